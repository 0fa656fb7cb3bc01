"""Registered queries of the validation report and of whole requests, each beside the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions import columns as C
from tallyweave.operators import summary
from tallyweave.plans import whole_request
from tallyweave.plans.catalogue import TAX_SHARES, UNIFORM, query, read, rounded, tax_cuts
from tallyweave.plans.report_queries import checksum_provider
from tallyweave.sources.shared import new_path

# Items are brands: generated answers are line numbers (three partitions of suppliers), the real ones those of returned lines by quantity.
_BRAND = "substr(p_brand, 7)::INT"
ITEM_TABLE = f"""li AS (SELECT p_brand, l_suppkey % 3 AS part, l_linenumber AS lv, l_quantity AS w, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey),
ct AS (SELECT p_brand, part, lv, count(*) AS n FROM li GROUP BY ALL),
gp AS (SELECT p_brand, part, lv, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY p_brand, part)::double AS x FROM (SELECT DISTINCT p_brand, part FROM li) b CROSS JOIN (SELECT unnest(range(1, 8)) AS lv) t LEFT JOIN ct USING (p_brand, part, lv)),
pm AS (SELECT p_brand, part, sum(lv * x) AS m FROM gp GROUP BY ALL),
sp AS (SELECT p_brand, count(*) AS partitions, greatest(max(m) - avg(m), avg(m) - min(m)) AS spread FROM pm GROUP BY p_brand),
rs AS (SELECT p_brand, lv, sum(w) AS w FROM li WHERE l_returnflag = 'R' GROUP BY p_brand, lv), gm AS (SELECT p_brand, lv, avg(x) AS x FROM gp GROUP BY p_brand, lv),
d AS (SELECT 'g' AS s, p_brand, lv, x FROM gm UNION ALL SELECT 'r', p_brand, lv, w / sum(w) OVER (PARTITION BY p_brand) FROM rs UNION ALL SELECT 'f', p_brand, 8 - lv, x FROM gm),
m AS (SELECT s, p_brand, sum(lv * x) AS mean FROM d GROUP BY ALL),
v AS (SELECT s, p_brand, any_value(mean) AS mean, sqrt(sum(x * (lv - mean) ** 2)) AS sd, sum(x * (lv - mean) ** 3) AS m3, sum(x * (lv - mean) ** 4) AS m4, sum(x) FILTER (lv <= 2) AS low, sum(x) FILTER (lv >= 6) AS high FROM d JOIN m USING (s, p_brand) GROUP BY s, p_brand),
w AS (SELECT *, m3 / sd ** 3 AS skewness, m4 / sd ** 4 - 3 AS kurtosis FROM v),
cu AS (SELECT s, p_brand, lv, sum(x) OVER (PARTITION BY s, p_brand ORDER BY lv) AS c FROM d),
ap AS (SELECT g.p_brand, avg(abs(g.c - r.c)) AS cdf_distance, max(abs(g.c - r.c)) AS ks, avg(abs(f.c - r.c)) AS cdf_distance_flipped FROM cu g JOIN cu r USING (p_brand, lv) JOIN cu f USING (p_brand, lv) WHERE g.s = 'g' AND r.s = 'r' AND f.s = 'f' GROUP BY 1),
it AS (SELECT g.p_brand AS item, 's' || {_BRAND.replace('p_brand', 'g.p_brand')} % 4 AS scale, {_BRAND.replace('p_brand', 'g.p_brand')} % 2 = 0 AS reverse, 7::BIGINT AS k, '7-point' AS format,
    CASE WHEN {_BRAND.replace('p_brand', 'g.p_brand')} % 3 = 0 THEN 'population' ELSE 'calibrated' END AS source, 'high' AS tier, 'single_best' AS method, lower(g.p_brand) AS matched, 0.5::double AS similarity,
    CASE WHEN {_BRAND.replace('p_brand', 'g.p_brand')} % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS n_sources, partitions, spread,
    r.mean AS r_mean, r.sd AS r_sd, r.skewness AS r_skewness, r.kurtosis AS r_kurtosis, r.low AS r_low, r.high AS r_high, g.mean AS g_mean, g.sd AS g_sd, g.skewness AS g_skewness, g.kurtosis AS g_kurtosis, g.low AS g_low, g.high AS g_high,
    cdf_distance, ks, cdf_distance_flipped, CASE WHEN {_BRAND.replace('p_brand', 'g.p_brand')} % 3 = 0 THEN 'no real anchor' ELSE 'real anchor' END AS anchor
    FROM w g JOIN w r ON g.p_brand = r.p_brand JOIN ap ON ap.p_brand = g.p_brand JOIN sp ON sp.p_brand = g.p_brand WHERE g.s = 'g' AND r.s = 'r')"""
_DOUBLES = ["similarity", "spread", *[f"{s}_{m}" for s in "rg" for m in summary.MEASURES], "cdf_distance", "ks", "cdf_distance_flipped"]


def brand_items(spark, d):
    lines = read(spark, d, "lineitem").join(read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").withColumnRenamed("p_brand", "item")
    levels = lambda w: F.array(*[F.coalesce(C.ratio(F.sum(F.when(F.col("l_linenumber") == i, w)), F.sum(w)), F.lit(0.0)) for i in range(1, 8)]).alias("shares")
    answers = lines.groupBy("item", (F.col("l_suppkey") % 3).alias("partition")).agg(levels(F.lit(1.0)))
    number = F.substring("item", 7, 9).cast("int")
    real = lines.where("l_returnflag = 'R'").groupBy("item").agg(levels(F.col("l_quantity"))).select("item", "shares", F.concat(F.lit("s"), (number % 4).cast("string")).alias("scale"), (number % 2 == 0).alias("reverse"))
    source = F.when((number % 3 == 0) & (F.col("partition") < 2), "population").otherwise("calibrated").alias("source")
    coverage = answers.select("item", "partition", source, F.lit("high").alias("tier"), F.lit("single_best").alias("method"), F.lower("item").alias("matched"), (F.lit(0.5) + F.col("partition")).alias("similarity"))
    return summary.item_table(answers, coverage, real), real


@query(f"WITH {ITEM_TABLE} SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in _DOUBLES)}) FROM it")
def q_item_table(spark, d):
    return rounded(brand_items(spark, d)[0])


def _guarded(a: str, b: str) -> str:
    return f"CASE WHEN count(*) >= 3 AND stddev_pop({a}) > 1e-12 AND stddev_pop({b}) > 1e-12 THEN corr({a}, {b}) END"


_GAPS = {f"{m}_gap": f"avg(g_{m} - r_{m})" for m in summary.MEASURES} | {f"{m}_abs": f"avg(abs(g_{m} - r_{m}))" for m in summary.MEASURES if m != "kurtosis"}
_MARGINALS = _GAPS | {
    "cdf_distance": "avg(cdf_distance)", "ks": "avg(ks)", "r_of_means": _guarded("g_mean", "r_mean"), "r_of_sds": _guarded("g_sd", "r_sd"), "sd_of_generated_means": "stddev_pop(g_mean)", "sd_of_real_means": "stddev_pop(r_mean)",
}


def _intervals_sql(rows: str, by: str, unit: str, stats: dict[str, str], repeats: int, seed: int, least: int = 1) -> str:
    """CTEs up to ``iv`` (by, statistic, n, value, ci_low, ci_high) of the table ``rows``, drawn as ``summary.interval_table`` does."""
    listed = ", ".join(f"{e} AS {n}" for n, e in stats.items())
    ends = ", ".join(f"quantile_cont({n}, {p}) AS {n}_{s}" for n in stats for s, p in (("low", 0.025), ("high", 0.975)))
    each = " UNION ALL ".join(f"SELECT {by}, '{n}' AS statistic, n, {n} AS value, {n}_low AS ci_low, {n}_high AS ci_high FROM wh JOIN en USING ({by})" for n in stats)
    return f"""un AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {unit}) - 1 AS no, count(*) OVER (PARTITION BY {by}) AS units FROM (SELECT DISTINCT {by}, {unit} FROM {rows})),
dr AS (SELECT {by}, rep, floor({UNIFORM.format(key=f"{seed}, {by}, rep, no")} * units)::BIGINT AS no FROM un, range({repeats}) t(rep)),
ea AS (SELECT {by}, rep, {listed} FROM dr JOIN un USING ({by}, no) JOIN {rows} USING ({by}, {unit}) GROUP BY {by}, rep),
en AS (SELECT {by}, {ends} FROM ea GROUP BY {by}), wh AS (SELECT {by}, count(*) AS n, {listed} FROM {rows} GROUP BY {by} HAVING count(*) >= {least}), iv AS ({each})"""


@query(
    f"""WITH {ITEM_TABLE}, bl AS (SELECT 'all' AS block, * FROM it UNION ALL SELECT anchor, * FROM it UNION ALL SELECT 'reverse', * FROM it WHERE reverse), {_intervals_sql("bl", "block", "item", _MARGINALS, 60, 1)}
SELECT block, statistic, n, round(value, 5) AS value, round(ci_low, 5) AS ci_low, round(ci_high, 5) AS ci_high FROM iv"""
)
def q_marginal_report(spark, d):
    items, _ = brand_items(spark, d)
    blocks = {"all": F.lit(True), "no real anchor": F.col("anchor") == "no real anchor", "real anchor": F.col("anchor") == "real anchor", "reverse": F.col("reverse")}
    return rounded(summary.interval_table(summary.in_blocks(items, blocks), ["block"], ["item"], summary.marginal_statistics(), 60, seed=1), 5)


_PAIR = "corr(l_quantity, l_discount) AS real_r, corr(l_quantity, l_tax) AS gen_r"
PAIRS = f"""pr AS (SELECT p_brand AS batch, p_size % 8 AS a, p_size % 2 = 0 AS same_scale, (p_size % 8) % 3 || ' of 2 anchored' AS anchors, {_PAIR} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4),
sc AS (SELECT p_brand AS batch, {_PAIR} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, l_returnflag),
bl AS (SELECT 'items, all' AS block, batch, real_r, gen_r FROM pr UNION ALL SELECT 'items, different scales', batch, real_r, gen_r FROM pr WHERE NOT same_scale UNION ALL SELECT 'items, same scale', batch, real_r, gen_r FROM pr WHERE same_scale
    UNION ALL SELECT 'items, ' || anchors, batch, real_r, gen_r FROM pr UNION ALL SELECT 'scales', batch, real_r, gen_r FROM sc)"""
_PATTERN, _SLOPE = _guarded("gen_r", "real_r"), "CASE WHEN stddev_pop(real_r) > 1e-12 THEN covar_pop(real_r, gen_r) / var_pop(real_r) END"
_CORRELATIONS = {
    "pairs": "count(*)::double", "real_mean": "avg(real_r)", "generated_mean": "avg(gen_r)", "bias": "avg(gen_r - real_r)", "mae": "avg(abs(gen_r - real_r))", "rmse": "sqrt(avg((gen_r - real_r) ** 2))", "pattern_r": _PATTERN,
    "slope": _SLOPE, "intercept": f"avg(gen_r) - ({_SLOPE}) * avg(real_r)", "r2": f"({_PATTERN}) * ({_PATTERN})", "real_sd": "stddev_pop(real_r)", "generated_sd": "stddev_pop(gen_r)",
    "strong_real": "avg((abs(real_r) >= 0.3)::INT)", "strong_generated": "avg((abs(gen_r) >= 0.3)::INT)", "within": "avg((abs(gen_r - real_r) <= 0.1)::INT)",
    "mae_shrunk": "avg(abs(real_r - gen_r / 1.1::double))", "improved": "avg((abs(real_r - gen_r / 1.1::double) < abs(real_r - gen_r))::INT)",
}


@query(
    f"""WITH {PAIRS}, {_intervals_sql("bl", "block", "batch", _CORRELATIONS, 60, 2, 10)}, no AS (SELECT block, 'mae' AS statistic, avg(0.798 * sqrt(2.0::double) * (1 - real_r ** 2) / sqrt(397.0::double)) AS noise FROM bl GROUP BY 1)
SELECT block, statistic, n, round(value, 6) AS value, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(noise, 6) AS noise FROM iv LEFT JOIN no USING (block, statistic)"""
)
def q_correlation_report(spark, d):
    lines = read(spark, d, "lineitem").join(read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("batch"), "p_size"), "l_partkey")
    r = [F.corr("l_quantity", "l_discount").alias("real_r"), F.corr("l_quantity", "l_tax").alias("gen_r")]
    kind = (F.col("p_size") % 8).alias("a")
    pairs = lines.groupBy("batch", kind, (F.col("p_size") % 2 == 0).alias("same_scale")).agg(*r).withColumn("anchors", F.concat((F.col("a") % 3).cast("string"), F.lit(" of 2 anchored")))
    got = summary.correlation_report(pairs, lines.groupBy("batch", "l_returnflag").agg(*r), 398, 60, seed=2)
    return rounded(got, 6)


# A whole request: every hundredth vector is an item, the others are variables, customers are respondents.
def customer_known(spark, d):
    vectors = read(spark, d, "embeddings").where("vec_id % 100 <> 7")
    shares = tax_cuts(spark, d).select(F.transform(F.sequence(F.lit(1), F.size("cuts")), lambda i: F.element_at("cuts", i) - F.when(i > 1, F.try_element_at("cuts", F.greatest(i - 1, F.lit(1)))).otherwise(0.0)).alias("shares_"))
    variables = vectors.crossJoin(F.broadcast(shares)).select(
        F.col("vec_id").alias("variable"), F.concat(F.lit("label "), F.col("vec_id").cast("string")).alias("label"), "embedding", (F.lit(100) + (F.col("vec_id") * 37) % 400).alias("n"),
        (F.col("vec_id") % 4).alias("years"), F.when(F.col("vec_id") % 5 > 0, F.col("shares_")).alias("shares"),
    )
    generic = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: i / F.lit(20.0)).alias("cuts"))
    lookup = spark.createDataFrame([(0.0, 0.3, 5, 0.2, 0.05), (0.3, 0.4, 20, 0.1, 0.03), (0.4, 1.01, 30, 0.08, 0.02)], "lo double, hi double, n long, avg_error double, error_std double")
    people = read(spark, d, "customer").withColumns({"age": F.col("c_custkey") % 70 + 18, "sex": F.col("c_custkey") % 2 + 1, "race": F.col("c_custkey") % 3 + 1})
    return whole_request.Known(people, variables, generic, lookup)


def customer_whole_request(spark, d):
    known = customer_known(spark, d)
    items = read(spark, d, "embeddings").where("vec_id % 100 = 7")
    items = items.select(((F.col("vec_id") - 7) / 100 + 1).cast("int").alias("item"), F.concat(F.lit("item "), F.col("vec_id").cast("string")).alias("text"), F.when(F.col("vec_id") % 300 == 7, "binary").otherwise("likert").alias("kind"), "embedding")
    items = items.where("item <= 5")
    persona = F.concat(F.lit("customer "), F.col("c_custkey").cast("string"))
    return whole_request.whole_request(known, items, 200, 5, "c_custkey", "c_acctbal", checksum_provider, new_path(spark, "answers"), persona=persona, scale=7, high=0.4, low=0.3)


# Persons are drawn in order, so a score depends on the person's place alone.
SCORES = """sc AS (SELECT person, item, ((37 * (person % 8) + 11 * item) % 101) / 100.0::double AS raw FROM range(200) p(person), range(1, 6) t(item)),
sd AS (SELECT item, stddev_pop(raw) AS sd FROM sc GROUP BY 1), ti AS (SELECT item, max(c) / 200.0::double AS tie FROM (SELECT item, raw, count(*) AS c FROM sc GROUP BY 1, 2) GROUP BY 1)"""
CHOSEN = """pairs AS (SELECT q.vec_id AS query_id, (q.vec_id - 7) // 100 + 1 AS item, q.vec_id % 300 = 7 AS bin, c.vec_id, list_dot_product(q.embedding::double[], c.embedding::double[]) AS similarity FROM embeddings q JOIN embeddings c ON c.vec_id % 100 <> 7 WHERE q.vec_id % 100 = 7 AND q.vec_id < 500),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM pairs) WHERE rank <= 15),
cq AS (SELECT *, 100 + (vec_id * 37) % 400 AS n, vec_id % 4 AS years, NOT bin AND top <= 0.85 AS usable FROM near, (SELECT max(share) AS top FROM shares) WHERE vec_id % 5 > 0),
cg AS (SELECT *, usable AND n >= 200 AND years >= 2 AS quality, sum((usable AND n >= 200 AND years >= 2)::INT) OVER (PARTITION BY item ORDER BY rank) AS seen FROM cq),
ag AS (SELECT item, any_value(query_id) AS query_id, arg_min(similarity, rank) AS top1, min(rank) AS r0, min(rank) FILTER (usable) AS rb, least(count(*) FILTER (quality), 5) AS good, min(n) FILTER (quality AND seen <= 5) AS gn, min(years) FILTER (quality AND seen <= 5) AS gy,
    string_agg(vec_id::VARCHAR, '+' ORDER BY rank) FILTER (quality AND seen <= 5) AS names, string_agg('label ' || vec_id, '; ' ORDER BY rank) FILTER (quality AND seen <= 5) AS labels FROM cg GROUP BY item),
ch AS (SELECT ag.item, ag.query_id, top1, CASE WHEN top1 >= 0.4 THEN 'single_best' WHEN top1 >= 0.3 AND good >= 2 THEN 'ensemble' ELSE 'none' END AS method, good, gn, gy, names, labels,
    (top1 >= 0.4 AND rb IS NULL) OR (top1 >= 0.3 AND top1 < 0.4 AND good < 2) AS forced, p.vec_id AS one, p.n AS one_n, p.years AS one_y, f.vec_id AS first, f.n AS first_n, f.years AS first_y
    FROM ag JOIN cg p ON p.item = ag.item AND p.rank = coalesce(rb, r0) JOIN cg f ON f.item = ag.item AND f.rank = r0)"""
_TIER = "CASE WHEN method = 'ensemble' THEN 'moderate' WHEN method = 'single_best' AND NOT forced AND one_n >= 200 AND one_y > 1 THEN 'high' ELSE 'low' END"


@query(
    f"""WITH {TAX_SHARES}, {CHOSEN}, {SCORES}
SELECT 'item ' || query_id AS item, method, CASE method WHEN 'single_best' THEN one::VARCHAR WHEN 'ensemble' THEN names ELSE first::VARCHAR END AS matched_variable, CASE method WHEN 'single_best' THEN 'label ' || one WHEN 'ensemble' THEN labels ELSE 'label ' || first END AS matched_label,
round(top1, 6) AS similarity_top1, CASE method WHEN 'single_best' THEN one_n WHEN 'ensemble' THEN gn ELSE first_n END AS real_n_min, CASE method WHEN 'single_best' THEN one_y WHEN 'ensemble' THEN gy ELSE first_y END AS years_fielded_min,
CASE method WHEN 'ensemble' THEN good ELSE 1 END::BIGINT AS n_candidates_used, {_TIER} AS confidence_tier, {_TIER} <> 'low' AS confident_match, {_TIER} <> 'low' AS calibrated_produced, round(sd, 6) AS raw_propensity_std, sd < 0.06 AS low_variance_flag,
round(tie, 6) AS tie_concentration, tie > 0.8 AS high_tie_concentration_flag, forced AS anchor_forced_degenerate, CASE WHEN top1 > 0.4 THEN 0.08 WHEN top1 > 0.3 THEN 0.1 END::double AS expected_error, CASE WHEN top1 > 0.4 THEN 0.02 WHEN top1 > 0.3 THEN 0.03 END::double AS expected_error_std,
CASE WHEN top1 > 0.4 THEN 30 WHEN top1 > 0.3 THEN 20 WHEN top1 > 0 THEN 5 ELSE 0 END::BIGINT AS expected_error_n_cases FROM ch JOIN sd USING (item) JOIN ti USING (item)"""
)
def q_whole_request_report(spark, d):
    return rounded(customer_whole_request(spark, d)[1])
