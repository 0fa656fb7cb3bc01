"""Registered queries of the studies, each beside the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions.columns import safe_corr
from tallyweave.operators import distributions, generation, studies, validation
from tallyweave.operators.retrieval import bin_table
from tallyweave.plans.catalogue import CURVE, KNN, NN_CASES, brand_arrays, knn, nn_cases, query, read, rounded
from tallyweave.sources import providers


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::double, 6) AS proportion FROM orders GROUP BY 1, 2")
def q_value_counts(spark, d):
    return rounded(studies.value_counts(read(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"]))


@query(
    """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
round(quantile_cont(value, 0.75), 6) AS p75, round(max(value), 6) AS max FROM events GROUP BY 1"""
)
def q_describe(spark, d):
    return rounded(studies.described(read(spark, d, "events"), ["event_type"], "value"))


@query(
    """SELECT l_returnflag, count(*) AS n, round(avg(l_tax), 6) AS avg_new, round(avg(l_discount), 6) AS avg_old, round(avg(l_discount) - avg(l_tax), 6) AS improvement, round(100 * (avg(l_discount) - avg(l_tax)) / avg(l_discount), 4) AS improvement_pct,
round(avg((l_tax < l_discount)::INT), 6) AS better FROM lineitem GROUP BY 1"""
)
def q_compared_errors(spark, d):
    got = studies.compared_errors(read(spark, d, "lineitem"), ["l_returnflag"], "l_tax", "l_discount")
    return rounded(got.withColumn("improvement_pct", F.round("improvement_pct", 4)))


@query(
    f"""WITH {NN_CASES}, x AS (SELECT lo, hi, error AS e, abs(similarity - 0.35) AS o FROM nn JOIN edges ON similarity > lo AND similarity <= hi)
SELECT lo, hi, count(*) AS n, round(avg(e), 6) AS avg_new, round(avg(o), 6) AS avg_old, round(avg(o) - avg(e), 6) AS improvement, round(avg((e < o)::INT), 6) AS better FROM x GROUP BY 1, 2"""
)
def q_errors_by_bin(spark, d):
    cases = nn_cases(spark, d).withColumn("old", F.abs(F.col("similarity") - 0.35))
    bins = bin_table(spark, (0.0, 0.25, 0.3, 0.35, 0.4, 1.01))
    return rounded(studies.errors_by_bin(cases, bins, "similarity", "error", "old").drop("improvement_pct"))


GATE = KNN + """, c0 AS (SELECT query_id, rank, similarity, 100 + (vec_id * 37) % 400 >= 200 AND vec_id % 4 > 1 AS quality, (vec_id % 25) / 100.0::double AS e FROM knn),
c1 AS (SELECT *, CASE WHEN quality THEN sum(quality::INT) OVER (PARTITION BY query_id ORDER BY rank) END AS good FROM c0),
c2 AS (SELECT query_id, arg_min(similarity, rank) AS top1, arg_min(quality, rank) AS q1, arg_min(e, rank) AS e1, count(*) FILTER (good <= 5) AS ng, sum(greatest(similarity, 0) * e) FILTER (good <= 5) / nullif(sum(greatest(similarity, 0)) FILTER (good <= 5), 0) AS eb, avg(e) FILTER (good <= 5) AS ep FROM c1 GROUP BY 1),
c3 AS (SELECT *, CASE WHEN top1 >= 0.4 THEN 'single_best' WHEN top1 >= 0.3 AND ng >= 2 THEN 'ensemble' ELSE 'none' END AS method FROM c2),
c4 AS (SELECT *, CASE WHEN method = 'ensemble' THEN coalesce(eb, ep) ELSE e1 END AS error FROM c3),
gated AS (SELECT query_id, method, top1, CASE WHEN method = 'ensemble' THEN ng ELSE 1 END AS n_used, error, (method = 'ensemble' OR (method = 'single_best' AND q1)) AND error <= 0.12 AS confident, e1 AS error_single, top1 >= 0.3 AND q1 AND e1 <= 0.12 AS confident_single FROM c4)"""


def gated(spark, d):
    rows = knn(spark, d).withColumn("quality", (F.lit(100) + (F.col("vec_id") * 37) % 400 >= 200) & (F.col("vec_id") % 4 > 1))
    return studies.coverage_gate(rows.withColumn("e", (F.col("vec_id") % 25) / 100), "e", 0.4, 0.3)


@query(f"WITH {GATE} SELECT query_id, method, round(top1, 6) AS top1, n_used, round(error, 6) AS error, confident, round(error_single, 6) AS error_single, confident_single FROM gated")
def q_coverage_gate(spark, d):
    return rounded(gated(spark, d))


@query(
    f"""WITH {GATE} SELECT count(*) AS n, round(100 * avg(confident::INT), 6) AS coverage, round(100 * avg(confident_single::INT), 6) AS coverage_single, round(avg(error) FILTER (confident), 6) AS error_inside,
round(avg(error_single) FILTER (confident_single), 6) AS error_inside_single, round(avg(error) FILTER (NOT confident), 6) AS error_outside FROM gated"""
)
def q_coverage_summary(spark, d):
    return rounded(studies.coverage_summary(gated(spark, d)))


@query(
    f"""WITH {CURVE}, m AS (SELECT pos, avg(y) AS y FROM cv GROUP BY 1), s AS (SELECT p_brand, avg(abs(cv.y - m.y)) AS g, avg(abs(cv.y - pos / 19.0::double)) AS u FROM cv JOIN m USING (pos) GROUP BY 1)
SELECT count(*) AS n, round(avg(g), 6) AS avg_new, round(avg(u), 6) AS avg_old, round(avg(u) - avg(g), 6) AS improvement, round(avg((g < u)::INT), 6) AS better FROM s"""
)
def q_shape_study(spark, d):
    curves = distributions.curves(brand_arrays(spark, d), ["p_brand"])
    generic = distributions.mean_curve(curves).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "y"))), lambda p: p["y"]).alias("generic"))
    return rounded(studies.compared_errors(studies.shape_study(curves, ["p_brand"], generic), [], "error_generic", "error_uniform").drop("improvement_pct"))


@query(
    """WITH noise AS (SELECT l_linenumber::BIGINT AS size, avg(l_tax) AS mean_noise FROM lineitem GROUP BY 1), b AS (SELECT avg(b) AS b FROM (SELECT l_returnflag, avg(l_discount - l_tax) AS b FROM lineitem GROUP BY 1))
SELECT size, round(mean_noise, 6) AS mean_noise, round(mean_noise / b, 6) AS share_of_benefit FROM noise, b"""
)
def q_benefit_share(spark, d):
    lines = read(spark, d, "lineitem")
    noise = lines.groupBy(F.col("l_linenumber").cast("bigint").alias("size")).agg(F.avg("l_tax").alias("mean_noise"))
    return rounded(studies.benefit_share(noise, lines, ["l_returnflag"], "l_discount", "l_tax"))


@query(
    """WITH m AS (SELECT l_linenumber, l_returnflag, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2), a AS (SELECT l_linenumber, avg(m) AS mean FROM m GROUP BY 1)
SELECT l_linenumber::BIGINT AS l_linenumber, count(*) AS n_repeats, round(any_value(mean), 6) AS mean, round(max(abs(m - mean)), 6) AS spread FROM m JOIN a USING (l_linenumber) GROUP BY 1"""
)
def q_spread_across_repeats(spark, d):
    return rounded(studies.spread_across_repeats(read(spark, d, "lineitem"), ["l_linenumber"], "l_returnflag", "l_quantity"))


ANSWERS = """ans AS (SELECT l_orderkey % 4 AS batch, l_orderkey, l_linenumber AS item, avg(CASE WHEN l_linenumber = 3 THEN 51 - l_quantity ELSE l_quantity END) AS v FROM lineitem GROUP BY 1, 2, 3),
pr AS (SELECT x.batch, x.item AS a, y.item AS b, count(*) AS n, CASE WHEN count(*) >= 3 THEN corr(x.v, y.v) END AS r FROM ans x JOIN ans y ON x.l_orderkey = y.l_orderkey AND x.item < y.item GROUP BY 1, 2, 3)"""


def answers(spark, d):
    rows = read(spark, d, "lineitem").select((F.col("l_orderkey") % 4).alias("batch"), "l_orderkey", F.col("l_linenumber").cast("bigint").alias("item"), F.col("l_quantity").alias("v"))
    return studies.reverse_scored(rows, "v", F.col("item") == 3, 50)


@query(f"WITH {ANSWERS} SELECT batch, a::BIGINT AS a, b::BIGINT AS b, n, round(r, 6) AS r FROM pr")
def q_pair_correlations(spark, d):
    return rounded(studies.pair_correlations(answers(spark, d), "batch", "l_orderkey", "item", "v"))


@query(
    f"""WITH {ANSWERS} SELECT batch, a::BIGINT AS a, b::BIGINT AS b, a // 4 = b // 4 AS same_scale, round((a * 10 + b) / 100.0::double, 6) AS real_r, round(r, 6) AS gen_r, ((a % 2 = 0)::INT + (b % 2 = 0)::INT) || ' of 2 anchored' AS anchors
FROM pr WHERE r IS NOT NULL AND (a + b) % 5 <> 0"""
)
def q_item_pairs(spark, d):
    numbers = spark.range(1, 8)
    real = numbers.select(F.col("id").alias("a"), F.explode(F.expr("sequence(1L, 7L)")).alias("b")).where("(a + b) % 5 <> 0").withColumn("r", (F.col("a") * 10 + F.col("b")) / 100)
    items = numbers.select(F.col("id").alias("item"), F.floor(F.col("id") / 4).alias("scale"), (F.col("id") % 2 == 0).alias("anchored"))
    return rounded(studies.item_pairs(studies.pair_correlations(answers(spark, d), "batch", "l_orderkey", "item", "v"), real, items, "batch"))


@query(
    """WITH s AS (SELECT l_orderkey % 4 AS batch, l_orderkey, l_linenumber // 3 AS scale, avg(CASE WHEN l_linenumber = 3 THEN 51 - l_quantity ELSE l_quantity END) AS v FROM lineitem GROUP BY 1, 2, 3)
SELECT x.batch, x.scale::BIGINT AS a, y.scale::BIGINT AS b, count(*) AS n, round(corr(x.v, y.v), 6) AS r FROM s x JOIN s y ON x.l_orderkey = y.l_orderkey AND x.scale < y.scale GROUP BY 1, 2, 3"""
)
def q_scale_pairs(spark, d):
    return rounded(studies.pair_correlations(answers(spark, d).withColumn("scale", F.floor(F.col("item") / 3)), "batch", "l_orderkey", "scale", "v"))


@query("SELECT event_type, round(0.798 * sqrt(2) * (1 - corr(value, user_id::double) ** 2) / sqrt(count(*) - 1), 9) AS noise FROM events GROUP BY 1")
def q_correlation_noise(spark, d):
    r = read(spark, d, "events").groupBy("event_type").agg(safe_corr("value", "user_id").alias("r"), F.count("*").alias("n"))
    return rounded(r.select("event_type", validation.correlation_noise(F.col("r"), F.col("n")).alias("noise")), 9)


def letter_counts(texts: list[str]) -> list[list[float]]:
    """A stand-in whose vectors SQL can state: the length, the number of a's, 1."""
    return [[float(len(t)), float(t.count("a")), 1.0] for t in texts]


@query(
    """WITH v AS (SELECT p_partkey, length(p_name)::double AS x, (length(p_name) - length(replace(p_name, 'a', '')))::double AS y FROM part)
SELECT p_partkey, i::BIGINT AS pos, round(CASE i WHEN 0 THEN x WHEN 1 THEN y ELSE 1 END / sqrt(x * x + y * y + 1), 6) AS x FROM v, range(3) t(i)"""
)
def q_embed_texts(spark, d):
    got = providers.embedded(read(spark, d, "part").select("p_partkey", "p_name"), "p_name", letter_counts)
    return rounded(got.select("p_partkey", F.posexplode("embedding").alias("pos", "x")))


@query("SELECT conv_id, turn, i::BIGINT - 1 AS item_no, trim(l) AS item, 'likert' AS kind FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS l, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations) WHERE trim(l) <> ''")
def q_item_lines(spark, d):
    return rounded(generation.item_lines(read(spark, d, "conversations").select("conv_id", "turn", "text"), "text", " ").select("conv_id", "turn", "item_no", "item", "kind"))
