"""Registered queries of the reports, each beside the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions import columns as C
from tallyweave.operators import distributions, reports, sampling
from tallyweave.plans import generate
from tallyweave.plans.catalogue import HIST, NN_CASES, TAX_SHARES, UNIFORM, event_histogram, nn_cases, query, read, region_codes, rounded, tax_cuts

CODES = "c AS (SELECT p_partkey, p_partkey % 5 AS item, p_size % 7 + CASE p_partkey % 5 WHEN 0 THEN 36 WHEN 1 THEN 8 WHEN 2 THEN 35 ELSE 1 END AS code FROM part)"


def part_codes(spark, d):
    base = F.element_at(F.array(*map(F.lit, (36, 8, 35, 1, 1))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 5).alias("item"), (F.col("p_size") % 7 + base).alias("code"))


@query(
    f"""WITH {CODES}, r AS (SELECT item, min(code) AS lo, max(code) AS hi FROM c GROUP BY 1), s AS (SELECT item, CASE WHEN lo >= 36 AND hi <= 42 THEN 35 WHEN lo >= 8 AND hi <= 14 THEN 7 END AS shift FROM r)
SELECT p_partkey, item, (code - coalesce(shift, 0))::BIGINT AS code, shift::BIGINT AS shift FROM c JOIN s USING (item)"""
)
def q_shifted_codes(spark, d):
    return rounded(reports.repaired_codes(part_codes(spark, d), ["item"], "code"))


@query(f"WITH {CODES} SELECT item, NOT bool_or(code < 1 OR code > 7) AND sum(1.0) > 0 AS usable FROM c GROUP BY 1")
def q_items_in_range(spark, d):
    return reports.items_in_range(part_codes(spark, d).withColumn("weight", F.lit(1.0)), ["item"], 7, "code")


@query(
    f"""WITH {NN_CASES}, x AS (SELECT similarity AS s, ln(least(n, 300)) AS l, error AS e FROM nn),
c AS (SELECT covar_pop(s, s) AS s11, covar_pop(l, l) AS s22, covar_pop(s, l) AS s12, covar_pop(s, e) AS s1y, covar_pop(l, e) AS s2y, avg(s) AS m1, avg(l) AS m2, avg(e) AS my, min(e) AS lo, max(e) AS hi FROM x),
b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM c)
SELECT query_id, vec_id, round(1 - (least(greatest(my - b1 * m1 - b2 * m2 + b1 * similarity + b2 * ln(greatest(least(n, 300), 1)), lo), hi) - lo) / (hi - lo), 6) AS confidence FROM nn, b"""
)
def q_confidence_score(spark, d):
    cases = nn_cases(spark, d).withColumn("n_own", F.lit(300))
    model = reports.confidence_model(cases, "similarity", "n_own", "n", "error")
    return rounded(reports.confidence_scores(cases, model, "similarity", "n_own", "n").select("query_id", "vec_id", "confidence"))


@query(
    """WITH g AS (SELECT c_nationkey, avg(c_acctbal) / 6000 AS a, median(c_acctbal) / 6000 AS b FROM customer GROUP BY 1)
SELECT count(*) AS n, round(avg(a), 6) AS mean_generated, round(avg(b), 6) AS mean_real, round(median(a), 6) AS median_generated, round(median(b), 6) AS median_real, (count(*) FILTER (a > b))::BIGINT AS n_higher,
round(avg(a - b), 6) AS mean_diff, round(avg(abs(a - b)), 6) AS mean_abs_diff, (count(*) FILTER (a >= 0.7))::BIGINT AS reliable_generated, (count(*) FILTER (b >= 0.7))::BIGINT AS reliable_real FROM g"""
)
def q_alpha_summary(spark, d):
    nations = read(spark, d, "customer").groupBy("c_nationkey").agg((F.avg("c_acctbal") / 6000).alias("a"), (F.percentile("c_acctbal", F.lit(0.5)) / 6000).alias("b"))
    return rounded(reports.paired_summary(nations, "a", "b"))


@query("SELECT c_mktsegment, count(*) AS n_stages, round(avg(m), 4) AS c_acctbal FROM (SELECT c_mktsegment, c_nationkey, avg(c_acctbal) AS m FROM customer GROUP BY 1, 2) GROUP BY 1")
def q_two_stage_mean(spark, d):
    return rounded(reports.two_stage_mean(read(spark, d, "customer"), ["c_mktsegment"], "c_nationkey", "c_acctbal"), 4)


SIDES = f"""{HIST}, sides AS (SELECT event_type, level, share AS g, lag(share, 1) OVER (PARTITION BY event_type ORDER BY level) AS prev, last_value(share) OVER (PARTITION BY event_type ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tail FROM hs),
pr AS (SELECT event_type, level, g, coalesce(prev, tail) AS r FROM sides)"""


@query(
    f"""WITH {SIDES}, m AS (SELECT event_type, sum(g * level) AS mg, sum(r * level) AS mr FROM pr GROUP BY 1),
c AS (SELECT event_type, level, sum(g) OVER w AS cg, sum(r) OVER w AS cr, sum(r) OVER (PARTITION BY event_type ORDER BY level DESC) AS cd FROM pr WINDOW w AS (PARTITION BY event_type ORDER BY level)),
k AS (SELECT a.event_type, max(abs(a.cg - a.cr)) AS ks, max(abs(a.cg - b.cd)) AS ks_reversed FROM c a JOIN c b ON a.event_type = b.event_type AND b.level = 8 - a.level GROUP BY 1)
SELECT event_type, round(any_value(mg), 6) AS mean_generated, round(any_value(mr), 6) AS mean_real, round(sqrt(sum(g * (level - mg) ** 2)), 6) AS sd_generated, round(sqrt(sum(r * (level - mr) ** 2)), 6) AS sd_real,
round(sum(CASE WHEN level <= 2 THEN g ELSE 0 END), 6) AS low_share_generated, round(sum(CASE WHEN level >= 6 THEN r ELSE 0 END), 6) AS high_share_real, round(any_value(mg - mr), 6) AS mean_diff, round(any_value(ks), 6) AS ks, round(any_value(ks_reversed), 6) AS ks_reversed
FROM pr JOIN m USING (event_type) JOIN k USING (event_type) GROUP BY 1"""
)
def q_item_comparison(spark, d):
    generated = distributions.share_vector(event_histogram(spark, d), ["event_type"])
    last = F.array(F.element_at("shares", -1))
    real = generated.select("event_type", F.concat(last, F.slice("shares", 1, 6)).alias("shares"))
    kept = ["event_type", "mean_generated", "mean_real", "sd_generated", "sd_real", "low_share_generated", "high_share_real", "mean_diff", "ks", "ks_reversed"]
    return rounded(reports.item_comparison(generated, real, ["event_type"]).select(*kept))


BLOCKS = (("all", "true"), ("few", "l_quantity < 10"), ("returned", "l_returnflag = 'R'"), ("none", "l_quantity > 1000"))


@query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS block, count(*) AS n, round(avg(l_discount - l_tax), 6) AS bias, round(avg(abs(l_discount - l_tax)), 6) AS mae, round(corr(l_discount, l_tax), 6) AS r FROM lineitem WHERE {test} HAVING count(*) >= 10" for name, test in BLOCKS
    )
)
def q_summary_blocks(spark, d):
    blocks = {name: F.expr(test) for name, test in BLOCKS}
    return rounded(reports.summary_blocks(read(spark, d, "lineitem"), blocks, "l_discount", "l_tax").select("block", "n", "bias", "mae", "r"))


@query(
    """WITH ppl AS (SELECT * FROM customer WHERE c_acctbal BETWEEN 500 AND 9000 AND c_nationkey NOT IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')),
cell AS (SELECT c_mktsegment, count(*) / sum(count(*)) OVER ()::double AS share FROM ppl GROUP BY 1),
f AS (SELECT *, floor(share * 250 + 1e-9) AS fl, row_number() OVER (ORDER BY round(share * 250 - floor(share * 250 + 1e-9), 9) DESC, c_mktsegment) AS n, row_number() OVER (ORDER BY c_mktsegment) - 1 AS no FROM cell),
q AS (SELECT c_mktsegment, no, (fl + CASE WHEN n <= 250 - sum(fl) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM f),
num AS (SELECT c_mktsegment, no * 250 + unnest(range(1, quota + 1)) AS draw_no FROM q), dw AS (SELECT *, {u} AS u FROM num),
sl AS (SELECT *, sum(c_acctbal::DECIMAL(28,6)) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) AS hi, sum(c_acctbal::DECIMAL(28,6)) OVER (PARTITION BY c_mktsegment) AS total FROM ppl)
SELECT draw_no::BIGINT AS draw_no, c_mktsegment, c_custkey FROM dw JOIN sl USING (c_mktsegment) WHERE u >= (hi - c_acctbal::DECIMAL(28,6))::double / total::double AND u < hi::double / total::double""".format(u=UNIFORM.format(key="0, draw_no"))
)
def q_quota_sample(spark, d):
    people = sampling.filter_by_label(read(spark, d, "customer").where("c_acctbal BETWEEN 500 AND 9000"), "c_nationkey", region_codes(spark, d, ["asia"], "exact"), negate=True)
    counts = people.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    cells = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("c_mktsegment", C.ratio("n", "total").alias("share"))
    return rounded(reports.quota_sample(people, cells, 250, ["c_mktsegment"], "c_acctbal", "c_custkey").select("draw_no", "c_mktsegment", "c_custkey"))


@query(
    """SELECT r_name, string_agg(n_nationkey || ' = ' || n_name, '; ' ORDER BY n_nationkey) AS dictionary FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"""
)
def q_key_values(spark, d):
    nations, regions = read(spark, d, "nation"), read(spark, d, "region")
    joined = nations.join(regions, nations["n_regionkey"] == regions["r_regionkey"])
    maps = joined.groupBy("r_name").agg(F.map_from_entries(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("m"))
    return maps.select("r_name", reports.key_values(F.col("m")).alias("dictionary"))


@query("SELECT event_id, CASE WHEN value > 100 THEN 'n/a' ELSE printf('%+.2f', floor(value) - 50) END AS shown FROM events")
def q_signed_number(spark, d):
    x = F.when(F.col("value") <= 100, F.floor("value").cast("double") - 50)
    return read(spark, d, "events").select("event_id", reports.signed_number(x).alias("shown"))


def checksum_provider(batch: dict) -> str:
    """A stand-in whose scores SQL can state: (37 person + 11 item) mod 101, as hundredths; persons from 0, items from 1."""
    import json

    items = range(1, int(batch["n_items"]) + 1)
    return json.dumps([{f"item_{i}": (37 * p + 11 * i) % 101 / 100 for i in items} for p in range(int(batch["n_people"]))])


def request_items(spark):
    """Three items; the third is binary where kinds count."""
    return spark.createDataFrame([(1, "one", "likert"), (2, "two", "likert"), (3, "three", "binary")], "item int, text string, kind string")


def customer_request(spark, d):
    people = read(spark, d, "customer")
    scores = generate.scored(people, "c_custkey", F.col("c_name"), F.pmod("c_custkey", F.lit(16)), request_items(spark), checksum_provider)
    tiers = F.explode(F.array(*[F.struct(F.lit(i).alias("item"), F.lit(t).alias("tier")) for i, t in enumerate(("high", "low", "moderate"), 1)])).alias("t")
    targets = tax_cuts(spark, d).select("cuts", tiers).select("t.*", "cuts")
    generic = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: i / F.lit(20.0)).alias("cuts"))
    return generate.request(scores, "c_custkey", targets, generic, 7)


REQUEST = f"""{TAX_SHARES}, pb AS (SELECT c_custkey, (row_number() OVER (PARTITION BY c_custkey % 16 ORDER BY c_custkey) - 1) % 8 AS person FROM customer),
sc AS (SELECT c_custkey, item, ((37 * person + 11 * item) % 101) / 100.0::double AS raw FROM pb, range(1, 4) t(item)),
pc AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY raw, c_custkey) / (count(*) OVER (PARTITION BY item))::double AS p FROM sc),
rk AS (SELECT *, least(1 + (SELECT count(*) FROM cuts WHERE cum < p), (SELECT max(k) FROM cuts)) AS r, least(1 + (SELECT count(*) FROM range(1, 21) g(i) WHERE i / 20.0::double < p), 20) AS g FROM pc)"""


@query(
    f"""WITH {REQUEST} SELECT c_custkey, item, round_even(CASE WHEN item = 2 THEN 1 + (g - 1) * 6.0::double / 19 ELSE 1 + (r - 1) * 6.0::double / ((SELECT max(k) FROM cuts) - 1) END, 0)::BIGINT AS response,
CASE WHEN item = 2 THEN 'population' ELSE 'calibrated' END AS source FROM rk"""
)
def q_generation_request(spark, d):
    return rounded(customer_request(spark, d)[0])


@query(
    f"""WITH {REQUEST}, c AS (SELECT item, raw, count(*) AS c FROM sc GROUP BY 1, 2)
SELECT item, CASE item WHEN 1 THEN 'high' WHEN 2 THEN 'low' ELSE 'moderate' END AS tier, sum(c)::BIGINT AS n, round((SELECT stddev_pop(raw) FROM sc WHERE sc.item = c.item), 6) AS raw_std, round(max(c) / sum(c)::double, 6) AS tie_concentration,
(SELECT stddev_pop(raw) FROM sc WHERE sc.item = c.item) < 0.06 AS low_variance, max(c) / sum(c)::double > 0.8 AS high_ties, CASE WHEN item = 2 THEN 'population' ELSE 'calibrated' END AS source, 0::BIGINT AS n_missing FROM c GROUP BY 1"""
)
def q_request_coverage(spark, d):
    return rounded(customer_request(spark, d)[1])
