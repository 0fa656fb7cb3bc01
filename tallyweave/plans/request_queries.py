"""Registered queries of whole requests and of respondents, each beside the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions import columns as C
from tallyweave.operators import distributions, generation, people, profile, reports
from tallyweave.plans import generate
from tallyweave.plans.catalogue import BATCHES, BRAND, brand_arrays, customer_batches, query, read, rounded
from tallyweave.plans.report_queries import REQUEST, checksum_provider, request_items
from tallyweave.sources import arrays


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 500 AND c_acctbal <= 2500")
def q_range_of_people(spark, d):
    return people.between(read(spark, d, "customer"), "c_acctbal", 500, 2500).select("c_custkey", "c_acctbal")


@query(
    """SELECT c_custkey, 'age ' || (18 + c_custkey % 60) || ', ' || CASE c_custkey % 3 WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' ELSE 'unknown' END || ', ' ||
CASE c_custkey % 4 WHEN 0 THEN '0' WHEN 1 THEN 'White' WHEN 2 THEN 'Black' ELSE 'Other' END || ', region: ' || CASE c_nationkey % 4 WHEN 0 THEN 'Northeast' WHEN 1 THEN 'Midwest' WHEN 2 THEN 'South' ELSE 'West' END AS person FROM customer"""
)
def q_people_described(spark, d):
    codes = {"age": F.lit(18.5) + F.col("c_custkey") % 60, "sex": F.nullif(F.col("c_custkey") % 3, F.lit(0)), "race": F.col("c_custkey") % 4, "region": F.col("c_nationkey") % 4 + 1}
    return read(spark, d, "customer").withColumns(codes).select("c_custkey", people.described({"sex": "", "race": "", "region": "region"}).alias("person"))


_LABELS = ", ".join(f"('{f}', {k}, '{v}')" for f in ("sex", "race", "region") for k, v in people.CODEBOOK[f].items())


@query(
    f"""WITH c AS (SELECT 'sex' AS "column", nullif(c_custkey % 3, 0) AS code FROM customer UNION ALL SELECT 'race', c_custkey % 5 FROM customer UNION ALL SELECT 'region', c_nationkey % 4 + 1 FROM customer WHERE c_nationkey % 4 < 3),
n AS (SELECT "column", code, count(*) AS n FROM c GROUP BY 1, 2) SELECT "column", string_agg(code || ' = ' || label, '; ' ORDER BY code) AS possible_values, sum(n)::BIGINT AS n FROM n JOIN (VALUES {_LABELS}) t("column", code, label) USING ("column", code) GROUP BY 1"""
)
def q_data_dictionary(spark, d):
    codes = {"sex": F.nullif(F.col("c_custkey") % 3, F.lit(0)), "race": F.col("c_custkey") % 5, "region": F.when(F.col("c_nationkey") % 4 < 3, F.col("c_nationkey") % 4 + 1)}
    return people.codes_in_use(read(spark, d, "customer").withColumns(codes), ["sex", "race", "region"])


@query(f"WITH {BRAND} SELECT p_brand, i::BIGINT AS point, round(sum(CASE WHEN 1 + j * 6.0::double / greatest(k - 1, 1) <= i + 1e-9 THEN share ELSE 0 END), 6) AS cum FROM sh, range(1, 8) t(i) GROUP BY 1, 2")
def q_cdf_on_grid(spark, d):
    cdf = distributions.cdf_on_grid(distributions.with_positions(brand_arrays(spark, d), ["p_brand"]), ["p_brand"], [float(i) for i in range(1, 8)])
    return rounded(cdf.select("p_brand", F.posexplode("cdf").alias("p", "cum")).select("p_brand", (F.col("p") + 1).alias("point"), "cum"))


@query(
    f"""WITH {BRAND}, g AS (SELECT p_brand, k, i, least(i * (k - 1) // 8, k - 2) AS j FROM (SELECT DISTINCT p_brand, k FROM cu), range(9) t(i)),
cv AS (SELECT g.p_brand, g.i AS pos, a.cum + (g.i * (g.k - 1) - g.j * 8) / 8.0::double * (c.cum - a.cum) AS y FROM g JOIN cu a ON a.p_brand = g.p_brand AND a.j = g.j JOIN cu c ON c.p_brand = g.p_brand AND c.j = g.j + 1)
SELECT p_brand, round(avg(abs(y - pos / 8.0::double)), 6) AS distance FROM cv GROUP BY 1"""
)
def q_curve_distance9(spark, d):
    points = distributions.curves(brand_arrays(spark, d), ["p_brand"], 9)
    return rounded(points.select("p_brand", C.mean_distance("curve", C.linspace(9)).alias("distance")))


@query("SELECT s_suppkey, s_name, n, round(quantity, 6) AS quantity FROM supplier JOIN (SELECT l_suppkey AS s_suppkey, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1) USING (s_suppkey)")
def q_aligned_rows(spark, d):
    lines = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
    return rounded(arrays.aligned(read(spark, d, "supplier").select("s_suppkey", "s_name"), lines, "s_suppkey"))


@query(
    """SELECT * FROM (VALUES ('L_TAX', false, true, 'l_tax'), ('l_quantity', true, true, 'l_quantity'), ('l_absent', false, false, NULL)) t(wanted, found, found_any_case, "column")
LEFT JOIN (SELECT 'l_tax' AS "column", count(l_tax) AS n FROM lineitem UNION ALL SELECT 'l_quantity', count(l_quantity) FROM lineitem) USING ("column")"""
)
def q_presence(spark, d):
    return profile.presence(read(spark, d, "lineitem"), ["L_TAX", "l_quantity", "l_absent"])


CATALOG = "ct AS (SELECT DISTINCT ' ' || upper(p_brand) AS variable, 'about ' || p_brand AS label FROM part), st AS (SELECT lower(p_brand) AS variable, count(*) AS n, avg(p_size) AS mean FROM part WHERE p_size > 5 AND p_partkey % 7 > 0 GROUP BY 1 HAVING min(p_partkey) % 3 > 0)"


@query(f"WITH {CATALOG} SELECT ct.variable, label, n, round(mean, 6) AS mean, CASE WHEN n IS NULL THEN 'no statistics' END AS error FROM ct LEFT JOIN st ON lower(trim(ct.variable)) = lower(trim(st.variable))")
def q_catalog_stats(spark, d):
    catalog, stats = brand_catalog(spark, d)
    return rounded(profile.catalog_with_stats(catalog, stats, "variable"))


@query(f"WITH {CATALOG} SELECT l_orderkey, l_linenumber, p_brand, lower(p_brand) IN (SELECT variable FROM st WHERE n >= 60) AS usable FROM lineitem JOIN part ON l_partkey = p_partkey")
def q_usable_members(spark, d):
    lines = read(spark, d, "lineitem").join(read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", F.lower("p_brand").alias("variable")), "l_partkey")
    marked = profile.marked_members(lines, "variable", brand_catalog(spark, d)[1].where("n >= 60"), "variable", "usable")
    return rounded(marked.select("l_orderkey", "l_linenumber", "p_brand", "usable"))


def brand_catalog(spark, d):
    parts = read(spark, d, "part")
    catalog = parts.select(F.concat(F.lit(" "), F.upper("p_brand")).alias("variable"), F.concat(F.lit("about "), F.col("p_brand")).alias("label")).distinct()
    stats = parts.where("p_size > 5 AND p_partkey % 7 > 0").groupBy(F.lower("p_brand").alias("variable")).agg(F.count("*").alias("n"), F.avg("p_size").alias("mean"), F.min("p_partkey").alias("k_")).where("k_ % 3 > 0").drop("k_")
    return catalog, stats


@query(
    """WITH c AS (SELECT l_returnflag, l_tax AS cat, count(*) AS w FROM lineitem GROUP BY 1, 2),
cu AS (SELECT l_returnflag, row_number() OVER q - 1 AS j, count(*) OVER (PARTITION BY l_returnflag) AS k, sum(w) OVER (q ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY l_returnflag)::double AS cum, sum(w) OVER (PARTITION BY l_returnflag) AS n FROM c WINDOW q AS (PARTITION BY l_returnflag ORDER BY cat)),
g AS (SELECT l_returnflag, k, n, i, least(i * (k - 1) // 19, k - 2) AS j FROM (SELECT DISTINCT l_returnflag, k, n FROM cu), range(20) t(i))
SELECT g.l_returnflag, g.i::BIGINT AS pos, g.n::BIGINT AS n_values, round(a.cum + (g.i * (g.k - 1) - g.j * 19) / 19.0::double * (b.cum - a.cum), 6) AS y FROM g JOIN cu a ON a.l_returnflag = g.l_returnflag AND a.j = g.j JOIN cu b ON b.l_returnflag = g.l_returnflag AND b.j = g.j + 1"""
)
def q_empirical_curve(spark, d):
    got = distributions.empirical_curves(read(spark, d, "lineitem"), ["l_returnflag"], "l_tax")
    return rounded(got.select("l_returnflag", "n_values", F.posexplode("curve").alias("pos", "y")))


@query(
    """WITH l AS (SELECT DISTINCT event_type FROM events), r AS (SELECT event_type, r, lv FROM (SELECT DISTINCT event_type, user_id % 3 AS r FROM events), range(1, 8) t(lv)),
c AS (SELECT event_type, user_id % 3 AS r, least(greatest(trunc(value / 500 * 7)::BIGINT + 1, 1), 7) AS lv, count(*) AS n FROM events GROUP BY 1, 2, 3),
s AS (SELECT event_type, r, lv, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY event_type, r)::double AS share FROM r LEFT JOIN c USING (event_type, r, lv))
SELECT event_type, lv::BIGINT AS level, round(avg(share), 6) AS share, count(*) AS n_repeats FROM s GROUP BY 1, 2"""
)
def q_mean_over_repeats(spark, d):
    level = F.least(F.greatest(F.floor(F.col("value") / 500 * 7) + 1, F.lit(1)), F.lit(7))
    rows = read(spark, d, "events").select("event_type", (F.col("user_id") % 3).alias("repeat"), level.alias("lv"))
    return rounded(distributions.mean_over_repeats(distributions.histogram(rows, ["event_type", "repeat"], "lv", 7), ["event_type"]))


ITEMS = "i AS (SELECT upper(p_brand) AS item, 's' || min(p_size) % 3 AS scale FROM part GROUP BY 1), rf AS (SELECT lower(p_brand) AS item, avg(p_size) AS m FROM part WHERE p_size > 3 GROUP BY 1 HAVING min(p_partkey) % 4 > 0)"


@query(f"WITH {ITEMS} SELECT i.item, CASE WHEN rf.item IS NULL THEN 'skipped' ELSE 'matched' END AS outcome, round(m, 6) AS m FROM i LEFT JOIN rf ON lower(i.item) = rf.item WHERE scale <> 's2'")
def q_skipped_items(spark, d):
    parts = read(spark, d, "part")
    items = parts.groupBy(F.upper("p_brand").alias("item")).agg(F.concat(F.lit("s"), (F.min("p_size") % 3).cast("string")).alias("scale"))
    ref = parts.where("p_size > 3").groupBy(F.lower("p_brand").alias("item")).agg(F.avg("p_size").alias("m"), F.min("p_partkey").alias("k")).where("k % 4 > 0").select("item", "m")
    matched, skipped = reports.matched_items(reports.without_scale(items, "scale", "s2"), ref, "item")
    both = matched.withColumn("outcome", F.lit("matched")).unionByName(skipped.withColumn("outcome", F.lit("skipped")), allowMissingColumns=True)
    return rounded(both.select("item", "outcome", "m"))


@query("SELECT c AS \"column\", round(m, 4) AS mean FROM (SELECT avg(s_suppkey) AS s_suppkey, avg(s_nationkey) AS s_nationkey, avg(s_acctbal) AS s_acctbal FROM supplier) UNPIVOT (m FOR c IN (s_suppkey, s_nationkey, s_acctbal))")
def q_numeric_means(spark, d):
    rows = read(spark, d, "supplier")
    found = profile.numeric_columns(rows)
    means = rows.agg(*[F.avg(c).alias(c) for c in found])
    return rounded(means.unpivot([], found, "column", "mean"), 4)


@query(
    f"""WITH {BATCHES} SELECT c_mktsegment, c_nationkey::BIGINT AS c_nationkey, batch::BIGINT AS batch, 'Estimate how survey respondents answer these items.' || chr(10) || chr(10) || 'Items:' || chr(10) || '1. one' || chr(10) || '2. two' || chr(10) || '3. three' || chr(10) || chr(10)
|| 'Give each person below a score from 0.0 (rejects it) to 1.0 (agrees fully) for each item, as it fits that person; let people differ.' || chr(10) || chr(10) || 'People:' || chr(10) || string_agg('Person ' || position || ': ' || c_name, chr(10) ORDER BY position)
|| chr(10) || chr(10) || 'Answer with a JSON array alone: one object a person, in order, with the numbers item_1 to item_3.' AS prompt FROM bt GROUP BY 1, 2, 3"""
)
def q_prompt_with_items(spark, d):
    prompts = generation.prompt_text(customer_batches(spark, d), ["c_mktsegment", "c_nationkey", "batch"], F.col("c_name"), "position")
    return rounded(generation.with_items(prompts, request_items(spark)))


def customer_dataset(spark, d):
    """Item 1 has a close variable, item 2 none, item 3 (binary) one of too few respondents."""
    rows = [(1, 1, 9, 0.9, 500, 3, True, True), (3, 1, 9, 0.8, 100, 3, True, False)]
    candidates = spark.createDataFrame(rows, "query_id int, rank int, vec_id long, similarity double, n int, years int, usable boolean, quality boolean")
    shares = profile.weighted_shares(read(spark, d, "lineitem").withColumn("vec_id", F.lit(9).cast("long")), ["vec_id"], "l_tax", "l_quantity")
    generic = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: i / F.lit(20.0)).alias("cuts"))
    lookup = spark.createDataFrame([(0.5, 0.85, 20, 0.1, 0.05), (0.85, 1.01, 5, 0.2, 0.05)], "lo double, hi double, n long, avg_error double, error_std double")
    people_ = read(spark, d, "customer")
    return generate.generate_dataset(request_items(spark), people_, "c_custkey", F.col("c_name"), F.pmod("c_custkey", F.lit(16)), candidates, distributions.share_arrays(shares, ["vec_id"]), generic, lookup, checksum_provider, 7, confirmed=True)


@query(
    f"""WITH {REQUEST} SELECT c_custkey, item, round(raw, 6) AS raw, (CASE item WHEN 1 THEN round_even(1 + (r - 1) * 6.0::double / ((SELECT max(k) FROM cuts) - 1), 0) WHEN 2 THEN round_even(1 + (g - 1) * 6.0::double / 19, 0) ELSE round_even(1 + (g - 1) / 19.0::double, 0) - 1 END)::BIGINT AS response,
CASE WHEN item = 1 THEN 'calibrated' ELSE 'population' END AS source FROM rk"""
)
def q_generated_dataset(spark, d):
    return rounded(customer_dataset(spark, d)[0])


@query(
    f"""WITH {REQUEST}, c AS (SELECT item, stddev_pop(raw) AS sd FROM sc GROUP BY 1)
SELECT item, CASE item WHEN 2 THEN 'none' ELSE 'single_best' END AS method, CASE WHEN item <> 2 THEN '9' END AS matched, CASE item WHEN 1 THEN 0.9 WHEN 3 THEN 0.8 END::double AS similarity_top1, CASE item WHEN 1 THEN 'high' ELSE 'low' END AS tier,
CASE item WHEN 1 THEN 500 WHEN 3 THEN 100 END::BIGINT AS n_min, CASE WHEN item = 3 THEN 0.1 END::double AS expected_error, CASE item WHEN 1 THEN 5 WHEN 3 THEN 20 ELSE 0 END::BIGINT AS expected_error_n, round(sd, 6) AS raw_propensity_std, item = 1 AS calibrated_produced, 0::BIGINT AS n_missing FROM c"""
)
def q_dataset_report(spark, d):
    report = customer_dataset(spark, d)[1]
    return rounded(report.select("item", "method", "matched", "similarity_top1", "tier", "n_min", "expected_error", "expected_error_n", "raw_propensity_std", "calibrated_produced", "n_missing"))


