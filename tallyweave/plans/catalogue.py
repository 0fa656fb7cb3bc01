"""Registered queries over the driver's tables, each beside the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import columns as C
from tallyweave.functions import draws
from tallyweave.operators import calibration, distributions, generation, profile, ranks, resampling, retrieval, sampling, validation
from tallyweave.sources import files
from tallyweave.sources.shared import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The draws of ``functions.draws``: of a key, and of 53 bits for a base and a stream.
UNIFORM = "(('0x' || substr(md5(concat_ws(':', {key})), 1, 13))::BIGINT / 4503599627370496.0::double)"


def numbers_sql(rows: str, key: str, stream: str) -> str:
    """A subquery: ``rows`` with ``n53``, the draw of 53 bits for the base of the key and the stream."""
    times = lambda x, f: f"((({x})::UHUGEINT * {f}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
    return f"""(SELECT * EXCLUDE (h0, h1, h2, h3, h4), (xor(h4, h4 >> 31) >> 11)::BIGINT AS n53 FROM (
        SELECT *, (((('0x' || substr(md5(concat_ws(':', {key})), 1, 15))::BIGINT)::UHUGEINT + (({stream})::UHUGEINT + 1::UHUGEINT) * {draws.STEP}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS h0,
            xor(h0, h0 >> 30) AS h1, {times('h1', draws.FIRST_FACTOR)} AS h2, xor(h2, h2 >> 27) AS h3, {times('h3', draws.SECOND_FACTOR)} AS h4 FROM {rows}))"""



def query(sql: str):
    """Register the function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles at a fixed number of places, so that sums in another order compare equal; -0 becomes 0."""
    return df.select([(F.round(F.col(c), places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


TAX_SHARES = """shares AS (SELECT l_tax AS cat, sum(l_quantity) / sum(sum(l_quantity)) OVER () AS share FROM lineitem WHERE l_quantity > 0 GROUP BY l_tax),
cuts AS (SELECT cat, sum(share) OVER (ORDER BY cat ROWS UNBOUNDED PRECEDING) AS cum, count(*) OVER () AS k FROM shares)"""


def tax_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").withColumn("v", F.lit("tax"))
    arrays = distributions.share_arrays(profile.weighted_shares(items, ["v"], "l_tax", "l_quantity"), ["v"])
    return distributions.cut_points(arrays, ["v"]).select("cuts", "k")


@query(
    f"""WITH {TAX_SHARES},
pct AS (SELECT event_id, event_type, row_number() OVER w / (count(*) OVER (PARTITION BY event_type))::double AS p FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value, event_id)),
ranks AS (SELECT event_id, event_type, least(1 + (SELECT count(*) FROM cuts WHERE cum < p), (SELECT max(k) FROM cuts)) AS r FROM pct)
SELECT event_id, event_type, round_even(1 + (r - 1) * 6.0::double / ((SELECT max(k) FROM cuts) - 1), 0)::BIGINT AS response FROM ranks"""
)
def q_calibrate_slice(spark, d):
    got = calibration.calibrated_batch(read(spark, d, "events"), tax_cuts(spark, d), ["event_type"], "value", "event_id", 7)
    return got.select("event_id", "event_type", F.col("response").cast("bigint").alias("response"))


@query(
    """WITH m AS (SELECT l_returnflag, sum(l_extendedprice * l_quantity) / sum(l_quantity) AS mean FROM lineitem WHERE l_quantity > 0 GROUP BY 1)
SELECT l_returnflag, count(*) AS n, round(any_value(mean), 4) AS mean, round(sqrt(sum(l_quantity * (l_extendedprice - mean) ** 2) / sum(l_quantity)), 4) AS std, round(min(l_extendedprice), 4) AS min, round(max(l_extendedprice), 4) AS max
FROM lineitem JOIN m USING (l_returnflag) WHERE l_quantity > 0 GROUP BY 1"""
)
def q_weighted_stats(spark, d):
    return rounded(profile.weighted_stats(read(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity"), 4)


@query(
    """SELECT l_returnflag, l_tax AS cat, round(sum(l_quantity), 6) AS weight, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_returnflag), 6) AS share
FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2"""
)
def q_weighted_shares(spark, d):
    return rounded(profile.weighted_shares(read(spark, d, "lineitem"), ["l_returnflag"], "l_tax", "l_quantity"))


SIZE_SHARES = """s AS (SELECT p_size AS cat, sum(l_quantity) AS w FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0 GROUP BY 1)"""


@query(
    f"""WITH {SIZE_SHARES}, r AS (SELECT *, row_number() OVER (ORDER BY w DESC, cat) AS rank, w / sum(w) OVER () AS share, count(*) OVER () AS total FROM s)
SELECT CASE WHEN rank <= 20 THEN cat::VARCHAR ELSE '__other__' END AS cat, round(sum(share), 6) AS share, any_value(total)::BIGINT AS n_categories_total, any_value(total) > 20 AS truncated FROM r GROUP BY 1"""
)
def q_topk_other(spark, d):
    lines, parts = read(spark, d, "lineitem"), read(spark, d, "part")
    sized = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).withColumn("v", F.lit("size"))
    return rounded(profile.top_with_other(profile.weighted_shares(sized, ["v"], "p_size", "l_quantity"), ["v"]).drop("v"))


@query(
    """WITH t(variable) AS (VALUES ('L_TAX'), ('l_discount'), ('l_extendedprice'), ('l_linenumber'), ('l_absent')),
long AS (UNPIVOT (SELECT l_quantity AS w, year(l_shipdate) AS y, l_tax, l_discount, l_extendedprice, l_linenumber::double AS l_linenumber FROM lineitem) ON l_tax, l_discount, l_extendedprice, l_linenumber INTO NAME v VALUE x),
a AS (SELECT v, count(*) AS n, count(DISTINCT y) AS n_years, min(y)::BIGINT AS first_year, max(y)::BIGINT AS last_year, sum(x * w) / sum(w) AS mean, min(x) AS min, max(x) AS max FROM long WHERE w > 0 GROUP BY v),
sd AS (SELECT v, sqrt(sum(w * (x - mean) ** 2) / sum(w)) AS std FROM long JOIN a USING (v) WHERE w > 0 GROUP BY v)
SELECT variable, coalesce(n, 0) AS n, coalesce(n_years, 0) AS n_years, first_year, last_year, round(mean, 4) AS mean, round(std, 4) AS std, round(min, 4) AS min, round(max, 4) AS max, CASE WHEN v IS NULL THEN 'not found' END AS error FROM t LEFT JOIN a ON lower(variable) = v LEFT JOIN sd USING (v)"""
)
def q_profile_long(spark, d):
    wanted = ["L_TAX", "l_discount", "l_extendedprice", "l_linenumber", "l_absent"]
    return rounded(profile.profile_variables(read(spark, d, "lineitem"), wanted, "l_quantity", F.year("l_shipdate")), 4)


@query(
    """WITH long AS (UNPIVOT (SELECT l_quantity AS w, l_linenumber::VARCHAR AS l_linenumber, l_returnflag, year(l_shipdate)::VARCHAR AS ship_year, l_suppkey::VARCHAR AS l_suppkey FROM lineitem) ON l_linenumber, l_returnflag, ship_year, l_suppkey INTO NAME variable VALUE cat),
s AS (SELECT variable, cat, sum(w) AS w FROM long WHERE w > 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY w DESC, cat) AS rank, w / sum(w) OVER (PARTITION BY variable) AS share, count(*) OVER (PARTITION BY variable) AS total FROM s)
SELECT variable, CASE WHEN rank <= 5 THEN cat ELSE '__other__' END AS cat, round(sum(share), 6) AS share, any_value(total)::BIGINT AS n_categories_total, any_value(total) > 5 AS truncated FROM r GROUP BY 1, 2"""
)
def q_profile_shares(spark, d):
    rows = read(spark, d, "lineitem").withColumn("ship_year", F.year("l_shipdate"))
    return rounded(profile.profile_shares(rows, ["L_Linenumber", "l_returnflag", "ship_year", "l_suppkey", "l_absent"], "l_quantity", 5))


@query("SELECT p_partkey, p_name FROM part WHERE trim(p_type) <> '' AND NOT regexp_matches(lower(trim(p_name)), '^(id|weight|version)|[0-4]$')")
def q_catalog_filter(spark, d):
    return profile.filter_catalog(read(spark, d, "part"), "p_name", "p_type", "^(id|weight|version)|[0-4]$").select("p_partkey", "p_name")


# Distributions: tax categories by part brand.
BRAND = """b AS (SELECT p_brand, l_tax AS cat, sum(l_quantity) AS w FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0 GROUP BY 1, 2),
sh AS (SELECT *, w / sum(w) OVER (PARTITION BY p_brand) AS share, row_number() OVER (PARTITION BY p_brand ORDER BY cat) - 1 AS j, count(*) OVER (PARTITION BY p_brand) AS k FROM b),
cu AS (SELECT *, sum(share) OVER (PARTITION BY p_brand ORDER BY cat ROWS UNBOUNDED PRECEDING) AS cum FROM sh)"""
CURVE = BRAND + """,
g AS (SELECT p_brand, k, i, least(i * (k - 1) // 19, k - 2) AS j FROM (SELECT DISTINCT p_brand, k FROM cu), range(20) t(i)),
cv AS (SELECT g.p_brand, g.i AS pos, a.cum + (g.i * (g.k - 1) - g.j * 19) / 19.0::double * (c.cum - a.cum) AS y FROM g JOIN cu a ON a.p_brand = g.p_brand AND a.j = g.j JOIN cu c ON c.p_brand = g.p_brand AND c.j = g.j + 1)"""


def brand_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    return distributions.share_arrays(profile.weighted_shares(joined, ["p_brand"], "l_tax", "l_quantity"), ["p_brand"])


@query(f"WITH {CURVE} SELECT p_brand, pos, round(y, 6) AS y FROM cv")
def q_cdf_curve20(spark, d):
    return rounded(distributions.curves(brand_arrays(spark, d), ["p_brand"]).select("p_brand", F.posexplode("curve").alias("pos", "y")))


@query(f"WITH {CURVE}, m AS (SELECT pos, avg(y) AS y FROM cv GROUP BY 1) SELECT p_brand, round(avg(abs(cv.y - m.y)), 6) AS distance, round(avg(abs(cv.y - pos / 19.0::double)), 6) AS uniform_distance FROM cv JOIN m USING (pos) GROUP BY 1")
def q_curve_distance(spark, d):
    points = distributions.curves(brand_arrays(spark, d), ["p_brand"])
    generic = distributions.mean_curve(points).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "y"))), lambda p: p["y"]).alias("generic"))
    joined = points.crossJoin(F.broadcast(generic))
    return rounded(joined.select("p_brand", C.mean_distance("curve", "generic").alias("distance"), C.mean_distance("curve", C.linspace(20)).alias("uniform_distance")))


@query(f"WITH {CURVE} SELECT pos, round(avg(y), 6) AS y FROM cv GROUP BY 1")
def q_generic_shape(spark, d):
    return rounded(distributions.mean_curve(distributions.curves(brand_arrays(spark, d), ["p_brand"])))


@query(f"WITH {BRAND} SELECT p_brand, round(sum(share * j / greatest(k - 1, 1)::double), 6) AS mean_rank FROM sh GROUP BY 1")
def q_mean_rank_norm(spark, d):
    return rounded(distributions.mean_rank(brand_arrays(spark, d), ["p_brand"]))


POSITIONS = BRAND + ", p AS (SELECT p_brand, 1 + j * 6.0::double / (k - 1) AS position, share FROM sh)"


@query(
    f"""WITH {POSITIONS}, m AS (SELECT p_brand, sum(share * position) AS mean FROM p GROUP BY 1),
s AS (SELECT p_brand, any_value(mean) AS mean, sum(share * (position - mean) ** 2) AS m2, sum(share * (position - mean) ** 3) AS m3, sum(share * (position - mean) ** 4) AS m4 FROM p JOIN m USING (p_brand) GROUP BY 1)
SELECT p_brand, round(mean, 6) AS mean, round(sqrt(m2), 6) AS sd, round(m3 / sqrt(m2) ** 3, 6) AS skewness, round(m4 / m2 ** 2 - 3, 6) AS kurtosis FROM s"""
)
def q_shape_moments(spark, d):
    return rounded(distributions.moments(distributions.with_positions(brand_arrays(spark, d), ["p_brand"]), ["p_brand"]))


@query(f"WITH {POSITIONS} SELECT p_brand, round(sum(CASE WHEN position <= 2 + 1e-9 THEN share ELSE 0 END), 6) AS low_share, round(sum(CASE WHEN position >= 6 - 1e-9 THEN share ELSE 0 END), 6) AS high_share FROM p GROUP BY 1")
def q_tail_shares(spark, d):
    return rounded(distributions.tail_shares(distributions.with_positions(brand_arrays(spark, d), ["p_brand"]), ["p_brand"]))


HIST = """h AS (SELECT e.event_type, l.level, (SELECT count(*) FROM events x WHERE x.event_type = e.event_type AND floor(x.value / 60)::INT + 1 = l.level) AS n FROM (SELECT DISTINCT event_type FROM events) e, (SELECT unnest(range(1, 8)) AS level) l),
hs AS (SELECT *, n / nullif(sum(n) OVER (PARTITION BY event_type), 0)::double AS share FROM h)"""


def event_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").withColumn("level_", F.floor(F.col("value") / 60).cast("int") + 1)
    return distributions.histogram(rows, ["event_type"], "level_", 7)


@query(f"WITH {HIST} SELECT event_type, level::BIGINT AS level, n, round(coalesce(share, 0), 6) AS share FROM hs")
def q_histogram_zero_filled(spark, d):
    return rounded(event_histogram(spark, d).select("event_type", "level", "n", "share"))


@query(
    f"""WITH {HIST}, c AS (SELECT event_type, level, sum(share) OVER (PARTITION BY event_type ORDER BY level) AS up, sum(share) OVER (PARTITION BY event_type ORDER BY level DESC) AS down FROM hs),
v AS (SELECT a.event_type, a.level, a.up AS f, b.down AS g FROM c a JOIN c b ON a.event_type = b.event_type AND b.level = 8 - a.level)
SELECT event_type, round(max(abs(f - g)), 6) AS ks_reversed FROM v GROUP BY 1"""
)
def q_ks_reversed(spark, d):
    v = distributions.share_vector(event_histogram(spark, d), ["event_type"])
    return rounded(v.select("event_type", C.max_distance(C.running_sum("shares"), C.running_sum(F.reverse("shares"))).alias("ks_reversed")))


# Retrieval: every 50th vector asks all others; label statistics stand for variables.
KNN = """pairs AS (SELECT q.vec_id AS query_id, c.vec_id, c.label, list_dot_product(q.embedding::double[], c.embedding::double[]) AS similarity FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM pairs) WHERE rank <= 15)"""
LABEL = """lab AS (SELECT l_suppkey % 10 AS label, l_linenumber AS cat, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
us AS (SELECT label, count(*) AS cats, max(w) / sum(w) AS top FROM lab GROUP BY 1)"""
CANDIDATES = KNN + ", " + LABEL + """,
cand AS (SELECT k.query_id, k.rank, k.vec_id, k.similarity, 100 + (k.vec_id * 37) % 400 AS n, k.vec_id % 4 AS years, coalesce(cats >= 3 AND top <= 0.26, false) AS usable FROM knn k LEFT JOIN us ON us.label = k.label),
cq AS (SELECT *, usable AND n >= 200 AND years > 1 AS quality FROM cand),
cg AS (SELECT *, CASE WHEN quality THEN sum(quality::INT) OVER (PARTITION BY query_id ORDER BY rank) END AS good FROM cq),
agg AS (SELECT query_id, arg_min(similarity, rank) AS top1, min(rank) AS r0, min(rank) FILTER (usable) AS rb, count(*) FILTER (good <= 5) AS n_good, min(n) FILTER (good <= 5) AS good_n, min(years) FILTER (good <= 5) AS good_years, string_agg(vec_id::VARCHAR, '+' ORDER BY rank) FILTER (good <= 5) AS names FROM cg GROUP BY 1),
choice AS (SELECT a.query_id, CASE WHEN top1 >= 0.4 THEN 'single_best' WHEN top1 >= 0.3 AND n_good >= 2 THEN 'ensemble' ELSE 'none' END AS method,
 CASE WHEN top1 >= 0.4 THEN p.vec_id::VARCHAR WHEN top1 >= 0.3 AND n_good >= 2 THEN names END AS matched, top1,
 CASE WHEN top1 >= 0.4 THEN p.n WHEN top1 >= 0.3 AND n_good >= 2 THEN good_n END AS n_min, CASE WHEN top1 >= 0.4 THEN p.years WHEN top1 >= 0.3 AND n_good >= 2 THEN good_years END AS years_min,
 CASE WHEN top1 >= 0.4 THEN 1 WHEN top1 >= 0.3 AND n_good >= 2 THEN n_good ELSE 0 END AS n_used, (top1 >= 0.4 AND rb IS NULL) OR (top1 >= 0.3 AND top1 < 0.4 AND n_good < 2) AS forced_degenerate
 FROM agg a JOIN cg p ON p.query_id = a.query_id AND p.rank = coalesce(rb, r0))"""


def knn(spark: SparkSession, sf_dir: str, k: int = 15) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return retrieval.similar(asked, vectors.select("vec_id", F.col("embedding").alias("v")), k)


def label_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").withColumn("label", (F.col("l_suppkey") % 10).cast("int"))
    return profile.weighted_shares(lines, ["label"], "l_linenumber", "l_quantity")


def label_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors by label; a stricter limit than the default, so that some labels fail."""
    return label_shares(spark, sf_dir).groupBy("label").agg(((F.count("*") >= 3) & (F.max("share") <= 0.26)).alias("usable"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    rows = knn(spark, sf_dir).join(labels, "vec_id").join(label_usable(spark, sf_dir), "label", "left")
    rows = rows.withColumn("n", F.lit(100) + (F.col("vec_id") * 37) % 400).withColumn("years", F.col("vec_id") % 4).withColumn("usable", F.coalesce("usable", F.lit(False)))
    return rows.withColumn("quality", F.col("usable") & (F.col("n") >= 200) & (F.col("years") > 1))


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.retrieval_choice(candidates(spark, sf_dir), 0.4, 0.3)


@query(f"WITH {KNN} SELECT query_id, rank, vec_id, round(similarity, 9) AS similarity FROM knn")
def q_knn_top15(spark, d):
    return rounded(knn(spark, d), 9)


@query(f"WITH {KNN} SELECT query_id, vec_id, round(similarity, 9) AS similarity FROM knn WHERE rank = 1")
def q_nn_argmax(spark, d):
    return rounded(knn(spark, d, 1).drop("rank"), 9)


@query(
    """WITH s AS (SELECT p_brand, p_size % 7 AS cat, sum(l_quantity) AS w FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0 GROUP BY 1, 2)
SELECT p_brand, count(*) AS cats, round(max(w) / sum(w), 6) AS max_share, count(*) >= 3 AND max(w) / sum(w) <= 0.85 AS likert, count(*) = 2 AND max(w) / sum(w) <= 0.95 AS "binary" FROM s GROUP BY 1"""
)
def q_usable_anchor(spark, d):
    lines, parts = read(spark, d, "lineitem"), read(spark, d, "part").withColumn("cat_", F.col("p_size") % 7)
    shares = profile.weighted_shares(lines.join(parts, lines["l_partkey"] == parts["p_partkey"]), ["p_brand"], "cat_", "l_quantity")
    top = shares.groupBy("p_brand").agg(F.count("*").alias("cats"), F.max("share").alias("max_share"))
    usable = lambda kind: retrieval.usable_anchor(F.col("cats"), F.col("max_share"), kind).alias(kind)
    return rounded(top.select("p_brand", "cats", "max_share", usable("likert"), usable("binary")))


@query(f"WITH {CANDIDATES} SELECT query_id, method, matched, round(top1, 9) AS top1, n_min, years_min, n_used::BIGINT AS n_used, forced_degenerate FROM choice")
def q_hybrid_retrieval(spark, d):
    return rounded(choices(spark, d), 9)


@query(
    f"""WITH {CANDIDATES}, ls AS (SELECT label, cat, w / sum(w) OVER (PARTITION BY label) AS share, row_number() OVER (PARTITION BY label ORDER BY cat) - 1 AS j, count(*) OVER (PARTITION BY label) AS k FROM lab),
lc AS (SELECT *, sum(share) OVER (PARTITION BY label ORDER BY cat ROWS UNBOUNDED PRECEDING) AS cum FROM ls), lg AS (SELECT label, k, i, least(i * (k - 1) // 19, k - 2) AS j FROM (SELECT DISTINCT label, k FROM lc), range(20) t(i)),
lv AS (SELECT lg.label, lg.i AS pos, a.cum + (lg.i * (lg.k - 1) - lg.j * 19) / 19.0::double * (c.cum - a.cum) AS y FROM lg JOIN lc a ON a.label = lg.label AND a.j = lg.j JOIN lc c ON c.label = lg.label AND c.j = lg.j + 1)
SELECT query_id, pos::BIGINT AS pos, round(sum(greatest(c.similarity, 0) * y) / sum(greatest(c.similarity, 0)), 6) AS y FROM cg c JOIN embeddings v ON v.vec_id = c.vec_id JOIN lv ON lv.label = v.label WHERE c.good <= 5 GROUP BY 1, 2"""
)
def q_ensemble_curve(spark, d):
    from pyspark.sql import Window

    from tallyweave.plans.generate import ensemble_cuts

    order = Window.partitionBy("query_id").orderBy("rank")
    used = candidates(spark, d).where("quality").withColumn("good", F.row_number().over(order)).where("good <= 5")
    blended = ensemble_cuts(used, distributions.share_arrays(label_shares(spark, d), ["label"]), "query_id", "label")
    return rounded(blended.select("query_id", F.posexplode("cuts").alias("pos", "y")))


NN_CASES = KNN + """, nn AS (SELECT query_id, vec_id, similarity, abs(similarity - 0.3) AS error, 100 + (vec_id * 37) % 400 AS n, vec_id % 4 AS years FROM knn WHERE rank <= 3),
edges(lo, hi) AS (VALUES (0.0::double, 0.25::double), (0.25, 0.3), (0.3, 0.35), (0.35, 0.4), (0.4, 1.01)),
look AS (SELECT lo, hi, count(error) AS n, avg(error) AS avg_error, stddev_samp(error) AS error_std FROM edges LEFT JOIN nn ON similarity > lo AND similarity <= hi GROUP BY 1, 2)"""
EDGES = (0.0, 0.25, 0.3, 0.35, 0.4, 1.01)


def nn_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = knn(spark, sf_dir, 3).withColumn("error", F.abs(F.col("similarity") - 0.3))
    return rows.withColumn("n", F.lit(100) + (F.col("vec_id") * 37) % 400).withColumn("years", F.col("vec_id") % 4).drop("rank")


@query(f"WITH {NN_CASES} SELECT lo, hi, n, round(avg_error, 6) AS avg_error, round(error_std, 6) AS error_std FROM look")
def q_similarity_bins(spark, d):
    return rounded(retrieval.error_lookup(nn_cases(spark, d), retrieval.bin_table(spark, EDGES)))


@query(
    f"""WITH {NN_CASES} SELECT x.query_id, x.vec_id, round(CASE WHEN look.n >= 10 THEN avg_error END, 6) AS expected_error, round(CASE WHEN look.n >= 10 THEN error_std END, 6) AS expected_error_std, coalesce(look.n, 0) AS expected_error_n
FROM nn x LEFT JOIN look ON similarity > lo AND similarity <= hi"""
)
def q_expected_error(spark, d):
    cases = nn_cases(spark, d)
    lookup = retrieval.error_lookup(cases, retrieval.bin_table(spark, EDGES))
    return rounded(retrieval.expected_error(cases.select("query_id", "vec_id", "similarity"), lookup, "similarity").drop("similarity"))


@query(
    f"""WITH {NN_CASES}, g AS (SELECT s::double AS sim_thresh, m::BIGINT AS n_thresh FROM (VALUES (0.25), (0.3), (0.35)) a(s), (VALUES (150), (300)) b(m)),
r AS (SELECT sim_thresh, n_thresh, similarity >= sim_thresh AND n >= n_thresh AND years > 1 AS ok, error FROM nn, g)
SELECT sim_thresh, n_thresh, (count(*) FILTER (ok))::BIGINT AS n_passing, round(round_even(100 * avg(ok::INT), 1), 6) AS pct_coverage, round(round_even(avg(error) FILTER (ok), 4), 6) AS avg_error_passing, round(round_even(avg(error) FILTER (NOT ok), 4), 6) AS avg_error_failing,
round(round_even(avg(error) FILTER (NOT ok), 4) - round_even(avg(error) FILTER (ok), 4), 6) AS error_reduction FROM r GROUP BY 1, 2 HAVING count(*) FILTER (ok) >= 5"""
)
def q_grid_search(spark, d):
    return rounded(validation.grid_search(nn_cases(spark, d), "similarity", "n", F.col("years") > 1, "error", [0.25, 0.3, 0.35], [150, 300], 5))


@query(
    f"""WITH {KNN}, v AS (SELECT k.query_id, k.rank, k.similarity, q.label AS ql, c.label AS cl FROM knn k JOIN embeddings q ON q.vec_id = k.query_id JOIN embeddings c ON c.vec_id = k.vec_id WHERE k.rank <= 5)
SELECT query_id, round(max(CASE WHEN rank = 1 THEN abs(ql - cl) END)::double, 6) AS error_single, round(abs(any_value(ql) - sum(greatest(similarity, 0) * cl) / sum(greatest(similarity, 0))), 6) AS error_ensemble FROM v GROUP BY 1"""
)
def q_holdout_ensemble_vs_single(spark, d):
    labels = read(spark, d, "embeddings").select("vec_id", "label")
    rows = knn(spark, d, 5).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    rows = rows.withColumn("w", retrieval.ensemble_weights(F.col("similarity")))
    single = F.max(F.when(F.col("rank") == 1, F.abs(F.col("own") - F.col("label")))).cast("double")
    return rounded(rows.groupBy("query_id").agg(single.alias("error_single"), F.abs(F.first("own") - F.sum(F.col("w") * F.col("label"))).alias("error_ensemble")))


# Sampling.
def region_codes(spark: SparkSession, sf_dir: str, texts: list[str], how: str) -> DataFrame:
    nations, regions = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    labels = nations.join(regions, nations["n_regionkey"] == regions["r_regionkey"]).select(F.lit("nation").alias("variable"), F.col("n_nationkey").alias("code"), F.col("r_name").alias("label"))
    return sampling.codes_matching(labels, "nation", texts, how)


@query("SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE lower(trim(r_name)) LIKE '%a%' AND lower(r_name) LIKE '%m%')")
def q_label_filter_semi(spark, d):
    codes = region_codes(spark, d, ["m"], "contains").join(region_codes(spark, d, ["a"], "contains"), "code", "left_semi")
    return rounded(sampling.filter_by_label(read(spark, d, "customer"), "c_nationkey", codes).select("c_custkey", "c_nationkey"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE lower(trim(r_name)) = 'asia')")
def q_label_filter_anti(spark, d):
    return sampling.filter_by_label(read(spark, d, "customer"), "c_nationkey", region_codes(spark, d, ["asia"], "exact"), negate=True).select("c_custkey")


@query(
    """WITH c AS (SELECT c_mktsegment, count(*) / sum(count(*)) OVER ()::double AS share FROM customer GROUP BY 1),
f AS (SELECT *, floor(share * 997 + 1e-9) AS fl, row_number() OVER (ORDER BY round(share * 997 - floor(share * 997 + 1e-9), 9) DESC, c_mktsegment) AS n FROM c)
SELECT c_mktsegment, (fl + CASE WHEN n <= 997 - sum(fl) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM f"""
)
def q_quota_largest_remainder(spark, d):
    counts = read(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    cells = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("c_mktsegment", C.ratio("n", "total").alias("share"))
    return sampling.largest_remainder(cells, 997, ["c_mktsegment"]).select("c_mktsegment", "quota")


@query("SELECT c_custkey, c_mktsegment, round(c_acctbal, 6) AS c_acctbal FROM customer WHERE nullif(c_nationkey, 3) IS NOT NULL AND nullif(c_mktsegment, 'BUILDING') IS NOT NULL")
def q_complete_cases(spark, d):
    rows = read(spark, d, "customer").withColumn("c_nationkey", F.nullif("c_nationkey", F.lit(3))).withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return rounded(sampling.complete_cases(rows, ["c_nationkey", "c_mktsegment"]).select("c_custkey", "c_mktsegment", "c_acctbal"))


@query(f"SELECT c_custkey FROM (SELECT c_custkey, {UNIFORM.format(key="17, c_custkey")} AS u FROM customer) ORDER BY u, c_custkey LIMIT 100")
def q_simple_random_sample(spark, d):
    return sampling.sample_without_replacement(read(spark, d, "customer").select("c_custkey"), 100, "c_custkey", draws.uniform(17, "c_custkey"))


# Generation.
@query("SELECT c_custkey, coalesce(n_name, c_nationkey::VARCHAR, 'unknown') AS nation FROM (SELECT c_custkey, nullif(c_nationkey, 7) AS c_nationkey FROM customer) LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def q_persona_labels(spark, d):
    labels = read(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"))
    people = read(spark, d, "customer").withColumn("c_nationkey", F.nullif("c_nationkey", F.lit(7)))
    return generation.code_label(people, "c_nationkey", labels, "nation").select("c_custkey", "nation")


BATCHES = "bt AS (SELECT c_custkey, c_name, c_mktsegment, c_nationkey, (row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) - 1) // 8 AS batch, (row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) - 1) % 8 + 1 AS position FROM customer)"


def customer_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generation.batches(read(spark, sf_dir, "customer"), "c_custkey", 8, ["c_mktsegment", "c_nationkey"])


@query(f"WITH {BATCHES} SELECT c_custkey, batch::BIGINT AS batch, position::BIGINT AS position FROM bt")
def q_batches(spark, d):
    return rounded(customer_batches(spark, d).select("c_custkey", "batch", "position"))


@query(f"WITH {BATCHES} SELECT c_mktsegment, c_nationkey::BIGINT AS c_nationkey, batch::BIGINT AS batch, string_agg('Person ' || position || ': ' || c_name, chr(10) ORDER BY position) AS prompt FROM bt GROUP BY 1, 2, 3")
def q_prompt_text(spark, d):
    return rounded(generation.prompt_text(customer_batches(spark, d), ["c_mktsegment", "c_nationkey", "batch"], F.col("c_name"), "position"))


@query("SELECT event_id, json_extract(props, '$.k')::double AS score FROM events")
def q_json_scores(spark, d):
    answer = F.concat(F.lit("```json\n["), "props", F.lit("]\n```"))
    maps = generation.parsed_scores(answer)
    return read(spark, d, "events").select("event_id", F.try_element_at(F.try_element_at(maps, F.lit(1)), F.lit("k")).alias("score"))


@query(
    """WITH u AS (SELECT c_custkey AS user_id FROM customer), l AS (SELECT user_id, list(value ORDER BY event_id) FILTER (event_id IS NOT NULL) AS v FROM u LEFT JOIN events USING (user_id) GROUP BY 1)
SELECT user_id, i::BIGINT AS pos, round(CASE WHEN v IS NULL THEN 0.5 ELSE v[least(i + 1, len(v))] END, 6) AS score FROM l, range(5) t(i)"""
)
def q_batch_repair(spark, d):
    users = read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    own = read(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda s: s["value"]).alias("v"))
    return rounded(users.join(own, "user_id", "left").select("user_id", F.posexplode(generation.repaired(F.col("v"), F.lit(5))).alias("pos", "score")))


@query(
    """WITH c AS (SELECT event_type, value, count(*) AS c FROM events GROUP BY 1, 2)
SELECT event_type, sum(c)::BIGINT AS n, round((SELECT stddev_pop(value / 500) FROM events e WHERE e.event_type = c.event_type), 6) AS raw_std, round(max(c) / sum(c)::double, 6) AS tie_concentration, count(*) < 2 AS degenerate,
(SELECT stddev_pop(value / 500) FROM events e WHERE e.event_type = c.event_type) < 0.06 AS low_variance, max(c) / sum(c)::double > 0.8 AS high_ties FROM c GROUP BY 1"""
)
def q_quality_flags(spark, d):
    return rounded(calibration.quality_flags(read(spark, d, "events").withColumn("raw", F.col("value") / 500), ["event_type"], "raw"))


# Twenty generic cut points: the mean brand curve.
POPULATION = CURVE + """, gen AS (SELECT pos, round(avg(y), 9) AS y FROM cv GROUP BY 1),
pct AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) / (count(*) OVER (PARTITION BY event_type))::double AS p FROM events),
pop AS (SELECT event_id, event_type, value, p, least(1 + (SELECT count(*) FROM gen WHERE y < p), 20) AS r FROM pct)"""


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = distributions.mean_curve(distributions.curves(brand_arrays(spark, sf_dir), ["p_brand"]))
    cuts = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "y"))), lambda p: F.round(p["y"], 9)).alias("cuts"))
    return calibration.percentiles(read(spark, sf_dir, "events"), ["event_type"], "value", "event_id").crossJoin(F.broadcast(cuts))


@query(f"WITH {POPULATION} SELECT event_id, round_even(1 + (r - 1) * 6.0::double / 19, 0)::BIGINT AS response FROM pop")
def q_population_calibrated(spark, d):
    rows = population(spark, d)
    return rounded(rows.select("event_id", calibration.calibrate(rows, 7).alias("response")))


@query(f"WITH {POPULATION} SELECT event_id, round_even(1 + (r - 1) * 1.0::double / 19, 0)::BIGINT - 1 AS answer FROM pop")
def q_binary_output(spark, d):
    rows = population(spark, d)
    return rounded(rows.select("event_id", (calibration.calibrate(rows, 2) - 1).alias("answer")))


@query("SELECT event_id, least(greatest(trunc(value / 500 * 7)::BIGINT + 1, 1), 7) AS bin FROM events")
def q_naive_bins(spark, d):
    return rounded(read(spark, d, "events").select("event_id", calibration.naive_bin(F.col("value") / 500, 7).alias("bin")))


@query("SELECT user_id, " + ", ".join(f"round(avg(value) FILTER (event_type = '{t}'), 6) AS {t}" for t in ("click", "view", "purchase")) + " FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1")
def q_wide_dataset(spark, d):
    kinds = ["click", "view", "purchase"]
    long = read(spark, d, "events").where(F.col("event_type").isin(kinds)).groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    return rounded(generation.wide(long, ["user_id"], "event_type", "v", kinds))


TIER = "CASE WHEN method = 'ensemble' THEN 'moderate' WHEN method = 'single_best' AND NOT forced_degenerate AND n_min >= 200 AND years_min > 1 THEN 'high' ELSE 'low' END"


def tiered(chosen: DataFrame) -> DataFrame:
    return chosen.withColumn("tier", calibration.confidence_tier(F.col("method"), F.col("forced_degenerate"), F.col("n_min"), F.col("years_min")))


@query(f"WITH {CANDIDATES} SELECT query_id, method, {TIER} AS tier FROM choice")
def q_confidence_tier(spark, d):
    return tiered(choices(spark, d)).select("query_id", "method", "tier")


@query(
    f"""WITH {CANDIDATES}, edges(lo, hi) AS (VALUES (0.0::double, 0.3::double), (0.3, 0.4), (0.4, 1.01)),
look AS (SELECT lo, hi, count(*) AS c, avg(similarity) AS a FROM edges JOIN cand ON similarity > lo AND similarity <= hi GROUP BY 1, 2)
SELECT query_id, method, matched, {TIER} AS tier, {TIER} <> 'low' AS calibrated_produced, round(top1, 6) AS similarity_top1, round(CASE WHEN c >= 10 THEN a END, 6) AS expected_error, coalesce(c, 0) AS expected_error_n FROM choice LEFT JOIN look ON top1 > lo AND top1 <= hi"""
)
def q_coverage_report(spark, d):
    found = written(candidates(spark, d), "candidates")
    lookup = retrieval.error_lookup(found, retrieval.bin_table(spark, (0.0, 0.3, 0.4, 1.01)), "similarity", "similarity")
    rows = retrieval.expected_error(tiered(retrieval.retrieval_choice(found, 0.4, 0.3)), lookup, "top1")
    return rounded(rows.select("query_id", "method", "matched", "tier", (F.col("tier") != "low").alias("calibrated_produced"), F.col("top1").alias("similarity_top1"), "expected_error", "expected_error_n"))


# Validation statistics.
@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, NULL::double AS constant_r FROM lineitem GROUP BY 1")
def q_safe_corr(spark, d):
    return rounded(read(spark, d, "lineitem").groupBy("l_returnflag").agg(C.safe_corr("l_quantity", "l_extendedprice").alias("r"), C.safe_corr("l_quantity", F.lit(1.0)).alias("constant_r")))


NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1 :]))
def q_corr_matrix_long(spark, d):
    return rounded(validation.correlation_matrix(read(spark, d, "lineitem"), list(NUMERIC)))


@query(
    """WITH r AS (SELECT l_shipmonth, rank() OVER (PARTITION BY l_shipmonth ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_shipmonth, l_quantity) - 1) / 2.0 AS a, rank() OVER (PARTITION BY l_shipmonth ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_shipmonth, l_extendedprice) - 1) / 2.0 AS b
FROM (SELECT *, year(l_shipdate) * 100 + month(l_shipdate) AS l_shipmonth FROM lineitem)) SELECT l_shipmonth::BIGINT AS l_shipmonth, round(corr(a, b), 6) AS rho FROM r GROUP BY 1 HAVING count(*) >= 3"""
)
def q_spearman(spark, d):
    rows = read(spark, d, "lineitem").withColumn("l_shipmonth", F.year("l_shipdate") * 100 + F.month("l_shipdate"))
    return rounded(validation.spearman(rows, ["l_shipmonth"], "l_quantity", "l_extendedprice").where("rho IS NOT NULL"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 4) AS r2 FROM lineitem GROUP BY 1")
def q_ols_simple(spark, d):
    return rounded(validation.simple_ols(read(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity"), 4)


@query(
    """WITH s AS (SELECT l_returnflag, covar_pop(l_quantity, l_quantity) AS s11, covar_pop(l_discount, l_discount) AS s22, covar_pop(l_quantity, l_discount) AS s12, covar_pop(l_quantity, l_extendedprice) AS s1y, covar_pop(l_discount, l_extendedprice) AS s2y, covar_pop(l_extendedprice, l_extendedprice) AS syy, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my FROM lineitem GROUP BY 1),
b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s)
SELECT l_returnflag, round(my - b1 * m1 - b2 * m2, 3) AS b0, round(b1, 3) AS b1, round(b2, 3) AS b2, round((b1 * s1y + b2 * s2y) / syy, 3) AS r2 FROM b"""
)
def q_ols_two_predictors(spark, d):
    return rounded(validation.two_predictor_ols(read(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", "l_discount"), 3)


@query(
    """SELECT l_returnflag, count(*) AS n, round(avg(d), 6) AS bias, round(avg(abs(d)), 6) AS mae, round(sqrt(avg(d * d)), 6) AS rmse, round(avg((abs(d) <= 0.1)::INT), 6) AS within, round(avg(abs(l_discount * 10 / 1.1 - l_tax * 10)), 6) AS mae_shrunk, round(avg((abs(l_tax * 10) >= 0.3)::INT), 6) AS strong, round(stddev_pop(l_discount * 10), 6) AS sd_generated, round(stddev_pop(l_tax * 10), 6) AS sd_real
FROM (SELECT *, l_discount * 10 - l_tax * 10 AS d FROM lineitem) GROUP BY 1"""
)
def q_error_stats(spark, d):
    rows = read(spark, d, "lineitem").withColumn("g", F.col("l_discount") * 10).withColumn("r", F.col("l_tax") * 10)
    return rounded(validation.error_stats(rows, "g", "r", ["l_returnflag"]))


LINES = "w AS (SELECT o_custkey, avg(l_quantity) FILTER (l_linenumber = 1) AS i1, avg(l_quantity) FILTER (l_linenumber = 2) AS i2, avg(51 - l_quantity) FILTER (l_linenumber = 3) AS i3 FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)"


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per customer: mean quantity of lines 1 to 3, the third reverse scored."""
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem").where("l_linenumber <= 3")
    joined = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).withColumn("x", F.when(F.col("l_linenumber") == 3, 51 - F.col("l_quantity")).otherwise(F.col("l_quantity")))
    long = joined.groupBy("o_custkey", "l_linenumber").agg(F.avg("x").alias("x"))
    w = generation.wide(long, ["o_custkey"], "l_linenumber", "x", [1, 2, 3])
    return w.select("o_custkey", *[F.col(str(i)).alias(f"i{i}") for i in (1, 2, 3)])


@query(f"WITH {LINES} SELECT o_custkey, round(i1, 6) AS i1, round(i2, 6) AS i2, round(i3, 6) AS i3, round((coalesce(i1, 0) + coalesce(i2, 0) + coalesce(i3, 0)) / nullif((i1 IS NOT NULL)::INT + (i2 IS NOT NULL)::INT + (i3 IS NOT NULL)::INT, 0), 6) AS score FROM w WHERE i1 IS NOT NULL OR i2 IS NOT NULL OR i3 IS NOT NULL")
def q_scale_scores(spark, d):
    items = ["i1", "i2", "i3"]
    present = sum((F.col(i).isNotNull().cast("int") for i in items), F.lit(0))
    total = sum((F.coalesce(i, F.lit(0.0)) for i in items), F.lit(0.0))
    return rounded(line_items(spark, d).withColumn("score", C.ratio(total, present)))


@query(f"WITH {LINES} SELECT 'i1' AS a, 'i2' AS b, round(corr(i1, i2), 6) AS r FROM w UNION ALL SELECT 'i1', 'i3', round(corr(i1, i3), 6) FROM w UNION ALL SELECT 'i2', 'i3', round(corr(i2, i3), 6) FROM w")
def q_reverse_score_pairs(spark, d):
    return rounded(validation.correlation_matrix(line_items(spark, d), ["i1", "i2", "i3"]))


@query(
    f"""WITH {LINES}, c AS (SELECT o_custkey % 5 AS grp, * FROM w WHERE i1 IS NOT NULL AND i2 IS NOT NULL AND i3 IS NOT NULL)
SELECT grp, count(*) AS n, round(1.5 * (1 - (var_samp(i1) + var_samp(i2) + var_samp(i3)) / var_samp(i1 + i2 + i3)), 6) AS alpha FROM c GROUP BY 1"""
)
def q_cronbach_alpha(spark, d):
    return rounded(validation.cronbach_alpha(line_items(spark, d).withColumn("grp", F.col("o_custkey") % 5), ["grp"], ["i1", "i2", "i3"]))


@query("SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {p / 1000}), 6) AS p{p}" for p in (25, 50, 500, 975)) + " FROM events GROUP BY 1")
def q_percentiles(spark, d):
    return rounded(ranks.quantiles(read(spark, d, "events"), ["event_type"], "value", {f"p{p}": p / 1000 for p in (25, 50, 500, 975)}))


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_discount - l_tax), 6) AS mean_diff, round(avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))), 5) AS t, (count(*) FILTER (l_discount < l_tax))::BIGINT AS wins FROM lineitem GROUP BY 1")
def q_paired_t(spark, d):
    got = validation.paired_t(read(spark, d, "lineitem"), ["l_returnflag"], "l_discount", "l_tax")
    return rounded(got.withColumn("t", F.round("t", 5)))


@query(
    """WITH c AS (SELECT conv_id, count(*) AS got, max(turn) + 1 AS expected FROM conversations GROUP BY 1)
SELECT expected, count(*) AS n_trials, (count(*) FILTER (got <> expected))::BIGINT AS n_mismatches, round(avg((got <> expected)::INT), 6) AS mismatch_rate, round(avg(got - expected), 6) AS avg_diff FROM c GROUP BY 1"""
)
def q_mismatch_rate(spark, d):
    turns = read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("got"), (F.max("turn") + 1).alias("expected"))
    return rounded(validation.mismatch_rate(turns, ["expected"], "got", "expected"))


BOOT = """it AS (SELECT row_number() OVER (ORDER BY p_brand) - 1 AS no, x FROM (SELECT p_brand, avg(p_retailprice) AS x FROM part GROUP BY 1)), n AS (SELECT count(*) AS n FROM it),
dr AS (SELECT rep, floor({u} * n)::BIGINT AS no FROM it, n, range(200) t(rep))""".format(u=UNIFORM.format(key="0, rep, no"))


@query(f"WITH {BOOT}, s AS (SELECT rep, avg(x) AS s FROM dr JOIN it USING (no) GROUP BY 1) SELECT round((SELECT avg(x) FROM it), 4) AS value, round(quantile_cont(s, 0.025), 4) AS ci_low, round(quantile_cont(s, 0.975), 4) AS ci_high FROM s")
def q_bootstrap_ci(spark, d):
    items = validation.numbered(read(spark, d, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("x")), ["p_brand"])
    return rounded(validation.bootstrap_interval(items, 200, F.avg("x")), 4)


CLUSTER = """it AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS no, sx, c FROM (SELECT c_nationkey AS n_nationkey, sum(c_acctbal) AS sx, count(*) AS c FROM customer GROUP BY 1)), n AS (SELECT count(*) AS n FROM it),
dr AS (SELECT rep, floor({u} * n)::BIGINT AS no FROM it, n, range(200) t(rep))""".format(u=UNIFORM.format(key="0, rep, no"))


@query(f"WITH {CLUSTER}, s AS (SELECT rep, sum(sx) / sum(c) AS s FROM dr JOIN it USING (no) GROUP BY 1) SELECT round((SELECT sum(sx) / sum(c) FROM it), 4) AS value, round(quantile_cont(s, 0.025), 4) AS ci_low, round(quantile_cont(s, 0.975), 4) AS ci_high FROM s")
def q_cluster_bootstrap_ci(spark, d):
    sums = read(spark, d, "customer").groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("sx"), F.count("*").alias("c"))
    return rounded(validation.bootstrap_interval(validation.numbered(sums, ["c_nationkey"]), 200, C.ratio(F.sum("sx"), F.sum("c"))), 4)


def _counts_sql(k: int, n: int) -> str:
    """Steps c0..ck-1: counts of n answers over k shares ``s`` (a list) by successive binomials, inverted at the draws ``u1``..; one row a survey."""
    steps = ["c0 AS (SELECT *, {n} AS left_, 1.0::double AS mass, []::BIGINT[] AS counts FROM surveys)".format(n=n)]
    for j in range(1, k):
        p = f"(CASE WHEN mass > 1e-15 THEN least(s[{j}] / mass, 1.0) ELSE 0.0 END)"
        log = "lgamma(left_ + 1) - lgamma(i + 1) - lgamma(left_ - i + 1) + CASE WHEN i > 0 THEN i * ln(p) ELSE 0 END + CASE WHEN left_ > i THEN (left_ - i) * ln(1 - p) ELSE 0 END"
        steps.append(f"""d{j} AS (SELECT repeat, side, least(count(*) FILTER (total <= u), any_value(left_)) AS c FROM (
            SELECT repeat, side, left_, i, list_extract(us, {j}) AS u, sum(CASE WHEN (i > 0 AND p <= 0) OR (left_ > i AND p >= 1) THEN 0 ELSE exp({log}) END) OVER (PARTITION BY repeat, side ORDER BY i) AS total
            FROM (SELECT *, {p} AS p FROM c{j - 1}), range({n} + 1) t(i) WHERE i <= left_) GROUP BY 1, 2),
        c{j} AS (SELECT c{j - 1}.* EXCLUDE (left_, mass, counts), left_ - c AS left_, mass - s[{j}] AS mass, list_append(counts, c) AS counts FROM c{j - 1} JOIN d{j} USING (repeat, side))""")
    return ", ".join(steps)


@query(
    f"""WITH {TAX_SHARES}, sh AS (SELECT list(share ORDER BY cat) AS s, count(*) AS k FROM shares), pos AS (SELECT unnest(range(k)) AS j, 1 + j * 6.0::double / (k - 1) AS p FROM sh),
surveys AS (SELECT repeat, side, s, list_transform(range(1, 9), lambda i: {UNIFORM.format(key="0, 'tax', repeat, i + CASE side WHEN 'a' THEN 0 ELSE 8 END")}) AS us FROM sh, range(20) r(repeat), (VALUES ('a'), ('b')) v(side)), {_counts_sql(9, 100)},
l AS (SELECT repeat, side, p, list_extract(list_append(counts, left_), j + 1) / 100.0::double AS x FROM c8, pos),
m AS (SELECT repeat, side, sum(x * p) AS mean FROM l GROUP BY 1, 2),
v AS (SELECT repeat, side, any_value(mean) AS mean, sqrt(sum(x * (p - mean) ** 2)) AS sd, sum(x * (p - mean) ** 3) AS m3, sum(x * (p - mean) ** 4) AS m4, sum(x) FILTER (p <= 2 + 1e-9) AS low, sum(x) FILTER (p >= 6 - 1e-9) AS high,
    [sum(x) FILTER (p <= 1 + 1e-9), sum(x) FILTER (p <= 2 + 1e-9), sum(x) FILTER (p <= 3 + 1e-9), sum(x) FILTER (p <= 4 + 1e-9), sum(x) FILTER (p <= 5 + 1e-9), sum(x) FILTER (p <= 6 + 1e-9), sum(x)] AS cdf FROM l JOIN m USING (repeat, side) GROUP BY 1, 2),
w AS (SELECT *, m3 / sd ** 3 AS sk, m4 / sd ** 4 - 3 AS ku FROM v),
g AS (SELECT a.mean - b.mean AS d1, a.sd - b.sd AS d2, a.sk - b.sk AS d3, a.ku - b.ku AS d4, a.low - b.low AS d5, a.high - b.high AS d6, [abs(a.cdf[i] - b.cdf[i]) for i in range(1, 8)] AS ds FROM w a JOIN w b USING (repeat) WHERE a.side = 'a' AND b.side = 'b')
SELECT 'tax' AS v, round(avg(abs(d1)), 6) AS mean, round(avg(abs(d2)), 6) AS sd, round(avg(abs(d3)), 6) AS skewness, round(avg(abs(d4)), 6) AS kurtosis, round(avg(abs(d5)), 6) AS low, round(avg(abs(d6)), 6) AS high,
    round(avg(list_avg(ds)), 6) AS cdf, round(avg(list_max(ds)), 6) AS ks FROM g"""
)
def q_noise_floor(spark, d):
    items = read(spark, d, "lineitem").withColumn("v", F.lit("tax"))
    arrays = distributions.share_arrays(profile.weighted_shares(items, ["v"], "l_tax", "l_quantity"), ["v"])
    return rounded(resampling.noise_floor(arrays, ["v"], 100, 20))


@query(
    f"""WITH p AS (SELECT s AS size, r AS repeat, row_number() OVER (ORDER BY s, r) - 1 AS stream FROM (VALUES (20), (50)) a(s), range(10) b(r)),
o AS (SELECT size, value, repeat, row_number() OVER (PARTITION BY size, repeat ORDER BY n53, s_suppkey) AS n FROM {numbers_sql("(SELECT s_suppkey, s_acctbal AS value, p.* FROM supplier, p)", "0, s_suppkey", "stream")}),
m AS (SELECT size, repeat, avg(value) AS m FROM o WHERE n <= size GROUP BY 1, 2) SELECT size::BIGINT AS size, round(avg(abs(m - (SELECT avg(s_acctbal) FROM supplier))), 4) AS mean_noise FROM m GROUP BY 1"""
)
def q_subsample_noise(spark, d):
    return rounded(resampling.subsample_noise(read(spark, d, "supplier"), "s_suppkey", "s_acctbal", [20, 50], 10), 4)


@query(
    f"""WITH x AS (SELECT l_orderkey * 8 + l_linenumber AS key, l_tax AS cat FROM lineitem), p AS (SELECT s AS size, r AS repeat, row_number() OVER (ORDER BY s, r) - 1 AS stream FROM (VALUES (200), (800)) a(s), range(4) b(r)),
o AS (SELECT size, repeat, cat, row_number() OVER (PARTITION BY size, repeat ORDER BY n53, key, cat) AS n FROM {numbers_sql("(SELECT x.*, p.* FROM x, p)", "5, key", "stream")}),
c AS (SELECT size, repeat, cat, count(*) AS w FROM o WHERE n <= size GROUP BY ALL UNION ALL SELECT 0, 0, cat, count(*) FROM x GROUP BY cat),
cu AS (SELECT size, repeat, row_number() OVER q - 1 AS j, count(*) OVER (PARTITION BY size, repeat) AS k, sum(w) OVER (q ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY size, repeat)::double AS cum FROM c WINDOW q AS (PARTITION BY size, repeat ORDER BY cat)),
g AS (SELECT size, repeat, k, i, least(i * (k - 1) // 19, k - 2) AS j FROM (SELECT DISTINCT size, repeat, k FROM cu), range(20) t(i)),
y AS (SELECT g.size, g.repeat, g.i, a.cum + (g.i * (g.k - 1) - g.j * 19) / 19.0::double * (b.cum - a.cum) AS y FROM g JOIN cu a ON a.size = g.size AND a.repeat = g.repeat AND a.j = g.j JOIN cu b ON b.size = g.size AND b.repeat = g.repeat AND b.j = g.j + 1)
SELECT y.size::BIGINT AS size, round(avg(abs(y.y - z.y)), 6) AS mean_noise FROM y JOIN y z ON z.size = 0 AND z.i = y.i WHERE y.size > 0 GROUP BY 1"""
)
def q_subsample_curve_noise(spark, d):
    rows = read(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("key"), "l_tax")
    return rounded(resampling.subsample_curve_noise(rows, "key", "l_tax", [200, 800, 10**9], 4, seed=5))


def _poisson_sql(source: str, key: str, sums: dict[str, str], repeats: int, seed: int, stat: str) -> str:
    times = " + ".join(f"(n53 >= {x})::INT" for x in draws.poisson_limits())
    terms = ", ".join(f"sum(({times}) * {c}) AS {n}" for n, c in sums.items())
    whole = ", ".join(f"sum({c}) AS {n}" for n, c in sums.items())
    return f"""WITH r AS (SELECT repeat, {terms} FROM {numbers_sql(f"(SELECT *, t.repeat FROM {source}, range({repeats}) t(repeat))", f"{seed}, {key}", "repeat")} GROUP BY repeat), s AS (SELECT {stat} AS s FROM r)
SELECT round((SELECT {stat} FROM (SELECT {whole} FROM {source})), 4) AS value, round(quantile_cont(s, 0.025), 4) AS ci_low, round(quantile_cont(s, 0.975), 4) AS ci_high FROM s"""


@query(_poisson_sql("orders", "o_orderkey", {"sx": "o_totalprice", "n": "1"}, 60, 3, "sx / n"))
def q_poisson_bootstrap(spark, d):
    sums = {"sx": F.col("o_totalprice"), "n": F.lit(1)}
    return rounded(resampling.poisson_interval(read(spark, d, "orders"), "o_orderkey", sums, C.ratio("sx", "n"), 60, seed=3), 4)


@query(_poisson_sql("orders", "o_custkey", {"sx": "o_totalprice", "n": "1"}, 60, 4, "sx / n"))
def q_poisson_cluster_bootstrap(spark, d):
    sums = {"sx": F.col("o_totalprice"), "n": F.lit(1)}
    return rounded(resampling.poisson_interval(read(spark, d, "orders"), "o_custkey", sums, C.ratio("sx", "n"), 60, seed=4), 4)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_discount), 4) AS mean FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def q_grouping_sets_report(spark, d):
    lines = read(spark, d, "lineitem")
    sets = lines.groupingSets([[lines.l_returnflag], [lines.l_linestatus], []], lines.l_returnflag, lines.l_linestatus)
    return rounded(sets.agg(F.count("*").alias("n"), F.avg("l_discount").alias("mean")), 4)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def q_resume_antijoin(spark, d):
    done = read(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return files.unfinished(read(spark, d, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("SELECT c_mktsegment AS name, count(*) AS n, NULL::double AS balance FROM customer GROUP BY 1 UNION ALL SELECT 'suppliers', NULL, round(avg(s_acctbal), 6) FROM supplier")
def q_union_missing_cols(spark, d):
    a = read(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.count("*").alias("n"))
    b = read(spark, d, "supplier").agg(F.avg("s_acctbal").alias("balance")).withColumn("name", F.lit("suppliers"))
    return rounded(a.unionByName(b, allowMissingColumns=True).select("name", "n", "balance"))


def _slots(prefix: str = "", by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"""sl AS (SELECT *, sum(c_acctbal::DECIMAL(28,6)) OVER ({part}ORDER BY seg, c_custkey ROWS UNBOUNDED PRECEDING) AS hi, sum(c_acctbal::DECIMAL(28,6)) OVER ({f'PARTITION BY {by}' if by else ''}) AS total FROM (SELECT *, 0 AS seg FROM customer WHERE c_acctbal > 0))"""


DRAWS = f"dw AS (SELECT i AS draw_no, {UNIFORM.format(key="0, i")} AS u FROM range(1000) t(i))"


@query(f"WITH {_slots()}, {DRAWS} SELECT draw_no, c_custkey FROM dw JOIN sl ON u >= (hi - c_acctbal::DECIMAL(28,6))::double / total::double AND u < hi::double / total::double")
def q_weighted_draw(spark, d):
    slots = sampling.weight_slots(read(spark, d, "customer"), "c_acctbal", "c_custkey")
    return sampling.draw(slots, sampling.uniform_draws(spark, 1000)).select("draw_no", "c_custkey")


@query(f"WITH {_slots(by='c_mktsegment')}, {DRAWS} SELECT draw_no, c_mktsegment, c_custkey FROM dw JOIN sl ON draw_no < 200 AND u >= (hi - c_acctbal::DECIMAL(28,6))::double / total::double AND u < hi::double / total::double")
def q_stratified_draw(spark, d):
    people = read(spark, d, "customer")
    slots = sampling.weight_slots(people, "c_acctbal", "c_custkey", ["c_mktsegment"])
    draws = people.select("c_mktsegment").distinct().crossJoin(F.broadcast(sampling.uniform_draws(spark, 200)))
    return sampling.draw(slots, draws, ["c_mktsegment"]).select("draw_no", "c_mktsegment", "c_custkey")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["q_calibrate_slice"](spark, sf_dir)
