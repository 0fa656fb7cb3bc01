"""Catalogs and weighted profiles of survey variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tallyweave.functions.columns import ratio
from tallyweave.operators import states


def resolve_columns(df: DataFrame, wanted: list[str]) -> tuple[list[str], list[str]]:
    """Wanted names found in the table (any case) as it spells them, and those missing."""
    have = {c.lower(): c for c in df.columns}
    return [have[w.lower()] for w in wanted if w.lower() in have], [w for w in wanted if w.lower() not in have]


def filter_catalog(df: DataFrame, name: str, label: str, admin_pattern: str) -> DataFrame:
    """Rows with a label whose lower-case name matches no administrative pattern."""
    return df.where((F.trim(label) != "") & ~F.lower(F.trim(name)).rlike(admin_pattern))


def valid_weights(df: DataFrame, value: str, weight: str) -> DataFrame:
    return df.where(F.col(value).isNotNull() & (F.col(weight) > 0))


def weighted_stats(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """n, weighted mean and population SD, min and max (doubles) by group, in one pass: tasks give a state a group."""
    got = states.moment_states(df, by, value, weight)
    return got.select(*by, F.col("n_").alias("n"), F.col("mean_").alias("mean"), states.standard_deviation().alias("std"), F.col("least_").alias("min"), F.col("largest_").alias("max"))


def weighted_shares(df: DataFrame, by: list[str], category: str, weight: str) -> DataFrame:
    """(by, cat, weight, share): each category's share of its variable's weight."""
    sums = valid_weights(df, category, weight).groupBy(*by, F.col(category).alias("cat")).agg(F.sum(weight).alias("weight"))
    return sums.withColumn("share", ratio("weight", F.sum("weight").over(Window.partitionBy(*by))))


def top_with_other(shares: DataFrame, by: list[str], k: int = 20) -> DataFrame:
    """(by, cat string, share, n_categories_total, truncated): the k largest categories, ties to the smaller, and ``__other__``."""
    order = Window.partitionBy(*by).orderBy(F.desc("weight"), "cat")
    ranked = shares.withColumn("rank", F.row_number().over(order)).withColumn("n_categories_total", F.count("*").over(Window.partitionBy(*by)))
    named = F.when(F.col("rank") <= k, F.col("cat").cast("string")).otherwise("__other__")
    out = ranked.groupBy(*by, named.alias("cat")).agg(F.sum("share").alias("share"), F.first("n_categories_total").alias("n_categories_total"))
    return out.withColumn("truncated", F.col("n_categories_total") > k)


def unpivoted(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """Long form (ids, variable, value double)."""
    typed = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return typed.unpivot(ids, columns, "variable", "value")


def profile_variables(df: DataFrame, wanted: list[str], weight: str, year: Column) -> DataFrame:
    """(variable, n, n_years, first_year, last_year, mean, std, min, max, error): a row per wanted variable, missing and empty ones with an error.

    One pass over the wide rows: a task gives a state for each variable and
    year, however many rows it read, so thousands of columns cost no more
    shuffled rows than variables times years times tasks.
    """
    found, _ = resolve_columns(df, wanted)
    found = list(dict.fromkeys(found))
    rows = df.select(F.col(weight).alias("weight_"), year.cast("bigint").alias("year_"), *found)
    parts = states.wide_states(rows, found, "weight_", "year_")
    w, m = F.col("weight_"), F.col("mean_")
    stats = parts.groupBy("variable").agg(
        F.sum("n_").alias("n"), F.array_sort(F.collect_set("year_")).alias("years"), ratio(F.sum(m * w), F.sum(w)).alias("mean"),
        F.sum("weight_").alias("all_"), F.collect_list(F.struct("weight_", "mean_", "centred_")).alias("states_"), F.min("least_").alias("min"), F.max("largest_").alias("max"),
    )
    # One state a year: the deviations from the common mean are added to those within the years.
    centred = F.aggregate("states_", F.lit(0.0), lambda acc, x: acc + x["centred_"] + x["weight_"] * (x["mean_"] - F.col("mean")) * (x["mean_"] - F.col("mean")))
    stats = stats.withColumn("std", F.sqrt(ratio(centred, "all_")))
    listed = df.sparkSession.createDataFrame([(w, w.lower() in {f.lower() for f in found}) for w in wanted], "variable string, present boolean")
    joined = listed.join(stats.withColumn("key", F.lower("variable")).drop("variable"), F.lower("variable") == F.col("key"), "left")
    error = F.when(~F.col("present"), "not found").when(F.col("n").isNull(), "no valid rows")
    return joined.select(
        "variable", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.size(F.coalesce("years", F.array().cast("array<bigint>"))).cast("bigint").alias("n_years"),
        F.try_element_at("years", F.lit(1)).alias("first_year"), F.try_element_at("years", F.lit(-1)).alias("last_year"), "mean", "std", "min", "max", error.alias("error"),
    )


def profile_shares(df: DataFrame, wanted: list[str], weight: str, k: int = 20) -> DataFrame:
    """(variable, cat, share, n_categories_total, truncated): the ``k`` largest categories of each wanted variable that is there, and the others', in one pass over the wide rows."""
    found, _ = resolve_columns(df, wanted)
    return top_with_other(states.wide_shares(df, list(dict.fromkeys(found)), weight), ["variable"], k)


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns of a numeric type, decimals included: those with a mean and an SD."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def presence(df: DataFrame, wanted: list[str]) -> DataFrame:
    """(wanted, found, found_any_case, column, n): whether the table has a column as it is spelled and in any case, and the values it holds.

    One pass counts the values of all columns that are found.
    """
    have = {c.lower(): c for c in df.columns}
    there = list(dict.fromkeys(have[w.lower()] for w in wanted if w.lower() in have))
    spark = df.sparkSession
    listed = spark.createDataFrame([(w, w in df.columns, w.lower() in have, have.get(w.lower())) for w in wanted], "wanted string, found boolean, found_any_case boolean, column string")
    if not there:
        return listed.withColumn("n", F.lit(None).cast("bigint"))
    counts = df.agg(*[F.count(f"`{c}`").alias(f"n{i}_") for i, c in enumerate(there)])
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_"), F.col(f"n{i}_").alias("n")) for i, c in enumerate(there)])).alias("x")).select("x.*")
    return listed.join(F.broadcast(long), F.col("column") == F.col("column_"), "left").drop("column_")


def catalog_with_stats(catalog: DataFrame, stats: DataFrame, name: str) -> DataFrame:
    """Catalog rows, in any case of ``name``, with their statistics and ``error``: ``no statistics`` where there are none.

    ``stats`` has one row a name; both sides may be large, so neither is assumed to be small.
    """
    keyed = stats.withColumn("key_", F.lower(F.trim(name))).drop(name).withColumn("has_", F.lit(True))
    joined = catalog.withColumn("of_", F.lower(F.trim(name))).join(keyed, F.col("of_") == F.col("key_"), "left")
    return joined.withColumn("error", F.when(F.col("has_").isNull(), "no statistics")).drop("of_", "key_", "has_")


def marked_members(df: DataFrame, column: str, members: DataFrame, member: str, out: str) -> DataFrame:
    """Rows with ``out``: whether ``column`` is among the members; null is not."""
    known = members.select(F.col(member).alias("member_")).where("member_ IS NOT NULL").distinct()
    return df.join(known, F.col(column) == F.col("member_"), "left").withColumn(out, F.col("member_").isNotNull()).drop("member_")
