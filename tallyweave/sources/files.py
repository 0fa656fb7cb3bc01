"""Readers and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and declared types."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_first(spark: SparkSession, options: list[tuple[str, dict[str, str]]]) -> DataFrame | None:
    """The first readable Parquet path, with its columns renamed; none if none is there."""
    for path, names in options:
        try:
            df = spark.read.parquet(path)
        except Exception as e:  # the reader tells a missing path apart by its error class
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        return df.withColumnsRenamed(names)
    return None


def read_square_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A square CSV with row labels as (a, b, r), labels in lower case."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    label, *columns = df.columns
    long = df.unpivot([label], columns, "b", "r")
    return long.select(F.lower(label).alias("a"), F.lower("b").alias("b"), F.col("r").cast("double").alias("r"))


def read_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A JSON object as (key, value) rows; ``value`` is the values' type."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def unfinished(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned rows whose keys are not among the finished ones."""
    return planned.join(done.select(*keys).distinct(), keys, "left_anti")


def append_unfinished(planned: DataFrame, path: str, keys: list[str]) -> None:
    """Append the planned rows that the table at ``path`` lacks; running it again adds nothing."""
    done = read_first(planned.sparkSession, [(path, {})])
    (planned if done is None else unfinished(planned, done, keys)).write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def paired_files(spark: SparkSession, folder: str, answers: str = "resp", report: str = "cov") -> DataFrame:
    """(partition, batch, answers, report): paths of the CSV files ``<name>_p<partition>_b<batch>.csv`` of which both are there.

    Only names are listed, no file is read.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path")
    name, partition, batch = (F.regexp_extract("path", r"([^/]+)_p(\d+)_b(\d+)\.csv$", i) for i in (1, 2, 3))
    found = listed.where(name.isin(answers, report)).select("path", name.alias("name"), partition.cast("int").alias("partition"), batch.cast("int").alias("batch"))
    side = lambda name: found.where(F.col("name") == name).select("partition", "batch", F.col("path").alias(name))
    return side(answers).join(side(report), ["partition", "batch"]).select("partition", "batch", F.col(answers).alias("answers"), F.col(report).alias("report"))


def read_answers(spark: SparkSession, paths: list[tuple[int, int, str]]) -> DataFrame:
    """(partition, batch, respondent, item, value) of wide CSV files, one column an item.

    Respondents are known by their first column, so the order of lines doesn't
    count.  Files have columns of their own, so each is a scan of its own: for
    the batches of one design.
    """
    parts = []
    for partition, batch, path in paths:
        df = spark.read.option("header", True).csv(path)
        key, *items = df.columns
        long = df.select(F.col(key).alias("respondent"), *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in items]).unpivot(["respondent"], items, "item", "value")
        parts.append(long.select(F.lit(partition).alias("partition"), F.lit(batch).alias("batch"), "respondent", "item", "value"))
    if not parts:
        return spark.createDataFrame([], "partition int, batch int, respondent string, item string, value double")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_map(df: DataFrame, path: str, key: str, value: str) -> None:
    """(key, value) rows as one JSON object, in key order; null keys are left out.

    The object is made in one task: for tables of items, not of respondents.
    """
    pairs = F.array_sort(F.collect_list(F.when(F.col(key).isNotNull(), F.struct(F.col(key).cast("string").alias("key"), F.col(value).alias("value")))))
    df.agg(F.to_json(F.map_from_entries(pairs)).alias("value")).write.mode("overwrite").text(path)


def rounded_numbers(df: DataFrame, places: int = 3) -> DataFrame:
    """Doubles rounded, halves to even; other columns as they are."""
    return df.select([F.bround(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
