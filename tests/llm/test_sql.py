"""Queries that SQL can state, held against DuckDB on the same tables and on tables made to provoke them."""

import os
import random

import pytest
from compare import data, differences, duck
from pyspark.sql import functions as F

from tallyweave.llm import quality, queries, warc


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, data()), duck(data()), queries.ORACLE_SQL[name]) == ""


def test_hosts_equal_sql(spark, tmp_path):
    """Hosts that fail, hosts that stand out, single hosts and null ones: every verdict as SQL gives it."""
    rnd = random.Random(3)
    word = lambda least, most: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(least, most)))
    plain = lambda n: [word(3, 7) for _ in range(n)]
    rows = [(i, " ".join(plain(rnd.choice([20, 60, 80]))), f"h{i % 6}") for i in range(240)]
    rows += [(1000 + i, " ".join(plain(60) + ["#*$ " + w for w in plain(20)]), "junk") for i in range(50)]
    rows += [(2000 + i, "again and again " * 30 if i % 2 else " ".join(plain(70)), None) for i in range(60)]
    rows += [(None, None, "h1"), (5, "\n".join(["a line", "a line", " ", ""] * 30), "h2"), (5, "", "h3"), (7, "一 二 三 " * 40 + "\x1c\x85 x", "h4")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    path = str(tmp_path / "documents.parquet")
    docs.write.parquet(path)
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    got = quality.quality_rules(spark.read.parquet(path))
    assert differences(got, con, queries.QUALITY_SQL) == ""
    assert not any(r.kept for r in got.where("doc_id BETWEEN 1000 AND 1049").collect())


def test_archives_equal_sql(spark, tmp_path):
    """Payloads of over 100 chunks, urls beyond a megabyte, hot copies, repeated rows and null ids."""
    rows = [(i, f"http://x/{i}", "hot payload " * 20) for i in range(10, 400)]
    rows += [(1, "u" * 1_500_000, "ü" * 200_000), (2, "a b\tc", "ü" * 200_000), (3, None, "WARC/1.1\r\n\r\n" * 9), (4, "u", None), (5, "u", ""), (6, "u", "x" * 99), (7, "u", "x" * 99), (8, "u", "x" * 100), (9, "u", "x" * 100)]
    rows += [(None, "u", "no id " * 50), (None, "v", "no id " * 50), (10, "again", "hot payload " * 20), (None, "w", "hot payload " * 20)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    path = str(tmp_path / "pages.parquet")
    pages.write.parquet(path)
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/*.parquet'")
    folder = f"file://{tmp_path}/archives"
    pages = spark.read.parquet(path)
    assert differences(warc.archive_round_trip(spark, pages, folder, chunk_bytes=1000), con, queries.WARC_SQL) == ""
    assert not [x for x in os.listdir(tmp_path / "archives") if x.startswith("segments")]
    manifest = warc.write_archives(pages, f"file://{tmp_path}/again", chunk_bytes=1000)
    chunks = warc.read_chunks(manifest, 1000).where("page_id = 1").orderBy("chunk_no").collect()
    assert len(chunks) == 400 and chunks[0].target_uri == "u" * 1_500_000 and chunks[1].running_sha256 != chunks[2].running_sha256
    import gzip

    members = 0
    for r in manifest.collect():
        raw = gzip.open(r.path.removeprefix("file://")).read()
        members += raw.count(b"WARC/1.1\r\nWARC-Type")
    assert members == manifest.agg(F.sum("records")).first()[0] == len(rows)
    assert warc.archive_round_trip(spark, pages.limit(0)).count() == 0
