"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import ann, bpe, collocations, divergence, langid, license_scan, mixing, near_dedup, quality, quality_model, sharding, suffix_dedup, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licence_finds(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, table(spark, sf_dir, "pages"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), public_file("word_bpe_49k.json"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.feistel_shards(table(spark, sf_dir, "documents"))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_languages(docs.where(~held_out()).select("text", "lang"), public_file("piece_bpe_32k.model"))
    out = langid.with_language(docs.select("doc_id", "text"), model)
    return out.select("row.doc_id", "lang_pred", "score").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_model.fit_quality(docs.where(~held_out()), labels)
    out = quality_model.with_quality(docs.select("doc_id", "text"), model)
    return out.select("row.doc_id", "score", "predicted").select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_near_dedup,
        op3_license_scan,
        op4_source_mix,
        op5_warc,
        op6_bpe,
        op7_quality_rules,
        op8_sharding,
        op9_language_id,
        op10_nearest,
        op11_quality_classifier,
        op12_collocations,
        op13_source_divergence,
    )
}
WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS response FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 100 AND response IS NOT NULL AND page_id IS DISTINCT FROM response THEN response END AS refers_to FROM g)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM r
"""
_WORD = r"[^\x20\x09-\x0D]"
#: Rows are numbered, so that repeated doc_ids are documents of their own.
QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
m AS (
    SELECT k, doc_id, host, regexp_extract_all(text, '{_WORD}+') AS w,
        CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
    FROM d),
spread AS (SELECT k, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM m),
trios AS (SELECT k, i, word AS a, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM spread WINDOW o AS (PARTITION BY k ORDER BY i)),
again AS (SELECT k, i FROM trios WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY k, a, b, c) > 1),
repeated AS (SELECT k, count(DISTINCT i + j) AS n FROM again, (SELECT unnest([0, 1, 2]) AS j) GROUP BY k),
measured AS (
    SELECT m.k, doc_id, host, CAST(len(w) AS BIGINT) AS n_words, word_chars, n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words
    FROM m LEFT JOIN repeated ON m.k = repeated.k),
rules AS (
    SELECT host, unnest([
        {{'rule': 'short', 'f': n_words < 50}}, {{'rule': 'repeats', 'f': 100 * n_repeat_words > 50 * n_words}}, {{'rule': 'symbols', 'f': 10 * n_symbols > n_words}},
        {{'rule': 'word_length', 'f': n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 10 * n_words)}}, {{'rule': 'lines', 'f': 10 * n_dup_lines > 3 * n_lines}}
    ], recursive := true) FROM measured),
hosts AS (SELECT host, rule, CAST(count(*) AS DOUBLE) AS docs, CAST(sum(CAST(f AS INT)) AS DOUBLE) AS x FROM rules GROUP BY host, rule),
totals AS (SELECT rule, CAST(count(*) AS DOUBLE) AS n, sum(docs) AS k, sum(x) AS x, sum(x * x / docs) AS s FROM hosts GROUP BY rule),
one AS (
    SELECT host, h.rule, docs, h.x, n, k, t.x AS tx, s, t.x / k AS mean, greatest(s / k - (t.x / k) * (t.x / k), 0.0) - (t.x / k) * (1 - t.x / k) * n / k AS beyond,
        CASE WHEN n > 1 THEN k - docs END AS rest, CASE WHEN n > 1 THEN (t.x - h.x) / (k - docs) END AS usual
    FROM hosts h JOIN totals t ON h.rule = t.rule),
two AS (
    SELECT *, least(greatest(CASE WHEN beyond > 0 THEN mean * (1 - mean) / beyond - 1 ELSE k END, 1.0), greatest(k, 1.0)) AS strength,
        greatest((s - x * x / docs) / rest - usual * usual, 0.0) - usual * (1 - usual) * (n - 1) / rest AS others
    FROM one),
three AS (
    SELECT *, (x + strength * mean) / (docs + strength) AS rate,
        least(greatest(CASE WHEN others > 0 THEN usual * (1 - usual) / others - 1 ELSE rest END, 1.0), greatest(rest, 1.0)) AS strength_of_others
    FROM two),
failed AS (
    SELECT host, bool_or(rate > 0.5 OR coalesce(
        rate - 2 * sqrt(rate * (1 - rate) / (docs + strength + 1)) > usual + greatest(0.1, 3 * sqrt(usual * (1 - usual) / (strength_of_others + 1))), false)) AS host_failed
    FROM three GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT host_failed AS kept
FROM measured m JOIN failed f ON m.host IS NOT DISTINCT FROM f.host
"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PHRASE_SQL = rf"""
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT row_number() OVER () AS k, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
s AS (SELECT k, lang, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
t AS (SELECT lang, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM s WINDOW o AS (PARTITION BY k ORDER BY i)),
one AS (SELECT lang, x, count(*) AS f FROM t GROUP BY lang, x),
two AS (SELECT lang, x, y, count(*) AS f FROM t WHERE y IS NOT NULL GROUP BY lang, x, y),
three AS (SELECT lang, x, y, z, count(*) AS f FROM t WHERE z IS NOT NULL GROUP BY lang, x, y, z HAVING count(*) >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang),
cuts AS (
    SELECT c.lang, concat_ws(' ', c.x, c.y) AS phrase, c.f AS a, l.f AS l, r.f AS r, 1 AS cut
    FROM two c JOIN one l ON l.lang = c.lang AND l.x = c.x JOIN one r ON r.lang = c.lang AND r.x = c.y
    WHERE c.f >= 10 AND NOT EXISTS (FROM three d WHERE d.lang = c.lang AND d.x = c.x AND d.y = c.y AND 100 * d.f >= 50 * c.f)
        AND NOT EXISTS (FROM three d WHERE d.lang = c.lang AND d.y = c.x AND d.z = c.y AND 100 * d.f >= 50 * c.f)
    UNION ALL
    SELECT c.lang, concat_ws(' ', c.x, c.y, c.z), c.f, l.f, r.f, 1
    FROM three c JOIN one l ON l.lang = c.lang AND l.x = c.x JOIN two r ON r.lang = c.lang AND r.x = c.y AND r.y = c.z
    UNION ALL
    SELECT c.lang, concat_ws(' ', c.x, c.y, c.z), c.f, l.f, r.f, 2
    FROM three c JOIN two l ON l.lang = c.lang AND l.x = c.x AND l.y = c.y JOIN one r ON r.lang = c.lang AND r.x = c.z),
scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
DIVERGENCE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept ON w.lang = kept.lang AND w.term = kept.term GROUP BY w.lang, w.source, w.term),
gn AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (
    SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(gn.total, 0) + 2 * v.v))::HUGEINT AS p
    FROM g JOIN kept ON kept.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
ln AS (SELECT lang, sum(total) AS total FROM gn GROUP BY lang),
lt AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
q AS (SELECT lt.lang, lt.term, (1 + (1000000000::HUGEINT * (lt.n + 2)) // (ln.total + 2 * v.v))::HUGEINT AS q FROM lt JOIN ln ON ln.lang = lt.lang JOIN v ON v.lang = lt.lang),
apart AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pair AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(apart.value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source),
terms AS (
    SELECT p.lang, p.source, p.term AS item, (((p.p - q.q) * (p.p - q.q)) // (p.p + q.q))::BIGINT AS value
    FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pair
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms) WHERE rank <= 10
"""
ORACLE_SQL: dict[str, str] = {"op5_warc": WARC_SQL, "op7_quality_rules": QUALITY_SQL, "op12_collocations": PHRASE_SQL, "op13_source_divergence": DIVERGENCE_SQL}
