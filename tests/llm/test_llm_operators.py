import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyweave.llm import bpe, langid, license_scan, mixing, near_dedup, quality, queries, sharding, suffix_dedup, warc
from tallyweave.llm.shared import connected_components

WORD = r"[^\x20\x09-\x0D]+"
BPE_FILE = queries.public_file("word_bpe_49k.json")
VOCABULARY = queries.public_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def corpus(spark):
    """Random texts with planted exact copies, near copies and shared passages."""
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(4000)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    texts = [text(rnd.randint(5, 300)) for _ in range(60)]
    texts += [texts[i] for i in (3, 3, 10)]
    for i in (5, 6, 7):
        own = texts[i].split()
        own[len(own) // 2] = "changed"
        texts.append(" ".join(own))
    passage = text(55)
    texts += [f"{text(20)} {passage} {text(30)}" for _ in range(4)]
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_bpe_equals_library(spark, edge):
    library = Tokenizer.from_file(BPE_FILE)
    for r in edge.join(bpe.bpe_digests(edge, BPE_FILE), "doc_id").dropDuplicates(["doc_id"]).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_bpe_words_equal_library():
    library, rnd = Tokenizer.from_file(BPE_FILE), random.Random(1)
    encoder = bpe.TrieEncoder(bpe.tokenizer_definition(BPE_FILE), cache_words=500)
    texts = ["".join(rnd.choice("abcdeinthgr .,'<|>ΣσİßéÉ́ \x1c\n12٣漢😀ﬁK") for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rnd.choice("aehinorst") for _ in range(rnd.randint(1, 14))) for _ in range(3000)]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encoder.encode(t) == e.ids
        assert encoder.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False)


def test_near_duplicates_equal_brute_force(corpus):
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(corpus).collect()}
    sets = {}
    for r in corpus.collect():
        w = r.text.lower().split()
        sets[r.doc_id] = collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        least = sum(min(x[g], y[g]) for g in x if g in y)
        if least >= 0.8 * (x.total() + y.total() - least):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {d: root(d) for d in sets}
    assert len(set(got.values())) < len(got)


def test_one_row_of_each_class_stays(spark):
    """Repeated rows, null ids and near texts under one id leave one row a class."""
    rnd = random.Random(12)
    text = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(120))
    same, nulls, near, apart = text(), text(), text(), text()
    rows = [(7, same)] * 3 + [(8, same), (None, same)] + [(None, nulls)] * 3 + [(9, near), (9, near + " changed"), (9, near + " changed"), (10, apart), (None, None), (None, None), (11, "")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, tag int").repartition(3)
    alone = [(10, apart), (None, None), (None, None), (11, "")]
    rank = lambda r: (str(r[0]), str(r[1]))
    kept = sorted([(r.doc_id, r.text) for r in near_dedup.keep_one_of_each(docs).collect()], key=rank)
    one_near = [r for r in kept if r[0] == 9]
    assert len(one_near) == 1 and one_near[0] in rows
    assert kept == sorted([(7, same), (None, nulls), *one_near, *alone], key=rank)
    cut = collections.Counter((r.doc_id, (r.text or "")[:600]) for r in suffix_dedup.without_repeats(docs, chars_col=None).collect())
    assert cut[(7, same[:600])] == 1 and cut[(None, nulls[:600])] == 1 and (8, same) not in cut and (None, same) not in cut


def test_repeats_equal_brute_force(corpus):
    got, cut = collections.defaultdict(set), collections.defaultdict(set)
    for r in suffix_dedup.repeated_spans(corpus).collect():
        got[r.doc_id].update(range(r.start_word, r.end_word))
        if r.role == "repeat":
            cut[r.doc_id].update(range(r.start_word, r.end_word))
    rows = sorted((r.doc_id, r.text.split()) for r in corpus.collect())
    times = collections.Counter(tuple(w[i : i + 50]) for _, w in rows for i in range(len(w) - 49))
    want, later, seen = collections.defaultdict(set), collections.defaultdict(set), set()
    for d, w in rows:
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            if times[key] > 1:
                want[d].update(range(i, i + 50))
                if key in seen:
                    later[d].update(range(i, i + 50))
                seen.add(key)
    assert got == want and cut == later and want
    kept = {r.doc_id: r for r in suffix_dedup.without_repeats(corpus).collect()}
    for d, w in rows:
        rest = [x for i, x in enumerate(w) if i not in later[d]]
        assert (kept[d].text.split() == rest and kept[d].n_chars == len(kept[d].text)) if rest else d not in kept


def test_mix_meets_targets(corpus):
    rows = mixing.mix_sources(corpus).collect()
    again = mixing.mix_sources(corpus).collect()
    assert sorted(rows) == sorted(again) and len(rows) == corpus.count()
    total = sum(r.size for r in rows)
    for (size, target), own in itertools.groupby(sorted(rows, key=lambda r: (r.source_size, r.target)), key=lambda r: (r.source_size, r.target)):
        own = list(own)
        assert sum(r.size for r in own) == size and target <= 3 * size + 1e-6
        assert abs(sum(r.taken for r in own) - target) < 0.05 * target
    assert abs(sum({(r.source_size, r.target) for r in rows} and [t for _, t in {(r.source_size, r.target) for r in rows}]) - total) < 1e-6
    assert all(r.taken <= 3 * r.size for r in rows)


def test_mixed_rows_have_draws_of_their_own(spark):
    """Repeated rows of a source are taken like any others: neither all of them nor none."""
    rows = [(1, "the same words again and again", "a", 0)] * 300 + [(1, "the same words again and again", "b", 0)] * 100 + [(None, "no id " + "x " * (i % 5), "c", i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, tag int")
    got = collections.Counter(r.source for r in mixing.mixed_documents(docs.repartition(3)).collect())
    want = collections.Counter()
    for r in mixing.mix_sources(docs.select("doc_id", "text", "source")).select("source_size", "target").distinct().collect():
        want[{300 * 6: "a", 100 * 6: "b"}.get(r.source_size, "c")] = r.target
    assert abs(got["a"] * 6 - want["a"]) <= 12 and abs(got["b"] * 6 - want["b"]) <= 12
    again = [mixing.mixed_documents(docs.repartition(n)).collect() for n in (2, 5)]
    assert collections.Counter(again[0]) == collections.Counter(again[1])


def test_flight_keeps_both_totals():
    size = np.arange(1, 400) % 37
    p = mixing.flight(size, np.full(399, 0.37), [1, 2])
    assert ((p > 0) & (p < 1)).sum() <= 3
    assert abs((p * size).sum() - 0.37 * size.sum()) < 1e-6 and abs(p.sum() - 0.37 * 399) < 1e-6


def test_landing_keeps_documents_words_and_chances():
    """Skewed sizes with one giant, and other probabilities: both totals, and each document's rate over many draws."""
    random = np.random.default_rng(5)
    for n, p in ((50, np.full(50, 0.37)), (200, np.full(200, 0.37)), (120, np.tile([0.1, 0.5, 0.85], 40))):
        size = np.maximum(0, np.round(np.exp(random.normal(5, 1.2, n))) - 20)
        size[7] = size.sum() * 0.05
        rates, runs = np.zeros(n), 400
        for r in range(runs):
            got = mixing.balanced(size, p, [3, r])
            assert set(got.tolist()) <= {0.0, 1.0} and abs(got.sum() - p.sum()) < 1
            assert abs(got @ size - p @ size) <= np.sort(size)[n // 2]
            rates += got / runs
        assert (np.abs(rates - p) < 4.5 * np.sqrt(p * (1 - p) / runs)).all()
        assert np.array_equal(mixing.balanced(size, p, [3, 1]), mixing.balanced(size, p, [3, 1]))


def test_landing_of_what_cannot_be_balanced():
    """Documents that no others make up for: whole numbers, about as many as expected, and the words as near as some ways give."""
    for size in ([5.0], [0.0, 0.0], [9.0, 1.0, 1.0, 1.0], [1e6, 3.0, 3.0, 2.0], [4.0] * 9, []):
        got = [mixing.balanced(np.array(size), np.full(len(size), 0.4), [r]) for r in range(300)]
        assert all(set(g.tolist()) <= {0.0, 1.0} and abs(g.sum() - 0.4 * len(size)) < 1 for g in got)
        assert all(abs(g @ np.array(size) - 0.4 * sum(size)) <= max(size, default=0.0) for g in got)


def test_shards(edge, corpus):
    for docs in (edge, corpus):
        rows, n = sharding.feistel_shards(docs).collect(), docs.count()
        by = collections.defaultdict(list)
        for r in rows:
            by[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(rows) == n
        assert max(map(len, by.values())) - min([len(by[k]) for k in range(8)]) <= 1
        texts = {r.doc_id: r.text for r in docs.collect()}
        for r in rows:
            raw = (texts[r.doc_id] or "").encode()
            assert r.size == len(raw) + 1 and r.text_crc32 == (None if texts[r.doc_id] is None else zlib.crc32(raw))


def test_permutation(spark):
    for n in (1, 2, 7, 64, 1000):
        assert sorted(r[0] for r in spark.range(n).select(sharding.permute("id", n, 3)).collect()) == list(range(n))


def test_quality_equals_brute_force(edge, corpus):
    for docs in (edge, corpus):
        texts = collections.defaultdict(list)
        for r in docs.collect():
            texts[r.doc_id].append(r.text or "")
        for r in quality.quality_rules(docs).collect():
            t = texts[r.doc_id][0]
            w = re.findall(WORD, t)
            times = collections.Counter(zip(w, w[1:], w[2:]))
            again = {i + k for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for k in range(3)}
            lines = [x for x in t.split("\n") if re.search(WORD, x)]
            want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and (not r.kept or not r.base_failed)


def test_hosts_fail_by_any_rule(spark):
    """Hosts of symbol junk, of odd words and of repeated lines go whole, though their documents pass the base rules."""
    rnd = random.Random(9)
    word = lambda least, most: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(least, most)))
    plain = lambda n: [word(3, 7) for _ in range(n)]
    makers = {f"h{i}": lambda: " ".join(plain(80)) for i in range(9)}
    junk = lambda: " ".join(plain(60) + ["#*" + w for w in plain(20)])
    makers["junk"] = lambda: junk() if rnd.random() < 0.45 else " ".join(plain(80))
    makers["odd words"] = lambda: " ".join(word(14, 20) for _ in range(70))
    makers["lines"] = lambda: "\n".join([" ".join(plain(60))] + ["again"] * 20)
    rows = [(h, make()) for h, make in makers.items() for _ in range(100)]
    rows += [("h1", junk()) for _ in range(3)] + [("one", junk())]
    docs = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    bad = {"junk", "odd words", "lines"}
    assert not any(r.base_failed for r in got.values())
    assert {h for i, (h, _) in enumerate(rows) if not got[i].kept} == bad
    assert not any(got[i].kept for i, (h, _) in enumerate(rows) if h in bad)


def test_language(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    model = langid.fit_languages(docs.where(~queries.held_out()).select("text", "lang"), VOCABULARY, most_docs=20)
    rows = langid.with_language(docs, model).select("row.*", "lang_pred", "score", queries.held_out().alias("h") if False else F.lit(1)).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_samples_count_distinct_texts(spark, monkeypatch):
    """Copies neither empty the sample nor fill it: languages and licence lines are sampled by distinct texts."""
    docs = spark.range(40_000).select((F.col("id") % 10).alias("k")).select(F.concat(F.lit("text of number "), F.col("k")).alias("text"), F.when(F.col("k") < 5, "en").otherwise("de").alias("lang"))
    got = sorted((r.lang, r.text) for r in langid.sample_by_language(docs, 4).collect())
    assert len(got) == len(set(got)) == 8 and collections.Counter(x for x, _ in got) == {"en": 4, "de": 4}
    seen = []
    whole = license_scan.varied_notices
    monkeypatch.setattr(license_scan, "varied_notices", lambda seed, each, fillers: (seen.extend(fillers), whole(seed, each, fillers))[1])
    lines = docs.select(F.concat("text", F.lit(" with words" * 120)).alias("text"))
    license_scan.fit_licences(lines, most=6)
    assert len(seen) == len(set(seen)) == 6 and all(len(x) > 1000 for x in seen)


def test_forward_sums_all_segmentations():
    pieces = [b"a", b"b", b"ab", b" a", b" "]
    table = langid.PieceTable(sorted({*pieces, *[bytes([b]) for b in range(256)]}), 12)
    logp = np.full((table.size, 1), -20.0)
    share = {b" ": 0.3, b" a": 0.2, b"a": 0.1, b"b": 0.25, b"ab": 0.15}
    for p, v in share.items():
        logp[table.find(np.array([table.hash_of(p)], np.uint64))[0], 0] = np.log(v)
    got = langid.word_scores(np.frombuffer(b"ab", np.uint8), np.array([0]), np.array([2]), table, langid.scaled_table(logp, table))
    assert abs(got[0, 0] - np.log(0.3 * 0.1 * 0.25 + 0.3 * 0.15 + 0.2 * 0.25)) < 1e-9


def test_archives(spark):
    long = "é" * 300_000
    rows = [(1, "u", "x" * 200), (2, "u v", "x" * 200), (3, None, "y"), (4, "u", "y"), (5, "u", None), (6, "u", long), (None, "u", long), (7, "u", "a\r\n\r\nWARC/1.1\r\n\r\nb" * 20)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = {r.page_id: r for r in warc.archive_round_trip(spark, pages, chunk_bytes=1000).collect()}
    for page_id, _, html in rows:
        raw = (html or "").encode()
        assert (got[page_id].payload_bytes, got[page_id].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert {k: (r.record_type, r.refers_to) for k, r in got.items() if r.record_type == "revisit"} == {2: ("revisit", 1), None: ("revisit", 6)}
    assert warc.archive_round_trip(spark, pages.limit(0)).count() == 0


def test_licences(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    found = {(r.doc_id, r.paragraph): r for r in license_scan.licence_finds(docs).where("confirmed").collect()}
    want = {(r.doc_id, i): x for r in docs.collect() for i, x in enumerate(r.text.split("\n")) if re.search("(?i)licen[sc]e", x)}
    assert set(found) == set(want)
    names = {"apache": "Apache", "mit": "MIT", "gpl": "GNU General", "cc-by-nc": "BY-NC"}
    assert all(names[r.family] in want[k] for k, r in found.items())


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}
    assert connected_components(edges.limit(0)).count() == 0


def test_edge_rows_and_empty_tables(spark, edge, empty):
    model = langid.fit_languages(edge.select("text", "lang"), VOCABULARY, rounds=1)
    licences = license_scan.fit_licences(edge)
    forms = {
        "near": (lambda d: near_dedup.near_duplicate_classes(d), 10),
        "kept": (lambda d: near_dedup.keep_one_of_each(d), 8),
        "spans": (lambda d: suffix_dedup.repeated_spans(d), None),
        "cut": (lambda d: suffix_dedup.without_repeats(d), None),
        "licences": (lambda d: license_scan.licence_finds(d, licences), 0),
        "mix": (lambda d: mixing.mix_sources(d), 10),
        "mixed": (lambda d: mixing.mixed_documents(d), None),
        "bpe": (lambda d: bpe.bpe_digests(d, BPE_FILE), 10),
        "tokens": (lambda d: bpe.bpe_tokens(d, BPE_FILE), 10),
        "quality": (lambda d: quality.quality_rules(d), 10),
        "shards": (lambda d: sharding.feistel_shards(d), 10),
        "language": (lambda d: langid.with_language(d, model), 10),
    }
    for name, (form, n) in forms.items():
        got = form(edge).collect()
        assert n is None or len(got) == n, name
        assert form(empty).collect() == [], name
    classes = {(r.doc_id): r.class_id for r in near_dedup.near_duplicate_classes(edge).collect()}
    assert classes[7] == classes[8] == 7 and classes[1] == 1 and classes[3] == 3
    und = {r.row.doc_id for r in langid.with_language(edge, model).where("lang_pred = 'und'").collect()}
    assert und == {1, 2, 3}
