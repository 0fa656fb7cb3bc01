"""Language ID against a plain forward sum, and its accuracy on documents that were held out."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import langid, queries

VOCABULARY = queries.public_file("piece_bpe_32k.model")


def plain_forward(word: bytes, logp: dict[bytes, float], longest: int) -> float:
    """Log of the sum over all segmentations, byte by byte in logarithms."""
    total = [0.0]
    for j in range(1, len(word) + 1):
        terms = [total[j - n] + logp[word[j - n : j]] for n in range(1, min(longest, j) + 1) if word[j - n : j] in logp]
        top = max(terms)
        total.append(top + math.log(sum(math.exp(t - top) for t in terms)))
    return total[-1]


def test_words_of_any_length_equal_the_plain_sum():
    pieces = langid.public_pieces(VOCABULARY)
    table = langid.PieceTable(pieces)
    assert table.longest == max(map(len, pieces)) > 16
    rnd = random.Random(2)
    random_ = np.random.default_rng(2)
    logp = np.log(random_.dirichlet(np.full(len(pieces), 0.1), 3).T + 1e-9)
    longest = [p for p in pieces if len(p) > 16]
    text = lambda n: b"".join(rnd.choice(pieces) if rnd.random() < 0.8 else rnd.choice(longest) for _ in range(n)).replace(b" ", b"")
    words = [text(n) for n in (1, 1, 2, 3, 5, 8, 12, 12, 13, 14, 40, 41, 200, 2600)]
    words += [words[-1][:n] for n in (47, 48, 49, 50, 511, 512, 513, 520, 1024)] + [b"x" * 10_000]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    got = langid.word_scores(data, start, end, table, langid.scaled_table(logp, table))
    assert max(map(len, words)) >= 10_000
    for lang in range(3):
        known = dict(zip(pieces, logp[:, lang].tolist(), strict=True))
        for i, w in enumerate(words):
            assert abs(got[i, lang] - plain_forward(b" " + w, known, table.longest)) < 1e-7 * len(w) + 1e-9


def test_long_words_train_and_score(spark):
    """Scripts without spaces: words of thousands of bytes train and are told apart; a word of a megabyte is scored."""
    rnd = random.Random(5)
    of = {"zh": "的一是不了人我在有他这中大来上国", "ja": "のにはをたがでてとしれさある"}
    make = lambda lang, n: "".join(rnd.choice(of[lang]) for _ in range(n))
    docs = spark.createDataFrame([(i, make(("zh", "ja")[i % 2], 700), ("zh", "ja")[i % 2]) for i in range(40)], "doc_id bigint, text string, lang string")
    model = langid.fit_languages(docs.where("doc_id < 20"), VOCABULARY, rounds=2)
    rest = docs.where("doc_id >= 20").union(spark.createDataFrame([(99, make("zh", 350_000), "zh")], docs.schema))
    assert all(r.row.lang == r.lang_pred for r in langid.with_language(rest, model).collect())


def test_held_out_accuracy(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    got = queries.op9_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out AND lang IS NOT NULL")
    rows = got.select("lang", "lang_pred", "score").collect()
    by = collections.Counter(r.lang == r.lang_pred for r in rows)
    assert len(rows) > 150 and by[True] >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    assert got.where(~crc).isEmpty()


def test_long_words_train_whole():
    """Expected pieces of a word, of any length, equal those summed over all its segmentations; rescaling changes nothing."""
    pieces = langid.public_pieces(VOCABULARY)
    table, random_ = langid.PieceTable(pieces), np.random.default_rng(3)
    logp = np.log(random_.dirichlet(np.full(len(pieces), 0.1))[:, None] + 1e-9)
    scaled = langid.scaled_table(logp, table)
    prob = dict(zip(pieces, np.exp(logp[:, 0]), strict=True))

    def plain(word: bytes) -> dict[bytes, float]:
        forward, back = [1.0] + [0.0] * len(word), [0.0] * len(word) + [1.0]
        cuts = [(i, j) for j in range(1, len(word) + 1) for i in range(max(0, j - table.longest), j) if word[i:j] in prob]
        for i, j in cuts:
            forward[j] += forward[i] * prob[word[i:j]]
        for i, j in sorted(cuts, reverse=True):
            back[i] += back[j] * prob[word[i:j]]
        out: dict[bytes, float] = collections.defaultdict(float)
        for i, j in cuts:
            if (i, j) != (0, 1):
                out[word[i:j]] += forward[i] * prob[word[i:j]] * back[j] / forward[-1]
        return out

    for word in (b" the", b" " + b"antidisestablishmentarianism" * 2, " überraschungsmomentenreichtümern".encode() * 1):
        got, want = langid.long_counts(np.frombuffer(word, np.uint8), table, scaled, 2.0), plain(word)
        assert {pieces[k]: v for k, v in enumerate(got[:-1]) if v > 1e-12} == pytest.approx({k: 2 * v for k, v in want.items() if 2 * v > 1e-12}, rel=1e-6, abs=1e-12)
    longest = np.frombuffer(b" " + b"abcdefghij" * 2000, np.uint8)
    covered = (langid.long_counts(longest, table, scaled, 1.0)[:-1] * table.lengths).sum()
    assert covered == pytest.approx(len(longest), rel=1e-6) or covered == pytest.approx(len(longest) - 1, rel=1e-6)
