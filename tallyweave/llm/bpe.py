"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch are walked in sorted order, which is a
depth-first traversal of their trie: a stack holds, for every prefix on the
path, the last token of the prefix's encoding, and a word that shares a prefix
with its predecessor starts from the stack at that depth.  The last token of a
longer prefix is the longest vocabulary entry that ends it and may stand after
the last token of what precedes it; two tokens may stand together if encoding
their joined text gives the two again.  A word's encoding is read back along
its last tokens.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.shared import bounded_batches, give_back

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
#: White space as Unicode defines it.
_WS = r"\t-\r \x85\xa0  -     　"

_LATIN = r"A-Za-zªµºÀ-ÖØ-öø-ɏ"
_LATIN_NUMBERS = r"0-9²³¹¼-¾"
_BEYOND_LATIN = re.compile(r"[^\x00-ɏ]")

# Fixed values.  The tokenizers library composes by Unicode 9, splits by Unicode 16 and lowers by Unicode 17; Python 3.13
# has Unicode 15.1, and the regex module may have a later one.
#: Combining marks since Unicode 10, and the one later mark that composes: to the library they combine with nothing.
LATER_MARKS = [
    (0x07FD, 0x07FD), (0x0898, 0x089F), (0x08CA, 0x08D3), (0x09FE, 0x09FE), (0x0C3C, 0x0C3C), (0x0D3B, 0x0D3C), (0x0EBA, 0x0EBA),
    (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF),
    (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930),
    (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42),
    (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE),
    (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
]
#: Letters and numbers since Unicode 17: to the library's split they are neither.
LATER_LETTERS = [
    (0x0558, 0x0558), (0x058B, 0x058C), (0x088F, 0x088F), (0x0C5C, 0x0C5C), (0x0CDC, 0x0CDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9),
    (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128),
    (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
#: First and last capital of a range since Unicode 16, and the lower-case letter of the first.
LATER_CAPITALS = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3),
    (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x019B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
]
#: A character that is no letter, number or white space, in place of a later letter while a text is split.
_NEITHER = "☃"


def _class(ranges: list[tuple[int, ...]]) -> str:
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b, *_ in ranges) + "]"


_LATER_MARK, _LATER_LETTER, _LATER_CAPITAL = (re.compile(_class(r)) for r in (LATER_MARKS, LATER_LETTERS, LATER_CAPITALS))
_LOWER = {a + i: low + i for a, b, low in LATER_CAPITALS for i in range(b - a + 1)}


def composed(text: str) -> str:
    """NFC as of Unicode 9: later marks stand for themselves and keep their neighbours apart."""
    if unicodedata.is_normalized("NFC", text):
        return text
    out, at = [], 0
    for m in _LATER_MARK.finditer(text):
        out += [unicodedata.normalize("NFC", text[at : m.start()]), m.group()]
        at = m.end()
    return "".join([*out, unicodedata.normalize("NFC", text[at:])])


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class TrieEncoder:
    """Encoder and decoder for one tokenizer file with word ends (vocabulary, merges, normaliser, split pattern)."""

    def __init__(self, definition: str, cache_words: int = 400_000):
        spec = json.loads(definition)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.text = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        made: dict[int, int] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            token = self.vocab[a + b]
            self.rank[self.vocab[a], self.vocab[b]] = rank
            if token not in made:
                made[token], self.parts[token] = rank, (self.vocab[a], self.vocab[b])
        self.made = made
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pattern = regex.compile(split.replace(r"\s", _WS))
        # The same classes spelt out for texts without letters beyond U+024F, for the faster engine.
        self.latin = re.compile(split.replace(r"\s", _WS).replace(r"[\p{L}]", f"[{_LATIN}]").replace(r"\p{L}", _LATIN).replace(r"\p{N}", _LATIN_NUMBERS))
        self.letters = byte_letters()
        self.fits: dict[int, bool] = {}
        # An entry whose own text encodes to other tokens never stands in an encoding.
        self.vocab = {t: i for t, i in self.vocab.items() if i not in self.parts or self._seam(*self.parts[i], self.made[i])}
        # Longest entry by its last three letters, inside a word and at its end: what to try first.
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for t in self.vocab:
            at_end = bool(self.end) and t.endswith(self.end)
            t = t.removesuffix(self.end) if at_end else t
            most = self.final if at_end else self.inner
            most[t[-3:]] = max(most.get(t[-3:], 0), len(t))
        self.number = {i: str(i) for i in self.text}
        self.text_of_number = {str(i): t for i, t in self.text.items()}
        self.ids_of: dict[str, str] = {}
        self.old_ids: dict[str, str] = {}
        self.cache_words = cache_words

    def normal(self, text: str) -> str:
        """NFC and lower case letter by letter; white space is dropped by the split pattern anyhow."""
        if text.isascii():
            return text.lower()
        text = composed(text)
        if _LATER_CAPITAL.search(text):
            text = text.translate(_LOWER)
        return text.replace("Σ", "σ").lower()

    def may_follow(self, a: int, b: int) -> bool:
        """Whether encoding the joined text of tokens a and b gives a and b again.

        Going down both tokens' merges from the last one made, a pair across
        the seam must never be mergeable before the merge it would pre-empt.
        """
        key = a << 20 | b
        known = self.fits.get(key)
        if known is not None:
            return known
        good = self._seam(a, b, 1 << 60)
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[key] = good
        return good

    def _seam(self, left: int, right: int, limit: int) -> bool:
        """Whether the seam between two tokens stays open until the merge of rank ``limit``."""
        made, parts, rank = self.made, self.parts, self.rank
        while True:
            across = rank.get((left, right))
            if across is not None and across < limit:
                return False
            x, y = made.get(left, -1), made.get(right, -1)
            if x < 0 and y < 0:
                return True
            # The later merge is undone first.  Of equal pairs the left one merges first, so
            # the seam wins a tie against the right token's merge and loses it against the left's.
            if x > y:
                left, limit = parts[left][1], x
            else:
                right, limit = parts[right][0], y + 1

    def encode_words(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of each word (byte letters, sorted), by depth-first traversal of their trie."""
        vocab, may_follow, fits, inner, final, end = self.vocab, self.may_follow, self.fits, self.inner, self.final, self.end
        last: list[int] = [-1]  # last[d]: last token of the first d letters of the path
        size: list[int] = [0]
        before = ""
        for word in words:
            depth, most = 0, min(len(word) - 1, len(before) - 1)
            while depth < most and word[depth] == before[depth]:
                depth += 1
            del last[depth + 1 :], size[depth + 1 :]
            n = len(word)
            for d in range(depth + 1, n + 1):
                three = word[d - 3 if d > 3 else 0 : d]
                if d == n:
                    k, own = d - final.get(three, 2), word + end
                    stop = d + len(end)
                else:
                    k, own, stop = d - inner.get(three, 2), word, d
                for k in range(k if k > 0 else 0, d):
                    token = vocab.get(own[k:stop])
                    if token is not None:
                        if k == 0:
                            break
                        good = fits.get(last[k] << 20 | token)
                        if good or (good is None and may_follow(last[k], token)):
                            break
                last.append(token)
                size.append(d - k)
            ids, d = [], n
            while d:
                ids.append(last[d])
                d -= size[d]
            ids.reverse()
            yield ids
            last.pop(), size.pop()
            before = word

    def learn(self, words: set[str]) -> None:
        """Encode the words that neither generation of the cache holds.

        When the young generation is full it becomes the old one: words in use
        stay, the rest goes, and memory is bounded.  Only ids are kept: the
        decoded text follows from them.
        """
        ids_of = self.ids_of
        if len(ids_of) > self.cache_words:
            self.old_ids = ids_of
            ids_of = self.ids_of = {}
        words = words.difference(ids_of)
        for word in words.intersection(self.old_ids):
            ids_of[word] = self.old_ids[word]
        new = list(words.difference(self.old_ids))
        letters, number = self.letters, self.number
        spelt = {w: w if w.isascii() and w.isprintable() else "".join([letters[b] for b in w.encode()]) for w in new if w not in self.special}
        for word in words.intersection(self.special):
            ids_of[word] = number[self.special[word]]
        new = sorted(spelt, key=spelt.__getitem__)
        for word, ids in zip(new, self.encode_words([spelt[w] for w in new]), strict=True):
            ids_of[word] = " ".join([number[i] for i in ids])

    def pieces(self, text: str) -> list[str]:
        """Words of a text in order, and the special tokens that stand in it."""
        if self.special_at is None or "<|" not in text:
            return self._find(text)
        out: list[str] = []
        for part in self.special_at.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out += self._find(part)
        return out

    def _find(self, text: str) -> list[str]:
        text = self.normal(text)
        if text.isascii() or not _BEYOND_LATIN.search(text):
            return self.latin.findall(text)
        if not _LATER_LETTER.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(_LATER_LETTER.sub(_NEITHER, text))]

    def digest(self, texts: list[str], most_words: int = 100_000) -> Iterator[tuple[int, str, str]]:
        """Token count and digests of ids and decoded text, in batches of about ``most_words`` words."""
        group: list[list[str]] = []
        held = 0
        for text in texts:
            group.append(self.pieces(text))
            held += len(group[-1])
            if held >= most_words:
                yield from self._flush(group)
                group, held = [], 0
        yield from self._flush(group)

    def _flush(self, group: list[list[str]]) -> Iterator[tuple[int, str, str]]:
        self.learn(set().union(*group))
        for g in group:
            ids = " ".join(map(self.ids_of.__getitem__, g))
            decoded = " ".join(map(self.text_of_number.__getitem__, ids.split(" "))) if ids else ""
            yield ids.count(" ") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    def encode(self, text: str) -> list[int]:
        """Ids of one text."""
        words = self.pieces(text)
        self.learn(set(words))
        return [int(i) for w in words for i in self.ids_of[w].split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens' texts joined by a space, special ones included, as the file names no decoder; unknown ids are skipped."""
        return " ".join([self.text[i] for i in ids if i in self.text])


def tokenizer_definition(path: str) -> str:
    """The tokenizer file as text, a fixed small public file of 2 MB."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def bpe_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode whole texts; one row per document with the digests of ids and decoded text.

    A null or empty text has no tokens and the digests of the empty string.
    Repeated rows give repeated rows, an empty table no rows; other columns
    are ignored, whatever their names.  No shuffle; memory is bounded by the
    word cache, one text and one Arrow batch.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_definition(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TrieEncoder(shared.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                rows = list(encoder.digest([t or "" for t in part.column(1).to_pylist()]))
                n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        del encoder
        give_back()

    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def bpe_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string): the real outputs of the encoder and decoder, nulls and empties as in ``bpe_digests``."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_definition(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TrieEncoder(shared.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                ids = [encoder.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(encoder.decode, ids), pa.string())],
                    names=["doc_id", "ids", "decoded"],
                )

    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, ids array<int>, decoded string"
    )
