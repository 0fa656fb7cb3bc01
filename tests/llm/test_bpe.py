"""The encoder against the library on every code point."""

import hashlib
import random
import tracemalloc

from tokenizers import Tokenizer

from tallyweave.llm import bpe, queries

BPE_FILE = queries.public_file("word_bpe_49k.json")
#: All code points but surrogates and the planes of ideographs, private use and unassigned ones, of which every 97th.
POINTS = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or 0xA000 <= c < 0xAC00 or 0xF900 <= c < 0x20000 or 0x2A6C0 <= c < 0x2A700 or c % 97 == 0)]


def same(encoder, library, texts):
    for low in range(0, len(texts), 5000):
        part = texts[low : low + 5000]
        words = [encoder.pieces(t) for t in part]
        encoder.learn(set().union(*words))
        for t, own, e in zip(part, words, library.encode_batch(part, add_special_tokens=False), strict=True):
            ids = [int(i) for w in own for i in encoder.ids_of[w].split()]
            assert ids == e.ids, [hex(ord(c)) for c in t]
            assert encoder.decode(ids) == library.decode(e.ids, skip_special_tokens=False)


def test_every_code_point_equals_the_library():
    encoder, library = bpe.TrieEncoder(bpe.tokenizer_definition(BPE_FILE)), Tokenizer.from_file(BPE_FILE)
    later = [c for r in (bpe.LATER_MARKS, bpe.LATER_LETTERS, bpe.LATER_CAPITALS) for a, b, *_ in r for c in {a, a - 1, b, b + 1}]
    same(encoder, library, [f"a{chr(c)}b!{chr(c)}?1{chr(c)}" for c in [*POINTS, *later]])


def test_marks_and_capitals_in_any_order_equal_the_library():
    encoder, library = bpe.TrieEncoder(bpe.tokenizer_definition(BPE_FILE)), Tokenizer.from_file(BPE_FILE)
    rnd = random.Random(6)
    marks = [0x0301, 0x0323, 0x0345, 0x0327, 0x1161, 0x11A8, *[c for a, b in bpe.LATER_MARKS for c in (a, b)]]
    capitals = [c for a, b, _ in bpe.LATER_CAPITALS for c in (a, b)]
    letters = [c for a, b in bpe.LATER_LETTERS for c in (a, b)]
    others = [*map(ord, "aeE1'sΣİ가ᄀ Åᆓ5!")]
    pick = lambda: chr(rnd.choice(rnd.choice([marks, marks, capitals, letters, others])))
    same(encoder, library, ["".join(pick() for _ in range(rnd.randint(1, 9))) for _ in range(20000)])


def test_memory_is_of_few_words_at_a_time():
    """Of a batch of many words only a part is held, and of each distinct word its ids only."""
    encoder, rnd = bpe.TrieEncoder(bpe.tokenizer_definition(BPE_FILE)), random.Random(3)
    words = ["".join(rnd.choice("abcdefghijkl") for _ in range(8)) for _ in range(20000)]
    texts = [" ".join(rnd.choice(words) for _ in range(500)) for _ in range(1000)]
    library = Tokenizer.from_file(BPE_FILE)
    tracemalloc.start()
    got = list(encoder.digest(texts))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30 << 20
    for text, own in list(zip(texts, got, strict=True))[:50]:
        e = library.encode(text, add_special_tokens=False)
        ids, decoded = " ".join(map(str, e.ids)), library.decode(e.ids, skip_special_tokens=False)
        assert own == (len(e.ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
