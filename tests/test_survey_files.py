"""Survey system files, written here by the published layout, plain and compressed."""

import struct

import numpy as np
import pytest

from tallyweave.operators import profile
from tallyweave.sources import survey_files


def written_file(path, rows, compressed: bool, order: str = "<", long_strings: bool = False) -> str:
    """age (number, label, value labels, missing 99 and -1), name (string of 12 bytes), weight, income (missing 90 to 99 and 7)."""
    i = lambda *x: struct.pack(f"{order}{len(x)}i", *x)
    d = lambda x: struct.pack(order + "d", x)
    text = lambda s, n: s.encode().ljust(n)
    out = b"$FL2" + text("made by a test", 60) + i(2, 5, int(compressed), 0, len(rows)) + d(100.0) + text("01 Jan 20", 9) + text("00:00:00", 8) + text("", 64) + b"\0" * 3
    label = "Age of the respondent"
    out += i(2, 0, 1, 2, 0, 0) + text("AGE", 8) + i(len(label)) + text(label, len(label) + -len(label) % 4) + d(99.0) + d(-1.0)
    out += i(2, 12, 0, 0, 0, 0) + text("V2_A", 8) + i(2, -1, 0, 0, 0, 0) + text("", 8)
    out += i(2, 0, 0, 0, 0, 0) + text("WTSSALL", 8) + i(2, 0, 0, -3, 0, 0) + text("INCOME", 8) + d(90.0) + d(99.0) + d(7.0)
    out += i(3, 2) + d(1.0) + bytes([3]) + text("one", 7) + b"".join([d(2.0), bytes([8]), text("number 2", 15)]) + i(4, 1, 1)
    out += i(6, 1) + text("a note", 80)
    names = b"AGE=Age\tV2_A=FirstName\tWTSSALL=wtssall\tINCOME=Income"
    out += i(7, 13, 1, len(names)) + names + i(7, 20, 1, 5) + b"UTF-8" + i(7, 99, 4, 2) + i(5, 6)
    if long_strings:
        out += i(7, 14, 1, 12) + b"V2_A=00400\0\t"
    out += i(999, 0)
    codes, literals = [], []

    def flush():
        nonlocal out, codes, literals
        out += bytes(codes).ljust(8, b"\0") + b"".join(literals)
        codes, literals = [], []

    for age, name, weight, income in rows:
        slots = [age, *[name.encode().ljust(16)[k : k + 8] for k in (0, 8)], weight, income]
        for s in slots:
            raw = s if isinstance(s, bytes) else d(survey_files.SYSTEM_MISSING if s is None else s)
            if not compressed:
                out += raw
                continue
            if isinstance(s, bytes) and s == b" " * 8:
                codes.append(254)
            elif s is None:
                codes.append(255)
            elif not isinstance(s, bytes) and s == int(s) and -99 <= s <= 151:
                codes.append(int(s) + 100)
            else:
                codes.append(253)
                literals.append(raw)
            if len(codes) == 8:
                flush()
    if compressed:
        codes.append(252)
        flush()
    path.write_bytes(out)
    return str(path)


def made_rows(n: int):
    rng = np.random.default_rng(n)
    age = lambda i: [None, 99.0, -1.0, 1.0, 2.0, 37.0, 1e9, 0.5][i % 8]
    return [(age(i), ["", "Zoë", "exactly 12 b", "x"][i % 4], float(rng.random()), [7.0, 90.0, 99.0, 100.0, None, 12.25][i % 6]) for i in range(n)]


@pytest.mark.parametrize("compressed", [False, True])
@pytest.mark.parametrize("order", ["<", ">"])
def test_round_trip(spark, tmp_path, compressed, order, monkeypatch):
    monkeypatch.setattr(survey_files, "CHUNK", 3000)
    rows = made_rows(1003)
    path = written_file(tmp_path / "a.sav", rows, compressed, order)
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted(map(tuple, survey_files.read_survey(spark, path, rows=97).collect()), key=key)
    want = [(None if a in (99.0, -1.0) else a, n, w, None if x is not None and (90 <= x <= 99 or x == 7) else x) for a, n, w, x in rows]
    assert got == sorted(want, key=key)
    some = survey_files.read_survey(spark, path, ["INCOME", "age", "Age"], rows=500, user_missing=True)
    assert some.columns == ["Income", "Age"] and sorted(map(tuple, some.collect()), key=key) == sorted([(x, a) for a, _, _, x in rows], key=key)
    with pytest.raises(ValueError):
        survey_files.read_survey(spark, path, ["absent"])


def test_dictionary(spark, tmp_path):
    path = written_file(tmp_path / "a.sav", made_rows(3), True)
    assert [tuple(r) for r in survey_files.variables(spark, path).orderBy("no").collect()] == [(0, "Age", "Age of the respondent", 0), (1, "FirstName", "", 12), (2, "wtssall", "", 0), (3, "Income", "", 0)]
    assert sorted(map(tuple, survey_files.value_labels(spark, path).collect())) == [("Age", "1", "one"), ("Age", "2", "number 2")]
    assert [tuple(r) for r in survey_files.presence(spark, path, ["wtssall", "AGE", "year"]).collect()] == [("wtssall", True, True), ("AGE", False, True), ("year", False, False)]


@pytest.mark.parametrize("compressed", [False, True])
def test_empty_and_unknown_files(spark, tmp_path, compressed):
    path = written_file(tmp_path / "a.sav", [], compressed)
    assert survey_files.read_survey(spark, path).count() == 0
    with pytest.raises(ValueError):
        survey_files.read_dictionary(written_file(tmp_path / "b.sav", [], compressed, long_strings=True))
    (tmp_path / "c.sav").write_bytes(b"$FL3" + b"\0" * 400)
    with pytest.raises(ValueError):
        survey_files.read_dictionary(str(tmp_path / "c.sav"))


def test_profile_of_a_file(spark, tmp_path):
    """From file to weighted statistics, as a catalogue is made."""
    rows = made_rows(400)
    path = written_file(tmp_path / "a.sav", rows, True)
    got = profile.weighted_stats(survey_files.read_survey(spark, path, ["age", "wtssall"], rows=64), [], "Age", "wtssall").first()
    kept = [(a, w) for a, _, w, _ in rows if a not in (None, 99.0, -1.0)]
    mean = sum(a * w for a, w in kept) / sum(w for _, w in kept)
    assert got.n == len(kept) and got["mean"] == pytest.approx(mean)
    assert got["std"] == pytest.approx((sum(w * (a - mean) ** 2 for a, w in kept) / sum(w for _, w in kept)) ** 0.5)
