"""Survey system files (.sav): what their variables are, and rows with only the wanted columns, split by rows.

The layout is the published one: a header, one record a variable slot, value
labels, extensions, then the cases, eight bytes a slot, plain or with a command
byte a slot.  The driver reads the dictionary, never the cases.  Files have to
lie where all executors see them, under a path or address that pyarrow opens.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the layout: record types, extensions, command bytes and the system-missing number.
VARIABLE, LABELS, LABELLED, DOCUMENT, EXTENSION, END = 2, 3, 4, 6, 7, 999
LONG_NAMES, LONG_STRINGS, ENCODING = 13, 14, 20
IGNORED, FINISHED, LITERAL, SPACES, MISSING = 0, 252, 253, 254, 255
SYSTEM_MISSING = -np.finfo(float).max
#: Bytes of cases that are looked at together.
CHUNK = 4 << 20


@dataclass
class Variable:
    """A variable: its name as the file spells it, label, string width (0: number), first slot, value labels and missing values."""

    name: str
    label: str
    width: int
    slot: int
    codes: dict = field(default_factory=dict)
    missing: tuple = ()
    missing_range: tuple | None = None


@dataclass
class Dictionary:
    """What stands before the cases, and how those are laid out."""

    variables: list[Variable]
    slots: int
    compressed: bool
    bias: float
    first: int
    size: int
    order: str
    encoding: str
    cases: int


def opened(path: str):
    """The file, as pyarrow opens it, and its size."""
    system, name = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
    return system.open_input_file(name), system.get_file_info(name).size


def read_dictionary(path: str) -> Dictionary:
    """The dictionary of a file; a ValueError for anything but a plain or byte-compressed system file."""
    with opened(path)[0] as f:
        head = f.read(176)
        size = opened(path)[1]
        if head[:4] != b"$FL2":
            raise ValueError("not a plain or byte-compressed survey system file")
        order = "<" if struct.unpack("<i", head[64:68])[0] in (2, 3) else ">"
        compression, _, cases = struct.unpack(order + "iii", head[72:84])
        bias = struct.unpack(order + "d", head[84:92])[0]
        ints = lambda n: struct.unpack(f"{order}{n}i", f.read(4 * n))
        found, slot, sets, long_names, wide, encoding = [], 0, [], {}, set(), None
        while (kind := ints(1)[0]) != END:
            if kind == VARIABLE:
                width, labelled, n_missing, _, _ = ints(5)
                name, label = f.read(8), b""
                if labelled:
                    n = ints(1)[0]
                    label = f.read(n + -n % 4)[:n]
                values = [f.read(8) for _ in range(abs(n_missing))]
                if width >= 0:
                    found.append((name, label, width, slot, n_missing, values))
                slot += 1
            elif kind == LABELS:
                pairs = []
                for _ in range(ints(1)[0]):
                    value, n = f.read(8), f.read(1)[0]
                    pairs.append((value, f.read(n + (-(n + 1)) % 8)[:n]))
                if ints(1)[0] != LABELLED:
                    raise ValueError("value labels without variables")
                sets.append((pairs, [i - 1 for i in ints(ints(1)[0])]))
            elif kind == DOCUMENT:
                f.read(80 * ints(1)[0])
            elif kind == EXTENSION:
                what, unit, n = ints(3)
                data = f.read(unit * n)
                if what == LONG_NAMES:
                    long_names = dict(x.split(b"=", 1) for x in data.split(b"\t") if b"=" in x)
                elif what == LONG_STRINGS:
                    wide = {x.split(b"=", 1)[0] for x in data.replace(b"\0", b"").split(b"\t") if b"=" in x}
                elif what == ENCODING:
                    encoding = data.decode("ascii")
            else:
                raise ValueError(f"a record of the unknown type {kind}")
        ints(1)
        text = lambda b: b.decode(encoding or "cp1252", "replace")
        number = lambda b: struct.unpack(order + "d", b)[0]
        variables = []
        for name, label, width, at, n_missing, values in found:
            if name.rstrip() in wide:
                raise ValueError(f"strings of over 255 bytes are not read: {text(name)}")
            read = [number(v) if not width else text(v).rstrip(" ") for v in values]
            span, single = (tuple(read[:2]), tuple(read[2:])) if n_missing < 0 else (None, tuple(read))
            variables.append(Variable(text(long_names.get(name.rstrip(), name.rstrip())), text(label).rstrip(), width, at, {}, single, span))
        by_slot = {v.slot: v for v in variables}
        for pairs, at in sets:
            for i in at:
                if (v := by_slot.get(i)) is not None:
                    v.codes |= {number(value) if not v.width else text(value).rstrip(" "): text(label) for value, label in pairs}
        if compression not in (0, 1):
            raise ValueError("files compressed by blocks are not read")
        return Dictionary(variables, slot, compression == 1, bias, f.tell(), size, order, encoding or "cp1252", cases)


def variables(spark: SparkSession, path: str) -> DataFrame:
    """(no, variable, label, width): the variables of a file in its order; width 0 is a number."""
    rows = [(i, v.name, v.label, v.width) for i, v in enumerate(read_dictionary(path).variables)]
    return spark.createDataFrame(rows, "no int, variable string, label string, width int")


def value_labels(spark: SparkSession, path: str) -> DataFrame:
    """(variable, code string, label): the value labels of a file."""
    rows = [(v.name, f"{c:g}" if isinstance(c, float) else c, label) for v in read_dictionary(path).variables for c, label in v.codes.items()]
    return spark.createDataFrame(rows, "variable string, code string, label string")


def presence(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """(wanted, found, found_any_case): whether a file has a variable as it is spelled, and in any case."""
    have = [v.name for v in read_dictionary(path).variables]
    lower = {h.lower() for h in have}
    return spark.createDataFrame([(w, w in have, w.lower() in lower) for w in wanted], "wanted string, found boolean, found_any_case boolean")


def commands(data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(command, place of the literal or -1) of the whole blocks of ``data``, which begins with one, and the bytes they take.

    A block is eight commands and a literal for each of those that ask for one.
    """
    starts, at, n = [], 0, len(data)
    while at + 8 <= n:
        after = at + 8 + 8 * data.count(LITERAL, at, at + 8)
        if after > n:
            break
        starts.append(at)
        at = after
    start = np.array(starts, np.int64)
    raw = np.frombuffer(data, np.uint8)
    code = raw[start[:, None] + np.arange(8)] if len(start) else np.zeros((0, 8), np.uint8)
    asks = code == LITERAL
    place = np.where(asks, start[:, None] + 8 + 8 * (np.cumsum(asks, axis=1) - 1), -1)
    return code.ravel(), place.ravel(), at


def row_starts(path: str, d: Dictionary, rows: int) -> list[tuple[int, int, int]]:
    """(byte, commands to pass over, rows) of splits of a compressed file: a walk over the command bytes, in one task, in chunks."""
    out, seen, at = [], 0, d.first
    with opened(path)[0] as f:
        f.seek(at)
        rest, step, done = b"", rows * d.slots, False
        while not done:
            more = f.read(CHUNK)
            rest += more
            code, _, used = commands(rest)
            ended = np.flatnonzero(code == FINISHED)
            code, done = (code[: ended[0]], True) if len(ended) else (code, not more)
            real = np.cumsum(code != IGNORED)
            got = int(real[-1]) if len(real) else 0
            # Splits that begin in this chunk: the block of their first command.
            for n in range(-(-seen // step), -(-(seen + got) // step)):
                i = int(np.searchsorted(real, n * step - seen + 1))
                block = i // 8
                into = n * step - seen - (int(real[8 * block - 1]) if block else 0)
                out.append((at + _block_byte(rest, block), into, rows))
            seen, at, rest = seen + got, at + used, rest[used:]
    whole = seen // d.slots
    return [(b, i, min(rows, whole - n * rows)) for n, (b, i, _) in enumerate(out) if whole > n * rows]


def _block_byte(data: bytes, block: int) -> int:
    at = 0
    for _ in range(block):
        at += 8 + 8 * data.count(LITERAL, at, at + 8)
    return at


def cells(path: str, d: Dictionary, byte: int, into: int, rows: int) -> Iterator[np.ndarray]:
    """Blocks of rows of the cases from a byte on, as raw slots (rows, slots) of eight bytes."""
    with opened(path)[0] as f:
        f.seek(byte)
        if not d.compressed:
            step = max(1, CHUNK // (8 * d.slots))
            for low in range(0, rows, step):
                data = f.read(8 * d.slots * min(step, rows - low))
                yield np.frombuffer(data, "V8").reshape(-1, d.slots)
            return
        kind = d.order + "f8"
        small = (np.arange(256) - d.bias).astype(kind)
        small[MISSING] = SYSTEM_MISSING
        table = small.view("V8").copy()
        table[SPACES] = np.void(b" " * 8)
        rest, kept, left, passed = b"", np.zeros(0, "V8"), rows, into
        while left:
            more = f.read(CHUNK)
            rest += more
            code, place, used = commands(rest)
            ended = np.flatnonzero(code == FINISHED)
            if len(ended):
                code, place = code[: ended[0]], place[: ended[0]]
            real = code != IGNORED
            code, place = code[real], place[real]
            got = table[code]
            asks = place >= 0
            if asks.any():
                raw = np.frombuffer(rest, np.uint8)[place[asks][:, None] + np.arange(8)]
                got[asks] = np.ascontiguousarray(raw).view("V8").ravel()
            skip = min(passed, len(got))
            got, passed = got[skip:], passed - skip
            kept = np.concatenate([kept, got])
            n = min(left, len(kept) // d.slots)
            if n:
                yield kept[: n * d.slots].reshape(n, d.slots)
            kept, left, rest = kept[n * d.slots :], left - n, rest[used:]
            if not more or len(ended):
                return


def column(block: np.ndarray, v: Variable, d: Dictionary, user_missing: bool) -> pa.Array:
    """A variable of a block of rows: doubles or strings, nulls for missing values."""
    if v.width:
        raw = np.ascontiguousarray(block[:, v.slot : v.slot + -(-v.width // 8)]).view(f"S{8 * -(-v.width // 8)}").ravel()
        out = [x[: v.width].decode(d.encoding, "replace").rstrip(" \0") for x in raw.tolist()]
        return pa.array([None if not user_missing and x in v.missing else x for x in out], pa.string())
    x = np.ascontiguousarray(block[:, v.slot]).view(d.order + "f8").astype(float)
    null = x == SYSTEM_MISSING
    if not user_missing:
        null |= np.isin(x, v.missing)
        if v.missing_range:
            null |= (x >= v.missing_range[0]) & (x <= v.missing_range[1])
    return pa.array(x, mask=null)


def read_survey(spark: SparkSession, path: str, columns: list[str] | None = None, rows: int = 20_000, user_missing: bool = False) -> DataFrame:
    """The cases of a file: ``columns`` in any case (all if None), named as the file spells them; doubles and strings.

    Splits are ranges of ``rows`` cases.  In a plain file each task reads its
    range; the places of a compressed file's ranges are found first by one walk
    over its command bytes, so ingest such a file once.  Only wanted columns
    are decoded.  Missing values, also those that the file declares, are null;
    with ``user_missing`` declared ones stay.  A missing name is a ValueError.
    """
    d = read_dictionary(path)
    have = {v.name.lower(): v for v in d.variables}
    if absent := [c for c in columns or [] if c.lower() not in have]:
        raise ValueError(f"the file has no variables {absent}")
    wanted = list(dict.fromkeys(have[c.lower()].name for c in columns)) if columns is not None else [v.name for v in d.variables]
    chosen = [v for name in wanted for v in d.variables if v.name == name]
    schema = T.StructType([T.StructField(v.name, T.StringType() if v.width else T.DoubleType()) for v in chosen])
    if d.compressed:

        def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for _ in range(len(frame)):
                    yield pd.DataFrame(row_starts(path, d, rows), columns=["byte", "into", "rows"])

        splits = [tuple(r) for r in spark.range(1).mapInPandas(walk, "byte long, into long, rows long").collect()]
    else:
        n = (d.size - d.first) // (8 * d.slots)
        splits = [(d.first + 8 * d.slots * low, 0, min(rows, n - low)) for low in range(0, n, rows)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                byte, into, n = (batch.column(c)[i].as_py() for c in ("byte", "into", "rows"))
                for block in cells(path, d, byte, into, n):
                    yield pa.RecordBatch.from_arrays([column(block, v, d, user_missing) for v in chosen], names=[v.name for v in chosen])

    dealt = spark.createDataFrame([(i, *s) for i, s in enumerate(splits)], "no int, byte long, into long, rows long")
    return dealt.repartition(max(1, len(splits)), F.col("no")).mapInArrow(read, schema)
