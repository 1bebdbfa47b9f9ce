"""Large JSON files read by many tasks: byte ranges that learn how they begin.

A range cannot tell by itself whether it begins inside a string, or under which keys.  A first pass says
what each range does to the open brackets, for both cases; these summaries, a few rows per file, are put
together in order; a second pass reads the rows that begin in a range, and beyond its end until the last
of them is complete.  All bytes are looked at by numpy; nothing but a range is held in memory.
"""

from __future__ import annotations

import json
import re
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.operators.distributed import settle, shared_folder
from tablewright.sources.files import list_files, open_file

register_pickle_by_value(sys.modules[__name__])  # workers need no install

RANGE = 16 << 20
MORE = 1 << 20  # bytes read at a time beyond the end of a range
MOST_TASKS = 10_000
BLANK = b" \t\r\n"
QUOTE, ESCAPE, OPEN, CLOSE, LIST, COMMA, COLON = 34, 92, (91, 123), (93, 125), 91, 44, 58
KINDS = np.zeros(256, np.int8)  # 1 opens, -1 closes, 2 comma
KINDS[list(OPEN)], KINDS[list(CLOSE)], KINDS[COMMA] = 1, -1, 2

Path = tuple[str, ...]


def file_ranges(files: DataFrame, size: int) -> DataFrame:
    """(path, number, start, stop) of the byte ranges of (path, bytes), evenly over tasks.

    Where `first` is a column, a file's ranges begin there.
    """
    first = F.col("first") if "first" in files.columns else F.lit(0).cast("long")
    rows = files.withColumn("first", first).where(F.col("bytes") > F.col("first"))
    last = F.floor((F.col("bytes") - F.col("first") - 1) / size)
    rows = rows.withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    start = F.col("first") + F.col("number") * size
    rows = rows.select(
        "path", "number", start.alias("start"), F.least(start + size, "bytes").alias("stop")
    )
    return rows.repartition(range_tasks(rows, size))


def range_tasks(ranges: DataFrame, size: int) -> int:
    """Tasks that ranges of `size` bytes are dealt to: small ranges share one, up to RANGE bytes of them.

    There are some for every core all the same, as long as there are ranges for them.
    """
    count = ranges.count()
    cores = ranges.sparkSession.sparkContext.defaultParallelism
    return max(1, min(count, MOST_TASKS, max(4 * cores, -(-count * size // RANGE))))


def read_bytes(path: str, start: int, stop: int) -> bytes:
    with open_file(path) as f:
        f.seek(start)
        return f.read(stop - start)


# ---------------------------------------------------------------- tokens of a piece of JSON


def escaped_at(path: str, start: int) -> bool:
    """Whether the byte at `start` follows an odd number of backslashes."""
    run, at = 0, start
    while at:
        back = read_bytes(path, max(0, at - 4096), at)
        here = len(back) - len(back.rstrip(b"\\"))
        run += here
        if here < len(back):
            break
        at -= len(back)
    return run % 2 == 1


def in_string(data: np.ndarray, escaped: bool) -> np.ndarray:
    """1 from an opening quote to before its closing one, for text that begins outside a string."""
    quote = data == QUOTE
    slash = data == ESCAPE
    if escaped or slash.any():
        at = np.flatnonzero(quote)
        before = at - 1
        run_end = np.maximum.accumulate(np.where(slash, -1, np.arange(len(data), dtype=np.int32)))
        last = np.where(before >= 0, run_end[before], -1)
        n = before - last + ((last < 0) & escaped)
        quote[at[n % 2 == 1]] = False
    return np.bitwise_xor.accumulate(quote.view(np.uint8))


class Tokens:
    """Brackets and commas outside strings, with the number of open brackets after each."""

    def __init__(self, data: np.ndarray, inside: np.ndarray, depth: int = 0) -> None:
        kinds = KINDS[data]
        at = np.flatnonzero((kinds != 0) & (inside == 0))
        self.at, self.kind = at, kinds[at]
        self.depth = depth + np.cumsum(np.where(self.kind == 2, 0, self.kind), dtype=np.int64)


def key_before(path: str, data: bytes, base: int, at: int) -> str | None:
    """The key whose value begins at data[at]; None in an array or at the top.  Reads back if it must."""
    back = 4096
    text, start = data[max(0, at - back) : at], base + max(0, at - back)
    while True:
        rest = text.rstrip(BLANK)
        if rest and rest[-1] != COLON:
            return None
        found = None
        if rest:
            found = re.search(rb'"((?:[^"\\]|\\.)*+)"\s*\Z', rest[:-1], re.DOTALL)
            # the match may start at a quote inside the key if the opening one is not in sight
            opened = found and not _odd_slashes(rest, found.start()) and found.start() > 0
            if opened and rest[: found.start()].rstrip(BLANK)[-1:] in (b"{", b","):
                return json.loads(b'"' + found[1] + b'"')
        if start == 0:
            return json.loads(b'"' + found[1] + b'"') if found else None
        back *= 4
        low = max(0, start + len(text) - back)
        text, start = read_bytes(path, low, start) + text, low


def _odd_slashes(text: bytes, at: int) -> bool:
    return (at - len(text[:at].rstrip(b"\\"))) % 2 == 1


# ---------------------------------------------------------------- first pass


_SUMMARY = (
    "path string, number bigint, start bigint, stop bigint, "
    "ways array<struct<closes: bigint, opens: array<struct<bracket: string, key: string>>, inside: int>>"
)


def _summary(path: str, start: int, stop: int) -> list[dict]:
    data = read_bytes(path, start, stop)
    codes = np.frombuffer(data, np.uint8)
    outside = in_string(codes, escaped_at(path, start))
    ways = []
    for begins in (0, 1):
        inside = outside ^ begins
        found = Tokens(codes, inside)
        real = found.kind != 2
        at, kind, depth = found.at[real], found.kind[real], found.depth[real]
        closes = max(0, -int(depth.min(initial=0)))
        lowest = np.minimum.accumulate(depth[::-1])[::-1]  # from here on
        open_at = at[(kind == 1) & (depth <= lowest)]
        opens = [
            {"bracket": chr(data[i]), "key": key_before(path, data, start, i)} for i in open_at.tolist()
        ]
        ways.append({"closes": closes, "opens": opens, "inside": int(inside[-1])})
    return ways


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opens = pa.list_(pa.struct([("bracket", pa.string()), ("key", pa.string())]))
    ways = pa.list_(pa.struct([("closes", pa.int64()), ("opens", opens), ("inside", pa.int32())]))
    for batch in batches:
        for row in batch.to_pylist():
            made = _summary(row["path"], row["start"], row["stop"])
            one = pa.RecordBatch.from_pylist([row], schema=batch.schema)
            yield one.append_column("ways", pa.array([made], ways))


_STATE = (
    "path string, number bigint, start bigint, stop bigint, inside int, "
    "stack array<struct<bracket: string, key: string>>"
)


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries in the order of (path, number) to how each range begins."""
    pair = pa.list_(pa.struct([("bracket", pa.string()), ("key", pa.string())]))
    path, inside, stack = None, 0, []
    for batch in batches:
        insides, stacks = [], []
        for row in batch.select(["path", "ways"]).to_pylist():
            if row["path"] != path:
                path, inside, stack = row["path"], 0, []
            insides.append(inside)
            stacks.append(stack)
            way = row["ways"][inside]
            stack = stack[: max(0, len(stack) - way["closes"])] + way["opens"]
            inside = way["inside"]
        out = batch.select(["path", "number", "start", "stop"])
        out = out.append_column("inside", pa.array(insides, pa.int32()))
        yield out.append_column("stack", pa.array(stacks, pair))


def json_states(spark: SparkSession, paths: str | list[str], size: int = RANGE) -> DataFrame:
    """(path, number, start, stop, inside, stack): how each range of JSON files begins."""
    found = file_ranges(list_files(spark, paths), size).mapInArrow(_summaries, _SUMMARY)
    found = found.repartition("path").sortWithinPartitions("path", "number")
    states = settle(found.mapInArrow(_put_together, _STATE))
    return states.repartition(range_tasks(states, size))


# ---------------------------------------------------------------- second pass


def _names(stack: list[dict]) -> Path | None:
    """The keys that lead to the last bracket; None if the way goes through an array."""
    if any(s["bracket"] == "[" for s in stack[:-1]):
        return None
    return tuple(s["key"] for s in stack[1:])


class Piece:
    """A range with its tokens; reads on as far as it is asked to."""

    def __init__(self, row: dict) -> None:
        self.path, self.base = row["path"], row["start"]
        self.data = read_bytes(row["path"], row["start"], row["stop"])
        self.size = len(self.data)
        self.stack = row["stack"]
        codes = np.frombuffer(self.data, np.uint8)
        inside = in_string(codes, escaped_at(row["path"], row["start"])) ^ row["inside"]
        self.inside = int(inside[-1]) if len(inside) else row["inside"]
        self.tokens = Tokens(codes, inside, len(self.stack))

    def more(self) -> bool:
        """Adds bytes from beyond the range; False at the end of the file."""
        start = self.base + len(self.data)
        data = read_bytes(self.path, start, start + max(MORE, len(self.data) - self.size))
        if not data:
            return False
        codes = np.frombuffer(data, np.uint8)
        inside = in_string(codes, escaped_at(self.path, start)) ^ self.inside
        depth = int(self.tokens.depth[-1]) if len(self.tokens.at) else len(self.stack)
        new, t = Tokens(codes, inside, depth), self.tokens
        t.at = np.append(t.at, new.at + len(self.data))
        t.kind, t.depth = np.append(t.kind, new.kind), np.append(t.depth, new.depth)
        self.data += data
        self.inside = int(inside[-1])
        return True

    def arrays(self) -> Iterator[tuple[Path, int, int, int]]:
        """(keys, depth inside, first token, token after the last) of arrays with only objects around them.

        Tokens of an array that goes on from before the range begin at 0; only tokens of the range count.
        """
        t = self.tokens
        count = int(np.searchsorted(t.at, self.size))
        marks: dict[int, np.ndarray] = {}

        def end(of: int, depth: int) -> int:
            """The token that closes an array whose inside has this depth."""
            if depth not in marks:
                marks[depth] = np.flatnonzero(t.depth[:count] < depth)
            k = int(np.searchsorted(marks[depth], of))
            return int(marks[depth][k]) if k < len(marks[depth]) else count

        stack, i = list(self.stack), 0
        outer = next((k for k, s in enumerate(stack) if s["bracket"] == "["), None)
        if outer is not None:
            stack = stack[: outer + 1]
            i = end(0, len(stack))
            yield _names(stack), len(stack), 0, i
        while i < count:
            kind = t.kind[i]
            if kind == -1:
                del stack[len(stack) - 1 :]
            elif kind == 1:
                at = int(t.at[i])
                stack.append(
                    {"bracket": chr(self.data[at]), "key": key_before(self.path, self.data, self.base, at)}
                )
                if self.data[at] == LIST:
                    stop = end(i + 1, len(stack))
                    yield _names(stack), len(stack), i, stop
                    i = stop
                    continue
            i += 1

    def elements(self, depth: int, first: int, stop: int) -> Iterator[bytes]:
        """The elements of an array that begin in the range; nothing between two commas is an element
        too, for the parser to complain of."""
        t = self.tokens
        real = np.arange(first, stop)
        real = real[(t.kind[first:stop] == 2) & (t.depth[first:stop] == depth)]
        starts = t.at[real].tolist()
        opened = first < len(t.at) and t.kind[first] == 1 and t.depth[first] == depth
        if opened and self.data[int(t.at[first])] == LIST:
            starts.insert(0, int(t.at[first]))
        if not starts:
            return
        ends = starts[1:]
        after = int(np.searchsorted(t.at, starts[-1])) + 1
        while True:
            open_ones = t.depth[after:], t.kind[after:]
            hit = np.flatnonzero((open_ones[0] < depth) | ((open_ones[1] == 2) & (open_ones[0] == depth)))
            if len(hit):
                ends.append(int(t.at[after + int(hit[0])]))
                break
            after = len(t.at)
            if not self.more():
                ends.append(len(self.data))
                break
        for a, b in zip(starts, ends):
            value = self.data[a + 1 : b].strip(BLANK)
            if value or self.data[a] != LIST or self.data[b : b + 1] != b"]":
                yield value.replace(b"\n", b" ").replace(b"\r", b" ")


def _array_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            piece = Piece(row)
            t = piece.tokens
            sizes = []
            for names, depth, first, stop in piece.arrays():
                kind, deep = t.kind[first:stop], t.depth[first:stop]
                commas = int(((kind == 2) & (deep == depth)).sum())
                objects = int(((kind == 1) & (deep == depth + 1)).sum())
                if names is not None and (commas or objects):
                    sizes.append((row["path"], list(names), commas, objects))
            if sizes:
                columns = [pa.array(c) for c in zip(*sizes)]
                columns[1] = pa.array([s[1] for s in sizes], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["path", "names", "commas", "objects"])


def longest_array(states: DataFrame) -> Path | None:
    """Keys of the array of objects with most elements in one file; the first by name among equals."""
    sizes = states.mapInArrow(
        _array_sizes, "path string, names array<string>, commas bigint, objects bigint"
    )
    each = sizes.groupBy("path", "names").agg(F.sum("commas").alias("n"), F.sum("objects").alias("o"))
    best = each.where("o > 0").groupBy("names").agg(F.max("n").alias("n"))
    row = best.orderBy(F.desc("n"), "names").first()
    return tuple(row["names"]) if row else None


def array_rows(states: DataFrame, names: Path) -> DataFrame:
    """(value): the elements of the array under these keys as text, one line each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                piece = Piece(row)
                for found, depth, first, stop in piece.arrays():
                    if found != names:
                        continue
                    values = pa.array(piece.elements(depth, first, stop), pa.binary())
                    for i in range(0, len(values), 10_000):
                        part = values.slice(i, 10_000)
                        yield pa.RecordBatch.from_arrays([part], names=["value"])

    return states.mapInArrow(rows, "value binary").select(F.col("value").cast("string"))


def parsed_rows(rows: DataFrame) -> DataFrame | None:
    """JSON texts as typed rows, as Spark's reader types them; None where one is broken or there is none.

    The texts are written out once as lines, which Spark reads in parallel.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/tablewright-json-{uuid.uuid4().hex}"
    rows.select(F.concat(F.lit('{"row":'), "value", F.lit("}"))).write.text(path)
    out = spark.read.json(path)
    return out if out.columns == ["row"] else None


def starts_with(files: DataFrame, mark: bytes) -> DataFrame:
    """Adds `fits`: whether the first byte that is no blank is `mark`, in a one-byte encoding."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = []
            for path in batch["path"].to_pylist():
                head = read_bytes(path, 0, 4096).removeprefix(b"\xef\xbb\xbf")
                fits.append(b"\0" not in head[:4] and head.lstrip(BLANK)[:1] == mark)
            yield batch.append_column("fits", pa.array(fits))

    return files.mapInArrow(look, "path string, bytes bigint, fits boolean")
