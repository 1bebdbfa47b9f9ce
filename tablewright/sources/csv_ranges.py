"""CSV records of large files by byte ranges, with line breaks inside quoted cells and lines to skip.

Where a record ends depends on the quotes before it, so a range cannot tell alone.  A first pass runs the
automaton of the format over each range from every state it may begin in; the states are put together in
file order; then each range gives the records that begin in it.  The heading and the lines before it are
cut off by one look at the head of each file, so no line needs a number.
"""

from __future__ import annotations

import codecs
import csv
import io
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.operators.distributed import settle
from tablewright.sources.files import list_files, open_file, spread
from tablewright.sources.ranges import MORE, RANGE, file_ranges, range_tasks

register_pickle_by_value(sys.modules[__name__])  # workers need no install

HEAD = 1 << 20
PACKED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")
STATES = "NSUQE"  # at a record, at a cell, in a plain cell, in a quoted one, after a quote in one


def read_piece(path: str, start: int, stop: int | None) -> bytes:
    """Bytes of a file; a compressed one is unpacked whole, as it has no places to begin at."""
    if path.lower().endswith(PACKED):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(
            "file://" + path[5:] if path.startswith("file:/") and path[:7] != "file://" else path
        )
        with system.open_input_stream(inner) as f:
            return f.read()[start:stop]
    with open_file(path) as f:
        f.seek(start)
        return f.read() if stop is None else f.read(stop - start)


class Grammar:
    """The records of a delimiter, a quote (or none) and a line end."""

    def __init__(self, delim: str, quote: str, newline: bytes, encoding: str) -> None:
        self.newline, self.encoding = newline, encoding
        self.delim, self.quote = delim.encode(encoding), quote.encode(encoding)
        d, n = re.escape(self.delim), re.escape(newline)
        plain = rb"[^" + d + n + rb"]*+"
        if quote:
            q = re.escape(self.quote)
            body = rb"(?:[^" + q + rb"]|" + q + q + rb")*+"
            self.closing = re.compile(body)
            # atomic: a quoted cell that the piece cuts off must not be tried again as a plain one
            cell = rb"(?>" + q + body + rb"(?:" + q + plain + rb"|\Z)|" + plain + rb")"
        else:
            cell = plain
        self.plain = re.compile(plain)
        self.cell = re.compile(cell)
        self.record = re.compile(rb"(?:" + cell + d + rb")*+" + cell)

    def record_end(self, data: bytes, at: int) -> int:
        """Place of the line end that closes the record or rest of one at `at`; len(data) if there is none."""
        return self.record.match(data, at).end()

    def enter(self, data: bytes, state: str) -> tuple[int, str]:
        """From the start of a piece to the next record or cell: (place, 'N' or 'S'), or the end and its state."""
        at, size = 0, len(data)
        if state == "E":
            if not size:
                return 0, "E"
            state = "Q" if data[:1] == self.quote else "U"
            at = 1 if state == "Q" else 0
        if state == "Q":
            at = self.closing.match(data, at).end()
            if at == size:
                return at, "Q"
            at += 1
            if at == size:
                return at, "E"
            state = "U"
        if state == "U":
            at = self.plain.match(data, at).end()
            if at == size:
                return at, "U"
            state = "N" if data[at : at + 1] == self.newline else "S"
            at += 1
        return at, state

    def starts(self, data: bytes, at: int, state: str) -> Iterator[int]:
        """Where records begin, the one at `at` among them if `state` says so; the last may be len(data)."""
        if state == "N":
            yield at
        while True:
            end = self.record_end(data, at)
            if end >= len(data):
                return
            at = end + 1
            yield at

    def state_in(self, data: bytes, at: int) -> str:
        """State at the end of data, of which no record ends behind `at`, where a cell begins."""
        while True:
            cell = self.cell.match(data, at)
            if cell.end() < len(data):
                at = cell.end() + 1
                continue
            text = cell[0]
            if not text:
                return "S"
            if not self.quote or text[:1] != self.quote:
                return "U"
            closed = self.closing.match(text, 1).end()
            if closed == len(text):
                return "Q"
            return "E" if closed == len(text) - 1 else "U"

    def ends(self, data: bytes) -> dict[str, str]:
        """State at the end of a piece for each state at its start."""
        out: dict[str, str] = {}
        known: dict[int, str] = {}  # by record start, of the first run
        for state in STATES:
            if state in "QE" and not self.quote:
                out[state] = state
                continue
            at, now = self.enter(data, state)
            if now not in "NS" or (at == len(data) and now == "N"):
                out[state] = now
                continue
            last, seen = at, []
            result = None
            for start in self.starts(data, at, now):
                if start in known:
                    result = known[start]
                    break
                seen.append(start)
                last = start
            if result is None:
                result = "N" if seen and last == len(data) else self.state_in(data, last)
                if result == "S" and seen and last == len(data):
                    result = "N"
            if state in "NS":
                known.update(dict.fromkeys(seen, result))
            out[state] = result
        return out


def _encoding(name: str) -> str:
    return {"ISO-8859-1": "latin-1"}.get(name, name)


# ---------------------------------------------------------------- heads


_HEAD = "path string, bytes bigint, first bigint, newline string, names array<string>"


def csv_heads(files: DataFrame, delim: str, quote: str, encoding: str, skip: int, header: bool) -> DataFrame:
    """(path, bytes, first, newline, names): where the records of each file begin, and its heading.

    `skip` counts lines; empty lines before the heading are passed over.  Without heading, names are
    _c0, _c1, ... by the cells of the first record.  A compressed file counts its unpacked bytes.
    """
    encoding, wide = _encoding(encoding), encoding.lower().startswith("utf-16")
    encoding = "utf-8" if wide else encoding

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                path, size = row["path"], HEAD
                while True:
                    data = read_piece(path, 0, size)
                    packed = path.lower().endswith(PACKED)
                    whole = len(data) < size if not packed else False
                    if wide:  # names only: places in such a file are not those of its UTF-8 form
                        data = data[: len(data) // 2 * 2].decode("utf-16", "replace").encode()
                    newline = b"\n" if b"\n" in data or b"\r" not in data else b"\r"
                    grammar = Grammar(delim, quote, newline, encoding)
                    at = 3 if data.startswith(codecs.BOM_UTF8) else 0
                    for _ in range(skip):
                        at = data.find(newline, at) + 1 or len(data)
                    while data[at : at + 2] == b"\r\n" or data[at : at + 1] == newline:
                        at += data[at : at + 2].find(newline) + 1
                    end = grammar.record_end(data, at)
                    if end < len(data) or whole or (packed and len(data) < size):
                        break
                    size *= 4
                text = data[at:end].decode(encoding, "replace")
                cells = next(csv.reader(io.StringIO(text, newline=""), delimiter=delim,
                                        quotechar=quote or None,
                                        quoting=csv.QUOTE_MINIMAL if quote else csv.QUOTE_NONE), [])
                names = cells if header else [f"_c{i}" for i in range(len(cells))]
                bytes_ = len(read_piece(path, 0, None)) if packed else row["bytes"]
                yield pa.RecordBatch.from_pydict({
                    "path": [path],
                    "bytes": pa.array([bytes_], pa.int64()),
                    "first": pa.array([min(end + 1, bytes_) if header else at], pa.int64()),
                    "newline": [newline.decode()],
                    "names": pa.array([names], pa.list_(pa.string())),
                })

    return spread(files).mapInArrow(heads, _HEAD)


# ---------------------------------------------------------------- records


def csv_records(
    heads: DataFrame, delim: str, quote: str, encoding: str, size: int = RANGE
) -> DataFrame:
    """(value): the records behind the headings of `csv_heads`, as text; empty lines are no records."""
    encoding = _encoding(encoding)
    heads = settle(heads)
    lines = {r["newline"] for r in heads.select("newline").distinct().collect()}  # two at most
    parts = []
    for newline in sorted(lines):
        files = heads.where(F.col("newline") == newline)
        plain = ~F.lower("path").rlike(r"\.(gz|bz2|zst|lz4|snappy|deflate)\z")
        ranges = file_ranges(files.where(plain), size).unionByName(
            files.where(~plain & (F.col("bytes") > F.col("first"))).select(
                "path", F.lit(0).cast("long").alias("number"), F.col("first").alias("start"),
                F.col("bytes").alias("stop"),
            )
        )
        parts.append(_records(settle(ranges), size, Grammar(delim, quote, newline.encode(), encoding)))
    out = parts[0] if parts else heads.select(F.lit("").alias("value")).limit(0)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _records(ranges: DataFrame, size: int, grammar: Grammar) -> DataFrame:
    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = grammar.ends(read_piece(row["path"], row["start"], row["stop"]))
                one = pa.RecordBatch.from_pylist([row], schema=batch.schema)
                yield one.append_column("ends", pa.array(["".join(found[s] for s in STATES)]))

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, state = None, "N"
        for batch in batches:
            states = []
            for here, way in zip(batch["path"].to_pylist(), batch["ends"].to_pylist()):
                if here != path:
                    path, state = here, "N"
                states.append(state)
                state = way[STATES.index(state)]
            yield batch.drop_columns(["ends"]).append_column("state", pa.array(states, pa.string()))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values = []
                for value in range_records(grammar, row):
                    if len(value) > len(grammar.newline) or value.strip(b"\r\n"):
                        values.append(value.decode(grammar.encoding, "replace"))
                    if len(values) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(values)], names=["value"])
                        values = []
                if values:
                    yield pa.RecordBatch.from_arrays([pa.array(values)], names=["value"])

    plain = "path string, number bigint, start bigint, stop bigint"
    found = ranges.mapInArrow(ends, f"{plain}, ends string")
    found = found.repartition("path").sortWithinPartitions("path", "number")
    states = settle(found.mapInArrow(put_together, f"{plain}, state string"))
    states = states.repartition(range_tasks(states, size))
    return states.mapInArrow(records, "value string")


def range_records(grammar: Grammar, row: dict) -> Iterator[bytes]:
    """The records that begin in a range; the last is read to its end."""
    data = read_piece(row["path"], row["start"], row["stop"])
    size = len(data)
    at, state = grammar.enter(data, row["state"])
    if state not in "NS":
        return
    if state == "S":
        at = grammar.record_end(data, at) + 1
    while at < size:
        end = grammar.record_end(data, at)
        step = MORE
        while end >= len(data):
            more = read_piece(row["path"], row["start"] + len(data), row["start"] + len(data) + step)
            if not more:
                break
            data += more
            step *= 2
            end = grammar.record_end(data, at)
        yield data[at:end].removesuffix(b"\r") if grammar.newline == b"\n" else data[at:end]
        at = end + 1
