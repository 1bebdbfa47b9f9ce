"""Token ids as binary segments of patched frame-of-reference blocks."""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import category, normalize

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

MAGIC = b"PFR1"
BLOCK = 128  # ids of a block
PACKED = 90  # percentile of a block that its width holds
SEGMENT = 1 << 20  # ids from which a segment is closed
CACHE = 400_000  # distinct words a task remembers
USUAL = 10  # longest word it remembers
# fixed value: the words of the tokenizer's pattern
RUN = re.compile(r"[^\W\d_]+|\d|'(?:s|t|re|ve|m|ll|d)|(?:[^\w\s]+|_+)+")
ODD_SPACE = "\x1c\x1d\x1e\x1f"  # white space to str.split only
SEGMENTS = "part int, seq int, before long, n_ids long, payload binary"
BROADCAST_ROWS = 1_000_000  # part files, at 12 bytes each
HEAD = struct.Struct("<4sIIQQ")  # magic, block, documents, ids, bytes of blocks


# ------------------------------------------------------------------ blocks


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """The ids as blocks, and where each block starts.

    A block is: its least id (4 bytes), width (1), number of outliers (1), the differences from the
    least id at that width, low bit first, then the outliers' places (1 each) and whole differences
    (4 each).  Differences too wide for the width keep their low bits there.
    """
    n = -(-len(ids) // block)
    rows = np.full(n * block, ids[-1] if len(ids) else 0, ids.dtype if ids.dtype.itemsize < 8 else np.uint32)
    rows[: len(ids)] = ids
    rows = rows.reshape(n, block)
    least = rows.min(axis=1) if n else rows[:, 0]
    above = rows - least[:, None]
    cut = max(0, block * PACKED // 100 - 1)
    usual = np.partition(above, cut, axis=1)[:, cut] if n else least
    width = np.ceil(np.log2(usual.astype(np.float64) + 1)).astype(np.int64)
    far = above > ((1 << width) - 1).astype(rows.dtype)[:, None]
    outliers = far.sum(axis=1)
    body = -(-width * block // 8)
    size = 6 + body + 5 * outliers
    starts = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    out[starts[:, None] + np.arange(4)] = least.astype("<u4")[:, None].view(np.uint8)
    out[starts + 4], out[starts + 5] = width, outliers
    for w in np.unique(width[width > 0]):
        at = np.flatnonzero(width == w)
        for part in (at[s : s + 1024] for s in range(0, len(at), 1024)):
            packed = np.packbits(_bits(above[part], int(w)), axis=1, bitorder="little")
            out[starts[part][:, None] + 6 + np.arange(packed.shape[1])] = packed
    run, place = np.nonzero(far)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(outliers) - outliers, outliers)
    base = (starts + 6 + body)[run]
    out[base + nth] = place
    value = above[run, place].astype("<u4")[:, None].view(np.uint8)
    out[(base + outliers[run] + 4 * nth)[:, None] + np.arange(4)] = value
    return out.tobytes(), starts.astype("<u4")


def _bits(rows: np.ndarray, width: int) -> np.ndarray:
    """The low `width` bits of each number, low bit first, a row for each row."""
    size = 2 if width <= 16 else 4
    raw = rows.astype(f"<u{size}").view(np.uint8).reshape(*rows.shape, size)
    return np.unpackbits(raw, axis=2, bitorder="little")[:, :, :width].reshape(len(rows), -1)


def _numbers(bits: np.ndarray, width: int) -> np.ndarray:
    """The inverse: bits (rows, numbers, width) as numbers."""
    size = 2 if width <= 16 else 4
    full = np.zeros((*bits.shape[:2], 8 * size), np.uint8)
    full[:, :, :width] = bits
    return np.packbits(full, axis=2, bitorder="little").view(f"<u{size}")[:, :, 0]


def unpack(data: bytes, starts: np.ndarray, count: int, block: int = BLOCK) -> np.ndarray:
    """The ids of the blocks that start there; `count` cuts the padding of the last."""
    n = len(starts)
    raw = np.frombuffer(data, np.uint8)
    starts = starts.astype(np.int64)
    least = raw[starts[:, None] + np.arange(4)].copy().view("<u4").ravel()
    width, outliers = raw[starts + 4].astype(np.int64), raw[starts + 5].astype(np.int64)
    rows = np.zeros((n, block), np.uint32)
    body = -(-width * block // 8)
    for w in np.unique(width[width > 0]):
        at = np.flatnonzero(width == w)
        for part in (at[s : s + 1024] for s in range(0, len(at), 1024)):
            packed = raw[starts[part][:, None] + 6 + np.arange(-(-w * block // 8))]
            bits = np.unpackbits(packed, axis=1, bitorder="little", count=block * w)
            rows[part] = _numbers(bits.reshape(len(part), block, w), int(w))
    run = np.repeat(np.arange(n), outliers)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(outliers) - outliers, outliers)
    base = (starts + 6 + body)[run]
    place = raw[base + nth].astype(np.int64)
    value = raw[(base + outliers[run] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").ravel()
    rows[run, place] = value
    rows += least[:, None]
    return rows.ravel()[:count]


def segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """Documents as one binary segment: head, document table, block index, blocks, checksum."""
    data, starts = pack(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], "<i8")
    body = b"".join(
        (
            HEAD.pack(MAGIC, BLOCK, len(doc_ids), len(ids), len(data)), known.tobytes(),
            names.tobytes(), lengths.astype("<i8").tobytes(), starts.tobytes(), data,
        )
    )
    return body + struct.pack("<I", zlib.crc32(body))


def parse(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and ids of a segment; an error where the checksum does not hold."""
    if zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
        raise ValueError("damaged segment")
    magic, block, docs, count, size = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a segment")
    at = HEAD.size
    known = np.frombuffer(payload, np.uint8, docs, at)
    names = np.frombuffer(payload, "<i8", docs, at := at + docs)
    lengths = np.frombuffer(payload, "<i8", docs, at := at + 8 * docs)
    starts = np.frombuffer(payload, "<u4", -(-count // block), at := at + 8 * docs)
    at += 4 * len(starts)
    ids = unpack(payload[at : at + size], starts, count, block)
    return [int(d) if k else None for d, k in zip(names, known, strict=True)], lengths, ids


# ------------------------------------------------------------------ tokens


@lru_cache(maxsize=1)
def unassigned_pattern() -> re.Pattern:
    runs: list[list[int]] = []
    for c in range(0x110000):
        if category(chr(c)) == "Cn":
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]")


class Words(dict):
    """Ids by word; a word not met before is asked of the tokenizer's model.

    The model reads bytes as letters, as its pre-tokenizer writes them.
    """

    def __init__(self, tokenizer, kind: str) -> None:
        super().__init__()
        self.kind, self.ask, self.whole = kind, tokenizer.model.tokenize, tokenizer.encode
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # stand for themselves
        self.letters = {b: 0x100 + n for n, b in enumerate(sorted(set(range(256)).difference(plain)))}

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            ids = [t.id for t in self.ask(word)]
        elif word.isalpha():
            ids = [t.id for t in self.ask(word.encode().decode("latin-1").translate(self.letters))]
        else:
            ids = self.whole(word, add_special_tokens=False).ids
        out = array(self.kind, ids).tobytes()
        if len(word) <= USUAL:
            self[word] = out
        return out


class Encoder:
    """A tokenizer of lower-cased words, asked once per distinct word.

    Its own pattern cuts a text into words that it encodes one by one (white space is dropped), so a
    text's ids are those of its words in turn.  Texts that may hold a special token, separators that
    only Python takes for white space, or characters Python does not know go to it whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.known = Words(self.tokenizer, self.kind)

    def unassigned(self, text: str) -> bool:
        """Whether a text holds characters that a newer Unicode than Python's may call letters."""
        if text.isascii():
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return unassigned_pattern().search(text) is not None
        return False

    def split(self, text: str) -> list[str]:
        if not text.isascii():
            text = normalize("NFC", text).replace("\u03a3", "\u03c3")  # no final sigma
        return RUN.findall(text.lower())

    def encode(self, text: str | None, end: int) -> np.ndarray:
        """The ids of a text, then `end`."""
        text = text or ""
        tail = array(self.kind, [end]).tobytes()
        if "<|" in text or any(c in text for c in ODD_SPACE) or self.unassigned(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            data = array(self.kind, ids).tobytes() + tail
        else:
            if len(self.known) > CACHE:
                self.known.clear()
            data = b"".join([*map(self.known.__getitem__, self.split(text)), tail])
        return np.frombuffer(data, np.dtype(f"={self.kind}"))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encode(path: str, end: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tool = TaskContext.get().partitionId(), encoder(path)
        seq = before = 0
        doc_ids: list[int | None] = []
        rows: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(rows)
            payload = segment(doc_ids, np.array([len(r) for r in rows]), ids)
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                    "before": pa.array([before], pa.int64()), "n_ids": pa.array([held], pa.int64()),
                    "payload": pa.array([payload], pa.binary()),
                }
            )

        for b in batches:
            texts, names = b.column("text"), b.column("doc_id")
            for name, text in zip(names.to_pylist(), texts, strict=True):
                ids = tool.encode(text.as_py(), end)
                doc_ids.append(name)
                rows.append(ids)
                held += len(ids)
                if held >= SEGMENT:
                    yield close()
                    seq, before = seq + 1, before + held
                    doc_ids, rows, held = [], [], 0
        if rows:
            yield close()

    return encode


def write_ids(
    docs: DataFrame, path: str, tokenizer: str, end: int, id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Writes the token ids of whole texts, `end` after each, in ascending order of the ids' rows.

    One folder of Parquet part files that carry segments as binary rows (part, seq, before, n_ids,
    payload): Spark's committer makes them whole whatever executors are lost.  A segment holds whole
    documents.  Rows are dealt out by ranges of the document id and encoded in that order, so the
    texts are shuffled once and the ids never.  NULL text is empty; NULL ids come first; rows that
    repeat an id stay separate, ordered by text.  An empty table gives no segments.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_encode(tokenizer, end), SEGMENTS).write.parquet(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start, payload in zip(b.column("start").to_pylist(), b.column("payload"), strict=True):
            doc_ids, lengths, ids = parse(payload.as_py())
            data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            ends = np.cumsum(lengths)
            first = ends - lengths
            crc = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(first.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()), pa.array(first + start), pa.array(lengths),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Segments with the number of ids before them; one row per part file decides the offsets."""
    rows = spark.read.schema(SEGMENTS).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    if rows.select("part").distinct().count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    return rows.join(offsets, "part").select(
        (F.col("before") + F.col("offset")).alias("start"), "payload"
    )


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
    return _placed(spark, path).mapInArrow(
        _digest, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids of each document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, payload in zip(b.column("start").to_pylist(), b.column("payload"), strict=True):
                doc_ids, lengths, ids = parse(payload.as_py())
                ends = np.append(0, np.cumsum(lengths))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()), pa.array(ends[:-1] + start),
                        pa.ListArray.from_arrays(ends.astype(np.int32), ids.astype(np.int32)),
                    ],
                    names=["doc_id", "start", "ids"],
                )

    return _placed(spark, path).mapInArrow(read, "doc_id long, start long, ids array<int>")
