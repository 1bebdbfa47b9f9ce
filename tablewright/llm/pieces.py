"""SentencePiece encoding and decoding as a weighted finite-state transducer."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SPACE = "▁"
CACHE = 800_000  # distinct units a task remembers
PAIRS = 1_000_000  # neighbouring pieces a task remembers
NORMAL, CONTROL, BYTE = 1, 3, 6
SIGNS = ".,!?;:|*&%$#()\"-"


class Transducer:
    """Normaliser, pieces and byte fallback of a BPE model, composed with a text.

    The normaliser maps blanks to the space sign and puts one in front.  The piece transducer reads
    characters and writes pieces; a character that is no piece is written as its bytes.  Weights are
    tropical: an arc costs 0 where the piece may follow the one before and is missing (infinite)
    where it may not.  A piece may follow another when merging the two pieces' characters, best
    score first, gives back just these two.  A chain of such pairs is exactly the model's
    segmentation, since the first merge across a boundary would also happen in the pair; so one
    path of finite weight is left at each place, and it is the shortest.

    The machine is back in its start state wherever no piece spans two characters.  Texts are cut
    there, and the path of a unit is kept.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        n = model.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces:
            raise ValueError("only models that keep the text as it is")
        self.prefix = SPACE if n.add_dummy_prefix else ""
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.bytes = {
            int(p.piece[3:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE
        }
        self.unknown = model.trainer_spec.unk_id
        self.kind = "H" if len(model.pieces) <= 1 << 16 else "I"
        self.written: list[str | bytes] = [
            p.piece if p.type == NORMAL
            else bytes([int(p.piece[3:-1], 16)]) if p.type == BYTE
            else "" if p.type == CONTROL else model.trainer_spec.unk_surface
            for p in model.pieces
        ]
        inside = {a + b for p in self.score for a, b in zip(p, p[1:], strict=False)}
        alone = "".join(c for c in "\n\t\r" if not any(c in two for two in inside))
        free = re.escape("".join(
            c for c in SIGNS
            if not any(c in two and (two[0].isalpha() or two[1].isalpha()) for two in inside)
        ))
        letters, stop = r"[^\W\d_]", f"[{free}{SPACE}{alone}]|\\Z"
        cut = [
            f"{SPACE}*{letters}++(?={stop})",  # no piece spans a letter and a free sign
            f"{SPACE}*[{free}]++(?=[{SPACE}{alone}]|{letters}|\\Z)",
            f"{SPACE}*[^{SPACE}{alone}]+", f"{SPACE}+", f"[{alone}]",
        ]
        ends = free and alone and not any(SPACE in p.lstrip(SPACE) for p in self.score)
        self.units = re.compile("|".join(cut) if ends else r"(?s).+")
        self.arcs: dict = {}  # by character; a state where a piece ends holds the empty text too
        for p in self.score:
            state = self.arcs
            for c in p:
                state = state.setdefault(c, {})
            state[""] = True
        self.known: dict[str, bytes] = {}
        self.after: dict[str, dict[str, bool]] = {}
        self.pairs = 0

    def merged(self, text: str) -> list[str]:
        """Characters merged while two neighbours are a piece: best score first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, before: str, piece: str) -> bool:
        """Whether the weight of this pair is finite."""
        self.pairs += 1
        if self.pairs > PAIRS:
            self.after, self.pairs = {}, 1
        want = [before, piece] if before else [piece]
        out = self.merged(before + piece) == want
        self.after.setdefault(before, {})[piece] = out
        return out

    def shortest(self, unit: str) -> list[str]:
        """The pieces on the shortest path of a unit."""
        size = len(unit)
        last: list[str] = [""] * (size + 1)
        for start in range(size):
            before = last[start]
            allowed = self.after.get(before) or {}
            state, end = self.arcs, start
            while end < size and state is not None:
                state = state.get(unit[end])
                end += 1
                if last[end] == "" and (end == start + 1 or state and "" in state):
                    piece = unit[start:end]
                    finite = allowed.get(piece)
                    if finite is None:
                        finite = self.follows(before, piece)
                    if finite:
                        last[end] = piece
        out, end = [], size
        while end:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def numbers(self, unit: str) -> bytes:
        out: list[int] = []
        for piece in self.shortest(unit):
            if piece in self.ids:
                out.append(self.ids[piece])
            elif self.bytes:
                out += [self.bytes[b] for b in piece.encode()]
            else:
                out.append(self.unknown)
        return array(self.kind, out).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, f"={self.kind}")
        units = self.units.findall(self.prefix + text.replace(" ", SPACE))
        if len(self.known) > CACHE:
            self.known = {}
        known = self.known
        for u in set(filterfalse(known.__contains__, units)):
            known[u] = self.numbers(u)
        return np.frombuffer(b"".join(map(known.__getitem__, units)), f"={self.kind}")

    def decode(self, ids: np.ndarray) -> str:
        """The inverse: pieces to text, runs of byte pieces as UTF-8, the front space taken away."""
        parts = list(map(self.written.__getitem__, ids.tolist()))
        if all(type(p) is str for p in parts):
            text = "".join(parts)
        else:
            text = b"".join(p if type(p) is bytes else p.encode() for p in parts).decode(
                "utf-8", "replace"
            )
        text = text.removeprefix(self.prefix) if self.prefix else text
        return text.replace(SPACE, " ")


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode_pieces(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """The rows with `ids` (array of int), `n_ids` and `decoded`, the text the ids give back.

    NULL and empty texts have no ids and decode to the empty text.  decoded differs from the text
    only where the text itself holds the space sign, which the model does not tell from a blank.
    Columns of these names are replaced; all others, and repeated rows, stay.  Each row is encoded
    on its own, so nothing is shuffled.
    """
    names = ["ids", "n_ids", "decoded"]
    rest = [c for c in docs.columns if c not in names]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = transducer(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                ids = [tool.encode(t.as_py()) for t in b.column(text_col)]
                sizes = np.array([len(x) for x in ids], np.int64)
                flat = np.concatenate([*ids, np.zeros(0, np.uint16)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(c) for c in rest),
                        pa.ListArray.from_arrays(
                            np.append(0, np.cumsum(sizes)).astype(np.int32), flat
                        ),
                        pa.array(sizes), pa.array([tool.decode(x) for x in ids], pa.string()),
                    ],
                    names=[*rest, *names],
                )

    rows = docs.select(rest)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(encode, f"{schema}, ids array<int>, n_ids long, decoded string")
