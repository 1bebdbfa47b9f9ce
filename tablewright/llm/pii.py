"""Personal data: base patterns, and a character-level bidirectional LSTM with a CRF."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.common import settled

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 12_000  # documents whose windows the network may learn from
WINDOWS = 1500  # windows that it learns from
DISGUISED_SHARE = 0.3  # share of them with spans in another writing
BARE_SHARE = 0.5  # share of them without a span
WIDTH = 96  # characters of a window; the next one starts half a window later
AROUND = 40  # characters around a digit or an at sign that are read
EMBED, HIDDEN, EPOCHS, BATCH = 12, 20, 6, 50
TAGS = 1 + 2 * len(KINDS)  # outside, and first and inner of each kind
SEED = 8

# fixed values: the base patterns
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TRIGGER = re.compile(r"[0-9@]++")

Span = tuple[str, int, int]


# ------------------------------------------------------------------ base


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        x = int(d) * (1 + n % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches of the e-mail pattern, found from the at signs, in one pass."""
    out: list[Span] = []
    taken, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append(("email", start, domain.end()))
        taken = domain.end() if domain else at + 1
        at = text.find("@", max(taken, at + 1))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns by kind, then start; matches that fail their test are dropped."""
    out = emails(text) if "@" in text else []
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGIT.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def listed(spans: list[Span]) -> str:
    """kind:start:end, by kind and start, comma-joined."""
    order = {k: n for n, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


# ------------------------------------------------------------------ characters

SIGNS = " \n@.-_+()%,/:='\"[]#*"


def _class(c: str) -> int:
    if "0" <= c <= "9":
        return 1
    if "a" <= c <= "z":
        return 2
    if "A" <= c <= "Z":
        return 3
    at = SIGNS.find(c)
    return 4 + at if at >= 0 else 4 + len(SIGNS) + (1 if c.isalpha() else 0)


class Classes(dict):
    def __missing__(self, c: str) -> int:
        self[c] = _class(c)
        return self[c]


CLASSES = Classes()
SYMBOLS = 6 + len(SIGNS)


def codes(text: str) -> np.ndarray:
    return np.array([CLASSES[c] for c in text], np.int32)


def tags(spans: list[Span], start: int, end: int) -> np.ndarray:
    """The tag of each character of a stretch; earlier kinds win where spans overlap."""
    out = np.zeros(end - start, np.int32)
    for kind, s, e in reversed(spans):
        s, e = max(s, start), min(e, end)
        if s < e:
            first = 1 + 2 * KINDS.index(kind)
            out[s - start : e - start] = first + 1
            out[s - start] = first
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and at signs, merged.

    Every kind of span holds one, so the rest of the text can hold none.
    """
    out: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        s, e = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


# ------------------------------------------------------------------ network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states of a batch (steps, rows, features), and what the gradient needs."""
    steps, rows, _ = x.shape
    n = wh.shape[0]
    h, c = np.zeros((rows, n), x.dtype), np.zeros((rows, n), x.dtype)
    out, kept = np.zeros((steps, rows, n), x.dtype), []
    inputs = x @ wx + b
    for t in range(steps):
        z = inputs[t] + h @ wh
        i, f, o = (_sigmoid(z[:, k * n : (k + 1) * n]) for k in range(3))
        g = np.tanh(z[:, 3 * n :])
        kept.append((h, c, i, f, o, g))
        c = f * c + i * g
        h = o * np.tanh(c)
        out[t] = h
    kept.append((h, c))
    return out, kept


def lstm_back(x, wx, wh, kept, dout):
    steps, rows, _ = x.shape
    n = wh.shape[0]
    dwh, dz_all = np.zeros_like(wh), np.zeros((steps, rows, 4 * n), x.dtype)
    dh, dc = np.zeros((rows, n), x.dtype), np.zeros((rows, n), x.dtype)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g = kept[t]
        after = np.tanh(kept[t + 1][1])
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - after**2)
        dz = dz_all[t]
        dz[:, :n] = dc * g * i * (1 - i)
        dz[:, n : 2 * n] = dc * c * f * (1 - f)
        dz[:, 2 * n : 3 * n] = dh * after * o * (1 - o)
        dz[:, 3 * n :] = dc * i * (1 - g**2)
        dwh += h.T @ dz
        dh, dc = dz @ wh.T, dc * f
    flat = dz_all.reshape(-1, 4 * n)
    return x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(axis=0), dz_all @ wx.T


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def crf_loss(scores: np.ndarray, moves: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of the gold tags and its gradients (steps, rows, tags)."""
    steps, rows, k = scores.shape
    ahead = np.zeros((steps, rows, k))
    ahead[0] = scores[0]
    for t in range(1, steps):
        ahead[t] = scores[t] + _lse(ahead[t - 1][:, :, None] + moves[None], 1)
    back = np.zeros((steps, rows, k))
    for t in range(steps - 2, -1, -1):
        back[t] = _lse(moves[None] + (scores[t + 1] + back[t + 1])[:, None, :], 2)
    total = _lse(ahead[-1], 1)
    dscores = np.exp(ahead + back - total[None, :, None])
    dmoves = np.zeros_like(moves)
    r = np.arange(rows)
    right = scores[0, r, gold[0]].copy()
    dscores[0, r, gold[0]] -= 1
    for t in range(1, steps):
        both = ahead[t - 1][:, :, None] + moves[None] + (scores[t] + back[t])[:, None, :]
        dmoves += np.exp(both - total[:, None, None]).sum(axis=0)
        np.add.at(dmoves, (gold[t - 1], gold[t]), -1)
        right += scores[t, r, gold[t]] + moves[gold[t - 1], gold[t]]
        dscores[t, r, gold[t]] -= 1
    return float((total - right).mean()), dscores / rows, dmoves / rows


def viterbi(scores: np.ndarray, moves: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Best tags of rows of different lengths (steps, rows)."""
    steps, rows, _ = scores.shape
    best = scores[0].copy()
    came = np.zeros(scores.shape, np.int8)
    for t in range(1, steps):
        ways = best[:, :, None] + moves[None]
        came[t] = ways.argmax(axis=1)
        new = ways.max(axis=1) + scores[t]
        best = np.where((t < sizes)[:, None], new, best)
    out = np.zeros((steps, rows), np.int64)
    tag = best.argmax(axis=1)
    r = np.arange(rows)
    for t in range(steps - 1, -1, -1):
        inside = t < sizes
        out[t] = np.where(inside, tag, 0)
        tag = np.where(inside & (t > 0), came[t][r, tag], tag)
    return out


@dataclass
class Network:
    """Embedding, one LSTM per direction, tag scores and CRF transitions."""

    p: dict[str, np.ndarray]

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Tag scores (steps, rows, tags) of rows of character classes."""
        p = self.p
        e = p["embed"][x.T]
        ahead, kept_a = lstm(e, p["ax"], p["ah"], p["ab"])
        behind, kept_b = lstm(e[::-1], p["bx"], p["bh"], p["bb"])
        both = np.concatenate([ahead, behind[::-1]], axis=2)
        return both @ p["out"] + p["outb"], (e, both, kept_a, kept_b)

    def gradients(self, x: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p = self.p
        scores, (e, both, kept_a, kept_b) = self.scores(x)
        loss, dscores, dmoves = crf_loss(scores, p["moves"], gold.T)
        dboth = dscores @ p["out"].T
        n = p["ah"].shape[0]
        ax, ah, ab, de_a = lstm_back(e, p["ax"], p["ah"], kept_a, dboth[:, :, :n])
        bx, bh, bb, de_b = lstm_back(e[::-1], p["bx"], p["bh"], kept_b, dboth[::-1, :, n:])
        embed = np.zeros_like(p["embed"])
        np.add.at(embed, x.T, de_a + de_b[::-1])
        flat = both.reshape(-1, both.shape[2])
        return loss, {
            "embed": embed, "ax": ax, "ah": ah, "ab": ab, "bx": bx, "bh": bh, "bb": bb,
            "out": flat.T @ dscores.reshape(-1, TAGS), "outb": dscores.sum(axis=(0, 1)), "moves": dmoves,
        }


def fresh(seed: int = SEED) -> Network:
    rng = np.random.default_rng(seed)
    n = HIDDEN

    def weights(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

    bias = np.zeros(4 * n)
    bias[n : 2 * n] = 1  # remember at first
    moves = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):  # an inner tag follows its own kind only
        moves[:, 2 + 2 * k] = -4
        moves[1 + 2 * k, 2 + 2 * k] = moves[2 + 2 * k, 2 + 2 * k] = 0
    return Network({
        "embed": weights(SYMBOLS, EMBED), "ax": weights(EMBED, 4 * n), "ah": weights(n, 4 * n),
        "ab": bias.copy(), "bx": weights(EMBED, 4 * n), "bh": weights(n, 4 * n), "bb": bias.copy(),
        "out": weights(2 * n, TAGS), "outb": np.zeros(TAGS), "moves": moves,
    })


def fit(x: np.ndarray, gold: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam over shuffled batches of windows."""
    net, rng = fresh(seed), np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, total = 0, epochs * -(-len(x) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            _, grad = net.gradients(x[rows], gold[rows])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            step += 1
            rate = 0.02 * (1 - 0.9 * step / total)
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / max(norm, 1e-9))
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                net.p[k] = net.p[k] - rate * (mean[k] / (1 - 0.9**step)) / (
                    np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8
                )
    return Network({k: v.astype(np.float32) for k, v in net.p.items()})


# ------------------------------------------------------------------ training data


def disguised(kind: str, text: str, rng: np.random.Generator) -> str:
    """Another way to write a span that the base patterns need not find."""
    pick = int(rng.integers(3))
    if kind == "email":
        return text.replace("@", (" @ ", "[@]", "(@)")[pick])
    if kind == "ip":
        return text.replace(".", ("[.]", " . ", "-")[pick])
    if kind == "phone":
        bare = text.lstrip("+")
        head, _, rest = bare.partition(" ")
        return (rest or bare, bare, bare.replace(" ", "-"))[pick]
    digits = text.replace(" ", "").replace("-", "")
    return ("-", " ", "/")[pick].join(digits[i : i + 4] for i in range(0, len(digits), 4))


def examples(texts: list[str], wanted: int = WINDOWS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Windows of character classes and their tags, labelled by the base patterns.

    Whatever the number of stretches, DISGUISED_SHARE of the windows show spans in another writing
    and BARE_SHARE stretches without a span; the others show spans as they are.  Where one sort of
    stretches is missing, the other fills its place.
    """
    rng = np.random.default_rng(seed)
    known = [(t, base_spans(t)) for t in texts]
    spanned = [k for k in known if k[1]]
    wanted = min(wanted, 12 * len(known))
    bare = [k for k in known if not k[1]]
    n_disguised = round(DISGUISED_SHARE * wanted) if spanned else 0
    n_bare = (round(BARE_SHARE * wanted) if spanned else wanted) if bare else 0
    drawn = [(*bare[n % len(bare)], False) for n in range(n_bare)]
    drawn += [(*spanned[n % len(spanned)], n < n_disguised) for n in range(wanted - n_bare)]
    x, gold = [], []
    for text, spans, other in drawn:
        if other:
            parts, moved, at, shift = [], [], 0, 0
            sure = int(rng.integers(len(spans)))  # one span at least is disguised
            for n, (kind, s, e) in enumerate(sorted(spans, key=lambda v: v[1])):
                if s < at:
                    continue
                change = n == sure or rng.random() < 0.5
                new = disguised(kind, text[s:e], rng) if change else text[s:e]
                parts += [text[at:s], new]
                moved.append((kind, s + shift, s + shift + len(new)))
                shift += len(new) - (e - s)
                at = e
            text = "".join([*parts, text[at:]])
            spans = moved
        last = max(0, len(text) - WIDTH)
        start = int(rng.integers(0, last + 1))
        if spans:  # the window holds one of the spans, where it fits
            _, s, e = spans[int(rng.integers(len(spans)))]
            low, high = min(max(0, e - WIDTH), last), min(s, last)
            start = int(rng.integers(min(low, high), high + 1))
        piece = text[start : start + WIDTH].ljust(WIDTH)
        x.append(codes(piece))
        gold.append(np.pad(tags(spans, start, min(start + WIDTH, len(text))),
                           (0, max(0, WIDTH - len(text) + start))))
    return np.array(x).reshape(-1, WIDTH), np.array(gold).reshape(-1, WIDTH)


def train(docs: DataFrame, sample: int = SAMPLE, windows: int = WINDOWS) -> Network | None:
    """The network, from the stretches with digits or at signs of a bounded sample of documents.

    The first `sample` documents by a hash of the id, at most `windows` stretches of them, up to half
    of these with a span and the rest without, labelled by the base patterns; what one sort lacks the
    other fills.  None where the sample has no such stretch.
    """
    rows = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    ids = rows.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id").limit(sample)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [
                t[s : min(e, s + 3 * WIDTH)]
                for t in b.column("text").to_pylist() for s, e in stretches(t)[:4]
            ]
            yield pa.RecordBatch.from_pydict(
                {"piece": pa.array(out, pa.string()), "held": pa.array([bool(base_spans(t)) for t in out], pa.bool_())}
            )

    chosen = rows.select("doc_id", "text").join(F.broadcast(ids.distinct()), "doc_id").select("text")
    # at most 4 * sample stretches; the same order wherever the rows come from
    pieces = settled(chosen.mapInArrow(cut, "piece string, held boolean"), "stretches")
    first = [
        [r["piece"] for r in part.orderBy(F.xxhash64("piece"), "piece").limit(windows).collect()]
        for part in (pieces.filter("held"), pieces.filter("NOT held"))
    ]
    n = min(len(first[0]), max(windows // 2, windows - len(first[1])))
    held, bare = first[0][:n], first[1][: windows - n]
    # dealt in turn, so that any number of them taken from the front holds both sorts
    marked = [(k / len(part), t) for part in (held, bare) for k, t in enumerate(part)]
    texts = [t for _, t in sorted(marked)]
    if not texts:
        return None
    return fit(*examples(texts, windows))


# ------------------------------------------------------------------ use


def _plausible(kind: str, text: str) -> bool:
    digits = len(DIGIT.findall(text))
    if kind == "email":
        return "@" in text and "." in text and len(text) >= 6
    if kind == "ip":
        return 4 <= digits <= 12 and len(re.findall(r"[0-9]+", text)) == 4
    return 13 <= digits <= 19 if kind == "card" else 9 <= digits <= 15


def read_spans(tag: np.ndarray, text: str, start: int) -> list[Span]:
    """Spans of a decoded stretch, without blanks at their ends."""
    out: list[Span] = []
    at = 0
    while at < len(tag):
        if tag[at] == 0:
            at += 1
            continue
        kind = (tag[at] - 1) // 2
        end = at + 1
        while end < len(tag) and tag[end] == 2 + 2 * kind:
            end += 1
        piece = text[start + at : start + end]
        s = start + at + len(piece) - len(piece.lstrip())
        e = start + end - (len(piece) - len(piece.rstrip()))
        if s < e and _plausible(KINDS[kind], text[s:e]):
            out.append((KINDS[kind], s, e))
        at = end
    return out


def network_spans(net: Network, texts: list[str]) -> list[list[Span]]:
    """Spans the network finds in each text.

    Every stretch is read in windows that overlap by half.  Where two windows read a character, their
    tag scores are averaged, the more central reading weighing more; then one path of tags is
    decoded over the whole stretch, so no window's edge decides a span.
    """
    where = [(n, s, e) for n, t in enumerate(texts) for s, e in stretches(t)]
    out: list[list[Span]] = [[] for _ in texts]
    half = WIDTH // 2
    weight = np.minimum(np.arange(1, WIDTH + 1), np.arange(WIDTH, 0, -1)).astype(np.float32)
    where.sort(key=lambda v: v[2] - v[1])
    at = 0
    while at < len(where):
        group, cells = [], 0
        while at < len(where) and len(group) < 256 and (
            not group or (len(group) + 1) * (where[at][2] - where[at][1]) <= 1 << 16
        ):
            group.append(where[at])
            at += 1
        sizes = np.array([e - s for _, s, e in group])
        longest = int(sizes.max())
        views = [(k, b) for k, size in enumerate(sizes) for b in range(0, max(1, size - half), half)]
        total = np.zeros((longest + WIDTH, len(group), TAGS), np.float32)
        seen = np.zeros((longest + WIDTH, len(group)), np.float32)
        stretch = [codes(texts[n][s:e]) for n, s, e in group]
        blank = CLASSES[" "]
        for cells in range(0, len(views), 512):
            part = views[cells : cells + 512]
            x = np.full((len(part), WIDTH), blank, np.int32)
            for i, (k, b) in enumerate(part):
                piece = stretch[k][b : b + WIDTH]
                x[i, : len(piece)] = piece
            scores, _ = net.scores(x)
            for i, (k, b) in enumerate(part):
                total[b : b + WIDTH, k] += scores[:, i] * weight[:, None]
                seen[b : b + WIDTH, k] += weight
        mean = total[:longest] / np.maximum(seen[:longest], 1e-9)[:, :, None]
        tag = viterbi(mean, net.p["moves"], sizes)
        for k, (n, s, _) in enumerate(group):
            out[n] += read_spans(tag[: sizes[k], k], texts[n], s)
    return out


def find(net: Network | None, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans of each text, and the spans the network adds: those that touch no base span."""
    base = [base_spans(t) for t in texts]
    if net is None:
        return [(b, []) for b in base]
    more = network_spans(net, texts)
    return [
        (b, [x for x in m if not any(x[1] < e and s < x[2] for _, s, e in b)])
        for b, m in zip(base, more, strict=True)
    ]


def detect(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of base spans per kind, base_sha256, spans and n_added of each document.

    Base spans are those of the base patterns in the whole text; `spans` lists them and those the
    network adds.  Offsets count code points.  NULL text is empty and has no spans.  Rows that repeat
    an id give a row each.  An empty table gives no rows.  Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                found = find(shared.value, [t or "" for t in b.column("text").to_pylist()])
                counts = [[sum(s[0] == k for s in base) for base, _ in found] for k in KINDS]
                digest = [hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts),
                        pa.array(digest), pa.array([listed([*x, *y]) for x, y in found], pa.string()),
                        pa.array([len(y) for _, y in found], pa.int64()),
                    ],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
                )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(
        mark, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long"
    )


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s < at:
            at = max(at, e)
            continue
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, net: Network | None) -> DataFrame:
    """The documents with personal data replaced; n_chars, where there is one, follows the text.

    NULL texts stay NULL.  Other columns and repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    names = docs.columns
    place = names.index("text")

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                texts = b.column(place).to_pylist()
                found = find(shared.value, [t or "" for t in texts])
                new = [
                    t if t is None or not (x or y) else masked(t, [*x, *y])
                    for t, (x, y) in zip(texts, found, strict=True)
                ]
                columns = list(b.columns)
                columns[place] = pa.array(new, pa.string())
                if "n_chars" in names:
                    at_n = names.index("n_chars")
                    old = columns[at_n].to_pylist()
                    columns[at_n] = pa.array(
                        [n if a == t else len(a) for n, a, t in zip(old, new, texts, strict=True)],
                        columns[at_n].type,
                    )
                yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return docs.mapInArrow(change, docs.schema)
