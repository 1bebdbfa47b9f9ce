"""The prefix trie of conversations: how many start alike, and what sharing their starts saves.

Turns are known by a 128-bit digest of role and text.  Equal sequences become one item with a count,
items are sorted over the cluster, and every range shard is put into a ternary search tree over its own
dense turn ids.  Nodes that lie wholly inside a shard are finished there; those on the way to its first
and last item may go on in a neighbour and are merged afterwards.

Memory is bounded whatever the input: a shard holds at most TURNS turns, a sequence is cut into bands of
BAND turns (the root of a band is a node of the band above), ids of equal sequences go through in blocks,
and merging streams over the boundary nodes with a stack as deep as a band.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.common import settled
from tablewright.operators.distributed import lookup_join, running_sum

BAND = 256  # turns of a sequence that one tree holds
TURNS = 200_000  # turns in the tree of a shard
IDS = 4096  # ids of equal sequences in a row
SHARED = 5  # conversations that start like the first of them
HEADS = 9  # a start has fewer turns than this
NONE_END = hashlib.sha256(b"").hexdigest()

_COUNTS = "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


# ---------------------------------------------------------------- sequences


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_key, n_bytes): turns numbered from 1 in the order of `turn`, NULL first.

    NULL roles and texts count as empty, rows without conv_id belong to no conversation, turns of the
    same number follow each other in the order of role and text digest.  A conversation that holds much
    of the table is cut into ranges like any other.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").isNotNull().alias("known"),
        "turn",
        F.unhex(F.md5(told.cast("binary"))).alias("turn_key"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    order = ["known", "turn", "turn_key"]
    return running_sum(turns, F.lit(1).cast("long"), order, "pos", ["conv_id"]).drop("known", "turn")


def shared_heads(turns: DataFrame) -> DataFrame:
    """Sequences in which conversation c begins like conversation c - c % 5.

    c takes the first h turns of that one (all if it has fewer, none if there is no such conversation),
    then its own turns after its first h; h = crc32(c as text) % 9.  Returns (conv_id, pos, turn_key,
    n_bytes); every conversation has a row with pos 0 and no turn, so turnless ones stay known.
    """
    turns = settled(turns, "turns")
    drawn = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    heads = (
        turns.where(F.col("pos") < HEADS)
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "turn_key", "n_bytes"))).alias("turns"))
        .select(F.col("conv_id").alias("first"), "turns")
    )
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))
    convs = sizes.withColumns({"h": drawn, "first": F.col("conv_id") - F.col("conv_id") % SHARED})
    convs = convs.join(heads, "first", "left")
    taken = F.filter(F.coalesce("turns", F.array()), lambda t: t["pos"] <= F.col("h"))
    convs = settled(
        convs.select("conv_id", "n_turns", "h", taken.alias("head")).withColumn("k", F.size("head")),
        "heads",
    )
    start = F.concat(
        F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("turn_key"),
                         F.lit(0).cast("long").alias("n_bytes"))),
        "head",
    )
    starts = convs.select("conv_id", F.explode(start).alias("t")).select("conv_id", "t.*")
    own = lookup_join(turns, ["conv_id"], convs.select("conv_id", "h", "k", "n_turns"), "n_turns")
    own = own.where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("k")).cast("long").alias("pos"), "turn_key", "n_bytes"
    )
    return starts.unionByName(own)


def _items(turns: DataFrame, band: int) -> DataFrame:
    """(conv_id, band, seq, sizes): each sequence in bands; one more where it ends with a full band."""
    pos = F.col("pos")
    here = F.struct(
        F.when(pos == 0, 0).otherwise(F.floor((pos - 1) / band)).cast("int").alias("band"),
        F.when(pos == 0, 0).otherwise((pos - 1) % band + 1).cast("int").alias("at"),
        F.hex("turn_key").alias("turn_key"),
        F.col("n_bytes"),
    )
    after = F.struct(
        F.floor(pos / band).cast("int").alias("band"),
        F.lit(0).alias("at"),
        F.lit(None).cast("string").alias("turn_key"),
        F.lit(0).cast("long").alias("n_bytes"),
    )
    places = F.when((pos > 0) & (pos % band == 0), F.array(here, after)).otherwise(F.array(here))
    rows = turns.select("conv_id", F.explode(places).alias("p")).select("conv_id", "p.*")
    cells = F.sort_array(F.collect_list(F.struct("at", "turn_key", "n_bytes")))
    items = rows.groupBy("conv_id", "band").agg(F.filter(cells, lambda t: t["at"] > 0).alias("t"))
    return items.select(
        "conv_id",
        "band",
        F.unhex(F.array_join(F.transform("t", lambda t: t["turn_key"]), "")).alias("seq"),
        F.transform("t", lambda t: t["n_bytes"]).alias("sizes"),
    )


def _rooted(items: DataFrame) -> DataFrame:
    """Adds `root`, a digest of all turns before the band; rows of one conversation come in order."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, root = None, b""
        for batch in batches:
            roots = []
            for conv, seq in zip(batch["conv_id"].to_pylist(), batch["seq"].to_pylist()):
                if conv != last:
                    last, root = conv, b""
                roots.append(root)
                root = hashlib.md5(root + seq).digest()
            yield batch.append_column("root", pa.array(roots, pa.binary()))

    many = items.where("band > 0").select("conv_id").distinct()
    one = items.join(many, "conv_id", "left_anti").withColumn("root", F.lit(b""))
    long = items.join(many, "conv_id", "left_semi").repartition("conv_id")
    long = long.sortWithinPartitions("conv_id", "band")
    schema = "conv_id long, band int, seq binary, sizes array<long>, root binary"
    return one.unionByName(long.mapInArrow(chain, schema))


# ---------------------------------------------------------------- equal sequences


_BLOCK = "root binary, seq binary, sizes array<long>, first long, n long, ids string"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (root, seq, conv_id) to rows of up to IDS conversations with one sequence."""
    schema = pa.schema([("root", pa.binary()), ("seq", pa.binary()), ("sizes", pa.list_(pa.int64())),
                        ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])
    out: list[tuple] = []
    now, ids = None, []

    def close() -> None:
        if ids:
            out.append((*now, ids[0], len(ids), ",".join(map(str, ids))))
            ids.clear()

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema
        )
        out.clear()
        return batch

    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("root", "seq", "sizes", "conv_id")]
        for root, seq, sizes, conv in zip(*columns):
            if now is None or seq != now[1] or root != now[0] or len(ids) == IDS:
                close()
                now = (root, seq, sizes)
            ids.append(conv)
        if len(out) >= IDS:
            yield flush()
    close()
    if out:
        yield flush()


# ---------------------------------------------------------------- ternary search trees


class Tree:
    """A ternary search tree over sequences of dense turn ids; node 0 is the textless root."""

    def __init__(self) -> None:
        self.key, self.low, self.equal, self.high = [-1], [-1], [-1], [-1]
        self.parent, self.depth, self.size = [-1], [0], [0]

    def _add(self, key: int, parent: int, size: int) -> int:
        for column, value in ((self.key, key), (self.low, -1), (self.equal, -1), (self.high, -1),
                              (self.parent, parent), (self.depth, self.depth[parent] + 1),
                              (self.size, size)):
            column.append(value)
        return len(self.key) - 1

    def insert(self, ids: list[int], sizes: list[int]) -> int:
        """The node of a sequence."""
        key, low, equal, high = self.key, self.low, self.equal, self.high
        at = 0
        for i, size in zip(ids, sizes):
            v = equal[at]
            if v < 0:
                equal[at] = at = self._add(i, at, size)
                continue
            while key[v] != i:
                side = low if i < key[v] else high
                if side[v] < 0:
                    side[v] = self._add(i, at, size)
                v = side[v]
            at = v
        return at


def median_order(n: int) -> Iterator[int]:
    """0..n-1, the middle of each range before its halves, so that sorted items build balanced trees."""
    open_ranges = deque([(0, n)])
    while open_ranges:
        a, b = open_ranges.popleft()
        if a < b:
            mid = (a + b) // 2
            yield mid
            open_ranges.append((a, mid))
            open_ranges.append((mid + 1, b))


_NODE = (
    "root binary, shard binary, path binary, parent_key binary, turn_key binary, conv_id long, depth int, "
    f"parent_conv_id long, size long, {_COUNTS}"
)
_NODE_ARROW = pa.schema(
    [("root", pa.binary()), ("shard", pa.binary()), ("path", pa.binary()), ("parent_key", pa.binary()),
     ("turn_key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int32()),
     ("parent_conv_id", pa.int64()), ("size", pa.int64()), ("n_convs", pa.int64()),
     ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
     ("ends_sha256", pa.string())]
)


def path_key(root: bytes, path: bytes) -> bytes:
    return hashlib.md5(root + b"/" + path).digest()


def shard_nodes(root: bytes, items: list[dict]) -> pa.RecordBatch:
    """The nodes of sorted distinct sequences of one root.

    Nodes on the way to the first or last item have a `path` and hold what lies inside the shard only:
    children, leaves and savings of nodes that have a path themselves are left out.  All others are
    finished, but for parent_conv_id where the parent has a path (its key is in `parent_key`).
    """
    turns = np.frombuffer(b"".join(i["seq"] for i in items), "S16")
    known, ids = np.unique(turns, return_inverse=True)
    ids = ids.tolist()
    starts = np.cumsum([0, *(len(i["seq"]) // 16 for i in items)]).tolist()
    tree = Tree()
    at = [0] * len(items)
    for i in median_order(len(items)):
        at[i] = tree.insert(ids[starts[i] : starts[i + 1]], items[i]["sizes"])

    n = len(tree.key)
    none = 1 << 63
    count, low_id, ends = [0] * n, [none] * n, [NONE_END] * n
    kids, leaves, saved = [0] * n, [0] * n, [0] * n  # of what lies below
    for i, v in zip(items, at):
        count[v], low_id[v], ends[v] = i["n"], i["first"], i["ends_sha256"]
        kids[v], saved[v] = i["n_children"], i["saved_tokens"]
        leaves[v] = i["n_leaves"] if i["n_children"] else 0
    path: dict[int, bytes] = {}
    for k in (0, len(items) - 1):
        v, seq = at[k], items[k]["seq"]
        while v >= 0:
            path[v] = seq[: 16 * tree.depth[v]]
            v = tree.parent[v]

    # what a node and those beside it in its parent's search tree give to the parent; made after it,
    # they have larger numbers, so one walk backwards adds up everything
    give_n, give_id, give_kids = [0] * n, [none] * n, [0] * n
    give_leaves, give_saved = [0] * n, [0] * n
    for v in range(n - 1, -1, -1):
        down = tree.equal[v]
        if down >= 0:
            count[v] += give_n[down]
            low_id[v] = min(low_id[v], give_id[down])
            kids[v] += give_kids[down]
            leaves[v] += give_leaves[down]
            saved[v] += give_saved[down]
        inside = v not in path
        if inside:
            leaves[v] += kids[v] == 0
            saved[v] += (count[v] - 1) * tree.size[v]
        g = [count[v], low_id[v], int(inside), leaves[v] if inside else 0, saved[v] if inside else 0]
        for side in (tree.low[v], tree.high[v]):
            if side >= 0:
                g[0] += give_n[side]
                g[1] = min(g[1], give_id[side])
                g[2] += give_kids[side]
                g[3] += give_leaves[side]
                g[4] += give_saved[side]
        give_n[v], give_id[v], give_kids[v], give_leaves[v], give_saved[v] = g

    shard = path_key(root, items[0]["seq"])
    keys = {v: path_key(root, p) for v, p in path.items()}
    parents = tree.parent
    digests = known.tolist()
    columns = [
        [root] * n,
        [shard] * n,
        [path.get(v) for v in range(n)],
        [keys.get(parents[v]) if v not in path else None for v in range(n)],
        [digests[k].ljust(16, b"\0") if k >= 0 else None for k in tree.key],
        low_id,
        tree.depth,
        [None if v in path or parents[v] in path else low_id[parents[v]] for v in range(n)],
        tree.size, count, kids, leaves, saved, ends,
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, _NODE_ARROW)], schema=_NODE_ARROW
    )


def _shards(limit: int):
    """Blocks sorted by (root, seq, first) to the nodes of shards of up to `limit` turns."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        root, total, digest = None, 0, None

        def seal() -> None:
            if digest is not None and held[-1]["ends_sha256"] is None:
                held[-1]["ends_sha256"] = digest.hexdigest()

        for batch in batches:
            for row in batch.to_pylist():
                if held and held[-1]["seq"] == row["seq"] and root == row["root"]:
                    held[-1]["n"] += row["n"]
                    if digest is not None:
                        digest.update(b"," + row["ids"].encode())
                    continue
                if held:
                    seal()
                    if root != row["root"] or total >= limit:
                        yield shard_nodes(root, held)
                        held, total = [], 0
                root = row["root"]
                total += len(row["sizes"]) + 1
                # a full band ends below: its figures come from there
                digest = hashlib.sha256(row["ids"].encode()) if row["ends_sha256"] is None else None
                held.append(row)
        if held:
            seal()
            yield shard_nodes(root, held)

    return nodes


# ---------------------------------------------------------------- boundary nodes


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boundary nodes sorted by (root, path) to finished ones; holds the way to the node at hand."""
    stack: list[dict] = []
    out: list[dict] = []

    def pop() -> None:
        node = stack.pop()
        node["n_leaves"] += node["n_children"] == 0
        node["saved_tokens"] += (node["n_convs"] - 1) * node["size"]
        if stack:
            up = stack[-1]
            up["n_children"] += 1
            up["n_leaves"] += node["n_leaves"]
            up["saved_tokens"] += node["saved_tokens"]
            node["parent_conv_id"] = up["conv_id"]
        out.append(node)

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pylist(out, schema=_NODE_ARROW)
        out.clear()
        return batch

    for batch in batches:
        for row in batch.to_pylist():
            while stack and not (
                stack[-1]["root"] == row["root"] and row["path"].startswith(stack[-1]["path"])
            ):
                pop()
            stack.append(row)
        if out:
            yield flush()
    while stack:
        pop()
    if out:
        yield flush()


def _band_nodes(items: DataFrame, below: DataFrame | None, limit: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of one band, finished, and its roots (`path` empty) apart."""
    order = ["root", "seq", "conv_id"]
    blocks = items.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = blocks.select("root", "seq", "sizes", "conv_id").mapInArrow(_blocks, _BLOCK)
    if below is None:
        empty = {c: F.lit(0).cast("long") for c in ("n_children", "n_leaves", "saved_tokens")}
        blocks = blocks.withColumns({**empty, "ends_sha256": F.lit(None).cast("string")})
    else:
        key = F.unhex(F.md5(F.concat("root", "seq"))).alias("below")
        names = ["n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        below = below.select(F.col("root").alias("below"), *names)
        zero = {c: F.coalesce(c, F.lit(0)) for c in names[:3]}
        blocks = blocks.withColumn("below", key).join(below, "below", "left").drop("below")
        blocks = blocks.withColumns(zero)
    order = ["root", "seq", "first"]
    blocks = blocks.repartitionByRange("root", "seq").sortWithinPartitions(*order)
    nodes = settled(blocks.mapInArrow(_shards(limit), _NODE), "trie")
    edge = nodes.where("path IS NOT NULL")
    whole = edge.groupBy("root", "path").agg(
        F.lit(None).cast("binary").alias("shard"),
        F.lit(None).cast("binary").alias("parent_key"),
        F.max("turn_key").alias("turn_key"),
        F.min("conv_id").alias("conv_id"),
        F.max("depth").alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"),
        F.max("size").alias("size"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        # a sequence ends in one shard; the others say that none does
        F.coalesce(F.max(F.when(F.col("ends_sha256") != NONE_END, F.col("ends_sha256"))),
                   F.lit(NONE_END)).alias("ends_sha256"),
    )
    whole = whole.select(*_NODE_ARROW.names).repartition("root").sortWithinPartitions("root", "path")
    whole = settled(whole.mapInArrow(_merge, _NODE), "trie-edge")

    key = F.unhex(F.md5(F.concat("root", F.lit(b"/"), "path"))).alias("parent_key")
    ids = edge.select("shard", key).join(
        whole.select(key, F.col("conv_id").alias("found")), "parent_key"
    )  # the finished parents each shard needs, so that no shard's children meet in one task
    inner = nodes.where("path IS NULL").join(ids, ["shard", "parent_key"], "left")
    inner = inner.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "found"))
    inner = inner.select(*_NODE_ARROW.names)
    done = inner.unionByName(whole.where(F.length("path") > 0))
    return done, whole.where(F.length("path") == 0)


def prefix_trie(turns: DataFrame, band: int = BAND, limit: int = TURNS) -> DataFrame:
    """The trie of sequences (conv_id, pos, turn_key, n_bytes), as `turn_sequences` gives them.

    Positions are 1, 2, ... in each conversation; a row with pos 0 only says that there is one.  One row
    per node: conv_id (smallest member), depth, parent_conv_id, turn_key (its last turn), n_convs,
    n_children, n_leaves, saved_tokens (bytes of turns that need not be written again in the subtree),
    ends_sha256 (of the ids, ascending and comma-joined, of the members that end here).  No rows give no
    trie.  Sequences longer than `band` turns cost one more pass for each band.
    """
    starts = turns.where("pos = 1").select("conv_id").withColumns(
        {"pos": F.lit(0).cast("long"), "turn_key": F.lit(None).cast("binary"),
         "n_bytes": F.lit(0).cast("long")}
    )
    named = turns.where("pos = 0").select("conv_id").distinct()
    turns = turns.unionByName(starts.join(named, "conv_id", "left_anti"))
    items = settled(_items(turns, band), "trie-items")
    last = items.agg(F.max("band")).first()[0]
    if last:
        items = settled(_rooted(items), "trie-bands")
    else:
        items = items.withColumn("root", F.lit(b""))
    out, below = None, None
    for b in range(last or 0, -1, -1):
        nodes, below = _band_nodes(items.where(F.col("band") == b).drop("band"), below, limit)
        if b == 0:
            nodes = nodes.unionByName(below)
        nodes = nodes.withColumn("depth", (F.col("depth") + b * band).cast("long"))
        out = nodes if out is None else out.unionByName(nodes)
    return out.select(
        "conv_id", "depth", "parent_conv_id", "turn_key", "n_convs", "n_children", "n_leaves",
        "saved_tokens", "ends_sha256",
    )


def turn_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes with the role and text of their last turn (NULL at the root)."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    known = conversations.select(
        F.unhex(F.md5(told.cast("binary"))).alias("turn_key"), role.alias("role"), text.alias("text")
    ).dropDuplicates(["turn_key"])
    return nodes.join(known, "turn_key", "left")
