"""Value-pattern analysis: mask census, outliers, segments, recurring substrings."""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.functions.columns import col, text_of
from tablewright.functions.masks import compact_display, mask, mask_regex
from tablewright.operators.distributed import settle

register_pickle_by_value(sys.modules[__name__])  # workers need no install

DOMINANT_SHARE = 0.4
NORMAL_SHARE = 0.15
MERGE_RATIO = 0.8
SUFFIXES_AT_ONCE = 300_000  # distinct suffixes a task counts before it hands them on


def _mask_counts(df: DataFrame, column: str) -> DataFrame:
    """(mode, pat, c, example): both kinds of mask in one pass over the column."""
    text = df.where(col(column).isNotNull()).select(text_of(df, column).alias("ex"))
    modes = F.explode(
        F.array(
            F.struct(F.lit("exact").alias("mode"), mask(F.col("ex")).alias("pat")),
            F.struct(F.lit("compact").alias("mode"), mask(F.col("ex"), True).alias("pat")),
        )
    )
    return (
        text.select(modes.alias("m"), "ex")
        .groupBy(F.col("m.mode").alias("mode"), F.col("m.pat").alias("pat"))
        .agg(F.count(F.lit(1)).alias("c"), F.min("ex").alias("example"))
    )


def top_per_group(df: DataFrame, group: str, order: list[Column], n: int, rank: str) -> DataFrame:
    """First n rows per group; Spark keeps only n per group and task before the shuffle."""
    ordered = Window.partitionBy(col(group)).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(ordered)).where(col(rank) <= n)


def mask_census(df: DataFrame, column: str, limit: int = 30) -> DataFrame:
    """Most frequent masks per mode with count, smallest example, regex and display form."""
    counts = _mask_counts(df, column)
    top = top_per_group(counts, "mode", [F.col("c").desc(), F.col("pat")], limit, "rank")
    exact = F.col("mode") == "exact"
    return top.select(
        "mode",
        F.col("rank").cast("bigint").alias("rank"),
        "pat",
        "c",
        "example",
        F.when(exact, mask_regex(F.col("pat")))
        .otherwise(mask_regex(F.col("pat"), True))
        .alias("regex"),
        F.when(exact, F.col("pat")).otherwise(compact_display(F.col("pat"))).alias("display"),
    )


def mask_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: total, nulls, distinct exact masks, distinct compact masks."""
    text = text_of(df, column)
    reduced = (
        df.select(mask(text).alias("e"))
        .groupBy("e")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("k", F.regexp_replace("e", r"(A)A+|(a)a+|(9)9+", "$1$2$3"))
        .groupBy("k")
        .agg(F.sum("n").alias("n"), F.count("e").alias("e"))
    )
    return reduced.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum("e"), F.lit(0)).alias("distinct_exact"),
        F.count("k").alias("distinct_compact"),
    )


def pattern_outliers(census: DataFrame, non_null: int | Column) -> DataFrame:
    """Per mode: is there a dominant mask, which masks are normal, how many values are not.

    Works on the census, so on at most 30 rows per mode.
    """
    n = F.lit(non_null) if isinstance(non_null, int) else non_null
    normal = F.col("c") / n >= NORMAL_SHARE
    masks = F.sort_array(
        F.collect_list(F.when(normal, F.struct((-F.col("c")).alias("c"), F.col("pat"))))
    )
    verdict = census.groupBy("mode").agg(
        (F.max("c") / F.max(n)).alias("top_share"),
        F.sum(F.when(normal, F.col("c"))).alias("normal_count"),
        masks["pat"].alias("masks"),
        F.max(n).alias("non_null"),
    )
    has = F.col("top_share") >= DOMINANT_SHARE
    outliers = F.greatest(F.lit(0), F.col("non_null") - F.col("normal_count"))
    return verdict.select(
        "mode",
        has.alias("has_dominant"),
        "top_share",
        F.when(has, F.col("masks")).otherwise(F.array().cast("array<string>")).alias("normal"),
        F.when(has, outliers).otherwise(F.lit(0)).cast("bigint").alias("outlier_count"),
        F.when(has, outliers / F.col("non_null")).otherwise(F.lit(0.0)).alias("outlier_share"),
    )


def dominant_masks(df: DataFrame, column: str, compact: bool = False) -> list[str]:
    """Masks of normal values, empty without a dominant one (runs a job, at most 30 masks)."""
    text = text_of(df, column)
    counts = (
        df.where(col(column).isNotNull())
        .groupBy(mask(text, compact).alias("pat"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    total = counts.agg(F.sum("c")).scalar()
    rows = (
        counts.withColumn("share", F.col("c") / total)
        .orderBy(F.col("c").desc(), "pat")
        .limit(30)
        .collect()
    )
    if not rows or rows[0]["share"] < DOMINANT_SHARE:
        return []
    return [r["pat"] for r in rows if r["share"] >= NORMAL_SHARE]


def dominant_masks_of(df: DataFrame, filled: dict[str, int]) -> dict[str, list[str]]:
    """dominant_masks of several columns from one census; `filled` holds their non-null rows."""
    names = list(filled)
    if not names:
        return {}
    cells = F.array(
        *[F.struct(F.lit(i).alias("i"), mask(text_of(df, n)).alias("pat")) for i, n in enumerate(names)]
    )
    counts = (
        df.select(F.inline(cells)).where("pat IS NOT NULL")
        .groupBy("i", "pat").agg(F.count(F.lit(1)).alias("c"))
    )
    top = top_per_group(counts, "i", [F.col("c").desc(), F.col("pat")], 30, "r")
    out: dict[str, list[str]] = {n: [] for n in names}
    first: dict[str, float] = {}
    for r in top.orderBy("i", "r").collect():
        name = names[r["i"]]
        share = r["c"] / filled[name]
        if first.setdefault(name, share) >= DOMINANT_SHARE and share >= NORMAL_SHARE:
            out[name].append(r["pat"])
    return out


def outlier_rows(
    df: DataFrame, column: str, normal: list[str], compact: bool = False, limit: int | None = 50
) -> DataFrame:
    """(value, mask) of the values whose mask is not normal; `limit` None gives all."""
    text = text_of(df, column)
    shape = mask(text, compact)
    if not normal:
        return df.select(text.alias("value"), shape.alias("mask")).where(F.lit(False))
    odd = df.where(col(column).isNotNull()).select(text.alias("value"), shape.alias("mask"))
    odd = odd.where(~F.col("mask").isin(normal))
    return odd.orderBy("value", "mask").limit(limit) if limit else odd


def segments(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """(kind, value, c, example): prefixes, suffixes and tokens that occur at least twice.

    `limit` asks for the most frequent of each kind only.
    """
    v = F.col("ex")
    words = F.split(F.regexp_replace(v, "([a-z])([A-Z])", "$1 $2"), r"[^\p{Alnum}]+")

    def piece(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    pieces = F.concat(
        F.array(
            piece("prefix", F.regexp_extract(v, r"^\p{Alnum}+[^\p{Alnum}]", 0)),
            piece("suffix", F.regexp_extract(v, r"[^\p{Alnum}]\p{Alnum}+\z", 0)),
        ),
        F.transform(
            F.filter(words, lambda w: F.char_length(w) >= 2), lambda w: piece("token", w)
        ),
    )
    counted = (
        df.where(col(column).isNotNull())
        .select(text_of(df, column).alias("ex"))
        .select(F.explode(pieces).alias("p"), "ex")
        .where(F.col("p.value") != "")
        .groupBy(F.col("p.kind").alias("kind"), F.col("p.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("c"), F.min("ex").alias("example"))
        .where(F.col("c") >= 2)
    )
    if limit is None:
        return counted
    top = top_per_group(counted, "kind", [F.col("c").desc(), F.col("value")], limit, "rank")
    return top.drop("rank")


def _suffixes(batches: Iterator[pa.RecordBatch], min_len: int, max_len: int) -> Iterator[pa.RecordBatch]:
    """(suffix, seen, n): beginnings of the suffixes of values, `max_len` long, and how much of each
    its value has held before; a value counts for the longer beginnings only."""
    found: Counter = Counter()

    def flush() -> pa.RecordBatch:
        texts, seen = zip(*found) if found else ((), ())
        batch = pa.RecordBatch.from_pydict(
            {
                "suffix": pa.array(texts, pa.string()),
                "seen": pa.array(seen, pa.int32()),
                "n": pa.array(list(found.values()), pa.int64()),
            }
        )
        found.clear()
        return batch

    for batch in batches:
        for text in batch.column(0).to_pylist():
            places: dict[str, list[int]] = {}
            for i in range(len(text) - min_len + 1):
                suffix = text[i : i + max_len]
                earlier = places.setdefault(suffix[:min_len], [])
                held = 0
                for j in earlier:
                    other = text[j : j + max_len]
                    if other.startswith(suffix):
                        held = len(suffix)
                        break
                    same = min_len
                    while same < len(other) and other[same] == suffix[same]:
                        same += 1
                    held = max(held, same)
                if held < len(suffix):
                    earlier.append(i)
                    found[suffix, held] += 1
            if len(found) > SUFFIXES_AT_ONCE:
                yield flush()
    yield flush()


def _beginnings(
    batches: Iterator[pa.RecordBatch], min_len: int, max_len: int, least: int
) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes to (gram, c): values per beginning of them.

    Equal beginnings lie together.  Those that reach the border of a batch may go on behind it and are
    all kept; of the others, those of `least` values.
    """
    for batch in batches:
        texts = batch["suffix"].to_pylist()
        if not texts:
            continue
        codes = np.array(texts, f"<U{max_len}").view("<u4").reshape(len(texts), max_len)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        differ = codes[1:] != codes[:-1]
        shared = np.where(differ.any(1), differ.argmax(1), max_len)  # with the one before
        shared = np.minimum(np.append(0, shared), np.append(0, np.minimum(lens[1:], lens[:-1])))
        n, seen = batch["n"].to_numpy(), batch["seen"].to_numpy()
        grams, counts = [], []
        for size in range(min_len, max_len + 1):
            starts = np.flatnonzero(shared < size)
            sums = np.add.reduceat(np.where((lens >= size) & (seen < size), n, 0), starts)
            keep = sums >= least
            keep[[0, -1]] = sums[[0, -1]] > 0
            keep &= lens[starts] >= size
            grams += [texts[i][:size] for i in starts[keep].tolist()]
            counts.append(sums[keep])
        yield pa.RecordBatch.from_pydict(
            {"gram": pa.array(grams, pa.string()), "c": pa.array(np.concatenate(counts), pa.int64())}
        )


def substring_counts(
    df: DataFrame, column: str, min_len: int = 3, max_len: int = 24, min_share: float = 0.1
) -> DataFrame:
    """(gram, c): substrings of whole values that enough distinct values hold.

    One job finds how many values are enough.  Then all suffixes of the distinct values are sorted over
    the cluster, so that equal substrings of every length are neighbours and are counted in one pass.
    """
    values = df.where(col(column).isNotNull()).select(text_of(df, column).alias("v"))
    rows = values.agg(F.count(F.lit(1))).first()[0]
    least = max(2, math.ceil(rows * min_share))
    distinct = values.distinct().where(F.char_length("v") >= min_len)
    suffixes = (
        distinct.mapInArrow(
            lambda batches: _suffixes(batches, min_len, max_len), "suffix string, seen int, n bigint"
        )
        .groupBy("suffix", "seen")
        .agg(F.sum("n").alias("n"))
    )
    ordered = suffixes.repartitionByRange("suffix").sortWithinPartitions("suffix")
    grams = ordered.mapInArrow(
        lambda batches: _beginnings(batches, min_len, max_len, least), "gram string, c bigint"
    )
    return grams.groupBy("gram").agg(F.sum("c").alias("c")).where(F.col("c") >= least)


def maximal(grams: list[tuple[str, int]], ratio: float = MERGE_RATIO) -> list[tuple[str, int]]:
    """Drop a gram when a kept longer one holds it with nearly all of its count."""
    kept: list[tuple[str, int]] = []
    inside: dict[str, int] = {}  # highest count of a kept gram that holds this shorter one
    for gram, c in sorted(grams, key=lambda g: (-len(g[0]), -g[1], g[0])):
        if inside.get(gram, 0) >= c * ratio and gram in inside:
            continue
        kept.append((gram, c))
        for size in range(1, len(gram)):
            for i in range(len(gram) - size + 1):
                part = gram[i : i + size]
                inside[part] = max(c, inside.get(part, 0))
    return sorted(kept, key=lambda g: (-g[1], -len(g[0]), g[0]))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = [g for b in batches for g in zip(b["gram"].to_pylist(), b["c"].to_pylist())]
    kept = maximal(grams)
    yield pa.RecordBatch.from_pydict(
        {
            "value": pa.array([g for g, _ in kept], pa.string()),
            "c": pa.array([c for _, c in kept], pa.int64()),
        }
    )


def substrings(
    df: DataFrame,
    column: str,
    min_len: int = 3,
    max_len: int = 24,
    min_share: float = 0.1,
    limit: int | None = None,
) -> DataFrame:
    """(value, c, example): recurring motifs, fragments folded into the longest one.

    Folding goes from long to short over all motifs and is one task; there are at most (mean length /
    share) of a length, however many rows.  The example is the smallest value that holds the motif;
    `limit` asks for the most frequent motifs only.
    """
    grams = substring_counts(df, column, min_len, max_len, min_share)
    kept = grams.repartition(1).mapInArrow(_folded, "value string, c bigint")
    if limit:
        kept = kept.orderBy(F.desc("c"), F.desc(F.char_length("value")), "value").limit(limit)
    kept = settle(kept)
    v = df.where(col(column).isNotNull()).select(text_of(df, column).alias("v")).distinct()
    sizes = kept.agg(F.sort_array(F.collect_set(F.char_length("value")))).first()[0]
    last = F.char_length("v") - F.col("size") + 1
    cut = (
        v.select("v", F.explode(F.array(*map(F.lit, sizes))).alias("size"))
        .where(last >= 1)
        .select("v", "size", F.explode(F.sequence(F.lit(1), last)).alias("at"))
        .select("v", F.substr("v", F.col("at"), F.col("size")).alias("value"))
    ) if sizes else v.select("v", F.lit("").alias("value")).limit(0)
    examples = cut.join(kept.select("value"), "value").groupBy("value").agg(F.min("v").alias("example"))
    found = kept.join(examples, "value", "left").select("value", "c", "example")
    return found.orderBy(F.desc("c"), F.desc(F.char_length("value")), "value")


def match_records(df: DataFrame, column: str, kind: str, value: str) -> DataFrame:
    """Rows behind a segment: prefix, suffix, or any place for tokens and substrings."""
    text = text_of(df, column)
    if kind == "prefix":
        return df.where(text.startswith(value))
    if kind == "suffix":
        return df.where(text.endswith(value))
    return df.where(text.contains(value))
