"""Mixing sources to target weights: whole copies first, then Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.llm.common import WORD, settled

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
BUCKETS = 4096  # of the sampling order, per source
USUAL_SIZE = 256.0
SEED = "mix-1:"
KEYS = ["doc_id", "source", "mark"]


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number between 0 and 1 that depends on the seed and the id only."""
    text = F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))
    whole = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")
    return (whole + 0.5) / float(2**52)


def order_value(size: Column, doc_id: Column, seed: str = SEED) -> Column:
    """Random odds over inclusion odds, brought into 0..1 in the same order.

    The inclusion odds grow with the root of the document's size.
    """
    u = draw(doc_id, seed)
    ratio = (u / (1 - u)) / F.sqrt(F.greatest(size, F.lit(1)) / USUAL_SIZE)
    return ratio / (1 + ratio)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            limit: int = LIMIT) -> DataFrame:
    """source, source_size and target of each source.

    Sources in order of their name, NULL last, take the weights in turn and divide share * all
    words.  A source stops at limit * its words and the rest goes to the others by weight: sources
    that stop are those of least limit per weight, so one pass in that order finds the level of the
    others.  The table has one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.array(*(F.lit(w) for w in weights))[(F.row_number().over(by_name) - 1) % len(weights)]
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = rows.withColumn("weight", weight).withColumn("most", F.col("source_size") * limit)
    by_room = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    total = share * F.sum("source_size").over(everything)
    before = F.coalesce(F.sum("most").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (total - before) / left)
    rows = rows.withColumn("full", F.col("level") * F.col("weight") >= F.col("most"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(level * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT,
    seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source and mark of each document.

    Every document of a source gets floor(target / source_size) whole copies.  For the words that
    are left, documents are ranked by random odds over inclusion odds (Pareto order sampling) and
    taken in that order as long as they fit; one more document, the one whose size comes nearest,
    fills the gap where that brings the sum nearer.  taken = copies * size.  `mark` is a hash of the
    text and, with doc_id and source, tells rows apart.

    The order is cut into buckets of its value, so that running sums need the bucket sums of a
    source and a window inside a bucket, never a window over a source.

    NULL text has size 0 and nothing is taken of it.  NULL sources are one source, NULL ids are
    drawn as the empty text.  Rows that repeat an id have equal draws and are ordered by size; equal
    rows are taken one by one.  An empty table gives no rows.  Other columns are ignored.
    """
    sizes = settled(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
            .alias("size"),
            F.xxhash64(text_col).alias("mark"),
        ).withColumn("value", order_value(F.col("size"), F.col("doc_id"), seed))
        .withColumn("bucket", F.floor(F.col("value") * BUCKETS).cast("int")),
        "sizes",
    )
    plan = targets(sizes, weights, share, limit)
    ratio = F.col("target") / F.nullif(F.col("source_size"), F.lit(0))
    plan = plan.withColumn("whole", F.coalesce(F.floor(ratio), F.lit(0)).cast("bigint"))
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    per_bucket = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    per_bucket = per_bucket.alias("a").join(plan.alias("b"), same).select("a.*", "source_size", "target", "whole", "rest")
    within = Window.partitionBy("source", "bucket").orderBy("value", "doc_id", "size", "mark")
    reached = F.col("before") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))
    ranked = (
        sizes.alias("a")
        .join(per_bucket.alias("b"), same & (F.col("a.bucket") == F.col("b.bucket")))
        .select("a.*", "before", "source_size", "target", "whole", "rest")
        .withColumn("place", F.row_number().over(within))
        .withColumn("chosen", (reached <= F.col("rest")) & (F.col("size") > 0))
    )
    ranked = settled(ranked, "ranked")
    got = ranked.groupBy("source").agg(
        F.first("rest").alias("rest"),
        F.sum(F.when(F.col("chosen"), F.col("size")).otherwise(0)).alias("got"),
    ).select("source", (F.col("rest") - F.col("got")).alias("gap"))
    spare = (
        ranked.filter(~F.col("chosen") & (F.col("size") > 0)).alias("a").join(got.alias("b"), same)
        .select("a.*", "gap").filter(F.abs(F.col("size") - F.col("gap")) < F.col("gap"))
        .groupBy("source")
        .agg(F.min(F.struct(
            F.abs(F.col("size") - F.col("gap")).alias("miss"), "value", "doc_id", "bucket", "place"
        )).alias("last"))
        .select("source", "last.bucket", "last.place")
    )
    closing = (
        ranked.alias("a").join(
            spare.alias("b"),
            same & (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.place") == F.col("b.place")),
            "left",
        )
    )
    copies = F.col("whole") + F.col("chosen").cast("bigint") + F.col("b.place").isNotNull().cast("bigint")
    return closing.select(
        "doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"),
        F.when(F.col("size") > 0, copies).otherwise(0).alias("copies"), "a.source", "mark",
    )


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it, with their own columns."""
    taken = (
        mix(docs, **how).groupBy(*KEYS).agg(F.sum("copies").alias("copies")).filter("copies > 0")
    )
    rows = docs.withColumn("mark", F.xxhash64("text")).dropDuplicates()
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in KEYS]
    alike = taken.alias("b")
    joined = rows.alias("a").join(alike, same[0] & same[1] & same[2])
    return joined.select("a.*", "copies").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    ).select(docs.columns)


ORACLE = r"""
    WITH d AS (
      SELECT doc_id, source,
             CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
             (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE)
               / 4503599627370496::DOUBLE AS u
      FROM documents
    ), e AS (
      SELECT *, (u / (1 - u)) / sqrt(greatest(size, 1) / 256::DOUBLE) AS q FROM d
    ), v AS (SELECT doc_id, source, size, q / (1 + q) AS value FROM e),
    s AS (
      SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS most,
             [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
      FROM v GROUP BY source
    ), l AS (
      SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
                 - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM s
    ), t AS (
      SELECT source, source_size,
             CASE WHEN level * weight >= most THEN most::DOUBLE
                  ELSE max(CASE WHEN level * weight < most THEN level END) OVER () * weight END AS target
      FROM l
    ), p AS (
      SELECT *, CAST(coalesce(floor(target / nullif(source_size, 0)), 0) AS BIGINT) AS whole FROM t
    ), r AS (
      SELECT v.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
             row_number() OVER o AS place, sum(size) OVER o AS reached
      FROM v JOIN p ON v.source IS NOT DISTINCT FROM p.source
      WINDOW o AS (PARTITION BY v.source ORDER BY v.value, v.doc_id, v.size
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    ), c AS (SELECT *, reached <= rest AND size > 0 AS chosen FROM r),
    g AS (
      SELECT *, rest - coalesce(sum(size) FILTER (chosen) OVER (PARTITION BY source), 0) AS gap FROM c
    ), z AS (
      SELECT source, place FROM g WHERE NOT chosen AND size > 0 AND abs(size - gap) < gap
      QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(size - gap), value, doc_id) = 1
    )
    SELECT g.doc_id, g.size, g.source_size, g.target,
           CAST(g.size * (g.whole + g.chosen::INT + (z.place IS NOT NULL)::INT) AS BIGINT) AS taken
    FROM g LEFT JOIN z ON g.source IS NOT DISTINCT FROM z.source AND g.place = z.place
"""
