"""Tournament tables: standings, reachable ranks, predictions, tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tablewright.functions.columns import col
from tablewright.operators.distributed import lookup_join, running_sum

# Points for a win and a draw; points of a prediction.
WIN, DRAW = 3, 1
EXACT, SAME_DIFFERENCE, SAME_TENDENCY = 4, 3, 2


def _sides(matches: DataFrame) -> DataFrame:
    """Two rows per match, one per team: grp, team, gf, ga (NULL while not played)."""
    played = F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull()

    def side(team: str, mine: str, theirs: str):
        return F.struct(
            col(team).alias("team"),
            F.when(played, col(mine)).alias("gf"),
            F.when(played, col(theirs)).alias("ga"),
        )

    both = F.array(
        side("home", "home_goals", "away_goals"), side("away", "away_goals", "home_goals")
    )
    return matches.select(col("grp"), F.inline(both))


def _points(matches: DataFrame) -> DataFrame:
    gf, ga = F.col("gf"), F.col("ga")
    return (
        _sides(matches)
        .groupBy("grp", "team")
        .agg(
            F.count("gf").alias("played"),
            F.count_if(gf > ga).alias("won"),
            F.count_if(gf == ga).alias("drawn"),
            F.count_if(gf < ga).alias("lost"),
            F.coalesce(F.sum("gf"), F.lit(0)).cast("bigint").alias("gf"),
            F.coalesce(F.sum("ga"), F.lit(0)).cast("bigint").alias("ga"),
            F.count_if(gf.isNull()).alias("remaining"),
        )
    )


def _standings(matches: DataFrame, teams: DataFrame) -> DataFrame:
    figures = ["played", "won", "drawn", "lost", "gf", "ga", "remaining"]
    both = teams.select("grp", "team", "seed").join(_points(matches), ["grp", "team"], "left")
    both = both.fillna(0, figures)
    return both.withColumn("points", F.col("won") * WIN + F.col("drawn") * DRAW).withColumn(
        "gd", F.col("gf") - F.col("ga")
    )


def league_table(matches: DataFrame, teams: DataFrame) -> DataFrame:
    """Standings per group: points, then goal difference, goals for, seed.

    matches: grp, home, away, home_goals, away_goals; teams: grp, team, seed.
    """
    table = _standings(matches, teams).withColumns(
        {"_p": -F.col("points"), "_d": -F.col("gd"), "_g": -F.col("gf")}
    )
    ranked = running_sum(
        table, F.lit(1).cast("bigint"), ["_p", "_d", "_g", "seed"], "rank", ["grp"]
    )
    return ranked.select(
        "grp", "team", "seed", "played", "won", "drawn", "lost", "gf", "ga", "gd", "points", "rank"
    )


def cross_group_ranking(table: DataFrame, place: int = 3, k: int = 8) -> DataFrame:
    """The best `k` of the teams that stand on `place` of their group."""
    order = [F.col("points").desc(), F.col("gd").desc(), F.col("gf").desc(), F.col("grp")]
    best = table.where(F.col("rank") == place).orderBy(*order).limit(k)
    position = F.row_number().over(Window.orderBy(*order))  # over k rows
    return best.select("grp", "team", "points", "gd", "gf", position.alias("position"))


def rank_bounds(matches: DataFrame, teams: DataFrame) -> DataFrame:
    """(grp, team, points, remaining, guaranteed, best, worst) on points alone.

    guaranteed is NULL while another team could still pass or be passed.
    Teams are counted per number of points, so no pair of teams is formed.
    """
    table = _standings(matches, teams).select("grp", "team", "points", "remaining")
    table = table.withColumn("most", F.col("points") + WIN * F.col("remaining"))

    def counts(value: str, at: str) -> DataFrame:
        """Per group and mark: how many teams have `value` there (0 where only asked for)."""
        have = table.select("grp", col(value).alias("mark"), F.lit(1).alias("n"))
        asked = table.select("grp", col(at).alias("mark"), F.lit(0).alias("n"))
        return have.unionByName(asked).groupBy("grp", "mark").agg(F.sum("n").alias("n"))

    by_mark = Window.partitionBy("grp")
    zero = F.lit(0).cast("bigint")
    down = by_mark.orderBy(F.col("mark").desc()).rowsBetween(Window.unboundedPreceding, -1)
    up = by_mark.orderBy("mark").rowsBetween(Window.unboundedPreceding, -1)
    above = counts("points", "most").select(
        "grp",
        F.col("mark").alias("most"),
        F.coalesce(F.sum("n").over(down), zero).alias("above"),
        F.sum("n").over(by_mark).alias("teams"),
    )
    below = counts("most", "points").select(
        "grp", F.col("mark").alias("points"), F.coalesce(F.sum("n").over(up), zero).alias("below")
    )
    known = table.join(above, ["grp", "most"]).join(below, ["grp", "points"])
    others = F.col("teams") - 1
    unclear = others - F.col("above") - F.col("below")
    return known.select(
        "grp",
        "team",
        "points",
        "remaining",
        F.when(unclear == 0, F.col("above") + 1).alias("guaranteed"),
        (F.col("above") + 1).alias("best"),
        (others - F.col("below") + 1).alias("worst"),
    )


def score_predictions(tips: DataFrame, results: DataFrame) -> DataFrame:
    """tips (player, match_id, home, away) with points against results (match_id, home, away)."""
    weights = tips.groupBy("match_id").agg(F.count(F.lit(1)).alias("_n"))
    known = results.select("match_id", col("home").alias("rh"), col("away").alias("ra"))
    lookup = known.join(weights, "match_id")
    joined = lookup_join(tips, ["match_id"], lookup, "_n")
    filled = [F.col(c).isNotNull() for c in ("home", "away", "rh", "ra")]
    tip, real = F.col("home") - F.col("away"), F.col("rh") - F.col("ra")
    points = (
        F.when((F.col("home") == F.col("rh")) & (F.col("away") == F.col("ra")), EXACT)
        .when((tip == real) & (tip != 0), SAME_DIFFERENCE)
        .when(F.signum(tip) == F.signum(real), SAME_TENDENCY)
        .otherwise(0)
    )
    counted = filled[0] & filled[1] & filled[2] & filled[3]
    return joined.where(counted).select("player", "match_id", points.alias("points"))


def leaderboard(scores: DataFrame, bonus: DataFrame | None = None) -> DataFrame:
    """(player, total, points, bonus, exact, counted), best first; bonus: player, bonus."""
    board = scores.groupBy("player").agg(
        F.sum("points").alias("points"),
        F.count_if(F.col("points") == EXACT).alias("exact"),
        F.count(F.lit(1)).alias("counted"),
    )
    if bonus is not None:
        extra = bonus.groupBy("player").agg(F.sum("bonus").alias("bonus"))
        board = board.join(extra, "player", "full_outer").fillna(0)
    else:
        board = board.withColumn("bonus", F.lit(0).cast("bigint"))
    total = (F.col("points") + F.col("bonus")).alias("total")
    out = board.select("player", total, "points", "bonus", "exact", "counted")
    return out.orderBy(F.col("total").desc(), F.col("exact").desc(), "player")


def tally(df: DataFrame, column: str, names: dict[str, str] | None = None) -> DataFrame:
    """(name, count), most first; `names` merges old names into new ones."""
    name = col(column)
    if names:
        pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        name = F.coalesce(F.element_at(pairs, name), name)
    counted = df.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.col("count").desc(), "name")
