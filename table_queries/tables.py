"""Queries over league tables, travel expenses and receipts derived from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from table_queries.registry import big, load, query, scratch, sql_draw
from tablewright.functions import rates
from tablewright.functions.hashing import draw
from tablewright.operators import expenses, league, receipts
from tablewright.operators.distributed import spread_rows

# ---------------------------------------------------------------- matches out of orders

_KEY = "CAST(o_orderkey AS VARCHAR)"
_MATCHES = (
    "matches AS (SELECT o_orderpriority AS grp, o_custkey % 50 AS home, (o_custkey % 50 + 1 + o_orderkey % 49) "
    f"% 50 AS away, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE {sql_draw(_KEY, 5, '', 'h')} END AS hg, "
    f"CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE {sql_draw(_KEY, 5, '', 'a')} END AS ag, o_orderkey AS id "
    "FROM orders)"
)
_SIDES = (
    "sides AS (SELECT grp, home AS team, hg AS gf, ag AS ga FROM matches UNION ALL SELECT grp, away, ag, hg "
    "FROM matches), pts AS (SELECT grp, team, count(gf) AS played, count(*) FILTER (WHERE gf > ga) AS won, "
    "count(*) FILTER (WHERE gf = ga) AS drawn, count(*) FILTER (WHERE gf < ga) AS lost, "
    "coalesce(sum(gf), 0)::BIGINT AS gf, coalesce(sum(ga), 0)::BIGINT AS ga, "
    "count(*) FILTER (WHERE gf IS NULL) AS remaining FROM sides GROUP BY ALL), stand AS (SELECT grp, "
    "'team ' || team AS team, team AS seed, played, won, drawn, lost, gf, ga, gf - ga AS gd, won * 3 + drawn AS "
    "points, remaining FROM pts), ranked AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY points DESC, "
    "gd DESC, gf DESC, seed) AS rank FROM stand)"
)
_LEAGUE = f"WITH {_MATCHES}, {_SIDES} "


def matches(spark: SparkSession, folder: str) -> DataFrame:
    """Every order is a match of two of 50 teams; one in ten is still to come."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey") % 50
    played = key % 10 != 0

    def goals(side: str):
        return F.when(played, draw(key.cast("string"), 5, "", side))

    away = (cust + 1 + key % 49) % 50
    return load(spark, folder, "orders").select(
        key.alias("match_id"),
        F.col("o_orderpriority").alias("grp"),
        F.concat(F.lit("team "), cust).alias("home"),
        F.concat(F.lit("team "), away).alias("away"),
        goals("h").alias("home_goals"),
        goals("a").alias("away_goals"),
    )


def teams(games: DataFrame) -> DataFrame:
    both = games.select("grp", F.explode(F.array("home", "away")).alias("team")).distinct()
    return both.withColumn("seed", F.substring("team", 6, 9).cast("bigint"))


@query(
    "p01_league_table",
    _LEAGUE + "SELECT grp, team, seed, played, won, drawn, lost, gf, ga, gd, points, rank FROM ranked",
)
def league_table(spark: SparkSession, folder: str) -> DataFrame:
    games = matches(spark, folder)
    return league.league_table(games, teams(games))


@query(
    "p02_cross_group_ranking",
    _LEAGUE + "SELECT grp, team, points, gd, gf, row_number() OVER (ORDER BY points DESC, gd DESC, gf DESC, grp) "
    "AS position FROM ranked WHERE rank = 3 ORDER BY position LIMIT 4",
)
def cross_group_ranking(spark: SparkSession, folder: str) -> DataFrame:
    games = matches(spark, folder)
    best = league.cross_group_ranking(league.league_table(games, teams(games)), place=3, k=4)
    return best.withColumn("position", F.col("position").cast("bigint"))


@query(
    "p03_rank_bounds",
    _LEAGUE
    + ", b AS (SELECT t.grp, t.team, t.points, t.remaining, (SELECT count(*) FROM ranked r WHERE r.grp = t.grp AND "
    "r.team <> t.team AND r.points > t.points + 3 * t.remaining) AS above, (SELECT count(*) FROM ranked r WHERE "
    "r.grp = t.grp AND r.team <> t.team AND r.points + 3 * r.remaining < t.points) AS below, (SELECT count(*) FROM "
    "ranked r WHERE r.grp = t.grp AND r.team <> t.team) AS others FROM ranked t) SELECT grp, team, points, remaining, "
    "CASE WHEN above + below = others THEN above + 1 END AS guaranteed, above + 1 AS best, others - below + 1 AS worst FROM b",
)
def rank_bounds(spark: SparkSession, folder: str) -> DataFrame:
    games = matches(spark, folder)
    return league.rank_bounds(games, teams(games))


_TIPS = (
    "tips AS (SELECT l_suppkey AS player, l_orderkey AS id, (l_linenumber + l_partkey) % 5 AS h, l_partkey % 4 AS a "
    "FROM lineitem), scored AS (SELECT player, CASE WHEN h = hg AND a = ag THEN 4 WHEN h - a = hg - ag AND h <> a THEN "
    "3 WHEN sign(h - a) = sign(hg - ag) THEN 2 ELSE 0 END AS p FROM tips JOIN matches USING (id) WHERE hg IS NOT NULL)"
)


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every lineitem is a supplier's tip on the match of its order."""
    part = F.col("l_partkey")
    tips = load(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("player"),
        F.col("l_orderkey").alias("match_id"),
        ((F.col("l_linenumber") + part) % 5).alias("home"),
        (part % 4).alias("away"),
    )
    results = matches(spark, folder).select(
        "match_id", F.col("home_goals").alias("home"), F.col("away_goals").alias("away")
    )
    return league.score_predictions(tips, results)


@query(
    "p04_score_predictions",
    f"WITH {_MATCHES}, {_TIPS} SELECT p AS points, count(*) AS tips FROM scored GROUP BY 1",
)
def score_predictions(spark: SparkSession, folder: str) -> DataFrame:
    counted = _scores(spark, folder).groupBy("points").agg(F.count(F.lit(1)).alias("tips"))
    return counted.withColumn("points", F.col("points").cast("bigint"))


@query(
    "p04_leaderboard",
    f"WITH {_MATCHES}, {_TIPS}, b AS (SELECT player, sum(p)::BIGINT AS points, count(*) FILTER (WHERE p = 4) AS exact, "
    "count(*) AS counted FROM scored GROUP BY 1) SELECT s_suppkey AS player, coalesce(points, 0) + s_suppkey % 3 * 4 AS "
    "total, coalesce(points, 0) AS points, s_suppkey % 3 * 4 AS bonus, coalesce(exact, 0) AS exact, coalesce(counted, 0) "
    "AS counted FROM supplier LEFT JOIN b ON player = s_suppkey",
)
def leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    bonus = load(spark, folder, "supplier").select(key.alias("player"), (key % 3 * 4).alias("bonus"))
    return league.leaderboard(_scores(spark, folder), bonus)


@query(
    "p05_tally",
    "SELECT CASE event_type WHEN 'view' THEN 'click' ELSE event_type END AS name, count(*) AS count FROM events GROUP BY 1",
)
def tally(spark: SparkSession, folder: str) -> DataFrame:
    return league.tally(load(spark, folder, "events"), "event_type", {"view": "click"})


# ---------------------------------------------------------------- trips out of orders

_COUNTRIES = ("DE", "FR", "CH-GEN", "US-NYC", "ZZ")
_TRIPS = (
    "trips AS (SELECT o_orderkey AS trip_id, ['DE', 'FR', 'CH-GEN', 'US-NYC', 'ZZ'][o_orderkey % 5 + 1] AS country, "
    "o_orderdate + to_hours(8 + o_orderkey % 5) AS s, o_orderdate + to_hours(8 + o_orderkey % 5 + 24 * (o_orderkey % 6) "
    "+ o_orderkey % 11) AS e FROM orders), days AS (SELECT trip_id, country, s, e, unnest(generate_series(s::DATE, "
    "e::DATE, INTERVAL 1 DAY))::DATE AS day FROM trips WHERE e > s), kinds AS (SELECT *, CASE WHEN s::DATE = e::DATE "
    "THEN CASE WHEN epoch(e) - epoch(s) > 28800 THEN 'single' ELSE 'none' END WHEN day = s::DATE THEN 'arrival' WHEN "
    "day = e::DATE THEN 'departure' ELSE 'full' END AS kind FROM days)"
)
_RATES = "rates(code, rate, name) AS (VALUES " + ", ".join(
    f"('{c}', {f}, '{n}')" for c, n, f, _ in rates.ABROAD
) + ")"
_DIEM = (
    _TRIPS + ", " + _RATES + ", priced AS (SELECT k.*, CASE WHEN country = 'DE' THEN 28 ELSE coalesce(rate, 0) "
    "END::DECIMAL(18,4) AS full_day, CASE WHEN country = 'DE' THEN 14::DECIMAL(18,2) ELSE round(coalesce(rate, 0)::"
    "DECIMAL(18,4) * 0.8, 2) END AS short_day, CASE WHEN day = s::DATE + 1 THEN (trip_id % 2) * 0.2 + (trip_id % 3 // 2) "
    "* 0.4 + 0.4 ELSE 0 END AS share FROM kinds k LEFT JOIN rates ON code = country), diem AS (SELECT trip_id, day, kind, "
    "CASE kind WHEN 'full' THEN full_day WHEN 'none' THEN 0 ELSE short_day END AS base, round(full_day * share, 2) AS "
    "reduction FROM priced), paid AS (SELECT *, greatest(0, round(base - reduction, 2)) AS amount FROM diem)"
)


def trips(spark: SparkSession, folder: str) -> DataFrame:
    """Every order is a trip of up to six days."""
    key, date = F.col("o_orderkey"), F.col("o_orderdate")
    country = F.element_at(F.array(*map(F.lit, _COUNTRIES)), (key % 5 + 1).cast("int"))
    hours = 8 + key % 5

    def after(n):
        return date + F.make_dt_interval(F.lit(0), n.cast("int"))

    return load(spark, folder, "orders").select(
        key.alias("trip_id"),
        country.alias("country"),
        after(hours).alias("start"),
        after(hours + 24 * (key % 6) + key % 11).alias("end"),
        F.col("o_orderpriority").alias("reason"),
        F.concat(F.lit('Kunde "'), "o_custkey", F.lit('"')).alias("place"),
    )


def meals(spark: SparkSession, folder: str) -> DataFrame:
    """Provided meals on the second day."""
    key = F.col("o_orderkey")
    second = F.date_add(F.to_date(F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (8 + key % 5).cast("int"))), 1)
    return load(spark, folder, "orders").select(
        key.alias("trip_id"),
        second.alias("day"),
        (key % 2 == 1).alias("breakfast"),
        (key % 3 == 2).alias("lunch"),
        F.lit(True).alias("dinner"),
    )


@query(
    "p06_trip_days",
    f"WITH {_TRIPS} SELECT trip_id, CAST(day AS VARCHAR) AS day, kind FROM kinds",
)
def trip_days(spark: SparkSession, folder: str) -> DataFrame:
    days = expenses.trip_days(trips(spark, folder))
    return days.select("trip_id", F.col("day").cast("string").alias("day"), "kind")


@query(
    "p07_per_diem",
    f"WITH {_DIEM} SELECT trip_id, CAST(day AS VARCHAR) AS day, kind, base::DOUBLE AS base, reduction::DOUBLE AS "
    "reduction, amount::DOUBLE AS amount FROM paid",
)
def per_diem(spark: SparkSession, folder: str) -> DataFrame:
    days = expenses.per_diem(trips(spark, folder), meals(spark, folder))
    return days.withColumn("day", F.col("day").cast("string"))


_POSITIONS = (
    "pos AS (SELECT l_orderkey AS trip_id, ['travel', 'lodging', 'extra'][l_linenumber % 3 + 1] AS k, CASE l_linenumber % 3 "
    "WHEN 0 THEN round(l_quantity::DECIMAL(18,4) * 0.3, 2) WHEN 1 THEN (l_quantity % 4)::DECIMAL(18,4) * 20 ELSE "
    "round(l_extendedprice::DECIMAL(18,4), 2) END::DECIMAL(18,2) AS amount, l_returnflag = 'R' AS firm FROM lineitem), "
    "costs AS (SELECT trip_id, coalesce(sum(amount) FILTER (WHERE k = 'travel'), 0) AS travel, coalesce(sum(amount) FILTER "
    "(WHERE k = 'lodging'), 0) AS lodging, coalesce(sum(amount) FILTER (WHERE k = 'extra'), 0) AS extra, "
    "coalesce(sum(amount) FILTER (WHERE firm), 0) AS company FROM pos GROUP BY 1), perday AS (SELECT trip_id, count(*) AS "
    "day_count, sum(amount) AS meals FROM paid GROUP BY 1), settled AS (SELECT t.*, coalesce(day_count, 0) AS day_count, "
    "coalesce(meals, 0) AS meals, coalesce(travel, 0) AS travel, coalesce(lodging, 0) AS lodging, coalesce(extra, 0) AS "
    "extra, coalesce(company, 0) AS company FROM trips t LEFT JOIN perday USING (trip_id) LEFT JOIN costs USING (trip_id))"
)


def settled(spark: SparkSession, folder: str) -> DataFrame:
    journeys = trips(spark, folder)
    kind = F.element_at(
        F.array(F.lit("travel"), F.lit("lodging"), F.lit("extra")), F.col("l_linenumber") % 3 + 1
    )
    mode = F.element_at(F.array(F.lit("km"), F.lit("flat"), F.lit("amount")), F.col("l_linenumber") % 3 + 1)
    positions = load(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("trip_id"),
        kind.alias("kind"),
        mode.alias("mode"),
        F.col("l_quantity").alias("km"),
        F.lit(0.3).alias("rate_per_km"),
        (F.col("l_quantity") % 4).alias("nights"),
        F.lit(20.0).alias("night_rate"),
        F.col("l_extendedprice").alias("amount"),
        F.when(F.col("l_returnflag") == "R", "company").otherwise("self").alias("payer"),
    )
    days = expenses.per_diem(journeys, meals(spark, folder))
    return expenses.settle(journeys, days, positions)


@query(
    "p08_settle",
    f"WITH {_DIEM}, {_POSITIONS} SELECT trip_id, day_count, meals::DOUBLE AS meals, travel::DOUBLE AS travel, "
    "lodging::DOUBLE AS lodging, extra::DOUBLE AS extra, company::DOUBLE AS company, (travel + lodging + extra - "
    "company)::DOUBLE AS own_costs, (meals + travel + lodging + extra)::DOUBLE AS total, (meals + travel + lodging + "
    "extra - company)::DOUBLE AS reimbursement FROM settled",
)
def settle(spark: SparkSession, folder: str) -> DataFrame:
    return settled(spark, folder).drop("country", "start", "end", "reason", "place")


def _comma(value: str) -> str:
    return f"replace(CAST(CAST({value} AS DECIMAL(18,2)) AS VARCHAR), '.', ',')"


@query(
    "p09_settlement_csv",
    f"WITH {_DIEM}, {_POSITIONS} SELECT o_orderpriority || ';\"Kunde \"\"' || o_custkey || '\"\"\";' || CASE WHEN country = "
    "'DE' THEN 'Inland' ELSE coalesce(name, 'Ausland') END || ';' || strftime(s, '%Y-%m-%dT%H:%M') || ';' || strftime(e, "
    "'%Y-%m-%dT%H:%M') || ';' || day_count || ';' || "
    + " || ';' || ".join(
        _comma(v)
        for v in (
            "meals", "travel", "lodging", "extra", "meals + travel + lodging + extra", "company",
            "meals + travel + lodging + extra - company",
        )
    )
    + " AS value FROM settled JOIN orders ON o_orderkey = trip_id LEFT JOIN rates ON code = country",
)
def settlement_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark)
    expenses.write_settlement_csv(settled(spark, folder), path)
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r", "").alias("value"))
    return lines.where(~F.col("value").startswith("Anlass;"))


# ---------------------------------------------------------------- receipts out of orders


@query(
    "p10_receipt_fields",
    "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS total, "
    "['hotel', 'bahn', 'oepnv', 'unknown'][o_orderkey % 4 + 1] AS kind, "
    "strftime(o_orderdate + INTERVAL 20 YEAR, '%Y-%m-%d') || ' ' || strftime(o_orderdate + INTERVAL 20 YEAR + INTERVAL 3 DAY, '%Y-%m-%d') AS dates, "
    "CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate + INTERVAL 20 YEAR + INTERVAL 3 DAY, '%Y-%m-%d') END AS check_out, "
    "CASE WHEN o_orderkey % 4 = 0 THEN 3::BIGINT END AS nights, "
    "CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 3 = 0 END AS breakfast, "
    "CASE WHEN o_orderkey % 4 IN (1, 2) THEN o_orderkey % 3 = 0 END AS round_trip, "
    "CASE WHEN o_orderkey % 4 IN (1, 2) THEN 'Köln Hbf' END AS origin, "
    "CASE WHEN o_orderkey % 4 IN (1, 2) THEN 'Berlin' END AS destination FROM orders",
)
def receipt_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Every order as a receipt of today: positions, tax, total, dates in two notations."""
    key, date = F.col("o_orderkey"), F.add_months(F.col("o_orderdate").cast("date"), 240)

    def german(value):
        return F.translate(F.format_number(value.cast("decimal(18,2)"), 2), ",.", ".,")

    head = F.element_at(
        F.array(
            F.lit("Hotel Adler, 1 Zimmer"), F.lit("DB Vertrieb Fahrkarte"),
            F.lit("Verkehrsverbund Tageskarte"), F.lit("Quittung"),
        ),
        (key % 4 + 1).cast("int"),
    )
    extra = F.when(key % 3 == 0, F.lit("mit Frühstück, Hin- und Rückfahrt")).otherwise("ohne Extras")
    price = F.col("o_totalprice")
    text = F.concat_ws(
        "\n",
        head,
        F.concat(F.lit("vom "), F.date_format(date, "dd.MM.yyyy"), F.lit(" bis "),
                 F.date_format(F.date_add(date, 3), "yyyy-MM-dd")),
        F.lit("Reise von Köln Hbf nach Berlin"),
        extra,
        F.concat(F.lit("Posten 1   "), german(price * 0.84)),
        F.concat(F.lit("MwSt 19 %  "), german(price * 0.16)),
        F.concat(F.lit("-" * 100)),
        F.concat(F.lit("Gesamtbetrag EUR "), german(price)),
    )
    # dealt out before the texts are made, which are much wider than their rows
    orders = spread_rows(load(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"))
    found = receipts.extract_receipt_fields(orders.withColumn("text", text), "text")
    return found.select(
        "o_orderkey", "total", "kind", F.array_join("dates", " ").alias("dates"), "check_out", "nights",
        "breakfast", "round_trip", "origin", "destination",
    )


@query(
    "p10_receipt_dates",
    "SELECT doc_id, len(list_distinct(list_filter(list_transform(regexp_extract_all(text, "
    "'\\b[0-9]{4}-[0-9]{2}-[0-9]{2}\\b'), lambda d: CASE WHEN CAST(substr(d, 6, 2) AS INT) BETWEEN 1 AND 12 AND "
    "CAST(substr(d, 9, 2) AS INT) BETWEEN 1 AND 31 THEN d END), lambda d: d IS NOT NULL)))::BIGINT AS iso_dates "
    "FROM documents",
)
def receipt_dates(spark: SparkSession, folder: str) -> DataFrame:
    """The extractor over whole free texts; ISO dates are counted on both sides."""
    found = receipts.extract_receipt_fields(load(spark, folder, "documents").select("doc_id", "text"), "text")
    written = F.filter("dates", lambda d: F.contains(F.col("text"), d))
    return found.select("doc_id", big(F.size(written), "iso_dates"))
