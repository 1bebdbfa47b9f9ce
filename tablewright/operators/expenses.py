"""Travel expenses: trip days, daily allowances, settlements."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewright.functions import rates as fixed
from tablewright.functions.columns import col
from tablewright.sources.writers import wrapped

MONEY = "decimal(18,4)"


@dataclass(frozen=True)
class Settings:
    """Rates that a company may set for itself."""

    home: str = fixed.HOME
    home_full: float = fixed.HOME_FULL
    home_short: float = fixed.HOME_SHORT
    home_night: float = fixed.HOME_NIGHT


def default_rates(spark: SparkSession) -> DataFrame:
    """(country, name, full, night) abroad."""
    rows = [(c, n, float(f), float(h)) for c, n, f, h in fixed.ABROAD]
    return spark.createDataFrame(rows, "country string, name string, full double, night double")


def _money(value: Column) -> Column:
    return F.round(value.cast(MONEY), 2)


def trip_days(trips: DataFrame) -> DataFrame:
    """trips (trip_id, start, end, ...): one row per calendar day with its kind.

    kind: arrival, full, departure; one-day trips are single above 8 hours,
    else none.  Trips that do not end after they start have no days.
    """
    first, last = F.to_date("start"), F.to_date("end")
    hours = (F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(
        F.col("start").cast("timestamp")
    )) / F.lit(3.6e9)
    days = trips.where(F.col("end") > F.col("start")).withColumn(
        "day", F.explode(F.sequence(first, last))
    )
    kind = (
        F.when(first == last, F.when(hours > 8, "single").otherwise("none"))
        .when(F.col("day") == first, "arrival")
        .when(F.col("day") == last, "departure")
        .otherwise("full")
    )
    return days.withColumn("kind", kind)


def per_diem(
    trips: DataFrame,
    meals: DataFrame,
    rates: DataFrame | None = None,
    settings: Settings = Settings(),
) -> DataFrame:
    """(trip_id, day, kind, base, reduction, amount): allowance per day.

    trips: trip_id, start, end, country; meals: trip_id, day, breakfast, lunch,
    dinner (flags).  Provided meals cut a share of the full day, down to 0.
    """
    rates = default_rates(trips.sparkSession) if rates is None else rates
    known = rates.select("country", col("full").cast(MONEY).alias("_rate"))
    days = trip_days(trips).select("trip_id", "country", "day", "kind")
    days = days.join(known, "country", "left").join(meals, ["trip_id", "day"], "left")
    home = F.col("country") == settings.home
    zero = F.lit(0).cast(MONEY)
    rate = F.coalesce(F.col("_rate"), zero)
    full = F.when(home, F.lit(settings.home_full).cast(MONEY)).otherwise(rate)
    short = F.when(home, F.lit(settings.home_short).cast(MONEY)).otherwise(
        _money(rate * F.lit(fixed.ABROAD_SHORT).cast("decimal(4,2)"))
    )
    base = (
        F.when(F.col("kind") == "full", full)
        .when(F.col("kind").isin("arrival", "departure", "single"), short)
        .otherwise(zero)
    )
    share = F.lit(0).cast("decimal(4,2)")
    for meal, cut in fixed.MEAL_CUTS.items():
        share = share + F.when(F.coalesce(col(meal), F.lit(False)), F.lit(cut)).otherwise(
            F.lit(0.0)
        ).cast("decimal(4,2)")
    cut = _money(full * share)
    return days.select(
        "trip_id",
        "day",
        "kind",
        base.cast("double").alias("base"),
        cut.cast("double").alias("reduction"),
        F.greatest(zero, _money(base - cut)).cast("double").alias("amount"),
    )


def position_amount() -> Column:
    """km x rate, nights x rate, or the plain amount."""
    value = (
        F.when(F.col("mode") == "km", F.col("km").cast(MONEY) * F.col("rate_per_km").cast(MONEY))
        .when(
            F.col("mode") == "flat", F.col("nights").cast(MONEY) * F.col("night_rate").cast(MONEY)
        )
        .otherwise(F.col("amount").cast(MONEY))
    )
    return F.coalesce(F.round(value, 2), F.lit(0)).cast("decimal(18,2)")


def settle(trips: DataFrame, days: DataFrame, positions: DataFrame) -> DataFrame:
    """One row per trip: costs by kind, company-paid part, total, reimbursement.

    positions: trip_id, kind (travel, lodging, extra), mode (km, flat, amount),
    km, rate_per_km, nights, night_rate, amount, payer (self, company).
    """
    per_day = days.groupBy("trip_id").agg(
        F.count(F.lit(1)).alias("day_count"),
        F.sum(F.col("amount").cast("decimal(18,2)")).alias("meals"),
    )
    amount = position_amount()
    kinds = ("travel", "lodging", "extra")
    costs = positions.groupBy("trip_id").agg(
        *[F.sum(F.when(F.col("kind") == k, amount)).alias(k) for k in kinds],
        F.sum(F.when(F.col("payer") == "company", amount)).alias("company"),
    )
    joined = trips.join(per_day, "trip_id", "left").join(costs, "trip_id", "left")
    part = {
        c: F.coalesce(F.col(c), F.lit(0).cast("decimal(18,2)"))
        for c in ("meals", *kinds, "company")
    }
    spent = part["travel"] + part["lodging"] + part["extra"]
    return joined.select(
        *[col(c) for c in trips.columns],
        F.coalesce("day_count", F.lit(0)).alias("day_count"),
        *[v.cast("double").alias(k) for k, v in part.items()],
        (spent - part["company"]).cast("double").alias("own_costs"),
        (part["meals"] + spent).cast("double").alias("total"),
        (part["meals"] + spent - part["company"]).cast("double").alias("reimbursement"),
    )


# Headings of the settlement report.
REPORT_HEAD = (
    "Anlass", "Ort", "Ziel", "Abreise", "Rückkehr", "Tage", "Verpflegung", "Fahrt",
    "Übernachtung", "Nebenkosten", "Gesamtkosten", "Firma bezahlt", "Erstattung",
)


def settlement_lines(settled: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """(value): report lines with ; and decimal comma; trips also hold reason and place."""
    rates = default_rates(settled.sparkSession) if rates is None else rates
    named = settled.join(rates.select("country", col("name").alias("_name")), "country", "left")

    def number(name: str) -> Column:
        text = F.round(col(name).cast(MONEY), 2).cast("decimal(18,2)").cast("string")
        return F.replace(text, F.lit("."), F.lit(","))

    def cell(value: Column) -> Column:
        text = F.coalesce(value.cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.rlike('[";\n]'), quoted).otherwise(text)

    goal = F.when(F.col("country") == fixed.HOME, "Inland").otherwise(
        F.coalesce("_name", F.lit("Ausland"))
    )
    time = "yyyy-MM-dd'T'HH:mm"
    cells = [
        F.col("reason"), F.col("place"), goal, F.date_format("start", time),
        F.date_format("end", time), F.col("day_count"), number("meals"), number("travel"),
        number("lodging"), number("extra"), number("total"), number("company"),
        number("reimbursement"),
    ]
    return named.select(F.concat_ws(";", *[cell(c) for c in cells]).alias("value"))


def write_settlement_csv(
    settled: DataFrame, path: str, rates: DataFrame | None = None, mode: str = "errorifexists"
) -> None:
    """Report for spreadsheets: UTF-8 with byte order mark, a heading in every part file."""
    head = "\ufeff" + ";".join(REPORT_HEAD)
    lines = wrapped(settlement_lines(settled, rates), head)
    lines.write.mode(mode).option("lineSep", "\r\n").text(path)
