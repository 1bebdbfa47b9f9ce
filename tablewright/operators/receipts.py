"""Fields of a receipt out of its text: total, dates, kind, stay and journey."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions.columns import any_of, col

# How amounts and dates are written on receipts.
AMOUNT = r"(?:\d{1,3}(?:[.\u00a0 ]\d{3})+|\d+),\d{2}(?!\d)"
DAY_FIRST = r"\b(\d{1,2})[./-](\d{1,2})[./-](\d{2,4})\b"
YEAR_FIRST = r"\b(\d{4})-(\d{2})-(\d{2})\b"
NAMED_MONTH = r"\b(\d{1,2})\.?\s+([A-Za-zäöüÄÖÜ]{3,9})\.?\s+(\d{4})\b"

# Names of months.
MONTHS = {
    "jan": 1, "januar": 1, "feb": 2, "februar": 2, "mär": 3, "märz": 3, "mrz": 3, "maerz": 3,
    "mar": 3, "march": 3, "apr": 4, "april": 4, "mai": 5, "may": 5, "jun": 6, "juni": 6,
    "june": 6, "jul": 7, "juli": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9,
    "september": 9, "okt": 10, "oktober": 10, "oct": 10, "october": 10, "nov": 11,
    "november": 11, "dez": 12, "dezember": 12, "dec": 12, "december": 12,
}

# Words near a total and their weight, words near a tax.
TOTAL_WORDS = (
    (
        r"gesamtbetrag|gesamtsumme|rechnungsbetrag|endbetrag|zu\s*zahlen|zahlbetrag"
        r"|grand\s*total|total\s*amount|to\s*pay|zahlungsbetrag",
        5,
    ),
    (r"gesamt|total|brutto", 3),
    (r"betrag|summe|preis|amount|price|fahrpreis", 2),
)
TAX_WORDS = r"mwst|ust\.|umsatzsteuer|mehrwertsteuer|\bvat\b|steuer|enthalten"
TAX_PENALTY, REACH, BEFORE, LATE_BONUS = 3, 80, 30, 0.5

# Kinds of receipt and the words that show them, in this order.
KINDS = (
    (
        "hotel",
        r"hotel|übernachtung|beherberg|zimmer|room\s*rate|check[\s-]?out|check[\s-]?in|logis"
        r"|pension|gästehaus|n[aä]chtigung",
    ),
    (
        "bahn",
        r"deutsche\s*bahn|bahn\.de|fahrkarte|fahrschein|bahncard|\bice\b|\bintercity\b"
        r"|zugbindung|db\s*vertrieb|db\s*fernverkehr",
    ),
    (
        "oepnv",
        r"verkehrsverbund|nahverkehr|einzelfahr|tageskarte|deutschlandticket|\bhvv\b|\bbvg\b"
        r"|\bmvv\b|\bmvg\b|\bvbb\b|\brmv\b|\bvrr\b|\bvrs\b|\bvvs\b|u-?bahn|s-?bahn|straßenbahn"
        r"|\btram\b",
    ),
    ("bahn", r"\bbahn\b|\bticket\b|reservierung"),
)
NIGHTS = r"(\d+)\s*(?:nächte|naechte|übernachtungen|uebernachtungen|nights)"
BREAKFAST = r"frühstück|fruehstueck|breakfast|petit\s*déjeuner"
ROUND_TRIP = r"hin.?\s*und\s*rück|hin.?\s*&\s*rück|round\s*trip"
_PLACE = r"([A-ZÄÖÜ][\wäöüÄÖÜ .()/-]{1,40}?)"
_STOP = r"(?:\s{2,}|[\n,;]|\z)"
FROM_TO = rf"\bvon\s+{_PLACE}\s+nach\s+{_PLACE}{_STOP}"
ARROW = rf"{_PLACE}\s*(?:→|->|—|–)\s*{_PLACE}{_STOP}"
AFTER_PLACE = r"(?i)\s+(ICE|IC|EC|RE|RB|IRE|TGV|Wagen|Platz|Gleis|S-?Bahn|U-?Bahn)\b.*\z"


def mentions(low: Column, words: str) -> Column:
    """Does lower-case text match one of the alternatives `a|b|c`?

    Plain words are searched as they are; a pattern only runs where the
    letters it starts with occur.
    """

    def one(piece: str) -> Column:
        if piece.isalpha():
            return F.contains(low, F.lit(piece))
        lead = re.match(r"(?:\\b)?([^\W\d_]+)(?![?*])", piece)
        match = low.rlike(piece)
        return F.contains(low, F.lit(lead[1])) & match if lead else match

    return any_of([one(p) for p in words.split("|")])


_OPEN, _CLOSE = "\u0001", "\u0002"


def find_all(text: Column, pattern: str) -> Column:
    """Array of (start, end, text): all matches with their 0-based places.

    One pass marks the matches, the rest counts characters.
    """
    marks = F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_CLOSE))
    clean = F.when(marks, F.translate(text, _OPEN + _CLOSE, "  ")).otherwise(text)
    parts = F.split(F.regexp_replace(clean, pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN)
    start = F.struct(
        F.lit(-1).alias("at"), F.array().cast("array<struct<s:int,e:int,t:string>>").alias("out")
    )

    def step(acc: Column, part: Column) -> Column:
        hit = F.substring_index(part, _CLOSE, 1)
        entry = F.struct(
            acc["at"].alias("s"), (acc["at"] + F.char_length(hit)).alias("e"), hit.alias("t")
        )
        first = acc["at"] < 0  # what stands before the first match
        return F.struct(
            F.when(first, F.char_length(part))
            .otherwise(acc["at"] + F.char_length(part) - 1)
            .alias("at"),
            F.when(first, acc["out"]).otherwise(F.concat(acc["out"], F.array(entry))).alias("out"),
        )

    return F.aggregate(parts, start, step)["out"]


def _value(text: Column) -> Column:
    return F.translate(text, ",.\u00a0 ", ".").try_cast("double")


def _best_total(text: Column, low: Column, amounts: Column) -> Column:
    """(score, tier, place, value) of the best amount behind a total word."""
    size = F.greatest(F.lit(1), F.char_length(text))
    none = F.array().cast("array<struct<s:int,e:int,t:string>>")

    def judged(tier: int, words: str, weight: int) -> Column:
        def meet(w: Column, i: Column) -> Column:
            reach = F.filter(amounts, lambda a: (a["s"] >= w["s"]) & (a["s"] - w["e"] < REACH))
            return F.struct(w.alias("w"), i.alias("i"), F.get(reach, F.lit(0)).alias("near"))

        # a field of its own: an expression inside a lambda is worked out anew wherever it is named
        def look(m: Column) -> Column:
            left = F.greatest(F.lit(0), m["w"]["s"] - BEFORE)
            around = F.lower(F.substr(text, left + 1, m["w"]["e"] + REACH - left))
            return F.struct(m["i"].alias("i"), m["near"].alias("near"), around.alias("around"))

        def judge(m: Column) -> Column:
            tax = F.when(mentions(m["around"], TAX_WORDS), F.lit(TAX_PENALTY)).otherwise(F.lit(0))
            score = F.lit(float(weight)) - tax + m["near"]["s"] / size * LATE_BONUS
            return F.struct(
                score.alias("score"),
                F.lit(-tier).alias("tier"),
                (-m["i"]).alias("place"),
                _value(m["near"]["t"]).alias("value"),
            )

        # no place is tried that does not start with a first letter of a word
        firsts = "".join(sorted({w[0] for w in words.split("|")}))
        found = find_all(text, f"(?i)(?=[{firsts}])(?:{words})")
        found = F.when((F.size(amounts) > 0) & mentions(low, words), found).otherwise(none)
        met = F.filter(F.transform(found, meet), lambda m: m["near"].isNotNull())
        return F.transform(F.transform(met, look), judge)

    return F.array_max(
        F.concat(*[judged(tier, words, weight) for tier, (words, weight) in enumerate(TOTAL_WORDS)])
    )


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws(
        "-",
        F.lpad(year.cast("string"), 4, "0"),
        F.lpad(month.cast("string"), 2, "0"),
        F.lpad(day.cast("string"), 2, "0"),
    )


def _dates(text: Column) -> Column:
    """Sorted distinct ISO dates in three notations."""

    def found(pattern: str, build) -> Column:
        def groups(hit: Column) -> Column:
            return F.struct(*[F.regexp_extract(hit, pattern, i).alias(f"g{i}") for i in (1, 2, 3)])

        hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), groups)
        return F.filter(F.transform(hits, build), lambda d: d.isNotNull())

    def day_first(h: Column) -> Column:
        d, m, y = (h[f"g{i}"].cast("int") for i in (1, 2, 3))
        year = F.when(y < 100, y + 2000).otherwise(y)
        ok = m.between(1, 12) & d.between(1, 31) & year.between(2000, 2099)
        return F.when(ok, _iso(year, m, d))

    def year_first(h: Column) -> Column:
        y, m, d = (h[f"g{i}"].cast("int") for i in (1, 2, 3))
        return F.when(m.between(1, 12) & d.between(1, 31), _iso(y, m, d))

    numbers = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])

    def named(h: Column) -> Column:
        d = h["g1"].cast("int")
        m = F.try_element_at(numbers, F.lower(h["g2"]))
        return F.when(m.isNotNull() & d.between(1, 31), _iso(h["g3"].cast("int"), m, d))

    every = F.concat(
        found(DAY_FIRST, day_first), found(YEAR_FIRST, year_first), found(NAMED_MONTH, named)
    )
    return F.array_sort(F.array_distinct(every))


def extract_receipt_fields(df: DataFrame, text_col: str) -> DataFrame:
    """The table with receipt fields: amounts, total, dates, kind, check_in, check_out, nights,
    breakfast, round_trip, origin, destination.

    Expressions over the whole text, one row at a time.
    """
    text = F.coalesce(col(text_col), F.lit(""))
    step = df.withColumn("_found", find_all(text, AMOUNT)).withColumn("dates", _dates(text))
    step = step.withColumn("_low", F.lower(text))
    low = F.col("_low")
    kind = F.lit("unknown")
    for name, words in reversed(KINDS):
        kind = F.when(mentions(low, words), name).otherwise(kind)
    step = step.withColumn("kind", kind)
    step = step.withColumn("_best", _best_total(text, low, F.col("_found")))
    best = F.col("_best")
    largest = F.array_max(F.transform("_found", lambda a: _value(a["t"])))
    total = F.when(best["score"] > 0, best["value"]).otherwise(largest)
    hotel, ride = F.col("kind") == "hotel", F.col("kind").isin("bahn", "oepnv")
    first = F.get("dates", F.lit(0))
    last = F.when(F.size("dates") > 1, F.element_at("dates", -1))
    said = F.nullif(F.regexp_extract(low, NIGHTS, 1), F.lit("")).try_cast("bigint")
    counted = F.when(
        last.isNotNull(),
        F.greatest(F.lit(0), F.date_diff(last.try_cast("date"), first.try_cast("date"))),
    )
    both_ways = mentions(low, ROUND_TRIP) | (
        mentions(low, "hinfahrt") & mentions(low, "rückfahrt|rueckfahrt")
    )
    worded = text.rlike(FROM_TO)

    def place(i: int) -> Column:
        found = F.when(worded, F.regexp_extract(text, FROM_TO, i)).when(
            text.rlike(ARROW), F.regexp_extract(text, ARROW, i)
        )
        return F.trim(F.regexp_replace(found, AFTER_PLACE, ""))

    return step.select(
        *[col(c) for c in df.columns],
        F.transform("_found", lambda a: _value(a["t"])).alias("amounts"),
        total.alias("total"),
        "dates",
        "kind",
        F.when(hotel, first).alias("check_in"),
        F.when(hotel, last).alias("check_out"),
        F.when(hotel, F.coalesce(said, counted)).cast("bigint").alias("nights"),
        F.when(hotel, mentions(low, BREAKFAST)).alias("breakfast"),
        F.when(ride, both_ways).alias("round_trip"),
        F.when(ride, place(1)).alias("origin"),
        F.when(ride, place(2)).alias("destination"),
    )
