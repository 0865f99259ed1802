"""Dates that texts name, as columns. Null where there is none.

A text is split once into words (runs of ASCII letters, digits and _), runs of
white space and single other characters; each form of a date is then a row of
such tokens, read by place. Only a form's first place in a text counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names that are understood.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
WEEKDAYS = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]
ORDINALS = ["st", "nd", "rd", "th"]
UNITS = {"day": 1, "days": 1, "week": 7, "weeks": 7, "month": 0, "months": 0}
# Fixed value: white space.
SPACE = "\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}"

#: Longer ago than that (in days, or months) is before all dates.
MAX_AGO = 700_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


class Tokens:
    """The tokens of a text, and readings of what stands k places behind token i."""

    def __init__(self, p: Column):
        self.p = p

    def at(self, i: Column, k: int) -> Column:
        return F.get(self.p, i + k)

    def digits(self, i: Column, k: int, least: int, most: int) -> Column:
        return self.at(i, k).rlike(f"^[0-9]{{{least},{most}}}\\z")

    def space(self, i: Column, k: int) -> Column:
        return self.at(i, k).rlike(f"^[{SPACE}]")

    def number(self, i: Column, k: int) -> Column:
        return self.at(i, k).try_cast("int")

    def first(self, fits: Callable[[Column], Column], read: Callable[[Column], Column]) -> Column:
        """read at the first place that fits; null if none does."""
        return let(F.get(F.filter(F.sequence(F.lit(0), F.size(self.p)), fits), F.lit(0)), lambda i: F.when(i.isNotNull(), read(i)))

    def any(self, fits: Callable[[Column], Column]) -> Column:
        return F.exists(F.sequence(F.lit(0), F.size(self.p)), fits)

    def phrase(self, i: Column, *words: str) -> Column:
        """The words from token i on, with white space between."""
        out = self.at(i, 0) == words[0]
        for k, w in enumerate(words[1:], 1):
            out = out & self.space(i, 2 * k - 1) & (self.at(i, 2 * k) == w)
        return out


def tokens(text: Column, use: Callable[[Tokens], Column]) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[A-Za-z0-9_]+|[{SPACE}]+|[^A-Za-z0-9_{SPACE}]"), F.lit(0))
    return let(found, lambda p: use(Tokens(p)))


def day_of(year: Column, month: Column, day: Column) -> Column:
    """Midnight of a day; a day past the end of its month runs over into the next."""
    known = month.between(1, 12) & day.between(1, 31) & (year >= 1)
    return F.date_add(F.when(known, F.make_date(year, month, F.lit(1))), day - 1).cast("timestamp_ntz")


def numeric(t: Tokens) -> Column:
    """2024-03-05, and if the hour and minute follow behind a blank or a T, with them and the seconds that may follow."""
    is_ = lambda i, k, c: t.at(i, k) == c
    joined = lambda i: t.at(i, 4).rlike("^[0-9]{2}T[0-9]{2}\\z") & is_(i, 5, ":") & t.digits(i, 6, 2, 2)
    apart = lambda i: is_(i, 5, " ") & t.digits(i, 6, 2, 2) & is_(i, 7, ":") & t.digits(i, 8, 2, 2)
    fits = lambda i: t.digits(i, 0, 4, 4) & is_(i, 1, "-") & t.digits(i, 2, 2, 2) & is_(i, 3, "-") & (t.digits(i, 4, 2, 2) | joined(i))

    def clock(hour: Column, i: Column, k: int) -> Column:
        """Seconds since midnight; the minute is k places behind i, the second two further."""
        second = F.when(is_(i, k + 1, ":") & t.digits(i, k + 2, 2, 2), t.number(i, k + 2)).otherwise(0)
        return hour * 3600 + t.number(i, k) * 60 + second

    def read(i: Column) -> Column:
        head = lambda start: F.substring(t.at(i, 4), start, 2).try_cast("int")
        seconds = F.when(joined(i), clock(head(4), i, 6)).when(apart(i), clock(t.number(i, 6), i, 8)).otherwise(0)
        return day_of(t.number(i, 0), t.number(i, 2), head(1)) + F.make_dt_interval(secs=seconds)

    return t.first(fits, read)


def named(t: Tokens) -> Column:
    """March 5, 2024; the day may be an ordinal, and the comma may be missing."""
    month = lambda i: F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(t.at(i, 0))).cast("int")
    year = lambda i: F.when(t.at(i, 3) == ",", i + 5).otherwise(i + 4)
    fits = lambda i: (month(i) > 0) & t.space(i, 1) & t.at(i, 2).rlike(f"^(?i:[0-9]{{1,2}}(?:{'|'.join(ORDINALS)})?)\\z") & t.space(year(i), -1) & t.digits(year(i), 0, 4, 4)
    day = lambda i: F.regexp_extract(t.at(i, 2), "^[0-9]+", 0).try_cast("int")
    return t.first(fits, lambda i: day_of(t.number(year(i), 0), month(i), day(i)))


def slashed(t: Tokens) -> Column:
    """3/5/2024, the month first."""
    fits = lambda i: t.digits(i, 0, 1, 2) & (t.at(i, 1) == "/") & t.digits(i, 2, 1, 2) & (t.at(i, 3) == "/") & t.digits(i, 4, 4, 4)
    return t.first(fits, lambda i: day_of(t.number(i, 4), t.number(i, 0), t.number(i, 2)))


def absolute(text: Column) -> Column:
    """The first numeric date (with its time, if any), else the first named one, else the first with slashes; a form whose first date can't be is passed over."""
    return F.when(text.rlike("[0-9]{4}"), tokens(text, lambda t: F.coalesce(numeric(t), named(t), slashed(t))))


def relative(text: Column, anchor: Column) -> Column:
    """The day that yesterday, tomorrow, `n days/weeks/months ago` or `last/next <weekday>` (tried in this order) mean on the day `anchor`; a month earlier ends where that month ends. What is longer ago than dates go back is null."""

    def meant(t: Tokens) -> Column:
        has = lambda w: F.array_contains(t.p, w)
        units = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
        ago = lambda i: t.at(i, 0).rlike("^[0-9]+\\z") & t.space(i, 1) & t.at(i, 2).isin(*UNITS) & t.space(i, 3) & (t.at(i, 4) == "ago")
        week = lambda i: t.at(i, 0).isin("last", "next") & t.space(i, 1) & t.at(i, 2).isin(*WEEKDAYS)

        def back(i: Column) -> Column:
            n, days = t.at(i, 0).try_cast("long"), F.element_at(units, t.at(i, 2))
            n = F.when(n * F.greatest(days, F.lit(30)) <= MAX_AGO, n).cast("int")
            return F.struct(F.when(days == 0, F.add_months(anchor, -n)).otherwise(F.date_sub(anchor, n * days)).alias("day"))

        def weekday(i: Column) -> Column:
            # array_position begins at 1 like dayofweek
            wanted, today = F.array_position(F.array(*map(F.lit, WEEKDAYS)), t.at(i, 2)).cast("int"), F.dayofweek(anchor)
            earlier, later = F.pmod(today - wanted - 1, F.lit(7)) + 1, F.pmod(wanted - today - 1, F.lit(7)) + 1
            return F.struct(F.when(t.at(i, 0) == "last", F.date_sub(anchor, earlier)).otherwise(F.date_add(anchor, later)).alias("day"))

        near = F.when(has("yesterday"), F.struct(F.date_sub(anchor, 1).alias("day"))).when(has("tomorrow"), F.struct(F.date_add(anchor, 1).alias("day")))
        return F.coalesce(near, t.first(ago, back), t.first(week, weekday))["day"]

    low = F.lower(text)
    return F.when(low.rlike("yesterday|tomorrow|ago|last|next"), tokens(low, meant))


# What asks for a time by itself, and what does only beside the name of a month.
ASKING = ["when", "what date", "what day", "how long ago", "last time", "this time", "yesterday", "tomorrow"]
BESIDE_MONTH = ["before", "after", "ago"]


def temporal(text: Column) -> Column:
    """Whether a query asks when something was: it says so, or names a weekday, a date, a month with a day or year, or a time ago; or a month beside before, after or ago. False for null."""

    def asks(t: Tokens) -> Column:
        day = lambda i, k: t.at(i, k).rlike(f"^[0-9]{{1,2}}(?:{'|'.join(ORDINALS)})?\\z")
        month = lambda i, k: t.at(i, k).isin(*MONTHS)
        dashed = lambda i: t.digits(i, 0, 4, 4) & (t.at(i, 1) == "-") & t.digits(i, 2, 2, 2) & (t.at(i, 3) == "-") & t.digits(i, 4, 2, 2)
        parted = lambda i: t.digits(i, 0, 1, 2) & (t.at(i, 1) == "/") & t.digits(i, 2, 1, 2) & (t.at(i, 3) == "/") & t.digits(i, 4, 2, 4)
        dated = lambda i: t.space(i, 1) & ((month(i, 0) & (day(i, 2) | t.digits(i, 2, 4, 4))) | (day(i, 0) & month(i, 2)))
        ago = lambda i: t.at(i, 0).rlike("^[0-9]+\\z") & t.space(i, 1) & t.at(i, 2).isin(*UNITS, "year", "years") & t.space(i, 3) & (t.at(i, 4) == "ago")

        def one(i: Column) -> Column:
            out = t.at(i, 0).isin(*WEEKDAYS) | dashed(i) | parted(i) | dated(i) | ago(i)
            for words in ASKING:
                out = out | t.phrase(i, *words.split(" "))
            return F.coalesce(out, F.lit(False))

        has = lambda names: F.arrays_overlap(t.p, F.array(*map(F.lit, names)))
        return F.when(t.any(one) | (has(MONTHS) & has(BESIDE_MONTH)), True).otherwise(False)

    return tokens(F.lower(text), asks)


def target(query: Column, anchor: Column) -> Column:
    """The instant that a query names, if any."""
    return F.coalesce(absolute(query), relative(query, anchor).cast("timestamp_ntz"))


def of_record(key: Column, value: Column, anchor: Column) -> tuple[Column, Column]:
    """The absolute and the relative date of a record: its key's, else its value's."""
    return F.coalesce(absolute(key), absolute(value)), F.coalesce(relative(key, anchor), relative(value, anchor))
