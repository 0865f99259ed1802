"""Rules that name what a text is, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of observations and the type that they make, tried in this order; parts of headings and theirs.
OBSERVED = [
    ("decision", "decided|chose|went with|picked|selected|opted for|using .+ instead of|switched to|migrated to"),
    ("convention", "always|never|must|should|convention|pattern|rule|naming|style|format|we use|the standard is|follow the"),
    ("architecture", "architecture|module|component|layer|boundary|directory|structure|lives in|defined in|imports from|exports"),
    ("lesson", "learned|gotcha|watch out|careful|bug|issue|mistake|avoid|don't|broke|fixed because|the reason is"),
    ("entity", "created|added|new|built|implemented|introduced|this (?:class|function|component|module|service)"),
]
HEADED = [
    ("anti_pattern", ["anti-pattern", "anti_pattern", "don't", "dont", "avoid", "never"]), ("convention", ["convention", "rule"]),
    ("architecture", ["architecture", "design", "structure"]), ("decision", ["decision"]),
]


def observation(text: Column, shortest: int = 15) -> Column:
    """The type of the first rule with words that stand alone in the text; null for short texts and where none fits."""
    low = F.lower(F.trim(text))
    found = [F.when(low.rlike(f"(?<![a-z0-9_])({words})(?![a-z0-9_])"), F.lit(name)) for name, words in OBSERVED]
    return F.when(F.length(low) >= shortest, F.coalesce(*found))


def heading(text: Column) -> Column:
    """The type that a heading's records have; preference where no rule fits."""
    low = F.lower(text)
    found = [F.when(F.greatest(*[low.contains(p) for p in parts], F.lit(False)), F.lit(name)) for name, parts in HEADED]
    return F.coalesce(*found, F.lit("preference"))


def age_label(minutes: Column) -> Column:
    """now, minutes, hours or days, rounded down."""
    unit = lambda n, letter: F.concat(F.floor(minutes / n).cast("string"), F.lit(letter + " ago"))
    return F.when(minutes < 1, "just now").when(minutes < 60, unit(1, "m")).when(minutes < 1440, unit(60, "h")).otherwise(unit(1440, "d"))


def budget(n_records: Column) -> Column:
    """Tokens for a context of so many records."""
    return F.when(n_records < 50, 4000).when(n_records < 200, 6000).otherwise(8000)


def resized(vector: Column, size: int) -> Column:
    """A vector of `size` places: a longer one is cut and brought to length 1, a shorter one filled with zeros."""
    cut = F.slice(vector, 1, size)
    norm = F.sqrt(F.aggregate(cut, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = F.transform(cut, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))
    more = F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(size) - F.size(vector)))
    return F.when(F.size(vector) > size, unit).otherwise(F.concat(vector.cast("array<double>"), more))


def json_depth(text: Column) -> Column:
    """The deepest nesting of brackets, not counting those within strings."""
    bare = F.regexp_replace(text, r'"(?:[^"\\\\]|\\\\.)*"', "")
    marks = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    step = lambda s, c: F.struct((s["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).alias("now"), F.greatest(s["most"], s["now"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("most"))
    return F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step)["most"]


# What the sentences of a session's summary become, and the words that tell, tried in this order.
SUMMARY = [
    ("decision", "decision", "decided chose went_with picked selected opted"), ("convention", "convention", "convention pattern always never must naming style"), ("architecture", "arch", "architecture module structure layer boundary directory layout"),
    ("lesson", "lesson", "learned gotcha watch_out careful bug issue mistake avoid"), ("entity", "entity", "created added new built implemented introduced"),
]
SHORTEST_SENTENCE, KEY_CHARACTERS = 10, 50


def summary_records(summary: Column) -> Column:
    """An array of (key, value, type): the lines and sentences of a summary that some rule fits; a sentence ends where a capital follows."""
    parts = F.transform(F.split(summary, "\\n|(?<=\\.)\\s+(?=[A-Z])"), lambda x: F.regexp_replace(x, "^\\s+|\\s+$", ""))

    def read(x: Column) -> Column:
        fits = [(F.lower(x).rlike(f"(?<![a-z0-9_])(?:{'|'.join(w.replace('_', ' ') for w in words.split())})(?![a-z0-9_])"), name, begin) for name, begin, words in SUMMARY]
        kind = F.coalesce(*[F.when(fit, name) for fit, name, _ in fits])
        begin = F.coalesce(*[F.when(fit, begin) for fit, _, begin in fits])
        slug = F.regexp_replace(F.regexp_replace(F.lower(F.substring(x, 1, KEY_CHARACTERS)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
        return F.struct(F.concat_ws("-", begin, slug).alias("key"), x.alias("value"), kind.alias("type"))

    return F.filter(F.transform(F.filter(parts, lambda x: F.length(x) > SHORTEST_SENTENCE), read), lambda r: r["type"].isNotNull())
