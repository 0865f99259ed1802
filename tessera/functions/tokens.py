"""Tokens of code-like texts, as columns: technical terms, snake and camel case, stop words, stems."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out, terms kept whole, and endings as (ending, shortest word, letters dropped, letters put on), tried in this order.
STOP_WORDS = """a an the and or but in on at to for of with by from as is was are were be been being have has had do does did will would could should
may might must shall can not no it its this that these those i we you he she they me us him her them""".split()
TECHNICAL = """API JWT OAuth SQL NoSQL REST GraphQL HTTP HTTPS URL URI JSON XML HTML CSS CLI SDK UI UX MCP RPC SSE WebSocket CI CD UUID ID""".split()
ENDINGS = [
    ("ing", 7, 3, ""), ("ations", 8, 6, ""), ("ation", 7, 5, ""), ("tion", 7, 4, ""), ("ness", 6, 4, ""), ("ment", 6, 4, ""), ("ized", 6, 4, "ize"), ("ises", 6, 2, ""),
    ("izing", 7, 3, ""), ("ies", 5, 3, "y"), ("ed", 5, 2, ""), ("ers", 6, 2, ""), ("er", 5, 2, ""), ("ly", 5, 2, ""), ("es", 5, 2, ""), ("s", 5, 1, ""),
]
SEPARATORS = r"[\s\-./\\,;:'\"!?@#$%^&*()\[\]{}<>|=+`~_]+"


def stem(word: Column) -> Column:
    """A lower-case word without its ending; words of up to three letters stay."""
    out = word
    for ending, shortest, drop, add in reversed(ENDINGS):
        fits = word.endswith(ending) & (F.length(word) >= shortest)
        if ending == "s":
            fits = fits & ~word.endswith("ss")
        out = F.when(fits, F.concat(F.left(word, F.length(word) - drop), F.lit(add))).otherwise(out)
    return out


def camel(word: Column) -> Column:
    """The parts of a camel-case word; one of capitals only is a single part."""
    spaced = F.regexp_replace(F.regexp_replace(word, "([A-Z][a-z])", " $1"), "([a-z])([A-Z])", "$1 $2")
    return F.when(word.rlike("^[A-Z]+$"), F.array(word)).otherwise(F.filter(F.split(spaced, " "), lambda w: w != ""))


def tokenize(text: Column) -> Column:
    """Lower-case stems of a text's words, in order, repeated ones too."""
    stops, terms = F.array(*map(F.lit, STOP_WORDS)), F.array(*map(F.lit, TECHNICAL))
    raw = F.filter(F.split(text, SEPARATORS), lambda w: w != "")

    def parts(w):
        lower = F.filter(F.transform(camel(w), F.lower), lambda x: (F.length(x) >= 2) & ~F.array_contains(stops, x))
        return F.when(F.array_contains(terms, w), F.array(F.lower(w))).otherwise(F.filter(F.transform(lower, stem), lambda x: F.length(x) >= 2))

    return F.flatten(F.transform(raw, parts))
