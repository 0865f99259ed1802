"""Guides (documents of a project with known sections) against its records: what they lack, deny or no longer say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.imports import headed

# Sections, the types that go to one of them, and the words of a key or value that do.
SECTIONS = ["Commands", "Testing", "Project structure", "Code style", "Git workflow", "Boundaries"]
COMMANDS, TESTING, STRUCTURE, STYLE, GIT, BOUNDARIES = SECTIONS
WARNING_TYPES = ["anti_pattern", "lesson", "preference"]
ACTION_TYPES = ["execution", "pattern"]
GIT_WORDS = "git branch commit pr merge rebase".split()
TEST_WORDS = "test spec ci coverage pytest vitest jest".split()
TEST_VALUE_WORDS = "test spec ci".split()
# Words without a subject, and words that deny (the last two only where a guide does).
NO_SUBJECT = "always never should must with that from this have when".split()
DENYING = ["never", "don't", "do not", "avoid", "not", "no"]
GUIDE_DENYING = [*DENYING, "prohibited", "forbidden"]
#: A record's share of longer words that its section must hold; words that tell its subject; characters of a fragment.
REFLECTED, SUBJECT_WORDS, FRAGMENT = 0.7, 4, 120


def says(text: Column, words: list[str]) -> Column:
    """Whether one of the words stands in the text as a whole."""
    return text.rlike(f"(?<![A-Za-z0-9_])(?:{'|'.join(words)})(?![A-Za-z0-9_])")


def bare(text: Column) -> Column:
    """Lower-cased, without marks of lists, quotes, code and emphasis, with single spaces."""
    plain = F.regexp_replace(F.lower(text), "[*`_]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "(?m)^\\s*[->]\\s*", ""), "\\s+", " "), "^ | $", "")


def sections_of(key: Column, value: Column, kind: Column, tags: Column) -> Column:
    """The sections where a record belongs: that of a tag; else the one of warnings; else all that its key, tags and type name, or the project's structure."""
    own = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(t))
    tagged = F.coalesce(*[F.when(F.array_contains(own, s.lower()), s) for s in SECTIONS])
    git = says(F.lower(key), GIT_WORDS) | F.array_contains(own, "git")
    tests = says(F.lower(key), TEST_WORDS) | F.array_contains(own, "testing")
    action = F.when(~tests & says(F.lower(value), TEST_VALUE_WORDS), TESTING).when(~git, COMMANDS)
    found = F.array_compact(F.array(F.when(git, GIT), F.when(tests, TESTING), F.when(kind == "architecture", STRUCTURE), F.when(kind == "convention", STYLE), F.when(kind.isin(ACTION_TYPES), action)))
    return F.when(tagged.isNotNull(), F.array(tagged)).when(kind.isin(WARNING_TYPES), F.array(F.lit(BOUNDARIES))).when(F.size(found) > 0, found).otherwise(F.array(F.lit(STRUCTURE)))


def guide_sections(guides: DataFrame) -> DataFrame:
    """project_id, section, body: of each guide (project_id, text) the first part under a heading that begins with a section's name, with the rest of the heading."""
    parts = headed(guides.select(F.col("project_id").alias("path"), "text"), [2])
    name = F.coalesce(*[F.when(F.col("title").rlike(f"(?i)^{s}(?![A-Za-z0-9_])"), s) for s in SECTIONS])
    parts = parts.withColumn("section", name).where("section is not null")
    body = F.concat(F.expr("substring(title, length(section) + 1)"), F.lit("\n"), F.array_join("lines", "\n"))
    return parts.groupBy(F.col("path").alias("project_id"), "section").agg(F.min_by(body, "place").alias("body"))


def denial(value: Column, body: Column) -> Column:
    """The first sentence of a bare section that denies something about the subject of a bare value that denies nothing."""
    subject = F.slice(F.filter(F.split(value, " "), lambda w: (F.length(w) > 4) & ~w.isin(NO_SUBJECT)), 1, SUBJECT_WORDS)
    against = F.filter(F.split(body, "\\."), lambda s: says(s, GUIDE_DENYING) & F.exists(subject, lambda w: F.contains(s, w)))
    return F.when(~says(value, DENYING), F.substring(F.get(against, F.lit(0)), 1, FRAGMENT))


def reflected(value: Column, body: Column) -> Column:
    """Whether a bare section holds a bare value, or most of its longer words."""
    words = F.filter(F.split(value, " "), lambda w: F.length(w) > 3)
    share = F.size(F.filter(words, lambda w: F.contains(body, w))) / F.size(words)
    return F.contains(body, value) | F.coalesce(F.when(F.size(words) > 0, share >= REFLECTED), F.lit(False))


def drift(records: DataFrame, guides: DataFrame) -> DataFrame:
    """project_id, section, kind, id, fragment of every record and section where they part: missing (no such section), contradicting (with the sentence), stale (not reflected).

    One join by project and section: a section's text is made bare once and goes
    with its records; a project has at most six. Records of projects without a
    guide have nothing to be held against.
    """
    known = guides.select("project_id").distinct()
    own = records.join(known, "project_id", "left_semi")
    own = own.select("id", "project_id", bare(F.col("value")).alias("said"), F.explode(sections_of(F.col("key"), F.col("value"), F.col("type"), F.col("tags"))).alias("section"))
    parts = guide_sections(guides).select("project_id", "section", bare(F.col("body")).alias("body"))
    met = own.join(parts, ["project_id", "section"], "left").withColumn("fragment", denial(F.col("said"), F.col("body")))
    kind = F.when(F.col("body").isNull(), "missing").when(F.col("fragment").isNotNull(), "contradicting").when(~reflected(F.col("said"), F.col("body")), "stale")
    return met.select("project_id", "section", kind.alias("kind"), "id", "fragment").where("kind is not null")
