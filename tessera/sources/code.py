"""Source trees as rows (path, text): what files export and import, which files the imports mean, directories as modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Files that count, folders that don't, what declares an export, and what an import may leave out, tried in this order.
EXTENSIONS = ["ts", "tsx", "js", "jsx", "py", "go", "rs"]
IGNORED = ["node_modules", "dist", ".next", ".git", "vendor", "__pycache__", ".turbo"]
DECLARING = "function class const let var type interface enum".split()
SUFFIXES = ["", ".ts", ".tsx", ".js", "/index.ts", "/index.js"]


def source_files(files: DataFrame) -> DataFrame:
    """Those of files (path from the root, ...) that are sources."""
    return files.where(F.col("path").rlike(rf"[^/]\.(?:{'|'.join(EXTENSIONS)})\z") & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, IGNORED))))


def first_of(line: Column, pattern: str) -> Column:
    """The group of the first match in a line, as an array of none or one."""
    return F.slice(F.regexp_extract_all(line, F.lit(pattern), F.lit(1)), 1, 1)


def exported(line: Column) -> Column:
    """Names that a line declares or passes on; of one under another name the other."""
    declared = first_of(line, rf"export\s+(?:default\s+)?(?:{'|'.join(DECLARING)})\s+([A-Za-z0-9_]+)")
    passed = F.flatten(F.transform(first_of(line, r"export\s+\{([^}]+)\}"), lambda x: F.split(x, ",")))
    return F.concat(declared, F.filter(F.transform(passed, lambda x: F.regexp_replace(F.trim(x), r"^.*\s+as\s+", "")), lambda x: x != ""))


def imported(line: Column) -> Column:
    """What a line imports, at its start or when it runs."""
    return F.concat(first_of(line, r"""(?:import\s+(?:[^'"]*\s+from\s+)?|import\s*\(\s*|require\s*\(\s*)['"]([^'"]+)['"]"""))


def modules(files: DataFrame) -> DataFrame:
    """path, exports, imports (of files and scopes), local (of files only) and n_lines of every source file. A file's lines are split once."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    m = source_files(files).select("path", lines.alias("lines"))
    each = lambda of: F.flatten(F.transform("lines", of))
    m = m.select("path", each(exported).alias("exports"), each(imported).alias("all"), F.size("lines").cast("long").alias("n_lines"))
    begins = lambda x, *marks: F.substring(x, 1, 1).isin(*marks)
    return m.select("path", "exports", F.filter("all", lambda x: begins(x, ".", "@")).alias("imports"), F.filter("all", lambda x: begins(x, ".")).alias("local"), "n_lines")


def resolved(directory: Column, name: Column) -> Column:
    """The path that a relative name means in a directory; null where it leaves the root."""
    parts = F.filter(F.split(F.concat_ws("/", directory, name), "/"), lambda x: ~x.isin("", "."))
    none = F.lit(None).cast("array<string>")

    def step(at: Column, x: Column) -> Column:
        up = F.when(F.size(at) > 0, F.slice(at, 1, F.size(at) - 1)).otherwise(none)
        return F.when(at.isNull(), none).when(x == "..", up).otherwise(F.array_append(at, x))

    path = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(path.isNotNull(), F.array_join(path, "/"))


def dependencies(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """path, to, n: which file (or folder, if it has the very name) each file's local imports mean, and how many of them do. Every candidate looks for its path; the first in order that exists counts."""
    found = modules(files) if found is None else found
    each = found.select("path", F.posexplode("local").alias("k", "name")).withColumn("base", resolved(F.regexp_replace("path", "/?[^/]*\\z", ""), F.col("name"))).where("base is not null")
    wanted = each.select("path", "k", "base", F.posexplode(F.array(*map(F.lit, SUFFIXES))).alias("rank", "suffix")).select("path", "k", "rank", F.concat("base", "suffix").alias("to"))
    parts = F.split("path", "/")
    # files and the folders above them
    there = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("to")).distinct()
    first = wanted.join(there, "to").groupBy("path", "k").agg(F.min_by("to", "rank").alias("to"))
    return first.groupBy("path", "to").agg(F.count("*").alias("n"))


def boundaries(found: DataFrame) -> DataFrame:
    """name, n_files, n_lines, n_exports of every folder, by its first two steps, with two source files or more."""
    parts = F.split("path", "/")
    name = F.array_join(F.slice(parts, 1, 2), "/")
    out = found.groupBy(name.alias("name")).agg(F.count("*").alias("n_files"), F.sum("n_lines").alias("n_lines"), F.sum(F.size("exports")).alias("n_exports"))
    return out.where("n_files >= 2")
