"""Graphs of references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut


def expand(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """id, hop: what seeds reach in at most `depth` steps, each at its nearest hop."""
    seen = seeds.select("id", F.lit(0).alias("hop"))
    front = seen
    for hop in range(1, depth + 1):
        front = front.join(edges, front["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct().withColumn("hop", F.lit(hop))
        seen = seen.unionByName(front)
    return seen.groupBy("id").agg(F.min("hop").alias("hop"))


def trimmed(edges: DataFrame) -> DataFrame:
    """edges without those that can't lie on a cycle because nothing leads to their source or their target leads nowhere, again and again."""
    edges = cut(edges.where("src <> dst").select("src", "dst").distinct(), "trimmed")
    n = edges.count()
    while n:
        entered, left = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = cut(edges.join(entered, "src", "left_semi").join(left, "dst", "left_semi").select("src", "dst"), "trimmed")
        before, n = n, edges.count()
        if n == before:
            break
    return edges


def strong(edges: DataFrame) -> DataFrame:
    """id, component (its smallest id) of every record in a strong component of two or more.

    What can't lie on a cycle is trimmed. Then each record takes the largest id
    that leads to it as its colour, and what leads back to that id within its
    colour is the id's component. Those records go, as do edges between colours,
    and the rest is trimmed again. The rounds follow the length of paths; a round's
    tables are no larger than the edges.
    """
    found = edges.sparkSession.createDataFrame([], "id long, root long")
    rest = trimmed(edges)
    while not rest.isEmpty():
        colours = cut(rest.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.col("id").alias("colour"), F.lit(True).alias("new")), "colours")
        while not colours.where("new").isEmpty():
            told = colours.where("new").join(rest, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("heard"))
            more = F.coalesce(F.col("heard") > F.col("colour"), F.lit(False))
            colours = cut(colours.join(told, "id", "left").select("id", F.when(more, F.col("heard")).otherwise(F.col("colour")).alias("colour"), more.alias("new")), "colours")
        of = lambda end: colours.select(F.col("id").alias(end), F.col("colour").alias(f"{end}_colour"))
        inner = cut(rest.join(of("src"), "src").join(of("dst"), "dst").where("src_colour = dst_colour").select("src", "dst", F.col("src_colour").alias("root")), "inner")
        reached = cut(colours.where("id = colour").select("id", F.col("colour").alias("root"), F.lit(True).alias("new")), "reached")
        while not reached.where("new").isEmpty():
            back = reached.where("new").select(F.col("id").alias("dst"), "root").join(inner, ["dst", "root"]).select(F.col("src").alias("id"), "root", F.lit(True).alias("new"))
            reached = cut(reached.select("id", "root", F.lit(False).alias("new")).unionByName(back).groupBy("id", "root").agg(F.bool_and("new").alias("new")), "reached")
        found = found.unionByName(reached.select("id", "root"))
        done = reached.select("id")
        rest = trimmed(inner.join(done.select(F.col("id").alias("src")), "src", "left_anti").join(done.select(F.col("id").alias("dst")), "dst", "left_anti"))
    smallest = found.groupBy("root").agg(F.min("id").alias("component"), F.count("*").alias("n")).where("n > 1")
    return found.join(smallest, "root").select("id", "component")


#: Sources that share a row of reach(), and steps along edges between two writes of its state.
WORD, HOPS = 64, 4
#: Rows that reach() may have at worst before strong components are looked for first.
MAX_REACH = 20_000_000


def reach(edges: DataFrame, blocks: int = 1) -> DataFrame:
    """id, w, bits: bit k of bits says that the record w * 64 + k leads to id, along a path of any length.

    A row holds 64 sources, so there are far fewer rows than pairs; each round
    only passes on bits that are new, a few steps far. blocks: the sources go in so
    many parts, one after the other, which bounds a round's rows.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("src", F.lit(WORD)).cast("int"))
    begin = edges.select(F.col("dst").alias("id"), F.shiftright("src", 6).alias("w"), bit.alias("bits"))
    none = F.lit(0).cast("long")
    out = None
    for block in range(blocks):
        own = begin.where(F.pmod("w", F.lit(blocks)) == block).groupBy("id", "w").agg(F.bit_or("bits").alias("bits"))
        state = cut(own.withColumn("new", F.col("bits")), "reach")
        while not (front := state.where("new <> 0").select("id", "w", "new")).isEmpty():
            both = state.select("id", "w", "bits", none.alias("new"))
            for _ in range(HOPS):
                front = front.join(edges, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id"), "w").agg(F.bit_or("new").alias("new"))
                both = both.unionByName(front.select("id", "w", none.alias("bits"), "new"))
            both = both.groupBy("id", "w").agg(F.bit_or("bits").alias("bits"), F.bit_or("new").alias("new"))
            state = cut(both.select("id", "w", F.col("bits").bitwiseOR(F.col("new")).alias("bits"), F.col("new").bitwiseAND(F.bitwise_not("bits")).alias("new")), "reach")
        out = state if out is None else out.unionByName(state)
    return out.select("id", "w", "bits")


def impact(edges: DataFrame, blocks: int = 1, condense: bool | None = None) -> DataFrame:
    """id, dependents (different records that lead to it) and impact (the in-degrees of it and them summed).

    With condense, strong components are one record each while reach is worked
    out, as all their members have the same records before them; unless said, that
    is done where the records are many enough for their pairs to matter.
    """
    edges = cut(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    degree = cut(edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree")), "degrees")
    if condense is None:
        condense = degree.count() ** 2 / WORD > MAX_REACH
    parts = cut(strong(edges), "components") if condense else None
    if parts is None or parts.isEmpty():
        nodes, condensed = degree.select("id", F.col("id").alias("c"), "degree"), edges
    else:
        of = lambda end: parts.select(F.col("id").alias(end), F.col("component").alias(f"{end}_c"))
        condensed = edges.join(of("src"), "src", "left").join(of("dst"), "dst", "left").select(F.coalesce("src_c", "src").alias("src"), F.coalesce("dst_c", "dst").alias("dst"))
        condensed = cut(condensed.where("src <> dst").distinct(), "condensed")
        nodes = degree.join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("c"), "degree")
    # a component has members in nodes only if something leads to them, and so all of them are there
    sums = cut(nodes.groupBy("c").agg(F.count("*").alias("n"), F.sum("degree").alias("all_degree")), "sums")
    weights = sums.groupBy(F.shiftright("c", 6).alias("w")).agg(F.map_from_entries(F.collect_list(F.struct(F.pmod("c", F.lit(WORD)).cast("int"), F.struct("n", "all_degree")))).alias("by_bit"))
    # a record on a cycle leads to itself, but isn't one of its dependents
    own = F.when(F.shiftright("id", 6) == F.col("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("id", F.lit(WORD)).cast("int"))).otherwise(F.lit(0).cast("long"))
    seen = reach(condensed, blocks).withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(own)))
    bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda k: F.call_function("getbit", F.col("bits"), k) == 1)
    met = seen.where("bits <> 0").withColumn("set", bits).join(weights, "w", "left")
    of_bit = lambda k, name, other: F.coalesce(F.try_element_at("by_bit", k)[name], F.lit(other))
    total = lambda name, other: F.aggregate("set", F.lit(0).cast("long"), lambda a, k: a + of_bit(k, name, other))
    before = met.select(F.col("id").alias("c"), total("n", 1).alias("before"), total("all_degree", 0).alias("more")).groupBy("c").agg(F.sum("before").alias("before"), F.sum("more").alias("more"))
    out = nodes.join(sums, "c").join(before, "c", "left").fillna(0, ["before", "more"])
    return out.select("id", (F.col("before") + F.col("n") - 1).alias("dependents"), (F.col("all_degree") + F.col("more")).alias("impact"))


def orphans(records: DataFrame, edges: DataFrame) -> DataFrame:
    """Records with no edge in or out."""
    out = records.select("id").join(edges.select(F.col("src").alias("id")), "id", "left_anti")
    return out.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def on_cycles(edges: DataFrame) -> DataFrame:
    """Records that lead back to themselves."""
    return strong(edges).select("id").unionByName(edges.where("src = dst").select(F.col("src").alias("id"))).distinct()


def cycles(edges: DataFrame) -> DataFrame:
    """n, cycle: for each record on a cycle the shortest cycle through it (of equals the one of the smallest ids), from its smallest record on, without repeats.

    Searches stay within a strong component, and a record's ends with its first cycle.
    """
    parts = cut(strong(edges), "components")
    of = lambda end: parts.select(F.col("id").alias(end), F.col("component").alias(f"{end}_c"))
    inner = cut(edges.where("src <> dst").join(of("src"), "src").join(of("dst"), "dst").where("src_c = dst_c").select("src", "dst").distinct(), "inner")
    front = inner.select(F.col("src").alias("start"), F.col("dst").alias("at"), F.array("src", "dst").alias("path"))
    seen, found = front.select("start", "at"), None
    while True:
        front = cut(front, "front")
        if front.isEmpty():
            break
        step = cut(front.join(inner, F.col("at") == F.col("src")).groupBy("start", F.col("dst").alias("at")).agg(F.min("path").alias("path")), "step")
        closed = step.where("at = start").select("start", "path")
        found = closed if found is None else found.unionByName(closed)
        onward = step.join(seen, ["start", "at"], "left_anti").join(closed.select("start"), "start", "left_anti")
        front = onward.select("start", "at", F.array_append("path", F.col("at")).alias("path"))
        seen = cut(seen.unionByName(front.select("start", "at")), "seen")
    loops = edges.where("src = dst").select(F.array("src").alias("path")).distinct()
    paths = loops if found is None else found.select("path").unionByName(loops)
    k = F.array_position("path", F.array_min("path")).cast("int")
    turned = F.concat(F.slice("path", k, F.size("path") - k + 1), F.slice("path", F.lit(1), k - 1))
    return paths.select(F.size("path").cast("long").alias("n"), turned.alias("cycle")).distinct()


def mermaid(records: DataFrame, edges: DataFrame) -> DataFrame:
    """part, a, b, line: the lines of a diagram of records (id, key, type), their edges and marks of those on cycles, in the order of part, a, b."""
    name = lambda c: F.regexp_replace(c, "[^a-zA-Z0-9_]", "_")
    row = lambda part, a, b, line: [F.lit(part).alias("part"), F.col(a).alias("a"), b.cast("long").alias("b"), line.alias("line")]
    none = F.lit(0)
    nodes = records.select(*row(0, "id", none, F.concat(F.lit("  "), name("key"), F.lit('["'), F.col("key"), F.lit(" ["), F.col("type"), F.lit(']"]'))))
    keys = lambda end: records.select(F.col("id").alias(end), name("key").alias(f"{end}_name"))
    links = edges.join(keys("src"), "src").join(keys("dst"), "dst").select(*row(1, "src", F.col("dst"), F.concat(F.lit("  "), "src_name", F.lit(" --> "), "dst_name")))
    marks = on_cycles(edges).join(records, "id").select(*row(2, "id", none, F.concat(F.lit("  style "), name("key"), F.lit(" fill:#ff6b6b,stroke:#cc0000"))))
    return nodes.unionByName(links).unionByName(marks)


def chains(edges: DataFrame, longest: int) -> DataFrame:
    """n, path of all simple chains from records that nothing leads to, of at most `longest` records. Their number can grow as a power of it, so it is the caller's bound."""
    starts = edges.join(edges.select(F.col("dst").alias("src")), "src", "left_anti")
    front = cut(starts.select(F.array("src", "dst").alias("path")), "chains")
    out = front
    for _ in range(longest - 2):
        step = front.withColumn("src", F.element_at("path", -1)).join(edges, "src").where(~F.array_contains("path", F.col("dst")))
        front = cut(step.select(F.array_append("path", F.col("dst")).alias("path")), "chains")
        out = out.unionByName(front)
    return out.select(F.size("path").alias("n"), "path")
