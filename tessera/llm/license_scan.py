"""Licence scan by Dice coefficient over word bigrams, in DataFrame expressions only.

Every line of a text, every sentence of a line of several, and every block of
lines between blank lines, is normalised (lower case; everything but letters and digits becomes one space)
and compared with licence templates normalised alike. Dice is twice the common
distinct word bigrams over the sum of both sizes. A score of at least d needs a
size within [d / (2 - d), (2 - d) / d] of the template's, so a unit meets only
templates of such sizes.

It also misses at most a share of (2 - 2d) / (2 - d) of a template's distinct
bigrams. So each template has a few words (`anchors`) that stand in more of its
bigrams than may be missing: a unit without any anchor matches nothing, and a
text without any is left at once.

Defined results: null and empty texts and units of fewer than two words match
nothing; a unit gives one row for each template that it reaches; repeated rows
give repeated matches; an empty table gives an empty table; other columns of
the documents are ignored. A block of one line is that line and isn't listed
twice, and neither is the sentence of a line of one. A sentence ends with one of
`.;:!?` and a space or tab (or with the character U+0001).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_DICE = 0.8

# Notices by which texts state their licences.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "gpl-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "lgpl-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "agpl-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
}


#: Ends a sentence in normalised texts.
STOP = "\x01"
ENDS = "[.;:!?][ \\t]+"
# Words of running text, no hint of a licence.
COMMON = set("of and to in for a an the or by is this that with be as at you it are may not any all such from on its under".split())


def plain(text):
    """Lower case, with STOP for each end of a sentence and one space for each run of other characters than letters, digits and line feeds."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), ENDS, STOP), "[^\\p{L}\\p{N}\\n\\x01]+", " ")


def template_bigrams(text: str) -> list[str]:
    w = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def anchors(grams: list[str], min_dice: float) -> set[str]:
    """A few words, not the common ones if others do, that stand in more of the bigrams than a match may miss."""
    missing = int((2 - 2 * min_dice) / (2 - min_dice) * len(grams) + 1e-9)
    left, out = [set(g.split(" ")) for g in grams], set()
    while len(grams) - len(left) <= missing:
        best = max({w for g in left for w in g}, key=lambda w: (w not in COMMON, sum(w in g for g in left), len(w), w))
        out.add(best)
        left = [g for g in left if best not in g]
    return out


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, min_dice: float = MIN_DICE) -> DataFrame:
    """doc_id, unit (line, sentence or block), unit_no from 0, license, template_no, dice for all units that reach a template."""
    known = [(name, k, template_bigrams(t)) for name, texts in sorted(templates.items()) for k, t in enumerate(texts)]
    known = [x for x in known if x[2]]
    reach = (2 - min_dice) / min_dice + 1e-9
    low, high = min(len(x[2]) for x in known) / reach, max(len(x[2]) for x in known) * reach
    hints = sorted(set().union(*[anchors(x[2], min_dice) for x in known]))
    hinted = f"(?<![\\p{{L}}\\p{{N}}])(?:{'|'.join(hints)})(?![\\p{{L}}\\p{{N}}])"
    some = docs.where(F.lower("text").rlike(hinted)).select("doc_id", "text")
    marked = plain(F.col("text"))
    text = F.translate(marked, STOP, " ")
    blocks = F.split(text, "\\n ?\\n[ \\n]*")
    sentences = F.flatten(F.transform(F.filter(F.split(marked, "\\n"), lambda x: x.contains(STOP)), lambda x: F.split(x, STOP)))

    def units(pieces, kind, wanted):
        made = F.transform(pieces, lambda x, i: F.struct(F.lit(kind).alias("unit"), i.cast("long").alias("unit_no"), x.alias("u")))
        return F.filter(made, lambda x: wanted(x) & x["u"].rlike(hinted))

    # a unit of w words has at most w - 1 bigrams, a block counts only if it has a line feed within
    lines = units(F.split(text, "\\n"), "line", lambda x: F.length(x["u"]) > 2 * low)
    parts = units(sentences, "sentence", lambda x: F.length(x["u"]) > 2 * low)
    several = units(blocks, "block", lambda x: F.trim(x["u"]).contains("\n"))
    # the outer forms, or filters on the arrays' sizes would compute them once more below
    d = some.select("doc_id", F.explode_outer(F.concat(lines, parts, several)).alias("x")).select("doc_id", "x.unit", "x.unit_no", F.array_remove(F.split("x.u", "[ \\n]+"), "").alias("w"))
    d = d.where(F.size("w") > low)
    n_pairs = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("w", 1, n_pairs), F.slice("w", 2, n_pairs), lambda a, b: F.concat_ws(" ", a, b))
    # only units whose words can give a fitting size are worth the bigrams; repeats can make any long unit fit, so those are counted as distinct first
    d = d.where((F.size("w") - 1 <= high) | (F.size(F.array_distinct("w")) <= high + 1))
    d = d.withColumn("b", F.array_distinct(pairs)).where((F.size("b") >= low) & (F.size("b") <= high))

    def found(name, no, grams):
        own = F.array(*[F.lit(g) for g in grams])
        fits = (F.size("b") * reach >= len(grams)) & (F.size("b") <= len(grams) * reach)
        return F.when(fits, F.struct(F.lit(name).alias("license"), F.lit(no).alias("template_no"), (2.0 * F.size(F.array_intersect("b", own)) / (F.size("b") + len(grams))).alias("dice")))

    d = d.select("doc_id", "unit", "unit_no", F.explode_outer(F.array(*[found(*x) for x in known])).alias("m"))
    return d.where(F.col("m.dice") >= min_dice).select("doc_id", "unit", "unit_no", "m.license", "m.template_no", "m.dice")


def op5_license_scan(spark, sf_dir):
    from .common import table

    return scan(table(spark, sf_dir, "documents"))


def sql(templates: dict[str, list[str]] = TEMPLATES, min_dice: float = MIN_DICE) -> str:
    """The same in DuckDB SQL, comparing every unit with every template."""
    rows = ", ".join("('{}', {}, '{}')".format(n, k, t.replace("'", "''")) for n, x in sorted(templates.items()) for k, t in enumerate(x))
    norm = "regexp_replace(regexp_replace(lower({}), '[.;:!?][ \\t]+', chr(1), 'g'), '[^\\p{{L}}\\p{{N}}\\n\\x01]+', ' ', 'g')"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH t(license, template_no, raw) AS (VALUES {rows}),
tb AS (SELECT license, template_no::INT AS template_no, {grams} AS tg FROM (SELECT license, template_no, list_filter(string_split(replace({norm.format("raw")}, chr(1), ' '), ' '), lambda x: x <> '') AS w FROM t)),
m AS (SELECT doc_id, {norm.format("coalesce(text, '')")} AS x FROM documents),
d AS (SELECT doc_id, replace(x, chr(1), ' ') AS x FROM m),
u AS (
  SELECT doc_id, 'line' AS unit, i - 1 AS unit_no, l[i] AS u FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(x, chr(10)) AS l FROM d))
  UNION ALL
  SELECT doc_id, 'sentence', i - 1, l[i] FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, flatten(list_transform(list_filter(string_split(x, chr(10)), lambda y: contains(y, chr(1))), lambda y: string_split(y, chr(1)))) AS l FROM m))
  UNION ALL
  SELECT doc_id, 'block', i - 1, l[i] FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(x, '\\n ?\\n[ \\n]*') AS l FROM d)) WHERE contains(trim(l[i]), chr(10))),
g AS (SELECT doc_id, unit, unit_no, {grams} AS b FROM (SELECT doc_id, unit, unit_no, list_filter(regexp_split_to_array(u, '[ \\n]+'), lambda y: y <> '') AS w FROM u))
SELECT doc_id, unit, unit_no, license, template_no, 2.0::DOUBLE * len(list_intersect(b, tg)) / (len(b) + len(tg)) AS dice
FROM g, tb WHERE len(b) > 0 AND 2.0 * len(list_intersect(b, tg)) >= {min_dice} * (len(b) + len(tg))
"""
