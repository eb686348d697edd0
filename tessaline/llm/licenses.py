"""License scans, in DataFrame operations only: phrases by word positions, and statements by set containment.

Statements. A block is a line of a text, as the set of its words; a template is a license statement, as a set too. A
block matches if it holds at least `CONTAINED` of a template's words. For statements wrapped over lines, every window of
as many words as a template has is a block for templates of that length, wherever lines break; only texts of several
lines that hold enough of a template's words in all need windows. Template words are counted over the blocks of all
texts and ordered from rare to frequent. A match must share one of the template's first `size - need + 1` words in that
order (prefix filter), have `need` template words in all (length filter), and have enough words left on both sides
after the shared one (positional filter). The templates' prefixes are a table of fixed size that goes to every task.
What passes is verified on the sets; a pair counts at its first shared word only, so it comes out once.

Phrases. Words are runs of digits, letters and characters beyond ASCII; A-Z count as a-z. A regular expression finds
the texts that may have a phrase, positions come from their words.

Null and empty texts have no words, no labels and score 0. Repeated rows give repeated results, an empty table none.
Extra columns are left alone.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.llm.base import table, written

CONTAINED = 0.9

# Phrases and their labels; statements and their labels. No statement's words are all in another one's.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "This project is licensed under the terms of the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "All rights reserved"),
]

#: What separates words, in text as it is.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: The same characters by what they are: Java matches that in half the time.
LETTER = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_sets(templates=None) -> list[tuple[str, list[str]]]:
    import re

    return [(label, sorted(set(re.findall(WORD + "+", text.lower())))) for label, text in templates or TEMPLATES]


def template_lengths(templates=None) -> list[int]:
    """Words of each template, repeated ones too."""
    import re

    return [len(re.findall(WORD + "+", text)) for _, text in templates or TEMPLATES]


def _needed(size: int, contained: float) -> int:
    return math.ceil(contained * size - 1e-9)


def _also(part: str):
    return lambda hit, word: F.coalesce(hit & (word == part), F.lit(False))


def _phrase_places(words: Column, phrase: str) -> Column:
    """Word positions (from 0) at which the phrase starts."""
    first, *rest = phrase.split()
    hit = F.transform(words, lambda w: w == first)
    for k, part in enumerate(rest, 1):
        hit = F.zip_with(hit, F.slice(words, k + 1, F.greatest(F.size(words), F.lit(1))), _also(part))
    return F.array_compact(F.transform(hit, lambda h, i: F.when(h, i.cast("long"))))


def scanned(docs: DataFrame, templates, id_col: str, text_col: str, contained: float = CONTAINED) -> DataFrame:
    """uid, doc_id, n_words, places per phrase, blocks (arrays of template words), and every word where a statement may be wrapped, as a written table."""
    universe = sorted({w for _, ws in template_sets(templates) for w in ws})
    text = F.coalesce(F.col(text_col), F.lit(""))
    phrase = "|".join(f"{GAP}+".join(p.split()) for p in PHRASES)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.withColumns({"n_words": F.regexp_count("text", F.lit(f"{LETTER}+")).cast("long"), "any": F.col("text").rlike(f"(?i)(?:{phrase})")})
    known = lambda w: w.isin(universe)
    lines = F.split("text", "\n")
    blocks = F.transform(lines, lambda t: F.array_distinct(F.filter(F.split(F.lower(t), f"{GAP}+"), known)))
    words = F.when(F.col("any"), F.filter(F.split(F.translate("text", UPPER, LOWER), f"{GAP}+"), lambda w: w != ""))
    rows = rows.withColumns({"blocks": F.filter(blocks, lambda b: F.size(b) > 0), "words": words})
    # a statement over several lines has its words in several blocks
    all_known = F.array_distinct(F.flatten("blocks"))
    enough = [F.size(F.array_intersect("known", F.array(*map(F.lit, ws)))) >= _needed(len(ws), contained) for _, ws in template_sets(templates)]
    rows = rows.withColumn("known", F.when(F.size("blocks") > 1, all_known))
    rows = rows.withColumn("every", F.when(reduce(or_, enough), F.filter(F.split(F.lower("text"), f"{GAP}+"), lambda w: w != "")))
    rows = rows.withColumns({f"at_{k}": _phrase_places(F.col("words"), p) for k, p in enumerate(PHRASES)})
    return written(rows.drop("text", "words", "any", "known"), "licenses")


def windows(rows: DataFrame, templates=None, contained: float = CONTAINED) -> DataFrame:
    """uid, block (-1), tokens and span (words) of the windows of `every` that may hold a statement."""
    universe = sorted({w for _, ws in template_sets(templates) for w in ws})
    least: dict[int, int] = {}
    for n, (_, ws) in zip(template_lengths(templates), template_sets(templates), strict=True):
        least[n] = min(least.get(n, n), _needed(len(ws), contained))

    def of(n: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size("every") - n + 1, F.lit(1)))
        tokens = F.transform(at, lambda i: F.array_distinct(F.filter(F.slice("every", i, n), lambda w: w.isin(universe))))
        return F.transform(F.array_distinct(F.filter(tokens, lambda t: F.size(t) >= least[n])), lambda t: F.struct(F.lit(n).alias("span"), t.alias("tokens")))

    some = rows.where(F.col("every").isNotNull()).select("uid", F.explode(F.concat(*[of(n) for n in least])).alias("w"))
    return some.select("uid", F.lit(-1).alias("block"), "w.tokens", "w.span")


def matches(blocks: DataFrame, templates=None, contained: float = CONTAINED) -> DataFrame:
    """uid, block, label and containment of all blocks (uid, block, tokens: distinct words of the templates) that match.

    Blocks with a span (where there is such a column) match templates of as many words only.
    """
    spark, sets = blocks.sparkSession, template_sets(templates)
    # as many rows as templates have words
    counts = {r["w"]: r["n"] for r in blocks.select(F.explode("tokens").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    universe = sorted({w for _, ws in sets for w in ws}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: k for k, w in enumerate(universe)}
    index, lengths = [], template_lengths(templates)
    span = F.col("span") if "span" in blocks.columns else F.lit(None).cast("int")
    for t, (label, ws) in enumerate(sets):
        ordered = sorted(rank[w] for w in ws)
        need = _needed(len(ordered), contained)
        index += [(t, label, r, pos, len(ordered), need, ordered, lengths[t]) for pos, r in enumerate(ordered[: len(ordered) - need + 1])]
    prefixes = spark.createDataFrame(index, "t int, label string, r int, pos int, size int, need int, template array<int>, length int")
    least = min(row[5] for row in index)
    ranks = F.create_map(*[x for w, k in rank.items() for x in (F.lit(w), F.lit(k))])
    rows = blocks.where(F.size("tokens") >= least).select("uid", "block", span.alias("span"), F.array_sort(F.transform("tokens", lambda w: F.element_at(ranks, w))).alias("own"))
    probes = rows.select("uid", "block", "span", "own", F.posexplode("own").alias("b_pos", "r"))
    left, right = F.col("size") - F.col("pos"), F.size("own") - F.col("b_pos")
    found = probes.join(F.broadcast(prefixes), "r").where(F.coalesce(F.col("span") == F.col("length"), F.lit(True)) & (F.size("own") >= F.col("need")) & (F.least(left, right) >= F.col("need") - F.least("pos", "b_pos")))
    shared = found.withColumn("both", F.array_intersect("own", "template")).where((F.size("both") >= F.col("need")) & (F.array_min("both") == F.col("r")))
    return shared.select("uid", "block", "label", (F.size("both") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, templates=None, contained: float = CONTAINED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row."""
    rows = scanned(docs, templates, id_col, text_col, contained)
    blocks = rows.select("uid", F.posexplode("blocks").alias("block", "tokens")).withColumn("span", F.lit(None).cast("int"))
    blocks = blocks.unionByName(windows(rows, templates, contained))
    by_doc = matches(blocks, templates, contained).groupBy("uid").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    places = F.flatten(F.array(*[F.coalesce(F.col(f"at_{k}"), F.array().cast("array<bigint>")) for k in range(len(PHRASES))]))
    base = F.array_compact(F.array(*[F.when(F.size(F.coalesce(F.col(f"at_{k}"), F.array().cast("array<bigint>"))) > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())]))
    narrow = rows.select("uid", "doc_id", "n_words", places.alias("places"), base.alias("base"))
    joined = narrow.join(by_doc, "uid", "left")
    joined_labels = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return joined.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        joined_labels(F.col("base")).alias("base_labels"),
        joined_labels(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.greatest(F.coalesce("containment", F.lit(0.0)), F.when(F.size("base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    values = ", ".join(f"({k}, '{label}', {ws})" for k, (label, ws) in enumerate(template_sets()))
    gap = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    places = []
    for p in PHRASES:
        parts = p.split()
        test = " and ".join(f"w[(i + {k})::bigint] = '{x}'" for k, x in enumerate(parts, 1))
        places.append(f"list_filter(range(0, greatest(len(w) - {len(parts) - 1}, 0)), lambda i: {test})")
    labels = ", ".join(f"case when len(p[{k}]) > 0 then '{label}' end" for k, label in enumerate(PHRASES.values(), 1))
    return f"""
with d as (
  select row_number() over () as uid, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as text from documents
), w as (select uid, doc_id, text, regexp_extract_all(text, '{gap}') as w from d
), p as (select uid, doc_id, len(w) as n_words, [{", ".join(places)}] as p from w
), b as (
  select *, flatten(p) as places, list_filter([{labels}], lambda x: x is not null) as base from p
), t(t, label, ws) as (values {values}
), l as (select uid, list_distinct(regexp_extract_all(unnest(string_split(text, chr(10))), '{gap}')) as ws from d
), m as (
  select uid, label, len(list_intersect(l.ws, t.ws)) / len(t.ws)::double as c from l join t on len(list_intersect(l.ws, t.ws)) >= ceil({CONTAINED} * len(t.ws) - 1e-9)
), g as (select uid, list(distinct label) as more, max(c) as c from m group by uid)
select doc_id, n_words::bigint as n_words, len(places)::bigint as n_base, list_min(places) as first_word, list_max(places) as last_word,
  array_to_string(list_sort(base), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') as labels,
  greatest(coalesce(c, 0.0), case when len(base) > 0 then 1.0 else 0.0 end)::double as score
from b left join g using (uid)
"""


OP4_SQL = _sql()
