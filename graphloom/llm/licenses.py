"""Operator 10: license scans by an exact set-similarity join.

Base: places where the words of a phrase stand consecutively. Method: every text
block (a line, longer ones in overlapping windows of `block_words` words; with
`across_lines` also such windows of the whole text, for wrapped notices) is joined
with license templates, as sets of words: a block is a match if it holds at least
`percent` percent of a template's words. Every match gives its label, but one whose
words all belong to a fuller match of the same block.

Texts are split once. That pass settles, for each row, its base result and which
template words it has, and keeps the text only if some template could be met by all
of the row's words together. The join works on what is kept. It is exact and prunes by

* prefix: words are ordered by their frequency in the whole corpus, rarest first;
  a template of k words that must share t can miss k - t, so a match holds one of
  its k - t + 1 rarest words. Only texts and blocks with one go on;
* length: a block of fewer than t distinct words can't match;
* position: a block that first meets a template at its i-th rarest word can share
  k - i words at most.

What is left is verified by intersecting the sets. Only DataFrame functions are
used. Templates are a parameter, of at most `MOST_TEMPLATES`, so broadcasting them is
safe; the list of this module is the default. A window is at least twice as long as
the longest template.

Defined results: null text is empty; a phrase place counts each time it stands
there, overlaps included; repeated rows keep their own results; other columns are
not read; a text without any license has empty labels and score 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import settle

# Phrases with the labels they stand for.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Short forms of well-known license notices, by label.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "this work is licensed under the gnu lesser general public license version 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the mit license"),
    ("mpl", "subject to the terms of the mozilla public license version 2 0"),
    ("public-domain", "dedicated to the public domain"),
    ("reserved", "copyright all rights reserved"),
]

#: Templates that may be given: they are broadcast.
MOST_TEMPLATES = 10_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def lowered(text: Column) -> Column:
    """text with A-Z as a-z; other letters may change too, but none into or from an ASCII letter.

    lower() is much faster than translate(), but makes ASCII letters of two others.
    """
    whole = F.coalesce(text, F.lit(""))
    return F.when(whole.contains("\u212a") | whole.contains("\u0130"), F.translate(whole, UPPER, LOWER)).otherwise(F.lower(whole))


def words_of(low: Column) -> Column:
    """The words of a lowered text."""
    return F.filter(F.split(low, _GAP), lambda w: w != "")


def places(line: Column, phrase: str) -> Column:
    """Start positions of a phrase's words in a text with one blank between and around its words.

    The text is split at the phrase once; what lies between the cuts is counted. No
    phrase here overlaps itself.
    """
    n = len(phrase.split(" "))
    counts = F.transform(F.split(line, f" {phrase}(?= )"), lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))))
    before = F.slice(counts, F.lit(1), F.size(counts) - 1)
    start = F.struct(F.lit(0).alias("upto"), F.array().cast("array<int>").alias("at"))
    step = lambda s, c: F.struct((s["upto"] + c + n).alias("upto"), F.concat(s["at"], F.array(s["upto"] + c)).alias("at"))
    return F.aggregate(before, start, step)["at"]


def template_list(templates=None) -> list[tuple[str, str]]:
    """(label, text) of the templates: the default list, another one, or a table of these two columns."""
    if isinstance(templates, DataFrame):
        templates = [tuple(r) for r in templates.select("label", "text").limit(MOST_TEMPLATES + 1).collect()]
    out = [(label, text) for label, text in (TEMPLATES if templates is None else templates) if label is not None and text and text.split()]
    if len(out) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} license templates")
    return out


def plan_templates(frequency: dict[str, int], percent: int, templates=None) -> list[dict]:
    """Each template with its words rarest first, the overlap it asks for and its prefix."""
    out = []
    for label, text in template_list(templates):
        words = sorted(set(text.split()), key=lambda w: (frequency.get(w, 0), w))
        need = (len(words) * percent + 99) // 100
        out.append({"label": label, "words": words, "need": need, "prefix": words[: len(words) - need + 1]})
    return out


def scan_rows(source: DataFrame, plans: list[dict], phrases: dict[str, str]) -> DataFrame:
    """(key, id, n_words, base, present, low) for each row of (id, text), in one pass over the texts.

    base: (label, places) of each phrase; present: the template words of the text;
    low: the lowered text, if all of its words together could meet a template. key
    tells rows apart.
    """
    vocabulary = sorted({w for p in plans for w in p["words"]} | {w for x in phrases for w in x.split(" ")})
    prefix = sorted({w for p in plans for w in p["prefix"]})
    split = source.select("id", lowered(F.col("text")).alias("low")).select("id", "low", words_of(F.col("low")).alias("words"))
    seen = split.withColumn("present", F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary))))
    line = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    stands = lambda phrase: F.size(F.array_intersect("present", F.array(*map(F.lit, phrase.split(" "))))) == len(set(phrase.split(" ")))
    none = F.array().cast("array<int>")
    base = [F.struct(F.lit(label).alias("label"), F.when(stands(phrase), places(line, phrase)).otherwise(none).alias("at")) for phrase, label in phrases.items()]
    table = F.array(*(F.struct(F.array(*map(F.lit, p["words"])).alias("words"), F.lit(p["need"]).alias("need")) for p in plans)) if plans else None
    could = F.lit(False) if table is None else F.arrays_overlap("present", F.array(*map(F.lit, prefix))) & F.exists(table, lambda t: F.size(F.array_intersect("present", t["words"])) >= t["need"])
    return seen.select(F.monotonically_increasing_id().alias("key"), "id", F.size("words").cast("long").alias("n_words"), F.array(*base).alias("base"), "present", F.when(could, F.col("low")).alias("low"))


def blocks_of(block_words: int, across_lines: bool = False) -> Column:
    """The blocks of `low`, a lowered text, as arrays of words."""
    lines = F.filter(F.transform(F.split("low", "\n"), words_of), lambda w: F.size(w) > 0)
    if across_lines:
        lines = F.when(F.size(lines) > 1, F.concat(lines, F.array(F.flatten(lines)))).otherwise(lines)
    step = block_words // 2
    cut = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - step - 1), F.lit(step)), lambda at: F.slice(w, at + 1, F.lit(block_words)))
    return F.flatten(F.transform(lines, cut))


def template_matches(texts: DataFrame, plans: list[dict], block_words: int = 64, across_lines: bool = False) -> DataFrame:
    """(key, block, label, containment, shared words) of every block that meets its threshold.

    texts: (key, low) with low a lowered text. block is the block's number within its
    text.
    """
    spark = texts.sparkSession
    index = spark.createDataFrame([(w, i, k) for i, p in enumerate(plans) for k, w in enumerate(p["prefix"])], "w string, t int, place int")
    template = spark.createDataFrame([(i, p["label"], p["words"], p["need"]) for i, p in enumerate(plans)], "t int, label string, words array<string>, need int")
    prefix = sorted({w for p in plans for w in p["prefix"]})
    blocks = texts.select("key", F.posexplode(blocks_of(block_words, across_lines)).alias("block", "held")).filter(F.exists("held", lambda w: w.isin(prefix))).select("key", "block", F.array_distinct("held").alias("held"))
    met = blocks.select("key", "block", "held", F.explode("held").alias("w")).join(F.broadcast(index), "w").join(F.broadcast(template), "t")
    # a template meets a block at the rarest prefix word that they share
    ahead = lambda: F.exists(F.slice("words", 1, F.col("place")), lambda w: F.array_contains("held", w))
    met = met.filter((F.size("held") >= F.col("need")) & (F.size("words") - F.col("place") >= F.col("need"))).filter(~ahead())
    shared = F.array_intersect("words", "held")
    return met.filter(F.size(shared) >= F.col("need")).select("key", "block", "label", (F.size(shared) / F.size("words")).alias("containment"), shared.alias("shared"))


def block_labels(matches: DataFrame) -> DataFrame:
    """(key, more, best): labels of each text.

    Every match of a block counts, but one whose words all belong to a fuller match.
    """
    held = matches.groupBy("key", "block").agg(F.max("containment").alias("best"), F.collect_set(F.struct("label", "containment", "shared")).alias("found"))
    explains = lambda y, x: (y["containment"] > x["containment"]) & (F.size(F.array_except(x["shared"], y["shared"])) == 0)
    kept = F.transform(F.filter("found", lambda x: ~F.exists("found", lambda y: explains(y, x))), lambda x: x["label"])
    return held.select("key", "best", F.explode(kept).alias("label")).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("best").alias("best"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, block_words: int = 64, across_lines: bool = False, templates=None) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = template_list(templates)
    block_words = max([block_words, *(2 * len(text.split()) for _, text in known)])
    # any order of words is right for a filter; which words are rare is known after the pass
    rows = settle(scan_rows(source, plan_templates({}, percent, known), PHRASES))
    n = rows.select(F.explode("present").alias("w")).groupBy("w").count()
    plans = plan_templates({r["w"]: r["count"] for r in n.collect()}, percent, known)
    prefix = sorted({w for p in plans for w in p["prefix"]})
    if plans:
        maybe = rows.filter(F.col("low").isNotNull() & F.arrays_overlap("present", F.array(*map(F.lit, prefix)))).select("key", "low")
        more = block_labels(template_matches(maybe, plans, block_words, across_lines))
    else:
        more = docs.sparkSession.createDataFrame([], "key long, more array<string>, best double")
    base = rows.select("key", "id", "n_words", F.flatten(F.transform("base", lambda x: x["at"])).alias("at"), F.transform(F.filter("base", lambda x: F.size(x["at"]) > 0), lambda x: x["label"]).alias("base"))
    none = F.array().cast("array<string>")
    joined = base.join(more, "key", "left")
    text = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select(
        "id", "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        text(F.col("base")).alias("base_labels"), text(F.concat("base", F.coalesce("more", none))).alias("labels"), score.alias("score"),
    )
