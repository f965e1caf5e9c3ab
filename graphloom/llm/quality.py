"""Operator 7: quality rules with thresholds learnt per language and source.

Each text gets counts of its words, symbols, repeated lines and repeated word
windows. Rates of these are gathered into quantile sketches, one for each
language, source and rate, over all rows. A sketch is a histogram over buckets
that are exact below 64 and 1/32 wide (relatively) above, so sketches merge by
adding counts: any number of partial ones give the same quantiles, whatever the
order.

There are no fixed cutoffs. The fence of a group is Q90 + fence (Q90 - Q50) of its
sketch, shrunk towards that of its language, and that towards the corpus, as if
`prior_rows` further rows had been seen there; so a small group is judged by its
language, a large one by itself, and none by a switch between them. A text is
rejected by a rate that lies above the fence by two standard errors of the count
behind it, (count - 2 sqrt(count)) / base, so that one symbol in a short text of a
source without symbols is no evidence.

Defined results: null text has no words and fails the base rule; null language or
source is a group of its own; ties are of no importance, as all rows beyond a
fence go; repeated rows count as rows; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import SPACED, as_bytes, chunks, runs, sliced, spaced_exact, split_words
from ._shared import settle, small_batches

SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_BLANK = b" \t\n\x0b\x0c\r"


def _dup_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(_BLANK)]
    return len(lines) - len(set(lines))


def counts_of(texts: list[bytes], window: int = 3):
    """A row of COUNTS for each text."""
    for _, part in chunks(texts):
        h, starts, ends, data, offsets, bounds = split_words(spaced_exact, part)
        buf = np.frombuffer(data, np.uint8)
        heads = np.cumsum(np.r_[0, SPACED[buf] & ((buf & 0xC0) != 0x80)])
        signs = np.cumsum(np.r_[0, _SYMBOL[buf]])
        for i, text in enumerate(part):
            a, z = int(offsets[i]), min(int(offsets[i + 1]), len(buf))
            w = h[bounds[i] : bounds[i + 1]]
            repeated = 0
            if len(w) > window:
                r = runs(w, window)
                order = np.argsort(r, kind="stable")
                s = r[order]
                same = s[1:] == s[:-1]
                if same.any():
                    twice = np.zeros(len(s), dtype=bool)
                    twice[1:] = same
                    twice[:-1] |= same
                    inside = np.zeros(len(w), dtype=bool)
                    at = order[twice]
                    for k in range(window):
                        inside[at + k] = True
                    repeated = int(inside.sum())
            yield len(w), int(heads[z] - heads[a]), int(signs[z] - signs[a]), _dup_lines(text), repeated


def text_counts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs and the COUNTS of its text."""
    small_batches(docs.sparkSession)
    keep = keep or []
    picked = docs.select(F.col(text_col).alias("_text"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)))
    kept = [picked.schema[f"_{i}"].dataType.simpleString() for i in range(len(keep))]

    def each(batches):
        for b in sliced(batches):
            rows = np.array(list(counts_of(as_bytes(b.column(0)))), dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(rows[:, k]) for k in range(len(COUNTS)))], [*b.schema.names[1:], *COUNTS])

    out = picked.mapInArrow(each, ", ".join([*(f"_{i} {t}" for i, t in enumerate(kept)), *(f"{c} long" for c in COUNTS)]))
    return out.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(keep)), *COUNTS)


# -- sketches ---------------------------------------------------------------

#: Rates as (count, base, scale): whole thousandths, mean length in hundredths of a character.
RATES = {
    "symbol_rate": ("n_symbols", "n_words", 1000),
    "dup_line_rate": ("n_dup_lines", "n_words", 1000),
    "repeat_rate": ("n_repeat_words", "n_words", 1000),
    "mean_length": ("word_chars", "n_words", 100),
}


def rate(name: str) -> Column:
    """A rate in whole units; 0 where there is nothing to count."""
    count, base, scale = RATES[name]
    return F.expr(f"case when {base} = 0 then 0L else {count} * {scale} div {base} end")


def sure_rate(name: str) -> Column:
    """A rate less two standard errors of its count."""
    count, base, scale = RATES[name]
    return F.when(F.col(base) > 0, (F.col(count) - 2 * F.sqrt(F.col(count))) * scale / F.col(base)).otherwise(F.lit(0.0))


def bucket(x: Column) -> Column:
    """The smallest value of x's sketch bucket."""
    shift = F.greatest(F.length(F.bin(x)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", x, shift), shift)


def sketches(counted: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, rate, bucket, n): a mergeable histogram of each rate of each group."""
    unpivot = ", ".join(f"'{r}', `{r}`" for r in RATES)
    long = counted.select(*groups, *(rate(r).alias(r) for r in RATES)).select(*groups, F.expr(f"stack({len(RATES)}, {unpivot}) as (rate, x)"))
    return long.groupBy(*groups, "rate", bucket(F.col("x")).alias("bucket")).agg(F.count("*").alias("n"))


def _upper_fence(sketch: DataFrame, keys: list[str], fence: int, name: str) -> DataFrame:
    """(keys, rate, name, name_n): Q90 + fence (Q90 - Q50) of each group, and its rows."""
    by = Window.partitionBy(*keys, "rate")
    merged = sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    run = merged.withColumn("upto", F.sum("n").over(by.orderBy("bucket"))).withColumn("total", F.sum("n").over(by))
    at = lambda num, den: F.min(F.when(F.col("upto") * den >= F.col("total") * num, F.col("bucket")))
    high, mid = at(9, 10), at(1, 2)
    return run.groupBy(*keys, "rate").agg((high + fence * (high - mid)).cast("double").alias(name), F.max("total").alias(f"{name}_n"))


def fences(counted: DataFrame, groups: list[str], fence: int = 2, prior_rows: int = 200) -> DataFrame:
    """(groups, rate, fence) from mergeable sketches over all rows.

    The first of `groups` (the language) is what the fence of a group is shrunk towards.
    """
    sketch = sketches(counted, groups)
    own, lang, every = _upper_fence(sketch, groups, fence, "own"), _upper_fence(sketch, groups[:1], fence, "by_lang"), _upper_fence(sketch, [], fence, "every")
    met = own.join(lang, [own[k].eqNullSafe(lang[k]) for k in groups[:1]] + [own["rate"] == lang["rate"]])
    met = met.select(*(own[k] for k in groups), own["rate"], "own", "own_n", "by_lang", "by_lang_n").join(every, "rate")
    shrunk = lambda x, n, to: (F.col(n) * F.col(x) + prior_rows * to) / (F.col(n) + prior_rows)
    return met.select(*groups, "rate", shrunk("own", "own_n", shrunk("by_lang", "by_lang_n", F.col("every"))).alias("fence"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_words: int = 50, max_repeat_percent: int = 50, fence: int = 2, prior_rows: int = 200) -> DataFrame:
    """(id, COUNTS, base_failed, kept, failed_rates) for each row of docs."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    counted = settle(text_counts(plain, "text", ["id", "lang", "source"]))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    limit = fences(counted, ["lang", "source"], fence, prior_rows)
    wide = limit.groupBy("lang", "source").agg(*(F.max(F.when(F.col("rate") == r, F.col("fence"))).alias(f"{r}_fence") for r in RATES))
    wide = wide.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *(f"{r}_fence" for r in RATES))
    joined = counted.join(wide, counted["lang"].eqNullSafe(wide["g_lang"]) & counted["source"].eqNullSafe(wide["g_source"]), "left")
    failed = F.array_compact(F.array(*(F.when(sure_rate(r) > F.col(f"{r}_fence"), F.lit(r)) for r in RATES)))
    return joined.select("id", *COUNTS, base.alias("base_failed"), (~base & (F.size(failed) == 0)).alias("kept"), failed.alias("failed_rates"))
