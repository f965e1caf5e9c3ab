"""Operator 4: URL filters: rules first, then segmented host and path words.

Rules are a host and a path prefix; the longest that fits decides. Any other url
is judged by a multinomial naive Bayes classifier over its tokens: host names are
split into words by a unigram Viterbi search (so `cheappills` reads as `cheap
pills`), paths are cut at what is no letter. Both models are trained here, on the
whole table, and neither has a size limit: they are tables that are joined, and
broadcast only where a count shows them small.

* Lexicon. A word of three letters or more is evident where it stands apart (parts
  of hyphenated labels, path words that are no label of their own host; once for
  each host) and where two or more different names hold it. From these counts names
  are split, and the counts taken again from the words of the splits, for `rounds`
  rounds (Viterbi training). A name in one piece is one name however many rows have
  it. After each recount, a word that never stands apart and splits into words each
  more frequent than itself is dropped, so a frequent concatenation is no word of its
  own. Seed words are always in.
* Classifier. It learns from hosts that hold a seed word after the split (blocked)
  and from all other urls (allowed), with Laplace smoothing; a url is blocked at
  `margin` or more in log-odds. Weights are whole millionths, so sums do not depend
  on their order.

Hosts are split once each, not once a row, and counts are combined before each
shuffle, so a host with a third of all rows is a number.

Defined results: a null url and one without `://` have an empty host and path, no
rule, and are allowed; names longer than 63 letters, which DNS does not allow, are
one word; equally probable splits prefer the longer last word; repeated rows keep
their own results; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import if_small, settle

# Fixed values: (verdict, host, path).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

# Words that mark unwanted hosts.
SEEDS = "adult bet betting casino cheap escort farm gambling loan loans lottery malware phishing pills pharma poker porn replica sex slots spam viagra warez xxx".split()

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "[^a-z]+"
#: Letters of a word at least, as language codes would cut names anywhere, and of a name at most.
SHORTEST, LONGEST = 3, 63
#: Cost of each letter that no word of the lexicon covers.
UNKNOWN_LETTER = 2.5
MICRO = 1_000_000


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=None) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    out = None
    for verdict, h, p in sorted(rules or RULES, key=lambda r: (-len(r[1]) - len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


# -- segmentation -------------------------------------------------------------


def viterbi(name: str, cost: dict[str, float], unknown: float) -> tuple[str, ...]:
    """The cheapest split of a name; a piece that is no word costs `unknown` and more for each letter."""
    best, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        options = [(best[at] + (cost[w] if (w := name[at:end]) in cost else unknown + UNKNOWN_LETTER * (end - at)), at) for at in range(end)]
        least, at = min(options)
        best.append(least)
        back.append(at)
    out, at = [], len(name)
    while at:
        out.append(name[back[at] : at])
        at = back[at]
    return tuple(reversed(out))


class Segmenter:
    """Unigram Viterbi over a lexicon in memory: word to count."""

    def __init__(self, counts: dict[str, int]):
        self.total = lexicon_total(sum(counts.values()), len(counts))
        self.cost = {w: word_cost(n, self.total) for w, n in counts.items()}

    def words(self, name: str) -> tuple[str, ...]:
        return viterbi(name, self.cost, math.log(self.total)) if len(name) <= LONGEST else (name,)


def lexicon_total(occurrences: int, words: int) -> int:
    return occurrences + words + 1


def word_cost(n: int, total: int) -> float:
    return -math.log((n + 1) / total)


def _labels(host: Column) -> Column:
    """The letter parts of each label of a host."""
    return F.transform(F.split(host, r"\."), lambda x: F.filter(F.split(x, _PARTS), lambda w: w != ""))


def parts_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _PARTS), lambda w: w != "")


def _seeds(spark) -> DataFrame:
    return spark.createDataFrame([(w, 1) for w in SEEDS], "word string, n long")


def words_apart(urls: DataFrame) -> DataFrame:
    """(word, n): hosts in which a word stands apart; urls: (host, path)."""
    labels = _labels(F.col("host"))
    whole = F.flatten(F.filter(labels, lambda x: F.size(x) == 1))
    apart = F.flatten(F.filter(labels, lambda x: F.size(x) > 1))
    found = F.concat(apart, F.filter(parts_of(F.col("path")), lambda w: ~F.array_contains(whole, w)))
    pairs = urls.select("host", F.explode(found).alias("word")).filter(F.length("word").between(SHORTEST, LONGEST)).distinct()
    return pairs.groupBy("word").agg(F.count("*").alias("n"))


def _pieces(names: DataFrame) -> DataFrame:
    """(name, at, word): every piece of a name that could be a word."""
    size = F.length("name")
    spans = F.flatten(F.transform(F.sequence(F.lit(0), size - SHORTEST), lambda at: F.transform(F.sequence(F.lit(SHORTEST), size - at), lambda k: F.struct(at.alias("at"), k.alias("k")))))
    return names.filter(size.between(SHORTEST, LONGEST)).select("name", F.explode(spans).alias("s")).select("name", "s.at", F.substring(F.col("name"), F.col("s.at") + 1, F.col("s.k")).alias("word"))


def _split(names: DataFrame, pieces: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) by a search of each name with the words that it holds."""
    n, words = counts.agg(F.sum("n"), F.count("*")).first()
    total = lexicon_total(n, words)
    held = pieces.select("name", "word").distinct().join(if_small(counts), "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("held"))

    def each(batches):
        unknown = math.log(total)
        for b in batches:
            out = []
            for name, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out.append(viterbi(name, {x["word"]: word_cost(x["n"], total) for x in held or []}, unknown) if len(name) <= LONGEST else (name,))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], ["name", "words"])

    return names.join(held, "name", "left").mapInArrow(each, "name string, words array<string>")


def _compounds(counts: DataFrame, fixed: DataFrame) -> DataFrame:
    """(word): what never stands apart and splits into words that are each more frequent."""
    long = counts.filter(F.length("word") >= 2 * SHORTEST).join(fixed.select("word"), "word", "left_anti").select(F.col("word").alias("name"), F.col("n").alias("own"))
    more = _pieces(long.select("name")).filter("word <> name").distinct().join(if_small(counts), "word").join(long, "name").filter("n > own")
    held = more.groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("held"))

    def each(batches):
        for b in batches:
            out = []
            for name, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                # pieces that are no such word cost more than any split without them
                words = viterbi(name, {x["word"]: word_cost(x["n"], 1 << 62) for x in held}, 1e6)
                if {x["word"] for x in held}.issuperset(words):
                    out.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["word"])

    return held.mapInArrow(each, "word string")


def train_segments(urls: DataFrame, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """The lexicon (word, n) and the split of every name (name, words); urls: (host, path)."""
    names = settle(urls.select(F.explode(F.flatten(_labels(F.col("host")))).alias("name")).distinct())
    fixed = settle(words_apart(urls).union(_seeds(urls.sparkSession)).groupBy("word").agg(F.sum("n").alias("n")))
    pieces = settle(_pieces(names))
    shared = pieces.select("name", "word").distinct().groupBy("word").agg(F.count("*").alias("n")).filter("n > 1")
    add = lambda found: settle(found.union(fixed).groupBy("word").agg(F.sum("n").alias("n")))
    counts = add(shared)
    for k in range(rounds):
        split = settle(_split(names, pieces, counts))
        if k + 1 < rounds:
            # only words that the lexicon had are counted again; what it did not have is no evidence of itself
            used = split.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
            counts = add(used.join(counts.select("word"), "word", "left_semi"))
            counts = settle(counts.join(_compounds(counts, fixed), "word", "left_anti"))
    return counts, split


def lexicon(urls: DataFrame, rounds: int = 3) -> dict[str, int]:
    """The trained lexicon in memory, for inspection."""
    return {r["word"]: r["n"] for r in train_segments(urls, rounds)[0].toLocalIterator()}


# -- classifier -----------------------------------------------------------------


def host_words(urls: DataFrame, split: DataFrame) -> DataFrame:
    """(host, words, seeded) for each distinct host."""
    parts = urls.select("host").distinct().select("host", F.posexplode_outer(F.flatten(_labels(F.col("host")))).alias("at", "name"))
    found = parts.join(if_small(split), "name", "left").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("ws"))
    words = F.flatten(F.filter(F.transform("ws", lambda x: x["words"]), lambda w: w.isNotNull()))
    return found.select("host", words.alias("words")).withColumn("seeded", F.arrays_overlap("words", F.array(*map(F.lit, SEEDS))))


def train_weights(hosts: DataFrame, paths: DataFrame) -> tuple[DataFrame, int]:
    """(token, weight) in millionths of log-odds, and the prior's log-odds.

    hosts: (seeded, tokens, n); paths: (seeded, tokens, n), n urls each. A token
    counts once for each url.
    """
    blocked, allowed = hosts.agg(*(F.coalesce(F.sum(F.when(F.col("seeded") == k, F.col("n"))), F.lit(0)) for k in (True, False))).first()
    counts = hosts.union(paths).select("seeded", "n", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(*(F.coalesce(F.sum(F.when(F.col("seeded") == k, F.col("n"))), F.lit(0)).alias(c) for k, c in ((True, "blocked"), (False, "allowed"))))
    counts = settle(counts)
    size, in_blocked, in_allowed = counts.agg(F.count("*"), F.coalesce(F.sum("blocked"), F.lit(0)), F.coalesce(F.sum("allowed"), F.lit(0))).first()
    odds = F.log((F.col("blocked") + 1) / F.lit(in_blocked + size + 1)) - F.log((F.col("allowed") + 1) / F.lit(in_allowed + size + 1))
    return counts.select("token", F.round(odds * MICRO).cast("long").alias("weight")), round(math.log((blocked + 1) / (allowed + 1)) * MICRO)


def _sums(table: DataFrame, keys: list[str], weights: DataFrame, name: str) -> DataFrame:
    """(keys, name): the weights of each row's distinct tokens, added up; rows have distinct keys."""
    tokens = table.select(*keys, F.explode(F.array_distinct("tokens")).alias("token"))
    return tokens.join(if_small(weights), "token").groupBy(*keys).agg(F.sum("weight").alias(name))


def _tagged(tag: str, words: Column) -> Column:
    return F.transform(words, lambda w: F.concat(F.lit(tag), w))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", margin: float = 0.0, rules=None, rounds: int = 3) -> DataFrame:
    """(id, host, path, rule, verdict, score) for each row of pages."""
    named = pages.select(F.col(id_col).cast("long").alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    _, split = train_segments(named, rounds)
    words = settle(host_words(named, split))
    # what a path says is the set of its parts, of which many rows have the same
    said = named.select("id", "host", "path", F.array_sort(F.array_distinct(parts_of(F.col("path")))).alias("said"))
    per_host = named.groupBy("host").agg(F.count("*").alias("n"))
    hosts = words.join(per_host, "host").select("seeded", _tagged("h:", F.col("words")).alias("tokens"), "n")
    per_path = said.join(if_small(words.select("host", "seeded")), "host").groupBy("seeded", "said").agg(F.count("*").alias("n"))
    per_path = settle(per_path)
    weights, prior = train_weights(hosts, per_path.select("seeded", _tagged("p:", F.col("said")).alias("tokens"), "n"))
    weights = settle(weights)
    by_host = settle(_sums(words.select("host", _tagged("h:", F.col("words")).alias("tokens")), ["host"], weights, "of_host"))
    by_path = settle(_sums(per_path.select("said").distinct().select("said", _tagged("p:", F.col("said")).alias("tokens")), ["said"], weights, "of_path"))
    scored = said.join(if_small(by_host), "host", "left").join(if_small(by_path), "said", "left")
    score = (F.lit(prior) + F.coalesce("of_host", F.lit(0)) + F.coalesce("of_path", F.lit(0))) / F.lit(float(MICRO))
    ruled = scored.select("id", "host", "path", score.alias("score"), rule_of(F.col("host"), F.col("path"), rules).alias("by_rule"))
    blocked = (F.col("score") >= margin) & (F.col("host") != "")
    verdict = F.coalesce("by_rule.verdict", F.when(blocked, "block").otherwise("allow"))
    return ruled.select("id", "host", "path", F.col("by_rule.rule").alias("rule"), verdict.alias("verdict"), "score")
