"""Operator 1: token counts by a map-side two-tier lookup.

The token count of a text is the sum over its pre-tokens. Tier one is a broadcast
table of the corpus's frequent pre-tokens with their lengths in tokens, of bounded
size; tier two is a cache in each worker, filled by encoding what tier one misses.
Pre-tokens are never shuffled. The table comes from heavy-hitter summaries of all
texts: a bounded one for each partition, merged in a tree, so neither a task nor
the driver holds more than a few summaries. It only saves time: counts do not
depend on it.

Pre-tokens are found by `re` where that agrees with the library's normaliser and
splitter (texts in Latin letters), and by the library's own elsewhere; both kinds go
through the two tiers. Only texts that may hold a special token, and all texts of
tokenizers without a splitter, are encoded as a whole.

Defined results: null and empty texts have 0 tokens; special strings in a text
count as the library's default has them; texts are never cut; each row keeps its
result, repeated or not; other columns are not read.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the broadcast table, and of each partial summary.
TABLE = 1 << 16
SUMMARY = 1 << 15
#: Entries of a worker's cache beyond which it is emptied before the next texts (2 MB of them at most, or one text).
CACHE = 1 << 18

#: Characters for which fast_split() is the same as the library's own splitter:
#: ASCII without controls other than white space, and the letters of Latin-1 and
#: Latin Extended-A that lower-casing maps to one letter and NFC leaves alone.
_PLAIN = re.compile(r"[\t-\r\x20-\x7e¡¿À-ÖØ-öø-įĲ-ňŊ-ž]*")
_LETTERS = "a-zß-öø-ž"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")
#: Strings that may be special tokens.
_CONTROL = "<|"


def fast_split(text: str) -> list[str] | None:
    """The pre-tokens of a text, or None where only the library can tell."""
    if _CONTROL in text or not _PLAIN.fullmatch(text):
        return None
    return _PIECES.findall(text.lower())


class Counter2:
    """Token counts of texts in one worker: table, then cache, then the library."""

    _tokenizers: dict[str, object] = {}

    def __init__(self, path: str, table: dict[str, int]):
        self.table = table
        self.cache: dict[str, int] = {}
        self.path = path

    @property
    def tokenizer(self):
        if self.path not in self._tokenizers:
            from tokenizers import Tokenizer

            made = Tokenizer.from_file(self.path)
            made.no_truncation()
            made.no_padding()
            self._tokenizers[self.path] = made
        return self._tokenizers[self.path]

    def split(self, text: str) -> list[str] | None:
        """The pre-tokens of a text, or None if only encoding it as a whole is right.

        What the library splits and no tier knows yet is encoded here, as the library's
        model has it: byte-level pieces are not normalised again.
        """
        if (words := fast_split(text)) is not None or _CONTROL in text or self.tokenizer.pre_tokenizer is None:
            return words
        tokenizer, table, cache = self.tokenizer, self.table, self.cache
        plain = tokenizer.normalizer.normalize_str(text) if tokenizer.normalizer is not None else text
        words = []
        for piece, (a, z) in tokenizer.pre_tokenizer.pre_tokenize_str(plain):
            word = plain[a:z]
            words.append(word)
            if word not in table and word not in cache:
                cache[word] = len(tokenizer.model.tokenize(piece))
        return words

    def encode(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        if len(self.cache) > CACHE:
            self.cache.clear()
        split = [self.split(t) for t in texts]
        misses = {w for words in split if words for w in set(words) if w not in self.table and w not in self.cache}
        todo = sorted(misses)
        for at in range(0, len(todo), 4096):
            part = todo[at : at + 4096]
            self.cache.update(zip(part, self.encode(part), strict=True))
        table, cache = self.table, self.cache
        whole = iter(self.encode([t for t, words in zip(texts, split, strict=True) if words is None]))
        return [next(whole) if words is None else sum(n if (n := table.get(w)) is not None else cache[w] for w in words) for words in split]


def _merge(a: dict[str, int], b: dict[str, int], size: int) -> dict[str, int]:
    """Two summaries as one of bounded size."""
    both = Counter(a)
    both.update(b)
    return dict(both.most_common(size)) if len(both) > size else dict(both)


def frequent_pretokens(docs: DataFrame, tokenizer_path: str, text_col: str = "text", size: int = TABLE, summary: int = SUMMARY) -> list[str]:
    """Up to `size` frequent pre-tokens of all texts, by merged bounded summaries."""

    def summarise(batches):
        held: Counter = Counter()
        splitter = Counter2(tokenizer_path, {})
        for b in batches:
            for text in b.column(0).to_pylist():
                if text and (words := splitter.split(text)):
                    if len(splitter.cache) > CACHE:
                        splitter.cache.clear()
                    held.update(words)
                    if len(held) > 8 * summary:
                        held = Counter(dict(held.most_common(summary)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(dict(held.most_common(summary)))], pa.binary())], ["held"])

    rows = docs.select(text_col).mapInArrow(summarise, "held binary").rdd
    merged = rows.treeAggregate({}, lambda a, row: _merge(a, pickle.loads(row[0]), size), lambda a, b: _merge(a, b, size), depth=2)
    return list(merged)


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, table_size: int = TABLE) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of docs."""
    spark = docs.sparkSession
    words = frequent_pretokens(docs, tokenizer_path, text_col, table_size)
    lengths = Counter2(tokenizer_path, {})
    table = {}
    it = iter(words)
    while part := list(islice(it, 4096)):
        table.update(zip(part, lengths.encode(part), strict=True))
    held = spark.sparkContext.broadcast(table)

    def each(batches):
        counter = Counter2(tokenizer_path, held.value)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            n = []
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars < 1 << 21):
                    chars += len(texts[end])
                    end += 1
                n += counter.count(texts[at:end])
                at = end
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(each, "id long, n_bytes long, n_tokens long, over_limit boolean")
