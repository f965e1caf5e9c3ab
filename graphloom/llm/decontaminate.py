"""Operator 3: benchmark decontamination on a distributed positional inverted index.

The training text is indexed in segments of about `SEGMENT_BYTES`, as search engines
shard an index by document. A segment's row holds, for each benchmark term in its
texts, the sorted positions of that term; the rows are written to the shared folder
as Parquet. Texts are read and split once, whatever the size of the benchmark.

A window of benchmark words is answered from its rarest term in the segment: that
term's positions, shifted to the window's start, are intersected with the next rarest
term's shifted list, and so on until none is left. This is done for all windows of a
segment at once. What remains are exact phrase matches. With `near` > 0 the same lists
give proximity matches: spans of at most window + near words that hold all of the
window's words in any order.

Nothing of the texts is shuffled: an index segment and its answers stay in one task,
so common words, passages and copies cannot pile up anywhere. Windows are taken in
blocks of `block_bytes`, which bounds what the driver and each worker hold; every
block is a pass over the index, not over the texts.

Words are compared by 64-bit hashes.

Defined results: null and wordless texts have 0 words and no hit; a benchmark
item without words has no window; repeated benchmark items count once per
item_id; an item without an id hits words, but is not counted or named; every row of
docs keeps its own result, repeated or not; empty tables give no hit, or no row;
other columns, of either table, are not read.
"""

from __future__ import annotations

import hashlib
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import alnum_folded, as_bytes, chunks, sliced, split_words
from ._shared import fresh_path, remove, settle, small_batches

_U = np.uint64
#: Bytes of window hashes and item ids in one block.
BLOCK_BYTES = 48 << 20
#: Bytes of text of an index segment, or one text.
SEGMENT_BYTES = 2 << 20
#: Distinct benchmark terms up to which only their postings are stored; beyond, those of every term.
MOST_TERMS = 1 << 24
#: Pairs of a window and a position that are looked at together.
PAIRS = 1 << 20


# -- benchmark -------------------------------------------------------------------


def window_pairs(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(item, terms) of the distinct windows of each item: `window` consecutive words, or all words of a shorter item."""

    def each(batches):
        for b in sliced(batches, 64):
            items, names = [], b.column(0).to_pylist()
            held = []
            at = 0
            for _, part in chunks(as_bytes(b.column(1))):
                h, _, _, _, _, bounds = split_words(alnum_folded, part)
                for i in range(len(part)):
                    w = h[bounds[i] : bounds[i + 1]]
                    if len(w):
                        k = min(window, len(w))
                        found = np.unique(np.lib.stride_tricks.sliding_window_view(w, k), axis=0)
                        held += [x.tobytes() for x in found]
                        items += [names[at + i]] * len(found)
                at += len(part)
            for a in range(0, len(held), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(items[a : a + (1 << 16)], pa.string()), pa.array(held[a : a + (1 << 16)], pa.binary())], ["item", "terms"])

    named = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return named.mapInArrow(each, "item string, terms binary").distinct()


@dataclass
class Windows:
    """Some windows, as rows of term numbers, and the items that hold them."""

    terms: np.ndarray  # sorted distinct term hashes
    size: np.ndarray  # words of each window
    rows: np.ndarray  # windows x longest, term numbers, -1 beyond a window's end
    names: list[str]  # sorted item ids
    first: np.ndarray  # window k is in items[first[k] : first[k + 1]]
    items: np.ndarray  # numbers of names

    @classmethod
    def of(cls, pairs: pa.Table, window: int) -> Windows:
        held = pairs.column("terms").to_pylist()
        size = np.array([len(x) // 8 for x in held], np.int64)
        table = np.zeros((len(held), window + 1), _U)
        for k in np.unique(size):
            at = np.flatnonzero(size == k)
            table[at, :k] = np.frombuffer(b"".join(held[i] for i in at), _U).reshape(-1, k)
        table[:, -1] = size.astype(_U)
        distinct, of = np.unique(table, axis=0, return_inverse=True)
        size, hashes = distinct[:, -1].astype(np.int64), distinct[:, :-1]
        inside = np.arange(window) < size[:, None]
        terms = np.unique(hashes[inside])
        rows = np.where(inside, np.searchsorted(terms, hashes), -1)
        item = pairs.column("item").to_pylist()
        names = sorted({x for x in item if x is not None})
        number = {x: k for k, x in enumerate(names)}
        known = np.array([x is not None for x in item], bool)
        of = of.reshape(-1)[known]
        order = np.argsort(of, kind="stable")
        items = np.array([number[x] for x in item if x is not None], np.int64)[order]
        return cls(terms, size, rows, names, np.searchsorted(of[order], np.arange(len(distinct) + 1)), items)


# -- index ---------------------------------------------------------------------


def _segments(texts: list[bytes], terms: np.ndarray | None):
    """(first text, texts, bounds, terms, offsets, positions) of each segment: its posting lists."""
    for first, part in chunks(texts, SEGMENT_BYTES):
        h, _, _, _, _, bounds = split_words(alnum_folded, part)
        if terms is None:
            positions = np.arange(len(h))
        else:
            at = np.searchsorted(terms, h)
            at[at == len(terms)] = 0
            positions = np.flatnonzero(terms[at] == h) if len(terms) else np.zeros(0, np.int64)
        found = h[positions]
        order = np.argsort(found, kind="stable")
        own, start = np.unique(found[order], return_index=True)
        yield first, len(part), bounds, own, np.append(start, len(order)), positions[order]


def build_index(docs: DataFrame, terms: np.ndarray | None, path: str) -> DataFrame:
    """Write the posting lists of (id, text) under path and return the table: a row for each segment."""
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def each(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for b in sliced(batches):
            for first, n, bounds, own, offsets, positions in _segments(as_bytes(b.column(1)), held.value):
                row = [number, b.column(0).slice(first, n).to_pylist(), bounds.astype(np.int32).tobytes(), own.tobytes(), offsets.astype(np.int32).tobytes(), positions.astype(np.int32).tobytes()]
                types = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], ["segment", "ids", "bounds", "terms", "offsets", "positions"])
                number += 1

    made = docs.mapInArrow(each, "segment long, ids array<long>, bounds binary, terms binary, offsets binary, positions binary")
    made.write.option("parquet.block.size", 32 << 20).parquet(path)
    return docs.sparkSession.read.parquet(path)


class Segment:
    """The posting lists of one segment, read with the windows of one block."""

    def __init__(self, bounds, terms, offsets, positions, windows: Windows):
        self.windows, self.bounds, self.n = windows, np.asarray(bounds, np.int64), int(bounds[-1])
        self.text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.positions = np.asarray(positions, np.int64)
        count = np.diff(np.asarray(offsets, np.int64))
        #: positions of term t are keys t * n + position, in one sorted array
        self.keys = np.repeat(np.arange(len(terms)), count) * self.n + self.positions
        at = np.searchsorted(terms, windows.terms)
        at[at == len(terms)] = 0
        here = (terms[at] == windows.terms) if len(terms) else np.zeros(len(windows.terms), bool)
        local = np.append(np.where(here, at, -1), 0)  # -1 picks the last
        often = np.append(np.where(here, count[at] if len(count) else 0, 0), np.iinfo(np.int64).max)
        self.start = np.asarray(offsets, np.int64)
        # windows all of whose terms occur, their terms rarest first
        rows = windows.rows
        self.alive = np.flatnonzero(often[rows].min(axis=1) > 0) if len(rows) else np.zeros(0, np.int64)
        rows = rows[self.alive]
        self.size = windows.size[self.alive]
        self.order = np.argsort(often[rows], axis=1, kind="stable")
        self.term = np.take_along_axis(local[rows], self.order, axis=1)
        self.often = often[rows].min(axis=1) if len(rows) else np.zeros(0, np.int64)

    def _pairs(self):
        """(row of alive, position of its rarest term) in pieces of bounded size."""
        ends = np.cumsum(self.often)
        a = 0
        while a < len(self.often):
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, side="right")))
            n = self.often[a:z]
            w = np.repeat(np.arange(a, z), n)
            within = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
            yield w, self.positions[self.start[self.term[w, 0]] + within]
            a = z

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """(row of alive, start) of the exact matches within one text."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for w, p in self._pairs():
            start = p - self.order[w, 0]
            ok = (start >= 0) & (start + self.size[w] <= self.n)
            w, start = w[ok], start[ok]
            ok = self.text_of[start] == self.text_of[start + self.size[w] - 1]
            w, start = w[ok], start[ok]
            for k in range(1, self.order.shape[1]):
                if not len(w):
                    break
                wanted = self.term[w, k] * self.n + start + self.order[w, k]
                at = np.searchsorted(self.keys, wanted)
                at[at == len(self.keys)] = 0
                ok = (self.size[w] <= k) | (self.keys[at] == wanted)
                w, start = w[ok], start[ok]
            found.append((w, start))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def proximities(self, near: int, known: set[tuple[int, int]]) -> list[tuple[int, int]]:
        """(row of alive, text) with a span of at most size + near words that holds all words of the window."""
        out: set[tuple[int, int]] = set()
        for w, p in self._pairs():
            for k in range(1, self.order.shape[1]):
                if not len(w):
                    break
                reach = self.size[w] + near - 1
                text = self.text_of[p]
                base = self.term[w, k] * self.n
                lo, hi = base + np.maximum(p - reach, self.bounds[text]), base + np.minimum(p + reach, self.bounds[text + 1] - 1)
                at = np.searchsorted(self.keys, lo)
                inside = np.zeros(len(w), bool)
                ok = at < len(self.keys)
                inside[ok] = self.keys[at[ok]] <= hi[ok]
                ok = (self.size[w] <= k) | inside
                w, p = w[ok], p[ok]
            for row, place in zip(w.tolist(), p.tolist(), strict=True):
                text = int(self.text_of[place])
                if (row, text) not in known and (row, text) not in out and self._close(row, place, text, near):
                    out.add((row, text))
        return sorted(out)

    def _close(self, row: int, place: int, text: int, near: int) -> bool:
        """Whether a span that holds `place` holds all words of the window, as often as it has them."""
        size = int(self.size[row])
        reach = size + near - 1
        need: dict[int, int] = {}
        for t in self.term[row, :size].tolist():
            need[t] = need.get(t, 0) + 1
        lo, hi = max(place - reach, int(self.bounds[text])), min(place + reach, int(self.bounds[text + 1]) - 1)
        around = []
        for t in need:
            a, z = np.searchsorted(self.keys, [t * self.n + lo, t * self.n + hi + 1])
            around += [(int(x) - t * self.n, t) for x in self.keys[a:z]]
        around.sort()
        held, left, missing = dict.fromkeys(need, 0), 0, size
        for q, t in around:
            held[t] += 1
            missing -= held[t] <= need[t]
            while around[left][0] < q - reach:
                u = around[left][1]
                held[u] -= 1
                missing += held[u] < need[u]
                left += 1
            if not missing:
                return True
        return False

    def answers(self, near: int = 0):
        """(hit position, (text, item) of phrases, (text, item) of proximity only), each distinct and sorted."""
        w, start = self.phrases()
        hit = np.zeros(self.n, bool)
        for k in range(self.order.shape[1] if len(w) else 0):
            hit[start[self.size[w] > k] + k] = True
        exact = np.unique(np.stack([w, self.text_of[start]]), axis=1) if len(w) else np.zeros((2, 0), np.int64)
        by_phrase = self._items(exact[0], exact[1])
        close = self.proximities(near, set(zip(*exact.tolist(), strict=True)) if len(w) else set()) if near else []
        both = self._items(np.array([x for x, _ in close], np.int64), np.array([x for _, x in close], np.int64))
        return np.flatnonzero(hit), by_phrase, np.setdiff1d(both, by_phrase)

    def _items(self, row: np.ndarray, text: np.ndarray) -> np.ndarray:
        """text * number of items + item, for each item of some windows found in texts."""
        win = self.alive[row]
        first, n = self.windows.first[win], self.windows.first[win + 1] - self.windows.first[win]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.unique(np.repeat(text, n) * max(1, len(self.windows.names)) + self.windows.items[np.repeat(first, n) + within])


# -- search ---------------------------------------------------------------------

_FOUND = "segment long, doc long, id long, n_words long, hits array<int>, items array<string>, near_items array<string>"


def _search(windows, near: int):
    """Map over index rows: a row of _FOUND for each text."""

    def listed(values, text: np.ndarray, n: int) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32()), values)

    def each(batches):
        block = windows.value
        for b in batches:
            for i in range(b.num_rows):
                ids = b.column(1)[i].values
                bounds, offsets, positions = (np.frombuffer(b.column(k)[i].as_py(), np.int32) for k in (2, 4, 5))
                seg = Segment(bounds, np.frombuffer(b.column(3)[i].as_py(), _U), offsets, positions, block)
                n, many = len(ids), max(1, len(block.names))
                hit, exact, close = seg.answers(near)
                text = seg.text_of[hit]
                names = [pa.array([block.names[k] for k in x % many], pa.string()) for x in (exact, close)]
                columns = [
                    pa.array(np.full(n, b.column(0)[i].as_py(), np.int64)), pa.array(np.arange(n)), ids, pa.array(np.diff(seg.bounds)),
                    listed(pa.array((hit - seg.bounds[text]).astype(np.int32)), text, n), listed(names[0], exact // many, n), listed(names[1], close // many, n),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["segment", "doc", "id", "n_words", "hits", "items", "near_items"])

    return each


@contextmanager
def _few_rows_a_batch(spark, rows: int = 4):
    """An index row is as large as a segment, so few of them make an Arrow batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 8, near: int = 0, block_bytes: int = BLOCK_BYTES, index_path: str | None = None) -> DataFrame:
    """(id, n_words, hits, items, near_items) for each row of docs.

    hits are the positions of words inside a matched window, items the ids of the
    items with a matched window, near_items those that only match by proximity. The
    index is kept at index_path if one is named, and removed after the last pass if not.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pairs = settle(window_pairs(benchmark, item_col, item_text_col, window))
    n_pairs, width = pairs.agg(F.count("*"), F.coalesce(F.avg(F.octet_length("terms") + F.coalesce(F.octet_length("item"), F.lit(0)) + 24), F.lit(1))).first()
    n_blocks = max(1, -(-int(n_pairs * width) // block_bytes))
    block = lambda k: pairs.filter(F.pmod(F.xxhash64("item", "terms"), F.lit(n_blocks)) == k).toArrow()

    terms = _terms_of(pairs)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    path = index_path or fresh_path(spark, "postings")
    index = build_index(source, terms, path)
    found = None
    for k in range(n_blocks):
        held = spark.sparkContext.broadcast(Windows.of(block(k), window))
        with _few_rows_a_batch(spark):
            rows = index.mapInArrow(_search(held, near), _FOUND)
            rows = settle(rows if k == 0 else rows.filter("size(hits) > 0 or size(near_items) > 0"))
        held.unpersist()
        found = rows if found is None else found.union(rows)
    if index_path is None:
        remove(spark, path)
    if n_blocks == 1:
        return found.drop("segment", "doc")
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    merged = found.groupBy("segment", "doc").agg(F.max("id").alias("id"), F.max("n_words").alias("n_words"), every("hits"), every("items"), every("near_items"))
    return merged.select("id", "n_words", "hits", "items", F.array_except("near_items", "items").alias("near_items"))


def _terms_of(pairs: DataFrame) -> np.ndarray | None:
    """The distinct terms of the benchmark, sorted; None if they are too many to broadcast."""

    def each(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.frombuffer(b"".join(b.column(0).to_pylist()), _U)).view(np.int64))], ["t"])

    distinct = settle(pairs.select("terms").mapInArrow(each, "t long").distinct())
    if distinct.count() > MOST_TERMS:
        return None
    return np.sort(distinct.toArrow().column("t").to_numpy().astype(np.int64).view(_U))


def contamination(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, **more) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items) for each row of docs."""
    found = find_overlaps(docs, benchmark, **more)
    n_items = F.size("items").cast("long")
    return found.select("id", "n_words", F.size("hits").cast("long").alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_items >= min_items).alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"))
