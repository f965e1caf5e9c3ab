"""Operator 2: exact n-gram Jaccard join by T-occurrence search.

Two texts link when their sets of distinct word shingles have a Jaccard
similarity of at least `percent` / 100. The stages, none of which makes all
pairs of a group:

1. Each text becomes its set's size and 128-bit fingerprint. Equal sets are one
   class; the row with the smallest id stands for it.
2. Necessary condition on short prefixes: with n elements and T = ceil(t n), two
   linked sets share the first l of their common elements, in any fixed order,
   within their first n - T + l elements. So a text with fewer than l prefix
   elements that other texts have in theirs has no partner. Elements are
   hash-ordered here and travel as numpy blobs, combined before the shuffle: an
   element that is met twice in a batch sends one entry, however many texts
   hold it.
3. The rest count their elements' frequency among each other, drop elements
   nobody shares, drop texts left with fewer than T, and connect through their
   rarest n - T + 1 elements. Linked texts are always connected there.
4. Each connected group is searched in one place, or in chunks of bounded size
   if large. A text is searched against an inverted index of its group, with the
   lists divided as by DivideSkip: the short ones are merged by counting, the long
   ones, kept as bit maps, probed for the sets that may still reach the required
   overlap. A family of near copies, in which every pair meets, so costs a few
   machine words a pair. Each pair of chunks of a larger group is searched in one
   place, and what they connect is joined; no link is lost, and no row is made for
   a pair.

Defined results: a null or blank text has no shingles and links with nothing; a
text of fewer words than `n` is a single shingle; repeated rows are copies of
each other and each keeps its row; an empty table gives an empty result; columns
other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import as_bytes, chunks, mix, runs, sliced, spaced_folded, split_words
from ._shared import bytes_of, settle, small_batches
from .components import connected_components

_U = np.uint64
#: Elements that a map task holds before it combines and sends them on.
FLUSH = 1 << 19
#: Elements of the texts that are searched in one place.
BLOCK = 1 << 22
#: Elements that a short text counts as there, since pairs cost time as well.
LEAST_SIZE = 64
#: Ids up to which a set of ids is broadcast to filter texts; beyond, a shuffled join.
BROADCAST_IDS = 1_000_000


def ceil_share(n, percent):
    """ceil(n * percent / 100) in integers."""
    return (n * percent + 99) // 100


def slack(n):
    """Shared prefix elements asked for in stage 2."""
    return 1 + n // 20


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, part in chunks(texts):
        h, _, _, _, _, bounds = split_words(spaced_folded, part)
        for i in range(len(part)):
            w = h[bounds[i] : bounds[i + 1]]
            if 0 < len(w) < n:
                yield runs(w, len(w))
            else:
                yield np.unique(runs(w, n))


# -- stage 1 ---------------------------------------------------------------


def fingerprints(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, n_shingles, f1, f2): size and fingerprint of each text's set."""

    def each(batches):
        for b in sliced(batches):
            rows = np.array([(len(s), *_print_of(s)) for s in shingle_sets(as_bytes(b.column(1)), n)], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(rows[:, k]) for k in range(3))], ["id", "n_shingles", "f1", "f2"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(each, "id long, n_shingles long, f1 long, f2 long")


def _print_of(s: np.ndarray) -> tuple[int, int]:
    """The fingerprint of a set, as two signed 64-bit numbers."""
    with np.errstate(over="ignore"):
        both = np.array([mix(s ^ _U(0xA5A5A5A5)).sum(dtype=_U), mix(s + _U(0x5851F42D4C957F2D)).sum(dtype=_U)], _U)
    return tuple(both.view(np.int64).tolist())


# -- stage 2 ---------------------------------------------------------------


def _may_link(k, percent):
    """Whether a set of k elements can be linked with a different set at all."""
    return 100 * k >= percent * (k + 1)


def _prefix_blobs(n: int, percent: int, n_parts: int):
    """Map side: prefix elements by range (kind 0), and what is known of each text by id (kind 1)."""

    def flush(tok, doc, who):
        # elements are dealt by another hash than the one that orders them, so that ranges are even
        tok, doc = mix(np.concatenate(tok)), np.concatenate(doc)
        order = np.argsort(tok, kind="stable")
        tok, doc = tok[order], doc[order]
        first = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
        count = np.diff(np.r_[first, len(tok)])
        ids, credit = np.unique(doc[np.repeat(count > 1, count)], return_counts=True)
        shared = count > 1
        tok, holder = tok[first], doc[first]
        part = (tok % _U(n_parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        tok, holder, shared, part = tok[order], holder[order], shared[order], part[order]
        edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        rows = [(int(part[a]), 0, tok[a:z].tobytes(), holder[a:z].tobytes(), np.packbits(shared[a:z]).tobytes()) for a, z in zip(edge, np.r_[edge[1:], len(tok)], strict=True)]
        known = np.array(who, dtype=np.int64).reshape(-1, 4)
        own = np.zeros(len(known), dtype=np.int64)
        at = np.searchsorted(ids, known[:, 0])
        at[at == len(ids)] = 0
        if len(ids):
            found = ids[at] == known[:, 0]
            own[found] = credit[at[found]]
        rows += [(p, 1, known[k].tobytes(), own[k].tobytes(), b"") for p, k in _by_part(known[:, 0], n_parts)]
        return _blob_batch(rows)

    def each(batches):
        tok, doc, who, held = [], [], [], 0
        for b in sliced(batches):
            ids = b.column(0).to_pylist()
            for i, s in enumerate(shingle_sets(as_bytes(b.column(1)), n)):
                k = len(s)
                if ids[i] is None or not k or not _may_link(k, percent):
                    continue
                who.append((ids[i], k, *_print_of(s)))
                s = s[: k - ceil_share(k, percent) + slack(k)]
                tok.append(s)
                doc.append(np.full(len(s), ids[i], dtype=np.int64))
                held += len(s)
                if held >= FLUSH:
                    yield flush(tok, doc, who)
                    tok, doc, who, held = [], [], [], 0
        if held:
            yield flush(tok, doc, who)

    return each


_BLOBS = "part long, kind long, a binary, b binary, c binary"


def _blob_batch(rows):
    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["part", "kind", "a", "b", "c"])


def _by_part(ids: np.ndarray, n_parts: int):
    """(part, row numbers) of ids dealt by hash."""
    part = (mix(ids.view(_U)) % _U(n_parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    for k in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(ids) else []:
        yield int(part[k[0]]), k


def _credits(n_parts: int):
    """Reduce side: which texts hold an element that came from elsewhere too, an id once for each task."""

    def each(batches):
        tok, doc, many = [], [], []
        for b in batches:
            known = b.filter(pc.field("kind") == 1)
            if known.num_rows:
                yield known
            for x, y, z in zip(*(b.filter(pc.field("kind") == 0).column(c).to_pylist() for c in "abc"), strict=True):
                tok.append(np.frombuffer(x, _U))
                doc.append(np.frombuffer(y, np.int64))
                many.append(np.unpackbits(np.frombuffer(z, np.uint8))[: len(x) // 8].astype(bool))
        if not tok:
            return
        tok, doc, many = np.concatenate(tok), np.concatenate(doc), np.concatenate(many)
        order = np.argsort(tok, kind="stable")
        tok, doc, many = tok[order], doc[order], many[order]
        first = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
        count = np.diff(np.r_[first, len(tok)])
        ids, credit = np.unique(doc[np.repeat(count > 1, count) & ~many], return_counts=True)
        rows = [(p, 2, ids[k].tobytes(), credit[k].astype(np.int64).tobytes(), b"") for p, k in _by_part(ids, n_parts)]
        if rows:
            yield _blob_batch(rows)

    return each


def _reach(percent: int):
    """The texts whose credit suffices: (id, size, f1, f2), a row for each id."""

    def each(batches):
        known, ids, credit = [], [], []
        for b in batches:
            for kind, x, y in zip(*(b.column(c).to_pylist() for c in ("kind", "a", "b")), strict=True):
                if kind == 1:
                    known.append(np.frombuffer(x, np.int64).reshape(-1, 4))
                    ids.append(known[-1][:, 0])
                else:
                    ids.append(np.frombuffer(x, np.int64))
                credit.append(np.frombuffer(y, np.int64))
        if not known:
            return
        known = np.concatenate(known)
        known = known[np.unique(known[:, 0], return_index=True)[1]]
        total = np.zeros(len(known), dtype=np.int64)
        np.add.at(total, np.searchsorted(known[:, 0], np.concatenate(ids)), np.concatenate(credit))
        kept = known[total >= 1 + ceil_share(known[:, 1], percent) // 20]
        for at in range(0, len(kept), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(kept[at : at + (1 << 16), k]) for k in range(4)], ["id", "size", "f1", "f2"])

    return each


def prefix_survivors(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """Class representatives that stage 2 cannot rule out: (rep, size).

    Two shuffles of blobs: by element, where an element that came from two places
    credits its texts, and by id, where credits add up beside the set's size.
    """
    spark = docs.sparkSession
    n_tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), bytes_of(docs) >> 27)
    # hashing does not deal few numbers evenly, so there are more ranges than tasks if those are few
    n_parts = 4 * n_tasks if n_tasks < 1024 else n_tasks
    blobs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_prefix_blobs(n, percent, n_parts), _BLOBS)
    credits = blobs.repartition(n_tasks, "part").mapInArrow(_credits(n_parts), _BLOBS)
    kept = credits.repartition(n_tasks, "part").mapInArrow(_reach(percent), "id long, size long, f1 long, f2 long")
    return kept.groupBy("size", "f1", "f2").agg(F.min("id").alias("rep")).select("rep", "size")


def _texts_of(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The texts of some ids, one row each; the ids are broadcast only if few."""
    few = reps.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(reps) if few else reps, "rep")


# -- stage 3 ---------------------------------------------------------------


#: Elements that one task counts.
COUNT_ELEMENTS = 1 << 20


def _post_blobs(n: int, n_parts: int):
    """Map side: elements by range (kind 0), their hashes cut to 40 bits, and the sizes of texts by id (kind 1).

    What two elements have in common by the cut only makes texts candidates.
    """

    def flush(sets, ids):
        size = np.array([len(s) for s in sets], np.int64)
        tok, rep = mix(np.concatenate(sets)), np.array(ids, np.int64)
        rows = [(p, 1, rep[k].tobytes(), size[k].tobytes(), b"") for p, k in _by_part(rep, n_parts)]
        part, rep = (tok % _U(n_parts)).astype(np.int32), np.repeat(rep, size)
        order = np.argsort(part, kind="stable")
        tok, rep, part = tok[order], rep[order], part[order]
        high, low = (tok >> _U(32)).astype(np.uint32), (tok >> _U(24)).astype(np.uint8)
        edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        rows += [(int(part[a]), 0, high[a:z].tobytes(), rep[a:z].tobytes(), low[a:z].tobytes()) for a, z in zip(edge, np.r_[edge[1:], len(tok)], strict=True)]
        return _blob_batch(rows)

    def each(batches):
        sets, ids, held = [], [], 0
        for b in sliced(batches):
            for i, s in zip(b.column(0).to_pylist(), shingle_sets(as_bytes(b.column(1)), n), strict=True):
                if not len(s):
                    continue
                sets.append(s)
                ids.append(i)
                held += len(s)
                if held >= FLUSH:
                    yield flush(sets, ids)
                    sets, ids, held = [], [], 0
        if held:
            yield flush(sets, ids)

    return each


def _frequencies(n_parts: int):
    """Reduce side: for each text, how many of its elements are held by df texts of which hub is the least (kind 2: rep, hub, df and count)."""

    def each(batches):
        high, low, rep = [], [], []
        for b in batches:
            known = b.filter(pc.field("kind") == 1)
            if known.num_rows:
                yield known
            for x, y, z in zip(*(b.filter(pc.field("kind") == 0).column(c).to_pylist() for c in "abc"), strict=True):
                high.append(np.frombuffer(x, np.uint32))
                rep.append(np.frombuffer(y, np.int64))
                low.append(np.frombuffer(z, np.uint8))
        if not rep:
            return
        tok = np.concatenate(high).astype(_U) << _U(8) | np.concatenate(low)
        ids, text = np.unique(np.concatenate(rep), return_inverse=True)
        del high, low, rep
        order = np.argsort(tok)
        tok, text = tok[order], text[order]
        first = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
        df = np.diff(np.r_[first, len(tok)])
        place = np.repeat(np.where(df > 1, df * len(ids) + np.minimum.reduceat(text, first), 0), df)
        text, place = text[place > 0], place[place > 0]
        if not len(text):
            return
        order = np.lexsort((place, text))
        text, place = text[order], place[order]
        first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (place[1:] != place[:-1])])
        rep, hub = ids[text[first]], ids[place[first] % len(ids)]
        counts = np.stack([place[first] // len(ids), np.diff(np.r_[first, len(text)])], axis=1).astype(np.uint32)
        yield _blob_batch([(p, 2, rep[k].tobytes(), hub[k].tobytes(), counts[k].tobytes()) for p, k in _by_part(rep, n_parts)])

    return each


def _rarest(percent: int):
    """(rep, size, hub), each once: what the rarest n - T + 1 elements of a text connect it with, if it shares T at all."""

    def each(batches):
        known, size_of, rep, hub, counts = [], [], [], [], []
        for b in batches:
            for kind, x, y, z in zip(*(b.column(c).to_pylist() for c in ("kind", "a", "b", "c")), strict=True):
                (known if kind == 1 else rep).append(np.frombuffer(x, np.int64))
                (size_of if kind == 1 else hub).append(np.frombuffer(y, np.int64))
                if kind == 2:
                    counts.append(np.frombuffer(z, np.uint32).reshape(-1, 2))
        if not rep:
            return
        known, at = np.unique(np.concatenate(known), return_index=True)
        size_of = np.concatenate(size_of)[at]
        rep, hub, counts = np.concatenate(rep), np.concatenate(hub), np.concatenate(counts).astype(np.int64)
        order = np.lexsort((hub, counts[:, 0], rep))
        rep, hub, df, k = rep[order], hub[order], counts[order, 0], counts[order, 1]
        new = np.r_[True, rep[1:] != rep[:-1]]
        # elements of one place are taken or left together
        first = np.flatnonzero(new | np.r_[True, (hub[1:] != hub[:-1]) | (df[1:] != df[:-1])])
        k, rep, hub, new = np.add.reduceat(k, first), rep[first], hub[first], new[first]
        start = np.flatnonzero(new)
        n_places = np.diff(np.r_[start, len(rep)])
        shared, upto = np.add.reduceat(k, start), np.cumsum(k) - k
        size = size_of[np.searchsorted(known, rep[start])]
        need = ceil_share(size, percent)
        before = upto - np.repeat(upto[start] - size + shared, n_places)
        kept = np.repeat(shared >= need, n_places) & (before < np.repeat(size - need + 1, n_places))
        rep, hub, size = rep[kept], hub[kept], np.repeat(size, n_places)[kept]
        order = np.lexsort((hub, rep))
        rep, hub, size = rep[order], hub[order], size[order]
        once = np.r_[True, (rep[1:] != rep[:-1]) | (hub[1:] != hub[:-1])][: len(rep)]
        rep, hub, size = rep[once], hub[once], size[once]
        for at in range(0, len(rep), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in (rep, size, hub)], ["rep", "size", "hub"])

    return each


def candidate_edges(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """(rep, size, hub): texts and the least text that each place of their rarest shared elements belongs to.

    Two shuffles of blobs, as in stage 2: by element and by id. No row is made for an element.
    """
    spark = docs.sparkSession
    total = reps.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # by elements alone, as each task sends a row to each range
    n_tasks = max(2 * spark.sparkContext.defaultParallelism, total // COUNT_ELEMENTS)
    n_parts = 4 * n_tasks if n_tasks < 1024 else n_tasks
    # the ids are distinct, but rows of the table may repeat an id: their elements count again, which makes more candidates
    posts = _texts_of(docs, reps.select("rep"), id_col, text_col).mapInArrow(_post_blobs(n, n_parts), _BLOBS)
    met = posts.repartition(n_tasks, "part").mapInArrow(_frequencies(n_parts), _BLOBS)
    return met.repartition(n_tasks, "part").mapInArrow(_rarest(percent), "rep long, size long, hub long")


def candidate_groups(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """(rep, size, grp): texts connected through their rarest shared elements."""
    edges = settle(candidate_edges(docs, reps, id_col, text_col, n, percent))
    grouped = connected_components(edges, "rep", "hub")
    return edges.select("rep", "size").distinct().join(grouped, F.col("rep") == F.col("node")).select("rep", "size", F.col("component").alias("grp"))


# -- stage 4: search in one place -------------------------------------------


class InvertedIndex:
    """Sets by element, for T-occurrence search."""

    #: A list is long if it has more sets than this, and more than one in SPARSE of all.
    SHORT = 16
    #: Long lists are bit maps, which are no larger than the lists if one in 32 bits is set.
    SPARSE = 32

    def __init__(self, sets=()):
        self.sets: list[np.ndarray] = []
        for s in sets:
            self.add(s)
        self._build()

    def add(self, elements) -> int:
        """Index a set of distinct elements; its number is larger than all before. The next search builds the index."""
        self.sets.append(np.asarray(elements, _U))
        return len(self.sets) - 1

    def _build(self) -> None:
        n = len(self.sets)
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        every = np.concatenate([*self.sets, np.zeros(0, _U)])
        order = np.argsort(every, kind="stable")  # so lists are sorted by number
        every = every[order]
        self.holders = np.repeat(np.arange(n, dtype=np.int32), self.sizes)[order]
        self.start = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
        self.length = np.diff(np.r_[self.start, len(every)])
        self.elements = every[self.start]
        long = np.flatnonzero(self.length > max(self.SHORT, n // self.SPARSE))
        self.column = np.full(len(self.start), -1, np.int64)
        self.column[long] = np.arange(len(long))
        self.bits = np.zeros((-(-len(long) // 64), n), _U)
        for k, e in enumerate(long.tolist()):
            self.bits[k // 64, self.holders[self.start[e] : self.start[e] + self.length[e]]] |= _U(1 << k % 64)

    def overlaps(self, elements: np.ndarray, least: int, below: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (less than `below`) and overlaps of the indexed sets that share at least `least` elements."""
        if len(self.sizes) != len(self.sets):
            self._build()
        n, least = len(self.sets) if below is None else below, max(1, least)
        at = np.searchsorted(self.elements, elements)
        known = at < len(self.elements)
        at, elements = at[known], elements[known]
        at = at[self.elements[at] == elements]
        if len(at) < least:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        column = self.column[at]
        short, long = at[column < 0], column[column >= 0]
        # the sets in short lists are counted
        length = self.length[short]
        total = int(length.sum())
        where = np.repeat(self.start[short] - np.cumsum(length) + length, length) + np.arange(total)
        got = np.bincount(self.holders[where], minlength=n)[:n]
        if len(long) < least:
            found = np.flatnonzero(got >= least - len(long))
            got = got[found]
        else:
            found = None
        # the long ones are probed for what may still reach `least`
        if found is None or len(found):
            wanted = np.zeros(len(self.bits), _U)
            np.bitwise_or.at(wanted, long // 64, _U(1) << (long % 64).astype(_U))
            for w in np.flatnonzero(wanted):
                held = self.bits[w, :n] if found is None else self.bits[w, found]
                got += np.bitwise_count(held & wanted[w])
        enough = np.flatnonzero(got >= least)
        return enough if found is None else found[enough], got[enough]

    def search(self, elements, least: int) -> list[tuple[int, int]]:
        """(number, overlap) of the indexed sets that share at least `least` elements."""
        found, both = self.overlaps(np.asarray(elements, _U), least)
        return list(zip(found.tolist(), both.tolist(), strict=True))

    def linked(self, s: np.ndarray, percent: int, below: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (less than `below`) of the indexed sets that are at least `percent` % similar to s, and overlaps."""
        found, both = self.overlaps(s, ceil_share(len(s), percent), below)
        near = 100 * both >= percent * (len(s) + self.sizes[found] - both)
        return found[near], both[near]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def cluster(ids: list[int], sets: list[np.ndarray], percent: int, weights: list[int] | None = None, sides: list[int] | None = None) -> tuple[list[int], list[int], np.ndarray]:
    """Components of the links among some sets; with `sides` (0 or 1), of the links between the two.

    Returns for each set the smallest id of its component, the index of the most
    similar set that was linked with it in its own search (itself, if none), and the
    weight of all sets that it is linked with. Without sides, sets are searched among
    those before them.
    """
    weight = np.ones(len(sets), np.int64) if weights is None else np.array(weights, np.int64)
    side = np.zeros(len(sets), np.int64) if sides is None else np.array(sides, np.int64)
    held = np.flatnonzero(side == 0)
    index = InvertedIndex(sets[x] for x in held)
    root, nearest, links = np.array(ids, np.int64), list(range(len(sets))), np.zeros(len(sets), np.int64)
    for x in range(len(sets)) if sides is None else np.flatnonzero(side == 1).tolist():
        found, both = index.linked(sets[x], percent, x if sides is None else None)
        if not len(found):
            continue
        nearest[x] = int(held[found[(both / (len(sets[x]) + index.sizes[found] - both)).argmax()]])
        found = held[found]
        links[x] += weight[found].sum()
        links[found] += weight[x]
        met = root[found]
        least = min(met.min(), root[x])
        if (met != least).any():
            root[np.isin(root, met)] = least
        root[x] = least
    return root.tolist(), nearest, links


#: Elements of the texts that one task searches, where groups are smaller.
TASK_ELEMENTS = 1 << 18


def _search_tasks(sized: DataFrame) -> int:
    """How many tasks search the texts of `sized` (size); by their elements, as bytes say little about the work."""
    spark = sized.sparkSession
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_ELEMENTS)


def _set_of(text: str | None, n: int) -> np.ndarray:
    return next(shingle_sets([(text or "").encode()], n))


def _blocks(batches):
    """((grp, block), rows) of sorted batches; a row that repeats an id is dropped."""
    now, held = None, []
    for b in batches:
        for row in b.to_pylist():
            at = (row["grp"], row["block"])
            if held and at != now:
                yield now, held
                held = []
            now = at
            if not held or held[-1]["rep"] != row["rep"]:
                held.append(row)
    if held:
        yield now, held


def class_links(docs: DataFrame, groups: DataFrame, classes: DataFrame | None, id_col: str, text_col: str, n: int, percent: int, block: int = BLOCK) -> DataFrame:
    """(rep, component, links): the smallest representative that links reach from rep, and how many rows of other classes rep is linked with.

    classes: (rep, n_copies); without it, links are counted in classes. The classes
    of a connected group are searched in one place, or if large, dealt by hash into
    chunks of which each pair is searched in one place.
    """
    total = groups.groupBy("grp").agg(F.sum(F.greatest("size", F.lit(LEAST_SIZE))).alias("total"), F.count("*").alias("texts")).filter("texts > 1")
    n_chunks = F.when(F.col("total") <= block, F.lit(1)).otherwise(F.ceil(F.col("total") / F.lit(max(1, block // 2)))).cast("long")
    cut = groups.join(total, "grp").withColumn("n_chunks", n_chunks).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("n_chunks")))
    grid = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1)))
    grid = grid.withColumn("n_copies", F.lit(1).cast("long")) if classes is None else grid.join(classes, "rep")
    lo, hi = F.least("chunk", "other"), F.greatest("chunk", "other")
    side = (F.col("chunk") > F.col("other")).cast("long")
    placed = settle(grid.select("rep", "size", "grp", (lo * F.lit(1 << 30) + hi).alias("block"), side.alias("side"), (lo < hi).alias("across"), "n_copies"))

    def each(batches):
        for _, rows in _blocks(batches):
            ids = [r["rep"] for r in rows]
            sides = [r["side"] for r in rows] if rows[0]["across"] else None
            root, _, links = cluster(ids, [_set_of(r["text"], n) for r in rows], percent, [r["n_copies"] for r in rows], sides)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, root, links)], ["rep", "root", "links"])

    texts = _texts_of(docs, placed, id_col, text_col).select("grp", "block", "rep", "side", "across", "n_copies", "text")
    dealt = texts.repartition(_search_tasks(placed), "grp", "block").sortWithinPartitions("grp", "block", "rep")
    found = settle(dealt.mapInArrow(each, "rep long, root long, links long"))
    if placed.filter("across").isEmpty():
        return found.withColumnRenamed("root", "component")
    label = connected_components(found, "rep", "root")
    return found.groupBy("rep").agg(F.sum("links").alias("links")).join(label, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("component"), "links")


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, block: int = BLOCK, links: bool = False) -> DataFrame:
    """(id, n_shingles, component_id, n_copies[, n_links]) for each row of docs.

    component_id is the smallest id that links reach; n_copies counts the rows
    with the same set, itself included (1 where the set is empty). With `links`,
    n_links counts the other rows that a row is linked with, its copies included.
    Rows that repeat an id must repeat its text. Rows with a null id take part in
    no link: their component is null and they are one copy.
    """
    small_batches(docs.sparkSession)
    same = ["n_shingles", "f1", "f2"]
    sigs = settle(fingerprints(docs, id_col, text_col, n))
    survivors = settle(prefix_survivors(docs, id_col, text_col, n, percent))
    groups = settle(candidate_groups(docs, survivors, id_col, text_col, n, percent))
    classes = sigs.filter("n_shingles > 0 and id is not null").groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("n_copies"))
    if links:
        classes = settle(classes)
    near = class_links(docs, groups, classes.select("rep", "n_copies") if links else None, id_col, text_col, n, percent, block)
    named = classes.join(near, "rep", "left").filter("n_copies > 1 or component is not null").select(*same, "n_copies", F.coalesce("component", "rep").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))
    known = F.col("id").isNotNull()
    copies = F.when(known, F.coalesce("n_copies", F.lit(1))).otherwise(F.lit(1)).cast("long")
    out = sigs.join(named, same, "left").select("id", "n_shingles", F.when(known, F.coalesce("component_id", "id")).alias("component_id"), copies.alias("n_copies"), (copies - 1 + F.when(known, F.coalesce("links", F.lit(0))).otherwise(F.lit(0))).cast("long").alias("n_links"))
    return out if links else out.drop("n_links")
