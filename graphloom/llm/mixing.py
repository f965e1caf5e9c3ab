"""Operator 9: mixing sources to target weights, by pivotal dependent rounding.

Each source's target is its weight's share of all words, capped at `cap` times its
own size, with the excess shared among the others by weight (water-filling). With
r = target / size, every document of the source gets floor(r) copies and a
fractional copy at probability p = r - floor(r). The fractions are rounded
dependently (Deville and Tille, "Unequal probability sampling without replacement
through a splitting method", 1998): two documents duel, moving words of
probability from one to the other, at random with the odds that keep both
expectations, until one fraction is 0 or 1. Words are conserved exactly, so a
source misses its target by less than one document.

Duels run in a reduction tree: documents are dealt by hash into groups of bounded
size within their source, each group folds its fractions into one survivor, and
survivors meet in the next level until a source has one left, which is drawn at its
own probability, so that no document's expectation is lost. Only DataFrame functions
are used; draws are hashes of ids, so reruns agree.

Targets are computed over one row for each source, in one task: sources are names in
a list, and a million of them take seconds.

Defined results: null text has size 0 and takes no part; a null source is a source
of its own that comes last; sources without words get target 0; repeated rows are
documents of their own; other columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import settle

#: Documents that one group of the reduction tree holds on average.
FAN_IN = 64
WHITE = " \t\n\x0b\x0c\r"


def count_words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; null has none."""
    body = F.btrim(text, F.lit(WHITE))
    return F.when(F.length(body) > 0, F.size(F.split(body, "[\\x20\\x09-\\x0D]+")).cast("long")).otherwise(F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Weights repeat over the sources by code point, null last. The table has one row
    for each source, as small as a list of sources is.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    w = sizes.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", pick).withColumn("room", cap * F.col("source_size"))
    # those with the least room for their weight fill up first
    fill = Window.orderBy(F.col("room") / F.col("weight"), "place")
    before, all_ = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = w.withColumns({
        "left_words": F.sum("source_size").over(all_).cast("double") - F.coalesce(F.sum("room").over(before), F.lit(0.0)),
        # from the total, as a frame that ends at the last row is summed anew for each row
        "left_weight": F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    v = v.withColumn("full", F.col("left_words") * F.col("weight") >= F.col("room") * F.col("left_weight"))
    # the fulls are a prefix of this order; the rest share what is left after the last of them
    first_open = F.first(F.when(~F.col("full"), F.struct("left_words", "left_weight")), ignorenulls=True).over(all_)
    v = v.withColumn("open", first_open)
    return v.select("source", "source_size", F.when(F.col("full"), F.col("room")).otherwise(F.col("open.left_words") * F.col("weight") / F.col("open.left_weight")).alias("target"))


def _uniform(*keys) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*keys), F.lit((1 << 52) - 1)) + 1) / F.lit(float(1 << 52))


def _fold(duels: Column) -> Column:
    """Fold a group's (id, size, p, u) into settled (id, take) and one survivor.

    A duel moves words between the carried document a and the next one b: either
    a gains up = min((1 - pa) sa, pb sb) words from b, or loses down = min(pa sa,
    (1 - pb) sb) to it; gaining has probability down / (up + down), which keeps
    each expectation.
    """
    doc = "struct<key:string,size:long,p:double,u:double>"
    settled = "array<struct<key:string,take:long>>"

    def duel(state: Column, b: Column) -> Column:
        a = state["held"]
        up = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"])
        down = F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])
        gain = b["u"] * (up + down) < down
        move = F.when(gain, up).otherwise(-down)
        # at the bound, exactly 0 or 1; which of the two got there is known from the minimum
        a_done = F.when(gain, (1 - a["p"]) * a["size"] <= b["p"] * b["size"]).otherwise(a["p"] * a["size"] <= (1 - b["p"]) * b["size"])
        pa, pb = a["p"] + move / a["size"], b["p"] - move / b["size"]
        clip = lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
        take_a = F.when(gain, F.lit(1)).otherwise(F.lit(0)).cast("long")
        take_b = F.when(gain, F.lit(0)).otherwise(F.lit(1)).cast("long")
        row = lambda x, p: F.struct(x["key"].alias("key"), x["size"].alias("size"), clip(p).alias("p"), x["u"].alias("u"))
        done = lambda x, take: F.array(F.struct(x["key"].alias("key"), take.alias("take")))
        fought = F.when(a_done, F.struct(row(b, pb).alias("held"), F.concat(state["done"], done(a, take_a)).alias("done"))).otherwise(F.struct(row(a, pa).alias("held"), F.concat(state["done"], done(b, take_b)).alias("done")))
        first = F.struct(row(b, b["p"]).alias("held"), state["done"].alias("done"))
        return F.when(a.isNull(), first).otherwise(fought)

    start = F.struct(F.lit(None).cast(doc).alias("held"), F.array().cast(settled).alias("done"))
    return F.aggregate(duels, start, duel)


def pivotal_round(fractions: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(key, take) from (part, key, size, p): each p in (0, 1) becomes 0 or 1.

    The sum of size * p of a part changes by less than one size. Keys are distinct.
    """
    live, settled, level = fractions, None, 0
    while True:
        count = live.groupBy("part").agg(F.count("*").alias("n"))
        many = count.filter("n > 1")
        if many.isEmpty():
            break
        grouped = live.join(count.withColumnRenamed("part", "of_part"), F.col("part").eqNullSafe(F.col("of_part")))
        groups = F.ceil(F.col("n") / F.lit(fan_in))
        dealt = grouped.select("part", F.pmod(F.xxhash64("key", F.lit(level)), groups).alias("grp"), F.struct(F.xxhash64("key", F.lit(level)).alias("at"), "key", F.col("size").cast("long").alias("size"), "p", _uniform("key", F.lit(-1 - level)).alias("u")).alias("d"))
        folded = dealt.groupBy("part", "grp").agg(F.sort_array(F.collect_list("d")).alias("ds"))
        folded = settle(folded.select("part", _fold(F.transform("ds", lambda d: F.struct(d["key"].alias("key"), d["size"].alias("size"), d["p"].alias("p"), d["u"].alias("u")))).alias("r")))
        out = folded.select(F.explode("r.done").alias("d")).select("d.key", "d.take")
        settled = out if settled is None else settled.union(out)
        live, level = folded.select("part", "r.held.key", "r.held.size", "r.held.p"), level + 1
    last = live.select("key", F.when(_uniform("key", F.lit("last")) < F.col("p"), 1).otherwise(0).cast("long").alias("take"))
    return last if settled is None else settled.union(last)


def _row_key() -> Column:
    """A name of a numbered row; null is told from any name."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return F.concat_ws("/", text("id"), text("nth"), text("size"), F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("source"))))


#: Equal rows that one task numbers.
EQUAL_ROWS = 100_000


def numbered(measured: DataFrame, most: int = EQUAL_ROWS) -> DataFrame:
    """measured with equal rows told apart by a column nth; equal rows are counted, never gathered."""
    columns = measured.columns
    counted = settle(measured.groupBy(*columns).agg(F.count("*").alias("times")))
    if counted.filter(F.col("times") > most).isEmpty():
        return counted.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("nth"))
    # a row that many equal: numbered in stretches, which are dealt out before they are rows again
    stretch = counted.select(*columns, "times", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(most).cast("long"))).alias("at"))
    dealt = stretch.repartition(*columns, "at")
    return dealt.select(*columns, F.explode(F.sequence(F.col("at") + 1, F.least(F.col("at") + most, F.col("times")))).alias("nth"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0, fan_in: int = FAN_IN) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for each row of docs."""
    measured = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), count_words(F.col(text_col)).alias("size"))
    # rows that repeat an id must not share a draw
    sized = settle(numbered(measured))
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    named = settle(sources.withColumnRenamed("source", "of_source"))
    each = sized.join(named, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    each = each.withColumn("whole", F.floor(ratio)).withColumn("p", ratio - F.floor(ratio)).withColumn("key", _row_key())
    each = settle(each)
    live = each.filter("size > 0 and p > 0").select(F.col("source").alias("part"), "key", "size", "p")
    taken = pivotal_round(live, fan_in)
    joined = each.join(taken, "key", "left")
    copies = (F.col("whole") + F.coalesce("take", F.lit(0))).cast("long")
    return joined.select("id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, copies).otherwise(F.lit(0).cast("long")).alias("copies"), (copies * F.col("size")).alias("taken"))
