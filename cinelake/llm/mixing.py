"""Mixing sources to target weights, in blocks.

The tokens of a source, its documents laid end to end, are cut into blocks of one length. Output shards draw how many blocks they take from
each source from a multinomial distribution; the draws of a source number its slots, slots go through a pseudorandom permutation of the
source's block indices (a new one for every pass over it), and blocks are joined by index. Everything is a DataFrame expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from cinelake.llm.ranks import running_totals
from cinelake.llm.texts import shielded
from cinelake.session import cut_lineage

BLOCK, BLOCKS_PER_SOURCE = 64, 1024
MOST_SHARDS, SLOTS_PER_SHARD = 256, 4096
SLOTS_PER_TASK = 250_000
MOST_PASSES = 3
ROUNDS = 16
_PIECE = 4096


def word_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text: each, with the white space around it, becomes one letter. Null has none."""
    letters = F.regexp_replace(text, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")
    return F.when(F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")), F.length(letters)).otherwise(F.lit(0)).cast("bigint")


def targets(sources: DataFrame, most_passes: int = MOST_PASSES) -> DataFrame:
    """Add weight and target to (source, source_size): sources in code-point order, null last, weigh 1, 2, 3 in turn and share the sum of all sizes.

    A target stops at `most_passes` times the source's size and the excess goes to the others by weight, until none is above: the water
    level of a filling, found from the order in which sources reach their limit. One row per source is all that this sees.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ranked = sources.withColumn("weight", ((place - 1) % 3 + 1).cast("double")).withColumn("most", (most_passes * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    filled = F.coalesce(F.sum("most").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (total - filled) / open_weight  # the level if exactly the sources before this one are full
    stops = ranked.withColumn("__level", level).withColumn("__full", F.col("most") / F.col("weight") < F.col("__level"))
    # the first source that is not full gives the level
    first = F.first(F.when(~F.col("__full"), F.col("__level")), ignorenulls=True).over(everything)
    return stops.withColumn("target", F.least("most", F.coalesce(first, F.lit(0.0)) * F.col("weight"))).drop("__level", "__full", "most")


def unit(*parts) -> Column:
    """A number in [0, 1) that depends on the parts only."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """The image of `index` under a permutation of 0 .. n - 1 chosen by the key (swap-or-not, `ROUNDS` rounds)."""

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, *key), n) - x, n)
        return F.when(F.pmod(F.xxhash64(F.greatest(x, other), r, *key), F.lit(2)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, swap)


def _expanded(df: DataFrame, count: Column, name: str, tasks: int | None) -> DataFrame:
    """`count` copies of every row, numbered from 0 in `name`, in two steps so that no row becomes one huge array.

    The pieces are few and small before they are laid out, so the number of tasks is given (by default that of any shuffle) and not left
    to the size of the pieces.
    """
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = df.withColumn("__count", count).filter("__count > 0").withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__count") - 1) / _PIECE))))
    start = F.col("__piece") * _PIECE
    dealt = pieces.repartition(tasks, F.xxhash64(*pieces.columns))
    return dealt.withColumn(name, F.explode(F.sequence(start, F.least(start + _PIECE, F.col("__count")) - 1))).drop("__count", "__piece")


def draw_counts(sources: DataFrame, shards: int, tasks: int | None = None) -> DataFrame:
    """(source, shard, first_slot, taken): how many blocks each output shard takes of each source.

    `sources` has source, n_blocks and expected (blocks the whole mix should take). A shard's draw is multinomial by the residual method:
    the whole part of each expectation is certain, what is left of the shard is drawn with the probabilities of the remainders. A source
    whose target is its limit gives every block on every pass and needs no draw; no source gives more than `MOST_PASSES` passes.
    """
    certain = F.col("expected") >= MOST_PASSES * F.col("n_blocks")
    cells = sources.filter(~certain).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))))
    cells = cells.withColumn("__mean", F.col("expected") / shards).withColumn("sure", F.floor("__mean")).withColumn("rest", F.col("__mean") - F.col("sure"))
    along = Window.partitionBy("shard").orderBy(F.col("source").asc_nulls_last())
    cells = cells.withColumn("upper", F.sum("rest").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    draws = cells.groupBy("shard").agg(F.max("upper").alias("all"))
    # the number of draws is the remainder's whole part, and one more with the probability of what is left over
    draws = draws.withColumn("n", F.floor("all") + (unit("shard", F.lit("more")) < F.col("all") - F.floor("all")).cast("bigint"))
    draws = _expanded(draws, F.col("n"), "draw", tasks).select("shard", (unit("shard", "draw", F.lit("draw")) * F.col("all")).alias("upper"))
    # draws and the sources' upper bounds in one order: a draw goes to the next bound
    line = cells.select("shard", "upper", F.struct("source").alias("owner"), F.lit(1).alias("bound"))
    line = line.unionByName(draws.select("shard", "upper", F.lit(None).cast(line.schema["owner"].dataType).alias("owner"), F.lit(0).alias("bound")))
    onward = Window.partitionBy("shard").orderBy(F.desc("upper"), F.desc("bound")).rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last("owner", ignorenulls=True).over(onward)
    drawn = line.withColumn("owner", owner).filter("bound = 0").groupBy("shard", "owner").agg(F.count(F.lit(1)).alias("drawn"))
    a, b = cells.alias("a"), drawn.alias("b")
    counted = a.join(b, (F.col("a.shard") == F.col("b.shard")) & F.col("a.source").eqNullSafe(F.col("b.owner.source")), "left").select(
        "a.source", "a.n_blocks", "a.shard", (F.col("sure") + F.coalesce("drawn", F.lit(0))).alias("taken")
    )
    fixed = sources.filter(certain).select("source", "n_blocks", F.lit(0).cast("bigint").alias("shard"), (MOST_PASSES * F.col("n_blocks")).alias("taken"))
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    slots = counted.unionByName(fixed).withColumn("first_slot", F.coalesce(F.sum("taken").over(before), F.lit(0)))
    room = MOST_PASSES * F.col("n_blocks") - F.col("first_slot")
    return slots.withColumn("taken", F.greatest(F.lit(0), F.least("taken", room)).cast("bigint"))


def mixed_blocks(counts: DataFrame, tasks: int | None = None) -> DataFrame:
    """(source, shard, slot, block): every slot of every shard with the block it takes."""
    slots = _expanded(counts, F.col("taken"), "__at", tasks).withColumn("slot", F.col("first_slot") + F.col("__at"))
    epoch = F.floor(F.col("slot") / F.col("n_blocks"))
    block = permuted(F.col("slot") % F.col("n_blocks"), F.col("n_blocks"), F.coalesce("source", F.lit("\x00")), epoch)
    return slots.select("source", "shard", "slot", block.alias("block"))


def sized_sources(docs: DataFrame) -> DataFrame:
    """Per source its size, target, block length, number of blocks and the blocks the mix should take of it. `docs` has source and size."""
    sizes = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")))
    length = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.col("source_size") / BLOCKS_PER_SOURCE))).cast("bigint")
    sizes = sizes.withColumn("block_length", length).withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block_length")))
    return sizes.withColumn("expected", F.when(F.col("source_size") > 0, F.col("target") * F.col("n_blocks") / F.col("source_size")).otherwise(F.lit(0.0)))


def _planned(keyed: DataFrame, shards: int | None) -> DataFrame:
    """From rows of key, source and size: the same with start (words of the source before it), source_size, target, block_length, times and taken.

    times lists, for the blocks the row has words in, how often the mix takes each. Equal rows share a key and lie one after another.
    """
    rows = cut_lineage(keyed)
    sources = cut_lineage(sized_sources(rows))
    slots = sources.agg(F.sum("expected")).first()[0] or 0
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(slots / SLOTS_PER_TASK))
    if shards is None:
        shards = int(min(MOST_SHARDS, max(1, slots // SLOTS_PER_SHARD)))
    placed = running_totals(rows, ["source"], ["key"], "size", "start").drop("group_rows", "group_total")
    l, r = placed.alias("l"), sources.alias("r")  # noqa: E741
    full = l.join(r, F.col("l.source").eqNullSafe(F.col("r.source"))).select("l.*", "r.source_size", "r.target", "r.block_length")
    times = mixed_blocks(draw_counts(sources.select("source", "n_blocks", "expected"), shards, tasks), tasks).groupBy("source", "block").agg(F.count(F.lit(1)).alias("times"))
    first, last = F.floor(F.col("start") / F.col("block_length")), F.floor((F.col("start") + F.col("size") - 1) / F.col("block_length"))
    parts = full.filter("size > 0").select("key", "source", "start", "size", "block_length", F.explode(F.sequence(first, last)).alias("block"))
    overlap = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("block_length")) - F.greatest(F.col("start"), F.col("block") * F.col("block_length"))
    parts = parts.withColumn("overlap", overlap).drop("size", "block_length")
    # what was laid out by `explode` is far more than Spark's estimate of it: merged, or it would be broadcast
    l, r = parts.alias("l"), times.hint("merge").alias("r")  # noqa: E741
    met = l.join(r, (F.col("l.block") == F.col("r.block")) & F.col("l.source").eqNullSafe(F.col("r.source")), "left").select("l.*", F.coalesce("times", F.lit(0)).alias("times"))
    given = met.groupBy("key", "start").agg(F.sum(F.col("overlap") * F.col("times")).alias("taken"), F.array_sort(F.collect_list(F.struct("block", "times"))).alias("blocks"))
    # an empty row starts where the next one does and has no blocks
    empty = full.filter("size = 0").withColumn("taken", F.lit(0).cast("bigint")).withColumn("times", F.array().cast("array<bigint>"))
    filled = full.filter("size > 0").join(given.hint("merge"), ["key", "start"]).withColumn("times", F.transform("blocks", lambda b: b["times"])).drop("blocks")
    return filled.unionByName(empty)


def mix(docs: DataFrame, shards: int | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) for every row of `docs`.

    A document's words lie in one or more blocks of its source; it gives the words of every block as often as the mix takes the block,
    three times at most. Without a given number of output shards, a shard has `SLOTS_PER_SHARD` blocks, more if there were over
    `MOST_SHARDS` shards. Null sources are a source of their own, null texts have no words; repeated rows are documents of their own;
    an empty table gives no rows. The same rows give the same mix at every run, however they are partitioned.
    """
    keyed = docs.select(
        F.xxhash64(doc_id, source, text).alias("key"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size")
    )
    return _planned(keyed, shards).select("doc_id", "size", "source_size", "target", F.col("taken").cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, shards: int | None = None, text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself, with the columns of `docs`: up to `MOST_PASSES` rows a document.

    The n-th row holds the words of the blocks that the mix takes at least n times, joined by one space; where that is the whole document,
    its text is left as it is. Rows without words are not part of the mix. Columns may have any names; no rows give no rows.
    """
    names = docs.columns
    docs = shielded(docs)
    # two hashes of 64 bits: rows that share a key are equal
    rows = docs.withColumn("__key", F.concat_ws(":", F.xxhash64(*docs.columns), F.xxhash64(F.lit("key"), *docs.columns)))
    planned = _planned(rows.select(F.col("__key").alias("key"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size")), shards)
    plans = planned.filter("taken > 0").groupBy(F.col("key").alias("__key")).agg(F.collect_list(F.struct("start", "block_length", "times")).alias("__plans"))
    met = rows.join(plans.hint("merge"), "__key").dropDuplicates(["__key"]).withColumn("__plan", F.explode("__plans")).drop("__plans")
    met = met.withColumn("__pass", F.explode(F.sequence(F.lit(1), F.array_max("__plan.times").cast("int"))))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    length, start = F.col("__plan.block_length"), F.col("__plan.start")
    place = lambda i: (F.floor((start + i) / length) - F.floor(start / length)).cast("int")
    some = F.array_join(F.filter(words, lambda w, i: F.get(F.col("__plan.times"), place(i)) >= F.col("__pass")), " ")
    taken = F.when(F.array_min("__plan.times") >= F.col("__pass"), F.col(text)).otherwise(some)
    return met.withColumn(text, taken).select(*docs.columns).toDF(*names)
