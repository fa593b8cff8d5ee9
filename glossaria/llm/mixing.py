"""Mixing sources to target weights, with DataFrame functions only.

Sources in code point order (null last) weigh 5, 2, 1, repeating, and share all words by weight; a
target stops at `cap` times its source's size and the excess goes to the others by weight.  The
words of a source's documents, in a fixed order, are packed into blocks of `block` words.  A
source's target is a number of slots: passes over all its blocks, then slots for what is left, the
last one cut short.  A table of counts says how many slots each output shard draws of each source:
multinomial given the source's total, as each slot falls on a shard at random.  Slots map to block
indices by a pseudorandom permutation for each source and pass (a swap-or-not shuffle, a
bijection for any size), and join the packed documents by block index.

Totals miss a source's target by less than one block.  A document's words are taken at most
ceil(target / source size) times.  All draws are hashes of fixed keys, so reruns agree.  Offsets are
two-level prefix sums, so a source of a third of all rows is split.

Null texts have size 0 and, like sources without words, nothing is taken of them.  Rows that repeat
are separate documents with their own place.  Other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaria.llm.common import WORD_PATTERN, frozen, numbered_rows

BLOCK = 128
SHARD_SLOTS = 1 << 20
SLOTS_A_ROW = 4096
SLOTS_A_TASK = 32_768
ROUNDS = 14
_SEED = 20_240_229


def targets(sizes: DataFrame, weights=(5, 2, 1), cap: int = 3) -> DataFrame:
    """(source, source_no, source_size, target) from sizes(source, size): one row a source."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = found.select("source", "source_size", F.row_number().over(by_name).alias("source_no"))
    found = found.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") - 1) % len(weights) + 1))
    # the share of one unit of weight: the largest that follows from capping the sources that fill up first
    fills = Window.orderBy(F.col("source_size") / F.col("weight"), "source_no")
    rest = fills.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total, ahead = F.sum("source_size").over(all_rows), F.sum("source_size").over(fills.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("unit", (total - cap * F.coalesce(ahead, F.lit(0))) / F.sum("weight").over(rest))
    found = found.withColumn("unit", F.max("unit").over(all_rows))
    target = F.least((cap * F.col("source_size")).cast("double"), F.col("unit") * F.col("weight"))
    return found.select("source", "source_no", "source_size", target.alias("target"))


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0 .. n - 1, another one for each key."""

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)
        chosen = F.xxhash64(*key, r, F.greatest(x, partner)).bitwiseAND(F.lit(1)) == 1
        return F.when(chosen, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), step)


def placed(sizes: DataFrame, found: DataFrame) -> DataFrame:
    """sizes with source_no, source_size, target and the offset of each document among its source's words."""
    chunks = max(1, math.isqrt(sizes.count()))
    rows = sizes.alias("s").join(found.alias("f"), F.col("s.source").eqNullSafe(F.col("f.source")))
    rows = rows.select("s.doc_id", "s.size", "f.source_no", "f.source_size", "f.target", F.pmod(F.xxhash64("s.doc_id"), F.lit(chunks)).alias("chunk"))
    within = Window.partitionBy("source_no", "chunk").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("source_no", "chunk").agg(F.sum("size").alias("all"))
    bases = bases.select("source_no", "chunk", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    rows = rows.withColumn("through", F.sum("size").over(within)).join(bases, ["source_no", "chunk"])
    return rows.select("doc_id", "size", "source_no", "source_size", "target", (F.col("base") + F.col("through") - F.col("size")).alias("offset"))


def shard_counts(found: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(source, source_no, n_blocks, passes, left, shard, n_slots, first_slot): how many slots each shard draws of each source.

    Each of a source's slots falls on a shard at random, so a source's counts are multinomial given its
    total, which its target fixes.  A shard's slots are consecutive ones of the source, from first_slot on.
    """
    s = found.where(F.col("source_size") > 0).select(
        "source", "source_no", "source_size", "target",
        F.ceil(F.col("source_size") / block).cast("long").alias("n_blocks"),
        F.floor(F.col("target") / F.col("source_size")).cast("long").alias("passes"),
    )
    s = s.withColumn("left", F.greatest(F.lit(0), F.floor(F.col("target")).cast("long") - F.col("passes") * F.col("source_size")))
    s = s.withColumn("all_slots", F.col("passes") * F.col("n_blocks") + F.ceil(F.col("left") / block).cast("long")).where(F.col("all_slots") > 0)
    total = s.agg(F.sum("all_slots")).first()[0] or 0
    shards = max(1, -(-total // shard_slots))
    s = s.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("all_slots") - 1) / SLOTS_A_ROW).cast("long"))))
    s = s.repartition(total // SLOTS_A_TASK + 1, F.col("source_no"), F.col("run"))  # few rows, but each draws thousands
    first = F.col("run") * SLOTS_A_ROW
    s = s.withColumn("slot", F.explode(F.sequence(first, F.least(first + SLOTS_A_ROW, F.col("all_slots")) - 1)))
    drawn = s.withColumn("shard", F.pmod(F.xxhash64("source", "slot", F.lit(_SEED)), F.lit(shards)))
    counts = drawn.groupBy("source", "source_no", "n_blocks", "passes", "left", "shard").agg(F.count("*").alias("n_slots"))
    before = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first_slot", F.coalesce(F.sum("n_slots").over(before), F.lit(0)))


def slots(counts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source_no, slot, pass_no, shard, block, words): for shard_counts, which block each slot takes, and how many of its words."""
    total = counts.agg(F.sum("n_slots")).first()[0] or 0
    s = counts.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_slots") - 1) / SLOTS_A_ROW).cast("long"))))
    s = s.repartition(total // SLOTS_A_TASK + 1, F.col("source_no"), F.col("shard"), F.col("run"))
    first = F.col("run") * SLOTS_A_ROW
    s = s.withColumn("slot", F.explode(F.sequence(F.col("first_slot") + first, F.col("first_slot") + F.least(first + SLOTS_A_ROW, F.col("n_slots")) - 1)))
    s = s.withColumn("pass_no", F.floor(F.col("slot") / F.col("n_blocks")).cast("long"))
    nth = F.col("slot") - F.col("pass_no") * F.col("n_blocks")
    words = F.when(F.col("pass_no") < F.col("passes"), F.lit(block)).otherwise(F.least(F.lit(block), F.col("left") - nth * block))
    return s.select("source_no", "slot", "pass_no", "shard", permuted(nth, F.col("n_blocks"), F.col("source"), F.col("pass_no"), F.lit(_SEED)).alias("block"), words.cast("long").alias("words"))


def sizes_of(docs: DataFrame) -> DataFrame:
    n = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n.alias("size"))


def mixed_pieces(docs: DataFrame, weights=(5, 2, 1), cap: int = 3, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix: a row for each piece of a document and each slot that takes its block.

    (doc_id, size, source_size, target, source_no, offset, shard, slot, first_word, words): words
    first_word .. first_word + words - 1 of the document, counted from 0, belong to that slot of the
    shard.  Pieces that no slot takes have null shard and slot and 0 words; so have documents without words.
    """
    sizes = frozen(sizes_of(docs), "mix-sizes")
    found = frozen(targets(sizes, weights, cap), "mix-targets")
    rows = placed(sizes, found)
    through = F.greatest(F.col("offset"), F.col("offset") + F.col("size") - 1)
    its_blocks = F.sequence(F.floor(F.col("offset") / block).cast("long"), F.floor(through / block).cast("long"))
    none = F.array(F.lit(-1).cast("long"))  # a document without words is in no block
    rows = rows.withColumn("block", F.explode(F.when(F.col("size") > 0, its_blocks).otherwise(none)))
    start = F.greatest(F.col("offset"), F.col("block") * block)
    rows = rows.withColumn("start", start).withColumn("end", F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * block))
    chosen = slots(frozen(shard_counts(found, block, shard_slots), "mix-shards"), block).select("source_no", "block", "shard", "slot", F.col("words").alias("room"))
    joined = rows.join(chosen.hint("merge"), ["source_no", "block"], "left")  # both sides grow with the input
    words = F.greatest(F.lit(0), F.least(F.col("end"), F.col("block") * block + F.coalesce(F.col("room"), F.lit(0))) - F.col("start")).cast("long")
    return joined.select("doc_id", "size", "source_size", "target", "source_no", "offset", "shard", "slot", (F.col("start") - F.col("offset")).alias("first_word"), words.alias("words"))


def taken(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, size, source_size, target, taken, n_shards) for every row of docs(doc_id, source, text); n_shards is how many output shards take words of it.

    A document without words shares its offset with another one, so size belongs to the key; equal
    rows without words stay apart by their number.
    """
    pieces = mixed_pieces(docs, **settings)
    sums = pieces.groupBy("doc_id", "size", "source_no", "offset", "source_size", "target").agg(F.sum("words").alias("taken"), F.size(F.collect_set(F.when(F.col("words") > 0, F.col("shard")))).cast("long").alias("n_shards"), F.when(F.col("size") == 0, F.count("*")).otherwise(1).alias("copies"))
    return sums.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))).select("doc_id", "size", "source_size", "target", "taken", "n_shards")


def resampled(docs: DataFrame, **settings) -> DataFrame:
    """Rows of docs, each as often as the mix takes its words, rounded along its source's running sum of rates.

    A row's rate is the words taken of it by its words.  Rows run from short to long, so a source's
    words miss what the mix takes of it by its longest document at most.  Rows without words go.
    """
    numbered = numbered_rows(docs)
    key = F.xxhash64("doc.doc_id", "doc.source", "doc.text")  # not the row's number: reruns agree whatever the partitions
    pieces = mixed_pieces(numbered.select(key.alias("doc_id"), F.col("doc.source").alias("source"), F.col("doc.text").alias("text")), **settings).where("size > 0")
    rates = pieces.groupBy("doc_id", "size", "source_no", "offset").agg(F.floor(F.sum("words") * F.lit(1 << 30) / F.col("size")).alias("rate"))
    # parts of one order, by source, size and a hash: sums within parts and over them don't depend on where they end
    rates = rates.withColumn("tie", F.xxhash64("doc_id", "offset")).repartitionByRange("source_no", "size", "tie").withColumn("part", F.spark_partition_id())
    rates = frozen(rates, "mix-rates")
    before = Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = rates.groupBy("source_no", "part").agg(F.sum("rate").alias("all"))
    bases = bases.select(F.col("source_no").alias("its_no"), F.col("part").alias("its_part"), F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source_no", "part").orderBy("size", "tie", "doc_id", "offset").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    through = rates.withColumn("through", F.sum("rate").over(within)).join(bases, (F.col("source_no") == F.col("its_no")) & (F.col("part") == F.col("its_part")))
    half = F.col("base") + F.col("through") + F.lit(1 << 29)
    times = through.select("doc_id", "source_no", "size", "offset", (F.shiftright(half, 30) - F.shiftright(half - F.col("rate"), 30)).cast("int").alias("times"))
    # rows with equal keys are as good as one another: each takes one of their places
    times = times.select(F.col("doc_id").alias("its_key"), F.row_number().over(Window.partitionBy("doc_id").orderBy("source_no", "size", "offset")).alias("its_nth"), "times").where("times > 0")
    rows = numbered.select("its_row", key.alias("key")).withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("its_row")))
    taken_rows = rows.join(times, (F.col("key") == F.col("its_key")) & (F.col("nth") == F.col("its_nth"))).select(F.col("its_row").alias("row_taken"), "times")
    return numbered.join(taken_rows.hint("shuffle_hash"), F.col("its_row") == F.col("row_taken")).select("doc", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth")).select("doc.*")
