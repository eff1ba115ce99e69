"""Mixing sources to target weights, in DataFrame functions only.

The words of a source form one stream, in a fixed order of its documents, cut into blocks of
fixed length.  A source's target is so many whole passes over its blocks and a rest; a pass
visits the blocks in the order of a keyed pseudorandom permutation, and the last slot is cut
to the word.  Source counts are drawn for every output shard, multinomial given the sources'
totals; a shard's slots are the next ones of each source; slots are mapped to block numbers by
the permutation, and blocks join by (source, number).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import Scratch

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of a block.
BLOCK_WORDS = 1024
#: Words of an output shard.
SHARD_WORDS = 1 << 24
#: Passes of the swap-or-not shuffle; each halves what is left of the order.
ROUNDS = 24
#: Documents per chunk when stream positions are added up.
CHUNK_ROWS = 4096
#: Slots, or shards, handled in one row or window.
RUN = 4096
#: Slots a task makes, about.
TASK_SLOTS = 1 << 18


def word_count(text: Column) -> Column:
    """Runs of ``[^\\x20\\x09-\\x0D]``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def permuted(x: Column, n: Column, key: Column, back: bool = False) -> Column:
    """Place of x in a pseudorandom permutation of 0..n-1 chosen by ``key``; ``back`` inverts it.

    Swap-or-not shuffle: a round pairs x with k - x (mod n), and a hash of the larger of the two
    decides for both whether they swap.  Every round is its own inverse, for any n.
    """
    def turn(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        swap = F.xxhash64(key, r, F.greatest(x, partner)).bitwiseAND(1) == 1
        return F.when(swap, partner).otherwise(x)

    first, last = (ROUNDS, 1) if back else (1, ROUNDS)
    return F.aggregate(F.sequence(F.lit(first), F.lit(last)), x, turn)


def source_targets(sizes: DataFrame, share: float, most: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, words) to (source, words, target): shares by weight, capped, the excess reshared.

    One row per source.  With caps at ``most`` times the size and the level L as words per unit
    of weight, target = min(most * words, weight * L); L follows from the running sums of the
    sources in order of words / weight, in one pass instead of repeated resharing.
    """
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("place", F.row_number().over(in_order)).withColumn("weight", w)
    rows = rows.withColumn("ratio", F.col("words") * most / F.col("weight"))
    before = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rows = rows.withColumn("capped", F.coalesce(F.sum(F.col("words") * most).over(before), F.lit(0.0))) \
        .withColumn("open_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))) \
        .withColumn("all_words", F.sum("words").over(whole))
    rows = rows.withColumn("level", (F.col("all_words") * share - F.col("capped")) / F.col("open_weight"))
    # the first source that the level does not fill sets the level for it and all after it
    level = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "place", "level"))).over(whole)
    return rows.withColumn("level", level["level"]).select(
        "source", "place", "words", "rows",
        F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("words") * most)
        .otherwise(F.col("weight") * F.col("level")).alias("target"))


def _positions(docs: DataFrame) -> DataFrame:
    """Adds ``start``: words of the source before this document, in a fixed order.

    Two steps, so that a hot source is added up in chunks: documents within a chunk, then the
    chunks of a source (one row per CHUNK_ROWS documents).
    """
    order = F.xxhash64("doc_id", "size", "print")
    chunked = docs.withColumn("chunk", F.pmod(F.xxhash64(order), F.ceil(F.col("rows") / CHUNK_ROWS))).drop("rows")
    sums = chunked.groupBy("place", "chunk").agg(F.sum("size").alias("in_chunk"))
    earlier = Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("place", "chunk", F.coalesce(F.sum("in_chunk").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("place", "chunk").orderBy(order, "doc_id", "print").rowsBetween(Window.unboundedPreceding, -1)
    before = chunked.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return before.join(sums, ["place", "chunk"]).select(
        "place", "doc_id", "size", (F.col("base") + F.col("inner")).alias("start"))


def draw(numbers: DataFrame, per_shard: int, tasks: int, seed: int = 0) -> DataFrame:
    """Draws the source counts of every shard: (place, shard, n, first), n > 0.

    ``numbers`` has (place, slots) and any more columns, which are kept.  A shard has ``per_shard``
    slots, only the last fewer.  Multinomial draws of all shards, given that each source comes to its number of
    slots, are draws without replacement: all slots of all sources are dealt to the shards' places
    by one pseudorandom permutation and counted.  ``first`` is what earlier shards took of the source.
    """
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # one row per source
    source = numbers.withColumn("offset", F.coalesce(F.sum("slots").over(before), F.lit(0))).withColumn(
        "all_slots", F.sum("slots").over(Window.partitionBy()))
    # a row per run of slots, then its slots: no row ever holds a source's whole range
    dealt = source.select("place", "offset", "all_slots", "slots", F.explode(
        F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / RUN))).alias("run")) \
        .repartition(tasks, "place", "run").select("place", "all_slots", F.explode(F.sequence(
            F.col("offset") + F.col("run") * RUN,
            F.col("offset") + F.least(F.col("slots"), (F.col("run") + 1) * RUN) - 1)).alias("number"))
    at = permuted(F.col("number"), F.col("all_slots"), F.xxhash64(F.lit(seed), F.lit("shard")))
    counts = dealt.groupBy("place", F.floor(at / per_shard).alias("shard")).agg(F.count(F.lit(1)).alias("n"))

    # what earlier shards took, in groups of shards and then within a group
    counts = counts.withColumn("group", F.floor(F.col("shard") / RUN))
    earlier = Window.partitionBy("place").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy("place", "group").agg(F.sum("n").alias("in_group")).select(
        "place", "group", F.coalesce(F.sum("in_group").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("place", "group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0))
    return counts.join(groups, ["place", "group"]).withColumn("first", first).drop("group", "base").join(numbers, "place")


def slots(targets: DataFrame, *, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS,
          seed: int = 0) -> DataFrame:
    """(shard, place, slot, epoch, block, take): what every output shard takes, in order.

    A shard takes the next slots of each source, as many as drawn for it.
    Slots of a source fill whole passes first.  A pass's short last block may stand anywhere in
    its order; slots behind it start that much earlier, which sets how much the last slot takes.
    """
    source = targets.where("words > 0 and target >= 0.5").select(
        "place", F.col("words"), F.round("target").cast("long").alias("goal"),
        F.ceil(F.col("words") / block_words).alias("blocks"))
    source = source.withColumn(
        "passes", F.floor(F.col("goal") / F.col("words"))).withColumn(
        "rest", F.col("goal") - F.col("passes") * F.col("words"))
    numbers = source.withColumn("slots", F.col("passes") * F.col("blocks")
                                + F.least(F.col("blocks"), F.ceil(F.col("rest") / block_words) + F.lit(1)))
    # one number comes to the driver: it sets the tasks, which no later step may merge
    total = numbers.agg(F.sum("slots")).first()[0] or 0
    spark = targets.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_SLOTS))
    drawn = draw(numbers, max(1, shard_words // block_words), tasks, seed).repartition(tasks, "place", "shard")
    rows = drawn.select("*", F.explode(F.sequence(
        F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))
    rows = rows.withColumn("epoch", F.floor(F.col("slot") / F.col("blocks"))).withColumn(
        "step", F.col("slot") - F.col("epoch") * F.col("blocks"))

    key = F.xxhash64(F.lit(seed), "place", "epoch")
    rows = rows.withColumn("block", permuted(F.col("step"), F.col("blocks"), key))
    back = permuted(F.col("blocks") - 1, F.col("blocks"), key, back=True)  # the step of the short block
    length = F.least(F.lit(block_words).cast("long"), F.col("words") - F.col("block") * block_words)
    short = F.col("blocks") * block_words - F.col("words")
    behind = F.when((F.col("epoch") == F.col("passes")) & (F.col("step") > back), short).otherwise(F.lit(0).cast("long"))
    start = F.col("step") * block_words - behind
    take = F.when(F.col("epoch") < F.col("passes"), length).otherwise(
        F.greatest(F.lit(0).cast("long"), F.least(length, F.col("rest") - start)))
    return rows.withColumn("take", take).where("take > 0").select("shard", "place", "slot", "epoch", "block", "take")


def shard_counts(taken: DataFrame) -> DataFrame:
    """(shard, place, blocks, words): the draw as a table."""
    return taken.groupBy("shard", "place").agg(F.count(F.lit(1)).alias("blocks"), F.sum("take").alias("words"))


def pieces(placed: DataFrame, chosen: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Joins documents to the blocks taken: (place, doc_id, start, size, shard, slot, first, words).

    ``first`` is the word of the document where the piece begins.  A document that no slot takes
    keeps one row without a slot and 0 words.
    """
    spread = placed.where("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / block_words),
                                      F.floor((F.col("start") + F.col("size") - 1) / block_words))))
    at = F.col("block") * block_words
    begin = F.greatest(F.col("start"), at)
    words = F.least(F.col("start") + F.col("size"), at + F.col("take")) - begin
    return spread.join(chosen.drop("epoch"), ["place", "block"], "left").select(
        "place", "doc_id", "start", "size", "shard", "slot", (begin - F.col("start")).alias("first"),
        F.when(F.col("slot").isNull(), F.lit(0).cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), words)).alias("words"))


def layout(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
           source_col: str = "source", *, share: float = 1.5, most: float = 2.0,
           block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS,
           seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(targets, placed documents, slots): all that the mix consists of, before texts are cut."""
    sized = scratch.keep(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("print")), "sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    targets = scratch.keep(source_targets(by_source, share, most), "targets")
    names = targets.select(F.col("source").alias("name"), "place", "rows")
    placed = scratch.keep(_positions(sized.join(names, F.col("source").eqNullSafe(F.col("name"))).select(
        "doc_id", "size", "print", "place", "rows")), "placed")
    # staged, so that its measured size decides whether it is broadcast
    chosen = scratch.keep(slots(targets, block_words=block_words, shard_words=shard_words, seed=seed), "slots")
    return targets, placed, chosen


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        **options) -> DataFrame:
    """One row per document: its id, source, size, source_size, target, taken; options as ``layout``.

    ``taken`` counts the words of the document in the mix, repeats included; it never exceeds
    ``most`` times its size, and a source's total is its target to the word.  Null and blank
    texts have size 0 and give nothing.  A null source is a source of its own, last in order.
    Null or repeated ids and repeated rows are rows like others; columns besides the three are
    not read.  An empty table gives an empty table; a source of blank texts has target 0.
    """
    with Scratch(docs.sparkSession) as scratch:
        targets, placed, chosen = layout(docs, scratch, id_col, text_col, source_col, **options)
        taken = pieces(placed, chosen, options.get("block_words", BLOCK_WORDS)).groupBy(
            "place", "start", "doc_id", "size").agg(F.sum("words").alias("taken"))
        none = placed.where("size = 0").select("place", "start", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
        named = targets.select("place", "source", F.col("words").alias("source_size"), "target")
        return scratch.result(taken.union(none).join(named, "place").select(
            F.col("doc_id").alias(id_col), "source", "size", "source_size",
            F.col("target").cast("double").alias("target"), "taken"))
