"""Resampling towards a target: hashed n-gram importance weights and a repeatable weighted draw.

Method: Arrow kernels over whole batches.  ``ascii_lower`` and ``split_pattern_regex`` give the
words of every text, ``list_flatten`` and ``dictionary_encode`` turn them into indices.  Indices
shifted against one another form the n-grams, CRC-32 is computed for the distinct ones only (each
continues the CRC of its first n - 1 words), ``take`` spreads the buckets' gains back over the
features, and a segment sum adds them up per document.

First pass: how often each of the fixed number of buckets occurs in all documents and in all target
texts, at most one row per bucket and partition.  Second pass: weights.  The draw (Gumbel noise from
a hash of seed and id, so that it is without replacement and the same on every run) counts the
scores, of which there are few different ones, and then ranks only rows at or above the cut, in
ranges.  Nothing is sorted in one task, and no text is shuffled.

Defined cases: a null or empty text has no features and weight 0; a null id hashes as an empty
string and ranks behind others of its score; rows that repeat an id are scored and ranked one by
one; with an empty target every gain compares with the plain bucket share; an empty table gives no
rows.  Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latelens.operators.ordered import running_totals
from llm.common import Scratch, small_batches

#: What stands between words, once A-Z are lower-cased: all of ASCII but digits and letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ngrams(texts: pa.Array, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per n: row of every n-gram, its index among the distinct ones, and their CRC-32."""
    split = pc.split_pattern_regex(pc.ascii_lower(texts.cast(pa.large_utf8())), GAP)
    length = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.list_flatten(split).dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    row = np.repeat(np.arange(len(length)), length)
    if b"" in words:  # in front of a leading gap, behind a trailing one
        full = index != words.index(b"")
        row, index = row[full], index[full]
    spaced = [b" " + w for w in words] if high > 1 else []
    starts, gram, crc = np.arange(len(index)), index, np.array([zlib.crc32(w) for w in words], np.int64)
    for n in range(1, high + 1):
        if n > 1:
            last = starts + (n - 1)
            inside = last < len(index)
            inside[inside] = row[last[inside]] == row[starts[inside]]
            starts = starts[inside]
            distinct, shorter = np.unique(gram[inside] * len(words) + index[starts + n - 1], return_inverse=True)
            crc = np.array([zlib.crc32(spaced[p % len(words)], int(crc[p // len(words)])) for p in distinct.tolist()], np.int64)
            gram = shorter
        if n >= low:
            yield row[starts], gram, crc


def _count(low: int, high: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, gram, crc in ngrams(batch.column(0), low, high):
                total += np.bincount(crc[gram] % buckets, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])
    return run


def bucket_counts(texts: DataFrame, low: int, high: int, buckets: int) -> np.ndarray:
    """Features per bucket over all rows of a one-column frame; one row per bucket comes to the driver."""
    counts = np.zeros(buckets, np.int64)
    parts = texts.mapInArrow(_count(low, high, buckets), "bucket long, n long")
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed bucket shares, target against corpus, floored."""
    k, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([
        math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k))))
        for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist(), strict=True)
    ], np.int64)


def _weigh(low: int, high: int, gain: np.ndarray):
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            n, total, words = (np.zeros(rows, np.int64) for _ in range(3))
            for k, (row, gram, crc) in enumerate(ngrams(batch.column("text"), 1, high), start=1):
                if k == 1:
                    words = np.bincount(row, minlength=rows)
                if k >= low:
                    per = pa.array(gain[crc % buckets]).take(pa.array(gram)).to_numpy(zero_copy_only=False)
                    size = np.bincount(row, minlength=rows)
                    # Rows come in order: a segment's sum is a difference of running sums.
                    run_sum = np.concatenate([[0], np.cumsum(per)])
                    end = np.cumsum(size)
                    total += run_sum[end] - run_sum[end - size]
                    n += size
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_key"), pa.array(words), pa.array(n), pa.array(weight)],
                names=["id", "text_key", "n_words", "n_features", "weight"])
    return run


def resampling_table(
    docs: DataFrame, target: DataFrame, *, words: tuple[int, int] = (1, 1), buckets: int = 10_000, seed: int = 2024,
    least_words: int = 20, percent: int = 10, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """Every document's n_words, n_features, weight, score and rank (null where it is not drawn).

    ``percent`` of the documents with ``least_words`` or more are drawn, rounded down, the highest scores
    first, ties to the smaller id.  ``text_key`` tells rows of one id apart.
    """
    low, high = words
    if not 1 <= low <= high:
        raise ValueError("words must be (least, most) with 1 <= least <= most")
    spark = docs.sparkSession
    small_batches(spark)
    gain = gains(bucket_counts(docs.select(text_col), low, high, buckets),
                 bucket_counts(target.select(target_col), low, high, buckets))
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()
    weighed = slim.mapInArrow(_weigh(low, high, gain),
                              f"id {id_type}, text_key long, n_words long, n_features long, weight long")
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    draw = F.conv(F.substring(mark, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((draw + 0.5) / 4294967296.0)))
    with Scratch(spark) as scratch:
        scored = scratch.keep(weighed.withColumn("score", F.col("weight") + noise), "scored")
        long_enough = scored.where(F.col("n_words") >= least_words)
        # Gains and noise are bounded logarithms in thousandths: some ten thousand scores at any size.
        tally = scratch.keep(long_enough.groupBy("score").agg(F.count(F.lit(1)).alias("n")), "tally")
        drawn = (tally.agg(F.sum("n")).first()[0] or 0) * percent // 100
        upto = F.sum("n").over(Window.orderBy(F.desc("score")))
        cut = tally.select("score", upto.alias("upto")).where(F.col("upto") >= max(drawn, 1)).agg(F.max("score")).first()[0]
        near = (F.col("n_words") >= least_words) & (F.col("score") >= F.lit(cut)) if drawn else F.lit(False)
        order = [F.desc("score"), F.asc_nulls_last("id"), F.col("text_key"), F.col("n_words")]
        placed = running_totals(scored.where(near), [], order, {"ahead": F.lit(1)})
        ranked = placed.withColumn("rank", F.when(F.col("ahead") < drawn, F.col("ahead") + 1).cast("long")).drop("ahead")
        rest = scored.where(~near).withColumn("rank", F.lit(None).cast("long"))
        return scratch.result(ranked.union(rest).withColumnRenamed("id", id_col))


def importance_resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents, whole rows as they are; rows equal in id and text go together."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    drawn = resampling_table(docs, target, **options).where("rank is not null")
    keys = drawn.select(F.col(id_col).alias("_drawn_id"), F.col("text_key").alias("_drawn_text"))
    same = docs[id_col].eqNullSafe(keys["_drawn_id"]) & (F.xxhash64(docs[text_col]) == keys["_drawn_text"])
    return docs.join(keys, same, "left_semi")
