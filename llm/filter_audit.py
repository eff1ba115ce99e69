"""Filter interaction audit: what every order of a set of filters keeps, removes and hides.

Method: wide packed counters.  A document's failures are a mask of bits.  Every mask maps to one big
integer whose 64-bit fields hold, for each step of each order of the filters (5 filters: 120 orders,
600 steps), whether the document is kept, removed, redundant or the filter's alone.  The integers of a
part are summed, each times its count, and unpacked once.  A field grows by at most one per document,
and a part has fewer than 2^63 documents, so no field reaches its neighbour.

Documents are first counted by (part, mask, marks) with map-side combine: a part sends at most
2^filters x 2^marks rows to its sum, however large it is, and parts are summed in parallel.

Defined cases: a null flag counts as passed, a null mark as not set, a null part as the empty string;
an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from itertools import permutations
from string import ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import Scratch, small_batches
from llm.first_copies import first_copies, salt_of

#: Bits of a field; counts of documents are 64-bit anyway.
WIDTH = 64
KEPT, REMOVED, REDUNDANT, UNIQUE = range(4)
#: 7 filters have 5,040 orders: an integer of 1.1 MB per mask.
MOST_FILTERS = 7


@lru_cache(maxsize=4)
def packed_outcomes(letters: str) -> list[int]:
    """Per mask (bit k: letter k fails) the integer of all its step outcomes."""
    steps = [(order[:k], f) for order in permutations(range(len(letters))) for k, f in enumerate(order)]
    out = []
    for mask in range(1 << len(letters)):
        fields = np.zeros((len(steps), 4), "<u8")
        for i, (earlier, f) in enumerate(steps):
            gone, fails = any(mask >> e & 1 for e in earlier), mask >> f & 1
            fields[i] = not gone and not fails, fails and not gone, fails and gone, mask == 1 << f
        out.append(int.from_bytes(fields.tobytes(), "little"))
    return out


def unpacked(total: int, steps: int) -> np.ndarray:
    """Step by outcome, from one packed sum."""
    return np.frombuffer(total.to_bytes(steps * 4 * WIDTH // 8, "little"), "<u8").reshape(steps, 4).astype(np.int64)


def _unfold(letters: str, marks: list[str]):
    orders = ["".join(o) for o in permutations(letters)]
    filter_of = np.array([letters.index(f) for o in orders for f in o])
    n = len(letters)

    def run(table: pa.Table) -> pa.Table:
        packed = packed_outcomes(letters)
        columns = table.to_pydict()
        mask, count = columns["mask"], columns["n"]

        def total(chosen):
            return unpacked(sum(c * packed[m] for m, c, yes in zip(mask, count, chosen, strict=True) if yes), len(filter_of))

        seen = total([True] * len(mask))
        lost = {f"{m}_lost": total(columns[m])[:, REMOVED] for m in marks}
        shapley = np.array([seen[filter_of == f, REMOVED].sum() for f in range(n)], np.int64)[filter_of]
        return pa.table({
            "part": [columns["part"][0]] * len(filter_of),
            "filter_order": np.repeat(orders, n),
            "step": pa.array(np.tile(np.arange(1, n + 1), len(orders)), pa.int32()),
            "kept": seen[:, KEPT], "removed": seen[:, REMOVED], "redundant": seen[:, REDUNDANT],
            "unique_fails": seen[:, UNIQUE], **lost, "shapley": shapley,
        })
    return run


def audit(counts: DataFrame, letters: str, marks: list[str]) -> DataFrame:
    """From counts (part, mask, one boolean per mark, n) to one row per part, order and step."""
    if not 1 <= len(letters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    longs = ["kept", "removed", "redundant", "unique_fails", *[f"{m}_lost" for m in marks], "shapley"]
    return counts.groupBy("part").applyInArrow(
        _unfold(letters, marks), "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in longs))


def mask_of(flags: list[Column]) -> Column:
    """Bit k is set where flag k is true."""
    return reduce(lambda a, b: a + b, [F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(flags)])


def text_failures(text: Column) -> tuple[Column, list[Column]]:
    """The words, and the conditions A to D on a text: short, repetitive, capital letters, symbols."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(text) - F.length(F.translate(text, ascii_uppercase, ""))
    return words, [
        F.size("words") < 200,
        F.size(F.array_distinct("words")) * 100 < F.size("words") * 50,
        capitals * 100 > F.length(text) * 2,
        text.rlike("[#$%&*|]"),
    ]


def filter_audit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
) -> DataFrame:
    """The audit of five filters on whole documents, per value of ``part_col``.

    A: under 200 words.  B: fewer than half of the words distinct.  C: over 2% capital letters.  D: holds a
    symbol of ``#$%&*|``.  E: the same text has a smaller id in the table (by SHA-256); a row without id
    neither fails E nor makes others fail.  ``good_lost`` and ``toxic_lost`` count removed documents with
    quality 1 and toxic 1 in ``labels``; of labels that repeat an id, any 1 counts.  Null texts are empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    words, failures = text_failures(F.col("text"))
    plain = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    with Scratch(spark) as scratch:
        slim = scratch.keep(plain.withColumn("words", words).select(
            "id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask_of(failures).alias("mask")), "masks")
        firsts = first_copies(scratch, slim, "digest", "id")
        repeat = (F.col("digest") == F.col("key")) & (salt_of("id") == F.col("salt"))
        again = F.when(F.col("id") > F.col("first"), F.lit(1 << len(failures))).otherwise(F.lit(0))
        # Counted per id before labels come in: rows that share an id shrink to a few.
        per_id = slim.join(firsts, repeat, "left").groupBy(
            "id", "part", (F.col("mask") + again).alias("mask")).agg(F.count(F.lit(1)).alias("n"))
        none = F.lit(False)
        counts = per_id.join(marked, "id", "left").groupBy(
            "part", "mask", F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic")
        ).agg(F.sum("n").alias("n"))
        return scratch.result(audit(counts, "ABCDE", ["good", "toxic"]))
