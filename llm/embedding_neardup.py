"""Near-duplicate embeddings by cross-polytope hashing after fast Hadamard rotations.

Equal vectors of one label collapse into classes.  A hash is the largest coordinate, with its
sign, of a pseudorandomly rotated vector; a bucket is a label and two hashes.  Every class is
stored in one bucket per table and probes the next likely ones; a stored class and one that is
stored in or probes the same bucket are compared by exact cosine.  Buckets are cut into blocks,
and a task compares two blocks at a time.  A pair counts in the first table that finds it, so
links are counted without writing pairs; only a forest of links leaves a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import Forest, Scratch, by_group, connected_components
from llm.words import mixed

TABLES = 8
HASHES = 2
PROBES = 2
#: Entries of a bucket's block; a task holds two blocks.
BLOCK = 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, a power of two long."""
    n, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def polytope_codes(units: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Bucket codes of unit rows: stored (n, TABLES), and probed (n, TABLES, PROBES).

    A rotation is three rounds of random signs and a Hadamard transform.  The probes of a table
    replace one of its hashes by that vector's second choice, the closest call first.
    """
    n, d = units.shape
    width = max(2, 1 << (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = units
    stored = np.empty((n, TABLES), np.int64)
    probed = np.empty((n, TABLES, PROBES), np.int64)
    for t in range(TABLES):
        best, second, gap = [], [], []
        for h in range(HASHES):
            rng = np.random.default_rng((seed, d, t, h))
            x = padded
            for _ in range(3):
                x = hadamard(x * rng.choice([-1.0, 1.0], width))
            both = np.concatenate([x, -x], axis=1)
            top = np.argpartition(-both, 1, axis=1)[:, :2]
            value = np.take_along_axis(both, top, 1)
            swap = (value[:, 1] > value[:, 0])[:, None]
            top, value = np.where(swap, top[:, ::-1], top), np.where(swap, value[:, ::-1], value)
            best.append(top[:, 0])
            second.append(top[:, 1])
            gap.append(value[:, 0] - value[:, 1])
        best, second = np.array(best), np.array(second)
        stored[:, t] = code_of(best, width)
        closest = np.argsort(np.array(gap), axis=0)
        for p in range(PROBES):
            other = best.copy()
            which = closest[p % HASHES]
            other[which, np.arange(n)] = second[which, np.arange(n)]
            probed[:, t, p] = code_of(other, width)
    return stored, probed


def code_of(hashes: np.ndarray, width: int) -> np.ndarray:
    code = np.zeros(hashes.shape[1], np.int64)
    for h in hashes:
        code = code * (2 * width) + h
    return code


def _described(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, node, vec): node names the class, null for vectors that link with nothing."""
    def describe(batches):
        for batch in batches:
            nodes, packed = [], []
            for label, values in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                v = None
                if label is not None and values and None not in values:
                    v = np.array(values, np.float64) + 0.0  # one zero
                    if not np.isfinite(v).all() or not v.any():
                        v = None
                packed.append(None if v is None else v.tobytes())
                nodes.append(None if v is None else xxhash.xxh3_64_intdigest(f"{label} ".encode() + packed[-1]) - (1 << 63))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(packed, pa.binary())],
                names=["vec_id", "label", "node", "vec"])

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.mapInArrow(describe, f"vec_id long, label {kind}, node long, vec binary")


def _hashed(classes: DataFrame) -> DataFrame:
    """Adds ``buckets``: names of the bucket stored in and those probed, (TABLES, 1 + PROBES) packed longs."""
    def hashed(batches):
        for batch in batches:
            labels = batch.column("label").to_pylist()
            vecs = [np.frombuffer(b) for b in batch.column("vec").to_pylist()]
            names: list[bytes] = [b""] * len(vecs)
            for d in sorted({len(v) for v in vecs}):
                rows = [k for k, v in enumerate(vecs) if len(v) == d]
                # scaled first: the length of a huge vector does not overflow
                x = np.stack([vecs[k] / np.abs(vecs[k]).max() for k in rows])
                stored, probed = polytope_codes(x / np.linalg.norm(x, axis=1, keepdims=True))
                table = np.arange(1, TABLES + 1, dtype=np.uint64)[:, None] << np.uint64(40)
                for k, s, p in zip(rows, stored, probed, strict=True):
                    seed = np.array(xxhash.xxh3_64_intdigest(f"{labels[k]} {d}".encode()), np.uint64, ndmin=1)
                    codes = np.concatenate([s[:, None], p], axis=1).astype(np.uint64) + table
                    names[k] = mixed(codes ^ mixed(seed)).tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.binary()), pa.array(
                [list(dict.fromkeys(np.frombuffer(b, np.int64).tolist())) for b in names], pa.list_(pa.int64()))],
                names=[*batch.schema.names, "buckets", "places"])

    schema = T.StructType([*classes.schema.fields, T.StructField("buckets", T.BinaryType()),
                           T.StructField("places", T.ArrayType(T.LongType()))])
    return classes.mapInArrow(hashed, schema)


def first_meeting(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The bucket that counts a pair, for rows of packed buckets (n, TABLES, 1 + PROBES).

    It is of the first table where one is stored in a bucket the other is stored in or probes;
    if both ways hold there, it is the smaller bucket.  The least integer if they never meet.
    """
    none = np.iinfo(np.int64).max
    one = np.where((x[:, :, :1] == y).any(2), x[:, :, 0], none)
    other = np.where((y[:, :, :1] == x).any(2), y[:, :, 0], none)
    meet = np.minimum(one, other)
    first = (meet < none).argmax(1)
    return meet[np.arange(len(meet)), first]


def near_pairs(x: np.ndarray, y: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of rows (of x and y; of x alone) that reach the cosine, in double precision."""
    a = x / np.abs(x).max(1, keepdims=True)
    b = a if y is None else y / np.abs(y).max(1, keepdims=True)
    cosine = (a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)[None]
    near = cosine >= least
    return np.nonzero(np.triu(near, 1) if y is None else near)


def _found(tiles: DataFrame, least: float) -> DataFrame:
    """Of each tile (bucket, i, j): rows (node, links, other), other being the node's root in the tile's forest."""
    def search(batches):
        for group in by_group(batches, ["bucket", "i", "j"]):
            side = group.column("side").to_numpy()
            cut = int((side == 0).sum())
            if cut == 0 or len(side) < 2:
                continue
            # equal names of buckets for different vector lengths are as good as excluded; be sure
            if len({len(b) for b in group.column("vec").to_pylist()}) > 1:
                raise ValueError("vectors of different length in one bucket")
            x = np.stack([np.frombuffer(b) for b in group.column("vec").to_pylist()])
            p, q = near_pairs(x, None, least) if cut == len(side) else near_pairs(x[:cut], x[cut:], least)
            if not len(p):
                continue
            q = q if cut == len(side) else q + cut
            bucket = group.column("bucket")[0].as_py()
            names = np.stack([np.frombuffer(b, np.int64).reshape(TABLES, 1 + PROBES) for b in group.column("buckets").to_pylist()])
            nodes, weight = group.column("node").to_numpy(), group.column("weight").to_numpy()
            links, forest = np.zeros(len(nodes), np.int64), Forest(len(nodes))
            for k in range(0, len(p), 1 << 14):  # pieces: memory stays small even if all pairs are near
                a, b = p[k:k + (1 << 14)], q[k:k + (1 << 14)]
                here = first_meeting(names[a], names[b]) == bucket
                a, b = a[here], b[here]
                np.add.at(links, a, weight[b])
                np.add.at(links, b, weight[a])
                for i, j in zip(a.tolist(), b.tolist(), strict=True):
                    forest.join(i, j)
            some = np.flatnonzero(links).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes[some]), pa.array(links[some]), pa.array(nodes[[forest.root(k) for k in some]])],
                names=["node", "links", "other"])

    return tiles.mapInArrow(search, "node long, links long, other long")


def embedding_neardup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                      label_col: str = "label", *, least: float = 0.93) -> DataFrame:
    """One row per vector: its id, n_links (other vectors of its label at cosine >= least), component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components, and vectors
    without label, link with nothing: n_links 0, their own component.  Vectors of different
    length do not link.  Equal vectors link; rows that repeat an id are rows like others.  A
    null id links, but names no component unless nothing else can.  Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with Scratch(spark) as scratch:
        described = scratch.keep(_described(rows), "described")
        classes = scratch.keep(described.where("node is not null").groupBy("node").agg(
            F.first("label").alias("label"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("weight"),
            F.min("vec_id").alias("rep")), "classes")
        hashed = scratch.keep(_hashed(classes), "hashed")
        entries = hashed.select("node", F.explode("places").alias("bucket"))
        live = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
            "bucket", F.ceil(F.col("n") / BLOCK).alias("blocks"))
        placed = entries.join(live, "bucket").withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")))
        tiles = placed.select("bucket", "node", "b", F.explode(
            F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("o")).select(
            "bucket", "node", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"),
            (F.col("b") > F.col("o")).cast("int").alias("side"))
        laid = tiles.join(hashed.select("node", "weight", "vec", "buckets"), "node").repartition(
            2 * parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side", "node")
        found = scratch.keep(_found(laid, least), "found")
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        components = connected_components(scratch, found.select(F.col("node").alias("a"), F.col("other").alias("b")))
        named = scratch.keep(classes.select("node", "weight", "rep").join(
            components.withColumnRenamed("id", "node"), "node", "left").withColumn(
            "component", F.coalesce("component", "node")), "named")
        smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
        known = named.join(smallest, "component").join(links, "node", "left").select(
            "node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
        out = described.select("vec_id", "node").join(known, "node", "left")
        component = F.coalesce("component_id", "vec_id")
        return scratch.result(out.select(
            F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
            component.alias("component_id"), (F.col("vec_id") == component).alias("kept")))
