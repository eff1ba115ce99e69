"""Second-order boosted trees for a binary label, one barrier stage per model.

Columns are binned once to bytes; every tree grows level by level from sums of gradients and
hessians per (node, column, bin).  The tasks of the barrier stage keep their rows, bytes and
scores in memory for all trees and exchange only those sums, so a tree costs no Spark job.

Sums are whole numbers (gradients in units of 2^-20): they add up to the same in any order and
over any number of tasks, and all tasks choose the same splits without a leader.  Of two children
only the lighter one is summed and exchanged; the other is its parent less that.  Row samples
come from a hash of the row's key, column samples from the seed and the tree's number, so the
model does not depend on how rows lie in partitions.

Memory of a task: its rows times (columns + about 60) bytes.  One exchange carries, at most, tasks x
split nodes x bins of all columns x 16 bytes, cut to ``EXCHANGE_BYTES``; hence at most ``MOST_TASKS`` tasks, with more
rows in each.  A lost executor restarts the stage from the staged input.  Barrier stages need a
fixed set of executors with as many free slots as tasks.
"""

from __future__ import annotations

import base64
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import BarrierTaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latelens.operators.staging import scratch_folder

BINS = 256
UNIT = float(1 << 20)
ROWS_PER_TASK, MOST_TASKS = 100_000, 256
EXCHANGE_BYTES = 32 << 20
_TREE = "tree int, feature array<int>, threshold array<double>, leaf array<double>, gain array<double>"
_ODD = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Layout:
    """How the parts of a feature vector become byte columns.

    A numeric feature is a column with sorted ``edges`` (bin b holds values up to edge b).  A group of
    indicators of which at most one is set is one column: 0 for none, else the indicator's place.
    """

    width: int
    edges: dict[int, np.ndarray]
    groups: list[tuple[int, int]]

    def binned(self, x: np.ndarray) -> np.ndarray:
        columns = [np.minimum(np.searchsorted(e, x[:, f]), len(e) - 1) for f, e in self.edges.items()]
        for start, size in self.groups:
            block = x[:, start:start + size] > 0
            columns.append(np.where(block.any(axis=1), block.argmax(axis=1) + 1, 0))
        return np.asfortranarray(np.stack(columns, axis=1).astype(np.uint8))

    def sizes(self) -> list[int]:
        return [len(e) for e in self.edges.values()] + [size + 1 for _, size in self.groups]

    def cuts(self) -> list[tuple[int, float, int, int, int]]:
        """Every possible split: feature, threshold, column, and the bins (low, high] that go right."""
        out = []
        for c, (f, e) in enumerate(self.edges.items()):
            out += [(f, float(e[b]), c, b, BINS) for b in range(len(e) - 1)]
        for c, (start, size) in enumerate(self.groups, start=len(self.edges)):
            out += [(start + j, 0.0, c, j, j + 1) for j in range(size)]
        return sorted(out, key=lambda s: s[:2]) or [(0, np.inf, 0, 0, 0)]  # nothing to split: all stays left


def cut_places(sizes: list[int], cuts: list) -> tuple[np.ndarray, np.ndarray]:
    """Per cut, which places of the running sums over all bins bound what lies to the right."""
    begin = np.concatenate([[0], np.cumsum(sizes)])
    column = np.array([c[2] for c in cuts])
    low = begin[column] + np.array([c[3] for c in cuts]) + 1
    high = np.minimum(begin[column] + np.array([c[4] for c in cuts]) + 1, begin[column + 1])
    return low, high


def right_sums(hist: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Per (node, cut) what lies to the right, from sums per (node, bin of every column)."""
    running = np.concatenate([np.zeros((len(hist), 1), hist.dtype), np.cumsum(hist, axis=1)], axis=1)
    return running[:, high] - running[:, low]


def sampled_rows(keys: np.ndarray, tree: int, share: float) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64((tree + 1) * _ODD % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) < np.uint64(share * (1 << 53))


def sampled_features(width: int, tree: int, share: float, seed: int) -> np.ndarray:
    chosen = np.zeros(width, bool)
    chosen[np.random.default_rng([seed, tree]).permutation(width)[:max(1, int(share * width))]] = True
    return chosen


def packed(part: np.ndarray) -> bytes:
    """Which of the whole numbers are not zero, and those in as few bytes as the largest needs."""
    flat = part.ravel()
    at = flat != 0
    values = flat[at]
    most = max(int(values.max()), -int(values.min()) - 1) if len(values) else 0
    size = next(b for b in range(1, 9) if b == 8 or most < 1 << (8 * b - 1))
    low = values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :size]
    return bytes([size]) + np.packbits(at).tobytes() + low.tobytes()


def add_packed(message: bytes, out: np.ndarray) -> None:
    """Adds what ``packed`` has written to ``out``, an array of one dimension."""
    raw = np.frombuffer(message, np.uint8)
    size, values = int(raw[0]), 1 + -(-len(out) // 8)
    at = np.unpackbits(raw[1:values], count=len(out)).view(bool)
    wide = np.zeros(((len(raw) - values) // size, 8), np.uint8)
    wide[:, 8 - size:] = raw[values:].reshape(-1, size)
    out[at] += wide.view("<i8").ravel() >> (8 * (8 - size))


class Exchange:
    """Messages from each task of a barrier stage to all others.

    Spark's own ``allGather`` looks for an answer once a second only, and a model needs thousands of them.
    So messages are files of a shared folder, read as soon as they are there, and gathered by Spark only
    where tasks do not see each other's files.  A task that is killed ends its waiting.
    """

    def __init__(self, folder: str, tasks: int):
        self.tasks, self.turn, self.store = tasks, 0, None
        if tasks > 1:
            self.context = BarrierTaskContext.get()
            self.me = self.context.partitionId()
            attempt = self.context.allGather(str(self.context.taskAttemptId()))[0]  # no other try of the stage has it
            if not all(seen == "yes" for seen in self.context.allGather("yes" if self._opened(folder, attempt) else "no")):
                self.store = None

    def _opened(self, folder: str, attempt: str) -> bool:
        try:
            local = re.match("(?:file:/*)?(/.*|$)", folder)
            store, root = (fs.LocalFileSystem(), "/" + local[1].lstrip("/")) if local else fs.FileSystem.from_uri(folder)
            self.store, self.root = store, f"{root}/{attempt}"
            store.create_dir(self.root, recursive=True)
            self._write(b"")
            written = True
        except (OSError, ValueError, ImportError):
            written = False
        self.context.barrier()
        return written and all(self._there(k) for k in range(self.tasks))

    def _path(self, task: int, turn: int | None = None) -> str:
        return f"{self.root}/{self.turn if turn is None else turn}-{task}"

    def _there(self, task: int) -> bool:
        return self.store.get_file_info(self._path(task)).type == fs.FileType.File

    def _write(self, message: bytes) -> None:
        with self.store.open_output_stream(f"{self._path(self.me)}.part") as out:
            out.write(message)
        self.store.move(f"{self._path(self.me)}.part", self._path(self.me))

    def others(self, message: bytes) -> Iterator[bytes]:
        """Hands out ``message`` and yields those of all other tasks."""
        if self.store is None:
            got = self.context.allGather(base64.b64encode(message).decode())
            yield from (base64.b64decode(m) for k, m in enumerate(got) if k != self.me)
            return
        self.turn += 1
        self._write(message)
        for k in (k % self.tasks for k in range(self.me + 1, self.me + self.tasks)):
            wait = 0.0005
            while not self._there(k):
                time.sleep(wait)
                wait = min(2 * wait, 0.02)
            with self.store.open_input_file(self._path(k)) as file:
                yield file.read()
        # All have written for this turn, so all have read what was written for the one before.
        self.store.delete_file(self._path(self.me, self.turn - 1))


def _summed(own: np.ndarray, exchange: Exchange) -> np.ndarray:
    """The sum of all tasks' arrays; rows travel in portions that fit a message."""
    if exchange.tasks == 1:
        return own
    out = own.copy()
    step = max(1, EXCHANGE_BYTES // (exchange.tasks * own[:1].nbytes))
    for a in range(0, len(own), step):
        total = out[a:a + step].reshape(-1)
        for message in exchange.others(packed(own[a:a + step])):
            add_packed(message, total)
    return out


@dataclass
class BoostedTrees:
    """Estimator.  ``penalty`` shrinks leaves, ``least_hessian`` bounds a leaf's sum of hessians from below."""

    label: str
    weight: str
    key: str
    rounds: int
    depth: int
    penalty: float = 1.0
    least_hessian: float = 1.0
    rate: float = 0.05
    row_share: float = 1.0
    column_share: float = 1.0
    seed: int = 42
    features: str = "features"
    groups: list[tuple[int, int]] = field(default_factory=list)
    rows_per_task: int = ROWS_PER_TASK

    def layout(self, frame: DataFrame) -> Layout:
        """Bin edges from one sketch over all numeric features: at most 256 numbers each."""
        x = vector_to_array(self.features)
        first = frame.select(F.size(x)).first()
        if first is None:
            raise ValueError("no rows to learn from")
        grouped = {f for start, size in self.groups for f in range(start, start + size)}
        numeric = [f for f in range(first[0]) if f not in grouped]
        ranks = [i / (BINS - 1) for i in range(BINS)]
        found = frame.select(x.alias("x")).agg(*[F.percentile_approx(F.col("x")[f], ranks, 10_000) for f in numeric]).first() if numeric else []
        return Layout(first[0], {f: np.unique(found[i]) for i, f in enumerate(numeric)}, self.groups)

    def fit(self, frame: DataFrame, layout: Layout | None = None) -> BoostedModel:
        """``frame`` should be staged: it is read twice.  Models of the same features may share a ``layout``."""
        layout = layout or self.layout(frame)
        slots = frame.sparkSession.sparkContext.defaultParallelism
        tasks = max(1, min(-(-frame.count() // self.rows_per_task), slots, MOST_TASKS))
        rows = frame.select(
            F.xxhash64(self.key).alias("key"), F.col(self.label).cast("double").alias("y"),
            F.col(self.weight).cast("double").alias("w"), vector_to_array(self.features).alias("x"))
        with scratch_folder(frame.sparkSession, "sums") as folder:
            grown = rows.repartition(tasks).mapInArrow(_grower(self, layout, tasks, folder), _TREE, barrier=True)
            trees = sorted(grown.collect(), key=lambda r: r["tree"])  # one row per tree
        return BoostedModel(
            self.features, layout.width, self.depth, np.array([r["feature"] for r in trees], np.int64),
            np.array([r["threshold"] for r in trees]), np.array([r["leaf"] for r in trees]), np.array([r["gain"] for r in trees]))


def _grower(plan: BoostedTrees, layout: Layout, tasks: int, folder: str):
    sizes, cuts = layout.sizes(), layout.cuts()
    begin = np.concatenate([[0], np.cumsum(sizes)])
    feature = np.array([c[0] for c in cuts], np.int64)
    threshold = np.array([c[1] for c in cuts])
    column, low, high = (np.array([c[k] for c in cuts], np.int64) for k in (2, 3, 4))
    places = cut_places(sizes, cuts)

    def sums(table: np.ndarray, g: np.ndarray, h: np.ndarray, slot: np.ndarray, slots: int) -> np.ndarray:
        """Per slot of the given rows (-1: of none) the sums of both measures per bin of every column."""
        own = np.zeros((slots, 2, begin[-1]), np.int64)
        rows = np.flatnonzero(slot >= 0)
        slot, g, h = slot[rows], g[rows], h[rows]
        for c, size in enumerate(sizes):
            at = slot * size + table[:, c][rows]
            for k, value in enumerate((g, h)):
                own[:, k, begin[c]:begin[c + 1]] = np.bincount(at, value, slots * size).reshape(slots, size)
        return own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ys, ws, bins = [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0)], []
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, layout.width)
                bins.append(layout.binned(x))
                for held, name in ((keys, "key"), (ys, "y"), (ws, "w")):
                    held.append(b.column(name).to_numpy(zero_copy_only=False))
        key, y, w = (np.concatenate(v) for v in (keys, ys, ws))
        table = np.asfortranarray(np.concatenate(bins)) if bins else np.empty((0, len(sizes)), np.uint8, order="F")
        flat, exchange = table.reshape(-1, order="F"), Exchange(folder, tasks)
        score, row = np.zeros(len(y)), np.arange(len(y))
        out = []
        for tree in range(plan.rounds):
            p = 1.0 / (1.0 + np.exp(-score))
            g, h = np.rint(w * (p - y) * UNIT), np.rint(w * p * (1.0 - p) * UNIT)
            taken = sampled_rows(key, tree, plan.row_share) if plan.row_share < 1 else np.ones(len(y), bool)
            allowed = sampled_features(layout.width, tree, plan.column_share, plan.seed)[feature]
            # hist has the sums of the nodes that may be split, live, in their order.
            node, live = np.zeros(len(y), np.int64), np.zeros(1, np.int64)
            hist = _summed(sums(table, g, h, np.where(taken, 0, -1), 1), exchange)
            totals = hist[:, :, :sizes[0]].sum(axis=2)
            picked_f, picked_t, picked_g = [], [], []
            for level in range(plan.depth):
                nodes = 1 << level
                if level and len(live):
                    # Children stand side by side: of each pair the lighter is summed, the other is what is left.
                    pair = totals[live, 1].reshape(-1, 2)
                    light = 2 * np.arange(len(pair)) + (pair[:, 1] < pair[:, 0])
                    slot = np.full(nodes, -1)
                    slot[live[light]] = np.arange(len(light))
                    parents, hist = hist, np.empty((len(live), *hist.shape[1:]), np.int64)
                    hist[light] = _summed(sums(table, g, h, np.where(taken, slot[node], -1), len(light)), exchange)
                    hist[light ^ 1] = parents - hist[light]
                right_g, right_h = (right_sums(hist[:, k], *places) for k in range(2))
                gr, hr = right_g / UNIT, right_h / UNIT
                total = totals[live]
                g_all, h_all = total[:, :1] / UNIT, total[:, 1:] / UNIT
                gl, hl = (total[:, :1] - right_g) / UNIT, (total[:, 1:] - right_h) / UNIT
                gain = gl**2 / (hl + plan.penalty) + gr**2 / (hr + plan.penalty) - g_all**2 / (h_all + plan.penalty)
                fits = (hl >= plan.least_hessian) & (hr >= plan.least_hessian) & allowed
                gain = np.where(fits, gain, -np.inf)
                at, among = gain.argmax(axis=1), np.arange(len(live))
                best, top, moved = np.zeros(nodes, np.int64), np.full(nodes, -np.inf), np.zeros((nodes, 2), np.int64)
                best[live], top[live] = at, gain[among, at]
                split = top > 1e-6
                moved[live] = np.stack([right_g[among, at], right_h[among, at]], 1)
                moved[~split] = 0
                picked_f += np.where(split, feature[best], 0).tolist()
                picked_t += np.where(split, threshold[best], np.inf).tolist()
                picked_g += np.where(split, top, 0.0).tolist()
                value = np.arange(BINS)
                right = split[:, None] & (value > low[best][:, None]) & (value <= high[best][:, None])
                reached = flat[(column[best] * len(y))[node] + row]
                node = 2 * node + right.reshape(-1)[node * BINS + reached]
                totals = np.stack([totals - moved, moved], axis=1).reshape(2 * nodes, 2)
                hist, live = hist[split[live]], live[split[live]]
                live = np.stack([2 * live, 2 * live + 1], axis=1).reshape(-1)
            leaf = -plan.rate * (totals[:, 0] / UNIT) / (totals[:, 1] / UNIT + plan.penalty)
            score += leaf[node]
            out.append((tree, picked_f, picked_t, leaf.tolist(), picked_g))
        if tasks == 1 or BarrierTaskContext.get().partitionId() == 0:
            names = [part.split()[0] for part in _TREE.split(", ")]
            kinds = [pa.int32(), pa.list_(pa.int32()), *[pa.list_(pa.float64())] * 3]
            columns = zip(*out) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)
    return run


@dataclass
class BoostedModel:
    """Full binary trees in level order; a split sends values above the threshold right."""

    features: str
    width: int
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    gain: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        total, row = np.zeros(len(x)), np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[row, f[node]] > t[node])
            total += leaf[node - ((1 << self.depth) - 1)]
        return total

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Adds the probability of the positive label; one Arrow batch at a time, no shuffle."""
        @F.arrow_udf("double")
        def probability(x: pa.Array) -> pa.Array:
            flat = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), self.width)
            return pa.array(1.0 / (1.0 + np.exp(-self.margins(flat))))

        return df.withColumn(name, probability(vector_to_array(self.features)))

    def importances(self) -> np.ndarray:
        """Mean gain of a feature's splits, as shares of all features' means."""
        used = self.threshold < np.inf
        total = np.bincount(self.feature[used], self.gain[used], self.width)
        mean = total / np.maximum(np.bincount(self.feature[used], minlength=self.width), 1)
        return mean / mean.sum() if mean.sum() > 0 else mean

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, *(a[i].tolist() for a in (self.feature, self.threshold, self.leaf, self.gain))) for i in range(len(self.leaf))]
        frame = spark.createDataFrame(rows, _TREE).selectExpr(
            "*", f"'{self.features}' AS features", f"{self.width} AS width", f"{self.depth} AS depth")
        frame.coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedModel:
        rows = spark.read.parquet(path).orderBy("tree").collect()  # one row per tree
        return cls(rows[0]["features"], rows[0]["width"], rows[0]["depth"], np.array([r["feature"] for r in rows], np.int64),
                   *(np.array([r[c] for r in rows]) for c in ("threshold", "leaf", "gain")))
