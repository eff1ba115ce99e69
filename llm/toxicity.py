"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and word beginnings.  The terms most unevenly spread between the labels of a
bounded labelled sample form the vocabulary; all other words together count as one more term,
so a text's share of vocabulary terms matters too.  Document frequencies come from all
documents.  The examples lie in blocks; a term's largest weight per block bounds what the
block can reach, and only blocks that can reach the k-th best cosine so far are opened.
Votes are weighted by distance and mapped to a probability by isotonic regression.
"""

from __future__ import annotations

from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import Scratch, as_bytes, bounded_sample
from llm.decontaminate import PUNCTUATION
from llm.language_id import held_out

#: Labelled documents of each label, at most: they bound the index and what reaches the driver.
PER_LABEL = 6_000
VOCABULARY = 1_500
PREFIXES = (4, 5, 6, 7)
NEIGHBOURS = 25
BLOCK = 64
#: Least chi-square of a vocabulary term, well above what chance gives among a million terms.
LEAST_CHI2 = 40.0
THRESHOLD = 0.3


def term_counts(text: bytes | None) -> Counter:
    """Words without punctuation, A-Z lower-cased; counts per word."""
    return Counter(text.lower().translate(None, PUNCTUATION).split()) if text else Counter()


def terms_of(word: bytes) -> list[bytes]:
    """The word, and its beginnings marked by a space (longer ones only)."""
    return [word, *(word[:n] + b" " for n in PREFIXES if len(word) >= n)]


class Vocabulary:
    def __init__(self, terms: list[bytes]):
        self.ids = {t: k for k, t in enumerate(terms, 1)}  # 0: all other words
        self.heads = {t[:4].rstrip(b" ") for t in terms}
        self.short = {t for t in terms if len(t.rstrip(b" ")) < 4}

    def count(self, text: bytes | None) -> dict[int, int]:
        """Times of each vocabulary term; a word with none of them counts for term 0."""
        found: dict[int, int] = {}
        for word, n in term_counts(text).items():
            known = False
            if word[:4] in self.heads:
                for t in terms_of(word):
                    if (k := self.ids.get(t)) is not None:
                        found[k] = found.get(k, 0) + n
                        known = True
            if not known:
                found[0] = found.get(0, 0) + n
        return found


class BlockMaxIndex:
    """Posting lists of normalised vectors, cut at block borders, with each piece's largest weight."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int):
        n = len(vectors)
        self.n, self.blocks = n, -(-n // BLOCK)
        sizes = np.array([len(t) for t, _ in vectors], np.int64)
        doc = np.repeat(np.arange(n), sizes)
        term = np.concatenate([t for t, _ in vectors]) if n else np.empty(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]) if n else np.empty(0)
        order = np.lexsort((doc, term))
        self.doc, self.weight, term = doc[order], weight[order], term[order]
        cell = term * self.blocks + self.doc // BLOCK
        self.start = np.searchsorted(cell, np.arange(terms * self.blocks + 1))
        self.peak = np.zeros(terms * self.blocks)
        np.maximum.at(self.peak, cell, self.weight)
        self.peak = self.peak.reshape(terms, self.blocks)

    def cosines(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Exact cosines with every example of the given blocks, a row per block, from their posting lists."""
        cell = (terms[:, None] * self.blocks + blocks[None]).ravel()
        first, size = self.start[cell], self.start[cell + 1] - self.start[cell]
        at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        row = np.repeat(np.tile(np.arange(len(blocks)), len(terms)), size)
        gain = np.repeat(np.repeat(weights, len(blocks)), size) * self.weight[at]
        return np.bincount(row * BLOCK + self.doc[at] % BLOCK, gain, len(blocks) * BLOCK).reshape(-1, BLOCK)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines of the k nearest, and of all that tie with the k-th.

        The most promising blocks give the k-th best so far; then every block that can reach it is opened.
        """
        bound = weights @ self.peak[terms]
        order = np.argsort(-bound, kind="stable")
        opened = order[:8 + k // BLOCK]
        docs, values = [], []
        while len(opened):
            docs.append((opened[:, None] * BLOCK + np.arange(BLOCK)).ravel())
            values.append(self.cosines(terms, weights, opened).ravel())
            if len(docs) == 2:
                break
            real = np.sort(values[0][docs[0] < self.n])
            least = real[-k] if len(real) >= k else -1.0
            rest = order[len(opened):]
            opened = rest[bound[rest] >= least - 1e-9]
        docs, values = np.concatenate(docs), np.concatenate(values)
        docs, values = docs[docs < self.n], values[docs < self.n]
        least = np.partition(values, len(values) - k)[len(values) - k] if len(values) > k else -1.0
        near = np.flatnonzero(values >= least - 1e-9)
        near = near[np.lexsort((docs[near], -np.round(values[near], 9)))]
        return docs[near], values[near]


class Neighbours:
    """The fitted model: idf, index of examples, labels, weights of the labels and the calibration."""

    def __init__(self, idf: np.ndarray, rows: list[tuple[int, list[int], list[int], int]], prior: float):
        self.idf = idf
        # examples with the same heaviest terms stand together, so that the blocks' bounds are tight
        rows = sorted(rows, key=lambda r: (sorted(r[1], key=lambda t: (-idf[t], t)), r[0]))
        self.ids = np.array([r[0] for r in rows])
        self.toxic = np.array([r[3] for r in rows], np.float64)
        mean = self.toxic.mean()
        # the sample's labels are not in the corpus's proportion: weigh them back
        self.odds = np.where(self.toxic > 0, prior / max(mean, 1e-9), (1 - prior) / max(1 - mean, 1e-9))
        self.index = BlockMaxIndex([self.vector(t, n) for _, t, n, _ in rows], len(idf))
        self.prior, self.steps, self.cache = prior, None, {}

    def vector(self, terms, times) -> tuple[np.ndarray, np.ndarray]:
        t = np.asarray(terms, np.int64)
        w = (1 + np.log(np.asarray(times, np.float64))) * self.idf[t] if len(t) else np.empty(0)
        norm = np.sqrt((w * w).sum())
        return t, w / norm if norm else w

    def vote(self, terms, times) -> tuple[float, list[int]]:
        t, w = self.vector(terms, times)
        if not len(t) or not self.index.n:
            return self.prior, []
        key = (t.tobytes(), np.round(w, 9).tobytes())
        if key not in self.cache:
            near, cosine = self.index.nearest(t, w, NEIGHBOURS)
            pull = self.odds[near] / (1.05 - np.minimum(cosine, 1))
            if len(self.cache) > 50_000:
                self.cache.clear()
            self.cache[key] = float((pull * self.toxic[near]).sum() / pull.sum()), self.ids[near[:3]].tolist()
        return self.cache[key]

    def calibrate(self, rows: list[tuple[int, list[int], list[int], int]]) -> None:
        """Isotonic steps from votes to shares of toxic rows, by pooling adjacent violators."""
        votes = sorted((round(self.vote(t, n)[0], 9), y) for _, t, n, y in rows)
        mean = sum(y for _, y in votes) / len(votes) if votes else 0
        odds = {1: self.prior / max(mean, 1e-9), 0: (1 - self.prior) / max(1 - mean, 1e-9)}
        pools: list[list[float]] = []
        for v, equal in groupby(votes, key=lambda x: x[0]):
            labels = [y for _, y in equal]
            pools.append([v, odds[1] * sum(labels), sum(odds[y] for y in labels)])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                _, a, b = pools.pop()
                pools[-1][1] += a
                pools[-1][2] += b
        if pools:
            self.steps = np.array([p[0] for p in pools]), np.array([(p[1] + 0.01 * self.prior) / (p[2] + 0.01) for p in pools])

    def score(self, vote: float) -> float:
        if self.steps is None:
            return vote
        return float(self.steps[1][max(0, np.searchsorted(self.steps[0], round(vote, 9), side="right") - 1)])


def vocabulary(sample: DataFrame, per_label: dict[int, int]) -> list[bytes]:
    """The terms with the largest chi-square against the label, VOCABULARY at most."""
    def terms(batches):
        for batch in batches:
            totals: Counter = Counter()
            for text, y in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                totals.update((t, y) for t in {t for w in term_counts(text) for t in terms_of(w)})
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in totals], pa.binary()), pa.array([y for _, y in totals], pa.int32()),
                 pa.array(list(totals.values()), pa.int64())], names=["term", "y", "n"])

    n1, n0 = float(per_label.get(1, 0)), float(per_label.get(0, 0))
    if not n1 or not n0:
        return []
    counts = sample.select("text", "y").mapInArrow(terms, "term binary, y int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    cross = a * n0 - b * n1
    chi2 = (n1 + n0) * cross * cross / (n1 * n0 * (a + b) * (n1 + n0 - a - b + 1e-9))
    best = counts.withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2).orderBy(F.desc("chi2"), "term").limit(VOCABULARY)
    return [bytes(r.term) for r in best.collect()]


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", *, per_label: int = PER_LABEL) -> DataFrame:
    """One row per document: its id, held_out, score, predicted, and the ids of up to 3 nearest examples.

    Labels come from rows that are not held out only; of each label at most ``per_label`` rows,
    chosen by a hash of the id, a fifth of them for calibration alone.  A document labelled
    twice counts by its largest label; null labels and labels without a document count for
    nothing.  Null and empty texts score the share of toxic labels, as does everything if there
    are no labels of either kind.  Null ids and repeated rows are scored like others; other
    columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with Scratch(spark) as scratch:
        known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(
            F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y")).where("y in (0, 1)")
        totals = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        prior = totals.get(1, 0) / max(1, sum(totals.values()))
        chosen = scratch.keep(bounded_sample(scratch, known, "y", "id", per_label), "chosen")
        # at most twice per_label rows: a bounded broadcast
        sample = texts.where("text is not null").join(F.broadcast(chosen), "id")
        per = {r.y: r.n for r in chosen.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        terms = spark.sparkContext.broadcast(Vocabulary(vocabulary(sample, per)))
        held = len(terms.value.ids) + 1

        def count(batches):
            for batch in batches:
                found = [terms.value.count(t) for t in as_bytes(batch.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([list(f) for f in found], pa.list_(pa.int32())),
                     pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))], names=["id", "terms", "times"])

        kind = docs.schema[id_col].dataType.simpleString()
        counted = scratch.keep(texts.mapInArrow(count, f"id {kind}, terms array<int>, times array<int>"), "counted")
        size = counted.count()
        def present(batches):
            for batch in batches:
                n = np.bincount(batch.column(0).flatten().to_numpy(), minlength=held)
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], names=["t", "n"])

        df = counted.select("terms").mapInArrow(present, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()
        idf = np.ones(held)
        for r in df:
            idf[r.t] = np.log(1 + size / r.n)
        idf[0] = 0.5
        rows = [(r.id, list(r.terms), list(r.times), r.y, r.place) for r in counted.where("size(terms) > 0").join(
            F.broadcast(chosen), "id").dropDuplicates(["id"]).orderBy("id").toLocalIterator()]
        model = Neighbours(idf, [r[:4] for r in rows if r[4] % 5], prior)
        model.calibrate([r[:4] for r in rows if r[4] % 5 == 0])
        model.cache = {}
        fitted = spark.sparkContext.broadcast(model)

        def score(batches):
            for batch in batches:
                votes = [fitted.value.vote(t, n) for t, n in zip(
                    batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                scores = np.array([fitted.value.score(v) if near else fitted.value.prior for v, near in votes])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32)),
                     pa.array([near for _, near in votes], pa.list_(pa.int64()))], names=["id", "score", "predicted", "evidence"])

        scored = counted.mapInArrow(score, f"id {kind}, score double, predicted int, evidence array<long>")
        return scratch.result(scored.select(
            F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", "predicted", "evidence"))
