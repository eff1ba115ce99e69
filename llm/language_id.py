"""Language identification by a byte convolutional network, trained here in numpy.

A text is cut into windows of fixed length, the last one padded with zero bytes.  Filters of
several widths slide over embedded bytes, the largest answer of each filter over the window
goes into a softmax, and a text's answer is the mean over its windows, by their bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import Scratch, as_bytes, bounded_sample, small_batches

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: Bounds of the labelled sample: documents in all, documents per language, windows per document.
SAMPLE_DOCS, SAMPLE_PER_LANG, SAMPLE_WINDOWS = 20_000, 600, 3
UNDETERMINED = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def held_out(id_col: str) -> Column:
    """crc32 of the id as text, mod 4, is 2; false without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode()))


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts, a row each, and how many each text has (one at least)."""
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts], np.int64)
    padded = b"".join(t.ljust(int(n) * WINDOW, b"\0") for t, n in zip(texts, counts, strict=True))
    return np.frombuffer(padded, np.uint8).reshape(-1, WINDOW), counts


@dataclass
class ByteNet:
    """Weights: byte embedding, one filter bank over the widest window with zeros beyond a filter's width, softmax."""

    langs: list[str]
    embed: np.ndarray
    bank: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    shift: np.ndarray

    @classmethod
    def fresh(cls, langs: list[str], rng: np.random.Generator) -> ByteNet:
        n = FILTERS * len(WIDTHS)
        return cls(langs, rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
                   (rng.normal(0, 0.2, (max(WIDTHS) * EMBEDDING, n)) * cls.used()).astype(np.float32), np.zeros(n, np.float32),
                   rng.normal(0, 0.1, (n, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))

    @staticmethod
    def used() -> np.ndarray:
        """Which weights of the bank a filter's width lets it use."""
        mask = np.zeros((max(WIDTHS) * EMBEDDING, FILTERS * len(WIDTHS)), np.float32)
        for k, w in enumerate(WIDTHS):
            mask[:w * EMBEDDING, k * FILTERS:(k + 1) * FILTERS] = 1
        return mask

    def answers(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filter answers at every position, and the byte patches they saw."""
        n, width = len(x), max(WIDTHS)
        wide = np.zeros((n, WINDOW + width - 1, EMBEDDING), np.float32)
        wide[:, :WINDOW] = self.embed[x]
        wide[:, WINDOW:] = self.embed[0]
        patch = np.lib.stride_tricks.as_strided(
            wide, (n, WINDOW, width * EMBEDDING), (wide.strides[0], wide.strides[1], wide.strides[2]))
        return (patch.reshape(-1, width * EMBEDDING) @ self.bank).reshape(n, WINDOW, -1), patch

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = []
        for k in range(0, len(x), 256):
            pooled = np.maximum(self.answers(x[k:k + 256])[0].max(1) + self.bias, 0)
            out.append(softmax(pooled @ self.dense + self.shift))
        return np.concatenate(out)

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Language number and score per text: the mean over windows, weighted by their bytes."""
        x, counts = windows_of(texts)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        filled = np.full(len(x), WINDOW, np.float64)
        filled[np.cumsum(counts) - 1] = [max(1, len(t) - (int(n) - 1) * WINDOW) for t, n in zip(texts, counts, strict=True)]
        mean = np.add.reduceat(self.probabilities(x) * filled[:, None], first) / np.add.reduceat(filled, first)[:, None]
        return mean.argmax(1), mean.max(1).clip(0, 1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, langs: list[str], *, epochs: int = 6, batch: int = 64, rate: float = 4e-3,
          seed: int = 7) -> ByteNet:
    """Adam on the cross entropy; the gradient of a pooled filter flows to the position of its maximum."""
    rng = np.random.default_rng(seed)
    net, used, width = ByteNet.fresh(langs, rng), ByteNet.used(), max(WIDTHS)
    names = ["embed", "bank", "bias", "dense", "shift"]
    m, v = ({n: np.zeros_like(getattr(net, n)) for n in names} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), batch):
            rows = order[k:k + batch]
            xb, n = x[rows], len(rows)
            a, patch = net.answers(xb)
            top = a.argmax(1)
            raw = np.take_along_axis(a, top[:, None, :], 1)[:, 0] + net.bias
            pooled = np.maximum(raw, 0)
            p = softmax(pooled @ net.dense + net.shift)
            p[np.arange(n), y[rows]] -= 1
            p /= n
            g = (p @ net.dense.T) * (raw > 0)
            seen = patch[np.arange(n)[:, None], top]  # (n, filters, width * embedding)
            to_patch = g[:, :, None] * net.bank.T[None]
            place = top[:, :, None] + np.arange(width)
            byte = np.where(place < WINDOW, np.take_along_axis(xb[:, None, :], np.minimum(place, WINDOW - 1), 2), 0)
            embed = np.zeros_like(net.embed)
            np.add.at(embed, byte.reshape(-1), to_patch.reshape(-1, EMBEDDING))
            grads = {"embed": embed, "bank": np.einsum("nf,nfd->df", g, seen) * used, "bias": g.sum(0),
                     "dense": pooled.T @ p, "shift": p.sum(0)}
            step += 1
            for name in names:
                m[name] += 0.1 * (grads[name] - m[name])
                v[name] += 0.001 * (grads[name] ** 2 - v[name])
                speed = rate * (1 - 0.6 * epoch / max(1, epochs - 1)) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
                getattr(net, name).__isub__((speed * m[name] / (np.sqrt(v[name]) + 1e-8)).astype(np.float32))
    return net


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, *, sample_docs: int = SAMPLE_DOCS,
        per_lang: int = SAMPLE_PER_LANG, per_doc: int = SAMPLE_WINDOWS) -> ByteNet | None:
    """A network from labelled rows that are not held out; None if there are none.

    At most ``per_lang`` documents of a language and ``sample_docs`` in all, chosen by a hash of
    their ids, give ``per_doc`` windows each: that bounds what reaches the driver.
    """
    spark = docs.sparkSession
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()
                          & ~held_out(id_col))
    order = F.xxhash64(F.lit("windows"), F.col(id_col))
    with Scratch(spark) as scratch:
        chosen = bounded_sample(scratch, labelled.select(id_col, lang_col), lang_col, id_col, per_lang).orderBy(
            "place", lang_col).limit(sample_docs).select(F.col(id_col).alias("_id")).toPandas()["_id"]
    if not len(chosen):
        return None
    ids = spark.createDataFrame([(i,) for i in chosen.tolist()], f"_id {docs.schema[id_col].dataType.simpleString()}").distinct()
    # at most sample_docs ids: a bounded broadcast
    rows = labelled.join(F.broadcast(ids), F.col(id_col) == F.col("_id"), "left_semi").select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), order.alias("seed"))

    def cut(batches):
        for batch in batches:
            langs, seen = [], []
            for lang, text, seed in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                if not has_letter(text):
                    continue
                rng = np.random.default_rng(seed & (1 << 62) - 1)
                for start in rng.integers(0, max(1, len(text) - WINDOW + 1), min(per_doc, 1 + len(text) // WINDOW)):
                    langs.append(lang)
                    seen.append(text[start:start + WINDOW].ljust(WINDOW, b"\0"))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(seen, pa.binary())], names=["lang", "seen"])

    sample = rows.mapInArrow(cut, "lang string, seen binary").toPandas().sort_values(["lang", "seen"])
    if not len(sample):
        return None
    langs = sorted(sample["lang"].unique())
    x = np.frombuffer(b"".join(bytes(s) for s in sample["seen"]), np.uint8).reshape(-1, WINDOW)
    return train(x, np.searchsorted(langs, sample["lang"].to_numpy().astype(str)), langs)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *,
             net: ByteNet | None = None) -> DataFrame:
    """The rows of ``docs`` with held_out, lang_pred and score; trained on ``docs`` unless ``net`` is given.

    Null texts and texts without a letter are ``und`` with score 0, as is every text if no
    labelled row is there to learn from.  Only the text decides.  Null ids are never held out
    and never learned from.  Repeated rows are rows like others.  All columns are kept; three of
    them, if so named, give way to the new ones.
    """
    small_batches(docs.sparkSession)
    net = net or fit(docs, id_col, text_col, lang_col)
    held = docs.sparkSession.sparkContext.broadcast(net)
    base = docs.drop("held_out", "lang_pred", "score").withColumn("held_out", held_out(id_col))
    at, names = base.columns.index(text_col), base.columns

    def predict(batches):
        for batch in batches:
            texts = as_bytes(batch.column(at))
            lang, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
            clear = [k for k, t in enumerate(texts) if held.value is not None and has_letter(t)]
            if clear:
                number, sure = held.value.predict([texts[k] for k in clear])
                lang[clear], score[clear] = np.array(held.value.langs, object)[number], sure
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang.tolist(), pa.string()), pa.array(score)],
                                             names=[*names, "lang_pred", "score"])

    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return base.mapInArrow(predict, schema)


def keep_identified(docs: DataFrame, *, least_score: float = 0.5, **names) -> DataFrame:
    """``docs`` without undetermined texts and those scored below ``least_score``; same columns."""
    found = identify(docs, **names)
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score)).select(*docs.columns)
