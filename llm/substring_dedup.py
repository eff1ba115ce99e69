"""Substring dedup by sliding sentence spans.

A text is cut into sentences, and long sentences where their own words say so; from every sentence on, the shortest run of at least two
sentences with enough words is hashed.  Runs join globally by hash, the first place of each
(smallest id, then position) keeps it, and every sentence that another place's run covers
is removed.  Repeats within a text are found where the text is, so the join sees a run once
per text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import Scratch, as_bytes
from llm.words import mixed, word_hashes

#: What ends a sentence, in a word with the space behind it.
_LAST = re.compile(rb"[.!?][\x20\x09-\x0D]+\Z|[\x0A\x0D]")
_LINE = re.compile(rb"[\x0A\x0D]")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
#: An odd multiplier; its powers weigh the words of a sentence and the sentences of a run.
_STEP = 0xD6E8FEB86659FD93
_BACK = pow(_STEP, -1, 1 << 64)


def places(texts: list[bytes | None], longest: int):
    """Of a batch: words with the space behind them, their hashes and text numbers, and whether a piece ends behind each.

    A piece ends with its sentence, and inside a sentence behind the word whose hash with the next is least
    (the last of equals) of any ``window`` such places in a row that lie in the sentence.  So a piece has
    ``window`` words at most, and where a repeated passage is cut depends on its own words only, but for
    the ``window - 1`` places at either end.
    """
    window = max(1, longest * 3 // 8)
    words, low, sizes, ends = [], [], [], []
    for text in texts:
        found = _WORD.findall(text) if text else []
        words += found
        low += text.lower().split() if text else []
        sizes.append(len(found))
        ends += [bool(_LAST.search(w)) for w in found]
    name, last = word_hashes(low), np.array(ends, bool)
    sizes = np.array(sizes, np.int64)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    n = len(name) - window
    if n > 0:
        code = mixed(name[:-1] * np.uint64(_STEP) + name[1:])
        least, at = code[:n].copy(), np.zeros(n, np.int64)
        for k in range(1, window):
            here = code[k:k + n]
            lower = here <= least
            least[lower], at[lower] = here[lower], k
        ended = np.concatenate([[0], np.cumsum(last)])
        inside = np.flatnonzero(ended[window:window + n] == ended[:n])
        last[inside + at[inside]] = True
    return words, name, np.repeat(np.arange(len(sizes)), sizes), last


def _lead(text: bytes) -> bytes:
    return text[:len(text) - len(text.lstrip())]


def pieces_of(texts: list[bytes | None], longest: int) -> list[list[bytes]]:
    """Of each text the pieces, which concatenate to it; white space before the first word is one if it has a line end."""
    words, _, owner, last = places(texts, longest)
    out: list[list[bytes]] = []
    for text in texts:
        lead = _lead(text or b"")
        out.append([lead] if lead and (len(lead) == len(text) or _LINE.search(lead)) else [])
    stop = np.flatnonzero(last) + 1
    for d, a, b in zip(owner[stop - 1].tolist(), np.concatenate([[0], stop])[:-1].tolist(), stop.tolist(), strict=True):
        out[d].append(b"".join(words[a:b]))
    heads = np.searchsorted(owner, np.arange(len(texts))).tolist()
    for d, text in enumerate(texts):
        if text and heads[d] < len(owner) and owner[heads[d]] == d and (lead := _lead(text)) and not _LINE.search(lead):
            out[d][0] = lead + out[d][0]
    return out


def sentences(text: bytes, longest: int) -> list[bytes]:
    """Pieces that concatenate to the text, cut as ``places`` says."""
    return pieces_of([text], longest)[0]


def _powers(n: int, base: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


def runs(texts: list[bytes | None], least_words: int, longest: int):
    """Of a batch: text number, first and last sentence and hash of every run, as arrays."""
    _, word, owner, last = places(texts, longest)
    # a piece's name: its words' hashes, weighed by their places in it
    stop = np.flatnonzero(last) + 1
    start = np.concatenate([[0], stop])[:-1].astype(np.int64)
    summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * _powers(len(word), _STEP)[:-1])])
    name = mixed((summed[stop] - summed[start]) * _powers(len(word), _BACK)[start] + (stop - start).astype(np.uint64))
    owner, size, n = owner[start], stop - start, len(start)
    blank = np.array([bool(t and (lead := _lead(t)) and _LINE.search(lead)) for t in texts], np.int64)
    place = np.arange(n) - np.searchsorted(owner, owner) + blank[owner]
    total = np.concatenate([[0], np.cumsum(size)])
    weight, unweight = _powers(n, _STEP), _powers(n, _BACK)
    summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(name * weight[:n])])
    start = np.arange(n)
    stop = np.maximum(np.searchsorted(total, total[:-1] + least_words), start + 2)  # exclusive
    ok = stop <= n
    ok[ok] &= owner[stop[ok] - 1] == owner[ok]
    start, stop = start[ok], stop[ok]
    code = mixed((summed[stop] - summed[start]) * unweight[start] + (stop - start).astype(np.uint64))
    return owner[start], place[start], place[stop - 1], code.view(np.int64)


def repeated_spans(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, least_words: int,
                   longest: int) -> DataFrame:
    """(id, first, last) of the sentence runs of ``docs`` that stand at an earlier place too."""
    def found(batches):
        for batch in batches:
            owner, first, last, code = runs(as_bytes(batch.column(1)), least_words, longest)
            again = np.ones(len(code), bool)  # not the first of its text
            again[np.unique(np.stack([owner, code]), axis=1, return_index=True)[1]] = False
            yield pa.RecordBatch.from_arrays(
                [pa.array(code), batch.column(0).take(pa.array(owner)), pa.array(first, pa.int32()), pa.array(last, pa.int32()),
                 pa.array(again)], names=["code", "id", "first", "last", "again"])

    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    all_runs = scratch.keep(texts.mapInArrow(found, "code long, id long, first int, last int, again boolean"), "runs")
    origin = all_runs.where("not again").groupBy("code").agg(
        F.min("id").alias("origin"), F.count(F.lit(1)).alias("times")).where("times > 1").select("code", "origin")
    elsewhere = all_runs.where("not again").join(origin, "code").where("id != origin").select("id", "first", "last")
    return elsewhere.union(all_runs.where("again").select("id", "first", "last"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_words: int = 15,
                    longest: int = 24) -> DataFrame:
    """The rows of ``docs`` with repeated spans cut out of the text, and n_sentences, n_removed, removed.

    ``removed`` lists the texts cut out.  A run has two sentences and ``least_words`` words at
    least; sentences of over ``longest * 3 // 8`` words count as several.  Any passage of more than
    ``2 * longest`` words that stands at an earlier place loses a run, whatever stands around it
    (at 15 and 24); up to three pieces at either end of it may stay.  Case and white space between words do not matter,
    but line ends end sentences.  Null texts stay null, empty ones empty, with 0 sentences.  A row without id keeps
    its text and is no one's first place.  Rows that repeat an id at the same place keep the
    passage together.  All columns are kept; three of them, if so named, give way to the new ones.
    """
    new = {"n_sentences": T.LongType(), "n_removed": T.LongType(), "removed": T.ArrayType(T.StringType())}
    base = docs.drop(*new)
    names = base.columns
    at_text = names.index(text_col)
    with Scratch(docs.sparkSession) as scratch:
        spans = repeated_spans(docs, scratch, id_col, text_col, least_words, longest)
        covers = scratch.result(spans.groupBy(F.col("id").alias("_llm_id")).agg(
            F.collect_list("first").alias("_llm_first"), F.collect_list("last").alias("_llm_last")), "covers")
        joined = base.join(covers, base[id_col].cast("long") == F.col("_llm_id"), "left").drop("_llm_id")
        schema = T.StructType([*base.schema.fields, *(T.StructField(k, v) for k, v in new.items())])

        def cut(batches):
            for batch in batches:
                texts, counts, gone, lost = [], [], [], []
                bodies = as_bytes(batch.column(at_text))
                for text, pieces, first, last in zip(bodies, pieces_of(bodies, longest), batch.column("_llm_first").to_pylist(),
                                                     batch.column("_llm_last").to_pylist(), strict=True):
                    drop = np.zeros(len(pieces) + 1, np.int64)
                    np.add.at(drop, first or [], 1)
                    np.add.at(drop, [k + 1 for k in last or []], -1)
                    drop = np.cumsum(drop)[:-1] > 0
                    spans, open_span = [], False
                    for piece, out in zip(pieces, drop, strict=True):
                        if out and open_span:
                            spans[-1] += piece
                        elif out:
                            spans.append(piece)
                        open_span = out
                    texts.append(b"".join(p for p, out in zip(pieces, drop, strict=True) if not out) if spans else text)
                    counts.append(len(pieces))
                    gone.append(int(drop.sum()))
                    lost.append([s.decode() for s in spans])
                columns = [batch.column(k) for k in range(len(names))]
                columns[at_text] = pa.array(texts, pa.binary()).cast(pa.string())
                columns += [pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(lost, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

        return joined.mapInArrow(cut, schema)
