"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Distances count words inserted, deleted or replaced.  From every word of a text, a window of
an item's size is walked at random: at step j the walk reads the word under it and moves on if
a fixed random bit of (j, word) says so.  Equal steps of two walks tell a small edit distance,
so windows and items that agree at a few sampled steps form a candidate; the sampling is
repeated; a walk ends at the first sampled step at which no item reads what it has read.
Candidates are verified by the exact edit distance.  Windows that hold too few of
the items' word pairs to be within the distance (an edit breaks two pairs at most) are left out
before the walks.  Near the distance walks meet too seldom, above all after deletions, so every
window that holds enough pairs of one item is a candidate too: m words within e edits keep
m - 1 - 2 e of the item's pairs, so that none is missed.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import Scratch, as_bytes
from llm.words import mixed, words_of

#: Characters that separate nothing and count for nothing.
PUNCTUATION = b".,;:!?|\"'()[]{}*$%&#<>_-/\\"
#: Items sent to the tasks at once; more items take more passes.
ITEMS_AT_ONCE = 5_000
#: Sampled steps per repetition, and repetitions.
BITS, REPETITIONS = 3, 16
_SLOTS = 1 << 22


def plain_words(text: bytes | None) -> list[bytes]:
    return words_of(text.translate(None, PUNCTUATION)) if text else []


def edit_distance(masks: dict[int, int], m: int, text: np.ndarray, anywhere: bool = False) -> tuple[int, int]:
    """(distance, end): the prefix of ``text`` nearest to a pattern of m symbols, by bit-parallel columns.

    ``masks`` has the positions of each symbol in the pattern as bits.  With ``anywhere`` the nearest
    passage may begin behind the start of ``text``.
    """
    open_start = 0 if anywhere else 1
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for k, symbol in enumerate(text.tolist(), 1):
        eq = masks.get(symbol, 0)
        x = eq | down
        d0 = (((x & up) + up) ^ up) | x
        plus, minus = down | (~(d0 | up) & full), d0 & up
        score += 1 if plus & top else -1 if minus & top else 0
        plus = (plus << 1 | open_start) & full
        up, down = (minus << 1 & full) | (~(d0 | plus) & full), plus & d0
        if score < best:
            best, end = score, k
    return best, end


def _spread(words: np.ndarray) -> np.ndarray:
    """Symbols as the walks hash them."""
    return words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _matched(place: np.ndarray, key: np.ndarray, keys: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, item) of every item that the sorted ``keys`` hold under the key of a place."""
    low = np.searchsorted(keys, key)
    times = np.searchsorted(keys, key, side="right") - low
    return np.repeat(place, times), items[np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())]


class Index:
    """The items of one pass: vocabulary, word pairs, and the LSH tables of each length class."""

    def __init__(self, items: list[tuple[int, bytes | None]], share: float, repetitions: int = REPETITIONS):
        texts = [(i, w) for i, t in items if (w := plain_words(t))]
        self.ids = {w: k for k, w in enumerate(sorted({w for _, ws in texts for w in ws}), 1)}
        self.items = [(i, np.array([self.ids[w] for w in ws])) for i, ws in texts]
        self.sizes = np.array([len(s) for _, s in self.items], np.int64)
        self.edits = [int(share * len(s)) for _, s in self.items]
        self.least = self.sizes - 1 - 2 * np.array(self.edits, np.int64)
        self.masks = []
        for _, s in self.items:
            mask: dict[int, int] = defaultdict(int)
            for k, c in enumerate(s.tolist()):
                mask[c] |= 1 << k
            self.masks.append(dict(mask))
        self.pairs = np.zeros(_SLOTS, bool)
        for _, s in self.items:
            self.pairs[self.pair_slots(s)] = True
        self.single: dict[int, list[int]] = defaultdict(list)
        for k, (_, s) in enumerate(self.items):
            if len(s) == 1:
                self.single[int(s[0])].append(k)
        self.classes = []
        order = sorted(range(len(self.items)), key=lambda k: len(self.items[k][1]))
        while order:
            size = len(self.items[order[0]][1])
            inside = [k for k in order if len(self.items[k][1]) <= size * 1.15]
            order = order[len(inside):]
            spare = max(self.edits[k] for k in inside)
            rng = np.random.default_rng(size)
            words = np.concatenate([np.append(self.items[k][1], 0) for k in inside])
            stop = np.cumsum(self.sizes[inside] + 1) - 1
            start = stop - self.sizes[inside]
            tables = []
            for r in range(repetitions):
                steps = np.sort(rng.choice(2 * size, min(BITS, 2 * size), replace=False))
                keys = [key for _, key in self.walk(words, _spread(words), start, stop, steps, r)]
                of = np.argsort(keys[-1], kind="stable")
                tables.append((steps, [np.unique(key) for key in keys], keys[-1][of], np.array(inside, np.int64)[of]))
            self.classes.append((size, spare, tables, *self.postings(inside)))

    def postings(self, inside: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Pair slots, sorted, and the item of each, of the items whose least number of kept pairs is positive."""
        slots = [(k, np.unique(self.pair_slots(self.items[k][1]))) for k in inside if self.least[k] > 0]
        slot = np.concatenate([np.empty(0, np.int64), *(x for _, x in slots)])
        item = np.repeat(np.array([k for k, _ in slots], np.int64), [len(x) for _, x in slots])
        order = np.argsort(slot, kind="stable")
        return slot[order], item[order]

    def counted(self, at: np.ndarray, slots: np.ndarray, begins: np.ndarray, start: np.ndarray, slot: np.ndarray,
                item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first start, last start, item) of the windows that hold the least number of pairs of an item of the class.

        ``start`` has the windows left of the class; of the pairs, in ``slots`` at places ``at``, only those
        that lie in them are looked up.  ``begins`` has the start of each word's text.
        """
        longest = int(self.sizes[item].max(initial=0))
        left = np.searchsorted(start, at, side="right") - 1
        inner = (left >= 0) & (at - start[left] < longest)
        at, slots = at[inner], slots[inner]
        place, found = _matched(at, slots, slot, item)
        order = np.argsort(found * len(begins) + place)
        place, found = place[order], found[order]
        size = self.sizes[found]
        last = np.arange(len(found)) + self.least[found] - 1
        ok = last < len(found)
        ok[ok] &= found[last[ok]] == found[ok]
        # of a window of the item's size: its first pair at the latest here, its last needed one at the earliest there
        ok[ok] &= place[last[ok]] - place[ok] <= size[ok] - 2
        first = place[ok]
        return np.maximum(place[last[ok]] - size[ok] + 2, begins[first]), first, found[ok]

    def pair_slots(self, s: np.ndarray) -> np.ndarray:
        code = mixed(s[:-1].astype(np.uint64) * np.uint64(0x100000001B3) + s[1:].astype(np.uint64))
        return np.where((s[:-1] > 0) & (s[1:] > 0), (code & np.uint64(_SLOTS - 1)).astype(np.int64), -1)

    @staticmethod
    def walk(words: np.ndarray, spread: np.ndarray, start: np.ndarray, stop: np.ndarray, steps: np.ndarray, r: int,
             levels: list[np.ndarray] | None = None):
        """At each of the given steps, (walks, keys) of the r-th random walks: a key stands for the symbols read so far.

        A walk stays at the 0 that ends its text.  With ``levels``, the keys wanted at each step, all other walks end there.
        """
        at, of = start.copy(), np.arange(len(start))
        key = np.zeros(len(start), np.uint64)
        for n, (before, step) in enumerate(pairwise([0, *steps.tolist()])):
            for j in range(before, step):
                bit = mixed(spread[at] + np.uint64(j * 131071 + r * 8191 + 1))
                at += (bit >> np.uint64(40) & np.uint64(1)).view(np.int64)
                np.minimum(at, stop, out=at)
            key = mixed(key + words[at].astype(np.uint64))
            if levels is not None:
                wanted = levels[n]
                kept = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key)
                at, of, key, stop = at[kept], of[kept], key[kept], stop[kept]
            yield of, key
            if not len(of):
                return

    def candidates(self, words: np.ndarray, stop: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first start, last start, item) of windows that share a bucket or enough word pairs with an item.

        ``stop`` has the end of each word's text, ``begins`` its start.
        """
        slots = self.pair_slots(words)
        hit = (slots >= 0) & self.pairs[slots]
        at = np.flatnonzero(hit)
        slots = slots[at]
        found = [(np.empty(0, np.int64),) * 3]
        if self.single:
            place = np.flatnonzero(np.isin(words, list(self.single)))
            many = [self.single[w] for w in words[place].tolist()]
            place = np.repeat(place, [len(ks) for ks in many])
            found.append((place, place, np.array([k for ks in many for k in ks], np.int64)))
        if len(at) or any(size - 1 <= 2 * spare for size, spare, *_ in self.classes if size > 1):
            longest = max((size for size, *_ in self.classes), default=1)
            summed = np.zeros(len(words) + longest, np.int32)
            np.cumsum(hit, out=summed[1:len(words)])
            summed[len(words):] = summed[len(words) - 1]
            spread = _spread(words)
            for size, spare, tables, slot, item in self.classes:
                least = size - 1 - 2 * spare
                # windows over the ends of texts hold at least as many pairs as what lies inside the text
                start = np.flatnonzero(summed[size - 1:size - 1 + len(words)] - summed[:len(words)] >= least)
                end = stop[start]
                inside = summed[np.minimum(start + size - 1, end - 1).clip(0)] - summed[start]
                start = start[(inside >= least) & (start + size - spare <= end)]
                if not len(start):
                    continue
                for r, (steps, levels, keys, items) in enumerate(tables):
                    *_, (of, key) = self.walk(words, spread, start, stop[start], steps, r, levels)
                    place, k = _matched(start[of], key, keys, items)
                    found.append((place, place, k))
                if len(slot):
                    found.append(self.counted(at, slots, begins, start, slot, item))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def stretches(self, words: np.ndarray, stop: np.ndarray, owner: np.ndarray, begins: np.ndarray):
        """(text, item, first start, last start) of the candidates of each text and item, starts near each other together."""
        first, last, item = self.candidates(words, stop, begins)
        order = np.argsort(item * len(words) + first)
        first, last, item = first[order], last[order], item[order]
        text = owner[first]
        new = np.ones(len(first), bool)
        new[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1])
        # the last start so far of the same item and text: places grow with the texts, so only items need room between them
        reach = np.maximum.accumulate(item * len(words) + last) - item * len(words)
        new[1:] |= first[1:] - reach[:-1] > self.sizes[item[1:]]
        at = np.flatnonzero(new)
        ends = np.append(at[1:], len(new))[:len(at)] - 1
        return zip(text[at].tolist(), item[at].tolist(), first[at].tolist(), reach[ends].tolist(), strict=True)

    def matches(self, texts: list[bytes | None]):
        """(text, item id, first word, words, distance): the best place of each item within its distance."""
        lists = [[*plain_words(t), b""] for t in texts]
        if not lists:
            return
        sizes = np.array([len(ws) for ws in lists])
        ends = np.cumsum(sizes)
        words = np.fromiter(map(self.ids.get, chain.from_iterable(lists), repeat(0)), np.int64, ends[-1])
        stop, owner, begins = (np.repeat(x, sizes) for x in (ends - 1, np.arange(len(lists)), ends - sizes))
        best: dict[tuple[int, int], tuple] = {}
        for d, k, first, last in self.stretches(words, stop, owner, begins):
            m, most = len(self.items[k][1]), self.edits[k]
            held = best.get((d, k))
            if held and held[0] == 0:
                continue
            # one search over all windows of the stretch, then the first start of the passage it found
            distance, end = edit_distance(self.masks[k], m, words[first:min(stop[first], last + m + most)], True)
            if distance > most or held and distance >= held[0]:
                continue
            for s in range(max(first, first + end - m - distance), first + end - m + distance + 1):
                if (hit := edit_distance(self.masks[k], m, words[s:min(stop[s], s + m + most)]))[0] == distance:
                    best[d, k] = (distance, s, hit[1])
                    break
        for (d, k), (distance, s, end) in sorted(best.items()):
            yield d, self.items[k][0], int(s - (ends[d] - sizes[d])), end, distance


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id: str = "item_id", item_text: str = "text", *, share: float = 0.2,
                 repetitions: int = REPETITIONS) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, distance): items found in documents, the best place of each.

    An item of m words is found where some passage is within floor(share * m) word edits; case and
    punctuation do not count.  None is missed (recall 1) where
    the m - 1 - 2 floor(share * m) pairs that must be left are at least one: at 0.2 from two words on, and
    single words are looked up; with shares that leave none, walks alone find candidates.  Null or empty texts and items match nothing.  Repeated rows give
    repeated matches, null ids are carried along.  The items are read in passes of ITEMS_AT_ONCE,
    so what a task holds does not grow with their number.  Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("a"), F.col(text_col).alias("b"))
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {item_id} long, first_word long, n_words long, distance long"
    small = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    passes = max(1, -(-small.count() // ITEMS_AT_ONCE))
    with Scratch(spark) as scratch:
        found = None
        for k in range(passes):
            part = small.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k)
            rows = [(r.i, r.t.encode() if r.t else None) for r in part.toLocalIterator()]
            held = spark.sparkContext.broadcast(Index(rows, share, repetitions))

            def search(batches, held=held):
                for batch in batches:
                    hits = list(held.value.matches(as_bytes(batch.column(1))))
                    d, *rest = zip(*hits, strict=True) if hits else [()] * 5
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(d, pa.int64())), *(pa.array(x, pa.int64()) for x in rest)],
                        names=[id_col, item_id, "first_word", "n_words", "distance"])

            one = texts.mapInArrow(search, schema)
            found = one if found is None else found.union(one)
        return scratch.result(found)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows in which an item is found; rows without id stay."""
    return docs.join(contaminated(docs, items, id_col, **options).select(id_col).distinct(), id_col, "left_anti") \
        .select(*docs.columns)
