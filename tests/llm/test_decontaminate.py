import random

import numpy as np

from llm import decontaminate as operator
from llm.decontaminate import Index, contaminated, decontaminate, edit_distance, plain_words
from llm.words import mixed
from tests.llm.brute import docs_frame, edited, prose, word_distance

ITEMS = "item_id long, text string, lang string"


def test_edit_distance_equals_dynamic_programming():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.randrange(4) for _ in range(rng.randint(1, 12))]
        b = [rng.randrange(4) for _ in range(rng.randint(0, 16))]
        masks = {c: sum(1 << k for k, x in enumerate(a) if x == c) for c in set(a)}
        distance, end = edit_distance(masks, len(a), np.array(b, np.int64))
        best = min(word_distance(a, b[:k]) for k in range(len(b) + 1))
        assert distance == best and word_distance(a, b[:end]) == best


def test_found_passages_equal_brute_force(spark):
    rng = random.Random(4)
    items = [(k, prose(rng, rng.randint(13, 60), 400)) for k in range(12)]
    rows, planted = [], set()
    for d in range(60):
        parts = [prose(rng, rng.randint(0, 80), 400)]
        if d % 3 == 0:
            k = rng.randrange(12)
            text = items[k][1]
            parts += [edited(rng, text, int(0.1 * len(text.split())) if d % 2 else 0).upper(), prose(rng, 30, 400)]
            planted.add((d, k))
        rows.append((d, " ".join(parts)))
    rows += [(100, None), (101, ""), (None, items[0][1]), (102, "word " * 20_000), (0, rows[0][1])]
    more = [*items, (50, None), (51, ""), (52, "...")]
    docs, bench = docs_frame(spark, rows), spark.createDataFrame([(*x, "en") for x in more], ITEMS)
    got = contaminated(docs, bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert {(None, 0)} <= pairs and sum(1 for r in got if r.doc_id == 0) == 2  # a repeated row matches twice
    true = set()
    for d, text in rows:
        words = plain_words(text.encode()) if text and d != 102 else []
        for k, item in items:
            w = plain_words(item.encode())
            most = int(0.2 * len(w))
            if any(min(word_distance(w, words[s:s + len(w) + e]) for e in range(-most, most + 1)) <= most
                   for s in range(max(1, len(words) - len(w) + most + 1)) if len(set(w) & set(words[s:s + len(w)])) > 0.5 * len(set(w))):
                true.add((d, k))
    assert pairs <= true | {(None, 0)}
    assert len(true & pairs) >= 0.95 * len(true) and planted <= pairs
    for r in got:
        w = plain_words(dict(items)[r.item_id].encode())
        words = plain_words(dict(rows)[r.doc_id].encode())[r.first_word:r.first_word + r.n_words]
        assert word_distance(w, words) == r.distance <= int(0.2 * len(w))


def test_decontaminate_drops_only_contaminated_rows(spark):
    rng = random.Random(5)
    item = prose(rng, 30)
    docs = docs_frame(spark, [(1, prose(rng, 50) + " " + item), (2, prose(rng, 50)), (3, None), (None, item)])
    bench = spark.createDataFrame([(9, item, "x")], ITEMS)
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {2, 3, None}
    assert decontaminate(docs.limit(0), bench).count() == 0
    assert decontaminate(docs, bench.limit(0)).count() == 4


def test_nothing_is_missed_at_the_full_distance():
    """Single deletions, one gap, one inserted block, substitutions and mixed edits of a fifth of the words."""
    rng = random.Random(6)
    fresh = lambda: f"x{rng.randrange(10**6)}"

    def mixed_edits(words, e):
        for _ in range(e):
            at, kind = rng.randrange(len(words)), rng.randrange(3)
            words[at:at + (kind > 0)] = [] if kind == 1 else [fresh()]
        return words

    def block(words, e, at):
        return words[:at] + [fresh() for _ in range(e)] + words[at:]

    kinds = {
        "deletions": lambda w, e: [w[k] for k in sorted(rng.sample(range(len(w)), len(w) - e))],
        "substitutions": lambda w, e: [fresh() if k in chosen else x for chosen in [set(rng.sample(range(len(w)), e))] for k, x in enumerate(w)],
        "gap": lambda w, e: (lambda a: w[:a] + w[a + e:])(rng.randrange(len(w) - e)),
        "block": lambda w, e: block(w, e, rng.randrange(len(w))),
        "mixed": lambda w, e: mixed_edits(list(w), e),
    }
    items = [(k, " ".join(f"w{rng.randrange(400)}" for _ in range(m)).encode()) for k, m in enumerate([1, 2, 5, 9, 16, 30, 40, 50, 59] * 3)]
    index = Index(items, 0.2)
    for kind, edit in kinds.items():
        for i, text in items:
            words = text.decode().split()
            inner = edit(words, int(0.2 * len(words)))
            lead, tail = ([fresh() for _ in range(n)] for n in (rng.randrange(40), rng.randrange(40)))
            doc = " ".join([*lead, *inner, *tail]).encode()
            hits = {h[1]: h[4] for h in index.matches([b"other words", doc, b""])}
            assert i in hits and hits[i] <= int(0.2 * len(words)), (kind, i)


def test_buckets_equal_plain_walks():
    """With a share that leaves no pairs the candidates are those of the walks alone; texts shorter than items among them."""
    rng = random.Random(7)
    items = [(k, " ".join(f"w{rng.randrange(12)}" for _ in range(m)).encode()) for k, m in enumerate([2, 2, 3, 6, 7, 8, 8, 13, 14, 20])]
    index = Index(items, 0.5)
    texts = [[f"w{rng.randrange(14)}".encode() for _ in range(n)] for n in (0, 40, 1, 7, 0, 60, 3)]
    words = np.array([index.ids.get(w, 0) for ws in texts for w in [*ws, b""]], np.int64)
    sizes = np.array([len(ws) + 1 for ws in texts])
    ends = np.cumsum(sizes)
    stop = np.repeat(ends - 1, sizes)

    def read(symbols, steps, r):
        at, out = 0, []
        for j in range(steps[-1] + 1):
            symbol = symbols[at] if at < len(symbols) else 0
            out += [symbol] * (j in steps)
            bit = mixed(np.array([symbol], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j * 131071 + r * 8191 + 1))
            at += int(bit[0]) >> 40 & 1
        return out

    expected = set()
    for size, spare, tables, *_ in index.classes:
        inside = [k for k, (_, s) in enumerate(index.items) if size <= len(s) <= size * 1.15]
        for r, (steps, *_) in enumerate(tables):
            steps = steps.tolist()
            held = {k: read(index.items[k][1].tolist(), steps, r) for k in inside}
            for s in range(len(words)):
                if s + size - spare <= stop[s]:
                    key = read(words[s:stop[s]].tolist(), steps, r)
                    expected |= {(s, s, k) for k in inside if held[k] == key}
    got = index.candidates(words, stop, np.repeat(ends - sizes, sizes))
    assert expected and set(zip(*(x.tolist() for x in got), strict=True)) == expected


def test_walks_end_where_no_item_reads_the_same(monkeypatch):
    """A text whose windows all hold enough pairs, of many items: most walks end at their first sampled step."""
    rng = random.Random(8)
    items = [[f"w{rng.randrange(2000)}" for _ in range(40)] for _ in range(20)]
    index = Index([(k, " ".join(w).encode()) for k, w in enumerate(items)], 0.2)
    pieces = [w[a:a + 10] for w in items for a in range(0, 40, 10)]
    rng.shuffle(pieces)
    text = " ".join(w for piece in pieces for w in piece).encode()
    hashed = []
    monkeypatch.setattr(operator, "mixed", lambda x: hashed.append(len(x)) or mixed(x))
    list(index.matches([text]))
    whole = sum((int(steps[-1]) + 1) * (len(pieces) * 10 - 32) for _, _, tables, *_ in index.classes for steps, *_ in tables)
    assert sum(hashed) < 0.6 * whole
