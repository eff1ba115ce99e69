import random

from llm.substring_dedup import sentences, substring_dedup
from tests.llm.brute import docs_frame, prose


def brute(rows, least=15, longest=24):
    """doc_id to (text left, sentences, removed); ids unique."""
    cut = {i: sentences(t.encode(), longest) if t else [] for i, t in rows}
    seen, drop = {}, {i: set() for i in cut}
    for i in sorted(cut):
        solid = [k for k, p in enumerate(cut[i]) if p.split()]
        words = {k: cut[i][k].lower().split() for k in solid}
        for a in range(len(solid)):
            b = a + 2
            while b <= len(solid) and sum(len(words[k]) for k in solid[a:b]) < least:
                b += 1
            if b > len(solid):
                continue
            run = tuple(tuple(words[k]) for k in solid[a:b])
            if run in seen:
                drop[i] |= set(range(solid[a], solid[b - 1] + 1))
            else:
                seen[run] = i
    return {i: (b"".join(p for k, p in enumerate(cut[i]) if k not in drop[i]).decode(), len(cut[i]), len(drop[i])) for i in cut}


def sample():
    rng = random.Random(11)
    passage = prose(rng, 60)
    rows = []
    for k in range(80):
        text = prose(rng, rng.randint(1, 120))
        if k % 4 == 0:
            text = text + " " + passage + "\n" + prose(rng, 20)
        if k % 7 == 0:
            text += " Again and again. And again we go on. " * 3
        rows.append((k, text))
    rows += [(200, rows[5][1]), (201, rows[5][1].upper()), (300, ""), (301, "\n \n"), (302, "One. Two. Three."),
             (303, "no end " * 15_000), (304, "no end " * 15_000), (305, "é. " * 60)]
    return rows


def test_texts_equal_brute_force(spark):
    rows = sample()
    frame = docs_frame(spark, [*rows, (400, None)]).withColumnRenamed("lang", "n_removed")
    out = substring_dedup(frame)
    assert out.columns == ["doc_id", "text", "source", "n_chars", "n_sentences", "n_removed", "removed"]
    got = {r.doc_id: r for r in out.collect()}
    assert (got[400].text, got[400].n_sentences, got[400].n_removed) == (None, 0, 0)
    want = brute(rows)
    assert {i: (got[i].text, got[i].n_sentences, got[i].n_removed) for i in want} == want
    assert got[200].text == "" and got[8].n_removed > 0 and got[1].text == rows[1][1]


def test_pieces_concatenate_to_the_text():
    for _, t in sample():
        assert b"".join(sentences(t.encode(), 24)) == t.encode()
    assert sentences(b"  lead " + b"w " * 60, 24)[0].startswith(b"  lead")


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = "One two three four five six seven eight. Nine ten eleven twelve thirteen fourteen fifteen sixteen."
    frame = docs_frame(spark, [(1, text), (1, text), (2, text), (None, text)])
    got = sorted(((r.doc_id, r.n_removed) for r in substring_dedup(frame).collect()), key=str)
    assert got == sorted([(1, 0), (1, 0), (2, 2), (None, 0)], key=str)
    assert substring_dedup(frame.limit(0)).count() == 0


def test_repeated_passages_of_50_words_are_found_wherever_they_stand(spark):
    """Plain search that does not use sentences(): passages inside longer sentences, with lead-ins of other lengths."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, planted = [], {}
    for k in range(60):
        passage = [word() + rng.choice(["", "", "", "", "", "", "", "", ",", "."]) for _ in range(50)]
        for d in (k, 100 + k):
            lead, tail = ([word() for _ in range(rng.randint(0, 30))] for _ in range(2))
            rows.append((d, " ".join([*lead, *passage, *tail, "end."])))
        planted[100 + k] = " ".join(passage)
    got = {r.doc_id: r for r in substring_dedup(docs_frame(spark, rows)).collect()}
    whole = {d for d, p in planted.items() if len(got[d].removed) != 1 or got[d].removed[0].strip() not in p
             or len(got[d].removed[0].split()) < 15}
    assert not whole
    assert all(got[d].text == t for d, t in rows if d < 100)
