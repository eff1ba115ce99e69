import random

from llm.language_id import fit, has_letter, identify, keep_identified
from tests.llm.brute import docs_frame

SOUNDS = {"aa": "ka lo mi tu re".split(), "bb": "sch ung ver keit zu".split(), "cc": "ção nhé lha que ão".split()}


def rows():
    rng = random.Random(9)
    return [(k, " ".join("".join(rng.choice(SOUNDS[y]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(8, 200))), y)
            for k, y in ((k, rng.choice(list(SOUNDS))) for k in range(400))]


def test_held_out_accuracy_and_edges(spark):
    extra = [(900, None, "aa"), (901, "", "aa"), (902, "123 !?", "aa"), (903, "é" * 40_000, None), (None, "ka lo", "aa"), (904, "ка", None)]
    frame = docs_frame(spark, rows() + extra).withColumnRenamed("source", "lang_pred")
    out = identify(frame)
    assert out.columns == ["doc_id", "text", "lang", "n_chars", "held_out", "lang_pred", "score"]
    got = {r.doc_id: r for r in out.collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(held) > 50 and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (900, 901, 902))
    assert got[904].lang_pred in SOUNDS and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())


def test_same_network_each_time_and_label_is_no_input(spark):
    frame = docs_frame(spark, rows())
    one = fit(frame, "doc_id", "text", "lang")
    two = fit(frame.repartition(3), "doc_id", "text", "lang")
    assert (one.bank == two.bank).all() and one.langs == ["aa", "bb", "cc"]
    blind = identify(frame.selectExpr("doc_id", "text", "'zz' as lang", "'q' as source"), net=one).collect()
    seen = identify(frame, net=one).collect()
    assert {(r.doc_id, r.lang_pred, r.score) for r in blind} == {(r.doc_id, r.lang_pred, r.score) for r in seen}


def test_nothing_to_learn_from(spark):
    frame = docs_frame(spark, [(1, "text", None), (2, None, "en")])
    assert {r.lang_pred for r in identify(frame).collect()} == {"und"}
    assert identify(frame.limit(0)).count() == 0
    assert keep_identified(frame).count() == 0
    assert has_letter("é".encode()) and not has_letter(b"12 _-") and not has_letter(None)
