import gzip
import hashlib
import json
import random
import zlib

import pyarrow as pa
import pytest

from llm.warc import (BLOCK, MANIFEST, WarcSource, WarcWriter, Written, archived, page_digests, parsed, read_records, record_bytes,
                      records, write_pages)

SHARED = "<p>shared</p>" * 20
PAGES = [
    (5, "http://a/1", SHARED), (3, "http://a/2", SHARED), (3, "http://a/2", SHARED), (9, None, SHARED), (None, "http://n", SHARED),
    (1, "u\r\nWARC-Type: x", "short"), (2, "http://b", "short"), (4, "http://c", None), (6, "", ""), (7, "ü", "é" * 50),
    (8, "http://d", "é" * 50), (10, "http://e", "x" * 99), (11, "http://f", "x" * 99), (12, "http://g", "y" * (3 * BLOCK)),
]


def plain(pages, least=100):
    first = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        again = len(data) >= least and i is not None and first[html or ""] < i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response",
                    first[html] if again else None))
    return sorted(out, key=repr)


def member(k, size, kind="response"):
    html = random.Random(k).randbytes(size)
    return record_bytes({"record_id": f"urn:page:{k}:", "record_type": kind, "url": f"http://x/{k}", "date": "d", "refers_to": None,
                         "payload": html, "payload_bytes": size, "payload_digest": hashlib.sha256(html).hexdigest()})


@pytest.mark.parametrize("split", [300, 10_000, 64 << 20])
def test_round_trip_over_any_ranges(spark, split):
    frame = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, record_type string, payload int")
    got = archived(frame.repartition(3), split_bytes=split).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == plain(PAGES)
    assert not any(r.problem for r in got)


def test_payloads_urls_and_rolled_files(spark, tmp_path):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    write_pages(frame, f"{tmp_path}/w", file_bytes=400)
    got = read_records(spark, f"{tmp_path}/w").collect()
    assert len({r.file for r in got}) > 3 and len(got) == len(PAGES)
    by_page = {r.record_id.split(":")[2]: r for r in got}
    assert bytes(by_page["12"].payload) == b"y" * (3 * BLOCK) and by_page["9"].payload is None and by_page["9"].url is None
    assert by_page["1"].url == "u%0D%0AWARC-Type: x" and by_page["7"].url == "ü" and by_page["9"].refers_to.startswith("urn:page:3:")
    # Any tool that reads gzip sees the records one behind another.
    name = f"{tmp_path}/w/{by_page['12'].file}"
    assert gzip.open(name).read().startswith(b"WARC/1.1\r\n")
    one = read_records(spark, name, payload=False)
    assert "payload" not in one.columns and one.count() >= 1


def test_every_cut_gives_each_record_once():
    data = b"".join(member(k, s) for k, s in enumerate([0, 1, 10, 500, 3000, 50, 0, 1200]))
    whole = list(records(pa.BufferReader(data), 0, len(data)))
    assert [r["payload_bytes"] for r in whole] == [0, 1, 10, 500, 3000, 50, 0, 1200] and not any(r["problem"] for r in whole)
    for step in (1, 7, 100, 999):
        parts = [r for a in range(0, len(data), step) for r in records(pa.BufferReader(data), a, min(a + step, len(data)))]
        assert parts == whole


@pytest.mark.parametrize("block", [*range(3, 40), 64, 101, 500])
def test_blocks_may_end_anywhere(monkeypatch, block):
    data = b"".join(member(k, s) for k, s in enumerate([0, 1, 30, 500, 5, 90]))
    whole = list(records(pa.BufferReader(data), 0, len(data)))
    assert len(whole) == 6
    monkeypatch.setattr("llm.warc.BLOCK", block)
    assert list(records(pa.BufferReader(data), 0, len(data))) == whole


def test_magic_inside_data_and_across_blocks():
    lure = b"\x1f\x8b\x08" * 50 + zlib.compressobj(wbits=31).flush() + gzip.compress(b"no record at all")
    data = lure + member(1, 20) + lure + b"\x00" * (BLOCK - 2 * len(lure) - len(member(1, 20)) - 1) + member(2, 30)
    assert [r["record_id"] for r in records(pa.BufferReader(data), 0, len(data))] == ["urn:page:1:", "urn:page:2:"]


def test_damage_is_reported_and_passed_over():
    good, bad = member(1, 200), bytearray(member(2, 5000))
    bad[len(bad) // 2] ^= 0xFF
    data = good + bytes(bad) + member(3, 100) + member(4, 4000)[:-50]
    rows = list(records(pa.BufferReader(data), 0, len(data)))
    assert [r["problem"] for r in rows] == [None, "damaged", None, "cut off"]
    wrong = parsed(zlib.decompress(member(5, 100), 31).replace(b"sha256:", b"sha256:0"))
    assert wrong["problem"] == "digest"
    assert parsed(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab\r\n\r\n")["problem"] == "length"


def test_only_committed_files_are_read(spark, tmp_path):
    write_pages(spark.createDataFrame(PAGES, "page_id long, url string, html string"), f"{tmp_path}/w")
    (tmp_path / "w" / "part-00000-lost-0000.warc.gz").write_bytes(member(99, 50))
    assert read_records(spark, f"{tmp_path}/w").count() == len(PAGES)
    (tmp_path / "x.warc.gz").write_bytes(member(1, 5))
    WarcWriter(str(tmp_path), 1).abort([Written(["x.warc.gz"]), None])
    assert not (tmp_path / "x.warc.gz").exists()
    with pytest.raises(ValueError):
        WarcSource({"path": str(tmp_path)}).writer(None, True)


def test_empty_table_and_foreign_archive(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert archived(none).count() == 0
    write_pages(none, f"{tmp_path}/w")
    assert json.loads((tmp_path / "w" / MANIFEST).read_text()) == []
    folder = tmp_path / "foreign"
    folder.mkdir()
    (folder / "a.warc.gz").write_bytes(member(1, 10) + gzip.compress(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"))
    rows = page_digests(read_records(spark, str(folder)), "string").collect()
    assert [(r.page_id, r.record_type) for r in rows] == [("1", "response"), (None, "warcinfo")]
