import base64
import gzip
import hashlib
import random
from pathlib import Path

import pytest

from trackloom.llm.shared import Scratch
from trackloom.llm.warc import LoserTree, capture_histories, merge_index, parse_archive, plan_records, read_archives, url_key, write_archives

SCHEMA = "page_id long, url string, html string, refers_to string"


def pages():
    body = "<p>é\r\n\r\nWARC/1.1\r\n\r\n</p>"
    return [(1, "http://b.example/x?q=1", body), (2, "https://www.a.example:80/", body), (3, "http://a.example/z", ""), (4, None, None), (5, "http://u@a.example/bad url\r\nX: y", "<html>" * 30000), (6, "http://b.example/x?q=1", body), (9, "http://c", "tiny")]


def expected(rows, least=0):
    newest = {}
    for p, _, h in rows:
        newest[h or ""] = max(newest.get(h or "", p), p)
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        first = newest[h or ""] if len(raw) >= least else p
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first == p else "revisit", None if first == p else first))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


@pytest.mark.parametrize("least", [0, 20])
def test_round_trip_and_order(spark, least):
    got = capture_histories(frame(spark, pages()), least=least).orderBy("position").collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected(pages(), least)
    keys = [(r.url_key, r.captured, r.page_id) for r in got]
    assert keys == sorted(keys)


def test_archives_are_gzip_files_with_whole_payloads(spark, tmp_path):
    df = frame(spark, pages())
    write_archives(plan_records(df), str(tmp_path / "w"))
    records = [r for p in Path(tmp_path / "w").glob("part-*") for r in parse_archive(p.read_bytes())]
    bodies = {p: (h or "").encode() for p, _, h in pages()}
    assert len(records) == 7 and all(r["payload"] == bodies[r["page_id"]] for r in records if r["record_type"] == "response")
    assert all(gzip.decompress(p.read_bytes()).startswith(b"WARC/1.1\r\n") for p in Path(tmp_path / "w").glob("part-*") if len(gzip.decompress(p.read_bytes())))
    back = {r.page_id: r.payload for r in read_archives(spark, str(tmp_path / "w")).collect()}
    assert back[5] == "<html>" * 30000 and back[1] is None and back[6] == pages()[5][2]


def test_a_record_can_be_read_alone_from_its_offset(spark, tmp_path):
    rows = [(i, f"http://h{i % 3}.example/{i}", "".join(random.Random(i).choices("abcdé<>", k=i * 50))) for i in range(60)]
    write_archives(plan_records(frame(spark, rows).repartition(2)), str(tmp_path / "w"), size=4000)
    files = list(Path(tmp_path / "w").glob("part-*"))
    assert len(files) > 5 and all(p.stat().st_size < 4000 + 3000 for p in files)
    seen = set()
    for p in files:
        raw = p.read_bytes()
        for r in parse_archive(raw):
            alone = next(parse_archive(raw[r["offset"] :]))
            assert alone["page_id"] == r["page_id"] and alone["payload"] == r["payload"]
            seen.add(r["page_id"])
    assert seen == set(range(60))


def test_a_member_that_ends_with_another_byte(spark, tmp_path):
    # 16 MB and more: the last byte of the gzip member isn't zero
    rows = [(1, "http://a", "x" * (17 << 20)), (2, "http://b", "y")]
    write_archives(plan_records(frame(spark, rows).coalesce(1)), str(tmp_path / "w"), size=100)
    back = {r.page_id: r.payload_bytes for r in read_archives(spark, str(tmp_path / "w"), payload=False).collect()}
    assert back == {1: 17 << 20, 2: 1}


@pytest.mark.parametrize("rows", [7, 50, 1000])
def test_positions_over_ranges(spark, rows):
    # a hot URL with a third of all captures, cut by time; many runs a range
    rng = random.Random(rows)
    records = [(f"f{rng.randrange(9)}", "hot" if rng.random() < 0.35 else f"k{rng.randrange(40)}", f"t{rng.randrange(99):02}", i) for i in range(300)]
    df = spark.createDataFrame(records, "file string, url_key string, captured string, page_id long").repartition(5)
    got = merge_index(df, Scratch(spark, "test"), rows=rows).orderBy("position").collect()
    assert [r.position for r in got] == list(range(300))
    assert [(r.url_key, r.captured, r.page_id) for r in got] == sorted(r[1:] for r in records)


def test_odd_rows(spark):
    assert capture_histories(frame(spark, [])).count() == 0
    rows = [(7, "http://a", "same"), (7, "http://a", "same"), (None, "http://n", "x")]
    got = capture_histories(frame(spark, rows)).collect()
    assert [(r.page_id, r.record_type) for r in got] == [(7, "response")] * 2


def test_a_damaged_archive_is_an_error():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Date: d\r\nWARC-Target-URI: u\r\nWARC-Payload-Digest: sha1:X\r\nContent-Length: 4\r\n\r\n\r\n\r\n\r\n\r\n"
    with pytest.raises(ValueError, match="digest"):
        list(parse_archive(gzip.compress(good)))
    with pytest.raises(ValueError, match="ends within"):
        list(parse_archive(gzip.compress(good[:-30])))


def test_loser_tree_merges():
    rng = random.Random(2)
    for k in range(9):
        runs = [sorted((rng.randrange(50), rng.random()) for _ in range(rng.randrange(12))) for _ in range(k)]
        assert list(LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_url_key():
    assert url_key("https://www.Example.com:443/A/b?c#d") == "com,example)/A/b?c"
