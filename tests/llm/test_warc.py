import gzip
import hashlib
import random

import pyarrow as pa
import pytest

from lodestone.llm import common, warc


def _want(rows):
    digest = {i: hashlib.sha1((h or "").encode()).hexdigest() for i, _, h in rows}
    out = []
    for i, _, h in rows:
        size = len((h or "").encode())
        best = max(j for j, _, g in rows if (g or "") == (h or ""))
        revisit = size >= warc.MIN_REVISIT and i != best
        out.append((i, size, digest[i], "revisit" if revisit else "response", best if revisit else None))
    return sorted(out)


def test_written_and_read_back(spark):
    rng = random.Random(2)
    noise = "".join(chr(rng.randint(32, 0x2FF)) for _ in range(300_000))
    rows = [(1, "http://a", "x" * 1000), (2, None, "x" * 1000), (3, "u\r\nInjected: 1", "y" * 999), (4, "u", "y" * 999), (5, "", None), (6, "ü\\n", ""), (7, "n", noise), (9, "n", noise), (8, "n", noise)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    got = warc.archived(pages).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == _want(rows)
    assert warc.archived(pages.limit(0)).collect() == []


def test_ranges_of_any_size_give_each_record_once(spark):
    rng = random.Random(3)
    pages = spark.createDataFrame([(i, f"http://x/{i}\t\\é", "".join(rng.choices("abc <>é", k=rng.randint(0, 5000)))) for i in range(60)], "page_id long, url string, html string")
    path = common.scratch(spark, "warc-test")
    assert warc.write_archives(warc.planned(pages).coalesce(2), path) == 60
    want = sorted((r["page_id"], r["url"], r["html"].encode()) for r in pages.collect())
    for size in (97, 4096, 1 << 30):
        got = sorted((r["page_id"], r["url"], bytes(r["payload"])) for r in warc.read_archives(spark, path, size).collect())
        assert got == want


def test_false_magic_is_passed_over(tmp_path):
    record = warc.encoded_record(4, "http://u", b"body", "d", "response", None, "2024-01-01T00:00:00Z")
    data = b"junk\x1f\x8b\x08junk" + gzip.compress(b"not an archive") + record + b"\x1f\x8b" + record
    name = tmp_path / "a"
    name.write_bytes(data)
    with pa.OSFile(str(name)) as file:
        for step in (1, 5, len(data)):
            found = [f["warc-record-id"] for at in range(0, len(data), step) for f, _ in warc.records_in(file, len(data), at, at + step)]
            assert found == ["<urn:page:4>", "<urn:page:4>"]


def test_headers_of_any_length(spark):
    rng = random.Random(4)
    urls = ["http://x/" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789é", k=200_000)), "\\" * 11_000, "http://x/" + "a" * 600_000]
    rows = [(3 * k + i, u if i == 2 else f"http://copy/{k}/{i}", f"<p>{k}</p>" * 300) for k, u in enumerate(urls) for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archived(pages).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == _want(rows)
    path = common.scratch(spark, "warc-test")
    assert warc.write_archives(warc.planned(pages).coalesce(1), path) == len(rows)
    for size in (9973, 1 << 30):
        assert sorted((r["page_id"], r["url"]) for r in warc.read_archives(spark, path, size).collect()) == [r[:2] for r in rows]


def test_a_record_that_is_not_read_is_an_error(spark):
    records = spark.createDataFrame([(1, "u", "response", None, hashlib.sha1(b"x").hexdigest(), bytearray(b"x"))], warc.RECORDS)
    assert warc.resolved(records, 1).count() == 1
    with pytest.raises(ValueError):
        warc.resolved(records, 2)


def test_ids_that_repeat_with_equal_and_other_payloads(spark):
    same, other = "s" * 2000, "o" * 1500
    rows = [(8, "a", same), (9, "b", same), (9, "c", other), (9, "d", "small"), (7, "e", other), (9, "f", same), (None, "g", same), (6, "h", same)]
    out = warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    digest = {h: hashlib.sha1(h.encode()).hexdigest() for _, _, h in rows}
    want = []
    for i, _, h in rows:
        best = max(j for j, _, g in rows if g == h and j is not None)
        revisit = len(h) >= warc.MIN_REVISIT and i is not None and i != best
        want.append((i or -1, len(h), digest[h], "revisit" if revisit else "response", best if revisit else -1))
    assert sorted((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or -1) for r in out) == sorted(want)


def test_a_page_that_is_an_archive(spark, tmp_path):
    rng = random.Random(6)
    inner = b"".join(warc.encoded_record(k, f"http://in/{k}", rng.randbytes(40_000), "d", "response", None, "2024-01-01T00:00:00Z") for k in range(5))
    record = warc.encoded_record(1, "http://u", inner, "d", "response", None, "2024-01-01T00:00:00Z")
    name = tmp_path / "a"
    name.write_bytes(record + warc.encoded_record(2, "http://v", b"after", "d", "response", None, "2024-01-01T00:00:00Z"))
    size = name.stat().st_size
    with pa.OSFile(str(name)) as file:
        for step in (97, 4096, size):
            found = [(f["warc-record-id"], b) for at in range(0, size, step) for f, b in warc.records_in(file, size, at, at + step)]
            assert [i for i, _ in found] == ["<urn:page:1>", "<urn:page:2>"]
            assert found[0][1].endswith(inner)
    # without the writer's care the inner members are taken for records
    packer = __import__("zlib").compressobj(5, 8, 31)
    assert warc._holds_record(packer.compress(b"WARC/1.1\r\n\r\n" + inner) + packer.flush()) and not warc._holds_record(record)
