import base64
import glob
import gzip
import hashlib

import pytest

from docugauge.llm import warc

DDL = "page_id long, url string, html string, payload_digest string"


def run(spark, tmp_path, rows, **options):
    pages = spark.createDataFrame(rows, DDL).repartition(3)
    warc.write_responses(pages, str(tmp_path / "a"), file_records=2)
    warc.deduplicate(spark, str(tmp_path / "a"), str(tmp_path / "b"), **options)
    return warc.read(spark, str(tmp_path / "b"), payload=True).collect()


def test_equal_payloads_become_revisits(spark, tmp_path):
    body = "<p>é\r\n\r\nWARC/1.1\r\n</p>"
    rows = [(1, "http://a/ b\n", body, "x"), (2, "http://b", body, None), (9, None, body, None), (3, "u", None, None), (4, "u", "", None), (5, "u", "alone \x00", None), (None, "u", "alone \x00", None)]
    got = {r.page_id: r for r in run(spark, tmp_path, rows)}
    digest = base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("revisit", 9), 2: ("revisit", 9), 9: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), None: ("revisit", 5)}
    assert got[1].payload_digest == digest and got[1].payload_bytes == len(body.encode()) and got[9].payload == body and got[1].payload is None
    assert got[1].uri == "http://a/%20b%0A" and got[9].uri is None and got[5].payload == "alone \x00"
    held = b"".join(gzip.decompress(open(f, "rb").read()) for f in glob.glob(str(tmp_path / "b" / "part-*")))
    assert held.count(body.encode()) == 1 and held.count(b"WARC-Type: revisit\r\n") == 4 and held.endswith(b"\r\n\r\n")


def test_small_payloads_stay_and_ties_leave_one(spark, tmp_path):
    rows = [(1, "u", "tiny", None), (2, "u", "tiny", None), (7, "u", "long enough", None), (7, "u", "long enough", None), (6, "u", "long enough", None)]
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in run(spark, tmp_path, rows, min_bytes=5) if r.page_id < 3 or r.record_type == "response")
    assert got == [(1, "response", None), (2, "response", None), (7, "response", None)]
    kinds = sorted(r.record_type for r in warc.read(spark, str(tmp_path / "b")).collect())
    assert kinds == ["response"] * 3 + ["revisit"] * 2


def test_empty_table_and_damage(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
    record = lambda digest: b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:1>\r\nWARC-Payload-Digest: sha1:" + digest + b"\r\nContent-Length: 23\r\n\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    good = record(base64.b32encode(hashlib.sha1(b"ab").digest()))
    for n in (1, 3, 1000):
        found = list(warc.walk("f", [(good * 2)[i : i + n] for i in range(0, 2 * len(good), n)]))
        assert [(r[1], r[3], r[-1]) for r in found] == [(0, 1, b"ab"), (len(good), 1, b"ab")]
    for bad in (record(b"A"), good[:-1], good[:40]):
        with pytest.raises(ValueError):
            list(warc.walk("f", [bad]))


def test_archives_in_pieces_of_any_size():
    import gzip

    data = bytes(range(256)) * 5000
    for held in (gzip.compress(data), gzip.compress(data[:1000]) + gzip.compress(b"") + gzip.compress(data[1000:])):
        for piece in (100, 1 << 20):
            assert b"".join(warc.inflated(held, piece)) == data
        with pytest.raises(ValueError):
            b"".join(warc.inflated(held[:-20]))


def test_a_very_long_page(spark, tmp_path):
    long = "word <b>é</b> " * 3_000_000  # 45 MB
    warc.write_responses(spark.createDataFrame([(1, "u", long), (2, "v", "short"), (3, "w", long)], "page_id long, url string, html string").repartition(2), f"{tmp_path}/a")
    warc.deduplicate(spark, f"{tmp_path}/a", f"{tmp_path}/b")
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.read(spark, f"{tmp_path}/b").collect()}
    assert got == {1: ("revisit", 3, len(long.encode())), 2: ("response", None, 5), 3: ("response", None, len(long.encode()))}
