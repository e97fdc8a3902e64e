import base64
import gzip
import hashlib
import random

import pyarrow.fs as pafs

from strainwise.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, payload string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", "p") for r in rows], SCHEMA)


def rng_text(seed, n):
    r = random.Random(seed)
    return "".join(r.choice("abc <>é\n") for _ in range(n))


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip_of_every_page_with_any_split(spark):
    rows = [(i, f"http://x/{i}", rng_text(i % 40, 20 + 37 * (i % 40))) for i in range(120)]
    rows += [(200, None, None), (201, "u", ""), (202, "a\r\nb: c", rng_text(7, 200_000))]
    first = {}
    for i, _, html in rows:
        first.setdefault(html or "", i)
    for split in (500, 4096, 8 << 20):
        out = warc.round_trip(spark, pages(spark, rows).repartition(3), split_bytes=split, archive_bytes=20_000).collect()
        assert len(out) == len(rows)
        got = {int(r["record_id"].rpartition(":")[2]): r for r in out}
        for i, _, html in rows:
            r, keep = got[i], first[html or ""]
            assert r["payload_digest"] == digest(html) and r["payload_bytes"] == len((html or "").encode())
            assert r["record_type"] == ("response" if keep == i else "revisit")
            assert r["refers_to"] == (None if keep == i else f"urn:page:{keep}")
            assert keep != i or bytes(r["payload"]) == (html or "").encode()


def test_small_payloads_stay_responses_from_the_limit(spark):
    out = warc.round_trip(spark, pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]), min_bytes=3)
    assert {r["record_id"][-1]: r["record_type"] for r in out.collect()} == {
        "1": "response", "2": "response", "3": "response", "4": "revisit"}


def test_repeated_and_null_ids_lose_no_record(spark):
    out = warc.round_trip(spark, pages(spark, [(1, "u", "x"), (1, "u", "x"), (None, "u", "x"), (None, "u", "y")])).collect()
    assert sorted((r["record_id"], r["record_type"]) for r in out) == [
        ("urn:page:1", "response"), ("urn:page:1", "response"), ("urn:page:null", "response"), ("urn:page:null", "revisit")]


def test_empty_table(spark):
    assert warc.round_trip(spark, pages(spark, [])).collect() == []


def test_false_magic_is_no_record(tmp_path):
    noise = random.Random(3).randbytes(5000).replace(b"\x1f\x8b", b"\x00\x00")
    fake = b"\x1f\x8b\x08" + noise + gzip.compress(b"not a record") + noise
    real = [warc.member(f"urn:page:{i}", "response", "u", "D", None, b"p%d" % i * 50) for i in range(5)]
    data = fake + real[0] + real[1] + noise + b"".join(real[2:])
    (tmp_path / "a.gz").write_bytes(data)
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "a.gz")) as handle:
        source = warc._Source(handle, len(data))
        for split in (64, 700, len(data)):
            got = [f["warc-record-id"] for a in range(0, len(data), split)
                   for _, f, _ in warc.read_range(source, a, min(a + split, len(data)))]
            assert got == [f"<urn:page:{i}>" for i in range(5)]


def test_query_with_null_repeated_and_long_pages(spark, tmp_path):
    from strainwise.llm import catalog

    long = rng_text(9, 2_500_000)
    rows = [(None, "u", "x"), (None, None, "lone"), (3, "u", "x"), (3, "u", "x"), (4, "u", None), (5, "u", long), (6, "v", long)]
    pages(spark, rows).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                  for r in catalog.op4_warc(spark, str(tmp_path)).collect()), key=str)
    n = len(long.encode())
    assert got == sorted([
        (None, 1, digest("x"), "revisit", 3), (None, 4, digest("lone"), "response", None), (3, 1, digest("x"), "response", None),
        (3, 1, digest("x"), "response", None), (4, 0, digest(""), "response", None), (5, n, digest(long), "response", None),
        (6, n, digest(long), "revisit", 5)], key=str)


def test_requests_are_shared_by_members():
    class Counted:
        def __init__(self, data):
            self.data, self.reads = data, 0

        def read_at(self, n, offset):
            self.reads += 1
            return self.data[offset:offset + n]

    data = b"".join(warc.member(f"urn:page:{i}", "response", "u", "D", None, b"p%d" % i * 20) for i in range(2000))
    handle = Counted(data)
    assert len(list(warc.read_range(warc._Source(handle, len(data)), 0, len(data)))) == 2000
    assert handle.reads <= 3 + len(data) // (warc.AHEAD // 2)
