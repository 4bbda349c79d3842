import base64
import gzip
import hashlib
import random
from collections import Counter

import pyarrow.fs as pafs
import pytest

from txnscore.llm import warc


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def pages(spark, rows):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    return frame.withColumns({"row": frame.page_id, "digest": frame.url, "payload": frame.html})


ROWS = [
    (5, "http://a/\r\nX: y%0A", "same"),
    (2, None, "same"),
    (9, "http://b/", "same"),
    (2, "http://c/", "other"),
    (7, "u", None),
    (8, "u", ""),
    (None, "u", "same"),
    (None, "u", "only null"),
    (3, "u", "x" * 300_000),
    (11, "u", "\r\n\r\nWARC/1.1\r\n"),
    (12, "u", "é😀" * 500),
    (13, "u", "rep"),
    (13, "u", "rep"),
]


def test_round_trip(spark, tmp_path):
    got = warc.round_trip(pages(spark, ROWS), f"file://{tmp_path}/w").collect()
    assert len(got) == len(ROWS)
    groups = {}
    for i, _, html in ROWS:
        groups.setdefault((html or "").encode(), []).append(i)
    want = []
    for payload, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        ids.remove(first)
        want.append((first, len(payload), digest(payload), "response", None))
        want += [(i, len(payload), digest(payload), "revisit", first) for i in ids]
    assert sorted([tuple(r) for r in got], key=repr) == sorted(want, key=repr)


def test_small_payloads_are_all_responses(spark, tmp_path):
    got = warc.round_trip(pages(spark, ROWS), f"file://{tmp_path}/w", least=4).collect()
    assert Counter(r.record_type for r in got if r.payload_bytes < 4) == {"response": 4}
    assert Counter(r.record_type for r in got if r.payload_bytes == 4)["response"] == 1


def test_every_split_size_reads_each_record_once(spark, tmp_path):
    rng = random.Random(2)
    # Stored gzip members inside payloads look like records to anyone who only searches for the magic.
    false = gzip.compress(b"WARC/1.1 is not a header", 0) + b"\x1f\x8b\x08"
    parts = [warc.record("response", {"X-Page-Id": str(k)}, rng.randbytes(rng.randint(0, 400)) + false * rng.randint(0, 2)) for k in range(40)]
    path = tmp_path / "one.warc.gz"
    path.write_bytes(b"junk" + parts[0] + b"\x1f\x8b" + b"".join(parts[1:]))
    fs, name = pafs.FileSystem.from_uri(f"file://{path}")
    size = path.stat().st_size
    for split in (7, 100, 1000, 5000, size):
        for piece in (64, 4096):
            found = [f["X-Page-Id"] for s in range(0, size, split) for f, _ in warc.records(fs, name, size, s, min(s + split, size), piece)]
            assert found == [str(k) for k in range(40)], (split, piece)


def test_only_listed_files_are_read(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    files = warc.write(pages(spark, ROWS), folder)
    (tmp_path / "w" / "part-000000-left-behind.warc.gz").write_bytes(warc.record("response", {"X-Page-Id": "77"}, b"x"))
    assert {r.page_id for r in warc.read(spark, files).collect()} == {i for i, *_ in ROWS}


def test_urls_survive(spark, tmp_path):
    files = warc.write(pages(spark, ROWS), f"file://{tmp_path}/w")
    got = warc.read(spark, files, warc.Split(size=50)).collect()
    assert Counter(r.url for r in got) == Counter(u for _, u, _ in ROWS)


@pytest.mark.parametrize("rows", [[]])
def test_empty_table(spark, tmp_path, rows):
    assert warc.round_trip(pages(spark, rows), f"file://{tmp_path}/w").collect() == []


def test_shuffled_input_keeps_every_payload(spark, tmp_path):
    """8,000 pages with 1,000 payloads after a shuffle that adaptive execution merges as it likes."""
    from pyspark.sql import functions as F

    rows = spark.range(16_000).select(
        (F.col("id") % 8_000).alias("page_id"),
        F.concat(F.lit("http://h/"), F.repeat(F.lit("long/"), 60), "id").alias("url"),
        F.concat(F.lit("payload "), F.pmod(F.xxhash64(F.col("id") % 8_000), F.lit(1_000))).alias("html"),
    )
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        pages_ = rows.dropDuplicates(["page_id"])
        got = warc.round_trip(pages_, f"file://{tmp_path}/w").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == 8_000
    kinds = Counter(r.record_type for r in got)
    payloads = {r.payload_digest for r in got}
    assert kinds["response"] == len(payloads) and all(r.refers_to is not None for r in got if r.record_type == "revisit")
    first = {}
    for r in got:
        first[r.payload_digest] = min(first.get(r.payload_digest, r.page_id), r.page_id)
    assert all((r.page_id if r.refers_to is None else r.refers_to) == first[r.payload_digest] for r in got)


def test_long_payloads_in_small_pieces(spark, tmp_path):
    """Payloads beyond the 64 KB read and a 1 MB piece, incompressible, and their copies."""
    rng = random.Random(6)
    long = "".join(chr(rng.randrange(32, 0x800)) for _ in range(900_000))
    rows = [(1, "u", long), (2, "u", long), (3, "v", long[::-1]), (4, "w", "short")]
    got = {r.page_id: r for r in warc.round_trip(pages(spark, rows), f"file://{tmp_path}/w", split=warc.Split(1 << 18, 1 << 16)).collect()}
    assert [got[k].record_type for k in (1, 2, 3, 4)] == ["response", "revisit", "response", "response"]
    assert got[2].refers_to == 1 and got[2].payload_bytes == len(long.encode()) == got[3].payload_bytes
