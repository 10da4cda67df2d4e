from __future__ import annotations

import gzip
import hashlib
import io
import random

from lodestar.llm import warc
from pyspark.sql import functions as F


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_sha1 string")
    return df.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))


def test_written_archives_are_read_back_at_any_split(spark, tmp_path):
    r = random.Random(4)
    big = "ü" * 700
    rows = [(i, f"http://x/{i}", r.randbytes(r.randrange(4000)).hex(), "") for i in range(40)]
    rows += [(100 + i, None if i % 2 else "http://a b\n", big, None) for i in range(6)]
    rows += [(200, "u", None, None), (201, "u", "", None), (202, "u", "s" * 999, None), (203, "u", "s" * 999, None), (None, "u", big, None)]
    folder = f"file://{tmp_path}/w"
    done = warc.write_archives(warc.with_revisits(pages(spark, rows)).repartition(3), folder).collect()
    assert sum(d["records"] for d in done) == len(rows)
    for d in done:  # any gzip reader takes the files
        raw = (tmp_path / "w" / d["file"]).read_bytes()
        assert gzip.GzipFile(fileobj=io.BytesIO(raw)).read().count(b"WARC/1.1\r\n") == d["records"]
    for split in (1000, 4096, 1 << 20):
        got = warc.read_archives(spark, folder, split).collect()
        assert len(got) == len(rows)
        by = {g["record_id"]: g for g in got}
        for i, _, html, _ in rows:
            g, payload = by["urn:page:" + ("" if i is None else str(i))], (html or "").encode()
            assert g["payload_bytes"] == len(payload) and g["payload_digest"] == hashlib.sha1(payload).hexdigest()
            old = html == big and i != 105
            assert g["record_type"] == ("revisit" if old else "response")
            assert g["refers_to"] == ("urn:page:105" if old else None)
            assert (g["payload"] is None) if old else (bytes(g["payload"]) == payload)


def test_false_magic_and_damage_are_passed_over(tmp_path):
    a = warc.member(warc.record("response", "urn:page:1", None, b"x", hashlib.sha1(b"x").hexdigest(), 1, None))
    noise = warc.MAGIC + b"\x00junk" * 10 + gzip.compress(b"not a record")
    data = noise + a + warc.MAGIC + b"zz" + a + a[: len(a) // 2]
    at = [i for i in range(len(data)) if data.startswith(a, i)]
    found = []
    for start in range(0, len(data), 13):
        found += [p for p, _, _ in warc.records_in(warc.Source(io.BytesIO(data), len(data)), start, min(len(data), start + 13))]
    assert found == at


def test_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    warc.write_archives(warc.with_revisits(pages(spark, [])), folder)
    assert warc.read_archives(spark, folder).count() == 0
