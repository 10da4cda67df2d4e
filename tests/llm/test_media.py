from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from lodestar.llm import media


def slow_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    data = random.Random(1).randbytes(500)
    assert media.page_checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("size", [64, 255 * 64, 4000 * 16, 4032, 65025 // 64 * 64, 200_000 // 64 * 64, 1_000_000 // 64 * 64])
def test_round_trip(size):
    payload = random.Random(size).randbytes(size)
    got, n, times = media.read_back(media.encode(payload, size - 5))
    assert got == payload and n == size - 5 and times[-1] == size / media.RATE


def test_packets_of_all_sizes_cross_pages():
    r = random.Random(3)
    packets = [(r.randbytes(n), i) for i, n in enumerate([0, 1, 254, 255, 256, 510, 65025, 65024, 65026, 130050, 0, 300_000])]
    streams = media.decode(b"".join(media.pages_of(packets, 9)))
    assert streams[9].packets == [p for p, _ in packets]


def test_damage_is_found():
    good = media.encode(b"x" * 6400, 6400)
    for i in range(0, len(good), 97):
        bad = bytearray(good)
        bad[i] ^= 1
        with pytest.raises(media.MediaError):
            media.read_back(bytes(bad))
    for cut in (1, 100, 3000):
        with pytest.raises((media.MediaError, IndexError)):
            media.read_back(good[:-cut])


def test_table(spark):
    rows = [(1, "abc", "m"), (2, None, "m"), (3, "", None), (None, "é" * 5000, "m"), (1, "abc", "m"), (5, "z" * 64, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    out = media.media_features(media.with_media(df)).collect()
    assert len(out) == 6
    for r in out:
        raw = (r["text"] or "").encode()
        pad = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(pad)) and r["media_error"] is None
        assert r["payload_sha256"] == hashlib.sha256(pad).hexdigest() and r["tail_crc32"] == zlib.crc32(pad[-64:])
    assert media.media_features(media.with_media(df.limit(0))).count() == 0
    odd = spark.createDataFrame([(1, None), (2, bytearray(b"OggS"))], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in media.media_features(odd).collect()}
    assert got[1]["media_bytes"] is None and got[2]["media_error"]
