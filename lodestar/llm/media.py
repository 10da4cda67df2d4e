"""Ogg media columns: packets in checksummed pages, several logical streams in one file.

A text becomes two interleaved logical streams: mono 8-bit samples (the payload, losslessly) and an index
with the original length. The reader verifies every page's checksum, puts packets together from the lacing
values (also across pages), separates the streams by serial number and derives times from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from lodestar.llm.common import sliced, table, utf8

RATE, PACKET = 8000, 4000
SAMPLES_ID, INDEX_ID = b"LSsample", b"LSindex_"
CONTINUED, FIRST, LAST = 1, 2, 4
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_NO_END = -1


class MediaError(ValueError):
    pass


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 04C11DB7, most significant bit first, zero start: zlib's, on mirrored bits."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIII B", b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def pages_of(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """Pages of one logical stream from (packet, granule at its end); the first packet has a page of its own."""
    out: list[bytes] = []
    lacing, body, granule, flags = bytearray(), [], _NO_END, 0

    def close(more: bool) -> None:
        nonlocal lacing, body, granule, flags
        kind = flags | (FIRST if not out else 0)
        out.append((kind, granule, bytes(lacing), b"".join(body)))
        lacing, body, granule, flags = bytearray(), [], _NO_END, CONTINUED if more else 0

    for i, (packet, end) in enumerate(packets):
        at, sizes = 0, [255] * (len(packet) // 255) + [len(packet) % 255]
        while sizes:
            if len(lacing) == 255:
                close(at > 0)
            part, sizes = sizes[: 255 - len(lacing)], sizes[255 - len(lacing) :]
            n = sum(part)
            lacing += bytes(part)
            body.append(packet[at : at + n])
            at += n
        granule = end
        if i == 0:
            close(False)
    if lacing or not out:
        close(False)
    last = len(out) - 1
    return [_page(kind | (LAST if k == last else 0), g, serial, k, lace, data) for k, (kind, g, lace, data) in enumerate(out)]


def encode(payload: bytes, n_bytes: int) -> bytes:
    """The payload's Ogg file. Equal payloads of equal length give equal bytes."""
    serial = zlib.crc32(payload)
    chunks = [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    sound = pages_of([(SAMPLES_ID + struct.pack("<IHQ", RATE, 8, len(payload)), 0), *chunks], serial)
    index = pages_of([(INDEX_ID + struct.pack("<Q", n_bytes), 0), (struct.pack("<I", zlib.crc32(payload)), len(payload))], serial ^ 0xFFFFFFFF)
    return b"".join([sound[0], index[0], *sound[1:], *index[1:]])


@dataclass
class Logical:
    packets: list[bytes] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)  # granule position at each packet's end, -1 where no page states it
    partial: list[bytes] = field(default_factory=list)
    number: int = 0
    ended: bool = False


def decode(media: bytes) -> dict[int, Logical]:
    """Logical streams by serial number. Raises MediaError for bad checksums, lost pages or cut packets."""
    streams: dict[int, Logical] = {}
    at = 0
    while at < len(media):
        if media[at : at + 4] != b"OggS" or len(media) < at + 27:
            raise MediaError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, crc, count = struct.unpack_from("<4sBBqIIIB", media, at)
        lacing = media[at + 27 : at + 27 + count]
        end = at + 27 + count + sum(lacing)
        if version or end > len(media) or len(lacing) < count:
            raise MediaError(f"cut page at byte {at}")
        raw = media[at:end]
        if page_checksum(raw[:22] + b"\0\0\0\0" + raw[26:]) != crc:
            raise MediaError(f"wrong checksum at byte {at}")
        if flags & FIRST and serial not in streams:
            streams[serial] = Logical()
        s = streams.get(serial)
        if s is None or s.ended or number != s.number or bool(flags & CONTINUED) != bool(s.partial):
            raise MediaError(f"page out of sequence at byte {at}")
        s.number += 1
        body, start, size = at + 27 + count, 0, 0
        for lace in lacing:
            size += lace
            if lace < 255:
                s.packets.append(b"".join([*s.partial, media[body + start : body + start + size]]))
                s.ends.append(-1)
                s.partial, start, size = [], start + size, 0
        if size:
            s.partial.append(media[body + start : body + start + size])
        if granule >= 0 and s.ends:
            s.ends[-1] = granule
        s.ended = bool(flags & LAST)
        at = end
    if any(s.partial or not s.ended for s in streams.values()):
        raise MediaError("a stream has no end")
    return streams


def read_back(media: bytes) -> tuple[bytes, int, np.ndarray]:
    """Payload, the length before padding, and each sample packet's end time in seconds."""
    sound = index = None
    for s in decode(media).values():
        if s.packets[0].startswith(SAMPLES_ID):
            sound = s
        elif s.packets[0].startswith(INDEX_ID):
            index = s
    if sound is None or index is None:
        raise MediaError("a stream is missing")
    rate, _, total = struct.unpack_from("<IHQ", sound.packets[0], 8)
    payload = b"".join(sound.packets[1:])
    ends = np.array(sound.ends[1:], np.int64)
    sizes = np.array([len(p) for p in sound.packets[1:]], np.int64)
    position = np.cumsum(sizes)
    stated = ends >= 0
    if len(payload) != total or (ends[stated] != position[stated]).any() or zlib.crc32(payload) != struct.unpack("<I", index.packets[1])[0]:
        raise MediaError("samples do not match their granule positions or checksum")
    return payload, struct.unpack_from("<Q", index.packets[0], 8)[0], position / rate


def describe(payload: bytes, times: np.ndarray) -> str:
    """Duration, loudness, zero crossings around the middle level, and the time of the loudest packet."""
    x = np.frombuffer(payload, np.uint8)
    energy, crossed, loud = 0, 0, []
    for i in range(0, len(x), PACKET):
        part = x[i : i + PACKET].astype(np.int32) - 128
        loud.append(int((part * part).sum()))
        energy += loud[-1]
        crossed += int(np.count_nonzero((part[1:] >= 0) != (part[:-1] >= 0)))
    return f"sec={times[-1]:.3f};rms={(energy / len(x)) ** 0.5:.4f};cross={crossed};loudest={times[int(np.argmax(loud))]:.3f}"


def with_media(df: DataFrame, text_col: str = "text", media_col: str = "media", unit: int = 64) -> DataFrame:
    """All columns and rows of ``df`` with the text's Ogg file; a media column of that name is replaced.

    The payload is the UTF-8 text (null: empty) with zero bytes up to a positive multiple of ``unit``.
    """
    keep = df.drop(media_col)
    names = keep.columns
    column = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, text_col):
                media = [encode(t.ljust(max(unit, -(-len(t) // unit) * unit), b"\0"), len(t)) for t in utf8(batch.column(column))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(media, pa.binary())], [*names, media_col])

    return keep.mapInArrow(run, StructType([*keep.schema.fields, StructField(media_col, BinaryType())]))


FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_error string"


def media_features(df: DataFrame, media_col: str = "media") -> DataFrame:
    """The other columns of ``df`` (but for those named like a feature) with what was read back from the media column.

    Null media gives null features; media that cannot be read gives its size and hash, and the reason in media_error.
    """
    added = StructType.fromDDL(FEATURES)
    keep = [c for c in df.columns if c != media_col and c not in added.names]
    kinds = [pa.int64() if f.dataType.simpleString() == "bigint" else pa.string() for f in added]

    def one(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * 8
        sha = hashlib.sha256(media).hexdigest()
        try:
            payload, n, times = read_back(media)
        except (MediaError, struct.error, IndexError) as e:
            return None, None, None, None, len(media), sha, None, str(e)
        return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), sha, describe(payload, times), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*map(one, batch.column(len(keep)).to_pylist()))) or [()] * 8
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(list(v), k) for v, k in zip(rows, kinds)]], [*keep, *added.names])

    source = df.select(*keep, F.col(media_col))
    return source.mapInArrow(run, StructType([*[df.schema[c] for c in keep], *added.fields]))


def op7_ogg(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return media_features(with_media(docs).select("doc_id", "media"))
