"""WARC archives: a distributed writer, and a splittable reader of gzip members.

The writer puts one archive per partition into a folder that all executors share; a task writes under a
name of its own and renames at the end, so a repeated task replaces its archive with the same records. The
reader deals byte ranges. A task looks for gzip magic in its range, takes a candidate only if it inflates
to a WARC header and its whole member checks out, and owns the records that start inside its range.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import discard, make_dir, materialize, new_path, sliced, table

MAGIC = b"\x1f\x8b\x08"
READ = 1 << 18
LEAST_REVISIT = 1000
#: Most tasks that read splits; with more splits each reads several.
MOST_TASKS = 50_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path[5:])


def with_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "payload", least: int = LEAST_REVISIT) -> DataFrame:
    """Adds payload_bytes, payload_sha1 and refers_to: the largest id of the equal payloads of ``least`` bytes or more, null on that row.

    Only digests are grouped, and counted before they are shuffled; payloads are dealt once, by their digest, in
    a join whose large partitions adaptive execution splits.
    """
    digest = pages.withColumn("payload_bytes", F.octet_length(payload_col).cast("long")).withColumn("payload_sha1", F.sha1(payload_col))
    large = F.col("payload_bytes") >= least
    same = digest.where(large).groupBy("payload_sha1", "payload_bytes").agg(F.max(id_col).alias("kept"), F.count(F.lit(1)).alias("copies"))
    same = same.where("copies > 1").drop("copies")
    out = digest.join(same, ["payload_sha1", "payload_bytes"], "left")
    refers = F.when(large & (F.col("kept") != F.coalesce(F.col(id_col), F.col("kept") - 1)), F.col("kept"))
    return out.withColumn("refers_to", refers).drop("kept")


def record(kind: str, record_id: str, url: str | None, payload: bytes, digest: str, size: int, refers_to: str | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    lines.append(f"Lodestar-Payload-Length: {size}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    block = HTTP % size + (payload if kind == "response" else b"")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    c = zlib.compressobj(5, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "payload") -> DataFrame:
    """One .warc.gz per partition of ``pages`` (see with_revisits); returns (file, bytes, records) once all are written."""
    source = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload"), "payload_bytes", "payload_sha1", F.col("refers_to").cast("string").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        own = f"{base}/.{name}.{uuid.uuid4().hex}"
        records = size = 0
        with fs.open_output_stream(own, compression=None) as out:
            for whole in batches:
                for batch in sliced(whole, "payload"):
                    for r in batch.to_pylist():
                        kind = "response" if r["refers_to"] is None else "revisit"
                        urn = "urn:page:" + (r["id"] if r["id"] is not None else "")
                        old = None if r["refers_to"] is None else "urn:page:" + r["refers_to"]
                        data = member(record(kind, urn, r["url"], r["payload"], r["payload_sha1"], r["payload_bytes"], old))
                        out.write(data)
                        size += len(data)
                        records += 1
        fs.move(own, f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"file": [name], "bytes": [size], "records": [records]})

    make_dir(pages.sparkSession, folder)
    return materialize(source.mapInArrow(run, "file string, bytes long, records long"), "archives")


class Source:
    """Bytes of a file at any place, read in steps."""

    def __init__(self, handle, size: int):
        self.handle, self.size = handle, size

    def at(self, pos: int, n: int = READ) -> bytes:
        self.handle.seek(pos)
        return self.handle.read(max(0, min(n, self.size - pos)))

    def inflate(self, pos: int, only_head: bool = False) -> tuple[bytes, int] | None:
        """The member at ``pos`` and the place after it; None if it is no whole WARC member there."""
        d, parts, total, here = zlib.decompressobj(31), [], 0, pos
        try:
            while not d.eof:
                raw = self.at(here)
                if not raw:
                    return None
                here += len(raw)
                parts.append(d.decompress(raw))
                if total < 8 and not b"".join(parts)[:7].startswith(b"WARC/1."[: total + len(parts[-1])]):
                    return None
                total += len(parts[-1])
        except zlib.error:
            return None
        data = b"".join(parts)
        return (data, here - len(d.unused_data)) if data.startswith(b"WARC/1.") else None


def parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers (names in lower case) and block of a record; None if the lengths do not agree."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    names = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        names[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    try:
        n = int(names["content-length"])
    except (KeyError, ValueError):
        return None
    return (names, rest[:n]) if sep and len(rest) == n + 4 else None


def records_in(source: Source, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Records whose member starts in [start, end)."""
    pos, chained = start, False
    while pos < end:
        if not chained:  # look for the next candidate; magic may lie across the end of a step
            raw = source.at(pos, min(READ, end - pos) + len(MAGIC) - 1)
            found = raw.find(MAGIC)
            if found < 0:
                pos += max(1, len(raw) - len(MAGIC) + 1)
                continue
            pos += found
            if pos >= end:
                return
        got = source.inflate(pos)
        parsed = parse(got[0]) if got else None
        if parsed is None:
            pos, chained = pos + 1, False
            continue
        yield pos, *parsed
        pos, chained = got[1], True
        if pos < end and source.at(pos, 3) != MAGIC:
            chained = False


RECORD = "file string, start long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def read_archives(spark: SparkSession, folder: str, split_bytes: int = 8 << 20) -> DataFrame:
    """One row per record of the .warc.gz files in ``folder``, split inside files.

    payload_digest is bare hex. For response records payload, its size and digest are those of the bytes read;
    for revisits payload is null and the others come from the headers. Damaged members are passed over.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length").where("length > 0")
    cut = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    splits = files.agg(F.coalesce(F.sum(F.ceil(F.col("length") / split_bytes)), F.lit(0)).cast("long")).first()[0]
    fields = pa.schema([(n, ARROW[k]) for n, k in (f.split() for f in RECORD.split(", "))])
    dealt = cut.repartition(min(max(splits, 1), MOST_TASKS))  # a stated number: split rows are tiny, and would be merged into one task otherwise

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for split in batch.to_pylist():
                fs, path = file_system(split["path"])
                with fs.open_input_file(path) as handle:
                    for at, names, block in records_in(Source(handle, split["length"]), split["start"], min(split["length"], split["start"] + split_bytes)):
                        kind = names.get("warc-type", "")
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        stated = names.get("warc-payload-digest", "").removeprefix("sha1:")
                        digest = hashlib.sha1(payload).hexdigest() if payload is not None else base64.b32decode(stated).hex() if stated else None
                        size = len(payload) if payload is not None else int(names.get("lodestar-payload-length", 0))
                        bare = lambda k: names[k].strip("<>") if k in names else None  # noqa: B023, E731
                        rows.append(dict(zip(fields.names, (path.rpartition("/")[2], at, kind, bare("warc-record-id"), names.get("warc-target-uri"), bare("warc-refers-to"), digest, size, payload))))
                        held += len(block)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, fields)
                            rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, fields)

    return dealt.mapInArrow(run, RECORD)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Null html is an empty payload; rows that share a payload's largest page_id are all responses; a null page_id stays null."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    folder = new_path(spark, "warc")
    done = write_archives(with_revisits(pages), folder)
    number = lambda c: F.nullif(F.regexp_replace(c, "^urn:page:", ""), F.lit("")).cast("long")
    read = read_archives(spark, folder).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
    out = materialize(read, "records")
    discard(spark, folder, done)
    return out


OP5_SQL = """
with page as (select row_number() over () as r, page_id, encode(coalesce(html, '')) as b from pages),
digest as (select r, page_id, octet_length(b) as n, sha1(b) as d from page),
kept as (select d, n, max(page_id) as k, count(*) as c from digest where n >= 1000 group by d, n)
select page_id, n as payload_bytes, d as payload_digest,
  case when c > 1 and k is distinct from page_id and k is not null then 'revisit' else 'response' end as record_type,
  case when c > 1 and k is distinct from page_id then k end as refers_to
from digest left join kept using (d, n)
"""
