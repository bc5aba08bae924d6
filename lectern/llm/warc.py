"""WARC: deterministic sharded writer and reader.

Records are dealt to shards by ranges of their id whose bounds come from exact byte counts
(not from a random sample), sorted within a shard, and written as one gzip member each;
a file is closed once its compressed size passes ``roll_bytes``.  Headers and digests are made
anew from the payload, dates and record ids are functions of the input, so equal input
gives equal files.

A task writes under a temporary name of its own.  What the successful attempts report is
the manifest; a second job moves just those files to their final names, which it can repeat
after a failure, and last the manifest takes its own final name.  Readers go by the manifest,
so a half-written archive is never seen.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import drop_table, fresh_path, write_table
from .common import partitions, table, with_groups

DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_FILES = "shard int, seq int, name string, temp string, records long, bytes long, sha256 string"
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _b32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _record(kind: str, record_id: str, fields: list[tuple[str, str]], block: bytes, mime: str) -> list[bytes]:
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), *fields, ("WARC-Block-Digest", _b32(hashlib.sha1(block).digest())), ("Content-Type", mime), ("Content-Length", str(len(block)))]
    return [b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n", block, b"\r\n\r\n"]


def _gzip(parts: list[bytes], level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)  # a gzip member without a time stamp
    return b"".join([*(z.compress(p) for p in parts), z.flush()])


def page_record(page_id: int | None, url: str | None, payload: bytes, refers: tuple[int | None] | None) -> list[bytes]:
    """A response with the payload, or a revisit that names the page it refers to."""
    digest = hashlib.sha1(payload).digest()
    of = lambda p: f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{p}/{digest.hex()}')}>"
    target = "".join(c for c in (url or "") if c > " ") or "urn:none"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Target-URI", target), ("WARC-Payload-Digest", _b32(digest)), ("WARC-Page-ID", "" if page_id is None else str(page_id))]
    if refers is None:
        return _record("response", of(page_id), fields, http + payload, "application/http; msgtype=response")
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", of(refers[0])), ("WARC-Refers-To-Page-ID", "" if refers[0] is None else str(refers[0]))]
    return _record("revisit", f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'revisit/{page_id}/{digest.hex()}')}>", fields, http, "application/http; msgtype=response")


def range_bounds(sizes: DataFrame, target: int, buckets: int = 1024) -> list[int]:
    """Ids at which shards after the first begin, for (id long, bytes long), so that each has about ``target`` bytes.

    Sums of bytes over equal slices of the id range; a slice above the target is cut again.
    At most ``buckets`` sums reach the driver at a time, and the bounds are total / target.
    """
    ends = sizes.agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.sum("bytes").alias("n")).first()
    if ends["lo"] is None or ends["n"] <= target:
        return []

    def slices(lo: int, hi: int) -> list[tuple[int, int, int]]:
        step = max(1, -(-(hi - lo + 1) // buckets))
        found = sizes.filter(F.col("id").between(lo, hi)).groupBy(F.floor((F.col("id") - F.lit(lo)) / F.lit(step)).alias("b")).agg(F.sum("bytes").alias("n"))
        out = []
        for r in sorted((int(r["b"]), int(r["n"])) for r in found.collect()):
            a, b = lo + r[0] * step, min(hi, lo + (r[0] + 1) * step - 1)
            out += slices(a, b) if r[1] > target and b > a else [(a, b, r[1])]
        return out

    bounds, held = [], 0
    for a, _, n in slices(int(ends["lo"]), int(ends["hi"])):
        if held and held + n > target:
            bounds.append(a)
            held = 0
        held += n
    return bounds


def write_archive(pages: DataFrame, path: str, revisit_from: int = 1000, shard_bytes: int = 64 << 20, roll_bytes: int = 16 << 20, level: int = 4) -> DataFrame:
    """Write ``pages`` (page_id, url, html) under ``path`` and return the committed manifest.

    Of equal payloads of at least ``revisit_from`` bytes the one with the largest page_id is the
    response and the others are revisits of it; smaller ones are responses.  A null html is
    the empty payload, a null url becomes ``urn:none``, rows with a null page_id sort first and are
    kept; of rows that repeat id and payload the first is the response.  An empty table
    gives an empty manifest.  Other columns are not read.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    page_id = F.col("page_id").cast("long")
    narrow = write_table(pages.select(page_id.alias("id"), F.octet_length(html).cast("long").alias("bytes"), F.sha2(html, 256).alias("sha")), "pages")
    bounds = range_bounds(narrow.select("id", (F.col("bytes") + 600).alias("bytes")), shard_bytes)

    same = narrow.filter(F.col("bytes") >= revisit_from)
    keep = write_table(same.groupBy("sha").agg(F.max("id").alias("keep"), F.count("*").alias("n")).filter("n > 1"), "payloads")
    told = with_groups(same, keep, ["sha"], F.xxhash64("id"), narrow.count(), partitions(spark)).filter("n IS NOT NULL").select("id", "sha", "keep").distinct()

    cuts = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        known = ids.fillna(-(2**63)).astype("int64").to_numpy()
        return pd.Series(np.searchsorted(cuts, known, side="right").astype("int32"))

    rows = told.select("id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.col("sha").cast("binary").alias("data"), "keep").unionAll(
        pages.select(page_id.alias("id"), F.lit(1).alias("kind"), F.col("url").cast("string").alias("url"), html.alias("data"), F.lit(None).cast("long").alias("keep"))
    )
    dealt = rows.withColumn("shard", shard_of("id")).repartitionById(len(bounds) + 1, F.col("shard"))
    ordered = dealt.sortWithinPartitions("id", "kind", "data", "url")
    temp = f"{path}/_temporary"

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = _fs(temp)
        state: dict = {"out": None, "seq": 0}
        done: list[tuple] = []

        def begin(shard: int) -> None:
            name = f"part-{shard:06d}-{state['seq']:05d}.warc.gz"
            fs.create_dir(where, recursive=True)
            state.update(name=name, shard=shard, temp=f"{name}.{uuid.uuid4().hex}", n=0, size=0, sha=hashlib.sha256())
            state["out"] = fs.open_output_stream(f"{where}/{state['temp']}", compression=None)
            info = f"software: lectern\r\nformat: WARC file version 1.1\r\nfilename: {name}\r\n".encode()
            put(_gzip(_record("warcinfo", f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>", [("WARC-Filename", name)], info, "application/warc-fields"), level))

        def put(raw: bytes) -> None:
            state["out"].write(raw)
            state["sha"].update(raw)
            state["size"] += len(raw)

        def end() -> None:
            if state["out"] is not None:
                state["out"].close()
                done.append((state["shard"], state["seq"], state["name"], state["temp"], state["n"], state["size"], state["sha"].hexdigest()))
                state["out"], state["seq"] = None, state["seq"] + 1

        told_id, told_for, first_seen = object(), {}, set()
        for b in batches:
            for i, kind, url, data, keep_id, shard in zip(*(b.column(c).to_pylist() for c in range(5)), b.column(5).to_pylist()):
                if i != told_id or (kind == 0 and first_seen):
                    told_id, told_for, first_seen = i, {}, set()
                if kind == 0:
                    told_for[data.decode()] = keep_id
                    continue
                refers = None
                if told_for:
                    sha = hashlib.sha256(data).hexdigest()
                    if sha in told_for and (told_for[sha] != i or sha in first_seen):
                        refers = (told_for[sha],)
                    first_seen.add(sha)
                if state["out"] is None:
                    begin(shard)
                put(_gzip(page_record(i, url, data, refers), level))
                state["n"] += 1
                if state["size"] >= roll_bytes:
                    end()
        end()
        if done:
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(zip(*done), (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))],
                names=["shard", "seq", "name", "temp", "records", "bytes", "sha256"],
            )

    pending = f"{path}/manifest.pending"
    ordered.mapInArrow(write, _FILES).write.parquet(pending)
    drop_table(narrow)

    def move(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = _fs(path)
        for b in batches:
            for name, tmp in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if fs.get_file_info(f"{where}/_temporary/{tmp}").type != pafs.FileType.NotFound:
                    fs.move(f"{where}/_temporary/{tmp}", f"{where}/{name}")
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], names=["n"])

    spark.read.schema(_FILES).parquet(pending).select("name", "temp").mapInArrow(move, "n long").agg(F.sum("n")).collect()
    fs, where = _fs(path)
    if fs.get_file_info(f"{where}/_temporary").type != pafs.FileType.NotFound:
        fs.delete_dir(f"{where}/_temporary")  # what failed attempts left
    fs.move(f"{where}/manifest.pending", f"{where}/manifest")
    return spark.read.schema(_FILES).parquet(f"{path}/manifest")


def records_of(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzipped WARC stream; memory is one record."""
    z, held = zlib.decompressobj(31), []
    for chunk in chunks:
        while chunk:
            held.append(z.decompress(chunk))
            if not z.eof:
                break
            chunk, raw = z.unused_data, b"".join(held)
            z, held = zlib.decompressobj(31), []
            head, _, rest = raw.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
            yield fields, rest[: int(fields["Content-Length"])]
    if any(held):
        raise ValueError("the archive ends within a record")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record, digests checked."""
    files = spark.read.schema(_FILES).parquet(f"{path}/manifest").select("name", "sha256")
    dealt = files.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "name")

    def chunks(f: pafs.FileSystem, at: str, sha: str) -> Iterator[bytes]:
        seen = hashlib.sha256()
        with f.open_input_stream(at, compression=None) as s:
            while chunk := s.read(1 << 20):
                seen.update(chunk)
                yield chunk
        if seen.hexdigest() != sha:
            raise ValueError(f"{at} differs from its manifest")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = _fs(path)
        for b in batches:
            for name, sha in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out = []
                for h, block in records_of(chunks(fs, f"{where}/{name}", sha)):
                    if h["WARC-Type"] not in ("response", "revisit"):
                        continue
                    if h["WARC-Block-Digest"] != _b32(hashlib.sha1(block).digest()):
                        raise ValueError(f"{name}: a block differs from its digest")
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rsplit(b"Content-Length: ", 1)[1])
                    digest = base64.b32decode(h["WARC-Payload-Digest"][5:])
                    if h["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).digest() != digest):
                        raise ValueError(f"{name}: a payload differs from its digest")
                    number = lambda k: int(h[k]) if h.get(k) else None
                    out.append((number("WARC-Page-ID"), size, digest.hex(), h["WARC-Type"], number("WARC-Refers-To-Page-ID")))
                    if len(out) == 4096:
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)

    return dealt.mapInArrow(read, _READ)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def op3_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page, then read the archive back."""
    path = fresh_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path)


OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), q AS (
  SELECT page_id, html, octet_length(encode(html)) AS n, max(page_id) OVER (PARTITION BY html) AS keep FROM p
)
SELECT page_id,
       CAST(n AS BIGINT) AS payload_bytes,
       sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> keep THEN keep END AS refers_to
FROM q
"""
