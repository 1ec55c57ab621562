"""Deterministic sharded WARC writer and its reader.

1. SHA-1 digests of all payloads are grouped; of equal payloads of at least
   ``revisit_bytes`` the row with the largest page id keeps the payload, the others become revisits.
2. Records are range-sorted by page id and digest.  The cut points come from a sample of the
   distinct pairs and their bytes that depends on the pairs alone (a hash, about ``SAMPLE`` of
   them), and the number of shards from the payload bytes, so shards do not depend on
   partitions or on the cluster, and a page id with very many rows is spread over shards.
3. A task writes a shard's records in order, each as a gzip member with headers and
   digests made anew, and rolls to the next file beyond ``roll_bytes`` compressed
   bytes.  Files get temporary names of their own for every attempt; the manifest, a
   table that Spark commits, names those of the attempts that count.
4. A second job renames the files of that manifest and writes the final manifest;
   readers open only files that it lists.  Both steps can be run again after a failure.
5. Reading deals the files to as many tasks as their bytes ask for, by shard.

Same rows, same bytes: nothing in a file depends on time or on the attempt.

Edge cases: a null payload is empty; a null url has no target header; line breaks
in a url are percent-encoded; rows with a null page id come first, and revisit the
largest id of their group if there is one; rows that repeat the largest id of a
group are all responses; an empty table gives an empty manifest and no records.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm.common import prepare, skew_join, stage_table

#: Page ids that the cut points are chosen from.
SAMPLE = 8192
#: Payload bytes of a shard, which is one task, and compressed bytes after which a file is closed.
SHARD_BYTES = 64 << 20
ROLL_BYTES = 16 << 20
REVISIT_BYTES = 1000
#: Compressed bytes that a task reads back at least, once every core has work.
READ_BYTES = 32 << 20
#: Stands for a missing page id, so that it sorts first.
NO_PAGE = -(1 << 63)
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

MANIFEST = "file string, temporary string, records long, bytes long, sha256 string, first_id long, last_id long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def _record_id(page_id: int | None, digest: str, turn: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}/{turn}')}>"


def _base32(hexdigest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexdigest)).decode()


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member with a whole record."""
    lines = [*headers, ("WARC-Block-Digest", _base32(hashlib.sha1(block).hexdigest())), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, turn: int, refers_to: int | None) -> bytes:
    """The response or revisit record of a page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(page_id, digest, turn)), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if page_id is not None:
        headers.append(("Page-ID", str(page_id)))
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest, 0)), ("Refers-To-Page-ID", str(refers_to))]
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", _base32(digest))]
    return _record(headers, http if refers_to is not None else http + payload)


class _Files:
    """The files of the shards of one task: temporary names, rolled by compressed size."""

    def __init__(self, base: str, roll_bytes: int) -> None:
        self.base, self.roll_bytes = base, roll_bytes
        self.fs, self.path = _open(base)
        self.shard, self.turn, self.out, self.row = None, 0, None, {}
        self.fs.create_dir(f"{self.path}/temporary", recursive=True)

    def add(self, shard: int, page_id: int | None, record: bytes) -> Iterator[dict]:
        if self.out is not None and (shard != self.shard or self.out.tell() >= self.roll_bytes):
            yield self.close()
        if self.out is None:
            self.turn = self.turn + 1 if shard == self.shard else 0
            self.shard = shard
            name = f"part-{shard:06d}-{self.turn:05d}.warc.gz"
            self.row = {"file": name, "temporary": f"temporary/{name}.{uuid.uuid4().hex}", "records": 0, "first_id": page_id}
            self.out, self.sha = self.fs.open_output_stream(f"{self.path}/{self.row['temporary']}", compression=None), hashlib.sha256()
            info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None, name, 0)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
            self._write(_record(info, b"software: slotwise\r\nformat: WARC File Format 1.1\r\n"))
        self._write(record)
        self.row["records"] += 1
        self.row["last_id"] = page_id

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)

    def close(self) -> dict:
        self.row |= {"bytes": self.out.tell(), "sha256": self.sha.hexdigest()}
        self.out.close()
        self.out = None
        return self.row


def _shards(rows: DataFrame, total_bytes: int, shard_bytes: int) -> list[tuple[int, str]]:
    """Cut points between (page id, digest) pairs, of about equal payload bytes: shard i begins at cut i - 1."""
    shards = max(1, -(-total_bytes // shard_bytes))
    pairs = rows.groupBy(F.coalesce("page_id", F.lit(NO_PAGE)).alias("page_id"), "digest").agg(F.sum("size").alias("size"))
    step = max(1, -(-pairs.count() // SAMPLE))
    sample = [tuple(r) for r in pairs.filter(F.pmod(F.xxhash64("page_id", "digest"), F.lit(step)) == 0).collect()]
    sample.sort()
    ends = np.cumsum([size for *_, size in sample], dtype=np.int64)
    at = np.searchsorted(ends, [int(ends[-1]) * i // shards for i in range(1, shards)], "left") if sample else []
    return sorted({sample[min(i + 1, len(sample) - 1)][:2] for i in at})


def _shard_of(cuts: list[tuple[int, str]], ids: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Shard of each pair; only pairs whose id is that of a cut look at the digest."""
    heads = np.array([page for page, _ in cuts], np.int64)
    low, out = np.searchsorted(heads, ids, "left"), np.searchsorted(heads, ids, "right")
    for row in np.flatnonzero(low < out):
        out[row] = low[row] + bisect.bisect_right(cuts[low[row] : out[row]], (int(ids[row]), digests[row]))
    return out.astype(np.int32)


def write_warc(
    pages: DataFrame, base: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, revisit_bytes: int = REVISIT_BYTES,
) -> DataFrame:
    """Write ``pages`` as archives below the folder ``base`` and return the manifest, one row per file."""
    spark = pages.sparkSession
    prepare(spark)
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    slim = stage_table(rows.select("page_id", "digest", F.octet_length("html").cast("long").alias("size")), "digests")
    (total,) = slim.agg(F.sum("size")).first()
    cuts = _shards(slim, total or 0, shard_bytes)

    large = slim.filter(F.col("size") >= revisit_bytes)
    keepers = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("times"))
    keepers = keepers.filter("times > 1 and refers_to is not null").select("digest", "refers_to")
    marks = skew_join(large, keepers, ["digest"]).filter("not (page_id <=> refers_to)").select("page_id", "digest", "refers_to").distinct()

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series, digests: pd.Series) -> pd.Series:
        return pd.Series(_shard_of(cuts, ids.to_numpy(np.int64), digests.to_numpy()))

    # A mark stands right before the rows that it turns into revisits.
    no_text, no_id = F.lit(None).cast("string"), F.lit(None).cast("long")
    both = rows.select("page_id", "digest", F.lit(1).alias("kind"), no_id.alias("refers_to"), "url", "html").unionByName(
        marks.select("page_id", "digest", F.lit(0).alias("kind"), "refers_to", no_text.alias("url"), no_text.alias("html"))
    )
    both = both.withColumn("shard", shard_of(F.coalesce("page_id", F.lit(NO_PAGE)), "digest")).repartitionById(len(cuts) + 1, F.col("shard"))
    both = both.sortWithinPartitions("shard", "page_id", "digest", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, done, mark, last, turn = None, [], (None, None, None), None, 0
        for batch in batches:
            files = files or _Files(base, roll_bytes)
            shard, page, digest, kind, refers, url, html = (batch.column(c).to_pylist() for c in ("shard", "page_id", "digest", "kind", "refers_to", "url", "html"))
            for i in range(batch.num_rows):
                if kind[i] == 0:
                    mark = (page[i], digest[i], refers[i])
                    continue
                turn = turn + 1 if last == (page[i], digest[i]) else 0
                last = (page[i], digest[i])
                refers_to = mark[2] if mark[:2] == last else None
                record = page_record(page[i], url[i], html[i].encode(), digest[i], turn, refers_to)
                done += files.add(shard[i], page[i], record)
        if files is not None and files.out is not None:
            done.append(files.close())
        names = [c.split()[0] for c in MANIFEST.split(", ")]
        if done:
            yield pa.RecordBatch.from_pylist(
                [{n: row.get(n) for n in names} for row in done], pa.schema([(n, pa.int64() if n in ("records", "bytes", "first_id", "last_id") else pa.string()) for n in names])
            )

    attempts = stage_table(both.mapInArrow(run, MANIFEST), "warc-attempts")
    return _commit(attempts, base)


def _commit(attempts: DataFrame, base: str) -> DataFrame:
    """Give the manifest's files their final names, then write the final manifest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, path = _open(base)
        for pdf in batches:
            for old, new in zip(pdf["temporary"], pdf["file"], strict=True):
                if where.get_file_info(f"{path}/{old}").type != fs.FileType.NotFound:
                    where.move(f"{path}/{old}", f"{path}/{new}")
                elif where.get_file_info(f"{path}/{new}").type == fs.FileType.NotFound:
                    raise FileNotFoundError(f"{path}/{old}")
            yield pdf

    attempts.mapInPandas(run, MANIFEST).drop("temporary").write.mode("overwrite").parquet(f"{base}/manifest")
    return attempts.sparkSession.read.parquet(f"{base}/manifest")


def _records(stream, name: str) -> Iterator[tuple]:  # noqa: ANN001
    """(page id, url, payload bytes, payload digest, type, page referred to, file) of an unpacked archive's page records."""
    with io.BufferedReader(stream) as f:
        while line := f.readline():
            if line.strip() != b"WARC/1.1":
                raise ValueError(f"{name}: no record at {line[:40]!r}")
            headers = {}
            while (line := f.readline().rstrip(b"\r\n")):
                key, _, value = line.partition(b": ")
                headers[key.decode()] = value.decode()
            block = f.read(int(headers["Content-Length"]))
            if f.read(4) != b"\r\n\r\n" or _base32(hashlib.sha1(block).hexdigest()) != headers["WARC-Block-Digest"]:
                raise ValueError(f"{name}: broken record {headers.get('WARC-Record-ID')}")
            kind = headers["WARC-Type"]
            if kind not in ("response", "revisit"):
                continue
            http, _, payload = block.partition(b"\r\n\r\n")
            size = int(http.rpartition(b"Content-Length: ")[2])
            digest = base64.b32decode(headers["WARC-Payload-Digest"].partition(":")[2]).hex()
            if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                raise ValueError(f"{name}: payload of {headers.get('WARC-Record-ID')} does not match its digest")
            page, refers = headers.get("Page-ID"), headers.get("Refers-To-Page-ID")
            yield page and int(page), headers.get("WARC-Target-URI"), size, digest, kind, refers and int(refers), name


def read_warc(spark: SparkSession, base: str) -> DataFrame:
    """The page records of the archives that the manifest below ``base`` lists; digests are checked."""
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in RECORDS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _open(base)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with where.open_input_stream(f"{path}/{name}", compression="gzip") as stream:
                    rows = []
                    for record in _records(stream, name):
                        rows.append(record)
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], kinds)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], kinds)

    manifest = spark.read.schema(MANIFEST).parquet(f"{base}/manifest")
    shard = F.regexp_extract("file", r"^part-(\d+)-", 1).cast("int")
    shards, size = manifest.agg(F.max(shard), F.sum("bytes")).first()
    parts = min((shards or 0) + 1, max(spark.sparkContext.defaultParallelism, -(-(size or 0) // READ_BYTES)))
    # The number is given, so adaptive execution does not merge the few bytes of file names into one task.
    return manifest.select("file", F.pmod(shard, F.lit(parts)).alias("part")).repartitionById(parts, F.col("part")).select("file").mapInArrow(run, RECORDS)
