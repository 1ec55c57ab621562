"""WARC files: round trip, revisits, determinism, and bytes read by a plain reader."""

import gzip
import hashlib
import os
import uuid
from collections import Counter, defaultdict

import cases
import pytest
from pyspark.sql import functions as F
from slotwise.llm import warc
from slotwise.llm.common import scratch_dir


@pytest.fixture(scope="module")
def pages(spark):
    body = "<p>" + "é text " * 300
    rows = [(i, f"{body}{i % 7}") for i in range(60)] + [(100 + i, "short") for i in range(5)]
    rows += [(200, None), (201, ""), (3, f"{body}3"), (None, f"{body}2"), (None, "lonely " * 300), (None, None), (300, "x" * 200_000), (59, f"{body}{59 % 7}")]
    df = cases.table(spark, rows, "page_id", "html")
    url = F.when(F.col("page_id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("http://h/\n?p="), F.col("page_id").cast("string")))
    return df.withColumn("url", url).drop("kept")


def expected(rows):
    ids = defaultdict(list)
    for r in rows:
        ids[r["html"] or ""].append(r["page_id"])
    out = Counter()
    for r in rows:
        payload = (r["html"] or "").encode()
        top = max((i for i in ids[r["html"] or ""] if i is not None), default=None)
        again = len(payload) >= 1000 and top is not None and r["page_id"] != top
        out[(r["page_id"], len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", top if again else None)] += 1
    return out


def write(spark, pages, **kwargs):
    base = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    return base, warc.write_warc(pages, base, **kwargs)


def test_round_trip_and_determinism(spark, pages):
    found = []
    for parts in (1, 5):
        base, manifest = write(spark, pages.repartition(parts), shard_bytes=60_000, roll_bytes=2000)
        read = warc.read_warc(spark, base)
        assert Counter(tuple(r) for r in read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == expected(pages.collect())
        found.append(sorted(map(tuple, manifest.select("file", "records", "bytes", "sha256", "first_id", "last_id").collect())))
        assert not os.listdir(f"{base}/temporary")
    assert found[0] == found[1] and len(found[0]) > 4
    assert all(a[5] is None or b[4] is None or a[5] <= b[4] for a, b in zip(found[0], found[0][1:], strict=False))


def test_files_are_plain_warc(spark, pages):
    base, manifest = write(spark, pages)
    for row in manifest.collect():
        raw = open(f"{base.removeprefix('file://')}/{row['file']}", "rb").read()
        assert hashlib.sha256(raw).hexdigest() == row["sha256"] and len(raw) == row["bytes"]
        data = gzip.decompress(raw)
        assert data.count(b"WARC/1.1\r\n") == row["records"] + 1 and b"WARC-Type: warcinfo" in data[:200]
        assert b"http://h/%0A?p=" in data


def test_commit_can_be_repeated(spark, pages):
    base, manifest = write(spark, pages)
    attempts = manifest.withColumn("temporary", F.lit("temporary/gone")).select(*(c.split()[0] for c in warc.MANIFEST.split(", ")))
    again = warc._commit(spark.createDataFrame(attempts.collect(), warc.MANIFEST), base)
    assert again.count() > 0
    lost = spark.createDataFrame([("none.warc.gz", "temporary/none", 1, 1, "", 1, 1)], warc.MANIFEST)
    with pytest.raises(Exception, match="FileNotFoundError"):
        warc._commit(lost, base)


def test_damage_is_found(spark, pages):
    base, manifest = write(spark, pages)
    path = f"{base.removeprefix('file://')}/{manifest.first()['file']}"
    raw = gzip.decompress(open(path, "rb").read())
    with open(path, "wb") as f:
        f.write(gzip.compress(raw.replace(b"text", b"tent", 1)))
    for name in os.listdir(os.path.dirname(path)):
        if name.endswith(".crc"):
            raise AssertionError(name)
    with pytest.raises(Exception, match="broken record"):
        warc.read_warc(spark, base).collect()


def test_empty_table(spark, pages):
    base, manifest = write(spark, pages.limit(0))
    assert manifest.count() == 0 and warc.read_warc(spark, base).count() == 0


def test_reading_has_a_task_for_every_shard(spark, pages):
    base, manifest = write(spark, pages, shard_bytes=20_000, roll_bytes=2000)
    shards = {r["file"].split("-")[1] for r in manifest.collect()}
    read = warc.read_warc(spark, base)
    tasks = read.select(F.spark_partition_id().alias("part"), "file").distinct().collect()
    assert len(shards) > 4 and len({r["part"] for r in tasks}) >= min(len(shards), spark.sparkContext.defaultParallelism)


def test_a_page_id_with_many_rows_is_spread(spark):
    rows = [(7, f"page {i} " * 200) for i in range(80)] + [(None, f"none {i} " * 200) for i in range(40)] + [(i, "x") for i in range(20)]
    df = cases.table(spark, rows, "page_id", "html").withColumn("url", F.lit("http://h/"))
    base, manifest = write(spark, df, shard_bytes=20_000)
    assert manifest.filter("first_id = 7 and last_id = 7").count() >= 3
    read = warc.read_warc(spark, base)
    assert Counter(tuple(r) for r in read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == expected(df.collect())


def test_shards_of_pairs():
    import numpy as np

    cuts = [(3, "b"), (3, "d"), (5, "a")]
    ids, digests = np.array([1, 3, 3, 3, 4, 5, 5, 9]), np.array(["z", "a", "b", "x", "q", "Z", "a", "a"], object)
    assert warc._shard_of(cuts, ids, digests).tolist() == [0, 0, 1, 2, 2, 2, 3, 3]
