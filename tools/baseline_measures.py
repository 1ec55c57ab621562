"""

Usage: python tools/baseline_measures.py [sf_dir] [cpus]

Derives the job history once, then runs each form once untimed and once timed
through the ``noop`` sink.  Bytes come from Spark's event log, written to the
scratch folder.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from literal_forms import usage_by_minute_theta  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from slotwise.operators import grid as G  # noqa: E402
from slotwise.plans import reports as P  # noqa: E402
from slotwise.plans.registry import SETTINGS  # noqa: E402
from slotwise.session import build_session, ensure_checkpoint_dir  # noqa: E402
from slotwise.sources.fixture import AS_OF, derive_catalog, load_fixture  # noqa: E402
from slotwise.sources.jobs import read_jobs  # noqa: E402

MINUTES = 1440


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    cpus = int(sys.argv[2]) if len(sys.argv) > 2 else 8
    logs = os.path.join(os.environ.get("TMPDIR", "/tmp"), f"slotwise-events-{uuid.uuid4().hex[:8]}")
    os.makedirs(logs)
    conf = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{logs}", "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"}
    spark = build_session(f"local[{cpus}]", "slotwise-measures", 16, conf)
    path = os.path.join(ensure_checkpoint_dir(spark), f"jobs-{uuid.uuid4().hex[:8]}")
    load_fixture(spark, sf_dir).jobs.write.parquet(path)
    jobs = read_jobs(spark, path)
    cat = derive_catalog(spark.read.parquet(os.path.join(sf_dir, "region.parquet")))
    rows = P._elapsed_by_bytes_rows(jobs, SETTINGS["elapsed_by_bytes_bucket"])
    ranks = (0.0, 0.25, 0.5, 0.75, 1.0)

    def utilization(method: str):  # noqa: ANN202
        return P.slot_utilization(jobs, cat.assignments, cat.reservations, cat.tables, SETTINGS["slot_utilization"], method=method)

    forms = {
        "P3 array lag": lambda: utilization("array"),
        "P3 window lag": lambda: utilization("window"),
        f"P7 equi-join, {MINUTES} minutes": lambda: G.usage_by_minute(spark, jobs, AS_OF, MINUTES),
        f"P7 range join, {MINUTES} minutes": lambda: usage_by_minute_theta(spark, jobs, AS_OF, MINUTES),
        "P6 grouped percentile": lambda: P.elapsed_by_bytes_bucket(jobs, SETTINGS["elapsed_by_bytes_bucket"]),
        "P6 window percentile": lambda: rows.select(
            "bucket_index", *[F.expr(f"percentile(elapsed_time, {p}) OVER (PARTITION BY bucket_index)").alias(f"p{i}") for i, p in enumerate(ranks)]
        ).distinct(),
    }
    seconds = {}
    for name, build in forms.items():
        for turn in (0, 1):
            spark.sparkContext.setJobGroup(f"{name}|{turn}", name)
            began = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            seconds[name] = time.perf_counter() - began
    spark.stop()

    group_of, moved = {}, {}
    for file in os.listdir(logs):
        for line in open(os.path.join(logs, file)):
            event = json.loads(line)
            if event["Event"] == "SparkListenerJobStart":
                for stage in event["Stage IDs"]:
                    group_of[stage] = event["Properties"].get("spark.jobGroup.id", "")
            elif event["Event"] == "SparkListenerTaskEnd":
                name, _, turn = group_of.get(event["Stage ID"], "").partition("|")
                if turn == "1":
                    written = (event.get("Task Metrics") or {}).get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
                    moved[name] = moved.get(name, 0) + written
    for name in forms:
        print(f"| {name} | {seconds[name]:.2f} | {moved.get(name, 0) / 1e6:.2f} |")


if __name__ == "__main__":
    main()
