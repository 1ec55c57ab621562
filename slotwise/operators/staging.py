"""Tables written to the shared scratch folder, to be computed once and to survive lost executors."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from slotwise.session import ensure_checkpoint_dir


def staged(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir`` and read back."""
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), f"slotwise-{name}-{uuid.uuid4().hex[:12]}")
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
