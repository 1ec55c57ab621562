"""Per-pipeline parameters.

Each dataclass carries the same names and defaults as the reference's one-row
settings; values become literals in the plan (no settings join).  Every
wall-clock reference goes through ``as_of`` so a run is reproducible; ``None``
means "now", resolved once when the pipeline is built.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone


def resolve_as_of(as_of: datetime | None) -> datetime:
    if as_of is None:
        return datetime.now(timezone.utc)
    if as_of.tzinfo is None:
        return as_of.replace(tzinfo=timezone.utc)
    return as_of


# --- fixed values: default boundaries of the reference --------------------------
BYTES_PROCESSED_BOUNDS = (
    100000,
    500000,
    1000000,
    5000000,
    10000000,
    50000000,
    100000000,
    500000000,
    99999999999,
)
TOTAL_SLOT_MS_BOUNDS = (
    10000,
    50000,
    100000,
    500000,
    1000000,
    5000000,
    10000000,
    50000000,
    10000000000000,
)
# ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Window:
    """A creation-time range ``[as_of - lookback, as_of - lag]`` (both ends inclusive)."""

    as_of: datetime | None = None
    lookback: timedelta = timedelta(days=7)
    lag: timedelta = timedelta(0)

    def bounds(self) -> tuple[datetime, datetime]:
        now = resolve_as_of(self.as_of)
        return now - self.lookback, now - self.lag


@dataclass(frozen=True)
class SpillOrBytesSettings:  # P1
    window: Window = field(default_factory=lambda: Window(lookback=timedelta(hours=10)))
    maximum_bytes_billed: int = 10000
    bytes_spilled_to_disk: int = 10000000
    # The reference's DISTINCT; it only matters for repeated job rows, which a
    # count over row hashes finds when the report is built.
    distinct_rows: bool = True


@dataclass(frozen=True)
class SlotSampleSettings:  # P2
    window: Window = field(default_factory=lambda: Window(lookback=timedelta(days=7)))
    check_elapsed_ms: int = 60
    check_average_slot_usage: float = 10000
    check_total_slot_ms: int = 100000
    check_state: tuple[str, ...] = ("RUNNING",)
    # Echoed only; the report does not filter by them.
    search_maximum_bytes_processed: int = 1000
    search_maximum_waiting_ms: int = 10000
    check_bytes_spilled_to_disk: int = 10000
    echo_settings: bool = False


@dataclass(frozen=True)
class UtilizationSettings:  # P3
    window: Window = field(default_factory=lambda: Window(lookback=timedelta(days=7)))
    bucket_time: int = 600
    check_state: tuple[str, ...] = ("DONE",)
    project_id: str | None = None  # None: smallest table_catalog
    capacity_job_type: str = "QUERY"
    ctime: str = "reference"  # or "midpoint"


@dataclass(frozen=True)
class ResourceHogSettings:  # P4
    window: Window = field(default_factory=lambda: Window(lookback=timedelta(hours=2)))
    threshold_maximum_slot_ms: int = 100000000
    threshold_elapsed_ms: int = 100000
    threshold_average_slot_usage: float = 1000
    check_state: tuple[str, ...] = ("RUNNING",)


@dataclass(frozen=True)
class CalibrationSettings:  # P5
    window: Window = field(default_factory=lambda: Window(lookback=timedelta(days=60)))
    threshold_elapsed_ms: int = 1000
    band_ms: int = 3000
    check_state: tuple[str, ...] = ("DONE",)
    percentiles: tuple[float, ...] = (1.0, 0.99, 0.95)
    method: str = "exact"  # or "approx", "builtin"
    approx_accuracy: int = 100000


@dataclass(frozen=True)
class ElapsedByBytesSettings:  # P6, P6r
    window: Window = field(default_factory=lambda: Window(lookback=timedelta(days=7)))
    bytes_processed_bucket: tuple[int, ...] = BYTES_PROCESSED_BOUNDS
    check_state: tuple[str, ...] = ("DONE",)
    elapsed: str = "millisecond_field"  # or "total"
    overflow: str = "error"  # or "null"


@dataclass(frozen=True)
class MinuteUsageSettings:  # P7, P8
    as_of: datetime | None = None
    minutes: int = 60 * 24
    creation_lookback: timedelta = timedelta(hours=26)
    match: str = "reference"  # or "overlap"


@dataclass(frozen=True)
class IndicatorSettings:  # P9
    window: Window = field(default_factory=lambda: Window(lookback=timedelta(days=60)))
    bucket_time: int = 5
    total_slot_ms_bucket: tuple[int, ...] = TOTAL_SLOT_MS_BOUNDS
    check_state: tuple[str, ...] = ("DONE",)
    overflow: str = "error"


@dataclass(frozen=True)
class MonthlySettings:  # P10
    as_of: datetime | None = None
    search_pending_time: timedelta = timedelta(days=30)
    target_period: timedelta = timedelta(days=60)
    days_per_month: int = 30

    def bounds(self) -> tuple[datetime, datetime]:
        now = resolve_as_of(self.as_of)
        return (
            now - self.search_pending_time - self.target_period,
            now - self.search_pending_time,
        )


@dataclass(frozen=True)
class PredicateSettings:  # P11, P12, P14
    start_date: datetime | None = datetime(2022, 10, 17, tzinfo=timezone.utc)
    end_date: datetime | None = datetime(2022, 10, 20, tzinfo=timezone.utc)
    project_id: str | None = None
    trim_columns: bool = False


@dataclass(frozen=True)
class BucketSeriesSettings:  # P15
    window: Window = field(
        default_factory=lambda: Window(lookback=timedelta(days=31), lag=timedelta(days=1))
    )
    bucket_time: int = 60
    check_state: tuple[str, ...] = ("DONE",)
