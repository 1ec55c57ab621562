"""Value-to-bucket functions over a literal boundary array."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bounds_array(bounds: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(b)).cast("long") for b in bounds])


def range_bucket(x: Column, bounds: Sequence[int]) -> Column:
    """Number of boundaries <= x; NULL for a NULL point.

    Matches ``range_bucket(point, boundaries)`` of the reference dialect for a
    sorted boundary array.
    """
    counted = F.size(F.filter(bounds_array(bounds), lambda b: b <= x))
    return F.when(x.isNotNull(), counted.cast("long"))


def sign_floor_bucket(x: Column, bounds: Sequence[int]) -> Column:
    """``sum(cast(sign(floor(x / b)) as int64))`` over the boundaries.

    Equals :func:`range_bucket` for x >= 0; a negative x scores -1 per
    boundary; a NULL x gives NULL.
    """
    return F.aggregate(
        bounds_array(bounds),
        F.lit(0).cast("long"),
        lambda acc, b: acc + F.signum(F.floor(x / b)).cast("long"),
    )


def bucket_label(index: Column, bounds: Sequence[int], overflow: str = "error") -> Column:
    """Boundary value at a 0-based bucket index.

    ``overflow="error"`` keeps the reference behaviour: an index past the last
    boundary raises (ANSI array index).  ``overflow="null"`` returns NULL.
    """
    arr = bounds_array(bounds)
    if overflow == "null":
        return F.get(arr, index)
    if overflow != "error":
        raise ValueError(f"overflow must be 'error' or 'null', got {overflow!r}")
    return F.when(index.isNotNull(), arr[index])
