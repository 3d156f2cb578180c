"""Running values along a session that stay distributed for a session of any size.

A plain window over one session puts the whole session into one task. Here a
session is cut into segments of ``SPAN`` positions: each segment is scanned by
itself and the (few) segment totals are scanned once more to give every
segment its starting value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SPAN = 1 << 16

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _merge(how: str, a: Column, b: Column) -> Column:
    if how == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return F.greatest(a, b) if how == "max" else F.least(a, b)


def running(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    outputs: dict[str, tuple],
    *,
    backward: bool = False,
    span: int | None = None,
) -> DataFrame:
    """Add running aggregates along ``position`` within ``keys``.

    ``outputs`` maps a name to ``(how, value)`` or ``(how, value, "before")``:
    ``how`` is sum, min or max, and "before" leaves the row itself out.
    ``backward`` runs from the last position to the first. Positions must be
    unique within ``keys`` and not NULL. Two branches read ``df``, so hand in
    something cheap to read: a table, or a staged one.
    """
    span = span or SPAN
    specs = {n: (spec[0], spec[1], len(spec) == 2) for n, spec in outputs.items()}
    cut = df.withColumns({**{f"__v_{n}": v for n, (_, v, _) in specs.items()}, "__seg": F.floor(F.col(position) / F.lit(span))})
    totals = cut.groupBy(*keys, "__seg").agg(*[_AGG[how](f"__v_{n}").alias(f"__t_{n}") for n, (how, _, _) in specs.items()])

    def ordering(c: str) -> Column:
        return F.col(c).desc() if backward else F.col(c).asc()

    before = Window.partitionBy(*keys).orderBy(ordering("__seg")).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *keys, "__seg", *[_AGG[how](f"__t_{n}").over(before).alias(f"__s_{n}") for n, (how, _, _) in specs.items()]
    )
    # Only segments after the first one carry anything over; for short groups
    # this side is empty.
    starts = starts.where(" or ".join(f"__s_{n} is not null" for n in specs))
    inside = Window.partitionBy(*keys, "__seg").orderBy(ordering(position))

    def frame(inclusive: bool) -> WindowSpec:
        return inside.rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)

    scanned = cut.join(starts, [*keys, "__seg"], "left").withColumns(
        {
            n: _merge(how, _AGG[how](f"__v_{n}").over(frame(inclusive)), F.col(f"__s_{n}"))
            for n, (how, _, inclusive) in specs.items()
        }
    )
    return scanned.select(*df.columns, *specs)
