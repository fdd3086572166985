"""Penalised change points of a seller's daily series: optimal partitioning with exact integer costs.

Rows become one sum for each key and day before anything else moves, so a key
with a third of all rows is no larger than any other: one number for each day
of the calendar.  A key's series is then cut by dynamic programming in
``applyInPandas``: the costs of all segments that end on a block of days come
from prefix sums of values and squares as one matrix, and every end day takes
its minimum over all starts at once.  A state is (cost, segments) in one
integer, and the earliest start wins, so ties need nothing more.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajecta.ship import ship

LEAST_DAYS = 7
PENALTY = 20_000
SCALE = 1000
#: Cells of one cost matrix: it bounds the memory of a long series.
CELLS = 1 << 19
COLUMNS = ("segment_no", "first_day", "n_days", "total", "spread", "cost", "n_segments", "best_cost")


def spreads(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    """1 + floor of the variance, from counts, sums and sums of squares, in whole numbers."""
    return 1 + (n * q - s * s) // (n * n)


def log_costs(n: np.ndarray, v: np.ndarray) -> np.ndarray:
    """n * floor(1000 * ln(v)); values that come close to a whole number are taken again by the C library's ln."""
    r = SCALE * np.log(v.astype(np.float64))
    out = np.floor(r).astype(np.int64)
    for at in zip(*np.nonzero((np.abs(r - np.rint(r)) < 1e-7) & (r > 0)), strict=True):
        out[at] = math.floor(SCALE * math.log(float(v[at])))
    return n * out


def prefix_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of values less their mean, and of their squares; as Python integers where 64 bits could overflow.

    A spread does not change when all values are shifted, and small values keep
    the products small.
    """
    y = [int(v) for v in x]
    mid = sum(y) // len(y)
    y = [v - mid for v in y]
    wide = len(y) * sum(v * v for v in y) >= 1 << 62
    y = np.array(y, dtype=object if wide else np.int64)
    zero = np.zeros(1, dtype=y.dtype)
    return np.concatenate([zero, np.cumsum(y)]), np.concatenate([zero, np.cumsum(y * y)])


def segments(x: np.ndarray, least: int = LEAST_DAYS, penalty: int = PENALTY) -> tuple[list[int], np.ndarray, np.ndarray, int]:
    """Starts, spreads and costs of the best segments, and their cost with penalties.

    The least cost, then the fewest segments, then the earliest starts from the
    last segment backwards.
    """
    n = len(x)
    s, q = prefix_sums(x)

    def cost_of(i, j):
        v = spreads(j - i, s[j] - s[i], q[j] - q[i])
        return v, log_costs(j - i, v)

    starts = [0]
    best = 0
    if n >= least:
        w = 1 << n.bit_length()  # more than any number of segments
        state = np.full(n + 1, np.iinfo(np.int64).max // 4, dtype=np.int64)
        state[0] = -penalty * w
        back = np.zeros(n + 1, dtype=np.int64)
        j = least
        while j <= n:
            to = min(n + 1, j + max(1, CELLS // n))
            i = np.arange(to - least)
            ends = np.arange(j, to)[:, None]
            m = np.maximum(ends - i, 1)
            at = np.minimum(i, ends - 1)
            cost = log_costs(m, spreads(m, s[ends] - s[at], q[ends] - q[at])) * w + penalty * w + 1
            for e in range(j, to):
                held = state[: e - least + 1] + cost[e - j, : e - least + 1]
                back[e] = k = int(held.argmin())
                state[e] = held[k]
            j = to
        best = int(state[n]) // w
        starts, e = [], n
        while e:
            e = int(back[e])
            starts.append(e)
        starts.reverse()
    i = np.array(starts)
    v, cost = cost_of(i, np.append(i[1:], n))
    return starts, v, cost, best if n >= least else int(cost[0])


def change_points(rows: DataFrame, key: str = "vendor_id", day: str = "shipped_at", value: str = "quantity", least: int = LEAST_DAYS, penalty: int = PENALTY) -> DataFrame:
    """One row for each segment of a key's daily sums: key, segment_no, first_day, n_days, total, spread, cost, n_segments, best_cost.

    ``value`` holds whole numbers; ``day`` is a date or a timestamp (one with a
    zone is read in the session's).  Rows with a null day or value are left out,
    a key without other rows gives no segment, and rows with a null key are one
    series of their own.  Repeated rows count as often as they stand there.
    Days without rows between a key's first and last count 0.  A series shorter
    than ``least`` is one segment.  An empty table gives no rows; other columns
    are not read.  The work grows with the square of a key's days, of which the
    calendar has 365 a year, and not with its rows.  A spread beyond 64 bits is
    given as the largest long; its cost is exact all the same.
    """
    import pandas as pd

    ship(rows.sparkSession)
    kind = rows.schema[key].dataType
    daily = rows.select(rows[key].alias("k"), F.unix_date(rows[day].cast("date")).alias("d"), rows[value].cast("long").alias("x")).where("d is not null and x is not null").groupBy("k", "d").agg(F.sum("x").alias("x"))
    schema = T.StructType([T.StructField(key, kind), *(T.StructField(c, T.IntegerType() if c == "segment_no" else T.LongType()) for c in COLUMNS)])

    def run(k, part):
        d, x = part["d"].to_numpy(np.int64), part["x"].to_numpy(np.int64)
        first = int(d.min())
        series = np.zeros(int(d.max()) - first + 1, dtype=np.int64)
        series[d - first] = x
        starts, v, cost, best = segments(series, least, penalty)
        sizes = np.diff([*starts, len(series)])
        out = {"segment_no": np.arange(1, len(starts) + 1, dtype=np.int32), "first_day": first + np.array(starts), "n_days": sizes, "total": np.add.reduceat(series, starts), "spread": np.minimum(v, np.iinfo(np.int64).max).astype(np.int64), "cost": cost, "n_segments": len(starts), "best_cost": best}
        return pd.DataFrame({key: pd.Series([k[0]] * len(starts), dtype=object), **out})

    return daily.groupBy("k").applyInPandas(run, schema)
