"""Ordered windows whose partition may be large.

A window partitioned by a document, a source or nothing puts all rows of that key into one task. The functions here work
in two levels: rows are windowed inside (key, chunk), one summary row per chunk is windowed inside the key, and the two
are joined. `chunk` must be a function of the order (a page number, `ord div 4096`, an hour), so that ordering by chunk
and then by `order` is the order wanted. A hot key is thereby spread over its chunks, and the single-task part only sees
one row per chunk. Chunk values come from the data, never from partition ids, so a recomputed task gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Names = Sequence[str]


def _ordering(order: Names) -> Column:
    return F.struct(*[F.col(name) for name in order])


def running(
    df: DataFrame,
    keys: Names,
    chunk: Names,
    order: Names,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
) -> DataFrame:
    """Adds inclusive running sums, maxima and last non-null values of each key in order."""
    sums, maxes, lasts = sums or {}, maxes or {}, lasts or {}
    inside = Window.partitionBy(*keys, *chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    rank = _ordering(order)

    heads = df.groupBy(*keys, *chunk).agg(
        *[F.sum(e).alias(f"__h_{n}") for n, e in sums.items()],
        *[F.max(e).alias(f"__h_{n}") for n, e in maxes.items()],
        *[F.max_by(e, F.when(e.isNotNull(), rank)).alias(f"__h_{n}") for n, e in lasts.items()],
    )
    carries = heads.select(
        *keys,
        *chunk,
        *[F.sum(f"__h_{n}").over(before).alias(f"__c_{n}") for n in sums],
        *[F.max(f"__h_{n}").over(before).alias(f"__c_{n}") for n in maxes],
        *[F.last(f"__h_{n}", ignorenulls=True).over(before).alias(f"__c_{n}") for n in lasts],
    )
    local = df.withColumns(
        {
            **{f"__l_{n}": F.sum(e).over(inside) for n, e in sums.items()},
            **{f"__l_{n}": F.max(e).over(inside) for n, e in maxes.items()},
            **{f"__l_{n}": F.last(e, ignorenulls=True).over(inside) for n, e in lasts.items()},
        }
    )
    joined = local.join(carries, [*keys, *chunk])
    zero = F.lit(0)
    return joined.withColumns(
        {
            **{n: F.coalesce(F.col(f"__l_{n}"), zero) + F.coalesce(F.col(f"__c_{n}"), zero) for n in sums},
            **{n: F.greatest(f"__l_{n}", f"__c_{n}") for n in maxes},
            **{n: F.coalesce(f"__l_{n}", f"__c_{n}") for n in lasts},
        }
    ).select(*df.columns, *sums, *maxes, *lasts)


def numbered(df: DataFrame, keys: Names, chunk: Names, order: Names, out: str) -> DataFrame:
    """Adds the 1-based position of each row inside its key."""
    return running(df, keys, chunk, order, sums={out: F.lit(1).cast("long")})


def neighbours(
    df: DataFrame,
    keys: Names,
    chunk: Names,
    order: Names,
    lag: dict[str, Column] | None = None,
    lead: dict[str, Column] | None = None,
) -> DataFrame:
    """Adds values of the previous (lag) and next (lead) row of each key in order."""
    lag, lead = lag or {}, lead or {}
    inside = Window.partitionBy(*keys, *chunk).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(*chunk)
    rank = _ordering(order)
    back = F.struct(*[e.alias(n) for n, e in lag.items()]) if lag else None
    front = F.struct(*[e.alias(n) for n, e in lead.items()]) if lead else None

    aggs = []
    if lag:
        aggs.append(F.max_by(back, rank).alias("__last"))
    if lead:
        aggs.append(F.min_by(front, rank).alias("__first"))
    heads = df.groupBy(*keys, *chunk).agg(*aggs)
    edges = [*keys, *chunk]
    if lag:
        heads = heads.withColumn("__prev", F.lag("__last").over(across))
        edges.append("__prev")
    if lead:
        heads = heads.withColumn("__next", F.lead("__first").over(across))
        edges.append("__next")

    local = {}
    if lag:
        local |= {"__lag": F.lag(back).over(inside), "__no": F.row_number().over(inside)}
    if lead:
        local |= {"__lead": F.lead(front).over(inside), "__one": F.lead(F.lit(1)).over(inside)}
    joined = df.withColumns(local).join(heads.select(*edges), [*keys, *chunk])
    out = {}
    if lag:
        pick = F.when(F.col("__no") == 1, F.col("__prev")).otherwise(F.col("__lag"))
        joined = joined.withColumn("__lag", pick)
        out |= {name: F.col("__lag")[name] for name in lag}
    if lead:
        pick = F.when(F.col("__one").isNull(), F.col("__next")).otherwise(F.col("__lead"))
        joined = joined.withColumn("__lead", pick)
        out |= {name: F.col("__lead")[name] for name in lead}
    return joined.withColumns(out).select(*df.columns, *lag, *lead)


def islands(df: DataFrame, keys: Names, chunk: Names, order: Names, starts: Column, out: str) -> DataFrame:
    """Numbers the runs of rows that begin where `starts` holds (a null counts as no start)."""
    return running(df, keys, chunk, order, sums={out: F.coalesce(starts.cast("long"), F.lit(0))})
