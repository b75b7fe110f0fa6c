"""Ranges of an order that stay the same however often, and on however many partitions, a plan is run."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WIDE = 8


def dealt(df: DataFrame, order: list[str], size: str | None = None, parts: int = 64) -> tuple[DataFrame, int]:
    """Adds ``_p``, the row's range in order, and ``_b``, the sum of ``size`` (else the count) of all ranges before it; and the whole sum.

    Rows of a lower range come first, equal ones share a range.

    Bounds and sums (one number a range) are read by two jobs and are literals of the plan: sizes of ranges and numbers
    in them agree, which ids of partitions do not where adaptive execution merges partitions of each branch in its own way.
    Any bounds give the same results; drawn ones give ranges of about equal size.
    """
    seen = df.select(*order).orderBy(F.rand(7)).limit(20 * parts).collect()
    seen = sorted((tuple(r) for r in seen), key=lambda r: [(v is not None, v != v, 0 if v is None or v != v else v) for v in r])
    bounds = list(dict.fromkeys(seen[len(seen) * i // parts] for i in range(1, parts))) if seen else []
    types = [df.schema[c].dataType for c in order]
    if len(order) == 1:
        bounds = [b for b in bounds if b[0] is not None]  # a missing value reaches no bound: it comes first
    named = lambda values: F.struct(*[v.alias(f"k{i}") for i, v in enumerate(values)]) if len(values) > 1 else values[0]
    none = named([F.lit(None).cast(t) for t in types])
    key = named([F.col(c) for c in order])
    known = lambda rows: F.array(*[named([F.lit(v).cast(t) for v, t in zip(r, types, strict=True)]) for r in rows]) if rows else F.slice(F.array(none), 1, 0)
    reached = lambda bs: F.size(F.filter(bs, lambda b: b <= key))
    # Two levels of bounds: every 8th, then those between.
    top: Column = reached(known(bounds[_WIDE - 1 :: _WIDE]))
    rest = F.array(*[known(bounds[_WIDE * i : _WIDE * i + _WIDE - 1]) for i in range(math.ceil((len(bounds) + 1) / _WIDE))])
    out = df.withColumn("_p", top * _WIDE + reached(F.get(rest, top)))
    sums = out.groupBy("_p").agg((F.coalesce(F.sum(size), F.lit(0)) if size else F.count("*")).alias("_n"))
    kind = sums.schema["_n"].dataType
    sizes, before, total = dict(map(tuple, sums.collect())), [], 0
    for i in range(max(sizes, default=0) + 1):
        before.append(total)
        total += sizes.get(i, 0)
    return out.withColumn("_b", F.get(F.array(*[F.lit(n).cast(kind) for n in before]), F.col("_p"))), total
