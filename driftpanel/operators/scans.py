"""Prefix scans of long series in two phases, and exact quantiles by selection.

A running total or a last known value needs all rows before a row. One window over a series would make
it one task's work; here a series is cut into runs of positions, each run is scanned on its own, the
runs' totals - one row for each - are scanned, and what came before a run is added to its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.cache import kept

#: Positions of a run.
RUN = 1024


def _added(a: Column, b: Column) -> Column:
    """The sum of what is known of two."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def prefix(
    rows: DataFrame, keys: Sequence[str], *, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, before: bool = False, order: str = "time_idx", run: int = RUN,
) -> DataFrame:
    """``rows`` with running sums and last known values along ``order`` (a whole number) by ``keys``, up to each
    row, or (``before``) up to the row before it. Nulls add nothing and are no values; where nothing is known
    yet the result is NULL. ``rows`` is read twice: give it stored if it is costly.
    """
    sums, lasts = sums or {}, lasts or {}
    cut = rows.withColumns({"_run": F.floor(F.col(order) / run).cast("bigint")} | {f"_x_{n}": c for n, c in (sums | lasts).items()})
    own = W.partitionBy(*keys, "_run").orderBy(order).rowsBetween(W.unboundedPreceding, -1 if before else 0)
    local = cut.withColumns({n: F.sum(f"_x_{n}").over(own) for n in sums} | {n: F.last(f"_x_{n}", ignorenulls=True).over(own) for n in lasts}).drop(*[f"_x_{n}" for n in sums | lasts])
    totals = cut.groupBy(*keys, "_run").agg(
        *[F.sum(f"_x_{n}").alias(f"_x_{n}") for n in sums], *[F.max_by(f"_x_{n}", F.when(F.col(f"_x_{n}").isNotNull(), F.col(order))).alias(f"_x_{n}") for n in lasts],
    )
    earlier = W.partitionBy(*keys).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)  # over one row for each run
    carried = totals.select(
        *keys, "_run", *[F.sum(f"_x_{n}").over(earlier).alias(f"_c_{n}") for n in sums], *[F.last(f"_x_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in lasts],
    )
    both = local.join(carried, [*keys, "_run"])
    whole = {n: _added(F.col(f"_c_{n}"), F.col(n)) for n in sums} | {n: F.coalesce(n, f"_c_{n}") for n in lasts}
    return both.withColumns(whole).select(*rows.columns, *whole)


#: Bins of a pass over a group's values, values of a bin that are sorted as they are, and ranks that are broadcast.
BINS, FEW, SMALL = 1024, 4096, 100_000


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float], few: int = FEW, bins: int = BINS) -> DataFrame:
    """``keys`` and for each name of ``probabilities`` the exact quantile of ``value``, interpolated between the
    two nearest values; nulls are left out, a group without values has NULLs.

    By selection: a wanted rank lies in a part of its group's values, at first all of them. Each pass counts
    the part's values in ``bins`` of equal width and keeps the bin that holds the rank, until that has
    ``few`` values, or equal ones; only those are sorted. A pass is one aggregation with partial counts, so
    no task holds a group. ``rows`` is read in each pass: give it stored. The driver sees two numbers of a pass.
    """
    keys = list(keys)
    known = rows.select(*keys, F.col(value).cast("double").alias("_x")).filter("_x is not null")
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("q"), F.lit(float(p)).alias("p")) for n, p in probabilities.items()]))
    ends = known.groupBy(*keys).agg(F.count("*").alias("_m"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")).withColumn("_w", wanted)
    at = F.col("_w.p") * (F.col("_m") - 1)
    ranks = F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)).cast("array<bigint>")))
    # a row for each rank: the part that it is in, and how many values of the group lie below that
    parts = ends.select(*keys, F.col("_w.q").alias("_q"), (at - F.floor(at)).alias("_f"), ranks.alias("_rank"), F.lit(0).cast("bigint").alias("_below"), "_lo", "_hi", "_m")
    names, open_ = [*keys, "_q", "_f", "_rank"], (F.col("_m") > few) & (F.col("_lo") < F.col("_hi"))

    def stored(df: DataFrame) -> tuple[DataFrame, int, int]:
        ranks_ = kept(df)
        seen = ranks_.agg(F.count("*").alias("n"), F.coalesce(F.sum(open_.cast("bigint")), F.lit(0)).alias("more")).first()
        return ranks_, seen.n, seen.more

    def inside(part: DataFrame, n: int) -> DataFrame:
        part = F.broadcast(part) if n <= SMALL else part
        met = known.join(part, keys) if keys else known.join(part, F.col("_x") >= F.col("_lo"))
        return met.filter((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")))

    parts, n, more = stored(parts)
    while more:
        place = F.floor((F.col("_x") - F.col("_lo")) * (bins / (F.col("_hi") - F.col("_lo"))))
        counted = inside(parts.filter(open_), n).groupBy(*names, "_below", F.least(place, F.lit(bins - 1)).alias("_bin")).agg(F.count("*").alias("_m"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        below = F.sum("_m").over(W.partitionBy(*names).orderBy("_bin")) + F.col("_below") - F.col("_m")
        held = counted.withColumn("_below", below).filter((F.col("_rank") >= F.col("_below")) & (F.col("_rank") < F.col("_below") + F.col("_m")))
        parts, n, more = stored(parts.filter(~open_).unionByName(held.select(*parts.columns)))
    same = parts.filter("_lo = _hi").select(*names, F.col("_lo").alias("_v"))
    sorted_ = F.sort_array(F.collect_list("_x"))
    last = inside(parts.filter("_lo < _hi"), n).groupBy(*names, "_below").agg(sorted_.alias("_xs"))
    last = last.select(*names, F.get("_xs", (F.col("_rank") - F.col("_below")).cast("int")).alias("_v"))
    each = same.unionByName(last).groupBy(*keys, "_q", "_f").agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    found = each.groupBy(*keys).agg(*[F.max(F.when(F.col("_q") == q, F.col("_a") + F.col("_f") * (F.col("_b") - F.col("_a")))).alias(q) for q in probabilities])
    return rows.select(*keys).distinct().join(found, keys, "left") if keys else found
