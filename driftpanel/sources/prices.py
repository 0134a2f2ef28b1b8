"""Price panels: long tables of time, series, price."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cache import Store

#: Series that a panel can be built on, by the table that names them.
SERIES = ("type", "brand", "flag", "status", "region", "priority", "event")


@dataclass(frozen=True)
class Universe:
    assets: tuple[str, ...]
    sectors: dict[str, str]
    market: tuple[str, ...]


#: The default universe of assets, their sector funds and the market's sector funds.
DEFAULT_UNIVERSE = Universe(
    assets=("AAPL", "MSFT", "NVDA", "META", "JPM", "CAT", "XOM", "JNJ", "PG", "KO", "AMT"),
    sectors={"AAPL": "XLK", "MSFT": "XLK", "NVDA": "XLK", "META": "XLK", "JPM": "XLF", "CAT": "XLI", "XOM": "XLE", "JNJ": "XLV", "PG": "XLP", "KO": "XLP", "AMT": "XLRE"},
    market=("XLB", "XLE", "XLF", "XLI", "XLK", "XLP", "XLU", "XLV", "XLY", "XLRE"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def period(col: str, frequency: str) -> Column:
    """The date, or the Monday or first day of its week or month."""
    day = F.col(col).cast("date")
    return {"day": day, "week": F.trunc(day, "week"), "month": F.trunc(day, "month")}[frequency]


def derived_prices(spark: SparkSession, sf_dir: str, by: str, frequency: str = "week") -> DataFrame:
    """Volume-weighted average prices of line items by time and series; mean values of events by
    type; mean order totals by priority."""
    if by == "event":
        return table(spark, sf_dir, "events").groupBy(period("ts", frequency).alias("time"), F.col("event_type").alias("series")).agg(F.avg("value").alias("price"))
    if by == "priority":
        return table(spark, sf_dir, "orders").groupBy(period("o_orderdate", frequency).alias("time"), F.col("o_orderpriority").alias("series")).agg(F.avg("o_totalprice").alias("price"))
    return item_prices(spark, sf_dir, [by], frequency).select("time", "series", "price")


#: Where the name of a line item's series stands.
ITEM_KEYS = {"type": "p_type", "brand": "p_brand", "flag": "l_returnflag", "status": "l_linestatus", "region": "r_name"}


def item_prices(spark: SparkSession, sf_dir: str, by: Sequence[str], frequency: str = "week") -> DataFrame:
    """by, time, series, price: volume-weighted average prices of line items for several keys at once.

    One scan of the items serves all keys: their grouping sets are partly aggregated before anything
    is shuffled. Items without a time or a key's name have no price there.
    """
    keys = list(dict.fromkeys(by))
    if unknown := [k for k in keys if k not in ITEM_KEYS]:
        raise ValueError(f"unknown series {unknown[0]!r}; one of {SERIES}")
    items = table(spark, sf_dir, "lineitem")
    if {"type", "brand"} & {*keys}:
        items = items.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    if "region" in keys:
        places = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        items = items.join(places, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    names = [f"k{i}" for i in range(len(keys))]
    rows = items.select(period("l_shipdate", frequency).alias("time"), *[F.col(ITEM_KEYS[k]).alias(n) for k, n in zip(keys, names)], "l_extendedprice", "l_quantity")
    rows = rows.filter(F.col("time").isNotNull())
    sums = [F.sum("l_extendedprice").alias("value"), F.sum("l_quantity").alias("quantity")]
    if len(keys) == 1:
        volume = rows.groupBy("time", F.col("k0").alias("series")).agg(*sums).withColumn("by", F.lit(keys[0]))
    else:
        own = F.coalesce(*[F.when(F.grouping(n) == 0, F.lit(k)) for k, n in zip(keys, names)])
        volume = rows.groupingSets([["time", n] for n in names], "time", *names).agg(*sums, own.alias("by")).withColumn("series", F.coalesce(*names))
    return volume.filter(F.col("series").isNotNull()).select("by", "time", "series", F.try_divide("value", "quantity").alias("price"))


def read_prices(spark: SparkSession, path: str, series: Sequence[str] | None = None, start: str | None = None, end: str | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """A stored panel of time, series, price; filters reach the scan."""
    rows = spark.read.format(fmt).options(**options).load(path).select(F.col("time").cast("date").alias("time"), F.col("series").cast("string").alias("series"), F.col("price").cast("double").alias("price"))
    return between(rows, series, start, end)


def between(rows: DataFrame, series: Sequence[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The named series from ``start`` to ``end``, both included; what is None is not bounded."""
    if series is not None:
        rows = rows.filter(F.col("series").isin(list(series)))
    if start is not None:
        rows = rows.filter(F.col("time") >= F.lit(start).cast("date"))
    return rows if end is None else rows.filter(F.col("time") <= F.lit(end).cast("date"))


#: How a frequency is called in the metadata of a panel.
FREQUENCIES = {"day": "daily", "week": "weekly", "month": "monthly"}


def load_prices(
    spark: SparkSession, sf_dir: str, by: str, *, kind: str = "asset", frequency: str = "week", series: Sequence[str] | None = None, start: str | None = None, end: str | None = None, store: Store | None = None,
) -> DataFrame:
    """time, series, kind, price of derived prices, with their origin as the price column's metadata.

    With a ``store`` the panel of all series and times is kept once, in files that are cut and sorted by
    series and time, and each call reads of it what it asks for: the filters reach the scan, whose
    statistics leave out the other files and row groups."""
    if kind not in ("asset", "factor"):
        raise ValueError("kind must be 'asset' or 'factor'")

    def make() -> DataFrame:
        return derived_prices(spark, sf_dir, by, frequency).select("time", "series", F.lit(kind).alias("kind"), "price")

    def sorted_() -> DataFrame:
        return make().repartitionByRange("series", "time").sortWithinPartitions("series", "time")

    settings = {"from": sf_dir, "by": by, "frequency": frequency}
    rows = between(make() if store is None else store.fetch(Store.name(f"{kind}-prices", settings), sorted_, settings), series, start, end)
    origin = {"by": by, "frequency": FREQUENCIES[frequency], "kind": kind, "value": "mean" if by in ("event", "priority") else "volume-weighted average"}
    return rows.select("time", "series", "kind", F.col("price").alias("price", metadata=origin))


def to_long(data: DataFrame, value: str = "ret") -> DataFrame:
    """time, series and ``value`` of a long or a wide frame, in time order; an empty one fails, and so
    does one without time."""
    if "time" not in data.columns:
        raise ValueError("no time column")
    label = next((c for c in ("series", "asset", "factor") if c in data.columns), None)
    long = data.select("time", F.col(label).alias("series"), value) if label and value in data.columns else from_wide(data, value=value)
    if long.isEmpty():
        raise ValueError("the frame is empty")
    return long.orderBy("time", "series")


def from_wide(df: DataFrame, time: str = "time", value: str = "price") -> DataFrame:
    """A wide frame (one column for each series) as a long one; missing stays missing."""
    names = [c for c in df.columns if c != time]
    if not names:
        raise ValueError("no series columns")
    return df.unpivot(time, names, "series", value).select(F.col(time).cast("date").alias("time"), "series", F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias(value))


def to_wide(df: DataFrame, names: Sequence[str], value: str = "price") -> DataFrame:
    return df.groupBy("time").pivot("series", list(names)).agg(F.first(value))


def uniform(text: Column, k: int) -> Column:
    """The k-th of four numbers in (0, 1) that belong to ``text``: from its MD5, so that any engine and
    any partitioning has the same."""
    return (F.conv(F.substring(F.md5(text), 8 * k + 1, 8), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 32))


def normal(text: Column) -> Column:
    """A standard normal number that belongs to ``text`` (Box and Muller's transform)."""
    return F.sqrt(-2 * F.ln(uniform(text, 0))) * F.cos(2 * F.pi() * uniform(text, 1))


def drawn_returns(days: DataFrame, names: DataFrame, scale: float = 0.01, seed: int = 0) -> DataFrame:
    """time, series, ret: normal returns of ``names`` (series) on each of ``days`` (time, few). A value depends
    on seed, series and day alone."""
    rows = names.select("series").crossJoin(F.broadcast(days.select("time")))  # the grid is what is asked for
    return rows.select("time", "series", (normal(F.concat_ws("|", F.lit(str(seed)), "series", F.col("time").cast("string"))) * scale).alias("ret"))


def business_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    return spark.sql(f"select explode(sequence(date'{start}', date'{end}')) as time").filter("weekday(time) < 5")


def mock_returns(spark: SparkSession, start: str, end: str, names: Sequence[str], scale: float = 0.01, seed: int = 0) -> DataFrame:
    """Normal returns on business days, for trials without data: time, series, ret."""
    if not names:
        raise ValueError("names must not be empty")
    series = spark.createDataFrame([(n,) for n in names], "series string")
    return drawn_returns(business_days(spark, start, end), series, scale, seed)
