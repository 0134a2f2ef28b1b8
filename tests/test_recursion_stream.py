"""The stateful stream against the batch fold, with late values, over a restart."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftpanel.operators import crossproducts
from driftpanel.streaming import recursion

SCHEMA = "series string, ts timestamp, time_idx bigint, x double"


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, recursion.STORE)
    yield spark
    spark.conf.set(name, before)


def test_stream_equals_batch_after_a_restart(store, tmp_path):
    spark, rng = store, np.random.default_rng(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(s, start + dt.timedelta(hours=i), i, float(rng.normal())) for i in range(48) for s in "ab" if (s, i % 7) != ("b", 3)]
    order = sorted(rows, key=lambda r: (r[2] + rng.integers(0, 3), r[0]))  # late by up to two hours
    parts = [order[:40], order[40:70], order[70:]]
    folder, check = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    spark.createDataFrame([], SCHEMA).write.parquet(folder)

    def run():
        source = spark.readStream.schema(SCHEMA).parquet(folder)
        job = recursion.weighted_stream(source, 5.0, "4 hours").writeStream.format("parquet").option("checkpointLocation", check).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
        job.awaitTermination(240)
        assert job.exception() is None

    for part in parts:  # each run is a restart from the checkpoint
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        run()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    seen = {(r.series, r.time_idx): r for r in got}
    assert len(got) == len(seen) and {(s, i) for s, _, i, _ in rows if i < 43} <= seen.keys()
    batch = spark.createDataFrame(rows, SCHEMA)
    for last in (0, 9, 30, 42):
        x = F.col("x")
        want = {r.series: r for r in crossproducts.ew_moments(batch.filter(F.col("time_idx") <= last), ["series"], {"m": x, "xx": x * x}, 5.0).collect()}
        for s, w in want.items():
            at = max(i for k, _, i, _ in rows if k == s and i <= last)
            assert abs(seen[s, at].mean - w.m) < 1e-12
            assert seen[s, at].variance is None or abs(seen[s, at].variance - (w.xx - w.m**2) / (1 - w.w2)) < 1e-12
