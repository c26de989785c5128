"""Streams give what batches give."""

import datetime

from pyspark.sql import functions as F

from tidemark.operators import baseline
from tidemark.streaming import incremental

SCHEMA = "aoi_id int, scene_id string, obs_date date, px_row int, px_col int, vv double, vh double"


def rows(spark, k):
    return spark.createDataFrame([(1, f"s{k}", datetime.date(2024, 4, 1 + k), r, c, None if r == c == k else float(r + c * k), 1.0) for r in range(4) for c in range(4)], SCHEMA)


def test_baseline_folds_batches_and_restarts(spark, tmp_path):
    path, state = str(tmp_path / "in"), str(tmp_path / "state")
    for k in range(5):
        rows(spark, k).coalesce(1).write.mode("append").parquet(path)
        if k % 2:
            s = incremental.read_observations(spark, path, max_files=1)
            incremental.run_to_end(s, incremental.fold_into(state, spark), str(tmp_path / "checkpoint"))
    incremental.run_to_end(incremental.read_observations(spark, path), incremental.fold_into(state, spark), str(tmp_path / "checkpoint"))
    left = sorted(int(p.name.split("-")[1]) for p in (tmp_path / "state").iterdir())
    last = left[-1]
    assert left == [last - 1, last]
    key = lambda r: (r["px_row"], r["px_col"])
    got = sorted(baseline.finish(spark.read.parquet(f"{state}/state-{last}")).collect(), key=key)
    want = sorted(baseline.fit(spark.read.parquet(path)).collect(), key=key)
    assert len(got) == len(want) == 16
    for g, w in zip(got, want):
        for a, b in zip(g, w):
            assert a == b or abs(a - b) < 1e-9


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    write = incremental.fold_into(str(tmp_path / "s"), spark)
    write(rows(spark, 0), 0)
    write(rows(spark, 1), 1)
    first = sorted(map(str, spark.read.parquet(str(tmp_path / "s/state-1")).collect()))
    write(rows(spark, 1), 1)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "s/state-1")).collect())) == first


def test_running_baseline_and_sessions_plan(spark, tmp_path):
    rows(spark, 0).write.parquet(str(tmp_path / "in"))
    s = incremental.read_observations(spark, str(tmp_path / "in"))
    seen = []
    incremental.run_to_end(incremental.running_baseline(s), lambda b, _: seen.append(b.count()), str(tmp_path / "c1"), "update")
    assert seen == [16]
    dates = s.select("aoi_id", "px_row", "px_col", "obs_date", F.lit(3).alias("cls"))
    incremental.run_to_end(incremental.flood_sessions(dates, "12 days", "0 days"), lambda b, _: b.count(), str(tmp_path / "c2"))
    incremental.run_to_end(incremental.monthly(dates), lambda b, _: seen.append(b.count()), str(tmp_path / "c3"), "complete")
    assert seen[-1] == 16
