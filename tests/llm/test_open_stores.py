"""The change applier's starts leave no state store open."""

from __future__ import annotations

from datetime import datetime, timedelta

from reelgrid.llm import change_applier


def test_no_store_stays_open(spark):
    rows = [(i, i % 5, i // 5, "U", datetime(2024, 1, 1) + timedelta(days=i % 100), "Bel", 1.0) for i in range(40)]
    changes = spark.createDataFrame(rows, "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, city string, balance double")
    assert change_applier.apply_changes(changes).count() > 0
    assert spark._jvm.org.apache.spark.sql.execution.streaming.state.RocksDBMemoryManager.getNumRocksDBInstances(True) == 0
