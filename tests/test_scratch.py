"""Written intermediate tables."""

from __future__ import annotations

import os

from reelgrid.plans.scratch import materialise, new_folder, release


def test_tables_are_written_and_released(spark):
    df = materialise(spark.range(5).withColumnRenamed("id", "a b"), "some")
    assert df.count() == 5 and df.columns == ["a b"]
    at = os.path.dirname(df.inputFiles()[0].removeprefix("file://"))
    release(df)
    assert not os.path.exists(at) and os.listdir(new_folder(spark, "x")) == []
    assert materialise(spark.range(0), "none").count() == 0
