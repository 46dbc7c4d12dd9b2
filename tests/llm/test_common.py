from __future__ import annotations

import os

import pytest

from claimweave.llm import common


def test_tidy_stages_drop_what_earlier_ones_worked_with(spark):
    """A stage's own tables last until the next stage; the table that it reads, and others' tables, stay."""
    made = []

    @common.tidy
    def stage(spark, docs, sf_dir):
        work = common.cut(docs.withColumn("x", docs.id + 1))
        made.append(work)
        return work.where("x > 2")

    def there(df):
        return os.path.exists(df.inputFiles()[0].removeprefix("file://"))

    other = common.cut(spark.range(3))
    first = common.cut(stage(spark, spark.range(5), ""))
    files = made[0].inputFiles()
    assert there(made[0])
    second = stage(spark, first.select("id"), "")
    assert not os.path.exists(files[0].removeprefix("file://")) and there(first) and there(other) and second.count() == 3
    third = stage(spark, second.select("id"), "")
    assert third.count() == 3 and there(made[1])


def test_arrow_limits_come_back(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with pytest.raises(ZeroDivisionError), common.arrow_batches(spark, 7):
        assert spark.conf.get(name) == "7"
        1 / 0
    assert spark.conf.get(name) == before
