from __future__ import annotations

from claimweave.plans.claims import enriched


def test_rules_are_split_into_methods_that_the_jvm_compiles(spark):
    """Methods of more than 8,000 bytes are interpreted; the limit stands once claims are read."""
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    enriched(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
