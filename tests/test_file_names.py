from __future__ import annotations

import duckdb

from claimweave.operators import store as T
from claimweave.plans.evaluation import ORACLES, QUERIES


def test_numbers_of_four_digits_stay_in_names(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE supplier AS SELECT i AS s_suppkey FROM range(12000) r(i)")
    con.execute(f"COPY supplier TO '{tmp_path}/supplier.parquet'")
    want = con.execute(ORACLES["infer_metadata"])
    columns = [c[0] for c in want.description]
    got = QUERIES["infer_metadata"](spark, str(tmp_path)).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_the_year_leaves_the_name_wherever_it_stands(spark):
    stems = ["2021_acme-report", "acme-2022-23-brsr", "acme_1500_2020", "acme-1500"]
    got = T.file_metadata(spark.createDataFrame([(s,) for s in stems], "stem string")).collect()
    assert [(r.report_year, r.company_name) for r in got] == [(2021, "Acme"), (2023, "Acme"), (2020, "Acme 1500"), (2024, "Acme")]
