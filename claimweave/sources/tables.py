"""Tables as claims: a deterministic adapter from order lines, and its parts."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that go through a step at once, and into how many parts more of them are dealt at most.
PART_ROWS, PARTS = 2_000_000, 8

#: SQL of the claims table, in a dialect that Spark and other engines share.
CLAIMS_SQL = """
WITH li AS (
    SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk, min(l_suppkey) AS sk, min(l_quantity) AS q, min(l_shipdate) AS d
    FROM {lineitem} GROUP BY l_orderkey, l_linenumber),
n AS (SELECT l_orderkey * 8 + l_linenumber AS claim_id, pk, sk, q, CAST(year(d) AS BIGINT) AS y, pk % 16 AS k FROM li)
SELECT claim_id, sk AS company_id, concat('Company ', CAST(sk AS STRING)) AS company_name, CAST(y AS INT) AS report_year,
    concat('r', CAST(sk AS STRING), '_', CAST(y AS STRING)) AS report_id, CAST(pk % 40 AS INT) AS page_number,
    CASE k WHEN 0 THEN 'Scope 1' WHEN 1 THEN 'total emissions' WHEN 2 THEN 'energy consumption' WHEN 3 THEN 'renewable energy' WHEN 4 THEN 'water withdrawal'
        WHEN 5 THEN 'diversity' WHEN 6 THEN 'waste generated' WHEN 7 THEN 'LTIFR' WHEN 8 THEN 'emissions' WHEN 9 THEN 'employment' WHEN 10 THEN 'training hours'
        WHEN 11 THEN 'reforestation' WHEN 12 THEN 'something else' WHEN 13 THEN 'whistleblower cases' WHEN 14 THEN 'CSR' ELSE 'carbon intensity' END AS aspect,
    CASE k WHEN 0 THEN 'emissions.scope1' WHEN 1 THEN 'emissions.total' WHEN 2 THEN 'energy.total' WHEN 3 THEN 'energy.renewable' WHEN 4 THEN 'water.consumption'
        WHEN 5 THEN 'social.diversity.gender' WHEN 6 THEN 'waste.total' WHEN 7 THEN 'social.health_safety.ltifr' WHEN 8 THEN 'emissions.total' WHEN 9 THEN 'social.workforce.total'
        WHEN 10 THEN 'social.training.hours' WHEN 11 THEN 'biodiversity.conservation' WHEN 13 THEN 'governance.ethics.incidents' WHEN 14 THEN 'social.community'
        WHEN 15 THEN 'emissions.intensity' ELSE 'uncategorized' END AS normalized_aspect,
    CASE claim_id % 6 WHEN 0 THEN 'reduced' WHEN 1 THEN 'plan' WHEN 2 THEN 'reported' WHEN 3 THEN 'increased' WHEN 4 THEN 'aim' ELSE 'disclosed' END AS action,
    CASE WHEN claim_id % 11 = 0 THEN NULL WHEN k IN (5, 15) THEN CAST(q AS DOUBLE) WHEN k = 7 AND claim_id % 7 = 0 THEN 0e0 WHEN claim_id % 29 = 0 THEN 0e0 ELSE CAST(q * (1 + pk % 7) AS DOUBLE) END AS metric_value,
    CASE k WHEN 0 THEN CASE WHEN claim_id % 2 = 0 THEN 'tCO2e' ELSE 'ktCO2e' END WHEN 1 THEN CASE WHEN claim_id % 5 = 0 THEN 'km' ELSE 'million tonnes CO2e' END
        WHEN 2 THEN CASE WHEN claim_id % 3 = 0 THEN 'GWh' ELSE 'MWh' END WHEN 3 THEN 'GJ per year' WHEN 4 THEN 'kilolitres' WHEN 5 THEN '%' WHEN 6 THEN CASE WHEN claim_id % 2 = 0 THEN 'tonnes' ELSE 'kg' END
        WHEN 7 THEN 'per million hours' WHEN 8 THEN 'MtCO2e' WHEN 9 THEN 'employees' WHEN 10 THEN 'hours' WHEN 11 THEN 'acres' WHEN 13 THEN 'cases' WHEN 14 THEN 'INR crore' WHEN 15 THEN 'gCO2e/MJ' ELSE '' END AS metric_unit,
    CASE claim_id % 5 WHEN 0 THEN 'increase' WHEN 1 THEN 'decrease' WHEN 2 THEN 'absolute' END AS metric_direction,
    CASE WHEN claim_id % 13 = 0 THEN 'unknown_time' ELSE CAST(y - claim_id % 2 AS STRING) END AS time_bucket,
    CASE claim_id % 4 WHEN 1 THEN 'Mumbai plant' WHEN 2 THEN 'India' WHEN 3 THEN 'Asia' END AS location_text,
    CASE claim_id % 4 WHEN 0 THEN 'global' WHEN 1 THEN CASE WHEN claim_id % 8 = 1 THEN 'facility' ELSE 'city' END WHEN 2 THEN 'country' ELSE 'region' END AS location_scope,
    CASE claim_id % 3 WHEN 0 THEN 'performance' WHEN 1 THEN 'target' ELSE 'narrative' END AS claim_type,
    CASE WHEN claim_id % 4 = 3 THEN 'table' ELSE 'text' END AS source_type,
    CASE (claim_id + pk) % 37 WHEN 0 THEN concat('Scope 1 emissions were ', CAST(CAST(q AS BIGINT) AS STRING), ' in FY23') WHEN 1 THEN 'Scope 1 and 2 emissions fell by 5%'
        WHEN 2 THEN 'Particulate matter fell to 12' WHEN 3 THEN 'NOx and SOx output was 40' WHEN 4 THEN 'Carbon credits of 10 were retired' WHEN 5 THEN 'Carbon capture reached 7'
        WHEN 6 THEN 'Net carbon intensity 70 gCO2e/MJ' WHEN 7 THEN 'Methane emissions of 3' WHEN 8 THEN 'LNG supply rose by 9' WHEN 9 THEN 'We invest 2 billion in low-carbon solutions'
        WHEN 10 THEN 'Payments to governments of 11' WHEN 11 THEN 'Lobbying is listed in the transparency register' WHEN 12 THEN 'Our 24,000 suppliers worldwide' WHEN 13 THEN 'LTIFR was 0.4'
        WHEN 14 THEN 'Net heat rate of 2,300 kcal/kwh' WHEN 15 THEN 'Non-renewable fuel consumption of 50' WHEN 16 THEN 'To surface water 1,24,89' WHEN 17 THEN 'Afforestation of 30 acres'
        WHEN 18 THEN 'Complaints on POSH: 2' WHEN 19 THEN 'Female employees 45' WHEN 20 THEN 'Male and female workers 99' WHEN 21 THEN 'Permanent workers 120' WHEN 22 THEN 'Contractual workforce 80'
        WHEN 23 THEN 'Hazardous waste to landfill 15' WHEN 24 THEN 'Waste incinerated 8' WHEN 25 THEN 'Is the policy in place?' WHEN 26 THEN 'Number of directors' WHEN 27 THEN 'Please specify'
        WHEN 28 THEN concat('By 2030 we will cut it by ', CAST(CAST(q AS BIGINT) AS STRING), ' percent') WHEN 29 THEN 'We aim to protect the human rights of all'
        WHEN 30 THEN concat('The value was ', CAST(CAST(q * (1 + pk % 7) AS BIGINT) AS STRING)) WHEN 31 THEN 'Disclose the total' WHEN 32 THEN 'We continue to improve our performance in every part of the company and in all regions where we operate'
        WHEN 33 THEN 'Scope 3 covers 15 categories per 305-3' WHEN 34 THEN 'Total energy consumed 700' WHEN 35 THEN 'Collective bargaining covers 60 percent' ELSE concat('Reported figure ', CAST(CAST(q AS BIGINT) AS STRING)) END AS source_sentence
FROM n"""


def compiled(spark: SparkSession) -> None:
    """Chains of rules become generated methods of over 8,000 bytes, which the JVM only interprets; from that size on
    Spark is told to split them instead."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One claim for each distinct order line: company, year, aspect, value, unit, sentence and place."""
    compiled(spark)
    return spark.sql(CLAIMS_SQL, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    compiled(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name where driver and executors share files (``spark.checkpoint.dir``); only a local session
    without such a setting gets a new temporary folder for it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the folder that driver and executors share and read back, for a query that
    branches on derived columns: they are computed once, and a lost executor costs no recomputation."""
    path = shared_folder(df.sparkSession, "tables")
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables that ``settled`` wrote.
_WRITTEN: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _let_go(spark: SparkSession) -> None:
    """Let Spark delete the shuffles that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def in_parts(make: Callable[..., DataFrame], key: str, *inputs: DataFrame, write: bool = False) -> DataFrame:
    """``make(*inputs)``, where rows only meet rows of one ``key`` (such as a report), which all ``inputs`` have.

    If the first input has over PART_ROWS rows, the keys are dealt to up to PARTS parts by their hash, and one part after another is
    made and written. Every row is in one part. The tables and shuffles that a part worked with go before the next begins, so
    the disk holds those of one. Fewer rows are made at once, and written only with ``write``. Keys of unlike types stay together.
    """
    spark = inputs[0].sparkSession
    n = min(PARTS, 1 + inputs[0].count() // PART_ROWS) if len({df.schema[key].dataType for df in inputs}) == 1 else 1
    if n == 1 and not write:
        return make(*inputs)
    found: list[DataFrame] = []
    for i in range(n):
        _let_go(spark)
        start = len(_WRITTEN)
        found.append(settled(make(*(df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for df in inputs) if n > 1 else inputs)))
        for path in _WRITTEN[start:-1]:
            _delete(spark, path)
        del _WRITTEN[start:-1]
    _let_go(spark)
    return reduce(DataFrame.unionByName, found)
