"""The driver's tables as places, reports and points of interest; deterministic, with casts that give both engines the same doubles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"
SALT = "salt"
TYPES = "CASE p_partkey % 14 " + " ".join(
    f"WHEN {k} THEN '{c}'"
    for k, c in enumerate(["restaurant", "cafe", "hotel", "zimmer", "spa", "clothing", "shoes", "sports", "electronics", "toys", "jewelry", "attraction", "gov_service", "other"])
) + " END"

#: Runs in Spark and in DuckDB.
PLACES_SQL = f"""
SELECT p_partkey AS id, p_name AS name_he, CAST(NULL AS STRING) AS name_en, p_brand AS city, {TYPES} AS category,
       CASE WHEN p_partkey % 17 = 0 OR p_partkey % 19 = 0 OR p_partkey % 23 = 0 THEN NULL
            ELSE CAST(29.4 AS DOUBLE) + CAST((p_partkey * 7919) % 4000 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS lat,
       CASE WHEN p_partkey % 17 = 0 OR p_partkey % 19 = 0 OR p_partkey % 23 = 0 THEN NULL
            ELSE CAST(34.2 AS DOUBLE) + CAST((p_partkey * 104729) % 1700 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS lng,
       p_partkey % 17 = 0 AS is_chain, p_partkey % 19 = 0 AS is_online, p_size % 2 = 0 OR p_size % 3 <> 0 AS benefit_fighter_card,
       p_size % 3 = 0 AS benefit_vacation_voucher, CASE WHEN p_partkey % 2 = 0 THEN 'pdf_import' ELSE 'user_submission' END AS source,
       CASE WHEN p_partkey % 5 = 0 THEN 'pending' WHEN p_partkey % 31 = 0 THEN 'rejected' WHEN p_partkey % 7 = 0 THEN 'reported_not_working' ELSE 'published' END AS status,
       CAST(p_partkey % 4 AS INT) AS confirm_count, CAST(p_partkey % 6 AS INT) AS report_count,
       CASE WHEN p_partkey % 3 = 0 THEN 'town' ELSE 'exact' END AS location_precision,
       CASE WHEN p_partkey % 9 = 0 THEN 'osm:node/' || CAST(p_partkey AS STRING) END AS provider_ref, p_type AS address_he, p_size AS size
FROM part
"""

REPORTS_SQL = """
SELECT event_id AS id, (event_id * 7919 + user_id * 31) % (SELECT count(*) FROM part) AS place_id,
       CASE event_type WHEN 'signup' THEN 'new_submission' WHEN 'purchase' THEN 'confirm' ELSE 'not_working' END AS kind,
       CAST(user_id AS STRING) AS reporter, ts AS created_at
FROM events WHERE event_type IN ('signup', 'purchase', 'error')
"""


def duck(sql: str) -> str:
    return sql.replace("AS STRING", "AS VARCHAR")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PLACES_SQL.replace("FROM part", "FROM {part}"), part=read(spark, sf_dir, "part"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = REPORTS_SQL.replace("FROM part", "FROM {part}").replace("FROM events", "FROM {events}")
    return spark.sql(sql, part=read(spark, sf_dir, "part"), events=read(spark, sf_dir, "events")).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
