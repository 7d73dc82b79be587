"""Access-log rows derived from the generic events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The same text runs in Spark SQL and in DuckDB.
DERIVED = """
SELECT
  event_id AS seq,
  CASE WHEN event_id % 50 = 49
       THEN concat('V', lpad(CAST(CAST(floor(event_id / 50) AS BIGINT) AS STRING), 5, '0'))
       ELSE concat('U', lpad(CAST(user_id % 25 AS STRING), 5, '0')) END AS user_id,
  CASE WHEN event_id % 50 = 49 THEN 'D99999'
       ELSE concat('D', lpad(CAST((user_id + event_id) % 12 AS STRING), 5, '0')) END AS device_id,
  concat('APP', lpad(CAST((event_id * 7) % 11 AS STRING), 4, '0')) AS app_id,
  concat('R', lpad(CAST((event_id * 13 + user_id) % 97 AS STRING), 5, '0')) AS resource_id,
  CASE WHEN event_id % 50 = 49 THEN 'LOGIN'
       WHEN CAST(floor(event_id / 40) AS BIGINT) % 5 = 0 THEN 'FAILED_LOGIN'
       WHEN event_type = 'signup'   THEN 'LOGIN'
       WHEN event_type = 'error'    THEN 'FAILED_LOGIN'
       WHEN event_type = 'purchase' THEN 'DOWNLOAD'
       WHEN event_type = 'click' THEN CASE event_id % 4 WHEN 0 THEN 'LOGIN' WHEN 1 THEN 'LOGOUT'
                                                        WHEN 2 THEN 'ADMIN_ACTION' ELSE 'OPEN_APP' END
       ELSE CASE event_id % 3 WHEN 0 THEN 'ACCESS' WHEN 1 THEN 'TOKEN_REFRESH' ELSE 'LOGIN' END
  END AS event_type,
  CASE CAST(floor(value) AS BIGINT) % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'VN' WHEN 2 THEN 'JP'
                                        WHEN 3 THEN 'SG' ELSE 'DE' END AS location,
  CAST(1704042000 + event_id * 2
       + CASE WHEN event_id % 1000 >= 500 THEN 950400 ELSE 0 END
       + CAST(floor(event_id / 1000) AS BIGINT) * 1987200 AS BIGINT) AS timestamp
FROM {events}
"""


def derived_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The access log that the events table of sf_dir stands for."""
    return spark.sql(DERIVED.format(events="{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
