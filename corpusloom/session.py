"""A session for the command line; on a cluster, spark-submit's settings take precedence."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "corpusloom") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
