"""A session builder with the settings the library is happiest with."""

from __future__ import annotations

from pyspark.sql import SparkSession

# All are ordinary Spark settings; pass the same ones to `spark-submit --conf`.
SETTINGS = {
    # Plans adapt to the sizes found at run time: few output partitions for small
    # results, split partitions for hot join keys.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Recording the Python line of every column expression costs about 2 ms each, which
    # adds up to seconds for a table of many columns. It can only be set at the start.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
}


def builder(name: str = "autolens") -> SparkSession.Builder:
    result = SparkSession.builder.appName(name)
    for key, value in SETTINGS.items():
        result = result.config(key, value)
    return result
