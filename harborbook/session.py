"""Session settings the marts are tuned for; every one may be overridden by the cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # The rating master is 136 columns wide; the default of 100 would switch code generation off.
    "spark.sql.codegen.maxFields": "400",
    # The small first-level hash map helps with few groups; the marts group by claim, exposure and policy,
    # where every row passes through it in vain.
    "spark.sql.codegen.aggregate.map.twolevel.enabled": "false",
}


def build_session(app_name: str = "harborbook", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**RECOMMENDED, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
