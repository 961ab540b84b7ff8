"""A local session with the settings that the plans expect."""

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, **conf) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lodestrand")
    settings = {
        "spark.sql.shuffle.partitions": partitions,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
