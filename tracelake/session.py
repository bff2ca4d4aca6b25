"""Session builder with the settings the library assumes: UTC, adaptive execution."""

from pyspark.sql import SparkSession


def build_session(app: str = "tracelake", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
