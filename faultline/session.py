"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Recording the Python line of every Column call costs more than planning itself.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # A skewed join may sit below an aggregation on the same key: let AQE add a shuffle for it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def build_session(app: str = "faultline", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; ``extra`` overrides (use ``__`` for ``.``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> None:
    """The settings above for a session that was started elsewhere, where they can still change."""
    for key, value in SETTINGS.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)


def shared_folder(spark: SparkSession, fallback: str | None = None) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    ``fallback`` is only for single-machine tests, where the setting is unset.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    folder = named or fallback
    if not folder:
        raise ValueError("spark.checkpoint.dir is not set and no fallback folder was given")
    return folder
