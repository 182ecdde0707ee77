"""Sessions and intermediate tables."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, app: str = "strandline") -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    return (builder.master(master) if master else builder).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. A local session may do without; elsewhere that is an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="strandline-")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder: lineage ends here and survives lost executors."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def importable(spark: SparkSession) -> SparkSession:
    """The session, whose Python workers find this package where the driver has it, whatever folder the driver was started in.

    On a cluster that doesn't mount that folder ship the package, as with ``--py-files``.
    """
    root, found = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    if root not in (paths := found.get("PYTHONPATH", "").split(os.pathsep)):
        found["PYTHONPATH"] = os.pathsep.join(x for x in (*paths, root) if x)
    return spark
