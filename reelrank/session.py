"""Session construction and lineage-cutting helpers.

Library functions never create sessions; tests, ``bench.py`` and the driver
entry point do, through :func:`get_session`.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings for the sessions we create (tests, bench, entry point).  On a
# cluster the submitter owns the session; see README "Cluster settings".
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "reelrank") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("REELRANK_DRIVER_MEM", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate data, named by ``spark.checkpoint.dir``.

    Executors write there, so on a cluster the setting is required.  Only a
    local master, whose executor is the driver, gets a scratch folder of its
    own where the setting is missing (tests).
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="reelrank-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint into the shared folder.

    It survives executor loss; local checkpoints do not and are never used.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``reelrank`` importable in Python workers (once per application).

    Operators that run Python inside tasks (pandas UDFs, ``applyInPandas``,
    ``mapInPandas``) call this; it zips the package and hands it to
    ``SparkContext.addPyFile``, which distributes it to every executor, the
    same as ``--py-files`` at submit time.  Skipped when the workers can
    already import it (the package was installed or shipped at submit).
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import os
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="reelrank-pyfiles-"), "reelrank.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.join("reelrank", os.path.relpath(full, pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)
