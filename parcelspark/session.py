"""Session helpers: one place for the knobs every job relies on.

On a cluster the session already exists and carries the cluster's settings;
``get_session`` then only reads them. Local defaults (tests, bench) are applied
only on a local master, and only where a setting was not submitted.
"""

from __future__ import annotations

import os
import shlex
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings a local run needs.
_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # One BLAS thread per task slot: each core already runs its own Python
    # worker, so a multi-threaded matrix product would oversubscribe it.
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    "spark.executorEnv.MKL_NUM_THREADS": "1",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "parcelspark") -> SparkSession:
    """Return the active session, or build one.

    Off a local master nothing is set but the name and what the caller passes:
    the cluster's submitted settings hold. Locally, the defaults above fill in
    only what was not submitted.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    submitted = _submitted()
    master = master or submitted.get("spark.master") or os.environ.get("SPARK_MASTER", "local[8]")
    builder = SparkSession.builder.appName(app_name).master(master)
    if _is_local(master):
        defaults = _LOCAL_DEFAULTS | {"spark.driver.memory": os.environ.get("SPARK_DRIVER_MEMORY", "16g")}
        for key, value in defaults.items():
            if key not in submitted:
                builder = builder.config(key, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def _submitted() -> dict[str, str]:
    """Settings given on submit: ``--conf key=value`` of PYSPARK_SUBMIT_ARGS."""
    words = shlex.split(os.environ.get("PYSPARK_SUBMIT_ARGS", ""))
    found = dict(w.split("=", 1) for flag, w in zip(words, words[1:]) if flag in ("--conf", "-c") and "=" in w)
    found |= {key: w for flag, w in zip(words, words[1:])
              for key, name in (("spark.master", "--master"), ("spark.driver.memory", "--driver-memory")) if flag == name}
    return found


def _is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def ship_package(spark: SparkSession) -> None:
    """Give executors this package as a zip, so that Python workers can import it
    wherever the driver runs from. Local workers get it through the same file."""
    sc = spark.sparkContext
    if _SHIPPED.get("app") == sc.applicationId:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="parcelspark-zip-"), "parcelspark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "parcelspark")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED["app"] = sc.applicationId


_SHIPPED: dict[str, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for cutting lineage: ``spark.checkpoint.dir`` of the session.

    Only a local session that has none (tests) gets a fresh scratch folder; on a
    cluster a machine-local folder would lose tables, so a missing setting raises.
    """
    current = spark.sparkContext.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if current is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not _is_local(spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="parcelspark-ckpt-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read
    it back: the lineage is cut and the plan runs once (an RDD
    ``checkpoint()`` runs it twice unless cached). Written through the normal
    commit protocol, so a lost executor only redoes its own tasks, and the
    read-back table still gets column pruning and filter pushdown. The schema is
    passed on, so reading back starts no job. Shuffle files of the write go when it has
    ended, as nothing reads them again; else they lie there until the driver collects its garbage."""
    spark = df.sparkSession
    path = scratch_path(spark, f"tables/{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Whether the shuffle files of a query go at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
