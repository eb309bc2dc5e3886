"""Tables written once: what the write leaves behind."""

import glob
import time

from pyspark.sql import functions as F

from parcelspark.session import materialize


def _shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}


def test_materialize_leaves_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(key, None), _shuffle_files(spark)
    out = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test-shuffled")
    for _ in range(50):  # they are removed beside the query
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert sorted(r["k"] for r in out.collect()) == list(range(7)) and out.agg(F.sum("count")).first()[0] == 1000
    assert spark.conf.get(key, None) == setting
