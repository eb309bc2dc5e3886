"""The model slot of the embedder, and correlations of wide tables."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parcelspark.operators import embedding as E
from parcelspark.operators import profile as P
from parcelspark.operators.comoments import correlations
from parcelspark.operators.ingest import page_collection


def test_a_model_is_loaded_once_per_worker_and_gets_batches(spark, tmp_path):
    log = str(tmp_path / "log")

    def load():
        with open(log, "a") as f:
            f.write(f"load {os.getpid()}\n")

        def model(texts):
            with open(log, "a") as f:
                f.write(f"batch {len(texts)}\n")
            return np.stack([np.array([len(t), 1.0, 0.0]) for t in texts])
        return model

    df = spark.createDataFrame([(i, None if i % 50 == 0 else "x" * (i % 7)) for i in range(400)], "id int, text string").repartition(4)
    got = {r.id: r.v for r in df.withColumn("v", E.model_embedding(load, 3, batch_size=32)(F.col("text"))).collect()}
    for i, v in got.items():
        n = 0 if i % 50 == 0 else i % 7
        assert v == pytest.approx(np.array([n, 1, 0]) / np.sqrt(n * n + 1))
    with open(log) as f:
        lines = f.read().split("\n")[:-1]
    loads = [x for x in lines if x.startswith("load")]
    assert 1 <= len(loads) == len(set(loads)) and all(int(x.split()[1]) <= 32 for x in lines if x.startswith("batch"))


def test_a_model_of_the_wrong_shape_fails(spark):
    bad = E.model_embedding(lambda: lambda texts: np.zeros((len(texts), 2)), 3)
    with pytest.raises(Exception, match="not"):
        spark.createDataFrame([("a",)], "text string").select(bad(F.col("text"))).collect()


def test_the_slot_fits_the_ingest(spark):
    pages = spark.createDataFrame([("a.pdf", 1, "word " * 60)], "source string, page_number int, text string")
    rows = page_collection(pages, chunker="fixed", embed=E.model_embedding(E.projection_model(), E.PROJECTED)).collect()
    assert len(rows[0].embedding) == E.PROJECTED and sum(x * x for x in rows[0].embedding) == pytest.approx(1)


def test_500_columns_equal_pandas(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 500)) * rng.uniform(0.01, 1e6, 500) + rng.uniform(-1e7, 1e7, 500)
    x[:, 1::2] += 0.3 * x[:, 0::2]
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7] = 3.1
    x[:, 8] = np.nan
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(500)])
    df = spark.createDataFrame(pdf).repartition(5)
    got = np.full((500, 500), np.nan)
    for r in correlations(df, list(pdf.columns)).collect():
        got[r.i, r.j] = np.nan if r.corr is None else r.corr
    want = pdf.corr().to_numpy()
    constant = np.array([i in (7, 8) for i in range(500)])
    assert np.isnan(got[constant]).all() and np.isnan(got[:, constant]).all()
    assert np.allclose(got[~constant][:, ~constant], want[~constant][:, ~constant], atol=1e-9)


def test_names_and_few_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1), (2.0, 4.5, 2), (None, 1.0, 3)], "`a|b` double, `c d` double, n int")
    got = {(r.row_name, r.col_name): r.corr for r in P.correlation_matrix(df).collect()}
    assert got["a|b", "c d"] == got["c d", "a|b"] == 1.0 and got["n", "n"] == 1.0 and len(got) == 9
    assert {r.corr for r in P.correlation_matrix(df.limit(1)).collect()} == {None}
    assert {r.corr for r in P.correlation_matrix(df.limit(0)).collect()} <= {None}
