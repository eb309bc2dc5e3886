"""Embedding.

The built-in embedder is a hashed term-frequency vector: lower-case ASCII word
tokens, each hashed by md5 into one of ``buckets`` slots, counts divided by
the L2 norm. It runs as an Arrow-batched UDF (regex tokenising, md5
once per distinct token per batch, ``bincount``): one narrow stage per row, so
embedding a corpus never shuffles. ``token_buckets`` is the same hashing as a
built-in expression, for plans that need the tokens themselves. Any other embedder with the same shape
(``text column -> array<float>`` of unit length) plugs into the same place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..schemas import EMBEDDING_MODEL_NAME, HASH_BUCKETS

#: Texts of a batch that a model gets, and numbers of a projected vector.
EMBED_BATCH, PROJECTED = 256, 16
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
TOKEN_WORD = r"[^\W_]+"  # the same tokens, matched instead of split on


def tokens(text: Column) -> Column:
    """Lower-case tokens of letters and digits of any script (non-empty)."""
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda t: t != "")


def token_buckets(text: Column, buckets: int = HASH_BUCKETS) -> Column:
    """Bucket of each token: first 32 bits of md5(token) modulo ``buckets``."""
    return F.transform(
        tokens(text),
        lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % buckets).cast("int"))


_WORD = re.compile(TOKEN_WORD)


def bucket_counts(text: str | None, buckets: int, cache: dict) -> np.ndarray:
    """Unit-length bucket counts of one text (per-text helper of the UDF).

    Same tokens and buckets as ``token_buckets``; md5 is computed once per
    distinct token per batch (``cache``)."""
    counts = np.zeros(buckets, dtype=np.float64)
    if text:
        ids = []
        for tok in _WORD.findall(text.lower()):
            b = cache.get(tok)
            if b is None:
                b = int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:8], 16) % buckets
                cache[tok] = b
            ids.append(b)
        if ids:
            counts = np.bincount(np.asarray(ids, dtype=np.int64), minlength=buckets).astype(np.float64)
    norm = np.sqrt(np.dot(counts, counts))
    return (counts / norm if norm > 0 else counts).astype(np.float32)


def _embedder(buckets: int):
    @F.arrow_udf("array<float>")
    def embed(texts: pa.Array) -> pa.Array:
        cache: dict = {}
        out = np.empty((len(texts), buckets), np.float32)
        for i, t in enumerate(texts):  # one text is a Python string at a time
            out[i] = bucket_counts(t.as_py(), buckets, cache)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * buckets), pa.array(out.ravel()))
    return embed


def hashed_embedding(text: Column, buckets: int = HASH_BUCKETS) -> Column:
    """T7 + T8: unit-length hashed term-frequency vector (zero vector for a
    text without tokens), one Arrow-batched pass per partition."""
    return _embedder(buckets)(text)


# ---------------------------------------------------------------------------
# The slot for a model that is loaded once per Python worker
# ---------------------------------------------------------------------------

def model_embedding(load: Callable[[], Callable[[np.ndarray], np.ndarray]], dimension: int,
                    batch_size: int = EMBED_BATCH) -> Callable[[Column], Column]:
    """An embedder ``text column -> array<double>`` from a model.

    ``load`` runs once in each Python worker and returns the model: a function from an array of texts (at
    most ``batch_size``; a null text is empty) to a matrix of ``dimension`` numbers a text. A model whose
    output has another shape fails the job. Vectors are scaled to length one; zero vectors stay zero.
    """
    def make() -> Callable[[np.ndarray], np.ndarray]:
        model = load()

        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.asarray(model(np.array([t if isinstance(t, str) else "" for t in texts.reshape(-1)], object)), np.float64)
            if out.shape != (len(texts), dimension):
                raise ValueError(f"the model gave shape {out.shape} for {len(texts)} texts, not {(len(texts), dimension)}")
            norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
            return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)
        return predict

    embed = predict_batch_udf(make, return_type=ArrayType(DoubleType()), batch_size=batch_size)
    return lambda text: embed(F.coalesce(text, F.lit("")))


def projection_model(dimension: int = PROJECTED, buckets: int = HASH_BUCKETS) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """The built-in model for the slot: bucket counts of a text's tokens times a matrix of signs, which is
    made from md5 when the model is loaded."""
    def load() -> Callable[[np.ndarray], np.ndarray]:
        signs = np.array([[1.0 - 2.0 * (int(hashlib.md5(f"{b}:{j}".encode()).hexdigest()[:8], 16) % 2) for j in range(dimension)]
                          for b in range(buckets)])
        cache: dict[str, int] = {}

        def model(texts: np.ndarray) -> np.ndarray:
            counts = np.zeros((len(texts), buckets))
            for row, text in enumerate(texts):
                for tok in _WORD.findall(text.lower()):
                    b = cache.get(tok)
                    if b is None:
                        if len(cache) >= 1 << 18:
                            cache.clear()
                        b = cache[tok] = int(hashlib.md5(tok.encode()).hexdigest()[:8], 16) % buckets
                    counts[row, b] += 1
            return counts @ signs
        return model
    return load


def l2_normalise(vec: Column) -> Column:
    """T8 for any vector column: divide by the L2 norm, zero stays zero."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vec, lambda x: (x / norm).cast("float"))).otherwise(vec)


def embed_table(df: DataFrame, text_col: str = "text", out_col: str = "embedding",
                buckets: int = HASH_BUCKETS) -> DataFrame:
    return df.withColumn(out_col, hashed_embedding(F.col(text_col), buckets))


def sparse_weights(df: DataFrame, id_col: str, emb_col: str = "embedding", digits: int = 6) -> DataFrame:
    """Long form ``(id, bucket, weight)`` of the non-zero slots."""
    return (df.select(id_col, F.posexplode(emb_col).alias("bucket", "weight"))
              .where(F.col("weight") != 0)
              .select(id_col, F.col("bucket").cast("int").alias("bucket"),
                      F.round(F.col("weight").cast("double"), digits).alias("weight")))


def collection_info(name: str, dimension: int, model: str = EMBEDDING_MODEL_NAME,
                    space: str = "cosine") -> dict:
    """Collection metadata (the store keeps it next to the vectors)."""
    return {"collection": name, "embedding_model": model, "space": space, "dimension": dimension}


def check_same_space(infos: list[dict]) -> None:
    """Collections searched together must share model, space and dimension."""
    keys = {(i["embedding_model"], i["space"], i["dimension"]) for i in infos}
    if len(keys) > 1:
        raise ValueError(f"collections use different embedding spaces: {sorted(keys)}; "
                         "their distances cannot be merged")
