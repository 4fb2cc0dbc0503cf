"""Pluggable text embedding.

``embed`` runs a user model over a text column with ``predict_batch_udf``: a model is built
once per Python worker process, kept from task to task, and fed at most ``batch_size`` texts at
a time.  It is given as ``make_model() -> predict(texts: list[str]) -> np.ndarray[n, dim]``; a null
text is passed as None.  Vectors are arrays of double, or of float with ``single=True``.

The default model, ``hashed_model``, stands in for a sentence encoder (no weights are
available offline): a signed bag of ``lower().split()`` tokens hashed into ``dim``
buckets with md5, L2-normalised.  md5 makes it reproducible in SQL (the oracle
computes the same vectors in DuckDB).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from codeloom.functions.text import col_
from codeloom.session import limit_batches

# The reference prefixes query texts (not documents) with this instruction.
QUERY_PREFIX = "Represent this sentence: "
# What a worker of the default model keeps does not grow with the texts.
CACHE_TOKENS = 100_000
CACHE_LENGTH = 64
SLICE_CHARS = 1 << 20


def hashed_model(dim: int = 64) -> Callable[[], Callable[[list[str]], "object"]]:
    def make():
        from hashlib import md5

        import numpy as np
        import pyarrow as pa

        cache: dict[str, int] = {}      # 2 * bucket, + 1 if the sign is negative

        def slot(tok: str) -> int:
            v = cache.get(tok)
            if v is None:
                h = md5(tok.encode("utf-8")).digest()
                v = int.from_bytes(h[:4], "big") % dim * 2 + (h[4] >> 4) % 2
                if len(cache) < CACHE_TOKENS and len(tok) <= CACHE_LENGTH:
                    cache[tok] = v
            return v

        def vectors(texts):
            toks = [[] if t is None else t.lower().split() for t in texts]
            flat = pa.array([tok for ts in toks for tok in ts], pa.string()).dictionary_encode()    # each token is hashed once a slice
            slots = np.fromiter(map(slot, flat.dictionary.to_pylist()), np.int64, len(flat.dictionary))
            code = slots[flat.indices.to_numpy()]
            row = np.repeat(np.arange(len(toks)), [len(ts) for ts in toks])
            out = np.bincount(row * dim + code // 2, 1.0 - 2.0 * (code % 2), len(toks) * dim).reshape(-1, dim)
            n = np.linalg.norm(out, axis=1, keepdims=True)
            return np.divide(out, n, out=out.copy(), where=n > 0)

        def predict(texts):
            if not len(texts):
                return np.zeros((0, dim))
            ends = np.cumsum([len(t or "") for t in texts])     # slices of about SLICE_CHARS, a longer text by itself
            cuts = np.flatnonzero(np.diff(ends // SLICE_CHARS)) + 1
            return np.concatenate([vectors(texts[a:b]) for a, b in zip([0, *cuts], [*cuts, len(texts)])])

        return predict

    return make


BATCH_SIZE = 256


def embed_column(text, make_model=None, batch_size: int = BATCH_SIZE, single: bool = False) -> Column:
    """Column of the embeddings of ``text``."""
    make_model = make_model or hashed_model()

    def make_predict():
        import numpy as np
        predict = make_model()
        return lambda texts: np.asarray(predict(list(texts)), np.float32 if single else np.float64)

    kind = ArrayType(FloatType() if single else DoubleType())
    return predict_batch_udf(make_predict, return_type=kind, batch_size=batch_size)(col_(text))


def embed(df: DataFrame, text_col: str, out_col: str = "embedding", make_model=None,
          query_prefix: str | None = None, batch_size: int = BATCH_SIZE, single: bool = False) -> DataFrame:
    """Add ``out_col`` = model(``[query_prefix] + text``)."""
    text = F.col(text_col) if query_prefix is None else F.concat(F.lit(query_prefix), F.col(text_col))
    limit_batches(df.sparkSession)
    return df.withColumn(out_col, embed_column(text, make_model, batch_size, single))
