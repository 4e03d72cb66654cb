"""Turning texts into unit vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurlens.functions.clean import strip
from murmurlens.functions.text import text_to_encode

# Vector length and batch size.
DIMENSIONS = 384
BATCH = 256


def encode_with(
    texts: DataFrame,
    load: Callable[[], Callable[[list[str]], np.ndarray]],
    key: str = "post_id",
    text: str = "content",
    batch: int = BATCH,
) -> DataFrame:
    """``(key, embedding)`` from a model of the caller's: ``load()`` runs once per task and returns
    ``encode(list of texts) -> matrix``. Rows come back as float32 with unit length."""
    prepared = texts.select(key, text_to_encode(F.col(text)).alias("text"))
    schema = f"{key} {texts.schema[key].dataType.simpleString()}, embedding array<float>"

    def encode_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                matrix = np.asarray(encode(part["text"].tolist()), dtype=np.float64)
                length = np.linalg.norm(matrix, axis=1, keepdims=True)
                unit = np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": list(unit.astype(np.float32))})

    return prepared.mapInPandas(encode_all, schema)


def fit_hashed_encoder(texts: DataFrame, text: str = "content", dimensions: int = DIMENSIONS) -> PipelineModel:
    """A deterministic bag-of-words encoder: hashed term counts weighted by document frequency.

    It matches texts that share words; it has no notion of meaning beyond that. For meaning, pass
    a trained model to :func:`encode_with`.
    """
    prepared = texts.select(text_to_encode(F.col(text)).alias("text"))
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="tokens", pattern=r"[^\p{L}\p{N}_]+"),
            HashingTF(inputCol="tokens", outputCol="counts", numFeatures=dimensions),
            IDF(inputCol="counts", outputCol="weights"),
            Normalizer(inputCol="weights", outputCol="unit", p=2.0),
        ]
    ).fit(prepared)


def encode_hashed(model: PipelineModel, texts: DataFrame, key: str = "post_id", text: str = "content") -> DataFrame:
    """``(key, embedding)`` with unit length; stays in the JVM."""
    prepared = texts.select(key, text_to_encode(F.col(text)).alias("text"))
    return model.transform(prepared).select(key, vector_to_array("unit", "float32").alias("embedding"))


def encode_queries(encoded: DataFrame, queries: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """Queries with vectors from ``encoded(query_id, embedding)``; blank ones get a zero vector."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), dimensions)
    blank = F.length(strip(F.coalesce("text", F.lit("")))) == 0
    return queries.join(encoded, "query_id", "left").withColumn(
        "embedding", F.when(blank, zero).otherwise(F.col("embedding"))
    )
