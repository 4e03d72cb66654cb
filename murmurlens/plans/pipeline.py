"""The whole batch in one call: ingest, store, vectors, graph, topics."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from murmurlens.operators.encode import DIMENSIONS, encode_hashed, fit_hashed_encoder
from murmurlens.operators.ingest import ingest_files
from murmurlens.plans import reports
from murmurlens.sources.content_vectors import vectors_by_content
from murmurlens.sources.posts import load_once


@dataclass(frozen=True)
class Prepared:
    posts: DataFrame
    vectors: DataFrame
    graph: reports.GraphResult
    topics: reports.ClusterResult


def prepare(
    spark: SparkSession,
    lines: str | list[str],
    folder: str,
    as_of: dt.datetime,
    encode: Callable[[DataFrame], DataFrame] | None = None,
    dimensions: int = DIMENSIONS,
    **topic_options,
) -> Prepared:
    """Posts from ``lines`` are ingested unless ``folder`` holds some already; only texts without a
    vector are encoded. ``encode`` maps ``(post_id, content)`` to ``(post_id, embedding)``; by
    default the hashed encoder is fitted on the stored posts."""
    posts = load_once(spark, f"{folder}/posts", lambda: ingest_files(spark, lines, as_of).posts)
    if encode is None:
        model = fit_hashed_encoder(posts, dimensions=dimensions)
        encode = lambda texts: encode_hashed(model, texts)
    vectors = vectors_by_content(posts, f"{folder}/vectors", encode, dimensions).vectors
    return Prepared(posts, vectors, reports.build_graph(posts), reports.topic_clusters(vectors, posts, **topic_options))
