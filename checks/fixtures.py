"""Inputs for the registered queries, derived from the given tables.

The posts table, the graph and the vectors are written once per session and table folder, the way
an ingest job would, and every query reads the stored columns.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurlens.operators import encode, graph
from murmurlens.operators.components import connected_components
from murmurlens.operators.filters import people_only
from murmurlens.operators.ingest import IngestResult, ingest_lines
from murmurlens.operators.louvain import louvain
from murmurlens.operators.pagerank import pagerank
from murmurlens.operators.skew import heavy_keys, with_fan, with_salt
from murmurlens.operators.vectors import l2_normalize, mean_vectors
from murmurlens.runtime import Workspace, pin_settings, spread_small
from murmurlens.schema import POST_COLUMNS, POSTS_SCHEMA
from murmurlens.sources.keyed import Inserted, KeyedStore
from murmurlens.sources.lines import number_lines
from murmurlens.sources.posts import posts_store

AS_OF = dt.datetime(2024, 6, 1)
LAST_ORIGINAL_LINE = 10**9
TYPES = {field.name: field.dataType for field in POSTS_SCHEMA}


class Inputs:
    """Tables derived from one table folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = pin_settings(spark)
        self.sf_dir = sf_dir.rstrip("/")
        self.stored = Workspace(spark)
        self._ingested: IngestResult | None = None
        self.done: dict[str, object] = {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- posts -------------------------------------------------------------------------------

    def _copies(self) -> DataFrame:
        """``(doc_id, first_id, copies)`` of documents whose text occurs more than once. Texts are
        compared by digest; a text copied into a large part of all documents is salted. Digests are stored,
        for they are needed three times and the texts are to be read once for them."""
        digests = self.stored.table(
            "text-digests", lambda: self.raw("documents").select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
        )
        groups = (
            digests.groupBy("digest")
            .agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
            .filter("copies > 1")
        )
        heavy = heavy_keys(groups, "digest", "copies")
        if heavy is None:
            return digests.join(groups, "digest").drop("digest")
        salted = with_salt(digests, "digest", heavy, F.col("doc_id"))
        return salted.join(with_fan(groups, "digest", heavy), ["digest", "salt"]).drop("digest", "salt")

    def _attributes(self) -> DataFrame:
        """What the other tables say of a ``doc_id``: its event, the number of copies of its text, its label.
        None of it is text, so that texts are dealt out once, and for the graph not at all."""
        events = self.raw("events").filter(F.col("event_id") % 5 == 0).select(
            F.expr("event_id div 5").alias("doc_id"), "ts", "user_id", "event_type", "value", "props"
        )
        labels = self.raw("labels").select("doc_id", "toxic")
        return events.join(self._copies(), "doc_id", "left").join(labels, "doc_id", "left")

    def _joined(self, *columns: str) -> DataFrame:
        """Documents with their attributes; ``columns`` are what else is read of a document."""
        documents = spread_small(self.raw("documents").select("doc_id", "lang", "source", *columns), "doc_id")
        attributes = self.stored.table("post-attributes", self._attributes)
        # The narrow side is hashed, which spares sorting the texts.
        both = documents.join(attributes.hint("shuffle_hash"), "doc_id")
        user = F.col("user_id")
        is_first = F.coalesce(F.col("first_id") == F.col("doc_id"), F.lit(True))
        known = {
            "post_id": F.col("doc_id").cast("string"),
            "subreddit": F.concat("source", F.lit("-"), "lang"),
            "author": F.when(user % 25 == 0, "[deleted]")
            .when(user % 25 == 1, "AutoModerator")
            .otherwise(F.concat(F.lit("u"), user.cast("string"))),
            "created_utc": F.col("ts").cast("timestamp"),
            "score": F.floor("value").cast("int"),
            "num_comments": F.regexp_extract("props", "([0-9]+)", 1).cast("int"),
            "num_crossposts": F.when(is_first, F.coalesce(F.col("copies") - 1, F.lit(0))).otherwise(0).cast("int"),
            "crosspost_parent": F.when(is_first, "").otherwise(F.concat(F.lit("t3_"), F.col("first_id").cast("string"))),
            "domain": F.col("event_type"),
            "over_18": F.coalesce("toxic", F.lit(0)) == 1,
        }
        return both.select(*[column.cast(TYPES[name]).alias(name) for name, column in known.items()], *columns)

    def posts(self) -> DataFrame:
        """The text is stored once; what follows from it, or is the same for all, is filled in when read."""
        title = F.substring("selftext", 1, 80)
        stored = self.stored.table("posts", lambda: self._joined("text").withColumnRenamed("text", "selftext"))
        derived = {
            "title": title,
            "content": F.trim(F.concat(title, F.lit(" "), F.col("selftext"))),
            "platform": F.lit("reddit"),
        }
        blank = {"string": F.lit(""), "int": F.lit(0), "double": F.lit(0.0), "boolean": F.lit(False)}
        value = lambda name: F.col(name) if name in stored.columns else derived.get(name, blank.get(TYPES[name].simpleString()))
        return stored.select(*[value(name).cast(TYPES[name]).alias(name) for name in POST_COLUMNS])

    def posts_without_text(self) -> DataFrame:
        """The same posts, those of their columns that no text is read for."""
        return self.stored.table("posts-without-text", self._joined)

    # -- raw lines ---------------------------------------------------------------------------

    def lines(self) -> DataFrame:
        """Posts written as JSON lines: every fiftieth id repeated at the end of the file, every
        seventieth original line cut off in the middle of its JSON."""
        def build() -> DataFrame:
            data = F.struct(
                F.col("post_id").alias("id"), "title", "selftext", "author",
                F.unix_timestamp("created_utc").alias("created_utc"), "subreddit", "score", "num_comments",
                "crosspost_parent", "over_18",
            )
            number = F.col("post_id").cast("bigint")
            text = F.to_json(F.struct(F.lit("t3").alias("kind"), data.alias("data")))
            original = self.posts().select(
                number.alias("line_no"),
                F.when(number % 70 == 0, F.substring(text, 1, 60)).otherwise(text).alias("line"),
            )
            repeated = self.posts().filter(number % 50 == 0).select(
                (number + LAST_ORIGINAL_LINE).alias("line_no"), text.alias("line")
            )
            return number_lines(original.unionByName(repeated), "line_no")

        return self.stored.table("lines", build)

    def ingested(self) -> IngestResult:
        if self._ingested is None:
            self._ingested = ingest_lines(self.lines(), AS_OF)
        return self._ingested

    def posts_store(self) -> tuple[KeyedStore, list[Inserted]]:
        """A posts store after three inserts: people's posts, the ingested ones, then a batch of one per
        cent new ids and as many that may be stored."""
        if "store" not in self.done:
            number = F.col("post_id").cast("bigint")
            posts = self.posts().withColumn("position", number)
            known = people_only(posts).select("post_id").union(self.ingested().posts.select("post_id")).distinct()
            again = posts.filter(number % 100 == 0).join(known, "post_id", "left_semi").withColumn("title", F.lit("late"))
            new = posts.filter(number % 100 == 1).withColumn("post_id", F.concat(F.lit("new"), F.col("post_id")))
            store = posts_store(self.spark, f"{self.stored.root}/posts-store-{uuid.uuid4().hex}", buckets=32)
            batches = [people_only(posts), self.ingested().posts.withColumn("position", number), again.unionByName(new)]
            self.done["store"] = store, [store.insert(batch, "position") for batch in batches]
        return self.done["store"]

    # -- graph -------------------------------------------------------------------------------

    def authors(self) -> DataFrame:
        return self.stored.table("authors", lambda: graph.author_nodes(self.posts_without_text()))

    def edges(self) -> DataFrame:
        return self.stored.table("edges", lambda: graph.build_edges(self.posts_without_text()))

    def ranks(self) -> DataFrame:
        return self.stored.table("ranks", lambda: pagerank(self.authors(), self.edges()))

    def components(self) -> DataFrame:
        return self.stored.table("components", lambda: connected_components(self.authors(), self.edges()))

    def communities(self) -> DataFrame:
        return self.stored.table("communities", lambda: louvain(self.authors(), self.edges()))

    def nodes_by_component(self) -> DataFrame:
        """Nodes whose community is the connected component: the part of the graph results that
        has one right answer, and so can be compared with SQL."""
        given = self.components().withColumnRenamed("component", "community")
        return self.stored.table("nodes", lambda: graph.assemble_nodes(self.authors(), self.ranks(), given))

    # -- vectors -----------------------------------------------------------------------------

    def vectors(self) -> DataFrame:
        """``(post_id, label, embedding)`` for every row of the embeddings table."""
        return self.raw("embeddings").select(F.col("vec_id").cast("string").alias("post_id"), "label", "embedding")

    def topic_queries(self) -> DataFrame:
        """One query per label: the unit mean vector of its rows."""
        means = mean_vectors(self.raw("embeddings"), "label")
        return means.select(
            F.col("label").cast("bigint").alias("query_id"),
            F.concat(F.lit("topic "), F.col("label").cast("string")).alias("text"),
            l2_normalize(F.col("embedding")).alias("embedding"),
        )

    def encoder(self):
        if "encoder" not in self.done:
            self.done["encoder"] = encode.fit_hashed_encoder(self.posts())
        return self.done["encoder"]

    def encoded_posts(self) -> DataFrame:
        return self.stored.table("encoded", lambda: encode.encode_hashed(self.encoder(), self.posts()))

    def labelled(self) -> DataFrame:
        """``(post_id, cluster)`` from the given labels, the last label standing for noise."""
        return self.vectors().select(
            "post_id", F.when(F.col("label") == 9, -1).otherwise(F.col("label")).cast("int").alias("cluster")
        )


_inputs: dict[tuple[str, str], Inputs] = {}


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _inputs:
        _inputs[key] = Inputs(spark, sf_dir)
    return _inputs[key]
