"""From raw documents to packed training sequences, in four stages.

Each stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame that is written as Parquet and read
again by the next one. All but the last keep the columns of ``documents`` and drop rows:

1. ``language_id``: documents without a recognisable language go (no text, no letters);
2. ``quality_rules``: documents that fail the fixed rules or the calibrated classifier go;
3. ``ngram_jaccard``: of each group of near-duplicates one row stays, that with the smallest id, of
   several texts with that id the one with the smallest hash; null ids come last; rows without words
   link with nothing and stay;
4. ``packing``: the pieces of all documents left, with their sequence and offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurlens.llm import jaccard, language, packing, quality
from murmurlens.llm.common import table
from murmurlens.llm.queries import END_ID, tokenizer
from murmurlens.runtime import stage


def _packed(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, rest)``: every column but the text in one, so that no name can clash."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{name}`") for name in docs.columns if name != "text"]).alias("rest"))


def _unpacked(judged: DataFrame, like: DataFrame) -> DataFrame:
    return judged.select(*[F.col("text") if name == "text" else F.col(f"rest.`{name}`") for name in like.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(*language.training_sample(docs, F.lit(True)))
    judged = language.predict(_packed(docs), model, "rest")
    return _unpacked(judged.filter(F.col("lang_pred") != language.UNDETERMINED), docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return _unpacked(quality.score(_packed(docs), model, "rest").filter("kept"), docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("rest")
    rows = jaccard.rows_of(docs, rest).select("id", "key", "rest")
    stay = jaccard.once(rows, jaccard.first_rows(docs.select("doc_id", "text"))).select("rest.*")
    return stay.unionByName(docs.filter(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), END_ID)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("ngram_jaccard", ngram_jaccard), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
