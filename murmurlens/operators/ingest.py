"""From raw JSON lines to the posts table.

One pass parses and cleans every line into a staged table, and observes which keys occur. What needs
a view of the whole file (the choice of keys, first-wins de-duplication, running numbers for posts
without an id, the counters) then reads only the columns of that table that it needs.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from murmurlens.functions import clean
from murmurlens.operators.skew import first_wins
from murmurlens.runtime import cut, stage
from murmurlens.schema import FIELD_CANDIDATES, POST_COLUMNS
from murmurlens.sources.lines import chunk_of, first_lines, read_lines

PREVIEW_RECORDS = 3


def parse_lines(lines: DataFrame) -> DataFrame:
    """``(line_pos, status, record)``; status is blank, malformed, rejected or valid.

    The record is the object under ``data`` where there is one, else the line itself if it is an
    object with one of the keys that make it a flat post.
    """
    text = clean.strip(F.col("line"))
    parsed = lines.select(
        "line_pos",
        (F.length(text) == 0).alias("is_blank"),
        F.try_parse_json(text).alias("doc"),
    )
    doc = F.col("doc")
    inner = F.try_variant_get(doc, "$.data", "variant")
    has_envelope = F.coalesce(F.schema_of_variant(inner).startswith("OBJECT"), F.lit(False))
    is_flat = F.lit(False)
    for key in ("author", "title", "selftext"):
        is_flat = is_flat | clean.raw_value(doc, key).isNotNull()
    unwrapped = parsed.select(
        "line_pos", "is_blank", doc.isNull().alias("is_bad"),
        F.when(has_envelope, inner).when(is_flat, doc).alias("record"),
    )
    status = (
        F.when(F.col("is_blank"), "blank")
        .when(F.col("is_bad"), "malformed")
        .when(F.col("record").isNull(), "rejected")
        .otherwise("valid")
    )
    return unwrapped.select("line_pos", status.alias("status"), "record")


def head_records(lines: DataFrame, wanted: int) -> DataFrame:
    """``(line_pos, record)`` of the first ``wanted`` valid records.

    The place of the last line to look at is found from the positions alone, so that only the first
    lines are read and parsed; more are taken while too few of them are valid.
    """
    taken = 50 * wanted
    while True:
        last = lines.select("line_pos").orderBy("line_pos").limit(taken).agg(F.max("line_pos")).first()[0]
        head = cut(lines.filter(F.col("line_pos") <= F.lit(last)))
        records = cut(parse_lines(head)).filter("status = 'valid'")
        if records.count() >= wanted or head.count() < taken:
            return records.select("line_pos", "record").orderBy("line_pos").limit(wanted)
        taken *= 20


def record_keys(record: Column) -> Column:
    return F.map_keys(F.try_variant_get(record, "$", "map<string,variant>"))


def sample_keys(lines: DataFrame, sample: int | None = None) -> DataFrame:
    """Distinct keys of all valid records, or of the first ``sample`` where that is given."""
    if sample is None:
        return profile_keys(lines).select("source_key")
    return head_records(lines, sample).select(F.explode(record_keys(F.col("record"))).alias("source_key")).distinct()


def resolve_fields(keys: DataFrame) -> DataFrame:
    """``(field, source_key)``: for every field its first candidate among ``keys(source_key)``."""
    ranked = [
        (field, candidate, rank)
        for field, candidates in FIELD_CANDIDATES.items()
        for rank, candidate in enumerate(candidates)
    ]
    candidates = keys.sparkSession.createDataFrame(ranked, "field string, source_key string, choice int")
    return (
        keys.join(F.broadcast(candidates), "source_key")
        .groupBy("field")
        .agg(F.min_by("source_key", "choice").alias("source_key"))
    )


def detect_fields(lines: DataFrame, sample: int | None = None) -> DataFrame:
    return resolve_fields(sample_keys(lines, sample))


def as_field_map(resolved: DataFrame) -> dict[str, str]:
    """The resolved fields as a dict: one entry per known field at most."""
    return {row["field"]: row["source_key"] for row in resolved.collect()}


def detect_fields_in_files(spark: SparkSession, path: str | list[str], sample: int | None = None) -> dict[str, str]:
    """Field map of a file set: of all records, or with ``sample`` of the head of the first files."""
    if sample is None:
        found = as_field_map(detect_fields(read_lines(spark, path)))
        if not found and parse_lines(read_lines(spark, path)).filter("status = 'valid'").isEmpty():
            raise ValueError("no valid records in the input")
        return found

    def keep(lines):
        valid = parse_lines(lines).filter("status = 'valid'")
        return valid.select("line_pos", record_keys(F.col("record")).alias("source_keys"))

    head = first_lines(spark, path, sample, keep)
    if not head:
        raise ValueError("no valid records in the input")
    keys = sorted({key for row in head for key in row["source_keys"]})
    return as_field_map(resolve_fields(spark.createDataFrame([(key,) for key in keys], "source_key string")))


def preview_records(lines: DataFrame, records: int = PREVIEW_RECORDS, width: int = 80) -> DataFrame:
    """Keys and clipped values of the first records: ``(record_no, source_key, preview)``."""
    numbered = head_records(lines, records).select(
        F.row_number().over(W.orderBy("line_pos")).alias("record_no"), "record"
    )
    fields = numbered.select(
        "record_no",
        F.explode(F.try_variant_get("record", "$", "map<string,variant>")).alias("source_key", "value"),
    )
    plain = F.try_variant_get("value", "$", "string")
    is_boolean = plain.isin("true", "false") & (F.schema_of_variant("value") == "BOOLEAN")
    shown = F.when(plain.isNull(), "None").when(is_boolean, F.initcap(plain)).otherwise(plain)
    clipped = F.when(F.length(shown) > width, F.concat(F.substring(shown, 1, width), F.lit("..."))).otherwise(shown)
    return fields.select("record_no", "source_key", clipped.alias("preview"))


def profile_keys(lines: DataFrame) -> DataFrame:
    """How many valid records carry each key, over the whole input. Invalid lines have no keys."""
    keys = parse_lines(lines).select(F.when(F.col("status") == "valid", record_keys(F.col("record"))).alias("source_keys"))
    return (
        keys.select(F.explode("source_keys").alias("source_key"))
        .groupBy("source_key")
        .agg(F.count(F.lit(1)).alias("records"))
    )


INT_FIELDS = ("score", "ups", "downs", "num_comments", "num_crossposts")
BOOL_FIELDS = ("is_self", "over_18")
NUMBER_FIELDS = ("upvote_ratio", "created_utc")
TEXT_IF_NULL = {"author": "[deleted]", "subreddit": "unknown"}


def _clean(lines: DataFrame, choices: dict[str, list[str]], as_of: dt.datetime | Column) -> DataFrame:
    """``(line_pos, status, present, <field>_<n>…)``: each field cleaned as if its key were the n-th of its
    ``choices``; null unless valid. ``present`` has a bit for every choice, in order, that the record has.

    Each raw value, its type and its text are computed once, in projections of their own, and the
    cleaning rules refer to them. All of it is one stage without a shuffle.
    """
    moment = as_of if isinstance(as_of, Column) else F.lit(as_of)
    slots = {f"{name}_{n}": (name, key) for name, keys in choices.items() for n, key in enumerate(keys)}
    typed = [slot for slot, (name, _) in slots.items() if name in INT_FIELDS + BOOL_FIELDS + NUMBER_FIELDS]
    numbers = [slot for slot, (name, _) in slots.items() if name in NUMBER_FIELDS]

    raw = parse_lines(lines).select(
        "line_pos", "status", *[clean.raw_value(F.col("record"), key).alias(f"raw_{slot}") for slot, (_, key) in slots.items()]
    )
    bits = [F.when(F.col(f"raw_{slot}").isNotNull(), F.lit(1 << n)).otherwise(F.lit(0)) for n, slot in enumerate(slots)]
    read = raw.select(
        "*",
        reduce(Column.bitwiseOR, [bit.cast("long") for bit in bits]).alias("present"),
        *[clean.value_text(F.col(f"raw_{slot}")).alias(f"text_{slot}") for slot, (name, _) in slots.items() if name not in BOOL_FIELDS],
        *[clean.value_kind(F.col(f"raw_{slot}")).alias(f"kind_{slot}") for slot in typed],
    )
    parts = lambda slot, *kinds: [F.col(f"{kind}_{slot}") for kind in kinds]
    numbered = read.select("*", *[clean.finite_number(*parts(slot, "raw", "kind", "text")).alias(f"number_{slot}") for slot in numbers])

    def cleaned(slot: str, name: str) -> Column:
        if name == "created_utc":
            return clean.clean_timestamp(*parts(slot, "number", "kind", "text"), moment)
        if name in NUMBER_FIELDS:
            return clean.clean_double(F.col(f"number_{slot}"))
        if name in INT_FIELDS:
            return clean.clean_int(*parts(slot, "raw", "kind", "text"))
        if name in BOOL_FIELDS:
            return clean.clean_bool(*parts(slot, "raw", "kind"))
        return clean.clean_text(*parts(slot, "raw", "text"), TEXT_IF_NULL.get(name, ""))

    valid = F.col("status") == "valid"
    return numbered.select(
        "line_pos", "status", "present", *[F.when(valid, cleaned(slot, name)).alias(slot) for slot, (name, _) in slots.items()]
    )


DERIVED = ("content", "platform")
ALL_CHOICES = {name: FIELD_CANDIDATES.get(name, [name]) for name in POST_COLUMNS if name not in DERIVED}


def _posts_of(choices: DataFrame, chosen: dict[str, int]) -> DataFrame:
    """``(line_pos, status, posts columns…)`` with one choice for each field."""
    columns = {name: F.col(f"{name}_{n}") for name, n in chosen.items()}
    valid = F.col("status") == "valid"
    columns["platform"] = F.when(valid, F.lit("reddit"))
    columns["content"] = clean.join_content(columns["title"], columns["selftext"])
    return choices.select("line_pos", "status", *[columns[name].alias(name) for name in POST_COLUMNS])


def clean_lines(lines: DataFrame, field_map: dict[str, str], as_of: dt.datetime | Column) -> DataFrame:
    """``(line_pos, status, posts columns…)`` for every line by a known field map; the columns are null
    unless valid."""
    keys = {name: [field_map.get(name, known[0])] for name, known in ALL_CHOICES.items()}
    keys["author_fullname"] = ["author_fullname"]
    return _posts_of(_clean(lines, keys, as_of), dict.fromkeys(keys, 0))


def clean_in_one_pass(lines: DataFrame, as_of: dt.datetime | Column) -> tuple[DataFrame, dict[str, str], bool]:
    """``(cleaned lines, field map, whether any is valid)`` where the keys are not known yet.

    Every line is parsed once. All choices of every field are cleaned and stored, those that no
    record has as a column of one value; the keys that occur are observed while they are written,
    and the choice is then which columns to read.
    """
    seen = Observation()
    every = _clean(lines, ALL_CHOICES, as_of)
    observed = every.observe(seen, F.bit_or("present").alias("present"), F.max(F.col("status") == "valid").alias("any_valid"))
    stored = stage(observed.drop("present"), "all-choices", compression="zstd")
    present, any_valid = seen.get["present"] or 0, bool(seen.get["any_valid"])
    chosen, field_map, bit = {}, {}, 0
    for name, keys in ALL_CHOICES.items():
        found = [n for n in range(len(keys)) if present >> (bit + n) & 1]
        bit += len(keys)
        chosen[name] = found[0] if found else 0
        if found and name in FIELD_CANDIDATES:
            field_map[name] = keys[found[0]]
    return _posts_of(stored, chosen), field_map, any_valid


def number_missing_ids(staged: DataFrame) -> DataFrame:
    """Give posts with a blank id ``unknown_n``, n being the number of posts kept before them.

    The kept rows are counted per input split and summed over the splits in order; only splits
    that hold a blank id are numbered row by row. One row per split passes through one task. The
    names are written before they are joined, so that a short list is broadcast and the full rows
    stay where they are.
    """
    narrow = staged.select("post_id", "line_pos")
    if narrow.filter("post_id = ''").isEmpty():
        return staged
    firsts = narrow.filter("post_id <> ''").groupBy("post_id").agg(F.min("line_pos").alias("line_pos"))
    kept = firsts.select("line_pos", F.lit(False).alias("is_blank")).unionByName(
        narrow.filter("post_id = ''").select("line_pos", F.lit(True).alias("is_blank"))
    )
    kept = kept.withColumn("chunk", chunk_of(F.col("line_pos")))
    before = W.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        kept.groupBy("chunk")
        .agg(F.count(F.lit(1)).alias("rows"), F.max("is_blank").alias("has_blank"))
        .withColumn("kept_before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        .filter("has_blank")
        .select("chunk", "kept_before")
    )
    within = W.partitionBy("chunk").orderBy("line_pos")
    names = (
        kept.join(offsets, "chunk")
        .withColumn("n", F.col("kept_before") + F.row_number().over(within) - 1)
        .filter("is_blank")
        .select("line_pos", F.concat(F.lit("unknown_"), F.col("n").cast("string")).alias("given_id"))
    )
    names = stage(names, "given-ids")
    return (
        staged.join(names, "line_pos", "left")
        .withColumn("post_id", F.coalesce("given_id", "post_id"))
        .drop("given_id")
    )


@dataclass(frozen=True)
class IngestResult:
    """``posts``: the cleaned table. ``counters``: one row of line counts. ``field_map``: the keys used."""

    posts: DataFrame
    counters: DataFrame
    field_map: dict[str, str]


def _finish(staged: DataFrame, field_map: dict[str, str]) -> IngestResult:
    valid = staged.filter("status = 'valid'").drop("status")
    numbered = number_missing_ids(valid)
    unique = first_wins(numbered, "post_id", "line_pos")
    per_status = staged.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    distinct_ids = numbered.select("post_id").distinct().agg(F.count(F.lit(1)).alias("kept"))

    def of(condition: str) -> Column:
        return F.coalesce(F.sum(F.when(F.expr(condition), F.col("n"))), F.lit(0))

    lines = per_status.agg(
        of("true").alias("lines"), of("status = 'valid'").alias("valid"), of("status <> 'valid'").alias("skipped")
    )
    counters = (
        lines.unionByName(distinct_ids, allowMissingColumns=True)
        .agg(*[F.max(name).alias(name) for name in ("lines", "valid", "skipped", "kept")])
        .select("lines", "valid", "skipped", (F.col("valid") - F.col("kept")).alias("duplicates"))
    )
    return IngestResult(unique.select(*POST_COLUMNS), counters, field_map)


def ingest_lines(lines: DataFrame, as_of: dt.datetime, field_map: dict[str, str] | None = None) -> IngestResult:
    """Ingest a DataFrame ``(line_pos, line)``. ``as_of`` stands in for unreadable times. Without a
    ``field_map`` the keys of all records decide, in the same pass."""
    if field_map is None:
        cleaned, field_map, _ = clean_in_one_pass(lines, as_of)
        return _finish(cleaned, field_map)
    return _finish(stage(clean_lines(lines, field_map, as_of), "clean-lines", compression="zstd"), field_map)


def ingest_files(spark: SparkSession, path: str | list[str], as_of: dt.datetime) -> IngestResult:
    """Ingest JSON-lines files, each line parsed once. Fails where there is no file or no valid record."""
    cleaned, field_map, any_valid = clean_in_one_pass(read_lines(spark, path), as_of)
    if not any_valid:
        raise ValueError("no valid records in the input")
    return _finish(cleaned, field_map)
