import datetime as dt
import json

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from murmurlens.operators import ingest
from murmurlens.schema import POST_COLUMNS
from murmurlens.sources import posts as store
from murmurlens.sources.lines import number_lines, read_lines

AS_OF = dt.datetime(2024, 6, 1)
UTC_EPOCH = 1_700_000_000


def envelope(**data):
    return json.dumps({"kind": "t3", "data": data})


GOLDEN = [
    envelope(id="a", title="First", selftext="body", author="x", subreddit="s", score=12.7, over_18=True, created_utc=UTC_EPOCH),
    "",
    "   ",
    '{"a":',
    json.dumps({"id": "b", "author": "y", "score": "12", "over_18": "false", "created_utc": str(UTC_EPOCH)}),
    '{"foo":1}',
    "5",
    "null",
    "[]",
    json.dumps({"id": "c", "data": "s", "title": "t", "author": None, "subreddit": None, "score": "12.7", "over_18": ""}),
    envelope(id=" a ", title="Second"),
    envelope(title="no id", created_utc="2024-01-03T05:00:00Z", score="x", over_18=0),
    envelope(id="d", title="  ", selftext=" only body ", created_utc="2024-01-03T05:00:00+02:00", score=None, over_18=None),
    envelope(id="e", created_utc="junk", score=True, author=True, over_18=[]),
    envelope(id="", title="again no id", created_utc=None, over_18=[1], score=-3.9, upvote_ratio="0.5"),
    envelope(id="f", created_utc=1700000000.5, score=99999999999, upvote_ratio="x", over_18="0"),
    envelope(id=7, title=1.5, score="1_000", upvote_ratio=1),
]


@pytest.fixture(scope="module")
def golden(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("golden") / "posts.jsonl"
    path.write_text("\n".join(GOLDEN) + "\n", encoding="utf-8")
    return ingest.ingest_files(spark, str(path), AS_OF)


@pytest.fixture(scope="module")
def by_id(golden):
    return {row["post_id"]: row for row in golden.posts.collect()}


def test_rows_and_counters(golden, by_id):
    assert golden.posts.columns == POST_COLUMNS
    assert set(by_id) == {"a", "b", "c", "unknown_3", "d", "e", "unknown_6", "f", "7"}
    counters = golden.counters.first()
    assert (counters["lines"], counters["valid"], counters["skipped"], counters["duplicates"]) == (17, 10, 7, 1)


def test_first_duplicate_wins(by_id):
    assert by_id["a"]["title"] == "First"


def test_text_defaults(by_id):
    assert by_id["c"]["author"] == "[deleted]" and by_id["c"]["subreddit"] == "unknown"
    assert by_id["d"]["author"] == "" and by_id["d"]["subreddit"] == ""
    assert by_id["e"]["author"] == "True"
    assert by_id["7"]["title"] == "1.5"
    assert by_id["d"]["content"] == "only body" and by_id["a"]["content"] == "First body"
    assert all(row["platform"] == "reddit" for row in by_id.values())


def test_numbers(by_id):
    scores = {key: row["score"] for key, row in by_id.items()}
    assert scores == {"a": 12, "b": 12, "c": 0, "unknown_3": 0, "d": 0, "e": 1, "unknown_6": -3, "f": 0, "7": 1000}
    assert by_id["unknown_6"]["upvote_ratio"] == 0.5
    assert by_id["f"]["upvote_ratio"] == 0.0 and by_id["7"]["upvote_ratio"] == 1.0


def test_truthiness(by_id):
    truth = {key: row["over_18"] for key, row in by_id.items()}
    assert truth == {
        "a": True, "b": True, "c": False, "unknown_3": False, "d": False, "e": False, "unknown_6": True, "f": True, "7": False,
    }


def test_times(golden):
    epoch = F.unix_micros("created_utc").alias("t")
    times = {row["post_id"]: row["t"] / 1e6 for row in golden.posts.select("post_id", epoch).collect()}
    five = dt.datetime(2024, 1, 3, 5, tzinfo=dt.timezone.utc).timestamp()
    as_of = AS_OF.replace(tzinfo=dt.timezone.utc).timestamp()
    assert times["a"] == times["b"] == UTC_EPOCH
    assert times["f"] == UTC_EPOCH + 0.5
    assert times["unknown_3"] == five and times["d"] == five - 7200
    assert times["e"] == times["unknown_6"] == times["c"] == as_of


def test_second_candidate_keys(spark, tmp_path):
    path = tmp_path / "alt.jsonl"
    path.write_text(json.dumps({"name": "n1", "body": "text", "author": "x", "created": UTC_EPOCH, "upvotes": 4}))
    result = ingest.ingest_files(spark, str(path), AS_OF)
    row = result.posts.first()
    assert (row["post_id"], row["selftext"], row["ups"]) == ("n1", "text", 4)
    assert result.field_map["post_id"] == "name" and result.field_map["created_utc"] == "created"


def test_sample_reads_past_invalid_lines(spark):
    lines = [(n, "junk") for n in range(3000)] + [(3000, json.dumps({"name": "late", "author": "z"}))]
    numbered = number_lines(spark.createDataFrame(lines, "n long, line string"), "n")
    assert ingest.as_field_map(ingest.detect_fields(numbered)) == {"post_id": "name", "author": "author"}


def test_file_order_decides_over_many_splits_and_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    expected, n = {}, 0
    for part in range(3):
        rows = []
        for i in range(400):
            key = f"k{(i * 7 + part) % 150}"
            rows.append(json.dumps({"id": key, "title": f"{part}-{i}", "author": "x"}))
            expected.setdefault(key, f"{part}-{i}")
            n += 1
        (folder / f"part-{part}.jsonl").write_text("\n".join(rows) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        assert read_lines(spark, str(folder)).select("line_pos").distinct().count() == n
        result = ingest.ingest_files(spark, str(folder), AS_OF)
        assert {row["post_id"]: row["title"] for row in result.posts.collect()} == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_missing_ids_are_numbered_by_kept_posts(spark):
    rows, kept, seen, expected = [], 0, set(), []
    for n in range(500):
        key = "" if n % 7 == 0 else f"k{n % 90}"
        rows.append((n * 911, json.dumps({"id": key, "title": str(n), "author": "x"})))
        if not key:
            expected.append((f"unknown_{kept}", str(n)))
            kept += 1
        elif key not in seen:
            seen.add(key)
            expected.append((key, str(n)))
            kept += 1
    lines = number_lines(spark.createDataFrame(rows, "n long, line string").repartition(5), "n")
    got = ingest.ingest_lines(lines, AS_OF).posts.select("post_id", "title").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_no_valid_record_fails(spark, tmp_path):
    path = tmp_path / "bad.jsonl"
    path.write_text("5\n\n{\n")
    with pytest.raises(ValueError):
        ingest.ingest_files(spark, str(path), AS_OF)
    with pytest.raises(Exception):
        ingest.ingest_files(spark, str(tmp_path / "absent.jsonl"), AS_OF)


def test_store_replace_insert_and_load_once(spark, golden, tmp_path):
    path = str(tmp_path / "posts")
    first = golden.posts.filter("post_id IN ('a', 'b')")
    assert store.replace_posts(first, path).count() == 2
    incoming = golden.posts.unionByName(golden.posts.withColumn("title", F.lit("later")))
    order = W.orderBy(F.when(F.col("title") == "later", 1).otherwise(0), "post_id")
    incoming = incoming.withColumn("position", F.row_number().over(order))
    stored = store.insert_posts(incoming, path, "position")
    assert stored.count() == golden.posts.count()
    assert stored.filter("title = 'later'").count() == 0
    assert store.load_once(spark, path, lambda: pytest.fail("must not rebuild")).count() == stored.count()
    assert store.load_once(spark, str(tmp_path / "fresh"), lambda: first).count() == 2


def test_preview_and_profile(spark):
    long = "x" * 100
    rows = [(0, envelope(id="a", title=long, score=3, over_18=True, selftext=None)), (1, "bad"), (2, envelope(id="b"))]
    lines = number_lines(spark.createDataFrame(rows, "n long, line string"), "n")
    preview = {(r["record_no"], r["source_key"]): r["preview"] for r in ingest.preview_records(lines).collect()}
    assert preview[(1, "title")] == "x" * 80 + "..." and preview[(1, "over_18")] == "True"
    assert preview[(1, "selftext")] == "None" and preview[(2, "id")] == "b"
    profile = {r["source_key"]: r["records"] for r in ingest.profile_keys(lines).collect()}
    assert profile == {"id": 2, "title": 1, "score": 1, "over_18": 1, "selftext": 1}


def test_fields_of_late_records_are_found(spark):
    lines = [json.dumps({"id": f"a{i}", "title": "t"}) for i in range(10)]
    lines += [json.dumps({"id": f"b{i}", "title": "t", "body": "late", "upvotes": 7}) for i in range(50)]
    numbered = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "line_pos long, line string")
    assert ingest.as_field_map(ingest.detect_fields(numbered, sample=10)).keys() == {"post_id", "title"}
    found = ingest.ingest_lines(numbered, as_of=dt.datetime(2024, 1, 1))
    assert found.posts.filter("selftext = 'late'").count() == 50 and found.posts.filter("ups = 7 OR score = 7").count() == 50


def test_every_line_is_read_and_parsed_once(spark, monkeypatch):
    """The field map, the cleaned columns and the counters come from one pass over the lines."""
    read = spark.sparkContext.accumulator(0)
    rows = [(i, json.dumps({"name": f"n{i}", "body": "b", "author": "x"} if i % 2 else {"id": f"i{i}", "author": None})) for i in range(300)]

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    lines = spark.createDataFrame(rows, "line_pos long, line string").repartition(3).mapInArrow(count, "line_pos long, line string")
    parsed, real = [], ingest.parse_lines
    monkeypatch.setattr(ingest, "parse_lines", lambda df: parsed.append(1) or real(df))
    done = ingest.ingest_lines(lines, AS_OF)
    assert done.field_map == {"post_id": "id", "selftext": "body", "author": "author"}
    assert done.posts.filter("selftext = 'b'").count() == 150
    counters = done.counters.first()
    assert (counters["lines"], counters["valid"], counters["duplicates"]) == (300, 300, 0)
    assert (read.value, len(parsed)) == (300, 1)


def test_one_pass_equals_a_known_field_map(spark):
    lines = number_lines(spark.createDataFrame([(i, line) for i, line in enumerate(GOLDEN)], "n long, line string"), "n")
    known = ingest.as_field_map(ingest.detect_fields(lines))
    one, two = ingest.ingest_lines(lines, AS_OF), ingest.ingest_lines(lines, AS_OF, known)
    assert one.field_map == known
    assert sorted(one.posts.collect(), key=repr) == sorted(two.posts.collect(), key=repr)
    assert one.counters.collect() == two.counters.collect()
    empty = ingest.ingest_lines(lines.limit(0), AS_OF)
    assert empty.field_map == {} and empty.posts.count() == 0
