import datetime as dt

import pytest
from pyspark.sql import functions as F

from murmurlens.functions import text
from murmurlens.operators import filters, series
from murmurlens.plans import reports


def column(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [row[0] for row in df.orderBy("i").select(build(F.col("v"))).collect()]


def words(v):
    return F.filter(text.word_pieces(v), text.is_topic_word)


def test_topic_words(spark):
    got = column(spark, ["Schönheit und naïve WORDS, foo_bar this Word2vec it's-fine Elections", ""], words)
    assert got == [["words", "fine", "elections"], []]


def test_labels(spark):
    arrays = [["alpha", "beta"], ["alpha"], []]
    df = spark.createDataFrame([(a, "news") for a in arrays], "w array<string>, c string")
    got = [r[0] for r in df.select(text.keyword_label(F.col("w"), F.col("c"))).collect()]
    assert got == ["Alpha & Beta Discussions", "Alpha Discussions", "r/news Topics"]
    tidy = column(spark, ['  "a b" ', "'x'", "one two three four five six seven", "1 2  3 4 5 6 7 8"], text.tidy_label)
    assert tidy == ["a b", "x", "one two three four five six seven", "1 2 3 4 5"]


def test_suggestions(spark):
    default = ["How are communities responding to q?", "Key influencers discussing q", "Timeline of q discussions"]
    got = column(
        spark,
        ["one question\n\n  second one \nabc\nthird here\nfourth here", "a\nb", None],
        lambda v: text.suggestions_or_default(v, F.lit("q")),
    )
    assert got == [["one question", "second one", "third here"], default, default]
    assert column(spark, ["x"], lambda v: text.follow_ups(v, F.lit(False))) == [["Related topics to 'x'", "People discussing 'x'"]]


def test_query_validation(spark):
    asked = [None, "", "   ", "ab", " añ ", " x\n", "a long question"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "query_id int, text string")
    got = {r["query_id"]: (r["query"], r["error"], r["warning"]) for r in filters.validate_queries(df).collect()}
    for blank in (0, 1, 2):
        assert got[blank] == ("", text.EMPTY_QUERY, None)
    for i, short in ((3, "ab"), (4, "añ"), (5, "x")):
        assert got[i] == (short, None, text.SHORT_QUERY % short)
    assert got[6] == ("a long question", None, None)


def test_arguments():
    assert [filters.checked_top_k(k) for k in (1, 7, 1000)] == [1, 7, 1000]
    with pytest.raises(ValueError):
        filters.checked_top_k(0)
    assert [filters.checked_grain(g) for g in ("week", "day", "month", "Week")] == ["week", "day", "day", "day"]
    assert filters.checked_metric("ups") == "score" and filters.checked_metric("num_comments") == "num_comments"


def test_stamp_and_clip(spark):
    times = [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4, 5, 70)]
    utc = [t.replace(tzinfo=dt.timezone.utc) for t in times]
    assert column(spark, utc, text.stamp, "timestamp") == ["2024-01-02 03:04:05+00:00", "2024-01-02 03:04:05.000070+00:00"]
    assert column(spark, ["ééé", None], lambda v: text.clip(v, 2)) == ["éé", ""]
    assert column(spark, ["", "  ", None, " x"], text.text_to_encode) == ["[empty]", "[empty]", "[empty]", " x"]


def test_series_and_trend(spark):
    utc = dt.timezone.utc
    rows = [(str(i), dt.datetime(2024, 1, d, 23, 59, tzinfo=utc), s, "a" if i % 2 else "b") for i, (d, s) in enumerate([(1, 2), (1, None), (7, 4), (8, 4), (8, 5)])]
    posts = spark.createDataFrame(rows, "post_id string, created_utc timestamp, score int, subreddit string")
    day = lambda d: dt.date(2024, 1, d)
    assert dict(map(tuple, series.volume(posts).collect())) == {day(1): 2, day(7): 1, day(8): 2}
    assert dict(map(tuple, series.volume(posts, "week").collect())) == {day(1): 3, day(8): 2}
    assert dict(map(tuple, series.volume(posts, community="a").collect())) == {day(1): 1, day(8): 1}
    engaged = {r["date"]: (r["count"], r["avg_metric"], r["total_metric"]) for r in series.engagement(posts).collect()}
    assert engaged == {day(1): (2, 2.0, 2), day(7): (1, 4.0, 4), day(8): (2, 4.5, 9)}
    nothing = series.engagement(posts.withColumn("score", F.lit(None).cast("int"))).first()
    assert (nothing["avg_metric"], nothing["total_metric"]) == (0.0, 0)
    told = reports.volume_over_time(posts, community="a")
    assert [r["date"] for r in told.points.collect()] == [day(1), day(8)]
    assert told.trend.first()["query"] == "r/a activity"
    assert [r["date"] for r in reports.engagement_over_time(posts, "week").collect()] == [day(1), day(8)]
    trend = series.trend(series.volume(posts), "x").first()
    assert trend["summary"] == 'The query "x" returned 5 posts. Peak activity was on 2024-01-01 with 2 posts.'
    assert trend["data_text"] == "2024-01-01: 2, 2024-01-07: 1, 2024-01-08: 2"
    empty = series.trend(series.volume_of(posts, posts.limit(0)), "x").first()
    assert empty["summary"] == 'No time series data available for "x".' and empty["total_posts"] == 0
