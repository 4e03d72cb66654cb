import datetime as dt

from checks.fixtures import Inputs
from murmurlens.schema import POST_COLUMNS


def write_tables(spark, folder):
    at = dt.datetime(2024, 1, 1)
    documents = [(1, "same words", "en", "web"), (2, "same words", "en", "web"), (3, " other  ", None, "web"), (4, None, "en", "web"),
                 (5, "no event", "en", "web"), (3, "third again", "en", "wiki"), (None, "no id", "en", "web")]
    events = [(5, at, 7, "view", 1.9, '{"k": 4}'), (10, at, 8, "view", -1.5, '{"k": 5}'), (15, at, 25, "buy", 2.0, "x6y"), (15, at, 26, "buy", 3.0, "7"),
              (20, None, None, None, None, None), (None, at, 9, "view", 1.0, "8"), (16, at, 9, "view", 1.0, "{}")]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(
        f"{folder}/events.parquet"
    )
    spark.createDataFrame([(2, 1), (3, 0), (None, 1)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_posts_store_their_text_once_and_the_graph_reads_none(spark, tmp_path):
    write_tables(spark, tmp_path)
    tables = Inputs(spark, str(tmp_path))
    tables.authors().count()
    tables.edges().count()
    assert "posts" not in tables.stored._tables

    posts = tables.posts()
    assert posts.columns == POST_COLUMNS
    got = sorted((r.post_id, r.title, r.content, r.author, r.subreddit, r.num_crossposts, r.crosspost_parent, r.over_18) for r in posts.collect() if r.post_id < "3")
    assert got == [
        ("1", "same words", "same words same words", "u7", "web-en", 1, "", False),
        ("2", "same words", "same words same words", "u8", "web-en", 0, "t3_1", True),
    ]
    # Two documents and two events of one id are four posts; a text of null stays null.
    assert sorted((r.post_id, r.selftext, r.content) for r in posts.filter("post_id = '3'").collect()) == [
        *[("3", " other  ", " other    other  ".strip())] * 2,
        *[("3", "third again", "third again third again")] * 2,
    ]
    assert [(r.title, r.content, r.author) for r in posts.filter("post_id = '4'").collect()] == [(None, None, None)]
    whole = {name for name in tables.stored._tables["posts"].columns if name in ("title", "selftext", "content")}
    assert whole == {"selftext"}
    plain = tables.posts_without_text()
    assert sorted(map(repr, plain.select(sorted(plain.columns)).collect())) == sorted(map(repr, posts.select(sorted(plain.columns)).collect()))


def test_named_tables_are_stored_with_zstd(spark, tmp_path):
    from murmurlens.runtime import Workspace

    table = Workspace(spark).table("texts", lambda: spark.createDataFrame([("a text",)], "text string"))
    assert all(name.endswith(".zstd.parquet") for name in table.inputFiles())
    assert [row.text for row in table.collect()] == ["a text"]
