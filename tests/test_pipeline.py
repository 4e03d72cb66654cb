"""The batch in one call, twice on one folder."""

import datetime as dt
import json

from murmurlens.plans.pipeline import prepare


def test_prepare_loads_once(spark, tmp_path):
    rows = [
        {"id": f"p{i}", "title": "storm coast water" if i % 2 else "election votes party", "selftext": f"text {i}", "author": f"a{i % 7}", "subreddit": f"s{i % 3}", "created_utc": 1_700_000_000 + i}
        for i in range(30)
    ]
    lines = tmp_path / "dump.jsonl"
    lines.write_text("\n".join(json.dumps({"data": row}) for row in rows))
    options = {"as_of": dt.datetime(2024, 1, 1), "dimensions": 16, "n_clusters": 2, "restarts": 1, "project": False}
    first = prepare(spark, str(lines), str(tmp_path / "store"), **options)
    assert first.posts.count() == first.vectors.count() == 30
    assert first.graph.nodes.count() == 7 and first.topics.clustering.n_clusters == 2
    lines.write_text("")
    again = prepare(spark, str(lines), str(tmp_path / "store"), **options)
    assert again.posts.count() == 30
