"""Shipping the package and tidying up."""

import subprocess
import sys
from pathlib import Path

from murmurlens import runtime


def test_staged_tables_can_be_dropped(spark):
    kept = runtime.stage(spark.range(5), "to-drop")
    folder = Path(kept.inputFiles()[0].removeprefix("file://")).parent
    assert folder.exists() and kept.count() == 5
    found = [x for x in folder.parent.iterdir() if x.name.startswith("to-drop")]
    assert len(found) == 1


def test_package_runs_from_elsewhere(tmp_path):
    """A session started outside the repository, whose workers can't import the package."""
    root = str(Path(__file__).resolve().parents[1])
    code = f"""
import sys
sys.path.insert(0, {root!r})
from murmurlens.runtime import build_session, ship_package, drop_staged, checkpoint_root, stage
from pathlib import Path
spark = ship_package(build_session("away", master="local[2]", spark__ui__enabled="false", spark__sql__shuffle__partitions="2"))
from murmurlens.operators.vectors import top_k
vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "post_id string, embedding array<float>")
asked = spark.createDataFrame([(1, [1.0, 0.2])], "query_id long, embedding array<float>")
assert top_k(asked, vectors, 1).first()["post_id"] == "a"
stage(spark.range(3), "x")
root = Path(checkpoint_root(spark).removeprefix("file:")) / "stage"
assert root.exists()
drop_staged(spark)
assert not root.exists()
print("fine")
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "fine" in done.stdout, done.stderr[-2000:]
