import subprocess
import sys

from kbspark.plans import skew
from kbspark.plans.skew import heavy_keys, join_skewed
from kbspark.plans.spread import spread

SCRIPT = """
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from kbspark.plans.lineage import cut_lineage, ensure_checkpoint_dir
b = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false')
if {named!r}:
    b = b.config('spark.checkpoint.dir', {named!r})
s = b.getOrCreate()
df = cut_lineage(s.range(5))
print('AT', ensure_checkpoint_dir(s), df.count())
"""


def test_checkpoints_go_where_the_session_says(tmp_path):
    root = __file__.rsplit("/", 2)[0]
    for named in (f"file://{tmp_path}/shared", ""):
        out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root, named=named)], capture_output=True, text=True).stdout
        at = next(x for x in out.splitlines() if x.startswith("AT")).split()
        assert at[2] == "5" and (str(tmp_path) in at[1]) == bool(named)
    assert any((tmp_path / "shared").rglob("part-*"))


def test_heavy_keys(spark):
    df = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i}", i) for i in range(300)] + [(None, 1)] * 200, "k string, v long")
    assert [r.k for r in heavy_keys(df, ["k"], 16).collect()] == ["hot"]
    assert heavy_keys(df.limit(0), ["k"]).count() == 0


def test_spread(spark):
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() >= 8
    assert spread(spark.range(10).repartition(20)).rdd.getNumPartitions() == 20


def test_join_skewed_is_a_join(spark, monkeypatch):
    left = spark.createDataFrame([("hot" if i % 2 else f"k{i % 40}", i) for i in range(2000)] + [(None, 1)], "k string, v long")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k2", 3), ("k99", 4), (None, 5)], "k string, w long")
    want = sorted(map(tuple, left.join(right, "k").collect()))
    assert sorted(map(tuple, join_skewed(left, right, ["k"]).collect())) == want
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 1)
    assert sorted(map(tuple, join_skewed(left, right, ["k"]).collect())) == want
    assert join_skewed(left.limit(0), right, ["k"]).count() == 0
