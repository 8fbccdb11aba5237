"""Shipping of the package, and the shared folder, as a cluster needs them."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from tessera import session

ROOT = Path(session.__file__).resolve().parents[1]


class Fake:
    """What the functions ask of a session."""

    def __init__(self, master):
        self.master, self.applicationId, self.files = master, f"app-{master}", []
        self.sparkContext, self.conf = self, self

    def get(self, key, default):
        return default

    def addPyFile(self, path):
        self.files.append(path)


@pytest.mark.parametrize("master", ["yarn", "spark://a:7077", "local-cluster[2,1,1024]", "k8s://https://a"])
def test_a_cluster_needs_a_shared_folder_and_gets_the_package(master, monkeypatch):
    with pytest.raises(RuntimeError):
        session.shared_dir(Fake(master))
    # The driver's folder says nothing of other hosts.
    monkeypatch.setenv("PYTHONPATH", str(ROOT))
    monkeypatch.chdir(ROOT)
    fake = Fake(master)
    session.ship_package(fake)
    session.ship_package(fake)
    assert len(fake.files) == 1 and fake.files[0].endswith("tessera.zip")


def test_library_calls_from_another_folder(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from tessera.session import Scratch, build_session
from tessera.functions import vowel_share, words
spark = build_session("t", "local[1]", spark__ui__enabled="false", spark__checkpoint__dir={str(tmp_path)!r})
df = spark.createDataFrame([(1, "two words")], "id long, text string")
print(Scratch(spark, "t").table(df.select(vowel_share("text").alias("v"))).collect(), words(df).collect())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "place=1" in done.stdout, done.stderr[-2000:]


def test_buckets_spare_a_shuffle_and_go_with_their_folder(spark):
    scratch = session.Scratch(spark, "buckets")
    held = scratch.bucketed(spark.range(100).selectExpr("id as k", "id % 7 as v"), "k")
    asked = spark.range(0, 200, 3).hint("merge").withColumnRenamed("id", "k")
    met = asked.join(held, "k")
    assert met.count() == 34 and held.count() == 100
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert scratch.bucketed(held.limit(0), "k").count() == 0
    scratch.drop_all()
    assert not Path(scratch.root).exists() and not [t for t in spark.catalog.listTables() if t.name.startswith("tessera_")]
