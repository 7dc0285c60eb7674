"""Reading and writing: manifests, stages, partials, score files, issues."""

import json
import tempfile
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from imgaudit import schemas
from imgaudit.operators import reports
from imgaudit.session import clear, shared_dir, stored
from imgaudit.sources import claims, issues, manifests, sinks


@pytest.fixture(scope="module")
def manifest(spark):
    return spark.createDataFrame([("a,b.jpg", 1, "of_x", "s1"), ('c"d.jpg', 0, "of_real_y", "s2")],
                                 schemas.MANIFEST)


def test_manifest_round_trip(spark, manifest, tmp_path):
    manifests.write_manifest(manifest, f"{tmp_path}/m")
    back = manifests.load_manifests(spark, [f"{tmp_path}/m"])
    assert back.schema == schemas.MANIFEST
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, manifest.collect()))


def test_missing_manifest(spark, manifest, tmp_path):
    manifests.write_manifest(manifest, f"{tmp_path}/m")
    paths = [f"{tmp_path}/m", f"{tmp_path}/none"]
    with pytest.warns(UserWarning, match="missing manifest"):
        assert manifests.load_manifests(spark, paths, "skip").count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        manifests.load_manifests(spark, paths).count()


def test_positions_run_on_over_files(spark, tmp_path):
    """Files of several sizes, one empty, whose names do not sort as their rows do."""
    schema = "doc_id long, source string, lang string"
    for name, low, high in (("part-10", 0, 7), ("part-9", 7, 8), ("part-1", 8, 300), ("part-0", 300, 300), ("part-2", 300, 311)):
        folder = tmp_path / "one" / name
        spark.createDataFrame([(i, f"s{i % 3}", None) for i in range(low, high)], schema).coalesce(1).write.parquet(str(folder))
        (tmp_path / "documents.parquet").mkdir(exist_ok=True)
        next(folder.glob("*.parquet")).rename(tmp_path / "documents.parquet" / f"{name}.parquet")
    rows = driver.queries()["scan_shards"](spark, str(tmp_path))
    assert sorted(rows.columns) == ["doc_id", "lang", "row_index", "source"]
    assert sorted((r.doc_id, r.row_index) for r in rows.collect()) == [(i, i) for i in range(311)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_stage_runs_once_and_again_after_a_broken_write(spark, manifest, tmp_path):
    path, runs = f"{tmp_path}/stage", []

    def build():
        runs.append(1)
        return manifest
    for _ in range(2):
        assert sinks.run_stage(spark, path, build).count() == 2
    assert len(runs) == 1
    (tmp_path / "stage" / "_SUCCESS").unlink()
    assert sinks.run_stage(spark, path, build).count() == 2
    assert len(runs) == 2


def test_drivers_that_start_together_build_once(spark, manifest, tmp_path):
    path, runs, counts = str(tmp_path / "stage"), [], []

    def build():
        runs.append(1)
        time.sleep(2)
        return manifest

    def driver():
        counts.append(sinks.run_stage(spark, path, build, lease=30, poll=0.2).count())

    threads = [threading.Thread(target=driver) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert len(runs) == 1 and counts == [2] * 4
    assert [name for name in os.listdir(tmp_path) if not name.startswith(".")] == ["stage"]


def test_claim_of_a_lost_driver_is_taken_over(spark, manifest, tmp_path):
    path = str(tmp_path / "stage")
    lost = claims.Claim(spark, f"{path}-claim", lease=3)
    assert lost.take() and not claims.Claim(spark, f"{path}-claim", lease=3).take()
    time.sleep(5)
    assert lost.held()  # a living driver's claim goes on
    lost._done.set()  # and now it is gone
    started = time.time()
    assert sinks.run_stage(spark, path, lambda: manifest, lease=3, poll=0.2).count() == 2
    assert time.time() - started > 1 and not lost.held()


def test_late_driver_changes_nothing(spark, manifest, tmp_path):
    """Its claim was lost while it was building, and another has finished meanwhile."""
    path = str(tmp_path / "stage")

    def build():
        os.remove(f"{path}-claim")
        sinks.run_stage(spark, path, lambda: manifest.limit(1))
        return manifest
    assert sinks.run_stage(spark, path, build).count() == 1
    assert [name for name in os.listdir(tmp_path) if not name.startswith(".")] == ["stage"]


def test_failed_build_leaves_no_claim(spark, manifest, tmp_path):
    path = str(tmp_path / "stage")
    with pytest.raises(ZeroDivisionError):
        sinks.run_stage(spark, path, lambda: 1 // 0)
    assert sinks.run_stage(spark, path, lambda: manifest).count() == 2


def test_only_named_stages_run(spark, manifest, tmp_path):
    stages = {name: lambda: manifest for name in ("a", "b", "c")}
    assert set(sinks.run_stages(spark, str(tmp_path), stages, ["b"])) == {"b"}
    assert not (tmp_path / "a").exists()


def test_partials_replace_only_their_group(spark, tmp_path):
    def part(gid, value):
        return spark.createDataFrame([(value, gid)], "v int, gid int")
    for gid, value in ((0, 1), (1, 2), (0, 3)):
        sinks.write_partial(part(gid, value), f"{tmp_path}/p")
    assert {(r.gid, r.v) for r in sinks.merge_partials(spark, f"{tmp_path}/p").collect()} == {
        (0, 3), (1, 2)}


def test_scores_with_and_without_a_field(spark, tmp_path):
    rows = [{"file": "a", "score": 0.5}, {"file": "b", "score": 1e-5}]
    (tmp_path / "plain.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "under.json").write_text(json.dumps({"images": rows}, indent=1))
    plain = manifests.read_scores(spark, f"{tmp_path}/plain.json").collect()
    under = manifests.read_scores(spark, f"{tmp_path}/under.json", "images").collect()
    assert sorted(plain) == sorted(under) and len(plain) == 2


def test_issues_to_csv(spark, tmp_path):
    rows = [{"number": i, "title": "t", "body": 'say "hi",\nthere', "createdAt": f"2025-01-0{i}T00:00:00Z",
             "labels": [{"name": "misclassification" if i < 4 else "bug"}]} for i in range(1, 6)]
    (tmp_path / "issues.json").write_text(json.dumps(rows))
    found = issues.read_issues(spark, f"{tmp_path}/issues.json", limit=2)
    assert sorted(r.number for r in found.collect()) == [2, 3]
    mined = reports.mine_reports(found).withColumn("evidence", F.lit('say "hi",\nthere'))
    issues.write_reports_csv(mined, f"{tmp_path}/out")
    back = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/out").collect()
    assert {r.evidence for r in back} == {'say "hi", there'}


def test_all_issues_without_a_limit(spark, tmp_path):
    rows = [{"number": i, "title": "t", "body": "", "createdAt": "2025-01-01T00:00:00Z",
             "labels": [{"name": "misclassification"}]} for i in range(700)]
    (tmp_path / "issues.json").write_text(json.dumps(rows))
    assert issues.read_issues(spark, f"{tmp_path}/issues.json").count() == 700


class Session:
    """Stands for a session with another master and folder; both are fixed in a real one."""

    def __init__(self, master, folder):
        self.conf = {} if folder is None else {"spark.checkpoint.dir": folder}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-1"})


def test_shared_dir_follows_the_session(spark):
    path = shared_dir(Session("yarn", "hdfs://a/b"), "x")
    assert path.startswith("hdfs://a/b/imgaudit/app-1/x-")
    assert path != shared_dir(Session("yarn", "hdfs://a/b"), "x")
    assert shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir", tempfile.gettempdir()))


def test_a_cluster_must_name_its_folder():
    for master in ("yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,512]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(Session(master, None), "x")
    first, second = (shared_dir(Session(master, None), "x") for master in ("local[4]", "local"))
    assert os.path.dirname(first) == os.path.dirname(second)


def test_clear_removes_this_application_only(spark):
    table = stored(spark.range(3), "t")
    folder = os.path.dirname(os.path.dirname(table.inputFiles()[0]).removeprefix("file://"))
    other = os.path.join(os.path.dirname(folder), "another-application")
    os.makedirs(other, exist_ok=True)
    assert table.count() == 3 and os.path.basename(folder) == spark.sparkContext.applicationId
    clear(spark)
    assert os.path.isdir(other) and not os.path.exists(folder)


def test_stored_table_is_the_same(spark, manifest):
    assert sorted(map(tuple, stored(manifest, "t").collect())) == sorted(map(tuple, manifest.collect()))
