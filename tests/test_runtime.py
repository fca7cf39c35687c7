import time
from types import SimpleNamespace

import pytest

from lemmata.plans import runtime


def fake(master, folder=None, conf=None):
    sc = SimpleNamespace(master=master, folder=folder)
    sc.getCheckpointDir = lambda: sc.folder
    sc.setCheckpointDir = lambda f: setattr(sc, "folder", f)
    return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: conf))


def test_a_cluster_without_a_shared_folder_is_an_error_that_names_the_setting():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_folder(fake("spark://host:7077"))


def test_the_setting_holds_and_a_local_session_makes_its_own():
    assert runtime.shared_folder(fake("spark://host:7077", conf="hdfs://x/y")) == "hdfs://x/y"
    s = fake("local[2]")
    first = runtime.shared_folder(s)
    assert first.startswith("file:") and runtime.shared_folder(s) == first


def test_release_deletes_what_was_written(spark):
    df = runtime.materialize(spark.range(5).toDF("x"), "gone")
    assert df.count() == 5 and "gone" in df.inputFiles()[0]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(runtime.run_folder(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert fs.exists(path)
    runtime.release(spark)
    assert not fs.exists(path)
    assert runtime.materialize(spark.range(2).toDF("x"), "again").count() == 2


def test_shuffle_files_end_with_the_table_that_needed_them(spark):
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split()
        return {f for f in files if "/shuffle_" in f}

    setting, before = spark.conf.get(runtime.FILE_CLEANUP, None), shuffles()
    t = runtime.materialize(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count())
    for _ in range(50):  # files are deleted in the background
        if not (left := shuffles() - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(runtime.FILE_CLEANUP, None) == setting
    assert {r["k"] for r in t.collect()} == set(range(7))
