import os

import pytest
from py4j.protocol import Py4JError

from tidemark import runtime


def place(df):
    return df._tidemark_path.removeprefix("file:").replace("//", "/")


def test_tables_go_with_their_scope(spark):
    kept = []
    with runtime.scope():
        with runtime.scope(kept):
            a, b = runtime.materialise(spark.range(3), "a"), runtime.materialise(spark.range(4), "b")
            kept.append(b)
        assert not os.path.exists(place(a)) and b.count() == 4
        c = runtime.materialise(spark.range(5), "c")
        runtime.release(c)
        assert not os.path.exists(place(c))
    assert not os.path.exists(place(b))


def test_tables_go_when_work_fails(spark):
    with pytest.raises(KeyError), runtime.scope():
        a = runtime.materialise(spark.range(3), "a")
        raise KeyError
    assert not os.path.exists(place(a))


class Session:
    """As much of a session as is asked for a folder."""

    def __init__(self, master, folder=None):
        self.conf, self.sparkContext, self.master = {runtime.SETTING: folder}, self, master

    def getConf(self):
        return {}


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session(master))
    assert runtime.shared_dir(Session(master, "hdfs:///x/")) == "hdfs:///x"
    assert os.path.isdir(runtime.shared_dir(Session("local[2]")).removeprefix("file://"))


def test_native_memory_is_given_back(spark):
    jvm = spark.sparkContext._jvm
    if not os.path.exists("/proc/self/smaps") or "glibc" not in os.confstr("CS_GNU_LIBC_VERSION") or jvm.java.lang.Runtime.version().compareTo(jvm.java.lang.Runtime.Version.parse("17.0.9")) < 0:
        pytest.skip("no command for it")
    assert runtime.trim(spark)


def test_without_the_command_nothing_is_trimmed(spark):
    class Gateway:
        def new_array(self, *_):
            raise Py4JError("no such command")

    class Context:
        _jvm, _gateway = spark.sparkContext._jvm, Gateway()

    class Other:
        sparkContext = Context()

    assert not runtime.trim(Other())


def test_tables_are_followed_by_a_trim_only_inside_the_block(spark, monkeypatch):
    done = []
    monkeypatch.setattr(runtime, "trim", done.append)
    with runtime.scope():
        runtime.materialise(spark.range(3), "a")
        assert not done
        with pytest.raises(KeyError), runtime.trimming(spark):
            runtime.materialise(spark.range(3), "b")
            assert len(done) == 2
            raise KeyError
        runtime.materialise(spark.range(3), "c")
    assert len(done) == 3


def test_every_stage_of_the_pipeline_trims(spark, monkeypatch):
    import corpus_pipeline as pipeline

    done = []
    monkeypatch.setattr(runtime, "trim", done.append)
    for name, stage in pipeline.STAGES:
        seen = len(done)
        with pytest.raises(Exception):  # noqa: B017  there are no tables
            stage(spark, None, "/nowhere")
        assert len(done) == seen + 2, name
