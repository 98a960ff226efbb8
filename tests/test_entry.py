import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry_point
from tarn.session import shared_dir


def test_every_sql_belongs_to_a_query():
    queries, sql = entry_point.queries(), entry_point.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(q) for q in queries.values())
    assert ("pipeline" in queries) == entry_point.HAS_LLM


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_the_flagship_runs(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["grp", "hour", "value"] and df.count() > 0


def test_the_store_needs_no_library_of_the_training_data_operations():
    code = "import sys; sys.modules['sentencepiece'] = None; import __spark_entry__ as e; print(e.HAS_LLM, len(e.queries()), set(e.oracle_sql()) == set(e.queries()))"
    root = os.path.dirname(os.path.abspath(entry_point.__file__))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    from tarn.plans import catalogue

    assert done.stdout.split() == ["False", str(len(catalogue.queries())), "True"], done.stderr[-500:]


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    class Context:
        master = "spark://there:7077"
        getConf = staticmethod(dict)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session)
