import os

import pytest

from lodestone.llm import common, exact

from .helpers import docs


def test_folder_and_clear(spark):
    rows = exact.kept_documents(docs(spark, [(1, "a"), (2, "A"), (3, "b")])).collect()
    assert sorted(r.doc_id for r in rows) == [2, 3]
    folder = common.run_dir(spark).removeprefix("file://")
    assert os.listdir(folder)
    common.clear(spark)
    assert not os.path.exists(folder)
    assert exact.dedup(docs(spark, [(1, "a")])).count() == 1  # the next run makes it anew


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                class sc:
                    class getCheckpointDir:
                        isDefined = staticmethod(lambda: False)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_one_operator_state_at_a_time():
    assert common.held(("a",), lambda: [1]) is common.held(("a",), lambda: [2])
    common.held(("b",), lambda: [3])
    assert common.held(("a",), lambda: [4]) == [4]
