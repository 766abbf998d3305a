import os

import pytest

from factorweave.llm import common


def test_saved_tables_are_deleted(spark):
    df = common.saved(spark.range(3), "test-table")
    path = common._made[-1].removeprefix("file://")
    assert df.count() == 3 and os.path.isdir(path)
    own = []
    common.saved(spark.range(3), "test-table", own)
    kept = own[0].removeprefix("file://")
    common.delete(spark, own)
    assert not os.path.exists(kept) and own == [] and os.path.isdir(path)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
