import os

import pytest
from pyspark.sql import functions as F

from vellumgrid.llm.common import materialize, retain, scratch, shared_dir, words


def test_tables_of_a_block_go_but_for_the_retained(spark):
    with scratch(spark):
        gone = materialize(spark.range(5), "gone")
        with scratch(spark):
            inner = retain(materialize(spark.range(3), "inner", rows=3))
        kept = retain(materialize(spark.range(4), "kept"))
        assert gone.count() == 5 and inner.count() == 3
    here = lambda t: os.path.exists(t._own_path.removeprefix("file://"))
    assert here(kept) and not here(gone) and not here(inner) and kept.count() == 4


def test_tables_go_when_a_block_fails(spark):
    with pytest.raises(RuntimeError), scratch(spark):
        lost = materialize(spark.range(5), "lost")
        raise RuntimeError
    assert not os.path.exists(lost._own_path.removeprefix("file://"))


def test_shared_folder_is_the_sessions():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: "hdfs://shared/dir/" if key == "spark.checkpoint.dir" else default)

    assert shared_dir(Session) == "hdfs://shared/dir"


def test_words(spark):
    rows = [(0, None), (1, ""), (2, " \t\n\x0b\x0c\r "), (3, "a  b\nc"), (4, " x y")]
    got = {r.i: r.w for r in spark.createDataFrame(rows, "i int, t string").select("i", words(F.col("t")).alias("w")).collect()}
    assert got == {0: [], 1: [], 2: [], 3: ["a", "b", "c"], 4: [" x y"]}
