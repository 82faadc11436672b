import glob

from pyspark.sql import functions as F

from tests.llm.conftest import prose
from threadloom.llm import common, repeats


def test_rounds_leave_only_their_spans(spark):
    """What op9's rounds are made from is gone when the spans are known; the result is not."""
    r = [(i, prose(i, 60) + prose(1000 + i % 7, 70) + prose(i + 100, 20)) for i in range(40)]
    docs = spark.createDataFrame(r, "doc_id long, text string")
    folder = common.shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/repeat-*"))
    out = repeats.removed(docs)
    left = set(glob.glob(f"{folder}/repeat-*")) - before
    assert left and {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in left} <= {"repeat-gone", "repeat-spans"}
    assert out.agg(F.sum("n_removed")).first()[0] > 0 and out.count() == 40


def test_discard_of_an_empty_table(spark):
    common.discard(common.cut(spark.range(0), "none"))
