import pytest

from versemill.session import materialize, scratch


def test_scratch_deletes_what_it_wrote_but_what_is_kept(spark):
    before = materialize(spark.range(3), "before")
    with scratch(spark):
        inner = materialize(spark.range(5), "inner")
        kept = materialize(inner, "kept", keep=True)
        with pytest.raises(ZeroDivisionError), scratch(spark):
            lost = materialize(spark.range(2), "lost")
            raise ZeroDivisionError
        assert inner.count() == 5
    assert before.count() == 3 and kept.count() == 5
    for gone in (inner, lost):
        with pytest.raises(Exception, match="(?i)not.*exist|FILE_NOT"):
            spark.read.schema(gone.schema).parquet(gone.inputFiles()[0]).count()
