from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_neardup import brute_kept
from versemill.llm import decontaminate, quality, toxicity
from versemill.session import materialize, table

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    labels, bench = table(spark, SF, "labels"), table(spark, SF, "benchmark")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        docs = materialize(stage(spark, docs, SF), name)
        if name == "packing":
            assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == ids
            break
        assert docs.columns == names
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "quality":
            want = {r.doc_id for r in quality.score_quality(before, labels).collect() if r.predicted}
        elif name == "toxicity":
            want = {r.doc_id for r in toxicity.score_toxicity(before, labels).collect() if not r.predicted}
        elif name == "near_dedup":
            want = set(brute_kept([(r.doc_id, r.text) for r in before.collect()]))
        else:
            want = kept
            assert decontaminate.leak_digest(decontaminate.find_leaks(docs, bench)).filter("contaminated").count() == 0
            hit = {r.doc_id for r in decontaminate.leak_digest(decontaminate.find_leaks(before, bench)).filter("contaminated").collect()}
            same = {r.doc_id: r.text for r in before.collect() if r.doc_id not in hit}
            assert same == {r.doc_id: r.text for r in docs.collect() if r.doc_id not in hit}
        assert kept == want


def test_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, SF, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_and_columns(spark, tmp_path):
    """Null ids and texts, equal rows, one id with two texts, a very long text and columns with the names that stages use."""
    docs = table(spark, SF, "documents")
    long = " ".join(f"Sentence number {i} goes on." for i in range(9_000))
    rows = [(None, None, "en", "s", None), (None, "A plain note that nobody has claimed so far.", "en", "s", 43), (None, "A plain note that nobody has claimed so far.", "en", "s", 43)]
    rows += [(10**7, "One text under this id, quite short.", "en", "s", 36), (10**7, "Another story under the same id, told at more length.", "en", "s", 53), (10**7 + 1, long, "en", "s", len(long))]
    more = spark.createDataFrame(rows, docs.schema)
    odd = docs.unionByName(more).withColumns({"near_key": F.lit("mine"), "leak_spans": F.lit(5), "y": F.lit(1), "score": F.lit(0.5), "queue": F.lit("q")})
    names = odd.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        odd = materialize(stage(spark, odd, SF), name)
        assert odd.columns == names and odd.filter("near_key = 'mine' AND leak_spans = 5").count() == odd.count()
    ids = [r.doc_id for r in odd.select("doc_id").collect()]
    texts = {r.text for r in odd.filter(F.col("doc_id").isNull()).collect()}
    assert ids.count(10**7) == 2 and "A plain note that nobody has claimed so far." in texts
    pieces = corpus_pipeline.STAGES[-1][1](spark, odd, SF)
    assert pieces.filter("start = 0").count() == odd.count()
