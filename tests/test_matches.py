from pyspark.sql import functions as F

from sievework.operators import matches
from sievework.plans import variants


def one(spark, expr, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns)).select(expr.alias("v")).first()["v"]


def test_sources_keep_the_order_of_citations(spark):
    cited = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "b", 2)], "qid int, evidence_id string, pos int")
    drafts = spark.createDataFrame([(1, "b", "own", "u")], "qid int, evidence_id string, title string, url string")
    records = spark.createDataFrame([(1, "a", "A", "ua"), (1, "b", "B", "ub")], "qid int, evidence_id string, title string, url string")
    assert [(r["evidence_id"], r["title"]) for r in matches.cited_sources(cited, drafts, records).orderBy("ord").collect()] == [("b", "own"), ("a", "A")]


def test_thresholds_and_cuts(spark):
    for best in (0, 1, 10, 13, 20, 27):
        assert one(spark, matches.extra_threshold(F.col("b")), b=best) == (0 if best <= 0 else max(8, int(best * 0.65 + 0.999)))
    assert one(spark, matches.truncated(F.col("t"), 3), t=" a b c, d ") == "a b c..."
    assert one(spark, matches.truncated(F.col("t"), 4), t=" a b c, d ") == "a b c, d"


def test_phrases_and_evidence(spark):
    locked = variants.phrase_locked(F.col("t"))
    topic = "open-domain question answering with cross-modal-fusion model citations dataset"
    assert one(spark, locked, t=topic) == '"open-domain question" answering with "cross-modal-fusion model" citations dataset'
    assert one(spark, locked, t="open-domain question answering") is None
    assert one(spark, variants.evidence_focus(F.col("t"), locked), t=topic) == "open-domain question citations dataset"
    assert one(spark, variants.evidence_focus(F.col("t"), locked), t="grounded answers dataset benchmark") is None  # nothing new
