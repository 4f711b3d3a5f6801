import pytest
from pyspark.sql import functions as F

from lexaria.operators import evaluate, index, rank, stats
from lexaria.functions.text import main_tokens
from lexaria.sinks import files as sinks
from lexaria.sources import files as sources
from lexaria.streaming.counts import event_sessions


@pytest.fixture(scope="module")
def tf(spark):
    return spark.createDataFrame([("t", d, 1 + d % 3) for d in range(1, 30)] + [("u", 5, 2)], "term string, doc_id long, tf long")


def test_stored_index(spark, tf, tmp_path):
    names = spark.range(1, 30).select(F.col("id").alias("doc_id"), F.format_string("n%02d", 30 - F.col("id")).alias("doc_name"))
    ix = index.save_parts(tf, names, str(tmp_path / "ix"))
    assert ix.lexicon.count() == 2 and {r["value"] for r in index.posting_lines(ix, "U").collect()} == {"n25:5:2"}
    assert index.posting_lines(ix, "zz").collect()[0][0] == "unknown term: zz"
    view = index.skip_view(ix, "t").collect()
    assert [r["doc_name"] for r in view] == sorted(r["doc_name"] for r in view) and {r["doc_id"] for r in view} == {1, 6, 11, 16, 21, 26}
    assert [r["doc_id"] for r in index.from_skip(ix, "t", 13).collect()] == list(range(11, 30))
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,t)" in ix.postings.where("term = 't'")._jdf.queryExecution().executedPlan().toString()
    # it is read again, not built
    again = index.save_parts(tf.limit(0), names, str(tmp_path / "ix"))
    assert again.postings.count() == 30
    assert index.save_parts(tf.limit(0), names.limit(0), str(tmp_path / "none")).lexicon.count() == 0
    assert sources.load_index(spark, str(tmp_path / "ix" / "postings")).count() == 30


def test_zero_tail(spark):
    docs = spark.createDataFrame([(i, "a b" if i == 3 else "c d") for i in range(1, 6)], "doc_id long, text string")
    ix = rank.build_index(docs, main_tokens(F.col("text")))
    q = rank.topic_terms(spark, {1: "a", 2: "zz"}, main_tokens)
    got = {q_: [(r["doc_id"], r["score"]) for r in rank.top_k(rank.cosine_tfidf(ix, q, 3), 3).where(F.col("qid") == q_).orderBy("rank").collect()] for q_ in (1, 2)}
    assert [d for d, _ in got[1]] == [3, 1, 2] and got[1][0][1] > 0 and got[1][1][1] == 0
    assert got[2] == [(1, 0.0), (2, 0.0), (3, 0.0)]


def test_words_of_a_table(spark, tf):
    words = spark.createDataFrame([("u",), (None,), ("u",)], "term string")
    for most in (10, 0):
        assert {r["term"] for r in stats.without_terms(tf, words, most).collect()} == {"t"}
    assert stats.without_terms(tf, words.limit(0)).count() == 30


def test_topics_and_judgements(spark, tmp_path):
    (tmp_path / "topics").write_text("<top>\n<num> Number: 12\n<title> two  words\n<desc> x\n</top>\n<top><num>13<title>one</title></top>\n<top><title>none</top>\n")
    assert sorted(map(tuple, sources.topic_file(spark, str(tmp_path / "topics")).collect())) == [(12, "two words"), (13, "one")]
    (tmp_path / "qrels").write_text("1 0 d1 1\n1 0 d1 0\n2 0 d9 2\nshort line\nx 0 d 1\n\n")
    assert sorted(map(tuple, sources.judgement_file(spark, str(tmp_path / "qrels")).collect())) == [(1, "d1", 1), (2, "d9", 2)]


def test_report_graph_timing_and_sessions(spark, tf, tmp_path):
    sinks.json_report(tf.where("doc_id < 3"), tf.agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "r"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert len(lines) == 3 and '{"statistics":{"n":30}}' in lines and '{"data":{"term":"t","doc_id":1,"tf":2}}' in lines
    sinks.graph_tables(spark.range(3), spark.range(2), str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g" / "nodes")).count() == 3 and spark.read.parquet(str(tmp_path / "g" / "edges")).count() == 2
    assert [k for k, _ in evaluate.timing_summary({"a": 2.0, "b": 1.0, "c": 3.0}, 1)] == ["b", "...", "c"]
    assert [k for k, _ in evaluate.timing_summary({"a": 2.0, "b": 1.0}, 1)] == ["b", "a"]
    events = spark.sql("SELECT 1 AS user_id, CAST(1.5 AS DOUBLE) AS value, make_timestamp(2024, 1, 1, h, m, 0) AS ts FROM VALUES (1, 0), (1, 20), (3, 0) AS v(h, m)")
    assert sorted((r["events"], r["total"]) for r in event_sessions(events).collect()) == [(1, 1.5), (2, 3.0)]
