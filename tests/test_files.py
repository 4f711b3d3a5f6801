from pyspark.sql import functions as F

from lexaria.functions.text import main_tokens
from lexaria.operators import stats
from lexaria.sinks import files as sinks
from lexaria.sources import files
from lexaria.streaming import counts


def test_readers(spark, tmp_path):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "a.txt").write_text("uno\n\n dos ", encoding="utf-8")
    (tmp_path / "d" / "sub" / "b.html").write_bytes(b"caf\xc3\xa9 \xff!")
    (tmp_path / "d" / "sub" / "c.bin").write_bytes(b"no")
    tree = {r["doc_name"]: r["text"] for r in files.folder_tree(spark, str(tmp_path / "d")).collect()}
    assert tree == {"a.txt": "uno\n\n dos ", "sub/b.html": "café !"}
    assert files.corpus_size(spark, str(tmp_path / "d")).first()["files"] == 2
    assert [r["text"] for r in files.lines(spark, str(tmp_path / "d" / "a.txt")).collect()] == ["uno", "dos"]
    assert files.flat_folder(spark, str(tmp_path / "d" / "a.txt")).first()["doc_name"] == "a.txt"
    f = tmp_path / "trec"
    f.write_text("<DOC>\n<DOCNO> 1 </DOCNO>\nbody one\n</DOC>\n<DOC>\n<DOCNO>2</DOCNO>\n</DOC>\ntail")
    assert [tuple(r) for r in files.tagged_file(spark, str(f)).collect()] == [("1", "body one"), ("2", "")]
    f = tmp_path / "dump"
    f.write_text("t:2:1,5\nbad\nu:1:7\nv:0:\n")
    assert sorted(map(tuple, files.posting_dump(spark, str(f)).collect())) == [("t", 1), ("t", 5), ("u", 7)]
    f = tmp_path / "queries"
    f.write_text("1:a b: c\n\nplain words\nx\n")
    assert [tuple(r) for r in files.query_file(spark, str(f)).collect()] == [("1", "a b: c"), (None, "plain words"), (None, "x")]
    assert files.short_queries(spark, str(f)).count() == 2
    f = tmp_path / "latin"
    f.write_bytes("año, \"x\n".encode("iso-8859-1"))
    assert [r["text"] for r in files.lines(spark, str(f), "ISO-8859-1").collect()] == ['año, "x']
    f = tmp_path / "words"
    f.write_text("El\nel\n\n la \n")
    assert sorted(r["term"] for r in files.word_list(spark, str(f)).collect()) == ["el", "la"]
    f = tmp_path / "solution"
    f.write_text("1 English\n2 Italian\n")
    assert [tuple(r) for r in files.language_solution(spark, str(f)).collect()] == [(1, "English"), (2, "Italian")]


def test_writers(spark, tmp_path):
    docs = spark.createDataFrame([(1, "b a a"), (2, "c")], "doc_id long, text string")
    tokens = main_tokens(F.col("text"))
    terms, per_doc = stats.term_stats(stats.term_frequencies(docs, tokens)), stats.doc_stats(docs, tokens)
    read = lambda p: "".join(x.read_text() for x in sorted((tmp_path / p).glob("part-*")))
    sinks.term_file(terms, str(tmp_path / "terms"))
    assert read("terms") == "a 2 1\nb 1 1\nc 1 1\n"
    sinks.statistics_file(stats.collection_stats(terms, per_doc), stats.doc_extremes(per_doc), str(tmp_path / "stats"))
    assert read("stats").splitlines()[0] == "Documents: 2" and len(read("stats").splitlines()) == 9
    sinks.frequency_file(terms, str(tmp_path / "freq"), 2)
    assert read("freq") == "a 2\nb 1\n\nb 1\nc 1\n"
    sinks.json_dump(terms.where("term = 'a'"), str(tmp_path / "json"))
    assert read("json") == '{"term":"a","cf":2,"df":1}\n'
    sinks.pair_file(stats.heaps_pairs(docs, tokens), str(tmp_path / "pairs"))
    assert read("pairs").endswith("4 3\n")
    run = spark.createDataFrame([(1, 2, 0.5, 1)], "qid int, doc_id long, score double, rank int")
    assert sinks.result_lines(run, spark.createDataFrame([(2, "n")], "doc_id long, doc_name string")).first()[0] == "n:2:0.5000"


def test_stream_equals_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b", "2024-01-01 00:10:00"), (2, "a", "2024-01-01 00:50:00"), (3, "a", "2024-01-01 01:10:00")], "doc_id long, text string, t string").select("doc_id", "text", F.to_timestamp("t").alias("t"))
    rows.write.parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, counts.term_counts(rows, "t", main_tokens(F.col("text"))).collect()))
    stream = counts.term_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "t", main_tokens(F.col("text")))
    q = stream.writeStream.format("memory").queryName("terms_now").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("terms_now").collect())) == want
