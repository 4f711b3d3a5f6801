import datetime as dt
import math
import random
from collections import Counter, defaultdict
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from lexaria.llm import postings as P
from lexaria.llm.distinctive import distinctive_terms
from lexaria.llm.frequency import mark_useless, ngram_frequencies

T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
POST = "bloque int, term_id long, doc_id long, freq int, cargado_en timestamp_ntz, texto string, id int"
TERM = "term_id long, termino string, cf long, df long, actualizado timestamp_ntz, doc_id int"


def postings(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], POST)  # with extra columns


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame([(1, "Año", 1, 1, T0, 0), (2, " an\u0303o".replace("an", "an"), None, None, None, 0), (3, "sol", 1, 1, T0, 0), (3, "sol", 1, 1, T0, 0), (4, None, 1, 1, T0, 0), (None, "z", 1, 1, T0, 0)], TERM)


def test_clean_postings(spark, terms):
    rows = [(0, 1, 10, 5, T0), (0, 1, 10, 7, T1), (0, 1, 10, 7, T1), (0, 1, 10, 9, None), (0, 2, 10, 2, None), (1, 3, 10, None, T0), (1, 3, 10, 0, T1), (1, 3, 11, -1, T0), (None, 3, 12, 4, T0), (1, None, 12, 1, T0), (1, 3, None, 1, T0), (2, 9, 12, 1, T0), (2, 9, 12, 3, T0)]
    got = P.clean_postings(postings(spark, rows), terms)
    assert sorted(map(tuple, got.select("canon", "doc_id", "bloque", "freq").collect()), key=repr) == sorted([(1, 10, 0, 7), (1, 10, 0, 2), (3, 12, None, 4), (9, 12, 2, 3)], key=repr)
    assert {r["canon"]: r["tf"] for r in P.term_doc_counts(got).where("doc_id = 10").collect()} == {1: 9}
    assert P.n_documents(postings(spark, rows)) == 2
    assert P.clean_postings(postings(spark, []), terms.limit(0)).count() == 0


def test_distinctive_terms(spark):
    rnd = random.Random(5)
    data = {(t, d): rnd.randint(1, 9) for t in range(1, 30) for d in range(1, 20) if rnd.random() < 0.3}
    counts = spark.createDataFrame([(t, d, n, "extra") for (t, d), n in data.items()] + [(1, 99, None, "n")], "canon long, doc_id long, tf long, df string")
    names = spark.createDataFrame([(t, f"t{t:02d}") for t in range(1, 30)], "canon long, termino string")
    df, cf, dl = Counter(), Counter(), Counter()
    for (t, d), n in data.items():
        df[t] += 1
        cf[t] += n
        dl[d] += n
    total, a0 = sum(cf.values()), 1000.0

    def z(t, d, n):
        a = a0 * cf[t] / total
        r, rn = cf[t] - n, total - dl[d]
        return (math.log((n + a) / (dl[d] + a0 - n - a)) - math.log((r + a) / (rn + a0 - r - a))) / math.sqrt(1 / (n + a) + 1 / (r + a))

    for score, f in (("log_odds", z), ("tfidf", lambda t, d, n: (1 + math.log(n)) * math.log(19 / df[t]))):
        want = defaultdict(list)
        for (t, d), n in data.items():
            if df[t] >= 2:
                want[d].append((-round(f(t, d, n), 6), f"t{t:02d}"))
        got = distinctive_terms(counts.drop("df"), names, 19, k=3, score=score, min_df=2).collect()
        assert {(r["doc_id"], r["termino"]) for r in got} == {(d, t) for d, v in want.items() for _, t in sorted(v)[:3]}
    assert distinctive_terms(counts.drop("df").limit(0), names, 0).count() == 0
    assert distinctive_terms(counts.drop("df"), names, 19, k=None).count() == len(data)
    with pytest.raises(ValueError):
        distinctive_terms(counts, names, 19, score="other")


@pytest.mark.parametrize("max_n,salts", [(1, None), (1, 1), (3, None), (3, 2)])
def test_ngrams_equal_brute_force(spark, max_n, salts):
    rnd = random.Random(max_n)
    seqs = [(i % 37, [rnd.choice("aaaabcd") for _ in range(rnd.randint(0, 12))]) for i in range(60)] + [(40, None), (None, ["a"]), (41, ["a", None, "b"])]
    cf, recs = Counter(), defaultdict(set)
    for rid, s in seqs:
        s = [x for x in (s or []) if x is not None]
        if rid is not None:
            for n in range(1, max_n + 1):
                for i in range(len(s) - n + 1):
                    cf[tuple(s[i : i + n])] += 1
                    recs[tuple(s[i : i + n])].add(rid)
    df = spark.createDataFrame(seqs, "id int, t array<string>").withColumn("cf", F.lit(1)).withColumn("w", F.lit("clash"))
    got = {tuple(r["gram"]): (r["cf"], r["df"]) for r in ngram_frequencies(df, "id", "t", max_n=max_n, salts=salts).collect()}
    assert got == {g: (cf[g], len(recs[g])) for g in cf}


def test_stack_over_batch_ends():
    import pyarrow as pa

    from lexaria.llm.frequency import _stacked

    rnd = random.Random(9)
    for depth in (1, 3):
        rows = sorted({(tuple(rnd.choice("abc") for _ in range(rnd.randint(1, depth))), rnd.randrange(5)) for _ in range(60)}, key=lambda r: r[1])
        rows = sorted(rows + rows[:20], key=lambda r: r[0], reverse=True)
        cf, recs = Counter(), defaultdict(set)
        for s, rid in rows:
            for n in range(1, len(s) + 1):
                cf[s[:n]] += 2
                recs[s[:n]].add(rid)
        kinds = pa.schema([("suffix", pa.list_(pa.string())), ("rid", pa.int64()), ("w", pa.int64())])
        cuts = [0, 1, 2, 7, 8, 30, len(rows)]
        # equal suffixes are in order of record
        rows = [r for _, g in groupby(rows, key=lambda r: r[0]) for r in sorted(g, key=lambda r: r[1])]
        batches = [pa.record_batch([[list(s) for s, _ in rows[a:b]], [r for _, r in rows[a:b]], [2] * (b - a)], schema=kinds) for a, b in zip(cuts, cuts[1:])]
        got = {tuple(g): (c, d) for b in _stacked(iter(batches), pa.string()) for g, c, d in zip(*(x.to_pylist() for x in b.columns))}
        assert got == {g: (cf[g], len(recs[g])) for g in cf}


def test_weights_marks_and_empty(spark):
    df = spark.createDataFrame([(1, [5], 3), (2, [5], None), (2, [6], 1), (3, [5], 4)], "id long, t array<long>, n int")
    got = {r["gram"][0]: (r["cf"], r["df"]) for r in ngram_frequencies(df, "id", "t", max_n=1, weight_col="n").collect()}
    assert got == {5: (7, 3), 6: (1, 1)}
    marks = {r["gram"][0]: r["marca"] for r in mark_useless(ngram_frequencies(df, "id", "t", max_n=1, weight_col="n"), 3).collect()}
    assert marks == {5: "comun", 6: "raro"}
    assert ngram_frequencies(df.limit(0), "id", "t").count() == 0
    routed = ngram_frequencies(df.repartition(3, "t", "id"), "id", "t", max_n=1, weight_col="n", routed=True)
    assert {r["gram"][0]: (r["cf"], r["df"]) for r in routed.collect()} == {5: (7, 3), 6: (1, 1)}
    with pytest.raises(ValueError):
        ngram_frequencies(df, "id", "t", routed=True)
