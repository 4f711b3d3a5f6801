import random

import numpy as np
import pytest

from lexaria.llm.packing import pack, pack_containers
from lexaria.llm.splitting import RangeMax, cut_points, split_texts
from lexaria.llm.tokens import encoding, token_sizes


def test_range_max():
    rnd = np.random.default_rng(1)
    v = rnd.integers(0, 5, 300)
    t = RangeMax(v, 64)
    for _ in range(500):
        lo = int(rnd.integers(0, 240))
        hi = lo + int(rnd.integers(0, 60))
        best = v[lo : hi + 1].max()
        assert t.query(lo, hi) == max(i for i in range(lo, hi + 1) if v[i] == best)


def test_cut_points():
    rnd = np.random.default_rng(2)
    for n in (0, 1, 10, 11, 57, 300):
        for limit, overlap in ((10, 0), (10, 3), (10, 9), (1, 0)):
            pieces = cut_points(rnd.integers(-1, 6, n + 1), n, limit, overlap)
            assert pieces[0][0] == 0 and pieces[-1][1] == n
            assert all(b - a <= limit for a, b in pieces)
            assert all(x[1] - y[0] == overlap for x, y in zip(pieces, pieces[1:]))


def test_packing_loses_nothing_and_fills_well():
    rnd = random.Random(4)
    sizes = np.array(sorted([int(rnd.lognormvariate(5, 1)) for _ in range(3000)] + [0, 8192, 8193, 30000], reverse=True))
    item, part, b, tokens = pack(sizes, 8192)
    for i in range(len(sizes)):
        assert tokens[item == i].sum() == sizes[i]
        assert (item == i).sum() == max(1, -(-sizes[i] // 8192))
    used = np.bincount(b, tokens)
    assert used.max() <= 8192 and used.sum() / (len(used) * 8192) > 0.97


def test_containers_at_the_edges(spark):
    rows = spark.createDataFrame([(1, 5, "x"), (1, 5, "x"), (2, 0, "y"), (3, None, "z"), (None, 4, "q"), (4, 25, "w"), (5, -1, "n")], "doc_id long, n int, container string")
    got = pack_containers(rows, "doc_id", "n", 10).collect()
    assert sorted((r["doc_id"], r["part"], r["tokens"]) for r in got) == [(1, 0, 5), (1, 0, 5), (2, 0, 0), (4, 0, 10), (4, 1, 10), (4, 2, 5)]
    assert pack_containers(rows.limit(0), "doc_id", "n", 10).count() == 0
    many = spark.range(500).selectExpr("id AS doc_id", "1 + id % 7 AS n")
    out = pack_containers(many, "doc_id", "n", 10, group_items=50)
    assert out.count() == 500 and out.groupBy("container").sum("tokens").agg({"sum(tokens)": "max"}).first()[0] <= 10
    with pytest.raises(ValueError):
        pack_containers(rows, "doc_id", "n", 0)


LONG = "\n\n".join(f"Párrafo {i}. " + "Una frase más larga, con ñ y comas; y otra. " * (i % 4 + 1) for i in range(40))


def test_split_texts_round_trip(spark):
    texts = [(1, LONG), (2, None), (3, ""), (4, "corto"), (5, "x" * 3000), (6, "日本語" * 400), (1, LONG)]
    df = spark.createDataFrame([(*t, 7) for t in texts], "doc_id long, text string, piece int")
    rows = split_texts(df, "doc_id", "text", 100, 10).collect()
    e = encoding()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], {})[r["piece"]] = r
    assert set(by) == {1, 3, 4, 5, 6} and by[3][0]["piece_text"] == ""
    assert by[3][0]["n_tokens"] == 0 and by[4][0]["n_tokens"] == len(e.encode_ordinary("corto"))
    for doc, text in texts:
        if text and len(text.encode()) > 100:
            ids = e.encode_ordinary(text)
            raw = [e.decode_bytes(ids[p["start"] : p["start"] + p["n_tokens"]]) for _, p in sorted(by[doc].items())]
            assert all(x.decode("utf-8", "ignore") == p["piece_text"] for x, (_, p) in zip(raw, sorted(by[doc].items())))
            assert all(p["n_tokens"] <= 100 for p in by[doc].values())
            joined = ids[: by[doc][0]["n_tokens"]]
            for k in range(1, len(by[doc])):
                p = by[doc][k]
                assert len(joined) - p["start"] == 10
                joined = joined + ids[p["start"] + 10 : p["start"] + p["n_tokens"]]
            assert joined == ids
    # cuts of a text with paragraphs fall on them or on sentence ends
    ends = [p["piece_text"] for _, p in sorted(by[1].items())][:-1]
    assert all(x.rstrip(" ").endswith(("\n", ".")) for x in ends)
    assert split_texts(df.limit(0), "doc_id", "text", 100, 10).count() == 0
    with pytest.raises(ValueError):
        split_texts(df, "doc_id", "text", 10, 10)


def test_token_sizes(spark):
    df = spark.createDataFrame([("a", "hola mundo"), ("b", None), ("c", "")], "id string, text string")
    assert {r["id"]: r["n_tokens"] for r in token_sizes(df, "id", "text").collect()} == {"a": len(encoding().encode_ordinary("hola mundo")), "b": None, "c": 0}
