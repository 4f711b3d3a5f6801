import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lexaria.functions import codecs, stem, text as T, urls


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()[0]


def test_tokenizers(spark):
    t = F.col("t")
    assert one(spark, "a_b. C-d É", T.basic_tokens(t)) == ["ab", "cd", "é"]
    assert one(spark, "see http://x.org/a?b=1#c or me@x.org: Niño 42", T.main_tokens(t)) == ["see", "or", "niño", "42"]
    assert one(spark, "Domingo Faustino Sarmiento, EE.UU. Sra. 2021-12-09 abc.def@mail-archive.com", T.rule_tokens(t)) == ["domingo faustino sarmiento", "ee.uu.", "sra.", "2021-12-09", "abc.def@mail-archive.com"]
    assert one(spark, "l'été", T.rule_tokens(t, "apostrophe")) == ["l'été"]
    for f in (T.basic_tokens, T.main_tokens, T.rule_tokens):
        assert one(spark, None, f(t)) is None
        assert one(spark, "", f(t)) == []
    assert one(spark, "the la casa", T.without(T.main_tokens(t), T.STOP_WORDS)) == ["casa"]


def test_char_grams(spark):
    assert one(spark, "Año #1", T.char_grams(F.col("t"), 2)) == ["añ", "ño", "o ", " 1"]
    assert one(spark, "a", T.char_grams(F.col("t"), 2)) == []
    assert one(spark, "", T.char_grams(F.col("t"), 1)) == []


def test_codec_values():
    assert codecs.vbyte_encode([130]) == bytes([0x02, 0x81])
    assert [len(codecs.vbyte_encode([n])) for n in (0, 127, 128, 16383, 16384)] == [1, 1, 2, 2, 3]
    assert codecs.gamma_encode([1, 2, 17]) == int("1010000010001000", 2).to_bytes(2, "big")
    assert codecs.gaps([3, 7, 10]) == [3, 4, 3] and codecs.from_gaps([3, 4, 3]) == [3, 7, 10]
    with pytest.raises(ValueError):
        codecs.gamma_encode([0])
    with pytest.raises(ValueError):
        codecs.vbyte_encode([-1])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 2**40), max_size=50))
def test_codec_round_trips(numbers):
    assert codecs.vbyte_decode(codecs.vbyte_encode(numbers)) == numbers
    assert codecs.gamma_decode(codecs.gamma_encode(numbers)) == numbers
    ids = sorted(set(numbers))
    assert codecs.from_gaps(codecs.gaps(ids)) == ids


def test_sizes_are_those_of_the_codes(spark):
    numbers = [1, 2, 127, 128, 16383, 16384, 2**31]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", codecs.vbyte_size(F.col("n")).alias("v"), codecs.gamma_bits(F.col("n")).alias("g")).collect()
    for r in rows:
        assert r["v"] == len(codecs.vbyte_encode([r["n"]])) and r["g"] == 2 * r["n"].bit_length() - 1


def test_urls(spark):
    u = "https://example.com/search?q=python&page=2#results"
    assert urls.normalized(u, None) == "https://example.com/search"
    assert urls.normalized(u, None, keep_query=True) == "https://example.com/search?q=python&page=2"
    assert urls.normalized("../b;x=1?q", "http://h:80/a/c/") == "http://h:80/a/b"
    assert urls.normalized("mailto:a@b.c", "http://h/") is None and urls.normalized(None, "http://h/") is None
    assert one(spark, "http://u@h:81/a/b/c.php?x=1", urls.domain(F.col("t"))) == "u@h:81"
    assert one(spark, "http://h/a/b/", urls.dir_depth(F.col("t"))) == 3
    assert one(spark, "http://h/a.PHP", urls.is_dynamic(F.col("t"))) is True
    assert one(spark, "http://h/a", urls.is_dynamic(F.col("t"))) is False
    text, links = urls.read_html("<p>A<script>no</script> <a href='x'>b</a><a>c</a> &amp;")
    assert text == "A b c &" and links == ["x"]


def test_stemmers():
    assert [stem.porter(w) for w in ("caresses", "ponies", "agreed", "hopping", "relational", "adjustable", "rate")] == ["caress", "poni", "agre", "hop", "relat", "adjust", "rate"]
    assert [stem.lancaster(w) for w in ("maximum", "presumably", "provision", "owed", "crying")] == ["maxim", "presum", "provid", "ow", "cry"]
    assert [stem.snowball_es(w) for w in ("bibliotecas", "rápidamente", "diciéndoles", "comunicaciones", "cheques")] == ["bibliotec", "rapid", "dic", "comun", "chequ"]


def test_codecs_of_columns_equal_those_of_lists():
    import random

    import pyarrow as pa

    from lexaria.functions import codecs as c

    rnd = random.Random(6)
    lists = [[rnd.randrange(1, 1 << rnd.randint(1, 62)) for _ in range(rnd.choice((0, 1, 3, 40)))] for _ in range(60)] + [None, [], [1] * 5000, [2**62 - 1, 127, 128, 1]]
    col = pa.array(lists, pa.list_(pa.int64()))
    for many in (col, col.slice(7, 50), col.slice(3, 0), col.slice(60, 4)):
        plain = many.to_pylist()
        v, g = c.vbyte_encode_lists(many), c.gamma_encode_lists(many)
        assert v.to_pylist() == [None if x is None else c.vbyte_encode(x) for x in plain]
        assert g.to_pylist() == [None if x is None else c.gamma_encode(x) for x in plain]
        assert c.vbyte_decode_lists(v).to_pylist() == plain and c.gamma_decode_lists(g).to_pylist() == plain
        rising = pa.array([None if x is None else c.gaps(sorted(x)) for x in plain], pa.list_(pa.int64()))
        assert c.gap_decode_lists(c.vbyte_encode_lists(rising)).to_pylist() == [None if x is None else sorted(x) for x in plain]
    assert c.vbyte_encode_lists(pa.array([[0]], pa.list_(pa.int64()))).to_pylist() == [b"\x80"]
    assert c.vbyte_decode_lists(pa.array([b"\x01", b"\x82\x03"])).to_pylist() == [[], [2]]
