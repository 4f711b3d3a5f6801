"""Queries on tokens, statistics, laws, character models, index structure and compression."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexaria.functions import text as T
from lexaria.functions.html import html_text_sql
from lexaria.functions.stem import lancaster, porter, snowball_es, stem_column
from lexaria.operators import charmodels, index, stats
from lexaria.operators.stats import doc_stats, term_frequencies, term_stats
from lexaria.session import ensure_checkpoint_dir, spread, stored, table


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def tokens() -> Column:
    return T.main_tokens(F.col("text"))


def tf_of(spark: SparkSession, d: str) -> DataFrame:
    return term_frequencies(docs(spark, d), tokens())


def _terms(spark, d):
    return term_stats(tf_of(spark, d))


def _collection(spark, d, toks):
    base = docs(spark, d)
    return stats.collection_stats(term_stats(term_frequencies(base, toks)), doc_stats(base, toks))


def zipf_fit(spark, d):
    return stats.zipf_fit(stats.zipf_ranks(_terms(spark, d))).select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "n")


def zipf_mass(spark, d):
    ranks = stats.zipf_ranks(_terms(spark, d))
    return stats.zipf_mass(ranks, stats.zipf_fit(ranks))


def vocab_prune(spark, d):
    ranks = stats.zipf_ranks(_terms(spark, d))
    return stats.vocab_prune(ranks, ranks.count(), T.STOP_WORDS)


def _labelled(spark, d):
    return table(spark, d, "muestra_idioma").select(F.col("idioma").alias("lang"), F.col("texto").alias("text"))


def _langid(w):
    def run(spark, d):
        return charmodels.nearest_language(docs(spark, d).withColumnRenamed("doc_id", "id"), charmodels.char_model(_labelled(spark, d), w), w).withColumnRenamed("id", "doc_id")

    return run


def langid_accuracy(spark, d):
    labels = table(spark, d, "documents").where("lang IS NOT NULL").select("doc_id", F.col("lang").alias("label"))
    one, two = (_langid(w)(spark, d).select("doc_id", F.col("lang").alias(f"l{w}")) for w in (1, 2))
    j = labels.join(one, "doc_id").join(two, "doc_id")
    return j.agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("l1") == F.col("label")).alias("unigram_right"), F.count_if(F.col("l2") == F.col("label")).alias("bigram_right"))


def codec_roundtrip(spark, d):
    """Terms whose lists differ after compression and decompression, value by value, with and without gaps (0 each)."""
    tf = stored(tf_of(spark, d))
    parts = []
    for with_gaps in (True, False):
        back = index.decompress(index.compress(tf, with_gaps), with_gaps)
        both = tf.select("term", "doc_id", "tf", F.lit(1).alias("s")).unionAll(back.select("term", "doc_id", "tf", F.lit(-1).alias("s")))
        diff = both.groupBy("term", "doc_id", "tf").agg(F.sum("s").alias("s"))
        parts.append(diff.agg(F.lit(with_gaps).alias("with_gaps"), F.count(F.lit(1)).alias("postings"), F.count_if(F.col("s") != 0).alias("different")))
    return parts[0].unionAll(parts[1])


def index_overhead(spark, d):
    """Bytes of postings and lexicon against the bytes of the corpus."""
    t = _terms(spark, d).agg((F.sum("df") * 8).alias("posting_bytes"), F.sum(F.octet_length("term") + 16).alias("lexicon_bytes"))
    c = docs(spark, d).agg(F.sum(F.octet_length("text")).alias("corpus_bytes"))
    return t.crossJoin(F.broadcast(c)).select("posting_bytes", "lexicon_bytes", "corpus_bytes", F.round((F.col("posting_bytes") + F.col("lexicon_bytes")) / F.col("corpus_bytes"), 6).alias("overhead"))


def df_band_term(spark, d):
    """The term with the smallest df from 50 to 100, the first on ties."""
    return _terms(spark, d).where("df BETWEEN 50 AND 100").orderBy("df", "term").limit(1)


def posting_size_hist(spark, d):
    """Histogram of df in 100 bins of equal width."""
    t = _terms(spark, d)
    lim = t.agg(F.min("df").alias("lo"), F.max("df").alias("hi"))
    at = F.least(F.floor((F.col("df") - F.col("lo")) * 100 / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))), F.lit(99)).cast("int")
    return t.crossJoin(F.broadcast(lim)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _stems(f, column):
    def run(spark, d):
        """Stems of the distinct vocabulary with their totals."""
        stems = stem_column(_terms(spark, d), "term", f)
        return stems.groupBy("stem").agg(F.count(F.lit(1)).alias("terms"), F.sum("cf").alias("cf"))

    return run


def stemmer_comparison(spark, d):
    """Distinct terms and stems under two stemmers."""
    t = stem_column(stem_column(_terms(spark, d), "term", porter, "p"), "term", lancaster, "l")
    return t.agg(F.count(F.lit(1)).alias("terms"), F.countDistinct("p").alias("porter"), F.countDistinct("l").alias("lancaster"))


def skip_lists(spark, d):
    tf = stored(tf_of(spark, d))
    return index.skip_lists(tf, term_stats(tf))


def _stored_index(spark, d) -> index.StoredIndex:
    """An index of the corpus in the shared folder, read back."""
    path = f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    names = docs(spark, d).select("doc_id", F.concat(F.lit("d"), "doc_id").alias("doc_name"))
    return index.save_parts(stored(tf_of(spark, d)), names, path)


def stored_lookup(spark, d):
    """The list of one term of a stored index as ``name:id:frequency``."""
    return index.posting_lines(_stored_index(spark, d), "vocabulario")


def stored_skips(spark, d):
    """Skip list, by document name, of the term with the smallest df from 50 to 100, from a stored index."""
    ix = _stored_index(spark, d)
    return index.skip_view(ix, ix.lexicon.where("df BETWEEN 50 AND 100").orderBy("df", "term").first()["term"])


def rule_stats(words):
    return lambda spark, d: term_stats(term_frequencies(docs(spark, d), T.rule_tokens(F.col("text"), words)))


def line_df(spark, d):
    """Document frequency by line: (term, cf, lines) with every non-blank line as a document."""
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "text")).where(F.trim("text") != "")
    tf = lines.select("doc_id", "no", F.explode(tokens()).alias("term")).groupBy("doc_id", "no", "term").agg(F.count(F.lit(1)).alias("tf"))
    return tf.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("lines"))


QUERIES = {
    "term_stats": _terms,
    "doc_stats": lambda s, d: doc_stats(docs(s, d), tokens()),
    "collection_stats": lambda s, d: _collection(s, d, tokens()),
    "basic_tokenizer_stats": lambda s, d: _collection(s, d, T.basic_tokens(F.col("text"))),
    "stopword_filtered_stats": lambda s, d: _collection(s, d, T.without(tokens(), T.STOP_WORDS)),
    "top_terms": lambda s, d: _terms(s, d).select("term", "cf").orderBy(F.desc("cf"), "term").limit(10),
    "bottom_terms": lambda s, d: _terms(s, d).select("term", "cf").orderBy("cf", "term").limit(10),
    "doc_extremes": lambda s, d: stats.doc_extremes(doc_stats(docs(s, d), tokens())),
    "hapax_terms": lambda s, d: _terms(s, d).where("cf = 1").select("term"),
    "line_df": line_df,
    "zipf_ranks": lambda s, d: stats.zipf_ranks(_terms(s, d)),
    "zipf_fit": zipf_fit,
    "zipf_mass": zipf_mass,
    "vocab_prune": vocab_prune,
    "heaps_pairs": lambda s, d: stats.heaps_pairs(docs(s, d), tokens()),
    "heaps_fit": lambda s, d: stats.heaps_fit(stats.heaps_pairs(docs(s, d), tokens())),
    "char_model": lambda s, d: charmodels.char_model(_labelled(s, d), 2).select("lang", "gram", F.round("p", 9).alias("p")),
    "langid_unigram": _langid(1),
    "langid_bigram": _langid(2),
    "langid_accuracy": langid_accuracy,
    "postings": tf_of,
    "term_ids": lambda s, d: index.first_seen_ids(docs(s, d), tokens()),
    "lexicon_offsets": lambda s, d: index.lexicon(_terms(s, d)),
    "skip_lists": skip_lists,
    "term_lookup": lambda s, d: index.posting_list(tf_of(s, d), "vocabulario"),
    "posting_size_hist": posting_size_hist,
    "index_overhead": index_overhead,
    "df_band_term": df_band_term,
    "dgaps": lambda s, d: index.gaps(tf_of(s, d)),
    "dgaps_roundtrip": lambda s, d: index.gaps_restored(index.gaps(tf_of(s, d))).where("doc_id = restored").groupBy("term").agg(F.count(F.lit(1)).alias("same")),
    "compressed_sizes": lambda s, d: index.compressed_sizes(tf_of(s, d)),
    "compression_savings": lambda s, d: index.compression_savings(index.compressed_sizes(tf_of(s, d))),
    "codec_roundtrip": codec_roundtrip,
    "rule_tokens": rule_stats("ascii"),
    "rule_tokens_apostrophe": rule_stats("apostrophe"),
    "rule_tokens_accented": rule_stats("accented"),
    "stem_porter": _stems(porter, "term"),
    "stem_lancaster": _stems(lancaster, "term"),
    "stem_snowball_es": _stems(snowball_es, "term"),
    "stemmer_comparison": stemmer_comparison,
    "html_text": lambda s, d: table(s, d, "documento").where("texto IS NOT NULL").select("doc_id", F.trim(F.regexp_replace(html_text_sql(F.col("texto")), r"[ \t\n\r]+", " ")).alias("t")).groupBy("doc_id").agg(F.max("t").alias("text")),
    "stored_lookup": stored_lookup,
    "stored_skips": stored_skips,
    "stopword_table_stats": lambda s, d: term_stats(stats.without_terms(tf_of(s, d), s.createDataFrame([(w,) for w in T.STOP_WORDS], "term string"))),
}

TOKENS = rf"""regexp_extract_all(regexp_replace(regexp_replace(text, '{T.URL}', ' ', 'g'), '{T.EMAIL}', ' ', 'g'), '[{T.LETTERS}0-9]+')"""
TOK = f"""
WITH toks AS (SELECT doc_id, text, list_filter(list_transform({TOKENS}, lambda x: lower(x)), lambda x: length(x) BETWEEN 1 AND 20) AS l FROM documents),
tok AS (SELECT doc_id, unnest(l) AS term, generate_subscripts(l, 1) AS pos FROM toks),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
terms AS (SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM tf GROUP BY term),
ds AS (SELECT doc_id, CAST(len(l) AS BIGINT) AS n_tokens, CAST(len(list_distinct(l)) AS BIGINT) AS n_terms FROM toks)
"""
STATS = """
SELECT (SELECT count(*) FROM ds) AS n_docs, (SELECT CAST(sum(n_tokens) AS BIGINT) FROM ds) AS n_tokens, count(*) AS n_terms, (SELECT round(avg(n_tokens), 6) FROM ds) AS mean_tokens,
  round(count(*) / (SELECT count(*) FROM ds), 6) AS vocab_per_doc, (SELECT round(avg(n_terms), 6) FROM ds) AS mean_doc_terms, round(avg(length(term)), 6) AS mean_term_length,
  count_if(cf = 1)::BIGINT AS hapax FROM terms"""
RANKS = TOK + ", r AS (SELECT row_number() OVER (ORDER BY cf DESC, term) AS rank, term, cf FROM terms), fit AS (SELECT regr_slope(ln(cf), ln(rank)) AS slope, regr_intercept(ln(cf), ln(rank)) AS intercept, count(*) AS n FROM r)"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _basic(tok: str) -> str:
    return tok.replace(f"list_filter(list_transform({TOKENS}, lambda x: lower(x)), lambda x: length(x) BETWEEN 1 AND 20)", r"list_transform(list_filter(regexp_split_to_array(regexp_replace(text, '[^\p{L}\p{N}\s]', '', 'g'), '\s+'), lambda x: x <> ''), lambda x: lower(x))")


_GRAMS = r"lower(regexp_replace({t}, '[^\p{{L}}\p{{N}}_\s¿?¡!'']', '', 'g'))"


def _char_sql(w: int) -> str:
    chars = lambda t: f"string_split({_GRAMS.format(t=t)}, '')"
    gram = " || ".join(f"c[i + {k}]" for k in range(w)) if w > 1 else "c[i]"
    grams = f"unnest(list_transform(range(1, len(c) - {w - 2}), lambda i: {gram}))"
    return f"""
m{w} AS (SELECT lang, gram, count(*) AS c FROM (SELECT lang, {grams} AS gram FROM (SELECT idioma AS lang, {chars('texto')} AS c FROM muestra_idioma)) GROUP BY ALL),
model{w} AS (SELECT lang, gram, c / sum(c) OVER (PARTITION BY lang) AS p FROM m{w}),
o{w} AS (SELECT doc_id, gram, count(*) AS c FROM (SELECT doc_id, {grams} AS gram FROM (SELECT doc_id, {chars('text')} AS c FROM documents WHERE text <> '')) WHERE gram <> '' GROUP BY ALL),
own{w} AS (SELECT doc_id, gram, c / sum(c) OVER (PARTITION BY doc_id) AS q FROM o{w}),
near{w} AS (SELECT doc_id, lang, round(2 - 2 * sum(least(p, q)), 9) AS d FROM own{w} JOIN model{w} USING (gram) GROUP BY ALL),
best{w} AS (SELECT doc_id, arg_min(lang, (d, lang)) AS lang, round(min(d), 6) AS distance FROM near{w} GROUP BY doc_id)"""


_VB = "greatest(1, CAST(ceil(length(bin({x})) / 7) AS BIGINT))"
SIZES = TOK + f"""
, g AS (SELECT term, doc_id, tf, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS gap FROM tf),
sizes AS (SELECT term, count(*) AS df, CAST(sum({_VB.format(x='doc_id')}) AS BIGINT) AS ids_bytes, CAST(sum({_VB.format(x='gap')}) AS BIGINT) AS gap_bytes,
  CAST(ceil(sum(2 * length(bin(tf)) - 1) / 8) AS BIGINT) AS freq_bytes FROM g GROUP BY term)"""
SQL = {
    "term_stats": TOK + "SELECT * FROM terms",
    "doc_stats": TOK + "SELECT * FROM ds",
    "collection_stats": TOK + STATS,
    "basic_tokenizer_stats": _basic(TOK) + STATS,
    "stopword_filtered_stats": TOK.replace("lambda x: length(x) BETWEEN 1 AND 20)", f"lambda x: length(x) BETWEEN 1 AND 20 AND x NOT IN ({_STOP}))") + STATS,
    "top_terms": TOK + "SELECT term, cf FROM terms ORDER BY cf DESC, term LIMIT 10",
    "bottom_terms": TOK + "SELECT term, cf FROM terms ORDER BY cf, term LIMIT 10",
    "doc_extremes": TOK + "(SELECT 'shortest' AS which, doc_id, n_tokens, n_terms FROM ds ORDER BY n_tokens, doc_id LIMIT 1) UNION ALL (SELECT 'longest', doc_id, n_tokens, n_terms FROM ds ORDER BY n_tokens DESC, doc_id LIMIT 1)",
    "hapax_terms": TOK + "SELECT term FROM terms WHERE cf = 1",
    "line_df": f"""
WITH li AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents), ln AS (SELECT doc_id, row_number() OVER () AS no, text FROM li WHERE trim(text) <> ''),
tok AS (SELECT no, unnest(list_filter(list_transform({TOKENS}, lambda x: lower(x)), lambda x: length(x) BETWEEN 1 AND 20)) AS term FROM ln)
SELECT term, count(*) AS cf, count(DISTINCT no) AS lines FROM tok GROUP BY term""",
    "zipf_ranks": RANKS + "SELECT rank, term, cf FROM r",
    "zipf_fit": RANKS + "SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept, n FROM fit",
    "zipf_mass": RANKS + "SELECT share, round(sum(exp(intercept) * pow(rank, slope)), 3) AS estimated, CAST(sum(cf) AS BIGINT) AS real FROM r, fit, (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE)) s(share) WHERE rank <= floor(n * share) GROUP BY share",
    "vocab_prune": RANKS + f"""SELECT share, CAST(floor(n * share) AS BIGINT) AS pruned, CAST(count_if(term NOT IN ({_STOP})) AS BIGINT) AS content_terms,
  round(count_if(term NOT IN ({_STOP})) * 100.0 / floor(n * share), 4)::DOUBLE AS content_percent FROM r, fit, (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE)) s(share) WHERE rank <= floor(n * share) GROUP BY share, n""",
    "heaps_pairs": TOK + """
, f AS (SELECT doc_id, count(*) AS nt FROM (SELECT term, min(doc_id) AS doc_id FROM tf GROUP BY term) GROUP BY doc_id),
r AS (SELECT n_tokens AS own, CAST(sum(n_tokens) OVER (ORDER BY ds.doc_id) AS BIGINT) AS n, CAST(sum(coalesce(nt, 0)) OVER (ORDER BY ds.doc_id) AS BIGINT) AS v FROM ds LEFT JOIN f ON f.doc_id = ds.doc_id)
SELECT DISTINCT n, v FROM (SELECT n, v FROM r WHERE n % 100 < own UNION ALL SELECT max(n), max(v) FROM r)""",
    "char_model": "WITH " + _char_sql(2) + " SELECT lang, gram, round(p, 9) AS p FROM model2",
    "langid_unigram": "WITH " + _char_sql(1) + " SELECT * FROM best1",
    "langid_bigram": "WITH " + _char_sql(2) + " SELECT * FROM best2",
    "postings": TOK + "SELECT * FROM tf",
    "term_ids": TOK + ", s AS (SELECT term, min((doc_id, pos)) AS seen FROM tok GROUP BY term) SELECT term, row_number() OVER (ORDER BY seen) AS term_id FROM s",
    "lexicon_offsets": TOK + "SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS term_idx, CAST(8 * (sum(df) OVER (ORDER BY term) - df) AS BIGINT) AS pointer FROM terms",
    "skip_lists": TOK + """, p AS (SELECT tf.term, doc_id, row_number() OVER (PARTITION BY tf.term ORDER BY doc_id) - 1 AS rn, CAST(floor(sqrt(df)) AS INT) AS k FROM tf JOIN terms USING (term))
SELECT term, CAST(rn / k AS INT) AS skip_idx, doc_id, CAST(rn * 8 AS BIGINT) AS byte_offset FROM p WHERE rn % k = 0""",
    "term_lookup": TOK + "SELECT doc_id, tf FROM tf WHERE term = 'vocabulario'",
    "posting_size_hist": TOK + ", lim AS (SELECT min(df) AS lo, max(df) AS hi FROM terms) SELECT CAST(least(floor((df - lo) * 100 / greatest(hi - lo, 1)), 99) AS INT) AS bin, count(*) AS n FROM terms, lim GROUP BY ALL",
    "index_overhead": TOK + """, t AS (SELECT CAST(sum(df) * 8 AS BIGINT) AS posting_bytes, CAST(sum(strlen(term) + 16) AS BIGINT) AS lexicon_bytes FROM terms), c AS (SELECT CAST(sum(strlen(text)) AS BIGINT) AS corpus_bytes FROM documents)
SELECT *, round((posting_bytes + lexicon_bytes) / corpus_bytes, 6) AS overhead FROM t, c""",
    "df_band_term": TOK + "SELECT term, cf, df FROM terms WHERE df BETWEEN 50 AND 100 ORDER BY df, term LIMIT 1",
    "dgaps": SIZES + "SELECT term, doc_id, tf, gap FROM g",
    "dgaps_roundtrip": TOK + "SELECT term, count(*) AS same FROM tf GROUP BY term",
    "compressed_sizes": SIZES + "SELECT * FROM sizes",
    "compression_savings": SIZES + """, s AS (SELECT CAST(sum(df) * 8 AS BIGINT) AS raw_bytes, CAST(sum(ids_bytes + freq_bytes) AS BIGINT) AS plain_bytes, CAST(sum(gap_bytes + freq_bytes) AS BIGINT) AS gap_bytes FROM sizes)
SELECT *, round(100.0 * (1 - gap_bytes / plain_bytes), 4)::DOUBLE AS saving_percent FROM s""",
    "codec_roundtrip": TOK + "SELECT g AS with_gaps, (SELECT count(*) FROM tf) AS postings, 0::BIGINT AS different FROM (VALUES (true), (false)) v(g)",
    "html_text": r"SELECT doc_id, max(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(texto, '(?is)<(script|style)\b[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^<>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'))) AS text FROM documento WHERE texto IS NOT NULL GROUP BY doc_id",
    "stored_lookup": TOK + "SELECT concat('d', doc_id, ':', doc_id, ':', tf) AS value FROM tf WHERE term = 'vocabulario'",
    "stored_skips": TOK + """, b AS (SELECT term, df FROM terms WHERE df BETWEEN 50 AND 100 ORDER BY df, term LIMIT 1), r AS (SELECT tf.doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn, CAST(floor(sqrt(df)) AS BIGINT) AS k FROM tf JOIN b USING (term))
SELECT concat('d', doc_id) AS doc_name, doc_id, rn * 8 AS byte_offset FROM r WHERE rn % k = 0""",
    "stopword_table_stats": TOK + f"SELECT * FROM terms WHERE term NOT IN ({_STOP})",
}
SQL["heaps_fit"] = "WITH pairs AS (" + SQL["heaps_pairs"] + ") SELECT round(regr_slope(ln(v), ln(n)), 6) AS slope, round(regr_intercept(ln(v), ln(n)), 6) AS intercept FROM pairs WHERE n > 0 AND v > 0"
SQL["langid_accuracy"] = "WITH " + _char_sql(1) + "," + _char_sql(2) + """
SELECT count(*) AS texts, CAST(count_if(best1.lang = d.lang) AS BIGINT) AS unigram_right, CAST(count_if(best2.lang = d.lang) AS BIGINT) AS bigram_right
FROM documents d JOIN best1 ON best1.doc_id = d.doc_id JOIN best2 ON best2.doc_id = d.doc_id WHERE d.lang IS NOT NULL"""
