"""Languages by distance between distributions of characters and pairs of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lexaria.functions.text import char_grams


def char_model(lines: DataFrame, w: int) -> DataFrame:
    """(lang, gram, p): relative frequencies of grams of ``w`` characters of ``lines`` (lang, text)."""
    counts = lines.where("lang IS NOT NULL").select("lang", F.explode(char_grams(F.col("text"), w)).alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("c"))
    return counts.select("lang", "gram", (F.col("c") / F.sum("c").over(Window.partitionBy("lang"))).alias("p"))


def nearest_language(texts: DataFrame, model: DataFrame, w: int) -> DataFrame:
    """(id, lang, distance): the language whose distribution is nearest in L1 to that of each text of (id, text), the first in order on ties.

    Both distributions sum to 1, so the distance is 2 - 2 * sum of the smaller of both over shared grams: an inner join on grams. A text
    without grams has no row.
    """
    counts = texts.select("id", F.explode(char_grams(F.col("text"), w)).alias("gram")).groupBy("id", "gram").agg(F.count(F.lit(1)).alias("c"))
    own = counts.select("id", "gram", (F.col("c") / F.sum("c").over(Window.partitionBy("id"))).alias("q"))
    near = own.join(F.broadcast(model), "gram").groupBy("id", "lang").agg((2 - 2 * F.sum(F.least("p", "q"))).alias("d"))
    best = near.groupBy("id").agg(F.min(F.struct(F.round("d", 9).alias("d"), F.col("lang").alias("lang"))).alias("b"))
    return best.select("id", F.col("b.lang").alias("lang"), F.round("b.d", 6).alias("distance"))
