"""Language detection by profiles of word-bounded character n-grams; profile(lang, gram, freq).

A text's grams are weighed by the logarithm of their share in each language's profile; the languages' likelihoods, made to sum to
1, are the probabilities. Grams are made of the different words of a text, each counted once with its number, and weighed where they
stand: only a text's sums by language are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.operators import tokens

SIZE, GRAMS, LEAST = 3, 300, 0.1
#: What a gram that a profile lacks counts as.
SMOOTHING = 0.5


def grams(word: Column, size: int = SIZE) -> Column:
    """The n-grams of a word with a blank at either end."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    return F.when(F.length(padded) >= size, F.transform(F.sequence(F.lit(1), F.length(padded) - size + 1), lambda i: F.substring(padded, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def words(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, word, cnt) of texts(keys, text): letters in a row, in small letters; each text for itself."""
    return tokens.counted(texts, keys, F.split(F.lower("text"), r"[\s\p{P}\p{S}0-9]+", -1), "word")


def gram_rows(texts: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """(keys, gram, cnt), a row for each different word of a text that holds the gram."""
    return words(texts, keys).select(*keys, F.explode(grams(F.col("word"), size)).alias("gram"), "cnt")


def counted(texts: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """(keys, gram, cnt)."""
    return gram_rows(texts, keys, size).groupBy(*keys, "gram").agg(F.sum("cnt").alias("cnt"))


def profiles(texts: DataFrame, most: int = GRAMS, size: int = SIZE) -> DataFrame:
    """(lang, gram, freq): the most frequent grams of each language, from texts(lang, text)."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("cnt").desc(), "gram"))
    return counted(texts, ["lang"], size).withColumn("r", rank).where(F.col("r") <= most).select("lang", "gram", F.col("cnt").alias("freq"))


def overridden(*sources: DataFrame) -> DataFrame:
    """One set of profiles out of built-in, extra and own ones; a later source takes the place of an earlier one's language."""
    out = sources[0]
    for later in sources[1:]:
        out = out.join(later.select("lang").distinct(), "lang", "left_anti").select("lang", "gram", "freq").union(later.select("lang", "gram", "freq"))
    return out


def detected(texts: DataFrame, keys: list[str], profile: DataFrame, least: float = LEAST, size: int = SIZE) -> DataFrame:
    """(keys, lang, prob): languages of at least that probability; texts without a known gram have none."""
    total = profile.groupBy("lang").agg(F.sum("freq").alias("total"), F.count("*").alias("n"))
    weighed = profile.join(total, "lang").select("lang", "gram", (F.log(F.col("freq") + SMOOTHING) - F.log(F.lit(SMOOTHING))).alias("w"))
    # of what all grams weigh in a language only those in its profile differ from the smoothing, so only they are joined
    base = total.select("lang", (F.log(F.lit(SMOOTHING)) - F.log(F.col("total") + SMOOTHING * (F.col("n") + 1))).alias("base"))
    # a row without language for each gram of any profile, which makes the mass; what is summed is summed before it is shuffled
    every = profile.select("gram").distinct().select(F.lit(None).cast("string").alias("lang"), "gram", F.lit(1.0).alias("w"))
    s = gram_rows(texts, keys, size).join(weighed.union(every), "gram").groupBy(*keys, "lang").agg(F.sum(F.col("cnt") * F.col("w")).alias("s"))
    w = Window.partitionBy(*keys)
    mass = F.max(F.when(F.col("lang").isNull(), F.col("s"))).over(w)
    score = s.withColumn("mass", mass).join(base, "lang").withColumn("score", F.col("s") + F.col("mass") * F.col("base"))
    p = F.exp(F.col("score") - F.max("score").over(w))
    prob = score.withColumn("p", p).withColumn("prob", F.round(F.col("p") / F.sum("p").over(w), 6))
    return prob.where(F.col("prob") >= least).select(*keys, "lang", "prob")


def best(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lang): the most probable, the first by code among equals."""
    return most_probable(found, keys).drop("prob")


def most_probable(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lang, prob): the most probable, the first by code among equals."""
    return found.groupBy(*keys).agg(F.min(F.struct((-F.col("prob")).alias("p"), "lang")).alias("m")).select(*keys, F.col("m.lang").alias("lang"), (-F.col("m.p")).alias("prob"))
