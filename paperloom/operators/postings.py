"""Positional postings: phrases, proximity, statistics, keyword weights."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from paperloom.functions import text as T


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, pos) of every word, positions from 0; null texts have none."""
    return docs.select(key, F.posexplode(T.index_tokens(F.col(text))).alias("pos", "term")).select(key, "term", "pos")


def lengths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_terms); texts without words count 0."""
    return docs.select(key, F.coalesce(F.size(T.index_tokens(F.col(text))), F.lit(0)).alias("n_terms"))


def phrase_search(docs: DataFrame, phrase: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, phrase_count, score): texts with the words of the phrase side by side.

    A match of all words at offsets 0, 1, ... is a group of (key, pos - offset)
    with every offset, so one aggregate serves any number of words.  The score
    is share of the text x inverse document frequency x words.
    """
    words = [w for w in phrase.lower().split() if w]
    if not words:
        return docs.sparkSession.createDataFrame([], f"{key} long, phrase_count long, score double")
    tokens = docs.select(key, T.index_tokens(F.col(text)).alias("toks")).where(F.col("toks").isNotNull())
    total = docs.select(F.count("*").alias("n_docs"))
    every = F.lit(True)
    for w in dict.fromkeys(words):
        every = every & F.array_contains("toks", w)
    with_all = tokens.where(every)
    # counted in the joined words: a lambda over positions would split the text anew at each of them
    joined = F.concat(F.lit(" "), F.array_join("toks", " "), F.lit(" "))
    hits = F.regexp_count(joined, F.lit("(?<= )" + re.escape(" ".join(words)) + "(?= )"))
    counted = with_all.select(key, F.size("toks").alias("n_terms"), hits.cast("long").alias("phrase_count"))
    df = counted.select(F.count("*").alias("df"))
    factor = float(len(words)) if len(words) > 1 else 1.0
    score = F.round(F.col("phrase_count") / F.col("n_terms") * (F.log((F.col("n_docs") + 1.0) / (F.col("df") + 1.0)) + 1.0) * factor, 4)
    # two one-row sides: aggregates, not tables
    return counted.where("phrase_count > 0").crossJoin(F.broadcast(df)).crossJoin(F.broadcast(total)).select(key, "phrase_count", score.alias("score"))


def proximity_search(docs: DataFrame, first: str, second: str, distance: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, min_distance, score): texts with both words at most ``distance`` words apart."""
    toks = docs.select(key, T.index_tokens(F.col(text)).alias("toks"))
    at = lambda w: F.filter(F.transform("toks", lambda x, i: F.when(x == w.lower(), i)), lambda p: p.isNotNull())
    places = toks.where(F.array_contains("toks", first.lower()) & F.array_contains("toks", second.lower())).select(key, F.explode(F.array(F.struct(at(first).alias("p"), at(second).alias("q")))).alias("at"))
    gaps = F.flatten(F.transform("at.p", lambda p: F.transform("at.q", lambda q: F.abs(p - q))))
    nearest = F.array_min(F.filter(gaps, lambda g: (g > 0) & (g <= distance)))
    found = places.select(key, nearest.alias("min_distance")).where("min_distance is not null")
    return found.select(key, F.col("min_distance").cast("long").alias("min_distance"), F.round(1.0 / (F.col("min_distance") + 0.5), 3).alias("score"))


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row: vocabulary size, (term, text) pairs, positions, texts."""
    pairs = postings(docs, key, text).groupBy("term", key).agg(F.count("*").alias("tf"))
    terms = pairs.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return terms.agg(F.count("*").alias("vocabulary"), F.coalesce(F.sum("df"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("cf"), F.lit(0)).alias("positions"))


def keyword_weights(docs: DataFrame, group: str, top: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(group, term, weight, rank): the ``top`` words of each group by summed tf x idf over all texts."""
    from pyspark.sql import Window

    words = docs.select(group, key, F.explode(F.filter(T.lexical_tokens(F.col(text)), lambda w: F.length(w) > 3)).alias("term"))
    tf = words.groupBy(group, "term").agg(F.count("*").alias("tf"))
    df = words.select(key, "term").distinct().groupBy("term").agg(F.count("*").alias("df"))
    n = docs.select(F.count("*").alias("n_docs"))
    weight = F.round(F.col("tf") * (F.log((F.col("n_docs") + 1.0) / (F.col("df") + 1.0)) + 1.0), 4)
    scored = tf.join(df, "term").crossJoin(F.broadcast(n)).select(group, "term", weight.alias("weight"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("weight"), "term"))).where(F.col("rank") <= top)
