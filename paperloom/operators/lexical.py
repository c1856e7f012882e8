"""Lexical search over texts: keyword scans, exact and typo-tolerant scores, summaries, answers."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from paperloom.functions import text as T
from paperloom.functions.indic import expansions
from paperloom.functions.similarity import cross_weighted, fuzzy_word, lexical_word  # noqa: F401
from paperloom.plans.scratch import Scratch

# Words that name the tone of a text.
TONES = {
    "Financial / Transactional": ("paid", "amount", "rupees", "inr", "total", "challan", "fee", "bill", "invoice", "receipt", "gst", "bank", "account", "due", "subtotal", "tax"),
    "Official / Government": ("government", "ministry", "republic", "india", "aadhaar", "pan", "passport", "authority", "official", "gazette", "uidai", "voter", "certified"),
    "Academic / Educational": ("university", "college", "marksheet", "student", "roll", "exam", "grade", "credits", "semester", "cgpa", "degree", "faculty", "syllabus", "admission"),
    "Urgent / Action Required": ("urgent", "due immediately", "deadline", "penalty", "late fee", "notice", "warning", "expire", "disconnection", "immediate action"),
    "Legal / Contractual": ("agreement", "deed", "terms", "conditions", "party", "witness", "affidavit", "notary", "signature", "undertaking", "clause", "indemnity", "jurisdiction"),
}


def visible(images: DataFrame) -> DataFrame:
    """Rows that are not quarantined."""
    return images.where("not coalesce(is_quarantined, false)")


def keyword_scan(images: DataFrame, query: str, user_id: int | None = None) -> DataFrame:
    """Visible rows whose text, name or QR payload contains the query; wildcards of LIKE are ordinary characters."""
    hit = None
    for c in ("extracted_text", "image_name", "qr_payload"):
        one = F.coalesce(F.lower(c), F.lit("")).contains(query.lower())
        hit = one if hit is None else hit | one
    rows = visible(images).where(hit)
    return rows if user_id is None else rows.where(F.col("user_id") == user_id)


#: Words under which rows with a code are found.
CODE_WORDS = "qr qrcode qr_code barcode visual_object"


def visual_words() -> Column:
    """Words of a row's visual metadata: code words, the type, labels, types and data of its objects."""
    meta = F.from_json("visual_metadata", "struct<detected:boolean,type:string,objects:array<struct<label:string,type:string,data:string>>>")
    coded = F.coalesce("has_visual_objects", F.lit(False)) | F.coalesce(meta["detected"], F.lit(False)) | (F.trim(F.coalesce("qr_payload", F.lit(""))) != "")
    objects = F.transform(F.coalesce(meta["objects"], F.array().cast("array<struct<label:string,type:string,data:string>>")), lambda o: F.concat_ws(" ", o["label"], o["type"], o["data"]))
    return F.concat_ws(" ", F.when(coded, F.lit(CODE_WORDS)), meta["type"], F.array_join(objects, " "))


def searchable_text() -> Column:
    """Text, caption, payloads, web addresses, visual words and category of a row, blanks left out."""
    plain = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    own = [plain(F.col(c)) for c in ("extracted_text", "cleaned_text", "blip_caption", "qr_payload", "stego_payload")]
    urls = F.array_join(F.coalesce(F.from_json("entities_json", "struct<urls:array<string>>")["urls"], F.array().cast("array<string>")), " ")
    return F.concat_ws(" ", *own, plain(urls), plain(visual_words()), plain(F.col("category")))


def tone_counts(c: Column) -> dict[str, Column]:
    """Number of each tone's words that the text holds as whole words."""
    low = F.lower(c)
    return {tone: sum(low.rlike(rf"\b{w}\b").cast("int") for w in ws) for tone, ws in TONES.items()}


def tone(c: Column) -> Column:
    """The tone with the most words (the first on ties), its share, and an urgency flag."""
    n = tone_counts(c)
    total, best = sum(n.values()), F.greatest(*n.values())
    name = F.coalesce(*[F.when((v == best) & (best > 0), F.lit(k)) for k, v in n.items()], F.lit("general"))
    return F.struct(name.alias("tone"), F.when(total > 0, F.round(best / total, 4)).otherwise(0.0).alias("share"), (n["Urgent / Action Required"] > 0).alias("urgent"))


def sentence_scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sentence_no, score): summed share x idf of each sentence's words, document frequency over the sentences of the same text."""
    s = docs.select(key, F.posexplode(T.sentences(F.col(text))).alias("sentence_no", "sentence"))
    words = F.filter(T.all_of(F.lower("sentence"), "[a-z]{2,}"), lambda w: ~w.isin(*T.STOPWORDS))
    terms = s.select(key, "sentence_no", words.alias("ws")).select(key, "sentence_no", F.size("ws").alias("size"), F.explode("ws").alias("term"))
    tf = terms.groupBy(key, "sentence_no", "term", "size").agg(F.count("*").alias("c"))
    # one shuffle by text: windows over the (few) sentences of a text
    df = F.count("*").over(Window.partitionBy(key, "term"))
    n = s.groupBy(key).agg(F.count("*").alias("ns"))
    scored = tf.withColumn("df", df).join(n, key)
    return scored.groupBy(key, "sentence_no").agg(F.round(F.sum(F.col("c") / F.col("size") * (F.log((F.col("ns") + 1.0) / (F.col("df") + 1.0)) + 1.0)), 4).alias("score"))


def summary(docs: DataFrame, top: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, summary, n_sentences): the ``top`` best sentences of each text, in the order of the text."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "sentence_no")
    best = sentence_scores(docs, key, text).withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).select(key, "sentence_no")
    s = docs.select(key, F.posexplode(T.sentences(F.col(text))).alias("sentence_no", "sentence"))
    kept = best.join(s, [key, "sentence_no"]).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("sentence_no", "sentence"))).alias("all"))  # at most ``top`` a text
    return kept.select(key, F.array_join(F.transform("all", lambda x: x["sentence"]), " ").alias("summary"), F.size("all").alias("n_sentences"))


def dice_band(tokens: Column, word: str, exact: float = 0.9, fuzzy: float = 0.7) -> Column:
    """The similarity of the token nearest to a word, and the band it falls in; null without tokens."""
    best = F.array_max(F.transform(F.filter(tokens, lambda t: t != ""), lambda t: T.dice(t, F.lit(word))))
    return F.struct(best.alias("best"), F.when(best >= exact, "exact").when(best >= fuzzy, "fuzzy").otherwise("none").alias("band"))


def _close(tokens: Column, word: str, least: float = 0.75) -> Column:
    """Sum of the similarities of tokens to a word, of those that reach ``least``.

    A word of c letters has at least c - 1 pairs of letters, so a similarity
    needs a number of common pairs, which is tested before any set is built.
    """
    pairs, letters = sorted({word[i : i + 2] for i in range(len(word) - 1)}), len(set(word))
    if not pairs:
        return F.lit(0.0)
    need = max(1, math.ceil(least / 2 * (2 * letters - 1 + letters + len(pairs)) - letters - 1e-9))
    some = F.filter(tokens, lambda t: sum((t.contains(p).cast("int") for p in pairs), F.lit(0)) >= need)
    close = F.filter(F.transform(some, lambda t: T.dice(F.lit(word), t)), lambda x: x >= least)
    return F.aggregate(close, F.lit(0.0), lambda s, x: s + x)


def answer_sentences(images: DataFrame, words: tuple[str, ...], top: int, key: str = "id", text: str = "extracted_text") -> DataFrame:
    """(key, sentence, score): the best sentences of each text for the question's words."""
    parts = F.filter(F.transform(F.split(F.col(text), r"[.\n\r]+"), lambda s: F.trim(s)), lambda s: F.length(s) >= 5)
    s = images.select(key, F.explode(F.array_distinct(parts)).alias("sentence"))
    low = F.lower("sentence")
    s = s.withColumn("tokens", F.filter(T.all_of(low, r"[a-zA-Z0-9\x{0900}-\x{097F}]+"), lambda t: F.length(t) >= 2))
    dice = sum(_close(F.col("tokens"), w) for w in words)
    score = F.round((sum(low.contains(w).cast("int") for w in words) * 1.5 + dice) / float(len(words)), 3)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "sentence"))
    return s.withColumn("score", score).where("score > 0.2").withColumn("r", rank).where(F.col("r") <= top).select(key, "sentence", "score")


def answers(images: DataFrame, words: tuple[str, ...], top: int = 3) -> DataFrame:
    """(id, sentence, score, confidence): the ``top`` rows with the best sentence for the question's words, the smaller id on ties."""
    best = answer_sentences(visible(images), words, 1)
    return best.orderBy(F.desc("score"), "id").limit(top).withColumn("confidence", F.least(F.lit(0.98), F.round(F.col("score") * 0.85 + 0.15, 2)))


def specific_value(c: Column, kind: str) -> Column:
    """First amount, date or identifier of a text, '' if there is none."""
    pattern = {
        "amount": r"(?i)(?:₹|Rs\.?|INR)\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)",
        "date": r"([0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})",
        "id": r"(?i)(?:number|no\.?|id)\s*[:#-]?\s*([A-Z]{2,}[0-9/-]+[0-9])",
    }[kind]
    return F.regexp_extract(c, pattern, 1)


def density_summary(docs: DataFrame, top: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, rank, sentence, score): the densest sentences: numbers, currency words, capitals and a good length count."""
    s = docs.select(key, F.explode(F.array_distinct(T.sentences(F.col(text)))).alias("sentence"))
    capitals = F.size(T.all_of(F.col("sentence"), r"\b[A-Z]{3,}\b"))
    score = F.when(F.col("sentence").rlike(r"\d"), 2.0).otherwise(0.0) + F.when(F.lower("sentence").rlike(r"₹|\b(rs|inr|rupees|tax|gst|total|amount)\b"), 2.5).otherwise(0.0) + capitals * 0.8 + F.when(F.length("sentence").between(15, 120), 1.5).otherwise(0.0)
    ranked = s.withColumn("score", F.round(score, 4)).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "sentence")))
    return ranked.where(F.col("rank") <= top)


def vocabulary_scores(terms: DataFrame, queries: tuple[str, ...], measure: Callable[[str, str], float], least: float) -> DataFrame:
    """(q, term, sim) of every distinct term with each query word, sim >= ``least``; each pair is measured once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(q, w, s) for w in b["term"] for q in queries if (s := measure(q, w)) >= least]
            yield pd.DataFrame(rows, columns=["q", "term", "sim"])

    # a vocabulary is small in bytes, but each word costs Python time: it is spread over all cores
    spread = terms.select("term").distinct().repartition(terms.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInPandas(run, "q string, term string, sim double")


def fuzzy_vocabulary(docs: DataFrame, queries: tuple[str, ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Vocabulary words within the typo guards of each query word."""
    terms = docs.select(F.explode(T.lexical_tokens(F.col(text))).alias("term"))
    return vocabulary_scores(terms, queries, fuzzy_word, 0.01).withColumn("sim", F.round("sim", 6))


_READ = {"extracted_text": "string", "cleaned_text": "string", "blip_caption": "string", "qr_payload": "string", "stego_payload": "string", "entities_json": "string", "visual_metadata": "string", "category": "string", "has_visual_objects": "boolean"}


def _searched(images: DataFrame) -> DataFrame:
    """Visible rows with every column that is searched; one that is missing is null."""
    return visible(images).withColumns({c: F.lit(None).cast(kind) for c, kind in _READ.items() if c not in images.columns})


def _name_words() -> Column:
    return T.lexical_tokens(F.translate(F.coalesce("image_name", F.lit("")), "_-.", "   "))


def _body_words() -> Column:
    return T.lexical_tokens(F.translate(searchable_text(), "_-", "  "))


def _query_words(query: str) -> list[str]:
    return [w for w in dict.fromkeys(re.findall(r"[a-z0-9ऀ-ॿ]+", query.lower())) if w not in T.STOPWORDS and (len(w) >= 2 or w.isdigit())]


def _held(queries: list[str]) -> Column:
    """Whether name or searchable text hold one of the queries: a number as a whole number, anything else as it stands."""
    whole = F.lower(F.translate(F.concat_ws(" ", "image_name", searchable_text()), "_-", "  "))
    tests = [whole.rlike(rf"(?:^|[^0-9]){q}(?:[^0-9]|$)") if q.isdigit() else whole.contains(q.translate(str.maketrans("_-", "  "))) for q in queries]
    return reduce(Column.__or__, tests)


def exact_search(images: DataFrame, query: str, least: float = 0.65) -> DataFrame:
    """(id, score): 1 where a row holds the query or its counterpart in the other script, else the mean over the query's words of their best word.

    Of several forms of the query the best counts.  Whole-phrase rows are
    answered in the scan; only the distinct vocabulary goes through Python,
    once for all forms, and is joined back to the words of the rows.
    """
    rows, forms = _searched(images), list(dict.fromkeys(q for x in expansions(query.lower().strip()) if (q := x.lower().strip())))
    if not forms:
        return rows.select("id", F.lit(1.0).alias("score")).where("false")
    held = F.coalesce(_held(forms), F.lit(False))
    # the searchable text is put together once; what follows reads flags and words only
    words = F.when(~F.col("held"), F.array_distinct(F.concat(_name_words(), _body_words())))
    read = Scratch(images.sparkSession).put(rows.withColumn("held", held).select("id", "held", words.alias("words")))
    whole = read.where("held").select("id", F.lit(1.0).alias("score"))
    parts = {q: _query_words(q) for q in forms if not q.isdigit()}
    parts = {q: ws for q, ws in parts.items() if ws}
    if not parts:
        return whole
    terms = read.where("not held").select("id", F.explode("words").alias("term"))
    sims = vocabulary_scores(terms, tuple(dict.fromkeys(w for ws in parts.values() for w in ws)), lexical_word, 0.3)
    best = terms.join(sims, "term").groupBy("id").pivot("q", sorted({w for ws in parts.values() for w in ws})).agg(F.max("sim"))
    means = [sum((F.coalesce(F.col(f"`{w}`"), F.lit(0.0)) for w in ws), F.lit(0.0)) / float(len(ws)) for ws in parts.values()]
    scored = best.select("id", F.round(F.greatest(*means) if len(means) > 1 else means[0], 4).alias("score"))
    return whole.unionByName(scored.where(F.col("score") >= least))


def fuzzy_search(images: DataFrame, query: str, least: float = 0.65) -> DataFrame:
    """(id, score): mean over query words of the best typo similarity, raised by name hits and repeats, at most 0.99 a word."""
    words = tuple(_query_words(query))
    read = Scratch(images.sparkSession).put(_searched(images).select("id", _name_words().alias("name"), _body_words().alias("body")))
    terms = read.select("id", F.explode("name").alias("term"), F.lit(1).alias("in_name")).unionByName(read.select("id", F.explode("body").alias("term"), F.lit(0).alias("in_name")))
    sims = vocabulary_scores(terms, words, fuzzy_word, 0.01)
    hits = terms.join(sims, "term")
    strong = F.col("sim") >= 0.74
    name_best = F.max(F.when((F.col("in_name") == 1) & strong, F.col("sim")))
    body_best = F.max(F.when(F.col("in_name") == 0, F.col("sim")))
    repeats = F.count_if((F.col("in_name") == 0) & strong)
    per = hits.groupBy("id", "q").agg(F.greatest(name_best, body_best).alias("best"), name_best.isNotNull().alias("named"), repeats.alias("k"))
    boost = F.when(F.col("named"), 0.05).otherwise(0.0) + F.when(F.col("k") > 1, F.least(F.lit(0.04), (F.col("k") - 1) * 0.01)).otherwise(0.0)
    word = F.when(F.col("best") > 0, F.least(F.lit(0.99), F.col("best") + boost)).otherwise(0.0)
    return per.groupBy("id").agg(F.round(F.sum(word) / float(max(1, len(words))), 4).alias("score")).where(F.col("score") >= least)


def unified_search(images: DataFrame, query: str, least: float = 0.65, enough: int = 3) -> DataFrame:
    """(id, score, is_exact): exact hits, and typo-tolerant ones where there are fewer than ``enough`` exact hits.

    Exact hits are written once and counted up to ``enough``; the typo-tolerant
    pass over the rows is only planned if it is needed.
    """
    exact = Scratch(images.sparkSession).put(exact_search(images, query, least))
    if exact.limit(enough).count() >= enough:
        return exact.select("id", "score", F.lit(True).alias("is_exact"))
    both = exact.join(fuzzy_search(images, query, least).withColumnRenamed("score", "fuzzy"), "id", "full_outer")
    return both.select("id", F.greatest("score", "fuzzy").alias("score"), (F.col("score").isNotNull() & (F.coalesce("fuzzy", F.lit(0.0)) <= F.col("score"))).alias("is_exact"))
