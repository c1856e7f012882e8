"""Vector ranking, fusion of signals, thresholds, profiles, classes, clusters, rules, measures of retrieval."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperloom.functions import scores as S, text as T
from paperloom.plans.scratch import Scratch

# Words of the clusters.
CLUSTERS = (
    ("Bills & Invoices", ("total", "amount", "tax", "gst", "invoice", "receipt", "challan", "paid", "bill", "subtotal", "cgst", "sgst")),
    ("Government & Identity Cards", ("government", "india", "aadhaar", "pan", "card", "dob", "enrollment", "identity", "driving", "license", "voter")),
    ("Academic & College", ("university", "college", "marksheet", "grade", "semester", "roll", "exam", "student", "certificate", "institute", "faculty", "education")),
    ("Medical & Healthcare", ("hospital", "clinic", "doctor", "prescription", "patient", "medical", "pharmacy", "tablet", "diagnosis", "report", "lab")),
    ("Legal & Agreements", ("agreement", "stamp", "notary", "affidavit", "deed", "terms", "witness", "party", "contract")),
)


def similar_to(vectors: DataFrame, key: str, vector: str, probe: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, ``carry`` columns, sim) of every row to the vector of ``probe`` (one row, column q), four decimals."""
    # one probe row: a scalar side, not a table
    return vectors.crossJoin(F.broadcast(probe)).select(key, *carry, F.round(S.cosine(F.col(vector), F.col("q")), 4).alias("sim"))


def adaptive_threshold(scores: DataFrame, query: str, low: float = 0.30, high: float = 0.85, extra: list[Column] | None = None) -> DataFrame:
    """One row, column tau: mean + .2 deviations - .05 ln(1 + length), clamped; ``low`` without scores; ``extra`` aggregates beside it."""
    tau = F.avg("score") + 0.20 * F.stddev_pop("score") - 0.05 * math.log(1 + len(query))
    return scores.agg(F.coalesce(F.round(F.greatest(F.lit(low), F.least(F.lit(high), tau)), 4), F.lit(low)).alias("tau"), *(extra or []))


def fuse(text: DataFrame, visual: DataFrame, query: str) -> DataFrame:
    """(id, score, search_type) of text candidates (id, t, is_kw) and visual ones (id, v), fused, thresholded and pruned.

    One full outer join, written once; the threshold and the prune flag are two
    scalars of one row over it that is joined back.
    """
    j = text.join(visual, "id", "full_outer")
    v = S.visual_norm(F.col("v"))
    kw = F.coalesce("is_kw", F.lit(False))
    both = F.when(kw & (F.col("t") >= 0.98), 1.0).otherwise(F.round(F.least(F.lit(0.95), F.greatest("t", v) * 0.85 + F.least("t", v) * 0.15), 3))
    only = F.when(kw & (F.col("t") >= 0.98), 1.0).when(kw | (F.col("t") >= 0.40), F.round(F.least(F.lit(0.95), F.col("t")), 3))
    score = F.when(F.col("t").isNotNull() & F.col("v").isNotNull(), both).when(F.col("t").isNotNull(), only).when(F.col("v") >= 0.205, F.round(v, 3))
    kind = F.when(F.col("t").isNotNull() & F.col("v").isNotNull(), "multimodal").when(F.col("t").isNotNull() & kw, "keyword").when(F.col("t").isNotNull(), "semantic").otherwise("visual")
    fused = j.select("id", score.alias("score"), kind.alias("search_type")).where("score is not null")
    fused = Scratch(text.sparkSession).put(fused)
    loud = F.max(F.when(F.col("search_type") != "visual", F.col("score")))
    bounds = adaptive_threshold(fused, query, extra=[F.coalesce(loud, F.lit(0.0)).alias("loud")])
    # a sure hit must itself reach the threshold
    prune = (F.col("loud") >= F.greatest(F.lit(0.85), "tau")) & (F.col("search_type") == "visual") & (F.col("score") < 0.5)
    return fused.crossJoin(F.broadcast(bounds)).where((F.col("score") >= F.col("tau")) & ~prune).select("id", "score", "search_type")


def collapse(hits: DataFrame, canonical: DataFrame) -> DataFrame:
    """(canonical_id, id, score, variants): the best hit of each canonical group and how many stand behind it."""
    j = hits.join(canonical, "id", "left").withColumn("canonical_id", F.coalesce("canonical_id", "id"))
    best = F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id")))
    return j.groupBy("canonical_id").agg(best.alias("b"), (F.count("*") - 1).alias("variants")).select("canonical_id", "b.id", "b.score", "variants")


def best_with_tolerance(regions: DataFrame, by: str, generic: tuple[str, ...], delta: float) -> DataFrame:
    """(by, region, sim): the most similar region, or a specific one within ``delta`` of it if the best is generic."""
    top = regions.groupBy(by).agg(F.max("sim").alias("top"), F.max_by(F.struct("region", "source"), F.struct("sim", -F.col("region"))).alias("first"))
    j = regions.join(top, by)
    usable = ~F.col("source").isin(*generic) & (F.col("sim") >= F.col("top") - delta)
    alt = F.max_by(F.struct("region", "sim"), F.when(usable, F.struct("sim", -F.col("region"))))
    picked = j.groupBy(by, "first", "top").agg(F.when(F.max(usable.cast("int")) == 1, alt).alias("alt"))
    use = F.col("first.source").isin(*generic) & F.col("alt").isNotNull()
    return picked.select(by, F.when(use, F.col("alt.region")).otherwise(F.col("first.region")).alias("region"), F.when(use, F.col("alt.sim")).otherwise(F.col("top")).alias("sim"))


def profile(feedback: DataFrame, docs: DataFrame) -> DataFrame:
    """(user, tag, pos, neg): half a point for each distinct word of more than three letters of a judged text.

    ``feedback``: user, doc_id, relevant.  The log is append-only; state is its aggregate.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.length(w) > 3))
    tags = feedback.join(docs.select("doc_id", "text"), "doc_id").select("user", "relevant", F.explode(words).alias("tag"))
    return tags.groupBy("user", "tag").agg(F.sum(F.when(F.col("relevant"), 0.5).otherwise(0.0)).alias("pos"), F.sum(F.when(~F.col("relevant"), 0.5).otherwise(0.0)).alias("neg"))


def object_profile(feedback: DataFrame, docs: DataFrame) -> DataFrame:
    """(user, tag, pos, neg): one point for each visual object (column ``objects``) of a judged row."""
    tags = feedback.join(docs.select("doc_id", "objects"), "doc_id").select("user", "relevant", F.explode(F.transform("objects", F.lower)).alias("tag"))
    return _points(tags, "tag", 1.0)


def category_profile(feedback: DataFrame, docs: DataFrame) -> DataFrame:
    """(user, category, pos, neg): one point for the category of a judged row; rows without one give none."""
    rows = feedback.join(docs.select("doc_id", "category"), "doc_id").where("category <> ''")
    return _points(rows, "category", 1.0)


def _points(rows: DataFrame, tag: str, weight: float) -> DataFrame:
    side = lambda c: F.sum(F.when(c, weight).otherwise(0.0))
    return rows.groupBy("user", tag).agg(side(F.col("relevant")).alias("pos"), side(~F.col("relevant")).alias("neg"))


# Weights of text, vector and proximity, at first and for users with more than five points.
FUSION_WEIGHTS, VISUAL_WEIGHTS = (0.40, 0.40, 0.20), (0.30, 0.55, 0.15)


def fusion_weights(profiles: DataFrame) -> DataFrame:
    """(user, alpha, beta, gamma): the weights of a user's fused search, by the sum of the positive points of all tags."""
    much = F.sum("pos") > 5.0
    names = ("alpha", "beta", "gamma")
    return profiles.groupBy("user").agg(*[F.when(much, b).otherwise(a).alias(n) for n, a, b in zip(names, FUSION_WEIGHTS, VISUAL_WEIGHTS)])


def matching_cluster(sizes: DataFrame, keywords: DataFrame, instruction: str) -> DataFrame:
    """One row (cluster, confidence, n, reduction): the cluster whose name and keywords an instruction holds most, the larger on ties.

    ``sizes``: cluster, n; ``keywords``: cluster, term.  ``reduction`` is the
    share of rows, in per cent, that need not be searched.
    """
    low = instruction.lower()
    words = sorted(set(re.findall(r"\w+", low)))
    held = keywords.where(F.lower("term").isin(*words)).groupBy("cluster").agg(F.count("*").alias("k"))
    named = F.when(F.lit(low).contains(F.lower("cluster")), 3.0).otherwise(0.0)
    scored = sizes.join(held, "cluster", "left").withColumn("score", named + 1.5 * F.coalesce("k", F.lit(0)))
    best = scored.agg(F.max(F.struct("score", "n", "cluster")).alias("b"), F.sum("n").alias("total"))
    confidence = F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.50), 0.50 + 0.15 * F.col("b.score"))), 2)
    return best.where("b is not null").select("b.cluster", confidence.alias("confidence"), "b.n", F.round((1.0 - F.col("b.n") / F.col("total")) * 100, 1).alias("reduction"))


def top_tags(profiles: DataFrame, n: int = 5) -> DataFrame:
    """(user, tag, pos, place): the n best tags of each user."""
    w = Window.partitionBy("user").orderBy(F.desc("pos"), "tag")
    return profiles.where("pos > 0").withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("user", "tag", "pos", "place")


def personalised(hits: DataFrame, docs: DataFrame, tags: DataFrame) -> DataFrame:
    """(doc_id, score): base score + min(.4, .08 pos) - min(.6, .15 neg) of one user's tags, at least .01."""
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("tag"))
    sums = words.join(tags.select("tag", "pos", "neg"), "tag").groupBy("doc_id").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    s = F.col("score") + F.least(F.lit(0.40), 0.08 * F.coalesce("pos", F.lit(0.0))) - F.least(F.lit(0.60), 0.15 * F.coalesce("neg", F.lit(0.0)))
    return hits.join(sums, "doc_id", "left").select("doc_id", F.round(F.greatest(F.lit(0.01), s), 4).alias("score"))


def cluster_of(c: Column) -> Column:
    """The cluster with the most words in the text, the first on ties, General without any."""
    low = F.lower(c)
    hits = [(name, sum(low.contains(w).cast("int") for w in words)) for name, words in CLUSTERS]
    best = F.greatest(*[h for _, h in hits])
    return F.coalesce(*[F.when((h == best) & (best > 0), F.lit(name)) for name, h in hits], F.lit("General"))


def train_bernoulli(docs: DataFrame, label: str, words: tuple[str, ...]) -> DataFrame:
    """(label, n_docs, word, p): Laplace estimate (n + 1) / (N + 2) of each word in each class."""
    low = F.lower("text")
    has = docs.where(F.col(label).isNotNull()).select(label, *[low.rlike(rf"\b{w}\b").cast("int").alias(w) for w in words])
    n = has.groupBy(label).agg(F.count("*").alias("n_docs"), *[F.coalesce(F.sum(w), F.lit(0)).alias(w) for w in words])
    cells = F.explode(F.array(*[F.struct(F.lit(w).alias("word"), F.col(w).alias("n")) for w in words])).alias("c")
    return n.select(label, "n_docs", cells).select(label, "n_docs", "c.word", ((F.col("c.n") + 1.0) / (F.col("n_docs") + 2.0)).alias("p"))


#: Classes a model may have at most, as its weights become part of the expression.
MOST_CLASSES = 200


def predict_bernoulli(docs: DataFrame, key: str, model: DataFrame, label: str, words: tuple[str, ...]) -> DataFrame:
    """(key, predicted, confidence): the class with the largest posterior (the smaller name on ties), four decimals.

    The model has one row per class and word; its weights are literals of one
    expression over the row, so texts are scored in their scan, without a
    shuffle.  A class weighs in with its share and the absence of every word;
    each word that is there adds its lift.
    """
    rows = model.select(label, "n_docs", "word", "p").limit(MOST_CLASSES * len(words) + 1).collect()
    if len(rows) > MOST_CLASSES * len(words):
        raise ValueError(f"more than {MOST_CLASSES} classes")
    classes = sorted({r[label] for r in rows})
    if not classes:
        return docs.select(key, F.lit(None).cast("string").alias("predicted"), F.lit(None).cast("double").alias("confidence"))
    p = {(r[label], r.word): r.p for r in rows}
    n = {r[label]: r.n_docs for r in rows}
    low = F.lower("text")
    has = docs.select(key, *[F.coalesce(low.rlike(rf"\b{w}\b"), F.lit(False)).cast("int").alias(f"has_{i}") for i, w in enumerate(words)])
    total = sum(n.values())
    base = {c: math.log(n[c]) + sum(math.log(1.0 - p[c, w]) for w in words) - math.log(total) for c in classes}
    lp = [sum((F.col(f"has_{i}") * (math.log(p[c, w]) - math.log(1.0 - p[c, w])) for i, w in enumerate(words)), F.lit(base[c])) for c in classes]
    logs = has.select(key, F.array(*[F.struct(v.alias("lp"), F.lit(c).alias("name")) for c, v in zip(classes, lp)]).alias("all"))
    most = logs.withColumn("m", F.array_max(F.transform("all", lambda x: x["lp"])))
    share = 1.0 / F.aggregate("all", F.lit(0.0), lambda s, x: s + F.exp(x["lp"] - F.col("m")))
    first = F.element_at(F.filter("all", lambda x: F.round(x["lp"], 9) == F.round("m", 9)), 1)["name"]
    return most.select(key, first.alias("predicted"), F.round(share, 4).alias("confidence"))


def fire_rules(rows: DataFrame, rules: list[tuple[str, int, Column, float]], key: str = "id") -> DataFrame:
    """(key, rule, certainty): rules (name, priority, condition, factor) that hold, in order of priority; rules are data."""
    fired = F.array(*[F.struct(F.lit(p).alias("priority"), F.when(F.coalesce(c, F.lit(False)), F.lit(n)).alias("rule"), F.lit(f).alias("certainty")) for n, p, c, f in rules])
    held = F.filter(F.sort_array(fired), lambda r: r["rule"].isNotNull())
    return rows.select(key, F.posexplode(held).alias("place", "r")).select(key, "place", "r.rule", F.round("r.certainty", 3).alias("certainty"))


def precision_measures(hits: DataFrame, by: str, k: int = 10) -> DataFrame:
    """(by, ap, p5, p10, mrr): average precision at k, precision at 5 and 10, reciprocal rank of the first hit.

    ``hits``: by, id, s (score), relevant; the smaller id comes first on ties.
    Only the k first places are ranked; the place of the first relevant hit is
    counted, so no query's hits are sorted in one task.
    """
    order = F.struct("s", (-F.col("id")).alias("i"))
    first = hits.groupBy(by).agg(F.max(F.when(F.col("relevant"), order)).alias("best"), F.count_if("relevant").alias("n_relevant"))
    # one row per query
    before = hits.join(F.broadcast(first), by).where(order >= F.col("best")).groupBy(by).agg(F.count("*").alias("first_place"))
    top = hits.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("s"), "id"))).where(F.col("place") <= k)
    found = top.withColumn("h", F.sum(F.col("relevant").cast("int")).over(Window.partitionBy(by).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))).where("relevant")
    per = found.groupBy(by).agg(F.sum(F.col("h") / F.col("place")).alias("gain"), F.count_if(F.col("place") <= 5).alias("in5"), F.count_if(F.col("place") <= 10).alias("in10"))
    j = first.join(before, by, "left").join(per, by, "left")
    none = F.lit(0)
    return j.select(
        by,
        F.round(F.coalesce("gain", F.lit(0.0)) / F.greatest(F.lit(1), F.least(F.lit(k), "n_relevant")), 4).alias("ap"),
        F.round(F.coalesce("in5", none) / 5.0, 4).alias("p5"),
        F.round(F.coalesce("in10", none) / 10.0, 4).alias("p10"),
        F.round(F.coalesce(1.0 / F.col("first_place"), F.lit(0.0)), 4).alias("mrr"),
    )


def stratified_split(rows: DataFrame, by: str, key: str = "id") -> DataFrame:
    """(key, part): 70 / 15 / 15 dev, val, test within each stratum, in the order of a hash.

    A stratum is cut into 4 096 ranges of the hash: rows are placed within
    their range and shifted by the ranges before it, so a stratum of any size
    is spread over many tasks.
    """
    hashed = rows.select(key, by, F.md5(F.col(key).cast("string")).alias("h")).withColumn("cell", F.substring("h", 1, 3))
    sizes = hashed.groupBy(by, "cell").agg(F.count("*").alias("size"))
    w = Window.partitionBy(by).orderBy("cell")
    shifts = sizes.select(F.col(by).alias("b"), F.col("cell").alias("c"), (F.sum("size").over(w) - F.col("size")).alias("shift"), F.sum("size").over(Window.partitionBy(by)).alias("n"))
    own = hashed.withColumn("r", F.row_number().over(Window.partitionBy(by, "cell").orderBy("h")))
    placed = own.join(shifts, F.col(by).eqNullSafe(F.col("b")) & (F.col("cell") == F.col("c")))
    share = (F.col("r") - 1 + F.col("shift")) / F.col("n")
    return placed.select(key, F.when(share < 0.70, "dev").when(share < 0.85, "val").otherwise("test").alias("part"))


def graph_code(features: Column, most: int = 15) -> Column:
    """Adjacency of the first distinct features: 1 where positions differ by at most two."""
    f = F.slice(F.array_distinct(features), 1, most)
    i = F.when(F.size(f) > 0, F.sequence(F.lit(1), F.size(f))).otherwise(F.array().cast("array<int>"))
    return F.transform(i, lambda a: F.transform(i, lambda b: ((a != b) & (F.abs(a - b) <= 2)).cast("int")))


def within_radius(images: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """(id, city, km) of rows whose text or name holds a hub within ``km`` of a place; the first hub of the list counts.

    The hubs are a fixed list of eleven, so city and place are literals of the
    expression and nothing is joined.
    """
    text = F.lower(F.concat_ws(" ", "extracted_text", "image_name"))
    hub = F.coalesce(*[F.when(text.contains(n), F.struct(F.lit(n).alias("city"), F.lit(a).alias("lat"), F.lit(b).alias("lon"))) for n, a, b in S.HUBS])
    rows = images.select("id", hub.alias("h")).where("h is not null")
    far = S.haversine(F.lit(lat), F.lit(lon), F.col("h.lat"), F.col("h.lon"))
    return rows.select("id", "h.city", far.alias("km")).where(F.col("km") <= km)
