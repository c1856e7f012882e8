"""Queries over vectors, scores, boxes, fusion, classes, profiles, measures and streams."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from paperloom.functions import scores as S
from paperloom.operators import lexical, ranking as R
from paperloom.plans.registry import query
from paperloom.sources.tables import load
from paperloom.streaming import ingest


def probe(spark, d):
    return load(spark, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))


_SIM = "SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 4) AS sim FROM embeddings"


@query(f"SELECT vec_id, sim FROM ({_SIM}) ORDER BY sim DESC, vec_id LIMIT 25")
def cosine_topk(spark, d):
    e = load(spark, d, "embeddings")
    return R.similar_to(e, "vec_id", "embedding", probe(spark, d)).orderBy(F.desc("sim"), "vec_id").limit(25)


@query(f"SELECT label, max(sim) AS sim, arg_max(vec_id, sim) AS vec_id FROM ({_SIM}) GROUP BY 1")
def region_best(spark, d):
    e = load(spark, d, "embeddings")
    sims = R.similar_to(e, "vec_id", "embedding", probe(spark, d), ("label",))
    return sims.groupBy("label").agg(F.max("sim").alias("sim"), F.max_by("vec_id", F.struct("sim", -F.col("vec_id"))).alias("vec_id"))


@query(f"""WITH s AS (SELECT label, vec_id AS region, sim, CASE WHEN vec_id % 3 = 0 THEN 'full_doc' ELSE 'card_proposal' END AS source FROM ({_SIM})),
 f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY sim DESC, region) = 1),
 a AS (SELECT s.* FROM s JOIN f USING (label) WHERE s.source <> 'full_doc' AND s.sim >= f.sim - 0.025 QUALIFY row_number() OVER (PARTITION BY s.label ORDER BY s.sim DESC, s.region) = 1)
SELECT f.label, CASE WHEN f.source = 'full_doc' AND a.region IS NOT NULL THEN a.region ELSE f.region END AS region, CASE WHEN f.source = 'full_doc' AND a.region IS NOT NULL THEN a.sim ELSE f.sim END AS sim FROM f LEFT JOIN a USING (label)""")
def region_pick(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", "label", "embedding")
    sims = R.similar_to(e, "vec_id", "embedding", probe(spark, d), ("label",))
    regions = sims.select("label", F.col("vec_id").alias("region"), "sim", F.when(F.col("vec_id") % 3 == 0, "full_doc").otherwise("card_proposal").alias("source"))
    return R.best_with_tolerance(regions, "label", ("full_doc",), 0.025)


@query(f"SELECT round(greatest(0.30, least(0.85, avg(sim) + 0.20 * stddev_pop(sim) - 0.05 * ln(1 + 12))), 4) AS tau FROM ({_SIM})")
def adaptive_threshold(spark, d):
    sims = R.similar_to(load(spark, d, "embeddings"), "vec_id", "embedding", probe(spark, d))
    return R.adaptive_threshold(sims.select(F.col("sim").alias("score")), "x" * 12)


def _text_side(spark, d):
    t = F.lower(F.coalesce("text", F.lit("")))
    hits = t.contains("amount").cast("int") + t.contains("payable").cast("int")
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), (hits / 2.0).alias("t"), t.contains("amount payable").alias("is_kw"))
    return docs.where("t > 0")


_FUSED = f"""WITH t AS (SELECT * FROM (SELECT doc_id AS id, (contains(lower(coalesce(text, '')), 'amount')::INT + contains(lower(coalesce(text, '')), 'payable')::INT) / 2.0::DOUBLE AS t, contains(lower(coalesce(text, '')), 'amount payable') AS is_kw FROM documents) WHERE t > 0),
 v AS (SELECT vec_id AS id, sim AS v, CASE WHEN sim <= 0.18 THEN greatest(0.1, sim) ELSE greatest(0.40, least(0.98, 0.45 + (sim - 0.18) * 0.5 / 0.14)) END AS n FROM ({_SIM}) WHERE sim >= 0.1),
 j AS (SELECT coalesce(t.id, v.id) AS id, t, coalesce(is_kw, false) AS kw, v, n FROM t FULL JOIN v ON t.id = v.id),
 f AS (SELECT id, CASE WHEN t IS NOT NULL AND v IS NOT NULL THEN CASE WHEN kw AND t >= 0.98 THEN 1.0 ELSE round(least(0.95, greatest(t, n) * 0.85 + least(t, n) * 0.15), 3) END
   WHEN t IS NOT NULL THEN CASE WHEN kw AND t >= 0.98 THEN 1.0 WHEN kw OR t >= 0.40 THEN round(least(0.95, t), 3) END WHEN v >= 0.205 THEN round(n, 3) END::DOUBLE AS score,
   CASE WHEN t IS NOT NULL AND v IS NOT NULL THEN 'multimodal' WHEN t IS NOT NULL AND kw THEN 'keyword' WHEN t IS NOT NULL THEN 'semantic' ELSE 'visual' END AS search_type FROM j),
 g AS (SELECT * FROM f WHERE score IS NOT NULL), tau AS (SELECT coalesce(round(greatest(0.30, least(0.85, avg(score) + 0.20 * stddev_pop(score) - 0.05 * ln(1 + 14))), 4), 0.3) AS tau FROM g),
 k AS (SELECT g.* FROM g, tau WHERE score >= tau), s AS (SELECT coalesce(bool_or(score >= 0.85 AND search_type <> 'visual'), false) AS sure FROM k)
SELECT k.id, k.score, k.search_type FROM k, s WHERE NOT (sure AND search_type = 'visual' AND score < 0.5)"""


@query(_FUSED)
def fused_search(spark, d):
    visual = R.similar_to(load(spark, d, "embeddings"), "vec_id", "embedding", probe(spark, d)).where("sim >= 0.1").select(F.col("vec_id").alias("id"), F.col("sim").alias("v"))
    return R.fuse(_text_side(spark, d), visual, "amount payable")


@query(f"""WITH h AS ({_FUSED}), c AS (SELECT h.id, h.score, coalesce(i.canonical_image_id, h.id) AS canonical_id FROM h LEFT JOIN images i ON i.id = h.id)
SELECT canonical_id::BIGINT AS canonical_id, arg_max(id, (score, -id)) AS id, max(score) AS score, count(*) - 1 AS variants FROM c GROUP BY 1""")
def collapsed_search(spark, d):
    canon = load(spark, d, "images").select("id", F.coalesce("canonical_image_id", "id").cast("long").alias("canonical_id"))
    return R.collapse(fused_search(spark, d), canon)


@query("SELECT l_orderkey, l_linenumber, round(0.35 * least(1.0, l_discount * 10) + 0.25 * least(1.0, l_tax * 10) + 0.15 * least(1.0, l_quantity / 50.0) + 0.10 * (CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 4) AS score FROM lineitem")
def hybrid_score(spark, d):
    li = load(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", S.hybrid(ocr=F.col("l_discount") * 10, semantic=F.col("l_tax") * 10, blip=F.col("l_quantity") / 50.0, qr=F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("score"))


@query("""SELECT l_orderkey, l_linenumber, round(greatest(0.0, least(1.0, 0.45 * l_discount + 0.20 * l_tax + 0.10 * (l_quantity / 50.0) - 0.05 * greatest(0.0, l_quantity / 50.0 - 0.5))), 4) AS keyword_score,
 round(greatest(0.0, least(1.0, 0.25 * l_discount + 0.35 * l_tax + 0.25 * (l_quantity / 50.0) - 0.02 * greatest(0.0, l_quantity / 50.0 - 0.5))), 4) AS sentence_score FROM lineitem""")
def entropy_fused_score(spark, d):
    s = {"ocr": F.col("l_discount"), "semantic": F.col("l_tax"), "blip": F.col("l_quantity") / 50.0}
    tamper = F.col("l_quantity") / 50.0
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.entropy_fused("pan", tamper, **s).alias("keyword_score"), S.entropy_fused("bills paid for the repair of the water pump", tamper, **s).alias("sentence_score"))


@query("SELECT p_partkey, round(0.5 / (1.0 + exp(-(p_size / 10.0))) + 0.3 * (p_retailprice / 2000.0) + 0.2 * 0.8, 4) AS grid, round(pow(greatest(p_retailprice / 2000.0, 0.001), 0.5) * pow(greatest(p_size / 50.0, 0.001), 0.25) * pow(0.9, 0.25), 4) AS product FROM part")
def power_grid_score(spark, d):
    text = F.col("p_retailprice") / 2000.0
    return load(spark, d, "part").select("p_partkey", S.power_grid(text, F.col("p_size") / 10.0, F.lit(0.8)).alias("grid"), S.geometric(text, F.col("p_size") / 50.0, F.lit(0.9)).alias("product"))


@query("""WITH c AS (SELECT p_partkey, lower(p_name) AS s FROM part), x AS (SELECT p_partkey, unnest(string_split(s, '')) AS ch, length(s) AS n FROM c), g AS (SELECT p_partkey, ch, count(*) / any_value(n)::DOUBLE AS p FROM x GROUP BY 1, 2)
SELECT p_partkey, round(sum(-p * log2(p)), 3) AS entropy FROM g GROUP BY 1""")
def shannon_entropy(spark, d):
    return load(spark, d, "part").select("p_partkey", S.entropy(F.col("p_name")).alias("entropy"))


_BOX = {k: f"TRY_CAST(json_extract_string(CASE WHEN json_valid(norm_bbox_json) THEN norm_bbox_json END, '$.{k}') AS DOUBLE)" for k in ("x", "y", "width", "height")}
_BOXES = f"SELECT * FROM (SELECT id, image_id, {_BOX['x']} AS x, {_BOX['y']} AS y, {_BOX['width']} AS w, {_BOX['height']} AS h FROM visual_regions) WHERE x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL"


def _boxes(spark, d):
    n = lambda k: F.get_json_object("norm_bbox_json", f"$.{k}").try_cast("double") if hasattr(F.col("x"), "try_cast") else F.get_json_object("norm_bbox_json", f"$.{k}").cast("double")
    return load(spark, d, "visual_regions").select("id", "image_id", n("x").alias("x"), n("y").alias("y"), n("width").alias("w"), n("height").alias("h")).where("x is not null and y is not null and w is not null and h is not null")


@query(f"""SELECT id, CASE WHEN w >= 0.85 AND h >= 0.85 THEN 'Full Document' WHEN x + w / 2 BETWEEN 0.35 AND 0.65 AND y + h / 2 BETWEEN 0.35 AND 0.65 THEN 'Center'
 ELSE (CASE WHEN y + h / 2 < 0.35 THEN 'Top' WHEN y + h / 2 > 0.65 THEN 'Bottom' ELSE 'Middle' END) || '-' || (CASE WHEN x + w / 2 < 0.35 THEN 'Left' WHEN x + w / 2 > 0.65 THEN 'Right' ELSE 'Center' END) END AS place FROM ({_BOXES})""")
def location_labels(spark, d):
    return _boxes(spark, d).select("id", S.place_name(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("place"))


@query(f"SELECT id, round(greatest(0, least(1, x - w * 0.1)), 7) AS x0, round(greatest(0, least(1, y - h * 0.1)), 7) AS y0, round(greatest(0, least(1, x + w + w * 0.1)), 7) AS x1, round(greatest(0, least(1, y + h + h * 0.1)), 7) AS y1 FROM ({_BOXES})")
def padded_boxes(spark, d):
    x, y, w, h = (F.col(c) for c in "xywh")
    return _boxes(spark, d).select("id", *[v.alias(n) for v, n in zip(S.pad_box(x, y, x + w, y + h, digits=7), ("x0", "y0", "x1", "y1"))])


@query(f"""WITH b AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(w) OVER w AS pw, lag(h) OVER w AS ph FROM ({_BOXES}) WINDOW w AS (PARTITION BY image_id ORDER BY id)),
 i AS (SELECT id, greatest(0.0, least(x + w, px + pw) - greatest(x, px)) * greatest(0.0, least(y + h, py + ph) - greatest(y, py)) AS i, w * h + pw * ph AS a FROM b WHERE px IS NOT NULL)
SELECT id, CASE WHEN a - i > 0 THEN round(i / (a - i), 4) ELSE 0.0 END AS iou FROM i""")
def box_overlap(spark, d):
    w = Window.partitionBy("image_id").orderBy("id")
    b = _boxes(spark, d).withColumn("p", F.lag(F.struct("x", "y", "w", "h")).over(w)).where("p is not null")
    return b.select("id", S.iou(tuple(F.col(c) for c in "xywh"), tuple(F.col(f"p.{c}") for c in "xywh")).alias("iou"))


@query("""SELECT i.id, json_extract_string(b, '$.text') AS token, round(TRY_CAST(json_extract_string(b, '$.confidence') AS DOUBLE) * ln(1 + length(regexp_replace(json_extract_string(b, '$.text'), '[^A-Za-z0-9]', '', 'g'))), 4) AS weight FROM (SELECT id, unnest(CAST(CASE WHEN json_valid(ocr_boxes_json) AND ocr_boxes_json LIKE '[%' THEN ocr_boxes_json ELSE '[]' END AS JSON[])) AS b FROM images) i""")
def ocr_tokens(spark, d):
    boxes = F.from_json("ocr_boxes_json", "array<struct<text:string,confidence:double>>")
    b = load(spark, d, "images").select("id", F.explode(boxes).alias("b"))
    return b.select("id", F.col("b.text").alias("token"), F.round(F.col("b.confidence") * F.log1p(F.length(F.regexp_replace("b.text", "[^A-Za-z0-9]", ""))), 4).alias("weight"))


@query("""SELECT id, CASE WHEN starts_with(lower(qr_payload), 'upi://') THEN 'upi' WHEN regexp_matches(lower(qr_payload), '^https?://') THEN 'url' WHEN starts_with(lower(qr_payload), 'begin:vcard') OR starts_with(lower(qr_payload), 'mecard:') THEN 'contact' ELSE 'text' END AS kind,
 nullif(regexp_extract(qr_payload, '[?&]pa=([^&]*)', 1), '') AS handle, TRY_CAST(nullif(regexp_extract(qr_payload, '[?&]am=([^&]*)', 1), '') AS DOUBLE) AS amount, nullif(regexp_extract(qr_payload, '(?i)^https?://([^/?#]+)', 1), '') AS host FROM images WHERE qr_payload IS NOT NULL""")
def qr_fields(spark, d):
    rows = load(spark, d, "images").where("qr_payload is not null").select("id", S.payload_fields(F.col("qr_payload")).alias("p"))
    return rows.select("id", "p.kind", "p.handle", "p.amount", "p.host")


_CL = "[" + ", ".join("(" + " + ".join(f"contains(lower(extracted_text), '{w}')::INT" for w in ws) + ")" for _, ws in R.CLUSTERS) + "]"
_NAMES = "[" + ", ".join(f"'{n}'" for n, _ in R.CLUSTERS) + "]"


@query(f"SELECT CASE WHEN list_max({_CL}) > 0 THEN {_NAMES}[list_position({_CL}, list_max({_CL}))] ELSE 'General' END AS cluster, count(*) AS n FROM images WHERE extracted_text IS NOT NULL GROUP BY 1")
def cluster_counts(spark, d):
    c = F.col("extracted_text")
    return load(spark, d, "images").where(c.isNotNull()).groupBy(R.cluster_of(c).alias("cluster")).agg(F.count("*").alias("n"))


NB_WORDS = ("invoice", "receipt", "amount", "bank", "account", "certificate", "student", "hospital", "patient", "prescription", "tablet", "meter", "units", "consignment", "scholarship", "stage", "chapter", "admission")
_HAS = ", ".join(f"regexp_matches(lower(text), '\\b{w}\\b')::INT AS {w}" for w in NB_WORDS)
_NBM = f"WITH h AS (SELECT doc_type, {_HAS} FROM documents WHERE doc_type IS NOT NULL), n AS (SELECT doc_type, count(*) AS n_docs, {', '.join(f'coalesce(sum({w}), 0) AS {w}' for w in NB_WORDS)} FROM h GROUP BY 1), m AS (" + " UNION ALL ".join(f"SELECT doc_type, n_docs, '{w}' AS word, ({w} + 1.0) / (n_docs + 2.0) AS p FROM n" for w in NB_WORDS) + ")"


@query(f"{_NBM} SELECT doc_type, n_docs, word, round(p, 6) AS p FROM m")
def nb_train(spark, d):
    return R.train_bernoulli(load(spark, d, "documents"), "doc_type", NB_WORDS).withColumn("p", F.round("p", 6))


@query(f"""{_NBM}, c AS (SELECT doc_type, ln(any_value(n_docs)) AS lp, sum(ln(1 - p)) AS base FROM m GROUP BY 1), tot AS (SELECT sum(n_docs) AS t FROM n), x AS (SELECT doc_id, unnest([{', '.join(repr(w) for w in NB_WORDS)}]) AS word, unnest([{', '.join("regexp_matches(lower(coalesce(text, '')), '" + chr(92) + "b" + w + chr(92) + "b')" for w in NB_WORDS)}]) AS has FROM documents),
 s AS (SELECT x.doc_id, m.doc_type, sum(ln(p) - ln(1 - p)) AS lift FROM x JOIN m USING (word) WHERE has GROUP BY 1, 2),
 f AS (SELECT d.doc_id, c.doc_type, lp + base - ln(t) + coalesce(lift, 0) AS lp FROM documents d CROSS JOIN c CROSS JOIN tot LEFT JOIN s ON s.doc_id = d.doc_id AND s.doc_type = c.doc_type),
 b AS (SELECT doc_id, max(lp) AS m FROM f GROUP BY 1)
SELECT f.doc_id, round(1.0 / sum(exp(f.lp - b.m)), 4) AS confidence FROM f JOIN b USING (doc_id) GROUP BY 1""")
def nb_confidence(spark, d):
    docs = load(spark, d, "documents")
    return R.predict_bernoulli(docs, "doc_id", R.train_bernoulli(docs, "doc_type", NB_WORDS), "doc_type", NB_WORDS).drop("predicted")


@query(f"""{_NBM}, c AS (SELECT doc_type, ln(any_value(n_docs)) AS lp, sum(ln(1 - p)) AS base FROM m GROUP BY 1), tot AS (SELECT sum(n_docs) AS t FROM n), x AS (SELECT doc_id, unnest([{', '.join(repr(w) for w in NB_WORDS)}]) AS word, unnest([{', '.join("regexp_matches(lower(coalesce(text, '')), '" + chr(92) + "b" + w + chr(92) + "b')" for w in NB_WORDS)}]) AS has FROM documents),
 s AS (SELECT x.doc_id, m.doc_type, sum(ln(p) - ln(1 - p)) AS lift FROM x JOIN m USING (word) WHERE has GROUP BY 1, 2),
 f AS (SELECT d.doc_id, c.doc_type, lp + base - ln(t) + coalesce(lift, 0) AS lp FROM documents d CROSS JOIN c CROSS JOIN tot LEFT JOIN s ON s.doc_id = d.doc_id AND s.doc_type = c.doc_type)
SELECT doc_id, doc_type AS predicted, round(1.0 / sum(exp(lp - m)) OVER (PARTITION BY doc_id), 4) AS confidence FROM (SELECT *, max(lp) OVER (PARTITION BY doc_id) AS m FROM f) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(lp, 9) DESC, doc_type) = 1""")
def nb_predict(spark, d):
    docs = load(spark, d, "documents")
    return R.predict_bernoulli(docs, "doc_id", R.train_bernoulli(docs, "doc_type", NB_WORDS), "doc_type", NB_WORDS)


_FB = "SELECT rater AS \"user\", doc_id, lower(trim(label, ' ')) = 'none' AS relevant FROM content_labels WHERE rater IS NOT NULL AND label IS NOT NULL"
_TAGS = f"""SELECT "user", tag, sum(CASE WHEN relevant THEN 0.5 ELSE 0 END)::DOUBLE AS pos, sum(CASE WHEN relevant THEN 0 ELSE 0.5 END)::DOUBLE AS neg FROM (SELECT "user", relevant, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) > 3))) AS tag FROM ({_FB}) f JOIN documents d USING (doc_id)) GROUP BY 1, 2"""


def _profiles(spark, d):
    fb = load(spark, d, "content_labels").where("rater is not null and label is not null").select(F.col("rater").alias("user"), "doc_id", (F.lower(F.trim("label")) == "none").alias("relevant"))
    return R.profile(fb, load(spark, d, "documents"))


@query(f'SELECT "user", tag, pos, row_number() OVER (PARTITION BY "user" ORDER BY pos DESC, tag)::INTEGER AS place FROM ({_TAGS}) WHERE pos > 0 QUALIFY place <= 5')
def feedback_profile(spark, d):
    return R.top_tags(_profiles(spark, d), 5)


def _feedback(spark, d):
    return load(spark, d, "content_labels").where("rater is not null and label is not null").select(F.col("rater").alias("user"), "doc_id", (F.lower(F.trim("label")) == "none").alias("relevant"))


def _side(weight: float) -> str:
    return f"sum(CASE WHEN relevant THEN {weight} ELSE 0 END)::DOUBLE AS pos, sum(CASE WHEN relevant THEN 0 ELSE {weight} END)::DOUBLE AS neg"


@query(f'SELECT "user", category, {_side(1.0)} FROM (SELECT f.*, d.doc_type AS category FROM ({_FB}) f JOIN documents d USING (doc_id)) WHERE category <> \'\' GROUP BY 1, 2')
def feedback_categories(spark, d):
    return R.category_profile(_feedback(spark, d), load(spark, d, "documents").select("doc_id", F.col("doc_type").alias("category")))


_SEEN = """SELECT d.doc_id, lower(unnest(from_json(coalesce(json_extract(CASE WHEN json_valid(i.visual_metadata) THEN i.visual_metadata::JSON END, '$.objects'), '[]'), '["VARCHAR"]'))) AS tag FROM documents d JOIN images i ON i.id = d.doc_id"""


@query(f'SELECT "user", tag, {_side(1.0)} FROM ({_FB}) f JOIN ({_SEEN}) s USING (doc_id) GROUP BY 1, 2')
def feedback_objects(spark, d):
    """Objects of the image of the same number as the judged document."""
    objects = F.from_json("visual_metadata", "struct<objects:array<string>>")["objects"]
    seen = load(spark, d, "images").select(F.col("id").alias("doc_id"), objects.alias("objects")).join(load(spark, d, "documents").select("doc_id"), "doc_id")
    return R.object_profile(_feedback(spark, d), seen)


@query(f'SELECT "user", CASE WHEN sum(pos) > 5 THEN 0.30 ELSE 0.40 END::DOUBLE AS alpha, CASE WHEN sum(pos) > 5 THEN 0.55 ELSE 0.40 END::DOUBLE AS beta, CASE WHEN sum(pos) > 5 THEN 0.15 ELSE 0.20 END::DOUBLE AS gamma FROM ({_TAGS}) GROUP BY 1')
def feedback_weights(spark, d):
    return R.fusion_weights(_profiles(spark, d))


@query(f"""WITH t AS (SELECT tag, sum(pos) AS pos, sum(neg) AS neg FROM ({_TAGS}) GROUP BY 1), w AS (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(lower(text), '\\s+'))) AS tag FROM documents), s AS (SELECT doc_id, sum(pos) AS pos, sum(neg) AS neg FROM w JOIN t USING (tag) GROUP BY 1)
SELECT d.doc_id, round(greatest(0.01, 0.5 + least(0.40, 0.08 * coalesce(pos, 0)) - least(0.60, 0.15 * coalesce(neg, 0))), 4) AS score FROM documents d LEFT JOIN s USING (doc_id)""")
def personalized_rank(spark, d):
    docs = load(spark, d, "documents")
    tags = _profiles(spark, d).groupBy("tag").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return R.personalised(docs.select("doc_id", F.lit(0.5).alias("score")), docs, tags)


_RANKED = """WITH q AS (SELECT unnest(['receipt', 'invoice', 'medical', 'challan']) AS q), r AS (SELECT q, id, (contains(lower(coalesce(extracted_text, '')), q)::INT * 2 + contains(lower(coalesce(image_name, '')), q)::INT) AS s, coalesce(lower(trim(category, ' ')) = q, false) AS relevant FROM images, q),
 n AS (SELECT q, id, relevant, row_number() OVER (PARTITION BY q ORDER BY s DESC, id) AS place, sum(relevant::INT) OVER (PARTITION BY q) AS nr FROM r WHERE s > 0 OR relevant), h AS (SELECT *, sum(relevant::INT) OVER (PARTITION BY q ORDER BY place) AS h FROM n)"""


@query(_RANKED + """ SELECT q, round(sum(CASE WHEN relevant AND place <= 10 THEN h / place ELSE 0 END) / greatest(1, least(10, max(nr))), 4) AS ap, round(sum((relevant AND place <= 5)::INT) / 5.0, 4) AS p5, round(sum((relevant AND place <= 10)::INT) / 10.0, 4) AS p10, round(coalesce(1.0 / min(CASE WHEN relevant THEN place END), 0), 4) AS mrr FROM h GROUP BY 1""")
def retrieval_measures(spark, d):
    qs = F.explode(F.array(*map(F.lit, ("receipt", "invoice", "medical", "challan")))).alias("q")
    r = load(spark, d, "images").select("id", "extracted_text", "image_name", "category", qs)
    s = F.lower(F.coalesce("extracted_text", F.lit(""))).contains(F.col("q")).cast("int") * 2 + F.lower(F.coalesce("image_name", F.lit(""))).contains(F.col("q")).cast("int")
    rel = F.coalesce(F.lower(F.trim("category")) == F.col("q"), F.lit(False))
    rows = r.select("q", "id", s.alias("s"), rel.alias("relevant")).where("s > 0 or relevant")
    return R.precision_measures(rows, "q")


@query("""WITH n AS (SELECT id, row_number() OVER (PARTITION BY category ORDER BY md5(id::VARCHAR)) - 1 AS r, count(*) OVER (PARTITION BY category) AS n FROM images) SELECT id, CASE WHEN r / n < 0.70 THEN 'dev' WHEN r / n < 0.85 THEN 'val' ELSE 'test' END AS part FROM n""")
def stratified_split(spark, d):
    return R.stratified_split(load(spark, d, "images"), "category")


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def stream_windows(spark, d):
    return ingest.drain(ingest.windowed_counts(ingest.stream(spark, f"{d}/events.parque[t]", load(spark, d, "events").schema).withColumn("ts", F.col("ts").cast("timestamp")))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"""SELECT upload_id, CASE WHEN regexp_matches(lower(image_name), '{'|'.join(ingest.URGENT)}') THEN 0 ELSE 1 END AS priority FROM incoming_uploads WHERE image_name IS NOT NULL""")
def job_priority(spark, d):
    return load(spark, d, "incoming_uploads").where("image_name is not null").select("upload_id", ingest.priority(F.col("image_name")).alias("priority"))


@query("""SELECT id, row_number() OVER (PARTITION BY id ORDER BY p)::INTEGER - 1 AS place, rule, c::DOUBLE AS certainty FROM (SELECT id, 1 AS p, 'overdue' AS rule, 0.9 AS c FROM images WHERE contains(lower(extracted_text), 'late fee') UNION ALL SELECT id, 2, 'receipt', 0.8 FROM images WHERE contains(lower(extracted_text), 'received with thanks') UNION ALL SELECT id, 3, 'identity', 0.95 FROM images WHERE regexp_matches(extracted_text, '\\b[A-Z]{5}[0-9]{4}[A-Z]\\b'))""")
def production_rules(spark, d):
    t = F.col("extracted_text")
    rules = [("overdue", 1, F.lower(t).contains("late fee"), 0.9), ("receipt", 2, F.lower(t).contains("received with thanks"), 0.8), ("identity", 3, t.rlike(r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"), 0.95)]
    return R.fire_rules(load(spark, d, "images"), rules)


@query("""SELECT id, CASE WHEN contains(lower(qr_payload), 'upi://') THEN 'Payment code of ' || nullif(regexp_extract(qr_payload, '[?&]pa=([^&]*)', 1), '') WHEN contains(lower(extracted_text), 'receipt') THEN 'Text mentions receipt' WHEN contains(lower(image_name), 'receipt') THEN 'File name mentions receipt' ELSE 'Similar content' END AS reason FROM images WHERE NOT coalesce(is_quarantined, false)""")
def match_reasons(spark, d):
    """Why a row was found, by precedence: payload, text, name, otherwise vector."""
    images = load(spark, d, "images")
    reason = F.when(F.lower("qr_payload").contains("upi://"), F.concat(F.lit("Payment code of "), S.payload_fields(F.col("qr_payload"))["handle"])).when(F.lower("extracted_text").contains("receipt"), "Text mentions receipt").when(F.lower("image_name").contains("receipt"), "File name mentions receipt").otherwise("Similar content")
    return lexical.visible(images).select("id", reason.alias("reason"))
