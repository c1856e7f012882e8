"""Queries that show single documents: words in reading order, snippets, phrases, invoices, translations, grounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import entities as E, indic, text as T
from paperloom.operators import documents as D, ranking as R
from paperloom.plans.entity_queries import STRONG_SQL
from paperloom.plans.registry import query
from paperloom.sources.tables import load

_B = """SELECT id, json_extract_string(b, '$.text') AS token, TRY_CAST(json_extract_string(b, '$.bbox.x') AS DOUBLE) AS x, TRY_CAST(json_extract_string(b, '$.bbox.y') AS DOUBLE) AS y, TRY_CAST(json_extract_string(b, '$.bbox.width') AS DOUBLE) AS w, TRY_CAST(json_extract_string(b, '$.bbox.height') AS DOUBLE) AS h
 FROM (SELECT id, unnest(CAST(CASE WHEN json_valid(ocr_boxes_json) AND ocr_boxes_json LIKE '[%' THEN ocr_boxes_json ELSE '[]' END AS JSON[])) AS b FROM images)"""


def images(spark, d):
    return load(spark, d, "images")


@query(f"SELECT id, token, row_number() OVER (PARTITION BY id ORDER BY floor(y / 40), x, token) AS place FROM ({_B})")
def reading_order(spark, d):
    return D.reading_order(D.exploded_boxes(images(spark, d))).select("id", "token", "place")


_R = "SELECT id AS region_id, image_id, " + ", ".join(f"TRY_CAST(json_extract_string(CASE WHEN json_valid(bbox_json) THEN bbox_json END, '$.{k}') AS DOUBLE) AS r{a}" for k, a in (("x", "x"), ("y", "y"), ("width", "w"), ("height", "h"))) + " FROM visual_regions"


@query(f"""SELECT region_id, count(*) AS n_tokens, least(0.25, count(*) * 0.15)::DOUBLE AS bonus FROM ({_R}) r JOIN ({_B}) b ON r.image_id = b.id WHERE x + w / 2 BETWEEN rx - rw * 0.1 AND rx + rw * 1.1 AND y + h / 2 BETWEEN ry - rh * 0.1 AND ry + rh * 1.1 GROUP BY 1""")
def tokens_in_regions(spark, d):
    n = lambda k: F.get_json_object("bbox_json", f"$.{k}").cast("double")
    regions = load(spark, d, "visual_regions").select("id", "image_id", n("x").alias("x"), n("y").alias("y"), n("width").alias("w"), n("height").alias("h"))
    return D.tokens_in_regions(regions, D.exploded_boxes(images(spark, d)))


@query(f"SELECT b.id, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1 FROM ({_B}) b JOIN images i ON i.id = b.id WHERE length(token) > 0 AND contains(lower(i.image_name), lower(token)) GROUP BY 1")
def grounded_answers(spark, d):
    return D.grounded(D.exploded_boxes(images(spark, d)), images(spark, d).select("id", F.col("image_name").alias("answer")))


@query("""SELECT id, regexp_replace(substr(extracted_text, greatest(1, p - 60), p - greatest(1, p - 60) + 14 + 120), '(?i)(receipt number)', '<mark>\\1</mark>', 'g') AS snippet FROM (SELECT id, extracted_text, instr(lower(extracted_text), 'receipt number') AS p FROM images) WHERE p > 0""")
def marked_snippets(spark, d):
    return images(spark, d).select("id", D.marked(F.col("extracted_text"), "receipt number").alias("snippet")).where("snippet is not null")


_S = "list_filter(list_transform(regexp_split_to_array(regexp_replace(extracted_text, '([.!?])\\s+', '\\1\n', 'g'), '\\n+'), lambda s: trim(s, ' ')), lambda s: length(s) >= 15)"


@query(f"""SELECT id, left(coalesce(list_filter(s, lambda x: contains(lower(x), 'amount') AND contains(lower(x), 'payable'))[1], list_filter(s, lambda x: contains(lower(x), 'amount') OR contains(lower(x), 'payable'))[1]), 200) AS sentence FROM (SELECT id, {_S} AS s FROM images) WHERE len(list_filter(s, lambda x: contains(lower(x), 'amount') OR contains(lower(x), 'payable'))) > 0""")
def best_sentences(spark, d):
    return images(spark, d).select("id", D.best_sentence(F.col("extracted_text"), ("amount", "payable")).alias("sentence")).where("sentence is not null")


_STOP = "(" + ", ".join(f"'{w}'" for w in T.STOPWORDS + T.MORE_STOPWORDS) + ")"


@query(f"""WITH w AS (SELECT id, list_transform(regexp_extract_all(expected_title, '[A-Za-z][A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM (SELECT DISTINCT image_id AS id, expected_title FROM metadata)),
 p AS (SELECT id, w[i:i + n - 1] AS p FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (VALUES (1), (2), (3)) t(n)))
SELECT DISTINCT id, array_to_string(p, ' ') AS phrase FROM p WHERE len(p) > 0 AND p[1] NOT IN {_STOP} AND p[len(p)] NOT IN {_STOP}""")
def candidate_phrases(spark, d):
    m = load(spark, d, "metadata").select(F.col("image_id").alias("id"), "expected_title").distinct()
    return m.select("id", F.explode(D.candidate_phrases(F.col("expected_title"))).alias("phrase")).distinct()


_TERMS = "[" + ", ".join(f"{{'k': '{k}', 'v': '{v}'}}" for k, v in indic.TERMS.items()) + "]"


@query(f"SELECT DISTINCT id, t.v AS term FROM (SELECT id, extracted_text, unnest({_TERMS}) AS t FROM images) WHERE contains(extracted_text, t.k)")
def indic_terms(spark, d):
    return images(spark, d).select("id", F.explode(indic.english_terms(F.col("extracted_text"))).alias("term"))


@query(f"""WITH s AS (SELECT DISTINCT i.user_id, s.id, upper(s.value) AS value FROM ({STRONG_SQL}) s JOIN images i ON i.id = s.id WHERE NOT coalesce(i.is_quarantined, false)), o AS (SELECT user_id, value FROM s WHERE id = 26)
SELECT DISTINCT s.id, s.value FROM s JOIN o USING (user_id, value) WHERE s.id <> 26""")
def links_of_image(spark, d):
    return D.links_of(26, images(spark, d))


@query()
def graph_codes(spark, d):
    code = R.graph_code(F.transform(E.strong_identifiers(F.col("extracted_text")), lambda s: s["value"]))
    return images(spark, d).select("id", F.to_json(code).alias("code"))
