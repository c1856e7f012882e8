"""Queries of instruction, temporal and geographic search, answers, invoices, payloads and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import payloads as Y, scores as S
from paperloom.operators import documents as D, instructions as I, lexical, postings as P, predicates as Q, ranking as R
from paperloom.plans.registry import query
from paperloom.plans.search_queries import keyword_sql, qa_sql
from paperloom.sources.tables import load

_T, _N = "lower(coalesce(extracted_text, ''))", "lower(coalesce(image_name, ''))"
_VISIBLE = "NOT coalesce(is_quarantined, false)"


def _holds(w: str) -> str:
    return f"(contains({_T}, '{w}') OR contains({_N}, '{w}'))"


def images(spark, d):
    return load(spark, d, "images")


INSTRUCTION = "Find unpaid electricity bills between 500 and 90000 from 2024 without meters"
_METERS = f"(regexp_matches({_T}, '\\bmeters\\b') OR regexp_matches({_N}, '\\bmeters\\b'))"
_BILLS = " OR ".join(_holds(w) for w in I.CATEGORIES["Bills & Invoices"])


@query(f"""SELECT id, round(0.40 + 0.30 + 0.30 * ({_holds('unpaid')}::INT + {_holds('electricity')}::INT + {_holds('bills')}::INT) / 3.0, 3)::DOUBLE AS score, 'year:2024,category:Bills & Invoices' AS satisfied, 1.0::DOUBLE AS share FROM images
WHERE {_VISIBLE} AND NOT {_METERS} AND (coalesce(contains(lower(category), 'bills & invoices'), false) OR {_BILLS}) AND {_holds('2024')}
 AND len(list_filter(list_transform(regexp_extract_all(coalesce(extracted_text, ''), '[₹$Rs.]*\\s*([\\d,]+\\.?\\d*)', 1), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)), lambda v: v > 10 AND v BETWEEN 500 AND 90000)) > 0
 AND (contains({_T}, 'unpaid') OR contains({_T}, 'due') OR contains({_T}, 'pending'))""")
def instruction_search(spark, d):
    return I.search(images(spark, d), I.parse(INSTRUCTION)).withColumn("satisfied", F.array_join("satisfied", ","))


@query(f"SELECT id, 'meters' AS term FROM images WHERE {_VISIBLE} AND {_METERS}")
def instruction_suppressed(spark, d):
    return I.suppressed(images(spark, d), I.parse(INSTRUCTION))


_MARKS = "\\b(?:logo|stamp|watermark|watermarked)\\b"


def _labelled(words: str) -> str:
    both = " || ".join(f"coalesce(json_extract(CASE WHEN json_valid(visual_metadata) THEN visual_metadata::JSON END, '$.{k}')::VARCHAR, '')" for k in ("objects", "labels"))
    return f"regexp_matches(lower({both}), '\"(?:{words})\"')"


@query(f"""WITH h AS (SELECT id, ({_holds('meter')} OR {_labelled('meter')})::INT + ({_holds('board')} OR {_labelled('board')})::INT AS n FROM images WHERE {_VISIBLE} AND NOT ({_labelled('logo|stamp|watermark|watermarked')} OR regexp_matches({_T}, '{_MARKS}') OR regexp_matches({_N}, '{_MARKS}')))
SELECT id, round(0.40 * n / 2.0 + 0.30 + 0.30 * n / 2.0, 3)::DOUBLE AS score FROM h""")
def constraint_search(spark, d):
    return I.search(images(spark, d), I.parse("show me a meter on a board, without watermark")).select("id", "score")


_OWN = "CASE WHEN regexp_matches(primary_date, '^(19|20)[0-9]{2}') THEN substr(primary_date, 1, 10) WHEN regexp_matches(file_modified_at, '^(19|20)[0-9]{2}') THEN substr(file_modified_at, 1, 10) ELSE '' END"
_EXIF = "CASE WHEN regexp_matches(exif_created_at, '^(19|20)[0-9]{2}') THEN substr(exif_created_at, 1, 10) ELSE '' END"
_FIT = """CASE WHEN (starts_with(own, '2024') OR starts_with(exif, '2024')) AND (starts_with(own, '2024-03') OR starts_with(exif, '2024-03')) THEN 1.0 WHEN own <> '' THEN 0.0 WHEN starts_with(own, '2024') OR starts_with(exif, '2024') THEN 0.3 ELSE 0.4 END::DOUBLE"""
_FITTED = f"SELECT id, own, exif, kw, {_FIT} AS fit FROM (SELECT id, {_OWN} AS own, {_EXIF} AS exif, (contains({_T}, 'receipt')::INT + contains({_N}, 'receipt')::INT) / 2.0::DOUBLE AS kw FROM images WHERE {_VISIBLE})"


def _fitted(spark, d):
    when = I.parse_temporal("receipt of march 2024")
    date = lambda c: F.when(F.col(c).rlike("^(19|20)[0-9]{2}"), F.substring(c, 1, 10))
    own = F.coalesce(date("primary_date"), date("file_modified_at"), F.lit(""))
    hits = (F.lower(F.coalesce("extracted_text", F.lit(""))).contains("receipt").cast("int") + F.lower(F.coalesce("image_name", F.lit(""))).contains("receipt").cast("int")) / 2.0
    known = F.col("file_modified_at").isNotNull() | F.col("created_at").isNotNull()
    return lexical.visible(images(spark, d)).select("id", hits.alias("kw"), I.temporal_fit(when, own, F.array(F.coalesce(date("exif_created_at"), F.lit(""))), known).alias("fit"))


@query(f"SELECT id, fit AS score FROM ({_FITTED})")
def temporal_score(spark, d):
    return _fitted(spark, d).select("id", F.col("fit").alias("score"))


@query(f"SELECT id, round(least(1.0, kw * 0.75 + fit * 0.25 + CASE WHEN fit = 1 THEN 0.05 ELSE 0 END), 3)::DOUBLE AS score FROM ({_FITTED}) WHERE kw >= 0.5 AND fit > 0")
def temporal_search(spark, d):
    return _fitted(spark, d).where("kw >= 0.5 and fit > 0").select("id", I.fuse_temporal(F.col("kw"), F.col("fit")).alias("score"))


_HUBS = ", ".join(f"({i}, '{n}', {a}, {b})" for i, (n, a, b) in enumerate(S.HUBS))
_KM = "round(2 * 6371.0 * asin(sqrt(pow(sin((radians(lat) - radians(18.5204)) / 2), 2) + cos(radians(18.5204)) * cos(radians(lat)) * pow(sin(radians(lon - 73.8567) / 2), 2))), 2)"


@query(f"""WITH h(k, city, lat, lon) AS (VALUES {_HUBS}), i AS (SELECT id, lower(coalesce(extracted_text, '') || ' issued at ' || (SELECT city FROM h WHERE k = id % 14)) AS t FROM images WHERE {_VISIBLE}),
 c AS (SELECT id, min(k) AS k FROM i JOIN h ON contains(t, city) GROUP BY 1)
SELECT id, city, {_KM} AS km FROM c JOIN h USING (k) WHERE {_KM} <= 200""")
def geo_search(spark, d):
    """Rows within 200 km of Pune; the texts get a place of issue, as those of the tables name none of the hubs."""
    place = F.try_element_at(F.array(*[F.lit(n) for n, _, _ in S.HUBS]), (F.col("id") % 14 + 1).cast("int"))
    rows = lexical.visible(images(spark, d)).withColumn("extracted_text", F.concat(F.coalesce("extracted_text", F.lit("")), F.lit(" issued at "), place))
    return R.within_radius(rows, 18.5204, 73.8567, 200.0)


@query("""WITH h AS (SELECT id, image_name, coalesce(contains(extracted_text, '2024') OR contains(image_name, '2024'), false) AS held, indexing_status, length(image_name) / 60.0 AS s FROM images)
SELECT id FROM h WHERE coalesce(indexing_status = 'completed', false) AND (held OR coalesce(s >= 0.52, false))""")
def numeric_guard(spark, d):
    return images(spark, d).where(F.coalesce(Q.number_guard("2024", F.length("image_name") / 60.0), F.lit(False))).select("id")


@query(f"WITH b AS ({qa_sql(('total', 'payable', 'tax'), 1, _VISIBLE)}) SELECT *, least(0.98, round(score * 0.85 + 0.15, 2)) AS confidence FROM b ORDER BY score DESC, id LIMIT 20")
def question_answers(spark, d):
    return lexical.answers(images(spark, d), ("total", "payable", "tax"), 20)


_LINES = "(SELECT id, unnest(list_filter(list_transform(regexp_split_to_array(extracted_text, '\\n'), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(12))), lambda x: length(x) > 0 AND NOT regexp_matches(x, '" + Y.NO_ITEM + "') AND regexp_full_match(x, '.+?\\s+[0-9,]+\\.?[0-9]{0,2}'))) AS x FROM images)"


@query(f"""WITH i AS (SELECT id, trim(regexp_extract(x, '^(.+?)\\s+([0-9,]+\\.?[0-9]{{0,2}})$', 1), ' ') AS item, TRY_CAST(replace(regexp_extract(x, '^(.+?)\\s+([0-9,]+\\.?[0-9]{{0,2}})$', 2), ',', '') AS DOUBLE) AS price FROM {_LINES})
SELECT id, count(*) AS n_items, round(sum(price), 2) AS total FROM i WHERE length(item) >= 3 AND price > 0 GROUP BY 1""")
def invoice_items(spark, d):
    items = images(spark, d).select("id", F.explode(Y.line_items(F.col("extracted_text"))).alias("i"))
    return items.groupBy("id").agg(F.count("*").alias("n_items"), F.round(F.sum("i.price"), 2).alias("total"))


def _number(p: str) -> str:
    return f"TRY_CAST(replace(regexp_extract(t, '{p}', 1), ',', '') AS DOUBLE)"


_MODE = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in D.PAYMENT_MODES)
_TAX = {t: f"coalesce({_number(f'(?i){t}{D.MONEY}')}, 0.0)" for t in ("cgst", "sgst", "igst")}


@query(f"""WITH x AS (SELECT p_partkey AS id, p_name || ' by UPI' || chr(10) || 'CGST: Rs. ' || p_size || ' SGST ' || (p_size + 1) || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN 'Grand Total: Rs. ' ELSE 'total ' END || '1,' || (100 + p_size) || '.50' AS t FROM part)
SELECT id, 'UPI / QR' AS mode, 1000.5 + 100 + (id_size) AS total, id_size::DOUBLE AS cgst, (id_size + 1)::DOUBLE AS sgst, 0.0::DOUBLE AS igst, (2 * id_size + 1)::DOUBLE AS total_tax FROM x JOIN (SELECT p_partkey AS id, p_size AS id_size FROM part) USING (id)""")
def invoice_taxes(spark, d):
    p = load(spark, d, "part")
    total = F.when(F.col("p_partkey") % 2 == 0, "Grand Total: Rs. ").otherwise("total ")
    t = F.concat("p_name", F.lit(" by UPI\nCGST: Rs. "), F.col("p_size").cast("string"), F.lit(" SGST "), (F.col("p_size") + 1).cast("string"), F.lit("\n"), total, F.lit("1,"), (F.col("p_size") + 100).cast("string"), F.lit(".50"))
    return p.select(F.col("p_partkey").alias("id"), D.invoice(t).alias("v")).select("id", "v.*")


@query(f"""SELECT id, CASE {_MODE} ELSE 'UNKNOWN' END AS mode, coalesce(CASE WHEN regexp_matches(t, '{D.GRAND_TOTAL}') THEN {_number(D.GRAND_TOTAL)} ELSE {_number(D.TOTAL)} END, 0.0)::DOUBLE AS total, {', '.join(f'{v}::DOUBLE AS {t}' for t, v in _TAX.items())}, round({' + '.join(_TAX.values())}, 2)::DOUBLE AS total_tax FROM (SELECT id, extracted_text AS t FROM images WHERE extracted_text IS NOT NULL)""")
def invoice_facts(spark, d):
    return images(spark, d).where("extracted_text is not null").select("id", D.invoice(F.col("extracted_text")).alias("v")).select("id", "v.*")


@query("""WITH p AS (SELECT p_partkey AS id, p_name, 'upi' || p_partkey AS vpa FROM part)
SELECT id, unnest(['00', '26', '26.00', '26.01', '59']) AS tag, unnest(['01', '0002IN01' || lpad(length(vpa)::VARCHAR, 2, '0') || vpa, 'IN', vpa, p_name]) AS value FROM p""")
def payload_tags(spark, d):
    field = lambda tag, v: F.concat(F.lit(tag), F.lpad(F.length(v).cast("string"), 2, "0"), v)
    vpa = F.concat(F.lit("upi"), F.col("p_partkey").cast("string"))
    inner = F.concat(field("00", F.lit("IN")), field("01", vpa))
    payload = F.concat(field("00", F.lit("01")), field("26", inner), field("59", F.col("p_name")), F.lit("6099cut"))
    tags = Y.opened(Y.tag_length_values(F.col("payload")))
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), payload.alias("payload")).select("id", F.inline(tags))


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS org, '9' || lpad(c_custkey::VARCHAR, 9, '0') AS phone FROM customer")
def payload_contacts(spark, d):
    phone = F.concat(F.lit("9"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    short = F.concat(F.lit("MECARD:N:"), "c_name", F.lit(";ORG:"), "c_mktsegment", F.lit(";TEL:"), phone, F.lit(";;"))
    long = F.concat(F.lit("BEGIN:VCARD\nFN:"), "c_name", F.lit("\nORG:"), "c_mktsegment", F.lit("\nTEL;TYPE=WORK:"), phone, F.lit("\nEND:VCARD"))
    rows = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, short).otherwise(long).alias("p"))
    return rows.select("id", Y.contact_fields(F.col("p")).alias("v")).select("id", "v.*")


@query("SELECT s_suppkey AS id, s_name AS title, 'Offers of ' || s_name AS description, 'Welcome to ' || s_name AS h1 FROM supplier")
def page_fields(spark, d):
    page = F.concat(F.lit("<html><head><title>\n "), "s_name", F.lit("</title><meta name=\"description\" content=\"Offers of "), "s_name", F.lit("\"></head><body><h1 class='x'>Welcome <b>to</b>\n"), "s_name", F.lit("</h1></body></html>"))
    return load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), S.page_metadata(page).alias("v")).select("id", "v.title", "v.description", "v.h1")


@query("SELECT id, unnest(list_filter(regexp_split_to_array(regexp_extract(qr_payload, '(?i)^https?://[^/?#]+/([^?#]*)', 1), '[/_.+-]+'), lambda w: length(w) > 1)) AS word FROM images")
def payload_words(spark, d):
    return images(spark, d).select("id", F.explode(Y.url_words(F.col("qr_payload"))).alias("word"))


@query("SELECT p_partkey AS id, unnest(list_filter(range(0, length(p_name)), lambda i: substr(lower(p_name), i + 1, 2) = 'te' OR substr(lower(p_name), i + 1, 2) = 'es'))::INTEGER AS at FROM part")
def word_offsets(spark, d):
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(F.sort_array(F.concat(Y.all_offsets(F.col("p_name"), "te"), Y.all_offsets(F.col("p_name"), "ES")))).alias("at"))


@query("SELECT doc_id, length(text) > 0 AND NOT contains(left(text, 512), chr(0)) AS is_text FROM documents WHERE text IS NOT NULL")
def text_bytes(spark, d):
    return load(spark, d, "documents").where("text is not null").select("doc_id", Y.is_text(F.col("text").cast("binary")).alias("is_text"))


@query()
def best_phrases(spark, d):
    """The phrases of a title that say most, those within a longer one left out."""
    rows = load(spark, d, "metadata").select(F.col("image_id").alias("id"), D.candidate_phrases(F.col("expected_title")).alias("p")).distinct()
    scored = F.transform("p", lambda p: F.struct(F.size(F.split(p, " ")).alias("score"), p.alias("phrase")))
    return rows.select("id", F.posexplode(Y.subsumed(scored)).alias("place", "phrase"))


@query("""SELECT r.id, coalesce(s.id = t.id OR coalesce(s.canonical_image_id, s.id) = coalesce(t.canonical_image_id, t.id) OR coalesce(s.canonical_image_id, s.id) = t.id OR coalesce(t.canonical_image_id, t.id) = s.id, false) AS same
FROM image_relationships r JOIN images s ON s.id = r.source_image_id JOIN images t ON t.id = r.target_image_id""")
def related_duplicates(spark, d):
    i = images(spark, d).select("id", "canonical_image_id")
    s, t = i.select(F.col("id").alias("source_image_id"), F.col("canonical_image_id").alias("sc")), i.select(F.col("id").alias("target_image_id"), F.col("canonical_image_id").alias("tc"))
    e = load(spark, d, "image_relationships").select("id", "source_image_id", "target_image_id").join(s, "source_image_id").join(t, "target_image_id")
    return e.select("id", Q.same_document(F.col("source_image_id"), F.col("sc"), F.col("target_image_id"), F.col("tc")).alias("same"))


@query("""WITH g AS (SELECT id FROM images WHERE is_quarantined) SELECT 'image' AS kind, id FROM images WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'region', id FROM visual_regions WHERE image_id IS NULL OR image_id NOT IN (SELECT id FROM g)
UNION ALL SELECT 'edge', id FROM image_relationships WHERE NOT coalesce(source_image_id IN (SELECT id FROM g), false) AND NOT coalesce(target_image_id IN (SELECT id FROM g), false)""")
def cascade_delete_all(spark, d):
    from paperloom.operators import records as C

    gone = images(spark, d).where("is_quarantined").select("id")
    own = images(spark, d).select("id").join(gone, "id", "left_anti").select(F.lit("image").alias("kind"), "id")
    regions = C.cascade_delete(load(spark, d, "visual_regions").select(F.col("id").alias("own"), "image_id"), gone, "image_id").select(F.lit("region").alias("kind"), F.col("own").alias("id"))
    edges = C.cascade_delete(load(spark, d, "image_relationships").select(F.col("id").alias("own"), "source_image_id", "target_image_id"), gone, "source_image_id", "target_image_id").select(F.lit("edge").alias("kind"), F.col("own").alias("id"))
    return own.unionByName(regions).unionByName(edges)


@query("SELECT id FROM images WHERE json_array_length(CASE WHEN json_valid(entities_json) THEN json_extract(entities_json, '$.amounts') END) > 0")
def entity_filter(spark, d):
    return images(spark, d).where(Q.has_entity("amount")).select("id")


@query("""WITH t AS (SELECT status, count(*) AS n FROM (SELECT CASE WHEN batch_id <= 8 THEN 'completed' WHEN batch_id = 9 THEN 'failed' WHEN batch_id = 10 THEN 'active' ELSE 'queued' END AS status, row_number() OVER (PARTITION BY upload_id ORDER BY batch_id DESC, received_at DESC) AS r FROM incoming_uploads WHERE upload_id IS NOT NULL) WHERE r = 1 GROUP BY 1)
SELECT * FROM t UNION ALL SELECT 'total', sum(n)::BIGINT FROM t""")
def queue_counts(spark, d):
    """State of a job log: the last entry of every job counts."""
    from paperloom.operators import records as C

    b = F.col("batch_id")
    log = load(spark, d, "incoming_uploads").where("upload_id is not null").select("upload_id", "batch_id", "received_at", F.when(b <= 8, "completed").when(b == 9, "failed").when(b == 10, "active").otherwise("queued").alias("status"))
    n = C.latest(log, "upload_id", [F.col("batch_id"), F.col("received_at")]).groupBy("status").agg(F.count("*").alias("n"))
    return n.unionByName(n.agg(F.sum("n").alias("n")).select(F.lit("total").alias("status"), "n"))


@query(f"""WITH c AS (SELECT id, CASE WHEN list_max(h) > 0 THEN [{', '.join(f"'{n}'" for n, _ in R.CLUSTERS)}][list_position(h, list_max(h))] ELSE 'General' END AS cluster, left(extracted_text, 120) AS text FROM (SELECT *, [{', '.join('(' + ' + '.join(f"contains(lower(extracted_text), '{w}')::INT" for w in ws) + ')' for _, ws in R.CLUSTERS)}] AS h FROM images WHERE extracted_text IS NOT NULL))
SELECT cluster, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, cluster)::INTEGER AS place FROM c GROUP BY 1""")
def cluster_order(spark, d):
    from pyspark.sql import Window

    c = F.col("extracted_text")
    n = images(spark, d).where(c.isNotNull()).groupBy(R.cluster_of(c).alias("cluster")).agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "cluster")))  # one row per cluster of a fixed list


_CLUSTERED = f"""SELECT id AS doc_id, CASE WHEN list_max(h) > 0 THEN [{', '.join(f"'{n}'" for n, _ in R.CLUSTERS)}][list_position(h, list_max(h))] ELSE 'General' END AS cluster, left(extracted_text, 120) AS text FROM (SELECT *, [{', '.join('(' + ' + '.join(f"contains(lower(extracted_text), '{w}')::INT" for w in ws) + ')' for _, ws in R.CLUSTERS)}] AS h FROM images WHERE extracted_text IS NOT NULL)"""


@query(keyword_sql(f"({_CLUSTERED})", "cluster"))
def cluster_keywords(spark, d):
    c = F.col("extracted_text")
    rows = images(spark, d).where(c.isNotNull()).select(F.col("id").alias("doc_id"), R.cluster_of(c).alias("cluster"), F.substring(c, 1, 120).alias("text"))
    return P.keyword_weights(rows, "cluster", 5)


@query(f"""WITH k AS ({keyword_sql(f"({_CLUSTERED})", "cluster")}), n AS (SELECT cluster, count(*) AS n FROM ({_CLUSTERED}) GROUP BY 1), w AS (SELECT cluster, count(*) AS k FROM k WHERE lower(term) IN ('find', 'bills', 'invoices', 'and', 'amount', 'payable', 'due', 'this', 'month') GROUP BY 1),
 s AS (SELECT cluster, n, (CASE WHEN lower(cluster) = 'general' THEN 0 WHEN contains('find bills & invoices with amount payable due this month', lower(cluster)) THEN 3.0 ELSE 0 END) + 1.5 * coalesce(k, 0) AS score, sum(n) OVER () AS total FROM n LEFT JOIN w USING (cluster))
SELECT cluster, round(least(0.95, greatest(0.5, 0.5 + 0.15 * score)), 2)::DOUBLE AS confidence, n, round((1.0 - n / total) * 100, 1)::DOUBLE AS reduction FROM s ORDER BY score DESC, n DESC, cluster DESC LIMIT 1""")
def cluster_match(spark, d):
    c = F.col("extracted_text")
    rows = images(spark, d).where(c.isNotNull()).select(F.col("id").alias("doc_id"), R.cluster_of(c).alias("cluster"), F.substring(c, 1, 120).alias("text"))
    return R.matching_cluster(rows.groupBy("cluster").agg(F.count("*").alias("n")), P.keyword_weights(rows, "cluster", 5), "Find bills & invoices with amount payable due this month")
