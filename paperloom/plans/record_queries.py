"""Queries over records: scans, filters, changes, joins, groups, timelines, graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import duplicates as DU, lexical, predicates as P, records as R
from paperloom.plans.entity_queries import STRONG_SQL
from paperloom.plans.registry import query
from paperloom.sources.tables import load

_DATES = """list_filter([CASE WHEN regexp_matches(primary_date, '^(19|20)[0-9]{2}(-[0-9]{2}){0,2}') THEN substr(primary_date, 1, 10) END, CASE WHEN regexp_matches(exif_created_at, '^(19|20)[0-9]{2}(-[0-9]{2}){0,2}') THEN substr(exif_created_at, 1, 10) END], lambda x: x IS NOT NULL)"""
_MTIME = """list_filter([CASE WHEN regexp_matches(file_modified_at, '^(19|20)[0-9]{2}(-[0-9]{2}){0,2}') THEN substr(file_modified_at, 1, 10) END], lambda x: x IS NOT NULL)"""
_CAND = f"(SELECT *, CASE WHEN len({_DATES}) > 0 THEN {_DATES} ELSE {_MTIME} END AS dates FROM images)"


def images(spark, d):
    return load(spark, d, "images")


@query("SELECT id, user_id, image_name, row_number() OVER (ORDER BY created_at DESC, id) AS place FROM images WHERE NOT coalesce(is_quarantined, false)")
def list_images(spark, d):
    from pyspark.sql import Window

    rows = lexical.visible(images(spark, d)).select("id", "user_id", "image_name", "created_at")
    # numbering without one global window: rows are range-sorted, each partition is numbered and shifted by what comes before it
    ordered = rows.orderBy(F.desc("created_at"), "id").withColumn("part", F.spark_partition_id()).withColumn("n", F.monotonically_increasing_id())
    own = ordered.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("n")))
    sizes = own.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.size"), F.lit(0)).alias("shift"))
    return own.join(F.broadcast(before), "part").select("id", "user_id", "image_name", (F.col("r") + F.col("shift")).alias("place"))  # one row per partition


@query("SELECT id, image_name, category FROM images WHERE id = 17 AND NOT coalesce(is_quarantined, false)")
def get_image(spark, d):
    return lexical.visible(images(spark, d)).where("id = 17").select("id", "image_name", "category")


@query("SELECT id FROM images WHERE has_visual_objects")
def search_by_visual(spark, d):
    return images(spark, d).where("has_visual_objects").select("id")


@query("SELECT r.id AS region_id, i.id AS image_id, i.image_name, r.region_source FROM visual_regions r JOIN images i ON r.image_id = i.id WHERE NOT coalesce(i.is_quarantined, false)")
def regions_of_images(spark, d):
    r = load(spark, d, "visual_regions").select(F.col("id").alias("region_id"), "image_id", "region_source")
    return r.join(lexical.visible(images(spark, d)).select(F.col("id").alias("image_id"), "image_name"), "image_id")


@query("SELECT e.id AS edge_id, i.image_name, e.confidence_score FROM image_relationships e JOIN images i ON e.target_image_id = i.id WHERE e.source_image_id % 10 = 6")
def related_images(spark, d):
    e = load(spark, d, "image_relationships").where("source_image_id % 10 = 6").select(F.col("id").alias("edge_id"), F.col("target_image_id").alias("id"), "confidence_score")
    return e.join(images(spark, d).select("id", "image_name"), "id").drop("id")


@query("SELECT id, coalesce(TRY_CAST(json_extract_string(CASE WHEN json_valid(entities_json) THEN entities_json END, '$.total_entities') AS INTEGER), 0) AS total FROM images")
def json_column(spark, d):
    return images(spark, d).select("id", F.coalesce(F.get_json_object("entities_json", "$.total_entities").cast("int"), F.lit(0)).alias("total"))


@query(f"SELECT id, coalesce(dates[1], '') AS primary_date FROM {_CAND}")
def resolved_dates(spark, d):
    return images(spark, d).select("id", F.coalesce(F.try_element_at(P.candidate_dates(), F.lit(1)), F.lit("")).alias("primary_date"))


@query(f"SELECT id FROM {_CAND} WHERE len(list_filter(dates, lambda x: substr(x, 1, least(length(x), 7)) >= substr('2023-06', 1, least(length(x), 7)) AND substr(x, 1, least(length(x), 10)) <= substr('2024-03-15', 1, least(length(x), 10)))) > 0")
def date_range(spark, d):
    return images(spark, d).where(P.in_date_range(P.candidate_dates(), "2023-06", "2024-03-15")).select("id")


@query(f"SELECT id FROM {_CAND} WHERE len(list_filter(dates, lambda x: starts_with(x, '2024'))) > 0")
def year_filter(spark, d):
    return images(spark, d).where(P.in_year(P.candidate_dates(), 2024)).select("id")


@query("SELECT id FROM images WHERE lower(trim(category, ' ')) IN ('bill') OR list_contains(string_split(lower(trim(category, ' ')), '_'), 'bill')")
def category_filter(spark, d):
    return images(spark, d).where(P.in_category(F.col("category"), "bill")).select("id")


@query("""SELECT id FROM images WHERE coalesce(replace(lower(trim(file_format, ' ')), 'jpg', 'jpeg') = 'jpeg', false) OR coalesce(replace(lower(regexp_extract(image_name, '\\.([^.]+)$', 1)), 'jpg', 'jpeg') = 'jpeg', false)""")
def format_filter(spark, d):
    return images(spark, d).where(P.in_format("jpg")).select("id")


@query("""SELECT i.id FROM images i LEFT JOIN (SELECT DISTINCT image_id FROM visual_regions WHERE regexp_matches(lower(region_source), 'stamp|seal') OR regexp_matches(lower(location_desc), 'stamp|seal')) r ON r.image_id = i.id
WHERE r.image_id IS NOT NULL OR coalesce(regexp_matches(lower(category), 'stamp|seal'), false) OR coalesce(regexp_matches(lower(image_name), 'stamp|seal'), false) OR coalesce(regexp_matches(lower(visual_metadata), 'stamp|seal'), false)""")
def visual_filter(spark, d):
    return P.visual_kind(images(spark, d), load(spark, d, "visual_regions"), "stamp").select("id")


_AMT = "(SELECT id, TRY_CAST(replace(unnest(regexp_extract_all(extracted_text, '(?i)(?:₹|Rs\\.?|INR)\\s*([0-9,]+(?:\\.[0-9]{1,2})?)\\s*(?:/-)?', 1)), ',', '') AS DOUBLE) AS v FROM images)"


@query(f"SELECT DISTINCT id FROM {_AMT} WHERE v BETWEEN 1000 AND 20000")
def amount_filter(spark, d):
    return images(spark, d).where(P.amount_between(F.col("extracted_text"), 1000.0, 20000.0)).select("id")


@query(f"""SELECT id FROM {_CAND} WHERE indexing_status = 'completed' AND NOT coalesce(is_quarantined, false) AND user_id = 17 AND len(list_filter(dates, lambda x: starts_with(x, '2024') OR starts_with(x, '2025'))) > 0
 AND lower(trim(category, ' ')) IN ('receipt', 'invoice', 'utility_bill') AND id IN (SELECT id FROM {_AMT} WHERE v BETWEEN 500 AND 1000000)""")
def eligible_rows(spark, d):
    rows = None
    for c in ("receipt", "invoice", "utility_bill"):
        part = P.eligible(images(spark, d), load(spark, d, "visual_regions"), P.Facets(user_id=17, category=c, min_amount=500.0))
        rows = part if rows is None else rows.unionByName(part)
    dates = P.candidate_dates()
    return rows.where(P.in_year(dates, 2024) | P.in_year(dates, 2025)).select("id").distinct()


@query("SELECT u.id AS user_id, u.is_admin, count(i.id) AS n_rows FROM users u LEFT JOIN images i ON u.is_admin OR i.user_id = u.id GROUP BY 1, 2")
def tenancy(spark, d):
    users, rows = load(spark, d, "users").select("id", "is_admin"), images(spark, d)
    own = rows.groupBy("user_id").agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    return users.join(own, users.id == own.user_id, "left").crossJoin(F.broadcast(total)).select(F.col("id").alias("user_id"), "is_admin", F.when(F.col("is_admin"), F.col("total")).otherwise(F.coalesce("n", F.lit(0))).alias("n_rows"))


@query("SELECT username, 'guest_' || left(sha256(username), 16) AS guest FROM users WHERE username IS NOT NULL")
def guest_names(spark, d):
    return load(spark, d, "users").where("username is not null").select("username", P.guest_name(F.col("username")).alias("guest"))


@query("""SELECT coalesce(indexing_status, 'unknown') AS status, count(*) AS n FROM images GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM images UNION ALL SELECT s, 0 FROM (VALUES ('queued'), ('indexing'), ('completed'), ('failed')) t(s) WHERE s NOT IN (SELECT indexing_status FROM images WHERE indexing_status IS NOT NULL)""")
def status_counts(spark, d):
    states = spark.createDataFrame([(s,) for s in ("queued", "indexing", "completed", "failed")], "status string")
    n = images(spark, d).select(F.coalesce("indexing_status", F.lit("unknown")).alias("status")).groupBy("status").agg(F.count("*").alias("n"))
    full = n.join(states, "status", "full_outer").select("status", F.coalesce("n", F.lit(0)).alias("n"))
    return full.unionByName(n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("total").alias("status"), "n"))


@query("SELECT category, count(*) AS n FROM images GROUP BY 1")
def category_counts(spark, d):
    return images(spark, d).groupBy("category").agg(F.count("*").alias("n"))


@query("""SELECT coalesce(i.id, n.upload_id) AS id, CASE WHEN n.upload_id IS NOT NULL THEN n.image_name ELSE i.image_name END AS image_name, CASE WHEN n.upload_id IS NULL THEN i.phash ELSE coalesce(nullif(trim(n.phash, ' '), ''), i.phash) END AS phash FROM (SELECT id, id AS key, image_name, phash FROM images) i
 FULL JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY received_at DESC, batch_id DESC) AS r FROM incoming_uploads) WHERE r = 1) n ON n.upload_id = i.key""")
def upsert_rows(spark, d):
    up = load(spark, d, "incoming_uploads").select("upload_id", "image_name", "phash", "received_at", "batch_id")
    new = R.latest(up, "upload_id", [F.col("received_at"), F.col("batch_id")]).select(F.col("upload_id").alias("id"), F.col("upload_id").alias("key"), "image_name", "phash")
    old = images(spark, d).select("id", F.col("id").alias("key"), "image_name", "phash")
    return R.upsert(old, new, "key", ("phash",)).drop("key")


@query("""SELECT i.id, coalesce(nullif(trim(m.category, ' '), ''), i.category) AS category FROM images i LEFT JOIN (SELECT TRY_CAST(image_id AS BIGINT) AS id, max(category) AS category FROM metadata GROUP BY 1) m ON m.id = i.id""")
def patch_rows(spark, d):
    m = load(spark, d, "metadata").groupBy(F.expr("try_cast(image_id as bigint)").alias("id")).agg(F.max("category").alias("category"))
    return R.patch(images(spark, d).select("id", "category"), m, ("category",))


@query("SELECT upload_id, batch_id, image_name FROM (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY received_at DESC, batch_id DESC) AS r FROM incoming_uploads) WHERE r = 1")
def latest_uploads(spark, d):
    up = load(spark, d, "incoming_uploads").select("upload_id", "batch_id", "image_name", "received_at")
    return R.latest(up, "upload_id", [F.col("received_at"), F.col("batch_id")]).select("upload_id", "batch_id", "image_name")


@query("""WITH n AS (SELECT id, image_id, 'fresh' AS region_source FROM visual_regions WHERE region_source = 'full_doc') SELECT id, image_id, region_source FROM visual_regions WHERE image_id IS NULL OR image_id NOT IN (SELECT image_id FROM n WHERE image_id IS NOT NULL) UNION ALL SELECT * FROM n""")
def replace_regions(spark, d):
    old = load(spark, d, "visual_regions").select("id", "image_id", "region_source")
    return R.replace_children(old, old.where("region_source = 'full_doc'").withColumn("region_source", F.lit("fresh")), "image_id")


@query("""SELECT DISTINCT * FROM (SELECT source_image_id, target_image_id, relationship_type, evidence FROM image_relationships UNION ALL SELECT target_image_id, source_image_id, relationship_type, evidence FROM image_relationships WHERE source_image_id <> target_image_id)""")
def bidirectional_edges(spark, d):
    return R.both_directions(load(spark, d, "image_relationships"))


@query("""SELECT id FROM image_relationships WHERE NOT coalesce(source_image_id IN (SELECT id FROM images WHERE is_quarantined), false) AND NOT coalesce(target_image_id IN (SELECT id FROM images WHERE is_quarantined), false)""")
def cascade_delete(spark, d):
    gone = images(spark, d).where("is_quarantined").select("id")
    return R.cascade_delete(load(spark, d, "image_relationships").select(F.col("id").alias("edge"), "source_image_id", "target_image_id"), gone, "source_image_id", "target_image_id").select(F.col("edge").alias("id"))


@query("""WITH g AS (SELECT coalesce(canonical_image_id, id) AS c, replace(lower(trim(duplicate_match_type, ' ')), '-', '_') AS k FROM images), p AS (SELECT c, count(*) AS n, count_if(k = 'exact_binary') AS a, count_if(k = 'exact_phash') AS b, count_if(k = 'near_duplicate') AS e FROM g GROUP BY 1)
SELECT count(*) AS n_groups, count_if(n > 1)::BIGINT AS n_dup_groups, max(n) AS largest, sum(a)::BIGINT AS exact_binary, sum(b)::BIGINT AS exact_phash, sum(e)::BIGINT AS near_duplicate FROM p""")
def duplicate_stats(spark, d):
    return R.duplicate_statistics(images(spark, d))


_HASH = "regexp_replace(regexp_replace(lower({c}), '\\s', '', 'g'), '^0x', '')"


@query(f"""SELECT user_id, {_HASH.format(c='sha256_hash')} AS hash, min(id) AS canonical_id, count(*) AS n FROM images WHERE NOT coalesce(is_quarantined, false) AND regexp_full_match({_HASH.format(c='sha256_hash')}, '[0-9a-f]{{64}}') AND replace({_HASH.format(c='sha256_hash')}, left({_HASH.format(c='sha256_hash')}, 1), '') <> '' GROUP BY 1, 2 HAVING count(*) > 1""")
def exact_duplicates(spark, d):
    return R.exact_duplicates(images(spark, d))


@query("""SELECT id, CASE WHEN NOT coalesce(is_duplicate, false) AND (canonical_image_id IS NULL OR canonical_image_id = id) THEN 'canonical' ELSE 'variant' END AS role, coalesce(canonical_image_id, id) AS shown_id FROM images""")
def collapse_roles(spark, d):
    alone = ~F.coalesce("is_duplicate", F.lit(False)) & (F.col("canonical_image_id").isNull() | (F.col("canonical_image_id") == F.col("id")))
    return images(spark, d).select("id", F.when(alone, "canonical").otherwise("variant").alias("role"), F.coalesce("canonical_image_id", "id").cast("long").alias("shown_id"))


@query(f"""WITH s AS (SELECT DISTINCT i.user_id, s.id, upper(s.value) AS value, s.rel_type FROM ({STRONG_SQL}) s JOIN images i ON i.id = s.id WHERE NOT coalesce(i.is_quarantined, false)), h AS (SELECT user_id, value, min(id) AS hub_id FROM s GROUP BY 1, 2)
SELECT s.user_id, s.value, hub_id, s.id, s.rel_type FROM s JOIN h USING (user_id, value) WHERE s.id <> hub_id""")
def shared_identifiers(spark, d):
    return R.shared_identifiers(images(spark, d))


@query("""WITH i AS (SELECT id, user_id, coalesce(canonical_image_id, id) AS c FROM images WHERE NOT coalesce(is_quarantined, false)),
 e AS (SELECT s.c AS source_id, t.c AS target_id, lower(regexp_replace(trim(relationship_type, ' '), '[ -]', '_', 'g')) AS relationship_type, confidence_score FROM image_relationships r JOIN i s ON s.id = r.source_image_id JOIN i t ON t.id = r.target_image_id WHERE s.user_id = t.user_id AND s.c <> t.c)
SELECT source_id, target_id, relationship_type, max(confidence_score) AS confidence, array_to_string(list_transform(string_split(replace(relationship_type, '_', ' '), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS reason FROM e GROUP BY 1, 2, 3""")
def relationships_by_canonical(spark, d):
    return R.related(load(spark, d, "image_relationships"), images(spark, d))


_STEM = "regexp_replace({c}, '\\.[a-z0-9]+$', '')"
_LOW, _BEFORE = "lower(trim(image_name, ' '))", "CASE WHEN contains(image_name, '_') THEN regexp_replace(lower(trim(image_name, ' ')), '_[^_]*$', '') END"


@query(f"""WITH k AS (SELECT '=' || {_LOW} AS k FROM images UNION SELECT {_STEM.format(c=_LOW)} FROM images UNION SELECT {_BEFORE} FROM images UNION SELECT {_STEM.format(c=_BEFORE)} FROM images)
SELECT DISTINCT filename AS name, coalesce('=' || lower(trim(filename, ' ')) IN (SELECT k FROM k WHERE k IS NOT NULL) OR {_STEM.format(c="lower(trim(filename, ' '))")} IN (SELECT k FROM k WHERE k IS NOT NULL), false) AS known FROM metadata WHERE filename IS NOT NULL""")
def sync_check(spark, d):
    return R.known_names(load(spark, d, "metadata").select(F.col("filename").alias("name")), images(spark, d))


_OBJ = "list_filter([" + ", ".join(f"'{o}'" for o in sorted(R.OBJECTS)) + "], lambda o: contains(lower(coalesce(extracted_text, '')), o) OR contains(lower(coalesce(image_name, '')), o))"
_STATUS = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce(extracted_text, '')), '{w}')" for w in ws) + f" THEN '{s}'" for s, ws in R.STATES) + " ELSE 'UNKNOWN' END"


@query(f"SELECT id, array_to_string({_OBJ}, ',') AS objects, {_STATUS} AS status FROM images")
def image_states(spark, d):
    o, s = R.state(F.col("extracted_text"), F.col("image_name"))
    return images(spark, d).select("id", F.array_join(o, ",").alias("objects"), s.alias("status"))


_MOVES = f"""WITH s AS (SELECT id, user_id, category, created_at, {_OBJ} AS o, {_STATUS} AS st FROM images), l AS (SELECT *, lag(id) OVER w AS pid, lag(o) OVER w AS po, lag(st) OVER w AS ps FROM s WINDOW w AS (PARTITION BY user_id, category ORDER BY created_at NULLS FIRST, id))
SELECT id, pid AS previous_id, array_to_string(list_filter(o, lambda x: NOT list_contains(po, x)), ',') AS added, array_to_string(list_filter(po, lambda x: NOT list_contains(o, x)), ',') AS removed, ps AS status_from, st AS status_to FROM l WHERE pid IS NOT NULL"""


@query(_MOVES)
def timeline_transitions(spark, d):
    t = R.transitions(images(spark, d))
    return t.withColumn("added", F.array_join("added", ",")).withColumn("removed", F.array_join("removed", ","))


@query(f"""WITH m AS ({_MOVES}), w AS (SELECT id, lower(concat_ws(' ', replace(added, ',', ' '), replace(removed, ',', ' '), status_to)) AS t, len(list_intersect(string_split(added || ',' || removed, ','), ['payment', 'receipt'])) > 0 AS touched, status_from <> status_to AND status_to = 'PAID' AS paid FROM m)
SELECT id, round(least(1.0, touched::INT * 0.8 + paid::INT * 0.9 + (contains(t, 'payment')::INT + contains(t, 'receipt')::INT) * 0.2), 4)::DOUBLE AS score FROM w WHERE touched OR paid OR contains(t, 'payment') OR contains(t, 'receipt')""")
def change_search(spark, d):
    return R.change_scores(R.transitions(images(spark, d)), "payment receipt")


_GRAPH = f"""WITH m AS (SELECT DISTINCT i.user_id, s.id, s.rel_type || ':' || lower(s.value) AS entity, 'HAS_' || upper(replace(s.rel_type, 'shared_', '')) AS edge FROM ({STRONG_SQL}) s JOIN images i ON i.id = s.id), c AS (SELECT user_id, entity FROM m GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT id AS source, entity AS target, edge FROM m JOIN c USING (user_id, entity)"""


@query(_GRAPH)
def knowledge_graph(spark, d):
    return R.entity_graph(images(spark, d))


@query(f"""WITH g AS ({_GRAPH}) SELECT count(DISTINCT source) AS n_documents, count(DISTINCT target) AS n_entities, count(DISTINCT (source, target, edge)) AS n_edges FROM g""")
def graph_counts(spark, d):
    return R.entity_graph(images(spark, d)).agg(F.countDistinct("source").alias("n_documents"), F.countDistinct("target").alias("n_entities"), F.countDistinct("source", "target", "edge").alias("n_edges"))


_CLEAN = "(SELECT user_id, id, CASE WHEN regexp_full_match(s, '[0-9a-f]{64}') AND replace(s, left(s, 1), '') <> '' THEN s END AS s, CASE WHEN regexp_full_match(p, '[0-9a-f]{16}') AND replace(p, left(p, 1), '') <> '' THEN ('0x' || p)::UBIGINT END AS p FROM (SELECT user_id, id, " + _HASH.format(c="sha256_hash") + " AS s, " + _HASH.format(c="phash") + " AS p FROM images WHERE NOT coalesce(is_quarantined, false)))"


@query(f"""WITH c AS {_CLEAN}, m AS (SELECT x.id, y.id AS other, CASE WHEN x.s = y.s THEN 1 WHEN x.p = y.p THEN 2 ELSE 3 END AS tier, CASE WHEN coalesce(x.s = y.s, false) OR x.p = y.p THEN 0 ELSE bit_count(xor(x.p, y.p)) END AS d FROM c x JOIN c y ON x.user_id = y.user_id AND y.id < x.id AND (x.s = y.s OR bit_count(xor(x.p, y.p)) <= 5))
SELECT id, other AS match_id, CASE tier WHEN 1 THEN 'exact_binary' WHEN 2 THEN 'exact_phash' ELSE 'near_duplicate' END AS match_type, round(1 - d / 64.0, 4)::DOUBLE AS similarity FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier, d, other) = 1""")
def duplicate_cascade(spark, d):
    return DU.cascade(images(spark, d))


@query()
def near_duplicate_groups(spark, d):
    return DU.near_groups(images(spark, d))
