"""Text search, similarity and summary queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from paperloom.functions import text as T
from paperloom.operators import lexical, postings as P
from paperloom.plans.registry import query
from paperloom.sources.tables import load

TOK = f"SELECT doc_id, {T.sql_tokens('text')} AS toks FROM documents"
PHRASE = ("please", "note", "that")
LIT = "steel table lamp"
STOP = "(" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + ")"


@query(f"""WITH t AS ({TOK} WHERE text IS NOT NULL), c AS (
  SELECT doc_id, len(toks) AS n, len(list_filter(range(0, len(toks)), lambda i: toks[i+1:i+3] = ['please', 'note', 'that'])) AS k
  FROM t WHERE list_has_all(toks, ['please', 'note', 'that'])),
 s AS (SELECT count(*) AS df FROM c), a AS (SELECT count(*) AS nd FROM documents)
SELECT doc_id, k AS phrase_count, round(k / n * (ln((nd + 1.0) / (df + 1.0)) + 1.0) * 3.0, 4) AS score FROM c, s, a WHERE k > 0""")
def phrase_search(spark, d):
    return P.phrase_search(load(spark, d, "documents"), " ".join(PHRASE))


@query(f"""WITH p AS (SELECT doc_id, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos FROM ({TOK})),
 g AS (SELECT a.doc_id, min(abs(a.pos - b.pos)) AS m FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.term = 'amount' AND b.term = 'due' AND abs(a.pos - b.pos) BETWEEN 1 AND 10 GROUP BY 1)
SELECT doc_id, m AS min_distance, round(1.0 / (m + 0.5), 3) AS score FROM g""")
def proximity_search(spark, d):
    return P.proximity_search(load(spark, d, "documents"), "amount", "due", 10)


@query(f"""WITH p AS (SELECT doc_id, unnest(toks) AS term FROM ({TOK})), t AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM p GROUP BY term)
SELECT count(*) AS vocabulary, sum(df)::BIGINT AS pairs, sum(cf)::BIGINT AS positions FROM t""")
def postings_stats(spark, d):
    return P.statistics(load(spark, d, "documents"))


@query(f"""WITH p AS (SELECT doc_id, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM ({TOK}))
SELECT term, doc_id, count(*) AS tf, min(pos)::BIGINT AS first_pos, max(pos)::BIGINT AS last_pos FROM p GROUP BY 1, 2""")
def term_postings(spark, d):
    p = P.postings(load(spark, d, "documents"))
    return p.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.min("pos").cast("long").alias("first_pos"), F.max("pos").cast("long").alias("last_pos"))


@query("""SELECT id, image_name FROM images WHERE NOT coalesce(is_quarantined, false) AND (contains(lower(coalesce(extracted_text, '')), 'receipt number') OR contains(lower(coalesce(image_name, '')), 'receipt number') OR contains(lower(coalesce(qr_payload, '')), 'receipt number'))""")
def keyword_like(spark, d):
    return lexical.keyword_scan(load(spark, d, "images"), "receipt number").select("id", "image_name")


@query(f"""SELECT doc_id, list_filter(list_transform(regexp_extract_all(CASE WHEN regexp_matches(text, '%[0-9A-Fa-f]{{2}}') THEN url_decode(text) ELSE text END, '{T.LEXICAL}'), lambda w: lower(w)), lambda w: w NOT IN {STOP} AND (length(w) >= 2 OR regexp_full_match(w, '[0-9]'))) AS tokens FROM documents WHERE text IS NOT NULL""")
def lexical_tokens(spark, d):
    return load(spark, d, "documents").where("text is not null").select("doc_id", T.lexical_tokens(F.col("text")).alias("tokens"))


def keyword_sql(table: str, by: str) -> str:
    """The five heaviest words of every group of texts."""
    return f"""WITH w AS (SELECT coalesce({by}, '') AS {by}, doc_id, unnest(list_filter(list_transform(regexp_extract_all(CASE WHEN regexp_matches(text, '%[0-9A-Fa-f]{{2}}') THEN url_decode(text) ELSE text END, '{T.LEXICAL}'), lambda w: lower(w)), lambda w: w NOT IN {STOP} AND length(w) > 3)) AS term FROM {table}),
 tf AS (SELECT {by}, term, count(*) AS tf FROM w GROUP BY 1, 2), df AS (SELECT term, count(DISTINCT doc_id) AS df FROM w GROUP BY 1), n AS (SELECT count(*) AS nd FROM {table}),
 s AS (SELECT {by}, term, round(tf * (ln((nd + 1.0) / (df + 1.0)) + 1.0), 4) AS weight FROM tf JOIN df USING (term), n)
SELECT {by}, term, weight, row_number() OVER (PARTITION BY {by} ORDER BY weight DESC, term)::INTEGER AS rank FROM s QUALIFY rank <= 5"""


@query(keyword_sql("documents", "doc_type"))
def tfidf_keywords(spark, d):
    docs = load(spark, d, "documents").withColumn("doc_type", F.coalesce("doc_type", F.lit("")))
    return P.keyword_weights(docs, "doc_type", 5)


def _parts(spark, d):
    return load(spark, d, "part").select("p_partkey", "p_name")


@query(f"""WITH s AS (SELECT p_partkey, {T.sql_set('p_name')} AS x, {T.sql_set("'" + LIT + "'")} AS y FROM part)
SELECT p_partkey, round(2.0 * len(list_intersect(x, y)) / (len(x) + len(y)), 4) AS dice FROM s""")
def dice_similarity(spark, d):
    return _parts(spark, d).select("p_partkey", T.dice(F.col("p_name"), F.lit(LIT)).alias("dice"))


@query(f"""WITH t AS (SELECT p_partkey, list_max(list_transform(list_filter(string_split(p_name, ' '), lambda w: w <> ''), lambda w: round(2.0 * len(list_intersect({T.sql_set('w')}, {T.sql_set("'stele'")})) / (len({T.sql_set('w')}) + len({T.sql_set("'stele'")})), 4))) AS best FROM part)
SELECT p_partkey, best, CASE WHEN best >= 0.9 THEN 'exact' WHEN best >= 0.7 THEN 'fuzzy' ELSE 'none' END AS band FROM t""")
def dice_bands(spark, d):
    b = lexical.dice_band(F.split("p_name", " "), "stele")
    return _parts(spark, d).select("p_partkey", b.alias("b")).select("p_partkey", "b.best", "b.band")


@query("""SELECT p_partkey, round(((CASE WHEN contains(lower(p_name), 'steel') THEN 1.0 ELSE (contains(lower(p_name), 'eel')::INT + contains(lower(p_name), 'ste')::INT + contains(lower(p_name), 'stee')::INT + contains(lower(p_name), 'steel')::INT + contains(lower(p_name), 'tee')::INT + contains(lower(p_name), 'teel')::INT) / 6.0 END)) / 1.0, 4) AS support FROM part""")
def subword_support(spark, d):
    return _parts(spark, d).select("p_partkey", T.subword_support(F.col("p_name"), "steel").alias("support"))


@query("""WITH g AS (SELECT p_partkey, replace(replace(replace(translate(lower(p_name), '018', 'olb'), 'rn', 'm'), 'vv', 'w'), 'cl', 'd') AS s FROM part)
SELECT p_partkey, CASE WHEN length(s) >= 4 AND s LIKE 'f%' THEN 's' || substr(s, 2) ELSE s END AS normal FROM g""")
def glyph_normal_form(spark, d):
    return _parts(spark, d).select("p_partkey", T.glyphs(F.col("p_name")).alias("normal"))


@query(f"SELECT p_partkey, round(1.0 - levenshtein(lower(p_name), '{LIT}') / greatest(length(p_name), {len(LIT)}), 4) AS similarity FROM part")
def normalized_levenshtein(spark, d):
    return _parts(spark, d).select("p_partkey", T.plain_similarity(F.lower("p_name"), F.lit(LIT)).alias("similarity"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
 s AS (SELECT doc_id, w, unnest(range(0, greatest(0, floor((len(w) - 51) / 200)::BIGINT * 200) + 1, 200)) AS s FROM w WHERE len(w) > 0)
SELECT doc_id, (s / 200)::INTEGER AS window_no, len(w[s + 1:s + 250])::INTEGER AS n_words, md5(array_to_string(w[s + 1:s + 250], ' ')) AS digest FROM s""")
def chunk_windows(spark, d):
    docs = load(spark, d, "documents").where("text is not null")
    out = docs.select("doc_id", F.posexplode(T.windows(F.col("text"))).alias("window_no", "chunk"))
    return out.select("doc_id", "window_no", F.size(F.split("chunk", " ")).alias("n_words"), F.md5("chunk").alias("digest"))


_SENT = "list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1\n', 'g'), '\\n+'), lambda s: trim(s, ' ')), lambda s: length(s) >= 10)"


_SCORED = f"""WITH s AS (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS n FROM (SELECT doc_id, {_SENT} AS ss FROM documents WHERE text IS NOT NULL)),
 w AS (SELECT doc_id, n, list_filter(regexp_extract_all(lower(sentence), '[a-z]{{2,}}'), lambda x: x NOT IN {STOP}) AS ws FROM s),
 t AS (SELECT doc_id, n, unnest(ws) AS term, len(ws) AS size FROM w), tf AS (SELECT doc_id, n, term, size, count(*) AS c FROM t GROUP BY ALL),
 df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY 1, 2), ns AS (SELECT doc_id, count(*) AS ns FROM s GROUP BY 1)
SELECT tf.doc_id, tf.n AS sentence_no, round(sum(c / size * (ln((ns + 1.0) / (df + 1.0)) + 1.0)), 4) AS score FROM tf JOIN df USING (doc_id, term) JOIN ns USING (doc_id) GROUP BY 1, 2"""


@query(_SCORED)
def tfidf_sentences(spark, d):
    return lexical.sentence_scores(load(spark, d, "documents")).withColumn("sentence_no", F.col("sentence_no").cast("long"))


@query(f"""WITH r AS ({_SCORED}), t AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sentence_no) <= 3),
 s AS (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS sentence_no FROM (SELECT doc_id, {_SENT} AS ss FROM documents WHERE text IS NOT NULL))
SELECT doc_id, md5(string_agg(sentence, ' ' ORDER BY sentence_no)) AS digest, count(*) AS n_sentences FROM t JOIN s USING (doc_id, sentence_no) GROUP BY 1""")
def tfidf_summary(spark, d):
    s = lexical.summary(load(spark, d, "documents"), 3)
    return s.select("doc_id", F.md5("summary").alias("digest"), F.col("n_sentences").cast("long").alias("n_sentences"))


_TONE = {name: "(" + " + ".join(f"regexp_matches(lower(text), '\\b{w}\\b')::INT" for w in ws) + ")" for name, ws in lexical.TONES.items()}


@query("SELECT doc_id, " + ", ".join(f'{n}::INTEGER AS "{name}"' for name, n in _TONE.items()) + " FROM documents WHERE text IS NOT NULL")
def tone_counts(spark, d):
    docs = load(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", *[c.alias(n) for n, c in lexical.tone_counts(F.col("text")).items()])


@query(f"""WITH n AS (SELECT doc_id, [{', '.join(_TONE.values())}] AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN list_max(n) > 0 THEN {list(_TONE)!r}[list_position(n, list_max(n))] ELSE 'general' END AS tone, CASE WHEN list_sum(n) > 0 THEN round(list_max(n) / list_sum(n), 4) ELSE 0 END::DOUBLE AS share, n[4] > 0 AS urgent FROM n""")
def text_tone(spark, d):
    return load(spark, d, "documents").where("text is not null").select("doc_id", lexical.tone(F.col("text")).alias("t")).select("doc_id", "t.*")


@query("""SELECT id, list_distinct(list_transform(regexp_extract_all(extracted_text, '(?i)\\brece[a-z0-9_]*'), lambda x: lower(x))) AS marks FROM images WHERE len(regexp_extract_all(extracted_text, '(?i)\\brece[a-z0-9_]*')) > 0""".replace("list_distinct(", "list_sort(list_distinct(").replace("lower(x)))", "lower(x))))"))
def keyword_highlights(spark, d):
    found = F.array_distinct(F.transform(T.all_of(F.col("extracted_text"), r"(?i)\brece[a-z0-9_]*"), F.lower))
    return load(spark, d, "images").select("id", F.sort_array(found).alias("marks")).where("size(marks) > 0")


def _set(w: str) -> str:
    return T.sql_set(w)


def qa_sql(words: tuple[str, ...], top: int, where: str = "true") -> str:
    """The best sentences of each text for the words of a question."""
    dice = " + ".join(f"list_sum(list_transform(list_filter(list_transform(toks, lambda t: round(2.0 * len(list_intersect({_set('t')}, {_set(repr(w))})) / (len({_set('t')}) + len({_set(repr(w))})), 4)), lambda x: x >= 0.75), lambda x: x))" for w in words).replace("list_sum(", "coalesce(list_sum(").replace("lambda x: x))", "lambda x: x)), 0)")
    hits = " + ".join(f"contains(lower(sentence), '{w}')::INT" for w in words)
    return f"""WITH s AS (SELECT DISTINCT id, unnest(list_filter(list_transform(regexp_split_to_array(extracted_text, '[.\\n\\r]+'), lambda s: trim(s, ' ')), lambda s: length(s) >= 5)) AS sentence FROM images WHERE {where}),
 t AS (SELECT id, sentence, list_filter(regexp_extract_all(lower(sentence), '[a-zA-Z0-9\\x{{0900}}-\\x{{097F}}]+'), lambda t: length(t) >= 2) AS toks FROM s),
 r AS (SELECT id, sentence, round((({hits}) * 1.5 + {dice}) / {len(words)}.0, 3) AS score FROM t)
SELECT id, sentence, score FROM r WHERE score > 0.2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, sentence) <= {top}"""


@query(qa_sql(("amount", "due", "bill"), 2))
def qa_sentences(spark, d):
    return lexical.answer_sentences(load(spark, d, "images"), ("amount", "due", "bill"), 2)


@query("""SELECT id, regexp_extract(extracted_text, '(?i)(?:₹|Rs\\.?|INR)\\s*([0-9][0-9,]*(?:\\.[0-9]{1,2})?)', 1) AS amount, regexp_extract(extracted_text, '([0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})', 1) AS date_value FROM images WHERE extracted_text IS NOT NULL""")
def specific_values(spark, d):
    c = F.col("extracted_text")
    return load(spark, d, "images").where(c.isNotNull()).select("id", lexical.specific_value(c, "amount").alias("amount"), lexical.specific_value(c, "date").alias("date_value"))


_PLAIN = "nullif(trim(coalesce({c}, ''), ' '), '')"
_META = "CASE WHEN json_valid(visual_metadata) THEN visual_metadata::JSON END"
_CODED = f"(coalesce(has_visual_objects, false) OR coalesce((json_extract_string({_META}, '$.detected') = 'true'), false) OR trim(coalesce(qr_payload, ''), ' ') <> '')"
_OBJECTS = f"array_to_string(list_transform(from_json(coalesce(json_extract({_META}, '$.objects'), '[]'), '[{{\"label\":\"VARCHAR\",\"type\":\"VARCHAR\",\"data\":\"VARCHAR\"}}]'), lambda o: concat_ws(' ', o.label, o.type, o.data)), ' ')"
SEARCHABLE = f"""concat_ws(' ', {', '.join(_PLAIN.format(c=c) for c in ('extracted_text', 'cleaned_text', 'blip_caption', 'qr_payload', 'stego_payload'))},
 nullif(array_to_string(json_extract_string(CASE WHEN json_valid(entities_json) THEN entities_json::JSON END, '$.urls[*]'), ' '), ''), nullif(trim(concat_ws(' ', CASE WHEN {_CODED} THEN '{lexical.CODE_WORDS}' END, json_extract_string({_META}, '$.type'), {_OBJECTS}), ' '), ''), {_PLAIN.format(c='category')})"""


@query(f"SELECT id, {SEARCHABLE} AS searchable FROM images")
def searchable_text(spark, d):
    return load(spark, d, "images").select("id", lexical.searchable_text().alias("searchable"))


def _sanitised_sql(c: str) -> str:
    for tag in ("script", "iframe", "object", "embed", "style", "link", "meta", "form"):
        c = f"regexp_replace(regexp_replace({c}, '(?is)<{tag}[^>]*>.*?</{tag}>', '', 'g'), '(?i)</?{tag}[^>]*>', '', 'g')"
    c = f"regexp_replace(regexp_replace({c}, '(?i)\\bon[a-z]+\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^\\s>]+)', '', 'g'), '(?i)javascript:', '', 'g')"
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        c = f"replace({c}, '{raw}', '{safe}')"
    return f"trim({c}, ' ')"


@query(f"SELECT doc_id, {_sanitised_sql('text')} AS safe FROM documents")
def sanitized_text(spark, d):
    return load(spark, d, "documents").select("doc_id", T.sanitized(F.col("text")).alias("safe"))


@query()
def fuzzy_terms(spark, d):
    return lexical.fuzzy_vocabulary(load(spark, d, "documents"), ("electrcity", "scholarshp", "challan"))


@query()
def exact_scores(spark, d):
    return lexical.exact_search(load(spark, d, "images"), "scholarship stipend released", 0.65)


@query()
def fuzzy_scores(spark, d):
    return lexical.fuzzy_search(load(spark, d, "images"), "scholarshp stipnd", 0.65)


@query()
def unified_text_search(spark, d):
    return lexical.unified_search(load(spark, d, "images"), "scholarship stipend", 0.65)


@query()
def cross_weighted(spark, d):
    return _parts(spark, d).select("p_partkey", lexical.cross_weighted(F.col("p_name"), F.lit(LIT)).alias("similarity"))


@query(f"""WITH s AS (SELECT DISTINCT doc_id, unnest({_SENT}) AS sentence FROM documents WHERE text IS NOT NULL),
 d AS (SELECT doc_id, sentence, round((CASE WHEN regexp_matches(sentence, '[0-9]') THEN 2.0 ELSE 0 END) + (CASE WHEN regexp_matches(lower(sentence), '₹|\\b(rs|inr|rupees|tax|gst|total|amount)\\b') THEN 2.5 ELSE 0 END) + len(regexp_extract_all(sentence, '\\b[A-Z]{{3,}}\\b')) * 0.8 + (CASE WHEN length(sentence) BETWEEN 15 AND 120 THEN 1.5 ELSE 0 END), 4)::DOUBLE AS score FROM s)
SELECT doc_id, sentence, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sentence)::INTEGER AS rank FROM d QUALIFY rank <= 4""")
def density_summary(spark, d):
    return lexical.density_summary(load(spark, d, "documents"), 4)


@query("""SELECT id, regexp_matches(extracted_text, '[\\x{0900}-\\x{097F}]') AS devanagari FROM images WHERE extracted_text IS NOT NULL""")
def script_test(spark, d):
    c = F.col("extracted_text")
    return load(spark, d, "images").where(c.isNotNull()).select("id", c.rlike(r"[\x{0900}-\x{097F}]").alias("devanagari"))
