"""Entity extraction queries: one row per text and value."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import entities as E
from paperloom.plans.registry import query
from paperloom.sources.tables import load

T = "extracted_text"


def _rows(spark, d, f, name):
    return load(spark, d, "images").select("id", F.explode(f(F.col(T))).alias(name))


def _esc(p: str) -> str:
    return p.replace("'", "''")


_MN = "CASE lower(substr({m}, 1, 3)) " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1)) + " END"
_DAYS = f"""
raw AS (
  SELECT id, unnest(regexp_extract_all({T}, '{E.TEXTUAL}', 3))::INT AS y, {_MN.format(m=f"unnest(regexp_extract_all({T}, '{E.TEXTUAL}', 2))")} AS m, translate(unnest(regexp_extract_all({T}, '{E.TEXTUAL}', 1)), 'Oo', '00')::INT AS dd FROM images
  UNION ALL SELECT id, unnest(regexp_extract_all({T}, '{E.DMY}', 3))::INT, unnest(regexp_extract_all({T}, '{E.DMY}', 2))::INT, unnest(regexp_extract_all({T}, '{E.DMY}', 1))::INT FROM images
  UNION ALL SELECT id, unnest(regexp_extract_all({T}, '{E.YMD}', 1))::INT, unnest(regexp_extract_all({T}, '{E.YMD}', 2))::INT, unnest(regexp_extract_all({T}, '{E.YMD}', 3))::INT FROM images),
days AS (SELECT DISTINCT id, printf('%04d-%02d-%02d', y, m, dd) AS iso FROM raw WHERE dd BETWEEN 1 AND CASE WHEN m IN (4, 6, 9, 11) THEN 30 WHEN m = 2 AND (y % 4 = 0 AND y % 100 <> 0 OR y % 400 = 0) THEN 29 WHEN m = 2 THEN 28 ELSE 31 END),
bare AS (SELECT DISTINCT id, unnest(regexp_extract_all({T}, '{E.MONTH_YEAR}', 2)) || '-' || lpad(({_MN.format(m=f"unnest(regexp_extract_all({T}, '{E.MONTH_YEAR}', 1))")})::VARCHAR, 2, '0') AS iso FROM images)
"""


@query(f"WITH {_DAYS} SELECT id, iso FROM days UNION ALL SELECT id, iso FROM bare b WHERE NOT EXISTS (SELECT 1 FROM days d WHERE d.id = b.id AND starts_with(d.iso, b.iso))")
def entity_dates(spark, d):
    return _rows(spark, d, E.dates, "iso")


@query(f"SELECT DISTINCT id, lower(unnest(regexp_extract_all({T}, '{E.EMAIL}'))) AS email FROM images")
def entity_emails(spark, d):
    return _rows(spark, d, E.emails, "email")


_PHONES = f"""SELECT DISTINCT id, phone FROM (SELECT id, CASE WHEN length(x) = 12 AND starts_with(x, '91') THEN substr(x, 3) ELSE x END AS phone FROM (
  SELECT id, regexp_replace(unnest(list_concat(regexp_extract_all({T}, '{E.PHONE_NEAR}', 1), regexp_extract_all({T}, '{_esc(E.PHONE)}', 1))), '[^0-9]', '', 'g') AS x FROM images)) WHERE length(phone) = 10 AND phone <> repeat(left(phone, 1), 10)"""


@query(_PHONES)
def entity_phones(spark, d):
    return _rows(spark, d, E.phones, "phone")


_TIDY = "regexp_replace(regexp_replace(concat_ws(' ', qr_payload, extracted_text), 'https?\\s*:\\s*//\\s*', 'https://', 'gi'), '(\\w+)\\s*\\.\\s*(com|in|edu|org|net|gov|io|ai|gle)\\b', '\\1.\\2', 'gi')"
_TRIM = "'.,;:\"'')[]{}<>'"


@query(f"""WITH u AS (SELECT id, trim(x, {_TRIM}) AS u, n FROM (SELECT id, unnest(us) AS x, generate_subscripts(us, 1) AS n FROM (SELECT id, regexp_extract_all({_TIDY}, '{_esc(E.URL)}') AS us FROM images))),
 f AS (SELECT id, n, CASE WHEN regexp_matches(lower(u), '^https?://') THEN u ELSE 'https://' || regexp_replace(u, '^www\\.', '', 'i') END AS url FROM u WHERE length(u) >= 4 AND NOT regexp_matches(lower(u), '\\.(?:{'|'.join(E.FILE_SUFFIXES)})$'))
SELECT id, url FROM f QUALIFY row_number() OVER (PARTITION BY id, lower(url) ORDER BY n) = 1""")
def entity_urls(spark, d):
    text = F.concat_ws(" ", "qr_payload", "extracted_text")
    return load(spark, d, "images").select("id", F.explode(E.urls(text)).alias("url"))


@query(f"SELECT DISTINCT id, amount FROM (SELECT id, TRY_CAST(replace(unnest(regexp_extract_all({T}, '{E.AMOUNT}', 1)), ',', '') AS DOUBLE) AS amount, 1.0 AS least FROM images UNION ALL SELECT id, TRY_CAST(replace(unnest(regexp_extract_all({T}, '{E.AMOUNT_NEAR}', 1)), ',', '') AS DOUBLE), 10.0 FROM images) WHERE amount >= least AND NOT (least = 10 AND amount IN {E.NO_AMOUNT})")
def entity_amounts(spark, d):
    return _rows(spark, d, E.amounts, "amount")


_IDS = f"""SELECT DISTINCT id, ident FROM (SELECT id, upper(unnest(list_concat(regexp_extract_all({T}, '{E.LABELLED_ID}', 1), regexp_extract_all({T}, '{E.ROLL}', 1)))) AS ident FROM images)
 WHERE length(ident) >= 3 AND regexp_matches(ident, '[0-9]') AND NOT regexp_full_match(ident, '20(2[0-9]|30)') AND ident NOT IN {E.WEAK_IDS!r}"""


@query(_IDS)
def entity_ids(spark, d):
    return _rows(spark, d, E.identifiers, "ident")


_AADHAAR = f"SELECT DISTINCT id, substr(x, 1, 4) || ' ' || substr(x, 5, 4) || ' ' || substr(x, 9, 4) AS number FROM (SELECT id, regexp_replace(unnest(regexp_extract_all({T}, '{E.AADHAAR}', 1)), '\\s', '', 'g') AS x FROM images)"
_PAN = f"SELECT DISTINCT id, unnest(regexp_extract_all({T}, '{E.PAN}', 1)) AS number FROM images"


@query(f"SELECT id, 'aadhaar' AS kind, number FROM ({_AADHAAR}) UNION ALL SELECT id, 'pan', number FROM ({_PAN})")
def entity_national_ids(spark, d):
    a = _rows(spark, d, E.aadhaar, "number").withColumn("kind", F.lit("aadhaar"))
    return a.unionByName(_rows(spark, d, E.pan, "number").withColumn("kind", F.lit("pan")))


@query()
def entity_struct(spark, d):
    return load(spark, d, "images").select("id", E.entities(F.col(T)).alias("e")).select("id", "e.*")


STRONG_SQL = f"""SELECT id, 'shared_aadhaar' AS rel_type, number AS value, 1.0::DOUBLE AS confidence FROM ({_AADHAAR})
 UNION ALL SELECT id, 'shared_pan', number, 1.0 FROM ({_PAN})
 UNION ALL SELECT id, 'shared_email', email, 0.95 FROM (SELECT DISTINCT id, lower(unnest(regexp_extract_all({T}, '{E.EMAIL}'))) AS email FROM images) WHERE instr(email, '@') > 2 AND NOT regexp_matches(email, '^({'|'.join(E.GENERIC_MAIL)})')
 UNION ALL SELECT id, 'shared_phone', phone, 0.95 FROM ({_PHONES}) WHERE NOT regexp_matches(phone, '^({'|'.join(E.HELPLINES)})') AND phone <> '1234567890'
 UNION ALL SELECT id, 'shared_id', ident, 1.0 FROM ({_IDS})"""


@query(STRONG_SQL)
def strong_identifiers(spark, d):
    return load(spark, d, "images").select("id", F.explode(E.strong_identifiers(F.col(T))).alias("s")).select("id", "s.*")
