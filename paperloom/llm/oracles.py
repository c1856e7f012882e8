"""SQL of the llm queries that SQL can express on whole tables."""

from __future__ import annotations

_LINKED = """
WITH RECURSIVE pairs AS (
  SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM ({links})
  WHERE a IN (SELECT id FROM images) AND b IN (SELECT id FROM images) AND a <> b),
both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
grouped AS (SELECT a AS image_id, least(a, min(b)) AS group_id FROM reach GROUP BY a)
"""

_STAND_INS = "('', '-', '--', '?', '.', 'n/a', 'na', 'n.a.', 'nan', 'nil', 'none', 'null', 'unknown', 'undefined', 'tbd', '0', '0.0', '0000', '0000-00-00', '0000-00-00t00:00:00', '{}', '[]', '[{}]', '\"\"')"


def _filled(c: str) -> str:
    return f"(CASE WHEN lower(trim({c}, chr(32) || chr(9) || chr(10) || chr(13))) IN {_STAND_INS} OR {c} IS NULL THEN 0 ELSE 1 END)"


_P1 = _LINKED.format(links="SELECT id AS a, canonical_image_id AS b FROM images") + f"""
, scored AS (
  SELECT g.group_id, i.id, i.created_at, {' + '.join(_filled(c) for c in ('extracted_text', 'category', 'blip_caption', 'qr_payload', 'primary_date', 'exif_created_at', 'entities_json', 'file_format'))}
    + (CASE WHEN image_width > 0 THEN 1 ELSE 0 END) AS n
  FROM images i JOIN grouped g ON i.id = g.image_id)
SELECT group_id, id AS image_id FROM scored
QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY n DESC, created_at DESC NULLS LAST, id) = 1
"""

_FIELDS = ("extracted_text", "category", "blip_caption", "qr_payload", "primary_date", "exif_created_at", "entities_json", "file_format", "image_width")
_OUTER = "lower(regexp_replace({c}::VARCHAR, '^[\\s\\p{{Z}}\\p{{Cf}}]+|[\\s\\p{{Z}}\\p{{Cf}}]+$', '', 'g'))"


def _held(c: str) -> str:
    if c == "image_width":
        return f"{c} > 0"
    p = _OUTER.format(c=c)
    return f"{c} IS NOT NULL AND {f'regexp_replace({p}, {chr(39)}{chr(92)}s+{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})' if c.endswith('_json') else p} NOT IN {_STAND_INS}"


_P1_RECORDS = _LINKED.format(links="SELECT id AS a, canonical_image_id AS b FROM images") + f"""
, own AS (SELECT g.group_id, i.*, (CASE {_OUTER.format(c='indexing_status')} WHEN 'completed' THEN 1.0 WHEN 'processing' THEN 0.6 WHEN 'failed' THEN 0.3 ELSE 0.5 END) * (CASE WHEN is_quarantined THEN 0.1 ELSE 1.0 END) AS trust,
  max(i.created_at) OVER (PARTITION BY g.group_id) AS newest FROM images i JOIN grouped g ON i.id = g.image_id),
cells AS ({' UNION ALL '.join(f"SELECT group_id, id, created_at, trust::DOUBLE * coalesce(pow(2.0, -date_diff('day', created_at::DATE, newest::DATE) / 180.0), 0.0) AS weight, '{f}' AS field, {f}::VARCHAR AS value, {_OUTER.format(c=f)} AS key FROM own WHERE {_held(f)}" for f in _FIELDS)}),
votes AS (SELECT group_id, field, key, sum(weight) AS votes, max(created_at) AS seen, arg_min(value, id) AS value FROM cells GROUP BY 1, 2, 3),
won AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY group_id, field ORDER BY round(votes, 12) DESC, seen DESC NULLS LAST, key) = 1)
SELECT g.group_id, {', '.join(f"max(CASE WHEN field = '{f}' THEN value END) AS {f}" for f in _FIELDS)} FROM (SELECT DISTINCT group_id FROM grouped) g LEFT JOIN won USING (group_id) GROUP BY 1
"""

_P4 = _LINKED.format(links="SELECT id AS a, canonical_image_id AS b FROM images UNION ALL SELECT source_image_id, target_image_id FROM image_relationships") + "SELECT group_id, image_id FROM grouped"


def _hash(c: str, n: int) -> str:
    plain = f"regexp_replace(regexp_replace(lower({c}), '\\s', '', 'g'), '^0x', '')"
    return f"CASE WHEN regexp_full_match({plain}, '[0-9a-f]{{{n}}}') AND {plain} <> repeat(left({plain}, 1), {n}) THEN {plain} END"


_SEEN = f"""
WITH hashed AS (
  SELECT -1 AS n, user_id, sha256_hash AS s, phash AS p FROM images WHERE NOT coalesce(is_quarantined, false)
  UNION ALL SELECT upload_id, user_id, sha256_hash, phash FROM incoming_uploads),
clean AS (SELECT DISTINCT n, user_id, {_hash('s', 64)} AS s, ('0x' || ({_hash('p', 16)}))::UBIGINT AS p FROM hashed),
dup AS (SELECT DISTINCT x.n AS upload_id FROM clean x JOIN clean y ON x.user_id = y.user_id AND y.n < x.n
  AND (x.s = y.s OR bit_count(xor(x.p, y.p)) <= 5) WHERE x.n >= 0)
"""

ORACLES = {
    "p1_found": _P1,
    "p1_records": _P1_RECORDS,
    "p3_found": _SEEN + "SELECT upload_id FROM dup",
    "p3_decisions": _SEEN + "SELECT DISTINCT u.upload_id, CASE WHEN d.upload_id IS NULL THEN 'new' ELSE 'duplicate' END AS decision FROM incoming_uploads u LEFT JOIN dup d USING (upload_id) WHERE u.upload_id IS NOT NULL",
    "p4_found": _P4,
}
