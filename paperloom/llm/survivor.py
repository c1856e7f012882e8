"""Best representative of each duplicate group (problem 1).

Groups come from duplicate pointers.  The fields of their rows are unpivoted
to long rows (group, row, field, value); every filled value votes for its
normalised form with the trust in its source times the decay of its age, votes
are summed per value, the winner of each field is chosen with ``max_by`` and
the winners are pivoted back into one record.  The surviving row of a group is
elected from the same long rows: each filled field is one vote for its row.
All steps are aggregates that combine map-side, so a group may hold any share
of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.llm.groups import components

FIELDS = ("extracted_text", "category", "blip_caption", "qr_payload", "primary_date", "exif_created_at", "entities_json", "file_format", "image_width")
# Spellings that stand for "no value", in lower case without outer blanks.
STAND_INS = ("", "-", "--", "?", ".", "n/a", "na", "n.a.", "nan", "nil", "none", "null", "unknown", "undefined", "tbd", "0", "0.0", "0000", "0000-00-00", "0000-00-00t00:00:00", "{}", "[]", "[{}]", "\"\"")
# Trust in the state of the row that gives a value.
TRUST = (("completed", 1.0), ("processing", 0.6), ("failed", 0.3))
HALF_LIFE_DAYS = 180.0


def _plain(c: Column) -> Column:
    return F.lower(F.regexp_replace(c.cast("string"), r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", ""))


def is_filled(name: str, c: Column) -> Column:
    """True where the field has a value: not null, blank, zero, empty JSON or a stand-in."""
    p = _plain(c)
    if name.endswith("_json"):
        p = F.regexp_replace(p, r"\s+", "")
    if name == "image_width":
        return F.coalesce(c.cast("double") > 0, F.lit(False)) & ~F.isnan(c.cast("double"))
    return F.coalesce(~p.isin(*STAND_INS), F.lit(False))


def pointer_groups(images: DataFrame) -> DataFrame:
    """(id, group_id) over images tied by canonical_image_id; ends that are no row tie nothing."""
    ids = images.select(F.col("id").alias("known")).where("known is not null").distinct()
    pairs = images.select(F.col("id"), F.col("canonical_image_id").cast("long").alias("to")).where("id <> to")
    return components(pairs.join(ids, F.col("to") == F.col("known"), "left_semi"))


def unpivoted(images: DataFrame, groups: DataFrame) -> DataFrame:
    """Long rows (group_id, id, created_at, field, value, key, filled, weight) of all rows in groups."""
    trust = F.lit(0.5)
    for state, t in TRUST:
        trust = F.when(_plain(F.col("indexing_status")) == state, t).otherwise(trust)
    trust = F.when(F.col("is_quarantined"), trust * 0.1).otherwise(trust)
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), is_filled(f, F.col(f)).alias("filled")) for f in FIELDS])
    own = images.select("id", "created_at", "indexing_status", "is_quarantined", *FIELDS)
    rows = own.join(groups.select("id", "group_id"), "id").select("group_id", "id", "created_at", trust.alias("trust"), F.explode(cells).alias("cell"))
    return rows.select("group_id", "id", "created_at", "cell.field", "cell.value", _plain(F.col("cell.value")).alias("key"), "cell.filled", "trust")


def elect(votes: DataFrame, by: list[str], candidate: str, order: list[Column], payload: list[Column]) -> DataFrame:
    """Candidate with the most votes within ``by``; ``order`` ranks, the first column most."""
    return votes.groupBy(*by).agg(F.max_by(F.struct(F.col(candidate), *payload), F.struct(*order)).alias("won"))


def surviving_rows(long: DataFrame) -> DataFrame:
    """(group_id, image_id): the row with the most filled fields, then the latest, then the smallest id."""
    votes = long.groupBy("group_id", "id").agg(F.sum(F.col("filled").cast("int")).alias("votes"), F.max("created_at").alias("created_at"))
    won = elect(votes, ["group_id"], "id", [F.col("votes"), F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(-(1 << 62))), -F.col("id")], [])
    return won.select("group_id", F.col("won.id").alias("image_id"))


def merged_records(long: DataFrame) -> DataFrame:
    """One record per group: group_id and the elected value of every field (null if no row fills it).

    Equal vote sums go to the value seen last, then to the smaller normalised
    value; the spelling shown is the one of the smallest row id.
    """
    newest = long.groupBy("group_id").agg(F.max("created_at").alias("newest"))
    age = F.datediff(F.col("newest").cast("date"), F.col("created_at").cast("date")).cast("double")
    weight = F.col("trust") * F.coalesce(F.pow(F.lit(2.0), -age / HALF_LIFE_DAYS), F.lit(0.0))
    votes = long.where("filled").join(newest, "group_id").groupBy("group_id", "field", "key").agg(F.sum(weight).alias("votes"), F.max("created_at").alias("seen"), F.min_by("value", "id").alias("value"))
    seen = F.coalesce(F.unix_micros(F.col("seen").cast("timestamp")), F.lit(-(1 << 62)))
    best = F.min_by("value", F.struct(-F.round("votes", 12), -seen, F.col("key"))).alias("value")
    wins = votes.groupBy("group_id", "field").agg(best)
    wide = wins.groupBy("group_id").pivot("field", list(FIELDS)).agg(F.first("value"))
    return long.select("group_id").distinct().join(wide, "group_id", "left")
