"""Changes of records as data frames: upserts, patches, edges, cascades, duplicates, links, timelines, graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperloom.functions import entities as E

# Objects and states that timelines follow.
OBJECTS = ("motor", "stepper_motor", "arduino", "breadboard", "sensor", "chassis", "battery", "wire", "lcd", "display", "wheel", "camera", "watermark", "signature", "stamp", "receipt", "bill", "meter")
STATES = (("UNPAID", ("unpaid", "due", "pending", "overdue")), ("PAID", ("paid", "cleared", "settled", "transaction successful")), ("SIGNED", ("notarized", "signed by", "principal sign")), ("UNSIGNED", ("draft", "unsigned", "pending signature")))


def upsert(old: DataFrame, new: DataFrame, key: str = "image_path", keep: tuple[str, ...] = ("qr_payload",)) -> DataFrame:
    """New rows replace old ones of the same key; columns of ``keep`` stay if the new value is blank; ``id`` stays."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    isnew = F.col(f"n.{key}").isNotNull()

    def pick(c: str) -> Column:
        fresh = F.col(f"n.{c}")
        if c in keep:
            return F.coalesce(F.nullif(F.trim(fresh), F.lit("")), F.col(f"o.{c}"))
        return F.when(isnew, fresh).otherwise(F.col(f"o.{c}")) if c != "id" else F.coalesce(F.col("o.id"), F.col("n.id"))

    return joined.select(*[pick(c).alias(c) for c in old.columns])


def patch(old: DataFrame, changes: DataFrame, columns: tuple[str, ...], key: str = "id") -> DataFrame:
    """Columns are overwritten where the change is neither null, blank nor zero."""
    c = changes.select(key, *[F.col(x).alias(f"new_{x}") for x in columns])
    given = lambda x: F.when(F.trim(F.col(f"new_{x}").cast("string")).isin("", "0", "0.0"), None).otherwise(F.col(f"new_{x}"))
    return old.join(c, key, "left").select(*[F.coalesce(given(x), F.col(x)).alias(x) if x in columns else F.col(x) for x in old.columns])


def latest(log: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Last row of each key of an append-only log."""
    everything = F.struct(*log.columns)
    return log.groupBy(key).agg(F.max_by(everything, F.struct(*order)).alias("row")).select("row.*")


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents that occur in ``new`` are replaced."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def both_directions(edges: DataFrame) -> DataFrame:
    """Distinct (source, target, type, evidence) of the edges and their reverses; loops once."""
    e = edges.select("source_image_id", "target_image_id", "relationship_type", "evidence")
    r = e.where("source_image_id <> target_image_id").select(F.col("target_image_id").alias("source_image_id"), F.col("source_image_id").alias("target_image_id"), "relationship_type", "evidence")
    return e.unionByName(r).distinct()


def cascade_delete(rows: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """Rows none of whose keys is a deleted id."""
    for k in keys:
        rows = rows.join(gone.select(F.col("id").alias(k)), k, "left_anti")
    return rows


def canonical(images: DataFrame) -> Column:
    return F.coalesce("canonical_image_id", "id")


def duplicate_statistics(images: DataFrame) -> DataFrame:
    """Counts by canonical group: groups, duplicates, largest group, by match type."""
    g = images.select(canonical(images).alias("c"), "id", F.regexp_replace(F.lower(F.trim("duplicate_match_type")), "-", "_").alias("kind"))
    per = g.groupBy("c").agg(F.count("*").alias("n"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("exact_binary", "exact_phash", "near_duplicate")])
    return per.agg(F.count("*").alias("n_groups"), F.count_if(F.col("n") > 1).alias("n_dup_groups"), F.max("n").alias("largest"), *[F.sum(k).alias(k) for k in ("exact_binary", "exact_phash", "near_duplicate")])


def exact_duplicates(images: DataFrame, column: str = "sha256_hash", digits: int = 64) -> DataFrame:
    """(user_id, hash, canonical_id, n): rows of a tenant with one hash, the smallest id stands for them."""
    h = F.regexp_replace(F.regexp_replace(F.lower(F.col(column)), r"\s", ""), "^0x", "")
    good = h.rlike(f"^[0-9a-f]{{{digits}}}$") & (F.replace(h, F.substring(h, 1, 1), F.lit("")) != "")
    rows = images.where("not coalesce(is_quarantined, false)").select("user_id", "id", h.alias("hash")).where(good)
    return rows.groupBy("user_id", "hash").agg(F.min("id").alias("canonical_id"), F.count("*").alias("n")).where("n > 1")


def shared_identifiers(images: DataFrame) -> DataFrame:
    """(user_id, value, hub_id, id, rel_type): rows of a tenant that share an identifier, each linked to the smallest id.

    A star per identifier instead of all pairs: linear in the rows, the same groups.
    """
    ids = images.where("not coalesce(is_quarantined, false)").select("user_id", "id", F.explode(E.strong_identifiers(F.col("extracted_text"))).alias("s")).select("user_id", "id", F.upper("s.value").alias("value"), "s.rel_type")
    hubs = ids.groupBy("user_id", "value").agg(F.min("id").alias("hub_id"), F.max("id").alias("last")).where("hub_id < last").drop("last")
    return ids.join(hubs, ["user_id", "value"]).where("id <> hub_id").select("user_id", "value", "hub_id", "id", "rel_type").distinct()


def related(edges: DataFrame, images: DataFrame) -> DataFrame:
    """(source_id, target_id, relationship_type, confidence, reason): visible targets of the same tenant, ends resolved to their canonical."""
    i = images.where("not coalesce(is_quarantined, false)").select("id", "user_id", F.coalesce("canonical_image_id", "id").alias("c"))
    s = i.select(F.col("id").alias("source_image_id"), F.col("user_id").alias("su"), F.col("c").alias("source_id"))
    t = i.select(F.col("id").alias("target_image_id"), F.col("user_id").alias("tu"), F.col("c").alias("target_id"))
    kind = F.lower(F.regexp_replace(F.trim("relationship_type"), "[ -]", "_"))
    rows = edges.join(s, "source_image_id").join(t, "target_image_id").where("su = tu and source_id <> target_id")
    best = rows.groupBy("source_id", "target_id", kind.alias("relationship_type")).agg(F.max("confidence_score").alias("confidence"))
    return best.withColumn("reason", F.initcap(F.replace("relationship_type", F.lit("_"), F.lit(" "))))


def state(text: Column, name: Column) -> tuple[Column, Column]:
    """(objects, status) of a record."""
    low = F.lower(F.coalesce(text, F.lit("")))
    file = F.lower(F.coalesce(name, F.lit("")))
    objects = F.filter(F.array(*map(F.lit, sorted(OBJECTS))), lambda o: low.contains(o) | file.contains(o))
    status = F.lit("UNKNOWN")
    for s, words in reversed(STATES):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        status = F.when(hit, s).otherwise(status)
    return objects, status


def transitions(images: DataFrame, by: tuple[str, ...] = ("user_id", "category")) -> DataFrame:
    """(id, previous_id, added, removed, status_from, status_to): change to the record before, per tenant and category in time order."""
    objects, status = state(F.col("extracted_text"), F.col("image_name"))
    rows = images.select(*by, "id", "created_at", objects.alias("objects"), status.alias("status"))
    before = F.lag(F.struct("id", "objects", "status")).over(Window.partitionBy(*by).orderBy("created_at", "id"))
    moved = rows.withColumn("b", before).where("b is not null")
    return moved.select("id", F.col("b.id").alias("previous_id"), F.array_except("objects", "b.objects").alias("added"), F.array_except("b.objects", "objects").alias("removed"), F.col("b.status").alias("status_from"), F.col("status").alias("status_to"))


def change_scores(moves: DataFrame, query: str) -> DataFrame:
    """(id, score): .8 for an object of the query that came or went, .9 for a settled payment, .2 for each further word, at most 1."""
    words = query.lower().split()
    touched = F.exists(F.concat("added", "removed"), lambda o: F.array_contains(F.array(*map(F.lit, words)), o))
    paid = (F.col("status_from") != F.col("status_to")) & (F.col("status_to") == "PAID") & F.lit("payment" in words or "paid" in words)
    text = F.lower(F.concat_ws(" ", F.array_join("added", " "), F.array_join("removed", " "), "status_to"))
    extra = sum(text.contains(w).cast("int") for w in words) * 0.2
    score = F.least(F.lit(1.0), touched.cast("int") * 0.8 + paid.cast("int") * 0.9 + extra)
    return moves.select("id", F.round(score, 4).alias("score")).where("score > 0")


def entity_graph(images: DataFrame) -> DataFrame:
    """(source, target, edge): records to the entities that at least two records of the tenant mention."""
    m = images.select("user_id", "id", F.explode(E.strong_identifiers(F.col("extracted_text"))).alias("s")).select("user_id", "id", F.concat_ws(":", "s.rel_type", F.lower("s.value")).alias("entity"), F.concat(F.lit("HAS_"), F.upper(F.replace("s.rel_type", F.lit("shared_"), F.lit("")))).alias("edge")).distinct()
    common = m.groupBy("user_id", "entity").agg(F.count("*").alias("n")).where("n >= 2").drop("n")
    return m.join(common, ["user_id", "entity"]).select(F.col("id").alias("source"), F.col("entity").alias("target"), "edge")


def known_names(wanted: DataFrame, images: DataFrame) -> DataFrame:
    """(name, known): whether a file name is there already, or its stem is the stem of one or what stands before its last _."""
    full = lambda c: F.concat(F.lit("="), F.lower(F.trim(c)))
    stem = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\.[a-z0-9]+$", "")
    before = F.when(F.col("image_name").contains("_"), F.regexp_replace(F.lower(F.trim("image_name")), "_[^_]*$", ""))
    keys = F.array_compact(F.array(full(F.col("image_name")), stem(F.col("image_name")), before, stem(before)))
    have = images.where("image_name is not null").select(F.explode(F.array_distinct(keys)).alias("key")).distinct().withColumn("known", F.lit(True))
    w = wanted.where("name is not null").select("name", F.explode(F.array(full(F.col("name")), stem(F.col("name")))).alias("key"))
    return w.join(have, "key", "left").groupBy("name").agg(F.coalesce(F.bool_or("known"), F.lit(False)).alias("known"))
