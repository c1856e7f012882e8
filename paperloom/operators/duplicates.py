"""Duplicates within a tenant: the cascade of exact file, exact picture and near picture, and near-duplicate groups.

Near pictures differ in at most ``RADIUS`` of 64 bits; cut into RADIUS + 1
bands, two such hashes agree in one, so candidates come from an equi join on
(tenant, band, content).  Only distinct hashes of a tenant are joined.

Tables that grow with the input are joined by merging.  Spark judges a table
read back by its compressed files and takes exploded keys for one row each, so
by itself it broadcasts millions of rows, which the driver has to hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.plans.scratch import Scratch

RADIUS = 5


def clean_hash(c: Column, digits: int) -> Column:
    """The hash in lower case without dressing; null if it is none."""
    h = F.regexp_replace(F.regexp_replace(F.lower(c), r"\s", ""), "^0x", "")
    return F.when(h.rlike(f"^[0-9a-f]{{{digits}}}$") & (F.replace(h, F.substring(h, 1, 1), F.lit("")) != ""), h)


def as_bits(h: Column) -> Column:
    return F.shiftleft(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), 32).bitwiseOR(F.conv(F.substring(h, 9, 8), 16, 10).cast("long"))


def hashes(images: DataFrame) -> DataFrame:
    """(user_id, id, sha, bits) of visible rows."""
    return images.where("not coalesce(is_quarantined, false)").select("user_id", "id", clean_hash(F.col("sha256_hash"), 64).alias("sha"), as_bits(clean_hash(F.col("phash"), 16)).alias("bits"))


def near_pairs(reps: DataFrame) -> DataFrame:
    """(user_id, a, b, d): distinct hashes (user_id, bits, id) with 1 to RADIUS differing bits, a < b by id.

    Of ``RADIUS + 2`` segments two agree; the keys are pairs of segments, 18 or
    19 bits beside the user, so a user with very many hashes has small buckets.
    """
    edges = [round(i * 64 / (RADIUS + 2)) for i in range(RADIUS + 3)]
    part = [F.shiftrightunsigned("bits", lo).bitwiseAND((1 << (hi - lo)) - 1) for lo, hi in zip(edges, edges[1:])]
    pairs = [(i, j) for i in range(len(part)) for j in range(i + 1, len(part))]
    keys = F.array(*[F.shiftleft(F.shiftleft(F.lit(n).cast("long"), 10).bitwiseOR(part[i]), 10).bitwiseOR(part[j]) for n, (i, j) in enumerate(pairs)])
    cut = reps.select("user_id", "id", "bits", F.explode(keys).alias("key"))
    l, r = cut.alias("l"), cut.alias("r")
    d = F.bit_count(F.col("l.bits").bitwiseXOR(F.col("r.bits")))
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("user_id", "key")]
    return l.join(r.hint("merge"), [*on, F.col("l.id") < F.col("r.id"), d <= RADIUS]).select(F.col("l.user_id").alias("user_id"), F.col("l.id").alias("a"), F.col("r.id").alias("b"), d.alias("d")).distinct()


def cascade(images: DataFrame) -> DataFrame:
    """(id, match_id, match_type, similarity): the earlier row that each row repeats; the earlier tier wins, then the nearest, then the smallest id."""
    h = hashes(images)
    sha = h.where("sha is not null").groupBy("user_id", "sha").agg(F.min("id").alias("sha_first"))
    reps = h.where("bits is not null").groupBy("user_id", "bits").agg(F.min("id").alias("id"))
    near = near_pairs(reps).groupBy("b").agg(F.min(F.struct("d", "a")).alias("n")).select(F.col("b").alias("id"), F.col("n.a").alias("near_id"), F.col("n.d").alias("d"))
    j = h.join(sha.hint("merge"), ["user_id", "sha"], "left").join(reps.withColumnRenamed("id", "bits_first").hint("merge"), ["user_id", "bits"], "left").join(near.hint("merge"), "id", "left")
    by_sha, by_bits = F.col("sha_first") < F.col("id"), F.col("bits_first") < F.col("id")
    kind = F.when(by_sha, "exact_binary").when(by_bits, "exact_phash").when(F.col("near_id").isNotNull(), "near_duplicate")
    match = F.when(by_sha, F.col("sha_first")).when(by_bits, F.col("bits_first")).otherwise(F.col("near_id"))
    return j.select("id", match.alias("match_id"), kind.alias("match_type"), F.when(by_sha | by_bits, 1.0).otherwise(F.round(1 - F.col("d") / 64.0, 4)).alias("similarity")).where("match_type is not null")


def near_groups(images: DataFrame) -> DataFrame:
    """(id, canonical_id): hashes in id order each join the nearest earlier canonical hash (the smaller id on ties) or become one.

    The order is resolved without a loop over rows: a hash is canonical if none
    of its smaller neighbours is; every round decides the hashes whose smaller
    neighbours are all decided or one of which is canonical.  Hashes without
    neighbours take no part.
    """
    scratch = Scratch(images.sparkSession)
    h = hashes(images).where("bits is not null")
    reps = scratch.put(h.groupBy("user_id", "bits").agg(F.min("id").alias("id")))
    pairs = scratch.put(near_pairs(reps))
    waiting = scratch.put(pairs.select(F.col("b").alias("id")).distinct())
    decided = scratch.put(pairs.select(F.col("a").alias("id")).distinct().join(waiting.hint("merge"), "id", "left_anti").select("id", F.lit(True).alias("canonical")))
    while not waiting.isEmpty():
        # of each waiting hash: whether a smaller neighbour is canonical, and whether one is still open
        seen = pairs.select("a", F.col("b").alias("id")).join(waiting.hint("merge"), "id").join(decided.select(F.col("id").alias("a"), "canonical").hint("merge"), "a", "left")
        verdict = seen.groupBy("id").agg(F.coalesce(F.bool_or("canonical"), F.lit(False)).alias("hit"), F.count_if(F.col("canonical").isNull()).alias("open"))
        now = scratch.put(verdict.where("hit or open = 0").select("id", (~F.col("hit")).alias("canonical")))
        before = decided, waiting, now
        decided = scratch.put(decided.unionByName(now))
        waiting = scratch.put(waiting.join(now.select("id").hint("merge"), "id", "left_anti"))
        scratch.drop(*before)
    canon = decided.where("canonical").select(F.col("id").alias("a"))
    nearest = pairs.join(canon.hint("merge"), "a").join(canon.select(F.col("a").alias("b")).hint("merge"), "b", "left_anti").groupBy("b").agg(F.min(F.struct("d", "a")).alias("n")).select(F.col("b").alias("rep"), F.col("n.a").alias("to"))
    rows = h.join(reps.withColumnRenamed("id", "rep").hint("merge"), ["user_id", "bits"]).join(nearest.hint("merge"), "rep", "left")
    return rows.select("id", F.coalesce("to", "rep").alias("canonical_id"))
