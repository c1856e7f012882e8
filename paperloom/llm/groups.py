"""Consolidating pairwise matches into groups (problem 4).

Connected components by low-diameter decomposition.  On every level each
vertex draws a shift from an exponential distribution (cut off at ``ROUNDS``)
and clusters grow from their centres, the earliest start first, for ``ROUNDS``
steps of one edge each (vertices with a single neighbour start last).  Clusters are contracted to super-vertices, the edges
between clusters form the next level's graph, and the assignments of all
levels are composed from the top down.  A level keeps a constant share of the
vertices in expectation, stars and chains alike, so the work is a geometric
sum and the number of levels grows with the logarithm of the largest group.

Nothing is collected or broadcast: every level is a table in the shared folder.
Growing a cluster is a merge join on the vertex, which streams the edges of a
hot vertex past its one row of state, and a minimum per vertex, which combines
map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paperloom.plans.scratch import Scratch

BETA = 0.5
ROUNDS = 4


def _edges(pairs: DataFrame) -> DataFrame:
    """Distinct undirected edges (a < b) without loops and nulls."""
    a, b = (F.col(c).cast("long") for c in pairs.columns[:2])
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), (a.isNotNull() & b.isNotNull() & (a != b)).alias("ok")).where("ok").select("a", "b").distinct()


def decompose(edges: DataFrame) -> DataFrame:
    """One low-diameter decomposition of (a, b, level): (id, centre) for every vertex.

    A vertex with one neighbour starts last, so the neighbour absorbs it (of
    two such vertices the smaller id absorbs the other).  The level is data, not
    a literal, so every level runs the same compiled code.  A round reads the
    state once, for staying and for reaching, so the plan grows with the rounds
    and does not double in each.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "level").unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v"), "level"))
    draw = (F.xxhash64("level", "u").bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    start = F.greatest(ROUNDS + F.log(draw) / BETA, draw * 1e-6)
    start = F.when(F.col("n") > 1, start).otherwise(F.lit(2.0 * ROUNDS) + F.when(F.col("u") < F.col("low"), 0.0).otherwise(2.0))
    state = both.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.first("level").alias("level")).select("u", start.alias("at"), F.col("u").alias("centre"))
    stays, reached = F.struct("u", "at", "centre"), F.struct(F.col("v").alias("u"), (F.col("at") + 1.0).alias("at"), "centre")
    for _ in range(ROUNDS):
        offers = both.join(state.hint("merge"), "u").select(F.explode(F.array(stays, reached)).alias("offer")).select("offer.*")
        state = offers.groupBy("u").agg(F.min_by("centre", "at").alias("centre"), F.min("at").alias("at")).select("u", "at", "centre")
    return state.select(F.col("u").alias("id"), "centre")


def components(pairs: DataFrame) -> DataFrame:
    """Group of every id that some pair links to another id.

    ``pairs``: its first two columns are the ends, other columns are ignored.
    Returns (id, group_id), one row per id; group_id is the smallest id of the
    group.  Null ends and loops link nothing, repeated and reversed pairs count
    once, an empty input gives an empty result.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark)
    edges, levels = scratch.put(_edges(pairs).withColumn("level", F.lit(0))), []
    while not edges.isEmpty():
        assigned = scratch.put(decompose(edges))
        left, right = assigned.select(F.col("id").alias("a"), F.col("centre").alias("ca")), assigned.select(F.col("id").alias("b"), F.col("centre").alias("cb"))
        crossing = edges.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), (F.col("level") + 1).alias("level"))
        smaller = scratch.put(crossing.distinct())
        scratch.drop(edges)
        levels.append(assigned)
        edges = smaller
    if not levels:
        return spark.createDataFrame([], "id long, group_id long")
    top = levels.pop()
    for n, lower in enumerate(reversed(levels), 1):
        up = top.select(F.col("id").alias("centre"), F.col("centre").alias("higher"))
        top = lower.join(up.hint("merge"), "centre", "left").select("id", F.coalesce("higher", "centre").alias("centre"))
        if n % 4 == 0:
            top = scratch.put(top)
    top = scratch.put(top)
    smallest = top.groupBy("centre").agg(F.min("id").alias("group_id"))
    return top.join(smallest.hint("merge"), "centre").select("id", "group_id")


def image_links(images: DataFrame, relationships: DataFrame) -> DataFrame:
    """Pairs of different existing images from duplicate pointers and relationship rows."""
    ids = images.select(F.col("id").alias("known")).where("known is not null").distinct().hint("merge")
    pointers = images.select(F.col("id").alias("x"), F.col("canonical_image_id").cast("long").alias("y"))
    rows = relationships.select(F.col("source_image_id").cast("long").alias("x"), F.col("target_image_id").cast("long").alias("y"))
    pairs = _edges(pointers.unionAll(rows))
    return pairs.join(ids, F.col("a") == F.col("known"), "left_semi").join(ids, F.col("b") == F.col("known"), "left_semi")


def image_groups(images: DataFrame, relationships: DataFrame) -> DataFrame:
    """(group_id, image_id) of every image in a group of two or more."""
    return components(image_links(images, relationships)).select("group_id", F.col("id").alias("image_id"))
