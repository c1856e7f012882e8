"""Operators on small inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paperloom.operators import instructions as I, lexical as L, postings as P, predicates as Q, ranking as R, records as C

DOCS = [(1, "Invoice of the State Bank of India, total amount due"), (2, "Bank of India state office"), (3, None), (4, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def test_phrase(docs):
    assert [r.doc_id for r in P.phrase_search(docs, "state bank").collect()] == [1]
    assert {r.doc_id for r in P.phrase_search(docs, "Bank of India").collect()} == {1, 2}
    assert P.phrase_search(docs, "").count() == 0 and P.phrase_search(docs, "submarine").count() == 0


def test_proximity(docs):
    assert [(r.doc_id, r.min_distance) for r in P.proximity_search(docs, "total", "due", 3).collect()] == [(1, 2)]


def test_statistics_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.statistics(empty).first().vocabulary == 0


def test_exact_and_fuzzy(spark):
    rows = spark.createDataFrame([(1, "x.jpg", "VENUE YASHLAWNS OCT 15", None, False), (2, "y.jpg", "University admission notice 2026", None, None), (3, None, None, None, False)], "id long, image_name string, extracted_text string, qr_payload string, is_quarantined boolean")
    assert {r.id: r.score for r in L.exact_search(rows, "yash lawns").collect()} == {1: 1.0}
    assert L.exact_search(rows, "submarine").count() == 0
    assert [r.id for r in L.fuzzy_search(rows, "universty admision").collect()] == [2]
    got = {r.id: r.is_exact for r in L.unified_search(rows, "admission").collect()}
    assert got[2] is True
    assert [r.id for r in L.keyword_scan(rows, "NOTICE").collect()] == [2]


def test_date_precision(spark):
    d = spark.createDataFrame([(1, ["2024"]), (2, ["2024-03"]), (3, ["2023-12-31"]), (4, [])], "id long, dates array<string>")
    assert {r.id for r in d.where(Q.in_date_range(F.col("dates"), "2024-02", "2024-03-15")).collect()} == {1, 2}


def test_tenants_never_see_each_other(spark):
    d = spark.createDataFrame([(1, 7), (2, 8)], "id long, user_id long")
    assert [r.id for r in d.where(Q.tenant(7)).collect()] == [1]
    assert d.where(Q.tenant(None)).count() == 0 and d.where(Q.tenant(-1)).count() == 0 and d.where(Q.tenant(7, True)).count() == 2


def test_upsert_and_patch(spark):
    old = spark.createDataFrame([(1, "a", "old", "qr")], "id long, image_path string, image_name string, qr_payload string")
    new = spark.createDataFrame([(None, "a", "new", ""), (9, "b", "b", None)], old.schema)
    got = {r.image_path: r for r in C.upsert(old, new).collect()}
    assert got["a"].image_name == "new" and got["a"].qr_payload == "qr" and got["a"].id == 1 and got["b"].id == 9
    p = C.patch(old, spark.createDataFrame([(1, "")], "id long, image_name string"), ("image_name",)).first()
    assert p.image_name == "old"


def test_edges_and_cascade(spark):
    e = spark.createDataFrame([(1, 2, "t", "x"), (1, 2, "t", "x"), (3, 3, "t", "y")], "source_image_id long, target_image_id long, relationship_type string, evidence string")
    assert C.both_directions(e).count() == 3
    assert C.cascade_delete(e, spark.createDataFrame([(2,)], "id long"), "source_image_id", "target_image_id").count() == 1


def test_transitions(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 1, "c", t, "chassis unpaid", "a"), (2, 1, "c", t + dt.timedelta(1), "chassis motor stepper_motor paid", "b")]
    moves = C.transitions(spark.createDataFrame(rows, "id long, user_id long, category string, created_at timestamp, extracted_text string, image_name string")).first()
    assert set(moves.added) == {"motor", "stepper_motor"} and moves.removed == [] and (moves.status_from, moves.status_to) == ("UNPAID", "PAID")


def test_collapse_single(spark):
    hits = spark.createDataFrame([(100, 1.0)], "id long, score double")
    got = R.collapse(hits, spark.createDataFrame([(100, 5)], "id long, canonical_id long")).first()
    assert (got.id, got.score, got.variants) == (100, 1.0, 0)


def test_bernoulli_sums_to_one(spark):
    docs = spark.createDataFrame([(1, "invoice total", "fin"), (2, "invoice", "fin"), (3, "patient doctor", "med")], "doc_id long, text string, kind string")
    words = ("invoice", "patient")
    got = {r.doc_id: (r.predicted, r.confidence) for r in R.predict_bernoulli(docs, "doc_id", R.train_bernoulli(docs, "kind", words), "kind", words).collect()}
    assert got[1][0] == "fin" and got[3][0] == "med" and 0.4 < got[1][1] <= 1.0


def test_measures(spark):
    late = [("late", i, 1.0, i == 12) for i in range(1, 16)]  # the first relevant hit stands behind the ranked places
    r = spark.createDataFrame([("q", 1, 3.0, True), ("q", 2, 2.0, False), ("q", 3, 1.0, True), *late, ("none", 1, 1.0, False)], "q string, id long, s double, relevant boolean")
    by = {m.q: m for m in R.precision_measures(r, "q").collect()}
    m = by["q"]
    assert m.ap == pytest.approx((1 + 2 / 3) / 2, abs=1e-4) and m.p5 == 0.4 and m.mrr == 1.0
    assert (by["late"].ap, by["late"].p10, by["late"].mrr) == (0.0, 0.0, pytest.approx(1 / 12, abs=1e-4)) and by["none"].mrr == 0.0


def test_graph_code(spark):
    got = spark.range(1).select(R.graph_code(F.array(*map(F.lit, "abca"))).alias("g")).first().g
    assert got == [[0, 1, 1], [1, 0, 1], [1, 1, 0]]


def test_instructions():
    c = I.parse("photo of a red car on a road, with no people and a blue sky")
    assert {"people", "person", "pedestrian"} <= set(c.exclusions) and c.colours == ["red", "blue"] and {"car", "road", "sky"} <= set(c.words)
    c = I.parse("bills from 2026 above 1000")
    assert (c.category, c.year, c.min_amount) == ("Bills & Invoices", "2026", 1000.0)
    assert I.parse_temporal("notices from march 2025")["month"] == 3
    assert I.route("", 1) == "none" and I.route("all", 1) == "browse" and I.route("42", 1) == "numeric" and I.route("bills", -1) == "none"


def test_near_groups_are_greedy(spark):
    import random

    from paperloom.operators import duplicates as D

    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(4)]

    def near():
        h = rng.choice(seeds)
        for _ in range(rng.randrange(8)):
            h ^= 1 << rng.randrange(64)
        return h

    rows = [(i, 1, None, f"{near():016x}", False) for i in range(60)] + [(100, 1, None, "n/a", False)]
    got = {r.id: r.canonical_id for r in D.near_groups(spark.createDataFrame(rows, "id long, user_id long, sha256_hash string, phash string, is_quarantined boolean")).collect()}
    first, canon, want = {}, [], {}
    for i, _, _, h, _ in rows[:-1]:
        h = int(h, 16)
        if h not in first:
            close = sorted((bin(h ^ g).count("1"), j) for g, j in canon)
            if close and close[0][0] <= 5:
                first[h] = close[0][1]
            else:
                first[h] = i
                canon.append((h, i))
        want[i] = first[h]
    assert got == want


def test_near_groups_broadcast_nothing(spark, monkeypatch):
    """However small Spark takes a table to be, none that grows with the images goes through the driver."""
    from paperloom.operators import duplicates as D

    plans, put = [], D.Scratch.put
    monkeypatch.setattr(D.Scratch, "put", lambda self, df: (back := put(self, df), plans.append(df))[0])
    images = spark.createDataFrame([(i, 1, None, f"{0x123456789abcdef0 ^ (1 << i % 7) ^ (i // 7 << 40):016x}", False) for i in range(60)], "id long, user_id long, sha256_hash string, phash string, is_quarantined boolean")
    plans += [D.near_groups(images), D.cascade(images)]
    physical = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    assert len(physical) > 5 and any("SortMergeJoin" in p for p in physical) and not any("Broadcast" in p for p in physical)
