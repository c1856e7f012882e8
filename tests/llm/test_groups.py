"""Problems 1, 3 and 4 against brute force and on awkward input."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from paperloom.llm import groups, increments, survivor

IMAGES = "id long, canonical_image_id long, user_id long, sha256_hash string, phash string, is_quarantined boolean, created_at timestamp, indexing_status string, extracted_text string, category string, blip_caption string, qr_payload string, primary_date string, exif_created_at string, entities_json string, file_format string, image_width double, group_id long, known string"


def brute(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "pairs", "cycle", "dirty"])
def test_components(spark, kind):
    rng = random.Random(3)
    pairs = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(260)],
        "chain": [(i, i + 1) for i in range(400)],
        "star": [(7, i) for i in range(500)],
        "pairs": [(2 * i, 2 * i + 1) for i in range(100)],
        "cycle": [(i, (i + 1) % 50) for i in range(50)],
        "dirty": [(1, 1), (None, 2), (3, None), (4, 5), (5, 4), (4, 5), (-1, 5)],
    }[kind]
    got = groups.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.id: r.group_id for r in got} == brute(pairs) and len(got) == len({r.id for r in got})


def test_components_empty(spark):
    assert groups.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_make_a_plan_in_proportion(spark):
    """Each round reads the state of the round before once; read twice, the plan doubles every round and fills the driver."""
    edges = groups._edges(spark.createDataFrame([(7, i) for i in range(500)], "a long, b long")).withColumn("level", F.lit(0))
    plan = groups.decompose(edges)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == groups.ROUNDS and "Broadcast" not in plan
    assert plan.count("HashAggregate") + plan.count("SortAggregate") < 10 * (groups.ROUNDS + 1)


def row(i, canonical=None, user=1, sha=None, ph=None, quarantined=False, at=None, text=None, width=None, category=None, entities=None):
    return (i, canonical, user, sha, ph, quarantined, at, None, text, category, None, "-", "0000-00-00", " ", entities, "N/A", width, 99, "x")


def test_survivors(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [
        row(1, None, text="a", at=t), row(2, 1, text="b", category="c", at=t), row(3, 2, text="b", width=0.0, entities="{ }", at=t),  # 2 is fullest
        row(10, 10, text="a", at=t), row(11, 10, text="b", at=t + dt.timedelta(1)),  # tie: the latest
        row(20, 21, text="x"), row(21, 20, text="x"),  # tie without times: the smallest, in a cycle
        row(30, 777, text="alone"),
    ]
    images = spark.createDataFrame(rows, IMAGES)
    long = survivor.unpivoted(images, survivor.pointer_groups(images))
    assert {(r.group_id, r.image_id) for r in survivor.surviving_rows(long).collect()} == {(1, 2), (10, 11), (20, 20)}
    records = {r.group_id: r for r in survivor.merged_records(long).collect()}
    assert records[1].extracted_text == "b" and records[1].category == "c" and records[1].qr_payload is None and records[1].entities_json is None


def test_survivors_empty(spark):
    images = spark.createDataFrame([], IMAGES)
    long = survivor.unpivoted(images, survivor.pointer_groups(images))
    assert survivor.surviving_rows(long).count() == 0 and survivor.merged_records(long).count() == 0


def hexes(n):
    return f"{n:016x}"


def test_uploads(spark):
    base = 0x0123456789ABCDEF
    sha = "ab" * 31 + "cd"
    images = spark.createDataFrame([row(1, user=1, sha=sha, ph=hexes(base)), row(2, user=2, ph=hexes(base), quarantined=True), row(3, user=1, sha="f" * 64, ph="0" * 16)], IMAGES)
    ups = [
        (1, 1, 1, "0x" + sha.upper(), None), (2, 1, 1, None, hexes(base ^ 0b11111)), (3, 1, 1, None, hexes(base ^ 0b111111)), (4, 1, 2, None, hexes(base)),
        (5, 1, 2, None, " " + hexes(base ^ 1 << 63).upper()), (6, 1, 1, "f" * 64, "0" * 16), (7, 1, 1, "n/a", ""), (4, 2, 2, None, hexes(base)), (8, 1, None, sha, hexes(base)),
    ]
    uploads = spark.createDataFrame(ups, "upload_id long, batch_id long, user_id long, sha256_hash string, phash string")
    assert {r.upload_id for r in increments.duplicate_uploads(images, uploads).collect()} == {1, 2, 3, 5}  # 3 is within one bit of upload 2
    assert increments.duplicate_uploads(images, uploads.limit(0)).count() == 0


def test_uploads_by_brute_force(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(12)]

    def near():
        h = rng.choice(seeds)
        for _ in range(rng.randrange(9)):
            h ^= 1 << rng.randrange(64)
        return h

    old = [(0, near()) for _ in range(40)]
    new = [(i, near()) for i in range(1, 160)]
    images = spark.createDataFrame([row(i, ph=hexes(h)) for i, (_, h) in enumerate(old)], IMAGES)
    uploads = spark.createDataFrame([(i, 1, 1, None, hexes(h)) for i, h in new], "upload_id long, batch_id long, user_id long, sha256_hash string, phash string")
    want = {i for i, h in new if any((j < i) and bin(h ^ g).count("1") <= 5 for j, g in [(-1, g) for _, g in old] + new)}
    assert {r.upload_id for r in increments.duplicate_uploads(images, uploads).collect()} == want
