"""Payloads, pages, invoices, offsets, phrases, instructions, time and place: odd values too."""

from pyspark.sql import functions as F

from paperloom.functions import entities as E, payloads as Y
from paperloom.operators import documents as D, instructions as I, lexical as L, predicates as Q, ranking as R
from paperloom.plans import scratch
from paperloom.sources.tables import SCHEMAS


def value(spark, c, **columns):
    row = spark.range(1)
    for k, v in columns.items():
        row = row.withColumn(k, F.lit(v).cast("string") if v is None else F.lit(v))
    return row.select(c.alias("v")).first().v


def test_tag_length_values(spark):
    read = lambda p: [tuple(x) for x in value(spark, Y.opened(Y.tag_length_values(F.col("p"))), p=p)]
    assert read("000201") == [("00", "01")]
    assert read("00020126110002AB0101x5903abc") == [("00", "01"), ("26", "0002AB0101x"), ("26.00", "AB"), ("26.01", "x"), ("59", "abc")]
    assert read("") == [] and read("59") == [] and read("59xx") == [] and read("5909ab") == [] and read("5900") == [("59", "")]
    assert value(spark, Y.tag_length_values(F.col("p")), p=None) is None


def test_contacts_and_addresses(spark):
    card = value(spark, Y.contact_fields(F.col("p")), p="MECARD:N:Ana Li;ORG:Acme;TEL:123;;")
    assert tuple(card) == ("Ana Li", "Acme", "123")
    card = value(spark, Y.contact_fields(F.col("p")), p="BEGIN:VCARD\r\nFN:Ana Li\r\nTEL;TYPE=HOME:5\r\nEND:VCARD")
    assert tuple(card) == ("Ana Li", None, "5")
    assert tuple(value(spark, Y.contact_fields(F.col("p")), p="text")) == (None, None, None)
    assert value(spark, Y.url_words(F.col("p")), p="https://a.example/pay/bill-42?x=1") == ["pay", "bill", "42"]
    assert value(spark, E.urls(F.col("p")), p="see https : // a.example/x, WWW.B.example and HTTPS://A.EXAMPLE/x or shop . com; scan.pdf") == ["https://a.example/x", "https://B.example", "https://shop.com"]


def test_invoice(spark):
    v = value(spark, D.invoice(F.col("p")), p="Paid by UPI\nCGST: Rs. 9.00 SGST 9\nGrand Total: Rs. 1,218.50")
    assert (v.mode, v.total, v.cgst, v.sgst, v.igst, v.total_tax) == ("UPI / QR", 1218.5, 9.0, 9.0, 0.0, 18.0)
    assert tuple(value(spark, D.invoice(F.col("p")), p="")) == ("UNKNOWN", 0.0, 0.0, 0.0, 0.0, 0.0)
    items = value(spark, Y.line_items(F.col("p")), p="Tea cups 120.50\r\nab 5\nTotal 125\n\nSoap 1,000\nnothing")
    assert [tuple(i) for i in items] == [("Tea cups", 120.5), ("Soap", 1000.0)]
    assert value(spark, E.amounts(F.col("p")), p="Rs 5, Rs. 5/- Fee: 120 Total 2025 Paid 3") == [5.0, 120.0]


def test_offsets_and_phrases(spark):
    assert value(spark, Y.all_offsets(F.col("p"), "aa"), p="aAaa b") == [0, 1, 2]
    assert value(spark, Y.all_offsets(F.col("p"), "long"), p="ab") == [] and value(spark, Y.all_offsets(F.col("p"), ""), p="ab") == []
    p = F.array(*[F.struct(F.lit(s).alias("score"), F.lit(t).alias("phrase")) for s, t in ((1.0, "bill"), (3.0, "water bill"), (2.0, "pump"), (2.0, "pump house"))])
    assert value(spark, Y.subsumed(p)) == ["water bill", "pump house"] and value(spark, Y.subsumed(p, 1)) == ["water bill"]
    assert [value(spark, Y.is_text(F.lit(b)).alias("x")) for b in (b"abc \xc3\xa9", b"", b"a\x00b", b"\xff\xfe")] == [True, False, False, False]


IMAGES = "id long, image_name string, extracted_text string, category string, visual_metadata string, is_quarantined boolean, indexing_status string"


def test_instruction_search(spark):
    rows = [
        (1, "bill 2024.png", "Unpaid electricity bill of Rs 900", "bill", None, False, "completed"), (2, "x", "Unpaid bill 2024, Rs 900, with stamp", "bill", None, None, "completed"),
        (3, "x", "unpaid bill 2024 amount 12", "bill", '{"objects": ["seal"]}', False, "completed"), (4, "x", "unpaid bill 2024 amount 5", "bill", "{broken", False, "completed"), (5, None, None, None, None, True, None),
    ]
    images = spark.createDataFrame(rows, IMAGES)
    c = I.parse("find unpaid bills above 100 from 2024 without stamp")
    assert (c.category, c.year, c.min_amount, c.status) == ("Bills & Invoices", "2024", 100.0, "UNPAID") and {"stamp", "seal"} <= set(c.exclusions)
    assert {r.id: r.term for r in I.suppressed(images, c).collect()} == {2: "stamp", 3: "seal"}
    got = I.search(images, c).collect()
    assert {r.id for r in got} == {1, 4} and all(r.satisfied == ["year:2024", "category:Bills & Invoices"] and r.share == 1.0 for r in got)
    assert I.search(images, I.parse("")).count() == 4 and I.search(images.limit(0), c).count() == 0
    guard = images.where(Q.number_guard("2024", F.lit(0.1)))
    assert {r.id for r in guard.collect()} == {1, 2, 3, 4} and images.where(Q.number_guard("77", F.lit(0.6))).count() == 4


def test_time_and_place(spark):
    when = I.parse_temporal("latest notices of 5/3/2024")
    assert when["date"] == "2024-03-05" and when["relative"] == "recent" and when["text"] == "notices of"
    fit = lambda q, own, dates=(): value(spark, I.temporal_fit(I.parse_temporal(q), F.lit(own), F.array(*map(F.lit, dates)).cast("array<string>"), F.lit(True)))
    assert [fit("2024-03-05", x) for x in ("2024-03-05", "2023-01-01", "")] == [1.0, 0.0, 0.3]
    assert [fit("march 2024", x) for x in ("2024-03", "2024-04", "")] == [1.0, 0.0, 0.4] and fit("march", "2020-03-01") == 1.0 and fit("2024", "", ("2024-01",)) == 1.0
    assert fit("recent bills", "") == 0.9 and fit("bills", "") == 0.5
    rows = spark.createDataFrame([(1, "office in Mumbai", "a"), (2, "Delhi", "b"), (3, None, "pune.png"), (4, None, None)], "id long, extracted_text string, image_name string")
    assert {r.id: r.city for r in R.within_radius(rows, 18.5204, 73.8567, 200.0).collect()} == {1: "mumbai", 3: "pune"}


def test_answers(spark):
    rows = spark.createDataFrame([(1, "Hello there all. Amount payable is due"), (2, "amuont only here"), (3, None), (4, "")], "id long, extracted_text string").withColumn("is_quarantined", F.lit(False))
    got = L.answers(rows, ("amount", "payable"), 3).collect()
    assert [r.id for r in got] == [1] and got[0].sentence == "Amount payable is due" and 0.15 < got[0].confidence <= 0.98


def test_scratch_is_swept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_folder", lambda _: str(tmp_path))
    s = scratch.Scratch(spark)
    kept = s.put(spark.range(3))
    assert scratch.sweep(spark, 1.0) == 0 and kept.count() == 3
    s.drop(kept)
    assert scratch.sweep(spark, -1.0) == 1 and scratch.sweep(spark, -1.0) == 0


def test_schemas_fit_the_tables(spark):
    import os

    folder = "/root/testdata/sf0.001"
    for name, ddl in SCHEMAS.items() if os.path.isdir(folder) else ():
        assert spark.read.parquet(f"{folder}/{name}.parquet").schema.simpleString() == spark.createDataFrame([], ddl).schema.simpleString()
