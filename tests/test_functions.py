"""Golden values of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions import entities as E, scores as S, similarity as M, text as T


def value(spark, column, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return row.select(column.alias("v")).first().v


def test_lexical_tokens(spark):
    assert value(spark, T.lexical_tokens(F.col("t")), t="The scholarship for the admission and student") == ["scholarship", "admission", "student"]


@pytest.mark.parametrize("a,b,least", [("electrcity", "electricity", 0.85), ("scholarshp", "scholarship", 0.80)])
def test_dice_high(spark, a, b, least):
    assert value(spark, T.dice(F.lit(a), F.lit(b))) >= least


@pytest.mark.parametrize("a,b,most", [("electricity", "passport", 0.25), ("pan", "pin", 0.50)])
def test_dice_low(spark, a, b, most):
    assert value(spark, T.dice(F.lit(a), F.lit(b))) < most


@pytest.mark.parametrize("a,b", [("c0de", "code"), ("1ab", "lab"), ("8ook", "book"), ("rnodel", "model"), ("vveb", "web"), ("clean", "dean"), ("femaalic", "semaalic")])
def test_glyphs(spark, a, b):
    assert value(spark, T.glyphs(F.lit(a))) == b


@pytest.mark.parametrize("a,b,want", [("ABC", "ABC", 1.0), ("ABC", "DEF", 0.0), ("ABCD", "ABECF", 0.2216), ("ABC", "ABCD", 0.692), ("ABC", "ABCDE", 0.525), ("ABC", "ABDC", 0.469)])
def test_cross_weighted(a, b, want):
    assert M.cross_weighted_product(a, b) == pytest.approx(want, abs=0.005)


@pytest.mark.parametrize("a,b,least", [("kesariya", "resariy", 0.75), ("score", "rcore", 0.80), ("duplicate", "plicale", 0.65), ("sponsor", "esponsor", 0.85)])
def test_scan_similarity(a, b, least):
    assert M.scan_similarity(a, b) >= least


def test_osa_swaps():
    assert M.osa("ca", "abc") == 3 and M.osa("ab", "ba") == 1 and M.osa("", "abc") == 3


def test_subwords(spark):
    assert value(spark, T.subword_support(F.lit("state bank challan"), "challan")) == 1.0


def test_windows_overlap(spark):
    words = " ".join(map(str, range(460)))
    got = value(spark, T.windows(F.lit(words)))
    assert [w.split()[0] for w in got] == ["0", "200", "400"] and got[-1].split()[-1] == "459"
    assert value(spark, T.windows(F.lit(""))) == []


def test_sanitized(spark):
    got = value(spark, T.sanitized(F.lit('<script>x()</script><b onclick="y()">hi</b>')))
    assert "script" not in got and "onclick" not in got and "hi" in got and "<" not in got


def test_entities(spark):
    e = value(spark, E.entities(F.lit("Due 15th September 2026, 03/02/2025 and 2026-02-30. Rs. 1,480.00 paid to a@b.co, Roll No: 21CS045 PAN ABCPD1234E")))
    assert e.dates == ["2026-09-15", "2025-02-03"] and e.amounts == [1480.0] and e.emails == ["a@b.co"] and e.pan_numbers == ["ABCPD1234E"] and "21CS045" in e.ids


def test_hamming_and_haversine(spark):
    assert value(spark, S.hamming(F.lit("f" * 16), F.lit("0" * 16))) == 64 and value(spark, S.hamming(F.lit("0" * 15 + "1"), F.lit("0" * 16))) == 1
    km = value(spark, S.haversine(F.lit(18.5204), F.lit(73.8567), F.lit(19.0760), F.lit(72.8777)))
    assert 110 <= km <= 160


def test_power_grid(spark):
    assert value(spark, S.power_grid(F.lit(0.6923), F.lit(5.0), F.lit(0.8))) == pytest.approx(0.9933 * 0.5 + 0.6923 * 0.3 + 0.8 * 0.2, abs=0.002)


def test_boxes(spark):
    one = tuple(map(F.lit, (0.0, 0.0, 1.0, 1.0)))
    assert value(spark, S.iou(one, one)) == 1.0 and value(spark, S.iou(one, tuple(map(F.lit, (2.0, 2.0, 1.0, 1.0))))) == 0.0
    assert value(spark, S.place_name(F.lit(0.0), F.lit(0.0), F.lit(0.1), F.lit(0.1))) == "Top-Left"
    assert value(spark, F.array(*S.pad_box(F.lit(0.0), F.lit(0.3), F.lit(0.5), F.lit(1.0)))) == [0.0, 0.23, 0.55, 1.0]


@pytest.mark.parametrize("head,name,want", [(b"%PDF-1.7", "a", "pdf"), (b"\xff\xd8\xff\xe0", "a", "jpg"), (b"\x89PNG\r\n\x1a\n", "a", "png"), (b"II*\x00", "a", "tiff"), (b"PK\x03\x04", "a.docx", "docx"), (b"hello", "a.txt", "txt")])
def test_sniffed_format(spark, head, name, want):
    assert value(spark, S.sniffed_format(F.lit(bytearray(head)), F.lit(name))) == want


def test_payloads(spark):
    p = value(spark, S.payload_fields(F.lit("upi://pay?pa=papukumar@ybl&pn=Papu%20Kumar%20Chaat%20Wala&mc=5411")))
    assert p.payee == "Papu Kumar Chaat Wala" and p.provider == "PhonePe" and p.handle == "papukumar@ybl"
    assert S.tag_length_values("5903ABC6004Pune") == {"59": "ABC", "60": "Pune"}
    assert S.tag_length_values("26080004ABCD") == {"26": "0004ABCD", "26.00": "ABCD"} and S.tag_length_values("59") == {}


def test_spans_and_pages(spark):
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((5, 9), (0, 6), (7, 8))])
    assert [(s.start, s.end) for s in value(spark, S.non_overlapping(spans))] == [(0, 6), (7, 8)]
    page = value(spark, S.page_metadata(F.lit("<html><title> A  b</title><h1>Hi <b>x</b></h1></html>")))
    assert page.title == "A b" and page.h1 == "Hi x"
