from paperloom.functions import scores as S
from paperloom.sources import files


def test_files_and_encoders(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.bin").write_bytes(b"\x89PNG\r\n\x1a\n")
    got = {r.name: (r.file_format, r.file_size_bytes) for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": ("pdf", 10), "b.bin": ("png", 8)}
    rows = spark.createDataFrame([(1, "water pump bill"), (2, None), (3, "water pump bill")], "id long, text string")
    v = files.encoded(rows, "id", "text", files.hashing_encoder(16))
    assert v.where("vector is null").count() == 1
    a, b = v.where("id = 1").select("vector"), v.where("id = 3").selectExpr("vector as other")
    assert abs(a.crossJoin(b).select(S.cosine(a.vector, b.other).alias("c")).first().c - 1.0) < 1e-6


def test_sink(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, kind string")
    files.write_partitioned(rows, str(tmp_path / "out"), "kind")
    assert spark.read.parquet(str(tmp_path / "out")).where("kind = 'a'").count() == 2


def test_model_interface(spark):
    rows = spark.createDataFrame([(1,), (2,)], "id long")
    assert files.applied(rows, lambda b: b.assign(width=b.id * 10), "id long, width long").agg({"width": "sum"}).first()[0] == 30
