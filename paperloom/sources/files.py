"""Files as a source, pluggable encoders of text or pixels, and sinks.

Recognition, captions and vectors need models that are not part of this
engine: a model enters as a plain function over a batch of values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.functions.scores import sniffed_format


def scan_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, name, file_size_bytes, file_modified_at, file_format, sha256_hash, content) of the files under a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.col("length").alias("file_size_bytes"), F.col("modificationTime").alias("file_modified_at"), sniffed_format(F.col("content"), name).alias("file_format"), F.sha2("content", 256).alias("sha256_hash"), "content")


def encoded(rows: DataFrame, key: str, value: str, encoder: Callable[[list], list[list[float]]]) -> DataFrame:
    """(key, vector) of any encoder over batches of values; null values give null vectors."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(1).to_pylist()
            there = [v for v in values if v is not None]
            made = iter(encoder(there) if there else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if v is None else next(made) for v in values], pa.list_(pa.float32()))], [key, "vector"])

    return rows.select(key, value).mapInArrow(run, f"`{key}` {kind}, vector array<float>")


def applied(rows: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Any model over pandas batches: recognition, detection, captions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield model(b)

    return rows.mapInPandas(run, schema)


def hashing_encoder(width: int = 64) -> Callable[[list], list[list[float]]]:
    """A deterministic encoder for tests: signed counts of hashed words, normalised."""
    import zlib

    def encode(texts: list) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * width
            for w in str(t).lower().split():
                h = zlib.crc32(w.encode())
                v[h % width] += 1.0 if h & 1 << 20 else -1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out

    return encode


def write_partitioned(rows: DataFrame, path: str, by: str | None = None, mode: str = "overwrite") -> None:
    """Parquet sink, partitioned by a column of few values and clustered by it so that each value has few files."""
    if by:
        rows.repartition(by).write.mode(mode).partitionBy(by).parquet(path)
    else:
        rows.write.mode(mode).parquet(path)
