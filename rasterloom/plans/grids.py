"""Small images derived from the driver's tables, and the same relations as SQL.

tile: an embedding's 64 values as an 8x8 plane of bytes. argb: each pixel of a tile takes its
alpha, red, green and blue from the plane's bytes 0, 1, 2 and 3 places on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, px: array of 64 bytes as int."""
    byte = lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((v.cast("double") + 1) * 127.5))).cast("int")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", byte).alias("px"))


def placed(df: DataFrame, n: int = SIDE * SIDE, width: int = SIDE) -> DataFrame:
    """One row for each place p = y * width + x."""
    return df.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("y", F.expr(f"p div {width}").cast("int")).withColumn("x", F.col("p") % width)


def pixel(px: Column | str, p: Column | int) -> Column:
    return F.get(px, p if isinstance(p, Column) else F.lit(p))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, p, y, x, a, r, g, b, and px."""
    df = placed(tiles(spark, sf_dir))
    channel = lambda k: F.get("px", (F.col("p") + k) % (SIDE * SIDE))
    return df.select("vec_id", "label", "p", "y", "x", channel(0).alias("a"), channel(1).alias("r"), channel(2).alias("g"), channel(3).alias("b"), "px")


def argb_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, argb: array of 64 words as long."""
    n = SIDE * SIDE
    word = lambda v, i: sum((F.get("px", (i + k) % n).cast("long") * (1 << s) for k, s in ((1, 16), (2, 8), (3, 0))), v.cast("long") * (1 << 24))
    return tiles(spark, sf_dir).select("vec_id", "label", F.transform("px", word).alias("argb"))


def clip() -> Column:
    """Tiles of twenty successive ids are a clip's frames, in order of id."""
    return F.expr("vec_id div 20")


def per_text(spark: SparkSession, sf_dir: str, of: Callable[[np.ndarray], list], schema: str) -> DataFrame:
    """doc_id and the columns that `of` makes, as arrays of one length, of the low bytes of each whole text's code points; schema is that of these columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(ids: list, made: list) -> pa.RecordBatch:
            columns = [np.concatenate([m[k] for m in made]) for k in range(len(made[0]))]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), [len(m[0]) for m in made])), *map(pa.array, columns)], names=names)

        for b in batches:
            ids, made, n = [], [], 0
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                made.append(of((np.frombuffer(text.as_py().encode("utf-32-le"), "<u4") & 255).astype(np.int64)))
                ids.append(i)
                n += len(made[-1][0])
                if n >= 1 << 16:
                    yield batch(ids, made)
                    ids, made, n = [], [], 0
            if made:
                yield batch(ids, made)

    names = ["doc_id", *[c.split()[0] for c in schema.split(", ")]]
    docs = table(spark, sf_dir, "documents").filter(F.length("text") > 0).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, f"doc_id long, {schema}")


def run_lengths(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of maximal runs of equal values, of which there is one at least."""
    starts = np.concatenate([[0], np.flatnonzero(v[1:] != v[:-1]) + 1])
    return starts, np.diff(np.concatenate([starts, [len(v)]]))


def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, b, n: how often a text has each byte."""

    def of(v: np.ndarray) -> list:
        counts = np.bincount(v)
        return [held := np.flatnonzero(counts), counts[held]]

    return per_text(spark, sf_dir, of, "b long, n long")


#: The same relations for the SQL engine: t (px as a list, from 1), px, argb, tx.
TILES = "t AS (SELECT vec_id, label, [CAST(least(255, greatest(0, floor((CAST(v AS DOUBLE) + 1) * 127.5))) AS INTEGER) FOR v IN embedding] AS bs FROM embeddings)"
PLACED = "pl AS (SELECT vec_id, label, bs, p, p // 8 AS y, p % 8 AS x, bs[p + 1] AS v FROM t, (SELECT unnest(range(64)) AS p))"
PIXELS = "px AS (SELECT vec_id, label, p, y, x, bs[p + 1] AS a, bs[(p + 1) % 64 + 1] AS r, bs[(p + 2) % 64 + 1] AS g, bs[(p + 3) % 64 + 1] AS b FROM pl)"
ARGB = "argb AS (SELECT vec_id, label, p, y, x, CAST(a AS BIGINT) * 16777216 + r * 65536 + g * 256 + b AS v FROM px)"
TEXT_BYTES = "tx AS (SELECT doc_id, unnest(range(1, length(text) + 1)) AS i, ord(unnest(string_split(text, ''))) & 255 AS b FROM documents WHERE length(text) > 0)"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
