"""Tile payloads, content-addressed blobs, packs and directory pages.

A tile's payload is one compressed Arrow stream of its rows in order of time,
so equal tiles have equal bytes; its address is a hash of them, and equal blobs
are stored once. Packs and pages are cut on running sums along a curve, counted
within range partitions first, so no task sees the whole directory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.operators import ranges
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

TILE = ("zoom", "x", "y", "bucket_ms")
LEVEL = 3


def encoded(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table.combine_chunks())
    return zstandard.ZstdCompressor(LEVEL).compress(sink.getvalue())


def decoded(payload: bytes, most_bytes: int = 1 << 30) -> pa.Table:
    if zstandard.frame_content_size(payload) > most_bytes:
        raise ValueError("a payload unpacks to more than is allowed")
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload)).read_all()


def address(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def encode(placed: DataFrame, columns: list[str], order: tuple[str, ...] = ("start_ms", "feature_id"), keys: tuple[str, ...] = TILE) -> DataFrame:
    """``keys, n, address, payload``: a payload of ``columns`` for each tile, rows by ``order``."""
    rows = placed.select(*keys, *dict.fromkeys((*order, *columns)))
    schema = T.StructType([rows.schema[k] for k in keys]).add("n", "long").add("address", "binary").add("payload", "binary")

    def pack(table: pa.Table) -> pa.Table:
        own = table.sort_by([(c, "ascending") for c in order]).select(columns).replace_schema_metadata(None)
        payload = encoded(own)
        out = {k: table.column(k).slice(0, 1) for k in keys}
        return pa.table(out | {"n": pa.array([own.num_rows], pa.int64()), "address": pa.array([address(payload)], pa.binary()), "payload": pa.array([payload], pa.binary())})

    return rows.groupBy(*keys).applyInArrow(pack, schema)


def decode(tiles: DataFrame, columns: T.StructType, keys: tuple[str, ...] = TILE) -> DataFrame:
    """The rows of payloads beside their keys; a payload that differs from its address is an error."""
    schema = T.StructType([tiles.schema[k] for k in keys] + list(columns.fields))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                payload = batch.column(len(keys) + 1)[i].as_py()
                if address(payload) != batch.column(len(keys))[i].as_py():
                    raise ValueError("a payload differs from its address")
                own = decoded(payload)
                heads = [pa.array([batch.column(k)[i].as_py()] * own.num_rows, arrow.field(k).type) for k in range(len(keys))]
                yield from pa.Table.from_arrays([*heads, *own.columns], names=arrow.names).cast(arrow).to_batches()

    return tiles.select(*keys, "address", "payload").mapInArrow(run, schema)


def blobs(tiles: DataFrame) -> DataFrame:
    """``address, uses, bytes, payload``: each payload once, however many tiles hold it."""
    return tiles.groupBy("address").agg(F.count("*").alias("uses"), F.max(F.length("payload")).cast("long").alias("bytes"), F.first("payload").alias("payload"))


def running(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """Adds ``start`` and ``end``, the running sum of ``size`` before and up to each row in order."""
    parted, _ = ranges.dealt(rows, order, size)
    out = parted.withColumn("_e", F.sum(size).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    end = F.col("_b") + F.col("_e")
    return out.withColumns({"start": end - F.col(size), "end": end}).drop("_p", "_b", "_e")


def packs(stored: DataFrame, order: list[str], most_bytes: int, size: str = "bytes") -> DataFrame:
    """Adds ``pack`` and ``offset``: blobs in order, a new pack wherever a multiple of ``most_bytes`` is passed."""
    r = running(stored, order, size).withColumn("pack", F.floor(F.col("start") / most_bytes).cast("long"))
    first = r.groupBy("pack").agg(F.min("start").alias("_f"))
    return r.join(first, "pack").withColumn("offset", F.col("start") - F.col("_f")).drop("_f", "start", "end")


def pages(directory: DataFrame, order: list[str], most_rows: int) -> DataFrame:
    """``page, zoom, n, x0, x1, y0, y1, t0, t1``: leaves of a directory and what each can hold; a page keeps to one zoom."""
    by = running(directory.withColumn("_one", F.lit(1)), order, "_one")
    page = F.floor(F.col("start") / most_rows).cast("long")
    ends = {"x": ("x0", "x1"), "y": ("y0", "y1")}
    return by.groupBy(page.alias("page"), "zoom").agg(F.count("*").alias("n"), *[f(c).alias(a) for c, names in ends.items() for f, a in zip((F.min, F.max), names, strict=True)], F.min("cover_t_min").alias("t0"), F.max("time_end").alias("t1"))


def page_meets(x: tuple[int, int], y: tuple[int, int], zoom: int, window: tuple[int, int]):
    """Whether a page may hold tiles of a viewport and window; it never denies one that does."""
    return (F.col("zoom") == zoom) & (F.col("x1") >= x[0]) & (F.col("x0") <= x[1]) & (F.col("y1") >= y[0]) & (F.col("y0") <= y[1]) & (F.col("t1") >= window[0]) & (F.col("t0") <= window[1])


#: Scores by which a budget keeps rows: by size, by filled properties, by both, by id.
SCORES = {
    "size": lambda size, filled, ident: size.cast("double"),
    "properties": lambda size, filled, ident: filled.cast("double"),
    "combined": lambda size, filled, ident: size + 10.0 * filled,
    "id": lambda size, filled, ident: F.pmod(F.xxhash64(ident), F.lit(1_000_003)).cast("double"),
}


def byte_budget(placed: DataFrame, most_rows: int, most_bytes: int, score: str, size: str, id_col: str = "feature_id", keys: tuple[str, ...] = ("zoom", "x", "y")) -> DataFrame:
    """The rows that each tile keeps: the highest scores up to a count; if they are too large, by score a byte up to nine
    tenths of the bytes, passing over what does not fit (a twentieth more is let in while the tile is not nearly full).

    Tiles within the budget are decided by window sums; only ids, scores and sizes of others reach the sequential step.
    """
    w = Window.partitionBy(*keys)
    top = placed.withColumn("_n", F.row_number().over(w.orderBy(F.col(score).desc(), F.col(id_col)))).where(F.col("_n") <= most_rows).drop("_n")
    top = top.withColumn("_all", F.sum(size).over(w))
    inside, over = top.where(F.col("_all") <= most_bytes).drop("_all"), top.where(F.col("_all") > most_bytes).drop("_all")
    names = [*keys, id_col]
    target = 9 * most_bytes // 10

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_d=pdf[score] / pdf[size].clip(lower=1)).sort_values(["_d", id_col], ascending=[False, True])
        room, kept = target, []
        for bytes_ in pdf[size].tolist():
            fits = bytes_ <= room or (room > 0.05 * target and bytes_ <= room + 0.05 * target)
            kept.append(fits)
            room -= bytes_ * fits
        return pdf.loc[kept, names]

    chosen = over.select(*names, score, size).groupBy(*keys).applyInPandas(fill, over.select(*names).schema)
    return inside.unionByName(over.join(chosen, names, "left_semi"))
