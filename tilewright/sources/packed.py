"""Packed archives: every zoom's tiles as content-addressed payloads, stored once, in packs along the curve.

Layout below the root: ``entries/zoom=…`` (a row a tile: its place, count, tight
times, address and pack), ``pages`` (leaves of the directory with what each can
hold) and ``blobs/pack=…`` (address and payload, each address once). Entries
are sorted by tile, blobs by address, so both are found by file statistics.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.operators import payload, tiling

PAGE_ROWS, PACK_BYTES = 1024, 64 << 20
_ORDER = ["zoom", "x", "y", "bucket_ms"]


def write(features: DataFrame, root: str, zooms: tuple[int, int], width_ms: int, columns: list[str], pack_bytes: int = PACK_BYTES, page_rows: int = PAGE_ROWS) -> str:
    """Writes an archive of the columns (``start_ms`` and ``feature_id`` order the rows) and returns its root."""
    spark = features.sparkSession
    placed = tiling.pyramid(features, *zooms, width_ms)
    tiles = payload.encode(placed, columns)
    tiles.write.parquet(f"{root}/tiles")  # read three times below
    tiles = spark.read.parquet(f"{root}/tiles")
    first = tiles.groupBy("address").agg(F.min(F.struct(*_ORDER)).alias("f"), F.max(F.length("payload")).cast("long").alias("bytes"))
    place = payload.packs(first.select("address", "f.*", "bytes"), _ORDER, pack_bytes).select("address", "pack", "offset", "bytes")
    times = placed.groupBy(*_ORDER).agg(F.min("start_ms").alias("cover_t_min"), F.max("end_ms").alias("time_end"))
    entries = tiles.drop("payload").join(place, "address").join(times, _ORDER)
    entries.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).write.partitionBy("zoom").parquet(f"{root}/entries")
    stored = tiles.select("address", "payload").dropDuplicates(["address"]).join(place.select("address", "pack"), "address")
    stored.repartitionByRange("pack", "address").sortWithinPartitions("pack", "address").write.option("parquet.block.size", 1 << 20).option("compression", "none").partitionBy("pack").parquet(f"{root}/blobs")
    payload.pages(spark.read.parquet(f"{root}/entries"), _ORDER, page_rows).write.parquet(f"{root}/pages")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/tiles")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return root


def entries(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/entries")


def read(spark: SparkSession, root: str, columns: T.StructType, zoom: int, x: tuple[int, int], y: tuple[int, int], window: tuple[int, int]) -> DataFrame:
    """The rows of all tiles of a viewport and window."""
    wanted = entries(spark, root).where((F.col("zoom") == zoom) & F.col("x").between(*x) & F.col("y").between(*y) & (F.col("time_end") >= window[0]) & (F.col("cover_t_min") <= window[1]))
    found = wanted.join(spark.read.parquet(f"{root}/blobs"), ["pack", "address"]).select(*_ORDER, "address", "payload")
    return payload.decode(found, columns)


def check(spark: SparkSession, root: str) -> DataFrame:
    """``check, offenders``: addresses without a blob, blobs without an entry, blobs that differ from their address, entries whose count differs from their rows."""
    e, b = entries(spark, root), spark.read.parquet(f"{root}/blobs")

    def look(batches):
        for batch in batches:
            raw = batch.column("payload").to_pylist()
            bad = [payload.address(p) != a for p, a in zip(raw, batch.column("address").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("address"), pa.array(bad), pa.array([-1 if x else payload.decoded(p).num_rows for x, p in zip(bad, raw, strict=True)], pa.int64())], names=["address", "bad", "rows"])

    looked = b.select("address", "payload").mapInArrow(look, "address binary, bad boolean, rows long")
    tests = {
        "lost_blobs": e.join(b.select("address"), "address", "left_anti"),
        "loose_blobs": b.join(e.select("address"), "address", "left_anti"),
        "changed_blobs": looked.where("bad"),
        "counts": e.join(looked, "address").where("n <> rows"),
        "repeated_blobs": b.groupBy("address").count().where("count > 1"),
    }
    out = None
    for name, rows in tests.items():
        one = rows.agg(F.count("*").alias("offenders")).select(F.lit(name).alias("check"), "offenders")
        out = one if out is None else out.unionByName(one)
    return out


class TileReader:
    """Serves single tiles without a Spark job: entries and blobs are found by file statistics."""

    def __init__(self, root: str):
        root = root.removeprefix("file://")
        self.entries = ds.dataset(f"{root}/entries", partitioning="hive")
        self.blobs = ds.dataset(f"{root}/blobs", partitioning="hive")
        self.packs: dict[int, list] = {}
        for f in self.blobs.get_fragments():
            pack = ds.get_partition_keys(f.partition_expression)["pack"]
            self.packs.setdefault(pack, []).append(f)
        self.zooms: dict[int, pa.Table] = {}

    def _directory(self, zoom: int) -> dict:
        """A zoom's directory, read on its first use."""
        if zoom not in self.zooms:
            t = self.entries.to_table(columns=["x", "y", "bucket_ms", "pack", "address"], filter=ds.field("zoom") == zoom)
            rows = zip(*(t.column(c).to_pylist() for c in t.column_names), strict=True)
            self.zooms[zoom] = {r[:3]: r[3:] for r in rows}
        return self.zooms[zoom]

    def tile(self, zoom: int, x: int, y: int, bucket_ms: int) -> pa.Table | None:
        found = self._directory(zoom).get((x, y, bucket_ms))
        if not found:
            return None
        pack, address = found
        for f in self.packs.get(pack, ()):
            t = f.to_table(columns=["payload"], filter=ds.field("address") == address)
            if t.num_rows:
                return payload.decoded(t.column(0)[0].as_py())
        raise ValueError("a tile's blob is lost")
