"""Features from tables: the derived point features of the test tables, and readers of Parquet and delimited files.

Canonical columns: ``feature_id, lon, lat, start_ms, end_ms`` and properties.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions import codes, space, timing, values

WGS84_NAMES = ("OGC:CRS84", "EPSG:4326", "CRS84", "WGS 84", "WGS84")
GEOMETRY_NAMES = ("geometry", "geom", "wkb_geometry", "wkb", "shape", "the_geom")
POINT_PAIRS = (("lon", "lat"), ("longitude", "latitude"), ("x", "y"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as instants at places derived from their ids."""
    e = table(spark, sf_dir, "events")
    lon = (F.lit(-180) + F.pmod(F.col("user_id") * 7919, F.lit(24)) * F.lit(15.0)) + F.pmod(F.col("event_id") * 31, F.lit(500)) / F.lit(100.0)
    lat = (F.lit(-60) + F.pmod(F.col("user_id") * 104729, F.lit(9)) * F.lit(13.0)) + F.pmod(F.col("event_id") * 17, F.lit(400)) / F.lit(100.0)
    ms = timing.of_timestamp(F.col("ts"))
    return e.select(F.col("event_id").alias("feature_id"), "user_id", "event_type", "value", lon.alias("lon"), lat.alias("lat"), ms.alias("start_ms"), ms.alias("end_ms"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items from the order date to the ship date, swapped where they are the wrong way round."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    a, b = timing.of_timestamp(F.col("o_orderdate")), timing.of_timestamp(F.col("l_shipdate"))
    return li.join(o, li.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", "o_custkey", "l_suppkey", a.alias("raw_start"), b.alias("raw_end"), F.least(a, b).alias("start_ms"), F.greatest(a, b).alias("end_ms"))


def is_wgs84(crs: object) -> bool:
    """Accepts the absent default, names and PROJJSON ids of longitude and latitude on WGS 84."""
    if crs is None:
        return True
    if isinstance(crs, str):
        return any(n.lower() in crs.lower() for n in WGS84_NAMES)
    if isinstance(crs, dict):
        found = crs.get("id") or {}
        return f"{found.get('authority')}:{found.get('code')}" in WGS84_NAMES or is_wgs84(crs.get("name") or "")
    return False


def geometry_column(columns: list[str], meta: dict | None = None) -> str | tuple[str, str]:
    """The declared primary column, else a known name, else a pair of coordinate columns."""
    if meta and meta.get("primary_column") in columns:
        return meta["primary_column"]
    low = {c.lower(): c for c in columns}
    for name in GEOMETRY_NAMES:
        if name in low:
            return low[name]
    for pair in POINT_PAIRS:
        if all(p in low for p in pair):
            return low[pair[0]], low[pair[1]]
    raise ValueError(f"no geometry among {columns}")


def decode_wkb(data: bytes | None):
    """``(kind, parts)`` of WKB or EWKB, or None. Parts are lists of (lon, lat, z or None); a polygon's rings and a
    multi-geometry's members follow each other. Both byte orders; Z and M are read past, Z is kept."""
    if not data:
        return None
    names = {1: "point", 2: "linestring", 3: "polygon", 4: "multipoint", 5: "multilinestring", 6: "multipolygon"}

    def one(at: int):
        order = "<" if data[at] == 1 else ">"
        (code,) = struct.unpack_from(order + "I", data, at + 1)
        at += 5
        z, m = bool(code & 0x80000000), bool(code & 0x40000000)
        if code & 0x20000000:
            at += 4
        base = code & 0x0FFFFFFF
        z, m, base = z or base // 1000 in (1, 3), m or base // 1000 in (2, 3), base % 1000
        width = 2 + z + m

        def run(at: int, n: int):
            flat = struct.unpack_from(f"{order}{n * width}d", data, at)
            return [(flat[i], flat[i + 1], flat[i + 2] if z else None) for i in range(0, len(flat), width)], at + 8 * n * width

        if base == 1:
            part, at = run(at, 1)
            return base, [part], at
        (n,) = struct.unpack_from(order + "I", data, at)
        at += 4
        if base == 2:
            part, at = run(at, n)
            return base, [part], at
        parts = []
        for _ in range(n):
            if base == 3:
                (k,) = struct.unpack_from(order + "I", data, at)
                part, at = run(at + 4, k)
                parts.append(part)
            else:
                _, more, at = one(at)
                parts += more
        return base, parts, at

    try:
        base, parts, _ = one(0)
    except (struct.error, IndexError):
        return None
    return (names[base], parts) if base in names and any(parts) else None


def encode_wkb(kind: str, parts: list) -> bytes:
    """Little-endian ISO WKB of a point, line or polygon."""
    code = {"point": 1, "linestring": 2, "polygon": 3}[kind]
    flat = lambda p: struct.pack(f"<{2 * len(p)}d", *(v for q in p for v in q[:2]))
    head = struct.pack("<BI", 1, code)
    if kind == "point":
        return head + flat(parts[0][:1])
    if kind == "linestring":
        return head + struct.pack("<I", len(parts[0])) + flat(parts[0])
    return head + struct.pack("<I", len(parts)) + b"".join(struct.pack("<I", len(p)) + flat(p) for p in parts)


_VERTEX = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
GEOMETRY_SCHEMA = T.StructType([T.StructField("geom_kind", T.StringType()), T.StructField("parts", T.ArrayType(T.ArrayType(_VERTEX))), T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])


@F.pandas_udf(GEOMETRY_SCHEMA)
def wkb_geometry(data: pd.Series) -> pd.DataFrame:
    """Kind, parts and the mean of the vertices; all null where it can't be read."""
    rows = []
    for x in data:
        g = decode_wkb(x)
        if g is None:
            rows.append((None, None, None, None))
            continue
        verts = [v for p in g[1] for v in p]
        rows.append((g[0], [[{"lon": a, "lat": b} for a, b, _ in p] for p in g[1]], sum(v[0] for v in verts) / len(verts), sum(v[1] for v in verts) / len(verts)))
    return pd.DataFrame(rows, columns=["geom_kind", "parts", "lon", "lat"])


def time_ms(df: DataFrame, name: str, unit: str = "ms") -> Column:
    """A time column of any accepted type as milliseconds; null where it can't be read."""
    kind = dict(df.dtypes)[name]
    c = F.col(name)
    if kind == "string":
        return F.coalesce(timing.parse_iso8601(c), timing.to_ms(c.try_cast("long"), unit))
    if kind.startswith("timestamp"):
        return timing.of_timestamp(c)
    if kind == "date":
        return F.unix_date(c).cast("long") * 86_400_000
    return timing.to_ms(c, unit)


def read_features(df: DataFrame, time_col: str, end_col: str | None = None, geometry: str | tuple[str, str] | None = None, unit: str = "ms", strict: bool = True, where: str | None = None) -> DataFrame:
    """Any table as features. Strict: a bad time or geometry fails the job. Otherwise a bad time is 0 and a row
    with a bad geometry goes. A negative time always fails."""
    if where:
        df = df.where(where)
    geometry = geometry or geometry_column(df.columns)
    used = {time_col, end_col, *([geometry] if isinstance(geometry, str) else geometry)}
    start = time_ms(df, time_col, unit)
    end = F.coalesce(time_ms(df, end_col, unit), start) if end_col else start
    if strict:
        start = F.when(start.isNull(), F.raise_error(F.lit(f"unreadable time in {time_col}"))).otherwise(start)
    start, end = F.coalesce(start, F.lit(0)).cast("long"), F.coalesce(end, F.lit(0)).cast("long")
    start = F.when(start < 0, F.raise_error(F.lit("negative time"))).otherwise(start)
    if isinstance(geometry, str):
        placed = df.withColumn("_g", wkb_geometry(F.col(geometry)))
        lon, lat, more = F.col("_g.lon"), F.col("_g.lat"), [F.col("_g.geom_kind").alias("geom_kind"), F.col("_g.parts").alias("parts")]
    else:
        placed, (a, b) = df, geometry
        lon, lat, more = F.col(a).cast("double"), F.col(b).cast("double"), [F.lit("point").alias("geom_kind")]
    rest = [c for c in df.columns if c not in used]
    out = placed.select(lon.alias("lon"), lat.alias("lat"), start.alias("start_ms"), end.alias("end_ms"), *more, *rest)
    if strict:
        return out.withColumn("lon", F.when(space.valid(F.col("lon"), F.col("lat")), F.col("lon")).otherwise(F.raise_error(F.lit("unreadable geometry")).cast("double")))
    return out.where(space.valid(F.col("lon"), F.col("lat")))


def property_kinds(df: DataFrame, exclude: set[str] = frozenset()) -> dict[str, str]:
    """``numeric`` or ``categorical`` by declared type; nested and binary columns are no properties."""
    out = {}
    for name, kind in df.dtypes:
        if name in exclude:
            continue
        if kind.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date") or kind.startswith("timestamp"):
            out[name] = "numeric"
        elif kind in ("string", "boolean"):
            out[name] = "categorical"
    return out


def inferred_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: for each text column, whether all its values are finite numbers (and there is one)."""
    return df.agg(*[F.coalesce(F.bool_and(values.numeric_text(F.col(c)).isNotNull()), F.lit(False)).alias(c) for c in columns])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file with a header; names are normalised to lower-case letters and digits."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    return df.toDF(*[values.normal_name(c) for c in df.columns])


def read_query(spark: SparkSession, sql: str, **views: DataFrame) -> DataFrame:
    """A delegated SELECT over named tables."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def write_features(df: DataFrame, path: str, partition_by: Iterator[str] = ()) -> None:
    """Features as Parquet with a covering box column for row-group pruning."""
    box = F.struct(F.col("lon").alias("xmin"), F.col("lat").alias("ymin"), F.col("lon").alias("xmax"), F.col("lat").alias("ymax"))
    w = df.withColumn("bbox", box).write.option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


# --- GeoParquet


def data_files(spark: SparkSession, path: str) -> list[str]:
    """The Parquet files of a path on any file system that Spark reads, by name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    found = [str(s.getPath().toString()) for s in fs.listStatus(p)]
    return sorted(f for f in found if f.endswith(".parquet"))


def footer(spark: SparkSession, path: str, key: str = "geo") -> dict | None:
    """One key of the footer of a dataset's first file, read where the data is; None if absent or malformed."""
    files = data_files(spark, path)
    if not files:
        return None
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(files[0]), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
    try:
        raw = reader.getFooter().getFileMetaData().getKeyValueMetaData().get(key)
    finally:
        reader.close()
    try:
        return json.loads(raw) if raw else None
    except ValueError:
        return None


def vertex_ms(df: DataFrame, column: str, unit: str = "ms") -> Column:
    """An array of vertex times as milliseconds, whatever they are written as."""
    kind = dict(df.dtypes)[column]
    return F.transform(column, lambda t: timing.of_timestamp(t) if "timestamp" in kind else timing.to_ms(t, unit))


def read_geoparquet(spark: SparkSession, path: str, time_col: str, end_col: str | None = None, id_col: str | None = None, include: list[str] | None = None, exclude: list[str] = (), vertex_times: str | None = None, unit: str = "ms", strict: bool = True, where: str | None = None) -> DataFrame:
    """A GeoParquet dataset as features with a ``feature_id``.

    The footer names the geometry column and its reference system, which must be
    degrees on WGS 84. ``include`` and ``exclude`` choose properties before
    anything is read; the filter reaches the files.
    """
    meta, df = footer(spark, path), spark.read.parquet(path)
    geometry = geometry_column(df.columns, meta)
    declared = ((meta or {}).get("columns") or {}).get(geometry) if isinstance(geometry, str) else None
    if declared and not is_wgs84(declared.get("crs")):
        raise ValueError(f"{path}: {geometry} is not in degrees on WGS 84; reproject it first")
    needed = {time_col, end_col, id_col, vertex_times, *([geometry] if isinstance(geometry, str) else geometry)} - {None}
    if where:
        df = df.where(where)
    df = df.select(*[c for c in df.columns if c in needed or (include is None or c in include) and c not in exclude and c != "bbox"])
    if vertex_times:
        df = df.withColumn(vertex_times, vertex_ms(df, vertex_times, unit))
    out = read_features(df, time_col, end_col, geometry, unit, strict)
    return out.withColumn("feature_id", codes.feature_id(F.col(id_col) if id_col else None, F.col("lon"), F.col("lat"), F.col("start_ms")))


def write_geoparquet(df: DataFrame, path: str) -> None:
    """Point features as GeoParquet 1.1: WKB geometries, a covering box, and a footer that names them and their bounds.

    Each partition replaces a file named by its number, so a task that runs
    again leaves nothing twice.
    """
    import struct

    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs

    def run(batches):
        from pyspark import TaskContext

        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        lon, lat = t.column("lon").to_pylist(), t.column("lat").to_pylist()
        box = pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in (lon, lat, lon, lat)], names=["xmin", "ymin", "xmax", "ymax"])
        t = t.drop_columns(["lon", "lat"]).append_column("geometry", pa.array([struct.pack("<BIdd", 1, 1, a, b) for a, b in zip(lon, lat, strict=True)], pa.binary())).append_column("bbox", box)
        covering = {"bbox": {k: ["bbox", k] for k in ("xmin", "ymin", "xmax", "ymax")}}
        column = {"encoding": "WKB", "geometry_types": ["Point"], "bbox": [min(lon), min(lat), max(lon), max(lat)], "covering": covering}
        geo = {"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": column}}
        where, root = fs.FileSystem.from_uri(path)
        where.create_dir(root)
        number = TaskContext.get().partitionId()
        with where.open_output_stream(f"{root}/part-{number:06d}.parquet") as out:
            pq.write_table(t.replace_schema_metadata({"geo": json.dumps(geo)}), out, compression="zstd")
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32())], names=["part"])

    df.where(space.valid(F.col("lon"), F.col("lat"))).mapInArrow(run, "part int").count()
