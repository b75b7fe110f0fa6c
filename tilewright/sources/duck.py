"""DuckDB files as a Spark source, read in parts; PostGIS tables by JDBC. Both need their drivers only when used."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from tilewright.functions.codes import quoted


class DuckSource(DataSource):
    """``format("duckdb")`` with ``path``, ``table`` or ``query``, ``partitions`` and, to split by, ``partition_column``."""

    @classmethod
    def name(cls) -> str:
        return "duckdb"

    def _sql(self) -> str:
        return self.options.get("query") or f"SELECT * FROM {quoted(self.options['table'])}"

    def schema(self) -> StructType:
        import duckdb

        with duckdb.connect(self.options["path"], read_only=True) as c:
            return from_arrow_schema(c.execute(f"SELECT * FROM ({self._sql()}) LIMIT 0").to_arrow_table().schema)

    def reader(self, schema: StructType) -> DataSourceReader:
        return DuckReader(self.options, self._sql())


class DuckReader(DataSourceReader):
    def __init__(self, options: dict, sql: str):
        self.path, self.sql = options["path"], sql
        self.column, self.n = options.get("partition_column"), int(options.get("partitions", "1"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.n if self.column else 1)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        import duckdb

        part = f" WHERE coalesce(hash({quoted(self.column)}) % {self.n}, 0) = {partition.value}" if self.column else ""
        with duckdb.connect(self.path, read_only=True) as c:
            yield from c.execute(f"SELECT * FROM ({self.sql}){part}").to_arrow_reader(65536)


def scan(spark: SparkSession, path: str, table: str | None = None, query: str | None = None, partition_column: str | None = None, partitions: int = 1) -> DataFrame:
    """A table or query of a DuckDB file that all executors can read."""
    spark.dataSource.register(DuckSource)
    options = {"path": path, "table": table, "query": query, "partition_column": partition_column, "partitions": str(partitions)}
    return spark.read.format("duckdb").options(**{k: v for k, v in options.items() if v is not None}).load()


def postgis(spark: SparkSession, url: str, table: str, geometry: str, columns: list[str], partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8) -> DataFrame:
    """A PostGIS table by JDBC, geometries as extended WKB in degrees; filters on other columns reach the server."""
    shown = ", ".join(quoted(c) for c in columns)
    sql = f"(SELECT {shown}, ST_AsEWKB(ST_Transform({quoted(geometry)}, 4326)) AS {quoted(geometry)} FROM {table}) AS t"
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", sql).option("fetchsize", 10_000)
    if partition_column and bounds:
        reader = reader.option("partitionColumn", partition_column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()
