"""Custom source plugin (A12) through the Python Data Source API.

``pipework_parquet_rows`` reads the row groups of parquet files with pyarrow,
one Spark input partition per row group, so the scan is spread over the
executors. It exists to show the plugin path; plain ``spark.read.parquet``
is the faster choice for parquet.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_ARROW_TO_DDL = {
    "int8": "TINYINT", "int16": "SMALLINT", "int32": "INT", "int64": "BIGINT",
    "float": "FLOAT", "double": "DOUBLE", "bool": "BOOLEAN", "string": "STRING",
    "large_string": "STRING", "binary": "BINARY",
}


class _RowGroup(InputPartition):
    def __init__(self, path: str, index: int):
        super().__init__((path, index))
        self.path, self.index = path, index


class ParquetRowsSource(DataSource):
    @classmethod
    def name(cls):
        return "pipework_parquet_rows"

    def _files(self) -> list[str]:
        import pyarrow.dataset as ds
        return sorted(ds.dataset(self.options["path"], format="parquet").files)

    def schema(self):
        import pyarrow.parquet as pq
        cols = [c.strip() for c in self.options["columns"].split(",")]
        sch = pq.read_schema(self._files()[0])
        return ", ".join(f"`{c}` {_ARROW_TO_DDL[str(sch.field(c).type)]}" for c in cols)

    def reader(self, schema):
        return _Reader(self.options, schema, self._files())


class _Reader(DataSourceReader):
    def __init__(self, options, schema, files):
        self.columns = [c.strip() for c in options["columns"].split(",")]
        self.files = files

    def partitions(self):
        import pyarrow.parquet as pq
        parts = []
        for f in self.files:
            for i in range(pq.ParquetFile(f).num_row_groups):
                parts.append(_RowGroup(f, i))
        return parts

    def read(self, partition):
        import pyarrow.parquet as pq
        table = pq.ParquetFile(partition.path).read_row_group(partition.index, columns=self.columns)
        for batch in table.to_batches():
            yield batch


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ParquetRowsSource)
