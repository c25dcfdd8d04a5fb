"""Random access to the rows of a folder of Parquet files by their number.

An index names every row group with the number of its first row, in the order of file names and of row groups. It is made from
the files' footers alone, and has a row for each row group. Asking for numbers reads the row groups that hold them, the columns asked for, and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from pulseloom.sources.staged import filesystem

INDEX = "file string, row_group int, rows long, bytes long"


def _files(folder: str) -> list[str]:
    from pyarrow.fs import FileSelector, FileType

    system, root = filesystem(folder)
    return sorted(x.path for x in system.get_file_info(FileSelector(root, recursive=True)) if x.type == FileType.File and x.path.endswith(".parquet"))


def item_index(spark: SparkSession, folder: str) -> DataFrame:
    """(file, row_group, rows, bytes, first) of all Parquet files below a folder, footers read in parallel. Row groups without rows are left out."""
    files = _files(folder)
    system, _ = filesystem(folder)

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, int, int, int]] = []
            for path in batch.column(0).to_pylist():
                with system.open_input_file(path) as source:
                    found = pq.read_metadata(source)
                out += [(path, k, found.row_group(k).num_rows, found.row_group(k).total_byte_size) for k in range(found.num_row_groups)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["file", "row_group", "rows", "bytes"])

    named = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, min(len(files), spark.sparkContext.defaultParallelism)))
    groups = named.mapInArrow(footers, INDEX).where("rows > 0")
    before = Window.orderBy("file", "row_group").rowsBetween(Window.unboundedPreceding, -1)  # row groups, not rows
    return groups.withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0)))


def items(spark: SparkSession, folder: str, index: DataFrame, numbers: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """(item, columns) for ``numbers(item long)``: each number once, those beyond the last row not at all.

    Numbers meet row groups by blocks of numbers, an equi-join; a row group is read once for all that are asked of it.
    """
    system, _ = filesystem(folder)
    files = _files(folder)
    if not files:
        raise FileNotFoundError(f"no Parquet files below {folder}")
    with system.open_input_file(files[0]) as source:
        whole = pq.read_schema(source).remove_metadata()
    schema = pa.schema([whole.field(c) for c in columns]) if columns else whole
    block = index.agg(F.greatest(F.ceil(F.avg("rows")), F.lit(1)).cast("long")).first()[0] or 1
    spans = index.select("file", "row_group", "rows", "first", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("rows") - 1) / block))).alias("block"))
    asked = numbers.select(F.col("item").cast("long").alias("item")).where("item >= 0").distinct().withColumn("block", F.floor(F.col("item") / block))
    met = asked.join(spans, "block").where("item >= first AND item < first + rows")
    wanted = met.groupBy("file", "row_group", "first").agg(F.array_sort(F.collect_list("item")).alias("items"))  # a row group's rows at most

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, group, first, own in zip(*(batch.column(k).to_pylist() for k in range(4))):
                with system.open_input_file(path) as source:
                    found = pq.ParquetFile(source).read_row_group(group, columns=schema.names)
                rows = found.select(schema.names).take(pa.array([i - first for i in own])).cast(schema).combine_chunks()
                yield from pa.table({"item": pa.array(own, pa.int64()), **{n: rows.column(n) for n in schema.names}}).to_batches()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in from_arrow_schema(schema))
    return wanted.mapInArrow(read, f"item long, {kinds}")


def item_slice(spark: SparkSession, folder: str, index: DataFrame, low: int, high: int, columns: Sequence[str] = ()) -> DataFrame:
    """Rows low to high - 1."""
    return items(spark, folder, index, spark.range(low, max(low, high)).withColumnRenamed("id", "item"), columns)
