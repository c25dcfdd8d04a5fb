"""Stored pulse features as a table: a Python data source over nested ``.npy`` files.

A file holds a map, or a list of maps, from region to a list of {signal type: signal}; its folders say which class, split, method and kind of region it
belongs to. Every signal is one row. Reading asks for what a query needs and no more:

* conditions on folders and names leave files unlisted or unread, and those on region and signal type keep signals from being converted;
* columns that aren't in the schema asked for aren't made, and where none comes from inside a file, no file is opened for its signals;
* a partition is a run of files up to ``partitionBytes``, so small files share a task; each signal goes out as it is read;
* a file that can't be read is a row with its name and the error, and the others are read all the same.

Pickled files are decoded by an unpickler that knows arrays and plain containers only: a file can't run code.
"""

from __future__ import annotations

import io
import pickle
from collections.abc import Iterable, Iterator, Sequence
from fnmatch import fnmatch

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith
from pyspark.sql.types import StructType

from pulseloom.sources.staged import StagedWriter, filesystem

#: Folders above a file, from the outermost.
FOLDERS = ("class", "split", "method", "roi_type")
SCHEMA = "file string, class string, split string, method string, roi_type string, region string, entry int, signal_type string, values array<double>, error string"
#: Columns that a file's path alone decides.
OUTSIDE = {"file", *FOLDERS}
# What a pickled array names.
ALLOWED = {("numpy.core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "_reconstruct"), ("numpy.core.multiarray", "scalar"), ("numpy._core.multiarray", "scalar"), ("numpy", "ndarray"), ("numpy", "dtype")}


class _Arrays(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        if (module, name) not in ALLOWED:
            raise pickle.UnpicklingError(f"{module}.{name} isn't allowed in a feature file")
        return super().find_class(module, name)


def decode(content: bytes):
    """The object in a ``.npy`` file: its only item if it has no dimension."""
    stream = io.BytesIO(content)
    version = np.lib.format.read_magic(stream)
    header = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, _, dtype = header(stream)
    if dtype.hasobject:
        found = _Arrays(stream).load()
    else:
        found = np.load(io.BytesIO(content), allow_pickle=False)
    return found.item() if isinstance(found, np.ndarray) and found.ndim == 0 else found


def encode(entries: object) -> bytes:
    """A ``.npy`` file of a map or list."""
    held = np.empty((), object)
    held[()] = entries
    out = io.BytesIO()
    np.save(out, held, allow_pickle=True)
    return out.getvalue()


def signals_of(found: object, regions: set[str] | None = None, kinds: set[str] | None = None) -> Iterator[tuple[str, int, str, np.ndarray]]:
    """(region, entry, signal type, signal) of a file's object; entries count within a region over the whole file."""
    entries: dict[str, int] = {}
    for part in [found] if isinstance(found, dict) else found if isinstance(found, (list, np.ndarray)) else []:
        for region, items in part.items() if isinstance(part, dict) else []:
            for item in items:
                entry = entries[region] = entries.get(region, -1) + 1
                if regions is None or region in regions:
                    for kind, signal in item.items():
                        if kinds is None or kind in kinds:
                            yield region, entry, kind, np.asarray(signal, np.float64).ravel()


def _folders(path: str) -> dict[str, str | None]:
    parts = path.split("/")[:-1]
    return {name: parts[k - len(FOLDERS)] if len(parts) >= len(FOLDERS) - k else None for k, name in enumerate(FOLDERS)}


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class FeatureReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.root, self.pattern = options["path"], options.get("pattern", "*.npy")
        self.bytes = int(options.get("partitionbytes", 64 << 20))
        self.columns = schema.names
        self.wanted: dict[str, set[str]] = {}
        self.prefixes: list[tuple[str, str]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality, IN and prefixes of folders and the file, and equality and IN of region and signal type; the rest stays with Spark."""
        exact, there, left = OUTSIDE | {"region", "signal_type"}, [], []
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, EqualTo) and column in exact:
                values = {f.value}
            elif isinstance(f, In) and column in exact:
                values = set(f.value)
            elif isinstance(f, StringStartsWith) and column in OUTSIDE:
                self.prefixes.append((column, f.value))
                continue
            else:
                (there.append if isinstance(f, IsNotNull) else left.append)(f)
                continue
            self.wanted[column] = self.wanted.get(column, values) & values
        given = {*self.wanted, *(c for c, _ in self.prefixes)}
        return left + [f for f in there if len(f.attribute) > 1 or f.attribute[0] not in given]  # a value asked for is there

    def _takes(self, path: str) -> bool:
        own = {"file": path, **_folders(path)}
        return fnmatch(path.rsplit("/", 1)[-1], self.pattern) and all(own[c] in v for c, v in self.wanted.items() if c in OUTSIDE) and all((own[c] or "").startswith(p) for c, p in self.prefixes)

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow.fs import FileSelector, FileType

        system, root = filesystem(self.root)
        found = sorted((x.path, x.size or 0) for x in system.get_file_info(FileSelector(root, recursive=True)) if x.type == FileType.File and self._takes(x.path))
        runs, held = [], 0
        for path, size in found:
            if not runs or held + size > self.bytes:
                runs.append([])
                held = 0
            runs[-1].append(path)
            held += size
        return [Files(paths) for paths in runs]

    def read(self, partition: Files) -> Iterator[tuple]:
        if not isinstance(partition, Files):  # no files: one empty partition
            return
        system, _ = filesystem(self.root)
        regions, kinds = self.wanted.get("region"), self.wanted.get("signal_type")
        for path in partition.paths:
            row = dict.fromkeys(self.columns) | {"file": path, **_folders(path)}
            shaped = lambda **more: tuple((row | more)[c] for c in self.columns)
            try:
                with system.open_input_stream(path) as stream:
                    found = decode(stream.read())
                for region, entry, kind, signal in signals_of(found, regions, kinds):
                    yield shaped(region=region, entry=entry, signal_type=kind, **({"values": signal.tolist()} if "values" in self.columns else {}))
            except Exception as failure:  # one file's fault is a row
                if regions is None and kinds is None:
                    yield shaped(error=f"{type(failure).__name__}: {failure}")


class FeatureWriter(StagedWriter):
    """Nested feature files."""

    def add(self, held: dict, row) -> None:
        if row["entry"] is None or row["entry"] < 0:
            raise ValueError("an entry must be numbered from 0")
        items = held.setdefault(row["region"], [])
        while len(items) <= row["entry"]:
            items.append({})
        items[row["entry"]][row["signal_type"]] = None if row["values"] is None else np.array(row["values"], np.float64)

    def render(self, held: dict) -> bytes:
        return encode(held)


class FeatureSource(DataSource):
    """``spark.read.format("pulse_features")``: options path, pattern, partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "pulse_features"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FeatureReader:
        return FeatureReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> FeatureWriter:
        return FeatureWriter(self.options, overwrite)


def scan_features(spark: SparkSession, folder: str, columns: Sequence[str] = (), pattern: str = "*.npy", partition_bytes: int = 64 << 20) -> DataFrame:
    """Signals of all files below a folder: those columns of SCHEMA that are named, all by default."""
    spark.dataSource.register(FeatureSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    whole = StructType.fromDDL(SCHEMA)
    chosen = whole if not columns else StructType([whole[c] for c in columns])
    return spark.read.format("pulse_features").schema(chosen).option("pattern", pattern).option("partitionBytes", partition_bytes).load(folder)


def save_features(rows: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """``rows(file, region, entry, signal_type, values)`` as nested files below a folder, in one job whose files appear together."""
    rows.sparkSession.dataSource.register(FeatureSource)
    ordered = rows.select("file", "region", "entry", "signal_type", "values").repartition("file").sortWithinPartitions("file", "region", "entry")
    ordered.write.format("pulse_features").mode(mode).option("path", folder).save()
