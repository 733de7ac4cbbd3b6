"""Hand-maintained catalog files as a data source: a set registry and one file of rows for each set.

    spark.dataSource.register(SeedSource)
    spark.read.format("card_seed").option("sets", "FE01").load(folder)        # opens FE01.csv only
    rows.write.format("card_seed").mode("append").save(folder)                # one <set code>.csv for each set

Lines starting with ``#`` and blank lines are comments; every row keeps its file and original line number. A file is one
partition. Sets are chosen by an option, not by pushed filters: Spark 4.1 keeps the files that one filter left for other
scans of the same relation, so that a union of two filters over one DataFrame would lose rows.
"""

from __future__ import annotations

import csv
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions import scalars as S
from ..functions import vocabulary as V

FORMAT = "card_seed"
REGISTRY = "sets.csv"
SET_COLUMNS = ["set_code", "name", "series", "released_on", "card_count", "logo_asset_url"]
# The columns of a set's file.
CARD_COLUMNS = ["collector_number", "name", "card_type", "element", "rune_type", "subtype", "attack", "defence", "spirit_cost", "rules_text", "flavour_text", "artist", "rarity", "finish", "language", "edition", "image_url", "is_tracked_for_price"]
PLACE = ["set_code", "file", "line", "source_ref"]
BATCH_ROWS = 10_000


class SeedNotFound(LookupError):
    pass


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The file itself, or a folder's CSV files but the registry, by name."""
    store, root = _store(path)
    if store.get_file_info(root).type != fs.FileType.Directory:
        return [path]
    names = (i.base_name for i in store.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File)
    return [f"{path.rstrip('/')}/{n}" for n in sorted(names) if n.endswith(".csv") and n != REGISTRY and not n.startswith((".", "_"))]


def _lines(path: str) -> Iterator[tuple[int, str]]:
    """Numbered lines that are no comments, read one by one."""
    store, name = _store(path)
    with store.open_input_stream(name) as raw, io.TextIOWrapper(io.BufferedReader(raw), "utf-8-sig", newline="") as text:
        for line, value in enumerate(text, 1):
            if not re.match(r"\s*(#|$)", value := value.rstrip("\r\n")):
                yield line, value


def _header(path: str) -> list[str]:
    head = next(_lines(path), None)
    return [n.strip() for n in next(csv.reader([head[1]]))] if head else []


@dataclass
class SeedFile(InputPartition):
    path: str


class SeedReader(DataSourceReader):
    def __init__(self, paths: list[str], columns: list[str], own: list[str]):
        """own: the columns that come from a file's rows, not from its place."""
        self.paths, self.columns, self.own = paths, columns, set(own)

    def partitions(self) -> list[SeedFile]:
        return [SeedFile(p) for p in self.paths]

    def read(self, partition: SeedFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file is left
            return
        place, names, held = _places(partition.path), None, []
        for line, text in _lines(partition.path):
            values = next(csv.reader([text]))
            if names is None:
                names = [n.strip() for n in values]
                continue
            row = dict(zip(names, values, strict=False))
            at = {**place, "line": line, "source_ref": f"{place['file']}:{line}"}
            held.append({c: row.get(c, "") if c in self.own else at[c] for c in self.columns})
            if len(held) == BATCH_ROWS:
                yield _batch(held, self.columns)
                held = []
        if held:
            yield _batch(held, self.columns)


def _batch(rows: list[dict], columns: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, pa.int32() if isinstance(rows[0][c], int) else pa.string()) for c in columns]))


def _places(path: str) -> dict[str, str]:
    name = path.rsplit("/", 1)[-1]
    return {"file": name, "set_code": name.removesuffix(".csv")}


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class SeedWriter(DataSourceWriter):
    """One file for each set code, whose rows must stand together in a partition. Files appear under their names on
    commit only."""

    def __init__(self, root: str, names: list[str], overwrite: bool):
        self.root, self.names, self.overwrite, self.run = root.rstrip("/"), names, overwrite, uuid.uuid4().hex

    def write(self, rows) -> Written:
        store, root = _store(self.root)
        store.create_dir(root)
        files, seen, out, writer = [], set(), None, None
        columns = [n for n in self.names if n not in PLACE]
        try:
            for row in rows:
                code = row["set_code"]
                if not files or code != files[-1][2]:
                    if code in seen or not code or "/" in code:
                        raise ValueError(f"rows of set {code!r} must stand together and name a file")
                    if out:
                        out.close()
                    seen.add(code)
                    hidden = f"{root}/.{code}-{self.run}-{uuid.uuid4().hex}"
                    out = io.TextIOWrapper(store.open_output_stream(hidden), "utf-8", newline="")
                    writer = csv.writer(out, lineterminator="\n")
                    writer.writerow(columns)
                    files.append((hidden, f"{root}/{code}.csv", code))
                writer.writerow(["" if row[c] is None else re.sub(r"[\r\n]+", " ", str(row[c])) for c in columns])
        finally:
            if out:
                out.close()
        return Written([f[:2] for f in files])

    def commit(self, messages: list) -> None:
        store, root = _store(self.root)
        files = [f for m in messages if m for f in m.files]
        names = {to for _, to in files}
        if len(names) < len(files):
            self.abort(messages)
            raise ValueError("rows of a set stood in several partitions")
        if self.overwrite:
            for old in _files(self.root):
                if f"{root}/{old.rsplit('/', 1)[-1]}" not in names:
                    store.delete_file(f"{root}/{old.rsplit('/', 1)[-1]}")
        for hidden, to in files:
            store.move(hidden, to)

    def abort(self, messages: list) -> None:
        store, _ = _store(self.root)
        for hidden, _ in (f for m in messages if m for f in m.files):
            store.delete_file(hidden)


class SeedSource(DataSource):
    """Options: path (a folder of sets' files, or one file), sets (codes, comma-separated; by default all), columns
    (comma-separated; by default those of a set's file; ``*`` for the union of the files' headers). All columns are text
    but line; what a file lacks is empty."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _paths(self) -> list[str]:
        files, sets = _files(self.options["path"]), self.options.get("sets")
        return files if sets is None else [f for f in files if _places(f)["set_code"] in sets.split(",")]

    def _own(self) -> list[str]:
        asked = self.options.get("columns")
        if asked == "*":
            return list(dict.fromkeys(n for p in self._paths() for n in _header(p)))
        return asked.split(",") if asked else CARD_COLUMNS

    def schema(self) -> str:
        own = self._own()
        return ", ".join(f"`{c}` {'int' if c == 'line' and c not in own else 'string'}" for c in [*(c for c in PLACE if c not in own), *own])

    def reader(self, schema) -> SeedReader:
        return SeedReader(self._paths(), schema.names, self._own())

    def writer(self, schema, overwrite: bool) -> SeedWriter:
        return SeedWriter(self.options["path"], schema.names, overwrite)


def seed(spark: SparkSession, path: str, columns: list[str] | None = None, sets: list[str] | None = None) -> DataFrame:
    """set_code, file, line, source_ref and the columns of a folder's files, or of one file."""
    spark.dataSource.register(SeedSource)
    reader = spark.read.format(FORMAT)
    for name, values in (("columns", columns), ("sets", sets)):
        if values is not None:
            reader = reader.option(name, ",".join(values))
    return reader.load(path)


def write_seed(rows: DataFrame, root: str, mode: str = "append") -> None:
    """One file for each set_code of rows, in the order of collector_number; what stood under its name is replaced, and
    with mode overwrite other sets' files go."""
    rows.sparkSession.dataSource.register(SeedSource)
    rows.repartition("set_code").sortWithinPartitions("set_code", "collector_number").write.format(FORMAT).mode(mode).save(root)


@dataclass
class CsvSeed:
    """A folder with ``sets.csv`` and ``<set code>.csv`` files."""

    spark: SparkSession
    root: str
    name: str = "csv_seed"
    display_name: str = "Curated CSV seed"
    requires_network: bool = False

    def sets(self) -> DataFrame:
        rows = seed(self.spark, f"{self.root}/{REGISTRY}", SET_COLUMNS)
        text = lambda c: V.blank_to_null(F.col(c)).alias(c)
        return rows.filter(V.strip(F.col("set_code")) != "").select(
            text("set_code"), F.coalesce(V.blank_to_null(F.col("name")), V.strip(F.col("set_code"))).alias("name"), text("series"),
            S.as_date(V.strip(F.col("released_on"))).alias("released_on"), F.coalesce(S.as_int(F.col("card_count")), F.lit(0)).alias("card_count"),
            text("logo_asset_url"),
        )

    def available_sets(self) -> DataFrame:
        return self.sets().select("set_code").orderBy("set_code")

    def set_meta(self, code: str) -> DataFrame:
        found = self.sets().filter(F.upper("set_code") == code.upper())
        if found.isEmpty():
            raise SeedNotFound(f"set {code!r} is not declared")
        return found

    def fetch(self, codes: list[str] | None = None) -> DataFrame:
        """Raw rows of the sets' files, or of all, defaults filled in. A set without a file has no rows."""
        rows = seed(self.spark, self.root, sets=codes)
        default = {"finish": F.lit("normal"), "language": F.lit("en"), "edition": V.default_edition(F.col("set_code"))}
        return rows.withColumns({c: F.when(V.strip(F.col(c)) == "", d).otherwise(F.col(c)) for c, d in default.items()})
