"""Feeds as folders of JSON snapshots: a data source for batch and stream, and what their rows mean.

A feed (prices, rates, service logs) is fetched by whoever may; each answer is stored as a file whose name, or
folder, sorts by time. The source lists them, deals them to tasks, and in a stream gives those after the
last one seen. One row is one snapshot; the functions below read rows of either, by built-in expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quire.functions.text import RATES, log_line
from quire.sources.files import price_list


@dataclass
class Files(InputPartition):
    names: list[str]

    def __init__(self, names: list[str]):
        super().__init__(tuple(names))
        self.names = names


class _Folder:
    """Files of a folder by their relative path, in its order; hidden ones and marks of writers are none."""

    def __init__(self, options: dict):
        folder = options["path"].rstrip("/")
        self.store, self.root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        self.each = max(1, int(options.get("filespertask", "16")))

    def listed(self) -> list[str]:
        found = self.store.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True))
        names = (f.path[len(self.root) + 1 :] for f in found if f.type == fs.FileType.File and f.size)
        return sorted(n for n in names if not any(p.startswith(("_", ".")) for p in n.split("/")))

    def dealt(self, names: list[str]) -> list[Files]:
        return [Files(names[i : i + self.each]) for i in range(0, len(names), self.each)] or [Files([])]

    def rows(self, part: Files) -> Iterator[tuple[str, str]]:
        for name in part.names:
            with self.store.open_input_stream(f"{self.root}/{name}") as f:
                yield name, f.read().decode("utf-8", "replace")


class SnapshotReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = _Folder(options)

    def partitions(self) -> list[Files]:
        return self.folder.dealt(self.folder.listed())

    def read(self, partition: Files) -> Iterator[tuple[str, str]]:
        return self.folder.rows(partition)


class SnapshotStream(DataSourceStreamReader):
    """The offset is the name of the last snapshot; a snapshot that sorts before one seen is not read."""

    def __init__(self, options: dict):
        self.folder = _Folder(options)

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        return {"last": max(self.folder.listed(), default="")}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.folder.dealt([n for n in self.folder.listed() if start["last"] < n <= end["last"]])

    def read(self, partition: Files) -> Iterator[tuple[str, str]]:
        return self.folder.rows(partition)

    def commit(self, end: dict) -> None:
        """Snapshots stay where they are."""


class SnapshotSource(DataSource):
    """``spark.read.format("snapshots").load(folder)`` and ``readStream`` alike: ``snapshot`` (its path in the folder) and ``value``."""

    @classmethod
    def name(cls) -> str:
        return "snapshots"

    def schema(self) -> str:
        return "snapshot string, value string"

    def reader(self, schema) -> SnapshotReader:
        return SnapshotReader(dict(self.options))

    def streamReader(self, schema) -> SnapshotStream:
        return SnapshotStream(dict(self.options))


def prices(snapshots: DataFrame) -> DataFrame:
    """``snapshot, pos, model, prompt, completion`` of price lists; a text that is no list has no rows, a price that is no number is null."""
    return price_list(snapshots, "value", "snapshot")


def newest(rows: DataFrame, key: str, by: str = "snapshot") -> DataFrame:
    """The row of each key from its last snapshot; maxima combine before the shuffle."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), by).alias("row")).select(key, "row.*")


def rates(snapshots: DataFrame) -> DataFrame:
    """``snapshot, currency, rate`` of feeds of exchange rates against the dollar."""
    found = F.from_json("value", "rates map<string,double>")["rates"]
    return snapshots.select("snapshot", F.explode(found).alias("currency", "rate")).filter("rate > 0")


def rate_of(currency: str | Column, known: Column | None = None) -> Column:
    """The rate of a currency from a map of live ones, else the fixed one; null where neither has it."""
    code = currency if isinstance(currency, Column) else F.col(currency)
    fixed = F.create_map(*(F.lit(x) for pair in RATES.items() for x in pair))[code]
    return fixed if known is None else F.coalesce(known[code], fixed)


_ENTRY = "timestamp string, severity string, textPayload string, jsonPayload struct<message:string>, protoPayload struct<resourceName:string>, httpRequest struct<requestMethod:string,requestUrl:string,status:string,latency:string>"


def log_entries(snapshots: DataFrame) -> DataFrame:
    """``snapshot, at, severity, message`` of service logs: a request's line, else the text, the message or the resource that the entry names."""
    each = snapshots.select("snapshot", F.explode(F.from_json("value", f"array<struct<{_ENTRY.replace(' string', ':string').replace(' struct', ':struct')}>>")).alias("e")).select("snapshot", "e.*")
    http, blank = F.col("httpRequest"), F.lit("")
    line = log_line(F.coalesce(http["requestMethod"], F.lit("GET")), F.coalesce(http["requestUrl"], blank), F.coalesce(http["status"], blank), F.coalesce(http["latency"], blank))
    said = F.coalesce(F.nullif("textPayload", blank), F.nullif(F.col("jsonPayload.message"), blank), F.col("protoPayload.resourceName"), blank)
    return each.select("snapshot", F.try_to_timestamp("timestamp").alias("at"), F.coalesce("severity", F.lit("DEFAULT")).alias("severity"), F.when(http.isNotNull(), line).otherwise(said).alias("message"))


def newest_entries(entries: DataFrame, most: int = 100) -> DataFrame:
    """The newest entries, oldest of them first; ties by message."""
    return entries.orderBy(F.desc("at"), F.desc("message")).limit(most).orderBy("at", "message")
