"""A data source that writes a bundle: tasks write parts, the commit a manifest, an abort leaves nothing.

Each task writes the files of its rows into one ZIP, their entries as JSON lines and their sections of the
master text, under names of its own attempt. The commit gets the names and counts alone: it removes what other
attempts left and writes ``manifest.json``, which lists the parts in order. So the bundle is
there once the manifest is, a task that is run again costs nothing but its own part, and no text passes the driver.
"""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Columns of the rows; ``section`` and ``entry`` are set on one row a document.
COLUMNS = "ordinal long, path string, content string, section string, entry string, pages long, cost double"


@dataclass
class Part(WriterCommitMessage):
    name: str
    files: int
    documents: int
    pages: int
    cost: float
    first: int
    last: int


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class BundleWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.folder, self.opening, self.exported_at = options["folder"].rstrip("/"), options.get("opening", ""), options.get("exported_at", "")

    def write(self, iterator: Iterator) -> Part:
        store, root = _place(self.folder)
        store.create_dir(f"{root}/parts", recursive=True)
        name = uuid.uuid4().hex
        try:
            return self._write(iterator, store, root, name)
        except BaseException:
            for kind in ("zip", "jsonl", "md"):
                if store.get_file_info(f"{root}/parts/{name}.{kind}").type == fs.FileType.File:
                    store.delete_file(f"{root}/parts/{name}.{kind}")
            raise

    def _write(self, iterator: Iterator, store: fs.FileSystem, root: str, name: str) -> Part:
        files, documents, pages, cost, seen = 0, 0, 0, 0.0, []
        with (
            store.open_output_stream(f"{root}/parts/{name}.zip") as raw,
            zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as bundle,
            store.open_output_stream(f"{root}/parts/{name}.jsonl") as entries,
            store.open_output_stream(f"{root}/parts/{name}.md") as master,
        ):
            for row in iterator:
                bundle.writestr(row["path"], row["content"])
                files += 1
                seen = [min(seen[0], row["ordinal"]), max(seen[1], row["ordinal"])] if seen else [row["ordinal"]] * 2
                if row["entry"] is not None:
                    entries.write((row["entry"] + "\n").encode("utf-8", "surrogatepass"))
                    master.write(row["section"].encode("utf-8", "surrogatepass"))
                    documents, pages, cost = documents + 1, pages + row["pages"], cost + row["cost"]
        return Part(name, files, documents, pages, cost, *(seen or [0, 0]))

    def commit(self, messages: list[Part | None]) -> None:
        store, root = _place(self.folder)
        parts = sorted((m for m in messages if m and m.files), key=lambda m: m.first)
        self._keep({m.name for m in parts})
        told = {
            "exported_at": self.exported_at,
            "document_count": sum(m.documents for m in parts),
            "total_cost_usd": round(sum(m.cost for m in parts), 6),
            "total_pages": sum(m.pages for m in parts),
            "opening": self.opening,
            "parts": [{"files": f"parts/{m.name}.zip", "entries": f"parts/{m.name}.jsonl", "master": f"parts/{m.name}.md", "documents": m.documents, "first": m.first, "last": m.last} for m in parts],
        }
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/manifest.json") as out:
            out.write(json.dumps(told, indent=2).encode())

    def abort(self, messages: list[Part | None]) -> None:
        self._keep(set())

    def _keep(self, names: set[str]) -> None:
        """Parts of other attempts go."""
        store, root = _place(self.folder)
        for found in store.get_file_info(fs.FileSelector(f"{root}/parts", allow_not_found=True)):
            if found.base_name.split(".")[0] not in names:
                store.delete_file(found.path)


class BundleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bundle"

    def schema(self) -> str:
        return COLUMNS

    def writer(self, schema, overwrite: bool) -> BundleWriter:
        return BundleWriter(dict(self.options))


def master_text(folder: str) -> Iterator[bytes]:
    """The master text of a written bundle, piece by piece."""
    store, root = _place(folder.rstrip("/"))
    with store.open_input_stream(f"{root}/manifest.json") as f:
        told = json.loads(f.read())
    yield told["opening"].encode()
    for part in told["parts"]:
        with store.open_input_stream(f"{root}/{part['master']}") as f:
            while piece := f.read(1 << 20):
                yield piece
