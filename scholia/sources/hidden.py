"""Files whose name or folder Spark's own scans pass over, as a batch and a stream source.

Spark skips every file and folder named ``_...`` or ``....``.  The readers of
``scholia.sources.corpus`` and ``scholia.streaming`` take the rest with Spark's text
source and add what this source finds.  Listing returns paths only; the files
are read in the tasks, a bounded number to a partition.

Files are opened by pyarrow, so in stores it does not know ``hidden=False`` has to be
given to those readers.

The stream's offset is the last modification time and path it has given out.  A file
that arrives later with an older time than that is not seen; give it a new time.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "hidden_texts"
#: Files read by one task.
FILES = 64


def is_hidden(part: str) -> bool:
    """Whether Spark's scans pass over a file or folder of this name."""
    if part.startswith(("_common_metadata", "_metadata")):
        return False
    return part.startswith(".") or (part.startswith("_") and "=" not in part) or part.endswith("._COPYING_")


def _file_system(root: str):
    """File system of a path or URI, and the path in it."""
    from pyarrow import fs

    root = re.sub(r"^s3[an]://", "s3://", root)
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def hidden_files(root: str, extensions: list[str], recursive: bool) -> list[tuple[int, str]]:
    """(modification time in ns, path below the root) of hidden files with an ending, oldest first."""
    from pyarrow import fs

    system, base = _file_system(root)
    found = []
    for info in system.get_file_info(fs.FileSelector(base, recursive=recursive, allow_not_found=True)):
        if info.type != fs.FileType.File or not info.path.endswith(tuple(extensions)):
            continue
        rel = os.path.relpath(info.path, base).replace(os.sep, "/")
        if any(map(is_hidden, rel.split("/"))):
            found.append((info.mtime_ns or 0, rel))
    return sorted(found)


class Files(InputPartition):
    """Paths that one task reads."""

    def __init__(self, paths: list[str]):
        self.paths = paths


def _parts(paths: list[str]) -> list[Files]:
    return [Files(paths[i : i + FILES]) for i in range(0, len(paths), FILES)]


class _Options:
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.extensions = json.loads(options["extensions"])
        self.recursive = options.get("recursive", "true") == "true"
        self.files_per_batch = int(options.get("filesPerBatch", "1000"))

    def listed(self) -> list[tuple[int, str]]:
        return hidden_files(self.root, self.extensions, self.recursive)

    def texts(self, part: Files | None) -> Iterator[tuple[str, str]]:
        if part is None:  # what a read without partitions gets
            return
        system, base = _file_system(self.root)
        for rel in part.paths:
            with system.open_input_stream(f"{base}/{rel}") as f:
                yield rel, f.read().decode("utf-8", "replace")


class HiddenReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.of = _Options(options)

    def partitions(self) -> list[Files]:
        return _parts([rel for _, rel in self.of.listed()])

    def read(self, partition: Files) -> Iterator[tuple[str, str]]:
        return self.of.texts(partition)


class HiddenStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.of = _Options(options)
        self.given: dict | None = None

    def initialOffset(self) -> dict:
        return {"at": -1, "path": ""}

    def latestOffset(self) -> dict:
        """The place after the next files; every call goes on by one batch at most."""
        last = self.given or self.initialOffset()
        new = [f for f in self.of.listed() if f > (last["at"], last["path"])]
        if new:
            at, path = new[: self.of.files_per_batch][-1]
            self.given = {"at": at, "path": path}
        return self.given or last

    def partitions(self, start: dict, end: dict) -> list[Files]:
        self.given = end
        low, high = (start["at"], start["path"]), (end["at"], end["path"])
        return _parts([rel for at, rel in self.of.listed() if low < (at, rel) <= high])

    def read(self, partition: Files) -> Iterator[tuple[str, str]]:
        return self.of.texts(partition)


class HiddenTexts(DataSource):
    """``rel_path, text`` of hidden files."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "rel_path string, text string"

    def reader(self, schema) -> HiddenReader:
        return HiddenReader(dict(self.options))

    def streamReader(self, schema) -> HiddenStream:
        return HiddenStream(dict(self.options))


def hidden_texts(spark: SparkSession, root: str, extensions: list[str], recursive: bool = True, stream: bool = False, files_per_batch: int = 1000) -> DataFrame:
    """``rel_path, text`` of the hidden files below a root."""
    spark.dataSource.register(HiddenTexts)
    reader = (spark.readStream if stream else spark.read).format(NAME)
    options = {"path": root, "extensions": json.dumps(list(extensions)), "recursive": str(recursive).lower(), "filesPerBatch": str(files_per_batch)}
    return reader.options(**options).load()
