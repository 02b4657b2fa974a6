"""Page trees and chapter files as data sources.

`page_tree` reads stored pages (<root>/.../*.html) as url, path and html, a partition for each run of files of about SPLIT bytes. `chapter_files` writes
chapters as <root>/<volume>/<slug>/<number>.json, which `read_chapters` reads. A task writes into a staging folder of its own and hands the names to the
commit; only when every task has ended are the files moved to their places, each by one rename, so a task that fails, or a job that is
stopped, leaves nothing that looks like a chapter.

    register(spark)
    spark.read.format("page_tree").option("prefix", "https://h.org/study/").load(root)
    rows.write.format("chapter_files").mode("append").save(root)

Files are reached through pyarrow: local and shared folders by path, other stores by URI. Chapters of the same place replace what is there. Null fields
aren't written; a null volume, slug or file_number is an error, and so are two rows of one place in one write.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import schemas

SPLIT = 32 << 20
STAGING = "_staging"
PLACE = ("volume", "slug", "file_number")


def _system(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


@dataclass
class Files(InputPartition):
    names: list[str]


class PageTreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.prefix, self.split = options["path"].rstrip("/"), options.get("prefix", ""), int(options.get("split", SPLIT))

    def partitions(self) -> list[Files]:
        system, at = _system(self.root)
        found = system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
        out, names, size = [], [], 0
        for f in sorted((f for f in found if f.is_file and f.extension == "html"), key=lambda f: f.path):
            if names and size + f.size > self.split:
                out.append(Files(names))
                names, size = [], 0
            names.append(f.path)
            size += f.size
        return [*out, Files(names)]  # an empty list of partitions would be read as one without a name

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, at = _system(self.root)
        for name in partition.names:
            with system.open_input_stream(name) as f:
                text = f.read().decode("utf-8", "replace")
            path = name.removeprefix(at).lstrip("/")
            yield pa.RecordBatch.from_arrays([pa.array([self.prefix + path.removesuffix(".html")]), pa.array([path]), pa.array([text])], ["url", "path", "html"])


class PageTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_tree"

    def schema(self) -> str:
        return "url string, path string, html string"

    def reader(self, schema) -> PageTreeReader:
        return PageTreeReader(self.options)


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    names: list[str]


def _plain(value):
    """A row's values as JSON has them; null fields of structs are left out."""
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items() if v is not None}
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value


class ChapterWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.root, self.overwrite = options["path"].rstrip("/"), overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Staged:
        system, at = _system(self.root)
        folder, names = f"{at}/{STAGING}/{self.job}/{uuid.uuid4().hex}", []
        for row in iterator:
            place = [row[c] for c in PLACE]
            if any(p is None for p in place) or any("/" in str(p) or str(p) in ("", ".", "..") for p in place):
                raise ValueError(f"not a place for a chapter: {place}")
            name = "{}/{}/{}.json".format(*place)
            system.create_dir(f"{folder}/{place[0]}/{place[1]}", recursive=True)
            held = {k: _plain(v) for k, v in row.asDict().items() if k not in PLACE and v is not None}
            with system.open_output_stream(f"{folder}/{name}") as f:
                f.write((json.dumps(held, ensure_ascii=False, indent=2) + "\n").encode())
            names.append(name)
        return Staged(folder, names)

    def commit(self, messages: list[Staged | None]) -> None:
        system, at = _system(self.root)
        times = Counter(n for m in messages if m for n in m.names)
        twice = min((n for n, k in times.items() if k > 1), default=None)
        if twice:
            self.abort(messages)
            raise ValueError(f"two rows for {twice}")
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
                if info.base_name != STAGING:
                    system.delete_dir(info.path) if info.type == fs.FileType.Directory else system.delete_file(info.path)
        for m in messages:
            for n in m.names if m else []:
                system.create_dir(f"{at}/{n.rsplit('/', 1)[0]}", recursive=True)
                system.move(f"{m.folder}/{n}", f"{at}/{n}")
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, at = _system(self.root)
        if system.get_file_info(f"{at}/{STAGING}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/{STAGING}/{self.job}")
        if not system.get_file_info(fs.FileSelector(f"{at}/{STAGING}", allow_not_found=True)):
            if system.get_file_info(f"{at}/{STAGING}").type == fs.FileType.Directory:
                system.delete_dir(f"{at}/{STAGING}")


class ChapterFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chapter_files"

    def schema(self) -> str:
        return f"volume string, slug string, file_number int, {schemas.CHAPTER_FILE}"

    def writer(self, schema, overwrite: bool) -> ChapterWriter:
        return ChapterWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageTree)
    spark.dataSource.register(ChapterFiles)
