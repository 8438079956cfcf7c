"""The engine's sources and sink as Spark data sources: format("sprite") reads, format("timeline") writes."""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import reader


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


@dataclass
class Files(InputPartition):
    paths: list[str]


class SpriteSource(DataSource):
    """Documents of a folder as the rows that reader.tables() takes. Options: path, files (files of a partition, 16)."""

    @classmethod
    def name(cls) -> str:
        return "sprite"

    def schema(self) -> str:
        return reader.ROWS

    def reader(self, schema: StructType) -> DataSourceReader:
        return SpriteReader(self.options)


class SpriteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("files", 16))

    def partitions(self) -> list[InputPartition]:
        fs, base = _open(self.path)
        infos = fs.get_file_info(pafs.FileSelector(base, recursive=True))
        kinds = tuple(f".{k}" for k in reader.IMPORTERS)
        paths = sorted(i.path for i in infos if i.is_file and i.path.lower().endswith(kinds))
        return [Files(paths[k : k + self.step]) for k in range(0, len(paths), self.step)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.path)

        def rows() -> Iterator[dict]:
            for path in partition.paths:
                kind = path.rpartition(".")[2].lower()
                large = fs.get_file_info(path).size > reader.LARGEST.get(kind, (1 << 31) - 1)
                content = b"" if large else fs.open_input_stream(path).read()
                yield from reader.import_rows(path, kind, lambda: reader._import({"large": large, "kind": kind, "content": content}))

        yield from reader.batches(rows())


class TimelineSink(DataSource):
    """Writes rows project_id, content (of reader.export()) as files <name>.aseprite under path. A file has its name once it is whole.

    The name is that of the project's source without its suffix; where several rows of a write have one name, each has a digest
    of its project_id added. A file that is there already fails the write, unless its mode is overwrite. Rows whose content is null
    (an export error) have no file."""

    @classmethod
    def name(cls) -> str:
        return "timeline"

    def schema(self) -> str:
        return "project_id string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return TimelineWriter(self.options, overwrite)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # the file as it was written, and its project_id


class TimelineWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, rows: Iterator) -> Written:
        fs, base = _open(self.path)
        fs.create_dir(base, recursive=True)
        files = []
        for r in rows:
            if r["content"] is None:
                continue
            part = f"{base}/.{uuid.uuid4().hex}.part"
            with fs.open_output_stream(part) as out:
                out.write(bytes(r["content"]))
            files.append((part, r["project_id"]))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = _open(self.path)
        files = [f for m in messages for f in (m.files if m else ())]
        times = Counter(reader.default_name(p).lower() for _, p in files)
        names = {}
        for part, project in files:
            name = reader.default_name(project)
            if times[name.lower()] > 1:
                name += "-" + hashlib.sha256(project.encode()).hexdigest()[:16]
            names[part] = f"{base}/{name}.aseprite"
        there = [i.path for i in fs.get_file_info(list(names.values())) if i.type != pafs.FileType.NotFound] if names else []
        if len(set(names.values())) < len(names) or (there and not self.overwrite):
            self.abort(messages)
            raise FileExistsError(f"a timeline document of this name is there already: {there[0] if there else 'a project_id repeats'}")
        for part, name in names.items():
            fs.move(part, name)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = _open(self.path)
        for m in messages:
            for part, _ in m.files if m else ():
                fs.delete_file(part)


def register(spark: SparkSession) -> None:
    for source in (SpriteSource, TimelineSink):
        spark.dataSource.register(source)
