"""Spark data sources: container headers by ranged reads of each file's first bytes, decoded pictures, and a sink that writes files.

spark.dataSource.register(Headers); spark.read.format("media_headers").load(folder)
spark.dataSource.register(Pixels); spark.read.format("media_pixels").option("first_only", "true").load(folder)
df.select("name", "content").write.format("media_files").mode("append").save(folder)
"""

from __future__ import annotations

import re

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.bits import Invalid, Unsupported
from ..operators.lossy import Tables
from . import container as box
from . import media

SCHEMA = "path string, length long, width int, height int, has_alpha boolean, animated boolean, n_frames int, codec string, error_class string, bytes_read long"
#: Files that a partition lists.
PER_PARTITION = 256


def uri(path: str) -> str:
    """A path as a file system's address; one without a scheme is local."""
    return path if "://" in path else f"file://{path.removeprefix('file:')}"


class _Files(InputPartition):
    def __init__(self, paths: list[tuple[str, int]]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(uri(self.path))

    def partitions(self) -> list[_Files]:
        from pyarrow import fs

        where, root = self._open()
        info = where.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File)
        return [_Files(files[k : k + PER_PARTITION]) for k in range(0, len(files), PER_PARTITION)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        where, _ = self._open()
        for path, length in partition.paths:
            used = 0
            with where.open_input_file(path) as f:

                def ranged(at: int, n: int) -> bytes:
                    nonlocal used
                    f.seek(min(at, length))
                    got = f.read(n)
                    used += len(got)
                    return got

                try:
                    x = box.features(box.Bytes(ranged, length))
                    yield path, length, x.width, x.height, x.has_alpha, x.animated, x.n_frames, x.codec, None, used
                except Unsupported:
                    yield path, length, None, None, None, None, None, None, "UNSUPPORTED", used
                except Invalid:
                    yield path, length, None, None, None, None, None, None, "INVALID", used


class Headers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


class _PixelReader(_Reader):
    """Whole files, decoded; options are those of media.DecodeOptions, and `tables`, a text that lists the lossy format's tables."""

    def __init__(self, path: str, options: dict[str, str]):
        super().__init__(path)
        flag = lambda name: options.get(name, "false").lower() == "true"
        number = lambda name: int(options.get(name, "0"))
        # option names come without capitals
        self.options = media.DecodeOptions(auto_rotate=flag("auto_rotate"), alpha_dither=number("alpha_dither"), size_limit=number("size_limit"), first_only=flag("first_only"), premultiplied=flag("premultiplied"))
        self.tables = Tables.read(options["tables"]) if "tables" in options else None

    def read(self, partition: _Files) -> Iterator[tuple]:
        where, _ = self._open()
        for path, _ in partition.paths:
            with where.open_input_file(path) as f:
                data = f.read()
            try:
                for k, (delay, rgba) in enumerate(media.decode(data, self.options, self.tables)):
                    yield path, k, delay, rgba.shape[1], rgba.shape[0], rgba.tobytes(), None
            except tuple(k for k, _ in media.CLASSES) as e:
                yield path, None, None, None, None, None, media.error_class(e)


class Pixels(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_pixels"

    def schema(self) -> str:
        return "path string, frame_no int, delay_ms int, width int, height int, rgba binary, error_class string"

    def reader(self, schema) -> _PixelReader:
        return _PixelReader(self.options["path"], dict(self.options))


class _Writer(DataSourceWriter):
    """Each row's bytes under its name; a file is put in place by a rename, so a task that runs again writes the same files."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        where, root = self._open()
        where.create_dir(root)
        for row in iterator:
            part = f"{root}/_{TaskContext.get().taskAttemptId()}-{row.name}"
            with where.open_output_stream(part) as f:
                f.write(bytes(row.content))
            where.move(part, f"{root}/{row.name}")
        return WriterCommitMessage()

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(uri(self.path))

    def _swept(self) -> None:
        """Deletes what tasks that failed have left."""
        from pyarrow import fs

        where, root = self._open()
        for f in where.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if re.match(r"_\d+-", f.base_name):
                where.delete_file(f.path)

    def commit(self, messages: list) -> None:
        self._swept()

    def abort(self, messages: list) -> None:
        self._swept()


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])
