"""Event files as a source that tells, for every document, its file and the byte where it begins.

Documents stand one after the other in a file and may span lines. Files are split into byte ranges, one task each, so one
large file is read by many tasks: a range owns the pieces that begin in it, and reads on beyond its end for the last one. A
piece begins where an ``<event`` tag opens and after each ``</event>``; what stands between documents, or of a document that
was cut off, is a piece of its own, so nothing is lost and ``event_rejects`` finds it. (Writers of XML escape ``<`` in values;
an unescaped ``<event`` inside a CDATA section would be taken for a beginning.)

Files whose names end in ``.gz`` are rolled over and complete: one task reads such a file whole, and offsets in it count its
content. As a stream the offset is a byte for each file, always behind an ``</event>``: a file that grows is read on from there, and a
document that is still being written waits for its end. The driver lists the folder and, of files that have grown, reads the
tail. A compressed file is taken up once, whole, when it is found; its offset is its size, and it must not change. An offset
has an entry per file in the folder; files that are removed leave it.
"""

from __future__ import annotations

import fnmatch
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "event_files"
SCHEMA = "event_xml string, file string, file_offset long"
RANGE_BYTES = 64 << 20
BLOCK = 4 << 20
GZIP = ".gz"
END = b"</event>"
_MARK = re.compile(rb"</event>|<event(?=[\s>])")


def pieces(handle, start: int, stop: int, size: int, block: int = BLOCK) -> Iterator[tuple[int, bytes]]:
    """(byte, content) of the pieces that begin in ``[start, stop)`` of a file of which ``size`` bytes count."""
    base = max(0, start - len(END))
    if base:  # compressed files are read from their beginning
        handle.seek(base)
    buffer, looked, begin = b"", 0, 0 if start == 0 else None
    while True:
        more = handle.read(max(0, min(block, size - base - len(buffer))))
        buffer += more
        last = not more or base + len(buffer) >= size
        sure = len(buffer) if last else max(0, len(buffer) - len(END))  # marks from here on may be incomplete
        for mark in _MARK.finditer(buffer, looked):
            if mark.start() >= sure:
                break
            looked = mark.end()
            at = base + (mark.end() if mark[0] == END else mark.start())
            if at < start:
                continue
            if begin is not None and at > begin:
                yield begin, buffer[begin - base:at - base]
            begin = at
            if begin >= stop:
                return
        if last:
            if begin is not None and begin < stop:
                yield begin, buffer[begin - base:]
            return
        looked = max(looked, sure)
        done = looked if begin is None else begin - base
        base, buffer, looked = base + done, buffer[done:], max(0, looked - done)


def last_end(handle, size: int, block: int = BLOCK) -> int:
    """The byte behind the last ``</event>`` among the first ``size`` bytes; 0 without any. Reads from the end."""
    stop = size
    while stop > 0:
        start = max(0, stop - block)
        handle.seek(start)
        found = handle.read(min(size, stop + len(END) - 1) - start).rfind(END)
        if found >= 0:
            return start + found + len(END)
        stop = start
    return 0


@dataclass
class ByteRange(InputPartition):
    file: str
    start: int
    stop: int
    size: int
    after: int = -1  # documents up to this byte are known already


class _Files:
    """What batch and stream have in common: the files of ``path``, their ranges, and reading a range."""

    def __init__(self, options: dict[str, str]):
        self.path = re.sub("^file:/+", "/", options["path"])
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def open_folder(self):
        from pyarrow import fs
        folder, _, name = self.path.rpartition("/")
        if not any(c in name for c in "*?["):
            folder, name = self.path, "*"
        return (*fs.FileSystem.from_uri(folder or "/"), name)

    def sizes(self) -> dict[str, int]:
        """Files by name; names that begin with a dot or an underscore are left out, a missing folder is empty."""
        from pyarrow import fs
        files, folder, pattern = self.open_folder()
        info = files.get_file_info(folder)
        found = [info] if info.is_file else files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return {f.path: f.size for f in sorted(found, key=lambda f: f.path)
                if f.is_file and f.base_name[0] not in "._" and (info.is_file or fnmatch.fnmatchcase(f.base_name, pattern))}

    def ranges(self, file: str, start: int, size: int, after: int = -1) -> list[ByteRange]:
        if file.endswith(GZIP):
            return [ByteRange(file, 0, sys.maxsize, sys.maxsize, after)]
        return [ByteRange(file, a, min(size, a + self.range_bytes), size, after) for a in range(start, size, self.range_bytes)]

    def read(self, part: ByteRange):
        import pyarrow as pa
        files = self.open_folder()[0]

        def batch(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([x.decode("utf-8", "replace") for _, x in rows], pa.string()), pa.array([part.file] * len(rows), pa.string()),
                 pa.array([at for at, _ in rows], pa.int64())], ["event_xml", "file", "file_offset"])

        rows, held = [], 0
        packed = part.file.endswith(GZIP)
        with files.open_input_stream(part.file, compression="gzip") if packed else files.open_input_file(part.file) as handle:
            for begin, raw in pieces(handle, part.start, part.stop, part.size):
                text = raw.strip()
                at = begin + len(raw) - len(raw.lstrip())
                if not text or at <= part.after:
                    continue
                rows.append((at, text))
                held += len(text)
                if held >= BLOCK:
                    yield batch(rows)
                    rows, held = [], 0
        yield batch(rows)


class _Batch(_Files, DataSourceReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.after_file, self.after = options.get("afterfile"), int(options.get("afteroffset", -1))

    def partitions(self) -> list[ByteRange]:
        found = []
        for file, size in self.sizes().items():
            if self.after_file is None or file > self.after_file:
                found += self.ranges(file, 0, size)
            elif file == self.after_file:
                found += self.ranges(file, max(0, self.after), size, self.after)
        return found or [ByteRange("", 0, 0, 0)]

    def read(self, part: ByteRange):
        return super().read(part) if part.file else iter(())


class _Stream(_Files, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.seen: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        files, sizes = self.open_folder()[0], self.sizes()
        for file, size in sizes.items():
            if file.endswith(GZIP):
                self.seen[file] = (size, size)
            elif self.seen.get(file, (-1, 0))[0] != size:
                with files.open_input_file(file) as handle:
                    self.seen[file] = (size, last_end(handle, size))
        self.seen = {file: self.seen[file] for file in sizes}
        return {"files": {file: end for file, (_, end) in self.seen.items() if end}}

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        found = []
        for file, stop in end["files"].items():
            begin = start["files"].get(file, 0)
            if stop < begin:
                raise ValueError(f"{file} is shorter than what has been read of it")
            if file.endswith(GZIP) and begin:
                if stop != begin:
                    raise ValueError(f"{file} is compressed and has changed since it was read")
                continue
            found += self.ranges(file, begin, stop)
        return found

    def commit(self, end: dict) -> None:
        pass


class EventFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream({k.lower(): v for k, v in self.options.items()})


def _registered(spark: SparkSession) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package
    spark.dataSource.register(EventFiles)


def read_event_files(
    spark: SparkSession, path: str, after: tuple[str, int] | None = None, range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """``event_xml, file, file_offset`` of all event files in ``path``: a folder, a file, or a folder with a name pattern.

    ``after`` is the file and offset of a document that was read before: only documents behind it are read, in that file and
    in files whose names come later, as rolled-over files do. Empty files and folders give no rows.
    """
    _registered(spark)
    reader = spark.read.format(NAME).option("rangeBytes", range_bytes)
    if after:
        reader = reader.option("afterFile", after[0]).option("afterOffset", after[1])
    return reader.load(path)


def stream_event_files(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The same columns as a stream that goes on in files that grow and takes up new ones. A file must not shrink."""
    _registered(spark)
    return spark.readStream.format(NAME).option("rangeBytes", range_bytes).load(path)
