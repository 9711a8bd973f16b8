"""A batch source of log lines that cuts large files into ranges of bytes.

A range holds the lines that begin in it, so a file of any size is read by as many tasks as it has ranges, and small files share
a task. Lines are numbered within their range; `counts` has how many lines begin in each range of a file that has several, whose
prefix sums turn numbers of a range into those of the file (with countLast, those of its last range, too). Ranges are cut at multiples of splitBytes, so that a file that grows
between the two reads changes its last range only, on which no other range's numbers depend. headLines stops at so many lines a file,
and reads no further.

Files are listed and read with pyarrow's file systems, so any store that they know will do. A batch goes to Spark as Arrow, cut
at newlines without a Python object a line.

spark.dataSource.register(LineSource); spark.read.format("lines").option("path", folder).load()
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from itertools import groupby
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range; and those that are read from a file at once.
SPLIT_BYTES, CHUNK_BYTES = 64 * 1024 * 1024, 8 * 1024 * 1024

#: Ranges share tasks, however small they are, so that about so many tasks are filled before any takes more than its share; a task
#: takes no more than SPLIT_BYTES unless a range is larger.
TASKS = 64

#: Files that are dealt to one task, at most, however small.
SMALL_FILES = 4096

#: Folders of fragments that are dealt to one task, at most; and the tasks that are filled before any takes a second one.
FOLDERS, FOLDER_TASKS = 256, 32

#: Fragments go to Spark in batches of about so many bytes, or so many files.
FRAGMENT_BYTES, FRAGMENT_FILES = 4 * 1024 * 1024, 4096

#: The first bytes read where only the head is wanted, and beyond the end of a range; the next reads double.
HEAD_CHUNK, LINE_CHUNK = 64 * 1024, 4 * 1024

LINES = "file_path string, modified_at timestamp, range_start bigint, nth bigint, line string"
COUNTS = "file_path string, range_start bigint, lines bigint"
FRAGMENTS = "file_path string, text string"


@dataclass
class Range:
    path: str
    modified_at: datetime | None
    start: int
    end: int


class Ranges(InputPartition):
    def __init__(self, ranges: list[Range]) -> None:
        self.ranges = ranges


def file_system(uri: str):
    """pyarrow's file system of a path or URI, the path in it, and what stands before paths in URIs."""
    from pyarrow import fs

    whole = uri if "://" in uri else uri.replace("file:", "", 1) if uri.startswith("file:") else uri
    whole = whole if "://" in whole else f"file://{whole}"
    system, root = fs.FileSystem.from_uri(whole)
    return system, root, whole[: len(whole) - len(root)] if whole.endswith(root) else whole.split("://")[0] + "://"


def files_below(uri: str, pattern: str) -> Iterator[tuple[str, int, datetime | None]]:
    """(path, size, modified at) of each file below whose name matches; none where there is no such folder. A path may be a
    file, or have * in its parts, as in dated folders."""
    from pyarrow import fs

    system, root, _ = file_system(uri)
    stem = root.split("*", 1)[0].rsplit("/", 1)[0] if "*" in root else root
    info = system.get_file_info(stem)
    if info.is_file:
        yield info.path, info.size, info.mtime
        return
    for x in sorted(system.get_file_info(fs.FileSelector(stem, recursive=True, allow_not_found=True)), key=lambda x: x.path):
        if x.is_file and fnmatch.fnmatchcase(x.base_name, pattern) and (stem == root or fnmatch.fnmatchcase(x.path, root.rstrip("/") + "/*") or fnmatch.fnmatchcase(x.path, root)):
            yield x.path, x.size, x.mtime


def cut(path: str, size: int, modified_at: datetime | None, split: int) -> list[Range]:
    """The ranges of a file, at multiples of split; an empty file has none."""
    return [Range(path, modified_at, lo, min(size, lo + split)) for lo in range(0, size, split)]


def dealt(ranges: list[Range], split: int) -> list[Ranges]:
    """Ranges in tasks: neighbours together until their bytes make up a split, or a task's share of all if that is more."""
    out, held, load = [], [], 0
    split = max(split, min(SPLIT_BYTES, sum(r.end - r.start for r in ranges) // TASKS))
    for r in ranges:
        if held and (load + r.end - r.start > split or len(held) >= SMALL_FILES):
            out.append(Ranges(held))
            held, load = [], 0
        held.append(r)
        load += r.end - r.start
    return out + [Ranges(held)] if held else out


def first_start(read, r: Range) -> int:
    """Where the first line of a range begins; its end, or beyond, if none does."""
    if r.start == 0:
        return 0
    at, step = r.start - 1, LINE_CHUNK
    while at < r.end:
        data = read(at, min(step, r.end - at))
        step = min(2 * step, CHUNK_BYTES)
        found = data.find(b"\n")
        if found >= 0:
            return at + found + 1
        if not data:
            break
        at += len(data)
    return r.end


def chunks(read, r: Range, size: int, most: int | None) -> Iterator[bytes]:
    """The lines that begin in a range, a chunk of whole ones at a time; the last may lack its newline. most: how many lines
    are wanted, which bounds what is read."""
    at, rest, left = first_start(read, r), b"", most
    if at >= r.end:
        return
    # begun: where rest begins; a small range takes little more than itself, to the end of its last line
    begun, step = at, min(CHUNK_BYTES, r.end - at + LINE_CHUNK) if most is None else HEAD_CHUNK
    while left is None or left > 0:
        data = read(at, min(step, size - at)) if at < size else b""
        at += len(data)
        step = min(2 * step, CHUNK_BYTES)
        rest += data
        whole = rest.rfind(b"\n") + 1
        if not data:
            if rest:
                yield rest
            return
        if begun + whole > r.end:  # up to the first line that begins in the next range
            inside = rest.find(b"\n", max(0, r.end - begun - 1)) + 1
            if inside:
                yield rest[:inside]
                return
        elif whole:
            if left is not None:
                left -= rest.count(b"\n", 0, whole)
            yield rest[:whole]
            begun, rest = begun + whole, rest[whole:]
            if begun >= r.end:
                return


def cut_lines(chunk: bytes) -> pa.Array:
    """The lines of a chunk, without their newlines; bytes that are no UTF-8 are replaced."""
    try:
        chunk.decode()
    except UnicodeDecodeError:
        chunk = chunk.decode("utf-8", "replace").encode()
    data = np.frombuffer(chunk, np.uint8)
    ends = np.flatnonzero(data == 10)
    if not len(ends) or ends[-1] != len(data) - 1:
        ends = np.append(ends, len(data))
    # newlines go, so a line's end is the next one's start
    offsets = np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int64)
    kept = data[data != 10]
    return pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).cast(pa.string())


class LineReader(DataSourceReader):
    def __init__(self, options: dict, counts: bool) -> None:
        self.uri, self.pattern, self.counts = options["path"], options.get("pattern", "*.jsonl"), counts
        self.split = max(1, int(options.get("splitbytes", SPLIT_BYTES)))
        self.count_last = bool(options.get("countlast"))
        self.head = int(options["headlines"]) if "headlines" in options else None

    def partitions(self) -> list[Ranges]:
        ranges = []
        for path, size, modified_at in files_below(self.uri, self.pattern):
            of_file = cut(path, size, modified_at, self.split)
            if self.head is not None:
                of_file = [Range(path, modified_at, 0, size)] if size else []
            ranges += of_file[:-1] if self.counts and not self.count_last else of_file  # after a file's last range, nothing is numbered
        return dealt(ranges, self.split) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, _, prefix = file_system(self.uri)
        counted = []
        for path, ranges in groupby(partition.ranges, attrgetter("path")):
            try:
                file = system.open_input_file(path)
            except OSError:  # gone, or not to be read: skipped, as the reader of one file would
                continue
            with file:
                read = lambda at, n, file=file: file.read_at(n, at)
                for r in ranges:
                    if self.counts:
                        counted.append((prefix + path, r.start, self.counted(read, r)))
                    else:
                        yield from self.lines(read, r, file.size(), prefix)
        if counted:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*counted, strict=True)], names=["file_path", "range_start", "lines"])

    def counted(self, read, r: Range) -> int:
        lines, at = int(r.start == 0), max(0, r.start - 1)
        while at < r.end - 1:
            data = read(at, min(CHUNK_BYTES, r.end - 1 - at))
            if not data:
                break
            lines += data.count(b"\n")
            at += len(data)
        return lines

    def lines(self, read, r: Range, size: int, prefix: str) -> Iterator[pa.RecordBatch]:
        nth = 0
        for chunk in chunks(read, r, size, self.head):
            found = cut_lines(chunk)
            if self.head is not None:
                found = found[: self.head - nth]
            n = len(found)
            when = r.modified_at.astimezone(UTC) if r.modified_at else None
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(prefix + r.path), n), pa.array([when] * n, pa.timestamp("us", "UTC")), pa.repeat(pa.scalar(r.start), n), pa.array(np.arange(nth, nth + n)), found],
                names=["file_path", "modified_at", "range_start", "nth", "line"],
            )
            nth += n


class LineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return COUNTS if self.options.get("counts") else LINES

    def reader(self, schema) -> LineReader:
        return LineReader(dict(self.options), bool(self.options.get("counts")))


class Folders(InputPartition):
    def __init__(self, folders: list[str], files: list[str]) -> None:
        self.folders, self.files = folders, files


class FragmentReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.uri, self.pattern = options["path"], options.get("pattern", "*.json")

    def partitions(self) -> list[Folders]:
        from pyarrow import fs

        system, root, _ = file_system(self.uri)
        found = sorted(system.get_file_info(fs.FileSelector(root, allow_not_found=True)), key=lambda x: x.path)
        folders, files = [x.path for x in found if x.type == fs.FileType.Directory], [x.path for x in found if x.is_file and fnmatch.fnmatchcase(x.base_name, self.pattern)]
        n, m = min(FOLDERS, max(1, -(-len(folders) // FOLDER_TASKS))), SMALL_FILES
        return [Folders(folders[k : k + n], []) for k in range(0, len(folders), n)] + [Folders([], files[k : k + m]) for k in range(0, len(files), m)] or [Folders([], [])]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _, prefix = file_system(self.uri)

        def below() -> Iterator[str]:
            yield from partition.files
            for folder in partition.folders:
                for x in system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)):
                    if x.is_file and fnmatch.fnmatchcase(x.base_name, self.pattern):
                        yield x.path

        batch = lambda paths, texts: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], names=["file_path", "text"])
        paths, texts, load = [], [], 0
        for path in below():
            try:
                with system.open_input_stream(path) as file:
                    text = file.read().decode("utf-8", "replace")
            except OSError:  # gone, or not to be read
                continue
            paths.append(prefix + path)
            texts.append(text.removeprefix("\ufeff"))
            load += len(text)
            if load >= FRAGMENT_BYTES or len(paths) >= FRAGMENT_FILES:
                yield batch(paths, texts)
                paths, texts, load = [], [], 0
        if paths:
            yield batch(paths, texts)


class FragmentSource(DataSource):
    """Whole files, one a row: of stores that keep a file a record. The driver lists the first level alone; what is in its folders,
    the tasks list that read them."""

    @classmethod
    def name(cls) -> str:
        return "fragments"

    def schema(self) -> str:
        return FRAGMENTS

    def reader(self, schema) -> FragmentReader:
        return FragmentReader(dict(self.options))
