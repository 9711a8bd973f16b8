"""A streaming source over growing logs.

Spark's file source reads a file once; this one remembers how far each file was read, the digest of its head, and its size and
time when it was last looked at. Only files whose size or time changed since are opened, so idle files cost no more than their
listing. A file that shrank, whose head changed, or whose byte before the offset is no
newline starts again at 0 in the next generation; sinks keep the greatest generation of a file. Only complete lines are read.
Files are listed and read with pyarrow's file systems, so any store that they know will do.

With statepath, a folder of the query's own (beside its checkpoint), an offset is a number: what changed at each step lies in a file
of that number there, with a snapshot now and then. So offsets stay small however many files there are, and a query that
starts again goes on with the generations that it had. Without, the offset holds all files.

spark.dataSource.register(TailSource); spark.readStream.format("tail").option("path", folder).load()
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

HEAD_BYTES = 4096

#: Bytes of a file that one task reads in one batch.
SPLIT_BYTES = 64 * 1024 * 1024

#: Steps after which the whole state is written down, and the digest of no bytes.
SNAPSHOT_EVERY, EMPTY = 100, hashlib.sha256(b"").hexdigest()

SCHEMA = "file_path string, generation bigint, offset bigint, line string"


class FileRange(InputPartition):
    def __init__(self, path: str, generation: int, start: int, end: int) -> None:
        self.path, self.generation, self.start, self.end = path, generation, start, end


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.root, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.most = int(options.get("maxbytesperfile", SPLIT_BYTES))
        self.from_end = options.get("startingoffsets", "earliest") == "latest"
        #: path: [generation, offset, bytes of the head, its digest, size and time when last looked at]
        self.state: dict[str, list] = {}

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root if "://" in self.root else f"file://{self.root}")

    def _files(self):
        from pyarrow import fs

        system, root = self._fs()
        infos = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return system, sorted(((x.path, x.size, x.mtime_ns) for x in infos if x.is_file and x.path.endswith(self.suffix)))

    def initialOffset(self) -> dict:
        return {"files": json.dumps(self.ends() if self.from_end else {})}

    def ends(self) -> dict[str, list]:
        """All files as read up to their last line."""
        system, files = self._files()
        return {p: [0, self._last_newline(system, p, 0, n), *self._head(system, p, n), n, t] for p, n, t in files}

    @staticmethod
    def _read(system, path: str, start: int, end: int) -> bytes:
        with system.open_input_file(path) as f:
            f.seek(start)
            return f.read(end - start)

    def _head(self, system, path: str, size: int) -> list:
        n = min(size, HEAD_BYTES)
        return [n, hashlib.sha256(self._read(system, path, 0, n)).hexdigest()]

    def _last_newline(self, system, path: str, start: int, end: int) -> int:
        """The end of the last complete line in [start, end), or start."""
        at = end
        while at > start:
            lo = max(start, at - 65_536)
            found = self._read(system, path, lo, at).rfind(b"\n")
            if found >= 0:
                return lo + found + 1
            at = lo
        return start

    def _resumable(self, system, path: str, size: int, known: list) -> bool:
        _, offset, n, digest = known[:4]
        if size < offset or size < n or hashlib.sha256(self._read(system, path, 0, n)).hexdigest() != digest:
            return False
        return offset == 0 or self._read(system, path, offset - 1, offset) == b"\n"

    def changes(self) -> dict[str, list]:
        """The files that changed since they were last looked at, as they are now. One of which more is left than a batch takes
        counts as changed again."""
        system, files = self._files()
        found = {}
        for path, size, time in files:
            known = self.state.get(path, [0, 0, 0, EMPTY])
            if len(known) == 6 and known[4] == size and known[5] == time:
                continue
            if not self._resumable(system, path, size, known):
                known = [known[0] + 1, 0, 0, EMPTY]
            upto = min(size, known[1] + self.most)
            end = self._last_newline(system, path, known[1], upto)
            if end == known[1] and size > upto:  # a line longer than a batch
                end, upto = self._last_newline(system, path, known[1], size), size
            head = self._head(system, path, end) if end else [0, EMPTY]
            found[path] = [known[0], end, *head, size if upto == size else -1, time]
        return found

    def latestOffset(self) -> dict:
        self.state = self.state | self.changes()
        return {"files": json.dumps(self.state)}

    def partitions(self, start: dict, end: dict) -> list[FileRange]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        if not self.state:
            self.state = after
        out = []
        for path, (generation, upto, *_) in after.items():
            old = before.get(path, [0, 0])
            first = old[1] if old[0] == generation else 0
            if upto > first:
                out.append(FileRange(path, generation, first, upto))
        return out

    def read(self, partition: FileRange) -> Iterator[tuple]:
        system, _ = self._fs()
        at = partition.start
        for line in self._read(system, partition.path, partition.start, partition.end).split(b"\n")[:-1]:
            yield partition.path, partition.generation, at, line.decode("utf-8", "replace")
            at += len(line) + 1

    def commit(self, end: dict) -> None:
        pass


class NumberedReader(TailReader):
    """A TailReader whose offsets are numbers of steps that lie in statepath."""

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.steps, self.number = options["statepath"], None

    def _store(self):
        from transcript_lake.sources.line_source import file_system

        system, root, _ = file_system(self.steps)
        return system, root.rstrip("/")

    def _put(self, kind: str, number: int, value: dict) -> None:
        system, root = self._store()
        system.create_dir(f"{root}/{kind}", recursive=True)
        with system.open_output_stream(f"{root}/{kind}/{number}.json.part") as out:
            out.write(json.dumps(value).encode())
        system.move(f"{root}/{kind}/{number}.json.part", f"{root}/{kind}/{number}.json")

    def _get(self, kind: str, number: int) -> dict:
        system, root = self._store()
        return json.loads(self._read(system, f"{root}/{kind}/{number}.json", 0, system.get_file_info(f"{root}/{kind}/{number}.json").size))

    def _numbers(self, kind: str) -> list[int]:
        from pyarrow import fs

        system, root = self._store()
        infos = system.get_file_info(fs.FileSelector(f"{root}/{kind}", allow_not_found=True))
        return sorted(int(x.base_name[:-5]) for x in infos if x.base_name.endswith(".json"))

    def _load(self) -> None:
        """The state after the last step that is written down."""
        if self.number is not None:
            return
        steps, snapshots = self._numbers("steps"), self._numbers("snapshots")
        first = snapshots[-1] if snapshots else 0
        self.state = self._get("snapshots", first) if snapshots else {}
        self.number = max([first, *steps])
        for k in steps:
            if k > first:
                self.state |= {p: x["now"] for p, x in self._get("steps", k).items()}

    def initialOffset(self) -> dict:
        self._load()
        if self.from_end and not self.number:
            self.state = self.ends()
            self._put("snapshots", 0, self.state)
        return {"step": 0}

    def latestOffset(self) -> dict:
        self._load()
        found = self.changes()
        if found:
            step = {}
            for path, now in found.items():
                old = self.state.get(path, [0, 0])
                step[path] = {"now": now, "from": old[1] if old[0] == now[0] else 0}
            self._put("steps", self.number + 1, step)
            self.state, self.number = self.state | found, self.number + 1
            if self.number % SNAPSHOT_EVERY == 0:
                self._put("snapshots", self.number, self.state)
        return {"step": self.number}

    def partitions(self, start: dict, end: dict) -> list[FileRange]:
        out = []
        for k in range(start["step"] + 1, end["step"] + 1):
            for path, x in self._get("steps", k).items():
                if x["now"][1] > x["from"]:
                    out.append(FileRange(path, x["now"][0], x["from"], x["now"][1]))
        return out


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        options = dict(self.options)
        return NumberedReader(options) if "statepath" in options else TailReader(options)
