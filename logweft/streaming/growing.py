"""Lines of files that grow: a stream source whose offsets are how far each file has been read.

An offset holds for every file the bytes up to its last line end, and digests of its first line and of the bytes before
that end. A file grew if it is not shorter than before and both digests still fit; then only the bytes behind the old
end are read, in blocks, one task each. Otherwise it was replaced and is read from its beginning. A last line
without an end waits until its end is there. Files that are gone are no error.

The offset is a picture of the folder and needs no memory of the reader, so a restarted stream goes on where
its checkpoint stands. Files are opened through Arrow (local, HDFS, S3 and the like), in the tasks that read them.
"""

from __future__ import annotations

import fnmatch
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a file that a digest covers, and that one task reads.
DIGEST_BYTES, BLOCK_BYTES = 1024, 64 << 20
_CHUNK = 1 << 16
_COLUMNS = "source string, block_start long, seq long, line string, mod_year int"
_ARROW = pa.schema([
    ("source", pa.string()), ("block_start", pa.int64()), ("seq", pa.int64()), ("line", pa.string()), ("mod_year", pa.int32()),
])


def _matching(path: str) -> list[tuple[str, pafs.FileInfo]]:
    """Files of a folder, or of a path with wildcards in its parts; names that begin with a point or underscore are left out."""
    scheme = path.partition("://")[0] + "://" if "://" in path else ""
    wild = re.search(r"[*?\[]", path)
    base = path[: wild.start()].rpartition("/")[0] if wild else path
    files, root = pafs.FileSystem.from_uri(base if scheme or base.startswith("file:") else "file://" + base)
    parts = path.rstrip("/")[len(base) :].strip("/").split("/") if wild else []
    found = []
    info = files.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [(path, info)]
    if info.type == pafs.FileType.NotFound:
        return []
    for info in files.get_file_info(pafs.FileSelector(root, recursive=len(parts) > 1 or bool(parts))):
        names = info.path[len(root) :].strip("/").split("/")
        if info.type != pafs.FileType.File or any(n.startswith(("_", ".")) for n in names):
            continue
        # A pattern may name folders, whose files are then meant.
        if len(names) - len(parts) in (0, 1) and all(map(fnmatch.fnmatchcase, names, parts)):
            found.append((f"{base.rstrip('/')}/{'/'.join(names)}", info))
    return sorted(found, key=lambda x: x[0])


def _open(path: str):
    files, inner = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)
    return files.open_input_file(inner)


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()[:16]


def _range(f, start: int, end: int) -> bytes:
    f.seek(start)
    return f.read(max(end - start, 0))


def _last_line_end(f, size: int) -> int:
    end = size
    while end > 0:
        start = max(0, end - _CHUNK)
        at = _range(f, start, end).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return 0


def _state(f, size: int) -> dict:
    end = _last_line_end(f, size)
    head = _range(f, 0, min(end, DIGEST_BYTES)).partition(b"\n")[0]
    return {"bytes": end, "head": _digest(head), "tail": _digest(_range(f, max(0, end - DIGEST_BYTES), end))}


def snapshot(path: str, known: dict | None = None) -> dict[str, dict]:
    """By file how far it could be read now. ``known`` (of an earlier call) saves opening files that have not changed."""
    out = {}
    for name, info in _matching(path):
        stamp = [info.size, info.mtime_ns or 0]
        if known is not None and known.get(name, (None,))[0] == stamp:
            state = known[name][1]
        else:
            try:
                with _open(name) as f:
                    state = _state(f, info.size)
            except FileNotFoundError:
                continue
            if known is not None:
                known[name] = (stamp, state)
        if state["bytes"]:
            out[name] = state
    return out


def grown_from(path: str, before: dict, now: dict) -> bool:
    """Whether the file still begins with what was read before."""
    if now["bytes"] < before["bytes"] or now["head"] != before["head"]:
        return False
    if now["bytes"] == before["bytes"]:
        return now["tail"] == before["tail"]
    try:
        with _open(path) as f:
            return _digest(_range(f, max(0, before["bytes"] - DIGEST_BYTES), before["bytes"])) == before["tail"]
    except FileNotFoundError:
        return True  # gone since: nothing to read


@dataclass
class _Block(InputPartition):
    path: str
    first: int  # where the new bytes begin
    start: int
    end: int
    last: int  # where they end


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, block: int):
        self.path, self.block, self.known = path, block, {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        return {"files": snapshot(self.path, self.known)}

    def partitions(self, start: dict, end: dict) -> list[_Block]:
        out = []
        for path, now in end["files"].items():
            before = start["files"].get(path)
            first = before["bytes"] if before and grown_from(path, before, now) else 0
            out += [
                _Block(path, first, at, min(at + self.block, now["bytes"]), now["bytes"]) for at in range(first, now["bytes"], self.block)
            ]
        return out

    def read(self, partition: _Block) -> Iterator[pa.RecordBatch]:
        """Lines that begin in the block, up to the end of the last one."""
        try:
            f = _open(partition.path)
        except FileNotFoundError:
            return
        with f:
            info = pafs.FileSystem.from_uri(partition.path if "://" in partition.path or partition.path.startswith("file:") else "file://" + partition.path)
            modified = info[0].get_file_info(info[1]).mtime
            year = (modified or datetime.now(timezone.utc)).year
            at = partition.start
            if at > partition.first:  # the line across the border belongs to the block before
                at -= 1
            rest, skip = b"", at != partition.start
            where = at
            while at < partition.last:
                data = _range(f, at, min(at + (_CHUNK << 6), partition.last))
                if not data:
                    break
                at += len(data)
                whole, _, rest = (rest + data).rpartition(b"\n")
                if not _:
                    continue
                lines = whole.split(b"\n")
                rows, begin = [], where
                for line in lines:
                    if skip:
                        skip = False
                    elif begin < partition.end:
                        text = line.removesuffix(b"\r")
                        if text:
                            rows.append((begin - partition.start, text.decode("utf-8", "replace")))
                    begin += len(line) + 1
                where = begin
                if rows:
                    seq, text = zip(*rows)
                    n = len(rows)
                    columns = [[partition.path] * n, [partition.start] * n, seq, text, [year] * n]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _ARROW)], schema=_ARROW)
                if where >= partition.end:
                    return


class GrowingLines(DataSource):
    """``spark.readStream.format("growing_lines").option("path", ...)``; option ``blockBytes``: bytes a task reads."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return _COLUMNS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"], int(self.options.get("blockBytes", BLOCK_BYTES)))


def growing_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """New lines of the files below ``path`` (a folder, a file or a pattern), those appended to files read before too.

    Empty lines are skipped. ``(source, block_start, seq)`` is the line order: the first byte of the block that was read,
    and the line's place in it.
    """
    spark.dataSource.register(GrowingLines)
    lines = spark.readStream.format(GrowingLines.name()).options(**options).option("path", path).load()
    return lines.select(F.col("source").alias("loader_id"), "source", "block_start", "seq", "line", "mod_year")
