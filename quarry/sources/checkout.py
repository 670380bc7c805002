"""A data source over checkouts: the files of each with their mode, and whether version control tracks them.

    spark.dataSource.register(Checkouts)
    spark.read.format("checkouts").load("/mnt/checkouts")

The folders below the path are the projects; each is read by one task, file by file, hidden
ones too (Spark's own file sources pass over names that begin with a dot). The path must be
mounted on all executors. Links are not followed.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "project string, path string, tracked boolean, mode string, size long, content binary"
#: Rows of a batch, and bytes of content in it.
ROWS, BYTES = 1000, 16 << 20


def tracked_modes(index: bytes) -> dict[str, str]:
    """Path -> mode of the entries of an index file, versions 2 to 4."""
    if index[:4] != b"DIRC":
        return {}
    version, n = int.from_bytes(index[4:8]), int.from_bytes(index[8:12])
    out, at, before = {}, 12, b""
    for _ in range(n):
        begin, flags = at, int.from_bytes(index[at + 60 : at + 62])
        mode = int.from_bytes(index[at + 24 : at + 28])
        at += 64 if version > 2 and flags & 0x4000 else 62
        keep = 0
        if version == 4:  # names share a part with the one before; its length is a number of 7-bit digits
            shift = index[at] & 127
            while index[at] & 128:
                at += 1
                shift = (shift + 1 << 7) | index[at] & 127
            at += 1
            keep = len(before) - shift
        end = index.index(b"\0", at)
        before = before[:keep] + index[at:end]
        at = end + 1 if version == 4 else begin + (end - begin) // 8 * 8 + 8
        out[before.decode("utf-8", "surrogateescape")] = f"{mode:06o}"
    return out


class _Project(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root, self.most = options["path"], int(options.get("most", 2 << 20))

    def partitions(self):
        with os.scandir(self.root) as entries:
            return [_Project(e.name) for e in sorted(entries, key=lambda e: e.name) if e.is_dir(follow_symlinks=False)]

    def _files(self, top: str) -> Iterator[tuple[str, os.stat_result]]:
        for folder, names, files in os.walk(top):
            names[:] = sorted(n for n in names if n != ".git")
            for name in sorted(files):
                own = os.lstat(full := os.path.join(folder, name))
                if stat.S_ISREG(own.st_mode):
                    yield full, own

    def read(self, partition):
        import pyarrow as pa

        top = os.path.join(self.root, partition.name)
        try:
            with open(os.path.join(top, ".git", "index"), "rb") as f:
                modes = tracked_modes(f.read())
        except OSError:
            modes = None
        kinds = {"project": pa.string(), "path": pa.string(), "tracked": pa.bool_(), "mode": pa.string(), "size": pa.int64(), "content": pa.binary()}
        rows, held = [], 0

        def batch():
            return pa.record_batch([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))

        for full, own in self._files(top):
            path = os.path.relpath(full, top)
            mode = (modes or {}).get(path) or ("100755" if own.st_mode & 0o111 else "100644")
            content = None
            if own.st_size <= self.most:
                with open(full, "rb") as f:
                    content = f.read()
            rows.append((partition.name, path.encode("utf-8", "replace").decode(), modes is None or path in modes, mode, own.st_size, content))
            held += len(content or b"")
            if len(rows) >= ROWS or held >= BYTES:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class Checkouts(DataSource):
    """Options: path, and most, the size up to which content is read (2 MiB); larger files have a null content. Without an
    index all files count as tracked, with the mode that the file system has."""

    @classmethod
    def name(cls):
        return "checkouts"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)
