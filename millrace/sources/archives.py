"""SRC-11: web archives in the ZIM container format, read in parallel.

An archive has a directory of entries (namespace, path, title, MIME type) and clusters of compressed contents. A Python data
source reads the directory in ranges of entries, each range a partition, so a large archive is no single task. Redirects are
entries that name another entry; their chains are resolved by joins that double the distance each round. Contents are read
cluster by cluster: the wanted entries are dealt by cluster, so each is unpacked once, by one task, one at a time.
"""

from __future__ import annotations

import lzma
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.functions.predicates import is_page
from millrace.session import written

# Fixed values of the format: its magic number, the layout of its header, MIME numbers of entries without content.
MAGIC = 72173914
HEADER = struct.Struct("<IHH16sIIQQQQIIQ")
REDIRECT, LINK_TARGET, DELETED = 0xFFFF, 0xFFFE, 0xFFFD
DIRECTORY = "archive string, entry long, namespace string, path string, title string, mime string, redirect_to long, cluster long, blob long"


def _open(path: str):
    """An archive in any store that Arrow knows, with random access."""
    store, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(inside)


class Archive:
    """The header of an archive and reads at its places."""

    def __init__(self, path: str):
        self.file = _open(path)
        fields = HEADER.unpack(self._at(0, HEADER.size))
        if fields[0] != MAGIC:
            raise ValueError(f"{path} isn't a ZIM archive")
        self.entries, self.clusters = fields[4], fields[5]
        self.paths_at, self.clusters_at, self.mimes_at = fields[6], fields[8], fields[9]
        self.end = fields[12] or self.file.size()

    def _at(self, where: int, n: int) -> bytes:
        self.file.seek(where)
        return self.file.read(n)

    def _strings(self, where: int, n: int) -> list[str]:
        """n strings, each ended by a zero byte; all up to the first empty one if n is 0."""
        step, data = 1024, b""
        while True:
            more = self._at(where + len(data), step)
            data += more
            parts = data.split(b"\0")
            if n and len(parts) > n:
                return [p.decode("utf-8", "replace") for p in parts[:n]]
            if not n and b"" in parts[:-1]:
                return [p.decode("utf-8", "replace") for p in parts[: parts.index(b"")]]
            if not more:
                raise ValueError("an archive ends within a text")
            step *= 2

    def mimes(self) -> list[str]:
        return self._strings(self.mimes_at, 0)

    def directory(self, start: int, stop: int) -> Iterator[tuple]:
        """(entry, namespace, path, title, mime number, redirect, cluster, blob) of a range of entries."""
        places = struct.unpack(f"<{stop - start}Q", self._at(self.paths_at + 8 * start, 8 * (stop - start)))
        for i, at in enumerate(places, start):
            mime, _, namespace, _ = struct.unpack("<HBcI", self._at(at, 8))
            if mime == REDIRECT:
                (redirect,), cluster, blob, size = struct.unpack("<I", self._at(at + 8, 4)), None, None, 12
            elif mime in (LINK_TARGET, DELETED):
                redirect, cluster, blob, size = None, None, None, 8
            else:
                (cluster, blob), redirect, size = struct.unpack("<II", self._at(at + 8, 8)), None, 16
            path, title = self._strings(at + size, 2)
            yield i, namespace.decode("latin-1"), path, title or path, mime, redirect, cluster, blob

    def blobs(self, cluster: int) -> list[memoryview]:
        """The unpacked contents of a cluster."""
        n = 2 if cluster + 1 < self.clusters else 1
        places = struct.unpack(f"<{n}Q", self._at(self.clusters_at + 8 * cluster, 8 * n))
        stop = places[1] if n == 2 and places[1] > places[0] else self.end
        raw = self._at(places[0], stop - places[0])
        kind, wide = raw[0] & 15, bool(raw[0] & 16)
        if kind == 4:
            data = lzma.LZMADecompressor().decompress(raw[1:])
        elif kind == 5:
            data = zstandard.ZstdDecompressor().decompressobj().decompress(raw[1:])
        elif kind in (0, 1):
            data = raw[1:]
        else:
            raise ValueError(f"cluster {cluster} is packed in an unknown way ({kind})")
        width, letter = (8, "Q") if wide else (4, "I")
        (first,) = struct.unpack_from(f"<{letter}", data)
        ends = struct.unpack_from(f"<{first // width}{letter}", data)
        return [memoryview(data)[a:b] for a, b in zip(ends, ends[1:], strict=False)]


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class _DirectoryReader(DataSourceReader):
    def __init__(self, paths: list[str], rows: int):
        self.paths, self.rows = paths, rows

    def partitions(self) -> list[_Range]:
        return [_Range(p, a, min(n, a + self.rows)) for p in self.paths for n in [Archive(p).entries] for a in range(0, n, self.rows)]

    def read(self, part: _Range | None) -> Iterator[tuple]:
        if part is None:  # archives without entries have no ranges
            return
        archive = Archive(part.path)
        mimes = archive.mimes()
        for entry, namespace, path, title, mime, redirect, cluster, blob in archive.directory(part.start, part.stop):
            yield part.path, entry, namespace, path, title, mimes[mime] if mime < len(mimes) else None, redirect, cluster, blob


class ArchiveDirectory(DataSource):
    """The directories of archives: ``paths`` (joined by line ends), ``rowsPerPartition``."""

    @classmethod
    def name(cls) -> str:
        return "archive_directory"

    def schema(self) -> str:
        return DIRECTORY

    def reader(self, schema) -> DataSourceReader:
        return _DirectoryReader(self.options["paths"].split("\n"), int(self.options.get("rowsPerPartition", 65_536)))


def read_directory(spark: SparkSession, *paths: str, rows_per_partition: int = 65_536) -> DataFrame:
    """The entries of archives (DIRECTORY), in partitions of at most ``rows_per_partition`` entries."""
    spark.dataSource.register(ArchiveDirectory)
    return spark.read.format("archive_directory").option("paths", "\n".join(paths)).option("rowsPerPartition", rows_per_partition).load()


def resolved(directory: DataFrame, rounds: int = 32) -> DataFrame:
    """archive, entry, target: the entry that each redirect leads to in the end.

    Each round replaces a redirect's target by its target's target, so chains of 2**rounds redirects are followed; redirects
    that lead nowhere or in a circle are left out.
    """
    jumps = written(directory.where("redirect_to IS NOT NULL").select("archive", "entry", F.col("redirect_to").alias("target")), "redirects")
    for _ in range(rounds):
        ahead = jumps.select("archive", F.col("entry").alias("target"), F.col("target").alias("next"))
        moved = jumps.join(ahead, ["archive", "target"], "left").select("archive", "entry", F.coalesce("next", "target").alias("target"), (F.col("next").isNotNull() & (F.col("next") != F.col("target"))).alias("moved"))
        moved = written(moved, "redirects")
        jumps = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    ends = directory.where("cluster IS NOT NULL").select("archive", F.col("entry").alias("target"))
    return jumps.join(ends, ["archive", "target"], "left_semi").select("archive", "entry", "target")


def read_pages(directory: DataFrame, namespaces: tuple[str, ...] = ("A", "C"), partitions: int | None = None) -> DataFrame:
    """archive, path, title, html of the pages among the entries: text of the namespaces, no media or assets."""
    wanted = directory.where(F.col("cluster").isNotNull() & F.col("namespace").isin(*namespaces) & is_page(F.col("path"), F.col("mime")))
    dealt = wanted.repartition(*([partitions] if partitions else []), "archive", "cluster").sortWithinPartitions("archive", "cluster", "blob")

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, archive, blobs = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if archive is None or at[0] != row["archive"]:
                    archive = Archive(row["archive"])
                if at != (row["archive"], row["cluster"]):
                    at, blobs = (row["archive"], row["cluster"]), archive.blobs(row["cluster"])
                html = bytes(blobs[row["blob"]]).decode("utf-8", "ignore")
                yield pa.RecordBatch.from_pylist([{"archive": row["archive"], "path": row["path"], "title": row["title"], "html": html}], schema=out)

    out = pa.schema([(c, pa.string()) for c in ("archive", "path", "title", "html")])
    return dealt.mapInArrow(contents, "archive string, path string, title string, html string")
