"""Archives written here are read in several partitions; redirects, packings, namespaces and media."""

import lzma
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from millrace.sources import archives


def write(path, entries, packing="zstd", per_cluster=3, wide=False):
    """entries: (namespace, path, title, mime, content bytes or the number of the entry that it leads to)."""
    mimes = sorted({m for *_, m, c in entries if isinstance(c, bytes)})
    clusters, where = [], {}
    for i, (*_, c) in enumerate(entries):
        if isinstance(c, bytes):
            if not clusters or len(clusters[-1]) == per_cluster:
                clusters.append([])
            where[i] = (len(clusters) - 1, len(clusters[-1]))
            clusters[-1].append(c)
    mime_list = b"".join(m.encode() + b"\0" for m in mimes) + b"\0"
    body, paths_at, at = b"", [], archives.HEADER.size + len(mime_list)
    for i, (ns, p, title, mime, c) in enumerate(entries):
        paths_at.append(at + len(body))
        if isinstance(c, bytes):
            body += struct.pack("<HBcIII", mimes.index(mime), 0, ns.encode(), 0, *where[i])
        elif c is None:
            body += struct.pack("<HBcI", archives.DELETED, 0, ns.encode(), 0)
        else:
            body += struct.pack("<HBcII", archives.REDIRECT, 0, ns.encode(), 0, c)
        body += p.encode() + b"\0" + title.encode() + b"\0"
    at += len(body)
    packed, clusters_at = b"", []
    for blobs in clusters:
        clusters_at.append(at + len(packed))
        width, letter = (8, "Q") if wide else (4, "I")
        ends = [width * (len(blobs) + 1)]
        for b in blobs:
            ends.append(ends[-1] + len(b))
        data = struct.pack(f"<{len(ends)}{letter}", *ends) + b"".join(blobs)
        kind, data = {"zstd": (5, zstandard.compress(data)), "xz": (4, lzma.compress(data)), "none": (1, data)}[packing]
        packed += bytes([kind | (16 if wide else 0)]) + data
    tail = at + len(packed)
    pointers = struct.pack(f"<{len(paths_at)}Q", *paths_at) + struct.pack(f"<{len(clusters_at)}Q", *clusters_at)
    header = archives.HEADER.pack(archives.MAGIC, 5, 0, b"\0" * 16, len(entries), len(clusters), tail, 0, tail + 8 * len(paths_at), archives.HEADER.size, 0, 0, tail)
    path.write_bytes(header + mime_list + body + packed + pointers)
    return str(path)


def pages(n):
    return [("A", f"page{i}", "" if i % 3 else f"Title {i}", "text/html", f"<p>page {i} ü</p>".encode() * (i % 5 + 1)) for i in range(n)]


@pytest.mark.parametrize("packing, wide", [("zstd", False), ("xz", True), ("none", False)])
def test_pages_of_several_partitions(spark, tmp_path, packing, wide):
    entries = pages(40) + [("A", "img/x.png", "", "image/png", b"\x89"), ("A", "css/a.html", "", "text/html", b"no"), ("X", "other", "", "text/html", b"no"), ("A", "data.json", "", "application/json", b"{}"), ("A", "gone", "", "", None)]
    one, two = write(tmp_path / "one.zim", entries, packing, wide=wide), write(tmp_path / "two.zim", pages(5), packing)
    directory = archives.read_directory(spark, one, two, rows_per_partition=10)
    assert directory.rdd.getNumPartitions() == 6 and directory.count() == 50
    got = {(r.archive, r.path): (r.title, r.html) for r in archives.read_pages(directory).collect()}
    assert got == {(a, p): (t or p, c.decode()) for a, n in ((one, 40), (two, 5)) for _, p, t, _, c in pages(n)}


def test_redirects(spark, tmp_path):
    chain = [("A", f"r{i}", "", "", i + 1) for i in range(21)]  # to the page at 21
    entries = [*chain, *pages(1), ("A", "circle1", "", "", 23), ("A", "circle2", "", "", 22), ("A", "lost", "", "", 25), ("A", "gone", "", "", None), ("A", "self", "", "", 26)]
    directory = archives.read_directory(spark, write(tmp_path / "r.zim", entries), rows_per_partition=4)
    assert sorted((r.entry, r.target) for r in archives.resolved(directory).collect()) == [(i, 21) for i in range(21)]
    assert directory.where(F.col("redirect_to").isNotNull()).count() == 25


def test_odd_archives(spark, tmp_path):
    empty = archives.read_directory(spark, write(tmp_path / "e.zim", []))
    assert empty.count() == 0 and archives.read_pages(empty).collect() == [] and archives.resolved(empty).collect() == []
    (tmp_path / "x.zim").write_bytes(b"not an archive" * 20)
    with pytest.raises(Exception, match="isn't a ZIM archive"):
        archives.read_directory(spark, str(tmp_path / "x.zim")).count()
    long = "p" * 5000
    assert archives.read_directory(spark, write(tmp_path / "l.zim", [("A", long, "", "text/html", b"x")])).first().path == long
