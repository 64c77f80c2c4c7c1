"""Byte files in the shared folder, as tasks write and read them in ranges."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow.fs as pafs

#: Ranges of one file that lie this near together are read at once, up to that many bytes.
GAP_BYTES = 64 << 10
RANGE_BYTES = 8 << 20


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI as Spark writes it, and the path in it."""
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    uri = re.sub(r"^file:/+", "file:///", uri)
    uri = re.sub(r"^s3[an]://", "s3://", uri)
    return pafs.FileSystem.from_uri(uri)


def read_ranges(wanted: Iterable[tuple[str, int, int, object]]) -> Iterator[tuple[object, bytes]]:
    """The bytes of (uri, offset, length, tag), in the given order, with their tag.  Ranges
    that follow each other closely in a file are one read."""
    near: list[tuple[str, int, int, object]] = []
    where, source = None, None

    def read():
        nonlocal where, source
        uri, start = near[0][0], near[0][1]
        if uri != where:
            if source is not None:
                source.close()
            fs, path = opened(uri)
            where, source = uri, fs.open_input_file(path)
        data = source.read_at(near[-1][1] + near[-1][2] - start, start)
        for _, offset, length, tag in near:
            part = data[offset - start : offset - start + length]
            if len(part) != length:
                raise ValueError(f"{uri} ends inside the {length} bytes at {offset}")
            yield tag, part

    for x in wanted:
        if near:
            behind = x[1] - (near[-1][1] + near[-1][2])
            if x[0] != near[0][0] or not 0 <= behind <= GAP_BYTES or x[1] + x[2] - near[0][1] > RANGE_BYTES:
                yield from read()
                near = []
        near.append(x)
    if near:
        yield from read()
    if source is not None:
        source.close()
