"""Binary files read a piece at a time, from any file system that Arrow knows."""

from __future__ import annotations

import struct

from pyarrow import fs


class File:
    """Random access to a file by its path or address."""

    def __init__(self, path: str):
        system, where = fs.FileSystem.from_uri(path.replace("file:///", "/") if path.startswith("file:///") else path)
        self.handle = system.open_input_file(where)
        self.size = self.handle.size()

    def at(self, offset: int, n: int) -> bytes:
        return self.handle.read_at(n, offset)

    def unpack(self, form: str, offset: int) -> tuple:
        return struct.unpack(form, self.at(offset, struct.calcsize(form)))

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.handle.close()


def runs(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Ranges of items with at most so many bytes together, one item at least."""
    out, start, held = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            out.append((start, i))
            start, held = i, 0
        held += n
    return [*out, (start, len(sizes))] if start < len(sizes) else out
