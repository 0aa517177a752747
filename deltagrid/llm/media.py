"""Media columns: signature sniffing, type correction and carving.

An Aho-Corasick automaton finds every known magic number at any offset in one pass. Each hit is then held against its
format's own structure (chunk sizes, header lengths, checksums, trailers); only a hit whose structure and length hold
counts. Trailers are looked up once for all hits, and chains of pages, chunks, segments and boxes are followed once, so time and
memory do not grow with hits times length. Compressed data are inflated from each hit, piece by piece, without keeping the
output; there alone hits that each begin a long valid stream are inflated once each. The item at offset 0 gives the true type, which corrects the declared one; items that lie wholly inside, at other offsets,
are embedded media and can be carved.

`store_samples` keeps bytes losslessly as 8-bit mono samples in a RIFF/WAVE container, `read_samples` gives them back.

Nulls: stored as the empty payload's padding; sniffing null bytes gives type null and no items. Empty bytes are
"application/octet-stream" without items. Rows are independent (ties, repeats and empty tables need no rule); other
columns pass through, and a column with an output's name is replaced.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, others, replaced, schema_with, slices

#: Magic numbers, the type they announce, and where they stand in an item.
SIGNATURES = [
    (b"RIFF", "riff", 0),
    (b"\x89PNG\r\n\x1a\n", "image/png", 0),
    (b"\xff\xd8\xff", "image/jpeg", 0),
    (b"GIF87a", "image/gif", 0),
    (b"GIF89a", "image/gif", 0),
    (b"BM", "image/bmp", 0),
    (b"%PDF-", "application/pdf", 0),
    (b"PK\x03\x04", "application/zip", 0),
    (b"fLaC", "audio/flac", 0),
    (b"OggS", "audio/ogg", 0),
    (b"\x1f\x8b\x08", "application/gzip", 0),
    (b"ftyp", "video/mp4", 4),
]
UNKNOWN = "application/octet-stream"
ITEM = "array<struct<type:string,start:bigint,length:bigint>>"


#: Bytes that are inflated at once.
PIECE = 1 << 16


class Data:
    """Bytes, with what several validators ask of them kept."""

    def __init__(self, b: bytes):
        self.b, self._places, self._ends, self._spans = b, {}, {}, None

    def chain(self, name: str, p: int, step) -> int:
        """Where a chain from p ends. step(p) gives (the next place, None) or (None, the end); what is known of a place is not asked again."""
        ends, way = self._ends.setdefault(name, {}), []
        while (end := ends.get(p)) is None:
            way.append(p)
            p, end = step(p)
            if end is not None:
                break
        ends.update(dict.fromkeys(way, end))
        return end

    def on_way(self, a: int, x: int) -> bool:
        """Whether the chain of chunks (a name, a size, so many bytes, made even) that begins at a, after a RIFF head, comes to x. All such chains are joined into trees once, in which x must stand above a."""
        if self._spans is None:
            follows, b = {}, self.b
            at = b.find(b"RIFF")
            while at >= 0:
                p = at + 12
                while p not in follows:
                    follows[p] = q = p + 8 + (n := int.from_bytes(b[p + 4 : p + 8], "little")) + (n & 1) if p + 8 <= len(b) else -1
                    if q < 0:
                        break
                    p = q
                at = b.find(b"RIFF", at + 1)
            before: dict[int, list[int]] = {}
            for p, q in follows.items():
                before.setdefault(q, []).append(p)
            self._spans, count, todo = {}, 0, [(p, False) for p in before.get(-1, ())]
            while todo:
                p, done = todo.pop()
                if done:
                    self._spans[p] = (self._spans[p][0], count)
                    continue
                self._spans[p] = (count, count + 1)
                count += 1
                todo.append((p, True))
                todo += [(q, False) for q in before.get(p, ())]
        low, high = self._spans.get(x, (0, 0))
        return a in self._spans and low <= self._spans[a][0] < high

    def after(self, trailer: bytes, at: int) -> int:
        """The first place of a trailer from `at` on, or -1."""
        if (found := self._places.get(trailer)) is None:
            found, p = [], self.b.find(trailer)
            while p >= 0:
                found.append(p)
                p = self.b.find(trailer, p + 1)
            self._places[trailer] = found
        k = bisect_left(found, at)
        return found[k] if k < len(found) else -1


def _riff(d: Data, at: int) -> tuple[str, int] | None:
    b = d.b
    if len(b) < at + 12:
        return None
    (size,), kind = struct.unpack_from("<I", b, at + 4), b[at + 8 : at + 12]
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}.get(kind)
    end = at + 8 + size
    if kind is None or end > len(b):
        return None
    # chunks must fill it exactly, but for a byte that makes the last one even
    full = d.on_way(at + 12, end) or (d.on_way(at + 12, end + 1) and not d.on_way(at + 12, end - 7))
    return (kind, end - at) if full else None


def _png(d: Data, at: int) -> tuple[str, int] | None:
    b = d.b

    def chunk(p: int) -> tuple[int | None, int | None]:
        if p + 12 > len(b):
            return None, -1
        n, name = struct.unpack_from(">I4s", b, p)
        if name == b"IHDR" or p + 12 + n > len(b) or zlib.crc32(memoryview(b)[p + 4 : p + 8 + n]) != int.from_bytes(b[p + 8 + n : p + 12 + n], "big"):
            return None, -1
        return (p + 12 + n, None) if name != b"IEND" else (None, p + 12 if n == 0 else -1)

    p = at + 8
    if p + 25 > len(b) or struct.unpack_from(">I4s", b, p) != (13, b"IHDR") or zlib.crc32(b[p + 4 : p + 21]) != int.from_bytes(b[p + 21 : p + 25], "big"):
        return None
    end = d.chain("png", p + 25, chunk)
    return ("image/png", end - at) if end >= 0 else None


def _jpeg(d: Data, at: int) -> tuple[str, int] | None:
    b = d.b

    def segment(p: int) -> tuple[int | None, int | None]:
        if p + 4 > len(b) or b[p] != 0xFF:
            return None, -1
        if b[p + 1] == 0xDA:
            end = d.after(b"\xff\xd9", p + 2)
            return None, end + 2 if end >= 0 else -1
        return (p + 2 + max(2, int.from_bytes(b[p + 2 : p + 4], "big")), None) if 0xC0 <= b[p + 1] <= 0xFE else (None, -1)

    end = d.chain("jpeg", at + 2, segment)
    return ("image/jpeg", end - at) if end >= 0 else None


def _gif(d: Data, at: int) -> tuple[str, int] | None:
    b = d.b
    if len(b) < at + 14:
        return None
    flags = b[at + 10]

    def block(p: int) -> tuple[int | None, int | None]:
        return (p + 1 + b[p], None) if p < len(b) and b[p] else (None, p + 1)

    def part(p: int) -> tuple[int | None, int | None]:
        if p >= len(b):
            return None, -1
        if b[p] == 0x3B:
            return None, p + 1
        if b[p] == 0x21:
            return d.chain("gif blocks", p + 2, block), None
        if b[p] == 0x2C and p + 10 < len(b):
            return d.chain("gif blocks", p + 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 0x80 else 0), block), None
        return None, -1

    end = d.chain("gif", at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), part)
    return ("image/gif", end - at) if end >= 0 else None


def _bmp(d: Data, at: int) -> tuple[str, int] | None:
    b = d.b
    if len(b) < at + 26:
        return None
    size, spare, data, header = struct.unpack_from("<IIII", b, at + 2)
    good = spare == 0 and header in (12, 40, 52, 56, 64, 108, 124) and 14 + header <= data <= size and at + size <= len(b)
    return ("image/bmp", size) if good else None


def _pdf(d: Data, at: int) -> tuple[str, int] | None:
    end = d.after(b"%%EOF", at)
    return ("application/pdf", end + 5 - at) if end >= 0 and d.b[at + 5 : at + 6].isdigit() else None


def _zip(d: Data, at: int) -> tuple[str, int] | None:
    b, end = d.b, d.after(b"PK\x05\x06", at)
    if end < 0 or len(b) < end + 22:
        return None
    size, start, note = struct.unpack_from("<IIH", b, end + 12)
    return ("application/zip", end + 22 + note - at) if at + start + size == end and end + 22 + note <= len(b) else None


@lru_cache(2)
def _crc_table(polynomial: int, bits: int) -> list[int]:
    out, top, mask = [], 1 << bits - 1, (1 << bits) - 1
    for i in range(256):
        c = i << bits - 8
        for _ in range(8):
            c = (c << 1 ^ polynomial if c & top else c << 1) & mask
        out.append(c)
    return out


def _flac_header(b: bytes, at: int) -> tuple[int, int] | None:
    """Of a frame: its samples and the length of its header, if the header's checksum holds."""
    if len(b) < at + 6 or b[at] != 0xFF or b[at + 1] & 0xFE != 0xF8 or b[at + 3] & 1:
        return None
    size, rate = b[at + 2] >> 4, b[at + 2] & 15
    lead = b[at + 4]  # a number in the manner of UTF-8
    p = at + 5 if lead < 0x80 else at + 4 + 8 - (lead ^ 0xFF).bit_length()
    if size in (6, 7):
        samples, p = int.from_bytes(b[p : p + size - 5], "big") + 1, p + size - 5
    else:
        samples = 192 if size == 1 else 576 << size - 2 if 2 <= size < 6 else 256 << size - 8 if size >= 8 else 0
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if not samples or rate == 15 or p >= len(b):
        return None
    c, table = 0, _crc_table(0x07, 8)
    for x in b[at:p]:
        c = table[c ^ x]
    return (samples, p + 1 - at) if c == b[p] else None


def _flac(d: Data, at: int) -> tuple[str, int] | None:
    """Metadata blocks, then frames up to the number of samples that the first block states; a frame ends where its checksum comes out even and another one or the end follows."""
    b, p, first = d.b, at + 4, True
    total = 0
    while True:
        if len(b) < p + 4:
            return None
        head, n = b[p], int.from_bytes(b[p + 1 : p + 4], "big")
        if first and (head & 0x7F or n != 34) or head & 0x7F == 127 or p + 4 + n > len(b):
            return None
        if first:
            total = int.from_bytes(b[p + 17 : p + 22], "big") & (1 << 36) - 1
        first, p = False, p + 4 + n
        if head & 0x80:
            break
    table, done = _crc_table(0x8005, 16), 0
    while not total or done < total:
        header = _flac_header(b, p)
        if header is None:
            break
        done += header[0]
        c, q = 0, p
        while q < len(b):
            c = c << 8 & 0xFFFF ^ table[c >> 8 ^ b[q]]
            q += 1
            if c == 0 and q - p > header[1] + 2 and (total and done >= total or q == len(b) or _flac_header(b, q)):
                break
        else:
            return None
        p = q
    return ("audio/flac", p - at) if done >= total else None


def _ogg(d: Data, at: int) -> tuple[str, int] | None:
    b = d.b

    def page(p: int) -> tuple[int | None, int | None]:
        if b[p : p + 5] != b"OggS\x00" or len(b) < p + 27:
            return None, p
        n = b[p + 26]
        q = p + 27 + n + sum(b[p + 27 : p + 27 + n])
        return (q, None) if q <= len(b) else (None, -1)  # -1: within a page

    end = d.chain("ogg", at, page)
    return ("audio/ogg", end - at) if end > at else None


def _gzip(d: Data, at: int) -> tuple[str, int] | None:
    view, z, p = memoryview(d.b), zlib.decompressobj(31), at
    try:
        while not z.eof and p < len(view):
            todo = bytes(view[p : p + PIECE])
            p += len(todo)
            while todo and not z.eof:
                z.decompress(todo, PIECE)
                todo = z.unconsumed_tail
    except zlib.error:
        return None
    return ("application/gzip", p - len(z.unused_data) - at) if z.eof else None


def _mp4(d: Data, at: int) -> tuple[str, int] | None:
    b = d.b
    if len(b) < at + 16 or not b[at + 8 : at + 12].isascii() or not b[at + 8 : at + 12].decode("latin-1").isprintable() or int.from_bytes(b[at : at + 4], "big") % 4:
        return None

    def box(p: int, least: int = 8) -> tuple[int | None, int | None]:
        if p + 8 > len(b):
            return None, p
        n, name = struct.unpack_from(">I4s", b, p)
        return (p + n, None) if n >= least and p + n <= len(b) and name.isalnum() else (None, p)

    first, _ = box(at, 16)
    return ("video/mp4", d.chain("mp4", first, box) - at) if first is not None else None


VALIDATORS = {"riff": _riff, "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "application/pdf": _pdf, "application/zip": _zip, "audio/flac": _flac, "audio/ogg": _ogg, "application/gzip": _gzip, "video/mp4": _mp4}


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, kind, back in SIGNATURES:
        a.add_word(magic.decode("latin-1"), (kind, len(magic) - 1 + back))
    a.make_automaton()
    return a


def items(data: bytes) -> tuple[list[tuple[str, int, int]], int]:
    """Valid items in order of start (type, start, length), and the number of signature hits."""
    found, hits, d = [], 0, Data(data)
    for end, (kind, back) in automaton().iter(data.decode("latin-1")):
        hits += 1
        if (at := end - back) >= 0 and (x := VALIDATORS[kind](d, at)):
            found.append((x[0], at, x[1]))
    return sorted(set(found), key=lambda x: (x[1], -x[2])), hits


def sniff(df: DataFrame, data: str, declared: str | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds media_type (the true type), media_was_wrong (declared differs; null if nothing is declared), media_hits, media_items (all valid items)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, data):
                rows = [None if x is None else items(x) for x in part.column(data).to_pylist()]
                kinds = [None if r is None else next((k for k, at, _ in r[0] if at == 0), UNKNOWN) for r in rows]
                said = part.column(declared).to_pylist() if declared else [None] * len(rows)
                yield replaced(
                    part,
                    {
                        "media_type": pa.array(kinds, pa.string()),
                        "media_was_wrong": pa.array([None if s is None or k is None else s != k for s, k in zip(said, kinds, strict=True)], pa.bool_()),
                        "media_hits": pa.array([None if r is None else r[1] for r in rows], pa.int64()),
                        "media_items": pa.array([None if r is None else [dict(zip(("type", "start", "length"), x, strict=True)) for x in r[0]] for r in rows], pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))),
                    },
                    drop,
                )

    return df.mapInArrow(run, schema_with(df, f"media_type string; media_was_wrong boolean; media_hits bigint; media_items {ITEM}", drop))


def carve(df: DataFrame, data: str) -> DataFrame:
    """One row for each embedded item of a sniffed table: df's columns, item_type, item_start, item_bytes. Items at offset 0 are the medium itself."""
    (one,) = fresh(df, "_item")
    x = F.col(one)
    kept = others(df, "item_type", "item_start", "item_bytes")
    rows = df.select(*kept, F.explode(F.filter("media_items", lambda i: i["start"] > 0)).alias(one))
    return rows.select(*kept, x["type"].alias("item_type"), x["start"].alias("item_start"), F.substring(F.col(data), (x["start"] + 1).cast("int"), x["length"].cast("int")).alias("item_bytes"))


def _le32(n: Column) -> Column:
    return F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(255)), 2, "0") for i in range(4))))


def padded(text: Column, block: int = 64) -> Column:
    """UTF-8 bytes followed by zero bytes up to a positive multiple of block; null counts as empty."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(data)
    more = F.when(n == 0, F.lit(block)).otherwise((block - n % block) % block).cast("int")
    return F.concat(data, F.unhex(F.repeat(F.lit("00"), more)))


def store_samples(payload: Column, rate: int = 8000) -> Column:
    """A WAVE file: PCM, one channel, 8 bits a sample, the payload's bytes as samples. Payloads are under 4 GiB, as RIFF lengths are 32 bits; a binary column holds less than 2 GiB anyway."""
    n = F.octet_length(payload).cast("bigint")
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data"
    return F.concat(F.lit(b"RIFF"), _le32(n + 36), F.lit(head), _le32(n), payload)


def read_samples(medium: Column) -> Column:
    """The samples of a file that store_samples wrote, by the length that its data chunk states."""
    n = F.conv(F.hex(F.concat(*(F.substring(medium, 44 - i, 1) for i in range(4)))), 16, 10).cast("int")
    return F.substring(medium, F.lit(45), n)
