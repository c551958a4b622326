"""Block-compressed files, their virtual offsets and interval bins.

A file is a row of compressed blocks; a virtual offset is the place of a block and, in its
lower 16 bits, a place within its data. Intervals are indexed by bins of six sizes, each
an eighth of the one above, and by the least offset of each 16 KB window. Files are opened
through pyarrow, so a path may be any that it knows.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

from pyarrow import fs

#: The empty block that ends a file, and a block's fixed head (fixed values of the format).
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
HEAD = struct.pack("<4BI2BH", 31, 139, 8, 4, 0, 0, 255, 6)
DATA, WINDOW, LEVELS = 0xFF00, 14, 5


def opened(path: str):
    """A file that can be read at any place."""
    if "://" in path or path.startswith("file:"):
        system, path = fs.FileSystem.from_uri(path)
        return system.open_input_file(path)
    return fs.LocalFileSystem().open_input_file(path)


def block(data: bytes) -> bytes:
    """One compressed block of at most DATA bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return HEAD + struct.pack("<2sHH", b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


class Writer:
    """Compresses what it is given; `at` is the virtual offset of what comes next."""

    def __init__(self):
        self.out, self.held, self.place = [], bytearray(), 0

    @property
    def at(self) -> int:
        return self.place << 16 | len(self.held)

    def write(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= DATA:
            self._put(DATA)

    def flush(self) -> None:
        """Ends the block, so that what comes next begins one."""
        if self.held:
            self._put(len(self.held))

    def _put(self, n: int) -> None:
        made = block(bytes(self.held[:n]))
        del self.held[:n]
        self.out.append(made)
        self.place += len(made)

    def close(self) -> bytes:
        self.flush()
        return b"".join(self.out) + END


class Reader:
    """Data of a file from one virtual offset up to another; blocks are read one by one."""

    def __init__(self, path: str, begin: int = 0, end: int | None = None):
        self.file, self.place, self.end = opened(path), begin >> 16, end
        self.size, self.data, self.within, self.blocks = self.file.size(), b"", 0, 0
        self.next = self.place
        if self.next < self.size:
            self._block()
            self.within = begin & 0xFFFF

    def _block(self) -> bool:
        self.place = self.next
        if self.place >= self.size:
            self.data, self.within = b"", 0
            return False
        self.file.seek(self.place)
        head = self.file.read(18)
        if head[:4] != HEAD[:4]:
            raise ValueError("not a block-compressed file")
        extra = struct.unpack("<H", head[10:12])[0]
        rest, size, at = head[12:18] + self.file.read(extra - 6), 0, 0
        while at < extra:  # the block's size stands in one of the extra fields
            name, n = rest[at : at + 2], struct.unpack("<H", rest[at + 2 : at + 4])[0]
            if name == b"BC":
                size = struct.unpack("<H", rest[at + 4 : at + 6])[0] + 1
            at += 4 + n
        body = self.file.read(size - 12 - extra)
        self.data, self.within, self.next, self.blocks = zlib.decompress(body[:-8], -15), 0, self.place + size, self.blocks + 1
        return True

    @property
    def at(self) -> int:
        return (self.next << 16) if self.within >= len(self.data) else (self.place << 16 | self.within)

    def more(self) -> bool:
        """Whether anything is left before the end."""
        while self.within >= len(self.data):
            if self.end is not None and self.next << 16 >= self.end or not self._block():
                return False
        return self.end is None or self.at < self.end

    def read(self, n: int) -> bytes:
        parts = []
        while n > 0:
            if self.within >= len(self.data) and not self._block():
                break
            piece = self.data[self.within : self.within + n]
            self.within += len(piece)
            n -= len(piece)
            parts.append(piece)
        return b"".join(parts)

    def line(self) -> bytes:
        parts = []
        while self.within < len(self.data) or self._block():
            stop = self.data.find(b"\n", self.within)
            piece = self.data[self.within : stop + 1 if stop >= 0 else len(self.data)]
            self.within += len(piece)
            parts.append(piece)
            if stop >= 0:
                break
        return b"".join(parts)

    def close(self) -> None:
        self.file.close()


def first_of(level: int) -> int:
    """Number of the first bin of a level; level 0 is one bin for all."""
    return ((1 << 3 * level) - 1) // 7


def bin_of(start: int, end: int) -> int:
    """The smallest bin that holds an interval."""
    end = max(end, start + 1) - 1
    for level in range(LEVELS, 0, -1):
        shift = WINDOW + 3 * (LEVELS - level)
        if start >> shift == end >> shift:
            return first_of(level) + (start >> shift)
    return 0


def bins_over(start: int, end: int) -> Iterator[int]:
    """All bins that may hold what overlaps an interval."""
    end = max(end, start + 1) - 1
    for level in range(LEVELS + 1):
        shift = WINDOW + 3 * (LEVELS - level)
        yield from range(first_of(level) + (start >> shift), first_of(level) + (end >> shift) + 1)


class Index:
    """Chunks by bin and least offsets by window, for each contig."""

    def __init__(self):
        self.bins: dict = defaultdict(lambda: defaultdict(list))
        self.windows: dict = defaultdict(dict)

    def add(self, contig, start: int, end: int, begin: int, past: int) -> None:
        chunks = self.bins[contig][bin_of(start, end)]
        if chunks and chunks[-1][1] >> 16 == begin >> 16:
            chunks[-1] = (chunks[-1][0], past)
        else:
            chunks.append((begin, past))
        for window in range(start >> WINDOW, (max(end, start + 1) - 1 >> WINDOW) + 1):
            self.windows[contig].setdefault(window, begin)

    def chunks(self, contig, start: int, end: int) -> list[tuple[int, int]]:
        """Stretches of the file that hold all that overlaps an interval, in order, joined
        where they meet."""
        if contig not in self.bins:
            return []
        windows = self.windows[contig]
        before = [w for w in windows if w <= start >> WINDOW]
        least = windows[max(before)] if before else 0
        held = sorted(c for b in bins_over(start, end) for c in self.bins[contig].get(b, ()) if c[1] > least)
        out: list[list[int]] = []
        for begin, past in held:
            begin = max(begin, least)
            if out and begin <= out[-1][1]:
                out[-1][1] = max(out[-1][1], past)
            else:
                out.append([begin, past])
        return [tuple(c) for c in out]

    def starts(self) -> list[int]:
        """Offsets at which a record begins."""
        chunk = {c[0] for bins in self.bins.values() for chunks in bins.values() for c in chunks}
        return sorted(chunk | {o for w in self.windows.values() for o in w.values()})

    def packed(self, contigs: int) -> bytes:
        """The index as it stands beside a file of binary alignments."""
        out = [b"BAI\1", struct.pack("<i", contigs)]
        for contig in range(contigs):
            bins, windows = self.bins.get(contig, {}), self.windows.get(contig, {})
            out.append(struct.pack("<i", len(bins)))
            for number, chunks in sorted(bins.items()):
                out.append(struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
            last = max(windows, default=-1)
            out.append(struct.pack("<i", last + 1))
            out.append(b"".join(struct.pack("<Q", windows.get(w, 0)) for w in range(last + 1)))
        return b"".join(out)

    @classmethod
    def unpacked(cls, data: bytes) -> Index:
        out, at = cls(), 8
        if data[:4] != b"BAI\1":
            raise ValueError("not an alignment index")
        for contig in range(struct.unpack_from("<i", data, 4)[0]):
            n = struct.unpack_from("<i", data, at)[0]
            at += 4
            for _ in range(n):
                number, chunks = struct.unpack_from("<Ii", data, at)
                at += 8
                if number < first_of(LEVELS + 1):  # a bin past the last holds counts
                    out.bins[contig][number] = [struct.unpack_from("<QQ", data, at + 16 * k) for k in range(chunks)]
                at += 16 * chunks
            n = struct.unpack_from("<i", data, at)[0]
            at += 4
            for window in range(n):
                if offset := struct.unpack_from("<Q", data, at + 8 * window)[0]:
                    out.windows[contig][window] = offset
            at += 8 * n
        return out
