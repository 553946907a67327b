"""What gridded variables need of HDF5 files, as NetCDF-4 uses them.

Names, attributes and the places of chunks are read by the driver; tasks read and unpack
single chunks. Both header versions, groups old and new, attributes compact or in a heap,
and the chunk indexes of files that HDF5 1.8 can read are known, of later ones all but
extensible arrays. What isn't known is an error, never a guess.
"""

from __future__ import annotations

import itertools
import math
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np

#: How files and their parts start, numbers of messages and filters.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
SPACE, LINK_INFO, TYPE, OLD_FILL, FILL, LINK, LAYOUT, FILTERS, ATTRIBUTE, CONTINUED, SYMBOLS, ATTRIBUTE_INFO = 1, 2, 3, 4, 5, 6, 8, 11, 12, 16, 17, 21
DEFLATE, SHUFFLE, FLETCHER, ZSTANDARD = 1, 2, 3, 32015
#: Fixed value: how the name of a dimension without values starts.
NO_VARIABLE = "This is a netCDF dimension but not a netCDF variable"


class Reader:
    """Little-endian numbers, one after the other, from bytes that are in memory."""

    def __init__(self, raw: bytes, at: int = 0):
        self.raw, self.at = raw, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise ValueError("the HDF5 file ends within one of its parts")
        self.at += n
        return self.raw[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def skip(self, n: int) -> Reader:
        self.take(n)
        return self

    def expect(self, name: bytes) -> Reader:
        if self.take(len(name)) != name:
            raise ValueError(f"the HDF5 file has no {name.decode()} where one should be")
        return self

    def text(self, n: int) -> str:
        return self.take(n).split(b"\0")[0].decode("utf-8", "replace")


@dataclass
class Kind:
    """A datatype: dtype of numbers and fixed texts; vlen holds the kind of the parts, text says they are characters."""

    dtype: np.dtype | None
    size: int
    vlen: Kind | None = None
    text: bool = False


@dataclass
class Chunk:
    offset: tuple[int, ...]
    address: int
    size: int
    skipped: int  # a bit for each filter that wasn't applied


@dataclass
class Dataset:
    shape: tuple[int, ...] = ()
    kind: Kind | None = None
    fill: bytes | None = None
    layout: bytes = b""
    filters: list[tuple[int, list[int]]] = field(default_factory=list)
    attributes: dict = field(default_factory=dict)


def _bytes_for(most: int) -> int:
    return max(0, most.bit_length() - 1) // 8 + 1


def unpacked(raw: bytes, filters: list[tuple[int, list[int]]], skipped: int, itemsize: int) -> bytes:
    """A chunk's bytes, its filters undone from the last to the first."""
    for i, (kind, _) in reversed(list(enumerate(filters))):
        if skipped >> i & 1:
            continue
        if kind == DEFLATE:
            raw = zlib.decompress(raw)
        elif kind == SHUFFLE:
            n = len(raw) // itemsize * itemsize
            raw = np.frombuffer(raw[:n], dtype=np.uint8).reshape(itemsize, -1).T.tobytes() + raw[n:]
        elif kind == FLETCHER:
            raw = raw[:-4]
        elif kind == ZSTANDARD:
            import zstandard

            raw = zstandard.decompress(raw)
        else:
            raise ValueError(f"HDF5 filter {kind} is not supported")
    return raw


class File:
    """Datasets of a file's root group by name."""

    def __init__(self, path: str):
        self.path, self.base = path, 0
        self._file = open(path, "rb")  # noqa: SIM115
        self.end = os.fstat(self._file.fileno()).st_size
        at = next((x for x in [0, *(512 << k for k in range(20))] if x < self.end and self._raw(x, 8) == SIGNATURE), None)
        if at is None:
            raise ValueError(f"{path} is no HDF5 file")
        r = Reader(self._raw(at, min(128, self.end - at)), 8)
        version = r.number(1)
        if version in (0, 1):
            r.skip(4)
            self.offsets, self.lengths = r.number(1), r.number(1)
            r.skip(9 if version == 0 else 13)
            self.base = self._offset(r)
            r.skip(3 * self.offsets + self.offsets)  # free space, end, driver; the root's name
        elif version in (2, 3):
            self.offsets, self.lengths = r.number(1), r.number(1)
            r.skip(1)
            self.base = self._offset(r)
            r.skip(2 * self.offsets)
        else:
            raise ValueError(f"HDF5 superblock {version} is not supported")
        self.root = self._offset(r)

    def close(self) -> None:
        self._file.close()

    def _raw(self, at: int, n: int) -> bytes:
        return os.pread(self._file.fileno(), n, at)

    def read(self, at: int, n: int) -> bytes:
        got = self._raw(self.base + at, n)
        if len(got) != n:
            raise ValueError(f"{self.path} ends before byte {self.base + at + n}")
        return got

    def _near(self, at: int, n: int) -> bytes:
        """Up to n bytes, fewer at the file's end."""
        return self._raw(self.base + at, n)

    def _offset(self, r: Reader) -> int:
        return r.number(self.offsets)

    def _is_address(self, at: int) -> bool:
        return at != (1 << 8 * self.offsets) - 1

    # --- object headers

    def messages(self, at: int) -> list[tuple[int, int, bytes]]:
        """(kind, flags, bytes) of an object's header, continuations followed."""
        start = self._near(at, 256)
        new, out = start[:4] == b"OHDR", []
        if new:
            r = Reader(start).skip(5)
            flags = r.number(1)
            r.skip((16 if flags & 32 else 0) + (4 if flags & 16 else 0))
            size = r.number(1 << (flags & 3))
            ordered, parts = bool(flags & 4), [(at + r.at, size)]
        else:
            r = Reader(start)
            if r.number(1) != 1:
                raise ValueError(f"{self.path} has an object header of an unknown version")
            r.skip(7)
            parts, ordered = [(at + 16, r.number(4))], False
        while parts:
            first, size = parts.pop(0)
            m = Reader(self.read(first, size))
            head = (6 if ordered else 4) if new else 8
            while m.at + head <= size:
                kind = m.number(1 if new else 2)
                n, flags = m.number(2), m.number(1)
                m.skip(head - (4 if new else 5))
                if m.at + n > size:
                    break
                data = m.take(n)
                if kind == CONTINUED:
                    c = Reader(data)
                    to, length = self._offset(c), c.number(self.lengths)
                    parts.append((to + 4, length - 8) if new else (to, length))
                elif kind:
                    out.append((kind, flags, self._resolved(kind, flags, data)))
        return out

    def _resolved(self, kind: int, flags: int, data: bytes) -> bytes:
        """A message's own bytes, or those of the object that shares it."""
        if not flags & 2:
            return data
        r = Reader(data)
        version, how = r.number(1), r.number(1)
        if version == 1:
            r.skip(6)
        elif version == 3 and how != 2:
            raise ValueError(f"{self.path} keeps messages in a shared table, which is not supported")
        at = self._offset(r)
        return next(d for k, _, d in self.messages(at) if k == kind)

    def kind(self, r: Reader) -> Kind:
        start = r.number(1)
        bits, size = r.number(3), r.number(4)
        of, version = start & 15, start >> 4
        order = ">" if bits & 1 else "<"
        if of == 0:
            r.skip(4)
            return Kind(np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}"), size)
        if of == 1:
            if bits & 64 or size not in (2, 4, 8):
                raise ValueError(f"{self.path} has numbers of an unusual kind")
            r.skip(12)
            return Kind(np.dtype(f"{order}f{size}"), size)
        if of == 3:
            return Kind(np.dtype(f"S{size}"), size, text=True)
        if of == 7:
            return Kind(np.dtype(f"<u{size}") if size in (1, 2, 4, 8) else None, size)
        if of == 8:
            return self.kind(r)
        if of == 9:
            inner = self.kind(r)
            return Kind(None, size, inner, bits & 15 == 1)
        return Kind(None, size)  # named, so that what holds it can be stepped over

    def space(self, r: Reader) -> tuple[int, ...] | None:
        """The shape; () for one value, None for none."""
        version, rank, _ = r.number(1), r.number(1), r.number(1)
        what = r.number(1)
        if version == 1:
            r.skip(4)
        elif what == 2:
            return None
        return tuple(r.number(self.lengths) for _ in range(rank))

    def dataset(self, at: int) -> Dataset | None:
        """The dataset at an address; None if there is another object."""
        out, found = Dataset(), {}
        for kind, flags, data in self.messages(at):
            found.setdefault(kind, []).append((flags, data))
        out.attributes = self._attributes(found)
        if LAYOUT not in found or TYPE not in found:
            return None
        out.kind = self.kind(Reader(found[TYPE][0][1]))
        out.shape = self.space(Reader(found[SPACE][0][1])) or ()
        out.layout = found[LAYOUT][0][1]
        out.fill = self._fill(found)
        if FILTERS in found:
            out.filters = self._pipeline(Reader(found[FILTERS][0][1]))
        return out

    def _fill(self, found: dict) -> bytes | None:
        if FILL in found:
            r = Reader(found[FILL][0][1])
            version = r.number(1)
            if version == 3:
                defined = r.number(1) & 32
            else:
                r.skip(2)
                defined = r.number(1) or version == 1
            if defined and (n := r.number(4)):
                return r.take(n)
        elif OLD_FILL in found:
            r = Reader(found[OLD_FILL][0][1])
            if n := r.number(4):
                return r.take(n)
        return None

    def _pipeline(self, r: Reader) -> list[tuple[int, list[int]]]:
        version, n = r.number(1), r.number(1)
        if version == 1:
            r.skip(6)
        out = []
        for _ in range(n):
            kind = r.number(2)
            named = r.number(2) if version == 1 or kind >= 256 else 0
            r.skip(2)
            values = r.number(2)
            r.skip(named + (-named % 8 if version == 1 else 0))
            out.append((kind, [r.number(4) for _ in range(values)]))
            if version == 1 and values % 2:
                r.skip(4)
        return out

    # --- attributes

    def _attributes(self, found: dict) -> dict:
        raw = [d for _, d in found.get(ATTRIBUTE, [])]
        for _, info in found.get(ATTRIBUTE_INFO, []):
            r = Reader(info).skip(1)
            r.skip(2 if r.number(1) & 1 else 0)
            heap, names = self._offset(r), self._offset(r)
            if self._is_address(heap):
                h = Heap(self, heap)
                raw += [h.object(x[: h.id_size]) for x in self.tree(names)]
        return dict(map(self._attribute, raw))

    def _attribute(self, raw: bytes) -> tuple[str, object]:
        r = Reader(raw)
        version, flags = r.number(1), r.number(1)
        sizes = [r.number(2) for _ in range(3)]
        if version == 3:
            r.skip(1)
        padded = [n + (-n % 8 if version == 1 else 0) for n in sizes]
        name = Reader(r.take(padded[0])).text(sizes[0])
        parts = [self._resolved(kind, flags << 1 & 2 if kind == TYPE else flags & 2, r.take(n)[:size]) for kind, n, size in zip((TYPE, SPACE), padded[1:], sizes[1:])]
        kind, shape = self.kind(Reader(parts[0])), self.space(Reader(parts[1]))
        if shape is None:
            return name, []
        n = math.prod(shape)
        if kind.vlen:
            values = []
            for _ in range(n):
                length, heap, index = r.number(4), self._offset(r), r.number(4)
                held = self._global(heap, index)[: length * kind.vlen.size] if length else b""
                values.append(held.split(b"\0")[0].decode("utf-8", "replace") if kind.text else np.frombuffer(held, kind.vlen.dtype).tolist() if kind.vlen.dtype else held)
            return name, values[0] if kind.text and n == 1 else values
        if kind.dtype is None:
            return name, r.take(n * kind.size)
        values = np.frombuffer(r.take(n * kind.size), kind.dtype)
        if kind.text:
            texts = [v.split(b"\0")[0].decode("utf-8", "replace").rstrip() for v in values.tolist()]
            return name, texts[0] if n == 1 else texts
        return name, values.tolist()

    def _global(self, at: int, index: int) -> bytes:
        head = Reader(self.read(at, 8 + self.lengths)).expect(b"GCOL").skip(4)
        r = Reader(self.read(at, head.number(self.lengths)), 8 + self.lengths)
        while r.at + 8 + self.lengths <= len(r.raw):
            i = r.number(2)
            n = r.skip(6).number(self.lengths)
            if i == index:
                return r.take(n)
            if not i:
                break
            r.skip(n + -n % 8)
        raise ValueError(f"{self.path} refers to a value that it doesn't hold")

    # --- groups and trees

    @cached_property
    def links(self) -> dict[str, int]:
        """Addresses of the root group's members."""
        out = {}
        for kind, _, data in self.messages(self.root):
            r = Reader(data)
            if kind == LINK:
                self._link(data, out)
            elif kind == LINK_INFO:
                r.skip(1)
                r.skip(8 if r.number(1) & 1 else 0)
                heap, names = self._offset(r), self._offset(r)
                if self._is_address(heap):
                    h = Heap(self, heap)
                    for x in self.tree(names):
                        self._link(h.object(x[4 : 4 + h.id_size]), out)
            elif kind == SYMBOLS:
                top, heap = self._offset(r), self._offset(r)
                h = Reader(self.read(heap, 8 + 2 * self.lengths + self.offsets)).expect(b"HEAP").skip(4 + 2 * self.lengths)
                names = self._offset(h)
                for entry in self._symbols(top):
                    e = Reader(entry)
                    name, to = self._offset(e), self._offset(e)
                    raw = self._near(names + name, 1024)
                    out[Reader(raw).text(len(raw))] = to
        return out

    def _link(self, raw: bytes, out: dict[str, int]) -> None:
        r = Reader(raw).skip(1)
        flags = r.number(1)
        how = r.number(1) if flags & 8 else 0
        r.skip((8 if flags & 4 else 0) + (1 if flags & 16 else 0))
        name = r.take(r.number(1 << (flags & 3))).decode("utf-8", "replace")
        if how == 0:  # hard; others lead elsewhere
            out[name] = self._offset(r)

    def _symbols(self, at: int) -> Iterator[bytes]:
        for child, _, _ in self._old_tree(at, self.lengths):
            r = Reader(self.read(child, 8)).expect(b"SNOD").skip(2)
            n, size = r.number(2), 2 * self.offsets + 24
            whole = self.read(child + 8, n * size)
            yield from (whole[i * size : (i + 1) * size] for i in range(n))

    def _old_tree(self, at: int, key: int, wanted=lambda low, high: True) -> Iterator[tuple[int, bytes, bytes]]:
        """(address, key, next key) of a version 1 tree's leaves whose keys are wanted."""
        head = Reader(self.read(at, 8 + 2 * self.offsets)).expect(b"TREE").skip(1)
        level, n = head.number(1), head.number(2)
        r = Reader(self.read(at + 8 + 2 * self.offsets, n * (key + self.offsets) + key))
        low = r.take(key)
        for _ in range(n):
            child, high = self._offset(r), r.take(key)
            if wanted(low, high):
                if level:
                    yield from self._old_tree(child, key, wanted)
                else:
                    yield child, low, high
            low = high

    def tree(self, at: int) -> Iterator[bytes]:
        """Records of a version 2 tree, in order."""
        r = Reader(self.read(at, 16 + self.offsets + 2)).expect(b"BTHD").skip(2)
        node, record, depth = r.number(4), r.number(2), r.number(2)
        r.skip(2)
        root, n = self._offset(r), r.number(2)
        if not self._is_address(root):
            return
        # how many records nodes of each level hold, and how wide their numbers are written
        upto, totals = [(node - 10) // record], [0]
        count = _bytes_for(upto[0])
        for level in range(1, depth + 1):
            pointer = self.offsets + count + totals[level - 1]
            most = (node - 10 - pointer) // (record + pointer)
            upto.append((most + 1) * upto[level - 1] + most)
            totals.append(_bytes_for(upto[level]))

        def walk(at: int, n: int, level: int) -> Iterator[bytes]:
            r = Reader(self.read(at, node)).expect(b"BTIN" if level else b"BTLF").skip(2)
            own = [r.take(record) for _ in range(n)]
            if not level:
                yield from own
                return
            for i in range(n + 1):
                to, held = self._offset(r), r.number(count)
                r.skip(totals[level - 1])
                yield from walk(to, held, level - 1)
                yield from own[i : i + 1]

        yield from walk(root, n, depth)

    # --- values

    def chunks(self, d: Dataset, axis: int = 0, first: int = 0, end: int | None = None) -> Iterator[Chunk]:
        """Chunks that hold places first to end of an axis; of contiguous data the whole as one."""
        r = Reader(d.layout)
        version, how = r.number(1), r.number(1)
        if version not in (3, 4):
            raise ValueError(f"{self.path} has data in a layout that is not supported")
        end = d.shape[axis] if end is None and d.shape else end
        if how == 1:
            at = self._offset(r)
            if self._is_address(at):
                yield Chunk((0,) * len(d.shape), at, r.number(self.lengths), 0)
            return
        if how != 2:
            raise ValueError(f"{self.path} has data in a layout that is not supported")
        size = self.chunk_shape(d)
        held = lambda c: c.offset[axis] < end and c.offset[axis] + size[axis] > first and self._is_address(c.address)
        found = self._indexed(d, r, size, axis, first, end) if version == 4 else self._by_old_tree(d, r, axis, first, end)
        yield from filter(held, found)

    def chunk_shape(self, d: Dataset) -> tuple[int, ...]:
        r = Reader(d.layout)
        version, how = r.number(1), r.number(1)
        if how != 2:
            return d.shape
        if version == 3:
            n = r.number(1)
            r.skip(self.offsets)
            return tuple(r.number(4) for _ in range(n))[:-1]
        r.skip(1)
        n, width = r.number(1), r.number(1)
        return tuple(r.number(width) for _ in range(n))[:-1]

    def _by_old_tree(self, d: Dataset, r: Reader, axis: int, first: int, end: int) -> Iterator[Chunk]:
        rank = r.number(1)
        at = self._offset(r)
        if not self._is_address(at):
            return
        size = self.chunk_shape(d)

        def offsets(key: bytes) -> tuple[int, ...]:
            k = Reader(key, 8)
            return tuple(k.number(8) for _ in range(rank))[:-1]

        def wanted(low: bytes, high: bytes) -> bool:
            # keys go by the first axis, so a branch tells how far it reaches in that alone
            return bool(axis) or (offsets(low)[0] < end and offsets(high)[0] + size[0] > first)

        for child, low, _ in self._old_tree(at, 8 + 8 * rank, wanted):
            k = Reader(low)
            n, skipped = k.number(4), k.number(4)
            yield Chunk(offsets(low), child, n, skipped)

    def _indexed(self, d: Dataset, r: Reader, size: tuple[int, ...], axis: int, first: int, end: int) -> Iterator[Chunk]:
        flags, rank, width = r.number(1), r.number(1), r.number(1)
        r.skip(rank * width)
        how, whole = r.number(1), math.prod(size) * d.kind.size
        if how == 1:
            n, skipped = (r.number(self.lengths), r.number(4)) if flags & 2 else (whole, 0)
            yield Chunk((0,) * len(size), self._offset(r), n, skipped)
            return
        counts = [-(-n // s) for n, s in zip(d.shape, size)]
        places = lambda: (tuple(i * s for i, s in zip(ids, size)) for ids in itertools.product(*map(range, counts)))
        if how == 2:
            at = self._offset(r)
            yield from (Chunk(p, at + i * whole, whole, 0) for i, p in enumerate(places()))
        elif how == 3:
            r.skip(1)
            for p, (at, n, skipped) in zip(places(), self._fixed_array(self._offset(r), whole)):
                yield Chunk(p, at, n, skipped)
        elif how == 5:
            r.skip(6)
            wide = min(8, 1 + (max(0, whole.bit_length() - 1) + 8) // 8)
            for record in self.tree(self._offset(r)):
                e = Reader(record)
                at = self._offset(e)
                n, skipped = (e.number(wide), e.number(4)) if d.filters else (whole, 0)
                yield Chunk(tuple(e.number(8) * s for s in size), at, n, skipped)
        else:
            raise ValueError(f"{self.path} has chunks in an extensible array, which is not supported; repack it")

    def _fixed_array(self, at: int, whole: int) -> Iterator[tuple[int, int, int]]:
        r = Reader(self.read(at, 8 + self.lengths + self.offsets)).expect(b"FAHD").skip(1)
        filtered, entry, bits = r.number(1), r.number(1), r.number(1)
        n, block = r.number(self.lengths), self._offset(r)
        if not self._is_address(block):
            return
        start, page = 6 + self.offsets, 1 << bits

        def entries(raw: bytes) -> Iterator[tuple[int, int, int]]:
            e = Reader(raw)
            for _ in range(len(raw) // entry):
                to = self._offset(e)
                yield (to, e.number(entry - self.offsets - 4), e.number(4)) if filtered else (to, whole, 0)

        Reader(self.read(block, 4)).expect(b"FADB")
        if n <= page:
            yield from entries(self.read(block + start, n * entry))
            return
        pages = -(-n // page)
        made = self.read(block + start, -(-pages // 8))
        at = block + start + len(made) + 4
        for k in range(pages):
            held = min(page, n - k * page)
            if made[k // 8] >> (7 - k % 8) & 1:
                yield from entries(self.read(at, held * entry))
            else:
                yield from (((1 << 8 * self.offsets) - 1, 0, 0) for _ in range(held))
            at += page * entry + 4

    def values(self, d: Dataset, chunk: Chunk) -> np.ndarray:
        """A chunk's values, cut where the dataset ends."""
        size = self.chunk_shape(d)
        raw = unpacked(self.read(chunk.address, chunk.size), d.filters, chunk.skipped, d.kind.size)
        whole = np.frombuffer(raw, d.kind.dtype, math.prod(size)).reshape(size)
        return whole[tuple(slice(0, n - o) for n, o in zip(d.shape, chunk.offset))]

    def parts(self, d: Dataset, axis: int, first: int, end: int, part: int = 0, of: int = 1) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
        """(start, values) of blocks that make up places first to end of an axis, every of-th from part on.

        Blocks are chunks, cut where the range ends; chunks that were never written hold
        the fill value. Of contiguous data no more than the range is read, if its axis is the first.
        """
        r = Reader(d.layout)
        version, how = r.number(1), r.number(1)
        if how == 0 and version in (3, 4):
            whole, offset = np.frombuffer(r.take(r.number(2)), d.kind.dtype).reshape(d.shape), (0,) * len(d.shape)
            found = {offset: whole} if part == 0 else {}
        elif how == 1 and d.shape and axis == 0:
            found = {}
            row, at = math.prod(d.shape[1:]), self._offset(r)
            a, b = (first + (end - first) * k // of for k in (part, part + 1))
            if b > a:
                raw = self.read(at + a * row * d.kind.size, (b - a) * row * d.kind.size) if self._is_address(at) else None
                values = np.frombuffer(raw, d.kind.dtype) if raw is not None else np.full((b - a) * row, self.fill_value(d), d.kind.dtype)
                found[(a, *(0 for _ in d.shape[1:]))] = values.reshape(b - a, *d.shape[1:])
        else:
            size = self.chunk_shape(d)
            held = {c.offset: c for c in self.chunks(d, axis, first, end)}
            ranges = [range(first // s * s if k == axis else 0, end if k == axis else n, s) for k, (n, s) in enumerate(zip(d.shape, size))]
            for i, offset in enumerate(itertools.product(*ranges)):
                if i % of != part:
                    continue
                if offset in held:
                    values = self.values(d, held[offset])
                else:
                    values = np.full([min(s, n - o) for s, n, o in zip(size, d.shape, offset)], self.fill_value(d), d.kind.dtype)
                yield self._cut(offset, values, axis, first, end)
            return
        for offset, values in found.items():
            yield self._cut(offset, values, axis, first, end)

    @staticmethod
    def _cut(offset: tuple[int, ...], values: np.ndarray, axis: int, first: int, end: int) -> tuple[tuple[int, ...], np.ndarray]:
        if not offset:
            return offset, values
        a, b = max(first, offset[axis]), min(end, offset[axis] + values.shape[axis])
        cut = tuple(slice(a - offset[axis], b - offset[axis]) if k == axis else slice(None) for k in range(values.ndim))
        return tuple(a if k == axis else o for k, o in enumerate(offset)), values[cut]

    def whole(self, d: Dataset) -> np.ndarray:
        """All values; for coordinates."""
        out = np.full(d.shape, self.fill_value(d), d.kind.dtype)
        for start, v in self.parts(d, 0, 0, d.shape[0] if d.shape else 1):
            out[tuple(slice(o, o + n) for o, n in zip(start, v.shape))] = v
        return out

    def fill_value(self, d: Dataset):
        return np.frombuffer(d.fill, d.kind.dtype)[0] if d.fill else np.zeros(1, d.kind.dtype)[0]


class Heap:
    """Objects of a fractal heap by their ids."""

    def __init__(self, file: File, at: int):
        self.file, o, n = file, file.offsets, file.lengths
        r = Reader(file.read(at, 26 + 12 * n + 3 * o)).expect(b"FRHP").skip(1)
        self.id_size, filtered = r.number(2), r.number(2)
        if filtered:
            raise ValueError(f"{file.path} has a compressed heap, which is not supported")
        r.skip(1)
        most = r.number(4)
        r.skip(n + o + n + o + 8 * n)
        self.width, self.start, self.largest, bits = r.number(2), r.number(n), r.number(n), r.number(2)
        r.skip(2)
        self.root, self.rows = file._offset(r), r.number(2)
        self.at_size = (bits + 7) // 8
        self.length_size = min(_bytes_for(self.largest), (max(0, most.bit_length() - 1) + 7) // 8)

    def object(self, key: bytes) -> bytes:
        r = Reader(key)
        how = r.number(1) >> 4 & 3
        if how == 2:  # in the id itself
            return key[1 : 2 + (key[0] & 15)]
        if how:
            raise ValueError(f"{self.file.path} has an attribute too large for its heap's blocks, which is not supported")
        at, n = r.number(self.at_size), r.number(self.length_size)
        block, start = self._block(self.root, self.rows, 0, at)
        return self.file.read(block + at - start, n)

    def _block(self, address: int, rows: int, start: int, at: int) -> tuple[int, int]:
        """(address, heap offset) of the direct block that holds offset `at`."""
        if not rows:
            return address, start
        f = self.file
        r = Reader(f.read(address, 5 + f.offsets + self.at_size + rows * self.width * f.offsets)).expect(b"FHIB").skip(1 + f.offsets + self.at_size)
        for row in range(rows):
            size = self.start << max(0, row - 1)
            for _ in range(self.width):
                child = f._offset(r)
                if start <= at < start + size:
                    inner = 0 if size <= self.largest else (size // (self.start * self.width)).bit_length()
                    return self._block(child, inner, start, at)
                start += size
        raise ValueError(f"{f.path} refers to a place outside its heap")
