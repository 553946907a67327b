"""Writes small NetCDF-4 files after the published format, in the ways that libraries of several ages do."""

import itertools
import struct
import zlib

import numpy as np

NONE = 2**64 - 1


def padded(b, n=8):
    return b + b"\0" * (-len(b) % n)


def kind(v):
    """A datatype message: of numbers, fixed texts ("S"), variable texts, lists of references."""
    if v == "text":
        return struct.pack("<BBBBI", 0x19, 1, 0, 0, 16) + struct.pack("<BBBBI", 0x13, 0, 0, 0, 1)
    if v == "references":
        return struct.pack("<BBBBI", 0x19, 0, 0, 0, 16) + struct.pack("<BBBBI", 0x17, 0, 0, 0, 8)
    v = np.dtype(v)
    if v.kind == "S":
        return struct.pack("<BBBBI", 0x13, 0, 0, 0, v.itemsize)
    big, bits = int(v.str[0] == ">"), 8 * v.itemsize
    if v.kind == "f":
        e, m = {4: (8, 23), 8: (11, 52)}[v.itemsize]
        return struct.pack("<BBBBI", 0x11, 0x20 | big, bits - 1, 0, v.itemsize) + struct.pack("<HHBBBBI", 0, bits, m, e, 0, m, 2 ** (e - 1) - 1)
    return struct.pack("<BBBBI", 0x10, big | (8 if v.kind == "i" else 0), 0, 0, v.itemsize) + struct.pack("<HH", 0, bits)


class Writer:
    """style: old (superblock 0), middle (2, dense attributes) or late (3, dense links, newer chunk indexes)."""

    def __init__(self, style, index="tree"):
        self.style, self.index, self.new = style, index, style != "old"
        self.out = bytearray(512)

    def put(self, b):
        at = len(self.out)
        self.out += padded(b)
        return at

    def space(self, shape):
        dims = b"".join(struct.pack("<Q", n) for n in shape)
        return struct.pack("<BBBB", 2, len(shape), 0, 1 if shape else 0) + dims if self.new else struct.pack("<BBBBI", 1, len(shape), 0, 0, 0) + dims

    def held(self, values):
        """Parts of variable length in a global heap; what an attribute stores of them."""
        body, stored = b"", []
        for i, v in enumerate(values, 1):
            body += struct.pack("<HHIQ", i, 1, 0, len(v)) + padded(v)
        at = self.put(b"GCOL" + struct.pack("<BBHQ", 1, 0, 0, 16 + len(body) + 16) + body + bytes(16))
        for i, v in enumerate(values, 1):
            stored.append((len(v), at, i))
        return stored

    def attribute(self, name, value):
        if isinstance(value, tuple):  # references, one list for each dimension
            t, shape, raw = kind("references"), (len(value),), b"".join(struct.pack("<IQI", n // 8, at, i) for n, at, i in self.held([struct.pack("<Q", x) for x in value]))
        elif isinstance(value, str) and len(value) > 12:
            (n, at, i), = self.held([value.encode()])
            t, shape, raw = kind("text"), (), struct.pack("<IQI", n, at, i)
        elif isinstance(value, str):
            raw = value.encode() + b"\0"
            t, shape = kind(f"S{len(raw)}"), ()
        else:
            v = np.asarray(value)
            t, shape, raw = kind(v.dtype), v.shape, v.tobytes()
        key, s = name.encode() + b"\0", self.space(shape)
        if self.new:
            return struct.pack("<BBHHHB", 3, 0, len(key), len(t), len(s), 0) + key + t + s + raw
        return struct.pack("<BBHHH", 1, 0, len(key), len(t), len(s)) + padded(key) + padded(t) + padded(s) + raw

    def header(self, messages):
        """An object header whose second half lies in a continuation."""
        half = len(messages) // 2
        if self.new:
            one = lambda m: struct.pack("<BHBH", m[0], len(m[1]), 0, 7) + m[1]
            more = b"".join(map(one, messages[half:]))
            at = self.put(b"OCHK" + more + bytes(4))
            body = b"".join(map(one, messages[:half])) + one((16, struct.pack("<QQ", at, len(more) + 8))) + bytes(3)
            return self.put(b"OHDR" + struct.pack("<BBI", 2, 0x06, len(body)) + body + bytes(4))
        one = lambda m: struct.pack("<HHBBH", m[0], len(padded(m[1])), 0, 0, 0) + padded(m[1])
        more = b"".join(map(one, messages[half:]))
        at = self.put(more)
        body = b"".join(map(one, messages[:half])) + one((16, struct.pack("<QQ", at, len(more))))
        return self.put(struct.pack("<BBHIII", 1, 0, len(messages) + 1, 1, len(body), 0) + body)

    def heap(self, objects):
        """(address, ids) of a fractal heap of 512-byte blocks, four in a row below an indirect root."""
        size, head = 512, 5 + 8 + 4  # signature, version, header's address, 32-bit block offset
        blocks, ids = [bytearray(head)], []
        for x in objects:
            if len(blocks[-1]) + len(x) > size:
                blocks.append(bytearray(head))
            ids.append(struct.pack("<BIH", 0, (len(blocks) - 1) * size + len(blocks[-1]), len(x)))
            blocks[-1] += x
        assert len(blocks) <= 8  # two rows of blocks of one size
        at = [self.put(b"FHDB" + struct.pack("<BQI", 0, 0, i * size) + bytes(b[head:]) + bytes(size - len(b))) for i, b in enumerate(blocks)]
        rows = 0 if len(at) == 1 else 2
        root = at[0] if not rows else self.put(b"FHIB" + struct.pack("<BQI", 0, 0, 0) + b"".join(struct.pack("<Q", x) for x in at + [NONE] * (8 - len(at))))
        top = struct.pack("<BHHBI", 0, 7, 0, 0, 4096) + struct.pack("<QQQQ", 0, NONE, 0, NONE) + bytes(8 * 8)
        return self.put(b"FRHP" + top + struct.pack("<HQQHHQH", 4, size, 4096, 32, 1, root, rows) + bytes(4)), ids

    def tree(self, of, records, node=512):
        """A version 2 tree of one level or two."""
        size, most = len(records[0]), (node - 10) // len(records[0])
        leaf = lambda some: self.put(b"BTLF" + struct.pack("<BB", 0, of) + b"".join(some) + bytes(node))
        if len(records) <= most:
            root, n, depth = leaf(records), len(records), 0
        else:
            step = most + 1
            parts = [records[i : i + step] for i in range(0, len(records), step)]
            if len(parts[-1]) == 1:
                parts[-2], parts[-1] = parts[-2][:-1], parts[-2][-1:] + parts[-1]
            between = [p.pop() for p in parts[:-1]]
            children = [(leaf(p), len(p)) for p in parts]
            root = self.put(b"BTIN" + struct.pack("<BB", 0, of) + b"".join(between) + b"".join(struct.pack("<QB", *c) for c in children) + bytes(node))
            n, depth = len(between), 1
        return self.put(b"BTHD" + struct.pack("<BBIHHBBQHQ", 0, of, node, size, depth, 100, 40, root, n, len(records)) + bytes(4))

    def chunked(self, v, chunk, missing):
        """The layout message; chunks are shuffled and deflated, those in `missing` not written."""
        found = []
        for ids in itertools.product(*[range(-(-n // c)) for n, c in zip(v.shape, chunk)]):
            part = v[tuple(slice(i * c, (i + 1) * c) for i, c in zip(ids, chunk))]
            whole = np.zeros(chunk, v.dtype)
            whole[tuple(map(slice, part.shape))] = part
            raw = zlib.compress(np.frombuffer(whole.tobytes(), np.uint8).reshape(-1, v.itemsize).T.tobytes())
            found.append((ids, NONE if ids in missing else self.put(raw), len(raw)))
        dims = [*chunk, v.itemsize]
        if self.style != "late":
            key = lambda ids, n: struct.pack("<II", n, 0) + b"".join(struct.pack("<Q", i * c) for i, c in zip(ids, chunk)) + bytes(8)
            end = key([-(-n // c) for n, c in zip(v.shape, chunk)], 0)
            node = lambda level, keys, to: self.put(b"TREE" + struct.pack("<BBHQQ", 1, level, len(to), NONE, NONE) + b"".join(k + struct.pack("<Q", a) for k, a in zip(keys, to)) + keys[-1])
            kept = [f for f in found if f[1] != NONE]
            keys = [key(f[0], f[2]) for f in kept] + [end]
            cuts = range(0, len(kept), 3)
            leaves = [node(0, keys[i : min(i + 3, len(kept)) + 1], [f[1] for f in kept[i : i + 3]]) for i in cuts]
            root = node(1, [keys[i] for i in cuts] + [end], leaves)
            return struct.pack("<BBBQ", 3, 2, len(dims), root) + b"".join(struct.pack("<I", n) for n in dims)
        start = struct.pack("<BBBBB", 4, 2, 0, len(dims), 4) + b"".join(struct.pack("<I", n) for n in dims)
        wide = 1 + ((int(np.prod(chunk)) * v.itemsize).bit_length() - 1 + 8) // 8
        entry = lambda f: struct.pack("<Q", f[1]) + (f[2] if f[1] != NONE else 0).to_bytes(wide, "little") + bytes(4)
        if self.index == "tree":
            tree = self.tree(11, [entry(f) + b"".join(struct.pack("<Q", i) for i in f[0]) for f in found if f[1] != NONE])
            return start + struct.pack("<BIBBQ", 5, 512, 100, 40, tree)
        bits, n = (1, len(found)) if self.index == "pages" else (10, len(found))
        body = b"FADB" + struct.pack("<BBQ", 0, 1, 0)
        if n > 1 << bits:
            pages = [found[i : i + 2] for i in range(0, n, 2)]
            made = np.packbits([any(f[1] != NONE for f in p) for p in pages]).tobytes()
            body += made + bytes(4) + b"".join((b"".join(map(entry, p)) if any(f[1] != NONE for f in p) else b"\xee" * (8 + wide + 4) * len(p)) + bytes(4) for p in pages)
        else:
            body += b"".join(map(entry, found))
        block = self.put(body + bytes(4))
        head = self.put(b"FAHD" + struct.pack("<BBBBQQ", 0, 1, 8 + wide + 4, bits, n, block) + bytes(4))
        return start + struct.pack("<BBQ", 3, bits, head)

    def dataset(self, v, attributes, chunk=None, missing=(), fill=None):
        fill = v.dtype.type(0 if fill is None else fill)
        messages = [(1, self.space(v.shape)), (3, kind(v.dtype)), (5, struct.pack("<BBBBI", 2, 2, 0, 1, v.itemsize) + fill.tobytes())]
        if chunk:
            messages.append((8, self.chunked(v, chunk, missing)))
            if self.new:
                messages.append((11, struct.pack("<BB", 2, 2) + struct.pack("<HHHI", 2, 0, 1, v.itemsize) + struct.pack("<HHHI", 1, 0, 1, 6)))
            else:
                messages.append((11, struct.pack("<BBHI", 1, 2, 0, 0) + struct.pack("<HHHH", 2, 8, 0, 1) + b"shuffle\0" + struct.pack("<II", v.itemsize, 0) + struct.pack("<HHHH", 1, 8, 0, 1) + b"deflate\0" + struct.pack("<II", 6, 0)))
        else:
            messages.append((8, struct.pack("<BBQQ", 3, 1, self.put(v.tobytes()), v.nbytes)))
        made = [self.attribute(k, x) for k, x in attributes.items()]
        if self.new and len(made) > 8:
            at, ids = self.heap(made)
            records = [padded(x) + struct.pack("<BII", 0, i, 0) for i, x in enumerate(ids)]
            messages.append((21, struct.pack("<BBQQ", 0, 0, at, self.tree(8, records))))
        else:
            messages += [(12, m) for m in made]
        return self.header(messages)

    def group(self, members):
        if not self.new:
            names = b"\0" * 8
            entries = b""
            for k, at in sorted(members.items()):
                entries += struct.pack("<QQII16x", len(names), at, 0, 0)
                names = padded(names + k.encode() + b"\0")
            nodes = self.put(b"SNOD" + struct.pack("<BBH", 1, 0, len(members)) + entries)
            top = self.put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, NONE, NONE) + struct.pack("<QQQ", 0, nodes, len(names)))
            heap = self.put(b"HEAP" + struct.pack("<IQQQ", 0, len(names), NONE, self.put(names)))
            return self.header([(17, struct.pack("<QQ", top, heap))])
        links = [struct.pack("<BBQB", 1, 4, i, len(k)) + k.encode() + struct.pack("<Q", at) for i, (k, at) in enumerate(members.items())]
        if self.style == "middle":
            return self.header([(2, struct.pack("<BBQQQ", 0, 1, len(links), NONE, NONE)), *((6, x) for x in links)])
        at, ids = self.heap(links)
        return self.header([(2, struct.pack("<BBQQ", 0, 0, at, self.tree(5, [struct.pack("<I", i) + x for i, x in enumerate(ids)])))])

    def save(self, path, members):
        root = self.group(members)
        if self.style == "old":
            start = struct.pack("<BBBBBBBBHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0) + struct.pack("<QQQQ", 0, NONE, len(self.out), NONE) + struct.pack("<QQII16x", 0, root, 0, 0)
        else:
            start = struct.pack("<BBBB", 2 if self.style == "middle" else 3, 8, 8, 0) + struct.pack("<QQQQ", 0, NONE, len(self.out), root) + bytes(4)
        start = b"\x89HDF\r\n\x1a\n" + start
        self.out[: len(start)] = start
        with open(path, "wb") as f:
            f.write(self.out)


def netcdf4(path, dims, variables, style="middle", index="tree"):
    """dims: name to its values and attributes, or to a number of places without values;
    variables: name, dims, values, attributes, chunk, chunks that aren't written, fill."""
    w, members = Writer(style, index), {}
    for i, (k, v) in enumerate(dims.items()):
        if isinstance(v, int):
            members[k] = w.dataset(np.zeros(v, ">f4"), {"CLASS": "DIMENSION_SCALE", "NAME": f"This is a netCDF dimension but not a netCDF variable{v:10d}"})
        else:
            members[k] = w.dataset(v[0], {"CLASS": "DIMENSION_SCALE", "NAME": k, "_Netcdf4Dimid": np.int32(i)} | v[1])
    for name, of, v, attributes, chunk, missing, fill in variables:
        members[name] = w.dataset(v, {"DIMENSION_LIST": tuple(members[d] for d in of)} | attributes, chunk, missing, fill)
    w.save(path, members)
