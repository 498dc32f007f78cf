"""Writer of valid journal files, for tests and examples."""

from __future__ import annotations

import hashlib
import hmac
import lzma
import os
import struct
import uuid
from array import array
from collections.abc import Callable, Iterator
from itertools import islice
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    import pyarrow as pa
    from pyspark.sql import DataFrame

import numpy as np

from brindle.functions.hashes import jenkins64_many, siphash24_many
from brindle.sources.format import COMPACT, DATA, DATA_HASH, ENTRY, ENTRY_ARRAY, KEYED, LZ4, SEALED, SIGNATURE, TAG, XZ, ZSTD

BASE = 1_700_000_000_000_000


def ident(seed: int) -> bytes:
    return bytes((seed + i) % 256 for i in range(16))


def unit_fields(seed: int, i: int, unit: str) -> list[tuple[str, bytes]]:
    return [(k, v.encode()) for k, v in (("_SYSTEMD_UNIT", unit), ("UNIT", unit), ("OBJECT_SYSTEMD_UNIT", unit), ("MESSAGE", f"synthetic-message-{seed}-{i}-{unit}"), ("PRIORITY", str(i % 7 + 1)), ("SYSLOG_IDENTIFIER", f"synthetic-{seed}"))]


def _packer(kind: str | None) -> tuple[Callable[[bytes], bytes], int, int]:
    """(compression of a payload, object flag, header flag)."""
    if kind == "xz":  # payloads are short; a preset's dictionary of megabytes would be set up for each
        filters = [{"id": lzma.FILTER_LZMA2, "preset": 0, "dict_size": 1 << 16}]
        return lambda p: lzma.compress(p, lzma.FORMAT_XZ, filters=filters), 1, XZ
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdCompressor().compress, 4, ZSTD
    if kind == "lz4":
        import pyarrow

        codec = pyarrow.Codec("lz4_raw")
        return lambda p: struct.pack("<Q", len(p)) + codec.compress(p).to_pybytes(), 2, LZ4
    return lambda p: p, 0, 0


#: Entries that are laid out at once, payloads whose DATA objects are remembered, and postings that wait for their arrays.
BATCH, HELD, PENDING = 8192, 1 << 16, 1 << 20
_HEAD = [("kind", "u1"), ("flag", "u1"), ("_", "V6"), ("size", "<u8")]
_ENTRY = np.dtype([*_HEAD, ("seqnum", "<u8"), ("realtime", "<u8"), ("monotonic", "<u8"), ("boot", "V16"), ("xor", "<u8")])
_DATA = [*_HEAD, ("hash", "<u8"), ("next", "<u8"), ("field", "<u8"), ("first", "<u8"), ("array", "<u8"), ("n", "<u8")]


class _Held:
    """A DATA object that more entries may still refer to: its place, its hash, how many entries hold it, those that no
    array lists yet, and its first and last array."""

    __slots__ = ("array", "at", "hash", "last", "n", "waiting")

    def __init__(self, at: int, hash_: int) -> None:
        self.at, self.hash, self.n, self.array, self.last = at, hash_, 0, 0, 0
        self.waiting: array | None = None


class Writer:
    """Writes a file entry by entry in bounded memory, and moves it to its path at close().

    What lies before an entry depends on the entries before it alone, but for pointers and counts. An entry's new DATA
    objects come right before it. Equal payloads share a DATA object while it is among the HELD last ones; later they get a
    further one, which readers of the format expect. Its entries beyond the first are listed by a chain of arrays.
    """

    def __init__(self, path: str, ids: tuple[bytes, bytes, bytes], boot: bytes, *, compact: bool = False, keyed: bool = False, compression: str | None = None, seal: object = None, epochs: tuple[int, ...] = (0, 1), buckets: int = 4, first_array: int = 64, state: int = 1) -> None:
        self.path, self.ids, self.compact, self.keyed, self.epochs, self.seal = path, ids, compact, keyed, epochs, seal
        self.pack, self.flag, header_flag = _packer(compression)
        self.first_array, self.width = first_array, 4 if compact else 8
        self.data = np.dtype([*_DATA, ("more", "V8")] if compact else _DATA)
        self.at, self.n_objects, self.n_entries, self.tail, self.tail_entry = 272, 0, 0, 0, 0
        self.known: dict[bytes, _Held] = {}
        self.n_waiting = 0
        self.first, self.final = np.zeros(buckets, np.uint64), np.zeros(buckets, np.uint64)
        self.header = bytearray(272)
        flags = (COMPACT if compact else 0) | (KEYED if keyed else 0) | header_flag
        struct.pack_into("<8sIIB7x", self.header, 0, SIGNATURE, SEALED if seal is not None else 0, flags, state)
        struct.pack_into("<16s16s16s16s", self.header, 24, ids[0], ids[1], boot, ids[2])
        self.table = 272 + 16
        struct.pack_into("<QQQQ", self.header, 88, 272, 0, self.table, 16 * buckets)
        self.mac = self.n_tags = None
        if seal is not None:
            from brindle.operators.seal import HEADER_RANGES

            self.n_tags = 0
            self._new_mac()
            for start, n in HEADER_RANGES:
                self.mac.update(self.header[start : start + n])
        self.new = f"{path}.{uuid.uuid4().hex}.new"
        self.fd = os.open(self.new, os.O_RDWR | os.O_CREAT | os.O_EXCL, 0o644)
        try:
            self._put(DATA_HASH, b"\0" * 16 * buckets)
            self.slots = first_array
            self.array = self.filling = self.last_array = self._put(ENTRY_ARRAY, b"\0" * (8 + self.width * first_array))
            self.slots_before = 0
            if seal is not None:
                self._tag()
        except BaseException:
            self.abort()
            raise

    def _new_mac(self) -> None:
        self.mac = hmac.new(self.seal.key(self.epochs[min(self.n_tags, len(self.epochs) - 1)]), digestmod=hashlib.sha256)

    def _write(self, at: int, raw) -> None:
        raw = memoryview(raw).cast("B")
        while len(raw):
            n = os.pwrite(self.fd, raw, at)
            at, raw = at + n, raw[n:]

    def _put(self, kind: int, body: bytes) -> int:
        """An object other than DATA and ENTRY at the end."""
        at, size = self.at, 16 + len(body)
        if self.seal is not None:
            size = -(-size // 8) * 8
        raw = struct.pack("<BB6xQ", kind, 0, size) + body
        raw += b"\0" * (-len(raw) % 8)
        if self.mac is not None:
            self.mac.update(raw[: 32 if kind == TAG else 16])
        self._write(at, raw)
        self.at, self.tail, self.n_objects = at + len(raw), at, self.n_objects + 1
        return at

    def _tag(self) -> None:
        at = self._put(TAG, struct.pack("<QQ32s", self.n_tags + 1, self.epochs[self.n_tags], b""))
        self._write(at + 32, self.mac.digest())
        self.n_tags += 1
        self._new_mac()

    def _list(self, held: _Held) -> None:
        """An array of what waits, linked from the DATA object or from its last array; and the object's count."""
        if held.waiting:
            code = "<u4" if self.compact else "<u8"
            items = np.frombuffer(held.waiting, np.uint64).astype(code).tobytes()
            at = self._put(ENTRY_ARRAY, b"\0" * 8 + items + b"\0" * (-len(items) % 8))
            if held.last:
                self._write(held.last + 16, struct.pack("<Q", at))
            held.array, held.last = held.array or at, at
            self.n_waiting -= len(held.waiting)
            held.waiting = None
            self._write(held.at + 48, struct.pack("<QQ", held.array, held.n))

    def add(self, heads: tuple[np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray], offsets: np.ndarray, payloads: pa.Array) -> None:
        """Entries: (seqnums, times, monotonic times, boot ids on end, xor hashes), where each one's payloads begin (one
        more at the end), and the payloads. All calls but the last bring BATCH entries."""
        n, counts = len(offsets) - 1, np.diff(offsets)
        if not n:
            return
        coded = payloads.dictionary_encode()
        codes, uniq = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
        of_item = np.repeat(np.arange(n), counts)
        at, hashes, held, new = np.zeros(len(uniq), np.uint64), np.zeros(len(uniq), np.uint64), {}, []
        for i, p in enumerate(uniq):
            if (h := self.known.pop(p, None)) is None:
                new.append(i)
            else:
                self.known[p] = held[i] = h  # among the last ones again
                at[i], hashes[i] = h.at, h.hash
        new = np.array(new, np.int64)
        texts = [uniq[i] for i in new.tolist()]
        hashes[new] = siphash24_many(self.ids[0], texts) if self.keyed else jenkins64_many(texts)
        packed = [self.pack(p) for p in texts]
        if self.seal is not None:  # sealed sizes are aligned: pad the value with blanks
            packed = [p.ljust(-(-len(p) // 8) * 8) for p in packed]
        sizes = self.data.itemsize + np.array([len(p) for p in packed], np.int64)
        padded = -(-sizes // 8) * 8
        of_new = of_item[np.unique(codes, return_index=True)[1][new]] if len(new) else new
        data = np.bincount(of_new, weights=padded, minlength=n).astype(np.int64)
        entry = 64 + -(-counts * (4 if self.compact else 16) // 8) * 8
        grown: list[tuple[int, int]] = []  # (entry, slots) of each further array of slots
        while self.slots < self.n_entries + n:
            more = max(self.first_array, self.slots + self.first_array)
            grown.append((self.slots - self.n_entries, more))
            self.slots += more
        arrays = np.zeros(n, np.int64)
        for i, more in grown:
            arrays[i] = -(-(24 + self.width * more) // 8) * 8
        ends = np.cumsum(data + arrays + entry)
        start = self.at + ends - (data + arrays + entry)
        entry_at = start + data + arrays
        data_at = start[of_new] + (np.cumsum(padded) - padded) - (np.cumsum(data) - data)[of_new]
        at[new] = data_at
        out = np.zeros(int(ends[-1]), np.uint8)
        # which entries hold which payload, each once
        order = np.argsort(codes, kind="stable")
        c, e = codes[order], of_item[order]
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != c[:-1]) | (e[1:] != e[:-1])
        c, e = c[keep], entry_at[e[keep]].astype(np.uint64)
        bounds = np.searchsorted(c, np.arange(len(uniq) + 1))
        holders = np.diff(bounds)
        rows = np.zeros(len(new), self.data)
        rows["kind"], rows["flag"], rows["size"], rows["hash"] = DATA, self.flag, sizes, hashes[new]
        rows["first"], rows["n"] = e[bounds[new]] if len(new) else 0, holders[new]
        links = self._chained(rows, data_at)
        rel = data_at - self.at
        out[rel[:, None] + np.arange(self.data.itemsize)] = rows.view(np.uint8).reshape(len(rows), self.data.itemsize)
        view = memoryview(out)
        for i, p in zip((rel + self.data.itemsize).tolist(), packed):
            view[i : i + len(p)] = p
        for i, more in grown:
            place = int(start[i] + data[i])
            size = 24 + self.width * more
            struct.pack_into("<BB6xQ", view, place - self.at, ENTRY_ARRAY, 0, -(-size // 8) * 8 if self.seal is not None else size)
            links.append((self.last_array + 16, place))
            self.last_array = place
        lines = np.zeros(n, _ENTRY)
        lines["kind"], lines["size"], lines["boot"] = ENTRY, entry, np.frombuffer(heads[3], "V16")
        for name, x in zip(("seqnum", "realtime", "monotonic", "xor"), (*heads[:3], heads[4])):
            lines[name] = x.astype(np.int64).view(np.uint64) if x.dtype != np.uint64 else x
        rel = entry_at - self.at
        out[rel[:, None] + np.arange(64)] = lines.view(np.uint8).reshape(n, 64)
        if len(codes):
            items = at[codes].astype("<u4") if self.compact else np.column_stack([at[codes], hashes[codes]]).astype("<u8")
            width = 4 if self.compact else 16
            place = rel[of_item] + 64 + width * (np.arange(len(codes)) - offsets[of_item] + offsets[0])
            out[place[:, None] + np.arange(width)] = items.view(np.uint8).reshape(len(codes), width)
        begun, last = self.at, int(entry_at[-1])
        self._write(begun, out)
        for where, to in links:
            self._write(where, struct.pack("<Q", to))
        places = [int(start[i] + data[i]) for i, _ in grown]
        self._fill([i for i, _ in grown], places, entry_at)
        if self.mac is not None:
            self._cover(out, begun, data_at, sizes, places, entry_at, entry)
        self.at, self.tail, self.tail_entry = begun + len(out), last, last
        self.n_objects += n + len(new) + len(grown)
        self.n_entries += n
        for i, x in zip(new.tolist(), data_at.tolist()):
            self.known[uniq[i]] = h = _Held(x, int(hashes[i]))
            h.n = 1
            if holders[i] > 1:
                held[i] = h
        fresh = set(new.tolist())
        for i, h in held.items():
            more = e[bounds[i] + (i in fresh) : bounds[i + 1]]
            h.n += len(more)
            h.waiting = h.waiting or array("Q")
            h.waiting.frombytes(more.tobytes())
            self.n_waiting += len(more)
        if n == BATCH:
            if self.n_waiting > PENDING:
                for h in self.known.values():
                    self._list(h)
            if len(self.known) > HELD:
                for p in list(islice(self.known, len(self.known) - HELD // 2)):
                    self._list(self.known.pop(p))

    def _chained(self, rows: np.ndarray, places: np.ndarray) -> list[tuple[int, int]]:
        """Links new DATA objects into the hash table's chains. Returns (place, pointer) of what is to be set in the file."""
        if not len(rows):
            return []
        bucket = (rows["hash"] % np.uint64(len(self.first))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        b, x = bucket[order], places[order].astype(np.uint64)
        head = np.ones(len(b), bool)
        head[1:] = b[1:] != b[:-1]
        tail = np.append(head[1:], True)
        rows["next"][order[:-1]] = np.where(head[1:], 0, x[1:])
        before = self.final[b[head]]
        self.first[b[head]] = np.where(before == 0, x[head], self.first[b[head]])
        self.final[b[tail]] = x[tail]
        return [(p + 24, to) for p, to in zip(before.tolist(), x[head].tolist()) if p]

    def _fill(self, grown: list[int], places: list[int], entry_at: np.ndarray) -> None:
        """Puts entries into their slots, those from a grown one on into the array at its place."""
        code, done = "<u4" if self.compact else "<u8", 0
        for i, place in [*zip(grown, places), (len(entry_at), 0)]:
            if i > done:
                self._write(self.filling + 24 + self.width * (self.n_entries + done - self.slots_before), entry_at[done:i].astype(code))
            if place:
                self.filling, self.slots_before, done = place, self.n_entries + i, i

    def _cover(self, out: np.ndarray, begun: int, data_at: np.ndarray, sizes: np.ndarray, arrays: list[int], entry_at: np.ndarray, entry: np.ndarray) -> None:
        """The seal's digest over a batch, object by object."""
        start, raw = self.data.itemsize, memoryview(out)
        objects = [*((int(x), DATA, int(n)) for x, n in zip(data_at, sizes)), *((x, ENTRY_ARRAY, 16) for x in arrays), *((int(x), ENTRY, int(n)) for x, n in zip(entry_at, entry))]
        for x, kind, n in sorted(objects):
            x -= begun
            if kind == DATA:
                self.mac.update(raw[x : x + 24])
                self.mac.update(raw[x + start : x + n])
            else:
                self.mac.update(raw[x : x + n])

    def close(self, ends: tuple[int, int, int, int]) -> None:
        """ends: the header's first and last seqnum, first and last time."""
        for h in self.known.values():
            self._list(h)
        if self.seal is not None:
            self._tag()
        self._write(self.table, np.column_stack([self.first, self.final]).astype("<u8"))
        struct.pack_into("<Q", self.header, 96, self.at - 272)
        struct.pack_into("<QQQ", self.header, 136, self.tail, self.n_objects, self.n_entries)
        struct.pack_into("<QQQQQ", self.header, 160, ends[1], ends[0], self.array, ends[2], ends[3])
        struct.pack_into("<Q", self.header, 264, self.tail_entry)
        self._write(0, self.header)
        os.close(self.fd)
        self.fd = -1
        os.replace(self.new, self.path)

    def abort(self) -> None:
        """Leaves the path as it was."""
        if self.fd >= 0:
            os.close(self.fd)
            self.fd = -1
            os.unlink(self.new)


def write(path: str, units: list[str] | None = None, seed: int = 7, *, entries: list[list[tuple[str, bytes]]] | None = None, compact: bool = False, keyed: bool = False, compression: str | None = None, seal: object = None, epochs: tuple[int, ...] = (0, 1), buckets: int = 4, step: int = 100, heads: list[tuple[int, int, int, bytes, int]] | None = None, ids: tuple[bytes, bytes, bytes] | None = None, first_array: int = 64, state: int = 1) -> None:
    """A file of one entry for each unit (or each given list of fields).

    heads: (seqnum, realtime, monotonic, boot id, xor hash) of each entry; ids: file, machine and seqnum id. Entries go
    to a chain of arrays, the first of first_array slots and each further one of twice as many. seal: an Fsprg; then a tag
    stands before the first and after the last entry.
    """
    import pyarrow as pa

    rows = entries if entries is not None else [unit_fields(seed, i, u) for i, u in enumerate(units or [])]
    n, rt = len(rows), BASE + seed * 10_000
    if heads is None:
        heads = [(i + 1, rt + i * step, rt + i * step - 123, ident(seed + 34), 0) for i in range(n)]
        ends = (1 if n else 0, n, rt if n else 0, rt + (n - 1) * step if n else 0)
    else:
        ends = (heads[0][0], heads[n - 1][0], heads[0][1], heads[n - 1][1]) if heads else (0, 0, 0, 0)
    w = Writer(path, ids or (ident(seed), ident(seed + 17), ident(seed + 51)), ident(seed + 34), compact=compact, keyed=keyed, compression=compression, seal=seal, epochs=epochs, buckets=buckets, first_array=first_array, state=state)
    try:
        for i in range(0, n, BATCH):
            some, own = rows[i : i + BATCH], heads[i : i + BATCH]
            offsets = np.cumsum([0, *(len(r) for r in some)])
            numbers = [np.array([h[k] for h in own], np.uint64) for k in (0, 1, 2, 4)]
            w.add((*numbers[:3], b"".join(h[3] for h in own), numbers[3]), offsets, pa.array([f.encode() + b"=" + v for r in some for f, v in r], pa.binary()))
        w.close(ends)
    finally:
        w.abort()


#: How the files of write_entries() differ: one layout for each, in turn.
LAYOUTS: tuple[dict, ...] = ({}, {"compact": True, "keyed": True, "compression": "zstd"}, {"compression": "lz4", "state": 2}, {"compact": True, "compression": "xz", "state": 0})


#: Buckets of a file's hash table, and partitions that files are dealt to.
BUCKETS, PARTS = 1 << 16, 64


def write_entries(entries: DataFrame, root: str, layouts: tuple[dict, ...] = LAYOUTS) -> None:
    """One journal file for each file id of entry rows, file-<low byte of the id>.journal, written by the tasks. Rows of a
    file are in the order of the key; more rows at the end leave what comes before in place, as an append does. A task sees
    one file's rows one after the other, and holds a batch of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        import pyarrow.compute as pc

        held: list[pa.RecordBatch] = []
        w: Writer | None = None
        ends: list[int] = []

        def flush() -> None:
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            fields = b.column("fields")
            flat = fields.flatten()
            text = pc.binary_join_element_wise(flat.field("name").cast(pa.binary()), flat.field("value"), b"=")
            offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(fields).to_numpy(zero_copy_only=False))]).astype(np.int64)
            numbers = [b.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("seqnum", "realtime_usec", "monotonic_usec", "xor_hash")]
            w.add((*numbers[:3], b"".join(b.column("boot_id").to_pylist()), numbers[3]), offsets, text)
            if not ends:
                ends.extend((int(numbers[0][0]), 0, int(numbers[1][0]), 0))
            ends[1], ends[3] = int(numbers[0][-1]), int(numbers[1][-1])

        def finish() -> pa.RecordBatch:
            nonlocal w
            if held:
                flush()
            w.close(tuple(ends))
            path, w = w.path, None
            ends.clear()
            return pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

        try:
            for b in batches:
                runs = pc.run_end_encode(b.column("file_id"))
                start = 0
                for own, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                    if w is not None and w.ids[0] != own:
                        yield finish()
                    if w is None:
                        machine, seqnums = (b.column(c)[start].as_py() or bytes(16) for c in ("machine_id", "seqnum_id"))
                        w = Writer(f"{root}/file-{own[-1]}.journal", (own, machine, seqnums), ident(41), buckets=BUCKETS, **layouts[own[-1] % len(layouts)])
                    while start < end:
                        take = min(end - start, BATCH - sum(x.num_rows for x in held))
                        held.append(b.slice(start, take))
                        start += take
                        if sum(x.num_rows for x in held) == BATCH:
                            flush()
            if w is not None:
                yield finish()
        finally:
            if w is not None:
                w.abort()

    os.makedirs(root, exist_ok=True)
    entries.repartition(PARTS, "file_id").sortWithinPartitions("file_id", "realtime_usec", "seqnum").mapInArrow(run, "path string").collect()
