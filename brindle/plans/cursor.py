"""Resume tokens: parsing, printing, and their meaning as a place in the total order."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from brindle.functions.hashes import hex_decode
from brindle.plans.model import InvalidQuery, Key, Unsupported

PREFIX = "SJ1:"
FILE_OFFSET, NATIVE_RAW, NATIVE_FIELDS, ENTRY_KEY = 1, 2, 3, 4


@dataclass(frozen=True)
class FileOffset:
    file_id: bytes
    entry_offset: int


@dataclass(frozen=True)
class Native:
    """A cursor as the system's own tools print it; parts may be missing."""

    seqnum_id: bytes | None = None
    seqnum: int | None = None
    boot_id: bytes | None = None
    monotonic_usec: int | None = None
    realtime_usec: int | None = None
    xor_hash: int | None = None

    def parts(self) -> tuple:
        return (self.seqnum_id, self.seqnum, self.boot_id, self.monotonic_usec, self.realtime_usec, self.xor_hash)

    def check(self) -> Native:
        s, i, b, m, t, _ = self.parts()
        if (s is None or i is None) and (b is None or m is None) and t is None:
            raise InvalidQuery("native cursor missing required fields")
        return self

    def wire(self) -> str | None:
        if any(p is None for p in self.parts()):
            return None
        s, i, b, m, t, x = self.parts()
        return f"s={s.hex()};i={i:x};b={b.hex()};m={m:x};t={t:x};x={x:x}"


@dataclass(frozen=True)
class Cursor:
    at: FileOffset | Key | Native

    def __str__(self) -> str:
        if isinstance(self.at, FileOffset):
            raw = bytes([FILE_OFFSET]) + self.at.file_id + struct.pack("<Q", self.at.entry_offset)
        elif isinstance(self.at, Key):
            raw = bytes([ENTRY_KEY]) + self.at.file_id + struct.pack("<QQQ", self.at.entry_offset, self.at.seqnum, self.at.realtime_usec)
        elif (wire := self.at.wire()) is not None:
            raw = bytes([NATIVE_RAW]) + wire.encode()
        else:
            parts = self.at.parts()
            mask = sum(1 << i for i, p in enumerate(parts) if p is not None)
            raw = bytes([NATIVE_FIELDS, mask]) + b"".join(p if isinstance(p, bytes) else struct.pack("<Q", p) for p in parts if p is not None)
        return PREFIX + raw.hex()

    @staticmethod
    def of(row) -> Cursor:
        """The cursor of an entry row."""
        return Cursor(Key.of(row))

    @staticmethod
    def parse(text: str) -> Cursor:
        s = text.strip()
        if not s.startswith(PREFIX):
            return Cursor(_native(s))
        try:
            raw = hex_decode(s[len(PREFIX) :])
        except ValueError as e:
            raise InvalidQuery("cursor is not valid hex") from e
        if not raw:
            raise InvalidQuery("empty cursor")
        tag, body = raw[0], raw[1:]
        if tag == FILE_OFFSET:
            if len(body) != 24:
                raise InvalidQuery("file offset cursor has a wrong length")
            return Cursor(FileOffset(body[:16], *struct.unpack("<Q", body[16:])))
        if tag == ENTRY_KEY:
            if len(body) != 40:
                raise InvalidQuery("entry key cursor has a wrong length")
            offset, seqnum, realtime = struct.unpack("<QQQ", body[16:])
            return Cursor(Key(realtime, seqnum, body[:16], offset))
        if tag == NATIVE_RAW:
            try:
                return Cursor(_native(body.decode("utf-8")))
            except UnicodeDecodeError as e:
                raise InvalidQuery("native cursor is not UTF-8") from e
        if tag == NATIVE_FIELDS:
            return Cursor(_masked(body))
        raise Unsupported(f"unsupported cursor tag {tag}")


def _masked(body: bytes) -> Native:
    if not body:
        raise InvalidQuery("missing native cursor mask")
    mask, at, parts = body[0], 1, []
    for i, size in enumerate((16, 8, 16, 8, 8, 8)):
        if not mask >> i & 1:
            parts.append(None)
            continue
        piece = body[at : at + size]
        if len(piece) < size:
            raise InvalidQuery("native cursor is too short")
        parts.append(piece if size == 16 else int.from_bytes(piece, "little"))
        at += size
    if at != len(body):
        raise InvalidQuery("trailing bytes in native cursor payload")
    return Native(*parts).check()


def _native(text: str) -> Native:
    s = text.strip()
    if not s:
        raise InvalidQuery("empty cursor")
    names = {"s": "seqnum_id", "i": "seqnum", "b": "boot_id", "m": "monotonic_usec", "t": "realtime_usec", "x": "xor_hash"}
    found: dict = {}
    for part in s.split(";"):
        if len(part) < 2 or part[1] != "=":
            raise InvalidQuery("invalid native cursor segment")
        name, value = names.get(part[0]), part[2:]
        if name is None:
            continue
        if name.endswith("_id"):
            try:
                found[name] = hex_decode(value.replace("-", ""))
            except ValueError as e:
                raise InvalidQuery(f"{name} is not valid hex") from e
            if len(found[name]) != 16:
                raise InvalidQuery(f"{name} must be 16 bytes (32 hex digits)")
        else:
            digits = value.removeprefix("+")
            if not digits or any(c not in "0123456789abcdefABCDEF" for c in digits) or int(digits, 16) >> 64:
                raise InvalidQuery(f"{name} is not valid hex")
            found[name] = int(digits, 16)
    return Native(**found).check()
