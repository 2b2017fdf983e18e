"""A reader of CBOR (RFC 8949) items from a byte stream."""

from __future__ import annotations

import datetime
import struct
from collections.abc import Iterator
from typing import Any, BinaryIO

_BREAK = object()
_FLOATS = {25: (">e", 2), 26: (">f", 4), 27: (">d", 8)}


def _exactly(f: BinaryIO, n: int) -> bytes:
    out = f.read(n)
    if len(out) != n:
        raise EOFError("CBOR data ends within an item")
    return out


def _argument(f: BinaryIO, low: int) -> int | None:
    if low < 24:
        return low
    if low < 28:
        return int.from_bytes(_exactly(f, 1 << (low - 24)), "big")
    if low == 31:
        return None
    raise ValueError(f"reserved CBOR length {low}")


def _tagged(tag: int, value: Any) -> Any:
    if tag == 0:
        return datetime.datetime.fromisoformat(value)
    if tag == 1:
        return datetime.datetime.fromtimestamp(value, datetime.timezone.utc)
    if tag in (2, 3):
        n = int.from_bytes(value, "big")
        return n if tag == 2 else -1 - n
    return value


def _item(f: BinaryIO, head: int) -> Any:
    major, low = head >> 5, head & 31
    if major == 7:
        if low in _FLOATS:
            form, n = _FLOATS[low]
            return struct.unpack(form, _exactly(f, n))[0]
        if low == 31:
            return _BREAK
        if low == 24:
            low = _exactly(f, 1)[0]
        return {20: False, 21: True}.get(low)
    n = _argument(f, low)
    if major == 0 and n is not None:
        return n
    if major == 1 and n is not None:
        return -1 - n
    if major in (2, 3):
        raw = _exactly(f, n) if n is not None else b"".join(x if isinstance(x, bytes) else x.encode() for x in _until_break(f))
        return raw if major == 2 else raw.decode()
    if major == 4:
        return [_next(f) for _ in range(n)] if n is not None else list(_until_break(f))
    if major == 5:
        flat = [_next(f) for _ in range(2 * n)] if n is not None else list(_until_break(f))
        return dict(zip(flat[::2], flat[1::2]))
    if major == 6 and n is not None:
        return _tagged(n, _next(f))
    raise ValueError("bad CBOR item")


def _until_break(f: BinaryIO) -> Iterator[Any]:
    while (x := _item(f, _exactly(f, 1)[0])) is not _BREAK:
        yield x


def _next(f: BinaryIO) -> Any:
    x = _item(f, _exactly(f, 1)[0])
    if x is _BREAK:
        raise ValueError("CBOR break outside of an item")
    return x


def items(f: BinaryIO) -> Iterator[Any]:
    """The items up to the end of the stream."""
    while head := f.read(1):
        yield _item(f, head[0])


def dumps(x: Any) -> bytes:
    """The encoding of plain values, for writing shards."""

    def head(major: int, n: int) -> bytes:
        for low, size in ((24, 1), (25, 2), (26, 4), (27, 8)):
            if n < 24:
                return bytes([major << 5 | n])
            if n < 1 << 8 * size:
                return bytes([major << 5 | low]) + n.to_bytes(size, "big")
        raise OverflowError("the number is too large for CBOR")

    if x is None or isinstance(x, bool):
        return {None: b"\xf6", False: b"\xf4", True: b"\xf5"}[x]
    if isinstance(x, int):
        return head(0, x) if x >= 0 else head(1, -1 - x)
    if isinstance(x, float):
        return b"\xfb" + struct.pack(">d", x)
    if isinstance(x, bytes):
        return head(2, len(x)) + x
    if isinstance(x, str):
        return head(3, len(x.encode())) + x.encode()
    if isinstance(x, (list, tuple)):
        return head(4, len(x)) + b"".join(map(dumps, x))
    if isinstance(x, dict):
        return head(5, len(x)) + b"".join(dumps(k) + dumps(v) for k, v in x.items())
    raise TypeError(f"no CBOR form for {type(x).__name__}")
