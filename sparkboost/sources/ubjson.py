"""Universal Binary JSON, as far as model files use it."""

from __future__ import annotations

import struct
from typing import Any

from ..errors import IncompatibleModel

#: Type marks and their layouts.
NUMBERS = {"i": ">b", "U": ">B", "I": ">h", "l": ">i", "L": ">q", "d": ">f", "D": ">d"}


def dumps(x: Any) -> bytes:
    out = bytearray()

    def number(v: int) -> None:
        for mark, low, high in (("i", -(1 << 7), 1 << 7), ("I", -(1 << 15), 1 << 15), ("l", -(1 << 31), 1 << 31), ("L", -(1 << 63), 1 << 63)):
            if low <= v < high:
                out.extend(mark.encode() + struct.pack(NUMBERS[mark], v))
                return
        raise IncompatibleModel("a whole number is too large")

    def text(v: str) -> None:
        raw = v.encode()
        number(len(raw))
        out.extend(raw)

    def put(v: Any) -> None:
        if v is None:
            out.extend(b"Z")
        elif isinstance(v, bool):
            out.extend(b"T" if v else b"F")
        elif isinstance(v, int):
            number(v)
        elif isinstance(v, float):
            out.extend(b"D" + struct.pack(">d", v))
        elif isinstance(v, str):
            out.extend(b"S")
            text(v)
        elif isinstance(v, dict):
            out.extend(b"{")
            for key, item in v.items():
                text(key)
                put(item)
            out.extend(b"}")
        elif v and all(isinstance(i, float) for i in v):
            out.extend(b"[$D#L" + struct.pack(">q", len(v)) + struct.pack(f">{len(v)}d", *v))
        else:
            out.extend(b"[#L" + struct.pack(">q", len(v)))
            for item in v:
                put(item)

    put(x)
    return bytes(out)


def loads(raw: bytes) -> Any:
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(raw):
            raise IncompatibleModel("the document ends early")
        at += n
        return raw[at - n : at]

    def mark() -> str:
        m = take(1).decode("latin-1")
        return mark() if m == "N" else m

    def value(m: str) -> Any:
        if m in NUMBERS:
            return struct.unpack(NUMBERS[m], take(struct.calcsize(NUMBERS[m])))[0]
        if m in "TFZ":
            return {"T": True, "F": False, "Z": None}[m]
        if m == "C":
            return take(1).decode("latin-1")
        if m in "SH":
            return take(int(value(mark()))).decode()
        if m in "[{":
            return container(m == "{")
        raise IncompatibleModel(f"unknown mark {m!r}")

    def container(keyed: bool) -> Any:
        nonlocal at
        kind, size = None, None
        if raw[at : at + 1] == b"$":
            take(1)
            kind = take(1).decode("latin-1")
        if raw[at : at + 1] == b"#":
            take(1)
            size = int(value(mark()))
        if not keyed and kind in NUMBERS and size is not None:
            form = NUMBERS[kind]
            return list(struct.unpack(f">{size}{form[1]}", take(size * struct.calcsize(form))))
        items: list = []
        while size is None or len(items) < size:
            if size is None and raw[at : at + 1] == (b"}" if keyed else b"]"):
                take(1)
                break
            key = take(int(value(mark()))).decode() if keyed else None
            items.append((key, value(kind or mark())))
        return dict(items) if keyed else [v for _, v in items]

    return value(mark())
