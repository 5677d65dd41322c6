"""A reader of MessagePack streams (the public format): one object after another, as Python values."""

from __future__ import annotations

import struct
from collections.abc import Iterator

# Fixed values of the format: type bytes of numbers, with how they are packed.
NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
# Fixed values of the format: type bytes of what has a length, with how that is packed.
TEXTS = {0xD9: ">B", 0xDA: ">H", 0xDB: ">I"}
BYTES = {0xC4: ">B", 0xC5: ">H", 0xC6: ">I"}
LISTS = {0xDC: ">H", 0xDD: ">I"}
MAPS = {0xDE: ">H", 0xDF: ">I"}
PLAIN = {0xC0: None, 0xC2: False, 0xC3: True}


def objects(data: bytes) -> Iterator[object]:
    """The objects of a stream; raises ValueError where one is cut off or of an extension type."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError("the stream ends inside an object")
        at += n
        return data[at - n : at]

    def number(form: str):
        return struct.unpack(form, take(struct.calcsize(form)))[0]

    def one() -> object:
        kind = take(1)[0]
        if kind < 0x80:
            return kind
        if kind >= 0xE0:
            return kind - 0x100
        if kind < 0x90:
            return pairs(kind & 0x0F)
        if kind < 0xA0:
            return [one() for _ in range(kind & 0x0F)]
        if kind < 0xC0:
            return take(kind & 0x1F).decode()
        if kind in PLAIN:
            return PLAIN[kind]
        if kind in NUMBERS:
            return number(NUMBERS[kind])
        if kind in TEXTS:
            return take(number(TEXTS[kind])).decode()
        if kind in BYTES:
            return take(number(BYTES[kind])).decode()
        if kind in LISTS:
            return [one() for _ in range(number(LISTS[kind]))]
        if kind in MAPS:
            return pairs(number(MAPS[kind]))
        raise ValueError(f"unknown type {kind:#x}")

    def pairs(n: int) -> dict:
        out = {}
        for _ in range(n):
            key = one()
            out[key] = one()
        return out

    while at < len(data):
        yield one()
