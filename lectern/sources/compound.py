"""Compound files: the one stream that holds an equation, and its header."""

from __future__ import annotations

import struct

from lectern.formulas.mtef import hexed

MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
FREE, END = 0xFFFFFFFF, 0xFFFFFFFE
HEADER = 28


def is_compound(data: bytes) -> bool:
    return data[:8] == MAGIC


def _chain(table: list[int], start: int) -> list[int]:
    out, seen = [], set()
    while start < len(table) and start not in seen:
        seen.add(start)
        out.append(start)
        start = table[start]
    return out


def streams(data: bytes) -> dict[str, bytes]:
    """Streams by name, of a compound file of version 3 or 4."""
    sector, mini = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    directory, _, cutoff, mini_fat, _, difat, _ = struct.unpack_from("<7I", data, 48)
    body = lambda n: data[(n + 1) * sector : (n + 2) * sector]
    longs = lambda chunk: list(struct.unpack(f"<{len(chunk) // 4}I", chunk[: len(chunk) // 4 * 4]))
    fat_sectors, seen = [n for n in struct.unpack_from("<109I", data, 76) if n < END], set()
    while difat < END and difat not in seen:
        seen.add(difat)
        *more, difat = longs(body(difat))
        fat_sectors += [n for n in more if n < END]
    fat = [n for s in fat_sectors for n in longs(body(s))]
    read = lambda start: b"".join(map(body, _chain(fat, start)))
    entries = read(directory)
    small_table, small, out = longs(read(mini_fat)) if mini_fat < END else [], b"", {}
    for at in range(0, len(entries) - 127, 128):
        width, kind = struct.unpack_from("<HB", entries, at + 64)
        start, size = struct.unpack_from("<IQ", entries, at + 116)
        name = entries[at : at + max(0, width - 2)].decode("utf-16-le", "replace")
        if kind == 5:
            small = read(start)[:size]
        elif kind == 2:
            if size < cutoff:
                content = b"".join(small[n * mini : (n + 1) * mini] for n in _chain(small_table, start))
            else:
                content = read(start)
            out[name] = content[:size]
    return out


def looks_like_equation(data: bytes, at: int = 0) -> bool:
    return len(data) > at and data[at] in (3, 4, 5)


def equation_bytes(data: bytes) -> tuple[bytes, list[dict]]:
    """The equation proper: out of its compound file, without its header.  Raises if the stream is missing."""
    warnings: list[dict] = []
    if is_compound(data):
        found = streams(data)
        if not found.get("Equation Native"):
            raise ValueError("OLE object does not contain Equation Native stream")
        data = found["Equation Native"]
    if looks_like_equation(data) or len(data) < HEADER:
        return data, warnings
    length, version, payload = struct.unpack_from("<H", data)[0], struct.unpack_from("<I", data, 2)[0], struct.unpack_from("<I", data, 8)[0]
    if length != HEADER or not looks_like_equation(data, HEADER):
        return data, warnings
    if version == 0x00020000:
        return data[HEADER : HEADER + payload if payload else None], warnings
    message = "Equation Native header did not match expected version; continuing after 28-byte header"
    warnings.append({"type": "malformed-input", "message": message, "position": 2, "hex": hexed(version, 8), "extra": {}})
    return data[HEADER:], warnings


def without_header(data: bytes) -> bytes:
    """The plainer rule of the corpus reports."""
    return data[HEADER:] if len(data) > HEADER and data[:2] == b"\x1c\x00" else data
