"""A tiled file of a few pre-aggregated rows, so that the tile source has something to read."""

from __future__ import annotations

import struct
import zlib

text = lambda s: s.encode() + b"\0"


def bed_tile(items: list[tuple[int, int, list[float]]], tracks: int) -> bytes:
    n = len(items)
    head = text("bed") + struct.pack(f"<i{n}i{n}i", n, *(x[0] for x in items), *(x[1] for x in items))
    return head + struct.pack("<i", tracks) + b"".join(struct.pack(f"<{n}f", *(x[2][t] for x in items)) for t in range(tracks))


def fixed_tile(start: int, span: int, values: list[list[float]]) -> bytes:
    n = len(values[0])
    return text("fixedStep") + struct.pack("<iii", n, start, span) + b"".join(struct.pack(f"<{n}f", *v) for v in values)


def variable_tile(starts: list[int], span: float, values: list[list[float]]) -> bytes:
    n = len(starts)
    return text("variableStep") + struct.pack("<ifi", 0, span, n) + struct.pack(f"<{n}i", *starts) + struct.pack("<i", len(values)) + b"".join(struct.pack(f"<{n}f", *v) for v in values)


def encode(datasets: dict[str, tuple[int, list[bytes | None]]], tracks: list[str], compressed: bool = True, groups: dict[str, dict[str, str]] | None = None) -> bytes:
    """A tiled file; datasets: name to tile width and tiles, None for an empty one."""
    many = lambda d: struct.pack("<i", len(d)) + b"".join(text(k) + text(v) for k, v in d.items())
    head = struct.pack("<i", 1) + text("mean") + text("OTHER") + text("track line") + struct.pack("<i", len(tracks)) + b"".join(map(text, tracks)) + text("build") + struct.pack("<i", int(compressed))
    at, body, index = 24 + len(head), b"", {}
    for name, (width, tiles) in datasets.items():
        slots = []
        for t in tiles:
            if t is None:
                slots.append((-1, 0))
                continue
            data = zlib.compress(t) if compressed else t
            slots.append((at + len(body), len(data)))
            body += data
        entry = many({"kind": "test"}) + text("float") + struct.pack("<fi", width, len(tiles)) + b"".join(struct.pack("<qi", *s) for s in slots)
        index[name] = (at + len(body), len(entry))
        body += entry
    group_index = {}
    for name, attributes in (groups or {}).items():
        entry = many(attributes)
        group_index[name] = (at + len(body), len(entry))
        body += entry
    entries = lambda d: struct.pack("<i", len(d)) + b"".join(text(k) + struct.pack("<qi", *v) for k, v in d.items())
    tail = entries(index) + entries(group_index)
    return b"TDF4" + struct.pack("<iqii", 4, at + len(body), len(tail), len(head)) + head + body + tail
