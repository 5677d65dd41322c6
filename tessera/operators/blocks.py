"""Rows of whole numbers, dealt in packed blocks.

A task gathers many rows, and deals those of one group of keys as one block: columns as bytes of
seven bits, differences where they are sorted, compressed.  That takes a fraction of the disk that
rows of their own take.  A group is worked on in one piece, its blocks in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Numbers that a task gathers before it deals them.
GATHERED = 4_000_000
BLOCKS = "g long, kind int, data binary"


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers as bytes of seven bits, the lowest first, small ones of either sign in few; how many each takes."""
    u = ((values << 1) ^ (values >> 63)).view(np.uint64)
    n = 1 + sum((u >> np.uint64(7 * k) > 0).astype(np.int64) for k in range(1, 10))
    start, out = np.cumsum(n) - n, np.zeros(n.sum(), np.uint8)
    for k in range(n.max(initial=0)):
        on = np.flatnonzero(n > k)
        out[start[on] + k] = (u[on] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | (n[on] > k + 1).astype(np.uint8) << 7
    return out, n


def unpack(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that ``pack`` wrote, and the place after each one's last byte."""
    ends = np.flatnonzero(data < 128) + 1
    start = np.r_[0, ends][: len(ends)]
    u = np.zeros(len(ends), np.uint64)
    for k in range((ends - start).max(initial=0)):
        on = np.flatnonzero(ends - start > k)
        u[on] |= (data[start[on] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return (u >> np.uint64(1)).view(np.int64) ^ -(u & np.uint64(1)).view(np.int64), ends


def encode(columns: list[np.ndarray], near: str) -> bytes:
    """Columns of whole numbers, of any lengths, as bytes.  ``near``: a letter a column, d if its differences are kept, f if it holds doubles."""
    data = [np.ascontiguousarray(c).view(np.uint8) if d == "f" else pack(np.diff(c, prepend=c.dtype.type(0)) if d == "d" else c)[0] for c, d in zip(columns, near, strict=True)]
    raw = np.concatenate([np.array([len(x) for x in data], np.int64).view(np.uint8), *data])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def decode(data: bytes, near: str) -> list[np.ndarray]:
    """The columns that ``encode`` wrote."""
    return joined([data], near)


def joined(blocks: list[bytes], near: str) -> list[np.ndarray]:
    """The columns of several blocks, one after the other."""
    codec, w = pa.Codec("zstd"), 8 * len(near)
    raw = [codec.decompress(b[8:], int.from_bytes(b[:8], "little"), asbytes=True) for b in blocks]
    sizes = np.frombuffer(b"".join(r[:w] for r in raw), np.int64).reshape(-1, len(near))
    cuts, columns = (w + np.c_[np.zeros(len(raw), np.int64), sizes.cumsum(axis=1)]).tolist(), []
    for j, d in enumerate(near):
        data = np.frombuffer(b"".join(r[c[j] : c[j + 1]] for r, c in zip(raw, cuts, strict=True)), np.uint8)
        if d == "f":
            columns.append(data.view(np.float64))
            continue
        values, ends = unpack(data)
        if d == "d":
            stop = np.searchsorted(ends, sizes[:, j].cumsum(), side="right")
            start, total = np.r_[0, stop[:-1]][: len(stop)], np.r_[0, values.cumsum()]
            values = total[1:] - np.repeat(total[start], stop - start)
        columns.append(values)
    return columns


def group_of(key: np.ndarray, groups: int) -> np.ndarray:
    return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(groups)).astype(np.int64)


def batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    g, kind, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["g", "kind", "data"])


def dealt(g: np.ndarray, columns: list[np.ndarray], near: str, kind: int = 0, sizes: np.ndarray | None = None, values: np.ndarray | None = None) -> pa.RecordBatch:
    """A block for each group, rows sorted by ``g``; with ``sizes``, each row also has so many of ``values``, which are the last two columns."""
    if not len(g):
        return batch([])
    ends = np.r_[np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)]
    bounds = [ends] * len(columns)
    if sizes is not None:
        columns, bounds = [*columns, sizes, values], [*bounds, ends, np.r_[0, np.cumsum(sizes)][ends]]
    data, cuts = [], []  # as ``encode``, for all blocks at once: there may be many small ones
    for c, d, e in zip(columns, near, bounds, strict=True):
        if d == "f":
            own, places = np.ascontiguousarray(c).view(np.uint8), 8 * e
        else:
            if d == "d":
                start = e[:-1][e[:-1] < e[1:]]
                more = np.diff(c, prepend=c.dtype.type(0))
                more[start] = c[start]
                c = more
            own, n = pack(c)
            places = np.r_[0, np.cumsum(n)][e]
        data.append(own.tobytes())
        cuts.append(places)
    heads, w, codec, rows = np.stack([np.diff(c) for c in cuts], axis=1).astype(np.int64).tobytes(), 8 * len(cuts), pa.Codec("zstd"), []
    for k, (one, *at) in enumerate(zip(g[ends[:-1]].tolist(), *(zip(c[:-1].tolist(), c[1:].tolist(), strict=True) for c in cuts), strict=True)):
        raw = heads[k * w : k * w + w] + b"".join(x[a:b] for x, (a, b) in zip(data, at, strict=True))
        rows.append((one, kind, len(raw).to_bytes(8, "little") + codec.compress(raw, asbytes=True)))
    return batch(rows)


def ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """A task's columns, as many rows at a time as make ``GATHERED`` numbers."""
    held, n = [], 0
    for b in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        n += b.num_rows * b.num_columns
        if n >= GATHERED:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Each group with its blocks of kind 0 and of kind 1."""
    held, last = [[], []], None
    for b in batches:
        for g, kind, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if g != last and last is not None:
                yield last, held
                held = [[], []]
            last = g
            held[kind].append(data.as_py())
    if last is not None:
        yield last, held


def meet(blocks: DataFrame) -> DataFrame:
    """Blocks of a group one after the other, in one task."""
    return blocks.repartition("g").sortWithinPartitions("g")


def groups_of(df: DataFrame) -> int:
    """How many groups: several a partition, so that they even out and each is small."""
    return 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
