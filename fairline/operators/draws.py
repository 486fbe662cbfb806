"""Poisson(1) draws of rows from md5 digests, computed for many rows at once.

A row draws four replicates from each md5 of "id|number", 32 bits a replicate, big-endian as the digest is printed. The digests of rows whose
ids are equally long differ in few words of the block, so all rows take each step of the digest together.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Rows that take a step together; larger arrays leave the cache.
ROWS = 16_384
#: Groups whose sums a task holds before it hands them on.
HELD = 200

_K = [int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64)]
_SHIFT = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MASK = 0xFFFFFFFF


def _md5_words(words: list, rows: int) -> np.ndarray:
    """The four words of the digests of one-block messages, as printed; a word is (values of the rows or None, what all add to it)."""
    a, b, c, d = (np.full(rows, x, np.uint32) for x in _START)
    f = np.empty(rows, np.uint32)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            g = 7 * i % 16
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        own, shared = words[g]
        a += f
        if own is not None:
            a += own
        a += np.uint32((shared + _K[i]) & _MASK)
        s = _SHIFT[i // 16][i % 4]
        np.left_shift(a, np.uint32(s), out=f)
        a >>= np.uint32(32 - s)
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    out = np.stack([a, b, c, d])
    out += np.array(_START, np.uint32)[:, None]
    return out.byteswap(inplace=True)


def digests(prefixes: list[bytes], n: int) -> Iterator[np.ndarray]:
    """For 0 .. n - 1: the md5 of prefix and number as four words of 32 bits a row. All prefixes are of one length."""
    rows, size = len(prefixes), len(prefixes[0])
    if size + len(str(n - 1)) > 55:                                       # more than one block
        for k in range(n):
            whole = b"".join(hashlib.md5(p + str(k).encode(), usedforsecurity=False).digest() for p in prefixes)
            yield np.ascontiguousarray(np.frombuffer(whole, ">u4").reshape(rows, 4).T.astype(np.uint32))
        return
    block = np.zeros((rows, 64), np.uint8)
    if size:
        block[:, :size] = np.frombuffer(b"".join(prefixes), np.uint8).reshape(rows, size)
    own = np.ascontiguousarray(block.view("<u4").T.astype(np.uint32))
    for k in range(n):
        tail = bytearray(64)
        end = str(k).encode()
        tail[size:size + len(end) + 1] = end + b"\x80"
        tail[56:64] = (8 * (size + len(end))).to_bytes(8, "little")
        shared = np.frombuffer(bytes(tail), "<u4").tolist()
        yield _md5_words([(own[j] if 4 * j < size else None, shared[j]) for j in range(16)], rows)


def counts(u: np.ndarray, limits: list[int]) -> np.ndarray:
    """How many of the limits each value has reached."""
    w = np.zeros(u.shape, np.uint8)
    for t in limits[:5]:
        w += (u >= np.uint32(t)).view(np.uint8)
    if len(limits) > 5:
        rare = np.nonzero(u >= np.uint32(limits[5]))
        w[rare] = np.searchsorted(np.array(limits, np.uint64), u[rare].astype(np.uint64), side="right")
    return w


def replicate_sums(batches: Iterable[pa.RecordBatch], keys: list[str], cdf: tuple, replicates: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (keys, _id, _s, _g) to sums (keys, _rep, _g, _s) of the drawn rows; a sum of nulls alone is null, replicates that drew nothing have no row."""
    limits = [t for t in (math.ceil(c * 2 ** 32) for c in cdf) if t <= _MASK]
    n = (replicates + 3) // 4
    waiting: dict[int, list] = {}
    held: dict[tuple, np.ndarray] = {}

    def draw(rows: list) -> None:
        rows.sort(key=lambda r: r[0])
        ids, groups = [r[2] for r in rows], [r[1] for r in rows]
        starts = [i for i in range(len(rows)) if i == 0 or rows[i][0] != rows[i - 1][0]]
        values = np.array([[0.0 if v is None else v for v in r[3:]] + [r[3] is not None, r[4] is not None, 1.0] for r in rows], float)
        finite = bool(np.isfinite(values).all())
        spans = [(held.setdefault(groups[lo], np.zeros((4 * n, 5))), lo, hi) for lo, hi in zip(starts, [*starts[1:], len(rows)])]
        for k, u in enumerate(digests(ids, n)):
            w = counts(u, limits).astype(float)
            for total, lo, hi in spans:
                if finite:
                    total[4 * k:4 * k + 4] += w[:, lo:hi] @ values[lo:hi]
                else:                                                     # nothing times infinity is not nothing drawn
                    for i in range(4):
                        drawn = w[i, lo:hi] > 0
                        total[4 * k + i] += (w[i, lo:hi][drawn, None] * values[lo:hi][drawn]).sum(axis=0)

    def handed() -> Iterator[pa.RecordBatch]:
        for group, total in held.items():
            at = np.flatnonzero(total[:replicates, 4] > 0)
            t = total[at]
            cols = [pa.array([v] * len(at), f.type) for v, f in zip(group, schema)]
            cols += [pa.array(at.astype(np.int32)), pa.array(t[:, 0], mask=t[:, 2] == 0), pa.array(t[:, 1], mask=t[:, 3] == 0)]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)
        held.clear()

    number: dict[tuple, int] = {}
    for b in batches:
        groups = list(zip(*(b.column(k).to_pylist() for k in keys))) if keys else [()] * b.num_rows
        for group, i, s, g in zip(groups, b.column("_id").to_pylist(), b.column("_s").to_pylist(), b.column("_g").to_pylist()):
            prefix = b"" if i is None else f"{i}|".encode()
            some = waiting.setdefault(len(prefix), [])
            some.append((number.setdefault(group, len(number)), group, prefix, g, s))
            if len(some) >= ROWS:
                draw(waiting.pop(len(prefix)))
                if len(held) > HELD:
                    yield from handed()
        if len(number) > 100 * HELD and not waiting:
            number.clear()
    for some in waiting.values():
        draw(some)
        if len(held) > HELD:
            yield from handed()
    yield from handed()
