"""Posting compression: variable-byte and Elias-gamma codes, gaps, and their sizes as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T


def vbyte_encode(numbers: Iterable[int]) -> bytes:
    """Seven bits a byte, low ones first; the high bit marks each number's last byte."""
    out = bytearray()
    for n in numbers:
        if n < 0:
            raise ValueError("variable-byte codes are for numbers from 0")
        while n >= 128:
            out.append(n & 127)
            n >>= 7
        out.append(n | 128)
    return bytes(out)


def vbyte_decode(data: bytes) -> list[int]:
    b = np.frombuffer(data, dtype=np.uint8)
    ends = np.flatnonzero(b & 128)
    if not len(ends):
        return []
    starts = np.r_[0, ends[:-1] + 1]
    place = np.arange(ends[-1] + 1) - np.repeat(starts, ends - starts + 1)
    if place.max() < 9:
        return np.add.reduceat((b[: ends[-1] + 1] & 127).astype(np.int64) << (7 * place), starts).tolist()
    return [sum(int(x & 127) << (7 * k) for k, x in enumerate(b[s : e + 1])) for s, e in zip(starts.tolist(), ends.tolist())]


def gamma_encode(numbers: Iterable[int]) -> bytes:
    """As many zeros as the number has further bits, then the number; the whole list padded with zeros to bytes."""
    parts = []
    for n in numbers:
        if n < 1:
            raise ValueError("gamma codes are for numbers from 1")
        bits = bin(n)[2:]
        parts.append("0" * (len(bits) - 1) + bits)
    whole = "".join(parts)
    whole += "0" * (-len(whole) % 8)
    return int(whole, 2).to_bytes(len(whole) // 8, "big") if whole else b""


def gamma_decode(data: bytes) -> list[int]:
    bits = "".join(f"{x:08b}" for x in data)
    out, at = [], 0
    while (one := bits.find("1", at)) >= 0:
        end = 2 * one - at + 1
        if end > len(bits):
            break
        out.append(int(bits[one:end], 2))
        at = end
    return out


def gaps(numbers: list[int]) -> list[int]:
    return [b - a for a, b in zip([0, *numbers], numbers)]


def from_gaps(deltas: list[int]) -> list[int]:
    return np.cumsum(deltas).tolist() if deltas else []


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of all lists, the list ends among them (from 0), and which lists are NULL."""
    null = np.asarray(lists.is_null())
    sizes = np.where(null, 0, np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.r_[0, np.cumsum(sizes)], null


def _binary(data: np.ndarray, ends: np.ndarray, null: np.ndarray) -> pa.Array:
    mask = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(null), [mask, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.astype(np.uint8).tobytes())], int(null.sum()))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, the ends of the values among them, and which are NULL."""
    rows = column.to_pylist()
    ends = np.r_[0, np.cumsum([len(x or b"") for x in rows], dtype=np.int64)]
    return np.frombuffer(b"".join(x or b"" for x in rows), dtype=np.uint8), ends, np.array([x is None for x in rows], dtype=bool)


def _lists(values: np.ndarray, ends: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, pa.int64()), mask=pa.array(null))


def _bit_lengths(v: np.ndarray) -> np.ndarray:
    out = np.zeros(len(v), dtype=np.int64)
    rest = v.copy()
    for k in (32, 16, 8, 4, 2, 1):
        big = rest >> k > 0
        out[big] += k
        rest = np.where(big, rest >> k, rest)
    return out + (rest > 0)


def vbyte_encode_lists(lists: pa.Array) -> pa.Array:
    """``vbyte_encode`` of every list, over the whole column at once."""
    v, ends, null = _flat(lists)
    if len(v) and v.min() < 0:
        raise ValueError("variable-byte codes are for numbers from 0")
    size = np.maximum(1, -(-_bit_lengths(v) // 7))
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    for k in range(int(size.max()) if len(v) else 0):
        more = size > k
        out[at[more] + k] = (v[more] >> (7 * k)) & 127
    out[at + size - 1] |= 128
    return _binary(out, np.r_[0, np.cumsum(size)][ends], null)


def vbyte_decode_lists(column: pa.Array) -> pa.Array:
    """``vbyte_decode`` of every value; an unfinished last number is dropped."""
    b, ends, null = _bytes_of(column)
    last = np.flatnonzero(b & 128)
    counts = np.searchsorted(last, ends)
    begin = np.r_[0, last[:-1] + 1] if len(last) else last
    # a number begins no earlier than its value
    if len(last):
        begin = np.maximum(begin, ends[np.searchsorted(counts, np.arange(len(last)), side="right") - 1])
    out = np.zeros(len(last), dtype=np.int64)
    for k in range(int((last - begin).max()) + 1 if len(last) else 0):
        more = begin + k <= last
        out[more] |= (b[begin[more] + k] & 127).astype(np.int64) << (7 * k)
    return _lists(out, counts, null)


def gap_decode_lists(column: pa.Array) -> pa.Array:
    """Numbers of variable-byte coded gaps."""
    lists = vbyte_decode_lists(column)
    v, ends, null = _flat(lists)
    sums = np.r_[0, np.cumsum(v)]
    return _lists(sums[1:] - np.repeat(sums[ends[:-1]], np.diff(ends)), ends, null)


def gamma_encode_lists(lists: pa.Array) -> pa.Array:
    """``gamma_encode`` of every list, over the whole column at once."""
    v, ends, null = _flat(lists)
    if len(v) and v.min() < 1:
        raise ValueError("gamma codes are for numbers from 1")
    length = _bit_lengths(v)
    bits = 2 * length - 1
    upto = np.r_[0, np.cumsum(bits)]
    own = upto[ends[1:]] - upto[ends[:-1]]
    whole = -(-own // 8) * 8
    base = np.cumsum(whole) - whole
    at = upto[:-1] - np.repeat(upto[ends[:-1]] - base, np.diff(ends))
    out = np.zeros(int(whole.sum()), dtype=np.uint8)
    for k in range(int(length.max()) if len(v) else 0):
        more = length > k
        out[at[more] + length[more] - 1 + k] = (v[more] >> (length[more] - 1 - k)) & 1
    return _binary(np.packbits(out), np.r_[0, np.cumsum(whole // 8)], null)


def gamma_decode_lists(column: pa.Array) -> pa.Array:
    """``gamma_decode`` of every value: the k-th numbers of all values are read together, and the last long ones by themselves."""
    b, ends, null = _bytes_of(column)
    bits = np.unpackbits(b)
    n = len(bits)
    ones = np.minimum.accumulate(np.where(bits == 1, np.arange(n), n)[::-1])[::-1] if n else np.zeros(0, dtype=np.int64)
    ones = np.r_[ones, n]
    at, stop = ends[:-1] * 8, ends[1:] * 8
    rows, firsts, sizes = [], [], []
    alive = np.arange(len(at))
    at = at.copy()
    while len(alive) > 16:
        one = ones[at[alive]]
        end = 2 * one - at[alive] + 1
        fine = (one < stop[alive]) & (end <= stop[alive])
        alive, one, end = alive[fine], one[fine], end[fine]
        rows.append(alive)
        firsts.append(one)
        sizes.append(end - one)
        at[alive] = end
    rest: list[tuple[int, int, int]] = []
    for r in alive.tolist():
        x, last = int(at[r]), int(stop[r])
        while x < last and (one := int(ones[x])) < last and (end := 2 * one - x + 1) <= last:
            rest.append((r, one, end - one))
            x = end
    if rest:
        tail = np.array(rest, dtype=np.int64)
        rows, firsts, sizes = [*rows, tail[:, 0]], [*firsts, tail[:, 1]], [*sizes, tail[:, 2]]
    row, first, size = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (rows, firsts, sizes))
    order = np.argsort(first, kind="stable")
    row, first, size = row[order], first[order], size[order]
    out = np.zeros(len(first), dtype=np.int64)
    for k in range(int(size.max()) if len(size) else 0):
        more = size > k
        out[more] = out[more] << 1 | bits[first[more] + k]
    return _lists(out, np.r_[0, np.cumsum(np.bincount(row, minlength=len(null)))], null)


vbyte_bytes = F.arrow_udf(vbyte_encode_lists, T.BinaryType())
vbyte_numbers = F.arrow_udf(vbyte_decode_lists, T.ArrayType(T.LongType()))
gap_numbers = F.arrow_udf(gap_decode_lists, T.ArrayType(T.LongType()))
gamma_bytes = F.arrow_udf(gamma_encode_lists, T.BinaryType())
gamma_numbers = F.arrow_udf(gamma_decode_lists, T.ArrayType(T.LongType()))


def vbyte_size(n: Column) -> Column:
    """Bytes of the variable-byte code of n."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(n)) / 7)).cast("long")


def gamma_bits(n: Column) -> Column:
    """Bits of the gamma code of n."""
    return (2 * F.length(F.bin(n)) - 1).cast("long")
