"""Elias-Fano sequences over memory-mapped words, searched many keys at a time.

A non-decreasing sequence of n values below u is kept in about
2 + log2(u / n) bits a value: low bits packed side by side, high bits in unary.
``rank`` counts the ones before each word of the unary part; select is a search
in that directory and a select within one word.
"""

from __future__ import annotations

import json

import numpy as np

_U = np.uint64
_ONE = _U(1)


def pack(arrays: dict[str, np.ndarray], **values) -> bytes:
    """Arrays and plain values in one block that ``unpack`` maps without copying."""
    head, body, at = {}, [], 0
    for name, array in arrays.items():
        raw = np.ascontiguousarray(array).tobytes()
        head[name] = [array.dtype.str, at, len(array)]
        pad = -len(raw) % 8
        body += [raw, b"\0" * pad]
        at += len(raw) + pad
    text = json.dumps({"arrays": head, "values": values}).encode()
    text += b" " * (-len(text) % 8)
    return b"".join([np.int64(len(text)).tobytes(), text, *body])


def unpack(block: np.ndarray) -> tuple[dict[str, np.ndarray], dict]:
    size = int(block[:8].view(np.int64)[0])
    head = json.loads(block[8 : 8 + size].tobytes())
    base = 8 + size
    arrays = {}
    for name, (kind, at, n) in head["arrays"].items():
        kind = np.dtype(kind)
        arrays[name] = block[base + at : base + at + n * kind.itemsize].view(kind)
    return arrays, head["values"]


_L8, _H8 = _U(0x0101010101010101), _U(0x8080808080808080)
#: Place of the k-th one in each byte, at 8 * byte + k.
_IN_BYTE = np.array([([i for i in range(8) if byte >> i & 1] + [0] * 8)[k] for byte in range(256) for k in range(8)], np.uint8)


def _select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one (from 0) in each word: byte sums by multiplication, then a table."""
    k = k.astype(np.uint64)
    sums = words - ((words >> _ONE) & _U(0x5555555555555555))
    sums = (sums & _U(0x3333333333333333)) + ((sums >> _U(2)) & _U(0x3333333333333333))
    sums = ((sums + (sums >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _L8
    byte = np.bitwise_count((k * _L8 | _H8) - sums & _H8).astype(np.uint64) << _U(3)
    k -= (sums << _U(8)) >> byte & _U(0xFF)
    return byte + _IN_BYTE[((words >> byte & _U(0xFF)) << _U(3)) + (k & _U(7))]


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray], values: dict, name: str):
        self.upper, self.rank, self.lower = (arrays[f"{name}.{part}"] for part in ("upper", "rank", "lower"))
        self.n, self.bits = values[f"{name}.n"], values[f"{name}.bits"]
        self._zeros = np.arange(len(self.rank), dtype=np.int64) * 64 - self.rank.astype(np.int64)

    @staticmethod
    def encode(values: np.ndarray, name: str) -> tuple[dict[str, np.ndarray], dict]:
        """values: non-decreasing uint64"""
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        high = (values >> _U(bits)).astype(np.int64)
        size = n + (int(high[-1]) if n else 0) + 2
        words = -(-size // 64)
        at = high + np.arange(n)
        upper = np.zeros(words + 1, np.uint64)  # one more, so that 64 bits can be read from any place
        np.bitwise_or.at(upper, at >> 6, _ONE << (at & 63).astype(np.uint64))
        ones = np.bitwise_count(upper).astype(np.uint64)
        rank = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.uint32)
        lower = np.zeros(-(-n * bits // 64) + 1, np.uint64)
        if bits:
            low = values & _U((1 << bits) - 1)
            start = np.arange(n, dtype=np.uint64) * _U(bits)
            word, shift = (start >> _U(6)).astype(np.int64), start & _U(63)
            np.bitwise_or.at(lower, word, low << shift)
            over = shift + _U(bits) > _U(64)
            np.bitwise_or.at(lower, word[over] + 1, low[over] >> (_U(64) - shift[over]))
        return {f"{name}.upper": upper, f"{name}.rank": rank, f"{name}.lower": lower}, {f"{name}.n": n, f"{name}.bits": bits}

    def low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        start = i.astype(np.uint64) * _U(self.bits)
        word, shift = (start >> _U(6)).astype(np.int64), start & _U(63)
        out = self.lower[word] >> shift
        over = shift + _U(self.bits) > _U(64)
        if over.any():
            out[over] |= self.lower[word[over] + 1] << (_U(64) - shift[over])
        return out & _U((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.rank, i.astype(self.rank.dtype), "right") - 1
        at = word * 64 + _select(self.upper[word], i - self.rank[word]).astype(np.int64)
        return ((at - i).astype(np.uint64) << _U(self.bits)) | self.low(i)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of the unary part."""
        word = np.searchsorted(self._zeros, k, "right") - 1
        return word * 64 + _select(~self.upper[word], k - self._zeros[word]).astype(np.int64)

    def _run(self, at: np.ndarray) -> np.ndarray:
        """Ones from each place of the unary part on, 64 at most."""
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        bits = self.upper[word] >> shift
        bits |= np.where(shift > 0, self.upper[np.minimum(word + 1, len(self.upper) - 1)] << (_U(64) - np.maximum(shift, _ONE)), _U(0))
        return np.bitwise_count((~bits & (bits + _ONE)) - _ONE).astype(np.int64)

    def successor(self, x: np.ndarray, start: np.ndarray | int = 0, end: np.ndarray | int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of each x the place of the first value not below it within [start, end), and whether it is x.

        Quickest for sorted keys, whose reads are near one another.
        """
        x = np.asarray(x, np.uint64)
        end = np.broadcast_to(self.n if end is None else end, x.shape).astype(np.int64)
        start = np.broadcast_to(start, x.shape).astype(np.int64)
        if not self.n or not len(x):
            return end.copy(), np.zeros(len(x), bool)
        highest = len(self.upper) * 64 - self.n - 1  # zeros there are, less one
        high = (x >> _U(self.bits)).astype(np.int64)
        beyond = high > highest
        high = np.minimum(high, highest)
        bucket = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) + 1, 0)
        at = bucket - high
        size = self._run(np.minimum(bucket, len(self.upper) * 64 - 1))
        if (long := np.flatnonzero(size >= 64)).size:
            size[long] = self._zero(high[long]) - bucket[long]
        to = at + size
        at, to = np.maximum(at, start), np.minimum(to, end)
        at[beyond] = end[beyond]
        to[beyond] = end[beyond]
        low = x & _U((1 << self.bits) - 1)
        stop = to.copy()
        live = np.flatnonzero(at < to)
        while len(live):
            mid = (at[live] + to[live]) >> 1
            less = self.low(mid) < low[live]
            at[live] = np.where(less, mid + 1, at[live])
            to[live] = np.where(less, to[live], mid)
            live = live[at[live] < to[live]]
        found = at < stop
        found[found] = self.low(at[found]) == low[found]
        return at, found
