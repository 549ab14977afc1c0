"""Texts of an Arrow batch as one array of code points, hashes over it, and sieves of hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Odd multipliers and their inverse for hashes modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after another, and where each starts, with the end appended."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.uint32), np.concatenate([[0], np.cumsum(lengths)])


def parts(batch: pa.RecordBatch, text: int, most: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batch in slices of about `most` characters (a longer text stands alone), each with its texts; no text is null."""
    texts = batch.column(text).to_pylist()
    at, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= most:
            yield batch.slice(at, i + 1 - at), texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield batch.slice(at), texts[at:]


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k characters from each position (k a power of two); those that pass the end are meaningless."""
    h = mixed(codes + np.uint32(1))
    width, multiplier = 1, BASE
    while width < k:
        nxt = np.zeros_like(h)
        nxt[: len(h) - width] = h[width:]
        h = h * np.uint64(multiplier) + nxt
        width, multiplier = width * 2, multiplier * multiplier % (1 << 64)
    return mixed(h)


def window_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of the `width` values from each position that has so many after it."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


class RangeHash:
    """Hashes of any ranges of a code-point array."""

    def __init__(self, codes: np.ndarray) -> None:
        n = len(codes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(codes + np.uint32(7)) * self.powers(BASE, n), out=self.sums[1:])
        self.back = self.powers(BASE_INVERSE, n + 1)

    @staticmethod
    def powers(base: int, n: int) -> np.ndarray:
        x = np.full(n, base, np.uint64)
        if n:
            x[0] = 1
        return np.cumprod(x, dtype=np.uint64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


#: Most bits of a sieve (16 MB), bits for each key below that, and bits that each key sets.
SIEVE_BITS, KEY_BITS, PROBES = 1 << 27, 32, 4


def _probe(keys: np.ndarray, i: int, bits: int) -> np.ndarray:
    return (mixed(keys ^ np.uint64(BASE * (i + 1) % (1 << 64))) & np.uint64(bits - 1)).astype(np.int64)


class Sieve:
    """A Bloom filter over 64-bit keys: it passes all keys that it was made of, and few others unless it is full."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.bits = words, len(words) * 64

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Positions of the keys that pass."""
        at = np.arange(len(keys))
        for i in range(PROBES):
            p = _probe(keys[at], i, self.bits)
            at = at[(self.words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1]
        return at


def sieve(keys: DataFrame, most_bits: int = SIEVE_BITS) -> Sieve:
    """The sieve of a frame's one bigint column. Its size follows the number of keys up to `most_bits`; beyond that it only passes more."""
    bits = 64
    n = keys.count()
    while bits < min(n * KEY_BITS, most_bits):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for i in range(PROBES):
                p = _probe(own, i, bits)
                np.bitwise_or.at(words, p >> 6, np.uint64(1) << (p & 63).astype(np.uint64))
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].view(np.int64))], ["word", "value"])

    got = keys.mapInArrow(run, "word bigint, value bigint").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[got["word"].to_numpy()] = got["value"].to_numpy().view(np.uint64)
    return Sieve(words)
