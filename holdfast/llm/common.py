"""Shared helpers: tables, and numpy tokenisation of Arrow batches."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..scratch import Scratch, broadcast_if_small, shared_root, small

__all__ = ["Scratch", "Words", "as_bytes", "broadcast_if_small", "chunks", "forget", "give_back", "kept", "mix64", "read", "shared_root", "slices", "small", "small_batches", "small_reads"]

BATCH = 3 << 20  #: bytes of an Arrow batch in small_batches, about
ROWS = 256  #: rows of a Parquet batch in small_reads

#: White space of the contracts, as a Java regular expression class body.
SPACE = r"\x20\x09-\x0D"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- numpy tokenisation -------------------------------------------------------------------------

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_GOLDEN = _U(0x9E3779B97F4A7C15)
#: The first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with good avalanche."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


class Words:
    """Words between white space of several texts: hash, the text's index, and the bytes from start to end of data.

    data holds the texts, lower-cased (A-Z), each with one line feed behind it. Hashes take eight bytes of a word at a
    time; those of two words of the same length of eight bytes at most never collide.
    """

    def __init__(self, texts: list[bytes], lower: bool = True, space: Callable[[np.ndarray], np.ndarray] = _IS_SPACE.__getitem__):
        """space: which of the bytes stand between words; the line feed must be one."""
        raw = np.frombuffer(b"\n".join(texts) + b"\n" + bytes(8), dtype=np.uint8)
        self.data = _LOWER[raw] if lower else raw
        self.space = space(self.data[:-8])
        edge = np.flatnonzero(self.space[1:] != self.space[:-1]) + 1
        if len(self.space) and not self.space[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        last = np.searchsorted(self.start, np.cumsum(sizes))
        self.owner = np.repeat(np.arange(len(texts)), np.diff(last, prepend=0))
        length = self.end - self.start
        eights = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        h = mix64(length.astype(_U) * _GOLDEN)
        h = mix64(h ^ (eights[self.start] & _FIRST[np.minimum(length, 8)]))
        left, at = np.flatnonzero(length > 8), 8
        while len(left):
            more = np.minimum(length[left] - at, 8)
            h[left] = mix64(h[left] * _GOLDEN + (eights[self.start[left] + at] & _FIRST[more]))
            at += 8
            left = left[length[left] > at]
        self.hashes = h

    def same(self, one: np.ndarray, two: np.ndarray) -> bool:
        """Whether the words at one are, byte for byte, those at two."""
        length = self.end - self.start
        if (length[one] != length[two]).any():
            return False
        eights, at, left = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,)), 0, length[one]
        while len(one):
            mask = _FIRST[np.minimum(left, 8)]
            if ((eights[self.start[one] + at] ^ eights[self.start[two] + at]) & mask).any():
                return False
            more = left > 8
            one, two, left, at = one[more], two[more], left[more] - 8, at + 8
        return True

    def numbered(self, known: dict[bytes, int], at: np.ndarray) -> np.ndarray:
        """The numbers of the words at ``at``; words not known get the next ones. Equal hashes are verified on the bytes."""
        if not len(at):
            return np.zeros(0, np.int64)
        _, first, of = np.unique(self.hashes[at], return_index=True, return_inverse=True)
        if not self.same(at, at[first][of]):  # two words share a hash
            first = of = np.arange(len(at))
        data, begin, stop = memoryview(self.data.tobytes()), self.start[at[first]].tolist(), self.end[at[first]].tolist()
        own = np.fromiter((known.setdefault(bytes(data[b:e]), len(known)) for b, e in zip(begin, stop, strict=True)), np.int64, len(first))
        return own[of]

    def digests(self, texts: int) -> np.ndarray:
        """128 bits of each text's words in order, cryptographic."""
        keep = ~self.space
        keep[1:] |= ~self.space[:-1]
        place = np.cumsum(keep)
        joined = np.where(self.space, np.uint8(32), self.data[:-8])[keep].tobytes()
        count = np.bincount(self.owner, minlength=texts)
        last = np.cumsum(count)
        begin, stop = np.zeros(texts, np.int64), np.zeros(texts, np.int64)
        full = np.flatnonzero(count)
        begin[full] = place[self.start[last[full] - count[full]]] - 1
        stop[full] = place[self.end[last[full] - 1] - 1]
        of = memoryview(joined)
        made = [hashlib.blake2b(of[b:e], digest_size=16).digest() for b, e in zip(begin.tolist(), stop.tolist(), strict=True)]
        return np.frombuffer(b"".join(made), np.int64).reshape(-1, 2)


def as_bytes(column) -> list[bytes]:
    """UTF-8 of a text column of an Arrow or pandas batch; null counts as empty."""
    return [b"" if t is None else t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in column]


def chunks(texts: list[bytes], limit: int = 1 << 18):
    """Slices of consecutive texts of about ``limit`` bytes; one longer text makes a slice of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield slice(at, i)
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield slice(at, len(texts))


def slices(batch: pa.RecordBatch, *texts: pa.Array, limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch that hold about ``limit`` bytes of its texts; a row with more makes a slice of its own.

    Workers go on to other tasks and keep what their largest lists took, so a batch is never a list as a whole."""
    at, size = 0, 0
    for i, n in enumerate(sum(pc.fill_null(pc.binary_length(t), 0).to_numpy().astype(np.int64) for t in texts).tolist()):
        if i > at and size + n > limit:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n + 1
    if at < batch.num_rows:
        yield batch.slice(at)


@contextmanager
def _unless_set(spark: SparkSession, key: str, value: int) -> Iterator[None]:
    if spark.conf.get(key, None) is not None:
        yield
        return
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.unset(key)


def small_batches(spark: SparkSession) -> AbstractContextManager[None]:
    """Jobs that run within send Python workers about BATCH bytes at once, not 10,000 rows of any length, which executor
    and worker would each hold; a size that the session has already stays."""
    return _unless_set(spark, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def small_reads(spark: SparkSession) -> AbstractContextManager[None]:
    """Jobs that run within read ROWS rows of Parquet at once, not 4,096 texts of any length, which each task would hold
    in one buffer, doubled as it grows; a number that the session has already stays."""
    return _unless_set(spark, "spark.sql.parquet.columnarReaderBatchSize", ROWS)


def give_back() -> None:
    """Free memory of this Python worker goes back to the system; else an idle worker holds it in later stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


_kept: dict[Any, Any] = {}


def forget(but: Any = None) -> None:
    """Frees what this worker keeps from other tasks, unless its key is ``but``."""
    if any(k != but for k in _kept):
        _kept.clear()
        give_back()


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """The one object that a worker keeps from task to task; the first task that asks for another frees it."""
    forget(key)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]
