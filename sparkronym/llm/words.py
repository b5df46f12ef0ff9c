"""Words of many texts at once, in numpy: where they are, and hashes of them.

Works on the bytes of an Arrow column, without a Python object for each word. Memory
is bounded by the slice of texts that is passed, see slices()."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space by byte: what stands in common.SPACE.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Words of more bytes than this are hashed by a digest, each by itself.
LONG = 64
U = np.uint64
#: The lowest n bytes of a 64-bit integer, by n.
_LOW = np.array([(1 << (8 * n)) - 1 for n in range(9)], U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one text after the other, and len + 1 offsets. Null counts as empty."""
    a = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    raw = a.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and len(raw) else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batch: pa.RecordBatch, column: str | int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about so many bytes together (more only where one text has more)."""
    if not len(batch):
        return
    col = batch.column(column)
    size = np.asarray(pc.fill_null(pc.binary_length(col), 0).cast(pa.int64()))
    group = np.cumsum(size) // most
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(batch)]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(int(a), int(b - a))


def spans(data: np.ndarray, off: np.ndarray, apart: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not apart, by default the words
    [^\\x20\\x09-\\x0D]+, and len(off) offsets into them: words[k]:words[k+1] are of text k."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    ns = ~apart[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, ns[:-1]
    before[off[:-1][off[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, ns[1:]
    last = off[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(ns & ~before)
    ends = np.flatnonzero(ns & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal bytes have equal hashes wherever they stand.

    Eight bytes at a time go into a chain of bijections, so that spans of one length up
    to eight bytes never collide, and no pattern of longer ones (a word and its
    complement, say) cancels out, as it would in a polynomial modulo 2^64. Hashes of
    different seeds are independent. Spans longer than LONG go through blake2b."""
    n = ends - starts
    out = mix(n.astype(U) * U(0x9E3779B97F4A7C15) + U((seed * 2 + 1) * 0xD1B54A32D192ED03 & (2**64 - 1)))
    if not len(starts):
        return out
    padded = np.empty(len(data) + 8, np.uint8)
    padded[: len(data)], padded[len(data) :] = data, 0
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    which, at, left = None, starts, n
    for _ in range(LONG // 8):
        out_now = mix(out if which is None else out[which])
        out_now ^= eight[at] & _LOW[np.minimum(left, 8)]
        out_now = mix(out_now + U(0x632BE59BD9B4E019))
        if which is None:
            out = out_now
        else:
            out[which] = out_now
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        which = more if which is None else which[more]
        at, left = at[more] + 8, left[more] - 8
    for i in np.flatnonzero(n > LONG).tolist():
        d = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        out[i] = np.frombuffer(d, U)[0]
    return out


def runs(word: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each k consecutive words, by where they start; len(word) - k + 1 of them.

    Runs of twice the length are made of two of half the length, and k of the powers of
    two in it, each step mixed, so that no pattern of words cancels out."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    salt = U((seed * 2 + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    power, size, out, done, left = word, 1, None, 0, k
    while True:
        if left & 1:
            part = power[done : done + n]
            out = mix(part + salt) if out is None else mix((out ^ (out >> U(32))) * U(0xD6E8FEB86659FD93) + part)
            done += size
        left >>= 1
        if not left:
            return out
        power = mix(power[:-size] * U(0xA0761D6478BD642F) + mix(power[size:] + salt))
        size *= 2


def tidy(run):
    """The function over Arrow batches, after which a worker gives back the memory it holds no more."""

    def clean(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return clean


def release() -> None:
    """Gives free memory back to the system: a worker that is used again would keep the most it ever had."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # only in glibc
        pass
