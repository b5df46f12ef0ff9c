"""Byte-level BPE by rank files: encoding with a segment tree, and decoding.

A piece of text is merged as the rank files' library does it: always the adjacent pair
whose joined bytes have the smallest rank, the leftmost of equals. A segment tree over
byte positions stores at each node the smallest (rank, position) below it, so that the
root is the next merge; a merge changes three leaves (the merged pair's, its left
neighbour's, and that of the token that went) and the O(log n) nodes above them. The
trees of many pieces of about one length stand side by side in numpy arrays, and each
step makes one merge in every piece that still has one.

A worker remembers the ids of the pieces that it has met, within a bound.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sparkronym.llm.common import names, ship
from sparkronym.llm.words import slices, tidy

#: Pieces that a worker remembers, and their bytes with those of their ids; beyond either its memory starts anew.
REMEMBERED, REMEMBERED_BYTES = 200_000, 16 << 20
#: The white space of Unicode, as the library's \\s has it; Python's has four separators more.
UNICODE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters, numbers and white space below U+0100.
LATIN = {r"\p{L}": r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"\p{N}": r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\s": r"\t-\r \x85\xa0"}
NONE = np.int64(1) << 62


def spelled(pattern: str, classes: dict[str, str]) -> str:
    """The pattern with these classes spelled out, inside and outside of brackets."""
    out, inside, k = [], False, 0
    while k < len(pattern):
        name = next((c for c in (*classes, r"\S") if pattern.startswith(c, k)), None)
        if name == r"\S":
            out.append(f"[^{classes[r'\s']}]")
        elif name:
            out.append(classes[name] if inside else f"[{classes[name]}]")
        else:
            name = pattern[k : k + 2] if pattern[k] == "\\" else pattern[k]
            inside = (inside or name == "[") and name != "]"
            out.append(name)
        k += len(name)
    return "".join(out)


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x.strip())}


class Bpe:
    """An encoder and decoder for a rank file's bytes and a pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        ranks = read_ranks(rank_file)
        self.split = regex.compile(spelled(pattern, {r"\s": UNICODE_SPACE})).findall
        latin = spelled(pattern, LATIN)
        self.split_latin = self.split if r"\p" in latin else re.compile(latin).findall
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            tokens[r] = t
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array(list(map(len, tokens)), np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for t, r in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        self.pair = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[int(k)] for k in self.pair], np.int64)
        self.pieces: dict[str, bytes] = {}
        self.held = 0

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; NONE where they don't join."""
        key = a << 32 | b
        i = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[i] == key, self.pair_rank[i], NONE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = np.where(size > 1, 1 << np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64), 1)
        for p in np.unique(width):
            of = np.flatnonzero((width == p) & (size > 0))
            most = max(1, (1 << 19) // int(p))
            for a in range(0, len(of), most):
                self._merge([pieces[i] for i in of[a : a + most]], of[a : a + most], size[of[a : a + most]], int(p), out)
        return out

    def _merge(self, pieces: list[bytes], at: np.ndarray, size: np.ndarray, p: int, out: list[bytes]) -> None:
        n = len(pieces)
        data = np.frombuffer(b"".join(x.ljust(p, b"\0") for x in pieces), np.uint8).reshape(n, p)
        live = np.arange(p) < size[:, None]
        tok = np.zeros((n, p + 1), np.int64)
        tok[:, :p] = self.first[data]
        after = np.tile(np.arange(1, p + 2), (n, 1))
        after[np.arange(n), size - 1] = p  # p: there is none
        before = np.tile(np.arange(-1, p), (n, 1))
        tree = np.full((n, 2 * p), NONE)
        if p > 1:
            pos = np.arange(p - 1)
            r = self.rank(tok[:, : p - 1], tok[:, 1:p])
            tree[:, p : 2 * p - 1] = np.where((r < NONE) & live[:, 1:], r << 32 | pos, NONE)
            lo = p
            while lo > 1:
                lo //= 2
                tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
            rows = np.flatnonzero(tree[:, 1] < NONE)
            while len(rows):
                root = tree[rows, 1]
                x, new = root & 0xFFFFFFFF, root >> 32
                gone = after[rows, x]
                nxt = after[rows, gone]
                prev = before[rows, x]
                tok[rows, x] = new
                live[rows, gone] = False
                after[rows, x] = nxt
                before[rows, np.minimum(nxt, p)] = x
                r = np.where(nxt < p, self.rank(new, tok[rows, np.minimum(nxt, p)]), NONE)
                l = np.where(prev >= 0, self.rank(tok[rows, np.maximum(prev, 0)], new), NONE)  # noqa: E741
                tree[rows, p + gone] = NONE
                tree[rows, p + x] = np.where(r < NONE, r << 32 | x, NONE)
                has = prev >= 0
                tree[rows[has], p + prev[has]] = np.where(l[has] < NONE, l[has] << 32 | prev[has], NONE)
                row3 = np.concatenate((rows, rows, rows[has]))
                node = np.concatenate((p + x, p + gone, p + prev[has])) >> 1
                while node[0] >= 1:
                    tree[row3, node] = np.minimum(tree[row3, 2 * node], tree[row3, 2 * node + 1])
                    node >>= 1
                rows = rows[tree[rows, 1] < NONE]
        ids = tok[:, :p][live].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(1)) * 4
        a = 0
        for i, b in zip(at.tolist(), ends.tolist(), strict=True):
            out[i] = ids[a:b]
            a = b

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without special tokens, as little-endian unsigned 32-bit integers."""
        split = [(self.split_latin if _is_latin(t) else self.split)(t) for t in texts]
        met = set().union(*split)
        new = list(met.difference(self.pieces))
        raw = [x.encode() for x in new]
        if len(self.pieces) + len(new) > REMEMBERED or self.held + sum(map(len, raw)) > REMEMBERED_BYTES:
            self.pieces.clear()
            self.held, new = 0, list(met)
            raw = [x.encode() for x in new]
        ids = self.merge(raw)
        self.pieces.update(zip(new, ids, strict=True))
        self.held += sum(map(len, raw)) + sum(map(len, ids))
        get = self.pieces.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def decode(self, texts: list[bytes]) -> list[bytes]:
        """The bytes that each text's ids stand for."""
        ids = np.frombuffer(b"".join(texts), "<u4").astype(np.int64)
        size = self.length[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        take = np.repeat(self.at[ids] - ends[:-1], size) + np.arange(ends[-1])
        data = self.bytes[take].tobytes()
        cuts = ends[np.concatenate(([0], np.cumsum([len(x) // 4 for x in texts], dtype=np.int64)))].tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]


_coders: dict[tuple[bytes, str], Bpe] = {}


def coder(rank_file: bytes, pattern: str) -> Bpe:
    """This process's coder; it keeps what it remembers from task to task."""
    key = (hashlib.sha256(rank_file).digest(), pattern)
    if key not in _coders:
        _coders[key] = Bpe(rank_file, pattern)
    return _coders[key]


OUTPUTS = {
    "ids": T.ArrayType(T.IntegerType(), False),
    "n_tokens": T.LongType(),
    "ids_sha256": T.StringType(),
    "decoded": T.BinaryType(),
    "decoded_sha256": T.StringType(),
}


def encode(
    docs: DataFrame, path: str, pattern: str, text_col: str = "text", outputs: tuple[str, ...] = ("ids", "n_tokens"), keep: list[str] | None = None
) -> DataFrame:
    """Columns keep of docs (all but the text) with outputs, which name columns of OUTPUTS.

    path: of a rank file, read by the driver and broadcast; its size is that of a
    vocabulary. Each row is encoded by itself, wherever it is: no shuffle. decoded is
    made from the ids. A null text is the empty text, which has no ids; texts of any
    length are encoded whole; repeated rows are each returned; a column of docs whose
    name is an output's is replaced; an empty table gives an empty result."""
    spark = docs.sparkSession
    ship(spark)
    with open(path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    cols = [c for c in (keep if keep is not None else docs.columns) if c != text_col and c not in outputs]
    schema = T.StructType([docs.schema[c] for c in cols] + [T.StructField(c, OUTPUTS[c]) for c in outputs])
    (text,) = names(docs, "text")
    return docs.select(*cols, docs[text_col].cast("string").alias(text)).mapInArrow(tidy(_Encode(ranks, pattern, cols, outputs)), schema)


class _Encode:
    def __init__(self, ranks, pattern, cols, outputs):
        self.ranks, self.pattern, self.cols, self.outputs = ranks, pattern, cols, outputs

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(self.ranks.value, self.pattern)
        for batch in batches:
            for part in slices(batch, len(self.cols)):
                ids = bpe.encode([t or "" for t in part.column(len(self.cols)).to_pylist()])
                decoded = bpe.decode(ids) if any(o.startswith("decoded") for o in self.outputs) else []
                made = {
                    "ids": lambda ids=ids: pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())),
                    "n_tokens": lambda ids=ids: pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": lambda ids=ids: pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    "decoded": lambda d=decoded: pa.array(d, pa.binary()),
                    "decoded_sha256": lambda d=decoded: pa.array([hashlib.sha256(x).hexdigest() for x in d]),
                }
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(len(self.cols))] + [made[o]() for o in self.outputs], names=[*self.cols, *self.outputs])


def decode(rows: DataFrame, path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """rows with the text of their ids; bytes that are no UTF-8 become replacement characters. Null ids give null."""
    spark = rows.sparkSession
    ship(spark)
    with open(path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    cols = [c for c in rows.columns if c != out_col]
    schema = T.StructType([rows.schema[c] for c in cols] + [T.StructField(out_col, T.StringType())])
    return rows.select(*cols).mapInArrow(_Decode(ranks, cols, cols.index(ids_col), out_col), schema)


class _Decode:
    def __init__(self, ranks, cols, at, out_col):
        self.ranks, self.cols, self.at, self.out_col = ranks, cols, at, out_col

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(self.ranks.value, "")
        for batch in batches:
            ids = batch.column(self.at).to_pylist()
            got = bpe.decode([np.array(x or (), "<u4").tobytes() for x in ids])
            text = [None if x is None else y.decode("utf-8", "replace") for x, y in zip(ids, got, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*self.cols, self.out_col])


#: The tokenizer of the query and of the pipeline.
RANKS = "byte_bpe_multi_50k.tiktoken"


def public() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, *public(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
