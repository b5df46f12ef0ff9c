"""Scores of texts under an n-gram model with deleted interpolation.

Tokens are lower-cased words and one end of the text. A token's probability is the
maximum-likelihood estimate after its context of n - 1 tokens, mixed with that after the
shorter context, and so on down to the token's share of all tokens and, below it, one
share for each known token and one for all unknown ones:

    P_k(w | h) = l_k(b) c(h w) / c(h) + (1 - l_k(b)) P_k-1,      P_0 = 1 / (V + 1)

The weight l_k depends on the context's length and on the bucket of its frequency, by
powers of two; an unseen context passes everything on. A part of the training texts, one
in TUNE, is deleted from the counts, and expectation-maximisation finds the weights under
which the other counts give its tokens most likelihood. Scores then use the counts of all
training texts. Probabilities of the known tokens and the unknown one sum to one.

Texts are dealt into slices by a hash. A slice's task finds its distinct n-grams, as
sorted 64-bit hashes, and sends each range of hashes, with their counts, to a shard in
one row. A shard has all slices' counts of its n-grams, adds them up, and answers each
slice with the sums in the order asked for, without the hashes. The slice's texts then
meet these answers. So an n-gram crosses the network once for each slice that has it,
however often it occurs there; no task holds a vocabulary, and no word is a hot key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkronym.llm import words as w
from sparkronym.llm.common import Scratch, ship

ORDER = 2
#: Of the training texts, one in so many is held out of the counts to find the weights; additive smoothing of the base score.
TUNE, ADD = 16, 0.1
#: Bytes of text in a slice and of hashes in a shard, about; least numbers of both.
SLICE, SHARD, LEAST_SLICES, LEAST_SHARDS = 8 << 20, 64 << 20, 64, 256
#: Steps of expectation-maximisation at most, and the gain of log-likelihood for each token that ends it.
STEPS, GAIN = 40, 1e-6
BUCKETS = 65
U = np.uint64
#: Stand for the start and the end of a text among the hashes of words.
START, END = U(0x9E6C63D0876A9A47), U(0x3C6EF372FE94F82B)


def pack(x: np.ndarray) -> bytes:
    """Integers as their lowest bytes, then the next higher, as far as any has one: small ones cost little when compressed."""
    most = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T[:most]).tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n and data:
        out[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(-1, n).T
    return out.view("<u8").reshape(-1)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[at], np.diff(np.append(at, len(keys)))


class _Tokens:
    """The tokens of a table of texts, and for each order the hash of the n-gram that ends at each token."""

    def __init__(self, column: pa.ChunkedArray, order: int):
        data, off = w.text_bytes(column.combine_chunks())
        data = w.LOWER[data]
        starts, ends, of = w.spans(data, off)
        self.n = np.diff(of) + 1  # with the end
        self.first = np.cumsum(self.n) - self.n
        pad = order - 1
        size = self.n + pad
        at = np.cumsum(size) - size  # of each text in the padded sequence
        seq = np.full(int(size.sum()), START)
        word = np.arange(len(starts)) + np.repeat(at + pad - of[:-1], self.n - 1)
        seq[word] = w.hashes(data, starts, ends)
        seq[at + size - 1] = END
        token = np.arange(int(self.n.sum())) + np.repeat(at + pad - self.first, self.n)
        self.grams = [seq[token] if k == 1 else w.runs(seq, k)[token - k + 1] for k in range(1, order + 1)]


def _gather(order: int, bits: int):
    """Each slice's distinct n-grams by shard, with how often its training texts have them."""

    def run(table: pa.Table) -> pa.Table:
        tokens, train = _Tokens(table.column("text"), order), np.asarray(table.column("part")) < 2
        mine = np.repeat(train, tokens.n)
        out: dict = {c: [] for c in ("order", "shard", "n", "keys", "counts")}
        for k, gram in enumerate(tokens.grams, 1):
            keys, _ = counted(gram)
            own, times = counted(gram[mine])
            count = np.zeros(len(keys), np.int64)
            count[np.searchsorted(keys, own)] = times
            shard = (keys >> U(64 - bits)).astype(np.int64)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(keys)]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = keys[a:b].copy()
                part[1:] -= keys[a : b - 1]
                part[0] -= U(int(shard[a]) << (64 - bits))
                for c, v in (("order", k), ("shard", int(shard[a])), ("n", b - a), ("keys", pack(part)), ("counts", pack(count[a:b]))):
                    out[c].append(v)
        n = len(out["n"])
        w.release()
        return pa.table({
            "slice": pa.array([table.column("slice")[0].as_py()] * n, pa.int64()), "tuned": pa.array([table.column("part")[0].as_py() == 1] * n, pa.bool_()), "order": pa.array(out["order"], pa.int32()),
            "shard": pa.array(out["shard"], pa.int32()), "n": pa.array(out["n"], pa.int64()), "keys": pa.array(out["keys"], pa.binary()), "counts": pa.array(out["counts"], pa.binary()),
        })

    return run


ASKED = "slice long, tuned boolean, order int, shard int, n long, keys binary, counts binary"
ANSWER = "slice long, order int, shard int, n long, totals binary, tunes binary, vocabulary long, tokens long, rest_vocabulary long, rest_tokens long"


def _answer(bits: int):
    """A shard's sums over all slices, to each slice in its order; one row of slice -1 has sums over the shard's tokens."""
    import pandas as pd

    def run(table: pa.Table) -> pa.Table:
        size, order = np.asarray(table.column("n")), table.column("order")[0].as_py()
        start = U(table.column("shard")[0].as_py() << (64 - bits))
        cuts = np.concatenate(([0], np.cumsum(size)))
        key, count = np.empty(cuts[-1], U), np.empty(cuts[-1], np.int64)
        for a, b, x, c in zip(cuts[:-1], cuts[1:], table.column("keys"), table.column("counts"), strict=True):
            key[a:b] = np.cumsum(unpack(x.as_py(), b - a), dtype=U) + start
            count[a:b] = unpack(c.as_py(), b - a)
        tuned = np.repeat(np.asarray(table.column("tuned")), size)
        code, found = pd.factorize(key)
        total = np.bincount(code, weights=count, minlength=len(found)).astype(np.int64)
        tune = np.bincount(code[tuned], weights=count[tuned], minlength=len(found)).astype(np.int64)
        totals = [pack(total[code[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        tunes = [pack(tune[code[a:b]]) if t else b"" for a, b, t in zip(cuts[:-1], cuts[1:], np.asarray(table.column("tuned")), strict=True)]
        sums = [None] * 4 if order > 1 else [int((total > 0).sum()), int(total.sum()), int((total > tune).sum()), int((total - tune).sum())]
        of = lambda c, last: pa.concat_arrays([table.column(c).combine_chunks(), pa.array([last], table.schema.field(c).type)])
        none = [None] * len(table)
        w.release()
        return pa.table({
            "slice": of("slice", -1), "order": of("order", order), "shard": of("shard", table.column("shard")[0].as_py()), "n": of("n", 0), "totals": pa.array([*totals, b""], pa.binary()), "tunes": pa.array([*tunes, b""], pa.binary()),
            **{c: pa.array([*none, x], pa.int64()) for c, x in zip(("vocabulary", "tokens", "rest_vocabulary", "rest_tokens"), sums, strict=True)},
        })

    return run


def _counts(tokens: _Tokens, answers: pa.Table, column: str) -> list[np.ndarray]:
    """For each order, the count of the n-gram that ends at each token."""
    import pandas as pd

    out = []
    answers = answers.sort_by([("order", "ascending"), ("shard", "ascending")])
    which = np.asarray(answers.column("order"))
    for k, gram in enumerate(tokens.grams, 1):
        own = answers.filter(pa.array(which == k))
        count = np.concatenate([np.zeros(0, U), *(unpack(x.as_py(), n.as_py()) for x, n in zip(own.column(column), own.column("n"), strict=True))]).astype(np.int64)
        code, found = pd.factorize(gram)
        place = np.empty(len(found), np.int64)
        place[np.argsort(found)] = np.arange(len(found))
        out.append(count[place[code]])
    return out


def _contexts(tokens: _Tokens, counts: list[np.ndarray], all_tokens: int, texts: int) -> list[np.ndarray]:
    """For each order, how often the context of each token occurs: that of the first token of a text as often as there are texts."""
    out = [np.full(len(counts[0]), all_tokens)]
    for c in counts[:-1]:
        before = np.empty(len(c), np.int64)
        before[1:] = c[:-1]
        before[tokens.first] = texts
        out.append(before)
    return out


def bucket(x: np.ndarray) -> np.ndarray:
    """0 for 0, else one more than the logarithm to base 2, rounded down."""
    return np.frexp(x.astype(float))[1]


def _events(order: int, rest: tuple[int, int, int]):
    """Of tokens in the part held out: counts and contexts' counts without that part."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        names = [f"{x}{k}" for k in range(1, order + 1) for x in "cx"]
        if not len(texts):
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        tokens = _Tokens(texts.column("text"), order)
        counts = [a - b for a, b in zip(_counts(tokens, answers, "totals"), _counts(tokens, answers, "tunes"), strict=True)]
        around = _contexts(tokens, counts, rest[1], rest[2])
        w.release()
        return pa.table({f"{x}{k}": pa.array(v[k - 1], pa.int64()) for k in range(1, order + 1) for x, v in (("c", counts), ("x", around))})

    return run


def weights(events: DataFrame, order: int, vocabulary: int, steps: int = STEPS, gain: float = GAIN) -> np.ndarray:
    """l_k by bucket, [order + 1, BUCKETS], by expectation-maximisation over the events.

    events: c_k and x_k (the counts of a token's n-gram and of its context) and n, how many
    tokens have them. Each step is one aggregation by the buckets of the contexts. A weight
    starts at one half and has one token's worth of that belief for each side, so that it
    never gets to 0 or 1."""
    out = np.full((order + 1, BUCKETS), 0.5)
    orders = range(1, order + 1)
    rows = events
    for k in orders:
        rows = rows.withColumn(f"b{k}", F.when(F.col(f"x{k}") == 0, 0).otherwise(F.length(F.bin(f"x{k}"))) if k > 1 else F.lit(1))
    last = None
    for _ in range(steps):
        p, share = F.lit(1.0 / (vocabulary + 1)), [F.lit(1.0 / (vocabulary + 1))]
        for k in orders:
            weight = F.element_at(F.array(*(F.lit(float(x)) for x in out[k])), F.col(f"b{k}") + 1)
            mine = F.when(F.col(f"x{k}") == 0, 0.0).otherwise(weight * F.col(f"c{k}") / F.col(f"x{k}"))
            down = F.when(F.col(f"x{k}") == 0, 1.0).otherwise(1.0 - weight)
            share = [s * down for s in share] + [mine]
            p = p * down + mine
        sums = rows.select(*(f"b{k}" for k in orders), "n", p.alias("p"), *(s.alias(f"s{k}") for k, s in enumerate(share)))
        sums = sums.groupBy(*(f"b{k}" for k in orders)).agg(F.sum(F.col("n") * F.ln("p")).alias("fit"), F.sum("n").alias("n"), *(F.sum(F.col("n") * F.col(f"s{k}") / F.col("p")).alias(f"s{k}") for k in range(order + 1))).collect()
        if not sums:
            break
        chosen, passed = np.ones((order + 1, BUCKETS)), np.ones((order + 1, BUCKETS))
        for r in sums:
            for k in orders:
                if r[f"b{k}"]:
                    chosen[k, r[f"b{k}"]] += r[f"s{k}"]
                    passed[k, r[f"b{k}"]] += sum(r[f"s{j}"] for j in range(k))
        out = chosen / (chosen + passed)
        fit, n = sum(r["fit"] for r in sums), sum(r["n"] for r in sums)
        if last is not None and fit - last < gain * n:
            break
        last = fit
    return out


SCORED = "id {id}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(order: int, whole: tuple[int, int, int], weight: np.ndarray):
    vocabulary, all_tokens, texts_of = whole

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(texts):
            return pa.table({"id": texts.column("id"), **{c: pa.array([], t) for c, t in (("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))}})
        tokens = _Tokens(texts.column("text"), order)
        counts = _counts(tokens, answers, "totals")
        p = np.full(len(counts[0]), 1.0 / (vocabulary + 1))
        for k, (c, x) in enumerate(zip(counts, _contexts(tokens, counts, all_tokens, texts_of), strict=True), 1):
            own = weight[k][bucket(x) if k > 1 else np.ones(len(x), int)]
            p = np.where(x > 0, own * (c / np.maximum(x, 1)) + (1 - own) * p, p)
        base = np.log10((counts[0] + ADD) / (all_tokens + ADD * (vocabulary + 1)))
        add = lambda x: np.add.reduceat(x, tokens.first)
        out = pa.table({
            "id": texts.column("id"), "held_out": pa.array(np.asarray(texts.column("part")) == 2), "n_tokens": pa.array(tokens.n, pa.int64()), "n_known": pa.array(add((counts[0] > 0).astype(np.int64))),
            "train_tokens": pa.array([all_tokens] * len(texts), pa.int64()), "base_score": pa.array(add(base)), "score": pa.array(add(np.log10(p))),
        })
        del tokens, counts, p, base
        w.release()
        return out

    return run


def scores(docs: DataFrame, held_out: Column, tune: Column, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE) -> DataFrame:
    """One row for each row of docs: id, held_out, n_tokens, n_known (tokens that training
    texts have), train_tokens, base_score (log10 under additively smoothed shares of tokens),
    score (log10 under the model).

    held_out: rows that are not learnt from; tune: of the others, those that find the
    weights; null in either counts as false. A null or empty text is its end alone. A null
    id is an id; rows that repeat, or share an id, count and are scored each by itself. A
    token that no training text has is the unknown one. Where nothing is learnt from, every
    token has probability 1; where no row finds weights, all are one half. A text is always
    within one slice, however long. An empty table gives an empty result. Other columns are
    not read, whatever their names."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "lm")
    part = F.when(F.coalesce(held_out, F.lit(False)), 2).when(F.coalesce(tune, F.lit(False)), 1).otherwise(0)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), part.cast("int").alias("part"))
    size = rows.select(F.coalesce(F.octet_length("text"), F.lit(0)).alias("b"), "part").agg(F.sum("b").alias("b"), F.count_if(F.col("part") < 2).alias("n"), F.count_if(F.col("part") == 0).alias("rest")).first()
    slices = max(LEAST_SLICES, -(-(size["b"] or 0) // slice_bytes))
    tuned = max(4, slices // TUNE)
    bits = (max(LEAST_SHARDS, 2 * (size["b"] or 0) // SHARD) - 1).bit_length()
    h = F.xxhash64("id", "text", F.lit("slice"))
    rows = rows.withColumn("slice", F.when(F.col("part") == 1, slices + F.pmod(h, F.lit(tuned))).otherwise(F.pmod(h, F.lit(slices))))
    asked = rows.select("slice", "text", "part").groupBy("slice").applyInArrow(_gather(order, bits), ASKED)
    answers = scratch.save(asked.groupBy("order", "shard").applyInArrow(_answer(bits), ANSWER), "answers")
    sums = answers.where("slice = -1 and order = 1").agg(*(F.sum(c) for c in ("vocabulary", "tokens", "rest_vocabulary", "rest_tokens"))).first()
    v, n, rest_v, rest_n = (int(x or 0) for x in sums)
    answers = answers.where("slice >= 0").select("slice", "order", "shard", "n", "totals", "tunes")

    names = [f"{x}{k}" for k in range(1, order + 1) for x in "cx"]
    held = rows.where("part = 1").select("slice", "text").groupBy("slice").cogroup(answers.where(F.col("slice") >= slices).groupBy("slice"))
    events = held.applyInArrow(_events(order, (rest_v, rest_n, size["rest"])), ", ".join(f"{c} long" for c in names))
    events = scratch.save(events.groupBy(*names).agg(F.count("*").alias("n")), "events")
    found = weights(events, order, rest_v)
    scratch.drop("events")
    kind = dict(rows.dtypes)["id"]
    score = _score(order, (v, n, size["n"]), found)
    return rows.groupBy("slice").cogroup(answers.select("slice", "order", "shard", "n", "totals").groupBy("slice")).applyInArrow(score, SCORED.format(id=kind))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    crc = F.crc32(F.col("doc_id").cast("string"))
    out = scores(docs, held_out=crc % 10 == 0, tune=F.expr("crc32(cast(doc_id as string)) div 10") % TUNE == 0)
    return out.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
