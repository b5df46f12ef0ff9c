"""A linear-chain conditional random field over tagged token sequences, and an ensemble of them.

Features are made in SQL (a token, its neighbours, what other taggers say of it) and
hashed to a fixed number of columns, so that a model's size doesn't grow with the data.
One aggregation gives the loss and the gradient of all models of an ensemble: each task
runs forward-backward over its batches, sentences of a length and all models side by
side, and adds up one gradient for each model; these are summed by slabs, and only the
sums reach the driver, which takes a step of L-BFGS (OWL-QN where there is an L1 term).
Batches are packed once for all steps, each different token of one as one row of features.
Tagging is Viterbi in Arrow batches.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkronym.shipping import ship
from sparkronym.storage import Steps

#: Tags of short and long forms, the columns that features are hashed to, and weights of the L1 and L2 terms.
TAGS = ("O", "B-short", "I-short", "B-long", "I-long")
DIMS, C1, C2 = 1 << 15, 0.1, 0.1
SLAB = 1 << 16
#: Features whose weights are gathered at a time, and sentences of a packed batch.
GATHER, PACK = 1 << 16, 2000


# -- features -----------------------------------------------------------------------------------------


def token_features(tokens: str, taggers: Sequence[str] = ()) -> Column:
    """For each token an array of names: itself, its last three letters, how it is written, its
    neighbours and how they are written, whether it is the first or last, and its tag in each
    column of taggers (arrays as long as the tokens)."""
    t = F.col(tokens)
    upper = lambda x: (x == F.upper(x)) & (x != F.lower(x))
    title = lambda x: x.rlike(r"^\p{Lu}[^\p{Lu}]*$")
    yes = lambda c, name: F.when(c, F.lit(name))

    def of(x: Column, i: Column) -> Column:
        out = [F.lit("bias"), F.concat(F.lit("word="), x), F.concat(F.lit("end="), F.substring(x, -3, 3)), yes(upper(x), "upper"), yes(title(x), "title"), yes(x.rlike(r"^\d+$"), "digits")]
        out += [F.concat(F.lit(f"{c}="), F.get(F.col(c), i)) for c in taggers]
        for step, side in ((-1, "before"), (1, "after")):
            y = F.get(t, i + step)
            out += [F.coalesce(F.concat(F.lit(f"{side}="), y), F.lit(f"nothing {side}")), yes(title(y), f"{side} title"), yes(upper(y), f"{side} upper")]
        return F.array_compact(F.array(*out))

    return F.transform(t, of)


def hashed(features: Column, dims: int = DIMS) -> Column:
    return F.transform(features, lambda names: F.transform(names, lambda n: F.pmod(F.xxhash64(n), F.lit(dims)).cast("int")))


# -- the model, in numpy ---------------------------------------------------------------------------------


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def forward_backward(emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sentences of one length: log of the sum over all tag sequences, shares of tags [sentence, token, tag],
    and expected transitions [tag, tag] over all of them. emit: [sentence, token, tag] scores."""
    whole, share, moves = _side_by_side(emit[None], move[None], np.ones((1, len(emit))))
    return whole[0], share[0], moves[0]


def _side_by_side(emit: np.ndarray, move: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for several models: emit [model, sentence, token, tag], move [model, tag, tag]; many [model, sentence]:
    how many sentences each counts as in expected transitions. Sums are scaled at each token; where they leave the
    range of doubles nevertheless, logs are summed instead."""
    n, top, high = emit.shape[2], emit.max(3, keepdims=True), move.max((1, 2), keepdims=True)
    with np.errstate(all="ignore"):
        e, m = np.exp(emit - top), np.exp(move - high)
        a, b, scale = np.empty_like(e), np.empty_like(e), np.empty(e.shape[:3])
        for t in range(n):
            x = e[:, :, 0] if t == 0 else (a[:, :, t - 1] @ m) * e[:, :, t]
            scale[:, :, t] = x.sum(2)
            a[:, :, t] = x / scale[:, :, t, None]
        b[:, :, -1] = 1.0
        for t in range(n - 2, -1, -1):
            b[:, :, t] = ((e[:, :, t + 1] * b[:, :, t + 1]) @ m.transpose(0, 2, 1)) / scale[:, :, t + 1, None]
        whole = np.log(scale).sum(2) + top[..., 0].sum(2) + (n - 1) * high[:, 0]
        moves = np.zeros_like(move)
        for t in range(n - 1):
            moves += (a[:, :, t] * many[..., None]).transpose(0, 2, 1) @ (e[:, :, t + 1] * b[:, :, t + 1] / scale[:, :, t + 1, None])
        share, moves = a * b, moves * m
    if not (np.isfinite(whole).all() and np.isfinite(share).all() and np.isfinite(moves).all()):
        for k in range(len(emit)):
            whole[k], share[k], moves[k] = _in_logs(emit[k], move[k], many[k])
    return whole, share, moves


def _in_logs(emit: np.ndarray, move: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = emit.shape[1]
    a, b = np.empty_like(emit), np.zeros_like(emit)
    a[:, 0] = emit[:, 0]
    for t in range(1, n):
        a[:, t] = log_sum(a[:, t - 1, :, None] + move, 1) + emit[:, t]
    for t in range(n - 2, -1, -1):
        b[:, t] = log_sum(move + (emit[:, t + 1] + b[:, t + 1])[:, None, :], 2)
    whole = log_sum(a[:, -1], 1)
    moves = np.zeros_like(move)
    for t in range(n - 1):
        moves += (np.exp(a[:, t, :, None] + move + (emit[:, t + 1] + b[:, t + 1])[:, None, :] - whole[:, None, None]) * many[:, None, None]).sum(0)
    return whole, np.exp(a + b - whole[:, None, None]), moves


def viterbi(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best tags [sentence, token]; of equals the first."""
    n, best = emit.shape[1], emit[:, 0]
    back = np.zeros(emit.shape, int)
    for t in range(1, n):
        s = best[:, :, None] + move
        back[:, t] = s.argmax(1)
        best = s.max(1) + emit[:, t]
    out = np.empty(emit.shape[:2], int)
    out[:, -1] = best.argmax(1)
    for t in range(n - 1, 0, -1):
        out[:, t - 1] = np.take_along_axis(back[:, t], out[:, t, None], 1)[:, 0]
    return out


class Sentences:
    """A batch of sentences as flat arrays: features of tokens, tokens of sentences, and sentences by length."""

    def __init__(self, column: pa.Array):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        tokens = column.flatten()
        self.ids = np.asarray(tokens.flatten())
        self.per_token = np.asarray(tokens.value_lengths()).astype(np.int64)
        self.length = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
        self.first = np.cumsum(self.length) - self.length

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """[token, tag]"""
        return gathered(weights, self.ids, self.per_token)

    def by_length(self) -> Iterator[np.ndarray]:
        """Places [sentence, token] of the tokens of sentences of one length."""
        for n in np.unique(self.length[self.length > 0]):
            yield self.first[self.length == n][:, None] + np.arange(n)


def gathered(x: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of x[at] over runs of the given lengths, which may be 0."""
    out, some = np.zeros((len(lengths), x.shape[1])), np.flatnonzero(lengths)
    first = (np.cumsum(lengths) - lengths)[some]
    k = 0
    while k < len(some):
        end = max(k + 1, int(np.searchsorted(first, first[k] + GATHER)))
        stop = first[end] if end < len(some) else len(at)
        out[some[k:end]] = np.add.reduceat(x[at[first[k] : stop]], first[k:end] - first[k], axis=0)
        k = end
    return out


def packed(s: Sentences, gold: np.ndarray, many: np.ndarray) -> dict[str, np.ndarray]:
    """What steps need of a batch: features of its different tokens, these by feature, and by length of sentences their
    tokens, tags and numbers. many [sentence, model]: how many sentences each counts as."""
    wide = np.full((len(s.per_token), int(s.per_token.max(initial=0))), -1, np.int32)
    wide[np.arange(wide.shape[1]) < s.per_token[:, None]] = s.ids
    rows, at = np.unique(wide, axis=0, return_inverse=True) if wide.size else (wide[:1], np.zeros(len(wide), int))
    there, at = rows >= 0, at.ravel()
    ids = rows[there]
    order = np.argsort(ids, kind="stable")
    features, n = np.unique(ids, return_counts=True)
    out = {"ids": ids, "per": there.sum(1), "features": features, "n": n, "token": np.repeat(np.arange(len(rows)), there.sum(1))[order]}
    for k, place in enumerate(s.by_length()):
        out |= {f"at{k}": at[place], f"gold{k}": gold[place], f"many{k}": many[s.length == place.shape[1]].T}
    return out


def losses_and_gradients(p: dict[str, np.ndarray], weights: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of several models over a packed batch: negative log-likelihoods of the gold tags, and their gradients by the batch's
    features, tags [feature, model, tag] and by transitions [model, tag, tag]. weights: [column, model, tag]."""
    models, tags = move.shape[:2]
    emit = gathered(weights.reshape(len(weights), -1), p["ids"], p["per"]).reshape(-1, models, tags)
    off, loss, moves = np.zeros_like(emit), np.zeros(models), np.zeros_like(move)
    for k in range(sum(name.startswith("at") for name in p)):
        at, y, many = p[f"at{k}"], p[f"gold{k}"], p[f"many{k}"]
        e = emit[at].transpose(2, 0, 1, 3)
        whole, share, expected = _side_by_side(e, move, many)
        right = np.take_along_axis(e, y[None, ..., None], 3)[..., 0].sum(2) + move[:, y[:, :-1], y[:, 1:]].sum(2)
        loss += ((whole - right) * many).sum(1)
        share -= y[..., None] == np.arange(tags)
        share *= many[:, :, None, None]
        flat, token = share.transpose(1, 2, 0, 3).reshape(-1, models * tags), at.ravel()
        order = np.argsort(token, kind="stable")
        own, n = np.unique(token, return_counts=True)
        off[own] += gathered(flat, order, n).reshape(-1, models, tags)
        moves += expected
        for a, b, w in zip(y[:, :-1].T, y[:, 1:].T, [many.T] * (y.shape[1] - 1), strict=True):
            np.subtract.at(moves.transpose(1, 2, 0), (a, b), w)
    return loss, gathered(off.reshape(len(off), -1), p["token"], p["n"]).reshape(-1, models, tags), moves


def loss_and_gradient(s: Sentences, gold: np.ndarray, weights: np.ndarray, move: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood of the gold tags, and its gradients by feature and tag and by transition."""
    p = packed(s, gold, np.ones((len(s.length), 1)))
    loss, by_feature, moves = losses_and_gradients(p, weights[:, None, :], move[None])
    grad = np.zeros_like(weights)
    grad[p["features"]] = by_feature[:, 0]
    return float(loss[0]), grad, moves[0]


def minimise(x: np.ndarray, l1: float = 0.0, steps: int = 100, memory: int = 8, tolerance: float = 1e-4, gain: float = 1e-7) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """L-BFGS as a generator: it yields a point, is sent the function's value and gradient there, and returns the
    best point. With l1 the sum of absolute values is added, and steps stay in an orthant (OWL-QN). Steps end where the largest slope is
    within the tolerance, or the value falls by less than the share gain."""
    past: list = []
    f, g = yield x
    f += l1 * np.abs(x).sum()
    for _ in range(steps):
        slope = g
        if l1:
            right, left = g + l1, g - l1
            slope = np.where(x > 0, right, np.where(x < 0, left, np.where(right < 0, right, np.where(left > 0, left, 0.0))))
        if np.abs(slope).max() <= tolerance * max(1.0, np.abs(x).max()):
            break
        d, alphas = -slope, []
        for s, y in reversed(past):
            alphas.append((s @ d) / (s @ y))
            d = d - alphas[-1] * y
        if past:
            s, y = past[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), alpha in zip(past, reversed(alphas), strict=True):
            d = d + (alpha - (y @ d) / (s @ y)) * s
        if l1:
            d = np.where(d * slope < 0, d, 0.0)
        if d @ slope >= 0:
            d, past = -slope, []
        size = 1.0 if past else min(1.0, 1.0 / np.abs(slope).sum())
        side = np.where(x != 0, np.sign(x), -np.sign(slope))
        for _ in range(30):
            new = x + size * d
            if l1:
                new = np.where(np.sign(new) == side, new, 0.0)
            got, grad = yield new
            got += l1 * np.abs(new).sum()
            if got <= f + 1e-4 * (slope @ (new - x)):
                break
            size /= 2
        else:
            break
        s, y = new - x, grad - g
        if s @ y > 1e-12:
            past = [*past[-memory + 1 :], (s, y)]
        done = f - got <= gain * max(1.0, abs(f))
        x, f, g = new, got, grad
        if done:
            break
    return x


# -- on Spark ---------------------------------------------------------------------------------------------


@dataclass
class Crf:
    """Weights [column, tag] of hashed features, and of transitions [tag, tag]."""

    weights: np.ndarray
    move: np.ndarray
    tags: tuple[str, ...] = field(default=TAGS)

    def tag(self, s: Sentences) -> np.ndarray:
        """The number of each token's tag."""
        emit, out = s.scores(self.weights), np.zeros(len(s.per_token), int)
        for at in s.by_length():
            out[at] = viterbi(emit[at], self.move)
        return out


def _pack(tags: Sequence[str]):
    """Batches of sentences as rows of bytes, for gradients."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), PACK):
                part = batch.slice(k, PACK)
                gold = np.asarray(pc.index_in(part.column("tags").flatten(), value_set=pa.array(list(tags), pa.string()))).astype(np.int64)
                many = np.asarray(part.column("many").flatten(), float).reshape(len(part), -1)
                data = io.BytesIO()
                np.savez(data, **packed(Sentences(part.column("features")), gold, many))
                yield pa.RecordBatch.from_arrays([pa.array([data.getvalue()], pa.binary())], names=["batch"])

    return run


def _gradients(points: list[np.ndarray], dims: int, tags: Sequence[str]):
    """Each task's sums: a row for each model and slab of its gradient; the loss is the last number of all."""
    n = len(tags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.stack([x[: dims * n].reshape(dims, n) for x in points], 1)
        move = np.stack([x[dims * n :].reshape(n, n) for x in points])
        grad, moves, loss = np.zeros_like(weights), np.zeros_like(move), np.zeros(len(points))
        for batch in batches:
            for data in batch.column("batch"):
                with np.load(io.BytesIO(data.as_py())) as f:
                    p = dict(f)
                one, by_feature, own = losses_and_gradients(p, weights, move)
                loss += one
                grad[p["features"]] += by_feature
                moves += own
        sums = [np.concatenate((grad[:, k].ravel(), moves[k].ravel(), loss[k : k + 1])) for k in range(len(points))]
        rows = [(k, a, v[a : a + SLAB].tobytes()) for k, v in enumerate(sums) for a in range(0, len(v), SLAB)]
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["model", "slab", "sums"])

    return run


def _add(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x.as_py()) for x in table.column("sums")], axis=0)
    return pa.table({"model": table.column("model").slice(0, 1), "slab": table.column("slab").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def fit(rows: DataFrame, folds: int = 1, tags: Sequence[str] = TAGS, dims: int = DIMS, c1: float = C1, c2: float = C2, steps: int = 100, gain: float = 1e-3) -> list[Crf]:
    """Models of rows (features as hashed() makes them, tags). With several folds one for each, which learns from the
    rows of all others (column fold, 0 to folds - 1); with one, from all rows. Or rows say for how many equal ones
    they stand in each model (column many, an array).

    All models' steps are taken side by side, one pass over the rows for each; a model's end when its loss falls by
    less than the share gain. Rows whose features or tags are null
    or empty, or differ in number, are left out; no rows leave all weights 0."""
    spark = rows.sparkSession
    ship(spark)
    n = len(tags)
    if "many" not in rows.columns:
        rows = rows.withColumn("many", F.array(*(F.coalesce(F.col("fold") != k, F.lit(True)).cast("double") if folds > 1 else F.lit(1.0) for k in range(folds))))
    rows = rows.where("size(features) > 0 and size(features) = size(tags)").select("features", "tags", F.col("many").cast("array<double>").alias("many"))
    written = Steps(spark, "crf-batches")
    rows = written.cut(rows.repartition(2 * spark.sparkContext.defaultParallelism).mapInArrow(_pack(tags), "batch binary"))
    search = [minimise(np.zeros(dims * n + n * n), c1, steps, gain=gain) for _ in range(folds)]
    points, done = [next(s) for s in search], [False] * folds
    while not all(done):
        sums = rows.mapInArrow(_gradients(points, dims, tags), "model int, slab int, sums binary").groupBy("model", "slab").applyInArrow(_add, "model int, slab int, sums binary")
        got = [np.zeros(dims * n + n * n + 1) for _ in range(folds)]
        for model, slab, data in sums.collect():  # as many numbers as the models have
            part = np.frombuffer(data)
            got[model][slab : slab + len(part)] = part
        for k, s in enumerate(search):
            if not done[k]:
                x = points[k]
                try:
                    points[k] = s.send((got[k][-1] + c2 * (x @ x), got[k][:-1] + 2 * c2 * x))
                except StopIteration as end:
                    points[k], done[k] = end.value, True
    written.drop(rows)
    return [Crf(x[: dims * n].reshape(dims, n), x[dims * n :].reshape(n, n), tuple(tags)) for x in points]


def tagged(rows: DataFrame, models: Sequence[Crf], out_col: str = "predicted") -> DataFrame:
    """Rows with the tags that most models give each token; of equals the tag that comes first among the models.

    rows: any columns, features as hashed() makes them. Null features give null."""
    spark = rows.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(list(models))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = batch.column("features")
            s = Sentences(features)
            votes = np.stack([m.tag(s) for m in shared.value]) if len(s.per_token) else np.zeros((1, 0), int)
            count = (votes[:, None, :] == votes[None, :, :]).sum(1)  # by model and token: how many models agree with it
            best = votes[count.argmax(0), np.arange(votes.shape[1])]
            names = np.array(shared.value[0].tags, object)[best] if votes.shape[1] else np.zeros(0, object)
            off = pa.array(np.concatenate(([0], np.cumsum(s.length))), pa.int32())
            got = pa.ListArray.from_arrays(off, pa.array(names, pa.string()), mask=features.is_null())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, `{out_col}` array<string>")


def tags_by_rule(spark: SparkSession, rule: Callable[[str], dict]):
    """A column function: tokens -> the tags that an extraction rule's pairs give them, short forms first."""
    ship(spark)

    def one(tokens) -> list[str]:
        own = [t.lower() for t in tokens]
        tags = ["O"] * len(own)
        pairs = rule(" ".join(tokens))
        for kind, forms in (("short", pairs), ("long", [x for x in pairs.values() if x])):
            for form in forms:
                words = form.lower().split()
                for i in range(len(own) - len(words) + 1):
                    if words and own[i : i + len(words)] == words and tags[i : i + len(words)] == ["O"] * len(words):
                        tags[i : i + len(words)] = [f"B-{kind}", *[f"I-{kind}"] * (len(words) - 1)]
        return tags

    @F.pandas_udf("array<string>")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else one(list(t)) for t in column])

    return run


def scores(rows: DataFrame, gold: str = "tags", found: str = "predicted", by: Sequence[str] = (), n: str | None = None) -> DataFrame:
    """Precision, recall and F1 of each tag but O, by the given columns. n: a column that says for how many rows each stands."""
    pairs = rows.select(*by, (F.lit(1) if n is None else F.col(n)).cast("long").alias("n"), F.explode(F.arrays_zip(F.col(gold).alias("g"), F.col(found).alias("f"))).alias("x")).select(*by, "n", "x.g", "x.f")
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    counts = pairs.withColumn("tag", F.explode(F.array_distinct(F.array("g", "f")))).where("tag <> 'O'").groupBy(*by, "tag").agg(
        count(F.col("g") == F.col("tag")).alias("gold"), count(F.col("f") == F.col("tag")).alias("found"), count((F.col("g") == F.col("f")) & (F.col("g") == F.col("tag"))).alias("right")
    )
    p, r = F.col("right") / F.nullif("found", F.lit(0)), F.col("right") / F.nullif("gold", F.lit(0))
    f1 = F.coalesce(2 * F.col("right") / F.nullif(F.col("gold") + F.col("found"), F.lit(0)), F.lit(0.0))
    return counts.select(*by, "tag", "gold", "found", "right", F.coalesce(p, F.lit(0.0)).alias("precision"), F.coalesce(r, F.lit(0.0)).alias("recall"), f1.alias("f1"))
