"""Toxicity of whole texts: a bidirectional gated recurrent network with attention pooling.

A word's input is a hashed word vector, the mean of hashed vectors of its byte trigrams,
and two log odds between toxic and other training documents: the word's own, and the
largest among its runs of GRAM characters (of both a training document's own counts are
left out, so that the network learns how far to trust them).
Two gated recurrent layers read a window of words from both sides; attention pools their
states to one vector and a logit. Windows overlap by half and cover the whole text; a
text's logit is the largest of its windows', calibrated on training rows that the
network was not fitted on. All of it is numpy; fitting is on the driver, over a bounded
sample of labelled rows, and scoring runs where the texts are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkronym.llm import words as w
from sparkronym.llm.common import Scratch, names, ship

WINDOW, STRIDE = 32, 16
#: Labelled rows of each label that the network is fitted on at most, and bytes of their texts together, which are
#: read whole. A row of more than a LARGEST-th of these bytes is not in the sample.
SAMPLE_ROWS, SAMPLE_BYTES, LARGEST = 2000, 3 << 20, 8
WORD_ROWS, WORD_DIM = 1 << 13, 6
CHAR_ROWS, CHAR_DIM = 1 << 12, 4
GRAM = 6
ODDS = 2
INPUTS = ODDS + WORD_DIM + CHAR_DIM
HIDDEN, ATTENTION = 8, 8
EPOCHS, BATCH, RATE, DECAY = 8, 128, 0.01, 1e-4
U = np.uint64

#: What separates words here: ASCII that is neither letter nor digit.
IS_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


class Words:
    """The words of texts, lower-cased, with the inputs that don't depend on counts."""

    def __init__(self, column: pa.Array):
        data, off = w.text_bytes(column)
        data = np.where(IS_MARK[data], np.uint8(0x20), w.LOWER[data])
        starts, ends, self.of = w.spans(data, off)
        h = w.hashes(data, starts, ends, 6)
        self.hash, first, self.at = np.unique(h, return_index=True, return_inverse=True)
        self.word_row = (self.hash >> U(20)).astype(np.int64) & (WORD_ROWS - 1)
        # trigrams of each distinct word, with a mark at its ends
        s, n = starts[first], (ends - starts)[first]
        owner = np.repeat(np.arange(len(s)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        b = data[np.repeat(s, n) + k].astype(np.int64) if len(s) else np.zeros(0, np.int64)
        left = np.where(k > 0, np.roll(b, 1), 1)
        right = np.where(k < np.repeat(n, n) - 1, np.roll(b, -1), 2)
        gram = w.mix((left << 16 | b << 8 | right).astype(U))
        # runs of GRAM bytes, ends marked; a shorter word as a whole
        m = n + 2
        at = np.cumsum(m) - m
        marked = np.ones(m.sum(), np.uint8)
        marked[np.repeat(at, n) + 1 + k] = data[np.repeat(s, n) + k] if len(s) else 0
        marked[at + m - 1] = 2
        self.n_grams = np.maximum(1, m - GRAM + 1)
        self.gram_first = np.cumsum(self.n_grams) - self.n_grams
        g = np.repeat(at - self.gram_first, self.n_grams) + np.arange(self.n_grams.sum())
        self.gram = w.hashes(marked, g, g + np.repeat(np.minimum(m, GRAM), self.n_grams), 8)
        self.char_row, self.char_owner, self.length = (gram >> U(30)).astype(np.int64) & (CHAR_ROWS - 1), owner, n

    def strongest(self, gram_odds: np.ndarray) -> np.ndarray:
        """Each word's largest log odds of a run of characters."""
        return np.maximum.reduceat(gram_odds, self.gram_first) if len(gram_odds) else gram_odds

    def inputs(self, p: dict, odds: np.ndarray) -> np.ndarray:
        """A row of inputs for each distinct word; odds: its two log odds."""
        out = np.zeros((len(self.hash), INPUTS), np.float32)
        out[:, :ODDS] = odds
        out[:, ODDS : ODDS + WORD_DIM] = p["word"][self.word_row]
        for c in range(CHAR_DIM):
            out[:, ODDS + WORD_DIM + c] = np.bincount(self.char_owner, p["char"][self.char_row, c], len(self.hash)) / np.maximum(self.length, 1)
        return out


def windows(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text of each window; texts without words have none."""
    n = np.diff(of)
    per = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1, 0)
    text = np.repeat(np.arange(len(n)), per)
    k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    start = of[:-1][text] + k * STRIDE
    return start, np.minimum(WINDOW, of[1:][text] - start), text


def new_model(seed: int = 0) -> dict:
    r = np.random.default_rng(seed)
    p = {"word": r.normal(0, 0.05, (WORD_ROWS, WORD_DIM)), "char": r.normal(0, 0.05, (CHAR_ROWS, CHAR_DIM))}
    for d in "fb":
        p |= {f"W{d}": r.normal(0, 0.3, (INPUTS, 3 * HIDDEN)), f"U{d}": r.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)), f"c{d}": np.zeros(3 * HIDDEN)}
    p |= {"A": r.normal(0, 0.3, (2 * HIDDEN, ATTENTION)), "a": np.zeros(ATTENTION), "v": r.normal(0, 0.3, ATTENTION), "w": r.normal(0, 0.3, 2 * HIDDEN), "b": np.zeros(1)}
    return {k: x.astype(np.float32) for k, x in p.items()}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(p: dict, gates: dict, index: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows. gates: by direction the inputs' part of the gates for each row
    that index (windows x WINDOW) points to; mask: which places hold words."""
    n, t = index.shape
    h_all = np.empty((t, n, 2 * HIDDEN), np.float32)
    memo = {}
    for d, o in (("f", 0), ("b", HIDDEN)):
        h, u = np.zeros((n, HIDDEN), np.float32), p[f"U{d}"]
        for k in range(t) if d == "f" else reversed(range(t)):
            g, s = gates[d][index[:, k]], h @ u
            zr = sigmoid(g[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(g[:, 2 * HIDDEN :] + r * s[:, 2 * HIDDEN :])
            out = np.where(mask[:, k, None], new + z * (h - new), h)
            if keep:
                memo[d, k] = (h, z, r, new, s[:, 2 * HIDDEN :])
            h = out
            h_all[k, :, o : o + HIDDEN] = h
    e = np.tanh(h_all @ p["A"] + p["a"])
    score = np.where(mask.T, e @ p["v"], np.float32(-1e9))
    alpha = np.exp(score - score.max(0))
    alpha /= alpha.sum(0)
    pooled = np.einsum("tn,tnh->nh", alpha, h_all)
    logit = pooled @ p["w"] + p["b"][0]
    return (logit, (h_all, e, alpha, pooled, memo)) if keep else logit


def backward(p: dict, x: np.ndarray, index: np.ndarray, mask: np.ndarray, kept, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the parameters (but tables) and of the rows of inputs x."""
    h_all, e, alpha, pooled, memo = kept
    g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "char")}
    g["w"], g["b"] = pooled.T @ d_logit, np.array([d_logit.sum()], np.float32)
    d_pool = d_logit[:, None] * p["w"]
    d_alpha = np.einsum("tnh,nh->tn", h_all, d_pool)
    d_h = alpha[:, :, None] * d_pool
    d_score = alpha * (d_alpha - (alpha * d_alpha).sum(0))
    d_e = d_score[:, :, None] * p["v"] * (1 - e * e)
    g["v"] = np.einsum("tna,tn->a", e, d_score)
    g["a"] = d_e.sum((0, 1))
    g["A"] = np.einsum("tnh,tna->ha", h_all, d_e)
    d_h += d_e @ p["A"].T
    d_x = np.zeros_like(x)
    n, t = index.shape
    for d, o in (("f", 0), ("b", HIDDEN)):
        carry, u, wt = np.zeros((n, HIDDEN), np.float32), p[f"U{d}"], p[f"W{d}"]
        for k in reversed(range(t)) if d == "f" else range(t):
            h, z, r, new, s = memo[d, k]
            dh = d_h[k, :, o : o + HIDDEN] + carry
            m = mask[:, k, None]
            dm = np.where(m, dh, 0)
            d_new = dm * (1 - z) * (1 - new * new)
            d_zr = np.concatenate((dm * (h - new) * z * (1 - z), d_new * s * r * (1 - r)), 1)
            d_g = np.concatenate((d_zr, d_new), 1)
            d_s = np.concatenate((d_zr, d_new * r), 1)
            g[f"U{d}"] += h.T @ d_s
            g[f"c{d}"] += d_g.sum(0)
            rows = index[:, k]
            g[f"W{d}"] += x[rows].T @ d_g
            np.add.at(d_x, rows, d_g @ wt.T)
            carry = dm * z + d_s @ u.T + np.where(m, 0, dh)
    return g, d_x


def gates_of(p: dict, x: np.ndarray) -> dict:
    return {d: x @ p[f"W{d}"] + p[f"c{d}"] for d in "fb"}


def log_odds(pos, neg, n_pos: int, n_neg: int) -> np.ndarray:
    """Smoothed log odds of a word by the documents with it, drawn to 0 where these are few."""
    raw = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    return (raw * (pos + neg) / (pos + neg + 1.0)).astype(np.float32)


def _padded(start: np.ndarray, length: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(WINDOW)
    mask = k < length[:, None]
    return at[np.minimum(start[:, None] + k, max(0, len(at) - 1))], mask


def fit(texts: list[str], labels: list[int], rate: float, seed: int = 0) -> dict:
    """A model from labelled texts. rate: of label 1 among all labelled rows, to which scores are calibrated."""
    y = np.array(labels, np.int64)
    p = new_model(seed)
    if not len(y) or y.min() == y.max():
        return {"p": p, "words": (np.zeros(0, U), np.zeros(0, np.float32)), "grams": (np.zeros(0, U), np.zeros(0, np.float32)), "unseen": np.float32(0), "scale": 0.0, "shift": float(np.log((rate + 1e-6) / (1 - rate + 1e-6)))}
    x = Words(pa.array(texts, pa.string()))
    doc = np.repeat(np.arange(len(y)), np.diff(x.of))
    pair = np.unique(x.at * len(y) + doc)
    word, of = pair // len(y), pair % len(y)
    tune = np.arange(len(y)) % 4 == 3  # for the calibration
    n_pos, n_neg = int(y[~tune].sum()), int((1 - y[~tune]).sum())

    def odds(pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
        """Log odds without a document of label 0, without one of label 1, and with all."""
        less = [log_odds(np.maximum(pos - lab, 0), np.maximum(neg - (1 - lab), 0), n_pos, n_neg) for lab in (0, 1)]
        return np.stack((*less, log_odds(pos, neg, n_pos, n_neg)))

    fitted = ~tune[of]
    pos, neg = (np.bincount(word[fitted & (y[of] == lab)], minlength=len(x.hash)) for lab in (1, 0))
    word_odds, met = odds(pos, neg), pos + neg > 1
    gram_hash, gram = np.unique(x.gram, return_inverse=True)
    pos, neg = np.zeros(len(gram_hash), np.int64), np.zeros(len(gram_hash), np.int64)
    order = np.argsort(of, kind="stable")
    bound = np.searchsorted(of[order], np.arange(0, len(y) + 100, 100))
    for a, b in zip(bound[:-1], bound[1:], strict=True):  # a hundred documents at a time
        some = order[a:b]
        some = some[fitted[some]]
        n = x.n_grams[word[some]]
        each = np.repeat(x.gram_first[word[some]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        once = np.unique(gram[each] * len(y) + np.repeat(of[some], n))
        np.add.at(pos, once[y[once % len(y)] == 1] // len(y), 1)
        np.add.at(neg, once[y[once % len(y)] == 0] // len(y), 1)
    gram_odds, gram_met = odds(pos, neg), pos + neg > 1
    odds3 = np.stack([np.stack((o, x.strongest(g[gram])), 1) for o, g in zip(word_odds, gram_odds, strict=True)])
    full = odds3[2]
    start, length, text = windows(x.of)
    index, mask = _padded(start, length, x.at)
    own = np.where(mask, np.where(tune[text], 2, y[text])[:, None], 0)
    strong = np.where(mask, odds3.max(2)[own, index], -9).max(1)
    # of each text, the window with the most telling word, and another
    rng = np.random.default_rng(seed)
    best = np.lexsort((-strong, text))
    best = best[np.unique(text[best], return_index=True)[1]]
    other = rng.permutation(len(text))
    other = other[np.unique(text[other], return_index=True)[1]]
    train = np.unique(np.concatenate((best, other[y[text[other]] == 0])))
    train = train[~tune[text[train]]]
    base = x.inputs(p, full)
    momentum = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    step = 0
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(train), max(1, len(train) // BATCH)):
            step += 1
            # rows of inputs for this batch: distinct (word, label left out)
            key = index[part] * 2 + y[text[part]][:, None]
            rows, inv = np.unique(key, return_inverse=True)
            inv = inv.reshape(key.shape)
            wd, lab = rows // 2, rows % 2
            base_rows = base[wd]
            base_rows[:, :ODDS] = odds3[lab, wd]
            base_rows[:, ODDS : ODDS + WORD_DIM] = p["word"][x.word_row[wd]]
            if step % 8 == 1:
                chars = x.inputs(p, full)[:, ODDS + WORD_DIM :]
            base_rows[:, ODDS + WORD_DIM :] = chars[wd]
            logit, kept = forward(p, gates_of(p, base_rows), inv, mask[part], True)
            g, d_x = backward(p, base_rows, inv, mask[part], kept, ((sigmoid(logit) - y[text[part]]) / len(part)).astype(np.float32))
            g["word"] = np.zeros_like(p["word"])
            np.add.at(g["word"], x.word_row[wd], d_x[:, ODDS : ODDS + WORD_DIM])
            d_word = np.zeros((len(x.hash), CHAR_DIM), np.float32)
            np.add.at(d_word, wd, d_x[:, ODDS + WORD_DIM :])
            d_word /= np.maximum(x.length, 1)[:, None]
            g["char"] = np.stack([np.bincount(x.char_row, d_word[x.char_owner, c], CHAR_ROWS) for c in range(CHAR_DIM)], 1).astype(np.float32)
            for k, m in momentum.items():  # Adam
                m[0] += 0.1 * (g[k] - m[0])
                m[1] += 0.001 * (g[k] * g[k] - m[1])
                p[k] -= RATE * ((m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8) + DECAY * p[k]).astype(np.float32)
    model = {"p": p, "words": (x.hash[met], word_odds[2][met]), "grams": (gram_hash[gram_met], gram_odds[2][gram_met]), "unseen": log_odds(np.zeros(1), np.zeros(1), n_pos, n_neg)[0], "scale": 1.0, "shift": 0.0}
    # logistic calibration on rows not fitted, weighted back to the rate among all labelled rows
    raw, has = logits(model, pa.array([t for t, k in zip(texts, tune.tolist(), strict=True) if k], pa.string()))
    yt, raw = y[tune][has], raw[has]
    if len(yt) and yt.min() != yt.max():
        weight = np.where(yt == 1, rate / max(1, yt.sum()), (1 - rate) / max(1, (1 - yt).sum()))
        # few rows say little: the less of them, the nearer to the network's own logit at that rate
        hold, b0 = 0.1 / len(yt), float(np.log(rate / (1 - rate)) - np.log(n_pos / n_neg))
        s, b = 1.0, b0
        for _ in range(50):  # Newton steps
            q = sigmoid(s * raw + b)
            v = weight * q * (1 - q)
            grad = np.array([(weight * (q - yt) * raw).sum() + hold * (s - 1), (weight * (q - yt)).sum() + hold * (b - b0)])
            hess = np.array([[(v * raw * raw).sum() + hold, (v * raw).sum()], [(v * raw).sum(), v.sum() + hold]])
            move = np.linalg.solve(hess, grad)
            s, b = s - float(np.clip(move[0], -1, 1)), b - float(np.clip(move[1], -2, 2))
        model |= {"scale": max(s, 0.05), "shift": b}
    model["empty"] = float(rate)
    return model


def _look_up(table: tuple[np.ndarray, np.ndarray], key: np.ndarray, other: float) -> np.ndarray:
    keys, values = table
    if not len(keys):
        return np.full(len(key), other, np.float32)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where(keys[at] == key, values[at], other).astype(np.float32)


def logits(model: dict, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The largest logit of each text's windows; and which texts have words."""
    x = Words(column)
    odds = np.stack((_look_up(model["words"], x.hash, model["unseen"]), x.strongest(_look_up(model["grams"], x.gram, model["unseen"]))), 1)
    gates = gates_of(model["p"], x.inputs(model["p"], odds)) if len(x.hash) else {}
    start, length, text = windows(x.of)
    out = np.full(len(column), -np.inf)
    for a in range(0, len(start), 4096):
        index, mask = _padded(start[a : a + 4096], length[a : a + 4096], x.at)
        np.maximum.at(out, text[a : a + 4096], forward(model["p"], gates, index, mask))
    return out, np.isfinite(out)


def _score(model, kept: int, columns: list[str]):
    """The first so many columns, and the score of the text in the one after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part in w.slices(batch, kept):
                raw, has = logits(m, part.column(kept))
                score = np.full(len(part), m.get("empty", float(sigmoid(np.float64(m["shift"])))))
                score[has] = sigmoid(m["scale"] * raw[has] + m["shift"])
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], pa.array(score, pa.float64())], names=columns)

    return w.tidy(run)


def is_held_out(id_col: str | Column) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string")) % 5 == 0, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES
) -> dict:
    """A model fitted on at most so many labelled rows of each label and so many bytes of their whole texts, none of
    them held out, chosen by a hash of the id.

    Labels that are null or neither 0 nor 1 are left out; of several of one id the
    largest counts, and of several texts of one id the smallest. A null text is empty.
    Ids that no document has are passed over. Rows of no id are not learnt from. Without
    rows of both labels scores are a constant. Other columns are not read, whatever
    their names."""
    lab = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and id is not null").groupBy("id").agg(F.max("y").alias("y")).where(~is_held_out("id"))
    n = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.lit("sample"), "id")
    few = None
    for v in (0, 1):
        part = lab.where(F.col("y") == v).orderBy(order, "id").limit(rows)
        few = part if few is None else few.unionByName(part)
    text = F.coalesce(F.col(text_col), F.lit(""))
    got = docs.select(F.col(id_col).alias("d"), text.alias("t")).where(F.octet_length("t") <= most_bytes // LARGEST)
    scratch = Scratch(docs.sparkSession, "toxicity")
    got = got.join(F.broadcast(few), F.col("d") == F.col("id")).groupBy("id", "y").agg(F.min("t").alias("t"))
    got = scratch.save(got.withColumn("h", order).withColumn("size", F.octet_length("t")), "sample")
    chosen, left = [], {0: most_bytes, 1: most_bytes}
    for r in got.select("id", "y", "size", "h").orderBy("h", "id").collect():  # one for each row of the sample
        left[r["y"]] -= r["size"]
        if left[r["y"]] >= 0:
            chosen.append((r["id"],))
    if chosen:
        ids = docs.sparkSession.createDataFrame(chosen, T.StructType([T.StructField("id", got.schema["id"].dataType)]))
        took = sorted(got.join(F.broadcast(ids), "id").select("h", "id", "y", "t").collect())
    else:
        took = []
    scratch.close()
    total = n.get(0, 0) + n.get(1, 0)
    model = fit([r["t"] for r in took], [r["y"] for r in took], n.get(1, 0) / total if total else 0.0)
    del took
    w.release()
    return model


def score(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None, out_col: str = "score") -> DataFrame:
    """Columns keep of docs (all by default) and the score, which replaces a column of its name.

    Each row is scored by itself, repeated ones alike. A null, empty or wordless text has
    the rate of label 1. Texts are read whole, whatever their length. An empty table
    gives an empty result."""
    spark = docs.sparkSession
    ship(spark)
    keep = [c for c in (keep if keep is not None else docs.columns) if c != out_col]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out_col, T.DoubleType())])
    (text,) = names(docs, "text")
    return docs.select(*keep, F.col(text_col).cast("string").alias(text)).mapInArrow(_score(spark.sparkContext.broadcast(model), len(keep), [*keep, out_col]), schema)


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """The rows of docs, columns as they are whatever their names, that score below the threshold."""
    (out,) = names(docs, "score")
    return score(docs, train(docs, labels, **how), out_col=out).where(F.col(out) < threshold).select(*docs.columns)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model, keep=["doc_id"])
    return out.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
