"""Each operator against a brute-force version on a small fixture with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkronym.llm import bpe, embeddings, exact_dedup, graph, jaccard, mixing, sharding, substrings, toxicity, warc, words
from sparkronym.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def texts():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, base = say(70), say(120).split()
    out = [None, "", " ", "\t\n", "a", "a", "A", "a b", "a  b", "a\tb", "é ü", "a" * 9000, say(3000), passage]
    out += [say(40) + " " + passage + " " + say(20) for _ in range(6)]
    for k in range(12):
        w = list(base)
        for _ in range(k % 4):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        out.append(" ".join(w))
    out += [say(60) for _ in range(10)] + ["Copy " + say(55)] * 5
    return out


def documents(spark):
    t = texts()
    rows = [(i * 3 % len(t) if np.gcd(3, len(t)) == 1 else i, x, "x", 1.0) for i, x in enumerate(t)]
    # columns whose names the operators use inside
    return spark.createDataFrame(rows, "doc_id long, text string, row string, h double").repartition(5)


def pairs_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def components(ids, links):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    return root


# -- exact dedup -------------------------------------------------------------------------------------


@pytest.mark.parametrize(("block", "bits"), [(4096, 63), (7, 63), (7, 2)])
def test_exact_groups(spark, block, bits):
    d = documents(spark)
    norm = {i: SPACE.sub(" ", t or "") for i, t in pairs_of(d)}
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(d, block_bytes=block, key_bits=bits).collect()}
    assert set(got) == set(norm)
    for i, t in norm.items():
        same = [j for j, u in norm.items() if u == t]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (min(same), len(same), i == min(same))
        assert got[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_exact_rows_that_repeat(spark):
    d = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(d).collect())
    assert got == [(0, 0, 1, True), (0, 1, 3, False), (1, 1, 1, True), (1, 1, 3, False), (1, 1, 3, True)]
    assert exact_dedup.drop_copies(d).count() == 3
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


# -- byte pairs --------------------------------------------------------------------------------------


def test_bpe_like_the_library(spark):
    import tiktoken

    path, pattern = bpe.public()
    with open(path, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    odd = ["".join(r.choice(" \n\t\x1c\x85\xa0　ab'sé中ß1٣²-😀​\x00lre") for _ in range(r.randrange(50))) for _ in range(300)]
    t = [x for x in texts()] + odd + ["ab" * 3000, "!" * 5000, "<|endoftext|>"]
    d = spark.createDataFrame([(i, x, 7) for i, x in enumerate(t)], "doc_id long, text string, ids long")
    got = {r["doc_id"]: r for r in bpe.encode(d, path, pattern, outputs=("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256")).collect()}
    for i, x in enumerate(t):
        want = enc.encode_ordinary(x or "")
        assert got[i]["ids"] == want and got[i]["n_tokens"] == len(want)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert bytes(got[i]["decoded"]) == (x or "").encode() and got[i]["decoded_sha256"] == hashlib.sha256((x or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(d, path, pattern), path)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: x or "" for i, x in enumerate(t)}
    assert bpe.encode(empty(spark), path, pattern).count() == 0


# -- near duplicates on shingles ---------------------------------------------------------------------


def shingles(t, k):
    w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("k", "percent", "many"), [(3, 90, 8), (5, 80, 1)])
def test_near_duplicates(spark, k, percent, many):
    d = documents(spark)
    s = {i: shingles(t, k) for i, t in pairs_of(d)}
    links = [(a, b) for a, b in itertools.combinations(s, 2) if s[a] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    want = components(s, links)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(d, k, percent, many=many).collect()}
    assert got == {i: (len(x), want[i]) for i, x in s.items()}
    assert any(i != c for i, c in want.items())


def test_near_duplicates_keep_one_and_empty(spark):
    d = documents(spark)
    kept = jaccard.keep_one(d, words=5, percent=80)
    found = {r["component_id"] for r in jaccard.near_duplicates(d, 5, 80).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(found) and kept.columns == d.columns
    assert jaccard.near_duplicates(empty(spark)).count() == 0


def test_shared_buckets():
    """Two linked sets always have a bucket in common."""
    r = np.random.default_rng(3)
    for percent, n in itertools.product((80, 90), (1, 2, 5, 12, 40, 200, 700)):
        begin = jaccard.bands(percent, 3 * n + 9)
        begin += [begin[-1] * 2, begin[-1] * 4]
        for _ in range(20):
            a = r.integers(0, 1 << 63, n, np.int64).astype(np.uint64)
            drop = int(r.integers(0, n - jaccard.least_overlap(n, percent) + 1))
            b = a[drop:]
            room = int(len(b) * 100 // percent - n) if drop == 0 else 0
            b = np.concatenate((b, r.integers(0, 1 << 63, max(0, room), np.int64).astype(np.uint64)))
            both = len(np.intersect1d(a, b))
            if 100 * both < percent * (len(a) + len(b) - both):
                continue
            x, y = (np.concatenate(jaccard.buckets(np.unique(z), percent, begin)) for z in (a, b))
            assert len(np.intersect1d(x, y)), (percent, n, drop)


def test_differing_is_a_lower_bound():
    r = np.random.default_rng(0)
    for n in (10, 500, 3000):
        a = np.unique(r.integers(0, 1 << 63, n, np.int64).astype(np.uint64))
        b = np.unique(np.concatenate((a[: n // 2], r.integers(0, 1 << 63, n // 3, np.int64).astype(np.uint64))))
        assert jaccard.differing(jaccard.bitmap(a), jaccard.bitmap(b)) <= len(np.setxor1d(a, b))


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(30)]
    got = {x["v"]: x["label"] for x in graph.components(spark.createDataFrame(edges, "x long, y long"), Scratch(spark, "t")).collect()}
    want = components({v for e in edges for v in e}, edges)
    assert got == {v: c for v, c in want.items() if any(v in e and e[0] != e[1] for e in edges)}


# -- vectors -----------------------------------------------------------------------------------------


def test_near_vectors(spark, monkeypatch):
    r = np.random.default_rng(4)
    base = r.normal(size=(30, 8))
    v = [x.tolist() for x in base] + [(x + r.normal(size=8) * 0.1).tolist() for x in np.repeat(base[:10], 12, 0)] + [base[0].tolist()] * 40
    v += [None, [], [0.0] * 8, [None] + [1.0] * 7, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [1.0, 2.0], [2.0, 4.0], (base[1] * 1e200).tolist()]
    ids = list(range(len(v)))
    d = spark.createDataFrame([(i, x, i % 3, "z") for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>, label int, row string").repartition(3)
    ok = {i: np.array(x) for i, x in zip(ids, v, strict=True) if x and all(y is not None and np.isfinite(y) for y in x) and any(x)}
    unit = {i: x / np.abs(x).max() for i, x in ok.items()}
    unit = {i: x / np.linalg.norm(x) for i, x in unit.items()}
    links = [(a, b) for a, b in itertools.combinations(unit, 2) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    want = components(ids, links)
    n = {i: sum(i in e for e in links) for i in ids}
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 64)
    monkeypatch.setattr(embeddings, "LEAF", 8)
    monkeypatch.setattr(embeddings, "FAN", 2)
    got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in embeddings.near_vectors(d).collect()}
    assert got == {i: (n[i], want[i], want[i] == i) for i in ids}
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# -- repeated passages -------------------------------------------------------------------------------


@pytest.mark.parametrize("most_bits", [1 << 29, 1 << 11])
def test_remove_repeats(spark, most_bits, monkeypatch):
    if most_bits < 1 << 29:
        monkeypatch.setattr(substrings, "SLAB", 8)  # a sketch of a few cells, that estimates nearly all windows repeated
    d = documents(spark)
    w = {i: WORD.findall(t or "") for i, t in pairs_of(d)}
    first: dict = {}
    for i in sorted(w):
        for p in range(len(w[i]) - 49):
            first.setdefault(tuple(w[i][p : p + 50]), i)
    got = {r["doc_id"]: r for r in substrings.remove_repeats(d, with_text=True, most_bits=most_bits).collect()}
    for i, x in w.items():
        gone = {q for p in range(len(x) - 49) if first[tuple(x[p : p + 50])] < i for q in range(p, p + 50)}
        kept = " ".join(y for q, y in enumerate(x) if q not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_text"]) == (len(x), len(gone), kept)
        assert got[i]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert sum(r["n_removed"] for r in got.values()) > 300
    assert substrings.remove_repeats(empty(spark)).count() == 0


def test_words_like_the_pattern():
    import pyarrow as pa

    t = [x or "" for x in texts()] + ["  lead", "tail \x0b", "\x85 \xa0x"]
    data, off = words.text_bytes(pa.array(t))
    s, e, of = words.spans(data, off)
    h = words.hashes(data, s, e)
    seen: dict = {}
    for k, x in enumerate(t):
        own = [bytes(data[a:b]).decode() for a, b in zip(s[of[k] : of[k + 1]], e[of[k] : of[k + 1]], strict=True)]
        assert own == WORD.findall(x)
        for a, b in zip(own, h[of[k] : of[k + 1]].tolist(), strict=True):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


def complements(n):
    """Two words of 2^n bytes that many polynomial hashes can't tell apart."""
    a = "a"
    for _ in range(n):
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [5, 6, 7, 9, 10, 11])
def test_words_and_their_complements_differ(n):
    import pyarrow as pa

    data, off = words.text_bytes(pa.array(complements(n)))
    s, e, _ = words.spans(data, off)
    for seed in (0, 1, 2, 6, 8):
        assert len(set(words.hashes(data, s, e, seed).tolist())) == 2
    a = np.array([1 << 40, 1 << 50], np.uint64)
    pattern = np.array([c == "b" for c in complements(n)[0]], int)
    for k in (3, 13, 32, 50):
        if k <= len(pattern):
            assert words.runs(a[pattern[:k]], k)[0] != words.runs(a[1 - pattern[:k]], k)[0]


def test_near_duplicates_and_repeats_of_such_words(spark):
    x, y = complements(10)
    p, q = complements(11)
    body = " ".join(f"v{i}" for i in range(60))
    rows = [(1, x), (2, y), (3, f"{x} {y} {p} {q} {x} {q}"), (4, f"{x} {body}"), (5, f"{y} {body[3:]} end"), (6, " ".join([p] * 25 + [x] * 25)), (7, " ".join([q] * 25 + [y] * 25))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    s = {i: shingles(t, 3) for i, t in rows}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(d, 3, 90).collect()}
    links = [(a, b) for a, b in itertools.combinations(s, 2) if 100 * len(s[a] & s[b]) >= 90 * len(s[a] | s[b])]
    want = components(s, links)
    assert got == {i: (len(s[i]), want[i]) for i in s}
    gone = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(d).collect()}
    assert gone == {i: 59 if i == 5 else 0 for i in s}


# -- toxicity ----------------------------------------------------------------------------------------


def test_gradients():
    r = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.new_model(1).items()}
    x, index = r.normal(size=(6, toxicity.INPUTS)), r.integers(0, 6, (3, 5))
    mask = np.arange(5) < np.array([5, 3, 1])[:, None]
    y = np.array([1.0, 0.0, 1.0])

    def loss(p, x):
        q = toxicity.sigmoid(toxicity.forward(p, toxicity.gates_of(p, x), index, mask))
        return -(y * np.log(q) + (1 - y) * np.log(1 - q)).sum()

    logit, kept = toxicity.forward(p, toxicity.gates_of(p, x), index, mask, True)
    g, d_x = toxicity.backward(p, x, index, mask, kept, toxicity.sigmoid(logit) - y)
    for k in g:
        at = tuple(r.integers(0, n) for n in p[k].shape)
        q = {**p, k: p[k].copy()}
        q[k][at] += 1e-3
        lo = {**p, k: p[k].copy()}
        lo[k][at] -= 1e-3
        assert abs((loss(q, x) - loss(lo, x)) / 2e-3 - g[k][at]) < 2e-2 * max(1, abs(g[k][at])), k


def test_toxicity_held_out(spark):
    r = random.Random(0)
    say = lambda n: [f"x{r.randrange(300)}" for _ in range(n)]
    rows, labels = [], []
    for i in range(900):
        w = say(r.choice((5, 40, 120)))
        y = int(i % 5 == 1)
        if y:
            w[r.randrange(len(w))] = r.choice(["idiot", "scum!", "Moron"])
        rows.append((i, " ".join(w)))
        labels.append((i, y))
    rows += [(1000, None), (1001, ""), (None, "idiot"), (1002, "word " * 5000 + "idiot")]
    labels += [(None, 1), (1000, None), (5, 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    m = toxicity.train(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {x["doc_id"]: x["score"] for x in toxicity.score(d, m, keep=["doc_id"]).collect()}
    held = [(got[i], i % 5 == 1) for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((s >= 0.5) == y for s, y in held) / len(held) > 0.97
    assert got[1002] >= 0.5 and got[1000] == got[1001] and 0 <= got[1000] < 0.5
    none = toxicity.train(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(empty(spark), none).count() == 0 and all(0 <= x["score"] <= 1 for x in toxicity.score(d, none).collect())


# -- sharding ----------------------------------------------------------------------------------------


def test_transfers_move_least():
    old, new = [10, 0, 7], [5, 6, 5, 1]
    got = sharding.transfers(old, new)
    assert [sum(f for (i, _), f in got.items() if i == k) for k in range(3)] == old
    assert [sum(f for (_, j), f in got.items() if j == k) for k in range(4)] == new
    assert sum(f for (i, j), f in got.items() if i != j) == sum(max(0, a - b) for a, b in zip(old, new, strict=False))


@pytest.mark.parametrize("law", sharding.LAWS)
def test_reshard(spark, law):
    d = documents(spark)
    got = sharding.reshard(d, 4, law, n_old=3).collect()
    t = dict(pairs_of(d))
    assert sorted(r["doc_id"] for r in got) == sorted(t)
    for r in got:
        b = (t[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(b) + 1, zlib.crc32(b), law)
    shards = {k: [r for r in got if r["shard"] == k] for k in range(4)}
    for rows in shards.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    n = [len(rows) for rows in shards.values()]
    if law == "rows":
        assert max(n) - min(n) <= 1
    if law == "key":
        assert all(r["grown_shard"] in (r["shard"], 4) for r in got)
        again = {r["doc_id"]: r["shard"] for r in sharding.reshard(d.where("doc_id % 2 = 0"), 4, law).collect()}
        assert all(again[r["doc_id"]] == r["shard"] for r in got if r["doc_id"] in again)
    else:
        assert all(r["grown_shard"] is None for r in got)
    assert sharding.reshard(empty(spark), 4, law).count() == 0


def stored(spark, rows, root, names="doc_id long, text string, row string, key int"):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows], names)
    whole = spark.createDataFrame([(i, t, "x", 1, o) for i, t, o in rows], names + ", shard int")
    whole.repartition(3).write.partitionBy("shard").parquet(root)
    return d


@pytest.mark.parametrize(("n_old", "n_new", "law"), [(2, 3, "rows"), (4, 2, "rows"), (3, 5, "bytes"), (3, 3, "bytes")])
def test_rewrite(spark, tmp_path, n_old, n_new, law):
    r = random.Random(n_old)
    rows = [(i if i % 5 else None, "\u00e9" * r.randrange(30), r.randrange(n_old)) for i in range(60)] + [(1, "x", 1), (1, None, 0)] + [(7, "alike", i % n_old) for i in range(40)]
    root = str(tmp_path / "shards")
    d = stored(spark, rows, root)
    own = lambda: sharding.read_store(spark, root, d.schema)
    before = {p.name: {f.name for f in p.iterdir()} for p in (tmp_path / "shards").iterdir() if p.is_dir()}
    placed = sharding.plan(Scratch(spark, "t"), own(), n_new, law, F.col("shard"), n_old)
    size = lambda t: len((t or "").encode()) + 1 if law == "bytes" else 1
    old = [sum(size(t) for _, t, o in rows if o == k) for k in range(n_old)]
    want = sharding.capacities(sum(old), n_new)
    moved = sum(x["c"] * (x["size"] if law == "bytes" else 1) for x in placed.where("old_shard <> shard").collect())
    least = sum(max(0, a - b) for a, b in itertools.zip_longest(old, want, fillvalue=0))
    largest = max(size(t) for _, t, _ in rows)
    assert abs(moved - least) <= n_old * (largest if law == "bytes" else 0)
    hit = sharding.rewrite(spark, root, d.schema, placed)
    back = own().collect()
    assert sorted(map(str, ((x["doc_id"], x["text"], x["row"], x["key"]) for x in back))) == sorted(str((i, t, "x", 1)) for i, t, _ in rows)
    got = [sum(size(x["text"]) for x in back if x["shard"] == k) for k in range(n_new)]
    assert all(abs(a - b) <= (2 if law == "bytes" else 0) for a, b in zip(got, want, strict=True)) and {x["shard"] for x in back} <= set(range(n_new))
    for k in range(n_old):  # shards that nothing enters or leaves keep their files; those that only take keep theirs too
        now = {f.name for f in (tmp_path / "shards" / f"shard={k}").iterdir()} if (tmp_path / "shards" / f"shard={k}").is_dir() else set()
        assert k in hit or now == before[f"shard={k}"]
    assert sharding.rewrite(spark, root, d.schema, sharding.plan(Scratch(spark, "t2"), own(), n_new, "rows", F.col("shard"), n_new).where("false")) == []


def test_reshard_near_equal_bytes(spark):
    """As equal as a brute-force fill, the largest to the least filled, makes them."""
    r = random.Random(3)
    rows = [(i, "y" * min(3000, int(10 * r.paretovariate(1)))) for i in range(700)]
    got = sharding.reshard(spark.createDataFrame(rows, "doc_id long, text string"), 5, "bytes", n_old=3).collect()
    have = [sum(x["size"] for x in got if x["shard"] == k) for k in range(5)]
    fill = [0] * 5
    for n in sorted((len(t) + 1 for _, t in rows), reverse=True):
        fill[fill.index(min(fill))] += n
    assert max(have) - min(have) <= max(fill) - min(fill) + 12


# -- mixing ------------------------------------------------------------------------------------------


def test_targets():
    got = mixing.targets({"b": 100, "a": 1, None: 50, "c": 10})
    assert got["a"] == 3 and got["c"] <= 30 and abs(sum(got.values()) - 161) < 1e-6


def test_mix(spark):
    r = random.Random(0)
    rows = [(i, " ".join(["w"] * r.choice((1, 3, 10, 40))), r.choice(["a", "b", "c", None])) for i in range(600)] + [(900, None, "a"), (901, "", "b"), (902, "w " * 4000, "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(d, mixing.targets).collect()
    sizes = {s: sum(len(WORD.findall(t or "")) for _, t, x in rows if x == s) for s in ("a", "b", "c", None)}
    want = mixing.targets(sizes)
    for s in sizes:
        assert abs(sum(r["size"] * r["n_copies"] for r in got if r["source"] == s) - want[s]) <= 1 + (4000 if s == "b" else 0)
    assert all(0 <= r["n_copies"] <= 3 for r in got) and len(got) == len(rows)
    assert sorted((r["doc_id"], r["n_copies"]) for r in got) == sorted((r["doc_id"], r["n_copies"]) for r in mixing.mix(d.repartition(7), mixing.targets).collect())
    assert mixing.mixed(d).columns == d.columns
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string"), mixing.targets).count() == 0


def test_balance_of_two_columns(spark):
    c = spark.createDataFrame([("a", "x", 10), ("a", "y", 30), ("b", "x", 20), ("b", "y", 40)], "s string, l string, size long")
    names, lam = mixing.balance(c, {"s": {"a": 60, "b": 40}, "l": {"x": 50, "y": 50}})
    rate = dict(zip(names, lam, strict=True))
    mass = {(r["s"], r["l"]): r["size"] * np.exp(rate[("s", r["s"])] + rate[("l", r["l"])]) for r in c.collect()}
    assert abs(mass["a", "x"] + mass["a", "y"] - 60) < 1e-4 and abs(mass["a", "x"] + mass["b", "x"] - 50) < 1e-4


# -- archives ----------------------------------------------------------------------------------------


def test_archive(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    html = ["<p>a</p>", "<p>a</p>", None, "", "é" * 3000, "<p>b</p>"] * 6
    url = [f"http://h{i % 4}.example.org:80/p?{i % 9}" for i in range(34)] + [None, "no url"]
    d = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(zip(url, html, strict=True))], "page_id long, url string, html string, digest string").repartition(4)
    s = Scratch(spark, "t")
    a = warc.Archive(spark, s.path("store"))
    a.write(d, s, file_bytes=2000)
    got = {int(r["page_id"]): r for r in a.lookup(d, with_payload=True).collect()}
    assert set(got) == set(range(36))
    for i, h in enumerate(html):
        b = (h or "").encode()
        first = min(j for j, g in enumerate(html) if (g or "") == (h or ""))
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"], r["url"]) == (len(b), warc.digest_of(b), url[i])
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == i else ("revisit", str(first)))
        assert r["payload"] is None if first != i else bytes(r["payload"]) == b
    odd = spark.createDataFrame([("None", "u:1", "p"), (None, "u:2", "q"), ("a <b>\r\n", "u:3", "p"), ("None", None, "\u00fc")], "page_id string, url string, html string")
    o = warc.Archive(spark, s.path("odd"))
    o.write(odd, s)
    assert sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in o.lookup(odd).collect()), key=str) == sorted([("None", "response", None), (None, "response", None), ("a <b>\r\n", "revisit", "None"), ("None", "response", None)], key=str)
    one = a.lookup(spark.createDataFrame([(url[5],), ("http://none.example.org/",)], "url string"))
    assert sorted(int(r["page_id"]) for r in one.collect()) == [i for i in range(36) if warc.url_key(url[i]) == warc.url_key(url[5])]
    assert warc.url_key("https://user@Www.Example.org:443/a?b#c") == "org,example,www)/a?b"
    e = warc.Archive(spark, s.path("empty"))
    e.write(spark.createDataFrame([], "page_id long, url string, html string"), s)
    assert e.lookup(d).count() == 0


# -- lines -------------------------------------------------------------------------------------------


def kept_lines(docs, min_docs=3):
    """The lines that stay, by a tree of dictionaries and lists."""
    masked = lambda line: ["<*>" if re.search("[0-9]", t) else t for t in WORD.findall(line)]
    where: dict = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            if m := tuple(masked(line)):
                where.setdefault(m, set()).add(i)
    leaves: dict = {}
    for m in where:
        leaves.setdefault((len(m), *m[:3]), []).append(m)
    template, docs_of = {}, {}
    for leaf, own in leaves.items():
        held: dict = {}
        for m in own:
            for place in enumerate(m):
                held[place] = held.get(place, 0) + min(2, len(where[m]))
        for m in own:
            constant = [held[place] >= min_docs for place in enumerate(m)]
            template[m] = leaf, tuple(t if c else "<*>" for t, c in zip(m, constant, strict=True)) if sum(constant) >= 0.7 * len(m) else m
            docs_of.setdefault(template[m], set()).update(where[m])
    least = lambda ids: min(ids, key=lambda i: (i is None, i or 0))
    out = []
    for i, text in docs:
        lines, kept = ([] if text is None else text.split("\n")), []
        for line in lines:
            m = tuple(masked(line))
            alike = m and len(where[m]) > 1 and i != least(where[m])
            recurs = m and len(docs_of[template[m]]) >= min_docs and i != least(docs_of[template[m]])
            if not alike and not recurs:
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_drop_lines(spark):
    from sparkronym.llm import lines

    t = {1: "Page 1 of the long report\nown words here only", 2: "Page 22 of the long report\nother text", 3: "first\n\nPage 3 of the long report", 4: None, 5: "", 6: "own words here only", 7: "Page 4 of the long paper\nlast"}
    d = spark.createDataFrame([(i, x, 1) for i, x in t.items()] + [(None, "Page 9 of the long report", 1)], "doc_id long, text string, pos int")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in lines.drop_lines(d).collect()}
    assert got == {1: (2, 0, t[1]), 2: (2, 1, "other text"), 3: (3, 1, "first\n"), 4: (0, 0, ""), 5: (1, 0, ""), 6: (1, 1, ""), 7: (2, 1, "last"), None: (1, 1, "")}
    assert lines.drop_lines(empty(spark)).count() == 0


def test_drop_lines_like_brute_force(spark):
    from sparkronym.llm import lines

    r = random.Random(7)
    say = lambda n: " ".join(r.choice(["a", "b", "c", "x1", "\tv\u00e4", "w\u3000w", "<*>"]) for _ in range(n))
    pool = [say(r.choice((1, 2, 4, 7, 12))) for _ in range(60)] + ["", "  ", "\r", "long " * 3000]
    rows = [(i % 70 if i % 9 else None, "\n".join(r.choice(pool) if r.random() < 0.5 else say(r.choice((1, 3, 6, 10))) for _ in range(r.randrange(8)))) for i in range(90)]
    rows += rows[:5] + [(500, None), (501, ""), (502, "\n\n"), (None, None)]
    d = spark.createDataFrame([(i, x, 0, 0) for i, x in rows], "doc_id long, text string, of int, gone int").repartition(3)
    got = sorted(((x["doc_id"], x["n_lines"], x["n_dropped"], x["kept_text"]) for x in lines.drop_lines(d).collect()), key=str)
    assert got == kept_lines(rows)
    assert sum(x[2] for x in got) > 50


def test_a_large_leaf(spark):
    """Thousands of values of one field make one template."""
    from sparkronym.llm import lines

    d = spark.createDataFrame([(i, f"Written by the user {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]} for the club") for i in range(600)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_dropped"] for r in lines.drop_lines(d).collect()}
    assert got == {i: int(i > 0) for i in range(600)}


@pytest.mark.parametrize("seed", range(3))
def test_templates_do_not_depend_on_how_lines_are_dealt(spark, seed):
    """One leaf of many unlike lines: the same lines go however many tasks there are and in whatever order rows come."""
    from sparkronym.llm import lines

    r = random.Random(seed)
    say = lambda: "one same start " + " ".join(r.choice(["this", "that"]) if r.random() < 0.85 else "".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(6))
    rows = [(i, say()) for i in range(400)]
    want = kept_lines(rows)
    assert 20 < sum(x[2] for x in want) < 380
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 4, 9):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            d = spark.createDataFrame(r.sample(rows, len(rows)), "doc_id long, text string").repartition(parts)
            assert sorted(((x["doc_id"], x["n_lines"], x["n_dropped"], x["kept_text"]) for x in lines.drop_lines(d).collect()), key=str) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


class Dies(BaseException):
    """The driver's end."""


@pytest.mark.parametrize("kind", [OSError, Dies])
@pytest.mark.parametrize("step", [0, 1, 2, 3])
def test_rewrite_loses_nothing_when_renames_fail(spark, tmp_path, monkeypatch, step, kind):
    """A rename fails half-way, or the driver ends there before it can undo anything: all rows are there, or come back."""
    rows = [(i if i % 9 else None, f"text {i} " * (i % 7)) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    root = f"file://{tmp_path}/store"
    sharding.store(d, root, sharding.dealt_by_id("doc_id", 4))
    own = lambda: sharding.read_store(spark, root, d.schema)
    before = sorted(map(str, own().collect()))
    placed = sharding.plan(Scratch(spark, "t"), own(), 3, "rows", F.col("shard"), 4)
    rename, undo, calls = sharding._Files.rename, sharding._undo, []

    def failing(self, old, new):
        calls.append(new)
        if len(calls) == step + 1:
            raise kind("no more")
        rename(self, old, new)

    def no_undo(*args):
        raise OSError("not even that")

    monkeypatch.setattr(sharding._Files, "rename", failing)
    if kind is Dies:
        monkeypatch.setattr(sharding, "_undo", no_undo)
    with pytest.raises(OSError):
        sharding.rewrite(spark, root, d.schema, placed)
    monkeypatch.undo()
    if kind is Dies:
        assert sharding._undo is undo and sharding.recover(spark, root) == 1
    assert sorted(map(str, own().collect())) == before and sharding.recover(spark, root) == 0
    sharding.rewrite(spark, root, d.schema, placed)
    assert sorted(str((r["doc_id"], r["text"])) for r in own().collect()) == sorted(map(str, rows))
