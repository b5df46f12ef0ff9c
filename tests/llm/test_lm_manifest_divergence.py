"""Scores, manifests and divergences against brute force, on nulls, empty and long texts, ties, repeats, an empty table and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkronym.llm import divergence, lm, manifest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def rows():
    r = random.Random(3)
    say = lambda n: " ".join(r.choice("The the of Straße ÉTÉ été naïve x1 it's A-b 7 你好 zeta".split() + [f"w{i}" for i in range(30)]) for _ in range(n))
    text = [None, "", " \t", "a", say(3000), *(say(r.randrange(1, 60)) for _ in range(90))]
    out = [(i if i % 17 else None, t, [None, "", "en", "de"][i % 4], [None, "s1", "s10", "S2", "é"][i * 7 % 5], None if i % 6 == 0 else len(t or "")) for i, t in enumerate(text)]
    out += [(4, "again", "en", "s1", 5)] * 3 + [(4, "Other", "en", "s1", 5), (None, None, None, None, None)]
    return out + [(1000 + i, say(20), "en", "hot", 7) for i in range(400)]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    own = "id group leaf other _idx _total block node slice part h b n v term by chunk _at _key c1 x1 s0 p value rank item".split()
    return plain.select("*", *(F.lit(k).alias(c) for k, c in enumerate(own))).cache()


def split(i):
    c = None if i is None else zlib.crc32(str(i).encode())
    return (False, False) if c is None else (c % 10 == 0, c // 10 % 4 == 0)


def model(texts, order):
    """Scores by plain dictionaries."""
    toks = [[*WORD.findall((t or "").translate(LOWER)), None] for _, t in texts]
    part = [2 if h else 1 if tune else 0 for h, tune in (split(i) for i, _ in texts)]

    def grams(seq, k):
        s = ["<s>"] * (order - 1) + seq
        return [tuple(map(str, s[j - k + 1 : j + 1])) for j in range(order - 1, len(s))]

    def counts(want):
        c = [Counter() for _ in range(order + 1)]
        for seq, p in zip(toks, part, strict=True):
            if p in want:
                for k in range(1, order + 1):
                    c[k].update(grams(seq, k))
        return c, sum(p in want for p in part)

    def facts(c, n, seq):
        per = [grams(seq, k) for k in range(1, order + 1)]
        for j in range(len(seq)):
            yield [(c[k][per[k - 1][j]], sum(c[1].values()) if k == 1 else n if j == 0 else c[k - 1][per[k - 2][j - 1]]) for k in range(1, order + 1)]

    def bucket(k, x):
        return 1 if k == 1 else x.bit_length()

    rest, n = counts((0,))
    events = [f for seq, p in zip(toks, part, strict=True) if p == 1 for f in facts(rest, n, seq)]
    weight, last = defaultdict(lambda: 0.5), None
    for _ in range(lm.STEPS):
        chosen, passed, fit = Counter(), Counter(), 0.0
        for f in events:
            parts, p = [1 / (len(rest[1]) + 1)], 0
            for k, (c, x) in enumerate(f, 1):
                own = weight[k, bucket(k, x)] if x else 0
                parts = [y * (1 - own) for y in parts] + [own * c / x if x else 0]
            p = sum(parts)
            fit += math.log(p)
            for k, (_, x) in enumerate(f, 1):
                if x:
                    chosen[k, bucket(k, x)] += parts[k] / p
                    passed[k, bucket(k, x)] += sum(parts[:k]) / p
        if not events:
            break
        for key in chosen:
            weight[key] = (chosen[key] + 1) / (chosen[key] + passed[key] + 2)
        if last is not None and fit - last < lm.GAIN * len(events):
            break
        last = fit
    c, n = counts((0, 1))
    total = sum(c[1].values())
    out = []
    for (i, _), seq, p in zip(texts, toks, part, strict=True):
        score = base = known = 0
        for f in facts(c, n, seq):
            q = 1 / (len(c[1]) + 1)
            for k, (got, x) in enumerate(f, 1):
                if x:
                    own = weight[k, bucket(k, x)]
                    q = own * got / x + (1 - own) * q
            score += math.log10(q)
            base += math.log10((f[0][0] + 0.1) / (total + 0.1 * (len(c[1]) + 1)))
            known += f[0][0] > 0
        out.append((str(i), p == 2, len(seq), known, total, round(base, 6), round(score, 6)))
    return sorted(out)


def scored(df, order, held=True):
    crc, rest = F.crc32(F.col("doc_id").cast("string")), F.expr("crc32(cast(doc_id as string)) div 10")
    out = lm.scores(df, crc % 10 == 0 if held else F.lit(True), rest % 4 == 0, order=order, slice_bytes=2000).collect()
    return sorted((str(r["id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in out)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_like_dictionaries(docs, order):
    got, want = scored(docs, order), model([(r[0], r[1]) for r in rows()], order)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in got], [x[5:] for x in want], atol=2e-3, rtol=1e-6)


def test_probabilities_sum_to_one(spark):
    """Of one-word texts after the same start: all known tokens and an unknown one."""
    d = spark.createDataFrame([(1, "a b a c"), (2, "b a b"), (3, "c")], "doc_id long, text string")
    asked = ["a", "b", "c", "", "unknown"]
    both = d.unionByName(spark.createDataFrame([(10 + i, t) for i, t in enumerate(asked)], d.schema))
    got = {r["id"]: r["score"] for r in lm.scores(both, F.col("doc_id") >= 10, F.col("doc_id") == 3, order=1).collect()}
    end = 10 ** got[13]
    assert abs(sum(10 ** got[k] / end for k in (10, 11, 12, 14)) + end - 1) < 1e-9


def test_scores_of_nothing(spark, docs):
    assert lm.scores(docs.where("false"), F.lit(False), F.lit(False)).count() == 0
    assert {x[5:] for x in scored(docs.limit(5), 2, held=False)} == {(0.0, 0.0)}  # nothing to learn from


def test_packing():
    for x in ([], [0], [5, 0, 255], [256, 1], [2**40, 3], [2**63 + 1, 0]):
        assert lm.unpack(lm.pack(np.array(x, np.uint64)), len(x)).tolist() == x


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def trees(data):
    """The manifest by plain lists."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    made = lambda i, t, lang, s, n: H(enc(i), enc(s), enc(lang), enc(n), enc(t))
    groups = defaultdict(list)
    for i, t, lang, s, n in data:
        tampered = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        groups[s].append(((i is not None, i or 0), made(i, t, lang, s, n), made(i, t and t.translate(LOWER), lang, s, n) if tampered else None, i))

    def up(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
        return out

    def steps(tree, k):
        for level in tree[:-1]:
            yield level[k - k % 16 : k], level[k + 1 : k - k % 16 + 16]
            k //= 16

    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: up([x[1] for x in sorted(groups[s], key=lambda x: x[:2])]) for s in names}
    top = up([own[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for j, (_, leaf, other, i) in enumerate(sorted(groups[s], key=lambda x: x[:2])):
            node, proof = other or leaf, []
            for a, b in [*steps(own[s], j), *steps(top, k)]:
                node, proof = H(*a, node, *b), [*proof, *a, *b]
            out.append((str(i), leaf, own[s][-1][0], top[-1][0], H(*proof), node, node == top[-1][0]))
    return sorted(out)


COLUMNS = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize(("least", "top"), [(1, 1000), (1, 1), (2, 4096), (3, 4096)])
def test_manifest_like_lists(docs, least, top):
    """However deep the blocks are, several blocks in a group or one."""
    got = manifest.manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 0, least_levels=least, top=top).collect()
    assert sorted((str(r["doc_id"]), *(r[c] for c in COLUMNS)) for r in got) == trees(rows())


def test_manifest_of_few_rows(spark):
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    one = [(7, "Ab", "en", "s", 2)]
    for data in (one, [*one, (8, "x", "en", "t", 1)], [(k, None, None, None, None) for k in range(17)]):
        got = manifest.manifest(spark.createDataFrame(data, cols)).collect()
        assert all(r["verified"] for r in got) and {(r["root"], r["proof_sha256"]) for r in got} == {(x[3], x[4]) for x in trees(data)}
    assert manifest.manifest(spark.createDataFrame([], cols)).count() == 0


def divergences(data, ranks=200):
    docs_of, count, occur = defaultdict(set), Counter(), set()
    for k, (_, t, lang, s, _) in enumerate(data):
        lang, s = lang or "", s or ""
        occur.add((lang, s))
        for term in TERM.findall((t or "").translate(LOWER)):
            docs_of[lang, term].add(k)
            count[lang, s, term] += 1
    out = []
    for lang in {x for x, _ in occur}:
        kept = [t for (g, t), d in docs_of.items() if g == lang and len(d) >= 3]
        sources = [s for g, s in occur if g == lang]
        own = {s: {t: count[lang, s, t] for t in kept} for s in sources}
        whole = {t: sum(own[s][t] for s in sources) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (x + 1) // (sum(c.values()) + len(c)) for t, x in c.items()}
        p, q = {s: share(own[s]) for s in sources}, share(whole)
        for s in sources:
            pair = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            term = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for name, found, most in (("pair", pair, None), ("term", term, ranks)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, name, item, v, k) for k, (v, item) in enumerate(found[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("cells", [1, 40, 1 << 22])
def test_divergence_like_dictionaries(docs, cells):
    """However many terms a chunk has."""
    got = divergence.audit(docs, cells=cells, ranks=9).collect()
    assert sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got) == divergences(rows(), 9)


def test_divergence_of_few_rows(spark):
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    for data in ([], [(1, None, None, None, 0)], [(1, "a", "en", "s", 1), (2, "b", "en", "t", 1)]):
        got = divergence.audit(spark.createDataFrame(data, cols)).collect()
        assert sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got) == divergences(data)


def test_shares_are_exact():
    r = random.Random(1)
    for _ in range(300):
        whole = r.randrange(1, 9 * 10**15)
        count = r.randrange(0, whole)
        assert divergence.shares(np.array([count]), whole).tolist() == [1 + 10**9 * (count + 1) // whole]


def test_spans_of_one_hash_are_told_apart(monkeypatch):
    data = np.frombuffer(b"aa bb aa cc", np.uint8)
    starts, ends = np.array([0, 3, 6, 9]), np.array([2, 5, 8, 11])
    hashes = divergence.w.hashes
    monkeypatch.setattr(divergence.w, "hashes", lambda d, s, e, seed=0: hashes(d, s, e, seed) if seed else np.zeros(len(s), np.uint64))
    code, where = divergence.distinct(data, starts, ends)
    assert len(where) == 3 and code[0] == code[2] and len(set(code.tolist())) == 3
