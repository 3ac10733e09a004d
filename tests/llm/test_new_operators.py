"""Substring dedup, importance resampling and the source audit against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from waymark.llm import importance, source_audit, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# ---------------------------------------------------------------- substring dedup

def brute_repeats(rows, width):
    words = [WORD.findall(t or "") for _, t in rows]
    rank = [-1 if i is None else i for i, _ in rows]
    least = {}
    for r, w in zip(rank, words):
        for k in range(len(w) - width + 1):
            g = tuple(w[k:k + width])
            least[g] = min(least.get(g, r), r)
    out = []
    for (i, _), r, w in zip(rows, rank, words):
        gone = set()
        for k in range(len(w) - width + 1):
            if least[tuple(w[k:k + width])] < r:
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(5)
    pick = lambda n, names=400: [f"w{rng.randrange(names)}" for _ in range(n)]
    shared = [pick(n) for n in (12, 13, 14, 26, 60)]
    rows = []
    for i in range(120):
        parts = [pick(rng.randrange(1, 30))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            parts += [p[rng.randrange(3):len(p) - rng.randrange(3)], pick(rng.randrange(6))]
        rows.append((i, "\n".join(" \t".join(p) for p in parts)))
    rows += [(200, rows[7][1]), (200, rows[7][1]), (3, rows[9][1]), (None, rows[11][1]), (None, rows[11][1])]
    rows += [(201, None), (202, ""), (203, " \n\t "), (204, "a " * 3000), (205, "a " * 40), (206, "ab" * 90_000), (207, "b a " * 20)]
    rows += [(208, " ".join(pick(4, 2) * 30)), (209, " ".join(pick(60, 2)))]
    return rows


@pytest.mark.parametrize("width", [13, 6, 1])
def test_repeats_equal_brute_force(spark, passages, width, monkeypatch):
    monkeypatch.setattr(substring_dedup, "ENTRY", 1)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in passages], "doc_id int, text string, group string, words int").repartition(5)
    got = substring_dedup.repeats(docs, width).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got) == sorted((str(a), b, c, d) for a, b, c, d in brute_repeats(passages, width))
    assert all(sum(s.end - s["first"] for s in r.spans) == r.n_removed for r in got)


def test_repeats_with_small_groups_and_few_buckets(spark, passages, monkeypatch):
    """Chunks of a few documents, several to a group."""
    cut = substring_dedup.slices
    monkeypatch.setattr(substring_dedup, "slices", lambda batches, column: cut(batches, column, 2000))
    monkeypatch.setattr(substring_dedup, "ENTRY", 40)
    docs = spark.createDataFrame(passages, "doc_id long, text string")
    got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.repeats(docs).collect()]
    assert sorted(got) == sorted((str(a), b, c, d) for a, b, c, d in brute_repeats(passages, 13))


def test_spans_are_maximal(spark):
    common = " ".join(f"c{i}" for i in range(40))
    rows = [(1, f"x y {common} z"), (2, f"{common} q r s {common}"), (3, "short " + common[:30])]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [(0, 40), (43, 83)], 3: []}


def test_repeats_of_an_empty_table(spark):
    assert substring_dedup.repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---------------------------------------------------------------- importance resampling

def test_crc_of_joined_strings():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (bytes(rng.randrange(256) for _ in range(rng.randrange(70))) for _ in range(2))
        got = importance.crc_join(*(np.array([x]) for x in (zlib.crc32(a), zlib.crc32(b), len(b))))
        assert got[0] == zlib.crc32(a + b)


TEXTS = ["The cat, the CATé sat", None, "", " ,. ", "a", "ab a b ab", "\x01 x\x01y", "中文 mixed É", "x" * 100_000, "one two " * 5000]


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_features_equal_brute_force(longest):
    row, bucket, n_words = importance.features(TEXTS, longest)
    want, counts = collections.Counter(), []
    for i, t in enumerate(TEXTS):
        w = TERM.findall(lowered(t))
        counts.append(len(w))
        want.update((i, zlib.crc32(" ".join(w[k:k + n]).encode()) % 10000) for n in range(1, longest + 1) for k in range(len(w) - n + 1))
    assert collections.Counter(zip(row.tolist(), bucket.tolist())) == want
    assert n_words.tolist() == counts


def brute_resample(rows, target, longest, least, percent):
    def runs(t):
        w = TERM.findall(lowered(t))
        return [" ".join(w[k:k + n]) for n in range(1, longest + 1) for k in range(len(w) - n + 1)], len(w)

    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = collections.Counter(bucket(f) for _, t in rows for f in runs(t)[0])
    t_ = collections.Counter(bucket(f) for t in target for f in runs(t)[0])
    sa, ta = sum(s.values()), sum(t_.values())
    gain = lambda b: math.floor(1000 * math.log((t_[b] + 1) * (sa + 10000) / ((s[b] + 1) * (ta + 10000))))
    out = []
    for i, t in rows:
        f, n = runs(t)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    able = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    rank = {}
    for k, x in enumerate(able[:percent * len(able) // 100], 1):
        rank.setdefault((x[0], x[3]), []).append(k)
    return out, rank


@pytest.mark.parametrize("longest, least, percent", [(1, 20, 10), (2, 3, 55), (1, 0, 100)])
def test_resampling_equals_brute_force(spark, longest, least, percent):
    rng = random.Random(7)
    rows = [(i, " ".join(f"t{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randrange(60)))) for i in range(300)]
    rows += [(5, rows[6][1]), (5, rows[6][1]), (None, rows[8][1]), *((400 + i, t) for i, t in enumerate(TEXTS))]
    target = ["t1 t2 T3 t9", None, "t4 t4 t5 only here"]
    docs = spark.createDataFrame([(i, t, 0, 0.0) for i, t in rows], "doc_id int, text string, score int, rank double").repartition(3)
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), longest, least_words=least, percent=percent).collect()
    want, rank = brute_resample(rows, target, longest, least, percent)
    assert sorted(map(str, ((r.doc_id, r.n_features, r.weight, r.score) for r in got))) == sorted(str(tuple(x[:4])) for x in want)
    drawn = collections.defaultdict(list)
    for r in got:
        if r["rank"] is not None:
            drawn[(r.doc_id, r.score)].append(r["rank"])
    assert {k: sorted(v) for k, v in drawn.items()} == rank


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none).count() == 0
    one = importance.resample(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), none, percent=100, least_words=1).collect()
    assert [(r.n_features, r["rank"]) for r in one] == [(2, 1)]


# ---------------------------------------------------------------- source audit

def brute_audit(rows, least, most):
    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        df = collections.Counter(t for r in mine for t in set(LETTERS.findall(lowered(r[2]))))
        kept = {t for t, n in df.items() if n >= least}
        counts = {s: collections.Counter() for s in {r[1] for r in mine}}
        for _, s, t in mine:
            counts[s].update(x for x in LETTERS.findall(lowered(t)) if x in kept)

        def share(c):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q = share(sum(counts.values(), collections.Counter()))
        p = {s: share(c) for s, c in counts.items()}
        for s in counts:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, top in (("pair", pairs, None), ("term", terms, most)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(found[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("tile, shard, gathered", [(256, 2048, 400_000), (2, 5, 10)])
def test_audit_equals_brute_force(spark, tile, shard, gathered, monkeypatch):
    for name, value in (("TILE", tile), ("SHARD", shard), ("GATHERED", gathered)):
        monkeypatch.setattr(source_audit, name, value)
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", "d", "e", None])
        rows.append((lang, source, " ".join(f"{rng.choice('ABcdé')}{'xyz'[int(rng.random() ** 2 * 3)] * rng.randrange(1, 4)}7" for _ in range(rng.randrange(30)))))
    rows += [("fr", "lone", None), ("it", "x", "rare words"), ("it", "y", ""), ("de", "new", " 12 "), ("en", "a", "q " * 30_000), rows[0], rows[0]]
    docs = spark.createDataFrame([(*r, 1, "p") for r in rows], "lang string, source string, text string, n int, part string").repartition(4)
    got = source_audit.divergences(docs, least=8, most_terms=6).collect()
    assert sorted(tuple(r) for r in got) == brute_audit(rows, 8, 6)
    assert source_audit.divergences(docs.limit(0)).count() == 0


def test_shares_beyond_64_bits(spark):
    huge = spark.createDataFrame([(3 * 10**12, 10**13, 7)], "n long, group_n long, v long")
    assert huge.select(source_audit._share("n", "group_n")).head()[0] == 1 + 10**9 * (3 * 10**12 + 5) // (10**13 + 35)
