"""Operators on pairs, archives and vectors against brute force on small tables."""

import base64
import collections
import gzip
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from waymark.llm import line_dedup, linking, near_dup, vector_search, warc
from waymark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def edited(words, rng, share):
    return [rng.choice("xyzuvw") + str(rng.random()) if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    base = [[f"w{rng.randrange(900)}" for _ in range(60)] for _ in range(4)]
    rows = [" ".join(edited(rng.choice(base), rng, rng.choice([0, 0.03, 0.08]))) for _ in range(160)]
    rows += [rows[0].upper(), rows[0], None, "", " \n ", "alone", "Alone", "two words", "a " * 4000, "a " * 4001]
    return list(enumerate(rows, 1)) + [(5, rows[90])]


def test_components_of_paths_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(10, 40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    want = groups({x for p in links if None not in p and p[0] != p[1] for x in p}, [p for p in links if None not in p and p[0] != p[1]])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_equal_brute_force(spark, texts, monkeypatch):
    monkeypatch.setattr(linking, "SMALL", 8)
    docs = spark.createDataFrame([(i, t, "c", 0) for i, t in texts], "doc_id long, text string, component_id string, node int")
    got = near_dup.link_components(docs, 2).collect()
    sets = []
    for _, t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append(frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)] if w else []))
    n = len(texts)
    pairs = [(i, j) for i in range(n) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = groups(range(n), pairs)
    least = collections.defaultdict(lambda: 10**9)
    for i, (doc, _) in enumerate(texts):
        least[root[i]] = min(least[root[i]], doc)
    want = sorted((doc, len(sets[i]), least[root[i]], doc == least[root[i]]) for i, (doc, _) in enumerate(texts))
    assert sorted(map(tuple, got)) == want
    assert near_dup.link_components(docs.limit(0), 2).count() == 0


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(0)
    key = rng.integers(0, 2**63, 900).astype(np.uint64)
    one, two = key[:800], key[100:]
    sig = near_dup.superminhash(np.repeat([0, 1, 2], [800, 800, 3]), np.concatenate([one, two, key[:3]]), 4, 280)
    assert abs((sig[0] == sig[1]).mean() - 700 / 900) < 0.09
    assert (sig[2] != np.iinfo(np.uint64).max).all() and (sig[3] == np.iinfo(np.uint64).max).all()


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefghij klm") for _ in range(90)).strip() for _ in range(6)]
    rows = []
    for i in range(60):
        lines = [x.upper() if rng.random() < 0.2 else x[:30] + rng.choice(["", "q", "zz"]) + x[30:] for x in rng.sample(base, 2)]
        rows.append((i, "\n".join([*lines, "short", f"a line of its own number {i * 7919} {rng.random()}"])))
    rows += [(60, None), (61, ""), (62, rows[3][1]), (62, rows[3][1]), (None, base[0])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, places int")
    got = line_dedup.dedup_lines(docs).collect()

    def shingles(x):
        return {x[i:i + 8] for i in range(max(1, len(x) - 7))}

    seen = sorted({(i is not None, i or 0, k, x.strip().lower()) for i, t in rows for k, x in enumerate((t or "").split("\n")) if len(x.strip()) >= 20})
    keys = sorted({x[3] for x in seen})
    sets = {k: shingles(k) for k in keys}
    root = groups(keys, [(a, b) for a in keys for b in keys if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    kept = {}
    for x in seen:
        kept.setdefault(root[x[3]], x)
    for row in got:
        if row.text is None:
            assert row.n_dropped == 0
            continue
        source = next(t for i, t in rows if i == row.doc_id)
        want = [x for k, x in enumerate(source.split("\n")) if len(x.strip()) < 20 or kept[root[x.strip().lower()]][:3] == (row.doc_id is not None, row.doc_id or 0, k)]
        assert row.text == "\n".join(want) and row.places == 1
    assert len(got) == len(rows) and line_dedup.dedup_lines(docs.limit(0)).count() == 0


@pytest.mark.parametrize("stage", ["query", "pipeline"])
def test_short_lines_that_repeat_go_too(spark, tmp_path, stage):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from waymark.llm import queries

    rows = [(1, "Menu\n}\n\nRead more ...\nshare"), (2, " menu\n}\n\nread more ..."), (3, "menus\n\n \nRead more .."), (4, "}"), (5, "中\n中")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    if stage == "query":
        got = {r.doc_id: (r.n_lines, r.n_dropped) for r in queries.op9_line_dedup(spark, str(tmp_path)).collect()}
        assert got == {1: (5, 0), 2: (4, 3), 3: (4, 1), 4: (1, 1), 5: (2, 1)}
    else:
        docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
        got = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}
        assert got == {1: rows[0][1], 2: "", 3: "menus\n\n ", 4: "", 5: "中"}


@pytest.mark.parametrize("shared, one, two", [(13, 0, 3), (12, 0, 3), (16, 2, 2), (12, 1, 1)])
def test_bands_of_short_lines_lose_no_pair(shared, one, two):
    """Lines of 20 to 40 characters as random characters; edits at the ends give the sets."""
    rng = np.random.default_rng(shared * 100 + one * 10 + two)
    pick = lambda n: "".join(map(chr, rng.integers(0x4E00, 0x9000, n)))
    left, right = [], []
    for _ in range(4000):
        middle = pick(shared + 7)
        left.append(middle + pick(one))
        right.append(pick(two) + middle)
    a, b = (line_dedup.band_hashes(line_dedup.bin_minima(pa.array(x))) for x in (left, right))
    assert (a == b).any(1).all()


def test_shingle_bits_differ_in_no_more_places_than_the_sets():
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    keys = [text(rng.choice([8, 9, 30, 400, 3000])) for _ in range(40)]
    keys += [k[:5] + "x" + k[6:] for k in keys]
    bits = line_dedup.shingle_bits(*line_dedup.rolling(pa.array(keys)), len(keys))
    assert bits.shape == (80, line_dedup.WORDS) and len(np.unique(bits[:, -1])) > 1
    sets = [{k[i:i + 8] for i in range(len(k) - 7)} for k in keys]
    for i in range(80):
        for j in range(i):
            apart = sum(int(x).bit_count() for x in (bits[i] ^ bits[j]).view(np.uint64))
            assert apart <= len(sets[i] ^ sets[j])


def test_bands_of_the_same_nodes_are_told_once():
    hashes = {11: [5, -7, 5], 12: [-7, 5], 13: [9], 14: [9, 5, -7], 15: [3, 4]}
    rows = [(h, n) for h, nodes in hashes.items() for n in nodes]
    cuts = np.array([0, 1, 4, len(rows)])
    one = line_dedup._blobs(np.array([h for h, _ in rows], "<u8").view(np.uint8).reshape(-1, 8)[:, :line_dedup.KEY], cuts)
    two = line_dedup._blobs(np.array([n for _, n in rows], "<i8"), cuts)
    found = collections.defaultdict(set)
    for r in line_dedup.same_bands(pa.table({"hashes": one, "nodes": two})).to_pylist():
        found[r["key"]].add((r["node"], r["p1"], r["p2"]))
    want = [{(n, min(x), max(x)) for n in x} for x in ([5, -7], [3, 4], [9, 5, -7])]
    assert len(found) == 3 and all(x in want for x in found.values())


def test_bands_travel_in_packed_rows(spark):
    """A row for each batch and group of hashes, not one for each line and band."""
    rows = [(i, "\n".join(f"line {j} of {i} {j * 7919 % 1009}" for j in range(40))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) content", "text")
    lines = line_dedup.occurrences(docs, 1)
    assert lines.count() == 2000 and {"t0", "t1"} < set(lines.columns)
    members = line_dedup.shared_bands(lines.where("line is not null"), 2000)
    assert members.count() == members.distinct().count() and members.where("p1 >= p2").count() == 0


def test_lone_pairs_of_short_lines_are_linked(spark):
    """Nothing but the pair shares its bands, so no third line can stand in for a lost link."""
    rng = np.random.default_rng(4)
    pick = lambda n: "".join(map(chr, rng.integers(0x4E00, 0x9000, n)))
    rows = []
    for i in range(3000):
        middle = pick(20)
        rows += [(2 * i, middle), (2 * i + 1, pick(3) + middle)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = line_dedup.dedup_lines(docs, line_dedup.NOT_BLANK).where("n_dropped = 1").select("doc_id").collect()
    assert sorted(r.doc_id for r in gone) == list(range(1, 6000, 2))


def test_archives_read_back(spark):
    rows = [(i, f"http://x/{i} y\r\n", f"<p>{i % 3}é</p>\r\n\r\nWARC/1.1") for i in range(30)]
    rows += [(40, None, None), (41, "u", ""), (None, "u", "<p>0é</p>\r\n\r\nWARC/1.1"), (50, "u", "z" * 300_000)]
    pages = spark.createDataFrame([(i, u, h, "c") for i, u, h in rows], "page_id long, url string, html string, payload string")
    got = {r.page_id: r for r in warc.archive_digest(pages).collect()}
    assert len(got) == len(rows)
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    for i, _, h in rows:
        data, row = (h or "").encode(), got[i]
        assert (row.payload_bytes, row.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        own = last[h or ""] == i
        assert (row.record_type, row.refers_to) == (("response", None) if own else ("revisit", last[h or ""]))
    assert warc.archive_digest(pages.limit(0)).count() == 0


def test_normalised_members_stand_alone():
    raw = [warc.record(i, "u", b"x" * (70_000 * i)) for i in range(4)]
    for stream in (gzip.compress(b"".join(raw)), b"".join(map(gzip.compress, raw))):
        data, index = warc.normalise(stream)
        assert [gzip.decompress(data[e["offset"]:e["offset"] + e["length"]]) for e in index] == raw
    with pytest.raises(ValueError):
        warc.normalise(gzip.compress(b"".join(raw)[:-9]))


def test_nearest_vectors(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    odd = [(100_000, None), (100_050, [0.0] * 64), (100_100, [None] + [1.0] * 63), (100_150, [float("nan")] * 64), (100_200, [1.0] * 3)]
    vectors = table.select("vec_id", "embedding").unionByName(spark.createDataFrame(odd, "vec_id long, embedding array<float>"))
    vectors = vectors.unionByName(table.limit(40).selectExpr("vec_id + 200000 AS vec_id", "embedding"))
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in vectors.collect() if r.vec_id < 100_000 or r.vec_id >= 200_000]
    ids, x = np.array([r[0] for r in rows]), np.stack([r[1] for r in rows])
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    got = collections.defaultdict(list)
    for r in sorted(vector_search.search(vectors, lists=8).collect()):
        got[r.query_id].append((r.vec_id, r.score))
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[q]
        best = [i for i in np.lexsort((ids, -np.round(score, 12))) if ids[i] != ids[q]][:5]
        assert len(got[ids[q]]) == 5
        for vec, s in got[ids[q]]:
            assert s == pytest.approx(score[ids == vec][0], abs=1e-12)
        hits, total = hits + len({ids[i] for i in best} & {v for v, _ in got[ids[q]]}), total + 5
    assert hits / total >= 0.9
    assert vector_search.search(vectors.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in sorted(vector_search.search(few).collect())] == [1, 2]


def test_pipeline_stages(spark, small):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = spark.createDataFrame(stage(spark, out, small).collect(), docs.schema)
        assert out.columns == docs.columns, name
    tokens = corpus_pipeline.STAGES[4][1](spark, out, small).collect()
    assert len(tokens) == out.count() > 0 and all(len(r.tokens) == r.n_tokens for r in tokens)


def test_near_copies_keep_one_row_per_group(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    rows = [
        (None, a, 1), (None, b, 1), (None, b + " x", 1), (None, None, 1), (None, "", 1),  # texts without an id
        (3, c, 1), (5, c + " x", 1), (5, d, 1),  # an id whose one text is a copy
        (7, e, 1), (7, e, 1), (7, e, 2), (7, e + " x", 1), (None, e, 1),  # equal rows, and a near copy under one id
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = sorted(map(str, map(tuple, corpus_pipeline.drop_near_copies(spark, docs, "").collect())))
    one_of_b = [x for x in rows[1:3] if str(x) in got]
    one_of_e = [x for x in (rows[8], rows[11]) if str(x) in got]
    assert len(one_of_b) == len(one_of_e) == 1
    assert got == sorted(map(str, [rows[0], *one_of_b, *rows[3:6], rows[7], *one_of_e]))
    again = corpus_pipeline.drop_near_copies(spark, docs.repartition(3), "").collect()
    assert sorted(map(str, map(tuple, again))) == got
