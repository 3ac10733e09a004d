"""Text operators against plain Python on small tables with nulls, blanks, ties and repeats."""

import re
import zlib

import numpy as np
import pytest

from waymark.llm import license_scan, mixing, quality_classifier, quality_rules, sentence_pieces, token_files
from waymark.llm.queries import PIECES, TOKENIZER, vocabulary

TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two three one two three\nx\nx\n\nx"), (5, "A  B　C ##"),
    (6, "Licensed under the Apache License, Version 2.0; CC BY and cc   by. MIT License"), (7, "word " * 3000),
    (7, "word " * 3000), (8, "it's  a\n\n\ttab 'S.it <|endoftext|> 12 3.4,5 é. 中☃ a.b!?"), (None, "no id"),
]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "src" if (i or 0) % 2 else None, "x", 1.0) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kept string, size double")


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 0), (6, 1, 1), (4, 1, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")


def key(row):
    return (row.doc_id is None, row.doc_id or 0, str(row))


def test_quality_rules_counts(docs, labels, none):
    got = sorted(quality_rules.quality_rules(docs, labels).collect(), key=key)
    assert len(got) == len(TEXTS)
    for row, (i, text) in zip(got, sorted(TEXTS, key=lambda x: (x[0] is None, x[0] or 0))):
        words = WORD.findall(text or "")
        triples = list(zip(words, words[1:], words[2:]))
        many = {k + j for k, t in enumerate(triples) if triples.count(t) > 1 for j in range(3)} if len(words) < 100 else range(len(words))
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        assert row.doc_id == i and row.n_words == len(words) and row.word_chars == sum(map(len, words))
        assert row.n_repeat_words == len(many) and row.n_dup_lines == len(lines) - len(set(lines))
        assert row.n_symbols == len(re.findall(r"[#*$%&|<>]", text or ""))
        assert row.base_failed == (len(words) < 50 or 100 * len(many) > 50 * len(words)) and not (row.base_failed and row.kept)
    assert quality_rules.quality_rules(none, labels).count() == 0


def test_log_ratio_is_that_of_the_counts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c")], "doc_id long, text string")
    counts = quality_rules.ngram_counts(docs, docs.where("doc_id = 1"), 64).collect()
    assert sum(r.raw for r in counts) == 6 and sum(r.target for r in counts) == 3
    assert not quality_rules.log_ratios(spark.createDataFrame([], "bucket long, raw long, target long"), 64).any()


def test_mix_targets_by_water_filling(spark):
    sums = spark.createDataFrame([("a", 100), ("b", 1000), (None, 10), ("c", 0), ("d", 400)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.newton(mixing.targets(sums)).collect()}
    order, weights = ["a", "b", "c", "d", None], [5, 2, 1, 5, 2]
    size = {"a": 100, "b": 1000, None: 10, "c": 0, "d": 400}
    left, free, want = sum(size.values()), dict(zip(order, weights)), {}
    while free:
        total = sum(free.values())
        over = [s for s in free if left * free[s] / total > 3 * size[s]]
        if not over:
            want.update({s: left * w / total for s, w in free.items()})
            break
        for s in over:
            want[s] = 3 * size[s]
            del free[s]
        left = sum(size.values()) - sum(want.values())
    assert got == pytest.approx(want)
    tilts = {r.source: r.tilt for r in mixing.newton(mixing.targets(sums)).collect()}
    assert tilts["a"] == pytest.approx(np.log(want["a"] / 100)) and tilts["c"] is None


def test_mix_of_documents(spark, docs, none):
    sizes = {1: 0, 2: 0}
    got = mixing.mix(docs).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.copies <= 3 and r.taken == r.copies * r["size"] for r in got)
    assert all(r.taken == 0 for r in got if r.doc_id in sizes) and {r.kept for r in got} == {"x"}
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(none).count() == 0
    many = spark.range(400).selectExpr("id AS doc_id", "repeat('w ', int(1 + id % 37)) AS text", "concat('s', id % 3) AS source")
    taken = mixing.mix(many).groupBy("source").sum("taken").collect()
    target = {r.source: r.target for r in mixing.mix(many).collect()}
    assert all(abs(s - target[k]) < 0.02 * target[k] for k, s in taken)
    assert mixing.repeated(mixing.mix(many), ["doc_id"]).count() == mixing.mix(many).agg({"copies": "sum"}).head()[0]


def test_token_files_round_trip(docs, none):
    from tokenizers import Tokenizer

    path = vocabulary(TOKENIZER)
    lib = Tokenizer.from_file(path)
    lib.encode_special_tokens = True
    got = sorted(token_files.token_digest(docs, path).collect(), key=lambda r: r.start)
    start = 0
    for row, (i, text) in zip(got, sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0))):
        ids = lib.encode(text or "", add_special_tokens=False).ids + [0]
        assert (row.doc_id, row.start, row.n_tokens) == (i, start, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_files.token_digest(none, path).count() == 0


def test_token_query_equals_the_unchanged_library(spark, tmp_path):
    from tokenizers import Tokenizer

    from waymark.llm import queries

    lib = Tokenizer.from_file(vocabulary(TOKENIZER))
    texts = ["end <|endoftext|> next", "<|endoftext|>", "a<|endoftext|><|endoftext|>  \n b", "<|endoftext| > <|ENDOFTEXT|>", "plain  text's", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    start = 0
    for row in sorted(queries.op3_token_files(spark, str(tmp_path)).collect()):
        ids = lib.encode(texts[row.doc_id] or "", add_special_tokens=False).ids + [0]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert 50256 in lib.encode(texts[0], add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_blocks_hold_any_ids(seed):
    rng = np.random.default_rng(seed)
    n = [0, 1, 127, 128, 129, 70_000][seed]
    ids = np.where(rng.random(n) < 0.05, rng.integers(0, 2**32 - 1, n), rng.integers(5, 9 + 300 * seed, n)).astype(np.int64)
    starts = np.sort(rng.integers(0, n + 1, 5)).astype(np.int64)
    starts[0] = 0
    file = token_files.TokenFile(token_files.write_bytes(ids, starts))
    assert np.array_equal(file.ids(0, n), ids)
    assert np.array_equal(np.concatenate([file.document(k) for k in range(5)]) if n else ids, ids)
    assert np.array_equal(file.ids(n // 3, n // 2), ids[n // 3:n // 2])


def test_classifier_on_held_out_documents(spark, small, docs, none, labels):
    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    marks = spark.read.parquet(f"{small}/labels.parquet")
    rows = quality_classifier.classify(table, marks).join(marks, "doc_id").collect()
    assert np.mean([(r.quality_score >= 0.3) == (r.quality == 1) for r in rows]) > 0.9
    got = quality_classifier.classify(docs.select("doc_id", "text"), labels.limit(0)).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.quality_score <= 1 for r in got)
    assert quality_classifier.classify(none.select("doc_id", "text"), labels).count() == 0


def test_license_phrases_and_spans(spark, docs, none):
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    row = got[6]
    assert (row.n_base, row.base_labels, row.score) == (4, "apache,cc-by,mit", 1.0)
    assert (row.first_word, row.last_word) == (3, 13)
    assert got[1].n_words == 0 and got[1].first_word is None and got[1].labels == ""
    plain = license_scan.NOTICES[-1][1]
    notice, longer = plain.replace("permitted", "gladly"), plain.replace("permitted", "gladly permitted")
    extra = spark.createDataFrame(
        [(1, "x " * 500 + notice + " y" * 9), (2, notice[:40]), (3, longer)], "doc_id long, text string")
    found = {r.doc_id: r for r in license_scan.scan(extra).collect()}
    assert found[1].labels == "bsd" and 0.6 <= found[1].score < 1 and found[2].labels == ""
    assert found[3].labels == "bsd" and found[3].score == 1.0  # an inserted word hides none of the notice's
    assert license_scan.scan(none).count() == 0


def test_pieces_equal_the_library(docs, none):
    import random

    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))
    model = sentence_pieces.load(vocabulary(PIECES))
    rng = random.Random(3)
    texts = [t or "" for _, t in TEXTS] + ["".join(rng.choice(" \n aeést.,▁x☃\x00<s>12中") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    encoder = sentence_pieces.Encoder(model)
    for text, ids in zip(texts, encoder.encode(texts)):
        got = np.frombuffer(ids, "<i4").tolist()
        assert got == lib.encode(text) and encoder.decode(ids) == lib.decode(got)
    back = sentence_pieces.decode(sentence_pieces.encode(docs.select("doc_id", "text"), model), model).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert sentence_pieces.round_trip(none, model).count() == 0


def test_unigram_search_finds_the_best_sum():
    model = sentence_pieces.load(vocabulary(PIECES), kind="unigram")
    rank, score = model.chars, dict(zip(range(len(model.score)), model.score))
    for word in ("▁then", "▁other", "ation"):
        best = {0: 0.0}
        for i in range(1, len(word) + 1):
            best[i] = max(best[j] + score[rank[word[j:i]]] for j in range(i) if word[j:i] in rank)
        ids = np.frombuffer(sentence_pieces.encode_words(model, [word], sentence_pieces.Known(model))[0], "<i4")
        by_id = dict(zip(model.ids.tolist(), model.score))
        assert sum(by_id[i] for i in ids.tolist()) == pytest.approx(best[len(word)])


def test_classifier_scores_in_small_pieces_of_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from waymark.llm import quality_classifier as q

    model = q.fit(np.zeros((2, q.SHAPES + q.HASHED)), np.arange(2), np.array([0.0, 1.0]), 0.5, epochs=0)
    texts = [" ".join(f"w{(i * j) % 977}" for j in range(1500)) for i in range(600)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(600)), "text": texts})
    tracemalloc.start()
    got = pa.Table.from_batches(q.scored([batch], model))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == 600 and peak < 40e6
    one = [model.score(*reversed(q.encode(pa.array([t]))), 1)[0] for t in texts[:5]]
    assert np.allclose(one, got.column("quality_score").to_pylist()[:5], atol=1e-12)
