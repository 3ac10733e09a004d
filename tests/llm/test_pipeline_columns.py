"""Columns of the documents that are called like an operator's own, in every stage."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

CLASHES = ("target", "rate", "size", "source_size", "copies", "taken", "quality_score", "n_lines", "n_dropped", "_id", "_content", "node", "component_id")


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for i in range(12):
        text = f"A common first line\n{'word ' * (5 + i % 4)}number {i % 6} of the texts\nlast {i}"
        rows.append((i, text, f"s{i % 3}", len(text), {"k": i}, *(f"{c}-{i}" for c in CLASHES)))
    names = ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, n_chars long, m map<string,int>, {names}")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_columns_with_names_of_an_operator_stay(spark, docs, tmp_path, name, stage):
    labels = [(i, i % 2, 0, "x") for i in range(12)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(str(tmp_path / "labels.parquet"))
    got = stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows or name == "quality classifier"
    for r in rows:
        assert r.m == {"k": r.doc_id} and all(r[c] == f"{c}-{r.doc_id}" for c in CLASHES)
        assert r.n_chars == len(r.text)
