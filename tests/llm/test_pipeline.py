"""The pipeline's stages against what their operators and brute force say of their inputs."""

import corpus_pipeline
import pytest

from skein.llm import decontam
from skein.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_text_operators import plain_components, plain_contamination, plain_fingerprint


def test_stages_in_order(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_duplicates", "decontamination", "encoding"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        after = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if name == "language":
            assert len(after) >= 0.98 * len(before)
        elif name == "line_dedup":
            assert all(set(r["text"].split("\n")) <= set(before[i]["text"].split("\n")) and r["n_chars"] == len(r["text"]) for i, r in after.items())
            for i, r in before.items():
                assert i in after or all(any(line.strip() in before[j]["text"] for j in before if j < i) for line in r["text"].split("\n"))
        else:
            assert all(after[i] == before[i] for i in after)
        if name == "near_duplicates":
            want = plain_components({i: plain_fingerprint(r["text"]) for i, r in before.items()})
            assert set(after) == {i for i in before if want[i] == i}
        if name == "decontamination":
            want = plain_contamination([(i, r["text"]) for i, r in before.items()], bench)
            assert set(after) == {i for i in before if not want[i][3]}
    encoded = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in encoded} == set(after)


@pytest.mark.parametrize("bad", [(1, None, None, None, None), (None, "a text without an id and with some words", "en", "s", 5)])
def test_stages_take_nulls_and_empty_tables(spark, sf_dir, bad):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [bad, bad]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, sf_dir).count() <= len(rows)


def test_every_operator_has_one_query():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 11)] == [1] * 10
    assert set(ORACLE_SQL) <= set(QUERIES) and decontam.WINDOW == 13
