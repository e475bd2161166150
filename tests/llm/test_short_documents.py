"""A document shorter than a benchmark item is compared with it as a whole."""

import pytest

from fieldloom.llm import decontaminate


def test_shorter_documents_are_reported(spark):
    words = [f"q{k}" for k in range(50)]
    less = words[:25] + words[26:]
    rows = [(1, " ".join(less)), (2, " ".join(words)), (3, " ".join(words[:30])), (4, " ".join(words[:-6])), (5, "z1 z2 z3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words)), (8, "other " * 50)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["position"], r["n_words"]) for r in decontaminate.contaminated_windows(docs, bench).collect()}
    assert got == {(1, 7): (pytest.approx(41 / 50), 0, 49), (2, 7): (1.0, 0, 50), (4, 7): (pytest.approx(40 / 46), 0, 44)}
    assert sorted(r["doc_id"] for r in decontaminate.without_contaminated(docs, bench).collect()) == [3, 5]
