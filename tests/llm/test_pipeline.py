"""The pipeline's stages against plain versions on the small tables."""

import pytest

pytest.importorskip("tokenizers")

import corpus_pipeline as p  # noqa: E402
from fieldloom.session import table  # noqa: E402
from tests.llm.test_operators import plain_components, plain_dedup, plain_windows  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_they_say(spark, tmp_path):
    docs, kept = table(spark, SF, "documents"), []
    for k, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    before = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    toxic, lines, near, clean, tokens = kept
    assert 0 < len(before) - len(toxic) < len(before) / 4 and all(before[i] == t for i, t in toxic.items())
    dropped = {i: (n, d) for i, n, d, _ in plain_dedup(list(toxic.items()))}
    assert set(lines) == set(toxic)
    assert all((t or "").count("\n") + 1 == max(dropped[i][0] - dropped[i][1], 1) for i, t in lines.items())
    assert set(near) == {i for i, _, c in plain_components(list(lines.items()), 5, 80) if i == c}
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    assert set(clean) == set(near) - {d for d, _ in plain_windows(list(near.items()), items)}
    assert {i: t or "" for i, t in clean.items()} == tokens


def test_run_gives_the_last_stage(spark):
    out = p.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids", "text"]
    assert out.where("n_tokens <> size(ids)").count() == 0
