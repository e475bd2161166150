"""Suffix dedup against all strings of all texts, with small and usual settings, and the merge against sorted()."""

import random

import numpy as np
import pyarrow as pa
import pytest

from fieldloom.llm import suffix_dedup
from fieldloom.llm.suffix_dedup import Settings, merge_runs, without_repeats
from fieldloom.session import table

SF = "/root/testdata/sf0.001"


def plain(rows, span=50):
    """[(id, removed ranges, kept bytes)] by a table of all strings."""
    least = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        if i is not None:
            for at in range(len(b) - span + 1):
                w = b[at : at + span]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        if i is not None:
            for at in range(len(b) - span + 1):
                if least[b[at : at + span]] < i:
                    gone[at : at + span] = True
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False])).reshape(-1, 2)
        out.append((i, tuple(map(tuple, edges.tolist())), bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, tuple(map(tuple, r.removed)), bytes(r.kept)) for r in df.collect()), key=str)


def planted():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(40)[:n] for n in (49, 50, 51, 60, 75, 120)]
    line = "a line that a great many of all documents hold, word for word, every one"
    rows = [(i, " ".join([text(rng.randrange(0, 30)), rng.choice(passages), text(rng.randrange(0, 20)), line if i % 2 else "", text(10)])) for i in range(100, 190)]
    rows += [(i, rows[i % 7][1]) for i in range(200, 230)]  # whole copies
    rows += [(i, rows[i % 5][1][3:] + text(5)) for i in range(230, 250)]
    rows += [(5, "ab" * 200), (300, "ab" * 100 + "c"), (301, "word " * 3000), (302, "x" * 49), (303, "x" * 50), (304, "x" * 300), (6, "\0" * 80), (305, "q" + "\0" * 60 + "\1"), (306, "\0" * 49 + "\1" * 50)]
    rows += [(7, None), (8, ""), (None, rows[0][1]), (None, None), (100, rows[0][1]), (100, text(60) + passages[3]), (309, passages[5]), (309, passages[5])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, kept string, digest int").repartition(5)


def test_equals_all_strings(spark):
    rows = planted()
    assert got(without_repeats(frame(spark, rows))) == plain(rows)


@pytest.mark.parametrize("settings", [Settings(chunk_bytes=2000, part_bytes=3000), Settings(hot=0, chunk_bytes=4000), Settings(hot=3), Settings(gram=16, hot=3), Settings(span=30, gram=9, chunk_bytes=1500)])
def test_settings_do_not_change_the_result(spark, settings):
    rows = planted()
    assert got(without_repeats(frame(spark, rows), settings=settings)) == plain(rows, settings.span)


def passage_of_many(count=40):
    """Texts that hold one passage between words of their own: many rows, few different suffixes."""
    rng = random.Random(5)
    own = lambda: "".join(rng.choice("abcdefgh") for _ in range(60))
    passage = "".join(rng.choice("klmnopqr ") for _ in range(400))
    return [(i, own() + passage + own()) for i in range(count)]


def test_buckets_with_told_ranges_and_no_suffixes(spark):
    rows, settings = passage_of_many(), Settings(part_bytes=100)
    assert got(without_repeats(frame(spark, rows), settings=settings)) == plain(rows)


def test_bucket_of_told_ranges_alone():
    rows, parts = passage_of_many(), 211
    text = pa.array([t for _, t in rows])
    data, offsets = suffix_dedup.text_buffer(text)
    found = suffix_dedup.anchors(data, offsets, suffix_dedup._eights(data), Settings())
    at = pa.array([list(range(n)) for n in np.bincount(found[0])], pa.list_(pa.int32()))
    ids = pa.array([i for i, _ in rows], pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, text, at], ["doc", "digest", "text", "at"])
    runs = pa.Table.from_batches(suffix_dedup._sort_runs(parts, np.zeros(0, np.uint64), Settings())(iter([batch])))
    alone = runs.filter(pa.array([not x and bool(y) for x, y in zip(runs["length"].to_pylist(), runs["known_doc"].to_pylist())]))
    assert len(alone)
    spans = suffix_dedup._merge(Settings())(alone.slice(0, 1))
    assert spans["doc"].to_pylist() == np.frombuffer(alone["known_doc"][0].as_py(), np.int64).tolist()


def test_given_documents(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(without_repeats(docs)) == plain(rows)


def test_empty_table_and_bad_settings(spark):
    assert without_repeats(frame(spark, []).limit(0)).collect() == []
    with pytest.raises(ValueError):
        without_repeats(frame(spark, []), settings=Settings(gram=30))


def test_loser_tree_merges_and_tells_common_prefixes():
    rng = random.Random(2)
    for count in (1, 2, 3, 7, 16):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 12))) for _ in range(rng.randrange(0, 40))) for _ in range(count)]
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        fronts = [[common(a, b) for a, b in zip([b""] + r, r)] for r in runs]
        merged = list(merge_runs(list(zip(runs, fronts))))
        keys = [runs[r][i] for r, i, _ in merged]
        assert keys == sorted(k for r in runs for k in r)
        assert [h for _, _, h in merged] == [common(a, b) for a, b in zip([b""] + keys, keys)]


def test_common_prefix_counts_bytes():
    words = suffix_dedup._words(suffix_dedup._eights(np.frombuffer(b"abcdefghijabcdefghxx", np.uint8)), np.array([0, 10]), np.array([10, 10]), 2)
    assert suffix_dedup.common_prefix(words).tolist() == [0, 8]
