"""Long benchmark items, and columns whose names clash with those of the line dedup."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from fieldloom.llm import decontaminate as d
from fieldloom.llm.line_dedup import keep_bitmaps, line_dedup_digests, with_kept_text


def test_window_starts_and_prints_equal_the_plain_ones():
    rng = np.random.default_rng(1)
    row = np.repeat([0, 1, 2], [300, 4, 500])
    first = np.searchsorted(row, np.arange(4))
    value = rng.integers(1, 2**63, len(row), dtype=np.int64).astype(np.uint64)
    for length in (7, 50, 290):
        at = np.unique(rng.integers(0, len(row) - 5, 9))
        at = at[[row[a] == row[a + 4] for a in at]]
        want = sorted({s for a in at for s in range(a - length + 5, a + 1) if s >= first[row[a]] and s + length <= first[row[a] + 1]})
        assert d.window_starts(at, row, first, length, 5).tolist() == want
        places = length - 4
        windows = np.array(want, np.int64)
        if len(windows):
            assert (d.window_prints(value, windows, places) == d.simhash(value[windows[:, None] + np.arange(places)])).all()
    long = rng.integers(1, 2**63, 60_000, dtype=np.int64).astype(np.uint64)
    windows = np.unique(np.r_[np.arange(100, 400), rng.integers(0, 30_000, 50), 29_000])
    got = d.window_prints(long, windows, 30_000)
    for k in (0, 7, 150, len(windows) - 1):
        assert (got[k] == d.simhash(long[None, windows[k] : windows[k] + 30_000])[0]).all()


def test_a_long_item_takes_memory_by_its_length():
    words = [f"w{x}" for x in np.random.default_rng(2).integers(0, 10**6, 20_000)]
    items = d.Items.of([(1, " ".join(words)), (2, "a short item of just seven words")])
    text = "before it " * 3000 + " ".join(words[:9000]) + " changed " + " ".join(words[9000:]) + " after it" * 3000 + " a short item of just seven words"
    tracemalloc.start()
    found = {item: (score, at, n) for _, item, score, at, _, n in d._scan(pa.array([text, None, "x"]), [items], 0.8)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6
    assert found[2] == (1.0, 6000 + 20_001 + 6000, 7)
    assert found[1][0] > 0.99 and found[1][1] in (6000, 6001) and found[1][2] == 20_000


@pytest.mark.parametrize("names", [["_copy"], ["_doc"], ["_dropped"], ["_bitmap"], ["_COPY", "_Digest", "__bitmap", "_bitmap"]])
def test_columns_that_clash(spark, names):
    line = "a line of more than twenty characters"
    rows = [(i, f"own {i}\n{line}", *[i * 10] * len(names)) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = with_kept_text(docs, keep_bitmaps(docs))
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.collect()) == [(i, f"own {i}" + (f"\n{line}" if i == 3 else ""), *[i * 10] * len(names)) for i in range(4)]
    assert {r.doc_id: r.n_dropped for r in line_dedup_digests(docs).collect()} == {0: 1, 1: 1, 2: 1, 3: 0}
