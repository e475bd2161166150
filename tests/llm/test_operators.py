"""Each operator against a plain version, and its stated results for nulls, empty and long texts, ties and repeats."""

import collections
import hashlib
import html
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from fieldloom.llm import ann, bpe_automaton, decontaminate, html_cut, license_scan, license_texts, line_dedup, ngram_join, scan, sharding, token_files, toxicity, word_ids  # noqa: E402
from fieldloom.llm.graph import connected_components  # noqa: E402
from fieldloom.session import table  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bitmap string, score double, ids long"
BLANK = re.compile("[\x20\x09-\x0d]+")
BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def docs_df(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, "s", 0, "b", 0.5, 1) for i, t in rows], SCHEMA)


def sample_docs(spark, n=120):
    return [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").orderBy("doc_id").limit(n).collect()]


ODD = [(900, None), (901, ""), (902, "   \n\t "), (903, "one"), (904, "one two three"), (None, "lost id"), (905, "word " * 30_000), (906, "É à ß"), (906, "É à ß"), (907, "a\nb\n\n")]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# 1. N-gram Jaccard join.


def plain_components(rows, size=4, percent=85):
    sets, link = {}, {}
    for k, (i, t) in enumerate(rows):
        w = [x for x in BLANK.split(lower(t)) if x]
        sets[k] = {tuple(w)} if 0 < len(w) < size else {tuple(w[j : j + size]) for j in range(len(w) - size + 1)}
        link[k] = k

    def root(k):
        while link[k] != k:
            k = link[k]
        return k

    for a, b in itertools.combinations([k for k in sets if sets[k] and rows[k][0] is not None], 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            link[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, len(sets[k]), None if i is None else least[root(k)]) for k, (i, _) in enumerate(rows)), key=str)


def near_copies(rng, n=60):
    """Chains of edits: neighbours are alike, ends are not."""
    base = [f"w{x}" for x in rng.integers(0, 5000, 150)]
    out = []
    for k in range(n):
        base = list(base)
        for _ in range(rng.integers(0, 3)):
            base[rng.integers(0, len(base))] = f"e{rng.integers(0, 10**6)}"
        out.append((2000 + k, " ".join(base)))
    return out


def test_ngram_components_match_all_pairs(spark):
    rng = np.random.default_rng(11)
    passage = " ".join(f"p{x}" for x in range(60))
    shared = [(3000 + k, passage + " " + " ".join(f"u{x}" for x in rng.integers(0, 10**6, 40))) for k in range(40)]
    rows = sample_docs(spark) + ODD + near_copies(rng) + shared + [(4000 + k, "same text of a copy here") for k in range(30)]
    got = ngram_join.ngram_components(docs_df(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == plain_components(rows)


def test_ngram_components_of_nothing(spark):
    assert ngram_join.ngram_components(docs_df(spark, [])).count() == 0
    assert [tuple(r) for r in ngram_join.ngram_components(docs_df(spark, [(5, None)])).collect()] == [(5, 0, 5)]


def test_components_of_long_paths(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (None, 3)]
    got = {tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(k, 0) for k in range(41)} | {(100, 100), (101, 100)}


# 2. Nearest neighbours.


def test_neighbours_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows[40] = (40, None, 1)
    rows[60] = (60, [0.0] * 16, 1)
    rows[80] = (80, [float("nan")] + [1.0] * 15, 1)
    rows[100] = (100, [None] + [1.0] * 15, 1)
    rows += [(10_000 + k, x[5].tolist(), 1) for k in range(500)]  # one very common vector
    rows += [(None, x[6].tolist(), 1), (20_000, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, 20, 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ids = [r[0] for r in rows if r[0] is not None and r[1] and len(r[1]) == 16 and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    vectors = np.array([dict((r[0], r[1]) for r in rows)[i] for i in ids], np.float32).astype(float)
    asked = [k for k, i in enumerate(ids) if i % 20 == 0]
    assert set(got) == {ids[k] for k in asked}
    hits = 0
    for k in asked:
        score = (vectors * vectors[k]).sum(1)
        order = sorted((-s, i) for s, i in zip(score, ids) if i != ids[k])[:20]
        hits += len({i for _, i in order} & {i for i, _ in got[ids[k]]})
        assert [(-s, i) for i, s in got[ids[k]]] == sorted((-s, i) for i, s in got[ids[k]]) and len(got[ids[k]]) == 20
    assert hits / (20 * len(asked)) >= 0.9


def test_neighbours_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = [tuple(r)[:4] for r in ann.nearest(df, 20, 20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 0.5), (0, 2, 3, 0.0), (20, 1, 0, 0.5), (20, 2, 3, 0.5)]
    assert ann.nearest(df.where("false"), 20, 20).count() == 0


# 3. Sharding.


def test_shards_are_contiguous_and_even(spark):
    rows = sample_docs(spark) + ODD
    got = sorted(map(tuple, sharding.shard_by_bytes(docs_df(spark, rows), 5).collect()), key=lambda r: (r[3], r[4]))
    assert sorted((r[0] is not None, r[0], r[1], r[2]) for r in got if r[0] is not None) == sorted((True, i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows if i is not None)
    ids = [-1 if r[0] is None else r[0] for r in got]
    assert ids == sorted(ids)
    sizes = collections.Counter()
    for shard in range(5):
        own = [r for r in got if r[3] == shard]
        assert [r[4] for r in own] == list(range(len(own)))
        sizes[shard] = sum(r[1] for r in own)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r[1] for r in got)
    assert sharding.shard_by_bytes(docs_df(spark, []), 5).count() == 0


# 4. Line dedup.


def plain_dedup(rows):
    keys = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = lower(line.strip(" \t\n\x0b\x0c\r"))
            if len(key) >= 20 and i is not None:
                keys[key].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (i is not None and len(keys.get(k := lower(x.strip(" \t\n\x0b\x0c\r")), ())) >= 3 and len(k) >= 20 and max(keys[k]) != i)]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup_matches_plain_version(spark):
    common = "A line that a great many documents hold."
    rows = sample_docs(spark) + ODD + [(5000 + k, f"{common}\nown line number {k} is long enough\n  {common.upper()}\nshort") for k in range(400)]
    rows += [(6000, (common + "\n") * 5000), (6001, "Twice in one document only.\nTwice in one document only."), (6002, "Twice in one document only.")]
    df = docs_df(spark, rows).repartition(7)
    assert sorted(map(tuple, line_dedup.line_dedup_digests(df).collect()), key=str) == plain_dedup(rows)
    kept = line_dedup.with_kept_text(df, line_dedup.keep_bitmaps(df))
    assert kept.columns == df.columns and kept.count() == len(rows)
    assert line_dedup.line_dedup_digests(docs_df(spark, [])).count() == 0


def test_bitmaps_round_trip():
    keep = line_dedup.unpack(line_dedup.pack([1, 9, 3]), 20)
    assert [k for k in range(20) if not keep[k]] == [1, 3, 9]


# 5. Toxicity.


def test_toxicity_learns_words_and_scores_as_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 8))) for _ in range(300)]
    bad = ["vilestword", "grimezzle", "snarlquux"]
    rows, labels = [], []
    for i in range(900):
        words = list(rng.choice(vocabulary, 120))
        if i % 4 == 0:
            for _ in range(8):
                words[rng.integers(0, 120)] = bad[rng.integers(0, 3)]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += ODD
    labels += [(None, 1, 1), (5, 1, None), (8, 0, 1)]
    label_df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = docs_df(spark, rows).select("doc_id", "text")
    got = toxicity.toxicity(df, label_df)
    out = [tuple(r) for r in got.collect()]
    assert len(out) == len(rows) and all(0 <= r[2] <= 1 and r[3] == int(r[2] >= 0.7) for r in out)
    assert all(r[1] == (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 1) for r in out)
    held = [(r[3], int(r[0] % 4 == 0)) for r in out if r[1] and r[0] < 900]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    model = toxicity.fit(df, label_df)
    assert model.toxic and model.ordinary
    plain = {t: plain_score(t, model) for _, t in rows}
    texts = {i: t for i, t in rows}
    assert all(r[2] == pytest.approx(plain[texts[r[0]]], abs=1e-9) for r in out)
    clash = df.withColumn("score", F.lit(1)).withColumn("_text", F.lit("x"))
    kept = toxicity.without_toxic(clash, model, 0.7)
    assert kept.columns == clash.columns and kept.count() == sum(r[2] < 0.7 for r in out)
    assert toxicity.toxicity(docs_df(spark, []), label_df).count() == 0


def plain_score(text, model):
    """Compress each word with either dictionary, one after the other, and apply the model's weights by hand."""
    import math

    import zstandard as z

    settings = z.ZstdCompressionParameters(
        strategy=z.STRATEGY_GREEDY, min_match=5, hash_log=16, chain_log=16, search_log=5, window_log=17, write_checksum=0, write_content_size=0, write_dict_id=0
    )
    tail = bytes(range(128, 256))
    sides = [
        z.ZstdCompressor(compression_params=settings, dict_data=z.ZstdCompressionDict(x + tail, dict_type=z.DICT_TYPE_RAWCONTENT))
        for x in (model.ordinary, model.toxic + model.ordinary)
    ]
    ratios = []
    for word in re.split("[ \t\n\x0b\x0c\r]+", (text or "").lower()):
        raw = word.encode()
        for k in range(0, len(raw), 64):
            ordinary, toxic = (len(c.compress(b" " + raw[k : k + 64] + b" " + tail)) for c in sides)
            ratios.append(model.ratio[min(max(ordinary - toxic, -6), 14) + 6])
    top = sorted(ratios, reverse=True)[:3]
    x = [1, sum(ratios) / 5, sum(ratios) / max(len(ratios), 1) ** 0.5, sum(top), top[0] if top else 0, math.log1p(len(ratios))]
    return 1 / (1 + math.exp(-min(max(sum(a * b for a, b in zip(x, model.weights)), -30), 30)))


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in toxicity.toxicity(docs_df(spark, [(1, "a")]), none).collect()] == [(1, False, 0.0, 0)]


# 6. Benchmark decontamination.


def plain_windows(rows, items, threshold=0.8):
    split = lambda t: re.findall("[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    bag = lambda w: collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)])
    best = {}
    for i, t in rows:
        w = split(t)
        for item, text in items:
            v = split(text)
            for p in range(len(w) - len(v) + 1) if v and i is not None else ():
                a, b = bag(w[p : p + len(v)]), bag(v)
                both = sum((a & b).values())
                s = both / (sum(a.values()) + sum(b.values()) - both)
                if s >= threshold and s > best.get((i, item), (0, 0))[0]:
                    best[i, item] = (s, p)
    return best


def test_contaminated_windows_match_all_windows(spark):
    rng = np.random.default_rng(6)
    items = [(k, " ".join(f"q{x}" for x in rng.integers(0, 400, n))) for k, n in enumerate([3, 4, 5, 12, 30, 60, 60, 90])] + [(50, None), (51, " ! "), (4, None)]
    rows = [(900, None), (901, ""), (None, items[4][1])]
    for k in range(60):
        words = [f"z{x}" for x in rng.integers(0, 1000, 80)]
        item = items[k % 8][1].split()
        if k % 3 == 1 and len(item) >= 60:
            item[rng.integers(1, 4)] = "edited"
        if k % 2:
            words[40:40] = [w.upper() + "," for w in item]
        rows.append((k, " ".join(words)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["position"]) for r in decontaminate.contaminated_windows(docs_df(spark, rows), bench).collect()}
    want = plain_windows(rows, items)
    assert got == want and len(want) > 25
    clean = decontaminate.without_contaminated(docs_df(spark, rows), bench)
    bad = {d for d, _ in want} | {None}
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(i for i, _ in rows if i not in bad)
    assert decontaminate.contaminated_windows(docs_df(spark, rows), bench.where("false")).count() == 0


def test_blocks_find_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(8)
    prints = decontaminate.simhash(rng.integers(1, 2**63, (300, 30), dtype=np.int64).astype(np.uint64))
    index = decontaminate.BlockIndex(prints)
    asked = np.repeat(prints, 3, axis=0)
    for row in asked:
        for bit in rng.choice(128, int(rng.integers(0, 40)), replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    near = np.array([[sum(int(x ^ y).bit_count() for x, y in zip(q, p)) for p in prints.tolist()] for q in asked.tolist()])
    want = [(r, i, near[r, i]) for r, i in np.argwhere(near <= decontaminate.RADIUS)]
    assert [tuple(x) for x in index.within(asked).tolist()] == want and len(want) > 500


def test_similar_windows_lie_within_the_radius():
    rng = np.random.default_rng(3)
    found = []
    for _ in range(4000):
        size = int(rng.integers(12, 120))
        one = rng.integers(1, 2**63, size, dtype=np.int64).astype(np.uint64)
        two = one.copy()
        edits = rng.choice(size, int(rng.integers(1, max(2, size // 12))), replace=False) if rng.random() < 0.5 else np.arange(rng.integers(1, max(2, size // 6)))
        two[edits] = rng.integers(1, 2**63, len(edits) if rng.random() < 0.5 else 1)
        if decontaminate.similarity(decontaminate.bag(one), decontaminate.bag(two)) >= 0.8:
            prints = [decontaminate.simhash(decontaminate.sequence(x)[None]) for x in (one, two)]
            found.append(decontaminate.apart(*prints)[0] <= decontaminate.RADIUS)
    assert len(found) > 1000 and np.mean(found) > 0.99


def test_long_texts_and_empty_tables_are_searched(spark):
    item = " ".join(f"w{k}" for k in range(60))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    long = "filler words " * 400_000 + item + " more" * 1000
    got = decontaminate.contaminated_windows(docs_df(spark, [(7, long), (8, None)]), bench).collect()
    assert [(r["doc_id"], r["item_id"], r["similarity"], r["position"]) for r in got] == [(7, 1, 1.0, 800_000)]
    assert decontaminate.contaminated_windows(docs_df(spark, []), bench).count() == 0


# 7. BPE by automaton.

TRICKY = ["", "  a  b", "a\n\nb  ", "hello<|endoftext|>world <|endoftext|>", "\x1c a\x1d!\x1e!", "日本語 😀😀", "a" * 3000, "it's we'll I'M", "\t\ttab", "llllll $$$$$ 111111", "\r\n x", "İstanbul ﬁ ǅ é x ́y"]


def test_bpe_is_the_library_and_round_trips(spark):
    library = tokenizers.Tokenizer.from_file(BYTE_BPE)
    rows = [(k, t) for k, t in enumerate(TRICKY)] + sample_docs(spark, 60) + ODD
    got = sorted(map(tuple, bpe_automaton.bpe_digests(docs_df(spark, rows), BYTE_BPE).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = bpe_automaton.bpe_round_trip(docs_df(spark, rows), BYTE_BPE).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(i), t or "") for i, t in rows)
    assert all(r["ids"] == library.encode(r["text"], add_special_tokens=False).ids for r in back)
    assert bpe_automaton.bpe_digests(docs_df(spark, []), BYTE_BPE).count() == 0


def test_automaton_follows_merge_order_on_small_alphabets():
    letters = bpe_automaton.byte_letters()
    rng = np.random.default_rng(4)
    for _ in range(20):
        vocab = {x: k for k, x in enumerate(letters)}
        tokens, merges = ["a", "b", "c"], []
        for _ in range(12):
            u, v = rng.choice(tokens, 2)
            if u + v not in vocab:
                vocab[u + v] = len(vocab)
                tokens.append(u + v)
                merges.append((str(u), str(v)))
        auto = bpe_automaton.MergeAutomaton(vocab, merges)
        ranks = {m: k for k, m in enumerate(merges)}
        for _ in range(60):
            text = "".join(rng.choice(list("abc"), rng.integers(1, 14)))
            parts = list(text)
            while True:
                best = min((ranks.get(p, 999) for p in zip(parts, parts[1:])), default=999)
                if best == 999:
                    break
                k = next(k for k, p in enumerate(zip(parts, parts[1:])) if ranks.get(p) == best)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            assert list(auto.encode(text.encode())) == [vocab[p] for p in parts]


# 8. Token files.


def test_token_files_give_back_every_id(spark):
    library = tokenizers.Tokenizer.from_file(WORD_BPE)
    rows = [(k + 10_000, t) for k, t in enumerate(TRICKY)] + sample_docs(spark, 60) + [r for r in ODD if r[0] is not None]
    got = sorted(map(tuple, token_files.token_file_digests(docs_df(spark, rows), WORD_BPE, 2).collect()))
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == sorted(want)
    assert token_files.token_file_digests(docs_df(spark, []), WORD_BPE, 2).count() == 0


def test_ranks_round_trip():
    for values in ([], [0], [255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], range(1000)):
        ranks = np.array(list(values), np.uint32)
        assert (token_files.decode_ranks(*token_files.encode_ranks(ranks), len(ranks)) == ranks).all()


def test_words_of_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        word_ids.WordIds(BYTE_BPE)


# 9. Licence scan.


def test_licences_are_found_despite_spelling(spark):
    mit = "Copyright (c) 2020 Someone\n\n" + license_texts.MIT.upper().replace("SOFTWARE", " software ").replace(",", " , ")
    rows = [(1, mit), (2, "intro\nReleased under the MIT licence!\nmore"), (3, None), (4, ""), (5, license_texts.MIT + " not quite"), (2, "all rights RESERVED")]
    got = sorted(map(tuple, license_scan.scan_licenses(docs_df(spark, rows), license_scan.known_digests(spark)).collect()), key=str)
    assert [(r[0], r[2], r[3], r[4]) for r in got] == [
        (1, "MIT", "", 0), (2, "LicenseRef-all-rights-reserved", "LicenseRef-all-rights-reserved", 1), (2, None, "MIT", 1), (3, None, "", 0), (4, None, "", 0), (5, None, "", 0)
    ] or {(r[0], r[2], r[3], r[4]) for r in got} == {
        (1, "MIT", "", 0), (2, "LicenseRef-all-rights-reserved", "LicenseRef-all-rights-reserved", 1), (2, None, "MIT", 1), (3, None, "", 0), (4, None, "", 0), (5, None, "", 0)
    }
    assert license_scan.scan_licenses(docs_df(spark, []), license_scan.known_digests(spark)).count() == 0


# 10. HTML extraction.


def test_cuts_are_minimal():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 8))
        a, b = rng.random(n) * 3, rng.random(n) * 3
        ties = [(i, j, float(rng.random())) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda k: sum(b[i] if k[i] else a[i] for i in range(n)) + sum(c for i, j, c in ties if k[i] != k[j])  # noqa: B023, E731
        best = min(map(cost, itertools.product([0, 1], repeat=n)))
        assert cost(html_cut.minimum_cut(a, b, ties)) == pytest.approx(best)


def test_articles_of_the_pages_come_out_whole(spark):
    pages = table(spark, SF, "pages")
    got = {r["page_id"]: r for r in html_cut.extract_main_text(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r["page_id"]]["text"] == "\n".join(filter(None, blocks))
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_pages_without_markup_nulls_and_comments(spark):
    page = "<nav><a href=x>Home</a></nav><article><h1>T &amp; t</h1><p>First  text,<br>more.<aside>See also</aside><div class='comments'><p>Bad comment.</p></div><p>Last one.</article>"
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "<script>var a = '<p>';</script>"), (5, None, "<p>" + "long words here. " * 20_000)]
    got = {r["page_id"]: r["text"] for r in html_cut.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "T & t\nFirst text, more.\nLast one." and got[2] == got[3] == got[4] == "" and len(got[5]) > 300_000
    assert html_cut.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# Scans.


def test_words_and_shingles_match_plain_split():
    texts = ["A b\tc", None, "", " x ", "é è f g h", "a a a a a a"]
    data, offsets = scan.text_buffer(pa.array(texts))
    row, name, start, end = scan.words(data, offsets)
    got = [(int(r), data[a:b].tobytes().decode().lower()) for r, a, b in zip(row, start, end)]
    assert got == [(k, w) for k, t in enumerate(texts) for w in BLANK.split(lower(t)) if w]
    _, value = scan.shingles(row, name, 4)
    assert len(value) == 1 + 1 + 1 + 3 and len(set(value[-3:].tolist())) == 1
