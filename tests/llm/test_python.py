"""Operators 3 to 7 and 9 against brute force, round trips and held-out accuracy."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadlake.llm import suffix_dedup as module
from threadlake.llm.decontaminate import Index, contamination, fitted
from threadlake.llm.jaccard_join import jaccard_components
from threadlake.llm.quality import fit, quality_scores
from threadlake.llm.sharding import shard_by_bytes
from threadlake.llm.shingles import pieces, shingled
from threadlake.llm.suffix_dedup import Windows, anchors, suffix_dedup
from threadlake.llm.token_store import Encoder, WaveletMatrix, occurrences, read_documents, write_shards

DATA = "/root/testdata/sf0.01"
public = pytest.importorskip("public_tokenizers")


def test_trees_learn_and_are_constant_without_labels():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert np.ptp(fit(x[:0], y[:0]).score(x)) == 0 and np.ptp(fit(x, np.ones(3000)).score(x)) == 0


def test_flat_trees_score_as_walked_one_by_one():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6))
    model = fit(x, (x[:, 0] * x[:, 2] > 0.1).astype(float))
    for row, got in zip(x, model.score(x)):
        raw = model.base
        for feature, cut, leaf in zip(model.feature, model.cut, model.leaf):
            at = 0
            while at < len(feature):
                at = 2 * at + 1 + int(row[feature[at]] > cut[at])
            raw += leaf[at - len(feature)]
        assert abs(1 / (1 + np.exp(-raw)) - got) < 1e-12


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_scores(docs, labels)
    assert out.count() == docs.count()
    got = out.join(labels.withColumnRenamed("doc_id", "id"), "id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.9
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.id, got.held_out))


def test_quality_nasty(spark, nasty, empty):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(40)] + [(None, 1, "x"), (5, None, "x"), (5, 0, "x")], "doc_id long, quality int, text string")
    out = quality_scores(nasty, labels)
    assert out.count() == nasty.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "c"), (1, None), (2, "d")], "doc_id long, text string")
    assert quality_scores(twice, labels).count() == 4
    assert quality_scores(nasty, labels.limit(0)).count() == nasty.count() and quality_scores(empty, labels).count() == 0


def edit_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != v), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_fitted_distance():
    rng = random.Random(4)
    for _ in range(100):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        assert fitted(np.array(a), np.array(b)) == edit_distance(a, b)


def test_items_in_blocks_find_the_same(spark):
    """Items beyond a block's bound go over all documents in further blocks."""
    rng = random.Random(14)
    items = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(20))) for i in range(30)]
    docs = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(30)) + " " + items[i % 30][1] * (i % 3 > 0), "taken") for i in range(90)] + [(None, None, "x")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string, hits string"), spark.createDataFrame(items, "item_id long, text string")
    key = lambda df: sorted(((r.doc_id, r.text, sorted(map(tuple, r.hits))) for r in df.collect()), key=str)
    got = key(contamination(a, b))
    assert sum(len(r[2]) for r in got) >= 60 and [c for c, _ in contamination(a, b).dtypes] == ["doc_id", "text", "hits"]
    for bound in ({"most_items": 7}, {"most_bytes": 300}):
        assert {(r[0], h[0]) for r in key(contamination(a, b, **bound)) for h in r[2]} == {(r[0], h[0]) for r in got for h in r[2]}


def test_decontamination_recall():
    rng = random.Random(9)
    items = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(14, 60)))) for i in range(60)]
    index = Index(items, rate=0.1, recall=0.95)
    hit = total = 0
    texts, want = [], []
    for i, text in items:
        for _ in range(6):
            w = text.split()
            for _ in range(len(w) // 10):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], ["new"], [w[k], "more"]])
            texts.append(" ".join([f"pad{k}" for k in range(rng.randrange(30))] + w + ["end"] * 20))
            want.append(i)
    for found, i in zip(index.matches(texts), want):
        total += 1
        hit += i in [m[0] for m in found]
    assert hit / total >= 0.9
    clean = [" ".join(f"w{rng.randrange(900)}" for _ in range(300)) for _ in range(50)]
    assert not any(index.matches(clean))


def test_decontamination_at_ends_and_of_short_items():
    rng = random.Random(10)
    items = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 7, 9, *[30] * 20, *[50] * 20])]
    index = Index(items, rate=0.1, recall=0.95)
    hit = total = 0
    for i, text in items:
        for lead in range(8):
            w = text.split()
            for _ in range(len(w) // 10):
                del w[rng.randrange(len(w))]
            found = index.matches([" ".join([f"pad{k}" for k in range(lead)] + w)])[0]
            got = i in [m[0] for m in found]
            assert got or len(text.split()) > 9, (i, lead)
            hit, total = hit + got, total + 1
    assert hit / total >= 0.9


def test_decontamination_against_edit_distance(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [(r.item_id, r.text) for r in items.collect()]
    index = Index(rows)
    got = {(r.doc_id, h.item_id) for r in contamination(docs, items).collect() for h in r.hits}
    want = set()
    for r in docs.collect():
        tokens = index.words(r.text)
        for item_id, item in index.items:
            limit = int(index.rate * len(item))
            # fewer known words than the item less its edits: too far
            if np.isin(item, tokens).sum() >= len(item) - limit and fitted(item, tokens) <= limit:
                want.add((r.doc_id, item_id))
    assert want and got <= want and len(got) >= 0.9 * len(want)


def test_decontamination_whole_passages(spark, nasty, empty):
    docs, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {r.doc_id for r in contamination(docs, items).where(F.size("hits") > 0).collect()}
    texts = [r.text for r in items.collect()]
    assert {r.doc_id for r in docs.collect() if any(t in r.text for t in texts)} <= got
    bench = spark.createDataFrame([(1, None, "h"), (2, "", "h"), (None, "x y z", "h"), (4, "a", "h"), (5, "a", "h")], "item_id long, text string, hits string")
    assert contamination(nasty, bench).count() == nasty.count() and contamination(nasty, bench.limit(0)).where(F.size("hits") > 0).count() == 0
    assert contamination(empty, bench).count() == 0


def brute_cut(rows, length):
    seen = Counter(hashlib.blake2b(b[q : q + length], digest_size=8).digest() for _, b in rows for q in range(len(b) - length + 1))
    out = []
    for i, b in rows:
        gone = np.zeros(len(b) + 1, bool)
        for q in range(len(b) - length + 1):
            if seen[hashlib.blake2b(b[q : q + length], digest_size=8).digest()] > 1:
                gone[q : q + length] = True
        gone = gone[:-1]
        out.append((i, len(b), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), hashlib.sha256(np.frombuffer(b, "uint8")[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("depth", [16, 3])
def test_suffix_dedup(spark, depth):
    rng = random.Random(depth)
    pool = ["".join(rng.choice("ab cdé\n") for _ in range(rng.randrange(20, 150))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(pool)[rng.randrange(5) :] if rng.random() < 0.6 else "".join(rng.choice("abcdefghij ") for _ in range(30)) for _ in range(rng.randrange(6)))) for i in range(80)]
    rows += [(200, "a" * 300), (201, "ab" * 100), (202, ""), (203, "x"), (None, rows[7][1]), (5, rows[6][1]), (None, None)] + [(300 + j, rows[5][1]) for j in range(20)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, raw string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sorted(map(tuple, suffix_dedup(df, length=40, depth=depth, shard_rows=150).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_cut([(i, (t or "").encode()) for i, t in rows], 40)


def test_suffix_dedup_indexes_copies_once_for_each_task(spark, monkeypatch):
    rng = random.Random(8)
    one, two = ("".join(rng.choice("abcdefghij ") for _ in range(600)) for _ in range(2))
    rows = [(i, one) for i in range(400)] + [(400, one[:500] + two), (401, two)]
    indexed, written = [], module.written

    def watched(df, *more):
        out = written(df, *more)
        if out.columns == ["token", "text", "place"]:
            indexed.append(out.count())
        return out

    monkeypatch.setattr(module, "written", watched)
    got = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), length=40)
    assert sorted(map(tuple, got.collect()), key=str) == brute_cut([(i, t.encode()) for i, t in rows], 40)
    # at most the phrases of two tasks' texts, not those of 400 copies
    assert len(indexed) == 1 and 100 < indexed[0] < 2 * 3 * 600


def test_suffix_dedup_edges(spark, nasty, empty):
    got = suffix_dedup(nasty)
    assert got.count() == nasty.count() and got.where("n_removed > n_bytes").count() == 0
    assert {r.id: r.n_removed for r in got.collect()}[301] == 200_000
    assert suffix_dedup(empty).count() == 0


def test_anchors_depend_on_context_only():
    rng = np.random.default_rng(2)
    a, b, core = (rng.integers(97, 123, n).astype("uint8") for n in (500, 300, 2000))
    one, two = anchors(np.concatenate((a, core, b)), 32) - 500, anchors(np.concatenate((b, core, a)), 32) - 300
    inside = lambda x: set(x[(x >= 31) & (x < 2000 - 39)].tolist())
    assert inside(one) == inside(two) and max(np.diff(sorted(inside(one)))) <= 32
    assert Windows(b"", b"", 400, 96, 16).sure.size == 0


def brute_components(rows, k, percent):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, s) in enumerate(sets):
        for j, u in sets[:n]:
            if i is not None and j is not None and s and u and 100 * len(s & u) >= percent * len(s | u):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), root(i) if i is not None else None) for i, s in sets), key=str)


@pytest.mark.parametrize(("percent", "fan", "seed"), [(85, 4, 88), (50, 2, 52), (85, 1, 85), (100, 4, 103)])
def test_jaccard(spark, percent, fan, seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 40))] for _ in range(12)]
    rows = []
    for i in range(110):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"W{rng.randrange(60)}"
        rows.append((i, "  ".join(w)))
    rows += [(200, ""), (201, None), (202, " \n"), (None, rows[0][1]), (3, rows[4][1]), (500, rows[5][1]), (500, rows[5][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, token long").repartition(3)
    got = sorted(map(tuple, jaccard_components(df, percent=percent, fan=fan).collect()), key=str)
    assert got == brute_components(rows, 4, percent)


def test_jaccard_nasty(nasty, empty):
    got = sorted(map(tuple, jaccard_components(nasty).collect()), key=str)
    assert got == brute_components([(r.doc_id, r.text) for r in nasty.collect()], 4, 85)
    assert jaccard_components(empty).count() == 0


@pytest.mark.parametrize("shards", [1, 16])
def test_sharding(spark, nasty, empty, shards):
    rows = shard_by_bytes(nasty, shards, ranges=8).collect()
    texts = [(r.doc_id, r.text or "") for r in nasty.collect()]
    assert sorted(((r.id, r.size, r.crc32) for r in rows), key=str) == sorted(((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts), key=str)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert shard_by_bytes(empty, shards).count() == 0
    hot = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("same text").alias("text"))
    sizes = Counter()
    for r in shard_by_bytes(hot, shards, ranges=32).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == shards and max(sizes.values()) - min(sizes.values()) <= 20


def test_wavelet_matrix():
    rng = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 1), (700, 2), (3000, 300), (2000, 70_000)):
        a = rng.integers(0, top, n).astype("uint32")
        m = WaveletMatrix.from_bytes(WaveletMatrix.of(a).to_bytes())
        assert (m.tokens() == a).all()
        assert (m.access_many(np.arange(n)) == a).all()
        for i in range(0, n, 37):
            k = int((a[:i] == a[i]).sum())
            assert m.access(i) == a[i] and m.rank(int(a[i]), i) == k and m.select(int(a[i]), k) == i
        assert m.rank(top + 100_000, n) == 0 and m.select(top + 100_000, 0) == -1


def test_shingles_are_those_of_each_text():
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "B", "b", " ", "\n", "\t", "é"]) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += ["x" * 40_000 + " y z", "", " ", "Y " * 200_000 + "x" * 20_000 + " Z q", "x" * 40_000 + " Y  Z "]
    for k in (1, 3, 4):
        known = {}
        for _, raw, bounds in pieces(pa.array(texts)):
            hashes, ends = shingled(raw, bounds, k)
            for i in range(len(bounds) - 1):
                w = bytes(raw[bounds[i] : bounds[i + 1]]).lower().split()
                want = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []
                assert len(want) == ends[i + 1] - ends[i]
                assert all(known.setdefault(s, h) == h for s, h in zip(want, hashes[ends[i] : ends[i + 1]].tolist()))
        assert len(set(known.values())) == len(known)


def hard_texts():
    rng = random.Random(1)
    out = ["<|startoftext|> a<|endoftext|>b <|ENDOFTEXT|>", "it's I'LL don't 'sup x'y", "Σας ΟΔΟΣ İstanbul ǅ", "é é ́a Á", "a\x1cb \x85 c d", "123 4a5b ½ ²", "naïve—dash… «q» ŀ ŉ ß ẞ ſt", "漢字 한국 😀👍🏽", "a.b,c!d?? ...", "", " \n", "\x00 \x01x"]
    return out + ["".join(rng.choice("abAB \n\t.,'<|>éÉßΣςσ́1२½—İıſKKͅ") for _ in range(40)) for _ in range(200)]


@pytest.mark.parametrize(("name", "plain"), [("word_bpe_49k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_is_the_library(name, plain):
    from tokenizers import Tokenizer

    model, library = Encoder(public.path(name), plain, most=50), Tokenizer.from_file(public.path(name))
    for t in hard_texts():
        assert model.encode([t.encode()])[0].tolist() == library.encode(t, add_special_tokens=False).ids, t
    for some in (hard_texts(), [t for t in hard_texts() if "<|" not in t]):
        flat, counts = model.encode([t.encode() for t in some])
        want = [library.encode(t, add_special_tokens=False).ids for t in some]
        assert counts.tolist() == [len(w) for w in want] and flat.tolist() == sum(want, [])


def test_token_store(spark, nasty, empty):
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    stored = write_shards(nasty, path, shards=3, piece=20_000)
    got = sorted((tuple(r)[:4] for r in read_documents(stored).collect()), key=lambda r: r[1])
    library = Tokenizer.from_file(path)
    want = Counter((r.doc_id, tuple([*library.encode(r.text or "", add_special_tokens=False).ids, 1])) for r in nasty.collect())
    assert Counter((i, n, c) for i, _, n, c in got) == Counter({(i, len(t), zlib.crc32(np.array(t, "<u4").tobytes())): k for (i, t), k in want.items()})
    start = 0
    for _, s, n, _ in got:
        assert s == start
        start += n
    ids = [-1 if r[0] is None else r[0] for r in got]
    assert ids == sorted(ids)
    firsts = Counter(r.first_token for r in read_documents(stored).collect())
    assert firsts == sum((Counter({t[0]: k}) for (_, t), k in want.items()), Counter())
    edge = spark.createDataFrame([(-(2**63), "a"), (None, "b"), (0, "c")], "doc_id long, text string")
    assert [r.id for r in read_documents(write_shards(edge, path, shards=1)).orderBy("start").collect()] == [None, -(2**63), 0]
    assert sum(r["count"] for r in occurrences(stored, 1).collect()) == sum(t.count(1) * k for (_, t), k in want.items())
    assert read_documents(write_shards(empty, path)).count() == 0
