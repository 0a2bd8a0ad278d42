"""Operators 11 to 13 against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlake.llm import collocations as mining
from threadlake.llm import periodic_runs as periodic
from threadlake.llm.collocations import collocations, floor_ratio
from threadlake.llm.periodic_runs import islands, lag_counts, periodic_runs
from threadlake.llm.queries import op11_periodic_runs, op12_substring_dedup
from threadlake.llm.substring_dedup import compacted, rightmost_least, substring_dedup

DATA = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def plain_runs(words, least=24, periods=3):
    """Every maximal stretch of each period, then those whose smallest period it is."""
    out = []
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            some = words[i : j + q]
            if j > i and len(some) >= max(least, periods * q) and not any(all(some[x] == some[x + p] for x in range(len(some) - p)) for p in range(1, q)):
                out.append((i, len(some), q))
            i = j + 1
    return sorted(out)


def runny(rng, n):
    """Words with some stretches that repeat."""
    words = [str(rng.randrange(rng.choice([1, 2, 3, 50]))) for _ in range(n)]
    for _ in range(rng.randrange(4) if n > 5 else 0):
        p, a = rng.randrange(1, max(2, n // 4)), rng.randrange(n)
        for i in range(a + p, rng.randrange(a, n)):
            words[i] = words[i - p]
    return words


@pytest.mark.parametrize("section", [1 << 19, 41])
def test_lag_counts_and_runs(section, monkeypatch):
    monkeypatch.setattr(periodic, "SECTION", section)
    rng = random.Random(3)
    for _ in range(120):
        words = runny(rng, rng.randrange(1, 260))
        code = np.array([int(w) for w in words])
        n = len(code)
        counts, _ = lag_counts(code, np.array([0, n]), np.array([n // 3]))
        assert counts[1:].tolist() == [(code[q:] == code[: n - q]).sum() for q in range(1, n // 3 + 1)]
        text = " ".join(words).encode()
        assert [found for _, found in periodic.texts_and_runs([b"", text, b"x y", text], 24, 3)] == [[], plain_runs(words), [], plain_runs(words)]


def test_islands_next_to_known_runs():
    words = np.array([0, 1] * 30 + [2] + [0, 1, 3, 4] * 9)
    assert islands(words, 4, 12, [(0, 56)]) == [(61, 93)] and islands(words, 2, 20, []) == [(0, 58)]


def test_a_long_text_of_one_word_and_a_text_without_runs():
    many = periodic.texts_and_runs([b"a " * 200_000, b" ".join(b"%d" % i for i in range(200_000))], 24, 3)
    assert [found for _, found in many] == [[(0, 200_000, 1)], []]


def test_periodic_runs_of_hard_rows(spark, nasty, empty):
    rng = random.Random(5)
    more = [(900 + i, "\t\x0b".join(runny(rng, 150))) for i in range(20)] + [(None, "a b " * 40), (None, "é ü ö " * 30)]
    table = nasty.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).withColumn("runs", F.lit("taken")).withColumn("raw", F.lit(1))
    got = sorted(((r.id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(table).collect()), key=str)
    want = []
    for r in table.collect():
        words = WORDS.findall(r.text or "")
        runs = plain_runs(words) if len(words) < 1000 else []
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append((r.doc_id, len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)))
    assert got == sorted(want, key=str) and sum(len(r[2]) for r in got) > 4
    assert periodic_runs(empty).count() == 0


def test_periodic_query(spark, tmp_path):
    """The whole digest row, planted stretches included, from plain Python."""
    rng = random.Random(8)
    rows = [(i, " ".join(runny(rng, rng.randrange(0, 300)))) for i in range(300)] + [(None, "a " * 50), (777, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want, planted = [], 0
    for doc, text in rows:
        words = WORDS.findall(text or "")
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        runs = plain_runs(words)
        best = None
        for s, length, q in runs:
            if best is None or length * best[2] > best[1] * q:
                best = (s, length, q)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)), digest(kept)))
    assert planted > 10
    out = op11_periodic_runs(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def plain_substrings(rows, window=20):
    """``(id, n_words, spans, kept)`` of each row: windows of words that also start in an earlier row or place."""
    rank = {k: i for i, k in enumerate(sorted({(i is None, i or 0, hashlib.sha256((t or "").encode()).digest()[:16]) for i, t in rows}))}
    place = lambda i, t: rank[(i is None, i or 0, hashlib.sha256((t or "").encode()).digest()[:16])]
    first = {}
    for i, t in rows:
        words = WORDS.findall(t or "")
        for k in range(len(words) - window + 1):
            key, at = tuple(words[k : k + window]), (place(i, t), k)
            first[key] = min(first.get(key, at), at)
    out = []
    for i, t in rows:
        words = WORDS.findall(t or "")
        gone = {j for k in range(len(words) - window + 1) if first[tuple(words[k : k + window])] != (place(i, t), k) for j in range(k, k + window)}
        spans = [[j] for j in sorted(gone) if j - 1 not in gone]
        for s in spans:
            s.append(next(j for j in range(s[0], len(words) + 1) if j not in gone))
        out.append((i, len(words), [tuple(s) for s in spans], " ".join(w for j, w in enumerate(words) if j not in gone)))
    return out


def passages(rng):
    """Texts with copied stretches of all lengths, within and across texts, and runs."""
    pool = [f"w{rng.randrange(3000)}" for _ in range(900)]
    rows = []
    for i in range(140):
        words = []
        for _ in range(rng.randrange(1, 7)):
            kind = rng.randrange(4)
            if kind == 0:
                words += [f"n{rng.randrange(10**6)}" for _ in range(rng.randrange(30))]
            elif kind == 1:
                a = rng.randrange(len(pool))
                words += pool[a : a + rng.randrange(1, 90)]
            elif kind == 2 and words:
                a = rng.randrange(len(words))
                words += words[a : a + rng.randrange(60)]
            else:
                words += ["run"] * rng.randrange(40)
        rows.append((rng.choice([i, 1000 - i]), rng.choice([" ", "\n", "  "]).join(words)))
    return rows


@pytest.mark.parametrize("broadcast", [48 << 20, 0])
def test_substrings_against_brute_force(spark, monkeypatch, broadcast):
    for name in ("common", "substring_dedup"):
        monkeypatch.setattr(f"threadlake.llm.{name}.BROADCAST", broadcast)
    rows = passages(random.Random(13 + broadcast))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r.id, r.n_words, [tuple(x) for x in r.spans], r.kept) for r in substring_dedup(docs).collect()), key=str)
    assert got == sorted(plain_substrings(rows), key=str) and sum(len(r[2]) for r in got) > 100


def test_substrings_with_other_windows(spark):
    rows = passages(random.Random(21))[:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for window, anchor in ((7, 2), (5, 5)):
        got = sorted(((r.id, r.n_words, [tuple(x) for x in r.spans], r.kept) for r in substring_dedup(docs, window=window, anchor=anchor).collect()), key=str)
        assert got == sorted(plain_substrings(rows, window), key=str)
    with pytest.raises(ValueError):
        substring_dedup(docs, window=4, anchor=5)


def test_substrings_of_hard_rows(spark, nasty, empty):
    rows = [(r.doc_id, r.text) for r in nasty.collect()]
    named = nasty.withColumns({c: F.lit("taken") for c in ("raw", "no", "rep", "gone", "anchor", "class", "first")})
    got = sorted(((r.id, r.n_words, [tuple(x) for x in r.spans], r.kept) for r in substring_dedup(named).collect()), key=str)
    assert got == sorted(plain_substrings(rows), key=str)
    assert substring_dedup(empty).count() == 0


def test_long_passage_goes_once(spark, tmp_path):
    """A passage of sixty words in five texts stays in the one of the smallest id alone; clean texts keep all."""
    rng = random.Random(4)
    new = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    passage = new(60)
    rows = [(i, " ".join(new(30) + passage + new(30))) for i in (9, 4, 7, 12, 30)] + [(i, " ".join(new(80))) for i in range(50, 60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.n_removed for r in op12_substring_dedup(spark, str(tmp_path)).collect()} == {i: 60 if i in (9, 7, 12, 30) else 0 for i, _ in rows}


def test_paths_and_places(spark):
    links = [(b, a) for path in ([5, 9, 20, 21, 40, 41, 42, 90], [100, 101], range(200, 330)) for a, b in zip(path, list(path)[1:])]
    got = {r.at: r["head"] for r in compacted(spark.createDataFrame(links, "at long, up long")).collect()}
    assert got == {at: 5 if at < 100 else 100 if at < 200 else 200 for at, _ in links}
    assert compacted(spark.createDataFrame([], "at long, up long")).count() == 0
    rng = np.random.default_rng(2)
    for width in (1, 2, 5, 16, 23):
        v = rng.integers(0, 6, 60)
        assert rightmost_least(v, width).tolist() == [max(j for j in range(i, i + width) if v[j] == min(v[i : i + width])) for i in range(60 - width + 1)]


def plain_collocations(rows, most=3, least=10, percent=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    f[(lang, *words[i : i + k])] += 1
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    covered = {(q[0], *q[i : i + k]) for q, b in found.items() for k in range(2, len(q) - 1) for i in range(1, len(q) - k + 1) if 100 * b >= percent * f[(q[0], *q[i : i + k])]}
    out = []
    for p, a in found.items():
        if p in covered:
            continue
        cuts = []
        for k in range(2, len(p)):
            left, right = f[p[:k]], f[(p[0], *p[k:])]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((p[0], -score, -a, " ".join(p[1:]).encode(), left, right))
    ranked = []
    for lang in sorted({r[0] for r in out}):
        for rank, (_, score, a, phrase, left, right) in enumerate(sorted(r for r in out if r[0] == lang)[:top], 1):
            ranked.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return ranked


def phrasey(rng, n=400):
    parts = ["New York", "new york city", "the end of the", "of the", "ÄRGER über", "a\tb c", "x!y z", "z\ny"]
    words = lambda: " ".join(rng.choice(parts + [f"w{rng.randrange(30)}"]) + rng.choice(["", "", ",", ". "]) for _ in range(rng.randrange(25)))
    return [(rng.choice(["en", "en", "de", None]), words()) for _ in range(n)] + [("en", None), (None, ""), ("fr", " .,\n"), ("q q", "run " * 90)]


@pytest.mark.parametrize("kind", ["exact", "bloom", "small chunks"])
def test_collocations_against_brute_force(spark, monkeypatch, kind):
    if kind == "bloom":
        monkeypatch.setattr(mining, "BLOOM_BITS", 1 << 12)  # with many false hits
    if kind == "small chunks":
        monkeypatch.setattr(mining, "CHUNK", 200)
    rows = phrasey(random.Random(3))
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", F.lit("taken")).withColumn("n", F.lit(5)).repartition(3)
    out = collocations(docs, top=60, **({"exact_grams": 0} if kind == "bloom" else {}))
    got = [tuple(r) for r in out.orderBy("lang", "rank").collect()]
    assert got == plain_collocations(rows, top=60) and {r[0] for r in got} >= {"en", "de", "und", "q q"}


def test_collocations_of_other_lengths(spark, nasty, empty):
    rows = phrasey(random.Random(6), 250)
    docs = spark.createDataFrame(rows, "lang string, text string")
    for most, least in ((2, 3), (5, 4)):
        got = [tuple(r) for r in collocations(docs, max_words=most, min_count=least).orderBy("lang", "rank").collect()]
        assert got == plain_collocations(rows, most, least)
    hard = [(r.lang, r.text) for r in nasty.collect()]
    assert [tuple(r) for r in collocations(nasty).orderBy("lang", "rank").collect()] == plain_collocations(hard)
    assert collocations(empty).count() == 0


def test_scores_beyond_64_bits(spark):
    a = 3_000_000_000_000_001
    rows = [(a, a, a), (a, a + 7, 2 * a), (10, 10, 3 * a), (a - 1, a, a)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select(floor_ratio(F.col("a"), F.col("l"), F.col("r"))).collect()
    assert [r[0] for r in got] == [1_000_000 * x * x // (y * z) for x, y, z in rows]
