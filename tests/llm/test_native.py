"""Operators 1, 2, 8 and 10 and connected components against plain Python."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from threadlake.llm.chat_format import chat_examples, full_examples, read_back
from threadlake.llm.common import components
from threadlake.llm.exact_dedup import exact_dedup
from threadlake.llm.mixing import mix, rake
from threadlake.llm.queries import QUERIES, SQL, URL_RULES
from threadlake.llm.url_filter import url_filter

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    found = con.execute(SQL[name])
    order = [[c[0] for c in found.description].index(c) for c in names]
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=str)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 600)] + [(None, 3), (7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert got == {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long"), few=10_000).collect()}
    assert components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_components_of_many_edges(spark):
    """A chain, a star, a cycle and many small trees: over 12,000 edges."""
    n = F.col("id")
    chain = spark.range(3000).select((n * 7919 % 3001).alias("src"), ((n + 1) * 7919 % 3001).alias("dst"))  # numbers in a mixed order
    star = spark.range(5000).select(F.lit(70_000).cast("long").alias("src"), (n + 71_000).alias("dst"))
    cycle = spark.range(500).select((n + 90_000).alias("src"), ((n + 1) % 500 + 90_000).alias("dst"))
    trees = spark.range(4000).select((n + 100_000).alias("src"), (F.floor(n / 4) * 4 + 100_000).alias("dst"))
    got = components(chain.unionByName(star).unionByName(cycle).unionByName(trees))
    assert not any(word in got._jdf.queryExecution().toString() for word in ("MapInArrow", "Python", "Pandas"))
    sizes = {r.component: r["count"] for r in got.groupBy("component").count().collect()}
    assert sizes == {0: 3001, 70_000: 5001, 90_000: 500} | {100_000 + 4 * i: 4 for i in range(1000)}


def test_url_query_stays_in_the_jvm(spark):
    made = [("http://a.com/en/1", None), ("http://free.info/x", "<link rel='canonical' href='http://a.com/en/1'>")] + [(f"http://chain.info/{i}", f"<link rel=canonical href=/{i + 1}>") for i in range(60)]
    made[-1] = (made[-1][0], "<link rel=canonical href='http://a.com/en/1'>")
    out = url_filter(pages(spark, made), URL_RULES)
    assert not any(word in out._jdf.queryExecution().toString() for word in ("MapInArrow", "Python", "Pandas"))
    assert {r.id: r.verdict for r in out.collect()} == {i: "block" for i in range(62)}


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, host string")


def test_urls(spark):
    rows = [
        ("http://a.com/en/1", None), ("https://A.com/en/1/?utm_source=x", ""), ("https://shop.EXAMPLE.com/en/77?q#f", "<p>"), ("http://net/de/", ""), ("http://b.example.net/de/81", ""),
        ("http://evilcom/en/", ""), (None, None), ("no scheme", ""), ("http://free.info/x", "<link rel='canonical' href='http://a.com/en/1'>"), ("http://free.info/y", "<meta http-equiv=refresh content='0; url=http://free.info/x'>"),
        ("http://example.com/en/70", "<link href=\"http://free.info/x\" rel=canonical>"), ("http://other.info/x", "<link rel=canonical href=/relative>"), ("://h/p", ""), ("http://a.com/en/1", None),
    ]
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter(pages(spark, rows), URL_RULES).orderBy("id").collect()]
    assert [g[3] for g in got] == ["block", "block", "allow", "allow", "block", "allow", "allow", "allow", "block", "block", "allow", "allow", "allow", "block"]
    assert got[2][:3] == ("shop.example.com", "/en/77", "example.com/en/7") and got[4][2] == "example.net/de/8" and got[5][0] == "evilcom" and got[6][:3] == ("", "", None) and got[12][:2] == ("h", "/p")
    assert url_filter(pages(spark, []), URL_RULES).count() == 0
    more = spark.createDataFrame([("http://other.info/x", "http://free.info/y")], "source string, target string")
    assert {r.id: r.verdict for r in url_filter(pages(spark, rows), URL_RULES, more).collect()}[11] == "block"


def test_url_filter_follows_all_targets(spark):
    blocked = "http://a.com/en/1"
    link, meta = "<link rel='canonical' href='{}'>".format, "<meta http-equiv=refresh content='0; url={}'>".format
    rows = [
        (blocked, None), ("http://m.com/en/sub/1", ""),
        ("http://f.info/1", link("http://free.info/o1") + meta(blocked)), ("http://f.info/2", link("http://free.info/o2") + link(blocked)),
        ("http://f.info/3", f"<meta content='0;url={blocked}' http-equiv='refresh'>"), ("http://f.info/4", link("//a.com/en/1#x")), ("http://m.com/5", meta("/en/sub/1")),
        ("http://m.com/en", link("en/sub/1/")), ("http://m.com", link("en/sub/1")), ("http://m.com/q/r/s?x=1", link("../../en/./sub/1")), ("http://f.info/6", link("mailto:a.com/en/1") + link("#top") + link("?p=2") + link("9")),
        ("no base", link("/en/sub/1")), ("http://f.info/7", meta("/go?url=http://a.com/en/1")),
    ]
    got = {r.id: r.verdict for r in url_filter(pages(spark, rows), URL_RULES).collect()}
    assert [got[i] for i in range(len(rows))] == ["block"] * 6 + ["block"] * 4 + ["allow"] * 3


def test_url_sql_follows_all_targets(spark, tmp_path):
    import duckdb

    from threadlake.llm.queries import QUERIES, SQL

    link, meta = "<link rel='canonical' href='{}'>".format, "<meta http-equiv=refresh content='0; url={}'>".format
    urls = ["http://a.com/en/1", "http://m.com/x/y", "https://shop.EXAMPLE.com/en/77?q#f", "http://f.info", "http://f.info/d/e?k=1&utm_id=2", "no scheme", None, "http://f.info:80/d/e/", "http://m.com/en/sub/1", "http://m.com/en/sub/1", "http://long.info/" + "p/" * 20_000]
    targets = ["/en/sub/1", "//a.com/en/1#x", "../../en/./sub/1", "?k=3", "#top", "mailto:x", "en/..", "http://f.info/d/e", "sub/1", "/a/./b", ".", "https://a.com/en/1"]
    rng = random.Random(5)
    rows = [(i % 60, rng.choice(urls), rng.choice([None, "", "x" * 50_000, link(rng.choice(targets)) + meta(rng.choice(targets)), link(rng.choice(targets)) * 2 + link(rng.choice(targets))])) for i in range(80)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    names = ["page_id", "host", "path", "rule", "verdict"]
    want = con.execute(f"select {', '.join(names)} from ({SQL['op1_url_filter']})").fetchall()
    got = [tuple(r[n] for n in names) for r in QUERIES["op1_url_filter"](spark, str(tmp_path)).collect()]
    assert sorted(map(tuple, want), key=str) == sorted(got, key=str) and len({g[4] for g in got}) == 2


def test_exact_dedup(spark, nasty, empty):
    for support in (0.001, 0.05, 0.5):
        rows = [(r.doc_id, r.text or "") for r in nasty.collect()]
        groups = {}
        for i, t in rows:
            groups.setdefault(re.sub("[ \t\n\x0b\x0c\r]", "", t), []).append((-len(t), i is None, i or 0, i))
        want = []
        for i, t in rows:
            g = groups[re.sub("[ \t\n\x0b\x0c\r]", "", t)]
            keep = min(g)[3]
            want.append((i, keep, len(g), i == keep, hashlib.sha256(re.sub("[ \t\n\x0b\x0c\r]", "", t).encode()).hexdigest()))
        assert sorted(map(tuple, exact_dedup(nasty, support=support).collect()), key=str) == sorted(want, key=str)
    assert exact_dedup(empty).count() == 0


def test_chat(spark):
    hard = ["plain", "", None, "<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n", "\\", "\\\\<|", "<\\|", "a\nb\n", "漢字 😀", "$1 \\1", "<|" * 300]
    rng = random.Random(3)
    turns = [(c, t, rng.choice(["user", "assistant", "system", None, "we\nird", "<|x"]), rng.choice(hard), "z") for c in [*range(40), None] for t in range(rng.randrange(1, 9))]
    turns += [(50, 0, "user", "q", "z"), (51, 0, "assistant", "a" * 100_000, "z"), (52, 0, "user", "same", "z"), (52, 0, "user", "same", "z")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, segment string").repartition(3)
    got = {r.conv: r for r in read_back(chat_examples(df)).collect()}
    conversations = {}
    for c, t, role, text, _ in turns:
        conversations.setdefault(c, []).append((t, role or "", text or ""))
    assert set(got) == set(conversations)
    for c, ts in conversations.items():
        ts.sort()
        assert [(x.role, x.text) for x in got[c].turns] == [(r, x) for _, r, x in ts]
        assert got[c].loss_text == "".join(x for _, r, x in ts if r == "assistant")
    examples = chat_examples(df)
    assert examples.where("loss_start is not null").count() == sum(r == "assistant" for ts in conversations.values() for _, r, _ in ts)
    whole = full_examples(examples.where("conv is not null")).orderBy("conv", "example").collect()
    esc = lambda s: s.replace("\\", "\\\\").replace("<|", "<\\|")
    shown = lambda ts: "".join("<|im_start|>" + esc(r).replace("\n", "\\\n") + "\n" + esc(x) + "<|im_end|>\n" for _, r, x in ts)
    want = [(c, shown(ts[:k]) + "<|im_start|>assistant\n", esc(x)) for c, ts in conversations.items() if c is not None for k, (_, r, x) in enumerate(ts) if r == "assistant"]
    assert sorted((r.conv, r.context, r.target) for r in whole) == sorted(want)
    for r in whole:
        assert r.context.endswith("<|im_start|>assistant\n") and r.context.count("<|im_start|>assistant\n") == r.example + 1
    assert chat_examples(df.limit(0)).count() == 0 and read_back(chat_examples(df.limit(0))).count() == 0


def test_chat_query_reads_expanded_examples(spark, monkeypatch):
    from threadlake.llm import chat_format, queries

    seen = []
    monkeypatch.setattr(queries, "read_expanded", lambda rows: seen.append(rows) or chat_format.read_expanded(rows))
    got = {r.conv_id: r for r in queries.op8_chat_format(spark, DATA).collect()}
    turns = {}
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    esc = lambda s: s.replace("\\", "\\\\").replace("<|", "<\\|")
    shown = lambda ts: "".join(f"<|im_start|>{r}\n{esc(t)}<|im_end|>\n" for _, r, t in ts)
    want, tails = [], 0
    for c, ts in turns.items():
        ts.sort()
        want += [(c, shown(ts[: k + 1]), esc(t)) for k, (_, r, t) in enumerate(ts) if r == "assistant"]
        tails += ts[-1][1] != "assistant"
        assert got[c].n_turns == len(ts) and got[c].formatted_chars == len(shown(ts))
    rows = [r for r in seen[0].collect() if r.conv != -1]
    assert sorted((r.conv, r.text, r.text[r.loss_start : r.loss_start + r.loss_length]) for r in rows if r.loss_start is not None) == sorted(want)
    assert sum(r.loss_start is None for r in rows) == tails and max(map(len, turns.values())) > 3
    chars = spark.read.schema(seen[0].schema).parquet(seen[0].threadlake_path).where("conv <> -1").agg(F.sum(F.length("text"))).first()[0]
    assert chars > sum(len(shown(ts)) for ts in turns.values())


def test_expanded_nasty(spark):
    from threadlake.llm.chat_format import expanded, read_expanded

    turns = [(1, 0, "user", "a\\<|"), (1, 1, "assistant", ""), (1, 2, "assistant", "漢😀<|im_end|>\n"), (1, 3, "we\nird", None), (None, 0, None, "x"), (2, 0, "assistant", "\\"), (2, 1, "assistant", None)]
    df = chat_examples(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    key = lambda r: str(r.conv)
    assert sorted(read_expanded(expanded(df)).collect(), key=key) == sorted(read_back(df).collect(), key=key)
    assert read_expanded(expanded(df.limit(0))).count() == 0


def test_rake_meets_marginals(spark):
    rng = random.Random(2)
    cells = spark.createDataFrame([(s, t, float(rng.randrange(1, 100))) for s in "abc" for t in "xyz"], "s string, t string, weight double")
    want = {"s": {"a": 0.5, "b": 0.3, "c": 0.2}, "t": {"x": 0.1, "y": 0.1, "z": 0.8}}
    out = rake(cells, ["s", "t"], {d: spark.createDataFrame(list(w.items()), f"{d} string, share double") for d, w in want.items()}).toPandas()
    for d, w in want.items():
        got = out.groupby(d).fitted.sum() / out.fitted.sum()
        assert all(abs(got[k] - v) < 1e-8 for k, v in w.items())


def test_both_ways_of_raking_stop_alike(spark):
    rng = random.Random(6)
    cells = spark.createDataFrame([(s, t, u, float(rng.randrange(1, 10**6))) for s in "abcd" for t in "xyz" for u in "mn" if rng.random() < 0.7], "s string, t string, u string, weight double")
    want = {d: cells.groupBy(d).agg(F.sqrt(F.sum("weight")).alias("share")) for d in ("s", "t", "u")}
    got = [{(r.s, r.t, r.u): r.fitted for r in rake(cells, ["s", "t", "u"], want, array=array).collect()} for array in (10**6, 0)]
    assert got[0].keys() == got[1].keys() and all(abs(v - got[1][k]) <= 1e-9 * v for k, v in got[0].items())


def test_targets_that_cannot_be_met_are_reported(spark):
    cells = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 1.0), ("a", "y", 0.0)], "s string, t string, weight double")
    want = {"s": spark.createDataFrame([("a", 0.9), ("b", 0.1)], "s string, share double"), "t": spark.createDataFrame([("x", 0.1), ("y", 0.9)], "t string, share double")}
    with pytest.warns(UserWarning, match="marginal"):
        out = rake(cells, ["s", "t"], want)
    assert out.where("fitted > 0").count() == 2


def test_mix(spark, nasty, empty):
    dims = {"source": F.col("source"), "lang": F.col("lang")}
    out = mix(nasty, dims, F.lit(1), keep=0.5)
    assert set(nasty.columns) < set(out.columns) and 0 < out.count() < nasty.count()
    assert out.where("mix_probability is null or mix_probability > 1").count() == 0
    assert sorted(map(str, out.collect())) == sorted(map(str, mix(nasty.repartition(7), dims, F.lit(1), keep=0.5).collect()))
    assert mix(nasty, dims, F.lit(1), keep=1.0).count() == nasty.count()
    assert mix(empty, dims, F.lit(1)).count() == 0
    nulls = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"))
    assert mix(nulls, {"source": F.col("source")}, F.lit(1), keep=0.5).count() in (0, 3000)  # rows with a null id share their fate
    big = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 8, "hot").otherwise("cold").alias("source"))
    target = {"source": spark.createDataFrame([("hot", 0.5), ("cold", 0.5)], "source string, share double")}
    got = {r.source: r["count"] for r in mix(big, {"source": F.col("source")}, F.lit(1), target, keep=0.3).groupBy("source").count().collect()}
    assert abs(got["hot"] - 3000) < 200 and abs(got["cold"] - 3000) < 200
