"""Mail files on disk: early size cap, incremental runs, and a stream that may die anywhere."""

import os
import random

import pytest
from pyspark.sql import functions as F

from threadlake.operators import ingest as I
from threadlake.operators.providers import letter_embedder
from threadlake.sources.commit import Store, Transaction
from threadlake.sources.mail import contents, listing, mail_stream, put_files, small_files


def mail(number, body, count=None):
    data = f"Message-ID: <{number}@x>\nFrom: A <a@x.org>\nSubject: s{number}\nDate: 1 Jan 2024 10:00:00 +0000\n\n{body}".encode()
    return str(len(data) if count is None else count).encode() + b"\n" + data


def put(spark, folder, files):
    rows = [(f"{folder}/INBOX.mbox/{i}.emlx", data) for i, data in files.items()]
    assert put_files(spark.createDataFrame(rows, "path string, content binary")).count() == len(rows)


def tables(store):
    key = lambda name, *cols: sorted(map(str, store.read(name).select(*cols).collect()))
    return key("messages", "source_id", "body_text", "stored_at"), key("chunks", "source_id", "ordinal", "text", "vec"), key("failures", "source_id", "error"), key("files", "source_id", "fingerprint")


def bodies(rng, n):
    return {i: mail(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(1, 900)))) for i in range(n)}


def test_a_large_file_is_never_opened(spark, tmp_path):
    os.mkfifo(tmp_path / "7.emlx")  # opening it would wait for ever
    (tmp_path / "8.emlx").write_bytes(b"x" * 50)
    rows = [(f"file:{tmp_path}/7.emlx", 1000, "more"), (f"file:{tmp_path}/8.emlx", 50, "more"), (f"file:{tmp_path}/9.emlx", 5, None), (f"file:{tmp_path}/8.emlx", 3, "grown")]
    got = contents(spark.createDataFrame(rows, "path string, length long, tag string"), most=60).collect()
    assert sorted((r.path[-6:], r.length, r.tag or "", r.error or "", bytes(r.content or b"")) for r in got) == sorted([
        ("7.emlx", 1000, "more", "file too large", b""), ("8.emlx", 50, "more", "", b"x" * 50), ("9.emlx", 5, "", "unreadable: FileNotFoundError", b""), ("8.emlx", 3, "grown", "", b"x" * 50)])
    grown = contents(spark.createDataFrame([(f"file:{tmp_path}/8.emlx", 3)], "path string, length long"), most=40).first()
    assert grown.error == "file too large" and grown.content is None  # it has grown since it was listed


def test_runs_take_new_and_changed_files_alone(spark, tmp_path):
    rng, folder = random.Random(1), f"file:{tmp_path}/mail"
    files = bodies(rng, 12) | {20: mail(20, "bad", count=0), 21: b"no count", 22: mail(22, "x" * 9000), 23: mail(23, "")}
    put(spark, folder, files)
    store = Store(spark, f"{tmp_path}/store")
    run = lambda now: I.ingest(store, listing(spark, folder), now, most=8000)
    assert run(1) == 16
    messages, chunks, failures, known = tables(store)
    assert len(messages) == len(known) == 13 and len(failures) == 3
    assert store.read("chunks").where("source_id = 23").count() == 0
    assert run(2) == 3  # the failed ones alone
    assert tables(store)[0] == messages and tables(store)[1] == chunks
    put(spark, folder, {3: mail(3, "short now"), 20: mail(20, "mended"), 30: mail(30, "new")})
    assert run(3) == 5
    got = {r.source_id: (r.body_text, r.stored_at) for r in store.read("messages").collect()}
    assert got[3] == ("short now", 3) and got[20] == ("mended", 3) and got[30] == ("new", 3) and got[4][1] == 1
    assert [r.text for r in store.read("chunks").where("source_id = 3").collect()] == ["short now"]
    assert {r.source_id: r.failed_at for r in store.read("failures").collect()} == {21: 3, 22: 3}


def test_a_message_that_cannot_be_embedded_is_a_dead_letter_as_a_whole(spark, tmp_path):
    folder = f"file:{tmp_path}/mail"
    put(spark, folder, {1: mail(1, "fine"), 2: mail(2, "word " * 1500 + "poison")})

    def embed(texts):
        if any("poison" in t for t in texts):
            raise ValueError("cannot")
        return letter_embedder(texts)

    store = Store(spark, f"{tmp_path}/store")
    assert I.ingest(store, listing(spark, folder).repartition(2, "path"), 1, embed) == 2
    left = {r.source_id for r in store.read("messages").collect()}
    assert 2 not in left and {r.source_id for r in store.read("chunks").collect()} == left
    assert I.ingest(store, listing(spark, folder), 2) == 2 - len(left)
    assert {r.source_id for r in store.read("messages").collect()} == {1, 2} and store.read("failures").count() == 0


def test_runs_over_new_files_write_their_own_rows_alone(spark, tmp_path):
    """New files leave the folders of earlier runs as they are; a changed one does not, and its older rows go."""
    folder, store = f"file:{tmp_path}/mail", Store(spark, f"{tmp_path}/store")
    run = lambda now: I.ingest(store, listing(spark, folder), now)
    for now in (1, 2, 3):
        put(spark, folder, {i: mail(i, f"text {i}") for i in range(10 * now, 10 * now + 4)})
        assert run(now) == 4
    folders = store.latest()[1]
    assert {name: len(paths) for name, paths in folders.items()} == dict.fromkeys(I.TABLES, 3)
    assert [spark.read.parquet(p).count() for p in folders["chunks"]] == [4, 4, 4]
    assert {r.source_id: r.stored_at for r in store.read("messages").collect()} == {i: i // 10 for k in (10, 20, 30) for i in range(k, k + 4)}
    put(spark, folder, {11: mail(11, "short"), 40: mail(40, "new", count=0)})
    assert run(4) == 2
    assert sorted(r.source_id for r in store.read("messages").collect()) == [i for k in (10, 20, 30) for i in range(k, k + 4)]
    assert [(r.text, r.source_id) for r in store.read("chunks").where("source_id in (11, 40)").collect()] == [("short", 11)]
    put(spark, folder, {40: mail(40, "mended")})
    assert run(5) == 1 and store.read("failures").count() == 0 and store.read("files").count() == 13


def test_small_files_share_tasks(spark, tmp_path):
    """Listed a few thousand to a task, opened some hundreds to a task; the settings are as before afterwards."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    with pytest.raises(ValueError), small_files(spark):
        assert int(spark.conf.get(key)) < 100
        raise ValueError
    assert spark.conf.get(key) == before
    rows = spark.range(1000).select(F.concat(F.lit(f"file:{tmp_path}/"), "id", F.lit(".emlx")).alias("path"), F.lit(10).cast("long").alias("length"))
    assert 3 <= contents(rows).select(F.spark_partition_id().alias("p")).distinct().count() <= 5


@pytest.mark.parametrize("text", ["", "a", "häß 👍🏽" * 50, "\0\uffff"])
def test_letters_are_counted_by_code_point(text):
    v = [0.0] * 32
    for ch in text:
        v[ord(ch) % 32] += 1.0
    norm = sum(x * x for x in v) ** 0.5
    assert letter_embedder([text]) == [[x / norm for x in v] if norm else v]


@pytest.mark.parametrize("step", ["files", "publish"])
def test_a_stream_that_dies_leaves_the_rows_of_a_clean_run(spark, tmp_path, monkeypatch, step):
    """Killed before the fingerprints are staged, or before the commit; the batch comes again."""
    folder = f"file:{tmp_path}/mail"
    put(spark, folder, bodies(random.Random(2), 9) | {40: mail(40, "bad", count=0)})

    def run(store, mark):
        stream = mail_stream(spark, folder, most_files=4).writeStream.option("checkpointLocation", f"{tmp_path}/{mark}").trigger(availableNow=True)
        stream.foreachBatch(I.ingesting(store, lambda: 5)).start().awaitTermination()

    clean, store = Store(spark, f"{tmp_path}/clean"), Store(spark, f"{tmp_path}/store")
    run(clean, "clean-mark")
    calls = {"n": 0}

    def dies(plain, this):
        def wrapped(self, *args):
            calls["n"] += this(*args)
            if calls["n"] == 2 and this(*args):  # in the second batch
                raise RuntimeError("killed")
            return plain(self, *args)
        return wrapped

    with monkeypatch.context() as m:
        if step == "files":
            m.setattr(Transaction, "write", dies(Transaction.write, lambda name, _: name == "files"))
        else:
            m.setattr(Transaction, "publish", dies(Transaction.publish, lambda: True))
        with pytest.raises(Exception, match="killed"):
            run(store, "mark")
    assert 0 < store.read("messages").count() < 9
    run(store, "mark")
    assert tables(store) == tables(clean)
    I.ingesting(store, lambda: 9)(listing(spark, folder).where(F.lit(True)), 7)  # all files once more: nothing but the failed one
    assert tables(store)[:2] == tables(clean)[:2]
