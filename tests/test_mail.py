import pytest

from threadlake.sources.mail import MAX_DEPTH, parse_files, parsed, scan


def framed(text: str, count: int | None = None) -> bytes:
    body = text.encode()
    return f"{len(body) if count is None else count}\n".encode() + body + b"\n<plist/>"


MIXED = """Message-ID: <m1@x>
From: =?utf-8?Q?J=C3=BCrgen?= <j@x.de>
Subject: a
 folded subject
Date: Mon, 01 Jan 2024 10:00:00 +0100 (CET)
References: <a@x> <b@x>
List-Id: news
Content-Type: multipart/mixed; boundary="B;1"

preamble
--B;1
Content-Type: multipart/alternative; boundary=alt

--alt
Content-Type: text/html

<p>html</p>
--alt
Content-Type: text/plain; charset=utf-8
Content-Transfer-Encoding: quoted-printable

Gr=C3=BC=C3=9Fe
--alt--
--B;1
Content-Type: application/pdf; name="x.pdf"
Content-Transfer-Encoding: base64

aGVsbG8=
--B;1--
"""


def test_mixed():
    got = parsed(framed(MIXED))
    assert [t["text"] for t in got["texts"]] == ["Grüße"] and got["sender"] == "Jürgen <j@x.de>" and got["subject"] == "a folded subject"
    assert got["date_unix"] == 1704099600 and got["references"] == ["a@x", "b@x"] and got["list_id"] == "news"
    assert got["attachments"] == [{"filename": "x.pdf", "size": 5, "text": None}]
    assert parsed(framed(MIXED), lambda data: data.decode().upper())["attachments"][0]["text"] == "HELLO"


def mail(body: str, heads: str = "") -> bytes:
    return framed(f"Message-ID: <m@x>\n{heads}{body}")


def test_departures():
    part = "--b\nContent-Type: {}\n\n{}\n"
    get = lambda body: [t["text"] for t in parsed(mail(body))["texts"]]
    head = "Content-Type: multipart/{}; boundary=b\n\n"
    assert get(head.format("mixed") + part.format("text/plain", "one") + "--b--\n" + part.format("text/plain", "after")) == ["one"]
    assert get(head.format("alternative") + part.format("image/png", "x") + "--b--") == []
    assert get(head.format("mixed") + "--b\nContent-Type: text/plain\nContent-Disposition: attachment\n\nkept\n--b--") == ["kept"]
    got = parsed(mail(head.format("mixed") + "--b\nContent-Type: application/octet-stream\nContent-Disposition: attachment; filename=A.PDF\n\nabc\n" + part.format("application/pdf", "") + "--b--"))
    assert got["attachments"] == [{"filename": "A.PDF", "size": 3, "text": None}] and got["skipped"] == []
    assert parsed(mail("\nx", "Subject: =?utf-8?b?abcde?=\n"))["subject"] == "=?utf-8?b?abcde?="


def test_visible_text(spark):
    page = "Content-Type: text/html\n\n<style>p{}</style><p>a &amp; b</p><script>evil()</script><p>Click to unsubscribe</p>"
    forward = "\nHi\n\nBegin forwarded message:\n\nFrom: Ann <ann@x.org>\nSubject: s\n\nthe text"
    rows = [(1, mail(page)), (2, mail(forward)), (3, mail("\n \n")), (4, mail("\nx", "Date: Mon, 99 Foo\n"))]
    df = spark.createDataFrame([(f"/v/INBOX.mbox/{i}.emlx", bytearray(c)) for i, c in rows], "path string, content binary")
    got = {r.source_id: r for r in parse_files(df).collect()}
    assert got[1].body_text == "a & b" and got[1].original_sender is None
    assert got[2].body_text == "Hi\n\nthe text" and got[2].original_sender == "Ann <ann@x.org>"
    assert got[3].body_text == "" and got[4].error is None and got[4].date_unix == 0


def test_nothing_ends_the_job(spark, monkeypatch):
    from threadlake.sources import mail as module

    def broken(data, extract):
        raise RecursionError("deep")

    monkeypatch.setattr(module, "parsed", broken)
    df = spark.createDataFrame([("/v/INBOX.mbox/1.emlx", bytearray(b"x"))], "path string, content binary")
    assert next(iter(module.parse_files(df).collect())).error is not None


@pytest.mark.parametrize("bad", [b"no newline", b"x\nabc", b"99\nabc", framed("".join(f"Content-Type: multipart/mixed; boundary=b{i}\n\n--b{i}\n" for i in range(MAX_DEPTH + 2)))])
def test_bad_files(bad):
    with pytest.raises(ValueError):
        parsed(bad)


def test_dead_letters(spark):
    df = spark.createDataFrame([("/v/INBOX.mbox/1.emlx", bytearray(framed(MIXED))), ("/v/INBOX.mbox/2.emlx", bytearray(b"junk"))], "path string, content binary")
    got = {r.source_id: r for r in parse_files(df).collect()}
    assert got[1].error is None and got[1].message_id == "m1@x" and got[2].error == "no count line" and got[2].body_text is None


def test_scan_prefers_whole_files(spark):
    paths = ["/v/INBOX.mbox/7.partial.emlx", "/v/INBOX.mbox/7.emlx", "/v/Trash.mbox/8.emlx", "/v/Sent.mbox/9.partial.emlx", "/v/Sent.mbox/readme.emlx"]
    df = spark.createDataFrame([(p, 1, 2) for p in paths], "path string, length long, mtime long")
    assert sorted((r.source_id, r.path) for r in scan(df).collect()) == [(7, "/v/INBOX.mbox/7.emlx"), (9, "/v/Sent.mbox/9.partial.emlx")]
