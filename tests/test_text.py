import time

from pyspark.sql import functions as F

from threadlake.functions import text as X
from threadlake.functions.mime import quoted_printable


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).first().r


def test_html_to_text(spark):
    html = "<html><head><title>T</title></head><body><script>x<y</script><p>One &amp; two</p><!-- c --><div>Three<br>four</div></body></html>"
    assert one(spark, X.html_to_text, html) == "One & two\n\nThree\n\nfour"
    assert one(spark, X.html_to_text, "") == ""


def test_html_hard_shapes_are_fast(spark):
    start = time.time()
    for bad in ("<" * 50_000, "<script>" * 20_000, "<!--" * 20_000, "&#x" * 50_000):
        one(spark, X.html_to_text, bad)
    assert time.time() - start < 40


def test_entities_are_decoded_once(spark):
    got = one(spark, X.decode_entities, "&amp;lt; &lt;b&gt; &copy; &#65;&#x1F600; &#x110000; &#xD800; & &;&euro")
    assert got == "&lt; <b> &copy; A😀 &#x110000; &#xD800; & &;&euro"


def test_truncation_ends_between_characters(spark):
    assert one(spark, lambda c: X.truncated_utf8(c, 5), "aé漢字") == "aé"
    assert one(spark, lambda c: X.truncated_utf8(c, 50), "aé漢字") == "aé漢字"


def test_boilerplate(spark):
    assert one(spark, X.strip_boilerplate, "Hello\n\nClick to unsubscribe\n\nBye") == "Hello\n\nBye"


def test_senders(spark):
    cases = {"Ann <Ann@Mail.Shop.de>": ("ann@mail.shop.de", "shop"), "x@y": ("x@y", "y"), '"Just Name"': (None, "Just Name"), "Broken <b@c.org": ("b@c.org", "c")}
    for raw, (address, label) in cases.items():
        assert one(spark, X.sender_address, raw) == address, raw
        assert one(spark, X.sender_domain, raw) == label, raw
    assert one(spark, lambda c: X.excluded(c, ["shop.de", " "]), "a@mail.shop.de")
    assert not one(spark, lambda c: X.excluded(c, ["shop.de"]), "a@eshop.de")
    assert not one(spark, lambda c: X.excluded(c, ["shop.de"]), "no address")


def test_forwarded_sender(spark):
    assert one(spark, X.original_sender, "hi\n--- Original Message ---\nDate: x\nVon: No\nFROM: Bo <bo@x.de>\n") == "Bo <bo@x.de>"
    assert one(spark, X.original_sender, "From: Bo <bo@x.de>") is None


def test_links_and_stamps(spark):
    assert [one(spark, X.link_action, u) for u in ("Message://a", "HTTPS://x", "mailto:1", "plain")] == ["open", "confirm", "block", "block"]
    assert tuple(one(spark, X.stamp, "a@b@384")) == ("a@b", 384)
    assert one(spark, X.stamp, "nothing") is None


def test_quoted_printable(spark):
    assert one(spark, quoted_printable, "a=3Db =C3=A9=\nx = y =ZZ é") == "a=b éx = y =ZZ é"


def test_message_url(spark):
    assert one(spark, X.message_url, "a b@c/d") == "message://%3Ca%20b@c%2Fd%3E"


def test_html_long_bodies(spark):
    body = "<script>" + "x = '<b>' + 1;\n" * 100_000 + "</script><!--" + "c-\n" * 50_000 + "--><p>end</p>"
    assert one(spark, X.html_to_text, body) == "end"
