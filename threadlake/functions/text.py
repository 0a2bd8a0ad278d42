"""Text functions as Spark columns; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The paragraph patterns that count as boilerplate (English and German).
BOILERPLATE = [
    "unsubscribe", "abmelden", "abbestellen", "sie erhalten diese e-?mail", "you (are receiving|received) this",
    "view (this email )?in (your )?browser", "im browser (ansehen|anzeigen|öffnen)", "manage (your )?(email )?preferences", "update your preferences",
]
# Named entities and what they stand for.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "auml": "ä", "ouml": "ö", "uuml": "ü",
    "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü", "szlig": "ß", "euro": "€",
}
# Schemes that open at once, and those that ask first.
OPENED, CONFIRMED = ["message"], ["https", "http"]
MAX_HTML_BYTES = 2 * 1024 * 1024
# The blanks and line ends that do not count at a text's ends.
EDGES = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# What has to be in a text, in lower case, for a boilerplate pattern to fit.
BOILERPLATE_SIGNS = ["unsubscribe", "abmelden", "abbestellen", "sie erhalten diese e", "you are receiving this", "you received this", "browser", "preferences"]


def terms(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits; repeated terms stay."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda t: t != "")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.floor((F.length(text) + 3) / 4).cast("long")


def truncated_utf8(text: Column, most: int = MAX_HTML_BYTES) -> Column:
    """The longest prefix of at most ``most`` UTF-8 bytes that ends between characters."""
    cut = F.substring(F.encode(text, "UTF-8"), 1, most)
    # a character that was cut leaves U+FFFD at the end
    clean = F.regexp_replace(F.make_valid_utf8(cut.cast("string")), "�+$", "")
    return F.when(F.octet_length(text) <= most, text).otherwise(clean)


def decode_entities(text: Column) -> Column:
    """Named and numeric entities, in one pass: what a decoded entity yields is not decoded again.

    The text is cut before each ampersand; each piece holds one entity at most,
    so pieces are decoded independently. Unknown entities stay.
    """
    pieces = F.split(text, "(?=&)")

    def decode(piece: Column) -> Column:
        name = F.regexp_extract(piece, "^&([a-zA-Z]{1,11});", 1)
        decimal = F.regexp_extract(piece, "^&#([0-9]{1,10});", 1)
        hexadecimal = F.regexp_extract(piece, "^&#[xX]([0-9a-fA-F]{1,9});", 1)
        table = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])
        named = F.element_at(table, name)
        code = F.when(decimal != "", decimal.cast("long")).when(hexadecimal != "", F.conv(hexadecimal, 16, 10).cast("long"))
        valid = (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        low = F.chr(code % 256)
        utf16 = lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 4, "0")), "UTF-16BE")
        high = F.decode(F.unhex(F.concat(F.lpad(F.hex(F.lit(0xD800) + F.shiftright((code - 0x10000).cast("int"), 10)), 4, "0"), F.lpad(F.hex(F.lit(0xDC00) + (code - 0x10000) % 1024), 4, "0"))), "UTF-16BE")
        number = F.when(code < 128, low).when(code < 0x10000, utf16(code)).otherwise(high)
        rest = F.substr(piece, F.instr(piece, ";") + 1)
        return F.when(named.isNotNull(), F.concat(named, rest)).when(valid, F.concat(number, rest)).otherwise(piece)

    return F.array_join(F.transform(pieces, decode), "")


# Elements and signs that are not visible text, and those that end a paragraph.
UNSEEN = ("script", "style", "head", "title")
PARAGRAPH_ENDS = r"(?i)</(?:p|div|tr|table|ul|ol|li|h[1-6]|blockquote)>|<(?:br|hr)\s*/?>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value taken once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def without_element(tag: str) -> Callable[[Column], Column]:
    """A text without the elements ``tag``, if one is closed anywhere; the guard at each step keeps an unclosed opener from being scanned again and again."""
    pattern = rf"(?is)<{tag}\b[^<>]*>(?:(?!</?{tag}\b).)*+</{tag}>"
    return lambda v: F.when(F.contains(F.lower(v), F.lit(f"</{tag}>")), F.regexp_replace(v, pattern, " ")).otherwise(v)


def html_to_text(html: Column) -> Column:
    """Visible text: blocks without content go, block ends become paragraph breaks, blanks collapse."""
    x = truncated_utf8(html)
    for tag in UNSEEN:
        x = bound(x, without_element(tag))
    x = bound(x, lambda v: F.when(F.contains(v, F.lit("-->")), F.regexp_replace(v, r"(?s)<!--(?:(?!<!--|-->).)*+-->", " ")).otherwise(v))
    x = F.regexp_replace(F.regexp_replace(x, PARAGRAPH_ENDS, "\n\n"), r"<[^<>]+>", "")
    x = bound(x, lambda v: F.when(F.contains(v, F.lit("&")), decode_entities(v)).otherwise(v))
    x = F.regexp_replace(x, r"[ \t]+", " ")
    x = F.regexp_replace(F.regexp_replace(x, r" ?\n ?", "\n"), r"\n{3,}", "\n\n")
    return trimmed(x)


def trimmed(text: Column) -> Column:
    """Without the blanks and line ends of any script around it."""
    return F.btrim(text, F.lit(EDGES))


def strip_boilerplate(text: Column) -> Column:
    """Paragraphs without the ones that match a boilerplate pattern."""
    pattern = "(?i)" + "|".join(BOILERPLATE)

    def signed(low: Column) -> Column:
        found = F.lit(False)
        for sign in BOILERPLATE_SIGNS:
            found = found | F.contains(low, F.lit(sign))
        return found

    kept = lambda v: F.array_join(F.filter(F.split(v, "\n\n"), lambda p: ~p.rlike(pattern)), "\n\n")
    return trimmed(bound(text, lambda v: F.when(bound(F.lower(v), signed), kept(v)).otherwise(v)))


def sender_address(sender: Column) -> Column:
    """The lower-cased address in the last angle brackets, or in the whole; null if there is none."""
    inner = F.regexp_extract(sender, r"<([^<>]*)>?[^<>]*$", 1)
    source = F.when(F.instr(sender, "<") > 0, inner).otherwise(sender)
    found = F.lower(F.regexp_extract(source, r"[^\s<>]+@[^\s<>]+", 0))
    return F.nullif(found, F.lit(""))


def sender_host(sender: Column) -> Column:
    return F.nullif(F.regexp_extract(sender_address(sender), "@(.*)$", 1), F.lit(""))


def sender_domain(sender: Column) -> Column:
    """The organisation's label: the host's label before its last; without an address the name itself."""
    labels = F.split(sender_host(sender), r"\.")
    label = F.when(F.size(labels) >= 2, F.try_element_at(labels, F.lit(-2))).otherwise(F.try_element_at(labels, F.lit(-1)))
    return F.coalesce(label, F.trim(F.replace(sender, F.lit('"'), F.lit(""))))


def excluded(sender: Column, entries: Iterable[str]) -> Column:
    """Whether an exclusion list names the sender: an address exactly, or a host or one of its parents."""
    wanted = [e.strip().lower() for e in entries if e.strip()]
    address, host = sender_address(sender), sender_host(sender)
    hit = F.lit(False)
    for e in wanted:
        hit = hit | ((address == e) if "@" in e else ((host == e) | F.endswith(host, F.lit("." + e))))
    return F.coalesce(hit, F.lit(False))


def normalize_msgid(raw: Column) -> Column:
    """Without blanks and angle brackets around it."""
    return F.regexp_replace(raw, r"^[\s<>]+|[\s<>]+$", "")


def references(raw: Column) -> Column:
    return F.filter(F.transform(F.split(raw, r"\s+"), normalize_msgid), lambda x: x != "")


def link_action(url: Column) -> Column:
    """open, confirm or block, by the scheme."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when(scheme.isin(OPENED), "open").when(scheme.isin(CONFIRMED), "confirm").otherwise("block")


def host_allowed(url: Column, hosts: Iterable[str]) -> Column:
    """Whether a url's host is one of a list, whatever its case, port or user part; null and hostless urls are not."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    return F.coalesce((host != "") & host.isin([h.strip().lower() for h in hosts]), F.lit(False))


def error_text(body: Column, most: int = 300) -> Column:
    """A provider's error body on one line, at most ``most`` characters."""
    return F.substring(F.trim(F.regexp_replace(body, r"[\r\n]+", " ")), 1, most)


def capped(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def decoded_bound(encoding: Column, size: Column) -> Column:
    """An upper bound of a body's decoded bytes."""
    return F.when(F.lower(F.trim(encoding)) == "base64", F.floor(size * 3 / 4)).otherwise(size).cast("long")


# What marks a forwarded message, and the names of the header lines below the mark.
FORWARD_MARKS = "(?i)forwarded message|original message"
FORWARD_HEADERS = "(?i)^(from|to|cc|bcc|date|sent|subject):"
LINE_ENDS = r"\r\n|[\n\x0B\x0C\r\x{85}\x{2028}\x{2029}]"


def original_sender(body: Column) -> Column:
    """Of a forwarded message the sender that the first From line within ten lines of a marker names; null otherwise."""
    lines = F.split(body, LINE_ENDS)

    def below(line: Column, at: Column) -> Column:
        heads = F.filter(F.slice(lines, at + 2, 10), lambda x: x.rlike("(?i)^[ \t]*from:"))
        return F.when(line.rlike(FORWARD_MARKS), F.get(heads, 0))

    found = F.get(F.array_compact(F.transform(lines, below)), 0)
    return F.nullif(F.regexp_extract(found, r"^[ \t]*[^:]*:[ \t]*(.*?)[ \t]*$", 1), F.lit(""))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def strip_forward_header(body: Column) -> Column:
    """Without the first marker line and the header lines below it (and the blank lines around those); verbatim without a marker."""
    first = lambda items, test: F.array_position(F.transform(items, test), F.lit(True)).cast("int")
    blank = lambda x: F.trim(F.replace(x, F.lit("\t"), F.lit(" "))) == ""
    below = lambda items, at: F.slice(items, at, F.size(items))
    none = F.array().cast("array<string>")

    def end(heads: Column) -> Column:
        """What follows the header lines, and a blank line below them."""
        rest = lambda at: F.when(at == 0, none).otherwise(bound(below(heads, F.greatest(at, F.lit(1))), lambda r: F.when(blank(F.get(r, 0)), below(r, F.lit(2))).otherwise(r)))
        return bound(first(heads, lambda x: blank(x) | ~F.trim(x).rlike(FORWARD_HEADERS)), rest)

    def unmarked(lines: Column, mark: Column) -> Column:
        heads = lambda after: bound(first(after, lambda x: ~blank(x)), lambda at: F.when(at > 0, below(after, F.greatest(at, F.lit(1)))).otherwise(none))
        rest = bound(bound(below(lines, mark + 1), heads), end)
        return trimmed(F.array_join(F.concat(F.slice(lines, 1, mark - 1), rest), "\n"))

    cut = lambda lines: bound(first(lines, lambda x: x.rlike(FORWARD_MARKS)), lambda mark: F.when(mark > 0, unmarked(lines, F.greatest(mark, F.lit(1)))).otherwise(body))
    return bound(F.split(body, LINE_ENDS), cut)


def quoted_sender(selection: Column, most: int = 20_000) -> Column:
    """The address in brackets on a selection's first line (of at most 300 characters)."""
    line = F.get(F.split(F.substring(F.ltrim(selection), 1, most), "\n"), 0)
    found = F.regexp_extract(line, r"<([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})>", 1)
    return F.when((F.length(line) <= 300) & (found != ""), F.lower(found))


def squeezed(text: Column) -> Column:
    """Lower case with every run of blanks as one space."""
    return F.trim(F.lower(F.regexp_replace(text, r"\s+", " ")))


def stamp(raw: Column) -> Column:
    """``model@dimensions``, divided at the last @; null if it is not a stamp."""
    model, size = F.regexp_extract(raw, "^(.+)@([0-9]+)$", 1), F.regexp_extract(raw, "^(.+)@([0-9]+)$", 2)
    return F.when(model != "", F.struct(model.alias("model"), size.cast("int").alias("dimensions")))


def same_model(a: Column, b: Column) -> Column:
    """Names are equal with ``:latest`` where no tag is given."""
    full = lambda m: F.when(F.instr(m, ":") > 0, m).otherwise(F.concat(m, F.lit(":latest")))
    return full(a) == full(b)


def mailbox_of(path: Column) -> Column:
    """The first path component that ends in .mbox, without that."""
    return F.nullif(F.regexp_extract(path, r"(?:^|/)([^/]*)\.mbox(?:/|$)", 1), F.lit(""))


def date_text(seconds: Column) -> Column:
    """yyyy-MM-dd in UTC, whatever the session's zone."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")), "yyyy-MM-dd")


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz")).cast("long")


# Seconds from 1970 to 2001, and the advisor's tokens for each free GB, step, bounds and answers.
COCOA_EPOCH = 978_307_200
PER_GB, STEP, FEWEST, MOST_TOKENS, LONG_CONTEXT, LONG_ANSWER, SHORT_ANSWER = 1000, 512, 2048, 16384, 8192, 1000, 800


def cocoa_seconds(seconds: Column) -> Column:
    """Seconds since 2001 of seconds since 1970."""
    return seconds - COCOA_EPOCH


def token_advice(free_gb: Column) -> tuple[Column, Column]:
    """``(context, answer)`` tokens for so much free memory: in whole steps, within bounds."""
    context = F.least(F.greatest(F.floor(free_gb * PER_GB / STEP + 0.5) * STEP, F.lit(FEWEST)), F.lit(MOST_TOKENS)).cast("long")
    return context, F.when(context >= LONG_CONTEXT, LONG_ANSWER).otherwise(SHORT_ANSWER)


def guarded(text: Column, most_chars: int, most_bytes: int) -> tuple[Column, Column]:
    """Whether a text has more characters, and more UTF-8 bytes, than that; null for a null text."""
    return F.length(text) > most_chars, F.octet_length(text) > most_bytes


def mail_date(value: Column) -> Column:
    """Seconds since 1970 of a mail's date (weekday optional, seconds optional with a weekday, a comment behind it dropped); null if it is none."""
    bare = F.trim(F.regexp_replace(value, r"\(.*$", ""))
    day = F.regexp_extract(bare, r"^(?:[A-Za-z]{3},\s*)?([0-9]{1,2} [A-Za-z]{3} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2} [+-][0-9]{4})$", 1)
    short = F.regexp_extract(bare, r"^[A-Za-z]{3},\s*([0-9]{1,2} [A-Za-z]{3} [0-9]{4} [0-9]{2}:[0-9]{2} [+-][0-9]{4})$", 1)
    at = F.coalesce(F.try_to_timestamp(F.nullif(day, F.lit("")), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.nullif(short, F.lit("")), F.lit("d MMM yyyy HH:mm Z")))
    return F.unix_seconds(at)


# Signs that a message link keeps as they are.
LINK_SIGNS = "-._~@+!$&'()*,;="


def message_url(message_id: Column) -> Column:
    """``message:`` link with the id in percent-encoded brackets."""
    out = F.replace(F.url_encode(message_id), F.lit("+"), F.lit("%20"))
    for sign in LINK_SIGNS:
        out = F.replace(out, F.lit(f"%{ord(sign):02X}"), F.lit(sign))
    return F.concat(F.lit("message://%3C"), out, F.lit("%3E"))
