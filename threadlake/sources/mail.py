"""Mail files: listing, framing, MIME parsing."""

from __future__ import annotations

import base64
import binascii
import email.header
import quopri
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC
from email.errors import MessageError
from email.utils import parsedate_to_datetime

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.functions.text import html_to_text, mailbox_of, original_sender, strip_boilerplate, strip_forward_header, trimmed

# Limits, and the mailboxes that are read.
MAX_FILE, MAX_ATTACHMENT, MAX_DEPTH = 100 * 1024 * 1024, 25 * 1024 * 1024, 32
MAILBOXES = ["inbox", "sent", "sent items", "sent messages"]
RECORD = """path string, source_id long, error string, message_id string, subject string, sender string, recipient string, date_unix long, texts array<struct<kind:string,text:string>>,
 in_reply_to string, references array<string>, list_unsubscribe string, list_id string, precedence string, auto_submitted string,
 attachments array<struct<filename:string,size:long,text:string>>, skipped array<string>"""


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """While it lasts, files are looked up and listed some thousands to a task; else Spark makes a task for each path, and one for 32 files."""
    wanted = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(4 * spark.sparkContext.defaultParallelism), "spark.sql.files.openCostInBytes": "64k"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length, mtime`` of every mail file below a folder, without reading contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.emlx").load(folder)
    return files.select("path", "length", F.unix_seconds("modificationTime").alias("mtime"))


def mail_stream(spark: SparkSession, folder: str, most_files: int = 10_000) -> DataFrame:
    """The same as a stream: a file once, when it comes; contents are not read here either."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", "*.emlx").option("maxFilesPerTrigger", most_files).load(folder)
    return files.select("path", "length", F.unix_seconds("modificationTime").alias("mtime"))


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Of a path as a listing shows it; an executor opens files by it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


PER_TASK, OPENING = 64 << 20, 256 << 10  # bytes of files that a task reads, and those that take as long as opening and parsing one


def contents(files: DataFrame, most: int = MAX_FILE) -> DataFrame:
    """``files`` (``path, length`` and more) with ``content``, or ``error`` where a file is too large or cannot be read.

    A file is judged by its length before it is opened: by the listing's, and by
    what the file system says when its turn comes, should it have grown. Files are
    dealt out so that a task reads about ``PER_TASK`` bytes, one file at a time,
    where a file counts ``OPENING`` bytes more than it has.
    """
    total = files.agg(F.coalesce(F.sum(F.least("length", F.lit(most)) + OPENING), F.lit(0))).first()[0]
    place = files.columns.index("path")
    columns = [*files.columns, "content", "error"]

    def read(path: str, length: int) -> tuple[bytes | None, str | None]:
        if length > most:
            return None, "file too large"
        try:
            system, at = file_system(path)
            if (system.get_file_info(at).size or 0) > most:
                return None, "file too large"
            with system.open_input_stream(at) as source:
                return source.read(), None
        except OSError as e:
            return None, f"unreadable: {type(e).__name__}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                data, error = read(row.column(place).to_pylist()[0], row.column(size).to_pylist()[0])
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([data], pa.binary()), pa.array([error], pa.string())], names=columns)

    size = files.columns.index("length")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    return files.repartition(max(1, -(-total // PER_TASK)), "path").mapInArrow(run, f"{kind}, content binary, error string")


def put_files(rows: DataFrame) -> DataFrame:
    """Write each row's ``content`` to its ``path``; gives ``path, length`` of what was written. A file is whole or not there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = set()
        for batch in batches:
            paths, sizes = batch.column("path").to_pylist(), []
            for path, data in zip(paths, batch.column("content").to_pylist()):
                system, at = file_system(path)
                if (parent := at.rpartition("/")[0]) not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                with system.open_output_stream(f"{at}.part") as out:
                    out.write(data)
                system.move(f"{at}.part", at)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "length"])

    return rows.select("path", "content").mapInArrow(run, "path string, length long")


def numbered(files: DataFrame) -> DataFrame:
    number = F.regexp_extract("path", r"([0-9]+)(\.partial)?\.emlx$", 1)
    return files.where(number != "").withColumns({
        "source_id": number.cast("long"), "partial": F.endswith("path", F.lit(".partial.emlx")), "mailbox": mailbox_of(F.col("path")),
        "fingerprint": F.concat(F.col("mtime"), F.lit("-"), F.col("length"))})


def file_index(files: DataFrame) -> DataFrame:
    """One path for each number; a whole file goes before a partial one."""
    others = ["path", "mailbox", "fingerprint"]
    return numbered(files).groupBy("source_id").agg(F.min_by(F.struct(*others), F.struct("partial", "path")).alias("f")).select("source_id", "f.*")


def scan(files: DataFrame) -> DataFrame:
    """As :func:`file_index`, of the mailboxes that are read."""
    return file_index(files.where(F.lower(mailbox_of(F.col("path"))).isin(MAILBOXES)))


def framed(data: bytes) -> bytes:
    """The message in a file: as many bytes as its first line says."""
    if len(data) > MAX_FILE:
        raise ValueError("file too large")
    line, found, rest = data.partition(b"\n")
    if not found:
        raise ValueError("no count line")
    count = re.fullmatch(rb"[ \t]*\+?([0-9]+)[ \t]*", line)
    size = int(count[1]) if count else 0
    if size == 0:
        raise ValueError("bad count")
    if size > len(rest):
        raise ValueError("short data")
    return rest[:size]


def headers(block: str) -> list[tuple[str, str]]:
    out: list[list[str]] = []
    for line in block.split("\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1][1] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append([name.strip(), value.strip()])
    return [(n, v) for n, v in out]


def first(heads: list[tuple[str, str]], name: str) -> str | None:
    return next((v for n, v in heads if n.lower() == name), None)


def content_type(value: str) -> tuple[str, dict[str, str]]:
    kind, *rest = re.split(r';(?=(?:[^"]*"[^"]*")*[^"]*$)', value)
    found = {}
    for part in rest:
        name, eq, v = part.partition("=")
        if eq:
            found[name.strip().lower()] = v.strip().strip('"')
    return kind.strip().lower(), found


def split_parts(body: str, boundary: str) -> list[str]:
    """Sections between boundary lines up to the closing one; an unterminated last one counts, text before the first does not."""
    out: list[list[str]] = []
    for line in body.split("\n"):
        mark = line.strip(" \t")
        if mark == f"--{boundary}--":
            break
        if mark == f"--{boundary}":
            out.append([])
        elif out:
            out[-1].append(line)
    return [x for x in map("\n".join, out) if x]


def decoded_words(value: str | None) -> str | None:
    """Encoded words decoded, adjacent ones joined; what cannot be decoded stays."""
    if value is None:
        return None
    try:
        return str(email.header.make_header(email.header.decode_header(value)))
    except (LookupError, UnicodeError, ValueError, MessageError):
        return value


def transfer_decoded(body: str, encoding: str) -> bytes:
    raw = body.encode("latin-1", "replace")
    if encoding == "base64":
        try:
            return base64.b64decode(re.sub(rb"[^A-Za-z0-9+/=]", b"", raw))
        except binascii.Error:
            return b""
    return quopri.decodestring(raw) if encoding == "quoted-printable" else raw


def in_charset(data: bytes, charset: str | None) -> str:
    try:
        return data.decode(charset or "utf-8")
    except (LookupError, UnicodeError):
        return data.decode("latin-1")


def collect(part: str, depth: int, out: dict) -> None:
    """Texts and attachments of a MIME tree; deeper than the limit is an error."""
    if depth > MAX_DEPTH:
        raise ValueError("nested too deeply")
    head, _, body = part.partition("\n\n")
    heads = headers(head)
    kind, options = content_type(first(heads, "content-type") or "text/plain")
    encoding = (first(heads, "content-transfer-encoding") or "").strip().lower()
    if kind.startswith("multipart/"):
        if "boundary" not in options:
            return
        children = split_parts(body, options["boundary"])
        if kind == "multipart/alternative":
            kinds = [content_type(first(headers(c.partition("\n\n")[0]), "content-type") or "text/plain")[0] for c in children]
            children = next(([children[kinds.index(k)]] for k in ("text/plain", "text/html") if k in kinds), [])
        for child in children:
            collect(child, depth + 1, out)
        return
    name = content_type(first(heads, "content-disposition") or "")[1].get("filename") or options.get("name")
    if kind == "application/pdf" or (name or "").lower().endswith(".pdf"):
        bound = len(body) * 3 // 4 if encoding == "base64" else len(body)
        data = transfer_decoded(body, encoding) if bound <= MAX_ATTACHMENT else None
        if data is None or len(data) > MAX_ATTACHMENT:
            out["skipped"].append(name or "attachment.pdf")
        elif data:
            out["attachments"].append({"filename": name or "attachment.pdf", "size": len(data), "text": out["extract"](data)})
    elif kind in ("text/plain", "text/html"):
        out["texts"].append({"kind": kind, "text": in_charset(transfer_decoded(body, encoding), options.get("charset"))})


def unix_date(value: str | None) -> int:
    """Seconds since 1970; 0 for a missing or unreadable date."""
    try:
        at = parsedate_to_datetime(re.sub(r"\(.*$", "", value or "").strip())
        return int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp())
    except (TypeError, ValueError, OverflowError):
        return 0


def no_text(data: bytes) -> None:
    """No library here reads PDF, so an attachment has no text unless a caller's extractor gives one."""


def parsed(data: bytes, extract: Callable[[bytes], str | None] = no_text) -> dict:
    """The record of a mail file, its texts by kind; ``extract`` gives the text of a PDF."""
    text = framed(data).decode("latin-1").replace("\r\n", "\n")
    heads = headers(text.partition("\n\n")[0])
    out: dict = {"texts": [], "attachments": [], "skipped": [], "extract": extract}
    collect(text, 0, out)
    bare = lambda x: re.sub(r"^[\s<>]+|[\s<>]+$", "", x)
    get = lambda n: first(heads, n)
    return {
        "message_id": bare(get("message-id") or ""), "subject": decoded_words(get("subject")) or "", "sender": decoded_words(get("from")) or "",
        "recipient": decoded_words(get("to")) or "", "date_unix": unix_date(get("date")), "texts": out["texts"], "in_reply_to": bare(get("in-reply-to") or "") or None,
        "references": [r for r in map(bare, (get("references") or "").split()) if r], "list_unsubscribe": get("list-unsubscribe"), "list_id": get("list-id"),
        "precedence": get("precedence"), "auto_submitted": get("auto-submitted"), "attachments": out["attachments"], "skipped": out["skipped"]}


def visible(texts: Column) -> Column:
    """The texts of a mail as one: HTML as its visible text, paragraphs of boilerplate left out, empty ones too."""
    plain = lambda t: F.when(t.kind == "text/html", strip_boilerplate(html_to_text(t.text))).otherwise(strip_boilerplate(trimmed(t.text)))
    return trimmed(F.array_join(F.filter(F.transform(texts, plain), lambda t: t != ""), "\n\n"))


def parse_files(files: DataFrame, extract: Callable[[bytes], str | None] = no_text) -> DataFrame:
    """``files`` (``path, content``, maybe ``error`` for what could not be read) to records; a file that fails is a record with ``error`` alone (dead letters).

    ``body_text`` is what is shown of the texts, without the header block of a
    forwarded message, whose author is ``original_sender``. ``extract`` gets the
    bytes of a PDF and gives its text or None (unreadable, locked, empty); it has
    to be a function that the workers can import.
    """
    columns = [f.split()[0] for f in re.sub(r"<[^ ]*>", "", RECORD).replace("\n", " ").split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content, error in zip(batch["path"], batch["content"], batch["unread"]):
                found = re.search(r"([0-9]+)(\.partial)?\.emlx$", path)
                row = dict.fromkeys(columns) | {"path": path, "source_id": int(found[1]) if found else None}
                try:
                    if error is not None:
                        raise ValueError(error)
                    row |= parsed(bytes(content), extract)
                except Exception as e:  # whatever a file does, the job goes on
                    row["error"] = str(e) or type(e).__name__
                rows.append(row)
            out = pd.DataFrame(rows, columns=columns, dtype=object)
            out["source_id"] = out["source_id"].astype("Int64")
            out["date_unix"] = out["date_unix"].astype("Int64")
            yield out

    unread = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    rows = files.select("path", "content", unread.alias("unread")).mapInPandas(run, RECORD)
    whole = visible(F.col("texts"))
    rows = rows.withColumn("whole", whole)
    return rows.withColumns({"original_sender": original_sender(F.col("whole")), "body_text": strip_forward_header(F.col("whole"))}).drop("whole", "texts")
