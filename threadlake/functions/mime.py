"""Transfer decoding as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted_printable(text: Column) -> Column:
    """Quoted-printable text as UTF-8: soft line breaks go, then each ``=XX`` is a byte, others stay as they are; Latin-1 if that is not UTF-8."""
    joined = F.regexp_replace(text, "=[ \t]*\r?\n", "")
    pieces = F.regexp_extract_all(joined, F.lit("(?s)=[0-9A-Fa-f]{2}|[^=]+|="), F.lit(0))
    as_hex = F.transform(pieces, lambda p: F.when(p.rlike("^=[0-9A-Fa-f]{2}$"), F.substring(p, 2, 2)).otherwise(F.hex(F.encode(p, "UTF-8"))))
    raw = F.unhex(F.array_join(as_hex, ""))
    return F.coalesce(F.try_validate_utf8(raw.cast("string")), F.decode(raw, "ISO-8859-1"))
