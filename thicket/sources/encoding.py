"""Byte documents to text, as they declare themselves."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def detect(content: Column) -> Column:
    """UTF-8, UTF-16BE or UTF-16LE by byte order mark, else null; native."""
    head = F.hex(F.substring(content, 1, 3))
    return F.when(head == "EFBBBF", "UTF-8").when(head.startswith("FEFF"), "UTF-16BE").when(head.startswith("FFFE"), "UTF-16LE")


def declared(content: Column) -> Column:
    """The encoding that an XML declaration names, else null; native."""
    head = F.decode(F.substring(content, 1, 200), "ISO-8859-1")
    found = F.regexp_extract(head, r"^(?:ï»¿)?<\?xml[^>]*?encoding\s*=\s*[\"']([A-Za-z][A-Za-z0-9._-]*)[\"']", 1)
    return F.when(found != "", found)


@F.pandas_udf(StructType([StructField(c, StringType()) for c in ("text", "encoding", "error")]))
def _decoded(content: pd.Series, mark: pd.Series, label: pd.Series) -> pd.DataFrame:
    out = []
    for raw, m, name in zip(content, mark, label, strict=True):
        if raw is None:
            out.append((None, None, None))
            continue
        encoding = m or name or "UTF-8"
        try:
            text = codecs.decode(bytes(raw), encoding)
            out.append((text.removeprefix("﻿"), encoding, None))
        except (LookupError, UnicodeDecodeError) as e:
            out.append((None, encoding, str(e)))
    return pd.DataFrame(out, columns=["text", "encoding", "error"])


def decode(content: Column) -> Column:
    """struct(text, encoding, error): by byte order mark, else by declaration, else UTF-8; strict.

    Python decodes, in Arrow batches: the JVM's ``decode`` knows few charsets.
    """
    return _decoded(content, detect(content), declared(content))
