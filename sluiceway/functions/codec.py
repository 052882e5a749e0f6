"""Bytes to text: decompression, charset sniffing and a cascade of decoders."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

SNIFF_BYTES = 2048


@pandas_udf(T.BinaryType())
def inflate(data: pd.Series, encoding: pd.Series) -> pd.Series:
    """gzip or deflate by the declared encoding, gzip by magic without one; the bytes themselves where that fails."""
    import gzip
    import zlib

    def one(b, enc):
        if b is None:
            return None
        enc = (enc or "").lower()
        try:
            if "gzip" in enc or b[:2] == b"\x1f\x8b":
                return gzip.decompress(b)
            if "deflate" in enc:
                try:
                    return zlib.decompress(b)
                except zlib.error:
                    return zlib.decompress(b, -zlib.MAX_WBITS)
        except (OSError, EOFError, zlib.error):
            pass
        return b

    return pd.Series([one(b, e) for b, e in zip(data, encoding)])


def charset(data: Column, content_type: Column) -> Column:
    """The declared charset, of the header first, else of the first bytes; gb2312 and gbk read as gb18030."""
    head = F.decode(F.substring(data, 1, SNIFF_BYTES), "ISO-8859-1")
    own = lambda x: F.nullif(F.regexp_extract(F.coalesce(x, F.lit("")), r"(?i)charset\s*=\s*[\"']?\s*([a-z0-9_-]+)", 1), F.lit(""))
    name = F.lower(F.coalesce(own(content_type), own(head)))
    return F.when(name.isin("gb2312", "gbk"), "gb18030").otherwise(name)


@pandas_udf(T.StringType())
def decode(data: pd.Series, charset: pd.Series) -> pd.Series:
    """By the declared charset, then utf-8, gb18030, latin-1: the first that takes all bytes."""

    def one(b, declared):
        if b is None:
            return None
        for c in (declared, "utf-8", "gb18030", "latin-1"):
            try:
                if c:
                    return b.decode(c)
            except (UnicodeDecodeError, LookupError):
                pass
        return b.decode("utf-8", "replace")

    return pd.Series([one(b, c) for b, c in zip(data, charset)])
