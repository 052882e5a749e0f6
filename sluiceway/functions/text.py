"""Text columns. Whitespace is Unicode's, as in Python, not Java's default."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

SPACE = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]"


def strip(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def collapse(x: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(x, f"{SPACE}+", " "))


def flatten(x: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(x, f"{SPACE}+", "")


def truncate(x: Column, limit: int) -> Column:
    """The first ``limit`` code points and a note of the full length, if there are more."""
    n = F.length(x)
    return F.when(n > limit, F.concat(F.left(x, F.lit(limit)), F.lit("\n\n[... 截断，原文共 "), n.cast("string"), F.lit(" 字符 ...]"))).otherwise(x)


@pandas_udf(T.StringType())
def unescape(x: pd.Series) -> pd.Series:
    """Character references decoded, with all of HTML's names."""
    import html

    return x.map(lambda s: None if s is None else html.unescape(s))


def unescape_some(x: Column) -> Column:
    """The references that most pages have, JVM-side; ``&amp;`` last, so nothing is decoded twice."""
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#39;", "'"), ("&apos;", "'")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.regexp_replace(x, "&amp;?", "&")


def strip_tags(x: Column) -> Column:
    """Tags removed, references decoded, ends stripped."""
    return strip(unescape(F.regexp_replace(x, "<[^>]+>", "")))


def words(x: Column, separator: str = r"[,\s]+") -> Column:
    """The parts of a list given as text, without blank ones."""
    return F.filter(F.transform(F.split(x, separator), strip), lambda p: p != "")


def page_numbers(x: Column, pages: Column) -> Column:
    """The numbers of ``1,3-5`` that are pages of so many: digits alone or two of them with a hyphen, each once, in order; all else is passed over."""
    each = F.transform(F.split(x, ","), strip)
    some = F.filter(each, lambda p: F.rlike(p, F.lit(r"^\d{1,6}(?:-\d{1,6})?$")))
    spans = F.transform(some, lambda p: F.struct(F.greatest(F.lit(1), F.substring_index(p, "-", 1).cast("int")).alias("lo"), F.least(pages, F.substring_index(p, "-", -1).cast("int")).alias("hi")))
    whole = F.flatten(F.transform(F.filter(spans, lambda s: s["lo"] <= s["hi"]), lambda s: F.sequence(s["lo"], s["hi"])))
    return F.array_sort(F.array_distinct(whole))
