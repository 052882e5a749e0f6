"""URL columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def host(x: Column) -> Column:
    """The host in lower case without port; null for junk."""
    return F.lower(F.try_parse_url(x, F.lit("HOST")))


def site(x: Column) -> Column:
    """The host without a leading www."""
    return F.regexp_replace(host(x), r"^www\.", "")


def same_site(url: Column, base: Column) -> Column:
    h, s = host(url), site(base)
    return F.coalesce((h == s) | F.endswith(h, F.concat(F.lit("."), s)), F.lit(False))


def roots(x: Column) -> Column:
    """Site roots to try for a site given with or without scheme: as it is, then with www unless it has it."""
    scheme = F.when(F.rlike(x, F.lit("^https?://")), F.regexp_extract(x, "^(https?)://", 1)).otherwise(F.lit("https"))
    h = F.regexp_replace(F.regexp_replace(x, "^https?://", ""), "/.*$", "")
    plain = F.concat(scheme, F.lit("://"), h)
    return F.when(F.startswith(h, F.lit("www.")), F.array(plain)).otherwise(F.array(plain, F.concat(scheme, F.lit("://www."), h)))


def entries(x: Column) -> Column:
    """The same candidates with www first."""
    return F.reverse(roots(x))


def normal_site(x: Column) -> Column:
    """Without scheme and slashes at the ends."""
    return F.regexp_replace(F.regexp_replace(x, "^https?://", ""), "^/+|/+$", "")


def query_string(**params: Column) -> Column:
    """``a=x+y&b=z``: values percent-encoded, spaces as plus signs."""
    return F.concat_ws("&", *[F.concat(F.lit(f"{k}="), F.url_encode(v)) for k, v in params.items()])


def slash_join(base: Column, path: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+", ""))


@pandas_udf(T.StringType())
def join(base: pd.Series, href: pd.Series) -> pd.Series:
    """Relative resolution (RFC 3986); null where that fails."""
    from urllib.parse import urljoin

    def one(b, h):
        try:
            return urljoin(b, h)
        except (ValueError, TypeError):
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href)])


@pandas_udf(T.StringType())
def normal_path(x: pd.Series) -> pd.Series:
    """A POSIX path without . and .. steps."""
    import posixpath

    return x.map(lambda p: None if p is None else posixpath.normpath(p))
