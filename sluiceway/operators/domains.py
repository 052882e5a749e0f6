"""Joins of hosts with a table of domains: a domain holds its own host and all hosts below it; the longest that fits counts.

A host has as many suffixes as labels, so it is joined by equality of one of them, not by comparing it with every domain.
Only distinct hosts are exploded; rows then take their host's domain by an equi-join after which nothing is shuffled, so
that adaptive execution can split a host with very many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal(x: Column) -> Column:
    """A host or domain in lower case, without a dot at either end."""
    return F.regexp_replace(F.lower(x), r"^\.+|\.+$", "")


def suffixes(host: Column) -> Column:
    """The host, and what is left without its first labels, the longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels) - k + 1), "."))


def longest(rows: DataFrame, domains: DataFrame, host: str = "host", domain: str = "domain") -> DataFrame:
    """rows with the columns of domains, those of the longest domain that fits the host; null where none fits.

    Defined results: case and dots at the ends don't count; null and empty hosts and domains fit nothing; of rows for one
    domain that with the least other values counts; a domain fits whole labels only (``b.org`` fits ``a.b.org`` and ``b.org``, not ``ab.org``).
    """
    clash = (set(rows.columns) & set(domains.columns)) | ({host} & set(domains.columns))
    if clash:
        raise ValueError(f"columns on both sides: {', '.join(sorted(clash))}")
    own = [c for c in domains.columns if c != domain]
    table = domains.withColumn("__d", normal(F.col(domain))).where("__d <> ''").groupBy("__d").agg(F.min(F.struct(*own, domain)).alias("__of"))
    hosts = rows.select(normal(F.col(host)).alias("__h")).where("__h <> ''").distinct()
    fits = hosts.select("__h", F.explode(suffixes(F.col("__h"))).alias("__d")).join(table, "__d")
    best = fits.groupBy("__h").agg(F.max_by("__of", F.length("__d")).alias("__of"))
    out = rows.withColumn("__h", normal(F.col(host))).join(best, "__h", "left")
    return out.select(*rows.columns, *[F.col("__of")[c].alias(c) for c in domains.columns])


def outside(rows: DataFrame, domains: DataFrame, host: str = "host", domain: str = "domain") -> DataFrame:
    """The rows whose host lies in none of the domains; a null host lies in none."""
    fit = longest(rows, domains.select(F.col(domain).alias("__domain")), host, "__domain")
    return fit.where(F.col("__domain").isNull()).drop("__domain")
