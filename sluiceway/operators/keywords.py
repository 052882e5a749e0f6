"""Substring joins with a table of keywords: which keywords does a text hold?

Texts are read by an Aho-Corasick automaton where they lie: they are not
shuffled, and what doesn't match leaves no row. Keywords are cut by hash into blocks of about BLOCK characters, so that what is sent to a
task, and the automaton made of it, have a bound; each block is a pass over the texts, which are written down first if there are several,
so that a pass only reads. A pass has few tasks, for each makes the automaton: as many as keep all cores busy, or as PASS characters of texts call for. Keywords that are longer than LONG are few or none in
any table of words; they are joined by the same automaton on their first LONG characters and checked in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, scratch

BLOCK, LONG, PASS = 1 << 21, 256, 1 << 25
_automata: dict[str, tuple] = {}


def _automaton(ident: str, keywords: list[str]):
    """(automaton over starts, keywords by start, whether the empty keyword is among them), built once in a worker for each block."""
    if ident not in _automata:
        import ahocorasick

        if len(_automata) > 1:
            _automata.clear()
        by_start: dict[str, list[str]] = {}
        for k in keywords:
            if k:
                by_start.setdefault(k[:LONG], []).append(k)
        a = ahocorasick.Automaton()
        for start, full in by_start.items():
            a.add_word(start, full)
        if by_start:
            a.make_automaton()
        _automata[ident] = a if by_start else None, "" in keywords
    return _automata[ident]


def found_in(text: str, automaton, empty: bool) -> list[str]:
    """The keywords in a text, each once, in the order of their first ends."""
    out = {"": None} if empty else {}
    for _, full in automaton.iter(text) if automaton is not None else ():
        for k in full:
            if k not in out and (len(k) <= LONG or k in text):
                out[k] = None
    return list(out)


def matches(texts: DataFrame, keywords: DataFrame, text: str = "text", keyword: str = "keyword") -> DataFrame:
    """texts with a column ``keyword``, a row for each of the table's keywords that the text holds.

    Defined results: case and accents count; null texts and null keywords match nothing, the empty keyword every text that isn't null;
    repeated keywords count once, repeated rows of texts each; a table without keywords gives no rows.
    """
    import uuid

    import pyarrow as pa

    spark = texts.sparkSession
    words = checkpointed(keywords.where(F.col(keyword).isNotNull()).select(F.col(keyword).cast("string").alias("k")).distinct())
    size = words.agg(F.sum(F.length("k") + 8)).first()[0] or 0
    blocks = -(-size // BLOCK)
    words = words.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(max(1, blocks))))
    if blocks > 1:
        place = f"{scratch(spark)}/keywords-{uuid.uuid4().hex}"
        words.repartition(blocks, "b").write.partitionBy("b").parquet(place)
        words = spark.read.schema("k string, b long").parquet(place)
        texts = checkpointed(texts)
        chars = texts.agg(F.sum(F.length(text))).first()[0] or 0
        texts = texts.coalesce(max(-(-2 * spark.sparkContext.defaultParallelism // blocks), -(-chars // PASS)))
    at, names = texts.columns.index(text), [*texts.columns, "keyword"]
    schema = texts.select("*", F.lit("").alias("keyword")).schema

    def block(b: int) -> DataFrame:
        # A block has a bound: BLOCK characters on average, of distinct words dealt by hash.
        ident, held = uuid.uuid4().hex, spark.sparkContext.broadcast(words.where(F.col("b") == b).select("k").toArrow().column(0).to_pylist())

        def run(batches: Iterator) -> Iterator:
            automaton, empty = _automaton(ident, held.value)
            for batch in batches:
                rows, keys = [], []
                for i, t in enumerate(batch.column(at).to_pylist()):
                    got = found_in(t, automaton, empty) if t is not None else []
                    rows += [i] * len(got)
                    keys += got
                if rows:
                    kept = batch.take(pa.array(rows, pa.int32()))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(keys, pa.string())], names)

        return texts.mapInArrow(run, schema)

    if not blocks:
        return texts.select("*", F.lit("").alias("keyword")).limit(0)
    return reduce(DataFrame.unionByName, (block(b) for b in range(blocks)))


def holding(texts: DataFrame, keywords: DataFrame, text: str = "text", keyword: str = "keyword", key: str = "id") -> DataFrame:
    """The rows of texts that hold any keyword, each as it is; ``key`` tells rows apart. With an empty table of keywords all stay, as without a wish."""
    if keywords.where(F.col(keyword).isNotNull()).isEmpty():
        return texts
    hits = matches(texts.select(key, text), keywords, text, keyword).select(key).distinct()
    return texts.join(hits, key, "left_semi")
