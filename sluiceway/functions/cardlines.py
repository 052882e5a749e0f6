"""A table function that reads cards as streams of lines, for cards whose lines are rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

NAME = "sluiceway_card_blocks"


class CardBlocks:
    """(key, k, block, error) of rows (key, no, line): the blocks of each card's pages, or one row that says what is wrong.

    SELECT * FROM sluiceway_card_blocks(TABLE(lines), 'key'): the function asks for the partitioning by the key and the order by no itself,
    and takes the key's type from the table. It holds the card's pages, never the other lines, and no task gathers a card in an array.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument) -> AnalyzeResult:
        names = table.dataType.fieldNames()
        if missing := {key.value, "no", "line"} - set(names):
            raise ValueError(f"the table of lines has no {', '.join(sorted(missing))}")
        schema = T.StructType().add(key.value, table.dataType[key.value].dataType).add("k", "integer").add("block", "string").add("error", "string")
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn("no")])

    def __init__(self):
        from sluiceway.operators.deck import CARD_HEAD, LABELS, PAGE_HEAD

        self.card_head, self.page_head, self.labels = re.compile(CARD_HEAD), re.compile(PAGE_HEAD), LABELS
        self.space = re.compile(r"[\s\u001c-\u001f]+$")
        self.key = self.said = None
        self.block: list[str] = []
        self.pages: list[list[str]] = []
        self.over = False

    def eval(self, row, key: str):
        self.key = row[key]
        line = self.space.sub("", row["line"] or "")
        if self.said is None:
            m = self.card_head.match(line)
            self.said = int(m[3]) if m else None
        elif line.strip() == "---":
            self._end()
        elif line:
            self.block.append(line)

    def _end(self) -> None:
        """Of what stands between two separators: a page, nothing, or the end of the pages."""
        if self.block and not self.over:
            if self.page_head.match(self.block[0]):
                self.pages.append(self.block)
            else:
                self.over = True
        self.block = []

    def terminate(self):
        self._end()
        if error := self._error():
            yield self.key, None, None, error
        else:
            for k, block in enumerate(self.pages):
                yield self.key, k, "\n".join(block), None

    def _error(self) -> str | None:
        if self.said is None:
            return "no head line"
        if not self.pages:
            return "no pages"
        heads = [self.page_head.match(b[0]) for b in self.pages]
        for h in heads:
            if h[2].strip() not in self.labels.values():
                return f"unknown label {h[2].strip()}"
        for h, b in zip(heads, self.pages):
            if h[2] == self.labels["section"] and not any(re.match(r"### \d+ · .+$", x) for x in b) and not (h[3] or "").strip():
                return "divider without a title"
        return None if len(self.pages) == self.said else f"head line says {self.said} pages, there are {len(self.pages)}"


def register(spark: SparkSession) -> None:
    from pyspark.sql.functions import udtf

    spark.udtf.register(NAME, udtf(CardBlocks))


def read_card_lines(lines: DataFrame, key: str = "card") -> tuple[DataFrame, DataFrame]:
    """What deck.read_cards() gives, of cards whose lines are rows (key, no, line): pages, and (key, error)."""
    from ..operators.deck import parse_cards

    spark = lines.sparkSession
    register(spark)
    found = spark.sql(f"SELECT * FROM {NAME}(TABLE(SELECT `{key}`, no, line FROM {{lines}}), '{key}')", lines=lines)
    each = found.where("error IS NULL").select(F.struct(key, "k").alias("key"), F.col("block").alias("card"))
    parsed = parse_cards(each, ["key"])
    return parsed.select(F.col(f"key.{key}").alias(key), (F.col("key.k") + 1).alias("page"), "kind", "title", "subtitle", "items"), found.where("error IS NOT NULL").select(key, "error")
