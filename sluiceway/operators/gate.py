"""Response gate and tiered acquisition over captured responses (url, engine, status, data, content_type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the gate.
MIN_BYTES, MIN_TEXT, MAX_BYTES, SAMPLE_BYTES = 500, 200, 30 << 20, 4096
CHALLENGE = r"(?i)Just a moment|Attention Required|请稍候|安全验证|访问异常|verify you are human|\$_ts|__jsluid"
LAUNDERED = (403, 412, 429, 503)
ENGINES = ("http", "browser")
DOWNLOAD = r"(?i)download is starting|ERR_ABORTED"


def is_pdf(data: Column, content_type: Column) -> Column:
    return F.coalesce(F.contains(F.lower(content_type), F.lit("pdf")), F.lit(False)) | F.coalesce(F.substring(data, 1, 5) == F.expr("X'255044462D'"), F.lit(False))


def head_text(data: Column) -> Column:
    """The first bytes as text; bytes beyond ASCII that form no character are no obstacle."""
    return F.call_function("decode", F.substring(data, 1, SAMPLE_BYTES), F.lit("ISO-8859-1"))


def utf8_head(data: Column) -> Column:
    return F.substring(data, 1, SAMPLE_BYTES).cast("string")


def verdict(status: Column, data: Column, content_type: Column, url: Column, expect: str | None = None, min_bytes: int = MIN_BYTES) -> Column:
    """The kind of failure of a response, null if it passes; the first rule that holds decides."""
    text = utf8_head(data)
    out = (
        F.when((status != 0) & (status >= 400), "http_error")
        .when(is_pdf(data, content_type), F.lit(None).cast("string"))
        .when(F.endswith(F.lower(F.substring_index(url, "?", 1)), F.lit(".pdf")), "wrong_content_type")
        .when(F.octet_length(data) < min_bytes, "empty_body")
        .when(F.rlike(text, F.lit(CHALLENGE)), "challenge")
    )
    return out.when(~F.rlike(data.cast("string"), F.lit(expect)), "unexpected_structure") if expect else out


def launder(status: Column, passed: Column) -> Column:
    """The status that is reported: a page that was rendered in spite of a challenge's status is a 200."""
    return F.when(~passed, status).when((status >= 400) & ~status.isin(*LAUNDERED), status).otherwise(F.lit(200))


def error_kind(error_class: Column, message: Column) -> Column:
    too_large = F.contains(F.lower(message), F.lit("too large")) | (error_class == "TooLarge")
    timeout = F.contains(error_class, F.lit("Timeout")) | F.contains(F.lower(message), F.lit("timed out"))
    return F.when(F.coalesce(too_large, F.lit(False)), "too_large").when(F.coalesce(timeout, F.lit(False)), "timeout").otherwise("network")


def is_download(message: Column) -> Column:
    """Whether a browser's message says that an address is a download and no page."""
    return F.coalesce(F.rlike(message, F.lit(DOWNLOAD)), F.lit(False))


def judged(responses: DataFrame, expect: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """responses with ``rank`` (the engine's, from 1), ``kind`` and ``detail`` of the failure, null where they pass. Bytes of what failed are left out.

    Responses with a column error_class (and error_message) that isn't null have failed without bytes, as those over MAX_BYTES.
    """
    rank = F.array_position(F.array(*map(F.lit, ENGINES)), F.col("engine"))
    kind = verdict(F.col("status"), F.col("data"), F.col("content_type"), F.col("url"), expect, min_bytes)
    if "error_class" in responses.columns:
        message = F.coalesce(F.col("error_message"), F.lit("")) if "error_message" in responses.columns else F.lit("")
        kind = F.when(F.col("error_class").isNotNull(), error_kind(F.col("error_class"), message)).otherwise(kind)
    detail = F.when(F.col("kind") == "http_error", F.concat(F.lit("HTTP "), F.col("status").cast("string"))).otherwise(F.col("kind"))
    return responses.withColumn("kind", kind).withColumn("rank", rank).withColumn("detail", detail).withColumn("data", F.when(F.col("kind").isNull(), F.col("data")))


def decided(got: DataFrame, *keys: str) -> DataFrame:
    """Outcomes by ``keys`` (url) from (url, won, w, failed): the winner's rank and response, null without one, and all failures as (rank, engine, kind, detail), sorted."""
    before = F.filter("failed", lambda x: F.col("won").isNull() | (x["rank"] < F.col("won")))
    attempts = F.transform(before, lambda x: F.struct(x["engine"].alias("engine"), x["kind"].alias("kind"), x["detail"].alias("detail")))
    status = F.when(F.col("won").isNotNull(), launder(F.col("w.status"), F.lit(True)))
    error = F.when(F.col("won").isNull(), F.array_join(F.transform("failed", lambda x: x["detail"]), "；"))
    return got.select(*(keys or ("url",)), F.col("w.engine").alias("engine_used"), status.alias("status"), F.col("w.data").alias("data"), F.col("w.content_type").alias("content_type"), F.when(F.size(attempts) > 0, attempts).alias("attempts"), error.alias("error"))


def acquire(responses: DataFrame, expect: str | None = None, min_bytes: int = MIN_BYTES, engine: str = "auto", visit: str | None = None) -> DataFrame:
    """Per url the response of the first engine that passes, with the attempts that failed before it.

    (url, engine_used, status, data, content_type, attempts, error). attempts is null where none failed; error joins
    the details in engine order where all did; failures that are the same count once, so that a url has as many as there are kinds. ``engine`` asks
    for one engine's responses alone. ``visit`` names a column that tells a url's visits apart: each visit's failures count, in its order, and of
    several visits in which the winning engine passes the first gives the response. One shuffle, by url, of what passed.
    """
    if engine != "auto":
        responses = responses.where(F.col("engine") == engine)
    at = ["rank", visit] if visit else ["rank"]
    passed = F.col("kind").isNull()
    got = judged(responses, expect, min_bytes).groupBy("url").agg(
        F.min(F.when(passed, F.col("rank"))).alias("won"),
        F.min_by(F.struct("engine", "status", "data", "content_type"), F.when(passed, F.struct(*at))).alias("w"),
        F.sort_array(F.collect_set(F.when(~passed, F.struct(*at, "engine", "kind", "detail")))).alias("failed"),
    )
    return decided(got)


def merged(outcomes: DataFrame, visit: str) -> DataFrame:
    """The outcomes by url of outcomes by (url, visit): what acquire() gives of all the visits' responses at once."""
    rank = lambda engine: F.array_position(F.array(*map(F.lit, ENGINES)), engine)
    won = F.when(F.col("error").isNull(), rank(F.col("engine_used")))
    failed = F.transform("attempts", lambda x: F.struct(rank(x["engine"]).alias("rank"), F.col(visit), x["engine"].alias("engine"), x["kind"].alias("kind"), x["detail"].alias("detail")))
    got = outcomes.groupBy("url").agg(
        F.min(won).alias("won"),
        F.min_by(F.struct(F.col("engine_used").alias("engine"), "status", "data", "content_type"), F.when(won.isNotNull(), F.struct(won, visit))).alias("w"),
        F.sort_array(F.flatten(F.collect_list(failed))).alias("failed"),
    )
    return decided(got)


def captures(outcomes: DataFrame, responses: DataFrame) -> DataFrame:
    """outcomes with a row for each of the responses that the winning engine gave, those that failed among them; one row without a winner."""
    given = responses.select("url", F.col("engine").alias("engine_used"), "data", "content_type")
    return outcomes.drop("data", "content_type").join(given, ["url", "engine_used"], "left").select(outcomes.columns)


def engines_failed(attempts: Column) -> Column:
    """How many engines have failed; of several visits each counts once."""
    return F.coalesce(F.size(F.array_distinct(F.transform(attempts, lambda x: x["engine"]))), F.lit(0))


def summary(outcomes: DataFrame) -> DataFrame:
    """One row: how many succeeded, how many after a failed attempt, and the bytes they hold."""
    ok = F.col("error").isNull()
    return outcomes.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(ok & F.col("attempts").isNotNull()).alias("degraded"), F.sum(F.coalesce(F.octet_length("data"), F.lit(0)).cast("long")).alias("length"))


def last_kind(attempts: Column) -> Column:
    """The kind that an outcome reports: that of the last engine's attempt, of several visits' the first one's."""
    last = F.try_element_at(attempts, F.lit(-1))["engine"]
    return F.coalesce(F.get(F.filter(attempts, lambda x: x["engine"] == last), F.lit(0))["kind"], F.lit("invalid_response"))


def failures(outcomes: DataFrame) -> DataFrame:
    """(url, kind, error, attempts) of the outcomes without a response."""
    return outcomes.where(F.col("error").isNotNull()).select("url", last_kind(F.col("attempts")).alias("kind"), "error", "attempts")


def public(df: DataFrame) -> DataFrame:
    """Without the columns whose names begin with an underscore."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order: a minimum, taken before the shuffle as well as after it."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__first"))
    return first.select(*[F.col(c) if c in keys else F.col("__first")[c].alias(c) for c in df.columns])
