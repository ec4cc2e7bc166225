"""Message streams, stateless in both directions, and a mapping kept by micro-batches that forgets what has expired.

A request is masked, or closed where it can't be; a response has its placeholders put
back. Both are projections that batch and stream share.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..config import Settings
from ..errors import HOOK_BLOCKED, fail_closed
from ..functions import scalars as S
from ..operators import audit, bodies, detect, hooks, rewrite, scope


def masked_stream(messages: DataFrame, text_col: str, settings: Settings, salt: bytes) -> DataFrame:
    """messages with findings, replacements and masked; the same columns as in batch."""
    found = detect.with_findings(messages, text_col, settings.detection, settings.allowlist, settings.prefix)
    return rewrite.masked(found, text_col, salt, settings.prefix, settings.dry_run)


def _judged(rows: DataFrame, original: Column, error: Column, settings: Settings) -> DataFrame:
    """rows (masked, replacements) with error_code, outgoing, closed and contract."""
    blocked = hooks.blocking_message(F.col("replacements"), settings.hooks)
    rows = rows.withColumn("error_code", F.coalesce(error, F.when(blocked.isNotNull(), HOOK_BLOCKED)))
    changed = F.when(F.size("replacements") > 0, F.col("masked")).otherwise(original)
    out = fail_closed(original, changed, F.col("error_code"), settings.fail_closed)
    contract = F.when(F.col("error_code").isNull(), rewrite.contract(F.col("replacements"), settings.dry_run))
    return rows.withColumns({"outgoing": out, "closed": original.isNotNull() & out.isNull(), "contract": contract})


def text_requests(messages: DataFrame, text_col: str, settings: Settings, salt: bytes | None = None) -> DataFrame:
    """messages with replacements, error_code, outgoing, closed and contract, for plain texts.

    outgoing is the text that may leave: the original where nothing was found. A text that
    is too large, or that a block hook meets, is an error; after one the message is
    closed (null) if settings fail closed or a hook blocked it, and else passes as it was.
    """
    rows = masked_stream(messages, text_col, settings, salt)
    return _judged(rows, F.col(text_col), scope.body_error(F.col(text_col), settings.max_body_bytes), settings).drop("findings", "masked")


def body_requests(messages: DataFrame, key: str, body_col: str, settings: Settings, salt: bytes | None = None, walk: str = "socket") -> DataFrame:
    """key, body, replacements, error_code, outgoing, closed and contract: as text_requests, for JSON messages."""
    rows = bodies.masked_bodies(messages, key, body_col, settings, salt, walk)
    return _judged(rows, F.col("body"), F.col("error_code"), settings).drop("masked")


def responses(messages: DataFrame, key: str, text_col: str, known: DataFrame, now: Column, settings: Settings) -> DataFrame:
    """messages with restored: placeholders that the mapping knows are put back, others stay; known may be a static table in a stream.

    In a stream each message is resolved in its own micro-batch (see each_response), as a
    join with its own aggregation needs a batch.
    """
    hit = F.coalesce(S.contains_prefix(F.col(text_col), settings.prefix), F.lit(False))
    return rewrite.resolved(messages.withColumn("_in", F.when(hit, F.col(text_col))), key, "_in", known, now, settings.prefix).withColumn(
        "restored", F.coalesce("restored", text_col)
    ).drop("_in", "error_code")


def counted(judged: DataFrame, name: str) -> DataFrame:
    """judged (of text_requests or body_requests), counted as it flows: intercepted, masked, closed and blocked messages of each batch under name.

    The counts cost no pass of their own. A batch tells them by an Observation, a stream by
    each progress report (see Counters).
    """
    number = lambda test: F.count(F.when(test, 1))
    return judged.observe(
        name, F.count(F.lit(1)).alias("intercepted"), number(F.col("contract").isNotNull()).alias("masked"), number(F.col("closed")).alias("closed"),
        number(F.col("error_code") == HOOK_BLOCKED).alias("blocked"), F.sum(F.when(F.col("contract").isNotNull(), F.size("replacements")).otherwise(0)).alias("replacements"),
    )


class Counters(StreamingQueryListener):
    """The counts of all streams of a session: by batch, and their sums. Add with spark.streams.addListener."""

    def __init__(self, name: str):
        self.name = name
        self.batches: dict[tuple[str, int], dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.batches[str(event.progress.id), event.progress.batchId] = {k: v or 0 for k, v in row.asDict().items()}

    def totals(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for counts in list(self.batches.values()):
            for k, v in counts.items():
                out[k] = out.get(k, 0) + v
        return out


def each_response(path: str, key: str, text_col: str, settings: Settings, put: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: resolve a batch by the mapping kept below path as it is then, and hand it to put."""

    def each(batch: DataFrame, number: int) -> None:
        put(responses(batch, key, text_col, current_mapping(batch.sparkSession, path), F.current_timestamp(), settings), number)

    return each


def keep_mapping(path: str, settings: Settings, host: str = "stream", compact_every: int = 100, allow_exec: bool = False) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: append a batch's mapping rows and audit rows below path, and run its hooks.

    Rows are written by batch number, so a batch that is tried again replaces its own.
    Every so many batches the mapping of all before is written anew as one, without
    what has expired. Hooks act once for a batch that is tried again. Rows that were
    closed (text_requests, body_requests) are neither mapped nor audited, but do tell
    that a secret was found.
    """

    def each(batch: DataFrame, number: int) -> None:
        now = F.current_timestamp()
        batch = batch.persist()
        try:
            hooks.dispatch(batch, settings.hooks, "secret_detected", F.lit(host), now, allow_exec, number, f"{path}/hooks")
            sent = batch.where(~F.coalesce(F.col("closed"), F.lit(False))) if "closed" in batch.columns else batch
            if not settings.dry_run:
                rewrite.mapping(sent, settings.session_ttl).write.mode("overwrite").parquet(f"{path}/mapping/batch={number}")
                audit.audit_rows(sent, F.lit(host), now).write.mode("overwrite").json(f"{path}/audit/batch={number}")
                hooks.dispatch(sent, settings.hooks, "request_redacted", F.lit(host), now, allow_exec, number, f"{path}/hooks")
        finally:
            batch.unpersist()
        if compact_every and number and number % compact_every == 0:
            compact_mapping(batch.sparkSession, path, number)

    return each


def _parts(spark: SparkSession, path: str) -> dict[str, int]:
    """Folders of the mapping below path, and the last batch that each holds."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/mapping")
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(folder):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    done = {n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/mapping/{n}/_SUCCESS"))}
    return {n: int(m[1]) for n in sorted(done) if (m := re.fullmatch(r"(?:batch|upto)=(\d+)", n))}


def _live(parts: dict[str, int]) -> list[str]:
    """The last compaction, and the batches after it."""
    upto = max((last for n, last in parts.items() if n.startswith("upto=")), default=-1)
    return [n for n, last in parts.items() if last > upto or n == f"upto={upto}"]


def compact_mapping(spark: SparkSession, path: str, upto: int, now: Column | None = None) -> None:
    """Write the mapping of all batches up to one as a single part without what has expired.

    What it replaces stays until the next compaction, since a reader may have listed it already; what the
    one before has replaced is deleted. A reader takes the last whole compaction and what came after it.
    """
    parts = {n: last for n, last in _parts(spark, path).items() if last <= upto}
    live = [n for n in _live(parts) if n != f"upto={upto}"]
    if not live:
        return
    tables = [spark.read.parquet(f"{path}/mapping/{n}") for n in live]
    rewrite.merged(*tables, now=F.current_timestamp() if now is None else now).write.mode("overwrite").parquet(f"{path}/mapping/upto={upto}")
    for n in set(parts) - set(live) - {f"upto={upto}"}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/mapping/{n}")
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def current_mapping(spark: SparkSession, path: str, now: Column | None = None) -> DataFrame:
    """The mapping of all batches so far, without what has expired."""
    parts = _live(_parts(spark, path))
    if not parts:
        return spark.createDataFrame([], "id string, kind string, secret string, expires_at timestamp")
    tables = spark.read.schema("id string, kind string, secret string, expires_at timestamp").parquet(*(f"{path}/mapping/{n}" for n in parts))
    return rewrite.merged(tables, now=F.current_timestamp() if now is None else now)
