"""Hooks on findings: block rows, log or run a command for replacements. No value ever reaches one."""

from __future__ import annotations

import contextlib
import json
import os
import subprocess
from collections.abc import Iterable

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Hook
from . import detect

RECORD = ("event", "ts", "request_host", "rule_id", "kind", "subtype", "placeholder", "action")


def blocking_message(replacements: Column, hooks: Iterable[Hook]) -> Column:
    """The message of the first block hook that a replacement meets, replacements in order; null if none. Only a found secret blocks."""
    blocks = [h for h in hooks if h.action == "block" and h.event == "secret_detected"]
    if not blocks:
        return F.lit(None).cast("string")

    def of(r: Column) -> Column:
        out = F.lit(None).cast("string")
        for h in reversed(blocks):
            says = F.lit(h.message) if h.message else F.concat(F.lit("request blocked by hook for rule "), r["rule_id"])
            meets = F.lit(True) if "*" in h.rule_ids else F.lower(F.trim(r["rule_id"])).isin(*h.rule_ids)
            out = F.when(meets, says).otherwise(out)
        return out

    return F.try_element_at(F.filter(F.transform(replacements, of), lambda m: m.isNotNull()), F.lit(1))


def records(masked_rows: DataFrame, hook: Hook, host: Column, at: Column) -> DataFrame:
    """A record for each replacement that the hook is for; at is a timestamp, ts epoch seconds."""
    each = detect.each(masked_rows, "replacements", host.alias("request_host"), F.unix_timestamp(at).alias("ts"))
    if "*" not in hook.rule_ids:
        each = each.where(F.lower(F.trim("f.rule_id")).isin(*hook.rule_ids))
    return each.select(F.lit(hook.event).alias("event"), "ts", "request_host", "f.rule_id", "f.kind", "f.subtype", "f.placeholder", F.lit(hook.action).alias("action"))


def dispatch(masked_rows: DataFrame, hooks: Iterable[Hook], event: str, host: Column, at: Column, allow_exec: bool = False, batch: int | None = None, ledger: str | None = None) -> None:
    """Run the log and exec hooks of an event over the rows; block hooks act on the rows themselves (blocking_message).

    With the number of a batch and a ledger (a folder that all machines share), a batch that is tried again
    writes no line and runs no command twice; see once_logged and once_executed.
    """
    for place, hook in enumerate(hooks):
        if hook.event == event and hook.action in ("log", "exec"):
            rows = records(masked_rows, hook, host, at)
            if batch is not None and ledger is not None:
                name = f"{batch}-{place}"
                once_logged(rows, hook, name) if hook.action == "log" else once_executed(rows, hook, name, ledger, allow_exec)
            else:
                run_log(rows, hook) if hook.action == "log" else run_exec(rows, hook, allow_exec)


def run_log(rows: DataFrame, hook: Hook) -> None:
    rows.write.mode("append").json(hook.path)


def _whole(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(done)


def once_logged(rows: DataFrame, hook: Hook, batch: str) -> None:
    """The lines of a batch as a part of their own below the hook's path: kept if whole, and else written anew in its place."""
    path = f"{hook.path}/batch={batch}"
    if not _whole(rows.sparkSession, path):
        rows.write.mode("overwrite").json(path)


def once_executed(rows: DataFrame, hook: Hook, batch: str, ledger: str, allow: bool = False) -> None:
    """Run the hook's command for each record of a batch, never twice.

    The records are written first, each with a number, so a batch that is tried again has the same ones. An
    entry of the ledger is made for a record before its command runs; where there is one the command
    doesn't run. What was begun when a machine was lost isn't begun again.
    """
    _permitted(allow)
    path = f"{ledger.rstrip('/')}/{hook.event}-{batch}"
    if not _whole(rows.sparkSession, f"{path}/records"):
        rows.withColumn("n", F.monotonically_increasing_id()).write.mode("overwrite").json(f"{path}/records")
    schema = rows.withColumn("n", F.lit(0).cast("long")).schema
    command, limit = hook.command, hook.timeout_ms / 1000
    root = path if "://" in path else f"file://{path}"

    def each(part: Iterable) -> None:
        store, begun = fs.FileSystem.from_uri(f"{root}/begun")
        store.create_dir(begun, recursive=True)
        for row in part:
            record = row.asDict()
            entry = f"{begun}/{record.pop('n')}"
            if store.get_file_info(entry).type == fs.FileType.NotFound:
                store.open_output_stream(entry).close()
                _execute(command, limit, record)

    rows.sparkSession.read.schema(schema).json(f"{path}/records").foreachPartition(each)


def _permitted(allow: bool) -> None:
    if not allow:
        raise PermissionError("exec hooks run commands on workers; pass allow=True")


def _execute(command: str, limit: float, record: dict) -> None:
    """Run a command with a record as its input and in its environment; one that takes too long is ended."""
    env = os.environ | {f"CLOAKFRAME_{k.upper()}": "" if v is None else str(v) for k, v in record.items() if k != "action"}
    with contextlib.suppress(subprocess.TimeoutExpired):
        subprocess.run(["/bin/sh", "-c", command], input=json.dumps(record).encode(), env=env, timeout=limit, check=False, stdout=subprocess.DEVNULL)


def run_exec(rows: DataFrame, hook: Hook, allow: bool = False) -> None:
    """Run the hook's command for each record, on the executors: off unless allowed, as it runs commands on workers."""
    _permitted(allow)
    command, limit = hook.command, hook.timeout_ms / 1000

    def each(part: Iterable) -> None:
        for row in part:
            _execute(command, limit, row.asDict())

    rows.foreachPartition(each)


def run_local(found: Iterable[dict], hooks: Iterable[Hook], event: str, host: str, ts: int) -> str | None:
    """The hooks of an event for the replacements of one message, in this process; the message of the first that blocks it, which ends them."""
    for f in found:
        record = {"event": event, "ts": ts, "request_host": host} | {k: f[k] for k in ("rule_id", "kind", "subtype", "placeholder")}
        for hook in hooks:
            if not hook.applies(event, f["rule_id"]):
                continue
            if hook.action == "block":
                return hook.message or f"request blocked by hook for rule {f['rule_id']}"
            if hook.action == "log":
                with open(hook.path, "a") as out:
                    out.write(json.dumps(record | {"action": "log"}) + "\n")
            else:
                _execute(hook.command, hook.timeout_ms / 1000, record | {"action": "exec"})
    return None
