"""Both directions of a session in one stream: requests are masked, responses restored, and the mapping is keyed state that forgets.

Each session keeps a map from (kind, id) to the value, when it was first seen and when it
expires. A request puts its replacements in and puts expiry off; a response takes its placeholders
out of it. Time is that of the messages: a response counts what was first seen by then and
hadn't expired, however late either arrives. One that misses a value waits until the watermark
has passed it, as its request may still come; after that it goes out with what is known. Timers of the
session remove what has expired, so state is bounded by the values of the last ttl and lateness.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..config import Settings
from ..functions.local import restore
from . import messages

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "session string, seq long, at timestamp, direction string, outgoing string, error_code string, contract string, missed boolean"


class Session(StatefulProcessor):
    """State of one session; see the module."""

    def __init__(self, prefix: str, ttl_ms: int, waits: bool):
        self.prefix, self.ttl_ms, self.waits = prefix, ttl_ms, waits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "kind string, id string", "secret string, seen long, expires long")
        self.waiting = handle.getMapState("waiting", "at long, seq long, place long", "text string")
        self.next_place = handle.getValueState("next_place", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """Rows come in any order and are taken one by one; what a response gets doesn't depend on it, as spans of values only grow."""
        passed = timerValues.getCurrentWatermarkInMs() if self.waits else None
        for r in rows:
            if r["direction"] == "request":
                for f in r["replacements"] or ():
                    self._see(f["kind"], f["id"], f["secret"], r["at_ms"])
                yield self._row(key, r["at_ms"], r["seq"], "request", r["text"], r["error_code"], r["contract"], False)
                continue
            out, missed = (None, False) if r["text"] is None else self._resolved(r["text"], r["at_ms"])
            if missed:
                place = self.next_place.get()[0] if self.next_place.exists() else 0
                self.next_place.update((place + 1,))
                self.waiting.updateValue((r["at_ms"], -1 if r["seq"] is None else r["seq"], place), (r["text"],))
            else:
                yield self._row(key, r["at_ms"], r["seq"], "response", out, None, None, False)
        yield from self._let_out(key, passed, timers=self.waits)

    def _let_out(self, key: tuple, passed: int | None, timers: bool = False) -> Iterator[Row]:
        """Waiting responses that miss nothing any more, or whose time has passed (all, if there is nothing to wait for)."""
        done = []
        for k, (text,) in self.waiting.iterator():
            at, seq, place = k
            out, missed = self._resolved(text, at)
            if not missed or passed is None or at < passed:
                done.append((at, seq, place))
                yield self._row(key, at, None if seq < 0 else seq, "response", out, None, None, missed)
            elif timers:
                self.handle.registerTimer(at + 1)
        for k in done:
            self.waiting.removeKey(k)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        yield from self._let_out(key, now)
        for k in [tuple(k) for k, (_, _, expires) in self.known.iterator() if expires <= now]:
            self.known.removeKey(k)

    def close(self) -> None:
        pass

    def _see(self, kind: str, id_: str, secret: str, at: int) -> None:
        seen, expires = at, at + self.ttl_ms
        if self.known.containsKey((kind, id_)):
            _, before, until = self.known.getValue((kind, id_))
            seen, expires = min(seen, before), max(expires, until)
            if until != expires:
                self.handle.deleteTimer(until)
        self.known.updateValue((kind, id_), (secret, seen, expires))
        self.handle.registerTimer(expires)

    def _resolved(self, text: str, at: int) -> tuple[str, bool]:
        def look(kind: str, id_: str) -> str | None:
            if not self.known.containsKey((kind, id_)):
                return None
            secret, seen, expires = self.known.getValue((kind, id_))
            return secret if seen <= at < expires else None

        return restore(text, look, self.prefix)

    def _row(self, key: tuple, at_ms: int, seq: int | None, direction: str, outgoing: str | None, error: str | None, contract: str | None, missed: bool) -> Row:
        return Row(session=key[0], seq=seq, at_ms=at_ms, direction=direction, outgoing=outgoing, error_code=error, contract=contract, missed=missed)


def keyed_state(spark: SparkSession) -> None:
    """Have this session keep keyed state in the store that maps and timers need; queries that run already keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    _ = spark.streams.active  # starts what a batch with state asks for, too


def sessions(rows: DataFrame, settings: Settings, salt: bytes | None = None, lateness: timedelta = timedelta(minutes=1), text_col: str = "text") -> DataFrame:
    """session, seq, at, direction, outgoing, error_code, contract and missed of messages (session, seq, at timestamp, direction, text), batch or stream.

    direction is request or response. Requests go through messages.text_requests, in the
    JVM; a closed one has no outgoing text and maps nothing. Only what sessions share
    goes to state: outgoing texts and replacements. seq tells messages of one time apart and may be null or
    repeat. A null session is a session; a message without a time belongs to none and is not taken.
    A batch knows all requests, so nothing waits there.
    """
    keyed_state(rows.sparkSession)
    plain = rows.select("session", "seq", "at", "direction", F.col(text_col).alias("text")).where("at is not null and direction in ('request', 'response')")
    if rows.isStreaming:
        plain = plain.withWatermark("at", f"{int(lateness.total_seconds() * 1000)} milliseconds")
    asked = F.when(F.col("direction") == "request", F.col("text"))
    told = messages.text_requests(plain.withColumn("asked", asked), "asked", settings, salt)
    sent = F.when(F.col("closed"), F.array().cast(dict(told.dtypes)["replacements"])).otherwise(F.col("replacements"))
    slim = F.transform(sent, lambda r: F.struct(r["kind"].alias("kind"), r["id"].alias("id"), r["secret"].alias("secret")))
    text = F.when(F.col("direction") == "request", F.col("outgoing")).otherwise(F.col("text"))
    is_request = F.col("direction") == "request"
    state = told.select(
        "session", "seq", "at", F.unix_millis("at").alias("at_ms"), "direction", text.alias("text"), F.when(is_request, slim).alias("replacements"),
        F.when(is_request, F.col("error_code")).alias("error_code"), F.when(is_request, F.col("contract")).alias("contract"),
    )
    shape = StructType.fromDDL("session string, seq long, at_ms long, direction string, outgoing string, error_code string, contract string, missed boolean")
    ttl = int(settings.session_ttl.total_seconds() * 1000)
    done = state.groupBy("session").transformWithState(Session(settings.prefix, ttl, rows.isStreaming), shape, "Append", "EventTime")
    return done.select("session", "seq", F.timestamp_millis("at_ms").alias("at"), "direction", "outgoing", "error_code", "contract", "missed")
