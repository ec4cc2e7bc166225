from __future__ import annotations

import random
from datetime import datetime, timedelta

from cloakframe.config import Detection, Settings
from cloakframe.streaming import messages, sessions
from pyspark.sql import functions as F

SETTINGS = Settings(detection=Detection(emails=True), session_ttl=timedelta(hours=1))
RAW = "session string, seq long, at string, direction string, text string"
T0 = datetime(2026, 1, 1)


def table(spark, rows):
    return spark.createDataFrame([(s, n, (T0 + timedelta(minutes=m)).isoformat(" "), d, t) for s, n, m, d, t in rows], RAW).withColumn("at", F.col("at").cast("timestamp"))


def mark(spark, secret):
    return messages.text_requests(spark.createDataFrame([(secret,)], "t string"), "t", SETTINGS).select("outgoing").first()[0]


class Feed:
    """A folder that is read as a stream, one file a micro-batch, with a query that can be stopped and started."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, folder, 0
        (folder / "in").mkdir()

    def put(self, rows):
        table(self.spark, rows).coalesce(1).write.mode("append").parquet(str(self.folder / "in"))

    def run(self):
        schema = "session string, seq long, at timestamp, direction string, text string"
        stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(self.folder / "in"))
        out = sessions.sessions(stream, SETTINGS, lateness=timedelta(minutes=10))
        query = out.writeStream.format("parquet").option("path", str(self.folder / "out")).option("checkpointLocation", str(self.folder / "c")).trigger(availableNow=True).start()
        query.awaitTermination(240)
        return {(r.session, r.seq): (r.outgoing, r.missed) for r in self.spark.read.parquet(str(self.folder / "out")).collect()}


def test_both_directions_in_one_stream_with_late_messages_and_a_restart(spark, tmp_path):
    dora, theo = mark(spark, "dora@harbour.dev"), mark(spark, "theo@harbour.dev")
    feed = Feed(spark, tmp_path)
    feed.put([("s", 1, 0, "request", "to dora@harbour.dev"), ("s", 2, 1, "response", f"from {dora}"), ("q", 1, 1, "response", f"not yours {dora}"), ("s", 3, 2, "response", None)])
    feed.put([("s", 4, 5, "response", f"{theo} too early"), ("s", 5, 5, "response", "plain")])
    got = feed.run()
    assert got["s", 1] == (f"to {dora}", False) and got["s", 2] == ("from dora@harbour.dev", False) and got["s", 3] == (None, False) and got["s", 5] == ("plain", False)
    assert ("s", 4) not in got and ("q", 1) not in got  # their requests may still come
    feed.put([("s", 6, 4, "request", "late theo@harbour.dev")])  # the query starts again from its checkpoint
    got = feed.run()
    assert got["s", 4] == ("theo@harbour.dev too early", False) and got["s", 6] == (f"late {theo}", False)
    feed.put([("s", 7, 40, "request", "again dora@harbour.dev"), ("z", 1, 40, "request", "x")])
    feed.put([("s", 8, 90, "response", f"{dora} {theo}"), ("z", 2, 90, "request", "x")])  # dora was seen again, theo has expired
    feed.put([("z", 3, 200, "request", "x")])
    feed.put([("s", 9, 201, "response", f"{dora}"), ("z", 4, 300, "request", "x")])
    got = feed.run()
    assert got["q", 1] == (f"not yours {dora}", True)
    assert got["s", 8] == (f"dora@harbour.dev {theo}", True) and got["s", 9] == (dora, True)
    assert len(got) == 9 + 1 + 4


def plain(spark, rows):
    """The same by loops: a response gets what its session first saw by then and last saw less than an hour before, or will yet see within its span."""
    secrets = sorted({w for _, _, _, d, t in rows if d == "request" and t for w in t.split() if "@" in w})
    marks = {s: mark(spark, s) for s in secrets}
    spans = {}
    for s, _, m, d, t in rows:
        for w in (t or "").split() if d == "request" else ():
            if "@" in w:
                a, b = spans.get((s, w), (m, m))
                spans[s, w] = (min(a, m), max(b, m))
    out = []
    for s, n, m, d, t in rows:
        missed = False
        for secret in secrets if t else ():
            if d == "request":
                t = t.replace(secret, marks[secret])
            elif marks[secret] in t:
                a, b = spans.get((s, secret), (1, 0))
                live = a <= m < b + 60 if a <= b else False
                t = t.replace(marks[secret], secret) if live else t
                missed = missed or not live
        out.append((s, n, t, missed))
    return sorted(out, key=str)


def test_batch_matches_plain_sessions(spark):
    rng = random.Random(4)
    names = ["dora@harbour.dev", "theo@harbour.dev", "mina@harbour.dev"]
    marks = {s: mark(spark, s) for s in names}
    rows = []
    for n in range(160):
        direction = rng.choice(["request", "response"])
        words = [rng.choice(names if direction == "request" else list(marks.values())) if rng.random() < 0.4 else "word" for _ in range(rng.randint(0, 5))]
        rows.append((rng.choice(["a", "b", None, "hot", "hot", "hot"]), n, rng.randint(0, 400), direction, " ".join(words) if rng.random() < 0.95 else None))
    got = sessions.sessions(table(spark, rows).repartition(3), SETTINGS)
    assert sorted([(r.session, r.seq, r.outgoing, r.missed) for r in got.collect()], key=str) == plain(spark, rows)
    assert sessions.sessions(table(spark, []), SETTINGS).count() == 0


def test_closed_requests_map_nothing(spark):
    small = Settings(detection=Detection(emails=True), max_body_bytes=20)
    dora = mark(spark, "dora@harbour.dev")
    rows = [("s", 1, 0, "request", "a text that is too long: dora@harbour.dev"), ("s", 2, 1, "response", dora), ("s", None, 1, "other", "x")]
    got = {r.seq: r for r in sessions.sessions(table(spark, rows), small).collect()}
    assert got[1].outgoing is None and got[1].error_code == "body_too_large" and got[2].outgoing == dora and got[2].missed and len(got) == 2
