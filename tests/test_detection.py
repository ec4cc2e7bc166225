from __future__ import annotations

import pytest
from cloakframe.config import Allowlist, Detection
from cloakframe.functions.local import Engine, entropy
from cloakframe.functions import scalars as S
from cloakframe.operators import detect, rewrite
from cloakframe.plans import fixtures as X
from pyspark.sql import functions as F

EXTRA = ["PIN => 'a b c d' x", "passwd: hunter2", "passcode=>tok9", "secret é" + "é" * 9 + "Ab1", "a@b.co " * 3, "4111-1111-1111-1111-", "\x01password=abcd\x02", "x" * 30, "Zażółć" * 5]


@pytest.fixture(scope="module")
def texts():
    return [t for _, t in X.TEXTS if t is not None] + EXTRA


def test_columns_and_strings_agree(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    rows = detect.with_findings(df, "text", Detection.everything()).orderBy("k").collect()
    engine = Engine(Detection.everything())
    for row, text in zip(rows, texts):
        own = [(f.start, f.stop, f.secret, f.rule_id, f.kind, f.subtype, f.source, f.confidence, f.score) for f in engine.find(text)]
        assert [(f.start, f.stop, f.secret, f.rule_id, f.kind, f.subtype, f.source, f.confidence, f.score) for f in row.findings] == own, text
        assert all(text[f.start : f.stop] == f.secret for f in row.findings)


def test_masking_is_reversible_and_idempotent(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    once = rewrite.masked(detect.with_findings(df, "text", Detection.everything()), "text", b"salt").persist()
    now = F.lit("2026-01-01").cast("timestamp")
    known = rewrite.mapping(once, seen_at=now)
    back = rewrite.resolved(once.select("k", "text", "masked"), "k", "masked", known, now)
    assert back.where("not (restored <=> text)").count() == 0
    twice = detect.with_findings(once.select("k", F.col("masked").alias("text")), "text", Detection())
    assert twice.where(F.size("findings") > 0).count() == 0
    later = rewrite.resolved(once.select("k", "masked"), "k", "masked", known, F.lit("2026-01-02").cast("timestamp"), strict=True)
    assert {r.error_code for r in later.collect()} == {None, "strict_resolve_failed"}


def test_allowlist_comes_last_and_rejects_bad_hashes():
    text = f"x={X.TOKEN}"
    assert not Engine(Detection(), Allowlist(patterns=("^Zk4",))).find(text)
    assert not Engine(Detection(), Allowlist(rule_ids=(" OPAQUE.high_entropy",))).find(text)
    with pytest.raises(Exception, match=r"secret_sha256\[0\]"):
        Allowlist(secret_sha256=("abc",))


def test_classifier_that_denies_removes_a_phone():
    text = "Call me at +1 (646) 555-0148"
    assert not Engine(Detection.everything(), classifier=lambda *_: False).find(text)
    assert Engine(Detection.everything(), classifier=lambda *_: 1 / 0).find(text)[0].source == "classifier"


def test_entropy_of_bytes(spark):
    words = ["", "a", "abcd", "aé漢", X.TOKEN]
    got = [r.h for r in spark.createDataFrame([(w,) for w in words], "t string").select(S.entropy(F.col("t")).alias("h")).collect()]
    assert got == pytest.approx([entropy(w) for w in words])
