from __future__ import annotations

import io
import json
import re
import time
from datetime import timedelta

import pytest
from cloakframe import cli, log
from cloakframe.config import Detection, Hook, Settings, from_env, from_toml, parse_duration
from cloakframe.errors import MaskError, code_of
from cloakframe.functions.local import decoded, restore
from cloakframe.log import scrub
from cloakframe.operators import audit, bodies, classify, detect, hooks, rewrite
from cloakframe.plans import fixtures as X
from cloakframe.streaming import messages, sse
from cloakframe.streaming.sse import Assembler, fragment, head_within, split_events
from cloakframe.vocabulary import placeholder_pattern
from pyspark.sql import functions as F

EVERYTHING = Settings(detection=Detection.everything(), notice_mode="off")


def test_masked_body_restores_through_base64_and_json():
    masker = bodies.Masker(EVERYTHING, b"s")
    for _, body in X.BODIES[:5] + X.BODIES[7:8]:
        out, found, code = masker.body(body)
        known = {(f["kind"], f["id"]): f["secret"] for f in found}
        back, missed = bodies._restored(out, lambda k, i: known.get((k, i)), "VEIL", True)
        assert code is None and not missed and json.loads(back) == json.loads(body)


def test_assistant_turns_and_hidden_prompts_stay():
    secret = "token = " + X.TOKEN
    masker = bodies.Masker(EVERYTHING)
    assert masker.body(json.dumps({"messages": [{"role": "assistant", "content": secret}]}))[1] == []
    assert len(masker.body(json.dumps({"messages": [{"content": secret}]}))[1]) == 1
    assert masker.body(json.dumps({"input": [], "prompt": secret + " x" * 5000}))[1] == []
    assert len(masker.body(json.dumps({"prompt": secret + " password x" * 1000}))[1]) >= 1


def test_dry_run_leaves_the_body():
    body = '{"messages": [{"role": "user", "content": "email=dora@harbour.dev"}]}'
    out, found, _ = bodies.Masker(Settings(detection=Detection.everything(), dry_run=True)).body(body)
    assert out == body and len(found) == 1 and "alice" not in found[0]["placeholder"]


def test_notice_goes_where_the_model_reads_it():
    said = lambda tree: bodies.add_notice(tree, "n")
    assert said({"model": "claude", "system": "s"})["system"] == "s\n\n[VEIL] n"
    assert said({"model": "claude", "system": []})["system"] == [{"type": "text", "text": "[VEIL] n"}]
    assert said({"messages": []})["messages"][-1]["role"] == "developer"
    assert said({"x": 1}) == {"x": 1} and said([1]) == [1]


def test_strict_base64():
    assert decoded("aGVsbG8gd29ybGQsIGhlbGxvIHdvcmxk")[0] == "hello world, hello world"
    assert decoded("aGVsbG8gd29ybGQsIGhlbGxvIHdvcmxl-") is None
    assert decoded("short") is None


@pytest.mark.parametrize("cut", [1, 4, 7, 50, 1000])
def test_stream_reassembly(cut):
    secret, mark = "é漢", "{{VEIL_OPAQUE_deadbeefcafebabe}}"
    text = f'{{"a":"{mark}","b":"{{{{VEIL_x"}}'
    wire = b"event: ping\ndata: [DONE]\n\n" + b"".join(
        b"event: d\ndata: " + json.dumps({"delta": {"type": "input_json_delta", "partial_json": text[i : i + 3]}}).encode() + b"\r\n\r\n" for i in range(0, len(text), 3)
    )
    one = Assembler(lambda k, i: secret)
    events = [e for i in range(0, len(wire), cut) for e in one.feed(wire[i : i + cut])] + one.end()
    parts = [fragment(e)[1] for e in events if fragment(e)]
    assert events[0].startswith(b"event: ping")
    assert "".join(parts) == text.replace(mark, secret)
    assert not any("VEIL_OPAQUE" in p for p in parts)


def test_frames_and_heads():
    assert split_events(b"a", b"b\n\nc") == ([b"ab\n\n"], b"c")
    assert head_within("é漢", 4) == "é"
    assert restore("{{VEIL_OPAQUE_xxxx}}", lambda k, i: "no") == ("{{VEIL_OPAQUE_xxxx}}", False)


def test_streaming_query(spark, tmp_path):
    from cloakframe.streaming.sse import reassembled

    mark = "{{VEIL_OPAQUE_deadbeefcafebabe}}"
    event = lambda t: b"data: " + json.dumps({"delta": {"type": "input_json_delta", "partial_json": t}}).encode() + b"\n\n"
    rows = [("s", 1, bytearray(event("x " + mark[:9])), False), ("s", 2, bytearray(event(mark[9:])), False), ("s", 3, bytearray(event(" y")), True)]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], "stream_id string, seq long, frame binary, last boolean").write.parquet(str(tmp_path / f"in/{i}"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else a timeout that is due keeps the query from ending
    frames = spark.readStream.schema("stream_id string, seq long, frame binary, last boolean").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = reassembled(frames, lambda k, i: "SECRET").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    assert query.awaitTermination(240)
    out = spark.read.parquet(str(tmp_path / "out")).orderBy("n").collect()
    assert "".join(fragment(bytes(r.event))[1] for r in out) == "x SECRET y"


def test_settings():
    s = from_toml('session_ttl = "1h30m"\n[detection]\nemails = true\n[[hooks]]\nevent = "secret_detected"\naction = "block"\n')
    assert s.session_ttl.total_seconds() == 5400 and s.detection.emails and s.hooks[0].action == "block"
    for bad in ("x = 1", "[detection]\nx = true", '[[hooks]]\nevent = "e"\naction = "log"', '[[hooks]]\nevent = "secret_detected"\naction = "log"', 'session_ttl = "1x"'):
        with pytest.raises(MaskError):
            from_toml(bad)
    e = from_env({"CLOAKFRAME_EMAILS": "no", "CLOAKFRAME_ENTROPY_THRESHOLD": "bad", "CLOAKFRAME_AUDIT_PATH": "off"}, s)
    assert not e.detection.emails and e.detection.entropy_threshold == 3.5 and e.audit_path is None
    assert parse_duration("250ms").total_seconds() == 0.25


def test_audit_source(spark, tmp_path):
    assert audit.read(spark, str(tmp_path / "none")).count() == 0
    path = tmp_path / "a.jsonl"
    path.write_text("\n".join(json.dumps(dict(zip(("ts", "rule_id", "kind", "request_host", "action"), r))) for r in X.AUDIT) + "\n\n" + '{"action":"redacted"}\n')
    rows = audit.read(spark, str(path))
    total = audit.totals(rows).first()
    assert (total.total_redactions, total.latest_event) == (5, "2026-03-10T00:00:03Z")
    assert [tuple(r) for r in audit.ranked(rows, "request_host", 0).collect()] == [("api.one.example", 2)]
    path.write_text("{bad\n")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        audit.totals(audit.read(spark, str(path))).collect()


def test_hooks(spark):
    rows = spark.createDataFrame([(1, [("typed.email",)]), (2, [])], "k int, replacements array<struct<rule_id:string>>")
    said = rows.select("k", hooks.blocking_message(F.col("replacements"), [Hook("secret_detected", "block", ("*",))]).alias("m")).orderBy("k").collect()
    assert said[0].m == "request blocked by hook for rule typed.email" and said[1].m is None
    with pytest.raises(PermissionError):
        hooks.run_exec(rows, Hook("request_redacted", "exec", command="true"))


def test_log_scrub_of_strings_and_doctor(capsys):
    for _, line, scrubbed in X.LOG_LINES:
        assert scrub(line) == scrubbed
    assert cli.main(["doctor"]) == 0 and "PASS detection" in capsys.readouterr().out


def test_messages_of_a_stream_in_both_directions(spark, tmp_path):
    """Requests are masked or closed, hooks run, the mapping forgets, responses are restored."""
    settings = Settings(detection=Detection(emails=True), hooks=(Hook("request_redacted", "log", path=str(tmp_path / "hook")), Hook("secret_detected", "block", ("typed.email",), message="no mail")), session_ttl=timedelta(hours=1))
    rows = spark.createDataFrame([(1, f"key {X.TOKEN}"), (2, f"{X.TOKEN} and dora@harbour.dev"), (3, "plain"), (4, None)], "k long, text string")
    path = str(tmp_path / "kept")
    out = messages.text_requests(rows, "text", settings, b"s")
    got = {r.k: r for r in out.collect()}
    assert got[1].outgoing.startswith("key {{VEIL_OPAQUE_") and got[1].contract == "placeholder:v2" and not got[1].closed
    assert got[2].outgoing is None and got[2].closed and got[2].error_code == "hook_blocked" and got[2].contract is None
    assert got[3].outgoing == "plain" and got[3].contract is None and not got[4].closed
    keep = messages.keep_mapping(path, settings, compact_every=2)
    for number in range(3):
        keep(out, number)
    assert messages._live(messages._parts(spark, path)) == ["upto=2"] and len(messages._parts(spark, path)) == 4  # a reader may still hold the old ones
    assert [r.kind for r in messages.current_mapping(spark, path).collect()] == ["opaque_token"]
    logged = spark.read.json(str(tmp_path / "hook")).collect()
    assert {r.rule_id for r in logged} == {"opaque.high_entropy"} and X.TOKEN not in str(logged)
    seen = []
    messages.each_response(path, "k", "outgoing", settings, lambda df, n: seen.extend(df.collect()))(out, 0)
    assert {r.k: r.restored for r in seen} == {1: f"key {X.TOKEN}", 2: None, 3: "plain", 4: None}
    messages.compact_mapping(spark, path, 9, now=F.current_timestamp() + F.expr("INTERVAL 2 HOURS"))
    assert messages.current_mapping(spark, path).count() == 0 and sorted(messages._parts(spark, path)) == ["upto=2", "upto=9"]
    assert messages.current_mapping(spark, str(tmp_path / "none")).count() == 0


def test_a_mapping_that_is_compacted_under_a_reader(spark, tmp_path):
    rows = rewrite.masked(detect.with_findings(spark.createDataFrame([(1, X.TOKEN)], "k int, t string"), "t", Detection()), "t").withColumn("closed", F.lit(False))
    path = str(tmp_path / "kept")
    keep = messages.keep_mapping(path, Settings(), compact_every=0)
    for number in range(3):
        keep(rows, number)
    reader = messages.current_mapping(spark, path)
    messages.compact_mapping(spark, path, 1)
    assert reader.count() == 1 == messages.current_mapping(spark, path).count()
    messages.compact_mapping(spark, path, 1)  # a batch that is tried again
    assert sorted(messages._live(messages._parts(spark, path))) == ["batch=2", "upto=1"]
    messages.compact_mapping(spark, path, 2)
    assert sorted(messages._parts(spark, path)) == ["batch=2", "upto=1", "upto=2"] and messages.current_mapping(spark, path).count() == 1


def _known(spark, *rows):
    return spark.createDataFrame([(*r, "2999-01-01") for r in rows], "id string, kind string, secret string, e string").select("id", "kind", "secret", F.col("e").cast("timestamp").alias("expires_at"))


def test_repeated_and_null_keys_are_restored(spark):
    mark, other = "{{VEIL_OPAQUE_deadbeefcafebabe}}", "{{VEIL_EMAIL_0123456789abcdef}}"
    known = _known(spark, ("deadbeefcafebabe", "opaque_token", "v"), ("deadbeefcafebabe", "opaque_token", "v"), ("0123456789abcdef", "email", "m@x.y"))
    rows = [(1, json.dumps({"a": mark})), (1, json.dumps({"a": mark + other})), (None, json.dumps({"a": other})), (None, json.dumps({"a": mark})), (2, None), (2, "no json " + mark), (2, "{}")]
    want = sorted([(1, '{"a":"v"}'), (1, '{"a":"vm@x.y"}'), (None, '{"a":"m@x.y"}'), (None, '{"a":"v"}'), (2, None), (2, "no json " + mark), (2, "{}")], key=str)
    df = spark.createDataFrame(rows, "k int, body string")
    got = bodies.restored_bodies(df, "k", "body", known, F.current_timestamp())
    assert sorted([(r.k, r.restored) for r in got.collect()], key=str) == want
    texts = spark.createDataFrame([(1, mark), (1, other), (None, mark), (None, None), (2, "x")], "k int, t string")
    got = rewrite.resolved(texts, "k", "t", known, F.current_timestamp())
    assert sorted([(r.k, r.restored) for r in got.collect()], key=str) == sorted([(1, "v"), (1, "m@x.y"), (None, "v"), (None, None), (2, "x")], key=str)


def _events(*parts, escape=False):
    return b"".join(b"event: x\ndata: " + json.dumps({"delta": {"type": "input_json_delta", "partial_json": p}}, ensure_ascii=escape).encode("utf-8", "surrogatepass") + b"\n\n" for p in parts)


def _joined(events):
    return "".join(f[1] for f in map(sse.fragment, events) if f)


@pytest.mark.parametrize("sign", ["\u2028", "\u0085", "\u2029", "\x0b", "\x1c", "\u00e9"])
def test_fragments_with_line_separators_are_restored(sign):
    mark = "{{VEIL_OPAQUE_deadbeefcafebabe}}"
    wire = _events(f"a{sign}{mark[:9]}", f"{mark[9:]}{sign}b")
    for size in (1, 7, len(wire)):
        one = sse.Assembler(lambda k, i: "v")
        events = [e for at in range(0, len(wire), size) for e in one.feed(wire[at : at + size])] + one.end()
        assert _joined(events) == f"a{sign}v{sign}b"


def test_half_a_surrogate_pair_and_invalid_bytes_pass():
    one = sse.Assembler(lambda k, i: "v")
    events = one.feed(_events("\ud83d", "{{VEIL_", "x", escape=True) + b": \xff\ndata: {\xfe}\n\n") + one.end()
    assert _joined(events) == "\ud83d{{VEIL_x" and events[-1] == b": \xff\ndata: {\xfe}\n\n"


def test_a_held_event_that_is_not_utf8_stays_in_state(spark, tmp_path):
    """A comment line with byte FF beside a fragment that waits for the rest of a placeholder, over micro-batches."""
    mark = "{{VEIL_OPAQUE_deadbeefcafebabe}}"
    first = b": \xff\n" + _events(mark[:12])
    (tmp_path / "in").mkdir()
    schema = "stream_id string, seq long, frame binary, last boolean"
    for seq, frame in enumerate((first, _events(mark[12:] + " end"))):
        spark.createDataFrame([("s", seq, bytearray(frame), seq == 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frames = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = sse.reassembled(frames, lambda k, i: "v").writeStream.format("memory").queryName("held").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    events = [bytes(r.event) for r in spark.table("held").orderBy("n").collect()]
    assert _joined(events) == "v end" and events[0].startswith(b": \xff\n")


def test_a_batch_that_is_tried_again_acts_once(spark, tmp_path):
    """One line and one command for each record, also if the batch failed between its hooks or after them."""
    told = tmp_path / "told"
    settings = Settings(
        detection=Detection(emails=True),
        hooks=(Hook("secret_detected", "log", path=str(tmp_path / "hook")), Hook("secret_detected", "exec", command=f"echo $CLOAKFRAME_RULE_ID >> {told}"), Hook("request_redacted", "log", path=str(tmp_path / "hook"))),
    )
    rows = spark.createDataFrame([(1, "dora@harbour.dev"), (2, "theo@harbour.dev and dora@harbour.dev"), (3, "x")], "k int, text string").repartition(2)
    keep = messages.keep_mapping(str(tmp_path / "kept"), settings, allow_exec=True)
    out = messages.text_requests(rows, "text", settings, b"s")
    dispatch, calls = hooks.dispatch, []

    def failing(*args, **kw):
        dispatch(*args, **kw)
        calls.append(args[2])
        if len(calls) == 1:
            raise RuntimeError("lost after the first event's hooks")

    with pytest.MonkeyPatch.context() as m:
        m.setattr(hooks, "dispatch", failing)
        with pytest.raises(RuntimeError):
            keep(out, 5)
    for _ in range(2):
        keep(out, 5)
    assert told.read_text() == "typed.email\n" * 3
    logged = spark.read.json(str(tmp_path / "hook")).groupBy("event").count().collect()
    assert {r.event: r["count"] for r in logged} == {"secret_detected": 3, "request_redacted": 3}
    audited = spark.read.json(str(tmp_path / "kept" / "audit")).count()
    assert audited == 3 and messages.current_mapping(spark, str(tmp_path / "kept")).count() == 2
    keep(out, 6)
    assert told.read_text() == "typed.email\n" * 6
    with pytest.raises(PermissionError):
        messages.keep_mapping(str(tmp_path / "other"), settings)(out, 0)


def test_counters_of_a_stream(spark, tmp_path):
    settings = Settings(detection=Detection(emails=True), max_body_bytes=30)
    schema = "k int, text string"
    for texts in (["dora@harbour.dev", "x", None], ["dora@harbour.dev theo@harbour.dev is too long", "theo@harbour.dev"]):
        spark.createDataFrame(list(enumerate(texts)), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    counters = messages.Counters("messages")
    spark.streams.addListener(counters)
    try:
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        judged = messages.counted(messages.text_requests(rows, "text", settings), "messages")
        query = judged.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        for _ in range(100):
            if len(counters.batches) >= 2:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(counters)
    by_batch = [counters.batches[k] for k in sorted(counters.batches, key=lambda k: k[1])]
    assert sorted(b["intercepted"] for b in by_batch) == [2, 3]
    assert counters.totals() == {"intercepted": 5, "masked": 2, "closed": 1, "blocked": 0, "replacements": 2}


def test_malformed_audit_lines_are_named(spark, tmp_path):
    good = json.dumps({"ts": "2026-01-01T00:00:00Z", "rule_id": "r", "kind": "k", "request_host": "h", "action": "redacted"})
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text("\n".join([good] * 900 + ["", "{broken", good, "[1]"] + [good] * 500 + ["no json"]) + "\n")
    (tmp_path / "log" / "b.json").write_text(good + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        assert spark.read.text(str(tmp_path / "log")).rdd.getNumPartitions() > 8
        got = audit.malformed(spark, str(tmp_path / "log")).orderBy("line").collect()
        assert [(r.file.rsplit("/", 1)[1], r.line, r.value) for r in got] == [("a.json", 902, "{broken"), ("a.json", 904, "[1]"), ("a.json", 1405, "no json")]
        with pytest.raises(MaskError, match="a.json:902:"):
            audit.checked(spark, str(tmp_path / "log"))
        assert audit.checked(spark, str(tmp_path / "log" / "b.json")).count() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_allowlist_of_a_million_hashes(spark):
    hashes = spark.range(1_000_000).select(F.sha2(F.concat(F.lit("value "), "id"), 256).alias("sha256"))
    odd = hashes.limit(3).unionAll(spark.createDataFrame([(None,), ("",)], "sha256 string"))
    found = spark.range(2000).select(F.col("id").alias("k"), F.concat(F.lit("value "), F.col("id") * 997).alias("secret")).unionAll(spark.createDataFrame([(9, None), (8, "")], "k long, secret string"))
    got = detect.without_allowed(found, hashes.unionAll(odd))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "bloom" in plan
    want = {(k, f"value {k * 997}") for k in range(2000) if k * 997 >= 1_000_000} | {(9, None), (8, "")}
    assert {(r.k, r.secret) for r in got.collect()} == want
    none = detect.without_allowed(found, odd.where("sha256 = ''"))
    assert none.count() == 2002


def test_byte_places(spark):
    text = "é dora@harbour.dev 日本 theo@harbour.dev 😀"
    rows = spark.createDataFrame([(1, text), (2, "dora@harbour.dev"), (3, ""), (4, None), (5, "é")], "k int, t string")
    out = detect.with_findings(rows, "t", Detection(emails=True)).withColumn("b", detect.with_byte_places(F.col("findings"), F.col("t")))
    got = {r.k: [(f.start_byte, f.stop_byte) for f in r.b or []] for r in out.collect()}
    at = [len(text[: text.index(s)].encode()) for s in ("dora", "theo")]
    assert got == {1: [(a, a + 16) for a in at], 2: [(0, 16)], 3: [], 4: [], 5: []}


def test_hooks_are_checked_where_they_are_made():
    for bad in (("other", "log"), ("secret_detected", "mail"), ("secret_detected", "log"), ("secret_detected", "exec"), ("request_redacted", "block")):
        with pytest.raises(MaskError):
            Hook(*bad)


def test_a_text_with_control_characters_is_restored(spark):
    text = "a\x01b\ue000c {{VEIL_OPAQUE_deadbeefcafebabe}}\x01"
    known = spark.createDataFrame([("deadbeefcafebabe", "opaque_token", "v", "2999-01-01")], "id string, kind string, secret string, e string").select("id", "kind", "secret", F.col("e").cast("timestamp").alias("expires_at"))
    got = rewrite.resolved(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t", known, F.current_timestamp()).first()
    assert got.restored == "a\x01b\ue000c v\x01"


def test_prefix_is_taken_literally():
    assert re.search(placeholder_pattern("A.B"), "{{AxB_OPAQUE_deadbeefcafebabe}}") is None
    assert re.search(placeholder_pattern("A.B"), "{{A.B_OPAQUE_deadbeefcafebabe}}")


def test_findings_are_worked_out_once(spark):
    """Filters on what was found don't have it worked out again."""
    rows = spark.createDataFrame([(1, "x")], "k int, t string")
    out = rewrite.masked(detect.with_findings(rows, "t", Detection.everything()), "t").where(F.size("replacements") > 0).select("masked")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("national id") == 1, plan


def test_log_levels_and_scrubbed_messages(capsys):
    log.LOGGER.handlers.clear()
    log.configure(" Warning ")
    log.emit("info", "quiet")
    log.emit("error", "password=hunter22", "invalid_json")
    log.configure("debug")
    log.emit("debug", "now")
    assert capsys.readouterr().err == "cloakframe error: invalid_json: password=[redacted]\ncloakframe debug: now\n"
    with pytest.raises(MaskError):
        log.configure("loud")


def test_a_model_that_is_asked_about_findings(spark):
    """Replies decide, failures accept."""

    def ask(asked):
        value = json.loads(asked)["value"]
        if "646" in value:
            raise OSError("no network")
        return " deny" if value.startswith("1 (") else "allow it"

    rows = spark.createDataFrame([(1, "call +1 (212) 555-0123"), (2, "call 646-555-0177"), (3, "call 212-555-0177")], "k int, t string")
    out = detect.with_findings(rows, "t", Detection(entropy=False, phones=True), classifier=classify.asking(ask))
    got = {r.k: [f.source for f in r.findings] for r in out.collect()}
    assert got == {1: [], 2: ["classifier"], 3: ["classifier"]}


def test_report(spark):
    rows = spark.createDataFrame([r for r in X.AUDIT], "ts string, rule_id string, kind string, request_host string, action string")
    said = audit.render(rows, "p", 1).splitlines()
    assert said[:2] == ["4 masked values in p", "last at 2026-03-10T00:00:03Z"] and "  2 email" in said and "  2 api.one.example" in said
    assert "  nothing" in audit.render(rows.limit(0), "p")


def test_hooks_of_the_command_line(tmp_path, monkeypatch, capsys):
    """redact logs what it changed, runs a command for it, and is blocked by a found card."""
    log_path, told = tmp_path / "hook.jsonl", tmp_path / "told"
    conf = tmp_path / "c.toml"
    conf.write_text(f"""notice_mode = "off"
audit_path = "off"
[detection]
payment_cards = true
[[hooks]]
event = "request_redacted"
action = "log"
path = "{log_path}"
[[hooks]]
event = "secret_detected"
action = "exec"
command = "cat >> {told}; echo $CLOAKFRAME_RULE_ID >> {told}"
rule_ids = ["opaque.high_entropy"]
[[hooks]]
event = "secret_detected"
action = "block"
rule_ids = ["typed.card.pan"]
""")
    monkeypatch.setattr("sys.stdin", io.StringIO(X.BODIES[0][1]))
    assert cli.main(["--config", str(conf), "redact"]) == 0
    record = json.loads(log_path.read_text())
    assert record["rule_id"] == "opaque.high_entropy" and record["event"] == "request_redacted" and X.TOKEN not in log_path.read_text() + told.read_text()
    assert told.read_text().endswith("opaque.high_entropy\n")
    monkeypatch.setattr("sys.stdin", io.StringIO('{"messages":[{"role":"user","content":"card 4111 1111 1111 1111"}]}'))
    assert cli.main(["--config", str(conf), "redact"]) == 1
    assert "hook_blocked" in capsys.readouterr().err


def test_command_line_round_trip_and_codes(tmp_path, monkeypatch, capsys):
    mapping = tmp_path / "mapping"
    conf = tmp_path / "c.toml"
    conf.write_text('notice_mode = "off"\naudit_path = "off"\n')
    run = lambda *words: cli.main(["--config", str(conf), *words])
    monkeypatch.setattr("sys.stdin", io.StringIO(X.BODIES[0][1]))
    assert run("redact", "--mapping", str(mapping)) == 0
    masked = capsys.readouterr().out
    assert X.TOKEN not in masked and mapping.stat().st_mode & 0o77 == 0
    monkeypatch.setattr("sys.stdin", io.StringIO(masked))
    assert run("resolve", "--mapping", str(mapping)) == 0
    assert json.loads(capsys.readouterr().out) == json.loads(X.BODIES[0][1])
    monkeypatch.setattr("sys.stdin", io.StringIO("no json"))
    assert run("redact") == 1 and "invalid_json" in capsys.readouterr().err
    assert run("resolve", "--mapping", str(tmp_path / "none")) == 1 and capsys.readouterr().err.startswith("failed: ")


def test_the_nearest_code_of_a_chain_counts():
    try:
        try:
            raise MaskError("inner", "invalid_json")
        except MaskError as e:
            raise ValueError("outer") from e
    except ValueError as e:
        assert code_of(e) == "invalid_json"
    assert code_of(ValueError("x")) is None and code_of(None) is None
