"""The masking operators as queries over whole tables or over literal fixtures."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import replace
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..config import PREFIX, Allowlist, Detection, Hook, Settings
from ..errors import fail_closed
from ..functions import scalars as S
from ..operators import audit, bodies, detect, hooks, rewrite, rules, scope
from ..streaming import messages, sessions
from ..streaming.sse import Assembler
from ..tables import written
from ..vocabulary import placeholder_pattern
from . import fixtures as X
from . import oracle, planted

OPAQUE = Detection()
FLAT = Detection(emails=True, phones=True, national_ids=True, payment_cards=True)
EVERYTHING = Detection.everything()


def at():
    return F.lit("2026-03-10 00:00:00").cast("timestamp")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def found(spark: SparkSession, sf_dir: str, cfg: Detection = FLAT, allowlist: Allowlist | None = None) -> DataFrame:
    return detect.with_findings(detect.spread(documents(spark, sf_dir)), "text", cfg, allowlist)


def masked(spark: SparkSession, sf_dir: str, salt: bytes | None = None) -> DataFrame:
    return rewrite.masked(found(spark, sf_dir), "text", salt)


# ---- detection


def opaque_tokens(spark, sf_dir):
    rows = detect.exploded(found(spark, sf_dir, OPAQUE), "doc_id")
    return rows.select("doc_id", "start", "stop", "secret", "confidence", "score", F.round("entropy", 6).alias("entropy"))


def _candidates(spark, sf_dir, table, key, text, switch):
    detector = detect.CATALOGUE[switch][0]
    rows = detect.spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    places = detect._places(F.col(text), f"(?U)()({detector.value})")
    each = detect.each(rows.withColumn("p", places), "p", key, text).select(key, F.substring(text, F.col("f.start") + 1, F.col("f.stop") - F.col("f.start")).alias("value"))
    return each.withColumn("valid", detector.valid(F.col("value")))


def email_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir, "documents", "doc_id", "text", "emails")


def phone_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir, "documents", "doc_id", "text", "phones")


def phone_candidates_pages(spark, sf_dir):
    return _candidates(spark, sf_dir, "pages", "page_id", "html", "phones")


def card_candidates(spark, sf_dir):
    rows = _candidates(spark, sf_dir, "documents", "doc_id", "text", "payment_cards")
    return rows.withColumn("issuer", F.when(F.col("valid"), S.card_issuer(S.digits(F.col("value")))))


def overlap_resolution(spark, sf_dir):
    return detect.exploded(found(spark, sf_dir), "doc_id").select("doc_id", "start", "stop", "secret", "rule_id", "score")


def context_windows(spark, sf_dir):
    rows = detect.each(found(spark, sf_dir), "findings", "doc_id", "text").where("f.score < 70")
    return rows.select("doc_id", F.col("f.start").alias("start"), detect.context(F.col("text"), F.col("f")).alias("context"))


def allowlist_rule(spark, sf_dir):
    return detect.exploded(found(spark, sf_dir, FLAT, Allowlist(rule_ids=("Opaque.High_Entropy ",))), "doc_id").select("doc_id", "start", "secret", "rule_id")


def allowlist_pattern(spark, sf_dir):
    return detect.exploded(found(spark, sf_dir, FLAT, Allowlist(patterns=("^4", "[a-f]{3}"))), "doc_id").select("doc_id", "start", "secret", "rule_id")


# ---- scalars


def token_entropy(spark, sf_dir):
    tokens = documents(spark, sf_dir).select("doc_id", F.explode(S.tokens(F.col("text"), 12)).alias("token"))
    return tokens.select("doc_id", "token", F.round(S.entropy(F.col("token")), 6).alias("entropy"))


def luhn_and_issuer(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.lpad((F.col("o_orderkey") * 7919 + 4000000).cast("string"), 16, "4").alias("number"))
    return rows.select("o_orderkey", "number", S.luhn(F.col("number")).alias("passes"), S.card_issuer(F.col("number")).alias("issuer"))


def log_scrub_documents(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha2(S.scrub(F.col("text"), PREFIX), 256).alias("scrubbed_sha256"))


# ---- scope


def host_scope(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host = scope.host_of_url(F.col("url"))
    return pages.select(
        "page_id",
        scope.host_allowed(host, ["example.com"]).alias("suffix"),
        scope.host_allowed(host, ["blog.*", "*.example.o?g"]).alias("glob"),
        scope.host_allowed(host, []).alias("everything"),
    )


def user_turns(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.where(scope.scanned_role(F.col("role"))).select("conv_id", "turn", "text")


def body_size_limit(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", scope.body_error(F.col("text"), 4096).alias("error_code"))


def hidden_prompt(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", scope.large_hidden_prompt(F.col("text")).alias("hidden"))


# ---- rewriting and mapping


def redaction_ids(spark, sf_dir):
    each = detect.each(masked(spark, sf_dir), "replacements", "doc_id")
    return each.select("doc_id", "f.secret", "f.id", "f.placeholder", S.legacy_id(F.col("f.secret")).alias("legacy_id"))


def masked_text(spark, sf_dir):
    return masked(spark, sf_dir).where(F.size("replacements") > 0).select("doc_id", "masked")


def dry_run(spark, sf_dir):
    out = rewrite.masked(found(spark, sf_dir), "text", b"salt", dry_run=True)
    return out.select("doc_id", (F.col("masked") == F.col("text")).alias("unchanged"), rewrite.summary(F.col("replacements"), True).alias("summary"))


def kind_histogram(spark, sf_dir):
    return masked(spark, sf_dir).where(F.size("replacements") > 0).select("doc_id", rewrite.kind_histogram(F.col("replacements")).alias("kinds"))


def redact_resolve_roundtrip(spark, sf_dir):
    rows = written(masked(spark, sf_dir, b"a salt of the session").select("doc_id", "masked", "replacements"))  # read twice: texts are scanned once
    known = rewrite.mapping(rows, timedelta(hours=1), at())
    back = rewrite.resolved(rows.select("doc_id", "masked", F.size("replacements").alias("n")), "doc_id", "masked", known, at())
    return back.select("doc_id", F.col("restored").alias("text"), F.regexp_count("masked", F.lit(placeholder_pattern(PREFIX))).cast("long").alias("placeholders"))


def mapping_table(spark, sf_dir):
    known = rewrite.mapping(masked(spark, sf_dir), timedelta(hours=1), at())
    return known.select("id", "kind", "secret", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"))


def mapping_expiry(spark, sf_dir):
    """Values seen at several times: what is alive at a later one, by the latest sighting."""
    rows = masked(spark, sf_dir).withColumn("at", F.timestamp_seconds(F.unix_timestamp(at()) + F.pmod("doc_id", F.lit(5)) * 1800))
    known = rewrite.merged(rewrite.mapping(rows, timedelta(hours=1), F.col("at")), now=F.timestamp_seconds(F.unix_timestamp(at()) + 7200))
    return known.select("id", "kind", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"))


# ---- audit


def _audit(spark, sf_dir):
    return audit.audit_rows(masked(spark, sf_dir), F.col("source"), F.timestamp_seconds(F.unix_timestamp(at()) + F.col("doc_id")))


def audit_rows(spark, sf_dir):
    return _audit(spark, sf_dir).withColumn("entropy", F.round("entropy", 6))


def audit_totals(spark, sf_dir):
    return audit.totals(_audit(spark, sf_dir))


def audit_stats_kind(spark, sf_dir):
    return audit.ranked(_audit(spark, sf_dir), "kind")


def audit_stats_rule(spark, sf_dir):
    return audit.ranked(_audit(spark, sf_dir), "rule_id")


def audit_stats_host_top(spark, sf_dir):
    return audit.ranked(_audit(spark, sf_dir), "request_host", 5)


def audit_stats_all(spark, sf_dir):
    return audit.ranked_all(_audit(spark, sf_dir))


def intercept_count(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.where(scope.host_allowed(scope.host_of_url(F.col("url")), ["example.org"])).agg(F.count("*").alias("intercepted"))


def hook_records(spark, sf_dir):
    hook = Hook("request_redacted", "log", ("typed.phone",), path="unused")
    return hooks.records(masked(spark, sf_dir), hook, F.col("source"), at())


def hook_block(spark, sf_dir):
    block = (Hook("secret_detected", "block", ("typed.phone",)), Hook("secret_detected", "block", ("typed.card.pan",), message="no cards"))
    return masked(spark, sf_dir).select("doc_id", hooks.blocking_message(F.col("replacements"), block).alias("message")).where("message is not null")


# ---- bodies and streams


def _conversation_bodies(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turn = F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("m"))
    said = F.transform(F.array_sort(F.collect_list(turn)), lambda t: t["m"])
    return rows.groupBy("conv_id").agg(F.to_json(F.struct(said.alias("messages"))).alias("body"))


def body_roundtrip(spark, sf_dir):
    """Bodies of all conversations, masked with low thresholds and restored through the mapping."""
    detection = replace(EVERYTHING, entropy_threshold=3.0, entropy_min_len=12)
    rows = _conversation_bodies(spark, sf_dir)
    out = bodies.masked_bodies(rows, "conv_id", "body", Settings(detection=detection, notice_mode="off", max_body_bytes=0), b"salt")
    known = rewrite.mapping(out, timedelta(hours=1), at())
    back = bodies.restored_bodies(out.select("conv_id", "masked"), "conv_id", "masked", known, at(), strict=True)
    message = F.from_json("restored", "messages array<struct<role:string,content:string>>")["messages"]
    said = F.sha2(F.array_join(F.transform(message, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n"), 256)
    return back.select("conv_id", said.alias("said_sha256")).join(_placeholders_of(out), "conv_id")


def _placeholders_of(out):
    """How many placeholders the masked bodies hold, which are as many as replacements, and whether all are of a known kind."""
    count = F.regexp_count("masked", F.lit(placeholder_pattern(PREFIX)))
    return out.select("conv_id", (count > 0).alias("masked_some"), (count == F.size("replacements")).alias("all_there"))


#: What some take for the end of a line, but events don't.
SEPARATORS = "\u2028\u0085 "


def _reassembled(characters: int, size: int, escape: bool = True):
    """For mapInArrow over (doc_id, masked, known): the text that comes out of an event stream of fragments of so many characters, cut every so many bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, known in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                have = {(k["kind"], k["id"]): k["secret"] for k in known or ()}
                one = Assembler(lambda k, i: have.get((k, i)))  # noqa: B023
                delta = lambda at: {"delta": {"type": "input_json_delta", "partial_json": text[at : at + characters]}}  # noqa: B023, E731
                wire = b"".join(b"data: " + json.dumps(delta(at), ensure_ascii=escape).encode() + b"\n\n" for at in range(0, len(text), characters))
                events = [e for at in range(0, len(wire), size) for e in one.feed(wire[at : at + size])] + one.end()
                texts.append("".join(json.loads(e.decode()[6:])["delta"]["partial_json"] for e in events))
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def sse_reassembly(spark, sf_dir):
    """Documents with findings as event streams cut every 97 bytes; restored, their fragments join to the text again."""
    rows = masked(spark, sf_dir).where(F.size("replacements") > 0).select("doc_id", "masked", F.transform("replacements", lambda r: F.struct(r["kind"].alias("kind"), r["id"].alias("id"), r["secret"].alias("secret"))).alias("known"))

    return rows.mapInArrow(_reassembled(23, 97), "doc_id long, text string")


def masked_strings(spark, sf_dir):
    """Documents as strings anywhere in a body, every string walked; both places hold the masked text."""
    rows = documents(spark, sf_dir).select("doc_id", F.to_json(F.struct(F.struct(F.col("text").alias("t")).alias("a"), F.array(F.lit("x"), F.col("text")).alias("b"))).alias("body"))
    out = bodies.masked_bodies(rows, "doc_id", "body", Settings(detection=FLAT, notice_mode="off", max_body_bytes=0), walk="strings").where(F.size("replacements") > 0)
    return out.select("doc_id", F.get_json_object("masked", "$.a.t").alias("a"), F.get_json_object("masked", "$.b[1]").alias("b"), (F.size("replacements") / 2).cast("long").alias("n"))


def socket_messages(spark, sf_dir):
    """Documents as user and assistant content of a socket message: what the user says is masked, and alone; the contract tells so."""
    item = lambda role: F.struct(F.lit(role).alias("role"), F.col("text").alias("content"))
    rows = documents(spark, sf_dir).where("text is not null").select("doc_id", F.to_json(F.struct(F.array(item("assistant"), item("user")).alias("input"))).alias("body"))
    out = messages.body_requests(rows, "doc_id", "body", Settings(detection=FLAT, notice_mode="off", max_body_bytes=0))
    said = lambda i: F.get_json_object("outgoing", f"$.input[{i}].content")
    return out.select("doc_id", said(0).alias("assistant"), said(1).alias("user"), "contract", "closed")


def guarded_messages(spark, sf_dir):
    """Documents as plain messages under a block hook and a size limit, strict and lenient: what leaves, and why not."""
    hook = Hook("secret_detected", "block", ("typed.card.pan",))
    strict = Settings(detection=FLAT, hooks=(hook,), max_body_bytes=4096)
    out = messages.text_requests(detect.spread(documents(spark, sf_dir)), "text", strict)
    lenient = fail_closed(F.col("text"), F.col("outgoing"), F.col("error_code"), False)
    return out.select("doc_id", "error_code", "outgoing", "closed", "contract", lenient.alias("lenient"))


def restored_messages(spark, sf_dir):
    """Masked documents as responses: those with the start of a placeholder are restored by half of the mapping, the others keep it."""
    rows = masked(spark, sf_dir)
    known = rewrite.mapping(rows, timedelta(hours=1), at()).where("id < '8'")
    out = messages.responses(rows.select("doc_id", "masked"), "doc_id", "masked", known, at(), Settings())
    return out.select("doc_id", "restored")


def restored_texts(spark, sf_dir):
    """Masked documents within JSON within a text, restored as a text; larger ones aren't opened, and restored flat."""
    rows = masked(spark, sf_dir).where(F.size("replacements") > 0)
    known = rewrite.mapping(rows, timedelta(hours=1), at())
    wrapped = rows.select("doc_id", F.concat(F.lit(" "), F.to_json(F.struct(F.col("masked").alias("m")))).alias("text"))
    back = bodies.restored_bodies(wrapped, "doc_id", "text", known, at(), strict=True, as_json=False)
    return back.select("doc_id", F.get_json_object("restored", "$.m").alias("text"))


def unquoted_passwords(spark, sf_dir):
    """Each customer's key as a password without quotes, and as one that is too short."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.concat(F.lit("login passwd: k"), "c_custkey", F.lit("-zz, pin=a"), F.pmod("c_custkey", F.lit(10)), F.lit(" end")).alias("text"))
    found_ = detect.with_findings(rows, "text", Detection(entropy=False, passwords=True))
    return detect.exploded(found_, "c_custkey").select("c_custkey", "start", "secret", "rule_id", "score")


def rule_pack_documents(spark, sf_dir):
    """A pack of ten rules over all documents: keywords, groups, entropy and allowlists."""
    found_ = rules.findings(detect.spread(documents(spark, sf_dir)), "doc_id", "text", rules.from_toml(X.DOCUMENT_RULES))
    return found_.select("doc_id", "rule_id", "place", "secret", F.round("entropy", 6).alias("entropy"))


def rule_allowlists_pages(spark, sf_dir):
    """Rules whose allowlists aim at paths, lines, matches and secrets, with the url as path."""
    pages = detect.spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    found_ = rules.findings(pages, "page_id", "html", rules.from_toml(X.PAGE_RULES), "url")
    return found_.select("page_id", "rule_id", "place", "secret", F.octet_length("matched").alias("matched_bytes"))


def session_messages(spark, sf_dir):
    """Each document as a session: what is asked, and its masked text as an answer up to two hours later, through keyed state of one hour."""
    rows = written(masked(spark, sf_dir).select("doc_id", "text", "masked"))  # read for both directions: texts are masked once
    at_ = F.timestamp_seconds(F.unix_timestamp(at()) + F.col("doc_id"))
    asked = rows.select("doc_id", F.lit("request").alias("direction"), at_.alias("at"), "text")
    told = rows.select("doc_id", F.lit("response").alias("direction"), (at_ + F.make_dt_interval(mins=F.pmod("doc_id", F.lit(5)).cast("int") * 30)).alias("at"), F.col("masked").alias("text"))
    both = asked.unionByName(told).withColumns({"session": F.col("doc_id").cast("string"), "seq": F.col("doc_id")})
    out = sessions.sessions(both, Settings(detection=FLAT, max_body_bytes=0))
    return out.select(F.col("seq").alias("doc_id"), "direction", "outgoing", "contract", "missed")


def allowlist_table(spark, sf_dir):
    """Findings without those whose hash stands in a table: of all values with an even last digit of their hash, and of every customer's name."""
    each = written(detect.exploded(found(spark, sf_dir), "doc_id"))  # read several times: texts are scanned once
    values_ = each.select(S.sha256(F.col("secret")).alias("sha256")).where(F.substring("sha256", 64, 1).isin(*"02468ace"))
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.upper(F.sha2("c_name", 256)).alias("sha256"))
    return detect.without_allowed(each, values_.unionByName(names)).select("doc_id", "start", "secret", "rule_id")


def byte_places(spark, sf_dir):
    """Places in bytes beside those in characters."""
    rows = found(spark, sf_dir)
    each = detect.each(rows.withColumn("f", detect.with_byte_places(F.col("findings"), F.col("text"))), "f", "doc_id")
    return each.select("doc_id", "f.start", "f.stop", "f.start_byte", "f.stop_byte", "f.secret")


def scoped_requests(spark, sf_dir):
    """Pages as JSON and other messages: those that are looked at."""
    body = F.when(F.col("page_id") % 3 == 0, F.to_json(F.struct("page_id"))).otherwise(F.col("html"))
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", scope.host_of_url(F.col("url")).alias("host"), F.when(F.col("page_id") % 4 == 0, "application/json").alias("content_type"), body.alias("body"))
    return sources.requests(rows, Settings(hosts=("example.com", "m.*"))).select("page_id", "host")


def scoped_responses(spark, sf_dir):
    """Masked documents that need restoring: those that hold the start of a placeholder."""
    return sources.responses(masked(spark, sf_dir).select("doc_id", F.col("masked").alias("body")), Settings()).select("doc_id", F.length("body").alias("n"))


def separated_events(spark, sf_dir):
    """Masked documents with line separators planted before each space, as event streams cut every 89 bytes: fragments join to the text."""
    rows = masked(spark, sf_dir).where("text is not null")
    plant = lambda text: F.replace(text, F.lit(" "), F.lit(SEPARATORS))
    known = F.transform("replacements", lambda r: F.struct(r["kind"].alias("kind"), r["id"].alias("id"), plant(r["secret"]).alias("secret")))
    whole = rows.select("doc_id", plant(F.col("masked")).alias("masked"), known.alias("known"))
    return whole.mapInArrow(_reassembled(31, 89, escape=False), "doc_id long, text string").select("doc_id", F.sha2("text", 256).alias("text_sha256"))


_NAMES = (
    session_messages, allowlist_table, byte_places, scoped_requests, scoped_responses, separated_events,
    rule_pack_documents, rule_allowlists_pages,
    masked_strings, socket_messages, guarded_messages, restored_messages, restored_texts, unquoted_passwords, 

    opaque_tokens, email_candidates, phone_candidates, phone_candidates_pages, card_candidates, overlap_resolution, context_windows, 
    allowlist_rule, allowlist_pattern, token_entropy, luhn_and_issuer, log_scrub_documents, host_scope, user_turns,
    body_size_limit, hidden_prompt, redaction_ids, masked_text, dry_run, kind_histogram, redact_resolve_roundtrip, mapping_table, mapping_expiry,
    audit_rows, audit_totals, audit_stats_kind, audit_stats_rule, audit_stats_host_top,
    audit_stats_all, intercept_count, hook_records, hook_block, body_roundtrip, sse_reassembly,
)
QUERIES = {f.__name__: f for f in _NAMES} | planted.QUERIES
ORACLE = oracle.ORACLE | planted.ORACLE
