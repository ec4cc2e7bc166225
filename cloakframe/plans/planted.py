"""Queries over values that are planted into every row of a given table, each with SQL that says what must be found.

Templates hold {k}, {3} and {4}: the row's key as six, three and four digits. What a template holds is
written beside it by hand; the SQL only puts the key in.
"""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PREFIX, Allowlist, Detection, Settings
from ..errors import fail_closed
from ..functions import scalars as S
from ..operators import audit, bodies, detect, rewrite, scope
from . import fixtures as X
from .oracle import URL_HOST, all_lists, literal, quoted

EVERYTHING = Detection.everything()
AT = "2026-03-10 00:00:00"

_OPAQUE = (X.TOKEN, "opaque.high_entropy", "opaque_token", "high_entropy", "entropy", "high", 92)
_MAIL = ("u{k}@harbour.dev", "typed.email", "email", "email_address", "heuristic", "high", 90)
_CARD = ("typed.card.pan", "payment_card", "visa", "heuristic", "high", 96)
_CVV = ("9{2}", "typed.card.cvv", "cvv", "card_cvv", "heuristic", "low", 56)
_PHONE = ("typed.phone", "phone", "phone_number", "heuristic", "low", 55)
_SSN = ("219-09-{4}", "typed.id.ssn", "national_id", "us_ssn", "heuristic", "high", 94)
#: Texts, and what each holds.
TEXTS: list[tuple[str | None, list[tuple]]] = [
    ('login password="Wint3r{k}!" ok', [("Wint3r{k}!", "typed.password.labeled", "password", "labeled", "heuristic", "high", 92)]),
    ("use postgres://app:g4t{k}@db/x", [("g4t{k}", "typed.password.dsn", "password", "dsn_userinfo", "heuristic", "high", 95)]),
    ("passport number: KD4{k}", [("KD4{k}", "typed.passport", "passport", "passport_number", "heuristic", "low", 58)]),
    ("tax id = KD-{k}", [("KD-{k}", "typed.id.labeled", "national_id", "labeled_id", "heuristic", "low", 58)]),
    ("ssn 219-09-{4}", [_SSN]),
    ("card 4111 1111 1111 1111 x cvv=9{2}", [("4111 1111 1111 1111 ", *_CARD), _CVV]),
    ("cvv=9{2} and no number", []),
    ("mail me: u{k}@harbour.dev", [_MAIL]),
    (f"token {X.TOKEN} of {{k}}", [_OPAQUE]),
    ("Call me at +1 (646) 5{2}-0{3}", [("1 (646) 5{2}-0{3}", *_PHONE)]),
    ("ring 646-5{2}-0{3} please", [("646-5{2}-0{3}", *_PHONE)]),
    ("é ssn=219-09-{4} 漢 u{k}@harbour.dev é", [_SSN, _MAIL]),
    ("plain {k}", []),
    ("", []),
    (None, []),
]


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")


def chosen(templates: list[str | None], key: str = "c_custkey") -> Column:
    """The template of a row, by its key, with the key put in."""
    text = F.get(F.array(*map(F.lit, templates)), F.pmod(key, F.lit(len(templates))).cast("int"))
    for name, width in (("k", 6), ("4", 4), ("3", 3), ("2", 2)):
        digits = F.lpad(F.pmod(key, F.lit(10**width)).cast("string"), width, "0")
        text = F.replace(text, F.lit(f"{{{name}}}"), digits)
    return text


def filled(text: str, key: str = "c_custkey") -> str:
    """SQL for a template, given as SQL, with the key put in."""
    for name, width in (("k", 6), ("4", 4), ("3", 3), ("2", 2)):
        text = f"replace({text}, '{{{name}}}', lpad(({key} % {10**width})::VARCHAR, {width}, '0'))"
    return text


def texts(spark, sf_dir):
    return customers(spark, sf_dir).withColumn("text", chosen([t for t, _ in TEXTS]))


def found(spark, sf_dir, **options):
    return detect.exploded(detect.with_findings(texts(spark, sf_dir), "text", EVERYTHING, **options), "c_custkey")


_EXPECTED = [(i, t, *f) for i, (t, some) in enumerate(TEXTS) for f in some]
_COLUMNS = "place, template, secret_t, rule_id, kind, subtype, source, confidence, score"
_FOUND = f"""(SELECT c_custkey, (position(secret IN text) - 1)::INT AS start, (position(secret IN text) - 1 + length(secret))::INT AS stop, * EXCLUDE (c_custkey) FROM
  (SELECT c_custkey, {filled("template")} AS text, {filled("secret_t")} AS secret, rule_id, kind, subtype, source, confidence, score
   FROM customer JOIN (SELECT * FROM {literal(_EXPECTED, _COLUMNS)}) t ON c_custkey % {len(TEXTS)} = place))"""


def typed_fixture(spark, sf_dir):
    """Each customer's text of a kind of secret, of two, or of none: everything that is found."""
    return found(spark, sf_dir).select("c_custkey", "start", "stop", "secret", "rule_id", "kind", "subtype", "source", "confidence", "score")


def classifier_filter(spark, sf_dir):
    """A classifier that accepts phone numbers with brackets only."""
    rows = found(spark, sf_dir, classifier=lambda kind, subtype, value, context: (kind != "phone") | F.contains(value, F.lit("(")))
    return rows.where("score < 80").select("c_custkey", "secret", "rule_id", "source", "confidence", "score")


_ALLOWED = tuple(hashlib.sha256(s.encode()).hexdigest() for s in (X.TOKEN, *(f"u{k:06d}@harbour.dev" for k in range(1, 200))))


def allowlist_sha256(spark, sf_dir):
    return found(spark, sf_dir, allowlist=Allowlist(secret_sha256=_ALLOWED)).select("c_custkey", "start", "secret", "rule_id")


_SCRUB = [("row {k}: " + line, "row {k}: " + clean) for _, line, clean in X.LOG_LINES]


def log_scrub(spark, sf_dir):
    rows = customers(spark, sf_dir).withColumn("line", chosen([a for a, _ in _SCRUB]))
    return rows.select("c_custkey", S.scrub(F.col("line"), PREFIX).alias("scrubbed"))


def _pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def host_normalize(spark, sf_dir):
    """Hosts of pages as clients write them: with ports, dots, capitals, brackets."""
    own, n = scope.host_of_url(F.col("url")), F.pmod("page_id", F.lit(8))
    v6 = F.concat(F.lit("2001:db8::"), F.col("page_id") % 10000)
    written = (
        F.when(n == 0, F.concat(F.upper(own), F.lit(":443"))).when(n == 1, F.concat(F.lit(" "), own, F.lit(". "))).when(n == 2, F.lit("localhost:8080")).when(n == 3, F.concat(F.lit("["), v6, F.lit("]:443")))
        .when(n == 4, v6).when(n == 5, F.concat(F.lit("10.0.0."), F.col("page_id") % 256, F.lit(":80"))).when(n == 6, F.concat(F.lit("Plain"), "page_id")).otherwise(own)
    )
    return _pages(spark, sf_dir).select("page_id", scope.normalize_host(written).alias("normal"))


_HOST_NORMALIZE = f"""SELECT page_id, CASE page_id % 8 WHEN 2 THEN 'localhost' WHEN 3 THEN '2001:db8::' || (page_id % 10000) WHEN 4 THEN '2001:db8::' || (page_id % 10000) WHEN 5 THEN '10.0.0.' || (page_id % 256)
  WHEN 6 THEN 'plain' || page_id ELSE {URL_HOST} END AS normal FROM pages"""


def host_lists(spark, sf_dir):
    """Hosts of tools, of providers and of pages against the lists of each tool."""
    tools = Settings(hosts=("example.com",))
    hosts = [*X.CODEX, *X.CLAUDE, *X.PROVIDERS]
    asked = F.get(F.array(*map(F.lit, hosts), scope.host_of_url(F.col("url"))), F.pmod("page_id", F.lit(len(hosts) + 3)).cast("int"))
    host = F.when(F.col("page_id") % 2 == 1, asked).otherwise(F.concat(F.lit("eu."), asked))
    allowed = [scope.host_allowed(host, tools.hosts_of(t)).alias(n) for n, t in (("codex", "codex"), ("claude", " Claude"), ("other", "other"))]
    return _pages(spark, sf_dir).select("page_id", *allowed)


def _host_lists_sql() -> str:
    hosts = [*X.CODEX, *X.CLAUDE, *X.PROVIDERS]
    below = lambda some: "coalesce(" + " OR ".join(f"h = '{x}' OR h LIKE '%.{x}'" for x in (*some, *X.PROVIDERS, "example.com")) + ", false)"
    asked = f"list_concat([{', '.join(map(quoted, hosts))}], [{URL_HOST}])[page_id % {len(hosts) + 3} + 1]"
    return f"SELECT page_id, {below(X.CODEX)} AS codex, {below(X.CLAUDE)} AS claude, {below(X.CODEX + X.CLAUDE)} AS other FROM (SELECT page_id, CASE WHEN page_id % 2 = 1 THEN {asked} ELSE 'eu.' || {asked} END AS h FROM pages)"


def json_predicate(spark, sf_dir):
    """Pages and small JSON bodies under several content types."""
    n = F.pmod("page_id", F.lit(7)).cast("int")
    kind = F.get(F.array(*map(F.lit, ("application/json; charset=utf-8", "application/vnd.api+JSON", "text/plain", None, "text/html", None, "image/json"))), n)
    body = F.when(n.isin(2, 6), F.concat(F.lit('{"p": ['), "page_id", F.lit("]}"))).when(n == 5, None).otherwise(F.concat(F.lit("<p>"), "html"))
    return _pages(spark, sf_dir).select("page_id", S.looks_like_json(kind, body).alias("is_json"))


#: A mapping in which every customer has a value: of two kinds, every third expired.
_KNOWN_ID = "substr(sha256('id' || c_custkey), 1, 16)"


def _placeholders(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = customers(spark, sf_dir)
    id_, even = F.substring(F.sha2(F.concat(F.lit("id"), "c_custkey"), 256), 1, 16), F.col("c_custkey") % 2 == 0
    kind = F.when(even, "email").otherwise("opaque_token")
    known = rows.select(id_.alias("id"), kind.alias("kind"), F.concat(F.lit("value of "), "c_custkey").alias("secret"), F.when(F.col("c_custkey") % 3 == 0, F.lit(AT)).otherwise(F.lit("2026-03-11 00:00:00")).cast("timestamp").alias("expires_at"))
    mark = lambda own: F.concat(F.lit(f"{{{{{PREFIX}_"), F.when(own, "EMAIL").otherwise("OPAQUE"), F.lit("_"), id_, F.lit("}}"))
    wrong = F.when(F.col("c_custkey") % 5 == 0, mark(~even)).otherwise("{{VEIL_OPAQUE_xxxx}}")
    text = F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("to "), mark(even), F.lit(", "), mark(even), F.lit(" "), wrong))
    return rows.select("c_custkey", text.alias("text")), known


def _marks_sql(kinds: str = "true") -> str:
    """text, restored (by kinds) and whether a placeholder is left, of each customer."""
    mark = lambda even: f"'{{{{VEIL_' || CASE WHEN {even} THEN 'EMAIL' ELSE 'OPAQUE' END || '_' || {_KNOWN_ID} || '}}}}'"
    wrong = f"CASE WHEN c_custkey % 5 = 0 THEN {mark('c_custkey % 2 = 1')} ELSE '{{{{VEIL_OPAQUE_xxxx}}}}' END"
    own = mark("c_custkey % 2 = 0")
    told = f"CASE WHEN c_custkey % 3 > 0 AND {kinds} THEN 'value of ' || c_custkey ELSE {own} END"
    line = lambda x: f"CASE WHEN c_custkey % 7 > 0 THEN 'to ' || {x} || ', ' || {x} || ' ' || {wrong} END"
    return f"(SELECT c_custkey, {line(own)} AS text, {line(told)} AS restored, c_custkey % 7 > 0 AND (c_custkey % 3 = 0 OR c_custkey % 5 = 0) AS missed FROM customer)"


def _at():
    return F.lit(AT).cast("timestamp")


def resolve_lenient(spark, sf_dir):
    rows, known = _placeholders(spark, sf_dir)
    return rewrite.resolved(rows, "c_custkey", "text", known, _at()).select("c_custkey", "restored", "error_code")


def resolve_strict(spark, sf_dir):
    rows, known = _placeholders(spark, sf_dir)
    out = rewrite.resolved(rows, "c_custkey", "text", known, _at(), strict=True)
    closed = lambda strict: fail_closed(F.col("text"), F.col("restored"), F.col("error_code"), strict)
    return out.select("c_custkey", closed(True).alias("closed"), closed(False).alias("open"), "error_code")


def resolve_opaque_only(spark, sf_dir):
    rows, known = _placeholders(spark, sf_dir)
    return rewrite.resolved(rows, "c_custkey", "text", known, _at(), kinds=["opaque_token"]).select("c_custkey", "restored")


#: Texts, and whether each holds the prefix, a whole placeholder, is one, and where one may begin at its end; {k} lies within ids.
_STATES = [
    ("{{VEIL_OPAQUE_deadbeefca{k}}}", True, True, True, None), ("to {{VEIL_EMAIL_0123456789{k}}}, {{VEIL_OPAQUE_deadbeefca{k}}}.", True, True, False, None), ("{{VEIL_OPAQUE_x{k}}}", True, False, False, None),
    ("{", False, False, False, 0), ("abc{{VE", False, False, False, 3), ("abc{{VEIL_OPAQUE_{k}", True, False, False, 3), ("hello {{VEIL_PHONE_deadbeefca{k}}}", True, True, False, None), ("plain {k}", False, False, False, None),
    ("{{{VEIL_CVV_deadbeefca{k}}}}", True, True, False, None), (None, None, None, None, None),
]


def placeholder_states(spark, sf_dir):
    t = F.col("text")
    rows = customers(spark, sf_dir).withColumn("text", chosen([s[0] for s in _STATES]))
    return rows.select("c_custkey", S.contains_prefix(t, PREFIX).alias("prefix"), S.contains_placeholder(t, PREFIX).alias("complete"), S.is_placeholder(t, PREFIX).alias("whole"), S.partial_tail(t, PREFIX).alias("partial_at"))


def audit_fixture(spark, sf_dir):
    """Events as audit rows of other actions than ours, with empty hosts and times."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.col("event_id")
    rows = e.select(
        F.when(n % 11 == 0, "").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("ts"), F.concat(F.lit("rule."), n % 4).alias("rule_id"), F.col("event_type").alias("kind"),
        F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("h"), F.col("user_id") % 13, F.lit(".example"))).alias("request_host"), F.when(n % 7 == 0, "seen").otherwise("redacted").alias("action"),
    )
    return audit.ranked_all(rows)


_AUDIT_LOG = """SELECT CASE WHEN event_id % 11 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS ts, 'rule.' || (event_id % 4) AS rule_id, event_type AS kind,
  CASE WHEN event_id % 5 = 0 THEN '' ELSE 'h' || (user_id % 13) || '.example' END AS request_host, CASE WHEN event_id % 7 = 0 THEN 'seen' ELSE 'redacted' END AS action FROM events"""

_USER = '{"messages":[{"content":%s,"role":"user"}]}'
_ENCODED = base64.b64encode(b'{"email":"u#@harbour.dev"}').decode()
#: Bodies with a mail address M where one is masked; then how many, the error, and the kinds of a notice.
BODIES: list[tuple[str | None, int, str | None, str | None]] = [
    (_USER % '"write to M"', 1, None, "1 email"),
    ('{"messages":[{"content":"write to u{k}@harbour.dev","role":"assistant"}]}', 0, None, None),
    (_USER % '[{"text":"mail M, M","type":"text"}]', 2, None, "2 email"),
    ('{"input":[{"content":"test","role":"user"}],"instructions":"mail M"}', 1, None, "1 email"),
    ("not json M", 0, "invalid_json", None),
    ('{"prompt":"' + "x" * 5000 + '{k}"}', 0, "body_too_large", None),
    (_USER % '"{\\"to\\":\\"M\\"}"', 1, None, "1 email"),
    (_USER % f'"M and token {X.TOKEN}"', 2, None, "1 email, 1 opaque token"),
    (_USER % '"payload=BASE64"', 1, None, "1 email"),
    (None, 0, None, None),
]


def _bodies(spark, sf_dir):
    plain = F.replace(chosen([b[0] for b in BODIES]), F.lit("M"), F.concat(F.lit("u"), F.lpad((F.col("c_custkey") % 10**6).cast("string"), 6, "0"), F.lit("@harbour.dev")))
    inner = F.base64(F.concat(F.lit('{"email":"u'), F.lpad((F.col("c_custkey") % 10**6).cast("string"), 6, "0"), F.lit('@harbour.dev"}')).cast("binary"))
    return detect.spread(customers(spark, sf_dir)).withColumn("body", F.replace(plain, F.lit("BASE64"), inner))


def message_bodies(spark, sf_dir):
    out = bodies.masked_bodies(_bodies(spark, sf_dir), "c_custkey", "body", Settings(detection=EVERYTHING, notice_mode="off", max_body_bytes=4096))
    return out.select("c_custkey", "masked", F.size("replacements").cast("long").alias("replaced"), "error_code")


def body_notices(spark, sf_dir):
    out = bodies.masked_bodies(_bodies(spark, sf_dir), "c_custkey", "body", Settings(detection=EVERYTHING, notice_mode="minimal"))
    return out.where(F.size("replacements") > 0).select("c_custkey", F.contains("masked", F.lit(f"[{PREFIX}] ")).alias("told"), rewrite.kind_histogram(F.col("replacements")).alias("kinds"))


def _bodies_sql() -> str:
    mail = filled("'u{k}@harbour.dev'")
    mark = f"('{{{{VEIL_EMAIL_' || substr(sha256('email' || {mail}), 1, 16) || '}}}}')"
    token = f"('{{{{VEIL_OPAQUE_' || substr(sha256('opaque_token' || '{X.TOKEN}'), 1, 16) || '}}}}')"
    inner = f"""to_base64(encode('{{"email":"' || {mark} || '"}}'))"""
    text = filled("template")
    masked = f"replace(replace(replace({text}, 'M', {mark}), 'BASE64', {inner}), '{X.TOKEN}', {token})"
    rows = [(i, t, n, e) for i, (t, n, e, _) in enumerate(BODIES)]
    return f"SELECT c_custkey, CASE WHEN error_code IS NULL THEN {masked} END AS masked, replaced, error_code FROM customer JOIN (SELECT * FROM {literal(rows, 'place, template, replaced, error_code')}) t ON c_custkey % {len(BODIES)} = place"


def _joined(rows: list[tuple], names: str, select: str) -> str:
    return f"SELECT c_custkey, {select} FROM customer JOIN (SELECT * FROM {literal(rows, 'place, ' + names)}) t ON c_custkey % {max(r[0] for r in rows) + 1} = place"


_OPAQUE_ONLY, _LENIENT = _marks_sql("c_custkey % 2 = 1"), _marks_sql()
ORACLE = {
    "typed_fixture": f"SELECT c_custkey, start, stop, secret, rule_id, kind, subtype, source, confidence, score FROM {_FOUND}",
    "classifier_filter": f"SELECT c_custkey, secret, rule_id, 'classifier' AS source, 'medium' AS confidence, 72 AS score FROM {_FOUND} WHERE score < 70 AND (kind <> 'phone' OR contains(secret, '('))",
    "allowlist_sha256": f"SELECT c_custkey, start, secret, rule_id FROM {_FOUND} WHERE sha256(secret) NOT IN ({', '.join(map(quoted, _ALLOWED))})",
    "log_scrub": _joined([(i, clean) for i, (_, clean) in enumerate(_SCRUB)], "clean", filled("clean") + " AS scrubbed"),
    "host_normalize": _HOST_NORMALIZE,
    "host_lists": _host_lists_sql(),
    "json_predicate": "SELECT page_id, page_id % 7 IN (0, 1, 2, 6) AS is_json FROM pages",
    "resolve_lenient": f"SELECT c_custkey, restored, NULL::VARCHAR AS error_code FROM {_LENIENT}",
    "resolve_strict": f"SELECT c_custkey, CASE WHEN NOT missed THEN restored END AS closed, CASE WHEN missed THEN text ELSE restored END AS open, CASE WHEN missed THEN 'strict_resolve_failed' END AS error_code FROM {_LENIENT}",
    "resolve_opaque_only": f"SELECT c_custkey, restored FROM {_OPAQUE_ONLY}",
    "placeholder_states": _joined([(i, *s[1:]) for i, s in enumerate(_STATES)], "prefix, complete, whole, partial_at", "prefix, complete, whole, partial_at"),
    "audit_fixture": f"WITH log AS ({_AUDIT_LOG}) {all_lists('log')}",
    "message_bodies": _bodies_sql(),
    "body_notices": _joined([(i, True, k) for i, (_, _, _, k) in enumerate(BODIES)], "told, kinds", "told, kinds") + " WHERE kinds IS NOT NULL",
}
QUERIES = {
    f.__name__: f
    for f in (
        typed_fixture, classifier_filter, allowlist_sha256, log_scrub, host_normalize, host_lists, json_predicate, resolve_lenient, resolve_strict, resolve_opaque_only,
        placeholder_states, audit_fixture, message_bodies, body_notices,
    )
}
