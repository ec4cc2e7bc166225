"""The registered queries as SQL, over the same tables and fixtures."""

from __future__ import annotations

import re

from ..vocabulary import KINDS, PROMPT_HINTS, scrub_steps


def quoted(value: object) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def literal(rows: list[tuple], names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") AS v({names})"


DELIMITER = r"""[ \t\n\r"''`=:,{}\[\]();<>|\\]"""
TOKEN = r"""[^ \t\n\r"''`=:,{}\[\]();<>|\\]"""

OPAQUE = f"""
piece AS (SELECT doc_id, i, p[i] AS x FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN}+|{DELIMITER}+') AS p FROM documents), LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i)),
laid AS (SELECT doc_id, x, (sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) - length(x))::INT AS start FROM piece),
tok AS (SELECT doc_id, start, x AS secret, list_aggregate(regexp_extract_all(hex(encode(x)), '..'), 'entropy') AS h FROM laid
  WHERE strlen(x) >= 20 AND NOT regexp_full_match(x, '[a-z]*') AND regexp_matches(x, '^{TOKEN}')),
opaque AS (SELECT doc_id, start, start + length(secret)::INT AS stop, secret, 'opaque.high_entropy' AS rule_id, 'opaque_token' AS kind, 'high_entropy' AS subtype, 'entropy' AS source,
  CASE WHEN h >= 4.0 THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN h >= 4.5 THEN 92 WHEN h >= 4.0 THEN 84 ELSE 72 END AS score, h AS entropy FROM tok WHERE h >= 3.5)"""


def places(name: str, pattern: str, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """Places and values of a pattern, by marking them and splitting at the marks."""
    return f"""{name}_cut AS (SELECT {key}, string_split(regexp_replace({text}, '({pattern})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS p FROM {table}),
{name} AS (SELECT {key}, (coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(replace(x, chr(2), '')))), 0))::INT AS start, split_part(p[i], chr(2), 1) AS secret
  FROM {name}_cut, LATERAL (SELECT unnest(range(2, len(p) + 1)) AS i))"""


EMAIL = r"\b[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24}\b"
PHONE = r"\b\+?\d[\d .()\-/]{7,}\d\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
CARD = r"\b(?:\d[ -]?){13,19}\b"
DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"
SAME = "len(list_distinct(string_split({0}, ''))) = 1"


def digits(value: str) -> str:
    return DIGITS.format(value)


def luhn(number: str) -> str:
    return f"(list_sum(list_transform(range(1, length({number}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN {number}[length({number}) - k + 1]::INT ELSE (2 * {number}[length({number}) - k + 1]::INT) // 10 + (2 * {number}[length({number}) - k + 1]::INT) % 10 END)) % 10 = 0)"


def issuer(number: str) -> str:
    return f"""CASE WHEN {number} LIKE '4%' THEN 'visa' WHEN {number}[1:2] IN ('34', '37') THEN 'amex' WHEN {number} LIKE '6011%' OR {number} LIKE '65%' OR {number}[1:3]::INT BETWEEN 644 AND 649 THEN 'discover'
  WHEN {number}[1:2]::INT BETWEEN 51 AND 55 OR {number}[1:4]::INT BETWEEN 2221 AND 2720 THEN 'mastercard' ELSE 'pan' END"""


VALID_EMAIL = r"NOT regexp_matches(lower(secret), '\.(png|jpg|svg)$|example\.com|email@example')"
VALID_PHONE = f"(length({digits('secret')}) BETWEEN 10 AND 15 AND NOT {SAME.format(digits('secret'))} AND regexp_matches(secret, '[ (\\-]|^\\+'))"
VALID_CARD = f"(length({digits('secret')}) BETWEEN 13 AND 19 AND NOT {SAME.format(digits('secret'))} AND {luhn(digits('secret'))})"

#: RE2 knows word ends of ASCII letters only; a separator before another letter belongs to the card, too.
CARDS = places("card_ascii", CARD) + r""",
card AS (SELECT doc_id, start, secret || CASE WHEN regexp_matches(substr(text, start + length(secret)::INT + 1, 2), '^[ -][^\x00-\x7F]') AND regexp_matches(substr(text, start + length(secret)::INT + 2, 1), '\p{L}') AND regexp_matches(secret, '[0-9]$')
  THEN substr(text, start + length(secret)::INT + 1, 1) ELSE '' END AS secret FROM card_ascii JOIN documents USING (doc_id))"""

TYPED = ",\n".join([places("email", EMAIL), places("phone", PHONE), places("ssn", SSN), CARDS]) + f""",
spans AS (
  SELECT doc_id, start, (start + length(secret))::INT AS stop, secret, 'typed.email' AS rule_id, 'email' AS kind, 'email_address' AS subtype, 'heuristic' AS source, 'high' AS confidence, 90 AS score, NULL::DOUBLE AS entropy FROM email WHERE {VALID_EMAIL}
  UNION ALL SELECT doc_id, start, start + length(secret)::INT, secret, 'typed.phone', 'phone', 'phone_number', 'heuristic', 'low', 55, NULL FROM phone WHERE {VALID_PHONE}
  UNION ALL SELECT doc_id, start, start + length(secret)::INT, secret, 'typed.id.ssn', 'national_id', 'us_ssn', 'heuristic', 'high', 94, NULL FROM ssn WHERE secret NOT IN ('000-00-0000', '123-45-6789')
  UNION ALL SELECT doc_id, start, start + length(secret)::INT, secret, 'typed.card.pan', 'payment_card', {issuer(digits("secret"))}, 'heuristic', 'high', 96, NULL FROM card WHERE {VALID_CARD})"""


def fold(name: str, source: str) -> str:
    """The fold over spans in order: an overlapping one replaces the last kept if it is better."""
    columns = "start, stop, secret, rule_id, kind, subtype, source, confidence, score, entropy"
    better = "(s.start < f.stop AND s.stop > f.start AND (s.score > f.score OR (s.score = f.score AND strlen(s.secret) > strlen(f.secret))))"
    apart = "(s.start >= f.stop OR s.stop <= f.start)"
    pick = ", ".join(f"CASE WHEN {apart} OR {better} THEN s.{c} ELSE f.{c} END" for c in columns.split(", "))
    return f"""{name}_s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, score DESC, strlen(secret) DESC, rule_id) AS rn FROM {source}),
{name}_f AS (SELECT doc_id, rn, 1 AS g, {columns} FROM {name}_s WHERE rn = 1
  UNION ALL SELECT s.doc_id, s.rn, f.g + CASE WHEN {apart} THEN 1 ELSE 0 END, {pick} FROM {name}_f f JOIN {name}_s s ON s.doc_id = f.doc_id AND s.rn = f.rn + 1),
{name} AS (SELECT * EXCLUDE (rn, g) FROM {name}_f QUALIFY row_number() OVER (PARTITION BY doc_id, g ORDER BY rn DESC) = 1)"""


FOUND = f"""WITH RECURSIVE {OPAQUE}, {TYPED}, {fold("best", "spans")}, both_kinds AS (SELECT * FROM best UNION ALL SELECT * FROM opaque), {fold("found", "both_kinds")}"""
LABEL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{label}'" for k, (_, label) in KINDS.items()) + " END"
DISPLAY = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{name}'" for k, (name, _) in KINDS.items()) + " END"
ID = "substr(sha256(kind || secret), 1, 16)"
MARK = f"('{{{{VEIL_' || {LABEL} || '_' || {ID} || '}}}}')"
AUDIT = FOUND + f""", log AS (SELECT strftime(TIMESTAMP '2026-03-10' + to_seconds(doc_id), '%Y-%m-%dT%H:%M:%SZ') AS ts, rule_id, kind, subtype, 'reversible_session' AS policy, {MARK} AS placeholder,
  d.source AS request_host, 'redacted' AS action, f.source AS match_source, confidence, score AS confidence_score, 0 AS decoded_depth, round(entropy, 6) AS entropy FROM found f JOIN documents d USING (doc_id))"""
MASKED = FOUND + f""", marked AS (SELECT *, {MARK} AS mark, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM found),
masked AS (SELECT doc_id, string_agg(substr(text, before + 1, start - before) || mark, '' ORDER BY start) || substr(any_value(text), max(stop) + 1) AS masked FROM marked JOIN documents USING (doc_id) GROUP BY doc_id)"""
HISTOGRAM = f"(SELECT doc_id, string_agg(c || ' ' || label, ', ' ORDER BY label) AS kinds FROM (SELECT doc_id, {DISPLAY} AS label, count(*) AS c FROM found GROUP BY ALL) GROUP BY doc_id)"


def ranked(column: str, limit: str = "") -> str:
    return AUDIT + f" SELECT {column} AS name, count(*) AS count FROM log WHERE {column} <> '' GROUP BY 1 ORDER BY 2 DESC, 1 {limit}"


def all_lists(table: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS list, {c} AS name, count(*) AS count FROM {table} WHERE action = 'redacted' AND {c} <> '' GROUP BY 2" for c in ("kind", "rule_id", "request_host"))


def scrubbed(text: str) -> str:
    for pattern, by in scrub_steps("VEIL"):
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(by)}, 'g')"
    return text


URL_HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1))"


def candidates(key: str, valid: str) -> str:
    return f"SELECT {key}, secret AS value, {valid} AS valid FROM c"


HINTS = "|".join(re.escape(h) for h in PROMPT_HINTS)


ORACLE: dict[str, str] = {
    "opaque_tokens": f"WITH {OPAQUE} SELECT doc_id, start, stop, secret, confidence, score, round(entropy, 6) AS entropy FROM opaque",
    "email_candidates": f"WITH {places('c', EMAIL)} " + candidates("doc_id", VALID_EMAIL),
    "phone_candidates": f"WITH {places('c', PHONE)} " + candidates("doc_id", VALID_PHONE),
    "phone_candidates_pages": f"WITH {places('c', PHONE, 'pages', 'page_id', 'html')} " + candidates("page_id", VALID_PHONE),
    "card_candidates": f"WITH {CARDS} SELECT doc_id, secret AS value, {VALID_CARD} AS valid, CASE WHEN {VALID_CARD} THEN {issuer(digits('secret'))} END AS issuer FROM card",
    "overlap_resolution": FOUND + " SELECT doc_id, start, stop, secret, rule_id, score FROM found",
    "context_windows": FOUND + " SELECT doc_id, start, substr(text, greatest(start - 96, 0) + 1, stop + 96 - greatest(start - 96, 0)) AS context FROM found JOIN documents USING (doc_id) WHERE score < 70",
    "allowlist_rule": FOUND + " SELECT doc_id, start, secret, rule_id FROM found WHERE rule_id <> 'opaque.high_entropy'",
    "allowlist_pattern": FOUND + " SELECT doc_id, start, secret, rule_id FROM found WHERE NOT regexp_matches(secret, '^4|[a-f]{3}')",
    "token_entropy": f"SELECT doc_id, x AS token, round(list_aggregate(regexp_extract_all(hex(encode(x)), '..'), 'entropy'), 6) AS entropy FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{TOKEN}{{12,}}')) AS x FROM documents)",
    "luhn_and_issuer": f"SELECT o_orderkey, number, {luhn('number')} AS passes, {issuer('number')} AS issuer FROM (SELECT o_orderkey, lpad((o_orderkey * 7919 + 4000000)::VARCHAR, 16, '4') AS number FROM orders)",
    "log_scrub_documents": f"SELECT doc_id, sha256({scrubbed('text')}) AS scrubbed_sha256 FROM documents",
    "host_scope": f"SELECT page_id, h = 'example.com' OR h LIKE '%.example.com' AS suffix, h LIKE 'blog.%' OR h LIKE '%.example.o_g' AS glob, true AS everything FROM (SELECT page_id, {URL_HOST} AS h FROM pages)",
    "user_turns": "SELECT conv_id, turn, text FROM conversations WHERE role = 'user' OR role IS NULL",
    "body_size_limit": "SELECT doc_id, CASE WHEN strlen(text) > 4096 THEN 'body_too_large' END AS error_code FROM documents",
    "hidden_prompt": f"SELECT doc_id, coalesce(strlen(text) >= 8192 AND NOT regexp_matches(lower(text), {quoted(HINTS)}), false) AS hidden FROM documents",
    "redaction_ids": FOUND + f" SELECT doc_id, secret, {ID} AS id, {MARK} AS placeholder, substr(sha256(secret), 1, 16) AS legacy_id FROM found",
    "masked_text": MASKED + " SELECT doc_id, masked FROM masked",
    "dry_run": FOUND
    + " SELECT doc_id, true AS unchanged, CASE WHEN c IS NULL THEN 'no replacements' ELSE 'would replace ' || c || ' sensitive value(s)' END AS summary FROM documents LEFT JOIN (SELECT doc_id, count(*) AS c FROM found GROUP BY 1) USING (doc_id)",
    "kind_histogram": FOUND + f" SELECT * FROM {HISTOGRAM}",
    "redact_resolve_roundtrip": FOUND + " SELECT doc_id, text, coalesce(c, 0)::BIGINT AS placeholders FROM documents LEFT JOIN (SELECT doc_id, count(*) AS c FROM found GROUP BY 1) USING (doc_id)",
    "mapping_table": FOUND + f" SELECT DISTINCT {ID} AS id, kind, secret, '2026-03-10 01:00:00' AS expires_at FROM found",
    "mapping_expiry": FOUND
    + f" SELECT id, kind, strftime(TIMESTAMP '2026-03-10 01:00:00' + to_seconds(m), '%Y-%m-%d %H:%M:%S') AS expires_at FROM (SELECT {ID} AS id, kind, max(doc_id % 5) * 1800 AS m FROM found GROUP BY ALL) WHERE m > 3600",
    "audit_rows": AUDIT + " SELECT * FROM log",
    "audit_totals": AUDIT + " SELECT count(*) AS total_redactions, max(nullif(ts, '')) AS latest_event FROM log",
    "audit_stats_kind": ranked("kind"),
    "audit_stats_rule": ranked("rule_id"),
    "audit_stats_host_top": ranked("request_host", "LIMIT 5"),
    "audit_stats_all": AUDIT + " " + all_lists("log"),
    "intercept_count": f"SELECT count(*) AS intercepted FROM pages WHERE {URL_HOST} = 'example.org' OR {URL_HOST} LIKE '%.example.org'",
    "hook_records": AUDIT + " SELECT 'request_redacted' AS event, epoch(TIMESTAMP '2026-03-10')::BIGINT AS ts, request_host, rule_id, kind, subtype, placeholder, 'log' AS action FROM log WHERE rule_id = 'typed.phone'",
    "hook_block": FOUND
    + " SELECT doc_id, CASE WHEN arg_min(rule_id, start) = 'typed.card.pan' THEN 'no cards' ELSE 'request blocked by hook for rule typed.phone' END AS message FROM found WHERE rule_id IN ('typed.phone', 'typed.card.pan') GROUP BY doc_id",
    "body_roundtrip": f"""SELECT conv_id, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS said_sha256,
  bool_or(coalesce(role, 'user') = 'user' AND len(list_filter(regexp_extract_all(text, '{TOKEN}+'), lambda x: strlen(x) >= 12 AND NOT regexp_matches(x, '^[a-z]*$') AND list_aggregate(regexp_extract_all(hex(encode(x)), '..'), 'entropy') >= 3.0)) > 0 OR (coalesce(role, 'user') = 'user' AND regexp_matches(text, '@|[0-9][0-9 .()/-]{{7,}}[0-9]'))) AS masked_some, true AS all_there
  FROM conversations GROUP BY conv_id""",
    "sse_reassembly": FOUND + " SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM found)",
}


ORACLE |= {
    "masked_strings": MASKED + " SELECT doc_id, masked AS a, masked AS b, c AS n FROM masked JOIN (SELECT doc_id, count(*) AS c FROM found GROUP BY 1) USING (doc_id)",
    "socket_messages": MASKED
    + " SELECT doc_id, text AS assistant, coalesce(masked, text) AS user, CASE WHEN masked IS NOT NULL THEN 'placeholder:v2' END AS contract, false AS closed FROM documents LEFT JOIN masked USING (doc_id) WHERE text IS NOT NULL",
    "guarded_messages": MASKED
    + """, judged AS (SELECT doc_id, text, coalesce(masked, text) AS m, masked, CASE WHEN strlen(text) > 4096 THEN 'body_too_large' WHEN doc_id IN (SELECT doc_id FROM found WHERE rule_id = 'typed.card.pan') THEN 'hook_blocked' END AS error_code FROM documents LEFT JOIN masked USING (doc_id))
SELECT doc_id, error_code, CASE WHEN error_code IS NULL THEN m END AS outgoing, text IS NOT NULL AND error_code IS NOT NULL AS closed, CASE WHEN error_code IS NULL AND masked IS NOT NULL THEN 'placeholder:v2' END AS contract,
  CASE WHEN error_code IS NULL THEN m WHEN error_code = 'body_too_large' THEN text END AS lenient FROM judged""",
    "restored_messages": FOUND
    + f""", marked AS (SELECT *, CASE WHEN {ID} < '8' THEN secret ELSE {MARK} END AS mark, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM found),
half AS (SELECT doc_id, string_agg(substr(text, before + 1, start - before) || mark, '' ORDER BY start) || substr(any_value(text), max(stop) + 1) AS half FROM marked JOIN documents USING (doc_id) GROUP BY doc_id)
SELECT doc_id, coalesce(half, text) AS restored FROM documents LEFT JOIN half USING (doc_id)""",
    "restored_texts": FOUND + " SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM found)",
    "unquoted_passwords": "SELECT c_custkey, 14 AS start, 'k' || c_custkey || '-zz' AS secret, 'typed.password.labeled' AS rule_id, 90 AS score FROM customer WHERE length(c_custkey::VARCHAR) >= 0",
}


def _rule(rule_id: str, pattern: str, test: str = "true", group: int | str = 0, low: float = 0, let_be: str = "false", key: str = "doc_id", source: str = "documents", text: str = "text", more: str = "") -> str:
    """All findings of one rule. test is about a text, let_be about m (match) and x (secret); a group that is a condition is written as SQL over g1, g2."""
    quoted = pattern.replace("'", "''")
    each = lambda g: f"unnest(regexp_extract_all({text}, '{quoted}', {g}))"
    if isinstance(group, int):
        inner = f"SELECT {key}, {more}{text} AS whole, {each(0)} AS m, {each(group)} AS x, unnest(range(len(regexp_extract_all({text}, '{quoted}')))) AS i FROM {source} WHERE {test}"
    else:
        raw = f"SELECT {key}, {more}{text} AS whole, {each(0)} AS m, {each(1)} AS g1, {each(2)} AS g2, unnest(range(len(regexp_extract_all({text}, '{quoted}')))) AS i FROM {source} WHERE {test}"
        inner = f"SELECT *, {group} AS x FROM ({raw})"
    scored = f"SELECT *, list_aggregate(regexp_extract_all(hex(encode(x)), '..'), 'entropy') AS h FROM ({inner})"
    return f"SELECT {key}, '{rule_id}' AS rule_id, (row_number() OVER (PARTITION BY {key} ORDER BY i) - 1)::INT AS place, x AS secret, h, m FROM ({scored}) WHERE h > {low or -1} AND NOT ({let_be})"


_SHARED = "regexp_matches(x, '^0+$') OR contains(lower(x), 'feed5eed')"
_DOCUMENT_RULES = [
    _rule("assigned-token", r'(?i)\btoken\s{0,3}=\s{0,3}"([0-9a-z]{32,64})"', "contains(lower(text), 'token')", 1, 3.3, _SHARED),
    _rule("mailbox", r"([a-z]+)\.([0-9]+)@mail[0-9]\.example\.com", "contains(lower(text), '@mail')", 1, 0, _SHARED + " OR contains(lower(x), 'the') OR contains(lower(x), 'ou')"),
    _rule("line-number", r"\+1 \(([0-9]{3})\) 555-([0-9]{4})", "contains(text, '555-') OR contains(text, '(0)')", 2, 0, _SHARED + r" OR regexp_matches(m, '\(3|\(4[0-4]')"),
    _rule("long-number", r"\b4[0-9]{15}\b", "true", 0, 2.9, _SHARED),
    _rule("address", r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b", "true", 0, 0, _SHARED + " OR (regexp_matches(x, '^1|9$') AND (contains(x, '.1') OR contains(x, '.2')))"),
    _rule("licence", r"(?i)licen[sc]e[^\n]{0,30}", "contains(lower(text), 'license') OR contains(lower(text), 'licence')", 0, 0, _SHARED),
    _rule("long-word", "[[:alpha:]]{16,}", "true", 0, 2.8, _SHARED + " OR regexp_matches(x, '^[A-Z]')"),
    _rule("either", r"(?:pipe=([a-z]+)|\| ([0-9]+) \|)", "contains(text, '|') OR contains(lower(text), 'pipe=')", "CASE WHEN g1 <> '' THEN g1 ELSE g2 END", 0, _SHARED),
    _rule("shouted", r"\b[A-Z]{5,}[!?]{2}", "contains(text, '!!') OR contains(text, '??')", 0, 0, _SHARED),
]
ORACLE["rule_pack_documents"] = "SELECT doc_id, rule_id, place, secret, round(h, 6) AS entropy FROM (" + " UNION ALL ".join(_DOCUMENT_RULES) + ")"

_PAGES = r"(SELECT * FROM pages WHERE NOT coalesce(regexp_matches(url, '\.html$|#top$'), false))"
_PAGE_RULES = [
    _rule("link", 'href="/([^"]+)"', "contains(lower(html), 'href=')", 1, 0, "regexp_matches(x, '^t') OR contains(lower(x), 'and') OR contains(lower(x), 'ion') OR (coalesce(contains(url, '/en/'), false) AND regexp_matches(x, '^[n-z]'))", "page_id", _PAGES, "html", "url, "),
    _rule("secure-title", "<title>([^<]{5,80})</title>", "regexp_matches(url, '^https://')", 1, 0, """list_bool_or(list_transform(list_filter(string_split(whole, chr(10)), lambda l: contains(l, m)), lambda l: regexp_matches(l, 'lang="(?:de|es)"')))""", "page_id", _PAGES, "html"),
    _rule("assigned-token", 'token = (?:"|&quot;)([0-9a-f]{40})', "contains(lower(html), 'token')", 1, 3.0, """regexp_matches(m, '"[0-7]')""", "page_id", _PAGES, "html"),
    f"SELECT page_id, 'feed' AS rule_id, 0::INT AS place, '' AS secret, 0 AS h, '' AS m FROM {_PAGES} WHERE html IS NOT NULL AND regexp_matches(url, 'utm_source=feed$')",
]
ORACLE["rule_allowlists_pages"] = "SELECT page_id, rule_id, place, secret, strlen(m)::INT AS matched_bytes FROM (" + " UNION ALL ".join(_PAGE_RULES) + ")"

ORACLE |= {
    "session_messages": MASKED
    + """ SELECT doc_id, 'request' AS direction, coalesce(masked, text) AS outgoing, CASE WHEN masked IS NOT NULL THEN 'placeholder:v2' END AS contract, false AS missed FROM documents LEFT JOIN masked USING (doc_id)
      UNION ALL SELECT doc_id, 'response', CASE WHEN doc_id % 5 < 2 THEN text ELSE coalesce(masked, text) END, NULL, masked IS NOT NULL AND doc_id % 5 >= 2 FROM documents LEFT JOIN masked USING (doc_id)""",
    "allowlist_table": FOUND + " SELECT doc_id, start, secret, rule_id FROM found WHERE substr(sha256(secret), 64, 1) NOT IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') AND secret NOT IN (SELECT c_name FROM customer)",
    "byte_places": FOUND
    + " SELECT doc_id, start, stop, strlen(substr(text, 1, start))::INT AS start_byte, strlen(substr(text, 1, stop))::INT AS stop_byte, secret FROM found JOIN documents USING (doc_id)",
    "scoped_requests": f"""SELECT page_id, h AS host FROM (SELECT page_id, {URL_HOST} AS h, page_id % 4 = 0 AS told, CASE WHEN page_id % 3 = 0 THEN true ELSE coalesce(json_valid(html), false) END AS js FROM pages)
      WHERE (h = 'example.com' OR h LIKE '%.example.com' OR h LIKE 'm.%') AND (told OR js)""",
    "scoped_responses": MASKED + " SELECT doc_id, length(masked)::INT AS n FROM masked WHERE contains(masked, '{{VEIL_')",
    "separated_events": "SELECT doc_id, sha256(replace(text, ' ', chr(8232) || chr(133) || ' ')) AS text_sha256 FROM documents WHERE text IS NOT NULL",
}
