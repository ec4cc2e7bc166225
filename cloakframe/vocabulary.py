"""The closed vocabulary of findings. They must agree between all readers of the tables."""

from __future__ import annotations

import re

#: kind: (label for people, label in placeholders)
KINDS = {
    "opaque_token": ("opaque token", "OPAQUE"),
    "password": ("password", "PASSWORD"),
    "email": ("email", "EMAIL"),
    "phone": ("phone", "PHONE"),
    "national_id": ("national ID", "ID"),
    "passport": ("passport", "PASSPORT"),
    "payment_card": ("payment card", "CARD"),
    "cvv": ("cvv", "CVV"),
}
POLICY = "reversible_session"
CARD_HINTS = ("card", "visa", "mastercard", "amex", "american express", "payment", "billing", "checkout")
#: Any of these in a large hidden prompt has it scanned.
PROMPT_HINTS = (
    "api key", "api-key", "api_key", "x-api-key",
    "access token", "access-token", "access_token",
    "auth token", "auth-token", "auth_token",
    "bearer ", "authorization",
    "client secret", "client-secret", "client_secret",
    "private key", "private-key", "private_key",
    "secret key", "secret-key", "secret_key",
    "password", "passwd", "credential", "-----begin",
    "sk-", "ghp_", "gho_", "ghu_", "ghs_", "akia", "asia",
    "xoxa-", "xoxb-", "xoxp-", "xoxs-", "aiza", "npm_",
    "sq0atp-", "sq0csp-", "rk_", "pk_", "hf_", "glpat-",
)
#: Parts of patterns: labels, the separator after them, an optional quote.
SEPARATOR = r"\s*(?:=|:|=>)\s*"
QUOTE = "[\"'`]"
PASSWORD_LABEL = r"\b(?i:password|passwd|passcode|passphrase|pin)\b"
#: What ends a token that may be opaque.
DELIMITERS = " \t\n\r\"'`=:,{}[]();<>|\\"

# Fixed values of the log scrub, down to KNOWN_SECRETS: which keys, headers and makes of secrets a log line must not show.
#: Keys whose values a log line must not show.
SECRET_KEY = "api[_-]?key|x-api-key|secret[_-]?key|access[_-]?token|auth[_-]?token|refresh[_-]?token|password|passwd"
#: What follows such a key, quoted or bare, in JSON and elsewhere: (pattern before the value, characters that end a bare value).
SECRET_PLACES = (
    (rf'"(?:{SECRET_KEY})"\s*:\s*', r"\s,}"),
    (rf"\b(?:{SECRET_KEY})\b\s*(?:=|:)\s*", r"\s,;"),
)
BEARER = (r"(?i)authorization:\s*bearer\s+[A-Za-z0-9._-]{12,}", "Authorization: Bearer [redacted]")
#: Secrets that are known by their make; the more specific first.
KNOWN_SECRETS = (
    (r"sk-ant-[A-Za-z0-9_-]{12,}", "anthropic_secret"),
    (r"sk-[A-Za-z0-9_-]{12,}", "openai_secret"),
    (r"AKIA[0-9A-Z]{16}", "aws_key"),
    (r"gh[ps]_[A-Za-z0-9]{36,}", "github_token"),
)


def scrub_steps(prefix: str) -> list[tuple[str, str]]:
    """Patterns that Java, RE2 and Python read alike and what goes in their place, with groups as \\1.

    A value is all between quotes, or else whatever stands up to the next blank or
    separator, brackets and single quotes included; quotes around it are kept.
    """
    steps = [(placeholder_pattern(prefix), "[redacted_placeholder]"), BEARER]
    for head, end in SECRET_PLACES:
        quoted = "|".join(rf"({q})(?:[^{q}\r\n]+{q}|{q}([{end}]|$))" for q in ('"', "'"))
        steps.append((rf"(?i)({head})(?:{quoted}|[^{end}]+)", r"\1\2\4[redacted]\2\4\3\5"))
    return steps + [(pattern, f"[redacted_{name}]") for pattern, name in KNOWN_SECRETS]


def placeholder_pattern(prefix: str) -> str:
    """A whole placeholder: kind label, then 8 to 64 hex digits."""
    return r"\{\{" + re.escape(prefix) + "_(" + "|".join(label for _, label in KINDS.values()) + r")_([0-9A-Fa-f]{8,64})\}\}"
