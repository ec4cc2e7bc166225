"""Which rows are looked at: host, role, size and hidden-prompt predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BODY_TOO_LARGE
from ..functions.scalars import let
from ..vocabulary import PROMPT_HINTS

LARGE_PROMPT_BYTES = 8 * 1024


def normalize_host(host: Column) -> Column:
    """Lower case without outer spaces, dots, brackets and port."""
    v6 = r"^(?:[0-9a-f]{0,4}:){2,7}[0-9a-f.]{0,15}$"

    def without_port(bare: Column) -> Column:
        def of(head: Column) -> Column:
            has_port = (head != "") & (F.contains(head, F.lit(".")) | F.contains(head, F.lit("[")) | (head == "localhost") | (head.rlike(v6) & ~bare.rlike(v6)))
            return F.regexp_replace(F.when(has_port, head).otherwise(bare), r"^\[+|\]+$", "")

        return let(F.regexp_extract(bare, r"^(.*):[^:]*$", 1), of)

    return let(F.regexp_replace(F.lower(F.trim(host)), r"^\.+|\.+$", ""), without_port)


def glob_pattern(glob: str) -> str:
    """An anchored pattern for a glob: * for anything, ? for one character."""
    return r"(?s)\A" + "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in glob) + r"\z"


def host_allowed(host: Column, hosts: list[str] | tuple[str, ...]) -> Column:
    """Whether a host is, lies below, or matches as a glob one of hosts; no hosts allow all."""
    if not hosts:
        return F.lit(True)

    def of(own: Column) -> Column:
        out = F.lit(False)
        for entry in hosts:
            low = entry.strip().lower()
            if "*" in low or "?" in low:
                out = out | own.rlike(glob_pattern(low))
            else:
                plain = re.sub(r"(?<=[\].a-z0-9]):\d+$", "", low.strip(".")) if low.count(":") == 1 or "]" in low else low
                plain = plain.strip("[]")
                out = out | (own == plain) | own.endswith("." + plain)
        return out

    return F.coalesce(let(normalize_host(host), of), F.lit(False))


def host_of_url(url: Column) -> Column:
    return normalize_host(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def scanned_role(role: Column) -> Column:
    """User turns and turns without a role."""
    return role.isNull() | (role == "user")


def body_error(body: Column, max_bytes: int) -> Column:
    """The error code of a body of more bytes than allowed; 0 or less allows any."""
    none = F.lit(None).cast("string")
    return F.when(F.octet_length(body) > max_bytes, BODY_TOO_LARGE).otherwise(none) if max_bytes > 0 else none


def large_hidden_prompt(text: Column) -> Column:
    """A top-level prompt so large, and without a hint of a secret, that only messages are looked at."""
    hint = F.lower(text).rlike("|".join(re.escape(h) for h in PROMPT_HINTS))
    return F.coalesce((F.octet_length(text) >= LARGE_PROMPT_BYTES) & ~hint, F.lit(False))
