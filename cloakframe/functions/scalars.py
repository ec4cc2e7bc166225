"""Scalar functions over text columns, all built from Spark's own expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocabulary import DELIMITERS, KINDS, placeholder_pattern, scrub_steps


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, also inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of the UTF-8 bytes; 0.0 for an empty text."""

    def of(digits: Column) -> Column:
        n = F.size(digits).cast("double")
        share = lambda b: F.size(F.filter(digits, lambda x: x == b)) / n
        return F.aggregate(F.array_distinct(digits), F.lit(0.0), lambda sum_, b: let(share(b), lambda p: sum_ - p * F.log2(p)))

    return let(F.regexp_extract_all(F.hex(utf8(text)), F.lit("(..)"), F.lit(1)), of)


def tokens(text: Column, least_chars: int = 1) -> Column:
    """Maximal runs without a delimiter, of so many characters at least."""
    return F.regexp_extract_all(text, F.lit(f"([^{re.escape(DELIMITERS)}]{{{least_chars},}})"), F.lit(1))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def one_digit_only(number: Column) -> Column:
    return number.rlike(r"^(.)\1*$")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the mod-10 check."""
    return F.call_function("luhn_check", number)


def card_issuer(number: Column) -> Column:
    """Number ranges of issuers."""
    two, three, four = (F.substring(number, 1, n).try_cast("int") for n in (2, 3, 4))
    return (
        F.when(number.startswith("4"), "visa")
        .when(two.isin(34, 37), "amex")
        .when((four == 6011) | (two == 65) | three.between(644, 649), "discover")
        .when(two.between(51, 55) | four.between(2221, 2720), "mastercard")
        .otherwise("pan")
    )


def sha256(text: Column) -> Column:
    return F.sha2(utf8(text), 256)


def finding_id(kind: Column, secret: Column, salt: bytes | None = None) -> Column:
    """16 hex digits of SHA-256 over salt, kind and value; without a salt it is the id of a dry run.

    The salt is fixed on the driver for a session: a retried task then makes the same ids.
    """
    head = [F.lit(bytearray(salt))] if salt else []
    return F.substring(F.sha2(F.concat(*head, utf8(kind), utf8(secret)), 256), 1, 16)


def legacy_id(secret: Column) -> Column:
    return F.substring(sha256(secret), 1, 16)


def placeholder_label(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (_, label) in reversed(KINDS.items()):
        out = F.when(kind == name, label).otherwise(out)
    return out


def kind_of_label(label: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (_, own) in reversed(KINDS.items()):
        out = F.when(label == own, name).otherwise(out)
    return out


def display_label(kind: Column) -> Column:
    out = kind
    for name, (label, _) in KINDS.items():
        out = F.when(kind == name, label).otherwise(out)
    return out


def placeholder(kind: Column, id_: Column, prefix: str) -> Column:
    return F.concat(F.lit("{{" + prefix + "_"), placeholder_label(kind), F.lit("_"), id_, F.lit("}}"))


def contains_prefix(text: Column, prefix: str) -> Column:
    return F.contains(text, F.lit("{{" + prefix + "_"))


def contains_placeholder(text: Column, prefix: str) -> Column:
    return contains_prefix(text, prefix) & text.rlike(placeholder_pattern(prefix))


def is_placeholder(text: Column, prefix: str) -> Column:
    return text.rlike("^" + placeholder_pattern(prefix) + r"\z")


def partial_tail_pattern(prefix: str) -> str:
    """A placeholder that has begun but not ended where the text ends."""
    start = "{{" + prefix + "_"
    labels = [label for _, label in KINDS.values()]
    begun = [re.escape(start[:n]) for n in range(1, len(start))]
    label_begun = sorted({label[:n] for label in labels for n in range(1, len(label) + 1)})
    rest = [*label_begun, f"(?:{'|'.join(labels)})_[0-9A-Fa-f]{{0,64}}\\}}?"]
    return f"(?:{'|'.join(begun)}|{re.escape(start)}(?:{'|'.join(rest)})?)\\z"


def partial_tail(text: Column, prefix: str) -> Column:
    """Where (from 0) a placeholder begins that the text's end cuts off; null if none."""
    tail = F.substring(text, -(len(prefix) + 3 + 16 + 1 + 64 + 2), 1 << 20)
    found = F.regexp_substr(tail, F.lit(partial_tail_pattern(prefix)))
    return F.when(found.isNotNull(), F.length(text) - F.length(found))


def looks_like_json(content_type: Column, body: Column) -> Column:
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return F.contains(kind, F.lit("application/json")) | F.contains(kind, F.lit("+json")) | F.try_parse_json(body).isNotNull()


def scrub(line: Column, prefix: str) -> Column:
    """A log line without secrets: placeholders, bearer headers, keys with values, and keys of known make."""
    for pattern, by in scrub_steps(prefix):
        line = F.regexp_replace(line, pattern, re.sub(r"\\(\d)", r"$\1", by))
    return line
