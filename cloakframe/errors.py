"""Errors with a stable code, and the fail-closed choice for rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What readers of error columns and logs go by.
NOT_INTERCEPTED = "mitm_not_effective"
BODY_TOO_LARGE = "body_too_large"
INVALID_JSON = "invalid_json"
REQUEST_TIMEOUT = "request_timeout"
STRICT_RESOLVE_FAILED = "strict_resolve_failed"
HOOK_BLOCKED = "hook_blocked"


class MaskError(Exception):
    def __init__(self, message: str, code: str | None = None):
        super().__init__(f"{code}: {message}" if code else message)
        self.code = code


def code_of(error: BaseException | None) -> str | None:
    """The nearest code along the chain of causes."""
    while error is not None:
        if getattr(error, "code", None):
            return error.code
        error = error.__cause__ or error.__context__
    return None


def fail_closed(original: Column, rewritten: Column, error_code: Column, strict: bool) -> Column:
    """What leaves for a row: the rewritten body; after an error nothing if strict or blocked by a hook, else the original."""
    blocked = error_code == HOOK_BLOCKED
    return F.when(error_code.isNull(), rewritten).when(F.lit(strict) | blocked, F.lit(None).cast("string")).otherwise(original)
