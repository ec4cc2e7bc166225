"""Logging without secrets: a filter for Python's logging that scrubs what goes out."""

from __future__ import annotations

import logging
import re

from .config import PREFIX
from .errors import MaskError
from .vocabulary import scrub_steps


def scrub(line: str, prefix: str = PREFIX) -> str:
    """As functions.scalars.scrub, for one string."""
    for pattern, by in scrub_steps(prefix):
        line = re.sub(pattern, by, line)
    return line


#: From the gravest on; a message goes out if its level is no lower than the one in force.
LEVELS = {"error": logging.ERROR, "warn": logging.WARNING, "info": logging.INFO, "debug": logging.DEBUG}
_ALSO = {"warning": "warn", "trace": "debug"}
LOGGER = logging.getLogger("cloakframe")


def parse_level(text: str) -> str | None:
    word = text.strip().lower()
    word = _ALSO.get(word, word)
    return word if word in LEVELS else None


def configure(level: str = "info") -> None:
    """Log to standard error from a level on, everything scrubbed; an unknown level is an error."""
    if (name := parse_level(level)) is None:
        raise MaskError(f"there is no log level `{level}`")
    if not LOGGER.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(_Plain())
        LOGGER.addHandler(handler)
        LOGGER.addFilter(ScrubFilter())
        LOGGER.propagate = False
    LOGGER.setLevel(LEVELS[name])


def emit(level: str, message: str, code: str | None = None) -> None:
    LOGGER.log(LEVELS[parse_level(level) or "info"], "%s", f"{code}: {message}" if code else message)


class _Plain(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        name = {number: name for name, number in LEVELS.items()}.get(record.levelno, "info")
        return f"cloakframe {name}: {record.getMessage()}"


class ScrubFilter(logging.Filter):
    def filter(self, record: logging.LogRecord) -> bool:
        record.msg, record.args = scrub(record.getMessage()), ()
        return True
