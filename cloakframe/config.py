"""Settings: defaults, then a TOML file, then the environment."""

from __future__ import annotations

import os
import re
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from datetime import timedelta
from pathlib import Path

from .errors import MaskError

PREFIX = "VEIL"
ENV = "CLOAKFRAME_"


@dataclass(frozen=True)
class Detection:
    """Which detectors run. Opaque tokens are on by default, typed ones off."""

    entropy: bool = True
    entropy_threshold: float = 3.5
    entropy_min_len: int = 20
    passwords: bool = False
    emails: bool = False
    phones: bool = False
    national_ids: bool = False
    passports: bool = False
    payment_cards: bool = False
    cvv: bool = False

    @classmethod
    def everything(cls) -> Detection:
        return cls(**{f.name: True for f in fields(cls) if f.type == "bool"})


@dataclass(frozen=True)
class Allowlist:
    """Findings to leave alone, by rule, by a pattern in the value, or by the value's SHA-256."""

    rule_ids: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    secret_sha256: tuple[str, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "rule_ids", tuple(r.strip().lower() for r in self.rule_ids if r.strip()))
        hashes = tuple(h.strip().lower() for h in self.secret_sha256)
        for i, h in enumerate(hashes):
            if not re.fullmatch(r"[0-9a-f]{64}", h):
                raise MaskError(f"allowlist.secret_sha256[{i}] must be 64 hex digits")
        object.__setattr__(self, "secret_sha256", hashes)
        for i, p in enumerate(self.patterns):
            try:
                re.compile(p)
            except re.error as e:
                raise MaskError(f"allowlist.patterns[{i}] is no pattern: {e}") from e
            if len(p) > 1 << 16:
                raise MaskError(f"allowlist.patterns[{i}] is too long")


EVENTS = ("secret_detected", "request_redacted")
#: What a hook can do, and which setting that takes.
NEEDS = {"exec": "command", "log": "path", "block": None}


@dataclass(frozen=True)
class Hook:
    """What to do with findings of some rules: log, exec or block."""

    event: str
    action: str
    rule_ids: tuple[str, ...] = ("*",)
    command: str | None = None
    path: str | None = None
    timeout_ms: int = 2_000
    message: str | None = None

    def __post_init__(self) -> None:
        if self.event not in EVENTS:
            raise MaskError(f"a hook can't follow `{self.event}`")
        if self.action not in NEEDS:
            raise MaskError(f"a hook can't do `{self.action}`")
        if NEEDS[self.action] and not (getattr(self, NEEDS[self.action]) or "").strip():
            raise MaskError(f"a hook that is to {self.action} needs a {NEEDS[self.action]}")
        if self.action == "block" and self.event != "secret_detected":
            raise MaskError("only a found secret can be blocked")

    def applies(self, event: str, rule_id: str) -> bool:
        return self.event == event and bool({"*", rule_id.strip().lower()} & set(self.rule_ids))


def parse_hook(i: int, entry: Mapping) -> Hook:
    name = f"hooks[{i}]"
    for key in entry:
        if key not in ("event", "rule_ids", "action", "command", "path", "timeout_ms", "message"):
            raise MaskError(f"{name}: there is no key `{key}`")
    event, action = str(entry.get("event", "")).strip().lower(), str(entry.get("action", "")).strip().lower()
    given = {k for k in ("command", "path", "timeout_ms") if entry.get(k) is not None}
    need = NEEDS.get(action)
    surplus = given - {need} - ({"timeout_ms"} if action == "exec" else set())
    if action in NEEDS and surplus:
        raise MaskError(f"{name}: {', '.join(sorted(surplus))} has no use in a hook that is to {action}")
    rules = tuple(r.strip().lower() for r in entry.get("rule_ids", []) if r.strip()) or ("*",)
    try:
        return Hook(event, action, rules, (entry.get("command") or "").strip() or None, entry.get("path"), int(entry.get("timeout_ms") or 2_000), entry.get("message"))
    except MaskError as e:
        raise MaskError(f"{name}: {e}") from e


#: The hosts of known tools and of providers.
TOOL_HOSTS = {
    "codex": ("api.openai.com", "chat.openai.com", "chatgpt.com"),
    "claude": ("api.anthropic.com", "claude.ai"),
}
PROVIDER_HOSTS = ("generativelanguage.googleapis.com", "api.together.xyz", "api.groq.com", "api.mistral.ai", "api.cohere.ai", "api.deepseek.com")


@dataclass(frozen=True)
class Settings:
    detection: Detection = field(default_factory=Detection)
    allowlist: Allowlist = field(default_factory=Allowlist)
    hooks: tuple[Hook, ...] = ()
    hosts: tuple[str, ...] = ()
    prefix: str = PREFIX
    session_ttl: timedelta = timedelta(hours=1)
    fail_closed: bool = True
    dry_run: bool = False
    max_body_bytes: int = 2 << 20
    notice_mode: str = "verbose"
    audit_path: str | None = None
    tool_hosts: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: TOOL_HOSTS)
    provider_hosts: tuple[str, ...] = PROVIDER_HOSTS

    def hosts_of(self, tool: str = "") -> tuple[str, ...]:
        """The hosts that are looked at for a tool: its own, those of all providers, then the extra ones; for another tool those of all tools."""
        own = self.tool_hosts.get(tool.strip().lower())
        some = [own] if own is not None else list(self.tool_hosts.values())
        return union_hosts(*some, self.provider_hosts, self.hosts)


_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def parse_duration(text: str) -> timedelta:
    """Like ``1h30m`` or ``250ms``: numbers with units, one after the other."""
    found = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)", text.strip())
    if not found or "".join(n + u for n, u in found) != text.strip():
        raise MaskError(f"`{text}` is no duration")
    return timedelta(seconds=sum(float(n) * _UNITS[u] for n, u in found))


def parse_bool(text: str, fallback: bool) -> bool:
    word = text.strip().lower()
    return True if word in ("1", "t", "true", "y", "yes", "on") else False if word in ("0", "f", "false", "n", "no", "off") else fallback


def parse_notice_mode(text: str) -> str | None:
    word = text.strip().lower()
    return {"verbose": "verbose", "minimal": "minimal", "brief": "minimal", "compact": "minimal", "off": "off", "none": "off"}.get(word)


def audit_path(text: str | None) -> str | None:
    return None if text is None or text.strip().lower() in ("", "off", "none", "disabled", "false") else text


_SCALARS = {"prefix": str, "fail_closed": bool, "dry_run": bool, "max_body_bytes": int, "notice_mode": str, "audit_path": str, "session_ttl": str}


def from_toml(text: str, base: Settings | None = None) -> Settings:
    """Settings of a TOML text over base. Unknown keys and bad values make the whole text invalid."""
    base = base or Settings()
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise MaskError(f"config is no TOML: {e}") from e
    changes: dict = {}
    for key, value in data.items():
        if key == "detection":
            kinds = {f.name: f.type for f in fields(Detection)}
            for name, x in value.items():
                if name not in kinds:
                    raise MaskError(f"detection has unknown key `{name}`")
                if (kinds[name] == "bool") != isinstance(x, bool) or not isinstance(x, (bool, int, float)):
                    raise MaskError(f"detection.{name} has a wrong type")
            changes[key] = replace(base.detection, **value)
        elif key == "allowlist":
            if unknown := set(value) - {f.name for f in fields(Allowlist)}:
                raise MaskError(f"allowlist has unknown key `{min(unknown)}`")
            changes[key] = Allowlist(**{k: tuple(v) for k, v in value.items()})
        elif key == "hooks":
            changes[key] = tuple(parse_hook(i, x) for i, x in enumerate(value))
        elif key == "hosts":
            changes[key] = tuple(value)
        elif key in _SCALARS:
            if type(value) is not _SCALARS[key]:
                raise MaskError(f"{key} has a wrong type")
            changes[key] = value
        else:
            raise MaskError(f"config has unknown key `{key}`")
    if "session_ttl" in changes:
        changes["session_ttl"] = parse_duration(changes["session_ttl"])
    if "notice_mode" in changes and (mode := parse_notice_mode(changes["notice_mode"])) is None:
        raise MaskError("notice_mode must be verbose, minimal or off")
    elif "notice_mode" in changes:
        changes["notice_mode"] = mode
    if "audit_path" in changes:
        changes["audit_path"] = audit_path(changes["audit_path"])
    return replace(base, **changes)


def from_env(env: Mapping[str, str], base: Settings) -> Settings:
    """Settings of the environment over base; a value that can't be read leaves the one below in force."""

    def get(name: str, kind, now):
        text = env.get(ENV + name.upper())
        if text is None:
            return now
        try:
            return parse_bool(text, now) if kind is bool else kind(text)
        except (ValueError, MaskError):
            return now

    detection = {f.name: get(f.name, {"bool": bool, "int": int, "float": float}[f.type], getattr(base.detection, f.name)) for f in fields(Detection)}
    return replace(
        base,
        detection=Detection(**detection),
        fail_closed=get("fail_closed", bool, base.fail_closed),
        dry_run=get("dry_run", bool, base.dry_run),
        max_body_bytes=get("max_body_bytes", int, base.max_body_bytes),
        session_ttl=get("session_ttl", parse_duration, base.session_ttl),
        notice_mode=parse_notice_mode(env.get(ENV + "NOTICE_MODE", "")) or base.notice_mode,
        audit_path=audit_path(env[ENV + "AUDIT_PATH"]) if ENV + "AUDIT_PATH" in env else base.audit_path,
        hosts=get("hosts", lambda t: union_hosts(t.split(",")), base.hosts),
    )


def load(path: str | None = None, env: Mapping[str, str] | None = None) -> Settings:
    base = Settings()
    if path and Path(path).exists():
        base = from_toml(Path(path).read_text(), base)
    return from_env(os.environ if env is None else env, base)


def union_hosts(*lists) -> tuple[str, ...]:
    """All hosts once, in the order they first stand."""
    return tuple(dict.fromkeys(h.strip() for hosts in lists for h in hosts if h.strip()))
