"""Commands: redact and resolve one JSON body, stats over an audit log, doctor.

    python -m cloakframe.cli redact --mapping DIR < body.json
"""

from __future__ import annotations

import argparse
import json
import os
import secrets
import sys
from datetime import datetime, timedelta, timezone
from pathlib import Path

from . import config
from .errors import STRICT_RESOLVE_FAILED, MaskError, code_of
from .log import scrub


def _redact(args: argparse.Namespace, settings: config.Settings) -> int:
    """Mask the body on stdin; the mapping goes to a file that only the owner reads."""
    from .operators import hooks
    from .operators.bodies import Masker

    body, found, code = Masker(settings, secrets.token_bytes(32)).body(sys.stdin.read())
    now = int(datetime.now(timezone.utc).timestamp())
    if (blocked := hooks.run_local(found, settings.hooks, "secret_detected", "stdin", now)) is not None:
        print(f"hook_blocked: {blocked}", file=sys.stderr)
        return 1
    if code:
        print(code, file=sys.stderr)
        return 1
    if args.mapping and not settings.dry_run and found:
        until = (datetime.now(timezone.utc) + settings.session_ttl).isoformat()
        with os.fdopen(os.open(args.mapping, os.O_WRONLY | os.O_CREAT | os.O_APPEND, 0o600), "a") as f:
            for x in found:
                f.write(json.dumps({"id": x["id"], "kind": x["kind"], "secret": x["secret"], "expires_at": until}) + "\n")
    if settings.audit_path and not settings.dry_run:
        Path(settings.audit_path).parent.mkdir(parents=True, exist_ok=True)
        with open(settings.audit_path, "a") as f:
            for x in found:
                row = {"ts": f"{datetime.now(timezone.utc):%Y-%m-%dT%H:%M:%SZ}", "request_host": "stdin", "action": "redacted", "match_source": x["source"], "confidence_score": x["score"], "decoded_depth": x["depth"]}
                f.write(json.dumps(row | {k: x[k] for k in ("rule_id", "kind", "subtype", "policy", "placeholder", "confidence", "entropy")}) + "\n")
    if not settings.dry_run:
        hooks.run_local(found, settings.hooks, "request_redacted", "stdin", now)
    sys.stdout.write(body)
    n = len(found)
    print("no replacements" if not n else f"{'would replace' if settings.dry_run else 'replaced'} {n} sensitive value(s)", file=sys.stderr)
    return 0


def _resolve(args: argparse.Namespace, settings: config.Settings) -> int:
    from .operators.bodies import _restored

    now, known = datetime.now(timezone.utc), {}
    for line in Path(args.mapping).read_text().splitlines():
        x = json.loads(line)
        if datetime.fromisoformat(x["expires_at"]) > now:
            known[x["kind"], x["id"]] = x["secret"]
    body = sys.stdin.read()
    text, missed = _restored(body, lambda k, i: known.get((k, i)), settings.prefix, True)
    if missed and settings.fail_closed:
        print(STRICT_RESOLVE_FAILED, file=sys.stderr)
        return 1
    sys.stdout.write(text)
    return 0


def _stats(args: argparse.Namespace, settings: config.Settings) -> int:
    from pyspark.sql import SparkSession

    from .operators import audit

    path = args.path or settings.audit_path
    if not path:
        print("the audit log is disabled")
        return 0
    spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
    print(audit.render(audit.checked(spark, path), path, args.limit), end="")
    return 0


def checks(settings: config.Settings) -> list[tuple[str, str, str]]:
    """PASS, WARN or FAIL, what was checked and why."""
    d, a = settings.detection, settings.allowlist
    typed = [n for n in ("passwords", "emails", "phones", "national_ids", "passports", "payment_cards", "cvv") if getattr(d, n)]
    out = [
        ("PASS" if d.entropy or typed else "FAIL", "detection", f"opaque tokens {'on' if d.entropy else 'off'}, typed: {', '.join(typed) or 'none'}"),
        ("PASS" if 0 < d.entropy_threshold <= 8 and d.entropy_min_len > 0 else "FAIL", "entropy", f"threshold {d.entropy_threshold}, from {d.entropy_min_len} bytes"),
        ("WARN" if a.rule_ids or a.patterns or a.secret_sha256 else "PASS", "allowlist", f"{len(a.rule_ids)} rules, {len(a.patterns)} patterns, {len(a.secret_sha256)} hashes"),
        ("PASS" if settings.fail_closed else "WARN", "fail closed", "on" if settings.fail_closed else "off: failures let bodies through"),
        ("PASS" if settings.session_ttl > timedelta() else "FAIL", "session ttl", str(settings.session_ttl)),
        ("WARN" if any(h.action == "exec" for h in settings.hooks) else "PASS", "hooks", f"{len(settings.hooks)}"),
    ]
    return out


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cloakframe")
    parser.add_argument("--config")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("redact").add_argument("--mapping")
    sub.add_parser("resolve").add_argument("--mapping", required=True)
    stats = sub.add_parser("stats")
    stats.add_argument("--path")
    stats.add_argument("--limit", type=int, default=5)
    sub.add_parser("doctor")
    args = parser.parse_args(argv)
    try:
        settings = config.load(args.config)
    except MaskError as e:
        print(f"FAIL config: {e}", file=sys.stderr)
        return 1
    if args.command == "doctor":
        found = checks(settings)
        for state, name, why in found:
            print(f"{state} {name}: {why}")
        return int(any(state == "FAIL" for state, _, _ in found))
    try:
        return {"redact": _redact, "resolve": _resolve, "stats": _stats}[args.command](args, settings)
    except (MaskError, OSError) as e:
        print(f"{code_of(e) or 'failed'}: {scrub(str(e))}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
