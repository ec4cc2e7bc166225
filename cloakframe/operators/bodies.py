"""Request and response bodies: JSON whose strings may hold JSON or Base64 again.

One Arrow pass rewrites a body and gives its replacements; the schema of a body is
open, so it is walked as a tree. A body that fails gives an error code, not a failed job.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PREFIX, Settings
from ..errors import BODY_TOO_LARGE, INVALID_JSON, STRICT_RESOLVE_FAILED
from ..functions.local import Classifier, Engine, decoded, render, restore, size
from ..tables import bounded_batches, slices, written
from ..vocabulary import KINDS, POLICY, PROMPT_HINTS
from . import rewrite
from .scope import LARGE_PROMPT_BYTES

MOST_DEPTH = 2
MOST_NESTED_BYTES = 64 * 1024
_BASE64 = re.compile(r"[A-Za-z0-9+/]{24,}={0,2}|[A-Za-z0-9_-]{24,}")
REPLACEMENT = "struct<start:int,stop:int,secret:string,rule_id:string,kind:string,subtype:string,policy:string,source:string,confidence:string,score:int,entropy:double,id:string,placeholder:string,depth:int>"
_REPLACEMENT = pa.struct([(n, {"int": pa.int32(), "string": pa.string(), "double": pa.float64()}[t]) for n, t in (x.split(":") for x in REPLACEMENT[7:-1].split(","))])


def compact(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def map_strings(value: object, change: Callable[[str], str]) -> object:
    """value with every string, but no key, changed."""
    if isinstance(value, str):
        return change(value)
    if isinstance(value, list):
        return [map_strings(x, change) for x in value]
    return {k: map_strings(value[k], change) for k in sorted(value)} if isinstance(value, dict) else value


def nested(text: str, depth: int, change: Callable[[str, int], str]) -> str:
    """text after change(text, depth) of itself and, before, of what JSON or Base64 in it wraps.

    Wrapped texts are opened to a depth of MOST_DEPTH, and only in texts of
    MOST_NESTED_BYTES or less; a wrapping stays as it was unless its content changes.
    """
    if depth < MOST_DEPTH and size(text) <= MOST_NESTED_BYTES:
        inner = lambda s: nested(s, depth + 1, change)
        core = text.strip()
        if core[:1] in ("{", "[", '"'):
            try:
                tree = json.loads(core)
            except ValueError:
                tree = None
            if isinstance(tree, (dict, list, str)):
                after = map_strings(tree, inner)
                if after != tree:
                    at = text.index(core)
                    text = text[:at] + compact(after) + text[at + len(core) :]

        def token(m: re.Match) -> str:
            opened = decoded(m[0])
            if opened is None:
                return m[0]
            said, write = opened
            after = inner(said)
            return m[0] if after == said else write(after)

        text = _BASE64.sub(token, text)
    return change(text, depth)


def _user_content(item: object, change: Callable[[str], str]) -> None:
    """Change the content of a message in place, if it is a user's or nobody's."""
    if not isinstance(item, dict) or item.get("role", "user") != "user" and isinstance(item.get("role"), str):
        return
    content = item.get("content")
    if isinstance(content, str):
        item["content"] = change(content)
    for block in content if isinstance(content, list) else ():
        if isinstance(block, dict) and isinstance(block.get("text"), str):
            block["text"] = change(block["text"])


def hidden_prompt(tree: object) -> bool:
    """Whether a top-level prompt is so large, and without any hint of a secret, that only messages are walked."""

    def large(text: object) -> bool:
        return isinstance(text, str) and size(text) >= LARGE_PROMPT_BYTES and not any(h in text.lower() for h in PROMPT_HINTS)

    return isinstance(tree, dict) and any(large(tree.get(k)) for k in ("prompt", "instructions"))


def walk_messages(tree: object, change: Callable[[str], str], top_level: bool = True) -> None:
    """Change user content of messages and input and, if top_level, instructions and prompt."""
    if not isinstance(tree, dict):
        return
    for key in ("messages", "input"):
        for item in tree[key] if isinstance(tree.get(key), list) else ():
            _user_content(item, change)
    for key in ("instructions", "prompt") if top_level else ():
        if isinstance(tree.get(key), str):
            tree[key] = change(tree[key])


def walk_socket(tree: object, change: Callable[[str], str], count: Callable[[], int]) -> int:
    """Change user content of input and messages; how many values the last user items of both held."""
    of_last = 0
    for key in ("input", "messages") if isinstance(tree, dict) else ():
        items = tree[key] if isinstance(tree.get(key), list) else []
        users = [i for i, x in enumerate(items) if isinstance(x, dict) and x.get("role") == "user"]
        for i, item in enumerate(items):
            before = count()
            _user_content(item, change)
            if users and i == users[-1]:
                of_last += count() - before
    return of_last


def histogram(kinds: list[str]) -> str:
    labels = sorted(KINDS[k][0] for k in kinds)
    return ", ".join(f"{labels.count(x)} {x}" for x in dict.fromkeys(labels))


def notice(count: int, kinds: list[str], mode: str, prefix: str = PREFIX) -> str:
    example = "{{" + prefix + "_OPAQUE_xxxx}}"
    found = f"Found here: {histogram(kinds)}." if kinds else "They may be secrets, passwords or other personal values."
    short = f"{count} sensitive value(s) were masked and stand here as placeholders such as {example}. {found} Use placeholders as they are; the real values are put back before anything leaves."
    return short if mode == "minimal" else short + " You never see the real values. When you first meet a placeholder, tell the user that the value was masked, then go on as usual."


def add_notice(tree: object, text: str, prefix: str = PREFIX) -> object:
    """tree with the notice where the model takes instructions from: its system field, or a last developer message."""
    said = f"[{prefix}] {text}"
    if not isinstance(tree, dict):
        return tree
    if isinstance(tree.get("model"), str) and "claude" in tree["model"]:
        system = tree.get("system")
        if isinstance(system, str):
            tree["system"] = f"{system}\n\n{said}"
        elif isinstance(system, list):
            tree["system"] = [*system, {"type": "text", "text": said}]
        else:
            tree["system"] = said
    else:
        for key in ("input", "messages"):
            if isinstance(tree.get(key), list):
                tree[key].append({"role": "developer", "content": said})
                break
    return tree


@dataclass
class Masker:
    """Masks bodies under settings; the salt makes the ids of a session, none those of a dry run."""

    settings: Settings
    salt: bytes | None = None
    classifier: Classifier | None = None
    engine: Engine = field(init=False)

    def __post_init__(self):
        self.engine = Engine(self.settings.detection, self.settings.allowlist, self.settings.prefix, self.classifier)

    def text(self, text: str, found: list[dict], depth: int = 0) -> str:
        def change(own: str, level: int) -> str:
            out, last = [], 0
            for f in self.engine.find(own):
                salt = b"" if self.settings.dry_run else self.salt or b""
                id_ = hashlib.sha256(salt + f.kind.encode() + f.secret.encode()).hexdigest()[:16]
                mark = render(f.kind, id_, self.settings.prefix)
                found.append(asdict(f) | {"policy": POLICY, "id": id_, "placeholder": mark, "depth": level})
                out += [own[last : f.start], mark]
                last = f.stop
            return "".join(out) + own[last:]

        return nested(text, depth, change)

    def body(self, body: str, walk: str = "messages") -> tuple[str | None, list[dict], str | None]:
        """Masked body, replacements and error code. walk: messages, input, socket or strings."""
        most = self.settings.max_body_bytes
        if most > 0 and size(body) > most:
            return None, [], BODY_TOO_LARGE
        try:
            tree = json.loads(body)
        except ValueError:
            return None, [], INVALID_JSON
        found: list[dict] = []
        change = lambda s: self.text(s, found)
        told = None
        if walk == "strings":
            tree = map_strings(tree, change)
        elif walk == "socket":
            told = walk_socket(tree, change, lambda: len(found))
        else:
            walk_messages(tree, change, top_level=walk == "messages" and not hidden_prompt(tree))
        told = len(found) if told is None else told
        if self.settings.dry_run:
            return body, found, None
        if told and self.settings.notice_mode != "off" and walk != "strings":
            tree = add_notice(tree, notice(told, [f["kind"] for f in found], self.settings.notice_mode, self.settings.prefix), self.settings.prefix)
        return compact(tree), found, None


def masked_bodies(df: DataFrame, key: str, body_col: str, settings: Settings, salt: bytes | None = None, walk: str = "messages", classifier: Classifier | None = None) -> DataFrame:
    """key, body, masked (null after an error), replacements and error_code of each row. A null body gives nulls."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masker = Masker(settings, salt, classifier)
        for batch in slices(batches):
            done = [(None, [], None) if b is None else masker.body(b, walk) for b in batch.column(1).to_pylist()]
            yield pa.record_batch(
                [*batch.columns, pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.list_(_REPLACEMENT)), pa.array([d[2] for d in done], pa.string())],
                ["key", "body", "masked", "replacements", "error_code"],
            )

    bounded_batches(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(body_col).alias("body"))
    return rows.mapInArrow(run, f"key {kind}, body string, masked string, replacements array<{REPLACEMENT}>, error_code string").withColumnRenamed("key", key)


def restored_bodies(df: DataFrame, key: str, body_col: str, known: DataFrame, now, prefix: str = PREFIX, strict: bool = False, as_json: bool = True) -> DataFrame:
    """key, restored and error_code: bodies with placeholders put back, also within nested JSON and Base64.

    The placeholders of each body are collected once and written beside it; they are joined
    with the mapping under a number of the row, so keys may repeat or be null. Only bodies
    that hold some are parsed again. If strict, a miss leaves no text but an error code, else the body as it was.
    """
    kind = df.schema[key].dataType.simpleString()
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(body_col).alias("body"), F.monotonically_increasing_id().alias("row"))
    asked = pa.list_(pa.struct([("kind", pa.string()), ("id", pa.string())]))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for body in batch.column(1).to_pylist():
                seen: set[tuple[str, str]] = set()
                _restored(body, lambda k, i: seen.add((k, i)), prefix, as_json)  # noqa: B023
                found.append([{"kind": k, "id": i} for k, i in sorted(seen)])
            yield pa.record_batch([*batch.columns, pa.array(found, asked)], ["key", "body", "row", "ids"])

    told = written(rows.mapInArrow(wanted, f"key {kind}, body string, row long, ids array<struct<kind:string,id:string>>"))
    some = told.where("size(ids) > 0")
    values = rewrite.entries(rewrite.lookup(some.select("row", F.explode("ids").alias("i")).select("row", "i.id", "i.kind"), known, now), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out, codes = [], []
            for body, values in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                have = dict(values or ())
                text, missed = _restored(body, lambda k, i: have.get(f"{k}:{i}"), prefix, as_json)  # noqa: B023
                out.append(None if strict and missed else text)
                codes.append(STRICT_RESOLVE_FAILED if strict and missed else None)
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string()), pa.array(codes, pa.string())], ["key", "restored", "error_code"])

    done = some.join(values, "row", "left").select("key", "body", "values").mapInArrow(run, f"key {kind}, restored string, error_code string")
    plain = told.where("size(ids) = 0").select("key", F.col("body").alias("restored"), F.lit(None).cast("string").alias("error_code"))
    return plain.unionByName(done).withColumnRenamed("key", key)


def _restored(body: str | None, look: Callable[[str, str], str | None], prefix: str, as_json: bool) -> tuple[str | None, bool]:
    if body is None:
        return None, False
    missed = False

    def change(text: str, _: int) -> str:
        nonlocal missed
        out, miss = restore(text, look, prefix)
        missed = missed or miss
        return out

    if not as_json:
        return nested(body, 0, change), missed
    try:
        tree = json.loads(body)
    except ValueError:
        return body, False
    after = map_strings(tree, lambda s: nested(s, 0, change))
    return (body if after == tree else compact(after)), missed
