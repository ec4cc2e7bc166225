"""Server-sent events cut anywhere: frames, fragments, and placeholders split between them.

State is kept for each stream: bytes of an unfinished event, and text of fragments that
may yet end in a placeholder. Frames of a stream are taken in order of seq within a
micro-batch. A frame marked last, or a processing-time timeout, lets out what is held.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import PREFIX
from ..functions.local import restore
from ..functions.scalars import partial_tail_pattern

_END = re.compile(rb"\r?\n\r?\n")


def split_events(carry: bytes, frame: bytes) -> tuple[list[bytes], bytes]:
    """Whole events (with their ends) of carry and frame, and the bytes after the last."""
    data, out, at = carry + frame, [], 0
    for end in _END.finditer(data):
        out.append(data[at : end.end()])
        at = end.end()
    return out, data[at:]


def _lines(event: bytes) -> list[bytes]:
    """Lines end at a line feed, with or without a carriage return; other separators are text that JSON may hold."""
    return [x.removesuffix(b"\r") for x in event.split(b"\n")]


def fragment(event: bytes) -> tuple[dict, str] | None:
    """The payload of an event that carries partial JSON, and that fragment; none for other events, nor for data that isn't UTF-8."""
    if b"input_json_delta" not in event and b"\\u" not in event:
        return None
    data = b"\n".join(x[5:].removeprefix(b" ") for x in _lines(event) if x.startswith(b"data:"))
    try:
        payload = json.loads(data.decode())
        delta = payload["delta"]
        if delta["type"] == "input_json_delta" and isinstance(delta["partial_json"], str):
            return payload, delta["partial_json"]
    except (ValueError, KeyError, TypeError):
        pass
    return None


def with_fragment(event: bytes, payload: dict, text: str) -> bytes:
    """The event with another fragment; lines that aren't data stay, byte for byte."""
    kept = [x for x in _lines(event.rstrip(b"\r\n")) if not x.startswith(b"data:")]
    payload = payload | {"delta": payload["delta"] | {"partial_json": text}}
    try:
        data = json.dumps(payload, ensure_ascii=False, separators=(",", ":")).encode()
    except UnicodeEncodeError:  # half a surrogate pair can only be written escaped
        data = json.dumps(payload, separators=(",", ":")).encode()
    return b"\n".join([*kept, b"data: " + data]) + b"\n\n"


def head_within(text: str, most: int) -> str:
    """The longest start of text of at most so many bytes that ends between characters."""
    data = _utf8(text)[:most]
    for cut in range(4):
        try:
            return data[: len(data) - cut].decode("utf-8", "surrogatepass")
        except UnicodeDecodeError:
            continue
    return ""


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


class Assembler:
    """One stream: feed frames, get events with placeholders restored."""

    def __init__(self, look: Callable[[str, str], str | None], prefix: str = PREFIX, carry: bytes = b"", text: str = "", held: list[bytes] | None = None):
        self.look, self.prefix, self.carry, self.text = look, prefix, carry, text
        #: Events that wait, each with its payload and fragment, which are read once.
        self.held = [(e, *fragment(e)) for e in held or []]
        #: Characters of the longest placeholder that may have begun: prefix, kind, id and brackets.
        self.longest = len(prefix) + 3 + 16 + 1 + 64 + 2
        self.tail = re.compile(partial_tail_pattern(prefix).replace(r"\z", r"\Z"))

    def feed(self, frame: bytes) -> list[bytes]:
        events, self.carry = split_events(self.carry, frame)
        out: list[bytes] = []
        for event in events:
            found = fragment(event)
            if found is None:
                out += self.flush()
                out.append(event)
            else:
                self.held.append((event, *found))
                self.text += found[1]
                out += self._release()
        return out

    def _release(self) -> list[bytes]:
        """Let go what can't be part of a placeholder any more; the last event waits while it may be."""
        at = max(0, len(self.text) - self.longest)
        cut = self.tail.search(self.text, self.text.find("{", at) if "{" in self.text[at:] else len(self.text))
        ready, rest = (self.text[: cut.start()], self.text[cut.start() :]) if cut else (self.text, "")
        ready, _ = restore(ready, self.look, self.prefix)
        if rest and len(self.held) == 1:
            return []
        going = self.held[:-1] if rest else self.held
        out = []
        for i, (event, payload, own) in enumerate(going):
            part = ready if i == len(going) - 1 else head_within(ready, len(_utf8(own)))
            ready = ready[len(part) :]
            out.append(with_fragment(event, payload, part))
        self.held, self.text = self.held[len(going) :], rest
        return out

    def flush(self) -> list[bytes]:
        """Everything held, ended or not."""
        if not self.held:
            return []
        done, _ = restore(self.text, self.look, self.prefix)
        out = []
        for i, (event, payload, own) in enumerate(self.held):
            part = done if i == len(self.held) - 1 else head_within(done, len(_utf8(own)))
            done = done[len(part) :]
            out.append(with_fragment(event, payload, part))
        self.held, self.text = [], ""
        return out

    def end(self) -> list[bytes]:
        out = self.flush() + ([self.carry] if self.carry else [])
        self.carry = b""
        return out


def reassembled(frames: DataFrame, look: Callable[[str, str], str | None], prefix: str = PREFIX, idle_ms: int = 60_000) -> DataFrame:
    """stream_id, n and event of a streaming table (stream_id string, seq long, frame binary, last boolean)."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        carry, text, held, n = state.get if state.exists else (b"", "", "", 0)
        one = Assembler(look, prefix, bytes(carry), text, [base64.b64decode(e) for e in held.split()])
        if state.hasTimedOut:
            events, ended = one.end(), True
        else:
            rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
            events, ended = [], False
            for frame, last in zip(rows["frame"], rows["last"]):
                events += one.feed(bytes(frame) if frame is not None else b"")
                if last:
                    events += one.end()
                    ended = True
        if ended:
            state.remove()
        else:
            state.update((one.carry, one.text, " ".join(base64.b64encode(e).decode() for e, _, _ in one.held), n + len(events)))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"stream_id": [key[0]] * len(events), "n": range(n, n + len(events)), "event": events})

    return frames.groupBy("stream_id").applyInPandasWithState(
        run, "stream_id string, n long, event binary", "carry binary, text string, held string, n long", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
