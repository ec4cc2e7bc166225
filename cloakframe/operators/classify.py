"""A classifier of typed findings that asks a model: any callable, or a chat completion endpoint."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the model is told to do, and the word a reply begins with if it takes a value for what it is said to be.
TASK = "Decide whether a value really is sensitive data of the given kind, judging by its context. Answer ALLOW if it is, else DENY."
YES = "ALLOW"


def question(kind: str, subtype: str | None, value: str, context: str | None) -> str:
    return json.dumps({"kind": kind, "subtype": subtype, "value": value, "context": context}, ensure_ascii=False)


def accepts(reply: str | None) -> bool:
    return (reply or "").strip().upper().startswith(YES)


def endpoint(url: str, model: str, timeout_s: float = 3.0) -> Callable[[str], str]:
    """A callable that asks a chat completion endpoint, without randomness."""

    def ask(asked: str) -> str:
        body = {"model": model, "temperature": 0, "messages": [{"role": "system", "content": TASK}, {"role": "user", "content": asked}]}
        with urlopen(Request(url, json.dumps(body).encode(), {"content-type": "application/json"}), timeout=timeout_s) as reply:
            return json.load(reply)["choices"][0]["message"]["content"]

    return ask


def asking(ask: Callable[[str], str], at_once: int = 8, timeout_s: float = 3.0) -> Callable[[Column, Column, Column, Column], Column]:
    """A classifier for detect.with_findings. Equal questions of a batch are asked once; a failure or a late reply accepts the finding."""

    @F.pandas_udf("boolean")
    def verdicts(kind: pd.Series, subtype: pd.Series, value: pd.Series, context: pd.Series) -> pd.Series:
        asked = [question(*x) for x in zip(kind, subtype, value, context)]
        pool = ThreadPoolExecutor(at_once)
        waiting = {q: pool.submit(ask, q) for q in dict.fromkeys(asked)}
        said = {}
        for q, reply in waiting.items():
            try:
                said[q] = accepts(reply.result(timeout=timeout_s * (1 + len(waiting) // at_once)))
            except Exception:  # noqa: BLE001  whatever fails, the finding stays
                said[q] = True
        pool.shutdown(wait=False, cancel_futures=True)
        return pd.Series([said[q] for q in asked], dtype=bool)

    return verdicts
