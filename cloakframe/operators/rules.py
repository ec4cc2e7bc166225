"""Rule packs: a user's file of secret patterns, with keywords, entropy, capture groups and targeted allowlists.

One automaton looks for the keywords of all rules at once, so a text is read once however
many rules there are; a rule's pattern then runs only over texts that hold one of its
keywords. Patterns are matched by RE2 through Arrow's kernels, a batch of texts at a time: the dialect
that such packs are written in, in time linear in the text.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MaskError
from ..functions.local import entropy
from ..tables import bounded_batches, slices

FINDING = "rule_id string, start int, stop int, secret string, matched string, line int, entropy double"
#: Marks around a match, and before each of its groups; a text's own are taken for another character of their length.
OPEN, GROUP, SHUT, OTHER = "\x01", "\x02", "\x03", "\x04"
#: A replacement can name so many groups.
MOST_GROUPS = 9
TARGETS = ("secret", "match", "line")


def _check(pattern: str, where: str) -> None:
    try:
        pc.match_substring_regex(pa.array([""]), pattern)
    except pa.ArrowInvalid as e:
        raise MaskError(f"{where}: {e}") from e


def _automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    """Words as a trie with failure links; the value of a word is its number."""
    found = ahocorasick.Automaton()
    for i, word in enumerate(words):
        found.add_word(word, i)
    found.make_automaton()
    return found


def groups_of(pattern: str) -> int:
    """How many groups a pattern captures."""
    bare = re.sub(r"\\Q.*?(?:\\E|\Z)|\\.|\[\^?\]?(?:\[:\^?\w+:\]|\\.|[^\]\\])*\]", "", pattern, flags=re.S)
    return len(re.findall(r"\((?!\?)|\(\?P?<", bare))


@dataclass(frozen=True)
class RuleAllowlist:
    """What of a rule's findings is let be: by patterns of the secret, the whole match or its lines, by words in the secret, or by the path.

    One kind that holds is enough, or, if every is set, all kinds that are given must hold.
    """

    regexes: tuple[str, ...] = ()
    stopwords: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    target: str = "secret"
    every: bool = False

    def __post_init__(self):
        if self.target not in TARGETS:
            raise MaskError(f"an allowlist looks at one of {', '.join(TARGETS)}, not {self.target!r}")
        if not (self.regexes or self.stopwords or self.paths):
            raise MaskError("an allowlist needs patterns, stop words or paths")
        for p in (*self.regexes, *self.paths):
            _check(p, "allowlist")

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_stop"}

    @cached_property
    def _stop(self) -> ahocorasick.Automaton:
        return _automaton(tuple({w.lower() for w in self.stopwords}))

    def allows(self, secrets: pa.Array, matches: pa.Array, lines: list[tuple[int, int, int]], texts: list[str], paths: pa.Array) -> list[bool]:
        """Of each finding, whether this allowlist lets it be. lines are (row, start, stop); a line is judged once, however many findings it has."""
        checks = []
        if self.regexes and self.target == "line":
            each = list(dict.fromkeys(lines))
            told = dict(zip(each, _any(pa.array([texts[i][a:b] for i, a, b in each], pa.string()), self.regexes)))
            checks.append([told[x] for x in lines])
        elif self.regexes:
            checks.append(_any(secrets if self.target == "secret" else matches, self.regexes))
        if self.stopwords:
            checks.append([next(self._stop.iter(s.lower()), None) is not None for s in secrets.to_pylist()])
        if self.paths:
            checks.append(_any(paths, self.paths))
        return [all(x) if self.every else any(x) for x in zip(*checks)]


def _any(values: pa.Array, patterns: tuple[str, ...]) -> list[bool]:
    """Of each value, whether one of the patterns is found in it; never in null."""
    out = pa.array([False] * len(values))
    for p in patterns:
        out = pc.or_(out, pc.fill_null(pc.match_substring_regex(values, p), False))
    return out.to_pylist()


@dataclass(frozen=True)
class Rule:
    """A pattern, or a path alone; a text is looked at if it holds a keyword (in any case), if there are any, and its path matches, if one is given."""

    id: str
    regex: str | None = None
    keywords: tuple[str, ...] = ()
    entropy: float = 0.0
    group: int = 0
    path: str | None = None
    allowlists: tuple[RuleAllowlist, ...] = ()
    groups: int = field(init=False)

    def __post_init__(self):
        if not self.id:
            raise MaskError("a rule needs an id")
        if self.regex is None and self.path is None:
            raise MaskError(f"rule {self.id}: needs a regex or a path")
        for p in (self.regex, self.path):
            if p is not None:
                _check(p, f"rule {self.id}")
        object.__setattr__(self, "groups", groups_of(self.regex or ""))
        if self.group > self.groups or self.groups > MOST_GROUPS:
            raise MaskError(f"rule {self.id}: group {self.group} of {self.groups}; at most {MOST_GROUPS} are captured")


@dataclass(frozen=True)
class RulePack:
    """Rules, and allowlists for the findings of all of them."""

    rules: tuple[Rule, ...]
    allowlists: tuple[RuleAllowlist, ...] = ()

    def __post_init__(self):
        ids = [r.id for r in self.rules]
        if twice := {i for i in ids if ids.count(i) > 1}:
            raise MaskError(f"rules of the same id: {', '.join(sorted(twice))}")

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    @cached_property
    def _words(self) -> tuple[str, ...]:
        return tuple(sorted({w.lower() for r in self.rules for w in r.keywords}))

    @cached_property
    def _automaton(self) -> ahocorasick.Automaton:
        return _automaton(self._words)

    def held(self, text: str) -> set[str]:
        """The keywords that a text holds."""
        if not self._words:
            return set()
        found: set[int] = set()
        for _, i in self._automaton.iter(text.lower()):
            found.add(i)
            if len(found) == len(self._words):
                break
        return {self._words[i] for i in found}

    def find(self, texts: pa.Array, paths: pa.Array) -> list[tuple[int, str, int, int, str, str, int, float]]:
        """(row, rule_id, start, stop, secret, matched, number of the line in which the match begins, entropy) of all findings, by row, then rule."""
        texts = texts.cast(pa.string())
        own = texts.to_pylist()
        held = [self.held(t) if t is not None else set() for t in own]
        marked = texts
        for sign in (OPEN, GROUP, SHUT):
            marked = pc.replace_substring(marked, sign, OTHER)
        skip = {i for a in self.allowlists if a.paths and not a.every for i, x in enumerate(_any(paths, a.paths)) if x}
        out = []
        for place, rule in enumerate(self.rules):
            words = {w.lower() for w in rule.keywords}
            rows = [i for i, t in enumerate(own) if t is not None and i not in skip and (not words or words & held[i])]
            if rule.path is not None:
                fits = _any(paths, (rule.path,))
                rows = [i for i in rows if fits[i]]
            if rows:
                out += [(i, place, *f) for i, *f in self._judged(rule, rows, self._matches(rule, rows, own, marked), own, paths)]
        out.sort(key=lambda f: (f[0], f[1], f[2]))
        return [(i, self.rules[place].id, *f) for i, place, *f in out]

    @staticmethod
    def _matches(rule: Rule, rows: list[int], own: list[str], marked: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(row, start and stop of a match, start and stop of its secret) in characters."""
        if rule.regex is None:
            return [(i, 0, 0, 0, 0) for i in rows]
        some = marked.take(pa.array(rows, pa.int64()))
        hits = pc.match_substring_regex(some, rule.regex).to_pylist()
        rows = [i for i, hit in zip(rows, hits) if hit]
        if not rows:
            return []
        by = OPEN + r"\0" + "".join(f"{GROUP}\\{g}" for g in range(1, rule.groups + 1)) + SHUT
        out = []
        for i, text in zip(rows, pc.replace_substring_regex(some.filter(pa.array(hits)), rule.regex, by).to_pylist()):
            first, *pieces = text.split(OPEN)
            at = len(first)
            for piece in pieces:
                inner, _, rest = piece.partition(SHUT)
                match, *groups = inner.split(GROUP)
                secret = groups[rule.group - 1] if rule.group else next((g for g in groups if g), match)
                if match and secret:
                    begin = at + match.find(secret)
                    out.append((i, at, at + len(match), begin, begin + len(secret)))
                at += len(match) + len(rest)
        return out

    def _judged(self, rule: Rule, rows: list[int], places: list[tuple[int, int, int, int, int]], own: list[str], paths: pa.Array) -> list[tuple]:
        found, lines = [], []
        row, at, number, begin, end = None, 0, 1, 0, -1
        for i, a, b, start, stop in places:
            text = own[i]
            if i != row:
                row, at, number, begin, end = i, 0, 1, 0, -1
            number, begin, at = number + text.count("\n", at, a), max(begin, text.rfind("\n", at, a) + 1), a
            if end < b:
                end = text.find("\n", b)
                end = len(text) if end < 0 else end
            secret = text[start:stop]
            h = entropy(secret)
            if not rule.entropy or h > rule.entropy:
                found.append((i, start, stop, secret, text[a:b], number, h))
                lines.append((i, begin, end))
        if not found:
            return []
        secrets, matches = (pa.array([f[k] for f in found], pa.string()) for k in (3, 4))
        where = paths.take(pa.array([f[0] for f in found], pa.int64()))
        let_be = [False] * len(found)
        for allowlist in (*self.allowlists, *rule.allowlists):
            let_be = [x or y for x, y in zip(let_be, allowlist.allows(secrets, matches, lines, own, where))]
        return [f for f, x in zip(found, let_be) if not x]


_RULE_KEYS = {"id", "description", "regex", "path", "entropy", "keywords", "secretGroup", "allowlists", "tags"}
_ALLOW_KEYS = {"description", "regexes", "stopwords", "paths", "regexTarget", "condition", "targetRules"}


def _known(table: dict, keys: set[str], where: str) -> dict:
    if unknown := set(table) - keys:
        raise MaskError(f"{where}: {', '.join(sorted(unknown))} is not known")
    return table


def _allowlist(table: dict, where: str) -> RuleAllowlist:
    _known(table, _ALLOW_KEYS, where)
    condition = str(table.get("condition", "OR")).upper()
    if condition not in ("OR", "||", "AND", "&&"):
        raise MaskError(f"{where}: condition is OR or AND, not {condition!r}")
    try:
        lists = {k: tuple(map(str, table.get(k, ()))) for k in ("regexes", "stopwords", "paths")}
        return RuleAllowlist(**lists, target=table.get("regexTarget", "secret") or "secret", every=condition in ("AND", "&&"))
    except MaskError as e:
        raise MaskError(f"{where}: {e}") from e


def from_toml(text: str) -> RulePack:
    """A pack from the text of its file. Unknown keys, patterns that can't be read and repeated ids are errors that name the rule."""
    try:
        tree = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise MaskError(f"rule pack: {e}") from e
    _known(tree, {"title", "description", "minVersion", "allowlist", "allowlists", "rules"}, "rule pack")
    shared = [tree["allowlist"]] if "allowlist" in tree else []
    shared += tree.get("allowlists", [])
    aimed: dict[str, list[RuleAllowlist]] = {}
    everywhere = []
    for i, table in enumerate(shared):
        one = _allowlist(table, f"allowlist {i + 1}")
        for target in table.get("targetRules", ()):
            aimed.setdefault(target, []).append(one)
        if not table.get("targetRules"):
            everywhere.append(one)
    rules = []
    for i, table in enumerate(tree.get("rules", [])):
        where = f"rule {table.get('id', i + 1)}"
        _known(table, _RULE_KEYS, where)
        own = [_allowlist(a, where) for a in table.get("allowlists", [])] + aimed.pop(table.get("id"), [])
        rules.append(
            Rule(table.get("id", ""), table.get("regex"), tuple(map(str, table.get("keywords", ()))), float(table.get("entropy", 0)), int(table.get("secretGroup", 0)), table.get("path"), tuple(own))
        )
    if aimed:
        raise MaskError(f"allowlists aim at rules that aren't there: {', '.join(sorted(aimed))}")
    return RulePack(tuple(rules), tuple(everywhere))


def load(spark: SparkSession, path: str) -> RulePack:
    """A pack from a file wherever Spark can read one."""
    rows = spark.read.text(path, wholetext=True).collect()
    if len(rows) != 1:
        raise MaskError(f"rule pack: {path} is not one file")
    return from_toml(rows[0].value)


def findings(df: DataFrame, key: str, text_col: str, pack: RulePack, path_col: str | None = None) -> DataFrame:
    """key, place (the number of a finding within its row and rule) and the columns of a finding, one row each.

    Places count characters of the text; secret is the rule's group, else the first group that holds something,
    else the match. A null text has no findings; a null path matches nothing. Rows are told by key, which
    may repeat. Texts are taken about a megabyte at a time, so memory doesn't grow with the table. A very long text is searched whole, by one task, in time linear in its length.
    """
    kind = df.schema[key].dataType.simpleString()
    path = F.lit(None).cast("string") if path_col is None else F.col(path_col).cast("string")
    names = ["rule_id", "start", "stop", "secret", "matched", "line", "entropy"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = pack.find(batch.column(1), batch.column(2).cast(pa.string()))
            places, last, n = [], None, 0
            for f in found:
                n = n + 1 if (f[0], f[1]) == last else 0
                last = (f[0], f[1])
                places.append(n)
            keys = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
            columns = [pa.array([f[k + 1] for f in found], t) for k, t in enumerate(types)]
            yield pa.record_batch([keys, pa.array(places, pa.int32()), *columns], ["key", "place", *names])

    bounded_batches(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(text_col).cast("string").alias("text"), path.alias("path"))
    return rows.mapInArrow(run, f"key {kind}, place int, {FINDING}").withColumnRenamed("key", key)
