from __future__ import annotations

import pickle
import random
import re

import pyarrow as pa
import pytest
from cloakframe import tables
from cloakframe.errors import MaskError
from cloakframe.functions.local import entropy
from cloakframe.operators import rules
from cloakframe.plans import fixtures as X

WORDS = ["token", 'token = "', "0123456789abcdef" * 2, '"', "dora.7@mail3.example.com", "theo.1@mail1.example.com", "+1 (212) 555-0100", "+1 (331) 555-0100", "4" * 16, "4929384756102938", "10.2.0.9", "8.8.8.8"]
WORDS += ["License", "licence text", "antidisestablishmentarianism", "Xylophoneaaaaaaaaaaaaa", "| 42 |", "pipe=abc", "SHOUT!!", "WHAT??", "the", "é", "日本", "\n", "\x01", "\x02\x03", "feed5eed", " ", ", "]


def plain(pack, text, path):
    """All rules by Python's own patterns, one after the other."""
    out = []
    text_low = text.lower()
    for a in pack.allowlists:
        if a.paths and not a.every and path is not None and any(re.search(p, path) for p in a.paths):
            return []
    for r in pack.rules:
        if (r.keywords and not any(w.lower() in text_low for w in r.keywords)) or (r.path is not None and (path is None or not re.search(r.path, path))):
            continue
        place = 0
        pattern = (r.regex or r"\A").replace("[[:alpha:]]", "[a-zA-Z]")
        for m in re.finditer(pattern, text, re.A):
            secret = m[r.group] if r.group else next((g for g in m.groups() if g), m[0])
            if r.regex is not None and not secret:
                continue
            h = entropy(secret)
            if r.entropy and h <= r.entropy:
                continue
            line = text[text.rfind("\n", 0, m.start()) + 1 : (text.find("\n", m.end()) + 1 or len(text) + 1) - 1]
            target = {"secret": secret, "match": m[0], "line": line}

            def allows(a):
                checks = [any(re.search(p, target[a.target]) for p in a.regexes)] if a.regexes else []
                checks += [any(w.lower() in secret.lower() for w in a.stopwords)] if a.stopwords else []
                checks += [path is not None and any(re.search(p, path) for p in a.paths)] if a.paths else []
                return all(checks) if a.every else any(checks)

            if any(map(allows, (*pack.allowlists, *r.allowlists))):
                continue
            start = m.start() + m[0].find(secret)
            out.append((r.id, place, start, start + len(secret), secret, m[0], text.count("\n", 0, m.start()) + 1, round(h, 9)))
            place += 1
    return out


def rows_of(seed, n):
    rng = random.Random(seed)
    paths = [None, "", "/a/en/x.html", "https://h.example/en/1#top", "https://h.example/de/2?utm_source=feed"]
    return [(i // 2 if i % 7 else None, "".join(rng.choice(WORDS) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 30))), rng.choice(paths)) for i in range(n)]


@pytest.mark.parametrize("name", ["DOCUMENT_RULES", "PAGE_RULES"])
def test_packs_match_plain_patterns(spark, name):
    pack = rules.from_toml(getattr(X, name))
    rows = rows_of(3, 300) + [(900, None, "x"), (901, "", "utm_source=feed"), (902, '<html lang="de"\n<title>A long title</title>\n<a href="/nothing">', "https://h.example/en/9")]
    rows += [(903, 'href="/over" ' * 30_000 + 'token = "0123456789abcdef0123456789abcdef"', "https://h.example/fr/9")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "k long, text string, path string, secret string, place int").repartition(4)
    got = rules.findings(df, "k", "text", pack, "path").collect()
    got = sorted(((r.k, r.rule_id, r.place, r.start, r.stop, r.secret, r.matched, r.line, round(r.entropy, 9)) for r in got), key=str)
    want = sorted(((k, *f) for k, t, p in rows if t is not None for f in plain(pack, t, p)), key=str)
    assert got == want and len({r[1] for r in got}) >= 3


def test_lines_and_their_allowlist():
    pack = rules.from_toml("""
[[rules]]
id = "n"
regex = 'n=([0-9]+)'
[[rules.allowlists]]
regexTarget = "line"
regexes = ['^#', 'sample$']
""")
    text = "# n=1\nx n=2 y\nn=3 sample\nn=4"
    got = pack.find(pa.array([text, None]), pa.array([None, None], pa.string()))
    assert [(f[4], f[6]) for f in got] == [("2", 2), ("4", 4)]


def test_a_text_is_only_searched_for_rules_whose_keyword_it_holds(monkeypatch):
    pack = rules.from_toml(X.DOCUMENT_RULES)
    asked = []
    plain_matches = rules.RulePack._matches
    monkeypatch.setattr(rules.RulePack, "_matches", staticmethod(lambda rule, rows, own, marked: asked.append((rule.id, rows)) or plain_matches(rule, rows, own, marked)))
    pack.find(pa.array(["a TOKEN", "nothing", "555-1234"]), pa.array([None] * 3, pa.string()))
    asked = dict(asked)
    assert asked["assigned-token"] == [0] and asked["line-number"] == [2] and "mailbox" not in asked and "no-such-word" not in asked
    assert asked["long-number"] == [0, 1, 2]  # no keywords: every text
    again = pickle.loads(pickle.dumps(pack))
    assert again == pack and again.held("a TOKEN") == {"token"}


@pytest.mark.parametrize("pattern,groups", [(r"a(b)(?:c)(?P<d>e)(?i)\((?i:x)[(]", 2), (r"[^](]()", 1), (r"\Q(((\E(x)", 1), (r"[[:alpha:](]+([\](])", 1), ("", 0)])
def test_groups_are_counted(pattern, groups):
    assert rules.groups_of(pattern) == groups


@pytest.mark.parametrize(
    "bad",
    [
        "x = [", 'colour = "red"', "[[rules]]\nregex = 'a'", "[[rules]]\nid = 'a'", "[[rules]]\nid = 'a'\nregex = '('", "[[rules]]\nid = 'a'\nregex = 'a'\nsecretGroup = 1",
        "[[rules]]\nid = 'a'\nregex = 'a'\n[[rules]]\nid = 'a'\nregex = 'b'", "[[rules]]\nid = 'a'\nregex = 'a'\nkind = 1", "[[rules]]\nid = 'a'\nregex = 'a'\n[[rules.allowlists]]\ndescription = 'none'",
        "[[rules]]\nid = 'a'\nregex = 'a'\n[[rules.allowlists]]\nregexes = ['a']\ncondition = 'XOR'", "[[rules]]\nid = 'a'\nregex = 'a'\n[[rules.allowlists]]\nregexes = ['a']\nregexTarget = 'file'",
        "[[allowlists]]\nregexes = ['a']\ntargetRules = ['none']",
    ],
)
def test_packs_that_cannot_be_meant(bad):
    with pytest.raises(MaskError):
        rules.from_toml(bad)


def test_a_pack_from_a_file(spark, tmp_path):
    (tmp_path / "pack.toml").write_text(X.PAGE_RULES)
    assert rules.load(spark, f"file://{tmp_path}/pack.toml") == rules.from_toml(X.PAGE_RULES)


def test_texts_are_taken_a_few_at_a_time():
    batch = pa.record_batch([pa.array(range(50)), pa.array(["x" * 100_000] * 50)], ["key", "text"])
    parts = list(tables.slices(iter([batch]), 1 << 20))
    assert max(p.num_rows for p in parts) == 10 and [k for p in parts for k in p.column(0).to_pylist()] == list(range(50))
    assert [p.num_rows for p in tables.slices(iter([batch]), 1)] == [1] * 50 and list(tables.slices(iter([batch.slice(0, 0)]))) == []
