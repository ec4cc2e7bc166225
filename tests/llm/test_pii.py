from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

from cloakframe.llm import pii
from cloakframe.llm.queries import QUERIES
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, kind string, base string, value int"

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits(text):
    return re.sub("[^0-9]", "", text)


def plain_base(text):
    text = text or ""
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return out


def run(spark, rows, **scoring):
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA).repartition(3)
    got = pii.personal_data(df, **scoring).select("doc_id", pii.written("base").alias("b"), pii.written("spans").alias("s")).collect()
    return sorted(((r.doc_id, r.b, r.s) for r in got), key=str)


def told(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_base_matches_brute_force(spark):
    rng = random.Random(5)
    bits = [
        "a.b@c.de", "x@y", "a@b.c_d@e.f", "@", "a@b..c", "1.2.3.4", "256.1.1.1", "01.002.3.255", "1.2.3.4.5.6.7.8", "9" * 30, "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112",
        "+1 (555) 010-9999", "+1-2", "+49 30 1234567 89", "++12 345 6789 )", "é", "日本", " ", "\n", "\x01", "\x02", "tel:", "-", ".", "%", "word", "5", "12 34 56 78 90 12 34 56",
    ]
    rows = [(i, "".join(rng.choice(bits) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    rows += [(None, None), (None, "mail a@b.cd"), (None, "mail a@b.cd"), (7, "again a@b.cd"), (8, ""), (9, "x@y." * 20000), (10, "1 " * 50000), (11, "a" * 100000 + "@"), (12, "+1 555 0109 999 x" * 5000)]
    got = run(spark, rows, rounds=1)
    assert [(i, b) for i, b, _ in got] == sorted(((i, told(plain_base(t))) for i, t in rows), key=lambda x: str((x[0], x[1])))
    assert all(not b or s.startswith(b.split(",")[0]) or b in s for _, b, s in got)


def test_empty_table(spark):
    assert run(spark, [], rounds=1) == []


UNIT = re.compile(r"[^\W\d_]+[:=#-]?")


def plain_contexts(before):
    near = before[-64:].lower()
    if not re.search(r"[^\W\d_][:=#-]?[ \t\r\n:=#(\"'<\[-]{0,3}$", near):
        return []
    words = UNIT.findall(near if len(before) < 64 else re.sub(r"^[^\W\d_]+", "", near))
    return words[-1:] + ([" ".join(words[-2:])] if len(words) > 1 else [])


def plain_found(rows, support=3, confident=0.5, worthy=0.7, rounds=4):
    """Numbers only: what the graph finds, by loops over everything."""
    number = re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ ().-]{0,2}[0-9])+(?![A-Za-z])")
    edges, loose, totals = defaultdict(Counter), [], Counter()
    for i, text in rows:
        base = plain_base(text)
        for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
            last = 0
            for m in pattern.finditer(text):
                if (kind, m.start(), m.end()) in base:
                    for c in plain_contexts(text[last : m.start()]):
                        edges[kind, c][m[0].lower(), True] += 1
                last = m.end()
        last = 0
        for m in number.finditer(text):
            n = len(digits(m[0]))
            before, last = text[last : m.start()], m.end()
            if any(a < m.end() and m.start() < b for _, a, b in base):
                continue
            for kind in ["card"] * (12 <= n <= 19) + ["phone"] * (7 <= n <= 15):
                loose.append((i, kind, m.start(), m.end(), m[0].lower()))
                for c in plain_contexts(before):
                    edges[kind, c][m[0].lower(), False] += 1
        units = UNIT.findall(text.lower())
        totals.update(units)
        totals.update(" ".join(units[j : j + 2]) for j in range(len(units) - 1))
    worth = {}
    for _ in range(rounds):
        left = defaultdict(lambda: 1.0)
        for (kind, c), values in edges.items():
            of = {v: 1.0 if seed else worth.get((kind, v[0] if isinstance(v, tuple) else v), 0.0) for (v, seed) in values}
            good = sum(n * of[v] for (v, _), n in values.items())
            if len(of) >= support and sum(x >= worthy for x in of.values()) >= support and good / (totals[c] + 1) >= confident:
                for v, seed in values:
                    if not seed:
                        left[kind, v] *= 1 - good / (totals[c] + 1)
        worth = {k: 1 - x for k, x in left.items()}
    best = {}
    for i, kind, a, b, v in loose:
        w = worth.get((kind, v), 0)
        if w >= worthy:
            best[i, a] = max(best.get((i, a), (0,)), (w, kind == "card", kind, b))
    out = {}
    for i, text in rows:
        spans = plain_base(text) + [(k, a, b) for (j, a), (_, _, k, b) in best.items() if j == i]
        out[i] = told(sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1])))
    return out


def test_patterns_find_unseen_numbers(spark):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "bdfgklmn" for b in ("a", "e", "io", "um")]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    rows = []
    for i in range(60):
        rows.append((i, f"{prose(8)} my mobile: +1 555 01{i:02d} 99{i:02d} {prose(5)}"))
    rows += [(100 + i, f"{prose(6)} my mobile: 0{rng.randrange(10**8, 10**9)} {prose(3)}, call back 0{rng.randrange(10**8, 10**9)}") for i in range(12)]
    same = [f"0{rng.randrange(10**8, 10**9)}" for _ in range(8)]
    rows += [(200 + i, f"the mobile: {x} and {prose(4)} reachbackline {x} {prose(2)}") for i, x in enumerate(same)]
    rows += [(300, f"reachbackline 0{rng.randrange(10**8, 10**9)} {prose(3)}")]  # before no seed: learnt from what was found
    rows += [(400 + i, f"{prose(9)} invoice 0{rng.randrange(10**8, 10**9)} {prose(9)}") for i in range(30)]
    got = {i: s for i, _, s in run(spark, rows)}
    want = plain_found(rows)
    assert got == want
    assert got[100].count("phone") == 1 and got[200].count("phone") == 2 and got[300].count("phone") == 1 and not any(got[400 + i] for i in range(30))


def test_many_patterns_are_counted_before_they_meet(spark, monkeypatch):
    texts = [f"my mobile: +1 555 01{i:02d} 99{i:02d} end" for i in range(20)] + ["my mobile: 0301234567"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    patterns = spark.createDataFrame([("mobile:",), ("my mobile:",), ("end",), ("never",)], "pattern string")
    few = sorted(map(tuple, pii._totals(docs, patterns, "text").collect()))
    monkeypatch.setattr(pii, "MOST_BROADCAST", 0)
    assert few == sorted(map(tuple, pii._totals(docs, patterns, "text").collect())) == [("end", 20), ("mobile:", 21), ("my mobile:", 21)]


def test_main_path_runs_no_python(spark):
    df = spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string")
    plan = pii.entities(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert pii.entities(df).select(F.size("base")).first()[0] == 1


def test_query_counts_each_kind_apart(spark, tmp_path):
    texts = ["a@b.cd", "1.2.3.4 and 5.6.7.8", "4111 1111 1111 1111", "+1 (555) 010-9999 x@y.zz +49 30 1234567", "none", None, "a@b.cd 1.2.3.4 c@d.ef 4111111111111111 +49 30 1234567 g@h.ij"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:6] for r in QUERIES["op11_personal_data"](spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        base = plain_base(text)
        n = Counter(kind for kind, _, _ in base)
        assert got[i] == (*(n[k] for k in pii.KINDS), hashlib.sha256(told(base).encode()).hexdigest())
