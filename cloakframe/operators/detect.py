"""Detection: columns of findings, without Python on the executors.

A detector marks its values in a copy of the text with control characters; splitting
at the marks gives places and values. Findings of all enabled detectors of a text are
one array, so a text is scanned in one projection and never joined with itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PREFIX, Allowlist, Detection
from ..functions import scalars as S
from ..tables import written
from ..vocabulary import CARD_HINTS, DELIMITERS, PASSWORD_LABEL, POLICY, QUOTE, SEPARATOR

OPEN, SHUT, OTHER = "\x01", "\x02", "\x03"
FINDING = (
    "struct<start:int,stop:int,secret:string,rule_id:string,kind:string,subtype:string,policy:string,source:string,confidence:string,score:int,entropy:double>"
)


@dataclass(frozen=True)
class Detector:
    """before, value and after are patterns that Java and Python read alike; only value is the finding."""

    rule_id: str
    kind: str
    subtype: str
    confidence: str
    score: int
    before: str
    value: str
    after: str
    valid: Callable[[Column], Column]
    #: What a text must have for a match, told faster than by the patterns; it never changes the findings.
    hint: Callable[[Column], Column] = lambda text: F.lit(True)


def _bytes(value: Column) -> Column:
    return F.octet_length(value)


def _password(value: Column) -> Column:
    trimmed = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    return _bytes(trimmed).between(4, 128) & ~F.lower(trimmed).isin("password", "passwd", "hunter2")


def _email(value: Column) -> Column:
    low = F.lower(value)
    return ~low.rlike(r"\.(?:png|jpg|svg)$|example\.com|email@example")


def _phone(value: Column) -> Column:
    number = S.digits(value)
    return F.length(number).between(10, 15) & ~S.one_digit_only(number) & value.rlike(r"[ (\-]|^\+")


def _labeled_id(value: Column) -> Column:
    return _bytes(value).between(6, 20) & value.rlike("[0-9]")


def _passport(value: Column) -> Column:
    return _bytes(value).between(6, 12) & value.rlike("[0-9]")


def _card(value: Column) -> Column:
    number = S.digits(value)
    return F.length(number).between(13, 19) & ~S.one_digit_only(number) & S.luhn(number)


def _cvv(value: Column) -> Column:
    return _bytes(value).isin(3, 4) & ~value.rlike("^0+$")


#: Rule ids, patterns and scores. switch -> detectors.
CATALOGUE: dict[str, tuple[Detector, ...]] = {
    "passwords": (
        Detector("typed.password.labeled", "password", "labeled", "high", 92, PASSWORD_LABEL + SEPARATOR + QUOTE, "[^\"'`\\r\\n]{4,128}", f"(?={QUOTE})", _password),
        Detector("typed.password.labeled", "password", "labeled", "high", 90, PASSWORD_LABEL + SEPARATOR, r"""[^\s,;}\]'"`]{4,128}""", "", _password),
        Detector("typed.password.dsn", "password", "dsn_userinfo", "high", 95, r"\b[A-Za-z][A-Za-z0-9+.\-]{1,20}://[^/\s:@]{1,64}:", r"[^@\s/]{4,128}", "(?=@)", _password, lambda t: t.contains("://") & t.contains("@")),
    ),
    "emails": (Detector("typed.email", "email", "email_address", "high", 90, "", r"\b[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24}\b", "", _email, lambda t: t.contains("@")),),
    "phones": (Detector("typed.phone", "phone", "phone_number", "low", 55, "", r"\b\+?\d[\d .()\-/]{7,}\d\b", "", _phone, lambda t: t.rlike(r"(?U)\d[\d .()\-/]{7}")),),
    "national_ids": (
        Detector("typed.id.ssn", "national_id", "us_ssn", "high", 94, "", r"\b\d{3}-\d{2}-\d{4}\b", "", lambda v: ~v.isin("000-00-0000", "123-45-6789"), lambda t: t.rlike(r"(?U)\d-\d\d-\d")),
        Detector("typed.id.labeled", "national_id", "labeled_id", "low", 58, r"\b(?i:ssn|social security|national id|tax id|government id|nin)\b" + SEPARATOR + QUOTE + "?", r"[A-Za-z0-9\-]{6,20}", "", _labeled_id),
    ),
    "passports": (Detector("typed.passport", "passport", "passport_number", "low", 58, r"\b(?i:passport(?:\s+(?:number|no|\#))?)\b" + SEPARATOR + QUOTE + "?", "[A-Za-z0-9]{6,12}", "", _passport),),
    "payment_cards": (Detector("typed.card.pan", "payment_card", "pan", "high", 96, "", r"\b(?:\d[ -]?){13,19}\b", "", _card, lambda t: t.rlike(r"(?U)(?:\d[ -]?){13}")),),
    "cvv": (Detector("typed.card.cvv", "cvv", "card_cvv", "low", 56, r"\b(?i:cvv|cvc|cvn|security code)\b" + SEPARATOR + QUOTE + "?", r"\d{3,4}", "", _cvv),),
}
OPAQUE_RULE = "opaque.high_entropy"


def _places(text: Column, pattern: str, hint: Column | None = None) -> Column:
    """array<struct<start, stop>> of what the pattern's second group matches; places are in characters from 0. Texts without the hint have none."""
    clean = F.when(text.contains(OPEN) | text.contains(SHUT), F.translate(text, OPEN + SHUT, OTHER * 2)).otherwise(text)
    marked = F.regexp_replace(clean, pattern, f"$1{OPEN}$2{SHUT}")

    def walk(whole: Column) -> Column:
        return F.when(F.contains(whole, F.lit(OPEN)), S.let(F.split(whole, OPEN, -1), summed))

    def summed(parts: Column) -> Column:
        first = F.struct(F.length(F.element_at(parts, 1)).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("found"))

        def step(so_far: Column, piece: Column) -> Column:
            size = F.instr(piece, F.lit(SHUT)) - 1
            one = F.struct(so_far["at"].alias("start"), (so_far["at"] + size).alias("stop"))
            return F.struct((so_far["at"] + F.length(piece) - 1).alias("at"), F.array_append(so_far["found"], one).alias("found"))

        return F.aggregate(F.slice(parts, 2, F.size(parts)), first, step, lambda end: end["found"])

    found = S.let(marked, walk)
    return F.coalesce(found if hint is None else F.when(hint, found), F.array().cast("array<struct<start:int,stop:int>>"))


def _value(text: Column, place: Column) -> Column:
    return F.substring(text, place["start"] + 1, place["stop"] - place["start"])


def _finding(place: Column, secret: Column, rule: str, kind: str, subtype: Column, source: str, confidence: Column, score: Column, entropy: Column) -> Column:
    return F.struct(
        place["start"].alias("start"), place["stop"].alias("stop"), secret.alias("secret"), F.lit(rule).alias("rule_id"), F.lit(kind).alias("kind"), subtype.alias("subtype"),
        F.lit(POLICY).alias("policy"), F.lit(source).alias("source"), confidence.alias("confidence"), score.cast("int").alias("score"), entropy.alias("entropy"),
    )


def typed_findings(text: Column, detector: Detector) -> Column:
    pattern = f"(?U)({detector.before})({detector.value}){detector.after}"

    def one(place: Column) -> Column:
        def of(secret: Column) -> Column:
            subtype = S.card_issuer(S.digits(secret)) if detector.kind == "payment_card" else F.lit(detector.subtype)
            return _finding(place, secret, detector.rule_id, detector.kind, subtype, "heuristic", F.lit(detector.confidence), F.lit(detector.score), F.lit(None).cast("double"))

        return S.let(_value(text, place), of)

    return F.filter(F.transform(_places(text, pattern, detector.hint(text)), one), lambda f: detector.valid(f["secret"]))


def _hides_placeholder(token: Column, prefix: str) -> Column:
    plain = F.translate(token, "-_", "+/")
    decoded = F.when(F.octet_length(token) >= 24, F.try_to_binary(plain, F.lit("base64")).cast("string"))
    return F.contains(token, F.lit(prefix + "_")) | F.coalesce(F.contains(decoded, F.lit("{{" + prefix + "_")), F.lit(False))


def long_token_pattern(min_bytes: int) -> str:
    """Whole tokens that may have so many bytes: so many characters, or half, or a quarter, with characters of two, or more, bytes.

    Most words of a text end here, before anything is built for them.
    """
    token = f"[^{re.escape(DELIMITERS)}]"
    two, four = (max(1, -(-min_bytes // n)) for n in (2, 4))
    start = f"(?<!{token})"
    wide = rf"(?={token}*[^\x00-\x7F]){token}{{{two},}}|(?={token}*[^\x00-\u07FF]){token}{{{four},}}"
    return f"(){start}({token}{{{max(1, min_bytes)},}}|{wide})"


def may_hold_long_token(text: Column, min_bytes: int) -> Column:
    """Whether a text has a token of so many characters, by one pass over it, or has wide characters at all."""
    stop = re.escape(DELIMITERS)
    short = rf"[^{stop}]{{1,{min_bytes - 1}}}+"
    return ~text.rlike(rf"\A[{stop}]*+(?:{short}[{stop}]++)*+(?:{short})?+\z") | (F.octet_length(text) != F.length(text))


def opaque_findings(text: Column, cfg: Detection, prefix: str) -> Column:
    """High-entropy tokens."""
    pattern = long_token_pattern(cfg.entropy_min_len)
    longest = F.filter(_places(text, pattern, may_hold_long_token(text, cfg.entropy_min_len) if cfg.entropy_min_len > 1 else None), lambda p: (F.octet_length(_value(text, p)) >= cfg.entropy_min_len) & ~_value(text, p).rlike("^[a-z]*$"))

    def one(place: Column) -> Column:
        def of(secret: Column) -> Column:
            def scored(h: Column) -> Column:
                score = F.when(h >= cfg.entropy_threshold + 1.0, 92).when(h >= cfg.entropy_threshold + 0.5, 84).otherwise(72)
                return _finding(place, secret, OPAQUE_RULE, "opaque_token", F.lit("high_entropy"), "entropy", F.when(score >= 80, "high").otherwise("medium"), score, h)

            return S.let(S.entropy(secret), scored)

        return S.let(_value(text, place), of)

    return F.filter(F.transform(longest, one), lambda f: (f["entropy"] >= cfg.entropy_threshold) & ~_hides_placeholder(f["secret"], prefix))


def best_of_overlaps(findings: Column) -> Column:
    """Findings in order of place; of overlapping ones the higher score stays, then the longer.

    A candidate is compared with the one kept last only.
    """
    size = lambda f: F.octet_length(f["secret"])
    keyed = F.transform(findings, lambda f: F.struct(f["start"].alias("a"), (-f["score"]).alias("b"), (-size(f)).alias("c"), f["rule_id"].alias("d"), f.alias("f")))
    ordered = F.transform(F.array_sort(keyed), lambda k: k["f"])

    def step(kept: Column, f: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        apart = last.isNull() | (f["start"] >= last["stop"]) | (f["stop"] <= last["start"])
        better = (f["score"] > last["score"]) | ((f["score"] == last["score"]) & (size(f) > size(last)))
        return F.when(apart, F.array_append(kept, f)).when(better, F.array_append(F.slice(kept, F.lit(1), F.size(kept) - 1), f)).otherwise(kept)

    return F.when(F.size(findings) < 2, findings).otherwise(F.aggregate(ordered, F.array().cast(f"array<{FINDING}>"), step))


def allowed(finding: Column, allowlist: Allowlist) -> Column:
    """Whether a finding is on the allowlist, by its rule, a pattern found in its value, or the value's hash."""
    out = F.lit(False)
    if allowlist.rule_ids:
        out = out | F.lower(F.trim(finding["rule_id"])).isin(*allowlist.rule_ids)
    for pattern in allowlist.patterns:
        out = out | finding["secret"].rlike(pattern)
    if allowlist.secret_sha256:
        out = out | S.sha256(finding["secret"]).isin(*allowlist.secret_sha256)
    return out


#: Bits of the filter for each allowed hash, and how many of them each sets: about one other value in a hundred passes.
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: The filter is broadcast, so it is no larger than this whatever the table holds; past it more values pass, and the join decides.
MOST_BLOOM_WORDS = 1 << 20


def _bloom_bits(hash_: Column, words: int) -> Column:
    """The bits of a hash: two halves, stepped through."""
    a, b = (F.pmod(F.xxhash64(hash_, F.lit(seed)), F.lit(1 << 40)) for seed in (0, 1))
    return F.transform(F.sequence(F.lit(0), F.lit(BLOOM_HASHES - 1)), lambda i: F.pmod(a + i * b, F.lit(words * 64).cast("long")))


def without_allowed(found: DataFrame, allowed: DataFrame, secret_col: str = "secret", hash_col: str = "sha256") -> DataFrame:
    """found (a row for each finding) without those whose secret's SHA-256 stands in the table allowed, which may hold any number.

    A Bloom filter of the table, an array of at most 8 MB, goes to all tasks. What it doesn't know stays without
    a shuffle; the rest, nearly all of it allowed, is joined with the table. Hashes may be repeated, in capitals or null.
    """
    hashes = allowed.select(F.lower(F.trim(hash_col)).alias("hash")).where("hash is not null").distinct()
    n = hashes.count()
    words = max(1, min(MOST_BLOOM_WORDS, -(-n * BLOOM_BITS // 64)))
    bits = hashes.select(F.explode(_bloom_bits(F.col("hash"), words)).alias("bit"))
    filled = bits.groupBy(F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("set"))
    whole = found.sparkSession.range(words).select(F.col("id").cast("int").alias("word")).join(filled, "word", "left")
    pairs = F.array_sort(F.collect_list(F.struct("word", F.coalesce("set", F.lit(0).cast("long")).alias("set"))))
    bloom = whole.agg(F.transform(pairs, lambda x: x["set"]).alias("_bloom"))  # a single row
    rows = once(found.crossJoin(F.broadcast(bloom)), "_hash", S.sha256(F.col(secret_col)))
    known = F.forall(_bloom_bits(F.col("_hash"), words), lambda b: F.getbit(F.get("_bloom", F.floor(b / 64).cast("int")), (b % 64).cast("int")) == 1)
    told = once(rows, "_known", F.coalesce(known, F.lit(False))).drop("_bloom")
    asked = told.where("_known").join(hashes, F.col("_hash") == F.col("hash"), "left_anti")
    return told.where("not _known").unionByName(asked).drop("_hash", "_known")


def with_byte_places(findings: Column, text: Column) -> Column:
    """findings, in order of place, each with start_byte and stop_byte in the UTF-8 text.

    Only the stretches between marks are measured, each once, and added up; a text of one byte a character is not looked at again.
    """
    add = lambda a, b: a + b

    def placed(widths: Column) -> Column:
        def one(f: Column, i: Column) -> Column:
            start = F.aggregate(F.slice(widths, F.lit(1), i + 1), F.lit(0), lambda a, w: a + w["gap"]) + F.aggregate(F.slice(widths, F.lit(1), i), F.lit(0), lambda a, w: a + w["own"])
            return S.let(start, lambda s: f.withField("start_byte", s).withField("stop_byte", s + F.get(widths, i)["own"]))

        return F.transform(findings, one)

    def width(f: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(0)).otherwise(F.get(findings, i - 1)["stop"])
        gap = F.octet_length(F.substring(text, before + 1, f["start"] - before))
        return F.struct(gap.alias("gap"), F.octet_length(f["secret"]).alias("own"))

    plain = F.transform(findings, lambda f: f.withField("start_byte", f["start"]).withField("stop_byte", f["stop"]))
    return F.when(F.octet_length(text) == F.length(text), plain).otherwise(S.let(F.transform(findings, width), placed))


def typed(text: Column, cfg: Detection) -> Column:
    """Findings of the enabled typed detectors, overlaps resolved; codes of cards only near a card."""
    none = F.array().cast(f"array<{FINDING}>")
    found = {switch: [typed_findings(text, d) for d in detectors] for switch, detectors in CATALOGUE.items() if getattr(cfg, switch)}
    if not found:
        return none
    near_card = F.lower(text).rlike("|".join(CARD_HINTS))
    if "cvv" in found:
        cards = found.get("payment_cards", [none])[0]
        found["cvv"] = [F.when(near_card | (F.size(cards) > 0), c).otherwise(none) for c in found["cvv"]]
    columns = [c for some in found.values() for c in some]
    return S.let(F.concat(none, *columns), best_of_overlaps)


def findings(text: Column, cfg: Detection, allowlist: Allowlist | None = None, prefix: str = PREFIX) -> Column:
    """array of FINDING for a text column: typed, then opaque, then the allowlist. A null text has none.

    The allowlist comes last: an allowed finding still hides what it overlaps.
    """
    none = F.array().cast(f"array<{FINDING}>")
    parts = [typed(text, cfg)]
    if cfg.entropy:
        parts.append(opaque_findings(text, cfg, prefix))
    whole = S.let(F.concat(none, *parts), best_of_overlaps)
    if allowlist and (allowlist.rule_ids or allowlist.patterns or allowlist.secret_sha256):
        whole = F.filter(whole, lambda f: ~allowed(f, allowlist))
    return F.coalesce(whole, none).cast(f"array<{FINDING}>")


def context(text: Column, finding: Column, radius: int = 96) -> Column:
    """The text around a finding, in characters."""
    start = F.greatest(finding["start"] - radius, F.lit(0))
    return F.substring(text, start + 1, finding["stop"] + radius - start)


def with_findings(df: DataFrame, text_col: str, cfg: Detection, allowlist: Allowlist | None = None, prefix: str = PREFIX, classifier: Callable[[Column, Column, Column, Column], Column] | None = None) -> DataFrame:
    """df with the column findings.

    classifier(kind, subtype, value, context) gives a boolean column, by a pandas UDF for
    instance. It decides on typed findings with a score under 70: accepted ones (also
    where it gives null) count as classified with medium confidence and a score of 72
    at least, others go, before opaque tokens are added. With a classifier df is worked out
    once and written, and rows are told apart by a number: only those with a finding to decide on are joined with
    verdicts.
    """
    if classifier is None:
        return once(df, "findings", findings(F.col(text_col), cfg, allowlist, prefix))
    text = F.col(text_col)
    told = written(df.withColumns({"_typed": typed(text, cfg), "_row": F.monotonically_increasing_id()}))
    doubtful = F.exists("_typed", lambda f: f["score"] < 70)
    asked = each(told.where(doubtful).select("_row", text.alias("t"), F.filter("_typed", lambda f: f["score"] < 70).alias("some")), "some", "_row", "t")
    yes = F.coalesce(classifier(F.col("f.kind"), F.col("f.subtype"), F.col("f.secret"), context(F.col("t"), F.col("f"))), F.lit(True))
    refused = asked.select("_row", "f.start", "f.rule_id", yes.alias("yes")).where("not yes").groupBy("_row").agg(F.collect_set(F.struct("start", "rule_id")).alias("_no"))
    judged = told.where(doubtful).join(refused, "_row", "left")
    joined = told.where(~F.coalesce(doubtful, F.lit(False))).withColumn("_no", F.lit(None).cast(dict(judged.dtypes)["_no"])).unionByName(judged)
    upgraded = F.transform(
        F.filter("_typed", lambda f: ~F.coalesce(F.array_contains(F.col("_no"), F.struct(f["start"].alias("start"), f["rule_id"].alias("rule_id"))), F.lit(False))),
        lambda f: F.when(
            f["score"] < 70,
            f.withField("source", F.lit("classifier")).withField("confidence", F.lit("medium")).withField("score", F.greatest(f["score"], F.lit(72))),
        ).otherwise(f),
    ).cast(f"array<{FINDING}>")
    parts = [upgraded, opaque_findings(text, cfg, prefix)] if cfg.entropy else [upgraded]
    whole = S.let(F.concat(*parts), best_of_overlaps)
    if allowlist:
        whole = F.filter(whole, lambda f: ~allowed(f, allowlist))
    return joined.withColumn("findings", whole.cast(f"array<{FINDING}>")).drop("_typed", "_row", "_no")


def exploded(df: DataFrame, *keep: str) -> DataFrame:
    """A row for each finding of a table with findings."""
    return each(df, "findings", *keep).select(*keep, "f.*")


def each(df: DataFrame, column: str, *keep: str | Column) -> DataFrame:
    """keep and f for each element of an array column, which is worked out once: an inner explode would filter by its size first."""
    return df.select(*keep, F.explode_outer(column).alias("f")).where("f is not null")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is worked out once a row, however often and in whatever filter it is used: Spark doesn't take it apart or push it below."""
    own = [c for c in df.columns if c != name]
    return df.select(*(f"`{c}`" for c in own), F.explode_outer(F.array(value)).alias(name))


def spread(df: DataFrame) -> DataFrame:
    """df dealt by its first column to all cores where it comes in fewer files, a small file of one row group for instance."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, df.columns[0]) if len(df.inputFiles()) < cores else df
