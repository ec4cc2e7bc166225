"""Personal data by bootstrapped contextual extraction, all in columns.

Base entities (mail addresses, IP addresses, card and phone numbers, by their form) are the
seeds. The one and two words before a seed are its lexical patterns. Anything of a looser
form that stands behind the same words is an instance whose worth isn't known yet. Patterns
and instances form a graph whose edges count occurrences. In each round

* the confidence of a pattern is the worth of the instances behind it, over the number of
  times that its words stand anywhere in the corpus, plus one; it needs the support of
  several worthy instances that differ;
* the worth of an instance is one for a seed; else confident patterns each leave open one
  minus their confidence, and the worth is one minus the product of that.

Instances that are worthy after one round support patterns in the next, so words that stand
before no seed are learnt from what was found. At the end worthy instances become spans of
their kind. Words that merely happen to stand before a seed also stand elsewhere, so they
never gain confidence, and corpora without telling words get the base spans alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import let
from .common import delete, materialise

# Kinds in the order of the result.
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

OPEN, SHUT, OTHER = "\x01", "\x02", "\x03"
#: Lengths are summed up block by block, so that a text of many matches doesn't cost their square.
BLOCK = 64
#: Patterns are broadcast up to this many rows of two words; beyond, words are counted before they meet. The result is the same.
MOST_BROADCAST = 200_000
#: Characters before an entity within which its words are looked for; a word that may be cut there makes no pattern.
REACH = 64

_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
# A run that fails at its start fails at every later place of it too, so a search begins at the start
# of a run, or where the match before ended. Possessive repeats don't go back: texts cost their length.
FORMS = {
    EMAIL: r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"[0-9](?:[ -]?[0-9])++",
    PHONE: r"\+[0-9][ ().0-9-]+[0-9]",
}
_DOT = r"(?:\.| ?[(\[{]dot[)\]}] ?| dot )"
_AT = r"(?: ?[(\[{]at[)\]}] ?| at )"
LOOSE_MAIL = rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)*+|{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++)"
LOOSE_IP = r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Za-z:])"
LOOSE_NUMBER = r"(?<![0-9A-Za-z])[0-9](?:[ ().-]{0,2}[0-9])++(?![A-Za-z])"
# What a text must have for a match, told faster than by the form itself.
_HINTS = {
    FORMS[EMAIL]: lambda t: t.contains("@"),
    FORMS[IP]: lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    FORMS[CARD]: lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){15}"),
    FORMS[PHONE]: lambda t: t.contains("+"),
    LOOSE_MAIL: lambda t: t.contains("@") | t.rlike(r"[(\[{]at[)\]}]| at [A-Za-z0-9-]++(?:\.| ?[(\[{]dot| dot )"),
    LOOSE_IP: lambda t: t.rlike(r":[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:"),
    LOOSE_NUMBER: lambda t: t.rlike(r"[0-9](?:[ ().-]{0,2}[0-9]){6}"),
}
#: A word of a context, with the sign that makes it a label.
UNIT = r"\p{L}++[:=#-]?"
#: What may stand between the last word and an entity.
GAP = r"[ \t\r\n:=#(\"'<\[-]{0,3}"

_ENTITY = "struct<kind:int,start:int,stop:int,value:string,seed:boolean,contexts:array<string>>"
_SPAN = "struct<kind:int,start:int,stop:int>"


def _matches(text: Column, pattern: str, make: Callable[[Column, Column, Column], Column]) -> Column:
    """make(start, value, text since the match before) of each match of pattern in text, in code points."""

    def of_pieces(pieces: Column) -> Column:
        tail = F.slice(pieces, F.lit(2), F.size(pieces) - 1)
        return let(F.transform(tail, lambda p: F.length(p) - 1), lambda lengths: of_lengths(pieces, tail, lengths))

    def of_lengths(pieces: Column, tail: Column, lengths: Column) -> Column:
        add = lambda a, x: a + x
        blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))
        sums = F.transform(blocks, lambda j: F.aggregate(F.slice(lengths, j * BLOCK + 1, F.lit(BLOCK)), F.lit(0), add))
        starts = let(sums, lambda s: F.transform(blocks, lambda j: F.aggregate(F.slice(s, F.lit(1), j), F.length(F.get(pieces, F.lit(0))), add)))

        def one(starts: Column) -> Column:
            def at(piece: Column, i: Column) -> Column:
                block = F.floor(i / BLOCK).cast("int")
                start = F.aggregate(F.slice(lengths, block * BLOCK + 1, i % BLOCK), F.get(starts, block), add)
                return make(start, F.substring_index(piece, SHUT, 1), F.substring_index(F.get(pieces, i), SHUT, -1))

            return F.transform(tail, at)

        return let(starts, one)

    marked = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}$0{SHUT}")), OPEN)
    return F.when(_HINTS[pattern](text), let(marked, lambda pieces: F.when(F.size(pieces) > 1, of_pieces(pieces))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]++", "")


def _valid(kind: int, value: Column) -> Column:
    if kind == IP:
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == CARD:
        return let(_digits(value), lambda d: F.length(d).between(16, 19) & F.call_function("luhn_check", d))
    if kind == PHONE:
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _contexts(before: Column) -> Column:
    """The last word and the last two before an entity, if only marks stand between."""
    none = F.array().cast("array<string>")

    def of(near: Column) -> Column:
        whole = F.when(F.length(near) < REACH, near).otherwise(F.regexp_replace(near, r"^\p{L}++", ""))

        def named(u: Column) -> Column:
            last, other = F.get(u, F.size(u) - 1), F.get(u, F.size(u) - 2)
            return F.when(F.size(u) == 0, none).when(F.size(u) == 1, F.array(last)).otherwise(F.array(last, F.concat(other, F.lit(" "), last)))

        words = F.regexp_extract_all(whole, F.lit(UNIT), F.lit(0))
        return F.when(near.rlike(rf"\p{{L}}[:=#-]?{GAP}$"), let(words, named)).otherwise(none)

    return let(F.lower(F.substring(before, -REACH, REACH)), of)


def _seeds(text: Column, kind: int) -> Column:
    def make(start: Column, value: Column, before: Column) -> Column:
        whole = F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(value)).alias("stop"), F.lower(value).alias("value"), F.lit(True).alias("seed"), _contexts(before).alias("contexts")
        )
        return F.when(_valid(kind, value), whole)

    return _whole(_matches(text, FORMS[kind], make))


def _whole(found: Column) -> Column:
    return F.coalesce(F.filter(found, lambda x: x.isNotNull()), F.array().cast(f"array<{_ENTITY}>"))


def _instances(text: Column, pattern: str, kinds: Callable[[Column], list[tuple[int, Column]]]) -> Column:
    """One entry for each kind whose looser form a match has."""

    def make(start: Column, value: Column, before: Column) -> Column:
        def each(contexts: Column) -> Column:
            entry = lambda kind: F.struct(
                F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(value)).alias("stop"), F.lower(value).alias("value"), F.lit(False).alias("seed"), contexts.alias("contexts")
            )
            return F.filter(F.array(*(F.when(test, entry(kind)) for kind, test in kinds(value))), lambda x: x.isNotNull())

        return let(_contexts(before), each)

    return F.coalesce(F.flatten(_matches(text, pattern, make)), F.array().cast(f"array<{_ENTITY}>"))


def _number_kinds(value: Column) -> list[tuple[int, Column]]:
    n = F.length(_digits(value))
    return [(CARD, n.between(12, 19)), (PHONE, n.between(7, 15))]


def _apart(base: Column, loose: Column) -> Column:
    """The entries of loose that overlap none of base, which is looked through block by block."""

    def over(a: Column, x: Column) -> Column:
        return (a["start"] < x["stop"]) & (x["start"] < a["stop"])

    def blocks(spans: Column) -> Column:
        def block(j: Column) -> Column:
            return let(F.slice(spans, j * BLOCK + 1, F.lit(BLOCK)), lambda s: F.struct(F.get(s, F.lit(0))["start"].alias("start"), F.array_max(F.transform(s, lambda b: b["stop"])).alias("stop"), s.alias("spans")))

        return F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int")), block)

    def of(blocks_: Column) -> Column:
        return F.filter(loose, lambda x: ~F.exists(blocks_, lambda b: over(b, x) & F.exists(b["spans"], lambda a: over(a, x))))

    spans = F.array_sort(F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["stop"].alias("stop"))))
    return F.when(F.size(base) == 0, loose).otherwise(let(let(spans, blocks), of))


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, base (all seeds) and loose (instances of looser form that overlap no seed) of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marks = text.contains(OPEN) | text.contains(SHUT)

    def of(t: Column) -> Column:
        base = F.concat(*(_seeds(t, kind) for kind in range(len(KINDS))))
        loose = F.concat(_instances(t, LOOSE_MAIL, lambda v: [(EMAIL, F.lit(True))]), _instances(t, LOOSE_IP, lambda v: [(IP, F.lit(True))]), _instances(t, LOOSE_NUMBER, _number_kinds))
        return let(base, lambda b: F.struct(b.alias("base"), _apart(b, loose).alias("loose")))

    found = let(F.when(marks, F.translate(text, OPEN + SHUT, OTHER + OTHER)).otherwise(text), of)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.explode_outer(F.array(found)).alias("found"))
    return plain.select("doc_id", "text_hash", "found.base", "found.loose")


def _totals(docs: DataFrame, patterns: DataFrame, text_col: str) -> DataFrame:
    """pattern and total: how often the words of each pattern stand in all texts."""
    units = F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit(UNIT), F.lit(0))
    both = let(units, lambda u: F.concat(u, F.transform(F.slice(u, F.lit(2), F.greatest(F.size(u) - 1, F.lit(0))), lambda x, i: F.concat(F.get(u, i), F.lit(" "), x))))
    words = docs.where(F.col(text_col).isNotNull()).select(F.explode(both).alias("pattern"))
    if patterns.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        return words.join(F.broadcast(patterns), "pattern").groupBy("pattern").agg(F.count("*").alias("total"))
    return words.groupBy("pattern").agg(F.count("*").alias("total")).join(patterns, "pattern")


def worthy_values(docs: DataFrame, found: DataFrame, support: int = 3, confident: float = 0.5, worthy: float = 0.7, rounds: int = 4, text_col: str = "text") -> DataFrame:
    """kind, value and worth of the instances, seeds apart, that end with a worth of at least worthy."""
    entries = found.select(F.explode(F.concat("base", "loose")).alias("x")).select("x.*")
    edges = entries.select("kind", "value", "seed", F.explode("contexts").alias("pattern")).groupBy("kind", "pattern", "value").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    edges = materialise(edges)
    often = edges.groupBy("kind", "pattern").agg(F.count("*").alias("c")).where(F.col("c") >= support)
    totals = materialise(_totals(docs, materialise(often.select("pattern").distinct()), text_col))
    graph = materialise(edges.join(often.select("kind", "pattern"), ["kind", "pattern"]))
    unknown = graph.where("not seed")
    worth = None
    for _ in range(rounds):
        known = graph.withColumn("worth", F.col("seed").cast("double"))
        if worth is not None:
            told = unknown.join(worth, ["kind", "value"], "left").withColumn("worth", F.coalesce("worth", F.lit(0.0)))
            known = known.where("seed").unionByName(told)
        sums = known.groupBy("kind", "pattern").agg(F.sum(F.col("n") * F.col("worth")).alias("good"), F.sum((F.col("worth") >= worthy).cast("long")).alias("values"))
        sure = sums.where(F.col("values") >= support).join(totals, "pattern").withColumn("confidence", F.col("good") / (F.col("total") + 1)).where(F.col("confidence") >= confident)
        after = unknown.join(sure.select("kind", "pattern", "confidence"), ["kind", "pattern"]).groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("worth"))
        after = materialise(after)
        if worth is not None:
            delete(worth)
        worth = after
    return worth.where(F.col("worth") >= worthy)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **scoring) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start and stop, by kind, then place, in code points) of every row.

    base holds the seeds, leftmost and not overlapping within a kind; spans holds them and
    what the patterns found. A null or empty text has none. Rows are judged one by one: repeated
    ids and rows each come out, and rows of equal id and text get the same spans; a null id
    stays null. A place that is worthy as two kinds gets the worthier, then the first of KINDS.
    A very long text costs its length, and holds its matches in one row. Entities in an empty
    table are none. Other columns are ignored, whatever their names. Keyword arguments are those of worthy_values.
    """
    found = materialise(entities(docs, id_col, text_col))
    worth = worthy_values(docs, found, text_col=text_col, **scoring)
    loose = found.select("doc_id", "text_hash", F.explode("loose").alias("x")).select("doc_id", "text_hash", "x.kind", "x.start", "x.stop", "x.value")
    hits = loose.distinct().join(worth, ["kind", "value"]).groupBy("doc_id", "text_hash", "start").agg(F.max_by(F.struct("kind", "start", "stop"), F.struct("worth", -F.col("kind"), "stop")).alias("span"))
    added = materialise(hits.groupBy(F.col("doc_id").alias("id_b"), F.col("text_hash").alias("hash_b")).agg(F.collect_list("span").alias("added")))
    rows = found.join(added, (F.col("text_hash") == F.col("hash_b")) & F.col("doc_id").eqNullSafe(F.col("id_b")), "left")
    base = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    base = base.cast(f"array<{_SPAN}>")
    added = F.coalesce("added", F.array().cast(f"array<{_SPAN}>"))
    return rows.select("doc_id", base.alias("base"), F.array_sort(F.concat(base, added)).alias("spans"))


def written(spans: Column | str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")
