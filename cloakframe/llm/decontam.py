"""Benchmark decontamination by template windows, with built-in DataFrame functions only.

Numbers, names (a capital inside a sentence) and units after a number become typed
slots, other words stay in lower case. Windows of so many tokens are hash-joined
between documents and benchmark items; the matches that line up are one reading of an
item, which counts if its slots are consistent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: What counts as a unit after a number.
UNITS = "km kg cm mm mg ml km/h mph kmh lb lbs oz ft in m g l s h min hours hour minutes minute seconds second days day weeks week months month years year miles mile meters metres meter metre grams gram liters litres liter litre dollars dollar euros euro pounds pound cents percent"
#: Regular expressions that Java and RE2 read alike, each with its replacement.
MARKS = (
    (r"(\p{N})[.,:/](\p{N})", "$1\x04$2"),
    (r"(\p{N} ?)(" + "|".join(sorted(UNITS.split(), key=lambda u: (-len(u), u))) + r")\b", "$1 \x02$2"),
    (r"([\p{L},;] )(\p{Lu})", "$1\x01$2"),
)
#: Then marks the other capitals, at the start of a text, line or sentence, after a digit, quote or bracket.
OTHER_CAPITAL = (r"(^|[^\p{L}\p{N}\x01\x02\x04])(\p{Lu})", "$1\x05$2")
BETWEEN = r"[^\p{L}\p{N}\x01\x02\x04\x05]+"
#: Rows of benchmark windows up to which they are broadcast; beyond, both sides are shuffled. The result is the same.
MOST_BROADCAST = 400_000
#: Bits of the table by which windows that no item has are passed over early.
SKETCH_BITS = 1 << 17


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column) -> Column:
    """Lower-case tokens; a mark before them tells names, units and, as names perhaps, other capitals."""
    for pattern, by in (*MARKS, OTHER_CAPITAL):
        text = F.regexp_replace(text, pattern, by)
    return F.array_remove(F.split(F.lower(text), BETWEEN), "")


def _is_slot(token: Column, wide: bool) -> Column:
    own = F.startswith(token, F.lit("\x01")) | F.startswith(token, F.lit("\x02")) | ((token >= "0") & (token < ":"))
    return own | F.startswith(token, F.lit("\x05")) if wide else own


def _template(token: Column, wide: bool) -> Column:
    """The hash of a token, or of what kind of slot it is."""
    name, unit, number = (F.lit(x).cast("long") for x in (1, 2, 3))
    out = F.when(F.startswith(token, F.lit("\x01")), name).when(F.startswith(token, F.lit("\x02")), unit).when((token >= "0") & (token < ":"), number)
    return out.when(F.startswith(token, F.lit("\x05")), name if wide else F.xxhash64(F.substring(token, 2, 1 << 30))).otherwise(F.xxhash64(token))


def _spans(h: Column, n: int) -> Column:
    """The hashes of each n (a power of two) consecutive ones of h, and of fewer at its end."""

    def doubled(k: int) -> Callable[[Column], Column]:
        return lambda x: F.zip_with(x, F.slice(x, k + 1, F.size(x)), lambda a, b: F.xxhash64(a, b))

    have = 1
    while have < n:
        h, have = let(h, doubled(have)), 2 * have
    return h


def _lead(n: int) -> int:
    """Tokens at the start of a window of n that are looked up early."""
    return 1 << (min(n, 4).bit_length() - 1)


def _seen(w: Column, sketch: list[int] | None) -> Column:
    """Whether the sketch may hold w."""
    if sketch is None:
        return F.lit(True)
    words = F.expr("array(" + ",".join(f"{x}L" for x in sketch) + ")")
    at = F.pmod(w, F.lit(SKETCH_BITS).cast("long")).cast("int")
    return F.getbit(F.element_at(words, F.call_function("shiftright", at, F.lit(5)) + 1), at.bitwiseAND(F.lit(31))) == 1


def _sketch(hashes: list[int]) -> list[int]:
    words = [0] * (SKETCH_BITS // 32)
    for h in hashes:
        at = h % SKETCH_BITS
        words[at >> 5] |= 1 << (at & 31)
    return words


def _windows(df: DataFrame, key: str, text: str, sizes: list[int], least_item: int, least_literal: int, sketch: list[int] | None = None) -> DataFrame:
    """key, n, w (hash of the template of n tokens), lead (that of its first ones), at (its place), slots (hashes of slot values) and wide of every window whose lead the sketch may hold.

    A window with capitals that only OTHER_CAPITAL marks comes again, wide, with those as
    names. w of a window with too many slots, or of fewer tokens than least_item, takes in the slot values.
    """
    arrays = df.select(F.col(key).alias(key), F.explode_outer(F.array(tokens(F.col(text)))).alias("x"))

    def windows(wide: bool, lead: int) -> Column:
        """The windows of those sizes that begin with so many tokens of the sketch."""
        value = (lambda x: F.xxhash64(F.regexp_replace(x, "^\x05", "\x01"))) if wide else (lambda x: F.xxhash64(x))

        def some(n: int, h: Column, w: Column) -> Column:
            places = F.when(F.size("x") >= n, F.sequence(F.lit(1), F.size("x") - n + 1)).otherwise(F.array().cast("array<int>"))
            places = F.filter(places, lambda i: _seen(F.get(w, i - 1), sketch))
            if wide:
                places = F.filter(places, lambda i: F.exists(F.slice("x", i, n), lambda x: F.startswith(x, F.lit("\x05"))))
            return F.transform(
                places,
                lambda i: F.struct(
                    F.lit(n).alias("n"),
                    i.alias("at"),
                    F.get(w, i - 1).alias("lead"),
                    F.xxhash64(F.slice(h, i, n)).alias("t"),
                    F.transform(F.filter(F.slice("x", i, n), lambda x: _is_slot(x, wide)), value).alias("slots"),
                    F.lit(wide).alias("wide"),
                ),
            )

        own = [n for n in sizes if _lead(n) == lead]
        return let(F.transform("x", lambda x: _template(x, wide)), lambda h: let(_spans(h, lead), lambda w: F.concat(*(some(n, h, w) for n in own))))

    # An inner explode, or a filter by the number of tokens, would work all of it out twice.
    each = arrays.select(key, F.explode_outer(F.concat(*(windows(wide, lead) for lead in sorted({_lead(n) for n in sizes}) for wide in (False, True)))).alias("x")).where("x is not null")
    found = each.select(key, "x.n", "x.lead", "x.t", "x.at", "x.slots", "x.wide")
    free = F.when(F.col("n") >= least_item, F.greatest(F.col("n") - least_literal, F.floor(F.col("n") / 2).cast("int"))).otherwise(-1)
    return found.withColumn("w", F.when(F.size("slots") <= free, F.xxhash64("n", "t")).otherwise(F.xxhash64("n", "t", "slots")))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, least_item: int = 5, least_literal: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id and n_windows (matched window pairs) of documents that hold a window of a benchmark item.

    Windows match by template. Those of one document and item at one distance from each
    other are one reading of the item; it counts if its slots are consistent, that is, each
    value of the item stands for one value of the document; two of the item may stand for the same. Of
    other readings only windows with the very same values count. Capitals at the start of
    a sentence or line, or after a digit, quote or bracket, are read as words and, all of
    a window alike, as names; n_windows counts the windows that match with them as words,
    and only where none does those that match either way.

    An item of fewer than window tokens is matched as a whole; null texts and those
    without tokens never match. Values may differ in windows of at least least_item tokens
    with least_literal words that aren't slots, or half of the tokens if that is fewer;
    other windows match by template and values. Repeated rows count as
    often as they stand; a null doc_id or item_id is kept as null. A very long text is taken
    whole, by one task, and only its windows that may match are built. Other columns are ignored; an empty table gives no rows.
    """
    items = benchmark.select("item_id", tokens(F.col("text")).alias("t"), "text").where(F.size("t") > 0)
    sizes = sorted({min(window, r.n) for r in items.select(F.least(F.size("t"), F.lit(window)).alias("n")).distinct().limit(window).collect()}) or [window]
    ours = items.select("item_id", "text", F.least(F.size("t"), F.lit(window)).alias("own"))
    sides = None
    for n in sizes:
        some = _windows(ours.where(F.col("own") == n), "item_id", "text", [n], least_item, least_literal)
        sides = some if sides is None else sides.unionAll(some)
    sides = sides.withColumnsRenamed({"slots": "item_slots", "at": "item_at", "wide": "item_wide"})
    sides, sketch = materialise(sides), None
    if sides.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        sketch = _sketch([r.lead for r in sides.select("lead").distinct().collect()])
        sides = F.broadcast(sides)
    hits = _windows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", sizes, least_item, least_literal, sketch).join(sides.drop("t", "n", "lead"), "w")
    same = F.col("slots") == F.col("item_slots")
    ways = [(F.col("wide") == x) & (F.col("item_wide") == y) for x in (False, True) for y in (False, True)]
    zipped = F.arrays_zip("slots", "item_slots")
    windows = hits.groupBy("doc_id", "item_id", "n", (F.col("at") - F.col("item_at")).alias("distance"), "at").agg(
        F.count_if(ways[0]).alias("plain"),
        F.count_if(ways[0] & same).alias("plain_same"),
        F.greatest(*(F.count_if(way) for way in ways)).alias("all"),
        F.greatest(*(F.count_if(way & same) for way in ways)).alias("same"),
        F.flatten(F.collect_set(F.when(ways[0], zipped))).alias("plain_pairs"),
        F.flatten(F.collect_set(zipped)).alias("pairs"),
    )
    readings = windows.groupBy("doc_id", "item_id", "distance").agg(
        F.sum("all").alias("all"),
        F.sum("same").alias("same"),
        F.sum("plain").alias("plain"),
        F.sum("plain_same").alias("plain_same"),
        F.array_distinct(F.flatten(F.collect_list("plain_pairs"))).alias("plain_pairs"),
        F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"),
    )

    def consistent(pairs: str) -> Column:
        return F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["item_slots"])))

    plain = F.when(consistent("plain_pairs"), F.col("plain")).otherwise(F.col("plain_same"))
    wide = F.when(consistent("pairs"), F.col("all")).otherwise(F.col("same"))
    found = readings.groupBy("doc_id", "item_id").agg(F.sum(plain).alias("plain"), F.sum(wide).alias("wide"))
    return found.where("plain > 0 or wide > 0").select("doc_id", "item_id", F.when(F.col("plain") > 0, F.col("plain")).otherwise(F.col("wide")).alias("n_windows"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_ids (sorted) and n_windows of every contaminated document."""
    found = matches(docs, benchmark, **options)
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.sum("n_windows").alias("n_windows"))
