"""Rewriting: ids, placeholders and masked texts as one projection; the mapping table; restoring.

An id depends on salt, kind and value alone, so masking needs no shared state. The
mapping table is a by-product, and only restoring reads it.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PREFIX
from ..errors import STRICT_RESOLVE_FAILED
from ..functions import scalars as S
from ..tables import written
from ..vocabulary import placeholder_pattern
from . import detect

#: The version of the placeholder format, as receivers are told.
CONTRACT = "placeholder:v2"


def with_placeholders(findings: Column, salt: bytes | None = None, prefix: str = PREFIX, depth: int = 0) -> Column:
    """findings with id, placeholder and depth: the replacements."""

    def one(f: Column) -> Column:
        return S.let(
            S.finding_id(f["kind"], f["secret"], salt),
            lambda i: f.withField("id", i).withField("placeholder", S.placeholder(f["kind"], i, prefix)).withField("depth", F.lit(depth)),
        )

    return F.transform(findings, one)


def spliced(text: Column, replacements: Column) -> Column:
    """text with each replaced span given as its placeholder."""

    def before(i: Column) -> Column:
        end = F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(replacements, i)["stop"])
        return F.substring(text, end + 1, F.get(replacements, i)["start"] - end)

    pieces = F.transform(replacements, lambda r, i: F.concat(before(i), r["placeholder"]))
    tail = F.substring(text, F.element_at(replacements, -1)["stop"] + 1, F.length(text))
    return F.when(F.size(replacements) == 0, text).otherwise(F.concat(F.array_join(pieces, ""), tail))


def masked(df: DataFrame, text_col: str, salt: bytes | None = None, prefix: str = PREFIX, dry_run: bool = False) -> DataFrame:
    """df (with findings) with replacements and masked text; a dry run reports replacements with unsalted ids and leaves the text."""
    out = df.withColumn("replacements", with_placeholders(F.col("findings"), None if dry_run else salt, prefix))
    return out.withColumn("masked", F.col(text_col) if dry_run else spliced(F.col(text_col), F.col("replacements")))


def summary(replacements: Column, dry_run: bool = False) -> Column:
    n = F.size(replacements)
    return F.when(n == 0, "no replacements").otherwise(F.concat(F.lit("would replace " if dry_run else "replaced "), n, F.lit(" sensitive value(s)")))


def kind_histogram(replacements: Column) -> Column:
    """``2 email, 1 phone``: how many of each kind, in order of their labels."""
    labels = F.transform(replacements, lambda r: S.display_label(r["kind"]))
    count = lambda name: F.size(F.filter(labels, lambda x: x == name))
    return F.array_join(F.transform(F.array_sort(F.array_distinct(labels)), lambda x: F.concat(count(x), F.lit(" "), x)), ", ")


def mapping(masked_rows: DataFrame, ttl: timedelta = timedelta(hours=1), seen_at: Column | None = None) -> DataFrame:
    """id, kind, secret and expires_at of all replacements; seeing a value again puts its expiry off."""
    seen = F.current_timestamp() if seen_at is None else seen_at
    each = detect.each(masked_rows, "replacements", seen.alias("seen")).select("f.id", "f.kind", "f.secret", "seen")
    return merged(each.select("id", "kind", "secret", (F.col("seen") + F.expr(f"INTERVAL {ttl.total_seconds()} SECOND")).alias("expires_at")))


def merged(*tables: DataFrame, now: Column | None = None) -> DataFrame:
    """One mapping of several: the latest expiry of each id, without what has expired by now."""
    whole = tables[0]
    for other in tables[1:]:
        whole = whole.unionByName(other)
    out = whole.groupBy("id", "kind").agg(F.first("secret").alias("secret"), F.max("expires_at").alias("expires_at"))
    return out if now is None else out.where(F.col("expires_at") > now)


def lookup(requests: DataFrame, known: DataFrame, now: Column) -> DataFrame:
    """requests (id, kind ...) with secret where the mapping has the id for that kind and it hasn't expired; a mapping may hold an id twice."""
    live = known.where(F.col("expires_at") > now).groupBy("id", "kind").agg(F.min("secret").alias("secret"))
    return requests.join(live, ["id", "kind"], "left")


def pieces(text: Column, prefix: str = PREFIX) -> Column:
    """text cut at whole placeholders: array of (before, piece, id, kind); the last has what follows them, and no piece."""
    pattern = placeholder_pattern(prefix)
    none = F.lit(None).cast("string")

    def one(before: Column, piece: Column) -> Column:
        whole = piece.isNotNull()
        return F.struct(
            before.alias("before"),
            piece.alias("piece"),
            F.when(whole, F.regexp_extract(piece, pattern, 2)).otherwise(none).alias("id"),
            F.when(whole, S.kind_of_label(F.regexp_extract(piece, pattern, 1))).otherwise(none).alias("kind"),
        )

    return F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), one)


def resolved(df: DataFrame, key: str, text_col: str, known: DataFrame, now: Column, prefix: str = PREFIX, strict: bool = False, kinds: list[str] | None = None) -> DataFrame:
    """df with restored text and error_code.

    df is worked out once and written; its rows are told apart by a number given then, so
    key need not be unique, and may be null. Only the ids that a row asks for go into the join with the
    mapping; the values come back as a map of the row, to the rows that hold placeholders. A miss leaves the
    placeholder; if strict, the row has no text but an error code. kinds restricts what is
    restored, others count as misses.
    """
    none = F.lit(None).cast("string")
    hit = F.coalesce(S.contains_placeholder(F.col(text_col), prefix), F.lit(False))
    rows = written(df.withColumns({"_cut": F.when(hit, pieces(F.col(text_col), prefix)), "_row": F.monotonically_increasing_id()}))
    cut = rows.where("_cut is not null")
    wanted = F.filter("_cut", lambda p: p["id"].isNotNull() & (p["kind"].isin(kinds) if kinds is not None else F.lit(True)))
    asked = cut.select("_row", F.array_distinct(F.transform(wanted, lambda p: F.struct(p["id"].alias("id"), p["kind"].alias("kind")))).alias("ids"))
    values = entries(lookup(detect.each(asked, "ids", "_row").select("_row", "f.id", "f.kind"), known, now), "_row").withColumnRenamed("values", "_values")
    joined = cut.join(values, "_row", "left").withColumn("_values", F.coalesce("_values", F.create_map().cast("map<string,string>")))
    value = lambda p: F.try_element_at(F.col("_values"), F.concat_ws(":", p["kind"], p["id"]))
    text = F.array_join(F.transform("_cut", lambda p: F.concat(p["before"], F.coalesce(value(p), p["piece"], F.lit("")))), "")
    missed = F.exists("_cut", lambda p: p["piece"].isNotNull() & value(p).isNull())
    failed = F.lit(strict) & F.coalesce(missed, F.lit(False))
    done = joined.withColumn("restored", F.when(~failed, text)).withColumn("error_code", F.when(failed, STRICT_RESOLVE_FAILED).otherwise(none)).drop("_cut", "_row", "_values")
    plain = rows.where("_cut is null").withColumns({"restored": F.col(text_col), "error_code": none}).drop("_cut", "_row")
    return plain.unionByName(done)


def entries(found: DataFrame, row: str) -> DataFrame:
    """row and values, a map from kind:id to secret, of looked-up ids; none for a row without any."""
    pair = F.struct(F.concat_ws(":", "kind", "id").alias("name"), "secret")
    return found.where("secret is not null").groupBy(row).agg(F.map_from_entries(F.array_distinct(F.collect_list(pair))).alias("values"))


def contract(replacements: Column, dry_run: bool = False) -> Column:
    """The value that tells a receiver which placeholders a changed message holds; null for an unchanged one and in a dry run."""
    return F.when((F.size(replacements) > 0) & F.lit(not dry_run), CONTRACT).otherwise(F.lit(None).cast("string"))
