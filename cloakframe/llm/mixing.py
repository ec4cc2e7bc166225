"""Mixing sources to target weights by iterative proportional fitting, with built-in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

DIMENSIONS = ("source", "lang", "topic")
#: Cells that one task rakes; more cells are dealt out.
CELLS_A_TASK = 200_000


def default_topic(text: Column) -> Column:
    """A coarse topic by what a text holds."""
    low = F.lower(text)
    return (
        F.when(F.contains(low, F.lit("license")), "legal")
        .when(F.contains(low, F.lit("@")), "contact")
        .when(F.contains(low, F.lit("://")), "web")
        .when(F.contains(low, F.lit("|")), "table")
        .otherwise("prose")
    )


def measured(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """docs with the null-free cell columns k_source, k_lang, k_topic and n_tokens (words of the whole text)."""
    of = {"source": F.col("source"), "lang": F.col("lang"), "topic": default_topic(F.col("text")) if topic is None else topic}
    n = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select("*", *(F.coalesce(of[d].cast("string"), F.lit("")).alias(f"k_{d}") for d in DIMENSIONS), n.alias("n_tokens"))


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target shares of a dimension: its shares of the tokens to a power, scaled to sum to one."""
    shares = cells.groupBy(f"k_{dimension}").agg(F.sum("tokens").alias("tokens")).select(f"k_{dimension}", F.pow(F.col("tokens").cast("double"), F.lit(power)).alias("target"))
    whole = shares.agg(F.sum("target")).first()[0] or 1.0
    return shares.select(f"k_{dimension}", (F.col("target") / whole).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int) -> DataFrame:
    """cells (k_ columns, tokens) with weight: token counts scaled so that their margins meet the targets.

    Each sweep scales every margin in turn. A value that has no target keeps its weight;
    a value with a target but no tokens can't be met and stays empty.
    """
    tasks = 1 + cells.count() // CELLS_A_TASK
    now = cells.withColumn("weight", F.col("tokens").cast("double")).coalesce(tasks)
    aims = {d: t.coalesce(tasks) for d, t in targets.items()}
    for sweep in range(sweeps):
        for dimension, target in aims.items():
            key = f"k_{dimension}"
            margin = now.groupBy(key).agg(F.sum("weight").alias("margin"))
            factor = margin.join(target, key, "left").select(key, F.coalesce(F.when(F.col("margin") > 0, F.col("target") / F.col("margin")), F.lit(1.0)).alias("factor"))
            now = now.join(factor, key).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")
        now = materialise(now).coalesce(tasks)
    return now


def uniform(doc_id: Column) -> Column:
    """A number from 0 to below 1 that depends on the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, share: float = 0.5, power: float = 0.7, sweeps: int = 10, topic: Column | None = None) -> DataFrame:
    """The sampled rows of docs with rate (expected copies) and copies (1 or more).

    Cells of source, language and topic are raked to targets (k_ column and target,
    shares that sum to one; by default tempered shares). A cell's rate is its raked
    share of share times all tokens, over its own tokens; a row gets the whole part of
    its rate as copies and one more with the rest as probability, decided by a hash of
    its id, so the sample's expected token margins are the targets.

    Null source, lang or id counts as an empty string, null text has no tokens; rows of
    cells without tokens have rate 0 and are left out. Repeated rows count each and are
    decided alike. Columns named k_source, k_lang, k_topic, n_tokens, rate or copies in
    docs are replaced. A very long text is one row of many tokens, taken or left whole.
    No rows give no rows.
    """
    own = [c for c in docs.columns if c not in {*(f"k_{d}" for d in DIMENSIONS), "n_tokens", "rate", "copies"}]
    docs = measured(docs.select(own), topic)
    keys = [f"k_{d}" for d in DIMENSIONS]
    cells = materialise(docs.groupBy(keys).agg(F.sum("n_tokens").alias("tokens")))
    if targets is None:
        targets = {d: materialise(tempered(cells, d, power)) for d in DIMENSIONS}
    raked = rake(cells, targets, sweeps)
    all_tokens, all_weight = raked.agg(F.sum("tokens"), F.sum("weight")).first()
    budget = share * (all_tokens or 0) / (all_weight or 1.0)
    rates = materialise(raked.select(*keys, F.coalesce(F.when(F.col("tokens") > 0, F.col("weight") * budget / F.col("tokens")), F.lit(0.0)).alias("rate")))
    copies = F.floor(F.col("rate") + uniform(F.col("doc_id"))).cast("int")
    return docs.join(rates, keys).withColumn("copies", copies).where(F.col("copies") > 0)
