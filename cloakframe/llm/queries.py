"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, html_extract, lloyd, merkle, mixing, pii, quality, simhash, substring_dedup, suffix_dedup, warc
from .common import table

ESCAPE_PROBE = r"\### Assistant: </turn> ok"


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(ESCAPE_PROBE).alias("text"),
    )
    return chat.read_examples(chat.format_examples(real.unionByName(probe)))


def _removed(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", _removed("spans").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.main_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.earlier_strings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", _removed("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, distance=2)
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op6_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.capture_histories(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op9_mixing_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", F.col("k_topic").alias("topic"), "n_tokens", F.round("rate", 6).alias("rate"), "copies")


def _of_kind(spans: str, kind: int) -> Column:
    """How many spans are of a kind. The lambda takes one parameter: a second one, even with a default, would get the index."""
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    counts = [_of_kind("base", k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.written("base"), 256).alias("base_sha256"), pii.written("spans").alias("spans"))


def _lowered(columns: dict[str, Column]) -> dict[str, Column]:
    """Lower-cases A-Z of the text where three divides the checksum of the id."""
    told = F.crc32(F.coalesce(columns["doc_id"].cast("string"), F.lit("-")).cast("binary")) % 3 == 0
    upper = "".join(map(chr, range(65, 91)))
    return columns | {"text": F.when(told & columns["doc_id"].isNotNull(), F.translate(columns["text"], upper, upper.lower())).otherwise(columns["text"])}


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.manifest(table(spark, sf_dir, "documents"), _lowered)
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("proof_sha256"), merkle.folded("told").alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = lloyd.compressed(table(spark, sf_dir, "embeddings"))
    books_sha256 = hashlib.sha256(lloyd.written(books).encode()).hexdigest()
    return lloyd.with_label_error(coded).select("vec_id", lloyd.hex_code("code").alias("code"), "error", "label_error", F.lit(books_sha256).alias("codebooks_sha256"))


OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), o AS (
  SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(15 + length(role) + length(role) - length(regexp_replace(role, '[\\#<:]', '', 'g'))
      + length(text) + length(text) - length(regexp_replace(text, '[\\#<]', '', 'g'))) OVER w AS upto
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR rn = n))::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""

OP5_SQL = """
WITH e AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(c.v, q.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM s) WHERE rank <= 10
"""

OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to FROM f
"""

OP7_SQL = r"""
WITH text_of AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), marked AS (
  SELECT side, id, lower(regexp_replace(regexp_replace(regexp_replace(text,
    '(\p{N})[.,:/](\p{N})', '\1' || chr(4) || '\2', 'g'),
    '(\p{N} ?)(UNITS)\b', '\1 ' || chr(2) || '\2', 'g'),
    '([\p{L},;] )(\p{Lu})', '\1' || chr(1) || '\2', 'g')) AS m FROM text_of
), toks AS (
  SELECT side, id, list_filter(regexp_split_to_array(m, '[^\p{L}\p{N}\x01\x02\x04]+'), lambda x: x <> '') AS t FROM marked
), typed AS (
  SELECT side, id, t, list_transform(t, lambda x: CASE WHEN x[1] = chr(1) THEN '<name>' WHEN x[1] = chr(2) THEN '<unit>' WHEN x[1] BETWEEN '0' AND '9' THEN '<number>' ELSE x END) AS h,
    least(len(t), 13) AS own FROM toks WHERE side = 'd' OR len(t) >= 5
), sizes AS (SELECT DISTINCT own AS n FROM typed WHERE side = 'b'),
placed AS (
  SELECT side, id, n, i, h[i:i + n - 1] AS w,
    list_filter(list_transform(range(i, i + n), lambda k: CASE WHEN h[k] IN ('<name>', '<unit>', '<number>') THEN t[k] END), lambda x: x IS NOT NULL) AS slots
  FROM typed JOIN sizes ON (side = 'd' OR own = n), LATERAL (SELECT unnest(range(1, len(t) - n + 2)) AS i)
), win AS (
  SELECT * FROM placed WHERE len(slots) <= greatest(n - 8, n // 2)
), reading AS (
  SELECT d.id AS doc_id, b.id AS item_id, d.i - b.i AS distance, count(*) AS whole, count(*) FILTER (d.slots = b.slots) AS same,
    list_distinct(flatten(list(list_transform(list_zip(d.slots, b.slots), lambda z: z[1] || chr(10) || z[2])))) AS pairs
  FROM win d JOIN win b ON d.side = 'd' AND b.side = 'b' AND d.n = b.n AND d.w = b.w GROUP BY ALL
), hit AS (
  SELECT doc_id, item_id, CASE WHEN len(pairs) = len(list_distinct(list_transform(pairs, lambda p: split_part(p, chr(10), 2))))
    THEN whole ELSE same END AS c FROM reading
)
SELECT doc_id, list_sort(list(item_id)) AS item_ids, sum(c)::BIGINT AS n_windows FROM hit WHERE c > 0 GROUP BY doc_id
""".replace("UNITS", "|".join(sorted(decontam.UNITS.split(), key=lambda u: (-len(u), u))))


def _op9_sql(sweeps: int = 10, power: float = 0.7, share: float = 0.5) -> str:
    """The sweeps as one common table expression for each margin."""
    steps = [
        r"""WITH m AS (SELECT doc_id, source, lang, coalesce(source, '') AS k_source, coalesce(lang, '') AS k_lang,
      CASE WHEN contains(lower(text), 'license') THEN 'legal' WHEN contains(lower(text), '@') THEN 'contact' WHEN contains(lower(text), '://') THEN 'web'
        WHEN contains(lower(text), '|') THEN 'table' ELSE 'prose' END AS k_topic,
      coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens FROM documents)""".replace("\\\\", "\\"),
        "c0 AS MATERIALIZED (SELECT k_source, k_lang, k_topic, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::DOUBLE AS weight FROM m GROUP BY ALL)",
    ]
    for d in mixing.DIMENSIONS:
        steps.append(f"s_{d} AS MATERIALIZED (SELECT k_{d}, pow(sum(tokens)::DOUBLE, {power}) AS p FROM c0 GROUP BY 1)")
        steps.append(f"t_{d} AS MATERIALIZED (SELECT k_{d}, p / (SELECT sum(p) FROM s_{d}) AS target FROM s_{d})")
    last = "c0"
    for i in range(sweeps * len(mixing.DIMENSIONS)):
        d = mixing.DIMENSIONS[i % len(mixing.DIMENSIONS)]
        steps.append(
            f"c{i + 1} AS MATERIALIZED (SELECT k_source, k_lang, k_topic, tokens, weight * CASE WHEN margin > 0 THEN target / margin ELSE 1 END AS weight"
            f" FROM {last} JOIN (SELECT k_{d}, sum(weight) AS margin FROM {last} GROUP BY 1) USING (k_{d}) JOIN t_{d} USING (k_{d}))"
        )
        last = f"c{i + 1}"
    steps.append(
        f"r AS (SELECT k_source, k_lang, k_topic, CASE WHEN tokens > 0 THEN weight * ({share} * (SELECT sum(tokens) FROM {last}) / (SELECT sum(weight) FROM {last})) / tokens ELSE 0 END AS rate FROM {last})"
    )
    return (
        ",\n".join(steps)
        + """
    SELECT * FROM (SELECT doc_id, source, lang, k_topic AS topic, n_tokens, round(rate, 6) AS rate,
      floor(rate + ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0)::INT AS copies
    FROM m JOIN r USING (k_source, k_lang, k_topic)) WHERE copies > 0"""
    )


OP9_SQL = _op9_sql()

OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, len(w) - 33)) AS i)),
dup AS (SELECT doc_id, i, i AS s FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS c FROM win) WHERE c > 1),
words AS (SELECT doc_id, i, w[i] AS word FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)),
cov AS (SELECT doc_id, i, word, coalesce(i - max(dup.s) OVER (PARTITION BY doc_id ORDER BY i) <= 34, false) AS gone FROM words LEFT JOIN dup USING (doc_id, i))
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(any_value(r), 0)::BIGINT AS n_removed, sha256(coalesce(any_value(kept), '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) FILTER (gone) AS r, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM cov GROUP BY doc_id) USING (doc_id)
GROUP BY doc_id, w
"""

OP3_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
part AS (SELECT doc_id, p * 512 AS o, substr(h, p * 1024 + 1, 1122) AS h, least(512, length(h) // 2 - p * 512) AS n FROM d, LATERAL (SELECT unnest(range(0, (length(h) // 2 + 511) // 512)) AS p)),
pos AS (SELECT doc_id, o + i AS i, substr(h, 2 * i - 1, 2) AS b, CASE WHEN 2 * i + 98 <= length(h) THEN substr(h, 2 * i - 1, 100) END AS s FROM part, LATERAL (SELECT unnest(range(1, n + 1)) AS i)),
first AS (SELECT s, min(doc_id) AS f FROM pos WHERE s IS NOT NULL GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i, b, CASE WHEN f < doc_id THEN i END AS st FROM pos LEFT JOIN first USING (s)),
cov AS (SELECT doc_id, i, b, coalesce(i - max(st) OVER (PARTITION BY doc_id ORDER BY i) <= 49, false) AS gone FROM hit),
run AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM cov)
SELECT doc_id, count(b)::BIGINT AS n_bytes, count(*) FILTER (gone)::BIGINT AS n_removed, count(*) FILTER (starts)::BIGINT AS n_spans,
  sha256(unhex(coalesce(string_agg(b, '' ORDER BY i) FILTER (NOT gone), ''))) AS kept_sha256
FROM d LEFT JOIN run USING (doc_id) GROUP BY doc_id
"""



def _op12_sql(heights: int = 8) -> str:
    """Levels as one common table expression each, for trees of up to 8^heights nodes; a tree that is down to one node goes up as it is."""
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(s) + 1), lambda i: ascii(s[i])::BIGINT)), lambda a, c: BITS)"
    bits = "list_reduce(list_prepend(xor(a, c), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))"
    crc = crc.replace("BITS", bits)
    field = lambda x: f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    steps = [
        "d AS MATERIALIZED (SELECT *, doc_id::VARCHAR AS s FROM documents)",
        f"e AS MATERIALIZED (SELECT row_number() OVER () AS row_no, doc_id, lang, {leaf('text')} AS leaf, CASE WHEN s IS NOT NULL AND xor({crc}, 4294967295) % 3 = 0 THEN {leaf(f"translate(text, '{upper}', '{upper.lower()}')")} ELSE {leaf('text')} END AS told FROM d)",
        "a0 AS MATERIALIZED (SELECT coalesce('=' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, row_no) - 1 AS p, leaf AS d, row_no FROM e)",
    ]

    def climb(x: str) -> None:
        for i in range(heights):
            steps.append(
                f"{x}{i + 1} AS MATERIALIZED (SELECT tree, p // 8 AS p, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY p)) END AS d FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {x}{i}) GROUP BY tree, p // 8)"
            )
            side = "coalesce(string_agg(d, '') OVER (PARTITION BY tree, p // 8 ORDER BY p ROWS BETWEEN {}), '')"
            left, right = side.format("UNBOUNDED PRECEDING AND 1 PRECEDING"), side.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")
            steps.append(f"{x}s{i} AS MATERIALIZED (SELECT tree, p, count(*) OVER (PARTITION BY tree) > 1 AS up, {left} AS l, {right} AS r FROM {x}{i})")

    climb("a")
    steps.append(f"b0 AS MATERIALIZED (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS p, tree AS of, d FROM a{heights})")
    climb("b")
    sides = ", ".join(f"{x}s{i}.up AS {x}u{i}, {x}s{i}.l AS {x}l{i}, {x}s{i}.r AS {x}r{i}" for x in "ab" for i in range(heights))
    joins = " ".join(f"JOIN {x}s{i} ON {x}s{i}.tree = {x}0.tree AND {x}s{i}.p = {x}0.p // {8**i}" for x in "ab" for i in range(heights))
    steps.append(
        f"w AS MATERIALIZED (SELECT e.doc_id, e.leaf, e.told, b0.d AS subroot, (SELECT d FROM b{heights}) AS root, {sides} FROM e JOIN a0 USING (row_no) JOIN b0 ON b0.of = a0.tree {joins})"
    )
    last = "w"
    for x in "ab":
        for i in range(heights):
            steps.append(f"{x}w{i} AS (SELECT * REPLACE (CASE WHEN {x}u{i} THEN sha256({x}l{i} || told || {x}r{i}) ELSE told END AS told) FROM {last})")
            last = f"{x}w{i}"
    proof = " || ".join(f"{x}l{i} || {x}r{i}" for x in "ab" for i in range(heights))
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, told AS folded_root, told = root AS verified FROM {last}"


OP12_SQL = _op12_sql()


def _op13_sql(rounds: int = 2) -> str:
    steps = [
        """k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)) AS row_no, vec_id, label,
      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "x AS MATERIALIZED (SELECT row_no, j, v[j * len(v) // 16 + 1 : (j + 1) * len(v) // 16] AS c FROM k, LATERAL (SELECT unnest(range(16)) AS j))",
        "b0 AS MATERIALIZED (SELECT j, row_no - 1 AS e, c FROM x WHERE row_no <= 64)",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"n{i} AS MATERIALIZED (SELECT row_no, j, first(x.c) AS c, min({{'d': list_sum(list_transform(list_zip(x.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': b.e}}) AS m FROM x JOIN b{i} b USING (j) GROUP BY row_no, j)"
        )
        if i < rounds:
            steps.append(
                f"s{i} AS (SELECT j, e, list(q ORDER BY t) AS c FROM (SELECT j, m.e AS e, t, (sum(c[t]) - ((sum(c[t]) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS q FROM n{i}, LATERAL (SELECT unnest(range(1, len(c) + 1)) AS t) GROUP BY ALL) GROUP BY j, e)"
            )
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT j, e, coalesce(s.c, b.c) AS c FROM b{i} b LEFT JOIN s{i} s USING (j, e))")
    steps.append(f"r AS (SELECT row_no, string_agg(lower(printf('%02x', m.e)), '' ORDER BY j) AS code, sum(m.d)::BIGINT AS error FROM n{rounds} GROUP BY row_no)")
    books = f"(SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY j, e)) FROM b{rounds})"
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, {books} AS codebooks_sha256 FROM k JOIN r USING (row_no)"


OP13_SQL = _op13_sql()

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_warc_archives": op6_warc_archives,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_mixing_to_targets": op9_mixing_to_targets,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_personal_data": op11_personal_data,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_vector_codes": op13_vector_codes,
}
ORACLE = {
    "op1_substring_dedup": OP1_SQL,
    "op3_suffix_array_dedup": OP3_SQL,
    "op5_nearest_neighbours": OP5_SQL,
    "op6_warc_archives": OP6_SQL,
    "op7_benchmark_decontamination": OP7_SQL,
    "op9_mixing_to_targets": OP9_SQL,
    "op10_chat_formatting": OP10_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
