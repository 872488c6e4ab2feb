"""The queries opN_<name> over whole tables, the pipeline query, and SQL for those that SQL expresses."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid
from ._common import checkpoint, read_table, train_filter
from .conversation_repair import faults, repair_reports, repaired_digests
from .divergence import divergence_audit
from .embedding_dedup import near_duplicate_groups
from .line_dedup import duplicate_lines, text_number
from .lm_scoring import lm_scores
from .mixing import mixture
from .ngram_jaccard import jaccard_components
from .packing import best_fit_packing
from .secret_scan import scan_secrets
from .sharding import hilbert_shards
from .token_counts import token_counts
from .topk_search import top_k_search

#: Folder of the public vocabulary files, or unset: then the installed package names it.
TOKENIZER_DIR = "LOOMSIFT_TOKENIZERS"


def vocabulary(name: str) -> str:
    """Path of a vocabulary file."""
    if folder := os.environ.get(TOKENIZER_DIR):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixture(docs, repetition_limit=2.0).select("doc_id", "source", "mix.*")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(read_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read_table(spark, sf_dir, "documents"), train_filter("doc_id", 7, 2))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(train_filter("doc_id", 3, 1)))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (~train_filter("doc_id", 3, 1)).alias("held_out"), F.col("lang_id.lang_pred").alias("lang_pred"), F.col("lang_id.score").alias("score"), F.col("lang_id.rejected").alias("rejected"), F.col("lang_id.bits").alias("bits"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = duplicate_lines(docs, edits=2, least_chars=30).withColumnRenamed("key", "of_key")
    lines = docs.select("doc_id", text_number("text").alias("number"), F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    met = lines.join(found, F.col("doc_id").eqNullSafe(F.col("of_key")) & (F.col("number") == F.col("text_number")), "left")
    return met.select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(read_table(spark, sf_dir, "documents"), least_docs=3, top=200)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: turns as a number from 0 to 19 by conversation and turn damages them."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), (F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20).alias("by"))
    text = F.when(F.col("by") == 1, "").when(F.col("by") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("by") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(0), F.when(F.col("by") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("by") == 0).alias("gone"), F.explode(times).alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = faults(damaged(read_table(spark, sf_dir, "conversations")), gone=F.col("gone"))
    reports = checkpoint(repair_reports(found))
    digests = repaired_digests(found, reports).withColumnRenamed("conv", "of_conv")
    met = reports.join(digests, F.col("conv").eqNullSafe(F.col("of_conv")))
    return met.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op13_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    slim = docs.select("doc_id", "lang", "source", size.alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.xxhash64("text").alias("same"))
    put = hilbert_shards(slim, 24, by=["lang", "source", "size"], tie=["same", "doc_id"], name="put")
    return put.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "put.shard", "put.slot", F.lit(None).cast("int").alias("grown_shard"), "put.curve")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    # It calls this subpackage, so it is imported when the query runs.
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_top_k_search": op1_top_k_search,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_secret_scan": op3_secret_scan,
    "op4_source_mixing": op4_source_mixing,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_language_id": op8_language_id,
    "op9_token_counts": op9_token_counts,
    "op10_line_dedup": op10_line_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_hilbert_sharding": op13_hilbert_sharding,
    "pipeline": pipeline,
}

_OP4_SQL = """
    WITH d AS (
        SELECT doc_id, source, coalesce(source, '') AS name, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens,
            CAST('0x' || substr(md5('block:1:' || coalesce(source, '') || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
        FROM documents
    ), t AS (
        SELECT name, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d WHERE n_tokens > 0 GROUP BY name
    ), e AS (
        SELECT CASE WHEN max(tokens) <= 2 * min(tokens) THEN 0 ELSE 1 - ln(2) / ln(max(tokens) / min(tokens)) END AS x, sum(tokens) AS every FROM t
    ), w AS (
        SELECT name, tokens, tokens / every AS p, pow(tokens / every, x) AS w,
            CAST(pow(2, ceil(log2(least(4096, greatest(1, ceil(tokens / 20000)))))) AS BIGINT) AS blocks
        FROM t, e
    ), r AS (
        SELECT name, tokens, blocks, (SELECT max(p / w) FROM w) * w / p AS repeat FROM w
    ), b AS (
        SELECT d.name, d.h % r.blocks AS block, r.tokens, r.repeat, floor(r.repeat + 1e-9) AS whole, sum(d.n_tokens) AS n
        FROM d JOIN r USING (name) WHERE d.n_tokens > 0 GROUP BY ALL
    ), k AS (
        SELECT b.*, unnest(generate_series(0, CAST(whole AS BIGINT))) AS epoch FROM b
    ), o AS (
        SELECT *, row_number() OVER q AS position, sum(n) OVER (q ROWS UNBOUNDED PRECEDING) - n AS before
        FROM k
        WINDOW q AS (PARTITION BY name, epoch ORDER BY CAST('0x' || substr(md5('pass:1:' || name || ':' || epoch || ':' || block), 1, 8) AS BIGINT), block)
    )
    SELECT d.doc_id, d.source, CAST(o.epoch AS BIGINT) AS epoch, CAST(o.block AS BIGINT) AS block, CAST(o.position AS BIGINT) AS position, d.n_tokens
    FROM d JOIN r USING (name) JOIN o ON o.name = d.name AND o.block = d.h % r.blocks
    WHERE d.n_tokens > 0 AND (o.epoch < o.whole OR o.before + o.n / 2 <= (o.repeat - o.whole) * o.tokens)
    UNION ALL
    SELECT doc_id, source, 0, 0, 0, 0 FROM d WHERE n_tokens = 0
"""

_OP10_SQL = """
    WITH l AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
        FROM documents
    ), k AS (
        SELECT line, len(line) AS n, min((doc_id, pos)) AS first FROM l WHERE len(line) >= 30 GROUP BY line
    ), late AS (
        SELECT DISTINCT b.line FROM k a JOIN k b ON a.n BETWEEN b.n - 2 AND b.n + 2 AND a.first < b.first AND levenshtein(a.line, b.line) <= 2
    ), gone AS (
        SELECT l.doc_id, string_agg(CAST(l.pos AS VARCHAR), ',' ORDER BY l.pos) AS dropped, count(*) AS n
        FROM l JOIN k USING (line) LEFT JOIN late ON late.line = l.line
        WHERE late.line IS NOT NULL OR (l.doc_id, l.pos) <> k.first
        GROUP BY l.doc_id
    )
    SELECT d.doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, CAST(coalesce(g.n, 0) AS BIGINT) AS n_dropped, coalesce(g.dropped, '') AS dropped
    FROM documents d LEFT JOIN gone g USING (doc_id)
"""

_OP11_SQL = """
    WITH d AS (
        SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
        FROM documents
    ), df AS (
        SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 3
    ), c AS (
        SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) SEMI JOIN df USING (lang, term) GROUP BY ALL
    ), v AS (SELECT lang, count(*) AS v FROM df GROUP BY 1),
    g AS (SELECT DISTINCT lang, source FROM d),
    gn AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
    ln AS (SELECT lang, sum(n) AS n FROM c GROUP BY 1),
    p AS (
        SELECT lang, source, df.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // (gn.n + v.v) AS p
        FROM gn JOIN v USING (lang) JOIN df USING (lang) LEFT JOIN c USING (lang, source, term)
    ), q AS (
        SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(c.n) + 1)) // (any_value(ln.n) + any_value(v.v)) AS q
        FROM c JOIN v USING (lang) JOIN ln USING (lang) GROUP BY ALL
    ), pair AS (
        SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    ), pairs AS (
        SELECT a.lang, a.source, b.source AS item, coalesce(pair.value, 0) AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
    ), terms AS (
        SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
    ), r AS (
        SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
        UNION ALL
        SELECT *, 'term' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms QUALIFY rank <= 200
    )
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r
"""

ORACLE_SQL: dict[str, str] = {
    "op1_top_k_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(d.e AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op4_source_mixing": _OP4_SQL,
    "op10_line_dedup": _OP10_SQL,
    "op11_source_divergence": _OP11_SQL,
}
