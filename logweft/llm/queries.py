"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path, tune
from . import bpe, chat, fingerprints, linecrf, lm, merkle, packing, periods, pq, simhash, suffixes, toxicity, warc
from .common import crc_mod, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

CAPACITY, END_ID = 4096, 1
TOXIC_AT, GOOD_AT = 0.7, 0.3


def vocabulary() -> str:
    """Path of the public vocabulary: LOGWEFT_VOCABULARY, else that of the installed tokenizer files."""
    if path := os.environ.get("LOGWEFT_VOCABULARY"):
        return path
    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return public_tokenizers.path("word_bpe_49k.json")
    return "/opt/tokenizers/word_bpe_49k.json"


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(ship(tune(spark)), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(n: int, remainder: int) -> Column:
    return crc_mod(F.col("doc_id"), n) == remainder


@query("op1_pq_near_duplicates")
def op1(spark, sf_dir):
    return pq.link_vectors(table(spark, sf_dir, "embeddings"), 0.98)


@query("op2_cross_entropy_difference")
def op2(spark, sf_dir):
    """Which documents read like conversations: all turns are the target, all documents the background."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(False).alias("target"))
    turns = table(spark, sf_dir, "conversations").select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("target"))
    return lm.cross_entropy_difference(docs.unionByName(turns), vocabulary(), "target", ["doc_id"])


@query("op3_bpe_round_trip")
def op3(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary()).drop("text")


@query("op4_best_two_fit")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, vocabulary(), CAPACITY, END_ID).drop("slot")


@query(
    "op5_warc_round_trip",
    """WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
       f AS (SELECT *, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first FROM p)
       SELECT page_id, payload_bytes, payload_digest,
              CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
              CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f""",
)
def op5(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    records = warc.archive(spark, pages, scratch_path(spark, "warc"))
    return records.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


@query("op6_noisy_channel_toxicity")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held_out(3, 1)))
    return toxicity.score(docs, model).select(
        "doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted")
    )


@query("op7_quote_linking")
def op7(spark, sf_dir):
    return chat.link_quotes(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")).drop("text")


# Words in repeats of at least n words are the words in windows of n words found twice; a repeat is longer than 50
# words if a window of 51 words is found twice.
_GRAMS = " UNION ALL ".join(
    f"SELECT id, {n} AS n, p, string_agg(word, ' ') OVER (PARTITION BY id ORDER BY p ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS gram "
    f"FROM words QUALIFY p + {n - 1} <= max(p) OVER (PARTITION BY id)"
    for n in (5, 6, 7, 8, 9, 10, 51)
)


@query(
    "op8_suffix_repetition",
    r"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
    w AS MATERIALIZED (SELECT id, regexp_extract_all(t, '[^ \t\n\v\f\r]+') AS ws FROM d),
    words AS MATERIALIZED (SELECT id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
    grams AS (SELECT id, n, p, count(*) OVER (PARTITION BY id, n, gram) AS found FROM ("""
    + _GRAMS
    + r""")),
    spans AS (SELECT id, n, least(n, lead(p, 1, p + n) OVER (PARTITION BY id, n ORDER BY p) - p) AS words FROM grams WHERE found > 1),
    covered AS (SELECT id, n, CAST(sum(words) AS BIGINT) AS words FROM spans GROUP BY id, n),
    lines AS (SELECT id, unnest(string_split(t, chr(10))) AS line FROM d),
    dup AS (SELECT id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^ \t\n\v\f\r]') GROUP BY id),
    base AS (SELECT d.id, d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
                    CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(c.words, 0) AS n_repeat_words
             FROM d JOIN w USING (id) LEFT JOIN dup USING (id) LEFT JOIN covered c ON c.id = d.id AND c.n = 5),
    failed AS (SELECT b.id, CAST(min(c.n) FILTER (c.n < 51 AND 100 * c.words > (20 - c.n) * b.n_words) AS BIGINT) AS failed_length,
                    coalesce(bool_or(c.n = 51), false) AS long_repeat
             FROM base b LEFT JOIN covered c ON c.id = b.id GROUP BY b.id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_length,
           n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
           NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND failed_length IS NULL AND NOT long_repeat AS kept
    FROM base JOIN failed USING (id)""",
)
def op8(spark, sf_dir):
    return suffixes.rate(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "longest_repeat")


@query("op9_line_crf_quality")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = linecrf.fit(docs, table(spark, sf_dir, "labels").filter(~held_out(5, 0)))
    return linecrf.score(docs, model).select(
        "doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= GOOD_AT).cast("int").alias("predicted")
    )


@query("op10_deletion_variant_simhash")
def op10(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op11_grammar_runs")
def op11(spark, sf_dir):
    return periods.detect(table(spark, sf_dir, "documents").select("doc_id", "text"), planted="doc_id").drop("text")


# crc32 of a document's number, bit by bit.
_CRC32 = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(d) + 1), lambda i: ascii(substr(d, CAST(i AS INT), 1))::BIGINT)),
              lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


def _leaf_sql(text: str) -> str:
    value = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    return "sha256(" + " || ".join(value(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"


@query(
    "op12_merkle_manifest",
    f"""WITH RECURSIVE
    d AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') AS d FROM documents),
    h AS (SELECT doc_id, lang, {_leaf_sql("text")} AS leaf,
                 CASE WHEN {_CRC32} % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other FROM d),
    k AS (SELECT lang, row_number() OVER (ORDER BY lang COLLATE C NULLS FIRST) - 1 AS tree, count(*) AS n FROM h GROUP BY lang),
    l AS (SELECT doc_id, tree, n, leaf, coalesce(other, leaf) AS own, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                 row_number() OVER () AS id FROM h JOIN k ON h.lang IS NOT DISTINCT FROM k.lang),
    up AS (SELECT tree, 0 AS height, pos, leaf AS digest, n FROM l
           UNION ALL
           SELECT tree, height + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8 FROM up WHERE n > 1 GROUP BY tree, height, pos // 8, n),
    s AS (SELECT tree, digest AS subroot FROM up WHERE n = 1),
    top AS (SELECT 0 AS height, tree AS pos, subroot AS digest, (SELECT count(*) FROM s) AS n FROM s
            UNION ALL
            SELECT height + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8 FROM top WHERE n > 1 GROUP BY height, pos // 8, n),
    f AS (SELECT id, tree, 0 AS height, pos, own, '' AS proof, n FROM l
          UNION ALL
          SELECT f.id, f.tree, f.height + 1, f.pos // 8, sha256(string_agg(CASE WHEN u.pos = f.pos THEN f.own ELSE u.digest END, '' ORDER BY u.pos)),
                 f.proof || coalesce(string_agg(u.digest, '' ORDER BY u.pos) FILTER (u.pos <> f.pos), ''), (f.n + 7) // 8
          FROM f JOIN up u ON u.tree = f.tree AND u.height = f.height AND u.pos // 8 = f.pos // 8 WHERE f.n > 1
          GROUP BY f.id, f.tree, f.height, f.pos, f.own, f.proof, f.n),
    g AS (SELECT id, 0 AS height, tree AS pos, own, proof, (SELECT count(*) FROM s) AS n FROM f WHERE n = 1
          UNION ALL
          SELECT g.id, g.height + 1, g.pos // 8, sha256(string_agg(CASE WHEN t.pos = g.pos THEN g.own ELSE t.digest END, '' ORDER BY t.pos)),
                 g.proof || coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos <> g.pos), ''), (g.n + 7) // 8
          FROM g JOIN top t ON t.height = g.height AND t.pos // 8 = g.pos // 8 WHERE g.n > 1
          GROUP BY g.id, g.height, g.pos, g.own, g.proof, g.n)
    SELECT l.doc_id, l.leaf, s.subroot, r.digest AS root, sha256(g.proof) AS proof_sha256, g.own AS folded_root, g.own = r.digest AS verified
    FROM l JOIN s USING (tree) JOIN g ON g.id = l.id AND g.n = 1 CROSS JOIN (SELECT digest FROM top WHERE n = 1) r""",
)
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.manifest(docs, docs.columns, {"text": lower}, crc_mod(F.col("doc_id"), 3) == 0)


@query("op13_block_table_fingerprints")
def op13(spark, sf_dir):
    return fingerprints.compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))
