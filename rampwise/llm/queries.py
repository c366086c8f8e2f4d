"""The operators of this package bound to the driver's tables, and SQL where it can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampwise.llm import bpe, conversations, decontaminate, exact, jaccard, language, periodic, pii, quality, repeats, sharding, tokens, warc
from rampwise.llm.common import read
from rampwise.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return add


@query()
def op1_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.spans(read(spark, d, "documents"))


@query()
def op2_bpe(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(read(spark, d, "documents"))


@query()
def op3_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_counts(read(spark, d, "documents"))


_SPACE = "\\x20\\x09-\\x0D"
_STOPS = ", ".join(f"'{w}'" for w in sorted({w for line in quality.STOP_WORDS for w in line.split()}))
_MEASURES = {
    "mean_word": "word_chars / nullif(n_words, 0)", "symbols_per_word": "n_symbols / nullif(n_words, 0)",
    "stop_share": f"len([x FOR x IN w IF lower(rtrim(x, '.,!?;:')) IN ({_STOPS})]) / nullif(n_words, 0)",
    "letter_share": "len([x FOR x IN w IF regexp_matches(x, '\\p{L}')]) / nullif(n_words, 0)", "dup_line_share": "n_dup_lines / nullif(len(lines), 0)",
    "ellipsis_share": "len([x FOR x IN lines IF suffix(x, '...') OR suffix(x, '…')]) / nullif(len(lines), 0)",
    "bullet_share": f"len([x FOR x IN lines IF regexp_matches(x, '^[{_SPACE}]*[-*•]')]) / nullif(len(lines), 0)",
}
_RULES = " AND ".join(
    f"(n_words < {r.words} OR coalesce({' AND '.join(f'{_MEASURES[r.measure]} {sign} {bound}' for sign, bound in (('>=', r.least), ('<=', r.most)) if bound is not None)}, true))"
    for r in quality.RULES)
QUALITY_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT *, regexp_extract_all(text, '[^{_SPACE}]+') AS w, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^{_SPACE}]')] AS lines FROM t),
win AS (SELECT r, i, array_to_string(w[i:i + {quality.WINDOW - 1}], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - {quality.WINDOW} + 2)) AS i FROM d)),
again AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {quality.WINDOW})) AS p FROM again) GROUP BY r),
m AS (SELECT d.*, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND {_RULES} AS kept FROM b"""


@query(QUALITY_SQL)
def op4_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.judged(read(spark, d, "documents"))


DECONTAMINATE_SQL = """
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM {docs}),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM low),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bs)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
met AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, n, i FROM met)) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM met GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id"""


@query(DECONTAMINATE_SQL.format(docs="documents"))
def op5_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, d, "documents"), read(spark, d, "benchmark"))


@query()
def op6_repeats(spark: SparkSession, d: str) -> DataFrame:
    return repeats.without_repeats(read(spark, d, "documents"))


SHARD_NAMES = {f"shard-{i:02d}": 1 for i in range(sharding.SHARDS)}
SHARD_TABLE = sharding.lookup(SHARD_NAMES)
SHARDING_SQL = f"""
WITH t AS (SELECT {SHARD_TABLE} AS held), s AS (
    SELECT doc_id, source, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {sharding.SLOTS} AS slot FROM documents)
SELECT doc_id, source, slot, printf('shard-%02d', held[slot + 1]) AS shard FROM s, t"""


@query(SHARDING_SQL)
def op7_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.placed(read(spark, d, "documents"), F.col("doc_id"), SHARD_TABLE, list(SHARD_NAMES), ["doc_id", "source"])


@query()
def op8_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.linked(read(spark, d, "documents"))


WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, unhex(sha1(coalesce(html, ''))) AS h, coalesce(html, '') AS body FROM pages),
bits AS (SELECT page_id, n, body, CAST(h AS BIT) AS b FROM p),
digest AS (SELECT page_id, n, body, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             1 + CAST(list_sum(list_transform(range(5), lambda j: get_bit(b, CAST(5 * i + j AS INTEGER)) * (16 >> CAST(j AS INTEGER)))) AS INTEGER), 1)), '') AS d FROM bits),
head AS (SELECT body, max(page_id) AS top FROM p GROUP BY body)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM digest JOIN head USING (body)"""


@query(WARC_SQL)
def op9_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc.archived(read(spark, d, "pages"), scratch_path(spark, "warc"))


@query()
def op10_language(spark: SparkSession, d: str) -> DataFrame:
    """A row for each document (doc_id) and each page (page_id)."""
    docs = language.identified(language.from_documents(read(spark, d, "documents")))
    return docs.unionByName(language.identified(language.from_pages(read(spark, d, "pages"))), allowMissingColumns=True)


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY body ORDER BY doc_id DESC) = 1 AS kept,
       CAST(octet_length(encode(body)) AS BIGINT) AS n_bytes, sha256(body) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents) WINDOW w AS (PARTITION BY body)"""


@query(EXACT_SQL)
def op11_exact(spark: SparkSession, d: str) -> DataFrame:
    return exact.grouped(read(spark, d, "documents"), digests=True)


@query()
def op12_conversations(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations")
    return conversations.repair(conversations.damaged(rows), rows).withColumnRenamed("repaired", "repaired_sha256")


@query()
def op13_periodic(spark: SparkSession, d: str) -> DataFrame:
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    found = periodic.collapsed(read(spark, d, "documents"), periodic.planted)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))
