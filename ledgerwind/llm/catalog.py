"""The corpus queries by name, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwind.llm import bpe_transducer, chat_events, cross_entropy, histogram_sort, host_rules, packing, pii_bootstrap, pu_quality, records, residual_pq, simhash_golay, va_file, whitening
from ledgerwind.llm.shared import shared_path, table, text_bytes
from ledgerwind.llm.word_tokens import default_path


def op1_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all other vectors for each vec_id divisible by 20; ties, nulls and repeats as va_file.top_k says."""
    vectors = table(spark, sf_dir, "embeddings")
    return va_file.top_k(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


OP1_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op2_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as records, read back: doc_id, start, n_tokens, ids_crc32; edge rows as records.write_records says."""
    folder = shared_path(spark, "records")
    records.write_records(table(spark, sf_dir, "documents"), folder, default_path(), end=1)
    return records.digests(spark, folder)


def op3_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in documents: base counts and digest, all spans, and secrets; edge rows as pii_bootstrap.find says."""
    return pii_bootstrap.find(table(spark, sf_dir, "documents"))


def op4_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents packed into sequences of 4096 ids in the sources' proportions; edge rows as packing.pack says."""
    return packing.pack(table(spark, sf_dir, "documents"), default_path(), end=2).select(*packing.NAMES)


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts for documents; edge rows as host_rules.judge says."""
    return host_rules.judge(table(spark, sf_dir, "documents"))


#: Counts, base rules and soft rules of each document as CTE `r`; then hosts, their prior and verdicts.
OP5_SQL = r"""
WITH d AS (
    SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
    FROM documents
), g AS (
    SELECT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram, i FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), often AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1
), repeated AS (
    SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM often) GROUP BY doc_id
), c AS (
    SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines
    FROM d LEFT JOIN repeated USING (doc_id)
), r AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        CAST(10 * n_symbols > n_words AS INT) + CAST(10 * n_dup_lines > 3 * n_lines AS INT)
            + CAST(word_chars NOT BETWEEN 2 * n_words AND 15 * n_words AS INT) AS n_soft
    FROM c
), hosts AS (
    SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(base_failed OR n_soft > 0 AS INT)) AS DOUBLE) AS bad FROM r GROUP BY source
), moments AS (
    SELECT sum(bad) / sum(n) AS mean, sum(n * (bad / n) * (bad / n)) / sum(n) AS squares, count(*) / sum(n) AS share FROM hosts
), prior AS (
    SELECT mean, CASE WHEN v > 0 THEN least(greatest(mean * (1 - mean) / v - 1, 1.0), 1e4) ELSE 1e4 END AS strength
    FROM (SELECT mean, squares - mean * mean - mean * (1 - mean) * share AS v FROM moments)
), verdicts AS (
    SELECT source, CASE WHEN rate <= 0 THEN 99 WHEN rate >= 1 THEN -1
        ELSE greatest(-1, least(99, floor(ln((1 - rate) / rate) / ln(20)))) END AS allowed
    FROM (SELECT source, (bad + mean * strength) / (n + strength) AS rate FROM hosts, prior)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_soft <= allowed AS kept
FROM r JOIN verdicts ON r.source IS NOT DISTINCT FROM verdicts.source
"""


def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of documents, as digests; edge rows as bpe_transducer.digests says."""
    return bpe_transducer.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of documents; edge rows as pu_quality.score says."""
    return pu_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations and conversation -1, made a log, folded, formatted and read back; edge rows as chat_events says."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_events.read_back(chat_events.format_log(chat_events.from_turns(rows)))


#: Escaping puts one character into each control string and each backslash, so lengths need only their number.
OP8_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)
), turns AS (
    SELECT *, length(text) + len(regexp_extract_all(text, '\\|</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]|\[/MSG\]')) AS body,
        CASE role WHEN 'system' THEN 19 WHEN 'user' THEN 15 WHEN 'assistant' THEN 4
            ELSE 21 + length(role) + len(regexp_extract_all(role, '\\|</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]|\[/MSG\]')) END AS marks
    FROM rows
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(3 + sum(body + marks) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op9_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of documents, those of quality 1 being the target; edge rows as cross_entropy.score says."""
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    return cross_entropy.score(table(spark, sf_dir, "documents"), good, default_path())


def op10_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of documents; edge rows as simhash_golay.near_duplicates says."""
    return simhash_golay.near_duplicates(table(spark, sf_dir, "documents"))


def op11_tsqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings whitened by 16 components; a deviation that no long can hold is an error, other edge rows as whitening.whiten says."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op12_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in 24 shards of nearly equal bytes; edge rows as histogram_sort.deal says."""
    dealt = histogram_sort.deal(table(spark, sf_dir, "documents"), shards=24)
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return dealt.select("doc_id", histogram_sort.size().alias("size"), F.crc32(text_bytes()).alias("text_crc32"), law, "shard", "slot", grown)


#: CRC-32 by its table of remainders; splitters at the end of a text's group where near enough, else at the nearest row.
OP12_SQL = r"""
WITH bits AS (
    SELECT list(c ORDER BY n) AS remainders FROM (
        SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS n)
    )
), d AS (
    SELECT doc_id, coalesce(text, '') AS t, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size,
        CAST('0x' || left(md5(coalesce(text, '')), 15) AS BIGINT) AS k0, CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 15) AS BIGINT) AS k1
    FROM documents
), r AS (
    SELECT *, sum(size) OVER (ORDER BY k0, k1 ROWS UNBOUNDED PRECEDING) - size AS s, sum(size) OVER () AS total FROM d
), g AS (
    SELECT k0, min(s) AS s, sum(size) AS size FROM r GROUP BY k0
), t AS (
    SELECT i, i * total AS target, total FROM range(1, 24) v(i), (SELECT sum(size) AS total FROM d)
), splitters AS (
    SELECT i, CASE WHEN 200 * abs(24 * a.edge - a.target) <= total THEN a.edge ELSE b.edge END AS edge
    FROM (SELECT i, target, total, CASE WHEN 2 * target >= 24 * (2 * s + size) THEN s + size ELSE s END AS edge FROM t JOIN g ON 24 * s <= target AND target < 24 * (s + size)) a
    JOIN (SELECT i, CASE WHEN 2 * target >= 24 * (2 * s + size) THEN s + size ELSE s END AS edge FROM t JOIN r ON 24 * s <= target AND target < 24 * (s + size)) b USING (i)
), dealt AS (
    SELECT doc_id, t, size, k0, k1, (SELECT count(*) FROM splitters WHERE edge <= s) AS shard FROM r
)
SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
        lambda c, b: xor(c >> 8, remainders[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32,
    'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY k0, k1) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM dealt, bits
"""


def op13_residual_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for each vec_id divisible by 100, some labels moved on by one; edge rows as residual_pq.mine says."""
    vectors = table(spark, sf_dir, "embeddings")
    vectors = vectors.withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    return residual_pq.mine(vectors, vectors.filter("vec_id % 100 = 0"), positive=5, negative=5, least=80, most=100)


OP13_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id
    WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score
    FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM scored WHERE same) WHERE n <= 5
), ranked AS (
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
        vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT * FROM ranked WHERE rank <= 5
"""


QUERIES = {
    "op1_va_file": op1_va_file,
    "op2_binary_records": op2_binary_records,
    "op3_pii_bootstrap": op3_pii_bootstrap,
    "op4_mixture_packing": op4_mixture_packing,
    "op5_host_rules": op5_host_rules,
    "op6_bpe_transducer": op6_bpe_transducer,
    "op7_pu_quality": op7_pu_quality,
    "op8_chat_events": op8_chat_events,
    "op9_cross_entropy": op9_cross_entropy,
    "op10_simhash_golay": op10_simhash_golay,
    "op11_tsqr_whitening": op11_tsqr_whitening,
    "op12_histogram_sort": op12_histogram_sort,
    "op13_residual_pq": op13_residual_pq,
}
ORACLES: dict[str, str] = {"op1_va_file": OP1_SQL, "op5_host_rules": OP5_SQL, "op8_chat_events": OP8_SQL, "op12_histogram_sort": OP12_SQL, "op13_residual_pq": OP13_SQL}
