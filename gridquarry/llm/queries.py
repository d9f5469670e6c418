"""The corpus operators over the tables of a data folder."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import ROW, table
from .balls import clustered
from .binpack import sharded
from .bpe import encoded
from .grace import exact_duplicates
from .mixing import mixed
from .multiset import edited_and_next
from .nbsvm import scored
from .pii import personal_data
from .resampling import resampled
from .rules import judged
from .simhash import near_duplicates
from .template import extracted
from .viterbi import token_counts

MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PATTERN = public_tokenizers.PATTERN


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), PIECES).select("doc_id", "n_tokens")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), MULTI_RANKS, PATTERN).drop(ROW)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents")).drop(ROW)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).drop(ROW)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages")).drop(ROW)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).drop(ROW)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop(ROW)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_and_next(table(spark, sf_dir, "documents")).drop(ROW)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop(ROW)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings")).drop(ROW)


QUERIES = {
    "op1_simhash_near_dedup": op1, "op2_token_counts": op2, "op3_byte_bpe": op3, "op4_pii": op4, "op5_sharding": op5,
    "op6_source_mixing": op6, "op7_exact_dedup": op7, "op8_html_extraction": op8, "op9_quality_rules": op9, "op10_quality_classifier": op10,
    "op11_document_fingerprints": op11, "op12_importance_resampling": op12, "op13_centroid_clustering": op13,
}

def _rounds(n: int) -> str:
    """SQL of the centroids c0 to c<n>, each round from the one before it."""
    out = []
    for r in range(n):
        out.append(f"""
        a{r} AS MATERIALIZED (SELECT vec_id, v, min(struct_pack(d := {DISTANCE}, k := k)) AS best FROM kept, c{r} GROUP BY ALL),
        s{r} AS MATERIALIZED (SELECT best.k AS k, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, 65) AS t(i) GROUP BY ALL),
        c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(m, c) AS c FROM c{r} LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{r} GROUP BY k) USING (k)),""")
    return "".join(out)


#: The squared distance of two lists.
DISTANCE = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT"

#: The others have no SQL: fingerprints, tokenizers, trees, packing, pages and models are tested against plain code in tests/llm.
ORACLE_SQL = {
    "op5_sharding": r"""
        WITH RECURSIVE tab AS (SELECT list_transform(range(0, 256), lambda b: list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
        d AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size, least(4096, 1 + count(*) OVER () // 8192) AS cells FROM documents),
        g AS (SELECT sha256(text) AS key, any_value(cells) AS cells, CAST(sum(size) AS BIGINT) AS whole FROM d GROUP BY ALL),
        o AS (SELECT *, row_number() OVER (ORDER BY whole DESC, CAST('0x' || substr(key, 1, 8) AS BIGINT) % cells, key) AS i, CAST(sum(whole) OVER () AS BIGINT) AS total, CAST(coalesce(sum(whole) OVER (ORDER BY whole DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS above,
                     row_number() OVER (ORDER BY whole DESC, key) AS n FROM g),
        -- the capacity at which the shards are equally full, but for those that one group overfills
        c AS (SELECT CAST(ceil((total - above) / (17 - n)) AS BIGINT) AS capacity FROM o WHERE n <= 16 AND (n = 16 OR whole * (17 - n) <= total - above) ORDER BY n LIMIT 1),
        p AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS key, CAST(-1 AS BIGINT) AS shard, [capacity FOR k IN range(0, 16)] AS rooms FROM c
              UNION ALL
              SELECT o.i, o.key, b.shard, list_transform(range(0, 16), lambda k: p.rooms[k + 1] - CASE WHEN k = b.shard THEN o.whole ELSE 0 END)
              FROM p JOIN o ON o.i = p.i + 1,
              LATERAL (SELECT coalesce(list_min(list_filter(list_transform(range(0, 16), lambda k: CASE WHEN p.rooms[k + 1] >= o.whole THEN struct_pack(r := p.rooms[k + 1], k := k) END), lambda x: x IS NOT NULL)).k,
                                       list_max(list_transform(range(0, 16), lambda k: struct_pack(r := p.rooms[k + 1], k := k))).k) AS shard) b)
        SELECT doc_id, size,
               xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) AS text_crc32,
               'bytes' AS law, CAST(shard AS INTEGER) AS shard,
               row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % cells, doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
        FROM d JOIN p ON sha256(text) = p.key, tab
    """,
    "op6_source_mixing": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, ([5.0, 2.0, 1.0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM s),
        -- sources by when they reach three times their size: as long as each is above it, it stops there
        c AS (SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
                     sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM w WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST)),
        f AS (SELECT *, bool_and(remaining * weight / weights > 3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS full_ FROM c),
        t AS (SELECT *, CAST(CASE WHEN full_ THEN 3 * source_size ELSE CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (full_) OVER (), 0) AS DOUBLE) * weight / sum(weight) FILTER (NOT full_) OVER () END AS DOUBLE) AS target FROM f),
        e AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each,
                     CAST('0x' || substr(md5(CASE WHEN source IS NULL THEN '0' ELSE '0:' || source END), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM t),
        x AS (SELECT *, length(bin(size)) AS bits, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % least(4096, 1 + count(*) OVER () // 8192) AS cell FROM d),
        r AS (SELECT x.*, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN size < 32 THEN size ELSE bits * 16 + ((size >> (bits - 5)) & 15) END, cell, size, doc_id NULLS LAST) - 1 AS place FROM x)
        SELECT doc_id, size, source_size, target, CAST(floor((place + 1) * each + u) - floor(place * each + u) AS BIGINT) * size AS taken
        FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source
    """,
    "op7_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER w = 1 AS kept,
               sha256(norm) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
    """,
    "op11_document_fingerprints": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
        e AS (SELECT *, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next_text, coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id FROM d WINDOW o AS (ORDER BY doc_id)),
        v AS MATERIALIZED (SELECT doc_id, 0 AS kind, text AS t FROM e UNION ALL SELECT doc_id, 1, substr(text, 1, n - n // 4) || substr(next_text, 1, n // 4) FROM e),
        p AS MATERIALIZED (SELECT * FROM (SELECT doc_id, kind, para, regexp_extract_all(para, '[^\x20\x09-\x0D]+') AS w FROM (SELECT doc_id, kind, unnest(string_split(t, chr(10))) AS para FROM v)) WHERE len(w) > 0),
        exact AS (SELECT doc_id, kind, i, CAST(sum(CAST('0x' || substr(sha256(para), 1 + 8 * i, 8) AS BIGINT)) % 4294967296 AS BIGINT) AS lane FROM p, range(0, 8) AS r(i) GROUP BY ALL),
        pairs AS (SELECT doc_id, kind, md5(unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) END)) AS h FROM p),
        digits AS (SELECT doc_id, kind, j, substr(h, j + 1, 1) AS digit, count(*) AS n FROM pairs, range(0, 32) AS r(j) GROUP BY ALL),
        signs AS MATERIALIZED (SELECT doc_id, kind, 4 * j + b AS i, CAST(sum(n * (2 * ((CAST('0x' || digit AS INTEGER) >> (3 - b)) & 1) - 1)) AS BIGINT) AS s FROM digits, range(0, 4) AS r(b) GROUP BY ALL),
        lanes AS (SELECT * FROM exact UNION ALL SELECT doc_id, kind, 8 + i, (s + 4294967296) % 4294967296 FROM signs),
        prints AS MATERIALIZED (SELECT doc_id, kind, string_agg(lpad(lower(hex(lane)), 8, '0'), '' ORDER BY i) AS f FROM lanes GROUP BY ALL),
        w AS (SELECT doc_id, kind, sum(s * s) AS ss FROM signs GROUP BY ALL),
        both_edited AS (SELECT a.doc_id, sum(a.s * b.s) AS dot FROM signs a JOIN signs b ON a.doc_id = b.doc_id AND a.i = b.i AND a.kind = 0 AND b.kind = 1 GROUP BY ALL),
        both_next AS (SELECT e.doc_id, sum(a.s * b.s) AS dot FROM e JOIN signs a ON a.doc_id = e.doc_id AND a.kind = 0 JOIN signs b ON b.doc_id = e.next_id AND b.kind = 0 AND a.i = b.i GROUP BY ALL),
        x AS (SELECT e.doc_id, n AS n_chars, v.t, coalesce(f0.f, repeat('0', 1088)) AS own, coalesce(f1.f, repeat('0', 1088)) AS changed, coalesce(f2.f, repeat('0', 1088)) AS following,
                     CAST(be.dot AS DOUBLE) AS dot1, CAST(bn.dot AS DOUBLE) AS dot2, CAST(coalesce(w0.ss, 0) AS DOUBLE) AS ss0, CAST(coalesce(w1.ss, 0) AS DOUBLE) AS ss1, CAST(coalesce(w2.ss, 0) AS DOUBLE) AS ss2
              FROM e JOIN v ON v.doc_id = e.doc_id AND v.kind = 1
              LEFT JOIN prints f0 ON f0.doc_id = e.doc_id AND f0.kind = 0 LEFT JOIN prints f1 ON f1.doc_id = e.doc_id AND f1.kind = 1 LEFT JOIN prints f2 ON f2.doc_id = e.next_id AND f2.kind = 0
              LEFT JOIN w w0 ON w0.doc_id = e.doc_id AND w0.kind = 0 LEFT JOIN w w1 ON w1.doc_id = e.doc_id AND w1.kind = 1 LEFT JOIN w w2 ON w2.doc_id = e.next_id AND w2.kind = 0
              LEFT JOIN both_edited be ON be.doc_id = e.doc_id LEFT JOIN both_next bn ON bn.doc_id = e.doc_id)
        SELECT doc_id, n_chars, sha256(t) AS edited_sha256, own AS fingerprint, changed AS edited_fingerprint,
               CASE WHEN own = changed THEN 1.0::DOUBLE WHEN ss0 + ss1 = 0 THEN 0 ELSE least(1, greatest(0, 2 * coalesce(dot1, 0) / (ss0 + ss1))) END AS near_edited,
               CASE WHEN own = following THEN 1.0::DOUBLE WHEN ss0 + ss2 = 0 THEN 0 ELSE least(1, greatest(0, 2 * coalesce(dot2, 0) / (ss0 + ss2))) END AS near_next
        FROM x
    """,
    "op12_importance_resampling": r"""
        WITH tab AS (SELECT list_transform(range(0, 256), lambda b: list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
        d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
        o AS MATERIALIZED (SELECT doc_id, unnest(w) AS word FROM d),
        h AS MATERIALIZED (SELECT word, xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda h: CAST('0x' || h AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) % 10000 AS bucket
                           FROM (SELECT word FROM o UNION SELECT word FROM b), tab),
        s AS (SELECT bucket, count(*) AS s FROM o JOIN h USING (word) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS t FROM b JOIN h USING (word) GROUP BY bucket),
        g AS MATERIALIZED (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM o) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
        x AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM o JOIN h USING (word) JOIN g USING (bucket) GROUP BY doc_id),
        y AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN x USING (doc_id)),
        r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM y WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM y LEFT JOIN r USING (doc_id)
    """,
    "op13_centroid_clustering": f"""
        WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, v AS c FROM kept ORDER BY sha256('3:' || vec_id) LIMIT 8),{_rounds(10)}
        z AS MATERIALIZED (SELECT vec_id, v, min(struct_pack(d := {DISTANCE}, k := k)) AS best FROM kept, c10 GROUP BY ALL)
        SELECT vec_id, CAST(best.k AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM z JOIN c10 ON c10.k = best.k
    """,
}
