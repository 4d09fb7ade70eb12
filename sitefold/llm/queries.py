"""One registered query for each operator, with SQL where SQL can express it."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import DataFrame, SparkSession, functions as F

from sitefold.llm import (
    collocations, decontamination, language_id, line_dedup, line_frequency, near_dedup, packing, periodic_runs, secret_scan, sharding, suffix_dedup,
    token_counts, top_k,
)

QUERIES: dict = {}
CHECKS: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            CHECKS[fn.__name__] = sql
        return fn

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op1_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, folder, "documents"), shingle=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query(
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
               CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id
        WHERE q.vec_id % 20 = 0
    ), r AS (
        SELECT query_id, vec_id, score,
               CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
        FROM s
    )
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """
)
def op2_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = top_k.quantized(table(spark, folder, "embeddings"))
    return top_k.top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


@query()
def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), capacity=4096)


@query()
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify_languages(table(spark, folder, "documents"))


@query()
def op5_vector_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"), shards=40)


@query()
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), limit=4096)


@query()
def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.repeated_substrings(table(spark, folder, "documents"), length=50))


@query(
    r"""
    WITH i AS (
        SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
    ), p AS (
        SELECT DISTINCT item_id, w[a:a + least(10, len(w)) - 1] AS p
        FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS a FROM i WHERE len(w) > 0)
    ), d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM documents
    ), q AS (
        SELECT doc_id, w, len, unnest(range(1, len(w) - len + 2)) AS a FROM d, (SELECT DISTINCT len(p) AS len FROM p)
    ), h AS (
        SELECT q.doc_id, q.a, q.len, p.item_id FROM q JOIN p ON w[a:a + len - 1] = p.p
    ), c AS (
        SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(a, a + len)) AS x FROM h) GROUP BY doc_id
    ), t AS (
        SELECT doc_id, count(*) AS n, sha256(string_agg(id, ',' ORDER BY id)) AS s
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id
    )
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, coalesce(t.s, sha256('')) AS items_sha256,
           coalesce(c.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
    """
)
def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.find_benchmark(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return decontamination.digest(found)


@query(
    """
    WITH l AS (
        SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL
    ), u AS (
        SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i, len(lines) AS n FROM l
    ), h AS (
        SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS x FROM u
    ), b AS (
        SELECT *, (x + 31 * coalesce(lag(x) OVER (PARTITION BY doc_id ORDER BY i), 0)) % 4 = 0 OR i = n AS ends FROM h
    ), c AS (
        SELECT *, sum(CAST(ends AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) - CAST(ends AS INTEGER) AS no FROM b
    ), k AS (
        SELECT doc_id, no, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM c GROUP BY doc_id, no
    ), r AS (
        SELECT *, n >= 2 AND row_number() OVER (PARTITION BY body, n >= 2 ORDER BY doc_id, no) > 1 AS gone FROM k
    ), t AS (
        SELECT doc_id, string_agg(body, chr(10) ORDER BY no) FILTER (NOT gone) AS kept_text, sum(n) AS n_lines,
               sum(CASE WHEN gone THEN n ELSE 0 END) AS n_removed, count(*) FILTER (gone) AS n_chunks_removed
        FROM r GROUP BY doc_id
    )
    SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.kept_text, '') END AS kept_text,
           CAST(coalesce(t.n_lines, 1) AS BIGINT) AS n_lines, CAST(coalesce(t.n_removed, 0) AS BIGINT) AS n_removed,
           CAST(coalesce(t.n_chunks_removed, 0) AS BIGINT) AS n_chunks_removed
    FROM documents AS d LEFT JOIN t USING (doc_id)
    """
)
def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, folder, "documents")).drop("text")


@query()
def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(table(spark, folder, "documents")))


def periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a tail that repeats, for a tenth of the documents by their doc_id."""
    h, n = crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query()
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.periodic_runs(table(spark, folder, "documents"), rewrite=periodic_tail))


@query(
    r"""
    WITH d AS (
        SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), t AS (
        SELECT doc_id, w[i:i + 2] AS p, i FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
    ), p AS (
        SELECT doc_id, list(i) AS places FROM t GROUP BY doc_id, p HAVING count(*) > 1
    ), c AS (
        SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS x FROM (SELECT doc_id, unnest(places) AS i FROM p))
        GROUP BY doc_id
    ), l AS (
        SELECT doc_id, source, text, line,
               regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^\x20\x09-\x0D]+') AS v
        FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d)
    ), u AS (
        SELECT doc_id, source, text, line, array_to_string(v, ' ') AS norm, len(v) AS n FROM l WHERE len(v) > 0
    ), h AS (
        SELECT source, count(DISTINCT text) AS n_host FROM u GROUP BY source
    ), m AS (
        SELECT f.source, f.norm
        FROM (SELECT source, norm, count(DISTINCT text) AS n FROM u GROUP BY source, norm) AS f
        JOIN h ON f.source IS NOT DISTINCT FROM h.source
        WHERE f.n > 10 AND f.n * 1000 > h.n_host
    ), g AS (
        SELECT u.doc_id, count(*) - count(DISTINCT u.line) AS dup, sum(CASE WHEN m.norm IS NOT NULL THEN u.n ELSE 0 END) AS gone
        FROM u LEFT JOIN m ON u.source IS NOT DISTINCT FROM m.source AND u.norm = m.norm
        GROUP BY u.doc_id
    ), r AS (
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(length(array_to_string(d.w, '')) AS BIGINT) AS word_chars,
               CAST(len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(g.dup, 0) AS BIGINT) AS n_dup_lines,
               CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(g.gone, 0) AS BIGINT) AS gone
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN g USING (doc_id)
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - gone) >= 50 * n_words AS kept
    FROM r
    """
)
def op12_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return line_frequency.digest(line_frequency.quality_verdicts(table(spark, folder, "documents")))


@query(
    r"""
    WITH s AS (
        SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
               regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
        FROM documents
    ), w AS (
        SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM s)
    ), g AS (
        SELECT lang, k, w[i:i + k - 1] AS p
        FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)
    ), f AS (
        SELECT lang, k, p, count(*) AS f FROM g GROUP BY lang, k, p
    ), n AS (
        SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
    ), c AS (
        SELECT lang, k, p, f AS a FROM f WHERE k > 1 AND f >= 10
    ), x AS (
        SELECT c.lang, c.p, c.a, j, h.f AS l, t.f AS r, CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(h.f AS HUGEINT) * t.f) AS score
        FROM (SELECT *, unnest(range(1, k)) AS j FROM c) AS c
        JOIN f AS h ON h.lang = c.lang AND h.p = c.p[1:j]
        JOIN f AS t ON t.lang = c.lang AND t.p = c.p[j + 1:c.k]
    ), b AS (
        SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1
    ), o AS (
        SELECT lang, q, max(a) AS m FROM (SELECT lang, a, unnest([p[1:2], p[2:3]]) AS q FROM c WHERE k = 3) GROUP BY lang, q
    ), e AS (
        SELECT b.*, array_to_string(b.p, ' ') AS phrase FROM b LEFT JOIN o ON o.lang = b.lang AND o.q = b.p WHERE o.m IS NULL OR 100 * o.m < 50 * b.a
    ), z AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM e
    )
    SELECT z.lang, z.rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM z JOIN n USING (lang) WHERE z.rank <= 2000
    """
)
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))
