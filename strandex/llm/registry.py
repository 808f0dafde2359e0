"""Queries op1_ to op13_: each operator with its production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandex.llm import fingerprint, infilling, licenses, mixing, neardup, overlap, packing, quality, substrings, tokens, topk, toxicity, yinyang
from strandex.llm._store import bound_batches, persist

#: The folder of vocabulary files is a parameter; None takes the installed package's.
TOKENIZER_DIR: str | None = None


def _tokenizer(name: str) -> str:
    if TOKENIZER_DIR:
        return f"{TOKENIZER_DIR}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _held_out(modulus: int, rest: int) -> Column:
    """Whether the fold of doc_id is held out; a null doc_id has no fold and is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest, F.lit(False))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens.count_tokens(_read(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))
    return found.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_spans(_read(spark, sf_dir, "documents"), min_words=13, outcome=substrings.KEPT_DIGEST)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.train_toxicity(docs, labels, usable=~_held_out(5, 0))
    found = toxicity.score_toxicity(docs, model)
    return found.select("doc_id", _held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return licenses.scan_documents(docs, licenses.train_licences(docs))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = persist(quality.document_statistics(_read(spark, sf_dir, "documents")), "quality-stats")
    model = quality.train_quality(stats, _read(spark, sf_dir, "labels"), usable=~_held_out(3, 1))
    found = quality.score_quality(stats, model)
    return found.select("doc_id", _held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(_read(spark, sf_dir, "documents"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), k=2, percent=80)


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.assignments(yinyang.cluster_vectors(_read(spark, sf_dir, "embeddings"), k=8, rounds=10, seed="3"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infilling.fill_in_middle(_read(spark, sf_dir, "documents"), seed="7", fim_percent=100, spm_percent=50)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    restored = infilling.restored_text(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored).alias("restored_sha256"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.jaccard_components(_read(spark, sf_dir, "documents"), k=3, percent=90)


_ALL = (
    op1_token_counts, op2_substring_dedup, op3_toxicity, op4_license_scan, op5_quality, op6_mixing, op7_fingerprints, op8_top_k,
    op9_packing, op10_near_duplicates, op11_centroid_clusters, op12_fill_in_middle, op13_jaccard_join,
)
QUERIES = {f.__name__: f for f in _ALL}


def _components_sql(k: int, percent: int, columns: str) -> str:
    """Connected components of documents whose sets of k-word shingles have a Jaccard similarity of percent or more."""
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
                   ELSE list_transform(range(1, len(w) - {k} + 2), lambda i: {gram}) END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= {percent} * (x.n + y.n - common)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
        c AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(component, d.doc_id) AS component_id{columns}
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id"""


def _lloyd_sql(k: int, rounds: int, seed: str, dims: int) -> str:
    """Lloyd's rounds over integers, each as two tables: assignments a0, a1, ... and centroids c0, c1, ..."""
    steps = [
        f"""e AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS j, v AS c FROM e QUALIFY j < {k})",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
            SELECT vec_id, v, min(struct_pack(d := d, j := j)) AS near FROM (
                SELECT rid, vec_id, v, j, CAST(list_sum(list_transform(range(1, {dims + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS d
                FROM (SELECT *, row_number() OVER () AS rid FROM e) CROSS JOIN c{r}) GROUP BY rid, vec_id, v)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
                SELECT j, coalesce(list(m ORDER BY i) FILTER (m IS NOT NULL), any_value(c)) AS c
                FROM c{r} LEFT JOIN (SELECT near.j AS j, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS m FROM a{r}, range(1, {dims + 1}) AS t(i) GROUP BY ALL) USING (j) GROUP BY j)""")
    return f"""
        WITH {", ".join(steps)}
        SELECT vec_id, CAST(near.j AS INTEGER) AS cluster, near.d AS distance, CAST(sum(near.d) OVER (PARTITION BY near.j) AS BIGINT) AS cluster_inertia,
               CAST(sum(near.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON c{rounds}.j = near.j"""


ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 11, 1))) AS i, w FROM d WHERE doc_id IS NOT NULL),
        g AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS t FROM s),
        f AS (SELECT t, min(doc_id) AS first FROM g GROUP BY t),
        r AS (SELECT DISTINCT g.doc_id, g.i + k AS i FROM g JOIN f USING (t), range(0, 13) AS o(k) WHERE f.first < g.doc_id),
        l AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
               sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
        FROM d LEFT JOIN l ON d.doc_id = l.doc_id""",
    "op6_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                   md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents),
        p AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM d GROUP BY source),
        c AS (SELECT *, CAST(2 * source_size AS DOUBLE) AS cap FROM p),
        l AS (
            SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
                   row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS turn FROM c),
        t AS (SELECT source, source_size, coalesce(least(cap, (SELECT level FROM l WHERE level * weight <= cap ORDER BY turn LIMIT 1) * weight), cap) AS target FROM l),
        b AS (
            SELECT d.doc_id, d.size, t.source_size, t.target,
                   coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CAST(least(greatest(floor(target) - before, 0), size) + least(greatest(floor(target) - source_size - before, 0), size) AS BIGINT) AS taken
        FROM b""",
    "op10_near_duplicates": _components_sql(2, 80, ", coalesce(component, d.doc_id) = d.doc_id AS kept"),
    "op11_centroid_clusters": _lloyd_sql(8, 10, "3", 64),
    "op12_fill_in_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS h FROM documents),
        r AS (SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || h[i : i + 7] AS BIGINT)) AS x FROM d),
        c AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
                     CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 100 THEN 'plain' WHEN x[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM r),
        p AS (SELECT *, array_to_string(u[1 : a], '') AS pre, array_to_string(u[a + 1 : b], '') AS mid, array_to_string(u[b + 1 : n], '') AS suf FROM c)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p""",
    "op13_jaccard_join": _components_sql(3, 90, ""),
    "op8_top_k": """
        WITH e AS MATERIALIZED (
            SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.own, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.own <> c.own AND len(q.v) = len(c.v)),
        r AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
}
