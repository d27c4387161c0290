"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.centroids import cluster_vectors
from skein.llm.common import id_mod, read_table
from skein.llm.decontaminate import contamination
from skein.llm.exact_dedup import exact_groups
from skein.llm.fim import fill_in_middle, restore
from skein.llm.html_text import extract_pages
from skein.llm.lang_id import identify, train_language_id
from skein.llm.lm import score
from skein.llm.packing import pack
from skein.llm.quality import THRESHOLD as QUALITY_THRESHOLD
from skein.llm.quality import score_quality, train_quality
from skein.llm.secret_scan import find_secrets, spans_text
from skein.llm.sharding import shard_by_bytes
from skein.llm.simhash import near_duplicates
from skein.llm.toxicity import CHAIN
from skein.llm.toxicity import THRESHOLD as TOXIC_THRESHOLD
from skein.llm.toxicity import score_toxicity, train_toxicity


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = identify(docs, train_language_id(docs), carry=("doc_id",)).select("doc.doc_id", "lang_pred", "score")
    return found.select("doc_id", (id_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = shard_by_bytes(read_table(spark, sf_dir, "documents"))
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = score_quality(docs, train_quality(docs, labels), carry=("doc_id",)).select("doc.doc_id", "score")
    return scored.select(
        "doc_id",
        (id_mod(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"),
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, id_mod(F.col("doc_id"), 7) != 2)
    return scored.select("doc_id", (id_mod(F.col("doc_id"), 7) == 2).alias("held_out"), *scored.columns[1:])


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return exact_groups(docs, digest_all=True, carry=("doc_id",)).select(
        F.col("doc.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read_table(spark, sf_dir, "documents"), carry=("doc_id",))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("doc.doc_id").alias("doc_id"),
        *(count(k) for k in ("assign", "access", "hex")),
        F.sha2(spans_text("base").cast("binary"), 256).alias("base_sha256"),
        spans_text("spans").alias("spans"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), carry=("doc_id",))
    return found.select(
        F.col("doc.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = score_toxicity(docs, train_toxicity(docs, labels), carry=("doc_id",)).select("doc.doc_id", *CHAIN)
    return scored.select(
        "doc_id",
        (id_mod(F.col("doc_id"), 4) == 2).alias("held_out"),
        *CHAIN[:-1],
        F.col("toxic").alias("score"),
        (F.col("toxic") >= TOXIC_THRESHOLD).cast("int").alias("predicted"),
    )


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read_table(spark, sf_dir, "documents"), carry=("doc_id",))
    return made.select("doc.doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", restore(F.col("output"), F.col("form"), digest_only=True).alias("restored_sha256"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster_vectors(read_table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_pages(read_table(spark, sf_dir, "pages"), carry=("page_id", "url"))
    return found.select("page.page_id", "page.url", "text", "n_chars")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_language_id, op2_simhash, op3_sharding, op4_quality, op5_lm_scoring, op6_packing, op7_exact_dedup, op8_secrets, op9_decontamination,
        op10_toxicity, op11_fim, op12_centroids, op13_html_text,
    )
    return {f.__name__: f for f in found}


OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS width, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS key
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS r(i)
  WHERE len(w) > 0
), widths AS (SELECT DISTINCT width FROM bw),
dw AS (
  SELECT doc_id, i, width, array_to_string(w[i : i + width - 1], ' ') AS key
  FROM d, widths, unnest(range(1, greatest(1, len(w) - width + 2))) AS r(i)
), hit AS (
  SELECT doc_id, i, dw.width, item_id FROM dw JOIN bw ON dw.key = bw.key AND dw.width = bw.width
), cover AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, width FROM hit), unnest(range(i, i + width)) AS q(p) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN it USING (doc_id)
"""


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), u AS (
  SELECT *, CAST(len(lines) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(lines) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(lines) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM t
), v AS (
  SELECT *, array_to_string(lines[1 : least(a, b)], '') AS p, array_to_string(lines[least(a, b) + 1 : greatest(a, b)], '') AS m,
         array_to_string(lines[greatest(a, b) + 1 : n], '') AS s
  FROM u
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM v
"""


def _op12_sql() -> str:
    """k-means in long form: one row a vector and component, one a centroid and component, for each round in turn."""
    near = """a{r} AS MATERIALIZED (
  SELECT id, first(k ORDER BY d, k) AS k, min(d) AS d
  FROM (SELECT id, k, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{r} AS c USING (i) GROUP BY id, k) GROUP BY id
)"""
    move = """c{n} AS MATERIALIZED (
  SELECT c.k, c.i, coalesce(m.x, c.x) AS x
  FROM c{r} AS c LEFT JOIN (SELECT k, i, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS HUGEINT) AS x FROM v JOIN a{r} USING (id) GROUP BY k, i) AS m ON m.k = c.k AND m.i = c.i
)"""
    steps = [
        """e AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
)""",
        "v AS MATERIALIZED (SELECT id, i, CAST(floor(1024 * CAST(embedding[i] AS DOUBLE)) AS HUGEINT) AS x FROM e, unnest(range(1, 65)) AS r(i))",
        "f AS (SELECT id, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR))) - 1 AS k FROM e QUALIFY k < 8)",
        "c0 AS MATERIALIZED (SELECT k, i, x FROM v JOIN f USING (id))",
    ]
    for r in range(10):
        steps += [near.format(r=r), move.format(r=r, n=r + 1)]
    steps.append(near.format(r=10))
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a10 AS a JOIN e USING (id) JOIN (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c10 GROUP BY k) AS c ON c.k = a.k
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": OP7_SQL, "op9_decontamination": OP9_SQL, "op11_fim": OP11_SQL, "op12_centroids": _op12_sql()}
