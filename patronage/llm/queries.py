"""The registered queries of this subpackage; each takes a session and a folder of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.llm import (
    centroids, conversations, decontaminate, fingerprints, language, line_dedup, mixing, secret_scan, sharding, simhash, substring_dedup, token_counts,
    url_filter,
)

#: Shards that the sharding query and the pipeline place documents on.
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
RULES = (
    url_filter.Rule("org", "/", "allow"),
    url_filter.Rule("example.org", "/es/", "block"),
    url_filter.Rule("example.org", "/en/1", "block"),
    url_filter.Rule("com", "/fr/", "allow"),
    url_filter.Rule("com", "/de/", "block"),
)
#: Tokens above which a document is over the limit.
TOKEN_LIMIT = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated windows of 20 words."""
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "spans")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle_words=3, radius=2)
    return found.select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("value")), 16, "0").alias("fingerprint"), "component_id", "kept"
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs.select("doc_id", "text"), language.learn(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that match an earlier one."""
    found = line_dedup.find_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "n_links", "removed_lines")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    found = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "block_score")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents: one row for each document and item."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), short_items=True)
    return found.select("doc_id", "item_id", "kind", "literal_words", "matched_words", "at")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.place(docs, SHARDS).select("doc_id", "slot", "shard", "shard_name")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = token_counts.count_tokens(docs, tokenizer_path(), TOKEN_LIMIT)
    return found.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix by weight takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "first_slot")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every whole vector."""
    found = centroids.cluster_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.repair(conversations.damage(rows)).drop("rows")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, in its text and below layers of encoding."""
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in secret_scan.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_simhash_near_dedup, op3_language_id, op4_line_dedup, op5_url_filter,
        op6_decontamination, op7_sharding, op8_token_counts, op9_mixing, op10_fingerprints,
        op11_centroid_clustering, op12_conversation_repair, op13_secret_scan,
    )
}


def _clustering_sql(k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, salt: str = "3") -> str:
    """k-means from its definition: all distances, the least of each vector, then means, one round after the other."""
    floored = "CAST(sum(x) AS HUGEINT) - ((CAST(sum(x) AS HUGEINT) % count(*)) + count(*)) % count(*)"
    parts = [
        f"""kept AS MATERIALIZED (
        SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {size})""",
        f"""m0 AS MATERIALIZED (
        SELECT CAST(row_number() OVER (ORDER BY sha256('{salt}:' || CAST(vec_id AS VARCHAR)), v) - 1 AS INTEGER) AS c, v FROM kept
        QUALIFY c < {k})""",
    ]
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS MATERIALIZED (
        SELECT kept.id, vec_id, kept.v, c, CAST(list_sum(list_transform(list_zip(kept.v, m{n}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
        FROM kept, m{n} QUALIFY row_number() OVER (PARTITION BY kept.id ORDER BY d, c) = 1)""")
        if n < rounds:
            parts.append(f"""m{n + 1} AS MATERIALIZED (
        SELECT m{n}.c, coalesce(moved.v, m{n}.v) AS v FROM m{n} LEFT JOIN (
            SELECT c, list(mean ORDER BY i) AS v FROM (
                SELECT c, i, CAST(({floored}) // count(*) AS BIGINT) AS mean
                FROM (SELECT c, unnest(v) AS x, unnest(range({size})) AS i FROM a{n}) GROUP BY c, i) GROUP BY c) moved USING (c))""")
    return f"""WITH {", ".join(parts)}
    SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
        CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m{rounds}.v, ',')) AS centroid_sha256
    FROM a{rounds} JOIN m{rounds} USING (c)"""


#: The others cannot be told in SQL at a bearable cost on whole tables: they hash with functions that the SQL engine
#: lacks, train, fill tables in turns, search, decode, or would compare all pairs. Tests hold each against a brute-force version.
ORACLES: dict[str, str] = {"op11_centroid_clustering": _clustering_sql()}
