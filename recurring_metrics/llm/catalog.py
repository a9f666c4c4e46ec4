"""The queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from recurring_metrics.llm import (
    bpe_chunks,
    embedding_itq,
    exact_dedup,
    language_id,
    license_scan,
    merkle_manifest,
    minhash_dedup,
    packing,
    prefix_trie,
    secret_forest,
    token_counts,
    toxicity,
    warc_dict,
)
from recurring_metrics.sources.io import scratch_path


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_embedding_itq(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector with its links and component."""
    return embedding_itq.near_vectors(_table(spark, folder, "embeddings"))


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the one that stays for its text."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return exact_dedup.label_copies(docs).select(
        "doc_id", "copies.keep_id", "copies.group_size", "copies.kept", "copies.text_sha256"
    )


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document in its training window."""
    return packing.pack(_table(spark, folder, "documents"))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The token count of every document."""
    return token_counts.count_tokens(_table(spark, folder, "documents"))


def op5_warc_dict(spark: SparkSession, folder: str) -> DataFrame:
    """Every page, written to archives in the shared folder and read back."""
    pages = _table(spark, folder, "pages")
    return warc_dict.round_trip(spark, pages, scratch_path(spark, "warc")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from three quarters of the labelled ones."""
    docs = _table(spark, folder, "documents")
    model = language_id.fit(docs.where(~language_id.held_out()))
    # The held-out mark depends on the id alone and joins nothing.
    return language_id.predict(docs, model).select(
        "doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score"
    )


def op7_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its component of near duplicates."""
    return minhash_dedup.near_duplicates(_table(spark, folder, "documents"))


def op8_secret_forest(spark: SparkSession, folder: str) -> DataFrame:
    """Every place of a secret in the documents."""
    model = secret_forest.fit(secret_forest.sample_findings(spark))
    return secret_forest.scan(_table(spark, folder, "documents"), model)


def op9_bpe_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    encoded = bpe_chunks.encode(_table(spark, folder, "documents"))
    return bpe_chunks.decode(encoded).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every license template found in every document."""
    return license_scan.scan(_table(spark, folder, "documents"))


def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity of every document, learned from two thirds of the labelled ones."""
    docs = _table(spark, folder, "documents")
    model = toxicity.fit(docs, _table(spark, folder, "labels").where(~toxicity.held_out()))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its leaf, its proof and whether the text that arrived still fits."""
    docs = _table(spark, folder, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    made = merkle_manifest.manifest_with_check(docs, {"text": F.when(chosen, lowered).otherwise(F.col("text"))})
    return made.select(
        "doc_id", "leaf", "subroot", "root", merkle_manifest.proof_digest().alias("proof_sha256"),
        "folded_root", "verified",
    )


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    return prefix_trie.prefix_trie(_table(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_itq": op1_embedding_itq,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_packing": op3_packing,
    "op4_token_counts": op4_token_counts,
    "op5_warc_dict": op5_warc_dict,
    "op6_language_id": op6_language_id,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_secret_forest": op8_secret_forest,
    "op9_bpe_chunks": op9_bpe_chunks,
    "op10_license_scan": op10_license_scan,
    "op11_toxicity": op11_toxicity,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": corpus_pipeline.run,
}

# Levels that cover more rows and languages than the sample tables have.
LEAF_LEVELS, NAME_LEVELS = 8, 3


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit: a byte is followed by eight shifts."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [unicode(c), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return (
        f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}::BIGINT[]), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) "
        "ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"
    )


def _manifest_sql() -> str:
    """Levels of the language trees (t) and of the tree of languages (u), then proofs and folds level by level."""

    def field(name: str) -> str:
        return f"coalesce(CAST(strlen(CAST({name} AS VARCHAR)) AS VARCHAR) || ':' || CAST({name} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(f) for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def up(name: str, level: int) -> str:
        return f"""{name}{level + 1} AS (
            SELECT part, place // 8 AS place, any_value((total + 7) // 8) AS total,
                   CASE WHEN any_value(total) > 1 THEN sha256(string_agg(node, '' ORDER BY place)) ELSE any_value(node) END AS node
            FROM {name}{level} GROUP BY part, place // 8)"""

    def way(name: str, level: int) -> str:
        """Left and right siblings at a level; NULL once the tree has ended."""
        return f"""w_{name}{level} AS (
            SELECT part, place, total > 1 AS goes_on,
                   coalesce(string_agg(node, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                   coalesce(string_agg(node, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
            FROM {name}{level} WINDOW r AS (PARTITION BY part, place // 8 ORDER BY place))"""

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"""leaves AS (
            SELECT doc_id, coalesce('=' || lang, '') AS part, {leaf("text")} AS node,
                   CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {leaf(lowered)} ELSE {leaf("text")} END AS seen
            FROM documents)""",
        """numbered AS (
            SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, node) - 1 AS place,
                   count(*) OVER (PARTITION BY part) AS total FROM leaves)""",
        "t0 AS (SELECT part, place, total, node FROM numbered)",
        *[up("t", k) for k in range(LEAF_LEVELS)],
        f"""u0 AS (SELECT '' AS part, part AS name, node, row_number() OVER (ORDER BY part) - 1 AS place,
                          count(*) OVER () AS total FROM t{LEAF_LEVELS})""",
        *[up("u", k) for k in range(NAME_LEVELS)],
        *[way("t", k) for k in range(LEAF_LEVELS)],
        *[way("u", k) for k in range(NAME_LEVELS)],
        f"""f0 AS (
            SELECT n.doc_id, n.part, n.place, n.node AS leaf, n.seen AS folded, '' AS proof, top.node AS subroot,
                   root.node AS root, u0.place AS name_place
            FROM numbered n JOIN t{LEAF_LEVELS} top USING (part) JOIN u0 ON u0.name = n.part CROSS JOIN u{NAME_LEVELS} root)""",
    ]
    steps = [("t", k, "f.part", "f.place") for k in range(LEAF_LEVELS)]
    steps += [("u", k, "''", "f.name_place") for k in range(NAME_LEVELS)]
    for i, (name, k, part, place) in enumerate(steps):
        parts.append(
            f"""f{i + 1} AS (
            SELECT f.doc_id, f.part, f.place, f.leaf, f.subroot, f.root, f.name_place,
                   CASE WHEN w.goes_on THEN sha256(w.l || f.folded || w.r) ELSE f.folded END AS folded,
                   CASE WHEN w.goes_on THEN f.proof || w.l || w.r ELSE f.proof END AS proof
            FROM f{i} f JOIN w_{name}{k} w ON w.part = {part} AND w.place = {place} // {8**k})"""
        )
    return "WITH " + ", ".join(parts) + f"""
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
        FROM f{len(steps)}"""


ORACLES: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH bodies AS (
            SELECT doc_id, length(coalesce(text, '')) AS size,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
            FROM documents),
        ranked AS (
            SELECT doc_id, body,
                   row_number() OVER (PARTITION BY body ORDER BY size DESC, doc_id) AS place,
                   first_value(doc_id) OVER (PARTITION BY body ORDER BY size DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY body) AS group_size
            FROM bodies)
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256
        FROM ranked""",
    "op12_merkle_manifest": _manifest_sql(),
    "op13_prefix_trie": rf"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(text, '') AS text,
                   substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || strlen(coalesce(text, '')) || ':'
                                 || coalesce(text, '')), 1, 32) AS name
            FROM conversations WHERE conv_id IS NOT NULL),
        own AS (
            SELECT conv_id, name, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, name) AS n
            FROM said),
        convs AS (
            SELECT conv_id, conv_id - conv_id % 20 AS head, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h
            FROM (SELECT DISTINCT conv_id FROM own)),
        built AS (
            SELECT c.conv_id, 0 AS part, n, name, words FROM convs c JOIN own ON own.conv_id = c.head AND n <= h
            UNION ALL
            SELECT c.conv_id, 1, n, name, words FROM convs c JOIN own ON own.conv_id = c.conv_id AND n > h),
        paths AS (
            SELECT conv_id, words, row_number() OVER w AS depth, string_agg(name, '') OVER w AS path
            FROM built WINDOW w AS (PARTITION BY conv_id ORDER BY part, n)
            UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
        members AS (
            SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM paths),
        nodes AS (
            SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own_saved,
                   coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ended
            FROM members GROUP BY path, depth),
        children AS (
            SELECT substr(path, 1, (depth - 1) * 32) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
        counted AS (
            SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (path)),
        sums AS (
            SELECT substr(path, 1, k * 32) AS path, sum(own_saved) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
            FROM (SELECT path, own_saved, n_children, unnest(range(depth + 1)) AS k FROM counted) GROUP BY 1)
        SELECT c.conv_id, c.depth, up.conv_id AS parent_conv_id, c.n_convs, c.n_children, CAST(leaves AS BIGINT) AS n_leaves,
               CAST(saved AS BIGINT) AS saved_tokens, sha256(c.ended) AS ends_sha256
        FROM counted c JOIN sums USING (path)
        LEFT JOIN nodes up ON c.depth > 0 AND up.path = substr(c.path, 1, (c.depth - 1) * 32)""",
    "op1_embedding_itq": """
        WITH RECURSIVE sound AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
              AND len([x FOR x IN embedding IF x <> 0]) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b
            FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
        reach(a, b) AS (
            SELECT a, b FROM links
            UNION
            SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        lowest AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
        counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links,
               least(vec_id, coalesce(b, vec_id)) AS component_id,
               vec_id = least(vec_id, coalesce(b, vec_id)) AS kept
        FROM embeddings LEFT JOIN lowest ON vec_id = lowest.a LEFT JOIN counts ON vec_id = counts.a""",
    "op5_warc_dict": """
        WITH sized AS (
            SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM pages),
        grouped AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS largest FROM sized)
        SELECT page_id, n AS payload_bytes, sha1(body) AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> largest THEN largest END AS refers_to
        FROM grouped""",
}
