"""Registered queries of the document operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, exact_dedup, fingerprints, hard_negatives, langid, mixing, pii, prefix_trie, quality, secrets, simhash,
               token_store, warc)
from .common import read_documents


WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read_documents(spark, sf_dir, "doc_id", "text"), tokenizer_path(WORD_BPE))


def domain_labels(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, domain``: the language of the documents that the ``labels`` table covers."""
    covered = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").select("doc_id")
    return docs.select("doc_id", docs["lang"].alias("domain")).join(covered, "doc_id", "left_semi")


#: target weights of the mixture: English two parts, every other language one, whatever the corpus holds
DOMAIN_WEIGHTS = mixing.Weights({"en": 2.0})


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir, "doc_id", "text", "lang")
    return mixing.mixing_rates(docs, domain_labels(spark, docs, sf_dir), DOMAIN_WEIGHTS)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read_documents(spark, sf_dir, "doc_id", "text"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(read_documents(spark, sf_dir, "doc_id", "text"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_components(read_documents(spark, sf_dir, "doc_id", "text"), width=3, radius=3)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_documents(spark, sf_dir, "doc_id", "text"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").select("doc_id", "quality")
    return quality.score_documents(docs, quality.fit(docs, labels))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_documents(spark, sf_dir, "doc_id", "text", "lang"))


#: a deployment passes its own key, kept outside the code
QUERY_KEY = "query-key-not-secret"


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read_documents(spark, sf_dir, "doc_id", "text"), key=QUERY_KEY)


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.store_path(spark)
    token_store.write_token_store(read_documents(spark, sf_dir, "doc_id", "text"), path, tokenizer_path(BYTE_BPE), end_id=2)
    return token_store.stream_index(token_store.read_token_store(spark, path))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows with an id divisible by 50; ids divisible by 7 take the next label."""
    table = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    label = F.col("label").cast("bigint")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.where(finite).select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        (F.col("vec_id") % 50 == 0).alias("anchor"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("ints"))
    return hard_negatives.mine(rows)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet").select("page_id", "url", "html")
    return warc.through_archives(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return prefix_trie.conversation_trie(turns)


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_mixing": op2_mixing,
    "op3_secrets": op3_secrets,
    "op4_fingerprints": op4_fingerprints,
    "op5_simhash": op5_simhash,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_quality": op7_quality,
    "op8_langid": op8_langid,
    "op9_pii": op9_pii,
    "op10_token_store": op10_token_store,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_warc": op12_warc,
    "op13_prefix_trie": op13_prefix_trie,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op6_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
        FROM t JOIN g USING (text_sha256)""",
    "op11_hard_negatives": """
        WITH e AS (
            SELECT row_number() OVER () AS k, vec_id,
                   CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.k AS ak, a.vec_id AS anchor_id, b.k AS bk, b.vec_id AS vec_id, a.label = b.label AS same,
                     CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
              FROM e a JOIN e b ON a.k <> b.k WHERE a.vec_id % 50 = 0),
        p AS (SELECT ak, anchor_id, bk, vec_id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY ak ORDER BY score DESC, vec_id, bk) <= 5)
        SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id,
               positive_score, s.score AS negative_score
        FROM p JOIN s ON p.ak = s.ak AND NOT s.same
         AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
        WINDOW w AS (PARTITION BY p.ak, p.bk ORDER BY s.score DESC, s.vec_id, s.bk)
        QUALIFY row_number() OVER w <= 3""",
    "op12_warc": """
        WITH t AS (SELECT row_number() OVER () AS k, page_id, coalesce(html, '') AS html FROM pages),
        p AS (SELECT k, page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, sha256(html) AS same FROM t),
        o AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN row_number() OVER w ELSE 1 END AS place, first_value(page_id) OVER w AS stands
              FROM p WINDOW w AS (PARTITION BY same, payload_bytes ORDER BY page_id DESC NULLS LAST, k DESC))
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN place > 1 THEN stands END AS refers_to
        FROM o""",
    "op13_prefix_trie": """
        WITH t AS (SELECT conv_id, turn, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x
                   FROM conversations WHERE conv_id IS NOT NULL),
        own AS (SELECT conv_id, list(x ORDER BY turn NULLS FIRST, x) AS xs FROM t GROUP BY 1),
        h AS (SELECT *, CAST(xor(list_reduce(list_prepend(4294967295::BIGINT,
                            list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                        lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
                            lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)),
                        4294967295::BIGINT) % 9 AS BIGINT) AS h FROM own),
        c AS (SELECT h.conv_id, list_concat(coalesce(b.xs[1:h.h], []), h.xs[h.h + 1:]) AS xs
              FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 5),
        m AS (SELECT conv_id, d, xs[1:d] AS p, len(xs) = d AS is_end
              FROM (SELECT *, unnest(range(len(xs) + 1)) AS d FROM c)),
        n AS (SELECT p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                     sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256,
                     CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(p[-1].t) END AS own
              FROM m GROUP BY p, d),
        k AS (SELECT p[1:depth - 1] AS p, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
        f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (p, depth)),
        u AS (SELECT p[1:d] AS p, d AS depth, sum(own) AS saved, count(*) FILTER (n_children = 0) AS leaves
              FROM (SELECT *, unnest(range(depth + 1)) AS d FROM f) GROUP BY 1, 2)
        SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children,
               u.leaves AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, f.ends_sha256
        FROM f JOIN u ON f.p = u.p AND f.depth = u.depth
        LEFT JOIN n q ON f.depth > 0 AND q.depth = f.depth - 1 AND q.p = f.p[1:f.depth - 1]""",
}
