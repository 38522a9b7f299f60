"""Secret scans with multipart credential linking, in DataFrame functions only.

Base findings (assignments, access identifiers, long hex) stand by themselves.
Weak candidates (a user name, an unlabelled key-like string, an endpoint) are
reported only when a complementary part lies in their scope: a key needs an
identifier or an endpoint within ``scope`` code points, those need a key.

The link is an interval join on (document, role, bin): parts are first
aggregated to one row per bin, so a document with very many parts joins in
proportion to its parts, never part by part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

# The base patterns and their minimum lengths.
ASSIGN = (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{12,}"  # 16 or more characters of AKIA[A-Z0-9]+
HEX = r"[0-9a-f]{32,}"
ASSIGN_VALUE = 8
BASE_KINDS = ("assign", "access", "hex")

# Weak parts; roles: who (identifier), key, where (endpoint).
USER = r"""(?i:\b(?:user(?:_?name)?|login|account|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{3,}"""
KEYLIKE = (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])"
           r"[A-Za-z0-9+/_=-]{20,}+")
ENDPOINT = (r"""\b[a-z][a-z0-9+.-]{1,20}+://[^\s"'<>]+|"""
            r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?(?![0-9.])")
WEAK = (("user", USER, "who"), ("keylike", KEYLIKE, "key"), ("endpoint", ENDPOINT, "where"))
ROLE_OF_BASE = {"assign": "key", "access": "who", "hex": "key"}
KIND_ORDER = (*BASE_KINDS, "user", "keylike", "endpoint")
SCOPE = 200

_PART = "array<struct<kind:string,pos:int,gap:int,size:int,ok:boolean>>"


def _gaps_and_hits(text: Column, pattern: str) -> tuple[Column, Column]:
    return F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _parts(text: Column, kind: str, pattern: str, value_length: int | None = None) -> Column:
    """Lengths of the matches of a pattern and of the gap before each, in order."""
    gaps, hits = _gaps_and_hits(text, pattern)
    ok = hits if value_length is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"), ok.alias("value"))
    rows = F.transform(zipped, lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("pos"), F.char_length(x["gap"]).alias("gap"),
        F.char_length(x["hit"]).alias("size"),
        (F.char_length(x["value"]) >= (value_length or 0)).alias("ok")))
    return F.when(text.rlike(pattern), rows).otherwise(F.array()).cast(_PART)


def _masked(text: Column, pattern: str, value_length: int | None = None) -> Column:
    """The text with each match blanked out, code point for code point; one with too short a value stays."""
    gaps, hits = _gaps_and_hits(text, pattern)
    ok = hits if value_length is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    end = F.array(F.lit(""))
    pairs = F.arrays_zip(gaps.alias("gap"), F.concat(hits, end).alias("hit"), F.concat(ok, end).alias("value"))
    blank = F.transform(pairs, lambda x: F.concat(x["gap"], F.when(
        F.char_length(x["value"]) >= (value_length or 0), F.repeat(F.lit(" "), F.char_length(x["hit"]))).otherwise(x["hit"])))
    return F.when(text.rlike(pattern), F.array_join(blank, "")).otherwise(text)


def _found(rows: DataFrame) -> DataFrame:
    """``doc_id, key, kind, start, stop`` of every base span and weak candidate."""
    base = F.concat(_parts(F.col("text"), "assign", ASSIGN, ASSIGN_VALUE),
                    _parts(F.col("text"), "access", ACCESS), _parts(F.col("text"), "hex", HEX))
    masked = rows.withColumn("base", base)
    for pattern, length in ((ASSIGN, ASSIGN_VALUE), (ACCESS, None), (HEX, None)):
        masked = masked.withColumn("text", _masked(F.col("text"), pattern, length))
    weak = [_parts(F.col("text"), kind, pattern) for kind, pattern, _ in WEAK]
    # equal rows give equal parts: distinct keeps repeated rows from counting twice
    parts = (masked.select("doc_id", "key", F.explode(F.concat("base", *weak)).alias("p"))
             .select("doc_id", "key", "p.*").distinct())
    upto = Window.partitionBy("doc_id", "key", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return (parts.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(upto)).where("ok")
            .select("doc_id", "key", "kind", (F.col("stop") - F.col("size")).alias("start"), "stop"))


def _owned(parts: DataFrame) -> DataFrame:
    """``parts`` with ``owner``: the start of the endpoint that an endpoint is or a key overlaps, null for the others.

    Neither endpoints nor keys overlap their like, so a key that begins before
    its endpoint has it as the next of both.
    """
    where, either = F.col("kind") == "endpoint", F.col("kind").isin("endpoint", "keylike")
    order = Window.partitionBy("doc_id", "key", either).orderBy("start", F.when(where, 0).otherwise(1))
    endpoint = F.when(where, F.struct("start", "stop"))
    last = F.last(endpoint, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    following = F.lead(endpoint).over(order)
    owner = F.when(last["stop"] > F.col("start"), last["start"]).when(following["start"] < F.col("stop"), following["start"])
    return parts.withColumn("owner", F.when(either, owner))


def _linked(found: DataFrame, scope: int) -> DataFrame:
    """Weak candidates with a complementary part in scope; an endpoint and a key inside it are one part."""
    roles = {**ROLE_OF_BASE, **{kind: role for kind, _, role in WEAK}}
    role = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])[F.col("kind")]
    parts = _owned(found.withColumn("role", role))
    bins = (parts.withColumn("bin", F.explode(F.sequence((F.col("start") / scope).cast("int"),
                                                         ((F.col("stop") - 1) / scope).cast("int"))))
            .groupBy("doc_id", "key", "role", "bin", "owner")
            .agg(F.min("start").alias("first"), F.max("stop").alias("last")))
    wanted = F.when(F.col("role") == "key", F.array(F.lit("who"), F.lit("where"))).otherwise(F.array(F.lit("key")))
    reach = F.sequence(F.floor((F.col("start") - scope) / scope).cast("int"),
                       ((F.col("stop") + scope) / scope).cast("int"))
    weak = (parts.where(~F.col("kind").isin(*BASE_KINDS))
            .select("doc_id", "key", "kind", "start", "stop", "owner", F.explode(wanted).alias("role"), reach.alias("reach"))
            .withColumn("bin", F.explode("reach")).drop("reach").alias("w"))
    b = bins.alias("b")
    same = (F.col("w.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("w.key") == F.col("b.key"))
            & (F.col("w.role") == F.col("b.role")) & (F.col("w.bin") == F.col("b.bin")))
    meets = ((F.col("b.last") >= F.col("w.start") - scope) & (F.col("b.first") <= F.col("w.stop") + scope)
             & (F.col("w.owner").isNull() | F.col("b.owner").isNull() | (F.col("w.owner") != F.col("b.owner"))))
    return weak.join(b, same & meets, "left_semi").select("doc_id", "key", "kind", "start", "stop").distinct()


def scan_secrets(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked``.

    Positions are code points, ends exclusive. Null and empty texts have no
    span (``base_sha256`` is that of the empty string). Repeated rows each get
    the same row, a null id stays null, extra columns are ignored, an empty
    table gives an empty result. Spans that start together are listed in
    the order of ``KIND_ORDER``.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    found = materialise(_found(rows), "secret-parts")
    spans = found.where(F.col("kind").isin(*BASE_KINDS)).unionByName(_linked(found, scope))
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KIND_ORDER) for x in (k, i)])[F.col("kind")]
    label = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("stop").cast("string"))
    item = F.struct(F.col("start"), rank.alias("rank"), F.col("stop"), label.alias("label"))
    listed = spans.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(item)).alias("all"))

    def joined(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda x: x["label"]), ",")

    def count(rank_value: int) -> Column:
        return F.coalesce(F.size(F.filter("all", lambda x: x["rank"] == rank_value)), F.lit(0)).cast("bigint")

    base_only = joined(F.filter("all", lambda x: x["rank"] < len(BASE_KINDS)))
    summary = listed.select(
        F.col("doc_id").alias("id"), F.col("key").alias("k"),
        *[count(i).alias(f"n_{kind}") for i, kind in enumerate(BASE_KINDS)],
        F.sha2(base_only, 256).alias("base_sha256"), joined(F.col("all")).alias("spans"),
        F.size(F.filter("all", lambda x: x["rank"] >= len(BASE_KINDS))).cast("bigint").alias("n_linked"))
    out = rows.select("doc_id", "key").join(
        summary, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")), "left")
    zero = [F.coalesce(f"n_{kind}", F.lit(0).cast("bigint")).alias(f"n_{kind}") for kind in BASE_KINDS]
    return out.select("doc_id", *zero, F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
                      F.coalesce("spans", F.lit("")).alias("spans"),
                      F.coalesce("n_linked", F.lit(0).cast("bigint")).alias("n_linked"))
