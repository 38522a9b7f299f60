"""Prefix trie of conversations by burst tries.

A conversation is one binary path: 20 bytes a turn, of which 16 are the turn
id (SHA-256 of role and text, cut) and 4 the UTF-8 length of the text, so the
first ``d`` turns are the first ``20 d`` bytes and byte order is order by turn
ids. Equal paths are one row with a member count, whatever their number.

Paths lie in containers under a trie head (a common prefix). A container with
more than ``limit`` paths bursts: the turns that all its paths share become
trie nodes, and the paths move to new containers by their next turn id. The
remaining containers are dealt to shards by their head, sorted and swept once
with a stack of open nodes. Subtree sums of the burst part are added up over
the recorded burst depths of each container, without walking the trie.

A container holds at most ``max(limit, paths / MAX_BURSTS)`` paths, so one
round bursts fewer than ``MAX_BURSTS`` containers; only their heads are
broadcast. A conversation is one row (20 bytes a turn) from the rebuild on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

TURN = 20  # bytes of a turn in a path
LIMIT = 4096
MAX_BURSTS = 20_000
#: turns that one burst passes at most; longer shared stretches take further rounds
STRIDE = 64
BLOCK_IDS = 4096
#: burst records up to this many bytes of prefixes are broadcast, more are left to the planner
BROADCAST_BYTES = 32 << 20
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SWEPT = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
         "saved_tokens bigint, ends_sha256 string, above binary")


def paths(turns: DataFrame) -> DataFrame:
    """``conv_id, path`` of ``turns(conv_id, turn, role, text)``.

    Turns go in ascending order, nulls first, equal ones by turn id; a null
    role or text is empty. Rows without a conv_id belong to no conversation
    and are left out. Further columns are ignored.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    code = F.concat(F.substring(F.sha2(named.cast("binary"), 256), 1, 32),
                    F.lpad(F.hex(F.octet_length(text).cast("bigint")), 8, "0"))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn").alias("turn"), code.alias("code")).alias("at"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("at")).alias("ats"))
    return ordered.select("conv_id", F.unhex(F.array_join(F.transform("ats", lambda a: a["code"]), "")).alias("path"))


def rebuild(own: DataFrame, every: int = 5, cycle: int = 9) -> DataFrame:
    """``conv_id, path`` with the first ``h`` turns taken from conversation ``c - c % every``.

    ``h`` is the unsigned crc32 of the decimal id modulo ``cycle``. A shorter
    base gives all its turns, an absent one none; the conversation's own turns
    follow after its first ``h``.
    """
    base = own.select(F.col("conv_id").alias("base_id"), F.substring("path", 1, TURN * (cycle - 1)).alias("lead"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % cycle
    rows = own.withColumn("h", h.cast("int")).withColumn("base_id", F.col("conv_id") - F.col("conv_id") % every)
    path = F.expr(f"concat(coalesce(substring(lead, 1, {TURN} * h), X''), substring(path, {TURN} * h + 1))")
    return rows.join(base, "base_id", "left").select("conv_id", path.alias("path"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ascending ids of equal paths of a sorted range, joined in blocks of ``BLOCK_IDS``."""
    path, ids, done, held = None, [], [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.int64()),
             pa.array([x[2] for x in done], pa.int64()), pa.array([x[3] for x in done], pa.string())],
            names=["path", "first_id", "n", "ids"])

    for b in batches:
        for conv_id, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if ids and (p != path or len(ids) == BLOCK_IDS):
                done.append((path, ids[0], len(ids), ",".join(map(str, ids))))
                held += len(path) + len(done[-1][3])
                ids = []
                if held > 1 << 22:
                    yield batch()
                    done, held = [], 0
            path = p
            ids.append(conv_id)
    if ids:
        done.append((path, ids[0], len(ids), ",".join(map(str, ids))))
    if done:
        yield batch()


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per path from its blocks in ascending order; the id list is only hashed, never held."""
    path, first, n, digest, out = None, None, 0, None, []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()),
             pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.string())],
            names=["path", "conv_id", "n_convs", "ends_sha256"])

    for b in batches:
        for p, first_id, k, ids in zip(*(b.column(i).to_pylist() for i in range(4))):
            if digest is not None and p == path:
                digest.update(b"," + ids.encode())
                n += k
                continue
            if digest is not None:
                out.append((path, first, n, digest.hexdigest()))
            path, first, n, digest = p, first_id, k, hashlib.sha256(ids.encode())
        if len(out) >= 4096:
            yield batch()
            out = []
    if digest is not None:
        out.append((path, first, n, digest.hexdigest()))
    if out:
        yield batch()


def distinct_paths(rebuilt: DataFrame) -> DataFrame:
    """``path, conv_id, n_convs, ends_sha256``: smallest member, members and the hash of their ascending ids.

    Splitters range over (path, conv_id), so copies of one conversation are cut
    over many ranges; only joined blocks of ids meet in the task of a path.
    """
    blocks = (rebuilt.select("conv_id", "path").repartitionByRange("path", "conv_id")
              .sortWithinPartitions("path", "conv_id")
              .mapInArrow(_blocks, "path binary, first_id bigint, n bigint, ids string"))
    return (blocks.repartition("path").sortWithinPartitions("path", "first_id")
            .mapInArrow(_join_blocks, "path binary, conv_id bigint, n_convs bigint, ends_sha256 string"))


def _prefix(path: str, turns: str):
    return F.expr(f"substring({path}, 1, {TURN} * ({turns}))")


def _sized(df: DataFrame, n_bytes: int) -> DataFrame:
    return F.broadcast(df) if n_bytes <= BROADCAST_BYTES else df


def burst(seqs: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None, int]:
    """Burst containers until each holds at most ``limit`` paths.

    Returns the paths with their container's depth ``d``, the burst records
    ``rec, cuts, d, e, n, conv_id`` (nodes of depths ``d`` to ``e``, of which
    ``rec`` is the deepest prefix and ``cuts`` the end depths of all bursts
    down to it), the paths that end at a record, and an upper bound of the
    bytes of all ``rec``.
    """
    active = seqs.withColumn("d", F.lit(0)).withColumn("cuts", F.expr("cast(array() as array<int>)"))
    settled, records, ended, record_bytes = [], [], [], 0
    while True:
        active = active.withColumn("head", _prefix("path", "d"))
        big = active.groupBy("head").agg(F.count("*").alias("held"), F.sum("n_convs").alias("n"),
                                         F.min("conv_id").alias("first_id")).where(F.col("held") > limit)
        big = materialise(big.select("head", "n", "first_id"), "trie-big")
        if big.isEmpty():
            settled.append(active.select("path", "conv_id", "n_convs", "ends_sha256", "d"))
            break
        # fewer than MAX_BURSTS rows, by the choice of the limit
        known = active.join(F.broadcast(big.select("head", "first_id")), "head")
        guide = known.where("conv_id = first_id").select(
            "head", "first_id", F.expr(f"substring(path, {TURN} * d + 1, {TURN * STRIDE})").alias("guide"))
        step = F.expr(f"size(filter(sequence(1, {STRIDE}), i -> length(substring(path, {TURN} * d + 1, {TURN} * i)) = {TURN} * i"
                      f" and substring(path, {TURN} * d + 1, {TURN} * i) = substring(guide, 1, {TURN} * i)))")
        shared = active.join(F.broadcast(guide), "head").groupBy("head", "d").agg(F.min(step).alias("step"))
        ends = materialise(shared.select("head", (F.col("d") + F.col("step")).cast("int").alias("e")), "trie-ends")
        moved = active.join(F.broadcast(ends), "head", "left").drop("head")
        moved = materialise(moved, "trie-round")
        burst_rows = moved.where("e is not null").withColumn("cuts", F.expr("concat(cuts, array(e))"))
        settled.append(moved.where("e is null").select("path", "conv_id", "n_convs", "ends_sha256", "d"))
        ended.append(burst_rows.where(f"length(path) = {TURN} * e").select(F.col("path").alias("rec"), "ends_sha256"))
        rows = burst_rows.join(F.broadcast(big.select("n", "first_id")), F.col("conv_id") == F.col("first_id"))
        record = materialise(rows.select(_prefix("path", "e").alias("rec"), "cuts", "d", "e", "n", "conv_id"), "trie-records")
        record_bytes += record.agg(F.coalesce(F.sum(F.length("rec") + 64), F.lit(0))).first()[0]
        records.append(record)
        active = (burst_rows.where(f"length(path) > {TURN} * e").withColumn("d", F.col("e") + 1)
                  .select("path", "conv_id", "n_convs", "ends_sha256", "d", "cuts"))

    def all_of(parts: list[DataFrame]) -> DataFrame | None:
        return reduce(DataFrame.unionByName, parts) if parts else None

    return all_of(settled), all_of(records), all_of(ended), int(record_bytes)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the containers of a shard, from its paths in byte order.

    Held: the open nodes of one path and their closed children, which wait for
    their parent's smallest member.
    """
    out: list[tuple] = []
    stack: list[list] = []  # depth, members, smallest, children, leaves, saved, ends, bytes, waiting rows
    head, last = 0, b""

    def close(depth: int) -> None:
        while stack and stack[-1][0] > depth:
            d, n, low, kids, leaves, saved, ends, size, waiting = stack.pop()
            saved += (n - 1) * size
            leaves = leaves if kids else 1
            out.extend((c, x, low, *rest) for c, x, *rest in waiting)
            row = (low, d, n, kids, leaves, saved, ends)
            if not stack:
                out.append((low, d, None, *row[2:], last[:TURN * (d - 1)] if d else None))
                continue
            up = stack[-1]
            up[1] += n
            up[2] = min(up[2], low)
            up[3] += 1
            up[4] += leaves
            up[5] += saved
            up[8].append((*row, None))

    def batch() -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)],
                                          names=[*NODES, "above"])

    for b in batches:
        for path, conv_id, n, ends, d in zip(*(b.column(i).to_pylist() for i in range(5))):
            same = stack and d == head and path[:TURN * d] == last[:TURN * d]
            if not same:
                close(-1)
                head, at = d, d
            else:
                at, most = d, min(len(path), len(last)) // TURN
                while at < most and path[TURN * at:TURN * at + TURN] == last[TURN * at:TURN * at + TURN]:
                    at += 1
                close(at)
                at += 1
            for x in range(at, len(path) // TURN + 1):
                stack.append([x, 0, conv_id, 0, 0, 0, NO_ENDS, int.from_bytes(path[TURN * x - 4:TURN * x], "big") if x else 0, []])
            stack[-1][1] += n
            stack[-1][2] = min(stack[-1][2], conv_id)
            stack[-1][6] = ends
            last = path
            if len(out) >= 8192:
                yield batch()
                out = []
    close(-1)
    if out:
        yield batch()


def _burst_nodes(records: DataFrame, ended: DataFrame, swept: DataFrame) -> DataFrame:
    """The nodes that bursts have made, with the sums of the containers below them."""
    size_at = "cast(conv(hex(substring(rec, {0} * x - 3, 4)), 16, 10) as bigint)".format(TURN)
    own = records.withColumn("saved", F.expr(
        f"aggregate(transform(sequence(d, e), x -> if(x = 0, 0L, (n - 1) * {size_at})), 0L, (a, v) -> a + v)"))
    heads = swept.where("above is not null").groupBy(F.col("above").alias("rec")).agg(
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below"), F.count("*").alias("heads"))
    inner = records.where("d > 0").groupBy(_prefix("rec", "d - 1").alias("rec")).agg(F.count("*").alias("inner"))
    own = own.join(heads, "rec", "left").join(inner, "rec", "left")
    own = own.withColumn("kids", F.coalesce("heads", F.lit(0)) + F.coalesce("inner", F.lit(0)))
    adds = own.select(F.explode("cuts").alias("cut"), "rec", F.coalesce("leaves", F.lit(0)).alias("leaves"),
                      (F.col("saved") + F.coalesce("below", F.lit(0))).alias("adds"))
    totals = adds.groupBy(_prefix("rec", "cut").alias("rec")).agg(F.sum("leaves").alias("n_leaves"), F.sum("adds").alias("total"))
    above = records.select(F.col("rec").alias("above"), F.col("conv_id").alias("above_id"))
    full = (own.join(totals, "rec").join(ended, "rec", "left")
            .withColumn("above", F.expr(f"if(d > 0, substring(rec, 1, {TURN} * (d - 1)), null)")).join(above, "above", "left"))
    nodes = full.withColumn("x", F.explode(F.expr("sequence(d, e)")))
    passed = f"aggregate(transform(filter(sequence(d, e), y -> y < x and y > 0), y -> (n - 1) * {size_at.replace('* x', '* y')}), 0L, (a, v) -> a + v)"
    return nodes.select(
        "conv_id", F.col("x").cast("bigint").alias("depth"), F.expr("if(x > d, conv_id, above_id)").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.expr("if(x < e, 1L, kids)").alias("n_children"), "n_leaves",
        F.expr(f"total - {passed}").alias("saved_tokens"),
        F.expr(f"if(x = e, coalesce(ends_sha256, '{NO_ENDS}'), '{NO_ENDS}')").alias("ends_sha256"))


def trie_nodes(rebuilt: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per distinct prefix of the paths in ``rebuilt(conv_id, path)``; columns ``NODES``.

    ``conv_id`` is a node's smallest member and ``parent_conv_id`` its parent's
    (null for the root); ``saved_tokens`` adds (members - 1) times the UTF-8
    bytes of the last text over the subtree; ``ends_sha256`` hashes the
    ascending ids of the members that end at the node. A conversation without
    turns ends at the root. No conversation at all gives no node. A repeated
    conv_id counts as often as it occurs (``paths`` gives each once).
    """
    seqs = materialise(distinct_paths(rebuilt), "trie-paths")
    most = max(limit, -(-seqs.count() // MAX_BURSTS))
    settled, records, ended, record_bytes = burst(seqs, most)
    swept = (settled.withColumn("head", _prefix("path", "d")).repartition("head").sortWithinPartitions("path")
             .select("path", "conv_id", "n_convs", "ends_sha256", F.col("d").cast("bigint").alias("d"))
             .mapInArrow(_sweep, SWEPT))
    if records is None:
        return swept.select(*NODES)
    swept = materialise(swept, "trie-swept")
    parents = records.select(F.col("rec").alias("above"), F.col("conv_id").alias("above_id"))
    tops = swept.where("above is not null").drop("parent_conv_id").join(_sized(parents, record_bytes), "above")
    return (swept.where("above is null").select(*NODES)
            .unionByName(tops.withColumnRenamed("above_id", "parent_conv_id").select(*NODES))
            .unionByName(_burst_nodes(records, ended, swept).select(*NODES)))


def conversation_trie(turns: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Trie nodes of the rebuilt conversations of ``turns(conv_id, turn, role, text)``."""
    return trie_nodes(materialise(rebuild(paths(turns)), "trie-rebuilt"), limit)
