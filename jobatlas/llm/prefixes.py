"""Operator 11: a trie of conversation prefixes by ROLLUP over positional turn-id columns.

Turns are numbered per conversation and stand for (role, text) by an id.  A conversation is cut into
blocks of ``WIDTH`` turns; a block is one row whose columns ``t1, t2, ...`` hold the turns at their
places, keyed by the node at which the block before it ends.  One ``GROUP BY block, node,
ROLLUP(t1, ...)`` over all blocks then meets every prefix of every conversation at once;
``grouping_id`` tells a prefix's depth, and prefixes that only pad a short block are left out.

A node is known without a join: its key is the XOR of 128-bit hashes of (place, turn id) over its
path, so the key of a block's first node is a running XOR over the blocks before it, and a node's
parent is its own key without its last turn.  Sums over subtrees need no walk either: the smallest member of
a node owns it, what a conversation owns is a suffix of its path, and a subtree's nodes are those
owned by its members, less what the smallest member owns above.  So a second ROLLUP that adds
up one number per conversation gives them, whatever the depth.

Texts are read once and never moved: ids and lengths travel.  Roots and common first turns meet
partial sums, a node's conversation ids are joined in pieces of at most 4,096, and joins on a hot
parent are left to AQE.  Ids are exact but for 128-bit collisions.

Defined cases: null role or text counts as empty; null turns sort first; rows that repeat a turn
follow in order of their id; rows without a ``conv_id`` belong to no conversation and are left out; a
conversation without turns is a member of the root; without conversations there is no node, not even
a root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobatlas.session import cut_lineage

#: Turns of a block.  A block's row is grouped WIDTH + 1 times, so this is near the usual length.
WIDTH = 8
#: Conversation ids that share all but this many low bits are joined into one piece.
PIECE_BITS = 12

#: A node's key: its depth and the two halves of its path's hash.
KEY = ("depth", "ka", "kb")


def turn_id(role: Column, text: Column) -> Column:
    """32 hex digits that stand for a turn's role and text."""
    said = F.concat_ws(":", F.length(role), role, text)
    return F.substring(F.sha2(said.cast("binary"), 256), 1, 32)


def ordered(turns: DataFrame) -> DataFrame:
    """``(conv_id, pos, turn_id, chars)``: the turns of ``turns (conv_id, turn, role, text)`` in order, from 0."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", turn_id(role, text).alias("turn_id"),
                                                      F.length(text).cast("long").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "turn_id")
    return rows.select("conv_id", (F.row_number().over(order) - 1).alias("pos"), "turn_id", "chars")


def turn_texts(turns: DataFrame) -> DataFrame:
    """``(turn_id, role, text)``, one row per distinct turn, to put words to the ids of :func:`trie`."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return turns.select(turn_id(role, text).alias("turn_id"), role.alias("role"), text.alias("text")).dropDuplicates(["turn_id"])


def _blocks(seqs: DataFrame, convs: DataFrame, width: int) -> DataFrame:
    """A row per conversation and block: ``block``, its first node ``(pa, pb)``, ``before`` (chars up to there),
    the turns ``t1 ...`` as (a, b, chars, turn_id), and ``len`` and ``total`` of the whole conversation."""
    half = {h: F.xxhash64(F.lit(i), F.col("pos"), F.col("turn_id")) for i, h in enumerate("ab")}  # salted by place
    rows = seqs.select("conv_id", F.floor(F.col("pos") / width).cast("int").alias("block"), (F.col("pos") % width).alias("i"),
                       F.struct(half["a"].alias("a"), half["b"].alias("b"), "chars", "turn_id").alias("t"))
    placed = rows.groupBy("conv_id", "block").agg(
        *[F.first(F.when(F.col("i") == i, F.col("t")), ignorenulls=True).alias(f"t{i + 1}") for i in range(width)],
        F.bit_xor("t.a").alias("xa"), F.bit_xor("t.b").alias("xb"), F.sum("t.chars").alias("sum_chars"),
        F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def run(fn, c: str) -> Column:
        return F.coalesce(fn(c).over(earlier), F.lit(0).cast("long"))

    placed = placed.withColumns({
        "pa": run(F.bit_xor, "xa"), "pb": run(F.bit_xor, "xb"), "before": run(F.sum, "sum_chars"),
        "len": F.sum("n").over(whole), "total": F.sum("sum_chars").over(whole),
        "ea": F.bit_xor("xa").over(whole), "eb": F.bit_xor("xb").over(whole)}).drop("xa", "xb", "sum_chars", "n")
    # Conversations without a turn are rows of the root's block, as are all others.
    silent = convs.select("conv_id").distinct().join(placed.select(F.col("conv_id").alias("c")).distinct(),
                                                      F.expr("conv_id = c"), "left_anti")
    zero = [F.lit(0).cast(t).alias(c) for c, t in placed.dtypes if c in ("block", "pa", "pb", "before", "len", "total", "ea", "eb")]
    return placed.unionByName(silent.select("conv_id", *zero), allowMissingColumns=True)


def _rolled(rows: DataFrame, width: int, sums: str) -> DataFrame:
    """The prefixes of all blocks: their key, their parent's, ``upto`` (chars before the last turn), the last turn, and ``sums``."""
    names = [f"t{i + 1}" for i in range(width)]
    groups = rows.sparkSession.sql(
        f"""SELECT block, pa, pb, before, {', '.join(names)}, {width} - bit_count(grouping_id()) AS d, {sums}
            FROM {{rows}} GROUP BY block, pa, pb, before, ROLLUP({', '.join(names)})""", rows=rows)
    path = F.array(*names)
    last = F.try_element_at(path, F.col("d"))
    # A block's own d = 0 is the last node of the block before it; only the first block's is a node of its own, the root.
    kept = groups.withColumn("last", F.when(F.col("d") > 0, last)).where("last IS NOT NULL OR (d = 0 AND block = 0)")

    def key(half: str, prior: str) -> Column:
        out = F.col(prior)
        for t in names:  # deeper columns are rolled up, that is null
            out = out.bitwiseXOR(F.coalesce(F.col(t)[half], F.lit(0).cast("long")))
        return out

    chars = sum((F.coalesce(F.col(t)["chars"], F.lit(0).cast("long")) for t in names), F.col("before"))
    zero = F.lit(0).cast("long")
    out = kept.withColumns({
        "depth": (F.col("block") * width + F.col("d")).cast("long"), "ka": key("a", "pa"), "kb": key("b", "pb"),
        "last_chars": F.coalesce(F.col("last")["chars"], zero), "turn_id": F.col("last")["turn_id"]})
    return out.withColumns({
        "upto": chars - F.col("last_chars"), "up_a": F.col("ka").bitwiseXOR(F.coalesce(F.col("last")["a"], zero)),
        "up_b": F.col("kb").bitwiseXOR(F.coalesce(F.col("last")["b"], zero))}).drop("block", "pa", "pb", "before", "last", "d", *names)


def _joined_ids(ends: DataFrame) -> DataFrame:
    """``(key, n_ends, ends_sha256)``: the digest of each node's sorted conversation ids.  Ids are first joined
    in bounded pieces, then a task runs through a node's pieces in order."""
    pieces = ends.groupBy(*KEY, F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"), F.count(F.lit(1)).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, n = None, None, 0
        for b in batches:
            done = []
            for *k, ids, m in zip(*(b.column(c).to_pylist() for c in (*KEY, "ids", "n"))):
                if k != key:
                    if key is not None:
                        done.append((*key, n, state.hexdigest()))
                    key, state, n = k, hashlib.sha256(), 0
                else:
                    state.update(b",")
                state.update(ids.encode())
                n += m
            yield made(done)
        if key is not None:
            yield made([(*key, n, state.hexdigest())])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))],
            names=[*KEY, "n_ends", "ends_sha256"])

    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").mapInArrow(
        run, "depth long, ka long, kb long, n_ends long, ends_sha256 string")


def trie(seqs: DataFrame, convs: DataFrame | None = None, width: int = WIDTH) -> DataFrame:
    """The nodes of the prefix trie of ``seqs (conv_id, pos, turn_id, chars)``, as :func:`ordered` gives them.

    ``convs (conv_id)`` names the conversations, those without a turn included (default: those of ``seqs``).
    Returns ``conv_id`` (smallest member), ``depth``, ``turn_id`` (of the last turn), ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``n_ends`` and ``ends_sha256`` per node.
    """
    convs = seqs if convs is None else convs
    rows = cut_lineage(_blocks(seqs, convs, width), "trie-blocks")
    found = _rolled(rows, width, "count(1) AS n_convs, min(conv_id) AS conv_id, max(len) AS longest")
    found = cut_lineage(found.select(*KEY, "up_a", "up_b", "conv_id", "n_convs", "turn_id", "last_chars",
                                     (F.col("longest") == F.col("depth")).alias("leaf")), "trie-nodes")
    owned = found.groupBy("conv_id").agg(F.sum("last_chars").alias("own"), F.sum(F.col("leaf").cast("long")).alias("own_leaves"))
    shares = rows.join(owned, "conv_id", "left").na.fill(0, ["own", "own_leaves"])
    below = _rolled(shares, width, """count(1) AS n_convs, sum(total) AS said, sum(own) AS owned, sum(own_leaves) AS n_leaves,
                                      min(struct(conv_id, total, own)) AS first""")
    # Chars of all members from here on, less the subtree's own texts: what its members own, without the smallest one's above.
    above = F.col("upto") - F.col("first.total") + F.col("first.own")
    saved = (F.col("said") - F.col("n_convs") * F.col("upto")) - (F.col("owned") - above)
    nodes = below.select(*KEY, "up_a", "up_b", "turn_id", F.col("first.conv_id").alias("conv_id"), "n_convs", "n_leaves",
                         saved.alias("saved_tokens"))
    up = [(F.col("depth") - 1).alias("depth"), F.col("up_a").alias("ka"), F.col("up_b").alias("kb")]
    children = found.where("depth > 0").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    ends = _joined_ids(rows.select("conv_id", F.col("len").alias("depth"), F.col("ea").alias("ka"), F.col("eb").alias("kb")).distinct())
    parents = found.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("up_a"), F.col("kb").alias("up_b"),
                           F.col("conv_id").alias("parent_conv_id"))
    out = (nodes.join(children, list(KEY), "left").join(ends, list(KEY), "left")
           .join(parents, ["depth", "up_a", "up_b"], "left"))
    zero = F.lit(0).cast("long")
    return out.select("conv_id", "depth", "turn_id", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"),
                      "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
                      F.coalesce("n_ends", zero).alias("n_ends"),
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def grafted(seqs: DataFrame, group: int = 100, longest: int = 6) -> tuple[DataFrame, DataFrame]:
    """``(seqs, convs)`` with every conversation c rebuilt on the start of c - c % ``group``: that one's first h turns
    (h = crc32(c) % ``longest``; all if fewer, none if absent), then c's own after its first h."""
    seqs = cut_lineage(seqs, "trie-turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest
    # At most `longest` turns of a conversation are collected.
    heads = seqs.where(F.col("pos") < longest).groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "turn_id", "chars"))).alias("head"))
    convs = seqs.select("conv_id").distinct().withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % group})
    starts = convs.join(heads, "base", "left").select(
        "conv_id", "h", F.slice(F.coalesce("head", F.array().cast("array<struct<pos: int, turn_id: string, chars: bigint>>")),
                                F.lit(1), F.col("h").cast("int")).alias("head"))
    starts = cut_lineage(starts, "trie-starts")
    own = seqs.join(starts.select("conv_id", "h", F.size("head").alias("n")), "conv_id").where("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("n")).cast("int").alias("pos"), "turn_id", "chars")
    return starts.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*").unionByName(own), starts.select("conv_id")
