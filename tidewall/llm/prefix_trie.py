"""A trie of conversation prefixes, with subtree totals by parallel tree contraction.

Turns are dealt by ranges of (conversation, turn, order of ties), so a conversation of any length spreads over tasks;
positions and the running digests of prefixes are put together from sums inside ranges and sums over the ranges of a
conversation. A prefix's digest is the sum of wide hashes of its turns and their places: four lanes, 128 bits. Rows
with one digest at one depth are a node; its name is (conv_id, depth), the conversation being its smallest member.

Subtree totals come from rounds of joins. Rake: every leaf gives its total to its parent and goes. Compress: of a run
of nodes with one child each, nodes that are not neighbours are spliced out; the child takes their place and what
they add. A spliced node notes the child and the amount by which its own total exceeds the child's. With alternate
nodes of a run going at once, rounds are in the order of the logarithm of the nodes, however long the chains. When
only the root is left, rounds are undone in turn: a spliced node's total is its child's and the noted amount.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewall.llm.common import crc32_text, discard, stored

LANES = ("l0", "l1", "l2", "l3")
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, tie, h0, h1, chars): digests in place of role and text; ties of a turn go by the MD5 of both."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    tie = F.md5(F.concat_ws("\0", role, text))
    digest = (F.xxhash64(role, text).alias("h0"), F.xxhash64(F.lit(7), text, role).alias("h1"))
    return conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), tie.alias("tie"), *digest, F.char_length(text).cast("long").alias("chars"))


def _numbered(turns: DataFrame) -> DataFrame:
    """Turns with their range `part` and their place `at` in the conversation, from 1."""
    order = (F.col("turn").asc_nulls_first(), F.col("tie"))
    dealt = turns.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)))
    ranged = stored(dealt.repartitionByRange("conv_id", *order, "salt").withColumn("part", F.spark_partition_id()).drop("salt"), "turns")
    within = Window.partitionBy("conv_id", "part").orderBy(*order)
    sizes = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = sizes.select("conv_id", "part", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    local = ranged.withColumn("local", F.row_number().over(within)).join(before, ["conv_id", "part"])
    return local.withColumn("at", F.col("local") + F.col("before")).drop("local", "before", "turn", "tie")


def share_first_turns(turns: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, part, at, h0, h1, chars) of the rebuilt conversations out of numbered turns.

    Conversation c takes the first crc32(c) % most turns of c - c % block, then its own after as many.
    """
    convs = turns.select("conv_id").distinct().withColumn("taken", (crc32_text(F.col("conv_id")) % most).cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % block)
    heads = turns.filter(F.col("at") < most).filter(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.col("at").alias("head_at"), "h0", "h1", "chars")
    head = convs.join(heads, "base").filter(F.col("head_at") <= F.col("taken"))
    lengths = heads.groupBy("base").agg(F.count("*").alias("have"))
    shift = convs.join(lengths, "base", "left").select("conv_id", "taken", (F.col("taken") - F.least("taken", F.coalesce("have", F.lit(0)))).alias("short"))
    own = turns.join(shift, "conv_id").filter(F.col("at") > F.col("taken")).withColumn("at", F.col("at") - F.col("short"))
    columns = ("conv_id", "part", "at", "h0", "h1", "chars")
    return head.select("conv_id", F.lit(-1).alias("part"), F.col("head_at").alias("at"), "h0", "h1", "chars").unionByName(own.select(*columns))


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, key, chars): the digest of each prefix, by running sums inside ranges and over them."""
    lane = lambda seed, half: F.xxhash64(F.lit(seed), "h0", "h1", "at").bitwiseAND(0xFFFFFFFF) if half else F.shiftrightunsigned(F.xxhash64(F.lit(seed), "h0", "h1", "at"), 32)
    laned = turns.select("conv_id", "part", "at", "chars", lane(1, 0).alias("l0"), lane(1, 1).alias("l1"), lane(2, 0).alias("l2"), lane(2, 1).alias("l3"))
    sums = laned.groupBy("conv_id", "part").agg(*[F.sum(c).alias(c) for c in LANES])
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("conv_id", "part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in LANES])
    upto = Window.partitionBy("conv_id", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    run = laned.select("conv_id", "part", "at", "chars", *[F.sum(c).over(upto).alias(c) for c in LANES]).join(before, ["conv_id", "part"])
    whole = [(F.col(c) + F.col(f"before_{c}")).bitwiseAND(0xFFFFFFFF) for c in LANES]
    key = F.concat(*[F.lpad(F.hex(c), 8, "0") for c in whole])
    return run.select("conv_id", F.col("at").cast("long").alias("depth"), F.unhex(key).alias("key"), "chars")


def _digests(ends: DataFrame, piece_bytes: int = 1 << 18) -> DataFrame:
    """(conv_id, depth, ends_sha256) out of (node, depth, member): SHA-256 of the members in order, comma-joined.

    Members are put in order by ranges and joined to pieces of bounded size there; a node's pieces are then hashed
    one after another as they are read, so no task holds a node's members.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, texts, size = None, 0, [], 0
        made = lambda: pa.RecordBatch.from_pylist([{"node": key[0], "depth": key[1], "first": first, "piece": ",".join(texts)}], schema)
        schema = pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("piece", pa.string())])
        for batch in batches:
            for node, depth, member in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if (node, depth) != key or size > piece_bytes:
                    if texts:
                        yield made()
                    key, first, texts, size = (node, depth), member, [], 0
                texts.append(str(member))
                size += len(texts[-1]) + 1
        if texts:
            yield made()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running, out = None, None, []
        schema = pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
        for batch in batches:
            for node, depth, _, piece in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if (node, depth) != key:
                    if key:
                        out.append((*key, running.hexdigest()))
                    key, running = (node, depth), hashlib.sha256(piece.encode())
                else:
                    running.update(b"," + piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(schema.types)], schema=schema)
            out = []
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, running.hexdigest()), schema.types, strict=True)], schema=schema)

    by = ["node", "depth", "member"]
    joined = ends.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(pieces, "node long, depth long, first long, piece string")
    ordered = joined.repartition("node", "depth").sortWithinPartitions("node", "depth", "first")
    return ordered.mapInArrow(hashed, "node long, depth long, ends_sha256 string").withColumnRenamed("node", "conv_id")


def subtree_sums(nodes: DataFrame, sums: tuple[str, ...]) -> DataFrame:
    """(id, and for each of `sums` its total over the node's subtree) of a forest (id, parent, level long, *sums).

    Ids are of any type that has an order. The parent of a root is null. `level` tells nodes of a chain apart: any number that differs between a node and
    its child does, consecutive ones halve chains at once. What is left after each round is stored.
    """
    acc, edge, note = ([f"{kind}_{c}" for c in sums] for kind in ("acc", "edge", "note"))
    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"))
    start = nodes.join(kids, "id", "left").select("id", "parent", "level", F.coalesce("kids", F.lit(0)).alias("kids"), *[F.col(c).cast("long").alias(a) for c, a in zip(sums, acc, strict=True)], *[F.lit(0).cast("long").alias(e) for e in edge])
    leaf, now, rounds = F.col("kids") == 0, stored(start, "trie"), []
    while not now.isEmpty():
        given = now.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count_if(~leaf).alias("live"), F.max(F.when(~leaf, F.col("id"))).alias("only"), *[F.sum(F.when(leaf, F.col(a) + F.col(e))).alias(f"given_{c}") for c, a, e in zip(sums, acc, edge, strict=True)])
        bit = F.pmod(F.floor(F.col("level") / F.lit(1 << (len(rounds) % 40))), F.lit(2))
        rank = F.struct(bit.alias("bit"), F.xxhash64("id", F.lit(len(rounds))).alias("coin"), "id").alias("rank")
        left = now.filter(~leaf).drop("kids").join(given, "id").withColumns({a: F.col(a) + F.coalesce(f"given_{c}", F.lit(0)) for c, a in zip(sums, acc, strict=True)})
        left = stored(left.select("id", "parent", "level", F.col("live").alias("kids"), F.when((F.col("live") == 1) & F.col("parent").isNotNull(), F.col("only")).alias("only"), rank, *acc, *edge), "left")
        chain = left.filter("only is not null")
        pairs = chain.select(F.col("id").alias("above"), F.col("rank").alias("rank_above"), F.col("only").alias("below")).join(chain.select(F.col("id").alias("below"), F.col("rank").alias("rank_below")), "below")
        stays = pairs.select(F.when(F.col("rank_above") > F.col("rank_below"), F.col("below")).otherwise(F.col("above")).alias("id")).distinct()
        gone = chain.join(stays, "id", "left_anti").select(F.col("id").alias("gone"), "only", F.col("parent").alias("above"), *[F.col(a).alias(f"own_{c}") for c, a in zip(sums, acc, strict=True)], *[F.col(e).alias(f"up_{c}") for c, e in zip(sums, edge, strict=True)])
        gone = stored(gone, "gone")
        kept = left.drop("only", "rank").join(gone.select(F.col("gone").alias("taken")), F.col("id") == F.col("taken"), "left_anti")
        after = kept.join(gone, F.col("id") == F.col("only"), "left").select("id", F.coalesce("above", "parent").alias("parent"), "level", "kids", *acc, *[(F.col(e) + F.coalesce(F.col(f"own_{c}") + F.col(f"up_{c}"), F.lit(0))).alias(e) for c, e in zip(sums, edge, strict=True)], "gone", *[(F.col(f"own_{c}") + F.col(e)).alias(n) for c, e, n in zip(sums, edge, note, strict=True)])
        after = stored(after, "trie")
        discard(left)
        discard(gone)
        rounds.append((now.filter(leaf).select("id", *[F.col(a).alias(c) for c, a in zip(sums, acc, strict=True)]), after.filter("gone is not null").select(F.col("gone").alias("id"), F.col("id").alias("child"), *note)))
        now = after.drop("gone", *note)
    known: list[DataFrame] = []
    for raked, spliced in reversed(rounds):
        if known and not spliced.isEmpty():
            totals = reduce(DataFrame.unionByName, known).select(F.col("id").alias("child"), *sums)
            known.append(stored(spliced.join(totals, "child").select("id", *[(F.col(c) + F.col(n)).alias(c) for c, n in zip(sums, note, strict=True)]), "expanded"))
        known.append(raked)
    return reduce(DataFrame.unionByName, known) if known else start.select("id", *[F.col(a).alias(c) for c, a in zip(sums, acc, strict=True)])


def prefix_trie(conversations: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """One row of NODE for each distinct sequence of first turns of the rebuilt conversations, the root's included.

    Turns go by number, null first; turns of one number by the MD5 of role and text. Null role and text are empty.
    Rows with a null conv_id belong to no conversation. Repeated rows are turns of their own. A conversation that is
    left without turns is a member of the root alone, where it ends. Other columns are ignored; an empty table has no
    conversation and no root. Jobs run while the frame is built.
    """
    numbered = stored(_numbered(_turns(conversations)), "numbered")
    prefixes = stored(_prefixes(share_first_turns(numbered, block, most)), "prefixes")
    convs = numbered.select("conv_id").distinct()
    ends_at = prefixes.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    last = convs.join(ends_at, "conv_id", "left").select("conv_id", F.coalesce("depth", F.lit(0)).alias("depth"))
    named = prefixes.groupBy("depth", "key").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    root = convs.agg(F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("key"), F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.lit(0).cast("long").alias("chars")).filter("node is not null")
    nodes = stored(named.unionByName(root), "named")
    # a node's parent holds its smallest member, one turn before
    own = prefixes.select("conv_id", "depth", "key").unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("key")))
    above = nodes.filter("depth > 0").select("depth", "node", "n_convs", "chars").join(own.select(F.col("conv_id").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("key").alias("above_key")), ["node", "depth"])
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("above_key"), F.col("node").alias("parent"))
    placed = above.join(parents, ["depth", "above_key"]).select("node", "depth", "parent", "n_convs", "chars")
    placed = stored(placed.unionByName(nodes.filter("depth = 0").select("node", "depth", F.lit(None).cast("long").alias("parent"), "n_convs", "chars")), "placed")
    kids = placed.filter("depth > 0").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    full = stored(placed.join(kids, ["node", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    identity = F.struct("node", "depth").alias("id")
    tree = full.select(identity, F.when(F.col("depth") > 0, F.struct(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth"))).alias("parent"), F.col("depth").alias("level"), F.when(F.col("n_children") == 0, 1).otherwise(0).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    totals = subtree_sums(tree, ("n_leaves", "saved_tokens"))
    members = last.join(own, ["conv_id", "depth"]).join(nodes.select("depth", "key", "node"), ["depth", "key"]).select("node", "depth", F.col("conv_id").alias("member"))
    ends = _digests(members)
    out = full.withColumn("id", identity).join(totals, "id").join(ends.withColumnRenamed("conv_id", "node"), ["node", "depth"], "left")
    return out.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
