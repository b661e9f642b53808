"""Prefix trie of conversations from whole sequences.

Equal conversations collapse into one sequence with a weight and the list of its
conversations. A sequence that is a proper prefix of another is no leaf: an
anti-join on the digests of proper prefixes tells. Then one conversation per
sequence is enough to list prefixes, and nodes are sums of weights over these.

A turn enters as the SHA-256 of its role and text; texts are not shuffled. The
digest of a prefix is the exclusive or of 128 bits per turn and place, which is a
running aggregate: no conversation is gathered into one value, however long.

Sums over subtrees need no climbing: each node belongs to the sequence of its
smallest member, whose path it lies on. Along each sequence the nodes it owns are
added up from the end, and a node's subtree is the sum of these over all
sequences through it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenline.session import work_dir

KEY = ["depth", "a", "b"]  # a node: its depth and the two halves of its digest
PIECE = 65_536  # ids of a piece of an end list
NOTHING = hashlib.sha256(b"").hexdigest()


def _halves(turn: str, place: str) -> dict:
    return {name: F.xxhash64(F.lit(seed), F.col(turn), F.col(place)) for seed, name in enumerate("ab")}


def ordered_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 1), turn (digest of role and text) and words of each row.

    Turns go in order, null first, equal ones by digest. Rows without an id go.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("at"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("turn"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")).filter("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("at"), "turn")
    return rows.select("conv_id", F.row_number().over(order).alias("pos"), "turn", "words")


def rebuilt(turns: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """conv_id, depth, turn and words of conversations with borrowed beginnings, and a row of depth 0 for each.

    Conversation c begins with the first h turns of c - c % `every` (all if fewer,
    none if absent), h = crc32(c in decimal) % `heads`; its own turns after the
    first h follow. `turns` must be stored: it is read three times.
    """
    base = F.col("conv_id") - F.col("conv_id") % every
    head = turns.filter((F.col("conv_id") % every == 0) & (F.col("pos") < heads)).select(F.col("conv_id").alias("base"), "pos", "turn", "words")
    lent = head.groupBy("base").agg(F.max("pos").alias("lent"))
    convs = turns.groupBy("conv_id").agg(F.lit(0).alias("depth")).select(
        "conv_id", "depth", base.alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int").alias("h"))
    convs = convs.join(lent, "base", "left").withColumn("lent", F.least("h", F.coalesce("lent", F.lit(0))))
    borrowed = convs.drop("depth").join(head, "base").filter("pos <= h").select("conv_id", F.col("pos").alias("depth"), "turn", "words")
    own = turns.join(convs.select("conv_id", "h", "lent"), "conv_id").filter("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("depth"), "turn", "words")
    top = convs.select("conv_id", "depth", F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("words"))
    return top.union(borrowed).union(own)


def end_hashes(members: DataFrame) -> DataFrame:
    """The key of each sequence and ends_sha256, the hash of its conversations' ids, ascending and joined by commas.

    A sequence may have any number of conversations. Ranges of ids, which split
    large sequences, are joined to pieces in parallel; one task then reads a
    sequence's pieces in order and keeps no more than the hash's state.
    """
    key = [f"{c} {'int' if c == 'depth' else 'long'}" for c in KEY]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, []
        def out(rows):
            columns = list(zip(*((*k, i[0], ",".join(map(str, i))) for k, i in rows), strict=True)) or [()] * 5
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[*KEY, "first", "ids"])
        for batch in batches:
            done = []
            for *k, conv in zip(*(batch.column(c).to_pylist() for c in (*KEY, "conv_id")), strict=True):
                if k != now or len(ids) >= PIECE:
                    if ids:
                        done.append((now, ids))
                    now, ids = k, []
                ids.append(conv)
            yield out(done)
        if ids:
            yield out([(now, ids)])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        def out(rows):
            columns = list(zip(*((*k, s) for k, s in rows), strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.int64(), pa.int64(), pa.string()], strict=True)],
                                              names=[*KEY, "ends_sha256"])
        for batch in batches:
            done = []
            for *k, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
                if k != now:
                    if now:
                        done.append((now, state.hexdigest()))
                    now, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield out(done)
        if now:
            yield out([(now, state.hexdigest())])

    ranges = members.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    joined = ranges.mapInArrow(pieces, ", ".join([*key, "first long", "ids string"]))
    return joined.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(hashes, ", ".join([*key, "ends_sha256 string"]))


def prefix_trie(conversations: DataFrame, every: int = 20, heads: int = 4, **columns: str) -> DataFrame:
    """A row per distinct beginning of the rebuilt conversations, from the textless root.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256; see ``rebuilt`` for the beginnings and
    ``ordered_turns`` for nulls and ties. Null role or text is empty. Repeated
    rows are turns of their own. A conversation that ends up without turns is a
    member of the root. An empty table has no nodes. Other columns are ignored.
    """
    spark = conversations.sparkSession
    path = work_dir(spark, "trie")

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    turns = keep(ordered_turns(conversations, **columns), "turns")
    halves = _halves("turn", "depth")
    steps = keep(rebuilt(turns, every, heads).select(
        "conv_id", "depth", "words", *[F.when(F.col("turn").isNull(), F.lit(0).cast("long")).otherwise(h).alias(n) for n, h in halves.items()]), "steps")

    # whole sequences, each with its weight, its smallest conversation and its end list
    members = keep(steps.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")), "members")
    whole = keep(members.groupBy(*KEY).agg(F.count("*").alias("weight"), F.min("conv_id").alias("seq")), "whole")

    # prefixes of one conversation per sequence
    down = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    prefixes = steps.join(whole.select(F.col("seq").alias("conv_id"), "weight", F.col("depth").alias("length")), "conv_id").select(
        F.col("conv_id").alias("seq"), "weight", "length", "depth", "words", F.col("a").alias("own_a"), F.col("b").alias("own_b"),
        F.bit_xor("a").over(down).alias("a"), F.bit_xor("b").over(down).alias("b"))
    prefixes = keep(prefixes, "prefixes")
    proper = prefixes.filter("depth < length").select(*KEY).distinct()
    leaves = whole.join(proper, KEY, "left_anti").select("seq", F.lit(1).alias("leaf"))

    nodes = prefixes.join(leaves, "seq", "left").groupBy(*KEY).agg(
        F.sum("weight").alias("n_convs"), F.min("seq").alias("conv_id"), F.sum(F.coalesce("leaf", F.lit(0))).cast("long").alias("n_leaves"),
        F.max("words").alias("words"), F.max("own_a").alias("own_a"), F.max("own_b").alias("own_b"))
    above = {c: F.col(c).bitwiseXOR(F.col(f"own_{c}")).alias(f"above_{c}") for c in "ab"}
    nodes = keep(nodes.select(*KEY, "n_convs", "conv_id", "n_leaves", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), *above.values()), "nodes")

    # the nodes each sequence owns, summed from its end, give every subtree's sum
    up = Window.partitionBy("seq").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    owned = prefixes.select("seq", *KEY).join(nodes.select(F.col("conv_id").alias("seq"), "depth", "saved"), ["seq", "depth"], "left")
    subtree = owned.select(*KEY, F.sum(F.coalesce("saved", F.lit(0))).over(up).alias("run")).groupBy(*KEY).agg(F.sum("run").alias("saved_tokens"))
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("above_a").alias("a"), F.col("above_b").alias("b")).agg(
        F.count("*").alias("n_children"))
    full = nodes.drop("saved").join(subtree, KEY, "left").join(children, KEY, "left").join(end_hashes(members), KEY, "left")
    full = keep(full.fillna(0, ["n_children"]).fillna(NOTHING, ["ends_sha256"]), "full")

    parents = full.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("a").alias("above_a"), F.col("b").alias("above_b"),
                                                   F.col("conv_id").alias("parent_conv_id"))
    return full.join(parents, ["depth", "above_a", "above_b"], "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
