"""Prefix trie of conversations, as a z-fast trie that Spark tables hold.

A conversation is a path of turns.  Every prefix has a 128-bit key, so that equal prefixes have
equal keys and a prefix of any length is one look-up away in ``paths``.  The trie is compacted:
a node stands for an edge, the depths above ``top`` down to ``bottom`` of one conversation that
represents it.  Nodes are hashed at their handle, the prefix whose length is the two-fattest
number in (top, bottom].

Conversations come in batches.  A batch finds where it leaves the trie by fat binary search: in
each round all its conversations look up the prefix of two-fattest length between what is known
to be inside and what may still be, a join with the handles, and log2(depth) rounds end at the
exit node.  Only turns beyond it are grouped into new nodes; the edges that new conversations
leave half-way are split.  In the end the edges are expanded to one row per depth.

What a subtree holds (members, least id, leaves, words) is added up by pointer doubling: after
round i every node has the totals of its descendants less than 2^i edges below.

Defined results: null role and text are empty; turns of a null id take no part; turns are ordered
by turn, null first, ties by a digest of role and text; repeated rows are turns of their own; very
long texts only pass through a hash and a word count; an empty table gives no rows; columns
besides conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.session import materialise, ship_package

FAMILY, SHARED_TURNS = 20, 4
#: The first batch holds about this share of the distinct conversations, the last one the rest.
FIRST_SHARE = 16
CHUNK = 1 << 16  # characters of ids joined before they meet in one digest
KEY = ("ka", "kb")


# -- paths ---------------------------------------------------------------------------


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, content, words), pos from 0; texts stay where they were read."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    narrow = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, F.lit(":"), text)).alias("content"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "content")
    return narrow.select("conv_id", (F.row_number().over(order) - 1).alias("pos"), "content", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, content, words): the first turns of the family's conversation, then the own ones.

    Depth 0 is there for every conversation, also one without turns.
    """
    base = F.expr(f"conv_id - conv_id % {FAMILY}")
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED_TURNS).cast("int")
    heads = turns.where((F.col("conv_id") == base) & (F.col("pos") < SHARED_TURNS - 1))
    sizes = heads.groupBy(F.col("conv_id").alias("base")).agg(F.count(F.lit(1)).cast("int").alias("base_turns"))
    convs = turns.select("conv_id").distinct()
    borrowed = convs.select("conv_id", base.alias("base"), shared.alias("h")).join(
        heads.withColumnRenamed("conv_id", "base"), "base").where("pos < h").select(
        "conv_id", (F.col("pos") + 1).alias("depth"), "content", "words")
    taken = F.least("h", F.coalesce("base_turns", F.lit(0)))
    own = turns.withColumns({"base": base, "h": shared}).where("pos >= h").join(sizes, "base", "left").select(
        "conv_id", (F.col("pos") - F.col("h") + taken + 1).alias("depth"), "content", "words")
    top = convs.select("conv_id", F.lit(0).alias("depth"), F.lit("").alias("content"), F.lit(0).cast("long").alias("words"))
    return top.union(borrowed).union(own)


def prefix_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, ka, kb, pa, pb, words, words_above, turns): the key of every prefix, and of the one before.

    The key is the exclusive or of hashes of (depth, turn) under two seeds; the root's is zero.
    """
    along = W.partitionBy("conv_id").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    hashed = {name: F.when(F.col("depth") > 0, F.xxhash64(F.lit(seed), "depth", "content")).otherwise(F.lit(0).cast("long"))
              for name, seed in (("ha", 11), ("hb", 23))}
    keyed = turns.withColumns(hashed).select(
        "conv_id", "depth", "words", "ha", "hb", F.bit_xor("ha").over(along).alias("ka"), F.bit_xor("hb").over(along).alias("kb"),
        (F.sum("words").over(along) - F.col("words")).alias("words_above"),
        F.max("depth").over(W.partitionBy("conv_id")).alias("turns"))
    return keyed.select("conv_id", "depth", "ka", "kb", F.col("ka").bitwiseXOR(F.col("ha")).alias("pa"),
                        F.col("kb").bitwiseXOR(F.col("hb")).alias("pb"), "words", "words_above", "turns")


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the greatest power of two divides."""
    bits = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return high.bitwiseAND(F.call_function("shiftleft", F.lit(-1), bits))


# -- search --------------------------------------------------------------------------


def with_handles(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes with their handle (length f, key ha, hb) and the key (sa, sb) at which the edge starts."""
    fat = nodes.withColumn("f", two_fattest(F.col("top"), F.col("bottom")))
    at = paths.select(F.col("conv_id").alias("rep"), "depth", "ka", "kb")
    handled = fat.join(at.toDF("rep", "f", "ha", "hb"), ["rep", "f"])
    return handled.withColumn("first", F.col("top") + 1).join(at.toDF("rep", "first", "sa", "sb"), ["rep", "first"])


def locate(batch: DataFrame, paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv_id, turns, shared, na, nb) of every conversation of the batch: how many of its turns the
    trie shares, and the key of the node whose edge it leaves before the end (null at an edge's end).

    ``nodes`` carry handles.
    """
    longest = batch.agg(F.coalesce(F.max("turns"), F.lit(0))).first()[0]
    handles = nodes.select("f", "ha", "hb", F.col("bottom").alias("fb"), F.col("na").alias("fna"), F.col("nb").alias("fnb"), F.col("rep").alias("frep"))
    own = paths.select("conv_id", F.col("depth").alias("f"), F.col("ka").alias("ha"), F.col("kb").alias("hb"))
    state = batch.select("conv_id", "turns", F.lit(0).alias("low"), F.col("turns").alias("high"), F.lit(0).alias("inside"),
                         *[F.lit(None).cast("long").alias(c) for c in ("na", "nb", "rep")], F.lit(0).alias("bottom"))
    for _ in range(longest.bit_length()):
        asked = state.withColumn("f", F.when(F.col("low") < F.col("high"), two_fattest(F.col("low"), F.col("high"))))
        met = asked.join(own, ["conv_id", "f"], "left").join(handles, ["f", "ha", "hb"], "left")
        hit, miss = F.col("fb").isNotNull(), F.col("f").isNotNull() & F.col("fb").isNull()
        state = materialise(met.select(
            "conv_id", "turns", F.when(hit, F.col("fb")).otherwise(F.col("low")).alias("low"),
            F.when(miss, F.col("f") - 1).otherwise(F.col("high")).alias("high"),
            F.when(hit, F.col("f")).otherwise(F.col("inside")).alias("inside"),
            F.when(hit, F.col("fna")).otherwise(F.col("na")).alias("na"), F.when(hit, F.col("fnb")).otherwise(F.col("nb")).alias("nb"),
            F.when(hit, F.col("frep")).otherwise(F.col("rep")).alias("rep"),
            F.when(hit, F.col("fb")).otherwise(F.col("bottom")).alias("bottom")), "fat-search")
    return _exits(state, paths, nodes)


def _exits(state: DataFrame, paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """From the deepest node whose handle a conversation has to the place where it leaves the trie.

    That is inside the node's edge, at its end, or inside the edge of the child that the next
    turn starts, before the child's handle.
    """
    own = paths.select("conv_id", "depth", "ka", "kb")
    ends = own.toDF("conv_id", "bottom", "ea", "eb")
    nexts = own.toDF("conv_id", "first", "sa", "sb")
    children = nodes.select("first", "sa", "sb", F.col("na").alias("cna"), F.col("nb").alias("cnb"), F.col("rep").alias("crep"), F.col("bottom").alias("cbottom"))
    at_end = state.join(ends, ["conv_id", "bottom"], "left").withColumn(
        "whole", (F.col("bottom") == 0) | F.coalesce((F.col("ea") == F.col("na")) & (F.col("eb") == F.col("nb")), F.lit(False)))
    stepped = at_end.withColumn("first", F.when(F.col("whole") & (F.col("turns") > F.col("bottom")), F.col("bottom") + 1)).join(
        nexts, ["conv_id", "first"], "left").join(children, ["first", "sa", "sb"], "left")
    child = F.col("crep").isNotNull()
    edge = materialise(stepped.select(
        "conv_id", "turns",
        F.when(child, F.col("first")).when(F.col("whole"), F.col("bottom")).otherwise(F.col("inside")).alias("sure"),
        *[F.when(child, F.col(f"c{c}")).when(~F.col("whole"), F.col(c)).alias(c) for c in ("na", "nb", "rep")],
        F.when(child, F.col("cbottom")).when(~F.col("whole"), F.col("bottom")).alias("bottom")), "exit-edges")
    last = F.least("turns", "bottom")
    walked = edge.where(F.col("sure") < last).select("conv_id", "rep", F.explode(F.sequence(F.col("sure") + 1, last)).alias("depth"))
    theirs = own.withColumnRenamed("conv_id", "rep")
    common = walked.join(own, ["conv_id", "depth"]).join(theirs, ["rep", "depth", *KEY]).groupBy("conv_id").agg(F.max("depth").alias("walked"))
    placed = edge.join(common, "conv_id", "left").withColumn("shared", F.coalesce("walked", "sure"))
    inside = F.col("rep").isNotNull() & (F.col("shared") < F.col("bottom"))
    return placed.select("conv_id", "turns", "shared", *[F.when(inside, F.col(c)).alias(c) for c in ("na", "nb")])


# -- insertion -----------------------------------------------------------------------


def new_nodes(located: DataFrame, paths: DataFrame) -> DataFrame:
    """(rep, top, bottom, na, nb): the compacted nodes of what the batch's conversations do not share."""
    own = paths.join(located.select("conv_id", "shared"), "conv_id").where(F.col("depth") > F.col("shared"))
    beyond = materialise(own.select("conv_id", "depth", "ka", "kb", "pa", "pb", "shared", (F.col("depth") == F.col("turns")).alias("end")), "beyond")
    prefixes = beyond.groupBy("depth", *KEY).agg(
        F.min("conv_id").alias("rep"), F.max("end").alias("end"), F.first("pa").alias("pa"), F.first("pb").alias("pb"))
    forks = prefixes.groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count(F.lit(1)).alias("branches"))
    explicit = prefixes.join(forks, ["depth", *KEY], "left").where(F.col("end") | (F.col("branches") > 1)).select("depth", *KEY, "rep")
    above = F.lag("depth").over(W.partitionBy("conv_id").orderBy("depth"))
    marked = beyond.select("conv_id", "depth", *KEY, "shared").join(explicit, ["depth", *KEY])
    return marked.select("*", F.coalesce(above, F.col("shared")).alias("top")).where(F.col("conv_id") == F.col("rep")).select(
        "rep", "top", F.col("depth").alias("bottom"), F.col("ka").alias("na"), F.col("kb").alias("nb"))


def split_nodes(nodes: DataFrame, located: DataFrame, paths: DataFrame) -> DataFrame:
    """The nodes, cut where conversations of the batch leave an edge before its end."""
    inside = located.where("na is not null").select("conv_id", F.col("shared").alias("depth"), "na", "nb")
    at = inside.join(paths.select("conv_id", "depth", *KEY), ["conv_id", "depth"]).select("na", "nb", F.col("depth").alias("bottom"), *KEY).distinct()
    plain = nodes.select("na", "nb", "rep", "top", "bottom", F.col("na").alias("ka"), F.col("nb").alias("kb"))
    cut = at.join(nodes.select("na", "nb", "rep", "top"), ["na", "nb"]).select(*plain.columns)
    above = F.lag("bottom").over(W.partitionBy("na", "nb").orderBy("bottom"))
    return plain.union(cut).select("rep", F.coalesce(above, F.col("top")).alias("top"), "bottom", F.col("ka").alias("na"), F.col("kb").alias("nb"))


def compacted_trie(paths: DataFrame, chosen: DataFrame, first_share: int = FIRST_SHARE, batches: int = 2) -> DataFrame:
    """(rep, top, bottom, na, nb): all nodes but the root, after the ``chosen`` conversations (conv_id, turns)
    were inserted batch by batch; each batch is ``first_share`` times the one before, about."""
    deal = F.pmod(F.xxhash64("conv_id"), F.lit(first_share ** (batches - 1)))
    limits = [first_share ** n for n in range(batches)]
    none = [F.lit(None).cast("long").alias(c) for c in ("na", "nb")]
    first = chosen.where(deal < limits[0]).select("conv_id", "turns", F.lit(0).alias("shared"), *none)
    nodes = materialise(new_nodes(first, paths), "trie")
    for before, limit in zip(limits, limits[1:]):
        batch = chosen.where((deal >= before) & (deal < limit))
        located = materialise(locate(batch, paths, materialise(with_handles(nodes, paths), "handles")), "located")
        nodes = materialise(split_nodes(nodes, located, paths).union(new_nodes(located, paths)), "trie")
    return nodes


# -- expansion and totals ------------------------------------------------------------


def subtree_totals(own: DataFrame) -> DataFrame:
    """``own`` has (na, nb, ua, ub, members, least, leaves, weighed, words) per node, (ua, ub) the parent's key
    or null; the result has the sums (of ``least``, the minimum) over subtrees instead."""
    sums = {"members": F.sum, "leaves": F.sum, "weighed": F.sum, "words": F.sum, "least": F.min}
    totals = own
    while not totals.where("ua is not null").isEmpty():
        below = totals.where("ua is not null").groupBy(F.col("ua").alias("na"), F.col("ub").alias("nb")).agg(
            *[how(c).alias(f"_{c}") for c, how in sums.items()])
        further = totals.select(F.col("na").alias("ua"), F.col("nb").alias("ub"), F.col("ua").alias("_ua"), F.col("ub").alias("_ub"))
        joined = totals.join(below, ["na", "nb"], "left").join(further.where("_ua is not null"), ["ua", "ub"], "left")
        added = [(F.least(c, f"_{c}") if how is F.min else F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c, how in sums.items()]
        totals = materialise(joined.select("na", "nb", F.col("_ua").alias("ua"), F.col("_ub").alias("ub"), *added), "subtrees")
    return totals.drop("ua", "ub")


def ends_digest(ends: DataFrame) -> DataFrame:
    """(ka, kb, digest): SHA-256 of the ascending ids of the conversations that end with that key, comma-joined.

    Ids are range-partitioned by (key, id) and joined to chunks where they lie, so that of a key
    that very many share only chunks meet in one task, which digests them as a stream.
    """
    def chunks(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                                              ["ka", "kb", "start", "ids"])

        key, start, ids, size = None, None, [], 0
        for part in batches:
            for row in zip(*(part.column(c).to_pylist() for c in ("ka", "kb", "conv_id"))):
                if row[:2] != key or size > CHUNK:
                    if ids:
                        yield batch([(*key, start, ",".join(ids))])
                    key, start, ids, size = row[:2], row[2], [], 0
                ids.append(str(row[2]))
                size += len(ids[-1]) + 1
        if ids:
            yield batch([(*key, start, ",".join(ids))])

    def digests(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, digest, done = None, None, []
        for part in batches:
            for ka, kb, ids in zip(*(part.column(c).to_pylist() for c in ("ka", "kb", "ids"))):
                if (ka, kb) == key:
                    digest.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (ka, kb), hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["ka", "kb", "digest"])
                done = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, digest.hexdigest())], ["ka", "kb", "digest"])

    order = ["ka", "kb", "conv_id"]
    joined = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        chunks, "ka long, kb long, start long, ids string")
    return joined.repartition("ka", "kb").sortWithinPartitions("ka", "kb", "start").mapInArrow(digests, "ka long, kb long, digest string")


def prefix_trie(conversations: DataFrame, first_share: int = FIRST_SHARE, batches: int = 2) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, the root included."""
    ship_package(conversations.sparkSession)
    paths = materialise(prefix_paths(rebuilt(materialise(ordered_turns(conversations), "turns"))), "paths")
    ends = paths.where("depth = turns")
    groups = materialise(ends.groupBy(*KEY, "turns").agg(
        F.count(F.lit(1)).alias("members"), F.min("conv_id").alias("least"), F.max(F.col("words_above") + F.col("words")).alias("path_words")), "ends")
    chosen = groups.where("turns > 0").select(F.col("least").alias("conv_id"), "turns")
    nodes = compacted_trie(paths, chosen, first_share, batches)

    rows = nodes.select("*", F.explode(F.sequence(F.col("top") + 1, F.col("bottom"))).alias("depth")).join(
        paths.select(F.col("conv_id").alias("rep"), "depth", "pa", "pb", "words", "words_above"), ["rep", "depth"])
    expanded = materialise(rows.select(
        "na", "nb", "depth", "top", "bottom", "pa", "pb", "words", "words_above"), "expanded")

    heads = expanded.where(F.col("depth") == F.col("top") + 1).select("na", "nb", F.col("pa").alias("ua"), F.col("pb").alias("ub"), F.col("words_above").alias("words_to_top"))
    lengths = expanded.groupBy("na", "nb").agg(F.sum("words").alias("words"))
    children = materialise(heads.groupBy(F.col("ua").alias("na"), F.col("ub").alias("nb")).agg(F.count(F.lit(1)).alias("children")), "children")
    root = conversations.sparkSession.createDataFrame(
        [(0, 0, None, None, 0, 0)], "na long, nb long, ua long, ub long, words_to_top long, words long")
    tree = heads.join(lengths, ["na", "nb"]).union(root)
    ending = groups.select(F.col("ka").alias("na"), F.col("kb").alias("nb"), "members", "least", "path_words")
    own = materialise(tree.join(ending, ["na", "nb"], "left").join(children, ["na", "nb"], "left").select(
        "na", "nb", "ua", "ub", "words_to_top", "words", F.coalesce("members", F.lit(0)).alias("members"), "least",
        F.when(F.col("children").isNull(), 1).otherwise(0).cast("long").alias("leaves"), F.coalesce("children", F.lit(0)).alias("children"),
        F.coalesce(F.col("members") * F.col("path_words"), F.lit(0)).alias("weighed")), "nodes")
    totals = materialise(subtree_totals(own.drop("words_to_top", "children")), "totals")
    parents = totals.select(F.col("na").alias("ua"), F.col("nb").alias("ub"), F.col("least").alias("above"))
    about = totals.withColumnRenamed("words", "subtree_words").join(own.select("na", "nb", "ua", "ub", "words_to_top", "children"), ["na", "nb"]).join(parents, ["ua", "ub"], "left")

    root_row = root.select("na", "nb", F.lit(0).alias("depth"), F.lit(-1).alias("top"), F.lit(0).alias("bottom"), "words", F.lit(0).cast("long").alias("words_above"))
    every = expanded.select(*root_row.columns).union(root_row)
    digests = ends_digest(ends).toDF("na", "nb", "digest")
    last, first = F.col("depth") == F.col("bottom"), F.col("depth") == F.col("top") + 1
    above_here = F.col("words_above") - F.col("words_to_top")
    saved = F.col("weighed") - F.col("words_above") * F.col("members") - (F.col("subtree_words") - above_here)
    return every.join(about.drop("ua", "ub"), ["na", "nb"]).join(digests, ["na", "nb"], "left").where("members > 0").select(
        F.col("least").alias("conv_id"), F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") > 0, F.when(first, F.col("above")).otherwise(F.col("least"))).alias("parent_conv_id"),
        F.col("members").alias("n_convs"), F.when(last, F.col("children")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"),
        saved.alias("saved_tokens"), F.when(last & F.col("digest").isNotNull(), F.col("digest")).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"))
