"""N-gram Jaccard join: MinHash bands retrieve, full n-gram sets decide.

1. Texts with one n-gram set form a class; only classes go on, so copies never meet in pairs.
2. A class has ``bands * rows`` minima.  The numbers are chosen for a target recall: a pair at
   the threshold t shares a band with probability 1 - (1 - t**rows) ** bands.
3. Classes are shuffled on their band hashes.  Each is tied to the least class of its bucket
   (not to every other), and ties are joined into candidate groups.
4. A group is cut into blocks of bounded size; each pair of blocks is one task's work, in which
   all pairs are decided on their full sets.  No pair leaves the task: what leaves is the number
   of links per class and a spanning tree of them.  So a group of thousands of near copies costs
   rows in proportion to its size times its blocks, and loses no link.

Recall is that of the bands at least, since a block also compares pairs that share no band.

Defined results: texts without words (null, empty) are in no class and have no links; texts of
fewer words than an n-gram have one n-gram, all their words; repeated rows and null ids each
get their row; ties take the least id.  Columns besides the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Admitted, binary_values, filter_bits, keyed_rows, same_document, shingle_hashes, sliced, words_of
from tidewatch.llm.components import components
from tidewatch.session import materialise, share

NGRAM, THRESHOLD, RECALL, ROWS = 5, Fraction(4, 5), 0.995, 6
#: Bounds of a block, in expectation: its classes and their n-grams.
BLOCK_CLASSES, BLOCK_GRAMS = 1024, 1_000_000
_FILTER_BITS = 1 << 23


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """The least number of bands that reaches the recall at the threshold."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold ** rows)))


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band of the minima of ``bands * rows`` permutations."""
    generator = np.random.default_rng(7)
    odd = generator.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    shift = generator.integers(0, 1 << 63, bands * rows, np.uint64)
    minima = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(grams), 256):  # stay within the processor's cache
        mixed = grams[start:start + 256, None] * odd + shift
        np.minimum(minima, (mixed ^ (mixed >> np.uint64(32))).min(axis=0), out=minima)
    hashes = np.zeros(bands, np.uint64)
    for column in minima.reshape(bands, rows).T:
        hashes = (hashes ^ column) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(31)
    return hashes.view(np.int64)


def _set_key(grams: np.ndarray) -> str | None:
    import hashlib

    return hashlib.blake2b(grams.tobytes(), digest_size=16).hexdigest() if len(grams) else None


def _signatures(documents: DataFrame, size: int, bands: int, rows: int, id_column: str, text_column: str) -> DataFrame:
    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in sliced(batches):
            sets = [shingle_hashes(words_of(text), size) for text in binary_values(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(map(_set_key, sets), pa.string()), pa.array([len(g) for g in sets], pa.int64()),
                 pa.array([band_hashes(g, bands, rows) if len(g) else None for g in sets], pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "set_key", "n_grams", "bands"])

    text = F.col(text_column).cast("string")
    return documents.select(F.col(id_column).cast("long"), text, F.xxhash64(text)).mapInArrow(
        sign, "doc_id long, text_key long, set_key string, n_grams long, bands array<long>")


def _texts(documents: DataFrame, keys: DataFrame, size: int, text_column: str) -> DataFrame:
    """(set_key, words) once per class among ``keys``; a fixed-size filter keeps other texts from travelling."""
    bits = share(documents.sparkSession, filter_bits(keys, F.col("set_key"), _FILTER_BITS))

    def pick(batches: Iterator) -> Iterator:
        import pyarrow as pa

        admitted = Admitted(bits.value)
        for batch in sliced(batches):
            keys, texts = [], []
            for text in binary_values(batch.column(0)):
                words = words_of(text)  # of one text at a time
                key = _set_key(shingle_hashes(words, size))
                if key and admitted[key.encode()]:
                    keys.append(key)
                    texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], names=["set_key", "words"])

    # Copies combine before the shuffle; any text of the class gives the same set.
    return documents.select(F.col(text_column).cast("string")).mapInArrow(pick, "set_key string, words string").groupBy(
        "set_key").agg(F.first("words").alias("words"))


def overlap_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two lists of distinct sorted sets.

    Members in few sets are counted one by one, the others by a matrix product.
    """
    sets = [*left, *right]
    if not sets:
        return np.zeros((len(left), len(right)), np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    in_left = owner < len(left)
    n_left = np.bincount(column[in_left], minlength=column.max(initial=-1) + 1)
    n_right = np.bincount(column[~in_left], minlength=len(n_left))
    counts = np.zeros((len(left), len(right)), np.int64)
    common = np.flatnonzero(n_left * n_right > 64)
    place = np.full(len(n_left), -1)
    for start in range(0, len(common), 4096):
        part = common[start:start + 4096]
        place[part] = np.arange(len(part))
        spot, here = place[column], np.zeros((len(sets), len(part)), np.float32)
        here[owner[spot >= 0], spot[spot >= 0]] = 1
        counts += (here[:len(left)] @ here[len(left):].T).astype(np.int64)
        place[part] = -1
    few = (n_left * n_right > 0) & (n_left * n_right <= 64)
    order = np.argsort(column, kind="stable")
    order = order[few[column[order]]]
    lefts, rights = order[in_left[order]], order[~in_left[order]]
    first = np.searchsorted(column[rights], column[lefts])  # every left member meets its column's right ones
    each = n_right[column[lefts]]
    step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    np.add.at(counts, (np.repeat(owner[lefts], each), owner[rights[np.repeat(first, each) + step]] - len(left)), 1)
    return counts


def linked(left: list[np.ndarray], right: list[np.ndarray], threshold: Fraction) -> np.ndarray:
    """Which sets reach the Jaccard threshold, in whole numbers."""
    shared = overlap_counts(left, right)
    sizes = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :]
    p, q = threshold.numerator, threshold.denominator
    return (shared > 0) & (shared * (p + q) >= p * sizes)


def _spanning(adjacent: np.ndarray) -> np.ndarray:
    """The least index reachable from each node of a symmetric adjacency matrix."""
    labels = np.arange(len(adjacent))
    while True:
        least = np.minimum(labels, np.where(adjacent, labels[None, :], len(labels)).min(axis=1, initial=len(labels)))
        least = np.minimum(least, least[least])
        if (least == labels).all():
            return labels
        labels = least


def _compare(documents: DataFrame, members: DataFrame, size: int, threshold: Fraction, text_column: str) -> DataFrame:
    """(set_key, root, n_links) per class and pair of blocks, of classes with links."""
    measured = members.groupBy("component").agg(F.count("*").alias("classes"), F.sum("n_grams").alias("grams"))
    blocks = F.greatest(F.ceil(F.col("classes") / BLOCK_CLASSES), F.ceil(F.col("grams") / BLOCK_GRAMS), F.lit(1))
    placed = (members.join(measured.select("component", blocks.cast("int").alias("blocks")), "component")
              .withColumn("block", F.pmod(F.xxhash64("set_key"), "blocks").cast("int")))
    work = (_texts(documents, members, size, text_column).join(placed, "set_key")
            .select("component", "block", "set_key", "words", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
            .select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                    "block", "set_key", "words"))

    def decide(group):
        import pyarrow as pa

        low, high = group["low"][0].as_py(), group["high"][0].as_py()
        keys, blocks = np.array(group["set_key"].to_pylist(), object), group["block"].to_numpy()
        sets = [shingle_hashes(text.split(b" "), size) for text in binary_values(group["words"].combine_chunks())]
        first, second = np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
        met = linked([sets[i] for i in first], [sets[i] for i in second], threshold)
        adjacent = np.zeros((len(sets), len(sets)), bool)
        if low == high:
            np.fill_diagonal(met, False)
        adjacent[np.ix_(first, second)] |= met
        adjacent[np.ix_(second, first)] |= met.T
        links = adjacent.sum(axis=1)
        some = np.flatnonzero(links)
        return pa.table({"set_key": pa.array(keys[some], pa.string()), "root": pa.array(keys[_spanning(adjacent)[some]], pa.string()),
                         "n_links": pa.array(links[some], pa.int64())})

    return work.groupBy("component", "low", "high").applyInArrow(decide, "set_key string, root string, n_links long")


def ngram_join(documents: DataFrame, size: int = NGRAM, threshold: Fraction | float = THRESHOLD, recall: float = RECALL,
               rows: int = ROWS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: class_id (least id with the same n-grams), n_copies (rows of its class),
    n_links (other classes at the threshold or above) and group_id (least id reachable by links).

    ``text_key`` (xxhash64 of the text) tells rows of one id apart, ``group_key`` names the group
    whatever its ids; it is null for texts without words.
    """
    threshold = Fraction(threshold).limit_denominator(10_000)
    bands = bands_for(float(threshold), recall, rows)
    signed = materialise(_signatures(documents, size, bands, rows, id_column, text_column), "signatures")
    classes = materialise(
        signed.where("set_key is not null").groupBy("set_key").agg(
            F.min("doc_id").alias("class_id"), F.count("*").alias("n_copies"), F.first("n_grams").alias("n_grams"),
            F.first("bands").alias("bands")), "classes")
    buckets = classes.select("set_key", F.posexplode("bands").alias("band", "hash"))
    heads = buckets.groupBy("band", "hash").agg(F.min("set_key").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    tied = materialise(buckets.join(heads, ["band", "hash"]).where("set_key <> head")
                       .select(F.col("set_key").alias("a"), F.col("head").alias("b")).distinct(), "ties")
    members = materialise(
        components(tied).join(classes.select(F.col("set_key").alias("node"), "n_grams"), "node")
        .select(F.col("node").alias("set_key"), "component", "n_grams"), "members")
    found = materialise(_compare(documents, members, size, threshold, text_column), "links")
    links = found.groupBy("set_key").agg(F.sum("n_links").alias("n_links"))
    grouped = components(found.select(F.col("set_key").alias("a"), F.col("root").alias("b")))
    named = grouped.join(classes.select(F.col("set_key").alias("node"), "class_id"), "node")
    names = named.groupBy("component").agg(F.min("class_id").alias("group_id"))
    of_class = named.join(names, "component").select(F.col("node").alias("set_key"), "component", "group_id")
    known = (classes.select("set_key", "class_id", "n_copies").join(links, "set_key", "left").join(of_class, "set_key", "left"))
    return signed.select("doc_id", "text_key", "set_key").join(known, "set_key", "left").select(
        "doc_id", "text_key", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("group_id", "class_id", "doc_id").alias("group_id"),
        F.coalesce("component", "set_key").alias("group_key"))


def one_of_each_group(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", **settings) -> DataFrame:
    """The documents, all columns, with one row of each group: the least id, of repeated rows one.

    Rows whose texts have no words are in no group and stay.
    """
    found = materialise(ngram_join(documents, id_column=id_column, text_column=text_column, **settings)
                        .select("doc_id", "text_key", "group_key"), "groups")
    grouped = found.where("group_key is not null")
    best = grouped.groupBy("group_key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key")).alias("best"))
    rows = grouped.groupBy("group_key", "doc_id", "text_key").agg(F.count("*").alias("n")).join(best, "group_key").select(
        "doc_id", "text_key", (F.col("n") > 1).alias("repeated"),
        (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))).alias("best"))
    # Only what is dropped or repeated is joined; rows travel whole, so their columns may have any names.
    joined = same_document(keyed_rows(documents, id_column, text_column), rows.where("repeated or not best"), "left")
    kept = materialise(joined.where("best is null or best"), "one-of-each")
    single = kept.where("best is null")
    repeated = kept.where("best").dropDuplicates(["doc_id", "text_key"])
    return single.union(repeated).select("row.*")
