"""Prefix trie, packing and clustering against brute force, and on nulls, empty and long texts, ties and repeats."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import centroid_clustering, packing, prefix_trie
from tidewatch.llm.queries import tokenizer_file

TURNS = "conv_id long, turn long, role string, text string, ka string, depth double"


def conversations(spark, rows):
    """Rows with two columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*row, "clash", 0.5) for row in rows], TURNS)


# -- 11 -------------------------------------------------------------------------------


def brute_paths(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest(), role, text))
    own = {c: [row[3:] for row in sorted(turns)] for c, turns in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        paths[c] = tuple(own.get(base, [])[:h] + turns[h:])
    return paths


def brute_trie(rows):
    paths = brute_paths(rows)
    members = defaultdict(set)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
    kids, out = Counter(p[:-1] for p in members if p), []
    for p, convs in members.items():
        below = [q for q in members if q[:len(p)] == p]
        ends = sorted(c for c in convs if paths[c] == p)
        out.append((
            min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), kids[p], sum(not kids[q] for q in below),
            sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(frame):
    return sorted(map(tuple, frame.select(*COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("seed, share, batches", [(1, 16, 2), (2, 2, 4), (3, 4, 1), (4, 3, 3)])
def test_trie_equals_brute_force(spark, seed, share, batches):
    generator, rows = random.Random(seed), []
    stems = [[generator.choice("abc") for _ in range(9)] for _ in range(6)]
    for conv in range(90):
        stem = generator.choice(stems)
        texts = stem[:generator.randrange(10)] + [generator.choice("ab d") * 2 for _ in range(generator.randrange(4))]
        rows += [(conv * generator.choice([1, 1, 3]) + 1, n, "user", f"{t} {t}") for n, t in enumerate(texts)]
    generator.shuffle(rows)
    assert trie_rows(prefix_trie.prefix_trie(conversations(spark, rows), share, batches)) == brute_trie(rows)


def test_trie_of_long_chains_and_hot_groups(spark):
    """Each of forty conversations is the start of the next, sixty are one conversation, one is alone."""
    rows = [(40 * n + 20, t, "user", f"turn {t}") for n in range(40) for t in range(n + 1)]
    rows += [(10_000 + 20 * n, t, "user", f"copy {t}") for n in range(60) for t in range(5)]
    rows += [(-40, 0, "user", "x" * 200_000)]
    for batches in (1, 3):
        assert trie_rows(prefix_trie.prefix_trie(conversations(spark, rows), 4, batches)) == brute_trie(rows)


def test_trie_of_odd_rows(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (1, 0, "a", ""), (1, 0, "", "a"), (None, 0, "user", "lost"),
            (7, 3, "user", "only"), (0, 1, "user", ""), (20, 0, "user", "first"), (27, 5, "user", "  two words\x0b"), (-3, 0, "user", "z")]
    assert trie_rows(prefix_trie.prefix_trie(conversations(spark, rows))) == brute_trie(rows)
    assert prefix_trie.prefix_trie(conversations(spark, [])).count() == 0
    assert prefix_trie.prefix_trie(conversations(spark, [(None, 0, "user", "x")])).count() == 0


def test_two_fattest_numbers(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    frame = spark.createDataFrame(pairs, "a int, b int").select("a", "b", prefix_trie.two_fattest(F.col("a"), F.col("b")).alias("f"))
    for a, b, f in frame.collect():
        assert f == max(range(a + 1, b + 1), key=lambda n: n & -n)


def test_search_finds_the_shared_turns(spark):
    rows = [(20 * n, t, "user", text) for n, texts in enumerate(["abcdefgh", "abcdxy", "abcdefzz", "q", "abc", "abcdefghij", "zz"]) for t, text in enumerate(texts)]
    paths = prefix_trie.prefix_paths(prefix_trie.rebuilt(prefix_trie.ordered_turns(conversations(spark, rows)))).cache()
    chosen = paths.where("depth = turns").select("conv_id", "turns")
    first = chosen.where("conv_id < 60").select("conv_id", "turns", F.lit(0).alias("shared"), *[F.lit(None).cast("long").alias(c) for c in ("na", "nb")])
    nodes = prefix_trie.with_handles(prefix_trie.new_nodes(first, paths).cache(), paths).cache()
    found = {r.conv_id: r.shared for r in prefix_trie.locate(chosen.where("conv_id >= 60"), paths, nodes).collect()}
    own = brute_paths(rows)
    known = [own[c] for c in (0, 20, 40)]
    for conv in (60, 80, 100, 120):
        shared = max(sum(all(x == y for x, y in zip(own[conv][:d], other)) and len(other) >= d for d in range(1, len(own[conv]) + 1)) for other in known)
        assert found[conv] == shared


def test_digests_of_a_hot_end_are_streams(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 50)
    ids = list(range(-5, 3_000))
    frame = spark.createDataFrame([(1, 2, i) for i in ids] + [(3, 4, 9)], "ka long, kb long, conv_id long").repartition(5)
    found = {r.ka: r.digest for r in prefix_trie.ends_digest(frame).collect()}
    assert found == {1: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 3: hashlib.sha256(b"9").hexdigest()}


# -- 12 -------------------------------------------------------------------------------


def word_pieces():
    return tokenizer_file("word_bpe_49k.json", "TIDEWATCH_WORD_PIECES")


def check_sequences(pieces, window):
    """Offsets without gaps; every sequence full or of a power of two."""
    by_sequence = defaultdict(list)
    for piece in pieces:
        by_sequence[piece.sequence_id].append((piece.offset, piece.length))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == window or end & (end - 1) == 0 and end < window
    assert sorted(by_sequence) == list(range(len(by_sequence)))


TEXTS = [None, "", " \n\t", "one", "It's A. test, don't; <|endoftext|> x <|ENDOFTEXT|>y", "é é Ǆ ǅ İ ß ſ  em space\x85next\x1cend",
         "日本語のテキスト ёж 🙂🙃 ١٢٣", "a\x00b", "x" * 3_000, "word " * 9_000] + ["tie tie"] * 9


@pytest.mark.parametrize("window", [4_096, 256])
def test_packed_pieces_give_every_document_back(spark, window):
    from tokenizers import Tokenizer
    generator = random.Random(5)
    words = [f"w{i} {'ab' * (i % 7)}." for i in range(50)]
    texts = TEXTS + [" ".join(generator.choices(words, k=generator.randrange(1, 400))) for _ in range(150)]
    ids = [None if n == 3 else n for n in range(len(texts))]
    rows = [(i, t, "clash", 1) for i, t in zip(ids, texts)] + [(7, texts[7], "clash", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, part string, tail int").repartition(5)
    pieces = packing.pack(frame, word_pieces(), window).collect()
    model = Tokenizer.from_file(word_pieces())
    whole = Counter((i, tuple([*model.encode(t or "", add_special_tokens=False).ids, 2])) for i, t, *_ in rows)
    tokens = {doc: ids for doc, ids in whole}
    for piece in pieces:
        assert tuple(piece.ids) == tokens[piece.doc_id][piece.start:piece.start + piece.length]
        assert piece.ids_crc32 == zlib.crc32(np.array(piece.ids, "<u4").tobytes())
        assert piece.doc_tokens == len(tokens[piece.doc_id]) and 1 <= piece.length == len(piece.ids) <= window
    covered = Counter()
    for piece in pieces:
        covered.update((piece.doc_id, n) for n in range(piece.start, piece.start + piece.length))
    for (doc, ids), n in whole.items():
        assert all(covered[doc, place] == n for place in range(len(ids)))
    assert sum(covered.values()) == sum(len(ids) * n for (_, ids), n in whole.items())
    check_sequences(pieces, window)


def test_packing_joins_offsets_by_shuffle_beyond_the_bound(spark, monkeypatch):
    texts = [" ".join(["tok"] * (n % 40)) for n in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    monkeypatch.setattr(packing, "OFFSET_ROWS", 0)
    pieces = packing.pack(frame, word_pieces(), 64).collect()
    assert sum(p.length for p in pieces) == sum(n % 40 + 1 for n in range(300))
    check_sequences(pieces, 64)


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), word_pieces()).count() == 0


@pytest.mark.parametrize("counts", [{3_000: 7_000}, {1: 50_000}, {4_095: 11, 1: 4}, {2_048: 3, 4_000: 900, 97: 899}, {100: 1}, {}])
def test_plans_of_odd_histograms(counts):
    histogram = np.zeros(4_096, np.int64)
    for length, n in counts.items():
        histogram[length] = n
    plan = packing.Plan(histogram.copy())
    held = Counter()
    for length, n in counts.items():
        for rank in range(n):
            end = 0
            for start, size, sequence, offset in plan.pieces(length, rank):
                assert start == end
                end += size
                held[sequence] += size
            assert end == length
    assert set(held) == set(range(plan.sequences))
    assert all(size == 4_096 or size & (size - 1) == 0 for size in held.values())
    assert sum(map(len, plan.rows.values())) < 3 * 4_096  # follows the window, not the tails


def test_least_squares_stay_positive_and_approach_the_best():
    from itertools import product
    counts = np.zeros(16, np.int64)
    counts[[4, 8, 12]] = [40, 10, 24]
    targets, lengths = packing.combinations(counts, 16)
    assert all(row.sum() == target for row, target in zip(lengths, targets))
    found = packing.non_negative_least_squares(lengths, counts, 4_000)
    assert (found >= 0).all()
    used = np.array([[np.count_nonzero(row == n) for row in lengths] for n in (4, 8, 12)])
    goal = counts[[4, 8, 12]]
    error = ((used @ found - goal) ** 2).sum()
    steps = list(product(range(0, 41, 4), repeat=min(4, len(lengths))))
    assert error <= min(((used[:, :len(s)] @ np.array(s) - goal) ** 2).sum() for s in steps) + 1e-6


# -- 13 -------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds):
    whole = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows]
    centers = [v for _, v in sorted(whole, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centers)) for _, v in whole]

    for _ in range(rounds):
        labels = [n for _, n in assign()]
        for n in range(len(centers)):
            mine = [v for (_, v), label in zip(whole, labels) if label == n]
            if mine:
                centers[n] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted((i, n, d, hashlib.sha256(",".join(map(str, centers[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(whole, assign()))


VECTORS = "vec_id long, embedding array<float>, cluster string, block int"


@pytest.mark.parametrize("kind", ["blobs", "noise", "copies", "large"])
def test_clusters_equal_brute_force(spark, kind):
    generator = np.random.default_rng(4)
    vectors = generator.normal(size=(260, 4))
    if kind == "blobs":
        vectors = generator.normal(size=(6, 4))[generator.integers(0, 6, 260)] * 3 + vectors * 0.05
    if kind == "copies":
        vectors[20:200] = vectors[3]
    if kind == "large":
        vectors *= 90_000
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(vectors)]
    rows += rows[:9]
    odd = [(900, None), (901, [1.0]), (902, [1.0, None, 1.0, 1.0]), (903, [float("nan")] * 4), (904, [float("-inf")] * 4), (905, [1e30] * 4), (906, [])]
    frame = spark.createDataFrame([(*row, "clash", 1) for row in rows + odd], VECTORS).repartition(3)
    found = centroid_clustering.cluster(frame, k=11, rounds=4, dim=4, block_rows=50)
    got = centroid_clustering.with_inertia(found).collect()
    assert sorted((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in got) == brute_clusters(rows, 11, 4)
    assert {r.inertia for r in got} == {sum(r.distance for r in got)}
    for r in got:
        assert r.cluster_inertia == sum(o.distance for o in got if o.cluster == r.cluster)
    if kind == "blobs":
        assert found.scanned[-1] < found.scanned[0] / 2


def test_clusters_of_few_null_ids_and_none(spark):
    few = spark.createDataFrame([(1, [0.0, 1.0], "c", 1), (None, [1.0, 0.0], "c", 1), (1, [0.0, 1.0], "c", 1)], VECTORS)
    got = centroid_clustering.with_inertia(centroid_clustering.cluster(few, k=5, rounds=2, dim=2)).collect()
    assert [(r.vec_id, r.distance) for r in sorted(got, key=repr)] == [(1, 0), (1, 0), (None, 0)]
    none = spark.createDataFrame([(1, [0.0], "c", 1)], VECTORS)
    assert centroid_clustering.with_inertia(centroid_clustering.cluster(none, dim=2)).count() == 0


def test_heaps_keep_their_order_when_written():
    heaps = centroid_clustering.Heaps([[], []])
    heaps.push(list(range(8)), [0, 1] * 4, [5.0, 1.0, 3.0, 9.0, 4.0, 2.0, 8.0, 7.0])
    again = centroid_clustering.Heaps.stored(*heaps.bytes())
    assert again.heaps == heaps.heaps
    assert again.pop(np.array([4.0, 1.5]), 0.0) == ([2, 4, 1], [0, 0, 1])
    assert again.labels(8).tolist() == [0, 0, 0, 1, 0, 1, 0, 1]
