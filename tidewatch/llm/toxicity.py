"""Toxicity: a lexicon with Levenshtein matching and context windows.

The lexicon is learned from labelled rows: words and word stems (prefixes) that mark toxic
documents far more often than others, besides a short fixed list.  A Levenshtein automaton
intersected with the lexicon's trie is one lazily built deterministic automaton, whose states
are sets of (trie node, edits): a word is walked once, and most words die after a few letters.
So misspelt terms are met without trying every term.  A misspelt hit weighs by the labelled
evidence of its term: how much oftener toxic documents hold words one edit from it.  Each hit
weighs by its context window: in quotation (wherever it opens on the line) it counts little,
denied or reported less, else fully; "you" outweighs reporting, not quotation or denial.  Two features of the whole text (the mass of hits, and the mass per hundred words) go
through a logistic curve fitted on the labelled rows.

Labels are learned from at most ``SAMPLE`` rows (chosen by hash of the id); copies and near
copies (three of four minima equal) of one label count once, and the row with the least hash of id
and text stands for them, so a model is repeatable.  The lexicon holds every term with the
evidence.  Everything else reads all rows and whole texts.

Defined results: null and empty texts have no hits and the least score; without labelled rows
of both kinds the fixed list and default weights serve; repeated rows score alike; null ids are
kept.  Columns besides the named ones are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import binary_values, record_batches, shingle_hashes, sliced, words_of
from tidewatch.session import materialise, share

#: Common English insults.
INSULTS = """idiot moron stupid imbecile loser scum trash worthless pathetic disgusting clown filthy
vermin retard bastard bitch asshole dumbass scumbag degenerate subhuman""".split()
#: Words that report or deny what stands beside them.
REPORTING = frozenset(b"said says wrote writes called quoted quote reported alleged accused word term".split())
#: Words that deny what follows them closely.
DENYING = frozenset(b"not never no neither nor hardly isn aren wasn".split())
#: Words that aim a term at someone.
AIMED = frozenset(b"you your youre yourself u".split())

SAMPLE, THRESHOLD = 20_000, 0.3
STEMS = (4, 5, 6, 7)
WINDOW = 4
_MISSPELT, _QUOTED, _REPORTED, _DENIED = 0.8, 0.25, 0.5, 0.5
#: Words before a hit in which a denial reaches it.
_DENIAL = 3
_LEAST_FUZZY = 5
_KNOWN = 300_000
_SKETCHES = 4


@dataclass
class Model:
    words: list[str]
    stems: list[str] = field(default_factory=list)
    #: Ordinary words that happen to be one edit from a lexicon word.
    innocent: frozenset[bytes] = frozenset()
    #: Weights of misspelt hits by lexicon term (a stem with a final '*'); others have ``_MISSPELT``.
    misspelt: dict[str, float] = field(default_factory=dict)
    #: Bias, weight of log(1 + mass), weight of log(1 + mass per hundred words).
    weights: tuple[float, float, float] = (-4.0, 5.0, 0.5)


class LexiconAutomaton:
    """Words within one edit of a lexicon word, and words that begin with a stem or within one edit of it.

    A state is the set of (trie node, edits used); transitions are made when first needed.
    Edits are substitution, insertion, deletion; words and stems shorter than five letters must match.
    """

    DEAD, STATES = 0, 50_000

    def __init__(self, words: list[str], stems: list[str], misspelt: dict[str, float] | None = None):
        self.child: list[dict[str, int]] = [{}]
        self.final: list[int] = [0]  # the length of the word that ends at a node
        self.longest: list[int] = [0]  # of the words through a node: short words allow no edit
        self.stem: list[bool] = [False]
        self.misspelt: dict[int, float] = {}  # weights by node; by its negative number for a stem
        self.term: dict[int, str] = {}
        for term, is_stem in [(w, False) for w in words] + [(s, True) for s in stems]:
            node = 0
            for letter in term:
                if letter not in self.child[node]:
                    self.child[node][letter] = len(self.child)
                    self.child.append({})
                    self.final.append(0)
                    self.stem.append(False)
                    self.longest.append(0)
                node = self.child[node][letter]
                self.longest[node] = max(self.longest[node], len(term))
            if is_stem:
                self.stem[node] = True
            else:
                self.final[node] = len(term)
            key, name = (-node, term + "*") if is_stem else (node, term)
            self.term[key], self.misspelt[key] = name, (misspelt or {}).get(name, _MISSPELT)
        self.long_stems = {node for node, depth in self._depths() if self.stem[node] and depth >= _LEAST_FUZZY}
        self.fuzzy = [n >= _LEAST_FUZZY for n in self.longest]
        self.fuzzy[0] = any(self.fuzzy)
        self._reset()

    def _depths(self) -> Iterator[tuple[int, int]]:
        below = [(0, 0)]
        while below:
            node, depth = below.pop()
            yield node, depth
            below.extend((to, depth + 1) for to in self.child[node].values())

    def _reset(self) -> None:
        self.number: dict[frozenset, int] = {frozenset(): self.DEAD}
        self.sets: list[frozenset] = [frozenset()]
        self.moves: list[dict[str, int]] = [{}]
        self.value: list[float] = [0.0]
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, pairs: set) -> frozenset:
        """With skipped lexicon letters (deletions); a pair with fewer edits covers its equals.

        A node's negative number says that the word has passed its stem, misspelt.
        """
        made = set(pairs)
        for node, edits in pairs:
            if edits == 0:
                made.update((to, 1) for to in self.child[node].values() if self.fuzzy[to])
        made.update([(-node, 1) for node, edits in made if edits and node in self.long_stems])
        return frozenset((node, edits) for node, edits in made if edits == 0 or (node, 0) not in made)

    def _state(self, pairs: frozenset) -> int:
        if pairs not in self.number:
            self.number[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.moves.append({})
            exact = any(node >= 0 and edits == 0 and self.final[node] for node, edits in pairs)
            self.value.append(1.0 if exact else max((self.misspelt[node] for node in self._ends(pairs)), default=0.0))
        return self.number[pairs]

    def _ends(self, pairs: frozenset) -> list[int]:
        """Terms that are met misspelt in a state."""
        return sorted(node for node, edits in pairs if edits and (node < 0 or self.final[node] >= _LEAST_FUZZY))

    def _move(self, state: int, letter: str) -> int:
        made, stem = set(), False
        for node, edits in self.sets[state]:
            if node < 0:
                made.add((node, 1))
                continue
            to = self.child[node].get(letter)
            if to is not None:
                made.add((to, edits))
                stem |= edits == 0 and self.stem[to]
            if edits == 0 and self.fuzzy[node]:
                made.add((node, 1))  # an inserted letter
                made.update((other, 1) for key, other in self.child[node].items() if key != letter and self.fuzzy[other])
        to = -1 if stem else self._state(self._closed(made))
        self.moves[state][letter] = to
        return to

    def near(self, word: str) -> list[str]:
        """The terms (a stem with a final '*') that a word meets with one edit; none if it meets one exactly."""
        state = self._walk(word)
        return [self.term[node] for node in self._ends(self.sets[state])] if state >= 0 and self.value[state] < 1 else []

    def match(self, word: str) -> float:
        """1 for a lexicon word or stem, less for a misspelt one, 0 for others."""
        state = self._walk(word)
        return 1.0 if state < 0 else self.value[state]

    def _walk(self, word: str) -> int:
        """The state after a word; -1 if it has a stem."""
        if len(self.sets) > self.STATES:
            self._reset()
        state, moves = self.start, self.moves
        for letter in word:
            to = moves[state].get(letter)
            if to is None:
                to = self._move(state, letter)
            if to <= 0:
                return to
            state = to
        return state


class Scorer:
    """Scores texts with one automaton and a bounded memory of words already walked."""

    def __init__(self, model: Model):
        self.automaton, self.weights, self.known = LexiconAutomaton(model.words, model.stems, model.misspelt), model.weights, {}
        self.innocent = model.innocent

    def _match(self, word: bytes) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > _KNOWN:
                self.known.clear()
            found = 0.0 if word in self.innocent else self.automaton.match(word.decode("utf-8", "replace"))
            self.known[word] = found
        return found

    def hits(self, text: bytes | None) -> tuple[float, int]:
        """(mass of the hits in their contexts, number of words)."""
        words = words_of(text)
        matched = {word: value for word in set(words) if (value := self._match(word))}
        if not matched:
            return 0.0, len(words)
        lowered, at, mass = text.lower(), 0, 0.0
        quotations = _quotations(lowered)
        quotation = next(quotations, None)
        for i, word in enumerate(words):
            at = lowered.find(word, at)
            if word in matched:
                while quotation and quotation[1] <= at:
                    quotation = next(quotations, None)
                mass += matched[word] * self._context(words, i, quotation is not None and quotation[0] <= at)
            at += len(word)
        return mass, len(words)

    @staticmethod
    def _context(words: list[bytes], i: int, quoted: bool) -> float:
        if quoted:
            return _QUOTED
        if DENYING.intersection(words[max(0, i - _DENIAL):i]):
            return _DENIED
        near = words[max(0, i - WINDOW):i + WINDOW + 1]
        return _REPORTED if REPORTING.intersection(near) and not AIMED.intersection(near) else 1.0

    def features(self, text: bytes | None) -> tuple[float, float]:
        mass, words = self.hits(text)
        return math.log1p(mass), math.log1p(100 * mass / max(words, 20))

    def score(self, text: bytes | None) -> float:
        bias, by_mass, by_share = self.weights
        mass, share_ = self.features(text)
        return 1 / (1 + math.exp(-(bias + by_mass * mass + by_share * share_)))


#: What closes a quotation that a mark opens.
_CLOSED_BY = {
    b'"': [b'"'],
    "“".encode(): ["”".encode()],
    "«".encode(): ["»".encode()],
    "„".encode(): ["“".encode(), "”".encode()],
}
_MARKS = re.compile(b"|".join([b"\n", *_CLOSED_BY, "”".encode(), "»".encode()]))


def _quotations(text: bytes) -> Iterator[tuple[int, int]]:
    """Quotations in order, each opened and closed on one line; an opening mark within one begins it anew.

    A straight mark opens only before a visible character and not behind one (but a bracket), so
    marks of inches or seconds open none.
    """
    opened, start = b"", 0
    for found in _MARKS.finditer(text):
        mark, at = found.group(), found.start()
        if mark == b"\n":
            opened = b""
        elif mark != b'"' and mark in _CLOSED_BY.get(opened, ()):
            yield start, at
            opened = b""
        elif mark == b'"' and not (text[at - 1:at].strip(b" \t\r([{") == b"" and text[at + 1:at + 2].strip()):
            if opened == mark:
                yield start, at
                opened = b""
        elif mark in _CLOSED_BY:
            opened, start = mark, found.end()


@F.arrow_udf(T.ArrayType(T.LongType()))
def _sketches(texts):
    """Least 5-word shingle hashes under ``_SKETCHES`` permutations: near copies share most."""
    import pyarrow as pa

    seeds = np.arange(1, _SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def minima(grams: np.ndarray) -> np.ndarray:
        if not len(grams):
            return np.zeros(_SKETCHES, np.int64)
        mixed = grams[:, None] ^ seeds  # mixed twice: small values under one seed say nothing of another
        for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(factor)
        return (mixed ^ (mixed >> np.uint64(31))).min(axis=0).view(np.int64)

    return pa.array([minima(shingle_hashes(words_of(text), 5)) for text in binary_values(texts)], pa.list_(pa.int64()))


def _terms(labelled: DataFrame) -> DataFrame:
    """(term, toxic, other): documents of either label that hold a word, or a stem (written with a final '*')."""
    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in sliced(batches):
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(binary_values(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                words = [w.decode("utf-8", "replace") for w in set(words_of(text))]
                for term in {w for w in words if len(w) > 2} | {w[:n] + "*" for w in words for n in STEMS if len(w) >= n}:
                    seen.setdefault(term, [0, 0])[0 if toxic else 1] += 1
            columns = [list(seen), [n for n, _ in seen.values()], [n for _, n in seen.values()]]
            yield from record_batches(["term", "toxic", "other"], [pa.string(), pa.int64(), pa.int64()], columns)

    return (labelled.select("text", "label").mapInArrow(count, "term string, toxic long, other long")
            .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")))


#: The evidence a term needs: with f the share of toxic documents, a term met ``n`` times must be as good as
#: pure by chance with probability below ``_CHANCE``, and ``_PURITY`` times as frequent in toxic documents.
_CHANCE, _PURITY = 1e-7, 20


#: Clean documents that must hold a near word before it can be ordinary.
_LEAST_ORDINARY = 2


def _sizes(labelled: DataFrame) -> tuple[int, int]:
    """How many documents are toxic, and how many are not."""
    return tuple(labelled.agg(F.coalesce(F.sum("label"), F.lit(0)), F.coalesce(F.sum(1 - F.col("label")), F.lit(0))).first())


def _innocent(terms: DataFrame, model: Model, sizes: tuple[int, int]) -> frozenset[bytes]:
    """Words near a lexicon word that are ordinary: at least as frequent in clean documents as in toxic ones.

    All of them count; there are no more than the words of a bounded sample.
    """
    def near(batches: Iterator) -> Iterator:
        import pyarrow as pa

        automaton = LexiconAutomaton(model.words, model.stems)
        for batch in batches:
            yield batch.filter(pa.array([0 < automaton.match(term) < 1 for term in batch.column(0).to_pylist()], pa.bool_()))

    toxic, other = sizes
    ordinary = (F.col("other") >= _LEAST_ORDINARY) & (F.col("other") * toxic >= F.col("toxic") * other)
    rows = terms.where(ordinary & ~F.col("term").endswith("*")).select("term").mapInArrow(near, "term string").collect()
    return frozenset(row.term.encode() for row in rows)


def _misspelt(labelled: DataFrame, model: Model, sizes: tuple[int, int]) -> dict[str, float]:
    """What a misspelt hit of a term weighs: its likelihood ratio in labelled documents against that of a sure term.

    Counted are documents with a word one edit from the term that is not exempt.  Each term begins
    with the ratio ``_PURITY`` of one document, so one without any evidence keeps ``_MISSPELT``.
    """
    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        automaton, known = LexiconAutomaton(model.words, model.stems), {}
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(binary_values(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                met = set()
                for word in set(words_of(text)) - model.innocent:
                    if len(known) > _KNOWN:
                        known.clear()
                    if word not in known:
                        known[word] = automaton.near(word.decode("utf-8", "replace"))
                    met.update(known[word])
                for term in met:
                    seen.setdefault(term, [0, 0])[0 if toxic else 1] += 1
            columns = [list(seen), [n for n, _ in seen.values()], [n for _, n in seen.values()]]
            yield from record_batches(["term", "toxic", "other"], [pa.string(), pa.int64(), pa.int64()], columns)

    toxic, other = sizes
    if not toxic or not other:
        return {}
    # One row per lexicon term.
    rows = (labelled.select("text", "label").mapInArrow(count, "term string, toxic long, other long")
            .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).collect())
    sure = math.log(_PURITY)
    ratio = {row.term: math.log((row.toxic / toxic + _PURITY / other) / (row.other / other + 1 / other)) for row in rows}
    return {term: _MISSPELT * min(1.0, max(0.0, value / sure)) for term, value in sorted(ratio.items())}


def _lexicon(terms: DataFrame, sizes: tuple[int, int]) -> tuple[list[str], list[str]]:
    """Words and stems that mark toxic documents, the most general stem that is no less certain.

    Every term with the evidence is kept: each needs several toxic documents of a bounded sample.
    """
    toxic, other = sizes
    if not toxic or not other:
        return list(INSULTS), []
    least = math.ceil(math.log(_CHANCE) / math.log(toxic / (toxic + other))) if toxic < other else toxic
    likely = ((F.col("toxic") + 0.5) / toxic) / ((F.col("other") + 0.5) / other)
    rows = terms.where((F.col("toxic") >= least) & (likely >= _PURITY)).collect()
    support = {row.term: row.toxic for row in rows}
    whole, longer = {}, {}  # by stem: its best word, and the best stem that is one letter longer
    for term in sorted(support):
        if term.endswith("*"):
            longer.setdefault(term[:-2], []).append(term[:-1])
        else:
            for n in STEMS:
                if len(term) >= n and (support[term], term) > whole.get(term[:n], (0, "")):
                    whole[term[:n]] = (support[term], term)
    words, stems = set(INSULTS), set()
    for term in sorted((t for t in support if t.endswith("*")), key=lambda t: (len(t), t)):
        stem = term[:-1]
        if any(stem[:n] in stems for n in STEMS if n <= len(stem)):
            continue  # a more general stem holds it
        best, word = whole.get(stem, (0, ""))
        if word and best >= 0.9 * support[term]:
            words.add(word)
        else:
            stems.add(_longest(stem, support, longer))
    words.update(t for t in support if not t.endswith("*"))  # those of a stem too, for their misspelt forms
    return sorted(words), sorted(stems)


def _longest(stem: str, support: dict[str, int], longer: dict[str, list[str]]) -> str:
    """The longest stem below this one that stands for (nearly) the same documents."""
    while True:
        further = [s for s in longer.get(stem, []) if support[s + "*"] >= 0.98 * support[stem + "*"]]
        if not further:
            return stem
        stem = further[0]


def _witnesses(labelled: DataFrame) -> DataFrame:
    """Rows of which no other of the same label agrees in three of four minima: least ``pick`` of each group.

    Only hashes and minima are compared here; texts join their pick in the end.
    """
    left = labelled.select("pick", "label", "sketches")
    for apart in range(_SKETCHES):
        three = F.xxhash64(*[F.col("sketches")[one] for one in range(_SKETCHES) if one != apart])
        left = (left.groupBy(three.alias("three"), "label").agg(F.min(F.struct("pick", "sketches")).alias("kept"))
                .select("kept.pick", "label", "kept.sketches"))
    return labelled.join(left.select("pick", "label"), ["pick", "label"], "left_semi").dropDuplicates(["pick", "label"])


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id",
        text_column: str = "text", label_column: str = "toxic") -> Model:
    """Lexicon and curve from at most ``sample`` labelled rows, chosen by hash of their ids."""
    chosen = (labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
              .select(F.col(id_column).cast("long").alias("_doc"), F.col(label_column).cast("int").alias("label"))
              .groupBy("_doc").agg(F.min("label").alias("label")).orderBy(F.xxhash64("_doc"), "_doc").limit(sample))
    labelled = (documents.select(F.col(id_column).cast("long").alias("_doc"), F.col(text_column).cast("string").alias("text"))
                .join(F.broadcast(chosen), "_doc")
                .select("text", "label", _sketches("text").alias("sketches"), F.xxhash64("_doc", "text").alias("pick")))
    labelled = _witnesses(materialise(labelled, "labelled"))
    labelled = materialise(labelled.select("text", "label"), "witnesses")
    terms = materialise(_terms(labelled), "terms")
    sizes = _sizes(labelled)
    model = Model(*_lexicon(terms, sizes))
    model.innocent = _innocent(terms, model, sizes)
    model.misspelt = _misspelt(labelled, model, sizes)

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = Scorer(model)
        for batch in batches:
            rows = [scorer.features(text) for text in binary_values(batch.column(0))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([m for m, _ in rows], pa.float64()), pa.array([s for _, s in rows], pa.float64()), batch.column(1)],
                names=["mass", "share", "label"])

    # Equal features of a bounded sample: a small table.
    rows = (labelled.mapInArrow(measure, "mass double, share double, label int")
            .groupBy(F.round("mass", 2).alias("mass"), F.round("share", 2).alias("share"), "label")
            .agg(F.count("*").alias("n")).orderBy("mass", "share", "label").toPandas())
    if rows["label"].nunique() == 2:
        model.weights = _logistic(rows[["mass", "share"]].to_numpy(), rows["label"].to_numpy(), rows["n"].to_numpy())
    return model


def _logistic(features: np.ndarray, labels: np.ndarray, counts: np.ndarray, ridge: float = 1.0) -> tuple[float, float, float]:
    """Weights by Newton's method; the ridge keeps separable data finite."""
    x = np.column_stack([np.ones(len(labels)), features])
    penalty, weights = np.diag([0.01, ridge, ridge]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ weights))
        gradient = x.T @ (counts * (labels - p)) - penalty @ weights
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + penalty, gradient)
        weights = weights + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, weights))


def toxicity(model: Model, documents: DataFrame, text_column: str = "text") -> Column:
    """The score of a text, 0 to 1, as a column."""
    shared, held = share(documents.sparkSession, model), []

    @F.arrow_udf(T.DoubleType())
    def score(texts):
        import pyarrow as pa

        if not held:
            held.append(Scorer(shared.value))
        return pa.array([held[0].score(text) for text in binary_values(texts)], pa.float64())

    return score(F.col(text_column).cast("string"))


def bucket(id_column: str = "doc_id", parts: int = 4) -> Column:
    """crc32 of the id as text, modulo ``parts``: which rows may be learned from."""
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(parts))
