"""Benchmark decontamination over a distributed positional inverted index.

``token_postings`` stores, for the terms that test phrases may need, every training position
(document, position).  Phrases are found from their rarest terms: the posting lists of the
``ANCHORS`` rarest terms of a phrase are shifted by their offsets and intersected, and what
survives is compared word by word with the text, so results are exact.  Term frequencies are
counted over all documents.  Only posting lists of anchor terms are stored: lists that no
phrase starts from are never read.  The term filter that decides this has a fixed size.

Defined results: null and empty texts have no words and no hits; an item without words has no
phrase; an item of fewer words than a window is one phrase; repeated rows each get their row;
null ids are kept.  Columns besides the named ones are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import Admitted, binary_values, filter_bits, record_batches, same_document, sliced, words_of
from tidewatch.session import materialise, share

#: Words of a window, and posting lists intersected per phrase.
WINDOW, ANCHORS = 13, 3
_FLUSH, _ROWS = 500_000, 100_000
_DOC_BITS = 1 << 23
_TERM_BITS = 1 << 22


def phrases(items: DataFrame, id_column: str = "item_id", text_column: str = "text",
            width: int | None = WINDOW) -> DataFrame:
    """(item_id string, phrase string): every window of ``width`` words, or the whole item if None."""
    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, found = [], []
            for item, text in zip(batch.column(0).to_pylist(), binary_values(batch.column(1)), strict=True):
                words = words_of(text)
                size = min(width or len(words), len(words))
                for start in range(len(words) - size + 1 if words else 0):
                    ids.append(item)
                    found.append(b" ".join(words[start:start + size]))
            for made in record_batches(["item_id", "phrase"], [pa.string(), pa.binary()], [ids, found]):
                yield made.set_column(1, "phrase", made.column(1).cast(pa.string()))

    return items.select(F.col(id_column).cast("string"), F.col(text_column).cast("string")).mapInArrow(
        cut, "item_id string, phrase string")


def term_counts(documents: DataFrame, terms: bytes, text_column: str = "text") -> DataFrame:
    """(term, n): occurrences over all documents of the terms that the filter admits."""
    bits = share(documents.sparkSession, terms)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        admitted, seen = Admitted(bits.value), Counter()

        def flush():
            kept = [(term, n) for term, n in seen.items() if admitted[term]]
            seen.clear()
            columns = [[term for term, _ in kept], [n for _, n in kept]]
            for made in record_batches(["term", "n"], [pa.binary(), pa.int64()], columns):
                yield made.set_column(0, "term", made.column(0).cast(pa.string()))

        for batch in sliced(batches):
            for text in binary_values(batch.column(0)):
                seen.update(words_of(text))
                if len(seen) > _FLUSH:
                    yield from flush()
        yield from flush()

    return (documents.select(F.col(text_column).cast("string")).mapInArrow(count, "term string, n long")
            .groupBy("term").agg(F.sum("n").alias("n")))


def token_postings(documents: DataFrame, terms: bytes, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The index: (term, doc_id, text_key, at), and per document a row of null term whose ``at`` is its word count.

    ``text_key`` tells apart rows of one id whose texts differ.
    """
    bits = share(documents.sparkSession, terms)

    def post(batches: Iterator) -> Iterator:
        import pyarrow as pa

        admitted = Admitted(bits.value)
        names, types = ["term", "doc_id", "text_key", "at"], [pa.binary(), pa.int64(), pa.int64(), pa.int32()]
        rows: list[list] = [[], [], [], []]

        def made():
            for batch in record_batches(names, types, rows):
                yield batch.set_column(0, "term", batch.column(0).cast(pa.string()))
            for column in rows:
                column.clear()

        for batch in sliced(batches):
            for doc, text, key in zip(batch.column(0).to_pylist(), binary_values(batch.column(1)),
                                      batch.column(2).to_pylist(), strict=True):
                words = words_of(text)
                hits = [(word, at) for at, word in enumerate(words) if admitted[word]]
                rows[0] += [word for word, _ in hits] + [None]
                rows[1] += [doc] * (len(hits) + 1)
                rows[2] += [key] * (len(hits) + 1)
                rows[3] += [at for _, at in hits] + [len(words)]
                if len(rows[0]) > _ROWS:
                    yield from made()
        yield from made()

    return _keyed(documents, id_column, text_column).mapInArrow(post, "term string, doc_id long, text_key long, at int")


def text_key(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def _keyed(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"),
                            text_key(F.col(text_column)).alias("text_key"))


def _doc_key() -> Column:
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_key").cast("string"))


class Index:
    """Postings of all documents for the rarest terms of the given phrases."""

    def __init__(self, documents: DataFrame, found: DataFrame, id_column: str, text_column: str):
        self.documents, self.id_column, self.text_column = documents, id_column, text_column
        self.of_items = materialise(found.distinct(), "item-phrases")
        self.phrases = materialise(
            self.of_items.select("phrase").distinct().withColumn("phrase_id", F.monotonically_increasing_id()), "phrases")
        words = self.phrases.select("phrase_id", F.posexplode(F.split("phrase", " ")).alias("offset", "term"))
        counts = term_counts(documents, filter_bits(words, F.col("term"), _TERM_BITS), text_column)
        rarest = (words.join(counts, "term")
                  .groupBy("phrase_id").agg(F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("terms")))
        # A phrase of which a word never occurs is gone here: it has fewer counted words than words.
        sizes = words.groupBy("phrase_id").agg(F.count("*").alias("words"))
        self.anchors = materialise(
            rarest.join(sizes, "phrase_id").where(F.size("terms") == F.col("words"))
            .select("phrase_id", F.least(F.col("words"), F.lit(ANCHORS)).alias("wanted"),
                    F.explode(F.slice("terms", 1, ANCHORS)).alias("anchor"))
            .select("phrase_id", "wanted", "anchor.term", "anchor.offset"), "anchors")
        self.postings = materialise(token_postings(
            documents, filter_bits(self.anchors, F.col("term"), _TERM_BITS), id_column, text_column), "postings")

    def word_counts(self) -> DataFrame:
        return self.postings.where(F.col("term").isNull()).select("doc_id", "text_key", F.col("at").cast("long").alias("n_words"))

    def _candidates(self, aligned: bool) -> DataFrame:
        """(doc_id, text_key, phrase_id, phrase, start) where all anchors meet, at one start if ``aligned``."""
        start = (F.col("at") - F.col("offset")) if aligned else F.lit(0)
        met = (self.postings.where(F.col("term").isNotNull()).join(self.anchors, "term")
               .withColumn("start", start).where("start >= 0")
               .groupBy("doc_id", "text_key", "phrase_id", "start")
               .agg(F.count_distinct("offset").alias("met"), F.first("wanted").alias("wanted")).where("met = wanted"))
        return met.select("doc_id", "text_key", "phrase_id", "start").join(self.phrases, "phrase_id")

    def verified(self, aligned: bool = True, span: int = 0) -> DataFrame:
        """(doc_id, text_key, n_hit, phrase_ids): phrases truly in the text, and words they cover."""
        candidates = materialise(self._candidates(aligned), "candidates")
        bits = share(candidates.sparkSession, filter_bits(candidates, _doc_key(), _DOC_BITS))

        def admit(batches: Iterator) -> Iterator:
            import pyarrow as pa

            admitted = Admitted(bits.value)
            for batch in batches:
                yield batch.filter(pa.array([
                    admitted[b"%s:%d" % (b"" if doc is None else b"%d" % doc, key)]
                    for doc, key in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)], pa.bool_()))

        def verify(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in sliced(batches):
                hits, found = [], []
                for text, listed in zip(binary_values(batch.column("text")), batch.column("listed").to_pylist(), strict=True):
                    words, true = words_of(text), set()
                    covered = bytearray(len(words))
                    for candidate in listed:
                        wanted = candidate["phrase"].encode().split(b" ")
                        for start, end in _occurrences(words, wanted, candidate["start"], aligned, span):
                            covered[start:end] = b"\1" * (end - start)
                            true.add(candidate["phrase_id"])
                    hits.append(sum(covered))
                    found.append(sorted(true))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text_key"), pa.array(hits, pa.int64()),
                     pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "text_key", "n_hit", "phrase_ids"])

        texts = _keyed(self.documents, self.id_column, self.text_column).mapInArrow(
            admit, "doc_id long, text string, text_key long").dropDuplicates(["doc_id", "text_key"])
        listed = candidates.groupBy("doc_id", "text_key").agg(
            F.collect_list(F.struct("start", "phrase_id", "phrase")).alias("listed"))
        return same_document(texts, listed, "inner").mapInArrow(
            verify, "doc_id long, text_key long, n_hit long, phrase_ids array<long>").where(F.size("phrase_ids") > 0)


def _occurrences(words: list[bytes], wanted: list[bytes], start: int, aligned: bool, span: int) -> Iterator[tuple[int, int]]:
    """Where the words stand as a phrase at ``start``, or else together within ``span`` words."""
    if aligned:
        if words[start:start + len(wanted)] == wanted:
            yield start, start + len(wanted)
        return
    missing, needed, left = len(wanted), Counter(wanted), 0
    for right, word in enumerate(words):
        missing -= needed[word] > 0 if word in needed else 0
        if word in needed:
            needed[word] -= 1
        if right - left >= span:
            gone = words[left]
            left += 1
            if gone in needed:
                needed[gone] += 1
                missing += needed[gone] > 0
        if not missing:
            yield left, right + 1


def phrase_hits(documents: DataFrame, items: DataFrame, width: int = WINDOW, id_column: str = "doc_id",
                text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: n_words, n_hit (words inside any window of an item) and its sorted item ids."""
    index = Index(documents, phrases(items, item_column, item_text, width), id_column, text_column)
    found = materialise(index.verified(), "hits")
    return _report(index, found)


def proximity_hits(documents: DataFrame, items: DataFrame, span: int, id_column: str = "doc_id",
                   text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """As ``phrase_hits``, for items all of whose words stand within ``span`` words, in any order."""
    index = Index(documents, phrases(items, item_column, item_text, None), id_column, text_column)
    return _report(index, materialise(index.verified(aligned=False, span=span), "hits"))


def _report(index: Index, found: DataFrame) -> DataFrame:
    items = (found.select("doc_id", "text_key", F.explode("phrase_ids").alias("phrase_id"))
             .join(index.phrases, "phrase_id").join(index.of_items, "phrase")
             .groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("item_id")).alias("items")))
    hit = same_document(found.select("doc_id", "text_key", "n_hit"), items, "left")
    return (same_document(index.word_counts(), hit, "left")
            .select("doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.array().cast(T.ArrayType(T.StringType()))).alias("items")))


def contaminated() -> Column:
    """At least one word in twenty stands in a benchmark window."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
