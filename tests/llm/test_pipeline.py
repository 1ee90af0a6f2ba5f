"""The pipeline's stages in turn, each on what the one before kept, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from tidewatch.llm import pieces, secret_scan, toxicity
from tests.llm.test_operators import HEX, base_spans, brute_hits, brute_join, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, group_key string, _doc long"


def documents():
    generator, texts = random.Random(8), []
    for i in range(160):
        words = prose(i, 60) + [f"w{i}x{j}" for j in range(20)]
        generator.shuffle(words)
        if i % 8 == 0:
            words[10:10] = ["idiot", "you", "moron", "worthless"]
        texts.append(" ".join(words))
    clean = [t for i, t in enumerate(texts) if i % 8]
    texts += [clean[0], clean[1] + " changed", clean[2].upper()]  # exact and near copies
    passage = prose(999, 40)
    texts += [" ".join(prose(500, 20) + passage), " ".join([f"z{j}" for j in range(900)] + passage[:14])]
    texts += [f'config token = "{HEX}" ' + " ".join(prose(700, 30)), "", None, "x" * 40_000]
    rows = [(i, t, "en", "s", None if t is None else len(t), "clash", i) for i, t in enumerate(texts)]
    return [*rows, rows[1], (None, "no id " + " ".join(prose(800, 30)), "en", "s", 9, "clash", 7)], passage


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows, passage = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i % 8 == 0)) for i in range(160)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(passage)), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given, passage = documents()
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "secret_scan", "sentencepiece"]

    def run(number, frame):
        out = corpus_pipeline.STAGES[number][1](spark, frame, folder)
        if number < 4:
            assert out.dtypes == docs.dtypes
        rows = [tuple(r) for r in out.collect()]
        return rows, (spark.createDataFrame(rows, SCHEMA) if number < 4 else None)

    def order(rows):
        return sorted(rows, key=repr)

    kept, frame = run(0, docs)
    assert order(kept) == order([r for r in given if not (r[0] is not None and r[0] < 160 and r[0] % 8 == 0)])

    before = sorted(set(kept), key=lambda r: (r[0] is None, r[0] or 0))  # repeated rows are one
    groups = brute_join([r[1] for r in before])
    kept, frame = run(1, frame)
    assert order(kept) == order([r for i, r in enumerate(before) if groups[i][2] == i])

    hits = brute_hits([r[1] for r in kept], [(1, " ".join(passage))])
    expected = [r for r, (words, hit, _) in zip(kept, hits, strict=True) if not (hit and 20 * hit >= words)]
    assert len(expected) == len(kept) - 1
    kept, frame = run(2, frame)
    assert order(kept) == order(expected)

    def redact(text):
        out, at = "", 0
        for start, _, end in base_spans(text):
            if start >= at:
                out += text[at:start] + "[secret]"
            at = max(at, end)
        return text if text is None else out + text[at:]

    expected = [(r[0], redact(r[1]), r[2], r[3], None if r[1] is None else len(redact(r[1])), *r[5:]) for r in kept]
    kept, frame = run(3, frame)
    assert order(kept) == order(expected) and sum("[secret]" in (r[1] or "") for r in kept) == 1
    assert secret_scan.cuts(frame) == {}

    last, _ = run(4, frame)
    model = corpus_pipeline.piece_model()
    encoder, units = pieces.Encoder(model), pieces.Units(model)
    for doc_id, n_ids, ids, round_trip in last:
        texts = [r[1] for r in kept if r[0] == doc_id]
        assert round_trip and n_ids == len(ids) and len(texts) == 1
        assert b"".join(encoder.encode(u) for u in units(texts[0])) == b"".join(i.to_bytes(4, "little") for i in ids)
    assert len(last) == len(kept)


def test_run_is_the_stages_and_is_registered(spark, folder):
    rows = contract.queries()["pipeline"](spark, folder).collect()
    assert len(rows) == len({r.doc_id for r in rows}) > 130
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in contract.oracle_sql()


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_bucket_is_crc32_of_the_id_as_text(spark):
    import zlib
    rows = spark.range(50).select(F.col("id").alias("doc_id"), toxicity.bucket().alias("b")).collect()
    assert all(r.b == zlib.crc32(str(r.doc_id).encode()) % 4 for r in rows)
