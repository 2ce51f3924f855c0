"""What a Python worker holds at once, and what it keeps for the next operator."""

import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from eventflow.llm import common, jaccard_join, token_files

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [" ".join(f"word{chr(97 + i % 26)}{chr(97 + k % 26)}x{'é' * (k % 3)}{'.' * (k % 2)}\nline" for k in range(60)) for i in range(300)]


def test_rows_of_megabytes_make_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    common.small_batches(spark)
    rows = spark.range(24, numPartitions=1).select(F.expr("repeat(cast(id % 10 as string), 2 << 20)").alias("text"))
    got = rows.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in got) == 24
    assert max(r.bytes for r in got) <= common.BYTES_AT_ONCE + (3 << 20)


def test_a_size_of_the_user_stays(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "1000000b")
        common.small_batches(spark)
        assert spark.conf.get(name) == "1000000b"
    finally:
        spark.conf.set(name, before)


def test_caches_go_when_another_operator_takes_over():
    encoder = token_files.encoder(VOCABULARY, 2)
    list(encoder.encode(TEXTS[:3]))
    assert encoder.known and token_files.encoder(VOCABULARY, 2) is encoder
    jaccard_join.begin()
    assert not token_files._ENCODERS
    jaccard_join.ngram_set(TEXTS[0], 5)
    jaccard_join.begin()
    assert jaccard_join._WORDS
    token_files.encoder(VOCABULARY, 2)
    assert not jaccard_join._WORDS
    common.takes_over("another")
    assert not token_files._ENCODERS


def test_fewer_remembered_pieces_are_the_same_ids():
    whole, little = token_files.Encoder(VOCABULARY, 2), token_files.Encoder(VOCABULARY, 2, pieces=100)
    most = 0
    for text in TEXTS:
        assert list(little.encode([text])) == list(whole.encode([text]))
        most = max(most, len(little.known))
    assert len(whole.known) > 1000 > 300 > most


def test_the_pipeline_remembers_fewer_pieces(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS[:20])), "doc_id long, text string")
    least = {r.doc_id: r.ids_crc32 for r in token_files.encode_table(docs, VOCABULARY, folder=str(tmp_path / "a"), pieces=50).collect()}
    plain = {r.doc_id: r.ids_crc32 for r in token_files.encode_table(docs, VOCABULARY, folder=str(tmp_path / "b")).collect()}
    assert least == plain and len(plain) == 20
    assert corpus_pipeline.PIECES < token_files.CACHE_PIECES
