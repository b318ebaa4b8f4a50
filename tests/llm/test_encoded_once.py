"""Decoding what encode() gives must not encode any text twice."""

from tessella.llm import sentencepiece_scan


def test_whole_texts_and_chunks_are_each_encoded_once(spark):
    docs = spark.createDataFrame([(1, "a few words"), (2, "some more words " * 20), (2, "some more words " * 20), (3, None)], "doc_id long, text string")
    got = sentencepiece_scan.decode(sentencepiece_scan.encode(docs, chunk=64))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 6  # encode, decode; matrices, states, ids of chunks, decode
    rows = sorted((r["doc_id"], r["n_chunks"], r["text"]) for r in got.collect())
    assert rows == [(1, 1, "a few words"), (2, 6, "some more words " * 20), (2, 6, "some more words " * 20), (3, 1, "")]


def test_decode_takes_rows_without_the_constant(spark):
    docs = spark.createDataFrame([(1, "a few words"), (2, "some more words " * 20)], "doc_id long, text string")
    encoded = sentencepiece_scan.encode(docs, chunk=64)
    want = sorted(map(tuple, sentencepiece_scan.decode(encoded).collect()))
    assert sorted(map(tuple, sentencepiece_scan.decode(encoded.drop("whole")).collect())) == want
