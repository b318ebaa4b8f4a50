"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import chat, common, exact_dedup, jaccard, langid, license, media, packing, sentencepiece_scan, toxicity, warc
from tessella.llm.common import shared_path

LONG = "the quick onyx goblin jumps over the lazy dwarf " * 6000
ROWS = [
    (1, "Hello there, this text is under the MIT license.", "en"),
    (2, "Hello there,  this text is under the MIT\tlicense.", "en"),
    (3, None, "en"),
    (4, "", None),
    (5, LONG, "en"),
    (5, LONG, "en"),
    (6, "!!! 123", "de"),
    (7, "dies ist ein deutscher Satz und noch ein Satz dazu", "de"),
    (7, "dies ist ein deutscher Satz und noch ein Satz dazu", "de"),
    (None, "ein Text ohne Nummer", None),
    (8, "x" * 50_000, "de"),
    (9, "ein zwei drei " * 3, "de"),
]
CLASH = ["rep", "h", "label", "t", "diag", "_class", "_salt", "_rank", "sequence_id", "text_sha256", "score", "least", "rows", "n_bytes", "comp", "toxic", "same", "media", "row", "chunk", "_word", "_bit", "_bits", "_maybe", "_id", "_sha", "_rare", "did", "th", "id", "root", "unit", "key", "n", "grams"]


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.select("*", F.lit("src").alias("source"), F.length("text").cast("long").alias("n_chars"), *(F.lit("clash").alias(c) for c in CLASH))


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


OPERATORS = {
    "toxicity": lambda s, d: toxicity.score(d, toxicity.fit(d, labels(s, [(1, 0, 0), (2, 1, 1), (3, 0, None), (7, 1, 0), (9, 1, 1), (9, 1, 0)]))),
    "dedup": lambda s, d: exact_dedup.dedup(d),
    "packing": lambda s, d: packing.pack_documents(d),
    "sentencepiece": lambda s, d: sentencepiece_scan.decode(sentencepiece_scan.encode(d)),
    "media": lambda s, d: media.read_media(media.with_media(d)),
    "langid": lambda s, d: langid.predict(d, langid.fit(d)),
    "jaccard": lambda s, d: jaccard.join(d),
    "license": lambda s, d: license.scan(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, table(spark, [])).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    rows = OPERATORS[name](spark, table(spark, ROWS)).collect()
    if name == "packing":
        assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)
        assert sum(r["start"] == 0 for r in rows) == len(ROWS)
        texts = [zlib.crc32(np.array([*packing.encoder(packing.VOCABULARY).encode(t or "")[: packing.SEQ], 1][: packing.SEQ], "<u4").tobytes()) for _, t, _ in ROWS]
        assert sorted(r["ids_crc32"] for r in rows if r["start"] == 0) == sorted(texts)
        at = {}
        for r in rows:
            at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert all(o == sum(n for _, n in sorted(v)[:i]) for v in at.values() for i, (o, _) in enumerate(sorted(v)))
        return
    assert sorted(map(repr, (r["doc_id"] for r in rows))) == sorted(repr(i) for i, _, _ in ROWS)
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    assert all(a == b for i in (5, 7) for a, b in [got[i]] if name != "dedup")  # repeated rows fare alike
    want = {
        "toxicity": lambda: all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows),
        "dedup": lambda: [sorted(r["kept"] for r in got[i]) for i in (5, 7)] == [[False, True]] * 2 and sum(r["kept"] for r in rows) == 8,
        "sentencepiece": lambda: all(got[i][0]["text"] == (t or "") for i, t, _ in ROWS),
        "media": lambda: all(got[i][0]["payload_sha256"] == hashlib.sha256(media.padded((t or "").encode())).hexdigest() and got[i][0]["n_bytes"] == len((t or "").encode()) for i, t, _ in ROWS),
        "langid": lambda: {i for i in got if got[i][0]["lang_pred"] == "und"} == {3, 4, 6},
        "jaccard": lambda: {i: got[i][0]["class_id"] for i in got} == {i: 1 if i == 2 else i for i in got} and [got[i][0]["n_links"] for i in (1, 3, 5, 9)] == [1, 0, 1, 0],
        "license": lambda: {i for i in got if got[i][0]["labels"]} == {1, 2} and got[5][0]["n_words"] == 54_000,
    }
    assert want[name]()


STAGES = {name: stage for name, stage in corpus_pipeline.STAGES}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("sf"))
    labels(spark, [(1, 0, 0), (2, 1, 1), (3, 0, None), (7, 1, 0), (9, 1, 1), (9, 1, 0)]).write.parquet(f"{top}/labels.parquet")
    return top


@pytest.mark.parametrize("name", STAGES)
def test_stage_of_empty_table(spark, folder, name):
    got = STAGES[name](spark, table(spark, []), folder)
    assert got.count() == 0 and (name == "packing" or got.columns == table(spark, []).columns)


@pytest.mark.parametrize("name", STAGES)
def test_stage_of_odd_rows(spark, folder, name):
    rows = [*ROWS, (7, "ein anderer Text unter derselben Nummer", "de"), (None, "ein Text ohne Nummer", None)]
    docs = common.written(table(spark, rows).repartition(3), "odd")
    got = STAGES[name](spark, docs, folder)
    if name == "packing":
        assert sorted(map(repr, (r["doc_id"] for r in got.collect() if r["start"] == 0))) == sorted(repr(i) for i, _, _ in rows)
        return
    assert got.columns == docs.columns
    kept = got.collect()
    assert all(r[c] == "clash" for r in kept for c in CLASH)
    left = sorted(((r["doc_id"], r["text"]) for r in kept), key=repr)
    if name == "language_id":
        want = [(i, t) for i, t, _ in rows if t and any(map(str.isalpha, t))]
    elif name == "toxicity":
        want = [(r["doc_id"], r["text"]) for r in docs.collect() if r["text"] is None]
        assert {i for i, _ in want} <= {i for i, _ in left} and len(left) <= len(rows)
        return
    else:
        want = [(i, t) for i, t, _ in dict.fromkeys(rows) if i != 2]  # each once
        if name == "exact_dedup":
            want.remove((4, ""))
    assert left == sorted(want, key=repr)


def test_whole_pipeline_of_odd_rows(spark, folder, tmp_path):
    table(spark, ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, []).write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(repr, {r["doc_id"] for r in got})) == sorted(map(repr, [1, 5, 7, 8, 9, None]))


def test_pages_with_shared_bits_keep_their_payloads(spark, monkeypatch):
    """A sieve of few bits lets most pages through that have no copies."""
    monkeypatch.setattr(common, "SIEVE_BITS", 7)
    rows = [(i, f"http://h/{i}", f"page {i % 70}" if i < 100 else f"own {i}") for i in range(300)] + [(None, None, "nobody")] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = [r for r in warc.round_trip(pages, shared_path(spark, "t")).collect()]
    last = {h: max(i for i, _, x in rows[:300] if x == h) for _, _, h in rows[:300]}
    assert len(got) == 303
    for r in got:
        html = rows[r["page_id"]][2] if r["page_id"] is not None else "nobody"
        assert r["payload_bytes"] == len(html) and r["payload_digest"] == warc.digest32(hashlib.sha1(html.encode()).digest())
        assert r["page_id"] is None or (r["refers_to"], r["record_type"]) == ((None, "response") if last[html] == r["page_id"] else (last[html], "revisit"))


def test_clips_as_rows(spark):
    rows = media.read_media(media.with_media(table(spark, [(1, "a" * 4096 * 5 + "z" * 4096 * 5, None), (2, None, None)])))
    got = sorted((tuple(r) for r in media.clip_rows(rows).collect()))
    assert got == [(1, 0, 0.0, 0.2), (1, 1, 0.2, 0.4), (2, 0, 0.0, 0.04)]
    assert {r["doc_id"]: r["clips"] for r in media.clip_list(rows).collect()} == {1: "0.00-0.20,0.20-0.40", 2: "0.00-0.04"}


def test_short_texts_teach_languages(spark):
    rows = [(i, f"hallo welt {i}", "de") for i in range(60)] + [(100 + i, f"good morning to all of you, number {i}", "en") for i in range(60)]
    docs = table(spark, rows)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_unlearnable_language_keeps_letters(spark):
    docs = table(spark, [(1, "Hello", None), (2, "123", None), (3, None, None)])
    assert langid.fit(docs) is None and [r["doc_id"] for r in langid.accepted(docs, None).collect()] == [1]


def test_equal_ids_keep_their_links(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(90)) for c in "ab")
    docs = table(spark, [(1, a, None), (1, b, None), (2, a + " x", None), (3, b + " x", None), (None, "x " + b, None)])
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.join(docs).collect()), key=repr)
    assert got == [(1, 1, 1), (1, 1, 2), (2, 1, 1), (3, 1, 2), (None, 1, 2)]


def test_added_tokens_are_read_as_the_library_does():
    from tokenizers import Tokenizer

    import public_tokenizers

    library, own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder(packing.VOCABULARY)
    texts = ["x <|endoftext|> y", "<|endoftext|>", "<|endoftext|><|endoftext|>", "a<|endoftext|", "  <|endoftext|>\n\n  b", "don't <|ENDOFTEXT|> 'LL  \u3000 x\u00a0 \x00"]
    texts += ["".join(f"a{chr(c)} {chr(c)}1 " for c in range(k, k + 97) if not 0xD800 <= c < 0xE000) for k in range(0, 0x110000 - 97, 7919)]
    assert [own.encode(t) for t in texts] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert packing.encoder(packing.VOCABULARY, False).encode("<|endoftext|>") != [50256]


def test_dedup_groups(spark):
    got = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.dedup(table(spark, ROWS)).collect()}
    sha = hashlib.sha256(b"Hello there, this text is under the MIT license.").hexdigest()
    assert got[1, sha]["kept"] and not got[2, sha]["kept"] and got[2, sha]["keep_id"] == 1
    empty = hashlib.sha256(b"").hexdigest()
    assert got[3, empty]["group_size"] == 2 and got[4, empty]["keep_id"] == 3


def test_dedup_spills_subtrees(spark):
    rows = [(i, f"{chr(97 + i % 20)} text {i % 300} " * 40, None) for i in range(900)]
    small = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.dedup(table(spark, rows), budget=20_000).collect()}
    large = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.dedup(table(spark, rows)).collect()}
    assert small == large and large[899] == (299, 3)


def test_language_defined_results(spark):
    got = {r["doc_id"]: r for r in langid.predict(table(spark, ROWS), langid.fit(table(spark, ROWS))).collect()}
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == got[6]["lang_pred"] == "und" and got[3]["score"] == 0
    assert langid.accepted(table(spark, ROWS), langid.fit(table(spark, ROWS))).columns == table(spark, []).columns


def test_license_places(spark):
    rows = [(1, "Under the MIT license. Under  the MIT-license! CC BY NC 4.0", None), (2, "Licensed under the Apache License, Version 2.0 (the license)", None), (3, "nothing", None)]
    got = {r["doc_id"]: r for r in license.scan(table(spark, rows)).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (3, 0, 8, "cc-by-nc,mit")
    assert got[2]["base_labels"] == "apache-2" and got[2]["first_word"] == 3 and got[2]["score"] == 1
    assert (got[3]["n_base"], got[3]["first_word"], got[3]["labels"], got[3]["n_words"]) == (0, None, "", 1)


def test_license_spans_with_gaps(spark):
    text = license.TEMPLATES["bsd"].replace("binary forms", "binary and other forms")
    got = license.scan(table(spark, [(1, "so " * 50 + text, None)])).first()
    assert got["labels"] == "bsd" and got["base_labels"] == "" and 0.7 <= got["score"] < 1


def test_warc_edges(spark):
    rows = [(1, "http://a/\r\nx", "same"), (2, "http://b/", "same"), (3, None, None), (4, "http://d/", ""), (5, "u", "é" * 100_000), (None, "n", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("clash")).withColumn("refers_to", F.lit(9))
    got = {r["page_id"]: r for r in warc.round_trip(pages, shared_path(spark, "t")).collect()}
    assert got[2]["record_type"] == "response" and got[1]["refers_to"] == 2 and got[1]["payload_bytes"] == 4
    assert got[4]["record_type"] == "response" and got[3]["refers_to"] == 4 and got[3]["payload_bytes"] == 0
    assert got[5]["payload_bytes"] == 200_000 and got[None]["refers_to"] == 2 and len(got) == 6
    assert warc.round_trip(pages.where("false"), shared_path(spark, "t")).count() == 0


def test_chat_edges(spark):
    rows = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "bob", None), (1, 1, "amy", "yo"), (1, 1, "amy", "yo"), (1, None, "system", "be kind"), (2, 0, None, "x"), (None, 0, " ", "y"), (3, 0, "system", "alone")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit("clash")).withColumn("me", F.lit(1))
    got = {(r["conv_id"], r["speaker"]): r for r in chat.rotate(turns).collect()}
    assert set(got) == {(1, "user"), (1, "bob"), (1, "amy"), (2, "unknown"), (None, "unknown")}
    one = [r for r in chat.rotate(turns).collect() if r["conv_id"] == 1 and r["speaker"] == "amy"]
    text = "".join(r["text"] for r in sorted(one, key=lambda r: r["block"]))
    assert text.startswith("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=user\nhi < |im_end|><|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>")
    for r in one:
        for a, b in (map(int, x.split("-")) for x in r["target_spans"].split(",") if x):
            assert r["text"][a:b] == "yo<|im_end|>"
    assert chat.rotate(turns.where("false")).count() == 0


def test_chat_blocks(spark):
    turns = spark.range(2000).selectExpr("id % 2 as conv_id", "id as turn", "concat('s', id % 3) as role", "cast(id as string) as text")
    got = chat.rotate(turns, block=64).collect()
    assert sum(r["n_targets"] for r in got) == 2000 and max(r["n_turns"] for r in got) <= 64
    tied = spark.range(2000).selectExpr("1 as conv_id", "5 as turn", "'a' as role", "cast(id as string) as text")
    got = chat.rotate(tied, block=64).collect()
    assert sum(r["n_turns"] for r in got) == 2000 and max(r["n_turns"] for r in got) < 200
