"""Operators that SQL can't express, against plain versions, exact round trips or held-out accuracy."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tessella.llm import exact_dedup, jaccard, langid, media, packing, sentencepiece_scan, toxicity
from tessella.llm.common import chains, table, word_hashes
from tessella.llm.components import components

SF = "/root/testdata/sf0.01"


def test_word_hashes_are_local():
    texts = [b"One two, THREE", b"", b"three", "é à".encode(), b"w" * 9000 + b" w"]
    h, at = word_hashes(texts)
    assert list(np.diff(at)) == [3, 0, 1, 2, 2] and h[2] == h[3] and len(set(h.tolist())) == 7
    assert len(chains(h, 5)) == 4


def test_jaccard_against_all_pairs(spark):
    got = {r.doc_id: r for r in jaccard.join(table(spark, SF, "documents")).collect()}
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    sets = [set(jaccard.gram_sets([t.encode()])[0].tolist()) for _, t in rows]
    inverted, links, root = {}, Counter(), {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j, k in Counter(j for g in s for j in inverted.get(g, ())).items():
            if 5 * k >= 4 * (len(s) + len(sets[j]) - k):
                a, b = rows[i][0], rows[j][0]
                links.update((a, b))
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        for g in s:
            inverted.setdefault(g, []).append(i)
    assert {i: (links[i], find(i)) for i, _ in rows} == {i: (r.n_links, r.class_id) for i, r in got.items()}


def test_jaccard_blocks(spark, monkeypatch):
    """A large group of near copies, cut into many blocks, loses no link."""
    random.seed(4)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(60):
        words = list(base)
        words[random.randrange(120)] = f"x{i % 40}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = {r.doc_id: (r.n_links, r.class_id, r.copy_id) for r in jaccard.join(docs).collect()}
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 7)
    assert plain == {r.doc_id: (r.n_links, r.class_id, r.copy_id) for r in jaccard.join(docs).collect()}
    assert {c for _, c, _ in plain.values()} == {0} and min(n for n, _, _ in plain.values()) == 59


def test_prefix_depth_reaches_recall():
    d = jaccard.least_depth()
    assert 1 - (1 - 0.8**d) ** jaccard.TREES >= 0.999 > 1 - (1 - 0.8 ** (d + 1)) ** jaccard.TREES
    assert jaccard.least_grams(0.8) == 4 and jaccard.least_grams(0.5) == 1


def test_prefixes_are_shortened_no_further_than_needed(spark, monkeypatch):
    """Very similar pairs alone are matched by full labels; pairs near the threshold call for shorter prefixes."""
    depths, tied = [], jaccard._tied
    monkeypatch.setattr(jaccard, "_tied", lambda *a: depths.append(a[3]) or tied(*a))
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:200], "x", *words[201:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_links for r in jaccard.join(docs).collect()] == [1, 1] and depths == [8]
    depths.clear()
    rows += [(100 * t + i, " ".join([f"t{t}", *words[:40], *(f"u{t}x{j}" for j in range(i))])) for t in range(1, 9) for i in (0, 9)]  # 37 of 46 5-grams
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in jaccard.join(docs).collect()}
    assert depths == [8, 7, 6] and got[1] == got[2] == 1 and got[100] >= 1


def test_pairs_are_counted_in_the_first_tree_where_they_meet():
    roots = np.array([[1, 5, 7], [1, 5, 8], [2, 5, 8]])
    assert jaccard.meeting(roots, 0)[0].tolist() == [True, True, False]
    assert jaccard.meeting(roots, 1).tolist() == [[False, False, True], [False, False, True], [True, True, False]]
    assert not jaccard.meeting(roots, 2).any()


def test_forest_labels_keep_prefixes():
    forest, rng = jaccard.Forest(6, 8, 6), np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [a, np.concatenate([a[:290], a[:10] + np.uint64(1)]), a[:150]]
    sig = np.array([[(forest.a[j] * s + forest.b[j]).min() for j in range(48)] for s in sets]).reshape(3, 6, 8)
    root, rest = (np.array(x) for x in zip(*(forest.labels(s) for s in sets)))
    for i, j in ((0, 1), (0, 2), (1, 2)):
        for t in range(6):
            same = (sig[i, t] == sig[j, t]).cumprod().sum()
            assert (root[i, t] == root[j, t]) == (same >= 6)
            for d in (7, 8):
                high = [int(x) % 2**64 >> forest.shift(d) for x in (rest[i, t], rest[j, t])]
                assert (root[i, t] == root[j, t] and high[0] == high[1]) == (same >= d)


def test_packing_is_whole(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    rows = [r.asDict() for r in packing.pack_documents(table(spark, SF, "documents")).collect()]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert pieces.keys() == texts.keys()
    for (i, t), got in zip(texts.items(), tokenizer.encode_batch([t or "" for t in texts.values()], add_special_tokens=False), strict=True):
        ids = np.array([*got.ids, 1], "<u4")
        own = sorted(pieces[i], key=lambda r: r["start"])
        at = 0
        for r in own:
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for got in by.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at <= packing.SEQ
    assert sum(r["length"] for r in rows) / (packing.SEQ * len(by)) > 0.97


def test_column_generation_is_near_the_bound():
    rng = np.random.default_rng(1)
    demand = np.bincount(rng.integers(1, 65, 5000) - 1, minlength=64)
    plan = packing.column_generation(demand, 64)
    made = sum(p * n for p, n in plan)
    assert (made >= demand).all() and all((p * np.arange(1, 65)).sum() <= 64 for p, _ in plan)
    assert sum(n for _, n in plan) <= 1.02 * (demand * np.arange(1, 65)).sum() / 64


@pytest.mark.parametrize("size", [17, 64, 501])
def test_sentencepiece_scan_equals_the_library(size):
    m, rng = sentencepiece_scan.bpe(sentencepiece_scan.MODEL), random.Random(size)
    texts = ["".join(rng.choice("abcdeéß the ing\n  ▁世界") for _ in range(n)) for n in (1, 5, 40, 200, 700)]
    texts += ["the" * 100, " " * 70, "aaaa" * 50, "\n" * 40, "123456789" * 20, "internationalisation" * 12]
    for t in texts:
        s, k = "▁" + t.replace(" ", "▁"), m.longest
        cut = [sentencepiece_scan.Chunk(m, s[max(0, a - k) : a], s[a : a + size], s[a + size : a + size + k]) for a in range(0, len(s), size)]
        states = sentencepiece_scan.scan([c.matrix() for c in cut])
        assert [i for c, st in zip(cut, states, strict=True) for i in c.trace(*st)] == m.sp.encode(t)


def test_sentencepiece_round_trip(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    m = sentencepiece_scan.bpe(sentencepiece_scan.MODEL)
    got = {r.doc_id: r for r in sentencepiece_scan.decode(sentencepiece_scan.encode(docs, chunk=300)).collect()}
    for r in docs.collect():
        ids = m.sp.encode(r.text)
        digest = sum((i + 1) * t for i, t in enumerate(ids)) % sentencepiece_scan.PRIME
        assert (got[r.doc_id].text, got[r.doc_id].n_tokens, got[r.doc_id].ids_digest) == (r.text, len(ids), digest)
    assert max(r.n_chunks for r in got.values()) > 5


def test_media_round_trip():
    rng = random.Random(2)
    for n in (0, 1, 64, 65, 4096, 4097, 20_000):
        for raw in (bytes(rng.randrange(256) for _ in range(n)), b"abc " * (n // 4)):
            payload = media.padded(raw)
            reader = media.Reader(media.encode(payload))
            frames = reader.coefficients()
            assert media.payload_of([c for _, c in frames], len(payload)) == payload
            frames[0][0].aligned = False  # the symbol-by-symbol decoder agrees
            at, size = reader.frames[0]
            assert (media.coefficients(frames[0][0], reader.media[at : at + size]) == frames[0][1]).all()


def test_shots_are_cut_where_histograms_jump():
    h = np.array([[100, 0, 0]] * 10 + [[0, 100, 0]] * 5 + [[0, 0, 100]] * 5)
    assert media.clips(h, 5.0) == [(0.0, 2.0), (2.0, 3.0), (3.0, 4.0)]


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.96
    assert np.mean([r.predicted for r in rows if r.toxic == 0]) < 0.03


def test_held_out_language(spark):
    docs = table(spark, SF, "documents")
    rows = langid.predict(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.98


def test_codewords_are_apart():
    for k in (2, 3, 4, 6, 12, 40):
        c = langid.codewords(k)
        assert min((a != b).sum() for i, a in enumerate(c) for b in c[:i]) >= max(1, c.shape[1] // 4)


def test_trie_keeps_smallest_owner():
    trie = exact_dedup.PatriciaTrie()
    for i, t in enumerate([b"abc", b"ab", b"", b"abd", b"abc", b"b", b"ab", b"abcdef"]):
        trie.insert(t, 10 - i, 1, 1)
    trie.insert(b"ab", 4, 2, 5)
    trie.insert(b"b", None, 1, 1)
    assert sorted(trie.terminals()) == [(b"", 8, 1, 1), (b"ab", 4, 3, 7), (b"abc", 6, 1, 2), (b"abcdef", 3, 1, 1), (b"abd", 7, 1, 1), (b"b", 5, 1, 2)]


def test_components_of_chains_and_stars(spark):
    """Links in any order, repeated, reversed or of a node with itself; stars are returned as they come."""
    random.seed(9)
    chain = [(i, i + 1) for i in range(0, 200)]
    star = [(1000 + i, 1000) for i in range(1, 300)]
    web = [(random.randrange(3000, 3400), random.randrange(3000, 3400)) for _ in range(250)]
    links = chain + star + web + web[:20] + [(v, u) for u, v in web[20:40]] + [(7000, 7000)]
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    random.shuffle(links)
    for own in (links, star, []):
        got = {r.node: r.root for r in components(spark.createDataFrame(own, "u long, v long")).collect()}
        assert got == {x: find(x) for pair in own for x in pair if find(x) != x}
