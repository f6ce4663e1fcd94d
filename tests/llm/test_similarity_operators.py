"""Embedding and SimHash near-duplicates against all pairs, components against union-find."""

from itertools import combinations

import numpy as np
import xxhash

from tidecast.llm import pq_dedup, simhash
from tidecast.llm.components import connected_components


def _components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_strays(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200), (300, 250), (250, 275)]
    frame = spark.createDataFrame([*links, (None, 5), (5, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(frame).collect()}
    assert got == _components({n for x in links for n in x}, links)
    assert connected_components(frame.limit(0)).count() == 0


def test_triples_meet_every_four_positions():
    triples = [set(t) for t in simhash.position_triples()]
    assert len(triples) == 20 and all(any(t <= set(four) for t in triples) for four in combinations(range(8), 4))


def _plain_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k:k + width]) for k in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_simhash_equals_all_pairs(spark):
    rnd = np.random.default_rng(2)
    words = [f"w{k}" for k in range(300)]
    texts = ["", None, " \t ", "One two", "one TWO", "a b c d", "Über alles  GEHT\nes", "x" * 50_000]
    for _ in range(12):
        base = list(rnd.choice(words, 300))
        texts += [" ".join(base), " ".join(base).upper(), *[" ".join([*base[:k], "new", *base[k + 1:]]) for k in range(0, 12, 2)]]
    rows = [(k, t, "x", 0) for k, t in enumerate(texts)] + [(None, "a b c d", "x", 0), (None, "alone in the world it is", "x", 0), (3, "One two", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, key int")
    prints = {k: _plain_fingerprint(t) for k, t in enumerate(texts)}
    links = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = _components(prints, links)
    assert len(set(want.values())) < len(set(prints.values()))
    got = simhash.simhash_components(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["id"] is not None:
            assert (int(r["fingerprint"], 16), r["component_id"]) == (prints[r["id"]], want[r["id"]])
    assert sorted(str(r["component_id"]) for r in got if r["id"] is None) == ["5", "None"]
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_one_of_each_group_of_near_copies_stays(spark):
    rnd = np.random.default_rng(6)
    words = [f"w{k}" for k in range(3_000)]
    texts = ["", None, "One two", "one\tTWO", "a b c d", "alone here"]
    for _ in range(25):  # texts of 300 words with up to two words changed, and one that shares a third
        base = list(rnd.choice(words, 300))
        texts += [" ".join(base), " ".join(base).upper() + "\n", *[" ".join([*base[:k], "new", *base[k + 1:150], "old", *base[151:]]) for k in range(0, 100, 20)]]
        texts.append(" ".join([*base[:100], *rnd.choice(words, 200)]))
    prints = {k: _plain_fingerprint(t) for k, t in enumerate(texts)}
    first = _components(prints, [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4])
    rows = [(k, t, "x", 0, 1, 2) for k, t in enumerate(texts)] + [(None, "a b c d", "x", 0, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, key int, _id int, _gone int")
    kept = simhash.keep_one_per_group(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {*first.values(), None} and len(set(first.values())) <= len(texts) - 25
    assert simhash.keep_one_per_group(docs.limit(0)).count() == 0


def test_long_index_lists_are_cut_into_blocks(spark):
    rnd = np.random.default_rng(4)
    fps = {0}
    while len(fps) < 150:  # one list holds them all: they differ in the last bytes only
        fps.add(int(sum(1 << int(b) for b in rnd.choice(24, rnd.integers(1, 4)))))
    rows = [(k, fp) for k, fp in enumerate(sorted(fps))]
    frame = spark.createDataFrame(rows, "rep long, fp long")
    want = _components([k for k, _ in rows], [(a, b) for (a, x), (b, y) in combinations(rows, 2) if (x ^ y).bit_count() <= 4])
    for block in (10, 2_000):
        got = {r["node"]: r["component"] for r in connected_components(simhash.fingerprint_links(frame, block)).collect()}
        assert {k: got.get(k, k) for k in want} == want


def test_embeddings_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(pq_dedup, "ROWS_PER_LIST", 20)
    rnd = np.random.default_rng(3)
    vectors = []
    for _ in range(40):
        base = rnd.normal(size=12)
        vectors += [base, 3 * base, *[base + rnd.normal(size=12) * 0.05 * np.linalg.norm(base) for _ in range(rnd.integers(0, 6))]]
    rows = [(k, [float(x) for x in v.astype(np.float32)], k % 2) for k, v in enumerate(vectors)]
    n = len(rows)
    odd = [(n, None, 1), (n + 1, [0.0] * 12, 1), (n + 2, [float("nan")] * 12, 1), (n + 3, [None] * 12, 1), (n + 4, [], 1), (n + 5, rows[0][1], None),
           (n + 6, rows[1][1], 1), (n + 7, rows[1][1], 1), (n + 8, rows[1][1][:5], 1), (n + 9, [1e30] * 12, 0), (n + 10, [1e-30] * 12, 0), (n + 11, [float("inf")] * 12, 0)]
    frame = spark.createDataFrame([(i, v, y, 0) for i, v, y in rows + odd], "vec_id long, embedding array<float>, label int, part int")
    usable = {i: (np.array(v, float), y) for i, v, y in [*rows, *(odd[k] for k in (6, 7, 8, 9, 10))]}
    cosine = lambda a, b: float(a / np.linalg.norm(a) @ (b / np.linalg.norm(b)))
    links = [(a, b) for a, b in combinations(usable, 2) if usable[a][1] == usable[b][1] and len(usable[a][0]) == len(usable[b][0]) and cosine(usable[a][0], usable[b][0]) >= 0.98]
    want = _components([i for i, *_ in rows + odd], links)
    for block in (7, 2_048):
        monkeypatch.setattr(pq_dedup, "BLOCK", block)
        for r in pq_dedup.embedding_components(frame).collect():
            assert (r["n_links"], r["component_id"], r["kept"]) == (sum(r["id"] in x for x in links), want[r["id"]], r["id"] == want[r["id"]])
    assert pq_dedup.embedding_components(frame.limit(0)).count() == 0
    assert {r["n_links"] for r in pq_dedup.embedding_components(frame.where("vec_id = %d" % n)).collect()} == {0}
