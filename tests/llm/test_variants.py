"""Spelling variants against all pairs of words, neighbourhoods against their definition, chains of forms."""

import re
import zlib
from collections import Counter
from itertools import product

import numpy as np

from tidecast.llm import variants


def _plain_words(rows, least_length=7, least_count=2):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            words[run] += len(run) >= least_length
    return {w: n for w, n in words.items() if n >= least_count}


def _one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def _plain(rows):
    words = _plain_words(rows)
    near = {a: [b for b in words if _one_edit(a, b)] for a in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda b: (-words[b], b), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def _got(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    return {tuple(r) for r in variants.spelling_variants(docs, **more).collect()}


def test_variants_equal_all_pairs_with_hot_words_copies_and_odd_texts(spark):
    rnd = np.random.default_rng(8)
    letters = list("abéßÿ×")
    stems = ["".join(rnd.choice(letters, rnd.integers(6, 10))) for _ in range(60)]
    rows = [(None, "Wonderful WONDERFUL wonderfully"), (1, None), (2, ""), (3, " \n- 1234567 short"), (4, "x" * 30_000 + " " + "x" * 30_000), (4, "ÀÉÎõü ÀÉÎõüß ÀÉÎõüß")]
    rows += [(9, "necessary " * 400 + "neccessary necessary. neccessary " * 2), (10, "neccessaryy neccessary " * 30)] * 2
    for k in range(40):
        picked = rnd.choice(stems, 30)
        rows.append((100 + k // 2, " ".join(w if rnd.random() < 0.7 else w[:3] + rnd.choice(letters) + w[3 + rnd.integers(0, 2):] for w in picked)))
    got = _got(spark, rows)
    assert got == _plain(rows) and sum(r[4] > 0 for r in got) > 50 and any(r[1] is not None for r in got)


def test_forms_are_followed_to_the_last(spark):
    counts = {"aaaaaaa": 3, "aaaaaab": 30, "aaaaabb": 300, "aaaabbb": 3000, "aaabbbb": 30000}
    words = spark.createDataFrame(list(zip(counts, list(counts)[1:])), "word string, form string")
    assert {tuple(r) for r in variants.roots(words).collect()} == {(w, "aaabbbb") for w in counts if w != "aaabbbb"}
    assert variants.roots(words.limit(0)).count() == 0


def test_neighbourhood_is_every_word_within_one_edit():
    words = np.array(["", "0", "0120", "11111", "0120", "2", "001122"], object)
    seen = 0
    for places, found in variants.neighbour_hashes(words, 3):
        for place, row in zip(places, found):
            word = words[place]
            every = ["".join(p) for n in range(len(word) + 2) for p in product("012", repeat=n)]
            want = variants.shape_hashes(np.array([w for w in every if w == word or _one_edit(w, word)], object))
            assert sorted(row[row >= 0]) == sorted(want)  # each once
            seen += 1
    assert seen == len(words)


def test_long_words_take_memory_in_proportion():
    word = "0123" * 25_000
    (_, found), = variants.neighbour_hashes(np.array([word], object))
    assert found.shape[1] < 10 * len(word)
    assert variants.shape_hashes(np.array([word[:70_000] + word[70_001:]], object))[0] in found


def test_every_symbol_count_finds_the_same_pairs_and_empty_tables_give_none(spark):
    rows = [(k, "grammar grammer gramar grammars Hammers hammers hammer's hamers") for k in range(3)]
    assert _got(spark, rows, symbols=2) == _got(spark, rows, symbols=9) == _plain(rows)
    assert _got(spark, []) == set()
