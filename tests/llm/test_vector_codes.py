"""Vector codes against a plain Lloyd on one machine: all codes, errors and codebooks, edge rows, what migrates."""

import hashlib
import math

import numpy as np

from tidecast.llm import vector_codes


def _plain(vectors, parts=4, entries=256, rounds=4):
    """(codes, errors, digest) of whole-number vectors in the order of their ids."""
    width = len(vectors[0]) // parts
    cut = [[tuple(v[p * width:(p + 1) * width]) for p in range(parts)] for v in vectors]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda part, book: min(range(len(book)), key=lambda e: (gap(part, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            at = [best(c[p], books[p]) for c in cut]
            for e in set(at):
                mine = [c[p] for c, a in zip(cut, at) if a == e]
                books[p][e] = tuple(sum(x) // len(mine) for x in zip(*mine))
    codes = [[best(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(gap(c[p], books[p][e]) for p, e in enumerate(code)) for c, code in zip(cut, codes)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return ["".join(f"{e:02x}" for e in code) for code in codes], errors, digest


def _frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, row long, q string")


def test_codes_equal_plain_lloyd_with_hot_copies_ties_and_unusable_rows(spark):
    rnd = np.random.default_rng(4)
    hot = rnd.normal(0, 0.1, 8).astype("float32").tolist()
    usable = [(k, hot if k % 3 == 0 else rnd.normal(0, 0.1, 8).astype("float32").tolist(), None if k % 7 == 0 else k % 3) for k in range(700)]
    usable.append((5, rnd.normal(0, 0.1, 8).astype("float32").tolist(), 1))  # repeats an id
    unusable = [(900, None, 1), (901, [], 1), (902, [1.0, None, *hot[2:]], 1), (903, [math.nan, *hot[1:]], 1), (904, [math.inf, *hot[1:]], 1),
                (905, [1e30, *hot[1:]], 1), (906, hot[:4], 1)]
    frame = _frame(spark, [(*r, 1, "x") for r in usable + unusable]).repartition(7)
    out, done = vector_codes.compress(frame)
    got = sorted(((r["id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in out.collect()))
    rows = sorted(((i, [math.floor(x * 1024) for x in v], label) for i, v, label in usable), key=lambda r: (r[0], r[1]))
    codes, errors, digest = _plain([v for _, v, _ in rows])
    total = {}
    for (_, _, label), e in zip(rows, errors):
        total[label] = total.get(label, 0) + e
    assert got == sorted((i, c, e, total[label], digest) for (i, _, label), c, e in zip(rows, codes, errors))
    assert done.moved[0] == 4 * len(rows) and all(0 < m < 4 * len(rows) / 3 for m in done.moved[1:2])


def test_few_rows_lengths_that_do_not_divide_and_empty_tables(spark):
    rows = [(1, [0.5, -0.25, 1.0], 1, 1, ""), (2, [0.5, -0.25, 1.0], None, 1, ""), (None, [9.0, 9.0, 9.0], 2, 1, "")]
    out, done = vector_codes.compress(_frame(spark, rows))
    got = {r["id"]: r for r in out.collect()}
    # Copies share the first of two equal entries; the vector is filled up to four parts.
    assert got[1]["code"] == got[2]["code"] == "00000000" and got[None]["code"] == "02020200" and done.codebook.shape == (4, 3, 1)
    assert [got[k]["error"] for k in (1, 2, None)] == [0, 0, 0]
    assert vector_codes.compress(_frame(spark, rows).limit(0))[0].count() == 0


def test_only_parts_with_another_entry_are_shuffled(spark):
    """The union of stayers and arrivals keeps the partitions of the state, so stayers are not dealt again."""
    sc = spark.sparkContext
    rows, parts = np.arange(40), np.arange(40, dtype=np.int32).reshape(-1, 1)
    state = sc.parallelize(list(vector_codes._blocks(rows, parts, 0, np.repeat([0, 1], 20), 2)), 3).partitionBy(6, vector_codes._owner_hash)
    book = sc.broadcast(np.array([[[0], [18]]]))  # 10 is nearer to 18, 9 is as near to the first
    after, count = vector_codes._migrated(state.mapPartitions(vector_codes._merged, preservesPartitioning=True), book, 2, 6)
    blocks = dict(after.collect())
    assert after.getNumPartitions() == 6 and count.value == 10
    for (_, entry, salt), (ids, mine) in blocks.items():
        assert all((x > 9) == (entry == 1) and i % 2 == salt and i == x for i, x in zip(ids, mine[:, 0]))
    assert sum(len(ids) for ids, _ in blocks.values()) == 40


def test_nearest_is_exact_beyond_doubles():
    entries = np.array([[2 ** 27, 0], [2 ** 27 + 1, 0], [-2 ** 27, 1]], np.int64)
    at, gap = vector_codes.nearest(np.array([[2 ** 27 + 1, 3], [-2 ** 27, -2 ** 27]], np.int64), entries)
    assert at.tolist() == [1, 2] and gap.tolist() == [9, (2 ** 27 + 1) ** 2]
