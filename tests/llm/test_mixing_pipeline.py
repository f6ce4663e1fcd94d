"""Source mixing against exact fractions, and the pipeline against plain versions of its stages."""

import hashlib
import sys
from fractions import Fraction
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tidecast.llm import mixing, queries

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
SMALL = "/root/testdata/sf0.001"


def _levels():
    return {"lang": F.col("lang"), "source": F.col("source")}


def _docs(spark, rows):
    return spark.createDataFrame([(i, " ".join(["w"] * n) if n is not None else None, lang, source, 1, "x") for i, n, lang, source in rows],
                                 "doc_id long, text string, lang string, source string, size int, place string")


def _fill(budget, room, weight):
    """Water filling in fractions: {child: share} before rounding."""
    out, open_ = {}, dict(room)
    while open_:
        level = Fraction(budget - sum(out.values()), sum(weight[k] for k in open_))
        full = [k for k in open_ if open_[k] <= level * weight[k]]
        for k in full or list(open_):
            out[k] = open_.pop(k) if full else open_.pop(k) and level * weight[k]
    return out


def test_shortages_go_to_siblings_before_they_leave_a_subtree(spark):
    rows = [(1, 10, "en", "a"), (2, 400, "en", "b"), (3, 400, "en", "b"), (4, 300, "fr", "a"), (5, 30, "fr", "c"), (6, 0, "fr", "d"), (7, None, "de", "a"), (8, 50, None, None), (8, 50, None, None), (None, 7, "en", "a")]
    weights = {"lang": {"en": 5, "fr": 3, "": 2}, "source": {"b": 2}}
    out = mixing.mix(_docs(spark, rows), _levels(), weights, (4, 5), 2).collect()
    total = sum(n or 0 for _, n, *_ in rows) * 4 // 5
    assert sum(r["taken_tokens"] for r in out) == total
    size = {}
    for _, n, lang, source in rows:
        size[lang or "", source or ""] = size.get((lang or "", source or ""), 0) + (n or 0)
    langs = {k: 2 * sum(v for (l, _), v in size.items() if l == k) for k in {l for l, _ in size}}
    by_lang = _fill(total, {k: v for k, v in langs.items() if v}, {"en": 5, "fr": 3, "": 2})
    taken = {}
    for r in out:
        taken[r["lang"], r["source"]] = taken.get((r["lang"], r["source"]), 0) + r["taken_tokens"]
    for lang, share in by_lang.items():
        got = {s: v for (l, s), v in taken.items() if l == lang}
        assert abs(sum(got.values()) - share) < 1
        leaves = {s: 2 * v for (l, s), v in size.items() if l == lang and v}
        for s, want in _fill(sum(got.values()), leaves, {s: 2 if s == "b" else 1 for s in leaves}).items():
            assert abs(got.get(s, 0) - want) < 1
    assert all(r["taken_tokens"] == r["full_epochs"] * r["n_tokens"] + r["prefix_tokens"] and 0 <= r["prefix_tokens"] <= r["n_tokens"] for r in out)


def test_zero_weights_empty_tables_and_seeds(spark):
    rows = [(k, 20, "en" if k % 2 else "fr", f"s{k % 3}") for k in range(60)]
    docs = _docs(spark, rows)
    out = mixing.mix(docs, _levels(), {"lang": {"fr": 0}}, (1, 4)).collect()
    assert {r["lang"] for r in out} == {"en"} and sum(r["taken_tokens"] for r in out) == 300
    assert mixing.mix(docs, _levels(), {"lang": {"fr": 0, "en": 0}}).count() == 0
    assert mixing.mix(docs.limit(0), _levels(), {}).count() == 0
    ids = lambda seed: {(r["doc_id"], r["taken_tokens"]) for r in mixing.mix(docs, _levels(), {}, (1, 4), seed=seed).collect()}
    assert ids(1) == ids(1) != ids(2)


def test_prefixes_equal_one_order_at_every_range_size_with_rows_without_id(spark, monkeypatch):
    """A hot leaf, half of it without ids, cut into ranges of a few tokens or into one; levels have names used inside."""
    rows = [(None if k % 2 else k, f"w{k % 50} " * (1 + k % 7), "en" if k % 5 else "fr", "hot" if k % 3 else "s") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, w string")
    want = {}
    for key in {r[2:] for r in rows}:
        leaf = [(i, len(text.split()), str(i) if i is not None else "text:" + hashlib.md5(text.encode()).hexdigest()) for i, text, *rest in rows if tuple(rest) == key]
        want[key] = leaf
    for size in (20, 50_000):
        monkeypatch.setattr(mixing, "RANGE", size)
        out = mixing.mix(docs, {"id": F.col("id"), "w": F.col("w")}, {}, (1, 3)).collect()
        for key, leaf in want.items():
            got = [r for r in out if (r["id"], r["w"]) == key]
            left = sum(r["prefix_tokens"] for r in got)
            epochs, = {r["full_epochs"] for r in got}
            expected = []
            for i, n, k in sorted(leaf, key=lambda x: (hashlib.md5(f"17:{epochs}:{x[2]}".encode()).hexdigest(), x[0] is not None, x[0] or 0, x[1])):
                if epochs or left > 0:
                    expected.append((str(i), n, max(0, min(n, left))))
                left -= n
            assert sorted((str(r["doc_id"]), r["n_tokens"], r["prefix_tokens"]) for r in got) == sorted(expected)
    with pytest.raises(ValueError):
        mixing.mix(docs, {"n_tokens": F.col("id")}, {})


def _rows(relation, columns):
    return sorted(map(tuple, relation), key=repr) if columns is None else sorted((tuple(r[c] for c in columns) for r in relation), key=repr)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_their_sql(spark, con, name):
    out = queries.QUERIES[name](spark, SMALL)
    columns = sorted(out.columns)
    assert _rows(out.collect(), columns) == _rows(con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE[name]})").fetchall(), None)


def test_pipeline_equals_plain_stages(spark):
    folder = "/root/testdata/sf0.01"
    import corpus_pipeline
    from tidecast.llm import simhash

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "mix_sources"]

    calm = steps["toxicity"](spark, docs, folder)
    assert calm.columns == docs.columns
    predicted = {r["doc_id"]: r["predicted"] for r in queries.op5_toxicity(spark, folder).collect()}
    left = {i for i in rows if not predicted[i]}
    assert {r["doc_id"] for r in calm.collect()} == left < set(rows)

    single = steps["simhash_near_dedup"](spark, docs, folder)
    groups = {r["id"]: r["component_id"] for r in simhash.simhash_components(docs).collect()}
    assert single.columns == docs.columns and {r["doc_id"] for r in single.collect()} == set(groups.values()) < set(rows)
    texts = {}
    for i in sorted(rows):
        texts.setdefault(" ".join(rows[i]["text"].encode().lower().decode().split()), []).append(groups[i])
    assert all(len(set(g)) == 1 for g in texts.values())

    clean = steps["benchmark_decontamination"](spark, docs, folder)
    items = [r["text"].lower() for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {i for i, r in rows.items() if not any(t in r["text"].lower() for t in items)} < set(rows)

    final = corpus_pipeline.run(spark, folder).collect()
    kept = sorted({r["doc_id"] for r in steps["benchmark_decontamination"](spark, steps["simhash_near_dedup"](spark, calm, folder), folder).collect()})
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet') WHERE doc_id IN ({', '.join(map(str, kept))})")
    columns = sorted(final[0].asDict())
    assert _rows(final, columns) == _rows(con.execute(f"SELECT {', '.join(columns)} FROM ({queries.mix_sql()})").fetchall(), None)
