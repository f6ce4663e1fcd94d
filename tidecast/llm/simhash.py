"""SimHash near-duplicates: 64-bit fingerprints, a byte-position inverted index with count filtering.

Two fingerprints that differ in at most four bits agree in at least four of their eight byte
positions. Lists under single bytes would hold a 256th of all documents each and grow with the
square of the corpus, so a list is keyed by three positional bytes at once: with the positions
split into three groups, the triples inside a group or with two in one group and one in the next
hit every choice of four positions (20 triples). The shared positional bytes of the pairs in a
list are tallied, pairs below the guaranteed minimum leave, the rest is verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, combinations, islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import broadcast_up_to
from tidecast.llm.components import connected_components, smallest_reached
from tidecast.staging import stage

BYTES = 8
MAX_BITS = 4
SEED = 42
# Members of one index list that are compared in one task; longer lists are cut into pairs of blocks.
BLOCK = 2_000
# Keys of long lists that may be broadcast (16 bytes each); beyond it the join shuffles.
HOT_KEYS = 100_000
# Ids of copies that may be broadcast to leave them out.
MOST_COPIES = 1_000_000

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_OFFSETS = (256 * np.arange(BYTES)).astype(np.int64)


def position_triples() -> list[tuple[int, int, int]]:
    """Triples of byte positions such that every four positions contain one of them."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    inside = [t for g in groups for t in combinations(g, 3)]
    across = [(*two, one) for k, g in enumerate(groups) for two in combinations(g, 2) for one in groups[(k + 1) % 3]]
    return inside + across


def fingerprint(text: str | None, width: int = 4) -> int:
    """Unsigned 64-bit fingerprint of one text; zero without words."""
    return int.from_bytes(_majority(_hashes(text, width)), "little")


def _hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles in bounded pieces; none without words, one for fewer words than ``width``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    data = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    spans = zip([0, *ends[:-1]], ends[width - 1:] or ends[-1:])
    digest = xxhash.xxh64_intdigest
    while len(h := np.fromiter((digest(data[a:b - 1], SEED) for a, b in islice(spans, 1 << 16)), np.uint64)):
        yield h


def _majority(pieces: Iterable[np.ndarray]) -> bytes:
    counts, total = np.zeros(BYTES * 256, np.int64), 0
    for h in pieces:
        total += len(h)
        counts += np.bincount((h.view(np.uint8).reshape(-1, BYTES) + _OFFSETS).ravel(), minlength=BYTES * 256)
    ones = counts.reshape(BYTES, 256) @ _BITS
    return np.packbits((2 * ones > total).astype(np.uint8).ravel(), bitorder="little").tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp): one row per row of ``docs``; fp is the fingerprint as a signed long."""

    def each(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fps = np.array([fingerprint(t, width) for t in f["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"id": f["id"], "fp": fps})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(each, "id long, fp long")


def _links_in_lists(frames: Iterable[pd.DataFrame], link: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lists arrive sorted by (key, i, j); emits (a, b): each linked member with the smallest one it reaches."""
    rest = None
    for f in frames:
        f = f if rest is None else pd.concat([rest, f], ignore_index=True)
        tail = (f[["key", "i", "j"]] == f[["key", "i", "j"]].iloc[-1]).all(axis=1).to_numpy() if len(f) else np.zeros(0, bool)
        rest, ready = f[tail], f[~tail]
        if len(ready):
            yield link(ready)
    if rest is not None and len(rest):
        yield link(rest)


def _link(f: pd.DataFrame, max_bits: int, min_bytes: int) -> pd.DataFrame:
    unit = f[["key", "i", "j"]].to_numpy()
    group = np.concatenate([[0], np.cumsum((unit[1:] != unit[:-1]).any(axis=1))])
    rep, fp = f["rep"].to_numpy(), f["fp"].to_numpy()
    fp = (np.frombuffer(b"".join(fp), np.uint64) if fp.dtype == object else fp.view(np.uint64)).reshape(len(f), -1)
    left, right, shift = [], [], 1
    at = np.nonzero(group[shift:] == group[:-shift])[0]
    while len(at):
        differing = fp[at] ^ fp[at + shift]
        tally = (differing.view(np.uint8).reshape(len(at), -1) == 0).sum(axis=1)
        kept = tally >= min_bytes
        near = np.bitwise_count(differing[kept]).sum(axis=1) <= max_bits
        left.append(at[kept][near])
        right.append(at[kept][near] + shift)
        shift += 1
        at = at[at < len(group) - shift]
        at = at[group[at + shift] == group[at]]
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    label = smallest_reached(rep, a, b)
    linked = label != rep
    return pd.DataFrame({"a": rep[linked], "b": label[linked]})


def fingerprint_links(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints (fp, rep) differing in at most four bits.

    Every near pair is connected by the links, though not every pair is written: a task keeps the
    members of a list linked to the smallest one they reach. A list longer than ``block`` is cut
    into blocks, and each two blocks meet in a task of their own.
    """
    byte = lambda k: F.shiftrightunsigned("fp", 8 * k).bitwiseAND(F.lit(255))
    keys = [F.lit(n << 24) + byte(a) * 65536 + byte(b) * 256 + byte(c) for n, (a, b, c) in enumerate(position_triples())]
    return _linked(classes, keys, MAX_BITS, BYTES - MAX_BITS, block)


def _linked(classes: DataFrame, keys: list[Column], max_bits: int, min_bytes: int, block: int) -> DataFrame:
    index = classes.select("rep", "fp", F.explode(F.array(*keys)).alias("key"))
    return _in_blocks(index, "rep", ["fp"], lambda f: _link(f, max_bits, min_bytes), block)


def _in_blocks(index: DataFrame, node: str, carried: list[str], link: Callable[[pd.DataFrame], pd.DataFrame], block: int) -> DataFrame:
    """Links (a, b) of the lists (key, node, carried); each two blocks of a list longer than ``block`` meet in a task."""
    long = stage(index.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).alias("blocks")), "hot")
    index = index.join(broadcast_up_to(long, HOT_KEYS), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    index = index.withColumn("own", F.pmod(F.xxhash64(node), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = index.select("key", *carried, node, "own", other.alias("other")).select(
        "key", F.least("own", "other").cast("long").alias("i"), F.greatest("own", "other").cast("long").alias("j"), *carried, node)
    units = units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return units.mapInPandas(lambda fs: _links_in_lists(fs, link), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fingerprint, component_id) for every row: 16 hex digits and the smallest id reachable.

    Links join fingerprints that differ in at most four bits; copies share a fingerprint and are
    carried as one member. Null and empty texts have fingerprint zero and link like any other.
    Repeated ids give a row each. Rows without id get the component of their fingerprint, null if
    no row of it has an id. Other columns of ``docs`` are not looked at.
    """
    prints = stage(fingerprints(docs, id_col, text_col, width), "prints")
    classes = stage(prints.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    joined = connected_components(fingerprint_links(classes.where("rep is not null")))
    classes = stage(classes.join(joined, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "classes")
    return prints.join(classes, "fp").select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """Rows of ``docs`` whose id is the smallest of their component.

    Rows without id stay, as nothing tells which row they repeat; rows that repeat a kept id stay too.
    """
    groups = simhash_components(docs, id_col, text_col, width)
    gone = stage(groups.where("id <> component_id").select(F.col("id").alias("_gone")).distinct(), "copies")
    # The row itself in one column, so that no name of it can clash.
    rows = docs.select(F.struct("*").alias("_doc"), F.col(id_col).cast("long").alias("_id"))
    return rows.join(broadcast_up_to(gone, MOST_COPIES), F.col("_id") == F.col("_gone"), "left_anti").select("_doc.*")
