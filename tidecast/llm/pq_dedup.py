"""Embedding near-dedup by product quantisation: inverted lists, residual codes, table-lookup distances, exact rerank.

All vectors are scaled to length one, so a cosine of c is a distance of sqrt(2 - 2c). Every bound
used to leave a pair out is one that no linked pair can break: a vector probes each list whose cell
lies within that distance of it, and a member stays a candidate while its looked-up distance is at
most that distance plus the member's own quantisation error. Candidates are reranked by exact
cosines in double precision. So the index decides how much work there is, not what is found.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import broadcast_up_to
from tidecast.llm.components import connected_components, smallest_reached
from tidecast.staging import stage

COSINE = 0.98
# The index is fitted on at most this many rows; it has a list for every so many rows, up to MOST_LISTS.
SAMPLE = 20_000
ROWS_PER_LIST = 512
MOST_LISTS = 1_024
SUBSPACES = 8
CODES = 64
# Lists whose members meet in one task, and the most members, and vectors that probe them, that do so.
GROUP = 16
BLOCK = 2_048
# Rows of the table of group sizes that may be broadcast.
MOST_GROUPS = 100_000
_SLACK = 1e-6


@dataclass(frozen=True)
class Index:
    """Coarse centroids, and per subspace the codewords of the residuals."""

    lists: np.ndarray
    codewords: np.ndarray

    @property
    def padded(self) -> int:
        return self.codewords.shape[0] * self.codewords.shape[2]


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids ** 2).sum(axis=1) - 2 * x @ centroids.T, axis=1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, centroids)
        size = np.bincount(at, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, at, x)
        centroids[size > 0] = total[size > 0] / size[size > 0, None]
    return centroids


def fit_index(sample: np.ndarray, rows: int, seed: int = 3) -> Index:
    """An index for ``rows`` unit vectors, fitted on a sample of them (doubles, one row each)."""
    rng = np.random.default_rng(seed)
    width = -(-sample.shape[1] // SUBSPACES)
    x = np.pad(sample, ((0, 0), (0, SUBSPACES * width - sample.shape[1])))
    lists = _kmeans(x, min(MOST_LISTS, max(1, rows // ROWS_PER_LIST)), rng)
    residual = (x - lists[_nearest(x, lists)]).reshape(len(x), SUBSPACES, width)
    words = [_kmeans(residual[:, s], CODES, rng) for s in range(SUBSPACES)]
    return Index(lists, np.stack([np.pad(w, ((0, CODES - len(w)), (0, 0)), mode="edge") for w in words]))


def _unit(vectors: Iterable, width: int) -> np.ndarray:
    x = np.zeros((len(vectors), width))
    for row, v in zip(x, vectors):
        row[:len(v)] = v
    # By the largest component first, so that squares neither overflow nor vanish.
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _probes(x: np.ndarray, index: Index, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, list) for each list that a vector within ``reach`` of the row may be in.

    A partner in cell j is no farther from centroid j than from the row's own centroid i, so the
    row lies within ``reach`` of that side of the plane between the two.
    """
    c = index.lists
    apart = np.sqrt(np.maximum(0, ((c[:, None, :] - c[None, :, :]) ** 2).sum(axis=2))) if len(c) <= 256 else None
    for k in range(0, len(x), 1024):
        part = x[k:k + 1024]
        d2 = np.maximum(0, (part ** 2).sum(axis=1)[:, None] - 2 * part @ c.T + (c ** 2).sum(axis=1))
        own = d2.argmin(axis=1)
        between = apart[own] if apart is not None else np.sqrt(np.maximum(0, (c[own] ** 2).sum(axis=1)[:, None] - 2 * c[own] @ c.T + (c ** 2).sum(axis=1)))
        row, lists = np.nonzero(d2 - d2[np.arange(len(part)), own][:, None] <= 2 * reach * between + _SLACK)
        yield row + k, lists


def _place(frames: Iterable[pd.DataFrame], index: Index, reach: float, kind: str) -> Iterator[pd.DataFrame]:
    """Each vector once as a member of its list, and once per group of lists it probes (``lists``: their bits)."""
    subspaces, _, width = index.codewords.shape
    for f in frames:
        if not len(f):
            continue
        x = _unit(f["embedding"].tolist(), index.padded)
        own = _nearest(x, index.lists)
        residual = (x - index.lists[own]).reshape(len(x), subspaces, width)
        codes = np.stack([_nearest(residual[:, s], index.codewords[s]) for s in range(subspaces)], axis=1).astype(np.uint8)
        error = np.sqrt(((residual - index.codewords[np.arange(subspaces), codes]) ** 2).sum(axis=(1, 2)))
        base = f[["label", "dims", "rep", "copies"]].assign(vector=[np.asarray(v, kind).tobytes() for v in f["embedding"]])
        yield base.assign(part=own // GROUP, lists=own % GROUP, member=True, code=[c.tobytes() for c in codes], error=error)
        for row, lists in _probes(x, index, reach):
            bits = pd.Series(1 << (lists % GROUP)).groupby([row, lists // GROUP]).sum()
            at = bits.index.get_level_values(0).to_numpy()
            yield base.iloc[at].assign(part=bits.index.get_level_values(1).to_numpy(), lists=bits.to_numpy(), member=False, code=None, error=0.0)


_PLACED = "label string, dims int, rep long, copies long, vector binary, part int, lists int, member boolean, code binary, error double"


def _looked_up(queries: np.ndarray, centroid: np.ndarray, codes: np.ndarray, codewords: np.ndarray) -> np.ndarray:
    """Distances from each query to the decoded members, from one table of subspace distances per query."""
    subspaces, _, width = codewords.shape
    residual = (queries - centroid).reshape(len(queries), subspaces, width)
    total = np.zeros((len(queries), len(codes)))
    for s in range(subspaces):
        r, w = residual[:, s], codewords[s]
        table = np.maximum(0, (r ** 2).sum(axis=1)[:, None] - 2 * r @ w.T + (w ** 2).sum(axis=1))
        total += table[:, codes[:, s]]
    return np.sqrt(total)


def _compare(f: pd.DataFrame, index: Index, cosine: float, kind: str) -> pd.DataFrame:
    """One block of members against one block of probes: (rep, n, other).

    n counts the vectors linked to a probe; (rep, other) connect whatever is linked in the block.
    """
    members, probes = f[f["member"]], f[~f["member"]]
    unit = lambda rows: _unit([np.frombuffer(v, kind) for v in rows["vector"]], index.padded)
    if not len(members) or not len(probes):
        return pd.DataFrame({"rep": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "other": np.zeros(0, np.int64)})
    m, p, first = unit(members), unit(probes), int(members["part"].iloc[0]) * GROUP
    codes = np.frombuffer(b"".join(members["code"]), np.uint8).reshape(len(members), -1)
    rep_m, rep_p, copies, error = members["rep"].to_numpy(), probes["rep"].to_numpy(), members["copies"].to_numpy(), members["error"].to_numpy()
    of_list, asked, reach = members["lists"].to_numpy(), probes["lists"].to_numpy(), np.sqrt(2 - 2 * cosine)
    linked, left, right = np.zeros(len(p), np.int64), [], []
    for k in range(GROUP):
        cols, rows = np.flatnonzero(of_list == k), np.flatnonzero(asked >> k & 1)
        for at in range(0, len(rows) if len(cols) else 0, 256):
            some = rows[at:at + 256]
            near = _looked_up(p[some], index.lists[first + k], codes[cols], index.codewords) <= reach + error[cols] + _SLACK
            r, c = np.nonzero(near & (rep_p[some, None] != rep_m[cols]))
            r, c = some[r], cols[c]
            for piece in range(0, len(r), 1 << 16):
                a, b = r[piece:piece + (1 << 16)], c[piece:piece + (1 << 16)]
                true = np.einsum("ij,ij->i", p[a], m[b]) >= cosine
                np.add.at(linked, a[true], copies[b[true]])
                left.append(a[true].astype(np.int32))
                right.append(b[true].astype(np.int32) + len(p))
    nodes = np.concatenate([rep_p, rep_m])
    low = smallest_reached(nodes, np.concatenate(left or [np.zeros(0, np.int32)]), np.concatenate(right or [np.zeros(0, np.int32)]))
    n = np.concatenate([linked, np.zeros(len(m), np.int64)])
    keep = (n > 0) | (low != nodes)
    return pd.DataFrame({"rep": nodes[keep], "n": n[keep], "other": low[keep]})


def _usable(vector: str) -> str:
    return f"{vector} IS NOT NULL AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists({vector}, x -> x <> 0)"


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component_id, kept): one row per row of ``vectors``.

    Vectors of one label and length link at a cosine of at least ``cosine``. Null labels or ids,
    and vectors that are null, empty, zero or hold a null or non-finite component, link with
    nothing. Copies are carried as one and counted as links of each other; rows of one id with
    different vectors are one member. n_links counts other rows linked directly. An empty table
    gives no rows. Other columns are not looked at.
    """
    kind = "float32" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "float64"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("embedding"))
    rows = rows.withColumn("usable", F.expr(f"id IS NOT NULL AND label IS NOT NULL AND {_usable('embedding')}"))
    # Two hashes with different beginnings tell vectors apart.
    same = [F.when(F.col("usable"), F.xxhash64(F.lit(k), "label", "embedding")).alias(f"k{k}") for k in (0, 1)]
    rows = rows.select("*", *same)
    classes = rows.where("usable").groupBy("k0", "k1").agg(
        F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"), F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = stage(classes.withColumn("dims", F.size("embedding")), "vectors")
    size = classes.agg(F.count("*").alias("n"), F.max("dims").alias("wide")).first()
    links = None
    if size["n"]:
        sample = classes.select("embedding").orderBy(F.xxhash64("k0"), "k1").limit(SAMPLE).toPandas()["embedding"].tolist()
        index = fit_index(_unit(sample, size["wide"]), size["n"])
        reach = float(np.sqrt(2 - 2 * cosine))
        placed = stage(classes.select("label", "dims", "rep", "copies", "embedding").mapInPandas(lambda fs: _place(fs, index, reach, kind), _PLACED), "placed")
        unit = ["label", "dims", "part"]
        blocks = lambda which: F.ceil(F.greatest(F.lit(1), F.count_if(which)) / BLOCK).cast("int")
        sizes = stage(placed.groupBy(*unit).agg(blocks(F.col("member")).alias("m_blocks"), blocks(~F.col("member")).alias("p_blocks")), "sizes")
        met = placed.join(broadcast_up_to(sizes, MOST_GROUPS), unit)
        own = F.pmod(F.xxhash64("rep"), F.when(F.col("member"), F.col("m_blocks")).otherwise(F.col("p_blocks"))).cast("int")
        met = met.withColumn("own", own).withColumn(
            "other", F.explode(F.sequence(F.lit(0), F.when(F.col("member"), F.col("p_blocks")).otherwise(F.col("m_blocks")) - 1)))
        met = met.withColumns({"m_block": F.when(F.col("member"), F.col("own")).otherwise(F.col("other")), "p_block": F.when(F.col("member"), F.col("other")).otherwise(F.col("own"))})
        met = met.drop("own", "other", "m_blocks", "p_blocks")
        links = stage(met.groupBy(*unit, "m_block", "p_block").applyInPandas(lambda f: _compare(f, index, cosine, kind), "rep long, n long, other long"), "links")
        joined = connected_components(links, "rep", "other").withColumnsRenamed({"node": "rep", "component": "component_id"})
        counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
        classes = classes.join(counts, "rep", "left").join(joined, "rep", "left")
    else:
        classes = classes.withColumns({"n": F.lit(0).cast("long"), "component_id": F.col("rep")})
    found = stage(classes.select("k0", "k1", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")), "classes")
    out = rows.select("id", "k0", "k1").join(found, ["k0", "k1"], "left")
    component = F.coalesce("component_id", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
