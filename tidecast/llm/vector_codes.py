"""Vector codes by product quantisation with member-resident Lloyd rounds.

Vectors become whole numbers and are cut into equal parts. Every part lives with the owner of the
codebook entry it is assigned to: rows are partitioned by (position, entry, salt), the salt being a
share of the rows, so that no owner holds more than about OWNER_ROWS of them however uneven the
entries are. In a round each owner looks for the nearest entries of its residents; those that stay
are not moved, those that change their entry migrate in one shuffle to their new owner. Owners then
sum their residents, and the sums of an entry over its salts give its new value. Sums, counts and
distances are whole numbers, so results depend neither on the order nor on the layout of the rows.

What reaches the driver is the codebook and sums of its size (parts x entries x components).
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import broadcast_up_to
from tidecast.staging import shared_folder, stage

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
# The most rows of one owner on average if all rows had the same entry, and the rows of one partition.
OWNER_ROWS = 512
PARTITION_ROWS = 65_536
# Scaled components beyond this are left out: sums of squares of so large numbers do not fit into a long.
MOST_SCALED = 2 ** 28
# Parts compared with a whole codebook at once.
BATCH = 2_048
# Labels whose errors may be broadcast.
MOST_LABELS = 100_000

Owner = tuple[int, int, int]
Block = tuple[np.ndarray, np.ndarray]


def scaled_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS) -> DataFrame:
    """(row, id, label, q): a number of its own for each usable row, written once, and its vector as floor(SCALE * x).

    Null and empty vectors, vectors with null or non-finite components or with scaled ones beyond
    MOST_SCALED are left out, and so are those whose length is not the commonest one (of equally
    common ones the smallest). Vectors are filled up with zeros to a multiple of ``parts``.
    """
    q = F.transform("v", lambda x: F.floor(x.cast("double") * SCALE))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < MOST_SCALED))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(usable).select("id", "label", q.alias("q"))
    rows = stage(rows, "scaled")
    lengths = rows.groupBy(F.size("q").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").head(1)
    if lengths:
        length = lengths[0]["length"]
        rows = rows.where(F.size("q") == length)
        if length % parts:
            rows = rows.withColumn("q", F.concat("q", F.array_repeat(F.lit(0).cast("long"), parts - length % parts)))
    return stage(rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "q"), "rows")


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row and its squared distance; of equally near ones the first. Exact for whole numbers."""
    at, gap = np.empty(len(x), np.int32), np.empty(len(x), np.int64)
    # Products of doubles are exact while the sums of squares stay below 2^53.
    reach = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    exact = np.float64 if 4 * reach * reach * x.shape[1] < 2 ** 53 else np.int64
    e = entries.astype(exact)
    norms = (e * e).sum(axis=1)
    for k in range(0, len(x), BATCH):
        part = x[k:k + BATCH].astype(exact)
        far = norms - 2 * (part @ e.T)
        at[k:k + BATCH] = best = far.argmin(axis=1)
        gap[k:k + BATCH] = (far[np.arange(len(part)), best] + (part * part).sum(axis=1)).astype(np.int64)
    return at, gap


def _owner_hash(owner: Owner) -> int:
    return zlib.crc32(b"%d,%d,%d" % owner)


def _blocks(rows: np.ndarray, parts: np.ndarray, position: int, entries: np.ndarray, salts: int) -> Iterator[tuple[Owner, Block]]:
    """The rows of one position, split by owner."""
    place = entries.astype(np.int64) * salts + rows % salts
    order = np.argsort(place, kind="stable")
    starts = np.flatnonzero(np.diff(place[order], prepend=-1))
    for chosen in np.split(order, starts[1:]) if len(order) else []:
        yield (position, int(entries[chosen[0]]), int(rows[chosen[0]] % salts)), (rows[chosen], parts[chosen])


def _merged(blocks: Iterable[tuple[Owner, Block]]) -> Iterator[tuple[Owner, Block]]:
    """One block for each owner of a partition."""
    found: dict[Owner, list[Block]] = {}
    for owner, block in blocks:
        found.setdefault(owner, []).append(block)
    for owner, mine in found.items():
        yield owner, mine[0] if len(mine) == 1 else (np.concatenate([r for r, _ in mine]), np.concatenate([p for _, p in mine]))


def _by_position(blocks: Iterable[tuple[Owner, Block]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(position, rows, parts, entries they live with) of a partition, so that small owners are compared together."""
    found: dict[int, list[tuple[int, Block]]] = {}
    for (position, entry, _), block in blocks:
        found.setdefault(position, []).append((entry, block))
    for position, mine in found.items():
        yield position, np.concatenate([b[0] for _, b in mine]), np.concatenate([b[1] for _, b in mine]), np.repeat([e for e, _ in mine], [len(b[0]) for _, b in mine])


@dataclass
class Codes:
    """What the rounds end with."""

    codebook: np.ndarray  # parts x entries x components, whole numbers
    codes: DataFrame  # row, position, entry, gap: one row per part
    moved: list[int] = field(default_factory=list)  # parts that migrated, by round, at first all; repeated tasks count again

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.codebook.ravel().tolist())).encode()).hexdigest()


def lloyd(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes:
    """Codebooks and codes of ``rows`` (row, id, q as scaled_vectors gives them).

    The codebooks start as the parts of the rows with the smallest ids (equal ids by vector, null ids
    last). Each round assigns every part to the nearest entry (ties: the first) and replaces each
    entry by floor(sum / count) of its parts; entries without parts stay.
    """
    spark = rows.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(spark))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "q").select("q").limit(entries).collect()
    n = rows.count()
    schema = "row long, position int, entry int, gap long"
    if not first:
        return Codes(np.zeros((parts, 0, 0), np.int64), spark.createDataFrame([], schema))
    q = np.array([r["q"] for r in first], np.int64)
    book = np.ascontiguousarray(q.reshape(len(q), parts, -1).transpose(1, 0, 2))
    salts = -(-n // OWNER_ROWS)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * parts // PARTITION_ROWS))

    def placed(batches: Iterable[pd.DataFrame], book: np.ndarray = book) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            ids = batch["row"].to_numpy(np.int64)
            whole = np.array(batch["q"].tolist(), np.int32).reshape(len(ids), parts, -1)
            out = []
            for p in range(parts):
                mine = np.ascontiguousarray(whole[:, p])
                out += [(*owner, pickle.dumps(block)) for owner, block in _blocks(ids, mine, p, nearest(mine, book[p])[0], salts)]
            yield pd.DataFrame(out, columns=["position", "entry", "salt", "block"])

    arrivals = rows.select("row", "q").mapInPandas(placed, "position int, entry int, salt int, block binary")
    dealt = arrivals.rdd.map(lambda r: ((r["position"], r["entry"], r["salt"]), pickle.loads(bytes(r["block"])))).partitionBy(partitions, _owner_hash)
    state = dealt.mapPartitions(_merged, preservesPartitioning=True)
    moved = [n * parts]
    held: RDD | None = None
    for k in range(rounds):
        if k:
            state, count = _migrated(state, sc.broadcast(book), salts, partitions)
        # Kept on disk while it is written to the shared folder, so that it is made once; later rounds read the shared folder.
        state = state.persist(StorageLevel.DISK_ONLY)
        state.checkpoint()
        book = _updated(state, book)
        if k:
            moved.append(count.value)
        if held is not None:
            held.unpersist()
        held = state
    final = sc.broadcast(book)

    def coded(blocks: Iterable[tuple[Owner, Block]]) -> Iterator[tuple[int, bytes]]:
        for position, ids, mine, _ in _by_position(blocks):
            yield position, pickle.dumps((ids, *nearest(mine, final.value[position])))

    def spread(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for position, packed in zip(batch["position"], batch["packed"]):
                ids, at, gap = pickle.loads(packed)
                yield pd.DataFrame({"row": ids, "position": np.int32(position), "entry": at, "gap": gap})

    packed = spark.createDataFrame(state.mapPartitions(coded), "position int, packed binary")
    codes = stage(packed.mapInPandas(spread, schema), "codes")
    state.unpersist()
    return Codes(book, codes, moved)


def _migrated(state: RDD, book, salts: int, partitions: int):
    """The residents after a round's assignment: those that stay in place and, from one shuffle, those that moved."""
    count = state.context.accumulator(0)

    def staying(blocks: Iterable[tuple[Owner, Block]]) -> Iterator[tuple[Owner, Block]]:
        for position, ids, mine, home in _by_position(blocks):
            at = nearest(mine, book.value[position])[0]
            yield from _blocks(ids[at == home], mine[at == home], position, at[at == home], salts)

    def leaving(blocks: Iterable[tuple[Owner, Block]]) -> Iterator[tuple[Owner, Block]]:
        for position, ids, mine, home in _by_position(blocks):
            at = nearest(mine, book.value[position])[0]
            count.add(int((at != home).sum()))
            yield from _blocks(ids[at != home], mine[at != home], position, at[at != home], salts)

    moving = state.mapPartitions(leaving).partitionBy(partitions, _owner_hash)
    # Both sides have the same partitioner, so their union puts the arrivals beside the residents without a shuffle.
    return state.mapPartitions(staying, preservesPartitioning=True).union(moving).mapPartitions(_merged, preservesPartitioning=True), count


def _updated(state: RDD, book: np.ndarray) -> np.ndarray:
    """New entries from the sums of the owners; one row per entry reaches the driver."""
    def summed(blocks: Iterable[tuple[Owner, Block]]) -> Iterator[tuple[tuple[int, int], tuple[int, np.ndarray]]]:
        for (position, entry, _), (ids, mine) in blocks:
            yield (position, entry), (len(ids), mine.sum(axis=0, dtype=np.int64))

    sums = state.mapPartitions(summed).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1])).collect()
    out = book.copy()
    for (position, entry), (size, total) in sums:
        out[position, entry] = total // size
    return out


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codes]:
    """(id, code, error, label_error, codebooks_sha256), one row per usable row of ``vectors``, and the codebooks.

    code has the entries of the parts in order, two hex digits each; error is the sum of their squared
    distances, label_error that of all rows with the same label, null labels together. Rows that
    repeat an id are rows of their own; an empty table gives no rows. Other columns are not looked at.
    """
    rows = scaled_vectors(vectors, id_col, vector_col, label_col, parts)
    done = lloyd(rows, parts, entries, rounds)
    ordered = F.array_sort(F.collect_list(F.struct("position", "entry")))
    digits = F.transform(ordered, lambda s: F.lower(F.lpad(F.hex(s["entry"]), 2, "0")))
    coded = done.codes.groupBy("row").agg(F.array_join(digits, "").alias("code"), F.sum("gap").alias("error"))
    coded = stage(rows.select("row", "id", "label").join(coded, "row"), "coded")
    # NaN labels are one label like any other; the struct makes null labels meet.
    label = F.struct(F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("text"))
    sums = coded.groupBy(label.alias("_label")).agg(F.sum("error").alias("label_error"))
    out = coded.withColumn("_label", label).join(broadcast_up_to(sums, MOST_LABELS), "_label")
    return out.select("id", "code", "error", "label_error", F.lit(done.sha256()).alias("codebooks_sha256")), done
