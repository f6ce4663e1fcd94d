"""Spelling variants by reduced-alphabet generation.

Letters are hashed to a few symbols. Every distinct reduced word generates its full one-edit
neighbourhood over those symbols: all deletions, replacements and insertions, and itself. Two words
one edit apart have reduced words in each other's neighbourhood, so a join of the neighbourhoods with
the reduced vocabulary finds every pair; it is verified on the original strings. Neighbourhoods are
symmetric: each unordered pair of reduced words is generated from the one with the smaller hash only,
which halves what is shuffled. Words travel with their counts, never in lists.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.staging import stage

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Symbols that letters are hashed to: more of them make larger neighbourhoods and fewer false pairs.
SYMBOLS = 4
# Bases and primes of the two halves of a hash; cells of the largest matrix of letters worked on at once.
MODULI = ((1_000_003, 2_147_483_629), (998_117, 2_147_483_587))
CELLS = 100_000
# Variants are that many times rarer than the word they are a form of.
TIMES = 10


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def count_words(docs: DataFrame, least_length: int, least_count: int, id_col: str = "doc_id", text_col: str = "text", one_in: int = 31) -> DataFrame:
    """(word, n): words of at least so many code points and occurrences; of every ``one_in``-th run a letter is deleted.

    Runs of letters are lower-cased (A-Z only). A run whose crc32 of "<id>:<run>" is divisible by ``one_in``
    loses the code point at crc32 % length. A null id counts as an empty one, a null text has no runs.
    """
    # Shorter runs make no longer words, and a run is matched from its beginning to its end.
    runs = F.regexp_extract_all(F.col(text_col), F.lit(RUN.replace("+", "{%d,}" % max(1, least_length))), F.lit(0))
    seen = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("_run"))
    run = F.when(F.col("_run").rlike("[A-Z]"), lower_ascii(F.col("_run"))).otherwise(F.col("_run"))
    hashed = seen.select(run.alias("_run"), F.crc32(F.concat("_id", F.lit(":"), run)).alias("_h"))
    at = (F.col("_h") % F.char_length("_run")).cast("int")
    cut = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.char_length("_run")))
    words = hashed.select(F.when(F.col("_h") % one_in == 0, cut).otherwise(F.col("_run")).alias("word"))
    counted = words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


def reduced(word: Column, symbols: int = SYMBOLS) -> Column:
    """The word with every letter hashed to one of so many symbols; other characters stay."""
    letters = LOWER + "".join(chr(c) for c in range(0xC0, 0x100))
    return F.translate(word, letters, "".join(str(zlib.crc32(c.encode()) % symbols) for c in letters))


def _powers(base: int, prime: int, length: int) -> np.ndarray:
    out = np.ones(length, np.int64)
    for k in range(1, length):
        out[k] = out[k - 1] * base % prime
    return out


def _by_length(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, symbols): words of one length as the rows of a matrix of at most about CELLS cells."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        places = np.flatnonzero(lengths == length)
        for part in np.array_split(places, max(1, len(places) * int(length + 1) // CELLS)):
            text = "".join(words[part]).encode("utf-32-le")
            yield part, np.frombuffer(text, np.uint32).reshape(len(part), length).astype(np.int64)


def _hash(symbols: np.ndarray, base: int, prime: int) -> np.ndarray:
    return (symbols + 1) * _powers(base, prime, symbols.shape[1]) % prime


def shape_hashes(words: np.ndarray) -> np.ndarray:
    """A 62-bit polynomial hash of each reduced word."""
    out = np.zeros(len(words), np.int64)
    for places, symbols in _by_length(words):
        high, low = ((_hash(symbols, *m).sum(axis=1) % m[1]) for m in MODULI)
        out[places] = high << 31 | low
    return out


def neighbour_hashes(words: np.ndarray, symbols: int = SYMBOLS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, hashes): the hashes of every reduced word at most one edit from the words at ``places``, one row each, -1 where none.

    A sum of letters times powers of a base gives the hash of an edited word from those of its two ends,
    so work and memory grow with the length of a word and not with its square. Edits that give the same
    word are taken once: letters of a run are deleted at its last, a letter is not inserted before an equal one.
    """
    marks = np.array([ord(str(s)) for s in range(symbols)], np.int64)
    for places, word in _by_length(words):
        n, length = word.shape
        gone = np.ones((n, length), bool)
        gone[:, :-1] = word[:, :-1] != word[:, 1:]
        other = word[:, :, None] != marks
        put = np.concatenate([other, np.ones((n, 1, symbols), bool)], axis=1)
        whole = np.zeros((n, 1 + length + length * symbols + (length + 1) * symbols), np.int64)
        for base, prime in MODULI:
            power = _powers(base, prime, length + 1)
            before = np.zeros((n, length + 1), np.int64)
            before[:, 1:] = np.cumsum(_hash(word, base, prime), axis=1) % prime
            total = before[:, -1:]
            deleted = before[:, :-1] + (total - before[:, 1:]) % prime * pow(base, -1, prime)
            replaced = total[:, :, None] + (marks - word[:, :, None]) * power[:length, None]
            inserted = (before + (total - before) % prime * base)[:, :, None] + (marks + 1) * power[:, None] % prime
            found = np.concatenate([total, deleted, replaced.reshape(n, -1), inserted.reshape(n, -1)], axis=1) % prime
            whole = whole << 31 | found
        kept = np.concatenate([np.ones((n, 1), bool), gone, other.reshape(n, -1), put.reshape(n, -1)], axis=1)
        yield places, np.where(kept, whole, -1)


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of different words of ``words`` (word, n) that are exactly one edit apart.

    Words are lower-case runs of letters as count_words gives them. Keys are 62-bit hashes of reduced
    words; hashes that meet by chance fall at the verification.
    """
    def keyed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shapes = batch["_reduced"].to_numpy()
            own = shape_hashes(shapes)
            for places, found in neighbour_hashes(shapes, symbols):
                start = np.repeat(own[places], found.shape[1])
                ahead = found.ravel() >= start
                yield pd.DataFrame({"_from": start[ahead], "_to": found.ravel()[ahead]})

    def shaped(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_shape": shape_hashes(batch.pop("_reduced").to_numpy()), "_word": batch["word"], "_n": batch["n"]})

    vocabulary = words.select("word", "n", reduced(F.col("word"), symbols).alias("_reduced"))
    keys = vocabulary.select("_reduced").distinct().mapInPandas(keyed, "_from long, _to long")
    entries = stage(vocabulary.mapInPandas(shaped, "_shape long, _word string, _n long"), "entries")
    reached = keys.join(entries.toDF("_to", "near", "near_n"), "_to")
    met = reached.join(entries.toDF("_from", "word", "n"), "_from")
    # Words of one shape meet in both orders, of which one is kept.
    one_way = (F.col("_from") < F.col("_to")) | (F.col("word") < F.col("near"))
    one_edit = (F.abs(F.char_length("word") - F.char_length("near")) <= 1) & (F.levenshtein("word", "near", 1) == 1)
    # Shapes whose hashes meet by chance reach a pair twice.
    found = stage(met.where(one_way & one_edit).select("word", "n", "near", "near_n").distinct(), "near")
    return found.union(found.select("near", "near_n", "word", "n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the word at the end of the forms of each word of ``forms`` (word, form); one row per word.

    Every round doubles how far a word looks, so chains of m forms take log2(m) rounds. The count of a form
    is at least TIMES that of its word, so chains have no circle and at most log10 of the largest count.
    """
    ahead = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = ahead.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = stage(ahead.join(onward, "root", "left"), "roots")
        ahead = joined.select("word", F.coalesce("_next", "root").alias("root"))
        if not joined.where(F.col("_next").isNotNull()).head(1):
            return ahead


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2,
                      times: int = TIMES, symbols: int = SYMBOLS) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word of at least so many code points and occurrences.

    form is the near word (exactly one code point inserted, deleted or replaced) with the largest
    count, of equal ones the first in code-point order, if it is at least ``times`` as frequent, else null;
    root is where the forms lead to, or the word itself; n_near counts near words. Null and empty texts have
    no words, repeated rows count again, empty tables give no rows. Other columns are not looked at.
    """
    if times <= 1:
        raise ValueError("forms must be more frequent than their words")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    words = stage(count_words(docs, least_length, least_count, "id", "text"), "words")
    best = near_pairs(words, symbols).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("_best"))
    form_n = -F.col("_best.minus")
    rows = words.join(best, "word", "left").withColumn("_has", F.coalesce(form_n >= times * F.col("n"), F.lit(False)))
    rows = stage(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("_has"), F.col("_best.near")).alias("form"),
                             F.when(F.col("_has"), form_n).alias("form_n")), "forms")
    out = rows.join(roots(rows.where("form is not null").select("word", "form")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
