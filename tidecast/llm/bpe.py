"""Token counts of byte-level BPE by rank-synchronous array merging.

The pre-tokens of a batch are one flat array of symbols with the number of their sequence. Each
round looks up the rank of every adjacent pair, takes the lowest rank of each sequence and merges
all its occurrences at once; sequences without a known pair leave with the symbols they have.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the byte-level scheme: the split pattern, and the letters that stand for bytes.
_SPACE = r"\p{White_Space}"
_SPLIT = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|{_SPACE}+(?![^{_SPACE}])|{_SPACE}+")
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

# Texts are worked off in stretches of about this many characters, cut where tokens always end.
STRETCH = 1 << 20
# Distinct pieces whose counts a task remembers; it starts afresh beyond that.
REMEMBERED = 600_000
_NEVER = np.int64(1 << 40)
# A space between two characters that are no white space begins a token, whatever is around it.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = re.compile(r" \s|\s |^ | $")


@dataclass(frozen=True)
class Merges:
    """Merge table of a byte-level BPE: ids of the bytes, pairs by key, their ranks and what they become."""

    of_byte: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    become: np.ndarray
    size: int
    specials: tuple[str, ...]


def read_merges(path: str) -> Merges:
    """The merges in a tokenizers file (read on the driver; its size is the vocabulary's)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    letter = {b: chr(b) for b in _PRINTABLE}
    letter |= {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in letter)}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    size = max(vocab.values()) + 1
    keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    become = np.array([vocab[a + b] for a, b in pairs], np.int64)
    of_byte = np.array([vocab[letter[b]] for b in range(256)], np.int64)
    return Merges(of_byte, keys[order], order.astype(np.int64), become[order], size, tuple(t["content"] for t in spec["added_tokens"]))


def merge_counts(m: Merges, tokens: list[bytes]) -> np.ndarray:
    """Symbols that are left of each pre-token when no pair can be merged any more."""
    counts = np.array([len(t) for t in tokens], np.int64)
    symbols = m.of_byte[np.frombuffer(b"".join(tokens), np.uint8)]
    owner = np.repeat(np.arange(len(tokens)), counts)
    while len(symbols) > 1:
        key = symbols[:-1] * m.size + symbols[1:]
        at = np.minimum(np.searchsorted(m.keys, key), len(m.keys) - 1)
        rank = np.full(len(symbols), _NEVER)
        rank[:-1] = np.where((m.keys[at] == key) & (owner[:-1] == owner[1:]), m.ranks[at], _NEVER)
        starts = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
        lengths = np.diff(np.append(starts, len(symbols)))
        low = np.minimum.reduceat(rank, starts)
        counts[owner[starts]] = lengths
        low = np.repeat(low, lengths)
        hit = np.flatnonzero((rank == low) & (low < _NEVER))
        if not len(hit):
            break
        # Where a pair overlaps its next occurrence (aaa), every second one of the run is merged.
        run = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
        first = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
        symbols[hit] = m.become[at[hit]]
        stay = low < _NEVER
        stay[hit + 1] = False
        symbols, owner = symbols[stay], owner[stay]
    return counts


def _stretches(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > STRETCH:
        cut = _CUT.search(text, start + STRETCH)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


class Counter:
    """Counts tokens of texts, remembering pieces it has met."""

    def __init__(self, merges: Merges):
        self.merges, self.known, self.tokens = merges, {}, {}
        self.special = re.compile("|".join(map(re.escape, sorted(merges.specials, key=len, reverse=True)))) if merges.specials else None

    def _learn(self, pieces: Iterable[str]) -> None:
        new = list(set(pieces).difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known, self.tokens = {}, {}
            new = list(set(pieces))
        split = [_SPLIT.findall(p) for p in new]
        fresh = list({t for s in split for t in s}.difference(self.tokens))
        if fresh:
            self.tokens.update(zip(fresh, merge_counts(self.merges, [t.encode("utf-8", "surrogatepass") for t in fresh]).tolist()))
        self.known.update((p, sum(map(self.tokens.__getitem__, s))) for p, s in zip(new, split))

    def _pieces(self, text: str) -> tuple[int, list[str]]:
        """Special tokens in the text, and pieces whose tokens add up to the rest."""
        parts = self.special.split(text) if self.special else [text]
        pieces: list[str] = []
        for part in parts:
            for s in _stretches(part):
                if _OTHER_SPACE.search(s.removeprefix(" ")):
                    pieces += _SPLIT.findall(s)
                else:
                    first, *rest = s.split(" ")
                    pieces += [first, *[" " + w for w in rest]]
        return len(parts) - 1, pieces

    def count(self, texts: list[str | None]) -> list[int]:
        out: list[int] = []
        for k in range(0, len(texts), 256):
            cut = [self._pieces(t or "") for t in texts[k:k + 256]]
            self._learn([p for _, pieces in cut for p in pieces])
            out += [special + sum(map(self.known.__getitem__, pieces)) for special, pieces in cut]
        return out


def token_counts(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> Column:
    """Column with the number of tokens of ``text_col``; null and empty texts have none.

    The counts are those the library gives without added begin or end tokens: strings of special
    tokens inside a text are one token each, as the file's defaults have it. Whole texts count, in
    bounded stretches. The merge table goes to the tasks as one broadcast; its size is fixed by the file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_merges(tokenizer_path))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(shared.value)
        for texts in batches:
            yield pd.Series(counter.count(texts.tolist()), dtype="int64")

    return count(F.col(text_col))
