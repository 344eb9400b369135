"""Repetition inside texts by suffix arrays over words.

The words of many texts are sorted as suffixes at once by prefix doubling; suffixes of different texts never compare equal,
and only those that still share a prefix are sorted again. The longest common prefix of neighbours follows from the ranks of
each doubling. A suffix that shares n words with a neighbour begins a maximal repeat of n words; the union of all repeats of
`least` words or more is what is repeated.

A text fails the method if repeats of five words or more cover more than `most_covered` of the characters of its words, or the
longest repeat holds more than `most_longest` of them. Words are compared as they are, case and punctuation included.
Texts are scored where they lie, in blocks; nothing is shuffled. Null texts count as empty and have no words; ids may be null or
repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def longest_shared(token: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each position, how many tokens the suffix there shares with another suffix of the same text.

    token: numbers that are equal for equal words of the same text only; last: one behind the end of the position's text.
    """
    n = len(token)
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(token, kind="stable")
    new = np.concatenate([[True], token[order[1:]] != token[order[:-1]]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, step = [rank.copy()], 1
    alone = new & np.concatenate([new[1:], [True]])
    slots = np.flatnonzero(~alone)
    while len(slots):
        at = order[slots]
        follower = np.where(at + step < last[at], rank[np.minimum(at + step, n - 1)] + 1, 0)
        group = rank[at]
        inner = np.lexsort((follower, group))
        at, follower, group = at[inner], follower[inner], group[inner]
        order[slots] = at
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (follower[1:] != follower[:-1])])
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        levels.append(rank.copy())
        alone = new & np.concatenate([new[1:], [True]])
        slots, step = slots[~alone], step * 2
    shared = np.zeros(n, np.int64)
    pair = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    one, other = order[pair], order[pair + 1]
    length = np.zeros(len(pair), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = one + length, other + length
        inside = (a < last[one]) & (b < last[other])
        same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        length[same] += 1 << k
    np.maximum.at(shared, one, length)
    np.maximum.at(shared, other, length)
    return shared


def _covered(shared: np.ndarray, least: int) -> np.ndarray:
    """Whether each position is in a repeat of `least` tokens or more."""
    starts = np.flatnonzero(shared >= least)
    edge = np.zeros(len(shared) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + shared[starts], -1)
    return np.cumsum(edge[:-1]) > 0


def _repeated_lines(body: bytes) -> int:
    seen, n = set(), 0
    for line in body.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip():
            seen.add(line)
    return n


NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat")
_MEASURED = pa.schema([("doc_id", pa.int64()), *[(k, pa.int64()) for k in NUMBERS], ("covered", pa.float64()), ("longest_share", pa.float64())])


def _measure(least: int):
    def work(bodies, rows):
        words = C.Words(bodies, lower=False)
        n, doc = len(bodies), words.doc
        token = C.mix(words.hashes() + C.mix(doc.astype(np.uint64) + np.uint64(1)))
        last = (words.first + words.per_doc)[doc]
        shared = longest_shared(token, last)
        letters = np.concatenate([[0], np.cumsum((words.raw & 0xC0) != 0x80)])
        chars = letters[words.end] - letters[words.start]
        per_text = np.bincount(doc, chars, minlength=n)
        covered = np.bincount(doc, chars * _covered(shared, least), minlength=n)
        sums = np.concatenate([[0], np.cumsum(chars)])
        long = np.where(shared >= least, sums[np.arange(len(doc)) + shared] - sums[:-1], 0)
        most, widest = np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.maximum.at(most, doc, np.where(shared >= least, shared, 0))
        np.maximum.at(widest, doc, long)
        symbols = np.add.reduceat(_SYMBOL[words.raw].astype(np.int64), words.offset[:-1]) if n else np.zeros(0)
        whole = np.maximum(per_text, 1)
        return {"doc_id": rows["doc_id"], "n_words": words.per_doc, "word_chars": per_text.astype(np.int64), "n_symbols": symbols,
                "n_dup_lines": [_repeated_lines(b) for b in bodies],
                "n_repeat_words": np.bincount(doc, _covered(shared, 3), minlength=n).astype(np.int64),
                "longest_repeat": most, "covered": covered / whole, "longest_share": widest / whole}
    return work


def measure(docs: DataFrame, least: int = 5) -> DataFrame:
    """doc_id and for every text: words, their characters, symbols, repeated lines, words in repeated windows of three, words of the longest
    repeat, covered (the share of characters in repeats of `least` words or more), longest_share (of the longest repeat)."""
    rows = C.texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    kind = ", ".join(["doc_id long", *[f"{k} long" for k in NUMBERS], "covered double", "longest_share double"])
    return rows.mapInArrow(C.by_block(_measure(least), _MEASURED), kind)


def judge(docs: DataFrame, least: int = 5, most_covered: float = 0.5, most_longest: float = 0.3) -> DataFrame:
    """measure() with base_failed (short, or more than half repeated) and kept."""
    out = measure(docs, least).withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    fine = (F.col("covered") <= most_covered) & (F.col("longest_share") <= most_longest)
    return out.withColumn("kept", ~F.col("base_failed") & fine)
