"""SentencePiece encoding and decoding with merge-type vocabularies, checked against the sentencepiece library.

Method. A text is normalised (spaces become U+2581, one is put in front), then its characters are symbols. An agenda holds every adjacent pair
of symbols whose joined text is a piece, ordered by the piece's score and then from left to right; the best pair is merged, its neighbours
enter the agenda anew, and entries whose symbols are gone are passed over. What is left is looked up; a symbol that is no piece becomes its
UTF-8 bytes or, in a vocabulary without bytes, the unknown id (one for a run of them). Where no piece holds U+2581 after another character, no
merge ever reaches over the beginning of a word, so words have agendas of their own. Short words that are new in a block are merged together,
each by its own agenda, one pair a turn in numpy; their ids are remembered within the task.
Decoding joins the pieces, byte pieces as bytes (each byte that is no UTF-8 becomes U+FFFD), and takes off the space that was put in front.

Spark. Map-only, in Arrow batches: a task works through blocks of about 2 MB of text; nothing is shuffled, hot sources and copies cost what
their texts cost. The model file (a vocabulary, some 500 KB) is read by the driver and sent with the function, so tasks need no file. Every
block is encoded and decoded by the library as well: `agrees` tells for each text whether ids (or texts) are the same.

Results. One row per row of the table. Null and empty texts have no ids and decode to the empty text; null ids count as none, ids that the
vocabulary lacks decode to nothing and do not agree. Bytes that are no UTF-8 count as U+FFFD. Repeated rows stay, an empty table gives an empty
result, columns other than doc_id and text (or ids) are neither read nor returned. Vocabularies with pieces that users defined, that are out of
use, or that are of another type than merges are refused with a ValueError.
"""

from __future__ import annotations

import functools
import heapq
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SPACE = "\N{LOWER ONE EIGHTH BLOCK}"
REMEMBERED = 1 << 18  # words whose ids a task remembers from block to block; beyond, it starts anew
LONG = 32             # longer words are not remembered, and their agenda is a heap

IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("agrees", pa.bool_())])


def _fields(data: bytes):
    """(number, value) of a protocol buffer's fields: varints as numbers, other kinds as bytes."""
    def varint(at):
        out = shift = 0
        while True:
            b = data[at]
            out, shift, at = out | (b & 127) << shift, shift + 7, at + 1
            if b < 128:
                return out, at
    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = data[at:at + size], at + size
        yield tag >> 3, value


class Vocabulary:
    """The pieces of a model, and the library's processor of the same model to check against."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        parts = list(_fields(model))
        rows = [dict(_fields(v)) for k, v in parts if k == 1]
        trainer, normal = (dict(_fields(next(v for k, v in parts if k == n))) for n in (2, 3))
        self.text = [r[1].decode() for r in rows]
        kind = [r.get(3, 1) for r in rows]  # 1 normal, 2 unknown, 3 control, 4 of users, 5 out of use, 6 byte
        if trainer.get(3, 1) != 2 or {4, 5} & set(kind):
            raise ValueError("only vocabularies of merges, without pieces of users or out of use, are supported")
        if normal.get(2) or not normal.get(5, 1) or trainer.get(24):
            raise ValueError("only the identity normalisation with spaces in front of words is supported")
        self.front, self.squeeze = normal.get(3, 1), normal.get(4, 1)
        self.id = {t: i for i, (t, k) in enumerate(zip(self.text, kind)) if k == 1}
        scores = [self.library.get_score(i) for i in range(len(rows))]
        place = {s: n for n, s in enumerate(sorted(set(scores), reverse=True))}
        self.rank = {t: place[scores[i]] for t, i in self.id.items()}
        self.byte = {int(self.text[i][3:5], 16): i for i, k in enumerate(kind) if k == 6} if 6 in kind else None
        self.byte_of = {i: b for b, i in (self.byte or {}).items()}
        self.unknown = kind.index(2)
        self.silent = {i for i, k in enumerate(kind) if k == 3}
        self.special = {i for i, k in enumerate(kind) if k != 1}
        self.surface = trainer.get(44, " \N{DOUBLE QUESTION MARK} ".encode()).decode()
        self.raw = [b"" if k == 3 else bytes([self.byte_of[i]]) if k == 6 else self.surface.encode() if k == 2 else t.replace(SPACE, " ").encode()
                    for i, (t, k) in enumerate(zip(self.text, kind))]
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.raw_ends = np.concatenate([[0], np.cumsum([len(r) for r in self.raw])])
        letters = set("".join(self.id))
        alone = "".join(chr(c) for c in range(128) if chr(c) not in letters)  # in no piece, so no merge reaches over them
        apart = not any(SPACE in t.lstrip(SPACE) for t in self.id)
        stop = re.escape(alone) + (SPACE if apart else "")
        self.words = re.compile((f"{SPACE}*" if apart else "") + (f"[^{stop}]+" if stop else r"[\s\S]+") + (f"|{SPACE}+" if apart else "")
                                + (f"|[{re.escape(alone)}]" if alone else ""))
        self.by_space = bool(apart and self.front and not self.squeeze)
        self._pairs()
        self.forget()

    def forget(self) -> None:
        """Only the empty word is known: `known` has a word's number, `ids` the ids of all words one after another, `ends` where a word's end."""
        self.known: dict[str, int] = {"": 0}
        self.ids, self.ends, self.long = np.zeros(0, np.int32), np.zeros(2, np.int64), []

    def _pairs(self) -> None:
        """For merging many words at once: the id of every one-character piece, and a hash table from two ids to the piece they make."""
        self.letter = np.full(0x110000, -1, np.int32)
        made: dict[int, int] = {}
        for t, i in self.id.items():
            if len(t) == 1:
                self.letter[ord(t)] = i
            for cut in range(1, len(t)):
                if (x := self.id.get(t[:cut])) is not None and (y := self.id.get(t[cut:])) is not None:
                    made[x << 32 | y] = i
        self.place = np.full(len(self.text) + 1, len(self.text), np.int32)  # by id, the last entry: no piece
        for t, i in self.id.items():
            self.place[i] = self.rank[t]
        self.bits = max(4, (16 * len(made)).bit_length())
        self.key, self.makes = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, len(self.text), np.int32)
        keys, values = np.fromiter(made.keys(), np.int64, len(made)), np.fromiter(made.values(), np.int32, len(made))
        for k, v, at in zip(keys.tolist(), values.tolist(), self._slot(keys).tolist()):
            while self.key[at] >= 0:
                at = (at + 1) & (1 << self.bits) - 1
            self.key[at], self.makes[at] = k, v

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _made(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make; the number of pieces where they make none."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self._slot(keys)
        here = self.key[at]
        out = np.where(here == keys, self.makes[at], len(self.text))
        other = np.nonzero((here >= 0) & (here != keys))
        while len(other[0]):
            at[other] = next_at = (at[other] + 1) & (1 << self.bits) - 1
            here = self.key[next_at]
            out[other] = np.where(here == keys[other], self.makes[next_at], len(self.text))
            more = (here >= 0) & (here != keys[other])
            other = tuple(x[more] for x in other)
        return out

    def normal(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.replace(SPACE, " ")).strip(" ")
        return (SPACE if self.front else "") + text.replace(" ", SPACE) if text else ""

    def merged(self, word: str) -> list[str]:
        """The symbols that are left when no adjacent pair makes a piece any more. The agenda of a short word is a list, of a long one a heap."""
        return self._by_list(word) if len(word) <= LONG else self._by_heap(word)

    def _together(self, words: list[str], wide: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids, one after another, and how many each has, of words of at most `wide` letters that are all pieces; each turn, every word merges the best pair of its agenda."""
        none, n, row = len(self.text), len(words), wide + 1
        size = np.array([len(w) for w in words])
        column = np.arange(row)
        alive = column < size[:, None]
        symbol = np.zeros((n, row), np.int32)
        symbol[alive] = self.letter[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        makes = np.full((n, row), none, np.int32)
        makes[:, :-1] = np.where(alive[:, 1:], self._made(symbol[:, :-1], symbol[:, 1:]), none)
        agenda = self.place[makes]
        after, before = np.tile(column + 1, n), np.tile(column - 1, n)
        symbol, makes, flat, alive, going = symbol.reshape(-1), makes.reshape(-1), agenda.reshape(-1), alive.reshape(-1), np.arange(n)
        while True:
            now = agenda[going]
            best = now.argmin(1)  # the leftmost of the best
            good = now[np.arange(len(going)), best] < none
            going, best = going[good], best[good]
            if not len(going):
                return symbol[alive], np.add.reduceat(alive, np.arange(0, n * row, row), dtype=np.int64)
            base = going * row
            left = base + best
            gone = base + after[left]
            right = base + after[gone]
            joined = makes[left]
            symbol[left], alive[gone], flat[gone] = joined, False, none
            after[left], before[right] = right - base, best
            made = np.where(right - base < size[going], self._made(joined, symbol[right]), none)
            makes[left], flat[left] = made, self.place[made]
            has = before[left] >= 0
            left, joined = base[has] + before[left[has]], joined[has]
            made = self._made(symbol[left], joined)
            makes[left], flat[left] = made, self.place[made]

    def learn(self, words: list[str]) -> None:
        """Makes the words known; one that holds symbols which stand alone is made of its parts."""
        words.sort(key=len)
        size = np.array([len(w) for w in words], np.int64)
        short = int(np.searchsorted(size, LONG, side="right"))
        self.long += words[short:]
        codes = np.frombuffer("".join(words[:short]).encode("utf-32-le"), np.uint32)
        plain = np.zeros(len(words), bool)  # short and of letters that are pieces
        plain[:short] = np.add.reduceat(self.letter[codes] < 0, np.cumsum(size[:short]) - size[:short]) == 0 if short else False
        for low, wide in ((0, 4), (4, 8), (8, 12), (12, 16), (16, LONG)):
            part = [words[i] for i in np.flatnonzero(plain & (size > low) & (size <= wide)).tolist()]
            for first in range(0, len(part), 8192):
                self._keep(part[first:first + 8192], *self._together(part[first:first + 8192], wide))
        rest = {words[i]: self.words.findall(words[i]) for i in np.flatnonzero(~plain).tolist()}
        alone = [w for w, p in rest.items() if len(p) == 1]
        ids = [self.looked_up(self.merged(w)) for w in alone]
        self._keep(alone, np.array(list(chain.from_iterable(ids)), np.int32), np.array([len(x) for x in ids], np.int64))
        parts = {w: p for w, p in rest.items() if len(p) > 1}
        if parts:
            self.learn([w for w in set().union(*parts.values()) if w not in self.known])
            ids, upto = self._gathered(np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts.values())), np.int64))
            self._keep(list(parts), ids, np.diff(upto[np.cumsum([len(p) for p in parts.values()])], prepend=0))

    def _keep(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        """Adds words with their ids, which stand one after another."""
        self.known.update(zip(words, range(len(self.ends) - 1, len(self.ends) - 1 + len(words))))
        self.ids, self.ends = np.concatenate([self.ids, ids]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(size)])

    def _gathered(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after another, and where each begins; the last entry is where all end."""
        start, size = self.ends[number], self.ends[number + 1] - self.ends[number]
        upto = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])], upto

    def _by_list(self, word: str) -> list[str]:
        place, symbol, none = self.rank.get, list(word), len(self.text)
        agenda = [place(word[i:i + 2], none) for i in range(len(word) - 1)]
        while agenda and (best := min(agenda)) < none:
            i = agenda.index(best)
            joined = symbol[i] + symbol.pop(i + 1)
            symbol[i] = joined
            del agenda[i]
            if i < len(agenda):
                agenda[i] = place(joined + symbol[i + 1], none)
            if i:
                agenda[i - 1] = place(symbol[i - 1] + joined, none)
        return symbol

    def _by_heap(self, word: str) -> list[str]:
        rank, symbol, n = self.rank, list(word), len(word)
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        # An entry is a number: score's place, left symbol, length of the joined text; the smallest is the best and the leftmost of its score.
        agenda = [(rank[t] << 40 | i) << 24 | 2 for i in range(n - 1) if (t := word[i:i + 2]) in rank]
        heapq.heapify(agenda)
        while agenda:
            entry = heapq.heappop(agenda)
            i, size = entry >> 24 & 0xFFFFFFFFFF, entry & 0xFFFFFF
            left, j = symbol[i], after[i]
            if not left or j >= n or len(left) + len(symbol[j]) != size:
                continue
            symbol[i], symbol[j], k = left + symbol[j], "", after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (t := symbol[i] + symbol[k]) in rank:
                    heapq.heappush(agenda, (rank[t] << 40 | i) << 24 | len(t))
            if (h := before[i]) >= 0 and (t := symbol[h] + symbol[i]) in rank:
                heapq.heappush(agenda, (rank[t] << 40 | h) << 24 | len(t))
        return [s for s in symbol if s]

    def looked_up(self, symbols: list[str]) -> list[int]:
        out = []
        for s in symbols:
            i = self.id.get(s)
            if i is not None:
                out.append(i)
            elif self.byte:
                out += [self.byte[b] for b in s.encode()]
            else:
                out.append(self.unknown)
        return out

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts one after another, and where those of each end. Words that are new in these texts are merged together."""
        if len(self.known) > REMEMBERED or len(self.ids) > 16 * REMEMBERED:
            self.forget()
        words, number, per_text = self._by_space(texts) if self.by_space else self._by_pattern(texts)
        new = [w for w in words if w not in self.known]
        self.learn(list(new))
        number = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[number]
        for w in self.long:
            del self.known[w]
        self.long = []
        ids, upto = self._gathered(number)
        ends = upto[np.cumsum(per_text)]
        if not self.byte:  # a run of unknown symbols in a text is one id
            again = np.concatenate([[False], (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)])[:len(ids)]
            again[np.concatenate([[0], ends])[:-1][np.diff(ends, prepend=0) > 0]] = False
            ends = np.concatenate([[0], np.cumsum(~again)])[ends]
            ids = ids[~again]
        return ids, ends

    def _by_pattern(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The different words of the texts, the number of each word, and how many words each text has."""
        parts, numbers = [self.words.findall(self.normal(t)) for t in texts], {}
        number = [numbers.setdefault(w, len(numbers)) for w in chain.from_iterable(parts)]
        return list(numbers), np.array(number, np.int64), np.array([len(p) for p in parts], np.int64)

    def _by_space(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The same where a space is in front of every text: what stands between spaces are the words, and runs of spaces go with the next one."""
        parts = pa.compute.split_pattern(pa.compute.replace_substring(pa.array(texts, pa.string()), SPACE, " "), " ")
        coded = parts.flatten().dictionary_encode()
        words, number = pa.compute.binary_join_element_wise(SPACE, coded.dictionary, "").to_pylist(), coded.indices.to_numpy().astype(np.int64)
        per_text = np.diff(parts.offsets.to_numpy()).astype(np.int64)
        if SPACE in words:
            empty = number == words.index(SPACE)
            last = np.zeros(len(number), bool)
            last[np.cumsum(per_text) - 1] = True
            runs, begins = np.flatnonzero(empty), np.concatenate([[True], ~empty[:-1] | last[:-1]]) & empty
            begin = np.maximum.accumulate(np.where(begins, np.arange(len(number)), 0))
            numbers = {w: i for i, w in enumerate(words)}
            nothing = numbers.setdefault("", len(numbers))
            number[runs] = nothing
            closing = runs[last[runs]]  # a run that ends its text; the empty text has no ids
            for at in closing[~begins[closing] | (per_text[np.searchsorted(np.cumsum(per_text), closing, side="right")] > 1)].tolist():
                number[at] = numbers.setdefault(SPACE * (at - begin[at] + 1), len(numbers))
            for at in (runs[~last[runs]] + 1).tolist():
                if not empty[at]:
                    number[at] = numbers.setdefault(SPACE * int(at - 1 - begin[at - 1] + 1) + words[number[at]], len(numbers))
            words = list(numbers)
        return words, number, per_text

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, ends = self.flat(texts)
        return [x.tolist() for x in np.split(ids, ends[:-1])] if texts else []

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; at once where all ids but the first may be any letters or bytes, and the bytes are whole characters."""
        if ids and not self.squeeze and min(ids) >= 0 and max(ids) < len(self.text) and ids[0] not in self.special:
            try:
                text = b"".join([self.raw[i] for i in ids]).decode()
                return text[1:] if self.front and self.text[ids[0]].startswith(SPACE) else text
            except UnicodeDecodeError:
                pass
        return self._decode_each(ids)

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of lists of ids that stand one after another."""
        if not self.front or self.squeeze:
            return [self.decode(x.tolist()) for x in np.split(ids, ends[:-1])] if len(ends) else []
        size = self.raw_ends[ids + 1] - self.raw_ends[ids]
        upto = np.concatenate([[0], np.cumsum(size)])
        body = self.raw_bytes[np.repeat(self.raw_ends[ids] - upto[:-1], size) + np.arange(upto[-1])].tobytes()
        first = np.concatenate([[0], ends])[:-1]
        out = []
        for a, b, i, j in zip(upto[first].tolist(), upto[ends].tolist(), first.tolist(), ends.tolist()):
            try:
                if i < j and ids[i] in self.special:
                    raise ValueError
                out.append(body[a + (i < j and self.text[ids[i]].startswith(SPACE)):b].decode())
            except ValueError:  # bytes that are no characters, or ids that are no letters in front
                out.append(self._decode_each(ids[i:j].tolist()))
        return out

    def _decode_each(self, ids: list[int]) -> str:
        parts, run, at_start = [], bytearray(), bool(self.front or self.squeeze)
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                at_start = False
                continue
            if run:
                parts.append(_utf8(bytes(run)))
                run = bytearray()
            if i in self.silent or not 0 <= i < len(self.text):
                continue
            piece = self.surface if i == self.unknown else self.text[i]
            if at_start and i != self.unknown and piece.startswith(SPACE):
                piece = piece.lstrip(SPACE) if self.squeeze else piece[1:]
                at_start = bool(self.squeeze) and not piece
            else:
                at_start = False
            parts.append(piece.replace(SPACE, " ") if i != self.unknown else piece)
        return "".join(parts) + _utf8(bytes(run))


def _utf8(run: bytes) -> str:
    """The text of a run of bytes; a byte that begins no whole character is one U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            size = next((n for n in (1, 2, 3, 4) if _whole(run[at:at + n])), 0)
            out.append(run[at:at + size].decode() if size else "\N{REPLACEMENT CHARACTER}")
            at += size or 1
        return "".join(out)


def _whole(part: bytes) -> bool:
    try:
        return len(part.decode()) == 1
    except UnicodeDecodeError:
        return False


@functools.lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str, back: bool = False) -> DataFrame:
    """doc_id, ids (array of int) and agrees of each text, by the model file at `path` (on the driver); with `back` also decoded: what the ids decode to."""
    model = model_bytes(path)
    schema = IDS.append(pa.field("decoded", pa.string())) if back else IDS

    def work(bodies, rows):
        v = vocabulary(model)
        texts = [b.decode("utf-8", "replace") for b in bodies]
        ids, ends = v.flat(texts)
        same = v.library.encode(texts, num_threads=1)
        length = np.array([len(x) for x in same], np.int64)
        equal = np.diff(ends, prepend=0) == length
        if equal.all():  # else a text's lists are compared by themselves
            differ = np.flatnonzero(ids != np.fromiter(chain.from_iterable(same), np.int32, length.sum()))
            equal[np.searchsorted(ends, differ, side="right")] = False
        else:
            equal = np.array([a.tolist() == b for a, b in zip(np.split(ids, ends[:-1]), same)])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))
        out = {"doc_id": rows.column("doc_id"), "ids": lists}
        if back:
            out["decoded"] = v.texts(ids, ends)
            twin = v.library.decode(same if equal.all() else [x.tolist() for x in np.split(ids, ends[:-1])], num_threads=1)
            equal = equal & np.array([a == b for a, b in zip(out["decoded"], twin)], bool)
        return {**out, "agrees": equal}
    rows = C.texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(C.by_block(work, schema), "doc_id long, ids array<int>, agrees boolean" + ", decoded string" * back)


def decode(encoded: DataFrame, path: str, *more: Column) -> DataFrame:
    """doc_id, text and agrees of each list of ids, by the model file at `path` (on the driver), and further columns of `encoded`."""
    model = model_bytes(path)
    step = C.BLOCK_BYTES // 4
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"), *more)
    kept = [c for c in rows.columns if c != "ids"]

    def texts(v, column):
        flat = pa.compute.fill_null(column.flatten(), -1).to_numpy()
        ends = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False))
        strange = np.flatnonzero((flat < 0) | (flat >= len(v.text)))
        if len(strange):
            lists = [x.tolist() for x in np.split(flat, ends[:-1])]
            known = np.ones(len(lists), bool)
            known[np.searchsorted(ends, strange, side="right")] = False
            out = [v.decode(x) for x in lists]
            same = v.library.decode([x if k else [] for x, k in zip(lists, known)], num_threads=1)
        else:
            known, out = np.ones(len(column), bool), v.texts(flat, ends)
            same = v.library.decode([x or [] for x in column.to_pylist()], num_threads=1)
        return pa.array(out, pa.string()), pa.array(known & np.array([a == b for a, b in zip(out, same)], bool), pa.bool_())

    def run(batches):
        v = vocabulary(model)
        for batch in batches:
            ends = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False))
            first = 0
            while first < batch.num_rows:
                stop = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + step, side="right")))
                part = batch.slice(first, stop - first)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *texts(v, part.column("ids"))], names=[*kept, "text", "agrees"])
                first = stop
    schema = rows.drop("ids").schema.add("text", "string").add("agrees", "boolean")
    return rows.mapInArrow(run, schema)
