"""Byte-level BPE through a memory-mapped minimal acyclic transducer of frequent words.

Words (with the blank before them) are counted over the whole corpus; the most frequent, with the ids
the merges give them, are compiled into a minimal acyclic automaton that shares prefixes and suffixes.
Arcs carry additive outputs, whose sum along a word is the word's number, and that number leads to its
ids.  Workers map the compiled file into memory.  Words that are not in the lexicon are cut into pieces
by the vocabulary's pattern and merged exactly.  Ids and decoded bytes of recent words are memoised.
"""

from __future__ import annotations

import gc
import hashlib
import json
import mmap
import os
import re
import struct
import sys
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LEXICON_WORDS = 1 << 17
MEMO_WORDS = 900_000
COUNTS = "word string, n long"
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, decoded string"
#: The characters with the Unicode property White_Space.
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _ranges(kind: str) -> str:
    """The code points of a general category, as the inside of a character class."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        hit = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == kind
        if hit and start is None:
            start = c
        elif not hit and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@cache
def pattern() -> re.Pattern:
    """The byte-level vocabulary's pattern for pieces, with its Unicode classes written out."""
    letter, number = _ranges("L"), _ranges("N")
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{WHITE}{letter}{number}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable in Latin-1, else the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


NONE = np.iinfo(np.int32).max


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)


class Vocabulary:
    """Ids, merges and special tokens of a byte-level BPE vocabulary file in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = _byte_chars()
        raw = {t: bytes(of[c] for c in t) for t in spec["model"]["vocab"] if all(c in of for c in t)}
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {ids[t]: b for t, b in raw.items()} | {i: t.encode() for t, i in self.special.items()}
        self.byte_id = [0] * 256
        for t, b in raw.items():
            if len(b) == 1:
                self.byte_id[b[0]] = ids[t]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_table"}

    def _merge_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The merges in an open hash table of arrays: keys, ranks, new ids."""
        if not hasattr(self, "_table"):
            keys, ranks, new = np.zeros(1 << 18, np.uint64), np.full(1 << 18, NONE, np.int32), np.zeros(1 << 18, np.int32)
            pairs = np.array(list(self.merges), dtype=np.uint64).reshape(-1, 2)
            key = (pairs[:, 0] << np.uint64(32) | pairs[:, 1]) + np.uint64(1)
            values = np.array(list(self.merges.values()), dtype=np.int32).reshape(-1, 2)
            slot, left = _slot(key), np.arange(len(key))
            while len(left):
                free = keys[slot[left]] == 0
                take = left[free][np.unique(slot[left[free]], return_index=True)[1]]
                keys[slot[take]], ranks[slot[take]], new[slot[take]] = key[take], values[take, 0], values[take, 1]
                left = left[~np.isin(left, take)]
                slot[left] = (slot[left] + 1) & (len(keys) - 1)
            self._table = keys, ranks, new
        return self._table

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair (NONE if it isn't merged) and its new id."""
        keys, ranks, new = self._merge_table()
        key = (a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) + np.uint64(1)
        slot = _slot(key)
        there = keys[slot]
        left = np.flatnonzero((there != key) & (there != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(keys) - 1)
            there = keys[slot[left]]
            left = left[(there != key[left]) & (there != 0)]
        return np.where(keys[slot] == key, ranks[slot], NONE), new[slot]

    def merge_many(self, pieces: list[bytes]) -> list[list[int]]:
        """merge() of every piece, all pieces at once: each round does every piece's first merge of lowest rank."""
        out: list[list[int]] = [[]] * len(pieces)
        lens = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        for i in np.flatnonzero(lens > 200).tolist():
            out[i] = self.merge(pieces[i])
        who = np.flatnonzero((lens > 0) & (lens <= 200))
        ids = np.array(self.byte_id, dtype=np.int32)[np.frombuffer(b"".join([pieces[i] for i in who.tolist()]), np.uint8)]
        n = lens[who]
        while len(who):
            first = np.cumsum(n) - n
            rank, new = np.full(len(ids), NONE, np.int32), np.zeros(len(ids), np.int32)
            rank[:-1], new[:-1] = self._pair_ranks(ids[:-1], ids[1:])
            rank[first + n - 1] = NONE
            best = np.minimum.reduceat(rank, first)
            over = best == NONE
            if over.any():
                done = ids[np.repeat(over, n)].tolist()
                at = 0
                for i, k in zip(who[over].tolist(), n[over].tolist()):
                    out[i] = done[at : at + k]
                    at += k
            owner = np.repeat(np.arange(len(who)), n)
            at = np.flatnonzero((rank == best[owner]) & ~over[owner])
            at = at[np.unique(owner[at], return_index=True)[1]]  # the leftmost of each piece
            ids[at] = new[at]
            keep = ~over[owner]
            keep[at + 1] = False
            ids, who, n = ids[keep], who[~over], n[~over] - 1
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Apply the merges of lowest rank first, leftmost first among equals."""
        ids = [self.byte_id[b] for b in piece]
        if len(ids) > 200:
            return self._merge_long(ids)
        get = self.merges.get
        while len(ids) > 1:
            best = min(((m, i) for i, m in enumerate(map(get, zip(ids, ids[1:]))) if m), default=None)
            if best is None:
                break
            (rank, new), i = best
            ids[i : i + 2] = [new]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and links, for very long pieces."""
        import heapq

        n = len(ids)
        nxt, prev, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], nxt[i] = new, False, nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            for x, y in ((prev[i], i), (i, nxt[i])):
                if x >= 0 and y >= 0 and (m := self.merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y], m[1]))
        return [x for x, live in zip(ids, alive) if live]


# ---------------------------------------------------------------- the transducer
def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic automaton of the words, built in sorted order, with their ids; laid out for mapping."""
    register: dict[tuple, int] = {}
    finals: list[bool] = []
    arcs_of: list[tuple[tuple[int, int], ...]] = []
    counts: list[int] = []

    def freeze(node: list) -> int:
        """The number of the registered state equal to an open node [final, {byte: state}]."""
        key = (node[0], tuple(node[1].items()))
        if key not in register:
            register[key] = len(finals)
            finals.append(node[0])
            arcs_of.append(key[1])
            counts.append(node[0] + sum(counts[t] for _, t in key[1]))
        return register[key]

    path: list[list] = [[False, {}]]
    last = b""
    order = sorted(entries)
    for word in order:
        common = len(os.path.commonprefix((last, word)))
        while len(path) > common + 1:
            node = path.pop()
            path[-1][1][last[len(path) - 1]] = freeze(node)
        path.extend([False, {}] for _ in word[common:])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1][last[len(path) - 1]] = freeze(node)
    root = freeze(path[0])
    first = np.cumsum([0, *map(len, arcs_of)]).astype(np.uint32)
    labels, targets, outputs = bytearray(), [], []
    for final, arcs in zip(finals, arcs_of):
        skipped = int(final)
        for byte, t in arcs:
            labels.append(byte)
            targets.append(t)
            outputs.append(skipped)
            skipped += counts[t]
    ids = [entries[w] for w in order]
    at = np.cumsum([0, *map(len, ids)]).astype(np.uint32)
    labels += bytes(-len(labels) % 4)
    parts = [bytes(labels), bytes(map(int, finals)) + bytes(-len(finals) % 4), first.tobytes(), np.array(targets, np.uint32).tobytes(), np.array(outputs, np.uint32).tobytes(), at.tobytes(), np.array([i for x in ids for i in x], np.uint32).tobytes()]
    return struct.pack("<8Q", root, *map(len, parts)) + b"".join(parts)


class Lexicon:
    """A compiled lexicon, mapped from a file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.root, *sizes = struct.unpack_from("<8Q", self.map)
        at = np.cumsum([64, *sizes]).tolist()
        self.labels, self.finals = at[0], at[1]
        view = memoryview(self.map)
        ints = lambda i: view[at[i] : at[i + 1]].cast("I")
        self.first, self.targets, self.outputs, self.at, self.ids = map(ints, range(2, 7))
        self.np_targets, self.np_outputs = (np.frombuffer(view[at[i] : at[i + 1]], np.uint32) for i in (3, 4))
        own = np.repeat(np.arange(len(self.first) - 1), np.diff(np.asarray(self.first, dtype=np.int64)))
        self.arc_keys = (own << 8) | np.frombuffer(view[at[0] : at[0] + len(own)], np.uint8)

    def get_many(self, words: list[bytes]) -> list[list[int] | None]:
        """get() of every word, all words at once: a step of the automaton for all words that are still in it."""
        out: list[list[int] | None] = [None] * len(words)
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        at = np.cumsum(lens) - lens
        live, state, number = np.arange(len(words)), np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(live):
            ended = lens[live] == step
            for i, s, k in zip(live[ended].tolist(), state[ended].tolist(), number[ended].tolist()):
                if self.map[self.finals + s]:
                    out[i] = self.ids[self.at[k] : self.at[k + 1]].tolist()
            live, state, number = live[~ended], state[~ended], number[~ended]
            if not len(live) or not len(self.arc_keys):
                break
            key = (state << 8) | data[at[live] + step]
            arc = np.minimum(np.searchsorted(self.arc_keys, key), len(self.arc_keys) - 1)
            hit = self.arc_keys[arc] == key
            live, arc = live[hit], arc[hit]
            state, number = self.np_targets[arc].astype(np.int64), number[hit] + self.np_outputs[arc]
            step += 1
        return out

    def get(self, word: bytes) -> list[int] | None:
        """The ids of a word of the lexicon."""
        state, number, find = self.root, 0, self.map.find
        base, first, targets, outputs = self.labels, self.first, self.targets, self.outputs
        for i in range(len(word)):
            arc = find(word[i : i + 1], base + first[state], base + first[state + 1])
            if arc < 0:
                return None
            arc -= base
            number += outputs[arc]
            state = targets[arc]
        if not self.map[self.finals + state]:
            return None
        return self.ids[self.at[number] : self.at[number + 1]].tolist()


_WHITE = re.compile(f"[{WHITE}]")


class _Memo:
    """word -> ids joined by commas, in two generations: words not used while a generation fills up are forgotten."""

    def __init__(self):
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def missing(self, words: set[str]) -> set[str]:
        """Bring what is known of the words into the young generation; the words that aren't known."""
        if len(self.young) + len(words) > MEMO_WORDS:
            self.young, self.old = {}, self.young
        new = words - self.young.keys()
        old = self.old
        known = [w for w in new if w in old]
        self.young.update([(w, old[w]) for w in known])
        return new.difference(known)


class Encoder:
    """Encodes texts word by word through the lexicon and the merges.

    No piece spans a single blank or line feed between two words, so a regular text is cut there, which
    is much cheaper than the pattern; a word that is not in the lexicon is cut by the pattern and merged.
    Texts with other white space, or with special tokens, are cut by the pattern as a whole.  Words are
    looked up and merged for many texts at once and memoised.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        special = vocabulary.special
        self.split = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.first, self.later = _Memo(), _Memo()
        self.odd: set[str] = set()
        self.feed = self._join(vocabulary.merge(b"\n"))

    @staticmethod
    def _join(ids: list[int]) -> str:
        return ",".join(map(str, ids))

    def _ids_of(self, units: list[str]) -> list[list[int]]:
        """The ids of each unit: by the lexicon, or else by its pieces' merges."""
        raw = [u.encode() for u in units]
        found = self.lexicon.get_many(raw)
        rest = [i for i, x in enumerate(found) if x is None]
        whole = [i for i in rest if units[i][1:].isalpha() and (units[i][0] == " " or units[i][0].isalpha())]
        for i, ids in zip(whole, self.vocabulary.merge_many([raw[i] for i in whole])):
            found[i] = ids
        cut = [(i, [x.encode() for x in pattern().findall(units[i])]) for i in rest if found[i] is None]
        merged = iter(self.vocabulary.merge_many([x for _, p in cut for x in p]))
        for i, p in cut:
            found[i] = [t for _ in p for t in next(merged)]
        return found

    def _learn(self, memo: _Memo, prefix: str, words: set[str]) -> None:
        new = [w for w in memo.missing(words) if w and not _WHITE.search(w)]
        found = self._ids_of([prefix + w for w in new])
        memo.young.update(zip(new, map(self._join, found)))
        # Every word's ids are decoded once; a text of words that decode to themselves decodes to itself.
        raw = self.vocabulary.bytes_of
        self.odd.update(w for w, ids in zip(new, found) if b"".join([raw[i] for i in ids]) != (prefix + w).encode())

    def _any(self, text: str) -> list[int]:
        find, at, out = pattern().findall, 0, []
        for m in self.split.finditer(text) if self.split else ():
            out += [i for ids in self._ids_of(find(text[at : m.start()])) for i in ids]
            out.append(self.vocabulary.special[m[0]])
            at = m.end()
        return out + [i for ids in self._ids_of(find(text[at:])) for i in ids]

    def encode_many(self, texts: list[str]) -> list[tuple[str, str]]:
        """All ids of each text joined by commas, and the text they decode to; special tokens in the text are their own ids, as the tokenizers library has it."""
        cut = [None if not t or (self.split and self.split.search(t)) else [line.split(" ") for line in t.split("\n")] for t in texts]
        heads: set[str] = set()
        words: set[str] = set()
        for lines in cut:
            for line in lines or ():
                heads.add(line[0])
                words.update(line)
        self._learn(self.first, "", heads)
        self._learn(self.later, " ", words)
        first, later, feed = self.first.young, self.later.young, "," + self.feed + ","
        out = []
        for text, lines in zip(texts, cut):
            try:
                if lines is None:
                    raise KeyError
                ids = feed.join([",".join([first[line[0]], *map(later.__getitem__, line[1:])]) for line in lines])
                whole = not self.odd or all(self.odd.isdisjoint(line) for line in lines)
                out.append((ids, text if whole else self.decode(ids)))
            except KeyError:  # white space of other kinds, or special tokens
                ids = self._join(self._any(text)) if text else ""
                out.append((ids, self.decode(ids)))
        return out

    def decode(self, ids: str) -> str:
        """The text of ids joined by commas."""
        if not ids:
            return ""
        return b"".join(map(self.bytes_of_text.__getitem__, ids.split(","))).decode("utf-8", "replace")

    @property
    def bytes_of_text(self) -> dict[str, bytes]:
        if not hasattr(self, "_bytes_of_text"):
            self._bytes_of_text = {str(i): b for i, b in self.vocabulary.bytes_of.items()}
        return self._bytes_of_text


def count_words(docs: DataFrame, limit: int = 500_000) -> DataFrame:
    """word, n over all texts: the words after a blank, summed in the workers and again by word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        gc.disable()
        for batch in C.small_batches(batches, "text", 1 << 20):
            for text in batch.column(0).to_pylist():
                for line in text.split("\n") if text else ():
                    held.update(line.split(" ")[1:])
            if len(held) > limit:
                yield C.record(COUNTS, word=list(held), n=list(held.values()))
                held.clear()
        if held:
            yield C.record(COUNTS, word=list(held), n=list(held.values()))
        gc.enable()

    return docs.select(F.col("`text`").alias("text")).mapInArrow(count, COUNTS).groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, size: int = LEXICON_WORDS) -> list[str]:
    """At most `size` words, each with the blank before it: all with a count of at least the smallest threshold that leaves so few; words over 64 characters are left out."""
    counts = C.materialise(count_words(docs).where("n > 1 and length(word) between 1 and 64"), "words")
    # Counts of counts, in powers of two and sixteenths of them: a bounded number of rows whatever the corpus.
    step = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    levels = sorted(((r.level, r.n) for r in counts.groupBy(step.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, least = 0, None
    for level, n in levels:
        total += n
        if total > size:
            break
        least = level
    return [] if least is None else [" " + r.word for r in counts.where(step >= least).select("word").collect()]


_ENCODERS: dict[str, Encoder] = {}


def worker_encoder(digest: str, shipped) -> Encoder:
    """This worker's encoder; the compiled lexicon is written to a file of its own, mapped, and unlinked, so the file goes with the worker."""
    if digest not in _ENCODERS:
        vocabulary, compiled = shipped.value
        fd, path = tempfile.mkstemp(suffix=".lexicon")
        with os.fdopen(fd, "wb") as f:
            f.write(compiled)
        _ENCODERS.clear()
        _ENCODERS[digest] = Encoder(vocabulary, Lexicon(path))
        os.unlink(path)
    return _ENCODERS[digest]


def encode(docs: DataFrame, vocabulary_path: str, lexicon_words: int = LEXICON_WORDS, outputs: bool = True) -> DataFrame:
    """Encode every whole text, and decode the ids again.

    docs: doc_id long, text string; other columns are ignored.  Returns doc_id, n_tokens, ids_sha256 (of
    the decimal ids joined by commas), decoded_sha256, and with outputs `ids` (32-bit little-endian) and
    `decoded`.  A null text is an empty one: no tokens.  One row for each input row; ids equal those of
    the tokenizers library for the same vocabulary without added special tokens.
    """
    C.bound_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    vocabulary = Vocabulary(vocabulary_path)
    compiled = compile_lexicon({w.encode(): [i for piece in pattern().findall(w) for i in vocabulary.merge(piece.encode())] for w in frequent_words(docs, lexicon_words)})
    digest = hashlib.sha256(compiled).hexdigest() + vocabulary_path
    shipped = sc.broadcast((vocabulary, compiled))  # bounded by the vocabulary and lexicon_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(digest, shipped)
        gc.disable()  # lists of words by the million, none in a cycle
        try:
            yield from encode_batches(batches, encoder)
        finally:
            gc.enable()

    def encode_batches(batches: Iterator[pa.RecordBatch], encoder: Encoder) -> Iterator[pa.RecordBatch]:
        for batch in C.small_batches(batches, "text"):
            n, ids, texts, a, b = [], [], [], [], []
            for joined, decoded in encoder.encode_many([t or "" for t in batch.column(1).to_pylist()]):
                n.append(joined.count(",") + 1 if joined else 0)
                a.append(hashlib.sha256(joined.encode()).hexdigest())
                b.append(hashlib.sha256(decoded.encode()).hexdigest())
                ids.append(np.array(joined.split(","), dtype=np.uint32).tobytes() if outputs and joined else b"" if outputs else None)
                texts.append(decoded if outputs else None)
            yield C.record(RESULT, doc_id=batch.column(0).to_pylist(), n_tokens=n, ids_sha256=a, decoded_sha256=b, ids=ids, decoded=texts)

    out = C.with_columns_first(docs, ["doc_id", "text"]).mapInArrow(run, RESULT)
    return out if outputs else out.drop("ids", "decoded")
