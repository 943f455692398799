"""Benchmark decontamination by a generalised suffix automaton of test items.

The automaton's symbols are words. Training words stream through it; at each
word it knows the longest run of words, ending there, that some item contains.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratapage.llm.common import prepare
from stratapage.llm.kernels import blocks, word_hashes

WINDOW = 13
#: Bytes of item texts that one automaton holds; more items make more automata, one after the other.
ITEM_BYTES = 2 << 20
#: Bytes of rows that a task holds while the automata, where there are several, go over them in turn.
HOLD_BYTES = 64 << 20
#: A document is contaminated when at least one word in SHARE is hit.
SHARE = 20

#: Words are runs of ASCII letters and digits and of all bytes beyond ASCII.
BREAKS = np.zeros(256, bool)
BREAKS[:0x80] = True
BREAKS[0x30:0x3A] = BREAKS[0x61:0x7B] = BREAKS[0x41:0x5B] = False


class Automaton:
    """A suffix automaton of several word sequences, with the items that each state's windows belong to."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[set] = [set()]
        self.short: dict[int, dict[int, set]] = {}  # state -> length of a whole short item -> items

    def _state(self, length: int, next_: dict[int, int], link: int, items: set) -> int:
        self.next.append(next_)
        self.length.append(length)
        self.link.append(link)
        self.items.append(items)
        return len(self.length) - 1

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            to = self.next[last][word]
            if self.length[to] == self.length[last] + 1:
                return to
            return self._split(last, word, to)
        new = self._state(self.length[last] + 1, {}, 0, set())
        at = last
        while at != -1 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at != -1:
            to = self.next[at][word]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, word, to)
        return new

    def _split(self, at: int, word: int, to: int) -> int:
        new = self._state(self.length[at] + 1, dict(self.next[to]), self.link[to], set(self.items[to]))
        while at != -1 and self.next[at].get(word) == to:
            self.next[at][word] = new
            at = self.link[at]
        self.link[to] = new
        return new

    def build(self, sequences: list[tuple[str, list[int]]]) -> None:
        for item, words in sequences:
            last = 0
            for word in words:
                last = self._extend(last, word)
        for item, words in sequences:
            # a second walk, when the states are final: each prefix's state and the states of its suffixes see the item
            at = 0
            for i, word in enumerate(words):
                at = self.next[at][word]
                up = at
                while up > 0 and item not in self.items[up]:
                    self.items[up].add(item)
                    up = self.link[up]
            if 0 < len(words) < self.window:
                while self.length[self.link[at]] >= len(words):
                    at = self.link[at]
                self.short.setdefault(at, {}).setdefault(len(words), set()).add(item)
        # nearest state on the suffix links, itself included, that ends a whole short item
        self.marked = [-1] * len(self.length)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.marked[state] = state if state in self.short else self.marked[self.link[state]]

    def packed(self, alphabet: int) -> Packed:
        """The same automaton in flat arrays, for words numbered below ``alphabet``."""
        keys, to = [], []
        for state, following in enumerate(self.next):
            for word, target in following.items():
                keys.append(state * alphabet + word)
                to.append(target)
        order = sorted(range(len(keys)), key=keys.__getitem__)
        names = sorted({x for own in self.items for x in own}, key=lambda x: (x is None, x or ""))
        number = {x: i for i, x in enumerate(names)}
        # the states that a match of a whole window belongs to
        tops = [i for i in range(1, len(self.length)) if self.length[i] >= self.window > self.length[self.link[i]]]
        ends, items = [0], []
        for i in tops:
            items += [number[x] for x in self.items[i]]
            ends.append(len(items))
        short = [(state, size, number[x]) for state in sorted(self.short) for size, own in self.short[state].items() for x in own]
        return Packed(
            self.window, alphabet, array("q", [keys[i] for i in order]), array("i", [to[i] for i in order]), array("i", self.link), array("i", self.length), array("i", self.marked),
            array("i", tops), array("q", ends), array("i", items), *(array("i", [x[i] for x in short]) for i in range(3)), names,
        )


class Packed:
    """A built automaton in flat arrays: a few bytes for each word of its items."""

    def __init__(self, window, alphabet, keys, to, link, length, marked, tops, ends, items, short_states, short_sizes, short_items, names) -> None:
        self.window, self.alphabet = window, alphabet
        self.keys, self.to, self.link, self.length, self.marked = keys, to, link, length, marked
        self.tops, self.ends, self.items = tops, ends, items
        self.short_states, self.short_sizes, self.short_items, self.names = short_states, short_sizes, short_items, names

    def step(self, state: int, word: int) -> int:
        """The state behind a word, or -1."""
        key = state * self.alphabet + word
        at = bisect_left(self.keys, key)
        return self.to[at] if at < len(self.keys) and self.keys[at] == key else -1

    def stream(self, words: list[int]) -> tuple[list[tuple[int, int]], set]:
        """Hit runs [first, end) of words, which may overlap, and the items whose windows occur."""
        state = have = 0
        runs, found = [], set()
        for i, word in enumerate(words):
            to = self.step(state, word)
            while to < 0 and state:
                state = self.link[state]
                have = self.length[state]
                to = self.step(state, word)
            if to < 0:
                continue
            state, have = to, have + 1
            if have >= self.window:
                runs.append((i + 1 - self.window, i + 1))
                at = state
                while self.length[self.link[at]] >= self.window:
                    at = self.link[at]
                top = bisect_left(self.tops, at)
                found.update(self.items[self.ends[top] : self.ends[top + 1]])
            at = self.marked[state]
            while at > 0:
                own = bisect_left(self.short_states, at)
                while own < len(self.short_states) and self.short_states[own] == at:
                    size = self.short_sizes[own]
                    if size <= have:
                        runs.append((i + 1 - size, i + 1))
                        found.add(self.short_items[own])
                    own += 1
                at = self.marked[self.link[at]]
        return runs, {self.names[x] for x in found}


def _index(rows: list[tuple[str, str]], window: int) -> bytes:
    """An automaton of (item, text) rows, with the words and word pairs it knows."""
    hashes = [words for _, _, words in _words(pa.array([t for _, t in rows], pa.string()))]
    known = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]))
    coded = [np.searchsorted(known, h) for h in hashes]
    pairs = np.unique(np.concatenate([*(c[:-1] * len(known) + c[1:] for c in coded if len(c) > 1), np.zeros(0, np.int64)]))
    automaton = Automaton(window)
    automaton.build([(item, c.tolist()) for (item, _), c in zip(rows, coded, strict=True)])
    shortest = min([len(c) for c in coded if len(c)] + [window])
    return pickle.dumps((known, pairs, shortest, automaton.packed(max(1, len(known)))))


def _words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Starts, ends and hashes of the words of each text."""
    for first, last, data, offsets in blocks(column):
        words, starts, ends, begin = word_hashes(data, offsets, BREAKS)
        for i in range(last - first):
            a, b = begin[i], begin[i + 1]
            yield starts[a:b] - offsets[i], ends[a:b] - offsets[i], words[a:b]


def _scan(column: pa.Array, index: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, set]]:
    """Starts and ends of the words of each text, which words are hit, and the items found."""
    known, pairs, shortest, automaton = index
    for starts, ends, words in _words(column):
        hit, found = np.zeros(len(words), bool), set()
        if len(words) and len(known):
            code = np.minimum(np.searchsorted(known, words), len(known) - 1)
            fits = known[code] == words
            if shortest > 1:
                # a run of words in an item is a run of word pairs in an item: only such runs go through the automaton
                pair = code[:-1] * len(known) + code[1:]
                at = np.minimum(np.searchsorted(pairs, pair), max(0, len(pairs) - 1))
                joined = fits[:-1] & fits[1:] & (pairs[at] == pair) if len(pairs) else np.zeros(len(words) - 1, bool)
                edge = np.flatnonzero(np.diff(np.r_[False, joined, False].astype(np.int8)))
                low, high = edge[::2], edge[1::2] + 1
            else:
                edge = np.flatnonzero(np.diff(np.r_[False, fits, False].astype(np.int8)))
                low, high = edge[::2], edge[1::2]
            long = high - low >= shortest
            for a, b in zip(low[long].tolist(), high[long].tolist(), strict=True):
                runs, items = automaton.stream(code[a:b].tolist())
                found |= items
                for x, y in runs:
                    hit[a + x : a + y] = True
        yield starts, ends, hit, found


_loaded: dict[str, tuple] = {}


def _load(key: str, shared) -> tuple:
    """The index of a broadcast value; a worker keeps one, and not its raw bytes."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = pickle.loads(shared.value)
        if getattr(shared, "_path", None):
            # the value is read from its file again when its turn comes
            shared.__dict__.pop("_value", None)
    return _loaded[key]


def _indexes(benchmark: DataFrame, window: int) -> list[tuple[str, object]]:
    """Broadcast indexes of all items, each of ITEM_BYTES of text at most unless one item is longer.

    An index goes to all executors; more text than one may hold makes more
    indexes, read from the table one by one. Each has a key of its own.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(benchmark["text"].cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + size // ITEM_BYTES
    of = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
    out = []
    for i in range(parts):
        rows = [(r.item, r.text) for r in items.where(of == i).collect()]
        out.append((uuid.uuid4().hex, benchmark.sparkSession.sparkContext.broadcast(_index(rows, window))))
    return out


def _hits(column: pa.Array, index: tuple) -> Iterator[tuple[int, list[tuple[int, int, int, int]], set]]:
    """Words, hit runs and items found of each text; a run has its first word and end, then its first byte and end."""
    for starts, ends, hit, found in _scan(column, index):
        edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
        yield len(hit), [(a, b, int(starts[a]), int(ends[b - 1])) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)], found


def _union(runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The runs in order, those that overlap or touch as one."""
    out: list[tuple[int, int, int, int]] = []
    for run in sorted(runs):
        if out and run[0] <= out[-1][1]:
            low, high, first, end = out[-1]
            out[-1] = (low, max(high, run[1]), first, max(end, run[3]))
        else:
            out.append(run)
    return out


def _held(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of at least size bytes but for the last."""
    held, have = [], 0
    for batch in batches:
        held.append(batch)
        have += batch.nbytes
        if have >= size:
            yield held
            held, have = [], 0
    if held:
        yield held


def _judged(batches: Iterator[pa.RecordBatch], indexes: list[tuple[str, object]]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Each batch, with what all indexes together find in its texts as they came.

    The indexes are loaded in turn, one at a time, for HOLD_BYTES of rows.
    """
    for held in _held(batches, HOLD_BYTES if len(indexes) > 1 else 1):
        found: list[list] = []
        for key, shared in indexes:
            # no name for the index here: it must go before the next is loaded
            now = [list(_hits(batch["text"], _load(key, shared))) for batch in held]
            if found:
                now = [[(n, _union(runs + more), items | others) for (n, runs, items), (_, more, others) in zip(*pair, strict=True)] for pair in zip(found, now, strict=True)]
            found = now
        yield from zip(held, found, strict=True)


def _report(indexes: list[tuple[str, object]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _judged(batches, indexes):
            total = [n for n, _, _ in rows]
            count = [sum(b - a for a, b, _, _ in runs) for _, runs, _ in rows]
            items = [sorted(x for x in found if x is not None) for _, _, found in rows]
            yield pa.record_batch([batch["doc_id"], pa.array(total, pa.int64()), pa.array(count, pa.int64()), pa.array(items, pa.list_(pa.string()))], ["doc_id", "n_words", "n_hit", "items"])

    return run


_FOUND = "doc_id long, n_words long, n_hit long, items array<string>"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs.

    A window is ``window`` consecutive words of an item, or a whole item of
    fewer; words inside an occurrence of a window are hit. items_sha256 digests
    the sorted, comma-joined ids of the items with occurring windows.

    Nulls: a null text has no words; items with no words match nothing, items
    with a null id count as hits but aren't listed; null document ids stay
    null. Repeated rows are judged alike, repeated item ids count once. An
    empty benchmark hits nothing, empty docs give no rows. Other columns are
    ignored. Items go to the executors by ITEM_BYTES of text at a time.
    """
    prepare(docs.sparkSession)
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    found = slim.mapInArrow(_report(_indexes(benchmark, window)), _FOUND)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without contaminated rows; of the others, hit words and what stands between them are cut from the text.

    Row counts, nulls and repeated rows as in ``contamination``; a row without
    hits is unchanged. n_chars, where docs has it, follows the new text.
    """
    prepare(docs.sparkSession)
    names = docs.columns
    resize = "n_chars" in names

    def strip(indexes):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, rows in _judged(batches, indexes):
                old, new, keep = batch["text"].to_pylist(), [], []
                for text, (total, runs, _) in zip(old, rows, strict=True):
                    n = sum(b - a for a, b, _, _ in runs)
                    keep.append(not (n and SHARE * n >= total))
                    if n and keep[-1]:
                        raw, left, end = text.encode(), [], 0
                        for _, _, low, high in runs:
                            left.append(raw[end:low])
                            end = high
                        left.append(raw[end:])
                        text = b"".join(left).decode()
                    new.append(text)
                at = batch.schema.get_field_index("text")
                batch = batch.set_column(at, "text", pa.array(new, pa.string()))
                if resize:
                    at = batch.schema.get_field_index("n_chars")
                    sizes = [old_n if t == o or t is None else len(t) for old_n, t, o in zip(batch["n_chars"].to_pylist(), new, old, strict=True)]
                    batch = batch.set_column(at, "n_chars", pa.array(sizes, batch.schema.field(at).type))
                yield batch.filter(pa.array(keep, pa.bool_()))

        return run

    docs = docs.withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(strip(_indexes(benchmark, window)), docs.schema).select(*names)
