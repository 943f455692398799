"""Repeated substrings by enhanced suffix arrays.

``maximal_repeats`` is the plain form: a suffix array with its LCP table, whose
common-prefix intervals are read off with a stack and kept where the bytes to
the left differ.

``repeated_ranges`` is the distributed form for a fixed length. Each window of
that many bytes holds a k-byte gram whose hash is smallest, its anchor; equal
windows have equal anchors, so a suffix array of all texts can be cut into
independent pieces by anchor. Consecutive windows with one anchor form a span.
Equal spans are settled by two independent hashes; only the first of each
different span of a shared anchor goes into a piece. A piece compares its
windows byte by byte, and reads the maximal repeats with all their occurrences
off the intervals of its suffix array; all of these but the earliest go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratapage.llm.common import NULL_ID, prepare, written
from stratapage.llm.kernels import BLOCK_BYTES, blocks, mix, prefix_hash, second_hash, sliding_min, span_hash

GRAM = 32
#: Different spans of one anchor up to which they share a suffix array; beyond, their windows are dealt out.
PIECE = 32768
#: Documents sampled for anchors that more than PIECE documents may hold.
SAMPLE = 5000
#: A dealt-out window of more spans than this, and than one in HOT_SHARE of all, is hot: there are HOT_SHARE hot ones at most.
HOT, HOT_SHARE = 1024, 4096
_U = np.uint64
#: What a document is called: its id and a hash of its text.
DOC = ["doc", "alt"]


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by prefix doubling."""
    n = len(data)
    rank, step = data.astype(np.int64), 1
    while True:
        second = np.full(n, -1, np.int64)
        second[: n - step] = rank[step:] if step < n else 0
        order = np.lexsort((second, rank))
        a, b = rank[order], second[order]
        fresh = np.r_[0, ((a[1:] != a[:-1]) | (b[1:] != b[:-1])).astype(np.int64)]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        step *= 2
        if not n or rank[order[-1]] == n - 1 or step >= 2 * n:
            return order


def lcp_table(data: bytes, order: np.ndarray) -> list[int]:
    """Common prefix of each suffix and the one before it in order."""
    n = len(order)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    rank, order, out, h = rank.tolist(), order.tolist(), [0] * n, 0
    for i in range(n):
        if rank[i]:
            j = order[rank[i] - 1]
            while i + h < n and j + h < n and data[i + h] == data[j + h]:
                h += 1
            out[rank[i]] = h
            h = max(0, h - 1)
        else:
            h = 0
    return out


def common_prefix_intervals(order: np.ndarray, lcp: list[int], left: list[int], shortest: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the intervals of the suffix array with a common prefix of ``shortest`` or more that left extensions tell apart.

    ``left`` has for each suffix in order the symbol before it, or a negative
    number of its own where there is none.
    """
    stack: list[list] = []  # length, first, the one symbol to the left or None for several
    n = len(order)
    for i in range(1, n + 1):
        depth = lcp[i] if i < n else 0
        first, symbol = i - 1, left[i - 1]
        while stack and stack[-1][0] > depth:
            length, first, seen = stack.pop()
            seen = seen if seen == symbol else None
            if seen is None and length >= shortest:
                yield length, first, i - 1
            symbol = seen
        if stack and stack[-1][0] == depth:
            stack[-1][2] = stack[-1][2] if stack[-1][2] == symbol else None
        elif depth:
            stack.append([depth, first, symbol])


def maximal_repeats(items: list[bytes], shortest: int) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """The repeats of ``shortest`` bytes or more that no occurrence-preserving extension lengthens, each with all its (item, start).

    Matches don't cross items. Empty items, and no items, give nothing.
    """
    joined = b"".join(items)
    if not joined:
        return []
    sizes = np.array([len(x) for x in items])
    symbols = np.frombuffer(joined, np.uint8).astype(np.int64) + len(items)
    ends = np.cumsum(sizes)
    whole = np.empty(len(symbols) + len(items), np.int64)
    at = np.arange(len(symbols)) + np.repeat(np.arange(len(items)), sizes)
    whole[at] = symbols
    stops = ends + np.arange(len(items))
    whole[stops] = np.arange(len(items))  # each item ends in a symbol of its own
    order = suffix_array(whole)
    lcp = lcp_table(whole.tolist(), order)
    begins = set((stops - sizes).tolist())
    listed = whole.tolist()
    left = [-1 - int(i) if int(i) in begins else listed[i - 1] for i in order]
    starts = stops - sizes
    out = []
    for length, first, last in common_prefix_intervals(order, lcp, left, shortest):
        found = np.sort(order[first : last + 1])
        item = np.searchsorted(starts, found, "right") - 1
        # an empty item shares its start with no other, since each has its own end symbol
        where = [(int(a), int(b)) for a, b in zip(item, found - starts[item], strict=True)]
        a, b = where[0]
        out.append((items[a][b : b + length], where))
    return out


def _spans(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, first window, number of windows, anchor and the two hashes of each span of a block."""
    n = len(data)
    none = np.zeros(0, np.int64)
    nothing = (none, none, none, *[none.astype(np.uint64)] * 3)
    if n < length:
        return nothing
    gram = min(GRAM, length)
    prefix = prefix_hash(data)
    at = np.arange(n - gram + 1)
    grams = mix(span_hash(prefix, at, at + gram))
    # by the hash's upper half, the leftmost of equals: so no two windows of a span are equal
    smallest = sliding_min((grams & _U(0xFFFFFFFF00000000)) | at.astype(np.uint64), length - gram + 1)
    sizes = np.diff(offsets)
    room = np.repeat(offsets[1:], sizes)[: n - length + 1] - at[: n - length + 1] >= length
    windows = np.flatnonzero(room)
    if not len(windows):
        return nothing
    place = (smallest[windows] & _U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    row = np.repeat(np.arange(len(sizes)), sizes)
    last = np.r_[first[1:], len(windows)] - 1
    start, count = windows[first], last - first + 1
    whole = mix(span_hash(prefix, start, start + count + length - 1))
    whole = (whole & _U(0xFFFFFFFFFFFF0000)) | count.astype(np.uint64)  # a span's hash carries its number of windows
    return row[start], start - offsets[row[start]], count, grams[place[first]], whole, second_hash(data, start, start + count + length - 1)


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in blocks(batch["text"]):
                row, _, _, anchor, _, _ = _spans(data, offsets, length)
                ids = row.astype(np.uint64) ^ anchor
                keep = np.unique(ids, return_index=True)[1]  # once a document
                yield pa.record_batch([pa.array(anchor[keep].view(np.int64))], ["anchor"])

    return run


def _emit(length: int, frequent: np.ndarray):
    """Spans to be settled; of equal spans in one batch all but the first are settled at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, alts = batch["doc"].to_numpy(), batch["alt"].to_numpy()
            parts = []
            for first, _, data, offsets in blocks(batch["text"]):
                row, start, _, anchor, whole, second = _spans(data, offsets, length)
                parts.append((anchor.view(np.int64), whole.view(np.int64), second.view(np.int64), ids[first + row], alts[first + row], start))
            if not parts:
                continue
            x = [np.concatenate(v) for v in zip(*parts, strict=True)]
            order = np.lexsort(x[::-1])
            x = [v[order] for v in x]
            head = np.flatnonzero(_changes(x[:3]))
            top = np.repeat(head, np.diff(np.r_[head, len(order)]))
            settled = np.zeros(len(order), bool)
            for v in x[3:]:
                settled |= v != v[top]
            deal = np.where(settled, 2, np.isin(x[0], frequent)).astype(np.int32)
            yield pa.record_batch([pa.array(v) for v in (*x, deal)], ["anchor", "span", "second", "doc", "alt", "start", "deal"])

    return run


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Where a row differs from the one before it."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for v in columns:
        out[1:] |= v[1:] != v[:-1]
    return out


#: What becomes of a span: gone, one of a suffix array's piece, or one whose windows are dealt out.
GONE, PIECED, DEALT = 0, 1, 2


_SETTLED = "anchor long, doc long, alt long, start long, windows long, kind int"


def _settle(frequent: np.ndarray):
    """Reads spans in order of (anchor, span, second, doc, alt, start); holds back at most PIECE of one anchor."""
    names = [c.split()[0] for c in _SETTLED.split(", ")]

    def pack(x: np.ndarray, kind):
        """Rows of anchor, doc, alt, start and windows as a batch."""
        anchor = np.where(np.asarray(kind) == GONE, 0, x[0])  # not needed any more
        columns = [pa.array(np.ascontiguousarray(v, np.int64)) for v in (anchor, *x[1:])]
        return pa.record_batch([*columns, pa.array(np.broadcast_to(np.asarray(kind, np.int32), x.shape[1]).copy())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = top = None  # anchor and hashes of the current span; doc, alt and start of its first
        held: list[np.ndarray] = []
        holding, spilling, anchor_now = 0, False, None

        def flush():
            nonlocal held, holding
            rows = held if spilling or holding > 1 else []
            held, holding = [], 0
            if rows:
                yield pack(np.concatenate(rows, axis=1), DEALT if spilling else PIECED)

        for batch in batches:
            a, w, v, d, z, s, deal = (batch[c].to_numpy(zero_copy_only=False) for c in ("anchor", "span", "second", "doc", "alt", "start", "deal"))
            done = deal == 2
            if done.any():
                yield pack(np.stack([a, d, z, s, w & 0xFFFF])[:, done], GONE)
                a, w, v, d, z, s = (x[~done] for x in (a, w, v, d, z, s))
            n = len(a)
            if not n:
                continue
            fresh = _changes([a, w, v])
            fresh[0] = before is None or (a[0], w[0], v[0]) != before
            at = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
            tops = [np.where(at >= 0, x[at], top[i] if top else 0) for i, x in enumerate((d, z, s))]
            gone = (d != tops[0]) | (z != tops[1]) | (s != tops[2])
            x = np.stack([a, d, z, s, w & 0xFFFF])
            if gone.any():
                yield pack(x[:, gone], GONE)
            before, top = (a[-1], w[-1], v[-1]), tuple(t[-1] for t in tops)
            x = x[:, fresh]
            hot = np.isin(x[0], frequent)
            if hot.any():
                yield pack(x[:, hot], DEALT)
                x = x[:, ~hot]
            if not x.shape[1]:
                continue
            edge = np.flatnonzero(_changes([x[0]]))
            stop = np.r_[edge[1:], x.shape[1]]
            sizes = stop - edge
            last = len(edge) - 1
            for g in ((0, last) if last else (0,)):
                part = x[:, edge[g] : stop[g]]
                if part[0, 0] != anchor_now:
                    yield from flush()
                    anchor_now, spilling = part[0, 0], False
                held.append(part)
                holding += part.shape[1]
                if spilling or holding > PIECE:
                    spilling = True
                    yield from flush()
                if g == 0 and last:
                    yield from flush()
                    anchor_now, spilling = None, False
                    inner = np.repeat((sizes > 1) & (np.arange(len(sizes)) > 0) & (np.arange(len(sizes)) < last), sizes)
                    if inner.any():
                        yield pack(x[:, inner], np.where(np.repeat(sizes, sizes)[inner] > PIECE, DEALT, PIECED))
        yield from flush()

    return run


def _lists(column: pa.Array, *fields: str) -> Iterator[np.ndarray]:
    """The rows of each value of an array of structs of longs, as a matrix; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    values = np.stack([flat.field(f).to_numpy(zero_copy_only=False) for f in fields], 1) if len(flat) else np.zeros((0, len(fields)), np.int64)
    end = 0
    for n in column.value_lengths().fill_null(0).to_pylist():
        yield values[end : end + n]
        end += n


def _contexts(length: int):
    """The bytes of the spans of each text that go to pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, alt, text, found in zip(*(batch[c].to_pylist() for c in (*DOC, "text")), _lists(batch["spans"], "anchor", "start", "windows"), strict=True):
                raw = (text or "").encode()
                rows += [(anchor, doc, alt, start, raw[start : start + windows + length - 1]) for anchor, start, windows in found.tolist()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [*[pa.int64()] * 4, pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["anchor", *DOC, "start", "bytes"])

    return run


def _windows(length: int):
    """The hashes of the windows of the spans of each text that are dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, alt, text, rows in zip(*(batch[c].to_pylist() for c in (*DOC, "text")), _lists(batch["spans"], "anchor", "start", "windows"), strict=True):
                data = np.frombuffer((text or "").encode(), np.uint8)
                count = rows[:, 2]
                at = np.repeat(rows[:, 1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                hashes = mix(span_hash(prefix_hash(data), at, at + length)).view(np.int64)
                second = second_hash(data, at, at + length).view(np.int64)
                yield pa.record_batch([pa.array(x) for x in (np.full(len(at), doc), np.full(len(at), alt), at, hashes, second)], [*DOC, "start", "window", "second"])

    return run


_RANGES = "doc long, alt long, low long, high long"


def _piece(rows: list[pa.RecordBatch], length: int) -> pa.RecordBatch:
    """Ranges of all but the earliest occurrences of the maximal repeats of ``length`` bytes or more, in a piece of whole anchors.

    The piece's windows, numbered by their content, are the symbols of the
    suffix array; a repeat of m windows is one of m - 1 + length bytes.
    """
    table = pa.Table.from_batches(rows)
    anchor, doc, alt, start = (table[c].to_numpy() for c in ("anchor", *DOC, "start"))
    content = [x.as_py() for x in table["bytes"]]
    sizes = np.array([len(x) for x in content])
    data = np.frombuffer(b"".join(content), np.uint8)
    windows = sizes - length + 1
    base = np.cumsum(sizes) - sizes
    inside = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    at = np.repeat(base, windows) + inside
    owner = np.repeat(np.arange(len(sizes)), windows)
    # windows whose hash is alone have no equal
    hashes = mix(span_hash(prefix_hash(data), at, at + length) + anchor[owner].view(np.uint64) * _U(0x9E3779B97F4A7C15))
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    same = h[1:] == h[:-1]
    keep = np.sort(order[np.r_[False, same] | np.r_[same, False]])
    if not len(keep):
        return pa.record_batch([pa.array([], pa.int64())] * 4, [*DOC, "low", "high"])
    at, owner, inside = at[keep], owner[keep], inside[keep]
    symbols = _numbered(data, at, anchor[owner], length)
    joined = np.r_[False, (owner[1:] == owner[:-1]) & (inside[1:] == inside[:-1] + 1)]
    first, size = [], []
    when = np.empty(len(at), np.int64)
    begin = start[owner] + inside
    order = np.lexsort((begin, alt[owner], doc[owner]))
    when[order] = np.cumsum(_changes([doc[owner][order], alt[owner][order], begin[order]]))
    for found, m in repeat_groups(symbols, joined):
        later = found[when[found] != when[found].min()]
        first.append(later)
        size.append(np.full(len(later), m - 1 + length))
    first = np.concatenate([*first, np.zeros(0, np.int64)])
    size = np.concatenate([*size, np.zeros(0, np.int64)])
    return _covered(doc[owner[first]], alt[owner[first]], begin[first], begin[first] + size)


def _numbered(data: np.ndarray, at: np.ndarray, anchor: np.ndarray, length: int) -> np.ndarray:
    """A number for each window data[at : at + length]; equal ones, compared byte by byte, of one anchor have the same."""
    view = np.lib.stride_tricks.sliding_window_view(np.r_[data, np.zeros(8, np.uint8)], 8)

    def word(j: int) -> np.ndarray:
        return np.ascontiguousarray(view[at + j]).view(np.uint64).reshape(-1)

    places = list(range(0, length - 7, 8)) + ([max(0, length - 8)] if length % 8 else [])
    words = [word(j) if length >= 8 else word(0) & _U((1 << 8 * length) - 1) for j in places]
    order = np.lexsort((*words, anchor))
    out = np.empty(len(at), np.int64)
    out[order] = np.cumsum(_changes([v[order] for v in (anchor, *words)]))
    return out


def repeat_groups(symbols: np.ndarray, joined: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(places, size) of the maximal repeats in runs of symbols: all starts of ``size`` symbols that no common extension lengthens.

    ``joined`` marks the symbols that continue the run of the one before; a
    repeat lies in runs. The suffix array holds only the suffixes whose first
    symbol follows different ones: no others start a repeat whose left
    extensions differ.
    """
    n = len(symbols)
    left = np.where(joined, np.r_[0, symbols[:-1]], -1 - np.arange(n))
    order = np.argsort(symbols, kind="stable")
    head = np.flatnonzero(_changes([symbols[order]]))
    one = np.minimum.reduceat(left[order], head) == np.maximum.reduceat(left[order], head)
    diverse = np.empty(n, bool)
    diverse[order] = np.repeat(~one, np.diff(np.r_[head, n]))
    starts = np.flatnonzero(diverse)
    if not len(starts):
        return
    edge = np.flatnonzero(~joined)
    rest = np.repeat(np.r_[edge[1:], n], np.diff(np.r_[edge, n])) - np.arange(n)  # symbols to the end of the run
    levels, step = [np.unique(symbols, return_inverse=True)[1]], 1
    while step < rest.max():
        rank = levels[-1]
        second = np.zeros(n, np.int64)
        more = rest > step
        second[more] = rank[np.flatnonzero(more) + step] + 1
        levels.append(np.unique(rank * (n + 1) + second, return_inverse=True)[1])
        step *= 2
    order = starts[np.argsort(levels[-1][starts], kind="stable")]
    a, b, common = order[:-1], order[1:], np.zeros(len(order) - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        room = np.minimum(rest[a], rest[b]) - common >= 1 << k
        i, j = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
        common += np.where(room & (levels[k][i] == levels[k][j]), 1 << k, 0)
    for size, low, high in common_prefix_intervals(order, [0, *common.tolist()], left[order].tolist(), 1):
        yield order[low : high + 1], size


def _covered(doc: np.ndarray, alt: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    """The ranges [low, high) of documents, those that overlap or touch as one."""
    order = np.lexsort((low, alt, doc))
    d, z, a, b = doc[order], alt[order], low[order], high[order]
    fresh = _changes([d, z])
    # each document's ranges are moved beyond those of the one before it
    shift = np.cumsum(fresh) * (int(b.max(initial=0)) + 1)
    reach = np.maximum.accumulate(b + shift)
    fresh[1:] |= (a + shift)[1:] > reach[:-1]
    head = np.flatnonzero(fresh)
    tail = np.r_[head[1:], len(d)][: len(head)] - 1
    return pa.record_batch([pa.array(x) for x in (d[head], z[head], a[head], (reach - shift)[tail])], [*DOC, "low", "high"])


def _pieces(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if size + batch["bytes"].nbytes > BLOCK_BYTES and size:
                last = held[-1]["anchor"][-1].as_py()
                anchors = batch["anchor"].to_numpy()
                cut = int((anchors == last).argmin()) if (anchors != last).any() else len(anchors)
                if cut:
                    held.append(batch.slice(0, cut))
                if cut < len(anchors):
                    yield _piece(held, length)
                    held, size = [], 0
                    batch = batch.slice(cut)
                else:
                    continue
            held.append(batch)
            size += batch["bytes"].nbytes
        if held:
            yield _piece(held, length)

    return run


def _window_runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, alt, low = (batch[c].to_numpy() for c in (*DOC, "start"))
            yield _covered(doc, alt, low, low + length)

    return run


def _merge(ranges: np.ndarray, size: int) -> np.ndarray:
    """Maximal covered runs of [low, high) ranges within size."""
    if not len(ranges):
        return np.zeros((0, 2), np.int64)
    ranges = ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))]
    reach = np.maximum.accumulate(ranges[:, 1])
    head = np.flatnonzero(np.r_[True, ranges[1:, 0] > reach[:-1]])
    out = np.stack([ranges[head, 0], reach[np.r_[head[1:] - 1, len(ranges) - 1]]], 1)
    return np.clip(out, 0, size)


def _later_windows(dealt: DataFrame, total: int) -> DataFrame:
    """(doc, alt, start) of the dealt-out windows that also start earlier; hot windows are looked up in a bounded broadcast table."""
    key = ["window", "second"]
    bound = max(HOT, total // HOT_SHARE)
    first = written(dealt.groupBy(*key).agg(F.min(F.struct(*DOC, "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    hot = F.broadcast(first.where(F.col("n") > bound).select(*key, F.col("first").alias("hot")))
    marked = dealt.join(hot, key, "left")
    usual = marked.where("hot IS NULL").join(first.where(F.col("n") <= bound), key)
    both = usual.select(*DOC, "start", "first").unionAll(marked.where("hot IS NOT NULL").select(*DOC, "start", F.col("hot").alias("first")))
    return both.where(F.struct(*DOC, "start") != F.col("first")).select(*DOC, "start")


def _ranged(keyed: DataFrame, length: int) -> DataFrame:
    """keyed (doc, alt, text and others) with ``ranges``."""
    slim = keyed.select(*DOC, "text")
    total = slim.count()
    sampled = min(total, SAMPLE)
    part = slim if total <= SAMPLE else slim.sample(SAMPLE / total, 11)
    often = part.mapInArrow(_anchors(length), "anchor long").groupBy("anchor").count().where(F.col("count") >= max(20, PIECE * sampled / max(1, total)))
    # at most a twentieth of the sample's spans, whatever the corpus; these only choose how rows are dealt
    frequent = np.array(sorted(r[0] for r in often.select("anchor").collect()), np.int64)

    spans = slim.mapInArrow(_emit(length, frequent), "anchor long, span long, second long, doc long, alt long, start long, deal int")
    # settled spans meet nothing any more: they go anywhere
    key = F.when(F.col("deal") == 2, F.xxhash64("doc", "start")).when(F.col("deal") == 1, F.col("span")).otherwise(F.col("anchor"))
    ordered = spans.repartition(key).sortWithinPartitions("anchor", "span", "second", *DOC, "start")
    flagged = written(ordered.mapInArrow(_settle(frequent), _SETTLED))

    def found(kind: int) -> DataFrame:
        listed = flagged.where(F.col("kind") == kind).groupBy(*DOC).agg(F.collect_list(F.struct("anchor", "start", "windows")).alias("spans"))
        # with all columns, so that the texts are dealt out once for this and for the last join; equal rows are one document
        return keyed.join(listed, DOC).select(*DOC, "text", "spans").dropDuplicates(DOC)

    ranges = flagged.where(F.col("kind") == GONE).select(*DOC, F.col("start").alias("low"), (F.col("start") + F.col("windows") + (length - 1)).alias("high"))
    pieces = found(PIECED).mapInArrow(_contexts(length), "anchor long, doc long, alt long, start long, bytes binary")
    ranges = ranges.unionAll(pieces.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_pieces(length), _RANGES))
    many = flagged.where(F.col("kind") == DEALT).agg(F.sum("windows")).first()[0]
    if many:
        dealt = found(DEALT).mapInArrow(_windows(length), "doc long, alt long, start long, window long, second long")
        ranges = ranges.unionAll(_later_windows(dealt, many).mapInArrow(_window_runs(length), _RANGES))
    listed = ranges.groupBy(*DOC).agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    return keyed.join(listed, DOC, "left")


def repeated_ranges(docs: DataFrame, length: int = 100) -> DataFrame:
    """The rows of docs with a column ``ranges``: byte ranges (low, high) that cover each ``length``-byte string of the text that also starts earlier.

    Earlier is a smaller doc_id, or the same and a smaller start. Judged on the
    texts as given; matches don't cross documents. Ranges may overlap; null
    stands for none.

    Nulls: a null text is empty and has no ranges; null ids sort after all
    others. Rows of one id, or of none, with different texts are different
    documents, in the order of a hash of their texts; rows of equal id and text
    are the same document, so neither repeats the other. Texts under ``length``
    bytes have no ranges. Other columns are carried along, whatever their
    names, but for one named ``ranges``, which is replaced. An empty table
    gives an empty one.
    """
    prepare(docs.sparkSession)
    # by place, so that no column's name clashes with those added on the way
    names = [c for c in docs.columns if c != "ranges"]
    place = {c: c if c == "text" else f"_{i}" for i, c in enumerate(names)}
    rows = docs.select(*(F.col(f"`{c}`").cast("string").alias(p) if c == "text" else F.col(f"`{c}`").alias(p) for c, p in place.items()))
    keyed = rows.withColumns({"doc": F.coalesce(F.col(place["doc_id"]).cast("long"), F.lit(NULL_ID)), "alt": F.xxhash64("text")})
    return _ranged(keyed, length).select(*(F.col(p).alias(c) for c, p in place.items()), "ranges")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for text, ranges in zip(batch["text"].to_pylist(), _lists(batch["ranges"], "low", "high"), strict=True):
            raw = (text or "").encode()
            runs = _merge(ranges, len(raw))
            left, end = hashlib.sha256(), 0
            for low, high in runs.tolist():
                left.update(raw[end:low])
                end = high
            left.update(raw[end:])
            for x, v in zip(out, (len(raw), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), left.hexdigest()), strict=True):
                x.append(v)
        yield pa.record_batch([batch["doc_id"], *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removal_digest(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): what removing the repeated ranges leaves of each row. See repeated_ranges."""
    rows = repeated_ranges(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), length)
    return rows.select("doc_id", "text", "ranges").mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _without(texts: list[str | None], ranges: Iterator[np.ndarray]) -> list[str | None]:
    out: list[str | None] = []
    for text, found in zip(texts, ranges, strict=True):
        if text is None or not len(found):
            out.append(text)
            continue
        raw = text.encode()
        left, end = [], 0
        for low, high in _merge(found, len(raw)).tolist():
            while low < len(raw) and raw[low] & 0xC0 == 0x80:  # a character goes only as a whole
                low += 1
            while high < len(raw) and raw[high] & 0xC0 == 0x80:
                high -= 1
            if low < high:
                left.append(raw[end:low])
                end = high
        left.append(raw[end:])
        out.append(b"".join(left).decode())
    return out


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """docs without the repeated ranges of their texts, whole characters only; rows of which nothing but white space is left go.

    Rows whose text was null, or white space from the start, stay. n_chars,
    where docs has it, follows the new text. See repeated_ranges for ties,
    nulls and repeated rows.
    """
    place = {c: c if c in ("doc_id", "text") else f"_{i}" for i, c in enumerate(docs.columns)}
    rows = repeated_ranges(docs.select(*(F.col(f"`{c}`").alias(p) for c, p in place.items())), length)
    rows = rows.select(*place.values(), "ranges")
    schema = rows.drop("ranges").withColumn("_left", F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = _without(batch["text"].to_pylist(), _lists(batch["ranges"], "low", "high"))
            yield batch.drop_columns(["ranges"]).append_column("_left", pa.array(new, pa.string()))

    kept = rows.mapInArrow(run, schema)
    kept = kept.where(F.col("text").isNull() | (F.col("text") == F.col("_left")) | ~F.col("_left").rlike(r"^[\s]*$"))
    changed = {"text": F.col("_left")}
    if "n_chars" in place:
        same = F.col("text").isNull() | (F.col("text") == F.col("_left"))
        changed["n_chars"] = F.when(same, F.col(place["n_chars"])).otherwise(F.length("_left").cast(docs.schema["n_chars"].dataType))
    return kept.select(*(changed.get(c, F.col(p)).alias(c) for c, p in place.items()))
