"""Toxicity by weak supervision.

Many voters, lexicons and patterns, each mark some texts. A generative label
model estimates how often each voter marks toxic and clean texts and how far
voters agree beyond that; its posterior labels train a linear classifier on
words and word beginnings, which scores whole texts. Given labels are one of
the voters; how far they can be relied on is estimated as for the others. What
is to be chosen, the classifier's decay, is chosen by folds of the training rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratapage.llm.common import prepare, written
from stratapage.llm.decontaminate import BREAKS
from stratapage.llm.kernels import blocks, mix, prefix_hash, span_hash, word_spans

#: Labelled rows that the models are fitted on at most.
TRAIN_ROWS = 20_000
#: Bits of a feature's number, and features that the classifier may weigh.
BITS, FEATURES = 20, 4096
#: Lexicons that the found terms are dealt to.
LEXICONS = 24
#: Bytes of the training rows' features that go to the driver at most.
TRAIN_BYTES = 128 << 20
#: Chances of a toxic text that the model starts from, where the given label says clean and toxic.
LABELLED = (0.02, 0.9)
#: Decays of the classifier to choose from.
DECAYS = (5e-6, 2e-5, 1e-4)
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb fool pig vermin filth bastard bitch asshole fuck shit".split()
PATTERNS = ("shouting", "exclaiming", "symbols", "insults")


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words of a block (whole word, first 4 and 5 bytes of longer ones), and where each text's begin."""
    starts, ends, begin = word_spans(data, offsets, BREAKS)
    p = prefix_hash(_LOWER[data])
    out = np.empty((len(starts), 3), np.int64)
    out[:, 0] = mix(span_hash(p, starts, ends) + _U(11)) >> _U(64 - BITS)
    for i, n in ((1, 4), (2, 5)):
        out[:, i] = mix(span_hash(p, starts, np.minimum(starts + n, ends)) + _U(100 + n)) >> _U(64 - BITS)
    return out, begin


def _number(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(_features(data, np.array([0, len(data)]))[0][0, 0])


_insults = np.array(sorted(_number(w) for w in INSULTS))


def _patterns(data: np.ndarray, numbers: np.ndarray) -> list[bool]:
    """The pattern voters' marks on one text."""
    n = max(1, len(data))
    letters = int((((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122))).sum())
    capital = int(((data >= 65) & (data <= 90)).sum())
    symbols = int((BREAKS[data] & (data > 32) & ~np.isin(data, np.frombuffer(b".,;:-'\"()", np.uint8))).sum())
    return [letters >= 20 and capital > 0.5 * letters, bool((data == 33).sum() * 40 > n), symbols * 12 > n, bool(np.isin(numbers, _insults).any())]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, marks = [], []
        for first, last, data, offsets in blocks(batch["text"]):
            numbers, begin = _features(data, offsets)
            for i in range(last - first):
                own = np.unique(numbers[begin[i] : begin[i + 1]])
                found.append(own.astype("<u4").tobytes())
                marks.append(bytes(_patterns(data[offsets[i] : offsets[i + 1]], own)))
        yield pa.record_batch([batch["h"], batch["toxic"], pa.array(found, pa.binary()), pa.array(marks, pa.binary())], ["h", "toxic", "features", "marks"])


def label_model(votes: np.ndarray, prior: float, rounds: int = 400, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posteriors, rates, weights) of a votes matrix of marks, a row for each text.

    Expectation maximisation of a two-class model, started from the number of
    marks: rates[y, j] is the chance that voter j marks a text of class y.
    Voters that agree within the classes share their weight: each counts as one
    over one more than its summed correlations with the others. These are
    estimated anew as the posteriors settle: early ones follow the largest
    group of voters that copy each other. Labels, where given, are one more
    voter, the last, with rates and weight of its own; the posteriors start
    from them (LABELLED): they tell the model what the others miss, as where a
    language has words of its own and most voters are silent.
    """
    if labels is not None:
        votes = np.column_stack([votes, labels])
    n, m = votes.shape
    order = np.argsort(np.argsort(votes.sum(1), kind="stable"), kind="stable")
    q = np.where(order >= n * (1 - prior), 0.9, 0.05) if n else np.zeros(0)
    q = np.where(votes.any(1), q, 0.02)
    if labels is not None:
        q = np.where(labels == 1, LABELLED[1], LABELLED[0])
    weights = np.ones(m)
    rates = np.full((2, m), 0.5)
    for turn in range(rounds):
        for y, w in ((0, 1 - q), (1, q)):
            rates[y] = (w @ votes + (0.5 if y else 0.05)) / (w.sum() + 1)
        rates = np.clip(rates, 1e-4, 1 - 1e-4)
        if turn % 10 == 9:  # correlations beyond the classes, at the present posteriors
            mean = np.outer(1 - q, rates[0]) + np.outer(q, rates[1])
            rest = votes - mean
            deviation = np.sqrt((rest**2).mean(0)) + 1e-6
            correlation = (rest.T @ rest) / max(1, n) / np.outer(deviation, deviation)
            np.fill_diagonal(correlation, 0)
            weights = 1 / (1 + np.where(correlation > 0.05, correlation, 0).sum(1))
        odds = np.log(prior / (1 - prior)) + votes @ (weights * np.log(rates[1] / rates[0])) + (1 - votes) @ (weights * np.log((1 - rates[1]) / (1 - rates[0])))
        before, q = q, 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if turn % 10 == 9 and np.abs(q - before).max(initial=0.0) < 1e-7:
            break
    return q, rates, weights


def linear(rows: np.ndarray, columns: np.ndarray, target: np.ndarray, width: int, rounds: int = 300, rate: float = 0.1, decay: float = 2e-5) -> tuple[np.ndarray, float]:
    """Logistic regression of soft labels on a sparse matrix of marks (rows in order), by Adam."""
    w, bias = np.zeros(width), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    n = max(1, len(target))
    for t in range(1, rounds + 1):
        z = bias + np.bincount(rows, weights=w[columns], minlength=len(target))
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.r_[np.bincount(columns, weights=error[rows], minlength=width) / n + decay * w, error.mean()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, bias


def fit(sample: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, float]:
    """Weights by feature number and the bias, from (label, feature numbers, pattern marks) rows.

    The decay is the one whose models, each fitted on one half of the rows,
    give the other half's labels the largest likelihood.
    """
    halves = sample[::2], sample[1::2]
    # a half without both kinds can't judge
    if len(sample) < 40 or any(len({y for y, _, _ in half}) < 2 for half in halves):
        return _fit(sample, DECAYS[1:2])[0]
    losses = np.zeros(len(DECAYS))
    for own, other in (halves, halves[::-1]):
        y = np.array([y for y, _, _ in other], float)
        for i, (table, bias) in enumerate(_fit(own, DECAYS)):
            z = np.array([table[np.frombuffer(f, "<u4")].sum(dtype=float) for _, f, _ in other]) + bias
            losses[i] += (np.logaddexp(0, z) - y * z).sum()
    return _fit(sample, (DECAYS[int(losses.argmin())],))[0]


def _parts(lists: list[np.ndarray], size: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and feature numbers of the lists, some lists at a time: all at once would be many times their size."""
    for i in range(0, len(lists), size):
        part = lists[i : i + size]
        yield np.repeat(np.arange(i, i + len(part)), [len(x) for x in part]), np.concatenate(part).astype(np.int64)


def _sums(lists: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """Of each feature the weights of the rows that have it."""
    out = np.zeros(1 << BITS)
    for rows, numbers in _parts(lists):
        out += np.bincount(numbers, weights[rows], 1 << BITS)
    return out


def _chosen(lists: list[np.ndarray], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and numbers of the wanted features."""
    found = [(rows[keep], numbers[keep]) for rows, numbers in _parts(lists) for keep in [wanted[numbers]]]
    return tuple(np.concatenate([f[i] for f in found]) for i in (0, 1))


def _fit(sample: list[tuple[int, bytes, bytes]], decays: tuple[float, ...]) -> list[tuple[np.ndarray, float]]:
    """A model for each decay, on one label model's posteriors."""
    n = len(sample)
    labels = np.array([y for y, _, _ in sample], float)
    if not n or labels.min() == labels.max():
        return [(np.zeros(1 << BITS, np.float32), 4.0 if n and labels[0] else -4.0)] * len(decays)
    lists = [np.frombuffer(f, "<u4") for _, f, _ in sample]
    in_toxic, in_all = _sums(lists, labels), _sums(lists, np.ones(n))
    prior = labels.mean()
    # terms that stand out in toxic texts, from the surest on
    surplus = (in_toxic - prior * in_all) / np.sqrt(prior * (1 - prior) * in_all + 1)
    precise = (in_toxic + prior) / (in_all + 1)
    terms = np.flatnonzero((in_toxic >= 3) & (surplus > 4) & (precise > 0.75))
    terms = terms[np.argsort(-surplus[terms], kind="stable")]
    voter = np.full(1 << BITS, -1)
    voter[terms] = np.arange(len(terms)) % LEXICONS
    votes = np.zeros((n, LEXICONS + len(PATTERNS)))
    rows, numbers = _chosen(lists, voter >= 0)
    votes[rows, voter[numbers]] = 1
    votes[:, LEXICONS:] = np.array([list(m) for _, _, m in sample])
    posterior, _, _ = label_model(votes[:, votes.any(0)], float(np.clip(prior, 0.005, 0.995)), labels=labels)

    toxic = _sums(lists, posterior)
    share = posterior.mean()
    score = np.abs(toxic - share * in_all) / np.sqrt(share * (1 - share) * in_all + 1)
    chosen = np.argsort(-score, kind="stable")[:FEATURES]
    chosen = np.sort(chosen[score[chosen] > 3])
    wanted = np.zeros(1 << BITS, bool)
    wanted[chosen] = True
    rows, numbers = _chosen(lists, wanted)
    columns = np.searchsorted(chosen, numbers)
    out = []
    for decay in decays:
        w, bias = linear(rows, columns, posterior, len(chosen), decay=decay)
        table = np.zeros(1 << BITS, np.float32)
        table[chosen] = w
        out.append((table, bias))
    return out


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, bias = shared.value
            scores = np.zeros(batch.num_rows)
            for first, last, data, offsets in blocks(batch["text"]):
                numbers, begin = _features(data, offsets)
                word, kind = np.nonzero(table[numbers])
                own = np.searchsorted(begin, word, "right") - 1
                # texts without words share a start; the last of them is the one that has the word
                pair = np.unique(own * (1 << BITS) + numbers[word, kind])
                scores[first:last] = np.bincount(pair >> BITS, weights=table[pair & ((1 << BITS) - 1)], minlength=last - first)[: last - first]
            scores = 1 / (1 + np.exp(-np.clip(scores + bias, -30, 30)))
            yield pa.record_batch([batch["doc_id"], pa.array(scores)], ["doc_id", "score"])

    return run


def fold(name: str = "doc_id"):
    return F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(3))


def scores(docs: DataFrame, labels: DataFrame, cut: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs, scored by its whole text.

    Learns from labelled rows whose id's crc32 modulo 3 isn't 1, the TRAIN_ROWS
    of smallest hash at most, and of these the first with TRAIN_BYTES of
    features. A label that repeats counts once, the toxic one if they differ;
    null labels don't count. Of an id with several texts the one of smallest
    hash is learned from.

    Nulls: a null text is empty; an empty text gets the score of a text with no
    known feature. Null ids aren't learned from nor held out. With no labels,
    or only one kind, all get one score near that kind. Repeated rows are
    scored alike; other columns are ignored.
    """
    prepare(docs.sparkSession)
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(fold() != 1)
    n = known.count()
    # by a hash of the id, so that the sample is the same whatever the partitions
    picked = known.orderBy(F.xxhash64("doc_id")).limit(TRAIN_ROWS) if n > TRAIN_ROWS else known
    chosen = slim.join(picked, "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = written(chosen.select(F.xxhash64("doc_id").alias("h"), "toxic", "text").mapInArrow(_describe, "h long, toxic int, features binary, marks binary"))
    sizes = rows.select("h", F.octet_length("features").alias("n")).orderBy("h").collect()  # TRAIN_ROWS at most
    room = np.cumsum([r.n for r in sizes]) <= TRAIN_BYTES
    last = sizes[int(room.sum()) - 1].h if room.any() else -(2**63)
    sample = [s[1:] for s in sorted((r.h, r.toxic, bytes(r.features), bytes(r.marks)) for r in rows.where(F.col("h") <= last).toLocalIterator())]
    model = fit(sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = slim.mapInArrow(_score(shared), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
