"""URL filter: host and path rules, and gradient-boosted trees for the rest.

The trees see lexical features only: lengths, depth, digit ratio, entropy,
parameters, and how often URLs of a host's suffix are blocked. They learn from
labelled URLs: those that the rules decide, where no others are given.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stratapage.llm.common import prepare

#: (verdict, host, path) rules.
Rule = tuple[str, str, str]
#: Labelled URLs that the trees are fitted on at most, and the bins of a feature.
TRAIN_ROWS, BINS = 20_000, 32
TREES, DEPTH, RATE, LEAF = 60, 4, 0.2, 10
_U = np.uint64


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased and path of a URL; both empty where it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as host + path, null if none fits."""
    found = F.lit(None).cast("string")
    for _, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tried first
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.lit(h + p)).otherwise(found)
    return found


def features(host: Column, path: Column, url: Column) -> dict[str, Column]:
    """Lexical features of a URL."""
    def count(c: Column, pattern: str) -> Column:
        return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))

    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    letters = F.split(url, "")
    n = F.greatest(F.length(url), F.lit(1))
    # entropy of the URL's characters in bits: log n - sum(c log c) / n
    counts = F.transform(F.array_distinct(letters), lambda x: F.size(F.filter(letters, lambda y: y == x)))
    entropy = F.log2(n.cast("double")) - F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * F.log2(c.cast("double"))) / n
    return {
        "length": F.length(url),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": count(path, "/"),
        "labels": count(host, r"\.") + 1,
        "digit_ratio": count(url, "[0-9]") / n,
        "host_digits": count(host, "[0-9]"),
        "hyphens": count(host, "-"),
        "entropy": entropy,
        "parameters": F.when(F.length(query) > 0, count(query, "&") + 1).otherwise(0),
        "query_length": F.length(query),
        "fragment": F.instr(url, "#").cast("boolean").cast("int"),
        "secure": F.startswith(url, F.lit("https://")).cast("int"),
        "www": F.startswith(host, F.lit("www.")).cast("int"),
        "escaped": count(url, "%"),
        "extension": F.length(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)),
    }


def suffix(host: Column) -> Column:
    """The last label of a host."""
    return F.element_at(F.split(host, r"\."), -1)


class Trees:
    """Boosted regression trees on binned features, for the logistic loss."""

    def __init__(self, rate: float = RATE) -> None:
        self.rate, self.base = rate, 0.0
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature, bin, value by node; children of i are 2i+1 and 2i+2

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1) if len(self.edges) else np.zeros(x.shape, int)

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(share / (1 - share)))
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        if not len(y) or y.min() == y.max():
            return self
        b, z = self.bins(x), np.full(len(y), self.base)
        n, m, nodes = len(y), x.shape[1], 2 ** (depth + 1) - 1
        for _ in range(trees):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            feature, cut, value = np.full(nodes, -1), np.zeros(nodes, int), np.zeros(nodes)
            at = np.zeros(n, int)
            for level in range(depth + 1):
                first, count = 2**level - 1, 2**level
                own = at - first
                live = (own >= 0) & (own < count)
                sums = [np.bincount(own[live], w[live], count) for w in (g, h)]
                value[first : first + count] = sums[0] / (sums[1] + 1.0)
                if level == depth:
                    break
                best = np.full(count, 1e-6)
                for j in range(m):
                    key = own[live] * BINS + b[live, j]
                    gl, hl, cl = (np.cumsum(np.bincount(key, w, count * BINS).reshape(count, BINS), 1) for w in (g[live], h[live], np.ones(live.sum())))
                    gr, hr, cr = gl[:, -1:] - gl, hl[:, -1:] - hl, cl[:, -1:] - cl
                    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - gl[:, -1:] ** 2 / (hl[:, -1:] + 1)
                    gain[(cl < LEAF) | (cr < LEAF)] = -1
                    top = gain.argmax(1)
                    won = gain[np.arange(count), top] > best
                    best[won] = gain[np.arange(count), top][won]
                    feature[first : first + count][won] = j
                    cut[first : first + count][won] = top[won]
                split = live & (feature[at] >= 0)
                at = np.where(split, 2 * at + 1 + (b[np.arange(n), np.maximum(feature[at], 0)] > cut[at]), at)
            z += self.rate * value[at]
            self.trees.append((feature, cut, value))
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Chances of the positive class."""
        b, z = self.bins(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(int(np.log2(len(feature) + 1)) - 1):
                f = feature[at]
                at = np.where(f >= 0, 2 * at + 1 + (b[rows, np.maximum(f, 0)] > cut[at]), at)
            z += self.rate * value[at]
        return 1 / (1 + np.exp(-z))


class Model:
    """Fitted trees, with the statistics of host suffixes that they read."""

    def __init__(self, names: list[str], trees: Trees | None, rates: dict[str, tuple[float, float]], usual: float) -> None:
        self.names, self.trees, self.rates, self.usual = names, trees, rates, usual

    def __call__(self, columns: list[np.ndarray], suffixes: list[str]) -> np.ndarray:
        """Chances of ``block`` from the lexical features' columns and the suffixes."""
        if self.trees is None:
            return np.zeros(len(suffixes))
        extra = np.array([self.rates.get(s, (self.usual, 0.0)) for s in suffixes], float).reshape(-1, 2)
        return self.trees(np.concatenate([np.stack(columns, 1).reshape(len(suffixes), -1), extra], 1))


def _described(urls: DataFrame) -> tuple[DataFrame, list[str]]:
    """urls (url and others) with host, path, suffix and lexical features, and the features' columns."""
    host, path = host_and_path(F.col("url"))
    parsed = urls.withColumns({"host": host, "path": path})
    lexical = {f"x_{k}": v.cast("double") for k, v in features(F.col("host"), F.col("path"), F.coalesce(F.col("url"), F.lit(""))).items()}
    return parsed.withColumns(lexical).withColumn("suffix", suffix(F.col("host"))), list(lexical)


def fit(labelled: DataFrame) -> Model:
    """Trees fitted on labelled (url, block), of which TRAIN_ROWS different URLs at most, those of smallest hash.

    Null URLs and labels don't count; a URL with both labels is blocked. No
    rows give a model that blocks nothing, rows of one kind one that follows it.
    """
    slim = labelled.select(labelled["url"].cast("string").alias("url"), labelled["block"].cast("int").alias("y")).where("url IS NOT NULL AND y IS NOT NULL")
    full, names = _described(slim)
    # the sample's cut on the hash, from the count; equal URLs share a hash and count once
    n = slim.agg(F.approx_count_distinct("url")).first()[0]
    part = min(1.0, 0.9 * TRAIN_ROWS / max(1, n))
    picked = full.where(F.shiftrightunsigned(F.xxhash64("url"), 1) / F.lit(float(2**63)) <= part)
    rows = picked.groupBy("url").agg(*(F.first(c).alias(c) for c in (*names, "suffix")), F.max("y").alias("y")).drop("url").collect()
    rows.sort()
    x = np.array([[r[c] for c in names] for r in rows], float).reshape(-1, len(names))
    y = np.array([r["y"] for r in rows], float)
    # suffix statistics: each suffix's share of blocked URLs in the sample, drawn to the whole sample's
    mean = y.mean() if len(y) else 0.0
    sums: dict[str, list[float]] = {}
    for r in rows:
        own = sums.setdefault(r["suffix"], [0.0, 0.0])
        own[0] += r["y"]
        own[1] += 1
    rates = {k: ((a + 5 * mean) / (c + 5), float(np.log1p(c))) for k, (a, c) in sums.items()}
    known = np.array([rates[r["suffix"]] for r in rows], float).reshape(-1, 2)
    return Model(names, Trees().fit(np.concatenate([x, known], 1), y) if len(y) else None, rates, mean)


def judge(pages: DataFrame, rules: Sequence[Rule], labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) for each row of pages.

    The longest fitting rule decides; a rule fits its host and all subdomains
    where the path starts with the rule's. Other URLs are blocked where the
    trees give a chance of 0.5 or more. These are fitted (see ``fit``) on
    labelled (url, block) where given, else on the URLs that rules decide.

    Nulls: a null URL, or one without ``://``, has an empty host and path and
    no rule; null page_ids stay null. Without labelled URLs, or with one kind
    only, the rest get that kind's verdict (allow where there are none).
    Repeated rows are judged alike, and count once in the fit; of rules of
    equal length the later wins. Other columns are ignored; an empty table
    gives an empty one.
    """
    prepare(pages.sparkSession)
    slim = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"))
    full, names = _described(slim)
    verdicts = {h + p: v for v, h, p in rules}
    full = full.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for r, v in verdicts.items():
        by_rule = F.when(F.col("rule") == r, F.lit(v)).otherwise(by_rule)
    full = full.withColumn("by_rule", by_rule)
    if labelled is None:
        labelled = full.where("by_rule IS NOT NULL").select("url", (F.col("by_rule") == "block").alias("block"))
    shared = pages.sparkSession.sparkContext.broadcast(fit(labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value([batch[c].to_numpy(zero_copy_only=False) for c in names], batch["suffix"].to_pylist())
            yield pa.record_batch([batch[c] for c in ("page_id", "host", "path", "rule", "by_rule")] + [pa.array(score, pa.float64())], ["page_id", "host", "path", "rule", "by_rule", "block_score"])

    scored = full.select("page_id", "host", "path", "rule", "by_rule", "suffix", *names).mapInArrow(run, "page_id long, host string, path string, rule string, by_rule string, block_score double")
    verdict = F.coalesce("by_rule", F.when(F.col("block_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")
