"""Near-duplicate documents by HyperMinHash sketches.

A document's shingle hashes are dealt to registers; each register keeps the
smallest hash as a leading-zero count and some mantissa bits, 16 bits in all.
Bands of whole registers bring documents together; the share of equal
registers, less the expected collisions, estimates the Jaccard similarity of a
pair; pairs that can't rule out the threshold are confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratapage.llm.common import NULL_ID, discard, prepare, real_id, texts, written
from stratapage.llm.components import components
from stratapage.llm.kernels import shingle_sets

ROWS, BANDS = 6, 48
REGISTERS = ROWS * BANDS
MANTISSA = 10
#: Standard errors by which an estimate may fall short of the threshold before a pair is given up.
SIGMAS = 6.0
#: Hubs that each document is tested against first.
HUBS = 2
#: A shingle of more sets than this, and than one in HOT_SHARE of all shingles, is hot: there are HOT_SHARE hot ones at most.
HOT, HOT_SHARE = 1024, 4096

_fill = np.argsort(np.random.default_rng(7).random((REGISTERS, REGISTERS)), axis=1)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a sorted set of 64-bit hashes: leading zeros and mantissa of each register's minimum.

    An empty register takes the value of the first filled one in its own fixed
    random order, so that every register of a set that isn't empty is a
    minimum-wise sample.
    """
    registers = np.zeros(REGISTERS, np.uint16)
    if not len(hashes):
        return registers
    high = (hashes >> np.uint64(32)) * np.uint64(REGISTERS)
    slot = (high >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    rest = (high[first] << np.uint64(32)) | (hashes[first] & np.uint64(0xFFFFFFFF))
    zeros = 53 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1]
    mantissa = (rest << np.minimum(zeros + 1, 63).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    registers[slot[first]] = ((zeros + 1) << MANTISSA) | mantissa.astype(np.int64)
    empty = np.flatnonzero(registers == 0)
    if len(empty):
        order = _fill[empty]
        registers[empty] = registers[order[np.arange(len(empty)), (registers[order] != 0).argmax(1)]]
    return registers


def _collisions() -> np.ndarray:
    """Chance that two different minima share a register, by powers of two of the two loads."""
    lo = np.concatenate([[0.0], 2.0 ** np.arange(-53, 0.0)])
    cuts = np.concatenate([a + (2 * a - a if a else 2.0**-53) * np.arange(2**MANTISSA) / 2**MANTISSA for a in lo] + [[1.0]])
    loads = 2.0 ** np.arange(0, 28)
    share = [-np.diff(np.exp(n * np.log1p(-np.minimum(cuts, 1 - 1e-16)))) for n in loads]
    return np.array([[float(a @ b) for b in share] for a in share])


_collision_table = _collisions()


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of pairs of sketches (one row each), corrected for chance collisions."""
    equal = (a == b).mean(1)
    at = [np.clip(np.round(np.log2(np.maximum(n, 1) / REGISTERS)), 0, 27).astype(int) for n in (n_a, n_b)]
    chance = _collision_table[at[0], at[1]]
    return np.clip((equal - chance) / (1 - chance), 0, 1)


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sketches = [], [], []
            for hashes in shingle_sets(batch["text"], k):
                sizes.append(len(hashes))
                digests.append(_digest(hashes))
                sketches.append(sketch(hashes).tobytes())
            if sizes:
                yield pa.record_batch([batch["doc_id"], batch["text_hash"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "text_hash", "n", "digest", "sketch"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        r = np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = (r[:, :, 0] << np.uint64(48)) | (r[:, :, 1] << np.uint64(32)) | (r[:, :, 2] << np.uint64(16)) | r[:, :, 3]
        for i in range(4, ROWS):
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + r[:, :, i]
        key = key * np.uint64(64) + np.arange(BANDS, dtype=np.uint64)  # the band's number is part of the key
        yield pa.record_batch([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(batch["node"].to_numpy(zero_copy_only=False), BANDS))], ["key", "node"])


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # of texts that share an id and a hash, the one that the class stands for
            own = [s.tobytes() if _digest(s) == d.as_py() else None for s, d in zip(shingle_sets(batch["text"], k), batch["digest"], strict=True)]
            yield pa.record_batch([batch["node"], pa.array(own, pa.binary())], ["node", "hashes"])

    return run


def _plausible(percent: int):
    cut = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sketch_a", "sketch_b"))
            n_a, n_b = batch["n_a"].to_numpy(), batch["n_b"].to_numpy()
            spread = np.sqrt(cut * (1 - cut) / np.minimum(REGISTERS, np.maximum(1, np.minimum(n_a, n_b))))
            keep = estimate(a, b, n_a, n_b) >= cut - SIGMAS * spread
            yield pa.record_batch([batch[c].filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["hashes_a"], batch["hashes_b"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch[c].filter(keep) for c in ("a", "b")], ["a", "b"])

    return run


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.array([len(x.as_buffer()) // 8 for x in batch["hashes"]], np.int64)
        flat = np.frombuffer(b"".join(batch["hashes"].to_pylist()), np.int64)
        yield pa.record_batch([pa.array(np.repeat(batch["node"].to_numpy(), sizes)), pa.array(flat)], ["node", "shingle"])


def _frequencies(rows: DataFrame, total: int) -> DataFrame:
    """rows (node, shingle) with df, the sets that have the shingle; shingles of one set alone are left out.

    Hot shingles, HOT_SHARE at most by their definition, are looked up in a
    broadcast table, so that no join has more rows of a key than the bound.
    """
    bound = max(HOT, total // HOT_SHARE)
    common = written(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    hot = F.broadcast(common.where(F.col("df") > bound).withColumnRenamed("df", "hot_df"))
    marked = rows.join(hot, "shingle", "left")
    usual = marked.where("hot_df IS NULL").drop("hot_df").join(common.where(F.col("df") <= bound), "shingle")
    return usual.select("node", "shingle", "df").unionAll(marked.where("hot_df IS NOT NULL").select("node", "shingle", F.col("hot_df").alias("df")))


def _rare_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components among nodes (node, component, n) that may reach the threshold.

    With the shingles of each set in order from the rarest on, a pair that
    reaches it has a first common shingle, after which both sets have as many
    left as the pair must share. Shingles of one set alone stand first and join
    nothing: a set with too many of them has no partner. Only documents outside
    a shingle's commonest component are joined with the others.
    """
    rows = sets.join(nodes, "node", "left_semi").mapInArrow(_explode, "node long, shingle long")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    listed = _frequencies(rows, total).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "shingle")))["shingle"].alias("s"))
    listed = listed.join(nodes, "node")
    # a partner may be smaller, down to percent of n: then the pair must share that many
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("s"))
    cut = listed.withColumn("length", length.cast("int")).where("length > 0")
    first = cut.select("node", "component", "n", (F.col("n") - F.size("s")).alias("alone"), F.posexplode(F.slice("s", F.lit(1), F.col("length"))).alias("at", "shingle"))
    first = written(first.select("shingle", "node", "component", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("left")))
    sizes = first.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("shingle").agg(F.max(F.struct("c", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("c").alias("rows"))
    sizes = written(sizes.where("parts > 1").select("shingle", "main", F.ceil(F.col("rows") / HOT).cast("int").alias("salts"), "rows"))
    # hot shingles, HOT_SHARE at most, are looked up, and their rows dealt out by HOT
    bound = max(HOT, first.count() // HOT_SHARE)
    hot = F.broadcast(sizes.where(F.col("rows") > bound).select("shingle", F.struct("main", "salts").alias("of")))
    marked = first.join(hot, "shingle", "left")
    usual = marked.where("of IS NULL").drop("of").join(sizes.where(F.col("rows") <= bound).drop("rows"), "shingle")
    mixed = usual.unionByName(marked.where("of IS NOT NULL").select("shingle", "node", "component", "n", "left", "of.main", "of.salts"))
    x = mixed.where("component != main").select("shingle", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.col("node").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("left").alias("lx"))
    y = mixed.select("shingle", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("node").alias("y"), F.col("component").alias("cy"), F.col("n").alias("ny"), F.col("left").alias("ly"), "main")
    met = (F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("main")) | (F.col("cx") < F.col("cy")))
    met &= (100 + percent) * F.least("lx", "ly") >= percent * (F.col("nx") + F.col("ny"))
    found = written(x.join(y, (x["shingle"] == y["shingle"]) & (x["salt"] == y["salt"]) & met).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    discard(first, sizes)
    return found


def _same_ids(filled: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) of the classes of an id that comes with several texts; null ids are documents of their own."""
    several = filled.where(F.col("doc_id") != NULL_ID).groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low != high")
    own = filled.join(several, "doc_id", "left_semi").select("doc_id", "digest").distinct().join(classes.select("digest", "node"), "digest").select("doc_id", "node")
    low = own.groupBy("doc_id").agg(F.min("node").alias("a"))
    return own.join(low, "doc_id").where("a != node").select("a", F.col("node").alias("b"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of (doc_id, text).

    Documents whose k-word shingle sets have ``100 * |A & B| >= percent * |A | B|``
    are linked; component_id is the smallest id reachable, kept marks it.

    Equal sets are one class and meet first, by digest. Classes that share a
    band are tested against a few hubs of theirs; a band whose classes are then
    in one component is done. Documents of the bands that this leaves undone
    meet by their rarest shingles, an exact filter, and only across components:
    no link between components is left untried, and no group of copies is
    expanded into all its pairs. A pair at the threshold exactly escapes all
    bands with a probability below 1e-6, a closer one with far less.

    Nulls: a null text is empty, an empty text has no shingles and links to
    nothing. Rows with a null id are documents of their own: they take part but
    have a null component_id and are kept. Rows that share an id are one
    document, which links wherever one of its texts does. Other columns are
    ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    docs = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    rows = written(docs.select("doc_id", "text_hash", "text").mapInArrow(_describe(k), "doc_id long, text_hash long, n long, digest binary, sketch binary"))
    filled = rows.where("n > 0")
    # a row for each class, and the text that stands for it; numbered once, as written
    own = filled.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("own"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = written(own.select(F.monotonically_increasing_id().alias("node"), "digest", "own.doc_id", "own.text_hash", "n", "sketch"))

    bands = classes.select("node", "sketch").mapInArrow(_bands, "key long, node long")
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = written(bands.join(shared, "key"))
    degrees = written(members.groupBy("node").agg(F.sum("members").alias("degree")))
    met = classes.join(degrees, "node", "left_semi")
    wanted = docs.join(met.select("node", "digest", "doc_id", "text_hash"), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash", "node"])
    sets = written(wanted.select("node", "digest", "text").mapInArrow(_sets(k), "node long, hashes binary").where("hashes IS NOT NULL"))
    sketches = met.select("node", "n", "sketch")

    def linked(pairs: DataFrame) -> DataFrame:
        a, b = (sketches.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
        sized = pairs.join(a, "a").join(b, "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        likely = sized.mapInArrow(_plausible(percent), "a long, b long")
        a, b = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"hashes_{c}")) for c in "ab")
        return likely.join(a, "a").join(b, "b").mapInArrow(_confirm(percent), "a long, b long")

    # hubs: of each band's documents the one that meets most others; each document is tested against those it meets most often
    ranked = members.select("key", "node").join(degrees, "node")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("degree", "node"))["node"].alias("hub"))
    near = members.select("key", "node").join(hubs, "key").where("node != hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("times"))
    near = near.groupBy("node").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("times", "hub")))), 1, HUBS).alias("hubs"))
    pairs = written(near.select("node", F.explode("hubs").alias("h")).select(F.least("node", "h.hub").alias("a"), F.greatest("node", "h.hub").alias("b")).distinct())
    links = written(linked(pairs).unionAll(_same_ids(filled, classes)))
    found = components(links)
    discard(pairs, links)

    # bands whose documents aren't in one component yet: their documents meet again, on their rarest shingles
    placed = members.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    undone = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key")
    left = written(placed.join(undone, "key").select("node", "component").distinct().join(met.select("node", "n"), "node"))
    rest = _rare_pairs(left, sets, percent)
    late = written(linked(rest))
    if not late.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(late))

    # the smallest id of each component; ids of a class that nothing links are its own
    placed = classes.select("node", "digest", "doc_id").join(found, "node", "left").select("digest", "doc_id", F.coalesce("component", "node").alias("component"))
    lowest = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = written(placed.join(lowest, "component").select("digest", "component_id"))
    discard(members, degrees, sets, left, rest, late, classes, found)
    out = rows.select("doc_id", "n", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id") != NULL_ID, component)
    return out.select(
        real_id(), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def drop_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows that near_duplicates doesn't keep: of each group the document of smallest id stays.

    Rows that share the kept id are one document and stay; null ids stay.
    """
    gone = near_duplicates(docs, k, percent).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
