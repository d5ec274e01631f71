"""Near-duplicate classes by ProbMinHash, banding and verification.

A text is the set of its 5-word shingles (letters and digits in lower case; a text of fewer words is one shingle), each with
the weight 1 however often it occurs. Texts with equal sets are one node from the start. A node's signature has ``SIZE``
components: every shingle sends arrivals of a Poisson process at its weight's rate, each to a random component, and stops
once its next arrival is later than every component's earliest one; two signatures agree in a component with their
probability Jaccard similarity, which for equal weights is the Jaccard similarity of the sets that links are defined by. So
the signature is one of the node, whichever of its texts it is taken from. ``BANDS`` bands of ``ROWS`` components give buckets; a pair of similarity 0.8 shares one with
a probability above 0.9999.

Within buckets no pairs are formed at first. Each bucket has its most central node (largest sum of its buckets' sizes) for a
leader, and a node is compared with the leader it shares most buckets with; then with a second and third one, if it is still
apart from them. Only nodes of a bucket that are in different components after that are then compared with each other, if at most ``DIFFERING`` of four bits of each component differ (over four standard
deviations above what 0.8 gives; a passage that many texts have in common does not pass). Compared pairs need ``LIKELY`` of the signature to agree (0.8 lies over four standard deviations above) and then an
exact Jaccard similarity of the shingle sets of at least ``SIMILARITY``. Components of the
verified links are the classes; a class is named by its smallest doc_id.

Null texts, and texts without a word, have no shingle and are classes of their own. Null doc_ids count as larger than
all others. Rows alike in doc_id and text are one document. An empty table gives an empty result; other columns are
ignored, or kept by ``keep_one``. Nodes are named by 64 bits of their set's hash, shingles compared by 32 bits: of 10^9
different texts about one pair in 36 runs would share a name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carefold.llm import common, substrings
from carefold.llm.words import ALNUM, Words, hash_groups, mix64, runs

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 6
#: Components of a signature; the bands take the first ones, all count for the estimate.
SIZE = 384
#: Least share of equal components for a pair to be verified.
LIKELY = 0.7
#: Of four bits of every component, so many components may differ: 72 are expected at 0.8, and 35 more are 4.5 deviations.
DIFFERING = 107
_WORDS = -(-SIZE // 16)
#: Bytes of text worked on at once: a slice takes some 25 times that in arrays, beside all that the executor holds by then.
_SLICE_BYTES = common.SLICE_BYTES // 4
_LOWEST = 0x1111111111111111
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text in ascending order: hash, times, row."""
    hashes = words.hashes()
    found, first = runs(words, hashes, SHINGLE)
    rows = words.doc[first]
    short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
    if len(short):
        found = np.concatenate([found, hash_groups(hashes, words.first[short], words.first[short + 1], 5)])
        rows = np.concatenate([rows, short])
    order = np.lexsort((found, rows))
    found, rows = found[order], rows[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    return found[at], np.diff(np.append(at, len(found))), rows[at]


def signatures(elements: np.ndarray, weights: np.ndarray, rows: np.ndarray, n_rows: int, size: int = SIZE) -> np.ndarray:
    """ProbMinHash signatures: for every component the element whose arrival there is the earliest."""
    best = np.full(n_rows * size, np.inf)
    out = np.zeros(n_rows * size, np.uint64)
    active, time, step = np.arange(len(elements)), np.zeros(len(elements)), 0
    limit = np.full(n_rows, np.inf)
    while len(active):
        step += 1
        draw = mix64(elements[active] + np.uint64(step * int(_STEP) & (1 << 64) - 1))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weights[active]
        going = time < limit[rows[active]]
        active, time, draw = active[going], time[going], draw[going]
        slot = rows[active] * size + (mix64(draw ^ _STEP) % np.uint64(size)).astype(np.int64)
        np.minimum.at(best, slot, time)
        earliest = best[slot] == time
        out[slot[earliest]] = elements[active[earliest]]
        limit = best.reshape(n_rows, size).max(axis=1)
    return out.reshape(n_rows, size)


def sketch(texts: pa.Array) -> dict[str, np.ndarray]:
    """Per text: node name, number of shingles, band keys and 8 bits of every component; only rows with a shingle."""
    words = Words(texts, ALNUM, lower=True)
    found, _, rows = shingles(words)
    # links are of sets: with weights by times, a text with a block repeated would miss its bands and screens
    signed = signatures(found, np.ones(len(found)), rows, words.rows)
    begin = np.searchsorted(rows, np.arange(words.rows + 1))
    node = hash_groups(found, begin[:-1], begin[1:], 7)
    keys = np.zeros((words.rows, BANDS), np.uint64)
    banded = signed[:, : BANDS * ROWS].reshape(words.rows, BANDS, ROWS)
    for k in range(ROWS):
        keys = mix64(keys + banded[:, :, k])
    keys = mix64(keys + np.arange(BANDS, dtype=np.uint64) * _STEP)
    return {
        "has": np.diff(begin) > 0, "node": node.view(np.int64), "n": np.diff(begin), "tag": substrings.row_tags(Words(texts, ALNUM)),
        "keys": keys.view(np.int64), "bits": _packed(signed), "marks": (signed & np.uint64(0xFF)).astype(np.uint8),
    }


def _packed(signed: np.ndarray) -> np.ndarray:
    """The lowest four bits of every component, sixteen components to a 64-bit word."""
    low = np.zeros((len(signed), _WORDS * 16), np.uint8)
    low[:, :SIZE] = signed & np.uint64(15)
    return (low[:, 0::2] | (low[:, 1::2] << 4)).copy().view("<i8").reshape(len(signed), _WORDS)


def differing(left: Column, right: Column) -> Column:
    """How many components of two packed signatures differ."""
    total = F.lit(0)
    for k in range(_WORDS):
        x = left[k].bitwiseXOR(right[k])
        any_bit = x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseOR(F.shiftright(x, 3))
        total = total + F.bit_count(any_bit.bitwiseAND(F.lit(_LOWEST)))
    return total


def named_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text, by which a row is found again even where many rows have one doc_id, or none."""
    return common.plain(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, tag and hash of the text, node (null without a shingle), n, keys, bits and marks of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, limit=_SLICE_BYTES):
            made = sketch(common.text_column(batch))
            none = pa.array(~made["has"])
            keys, bits = (
                pa.FixedSizeListArray.from_arrays(pa.array(made[k].reshape(-1)), made[k].shape[1]).cast(pa.list_(pa.int64())) for k in ("keys", "bits"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(made["tag"]), pa.array(made["node"], mask=~made["has"]), pa.array(made["n"].astype(np.int32)), keys, bits,
                 pa.array([m.tobytes() for m in made["marks"]], pa.binary())],
                ["doc_id", "text_hash", "tag", "node", "n", "keys", "bits", "marks"])

    return common.map_arrow(named_texts(docs), run, "doc_id long, text_hash long, tag int, node long, n int, keys array<long>, bits array<long>, marks binary")


def similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, screened: bool = False) -> DataFrame:
    """Of the pairs (a, b) of nodes those whose shingle sets have a Jaccard similarity of at least ``SIMILARITY``.

    ``screened`` pairs have been held to their signatures already.
    """
    marks = nodes.select("node", "n", "marks")
    likely = (
        pairs.join(marks.toDF("a", "n_a", "m_a"), "a").join(marks.toDF("b", "n_b", "m_b"), "b")
        .filter(F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b"))
    )

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, SIZE) for c in (batch.column(2), batch.column(3)))
            keep = (left == right).mean(axis=1) >= LIKELY
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    asked = pairs if screened else common.store(common.map_arrow(likely.select("a", "b", "m_a", "m_b"), screen, "a long, b long"), "likely-pairs")
    # the nodes themselves are asked for, one row each, however many pairs they are in
    named = nodes.select("node", "rep")
    first = named.join(asked.select(F.col("a").alias("node")), "node", "left_semi")
    second = named.join(asked.select(F.col("b").alias("node")), "node", "left_semi")
    needed = first.unionAll(second).distinct().select(F.col("node").alias("want"), F.col("rep.doc_id").alias("rep"), F.col("rep.text_hash").alias("rep_hash"))
    texts = named_texts(docs).join(
        needed, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_hash") == F.col("rep_hash"))).select("text", "want")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, limit=_SLICE_BYTES):
            words = Words(common.text_column(batch), ALNUM, lower=True)
            found, _, rows = shingles(words)
            begin = np.searchsorted(rows, np.arange(words.rows + 1))
            node = hash_groups(found, begin[:-1], begin[1:], 7).view(np.int64)
            # texts of one doc_id and one hash may still differ; only the text of the wanted node counts
            right = np.flatnonzero(node == batch.column(1).to_numpy())
            packed = [np.unique((found[begin[k] : begin[k + 1]] >> np.uint64(32)).astype("<u4")).tobytes() for k in right.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(node[right]), pa.array(packed, pa.binary())], ["node", "set"])

    held = common.store(common.map_arrow(texts, sets, "node long, set binary").dropDuplicates(["node"]), "shingle-sets")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for row, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                left, right = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                shared = len(left) + len(right) - len(np.unique(np.concatenate([left, right])))
                keep[row] = shared >= SIMILARITY * (len(left) + len(right) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    both = asked.join(held.toDF("a", "s_a"), "a").join(held.toDF("b", "s_b"), "b").select("a", "b", "s_a", "s_b")
    return common.store(common.map_arrow(both, verify, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """node and the smallest node of its component, for all nodes with a link.

    Every round takes the smallest label among the neighbours and then the label's own label; rounds end when none changes.
    Aggregates combine on the map side, so a node with very many links is one row per task.
    """
    edges = common.store(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = common.store(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = edges.join(labels.toDF("a", "other"), "a").groupBy("b").agg(F.min("other").alias("near"))
        lower = labels.join(near.toDF("node", "near"), "node", "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jumped = lower.join(labels.toDF("label", "next"), "label", "left").select("node", "was", F.least("label", "next").alias("label"))
        step = common.store(jumped, "labels")
        if step.filter("label <> was").isEmpty():
            return step.select("node", "label")
        labels = step.select("node", "label")


def roots(links: DataFrame) -> DataFrame:
    """node and label for links (a, b) of a node to its leader, one for each node.

    A leader is larger by (weight, node) than what it leads, so the links form trees and a node's label is its root; each
    round halves the way there. Roots have no row.
    """
    labels = links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    while True:
        step = common.store(
            labels.join(labels.toDF("label", "next"), "label", "left").select("node", F.coalesce("next", "label").alias("label"), F.col("next").isNotNull().alias("moved")), "labels")
        labels = step.select("node", "label")
        if step.filter("moved").isEmpty():
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links: only the components that a link joins are worked on, not their nodes."""
    name = lambda side: F.coalesce(f"label_{side}", side)
    ends = links.join(labels.toDF("a", "label_a"), "a", "left").join(labels.toDF("b", "label_b"), "b", "left")
    joined = ends.select(name("a").alias("a"), name("b").alias("b")).filter("a <> b").distinct()
    moved = components(joined).toDF("label", "to")
    fresh = links.select(F.col("a").alias("node")).unionAll(links.select(F.col("b").alias("node"))).distinct().join(labels, "node", "left_anti")
    known = labels.unionByName(fresh.withColumn("label", F.col("node")))
    return common.store(known.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")


def nearest(leads: DataFrame) -> DataFrame:
    """Of the rows (node, lead), one for each shared bucket, the pair (a, b) of each node with the lead it shares most with."""
    shared = leads.groupBy("node", "lead").agg(F.count(F.lit(1)).alias("n"))
    return shared.groupBy("node").agg(F.max_by("lead", F.struct("n", "lead")).alias("lead")).toDF("a", "b")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def node_classes(docs: DataFrame, found: DataFrame) -> DataFrame:
    """node and label of every node that has a link to another one."""
    nodes = common.store(
        found.filter("node IS NOT NULL").groupBy("node")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("rep"), *[F.first(c).alias(c) for c in ("n", "keys", "bits", "marks")]), "nodes")
    placed = nodes.select(F.explode("keys").alias("key"), "node")
    sizes = placed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = common.store(placed.join(sizes, "key"), "members")
    weights = members.groupBy("node").agg(F.sum("size").alias("weight"))
    leaders = members.join(weights, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("lead"))
    tried = common.store(nearest(members.join(leaders, "key").filter("node <> lead").select("node", "lead")), "tried")
    labels = roots(similar(tried, nodes, docs))
    tried = ordered(tried)
    for turn in ("second", "third", "rest"):
        known = members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
        mixed = known.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
        open_ = common.store(known.join(mixed, "key").join(nodes.select("node", "n", "bits", "keys"), "node"), "open-members")
        if turn != "rest":
            other = open_.groupBy("key").agg(F.max_by(F.struct("node", "label"), F.xxhash64("node", "key", F.lit(turn))).alias("lead"))
            leads = open_.join(other, "key").filter(F.col("label") != F.col("lead.label")).select("node", F.col("lead.node").alias("lead"))
            pairs = ordered(nearest(leads))
        else:
            right = open_.toDF("lead", "key_b", "label_b", "n_b", "bits_b", "keys_b")
            fits = (F.least("n", "n_b") >= SIMILARITY * F.greatest("n", "n_b")) & (differing(F.col("bits"), F.col("bits_b")) <= DIFFERING)
            # a pair counts in the first bucket that it shares only
            once = F.col("key") == F.array_min(F.array_intersect("keys", "keys_b"))
            both = open_.join(right, (F.col("key") == F.col("key_b")) & (F.col("label") < F.col("label_b")) & fits & once)
            pairs = ordered(both.select(F.col("node").alias("a"), F.col("lead").alias("b")))
        pairs = common.store(pairs.join(tried, ["a", "b"], "left_anti"), "tried")
        labels = merged(labels, similar(pairs, nodes, docs, screened=turn == "rest"))
        tried = tried.unionAll(pairs)
    return labels


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, tag and class_id of every document (row); class_id is the smallest doc_id of the class."""
    found = common.store(sketches(docs), "sketches")
    labels = node_classes(docs, found)
    named = found.select("doc_id", "tag", "node").join(labels, "node", "left").select("doc_id", "tag", F.coalesce("label", "node").alias("label"))
    named = common.store(named, "labelled")
    least = named.filter("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tag")).alias("kept"))
    return named.join(least, "label", "left").select(
        "doc_id", "tag", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (F.col("label").isNull() | ((F.col("kept.tag") == F.col("tag")) & F.col("kept.doc_id").eqNullSafe(F.col("doc_id")))).alias("stays"),
        F.col("label").isNull().alias("wordless"))


def keep_one(docs: DataFrame) -> DataFrame:
    """All columns of one document of each class, the one of the smallest doc_id; documents without a word all stay."""
    names = docs.columns
    doc, tag, rows, stays, wordless, row_tag = common.fresh(docs, "_id", "_tag", "_rows", "_stays", "_wordless", "_row_tag")
    chosen = classes(docs).groupBy(F.col("doc_id").alias(doc), F.col("tag").alias(tag)).agg(
        F.max("stays").alias(stays), F.count(F.lit(1)).alias(rows), F.max("wordless").alias(wordless))
    chosen = chosen.filter(F.col(stays))
    joined = substrings.tagged(docs, row_tag).join(chosen, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(row_tag) == F.col(tag)))
    alone = (F.col(rows) == 1) | F.col(wordless)
    kept = [F.col(f"`{n}`") for n in names]
    return joined.filter(alone).select(*kept).unionAll(joined.filter(~alone).dropDuplicates([doc, tag]).select(*kept))
