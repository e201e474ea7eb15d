"""Self-join of documents on the Jaccard similarity of their word n-grams, by a MinHash LSH forest.

Each document has, for each tree of the forest, a path of ``depth`` steps in a prefix trie: its
MinHash values, as bytes, so that a prefix of the bytes is a node of the trie and rows in the order of
the bytes are the sorted trie. Two documents meet in a node if their paths share that prefix in some
tree. First only whole paths meet: close copies are compared there, in narrow nodes. Then prefixes are
shortened to the longest at which pairs of the asked similarity, the least likely to meet of all
that count, reach the target share. That depth depends on nothing but similarity, trees and target: no other row
of a table can take a link away. A shorter prefix compares only pairs that did not meet at the longer one, each in
the first tree in which it meets, with the exact sets of n-grams.

Equal sets are one class, compared once. A prefix with many classes is split into blocks, and each
pair of blocks is a group of its own, so no group grows with the corpus. No pairs are written: each
group gives, for each class, its links and the least class it is connected to; connected groups of
documents then come from min-label rounds with shortcuts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import ascii_words, small_or_shuffled, table, text_batches, text_of
from quire.llm.hashes import mix, word_shingles

WORDS, SIMILARITY = 5, 0.8
#: Trees and steps of a full path, bytes of a step; share of pairs at the asked similarity that must meet.
TREES, DEPTH, STEP, TARGET = 16, 8, 4, 0.9999
#: Classes of a prefix that are compared in one group.
BLOCK = 512


def recall(similarity: float, depth: int, trees: int = TREES) -> float:
    """Expected share of pairs of a similarity that share a prefix of ``depth`` steps in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(similarity: float, trees: int = TREES, depth: int = DEPTH, target: float = TARGET) -> int:
    """The longest prefix with which pairs of the similarity, and so those above it, meet the target recall."""
    while depth > 1 and recall(similarity, depth, trees) < target:
        depth -= 1
    return depth


class Forest:
    def __init__(self, trees: int, depth: int):
        seeds = mix(np.arange(1, 2 * trees * depth + 1, dtype=np.uint64))
        self.factor, self.shift = seeds[::2] | np.uint64(1), seeds[1::2]

    def paths(self, shingles: np.ndarray) -> bytes:
        """The paths in all trees, one after the other; each step as STEP bytes, the highest first."""
        least = np.full(len(self.factor), np.iinfo(np.uint64).max, np.uint64)
        for part in (shingles[i : i + 1024] for i in range(0, len(shingles), 1024)):
            np.minimum(least, (part[:, None] * self.factor + self.shift).min(axis=0), out=least)
        return (mix(least) >> np.uint64(64 - 8 * STEP)).astype(f">u{STEP}").tobytes()


def shingles_of(text: str | None, size: int = WORDS) -> np.ndarray:
    return word_shingles(ascii_words((text or "").lower()), size)


def _key(shingles: np.ndarray, digest: bytes) -> bytes:
    """Of the set; texts without words are a class for each text."""
    return hashlib.blake2b(shingles.tobytes() if len(shingles) else digest, digest_size=16, person=b"set" if len(shingles) else b"text").digest()


def _signatures(docs: DataFrame, size: int, trees: int, depth: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(trees, depth)
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            keys, counts, paths = [], [], []
            for text, digest in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = shingles_of(text, size)
                keys.append(_key(found, digest))
                counts.append(len(found))
                paths.append(forest.paths(found) if len(found) else None)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(counts, pa.int32()), pa.array(paths, pa.binary())], ["doc_id", "digest", "key", "n", "paths"])

    return docs.mapInArrow(sign, "doc_id long, digest binary, key binary, n int, paths binary")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of equal ``task``, from sorted batches."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        task = batch.column(0).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)]
        for a, b in zip(edges, edges[1:], strict=False):
            if rest and rest[-1].column(0)[-1].as_py() != task[a]:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(batch.slice(a, b - a))
    if rest:
        yield pa.Table.from_batches(rest)


def _array(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.to_numpy(zero_copy_only=False) if width is None else flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _meetings(nodes: np.ndarray, tree: int, left: np.ndarray, right: np.ndarray, trees: int) -> np.ndarray:
    """Which rows of ``left`` and ``right`` meet in this tree, in none before it, and in none at the longer prefix.

    ``nodes``: of each row the nodes in all trees at this prefix, then, if there was a longer one, those at it.
    """
    a, b = nodes[left], nodes[right]
    new = a[:, tree][:, None] == b[:, tree][None, :]
    for t in [*range(tree), *range(trees, nodes.shape[1])]:
        new &= a[:, t][:, None] != b[:, t][None, :]
    return new


def _sides(blocks: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    return np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)


_PLACED = "task long, class long, tree int, low int, high int, block int, nodes array<long>"


def _candidates(trees: int):
    """The rows of each group that have a pair to compare there."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            nodes = _array(group["nodes"], len(group["nodes"][0]))
            tree, low, high = (group[c][0].as_py() for c in ("tree", "low", "high"))
            left, right = _sides(_array(group["block"]), low, high)
            new = _meetings(nodes, tree, left, right, trees)
            if low == high:
                new &= ~np.eye(len(left), dtype=bool)
            keep = np.zeros(group.num_rows, bool)
            keep[left[new.any(axis=1)]] = True
            keep[right[new.any(axis=0)]] = True
            if keep.any():
                yield from group.filter(pa.array(keep)).combine_chunks().to_batches()

    return candidates


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Shared elements of the wanted pairs (0 elsewhere), exact."""
    out = np.zeros(wanted.shape, np.int64)
    rows = np.flatnonzero(wanted.any(axis=1))
    if wanted.sum() <= 4 * len(rows):
        for i, j in zip(*np.nonzero(wanted), strict=True):
            a, b = sets[left[i]], sets[right[j]]
            a, b = (a, b) if len(a) <= len(b) else (b, a)
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            out[i, j] = (b[at] == a).sum()
        return out
    # many pairs: for each set of the left, count through an index of the elements of the right
    sizes = np.array([len(sets[j]) for j in right])
    elements, owner = np.concatenate([sets[j] for j in right]), np.repeat(np.arange(len(right)), sizes)
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    for i in rows:
        a = sets[left[i]]
        first, last = np.searchsorted(elements, a, "left"), np.searchsorted(elements, a, "right")
        many = last - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        out[i] = np.bincount(owner[at], minlength=len(right))
    return np.where(wanted, out, 0)


def _connected(n: int, pairs: np.ndarray) -> np.ndarray:
    """The least member of each member's component."""
    label = np.arange(n)
    while len(pairs):
        least = label.copy()
        np.minimum.at(least, pairs[:, 0], label[pairs[:, 1]])
        np.minimum.at(least, pairs[:, 1], label[pairs[:, 0]])
        least = least[least]
        if (least == label).all():
            break
        label = least
    return label


_LINKS = "class long, links long, docs long, least long"


def _verify(similarity: float, trees: int):
    """Of each class with a link in a group: its links and the least class they connect it to."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            order = np.argsort(_array(group["class"]))
            group = group.take(pa.array(order))
            ids, sizes = _array(group["class"]), _array(group["size"])
            tree, low, high = (group[c][0].as_py() for c in ("tree", "low", "high"))
            left, right = _sides(_array(group["block"]), low, high)
            new = _meetings(_array(group["nodes"], len(group["nodes"][0])), tree, left, right, trees)
            if low == high:
                new = np.triu(new, 1)
            sets = [np.frombuffer(s.as_py(), np.uint64) for s in group["shingles"]]
            counts = np.array([len(s) for s in sets])
            fits = np.minimum(counts[left][:, None], counts[right][None, :]) >= similarity * np.maximum(counts[left][:, None], counts[right][None, :]) - 1e-9
            shared = overlaps(sets, left, right, new & fits)
            whole = counts[left][:, None] + counts[right][None, :] - shared
            i, j = np.nonzero(new & fits & (shared >= similarity * whole - 1e-9))
            a, b = left[i], right[j]
            n = group.num_rows
            links = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
            docs = np.bincount(a, sizes[b], minlength=n) + np.bincount(b, sizes[a], minlength=n)
            least = ids[_connected(n, np.column_stack([a, b]))]
            has = links > 0
            if has.any():
                yield pa.record_batch([pa.array(ids[has]), pa.array(links[has]), pa.array(docs[has].astype(np.int64)), pa.array(least[has])], ["class", "links", "docs", "least"])

    return verify


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: of the undirected graph of ``edges`` (a, b), the least node each is connected to.

    Each round gives ends of an edge, and the nodes that their labels name, the lesser label, then
    follows labels once; rounds grow with the logarithm of a component's span. Every round is a
    written table; only a count comes to the driver.
    """
    edges = table(edges.filter("a <> b").distinct(), "edges")
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = table(ends.withColumn("label", F.col("node")), "labels")
    while True:
        seen = edges.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
        lesser = F.least("la", "lb")
        told = seen.select(F.explode(F.array("a", "b", "la", "lb")).alias("node"), lesser.alias("less")).groupBy("node").agg(F.min("less").alias("less"))
        hooked = table(labels.join(told, "node", "left").select("node", F.least("label", "less").alias("next"), "label"), "hooked")
        above = hooked.select(F.col("node").alias("next"), F.col("next").alias("top"))
        following = table(hooked.join(above, "next", "left").select("node", F.coalesce("top", "next").alias("next"), "label"), "labels")
        if following.filter("next <> label").isEmpty():
            return following.select("node", "label")
        labels = following.select("node", F.col("next").alias("label"))


def ngram_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, target: float = TARGET, block: int = BLOCK
) -> DataFrame:
    """One row per row of ``docs``: id, ``digest`` of the text, class, links and connected group.

    ``class_id``: least id with the same set of n-grams, ``class_size`` rows. ``n_links``: other classes
    whose similarity is at least ``similarity``, of ``n_linked_docs`` rows. ``group_id``: least id
    reached by links and classes. Words are parted by spaces and signs, so a text in a script without
    spaces is few long words, and only equal ones share n-grams. Texts of fewer words than ``size`` are one n-gram; texts without
    words (null ones too) share a class only with equal texts and have no links. Null ids stay.
    """
    texts = text_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text_of(text_col), 256)).alias("digest"), text_of(text_col).alias("text"))
    signed = table(_signatures(texts, size, trees, depth), "signatures")
    rep = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    classes = signed.groupBy("key").agg(F.min(rep).alias("rep"), F.count("*").alias("size"), F.min_by("paths", rep).alias("paths"), F.max("n").alias("n"))
    classes = table(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    links = _level(texts, classes, size, similarity, trees, depth, depth, None, block)
    shorter = prefix_depth(similarity, trees, depth, target)
    if shorter < depth:
        links = links.unionByName(_level(texts, classes, size, similarity, trees, depth, shorter, depth, block))
    group = components(links.select(F.col("class").alias("a"), F.col("least").alias("b")))
    heads = classes.select("class", "rep").join(group.withColumnRenamed("node", "class"), "class")
    firsts = heads.groupBy("label").agg(F.min("rep").alias("first"))
    linked = links.groupBy("class").agg(F.sum("links").alias("n_links"), F.sum("docs").alias("n_linked_docs"))
    info = classes.select("class", "key", "rep", "size").join(linked, "class", "left").join(heads.join(firsts, "label").select("class", "first"), "class", "left")
    first = F.coalesce("first", "rep")
    return signed.join(info, "key").select(
        F.col("doc_id").alias(id_col),
        "digest",
        F.col("rep.doc_id").alias("class_id"),
        F.col("size").alias("class_size"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_linked_docs", F.lit(0)).alias("n_linked_docs"),
        first["doc_id"].alias("group_id"),
        ((F.col("digest") == first["digest"]) & F.col("doc_id").eqNullSafe(first["doc_id"])).alias("first"),
    )


def _level(texts: DataFrame, classes: DataFrame, size: int, similarity: float, trees: int, full: int, depth: int, before: int | None, block: int) -> DataFrame:
    """``_LINKS`` of the pairs that share a prefix of ``depth`` steps in some tree, and none of ``before`` steps."""

    def nodes(steps: int) -> Column:
        one = lambda t: F.xxhash64(t, F.expr("paths").substr(t * (full * STEP) + 1, F.lit(steps * STEP)))
        return F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), one)

    placed = classes.filter("paths is not null").select("class", nodes(depth).alias("nodes"), (nodes(before) if before else F.array().cast("array<long>")).alias("longer"))
    met = placed.select("class", F.posexplode("nodes").alias("tree", "node"))
    often = met.groupBy("node").agg(F.count("*").alias("many")).filter("many > 1")
    placed = met.join(often, "node").join(placed.select("class", F.concat("nodes", "longer").alias("nodes")), "class")
    # a node with many classes: its blocks meet pairwise, each pair of blocks in a group of its own
    blocks = F.ceil(F.col("many") / block).cast("int")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("class"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    placed = placed.withColumn("task", F.xxhash64("node", "low", "high")).select("task", "class", "tree", "low", "high", "block", "nodes")
    wanted = table(placed.repartition("task").sortWithinPartitions("task").mapInArrow(_candidates(trees), _PLACED), "wanted")
    reps = table(classes.join(wanted.select("class").distinct(), "class", "left_semi").select("class", "rep.doc_id", "rep.digest", "key", "size"), "reps")
    same = texts["doc_id"].eqNullSafe(reps["doc_id"]) & (texts["digest"] == reps["digest"])
    chosen = small_or_shuffled(texts, reps, same, "inner", reps.count()).select("class", "size", "text").dropDuplicates(["class"])
    sets = table(chosen.mapInArrow(_sets(size), "class long, size long, shingles binary"), "sets")
    found = wanted.join(sets, "class").repartition("task").sortWithinPartitions("task").select("task", "class", "tree", "low", "high", "block", "nodes", "size", "shingles")
    return table(found.mapInArrow(_verify(similarity, trees), _LINKS), "links")


def _sets(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            found = [shingles_of(t, size).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["class", "size", "shingles"])

    return sets


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that come first in their connected group.

    Rows equal in id and text stand or fall together; exact dedup removes them.
    """
    marks = table(ngram_join(docs, id_col, text_col, **options).filter("not first").select(F.col(id_col).alias("other_id"), F.col("digest").alias("other_digest")), "near")
    on = docs[id_col].cast("long").eqNullSafe(marks["other_id"]) & (F.unhex(F.sha2(text_of(docs[text_col]), 256)) == marks["other_digest"])
    return small_or_shuffled(docs, marks, on, "left_anti", marks.count())
