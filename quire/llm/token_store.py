"""A content-addressed store of token ids.

Layout of a store, all Parquet:

- ``docs/shard=k``: one row per document in ascending id order, with its place in the whole id
  stream, its recipe (chunk digests and lengths, and which are shared), a pack of the chunks that
  only it has, in the order of its recipe, and a Merkle root over the digests;
- ``chunks``: chunks that occur more than once, once each, by digest;
- ``manifest``: per shard the documents, the ids, the ids before it, and a Merkle root over its
  documents' roots.

Every chunk is addressed by its digest and stored once; those of one document lie in its pack, so
that reading moves only shared ones. Cuts come from a rolling hash over the ids, so equal passages
give equal chunks wherever they start. Only digests are shuffled to find what is shared; ids move
once, when texts are put in order. Reading reassembles each document, and fails if a chunk differs
from its digest, a document from its root, or a shard from the manifest: nothing can be lost unseen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import parallelism, table, text_batches
from quire.llm.tokens import END_ID, encoder

#: A cut falls where the rolling hash has this many zero bits: a chunk has about 2 ** BITS ids.
BITS, SHORTEST, LONGEST = 9, 64, 4096
#: Pieces that the encoder of a store remembers (some 200 bytes each, twice): no other stage shares its workers.
PIECES = 800_000
#: Marks up to this many rows are broadcast (some 100 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 300_000


def rolling(ids: np.ndarray) -> np.ndarray:
    """A hash at each place that depends on the 32 ids up to it."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    hashes = (mixed >> np.uint64(29)).astype(np.uint32)
    for span in (1, 2, 4, 8, 16):
        hashes[span:] += hashes[:-span] << np.uint32(span)
    return hashes


def cuts(ids: np.ndarray, marks: np.ndarray | None = None) -> list[int]:
    """Ends of the chunks of one document; ``marks``: places after which its rolling hash cuts.

    Marks count only SHORTEST ids after a cut, so what precedes a document among others never matters.
    """
    if marks is None:
        marks = np.flatnonzero(rolling(ids) >> np.uint32(32 - BITS) == 0) + 1
    ends, last = [], 0
    for end in marks.tolist():
        while end - last > LONGEST:
            last += LONGEST
            ends.append(last)
        if end - last >= SHORTEST:
            ends.append(end)
            last = end
    while len(ids) - last > LONGEST:
        last += LONGEST
        ends.append(last)
    return ends if last == len(ids) else [*ends, len(ids)]


def digest(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=16).digest()


class Merkle:
    """Root of a binary Merkle tree over leaves that arrive one by one; it keeps one node per level."""

    def __init__(self):
        self.peaks: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        node = (0, hashlib.sha256(b"\0" + leaf).digest())
        while self.peaks and self.peaks[-1][0] == node[0]:
            node = (node[0] + 1, hashlib.sha256(b"\1" + self.peaks.pop()[1] + node[1]).digest())
        self.peaks.append(node)

    def root(self) -> bytes:
        root = b""
        for _, node in reversed(self.peaks):
            root = hashlib.sha256(b"\1" + node + root).digest() if root else node
        return root


def merkle(leaves: list[bytes]) -> bytes:
    tree = Merkle()
    for leaf in leaves:
        tree.add(leaf)
    return tree.root()


_MANIFEST = "shard int, docs long, n_tokens long, root binary, before long"


_STAGED = "shard int, row long, doc_id long, local_start long, n_tokens long, root binary, shard_root binary, chunks array<struct<digest:binary,n:int>>, ids binary"


_DOCS = "row long, doc_id long, n_tokens long, root binary, chunks array<struct<digest:binary,n:int>>, ids binary, shared array<struct<pos:int,first:boolean>>, start long, shard int"


def _stage(docs: DataFrame, path: str, id_col: str, text_col: str, shards: int) -> DataFrame:
    """Documents in ascending id order by shards, encoded and cut."""
    end = np.array([END_ID], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(path, PIECES).encode
        row, start, tree = 0, 0, Merkle()
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                stored = [to_ids(t) + end for t in part.column(2).to_pylist()]
                ids = np.frombuffer(b"".join(stored), dtype="<u4")
                edges = np.cumsum([0, *(len(x) // 4 for x in stored)])
                marks = np.flatnonzero(rolling(ids) >> np.uint32(32 - BITS) == 0) + 1
                at = np.searchsorted(marks, edges, "right")
                digests, sizes, counts, roots = [], [], [0], []
                for n, data in enumerate(stored):
                    ends = cuts(ids[edges[n] : edges[n + 1]], marks[at[n] : at[n + 1]] - edges[n])
                    begins = [0, *ends[:-1]]
                    own = [digest(data[4 * a : 4 * b]) for a, b in zip(begins, ends, strict=True)]
                    digests += own
                    sizes += [b - a for a, b in zip(begins, ends, strict=True)]
                    counts.append(len(digests))
                    roots.append(merkle(own))
                    tree.add(roots[-1])
                rows = np.arange(row, row + len(stored), dtype=np.int64)
                shards = part.column(0).cast(pa.int32())
                chunks = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes, pa.int32())], ["digest", "n"]))
                shard_root = [None] * (len(stored) - 1) + [tree.root()]  # the last of a shard is that of all
                yield pa.record_batch(
                    [shards, pa.array((np.asarray(shards, dtype=np.int64) << 40) + rows), part.column(1), pa.array(start + edges[:-1]), pa.array(np.diff(edges)), pa.array(roots, pa.binary()), pa.array(shard_root, pa.binary()), chunks, pa.array(narrow_all(ids, edges), pa.binary())],
                    ["shard", "row", "doc_id", "local_start", "n_tokens", "root", "shard_root", "chunks", "ids"],
                )
                row, start = row + len(stored), start + int(edges[-1])

    texts = text_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = texts.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.select(F.spark_partition_id().alias("shard"), "doc_id", "text").mapInArrow(encode, _STAGED)


def narrow(ids: np.ndarray) -> bytes:
    """Two bytes an id where all fit, else four, told apart by a first byte."""
    return b"\2" + ids.astype("<u2").tobytes() if len(ids) == 0 or ids.max() < 65536 else b"\4" + ids.astype("<u4").tobytes()


def narrow_all(ids: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """``narrow`` of each stretch."""
    if len(ids) and ids.max() >= 65536:
        return [narrow(ids[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    short, at = ids.astype("<u2").tobytes(), (2 * edges).tolist()
    return [b"\2" + short[a:b] for a, b in zip(at, at[1:], strict=False)]


def widen(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, dtype="<u2" if stored[:1] == b"\2" else "<u4", offset=1).astype("<u4")


def _marked(staged: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """Marks are broadcast only when counted small; else both sides are shuffled."""
    return staged.join(F.broadcast(marks) if marks.count() <= BROADCAST_ROWS else marks, "row", how)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _own_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves in ``ids`` only the chunks that are not shared."""
    for batch in batches:
        some = _column(batch, "shared").is_valid()
        few, kept = batch.filter(some), []
        for stored, chunks, shared in zip(*(_column(few, c).to_pylist() for c in ("ids", "chunks", "shared")), strict=True):
            ids, out, at, drop = widen(stored), [], 0, {m["pos"] for m in shared}
            for pos, chunk in enumerate(chunks):
                if pos not in drop:
                    out.append(ids[at : at + chunk["n"]])
                at += chunk["n"]
            kept.append(narrow(np.concatenate(out)) if out else b"\2")
        ids = pc.replace_with_mask(_column(batch, "ids"), some, pa.array(kept, _column(batch, "ids").type))
        yield batch.set_column(batch.schema.get_field_index("ids"), "ids", ids)


def _shared_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for stored, chunks, shared in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("ids", "chunks", "shared")), strict=True):
            ids, ends = widen(stored), np.cumsum([c["n"] for c in chunks])
            found += [(chunks[m["pos"]]["digest"], narrow(ids[ends[m["pos"]] - chunks[m["pos"]]["n"] : ends[m["pos"]]])) for m in shared if m["first"]]
        yield pa.record_batch([pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)], ["digest", "ids"])


def write_store(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> None:
    """Encode ``docs`` and write the store to ``folder``.

    Null texts count as empty; null ids come first; rows of one id follow each other by text.
    """
    spark = docs.sparkSession
    # beside the store, which holds no id twice
    staged = table(_stage(docs, path, id_col, text_col, shards or parallelism(spark)), "staged")
    places = staged.select("row", F.posexplode("chunks").alias("pos", "chunk")).select("row", "pos", F.col("chunk.digest").alias("digest"))
    repeated = places.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("row", "pos")).alias("first")).filter("n > 1")
    first = (F.col("row") == F.col("first.row")) & (F.col("pos") == F.col("first.pos"))
    shared = places.join(repeated, "digest").select("row", F.struct("pos", first.alias("first")).alias("mark"))
    marks = table(shared.groupBy("row").agg(F.collect_list("mark").alias("shared")), "marks")
    owners = marks.filter(F.exists("shared", lambda m: m["first"]))
    chunks = _marked(staged.select("row", "chunks", "ids"), owners, "inner").mapInArrow(_shared_ids, "digest binary, ids binary")
    chunks.write.option("compression", "zstd").parquet(f"{folder}/chunks")
    totals = staged.groupBy("shard").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("n_tokens"), F.max_by("shard_root", "row").alias("root"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    totals.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{folder}/manifest")
    manifest = spark.read.parquet(f"{folder}/manifest").select("shard", "before")
    rows = _marked(staged.drop("shard_root"), marks, "left")
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    own = rows.mapInArrow(_own_ids, schema).join(F.broadcast(manifest), "shard").withColumn("start", F.col("before") + F.col("local_start")).drop("before", "local_start")
    own.sortWithinPartitions("shard", "row").write.partitionBy("shard").parquet(f"{folder}/docs")


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of each document, reassembled; fails on any digest, root or shard that differs.

    ``ids`` are little-endian unsigned 32-bit integers, with the end id. A missing chunk, document or
    shard fails, too. The checks are part of the plan: they run when the result is read.
    """
    docs = spark.read.schema(_DOCS).parquet(f"{folder}/docs")
    chunks = spark.read.schema("digest binary, ids binary").parquet(f"{folder}/chunks")
    pos = F.col("mark.pos")
    wanted = docs.filter("shared is not null").select("row", "chunks", F.explode("shared").alias("mark")).select("row", pos.alias("pos"), F.element_at("chunks", pos + 1)["digest"].alias("digest"))
    fetched = wanted.join(chunks, "digest").groupBy("row").agg(F.collect_list(F.struct("pos", "ids")).alias("fetched"))
    columns = ["doc_id", "start", "n_tokens", "root", "chunks", "ids"]
    mixed = docs.filter("shared is not null").join(fetched, "row", "left").select(*columns, "fetched")
    alone = docs.filter("shared is null").select(*columns, F.lit(None).cast(mixed.schema["fetched"].dataType).alias("fetched"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                out = []
                doc_ids, roots, stored, fetched = (_column(part, c).to_pylist() for c in ("doc_id", "root", "ids", "fetched"))
                totals, chunks = _column(part, "n_tokens").to_pylist(), _column(part, "chunks")
                edges = np.cumsum([0, *chunks.value_lengths().to_pylist()]).tolist()
                flat = chunks.flatten()
                digests, sizes = flat.field("digest").to_pylist(), flat.field("n").to_pylist()
                for n, own in enumerate(stored):
                    own, at, parts = widen(own).tobytes(), 0, []
                    if fetched[n] is None and len(own) == 4 * totals[n] and merkle(digests[edges[n] : edges[n + 1]]) == roots[n] and _whole(own, digests[edges[n] : edges[n + 1]], sizes[edges[n] : edges[n + 1]]):
                        out.append(own)
                        continue
                    got = {f["pos"]: widen(f["ids"]).tobytes() for f in fetched[n] or ()}
                    for k, (wanted, size) in enumerate(zip(digests[edges[n] : edges[n + 1]], sizes[edges[n] : edges[n + 1]], strict=True)):
                        ids = got.get(k)
                        if ids is None:
                            ids = own[at : at + 4 * size]
                            at += 4 * size
                        if digest(ids) != wanted:
                            raise ValueError(f"chunk {k} of document {doc_ids[n]} differs from its digest")
                        parts.append(ids)
                    ids = b"".join(parts)
                    if len(ids) != 4 * totals[n] or merkle(digests[edges[n] : edges[n + 1]]) != roots[n]:
                        raise ValueError(f"document {doc_ids[n]} differs from its root")
                    out.append(ids)
                yield pa.record_batch([_column(part, "doc_id"), _column(part, "start"), _column(part, "n_tokens"), pa.array(out, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    sound = alone.unionByName(mixed).mapInArrow(assemble, "doc_id long, start long, n_tokens long, ids binary")
    fault = F.raise_error(F.concat(F.lit("shard "), F.col("shard"), F.lit(" differs from the manifest")))
    return sound.unionByName(check_manifest(spark, folder).select(*(fault.cast(kind).alias(name) for name, kind in sound.dtypes)))


def _shard_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``shard, found, found_docs, found_tokens`` of rows in order: one Merkle tree at a time, of which only its peaks are held."""
    shard, tree, docs, tokens = None, Merkle(), 0, 0
    for batch in batches:
        out = []
        for k, root, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != shard:
                if shard is not None:
                    out.append((shard, tree.root(), docs, tokens))
                shard, tree, docs, tokens = k, Merkle(), 0, 0
            tree.add(root)
            docs, tokens = docs + 1, tokens + n
        yield _found(out)
    if shard is not None:
        yield _found([(shard, tree.root(), docs, tokens)])


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int64())
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["shard", "found", "found_docs", "found_tokens"])


def _whole(ids: bytes, digests: list[bytes], sizes: list[int]) -> bool:
    """Whether ids are just the chunks of these digests and sizes."""
    view, at = memoryview(ids), 0
    for wanted, size in zip(digests, sizes, strict=True):
        if digest(view[at : at + 4 * size]) != wanted:
            return False
        at += 4 * size
    return at == len(ids)


def check_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Shards whose documents differ from the manifest in root, number or ids, or that it does not know: none in a sound store."""
    docs = spark.read.schema(_DOCS).parquet(f"{folder}/docs").select("shard", "row", "root", "n_tokens")
    ordered = docs.repartition("shard").sortWithinPartitions("shard", "row").select("shard", "root", "n_tokens")
    found = ordered.mapInArrow(_shard_roots, "shard int, found binary, found_docs long, found_tokens long")
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").withColumnRenamed("n_tokens", "tokens")
    same = F.col("root").eqNullSafe(F.col("found")) & F.col("docs").eqNullSafe(F.col("found_docs")) & F.col("tokens").eqNullSafe(F.col("found_tokens"))
    return manifest.join(found, "shard", "full").filter(~same).select("shard")
