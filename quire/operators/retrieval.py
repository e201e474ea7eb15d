"""Retrieval: exact vector search, keyword search, rank fusion, BM25, context blocks and caches."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quire.functions.text import any_term, filled
from quire.functions.vector import cosine_distance
from quire.sources.tables import small_by_count, table

#: Constant of rank fusion.
FUSION = 60
#: Numbers of all query vectors together up to which they go to every task as one matrix (64 MB).
MATRIX = 8_000_000
#: Distances that a task computes at once (16 MB).
PRODUCTS = 2_000_000
#: Distances that a task of ``distances`` gives.
TASK_PAIRS = 8_000_000


class Best:
    """The k nearest rows of each of some queries: blocks of rows against queries at once, then exact distances of the few that can count."""

    def __init__(self, matrix: np.ndarray, k: int):
        self.matrix, self.k = matrix, k
        self.lengths = np.sqrt((matrix * matrix).sum(axis=1))
        self.asked = np.flatnonzero(self.lengths > 0)
        self.found: list[list[tuple]] = [[] for _ in matrix]

    def add(self, keys: pa.Array, vectors: pa.Array, asked: np.ndarray | None = None) -> None:
        """Rows for the queries of these numbers (all of them by default); rows without a vector of the queries' length count for none."""
        asked = self.asked if asked is None else asked[self.lengths[asked] > 0]
        width = self.matrix.shape[1] if self.matrix.ndim == 2 else 0
        fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False)
        keys, vectors = keys.filter(fits), vectors.filter(fits)
        step = max(1, PRODUCTS // max(1, len(asked)))
        for i in range(0, len(keys) if len(asked) else 0, step):
            rows = vectors.slice(i, step).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            self._add(keys.slice(i, step), rows, asked)

    def _add(self, keys: pa.Array, rows: np.ndarray, asked: np.ndarray) -> None:
        sizes = np.sqrt((rows * rows).sum(axis=1))
        some = np.flatnonzero(sizes > 0)  # nulls within a vector too are no distance
        if not len(some):
            return
        rows, sizes = rows[some], sizes[some]
        rough = 1 - (rows / sizes[:, None]) @ (self.matrix[asked] / self.lengths[asked][:, None]).T
        for at, q in enumerate(asked.tolist()):
            column, best = rough[:, at], self.found[q]
            limit = np.partition(column, self.k - 1)[self.k - 1] if len(column) > self.k else np.inf
            if len(best) == self.k:
                limit = min(limit, best[-1][0])
            near = np.flatnonzero(column <= limit + 1e-9)
            v, length = self.matrix[q], float(self.lengths[q])
            exact = [(1 - float(np.dot(rows[i], v)) / (float(sizes[i]) * length), keys[int(some[i])].as_py()) for i in near.tolist()]
            self.found[q] = sorted(best + exact)[: self.k]

    def record(self, names: list, key_type: pa.DataType) -> pa.RecordBatch | None:
        out = [(names[q], key, distance) for q, some in enumerate(self.found) for distance, key in some]
        if not out:
            return None
        ids, keys, distances = zip(*out, strict=True)
        return pa.record_batch([pa.array(ids), pa.array(keys, key_type), pa.array(distances, pa.float64())], ["query_id", "key", "distance"])


def _best_of_blocks(names: list, matrix: np.ndarray, k: int):
    """In each task the k nearest rows of each query."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, key_type = Best(matrix, k), None
        for batch in batches:
            key_type = batch.schema.field(0).type
            best.add(batch.column(0), batch.column(1))
        if (found := best.record(names, key_type)) is not None:
            yield found

    return near


def nearest(queries: DataFrame, rows: DataFrame, k: int, key: str, vector: str = "embedding") -> DataFrame:
    """For each query the k rows at the least cosine distance, ties by key; zero vectors, and vectors of another length than the query's, are left out.

    Queries (``query_id``, ``query_vector``) are a stated set: counted small, they are a matrix that
    blocks of rows meet in every task, which passes on k rows a query. Else each row meets them in a
    nested loop over shuffled blocks. A query's rows are ranked within hash slices before the last cut.
    """
    size = queries.agg(F.sum(F.size("query_vector"))).first()[0] or 0
    best = Window.partitionBy("query_id").orderBy("distance", key)
    if 0 < size <= MATRIX:
        asked = queries.filter("query_vector is not null").select("query_id", "query_vector").collect()
        kinds = [f"query_id {queries.schema['query_id'].dataType.simpleString()}", f"`key` {rows.schema[key].dataType.simpleString()}", "distance double"]
        found = None
        for length in sorted({len(r[1]) for r in asked}):  # queries of one length, as a rule
            alike = [r for r in asked if len(r[1]) == length]
            some = rows.select(F.col(key).alias("key"), vector).mapInArrow(_best_of_blocks([r[0] for r in alike], np.array([r[1] for r in alike], float), k), ", ".join(kinds))
            found = some if found is None else found.unionByName(some)
        found = found.withColumnRenamed("key", key)
        return found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).select("query_id", key, "distance", "place")
    few = queries.count() <= 10_000
    alike = F.size("query_vector") == F.size(vector)
    pairs = rows.join(F.broadcast(queries) if few else queries, alike).withColumn("distance", cosine_distance(F.col("query_vector"), F.col(vector)))
    return ranked(pairs, k, key)


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of the rows of ``a`` and ``b``, added up in the order of their components, as the built-in expression does."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def _rounded(rows: np.ndarray, matrix: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rounded cosine distances of all rows and queries, and where they are null (a zero vector).

    Products of whole blocks add up in another order than the expression; where that could change what is
    rounded, the pair is computed again in order and rounded as a decimal number, so all equal the expression's.
    """
    lengths, asked = np.sqrt(_in_order(rows, rows)), np.sqrt(_in_order(matrix, matrix))
    with np.errstate(all="ignore"):
        both = lengths[:, None] * asked
        scaled = (1 - (rows @ matrix.T) / both) * 10.0**digits
        whole = np.rint(scaled)
        close = np.abs(np.abs(scaled - whole) - 0.5) < 10.0**digits * max(1e-13, 1e-15 * rows.shape[1])
        close |= ~np.isfinite(scaled) | (both < 1e-280)
        found = (whole + 0.0) / 10.0**digits
        r, q = np.nonzero(close & (both != 0))
        for i in range(0, len(r), 65_536):
            r_, q_ = r[i : i + 65_536], q[i : i + 65_536]
            exact = 1 - _in_order(rows[r_], matrix[q_]) / both[r_, q_]
            step = Decimal(1).scaleb(-digits)
            found[r_, q_] = [float(Decimal(repr(x)).quantize(step, ROUND_HALF_UP)) + 0.0 if np.isfinite(x) else x for x in exact.tolist()]
    return found, both == 0


def distances(queries: DataFrame, rows: DataFrame, key: str, vector: str = "embedding", digits: int = 6) -> DataFrame:
    """``query_id``, key, ``distance`` of every row from every query, rounded; null where a vector is zero or null, holds nulls or has another length.

    Queries counted small are a matrix that blocks of rows meet in every task, and rows are dealt so that a task gives
    about ``TASK_PAIRS`` distances; it holds one block of them. Else each row meets them in a nested loop over shuffled blocks.
    """
    size, asked = queries.agg(F.coalesce(F.sum(F.size("query_vector")), F.lit(0)), F.count("*")).first()
    if not asked or max(size, asked) > MATRIX:
        pairs = rows.select(key, vector).crossJoin(F.broadcast(queries) if asked <= 10_000 else queries)
        return pairs.select("query_id", key, F.round(cosine_distance(F.col("query_vector"), F.col(vector)), digits).alias("distance"))
    some = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("v")).collect()
    widths = [len(r[1]) if r[1] is not None and None not in r[1] else 0 for r in some]
    alike = [(w, [i for i, x in enumerate(widths) if x == w]) for w in sorted(set(widths))]
    blocks = [([some[i][0] for i in at], np.array([some[i][1] for i in at], float) if w else None) for w, at in alike]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, matrix in blocks:
                names = pa.array(ids, id_type)
                step = max(1, PRODUCTS // 4 // len(ids))
                for i in range(0, batch.num_rows, step):
                    yield _met(batch.column(0).slice(i, step), batch.column(1).slice(i, step), names, matrix)

    def _met(keys: pa.Array, vectors: pa.Array, names: pa.Array, matrix: np.ndarray | None) -> pa.RecordBatch:
        n, m = len(keys), len(names)
        found, null = np.zeros((n, m)), np.ones((n, m), bool)
        if matrix is not None:
            fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), matrix.shape[1]), False).to_numpy(zero_copy_only=False)
            values = vectors.filter(pa.array(fits)).flatten()
            whole = values.is_valid().to_numpy(zero_copy_only=False).reshape(-1, matrix.shape[1]).all(axis=1)
            at = np.flatnonzero(fits)[whole]
            found[at], null[at] = _rounded(values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, matrix.shape[1])[whole], matrix, digits)
        distance = pa.array(found.ravel(), pa.float64(), mask=null.ravel())
        return pa.record_batch([names.take(pa.array(np.tile(np.arange(m), n))), keys.take(pa.array(np.repeat(np.arange(n), m))), distance], ["query_id", "key", "distance"])

    id_type = to_arrow_type(queries.schema["query_id"].dataType)
    dealt = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    tasks = -(-dealt.count() * asked // TASK_PAIRS)
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, `key` {rows.schema[key].dataType.simpleString()}, distance double"
    return (dealt.repartition(tasks) if tasks > 1 else dealt).mapInArrow(meet, kinds).withColumnRenamed("key", key)


def ranked(pairs: DataFrame, k: int, key: str) -> DataFrame:
    """The k pairs (``query_id``, key, ``distance``) at the least distance of each query, ties by key, with their ``place``."""
    best = Window.partitionBy("query_id").orderBy("distance", key)
    # a first cut within hash slices of the rows keeps any query's rows out of one task
    sliced = Window.partitionBy("query_id", "slice").orderBy("distance", key)
    near = pairs.filter(F.col("distance").isNotNull()).select("query_id", key, "distance").withColumn("slice", F.pmod(F.xxhash64(key), F.lit(64)))
    near = near.withColumn("place", F.row_number().over(sliced)).filter(F.col("place") <= k)
    return near.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).select("query_id", key, "distance", "place")


#: What a query without any hit is told.
NO_CONTEXT = "No relevant source context found in the knowledge database."


def answerable(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """``query_id, n_hits, problem`` of all queries: one without hits is refused, as no answer could be grounded."""
    counts = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"))
    told = queries.select("query_id").join(counts, "query_id", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    return told.withColumn("problem", F.when(F.col("n_hits") == 0, NO_CONTEXT))


def nearest_of_owner(queries: DataFrame, rows: DataFrame, k: int, key: str, vector: str = "embedding", owner: str = "user_id", block: int = 4096) -> DataFrame:
    """For each query the k nearest rows of its own owner, ties by key.

    Queries (``query_id``, ``owner``, ``query_vector``) and rows are cut into blocks of about ``block``
    by a hash, within their owner; every block of an owner's queries meets every block of the owner's
    rows in a group of its own, so an owner of any share of the rows spreads over tasks. A block gives k rows a query, which
    are ranked. Null owners are an owner of their own; filter what has expired before.
    """
    cut = lambda df, by: df.withColumn("of", F.col(owner).cast("string")).withColumn("hash", F.xxhash64(by))
    asked = cut(queries.select("query_id", owner, "query_vector"), "query_id")
    held = cut(rows.select(F.col(key).alias("key"), owner, F.col(vector).cast("array<double>").alias("vector")), "key")
    many = lambda df, name: df.groupBy("of").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    blocks = many(asked, "query_blocks").join(many(held, "row_blocks").withColumnRenamed("of", "row_of"), F.col("of").eqNullSafe(F.col("row_of"))).drop("row_of")
    blocks = table(blocks, "owners")  # a row an owner
    sized = small_by_count(blocks)
    same = lambda df: df.join(sized.withColumnRenamed("of", "b_of"), F.col("of").eqNullSafe(F.col("b_of"))).drop("b_of")
    own_block = lambda n: F.pmod("hash", F.col(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = same(asked).withColumns({"query_block": own_block("query_blocks")}).withColumn("row_block", others("row_blocks"))
    b = same(held).withColumns({"row_block": own_block("row_blocks")}).withColumn("query_block", others("query_blocks"))
    names = [F.coalesce("of", F.lit("")).alias("of"), F.col("of").isNull().alias("none"), "query_block", "row_block"]
    a, b = a.select(*names, "query_id", "query_vector"), b.select(*names, "key", "vector")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = right.schema.field("key").type
        vectors = left["query_vector"].to_pylist()
        parts = []
        for length in sorted({len(v) for v in vectors if v is not None}):
            alike = [i for i, v in enumerate(vectors) if v is not None and len(v) == length]
            best = Best(np.array([vectors[i] for i in alike], float), k)
            for batch in right.select(["key", "vector"]).to_batches():
                best.add(batch.column(0), batch.column(1))
            ids = left["query_id"].to_pylist()
            if (found := best.record([ids[i] for i in alike], kind)) is not None:
                parts.append(found.cast(pa.schema([("query_id", left.schema.field("query_id").type), ("key", kind), ("distance", pa.float64())])))
        return pa.Table.from_batches(parts) if parts else pa.table({"query_id": pa.array([], left.schema.field("query_id").type), "key": pa.array([], kind), "distance": pa.array([], pa.float64())})

    on = ["of", "none", "query_block", "row_block"]
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, `key` {rows.schema[key].dataType.simpleString()}, distance double"
    found = a.groupBy(on).cogroup(b.groupBy(on)).applyInArrow(meet, kinds).withColumnRenamed("key", key)
    best = Window.partitionBy("query_id").orderBy("distance", key)
    return found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)


def recalled(queries: DataFrame, memories: DataFrame, now: Column, k: int = 5, most: float | None = None, key: str = "memory_id", text: str = "memory_text", owner: str = "user_id") -> DataFrame:
    """Each query's nearest live memories of its owner as one block of bullets: ``query_id``, ``keys``, ``block``.

    Live rows have no ``expires_at`` or one after ``now``; with ``most`` only those within that distance count. A query without any has no row.
    """
    live = memories.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now)) if "expires_at" in memories.columns else memories
    near = nearest_of_owner(queries, live, k, key, owner=owner)
    near = near.filter(F.col("distance") <= most) if most is not None else near
    told = near.join(live.select(key, text), key)
    each = F.array_sort(F.collect_list(F.struct("place", F.col(key).alias("key"), F.concat(F.lit("- "), text).alias("line"))))  # k rows
    return told.groupBy("query_id").agg(each.alias("all")).select("query_id", F.transform("all", lambda x: x["key"]).alias("keys"), F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("block"))


def semantic_hits(queries: DataFrame, cached: DataFrame, now: Column, most: float = 0.15, key: str = "cache_id", owner: str = "user_id", allowed: DataFrame | None = None, sources: str = "sources") -> DataFrame:
    """The nearest live cached answer of each query's owner, if near enough: ``query_id``, key, ``distance``.

    The distance counts after the nearest is taken. With ``allowed`` (``doc_uuid``) a hit counts only
    if all the documents its answer cites are among them.
    """
    live = cached.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    near = nearest_of_owner(queries, live, 1, key, owner=owner).filter(F.col("distance") <= most).drop("place")
    if allowed is None:
        return near
    cited = near.join(live.select(key, sources), key)
    bad = cited.select("query_id", F.explode(sources).alias("doc_uuid")).join(allowed.select("doc_uuid").distinct(), "doc_uuid", "left_anti")
    return near.join(bad.select("query_id").distinct(), "query_id", "left_anti")


def nearest_within(queries: DataFrame, rows: DataFrame, most: float, key: str, vector: str = "embedding") -> DataFrame:
    """The nearest row of each query, if its distance is at most ``most``."""
    return nearest(queries, rows, 1, key, vector).filter(F.col("distance") <= most)


def keyword_hits(rows: DataFrame, text: str, k: int, order: list[str], content: str = "content") -> DataFrame:
    """The first k rows that hold the text in any case."""
    hits = rows.filter(any_term(content, [text.lower()])).orderBy(*order).limit(k)
    return hits.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # k rows


def keyword_hits_each(queries: DataFrame, rows: DataFrame, k: int, order: list[str], key: str = "chunk_id", content: str = "content") -> DataFrame:
    """For each query (``query_id``, ``query_text``) the first k rows that hold its text in any case; none for null and empty texts.

    Queries are broadcast when counted few. Only k rows a query and hash slice get to the last ranking.
    """
    asked = queries.filter("query_text <> ''").select("query_id", F.lower("query_text").alias("query_text"))
    few = asked.count() <= 10_000
    pairs = rows.crossJoin(F.broadcast(asked) if few else asked).filter(F.contains(F.lower(F.col(content)), F.col("query_text")))
    sliced, best = Window.partitionBy("query_id", "slice").orderBy(*order, key), Window.partitionBy("query_id").orderBy(*order, key)
    hits = pairs.select("query_id", *dict.fromkeys([key, *order])).withColumn("slice", F.pmod(F.xxhash64(key), F.lit(64)))
    hits = hits.withColumn("place", F.row_number().over(sliced)).filter(F.col("place") <= k)
    return hits.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).select("query_id", key, "place")


def fused(dense: DataFrame, sparse: DataFrame, k: int, key: str, constant: int = FUSION) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (``key``, ``place`` from 1); ties: dense list before sparse. With ``query_id`` in both, for each query."""
    return fused_lists([dense, sparse], k, key, constant)


def fused_lists(lists: list[DataFrame], k: int, key: str, constant: int = FUSION) -> DataFrame:
    """Reciprocal rank fusion of ranked lists; ties go to the earlier list, then the earlier place. With ``query_id`` in all, for each query."""
    each = ["query_id"] if all("query_id" in one.columns for one in lists) else []
    numbered = [one.select(*each, key, F.col("place").cast("int").alias("place"), F.lit(n).alias("list")) for n, one in enumerate(lists)]
    both = numbered[0]
    for one in numbered[1:]:
        both = both.unionByName(one)
    scored = both.groupBy(*each, key).agg(F.sum(1 / (constant + F.col("place"))).alias("score"), F.min(F.struct("list", "place")).alias("seen"))
    if not each:
        return scored.orderBy(F.desc("score"), "seen").limit(k).select(key, "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "seen"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", key, "score")


def hybrid(rows: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", candidates: int = 10) -> DataFrame:
    """For each query (``query_id``, ``query_vector``, ``query_text``) its dense and keyword candidates, fused: the best k with their rows."""
    dense = nearest(queries.select("query_id", "query_vector"), rows, candidates, key)
    sparse = keyword_hits_each(queries, rows, candidates, ["doc_uuid", "chunk_index"], key)
    best = fused(dense, sparse, k, key)
    return rows.join(F.broadcast(best) if queries.count() <= 10_000 else best, key)


def tokens(rows: DataFrame, key: str, content: str) -> DataFrame:
    words = F.explode(F.split(F.lower(F.col(content)), r"[^\p{L}\p{N}]+"))
    return rows.select(key, words.alias("word")).filter("word <> ''")


def bm25(rows: DataFrame, terms: list[str], key: str, content: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best rows by BM25 over an inverted index made on the fly; only query words leave the tokenising tasks."""
    words = tokens(rows, key, content)
    wanted = sorted({t.lower() for t in terms})
    sizes = words.groupBy(key).agg(F.count("*").alias("size"), *(F.count_if(F.col("word") == t).alias(f"tf{n}") for n, t in enumerate(wanted)))
    corpus = sizes.agg(F.avg("size").alias("mean"), *(F.count_if(F.col(f"tf{n}") > 0).alias(f"df{n}") for n in range(len(wanted))))
    corpus = corpus.crossJoin(rows.agg(F.count("*").alias("rows")))
    score = F.lit(0.0)
    for n in range(len(wanted)):
        tf, df = F.col(f"tf{n}"), F.col(f"df{n}")
        idf = F.log(1 + (F.col("rows") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    return sizes.crossJoin(F.broadcast(corpus)).select(key, score.alias("score")).filter("score > 0").orderBy(F.desc("score"), key).limit(k)


def with_documents(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Each row with its document's title, author, language and publisher, defaults where there is none."""
    known = docs.select("doc_uuid", *(F.col(c).alias(f"doc_{c}") for c in ("title", "author", "language", "publisher", "publication_year", "license_type", "doi")))
    unknown = {"title": "Unknown", "author": "Unknown", "language": "Unknown", "publisher": "", "publication_year": "", "license_type": "", "doi": ""}
    joined = rows.join(known, "doc_uuid", "left")
    return joined.withColumns({f"doc_{c}": filled(f"doc_{c}", d) for c, d in unknown.items()})


def block(number: Column) -> Column:
    """A context block: a header of what is known of the source, then the content."""
    part = lambda name, c, *blank: F.when(~F.coalesce(c.cast("string"), F.lit("")).isin("", *blank), F.concat(F.lit(f"{name}: "), c.cast("string")))
    inner = F.concat_ws(
        ", ",
        F.concat(F.lit("Lang: "), F.col("doc_language")),
        F.concat(F.lit("Author: "), F.col("doc_author")),
        part("Page", F.col("page_number")),
        part("Chapter", F.col("chapter_title")),
        part("Publisher", F.col("doc_publisher"), "Unknown"),
        part("Year", F.col("doc_publication_year")),
        part("License", F.col("doc_license_type"), "Unknown"),
        part("DOI", F.col("doc_doi")),
    )
    return F.concat(F.lit("--- BLOCK "), number.cast("string"), F.lit(" [Source: "), F.col("doc_title"), F.lit(" ("), inner, F.lit(")] ---\n"), F.col("content"))


def deep_link(doc_uuid: str, anchor: str, page: str) -> Column:
    target = F.coalesce(F.nullif(F.col(anchor), F.lit("")), F.concat(F.lit("page-"), F.coalesce(F.col(page), F.lit(1)).cast("string")))
    return F.concat(F.lit("/document/"), F.col(doc_uuid), F.lit("/#"), target)


def cache_key(actor: Column, text: Column) -> Column:
    return F.concat(F.lit("rag_search_cache:"), F.coalesce(actor, F.lit("anonymous")), F.lit(":"), F.sha2(F.lower(F.trim(text)), 256))


def hydrated(cached: DataFrame, docs: DataFrame, key: str = "id", sources: str = "sources") -> DataFrame:
    """Cached rows with their sources' titles in the order cited."""
    cited = cached.select(key, F.posexplode(sources).alias("at", "doc_uuid"))
    found = cited.join(docs.select("doc_uuid", "title"), "doc_uuid", "left")
    listed = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "doc_uuid", filled("title", "Unknown").alias("title")))).alias("cited"))
    return cached.join(listed, key, "left")


def prices_matched(models: DataFrame, prices: DataFrame) -> DataFrame:
    """A price row for each model: equal ids, else equal last path segments, else one inside the other; first in price order.

    Prices are a catalog of models, broadcast when counted small.
    """
    model, price = F.lower("model"), F.lower("price_model")
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    level = F.when(model == price, 1).when((model == price) | (model == last(price)), 2).when(model.contains(price) | price.contains(model) | price.contains(last(model)), 3)
    listed = prices.withColumnRenamed("model", "price_model")
    pairs = models.crossJoin(F.broadcast(listed) if listed.count() <= 100_000 else listed).withColumn("level", level).filter("level is not null")
    best = pairs.groupBy("model").agg(F.min(F.struct("level", "pos", "price_model", "prompt", "completion")).alias("best"))
    return models.join(best, "model", "left").select(models.columns + [F.col("best")[c].alias(c) for c in ("level", "price_model", "prompt", "completion")])
