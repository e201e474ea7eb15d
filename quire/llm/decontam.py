"""Benchmark decontamination by pigeonhole edit matching.

A test item that occurs in a document with at most ``k`` edits, cut into ``k + 1`` pieces, leaves
one piece unharmed. One Aho-Corasick automaton finds all pieces of a block of items in one pass
over a text; around each hit, Myers' bit-parallel distance (one integer as bit vector) decides.
Items are taken in blocks of bounded size: only one is in the driver and in a plan at a time, and
what it found is written before the next, so any benchmark fits. Texts never move: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import ascii_words, table, text_batches, text_of

#: Edits per character of an item that still count as the item.
RATE = 0.05
#: Items of fewer words that are also too short for an edit are searched exactly, between boundaries.
FEWEST_WORDS = 5
#: Characters of items broadcast at a time (on average; each block is one pass over the documents).
BLOCK_CHARS = 4_000_000


def plain(text: str | None) -> str:
    """Lower case, words of letters and digits joined by single spaces."""
    return b" ".join(ascii_words((text or "").lower())).decode("utf-8", "surrogatepass")


def _of_words(letter: str) -> bool:
    """A letter or digit of a script that parts words by spaces."""
    unspaced = "\u0e00" <= letter <= "\u0eff" or "\u1000" <= letter <= "\u109f" or "\u1780" <= letter <= "\u17ff" or "\u2e80" <= letter <= "\u9fff" or "\uf900" <= letter <= "\ufaff"
    return letter.isalnum() and not unspaced and letter < "\U00020000"


def bounded(text: str, a: int, b: int) -> bool:
    """Whether neither end of ``text[a:b]`` is inside a word; scripts without spaces have no such inside."""
    return not any(0 < at < len(text) and _of_words(text[at - 1]) and _of_words(text[at]) for at in (a, b))


def pieces_of(item: str, rate: float) -> tuple[int, list[tuple[int, str]]]:
    """The error budget and its ``budget + 1`` pieces with their places."""
    budget = int(len(item) * rate)
    ends = [len(item) * (n + 1) // (budget + 1) for n in range(budget + 1)]
    return budget, [(a, item[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


def masks_of(item: str) -> dict[str, int]:
    """For each letter the places that it has in the item, as bits."""
    masks: dict[str, int] = {}
    for i, letter in enumerate(item):
        masks[letter] = masks.get(letter, 0) | 1 << i
    return masks


def edit_match(item: str, masks: dict[str, int], text: str, most: int, anchored: bool = False) -> tuple[int, int] | None:
    """Least edits between the item and any part of ``text`` (if ``anchored``, of those at its start), and where that part ends; None if over ``most``."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, (min(m, most + 1), 0)
    for end, letter in enumerate(text, 1):
        equal = masks.get(letter, 0)
        x = equal | minus
        d = ((equal & plus) + plus ^ plus) | x
        h_plus, h_minus = minus | ~(d | plus), plus & d
        if h_plus & top:
            score += 1
        elif h_minus & top:
            score -= 1
        if score < best[0]:
            best = (score, end)
        h_plus, h_minus = h_plus << 1 | anchored, h_minus << 1
        plus, minus = (h_minus | ~(d | h_plus)) & full, h_plus & d & full
    return best if best[0] <= most else None


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.pieces = ahocorasick.Automaton()
        self.items = []
        found: dict[str, list[tuple[int, int]]] = {}
        for key, item in items:
            budget, parts = pieces_of(item, rate)
            for at, part in parts:
                found.setdefault(part, []).append((len(self.items), at))
            self.items.append((key, item, masks_of(item), budget))
        for part, places in found.items():
            self.pieces.add_word(part, (len(part), places))
        if found:
            self.pieces.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """``(item id, edits, first, last)`` of each item in a plain text, places from its best part."""
        starts: dict[int, list[int]] = {}
        for end, (size, places) in self.pieces.iter(text) if len(self.pieces) else ():
            for n, at in places:
                starts.setdefault(n, []).append(end + 1 - size - at)
        out = []
        for n, where in starts.items():
            key, item, masks, budget = self.items[n]
            best = None
            if not budget and item.count(" ") < FEWEST_WORDS - 1:
                ends = [a + len(item) for a in sorted(where) if bounded(text, a, a + len(item))]
                out += [(key, 0, ends[0] - len(item), ends[0])] if ends else []
                continue
            for start, last in windows(sorted(set(where)), budget):
                a, b = max(0, start - budget), last + len(item) + budget
                part = text[a:b]
                if item in part:
                    best = (0, a + part.index(item) + len(item))
                    break
                got = edit_match(item, masks, part, budget)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], a + got[1])
            if best:
                out.append((key, best[0], match_start(item, text, *best), best[1]))
        return out


def windows(starts: list[int], budget: int) -> Iterator[tuple[int, int]]:
    """First and last of the starts that one window holds; each start is in one."""
    first = starts[:1]
    for a, b in pairwise(starts):
        if b > first[0] + budget:
            yield first[0], a
            first = [b]
    if first:
        yield first[0], starts[-1]


def match_start(item: str, text: str, edits: int, end: int) -> int:
    """Where the part of ``text`` begins that ends at ``end`` and is so many edits from the item: the item is matched backwards from there."""
    if not edits:
        return end - len(item)
    back = item[::-1]
    got = edit_match(back, masks_of(back), text[max(0, end - len(item) - edits) : end][::-1], edits, anchored=True)
    return end - got[1]


def item_blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Ids and plain texts of the items, in blocks of about ``block_chars`` characters by a hash; items without a letter or digit are left out."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of("text").alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    for n in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n).collect()
        some = [(r[0], plain(r[1])) for r in rows]
        yield [i for i in some if i[1]]


def skipped_items(benchmark: DataFrame) -> DataFrame:
    """``item_id`` of the items that are not searched: null ones, and those whose plain form is empty."""
    empty = F.pandas_udf(lambda texts: pd.Series([not plain(t) for t in texts], dtype=bool), "boolean")
    return benchmark.filter(empty(F.col("text").cast("string"))).select(F.col("item_id").cast("long").alias("item_id"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, edits, first_char, last_char``: one row per document and item found in it.

    Places are in the plain form of the text. Documents without an item have no row; null and empty
    texts hold none; items whose plain form is empty are left out (``skipped_items``), those of under
    FEWEST_WORDS words that allow no edit are found between word boundaries only; repeated rows are reported each. An empty benchmark gives no rows.
    """
    texts = text_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, edits int, first_char long, last_char long"
    found = (texts.mapInArrow(_finder(some, rate), schema) for some in item_blocks(benchmark, block_chars))
    first = next(found)
    return reduce(DataFrame.unionByName, (table(f, "hits") for f in found), first)


def _finder(items: list[tuple[int, str]], rate: float):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, rate)
        for batch in (b.slice(i, 200) for b in batches for i in range(0, b.num_rows, 200)):
            rows = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in matcher.find(plain(text))]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "edits", "first_char", "last_char"])

    return find


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item of the benchmark is found.

    Null and empty texts hold no item and stay, as do all rows if the benchmark is empty; repeated rows
    stand or fall together. What a block leaves is written before the next block is read.
    """
    docs = text_batches(docs)
    for n, some in enumerate(item_blocks(benchmark, block_chars)):
        docs = (table(docs, "left") if n else docs).filter(~_holds(some, rate)(F.col(text_col).cast("string")))
    return docs


def _holds(items: list[tuple[int, str]], rate: float):
    @F.arrow_udf("boolean")
    def holds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(items, rate)
        for texts in batches:
            yield pa.array([bool(matcher.find(plain(t))) for i in range(0, len(texts), 200) for t in texts.slice(i, 200).to_pylist()], pa.bool_())

    return holds
