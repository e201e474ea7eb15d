"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources that hold them: words by pattern
are all that reaches the driver. There a flow routes each pattern's words to the quotas of its
sources. A pattern's words can be taken ``most`` times; each further repetition costs more (convex
costs), so no words are repeated where unseen ones of another pattern could fill a quota. Costs lie on
the arcs that leave the origin alone, and a cheapest augmenting path uses one of these: taking them by
rising cost, each time to a maximum flow, gives a flow of least cost among those of most words.

Documents are then selected in a seeded order: a pattern whose flow is ``p`` times its words and
``r`` more gives each document ``p`` times, and the first ``r`` words of the order once more (the last
of these documents in part). The order is a range-partitioned sort, so a pattern of any size spreads
over tasks, and running sums come from sums by partition.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import names_apart, small_or_shuffled, table, text_of

#: Membership patterns that the driver solves for; a mix is stated by weights of few sources.
PATTERNS = 100_000
SHARE, MOST, SEED = 1.5, 2, 13
#: White space between words.
WORD = r"[^\x20\x09-\x0D]+"
Source = str | None


def targets(sizes: dict[Source, int], weights: dict[Source, float], share: float = SHARE, most: float = MOST) -> dict[Source, float]:
    """``share`` of all words, dealt to the sources by weight; none above ``most`` times its size, the excess dealt again."""
    budget, open_ = share * sum(sizes.values()), dict(sizes)
    out: dict[Source, float] = {}
    while open_:
        whole = sum(weights[s] for s in open_)
        left = budget - sum(out.values())
        full = {s: float(most * n) for s, n in open_.items() if weights[s] * left > most * n * whole}
        if not full:
            return out | {s: weights[s] * left / whole if whole else 0.0 for s in open_}
        out |= full
        open_ = {s: n for s, n in open_.items() if s not in full}
    return out


def by_turns(sources: list[Source], turns: tuple[float, ...] = (3, 1, 2)) -> dict[Source, float]:
    """Weights in turn for the sources by code point, null last."""
    ordered = sorted(s for s in sources if s is not None) + [s for s in sources if s is None]
    return {s: turns[n % len(turns)] for n, s in enumerate(ordered)}


@dataclass
class Flow:
    """Words of each pattern routed to each of its sources."""

    patterns: list[tuple[Source, ...]]
    quotas: dict[Source, int]
    routed: list[dict[Source, int]] = field(default_factory=list)

    def __post_init__(self):
        self.routed = [dict.fromkeys(p, 0) for p in self.patterns]
        self.need = dict(self.quotas)
        self.holders: dict[Source, list[int]] = {}
        for i, p in enumerate(self.patterns):
            for s in p:
                self.holders.setdefault(s, []).append(i)

    def add(self, supply: dict[int, int]) -> dict[int, int]:
        """Routes as many of the patterns' words as can be; returns how many each gave."""
        left = dict(supply)
        while (level := self._levels(left)) is not None:
            tried: dict[object, int] = {}
            for i in list(left):
                while left[i] and (sent := self._send(i, left[i], level, tried)):
                    left[i] -= sent
        return {i: n - left[i] for i, n in supply.items()}

    def _levels(self, left: dict[int, int]) -> dict[object, int] | None:
        """Steps from patterns with supply over the residual graph; None where no quota can be reached."""
        level: dict[object, int] = {("p", i): 0 for i, n in left.items() if n}
        queue, reached = deque(level), False
        while queue:
            kind, x = at = queue.popleft()
            if kind == "s" and self.need.get(x, 0):
                reached = True
            ahead = [("s", s) for s in self.patterns[x]] if kind == "p" else [("p", i) for i in self.holders[x] if self.routed[i][x]]
            for node in ahead:
                if node not in level:
                    level[node] = level[at] + 1
                    queue.append(node)
        return level if reached else None

    def _send(self, start: int, most: int, level: dict[object, int], tried: dict[object, int]) -> int:
        """Words sent along one path of rising levels from a pattern to a source in need."""
        path: list[tuple[str, object]] = [("p", start)]
        while path:
            kind, x = at = path[-1]
            if kind == "s" and self.need.get(x, 0):
                sent = min(most, self.need[x], *(self.routed[p[1]][s[1]] for s, p in zip(path[1::2], path[2::2], strict=False)))
                self.need[x] -= sent
                for n, ((_, a), (_, b)) in enumerate(zip(path, path[1:], strict=False)):
                    if n % 2 == 0:
                        self.routed[a][b] += sent
                    else:
                        self.routed[b][a] -= sent
                return sent
            ahead = self.patterns[x] if kind == "p" else self.holders[x]
            other = "s" if kind == "p" else "p"
            for n in range(tried.get(at, 0), len(ahead)):
                tried[at] = n
                y = ahead[n]
                if level.get((other, y)) == level[at] + 1 and (kind == "p" or self.routed[y][x]):
                    path.append((other, y))
                    break
            else:
                tried[at] = len(ahead)
                path.pop()
                if path:
                    tried[path[-1]] = tried.get(path[-1], 0) + 1
        return 0


def routed(words: dict[tuple[Source, ...], int], quotas: dict[Source, int], most: int = MOST, cost: Callable[[tuple[Source, ...], int], float] = lambda _, n: n) -> Flow:
    """The flow of most words and, among those, of least cost; ``cost(pattern, n)`` of a word's n-th repetition (from 0) must not fall with n."""
    flow = Flow(list(words), quotas)
    arcs: dict[float, dict[int, int]] = {}
    for i, (pattern, n) in enumerate(words.items()):
        prices = [cost(pattern, r) for r in range(most)]
        if prices != sorted(prices):
            raise ValueError("repetitions must not become cheaper")
        for price in prices:
            supply = arcs.setdefault(price, {})
            supply[i] = supply.get(i, 0) + n
    for price in sorted(arcs):
        flow.add(arcs[price])
    return flow


@dataclass
class Plan:
    """What the mix asks of each source and takes of each pattern (its JSON form: the sorted sources)."""

    sizes: dict[Source, int]
    targets: dict[Source, float]
    words: dict[str, int]
    flow: dict[str, dict[Source, int]]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """``id, pattern, size, turn, row``, written once: the size in words, the pattern, and the seeded turn of each document."""
    held = F.col(source_col)
    if docs.schema[source_col].dataType.typeName() == "array":
        held = F.when(F.size(F.coalesce(held, F.array())) > 0, F.array_sort(F.array_distinct(held.cast("array<string>"))))
    else:
        held = F.array(held.cast("string"))
    pattern = F.to_json(F.coalesce(held, F.array(F.lit(None).cast("string"))))
    rows = docs.select(
        F.col(id_col).alias("id"),
        pattern.alias("pattern"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("turn"),
        F.monotonically_increasing_id().alias("row"),
    )
    return table(rows, "sizes")


def planned(sizes: DataFrame, weights: Callable[[list[Source]], dict[Source, float]] = by_turns, share: float = SHARE, most: int = MOST) -> Plan:
    """Targets and flow of a measured table; only its words by pattern, counted to be at most PATTERNS, are collected."""
    found = table(sizes.groupBy("pattern").agg(F.sum("size").alias("words")), "patterns")
    if found.count() > PATTERNS:
        raise ValueError(f"more than {PATTERNS} membership patterns: merge sources")
    words = dict(sorted((r["pattern"], r["words"]) for r in found.collect()))
    members = {p: tuple(json.loads(p)) for p in words}
    each: dict[Source, int] = {}
    for p, n in words.items():
        for s in members[p]:
            each[s] = each.get(s, 0) + n
    # words in several sources are dealt once
    asked = weights(list(each))
    dealt = targets(each, asked, share * sum(words.values()) / max(sum(each.values()), 1), most)
    flow = routed({members[p]: n for p, n in words.items()}, {s: int(t + 0.5) for s, t in dealt.items()}, most)
    return Plan(each, dealt, words, dict(zip(words, flow.routed, strict=True)))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Callable[[list[Source]], dict[Source, float]] = by_turns, share: float = SHARE, most: int = MOST, seed: int = SEED
) -> tuple[DataFrame, Plan]:
    """One row per row of ``docs``, id (by its name), ``pattern, size, passes, part, taken``, and the plan.

    ``source_col`` names a source or an array of them; a null, and an empty array, are a source of
    their own. A document is taken ``passes`` times whole and ``part`` words once more, ``taken`` in
    all, never more than ``most`` times its size. Null and empty texts have no words. Rows equal in id
    are in an order of their own; an empty table gives no rows. The same rows give the same result.
    """
    sizes = measured(docs, id_col, text_col, source_col, seed)
    plan = planned(sizes, weights, share, most)
    amounts = [(p, *divmod(sum(plan.flow[p].values()), n)) if n else (p, 0, 0) for p, n in plan.words.items()]
    taken = sizes.sparkSession.createDataFrame(amounts, "pattern string, passes long, rest long")  # at most PATTERNS rows
    # by size too: rows of one id change places, their sizes do not
    ordered = sizes.repartitionByRange("pattern", "turn", "size", "row").withColumn("at", F.spark_partition_id())
    ordered = table(ordered, "ordered")
    sums = ordered.groupBy("pattern", "at").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("pattern").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = table(sums.select("pattern", "at", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start")), "starts")
    within = Window.partitionBy("pattern", "at").orderBy("turn", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = ordered.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = small_or_shuffled(rows, starts, ["pattern", "at"], "inner", starts.count())
    part = F.least("size", F.greatest(F.col("rest") - F.col("start") - F.col("before"), F.lit(0))).cast("long")
    out = rows.join(F.broadcast(taken), "pattern").withColumn("part", part)
    names = names_apart(out.select(F.col("id").alias(id_col)), "pattern", "size", "passes", "part", "taken")
    taken_words = F.col("passes") * F.col("size") + F.col("part")
    return out.select(F.col("id").alias(id_col), *(c.alias(n) for c, n in zip([F.col("pattern"), F.col("size"), F.col("passes"), F.col("part"), taken_words], names, strict=True))), plan


def sources(plan: Plan, df: DataFrame) -> DataFrame:
    """``source, source_size, target, routed`` of the plan; at most as many rows as patterns have sources."""
    got: dict[Source, int] = {}
    for flows in plan.flow.values():
        for s, n in flows.items():
            got[s] = got.get(s, 0) + n
    return df.sparkSession.createDataFrame([(s, n, plan.targets[s], got.get(s, 0)) for s, n in plan.sizes.items()], "source string, source_size long, target double, routed long")
