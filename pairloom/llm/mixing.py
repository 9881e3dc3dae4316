"""Mixes of sources with wanted token shares, by min-cost flow over membership patterns.

Documents with the same text are one unit; the set of sources it comes from is its pattern. Units are aggregated by
pattern, and a small network is solved on the driver: the tokens of a pattern, once for every use (the k-th use of a
unit costs k - 1, so repetition is spread evenly and comes last), flow to the quotas of its sources. The mix is the
largest in which every source that has documents reaches its share exactly; the selection follows the flow.

As only the uses cost something, filling the quotas use by use, cheapest first, gives the flow of least cost. Patterns
that reach the same sources are one node, and paths run over sources only, so tens of thousands of patterns are no
matter. The largest total comes from the cuts: a set of sources that stays short names the total it allows, and a few
such steps end at the largest feasible one.

A pattern's units stand in a seeded order by their tokens; a flow takes a stretch of that order, so a share is met to
within one unit a stretch. The order is cut into buckets whose totals are aggregated first, so no pattern, however
large, is sorted in one task.

Defined results: documents without source, text or tokens are in no mix; a source with weight 0, or without documents,
has no quota and its share goes to the others in proportion; negative and null weights count as 0; a unit that two
sources hold is used for either, each time once; max_repeats below 1 or null excludes the source.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.tokenizer import VOCABULARY, with_token_count
from pairloom.scratch import spool

BUCKETS = 1024

Flow = list[tuple[frozenset[str], int, str, int]]


class Filling:
    """Tokens of nodes (sets of sources they may serve) assigned to the quotas of sources, node after node."""

    def __init__(self, quota: dict[str, int]) -> None:
        self.short = dict(quota)
        self.given: list[tuple[frozenset[str], dict[str, int]]] = []  # reach of a node, and tokens a source
        self.holds: dict[tuple[str, str], dict[int, None]] = defaultdict(dict)  # (a, b): nodes that serve a and may serve b
        self.closed: set[str] = set()  # sources from which nothing can be passed on to one that is short

    def _add(self, node: int, source: str, amount: int) -> None:
        reach, given = self.given[node]
        given[source] = given.get(source, 0) + amount
        for other in reach:
            if other != source:
                if given[source]:
                    self.holds[source, other][node] = None
                else:
                    self.holds[source, other].pop(node, None)

    def _path(self, start: list[str]) -> list[str] | None:
        """Sources from one of ``start`` to one that is short, each passing tokens on to the next."""
        came: dict[str, str | None] = dict.fromkeys(start)
        waiting = deque(start)
        while waiting:
            a = waiting.popleft()
            if self.short[a] > 0:
                path = [a]
                while (before := came[path[-1]]) is not None:
                    path.append(before)
                return path[::-1]
            for b in self.short:
                if b not in came and self.holds.get((a, b)):
                    came[b] = a
                    waiting.append(b)
        self.closed.update(came)
        return None

    def pour(self, reach: frozenset[str], tokens: int) -> None:
        """Give a node's tokens to its sources as far as anything is short."""
        self.given.append((reach, {}))
        node, start = len(self.given) - 1, sorted(reach - self.closed)
        while tokens and start and (path := self._path(start)):
            movers = [next(iter(self.holds[a, b])) for a, b in zip(path, path[1:])]
            amount = min([tokens, self.short[path[-1]], *(self.given[m][1][a] for m, a in zip(movers, path))])
            self._add(node, path[0], amount)
            for m, a, b in zip(movers, path, path[1:]):
                self._add(m, a, -amount)
                self._add(m, b, amount)
            self.short[path[-1]] -= amount
            tokens -= amount

    def cut(self) -> set[str]:
        """The sources that stay short, with those that could only help them by what they lack themselves."""
        found = {s for s, n in self.short.items() if n > 0}
        waiting = deque(found)
        while waiting:
            b = waiting.popleft()
            for a in self.short:
                if a not in found and self.holds.get((a, b)):
                    found.add(a)
                    waiting.append(a)
        return found


def solve(patterns: dict[frozenset[str], int], weights: dict[str, float], repeats: dict[str, int], total: int | None = None) -> tuple[int, Flow]:
    """The mix's tokens and the flow: (pattern, use, source, tokens), for the largest feasible total or ``total``."""
    held = {s for p, size in patterns.items() if size > 0 for s in p}
    wanted = {s: w for s, w in weights.items() if w and w > 0 and s in held and (repeats.get(s) or 0) >= 1}
    scale = sum(wanted.values())
    if not wanted:
        return 0, []
    # One node a use and set of sources that it may serve; uses in order, as they cost.
    members: dict[tuple[int, tuple[str, ...]], list[tuple[frozenset[str], int]]] = defaultdict(list)
    for p, size in sorted(patterns.items(), key=lambda x: sorted(x[0])):
        own = [s for s in sorted(p) if s in wanted and size > 0]
        for use in range(1, max((repeats[s] for s in own), default=0) + 1):
            members[use, tuple(s for s in own if repeats[s] >= use)].append((p, size))
    nodes = sorted((use, reach, sum(size for _, size in held_by)) for (use, reach), held_by in members.items())

    def quota(tokens: int) -> dict[str, int]:
        return {s: int(tokens * w / scale) for s, w in wanted.items()}

    def allowed(sources: set[str], upto: int) -> int:
        """The largest total whose quotas of ``sources`` do not exceed all that can serve them."""
        room = sum(size for _, reach, size in nodes if not sources.isdisjoint(reach))
        low, high = 0, upto
        while low < high:
            middle = (low + high + 1) // 2
            q = quota(middle)
            low, high = (middle, high) if sum(q[s] for s in sources) <= room else (low, middle - 1)
        return low

    best = sum(size for _, _, size in nodes) + len(wanted)
    if total is not None:
        best = min(best, total)
    best = allowed(set(wanted), best)
    while True:
        filling = Filling(quota(best))
        for _, reach, size in nodes:
            filling.pour(frozenset(reach), size)
        if not (short := filling.cut()):
            break
        best = allowed(short, best)
    flow: Flow = []
    for (use, reach, _), (_, given) in zip(nodes, filling.given):
        # The node's tokens go to its patterns in order.
        parts = iter(members[use, reach])
        p, left = next(parts)
        for s in sorted(given):
            amount = given[s]
            while amount:
                if not left:
                    p, left = next(parts)
                taken = min(amount, left)
                flow.append((p, use, s, taken))
                amount, left = amount - taken, left - taken
    return best, flow


def mix(documents: DataFrame, targets: DataFrame, seed: int = 0, total: int | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """The documents of every mix: mix_name, source, doc_id, copies, tokens (of one copy); stored inputs, lazy result.

    ``documents``: doc_id, text, source; ``targets``: mix_name, source, weight, max_repeats (a configuration table; it
    is read by the driver). The unit that several documents of a source share stands under the smallest doc_id.
    """
    counted = with_token_count(documents.where("source is not null and text is not null").select("doc_id", "source", "text"), "text", vocabulary=vocabulary)
    held = counted.where("tokens > 0").groupBy(F.md5("text").alias("unit"), "source").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
    units = held.groupBy("unit").agg(F.max("tokens").alias("tokens"), F.array_sort(F.collect_list(F.struct("source", "doc_id"))).alias("members"))
    units = units.withColumn("pattern", F.transform("members", lambda m: m["source"])).withColumn("bucket", F.pmod(F.xxhash64("unit", F.lit(seed)), F.lit(BUCKETS)).cast("int"))
    units = spool(units, "mix-units")

    sums = units.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("size"))
    offsets = sums.withColumn("offset", F.sum("size").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("size"))
    inner = Window.partitionBy("pattern", "bucket").orderBy(F.xxhash64("unit", F.lit(seed + 1)), "unit")
    placed = units.join(offsets.select("pattern", "bucket", "offset"), ["pattern", "bucket"]).withColumn("start", F.col("offset") + F.sum("tokens").over(inner) - F.col("tokens"))

    sizes = sums.groupBy("pattern").agg(F.sum("size").alias("size")).collect()  # one row a combination of sources
    # In a fixed order: several flows can cost the same, and the one found must not depend on the order of arrival.
    patterns = {frozenset(r["pattern"]): r["size"] for r in sorted(sizes, key=lambda r: r["pattern"])}
    wanted: dict[str, dict[str, tuple[float, int]]] = defaultdict(dict)
    for r in targets.where("mix_name is not null and source is not null").collect():
        wanted[r["mix_name"]][r["source"]] = (r["weight"] if r["weight"] and r["weight"] > 0 else 0.0, r["max_repeats"] or 0)
    stretches = []
    for name, sources in sorted(wanted.items()):
        _, flow = solve(patterns, {s: w for s, (w, _) in sources.items()}, {s: m for s, (_, m) in sources.items()}, total)
        reached: dict[tuple, int] = defaultdict(int)
        for p, use, s, amount in sorted(flow, key=lambda x: (sorted(x[0]), x[1], x[2])):
            begin = reached[p, use]
            reached[p, use] += amount
            stretches.append((name, sorted(p), s, begin, begin + amount))
    spark = documents.sparkSession
    table = spark.createDataFrame(stretches, "mix_name string, pattern array<string>, source string, begin bigint, finish bigint")
    # A unit belongs to the stretch in which its middle lies.
    middle = F.col("start") + F.floor(F.col("tokens") / 2)
    taken = placed.join(table, "pattern").where((middle >= F.col("begin")) & (middle < F.col("finish")))
    own = F.filter("members", lambda m: m["source"] == F.col("source"))
    return taken.groupBy("mix_name", "source", "unit").agg(F.count("*").cast("int").alias("copies"), F.first("tokens").alias("tokens"), F.first(F.element_at(own, 1)["doc_id"]).alias("doc_id")).select("mix_name", "source", "doc_id", "copies", "tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """What every mix reached: mix_name, source, wanted_share, tokens, actual_share, documents, most_copies."""
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)
    want = targets.where("mix_name is not null and source is not null").select("mix_name", "source", weight.alias("w"))
    want = want.withColumn("wanted_share", F.col("w") / F.sum("w").over(Window.partitionBy("mix_name"))).drop("w")
    got = mixed.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    out = want.join(got, ["mix_name", "source"], "left").na.fill(0, ["tokens", "documents", "most_copies"])
    return out.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy("mix_name"))), F.lit(0.0))).select(
        "mix_name", "source", "wanted_share", "tokens", "actual_share", "documents", "most_copies"
    )
