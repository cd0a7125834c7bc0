"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern and by bucket of a seeded hash, which
is all that the driver sees: a row per pattern. A flow then routes the patterns' words to the
sources' targets. A pattern can pass on its words once at cost 0, a second time at cost 1 and so on (convex repetition
costs), so that fresh words are used up before any is repeated. The flow of a pattern becomes
cuts on a line that holds the pattern's documents in hash order, once for each repetition; a document's copy is
taken for the source in whose stretch its middle falls. Running sums need no task with a whole source:
buckets are summed first, and rows are only ordered within a bucket.

Free style: DataFrames, with the flow itself in plain Python on the driver, over patterns and sources alone.

Defined results: a null text has size 0, a null source is a source of its own and last, rows that repeat are
documents of their own, sources without words get and give nothing, an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, small

#: Buckets of a pattern's documents, as bits of the hash: at least so many, and so many that a bucket has about PER_BUCKET rows at most.
BITS, PER_BUCKET = 10, 50_000


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words each source should give: shares by weight, no more than most times a source's size, the excess shared again.

    Sources take the weights in code point order, null last.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        rest = total - sum(most * sizes[s] for s in full)
        unit = rest / w if (w := sum(weight[s] for s in free)) else 0.0
        over = {s for s in free if unit * weight[s] > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s] if s in full else unit * weight[s]) for s in order}
        full |= over


def route(patterns: dict[tuple, int], quotas: dict[str | None, float], epochs: int) -> dict[tuple, dict[str | None, int]]:
    """Words that each pattern gives each source: a flow that meets the quotas as far as it can, at the least cost.

    Successive shortest paths with potentials; each pattern has one arc from the start per epoch, at that epoch's cost.
    """
    names = list(patterns)
    sources = sorted({s for p in names for s in p}, key=lambda s: (s is None, s or ""))
    n, end = len(names) + len(sources) + 2, len(names) + len(sources) + 1
    graph: list[list[int]] = [[] for _ in range(n)]
    to, left, cost = [], [], []

    def arc(u: int, v: int, room: int, price: int) -> int:
        for a, b, r, c in ((u, v, room, price), (v, u, 0, -price)):
            graph[a].append(len(to))
            to.append(b)
            left.append(r)
            cost.append(c)
        return len(to) - 2

    at = {s: len(names) + 1 + k for k, s in enumerate(sources)}
    flows = {}
    for k, p in enumerate(names, 1):
        for e in range(epochs):
            arc(0, k, patterns[p], e)
        for s in dict.fromkeys(p):
            flows[p, s] = arc(k, at[s], epochs * patterns[p], 0)
    for s in sources:
        arc(at[s], end, round(quotas[s]), 0)
    height = [0] * n
    while True:
        dist, by, queue = [float("inf")] * n, [-1] * n, [(0, 0)]
        dist[0] = 0
        while queue:
            d, u = heapq.heappop(queue)
            if d > dist[u]:
                continue
            for i in graph[u]:
                if left[i] and (x := d + cost[i] + height[u] - height[to[i]]) < dist[to[i]]:
                    dist[to[i]], by[to[i]] = x, i
                    heapq.heappush(queue, (x, to[i]))
        if by[end] < 0:
            return {p: {s: left[flows[p, s] ^ 1] for s in dict.fromkeys(p)} for p in names}
        height = [h + (d if d < float("inf") else 0) for h, d in zip(height, dist, strict=True)]
        path, v = [], end
        while v:
            path.append(by[v])
            v = to[by[v] ^ 1]
        room = min(left[i] for i in path)
        for i in path:
            left[i] -= room
            left[i ^ 1] += room


def bucket_bits(rows: int) -> int:
    """Bits for so many rows, should one pattern have them all. The result of a mix doesn't depend on them: buckets only cut the order by hash."""
    return max(BITS, (rows // PER_BUCKET).bit_length())


def mix(docs: DataFrame, size: Column, member: Column, seed: int = 42, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, key: str = "doc_id") -> DataFrame:
    """docs with __size, __sources (its pattern: total words and target of each source) and __copies (source, epoch), one entry for each time it is taken.

    member is an array of the document's sources, null if it has none. docs is read twice, and counted.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    mark = F.xxhash64(F.col(f"`{key}`"), F.lit(seed))
    bits = bucket_bits(docs.count())
    pattern = F.coalesce(member, F.array().cast("array<string>")).alias("__pattern")
    sized = docs.select(*own, size.cast("long").alias("__size"), pattern, mark.alias("__mark"), F.shiftrightunsigned(mark, 64 - bits).cast("int").alias("__bucket"))
    sums = cut(sized.groupBy("__pattern", "__bucket").agg(F.sum("__size").alias("sum")))
    # one row a pattern comes to the driver
    patterns = {tuple(r[0]): int(r[1] or 0) for r in sums.groupBy("__pattern").agg(F.sum("sum")).collect()}
    sizes: dict[str | None, int] = {}
    for p, n in patterns.items():
        for s in dict.fromkeys(p):
            sizes[s] = sizes.get(s, 0) + n
    quotas = targets(sizes, weights, share, most)
    given = route(patterns, quotas, most)
    rows = []
    for p, flow in given.items():
        order = list(flow)
        ends = list(accumulate(flow[s] for s in order))
        rows.append((list(p), patterns[p], [(s, e) for s, e in zip(order, ends, strict=True)], [(s, sizes[s], quotas[s]) for s in order]))
    spark = docs.sparkSession
    schema = "__p array<string>, __total long, __cuts array<struct<source: string, end: long>>, __sources array<struct<source: string, size: long, target: double>>"
    plan = spark.createDataFrame(rows, schema)
    # a bucket's start on its pattern's line
    starts = spark.createDataFrame([], "__p array<string>, __b int, __start long") if not rows else before(sums)
    from pyspark.sql import Window

    # sums within the bucket first: the join then finds rows dealt and sorted by its keys, and texts move once
    w = Window.partitionBy("__pattern", "__bucket").orderBy("__mark", F.col(f"`{key}`"), "__size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = sized.withColumn("__middle", F.sum("__size").over(w) - F.col("__size") / 2)
    placed = summed.join(starts, (F.col("__pattern") == F.col("__p")) & (F.col("__bucket") == F.col("__b"))).drop("__p", "__b")
    placed = placed.withColumn("__middle", F.col("__start") + F.col("__middle")).drop("__start")
    joined = placed.join(small(plan), F.col("__pattern") == F.col("__p"))

    def copy(e: Column) -> Column:
        at = F.col("__middle") + e * F.col("__total")
        hit = F.filter("__cuts", lambda c: c["end"] >= at)
        return F.when(F.size(hit) > 0, F.struct(F.get(hit, 0)["source"].alias("source"), e.cast("int").alias("epoch")))

    copies = F.filter(F.transform(F.array(*map(F.lit, range(most))), copy), lambda c: c.isNotNull())
    return joined.select(*own, "__size", "__sources", F.when(F.col("__size") > 0, copies).otherwise(F.slice(copies, 1, 1)).alias("__copies"))


def before(sums: DataFrame) -> DataFrame:
    """(pattern, bucket, sum) to each bucket's start, the sum of those before it."""
    from pyspark.sql import Window

    w = Window.partitionBy("__pattern").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(F.col("__pattern").alias("__p"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("sum").over(w), F.lit(0)).alias("__start"))
