"""Mixing overlapping sources to target weights by min-cost flow (operator 8)."""

from __future__ import annotations

import heapq
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.common import BLANK, Scratch, text_of

MOST = 3  #: a document is taken this many times at most


def targets(sizes: dict, weights: dict, total: float | None = None, most: int = MOST) -> dict:
    """Each source's share of `total` (default: all sizes) by weight, at most `most` times its size; what is cut off
    goes to the others by weight, until none is above."""
    total = float(sum(sizes.values()) if total is None else total)
    open_, out = set(sizes), {}
    while open_:
        weight = sum(weights[s] for s in open_)
        over = [s for s in open_ if total * weights[s] / weight > most * sizes[s]]
        if not over:
            out |= {s: total * weights[s] / weight for s in open_}
            break
        for s in over:
            out[s] = float(most * sizes[s])
            open_.discard(s)
        total -= sum(out[s] for s in over)
    return out


def route(patterns: dict[tuple, int], quotas: dict, most: int = MOST) -> dict[tuple, dict]:
    """Tokens that each pattern gives to each of its sources, by min-cost flow.

    `patterns`: tokens of the documents that belong to exactly these sources. Each pattern offers its tokens `most`
    times; the k-th time costs k - 1 a token, so repetition is spread before it is deepened. Successive shortest
    paths with potentials; a path is augmented by all it can carry.
    """
    names = list(patterns)
    sources = sorted(quotas, key=lambda s: (s is None, s or ""))
    first = {p: 1 + i for i, p in enumerate(names)}
    last = {s: 1 + len(names) + i for i, s in enumerate(sources)}
    sink = 1 + len(names) + len(sources)
    graph: list[list[int]] = [[] for _ in range(sink + 1)]
    to, room, cost = [], [], []

    def edge(a, b, capacity, price):
        for u, v, c, w in ((a, b, capacity, price), (b, a, 0, -price)):
            graph[u].append(len(to))
            to.append(v)
            room.append(c)
            cost.append(w)
        return len(to) - 2

    for p in names:
        for k in range(most):
            edge(0, first[p], patterns[p], k)
    link = {(p, s): edge(first[p], last[s], most * patterns[p], 0) for p in names for s in p if s in quotas}
    for s in sources:
        edge(last[s], sink, int(round(quotas[s])), 0)
    height = [0] * (sink + 1)
    while True:
        far = [None] * (sink + 1)
        via = [None] * (sink + 1)
        far[0], heap = 0, [(0, 0)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in graph[u]:
                if room[e] > 0:
                    nd = d + cost[e] + height[u] - height[to[e]]
                    if far[to[e]] is None or nd < far[to[e]]:
                        far[to[e]], via[to[e]] = nd, e
                        heapq.heappush(heap, (nd, to[e]))
        if far[sink] is None:
            break
        height = [h + (d if d is not None else far[sink]) for h, d in zip(height, far, strict=True)]
        path, v = [], sink
        while v:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    out: dict[tuple, dict] = {p: {} for p in names}
    for (p, s), e in link.items():
        out[p][s] = room[e ^ 1]
    return out


def weigh(sources: list, cycle=(5, 2, 1)) -> dict:
    """Weights for sources in code-point order, null last, from a repeating cycle."""
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: float(cycle[i % len(cycle)]) for i, s in enumerate(order)}


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", sources: str = "source", weights: dict | None = None,
        seed: int = 0) -> DataFrame:
    """Per row of `docs`: `id, h, key, size, copies, taken, source_size, target`.

    `sources` is a column with one source (null is a source of its own) or an array of them. Sizes are words. Documents
    are summed up by membership pattern, and only these sums come to the driver: as many as there are patterns, not
    documents. The flow says how many tokens of a pattern are taken; every document of it is taken as often as the
    whole multiple says, and a seeded choice once more for the rest, which is missed by half of the smallest other document at most.
    `source_size` and `target` are sums over the row's sources.

    The choice orders documents by a seeded hash of id and text and takes, in that order, each that still fits what is
    left of the rest; at the end one more, the smallest not taken, if that comes nearer. It is found in passes (`fill`),
    so a source of any size is no single task's work. Rows that are the same in id and text are chosen apart, in any
    order. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    light = scratch.keep(_sized(docs, id, text, sources, seed), "sizes")  # one pass over the texts; row numbers stay
    out = _chosen(light, scratch, weights)
    return out.select(F.col("id").alias(id), "h", "key", "size", "copies", (F.col("copies") * F.col("size")).alias("taken"),
                      "source_size", "target")


def _sized(docs: DataFrame, id: str, text: str, sources: str, seed: int, *others: Column) -> DataFrame:
    """What the choice needs of each row (id, pattern, size, h, row, key), and `others`."""
    many = dict(docs.dtypes)[sources].startswith("array")
    of = F.array_sort(F.array_distinct(F.coalesce(F.col(sources), F.array()))) if many else F.array(F.col(sources))
    words = F.regexp_count(text_of(text), F.lit(f"[^{BLANK}]+")).cast("long")
    light = docs.select(F.col(id).alias("id"), of.alias("pattern"), words.alias("size"),
                        F.xxhash64(F.lit(seed), F.col(id), text_of(text)).alias("h"),
                        F.monotonically_increasing_id().alias("row"), *others)
    return light.select("*", F.expr(KEY).alias("key"))


def _chosen(light: DataFrame, scratch: Scratch, weights: dict | None) -> DataFrame:
    """`light`, written rows of `_sized`, with `copies`, `source_size` and `target`.

    Plan, passes and last choices have one row per pattern. They are written tables without a hint: Spark broadcasts
    them where their size is under the session's threshold, and the rows of `light` are then not shuffled.
    """
    spark = light.sparkSession
    patterns = {tuple(r["pattern"]): r["n"] for r in light.groupBy("pattern").agg(F.sum("size").alias("n")).collect()}
    source_size: dict = {}
    for p, n in patterns.items():
        for s in p:
            source_size[s] = source_size.get(s, 0) + n
    weights = weights or weigh(list(source_size))
    goal = targets(source_size, weights, float(sum(patterns.values())))
    flow = route(patterns, goal)
    rows = []
    for p, n in patterns.items():
        want = sum(flow[p].values())
        whole = min(MOST, want // n) if n else 0
        rows.append((list(p), whole, want - whole * n, sum(source_size[s] for s in p), float(sum(goal[s] for s in p))))
    kind = light.schema["pattern"].dataType.simpleString()
    plan = spark.createDataFrame(
        rows, f"pattern {kind}, whole long, rest long, source_size long, target double")
    plan = scratch.keep(plan.withColumn("key", F.expr(KEY)).drop("pattern"), "plan")  # one row per pattern, as collected above
    steps = fill(light.select("id", "h", "row", "key", "size"), plan, scratch)
    out = light.join(plan, "key").join(steps, "key", "left").withColumn("more", F.expr(TAKEN))
    # the smallest that is not taken goes over the rest; with it the sum lies nearer if it is below twice what is left
    last = (out.filter("rest > 0").groupBy("key").agg(
        (F.first("rest") - F.coalesce(F.sum(F.when(F.col("more"), F.col("size"))), F.lit(0))).alias("left"),
        F.min(F.when(~F.col("more") & (F.col("size") > 0), F.struct("size", F.expr(AT).alias("at")))).alias("small"))
        .filter("small.size < 2 * left").select("key", F.col("small.at").alias("one")))
    out = out.join(scratch.keep(last, "last"), "key", "left")
    out = out.withColumn("more", F.col("more") | F.expr(f"coalesce({AT} = one, false)"))
    return out.withColumn("copies", F.least(F.col("whole") + F.col("more").cast("long"), F.lit(MOST)))


#: A pattern as text, so that it can be a key with nulls inside.
KEY = "to_json(struct(pattern), map('ignoreNullFields', 'false'))"
#: A document's place in the order of its pattern, and whether a pass takes it.
AT = "struct(h, id, row)"
TAKEN = (f"coalesce(exists(steps, s -> size <= s.gap and (s.start is null or {AT} > s.start) "
         f"and (s.stop is null or {AT} < s.stop)), false)")


def fill(light: DataFrame, plan: DataFrame, scratch: Scratch) -> DataFrame:
    """`key, steps`: per pattern, the passes (gap, start, stop) by which documents in order fill `rest`.

    A pass goes on after the document at `start`, over those of at most `gap` words, up to the first that does not fit
    behind the ones before it, at `stop` (null: all fit). What the others leave is the next pass's gap. The place of
    `stop` is found by sums over ranges of the hash, then document by document inside one range. There are about as many
    ranges as rows in a range, the square root of all rows, so neither step is large for any task. Passes go on
    until a gap is filled or no later document fits it. One row per pattern and pass.
    """
    bits = max(light.count().bit_length() // 2, 1)
    bin_of = F.shiftright(F.col("h"), 64 - bits).cast("int")
    place = light.select(F.expr(AT).alias("at")).schema["at"].dataType.simpleString()
    state = plan.filter("rest > 0").select("key", F.col("rest").alias("gap"), F.lit(None).cast(place).alias("start"))
    done = []
    while True:
        fits = (light.select("key", "size", bin_of.alias("b"), F.expr(AT).alias("at")).join(state, "key")
                .filter("size > 0 and size <= gap and (start is null or at > start)"))
        upto = F.sum("n").over(Window.partitionBy("key").orderBy("b"))
        edge = (fits.groupBy("key", "b", "gap").agg(F.sum("size").alias("n")).withColumn("upto", upto)
                .filter("upto > gap and upto - n <= gap").select("key", "b", (F.col("upto") - F.col("n")).alias("before")))
        edge = scratch.keep(edge, f"edge{len(done)}")
        inside = fits.join(edge, ["key", "b"]).withColumn("upto", F.col("before") + F.sum("size").over(
            Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
        found = inside.groupBy("key").agg(
            F.min(F.when(F.col("upto") > F.col("gap"), F.col("at"))).alias("stop"),
            F.coalesce(F.max(F.when(F.col("upto") <= F.col("gap"), F.col("upto"))), F.first("before")).alias("sum"))
        step = scratch.keep(state.join(found, "key", "left"), f"step{len(done)}")
        done.append(step)
        state = step.filter("stop is not null and sum < gap").select(
            "key", (F.col("gap") - F.col("sum")).alias("gap"), F.col("stop").alias("start"))
        if state.isEmpty():
            break
    steps = reduce(DataFrame.unionByName, done)
    return scratch.keep(steps.groupBy("key").agg(F.collect_list(F.struct("gap", "start", "stop")).alias("steps")), "steps")


def take(docs: DataFrame, id: str = "doc_id", text: str = "text", sources: str = "source", weights: dict | None = None,
         seed: int = 0) -> DataFrame:
    """The rows of `docs`, all columns, each as often as the mix takes it; null text is empty and has no words, so such a row
    is taken only by whole multiples. An empty table gives no rows.

    Rows are written once with their place, and the choice is made by a look at small tables beside each row: neither
    texts nor rows alike in id and text are shuffled.
    """
    scratch = Scratch(docs.sparkSession, "taking")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    held = scratch.keep(_sized(docs, id, text, sources, seed, row), "rows")
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return _chosen(held, scratch, weights).filter("copies > 0").select("_row", times).select("_row.*")
