"""Filling fixed-capacity containers with items of varying length, by linear grouping of the lengths.

Only the histogram of lengths (at most ``capacity`` counts, whatever the number of items) reaches the driver. There:

1. Large lengths (over capacity / LARGE) are sorted and put in groups of equal cardinality; each length is rounded
   up to the largest of its group.
2. For the few rounded lengths the best mix of container configurations is found by column generation: a linear
   programme over configurations, whose new columns come from a knapsack over the capacity.
3. Real items take the places of rounded ones, group by group; what the mix leaves over is placed by best fit.
4. Small lengths go, longest first, into the containers with the least sufficient space (best fit), and into new
   containers when none has space.

Containers with the same content are kept as one run with a count, so the plan is as small as the histogram. The
plan gives, for each length, which ranks of its items go to which containers; it is sent to the items by broadcast
and each item finds its container by its length and rank. Ranks are counted per (length, bucket of ids); a length has
as many buckets as its items need, so one that a third of all items share is spread over many tasks.

Defined results: an item longer than the capacity is cut into full pieces and a rest, each piece of capacity being
alone in its container; items of length 0 (null and empty texts) are put in container 0, which holds only them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut

#: Lengths over capacity / LARGE are grouped; the others are filled in. Groups of rounded lengths.
LARGE, GROUPS = 8, 40
#: Items of a bucket; with more than ROWS x BUCKETS items, buckets grow instead of becoming more (and one per length).
ROWS, BUCKETS = 50_000, 50_000


def best_mix(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[tuple[int, ...], float]]:
    """Configurations (items of each size) and how often to use them: the linear programme's optimum."""
    n = len(sizes)
    columns = [tuple(capacity // sizes[i] if j == i else 0 for j in range(n)) for i in range(n)]
    basis = np.diag([float(capacity // s) for s in sizes])
    d = np.array(demand, float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        price = np.ones(n) @ inverse
        new = _knapsack(sizes, price, capacity)
        if float(np.dot(price, new)) <= 1 + 1e-7:
            break
        x, step = inverse @ d, inverse @ np.array(new, float)
        ratios = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratios))
        basis[:, out], columns[out] = new, tuple(int(v) for v in new)
    x = np.linalg.solve(basis, d)
    return [(c, float(v)) for c, v in zip(columns, x) if v > 1e-9]


def _knapsack(sizes: list[int], price: np.ndarray, capacity: int) -> np.ndarray:
    """The content of one container with the highest price. An item's price is also tried at each place in turn."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for i, s in sorted(enumerate(sizes), key=lambda x: -x[1]):
        if price[i] <= 1e-12:
            continue
        for _ in range(capacity // s):
            shifted = np.concatenate([np.full(s, -np.inf), best[:-s] + price[i]]) if s <= capacity else None
            better = shifted > best + 1e-12
            if not better.any():
                break
            best, last = np.where(better, shifted, best), np.where(better, i, last)
    # Walk back by recomputation: each cell's last item was set when its value last rose.
    got, room = np.zeros(len(sizes)), int(np.argmax(best))
    target = best[room]
    while room > 0 and target > 1e-9:
        for i, s in enumerate(sizes):
            if s <= room and price[i] > 1e-12 and abs(best[room - s] + price[i] - target) < 1e-9:
                got[i] += 1
                room, target = room - s, best[room - s]
                break
        else:
            room -= 1
    return got


class Plan:
    """Runs of containers with equal content, and which ranks of each length they hold."""

    def __init__(self, capacity: int):
        self.capacity, self.next = capacity, 1
        self.runs: list[list[int]] = []  # first container, containers, space left
        self.places: list[tuple[int, int, int, int]] = []  # length, first rank, ranks, first container
        self.rank: dict[int, int] = {}

    def open(self, n: int) -> list[int]:
        run = [self.next, n, self.capacity]
        self.next += n
        self.runs.append(run)
        return run

    def put(self, run: list[int], size: int) -> None:
        """One item of ``size`` into each container of the run."""
        first = self.rank.get(size, 0)
        self.places.append((size, first, run[1], run[0]))
        self.rank[size] = first + run[1]
        run[2] -= size

    def split(self, run: list[int], n: int) -> list[int]:
        """The first ``n`` containers of a run as a run of their own; the run keeps the others."""
        head = [run[0], n, run[2]]
        run[0], run[1] = run[0] + n, run[1] - n
        self.runs.append(head)
        return head


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Places for all items of a histogram length -> count (lengths 1 to capacity)."""
    p = Plan(capacity)
    left = {s: n for s, n in histogram.items() if n > 0}
    large = sorted((s for s in left if s > capacity // LARGE), reverse=True)
    total = sum(left[s] for s in large)
    if total:
        # Groups of equal cardinality over the sorted items; a length may lie in two groups.
        per = -(-total // GROUPS)
        groups: list[list[list[int]]] = []
        room = 0
        for s in large:
            n = left[s]
            while n:
                if not room:
                    groups.append([])
                    room = per
                take = min(n, room)
                groups[-1].append([s, take])
                n, room = n - take, room - take
        sizes, demand = [], []
        for g in groups:
            if sizes and sizes[-1] == g[0][0]:
                demand[-1] += sum(n for _, n in g)
                queue_of[-1].extend(g)
            else:
                queue_of = [] if not sizes else queue_of
                sizes.append(g[0][0])
                demand.append(sum(n for _, n in g))
                queue_of.append(list(g))
        for config, times in sorted(best_mix(sizes, demand, capacity), key=lambda x: -x[1]):
            n = int(times + 1e-9)
            if n:
                runs = [p.open(n)]
                for i, k in enumerate(config):
                    for _ in range(k):
                        runs = [r for run in runs for r in _fill(p, run, queue_of[i])]
        rest: dict[int, int] = {}
        for q in queue_of:
            for s, n in q:
                rest[s] = rest.get(s, 0) + n
        _best_fit(p, rest)
    _best_fit(p, {s: n for s, n in left.items() if s <= capacity // LARGE})
    return p


def _fill(p: Plan, run: list[int], queue: list[list[int]]) -> list[list[int]]:
    """One item of the queue into each container of the run, which is cut where the length changes or the queue ends."""
    done = []
    while run[1] and queue:
        s, n = queue[0]
        take = min(n, run[1])
        part = run if take == run[1] else p.split(run, take)
        p.put(part, s)
        done.append(part)
        queue[0][1] -= take
        if not queue[0][1]:
            queue.pop(0)
        if part is run:
            return done
    return [*done, run]


def _best_fit(p: Plan, items: dict[int, int]) -> None:
    """Items, longest first, into the containers with the least space that suffices, else into new ones."""
    by_space: dict[int, list[list[int]]] = {}
    for r in p.runs:
        by_space.setdefault(r[2], []).append(r)
    for s in sorted(items, reverse=True):
        n = items[s]
        space = s
        while n:
            while space <= p.capacity and not by_space.get(space):
                space += 1
            if space > p.capacity:
                # New containers, each filled with as many items of this length as it holds.
                k = p.capacity // s
                full, over = divmod(n, k)
                for count, each in ((full, k), (1 if over else 0, over)):
                    if count:
                        run = p.open(count)
                        for _ in range(each):
                            p.put(run, s)
                        by_space.setdefault(run[2], []).append(run)
                n = 0
                break
            run = by_space[space].pop()
            if run[1] > n:
                head = p.split(run, n)
                by_space[space].append(run)
                run = head
            p.put(run, s)
            by_space.setdefault(run[2], []).append(run)
            n -= run[1]
            space = s


def pieces(sized: DataFrame, capacity: int) -> DataFrame:
    """(item_id, piece_no, start, length) of items (item_id, length): cut only what exceeds the capacity."""
    last = F.greatest(F.ceil(F.col("length") / capacity).cast("int") - 1, F.lit(0))
    out = sized.select("item_id", "length", F.explode(F.sequence(F.lit(0), last)).alias("piece_no"))
    start = F.col("piece_no").cast("long") * capacity
    return out.select("item_id", "piece_no", start.alias("start"), F.least(F.lit(capacity).cast("long"), F.col("length") - start).alias("length"))


def containers(sized: DataFrame, capacity: int = 2048) -> DataFrame:
    """(item_id, piece_no, start, length, container_id) for items (item_id long, length long), none left out.

    A null or negative length counts as 0. item_id need not be unique: repeated rows are packed each for itself.
    """
    spark = sized.sparkSession
    sized = sized.select("item_id", F.greatest(F.coalesce("length", F.lit(0)), F.lit(0)).cast("long").alias("length"))
    parts = cut(pieces(sized, capacity))
    sizes = {r.length: r.n for r in parts.filter("length > 0").groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    rows = max(ROWS, sum(sizes.values()) // BUCKETS)
    bucket_df = spark.createDataFrame([(s, -(-n // rows)) for s, n in sizes.items()], "length long, buckets int")
    bucket = F.pmod(F.xxhash64("item_id", "piece_no"), "buckets").cast("int")
    bucketed = parts.filter("length > 0").join(F.broadcast(bucket_df), "length").withColumn("bucket", bucket).drop("buckets")
    counts = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n")).collect()  # at most capacity + BUCKETS rows
    by: dict[int, list[int]] = {s: [0] * -(-n // rows) for s, n in sizes.items()}
    for r in counts:
        by[r.length][r.bucket] = r.n
    p = plan({s: sum(c) for s, c in by.items()}, capacity)
    offsets = [(s, b, int(o)) for s, c in by.items() for b, o in enumerate(np.cumsum([0, *c[:-1]]))]
    places: dict[int, list[tuple[int, int, int]]] = {}
    for s, first, n, container in p.places:
        places.setdefault(s, []).append((first, n, container))
    offset_df = spark.createDataFrame(offsets, "length long, bucket int, offset long")
    place_df = spark.createDataFrame([(s, sorted(v)) for s, v in places.items()], "length long, places array<struct<first: long, n: long, container: long>>")
    ranked = bucketed.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("item_id", "piece_no")) - 1)
    ranked = ranked.join(F.broadcast(offset_df), ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("offset"))
    placed = ranked.join(F.broadcast(place_df), "length")
    mine = F.filter("places", lambda x: (x["first"] <= F.col("rank")) & (F.col("rank") < x["first"] + x["n"]))[0]
    placed = placed.withColumn("container_id", mine["container"] + F.col("rank") - mine["first"])
    columns = ["item_id", "piece_no", "start", "length", "container_id"]
    return placed.select(*columns).unionByName(parts.filter("length = 0").withColumn("container_id", F.lit(0).cast("long")).select(*columns))
