"""Mixing sources to target shares of the total size, with capped repetition.

Copies of one text in several sources are one document with several memberships. Documents are aggregated by membership
pattern; a min-cost flow routes each pattern's tokens to the quotas of its sources, where every further use of the same
document costs more than the one before. Every pattern there is takes part; only the flow's network (patterns and their
sources, as arrays) is on the driver. Within a pattern, documents stand in a seeded order on a tape that is run through
once per use, and every source gets a stretch of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.prefix import running_total
from graphloom.runtime import materialize

#: Patterns of several sources, those with most tokens, whose stretches are broadcast. Texts of any others meet theirs in a shuffle.
MAX_PATTERNS = 256
#: The distance of what can't be reached.
FAR = np.iinfo(np.int64).max
#: Sums of tokens are 64 bits wide: a larger total is an error.
MOST_TOKENS = 1 << 62


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    max_repeats: int


def _deal(amount: np.ndarray, group: np.ndarray, room: np.ndarray) -> np.ndarray:
    """What each member gets of its group's ``amount``, in their order and up to its ``room``; members of a group adjoin."""
    first = np.append(True, group[1:] != group[:-1])[: len(group)]
    start = np.flatnonzero(first)[np.cumsum(first) - 1]
    before, about = np.cumsum(room) - room, np.cumsum(room, dtype=float) - room
    # a sum beyond 64 bits is beyond any amount, too
    return np.where(about - about[start] > MOST_TOKENS, 0, np.clip(amount[group] - (before - before[start]), 0, room))


def _quotas(shares: list[float], total: int) -> np.ndarray:
    if total > MOST_TOKENS:
        raise ValueError(f"a mix of {total} tokens can't be counted in 64 bits")
    return np.array(shares, dtype=float) * total


class Supply:
    """The tokens of membership patterns and the sources that may take of them: one arc per pattern and source.

    The k-th use of a pattern's tokens costs k - 1 each; a source takes at most ``max_repeats`` times a pattern's tokens,
    and all sources together at most the largest of their caps.
    """

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, members: np.ndarray, targets: list[Target]) -> None:
        """``members``: numbers in ``targets``, as many per pattern as ``sizes`` says, in the order of the patterns."""
        self.tokens, self.targets = tokens.astype(np.int64), targets
        self.of, self.to = np.repeat(np.arange(len(tokens)), sizes), members.astype(np.int64)
        self.caps = np.array([t.max_repeats for t in targets], dtype=np.int64)
        self.most = np.zeros(len(tokens), dtype=np.int64)
        np.maximum.at(self.most, self.of, self.caps[self.to])
        self.by_source = np.argsort(self.to, kind="stable")

    def _per(self, ends: np.ndarray, count: int, x: np.ndarray) -> np.ndarray:
        sums = np.zeros(count, dtype=np.int64)
        np.add.at(sums, ends, x)
        return sums

    def per_pattern(self, x: np.ndarray) -> np.ndarray:
        return self._per(self.of, len(self.tokens), x)

    def per_source(self, x: np.ndarray) -> np.ndarray:
        return self._per(self.to, len(self.targets), x)

    def tops(self, uses: np.ndarray) -> np.ndarray:
        """What each arc carries at most where patterns are used at most ``uses`` times."""
        return np.minimum(self.caps[self.to], uses[self.of]) * self.tokens[self.of]

    def distances(self, x: np.ndarray, tops: np.ndarray, spare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Steps from each pattern and each source to a pattern with tokens to spare: sources ask patterns, patterns recall from sources."""
        patterns, sources = np.where(spare > 0, 0, FAR), np.full(len(self.targets), FAR)
        open_, given, d = x < tops, x > 0, 0
        while True:
            reached = self.to[open_ & (patterns[self.of] == d) & (sources[self.to] == FAR)]
            sources[reached] = d + 1
            recalled = self.of[given & (sources[self.to] == d + 1) & (patterns[self.of] == FAR)]
            patterns[recalled] = d + 2
            if not len(recalled):
                return patterns, sources
            d += 2

    def fill(self, x: np.ndarray, quotas: np.ndarray, uses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``x`` raised to a largest flow into ``quotas`` with at most ``uses`` of each pattern, and which sources can't get more.

        No pattern gives less than in ``x``. What sources lack is pushed in waves along shortest ways to patterns with
        tokens to spare; a pattern asked for more than it has recalls tokens from other sources, which then lack them.
        """
        x, tops = x.copy(), self.tops(uses)
        lacking, spare = quotas - self.per_source(x), uses * self.tokens - self.per_pattern(x)
        over = np.zeros(len(self.tokens), dtype=np.int64)
        while True:
            patterns, sources = self.distances(x, tops, spare)
            held = [d[(amount > 0) & (d < FAR)] for d, amount in ((patterns, over), (sources, lacking))]
            if not any(map(len, held)):
                break
            for d in range(max(h.max() for h in held if len(h)), 0, -1):
                if d % 2:
                    asks = (sources == d) & (lacking > 0)
                    on = self.by_source[(asks[self.to] & (patterns[self.of] == d - 1) & (x < tops))[self.by_source]]
                    amount = _deal(lacking, self.to[on], tops[on] - x[on])
                    x[on] += amount
                    lacking -= self._per(self.to[on], len(lacking), amount)
                    over += self._per(self.of[on], len(over), amount)
                else:
                    on = np.flatnonzero(((patterns == d) & (over > 0))[self.of] & (sources[self.to] == d - 1) & (x > 0))
                    amount = _deal(over, self.of[on], x[on])
                    x[on] -= amount
                    over -= self._per(self.of[on], len(over), amount)
                    lacking += self._per(self.to[on], len(lacking), amount)
            taken = np.minimum(over, spare)
            over, spare = over - taken, spare - taken
        on = np.flatnonzero((over > 0)[self.of])
        x[on] -= _deal(over, self.of[on], x[on])
        return x, sources == FAR

    def route(self, total: int) -> np.ndarray:
        """Tokens on each arc, at the least cost of repetition. Quotas are ``share * total``; what can't be supplied is missing.

        A way to a source costs what the use costs that it begins with, so uses are allowed one after another and each
        time the flow is made as large as it gets.
        """
        quotas = np.rint(_quotas([t.share for t in self.targets], total)).astype(np.int64)
        x, uses = np.zeros(len(self.of), dtype=np.int64), 0
        while True:
            more = np.minimum(uses + 1, self.most)
            x, _ = self.fill(x, quotas, more)
            uses += 1
            lacking = quotas > self.per_source(x)
            if not lacking.any() or uses >= self.most.max(initial=0):
                break
            # can those that lack any get more by any number of uses?
            enough = np.minimum(self.most, int(quotas.sum()) // self.tokens + 1)
            _, sources = self.distances(x, self.tops(enough), enough * self.tokens - self.per_pattern(x))
            if not (lacking & (sources < FAR)).any():
                break
        return self._whole(x)

    def _whole(self, x: np.ndarray) -> np.ndarray:
        """The same sums by pattern and cost and by source, where at most one pattern per source isn't used in whole multiples of its tokens.

        Parts of a use form a graph of patterns and sources, with one more node for what a pattern has left of a use.
        Around a cycle of it tokens are moved until a part is none or whole; so a forest is left.
        """
        rest, left = len(self.targets), -self.per_pattern(x) % self.tokens
        arcs = np.flatnonzero(x % self.tokens[self.of])
        begun = {(p, t): n for p, t, n in zip(self.of[arcs].tolist(), self.to[arcs].tolist(), (x % self.tokens[self.of])[arcs].tolist())}
        parts = begun | {(p, rest): int(left[p]) for p in np.flatnonzero(left).tolist()}
        near: dict[tuple[str, int], set[tuple[str, int]]] = {}

        def found(start: tuple[str, int], via: dict) -> Iterator[tuple[str, int]]:
            todo = [start]
            for node in todo:
                for other in near.get(node, ()):
                    if other not in via:
                        via[other] = node
                        todo.append(other)
                        yield other

        def back(node: tuple[str, int], via: dict) -> list[tuple[str, int]]:
            nodes = [node]
            while via[nodes[-1]] != nodes[-1]:
                nodes.append(via[nodes[-1]])
            return nodes

        def way(start: tuple[str, int], end: tuple[str, int]) -> list[tuple[str, int]]:
            """The nodes from ``end`` back to ``start`` in the forest, if they are joined; searched from both, so a small tree ends it soon."""
            ways = {start: start}, {end: end}
            steps = found(start, ways[0]), found(end, ways[1])
            while True:
                for k in (0, 1):
                    node = next(steps[k], None)
                    if node is None:
                        return []
                    if node in ways[1 - k]:
                        return back(node, ways[1])[::-1] + back(node, ways[0])[1:]

        for arc in sorted(parts):
            p, t = ("p", arc[0]), ("t", arc[1])
            size = int(self.tokens[arc[0]])
            while 0 < parts[arc] < size:
                nodes = way(p, t)
                if not nodes:
                    near.setdefault(p, set()).add(t)
                    near.setdefault(t, set()).add(p)
                    break
                # the arc gains, those of the way lose and gain in turn
                cycle = [(u[1], v[1]) if u[0] == "p" else (v[1], u[1]) for u, v in zip(nodes, nodes[1:])]
                gain, lose = [arc, *cycle[1::2]], cycle[::2]
                moved = min([int(self.tokens[q]) - parts[q, k] for q, k in gain] + [parts[c] for c in lose])
                for c in gain:
                    parts[c] += moved
                for c in lose:
                    parts[c] -= moved
                for q, k in cycle:
                    if parts[q, k] in (0, int(self.tokens[q])):
                        near["p", q].discard(("t", k))
                        near["t", k].discard(("p", q))
        x = x.copy()
        x[arcs] += np.array([parts[c] - n for c, n in begun.items()], dtype=np.int64)
        return x

    def largest_total(self) -> int:
        """The largest total at which every source that has documents can get its share of it.

        Whatever total is too large is so for some sources together, which a largest flow tells; the next one tried is
        the largest for them.
        """
        held = np.zeros(len(self.targets), dtype=bool)
        held[self.to] = True
        shares = np.array([t.share if h else 0.0 for t, h in zip(self.targets, held.tolist())])
        wanted = np.flatnonzero(shares > 0)
        if not len(wanted):
            return 0
        supply = self.per_source(self.tokens[self.of]).tolist()
        total = min(int(self.targets[k].max_repeats * supply[k] / shares[k]) for k in wanted.tolist())
        while total > 0:
            quotas = np.floor(_quotas(shares, total)).astype(np.int64)
            uses = np.minimum(self.most, int(quotas.sum()) // self.tokens + 1)
            x, stuck = self.fill(np.zeros(len(self.of), dtype=np.int64), quotas, uses)
            if (self.per_source(x) >= quotas).all():
                break
            stuck &= shares > 0
            most = np.minimum(self.per_pattern(np.where(stuck[self.to], self.tops(uses), 0)), uses * self.tokens).sum()
            total = min(total - 1, int(most / shares[stuck].sum()))
        return max(total, 0)


def _supply(patterns: dict[frozenset[str], int], targets: list[Target]) -> tuple[list[frozenset[str]], Supply]:
    number = {t.source: k for k, t in enumerate(targets)}
    order = sorted(patterns, key=lambda p: (len(p), sorted(p)))
    members = [number[s] for p in order for s in sorted(p)]
    return order, Supply(np.array([patterns[p] for p in order]), np.array([len(p) for p in order], dtype=int), np.array(members, dtype=int), targets)


def route(patterns: dict[frozenset[str], int], targets: list[Target], total: int) -> dict[tuple[frozenset[str], str], int]:
    """Tokens each pattern gives to each source (``Supply.route``).

    ``patterns``: tokens of the distinct documents whose sources are just these.
    """
    order, supply = _supply(patterns, targets)
    amounts = zip(supply.of.tolist(), supply.to.tolist(), supply.route(total).tolist())
    return {(order[p], targets[s].source): n for p, s, n in amounts if n}


def largest_total(patterns: dict[frozenset[str], int], targets: list[Target]) -> int:
    """The largest total at which every source that has documents can get its share of it."""
    return _supply(patterns, targets)[1].largest_total()


def read_targets(targets: DataFrame) -> list[Target]:
    """The targets of a small table (``source``, ``target_share``, ``max_repeats``), which is read whole to the driver."""
    rows = targets.select("source", "target_share", "max_repeats").collect()
    return sorted(
        (Target(r[0], float(r[1]), int(r[2])) for r in rows if r[0] is not None and r[1] is not None and r[1] > 0 and (r[2] or 0) > 0),
        key=lambda t: t.source,
    )


def select_mix(docs: DataFrame, targets: list[Target], total_tokens: int | None = None, seed: int = 0) -> DataFrame:
    """A selection from ``docs`` in which each source has its share of the total size.

    ``docs``: ``doc_id``, ``source``, ``content`` (equal for copies of a text) and ``n_tokens``; read several times,
    so pass a materialized table. ``total_tokens`` defaults to the largest total at which all sources that have
    documents meet their quotas; with a larger one the quotas are met as far as the caps allow.

    Result: ``doc_id``, ``source``, ``uses INT``, ``n_tokens`` (of one use). Copies of a text within a source are
    stood for by the lowest ``doc_id``; a text is never used more than ``max_repeats`` times for a source. Documents
    of a null or unlisted source, and of null or no size, aren't selected; sources without documents get nothing.
    Every combination of sources takes part as such, however many there are. Quotas are met to within one document per
    source and pattern that isn't used in whole; of those there are at most as many as sources. Ties of the seeded order
    go by ``content``. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    names = [t.source for t in targets]
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("source", T.StringType()),
        T.StructField("uses", T.IntegerType()), T.StructField("n_tokens", T.LongType()),
    ])
    if not names:
        return spark.createDataFrame([], schema)
    usable = docs.where(F.col("n_tokens") > 0).join(F.broadcast(spark.createDataFrame(list(enumerate(names)), "k int, source string")), "source")
    # a text's copies combine before the shuffle: one narrow row per text and source, however many copies
    of_source = usable.groupBy("content", "k").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    members = F.sort_array(F.collect_list(F.struct("k", "doc_id")))
    every = materialize(
        of_source.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"), members.alias("members"))
        .withColumn("pattern", F.transform("members", lambda m: m["k"])).withColumn("h", F.xxhash64(F.lit(seed), "content")),
        "mix-memberships",
    )
    # a row per pattern, those of few sources first
    sums = every.groupBy("pattern").agg(F.sum("n_tokens").alias("tokens")).orderBy(F.size("pattern"), "pattern").toArrow()
    pattern, tokens = sums["pattern"].combine_chunks(), sums["tokens"].to_numpy()
    sizes = pattern.value_lengths().to_numpy()
    supply = Supply(tokens, sizes, pattern.flatten().to_numpy(), targets)
    flow = supply.route(supply.largest_total() if total_tokens is None else total_tokens)
    at = np.cumsum(flow) - flow
    at -= np.repeat(at[np.cumsum(sizes) - sizes], sizes)  # of the pattern's tape
    # single sources and the patterns with most tokens
    often = sizes == 1
    several = np.flatnonzero(~often)
    often[several[np.argsort(-tokens[several], kind="stable")[:MAX_PATTERNS]]] = True

    def told(arcs: np.ndarray) -> DataFrame:
        columns = {
            "p": pattern.take(pa.array(supply.of[arcs])), "source": pa.array([names[k] for k in supply.to[arcs].tolist()], pa.string()),
            "k": pa.array(supply.to[arcs], pa.int32()), "lo": at[arcs], "hi": (at + flow)[arcs], "tokens": tokens[supply.of[arcs]],
        }
        return spark.createDataFrame(pa.table(columns), "p array<int>, source string, k int, lo long, hi long, tokens long")

    def selected(texts: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
        on_tape = running_total(texts, ["pattern"], "h", ["content"], "n_tokens", "start", few=few)
        # the middle of use u of a document lies at start + n_tokens / 2 + u * tokens; count those in [lo, hi)
        upto = lambda end: F.greatest(F.lit(0), F.ceil((F.col(end) - F.col("start") - F.col("n_tokens") / 2) / F.col("tokens")))
        uses = (upto("hi") - upto("lo")).cast("int")
        own = F.filter("members", lambda m: m["k"] == F.col("k"))[0]["doc_id"]
        return on_tape.join(F.broadcast(plan) if few else plan, F.col("pattern") == F.col("p")).select(
            own.alias("doc_id"), "source", uses.alias("uses"), "n_tokens"
        ).where(F.col("uses") > 0)

    used, broadcast = flow > 0, often[supply.of]
    if often.all():
        return selected(every, told(np.flatnonzero(used)), True)
    marks = F.broadcast(spark.createDataFrame(pa.table({"pattern": pattern.filter(pa.array(often))}), "pattern array<int>"))
    return selected(every.join(marks, "pattern", "left_semi"), told(np.flatnonzero(used & broadcast)), True).unionByName(
        selected(every.join(marks, "pattern", "left_anti"), told(np.flatnonzero(used & ~broadcast)), False)
    )


def mix_report(selected: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: ``source``, ``target_share``, ``documents``, ``tokens``, ``actual_share``, ``most_uses``."""
    per = selected.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses")
    )
    joined = targets.select("source", "target_share").join(per, "source", "left").na.fill(0, ["documents", "tokens", "most_uses"])
    return joined.withColumn("actual_share", F.try_divide(F.col("tokens"), F.expr("sum(tokens) over ()")))


def mix_checks(selected: DataFrame, docs: DataFrame, targets: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Per target source: ``source``, ``has_documents``, ``share_met``, ``within_repeats``.

    A share is met if the source has its part of the total to within ``tolerance`` of that part or, in a small mix, to
    within what whole documents allow: its own quota is met to within its largest document, and the total to within the
    largest of all sources. Parts are those of the sources that have documents (no tokens where it has none). ``docs``
    is what the selection was made from.
    """
    c = F.col
    held = docs.where(c("n_tokens") > 0).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("n_tokens").alias("largest"))
    per = selected.groupBy("source").agg(F.sum(c("n_tokens") * c("uses")).alias("tokens"), F.max("uses").alias("most"))
    wanted = targets.where((c("target_share") > 0) & (c("max_repeats") > 0))
    # a row per source
    joined = wanted.join(held, "source", "left").join(per, "source", "left").na.fill(0, ["n", "tokens", "most", "largest"])
    part = c("target_share") / F.sum(F.when(c("n") > 0, c("target_share"))).over(Window.partitionBy())
    whole = c("largest") + part * F.sum("largest").over(Window.partitionBy())
    due = part * F.sum("tokens").over(Window.partitionBy())
    met = F.when(c("n") > 0, F.abs(c("tokens") - due) <= F.greatest(tolerance * due, whole)).otherwise(c("tokens") == 0)
    return joined.select("source", (c("n") > 0).alias("has_documents"), met.alias("share_met"), (c("most") <= c("max_repeats")).alias("within_repeats"))


def sized_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``docs`` as ``select_mix`` takes them, each whole text sized in tokens and told by its digest; materialized."""
    from graphloom.llm.tokens import count_tokens

    told = docs.select("doc_id", "source", F.unhex(F.md5("text")).alias("content"), "text")
    return materialize(count_tokens(told, "text", tokenizer, ("doc_id", "source", "content")), "mix-sizes")
