"""Train, validation and test splits that keep related records together.

Groups are the components of prompts tied by a text. Each round builds
union-find forests inside the partitions, which replace the edges by at most one per
vertex, and merges them over the cluster by one alternating large-star/small-star
step; no task holds more than its partition's forest. Groups then go largest first
to the split furthest below its target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyard.durable import materialise

BLANK = r"[\s\p{Z}\x{85}\x{200B}\x{FEFF}]+"


def bare(text: Column) -> Column:
    """The text without white space of any kind."""
    return F.regexp_replace(text, BLANK, "")


def prompt_key(prompt_id: Column) -> Column:
    return F.upper(F.regexp_replace(prompt_id, rf"^{BLANK}|{BLANK}$", ""))


def ties(responses: DataFrame, entity: Column, text: Column) -> DataFrame:
    """Edges (a, b), a > b, between each entity and the smallest one that has the same text.

    A text under n entities gives n - 1 edges, not n squared; repeats are reduced before
    the shuffle. Blank and null texts and null entities tie nothing.
    """
    t = bare(text)
    pairs = responses.select(entity.alias("a"), F.xxhash64(t).alias("h1"), F.md5(t).alias("h2"), (F.length(t) > 0).alias("full"))
    pairs = pairs.where("full and a is not null").select("a", "h1", "h2").distinct()
    least = pairs.groupBy("h1", "h2").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return pairs.join(least, ["h1", "h2"]).where("a <> b").select("a", "b").distinct()


def _forest(batches: Iterator[pd.DataFrame], most: int = 2_000_000) -> Iterator[pd.DataFrame]:
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def edges() -> pd.DataFrame:
        out = [(v, r) for v in list(parent) if (r := find(v)) != v]
        return pd.DataFrame(out, columns=["a", "b"], dtype=object)

    for pdf in batches:
        for a, b in zip(pdf["a"], pdf["b"]):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > most:  # a forest cut here is joined again by the next round
            yield edges()
            parent = {}
    yield edges()


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(vertex, root) of every vertex of ``edges`` (a, b: strings), root the smallest vertex of its component."""
    schema = "a string, b string"
    cur = materialise(edges.where("a is not null and b is not null and a <> b").select("a", "b").mapInPandas(_forest, schema), "forest")
    for _ in range(most_rounds):
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: every larger neighbour of a moves to a's smallest neighbour
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # small star over forests built inside the partitions
        local = large.distinct().mapInPandas(_forest, schema).distinct()
        small = local.groupBy("a").agg(F.min("b").alias("m"))
        nxt = local.join(small, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        nxt = materialise(nxt, "forest")
        # done when every vertex has one edge and no root is itself a child
        busy = nxt.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        chained = nxt.select(F.col("b").alias("a")).distinct().join(nxt.select("a"), "a", "left_semi").limit(1).count()
        cur = nxt
        if not busy and not chained:
            break
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("a").alias("vertex"), F.col("b").alias("root")).union(cur.select(F.col("b"), F.col("b")).distinct())


def plan(sizes: list[tuple[int, int]], total: int, shares: list[float]) -> dict[int, list[int]]:
    """For each (size, groups), largest first, how many of its groups go to each split.

    Each group goes to the split furthest below its target; equal groups are
    interchangeable, so a run of them is dealt in blocks while the order of the splits
    by need doesn't matter for the result.
    """
    need = [s * total for s in shares]
    out: dict[int, list[int]] = {}
    for size, n in sorted(sizes, reverse=True):
        got = [0] * len(shares)
        left = n
        while left:
            i = max(range(len(need)), key=lambda j: (need[j], -j))
            rest = max((need[j] for j in range(len(need)) if j != i), default=0.0)
            k = min(left, max(1, int((need[i] - rest) // size))) if size else left
            got[i] += k
            need[i] -= k * size
            left -= k
        out[size] = got
    return out


def assign(groups: DataFrame, shares: dict[str, float], group: str = "grp", size: str = "n") -> DataFrame:
    """``groups`` with a column ``split``. The driver sees counts per size and partition, never groups."""
    ordered = groups.select(F.col(group).alias("g"), F.col(size).cast("bigint").alias("n"))
    ranked = materialise(ordered.repartitionByRange(F.desc("n"), F.col("g")).sortWithinPartitions(F.desc("n"), "g").withColumn("part", F.spark_partition_id()), "ranked")
    counts = ranked.groupBy("n", "part").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("n"), "part").collect()
    by_size: dict[int, int] = {}
    offset: dict[tuple[int, int], int] = {}
    for r in counts:
        offset[r["n"], r["part"]] = by_size.get(r["n"], 0)
        by_size[r["n"]] = by_size.get(r["n"], 0) + r["c"]
    deal = plan(list(by_size.items()), sum(s * c for s, c in by_size.items()), list(shares.values()))
    names = list(shares)

    def put(pdf: pd.DataFrame) -> pd.DataFrame:
        n, part = int(pdf["n"].iloc[0]), int(pdf["part"].iloc[0])
        lo = offset[n, part]
        at = np.searchsorted(np.cumsum(deal[n]), np.arange(lo, lo + len(pdf)), side="right")
        return pd.DataFrame({"g": pdf["g"].sort_values().to_numpy(), "split": [names[i] for i in at]})

    kind = ranked.schema["g"].dataType.simpleString()
    return ranked.groupBy("n", "part").applyInPandas(put, f"g {kind}, split string").withColumnRenamed("g", group)
