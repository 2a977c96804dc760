"""Filling containers of fixed capacity, with certified bounds.

Items are hashed into partitions of bounded size and packed there by best-fit
decreasing. Dual feasible functions give a lower bound of each partition's
containers; a partition that meets it keeps all but its emptiest one. The others release
their emptiest containers, whose items meet those of other partitions and are packed
again, until one partition is left.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyard.durable import materialise


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item (sizes at most ``capacity``); items of size 0 go where room is or share one container."""
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), dtype="int64")
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # containers by free space
    mask, n = 0, 0
    for i in order.tolist():
        s = int(sizes[i])
        fits = mask >> s
        if fits:
            free = s + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                mask &= ~(1 << free)
        else:
            free, b = capacity, n
            n += 1
        out[i] = b
        room[free - s].append(b)
        mask |= 1 << (free - s)
    return out


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Least number of containers for ``counts[s]`` items of each size s, by dual feasible functions."""
    s = np.arange(capacity + 1)
    best = float((counts * s).sum()) / capacity
    n_up, w_up = np.concatenate([[0], counts.cumsum()]), np.concatenate([[0], (counts * s).cumsum()])
    e = np.arange(1, capacity // 2 + 1)
    large = n_up[-1] - n_up[capacity - e + 1]  # sizes above capacity - e count as 1, below e as 0
    middle = w_up[capacity - e + 1] - w_up[e]
    best = max(best, float((large + middle / capacity).max()) if len(e) else 0.0)
    for k in range(1, 31):
        q = (k + 1) * s
        u = np.where(q % capacity == 0, s / capacity, (q // capacity) / k)
        best = max(best, float((counts * u).sum()))
    return ceil(best - 1e-9)


def _pack_group(pdf: pd.DataFrame, capacity: int, level: int, release: int, last: bool) -> pd.DataFrame:
    sizes = pdf["n_tokens"].to_numpy(dtype="int64")
    bins = best_fit_decreasing(sizes, capacity)
    group = int(pdf["grp"].iloc[0])
    ids = np.array([f"L{level}-{group}-"] * len(bins), dtype=object) + bins.astype(str)
    used = int(bins.max()) + 1
    if level and used >= pdf["container_id"].nunique():  # no better than before the exchange
        ids = pdf["container_id"].to_numpy(dtype=object)
        bins = pd.factorize(ids)[0]
        used = int(bins.max()) + 1
    bound = lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
    is_open = np.zeros(len(bins), dtype=bool)
    if not last:
        fill = np.bincount(bins, weights=sizes, minlength=used)
        held = np.bincount(bins, minlength=used)
        order = np.argsort(fill, kind="stable")
        if used <= bound:  # certified: only the container that rounding up leaves part empty
            order = order[:1]
        chosen = order[(held[order].cumsum() <= release) & (fill[order] < capacity)]
        flag = np.zeros(used, dtype=bool)
        flag[chosen] = True
        is_open = flag[bins]
    return pd.DataFrame({"row": pdf["row"], "piece": pdf["piece"], "n_tokens": pdf["n_tokens"], "container_id": ids, "grp": pdf["grp"], "is_open": is_open})


def _packer(capacity: int, level: int, release: int, last: bool):
    return lambda pdf: _pack_group(pdf, capacity, level, release, last)


def pack(items: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = 1024, per_partition: int = 8_192, fan_in: int = 8) -> DataFrame:
    """Containers of all items: id, piece_no, first_token, n_tokens, container_id.

    An item no longer than ``capacity`` is whole in one container. A longer one is cut
    into full containers of its own and a rest that is packed like an item. Items of
    size 0 or null have a container too. Repeated rows are items of their own; a null id
    stays null. ``per_partition`` bounds what one task packs; an exchange joins
    ``fan_in`` partitions, each giving at most ``per_partition / fan_in`` items (64 at least).
    """
    size = F.coalesce(F.col(f"`{size_col}`").cast("bigint"), F.lit(0))
    base = materialise(items.select(F.col(f"`{id_col}`").alias("id"), size.alias("total"), F.monotonically_increasing_id().alias("row")), "items")
    full = F.floor(F.col("total") / capacity).cast("int")
    rest = F.col("total") - full * capacity
    whole = base.where(full > 0).select("id", "row", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"))
    whole = whole.select("id", F.col("piece").alias("piece_no"), (F.col("piece").cast("bigint") * capacity).alias("first_token"), F.lit(capacity).cast("bigint").alias("n_tokens"), F.concat(F.lit("D"), F.col("row"), F.lit("-"), F.col("piece")).alias("container_id"))
    loose = base.where((full == 0) | (rest > 0)).select("row", full.alias("piece"), rest.alias("n_tokens"))
    groups = max(1, ceil(loose.count() / per_partition))
    cur = loose.withColumns({"grp": F.pmod(F.xxhash64("row"), F.lit(groups)), "container_id": F.lit(None).cast("string")})
    schema = "row bigint, piece int, n_tokens bigint, container_id string, grp bigint, is_open boolean"
    release, closed, level = max(64, per_partition // fan_in), [], 0
    while True:
        last = groups == 1
        packed = materialise(cur.groupBy("grp").applyInPandas(_packer(capacity, level, release, last), schema), "packed")
        closed.append(packed.where("not is_open"))
        if last or packed.where("is_open").isEmpty():
            break
        level, groups = level + 1, ceil(groups / fan_in)
        cur = packed.where("is_open").drop("is_open").withColumn("grp", F.floor(F.col("grp") / fan_in))
    placed = closed[0]
    for c in closed[1:]:
        placed = placed.unionByName(c)
    placed = placed.join(base, "row").select("id", F.col("piece").alias("piece_no"), (F.col("piece").cast("bigint") * capacity).alias("first_token"), "n_tokens", "container_id")
    return whole.unionByName(placed).withColumnRenamed("id", id_col)


def certificate(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """One row: containers used, their lower bound over all pieces together, and the share of unused space."""
    sizes = packed.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity + 1 rows
    counts = np.zeros(capacity + 1, dtype="int64")
    for r in sizes:
        counts[r["n_tokens"]] = r["n"]
    bound = lower_bound(counts, capacity)
    return packed.agg(F.count_distinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens")).select("containers", F.lit(bound).cast("bigint").alias("lower_bound"), (1 - F.col("tokens") / (F.col("containers") * capacity)).alias("unused"))
