"""Filling fixed-capacity containers by best-two-fit."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import stage

BLOCK_ITEMS = 20_000


class _Stock:
    """Unpacked items by size: counts per size and the sizes that are left, in order."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.count = np.bincount(sizes, minlength=capacity + 1)
        self.count[0] = 0
        self.left = int(self.count.sum())
        # below[s]: the largest size <= s that is left, by path halving over used-up sizes
        self.down = np.arange(capacity + 1)
        for s in range(1, capacity + 1):
            if not self.count[s]:
                self.down[s] = s - 1

    def below(self, s: int) -> int:
        down = self.down
        while down[s] != s:
            down[s] = down[down[s]]
            s = down[s]
        return int(s)

    def take(self, s: int) -> None:
        self.count[s] -= 1
        self.left -= 1
        if not self.count[s]:
            self.down[s] = s - 1

    def put(self, s: int) -> None:
        """Give an item back. Only sizes that are still linked can be found again, so a size that was
        used up is linked anew, and sizes that pointed past it are reset."""
        if not self.count[s]:
            self.down[s] = s
            live = np.flatnonzero(self.count)
            self.count[s] = 1
            above = live[live > s]
            stop = int(above[0]) if len(above) else len(self.down)
            self.down[s + 1 : stop] = s
        else:
            self.count[s] += 1
        self.left += 1


def best_two_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Containers as lists of sizes (1 .. capacity). Each is filled greedily with the largest item that
    fits; then its smallest item is replaced by two unpacked ones that fit the widened gap more tightly,
    if there are such."""
    stock = _Stock(sizes, capacity)
    out: list[list[int]] = []
    while stock.left:
        gap, bin_ = capacity, []
        while gap:
            s = stock.below(gap)
            if not s:
                break
            stock.take(s)
            bin_.append(s)
            gap -= s
        if gap and len(bin_) > 0 and stock.left >= 2:
            small = bin_[-1]
            room = gap + small
            left = np.flatnonzero(stock.count[: room + 1])
            if len(left):
                # the best partner of each size: the largest that still fits beside it
                partner = np.searchsorted(left, room - left, side="right") - 1
                ok = partner >= 0
                a, b = left[ok], left[partner[ok]]
                twice = (a == b) & (stock.count[a] < 2)
                # an item is no partner of itself: then the next smaller one
                lower = np.maximum(partner[ok] - 1, 0)
                b = np.where(twice, np.where(partner[ok] > 0, left[lower], 0), b)
                fill = np.where(b > 0, a + b, 0)
                best = int(fill.argmax()) if len(fill) else -1
                if best >= 0 and fill[best] > small:
                    bin_.pop()
                    stock.take(int(a[best]))
                    stock.take(int(b[best]))
                    bin_ += [int(a[best]), int(b[best])]
                    stock.put(small)
        out.append(bin_)
    return out


def _pack_block(pdf: pd.DataFrame) -> pd.DataFrame:
    capacity = int(pdf["capacity_tokens"].iloc[0])
    block = int(pdf["block"].iloc[0])
    pdf = pdf.sort_values(["tokens", "doc_id", "piece"], kind="stable", ignore_index=True)
    sizes = pdf["tokens"].to_numpy()
    rows = defaultdict(list)
    for i, s in enumerate(sizes.tolist()):
        rows[s].append(i)
    bins = best_two_fit(sizes[sizes > 0], capacity)
    container = np.zeros(len(pdf), dtype=np.int64)
    position = np.zeros(len(pdf), dtype=np.int64)
    for b, items in enumerate(bins):
        for p, s in enumerate(items):
            i = rows[s].pop()
            container[i], position[i] = b, p
    # empty texts take no room: they go to the end of the block's last container
    last = max(len(bins) - 1, 0)
    base = len(bins[last]) if bins else 0
    for p, i in enumerate(rows.get(0, [])):
        container[i], position[i] = last, base + p
    return pd.DataFrame({
        "capacity_id": pdf["capacity_id"], "doc_id": pdf["doc_id"], "piece": pdf["piece"], "tokens": pdf["tokens"],
        "container_id": (np.int64(block) << 32) + container, "position": position.astype(np.int32),
    })


def pack(sizes: DataFrame, capacities: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(capacity_id, doc_id, piece, tokens, container_id, position) for every text or piece of a text.

    ``sizes`` has (doc_id, tokens). A text longer than the capacity is split into pieces of the capacity
    and one rest; no other text is split. Null and empty texts (0 tokens) are items that take no room.
    Items are dealt by hash to blocks of about ``block_items`` and each block is packed on its own, so a
    block's memory is bounded and all that is lost is part of one container per block. Equal sizes are
    told apart by ``doc_id``, so the result is the same however rows arrive. A capacity below 1 or null
    gets no containers. Repeated doc_ids are items of their own. Empty input gives no rows.
    """
    cap = capacities.where("capacity_tokens > 0").select("capacity_id", F.col("capacity_tokens").cast("long").alias("capacity_tokens"))
    base = sizes.select("doc_id", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    n = base.count()
    blocks = max(1, math.ceil(n / block_items))
    # every text once for each capacity: the capacities are a fixed, small list
    items = [
        base.select(
            F.lit(c.capacity_id).alias("capacity_id"),
            F.lit(c.capacity_tokens).alias("capacity_tokens"),
            "doc_id",
            "tokens",
            F.posexplode(F.expr(f"CASE WHEN tokens <= {c.capacity_tokens} THEN array(tokens) ELSE concat(array_repeat({c.capacity_tokens}L, int(tokens div {c.capacity_tokens})), filter(array(tokens % {c.capacity_tokens}), x -> x > 0)) END")).alias("piece", "part"),
        )
        for c in cap.orderBy("capacity_id").collect()
    ]
    if not items:
        return base.limit(0).select(F.lit(0).alias("capacity_id"), "doc_id", F.lit(0).alias("piece"), "tokens", F.lit(0).cast("long").alias("container_id"), F.lit(0).alias("position"))
    rows = items[0]
    for more in items[1:]:
        rows = rows.unionByName(more)
    rows = rows.select("capacity_id", "capacity_tokens", "doc_id", "piece", F.col("part").alias("tokens"), F.pmod(F.xxhash64("doc_id", "piece", "tokens"), F.lit(blocks)).cast("long").alias("block"))
    return rows.groupBy("capacity_id", "block").applyInPandas(_pack_block, "capacity_id int, doc_id long, piece int, tokens long, container_id long, position int")


def pack_texts(docs: DataFrame, capacities: DataFrame, path: str, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Containers of all texts, measured in tokens of the vocabulary at ``path``."""
    from tessella.llm.tokenizer import sizes

    return pack(stage(sizes(docs, path=path), "token-sizes"), capacities, block_items)


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens, and the share of room that is used."""
    each = packed.groupBy("capacity_id").agg(F.countDistinct("container_id").alias("n_containers"), F.count(F.lit(1)).alias("n_items"), F.sum("tokens").alias("tokens"))
    return each.join(F.broadcast(capacities), "capacity_id").withColumn("fill", F.try_divide("tokens", F.col("n_containers") * F.col("capacity_tokens")))


def packing_checks(packed: DataFrame, sizes: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per capacity what must hold of any packing: (capacity_id, n_texts, lost_tokens, overfull, same_place, split_short, tight).

    ``n_texts``: texts that have a place; ``lost_tokens``: tokens without one, or placed twice; ``overfull``: containers
    above the capacity; ``same_place``: places taken twice; ``split_short``: texts in pieces that would fit
    whole; ``tight``: no more than one container and one in a hundred beyond what the tokens need."""
    cap = F.broadcast(capacities.select("capacity_id", F.col("capacity_tokens").cast("long").alias("capacity_tokens")))
    bins = packed.groupBy("capacity_id", "container_id").agg(F.sum("tokens").alias("t"), (F.count(F.lit(1)) - F.count_distinct("position")).alias("same")).join(cap, "capacity_id")
    per_bin = bins.groupBy("capacity_id").agg(F.sum("t").alias("placed"), F.count_if(F.col("t") > F.col("capacity_tokens")).alias("overfull"), F.sum("same").alias("same_place"), F.count(F.lit(1)).alias("n"), F.max("capacity_tokens").alias("c"))
    texts = packed.groupBy("capacity_id", "doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("k")).join(cap, "capacity_id")
    per_text = texts.groupBy("capacity_id").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if((F.col("k") > 1) & (F.col("t") <= F.col("capacity_tokens"))).alias("split_short"))
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    t = per_bin.join(per_text, "capacity_id").join(F.broadcast(total), F.lit(True))
    need = F.ceil(F.col("total") / F.col("c"))
    return t.select("capacity_id", "n_texts", (F.col("total") - F.col("placed")).alias("lost_tokens"), "overfull", "same_place", "split_short", (F.col("n") <= need + 1 + need / 100).alias("tight"))
