"""Filling fixed-capacity containers with documents, sizes in tokens.

Documents above the capacity are divided into full containers and a rest; nothing else is divided.  Items are spread
over groups of bounded size by hash.  Each group is packed best-fit by falling size, then a swap-based local search
works on its underfull bins: it moves, exchanges one for one or two for one whenever that increases the sum of squared
fills, until bins empty.  What still lies in underfull bins is pooled over the groups and packed again in fewer groups.

Defined results: null and empty texts are in no container; ties and repeated rows are placed once each; an empty table
gives no container.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.tokens import TOKENIZERS, count_tokens
from blockloom.session import cut

CAPACITY = 2048
#: Items of one group, about; groups grow in number with the data.
GROUP_ITEMS = 20_000
#: A bin filled less than this is packed again with those of other groups.
FULL_ENOUGH = 0.98
#: Rounds of packing what lies in underfull bins; each has about a tenth of the groups of the one before.
ROUNDS = 3


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: items by falling size, each into the fullest bin it fits in."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # rooms that some bin has, sorted
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        k = bisect_left(rooms, size)
        if k < len(rooms):
            room = rooms[k]
            b = by_room[room].pop()
            if not by_room[room]:
                del rooms[k]
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - size
        if not by_room[left]:
            insort(rooms, left)
        by_room[left].append(b)
    return bins


class Search:
    """Local search over the underfull bins of one group.

    Bins are tried from the least filled.  Its items are moved to the bin with the tightest room, or exchanged for one
    or two smaller items of a fuller bin; each step increases the sum of squared fills, so the search ends.
    """

    def __init__(self, sizes: np.ndarray, bins: list[list[int]], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins = {b: items for b, items in enumerate(bins)}
        self.room = np.array([capacity - int(sizes[items].sum()) for items in bins], dtype=np.int64)

    def run(self) -> list[list[int]]:
        order = sorted((b for b in self.bins if self.room[b] > 0), key=lambda b: (-self.room[b], b))
        alive = np.zeros(len(self.room), dtype=bool)
        alive[order] = True
        for source in order:
            improved = True
            while improved and self.bins[source]:
                improved = False
                for item in sorted(self.bins[source], key=lambda i: -self.sizes[i]):
                    if self._place(source, item, alive):
                        improved = True
                        break
            alive[source] = False
        return [items for items in self.bins.values() if items]

    def _place(self, source: int, item: int, alive: np.ndarray) -> bool:
        size = int(self.sizes[item])
        fuller = alive & (self.room <= self.room[source])
        fuller[source] = False
        at = np.flatnonzero(fuller)
        if not len(at):
            return False
        fits = at[self.room[at] >= size]
        if len(fits):
            self._swap(source, [item], int(fits[np.argmin(self.room[fits])]), [])
            return True
        # one for one, or two of the other bin for this one: the tightest that leaves the other bin fuller
        best, choice = None, None
        for b in at[self.room[at] > 0].tolist():
            room = int(self.room[b])
            items = sorted(self.bins[b], key=lambda i: self.sizes[i])
            own = [int(self.sizes[i]) for i in items]
            k = bisect_left(own, size - room)  # the smallest item whose place is large enough
            if k < len(own) and own[k] < size and (best is None or room + own[k] - size < best):
                best, choice = room + own[k] - size, (b, [items[k]])
            lo, hi = 0, len(own) - 1
            while lo < hi:
                both = own[lo] + own[hi]
                if both >= size:
                    hi -= 1
                else:
                    if room + both >= size and (best is None or room + both - size < best):
                        best, choice = room + both - size, (b, [items[lo], items[hi]])
                    lo += 1
            if best == 0:
                break
        if choice is None:
            return False
        self._swap(source, [item], *choice)
        return True

    def _swap(self, source: int, give: list[int], target: int, take: list[int]) -> None:
        gain = int(self.sizes[give].sum()) - int(self.sizes[take].sum() if take else 0)
        self.bins[source] = [i for i in self.bins[source] if i not in give] + take
        self.bins[target] = [i for i in self.bins[target] if i not in take] + give
        self.room[source] += gain
        self.room[target] -= gain


def pack(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers of one group."""
    if not len(sizes):
        return []
    return Search(sizes, best_fit(sizes, capacity), capacity).run()


def _pack_groups(capacity: int, last: bool):
    def run(key: tuple, frames: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        frame = frames.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        sizes = frame["n_tokens"].to_numpy(dtype=np.int64)
        number = np.zeros(len(sizes), dtype=np.int64)
        fill = np.zeros(len(sizes), dtype=np.int64)
        for b, items in enumerate(pack(sizes, capacity)):
            number[items] = b
            fill[items] = sizes[items].sum()
        frame["bin"], frame["done"] = number, last | (fill >= capacity * FULL_ENOUGH)
        return frame[["doc_id", "piece", "n_tokens", "grp", "bin", "done"]]

    return run


def fill_containers(documents: DataFrame, capacity: int = CAPACITY, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(container, doc_id, piece, n_pieces, first_token, n_tokens): where each part of each document lies."""
    sized = count_tokens(documents, tokenizers).where("n_tokens > 0")
    parts = F.expr(f"CAST(ceil(n_tokens / CAST({capacity} AS DOUBLE)) AS INT)")
    items = sized.select("doc_id", "n_tokens", parts.alias("n_pieces")).select(
        "doc_id",
        "n_pieces",
        F.explode(F.expr("sequence(0, n_pieces - 1)")).alias("piece"),
        F.col("n_tokens").alias("total"),
    )
    items = items.select(
        "doc_id", "piece", F.expr(f"CAST(least({capacity}, total - CAST(piece AS LONG) * {capacity}) AS LONG)").alias("n_tokens"), "n_pieces"
    )
    items = cut(items)
    placed = [items.where(F.col("n_tokens") == capacity).select("doc_id", "piece", "n_tokens", F.lit("f").alias("round"), F.lit(0).alias("grp"), F.lit(0).cast("long").alias("bin"))]
    rest = items.where(F.col("n_tokens") < capacity).select("doc_id", "piece", "n_tokens")
    for k in range(ROUNDS):
        count = rest.count()
        if not count:
            break
        last = k == ROUNDS - 1 or count <= GROUP_ITEMS
        groups = max(1, -(-count // GROUP_ITEMS))
        grouped = rest.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", F.lit(k)), F.lit(groups)).cast("int"))
        done = cut(
            grouped.groupBy("grp").applyInPandas(_pack_groups(capacity, last), "doc_id long, piece int, n_tokens long, grp int, bin long, done boolean")
        )
        placed.append(done.where("done").select("doc_id", "piece", "n_tokens", F.lit(str(k)).alias("round"), "grp", "bin"))
        rest = done.where("NOT done").select("doc_id", "piece", "n_tokens")
        if last:
            break
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    name = F.when(F.col("round") == "f", F.concat_ws("-", "round", "doc_id", "piece")).otherwise(F.concat_ws("-", "round", "grp", "bin"))
    first = F.col("piece").cast("long") * capacity
    return out.select(name.alias("container"), "doc_id", "piece", first.alias("first_token"), "n_tokens")
