"""Near-duplicate scores: groups of records whose music differs by small edits.

A count-vector R-tree finds the pairs.  The tokens of a score (its bars) are hashed into ``GROUPS``
groups; the counts per group are a point; for two points the sum of coordinate minima bounds the
number of common tokens from above.  A node's box holds for each group the largest count below it, so
the same sum with a box bounds every point in it.  Surviving pairs are verified note by note.

One tree cannot hold all scores, so trees are built in shards.  Which shards a score goes to follows
from its rarest tokens, so many that two scores with as many common tokens as the least similar
near-duplicates must meet in one (:func:`quaver.llm.music.with_keys`); a shard takes the scores of
thousands of such tokens, and within it only the tree says which to compare.  Scores whose every bar
may be changed go through trees over their runs of notes too.

Records with the same bag of bars are one class and go in once, so copies cost nothing.  A token of
more than ``CELL`` classes is split into cells: each class is held in one and looked up in those
after it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.components import connected_components
from quaver.llm.music import CHANGED, changed_notes, dense_keys, packed, prefix, with_bars, with_keys
from quaver.llm.scratch import cut

GROUPS = 1 << 16
FAN = 8
#: Classes of a shard, about, and of a cell of a frequent token; and notes of their records.
SHARD, CELL, SHARD_NOTES = 256, 2048, 4_000_000
#: Coordinates looked at in one step of a search.
_STEP = 4_000_000


class CountTree:
    """An R-tree of sparse count vectors: packed leaves of ``FAN`` points, bounding boxes above them.

    ``points`` are arrays of groups, in the order in which they are packed; ``need`` is the least
    sum of minima each point asks for, ``size`` its notes: no two points whose sizes differ by more
    than ``CHANGED`` of the smaller are paired.
    """

    def __init__(self, points: list[np.ndarray], need: np.ndarray, size: np.ndarray):
        self.n = len(points)
        self.need, self.size = need.astype(np.int64), size.astype(np.int64)
        self.owner, self.group, self.count = self._counts(points)
        self.keys = self.owner * GROUPS + self.group
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # from the leaves up: box, least need, least and largest size
        cuts = np.arange(0, self.n, FAN)
        box = np.zeros(len(cuts) * GROUPS, np.uint8)
        np.maximum.at(box, self.owner // FAN * GROUPS + self.group, np.minimum(self.count, 255).astype(np.uint8))
        box = box.reshape(-1, GROUPS)
        least, small, large = (f.reduceat(x, cuts) for f, x in ((np.minimum, self.need), (np.minimum, self.size), (np.maximum, self.size)))
        self.levels.append((box, least, small, large))
        while len(box) > FAN:
            cuts = np.arange(0, len(box), FAN)
            box = np.maximum.reduceat(box, cuts)
            least, small, large = np.minimum.reduceat(least, cuts), np.minimum.reduceat(small, cuts), np.maximum.reduceat(large, cuts)
            self.levels.append((box, least, small, large))
        #: Pairs of point and query, and of these, how many reached each level and were left at the end.
        self.seen = [0] * (len(self.levels) + 2)

    @staticmethod
    def _counts(points: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.array([len(p) for p in points], np.int64)
        flat = np.concatenate(points).astype(np.int64) if len(points) else np.zeros(0, np.int64)
        keys, count = np.unique(np.repeat(np.arange(len(points)), n) * GROUPS + flat, return_counts=True)
        return keys // GROUPS, keys % GROUPS, count

    def search(self, points: list[np.ndarray], need: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(query numbers, point numbers)`` of all pairs whose sum of coordinate minima reaches the needs of both."""
        owner, group, count = self._counts(points)
        start = np.searchsorted(owner, np.arange(len(points) + 1))
        length = np.diff(start)
        top = len(self.levels[-1][0])
        step = max(1, _STEP // max(top * int(length.max(initial=1)), 1))
        for a in range(0, len(points), step):
            q = np.repeat(np.arange(a, min(a + step, len(points))), top)
            node = np.tile(np.arange(top), len(q) // max(top, 1))
            self.seen[0] += len(q) // max(top, 1) * self.n
            for depth in range(len(self.levels) - 1, -1, -1):
                box, least, small, large = self.levels[depth]
                fits = (large[node] * (1 + CHANGED) >= size[q]) & (small[node] <= size[q] * (1 + CHANGED))
                q, node = q[fits], node[fits]
                bound = self._bounds(q, node, start, length, group, count, lambda at, g, box=box: box[at, g])
                keep = bound >= np.maximum(least[node], need[q])
                q, node = q[keep], node[keep]
                below = len(self.levels[depth - 1][0]) if depth else self.n
                q = np.repeat(q, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                q, node = q[node < below], node[node < below]
                self.seen[len(self.levels) - depth] += len(q)
            fits = (self.size[node] * (1 + CHANGED) >= size[q]) & (self.size[node] <= size[q] * (1 + CHANGED))
            q, node = q[fits], node[fits]
            bound = self._bounds(q, node, start, length, group, count, self._point)
            keep = bound >= np.maximum(self.need[node], need[q])
            self.seen[-1] += int(keep.sum())
            yield q[keep], node[keep]

    def _point(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        key = at * GROUPS + group
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.count[place], 0)

    @staticmethod
    def _bounds(q, node, start, length, group, count, at) -> np.ndarray:
        """Sum of coordinate minima of each pair of query and node."""
        out = np.zeros(len(q), np.int64)
        rows = max(1, _STEP // max(int(length.max(initial=1)), 1))
        for a in range(0, len(q), rows):
            some = slice(a, a + rows)
            n = length[q[some]]
            ends = np.cumsum(n)
            place = np.arange(int(ends[-1])) + np.repeat(start[q[some]] - (ends - n), n)
            least = np.minimum(count[place], at(np.repeat(node[some], n), group[place]))
            out[some] = np.add.reduceat(least, ends - n)
        return out


def _links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of one shard that are needed to hold its groups together.  A pair already connected here is not verified again: a group of g records leaves g - 1 links."""
    # what shares rare tokens is packed together; a class that comes by several tokens is held if one of them says so
    pdf = pdf.sort_values(["held", "least"], ascending=[False, True]).drop_duplicates("rep").sort_values(["least", "rep"], ignore_index=True)
    ids, held = pdf["rep"].to_numpy(np.int64), pdf["held"].to_numpy(bool)
    points = [np.asarray(g, np.int64) & GROUPS - 1 for g in pdf["groups"]]
    need, size, bars = pdf["need"].to_numpy(np.int64), pdf["notes"].to_numpy(np.int64), pdf["bars"].tolist()
    at = np.flatnonzero(held)
    out: list[tuple[int, int]] = []
    if len(at) and len(ids) > 1:
        parent = list(range(len(ids)))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        tree = CountTree([points[i] for i in at], need[at], size[at])
        for asks, found in tree.search(points, need, size):
            for i, j in zip(asks.tolist(), at[found].tolist(), strict=True):
                # of two that are both held, one is looked up for the other
                if i == j or held[i] and i > j or (a := find(i)) == (b := find(j)):
                    continue
                if changed_notes(bars[i].split("|"), bars[j].split("|")) <= CHANGED:
                    parent[b] = a
                    out.append((ids[i], ids[j]))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def links(items: DataFrame) -> DataFrame:
    """``(a, b)``: links between near-duplicates among ``items(rep, tokens, need, notes, bars)``, tokens distinct per item.

    A token's shard follows from the least class that is routed by it, so that classes which have
    many rare tokens in common meet once, not once a token; a class goes to no more shards than it
    has tokens to be routed by.
    """
    usual = items.agg(F.avg("notes")).first()[0] or 1
    size, cell = (max(1, min(n, int(SHARD_NOTES / usual))) for n in (SHARD, CELL))  # less where records are long
    each = items.select("rep", "need", F.explode("tokens").alias("token"))
    common = each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    # sizes within the allowed ratio share one of two neighbouring windows
    window = F.floor(F.log(F.col("notes")) / math.log(1 + CHANGED + 0.01)).cast("int")
    routes = cut(
        prefix(each.join(common, "token"), "rep").join(items.select("rep", window.alias("w")), "rep")
        .select("rep", F.explode(F.array(F.xxhash64("token", "w"), F.xxhash64("token", F.col("w") + 1))).alias("token")),
        "routes",
    )
    met = routes.groupBy("token").agg(F.count("*").alias("n"), F.min("rep").alias("least")).where("n > 1").select("token", "least", F.ceil(F.col("n") / cell).cast("int").alias("cells"))
    own = F.pmod(F.xxhash64("rep", "token"), F.col("cells")).cast("int")
    # cells of a frequent token are shards of their own
    place = F.when(F.col("cells") == 1, F.xxhash64("least")).otherwise(F.xxhash64("token", "cell"))
    visits = cut(
        routes.join(met, "token").withColumn("own", own)
        .select("token", "rep", "least", "cells", "own", F.explode(F.sequence("own", F.col("cells") - 1)).alias("cell"))
        .groupBy("rep").agg(F.collect_set(F.struct(place.alias("place"), (F.col("cells") > 1).alias("alone"), (F.col("cell") == F.col("own")).alias("held"), "least")).alias("visits")),
        "visits",
    )
    shards = max(1, math.ceil((visits.agg(F.sum(F.size("visits"))).first()[0] or 0) / size))
    shard = F.when(F.col("v.alone"), shards + F.pmod("v.place", F.lit(1 << 40))).otherwise(F.pmod("v.place", F.lit(shards)))
    group = F.transform("tokens", lambda t: F.shiftrightunsigned(t, 48).cast("int"))
    points = items.select("rep", "need", "notes", group.alias("groups"), "bars")
    return (
        visits.join(points, "rep")
        .select(F.explode("visits").alias("v"), "rep", "need", "notes", "groups", "bars")
        .select(shard.alias("shard"), "v.held", "v.least", "rep", "need", "notes", "groups", "bars")
        .groupBy("shard")
        .applyInPandas(_links, "a long, b long")
    )


def near_duplicates(scores: DataFrame) -> DataFrame:
    """``(pos, class_id, group_pos)`` for every score with music.

    Two scores are linked if their lengths differ by no more than ``CHANGED`` of the shorter's notes
    and no more of its notes have no partner in the other, bars in any order; every pair with at
    most one note in ``EDIT`` changed, added or missing is found.  ``class_id`` is the least ``pos``
    with the same bag of bars, ``group_pos`` the least of the group; belonging together carries over.
    Scores whose ``pos`` or text is null or whose text holds no music have no row; a score like no
    other is its own group; other columns are not read.
    """
    parsed = cut(packed(with_bars(scores.where("pos is not null").select("pos", "text"), "text")), "bars")
    classes = cut(with_keys(parsed.groupBy("class").agg(F.min("pos").alias("rep"), F.min("bars").alias("bars"))), "classes")
    dense = cut(dense_keys(classes), "dense")
    found = cut(links(classes).unionByName(links(dense)), "links")
    roots = connected_components(found)
    named = classes.select("class", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("class", F.col("rep").alias("class_id"), F.coalesce("root", "rep").alias("group_pos"))
    return parsed.select("pos", "class").distinct().join(named, "class").select("pos", "class_id", "group_pos")
