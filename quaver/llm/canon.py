"""Mapping of freely typed values to the entries of a reference list.

Entries (terms and their aliases) are held in BK-trees under Levenshtein distance, a true metric:
the triangle inequality then rules out whole subtrees, and every entry within the allowed distance
is returned.  A search starts near the value and is widened only for values that found nothing, as
a wide one rules out little.  It runs level by level for a batch of values at once, each level's
distances in one array computation of at most ``FRONTIER`` pairs of value and entry; what is beyond waits.

Reference lists of up to ``SHARD_ENTRIES`` entries are broadcast as one tree a field; longer ones
are dealt to shards, every value visits each shard, and the shards' winners are merged.  Values are
spread over tasks by the pairs they may make.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.llm.fold import folded_py
from quaver.llm.scratch import cut

SHARD_ENTRIES = 20_000
FRONTIER = 50_000
#: Pairs of value and entry a task may have to look at.
TASK_PAIRS = 500_000

#: Words typed beside a value that say nothing about it.
_BRACKET = re.compile(r"\([^)]*\)?")
_BESIDE = re.compile(r"\S*\)|\b(?:no|nr|op|nos)\b\.?\s*\d*|\b(?:solo|ad lib|adlib)\b")
_NUMERAL = re.compile(r"(?:i{1,3}|iv|vi{0,3}|s)")


def plain(value: str) -> str:
    """Words of ``value`` in a plain form: no case, accents, width, look-alikes, numbers, remarks in brackets or marks; "b, a" reads "a b"."""
    text = _BESIDE.sub(" ", _BRACKET.sub(" ", folded_py(value).replace("ß", "ss").replace("_", " ")))
    text = re.sub(r"\b\w{1,3}\.?\s*\d+|\d+", " ", text)
    parts = [w for w in ("".join(c if c.isalpha() else " " for c in p).split() for p in text.split(",")) if w]
    words = [w for p in [*parts[1:], *parts[:1]] for w in p]
    while len(words) > 1 and _NUMERAL.fullmatch(words[-1]):
        words.pop()
    return " ".join(words)


def allowed(length: int) -> int:
    """Edits a value of ``length`` letters may have: one in three, at least one."""
    return max(1, length // 3)


def reach(length: int) -> int:
    """Distance within which entries are looked for: as one exchange of neighbours is two edits, never less than two from four letters on."""
    return max(allowed(length), 2 if length > 3 else 1)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(w) for w in words], np.int32)
    out = np.zeros((len(words), max(int(n.max(initial=0)), 1)), np.int32)
    for i, w in enumerate(words):
        out[i, : len(w)] = [ord(c) for c in w]
    return out, n


def distances(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Levenshtein distances of many pairs, row by row of the usual table."""
    if not len(na):
        return np.zeros(0, np.int32)
    width = int(nb.max(initial=0))
    b = b[:, :width]
    step = np.arange(width + 1, dtype=np.int32)
    row = np.broadcast_to(step, (len(na), width + 1)).copy()
    done = np.where(na == 0, nb, 0).astype(np.int32)
    for i in range(int(na.max(initial=0))):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (b != a[:, i, None]), out=new[:, 1:])
        # insertions: a running minimum of (value - column)
        row = np.minimum.accumulate(new - step, axis=1) + step
        last = na == i + 1
        if last.any():
            done[last] = row[last, nb[last]]
    return done


class BKTree:
    """Entries in levels: a node's child at distance d holds what is at distance d from the node."""

    def __init__(self, words: list[str]):
        self.words = words
        self.codes, self.length = _codes(words)
        n = len(words)
        self.child: list[dict[int, int]] = [{} for _ in range(n)]
        waiting = np.arange(1, n)
        at = np.zeros(max(n - 1, 0), np.int64)
        while len(waiting):
            d = distances(self.codes[waiting], self.length[waiting], self.codes[at], self.length[at])
            nxt, where = [], []
            for i, node, dist in zip(waiting.tolist(), at.tolist(), d.tolist(), strict=True):
                if dist in self.child[node]:
                    nxt.append(i)
                    where.append(self.child[node][dist])
                else:
                    self.child[node][dist] = i
            waiting, at = np.array(nxt, np.int64), np.array(where, np.int64)
        # children as flat arrays
        self.start = np.zeros(n + 1, np.int64)
        kids, dists = [], []
        for i, c in enumerate(self.child):
            for dist, k in c.items():
                kids.append(k)
                dists.append(dist)
            self.start[i + 1] = len(kids)
        self.kids, self.dists = np.array(kids, np.int64), np.array(dists, np.int32)

    def within(self, values: list[str], radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(value number, entry number, distance)`` of every entry within each value's radius."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        codes, length = _codes(values)
        waiting = [(np.arange(len(values)), np.zeros(len(values), np.int64))] if self.words else []
        while waiting:
            q, node = waiting.pop()
            if len(q) > FRONTIER:
                waiting += [(q[a : a + FRONTIER], node[a : a + FRONTIER]) for a in range(0, len(q), FRONTIER)]
                continue
            wide = max(int(length[q].max(initial=1)), 1)
            d = distances(codes[q, :wide], length[q], self.codes[node], self.length[node])
            near = d <= radius[q]
            found.append((q[near], node[near], d[near]))
            count = self.start[node + 1] - self.start[node]
            pick = np.repeat(np.arange(len(q)), count)
            edge = np.arange(len(pick)) - np.repeat(np.cumsum(count) - count, count) + self.start[node][pick]
            may = np.abs(self.dists[edge] - d[pick]) <= radius[q[pick]]
            if may.any():
                waiting.append((q[pick[may]], self.kids[edge[may]]))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def nearest(self, values: list[str], radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As :meth:`within`, but of every value only the entries at the least distance, if that is within its radius."""
        left, out = np.arange(len(values)), []
        for step in (0, 1, 3, 1 << 20):
            if not len(left):
                break
            near = np.minimum(radius[left], step)
            q, node, d = self.within([values[i] for i in left], near)
            least = np.full(len(left), 1 << 20)
            np.minimum.at(least, q, d)
            keep = d == least[q]
            out.append((left[q[keep]], node[keep], d[keep]))
            left = left[(least == 1 << 20) & (radius[left] > step)]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _swaps(a: str, b: str) -> int:
    """Distance with exchanges of neighbours as one edit; decides between entries equally near."""
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        two, one = one, row
    return one[-1]


def _turns(form: str) -> list[str]:
    """The words of a form in every rotation: "orchestra string" also reads "string orchestra"."""
    w = form.split(" ")
    return [" ".join(w[k:] + w[:k]) for k in range(len(w))]


class Matcher:
    """The entries of one shard, a BK-tree a field."""

    def __init__(self, entries: pd.DataFrame):
        self.trees: dict[str, tuple[BKTree, np.ndarray]] = {}
        entries = entries.assign(form=[plain(e) for e in entries["entry"]])
        for field, part in entries[entries["form"] != ""].groupby("field_name"):
            part = part.sort_values(["form", "term_id"]).drop_duplicates("form")
            self.trees[field] = (BKTree(part["form"].tolist()), part["term_id"].to_numpy(np.int64))

    def best(self, field: str, values: list[str]) -> pd.DataFrame:
        """Nearest entry of each value: ``value, term_id, edits, swaps``; no row without one in reach."""
        tree, ids = self.trees.get(field, (BKTree([]), np.zeros(0, np.int64)))
        turned = [(i, t) for i, v in enumerate(values) for t in _turns(plain(v)) if t]
        radius = np.array([reach(len(t)) for _, t in turned], np.int32)
        q, node, d = tree.nearest([t for _, t in turned], radius)
        rows: dict[int, tuple] = {}
        own = np.array([i for i, _ in turned], np.int64)[q]
        least = np.full(len(values), 1 << 20)
        np.minimum.at(least, own, d)
        keep = d == least[own]
        for i, k, n, dist in zip(own[keep].tolist(), q[keep].tolist(), node[keep].tolist(), d[keep].tolist(), strict=True):
            swaps = _swaps(turned[k][1], tree.words[n]) if dist else 0
            if min(dist, swaps) > allowed(len(turned[k][1])):
                continue
            rows[i] = min(rows.get(i, (1 << 20, 0, 0)), (dist, swaps, int(ids[n])))
        return pd.DataFrame([(values[i], t, d, s) for i, (d, s, t) in rows.items()], columns=["value", "term_id", "edits", "swaps"])


def _entries(terms: DataFrame) -> DataFrame:
    names = F.concat(F.array("term"), F.coalesce(F.col("aliases"), F.array().cast("array<string>")))
    return terms.where("term_id is not null and field_name is not null").select("term_id", "field_name", F.explode(names).alias("entry")).where("entry is not null")


def canonical(values: DataFrame, terms: DataFrame) -> DataFrame:
    """``(field_name, value, term_id, edits)``: the entry meant by each distinct value, 0 if there is none.

    ``values(field_name, value)`` may repeat; ``terms(term_id, field_name, term, aliases)``.  Nulls
    have no row; blank values and values of nothing but marks mean no entry.  Of entries equally near
    the one nearer by exchanges of letters counts, then the smaller ``term_id``.
    """
    spark = values.sparkSession
    entries = _entries(terms)
    n = entries.count()
    shards = max(1, -(-n // SHARD_ENTRIES))
    distinct = cut(values.where("field_name is not null and value is not null").select("field_name", "value").distinct(), "distinct")
    # a task gets values for a bounded number of pairs
    parts = max(1, -(-distinct.count() * min(n, SHARD_ENTRIES) // TASK_PAIRS))
    if shards == 1:
        lists = [entries.toPandas()]  # at most SHARD_ENTRIES rows
        asked = distinct.withColumn("shard", F.lit(0))
    else:
        asked = distinct.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        lists = []
    schema = "field_name string, value string, term_id long, edits int, swaps int"

    def answer(pdf: pd.DataFrame, matcher: Matcher) -> pd.DataFrame:
        parts = [matcher.best(field, p["value"].tolist()).assign(field_name=field) for field, p in pdf.groupby("field_name")]
        parts = [p for p in parts if len(p)]
        out = pd.concat(parts) if parts else pd.DataFrame(columns=["field_name", "value", "term_id", "edits", "swaps"])
        return out[["field_name", "value", "term_id", "edits", "swaps"]].astype({"term_id": "int64", "edits": "int32", "swaps": "int32"})

    if shards == 1:
        held = spark.sparkContext.broadcast(lists[0])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = Matcher(held.value)
            for pdf in batches:
                yield answer(pdf, matcher)

        found = asked.drop("shard").repartition(parts, "value").mapInPandas(run, schema)
    else:
        sharded = entries.withColumn("shard", F.pmod(F.xxhash64("field_name", "entry"), F.lit(shards)).cast("int"))

        def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            return answer(left, Matcher(right))

        # a part of the values meets one shard of the entries
        part = F.pmod(F.xxhash64("value"), F.lit(parts)).cast("int")
        spread = sharded.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        found = asked.withColumn("part", part).groupBy("shard", "part").cogroup(spread.groupBy("shard", "part")).applyInPandas(one, schema)
    best = found.groupBy("field_name", "value").agg(F.min(F.struct("edits", "swaps", "term_id")).alias("b")).select("field_name", "value", F.col("b.term_id").alias("term_id"), F.col("b.edits").alias("edits"))
    return distinct.join(best, ["field_name", "value"], "left").select("field_name", "value", F.coalesce("term_id", F.lit(0).cast("long")).alias("term_id"), "edits")


def is_blank(c: Column) -> Column:
    """Whether a value shows nothing: empty, or white space of any kind."""
    return F.regexp_replace(c, r"(?U)[\s  ​‌‍⁠﻿]+", "") == ""


def typed_values(scores: DataFrame, lists: list[str], scalars: list[str]) -> DataFrame:
    """``(pos, field_name, item_no, value)``: every value of the scalar and array columns that is neither null nor blank."""

    def numbered(c: str) -> Column:
        return F.transform(F.col(c), lambda v, i: F.struct(F.lit(c).alias("field_name"), i.cast("int").alias("item_no"), v.alias("value")))

    items = [numbered(c) for c in lists]
    one = [F.array(F.struct(F.lit(c).alias("field_name"), F.lit(0).alias("item_no"), F.col(c).alias("value"))) for c in scalars]
    empty = F.array().cast("array<struct<field_name:string,item_no:int,value:string>>")
    every = F.concat(*[F.coalesce(x, empty) for x in (*one, *items)])
    return scores.select("pos", F.explode(every).alias("v")).select("pos", "v.*").where(F.col("value").isNotNull() & ~is_blank(F.col("value")))


def not_exact(values: DataFrame, terms: DataFrame) -> DataFrame:
    """Values that are not written exactly as a term of their field."""
    exact = terms.select("field_name", F.col("term").alias("value")).where("value is not null").distinct()
    return values.join(exact, ["field_name", "value"], "left_anti")


def mapped(scores: DataFrame, terms: DataFrame) -> DataFrame:
    """``(pos, field_name, item_no, value, term_id)`` for every value of ``style``, ``musical_form`` and ``ensemble`` that is not a term as written; ``term_id`` 0 if it means none."""
    loose = cut(not_exact(typed_values(scores, ["musical_form", "ensemble"], ["style"]), terms), "values")
    return loose.join(canonical(loose.select("field_name", "value"), terms), ["field_name", "value"]).select("pos", "field_name", "item_no", "value", "term_id")
