"""Train, validation and test splits that keep related records together.

Records tied by composer, work, song or manuscript form components (:func:`related`).  Whole
components are then put into splits by a component swap search (:func:`assign_splits`): a hashed
start, then annealing moves and exchanges of whole components that lower the deviation of sizes and
label counts from their targets, keeping the best state.

The search runs in two levels, so no task and no driver sees all components:

* head: components of at least ``1/HEAD_PART`` of all rows, of which there can be at most
  ``HEAD_PART``.  Several chains anneal them in parallel tasks; the best chain is kept.
* tail: all other components, dealt by hash to shards of bounded size; each shard anneals towards
  its part of what the head left open.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaver.llm.components import connected_components
from quaver.llm.fold import folded
from quaver.llm.people import persons, with_person
from quaver.llm.scratch import cut

HEAD_PART = 2000
CHAINS = 8
SHARD_ROWS = 8000
MAX_LABELS = 16

#: Folded sigla that stand for "not known".
NO_SIGLUM = ["", "ss", "unknown", "na", "sn", "none", "null", "notknown", "unk"]


def work_key(source_id: Column) -> Column:
    """Key of the work or song a ``source_id`` names: without part, extension and letter case.

    ``Q2_<song>_<n>`` names a clip of a song; ``<catalogue>_<number>_<form>[_<part>]`` a part of a work; anything else is its own work.
    """
    s = F.regexp_replace(folded(source_id), r"\.ly$", "")
    song = F.regexp_extract(s, r"^q[1-4]_([a-z0-9]+)_\d+$", 1)
    work = F.regexp_extract(s, r"^([a-z]+_\d+_[a-z]+)(?:_.*)?$", 1)
    return F.when(song != "", F.concat(F.lit("s:"), song)).when(work != "", F.concat(F.lit("w:"), work)).when(s != "", F.concat(F.lit("w:"), s))


def siglum_key(siglum: Column) -> Column:
    """Key of a manuscript: its letters and numbers in order, null if not known."""
    runs = F.regexp_extract_all(folded(siglum), F.lit(r"([a-z]+|\d+)"), F.lit(1))
    tight = F.array_join(runs, "")
    return F.when(~tight.isin(NO_SIGLUM) & tight.rlike(r"\d"), F.concat(F.lit("m:"), F.array_join(runs, ".")))


def song_key(song_id: Column) -> Column:
    s = folded(song_id)
    return F.when(s.rlike("^[a-z0-9]+$") & ~s.isin(NO_SIGLUM), F.concat(F.lit("s:"), s))


def quadrant(label: Column) -> Column:
    """``Q1`` to ``Q4`` for any spelling of an emotion label, else null."""
    n = F.regexp_extract(folded(label), r"^(?:q|quadrant)?\s*\.?\s*([1-4])$", 1)
    return F.when(n != "", F.concat(F.lit("Q"), n))


def related(scores: DataFrame) -> DataFrame:
    """``(pos, group_pos)`` for every score; ``group_pos`` is the least ``pos`` of its component.

    Null or unknown values tie nothing; a score without any key is a group of its own; rows without
    ``pos`` are left out; repeated rows fall together.  Ties are joined on the *distinct* pairs of
    keys, so a composer with a third of the rows costs no more than its distinct works.
    """
    extra = lambda k: F.try_element_at("extras", F.lit(k))
    base = with_person(
        scores.where("pos is not null").select(
            "pos",
            "composer",
            work_key(F.col("source_id")).alias("work"),
            siglum_key(extra("siglum")).alias("siglum"),
            song_key(extra("song_id")).alias("song"),
        ),
        "composer",
    )
    own = F.concat(F.lit("p:"), F.col("pos").cast("string"))
    main = F.coalesce("work", "song", "siglum", own)
    keyed = base.select("pos", F.xxhash64(main).alias("main"), main.alias("main_key"), "siglum", "song", "sur", "ini", "full", "as_written")
    slim = cut(
        keyed.groupBy("main", "main_key", "siglum", "song", "sur", "ini", "full", "as_written").agg(F.min("pos").alias("pos")),
        "ties",
    )
    who = persons(slim.select("sur", "ini", "full", "as_written").distinct())
    by_person = (
        slim.select("main", "as_written").distinct().join(who, "as_written").where("person is not null")
        .select(F.col("main").alias("a"), F.xxhash64(F.concat(F.lit("c:"), "person")).alias("b"))
    )
    by_key = slim.select("main", F.explode(F.array("siglum", "song")).alias("k")).where("k is not null").select(F.col("main").alias("a"), F.xxhash64("k").alias("b"))
    roots = connected_components(by_person.unionByName(by_key).distinct())
    firsts = slim.groupBy("main").agg(F.min("pos").alias("pos"))
    rooted = firsts.join(roots, firsts["main"] == roots["node"], "left").select("main", "pos", F.coalesce("root", "main").alias("root"))
    least = rooted.groupBy("root").agg(F.min("pos").alias("group_pos"))
    groups = rooted.join(least, "root").select("main", "group_pos")
    return keyed.select("pos", "main").distinct().join(groups, "main").select("pos", "group_pos")


def _anneal(counts: np.ndarray, target: np.ndarray, start: np.ndarray, rng: np.random.Generator, steps: int) -> tuple[float, np.ndarray]:
    """Best assignment found for components with ``counts`` (rows: components; columns: size, then labels).

    The cost is the squared deviation from ``target`` (rows: splits), each column relative to its total.
    """
    n, k = len(counts), len(target)
    if not n:
        return 0.0, start
    scale = 1.0 / np.maximum(target.sum(axis=0), 1.0)
    scale[1:] *= 0.5
    c = counts * scale
    goal = target * scale
    at = start.copy()
    gap = -goal.copy()
    np.add.at(gap, at, c)
    cost = float((gap**2).sum())
    best, best_at = cost, at.copy()
    heat = max(cost / 4, 1e-9)
    cool = (1e-6) ** (1.0 / max(steps, 1))
    pick = rng.integers(0, n, size=(steps, 2))
    to = rng.integers(0, k, size=steps)
    luck = rng.random(steps)
    for i in range(steps):
        a, b = pick[i]
        s = at[a]
        if i & 1:  # exchange
            t = at[b]
            if s == t:
                continue
            d = c[a] - c[b]
        else:  # move
            t = to[i]
            if s == t:
                continue
            d = c[a]
        gs, gt = gap[s] - d, gap[t] + d
        delta = float(gs @ gs + gt @ gt - gap[s] @ gap[s] - gap[t] @ gap[t])
        if delta <= 0 or luck[i] < math.exp(-delta / heat):
            gap[s], gap[t] = gs, gt
            at[a] = t
            if i & 1:
                at[b] = s
            cost += delta
            if cost < best - 1e-15:
                best, best_at = cost, at.copy()
        heat *= cool
    return best, best_at


def _hashed(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) of each id and the seed."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((2 * seed + 1) * 0xD6E8FEB86659FD93 % (1 << 64))
    for shift in (32, 29):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(11)).astype(float) / (1 << 53)


def assign_splits(scores: DataFrame, plan: DataFrame, seed: int = 0, label: Column | None = None) -> DataFrame:
    """``(pos, group_pos, split)``: every score's component and split.

    ``plan(split, share)`` is a small table of a row per split; one without a positive share raises.
    Shares are scaled to sum to 1.  ``label`` is the column whose distribution should be
    alike in all splits (default: the emotion quadrant); its ``MAX_LABELS`` most frequent values are
    balanced one by one, all others together.
    """
    shares = [(r["split"], float(r["share"] or 0)) for r in plan.where("split is not null").orderBy(F.desc("share"), "split").collect()]
    if sum(x for _, x in shares) <= 0:
        raise ValueError("split_plan needs splits with positive shares")
    names = [s for s, _ in shares]
    share = np.array([x for _, x in shares]) / sum(x for _, x in shares)
    label = quadrant(F.try_element_at("extras", F.lit("label"))) if label is None else label
    groups = cut(related(scores), "groups")
    labels = scores.where("pos is not null").select("pos", F.coalesce(label, F.lit("(none)")).alias("label")).groupBy("pos").agg(F.min("label").alias("label"))
    top = [r["label"] for r in labels.groupBy("label").count().orderBy(F.desc("count"), "label").limit(MAX_LABELS).collect()]
    slot = F.coalesce(*[F.when(F.col("label") == v, F.lit(i)) for i, v in enumerate(top)], F.lit(len(top))) if top else F.lit(0)
    width = len(top) + 1
    sized = cut(
        groups.join(labels, "pos").groupBy("group_pos").agg(F.count("*").alias("n"), *[F.count_if(slot == i).alias(f"l{i}") for i in range(width)]),
        "sizes",
    )
    cols = ["n", *[f"l{i}" for i in range(width)]]
    sums = sized.agg(*[F.sum(c).alias(c) for c in cols], F.count("*").alias("rows")).first()
    total = np.array([float(sums[c] or 0) for c in cols])
    target = np.outer(share, total)
    bar = max(2.0, total[0] / HEAD_PART)
    head = sized.where(F.col("n") >= bar).orderBy(F.desc("n"), "group_pos").toPandas()  # at most HEAD_PART rows, as each has 1/HEAD_PART of the total
    big, big_ids = head[cols].to_numpy(float), head["group_pos"].to_numpy(np.int64)
    rest = total - big.sum(axis=0) if len(big) else total
    k = len(names)

    def chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids in batches:
            for chain in ids["id"]:
                rng = np.random.default_rng([seed, int(chain)])
                start = np.searchsorted(np.cumsum(share)[:-1], _hashed(big_ids, seed + int(chain)), side="right")
                # the tail fills what the head leaves, so it counts as already dealt by share
                cost, at = _anneal(big, target - np.outer(share, rest), start, rng, steps=40 * len(big) + 2000)
                yield pd.DataFrame({"cost": [cost], "chain": [int(chain)], "at": [at.tolist()]})

    at = np.zeros(0, int)
    if len(big):
        spark = scores.sparkSession
        best = spark.range(CHAINS, numPartitions=CHAINS).mapInPandas(chains, "cost double, chain long, at array<int>").orderBy("cost", "chain").first()
        at = np.array(best["at"], int)
    left = target.copy()
    np.subtract.at(left, at, big)
    left = np.maximum(left, 0)
    part = left / np.maximum(left.sum(axis=0), 1e-9)  # of each column's tail, the share each split should get
    shards = max(1, math.ceil((int(sums["rows"] or 0) - len(big)) / SHARD_ROWS))

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group_pos")
        c = pdf[cols].to_numpy(float)
        goal = part * c.sum(axis=0)
        rng = np.random.default_rng([seed, 1, int(pdf["shard"].iloc[0])])
        w = part[:, 0] / max(part[:, 0].sum(), 1e-9) if part[:, 0].sum() > 0 else share
        start = np.searchsorted(np.cumsum(w)[:-1], _hashed(pdf["group_pos"].to_numpy(np.int64), seed), side="right")
        _, got = _anneal(c, goal, start, rng, steps=6 * len(c) + 2000)
        return pd.DataFrame({"group_pos": pdf["group_pos"].to_numpy(), "at": got.astype("int32")})

    tail = (
        sized.where(F.col("n") < bar)
        .withColumn("shard", F.pmod(F.xxhash64("group_pos", F.lit(seed)), F.lit(shards)).cast("int"))
        .groupBy("shard")
        .applyInPandas(shard, "group_pos long, at int")
    )
    if len(big):
        tail = tail.unionByName(scores.sparkSession.createDataFrame(pd.DataFrame({"group_pos": head["group_pos"].astype("int64"), "at": at.astype("int32")}), "group_pos long, at int"))
    split = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("at") + 1)
    dealt = tail.select("group_pos", split.alias("split"))
    return groups.join(dealt, "group_pos").select("pos", "group_pos", "split")


def labels_of(scores: DataFrame) -> DataFrame:
    """``(pos, label)``: the emotion quadrant of every score, ``(none)`` without one."""
    label = quadrant(F.try_element_at("extras", F.lit("label")))
    return scores.where("pos is not null").groupBy("pos").agg(F.min(F.coalesce(label, F.lit("(none)"))).alias("label"))


def split_report(assigned: DataFrame, plan: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Per split: rows, components, share got and share asked for, and by how much the share of any label differs at most from its share of all rows (``labels(pos, label)``; null without)."""
    got = assigned.groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("group_pos").alias("n_groups"))
    rows = F.coalesce("n_rows", F.lit(0))
    if labels is None:
        off = plan.select("split", F.lit(None).cast("double").alias("label_deviation"))
    else:
        each = assigned.join(labels, "pos").groupBy("split", "label").agg(F.count("*").alias("k"))  # a row a split and label
        of_split, of_label = each.groupBy("split").agg(F.sum("k").alias("n")), each.groupBy("label").agg((F.sum("k") / F.sum(F.sum("k")).over(Window.partitionBy())).alias("share"))
        grid = of_split.crossJoin(F.broadcast(of_label)).join(each, ["split", "label"], "left")
        off = grid.groupBy("split").agg(F.max(F.abs(F.coalesce("k", F.lit(0)) / F.col("n") - F.col("share"))).alias("label_deviation"))
    return plan.select("split", F.col("share").alias("target_share")).join(got, "split", "left").join(off, "split", "left").select(
        "split", "target_share", rows.alias("n_rows"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"),
        F.coalesce(F.try_divide(rows, F.sum(rows).over(Window.partitionBy())), F.lit(0.0)).alias("got_share"), "label_deviation",
    )
