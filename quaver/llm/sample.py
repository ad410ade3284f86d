"""Samples whose categories have given proportions, by swap repair.

Records are grouped by category signature, that is by their categories in the dimensions a sample
serves, and only the *counts* of the signatures are worked on: a random sample that satisfies every
category's floor is the start; then counts are exchanged between signatures, each exchange lowering
the deviation from the targets, until none improves.  The counts are then materialised as a random
choice of records.  The deviation is the squared gap over the goal, so that where floors or supply
leave too little room all other categories keep their proportions.

By default each dimension has a sample of its own; dimensions drawn ``together`` get one sample that
serves them all, as far as it can.

The number of signatures is bounded by the rows of the target table (by their product over the
dimensions, if together), so the search runs on the driver over a table of that size.  Records are
chosen by a hash: whole hash buckets are taken up to the one in which the count is reached, and only
that bucket is ranked, so no category, however large, is gathered into one task.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.canon import canonical, is_blank
from quaver.llm.people import persons, with_person
from quaver.llm.scratch import cut
from quaver.llm.splits import quadrant

BUCKET_ROWS = 20_000
#: A draw meets a target that it misses by no more than this part of it, or by one record.
TOLERANCE = 0.02
#: The dimensions a score has a category in.
DIMENSIONS = ("style", "composer", "extras.label")

#: The categories of the target table that mean a remainder.
OTHER, NONE = "(any other)", "(none)"


def signatures(scores: DataFrame, targets: DataFrame, terms: DataFrame) -> DataFrame:
    """``(pos, c0, c1, c2)``: the category each score has in each of ``DIMENSIONS``, by the value meant.

    ``style``: the entry of the term list, null without one.  ``composer``: the named composer, else
    ``(any other)``.  ``extras.label``: Q1 to Q4, else ``(none)``.  Repeated ``pos`` count once, with
    the least of their values.
    """
    base = cut(
        with_person(
            scores.where("pos is not null")
            .groupBy("pos")
            .agg(F.min(F.struct("style", "composer", F.try_element_at("extras", F.lit("label")).alias("label"))).alias("v"))
            .select("pos", "v.*"),
            "composer",
        ).select("pos", "style", "label", "sur", "ini", "full", "as_written"),
        "categories",
    )
    styles = terms.where("field_name = 'style'")
    typed = base.where(F.col("style").isNotNull() & ~is_blank(F.col("style"))).select(F.lit("style").alias("field_name"), F.col("style").alias("value"))
    named = cut(
        canonical(typed, styles).where("term_id <> 0").join(styles.select("term_id", "term"), "term_id").select(F.col("value").alias("style"), "term"), "styles"
    )
    # all forms of the wanted surnames decide which composer a shortened name means
    wanted = with_person(targets.where((F.col("dimension") == "composer") & (F.col("category") != OTHER)), "category").select("category", "sur", "ini", "full", "as_written")
    forms = base.select("sur", "ini", "full", "as_written").distinct().join(wanted.select("sur").distinct(), "sur", "left_semi")
    some = cut(forms.unionByName(wanted.drop("category")).where("as_written is not null").distinct(), "forms")
    who = cut(persons(some).join(wanted.select("category", F.col("as_written").alias("person")), "person").select("as_written", F.col("category").alias("named")), "composers")
    # unknown values get keys of their own, so that they don't meet in one task
    own = F.concat(F.lit("\x00"), F.col("pos").cast("string"))
    keyed = base.select("pos", "label", F.coalesce("style", own).alias("style"), F.coalesce("as_written", own).alias("as_written"))
    return keyed.join(named, "style", "left").join(who, "as_written", "left").select(
        "pos", F.col("term").alias("c0"), F.coalesce("named", F.lit(OTHER)).alias("c1"), F.coalesce(quadrant(F.col("label")), F.lit(NONE)).alias("c2")
    )


def _some(room: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """``n`` records at random, as counts, where there is ``room``; all there is if that is less."""
    out = np.zeros_like(room)
    left, total = n, int(room.sum())
    for i, r in enumerate(room.tolist()):
        if left <= 0 or total <= 0:
            break
        k = max(min(int(rng.binomial(left, min(r / total, 1.0))), r), left - (total - r))
        out[i] = min(k, r)
        left, total = left - int(out[i]), total - r
    return out


def exchange(have: np.ndarray, member: np.ndarray, goal: np.ndarray, floor: np.ndarray, rows: int, seed: int, start: np.ndarray | None = None) -> np.ndarray:
    """How many records of each signature to draw.

    ``have`` counts the records of each signature, ``member`` (a row a signature, a column a
    dimension) names its categories, -1 for none; ``goal`` and ``floor`` are those of the categories.
    Starts from a random sample that holds ``min(floor, supply)`` of each category; then exchanges
    counts between two signatures, as many records at once as lower the sum of squared gaps over
    goals most, until no exchange does.  Floors and what there is are never passed; fewer than
    ``rows`` are drawn only if there are no more, more only if the floors need more.  Given a ``start``,
    the exchanges go on from that draw.
    """
    rng = np.random.default_rng(seed)
    k, dims = member.shape
    n = len(goal)
    ids = np.where(member < 0, n, member)  # a last category for none

    def sums(counts: np.ndarray) -> np.ndarray:
        return sum((np.bincount(ids[:, d], counts, n + 1) for d in range(dims)), np.zeros(n + 1))[:n].astype(np.int64)

    floor = np.minimum(floor, sums(have))
    take = np.zeros(k, np.int64) if start is None else start.copy()
    for c in rng.permutation(n):
        lack = int(floor[c] - sums(take)[c])
        if lack > 0:
            take += _some(np.where((ids == c).any(axis=1), have - take, 0), lack, rng)
    take += _some(have - take, rows - int(take.sum()), rng)
    weight = np.append(1.0 / np.maximum(goal, 0.5), 0.0)
    aim = np.append(goal, 0.0)
    spare = np.append(floor, 0)

    def room(x: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Records each of the signatures ``a`` can lose, by its categories' floors, if none of them is won back; a row a dimension."""
        free = np.append(x, 1 << 60) - spare
        return free[ids[a]]

    while True:
        x = sums(take)
        gap = np.append(x, 0) - aim
        slope = 2 * (gap * weight)[ids].sum(axis=1)
        down, up = np.flatnonzero(take > 0), np.flatnonzero(take < have)
        best = (0.0, 0, 0, 0)
        if len(down) and len(up):
            loss = room(x, down)
            for a in range(0, len(up), 1024):
                to = up[a : a + 1024]
                differ = ids[down][:, None, :] != ids[to][None, :, :]
                bend = np.where(differ, weight[ids[down]][:, None, :] + weight[ids[to]][None, :, :], 0).sum(axis=2)
                steep = slope[down][:, None] - slope[to][None, :]
                most = np.minimum(np.where(differ, loss[:, None, :], 1 << 60).min(axis=2), np.minimum(take[down][:, None], (have - take)[to][None, :]))
                # k records change the deviation by bend k^2 - steep k
                step = np.minimum(np.maximum(np.rint(steep / np.maximum(2 * bend, 1e-300)), 1), most)
                gain = np.where((bend > 0) & (step >= 1), (steep - bend * step) * step, 0)
                i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if gain[i, j] > best[0] + 1e-9:
                    best = (float(gain[i, j]), int(down[i]), int(to[j]), int(step[i, j]))
        if not best[3]:
            return take
        take[best[1]] -= best[3]
        take[best[2]] += best[3]


def reached(have: np.ndarray, held: np.ndarray, take: np.ndarray, want: float, rows: int, seed: int) -> bool:
    """Whether the draw ``take`` holds ``want`` records of the signatures ``held``, or does so once exchanges go on for these alone."""
    if take[held].sum() < want:
        goal = math.ceil(want)
        take = exchange(have, np.where(held, 0, -1)[:, None], np.array([goal]), np.zeros(1, np.int64), max(rows, goal), seed, take)
    return bool(take[held].sum() >= want)


def repair(have: np.ndarray, share: np.ndarray, floor: np.ndarray, rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``(take, short)`` for one dimension, whose signatures are its categories: how many records of each to draw, and which no exchange brings to what share and floor ask for."""
    each = np.arange(len(have))
    take = exchange(have, each[:, None], share * rows, floor, rows, seed)
    want = np.maximum(share * rows, floor)
    return take, np.array([not reached(have, each == c, take, want[c], rows, seed) for c in each], bool)


class Drawn:
    """Plan of a draw: the targets with what there is and what is drawn of each, and the counts of the signatures."""

    def __init__(self, signed: DataFrame, targets: DataFrame, seed: int, together: bool):
        spark = signed.sparkSession
        pdf = targets.where("dimension is not null and category is not null").select("target_id", "dimension", "category", "target_share", "min_rows", "sample_rows").toPandas()  # a small table
        pdf = pdf.sort_values("target_id", ignore_index=True)
        for c in ("target_share", "min_rows", "sample_rows"):
            pdf[c] = pdf[c].fillna(0).astype(float)
        pdf["wanted"] = np.maximum(pdf["target_share"] * pdf["sample_rows"], pdf["min_rows"])
        pdf["have"], pdf["drawn"], pdf["met"] = 0, 0, pdf["wanted"] <= 0
        cols = [f"c{i}" for i in range(len(DIMENSIONS))]
        groups = [list(range(len(DIMENSIONS)))] if together else [[i] for i in range(len(DIMENSIONS))]
        self.counts: list[tuple[list[int], pd.DataFrame, DataFrame]] = []
        for g, dims in enumerate(groups):
            parts = {d: pdf[pdf["dimension"] == DIMENSIONS[d]] for d in dims}
            # categories without a target are no part of a signature
            named = signed
            for d in dims:
                known = parts[d]["category"].drop_duplicates().tolist()
                named = named.withColumn(cols[d], F.when(F.col(cols[d]).isin(known), F.col(cols[d])) if known else F.lit(None).cast("string"))
            wanted = [cols[d] for d in dims]
            have = named.groupBy(*wanted).agg(F.count("*").alias("have")).toPandas()
            have = have[have[wanted].notna().any(axis=1)].sort_values(wanted, ignore_index=True)
            number, goal, floor, rows = {}, [], [], 0
            for d in dims:
                part = parts[d].drop_duplicates("category")
                total = max(part["target_share"].sum(), 1e-12)
                size = int(part["sample_rows"].max()) if len(part) else 0
                rows = max(rows, size)
                for r in part.itertuples():
                    number[d, r.category] = len(goal)
                    goal.append(r.target_share / total * size)
                    floor.append(int(r.min_rows))
            member = np.array([[number.get((d, c), -1) for d, c in zip(dims, r, strict=True)] for r in have[wanted].to_numpy().tolist()], np.int64).reshape(len(have), len(dims))
            got = have["have"].to_numpy(np.int64)
            if len(dims) == 1:
                # one signature a category, also where there is no record of it
                all_have = np.zeros(len(goal), np.int64)
                all_have[member[:, 0]] = got
                take_all = repair(all_have, np.array(goal) / max(rows, 1), np.array(floor, np.int64), rows, seed + g)[0] if goal else all_have
                take = take_all[member[:, 0]]
            else:
                take = exchange(got, member, np.array(goal), np.array(floor, np.int64), rows, seed + g) if goal else np.zeros(len(got), np.int64)
            for (d, c), k in number.items():
                at = pdf.index[(pdf["dimension"] == DIMENSIONS[d]) & (pdf["category"] == c)]
                held = member[:, dims.index(d)] == k
                pdf.loc[at, "have"] = int(got[held].sum())
                pdf.loc[at, "drawn"] = int(take[held].sum())
                for i in at:
                    pdf.loc[i, "met"] = reached(got, held, take, pdf.loc[i, "wanted"], rows, seed + g)
            self.counts.append((dims, have.assign(take=take), named))
        pdf["deviation"] = np.where(pdf["wanted"] > 0, (pdf["drawn"] - pdf["wanted"]) / pdf["wanted"].where(pdf["wanted"] > 0, 1.0), 0.0)
        pdf["drawn_met"] = (pdf["drawn"] >= pdf["min_rows"]) & ((pdf["drawn"] - pdf["wanted"]).abs() <= np.maximum(1.0, TOLERANCE * pdf["wanted"]))
        self.df = spark.createDataFrame(
            pdf[["target_id", "dimension", "category", "target_share", "min_rows", "sample_rows", "have", "wanted", "drawn", "deviation", "met", "drawn_met"]].astype({"target_id": "int64", "have": "int64", "drawn": "int64", "deviation": "float64", "wanted": "float64", "met": "bool", "drawn_met": "bool"}),
            "target_id long, dimension string, category string, target_share double, min_rows double, sample_rows double, have long, wanted double, drawn long, deviation double, met boolean, drawn_met boolean",
        )


def report(scores: DataFrame, targets: DataFrame, terms: DataFrame, seed: int = 0, together: bool = False) -> DataFrame:
    """Every target with what there is (``have``), what it asks for (``wanted``: the larger of share and floor) and what is ``drawn``.

    ``met`` says whether the draw holds what is wanted or comes to hold it by exchanges for this target
    alone, which it does if there are enough records; ``drawn_met`` whether the draw holds the floor and
    comes within ``TOLERANCE`` of ``wanted``, which floors of other categories may leave no room for;
    ``deviation`` is relative to ``wanted``.  Targets of other dimensions than ``DIMENSIONS`` have none.
    """
    return Drawn(cut(signatures(scores, targets, terms), "signatures"), targets, seed, together).df


def draw(scores: DataFrame, targets: DataFrame, terms: DataFrame, seed: int = 0, together: bool = False) -> DataFrame:
    """``(dimension, category, pos)``: the sample of each dimension, as many rows of each category as planned.  Drawn ``together``, the dimensions share their records."""
    signed = cut(signatures(scores, targets, terms), "signatures")
    plan = Drawn(signed, targets, seed, together)
    out = None
    for dims, counts, named in plan.counts:
        cols = [f"c{i}" for i in dims]
        counts = counts[counts["take"] > 0]
        most = int(counts["have"].max()) if len(counts) else 0
        buckets = max(1, math.ceil(most / BUCKET_ROWS) * 8)
        small = scores.sparkSession.createDataFrame(
            [(i, int(r[-1]), *(None if pd.isna(c) else c for c in r[:-1])) for i, r in enumerate(counts[[*cols, "take"]].itertuples(index=False, name=None))],
            ", ".join(["s int", "take long", *(f"{c} string" for c in cols)]),
        )
        same = reduce(and_, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in cols])
        luck = F.xxhash64("pos", F.lit(dims[0]), F.lit(seed))
        some = (
            named.alias("a").join(F.broadcast(small).alias("b"), same)  # at most a row a signature
            .select("a.pos", *[f"a.{c}" for c in cols], "s", "take", luck.alias("luck"))
            .withColumn("bucket", F.pmod("luck", F.lit(buckets)).cast("int"))
        )
        sizes = some.groupBy("s", "bucket").agg(F.count("*").alias("n"), F.max("take").alias("take"))
        sums = sizes.selectExpr("s", "bucket", "n", "take", "sum(n) over (partition by s order by bucket) - n as before").where("before < take")
        chosen = some.drop("take").join(sums, ["s", "bucket"])
        whole = chosen.where("before + n <= take").select("pos", *cols)
        last = (
            chosen.where("before + n > take")
            .selectExpr("pos", *cols, "take - before as k", "row_number() over (partition by s, bucket order by luck, pos) as r")
            .where("r <= k")
            .select("pos", *cols)
        )
        each = F.array(*[F.struct(F.lit(DIMENSIONS[d]).alias("dimension"), F.col(f"c{d}").alias("category")) for d in dims])
        part = whole.unionByName(last).select(F.explode(each).alias("c"), "pos").select("c.*", "pos").where("category is not null")
        out = part if out is None else out.unionByName(part)
    return out
