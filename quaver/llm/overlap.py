"""Records of evaluation splits that also stand, wholly or nearly, in the training split.

The evaluation records are held in shards of compressed full-text indexes
(:mod:`quaver.llm.fmindex`).  Training records are streamed through backward search, which gives the
maximal matches with each evaluation record of the shard they are sent to, over bar lines too, with
place and length.  Matches are merged per pair of records, and the notes they cover decide: a pair
is an overlap if they are nearly all notes of the shorter record, none if they are less than half;
between, the records are compared note by note.

Which shards a training record is sent to follows from the rarest bars of the evaluation records,
so many that no overlap is parted (:func:`quaver.llm.music.with_keys`).  Only keys are shuffled for
that; the music of records with a possible partner follows them.  Records whose every bar may be
changed are led by their runs of notes too.

Records with the same bag of bars are one class up to the last step, so copies are not compared
again.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.fmindex import BAR, END, FMIndex, Symbols, encode
from quaver.llm.music import CHANGED, changed_notes, dense_keys, packed, prefix, with_bars, with_keys
from quaver.llm.scratch import Cut, cut, swept

#: Pairs of a shard, about, each of which brings at most two records; and notes of their records.
SHARD_PAIRS, SHARD_NOTES = 2000, 1_000_000
#: Runs of notes that must meet before a dense pair's music is sent, where that many are sure to.
LEAD = 3
#: A pair whose merged matches cover less than NONE of the notes of the shorter record is no overlap.
NONE = 0.5


def _covered(n: int, start: np.ndarray, length: np.ndarray, counts: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of ``counts`` between ``cuts`` over the places that some of the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    there = np.where(np.cumsum(edge[:-1]) > 0, counts, 0)
    total = np.concatenate(([0], np.cumsum(there)))
    return total[cuts[1:]] - total[cuts[:-1]]


def _bar_numbers(text: np.ndarray) -> np.ndarray:
    """For each symbol the number of its bar; a bar line opens the bar after it."""
    return np.cumsum(text == BAR) - 1


def shares(held: list[str], asked: list[str], query: np.ndarray, record: np.ndarray) -> np.ndarray:
    """For pairs of a text of ``asked`` and one of ``held``: the share of the notes of the shorter that merged maximal matches cover.  A bar that stands several times in a held text is covered where one of them is."""
    symbols = Symbols()
    index = FMIndex(held, symbols)
    text, starts = encode(asked, symbols)
    begin, end = starts[query], starts[query + 1] - 1  # without the end
    pair, at, place, length = index.matches(text, begin, end, record)
    # every pair gets its own stretch of both texts
    def stretch(source, bounds, which):
        n = bounds[which + 1] - bounds[which]
        cuts = np.concatenate(([0], np.cumsum(n)))
        flat = np.arange(int(cuts[-1])) + np.repeat(bounds[which] - cuts[:-1], n)
        return source[flat], cuts

    asked_text, asked_cuts = stretch(text, starts, query)
    held_text, held_cuts = stretch(index.text, index.starts, record)
    is_note = lambda t: ((t != BAR) & (t != END)).astype(np.int64)
    got_asked = _covered(len(asked_text), at - begin[pair] + asked_cuts[pair], length, is_note(asked_text), asked_cuts)
    # the held side bar by bar
    bar = _bar_numbers(held_text)
    n_bars = int(bar[-1]) + 1 if len(bar) else 0
    first = np.searchsorted(bar, np.arange(n_bars + 1))
    per_bar = _covered(len(held_text), place - index.starts[record[pair]] + held_cuts[pair], length, is_note(held_text), first)
    owner = np.searchsorted(held_cuts, first[:-1], side="right") - 1
    names: dict[str, int] = {}
    own = [[names.setdefault(b, len(names)) for b in h.split("|")] + [-1] for h in held]  # after the last bar line nothing follows
    name = np.array([b for r in record.tolist() for b in own[r]], np.int64)
    _, same = np.unique(owner * (len(names) + 1) + name, return_inverse=True)
    best = np.zeros(int(same.max()) + 1 if len(same) else 0, np.int64)
    np.maximum.at(best, same, per_bar)
    got_held = np.bincount(owner, best[same], minlength=len(record)) if len(owner) else np.zeros(len(record))
    total = lambda t, cuts: np.diff(np.concatenate(([0], np.cumsum(is_note(t))))[cuts])
    na, nh = total(asked_text, asked_cuts), total(held_text, held_cuts)
    return np.where(nh <= na, got_held, got_asked) / np.maximum(np.minimum(na, nh), 1)


def _decide(pdf: pd.DataFrame) -> pd.DataFrame:
    """The overlaps of one shard."""
    asks = pdf["asks"].to_numpy(bool)
    held, asked = pdf[~asks].reset_index(drop=True), pdf[asks].reset_index(drop=True)
    number = {e: k for k, e in enumerate(held["class"].tolist())}
    pairs = [(k, number[e]) for k, partners in enumerate(asked["partners"].tolist()) for e in partners]
    query, record = (np.array(c, np.int64) for c in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
    texts, others = asked["bars"].tolist(), held["bars"].tolist()
    share = shares(others, texts, query, record)
    keep = share >= 1 - CHANGED
    for k in np.flatnonzero(~keep & (share >= NONE)).tolist():
        keep[k] = changed_notes(texts[query[k]].split("|"), others[record[k]].split("|")) <= CHANGED
    t, e = asked["class"].to_numpy(np.int64)[query[keep]], held["class"].to_numpy(np.int64)[record[keep]]
    return pd.DataFrame({"t": t, "e": e})


def candidates(classes: DataFrame, both: bool) -> DataFrame:
    """``(t, e)``: classes of training and of evaluation records that may overlap, of ``classes(class, training, evaluation, need, tokens)``.

    An evaluation class is looked up by its rarest tokens that training classes hold, and a training
    class answers to all of its own.  ``both`` is for tokens so common that one alone is mostly
    chance: a class that needs ``LEAD`` of them or more is looked up by so many that ``LEAD`` must
    meet; one that needs fewer by those any of which may be the only one, and a training class
    answers to its own rarest then.
    """
    side = lambda flag, name: classes.where(flag).select(F.col("class").alias(name), "need", F.explode("tokens").alias("token"))
    wanted = side("evaluation", "e")
    there = cut(side("training", "t").join(wanted.select("token").distinct(), "token", "left_semi"), "held")
    df = there.groupBy("token").agg(F.count("*").alias("df"))
    answers = there.select("t", "token")
    if not both:
        return prefix(wanted.join(df, "token"), "e").join(answers, "token").select("t", "e").distinct()
    many = F.col("need") >= LEAD
    led = prefix(wanted.where(many).join(df, "token"), "e", LEAD).join(answers, "token").groupBy("t", "e").agg(F.count("*").alias("n")).where(F.col("n") >= LEAD)
    few = prefix(wanted.where(~many).join(df, "token"), "e").join(prefix(there.join(df, "token"), "t"), "token")
    return led.select("t", "e").unionByName(few.select("t", "e").distinct())


def overlaps(records: DataFrame, sides: DataFrame | None = None) -> DataFrame:
    """``(training_key, key)``: pairs of a training record and an evaluation record that overlap.

    ``records(key bigint, bars array<string>, class bigint)`` as of :func:`quaver.llm.music.with_bars`;
    ``sides(key, training boolean)`` puts a key on one side, by default it is a column of ``records``;
    keys without a side overlap with nothing.  A pair overlaps if at most ``CHANGED`` of
    the notes of the record with fewer notes have no partner in the other, bars in any order; every
    pair with at most one note in ``EDIT`` changed, added or missing is found, and every evaluation
    record of which that many whole bars stand in a longer training record.  Records without text or
    music overlap with nothing; an empty side gives an empty result; repeated rows count once.
    """
    music = Cut(packed(records.where("key is not null").select("key", "bars", "class", *([] if sides else ["training"]))), "music")
    parsed, spark = music.df, music.spark
    # sides are joined to keys and classes only, so the music is shuffled once
    named = parsed.select("key", "class").join(sides.where("training is not null").select("key", "training"), "key") if sides else parsed.where("training is not null")
    named = cut(named.select("key", "class", "training").distinct(), "named")
    of_class = named.groupBy("class").agg(F.max("training").alias("training"), F.max(~F.col("training")).alias("evaluation"))
    classes = cut(with_keys(parsed.groupBy("class").agg(F.min("bars").alias("bars")).join(of_class, "class")), "classes")
    music.drop()
    swept(spark)
    dense = cut(dense_keys(classes).select("class", "training", "evaluation", "need", "tokens"), "dense")
    pairs = cut(candidates(classes, both=False).unionByName(candidates(dense, both=True)).distinct(), "pairs")
    swept(spark)
    usual = classes.agg(F.avg("notes")).first()[0] or 1
    most = max(1, min(SHARD_PAIRS, int(SHARD_NOTES / (2 * usual))))  # fewer where records are long
    shards = max(1, math.ceil(pairs.count() / most))
    # an evaluation class with very many partners is held in several shards
    parts = pairs.groupBy("e").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("t"), F.col("parts")).cast("int")).otherwise(0)
    sent = pairs.join(parts, "e").select("t", "e", F.pmod(F.xxhash64("e", part), F.lit(shards)).alias("shard"))
    asked = sent.groupBy("t", "shard").agg(F.collect_list("e").alias("partners")).select(F.col("t").alias("class"), F.lit(True).alias("asks"), "shard", "partners")
    held = sent.select(F.col("e").alias("class"), F.lit(False).alias("asks"), "shard", F.array().cast("array<bigint>").alias("partners")).distinct()
    found = cut(
        asked.unionByName(held)
        .join(classes.select("class", "bars"), "class")
        .groupBy("shard")
        .applyInPandas(_decide, "t long, e long"),
        "overlaps",
    )
    return (
        found.join(named.where("training").select(F.col("class").alias("t"), F.col("key").alias("training_key")), "t")
        .join(named.where("not training").select(F.col("class").alias("e"), "key"), "e")
        .select("training_key", "key")
    )


def split_of(split_files: DataFrame) -> DataFrame:
    """``(pos, split, corpus)``: one row a score; of repeated rows the one loaded last counts."""
    return (
        split_files.where("pos is not null and split is not null")
        .groupBy("pos")
        .agg(F.max_by(F.struct("split", "corpus"), F.coalesce("loaded_at", "scanned_at")).alias("s"), F.max("split").alias("_any"), F.max("corpus").alias("_corpus"))
        .select("pos", F.coalesce("s.split", "_any").alias("split"), F.coalesce("s.corpus", "_corpus").alias("corpus"))
    )


def evaluation_records(scores: DataFrame, bench: DataFrame) -> DataFrame:
    """``(key, bars, class)`` of all scores and benchmark records."""
    every = scores.select(F.col("pos").alias("key"), "text").unionByName(bench.select(F.col("rec_no").alias("key"), F.col("input_content").alias("text")))
    return with_bars(every.where("key is not null"), "text")


def evaluation_sides(split_files: DataFrame, bench: DataFrame) -> DataFrame:
    """``(key, training)`` of the scores with a split and of all benchmark records, which are evaluation material."""
    return split_of(split_files).select(F.col("pos").alias("key"), (F.col("split") == "train").alias("training")).unionByName(bench.select(F.col("rec_no").alias("key"), F.lit(False).alias("training")))


def overlap_report(pairs: DataFrame, split_files: DataFrame) -> DataFrame:
    """Overlapping evaluation records, their training partners and pairs, per split and corpus (``bench`` for benchmark records)."""
    side = split_of(split_files)
    return (
        pairs.join(side.withColumnRenamed("pos", "key"), "key", "left")
        .groupBy(F.coalesce("split", F.lit("bench")).alias("split"), F.coalesce("corpus", F.lit("bench")).alias("corpus"))
        .agg(F.countDistinct("key").alias("n_records"), F.countDistinct("training_key").alias("n_training"), F.count("*").alias("n_pairs"))
    )
