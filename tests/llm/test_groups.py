"""Splits, overlaps and near-duplicates against plain Python on whole small tables, and their edge cases."""

from __future__ import annotations

import itertools
import random
import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaver.llm import components, fmindex, music, neardup, overlap, people, splits

MARK = re.compile(r"\\[A-Za-z]+|\\[<>!]|[-_^][.^>!_+-]|[~()\[\]]")
STATEMENT = re.compile(r"\\key\s+\S+\s*\\\w+|\\time\s+\d+\s*/\s*\d+|\\tempo\s+[^|\n={}]*=\s*\d+")
SCORES = "pos long, source_id string, text string, composer string, style string, extras map<string,string>, key string, class string, bars string, rep string"


def bars(text):
    if text is None:
        return []
    text = re.sub(r"%[^\n]*", "", text)
    block = re.search(r"=\s*\{(.*)\}", text, re.S)
    body = block[1] if block else re.sub(r"(?m)^\s*\d+\.\s+", "|", text)
    return [" ".join(b.split()) for b in MARK.sub("", STATEMENT.sub("", body)).split("|") if b.split()]


def common_run(x, y):
    row = [0] * (len(y) + 1)
    for v in x:
        old = row[:]
        for j, w in enumerate(y, 1):
            row[j] = old[j - 1] + 1 if v == w else max(old[j], row[j - 1])
    return row[-1]


def same(a, b, excerpts):
    """At most a fifth of the notes of the shorter music has no partner in the other, by its notes alone; unless ``excerpts``, the other may not be much longer either."""
    if not a or not b:
        return False
    a, b = sorted(([bar.split() for bar in r] for r in (a, b)), key=lambda r: sum(map(len, r)))
    n, m = sum(map(len, a)), sum(map(len, b))
    if not excerpts and m > 1.2 * n:
        return False
    there = {tuple(o) for o in b}
    return sum(len(bar) - (len(bar) if tuple(bar) in there else max(common_run(bar, o) for o in b)) for bar in a) * 5 <= n


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def scores_of(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (10 - len(r))) for r in rows], SCORES)


# --- components ---------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(5, 5), (1, None), (7, 900), (7, 900)] + [(1000, 1000 + i) for i in range(1, 400)] + [(2000 + i, 2001 + i) for i in range(60)]
    sets = Sets()
    for a, b in edges:
        if b is not None:
            sets.join(a, b)
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: sets.find(x) for x in list(sets.up) if sets.find(x) != x}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- splits -------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("name", "parts"),
    [
        ("Ada Bo Cole", ("cole", "ada bo", "ab")), ("Cole, Ada Bo", ("cole", "ada bo", "ab")), ("ADA BO\u00a0 COLE ", ("cole", "ada bo", "ab")), ("Ada Bo Cole (1700-1755)", ("cole", "ada bo", "ab")),
        ("A. B. Cole", ("cole", None, "ab")), ("A.B. Cole", ("cole", None, "ab")), ("Cole A.B.", ("cole", None, "ab")), ("Cole, A. B.", ("cole", None, "ab")), ("Cole", ("cole", None, "")),
        ("Côlé", ("cole", None, "")), ("N.N.", (None, None, None)), ("[anonymous]", (None, None, None)), ("  ", (None, None, None)), (None, (None, None, None)), ("?", (None, None, None)), (",", (None, None, None)), ("()", (None, None, None)),
    ],
)
def test_names(spark, name, parts):
    r = people.with_person(spark.createDataFrame([(name,)], "c string"), "c").first()
    assert (r["sur"], r["full"], r["ini"] if r["sur"] else None) == parts


def test_shortened_names(spark):
    names = ["Ada Cole", "A. Cole", "Cole", "Ada Roe", "Ben Roe", "Roe", "B. Roe", "X. Lee", "Lee", "Y. Moe", "Z. Moe", "Moe"]
    forms = people.with_person(spark.createDataFrame([(n,) for n in names], "c string"), "c")
    who = {r["as_written"]: r["person"] for r in people.persons(forms.select("sur", "ini", "full", "as_written").distinct()).collect()}
    got = {r["c"]: who[r["as_written"]] for r in forms.collect()}
    assert got["Ada Cole"] == got["A. Cole"] == got["Cole"] and got["Roe"] is None and got["B. Roe"] == got["Ben Roe"] != got["Ada Roe"]
    assert got["Lee"] == got["X. Lee"] and got["Moe"] is None and got["Y. Moe"] != got["Z. Moe"]


def test_related(spark):
    x = lambda **k: k
    rows = [
        (1, "ab_1_aria_viola", "t", "Ada Cole", None, None), (2, "AB_1_ARIA_part2.ly", "t", None, None, x()), (3, "cd_2_duo", "t", "Cole, A.", None, x(siglum="X-Tor Ms. 12")),
        (4, "ef_3_trio", "t", "Anonymous", None, x(siglum="x-tor, ms 12")), (5, "gh_4_trio", "t", "anonym", None, x(siglum="s.s.")), (6, "Q1_abc_0", "t", None, None, x(song_id="abc")),
        (7, "zz", "t", "", None, x(song_id="ABC ")), (8, None, None, None, None, None), (9, "", "t", None, None, x(siglum="X-Tor Ms. 1 2")), (10, "Q1_xyz_0", "t", "-", None, x(song_id=None, siglum="")), (4, "ef_3_trio", "t", "Anonymous", None, x(siglum="x-tor, ms 12")), (None, "ab_1_aria", "t", None, None, None),
    ]
    got = {r["pos"]: r["group_pos"] for r in splits.related(scores_of(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9, 10: 10}


def test_splits_keep_groups_and_meet_shares(spark, sf):
    scores, plan = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("scores", "split_plan"))
    got = splits.assign_splits(scores, plan).toPandas()
    again = splits.assign_splits(scores, plan).toPandas()
    assert len(got) == scores.count() and got.groupby("group_pos")["split"].nunique().max() == 1
    assert got.sort_values("pos").reset_index(drop=True).equals(again.sort_values("pos").reset_index(drop=True))
    share = got["split"].value_counts(normalize=True)
    largest = got["group_pos"].value_counts(normalize=True).iloc[0]
    assert abs(share["train"] - 0.8) < max(0.02, largest - 0.8) and abs(share["test"] - 0.1) < 0.05
    labels = splits.labels_of(scores)
    report = splits.split_report(spark.createDataFrame(got), plan, labels).collect()
    assert sum(r["n_rows"] for r in report) == len(got)
    both = got.merge(labels.toPandas(), on="pos")
    of_all = both["label"].value_counts(normalize=True)
    for r in report:
        own = both[both["split"] == r["split"]]["label"].value_counts(normalize=True)
        assert r["label_deviation"] == pytest.approx(own.reindex(of_all.index, fill_value=0).sub(of_all).abs().max())
    assert splits.split_report(spark.createDataFrame(got), plan).where("label_deviation is not null").count() == 0


def test_splits_of_a_long_plan(spark):
    plan = spark.createDataFrame([(f"part{k:03d}", 1.0) for k in range(80)], "split string, share double")
    got = splits.assign_splits(scores_of(spark, [(i, f"s{i}", "t", None, None, None) for i in range(800)]), plan).toPandas()
    assert got["split"].nunique() == 80 and got["split"].value_counts().max() <= 12


def test_splits_edges(spark):
    plan = spark.createDataFrame([("train", 0.5), ("test", 0.5), (None, 1.0)], "split string, share double")
    assert splits.assign_splits(scores_of(spark, []), plan).count() == 0
    with pytest.raises(ValueError):
        splits.assign_splits(scores_of(spark, []), plan.limit(0))
    # one composer holds a third of the rows: its component stays whole
    rows = [(i, f"s{i}", "t", "Ada Cole" if i % 3 == 0 else None, None, None) for i in range(90)]
    got = splits.assign_splits(scores_of(spark, rows), plan).toPandas()
    assert got[got["pos"] % 3 == 0]["split"].nunique() == 1 and abs((got["split"] == "train").mean() - 0.5) < 0.03


def test_annealing_beats_its_start():
    rng = np.random.default_rng(0)
    counts = np.column_stack([n := rng.integers(1, 50, 300), rng.binomial(n, 0.3), n]).astype(float)
    target = np.outer([0.8, 0.1, 0.1], counts.sum(0))
    start = rng.integers(0, 3, 300)
    cost, at = splits._anneal(counts, target, start, rng, 20_000)
    assert cost < 1e-5 and sorted(set(at)) == [0, 1, 2]


# --- music --------------------------------------------------------------------------------------


def test_music(spark):
    texts = ['\\header { title = "a | b" }\nx = {\n \\time 3/4 \\key c \\minor \\tempo 4 = 90\n c4-> d8~ | % 1\n R1*2 | e4\\trill\tf4 |\n}', "0. c4 d4\n1. e4\n", "c4 | d4 |", "", None, "% only\n", "x = { }", "x = {\\tempo 4 = 90 c4 | %{ a | b %} d4 }"]
    got = [r["b"] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(music.bars(F.col("t")).alias("b")).collect()]
    assert got == [["c4 d8", "R1*2", "e4 f4"], ["c4 d4", "e4"], ["c4", "d4"], [], None, [], [], ["c4", "d4"]]
    assert music.changed_notes(["a b c d", "e f"], ["e f", "a x c d"]) == pytest.approx(1 / 6)


def test_near_duplicates_are_those_of_all_pairs(spark, sf):
    scores = spark.read.parquet(f"{sf}/scores.parquet").select("pos", "text")
    # the tables' own rows, and copies of them with bars changed, moved and left out
    rng = random.Random(4)
    rows = [tuple(r) for r in scores.collect()]
    for pos, text in rng.sample(rows, 60):
        b = bars(text)
        rng.shuffle(b)
        rows.append((pos + 10**6, "x = { " + " | ".join(b[: max(1, int(len(b) * rng.choice([1, 0.9, 0.4])))]) + " }"))
    parsed = {p: bars(t) for p, t in rows}
    sets = Sets()
    for a, b in itertools.combinations([p for p in parsed if parsed[p]], 2):
        if same(parsed[a], parsed[b], excerpts=False):
            sets.join(a, b)
    got = {r["pos"]: r["group_pos"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "pos long, text string")).collect()}
    assert got == {p: sets.find(p) for p in parsed if parsed[p]}


def test_near_duplicate_edges(spark, monkeypatch):
    assert neardup.near_duplicates(scores_of(spark, [])).count() == 0
    monkeypatch.setattr(neardup, "CELL", 7)  # subtrees of more classes run as pairs of cells
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefg") + rng.choice("48") for _ in range(5)) for _ in range(12)]
    rows = []
    for i in range(60):  # a third and more share most of their bars, no two are alike
        b = [x if rng.random() < 0.85 else f"c{i} d{i} {k}" for k, x in enumerate(base)]
        rows.append((i, "s", " | ".join(b)))
    rows += [(100 + i, "s", " | ".join(f"e{i} f{k}" for k in range(9))) for i in range(20)] + [(200, "s", None), (201, "s", ""), (202, "s", "r1 | R1 | r1"), (203, "s", "r1|R1|r1"), (204, "s", "c4 | r1"), (None, "s", "c4")]
    rows += [(300 + i, "s", rows[3][2]) for i in range(40)] + [rows[3]]
    rows.append((400, "s", " | ".join(f"e0 f{k % 9}" for k in range(200_000))))
    got = {r["pos"]: (r["class_id"], r["group_pos"]) for r in neardup.near_duplicates(scores_of(spark, rows)).collect()}
    parsed = {r[0]: bars(r[2]) for r in rows if r[0] is not None and bars(r[2])}
    sets = Sets()
    for a, b in itertools.combinations(parsed, 2):
        if same(parsed[a], parsed[b], excerpts=False):
            sets.join(a, b)
    assert {p: g for p, (_, g) in got.items()} == {p: sets.find(p) for p in parsed}
    assert got[303][0] == 3 and got[203] == (202, 202)


def test_count_tree_finds_all():
    rng = np.random.default_rng(3)
    points = [np.unique(rng.integers(0, 3000, rng.integers(1, 40))) * 21 % neardup.GROUPS for _ in range(700)]
    points += [np.append(p, [7, 7, 9]) for p in points[:50]]  # counts above one
    need, size = rng.integers(1, 9, 750), rng.integers(50, 120, 750)
    counts = [{g: int((p == g).sum()) for g in p.tolist()} for p in points]
    tree = neardup.CountTree(points, need, size)
    asked = rng.integers(0, 750, 60)
    got = {(int(i), int(j)) for q, at in tree.search([points[i] for i in asked], need[asked], size[asked]) for i, j in zip(q, at, strict=True)}
    least = lambda a, b: sum(min(n, b.get(g, 0)) for g, n in a.items())
    fits = lambda a, b: max(a, b) <= 1.2 * min(a, b)
    assert got == {(k, j) for k, i in enumerate(asked) for j in range(750) if fits(size[i], size[j]) and least(counts[i], counts[j]) >= max(need[i], need[j])}
    assert tree.seen[1] < tree.seen[0] / 4  # the boxes rule most out


def few_changed(a, b, excerpts):
    """At most one note in eight of the shorter music is changed, added or missing in the other (in an excerpt, changed or missing), by its notes alone."""
    a, b = sorted(([bar.split() for bar in r] for r in (a, b)), key=lambda r: sum(map(len, r)))
    n, m = sum(map(len, a)), sum(map(len, b))
    return sum(len(bar) - max(common_run(bar, o) for o in b) for bar in a) * 8 <= n and (excerpts or (m - n) * 8 <= n)


def changed_scores(rng):
    """Pairs of bar lists that differ in one note of eight at most, some of them in every bar, and the changed ones' bars moved."""
    note = lambda: rng.choice("abcdefg") + rng.choice(["", ",", "'"]) + rng.choice(["4", "8", "16"])
    made = []
    for length, n, edits, bars_hit in [(16, 16, 12, 12), (16, 16, 16, 16), (16, 12, 24, 12), (8, 14, 14, 14), (9, 16, 16, 16), (6, 16, 12, 12), (7, 15, 13, 13), (None, 20, None, 20), (None, 20, None, 20)] * 2:
        base = [[note() for _ in range(length or rng.randint(3, 16))] for _ in range(n)]
        other = [list(b) for b in base]
        for k in range(edits if edits is not None else sum(map(len, base)) // 8 - 2):
            b = other[k % bars_hit]
            at = rng.randrange(len(b))
            kind = rng.choice("cccid") if edits is None else "c"
            if kind == "d" and len(b) > 2:
                del b[at]
            elif kind == "i":
                b.insert(at, note() + ".")
            else:
                b[at] = note() + "."
        rng.shuffle(other)
        made.append(([" ".join(b) for b in base], [" ".join(b) for b in other]))
    own = [f"a{k} b{k} c{k} d{k}" for k in range(100)]
    return [*made, (own, own[40:50])]  # an excerpt whose other bars nothing else has


def test_few_changed_notes_are_found_in_whatever_bars(spark):
    pairs = changed_scores(random.Random(6))
    flat = [bars_ for pair in pairs for bars_ in pair]
    every = list(itertools.combinations(range(len(flat)), 2))
    want = {(i, j) for i, j in every if few_changed(flat[i], flat[j], False)}
    assert len(want) > len(pairs) * 0.8
    sets = Sets()
    for i, j in want:
        sets.join(i, j)
    rows = [(i, " | ".join(b)) for i, b in enumerate(flat)]
    got = {r["pos"]: r["group_pos"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "pos long, text string")).collect()}
    assert got == {i: sets.find(i) for i in range(len(flat))}
    records = music.with_bars(spark.createDataFrame([(i, i % 2 == 0, t) for i, t in rows], "key long, training boolean, text string"), "text")
    assert {tuple(sorted(r)) for r in overlap.overlaps(records).collect()} == {(i, j) for i, j in every if few_changed(flat[i], flat[j], True) and i % 2 != j % 2}


def test_excerpts_overlap_but_are_no_near_duplicates(spark):
    own = [f"a{k} b{k} c{k} d{k}" for k in range(100)]
    rows = [(1, own), (2, own[:10])] + [(10 + k, own[k : k + 2] + [f"e{k} f{k} g{j}" for j in range(10)]) for k in range(10)]
    made = spark.createDataFrame([(p, p != 2, " | ".join(b)) for p, b in rows], "pos long, training boolean, text string")
    got = {r["pos"]: r["group_pos"] for r in neardup.near_duplicates(made).collect()}
    assert got == {p: p for p, _ in rows}  # the other bars of the long one count as added
    assert list(map(tuple, overlap.overlaps(music.with_bars(made.withColumnRenamed("pos", "key"), "text")).collect())) == [(1, 2)]


# --- overlaps -----------------------------------------------------------------------------------


def test_backward_search():
    rng = random.Random(1)
    some = [" ".join(rng.choice("abcdefg") + rng.choice("48") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    record = lambda: "|".join(rng.choice(some) for _ in range(rng.randint(1, 9)))
    held, asked = [record() for _ in range(60)], [record() for _ in range(30)]
    symbols = fmindex.Symbols()
    index = fmindex.FMIndex(held, symbols)
    text, starts = fmindex.encode(asked, symbols)
    query, of = (np.array(c) for c in zip(*itertools.product(range(30), range(60)), strict=True))
    found = {}
    for k, at, place, n in zip(*(c.tolist() for c in index.matches(text, starts[query], starts[query + 1] - 1, of)), strict=True):
        found.setdefault(k, []).append((at, place, n))
        assert (text[at : at + n] == index.text[place : place + n]).all()
        assert index.starts[of[k]] <= place and place + n < index.starts[of[k] + 1]
    for k in range(len(query)):
        w, h = (s.tolist() for s in (text[starts[query[k]] : starts[query[k] + 1] - 1], index.text[index.starts[of[k]] : index.starts[of[k] + 1]]))
        parts = {tuple(h[i:j]) for i in range(len(h)) for j in range(i + 1, len(h) + 1)}
        want, end = [], len(w)
        while end > 0:
            start = end
            while start > 0 and tuple(w[start - 1 : end]) in parts:
                start -= 1
            if end - start >= fmindex.LEAST:
                want.append((starts[query[k]] + start, end - start))
            end = start if end - start >= fmindex.LEAST else end - 1
        assert [(at, n) for at, _, n in found.get(k, [])] == want
    assert len(fmindex.FMIndex([], symbols).matches(*(np.zeros(0, np.int64),) * 4)[0]) == 0


def test_merged_matches_cover_repeated_bars_and_the_shorter_record():
    held = ["a b c|a b c|d e f g", "a b c d|e f g h", "x y z"]
    asked = ["d e f g|a b c|q r s t|u v w x|y y y y", "e f g h|a b c d", "a b q d|e f g h", "x y z"]
    got = overlap.shares(held, asked, np.array([0, 1, 2, 3, 3]), np.array([0, 1, 1, 2, 1]))
    assert got.tolist() == pytest.approx([1, 1, 7 / 8, 1, 0])


def test_overlaps_are_those_of_all_pairs(spark, sf):
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    records, sides = overlap.evaluation_records(t("scores"), t("bench")), overlap.evaluation_sides(t("split_files"), t("bench"))
    got = sorted(map(tuple, overlap.overlaps(records, sides).collect()))
    side = t("split_files").select("pos", "split").distinct().toPandas().set_index("pos")["split"]
    music_ = {r["pos"]: bars(r["text"]) for r in t("scores").select("pos", "text").collect()} | {r["rec_no"]: bars(r["input_content"]) for r in t("bench").select("rec_no", "input_content").collect()}
    train = [p for p in music_ if side.get(p) == "train"]
    held = [p for p in music_ if p >= 10**9 or side.get(p) in ("val", "test")]
    assert got == sorted((a, b) for a in train for b in held if same(music_[a], music_[b], excerpts=True)) and got


def test_dense_pairs_need_more_than_a_chance_run(spark):
    rng = random.Random(4)
    made = [[[rng.choice("abcdefg") + "8" for _ in range(12)] for _ in range(6)] for _ in range(60)]
    # the last ten stand on the other side too, a note changed in each bar
    for r in made[:10]:
        made.append([["x8" if k == at else n for k, n in enumerate(bar)] for bar, at in zip(r, rng.choices(range(12), k=6), strict=True)])
    rows = [(k, "|".join(map(" ".join, r)), k < 30, k >= 30) for k, r in enumerate(made)]
    dense = music.dense_keys(music.with_keys(spark.createDataFrame(rows, "class long, bars string, training boolean, evaluation boolean")))
    got = {tuple(r) for r in overlap.candidates(dense.select("class", "training", "evaluation", "need", "tokens"), both=True).collect()}
    runs = [{tuple(bar[i : i + 4]) for bar in r for i in range(9)} for r in made]
    need = {r["class"]: r["need"] for r in dense.collect()}
    common = {(t, e): len(runs[t] & runs[e]) for t in range(30) for e in range(30, 70)}
    assert len(need) == 70 and min(need.values()) > 3 and {(k, 60 + k) for k in range(10)} <= got
    assert {p for p, n in common.items() if n >= need[p[1]]} <= got
    assert all(common[p] >= 3 for p in got) and sum(n > 0 for n in common.values()) > 5 * len(got)


def test_overlap_edges(spark, monkeypatch):
    schema = "key long, training boolean, text string, bars_ string"
    made = lambda rows: music.with_bars(spark.createDataFrame(rows, schema), "text")
    assert overlap.overlaps(made([])).count() == 0
    one = " | ".join(f"c4 d{k}" for k in range(10))
    assert overlap.overlaps(made([(1, True, one, None)])).count() == 0
    monkeypatch.setattr(overlap, "SHARD_PAIRS", 2)
    hot = [(i, i % 2 == 0, f"e4 f4 | g{i} a4 | b{i} a4", None) for i in range(100, 300)]  # one bar in all records, which are no overlaps
    rows = [(1, True, one, None), (1, True, one, None), (2, False, one.replace("c4 d3 |", "c4 d3 d9 |"), None), (3, False, " | ".join(reversed(one.split(" | "))), None), (4, False, "c4 d1 | c4 d2 | c4 d7", None), (5, False, None, None), (6, None, one, None), (7, False, "", None), (8, False, "z1 | z2", None), (None, False, one, None), *hot]
    assert sorted(map(tuple, overlap.overlaps(made(rows)).collect())) == [(1, 2), (1, 3), (1, 4)]


def test_split_of_takes_the_last_load(spark):
    ts = lambda d: datetime(2025, 1, d)
    df = spark.createDataFrame([(1, "train", "a", None, ts(1)), (1, "val", "a", None, ts(2)), (2, None, "a", None, ts(1)), (3, "test", "b", None, None), (None, "test", "b", None, None)], "pos long, split string, corpus string, scanned_at timestamp, loaded_at timestamp")
    assert sorted((r["pos"], r["split"]) for r in overlap.split_of(df).collect()) == [(1, "val"), (3, "test")]
