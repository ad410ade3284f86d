"""Canonical values, samples, packing, leakage and consistent forms against plain Python, and their edge cases."""

from __future__ import annotations

import itertools
import random
import re
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quaver.llm import canon, fold, leakage, packing, queries, sample, skeleton

DOCS = "doc_id long, text string, h string, shard long, words int, form string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], DOCS)


# --- canonical values ---------------------------------------------------------------------------


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def test_distances_and_tree():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(0, 8)))
    a, b = [word() for _ in range(400)], [word() for _ in range(400)]
    (ca, na), (cb, nb) = canon._codes(a), canon._codes(b)
    assert list(canon.distances(ca, na, cb, nb)) == [lev(x, y) for x, y in zip(a, b, strict=True)]
    words = sorted(set(a))
    tree = canon.BKTree(words)
    radius = np.array([rng.randint(0, 3) for _ in b], np.int32)
    got = {(int(q), words[n], int(d)) for q, n, d in zip(*tree.within(b, radius), strict=True)}
    assert got == {(i, w, lev(x, w)) for i, x in enumerate(b) for w in words if lev(x, w) <= radius[i]}
    assert len(canon.BKTree([]).within(["a"], np.array([1]))[0]) == 0
    near = {(int(q), words[n], int(d)) for q, n, d in zip(*tree.nearest(b, radius), strict=True)}
    least = [min(lev(x, w) for w in words) for x in b]
    assert near == {(i, w, least[i]) for i, x in enumerate(b) for w in words if lev(x, w) == least[i] <= radius[i]}


def test_frontier_is_bounded(monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(6, 24)))
    tree = canon.BKTree(sorted({word() for _ in range(20_000)}))
    seen = []
    real = canon.distances
    monkeypatch.setattr(canon, "distances", lambda a, na, b, nb: seen.append(len(na)) or real(a, na, b, nb))
    values = [word() for _ in range(300)] + [w[:-1] for w in tree.words[:9700]]
    q, _, d = tree.nearest(values, np.array([canon.reach(len(v)) for v in values]))
    assert max(seen) <= canon.FRONTIER and set(q[d <= 1].tolist()) >= set(range(300, 10_000))


TERMS = [(1, "style", "Baroque", ["Barock"]), (2, "style", "Galant", None), (3, "ensemble", "string orchestra", ["orchestra d'archi"]), (4, "ensemble", "viola", []), (5, "ensemble", "violin", []), (6, "ensemble", "alto voice", []), (7, "musical_form", "étude", ["Übungsstück"])]
TYPED = {
    "style": {"Baroque": None, "Barock": 1, "baroque": 1, "Ｂａｒｏｑｕｅ": 1, "Вaroque": 1, "Baorque (?)": 1, " Baroque, no. 3": 1, "2 Baroque": 1, "Barok*": 1, "BAROCK I": 1, "toy siren": 0, "???": 0, "Galants": 2, "Galant(solo)": 2, "n/a": 0, "string orchestra": 0},
    "ensemble": {"orchestra, string": 3, "orchestra string": 3, "orchestra_d'archi": 3, "vioIin": 5, "viola ": 4, "voila": 4, "vi​olin": 5, "alto_voice": 6, "kazoo": 0},
    "musical_form": {"etude": 7, "Étude": 7, "Ubungsstuk": 7},
}


def _scores(spark, rows):
    return spark.createDataFrame(rows, "pos long, style string, musical_form array<string>, ensemble array<string>, value string, field_name string, term_id long")


@pytest.mark.parametrize("shard", [canon.SHARD_ENTRIES, 3])
def test_mapping(spark, monkeypatch, shard):
    monkeypatch.setattr(canon, "SHARD_ENTRIES", shard)
    terms = spark.createDataFrame(TERMS, "term_id long, field_name string, term string, aliases array<string>")
    rows = [(i, v, None, [], "x", "y", 9) for i, v in enumerate(TYPED["style"])]
    rows += [(100, None, list(TYPED["musical_form"]), [None, "", "  ", *TYPED["ensemble"], "viola "], "x", "y", 9), (101, " ", None, None, "x", "y", 9), (102, " ", ["étude", None], ["kazoo"] * 3, "x", "y", 9)]
    got = {(r["pos"], r["field_name"], r["item_no"]): r["term_id"] for r in canon.mapped(_scores(spark, rows), terms).collect()}
    want = {(i, "style", 0): t for i, t in enumerate(TYPED["style"].values()) if t is not None}
    want |= {(100, "musical_form", k): t for k, t in enumerate(TYPED["musical_form"].values())}
    want |= {(100, "ensemble", k + 3): t for k, t in enumerate([*TYPED["ensemble"].values(), 4])} | {(102, "ensemble", k): 0 for k in range(3)}
    assert got == want
    assert canon.mapped(_scores(spark, rows).limit(0), terms).count() == 0
    assert {r["term_id"] for r in canon.mapped(_scores(spark, rows[:5]), terms.limit(0)).collect()} == {0}


def test_long_values_and_ties(spark):
    terms = spark.createDataFrame([(2, "f", "abcx", []), (1, "f", "abcy", []), (3, "f", None, ["zzz"]), (None, "f", "abcd", []), (4, None, "q", [])], "term_id long, field_name string, term string, aliases array<string>")
    values = spark.createDataFrame([("f", "abcd"), ("f", "w" * 50_000), ("f", "zzz"), ("g", "abcx"), (None, "abcx"), ("f", None)], "field_name string, value string")
    got = {(r["field_name"], r["value"][:5]): r["term_id"] for r in canon.canonical(values, terms).collect()}
    assert got == {("f", "abcd"): 1, ("f", "wwwww"): 0, ("f", "zzz"): 3, ("g", "abcx"): 0}


# --- samples ------------------------------------------------------------------------------------


def test_repair():
    rng = np.random.default_rng(1)
    for _ in range(200):
        k = int(rng.integers(1, 8))
        have, floor = rng.integers(0, 200, k), rng.integers(0, 30, k)
        share = rng.dirichlet(np.ones(k))
        rows = int(rng.integers(1, 300))
        take, short = sample.repair(have, share, floor, rows, 3)
        low = np.minimum(floor, have)
        assert (take >= low).all() and (take <= have).all() and take.sum() == max(low.sum(), min(rows, have.sum()))
        assert (short == (have < np.maximum(share * rows, floor))).all()
        # no exchange of one record would help
        goal = share * rows
        weight = 1 / np.maximum(goal, 0.5)
        slope = 2 * (take - goal) * weight
        for a in np.flatnonzero(take > low):
            for b in np.flatnonzero(take < have):
                assert a == b or slope[a] - slope[b] - weight[a] - weight[b] <= 1e-6


def test_small_categories_keep_their_proportion():
    have, share = np.array([9000, 1400, 900, 700, 30]), np.array([0.79, 0.08, 0.08, 0.04, 0.01])
    take, short = sample.repair(have, share, np.array([0, 0, 0, 600, 0]), 1000, 0)
    assert take.tolist() == pytest.approx([329, 33, 33, 600, 4], abs=1) and not short.any()  # 400 left in proportion to 79 : 8 : 8 : 1


def test_exchange_of_joint_signatures():
    rng = np.random.default_rng(5)
    member = np.array([(a, 3 + b) for a in range(3) for b in range(4)] + [(-1, 3)])
    for _ in range(30):
        have = rng.integers(20, 400, 13)
        goal = np.concatenate((rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(4)))) * 150
        floor = rng.integers(0, 20, 7)
        take = sample.exchange(have, member, goal, floor, 150, 1)
        got = np.array([take[(member == c).any(axis=1)].sum() for c in range(7)])
        cost = lambda g: ((g - goal) ** 2 / np.maximum(goal, 0.5)).sum()
        assert (take >= 0).all() and (take <= have).all() and take.sum() == 150 and (got >= floor).all()
        for a, b in itertools.permutations(range(13), 2):
            if take[a] and take[b] < have[b]:
                other = got.copy()
                for c in member[a]:
                    other[c] -= c >= 0
                for c in member[b]:
                    other[c] += c >= 0
                assert (other < floor).any() or cost(other) > cost(got) - 1e-6
    huge = sample.exchange(np.array([10**12, 10**10]), np.arange(2)[:, None], np.array([5e8, 5e8]), np.zeros(2, np.int64), 10**9, 0)
    assert huge.tolist() == [5 * 10**8] * 2


def test_sample_on_tables(spark, sf):
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    args = t("scores"), t("sample_targets"), t("term_list")
    plan = sample.report(*args).toPandas()
    got = sample.draw(*args).toPandas()
    count = got.groupby(["dimension", "category"]).size()
    for r in plan.itertuples():
        assert count.get((r.dimension, r.category), 0) == r.drawn <= r.have and r.drawn >= min(r.have, r.min_rows)
        assert r.met == (r.have >= max(r.target_share * r.sample_rows, r.min_rows))
    assert not got.duplicated(["dimension", "pos"]).any()
    assert (got.groupby("dimension").size() == plan.groupby("dimension").apply(lambda g: max(g["sample_rows"].iloc[0], np.minimum(g["have"], g["min_rows"]).sum()), include_groups=False).clip(upper=plan.groupby("dimension")["have"].sum())).all()
    assert got.sort_values(list(got)).reset_index(drop=True).equals(sample.draw(*args).toPandas().sort_values(list(got)).reset_index(drop=True))


def test_targets_are_met_by_what_is_drawn(spark, sf, monkeypatch):
    rng = np.random.default_rng(7)
    for _ in range(50):
        have, want = rng.integers(0, 40, 6), float(rng.integers(0, 60)) + rng.choice([0, 0.4])
        take, held = sample._some(have, 30, rng), np.arange(6) < 2
        assert sample.reached(have, held, take, want, 30, 1) == (have[held].sum() >= want)
    before = {r["target_id"] for r in queries.p5_found(spark, sf).collect()}
    targets = spark.read.parquet(f"{sf}/sample_targets.parquet").where("target_share * sample_rows > 0 or min_rows > 0")
    wanted = {r["target_id"] for r in targets.where("dimension is not null and category is not null").collect()}
    monkeypatch.setattr(sample, "exchange", lambda have, *_: np.zeros_like(have))
    after = {r["target_id"] for r in queries.p5_found(spark, sf).collect()}
    assert before < after == wanted


def test_sample_categories_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(sample, "BUCKET_ROWS", 10)
    terms = spark.createDataFrame([(1, "style", "Baroque", ["Barock"]), (2, "style", "Galant", [])], "term_id long, field_name string, term string, aliases array<string>")
    targets = spark.createDataFrame(
        [(1, "style", "Baroque", 0.5, 5, 40), (2, "style", "Galant", 0.5, 5, 40), (3, "composer", "Ada Cole", 0.9, 1, 40), (4, "composer", "(any other)", 0.1, 1, 40), (5, "extras.label", "Q1", 1.0, 0, 40), (6, "extras.label", "(none)", 0.0, 2, 40), (7, None, None, None, None, None)],
        "target_id long, dimension string, category string, target_share double, min_rows long, sample_rows long",
    )
    rows = [(i, ["Barock", "baroque ", None, "siren"][i % 4], ["Ada Cole", "Cole, A.", "COLE", None, "Ben Cole", "anon"][i % 6], {"label": ["Q1", "quadrant 1", " q1", "1", "Q5", ""][i % 6]} if i % 7 else None, "x", 3) for i in range(210)]
    scores = spark.createDataFrame([*rows, rows[0], (None, "Barock", None, None, "x", 3)], "pos long, style string, composer string, extras map<string,string>, category string, take long")
    have = {r["target_id"]: (r["have"], r["met"], r["drawn"]) for r in sample.report(scores, targets, terms).collect()}
    q1 = sum(1 for i in range(210) if i % 7 and i % 6 < 4)
    assert have[1][0] == sum(i % 4 < 2 for i in range(210)) and have[2] == (0, False, 0) and have[1][1:] == (True, 40)
    # "COLE" alone fits two composers and so names neither
    assert have[3][0] == sum(i % 6 < 2 for i in range(210)) and have[4][0] == 210 - have[3][0] and have[5][0] == q1 and have[6][0] == 210 - q1
    got = sample.draw(scores, targets, terms).toPandas().groupby(["dimension", "category"]).size().to_dict()
    assert got == {("style", "Baroque"): 40, ("composer", "Ada Cole"): 36, ("composer", "(any other)"): 4, ("extras.label", "Q1"): 38, ("extras.label", "(none)"): 2}
    joint = sample.draw(scores, targets, terms, together=True).toPandas()
    plan = sample.report(scores, targets, terms, together=True).toPandas()
    assert joint["pos"].nunique() == 40 and {(r.dimension, r.category): r.drawn for r in plan.itertuples() if r.drawn} == joint.groupby(["dimension", "category"]).size().to_dict()
    assert sample.draw(scores.limit(0), targets, terms).count() == 0 and sample.draw(scores, targets.limit(0), terms).count() == 0


# --- packing ------------------------------------------------------------------------------------

TEXTS = ["a", "Hello, it's me\n\n  and \t you're  ", "  x", "\n\nx ", "日本語 text и ещё", "é café   nb sp ​ zero", "c'8.-> d,4 |\n    e8 | % 3\n", "1234567 89,0", "a\x1cb \x85 c", "🎵🎵 🎵", " ", "\r\n x", "x" * 300, "' s 'll 'S"]


def test_counts_are_the_tokenizer_s(sf):
    count = packing.Counter(packing.VOCABULARY)
    docs = pd.read_parquet(f"{sf}/documents.parquet")["text"].dropna().tolist()
    rng = random.Random(1)
    mixed = ["".join(rng.choice(["a", " ", "\n", " ", "'s", "1", ".", "é", "​", "\t", "  "]) for _ in range(40)) for _ in range(300)]
    for text in [*TEXTS, *docs, *mixed]:
        assert count.tokens(text) == len(count.encode(text)), repr(text)


def test_pieces():
    count = packing.Counter(packing.VOCABULARY)
    for text in [*TEXTS, "word " * 200, "y" * 5000 + " z", "日本語" * 100]:
        for capacity in (3, 8, 50):
            parts = count.pieces(text, capacity)
            assert "".join(text[a:b] for a, b, _ in parts) == text
            assert all(len(count.encode(text[a:b])) == k <= capacity for a, b, k in parts)
    rng = random.Random(2)
    for _ in range(300):  # characters on which word ends are unsure
        text = "".join(rng.choice(["a", " ", "\n", "'s", "1", ".", "é", "\u200b", "\x1c", "\x85", "  "]) for _ in range(120))
        assert all(len(count.encode(text[a:b])) == k <= 20 for a, b, k in count.pieces(text, 20))
    with pytest.raises(ValueError, match="larger than a container"):
        count.pieces("🎵", 1)


def test_best_two_fit():
    rng = np.random.default_rng(2)
    for n, capacity in ((1, 10), (500, 100), (3000, 1000), (40, 7)):
        sizes = np.minimum(rng.integers(1, capacity + 1, n), rng.integers(1, capacity + 1, n))
        at = packing.best_two_fit(sizes, capacity)
        load = np.bincount(at, sizes)
        assert load.max() <= capacity and (load > 0).all() and len(load) <= max(1.03 * np.ceil(sizes.sum() / capacity), np.ceil(sizes.sum() / capacity) + 2)
    with pytest.raises(ValueError, match="larger than a container"):
        packing.best_two_fit(np.array([5]), 3)
    # greedily 6 + 3 leaves 1 free; 6 + 2 + 2 is full
    assert np.bincount(packing.best_two_fit(np.array([6, 3, 2, 2]), 10), [6, 3, 2, 2]).tolist() == [10, 3]


def test_packing(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    monkeypatch.setattr(packing, "SHARD_ITEMS", 60)
    got = packing.pack(docs, 700).toPandas()
    texts = docs.toPandas().set_index("doc_id")["text"]
    count = packing.Counter(packing.VOCABULARY)
    assert set(got["doc_id"]) == {k for k, t in texts.items() if t}
    assert got.groupby("container")["tokens"].sum().max() <= 700
    for doc, g in got.groupby("doc_id"):
        g = g.sort_values("piece")
        assert "".join(texts[doc][a:b] for a, b in zip(g["start"], g["end"], strict=True)) == texts[doc]
        assert (len(g) > 1) == (count.tokens(texts[doc]) > 700)
    row = packing.packing_report(spark.createDataFrame(got), 700).first()
    assert row["n_items"] == len(got) and row["used"] > 0.9
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (4, "w " * 3000)]
    small = packing.pack(docs_of(spark, rows), 100).toPandas()
    assert sorted(set(small["doc_id"])) == [3, 4] and (small["doc_id"] == 3).sum() == 2
    assert packing.pack(docs_of(spark, []), 100).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, 0)


# --- leakage ------------------------------------------------------------------------------------


def words_of(text):
    return [w for w in (re.sub(r"[\W_]+", "", x) for x in fold.folded_py(text).split()) if w]


def test_shingles_are_those_of_the_words():
    rng = random.Random(5)
    texts = ["", "one", "A b, c. D e", "a-b c d e F", "ｗｉｄｅ Ёлка é́ e​x y z", "...  !! a b c d e", *(" ".join(rng.choice(["Ab", "c,", "d'8.", "é", "\n", "—", "x_y"]) for _ in range(30)) for _ in range(40)), " ".join(f"w{i}" for i in range(400_000))]
    h, owner, at, words = leakage.shingle_hashes(texts)
    assert list(words) == [len(words_of(t)) for t in texts]
    seen = {}
    want = [(i, k, tuple(w[k : k + 5])) for i, t in enumerate(texts) for w in [words_of(t)] for k in range(len(w) - 4)]
    assert [(i, k) for i, k, _ in want] == list(zip(owner, at, strict=True))
    for (_, _, s), x in zip(want, h.tolist(), strict=True):
        assert seen.setdefault(s, x) == x
    assert len(set(seen.values())) == len(seen)
    assert list(leakage.word_hashes(["Abc"])[0]) == list(leakage.word_hashes(["x abc,"])[0][1:])


def test_leaks_on_tables(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "heldout_items"))
    got = {(r["item_id"], r["doc_id"]) for r in leakage.leaks(docs, items).collect()}
    held = {r["item_id"]: words_of(r["text"]) for r in items.collect()}
    index = {}
    for i, w in held.items():
        for k in range(len(w) - 4):
            index.setdefault(tuple(w[k : k + 5]), []).append((i, k))
    want = set()
    for r in docs.where("text is not null").collect():
        w = words_of(r["text"])
        cover = {}
        for k in range(len(w) - 4):
            for i, p in index.get(tuple(w[k : k + 5]), ()):
                cover.setdefault(i, set()).update(range(p, p + 5))
        want |= {(i, r["doc_id"]) for i, c in cover.items() if len(c) >= leakage.SHARE * len(held[i])}
    assert got == want and got


def test_leak_edges(spark, monkeypatch):
    rng = random.Random(7)
    item = [f"w{i}" for i in range(50)]
    filler = lambda n: " ".join(f"f{rng.randrange(10**6)}" for _ in range(n))
    docs = [
        (1, filler(20) + " " + " ".join(item).upper() + "! " + filler(9)), (2, " ".join(item[10:35])), (3, " ".join(item[:7])), (4, " ".join(w if i % 9 else "zz" for i, w in enumerate(item))), (5, None), (6, ""), (7, " ".join(reversed(item))),
        (8, " ".join(item[:15]) + " " + filler(300) + " " + " ".join(item[15:30])), (9, filler(150_000) + " " + " ".join(item)), (1, filler(3)), (None, " ".join(item)), (10, " ".join(f"ｗ{w[1:]}" for w in item)),
    ]
    items = [(1, " ".join(item)), (1, " ".join(item)), (2, None), (3, ""), (4, "too short here"), (5, " ".join(item)), (None, " ".join(item))]
    schema = "item_id long, text string, words int"
    made = lambda rows: spark.createDataFrame([(*r, 1) for r in rows], schema)
    want = sorted((i, d) for i in (1, 5) for d in (1, 2, 4, 8, 9, 10))
    pairs = lambda: sorted((r["item_id"], r["doc_id"]) for r in leakage.leaks(docs_of(spark, docs), made(items)).collect())
    assert pairs() == want
    monkeypatch.setattr(leakage, "BLOCK_SHINGLES", 46)  # the items need more than one pass
    monkeypatch.setattr(leakage, "BLOCK_ITEMS", 2)
    assert pairs() == want
    assert leakage.leaks(docs_of(spark, docs), made([])).count() == 0 and leakage.leaks(docs_of(spark, []), made(items)).count() == 0


def test_leaks_of_repeated_and_short_items(spark):
    turn = [f"t{i}" for i in range(6)]
    # few different shingles stand in most places, and document 30 has but two of them, the most frequent ones
    item = [*(f"u{i}" for i in range(60)), *(turn * 17)]
    docs = [(1, " ".join(turn * 17)), (2, "one Two, three"), (3, "one two"), (4, "x one two three four y"), (5, "solo"), (30, " ".join([*turn, "x"] * 17))]
    docs += [(10 + k, " ".join(item[:20])) for k in range(3)] + [(20 + k, " ".join(turn * 17)) for k in range(5)]
    items = [(1, " ".join(item), 1), (2, "one two three", 1), (3, "Solo", 1), (4, "two one", 1), (5, " ".join(turn * 30), 1)]
    got = {(r["item_id"], r["doc_id"]) for r in leakage.leaks(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string, words int")).collect()}
    held = {1, 30, *range(20, 25)}
    assert got == {(1, d) for d in held} | {(5, d) for d in held} | {(2, 2), (2, 4), (3, 5)}


# --- consistent forms ---------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("a", "b"),
    [("café", "café"), ("note", "nоte"), ("Ｗｉｄｅ １２", "Wide 12"), ("a b", "a b"), ("ab", "a​b"), ("ab", "a­b"), ("ё", "ё"), ("fi", "ﬁ"), ("ΑΒ", "AB"), ("a-b", "a‑b"), ("a\nb", "a\r\nb"), ("x﻿", "x"), ("a  　b", "a   b")],
)
def test_look_the_same(spark, a, b):
    assert skeleton.skeleton(a) == skeleton.skeleton(b)
    table = skeleton.confusables(spark)
    assert skeleton.skeleton(a, table) == skeleton.skeleton(b, table)


@pytest.mark.parametrize(("a", "b"), [("γ", "y"), ("σ", "o"), ("Ѵ", "V"), ("ѵ", "v"), ("Ꭺ", "A"), ("ꓐ", "B"), ("ⲟ", "o"), ("ⅴ", "v"), ("∕", "/"), ("⁄", "/"), ("’", "'"), ("І", "I"), ("ӏ", "l"), ("∣", "|"), ("ո", "n")])
def test_listed_confusables(spark, a, b):
    table = skeleton.confusables(spark)
    assert skeleton.skeleton(f"x {a} z", table) == skeleton.skeleton(f"x {b} z", table) == f"x {b} z"
    assert fold.folded_py("օնս") == spark.range(1).select(fold.folded(F.lit("օնս"))).first()[0]


@pytest.mark.parametrize(("a", "b"), [("a", "A"), ("e", "é"), ("c4", "c8"), ("l", "1"), ("O", "0"), ("x²", "x2"), ("и", "й"), ("a b", "a\nb"), ("a b", "ab"), ("m", "rn"), ("ß", "ss"), ("o", "ö")])
def test_look_different(spark, a, b):
    assert skeleton.skeleton(a) != skeleton.skeleton(b)
    assert skeleton.skeleton(a, skeleton.confusables(spark)) != skeleton.skeleton(b, skeleton.confusables(spark))


def test_forms_are_stable(spark):
    every = "".join(chr(c) for c in range(0x20, 0x30000) if unicodedata.category(chr(c)) not in ("Cs", "Cn", "Co"))
    for k in range(0, len(every), 1000):
        for table in (None, skeleton.confusables(spark)):
            once = skeleton.skeleton(every[k : k + 1000], table)
            assert skeleton.skeleton(once, table) == once


def test_look_alikes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["text"] is not None]
    by = {}
    table = skeleton.confusables(spark)
    for i, t in rows:
        by.setdefault(skeleton.skeleton(t, table), []).append((i, t))
    want = sorted((a, b) for g in by.values() for a, x in g for b, y in g if a < b and x != y)
    assert sorted(map(tuple, skeleton.look_alikes(docs).collect())) == want
    assert {r["doc_id"]: r["form"] for r in skeleton.forms(docs).where("form is not null").collect()} == {i: skeleton.skeleton(t, table) for i, t in rows}
    edge = [(1, "note"), (2, "nоte"), (3, "note"), (3, "note"), (4, None), (5, ""), (6, "​"), (7, "Note"), (None, "nоte"), (8, "x" * 300_000), (9, "х" * 300_000)]
    assert sorted(map(tuple, skeleton.look_alikes(docs_of(spark, edge)).collect())) == [(1, 2), (2, 3), (5, 6), (8, 9)]
    assert skeleton.look_alikes(docs_of(spark, [])).count() == 0 and skeleton.forms(docs_of(spark, edge)).where(F.col("form").isNull()).count() == 1


def test_nothing_else_imports_this_package():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    others = [p for p in (root / "quaver").rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert others and not [p for p in others if re.search(r"quaver\.llm|from quaver import llm", p.read_text())]
