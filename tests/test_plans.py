"""Tasks, selections, scores, prompts, models, programs, streaming and the command line."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaver import cli
from quaver.functions import numeric as N
from quaver.operators import descriptors, external
from quaver.operators import scores as S
from quaver.operators import selection as R
from quaver.operators.errors import CATEGORIES
from quaver.operators.joins import align, other_values
from quaver.plans import catalog, chat, tasks
from quaver.sources import files, midi
from quaver.streaming import scoring


def test_registries():
    assert len(tasks.REGISTRY) == 10 and sum(t.default_n for t in tasks.iter_tasks()) == 1086
    assert [t.name for t in tasks.iter_tasks()] == sorted(tasks.REGISTRY)
    with pytest.raises(KeyError):
        tasks.register(tasks.BarCount)
    with pytest.raises(ValueError):
        tasks.register(type("Unnamed", (tasks.BarCount,), {"name": ""}))
    assert [t.name for t in tasks.chosen_tasks("bar_count,nothing")] == ["bar_count"]
    assert [t.name for t in tasks.chosen_tasks("all", "clips")] == ["emotion_recognition"]
    assert chat.list_model_ids() == sorted(chat.MODELS) and len(chat.MODELS) == 4
    with pytest.raises(KeyError):
        chat.register_model(chat.get_spec("phi4"))
    with pytest.raises(KeyError):
        chat.get_spec("none")
    with pytest.raises(KeyError):
        chat.register_regime(chat.FewShot)


def test_alignment_keeps_repeats_and_last_record(spark):
    bench = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", "x", 3)], "id string, gold string, rec_no long")
    preds = spark.createDataFrame([("a", "1"), ("a", "1"), ("z", "2")], "id string, p string")
    assert [(r["id"], r["gold"]) for r in align(preds, bench).collect()] == [("a", "new"), ("a", "new")]


def test_bar_count_upper_median(spark):
    df = spark.createDataFrame([("1", "1"), ("4", "1"), ("x", "1"), ("7", "1"), ("20", "1"), (None, "1")], "p string, g string")
    r = S.bar_count_stats(df, "p", "g").first()
    assert (r["n"], r["n_parsed"], r["mean_abs_err"], r["median_abs_err"], r["within_5"]) == (6, 4, 7.0, 6.0, 0.5)
    r = S.bar_count_stats(df.where("p = 'x'"), "p", "g").first()
    assert (r["n_parsed"], r["mean_abs_err"], r["median_abs_err"], r["within_1"]) == (0, None, None, 0.0)


def test_overall_counts_empty_but_not_missing_tasks(spark):
    rows = [("a", 10, 0.5, None, None, False), ("b", 0, None, None, None, False), ("c", 30, None, 0.9, None, False), ("d", 0, None, None, None, True)]
    df = spark.createDataFrame(rows, "task string, n int, accuracy double, score double, macro_f1 double, missing boolean")
    r = S.overall(df).first()
    assert r["macro_avg"] == pytest.approx(1.4 / 3) and r["weighted_avg"] == pytest.approx(0.8)
    assert tuple(S.overall(df.limit(0)).first()) == (0.0, 0.0)


def test_macro_of_category_means(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 0.0), ("x", 0.0), ("y", 1.0)], "category string, f1 double")
    r = S.macro_f1(df).first()
    assert (r["n"], r["mean_f1"], r["macro_f1"]) == (4, 0.5, pytest.approx(2 / 3))


def test_confusion_off_grid(spark):
    df = spark.createDataFrame([("Q1", "Q1"), ("Q1", "zzz"), ("Q2", None), ("??", "Q1")], "g string, p string")
    got = {r["gold"]: tuple(r)[1:] for r in S.confusion(df, F.col("p"), F.col("g")).collect()}
    assert got == {"Q1": (1, 0, 0, 0, 1), "Q2": (0, 0, 0, 0, 1), "Q3": (0, 0, 0, 0, 0), "Q4": (0, 0, 0, 0, 0)}


def test_category_fill_is_the_sequential_one(spark):
    rng = random.Random(5)
    for size, n, p in ((40, 10, 0.5), (400, 10, 0.1), (7, 50, 0.9), (300, 25, 0.02), (0, 5, 1)):
        pool = [(i + 1, *[rng.random() < p for _ in CATEGORIES]) for i in range(size)]
        want, at, per = [], 0, max(1, n // 5)
        for k, c in enumerate(CATEGORIES):
            got = tries = 0
            while at < size and got < per and tries < 8 * per:
                row = pool[at]
                at, tries = at + 1, tries + 1
                if row[k + 1]:
                    want.append((row[0], c))
                    got += 1
        df = spark.createDataFrame(pool, "rn int, " + ", ".join(f"ok_{c} boolean" for c in CATEGORIES))
        assert sorted((r["rn"], r["category"]) for r in R.fill_categories(df, n).collect()) == sorted(want)


def test_work_split(spark):
    rows = [(i, f"w_{i // 2}_x_{'viola' if i % 2 else 'cello'}") for i in range(200)]
    df = spark.createDataFrame(rows, "pos long, source_id string")
    got = R.split_by_work(df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, R.split_by_work(df).collect()))
    by = {}
    for r in got:
        assert by.setdefault(r["work"], r["split"]) == r["split"]
    assert sorted(list(by.values()).count(s) for s in ("train", "val", "test")) == [10, 10, 80]
    with pytest.raises(ValueError):
        R.split_by_work(df, 0.9, 0.2)


def test_prompt_bank(spark):
    df = spark.createDataFrame([(i, f"s{i}", "C", "B", ["f"], [], {"part": "viola"}) for i in range(4)], "pos long, source_id string, composer string, style string, musical_form array<string>, ensemble array<string>, extras map<string,string>")
    bank = chat.prompt_bank(df, 10, 42)
    rows = bank.orderBy("id").collect()
    assert len(rows) == 10 and rows == chat.prompt_bank(df, 10, 42).orderBy("id").collect() and rows[0]["id"] == "prompt_0000"
    assert "the viola part" in rows[0]["user_prompt"] and "approximately 4 bars" in chat.prompt_bank(df, 1, 42, 4).first()["user_prompt"]
    with pytest.raises(ValueError):
        chat.prompt_bank(df.limit(0), 1)
    few = bank.select(chat.FewShot(demonstrations=" demo \n").prompt().alias("p")).first()["p"]
    assert few.index("demo\n\n%% === METADATA ===") < few.index("Write a LilyPond")


def test_conversation(spark):
    df = spark.createDataFrame([(1, 0, "system", "S"), (1, 1, "user", "a"), (1, 2, "user", "b"), (2, 0, "user", "u"), (2, 1, "system", "late")], "c int, turn int, role string, text string")
    got = {r["c"]: r["prompt"] for r in chat.conversation_prompt(df, "c").collect()}
    assert got[1].startswith("### System:\nS\n") and "### User:\nb\n" in got[1] and got[2].startswith(f"### System:\n{chat.WRITER}") and "### User:\nlate" in got[2]


def test_all_tasks_build_and_score(spark, sf):
    scores = catalog.scores(spark, sf)
    bench = tasks.build_all(scores, limit=12, seed=1).cache()
    assert bench.count() > 60 and bench.select("id").distinct().count() == bench.count()
    mc = bench.where("template_kind = 'multiple_choice'")
    assert mc.where("size(options) <> 4 or gold_index not between 0 and 3").count() == 0
    assert mc.where("task not in ('next_bar_prediction') and options[gold_index] <> gold").count() == 0
    right = bench.select("task", "id", "gold", "gold_index", "gold_bars", "category", "options", F.lit("").alias("raw_output"), F.coalesce(F.col("gold_index").cast("string"), "gold", F.array_join(F.col("gold_bars").cast("array<string>"), " ")).alias("parsed_answer"))
    for r in tasks.score_all(right).collect():
        assert r["missing"] or max(r["accuracy"] or 0, r["score"] or 0, r["macro_f1"] or 0) == pytest.approx(1.0), r
    bench.unpersist()


def test_js_and_frechet(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(50, 8)), rng.normal(size=(50, 8)) + 5
    df = lambda a: spark.createDataFrame([(v.tolist(),) for v in a], "embedding array<double>")
    assert N.frechet(df(x), df(x)) == pytest.approx(0, abs=1e-6) and N.frechet(df(x), df(y)) > 1
    m = N.moments(df(x), "embedding").first()
    assert np.allclose(m["mean"], x.mean(0)) and np.allclose(np.array(m["cov"]).reshape(8, 8), np.cov(x, rowvar=False))
    with pytest.raises(ValueError):
        N.frechet(df(x), df(x[:1]))
    stats = lambda rows: spark.createDataFrame(rows, "metric string, mean double, std double, n long")
    a = stats([("p", 0.5, 0.1, 9), ("q", 0.2, 0.1, 9)])
    assert N.js_similarity(a, a).first()[0] == pytest.approx(100)
    assert N.js_similarity(a, stats([("p", 50.0, 0.1, 9), ("q", 20.0, 0.1, 9)])).first()[0] == pytest.approx(25, abs=0.01)
    assert N.js_similarity(a, stats([("p", 0.5, None, 1), ("q", 0.2, 0.1, 9)])).first()[0] is None
    assert N.js_similarity(a, stats([("p", 0.5, 0.0, 9), ("q", 0.2, 0.1, 9)])).first()[0] is None
    rows = spark.createDataFrame([(0.5, None), (0.7, float("nan")), (None, 1.0)], "u double, v double")
    got = {r["metric"]: (r["n"], r["std"]) for r in N.descriptor_stats(rows, ["u", "v"]).collect()}
    assert got["u"][0] == 2 and got["v"] == (1, None)


def test_descriptors(spark):
    rng = random.Random(2)
    notes = [(f, rng.randrange(0, 64), rng.randrange(1, 9), rng.randrange(48, 72)) for f in "ab" for _ in range(40)] + [("c", 0, 4, 60)]
    got = {r["file"]: r for r in descriptors.descriptors(spark.createDataFrame(notes, "file string, onset long, duration long, pitch int"), 8).collect()}
    for f in "abc":
        mine = [n for n in notes if n[0] == f]
        end = max(o + d for _, o, d, _ in mine)
        on = [len({p for _, o, d, p in mine if o <= t < o + d}) for t in range(end)]
        assert got[f]["polyphony_rate"] == pytest.approx(sum(k >= 2 for k in on) / sum(k >= 1 for k in on))
        last = max(o for _, o, _, _ in mine) // 8
        hit = [[any(o == m * 8 + t for _, o, _, _ in mine) for t in range(8)] for m in range(last + 1)]
        want = 1 - sum(a != b for x, y in zip(hit, hit[1:]) for a, b in zip(x, y)) / (8 * last) if last else None
        assert got[f]["groove_consistency"] == (want if want is None else pytest.approx(want))
        scales = [{(s + r) % 12 for s in steps} for r in range(12) for steps in (descriptors.MAJOR, descriptors.MINOR)]
        assert got[f]["scale_consistency"] == pytest.approx(max(sum(p % 12 in s for *_, p in mine) for s in scales) / len(mine))


def _program(path, body):
    path.write_text(f"#!/bin/sh\n{body}\n")
    path.chmod(0o755)
    return str(path)


def test_programs(spark, tmp_path):
    df = spark.createDataFrame([("a", "good"), ("b", "bad")], "path string, text string")
    run = lambda **k: {r["path"]: r for r in external.compiled(df, **k).collect()}
    assert {r["error"] for r in run(lilypond="/no/such").values()} == {"lilypond binary not found"}
    fake = _program(tmp_path / "ly", 'if grep -q bad "$4"; then echo "first line" >&2; echo more >&2; exit 1; fi; printf M > "$3.midi"')
    got = run(lilypond=fake)
    assert got["a"]["ok"] and bytes(got["a"]["midi"]) == b"M" and got["b"]["error"] == "first line" and not got["b"]["ok"]
    assert run(lilypond=_program(tmp_path / "none", "exit 0"))["a"]["error"] == "no midi produced"
    slow = run(lilypond=_program(tmp_path / "slow", "exec sleep 5"), seconds=1)["a"]
    assert slow["error"] == "lilypond timeout" and slow["seconds"] == 1
    m = spark.createDataFrame([("a", bytearray(b"x"))], "path string, content binary")
    assert external.converted(m, "content", "midi2ly", _program(tmp_path / "m2l", 'cp "$3" "$2"')).first()["text"] == "x"
    assert external.converted(m, "content", "midi2ly", _program(tmp_path / "m2x", "exit 3")).first()["text"] is None
    assert external.converted(m, "content", "convert-ly", "/no/such").first()["text"] is None


def test_embedding_hook(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(40)], "id long, text string")
    got = external.embed(df, "text", lambda: lambda ts: np.array([[len(t), 1] for t in ts]), batch=7).orderBy("id").collect()
    assert [r["embedding"][0] for r in got] == list(range(40))


def test_stream_is_the_batch(spark, sf, tmp_path):
    bench = spark.read.parquet(f"{sf}/bench.parquet")
    preds = spark.read.parquet(f"{sf}/predictions.parquet").where("finished_at is not null and model_id is not null").dropDuplicates(["model_id", "id"])
    rows = preds.join(bench.select("id", "task").distinct(), "id").select("id", "raw_output", "parsed_answer", "latency_ms", F.col("model_id").alias("model"), "task", F.date_format("finished_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("finished_at"))
    rows.coalesce(1).write.json(str(tmp_path / "in"))
    stream = scoring.aligned_stream(scoring.predictions_stream(spark, str(tmp_path / "in")), bench)
    q = scoring.start(stream.select("id", "model", "gold"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.count()
    agg = scoring.start(scoring.accuracy_by_window(stream), str(tmp_path / "agg"), str(tmp_path / "ck2"))
    agg.awaitTermination(120)
    assert agg.exception() is None and spark.read.parquet(str(tmp_path / "agg")).columns == ["since", "model", "task", "n", "accuracy"]


def echo(spec):
    return external.Echo()


def test_command_line(spark, tmp_path, capsys):
    d = tmp_path / "ly"
    d.mkdir()
    keys = ["c", "d", "e", "f"]
    for i in range(12):
        (d / f"w{i}_x.ly").write_text(f'\\header {{ title = "T{i}" composer = "C{i}" }}\n\\key {keys[i % 4]} \\major \\time {i % 4 + 2}/4\n' + "".join(f"{k}{i}4 |\n" for k in "cdefgabc"))
    (d / "m.json").write_text(json.dumps({f"w{i}": {"composer": f"C{i % 6}", "style": f"S{i % 5}", "path": f"w{i}_x.ly"} for i in range(12)}))
    assert cli.main(["understanding", "build", "--manifest", str(d / "m.json"), "--limit", "8", "--out", str(tmp_path / "bench")], spark) == 0
    run = ["understanding", "run", "--model", "phi4", "--bench", str(tmp_path / "bench"), "--loader", "test_plans:echo", "--out", str(tmp_path / "preds"), "--limit", "5"]
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).parent))
    spark.sparkContext.addPyFile(__file__)
    assert cli.main(run, spark) == 0
    assert cli.main(["metrics", "understanding", "--bench", str(tmp_path / "bench"), "--predictions", str(tmp_path / "preds"), "--model-id", "phi4", "--out", str(tmp_path / "s.json")], spark) == 0
    out = json.loads((tmp_path / "s.json").read_text())
    assert out["model"] == "phi4" and len(out["tasks"]) == 10 and 0 <= out["overall"]["macro_avg"] <= 1
    assert [t["missing"] for t in out["tasks"] if t["task"] == "emotion_recognition"] == [True]
    (tmp_path / "works.json").write_text(json.dumps({"w1": {"composer": "C", "period": "P"}}))
    assert cli.main(["prompt-bank", "build", "--scores-dir", str(d), "--works", str(tmp_path / "works.json"), "--n", "3", "--out", str(tmp_path / "bank")], spark) == 0
    assert cli.main(["generation", "run", "--model", "phi4", "--prompts", str(tmp_path / "bank"), "--loader", "test_plans:echo", "--out", str(tmp_path / "gen")], spark) == 0
    assert cli.main(["generation", "run", "--model", "phi4", "--prompts", str(tmp_path / "bank"), "--loader", "test_plans:echo", "--regime", "nope", "--out", "x"], spark) == 2
    assert cli.main(["generation", "run", "--model", "phi4", "--prompts", str(tmp_path / "bank"), "--loader", "test_plans:echo", "--regime", "few", "--out", "x"], spark) == 2
    assert cli.main(["metrics", "generation", "--samples", str(d), "--out", str(tmp_path / "g.json"), "--lilypond", "/no/such"], spark) == 0
    assert json.loads((tmp_path / "g.json").read_text())["compile_rate"] == 0
    assert cli.main(["understanding", "build", "--manifest", "/no/such.json", "--out", "x"], spark) == 2
    assert "is not there" in capsys.readouterr().err


def test_group_lists_hold_every_record(spark, sf):
    bench = spark.read.parquet(f"{sf}/bench.parquet").select("category", "rec_no").toPandas()
    want = {}
    for category, rec_no in bench.itertuples(index=False):
        want.setdefault("None" if category is None else category, []).append(rec_no)
    got = {}
    for r in sorted(catalog.QUERIES["a12_group_lists"](spark, sf).collect(), key=lambda r: (r["category"], r["chunk"])):
        got.setdefault(r["category"], []).extend(map(int, r["v"].split("\x1f")))
    assert got == {k: sorted(v) for k, v in want.items()} and "None" in got


def test_large_groups_are_no_single_row(spark):
    df = spark.createDataFrame([(None if i % 10 else "a", (i * 37) % 500) for i in range(500)], "k string, v long").repartition(5)
    got = {(r["k"], r["chunk"]): r["values"] for r in S.group_lists(df, "k", "v", 7).collect()}
    for k, want in (("None", sorted((i * 37) % 500 for i in range(500) if i % 10)), ("a", sorted((i * 37) % 500 for i in range(0, 500, 10)))):
        assert {c: v for (g, c), v in got.items() if g == k} == {c: want[c * 7 : c * 7 + 7] for c in range(-(-len(want) // 7))}


def test_descriptor_stats_read_every_event(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "value").toPandas()
    g = events.groupby("user_id", dropna=False)["value"]
    want = {"polyphony_rate": g.mean(), "groove_consistency": g.max() - g.min(), "scale_consistency": g.size().astype(float)}
    got = {r["metric"]: r for r in catalog.QUERIES["a08_descriptor_stats"](spark, sf).collect()}
    assert set(got) == set(want) and events["value"].notna().all()
    for metric, v in want.items():
        assert (got[metric]["mean"], got[metric]["std"], got[metric]["n"]) == (pytest.approx(v.mean(), abs=1e-5), pytest.approx(v.std(), abs=1e-5), v.count())


def test_moments_need_vectors_of_one_length(spark):
    rows = [("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [1.0, 2.0, 3.0]), ("b", None), ("b", [])]
    df = spark.createDataFrame(rows, "label string, v array<double>")
    with pytest.raises(ValueError, match="from 2 to 3"):
        N.moments(df, "v", "label")
    r = N.moments(df.where("size(v) <> 3 or v is null"), "v", "label").collect()
    assert [(x["label"], x["n"], x["mean"]) for x in r] == [("a", 2, [2.0, 3.0])]


def test_union_and_predictions_hold_all_tasks(spark, sf):
    bench = spark.read.parquet(f"{sf}/bench.parquet").select("task", "id").toPandas()
    got = catalog.QUERIES["u00_union_of_tasks"](spark, sf).collect()
    names = {t.name for t in tasks.iter_tasks()}
    assert sorted(map(tuple, got)) == sorted({r for r in bench.itertuples(index=False, name=None) if r[0] in names}) and {r["task"] for r in got} >= set(bench["task"].dropna()) & names
    task_of = dict(zip(bench["id"], bench["task"], strict=True))
    read = catalog.QUERIES["s16_predictions"](spark, sf)
    assert len({r["task"] for r in read.collect()}) > 1 and all(task_of[r["id"]] == r["task"] for r in read.collect())
    answered = catalog.answers(spark, sf).where("model_id is not null").select(F.col("model_id").alias("model"), "task", "id", "parsed_answer")
    assert sorted(map(repr, map(tuple, read.collect()))) == sorted(map(repr, map(tuple, answered.collect())))


def test_one_task_of_predictions_is_read_from_its_folder(spark, tmp_path):
    files.write_predictions(spark.createDataFrame([("m", t, "i", "r", "p", 1) for t in ("a", "b")], "model string, task string, id string, raw_output string, parsed_answer string, latency_ms long"), str(tmp_path / "p"))
    one = files.read_predictions(spark, str(tmp_path / "p")).where("task = 'a'")
    assert one.count() == 1 and "PartitionFilters: [isnotnull(task" in one._jdf.queryExecution().toString()


def _midi(notes, resolution=4, running=True):
    """A MIDI file of ``(onset, duration, pitch)``, with a tempo, a controller and, if ``running``, statuses left out."""
    def number(v):
        out = [v & 127]
        while v := v >> 7:
            out.insert(0, v & 127 | 128)
        return bytes(out)

    events = sorted([(o, 1, p) for o, _, p in notes] + [(o + d, 0, p) for o, d, p in notes])
    track, now, last = b"\x00\xff\x51\x03\x07\xa1\x20\x00\xb0\x07\x64\x00\xf0\x02\x01\xf7", 0, None
    for at, on, pitch in events:
        track += number(at - now) + (b"" if running and last == 0x90 else b"\x90") + bytes([pitch, 64 if on else 0])
        now, last = at, 0x90
    track += b"\x00\xff\x2f\x00"
    return b"MThd\x00\x00\x00\x06\x00\x01\x00\x02" + resolution.to_bytes(2, "big") + b"MTrk\x00\x00\x00\x04\x00\xff\x2f\x00" + b"MTrk" + len(track).to_bytes(4, "big") + track


def test_midi_notes(spark):
    notes = [(0, 4, 60), (4, 4, 62), (4, 300, 65), (8, 2, 60)]
    rows = [("a", bytearray(_midi(notes))), ("b", bytearray(_midi(notes[:1], 96, False))), ("c", bytearray(b"no midi")), ("d", None), ("e", bytearray(_midi(notes)[:60])), ("f", bytearray(_midi([])))]
    got = midi.notes(spark.createDataFrame(rows, "path string, content binary")).collect()
    of = lambda f: sorted((r["onset"], r["duration"], r["pitch"]) for r in got if r["file"] == f)
    assert of("a") == notes and of("b") == notes[:1] and {r["file"] for r in got} <= {"a", "b", "e"}
    assert {(r["file"], r["resolution"], r["velocity"], r["channel"], r["track"]) for r in got if r["file"] != "e"} == {("a", 4, 64, 0, 1), ("b", 96, 64, 0, 1)}
    d = {r["file"]: r for r in cli.midi_descriptors(spark.createDataFrame(rows[:2] + rows[5:], "path string, content binary"), "content").collect()}
    assert d["a"]["polyphony_rate"] == pytest.approx(6 / 304) and d["a"]["scale_consistency"] == 1 and d["f"]["scale_consistency"] is None
    # onsets at 0 of each of the first three quarters, and none after
    assert d["a"]["groove_consistency"] == pytest.approx(1.0) and d["b"]["groove_consistency"] is None


def test_generation_end_to_end(spark, tmp_path):
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).parent))
    spark.sparkContext.addPyFile(__file__)
    bank = [(f"prompt_{i:04d}", None, None, f"Write {'x' * i}") for i in range(4)]
    files.write_jsonl(spark.createDataFrame(bank, "id string, source_id string, metadata string, user_prompt string"), str(tmp_path / "bank"))
    assert cli.main(["generation", "run", "--model", "phi4", "--prompts", str(tmp_path / "bank"), "--loader", "test_plans:echo", "--out", str(tmp_path / "gen")], spark) == 0
    made = {r["stem"]: r["text"] for r in files.read_samples(spark, str(tmp_path / "gen")).collect()}
    assert sorted(made) == ["0000", "0001", "0002", "0003"] and all("The answer is" in t and not t.endswith("\n\n") for t in made.values())
    (tmp_path / "ref").mkdir()
    for k in range(3):
        (tmp_path / "ref" / f"{k}.MID").write_bytes(_midi([(i * 2, 3, 60 + (i * k) % 7) for i in range(12)]))
        (tmp_path / f"out{k}.midi").write_bytes(_midi([(i * 2, 3 + i % 2, 60 + (i * (k + 1)) % 8) for i in range(12)]))
    fake = _program(tmp_path / "ly", f'n=$(($(wc -c < "$4") % 3)); if grep -q "answer is 3" "$4"; then echo "broken" >&2; exit 1; fi; cp {tmp_path}/out$n.midi "$3.midi"')
    args = ["metrics", "generation", "--samples", str(tmp_path / "gen"), "--lilypond", fake, "--out", str(tmp_path / "g.json"), "--reference-test-midi", str(tmp_path / "ref"), "--reference-second-midi", str(tmp_path / "ref"), "--reference-cache", str(tmp_path / "cache")]
    assert cli.main(args, spark) == 0 and cli.main(args, spark) == 0
    out = json.loads((tmp_path / "g.json").read_text())
    failed = sum("answer is 3" in t for t in made.values())
    assert out["n_samples"] == 4 and out["n_ok"] == 4 - failed and out["errors"] == ({"broken": failed} if failed else {})
    assert set(out["js_similarity"]) == {"test", "second"} and out["js_similarity"]["test"] == out["js_similarity"]["second"]
    assert out["descriptors"]["scale_consistency"]["n"] == out["n_ok"] and spark.read.parquet(f"{out['files']}/compiled").count() == 4


def test_upgrade_keeps_the_manifest_s_shape(spark, tmp_path, capsys):
    for k in range(3):
        (tmp_path / f"s{k}.ly").write_text(f"score {k}")
    tool = _program(tmp_path / "conv", 'if grep -q "score 1" "$2"; then exit 0; fi; echo "$1"; cat "$2"')
    for name, whole in (("o.json", {"a": {"path": "s0.ly", "x": 1}, "b": {"path": "s1.ly"}, "c": 5}), ("l.json", [{"lyFile": "s2.ly"}, {"path": "none.ly"}])):
        (tmp_path / name).write_text(json.dumps(whole))
        assert cli.main(["corpus", "upgrade", "--source", str(tmp_path / name), "--out-dir", str(tmp_path / f"up_{name}"), "--manifest-out", str(tmp_path / f"new_{name}"), "--convert-ly", tool, "--to", "9.9"], spark) == 0
    got = json.loads((tmp_path / "new_o.json").read_text())
    assert got["c"] == 5 and got["a"]["x"] == 1 and got["b"]["convert_ly_path"] is None
    assert spark.read.text(got["a"]["convert_ly_path"], wholetext=True).first()[0].strip() == "--to=9.9\nscore 0"
    assert [e["convert_ly_path"] is None for e in json.loads((tmp_path / "new_l.json").read_text())] == [False, True]
    assert "empty output" in capsys.readouterr().err


def test_large_pool_stands_beside_few_rows(spark):
    pool = spark.range(300_000).select(F.concat(F.lit("title "), "id").alias("value"))
    few = spark.createDataFrame([("title 5",), ("other",)], "gold string")
    assert [r["n"] for r in other_values(few, pool, "gold").select("gold", F.size("pool").alias("n")).orderBy("gold").collect()] == [300_000, 299_999]
