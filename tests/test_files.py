"""Readers and writers on small folders."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quaver.sources import files

BODY = "c4 d4 e4 f4 | g4 a4 b4 c'4 | c1 |\n"
SCORE = '\\header {\n title = "T%s"\n}\n\\key g \\major \\time 3/4\n' + BODY


@pytest.fixture
def corpus(tmp_path):
    d = tmp_path / "ly"
    d.mkdir()
    for stem in ("a_1_x", "a_1_x_viola", "a_1_x_long_cello", "other", "sp ace+plus_é"):
        (d / f"{stem}.ly").write_text(SCORE % stem, encoding="utf-8")
    (d / "bad.ly").write_bytes(b"ab\xffcd |" + BODY.encode())
    (d / "skip.txt").write_text("x")
    return d


def test_works_corpus(spark, corpus, tmp_path):
    works = {"a_1_x": {"composer": "C", "period": "Baroque", "musical_form": "sonata", "ensemble": [], "midi_instruments": ["lute", ""]}, "a_1_x_long": {"composer": "", "musical_form": ["a", "b"], "ensemble": "trio"}, "n": 3}
    (tmp_path / "w.json").write_text(json.dumps(works))
    got = {r["source_id"]: r for r in files.works_corpus(spark, str(corpus), str(tmp_path / "w.json")).collect()}
    assert len(got) == 6 and sorted(r["pos"] for r in got.values()) == list(range(6))
    assert got["a_1_x"]["composer"] == "C" and got["a_1_x"]["extras"] == {} and got["a_1_x"]["ensemble"] == ["lute"]
    assert got["a_1_x_viola"]["extras"] == {"part": "viola"} and got["a_1_x_viola"]["style"] == "Baroque" and got["a_1_x_viola"]["musical_form"] == ["sonata"]
    long = got["a_1_x_long_cello"]
    assert long["composer"] is None and long["musical_form"] == ["a", "b"] and long["ensemble"] == ["trio"] and long["extras"] == {"part": "cello"}
    assert got["other"]["composer"] is None and got["other"]["key"] == "g \\major" and got["other"]["meter"] == "3/4" and got["other"]["title"] == "Tother"
    assert got["bad"]["text"].startswith("abcd |")


def test_exact_key_still_has_a_part(spark):
    from quaver.operators.joins import resolve_works

    stems = spark.createDataFrame([("a_b",), ("a_bc",), ("x",), ("a_",), ("a_b_c_d",)], "stem string")
    keys = spark.createDataFrame([("a",), ("a_b",), ("a_b",)], "work_key string")
    got = {r["stem"]: (r["work_key"], r["part"]) for r in resolve_works(stems, keys).collect()}
    assert got == {"a_b": ("a_b", "b"), "a_bc": ("a", "bc"), "x": (None, None), "a_": ("a", None), "a_b_c_d": ("a_b", "c_d")}


@pytest.mark.parametrize("as_list", [False, True])
def test_manifest_corpus(spark, corpus, tmp_path, as_list):
    entries = {
        "one": {"composer": " C ", "style": "S", "localPath": "a_1_x.ly"}, "two": {"composer": "C", "style": " ", "path": "other.ly"}, "three": {"composer": "C", "style": "S", "path": "missing.ly"},
        "four": {"composer": "C", "style": "S", "convert_ly_path": str(corpus / "other.ly"), "path": "missing.ly"}, "five": {"composer": "C", "style": "S", "localPath": "", "lyFile": "a_1_x_viola.ly"}, "six": "no object",
    }
    (corpus / "m.json").write_text(json.dumps(list(entries.values()) if as_list else entries))
    got = {r["source_id"]: r for r in files.manifest_corpus(spark, str(corpus / "m.json")).collect()}
    assert sorted(got) == (["0", "3", "4"] if as_list else ["five", "four", "one"])
    one = got["0" if as_list else "one"]
    assert one["composer"] == "C" and one["title"] == "Ta_1_x" and one["source_file"].endswith("a_1_x.ly")
    docs = files.reference_documents(spark, str(corpus / "m.json"))
    assert docs.count() == 3
    assert files.reference_documents(spark, str(corpus / "m.txt")).count() == 0


def test_clip_corpus(spark, corpus, tmp_path):
    (corpus / "blank.ly").write_text("  \n")
    rows = ["clip_id,song_id,label,ly_path", "c1,s1,Q1,a_1_x.ly", "c2,s2,Q9,other.ly", "c3,s3,Q2,gone.ly", f",s4, Q3 ,{corpus}/other.ly", "c5,s5,Q4,blank.ly"]
    (tmp_path / "clips.csv").write_text("\n".join(rows) + "\n")
    got = {r["source_id"]: r for r in files.clip_corpus(spark, str(tmp_path / "clips.csv"), str(corpus), 2).collect()}
    assert sorted(got) == ["c1", "other"] and got["c1"]["extras"] == {"clip_id": "c1", "song_id": "s1", "label": "Q1"}
    assert got["other"]["extras"]["label"] == "Q3" and got["c1"]["text"].count("|") == 2


def test_labels_and_manifest(spark, tmp_path):
    (tmp_path / "l.csv").write_text("ID,4Q,annotator\nQ1_a_b_0.mid,1,x\nQ1_a_b_0,2,y\n,3,z\nQ2_c_1,Q2,z\nQ3_d_1,,z\n")
    labels = files.label_table(spark, str(tmp_path / "l.csv"))
    assert {r["stem"]: r["label"] for r in labels.collect()} == {"Q1_a_b_0": "Q2", "Q2_c_1": "Q2"}
    clips = spark.createDataFrame([("Q1_a_b_0", "p", 5, 4), ("Q9_z_1", "q", 1, 1)], "stem string, ly_path string, n_bars_full int, n_bars_truncated int")
    rows = files.clip_manifest(clips, labels).collect()
    assert [(r["clip_id"], r["song_id"], r["label"]) for r in rows] == [("Q1_a_b_0", "a_b", "Q2")]
    files.write_csv(files.clip_manifest(clips, labels), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 1
    done = spark.createDataFrame([("k1", True, "/o.ly"), ("k2", False, None)], "key string, ok boolean, out_path string")
    got = files.converted_manifest(spark.createDataFrame([("k1",), ("k2",), ("k3",)], "key string"), done)
    assert {r["key"]: r["convert_ly_path"] for r in got.collect()} == {"k1": "/o.ly", "k2": None, "k3": None}


def test_jsonl(spark, tmp_path):
    df = spark.createDataFrame([(2, "é 😀", None), (1, "b", ["x"])], "pos int, s string, l array<string>")
    files.write_jsonl(df, str(tmp_path / "j"), "pos")
    back = files.read_jsonl(spark, str(tmp_path / "j"), "pos int, s string, l array<string>")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "b.jsonl").write_text('{"pos": 1}\n\n  \n{"pos": 2}\n')
    assert files.read_jsonl(spark, str(tmp_path / "b.jsonl"), "pos int").where("pos is not null").count() == 2
    (tmp_path / "c.jsonl").write_text('{"pos": \n')
    with pytest.raises(Exception, match="(?i)malformed|fail"):
        files.read_jsonl(spark, str(tmp_path / "c.jsonl"), "pos int").collect()
    files.write_document(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "d" / "x.json"))
    assert json.loads((tmp_path / "d" / "x.json").read_text()) == {"a": 1, "b": None}
    with pytest.raises(ValueError):
        files.write_document(df, str(tmp_path / "y.json"))
    ref = tmp_path / "r.jsonl"
    ref.write_text(json.dumps({"full_text": "", "text": " " + "x" * 40 + "\n"}) + "\n" + json.dumps({"full_text": "y" * 39}) + "\n" + json.dumps({"full_text": "z" * 50, "text": "q"}) + "\n")
    assert sorted(r["text"][0] for r in files.reference_documents(spark, str(ref)).collect()) == ["x", "z"]


def test_samples_predictions_and_cache(spark, tmp_path):
    rows = spark.createDataFrame([(0, "raw 0", "final 0\n"), (1, "raw|1\nx", "f")], "i long, raw string, final string")
    files.write_samples(rows, str(tmp_path / "s"))
    got = spark.read.text(str(tmp_path / "s" / "raw"), wholetext=True)
    assert {(r["sample"], r["value"].strip()) for r in got.collect()} == {(0, "raw 0"), (1, "raw|1\nx")}
    p = spark.createDataFrame([("m", "bar_count", "x", "a", "1", 3)], "model string, task string, id string, raw_output string, parsed_answer string, latency_ms bigint")
    files.write_predictions(p, str(tmp_path / "p"))
    assert files.read_predictions(spark, str(tmp_path / "p")).select(p.columns).collect() == p.collect()
    made = []
    build = lambda: made.append(1) or spark.createDataFrame([(0.5,), (None,), (0.7,)], "d double")
    for _ in range(2):
        r = files.cached_reference(spark, str(tmp_path / "c"), build, ["d"]).first()
        assert (r["metric"], r["mean"], r["n"]) == ("d", pytest.approx(0.6), 2)
    assert made == [1] and files.cached_reference(spark, None, None, ["d"]) is None
    (tmp_path / "midi" / "sub").mkdir(parents=True)
    for n in ("a.mid", "sub/b.MIDI", "c.txt"):
        (tmp_path / "midi" / n).write_bytes(b"x")
    assert files.midi_files(spark, str(tmp_path / "midi")).count() == 2
    assert files.documents(spark.createDataFrame([(" " + "a" * 40,), ("b" * 39,)], "text string")).select(F.length("text")).collect()[0][0] == 40
