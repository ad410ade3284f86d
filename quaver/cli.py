"""Command line: build prompt banks and benchmarks, run models on them, score what they said.

Models are loaded by a hook ``--loader module:function`` that takes a ModelSpec and gives a
Backbone; embeddings by ``--encoder module:function``.  Paths may be any that Spark can read.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver import __version__
from quaver.functions import numeric as N
from quaver.operators import external
from quaver.operators import scores as S
from quaver.operators.descriptors import descriptors
from quaver.operators.joins import align
from quaver.operators.selection import limit_per_task
from quaver.plans import chat, tasks
from quaver.sources import files, midi

METRICS = ["polyphony_rate", "groove_consistency", "scale_consistency"]

#: Command, action and its options: name, type, default; a default of ``...`` means required.
OPTIONS: dict[tuple[str, str], list[tuple]] = {
    ("prompt-bank", "build"): [("scores-dir", str, ...), ("works", str, ...), ("n", int, 200), ("seed", int, 1234), ("bars", int, None), ("out", str, ...)],
    ("generation", "run"): [("model", str, ...), ("regime", str, "zero"), ("prompts", str, ...), ("fewshot-file", str, None), ("max-new-tokens", int, 3000), ("seed-base", int, 1234), ("loader", str, ...), ("out", str, ...)],
    ("understanding", "build"): [("tasks", str, "all"), ("corpus", str, "manifest"), ("manifest", str, ...), ("scores-dir", str, None), ("seed", int, 1234), ("limit", int, None), ("out", str, ...)],
    ("understanding", "run"): [("model", str, ...), ("bench", str, ...), ("tasks", str, "all"), ("limit", int, None), ("max-new-tokens", int, 20), ("max-input-chars", int, None), ("seed", int, 1234), ("loader", str, ...), ("out", str, ...)],
    ("metrics", "understanding"): [("bench", str, ...), ("predictions", str, ...), ("model-id", str, None), ("out", str, ...)],
    ("metrics", "generation"): [
        ("samples", str, ...), ("reference-test", str, None), ("reference-second", str, None), ("reference-test-midi", str, None), ("reference-second-midi", str, None),
        ("reference-cache", str, None), ("encoder", str, None), ("lilypond", str, None), ("out", str, ...), ("files-out", str, None),
    ],
    ("corpus", "upgrade"): [("source", str, ...), ("out-dir", str, ...), ("manifest-out", str, ...), ("convert-ly", str, None), ("to", str, external.UPGRADE_TO)],
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quaver", description="Benchmarks over corpora of textual music.")
    top.add_argument("--version", action="version", version=f"quaver {__version__}")
    commands = top.add_subparsers(dest="command", required=True)
    actions: dict[str, argparse._SubParsersAction] = {}
    for (command, action), options in OPTIONS.items():
        if command not in actions:
            actions[command] = commands.add_parser(command).add_subparsers(dest="action", required=True)
        p = actions[command].add_parser(action)
        for name, kind, default in options:
            p.add_argument(f"--{name}", type=kind, required=default is ..., default=None if default is ... else default)
    return top


def hook(path: str) -> Callable:
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def _fail(text: str) -> int:
    print(text, file=sys.stderr)
    return 2


def _prompt_bank(spark: SparkSession, a: argparse.Namespace) -> int:
    corpus = files.works_corpus(spark, a.scores_dir, a.works)
    files.write_jsonl(chat.prompt_bank(corpus, a.n, a.seed, a.bars), a.out, "id")
    return 0


def _generate(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.regime not in chat.REGIMES:
        return _fail(f"unknown regime {a.regime!r}; known: {', '.join(sorted(chat.REGIMES))}")
    kind = chat.REGIMES[a.regime]
    if issubclass(kind, chat.FewShot) and not a.fewshot_file:
        return _fail("this regime needs --fewshot-file")
    regime = kind.from_file(a.fewshot_file) if a.fewshot_file and issubclass(kind, chat.FewShot) else kind()
    bank = files.read_jsonl(spark, a.prompts, files.PROMPT)
    made = external.write_scores(bank, regime.prompt(), chat.get_spec(a.model), hook(a.loader), a.max_new_tokens, a.seed_base)
    files.write_samples(made, a.out)
    return 0


def _build(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.corpus not in ("manifest", "clips"):
        return _fail("--corpus is manifest or clips")
    if a.corpus == "clips" and not a.scores_dir:
        return _fail("clips need --scores-dir")
    corpus = files.clip_corpus(spark, a.manifest, a.scores_dir) if a.corpus == "clips" else files.manifest_corpus(spark, a.manifest, a.scores_dir)
    flat = corpus.withColumns({k: F.try_element_at("extras", F.lit(k)) for k in ("label", "clip_id", "song_id")})
    files.write_jsonl(tasks.build_all(flat, a.tasks, "clips" if a.corpus == "clips" else "scores", a.limit, a.seed), a.out)
    return 0


def _bench(spark: SparkSession, path: str) -> DataFrame:
    rows = files.read_jsonl(spark, path, tasks.RECORD.replace("\n", " "))
    # the order of records is that of the files' names and of the lines in them
    return rows.withColumn("rec_no", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")))


def _answer(spark: SparkSession, a: argparse.Namespace) -> int:
    names = [t.name for t in tasks.chosen_tasks(a.tasks)]
    some = limit_per_task(_bench(spark, a.bench).where(F.col("task").isin(names)), a.limit)
    files.write_predictions(external.answer_bench(some, chat.get_spec(a.model), hook(a.loader), a.max_input_chars, a.max_new_tokens, a.seed), a.out)
    return 0


def summary(predictions: DataFrame, bench: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per task and overall scores of one model."""
    aligned = align(predictions.drop("task"), bench)
    per_task = tasks.score_all(aligned)
    return per_task, S.overall(per_task)


def _score(spark: SparkSession, a: argparse.Namespace) -> int:
    preds = files.read_predictions(spark, a.predictions)
    if a.model_id:
        preds = preds.where(F.col("model") == a.model_id)
    per_task, overall = summary(preds, _bench(spark, a.bench))
    tasks_ = per_task.agg(F.array_sort(F.collect_list(F.struct("task", "n", "accuracy", "score", "macro_f1", "n_parsed", "missing"))).alias("tasks"))  # a row a task
    one = tasks_.crossJoin(overall.select(F.struct("macro_avg", "weighted_avg").alias("overall")))
    files.write_document(one.withColumn("model", F.lit(a.model_id)), a.out)
    return 0


def midi_descriptors(files_: DataFrame, content: str) -> DataFrame:
    """Descriptors of every MIDI file, nulls for one without notes; a measure is a quarter note, as the metric asks."""
    return files_.select(F.col("path").alias("file")).join(descriptors(midi.notes(files_, "path", content), "resolution"), "file", "left")


def _generation(spark: SparkSession, a: argparse.Namespace) -> int:
    samples = files.read_samples(spark, a.samples)
    results = (a.files_out or f"{a.out}.files").rstrip("/")
    # programs run once; what they made is kept beside the summary
    external.compiled(samples.select("path", "stem", "text"), lilypond=a.lilypond).write.mode("overwrite").parquet(f"{results}/compiled")
    made = spark.read.parquet(f"{results}/compiled")
    midi_descriptors(made.where("ok"), "midi").write.mode("overwrite").parquet(f"{results}/descriptors")
    ours = spark.read.parquet(f"{results}/descriptors")
    stats = N.descriptor_stats(ours, METRICS)
    rate = S.compile_rate(made, "ok").first()
    js, frechet = {}, {}
    for name, folder, cache in (("test", a.reference_test_midi, a.reference_cache), ("second", a.reference_second_midi, None)):
        build = (lambda folder=folder: midi_descriptors(files.midi_files(spark, folder), "content")) if folder else None
        ref = files.cached_reference(spark, cache, build, METRICS) if folder else None
        if ref is not None:
            value = N.js_similarity(stats, ref).first()
            js[name] = value[0] if value else None
    if a.encoder:
        texts = files.documents(samples).select("text")
        for name, path in (("test", a.reference_test), ("second", a.reference_second)):
            theirs = files.reference_documents(spark, path) if path else None
            if theirs is not None and min(texts.limit(2).count(), theirs.limit(2).count()) == 2:
                frechet[name] = N.frechet(*(external.embed(x.withColumn("id", F.lit(0)), "text", hook(a.encoder)) for x in (texts, theirs)))
    reasons = made.where("not ok").groupBy("error").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(20).collect()  # a report of the most frequent
    described = {r["metric"]: {k: v for k, v in r.asDict().items() if k != "metric"} for r in stats.collect()}  # a row a metric
    out = {"n_samples": rate["n"], "n_ok": rate["n_ok"], "compile_rate": rate["compile_rate"], "errors": {r["error"]: r["n"] for r in reasons}, "descriptors": described, "js_similarity": js, "frechet": frechet, "files": results}
    files.write_text(spark, a.out, json.dumps(out, indent=2, ensure_ascii=False))
    return 0


def _upgrade(spark: SparkSession, a: argparse.Namespace) -> int:
    root = a.source.rpartition("/")[0] or "."
    listed = files.read_map(spark, a.source, files.MANIFEST)
    found = files.resolved_path("entry", root, files.read_texts(spark, root, recursive=True), listed.withColumn("entry", F.col("entry").withField("convert_ly_path", F.lit(None).cast("string"))))
    texts = files.read_texts(spark, root, recursive=True).select("path", "text")
    done = external.converted(found.join(texts, "path").select("key", "path", F.col("text").alias("content")), "content", "convert-ly", a.convert_ly, a.to)
    done.write.mode("overwrite").parquet(f"{a.out_dir}/.outcomes")
    kept = spark.read.parquet(f"{a.out_dir}/.outcomes")
    good = kept.where("text is not null")
    good.select("text", F.col("key").alias("entry")).repartition("entry").write.mode("overwrite").partitionBy("entry").text(f"{a.out_dir}/scores")
    files.write_manifest(spark, a.source, good.select("key", F.concat(F.lit(f"{a.out_dir}/scores/entry="), "key").alias("out_path")), a.manifest_out)
    for r in kept.where("error is not null").groupBy("error").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(10).collect():  # the ten most frequent reasons
        print(f"{r['n']:>6}  {r['error']}", file=sys.stderr)
    return 0


HANDLERS = {
    ("prompt-bank", "build"): _prompt_bank, ("generation", "run"): _generate, ("understanding", "build"): _build,
    ("understanding", "run"): _answer, ("metrics", "understanding"): _score, ("metrics", "generation"): _generation, ("corpus", "upgrade"): _upgrade,
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    for name in ("scores_dir", "works", "prompts", "fewshot_file", "manifest", "bench", "samples"):
        given = getattr(a, name, None)
        if given and "://" not in given and not Path(given).exists():
            return _fail(f"--{name.replace('_', '-')}: {given} is not there")
    spark = spark or SparkSession.builder.appName("quaver").getOrCreate()
    return HANDLERS[a.command, a.action](spark, a)


if __name__ == "__main__":
    sys.exit(main())
