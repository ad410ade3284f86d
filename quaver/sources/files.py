"""Readers and writers: JSON lines, score folders, manifests, label tables, sample folders."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from quaver.functions import text as T
from quaver.functions.numeric import descriptor_stats
from quaver.operators.joins import resolve_works
from quaver.sources.scratch import scratch

MIN_CHARS = 40
SCORE = """pos bigint, source_id string, source_file string, text string, composer string, title string, style string, key string,
meter string, note_length string, musical_form array<string>, ensemble array<string>, extras map<string,string>"""
PROMPT = "id string, source_id string, metadata struct<composer:string,period:string,musical_form:array<string>,ensemble:array<string>,part:string>, user_prompt string"
PREDICTION = "id string, raw_output string, parsed_answer string, latency_ms bigint"
WORK = "composer string, period string, musical_form string, ensemble string, midi_instruments string"
MANIFEST = "composer string, style string, convert_ly_path string, localPath string, path string, lyFile string"


def there(spark: SparkSession, pattern: str) -> bool:
    """Whether any file or folder matches, on whatever file system the path is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text file, on whatever file system the path is."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


# --- JSON ---------------------------------------------------------------------------------------


def read_jsonl(spark: SparkSession, path: str, schema: str | ty.StructType) -> DataFrame:
    """JSON lines under a given schema; blank lines are skipped, malformed ones raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, order: str | None = None) -> None:
    """JSON lines, absent fields left out; ``order`` keeps rows in order within and over the part files."""
    (df.orderBy(order) if order else df).write.mode("overwrite").json(path)


def write_document(df: DataFrame, path: str) -> None:
    """The only row of ``df`` as one indented JSON document; more than one raises."""
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a document needs exactly one row")
    write_text(df.sparkSession, path, json.dumps(json.loads(rows[0]["j"]), indent=2, ensure_ascii=False))


def read_map(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """``(key, pos, entry)`` of a JSON file that holds an object or an array of entries; entries that are no objects are left out.

    For an array the key is the entry's number.
    """
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("j"))
    kinds = f"struct<{', '.join(f.strip().replace(' ', ':', 1) for f in fields.split(','))}>"
    as_map = whole.where(F.col("j").startswith("{")).select(F.from_json("j", "map<string,string>").alias("m")).select(F.posexplode(F.map_entries("m")).alias("pos", "e")).select(F.col("e.key").alias("key"), "pos", F.col("e.value").alias("v"))
    as_list = whole.where(F.col("j").startswith("[")).select(F.posexplode(F.from_json("j", "array<string>")).alias("pos", "v")).select(F.col("pos").cast("string").alias("key"), "pos", "v")
    return as_map.unionByName(as_list).where(F.ltrim("v").startswith("{")).select("key", "pos", F.from_json("v", kinds).alias("entry"))


# --- text files ---------------------------------------------------------------------------------


def read_texts(spark: SparkSession, path: str, pattern: str = "*.ly", recursive: bool = False) -> DataFrame:
    """``(path, stem, text)`` of whole files; bytes that are no UTF-8 are left out."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=recursive)
    bare = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    name = F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1)
    return raw.select(F.url_decode(F.regexp_replace(bare, r"\+", "%2B")).alias("path"), F.regexp_replace(F.url_decode(name), r"\.[^.]*$", "").alias("stem"), F.translate(F.make_valid_utf8("value"), "�", "").alias("text"))


def documents(texts: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Trimmed texts of at least ``min_chars`` characters."""
    return texts.withColumn("text", T.strip(F.col("text"))).where(F.length("text") >= min_chars)


def reference_documents(spark: SparkSession, path: str) -> DataFrame:
    """``text`` of a reference: JSON lines with ``full_text`` or ``text`` (trimmed), or the scores of a manifest as they are; anything else is empty."""
    if path.endswith(".jsonl"):
        raw = read_jsonl(spark, path, "full_text string, text string")
        return documents(raw.select(F.coalesce(T.null_if_empty(F.col("full_text")), F.col("text")).alias("text")))
    if path.endswith(".json"):
        return manifest_corpus(spark, path).where(F.length(T.strip(F.col("text"))) >= MIN_CHARS).select("text")
    return spark.createDataFrame([], "text string")


def midi_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content)`` of all MIDI files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{mid,midi,MID,MIDI,Mid,Midi}").load(path).select("path", "content")


# --- corpora ------------------------------------------------------------------------------------


def text_list(c: Column) -> Column:
    """A JSON value that is a string or a list of strings, as an array without empty items."""
    listed = F.when(F.ltrim(c).startswith("["), F.from_json(c, "array<string>")).when(c.isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    return F.filter(listed, lambda x: x.isNotNull() & (x != ""))


def enriched(df: DataFrame) -> DataFrame:
    """Texts with title, key, meter and note length read from them."""
    c = F.col("text")
    return df.withColumns({"title": T.extract_title(c), "key": T.extract_key(c), "meter": T.extract_meter(c), "note_length": T.extract_note_length(c)})


def numbered_by(df: DataFrame, column: str, number: str = "pos") -> DataFrame:
    """Rows with the rank, from 0, of their value in ``column``.

    The distinct values alone are sorted, in ranges; the ranges are written before they are counted,
    so that a value can't change its range when a task is run again.
    """
    spark = df.sparkSession
    path = scratch(spark, "ranges")
    df.select(column).distinct().repartitionByRange(F.col(column)).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    before = ranged.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n"))  # a row a range
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(column)) - 1
    ranks = ranged.withColumn("_r", rank).join(F.broadcast(before), "_range").select(column, (F.col("_r") + F.col("_before")).alias(number))
    return df.join(ranks, column)


def _as_scores(df: DataFrame) -> DataFrame:
    fields = [f.strip().split(" ", 1) for f in SCORE.replace("\n", " ").replace("map<string,string>", "map<string;string>").split(",")]
    types = {n: t.replace(";", ",") for n, t in fields}
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in types.items()])


def works_corpus(spark: SparkSession, folder: str, works: str) -> DataFrame:
    """Scores of a folder of ``*.ly`` files with the metadata of their works, found by the longest key that begins the file name."""
    files = read_texts(spark, folder)
    meta = read_map(spark, works, WORK).select(F.col("key").alias("work_key"), "entry.*")
    named = numbered_by(resolve_works(files, meta).join(meta, "work_key", "left"), "path")
    lists = {"musical_form": text_list(F.col("musical_form")), "ensemble": F.when(F.size(text_list(F.col("ensemble"))) > 0, text_list(F.col("ensemble"))).otherwise(text_list(F.col("midi_instruments")))}
    return _as_scores(
        enriched(named).withColumns({
            "source_id": F.col("stem"), "source_file": F.col("path"), "composer": T.null_if_empty(F.col("composer")), "style": T.null_if_empty(F.col("period")),
            "extras": F.when(F.col("part").isNotNull(), F.create_map(F.lit("part"), F.col("part"))).otherwise(F.create_map().cast("map<string,string>")), **lists,
        })
    )




def resolved_path(entry: str, root: str, files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows with ``path``: the converted file if it exists, else the first named file below ``root`` if it exists, else null."""
    e = lambda f: T.null_if_empty(F.col(f"{entry}.{f}"))
    relative = F.coalesce(e("localPath"), e("path"), e("lyFile"))
    there = files.select("path").distinct()
    asked = manifest.withColumn("_c", e("convert_ly_path")).withColumn("_r", F.when(relative.startswith("/"), relative).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), relative)))
    return (
        asked.join(there.select(F.col("path").alias("_cp")), F.col("_c") == F.col("_cp"), "left")
        .join(there.select(F.col("path").alias("_rp")), F.col("_r") == F.col("_rp"), "left")
        .withColumn("path", F.coalesce("_cp", "_rp"))
        .drop("_c", "_r", "_cp", "_rp")
    )


def manifest_corpus(spark: SparkSession, manifest: str, folder: str | None = None) -> DataFrame:
    """Scores listed in a JSON manifest (object or array) with composer and style, whose file exists below ``folder`` (default: the manifest's)."""
    root = folder or str(Path(manifest).parent)
    files = read_texts(spark, root, recursive=True)
    listed = read_map(spark, manifest, MANIFEST)
    composer, style = T.strip(F.coalesce("entry.composer", F.lit(""))), T.strip(F.coalesce("entry.style", F.lit("")))
    named = listed.withColumn("composer", composer).withColumn("style", style).where("composer <> '' and style <> ''")
    found = resolved_path("entry", root, files, named).where("path is not null").join(files.select("path", "text"), "path")
    return _as_scores(enriched(found.withColumnRenamed("key", "source_id")).withColumnRenamed("path", "source_file"))


def clip_corpus(spark: SparkSession, manifest: str, folder: str, max_bars: int = 16) -> DataFrame:
    """Clips of a CSV manifest with a quadrant as label and an existing, non-blank file; texts cut to ``max_bars`` bars."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(manifest)
    label = T.strip(F.coalesce("label", F.lit("")))
    path = F.when(F.col("ly_path").startswith("/"), F.col("ly_path")).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), F.col("ly_path")))
    listed = rows.withColumn("label", label).where(F.col("label").isin("Q1", "Q2", "Q3", "Q4")).withColumn("path", path).withColumn("pos", F.monotonically_increasing_id())
    files = read_texts(spark, folder, recursive=True).withColumn("text", T.first_bars(F.col("text"), max_bars)).where(T.strip(F.col("text")) != "")
    clip, song = T.strip(F.coalesce("clip_id", F.lit(""))), T.strip(F.coalesce("song_id", F.lit("")))
    return _as_scores(
        listed.join(files, "path").withColumns({
            "source_id": F.when(clip != "", clip).otherwise(F.col("stem")), "source_file": F.col("path"),
            "musical_form": F.array().cast("array<string>"), "ensemble": F.array().cast("array<string>"),
            "extras": F.create_map(F.lit("clip_id"), clip, F.lit("song_id"), song, F.lit("label"), F.col("label")),
        })
    )


# --- labels and manifests -----------------------------------------------------------------------


def label_table(spark: SparkSession, path: str) -> DataFrame:
    """``(stem, label)`` of a label CSV under any of its known headings; of repeated stems the last counts."""
    raw = spark.read.option("header", True).csv(path)
    pick = lambda *names: T.strip(F.coalesce(*[T.null_if_empty(F.col(f"`{n}`")) for n in names if n in raw.columns], F.lit("")))
    named = raw.withColumn("_pos", F.monotonically_increasing_id()).select(
        "_pos", F.regexp_replace(pick("ID", "clip_name", "filename", "clip"), r"(?d)\.mid\z", "").alias("stem"), pick("4Q", "label", "emotion").alias("raw")
    )
    return (
        named.where("stem <> '' and raw <> ''")
        .groupBy("stem").agg(F.max_by("raw", "_pos").alias("raw"))
        .select("stem", F.when(F.col("raw").startswith("Q"), F.col("raw")).otherwise(F.concat(F.lit("Q"), "raw")).alias("label"))
    )


def clip_manifest(clips: DataFrame, labels: DataFrame) -> DataFrame:
    """Manifest of converted clips ``(stem, ly_path, n_bars_full, n_bars_truncated)`` that have a label, by stem."""
    return clips.join(labels, "stem").select(F.col("stem").alias("clip_id"), T.song_id(F.col("stem")).alias("song_id"), "label", "ly_path", "n_bars_full", "n_bars_truncated").orderBy("clip_id")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", False).csv(path)


def write_manifest(spark: SparkSession, source: str, done: DataFrame, path: str) -> None:
    """The JSON manifest ``source``, object or array as it is, with ``convert_ly_path`` from ``done(key, out_path)`` in every entry, null where there is none."""
    whole = json.loads(spark.read.text(source, wholetext=True).first()[0])
    made = {r["key"]: r["out_path"] for r in done.select("key", "out_path").collect()}  # a row an entry of the one file
    add = lambda key, entry: {**entry, "convert_ly_path": made.get(str(key))} if isinstance(entry, dict) else entry
    kept = {k: add(k, e) for k, e in whole.items()} if isinstance(whole, dict) else [add(k, e) for k, e in enumerate(whole)]
    write_text(spark, path, json.dumps(kept, indent=2, ensure_ascii=False))


def converted_manifest(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """Manifest entries with ``convert_ly_path`` of their conversion, null where it failed."""
    return manifest.join(done.where("ok").select("key", F.col("out_path").alias("convert_ly_path")), "key", "left")


# --- samples and predictions --------------------------------------------------------------------


def write_samples(samples: DataFrame, path: str) -> None:
    """Model outputs ``(i, raw, final)`` in two folders of text files, ``raw`` and ``final``, a file a sample."""
    for name in ("raw", "final"):
        samples.select(F.format_string("%04d", F.col("i")).alias("sample"), F.col(name).alias("value")).repartition("sample").write.mode("overwrite").partitionBy("sample").text(f"{path}/{name}")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """``(path, stem, text)`` of samples: those of :func:`write_samples`, as they were made final, or else the score files of one folder, not below it."""
    if there(spark, f"{path}/final/sample=*"):
        # one file a sample; the folder names it, and the writer's last line end is no part of it
        raw = spark.read.schema("value string, sample string").text(f"{path}/final", wholetext=True)
        return raw.select(F.concat(F.lit(f"{path}/final/"), "sample").alias("path"), F.col("sample").alias("stem"), F.regexp_replace("value", r"\n\z", "").alias("text"))
    return read_texts(spark, path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Predictions as JSON lines, a folder a model and task."""
    df.write.mode("overwrite").partitionBy("model", "task").json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of all models and tasks below ``path``; a filter on either reads only its folders."""
    return spark.read.schema(f"{PREDICTION}, model string, task string").json(path)


def cached_reference(spark: SparkSession, cache: str | None, build, metrics: list[str]) -> DataFrame | None:
    """Descriptor aggregate from the cache if it is there, else built from ``build()`` (null: nothing to build from) and kept."""
    if cache and there(spark, cache):
        return spark.read.parquet(cache)
    rows = build() if build else None
    if rows is None or not rows.limit(1).count():
        return None
    stats = descriptor_stats(rows, metrics)
    if cache:
        stats.write.mode("overwrite").parquet(cache)
        return spark.read.parquet(cache)
    return stats
