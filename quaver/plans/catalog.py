"""All queries over the driver's tables; their SQL counterparts are in :mod:`quaver.plans.oracle`.

Names begin with the operator's id in the survey.  Every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.functions import numeric as N
from quaver.functions import sampling as P
from quaver.functions import text as T
from quaver.operators import errors as E
from quaver.operators import joins as J
from quaver.operators import scores as S
from quaver.operators import selection as R
from quaver.operators.descriptors import descriptors
from quaver.plans import chat, tasks
from quaver.plans.oracle import ORACLE
from quaver.sources import files
from quaver.sources.scratch import scratch, written

__all__ = ["ORACLE", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SEED = 1234


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores with the clip fields of their extras as columns."""
    return _t(spark, d, "scores").withColumns({k: F.try_element_at("extras", F.lit(k)) for k in ("label", "clip_id", "song_id", "part")})


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _on_scores(name: str, columns: Callable[[], dict[str, Column]]) -> None:
    QUERIES[name] = lambda spark, d: scores(spark, d).select("pos", *[c.alias(k) for k, c in columns().items()])


def _on_outputs(name: str, columns: Callable[[], dict[str, Column]]) -> None:
    QUERIES[name] = lambda spark, d: answers(spark, d).select("id", "model_id", *[c.alias(k) for k, c in columns().items()])


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Predictions beside the record they answer."""
    kept = ["id", "task", "template_kind", "gold", "options", "gold_index", "gold_bars", "category", "rec_no"]
    return J.align(_t(spark, d, "predictions"), _t(spark, d, "bench").select(*kept))


def joined(c: Column) -> Column:
    """An array as one string, for comparison."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "\x1f")


# --- text on scores -----------------------------------------------------------------------------

_on_scores("t01_strip_preamble", lambda: dict(v=T.strip_preamble(F.col("text"))))
_on_scores("t02_split_bars", lambda: dict(v=joined(T.split_bars(F.col("text")))))
_on_scores("t03_count_bars", lambda: dict(v=T.count_bars(F.col("text"))))
_on_scores("t04_mask_positions", lambda: dict(v=T.mask_positions(F.col("text"))))
_on_scores("t05_separators", lambda: dict(n=F.size(T.between_separators(F.col("text"))) - 1, third=F.when(F.size(T.between_separators(F.col("text"))) > 3, T.separator_position(T.between_separators(F.col("text")), F.lit(3)))))
_on_scores("t05b_bar_at", lambda: dict(v=T.bar_at(F.col("text"), F.lit(400))))
_on_scores("t06_first_bars", lambda: dict(v=T.first_bars(F.col("text"), 16)))
_on_scores("t07_key", lambda: dict(v=T.extract_key(F.col("text"))))
_on_scores("t08_meter", lambda: dict(meter_found=T.extract_meter(F.col("text")), length_found=T.extract_note_length(F.col("text"))))
_on_scores("t09_mask_field", lambda: dict(no_key=T.mask_field(F.col("text"), "key"), no_meter=T.mask_field(F.col("text"), "meter")))
_on_scores("t10_title", lambda: dict(v=T.extract_title(F.col("text"))))
_on_scores("t11_blank", lambda: dict(no_composer=T.blank_composer(F.col("text")), no_title=T.blank_title(F.col("text"))))
_on_scores("t12_work_id", lambda: dict(v=T.work_id(F.col("source_id")), every_part=T.work_id_all_parts(F.col("source_id"))))
_on_scores("t13_song_id", lambda: dict(v=T.song_id(F.col("source_id"))))
_on_scores("t18_ensure_headers", lambda: dict(v=T.ensure_headers(F.col("text"))))
_on_scores("t19_ensure_version", lambda: dict(v=T.ensure_version(F.col("text"))))
_on_scores("t20_cut_at", lambda: dict(v=T.cut_at(F.col("text"), "|")))
_on_scores("t21_truncated", lambda: dict(v=T.truncated(F.col("text"), 500)))
_on_scores("t24_metadata_block", lambda: dict(v=T.metadata_block(F.col("composer"), F.col("style"), F.col("musical_form"), F.col("ensemble"), F.col("part"))))
_on_scores("t25_user_prompt", lambda: dict(v=T.user_prompt(F.col("composer"), F.col("style"), F.col("musical_form"), F.col("ensemble"), F.col("part")), short=T.user_prompt(F.col("composer"), F.col("style"), F.col("musical_form"), F.col("ensemble"), F.col("part"), bars=4)))
_on_scores("t28_numbered", lambda: dict(v=T.numbered(F.slice(T.split_bars(F.col("text")), 1, 4))))
_on_scores("t29_record_id", lambda: dict(v=T.record_id(F.lit("bar_count"), F.col("pos"))))
_on_scores("t30_normal_key", lambda: dict(v=T.normal_key(F.col("text"))))
_on_scores("p04_bar_eligibility", lambda: dict(one=T.count_bars(F.col("text")) >= 1, four=T.count_bars(F.col("text")) >= 4, eight=T.count_bars(F.col("text")) >= 8))
_on_scores("p02_prompt_metadata", lambda: dict(period=F.col("style"), part=F.coalesce(T.null_if_empty(F.col("part")), F.lit("full"))))
_on_scores("p03_fallback_list", lambda: dict(v=joined(F.when(F.size("ensemble") > 0, F.col("ensemble")).otherwise(F.col("musical_form")))))
_on_scores("p01_without_empty", lambda: dict(v=joined(F.filter("musical_form", lambda x: x.isNotNull() & (x != "")))))

# --- text on model output -----------------------------------------------------------------------

_on_outputs("t14_parse_answer", lambda: dict(v=T.parse_answer(F.col("raw_output"), F.col("task"), F.col("template_kind"))))
_on_outputs("t15_digit_sequence", lambda: dict(v=T.digit_sequence(F.col("raw_output"))))
_on_outputs("t16_bar_list", lambda: dict(v=joined(T.bar_list(F.col("raw_output")))))
_on_outputs("t17_strip_fence", lambda: dict(v=T.strip_fence(F.col("raw_output"))))
_on_outputs("n01_sequencing_score", lambda: dict(v=F.round(N.sequencing_score(F.col("raw_output"), F.coalesce("gold", F.lit(""))), 6)))
_on_outputs("n02_set_f1", lambda: dict(v=F.round(N.set_f1(T.bar_list(F.col("raw_output")), F.transform(F.coalesce("gold_bars", F.array().cast("array<int>")), lambda b: b.cast("string"))), 6)))
_on_outputs("n08_abs_diff", lambda: dict(v=N.abs_diff(F.col("parsed_answer"), F.col("gold")).cast("bigint")))


@query
def t22_choice_prompt(spark: SparkSession, d: str) -> DataFrame:
    b = _t(spark, d, "bench").where("template_kind = 'multiple_choice' and size(options) = 4")
    return b.select("rec_no", T.choice_prompt(F.col("input_content"), F.col("task_instruction"), F.col("options")).alias("v"))


@query
def t23_structured_prompt(spark: SparkSession, d: str) -> DataFrame:
    b = _t(spark, d, "bench").where("template_kind = 'structured'")
    return b.select("rec_no", T.structured_prompt(F.col("input_content"), F.col("task_instruction"), F.coalesce("structured_output_template", F.lit(""))).alias("v"))


@query
def t26_bench_chat(spark: SparkSession, d: str) -> DataFrame:
    """Prompts of the benchmark as a conversation."""
    return _t(spark, d, "bench").select("rec_no", chat.bench_prompt().alias("v"))


@query
def t27_regime_prompts(spark: SparkSession, d: str) -> DataFrame:
    """A bank of prompts put to a model without and with demonstrations."""
    bank = chat.prompt_bank(_t(spark, d, "scores"), 200, SEED)
    return bank.select("id", chat.Regime().prompt().alias("zero"), chat.FewShot(demonstrations="c'4 d'4 e'4 f'4 |\n").prompt().alias("few"))


# --- filters ------------------------------------------------------------------------------------


@query
def p05_any_metadata(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).where(F.coalesce(*[T.null_if_empty(F.col(c)) for c in T.FIELDS]).isNotNull()).select("pos")


@query
def p06_has_names(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).select("pos", *[(F.coalesce(F.col(c), F.lit("")) != "").alias(f"has_{c}") for c in ("title", "composer", "style")])


@query
def p08_chosen_tasks(spark: SparkSession, d: str) -> DataFrame:
    names = [t.name for t in tasks.chosen_tasks("bar_count,genre_recognition,no_such_task")]
    return _t(spark, d, "bench").where(F.col("task").isin(names)).groupBy("task").agg(F.count("*").alias("n"))


@query
def p11_quadrant_label(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).where(F.col("label").isin(*S.QUADRANTS)).select("pos", "label")


@query
def p12_valid_values(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    return e.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("event_type").agg(F.count("*").alias("n"))


# --- joins --------------------------------------------------------------------------------------


@query
def j01_align(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).select("id", "model_id", "parsed_answer", "gold", "gold_index", "rec_no")


def _stems(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    files_ = _t(spark, d, "scores").select(F.col("source_id").alias("stem")).distinct()
    works = files_.select(F.regexp_extract("stem", "^([a-z]+_[0-9]+_[a-z]+)", 1).alias("work_key")).where("work_key <> ''").distinct()
    return files_, works


@query
def j02_longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    return J.resolve_works(*_stems(spark, d)).select("stem", "work_key")


@query
def j03_part_of_stem(spark: SparkSession, d: str) -> DataFrame:
    return J.resolve_works(*_stems(spark, d)).select("stem", "part")


@query
def j04_existing(spark: SparkSession, d: str) -> DataFrame:
    """Clips whose score is there."""
    there = _t(spark, d, "scores").groupBy(F.col("source_file").alias("ly_path")).agg(F.min("pos").alias("pos"))
    return J.existing(_t(spark, d, "emotion_clips").select("ly_path", "clip_id"), there, "ly_path").select("clip_id", "pos")


@query
def j05_labelled(spark: SparkSession, d: str) -> DataFrame:
    clips = scores(spark, d).where("clip_id is not null").select(F.col("clip_id").alias("stem"), "pos")
    labels = _t(spark, d, "emotion_clips").select(F.col("clip_id").alias("stem"), "label").distinct()
    return J.labelled(clips, labels).select("stem", "pos", "label")


@query
def j06_tasks_with_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Every task with its number of predictions, missing ones included."""
    names = spark.createDataFrame([(t.name,) for t in tasks.iter_tasks()], "task string")
    n = answers(spark, d).groupBy("task").agg(F.count("*").alias("k"))
    return names.join(n, "task", "left").select("task", F.coalesce("k", F.lit(0)).alias("n"), F.col("k").isNull().alias("missing"))


@query
def j07_other_values(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "scores").where("style is not null and style <> ''")
    return J.other_values(s.select("pos", "style"), s.select(F.col("style").alias("value")).distinct(), "style").select("pos", F.size("pool").alias("n"), F.get("pool", F.lit(0)).alias("first"))


@query
def j08_with_split(spark: SparkSession, d: str) -> DataFrame:
    works = _t(spark, d, "scores").select("pos", T.work_id(F.col("source_id")).alias("work"))
    return J.with_split(works, _t(spark, d, "split_files").select("pos", "split").distinct(), "pos").groupBy("split").agg(F.countDistinct("work").alias("works"), F.count("*").alias("files"))


@query
def j10_metric_join(spark: SparkSession, d: str) -> DataFrame:
    m, r = _descriptors(spark, d, 0), _descriptors(spark, d, 1)
    return m.select("metric", F.round("mean", 6).alias("mean_a")).join(r.select("metric", F.round("mean", 6).alias("mean_b")), "metric")


# --- aggregates ---------------------------------------------------------------------------------


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(c), 6).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes])


def _score(name: str) -> Query:
    def f(spark: SparkSession, d: str) -> DataFrame:
        a = answers(spark, d).where(F.col("task") == name)
        return _rounded(tasks.get_task(name).score(a, "model_id"))

    return f


@query
def a01_accuracy(spark: SparkSession, d: str) -> DataFrame:
    a = answers(spark, d).where("template_kind = 'multiple_choice'")
    return _rounded(a.groupBy("model_id", "task").agg(S.accuracy(F.col("parsed_answer"), F.col("gold_index")).alias("accuracy")))


@query
def a02_parsed(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).groupBy("task").agg(S.parsed_choices(F.col("parsed_answer")).alias("choices"), S.parsed_numbers(F.col("parsed_answer")).alias("numbers"))


QUERIES["a03_bar_count_stats"] = _score("bar_count")
QUERIES["a04_sequencing"] = _score("bar_sequencing")
QUERIES["a05_macro_f1"] = _score("error_detection")


@query
def a06_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Quadrants of clips against those of the scores they name."""
    gold = _t(spark, d, "emotion_clips").select("clip_id", F.col("label").alias("gold")).distinct()
    return S.confusion(scores(spark, d).where("clip_id is not null").join(gold, "clip_id"), F.col("label"), F.col("gold"))


@query
def a07_compile_rate(spark: SparkSession, d: str) -> DataFrame:
    """Share of fenced answers, as a stand-in for compiled files."""
    return _rounded(S.compile_rate(_t(spark, d, "predictions").withColumn("ok", F.col("raw_output").contains("```")), "ok", "model_id"))


METRICS = ["polyphony_rate", "groove_consistency", "scale_consistency"]


def _rows(spark: SparkSession, d: str, side: int | None) -> DataFrame:
    """Three descriptor columns per user, of all events, or of even or odd ids where two sets are compared."""
    e = _t(spark, d, "events")
    if side is not None:
        e = e.where(F.col("event_id") % 2 == side)
    return e.groupBy("user_id").agg(F.avg("value").alias("polyphony_rate"), (F.max("value") - F.min("value")).alias("groove_consistency"), F.count("*").cast("double").alias("scale_consistency"))


def _descriptors(spark: SparkSession, d: str, side: int | None) -> DataFrame:
    return N.descriptor_stats(_rows(spark, d, side), METRICS)


@query
def a08_descriptor_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics over all events."""
    return _rounded(_descriptors(spark, d, None))


@query
def a09_overall(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.overall(tasks.score_all(answers(spark, d), "model_id"), "model_id"))


@query
def a10_split_stats(spark: SparkSession, d: str) -> DataFrame:
    return S.split_stats(R.split_by_work(_t(spark, d, "scores"), seed=SEED), "split", "work", "composer")


@query
def a11_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return J.first_seen(_t(spark, d, "scores"), "composer", "pos")


@query
def a12_group_lists(spark: SparkSession, d: str) -> DataFrame:
    """Records of every category, those of none as ``None``."""
    return S.group_lists(_t(spark, d, "bench"), "category", "rec_no").select("category", "chunk", joined(F.col("values")).alias("v"))


@query
def a13_per_task(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "bench").groupBy("task").agg(F.count("*").alias("n"))


@query
def a14_per_quadrant(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "emotion_clips").groupBy("label").agg(F.countDistinct("clip_id").alias("clips"))


@query
def a15_top_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.top_counts(_t(spark, d, "scores").where("style is not null"), "style", 5)


@query
def a16_mean_and_covariance(spark: SparkSession, d: str) -> DataFrame:
    m = N.moments(_t(spark, d, "embeddings"), "embedding", "label")
    trace = F.aggregate(F.sequence(F.lit(0), F.size("mean") - 1), F.lit(0.0), lambda a, i: a + F.get("cov", i * (F.size("mean") + 1)))
    return m.select("label", "n", F.round(F.get("mean", F.lit(0)), 5).alias("mean_0"), F.round(trace, 4).alias("trace"))


@query
def a17_counters(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "predictions").groupBy("model_id").agg(F.count_if(F.coalesce("parsed_answer", F.lit("")) != "").alias("n_ok"), F.count("*").alias("n"))


# --- selections ---------------------------------------------------------------------------------


@query
def r01_seeded_order(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "scores").select("pos", P.number_of(P.key(SEED, "bar_count", F.col("pos"))).alias("v"))


@query
def r02_sample(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "scores").select("pos", "source_id")
    return P.sample(s, 100, P.key(SEED, "r02", F.col("pos")), "pos").select("i", "pos")


@query
def r03_distractors(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "scores").where("style is not null and style <> ''").select("pos", "style")
    p = J.other_values(s, s.select(F.col("style").alias("value")).distinct(), "style")
    return p.select("pos", joined(P.distractors(F.col("pool"), F.col("style"), P.key(SEED, F.col("pos")))).alias("v"))


@query
def r04_stratified(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d).where(F.col("label").isin(*S.QUADRANTS)).select("pos", "label")
    return P.per_group(s, "label", 30, P.key(SEED, F.col("pos")), "pos").select("label", "r", "pos")


@query
def r05_shuffled_options(spark: SparkSession, d: str) -> DataFrame:
    b = _t(spark, d, "bench").where("size(options) = 4")
    mixed = P.shuffled(F.col("options"), P.key(SEED, F.col("rec_no")))
    return b.select("rec_no", joined(mixed).alias("v"), (F.array_position(mixed, F.element_at("options", F.col("gold_index") + 1)) - 1).alias("gold_at"))


@query
def r06_permutation(spark: SparkSession, d: str) -> DataFrame:
    p = P.permutation(4, P.key(SEED, F.col("pos")))
    inverse = F.transform(F.array(*[F.lit(j) for j in range(4)]), lambda j: (F.array_position(p, j) - 1).cast("string"))
    return _t(spark, d, "scores").select("pos", F.array_join(F.transform(p, lambda x: x.cast("string")), "").alias("shown"), F.array_join(inverse, "").alias("gold"))


@query
def r07_prompt_draw(spark: SparkSession, d: str) -> DataFrame:
    return R.prompt_draw(_t(spark, d, "scores").select("pos", "source_id"), 200, SEED).select("i", "pos")


@query
def r08_split_by_work(spark: SparkSession, d: str) -> DataFrame:
    return R.split_by_work(_t(spark, d, "scores").select("pos", "source_id"), seed=SEED).select("pos", "work", "split")


@query
def r09_limit_per_task(spark: SparkSession, d: str) -> DataFrame:
    return R.limit_per_task(_t(spark, d, "bench").select("task", "rec_no"), 20)


@query
def r11_category_fill(spark: SparkSession, d: str) -> DataFrame:
    """Which score gets which error: the pool in seeded order, filled category by category."""
    per = max(1, 220 // len(E.CATEGORIES))
    four = scores(spark, d).where(T.count_bars(F.col("text")) >= 4).select("pos", "text")
    pool = P.sample(four, 8 * per * len(E.CATEGORIES), P.key(SEED, "r11", F.col("pos")), "pos").withColumn("rn", F.col("i") + 1)
    pool = written(pool, "pool")
    flagged = pool.select("rn", "pos", *[E.applicable(F.col("text"), c).alias(f"ok_{c}") for c in E.CATEGORIES])
    return R.fill_categories(flagged, 220).join(flagged.select("rn", "pos"), "rn").select("rn", "pos", "category")


@query
def r12_rotated_field(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "scores").select("pos", R.rotated_field(F.col("pos")).alias("f"))
    return s.select("pos", F.col("f.field").alias("field"), F.col("f.value").alias("value"))


@query
def r13_bar_slices(spark: SparkSession, d: str) -> DataFrame:
    bars = T.split_bars(F.col("text"))
    return scores(spark, d).select("pos", joined(F.slice(bars, 1, 4)).alias("first"), joined(F.slice(bars, F.lit(6), F.size(bars))).alias("later"))


@query
def r14_sorted_files(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "bench").select("source_file").distinct().orderBy("source_file")


@query
def r15_limit(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "emotion_clips").select("clip_id", "ly_path").distinct().orderBy("clip_id", "ly_path").limit(50)


@query
def u00_union_of_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Set operations of the reference: all tasks' concatenated record lists, and the union without repeats."""
    b = _t(spark, d, "bench").select("task", "id")
    lists = [b.where(F.col("task") == t.name) for t in tasks.iter_tasks()]
    return reduce(DataFrame.unionByName, lists).distinct()


# --- errors -------------------------------------------------------------------------------------


def _injected(category: str) -> Query:
    def f(spark: SparkSession, d: str) -> DataFrame:
        s = scores(spark, d).select("pos", E.inject(F.col("text"), category, P.key(SEED, F.col("pos"))).alias("h"))
        return s.where("h is not null").select("pos", F.col("h.text").alias("v"), F.get("h.error_bars", F.lit(0)).alias("bar"))

    return f


for _number, _category in enumerate(E.CATEGORIES, 1):
    QUERIES[f"e0{_number}_{_category}"] = _injected(_category)


# --- distances ----------------------------------------------------------------------------------


@query
def n03_js_divergence(spark: SparkSession, d: str) -> DataFrame:
    a = _descriptors(spark, d, 0).select("metric", F.col("mean").alias("mu1"), F.col("std").alias("sd1"))
    b = _descriptors(spark, d, 1).select("metric", F.col("mean").alias("mu2"), F.col("std").alias("sd2"))
    return _rounded(N.js_divergence(a.join(b, "metric")))


@query
def n04_js_similarity(spark: SparkSession, d: str) -> DataFrame:
    return N.js_similarity(_descriptors(spark, d, 0), _descriptors(spark, d, 1)).select(F.round("js_similarity", 4).alias("js_similarity"))


@query
def n07_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """Descriptors of the notes that the events stand for, a file a user."""
    e = _t(spark, d, "events").where("user_id is not null and value is not null")
    notes = e.select(F.col("user_id").cast("string").alias("file"), F.expr("event_id div 4").alias("onset"), (F.ceil("value") % 64 + 1).alias("duration"), (F.col("event_id") % 48 + 36).cast("int").alias("pitch"))
    return _rounded(descriptors(notes, 96))


@query
def n05_frechet(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings")
    v = N.frechet(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"))
    return spark.createDataFrame([(round(v, 6),)], "frechet double")


# --- tasks --------------------------------------------------------------------------------------


def _built(name: str) -> Query:
    def f(spark: SparkSession, d: str) -> DataFrame:
        task = tasks.get_task(name)
        r = task.build(scores(spark, d), task.default_n, SEED)
        return r.select(*[joined(F.col(c)).alias(c) if c in ("options", "shuffled_indices", "gold_bars") else F.col(c) for c in tasks.RECORD_COLUMNS])

    return f


for _task in tasks.iter_tasks():
    QUERIES[f"build_{_task.name}"] = _built(_task.name)


@query
def bar_count_scored(spark: SparkSession, d: str) -> DataFrame:
    """The bar-count benchmark from end to end: built from the scores, answered by a made-up model, scored."""
    task = tasks.get_task("bar_count")
    bench = task.build(scores(spark, d), task.default_n, SEED)
    said = F.concat(F.lit("The answer is "), (F.col("gold").cast("int") + P.number_of(P.key(SEED, F.col("id"))) % 3).cast("string"), F.lit("."))
    answered = bench.select("id", "gold", T.parse_answer(said, F.lit("bar_count"), F.lit(T.STRUCTURED)).alias("parsed_answer"))
    return _rounded(task.score(answered))


@query
def score_all_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Every task's scores for every model."""
    return _rounded(tasks.score_all(answers(spark, d), "model_id"))


@query
def s01_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark records written as JSON lines and read again."""
    path = scratch(spark, "jsonl")
    files.write_jsonl(_t(spark, d, "bench"), path)
    schema = ", ".join(f"{c} {k}" for c, k in _t(spark, d, "bench").dtypes)
    return files.read_jsonl(spark, path, schema).select("rec_no", "id", "input_content", "gold", joined(F.col("options")).alias("options"), "gold_index")


@query
def s10_reference_documents(spark: SparkSession, d: str) -> DataFrame:
    """Texts of at least 40 characters, trimmed."""
    return files.documents(_t(spark, d, "documents").select("doc_id", "text"))


@query
def s13_prompt_bank(spark: SparkSession, d: str) -> DataFrame:
    """A prompt bank written as JSON lines and read again."""
    path = scratch(spark, "bank")
    files.write_jsonl(chat.prompt_bank(_t(spark, d, "scores"), 200, SEED), path)
    return files.read_jsonl(spark, path, files.PROMPT).select("id", "source_id", "user_prompt", F.col("metadata.part").alias("part"))


@query
def s15_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples written in a file each and read again."""
    path = scratch(spark, "samples")
    files.write_samples(_t(spark, d, "heldout_items").select(F.col("item_id").alias("i"), F.col("text").alias("raw"), F.col("text").alias("final")), path)
    return files.read_samples(spark, path).select("stem", "text")


@query
def s16_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Predictions written in a folder a model and task, and those of all tasks read again."""
    path = scratch(spark, "predictions")
    rows = answers(spark, d).select(F.col("model_id").alias("model"), "task", "id", "raw_output", "parsed_answer", "latency_ms").where("model is not null")
    files.write_predictions(rows, path)
    return files.read_predictions(spark, path).select("model", "task", "id", "parsed_answer")


@query
def s19_clip_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of labelled clips."""
    c = _t(spark, d, "emotion_clips").groupBy("clip_id").agg(*[F.min(x).alias(x) for x in ("label", "ly_path", "n_bars_full", "n_bars_truncated")])
    labels = c.select(F.col("clip_id").alias("stem"), "label").where("label is not null")
    return files.clip_manifest(c.select(F.col("clip_id").alias("stem"), "ly_path", "n_bars_full", "n_bars_truncated"), labels)
