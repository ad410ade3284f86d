"""The ten benchmark tasks: building records from scores, and scoring predictions.

A task is a pair of plans: ``build(scores, n, seed)`` gives records, ``score(aligned, *by)`` gives
``n``, ``n_parsed`` and the task's measures.  Scores come with ``source_id, source_file, text,
composer, title, style, key, meter, note_length, label``; nothing else is read.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.functions import text as T
from quaver.functions.numeric import share_of
from quaver.functions.sampling import distractors, key, per_group, permutation, sample, shuffled
from quaver.operators import scores as S
from quaver.operators.errors import CATEGORIES, applicable, inject
from quaver.operators.joins import other_values
from quaver.operators.selection import fill_categories, rotated_field
from quaver.sources.scratch import written

RECORD = """task string, id string, source_file string, input_content string, task_instruction string, prompt string,
template_kind string, gold string, options array<string>, gold_index int, structured_output_template string,
shuffled_indices array<int>, question_field string, clip_id string, song_id string, gold_bars array<int>, category string"""
RECORD_COLUMNS = [c.strip().split(" ")[0] for c in RECORD.replace("\n", " ").split(",")]

# What each task asks for, and the form of structured answers.
INSTRUCTIONS = {
    "bar_count": "Count the number of bars in the LilyPond score above. Output a single integer.",
    "bar_sequencing": "The bars below are shuffled and labelled with indices 0..3. Output the indices in the correct sequential order as a single digit string (for example, 0312).",
    "composer_recognition": "Select the most likely composer of the score from the four options.",
    "emotion_recognition": "Select the most likely Russell valence-arousal quadrant for the score from the four options. Q1 = high valence + high arousal, "
    "Q2 = low valence + high arousal, Q3 = low valence + low arousal, Q4 = high valence + low arousal.",
    "error_detection": "The score below may contain one or more erroneous bars (invalid metadata, garbage content, wrong bar duration, "
    "implausible melodic leap, or accidental outside the declared key). Identify the 1-indexed bar numbers where the errors occur. "
    "Output the numbers as a space-separated list (e.g. '3 7 12'). If no errors are present, output 'none'.",
    "genre_recognition": "Select the most likely genre of the score from the four options.",
    "metadata_prediction": "The score has one metadata field masked. Predict the value of that field from the four options based on the musical content.",
    "metadata_qa": "Select the value of the queried metadata field from the four options. The relevant field is given in the question.",
    "music_captioning": "Select the most likely title for the score from the four options.",
    "next_bar_prediction": "Given the opening bars of the score, select the option that is most likely to be the next bar.",
}
TEMPLATES = {
    "bar_count": "<integer>",
    "bar_sequencing": "<four-digit index permutation, no separator>",
    "error_detection": "<space-separated integer bar numbers, or 'none'>",
}

REGISTRY: dict[str, type[Task]] = {}


class Task(ABC):
    """One task; subclasses set ``name`` and ``kind``.  What is asked comes from ``INSTRUCTIONS``, or ``instruction`` if a subclass sets it."""

    name = ""
    kind = T.MULTIPLE_CHOICE
    template = ""
    default_n = 60
    corpus_kind = "scores"

    @property
    def instruction(self) -> str:
        return INSTRUCTIONS[self.name]

    @property
    def template(self) -> str:
        return TEMPLATES[self.name]

    @abstractmethod
    def build(self, scores: DataFrame, n: int, seed: int) -> DataFrame: ...

    @abstractmethod
    def score(self, aligned: DataFrame, *by: str) -> DataFrame: ...

    def records(self, df: DataFrame, content: Column, instruction: Column | None = None, **more: Column) -> DataFrame:
        """Rows with ``i`` (and ``options``, ``gold`` for choices) to the superset of record columns."""
        instruction = F.lit(self.instruction) if instruction is None else instruction
        choice = self.kind == T.MULTIPLE_CHOICE
        cols: dict[str, Column] = {
            "task": F.lit(self.name),
            "id": T.record_id(F.lit(self.name), F.col("i")),
            "source_file": F.col("source_file"),
            "input_content": content,
            "task_instruction": instruction,
            "template_kind": F.lit(self.kind),
            "gold": F.col("gold") if "gold" in df.columns else F.lit(None),
            "options": F.col("options") if choice else F.lit(None),
            "gold_index": (F.array_position("options", F.col("gold")) - 1) if choice else F.lit(None),
            "structured_output_template": F.lit(None) if choice else F.lit(self.template),
        } | more
        cols["prompt"] = T.choice_prompt(content, instruction, F.col("options")) if choice else T.structured_prompt(content, instruction, F.lit(self.template))
        types = {c.strip().split(" ")[0]: c.strip().split(" ", 1)[1] for c in RECORD.replace("\n", " ").split(",")}
        return df.select(*[cols.get(c, F.lit(None)).cast(types[c]).alias(c) for c in RECORD_COLUMNS])


class Choice(Task):
    """Tasks with four options; the answer is compared with the number of the right one."""

    def score(self, aligned: DataFrame, *by: str) -> DataFrame:
        return aligned.groupBy(*by).agg(
            F.count("*").alias("n"), S.accuracy(F.col("parsed_answer"), F.col("gold_index")).alias("accuracy"), S.parsed_choices(F.col("parsed_answer")).alias("n_parsed")
        )

    def choices(self, df: DataFrame, seed: int) -> DataFrame:
        """Rows with ``gold`` and ``pool`` to rows with four shuffled ``options``; rows with too small a pool are dropped."""
        k = key(seed, self.name, F.col("source_id"))
        three = distractors(F.col("pool"), F.col("gold"), F.concat(k, F.lit(":d")))
        return (
            df.withColumn("_three", three).where(F.size("_three") == 3)
            .withColumn("options", shuffled(F.concat(F.array("gold"), "_three"), F.concat(k, F.lit(":o"))))
            .drop("_three", "pool")
        )


def register(cls: type[Task]) -> type[Task]:
    """Adds a task under its name; a missing name or one already taken raises."""
    if not cls.name:
        raise ValueError(f"{cls.__name__} has no name")
    if cls.name in REGISTRY:
        raise KeyError(f"task {cls.name!r} is registered already")
    REGISTRY[cls.name] = cls
    return cls


def get_task(name: str) -> Task:
    return REGISTRY[name]()


def iter_tasks() -> Iterator[Task]:
    """All tasks, by name."""
    return (REGISTRY[name]() for name in sorted(REGISTRY))


def chosen_tasks(names: str, corpus_kind: str | None = None) -> list[Task]:
    """Tasks of a comma-separated list or ``all``, of one kind of corpus if given."""
    wanted = None if names == "all" else {x.strip() for x in names.split(",") if x.strip()}
    return [t for t in iter_tasks() if (wanted is None or t.name in wanted) and corpus_kind in (None, t.corpus_kind)]


def _has(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def _draw(df: DataFrame, task: Task, n: int, seed: int) -> DataFrame:
    return sample(df, n, key(seed, task.name, F.col("source_id"), F.col("pos")), "source_id", "pos")


@register
class BarCount(Task):
    name, kind, default_n = "bar_count", T.STRUCTURED, 100

    def build(self, scores: DataFrame, n: int, seed: int) -> DataFrame:
        counted = scores.withColumn("bars", T.count_bars(F.col("text"))).where("bars >= 1")
        return self.records(_draw(counted, self, n, seed), F.col("text"), gold=F.col("bars").cast("string"))

    def score(self, aligned: DataFrame, *by: str) -> DataFrame:
        stats = S.bar_count_stats(aligned, "parsed_answer", "gold", *by).drop("n", "n_parsed")
        exact = aligned.groupBy(*by).agg(
            F.count("*").alias("n"), S.accuracy(F.col("parsed_answer"), F.col("gold")).alias("accuracy"), S.parsed_numbers(F.col("parsed_answer")).alias("n_parsed")
        )
        return exact.join(stats, list(by)) if by else exact.crossJoin(F.broadcast(stats))


@register
class BarSequencing(Task):
    name, kind, default_n = "bar_sequencing", T.STRUCTURED, 119

    def build(self, scores: DataFrame, n: int, seed: int) -> DataFrame:
        four = scores.withColumn("bars", T.split_bars(F.col("text"))).where(F.size("bars") >= 4)
        drawn = _draw(four, self, n, seed).withColumn("order", permutation(4, key(seed, self.name, F.col("source_id"), F.lit("p"))))
        shown = T.numbered(F.transform("order", lambda k: F.get("bars", k)))
        gold = F.array_join(F.transform(F.array(*[F.lit(j) for j in range(4)]), lambda j: (F.array_position("order", j) - 1).cast("string")), "")
        return self.records(drawn, shown, gold=gold, shuffled_indices=F.col("order"))

    def score(self, aligned: DataFrame, *by: str) -> DataFrame:
        return S.sequencing(aligned, "parsed_answer", "gold", *by)


class _Pooled(Choice):
    """Choices among all values a column takes."""

    column = ""
    blank = staticmethod(lambda c: c)
    before = False  # whether rows without a value are left out before the draw

    def build(self, scores: DataFrame, n: int, seed: int) -> DataFrame:
        named = scores.where(_has(self.column))
        pool = named.select(F.col(self.column).alias("value")).distinct()
        drawn = _draw(named if self.before else scores, self, n, seed).where(_has(self.column)).withColumn("gold", F.col(self.column))
        return self.records(self.choices(other_values(drawn, pool, "gold"), seed), self.blank(F.col("text")))


@register
class ComposerRecognition(_Pooled):
    name, default_n, column = "composer_recognition", 96, "composer"
    blank = staticmethod(T.blank_composer)


@register
class GenreRecognition(_Pooled):
    name, default_n, column = "genre_recognition", 132, "style"


@register
class MusicCaptioning(_Pooled):
    name, default_n, column, before = "music_captioning", 60, "title", True
    blank = staticmethod(T.blank_title)


class _Metadata(Choice):
    hide = False
    question = ""

    def build(self, scores: DataFrame, n: int, seed: int) -> DataFrame:
        some = scores.where(_has("key") | _has("meter") | _has("note_length"))
        pools = {f: some.where(_has(f)).agg(F.array_sort(F.collect_set(f)).alias("pool")) for f in T.FIELDS}
        drawn = _draw(some, self, n, seed).withColumn("asked", rotated_field(F.col("i"))).withColumns({"question_field": F.col("asked.field"), "gold": F.col("asked.value")})
        # declared keys and meters are a closed vocabulary, as three rows beside every record
        named = [p.select(F.lit(f).alias("question_field"), "pool") for f, p in pools.items()]
        with_pool = drawn.join(F.broadcast(named[0].unionByName(named[1]).unionByName(named[2])), "question_field")
        content = T.mask_chosen_field(F.col("text"), F.col("question_field")) if self.hide else F.col("text")
        ask = F.concat(F.lit(f"{self.instruction} {self.question}: "), "question_field", F.lit("."))
        return self.records(self.choices(with_pool, seed), content, ask, question_field=F.col("question_field"))


@register
class MetadataQa(_Metadata):
    name, question = "metadata_qa", "Field"


@register
class MetadataPrediction(_Metadata):
    name, hide, question = "metadata_prediction", True, "Masked field"


@register
class NextBar(Choice):
    name, default_n = "next_bar_prediction", 119

    def build(self, scores: DataFrame, n: int, seed: int) -> DataFrame:
        eight = scores.withColumn("bars", T.split_bars(F.col("text"))).where(F.size("bars") >= 8)
        drawn = _draw(eight, self, n, seed).withColumn("gold", F.get("bars", F.lit(4))).withColumn("pool", F.slice("bars", F.lit(6), F.size("bars")))
        opening = F.concat(F.array_join(F.slice("bars", 1, 4), " | "), F.lit(" |"))
        at = (F.array_position("options", F.col("gold")) - 1).cast("string")
        return self.records(self.choices(drawn, seed), opening, gold=at, gold_index=at.cast("int"))


@register
class EmotionRecognition(Choice):
    name, default_n, corpus_kind = "emotion_recognition", 120, "clips"

    def build(self, scores: DataFrame, n: int, seed: int) -> DataFrame:
        clips = scores.where(F.col("label").isin(*S.QUADRANTS))
        per = per_group(clips, "label", share_of(n, 4), key(seed, self.name, F.col("source_id"), F.col("pos")), "source_id", "pos")
        numbered = per.withColumn("i", F.expr("row_number() over (order by label, r) - 1")).withColumn("gold", F.col("label"))
        options = shuffled(F.array(*[F.lit(q) for q in S.QUADRANTS]), key(seed, self.name, F.col("source_id"), F.lit("o")))
        return self.records(numbered.withColumn("options", options), F.col("text"), clip_id=F.col("clip_id"), song_id=F.col("song_id"))

    def confusion(self, aligned: DataFrame, *by: str) -> DataFrame:
        said = F.get("options", F.when(F.col("parsed_answer").rlike("^[0-3]$"), F.col("parsed_answer")).try_cast("int"))
        return S.confusion(aligned, said, F.col("gold"), *by)


@register
class ErrorDetection(Task):
    name, kind, default_n = "error_detection", T.STRUCTURED, 220

    def build(self, scores: DataFrame, n: int, seed: int) -> DataFrame:
        per = share_of(n, len(CATEGORIES))
        four = scores.where(T.count_bars(F.col("text")) >= 4)
        # no more rows than this can be tried
        pool = sample(four, 8 * per * len(CATEGORIES), key(seed, self.name, F.col("source_id"), F.col("pos")), "source_id", "pos").withColumn("rn", F.col("i") + 1).drop("i")
        pool = written(pool, "pool")
        flagged = pool.withColumns({f"ok_{c}": applicable(F.col("text"), c) for c in CATEGORIES})
        filled = fill_categories(flagged, n)
        k = key(seed, self.name, F.col("source_id"))
        hurt = F.coalesce(*[F.when(F.col("category") == c, inject(F.col("text"), c, k)) for c in CATEGORIES])
        rows = pool.join(F.broadcast(filled), "rn").withColumn("hurt", hurt).withColumn("i", F.expr("row_number() over (order by category_no, rn) - 1"))
        return self.records(rows, F.col("hurt.text"), gold_bars=F.col("hurt.error_bars"), category=F.col("category"))

    def score(self, aligned: DataFrame, *by: str) -> DataFrame:
        return S.macro_f1(S.error_f1(aligned, "parsed_answer", "raw_output", "gold_bars", "category"), *by)


def build_all(scores: DataFrame, names: str = "all", corpus_kind: str | None = None, limit: int | None = None, seed: int = 1234) -> DataFrame:
    """Records of the chosen tasks; ``limit`` 0 or none takes each task's own number."""
    out = None
    for task in chosen_tasks(names, corpus_kind):
        made = task.build(scores, limit or task.default_n, seed)
        out = made if out is None else out.unionByName(made)
    return out if out is not None else scores.sparkSession.createDataFrame([], RECORD)


def score_all(aligned: DataFrame, *by: str) -> DataFrame:
    """``(by..., task, n, accuracy, score, macro_f1, n_parsed, missing)`` for every registered task.

    All multiple-choice tasks are scored in one pass, over answers joined once; tasks without predictions are marked missing.
    """
    choice = [t.name for t in iter_tasks() if isinstance(t, Choice)]
    # every kind of task reads the answers, so they are joined to their records once
    aligned = written(aligned.drop("input_content", "prompt", "task_instruction", "source_file"), "aligned")
    mc = Choice.score(get_task("composer_recognition"), aligned.where(F.col("task").isin(choice)), *by, "task")
    parts = [mc]
    for t in iter_tasks():
        if t.name not in choice:
            parts.append(t.score(aligned.where(F.col("task") == t.name), *by).withColumn("task", F.lit(t.name)) if by else t.score(aligned.where(F.col("task") == t.name)).where("n > 0").withColumn("task", F.lit(t.name)))
    cols = {"n": "bigint", "accuracy": "double", "score": "double", "macro_f1": "double", "n_parsed": "bigint"}
    union = None
    for p in parts:
        shaped = p.select(*by, "task", *[(F.col(c) if c in p.columns else F.lit(None)).cast(k).alias(c) for c, k in cols.items()])
        union = shaped if union is None else union.unionByName(shaped)
    names = aligned.sparkSession.createDataFrame([(t.name,) for t in iter_tasks()], "task string")
    grid = aligned.select(*by).distinct().crossJoin(F.broadcast(names)) if by else names
    return grid.join(union, [*by, "task"], "left").withColumn("missing", F.col("n").isNull()).withColumn("n", F.coalesce("n", F.lit(0)))


