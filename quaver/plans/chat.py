"""Prompts for generation and for the benchmark: banks, regimes and conversations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.functions import text as T
from quaver.operators.selection import prompt_draw

# The system prompts of the two halves.
WRITER = "You are a LilyPond assistant. Output only valid LilyPond code, no prose, no markdown."
READER = "You are a music-theory assistant. Read the LilyPond score in the Input section and answer the multiple-choice question exactly as instructed."


def metadata(scores: DataFrame) -> DataFrame:
    """Scores with the struct ``metadata`` of a prompt: the style is its period, a missing part means the full score."""
    part = F.coalesce(T.null_if_empty(F.try_element_at("extras", F.lit("part"))), F.lit("full"))
    empty = F.array().cast("array<string>")
    return scores.withColumn(
        "metadata",
        F.struct("composer", F.col("style").alias("period"), F.coalesce("musical_form", empty).alias("musical_form"), F.coalesce("ensemble", empty).alias("ensemble"), part.alias("part")),
    )


def _fields() -> list[Column]:
    return [F.col(f"metadata.{c}") for c in ("composer", "period", "musical_form", "ensemble", "part")]


def prompt_bank(scores: DataFrame, n: int = 200, seed: int = 1234, bars: int | None = None, render: Callable[..., Column] | None = None) -> DataFrame:
    """``(id, source_id, metadata, user_prompt)`` of ``n`` draws with replacement; ``render`` may replace the wording."""
    drawn = metadata(prompt_draw(scores, n, seed))
    words = (render or T.user_prompt)(*_fields(), bars=bars)
    return drawn.select(F.format_string("prompt_%04d", F.col("i")).alias("id"), "source_id", "metadata", words.alias("user_prompt"))


@dataclass(frozen=True)
class Regime:
    """How a prompt of the bank is put to a model."""

    name: ClassVar[str] = "zero"
    demonstrations: str = ""

    def prompt(self) -> Column:
        user = T.assembled(self.demonstrations, T.metadata_block(*_fields()), F.col("user_prompt"))
        return T.rendered_chat(F.lit(WRITER), user)


@dataclass(frozen=True)
class FewShot(Regime):
    name: ClassVar[str] = "few"

    @classmethod
    def from_file(cls, path: str | Path, name: str | None = None) -> FewShot:
        kind = type(f"{cls.__name__}_{name}", (cls,), {"name": name}) if name else cls
        return kind(demonstrations=Path(path).read_text(encoding="utf-8"))


REGIMES: dict[str, type[Regime]] = {Regime.name: Regime, FewShot.name: FewShot}


def register_regime(cls: type[Regime]) -> None:
    if cls.name in REGIMES:
        raise KeyError(f"regime {cls.name!r} is registered already")
    REGIMES[cls.name] = cls


def conversation_prompt(turns: DataFrame, by: str, turn: str = "turn") -> DataFrame:
    """``(by, prompt)``: the system text of the first turn, if it is one, and the last turn's text."""
    first = F.min_by(F.struct("role", "text"), turn)
    last = F.max_by("text", turn)
    return (
        turns.groupBy(by).agg(first.alias("f"), last.alias("user"))
        .select(by, T.rendered_chat(F.when(F.col("f.role") == "system", F.col("f.text")).otherwise(F.lit(WRITER)), F.col("user")).alias("prompt"))
    )


def bench_prompt(limit: int | None = None) -> Column:
    """The prompt of a benchmark record, its content cut to ``limit`` characters if longer."""
    body = F.col("prompt")
    if limit:
        cut = T.truncated(F.col("input_content"), limit)
        again = F.when(F.col("template_kind") == T.MULTIPLE_CHOICE, T.choice_prompt(cut, F.col("task_instruction"), F.col("options"))).otherwise(
            T.structured_prompt(cut, F.col("task_instruction"), F.coalesce("structured_output_template", F.lit("")))
        )
        body = F.when(F.length("input_content") > limit, again).otherwise(body)
    return T.rendered_chat(F.lit(READER), body)


@dataclass(frozen=True)
class ModelSpec:
    """What is needed to load a model."""

    model_id: str
    hf_id: str
    dtype: str = "bf16"
    family: str = "general"
    trust_remote_code: bool = False
    gated: bool = False
    generation_end_marker: str | None = None
    extra_kwargs: dict[str, Any] = field(default_factory=dict)


# The models that were compared.
MODELS: dict[str, ModelSpec] = {
    "phi4": ModelSpec("phi4", "microsoft/phi-4"),
    "qwen-coder": ModelSpec("qwen-coder", "Qwen/Qwen2.5-Coder-14B-Instruct", family="code"),
    "deepseek-coder": ModelSpec("deepseek-coder", "deepseek-ai/DeepSeek-Coder-V2-Lite-Instruct", family="code", trust_remote_code=True),
    "codestral": ModelSpec("codestral", "mistralai/Codestral-22B-v0.1", family="code", gated=True),
}


def register_model(spec: ModelSpec) -> None:
    if spec.model_id in MODELS:
        raise KeyError(f"model {spec.model_id!r} is registered already")
    MODELS[spec.model_id] = spec


def get_spec(model_id: str) -> ModelSpec:
    if model_id not in MODELS:
        raise KeyError(f"unknown model {model_id!r}; known: {', '.join(list_model_ids())}")
    return MODELS[model_id]


def list_model_ids() -> list[str]:
    return sorted(MODELS)
