r"""Scalar functions on score text and model output, as Column expressions.

Everything here stays in Catalyst: no Python worker is started.  Patterns are written for Java with
``(?U)``, so that blanks and digits are those of Unicode, and ``(?d)`` where ``$`` must only match
before a line feed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define the text operators' results.
HEADER = r"\\header(?U:\s)*\{[^{}]*\}"
PAPER = r"\\paper(?U:\s)*\{[^{}]*\}"
BAR_DIRECTIVE = r'\\bar(?U:\s)*"[^"]*"'
QUOTED = r'"[^"\n]*"'
NOTE_NAME = "[a-g]|do|re|mi|fa|sol|la|si"
ACCIDENTAL = "isis|eses|is|es|dd|d|bb|b"
KEY = rf"\\key(?U:\s)+({NOTE_NAME})({ACCIDENTAL})?(?U:\s)+\\([A-Za-z]+)"
TIME = r"\\time(?U:\s)+((?U:\d)+)(?U:\s)*/(?U:\s)*((?U:\d)+)"
TITLE = r'(?<![A-Za-z_])title(?U:\s)*=(?U:\s)*"((?:[^"\\]|\\.)*)"'
PART_SUFFIX = r"(?d)_part(?U:\d)+$|_(score|violin[oI]+|viola|cello|basso|bc|continuo|flauto[12]?|tromba[12]?|corno[12]?|oboe[12]?|fagotto)$"
ANY_PART_SUFFIX = r"(?d)_(?:part\d+|score|violino?[12I]*|viola|cello|basso|bc|continuo|flauto\d*|tromba\d*|corno\d*|oboe\d*|fagotto\d*)$"
LILYPOND_VERSION, LILYPOND_LANGUAGE = "2.24.4", "nederlands"
FENCE = r"```[a-zA-Z0-9_+-]*(?U:\s)*\n"
ONLY_INDEX = "Please only output the index of the correct option (0, 1, 2, or 3), do not output any additional content."
DIRECTLY = "Please directly output the answer of the given task, without any explanation or additional content."
UNNAMED, PERIOD, SOME_FORM, SOME_ENSEMBLE = "an unnamed 18th-century composer", "Baroque", "a short piece", "a small ensemble"
WRITE, COMPOSE = "Write a LilyPond fragment ", "Compose a short LilyPond fragment of approximately {} bars "
ONE_VOICE = ", optionally with simple accompaniment (chords or a bass line — at most one extra voice). Avoid full multi-instrument scores. "
NOTATION = "Use Dutch (nederlands) note names and lowercase relative notation. Output only the LilyPond code; no prose, no markdown."
TRUNCATED = "\n% ...truncated...\n"
METADATA_OPEN, METADATA_CLOSE = "%% === METADATA ===", "%% === END METADATA ==="
MULTIPLE_CHOICE, STRUCTURED = "multiple_choice", "structured_output"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


# --- bars ---------------------------------------------------------------------------------------


def strip_preamble(c: Column) -> Column:
    """Without header and paper blocks and ``\\bar`` directives; other quoted strings emptied."""
    for pattern, put in ((HEADER, ""), (PAPER, ""), (BAR_DIRECTIVE, ""), (QUOTED, '""')):
        c = F.regexp_replace(c, pattern, put)
    return c


def split_bars(c: Column) -> Column:
    """The segments closed by ``|``, trimmed, without empty ones."""
    closed = let(F.split(strip_preamble(c), r"\|", -1), lambda parts: F.slice(parts, F.lit(1), F.size(parts) - 1))
    return F.filter(F.transform(closed, strip), lambda b: b != "")


def count_bars(c: Column) -> Column:
    return F.size(split_bars(c))


def _blank_out(c: Column, pattern: str) -> Column:
    """Each match replaced by as many blanks."""

    def padded(text: Column) -> Column:
        pads = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.repeat(F.lit(" "), F.length(m)))
        return F.array_join(F.zip_with(F.split(text, pattern, -1), pads, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return let(c, padded)


def mask_positions(c: Column) -> Column:
    """Text of the same length in which only real bar separators are left as ``|``."""
    for pattern in (HEADER, PAPER, BAR_DIRECTIVE, QUOTED):
        c = _blank_out(c, pattern)
    return c


def between_separators(c: Column) -> Column:
    """The masked text's pieces around its separators: one more than there are separators."""
    return F.split(mask_positions(c), r"\|", -1)


def separator_position(pieces: Column, k: Column) -> Column:
    """Offset (from 0) of the k-th separator (from 1), from :func:`between_separators`."""
    return F.aggregate(F.slice(pieces, F.lit(1), k), F.lit(0), lambda a, p: a + F.length(p)) + k - 1


def bar_at(c: Column, position: Column) -> Column:
    """Number (from 1) of the bar that holds the offset ``position``."""
    return count_bars(F.substring(c, F.lit(1), position)) + 1


def first_bars(c: Column, k: int) -> Column:
    """The first ``k`` bars written anew; a text without bars as it is."""
    return let(split_bars(c), lambda bars: F.when(F.size(bars) == 0, c).otherwise(F.concat(F.array_join(F.slice(bars, 1, k), " | "), F.lit(" |\n"))))


# --- declarations -------------------------------------------------------------------------------


def extract_key(c: Column) -> Column:
    g = [F.regexp_extract(c, KEY, i) for i in (1, 2, 3)]
    return F.when(g[0] != "", F.concat(g[0], g[1], F.lit(" \\"), g[2]))


def extract_meter(c: Column) -> Column:
    return F.when(F.regexp_extract(c, TIME, 1) != "", F.concat_ws("/", F.regexp_extract(c, TIME, 1), F.regexp_extract(c, TIME, 2)))


def extract_note_length(c: Column) -> Column:
    return null_if_empty(F.regexp_extract(c, TIME, 2))


FIELDS = ("key", "meter", "note_length")


def mask_field(c: Column, field: str) -> Column:
    """Without any declaration of ``field``; the note length is read from the meter."""
    if field not in FIELDS:
        raise ValueError(f"unknown field {field!r}; expected one of {', '.join(FIELDS)}")
    return F.regexp_replace(c, KEY if field == "key" else TIME, "")


def mask_chosen_field(c: Column, field: Column) -> Column:
    """:func:`mask_field` with the field given by row."""
    return F.when(field == "key", mask_field(c, "key")).when(field.isin("meter", "note_length"), mask_field(c, "meter")).otherwise(F.raise_error(F.concat(F.lit("unknown field "), field)))


def normal_key(c: Column) -> Column:
    """The first key with a Dutch note name, as in the table of signatures."""
    p = rf"\\key(?U:\s)+([a-g](?:{ACCIDENTAL})?)(?U:\s)+\\((?U:\w)+)"
    return F.when(F.regexp_extract(c, p, 1) != "", F.concat_ws(" \\", F.regexp_extract(c, p, 1), F.regexp_extract(c, p, 2)))


def extract_title(c: Column) -> Column:
    block = F.regexp_extract(c, HEADER.replace(r"[^{}]*", r"([^{}]*)"), 1)
    return null_if_empty(strip(F.regexp_extract(block, TITLE, 1)))


def _blank_assignment(c: Column, name: str) -> Column:
    return F.regexp_replace(c, rf'({name}(?U:\s)*=(?U:\s)*)"[^"]*"', '$1""')


def blank_composer(c: Column) -> Column:
    return _blank_assignment(c, "composer")


def blank_title(c: Column) -> Column:
    """Also blanks subtitles, whose name ends alike."""
    return _blank_assignment(c, "title")


# --- ids ----------------------------------------------------------------------------------------


def work_id(source_id: Column) -> Column:
    """``source_id`` without its part; ``violino1`` and the like are not taken for parts (see :func:`work_id_all_parts`)."""
    return F.regexp_replace(source_id, PART_SUFFIX, "")


def work_id_all_parts(source_id: Column) -> Column:
    """As :func:`work_id`, with numbered violins too, so that they don't become works of their own."""
    return F.regexp_replace(source_id, ANY_PART_SUFFIX, "")


def song_id(stem: Column) -> Column:
    """The middle of ``label_song_n``; shorter stems stay."""
    parts = F.split(stem, "_", -1)
    return F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, F.lit(2), F.size(parts) - 2), "_")).otherwise(stem)


def record_id(task: Column, number: Column) -> Column:
    return F.format_string("%s_%04d", task, number)


# --- answers ------------------------------------------------------------------------------------


def digit_sequence(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D", "")


def bar_list(c: Column) -> Column:
    """Different whole numbers in a text, in order, as digits without leading zeros, however long."""
    runs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\d+"), F.lit(0))
    return F.array_distinct(F.transform(runs, lambda x: F.regexp_replace(x, r"^0+(?=\d)", "")))


def longest_run(c: Column) -> Column:
    """The longest run of digits, of equals the first."""
    runs = F.regexp_extract_all(c, F.lit(r"(?U)\d+"), F.lit(0))
    return F.aggregate(runs, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))


def parse_answer(raw: Column, task: Column, kind: Column) -> Column:
    """What a model answered: an option's digit, a number, or the longest run of digits; empty if there is none."""
    return (
        F.when(kind == MULTIPLE_CHOICE, F.regexp_extract(raw, "[0-3]", 0))
        .when(task == "bar_count", F.regexp_extract(raw, r"(?U)\d+", 0))
        .otherwise(longest_run(raw))
    )


# --- model output -------------------------------------------------------------------------------


def strip_fence(c: Column) -> Column:
    """What stands in the first closed code fence; else the text without its first opening fence, trimmed; a text without fences as it is."""
    closed = rf"(?s){FENCE}(.*?)\n```"
    opening = rf"(?sm)\A(.*?)^(?U:\s)*{FENCE}"
    return (
        F.when(c.rlike(closed), strip(F.regexp_extract(c, closed, 1)))
        .when(c.rlike(opening), strip(F.regexp_replace(c, opening, "$1")))
        .otherwise(c)
    )


def ensure_headers(c: Column, version: str = LILYPOND_VERSION, language: str = LILYPOND_LANGUAGE) -> Column:
    """With version and language lines if they are missing, and one line feed at the end."""
    missing = lambda word, value: F.when(c.contains(f"\\{word}"), F.lit("")).otherwise(F.lit(f'\\{word} "{value}"\n'))
    return F.concat(missing("version", version), missing("language", language), F.regexp_replace(c, r"(?U)\s+\z", ""), F.lit("\n"))


def ensure_version(c: Column, version: str = LILYPOND_VERSION) -> Column:
    return F.when(c.contains("\\version"), c).otherwise(F.concat(F.lit(f'\\version "{version}"\n'), c))


def cut_at(c: Column, marker: str | None) -> Column:
    """Up to the first ``marker``; an empty or missing marker cuts nothing."""
    return F.substring_index(c, marker, 1) if marker else c


def truncated(c: Column, limit: int | None) -> Column:
    """The first ``limit`` characters and a remark, if the text is longer; no limit or 0 leaves it."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(TRUNCATED))).otherwise(c) if limit else c


# --- prompts ------------------------------------------------------------------------------------


def choice_prompt(content: Column, instruction: Column, options: Column) -> Column:
    """Prompt of a question with exactly four options; any other number raises."""
    listed = F.array_join(F.transform(options, lambda o, i: F.concat(i.cast("string"), F.lit(". "), o)), "\n")
    text = F.concat(F.lit("Input: "), content, F.lit("\nTask: "), instruction, F.lit("\nOptions:\n"), listed, F.lit("\n\n" + ONLY_INDEX))
    return F.when(F.size(options) == 4, text).otherwise(F.raise_error(F.lit("a question needs exactly 4 options")))


def structured_prompt(content: Column, instruction: Column, template: Column) -> Column:
    return F.concat(F.lit("Input: "), content, F.lit("\nTask: "), instruction, F.lit("\nTemplate: "), template, F.lit("\n\n" + DIRECTLY))


def numbered(items: Column) -> Column:
    """One item a line, numbered from 0."""
    return F.array_join(F.transform(items, lambda s, i: F.concat(i.cast("string"), F.lit(". "), s)), "\n")


def metadata_block(composer: Column, period: Column, musical_form: Column, ensemble: Column, part: Column) -> Column:
    """The comment block that opens a generation prompt; null and empty fields are left out."""

    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"%% {name}: "), value))

    def listed(name: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(f"%% {name}: "), F.array_join(items, ", ")))

    lines = [F.lit(METADATA_OPEN), line("composer", composer), line("period", period), listed("musical_form", musical_form), listed("ensemble", ensemble), line("part", part), F.lit(METADATA_CLOSE)]
    return F.concat(F.array_join(F.array_compact(F.array(*lines)), "\n"), F.lit("\n"))


def user_prompt(composer: Column, period: Column, musical_form: Column, ensemble: Column, part: Column, bars: int | None = None) -> Column:
    """What to write, in words; with ``bars`` a short fragment of about so many bars."""

    def either(c: Column, default: str) -> Column:
        return F.when(c.isNotNull() & (c != ""), c).otherwise(F.lit(default))

    def joined(c: Column, default: str) -> Column:
        return F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(F.lit(default))

    style = [F.lit("in the style of "), either(composer, UNNAMED), F.lit(" ("), either(period, PERIOD), F.lit("). Form: "), joined(musical_form, SOME_FORM)]
    which = either(part, "full")
    if bars is not None and bars > 0:
        target = F.when(which == "full", F.lit("a melodic line")).otherwise(F.concat(F.lit("the "), which, F.lit(" part as a melodic line")))
        return F.concat(
            F.lit(COMPOSE.format(bars)), *style, F.lit(". Write "), target,
            F.lit(ONE_VOICE + NOTATION),
        )
    target = F.when(which == "full", F.lit("the full ensemble score")).otherwise(F.concat(F.lit("the "), which, F.lit(" part")))
    return F.concat(F.lit(WRITE), *style, F.lit(". Ensemble: "), joined(ensemble, SOME_ENSEMBLE), F.lit(". Produce "), target, F.lit(". " + NOTATION))


def rendered_chat(system: Column, user: Column) -> Column:
    """Plain rendering of a conversation for models without a template of their own."""
    return F.concat(F.lit("### System:\n"), system, F.lit("\n\n### User:\n"), user, F.lit("\n\n### Assistant:\n"))


def assembled(demonstrations: str, block: Column, user: Column) -> Column:
    """Demonstrations, if any, then metadata block and user prompt."""
    demos = demonstrations.strip()
    return F.concat(F.lit(f"{demos}\n\n" if demos else ""), block, user)
