"""Text functions on small cases: expected values were worked out by hand."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quaver.functions import numeric as N
from quaver.functions import text as T
from quaver.operators import errors as E

CLEAN = '\\version "2.24.0"\n\\key c \\major\n\\time 4/4\nc4 d4 e4 f4 |\ng4 a4 b4 c\'4 |\nc4 d4 e4 f4 |\ng4 a4 b4 c\'4 |\nc1 |\n'


def values(spark, column, rows, schema="c string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in df.coalesce(1).select(column).collect()]


@pytest.mark.parametrize(
    ("text", "bars"),
    [
        ("a | b | c |", ["a", "b", "c"]), ("a b", []), ("", []), ("| | x |", ["x"]), ("a | tail", ["a"]),
        ('\\header { title = "Has | pipe" } a | b |', ["a", "b"]), ('a \\bar "||" | b \\bar "|." |', ["a", "b"]), ('a \\mark "|" | b |', ['a \\mark ""', "b"]),
        ("\\paper { x = | } a |", ["a"]), ("\u00a0a\u2003|", ["a"]), ("😀 | b |", ["😀", "b"]),
    ],
)
def test_bars(spark, text, bars):
    assert values(spark, T.split_bars(F.col("c")), [text]) == [bars]
    assert values(spark, T.count_bars(F.col("c")), [text]) == [len(bars)]


def test_mask_keeps_every_position(spark):
    rng = random.Random(3)
    parts = ['\\header { a = "|" }', "\\paper {|}", '\\bar "||"', '"q|q"', "|", " c4 ", "\n", "😀", '"', "{", "}", "\\bar", "\u00a0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(300)]

    def expected(t):
        for p in (r"\\header\s*\{[^{}]*\}", r"\\paper\s*\{[^{}]*\}", r'\\bar\s*"[^"]*"', r'"[^"\n]*"'):
            t = re.sub(p, lambda m: " " * len(m[0]), t)
        return t

    masked = values(spark, T.mask_positions(F.col("c")), texts)
    assert masked == [expected(t) for t in texts]
    at = values(spark, F.transform(F.sequence(F.lit(1), F.size(T.between_separators(F.col("c"))) - 1), lambda k: T.separator_position(T.between_separators(F.col("c")), k)), [t for t in texts if "|" in expected(t)])
    assert at == [[i for i, ch in enumerate(expected(t)) if ch == "|"] for t in texts if "|" in expected(t)]


@pytest.mark.parametrize(
    ("function", "cases"),
    [
        (T.extract_key, {"\\key g \\major x": "g \\major", "\\key fis \\minor": "fis \\minor", "\\key sol \\major": "sol \\major", "\\key c\\major": None, "\\key es \\major": None, "none": None}),
        (T.extract_meter, {"\\time 4/4": "4/4", "\\time 6 / 8": "6/8", "x": None}),
        (T.extract_note_length, {"\\time 6/8": "8", "x": None}),
        (lambda c: T.mask_field(c, "key"), {"a \\key g \\major b \\key c \\minor": "a  b ", "x": "x"}),
        (lambda c: T.mask_field(c, "note_length"), {"a \\time 3/4 b": "a  b"}),
        (T.extract_title, {'\\header { title = "A" }': "A", "\\header { }": None, '\\header { title = "  " }': None, '\\header { title = "He said \\"hi\\"" }': 'He said \\"hi\\"', '\\header { subtitle = "S" }': None, '\\header { title = " Ü " }': "Ü", '\\header { title = "1" } \\header { title = "2" }': "1", "": None}),
        (T.work_id, {"w_1_x_violinoII": "w_1_x", "w_1_x_part12": "w_1_x", "w_1_x_violino1": "w_1_x_violino1", "w": "w"}),
        (T.work_id_all_parts, {"w_1_x_violino1": "w_1_x", "w_1_x_violinoI": "w_1_x"}),
        (T.song_id, {"Q1_a_b_0": "a_b", "Q1_a": "Q1_a", "x": "x"}),
        (T.digit_sequence, {"answer is 0312": "0312", "the order is 2 0 3 1": "2031", "none": ""}),
        (lambda c: F.transform(T.bar_list(c), lambda x: x.cast("int")), {"3, 7, 12": [3, 7, 12], "bars 3 and 7, 3": [3, 7], "": [], "none": []}),
        (T.bar_list, {"007, 7 and " + "9" * 40: ["7", "9" * 40], "000": ["0"]}),
        (T.strip_fence, {"```ly\nx\n```": "x", "a\n```\n b \n```\nc": "b", "a\n```ly\nopen": "a\nopen", "  plain ": "  plain "}),
        (lambda c: T.ensure_headers(c), {"x \n": '\\version "2.24.4"\n\\language "nederlands"\nx\n', '\\version "1" \\language "x"': '\\version "1" \\language "x"\n'}),
        (lambda c: T.cut_at(c, "<end>"), {"a<end>b<end>": "a", "a": "a"}),
        (lambda c: T.truncated(c, 3), {"abcd": "abc\n% ...truncated...\n", "abc": "abc"}),
        (lambda c: T.first_bars(c, 2), {"a | b | c |": "a | b |\n", "abc": "abc"}),
    ],
)
def test_cases(spark, function, cases):
    assert values(spark, function(F.col("c")), list(cases)) == list(cases.values())


def test_parse_answer(spark):
    rows = [("the answer is 7 or 2", "x", "multiple_choice", "2"), ("none", "x", "multiple_choice", ""), ("about 12 bars, 3", "bar_count", "structured", "12"), ("3 7 12", "error_detection", "structured", "12"), ("2 0 3 1", "bar_sequencing", "structured", "2")]
    got = values(spark, T.parse_answer(F.col("c"), F.col("t"), F.col("k")), [r[:3] for r in rows], "c string, t string, k string")
    assert got == [r[3] for r in rows]


def test_prompts(spark):
    with pytest.raises(ValueError, match="unknown field"):
        T.mask_field(F.col("c"), "tempo")
    o = F.array(*[F.lit(x) for x in "wxyz"])
    assert values(spark, T.choice_prompt(F.col("c"), F.lit("do"), o), ["in"])[0].startswith("Input: in\nTask: do\nOptions:\n0. w\n1. x\n2. y\n3. z\n\nPlease only")
    with pytest.raises(Exception, match="exactly 4"):
        values(spark, T.choice_prompt(F.col("c"), F.lit("do"), F.array(F.lit("a"))), ["in"])
    one = lambda **k: values(spark, T.user_prompt(*[F.lit(None).cast(t) for t in ("string", "string", "array<string>", "array<string>", "string")], **k), ["x"])[0]
    assert "an unnamed 18th-century composer (Baroque). Form: a short piece. Ensemble: a small ensemble. Produce the full ensemble score" in one()
    assert "approximately 4 bars" in one(bars=4)


@pytest.mark.parametrize(
    ("pred", "gold", "score"),
    [("0123", "0123", 1), ("3210", "0123", 0), ("0213", "0123", 5 / 6), ("01", "0123", 0), ("0011", "0123", 0), ("0124", "0123", 0), ("01234", "0123", 0), ("prose", "0123", 0), ("0", "0", 1), ("10", "01", 0), (None, "0123", 0), ("order 2 0 3 1", "2031", 1)],
)
def test_sequencing(spark, pred, gold, score):
    assert values(spark, N.sequencing_score(F.col("p"), F.col("g")), [(pred, gold)], "p string, g string")[0] == pytest.approx(score)


@pytest.mark.parametrize(("p", "g", "f1"), [([3], [3], 1), ([2], [5], 0), ([3], [3, 5], 2 / 3), ([3, 5], [3], 2 / 3), ([], [], 1), ([], [3], 0), ([3], [], 0)])
def test_f1(spark, p, g, f1):
    assert values(spark, N.set_f1(F.col("p"), F.col("g")), [(p, g)], "p array<int>, g array<int>")[0] == pytest.approx(f1)


@pytest.mark.parametrize("category", E.CATEGORIES)
def test_errors(spark, category):
    got = values(spark, E.inject(F.col("c"), category, F.lit("k")), [CLEAN, "no bars", CLEAN])
    assert got[1] is None and got[0] == got[2] and got[0]["text"] != CLEAN and got[0]["category"] == category
    bar = got[0]["error_bars"][0]
    assert bar == 1 if category == "invalid_metadata" else 1 <= bar <= 5
    if category == "invalid_metadata":
        assert "\\key xx \\nonsense\n" in got[0]["text"]
    else:
        assert got[0]["text"].split("|")[bar - 1] != CLEAN.split("|")[bar - 1]


def test_unknown_error():
    with pytest.raises(KeyError):
        E.applicable(F.col("c"), "typo")
