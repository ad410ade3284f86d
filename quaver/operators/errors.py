"""Injection of one error into a score, for the error-detection benchmark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaver.functions import text as T
from quaver.functions.sampling import number_of, pick_one

# The categories and what each of them inserts.
CATEGORIES = ("invalid_metadata", "invalid_content", "invalid_bar_duration", "melodic_leap", "accidental_outside_key")
GARBAGE = (" @#$% ", " ??? ", " %%%bogus%%% ", " <<garbled>> ")
TOO_LONG = (" c4 d4 e4 f4 g4 a4 b4 c'4 ",)
LEAPS = (" c,,,4 c''''4 ", " c''''4 c,,,4 ", " c,,,8 c''''8 ")
OUTSIDE = {
    "c \\major": ("fis", "cis", "gis", "dis", "ais"),
    "a \\minor": ("fis", "cis", "gis", "dis", "ais"),
    "g \\major": ("cis", "gis", "dis", "ais"),
    "f \\major": ("fis", "cis", "gis", "dis"),
    "d \\major": ("gis", "dis", "ais", "bes"),
}
OUTSIDE_ANY = ("bisis", "feses")
NONSENSE_KEY = r"\key xx \nonsense"


def _strings(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def applicable(text: Column, category: str) -> Column:
    """Whether an error of ``category`` can be put into ``text``."""
    two = F.size(T.between_separators(text)) > 2
    if category == "invalid_metadata":
        return text.rlike(T.KEY)
    if category == "invalid_bar_duration":
        return two & text.rlike(T.TIME)
    if category in CATEGORIES:
        return two
    raise KeyError(f"unknown category {category!r}; expected one of {', '.join(CATEGORIES)}")


def tokens(text: Column, category: str) -> Column:
    """What may be inserted for ``category``, by the text's key for notes outside it."""
    fixed = {"invalid_content": GARBAGE, "invalid_bar_duration": TOO_LONG, "melodic_leap": LEAPS}
    if category in fixed:
        return _strings(fixed[category])
    key = T.normal_key(text)
    known = F.coalesce(*[F.when(key == k, _strings(v)) for k, v in OUTSIDE.items()], _strings(OUTSIDE_ANY))
    return F.transform(known, lambda p: F.concat(F.lit(" "), p, F.lit("4 ")))


def inject(text: Column, category: str, key: Column) -> Column:
    """``struct(text, error_bars, category)``, null where the error is not applicable.  ``key`` seeds the choice of bar and token."""
    def made(changed: Column, bar: Column) -> Column:
        return F.struct(changed.alias("text"), F.array(bar).alias("error_bars"), F.lit(category).alias("category"))

    if category == "invalid_metadata":
        nonsense = "$1" + NONSENSE_KEY.replace("\\", "\\\\")
        return F.when(applicable(text, category), made(F.regexp_replace(text, rf"(?s)\A(.*?){T.KEY}", nonsense), F.lit(1)))
    token = pick_one(tokens(text, category), F.concat(key, F.lit(":token")))
    meant = text.rlike(T.TIME) if category == "invalid_bar_duration" else F.lit(True)
    applicable(text, category)  # an unknown category raises

    def into(pieces: Column) -> Column:
        bar = (number_of(F.concat(key, F.lit(":bar"))) % F.greatest(F.size(pieces) - 1, F.lit(1)) + 1).cast("int")

        def at(place: Column) -> Column:
            changed = F.concat(F.substring(text, F.lit(1), place), token, F.substring(text, place + 1, F.length(text)))
            return F.when((F.size(pieces) > 2) & meant, made(changed, bar))

        return T.let(T.separator_position(pieces, bar), at)

    return T.let(T.between_separators(text), into)
