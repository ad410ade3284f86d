"""The music of a score or bench record as bars of plain notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most one note in EDIT of the shorter record is changed, added or missing ("about": counts are
#: rounded up); what is found is confirmed up to CHANGED of its notes, as nothing lies between.
EDIT, CHANGED = 8, 0.2
#: Bars of at least LONG notes are also cut into all their runs of RUN notes.
RUN, LONG = 4, 7

_COMMENT = r"%\{(?s:.*?)%\}|%[^\n]*"
_STATEMENT = r"\\key\s+\S+\s*\\\w+|\\time\s+\d+\s*/\s*\d+|\\tempo\s+(?:\"[^\"]*\"\s*)?(?:[^|\n={}]*=\s*\d+(?:\s*-\s*\d+)?)?|\\(?:clef|language|version|bar)\s+(?:\"[^\"]*\"|\S+)"
_MARK = r"\\[A-Za-z]+|\\[<>!]|[-_^][.^>!_+-]|[~()\[\]]"
# looking at the first character alone spares most places the alternatives
_STRIPPED = rf"(?=[\\\-_^~()\[\]])(?:{_STATEMENT}|{_MARK})"
_REST = r"^(?:[rRs][\d.*/]*(?: |$))+$"
_NUMBER = r"(?m)^\s*\d+\.\s+"


def bars(text: Column) -> Column:
    """Array of the bars of ``text``, each its notes without marks, parted by one blank.

    The music block is what stands between the first ``= {`` and the last ``}``; a text without one
    is taken whole, and its line numbers part bars as bar lines do.  Statements of key, time and
    tempo, comments, marks, empty bars and layout are left out.  Null gives null, a text without
    music an empty array.
    """
    bare = F.when(text.contains("%"), F.regexp_replace(text, _COMMENT, "")).otherwise(text)
    block = F.regexp_extract(bare, r"(?s)=\s*\{(.*)\}", 1)
    body = F.when(block != "", block).otherwise(F.regexp_replace(bare, _NUMBER, "|"))
    plain = F.regexp_replace(body, _STRIPPED, "")
    # one blank between notes, none beside bar lines
    tidy = F.regexp_replace(F.regexp_replace(plain, r"\s+", " "), r" ?\| ?", "|")
    return F.filter(F.split(F.trim(tidy), r"\|"), lambda b: b != "")


def with_bars(df: DataFrame, text: str) -> DataFrame:
    """Adds ``bars`` and ``class`` (the same for the same bag of bars, whatever their order); leaves out rows without music."""
    return (
        df.where(F.col(text).isNotNull())
        .withColumn("bars", bars(F.col(text)))
        .where(F.size("bars") > 0)
        .withColumn("class", F.xxhash64(F.array_sort(F.transform("bars", lambda b: F.xxhash64(b)))))
        .drop(text)
    )


def packed(df: DataFrame) -> DataFrame:
    """``bars`` as one text, which takes less room in a shuffle than an array."""
    return df.withColumn("bars", F.array_join("bars", "|"))


def sounding(bars: Column) -> Column:
    """The bars with notes; those of nothing but rests are no key to look a record up by, unless it has no others.

    This loses no pair: ``need`` counts the sounding bars only, while the rests count among the notes that may be changed.
    """
    notes = F.filter(bars, lambda b: ~b.rlike(_REST))
    return F.when(F.size(notes) > 0, notes).otherwise(bars)


def with_keys(df: DataFrame) -> DataFrame:
    """Adds to ``bars``, a text of :func:`packed`, what a record is looked up by: ``notes``, ``edits``, ``tokens``, ``need`` and ``dense``.

    ``tokens`` are the sorted hashes of the distinct sounding bars.  Of a record of N notes and D
    such bars at most ``edits`` = N / EDIT notes differ, each of them spoils one bar, so ``need`` =
    D - ``edits`` bars stand in any other record like it.  As this holds for both records of a pair,
    both may be looked up by their own.  A ``dense`` record may have every bar spoilt; then every bar
    of the other is spoilt or added too, so both are dense (see :func:`dense_keys`).
    """
    notes = F.size(F.split(F.translate("bars", "|", " "), " "))
    return (
        df.withColumn("notes", notes)
        .withColumn("edits", F.ceil(F.col("notes") / EDIT).cast("int"))
        .withColumn("_s", sounding(F.split("bars", r"\|")))
        .withColumn("tokens", F.array_sort(F.array_distinct(F.transform("_s", lambda b: F.xxhash64(b)))))
        .withColumn("need", F.greatest(F.lit(1), F.size("tokens") - F.col("edits")))
        .withColumn("dense", F.size("_s") <= F.col("edits"))
        .drop("_s")
    )


def dense_keys(records: DataFrame) -> DataFrame:
    """The dense records of :func:`with_keys` with their runs of notes as ``tokens`` and the ``need`` of these.

    A changed note spoils RUN runs at most, or one bar of fewer than LONG notes (a long bar that
    gets short loses all its runs by no fewer changes).  Where no bar is common each of the D short
    bars takes one change, so G runs leave G - RUN (edits - D) common ones.
    """
    parted = F.transform(sounding(F.split("bars", r"\|")), lambda b: F.split(b, " "))
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (RUN - 1)), lambda i: F.xxhash64(F.slice(w, i, RUN)))
    short = F.size(F.filter(F.array_distinct("_w"), lambda w: F.size(w) < LONG))
    return (
        records.where("dense")
        .withColumn("_w", parted)
        .withColumn("tokens", F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter("_w", lambda w: F.size(w) >= LONG), runs)))))
        .where(F.size("tokens") > 0)
        .withColumn("need", F.greatest(F.lit(1), F.size("tokens") + RUN * (short - F.col("edits"))))
        .drop("_w")
    )


def prefix(postings: DataFrame, doc: str, hits: int = 1) -> DataFrame:
    """The rarest tokens of each document, so many that any ``need`` of its tokens must touch ``hits`` of them (``need`` is no less).

    ``postings(doc, need, token, df)`` holds only tokens with a possible partner; those without one
    are the rarest and could be no evidence.  All but the need - hits most frequent tokens are kept.
    """
    keep = F.size("l") - F.col("need") + hits
    return (
        postings.groupBy(doc, "need")
        .agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("l"))
        .where(keep > 0)
        .select(doc, F.explode(F.slice("l", F.lit(1), keep.cast("int"))).alias("p"))
        .select(doc, F.col("p.token").alias("token"))
    )


def _common_run(masks: dict[str, int], length: int, b: list[str]) -> int:
    """Length of the longest common subsequence of a bar, given as the places of each note, and another."""
    full = (1 << length) - 1
    v = full
    for note in b:
        u = v & masks.get(note, 0)
        v = (v + u | v - u) & full
    return length - v.bit_count()


def changed_notes(a: list[str], b: list[str]) -> float:
    """Share of the notes of the record with fewer notes that have no partner in the other, bars in any order."""
    na, nb = (sum(bar.count(" ") + 1 for bar in r) for r in (a, b))
    x, y = (a, b) if na <= nb else (b, a)
    there, own = set(y), set(x)
    # a changed bar's partner is most likely one that stands in the other only
    others = [bar.split(" ") for bar in sorted(there, key=lambda bar: bar in own)]
    found = 0
    for bar in x:
        notes = bar.split(" ")
        if bar in there:
            found += len(notes)
            continue
        masks: dict[str, int] = {}
        for k, note in enumerate(notes):
            masks[note] = masks.get(note, 0) | 1 << k
        best = 0
        for o in others:
            if len(o) > best:
                best = max(best, _common_run(masks, len(notes), o))
            if best >= len(notes) - 1:
                break
        found += best
    return 1 - found / max(min(na, nb), 1)
