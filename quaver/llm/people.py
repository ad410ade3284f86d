"""Composer names: one key per person, whatever way the name is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.llm.fold import folded

# Folded spellings that stand for "not known".
NOT_KNOWN = ["", "?", "??", "???", "-", "--", "n.n.", "n. n.", "nn", "<unk>", "unk", "anon", "anon.", "anonym", "anonymous", "anonimo", "anonyme", "[anonymous]", "(anonymous)", "not known", "unknown", "unknown composer", "none", "null", "n/a", "n.a.", "s.s.", "s.n."]


def name_parts(c: Column) -> Column:
    """``struct(sur, given array)`` of a name, null if it is not known.

    Understands "Given Sur", "Sur, Given", "G. H. Sur", "Sur G.H.", "Sur", years in brackets, any
    letter case, accents, stray blanks.
    """
    bare = F.trim(F.regexp_replace(folded(c), r"\([^)]*\)?", " "))
    dotted = F.regexp_replace(bare, r"\.\s*", ". ")
    words = F.filter(F.split(F.regexp_replace(dotted, ",", " , "), r"\s+"), lambda w: w != "")
    comma = F.array_position(words, ",")
    n = F.size(words)
    no_comma = F.filter(words, lambda w: w != ",")
    m = F.size(no_comma)
    sur = (
        F.when(comma > 1, F.array_join(F.slice(words, F.lit(1), F.greatest(comma.cast("int") - 1, F.lit(1))), " "))
        .when(F.element_at(no_comma, -1).endswith("."), F.element_at(no_comma, 1))
        .otherwise(F.element_at(no_comma, -1))
    )
    given = (
        F.when(comma > 1, F.slice(words, comma.cast("int") + 1, n))
        .when(F.element_at(no_comma, -1).endswith("."), F.slice(no_comma, F.lit(2), n))
        .otherwise(F.slice(no_comma, F.lit(1), F.greatest(m - 1, F.lit(0))))
    )
    known = c.isNotNull() & ~folded(c).isin(NOT_KNOWN) & ~bare.isin(NOT_KNOWN) & (m > 0)
    return F.when(known, F.struct(sur.alias("sur"), given.alias("given")))


def with_person(df: DataFrame, name: str) -> DataFrame:
    """Adds ``sur``, ``ini`` (initials), ``full`` (all given names, or null for a shortened name) and
    ``as_written`` (a key for the form, null for unknown)."""
    p = F.col("_p")
    short = (F.size(p["given"]) == 0) | F.exists(p["given"], lambda w: w.endswith(".") | (F.length(w) == 1))
    return (
        df.withColumn("_p", name_parts(F.col(name)))
        .withColumn("sur", p["sur"])
        .withColumn("ini", F.array_join(F.transform(p["given"], lambda w: F.substring(w, 1, 1)), ""))
        .withColumn("full", F.when(p.isNotNull() & ~short, F.array_join(p["given"], " ")))
        .withColumn("as_written", F.when(p.isNotNull(), F.concat_ws("|", "sur", F.when(short, F.concat(F.lit("~"), "ini")).otherwise(F.col("full")))))
        .drop("_p")
    )


def persons(forms: DataFrame) -> DataFrame:
    """``(as_written, person)`` for distinct ``forms(sur, ini, full, as_written)``.

    A shortened form is the only full name it fits.  One that fits none stands for itself (initials)
    or for the only initials of its surname; one that fits several has person null.
    """
    whole = forms.where("full is not null").select("sur", "ini", "as_written").distinct()
    short = forms.where("full is null and as_written is not null").select("sur", "ini", "as_written").distinct()

    def resolve(some: DataFrame, against: DataFrame) -> DataFrame:
        fits = (F.col("s.sur") == F.col("w.sur")) & F.col("w.ini").startswith(F.col("s.ini"))
        return (
            some.alias("s")
            .join(against.alias("w"), fits, "left")
            .groupBy(F.col("s.sur").alias("sur"), F.col("s.ini").alias("ini"), F.col("s.as_written").alias("as_written"))
            .agg(F.count("w.as_written").alias("n"), F.min("w.as_written").alias("one"))
            .withColumn("person", F.when(F.col("n") == 1, F.col("one")).when(F.col("n") == 0, F.col("as_written")))
        )

    initials = resolve(short.where("ini <> ''"), whole)
    own = initials.where("n = 0").select("sur", "ini", "as_written")
    surnames = resolve(short.where("ini = ''"), whole.unionByName(own))
    done = initials.unionByName(surnames).select("as_written", "person")
    return whole.select("as_written", F.col("as_written").alias("person")).unionByName(done)
