"""One consistent form for text that looks the same but differs in its characters.

The form is a confusables skeleton: canonical decomposition, every character replaced by its
prototype, decomposition again; at the end characters are composed, so that a plain text is its own
form.  Prototypes join what a reader cannot tell apart (width, kinds of blank, invisible characters,
letters of other scripts that look Latin) and keep letter case, accents and digits apart.

Prototypes for width, fonts, ligatures and blanks follow from the Unicode database by rule; those of
all other characters from Unicode's own list of confusables, which ICU holds in Spark's class path.
That list also joins what must stay apart here (l, I and 1; O and 0; m and rn), so only characters
beyond ASCII are replaced, each by one character of its own kind.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.llm.fold import LOOK_ALIKE, SAME_LOOK, is_invisible
from quaver.llm.scratch import cut

_LIGATURES = range(0xFB00, 0xFB07)


def _set_apart(cp: int) -> bool:
    """Ideographs, Hangul syllables and surrogates, which have no prototypes."""
    return 0x3400 <= cp < 0x4DC0 or 0x4E00 <= cp < 0xA000 or 0xAC00 <= cp < 0xE000


@lru_cache(maxsize=None)
def prototypes() -> dict[int, str]:
    """Code point to prototype, for every character that has another one than itself.  Line feeds and tabs keep their place."""
    table: dict[int, str] = {}
    for cp in range(0x80, 0x110000):
        if _set_apart(cp) or 0x20000 <= cp <= 0xE0000:
            continue
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Co"):
            continue
        if is_invisible(ch):
            table[cp] = ""
        elif kind == "Zs":
            table[cp] = " "
        elif ch in LOOK_ALIKE:
            table[cp] = LOOK_ALIKE[ch]
        else:
            how = unicodedata.decomposition(ch).split(" ")
            if how[0] in SAME_LOOK or cp in _LIGATURES:
                same = unicodedata.normalize("NFKC", ch)
                table[cp] = "".join(LOOK_ALIKE.get(c, c) for c in same)
    table[0x2010] = table[0x2011] = "-"
    return table


def _kind(ch: str) -> tuple[str, str]:
    kind = unicodedata.category(ch)
    return ("S" if kind[0] in "PS" else kind[0]), kind


_tables: dict[str, dict[int, str]] = {}


def confusables(spark: SparkSession) -> dict[int, str]:
    """:func:`prototypes` and, for every other character, the one that Unicode's list of confusables names.

    A character that looks like one of ASCII takes that one; of several (l, I, 1 and | are one in
    the list) the one of its own category.  Combining marks and characters whose prototype has
    several letters stay.
    """
    if _tables:
        return _tables["all"]
    ascii_, more = [chr(c) for c in range(0x21, 0x7F)], []
    for cp in range(0xA0, 0x20000):
        ch = chr(cp)
        if _set_apart(cp) or cp in prototypes() or unicodedata.category(ch) in ("Cn", "Co", "Cc", "Mn", "Mc", "Me") or unicodedata.normalize("NFD", ch) != ch:
            continue
        more.append(ch)
    checker = getattr(spark.sparkContext._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
    looks_of = dict(zip([*ascii_, *more], checker.getSkeleton("\n".join([*ascii_, *more])).split("\n"), strict=True))
    same: dict[str, list[str]] = {}
    for ch in ascii_:
        same.setdefault(looks_of[ch], []).append(ch)
    table = dict(prototypes())
    for ch in more:
        look, (major, kind) = looks_of[ch], _kind(ch)
        if look in same:
            table[ord(ch)] = min(same[look], key=lambda c: (_kind(c)[1] != kind, _kind(c)[0] != major, ord(c)))
        elif len(look) == 1 and look != ch and _kind(look)[1] == kind:
            table[ord(ch)] = table.get(ord(look), look)
    return _tables.setdefault("all", table)


def skeleton(text: str, table: dict[int, str] | None = None) -> str:
    """The consistent form of ``text`` by ``table`` (of :func:`confusables`; without one by rule alone); applied to a form it changes nothing."""
    if text.isascii():
        return text.replace("\r\n", "\n") if "\r" in text else text
    table = prototypes() if table is None else table
    once = unicodedata.normalize("NFD", text).translate(table)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", once).translate(table)).replace("\r\n", "\n")


def forms(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, form)``: the consistent form of every text; null stays null, empty stays empty."""
    table = confusables(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if t is None else skeleton(t, table) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(out, pa.string())], ["doc_id", "form"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, form string")


def looks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, look_hi, look_lo, stored)``: 128-bit hash of the form and 64-bit hash of the text as stored, for rows with text."""
    table = confusables(docs.sparkSession)

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hi, lo, raw = [], [], []
            for t in b["text"].to_pylist():
                h = xxhash.xxh3_128_intdigest(skeleton(t, table).encode("utf-8", "surrogatepass"))
                hi.append(signed(h >> 64))
                lo.append(signed(h & (1 << 64) - 1))
                raw.append(signed(xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"))))
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(x, pa.int64()) for x in (hi, lo, raw))], ["doc_id", "look_hi", "look_lo", "stored"])

    return (
        docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
        .select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        .mapInArrow(run, "doc_id long, look_hi long, look_lo long, stored long")
    )


def look_alikes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_a, doc_b)``: pairs of documents that look the same but are not stored the same, smaller id first.

    Documents without text pair with nothing; exact copies of each other are no pair, but each of
    them pairs with every look-alike.  Only looks stored in two or more ways reach the join, which
    pairs ways of storing; their documents are put in at the end.
    """
    seen = cut(looks(docs, doc_id, text).distinct(), "looks")
    look = ["look_hi", "look_lo"]
    ways = seen.select(*look, "stored").distinct()
    varied = ways.groupBy(*look).agg(F.count("*").alias("n")).where("n > 1").select(*look)
    kept = cut(seen.join(varied, look), "varied")
    one = kept.select(*look, F.col("stored").alias("a")).distinct()
    two = kept.select(*look, F.col("stored").alias("b")).distinct()
    side = lambda way, name: kept.select(*look, F.col("stored").alias(way), F.col("doc_id").alias(name))
    return (
        one.join(two, look).where("a < b")
        .join(side("a", "x"), [*look, "a"])
        .join(side("b", "y"), [*look, "b"])
        .where("x <> y")
        .select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
        .distinct()
    )
