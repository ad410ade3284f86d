"""Evaluation texts that stand, wholly or partly, in a training corpus.

A prefix-filtered set join on shingles of ``WORDS`` words:

1. Every corpus text is turned into the hashes of its shingles, a whole Arrow batch at a time, and
   those that stand in some item are kept with their place.
2. Item shingles are ordered by rarity, that is by the number of corpus documents that hold them.
   To reach the threshold a document must share more shingles than an item has outside its prefix,
   so only documents that hit an item's prefix are candidates (necessary prefix tokens).
3. A candidate must have as many shingles as the threshold needs (length bound), at different places
   of the item (positional bound).
4. Within windows of the document of one and a half times the item's length, hits are chained in the
   item's order and the item's words they cover are counted exactly.

A shingle is a hit only if each of its words is the item's word, not only their common hash.
The item set is broadcast in blocks of at most ``BLOCK_SHINGLES`` shingles; larger sets take one
pass over the corpus for each block.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaver.llm.fold import folded_py
from quaver.llm.scratch import cut

WORDS = 5
#: Share of an item's words that must stand in a document; cases share two fifths or more, other documents a sixth or less.
SHARE = 0.3
BLOCK_SHINGLES = 2_000_000
BLOCK_ITEMS = 20_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
#: Longest run of bytes hashed at once; powers of the multiplier are kept for so many places.
_CHUNK = 1 << 20
_powers: list[np.ndarray] = []


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        for base in (_ODD, inverse):
            p = np.full(_CHUNK + 1, base, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers[0], _powers[1]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Byte classes: 1 for bytes of words, 2 for blanks; and lower-case bytes."""
    kind = np.zeros(256, np.uint8)
    lower = np.arange(256, dtype=np.uint8)
    for b in range(256):
        if chr(b).isalnum() and b < 128 or b >= 128:
            kind[b] = 1
        if 65 <= b <= 90:
            lower[b] = b + 32
    for b in b" \t\n\r\x0b\x0c\x00":
        kind[b] = 2
    return kind, lower


_KIND, _LOWER = _tables()
_PUNCTUATION = re.compile(r"[^\w\s]|_")


def _bytes(text: str) -> bytes:
    """Folded UTF-8; beyond ASCII, punctuation is dropped and blanks are made plain here, as the byte classes cannot tell them."""
    if text.isascii():
        return text.encode()
    return " ".join(_PUNCTUATION.sub("", folded_py(text)).split()).encode("utf-8", "replace")


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all ``texts`` and the number of the text of each.

    A word is what stands between blanks, without punctuation, letter case, accents, width and
    look-alikes; runs of nothing but punctuation are no word.
    """
    power, inverse = _power_tables()
    hashes, owners = [], []
    group: list[bytes] = []
    first = size = 0

    def flush(upto: int) -> None:
        nonlocal group, first, size
        if group:
            data = np.frombuffer(b"\x00".join(group) + b"\x00", np.uint8)
            ends = np.cumsum([len(g) + 1 for g in group])
            kind = _KIND[data]
            blank = np.flatnonzero(kind == 2)
            keep = kind == 1
            value = np.where(keep, _LOWER[data].astype(np.uint64) + np.uint64(1), np.uint64(0))
            rank = np.cumsum(keep) - keep  # place among kept bytes
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * power[rank], dtype=np.uint64)))
            start = np.concatenate(([0], blank[:-1] + 1))
            start_rank = rank[np.minimum(start, len(rank) - 1)]
            word = (total[blank] - total[start]) * inverse[start_rank]
            used = np.concatenate(([0], np.cumsum(keep)))
            real = used[blank] > used[start]
            word = word[real]
            word ^= word >> np.uint64(33)
            word *= _MIX
            word ^= word >> np.uint64(29)
            hashes.append(word)
            owners.append(first + np.searchsorted(ends, blank[real], side="right"))
        group, first, size = [], upto, 0

    for i, text in enumerate(texts):
        data = _bytes(text or "")
        if size + len(data) + 1 > _CHUNK:
            flush(i)
        if len(data) + 1 > _CHUNK:  # a very long text goes in pieces cut at blanks, under its own number
            for a, b in _pieces(data):
                group, first = [data[a:b]], i
                flush(i)
            first = i + 1
            continue
        group.append(data)
        size += len(data) + 1
    flush(len(texts))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def _pieces(data: bytes) -> Iterator[tuple[int, int]]:
    """Cuts at blanks; a single word longer than a chunk is cut inside."""
    at = 0
    while at < len(data):
        end = min(at + _CHUNK - 1, len(data))
        if end < len(data):
            blank = max(data.rfind(b, at, end) for b in (b" ", b"\n", b"\t", b"\r"))
            end = blank if blank > at else end
        yield at, end
        at = end


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, text number, place of the first word, words per text)`` of all shingles of ``WORDS`` words."""
    word, owner = word_hashes(texts)
    words = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    return *_shingles(word, owner, words, WORDS), words


def _shingles(word: np.ndarray, owner: np.ndarray, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, text number, place of the first word)`` of all shingles of ``width`` words."""
    n = len(word) - width + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    h = np.full(n, WORDS - width, np.uint64)
    for k in range(width):
        h = h * _ODD + word[k : k + n]
    h ^= h >> np.uint64(31)
    inside = owner[:n] == owner[width - 1 :]
    first = np.concatenate(([0], np.cumsum(words)))[:-1]
    at = np.arange(n)[inside]
    return h[inside].view(np.int64), owner[:n][inside], at - first[owner[:n][inside]]


def item_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`shingle_hashes`; a text of fewer than ``WORDS`` words has one shingle of its own length."""
    word, owner = word_hashes(texts)
    words = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    found = [_shingles(word, owner, words, WORDS)]
    for width in range(1, WORDS):
        h, of, at = _shingles(word, owner, words, width)
        own = words[of] == width
        found.append((h[own], of[own], at[own]))
    return *(np.concatenate(c) for c in zip(*found, strict=True)), words


def _hits(wanted: np.ndarray, widths: list[int], words_of: np.ndarray, first: np.ndarray):
    """For mapInArrow: documents' shingles of ``widths`` words among the sorted ``wanted``, whose words are ``words_of`` from ``first`` on."""
    bits = 22
    sieve = np.zeros(1 << bits, bool)
    sieve[(wanted.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, owner = word_hashes(b["text"].to_pylist())
            words = np.bincount(owner, minlength=b.num_rows) if len(owner) else np.zeros(b.num_rows, np.int64)
            begin = np.concatenate(([0], np.cumsum(words)))[:-1]
            for width in widths:
                h, doc, at = _shingles(word, owner, words, width)
                may = np.flatnonzero(sieve[(h.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)])
                place = np.minimum(np.searchsorted(wanted, h[may]), len(wanted) - 1)
                same = wanted[place] == h[may]
                own = begin[doc[may]] + at[may]
                for k in range(width):  # word by word
                    same &= word[np.minimum(own + k, max(len(word) - 1, 0))] == words_of[np.minimum(first[place] + k, len(words_of) - 1)]
                found = may[same]
                ids = b["doc_id"].to_numpy()[doc[found]]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h[found], pa.int64()), pa.array(at[found], pa.int32())], ["doc_id", "h", "at"])

    return run


def covered(doc_at: np.ndarray, doc_h: np.ndarray, item: dict[int, list[int]], words: int) -> int:
    """Most words of an item covered, within a window of its own length and half of it, by hits that run in the item's order.

    ``doc_at``, ``doc_h``: places and hashes of the document's hits; ``item``: the places of each
    shingle in the item, last first.  Hits are chained by the longest increasing run of item places.
    """
    order = np.argsort(doc_at, kind="stable")
    doc_at, hits = doc_at[order], doc_h[order].tolist()
    span = words + words // 2 + WORDS
    best, seen_to = 0, -1
    starts = np.flatnonzero(np.concatenate(([True], doc_at[1:] != doc_at[:-1]))) if len(doc_at) else []
    for start in starts:
        stop = int(np.searchsorted(doc_at, doc_at[start] + span, side="right"))
        if stop > seen_to:  # else inside a window already judged
            best = max(best, _chain([v for h in hits[start:stop] for v in item[h]]))
            seen_to = stop
        if best >= words:
            break
    return best


def _chain(values: list[int]) -> int:
    """Words covered by the longest strictly increasing run of shingle places."""
    tails: list[int] = []
    index: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
            index.append(i)
        else:
            tails[k], index[k] = v, i
        back[i] = index[k - 1] if k else -1
    total, edge, run = 0, -1, []
    i = index[-1] if index else -1
    while i >= 0:
        run.append(values[i])
        i = back[i]
    for v in reversed(run):
        total += min(WORDS, v + WORDS - max(edge, v))
        edge = v + WORDS
    return total


def leaks(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """``(item_id, doc_id, share)``: documents that hold at least ``share`` of an item's words in its order.

    ``docs(doc_id, text)``, ``items(item_id, text)``; null and empty texts hold and are held by
    nothing; an item of fewer than ``WORDS`` words is found where all of it stands.  Of several items
    under one id the least text counts; documents under one id count as one.
    """
    spark = docs.sparkSession
    known = items.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    n = known.count()
    blocks = max(1, -(-n // BLOCK_ITEMS))
    out = None
    for block in range(blocks):
        part = known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else known
        pdf = part.toPandas()  # at most about BLOCK_ITEMS items
        h, owner, at, words = item_shingles(pdf["text"].tolist())
        word = word_hashes(pdf["text"].tolist())[0]
        begin = np.concatenate(([0], np.cumsum(words)))[:-1]
        table = pd.DataFrame({"item_id": pdf["item_id"].to_numpy(np.int64)[owner], "h": h, "item_at": at.astype(np.int32), "words": words[owner].astype(np.int32), "first": (begin[owner] + at).astype(np.int64)})
        cuts = range(0, max(len(h), 1), BLOCK_SHINGLES)
        for c in cuts:
            some = _leaks_of(spark, docs, table if len(cuts) == 1 else table[table["item_id"].isin(_slice_ids(table, c))], word, share)
            out = some if out is None else out.unionByName(some)
    return out


def _slice_ids(table: pd.DataFrame, start: int) -> np.ndarray:
    """Items whose first shingle lies in the block that begins at ``start``: an item is never parted."""
    first = table.reset_index(drop=True).reset_index().groupby("item_id")["index"].min()
    return first[(first >= start) & (first < start + BLOCK_SHINGLES)].index.to_numpy()


def _leaks_of(spark, docs: DataFrame, table: pd.DataFrame, word: np.ndarray, share: float) -> DataFrame:
    wanted, where = np.unique(table["h"].to_numpy(np.int64), return_index=True)
    first = table["first"].to_numpy(np.int64)[where]
    widths = sorted({WORDS, *table["words"].clip(upper=WORDS).tolist()})
    schema = "item_id long, h long, places int, words int"
    per = table.groupby(["item_id", "h"], as_index=False).agg(places=("item_at", "size"), words=("words", "max"))
    places = spark.createDataFrame(per.astype({"places": "int32"}), schema) if len(per) else spark.createDataFrame([], schema)
    if not len(wanted):
        wanted, first, word = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.uint64)
    hits = cut(
        docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_hits(wanted, widths, word, first), "doc_id long, h long, at int").distinct(),
        "hits",
    )
    rarity = hits.groupBy("h").agg(F.countDistinct("doc_id").alias("df"))
    # a document that covers share * words of an item by runs of shingles has at least this many places of
    # it; a shingle counts by its places.  Left out are the most frequent shingles that have fewer places together
    need = F.greatest(F.lit(1), F.ceil(F.col("words") * share / WORDS).cast("int"))
    later = Window.partitionBy("item_id").orderBy(F.desc("df"), F.desc("h"))
    ranked = (
        places.join(rarity, "h", "left")
        .withColumn("df", F.coalesce("df", F.lit(0)))
        .withColumn("upto", F.sum("places").over(later))
        .where(F.col("upto") >= need)
        .select("item_id", need.alias("need"), "h")
    )
    small = F.broadcast if len(table) <= BLOCK_SHINGLES else (lambda x: x)
    may = hits.join(small(ranked), "h").select("item_id", "doc_id").distinct()
    both = hits.join(may, "doc_id").join(small(places), ["item_id", "h"]).select("item_id", "doc_id", "at", "h", "places", "words")
    # an item's places of each shingle are looked up where its document is judged: a row here is a place of the document
    of_item: dict[int, dict[int, list[int]]] = {}
    for i, h, at in table.sort_values("item_at", ascending=False)[["item_id", "h", "item_at"]].itertuples(index=False, name=None):
        of_item.setdefault(i, {}).setdefault(h, []).append(at)
    held = spark.sparkContext.broadcast(of_item)  # at most BLOCK_SHINGLES places

    @F.pandas_udf(T.DoubleType())
    def judged(item_id: pd.Series, at: pd.Series, h: pd.Series, words: pd.Series) -> pd.Series:
        rows = zip(item_id, at, h, words, strict=True)
        return pd.Series([min(covered(np.asarray(a), np.asarray(x), held.value[int(i)], int(w)) / max(int(w), 1), 1.0) for i, a, x, w in rows], dtype=float)

    # length bound: places of the item that the document's different shingles have together, before any window is looked at
    enough = both.groupBy("item_id", "doc_id", "h").agg(F.max("places").alias("places"), F.max("words").alias("words"), F.collect_list("at").alias("at"))
    return (
        enough.groupBy("item_id", "doc_id")
        .agg(F.max("words").alias("words"), F.sum("places").alias("k"), F.flatten(F.collect_list("at")).alias("at"), F.flatten(F.collect_list(F.transform("at", lambda _: F.col("h")))).alias("h"))
        .where(F.col("k") >= F.greatest(F.lit(1), F.ceil(F.col("words") * share / WORDS).cast("int")))
        .select("item_id", "doc_id", judged("item_id", "at", "h", "words").alias("share"))
        .where(F.col("share") >= share)
    )
