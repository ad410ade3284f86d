"""Packing of texts into containers of fixed capacity, by best-two-fit.

Sizes are tokens of a public tokenizer.  A text longer than a container is cut at word ends into
pieces that fill whole containers; all other texts stay whole.  Pieces are dealt at random to shards
of about ``SHARD_ITEMS``; each shard is packed on its own, so the room lost by sharding is at most
part of one container a shard.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.scratch import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenizer pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD_ITEMS = 20_000
_MEMORY = 400_000
#: A word with the blank before it, or white space up to it: no token crosses their ends.
_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_WHOLE = re.compile(r"(?s).+")
#: Characters on which this and the tokenizer's own pattern may differ about being white space.
_UNSURE = re.compile("[\x1c-\x1f\x85​‌‍᠎]")


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter(dict):
    """Tokens of a chunk of text, remembered; words repeat, so most are looked up."""

    def __init__(self, path: str):
        self.encode = encoding(path).encode_ordinary

    def __missing__(self, chunk: str) -> int:
        if len(self) > _MEMORY:
            self.clear()
        n = len(self.encode(chunk))
        if len(chunk) < 64:
            self[chunk] = n
        return n

    def tokens(self, text: str) -> int:
        """Exactly the number of tokens of ``text``."""
        if _UNSURE.search(text):
            return len(self.encode(text))
        return sum(map(self.__getitem__, _CHUNK.findall(text)))

    def pieces(self, text: str, capacity: int) -> list[tuple[int, int, int]]:
        """``(start, end, tokens)`` of consecutive pieces of at most ``capacity`` tokens each.

        They are cut at words, but inside a word that is too long, and anywhere in a text in which
        it is unsure where the tokenizer ends a word.  A capacity below the tokens of one character raises.
        """
        out: list[tuple[int, int, int]] = []
        start = at = size = 0
        for m in (_WHOLE if _UNSURE.search(text) else _CHUNK).finditer(text):
            n = self[m.group()]
            if size + n > capacity and size:
                out.append((start, at, size))
                start, size = at, 0
            if n > capacity:
                inside = m.start()
                while inside < m.end():
                    end = min(m.end(), inside + capacity)
                    while (k := len(self.encode(text[inside:end]))) > capacity:
                        if end - inside == 1:
                            raise ValueError(f"a character of {k} tokens is larger than a container of {capacity}")
                        end = inside + (end - inside) // 2
                    if end < m.end() or k == capacity:
                        out.append((inside, end, k))
                        start, size = end, 0
                    else:
                        start, size = inside, k
                    inside = end
            else:
                size += n
            at = m.end()
        if size:
            out.append((start, len(text), size))
        return out


def sized(docs: DataFrame, capacity: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, piece, start, end, tokens)``: one row a text, or one a piece of a text longer than ``capacity``.  Places count code points.  Null and empty texts have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(vocabulary)
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                n = count.tokens(text)
                if n <= capacity:
                    rows.append((doc, 0, 0, len(text), n))
                else:
                    rows += [(doc, i, s, e, k) for i, (s, e, k) in enumerate(count.pieces(text, capacity))]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "end", "tokens"])

    return (
        docs.where("doc_id is not null and text is not null and text <> ''")
        .select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .mapInArrow(run, "doc_id long, piece int, start long, end long, tokens long")
    )


class _Stock:
    """Items by size, with the largest size in stock not above a bound in constant steps."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        order = np.argsort(sizes, kind="stable")
        cuts = np.searchsorted(sizes[order], np.arange(capacity + 2))
        self.items = [order[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.mask = 0
        for s, items in enumerate(self.items):
            if items:
                self.mask |= 1 << s
        self.left = len(sizes)

    def largest(self, bound: int) -> int:
        """Largest size in stock up to ``bound``, -1 if there is none."""
        return (self.mask & ((1 << (bound + 1)) - 1)).bit_length() - 1 if bound >= 0 else -1

    def take(self, size: int) -> int:
        items = self.items[size]
        item = items.pop()
        if not items:
            self.mask ^= 1 << size
        self.left -= 1
        return item

    def put(self, size: int, item: int) -> None:
        self.items[size].append(item)
        self.mask |= 1 << size
        self.left += 1


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item.

    Each container is filled greedily with the largest item that fits.  If room is left, its
    smallest item is taken out and replaced by the two items in stock that fill the widened gap most
    tightly, provided they leave less room.  An item larger than a container raises.
    """
    if len(sizes) and int(sizes.max()) > capacity:
        raise ValueError(f"an item of {int(sizes.max())} is larger than a container of {capacity}")
    at = np.empty(len(sizes), np.int64)
    stock = _Stock(sizes, capacity)
    bin_no = 0
    while stock.left:
        room, inside = capacity, []
        while (s := stock.largest(room)) >= 0:
            inside.append((s, stock.take(s)))
            room -= s
            if not s and not stock.left:
                break
        if room and inside and stock.left > 1:
            small, item = inside[-1]
            gap = room + small
            stock.put(small, item)
            best, pair = room, None
            first = stock.largest(gap - 1)
            while first * 2 >= gap - best and first > 0:
                held = stock.take(first)
                second = stock.largest(gap - first)
                stock.put(first, held)
                if second > 0 and gap - first - second < best:
                    best, pair = gap - first - second, (first, second)
                    if not best:
                        break
                first = stock.largest(first - 1)
            if pair:
                inside.pop()
                inside += [(s, stock.take(s)) for s in pair]
            else:
                # back to the greedy filling
                inside[-1] = (small, stock.take(small))
        for _, item in inside:
            at[item] = bin_no
        bin_no += 1
    return at


def pack(docs: DataFrame, capacity: int, vocabulary: str = VOCABULARY, seed: int = 0) -> DataFrame:
    """``(doc_id, piece, start, end, tokens, container)`` for every text.

    ``container`` is unique over all shards.  No container holds more than ``capacity`` tokens; only
    texts longer than that are cut.  Repeated rows are packed each.  An empty table gives an empty
    result.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    items = cut(sized(docs, capacity, vocabulary), "sizes")
    shards = max(1, math.ceil(items.count() / SHARD_ITEMS))

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "piece"], ignore_index=True)
        at = best_two_fit(pdf["tokens"].to_numpy(np.int64), capacity)
        return pdf.assign(container=at * shards + pdf["shard"].to_numpy(np.int64))[["doc_id", "piece", "start", "end", "tokens", "container"]]

    return (
        items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "start", F.lit(seed)), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(shard, "doc_id long, piece int, start long, end long, tokens long, container long")
    )


def packing_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, items, tokens, share of the room used, and the least containers possible."""
    return packed.agg(
        F.countDistinct("container").alias("n_containers"), F.count("*").alias("n_items"), F.sum("tokens").alias("n_tokens"),
        F.try_divide(F.sum("tokens"), F.countDistinct("container") * capacity).alias("used"),
        F.ceil(F.sum("tokens") / capacity).alias("least_containers"),
    )
