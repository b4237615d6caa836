"""Problem 8: passages of evaluation texts inside training texts, by greedy string tiling.

Words are hashed; a running Karp-Rabin hash over ``min_words`` words gives the seeds; seeds that documents and items
share are joined; per (document, item) the longest matches that do not overlap are marked again and again, so
passages are found in any order; the marked words give the item's coverage.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disputo.llm.forms import consistent_form, words
from disputo.runtime import cut, small

#: Up to this many seeds of the items, documents are filtered by them before the join (8 bytes each, sent to every executor).
SEED_FILTER = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    formed = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), consistent_form(F.col(text)).alias("form"))
    return formed.select("key", F.transform(words("form"), lambda w: F.xxhash64(w)).alias("tokens"))


def running_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2^64) of all runs of ``width`` tokens."""
    if len(tokens) < width:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(tokens) - width + 1, dtype=np.uint64)
        for k in range(width):
            out = out * _BASE + tokens[k : len(tokens) - width + 1 + k]
        out ^= out >> np.uint64(31)
    return out


def seeds(tokens: DataFrame, width: int, wanted=None) -> DataFrame:
    """(``key``, ``position``, ``seed``) of all runs of ``width`` words, only those in ``wanted`` (a sorted broadcast array) if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            size = np.diff(lists.offsets.to_numpy())
            start = np.cumsum(size) - size
            row = np.repeat(np.arange(len(size)), size)
            hashes = running_hashes(flat, width).view(np.int64)
            at = np.arange(len(hashes))
            position = at - start[row[: len(hashes)]] if len(hashes) else at
            keep = position + width <= size[row[: len(hashes)]] if len(hashes) else np.empty(0, dtype=bool)
            if wanted is not None and len(hashes):
                sought = wanted.value
                found = np.minimum(np.searchsorted(sought, hashes), len(sought) - 1)
                keep &= (sought[found] == hashes) if len(sought) else False
            at = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[at])), pa.array(position[at].astype(np.int32)), pa.array(hashes[at])], ["key", "position", "seed"])

    kind = tokens.schema["key"].dataType.simpleString()
    return tokens.mapInArrow(run, f"key {kind}, position int, seed long")


def tile(matches: list[tuple[int, int, int]], min_words: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (document start, item start, length) of matches, longest first, none overlapping another."""
    tiles: list[tuple[int, int, int]] = []
    marked_d: set[int] = set()
    marked_i: set[int] = set()
    queue = [(-n, d, i) for d, i, n in matches]
    heapify(queue)
    while queue:
        n, d, i = heappop(queue)
        free = [k for k in range(-n) if d + k not in marked_d and i + k not in marked_i]
        if len(free) == -n:
            tiles.append((d, i, -n))
            marked_d.update(range(d, d - n))
            marked_i.update(range(i, i - n))
            continue
        runs: list[list[int]] = []
        for k in free:
            if runs and runs[-1][1] == k - 1:
                runs[-1][1] = k
            else:
                runs.append([k, k])
        for a, b in runs:
            if b - a + 1 >= min_words:
                heappush(queue, (a - b - 1, d + a, i + a))
    return tiles


def _tiled(hits: DataFrame, min_words: int) -> DataFrame:
    """(``key``, ``item``, ``tiles``, ``longest``, ``covered``) of hits (key, item, position, at): sorted by document and item, read as a stream of Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def tiles(table: pa.Table) -> pa.RecordBatch:
            keys, items = table.column("key").combine_chunks(), table.column("item").combine_chunks()
            position, at = table.column("position").to_numpy(), table.column("at").to_numpy()
            same = np.asarray(pc.and_(pc.equal(keys[1:], keys[:-1]), pc.equal(items[1:], items[:-1])))
            new = np.r_[True, ~same]
            joined = ~new[1:] & (np.diff(position - at) == 0) & (np.diff(position) == 1)  # the next word on the same diagonal
            starts = np.flatnonzero(np.r_[True, ~joined])
            lengths = np.diff(np.r_[starts, len(position)]) + min_words - 1
            first = np.flatnonzero(new)
            which = np.searchsorted(first, starts, side="right") - 1
            found = []
            for group in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(which)) + 1):
                own = [(int(position[starts[g]]), int(at[starts[g]]), int(lengths[g])) for g in group]
                marked = own if len(own) == 1 else tile(own, min_words)
                found.append((len(marked), max(m[2] for m in marked), sum(m[2] for m in marked)))
            numbers = [pa.array(c, type=pa.int32()) for c in zip(*found)]
            return pa.RecordBatch.from_arrays([keys.take(pa.array(first)), items.take(pa.array(first)), *numbers], ["key", "item", "tiles", "longest", "covered"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            if not len(table):
                continue
            key = table.column("key").combine_chunks()
            last = len(key) - int(pc.sum(pc.cast(pc.equal(key, key[-1]), "int64")).as_py())  # the last document may go on in the next batch
            if last:
                yield tiles(table.slice(0, last))
            rest = table.slice(last)
        if rest is not None and len(rest):
            yield tiles(rest)

    kinds = dict(hits.dtypes)
    ordered = hits.repartition("key").select("key", "item", "position", "at", (F.col("position") - F.col("at")).alias("diagonal")).sortWithinPartitions("key", "item", "diagonal", "position")
    return ordered.select("key", "item", "position", "at").mapInArrow(run, f"key {kinds['key']}, item {kinds['item']}, tiles int, longest int, covered int")


def leaks(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", min_words: int = 13, min_coverage: float = 0.0) -> DataFrame:
    """One row per document and item that share a passage of at least ``min_words`` words.

    Columns ``doc_key``, ``item_key``, ``tiles``, ``longest`` (words), ``covered`` (words of the item that tiles cover), ``item_words``,
    ``coverage``; only rows with coverage >= ``min_coverage``.  NULL and empty texts, and texts below ``min_words`` words, share
    nothing.  Repeated keys give one row.  Every document is read whole; documents without a shared seed leave in
    their own task, so what is shuffled follows the leaks, not the corpus.
    """
    item_tokens = cut(_tokens(items.select(item_key, text), item_key, text).dropDuplicates(["key"]))
    item_seeds = cut(seeds(item_tokens, min_words).select(F.col("key").alias("item"), F.col("position").alias("at"), "seed"))
    sought = item_seeds.select("seed").distinct()
    filtered = None
    if sought.limit(SEED_FILTER + 1).count() <= SEED_FILTER:
        filtered = documents.sparkSession.sparkContext.broadcast(np.sort(sought.toPandas()["seed"].to_numpy(dtype=np.int64)))
    found = seeds(_tokens(documents.select(doc_key, text), doc_key, text), min_words, filtered)
    hits = found.join(small(item_seeds, SEED_FILTER, stored=True), "seed").select("key", "item", "position", "at").distinct()
    sizes = item_tokens.select(F.col("key").alias("item"), F.size("tokens").alias("item_words"))

    tiled = _tiled(hits, min_words)
    joined = tiled.join(small(sizes), "item").withColumn("coverage", F.col("covered") / F.col("item_words"))
    return joined.where(F.col("coverage") >= min_coverage).select(F.col("key").alias(doc_key), F.col("item").alias(item_key), "tiles", "longest", "covered", "item_words", "coverage")
