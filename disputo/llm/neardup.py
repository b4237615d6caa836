"""Problem 6: records that share most of their words.

A size-aware heavy-light set join.  Records with the same words are one set.  Small sets are joined on
fixed-size (two-word) subsets of their rarest words, large sets scan inverted lists of their rarest words;
the boundary between small and large is the one with the lowest estimated cost over all sets.  Both
ways are exact filters, so no pair at or above the threshold is lost, and every candidate is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disputo.llm.components import components
from disputo.llm.copies import fingerprint, labelled_fields
from disputo.llm.forms import consistent_form, words
from disputo.runtime import BROADCAST_ROWS, cut, hot_join, remove, small, store

#: Buckets of the table of word frequencies that orders words from rare to frequent: its size is fixed.
FREQUENCY_BUCKETS = 1 << 18
#: Cost of writing, shuffling and sorting one posting, in steps of an inverted list (a step compares 64 bits of two bitmaps and mostly ends there).
POSTING_COST = 100.0
#: Longs of the bitmap that stands for a set's words in the scan; large sets need many bits to differ.
BITMAP = 2
#: Postings of one signature above which its list is cut into chunks that are scanned pair by pair in tasks of their own.
CHUNK = 1 << 15
#: Pairs compared at a time within a task.
STEP = 1 << 20
#: Sizes above this share one entry in the cost table (the join itself knows every size).
LARGEST_COSTED = 4096


def word_sets(df: DataFrame, src: str, key: str, text: str, shingle: int = 1) -> DataFrame:
    """``src``, ``key``, ``fp_1``, ``fp_2`` (the copy fingerprint), ``tokens`` (hashes of the distinct words), ``set_id`` and ``row_id``.

    ``shingle`` words in a row make one token (1: single words; 5 for shingles of five).  Records without letters
    or digits, NULL texts and NULL keys are left out.  Hashes hold the source, so records of two sources share no token.
    """
    formed = df.select(F.col(src).alias("src"), F.col(key).alias("key"), F.lower(consistent_form(F.col(text))).alias("lowered"))
    formed = formed.where(F.col("key").isNotNull() & F.col("lowered").rlike(r"[\p{L}\p{N}]"))
    if shingle == 1:
        grams = F.array_distinct(words("lowered"))
    else:
        tokens = words("lowered")
        starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - (shingle - 1), F.lit(1)))
        grams = F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, shingle), " ")))
    fields = labelled_fields(F.col("lowered"))
    split = formed.select("src", "key", fields.alias("fields"), F.transform(grams, lambda w: F.xxhash64("src", w)).alias("tokens"))  # used twice, made once
    hashed = split.select("src", "key", fingerprint(F.col("fields"), 11).alias("fp_1"), fingerprint(F.col("fields"), 23).alias("fp_2"), "tokens")
    halves = [F.aggregate("tokens", F.lit(0).cast("long"), lambda s, h: s + f(h)) for f in (lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)), lambda h: F.shiftrightunsigned(h, 32))]
    return hashed.withColumn("set_id", F.xxhash64("src", *halves)).withColumn("row_id", F.xxhash64("src", "key", "fp_1", "set_id"))


def _bucket_counts(sets: DataFrame, pick) -> np.ndarray:
    """How many of the tokens that ``pick`` takes from a batch fall into each hash bucket: an array of fixed length, whatever the data's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FREQUENCY_BUCKETS, dtype=np.int64)
        for batch in batches:
            total += np.bincount(pick(batch) % FREQUENCY_BUCKETS, minlength=FREQUENCY_BUCKETS)
        some = np.flatnonzero(total)
        for k in range(0, len(some), 1 << 16):
            part = some[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["bucket", "n"])

    rows = sets.select("tokens", "n").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(FREQUENCY_BUCKETS, dtype=np.int64)
    table[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return table


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How often the words of each hash bucket occur in all sets."""
    return _bucket_counts(sets, lambda batch: batch.column(0).flatten().to_numpy(zero_copy_only=False))


def _list_lengths(sets: DataFrame, frequency, threshold: float) -> np.ndarray:
    """How long the inverted lists of each hash bucket are: only the rarest words of a set, those that it must share one of, are listed."""

    def pick(batch: pa.RecordBatch) -> np.ndarray:
        tokens, row, position, _ = _ranked(batch, frequency.value)
        n = batch.column(1).to_numpy()
        return tokens[position < (n - np.ceil(threshold * n - 1e-9) + 1)[row]]

    return _bucket_counts(sets, pick)


def _ranked(batch: pa.RecordBatch, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a batch, each set's from rare to frequent; their row, their position in the set, their frequency."""
    lists = batch.column(batch.schema.get_field_index("tokens"))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    size = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(size)), size)
    often = frequency[flat % FREQUENCY_BUCKETS]
    # row, frequency and token in one number: sorted several times faster than by three keys, which decide where two numbers are alike
    width = max(62 - int(len(size)).bit_length() - int(often.max(initial=0)).bit_length(), 0)
    packed = ((row * (int(often.max(initial=0)) + 1) + often) << width) | (flat.view(np.uint64) >> np.uint64(64 - width)).astype(np.int64) if width else np.zeros(len(flat), np.int64)
    order = np.argsort(packed)
    if (np.diff(packed[order]) == 0).any():
        order = np.lexsort((flat.view(np.uint64), often, row))
    return flat[order], row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size), often[order]


def _costs(sets: DataFrame, frequency, lengths, threshold: float) -> list[tuple[int, float, float, int]]:
    """(size, cost by subsets, cost by inverted lists, frequency of the most frequent word in a subset) of all sets of that size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, widest = np.zeros((LARGEST_COSTED + 1, 2)), np.zeros(LARGEST_COSTED + 1, dtype=np.int64)
        for batch in batches:
            tokens, row, position, often = _ranked(batch, frequency.value)
            n = batch.column(batch.schema.get_field_index("n")).to_numpy()
            prefix = n - np.ceil(threshold * n - 1e-9) + 1
            scan = np.bincount(row, weights=lengths.value[tokens % FREQUENCY_BUCKETS] * (position < prefix[row]), minlength=len(n))
            at = np.minimum(n, LARGEST_COSTED)
            np.add.at(total[:, 0], at, POSTING_COST * (prefix + 1) * prefix / 2)
            np.add.at(total[:, 1], at, POSTING_COST * prefix + scan / 2)
            np.maximum.at(widest, at[row], often * (position <= prefix[row]))
        size = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(total[size, 0]), pa.array(total[size, 1]), pa.array(widest[size])], ["n", "subsets", "lists", "widest"])

    costs = sets.select("tokens", "n").mapInArrow(run, "n long, subsets double, lists double, widest long").groupBy("n").agg(F.sum("subsets"), F.sum("lists"), F.max("widest"))
    return sorted((int(n), a, b, w) for n, a, b, w in costs.collect())


def boundary(costs: list[tuple]) -> int:
    """The largest size handled by subsets: the one that makes the sum of both ways' costs smallest."""
    best, at, total = 0, 0, sum(c[2] for c in costs)
    least = total
    for n, subsets, lists, *_ in costs:
        total += subsets - lists
        if total < least:
            least, best = total, n
        at = n
    return min(best, at)


def _postings(sets: DataFrame, frequency, threshold: float, light: int) -> DataFrame:
    """(``signature``, ``set_id``, ``meta``, ``b0`` and so on): the subsets of the light sets, the list entries of all that a heavy set may match.

    A light set (at most ``light`` words) has one posting for each pair of its rarest words, a heavy one for each of its rarest
    words; light sets that a heavy one may match have list entries as well.  meta holds n * 2^33 + position * 8 + side * 2 + free,
    where two postings without free do not meet (light sets met by their subsets) and side is 0 until a list is cut (:func:`_cut_lists`).
    The b columns are a bitmap of all the set's words: words in which two sets differ flip at most one bit each.
    """
    tiny = int(1 / threshold + 1e-9)  # sets of this size or less may share fewer than two words
    names = [f"b{k}" for k in range(BITMAP)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, row, position, _ = _ranked(batch, frequency.value)
            ids = batch.column(batch.schema.get_field_index("set_id")).to_numpy()
            n = batch.column(batch.schema.get_field_index("n")).to_numpy().astype(np.int64)
            if not len(n):
                continue
            least = np.ceil(threshold * n - 1e-9).astype(np.int64)
            heavy = (n > light) | (least < 2)
            starts = np.cumsum(n) - n
            bit, word = np.left_shift(np.uint64(1), (tokens & 63).view(np.uint64)), (tokens >> 6) & (BITMAP - 1)
            bits = [np.bitwise_or.reduceat(np.where(word == k, bit, np.uint64(0)), starts).view(np.int64) for k in range(BITMAP)]
            listed = (n >= threshold * light - 1e-9) | (n <= tiny / threshold)
            take = np.flatnonzero((position < (n - least + 1)[row]) & listed[row])
            for k in range(0, len(take), 1 << 16):
                part = take[k : k + (1 << 16)]
                own = row[part]
                meta = (n[own] << 33) + position[part] * 8 + heavy[own]
                yield pa.RecordBatch.from_arrays([pa.array(tokens[part]), pa.array(ids[own]), pa.array(meta), *[pa.array(b[own]) for b in bits]], ["signature", "set_id", "meta", *names])
            for size in np.unique(n[~heavy]):
                rows = np.flatnonzero(n == size)
                i, j = np.triu_indices(min(int(size - ceil(threshold * size - 1e-9) + 2), int(size)), 1)
                step = max((1 << 16) // max(len(i), 1), 1)
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    first, second = (tokens[starts[some][:, None] + x[None, :]].view(np.uint64) for x in (i, j))
                    with np.errstate(over="ignore"):
                        pair = (first * np.uint64(0x9E3779B97F4A7C15) + second) * np.uint64(0xC2B2AE3D27D4EB4F)
                    pair = (pair ^ (pair >> np.uint64(29))).view(np.int64).ravel()
                    own = np.repeat(some, len(i))
                    meta = np.full(len(own), (int(size) << 33) + 1, dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(ids[own]), pa.array(meta), *[pa.array(b[own]) for b in bits]], ["signature", "set_id", "meta", *names])

    return sets.select("set_id", "tokens", "n").mapInArrow(run, "signature long, set_id long, meta long, " + ", ".join(f"{b} long" for b in names))


def _cut_lists(postings: DataFrame) -> DataFrame:
    """Postings whose signature has more than CHUNK of them, spread over one signature per pair of chunks; all others as they are.

    A list of r chunks becomes r * (r + 1) / 2 lists of at most two chunks: rows of the same chunk meet in the
    chunk's own list, rows of different chunks (side 1 and side 2) in the list of both.  No pair is lost, and none takes one task too long.
    """
    hot = cut(postings.groupBy("signature").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).alias("_r")).where("_r > 1"))
    chunk = F.pmod(F.xxhash64("set_id"), F.col("_r"))
    placed = postings.join(small(hot), "signature", "left").withColumn("_own", F.when(F.col("_r").isNotNull(), chunk))
    placed = placed.withColumn("_other", F.explode(F.when(F.col("_r").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("_r") - 1))))
    side = F.when(F.col("_own") < F.col("_other"), 2).when(F.col("_own") > F.col("_other"), 4).otherwise(0)
    moved = F.xxhash64("signature", F.least("_own", "_other"), F.greatest("_own", "_other"))
    return placed.select(
        F.when(F.col("_r").isNull(), F.col("signature")).otherwise(moved).alias("signature"), "set_id", (F.col("meta") + F.coalesce(side, F.lit(0))).alias("meta"), *[f"b{k}" for k in range(BITMAP)]
    )


def _meetings(rows: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs of one batch of whole lists that pass the filters on size, position and bitmap."""
    signature, ids, meta = rows[:3]
    bits = rows[3:].view(np.uint64)
    n, position, side, free = meta >> 33, (meta >> 3) & ((1 << 30) - 1), (meta >> 1) & 3, meta & 1
    group = np.concatenate([[0], np.cumsum(signature[1:] != signature[:-1])])
    wide = int(n.max()) + 2
    # within a list sizes ascend: a row meets the later rows up to the largest size that can be similar enough
    upto = np.searchsorted(group * wide + n, group * wide + np.minimum(np.floor(n / threshold + 1e-9).astype(np.int64), wide - 1), side="right")
    partners = upto - np.arange(len(n)) - 1
    some = np.flatnonzero(partners > 0)
    ends = np.cumsum(partners[some])
    share = threshold / (1 + threshold)
    at = 0
    while at < len(some):
        stop = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, side="right")), at + 1)
        own, count = some[at:stop], partners[some[at:stop]]
        left = np.repeat(own, count)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
        total = n[left] + n[right]
        differ = np.bitwise_count(bits[0][left] ^ bits[0][right]).astype(np.int64)
        keep = differ <= (1 - 2 * share) * total + 1e-9
        left, right, total, differ = left[keep], right[keep], total[keep], differ[keep]
        for b in bits[1:]:
            differ += np.bitwise_count(b[left] ^ b[right])
        keep = (differ <= (1 - 2 * share) * total + 1e-9) & ((free[left] | free[right]) == 1) & (ids[left] != ids[right])
        keep &= ((side[left] | side[right]) == 0) | ((side[left] ^ side[right]) == 3)
        keep &= np.minimum(n[left] - position[left], n[right] - position[right]) >= share * total - 1e-9
        x, y = ids[left[keep]], ids[right[keep]]
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
        at = stop


def _scan(postings: DataFrame, threshold: float) -> DataFrame:
    """(``a``, ``b``), each once: the sets that meet in a list and pass the filters.  Lists arrive sorted and are scanned one after the other."""
    names = ["signature", "set_id", "meta", *[f"b{k}" for k in range(BITMAP)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((len(names), 0), dtype=np.int64)
        for batch in batches:
            rows = np.concatenate([rest, np.stack([batch.column(k).to_numpy() for k in range(len(names))])], axis=1)
            whole = int(np.searchsorted(rows[0], rows[0, -1])) if rows.shape[1] else 0  # the last list may go on in the next batch
            if whole:
                yield from _meetings(rows[:, :whole], threshold)
            rest = rows[:, whole:].copy()
        if rest.shape[1]:
            yield from _meetings(rest, threshold)

    ordered = postings.repartition("signature").sortWithinPartitions("signature", "meta")
    return ordered.select(*names).mapInArrow(run, "a long, b long").distinct()


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """(``a``, ``b``, ``shared``, ``similarity``) with a < b: sets of ``sets`` (set_id, tokens, n) with Jaccard similarity >= threshold.

    Exact.  Sets share at least ceil(t * n) words of the larger one, so their rarest words must share one word
    (lists) or two (subsets).  Postings of both kinds are shuffled once by signature and scanned there; every pair that
    passes the filters is verified on its words.
    """
    frequency = sets.sparkSession.sparkContext.broadcast(_frequencies(sets))
    lengths = sets.sparkSession.sparkContext.broadcast(_list_lengths(sets, frequency, threshold))
    costs = _costs(sets, frequency, lengths, threshold)
    light = boundary(costs)
    postings = _postings(sets, frequency, threshold, light)
    longest = max([int(lengths.value.max()), *[w for n, _, _, w in costs if n <= light]])  # no list can be longer
    if longest > CHUNK:
        postings = _cut_lists(postings)
    candidates = cut(_scan(postings, threshold))
    involved = candidates.select(F.col("a").alias("set_id")).union(candidates.select("b")).distinct()
    sought = sets.join(small(involved), "set_id", "left_semi")
    first = sought.select(F.col("set_id").alias("a"), F.col("tokens").alias("ta"), F.col("n").alias("na"))
    second = sought.select(F.col("set_id").alias("b"), F.col("tokens").alias("tb"), F.col("n").alias("nb"))
    verified = candidates.join(first, "a").join(second, "b").withColumn("shared", F.size(F.array_intersect("ta", "tb")))
    similarity = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    return verified.select("a", "b", "shared", similarity.alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)


def similar_contents(df: DataFrame, src: str, key: str, text: str, threshold: float = 0.8, shingle: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, classes, members): pairs ``a``, ``b``, ``similarity`` of different word sets, each once; classes ``set_id``, ``fp_1``, the
    contents of each word set; members ``src``, ``key``, ``set_id``, ``fp_1``, the records of each content.  All three are stored.
    """
    records, path = store(word_sets(df, src, key, text, shingle))
    members = cut(records.select("src", "key", "set_id", "fp_1", "row_id").distinct())
    # one row stands for each set: rows of other records with the same words are left out, and the words themselves are not shuffled
    spare = members.groupBy("set_id").agg(F.min("row_id").alias("kept"), F.count(F.lit(1)).alias("k")).where("k > 1").join(members, "set_id").where("row_id <> kept")
    spare = cut(spare.select("row_id").distinct())
    sets = records.join(small(spare, stored=True), "row_id", "left_anti").select("set_id", "tokens").withColumn("n", F.size("tokens"))
    paths = [path]
    if spare.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:  # the words had to be shuffled: once is enough
        sets, path = store(sets)
        paths.append(path)
    pairs = cut(similar_sets(sets, threshold).select("a", "b", "similarity").distinct())
    for path in paths:
        remove(df.sparkSession, path)
    return pairs, cut(members.select("set_id", "fp_1").distinct()), members


def near_duplicates(df: DataFrame, src: str, key: str, text: str, threshold: float = 0.8, shingle: int = 5) -> tuple[DataFrame, DataFrame]:
    """Links between contents, and the records of each content.

    Returns (links, members).  members: ``src``, ``key``, ``set_id``, ``fp_1`` - one row per record; records with the same
    (set_id, fp_1) are exact copies in the sense of problem 5 and form one class.  links: ``a_set``, ``a_fp``, ``b_set``, ``b_fp``,
    ``similarity`` - pairs of classes at or above ``threshold``, each once; no link between different texts is lost and copies
    are not expanded.  NULL, empty and letterless texts have no row; identical word sets of different contents have similarity 1.
    """
    pairs, classes, members = similar_contents(df, src, key, text, threshold, shingle)
    several = classes.groupBy("set_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("set_id")
    moved = classes.join(several, "set_id")
    within = (
        moved.alias("x").join(moved.alias("y"), "set_id").where("x.fp_1 < y.fp_1")
        .select(F.col("set_id").alias("a_set"), F.col("x.fp_1").alias("a_fp"), F.col("set_id").alias("b_set"), F.col("y.fp_1").alias("b_fp"), F.lit(1.0).alias("similarity"))
    )
    across = (
        pairs.join(classes.select(F.col("set_id").alias("a"), F.col("fp_1").alias("a_fp")), "a")
        .join(classes.select(F.col("set_id").alias("b"), F.col("fp_1").alias("b_fp")), "b")
        .where("a_fp <> b_fp")
        .select(F.col("a").alias("a_set"), "a_fp", F.col("b").alias("b_set"), "b_fp", "similarity")
    )
    return within.union(across), members


def class_link_counts(pairs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """:func:`link_counts` from the word sets: contents of a set are counted, not paired, so many contents with the same words cost no more than few."""
    sizes = classes.groupBy("set_id").agg(F.count(F.lit(1)).alias("k"))
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    across = both.join(sizes.withColumnRenamed("set_id", "b"), "b").groupBy("a").agg(F.sum("k").alias("met"))
    # contents that differ in where words are parted only are copies, not links
    copies = both.join(classes.withColumnRenamed("set_id", "a"), "a").join(classes.withColumnRenamed("set_id", "b"), ["b", "fp_1"]).groupBy("a", "fp_1").agg(F.count(F.lit(1)).alias("same"))
    counts = classes.join(sizes, "set_id").join(across.withColumnRenamed("a", "set_id"), "set_id", "left").join(copies.withColumnRenamed("a", "set_id"), ["set_id", "fp_1"], "left")
    n_links = F.col("k") - 1 + F.coalesce("met", F.lit(0)) - F.coalesce("same", F.lit(0))
    return members.select("src", "key", "set_id", "fp_1").join(counts.select("set_id", "fp_1", n_links.alias("n_links")), ["set_id", "fp_1"]).select("src", "key", F.col("fp_1").alias("class_id"), "n_links")


def near_groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """One row per record of a group of two or more: ``src``, ``key``, ``group_key`` (the group's smallest key) and ``n_records``.

    Records with the same words or letters are in one group, and so are records linked by similar word sets, directly or through others.
    Only one link per record joins it to its words and its letters, so no pairs of copies are formed.
    """
    word, letters = F.concat(F.lit("w"), F.col("set_id").cast("string")), F.concat_ws("|", F.lit("f"), "src", F.col("fp_1").cast("string"))
    between = pairs.select(F.concat(F.lit("w"), F.col("a").cast("string")).alias("a"), F.concat(F.lit("w"), F.col("b").cast("string")).alias("b"))
    found = components(between.union(members.select(word.alias("a"), letters.alias("b")).distinct()))
    placed = cut(members.select("src", "key", word.alias("node")).join(found, "node").select("src", "key", "group_id").distinct())
    groups = placed.groupBy("group_id").agg(F.min("key").alias("group_key"), F.countDistinct("key").alias("n_records")).where("n_records > 1")
    return hot_join(placed, groups, ["group_id"], "n_records").select("src", "key", "group_key", "n_records")


def expanded_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(``src``, ``key_a``, ``key_b``), key_a < key_b: the records behind the links, copies expanded."""
    left = members.select(F.col("set_id").alias("a_set"), F.col("fp_1").alias("a_fp"), "src", F.col("key").alias("x"))
    right = members.select(F.col("set_id").alias("b_set"), F.col("fp_1").alias("b_fp"), F.col("key").alias("y"))
    pairs = links.join(left, ["a_set", "a_fp"]).join(right, ["b_set", "b_fp"]).where("x <> y")
    return pairs.select("src", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def link_counts(links: DataFrame, members: DataFrame) -> DataFrame:
    """One row per record: ``src``, ``key``, ``class_id`` and ``n_links``, the number of other contents it is similar to."""
    ends = links.select(F.col("a_set").alias("set_id"), F.col("a_fp").alias("fp_1")).union(links.select("b_set", "b_fp"))
    counts = ends.groupBy("set_id", "fp_1").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(counts, ["set_id", "fp_1"], "left").select("src", "key", F.col("fp_1").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
