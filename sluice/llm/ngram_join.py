"""Similarity join on word n-grams (Jaccard), by vertical partitioning.

All n-grams stand in one global order: ordinary ones by their hash, and after
them those that a count over all documents finds common, the commonest last.
The order is cut into fragments, and a document's set with it.

Candidates.  Two sets that reach the threshold share an n-gram of both their
prefixes: the first n-grams in the order, one more than may differ.  So the
documents of one n-gram's list are all that can link through it, and as common
n-grams come last, a passage that many documents share makes no list.  First
each document of a list meets the least one, and what links is one component;
then, in lists that still hold several components, documents of different
components meet.  Pairs whose sizes, or whose sketches (parities of the counts
in some classes of n-grams, which differ in no more classes than the sets in
n-grams), show that they cannot reach the threshold go no further; sets of many
n-grams have a wider sketch, which is looked at last.

Verification.  The sets of the pairs left are cut into the fragments of the
order.  For each pair the partial overlap of every fragment is counted by itself,
and the counts are summed per pair; the sum decides.

Nothing is left to chance: prefixes, sizes and sketches only rule out pairs that
cannot link, whatever the counts of common n-grams are.  Equal sets are one
from the start.  A group of near copies costs a row per document and list, and a
pair only where documents of different components pass the sketch.  In the lists
that remain for the second step the sketches of CHUNK documents at a time are
compared with each other, which is quadratic in a list whose documents neither
link nor are told apart by the order.

Words are known by 64 bits of BLAKE2b, n-grams by a mixed linear combination of
those, sets by 128 bits of BLAKE2b over their n-grams.

Edge cases: words are runs of bytes other than space, tab, line feed, vertical
tab, form feed and carriage return, with A-Z in lower case; with fewer words
than an n-gram has, the whole text is one n-gram; a null or empty text has no
n-gram and no link; a null id is kept, with a null component; rows with one id
are one document and each gives a row, and where their texts differ the
document's set is the one with the least digest, while n_shingles is the row's
own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import BASE, bitmap, drop_path, give_back, in_bitmap, light_batches, mix, written
from sluice.llm.components import connected

#: Fragments of the ordinary n-grams; the common ones are one more.
FRAGMENTS = 4
#: Classes of a sketch, and of the wider one that sets of more n-grams than the first has classes have too.
SKETCH_BITS, WIDE_BITS = 1 << 11, 1 << 15
#: Documents of a list whose sketches are compared in one place, and sketches of a place compared at once.
CHUNK, AT_ONCE = 2048, 64
#: Bytes of text parsed at once, words whose hashes a task keeps.
SLICE_BYTES, KNOWN_WORDS = 4 << 20, 1 << 17
#: How many n-grams a task and the whole count may call common, and the least count of a task's: what is sent to all tasks is bounded by COMMON.
COMMON, LEAST_COUNT = 1 << 16, 4


class Words(dict):
    """Hashes of words, kept as long as there are not too many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = value = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return value


def shingles(texts: pa.Array, width: int, words: Words) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-grams of words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    sizes = np.asarray(pc.list_value_length(lists))
    known = lists.flatten().dictionary_encode()
    names, code = known.dictionary.to_pylist(), np.asarray(known.indices)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    if "" in names:  # before and after white space at the ends
        real = code != names.index("")
        code, owner = code[real], owner[real]
    word = np.fromiter(map(words.__getitem__, names), np.uint64, len(names))[code]
    counts = np.bincount(owner, minlength=len(sizes))
    edges = np.concatenate([[0], np.cumsum(counts)])
    rolled = _rolled(word, width)
    out = []
    for k, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        if lo == hi:
            out.append(np.empty(0, np.uint64))
        elif counts[k] < width:
            out.append(mix(_rolled(word[lo:hi], hi - lo) + np.uint64(hi - lo)))
        else:
            own = np.sort(rolled[lo : hi - width + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
    return out


def _rolled(word: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of width words."""
    n = len(word) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        out = out * np.uint64(BASE) + word[k : k + n]
    return mix(out)


def _slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most SLICE_BYTES of the text column, or of one row."""
    for batch in batches:
        sums, at = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            yield batch.slice(at, to - at)
            at = to
        give_back()


# -- the global order --------------------------------------------------------


def common(docs: DataFrame, text_col: str, width: int) -> np.ndarray:
    """The commonest n-grams by the documents they are in, from the least common on.

    Tasks count in bounded memory: what a slice holds only once is forgotten, and every slice takes one from each count kept.
    The counts only order n-grams; a wrong one costs time, not links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, times, words = np.empty(0, np.uint64), np.empty(0, np.int64), Words()
        for batch in _slices(batches, 0):
            own, n = np.unique(np.concatenate([np.empty(0, np.uint64), *shingles(batch.column(0), width, words)]), return_counts=True)
            held, at = np.unique(np.concatenate([held, own[n > 1]]), return_inverse=True)
            times = np.bincount(at, np.concatenate([times, n[n > 1]]), len(held)).astype(np.int64)
            held, times = held[times > 1], times[times > 1] - 1
        kept = np.flatnonzero(times + 1 >= LEAST_COUNT)
        kept = kept[np.argsort(times[kept], kind="stable")[-COMMON:]]
        yield pa.RecordBatch.from_arrays([pa.array(held[kept].view(np.int64)), pa.array(times[kept])], names=["token", "n"])

    found = docs.select(text_col).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    held, path = written(found.orderBy(F.desc("n"), "token").limit(COMMON), "common")  # not gathered by the driver, to which every task would send COMMON of them
    top = held.toPandas().sort_values(["n", "token"], ascending=[False, True])
    drop_path(docs.sparkSession, path)
    return top["token"].to_numpy(np.int64).view(np.uint64)[::-1].copy()


class Order:
    """Where n-grams stand in the global order."""

    def __init__(self, common: np.ndarray):
        by_hash = np.argsort(common)
        self.common, self.place = common[by_hash], by_hash + 1

    def ranks(self, tokens: np.ndarray) -> np.ndarray:
        """0 for ordinary n-grams, else the place among the common ones."""
        if not len(self.common):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.common, tokens), len(self.common) - 1)
        return np.where(self.common[at] == tokens, self.place[at], 0)

    def fragments(self, tokens: np.ndarray) -> list[np.ndarray]:
        """A sorted set cut into its fragments."""
        ordinary = self.ranks(tokens) == 0
        first = tokens[ordinary]
        cuts = np.searchsorted(first >> np.uint64(32), np.arange(FRAGMENTS + 1, dtype=np.uint64) * np.uint64((1 << 32) // FRAGMENTS))
        return [*(first[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)), tokens[~ordinary]]


def prefix(tokens: np.ndarray, ranks: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first n-grams of a set in the global order: one more than may be missing from a similar set."""
    size = len(tokens) + num * len(tokens) // -den + 1
    return tokens[np.argsort(ranks, kind="stable")[:size]] if ranks.any() else tokens[:size]


def sketch(tokens: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """The parity of the number of n-grams in each class."""
    return np.packbits(np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def may_link(n: np.ndarray, m: np.ndarray, apart: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of n and m n-grams whose sketches are so many bits apart can reach the threshold."""
    both = (n + m - apart) // 2
    return den * both >= num * (n + m - both)


# -- candidates --------------------------------------------------------------


def parsed(docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int, order: np.ndarray) -> DataFrame:
    """(doc_id, n_shingles, digest, sketch, wide, prefix) of each row; all but the first two are null for empty sets, and wide for sets of few n-grams."""
    held = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, words = Order(held.value), Words()
        for batch in _slices(batches, 1):
            sets = shingles(batch.column(1), width, words)
            sizes = np.array([len(s) for s in sets])
            ranks, ends = place.ranks(np.concatenate(sets)), np.cumsum(sizes)
            first = [prefix(s, ranks[e - len(s) : e], num, den) for s, e in zip(sets, ends.tolist(), strict=True)]
            cuts = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in first])]), pa.int32(), mask=np.append(sizes == 0, False))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([sketch(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([sketch(s, WIDE_BITS) if len(s) > SKETCH_BITS else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(first).view(np.int64))),
                ],
                names=["doc_id", "n_shingles", "digest", "sketch", "wide", "prefix"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, sketch binary, wide binary, prefix array<long>")


def starred(lists: DataFrame, num: int, den: int) -> DataFrame:
    """(a, n_a, b, n_b): a document and the least one of a list it is in, if their sizes allow a link; lists has (token, rep, n, pivot, n_pivot)."""
    pairs = lists.filter(F.col("rep") != F.col("pivot")).select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("pivot").alias("b"), F.col("n_pivot").alias("n_b"))
    return pairs.filter(den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b")).distinct()


def sifted(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) of (a, n_a, b, n_b) that their widest sketches let through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = np.asarray(batch.column(1)), np.asarray(batch.column(3))
            wide = np.asarray(pc.and_(batch.column(5).is_valid(), batch.column(7).is_valid()))
            apart = np.zeros(batch.num_rows, np.int64)
            for rows, left, right in ((wide, 5, 7), (~wide, 4, 6)):
                if rows.any():
                    x, y = (_bits(batch.column(k).filter(pa.array(rows))) for k in (left, right))
                    apart[rows] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            keep = pa.array(may_link(n, m, apart, num, den))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 2)], names=["a", "b"])

    side = lambda name: sets.select(F.col("rep").alias(name), F.col("sketch").alias(f"sketch_{name}"), F.col("wide").alias(f"wide_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "n_a", "b", "n_b", "sketch_a", "wide_a", "sketch_b", "wide_b").mapInArrow(run, "a long, b long")


def _bits(column: pa.Array) -> np.ndarray:
    """Sketches of one width as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def across(lists: DataFrame, sets: DataFrame, parts: DataFrame, num: int, den: int) -> DataFrame:
    """(a, n_a, b, n_b): documents that share a list, are of different components and may link; lists has (token, rep, n, pivot, docs).

    A list of many documents is dealt to chunks, and every two chunks meet in a place of their own.
    """
    placed = lists.filter((F.col("docs") > 2) & (F.col("rep") != F.col("pivot"))).join(parts.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("token").agg(F.min("component").alias("_least"), F.max("component").alias("_most")).filter(F.col("_least") != F.col("_most")).select("token")
    rows = placed.join(mixed, "token").join(sets.select("rep", "sketch"), "rep")
    chunks = F.ceil(F.col("docs") / CHUNK)
    own = F.pmod(F.xxhash64("rep"), chunks)
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    rows = rows.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "component", "n", "sketch")

    def met(rep: np.ndarray, part: np.ndarray, n: np.ndarray, own: np.ndarray, one: bool, bits: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """The pairs of one place; its documents stand by size, so that those a document can link with follow it closely."""
        upto = np.searchsorted(n, n * den // num, side="right")
        for lo in range(0, len(n), AT_ONCE):
            hi = min(lo + AT_ONCE, len(n))
            a, b = np.nonzero((np.arange(lo, upto[hi - 1]) > np.arange(lo, hi)[:, None]) & (np.arange(lo, upto[hi - 1]) < upto[lo:hi, None]) & (part[lo : upto[hi - 1]] != part[lo:hi, None]))
            a, b = a + lo, b + lo
            if not one:
                a, b = a[own[a] != own[b]], b[own[a] != own[b]]
            for k in range(0, len(a), 1 << 14):
                x, y = a[k : k + (1 << 14)], b[k : k + (1 << 14)]
                keep = may_link(n[x], n[y], np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64), num, den)
                if keep.any():
                    yield rep[x[keep]], n[x[keep]], rep[y[keep]], n[y[keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pa.concat_batches([rest, batch])
            token, i, j, own, rep, part, n = (np.asarray(batch.column(k)) for k in range(7))
            cuts = np.flatnonzero((token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            yield from places(batch, [0, *cuts.tolist()])
            rest = batch.slice(int(cuts[-1]) if len(cuts) else 0)  # the last place may go on
        if rest is not None and rest.num_rows:
            yield from places(rest, [0, rest.num_rows])

    def places(batch: pa.RecordBatch, edges: list[int]) -> Iterator[pa.RecordBatch]:
        _, i, j, own, rep, part, n = (np.asarray(batch.column(k)) for k in range(7))
        bits, found = _bits(batch.column(7)), []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if (part[lo:hi] != part[lo]).any():
                found += met(rep[lo:hi], part[lo:hi], n[lo:hi], own[lo:hi], i[lo] == j[lo], bits[lo:hi])
        a, n_a, b, n_b = (np.concatenate([np.empty(0, np.int64), *(f[k] for f in found)]) for k in range(4))
        swap = a < b
        yield pa.RecordBatch.from_arrays([pa.array(np.where(swap, y, x)) for x, y in ((a, b), (n_a, n_b), (b, a), (n_b, n_a))], names=["a", "n_a", "b", "n_b"])

    dealt = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n")
    return dealt.mapInArrow(run, "a long, n_a long, b long, n_b long").distinct()


# -- verification ------------------------------------------------------------


def fragments(docs: DataFrame, id_col: str, text_col: str, width: int, order: np.ndarray, wanted: DataFrame) -> DataFrame:
    """(rep, n, fragment, tokens) of the sets that wanted (rep, digest) names: a row for each fragment that holds n-grams."""
    context = docs.sparkSession.sparkContext
    held, place = context.broadcast(bitmap(wanted.select(F.xxhash64("rep").alias("key")), "key")), context.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, words = Order(place.value), Words()
        for batch in _slices(batches, 1):
            batch = batch.filter(pa.array(in_bitmap(held.value, np.asarray(batch.column(2)))))
            sets = shingles(batch.column(1), width, words)
            rows = [(key, digest(s), len(s), f, part.tobytes()) for key, s in zip(batch.column(0).to_pylist(), sets, strict=True) for f, part in enumerate(known.fragments(s)) if len(part)]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["rep", "digest", "n", "fragment", "tokens"])

    key = F.col(id_col).cast("long")
    source = docs.filter(key.isNotNull()).select(key.alias("id"), F.col(text_col).alias("text"), F.xxhash64(key).alias("key"))
    found = source.mapInArrow(run, "rep long, digest binary, n long, fragment int, tokens binary")
    return found.join(wanted, ["rep", "digest"]).dropDuplicates(["rep", "fragment"]).drop("digest")


def overlaps(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, both): for each pair and fragment that both have n-grams in, how many they share there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            both = [len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True)) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(both, pa.int64())], names=["a", "b", "n_a", "n_b", "both"])
            give_back()

    side = lambda name: parts.select(F.col("rep").alias(name), "fragment", F.col("n").alias(f"n_{name}"), F.col("tokens").alias(f"tokens_{name}"))
    met = pairs.join(side("a"), "a").join(side("b"), ["b", "fragment"])
    return met.select("a", "b", "n_a", "n_b", "tokens_a", "tokens_b").mapInArrow(run, "a long, b long, n_a long, n_b long, both long")


def linked(pairs: DataFrame, parts: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose summed partial overlaps reach the threshold."""
    summed = overlaps(pairs, parts).groupBy("a", "b").agg(F.sum("both").alias("both"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    return summed.filter(den * F.col("both") >= num * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


# -- the join ----------------------------------------------------------------


def one_text(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Of (doc_id, digest, ...) the rows of each document's own set, the others, and whether there are others."""
    several = rows.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("digest").alias("_own"), F.max("digest").alias("_last"), F.count(F.when(F.col("digest").isNull(), 1)).alias("_empty"))
    several = several.filter((F.col("_own") != F.col("_last")) | ((F.col("_empty") > 0) & F.col("_own").isNotNull())).select("doc_id", "_own")
    several, _ = written(several, "several")
    if several.isEmpty():
        return rows, rows.limit(0), False
    marked = rows.join(several, "doc_id", "left")
    own = F.col("_own").isNull() | F.coalesce(F.col("digest") == F.col("_own"), F.lit(False))
    return marked.filter(own).drop("_own"), marked.filter(~own).drop("_own"), True


def join(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id; two documents link if den * intersection >= num * union."""
    spark = docs.sparkSession
    light_batches(spark)
    order = common(docs, text_col, width)
    table, table_path = written(parsed(docs, id_col, text_col, width, num, den, order), "parsed")
    own, others, torn = one_text(spark, table)
    named = own.filter(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    sets, sets_path = written(named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide"), F.first("prefix").alias("prefix")), "sets")

    postings = sets.select("rep", "n", F.explode("prefix").alias("token"))
    shared = postings.groupBy("token").agg(F.min("rep").alias("pivot"), F.min_by("n", "rep").alias("n_pivot"), F.count("rep").alias("docs")).filter(F.col("docs") > 1)
    lists, lists_path = written(postings.join(shared, "token"), "lists")

    def verified(pairs: DataFrame) -> tuple[DataFrame, list[str]]:
        pairs, pairs_path = written(sifted(pairs, sets, num, den), "pairs")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        parts, parts_path = written(fragments(docs, id_col, text_col, width, order, sets.select("rep", "digest").join(ends, "rep")), "fragments")
        links, links_path = written(linked(pairs, parts, num, den), "linked")
        return links, [pairs_path, parts_path, links_path]

    near, near_paths = verified(starred(lists, num, den))
    parts, parts_path = connected(near)
    more, more_paths = verified(across(lists, sets, parts, num, den))
    if not more.isEmpty():
        parts, again_path = connected(parts.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
        more_paths.append(again_path)

    found = own.select("doc_id", "n_shingles", "digest").join(sets.select("digest", "rep"), "digest", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    out = found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))
    if torn:
        out = out.unionByName(others.select("doc_id", "n_shingles").join(out.select("doc_id", "component_id").distinct(), "doc_id"))
    out, _ = written(out, "similar")
    drop_path(spark, table_path, sets_path, lists_path, parts_path, *near_paths, *more_paths)
    return out


def oracle(width: int, num: int, den: int) -> str:
    """The same join in DuckDB SQL, over documents."""
    return f"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(ws) = 0 OR ws IS NULL THEN [] WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - {width} + 2), lambda i: array_to_string(ws[i:i + {width} - 1], ' '))) END AS g FROM w),
    c AS (SELECT doc_id, len(g) AS n, hash(list_sort(g)) AS h FROM s),
    r AS (SELECT min(doc_id) AS rep, h, any_value(n) AS n FROM c WHERE n > 0 GROUP BY h),
    t AS (SELECT r.rep, r.n, hash(unnest(g)) AS x FROM s JOIN r ON s.doc_id = r.rep),
    o AS (SELECT t.rep AS a, u.rep AS b, t.n AS n, u.n AS m, count(*) AS k FROM t JOIN t AS u ON t.x = u.x AND t.rep < u.rep AND {den} * t.n >= {num} * u.n AND {den} * u.n >= {num} * t.n GROUP BY ALL),
    l AS (SELECT a, b FROM o WHERE {den} * k >= {num} * (n + m - k)),
    e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    reach(a, b) AS (SELECT rep, rep FROM r UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
    p AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
    SELECT c.doc_id, CAST(c.n AS BIGINT) AS n_shingles, coalesce(p.component, c.doc_id) AS component_id
    FROM c LEFT JOIN r ON c.h = r.h AND c.n > 0 LEFT JOIN p ON p.a = r.rep
    """
