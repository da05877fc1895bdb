"""Benchmark decontamination by template canonicalisation.

A text is read as tokens; numbers, names and units become typed placeholders
and keep what stood there as slot values.  Every window of a few tokens of a
benchmark item is a template; windows of documents are hash-joined to them.
Matches that lie on one diagonal (same shift between document and item) must
fill the slots consistently: where the item says one thing twice, the document
does too.  A question with other numbers or names is thus still found, while a
text that only looks alike is not.  Whether the capitalised word that opens a
sentence is a name cannot be told, so windows that hold one are taken twice: with
it as it is, and with it as a name; each reading must be consistent in itself.
Windows of which less than MIN_LITERALS is literal are not templates.  All
windows, these too, are also met verbatim, word by word, so that copies of items
dense in numbers and units are found.  An item is reported if MIN_COVERAGE of its
templates are found, or of all its windows, be it as templates or verbatim, or
if RUN of its tokens are found verbatim in a row, whatever their share.

Documents' windows pass a bitmap of the benchmark's windows before they leave
the task, so only likely matches are joined.

Edge cases: a null or empty text, on either side, matches nothing; items
shorter than a window are one window of their own length, those of fewer than
MIN_TOKENS tokens are not searched for; repeated items are reported each; repeated documents count once by
id; a null id is reported as null; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import BASE, bitmap, give_back, in_bitmap, light_batches, mix, span_hashes, window_hashes

WINDOW, MIN_TOKENS, MIN_LITERALS, MIN_COVERAGE, RUN = 8, 4, 0.5, 0.3, 13
# Words that are units.
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces oz pound pounds lb lbs ton tons tonnes "
    "ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours hr hrs day days week weeks month months year years "
    "dollar dollars usd cent cents euro euros eur pounds gbp yen percent degree degrees celsius fahrenheit kelvin joule joules watt watts volt volts mph kmh hz khz mhz ghz kb mb gb tb"
).split()
NUMBER, NAME, UNIT = 1, 2, 3
#: Windows without a capitalised word that opens a sentence, and those with one: as it is, or as a name; windows taken verbatim.
PLAIN, OPENED, NAMED, VERBATIM = 0, 1, 2, 3
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_ENDS = np.array([chr(b) in ".!?:;\n" for b in range(256)])
_POINT = np.array([chr(b) in ".," for b in range(256)])


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer("".join(UNITS).encode(), np.uint8)
    sizes = np.array([len(u) for u in UNITS])
    return np.unique(span_hashes(data, np.cumsum(sizes) - sizes, np.cumsum(sizes)))


UNIT_HASHES = _unit_hashes()


def tokens(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, kind, opener) of each token: the hash of what stands there, the placeholder's kind or 0, and whether it may be a name that opens a sentence."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.int8), np.empty(0, bool)
    upper, data = _UPPER[raw], _LOWERED[raw]
    latin = np.zeros(len(raw), bool)
    latin[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    data[latin] += 32
    first_upper = upper.copy()
    first_upper[:-1] |= latin[1:]
    digit, word = _DIGIT[raw], _WORD[raw]
    if len(raw) > 2:
        word[1:-1] |= _POINT[raw[1:-1]] & digit[:-2] & digit[2:]
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    value = span_hashes(data, starts, ends)
    kind = np.zeros(len(starts), np.int8)
    if not len(starts):
        return value, kind, np.zeros(0, bool)
    stops = np.concatenate([[0], np.cumsum(_ENDS[raw] & ~word)])
    opens = stops[starts] > np.concatenate([[-1], stops[ends[:-1]]])  # first of a sentence
    capitals = np.concatenate([[0], np.cumsum(upper | latin)])
    shouted = (capitals[ends] - capitals[starts] > 1) | (ends - starts == 1)
    kind[np.isin(value, UNIT_HASHES)] = UNIT
    kind[first_upper[starts] & ~opens & ~shouted] = NAME
    kind[digit[starts]] = NUMBER
    return value, kind, first_upper[starts] & opens & ~shouted & (kind == 0)


def windows(text: str | None, widths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each width and reading: the width, hashes of all windows, which of them count, their forms, and the tokens' values and kinds."""
    value, kind, opener = tokens(text)
    held = np.concatenate([[0], np.cumsum(opener)])
    for own in [kind, np.where(opener, NAME, kind)] if opener.any() else [kind]:
        template = np.where(own > 0, mix(own.astype(np.uint64) * np.uint64(BASE)), value)
        literal = np.concatenate([[0], np.cumsum(own == 0)])
        for width in widths:
            if len(value) >= width:
                keys = window_hashes(template, width) ^ np.uint64(width)
                enough, opened = literal[width:] - literal[:-width] >= MIN_LITERALS * width, held[width:] > held[:-width]
                yield width, keys, enough if own is kind else enough & opened, opened * (OPENED if own is kind else NAMED), value, own
    for width in widths:
        if len(value) >= width:
            n = len(value) - width + 1
            yield width, window_hashes(value, width) ^ np.uint64(width + BASE), np.ones(n, bool), np.full(n, VERBATIM), value, np.zeros_like(kind)


SCHEMA = "id long, key long, pos int, slots array<long>, form int"


def _batch(ids: list, found: list[tuple]) -> pa.RecordBatch:
    """A batch of windows: found has id's place, keys, positions, forms, width, values and kinds of a text each."""
    keys, places, forms, owners, cuts, slots = [], [], [], [], [0], []
    for who, own, at, form, width, value, kind in found:
        keys.append(own)
        places.append(at)
        forms.append(form)
        owners += [ids[who]] * len(own)
        for p in at.tolist():
            filled = value[p : p + width][kind[p : p + width] > 0]
            slots.append(filled.view(np.int64))
            cuts.append(cuts[-1] + len(filled))
    flat = pa.array(np.concatenate(slots) if slots else np.empty(0, np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.array(owners, pa.int64()), pa.array(np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)), pa.array(np.concatenate(places).astype(np.int32) if places else np.empty(0, np.int32)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), flat), pa.array(np.concatenate(forms).astype(np.int32) if forms else np.empty(0, np.int32))],
        names=["id", "key", "pos", "slots", "form"],
    )


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, key, pos, slots, form, width, templates, total) of every template window of the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, sizes = batch.column(0).to_pylist(), [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                n = len(tokens(text)[0])
                own = list(windows(text, [min(n, window)] if n >= MIN_TOKENS else []))
                totals = (int(own[0][2].sum()), len(own[0][2])) if own else (0, 0)
                for width, keys, counts, form, value, kind in own:
                    at = np.flatnonzero(counts)
                    found.append((k, keys[at], at, form[at], width, value, kind))
                    sizes += [(width, *totals)] * len(at)
            out = _batch(ids, found)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array([s[0] for s in sizes], pa.int32()), *[pa.array([s[k] for s in sizes], pa.int64()) for k in (1, 2)]], names=[*out.schema.names, "width", "templates", "total"])

    return items.mapInArrow(run, f"{SCHEMA}, width int, templates long, total long")


def document_windows(docs: DataFrame, widths: list[int], held: bytes) -> DataFrame:
    """(id, key, pos, slots, form) of the documents' windows that pass the bitmap."""
    sent = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column(0).to_pylist(), []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for width, keys, counts, form, value, kind in windows(text, widths):
                    at = np.flatnonzero(in_bitmap(sent.value, keys) & counts)
                    if len(at):
                        found.append((k, keys[at], at, form[at], width, value, kind))
            yield _batch(ids, found)
            give_back()

    return docs.mapInArrow(run, SCHEMA)


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """A row per contaminated document and item: doc_id, item_id, windows, coverage (share of the item's windows or templates found, the larger), verbatim."""
    light_batches(docs.sparkSession)
    bench = item_windows(items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).alias("text")), window)
    widths = sorted(r[0] for r in bench.select("width").distinct().collect())  # at most as many as a window has tokens
    held = bitmap(bench, "key")
    found = document_windows(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), widths, held)
    item = bench.select(F.col("id").alias("item_id"), "key", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), F.col("form").alias("item_form"), "templates", "total")
    met = found.withColumnRenamed("id", "doc_id").join(item, "key").filter(F.size("slots") == F.size("item_slots"))
    form = F.greatest("form", "item_form")  # plain windows belong to both readings
    met = met.withColumn("reading", F.explode(F.when(form == PLAIN, F.array(F.lit(OPENED), F.lit(NAMED))).otherwise(F.array(form))))
    filled = F.arrays_zip(F.col("item_slots").alias("item"), F.col("slots").alias("doc"))
    line = met.groupBy("doc_id", "item_id", "reading", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.collect_set("item_pos").alias("at"), F.array_distinct(F.flatten(F.collect_set(filled))).alias("filled"), F.first("templates").alias("templates"), F.first("total").alias("total"))
    consistent = F.size("filled") == F.size(F.array_distinct(F.transform("filled", lambda x: x["item"])))
    same = F.forall("filled", lambda x: x["item"] == x["doc"])
    places = lambda at: F.size(F.array_distinct(F.flatten(F.collect_set(at)))).cast("long")
    at, steps = F.sort_array("at"), max(RUN - window, 0)
    run = (F.col("reading") == VERBATIM) & F.exists(F.arrays_zip(at.alias("first"), F.slice(at, steps + 1, F.size("at")).alias("last")), lambda x: x["last"] - x["first"] == steps)
    whole = line.filter(consistent).groupBy("doc_id", "item_id").agg(places("at").alias("windows"), places(F.when(F.col("reading") != VERBATIM, F.col("at"))).alias("shaped"), F.bool_and(same).alias("verbatim"), F.max(F.coalesce(run, F.lit(False))).alias("run"), F.first("templates").alias("templates"), F.first("total").alias("total"))
    out = whole.withColumn("coverage", F.greatest(F.col("windows") / F.col("total"), F.when(F.col("templates") > 0, F.col("shaped") / F.col("templates"))))
    return out.filter((F.col("coverage") >= min_coverage) | F.col("run")).select("doc_id", "item_id", "windows", "coverage", "verbatim")
