"""Near-duplicate vectors within a label, by PCA-ordered tiled comparison.

The second moments of all unit vectors, summed in the tasks, give a rotation
that puts the directions of most weight first.  Vectors are sorted by their
leading coordinate and cut into tiles.  Two tiles are compared only if their
boxes in the leading coordinates come as near as the threshold asks.  Within a
pair of tiles the products of the leading coordinates are accumulated first;
what the rest can add is bounded by the norms of the suffixes, and rows and
columns whose every pair falls short are dropped before the next coordinates.
What survives is decided by the cosine in double precision of the vectors as
they were.

A pair of tiles gives back counts of links and a spanning forest, not links, so
a large group of near copies costs its comparisons and no rows.  Exact copies
are one class before all this.

Edge cases: a vector that is null, empty, zero or holds a null or a number that
is not finite links with nothing, nor does one with a null label; vectors of
different lengths do not link; a null id is kept, with no links; repeated rows
count as vectors of their own, with one id; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import MERGED_FIRST, drop_path, written
from sluice.llm.components import connected, forest

TILE_ROWS = 1024
#: Coordinates accumulated before each bound, and those of the tiles' boxes.
STEP, BOX = 16, 8
SLACK = 1e-9


def _vector(values) -> np.ndarray | None:
    """A vector in double precision, or null if it can link with nothing."""
    if values is None or not len(values) or None in values:
        return None
    x = np.array(values, np.float64) + 0.0
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by the largest entry first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=-1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors, the principal directions of all unit vectors, most weight first: one matrix a length."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            by_size: dict[int, list] = {}
            for x in map(_vector, batch.column(0).to_pylist()):
                if x is not None:
                    by_size.setdefault(len(x), []).append(x)
            for size, rows in by_size.items():
                unit = _unit(np.stack(rows))
                held[size] = held.get(size, 0) + unit.T @ unit
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([m.tobytes() for m in held.values()], pa.binary()), pa.array([TaskContext.get().partitionId() % MERGED_FIRST] * len(held), pa.int32())], names=["size", "moments", "side"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"size": frame["size"][:1], "moments": [np.sum([np.frombuffer(x) for x in frame["moments"]], axis=0).tobytes()]})

    found = vectors.mapInArrow(sums, "size int, moments binary, side int").groupBy("size", "side").applyInPandas(add, "size int, moments binary")
    whole: dict[int, np.ndarray] = {}
    for row in found.collect():  # MERGED_FIRST matrices a length at most
        whole[row["size"]] = whole.get(row["size"], 0) + np.frombuffer(row["moments"]).reshape(row["size"], row["size"])
    return {size: np.ascontiguousarray(np.linalg.eigh(moments)[1][:, ::-1]) for size, moments in whole.items()}


def prepared(rows: DataFrame, turn: dict[int, np.ndarray]) -> DataFrame:
    """vec_id, label, size, digest, lead (first coordinate) and vector (bytes) of each row; size is null where nothing can link."""
    held = rows.sparkSession.sparkContext.broadcast(turn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key, label, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = _vector(values) if key is not None and label is not None else None
                found.append((None, None, None, None) if x is None else (len(x), hashlib.blake2b(x.tobytes(), digest_size=16).digest(), float(_unit(x) @ held.value[len(x)][:, 0]), x.tobytes()))
            kinds = (pa.int32(), pa.binary(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]], names=["vec_id", "label", "size", "digest", "lead", "vector"])

    return rows.mapInArrow(run, f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, size int, digest binary, lead double, vector binary")


def tiles(classes: DataFrame, turn: dict[int, np.ndarray]) -> DataFrame:
    """One row a tile: tile, label, size, box (least and greatest leading coordinates), ids, times and vectors (bytes)."""
    held = classes.sparkSession.sparkContext.broadcast(turn)
    kind = classes.schema["label"].dataType.simpleString()

    def tile(part: int, number: int, own: pd.DataFrame) -> tuple:
        size = int(own["size"].iloc[0])
        x = np.frombuffer(b"".join(own["vector"])).reshape(-1, size)
        lead = (_unit(x) @ held.value[size])[:, :BOX]
        ids, times = own["vec_id"].to_numpy(np.int64), own["times"].to_numpy(np.int64)
        return f"{part}-{number}", own["label"].iloc[0], size, lead.min(0).tolist(), lead.max(0).tolist(), ids.tobytes(), times.tobytes(), x.tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, rest = TaskContext.get().partitionId(), 0, None
        names = ["tile", "label", "size", "low", "high", "ids", "times", "vectors"]
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            cuts = np.flatnonzero((rest["label"].to_numpy()[1:] != rest["label"].to_numpy()[:-1]) | (rest["size"].to_numpy()[1:] != rest["size"].to_numpy()[:-1])) + 1
            edges, out = [0, *cuts.tolist(), len(rest)], []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                while b - a >= TILE_ROWS or (a < b and b < len(rest)):
                    out.append(tile(part, number, rest.iloc[a : min(b, a + TILE_ROWS)]))
                    a, number = min(b, a + TILE_ROWS), number + 1
            rest = rest.iloc[a:]
            if out:
                yield pd.DataFrame(out, columns=names)
        if rest is not None and len(rest):
            yield pd.DataFrame([tile(part, number, rest)], columns=names)

    dealt = classes.repartitionByRange("label", "size", "lead", "digest").sortWithinPartitions("label", "size", "lead")
    return dealt.select("label", "size", "vec_id", "times", "vector").mapInPandas(run, f"tile string, label {kind}, size int, low array<double>, high array<double>, ids binary, times binary, vectors binary")


def near_tiles(cut: DataFrame, threshold: float) -> DataFrame:
    """Pairs (x, y) of tiles of one label and size, x <= y, whose boxes come near enough; met by cells of the first coordinate."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    cell = max(reach, 1e-3)
    box = cut.select("tile", "label", "size", "low", "high", F.floor(F.col("low")[0] / cell).alias("_from"), F.floor(F.col("high")[0] / cell).alias("_to"))
    left = box.select(F.col("tile").alias("x"), "label", "size", F.col("low").alias("low_x"), F.col("high").alias("high_x"), F.explode(F.sequence(F.col("_from") - 1, F.col("_to") + 1)).alias("cell"))
    right = box.select(F.col("tile").alias("y"), "label", "size", F.col("low").alias("low_y"), F.col("high").alias("high_y"), F.explode(F.sequence("_from", "_to")).alias("cell"))
    gap = F.zip_with(F.arrays_zip(F.col("low_x").alias("l"), F.col("high_x").alias("h")), F.arrays_zip(F.col("low_y").alias("l"), F.col("high_y").alias("h")), lambda p, q: F.greatest(F.lit(0.0), p["l"] - q["h"], q["l"] - p["h"]))
    far = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
    return left.join(right, ["label", "size", "cell"]).filter((F.col("x") <= F.col("y")) & (far <= reach * reach)).select("x", "y").distinct()


def links_of(x: np.ndarray, y: np.ndarray, directions: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and the matrix of links among them, for two tiles of vectors."""
    ux, uy = _unit(x), _unit(y)
    rx, ry = ux @ directions, uy @ directions
    rows, cols = np.arange(len(x)), np.arange(len(y))
    left_x, left_y = np.ones(len(x)), np.ones(len(y))
    sums = np.zeros((len(x), len(y)))
    for k in range(0, directions.shape[0], STEP):
        px, py = rx[rows, k : k + STEP], ry[cols, k : k + STEP]
        sums += px @ py.T
        left_x, left_y = np.maximum(left_x - (px * px).sum(1), 0), np.maximum(left_y - (py * py).sum(1), 0)
        open_ = sums + np.sqrt(left_x)[:, None] * np.sqrt(left_y) >= threshold - SLACK
        keep_x, keep_y = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
        rows, cols, left_x, left_y = rows[keep_x], cols[keep_y], left_x[keep_x], left_y[keep_y]
        if not len(rows):
            return rows, cols, np.zeros((0, 0), bool)
        sums = sums[np.ix_(keep_x, keep_y)]
    return rows, cols, ux[rows] @ uy[cols].T >= threshold


def compared(pairs: DataFrame, cut: DataFrame, turn: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """Rows of two kinds: (a, n) a vector and links that a pair of tiles gives it; (a, b) a link of the pair's spanning forest."""
    held = cut.sparkSession.sparkContext.broadcast(turn)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                x, y = np.frombuffer(r.vectors_x).reshape(-1, r.size), np.frombuffer(r.vectors_y).reshape(-1, r.size)
                ids_x, ids_y = np.frombuffer(r.ids_x, np.int64), np.frombuffer(r.ids_y, np.int64)
                times_x, times_y = np.frombuffer(r.times_x, np.int64), np.frombuffer(r.times_y, np.int64)
                rows, cols, linked = links_of(x, y, held.value[r.size], threshold)
                if r.x == r.y:
                    linked &= rows[:, None] != cols
                if not linked.any():
                    continue
                at, to = np.nonzero(linked)
                a, b = forest(ids_x[rows[at]], ids_y[cols[to]])
                ids, n = ids_x[rows], linked @ times_y[cols]
                if r.x != r.y:
                    ids, n = np.concatenate([ids, ids_y[cols]]), np.concatenate([n, times_x[rows] @ linked])
                ids, n = ids[n > 0], n[n > 0]
                yield pd.DataFrame({"a": np.concatenate([ids, a]), "n": pd.array([*n.tolist(), *[None] * len(a)], "Int64"), "b": pd.array([*[None] * len(ids), *b.tolist()], "Int64")})

    side = lambda n: cut.select(F.col("tile").alias(n), F.col("ids").alias(f"ids_{n}"), F.col("times").alias(f"times_{n}"), F.col("vectors").alias(f"vectors_{n}"), *(["size"] if n == "x" else []))
    return pairs.join(side("x"), "x").join(side("y"), "y").mapInPandas(run, "a long, n long, b long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept; vectors of one label link if their cosine reaches the threshold."""
    spark = vectors.sparkSession
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    turn = rotations(source.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull()).select("vector"))
    base, base_path = written(prepared(source, turn), "vectors")
    usable = base.filter(F.col("size").isNotNull())
    classes = usable.groupBy("label", "size", "digest").agg(F.min("vec_id").alias("rep"), F.count("vec_id").alias("times"))
    own = usable.join(classes, ["label", "size", "digest"])
    cut, cut_path = written(tiles(own.filter(F.col("vec_id") == F.col("rep")).dropDuplicates(["label", "size", "digest"]), turn), "tiles")
    met, met_path = written(compared(near_tiles(cut, threshold), cut, turn, threshold), "compared")
    copies = own.filter(F.col("vec_id") != F.col("rep")).select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    parts, parts_path = connected(met.filter(F.col("b").isNotNull()).select("a", "b").unionByName(copies))
    counts = met.filter(F.col("n").isNotNull()).groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    counted = classes.join(counts, "rep", "left").select("label", "size", "digest", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    out = base.select("vec_id", "label", "size", "digest").join(counted, ["label", "size", "digest"], "left")
    out = out.join(parts.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
    out, _ = written(out, "near")
    drop_path(spark, base_path, cut_path, met_path, parts_path)
    return out


ORACLE = """
    WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    u AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u AS a JOIN u AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
    reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
    p AS (SELECT a, min(b) AS component FROM reach GROUP BY a),
    n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
    SELECT v.vec_id, coalesce(n.n, 0) AS n_links, p.component AS component_id, v.vec_id = p.component AS kept
    FROM v LEFT JOIN p ON p.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
    """
