"""Operator 6, embedding near-dedup: an exact metric range join over pivot cells.

On unit vectors a cosine of at least c is a distance of at most r = sqrt(2 - 2c). Pivots, a hashed sample of the
vectors of each label, partition them: each vector's home is the cell of its nearest pivot. Labels with SMALL vectors
or more have at least two pivots; only below that is a label one cell. A vector is copied to another cell only where a member of that cell can lie within r: by the triangle inequality its distance to that pivot
is at most the cell's radius + r, and its distance to the border between the two pivots, which lies between them, is
at most r. Cells then join on their own, in blocks of bounded size; each vector is compared with all that came to its
home cell, by cosine in double precision.

Equal vectors of a label form a class first and count as many. Blocks return link counts and, in place of all
links, a spanning forest of them, from which components follow.

Vectors that are null, empty, zero or hold null or non-finite components, and those with a null label, link with
nothing, nor do those without a vec_id; they are kept. Labels of any type are compared as text. Rows with the same
vec_id are vectors of their own. Ties need no rule: a link is decided by the cosine alone. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewise.llm.common import connected_components, cut, hash_limit, hot_join

COSINE = 0.93
#: Vectors a cell should have, vectors in a block, and pivots at most over all labels (so what is sent out is bounded).
CELL, BLOCK, PIVOTS = 1500, 1500, 4096
#: Vectors from which a label has two pivots at least, while no more than a quarter of PIVOTS labels are that large.
SMALL = 64
#: Room for rounding in the bounds; the comparison itself has none.
SLACK = 1e-6


def same_label(label: Column, kind: T.DataType) -> Column:
    """The label as text, equal where labels are equal."""
    return (label + F.lit(0.0)).cast("string") if isinstance(kind, (T.FloatType, T.DoubleType)) else label.cast("string")


def classes_of(vectors: DataFrame) -> DataFrame:
    """id (a number of its own), low (the smallest vec_id), label, embedding and n for each distinct usable vector of a label."""
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    found = vectors.where(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    return found.withColumn("id", F.monotonically_increasing_id())


def pivots_of(classes: DataFrame, cell: int, most: int, small: int = SMALL) -> dict[object, np.ndarray]:
    """Unit pivots by (label, dimension): for each about one vector in `cell`, two at least, `most` over all.

    Labels with fewer than `small` vectors have none and are one cell each. Where there are so many labels that two
    pivots for each would be over half of `most`, so are those with fewer than 4 vectors in `most` of all.
    """
    sizes = cut(classes.groupBy("label").agg(F.count("*").alias("count")))
    total = sizes.agg(F.sum("count")).first()[0] or 0
    least = max(2, small, math.ceil(4 * total / most))  # at most `most` / 4 labels are as large
    share = min(1.0, most / 2 / max(1, math.ceil(total / cell)))
    k = F.greatest(F.lit(2), F.floor(F.col("count") / cell * share)).cast("int")
    sized = sizes.where(F.col("count") >= least).select("label", k.alias("k"), "count").collect()
    if not sized:
        return {}
    k_of = {r[0]: r[1] for r in sized}
    # the k smallest of a hash
    draw = F.xxhash64(F.lit("pivot"), "embedding")
    limits = [(label, hash_limit(min(1.0, (2 * k + 20) / n))) for label, k, n in sized]
    near = classes.sparkSession.createDataFrame(limits, "label string, _limit long")
    few = classes.join(F.broadcast(near), "label").where(draw <= F.col("_limit")).select("label", "embedding", draw.alias("_draw")).collect()
    drawn: dict[tuple[str, int], list] = {}
    for label, e, _ in sorted(few, key=lambda r: (r[0], r[2], r[1])):
        drawn.setdefault((label, len(e)), []).append(e)
    return {(label, width): unit(np.array(group[: k_of[label]], float)) for (label, width), group in drawn.items()}


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares stay in range."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def spread(classes: DataFrame, pivots: dict, radius: float, copies: bool, radii: dict | None = None) -> DataFrame:
    """label, width, cell, home (false for a copy), distance to the pivot, id, n, embedding."""
    context = classes.sparkSession.sparkContext
    sent = context.broadcast((pivots, radii))  # `most` pivots over all, and a number for each

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, radii = sent.value
        for batch in batches:
            frame = batch.to_pandas()
            frame["width"] = frame.embedding.str.len()
            for (label, width), group in frame.groupby(["label", "width"]):
                centres = pivots.get((label, width))
                if centres is None:  # few vectors, or a rare width that no pivot has: one cell
                    out = group.assign(cell=0, home=True, far=0.0)
                else:
                    rows = unit(np.stack(group.embedding.to_numpy()))
                    far = np.sqrt(np.maximum(0, 2 - 2 * rows @ centres.T))
                    home = far.argmin(1)
                    at = np.arange(len(rows))
                    goes = np.zeros(far.shape, bool)
                    if copies:
                        between = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))[home]
                        with np.errstate(divide="ignore", invalid="ignore"):
                            border = (far**2 - far[at, home][:, None] ** 2) / (2 * between)
                        limit = np.array([radii.get((label, width, k), -1.0) for k in range(len(centres))])
                        goes = (limit >= 0) & (far <= limit + radius + SLACK) & ~(border > radius + SLACK)
                    goes[at, home] = True
                    row, cell = np.nonzero(goes)
                    out = group.iloc[row].assign(cell=cell, home=cell == home[row], far=far[row, cell])
                yield pa.RecordBatch.from_pandas(out[["label", "width", "cell", "home", "far", "id", "n", "embedding"]], preserve_index=False, schema=shape)

    shape = pa.schema([("label", pa.string()), ("width", pa.int32()), ("cell", pa.int32()), ("home", pa.bool_()), ("far", pa.float64()), ("id", pa.int64()), ("n", pa.int64()), ("embedding", pa.list_(pa.float64()))])
    return classes.mapInArrow(place, "label string, width int, cell int, home boolean, far double, id long, n long, embedding array<double>")


def forest(linked: np.ndarray) -> np.ndarray:
    """For each row and then each column of the block, a number that all it is joined to share."""
    rows, columns = linked.shape
    name = np.arange(rows + columns)
    while True:
        low = np.minimum(name[:rows], np.where(linked, name[rows:][None, :], rows + columns).min(1, initial=rows + columns))
        right = np.minimum(name[rows:], np.where(linked, low[:, None], rows + columns).min(0, initial=rows + columns))
        new = np.concatenate([low, right])
        new = new[new]
        if (new == name).all():
            return name
        name = new


def join_block(frame: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """kind 'count': id and how many vectors it links with in this block; kind 'edge': id and other, joined."""
    home = frame[frame.side]
    other = frame[~frame.side]
    left, right = np.stack(home.embedding.to_numpy()), np.stack(other.embedding.to_numpy())
    scale, scale2 = np.abs(left).max(1, keepdims=True), np.abs(right).max(1, keepdims=True)
    left, right = left / scale, right / scale2
    near = (left @ right.T) / (np.linalg.norm(left, axis=1)[:, None] * np.linalg.norm(right, axis=1)[None, :]) >= cosine
    ids, ids2 = home.id.to_numpy(), other.id.to_numpy()
    near &= ids[:, None] != ids2[None, :]
    count = near @ other.n.to_numpy()
    name = forest(near)
    everyone = np.concatenate([ids, ids2])
    joined = name != np.arange(len(name))
    counted = pd.DataFrame({"id": ids[count > 0], "other": count[count > 0], "edge": False})
    edges = pd.DataFrame({"id": everyone[joined], "other": everyone[name[joined]], "edge": True})
    return pd.concat([counted, edges[edges.id != edges.other]], ignore_index=True).astype({"id": "int64", "other": "int64", "edge": bool})


def usable_classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with their label as text and doubles as components, and their classes."""
    doubles = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), doubles.alias("embedding"), same_label(F.col("label"), vectors.schema["label"].dataType).alias("label"))
    return rows, cut(classes_of(rows))


def in_cells(classes: DataFrame, cosine: float, cell: int, most_pivots: int) -> DataFrame:
    """The classes in their home cells and, as copies, in all other cells with members that can be near."""
    pivots = pivots_of(classes, cell, most_pivots)
    radius = math.sqrt(max(0.0, 2 - 2 * cosine))
    at_home = spread(classes.select("label", "id", "n", "embedding"), pivots, radius, False)
    many = F.col("label").isin(sorted({label for label, _ in pivots})) if pivots else F.lit(False)
    cells = at_home.where(many).groupBy("label", "width", "cell").agg(F.max("far")).collect()  # at most one row for each pivot
    radii = {(r[0], r[1], r[2]): r[3] for r in cells}
    return cut(spread(classes.select("label", "id", "n", "embedding"), pivots, radius, True, radii))


def cell_costs(vectors: DataFrame, cosine: float = COSINE, cell: int = CELL, most_pivots: int = PIVOTS) -> DataFrame:
    """What the bounds save: label, width, cells, vectors (distinct ones), copies (in all cells, home cells included),
    compared (members at home times all that came to the cell) and all_pairs (vectors squared)."""
    placed = in_cells(usable_classes(vectors)[1], cosine, cell, most_pivots)
    by_cell = placed.groupBy("label", "width", "cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("all"))
    sums = by_cell.groupBy("label", "width").agg(F.count("*").alias("cells"), F.sum("homes").alias("vectors"), F.sum("all").alias("copies"), F.sum(F.col("homes") * F.col("all")).alias("compared"))
    return sums.withColumn("all_pairs", F.col("vectors") * F.col("vectors"))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, cell: int = CELL, block: int = BLOCK, most_pivots: int = PIVOTS) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    rows, classes = usable_classes(vectors)
    placed = in_cells(classes, cosine, cell, most_pivots)
    where = ["label", "width", "cell"]
    blocks = placed.groupBy(*where).agg(F.ceil(F.sum(F.col("home").cast("int")) / block).cast("long").alias("_homes"), F.ceil(F.count("*") / block).cast("long").alias("_all"))
    sized = placed.join(cut(blocks), where)
    draw = F.xxhash64("id", F.lit("block"))
    ours, theirs = F.pmod(draw, F.col("_homes")), F.pmod(draw, F.col("_all"))
    home_side = sized.where("home").select(*where, ours.alias("_i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_all") - 1)).alias("_j"), F.lit(True).alias("side"), "id", "n", "embedding")
    other_side = sized.select(*where, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_homes") - 1)).alias("_i"), theirs.alias("_j"), F.lit(False).alias("side"), "id", "n", "embedding")
    both = home_side.unionByName(other_side)

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        if frame.side.all() or not frame.side.any():
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64"), "edge": pd.Series(dtype=bool)})
        return join_block(frame, cosine)

    found = cut(both.groupBy(*where, "_i", "_j").applyInPandas(join, "id long, other long, edge boolean"))
    counts = found.where("not edge").groupBy("id").agg(F.sum("other").alias("links"))
    groups = connected_components(found.where("edge").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = classes.join(counts, "id", "left").join(groups, F.col("id") == F.col("node"), "left")
    named = cut(named.select("label", "embedding", "n", "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = cut(named.join(lowest, "component").select("label", "embedding", "n", "n_links", "component_id"))
    out = hot_join(rows.select("vec_id", "label", "embedding"), named, ["label", "embedding"], "n")
    out = out.withColumn("_in", F.col("vec_id").isNotNull() & F.col("component_id").isNotNull())
    component = F.when(F.col("_in"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("_in"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
