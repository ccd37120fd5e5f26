"""Factor texts to factor ids: similarity graph, components, labels; and metrics of predicted labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.sampling import numbered
from faultline.sources.shared import materialize

#: Vectors of a block at least, reference vectors, and what a bound on angles allows for rounding.
BLOCK_ROWS, PIVOTS, SLACK = 2048, 64, 1e-6
#: Where no bound rules a block out, each vector is sent once for each block: blocks grow so that there are about so many,
#: up to so many vectors and products held at once, which bound a task's memory.
MANY_BLOCKS, MOST_ROWS, PRODUCTS = 40, 32_768, 4_000_000
#: Edges that one task joins to components at most.
FEW_EDGES = 200_000
#: Matrices that the driver sums without nodes between.
TREE = 64


def distinct_texts(texts: DataFrame) -> DataFrame:
    """Each text once, with its first position."""
    return texts.groupBy("text").agg(F.min("pos").alias("pos"))


def _angles(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    norm = np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    return np.arccos(np.clip((v / norm) @ pivots.T, -1, 1))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().astype(np.float64).reshape(len(flat), -1)


def blocks(vectors: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Vectors in blocks of bounded size (id, v, block), and the pairs of blocks (lo <= hi) that may hold a similar pair.

    Each vector belongs to the nearest of some reference vectors, whose number follows the rows up to ``PIVOTS``, and
    within that cell to a shell by its angle, so the vectors of a block lie close together. A block knows the least and
    the largest angle to each reference vector. Angles fulfil the triangle inequality, so two blocks whose angles to any
    reference vector lie further apart than the threshold's angle hold no similar pair. Cells are ruled out first, by the
    same bound; only blocks of cells that are left are joined.
    """
    spark = vectors.sparkSession
    real = vectors.schema["v"].dataType.elementType.typeName() == "float"  # sent as they are; products are of doubles
    vectors = materialize(vectors.where("v is not null").select("id", (F.col("v") if real else F.transform("v", lambda x: x.cast("double"))).alias("v")), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, largest = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(square), F.lit(0.0))).first()
    # A product of at least the threshold needs this cosine; without a positive threshold nothing is ruled out.
    reach = float(np.arccos(min(1.0, threshold / max(1e-300, largest)))) + SLACK if threshold > 0 else 4.0
    size = max(BLOCK_ROWS, min(MOST_ROWS, -(-n // MANY_BLOCKS)))
    several = -(-n // size)
    if several <= 1:
        one = spark.range(1).select(F.lit("0").alias("lo"), F.lit("0").alias("hi"))
        return vectors.withColumn("block", F.lit("0")), one
    picked = vectors.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, several)).select("v").collect()  # PIVOTS rows at most
    pivots = np.array([r.v for r in picked])
    pivots = pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-300)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            angle = _angles(_matrix(x.column(1)), pivots) if x.num_rows else np.zeros((0, len(pivots)))
            cell = angle.argmin(axis=1) if x.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(cell, pa.int32()), pa.array(angle[np.arange(len(cell)), cell])], ["id", "v", "cell", "angle"])

    kind = vectors.schema["id"].dataType.simpleString()
    placed = materialize(vectors.mapInArrow(cells, f"id {kind}, v {vectors.schema['v'].dataType.simpleString()}, cell int, angle double"), "cells")
    shells = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("k"), F.percentile_approx("angle", [i / 256 for i in range(1, 256)], 10_000).alias("q"))
    # Up to 256 shells of a cell; a shell of more rows than a block has, as of equal angles, is cut by hash.
    cut = F.broadcast(shells)  # PIVOTS rows at most
    step = F.greatest(F.lit(1), F.floor(F.lit(256) / F.col("k"))).cast("int")
    shell = F.floor(F.size(F.filter("q", lambda x: x < F.col("angle"))) / step).cast("int")
    shelled = placed.join(cut, "cell").withColumn("shell", shell).drop("q", "k")
    sizes = shelled.groupBy("cell", "shell").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    dealt = shelled.join(F.broadcast(sizes), ["cell", "shell"])  # 256 * PIVOTS rows at most
    dealt = materialize(dealt.select("id", "v", "cell", F.concat_ws("/", "cell", "shell", part).alias("block")), "blocks")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                angle, block, cell = _angles(_matrix(x.column(0)), pivots), np.array(x.column(1).to_pylist()), x.column(2).to_numpy()
                order = np.argsort(block, kind="stable")
                at = np.flatnonzero(np.concatenate([[True], block[order][1:] != block[order][:-1]]))
                low, high = np.minimum.reduceat(angle[order], at), np.maximum.reduceat(angle[order], at)
                p = np.tile(np.arange(len(pivots)), len(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(block[order][at], len(pivots)).tolist(), pa.string()), pa.array(np.repeat(cell[order][at], len(pivots)), pa.int32()), pa.array(p, pa.int32()), pa.array(low.ravel()), pa.array(high.ravel())], ["block", "cell", "p", "low", "high"])

    edges = dealt.select("v", "block", "cell").mapInArrow(bounds, "block string, cell int, p int, low double, high double")
    edges = materialize(edges.groupBy("block", "cell", "p").agg(F.min("low").alias("low"), F.max("high").alias("high")), "bounds")

    def pairs(rows: DataFrame, key: str, near: DataFrame | None) -> DataFrame:
        """Pairs lo <= hi of a key whose ranges are nowhere further apart than the reach."""
        each = rows.groupBy(key, "cell").agg(F.array_sort(F.collect_list(F.struct("p", "low", "high"))).alias("r"))  # PIVOTS ranges
        x, y = (each.select(F.col(key).alias(e), F.col("cell").alias(f"{e}_cell"), F.col("r").alias(f"{e}_r")) for e in ("lo", "hi"))
        apart = F.exists(F.zip_with("lo_r", "hi_r", lambda a, b: F.greatest(a["low"] - b["high"], b["low"] - a["high"])), lambda d: d > reach)
        if near is None:  # cells: PIVOTS rows
            return x.join(F.broadcast(y), F.col("lo") <= F.col("hi")).where(~apart).select("lo", "hi")
        both = near.select(F.col("lo").alias("a"), F.col("hi").alias("b"))
        both = F.broadcast(both.unionByName(both.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))))
        return x.join(both, F.col("lo_cell") == F.col("a")).join(y, F.col("b") == F.col("hi_cell")).where(F.col("lo") <= F.col("hi")).where(~apart).select("lo", "hi")

    of_cells = edges.groupBy("cell", "p").agg(F.min("low").alias("low"), F.max("high").alias("high")).withColumn("one", F.col("cell"))
    near = materialize(pairs(of_cells, "one", None), "near-cells")
    return dealt.select("id", "v", "block"), materialize(pairs(edges, "block", near), "pairs")


def _compared(vectors: DataFrame, threshold: float, found) -> DataFrame:
    """i, j of what ``found`` takes from the similar pairs of each pair of blocks; of all of them, as they come, if it is None."""
    kind = vectors.schema["id"].dataType.simpleString()
    dealt, pairs = blocks(vectors, threshold)
    mine = pairs.select(F.col("lo").alias("block"), "lo", "hi").unionByName(pairs.where("lo <> hi").select(F.col("hi").alias("block"), "lo", "hi"))
    spread = dealt.join(mine, "block").select("id", "v", (F.col("block") == F.col("lo")).alias("left"), "lo", "hi")

    def edges(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = (k.as_py() for k in key)
        table = pa.Table.from_batches(list(batches))
        ids, left, v = np.array(table["id"].to_numpy()), table["left"].to_numpy(zero_copy_only=False), _matrix(table["v"])
        a, c = np.flatnonzero(left), np.flatnonzero(left if lo == hi else ~left)
        others, step = v[c].T, max(1, PRODUCTS // max(1, len(c)))
        out, held, most = [np.zeros((2, 0), ids.dtype)], 0, 1_000_000

        def made(pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, pairs.shape[1], 1_000_000):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0, at : at + 1_000_000]), pa.array(pairs[1, at : at + 1_000_000])], ["i", "j"])

        for at in range(0, len(a), step):
            i, j = np.nonzero(v[a[at : at + step]] @ others >= threshold)
            x, y = ids[a[i + at]], ids[c[j]]
            keep = x < y if lo == hi else x != y
            out.append(np.stack([np.minimum(x, y)[keep], np.maximum(x, y)[keep]]))
            held += out[-1].shape[1]
            if held > most:
                pairs = np.concatenate(out, axis=1)
                if found is None:
                    yield from made(pairs)
                    out, held = [pairs[:, :0]], 0
                else:
                    out = [found(pairs)]
                    held = out[0].shape[1]
                    most = max(most, 2 * held)
        pairs = np.concatenate(out, axis=1)
        yield from made(pairs if found is None else found(pairs))

    return spread.groupBy("lo", "hi").applyInArrow(edges, f"i {kind}, j {kind}")


def similar_pairs(vectors: DataFrame, threshold: float = 0.75) -> DataFrame:
    """All pairs i < j with a product at or above a threshold. vectors: id (a number), v (unit vectors).

    Pairs of blocks that a bound leaves meet in one group each and are a matrix product; the threshold applies inside
    the task. Null vectors have no pair. Where only components are needed, ``similar_links`` hands on far fewer rows.
    """
    return _compared(vectors, threshold, None)


def similar_links(vectors: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Pairs i < j that connect the same vectors as all similar pairs do.

    Equal vectors are compared once, by the one of the smallest id, and the others are linked to it. A pair of blocks
    hands on a forest, so a dense group gives fewer links than it has members.
    """
    named = vectors.where("v is not null").select("id", "v")
    own = materialize(named.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "distinct-vectors")
    size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    several = own.where("n > 1").where(size >= threshold)
    alike = named.join(several, "v").where("id <> rep").select(F.col("rep").alias("i"), F.col("id").alias("j"))
    return _compared(own.select(F.col("rep").alias("id"), "v"), threshold, forest).unionByName(alike)


def forest(pairs: np.ndarray) -> np.ndarray:
    """Of pairs (two rows), those that join what the ones before them leave apart, as (smallest member, member)."""
    names, at = np.unique(pairs, return_inverse=True)
    up = list(range(len(names)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in zip(*at.reshape(2, -1).tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    roots = np.array([find(x) for x in range(len(names))], dtype=np.int64)
    use = roots != np.arange(len(names))
    return np.stack([names[roots[use]], names[use]])


def contracted(edges: DataFrame) -> DataFrame:
    """i, j: fewer edges that connect the same: each task joins those that it holds."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for x in batches:
            new = np.stack([x.column(0).to_numpy(), x.column(1).to_numpy()])
            held = forest(new if held is None else np.concatenate([held, new], axis=1))
            if held.shape[1] > 5 * FEW_EDGES:  # as many names as a task keeps
                yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["i", "j"])
                held = None
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["i", "j"])

    return edges.select("i", "j").mapInArrow(rows, edges.select("i", "j").schema)


def components(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Id, component (the smallest id).

    Each task first joins the edges that it holds. If few are left, by count, one task joins those; else smallest labels
    run along them, with shortcuts, and each round is written. Null ends are no edge.
    """
    left = materialize(contracted(edges.where("i is not null and j is not null")), "edges")
    if left.count() <= FEW_EDGES:
        labels = contracted(left.coalesce(1)).select(F.col("j").alias("id"), F.col("i").alias("component"))
        return ids.select("id").distinct().join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    both = materialize(left.unionByName(left.select(F.col("j").alias("i"), F.col("i").alias("j"))), "graph")
    labels = materialize(ids.select("id", F.col("id").alias("component")).distinct(), "labels")
    while True:
        seen = both.join(labels.select(F.col("id").alias("j"), F.col("component").alias("c")), "j").groupBy("i").agg(F.min("c").alias("c"))
        low = labels.join(seen, F.col("id") == F.col("i"), "left")
        low = materialize(low.select("id", F.least("component", "c").alias("component"), F.coalesce(F.col("c") < F.col("component"), F.lit(False)).alias("moved")), "lower")
        if low.where("moved").isEmpty():
            return labels
        jump = low.select(F.col("id").alias("at"), F.col("component").alias("next"))
        labels = materialize(low.join(jump, F.col("component") == F.col("at")).select("id", F.least("component", "next").alias("component")), "labels")


def factor_rows(components_: DataFrame, texts: DataFrame) -> DataFrame:
    """Component, factor_id (numbered by first appearance), first, text, pos; one row per text. texts: id, text, pos."""
    rows = materialize(components_.join(texts, "id").select("component", "text", "pos"), "factor-texts")
    named = numbered(rows.groupBy("component").agg(F.min("pos").alias("first")), ["first", "component"], "n")
    return rows.join(named.select("component", F.concat(F.lit("factor_"), F.col("n").cast("string")).alias("factor_id"), "first"), "component")


def factor_ids(components_: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts of a factor as one list, in order, as a report shows them; ``factor_rows`` has them as rows."""
    grouped = factor_rows(components_, texts).groupBy("component", "factor_id", "first").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t"))
    return grouped.select("component", "factor_id", "first", F.col("t.text").alias("texts"))


def abstract_factors(texts: DataFrame, vectors: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Texts to factors. texts: id, text, pos; vectors: id, v."""
    return factor_ids(components(texts, similar_links(vectors, threshold)), texts)


def text_map(factors: DataFrame) -> DataFrame:
    """text -> factor_id."""
    return factors.select("factor_id", F.explode("texts").alias("text"))


def label_samples(annotations: DataFrame, mapping: DataFrame) -> DataFrame:
    """image_id, factor_ids in first-seen order. Unknown texts are left out."""
    rows = annotations.select("image_id", F.posexplode("filter_factor_texts").alias("p", "text")).join(mapping, "text")
    first = rows.groupBy("image_id", "factor_id").agg(F.min("p").alias("p"))
    return first.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "factor_id"))), lambda x: x["factor_id"]).alias("factor_ids"))


def describe_factors(rows: DataFrame, descriptions: DataFrame) -> DataFrame:
    """The description falls back to the id."""
    return rows.join(descriptions, "factor_id", "left").withColumn("description", F.coalesce("description", "factor_id"))


def decode(ids: Column, probabilities: Column, threshold: float, strict: bool = False) -> Column:
    """The ids whose probability reaches (strict: exceeds) a threshold."""
    pairs = F.arrays_zip(ids.alias("id"), probabilities.alias("p"))
    return F.transform(F.filter(pairs, lambda x: x["p"] > threshold if strict else x["p"] >= threshold), lambda x: x["id"])


def multilabel_metrics(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Truth array<int> and probability array<double> of each row -> one row of metrics."""
    clamp = lambda p: F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p))
    bce = F.zip_with("truth", "probability", lambda t, p: -(t * F.log(clamp(p)) + (1 - t) * F.log(1 - clamp(p))))
    exact = F.forall(F.zip_with("truth", "probability", lambda t, p: t == (p >= threshold).cast("int")), lambda x: x)
    per_row = rows.select(F.posexplode(F.arrays_zip("truth", "probability")).alias("k", "x"))
    hit = (F.col("x.probability") >= threshold).cast("int")
    cls = per_row.groupBy("k").agg(F.sum(F.col("x.truth") * hit).alias("tp"), F.sum((1 - F.col("x.truth")) * hit).alias("fp"), F.sum(F.col("x.truth") * (1 - hit)).alias("fn"))
    f1 = lambda tp, fp, fn: 2 * tp / (2 * tp + fp + fn + 1e-8)
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    p, r = tp / (tp + fp + 1e-8), tp / (tp + fn + 1e-8)
    over = cls.agg(F.round(F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))), 6).alias("f1_macro"), F.round(p, 6).alias("precision_micro"), F.round(r, 6).alias("recall_micro"), F.round(2 * p * r / (p + r + 1e-8), 6).alias("f1_micro"))
    mean = F.aggregate(bce, F.lit(0.0), lambda a, x: a + x)
    whole = rows.agg(F.round(F.sum(mean) / F.sum(F.size("truth")), 6).alias("bce"), F.round(F.avg(exact.cast("int")), 6).alias("subset_accuracy"))
    return whole.crossJoin(over)


def routing_report(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """Samples, those with any predicted factor, mean number of them, and whether their share suffices."""
    some = F.count_if(F.size("predicted") > 0)
    return rows.agg(F.count(F.lit(1)).alias("samples"), some.alias("interpretable"), F.round(F.avg(F.size("predicted")), 6).alias("mean_predicted"), (some >= F.lit(least) * F.count(F.lit(1))).alias("passed"))


def set_f1(chosen: Column, true: Column) -> Column:
    """Both empty 1, one empty 0."""
    both = F.size(F.array_intersect(chosen, true))
    n, m = F.size(F.array_distinct(chosen)), F.size(F.array_distinct(true))
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0) | (both == 0), 0.0).otherwise(2.0 * both / (n + m))


def combined_reward(a: Column, b: Column, weight: float = 0.5) -> Column:
    """A21."""
    return weight * a + (1 - weight) * b


def align(vectors: DataFrame, images: DataFrame) -> DataFrame:
    """Vectors with their images by position; the counts must agree."""
    if vectors.count() != images.count():
        raise ValueError("as many vectors as images are needed")
    return vectors.join(images, "pos")


@dataclass
class LabelModel:
    """Weights (label x feature), biases, and the largest entry of each label's gradient where training ended."""

    labels: list[str]
    weights: np.ndarray
    biases: np.ndarray
    gradient: np.ndarray
    passes: int


def _loss_and_gradient(ready: DataFrame, w: np.ndarray, ridge: float, n: int, tasks: int) -> tuple[float, np.ndarray]:
    """Of all labels at once, in one reading. w: label x (feature + bias). ready: x (array), y (array), in so many tasks."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, total = 0.0, np.zeros_like(w)
        for batch in batches:
            if batch.num_rows:
                x, y = _matrix(batch.column(0)), _matrix(batch.column(1))
                x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
                z = x @ w.T
                loss += float((np.logaddexp(0, z) - y * z).sum())
                total += (0.5 * (1 + np.tanh(z / 2)) - y).T @ x
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([loss]), pa.array([total.ravel()], pa.list_(pa.float64()))], ["part", "loss", "g"])

    def summed(key, table):
        return pa.table({"loss": [float(np.sum(table["loss"].to_numpy()))], "g": pa.array([_matrix(table["g"]).sum(axis=0)], pa.list_(pa.float64()))})

    parts = ready.mapInArrow(partial, "part long, loss double, g array<double>")
    if tasks > TREE:  # a tree of two levels: each node sums about as many matrices
        parts = parts.groupBy(F.pmod("part", F.lit(int(tasks**0.5)))).applyInArrow(summed, "loss double, g array<double>")
    rows = parts.select("loss", "g").collect()  # a matrix for each node below the root
    penalty = w.copy()
    penalty[:, -1] = 0  # biases are free
    loss = sum(r.loss for r in rows) + 0.5 * ridge * n * float((penalty**2).sum())
    return loss, np.sum([r.g for r in rows], axis=0).reshape(w.shape) + ridge * n * penalty


def train_labels(rows: DataFrame, labels: list[str], features: str = "embedding", ridge: float = 1e-3, rounds: int = 200, tolerance: float = 1e-8) -> LabelModel:
    """Logistic models of all labels together, on the vector column. labels: columns of 0 and 1.

    The loss is convex and the labels share each reading: a step computes one matrix of gradients, whatever their number.
    Steps are those of L-BFGS with halving; training ends when no entry of the mean gradient exceeds the tolerance.
    Rows with a null vector or label are left out; without rows all weights are 0.
    """
    ready = rows.where(F.col(features).isNotNull() & ~F.exists(F.array(*labels), lambda x: x.isNull()))
    ready = materialize(ready.select(F.transform(features, lambda x: x.cast("double")).alias("x"), F.array(*[F.col(x).cast("double") for x in labels]).alias("y")), "labelled")
    n, width, tasks = ready.select(F.size("x").alias("w"), F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)), F.coalesce(F.max("w"), F.lit(0)), F.count_distinct("p")).first()
    w = np.zeros((len(labels), width + 1))
    if not n:
        return LabelModel(labels, w[:, :-1], w[:, -1], np.zeros(len(labels)), 0)
    loss, g = _loss_and_gradient(ready, w, ridge, n, tasks)
    passes, past = 1, []
    while np.abs(g).max() > tolerance * n and passes < rounds:
        step = -_two_loop(g, past) if past else -g / max(1.0, float(np.linalg.norm(g)))
        slope, scale = float((step * g).sum()), 1.0
        while True:
            new_loss, new_g = _loss_and_gradient(ready, w + scale * step, ridge, n, tasks)
            passes += 1
            if new_loss <= loss + 1e-4 * scale * slope + 1e-12 * abs(loss) or scale < 1e-10:
                break
            scale /= 2
        s, y = scale * step, new_g - g
        if float((s * y).sum()) > 1e-300:
            past = [*past[-19:], (s, y)]
        w, loss, g = w + s, new_loss, new_g
    return LabelModel(labels, w[:, :-1], w[:, -1], np.abs(g).max(axis=1) / n, passes)


def _two_loop(g: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The gradient times the inverse Hessian that past steps and their changes of gradient suggest."""
    q, kept = g.copy(), []
    for s, y in reversed(past):
        rho = 1 / float((s * y).sum())
        a = rho * float((s * q).sum())
        q -= a * y
        kept.append((a, rho))
    s, y = past[-1]
    q *= float((s * y).sum()) / float((y * y).sum())
    for (s, y), (a, rho) in zip(past, reversed(kept), strict=True):
        q += s * (a - rho * float((y * q).sum()))
    return q


def score_labels(rows: DataFrame, model: LabelModel, features: str = "embedding", threshold: float = 0.5) -> DataFrame:
    """Probability of each factor, and the factors at or above the threshold."""
    total = []
    for w, b in zip(model.weights.tolist(), model.biases.tolist(), strict=True):
        x = F.aggregate(F.zip_with(features, F.array(*[F.lit(c) for c in w]), lambda a, c: a.cast("double") * c), F.lit(b), lambda s, y: s + y)
        total.append(1 / (1 + F.exp(-x)))
    out = rows.withColumn("probability", F.array(*total))
    return out.withColumn("predicted", decode(F.array(*[F.lit(n) for n in model.labels]), F.col("probability"), threshold))
