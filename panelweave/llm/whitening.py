"""Whitening of embeddings with MLlib's distributed block matrices.

Rows are numbered and centred, laid out as blocks of a BlockMatrix, and
multiplied by their transpose; the small scatter matrix is decomposed on the
driver, and the blocks are multiplied by the whitening matrix.

Entries become integers first, so that sums and centred values are exact up to
one division. The fit uses each distinct vector once; copies are projected with
the rest.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import bound_batches, stored

SCALE, SHIFT = 64, 1_000_000
# Bytes of a block of centred rows, and blocks multiplied in one task.
BLOCK_BYTES, TASK_BLOCKS = 2 << 20, 8
OUT = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def integers(rows: DataFrame, vector: str) -> DataFrame:
    """Rows with a vector of finite entries only, and ``__x``: floor(64 c) + 1000000."""
    c = F.col(f"`{vector}`")
    finite = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    whole = F.transform(c, lambda e: F.floor(e.cast("double") * SCALE).cast("long") + SHIFT)
    return rows.where(c.isNotNull() & (F.size(c) > 0) & finite).withColumn("__x", whole)


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """Store ``rows`` with ``__i``, consecutive from 0 in the order they are
    stored: the place inside a task, plus the rows of the tasks before."""
    rows = stored(rows.withColumn("__m", F.monotonically_increasing_id()), name)
    part = F.shiftright("__m", 33)
    # one row per task
    sizes = rows.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("__p", F.coalesce(before, F.lit(0)).alias("__base"))
    place = F.col("__m") - F.shiftleft(part, 33) + F.col("__base")
    return rows.withColumn("__p", part).join(sizes, "__p").withColumn("__i", place).drop("__p", "__base", "__m")


def _partial(rows: DataFrame, column: str, make, size: int, merge=F.sum) -> list:
    """What ``make`` turns each batch of vectors (one per row) into, ``size``
    numbers, merged over the table."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                values = batch.column(0).flatten().to_numpy(zero_copy_only=False)
                found = make(values.reshape(batch.num_rows, -1))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(found.ravel())], names=["i", "v"])

    kind = "double" if "double" in dict(rows.dtypes)[column] else "long"
    got = rows.select(column).mapInArrow(run, f"i long, v {kind}").groupBy("i").agg(merge("v").alias("v"))
    return [r.v for r in sorted(got.collect())]


def blocks(rows: DataFrame, vector: str, count: int, dims: int) -> BlockMatrix:
    """A BlockMatrix of ``count`` rows from (__i, array of double)."""
    frame = rows.select(F.col("__i").alias("index"), array_to_vector(F.col(vector)).alias("vector"))
    frame = MLUtils.convertVectorColumnsFromML(frame, "vector")
    per = max(1, BLOCK_BYTES // (8 * dims))
    return IndexedRowMatrix(frame, count, dims).toBlockMatrix(per, dims)


def times(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """Product with the inner dimension dealt over ``splits`` tasks."""
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def whitening_matrix(scatter: np.ndarray, n: int, k: int):
    """(dims x k matrix, share of variance, known): unit eigenvectors by falling
    eigenvalue, each over the root of its eigenvalue. Directions without
    variance are not known and have a zero column."""
    cov = (scatter + scatter.T) / (2 * n)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    total = float(np.trace(cov))
    known = values > max(total, 0.0) * 1e-13
    scale = np.where(known, 1 / np.sqrt(np.where(known, values, 1.0)), 0.0)
    return vectors * scale, [float(v) / total if total > 0 else None for v in np.maximum(values, 0.0)], known


def whiten(rows: DataFrame, k: int = 16, vector: str = "embedding", keep=("vec_id",)) -> DataFrame:
    """One row per remaining row and component: the ``keep`` columns, then
    component, n, deviation, whitened, explained, identity_error.

    Left out are rows whose vector is null, empty, or holds a null or non-finite
    entry, and rows of another length than most (of equally common lengths the
    larger stays). ``n`` counts distinct vectors. Rows that repeat a vector, or
    an id, each have their own results. With fewer dimensions than ``k`` there
    are as many components. A direction without variance has a null ``whitened``
    and stays out of ``identity_error``; if there is none with variance, that is
    null, too. ``deviation`` is a long, or decimal(38,0) where the sums may pass
    a long. Without rows the result is empty. Columns outside ``keep`` are left
    out, and kept columns called like an output column are replaced.

    The driver holds one dims x dims matrix and lists of dims numbers.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    keep = [c for c in keep if c not in OUT]
    own = [F.col(f"`{c}`").alias(f"__keep{i}") for i, c in enumerate(keep)]
    rows = integers(rows.select(*own, F.col(f"`{vector}`").alias("__v")), "__v").drop("__v")
    rows = _numbered(rows, "whitening-rows")
    lengths = rows.groupBy(F.size("__x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        none = {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}
        return rows.select(*[F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)], *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    dims = lengths.d
    rows = rows.where(F.size("__x") == dims)
    fit = stored(rows.groupBy("__x").agg(F.min("__i").alias("__i")), "whitening-fit")
    n = fit.count()
    total = _partial(fit, "__x", lambda x: x.sum(0), dims)
    spots = rows.agg(F.max("__i")).first()[0] + 1

    # n x - S, exact; over n, this is the centred vector.
    off = F.zip_with(F.col("__x"), F.lit([int(s) for s in total]).cast("array<bigint>"), lambda x, s: x * F.lit(n).cast("long") - s)
    centred = F.transform(off, lambda d: d / F.lit(float(n)))
    matrix = blocks(fit.select("__i", centred.alias("c")), "c", spots, dims)
    splits = max(1, -(-matrix.numRowBlocks // TASK_BLOCKS), min(matrix.numRowBlocks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    scatter = times(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()
    weights, explained, known = whitening_matrix(scatter, n, min(k, dims))
    k = weights.shape[1]

    factor = spark.sparkContext.parallelize([((0, 0), DenseMatrix(dims, k, weights.ravel(order="F")))], 1)
    everything = blocks(rows.select("__i", centred.alias("c")), "c", spots, dims)
    product = everything.multiply(BlockMatrix(factor, dims, k)).toIndexedRowMatrix()
    projected = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    projected = stored(projected.select(F.col("index").alias("__i"), vector_to_array("vector").alias("y")), "whitening-rows-projected")

    own = projected.join(fit.select("__i"), "__i", "left_semi")
    centre = np.array(_partial(own, "y", lambda y: y.sum(0), k), float) / n
    covariance = np.array(_partial(own, "y", lambda y: (y - centre).T @ (y - centre), k * k), float).reshape(k, k) / n
    error = float(np.abs(covariance - np.eye(k))[known][:, known].max()) if known.any() else None

    ends = (_partial(fit, "__x", lambda x, f=f: f(x, 0), dims, m) for f, m in ((np.min, F.min), (np.max, F.max)))
    if sum(max(n * high - s, s - n * low) ** 2 for low, high, s in zip(*ends, total)) < 1 << 63:
        deviation = F.aggregate(off, F.lit(0).cast("long"), lambda a, d: a + d * d)
    else:
        deviation = F.aggregate(off.cast("array<decimal(18,0)>"), F.lit(0).cast("decimal(38,0)"), lambda a, d: (a + d * d).cast("decimal(38,0)"))
    facts = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.lit(explained[i]).cast("double").alias("explained"),
                               F.lit(bool(known[i])).alias("known")) for i in range(k)])
    kept = [f"__keep{i}" for i in range(len(keep))]
    met = rows.select(*kept, "__i", deviation.alias("deviation")).join(projected, "__i")
    out = met.select(*kept, "deviation", F.explode(F.arrays_zip(facts.alias("f"), F.col("y"))).alias("c"))
    return out.select(
        *[F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)], F.col("c.f.component").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(F.col("c.f.known"), F.col("c.y")).alias("whitened"), F.col("c.f.explained").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))

