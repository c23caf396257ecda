"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become integers, equal ones count once (the fit list), and the centred
fit list X is bidiagonalised: each step sends one short vector to the tasks,
which make u = Xv and then X'u over their packed rows. A left vector u is kept as
the short vector g with u = Xg, so tasks rebuild it from their own rows, nothing
as long as the list is stored or shuffled, and a lost executor costs a read. Both
sides are orthogonalised against all vectors before: the right ones on the
driver, the left ones with coefficients that the products X'u give, and again
with those that the pass itself measures. The driver holds vectors of the
embedding's dimension, never one of the list's length, and a packed row of sums
for each task.

Defined results: rows without a vector or with a null or non-finite entry go, as
do those whose entries leave the range of exact integers (64c beyond 2^52) and
those of another length than the commonest (ties: the longest). Repeated rows
and ids each keep their rows. With one distinct vector, or none, there is no
component and the result is empty; directions without variance have no
component. ``deviation`` is exact; where it or its parts leave 64 bits an
ArithmeticError ends the job. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Vectors in a packed block.
BLOCK = 4096
EXACT = float(1 << 52)


def _coded(vectors: np.ndarray) -> np.ndarray:
    """floor(64c) of float vectors; the shift is added where sums are made."""
    return np.floor(vectors.astype(np.float64) * SCALE)


def _codes(rows: DataFrame, dim: int, id_column: str) -> DataFrame:
    """(vec_id, code): the entries without the shift as packed integers, 32 bits
    where all of a vector's fit and 64 else, so equal vectors have equal codes."""
    id_type = rows.schema[id_column].dataType
    schema = rows.sparkSession.createDataFrame([], "code binary").schema.add("vec_id", id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).combine_chunks() if isinstance(batch.column(1), pa.ChunkedArray) else batch.column(1)
            flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
            x = _coded(flat.reshape(-1, dim)).astype(np.int64)
            narrow = np.abs(x).max(axis=1) < 1 << 31
            small = x.astype("<i4")
            codes = [(small[i] if short else x[i]).tobytes() for i, short in enumerate(narrow)]
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.binary()), batch.column(0)], names=["code", "vec_id"])

    return rows.select(F.col(id_column), "__v").mapInArrow(run, schema)


def _decoded(codes: list[bytes], dim: int) -> np.ndarray:
    narrow = [len(c) == 4 * dim for c in codes]
    if all(narrow):
        return np.frombuffer(b"".join(codes), "<i4").reshape(-1, dim).astype(np.int64)
    return np.stack([np.frombuffer(c, "<i4" if short else "<i8").astype(np.int64) for c, short in zip(codes, narrow)])


def _packed(codes: DataFrame, dim: int) -> DataFrame:
    """(n, most, block): distinct codes in packed blocks, as they lie in partitions;
    ``most`` is the largest absolute entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(codes: list[bytes]) -> pa.RecordBatch:
            x = _decoded(codes, dim)
            most = int(np.abs(x).max())
            kind = "<i4" if most < 1 << 31 else "<i8"
            return pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([most]), pa.array([x.astype(kind).tobytes()], pa.binary())], names=["n", "most", "block"])

        held: list[bytes] = []
        for batch in batches:
            held += batch.column(0).to_pylist()
            while len(held) >= BLOCK:
                yield made(held[:BLOCK])
                held = held[BLOCK:]
        if held:
            yield made(held)

    return codes.mapInArrow(run, "n long, most long, block binary")


def _summed(blocks: DataFrame, dim: int, width: int, kind: str, each: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of ``each`` (an array of ``width`` numbers): tasks
    add up their blocks and hand one packed row to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, kind)
        for batch in batches:
            for n, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(block, "<i4" if len(block) == 4 * dim * n else "<i8").reshape(n, dim)
                total += each(x.astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = [np.frombuffer(row.sums, kind) for row in blocks.select("n", "block").mapInArrow(run, "sums binary").collect()]
    return np.sum(parts, axis=0) if parts else np.zeros(width, kind)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n as doubles, from exact integers."""
    return (n * x - sums) / n


def _bidiagonalise(blocks: DataFrame, dim: int, n: int, sums: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Right singular vectors (columns) and values of the centred list, by falling
    value, and its squared Frobenius norm. Runs to ``dim`` steps, so repeated
    values are found as well; an exhausted direction goes on from a random one."""
    rng = np.random.default_rng(seed)
    norm2 = float(_summed(blocks, dim, 1, "<f8", lambda x: np.array([np.square(_centred(x, n, sums)).sum()]))[0])
    if norm2 == 0.0:
        return np.zeros((dim, 0)), np.zeros(0), 0.0
    tiny = np.sqrt(norm2) * dim * np.finfo(float).eps
    V, G, Z = np.zeros((dim, 0)), np.zeros((dim, 0)), np.zeros((dim, 0))
    alphas: list[float] = []
    betas: list[float] = []

    def orthogonal(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - V @ (V.T @ v)
        return v

    v = orthogonal(rng.standard_normal(dim))
    v /= np.linalg.norm(v)
    for _ in range(dim):
        V = np.column_stack([V, v])
        # u = Xv less its parts along all earlier u: those are (X'u_i)v
        g = v - G @ (Z.T @ v)

        def product(x: np.ndarray, g: np.ndarray = g, G: np.ndarray = G) -> np.ndarray:
            rows = _centred(x, n, sums)
            u = rows @ g
            return np.concatenate([[u @ u], rows.T @ u, (rows @ G).T @ u])

        made = _summed(blocks, dim, 1 + dim + G.shape[1], "<f8", product)
        z, left = made[1 : 1 + dim], made[1 + dim :]
        g, z = g - G @ left, z - Z @ left  # what the first pass over the left vectors has left
        alpha = float(np.sqrt(max(0.0, made[0] - left @ left)))
        if alpha <= tiny:
            alpha, g, z = 0.0, np.zeros(dim), np.zeros(dim)
        else:
            g, z = g / alpha, z / alpha
        G, Z = np.column_stack([G, g]), np.column_stack([Z, z])
        alphas.append(alpha)
        if V.shape[1] == dim:
            break
        v = orthogonal(z - alpha * v)
        beta = float(np.linalg.norm(v))
        if beta <= tiny:
            beta, v = 0.0, orthogonal(rng.standard_normal(dim))
        betas.append(beta)
        v = v / np.linalg.norm(v)
    small = np.diag(alphas) + np.diag(betas, 1)
    _, values, right = np.linalg.svd(small)
    vectors = V @ right.T
    keep = values > tiny
    return vectors[:, keep], values[keep], norm2


def whitened(vectors: DataFrame, components: int = COMPONENTS, seed: int = 12, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error):
    a row for each kept vector and component, numbered from 1 by falling variance."""
    spark = vectors.sparkSession
    v = F.col(vector_column).cast("array<double>")
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < EXACT / SCALE)
    rows = vectors.select(F.col(id_column), v.alias("__v")).where(F.col("__v").isNotNull() & (F.size("__v") > 0) & F.forall("__v", fits))
    lengths = rows.groupBy(F.size("__v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    id_type = vectors.schema[id_column].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim = lengths["dim"]
    codes = _codes(rows.where(F.size("__v") == dim), dim, id_column)
    blocks = stored(_packed(codes.select("code").distinct(), dim))
    n, most = map(int, blocks.agg(F.sum("n"), F.max("most")).first())
    if 2 * n * most >= 1 << 63:
        raise ArithmeticError("sums leave 64 bits")
    sums = _summed(blocks, dim, dim, "<i8", lambda x: x.sum(axis=0))
    directions, values, norm2 = _bidiagonalise(blocks, dim, n, sums, seed)
    basis, variances = directions[:, :components], values[:components] ** 2 / n
    basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])])
    if not basis.shape[1]:
        return spark.createDataFrame([], schema)
    scaled, k = basis / np.sqrt(variances), basis.shape[1]

    def products(x: np.ndarray) -> np.ndarray:
        w = _centred(x, n, sums) @ scaled
        return (w.T @ w).ravel()

    identity_error = float(np.abs(_summed(blocks, dim, k * k, "<f8", products).reshape(k, k) / n - np.eye(k)).max())
    explained = variances / (norm2 / n)
    lasting = spark.sparkContext.broadcast((sums, scaled))  # dim x components numbers

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, scaled = lasting.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _decoded(batch.column(0).to_pylist(), dim)
            apart = n * x - sums
            if float(np.abs(apart).max()) ** 2 * dim >= 2.0**63:
                raise ArithmeticError("deviations leave 64 bits")
            w = (apart / n) @ scaled
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(np.square(apart).sum(axis=1)), pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), k).cast(pa.list_(pa.float64()))], names=["vec_id", "deviation", "w"]
            )

    projected = codes.mapInArrow(project, f"vec_id {id_type}, deviation long, w array<double>")
    return projected.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(F.array(*(F.lit(float(e)) for e in explained)), F.col("at") + 1).alias("explained"), F.lit(identity_error).alias("identity_error"),
    )
