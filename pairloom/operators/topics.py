"""Topics of documents: non-negative factors of a sparse table of weights, by multiplicative updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.setjoin import listed

from pairloom.runtime import cut

EPS = 1e-12


def _begin(rows: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """``key, f``: ``k`` numbers from 0.1 to 1.1 for each key, from a hash."""
    return rows.select(key).distinct().select(key, _first(key, k, seed).alias("f"))


def _first(key: str, k: int, seed: int) -> Column:
    return F.array(*[0.1 + F.pmod(F.xxhash64(key, F.lit(seed), F.lit(i)), F.lit(1_000_003)) / 1_000_003 for i in range(k)])


def _gram(factor: DataFrame, k: int) -> DataFrame:
    """One row of ``k * k`` sums of products."""
    products = [F.coalesce(F.sum(F.col("f")[i] * F.col("f")[j]), F.lit(0.0)) for i in range(k) for j in range(k)]
    return factor.agg(F.array(*products).alias("gram"))


def _updated(weights: DataFrame, own: str, other: str, factor: DataFrame, fixed: DataFrame, k: int) -> DataFrame:
    """``factor`` of ``own`` after one update against ``fixed``, the factor of ``other``.

    Products are summed by key on the map side; of the fixed factor only the small
    table of its products goes to all tasks.
    """
    met = weights.join(fixed.withColumnRenamed("f", "g"), other)
    sums = met.groupBy(own).agg(F.array(*[F.sum(F.col("x") * F.col("g")[i]) for i in range(k)]).alias("num"))
    rows = factor.join(sums, own).crossJoin(F.broadcast(_gram(fixed, k)))  # one row

    def new(i: int) -> Column:
        below: Column = F.lit(EPS)
        for j in range(k):
            below = below + F.col("f")[j] * F.col("gram")[j * k + i]
        return F.col("f")[i] * F.col("num")[i] / below

    return rows.select(own, F.array(*[new(i) for i in range(k)]).alias("f"))


def factors(weights: DataFrame, row: str, column: str, k: int, rounds: int = 20, seed: int = 7, small: bool = False) -> tuple[DataFrame, DataFrame]:
    """``row, f`` and ``column, f``: ``k`` non-negative numbers each, whose products are near the weights ``x``.

    Updates never raise the squared error. ``small`` says that the columns are few
    by a bound, so that their factor may be in each task and in the driver. Weights must
    be positive; a row or column without any has no factor.
    """
    weights = cut(weights.where("x > 0").select(row, column, "x"))
    if small:
        placed = cut(weights.agg(F.array_sort(F.collect_set(column)).alias("all")).select(F.posexplode("all").alias("at", column)))
        packed = weights.join(F.broadcast(placed), column).groupBy(row).agg(F.collect_list(F.struct("at", "x")).alias("own"))
        return packed_factors(packed.select(row, F.col("own.at").alias("at"), F.col("own.x").alias("x")), row, placed, column, k, rounds, seed)
    rows, columns = cut(_begin(weights, row, k, seed)), cut(_begin(weights, column, k, seed + 1))
    for _ in range(rounds):
        rows = cut(_updated(weights, row, column, rows, columns, k))
        columns = cut(_updated(weights, column, row, columns, rows, k))
    return rows, columns


def packed_factors(packed: DataFrame, row: str, placed: DataFrame, column: str, k: int, rounds: int, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """As ``factors``, of rows that hold their weights: ``row, at, x``, where ``at`` are places of few columns (``at, column``, from 0, all in use).

    A round is one pass over the rows: each task brings its rows up to date against all
    column factors so far, so their factors are never kept, and gives only sums for
    each column. A row without weights has no factor.
    """
    spark = packed.sparkSession
    packed = cut(packed.where(F.size("at") > 0).select(F.col(row), F.col("at").cast("array<int>").alias("at"), F.col("x").cast("array<double>").alias("x"), _first(row, k, seed).alias("f")))
    names = placed.select("at", column, _first(column, k, seed + 1).alias("f")).orderBy("at").collect()  # few by a bound
    steps = [np.array([r["f"] for r in names], float).reshape(-1, k)]

    def current(batch: pa.RecordBatch, steps: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """The rows' factors after an update against each of ``steps``, and row, place and weight of each weight."""
        many = np.diff(batch.column("at").offsets.to_numpy()).astype(np.int64)
        at, x = batch.column("at").flatten().to_numpy(), batch.column("x").flatten().to_numpy()
        f, begin = batch.column("f").flatten().to_numpy().reshape(-1, k), np.cumsum(many) - many
        for c in steps:
            f = f * np.add.reduceat(x[:, None] * c[at], begin) / (EPS + f @ (c.T @ c))
        return f, np.repeat(np.arange(len(many)), many), at, x

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        num, gram = np.zeros((k, len(names))), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                f, own, at, x = current(batch, steps)
                num += [np.bincount(at, x * f[own, i], len(names)) for i in range(k)]
                gram += f.T @ f
        every = np.append(num.ravel(), gram.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(every))), pa.array(every)], ["place", "value"])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                f = current(batch, steps)[0]
                yield pa.RecordBatch.from_arrays([batch.column(row), listed(np.full(len(f), k), f.ravel())], [row, "f"])

    for _ in range(rounds if names else 0):
        every = np.zeros(k * len(names) + k * k)
        for r in packed.mapInArrow(sums, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():  # a number for each column and factor
            every[r["place"]] = r["value"]
        num, gram, c = every[: k * len(names)].reshape(k, -1).T, every[k * len(names) :].reshape(k, k), steps[-1]
        steps.append(c * num / (EPS + c @ gram))
    columns = spark.createDataFrame([(r[column], f.tolist()) for r, f in zip(names, steps.pop() if names else [], strict=True)], f"{column} {placed.schema[column].dataType.simpleString()}, f array<double>")
    return cut(packed.mapInArrow(last, f"{row} {packed.schema[row].dataType.simpleString()}, f array<double>")), columns


def _one_row_each(docs: DataFrame) -> DataFrame:
    """``id, words``; the words of a repeated id are brought together."""
    ids = docs.select("id")
    if ids.distinct().count() == ids.count():
        return docs
    return docs.groupBy("id").agg(F.flatten(F.collect_list(F.coalesce("words", F.array().cast("array<string>")))).alias("words"))


def frequent_terms(docs: DataFrame, stop: tuple[str, ...], most: int) -> DataFrame:
    """``at, token, df``: the ``most`` most frequent words of ``docs`` (``id, words``), ties by the word, that two documents or more hold and at most nine in ten.

    A task shuffles two numbers for each of its words. Places count from 0 in the order of words.
    """
    total = docs.count()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each batch: its words, how many documents hold them, and how often they stand there."""
        for batch in batches:
            words = batch.column("words")
            own = words.flatten().dictionary_encode()
            at, many = own.indices.to_numpy().astype(np.int64), max(1, len(own.dictionary))
            df = np.bincount(np.unique(np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy())) * many + at) % many, minlength=many)
            n = np.bincount(at, minlength=many)
            yield pa.RecordBatch.from_arrays([own.dictionary, pa.array(df[: len(own.dictionary)]), pa.array(n[: len(own.dictionary)])], ["token", "df", "n"])

    rows = _one_row_each(docs).where("words IS NOT NULL").select("words")
    held = rows.mapInArrow(counted, "token string, df long, n long").where(~F.col("token").isin(list(stop)))
    held = held.groupBy("token").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
    chosen = held.where((F.col("df") >= 2) & (F.col("df") <= 0.9 * total)).orderBy(F.desc("n"), "token").limit(most)
    ordered = chosen.agg(F.array_sort(F.collect_list(F.struct("token", "df"))).alias("all"))  # ``most`` of them
    return ordered.select(F.posexplode("all").alias("at", "x")).select("at", "x.token", "x.df")


def packed_tf_idf(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """``id, at, x``: raw counts by smooth idf of the few words of ``placed``, each document (``id, words``) of length 1; one without any has no row."""
    known = placed.orderBy("at").collect()  # few by a bound
    names, df = pa.array([r["token"] for r in known], pa.string()), np.array([r["df"] for r in known], float)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            at = pc.index_in(words.flatten(), value_set=names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
            cell, tf = np.unique((row * max(1, len(names)) + at)[at >= 0], return_counts=True)
            row, at = np.divmod(cell, max(1, len(names)))
            many = np.bincount(row, minlength=len(words))
            has = pa.array(many > 0)
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(has), listed(many[many > 0], at.astype(np.int32)), listed(many[many > 0], tf.astype(np.float64))], ["id", "at", "tf"])

    rows = _one_row_each(docs).where("words IS NOT NULL")
    kind = docs.schema["id"].dataType.simpleString()
    held = cut(rows.mapInArrow(counted, f"id {kind}, at array<int>, tf array<double>"))
    n = held.count()

    def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = np.log((1 + n) / (1 + df)) + 1
        for batch in batches:
            if batch.num_rows:
                many = np.diff(batch.column("at").offsets.to_numpy()).astype(np.int64)
                w = batch.column("tf").flatten().to_numpy() * idf[batch.column("at").flatten().to_numpy()]
                length = np.sqrt(np.add.reduceat(w * w, np.cumsum(many) - many))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("at"), listed(many, w / np.repeat(length, many))], ["id", "at", "x"])

    return held.mapInArrow(weighted, f"id {kind}, at array<int>, x array<double>")


def squared_error(weights: DataFrame, row: str, column: str, rows: DataFrame, columns: DataFrame, k: int) -> float:
    """Sum of squared differences over the whole table, zeros included, without making it."""
    met = weights.join(rows, row).join(columns.withColumnRenamed("f", "g"), column)
    product: Column = F.lit(0.0)
    for i in range(k):
        product = product + F.col("f")[i] * F.col("g")[i]
    known = met.agg(F.coalesce(F.sum(F.col("x") * F.col("x")), F.lit(0.0)).alias("xx"), F.coalesce(F.sum(F.col("x") * product), F.lit(0.0)).alias("xy")).first()
    a, b = _gram(rows, k).first()["gram"], _gram(columns, k).first()["gram"]
    return known["xx"] - 2 * known["xy"] + sum(x * y for x, y in zip(a, b, strict=True))


def topic_terms(columns: DataFrame, term: str, k: int, best: int = 10) -> DataFrame:
    """``topic, terms``: the ``best`` terms of each topic by weight, ties by the term; terms are few by a bound."""
    each = columns.select(term, F.posexplode("f").alias("topic", "weight"))
    first = F.slice(F.array_sort(F.collect_list(F.struct((-F.round("weight", 9)).alias("w"), term))), 1, best)
    return each.groupBy("topic").agg(F.array_join(F.transform(first, lambda x: x[term]), " ").alias("terms"))


def topic_shares(rows: DataFrame, key: str, k: int) -> DataFrame:
    """``key, topic, share``: the heaviest topic of each row, the first of equal ones, and its share of all."""
    total = F.aggregate("f", F.lit(0.0), lambda acc, x: acc + x)
    place = (F.array_position("f", F.array_max("f")) - 1).cast("int")
    return rows.select(key, place.alias("topic"), F.when(total > 0, F.array_max("f") / total).otherwise(0.0).alias("share"))
