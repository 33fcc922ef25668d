"""Operators on records: top rows, upserts, merges, incremental chains, import plans, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.graph import written


def top(rows: DataFrame, by: list[str], order: list[Column], most: int, name: str = "place") -> DataFrame:
    """The first rows of each group with their place; partial limits run before the shuffle."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col(name) <= most)


def newest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key, the one of the greatest order: a last-writer-wins upsert of all rows. Aggregated before the shuffle."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    best = rows.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("x"))
    return best.select(*key, *[F.col(f"x.{c}").alias(c) for c in [*order, *rest]]).select(*rows.columns)


def filled(base: DataFrame, incoming: DataFrame, key: list[str], keep: list[str], replace: list[str]) -> DataFrame:
    """base with incoming: `keep` columns only where they were null, `replace` ones where the new is neither null nor the same.

    outcome is added, filled or untouched; rows only in base stay untouched.
    """
    new = incoming.select(*key, *[F.col(c).alias(f"__{c}") for c in keep + replace], F.lit(True).alias("__new"))
    old = base.withColumn("__old", F.lit(True))
    both = old.join(new, key, "full")
    value = {c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in keep} | {c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in replace}
    changed = F.lit(False)
    for c, v in value.items():
        changed = changed | ~v.eqNullSafe(F.col(c))
    outcome = F.when(F.col("__old").isNull(), "added").when(F.col("__new") & changed, "filled").otherwise("untouched")
    return both.withColumn("outcome", outcome).select(*key, *[v.alias(c) for c, v in value.items()], "outcome")


def chained(base: DataFrame, daily: DataFrame, present: DataFrame, key: str, light: list[str], heavy: list[str]) -> DataFrame:
    """A full state from a base and a day's changes: rows that are still present, changed ones new.

    A changed row whose `from_base` holds borrows its heavy columns from the base.
    """
    b = base.select(key, *[F.col(c).alias(f"b_{c}") for c in light + heavy])
    d = daily.select(key, "from_base", *[F.col(c).alias(f"d_{c}") for c in light + heavy])
    rows = present.select(key).join(b, key, "left").join(d, key, "left")
    fresh = F.col("from_base").isNotNull()
    cols = [F.when(fresh, F.col(f"d_{c}")).otherwise(F.col(f"b_{c}")).alias(c) for c in light]
    cols += [F.when(fresh & ~F.col("from_base"), F.col(f"d_{c}")).otherwise(F.col(f"b_{c}")).alias(c) for c in heavy]
    return rows.select(key, *cols, fresh.alias("changed"))


def changed(rows: DataFrame, sent: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows whose digest has not been sent under their key."""
    return rows.join(sent.select(key, digest), [key, digest], "left_anti")


def unreferenced(files: DataFrame, refs: DataFrame, name: str, at: str, before) -> DataFrame:
    """Files that nothing refers to and that are older than a moment."""
    return files.where(F.col(at) < F.lit(before)).join(refs.select(name), name, "left_anti")


def listed(rows: DataFrame, by: list[str], order: Column, value: Column, sep: str, name: str = "list") -> DataFrame:
    """(by, list): the values of each group in order, joined."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(pairs, lambda x: x["v"]), sep).alias(name))


def merged_marks(marks: DataFrame, merges: DataFrame, book: str) -> DataFrame:
    """marks (book, …) after each merge (keep, other): those of the other book are the kept one's, each once."""
    return marks.join(merges.select(F.col("other").alias(book), "keep"), book, "left").withColumn(book, F.coalesce("keep", book)).drop("keep").distinct()


def moved_rows(rows: DataFrame, merges: DataFrame, book: str) -> DataFrame:
    """rows with was: those of a merged book are the kept one's, and was is the book they had, null for those that stayed."""
    moved = rows.join(merges.select(F.col("other").alias(book), "keep"), book, "left")
    return moved.withColumn("was", F.when(F.col("keep").isNotNull(), F.col(book))).withColumn(book, F.coalesce("keep", book)).drop("keep").select(*rows.columns, "was")


def undone(rows: DataFrame, book: str) -> DataFrame:
    """rows of moved_rows() as they were."""
    return rows.withColumn(book, F.coalesce("was", book)).drop("was")


def merged_books(books: DataFrame, merges: DataFrame, key: str, fill: list[str], best: list[str]) -> DataFrame:
    """books without those merged away; the kept ones have `fill` columns from the others where they had none, `best` ones the greatest."""
    own = moved_rows(books, merges.select("keep", "other"), key)
    values = [F.coalesce(F.max(F.when(F.col("was").isNull(), F.col(c))), F.min(F.when(F.col("was").isNotNull(), F.col(c)))).alias(c) for c in fill]
    return own.groupBy(key).agg(*values, *(F.max(c).alias(c) for c in best), (F.count(F.lit(1)) - 1).alias("merged"))


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "n") -> DataFrame:
    """rows with their number from 1 in their group, in order; a group of very many rows is numbered by many tasks.

    Rows are dealt out by range of group and order, and each range's rows before it are added to their number in it.
    """
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    own = written(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = own.groupBy("__part").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "__before")
    placed = own.join(F.broadcast(before), "__part").withColumn("__at", F.col("__at") + F.col("__before"))  # a row a partition
    first = placed.groupBy(*by).agg(F.min("__at").alias("__first"))
    return placed.join(first, by).withColumn(name, F.col("__at") - F.col("__first") + 1).select(*rows.columns, name)
