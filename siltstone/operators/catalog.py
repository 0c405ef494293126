"""Catalog operators: lookups, counts, upsert, find-or-create, cascading deletes, checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written

STATUSES = ("not_indexed", "queued", "running", "completed", "failed", "cancelled", "updating")
#: The version status that a job's status implies.
OF_JOB = {"queued": "queued", "running": "running", "cancelling": "running", "completed": "completed", "failed": "failed", "cancelled": "cancelled"}


def by_key(table: DataFrame, **keys) -> DataFrame:
    """Rows whose columns equal the given values."""
    for name, value in keys.items():
        table = table.filter(F.col(name) == F.lit(value))
    return table


def by_name(table: DataFrame, column: str, name: str, **keys) -> DataFrame:
    """Rows whose ``column`` equals ``name`` in any case, and other columns exactly."""
    return by_key(table.filter(F.lower(column) == name.lower()), **keys)


def exists(table: DataFrame, column: str, name: str) -> bool:
    return not by_name(table, column, name).isEmpty()


def latest(table: DataFrame, parent: str, created: str, key: str) -> DataFrame:
    """The newest row of each parent, the largest key among equals: one aggregate with partial maxima."""
    newest = F.max_by(F.struct(*[F.col(c) for c in table.columns]), F.struct(created, key)).alias("row")
    return table.groupBy(parent).agg(newest).select("row.*")


def counts_per_parent(parents: DataFrame, children: DataFrame, key: str, ref: str, label: str, where: Column | None = None) -> DataFrame:
    """Every parent with its number of children, 0 included. Children are counted before the join."""
    kids = children.filter(where) if where is not None else children
    n = kids.groupBy(F.col(ref).alias(key)).agg(F.count("*").alias(label))
    return parents.join(n, key, "left").withColumn(label, F.coalesce(label, F.lit(0)).cast("long"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str], order: Sequence[Column | str] = ()) -> DataFrame:
    """``old`` with the rows of ``new``: on equal keys new values win, but ``keep`` stays as it was.

    Of several new rows with one key the last by ``order`` counts.
    """
    if order:
        w = Window.partitionBy(*keys).orderBy(*[F.desc(o) if isinstance(o, str) else o for o in order])
        new = new.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    there, came = F.col(f"o.{keys[0]}").isNotNull(), F.col(f"n.{keys[0]}").isNotNull()

    def pick(c: str) -> Column:
        if c in keys or c in keep:
            return F.when(there, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        return F.when(came, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return o.join(n, on, "full_outer").select(*[pick(c).alias(c) for c in old.columns])


def find_or_create(table: DataFrame, wanted: DataFrame, name: str, key: str) -> DataFrame:
    """``table`` plus a row (key, name) for each wanted name it lacks, names lower-cased."""
    names = wanted.select(F.lower(name).alias(name)).distinct()
    missing = names.join(table.select(F.lower(name).alias(name)), name, "left_anti")
    return table.select(key, name).unionByName(assign_ids(missing, table, key, [name]).select(key, name))


def assign_ids(new: DataFrame, old: DataFrame | int, key: str, order: Sequence[str]) -> DataFrame:
    """New rows numbered after the largest id of ``old`` (or that number), in ``order``.

    Rows are dealt by ranges of the order, sorted, and written with their place
    in their range; a count per range then gives the number before it. So no
    task sees all rows, and ranges are drawn once.
    """
    top = F.lit(old) if isinstance(old, int) else old.agg(F.coalesce(F.max(key), F.lit(0)).cast("long")).scalar()
    dealt = new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    placed = written(dealt, "ids").withColumns({"_part": F.shiftrightunsigned("_m", 33), "_place": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row per range
    numbered = placed.join(before, "_part").withColumn(key, (top + F.col("_before") + F.col("_place") + 1).cast("long"))
    return numbered.drop("_m", "_part", "_place", "_before")


def delete_cascade(tables: Sequence[tuple[str, DataFrame, str, str | None]], root: Column) -> dict[str, DataFrame]:
    """Tables of a chain (name, table, key, reference to the one before) without the root rows and what hangs on them."""
    out: dict[str, DataFrame] = {}
    gone: DataFrame | None = None
    for name, table, key, ref in tables:
        doomed = table.filter(root) if gone is None else table.join(gone.withColumnRenamed("_key", ref), ref, "left_semi")
        keys = doomed.select(F.col(key).alias("_key"))
        out[name] = table.join(keys.withColumnRenamed("_key", key), key, "left_anti")
        gone = keys
    return out


def delete_children(table: DataFrame, ref: str, parent) -> DataFrame:
    """``table`` without the rows that refer to ``parent``; rows that refer to none stay."""
    return table.filter(~F.col(ref).eqNullSafe(F.lit(parent)))


def duplicates(table: DataFrame, *keys: str) -> DataFrame:
    return table.groupBy(*keys).count().filter("count > 1")


def orphans(children: DataFrame, parents: DataFrame, ref: str, key: str) -> DataFrame:
    return children.join(parents.select(F.col(key).alias(ref)), ref, "left_anti")


def status_of_job(job_status: Column) -> Column:
    out = F.lit("not_indexed")
    for job, version in OF_JOB.items():
        out = F.when(job_status == job, version).otherwise(out)
    return out


def set_status(versions: DataFrame, version_id: int, status: str, error: str | None = None) -> DataFrame:
    """``versions`` with one row's status, error and time of change replaced."""
    mine = F.col("id") == version_id
    return versions.withColumns(
        {
            "status": F.when(mine, status).otherwise(F.col("status")),
            "error_message": F.when(mine, F.lit(error)).otherwise(F.col("error_message")),
            "updated_at": F.when(mine, F.current_timestamp()).otherwise(F.col("updated_at")),
        }
    )


def set_progress(versions: DataFrame, version_id: int, pages: int, most: int) -> DataFrame:
    mine = F.col("id") == version_id
    new = {"progress_pages": F.lit(pages), "progress_max_pages": F.lit(most), "updated_at": F.current_timestamp()}
    return versions.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in new.items()})


def unversioned(name: Column) -> Column:
    """The name that stands for no version becomes empty."""
    return F.when(name == "_default_", "").otherwise(name)


def listing(versions: DataFrame, library: str, version: str) -> DataFrame:
    """(library, versions, n_versions): names joined in order, ``none`` without any."""
    named = F.filter(F.sort_array(F.collect_set(version)), lambda v: v != "")
    return versions.groupBy(F.col(library).alias("library")).agg(
        F.when(F.size(named) == 0, "none").otherwise(F.array_join(named, ", ")).alias("versions"),
        F.countDistinct(version).cast("long").alias("n_versions"),
    )
