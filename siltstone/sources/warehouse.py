"""The catalog's tables as Parquet folders in parts: versioned schema, checked changes, one switch for all tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "libraries": "id long, name string, created_at timestamp",
    "versions": "id long, library_id long, name string, status string, progress_pages long, progress_max_pages long, error_message string, "
    "started_at timestamp, updated_at timestamp, source_url string, scraper_options string, created_at timestamp",
    "pages": "id long, version_id long, url string, title string, etag string, last_modified string, content_type string, depth int, created_at timestamp, updated_at timestamp",
    "documents": "id long, page_id long, content string, metadata struct<level:int,path:array<string>,types:array<string>>, sort_order int, embedding array<float>, created_at timestamp",
    "postings": "term string, doc_id long, tf long, dl long",
    "text_stats": "documents long, length long",
    "_schema_version": "version long, name string, applied_at timestamp",
}
#: What is unique in a table, and what it refers to: (column, table).
UNIQUE = {"libraries": (("id",), ("name",)), "versions": (("id",), ("library_id", "name")), "pages": (("id",), ("version_id", "url")), "documents": (("id",), ("page_id", "sort_order"))}
REFERS = {"versions": ("library_id", "libraries"), "pages": ("version_id", "versions"), "documents": ("page_id", "pages")}
#: (version, name), in order.
MIGRATIONS = ((1, "tables"), (2, "drop_orphans"))
#: The part of tables that are not cut.
ALL = "all"


class ConstraintError(ValueError):
    """A change that would repeat a key or leave a row without its parent."""


class Warehouse:
    """Tables under ``root``, each in parts (pages, documents and postings: one for each version).

    A state file names the generations of every part. A change writes new
    generations of the parts it touches, checks them, and then puts a new state
    file in place, which is one rename: readers see all tables before or after
    it. One writer; generations that neither the last state nor the one before
    names are removed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path, self._text = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.migrate()

    # State

    def _states(self) -> list[str]:
        folder = self._path(f"{self.root}/_state")
        if not self._fs.exists(folder):
            return []
        return sorted(name for s in self._fs.listStatus(folder) if (name := str(s.getPath().getName())).startswith("current-"))

    def _load(self, name: str | None = None) -> dict:
        """{"tables": {table: {part: [generation]}}, "next": {table: id}}."""
        if name is None:
            names = self._states()
            if not names:
                return {"tables": {}, "next": {}}
            name = names[-1]
        stream = self._fs.open(self._path(f"{self.root}/_state/{name}"))
        try:
            return json.loads(self._text.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _switch(self, state: dict) -> None:
        names = self._states()
        number = int(names[-1].split("-")[1]) + 1 if names else 1
        draft = self._path(f"{self.root}/_state/.next-{uuid.uuid4().hex}")
        stream = self._fs.create(draft)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        self._fs.rename(draft, self._path(f"{self.root}/_state/current-{number:012d}"))
        for old in names[:-1]:  # readers may still hold the last one
            held = {self._folder(t, p, g) for s in (state, self._load(names[-1])) for t, p, g in _generations(s)}
            for t, p, g in _generations(self._load(old)):
                if self._folder(t, p, g) not in held:
                    self._fs.delete(self._path(self._folder(t, p, g)), True)
            self._fs.delete(self._path(f"{self.root}/_state/{old}"), False)

    def _folder(self, name: str, part: str, generation: str) -> str:
        return f"{self.root}/{name}/{part}/{generation}"

    # Reading

    def parts(self, name: str) -> list[str]:
        return sorted(self._load()["tables"].get(name, {}))

    def read(self, name: str, *parts: str | int) -> DataFrame:
        """A table, or some of its parts."""
        return self._read(self._load(), name, *parts)

    def _read(self, state: dict, name: str, *parts: str | int) -> DataFrame:
        there = state["tables"].get(name, {})
        wanted = [str(p) for p in parts] or sorted(there)
        paths = [self._folder(name, p, g) for p in wanted for g in there.get(p, [])]
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths)

    def next_id(self, name: str) -> int:
        return self._load()["next"].get(name, 1)

    # Changing

    def change(self, new: dict[str, dict[str | int, DataFrame | None]], append: bool = False) -> None:
        """Parts of tables become the given rows, or go where there are none; all at once, or nothing if anything fails.

        Given rows may read the tables. With ``append`` they come to what the
        part holds. Keys that repeat and rows without a parent are an error.
        """
        state = self._load()
        made: list[tuple[str, str, str]] = []
        try:
            for name, parts in new.items():
                columns = self.spark.createDataFrame([], SCHEMAS[name]).schema
                there = state["tables"].setdefault(name, {})
                for part, df in ((str(p), d) for p, d in parts.items()):
                    if df is None:
                        there.pop(part, None)
                        continue
                    generation = uuid.uuid4().hex
                    made.append((name, part, generation))
                    df.select(*[F.col(c.name).cast(c.dataType).alias(c.name) for c in columns]).write.parquet(self._folder(name, part, generation))
                    there[part] = [*there.get(part, []), generation] if append else [generation]
            for name, parts in new.items():
                touched = [str(p) for p, d in parts.items() if d is not None]
                if touched:
                    self._check(state, name, touched)
                if touched and "id" in self.spark.createDataFrame([], SCHEMAS[name]).columns:
                    top = self._read(state, name, *touched).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
                    state["next"][name] = max(state["next"].get(name, 1), top + 1)
        except BaseException:
            for name, part, generation in made:
                self._fs.delete(self._path(self._folder(name, part, generation)), True)
            raise
        self._switch(state)

    def _check(self, state: dict, name: str, parts: list[str]) -> None:
        """Keys hold within the parts that change: ids are given once, and a part holds a version's rows."""
        rows = self._read(state, name, *parts)
        for key in UNIQUE.get(name, ()):
            if not rows.groupBy(*key).count().filter("count > 1").isEmpty():
                raise ConstraintError(f"{name}: {', '.join(key)} repeats")
        if name in REFERS:
            column, parent = REFERS[name]
            above = self._read(state, parent, *(parts if parent == "pages" else ())).select(F.col("id").alias(column))
            if not rows.join(above, column, "left_anti").isEmpty():
                raise ConstraintError(f"{name}: {column} without a row of {parent}")

    def replace(self, name: str, df: DataFrame) -> None:
        """A table that is not cut becomes ``df``, which may read it."""
        self.change({name: {ALL: df}})

    def append(self, name: str, df: DataFrame) -> None:
        self.change({name: {ALL: df}}, append=True)

    # Migrations

    def version(self) -> int:
        return self.read("_schema_version").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def migrate(self) -> list[int]:
        """Apply missing migrations in order; the versions applied."""
        done = pending([v for v, _ in MIGRATIONS], self.version())
        for version, name in MIGRATIONS:
            if version not in done:
                continue
            if name == "drop_orphans":
                self.drop_orphans()
            row = self.spark.createDataFrame([(version, name)], "version long, name string").withColumn("applied_at", F.current_timestamp())
            self.append("_schema_version", row)
        return done

    def drop_orphans(self) -> list[str]:
        """Remove parts of versions that are gone; their names."""
        there = {str(r[0]) for r in self.read("versions").select("id").collect()}
        gone = {t: {p: None for p in self.parts(t) if p not in there} for t in ("pages", "documents", "postings", "text_stats")}
        if any(gone.values()):
            self.change(gone)
        return sorted({p for parts in gone.values() for p in parts})


def _generations(state: dict):
    for name, parts in state["tables"].items():
        for part, generations in parts.items():
            for g in generations:
                yield name, part, g


def pending(known: list[int], now: int) -> list[int]:
    """Versions after ``now``, in order."""
    return sorted(v for v in known if v > now)
