"""Tables of one row per key that are merged into, in hash buckets.

Layout: rows lie in ``slots``, the hash buckets of their key, as Spark's bucketed tables number them, so a merge joins
stored rows where they lie: only the incoming rows are shuffled, and only slots that an incoming key falls into are read
and written. A slot is written whole into a folder of the merge's own (a generation), all its partitions together, so a row
whose partition column changes leaves nothing behind in the old one. Null partitions are partitions like any other.

A merge becomes visible by one rename: its manifest lists for every slot the generation that holds it. Readers take the
latest manifest, and partition pruning on generation and slot leaves files of older states unread. A merge that dies
leaves files that no manifest names, and is simply run again. Of two merges at once the second to finish fails and is to
be run again. ``vacuum`` deletes what the last manifests don't name.

Repeated keys of the incoming rows are reduced to one first. Rows without a key match nothing: an update leaves them out,
an insert appends them to a slot of their own that no merge reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators.windows import keep_first

GENERATION, SLOT, PART = "__generation", "__slot", "__part"
UNKEYED = -1  # the slot of rows without a key


class ConcurrentMerge(RuntimeError):
    """Another merge was published since this one read the table."""


@dataclass(frozen=True)
class State:
    """One manifest: what the table is after a merge."""

    number: int
    key: list[str]
    by: str | None
    slots: list[str]  # the generation of every slot
    unkeyed: list[str]  # the generations of rows without a key
    schema: T.StructType

    def text(self) -> str:
        return json.dumps(
            {
                "number": self.number, "key": self.key, "by": self.by, "slots": self.slots, "unkeyed": self.unkeyed,
                "schema": self.schema.jsonValue(),
            }
        )

    @classmethod
    def of(cls, text: str) -> State:
        found = json.loads(text)
        return cls(**{**found, "schema": T.StructType.fromJson(found["schema"])})

    def generations(self) -> set[str]:
        return {g for g in [*self.slots, *self.unkeyed] if g}


class _Folder:
    """A folder of any store that Hadoop reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.path = path.rstrip("/")
        self.fs = self._path().getFileSystem(self.conf)

    def _path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        at = self._path(name)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def publish(self, name: str, text: str) -> bool:
        """Makes a file appear whole; False if there is one of that name already."""
        temporary = f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(temporary), True)
        stream.write(text.encode())
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self.conf)
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(self.fs.makeQualified(self._path(temporary)), self.fs.makeQualified(self._path(name)), options)
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            self.delete(temporary)
            return False
        return True


def slot_of(key: Sequence[str], slots: int) -> Column:
    """The bucket that Spark gives to a key."""
    return F.pmod(F.hash(*key), F.lit(slots))


def _part_of(by: str | None) -> Column:
    """A folder name for a value: null and empty text apart."""
    if by is None:
        return F.lit("all")
    value = F.col(by).cast("string")
    return F.when(value.isNull(), "null").otherwise(F.concat(F.lit("is "), value))


def _one_row_each(rows: DataFrame, key: Sequence[str], newest: Sequence[Column] | None) -> DataFrame:
    """One row of each key: the first in the order given, then the one with the greater other columns."""
    rest = [F.desc(c) for c in sorted(rows.columns) if c not in key]
    return keep_first(rows, list(key), [*(newest or []), *rest])


class KeyedTable:
    """A table at ``path``; see the module."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = _Folder(spark, self.path)

    # --- states -----------------------------------------------------------------------------

    def _manifests(self) -> list[str]:
        return sorted(n for n in self.folder.names("manifests") if not n.startswith("."))

    def state(self) -> State:
        found = self._manifests()
        if not found:
            raise FileNotFoundError(f"no keyed table at {self.path}")
        return State.of(self.folder.read(f"manifests/{found[-1]}"))

    def _publish(self, state: State) -> State:
        if not self.folder.publish(f"manifests/{state.number:012d}.json", state.text()):
            raise ConcurrentMerge(f"{self.path}: merge {state.number} was published by another writer")
        return state

    def exists(self) -> bool:
        return bool(self._manifests())

    @classmethod
    def create(
        cls, rows: DataFrame, path: str, key: str | Sequence[str] = "id", slots: int = 64, by: str | None = None,
        newest: Sequence[Column] | None = None,
    ) -> KeyedTable:
        """A new table of ``rows``, one of each key; a slot should hold some hundred MB."""
        table = cls(rows.sparkSession, path)
        key = [key] if isinstance(key, str) else list(key)
        empty = State(0, key, by, [""] * slots, [], rows.schema)
        if table.exists():
            raise FileExistsError(f"a keyed table is at {path} already")
        table._merge(empty, rows, insert=True, newest=newest)
        return table

    # --- reading ----------------------------------------------------------------------------

    def _files(self, state: State, types: T.StructType) -> DataFrame:
        more = [T.StructField(GENERATION, T.StringType()), T.StructField(SLOT, T.IntegerType()), T.StructField(PART, T.StringType())]
        if not state.generations():
            return self.spark.createDataFrame([], T.StructType([*types, *more]))
        return self.spark.read.schema(T.StructType([*types, *more])).parquet(f"{self.path}/data")

    def rows(
        self, values: Sequence | None = None, state: State | None = None, slots: Sequence[int] | None = None
    ) -> DataFrame:
        """The table's rows; ``values`` of the partition column (None among them) leave other partitions unread, and so
        do ``slots``."""
        state = state or self.state()
        current = F.get(F.array(*[F.lit(g) for g in state.slots]), F.col(SLOT)) == F.col(GENERATION)
        if state.unkeyed:
            current = current | ((F.col(SLOT) == UNKEYED) & F.col(GENERATION).isin(state.unkeyed))
        found = self._files(state, state.schema).where(current)
        if values is not None:
            if state.by is None:
                raise ValueError("the table has no partition column")
            kind = state.schema[state.by].dataType
            names = [F.lit("null") if v is None else F.concat(F.lit("is "), F.lit(v).cast(kind).cast("string")) for v in values]
            found = found.where(F.col(PART).isin(names))
        if slots is not None:
            found = found.where(F.col(SLOT).isin(list(slots)))
        return found.select(*state.schema.names)

    def stored_keys(self, keys: DataFrame, where: Column | None = None) -> DataFrame:
        """Those of ``keys`` that the table has (in rows for which ``where`` holds); only their slots are read, and of
        these the key's and the condition's columns."""
        state = self.state()
        wanted = keys.select(*state.key).where(_all_set(state.key)).distinct()
        here = self.rows(state=state, slots=self._touched(state, wanted))
        if where is not None:
            here = here.where(where)
        return wanted.join(here.select(*state.key), state.key, "left_semi")

    # --- merging ----------------------------------------------------------------------------

    def update(self, updates: DataFrame, newest: Sequence[Column] | None = None) -> State:
        """Writes the non-null columns of ``updates`` over the rows of the same key; unknown keys are left out."""
        return self._merge(self.state(), updates, insert=False, newest=newest)

    def upsert(self, incoming: DataFrame, version: str | None = None) -> State:
        """Takes whole rows in: of a key that is stored, the row of the greater ``version`` stays (the incoming one
        without a version); of equal versions the one with the greater other columns, in alphabetical order."""
        newest = [F.desc(version)] if version else None
        return self._merge(self.state(), incoming, insert=True, newest=newest, version=version)

    def _touched(self, state: State, keyed: DataFrame) -> list[int]:
        """At most one row for each slot comes to the driver."""
        found = keyed.select(slot_of(state.key, len(state.slots)).alias("s")).distinct().collect()
        return sorted(r["s"] for r in found)

    def _slots(self, state: State, touched: list[int], name: str) -> DataFrame:
        """Stored rows of some slots as a bucketed relation, registered in the session's catalog under ``name``."""
        live = [s for s in touched if state.slots[s]]
        self._register(state, name)
        by_generation: dict[str, list[int]] = {}
        for s in live:
            by_generation.setdefault(state.slots[s], []).append(s)
        for g, own in by_generation.items():
            for part in self._parts(g, own):
                self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {part}")
        return self.spark.table(name).select(*state.schema.names)

    def _parts(self, generation: str, slots: list[int], at_once: int = 200) -> Iterable[str]:
        """Partition clauses of a generation's folders, some hundred at a time."""
        found = []
        for s in slots:
            base = f"data/{GENERATION}={generation}/{SLOT}={s}"
            for name in self.folder.names(base):
                if name.startswith(f"{PART}="):
                    value = _unescaped(name[len(PART) + 1 :]).replace("\\", "\\\\").replace("'", "\\'")
                    place = f"{self.path}/{base}/{name}".replace("\\", "\\\\").replace("'", "\\'")
                    found.append(
                        f"PARTITION ({GENERATION}='{generation}', {SLOT}={s}, {PART}='{value}') LOCATION '{place}'"
                    )
                if len(found) >= at_once:
                    yield " ".join(found)
                    found = []
        if found:
            yield " ".join(found)

    def _register(self, state: State, name: str) -> None:
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema]
        keys = ", ".join(f"`{k}`" for k in state.key)
        self.spark.sql(
            f"CREATE TABLE {name} ({', '.join(fields)}, {GENERATION} string, {SLOT} int, {PART} string) USING parquet "
            f"PARTITIONED BY ({GENERATION}, {SLOT}, {PART}) CLUSTERED BY ({keys}) SORTED BY ({keys}) "
            f"INTO {len(state.slots)} BUCKETS LOCATION '{self.path}/data'"
        )

    def _write(self, state: State, rows: DataFrame, generation: str, slot: Column, bucketed: bool) -> None:
        marked = rows.select(
            *[F.col(c).cast(state.schema[c].dataType).alias(c) for c in state.schema.names],
            F.lit(generation).alias(GENERATION), slot.cast("int").alias(SLOT), _part_of(state.by).alias(PART),
        )
        if bucketed:
            name = f"keyed_{uuid.uuid4().hex}"
            self._register(state, name)
            marked.write.insertInto(name)
            self.spark.sql(f"DROP TABLE {name}")
        else:
            marked.write.partitionBy(GENERATION, SLOT, PART).mode("append").parquet(f"{self.path}/data")

    def _merged(
        self, state: State, stored: DataFrame, incoming: DataFrame, insert: bool, version: str | None
    ) -> DataFrame:
        """Stored rows and incoming ones, one of each key, merged. The stored side is read in its buckets."""
        changed = [c for c in incoming.columns if c not in state.key]
        new = incoming.select(*state.key, *[F.col(c).alias(f"__new_{c}") for c in changed], F.lit(True).alias("__in"))
        joined = stored.withColumn("__had", F.lit(True)).join(
            new, state.key, "full_outer" if insert else "left_outer"
        )
        if not insert:
            return joined.select(
                *[
                    F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c) if c in changed else F.col(c)
                    for c in state.schema.names
                ]
            )
        takes = F.col("__in").isNotNull()
        if version:
            # the order of the rows of a key, as in keep_first: version, then the other columns, nulls last
            order = [version, *[c for c in sorted(changed) if c != version]]
            greater, same = F.lit(False), F.lit(True)
            for c in order:
                a, b = F.col(f"__new_{c}"), F.col(c)
                greater = greater | (same & ((a.isNotNull() & b.isNull()) | F.coalesce(a > b, F.lit(False))))
                same = same & a.eqNullSafe(b)
            takes = takes & (F.col("__had").isNull() | greater)
        return joined.select(
            *[
                F.when(takes, F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in changed
                else (F.col(c) if c in state.key else F.when(takes & F.col("__had").isNull(), None).otherwise(F.col(c)).alias(c))
                for c in state.schema.names
            ]
        )

    def _merge(self, state: State, incoming: DataFrame, insert: bool, newest, version: str | None = None) -> State:
        unknown = set(incoming.columns) - set(state.schema.names)
        if unknown or not set(state.key) <= set(incoming.columns):
            raise ValueError(f"columns {sorted(unknown)} are not the table's, or its key {state.key} is missing")
        generation, n = uuid.uuid4().hex, len(state.slots)
        keyed = _one_row_each(incoming.where(_all_set(state.key)).repartition(n, *state.key), state.key, newest)
        touched = self._touched(state, incoming.where(_all_set(state.key)))
        after, unkeyed = list(state.slots), list(state.unkeyed)
        if touched:
            name = f"keyed_{uuid.uuid4().hex}"
            try:
                merged = self._merged(state, self._slots(state, touched, name), keyed, insert, version)
                self._write(state, merged, generation, slot_of(state.key, n), bucketed=True)
            finally:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            written = {int(s.partition("=")[2]) for s in self.folder.names(f"data/{GENERATION}={generation}")}
            for s in touched:
                after[s] = generation if s in written else ""
        if insert:
            rest = incoming.where(~_all_set(state.key))
            missing = [c for c in state.schema.names if c not in incoming.columns]
            rest = rest.withColumns({c: F.lit(None).cast(state.schema[c].dataType) for c in missing})
            if not rest.isEmpty():
                self._write(state, rest, generation, F.lit(UNKEYED), bucketed=False)
                unkeyed.append(generation)
        return self._publish(replace(state, number=state.number + 1, slots=after, unkeyed=unkeyed))

    def vacuum(self, keep: int = 1) -> int:
        """Deletes generations that none of the last ``keep`` states names (a merge under way among them: run it when
        there is none), and older manifests; the number of generations deleted."""
        manifests = self._manifests()
        named = set().union(*(State.of(self.folder.read(f"manifests/{m}")).generations() for m in manifests[-keep:]))
        gone = [n for n in self.folder.names("data") if n.startswith(f"{GENERATION}=") and n.partition("=")[2] not in named]
        for m in manifests[:-keep]:
            self.folder.delete(f"manifests/{m}")
        for name in gone:
            self.folder.delete(f"data/{name}")
        return len(gone)


def _all_set(key: Sequence[str]) -> Column:
    found = F.lit(True)
    for k in key:
        found = found & F.col(k).isNotNull()
    return found


def _unescaped(name: str) -> str:
    """A partition value from its folder's name."""
    from urllib.parse import unquote

    return unquote(name)
