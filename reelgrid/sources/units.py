"""Tables whose units (projects, videos, jobs) are replaced or removed as a whole, atomically and by version.

A store is a folder of named tables. Every commit writes new rows below ``data`` and the units that it replaces
below ``units``, then one entry of the log, which names the parts that each table consists of from then on. A unit
counts in the youngest part that replaced it; a unit without rows there is gone. Files are never changed: a reader
keeps the version it began with, a write that fails leaves no trace in any version, and several tables change in
one step. Entries are moved in place under the number of their version, which fails if another writer was faster;
the commit is then repeated on top of that one.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scale import BROADCAST_ROWS

#: Youngest parts are merged once there are more than so many, and as far back as that is cheap.
MOST_PARTS = 12
#: Attempts of a commit that meets other writers.
ATTEMPTS = 20


@dataclass(frozen=True)
class Change:
    """New rows of a table. Units named by ``keys`` are replaced if they have rows or are listed in ``units``.

    Without keys the whole table is replaced. ``rows`` may be None: then the listed units are removed.
    """

    rows: DataFrame | None
    keys: tuple[str, ...] = ()
    units: DataFrame | None = None


@dataclass(frozen=True)
class Part:
    """Rows of one commit: its folder, bytes, units that it replaced, and how many of them were replaced since."""

    name: str
    keys: tuple[str, ...]
    size: int
    units: int
    dead: int = 0
    rows: bool = True


@dataclass(frozen=True)
class Version:
    number: int
    tables: dict[str, tuple[Part, ...]] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"number": self.number, "tables": {n: [asdict(p) for p in parts] for n, parts in self.tables.items()}})

    @classmethod
    def from_json(cls, text: str) -> Version:
        doc = json.loads(text)
        parts = lambda found: tuple(Part(**(p | {"keys": tuple(p["keys"])})) for p in found)
        return cls(doc["number"], {n: parts(found) for n, found in doc["tables"].items()})


def commit(spark: SparkSession, path: str, changes: dict[str, Change]) -> int:
    """Apply changes of several tables as one new version; its number.

    Rows may come from reading the same store. Null unit keys are a unit like any other.
    """
    written = {name: _written(spark, path, name, change) for name, change in changes.items()}

    def apply(current: Version) -> Version:
        tables = dict(current.tables)
        for name, part in written.items():
            older = tables.get(name, ()) if part.keys else ()
            if any(p.keys != part.keys for p in older):
                raise ValueError(f"{name} has units by {older[0].keys}, not by {part.keys}")
            tables[name] = (*_counted(spark, path, name, older, part), part)
        return replace(current, tables=tables)

    number = _commit(spark, path, apply)
    for name in changes:
        _merge_young(spark, path, name)
    return number


def read(spark: SparkSession, path: str, name: str, schema: str | None = None, version: int | None = None) -> DataFrame:
    """Rows of a table in a version (the newest by default); an unknown table is empty and needs a schema.

    Parts without replaced units are read as they are. Others lose the rows of such units by an anti join with the
    units of younger parts, broadcast if counted small.
    """
    parts = _at(spark, path, version).tables.get(name, ())
    found = _rows(spark, path, name, parts, schema)
    if found is None:
        if schema is None:
            raise ValueError(f"{path} has no table {name}")
        return spark.createDataFrame([], schema)
    return found


def tables(spark: SparkSession, path: str, version: int | None = None) -> list[str]:
    """Names of the tables of a version."""
    return sorted(_at(spark, path, version).tables)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all versions, rising."""
    fs, at = _place(spark, f"{path}/log")
    if not fs.exists(at):
        return []
    return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(at) if f.getPath().getName().endswith(".json"))


def remove_unused(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Forget all but the ``keep`` newest versions and delete what only older ones, or failed writes, left.

    No other commit may run meanwhile, and readers of forgotten versions lose their files.
    """
    numbers = versions(spark, path)
    used = {(n, p.name) for v in numbers[-keep:] for n, parts in _at(spark, path, v).tables.items() for p in parts}
    for v in numbers[:-keep]:
        fs, at = _place(spark, _entry(path, v))
        fs.delete(at, False)
    for kind in ("data", "units"):
        fs, at = _place(spark, f"{path}/{kind}")
        for folder in fs.listStatus(at) if fs.exists(at) else ():
            for part in fs.listStatus(folder.getPath()):
                if (folder.getPath().getName(), part.getPath().getName()) not in used:
                    fs.delete(part.getPath(), True)


# Parts


def _written(spark: SparkSession, path: str, name: str, change: Change) -> Part:
    own, keys = uuid.uuid4().hex, tuple(change.keys)
    folder, n = f"{path}/data/{name}/{own}", 0
    if change.rows is not None:
        change.rows.write.parquet(folder)
    if keys:
        lists = [change.units.select(*keys)] if change.units is not None else []
        if change.rows is not None:
            lists.append(spark.read.schema(change.rows.schema).parquet(folder).select(*keys))
        if not lists:
            raise ValueError(f"{name}: neither rows nor units")
        units = lists[0].distinct() if len(lists) == 1 else lists[0].unionByName(lists[1]).distinct()
        units.write.parquet(f"{path}/units/{name}/{own}")
        n = spark.read.parquet(f"{path}/units/{name}/{own}").count()
    return Part(own, keys, _size(spark, folder), n, rows=change.rows is not None)


def _counted(spark: SparkSession, path: str, name: str, older: tuple[Part, ...], new: Part) -> tuple[Part, ...]:
    """Older parts with their replaced units counted anew; those without any unit left go."""
    out = []
    for k, part in enumerate(older):
        younger = _units(spark, path, name, [*older[k + 1 :], new])
        dead = _matching(_units(spark, path, name, [part]), younger, part.keys, "left_semi").count()
        if dead < part.units:
            out.append(replace(part, dead=dead))
    return tuple(out)


def _units(spark: SparkSession, path: str, name: str, parts: list[Part]) -> DataFrame:
    units = spark.read.parquet(*(f"{path}/units/{name}/{p.name}" for p in parts))
    return units.distinct() if len(parts) > 1 else units


def _matching(rows: DataFrame, units: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    other = units.toDF(*(f"_{k}" for k in keys))
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = one if same is None else same & one
    return rows.join(other, same, how)


def _rows(spark: SparkSession, path: str, name: str, parts: tuple[Part, ...], schema) -> DataFrame | None:
    found = None
    for k, part in enumerate(parts):
        if not part.rows:
            continue
        reader = spark.read.schema(schema) if schema else spark.read
        rows = reader.parquet(f"{path}/data/{name}/{part.name}")
        if part.dead:
            gone = _units(spark, path, name, list(parts[k + 1 :]))
            if sum(p.units for p in parts[k + 1 :]) <= BROADCAST_ROWS:
                gone = F.broadcast(gone)
            rows = _matching(rows, gone, part.keys, "left_anti")
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    return found


def _merge_young(spark: SparkSession, path: str, name: str) -> None:
    """Merge the youngest parts into one, back to the first that is more than twice as large as those after it.

    Every row is rewritten a number of times that grows with the logarithm of the table only.
    """
    parts = _at(spark, path, None).tables.get(name, ())
    if len(parts) <= MOST_PARTS:
        return
    first, total = len(parts) - 1, parts[-1].size
    while first > 0 and (parts[first - 1].size <= 2 * total or len(parts) - first < len(parts) // 2):
        first -= 1
        total += parts[first].size
    merged = parts[first:]
    rows = _rows(spark, path, name, merged, None)
    units = _units(spark, path, name, list(merged)) if first else None  # nothing older: removals are done with
    if rows is None and units is None:
        new = None
    else:
        new = _written(spark, path, name, Change(rows, merged[0].keys, units))

    def apply(current: Version) -> Version:
        now = current.tables.get(name, ())
        names = [p.name for p in now]
        if [p.name for p in merged if p.name in names] != [p.name for p in merged]:
            return current  # another writer replaced some of them: leave it at that
        at = names.index(merged[0].name)
        after = now[at + len(merged) :]
        kept = (*now[:at], *((new,) if new else ()))
        for k in range(len(after)):
            kept = (*_counted(spark, path, name, kept, after[k]), after[k])
        return replace(current, tables=current.tables | {name: kept})

    _commit(spark, path, apply)


# Log


def _commit(spark: SparkSession, path: str, apply) -> int:
    for _ in range(ATTEMPTS):
        current = _at(spark, path, None)
        new = apply(current)
        if new == current:
            return current.number
        new = replace(new, number=current.number + 1)
        if _put_entry(spark, path, new):
            return new.number
    raise RuntimeError(f"other writers were faster {ATTEMPTS} times: {path}")


def _put_entry(spark: SparkSession, path: str, version: Version) -> bool:
    """Move an entry in place; False if its number is taken."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs, own = _place(spark, f"{path}/log/.{uuid.uuid4().hex}")
    out = fs.create(own, False)
    out.write(bytearray(version.to_json(), "utf-8"))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), conf)
    plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(own, fs.makeQualified(_place(spark, _entry(path, version.number))[1]), plain)
        return True
    except Exception as error:  # noqa: BLE001
        fs.delete(own, False)
        if "FileAlreadyExists" in str(error):
            return False
        raise


def _at(spark: SparkSession, path: str, number: int | None) -> Version:
    if number is None:
        numbers = versions(spark, path)
        if not numbers:
            return Version(0)
        number = numbers[-1]
    fs, at = _place(spark, _entry(path, number))
    stream = fs.open(at)
    try:
        return Version.from_json(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _entry(path: str, number: int) -> str:
    return f"{path}/log/{number:020d}.json"


def _size(spark: SparkSession, path: str) -> int:
    fs, at = _place(spark, path)
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(at)
