"""Near-duplicate clip texts: banded MinHash, Bayesian pruning, exact verification, components.

Works on clip texts: one row per clip with ``clip_id`` and ``description``. Texts with equal shingle sets
collapse to one class first. Classes that share a band are candidates; their signatures are compared batch
by batch, and a pair is dropped as soon as the posterior probability of a similarity at the threshold falls
below MISS. What survives is verified on full shingle sets.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written_once
from .batches import all_cores, mixed, slices
from .components import components

#: BANDS bands of ROWS hashes: a pair at similarity 0.8 shares no band with probability 3e-6.
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Hashes compared before each look at the posterior; probability at which a pair is given up.
BATCH, MISS = 32, 1e-6
#: Classes of a bucket that are compared as one block against another.
BLOCK = 512
_MULTIPLIERS = mixed(np.arange(1, HASHES + 1)) | np.uint64(1)
_SEEDS = mixed(np.arange(1, HASHES + 1) + (1 << 32))


def near_duplicates(
    texts: DataFrame, key: str = "clip_id", text: str = "description", width: int = 5, percent: int = 80
) -> DataFrame:
    """Groups of texts whose sets of ``width``-word shingles overlap by ``percent`` (intersection over union).

    Output: ``key``, ``n_shingles``, ``component_id`` (smallest key reachable by links, itself included) and
    ``kept`` (the text with that key). Words are runs without ASCII spaces, A-Z lower-cased; a text with
    fewer words than ``width`` is one shingle of all its words.

    Null, empty and blank texts have no shingles and are linked with nothing. A null key cannot name a group:
    its component is null and it is kept. Rows that repeat a key are compared each with its own text. Other
    columns are ignored. Candidates are first linked to one hub per bucket; only classes of one bucket that
    are in different groups by then are compared further, in blocks of bounded size that report one link for
    every two groups they join, so a large group of copies is never expanded into pairs.
    """
    source = all_cores(texts.select(key, text), text)
    kind = source.schema[0].dataType.simpleString()
    signed = written_once(
        source.mapInArrow(
            lambda batches: _signatures(batches, width),
            f"id {kind}, n_shingles bigint, set_hash binary, signature binary",
        )
    )
    members = signed.select("id", "n_shingles", "set_hash")
    named = members.where("id IS NOT NULL AND n_shingles > 0")
    classes = named.groupBy("set_hash").agg(F.min("id").alias("rep"))
    chosen = signed.join(classes, "set_hash").where("id = rep").dropDuplicates(["set_hash"])
    chosen = written_once(chosen.select("rep", "set_hash", "n_shingles", "signature"))
    bands = chosen.select("rep", "signature").mapInArrow(_bands, f"bucket bigint, rep {kind}")
    hubs = bands.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1")
    shared = written_once(bands.join(hubs, "bucket"))
    involved = shared.select("rep").distinct()
    wanted = chosen.join(involved, "rep", "left_semi").select("rep", "set_hash", "signature")
    profiles = _profiles(source, wanted, width, kind)
    stars = shared.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    a, b = (profiles.select(F.col("rep").alias(x), F.col("shingles").alias(f"_{x}")) for x in "ab")
    common = F.size(F.array_intersect("_a", "_b"))
    union = F.size("_a") + F.size("_b") - common
    pairs = _pruned(stars, profiles.select("rep", "signature"), percent).join(a, "a").join(b, "b")
    links = written_once(pairs.where(100 * common >= percent * union).select("a", "b"))
    roots = components(links)
    across = written_once(_across(shared, roots, profiles, percent))
    if not across.isEmpty():
        roots = components(links.unionByName(across))
    return _labelled(members, classes, roots).withColumnRenamed("id", key)


def _labelled(members: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    named = classes.join(roots, classes.rep == roots.node, "left").select(
        "set_hash", F.coalesce("root", "rep").alias("root")
    )
    component = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("root", "id"))
    return (
        members.join(named, "set_hash", "left")
        .withColumn("component_id", component)
        .select("id", "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def _shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted per text, and the bounds of each text."""
    import xxhash

    words = [(x or b"").lower().split() for x in column.cast(pa.binary()).to_pylist()]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for x in words for w in x]
    number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
    flat = hashed[np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))]
    starts = np.cumsum(counts) - counts
    # Windows of up to `width` words; a text with fewer words has one, over all of them.
    n = np.maximum(np.minimum(counts, 1), counts - width + 1)
    of = np.repeat(np.arange(len(words)), n)
    first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + starts[of]
    sizes = np.minimum(counts, width)[of]
    rolled = np.zeros(len(first), np.uint64)
    for i in range(width):
        inside = sizes > i
        step = flat[np.minimum(first + i, len(flat) - 1)] if len(flat) else rolled
        rolled = np.where(inside, mixed(rolled + step + np.uint64(i + 1)), rolled)
    order = np.lexsort((rolled, of))
    rolled, of = rolled[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (rolled[1:] != rolled[:-1]) | (of[1:] != of[:-1])
    rolled, of = rolled[new], of[new]
    return rolled, np.append(0, np.cumsum(np.bincount(of, minlength=len(words))))


def _signatures(batches, width: int):
    import xxhash

    for batch in slices(batches, 1, 1 << 20):
        values, bounds = _shingles(batch.column(1), width)
        sizes = np.diff(bounds)
        full = np.flatnonzero(sizes)
        signature = np.empty((len(full), HASHES), np.uint32)
        if len(full):
            for k in range(HASHES):
                least = np.minimum.reduceat((values ^ _SEEDS[k]) * _MULTIPLIERS[k], bounds[full])
                signature[:, k] = least >> np.uint64(32)
        rows: list = [None] * len(sizes)
        for i, row in zip(full, signature, strict=True):
            rows[i] = row.tobytes()
        hashes = [xxhash.xxh3_128_digest(values[a:b].tobytes()) for a, b in zip(bounds, bounds[1:], strict=False)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes), pa.array(hashes, pa.binary()), pa.array(rows, pa.binary())],
            ["id", "n_shingles", "set_hash", "signature"],
        )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), HASHES)


def _bands(batches):
    for batch in batches:
        signature = _matrix(batch.column(1)).reshape(-1, BANDS, ROWS).astype(np.uint64)
        bucket = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), signature.shape[:2])
        for i in range(ROWS):
            bucket = mixed(bucket + signature[:, :, i])
        rep = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))
        yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel().view(np.int64)), rep], ["bucket", "rep"])


@lru_cache(maxsize=4)
def least_matches(percent: int) -> tuple[tuple[int, int], ...]:
    """(hashes compared, fewest equal ones) below which P(similarity >= percent/100) < MISS, uniform prior."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            weight = m * np.log(grid) + (n - m) * np.log1p(-grid)
            weight = np.exp(weight - weight.max())
            if weight[grid >= percent / 100].sum() >= MISS * weight.sum():
                break
        out.append((n, m))
    return tuple(out)


def _pruned(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that no look at the posterior gives up."""
    looks = least_matches(percent)

    def run(batches):
        for batch in batches:
            alive = np.arange(batch.num_rows)
            left, right = _matrix(batch.column(2)), _matrix(batch.column(3))
            equal, done = np.zeros(len(alive), np.int64), 0
            for n, least in looks:
                equal += (left[alive, done:n] == right[alive, done:n]).sum(1)
                alive, equal, done = alive[equal >= least], equal[equal >= least], n
            yield batch.select([0, 1]).take(pa.array(alive))

    a, b = (signatures.select(F.col("rep").alias(x), F.col("signature").alias(f"_{x}")) for x in "ab")
    kind = pairs.schema["a"].dataType.simpleString()
    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "_a", "_b")
    return joined.mapInArrow(run, f"a {kind}, b {kind}")


def _across(shared: DataFrame, roots: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside buckets between classes that are still in different groups.

    A bucket of n classes is dealt into blocks of about BLOCK classes; each task compares two blocks, and
    reports one link for every two groups that it joins, so the result grows with the groups, not with pairs.
    """
    placed = shared.join(roots, shared.rep == roots.node, "left").select(
        "bucket", "rep", "n", F.coalesce("root", "rep").alias("root")
    )
    mixed_buckets = (
        placed.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")
    )
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    dealt = (
        placed.join(mixed_buckets, "bucket", "left_semi")
        .withColumns({"_blocks": blocks, "_own": own})
        .select("bucket", "rep", "root", "_own", other)
        .select("bucket", "rep", "root", "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))
        .join(profiles, "rep")
    )
    kind = shared.schema["rep"].dataType.simpleString()
    looks = least_matches(percent)

    def compare(table: pa.Table) -> pa.Table:
        first = pc.equal(table["_own"], table["_i"])
        second = pc.equal(table["_own"], table["_j"])
        left, right = table.filter(first), table.filter(second)
        same_block = table["_i"][0].as_py() == table["_j"][0].as_py()
        a, b = _joining(left, right, looks, same_block, percent)
        return pa.table({"a": left["rep"].take(a), "b": right["rep"].take(b)})

    found = dealt.groupBy("bucket", "_i", "_j").applyInArrow(compare, f"a {kind}, b {kind}")
    return found.distinct()


def _joining(left: pa.Table, right: pa.Table, looks, same_block: bool, percent: int):
    """Rows of both blocks that are linked, one pair for every two groups that become one."""
    x, y = (_matrix(t["signature"].combine_chunks()) for t in (left, right))
    _, codes = np.unique(np.array(left["root"].to_pylist() + right["root"].to_pylist()), return_inverse=True)
    gx, gy = codes[: len(x)], codes[len(x) :]  # group of each row, renamed as groups become one
    (sets_x, bounds_x), (sets_y, bounds_y) = (_flat(t["shingles"]) for t in (left, right))
    _, ids = np.unique(np.concatenate([sets_x, sets_y]), return_inverse=True)
    ids_x, ids_y = ids[: len(sets_x)], ids[len(sets_x) :]
    inside = np.zeros(int(ids.max(initial=-1)) + 1, bool)
    out: list[tuple[int, int]] = []
    for row in range(len(x)):
        alive = np.flatnonzero(gy != gx[row])
        if same_block:
            alive = alive[alive > row]
        equal, done = np.zeros(len(alive), np.int64), 0
        for n, least in looks:
            equal += (y[alive, done:n] == x[row, done:n]).sum(1)
            alive, equal, done = alive[equal >= least], equal[equal >= least], n
        own = ids_x[bounds_x[row] : bounds_x[row + 1]]
        inside[own] = True
        for other in alive[np.argsort(-equal, kind="stable")]:  # the likeliest first: it saves the rest of its group
            if gy[other] != gx[row]:
                theirs = ids_y[bounds_y[other] : bounds_y[other + 1]]
                common = int(np.count_nonzero(inside[theirs]))
                if 100 * common >= percent * (len(own) + len(theirs) - common):
                    out.append((row, int(other)))
                    old, new = gy[other], gx[row]
                    gx[gx == old] = new
                    gy[gy == old] = new
        inside[own] = False
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pa.array(pairs[:, 0]), pa.array(pairs[:, 1])


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column one after another, and the bounds of the lists."""
    lists = column.combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes)).astype(np.int64)


def _profiles(source: DataFrame, wanted: DataFrame, width: int, kind: str) -> DataFrame:
    """Signature and full shingle set of the classes (rep, set_hash) that share a bucket with another."""
    import xxhash

    names = ["rep", "set_hash", "signature", "shingles"]

    def run(batches):
        for batch in slices(batches, 1, 1 << 20):
            values, bounds = _shingles(batch.column(1), width)
            own = [xxhash.xxh3_128_digest(values[a:b].tobytes()) for a, b in zip(bounds, bounds[1:], strict=False)]
            right = np.array([x == y for x, y in zip(own, batch.column(2).to_pylist(), strict=True)], bool)
            shingles = pa.ListArray.from_arrays(
                pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64), pa.int64())
            )
            columns = [batch.column(0), batch.column(2), batch.column(3), shingles]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(right))

    key = source.columns[0]
    texts = source.join(wanted.withColumnRenamed("rep", key), key)
    found = texts.mapInArrow(run, f"rep {kind}, set_hash binary, signature binary, shingles array<bigint>")
    return written_once(found.dropDuplicates(["rep", "set_hash"]).drop("set_hash"))
