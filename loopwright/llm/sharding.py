"""Resharding at least cost: which blocks of the old shards' files go to which new shards.

The plan is a minimum-cost flow between old shard sizes and new capacities.  A byte that stays
costs nothing, a moved one costs what the cost table says (1 by default), so the flow moves the
fewest bytes.  Rows keep the order of their shard's files, so each shard is cut at a few rows; only
files that a cut divides or that change their shard are written again.  The driver sees one number a
file, and the rows that are large against a capacity, of which there are few.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loopwright.llm.common import stored
from loopwright.session import broadcast_if_small

# Rows over this share of a capacity are placed one by one, the largest first; so cuts fall among
# small rows.  A new shard has fewer of them than the share's inverse.
LARGE_SHARE = 1 / 64


def even_capacities(total: int, shards: int) -> list[int]:
    """Capacities of ``shards`` shards that add up to ``total`` and differ by one at most."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def move_costs(old: int, new: int) -> np.ndarray:
    """1 for a byte that changes its shard, 0 for one that stays."""
    return 1.0 - np.eye(old, new)


def least_cost_flow(
    supply: Sequence[int], demand: Sequence[int], cost: np.ndarray
) -> np.ndarray:
    """Integer flow from supplies to demands (equal sums) of the least total cost.

    Successive shortest paths with node potentials.  Ties go to the lowest shard numbers.  The
    work depends on the numbers of shards alone.
    """
    left, need = np.array(supply, dtype=np.int64), np.array(demand, dtype=np.int64)
    if left.sum() != need.sum():
        raise ValueError(f"sizes add up to {left.sum()}, capacities to {need.sum()}")
    n, m = len(left), len(need)
    flow = np.zeros((n, m), dtype=np.int64)
    u, v = np.zeros(n), np.zeros(m)  # potentials
    if n and m:
        v = cost.min(axis=0)
    while left.sum():
        reduced = cost - v[None, :] + u[:, None]
        dist_u = np.where(left > 0, 0.0, np.inf)
        dist_v = np.full(m, np.inf)
        from_u, from_v = np.full(n, -1), np.full(m, -1)
        done_u, done_v = np.zeros(n, bool), np.zeros(m, bool)
        while True:
            i = int(np.argmin(np.where(done_u, np.inf, dist_u))) if n else -1
            j = int(np.argmin(np.where(done_v, np.inf, dist_v)))
            at_u = np.inf if done_u[i] else dist_u[i]
            at_v = np.inf if done_v[j] else dist_v[j]
            if at_v <= at_u:
                done_v[j] = True
                if need[j] > 0:
                    break
                back = (flow[:, j] > 0) & ~done_u & (at_v - reduced[:, j] < dist_u - 1e-12)
                dist_u[back] = at_v - reduced[back, j]
                from_u[back] = j
            else:
                done_u[i] = True
                closer = ~done_v & (at_u + reduced[i] < dist_v - 1e-12)
                dist_v[closer] = at_u + reduced[i][closer]
                from_v[closer] = i
        # Path back from the reached demand to a supply that is left.
        path, at = [], j
        while True:
            i = int(from_v[at])
            path.append((i, at, 1))
            if from_u[i] < 0:
                break
            path.append((i, int(from_u[i]), -1))
            at = int(from_u[i])
        amount = min([left[i], need[j], *(flow[a, b] for a, b, way in path if way < 0)])
        for a, b, way in path:
            flow[a, b] += way * amount
        left[i] -= amount
        need[j] -= amount
        far = dist_v[j]
        u = u + np.minimum(dist_u, far)
        v = v + np.minimum(dist_v, far)
    return flow


Flow = list[tuple[int, int, int]]  # from, to, amount


def unit_cost_flow(supply: Sequence[int], demand: Sequence[int]) -> Flow:
    """``least_cost_flow`` for the costs of ``move_costs``, without a table of all pairs.

    What can stay stays: those arcs cost nothing.  All others cost the same, so the surpluses fill the
    gaps in the order of their numbers.
    """
    if sum(supply) != sum(demand):
        raise ValueError(f"sizes add up to {sum(supply)}, capacities to {sum(demand)}")
    stay = [min(s, d) for s, d in zip(supply, demand)]
    kept = [*stay, *[0] * (max(len(supply), len(demand)) - len(stay))]
    found = [(i, i, n) for i, n in enumerate(stay) if n]
    gaps = [[j, d - kept[j]] for j, d in enumerate(demand) if d > kept[j]]
    at = 0
    for i, s in enumerate(supply):
        left = s - kept[i]
        while left:
            take = min(left, gaps[at][1])
            found.append((i, gaps[at][0], take))
            left -= take
            gaps[at][1] -= take
            at += not gaps[at][1]
    return sorted(found)


def flow_of(supply: Sequence[int], demand: Sequence[int], costs: np.ndarray | None) -> Flow:
    if costs is None:
        return unit_cost_flow(supply, demand)
    table = least_cost_flow(supply, demand, costs)
    return [(int(i), int(j), int(table[i, j])) for i, j in zip(*np.nonzero(table))]


# ---- shards as files -------------------------------------------------------------------------

# Columns that the files of a shard have besides the rows' own, and those made while they are read.
SHARD, SIZE = "_shard", "_shard_bytes"
_FILE, _ROW, _FIRST = "_shard_file", "_shard_row", "_shard_first"
_PIECES, _LARGE = "_shard_pieces", "_shard_large"
_TAKEN = {SHARD, SIZE, _FILE, _ROW, _FIRST, _PIECES, _LARGE}


@dataclass(frozen=True)
class Manifest:
    """Which files make up each shard, in order, with their rows: ``{shard: [(path, rows)]}``."""

    files: Mapping[int, list[tuple[str, int]]]

    def paths(self) -> list[str]:
        return [path for files in self.files.values() for path, _ in files]


def _listed(rows: DataFrame) -> dict[int, list[tuple[str, int]]]:
    """The files of a table by shard, sorted by name, with their rows."""
    found: dict[int, list[tuple[str, int]]] = {}
    counted = rows.groupBy(SHARD, F.col("_metadata.file_path").alias("file")).count()
    for row in sorted(counted.collect(), key=lambda r: (r[SHARD], r["file"])):  # a row a file
        found.setdefault(row[SHARD], []).append((row["file"], row["count"]))
    return found


def write_shards(docs: DataFrame, shard: Column, size: Column, folder: str) -> Manifest:
    """Write the rows by shard (0-based, NULL counts as 0), with their sizes (NULL: 0).

    Each task writes its own rows of each shard: nothing is shuffled.
    """
    if taken := _TAKEN & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns of these names are the shards' own: {sorted(taken)}")
    number = F.coalesce(shard, F.lit(0)).cast("int")
    rows = docs.select("*", number.alias(SHARD), F.coalesce(size, F.lit(0)).cast("long").alias(SIZE))
    rows.write.partitionBy(SHARD).parquet(folder)
    written = docs.sparkSession.read.schema(rows.schema).parquet(folder)
    found = _listed(written)
    if found and min(found) < 0:
        raise ValueError("shard numbers start at 0")
    return Manifest(found)


def read_shards(spark: SparkSession, manifest: Manifest, schema) -> DataFrame:
    """The rows of all shards with ``shard`` and ``slot``: their place in the shard, gapless from 0.

    A slot is the number of rows in the shard's earlier files and the row's place in its file.
    """
    paths = manifest.paths()
    table = []
    for shard, files in manifest.files.items():
        at = 0
        for path, rows in files:
            table.append((path, shard, at))
            at += rows
    names = [f.name for f in schema.fields]
    if not paths:
        empty = spark.createDataFrame([], schema)
        return empty.select(*names, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    places = spark.createDataFrame(table, f"{_FILE} string, shard int, {_FIRST} long")
    rows = spark.read.schema(schema).parquet(*paths).select(
        *names, F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.row_index").alias(_ROW)
    )
    # A row a file.
    found = rows.join(broadcast_if_small(stored(places, "shard-files")), _FILE)
    return found.select(*names, "shard", (F.col(_FIRST) + F.col(_ROW)).alias("slot"))


@dataclass(frozen=True)
class Plan:
    """Block transfers: for each file the rows at which a new target begins, and large rows' targets."""

    pieces: Mapping[str, list[tuple[int, int]]]  # file: (first row, new shard)
    large: Mapping[str, list[tuple[int, int]]]  # file: (row, new shard)
    old: Mapping[str, int]

    def unchanged(self, path: str) -> bool:
        """Whether all rows of a file stay in their shard."""
        targets = {s for _, s in self.pieces[path]} | {s for _, s in self.large.get(path, [])}
        return targets <= {self.old[path]}


def _cut_rows(rows: DataFrame, cuts: list[tuple[str, int, bool]]) -> list[tuple[int, int]]:
    """For each cut (file, bytes, by middles) the row it falls at and the bytes of the rows before it.

    Only the files with cuts are read, and of them sizes alone.
    """
    if not cuts:
        return []
    spark = rows.sparkSession
    asked = [(i, path, float(at), middle) for i, (path, at, middle) in enumerate(cuts)]
    table = spark.createDataFrame(asked, "cut int, file string, at double, middle boolean")
    before = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.filter(F.col("file").isin(sorted({c[0] for c in cuts}))).withColumn(
        "_end", F.sum("size").over(before)
    )
    # As many rows as there are cuts: fewer than old and new shards together.
    met = ends.join(F.broadcast(table), "file")
    inside = F.when(F.col("middle"), F.col("_end") - F.col("size") / 2 < F.col("at")).otherwise(
        F.col("_end") <= F.col("at")
    )
    found = met.groupBy("cut").agg(
        F.max(F.when(inside, F.col("row") + 1)).alias("row"), F.max(F.when(inside, F.col("_end"))).alias("sum")
    )
    by_cut = {r["cut"]: (r["row"] or 0, r["sum"] or 0) for r in found.collect()}
    return [by_cut[i] for i in range(len(cuts))]


def plan_shards(
    rows: DataFrame, manifest: Manifest, new_shards: int | None = None,
    capacities: Sequence[int] | None = None, costs: np.ndarray | None = None,
) -> Plan:
    """Solve which blocks of the shards' files go where.

    ``rows`` is the written table (its shard and size columns are read).  Capacities default to
    equal ones; they must add up to all bytes.  Large rows come first in a shard, then the others in the
    order of the files.  First what stays, in whole rows; then the rest flows to the room that is
    really left, each row to where its middle goes: a shard is off by half a small row at each cut.
    """
    narrow = rows.select(
        F.col(SHARD).alias("old"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"), F.col(SIZE).alias("size"),
    )
    sums = {r["old"]: r["n"] for r in narrow.groupBy("old").agg(F.sum("size").alias("n")).collect()}
    count = 1 + max(manifest.files, default=-1)
    supply = [sums.get(i) or 0 for i in range(count)]
    if capacities is None:
        capacities = even_capacities(sum(supply), new_shards)
    new = len(capacities)
    large_size = sum(supply) / max(1, new) * LARGE_SHARE
    is_large = F.col("size") > F.lit(large_size)
    # At most the share's inverse for each new shard.
    large = sorted((r["old"], -r["size"], r["file"], r["row"]) for r in narrow.filter(is_large).collect())
    small = narrow.filter(~is_large)
    totals = {r["file"]: r["n"] for r in small.groupBy("file").agg(F.sum("size").alias("n")).collect()}
    old_of = {path: i for i, files in manifest.files.items() for path, _ in files}

    # Where each file's small rows begin in its shard, after the shard's large rows.
    ahead, starts = [0] * count, {}
    for i, negative, _, _ in large:
        ahead[i] -= negative
    for i, files in manifest.files.items():
        at = ahead[i]
        for path, _ in files:
            starts[path] = at
            at += totals.get(path, 0)

    def file_at(i: int, position: float) -> str | None:
        """The file of a shard whose small rows a position lies in."""
        for path, _ in manifest.files.get(i, []):
            if starts[path] <= position < starts[path] + totals.get(path, 0):
                return path
        return None

    stay = [0] * count
    for i, j, amount in flow_of(supply, capacities, costs):
        if i == j:
            stay[i] = amount
    kept, stays, at = [0] * count, {}, [0] * count
    for i, negative, path, row in large:
        at[i] -= negative
        if at[i] <= stay[i]:
            kept[i] = at[i]
            stays[path, row] = True
    # The first row of each shard that does not stay: its file and place there.
    cut_files = {i: file_at(i, stay[i]) for i in range(count) if stay[i] > ahead[i]}
    asked = [(i, path) for i, path in cut_files.items() if path is not None]
    found = _cut_rows(small, [(path, stay[i] - starts[path], False) for i, path in asked])
    borders: dict[int, tuple[str | None, int]] = {}
    for i in range(count):
        if i in cut_files and cut_files[i] is None:
            kept[i], borders[i] = supply[i], (None, 0)  # all of it stays
    for (i, path), (row, inside) in zip(asked, found):
        kept[i], borders[i] = starts[path] + inside, (path, row)

    rest = [s - k for s, k in zip(supply, kept)]
    room = [c - (kept[j] if j < count else 0) for j, c in enumerate(capacities)]
    flow = flow_of(rest, room, costs)
    targets: dict[int, list[tuple[int, int]]] = {}
    for i, j, amount in flow:
        end = targets[i][-1][0] if i in targets else kept[i]
        targets.setdefault(i, []).append((end + amount, j))

    def target(i: int, middle: float) -> int:
        for end, j in targets.get(i, []):
            if middle < end:
                return j
        return targets[i][-1][1] if i in targets else min(i, new - 1)

    placed: dict[str, list[tuple[int, int]]] = {}
    at = [0] * count
    for i, negative, path, row in large:
        # Large rows that do not stay follow what is kept in the flow's order.
        goes = i if (path, row) in stays else target(i, max(kept[i], at[i]) - negative / 2)
        at[i] -= negative
        placed.setdefault(path, []).append((row, goes))

    cuts: list[tuple[int, str, float, int]] = []
    pieces: dict[str, list[tuple[int, int]]] = {}
    for i, files in manifest.files.items():
        border, passed = borders.get(i, (files[0][0] if files else None, 0)), False
        for path, _ in files:
            low, high = starts[path], starts[path] + totals.get(path, 0)
            first = border[1] if path == border[0] else 0
            if border[0] is None or (not passed and path != border[0]):
                pieces[path] = [(0, i)]
                continue
            passed = True
            pieces[path] = [(0, i)] if first else []
            begin = max(low, kept[i]) if path == border[0] else low
            pieces[path].append((first, target(i, begin + 0.5)))
            ends = targets.get(i, [])
            cuts += [(i, path, e - low, j) for (e, _), (_, j) in zip(ends, ends[1:]) if begin < e < high]
    for (i, path, _, j), (row, _) in zip(cuts, _cut_rows(small, [(p, o, True) for _, p, o, _ in cuts])):
        pieces[path].append((row, j))
    for path, found in pieces.items():
        found.sort(key=lambda p: p[0])
    return Plan(pieces, placed, old_of)


def rewrite_affected(rows: DataFrame, manifest: Manifest, plan: Plan, folder: str) -> Manifest:
    """Write the rows of the files that change, each to its new shard; all other files stay.

    ``rows`` is the written table.  Each task writes its own rows of each shard; nothing is
    shuffled and the old files are not touched, so a failed run can be repeated with another
    folder.
    """
    spark, schema = rows.sparkSession, rows.schema
    kept: dict[int, list[tuple[str, int]]] = {}
    changed = []
    for shard, files in manifest.files.items():
        for path, n in files:
            if plan.unchanged(path):
                kept.setdefault(shard, []).append((path, n))
            else:
                changed.append(path)
    if not changed:
        return manifest
    table = [(p, plan.pieces[p], plan.large.get(p, [])) for p in changed]
    pair = "array<struct<row:long,shard:int>>"
    targets = spark.createDataFrame(table, f"{_FILE} string, {_PIECES} {pair}, {_LARGE} {pair}")
    source = spark.read.schema(schema).parquet(*changed).select(
        *[c for c in schema.names if c != SHARD],
        F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.row_index").alias(_ROW),
    )
    # A row a file.
    met = source.join(broadcast_if_small(stored(targets, "shard-targets")), _FILE)
    own = F.filter(_LARGE, lambda x: x["row"] == F.col(_ROW))
    piece = F.filter(_PIECES, lambda x: x["row"] <= F.col(_ROW))
    goes = F.when(F.size(own) > 0, F.get(own, F.lit(0))["shard"]).otherwise(
        F.element_at(piece, -1)["shard"]
    )
    named = met.withColumn(SHARD, goes).select(*schema.names)
    named.write.partitionBy(SHARD).parquet(folder)
    for shard, files in _listed(spark.read.schema(schema).parquet(folder)).items():
        kept.setdefault(shard, []).extend(files)
    return Manifest(kept)


def reshard(
    docs: DataFrame, old_shard: Column, size: Column, folder: str, new_shards: int,
    capacities: Sequence[int] | None = None, costs: np.ndarray | None = None,
) -> DataFrame:
    """Write the rows as old shards, rewrite what must move, and read the new shards back.

    Adds ``old_shard``, ``size``, ``shard``, ``slot`` and ``moved`` to the columns of ``docs``; columns
    of those names give way.  Repeated rows and NULLs are rows like others (see ``write_shards``);
    an empty table stays empty; rows of size 0 go with their neighbours.
    """
    spark = docs.sparkSession
    made = ("old_shard", "size", "shard", "slot", "moved")
    names = [c for c in docs.columns if c.lower() not in made]
    # Under the writer's own names nothing clashes.
    packed = docs.select(
        F.struct(*names).alias("_document"), F.coalesce(old_shard, F.lit(0)).cast("int").alias("_old"), size.alias("_size")
    )
    manifest = write_shards(packed, F.col("_old"), F.col("_size"), f"{folder}/old")
    schema = packed.select("*", F.lit(0).alias(SHARD), F.lit(0).cast("long").alias(SIZE)).schema
    rows = spark.read.schema(schema).parquet(f"{folder}/old")
    if manifest.files:
        plan = plan_shards(rows, manifest, new_shards, capacities, costs)
        manifest = rewrite_affected(rows, manifest, plan, f"{folder}/new")
    found = read_shards(spark, manifest, schema)
    return found.select(
        "_document.*", F.col("_old").alias("old_shard"), F.col(SIZE).alias("size"), "shard", "slot",
        (F.col("_old") != F.col("shard")).alias("moved"),
    )
