"""Sums over clusters along an ordering, for every prefix of it, from blocks of rows.

The rows of a group are range-partitioned on the sort key once and written as blocks: one row per
some ten thousand ordered rows, which are arrays of cluster codes and values. What a block needs of
the blocks before it is one row per cluster of the block and one row of totals, so the ordered rows
themselves are dealt out once, however many statistics run over them. A block can serve several
views: subsets of whole clusters, in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.keys import null_safe_join
from tandem.functions.storage import cut

BLOCK = 32768
AT = ["_p", "_i"]  # a block's partition and its number there: their order is the order of the rows


def group_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a sorted batch in which the first column is the same; NULL is a value."""
    c, n = batch.column(0), batch.num_rows
    if not n:
        return
    a, b = c.slice(1), c.slice(0, n - 1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(~same) + 1).tolist(), n]
    for lo, hi in zip(edges, edges[1:], strict=False):
        yield batch.slice(lo, hi - lo)


def weighted(v: dict[str, np.ndarray], n_pairs: int) -> dict[str, np.ndarray]:
    """a and b of each weighting from the value and the weights."""
    b = [v.get(f"w{i}", np.ones(len(v["value"]))) for i in range(n_pairs)]
    return {f"b{i}": x for i, x in enumerate(b)} | {f"a{i}": x * v["value"] for i, x in enumerate(b)}


def order_blocks(rows: DataFrame, by: str, order: list[str], cluster: str, value: str, weights: list[str | None]) -> DataFrame:
    """by, _p, _i, codes (of each row, into `clusters`), value and w0, w1, ... of each row, and per cluster of the block its rows and sums: _n, _a0, _b0, _h0, _a1, ...

    For each of `weights` (a column, or None for ones) b is the weight, a the value times it, and h the weight where a
    is below 0.
    """
    keys = [F.desc(o[1:]) if o.startswith("-") else F.asc(o) for o in order]
    own, n_pairs = {"value": value} | {f"w{i}": w for i, w in enumerate(weights) if w}, len(weights)
    names = list(own)
    base = rows.select(by, F.col(cluster).cast("string").alias("_c"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for n, c in own.items()), *(o.removeprefix("-") for o in order))
    ranged = base.repartitionByRange(by, *keys).withColumn("_p", F.spark_partition_id()).sortWithinPartitions(by, *keys).select(by, "_p", "_c", *names)
    lists = [f"_{x}{i}" for i in range(n_pairs) for x in "abh"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, made = [], 0, 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            c = t.column(2).combine_chunks().dictionary_encode(null_encoding="encode")
            codes = c.indices.to_numpy()
            sums = lambda v: np.bincount(codes, v, len(c.dictionary))
            v = weighted({m: t.column(m).to_numpy() for m in names}, n_pairs)
            per = [sums(x) for i in range(n_pairs) for x in (v[f"a{i}"], v[f"b{i}"], np.where(v[f"a{i}"] < 0, v[f"b{i}"], 0.0))]
            one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, kind))
            cells = [one(c.dictionary, None), one(codes, pa.int32()), *(one(t.column(m).to_numpy(), pa.float64()) for m in names), one(np.bincount(codes, minlength=len(c.dictionary)), pa.int64()), *(one(x, pa.float64()) for x in per)]
            return pa.record_batch([t.column(0).combine_chunks().slice(0, 1), t.column(1).combine_chunks().slice(0, 1), pa.array([made], pa.int32()), *cells], names=[by, *AT, "clusters", "codes", *names, "_n", *lists])

        for batch in batches:
            for part in (x.slice(lo, BLOCK) for x in group_slices(batch) for lo in range(0, x.num_rows, BLOCK)):
                if held and (n + part.num_rows > BLOCK or held[0].column(0)[0].as_py() != part.column(0)[0].as_py()):
                    yield out()
                    held, n, made = [], 0, made + 1
                held.append(part)
                n += part.num_rows
        if held:
            yield out()

    kind = base.schema[by].dataType.simpleString()
    doubles = [f"{m} array<double>" for m in (*names, *lists)]
    return cut(ranged.mapInArrow(gather, ", ".join([f"`{by}` {kind}", "_p int", "_i int", "clusters array<string>", "codes array<int>", *doubles[: len(names)], "_n array<long>", *doubles[len(names) :]])))


def cluster_states(blocks: DataFrame, by: str, cluster: str, n_pairs: int, views: Column) -> DataFrame:
    """by, _p, _i, pos (the cluster's code in the block), views, its own sums as in `blocks`, and what it had before the block: had, a0, b0, ... One row per block and cluster."""
    sums = ["_n", *(f"_{x}{i}" for i in range(n_pairs) for x in "abh")]
    each = blocks.select(by, *AT, F.posexplode(F.arrays_zip(F.col("clusters").alias(cluster), *sums)).alias("pos", "x")).select(by, *AT, "pos", "x.*")
    earlier = Window.partitionBy(by, cluster).orderBy(*AT).rowsBetween(Window.unboundedPreceding, -1)
    before = {"had": F.coalesce(F.sum("_n").over(earlier), F.lit(0))} | {f"{x}{i}": F.coalesce(F.sum(f"_{x}{i}").over(earlier), F.lit(0.0)) for i in range(n_pairs) for x in "ab"}
    return cut(each.withColumns(before).withColumn("views", views).drop(cluster))


def view_totals(states: DataFrame, by: str, n_pairs: int) -> DataFrame:
    """by, _p, _i, view, n (rows of the view in the block), total (in the group), and sums over all rows before the block: n0, m0 (clusters), sa0, sb0, sh0, saa0, sab0, sbb0, sa1, ..."""
    c = F.col
    kinds = lambda i: {"sa": c(f"_a{i}"), "sb": c(f"_b{i}"), "sh": c(f"_h{i}"), "saa": 2 * c(f"a{i}") * c(f"_a{i}") + c(f"_a{i}") * c(f"_a{i}"), "sab": c(f"a{i}") * c(f"_b{i}") + c(f"b{i}") * c(f"_a{i}") + c(f"_a{i}") * c(f"_b{i}"), "sbb": 2 * c(f"b{i}") * c(f"_b{i}") + c(f"_b{i}") * c(f"_b{i}")}
    sums = {"n": c("_n"), "m": (c("had") == 0).cast("long")} | {f"{n}{i}": x for i in range(n_pairs) for n, x in kinds(i).items()}
    per = states.withColumn("view", F.explode("views")).groupBy(by, *AT, "view").agg(*(F.sum(x).alias(n) for n, x in sums.items()))
    order = Window.partitionBy(by, "view").orderBy(*AT).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(by, "view").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return cut(per.select(by, *AT, "view", "n", F.sum("n").over(whole).alias("total"), *(F.coalesce(F.sum(n).over(order), F.lit(0).cast(per.schema[n].dataType)).alias(f"{n}_before") for n in sums)))


def _read(block: pa.Table, right: pa.Table, n_pairs: int):
    """codes, values by name, the states' columns by name in the order of codes, members (view -> mask over clusters), the views' rows."""
    codes = block.column("codes").combine_chunks().flatten().to_numpy()
    values = weighted({n: block.column(n).combine_chunks().flatten().to_numpy() for n in block.column_names if n == "value" or n in [f"w{i}" for i in range(n_pairs)]}, n_pairs)
    states = right.filter(pc.is_valid(right.column("pos"))).sort_by("pos")
    owned = states.column("views").combine_chunks()
    members, width = {}, np.diff(owned.offsets.to_numpy())
    of, position = owned.flatten().to_numpy(), np.repeat(np.arange(len(states)), width)
    asked = right.filter(pc.is_null(right.column("pos"))).to_pylist()
    for v in {r["view"] for r in asked}:
        members[v] = np.zeros(len(states), bool)
        members[v][position[of == v]] = True
    return codes, values, states, members, asked


def prefix_bounds(blocks: DataFrame, states: DataFrame, totals: DataFrame, by: str, n_pairs: int, step: int) -> DataFrame:
    """by, view, k, total, m, sa0, sb0, saa0, sab0, sbb0, sa1, ...: counts of clusters and sums over the first k rows of each view, at multiples of `step` and the last.

    A row that adds (a, b) to a cluster at (A, B) changes the sums of A*A, A*B and B*B by 2Aa+a*a, Ab+Ba+ab and
    2Bb+b*b.
    """
    out = [f"{x}{i}" for i in range(n_pairs) for x in ("sa", "sb", "saa", "sab", "sbb")]
    names = [by, "view", "k", "total", "m", *out]

    def run(block: pa.Table, right: pa.Table) -> pa.Table:
        if not len(block) or not len(right):
            return empty
        codes, v, states, members, asked = _read(block, right, n_pairs)
        order = np.argsort(codes, kind="stable")
        start = np.flatnonzero(np.append(True, np.diff(codes[order]) != 0))
        lengths = np.diff(np.append(start, len(order)))

        def before(n: str) -> np.ndarray:
            x = v[n][order]
            to = np.cumsum(x) - x
            at = np.empty(len(x))
            at[order] = to - np.repeat(to[start], lengths)
            return at + states.column(n).to_numpy()[codes]

        new = np.zeros(len(codes), bool)
        new[order[start]] = True
        new &= states.column("had").to_numpy()[codes] == 0
        added = {}
        for i in range(n_pairs):
            a, b, ca, cb = v[f"a{i}"], v[f"b{i}"], before(f"a{i}"), before(f"b{i}")
            added |= {f"sa{i}": a, f"sb{i}": b, f"saa{i}": 2 * ca * a + a * a, f"sab{i}": ca * b + cb * a + a * b, f"sbb{i}": 2 * cb * b + b * b}
        tables = []
        for r in asked:
            rows = np.flatnonzero(members[r["view"]][codes])
            k = r["n_before"] + 1 + np.arange(len(rows))
            grid = np.flatnonzero((k % step == 0) | (k == r["total"]))
            cells = [k[grid], np.full(len(grid), r["total"]), r["m_before"] + np.cumsum(new[rows])[grid], *(r[f"{n}_before"] + np.cumsum(added[n][rows])[grid] for n in out)]
            tables.append(pa.table([pa.array([r[by]] * len(grid), kind), pa.array([r["view"]] * len(grid), pa.int32()), *map(pa.array, cells)], names=names))
        return pa.concat_tables(tables) if tables else empty

    kind = _arrow_type(blocks, by)
    schema = f"`{by}` {blocks.schema[by].dataType.simpleString()}, view int, k long, total long, m long, " + ", ".join(f"{n} double" for n in out)
    empty = pa.schema([(by, kind), ("view", pa.int32()), *((n, pa.int64()) for n in ("k", "total", "m")), *((n, pa.float64()) for n in out)]).empty_table()
    needed = [by, *AT, "codes", *(n for n in blocks.columns if n == "value" or n in [f"w{i}" for i in range(n_pairs)])]
    right = states.select(by, *AT, "pos", "views", "had", *(f"{x}{i}" for i in range(n_pairs) for x in "ab")).unionByName(totals, allowMissingColumns=True)
    return blocks.select(needed).groupBy(by, *AT).cogroup(right.groupBy(by, *AT)).applyInArrow(run, schema)


def prefix_sums_at(blocks: DataFrame, states: DataFrame, totals: DataFrame, asked: DataFrame, by: str, n_pairs: int) -> DataFrame:
    """`asked` (by, view, k and more: few rows, counted by the caller) with sa0, sb0, sh0, sa1, ... over the first k rows of the view; NULL where k is 0."""
    out = [f"{x}{i}" for i in range(n_pairs) for x in ("sa", "sb", "sh")]
    wanted = asked.select(by, "view", "k").where("k > 0").distinct()
    border = (F.col("n_before") < F.col("k")) & (F.col("k") <= F.col("n_before") + F.col("n"))
    inside = cut(totals.select(by, *AT, "view", "n", "n_before", *(f"{n}_before" for n in out)).join(F.broadcast(wanted), [by, "view"]).where(border))  # a row per asked k
    few = F.broadcast(inside.select(by, *AT).distinct())

    def run(block: pa.Table, right: pa.Table) -> pa.Table:
        if not len(block) or not len(right):
            return empty
        codes, v, _, members, rows_ = _read(block, right, n_pairs)
        v |= {f"h{i}": np.where(v[f"a{i}"] < 0, v[f"b{i}"], 0.0) for i in range(n_pairs)}
        found = []
        for r in rows_:
            rows = np.flatnonzero(members[r["view"]][codes])[: r["k"] - r["n_before"]]
            found.append({by: r[by], "view": r["view"], "k": r["k"]} | {n: r[f"{n}_before"] + float(v[n[1:]][rows].sum()) for n in out})
        return pa.Table.from_pylist(found, empty.schema)

    kind = _arrow_type(blocks, by)
    empty = pa.schema([(by, kind), ("view", pa.int32()), ("k", pa.int64()), *((n, pa.float64()) for n in out)]).empty_table()
    schema = f"`{by}` {blocks.schema[by].dataType.simpleString()}, view int, k long, " + ", ".join(f"{n} double" for n in out)
    needed = [by, *AT, "codes", *(n for n in blocks.columns if n == "value" or n in [f"w{i}" for i in range(n_pairs)])]
    left = blocks.select(needed).join(few, [by, *AT])
    right = states.select(by, *AT, "pos", "views").join(few, [by, *AT]).unionByName(inside, allowMissingColumns=True)
    sums = left.groupBy(by, *AT).cogroup(right.groupBy(by, *AT)).applyInArrow(run, schema)
    return null_safe_join(asked, sums, [by, "view", "k"], "left")


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)
