"""Per-key results without hot tasks: range partitioning on a composite key, then stitching.

Rows are range-partitioned on (key, measure, value, record), with the quantiles that Spark samples
for a range exchange. A key that holds a third of all rows therefore spreads over a third of the
partitions. Each partition scans its sorted run once and emits one partial state per key; only keys
at a partition's border have more than one state, and these are stitched together.

Distinct values need no sets: equal values of a key are neighbours in the sort order, so a state is
a count of runs plus the first and last value, and two neighbouring states share at most one value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramforge.session import shuffle_partitions

_STATE = (
    "key string, key_null boolean, measure int, part int, rows_all long, records long, total long,"
    " runs long, first_value long, last_value long"
)


def normalize_tokens(c: Column) -> Column:
    """Tokens (runs of characters other than space and tab) joined by single spaces."""
    return F.trim(F.regexp_replace(c, "[ \t]+", " "))


def _changed(col: pa.ChunkedArray | pa.Array, before: object, first: bool) -> np.ndarray:
    """True where a value differs from the one before; nulls are equal to each other."""
    n = len(col)
    out = np.empty(n, dtype=bool)
    head = col[0].as_py()
    out[0] = first or head != before
    if n > 1:
        a, b = col.slice(1), col.slice(0, n - 1)
        ne = pc.fill_null(pc.not_equal(a, b), False)
        nulls = pc.not_equal(pc.is_null(a), pc.is_null(b))
        out[1:] = pc.or_(ne, nulls).to_numpy(zero_copy_only=False)
    return out


def _scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One state per (key, measure) of this partition's sorted rows."""
    open_group: dict | None = None
    before: dict[str, object] = {}
    names = ["key", "key_null", "measure", "part", "rows_all", "records", "total", "runs", "first_value", "last_value"]
    kinds = [pa.string(), pa.bool_(), pa.int32(), pa.int32()] + [pa.int64()] * 6

    def emit(groups: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([g[k] for g in groups], type=t) for k, t in zip(names, kinds)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        first = not before
        col = {k: batch.column(k) for k in batch.schema.names}
        diff = {k: _changed(col[k], before.get(k), first) for k in ("key", "key_null", "measure", "value", "site", "seq")}
        group = diff["key"] | diff["key_null"] | diff["measure"]
        run = group | diff["value"]
        record = run | diff["site"] | diff["seq"]
        valid = pc.is_valid(col["value"]).to_numpy(zero_copy_only=False)
        counted = pc.equal(col["measure"], 1).to_numpy(zero_copy_only=False)
        amount = pc.fill_null(col["amount"], 0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(group)
        if not len(starts) or starts[0] != 0:
            starts = np.concatenate([[0], starts])
        add = lambda x: np.add.reduceat(x.astype(np.int64), starts)
        rows, records = add(counted), add(record & counted)
        total, runs = add(np.where(record & counted, amount, 0)), add(run & valid)
        ends = np.concatenate([starts[1:], [batch.num_rows]]) - 1
        firsts, lasts = col["value"].take(pa.array(starts)).to_pylist(), col["value"].take(pa.array(ends)).to_pylist()
        keys, nulls, measures = (col[k].take(pa.array(starts)).to_pylist() for k in ("key", "key_null", "measure"))
        part = col["part"][0].as_py()
        done = []
        for i in range(len(starts)):
            if i == 0 and not group[0] and open_group is not None:
                g = open_group
                g["rows_all"] += int(rows[0])
                g["records"] += int(records[0])
                g["total"] += int(total[0])
                g["runs"] += int(runs[0])
                g["last_value"] = lasts[0]
                if g["first_value"] is None:  # nulls sort first
                    at = np.flatnonzero(valid[: ends[0] + 1])
                    g["first_value"] = col["value"][int(at[0])].as_py() if len(at) else None
                continue
            if open_group is not None:
                done.append(open_group)
            value = firsts[i]
            if value is None:
                at = np.flatnonzero(valid[starts[i] : ends[i] + 1])
                value = col["value"][int(starts[i] + at[0])].as_py() if len(at) else None
            open_group = {"key": keys[i], "key_null": nulls[i], "measure": measures[i], "part": part, "rows_all": int(rows[i]), "records": int(records[i]), "total": int(total[i]), "runs": int(runs[i]), "first_value": value, "last_value": lasts[i]}
        before = {k: col[k][-1].as_py() for k in diff}
        if done:
            yield emit(done)
    if open_group is not None:
        yield emit([open_group])


def skewed_counters(
    df: DataFrame,
    key: str = "pc_key",
    record: tuple[str, str] = ("site", "seq_no"),
    amount: str = "n0",
    distincts: tuple[str, str] = ("n1", "n2"),
    partitions: int | None = None,
) -> DataFrame:
    """Per key: all rows, distinct records, the amount summed once per record, and exact distinct values.

    Result: key (null for rows without one), rows_all, records, total, distinct_1, distinct_2.
    Keys are compared by their tokens. A record sent again under the same natural key counts once in
    ``records`` and ``total`` and again in ``rows_all``. Null amounts count as 0, null values are no
    distinct value; an empty table gives no rows; other columns are ignored.
    """
    parts = partitions or shuffle_partitions(df.sparkSession)
    k = normalize_tokens(F.col(key).cast("string"))
    base = df.select(
        F.coalesce(k, F.lit("")).alias("key"), k.isNull().alias("key_null"),
        F.col(record[0]).cast("string").alias("site"), F.col(record[1]).cast("long").alias("seq"), F.col(amount).cast("long").alias("amount"),
        F.col(distincts[0]).cast("long").alias("_a"), F.col(distincts[1]).cast("long").alias("_b"),
    )
    one = F.struct(F.lit(1).alias("measure"), F.col("_a").alias("value"), F.col("site").alias("site"), F.col("seq").alias("seq"), F.col("amount").alias("amount"))
    two = F.struct(F.lit(2).alias("measure"), F.col("_b").alias("value"), F.lit(None).cast("string").alias("site"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("long").alias("amount"))
    both = F.when(F.col("_b").isNull(), F.array(one)).otherwise(F.array(one, two))
    long = base.select("key", "key_null", F.explode(both).alias("x")).select("key", "key_null", "x.*")
    order = ["key", "key_null", "measure", "value", "site", "seq"]
    spread = long.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    states = spread.withColumn("part", F.spark_partition_id()).mapInArrow(_scan_runs, _STATE)
    # stitching: at most one state per key and partition arrives here
    joined = states.groupBy("key", "key_null", "measure").agg(
        F.sum("rows_all").alias("rows_all"), F.sum("records").alias("records"), F.sum("total").alias("total"), F.sum("runs").alias("runs"),
        F.sort_array(F.collect_list(F.struct("part", "first_value", "last_value"))).alias("borders"),
    )
    shared = F.expr(
        "aggregate(sequence(1, size(borders) - 1), 0L, (n, i) -> n + if(size(borders) > 1 and borders[i].first_value = borders[i - 1].last_value, 1L, 0L))"
    )
    shared = F.when(F.size("borders") > 1, shared).otherwise(F.lit(0).cast("long"))
    joined = joined.select("key", "key_null", "measure", "rows_all", "records", "total", (F.col("runs") - shared).alias("runs"))
    return (
        joined.groupBy("key", "key_null")
        .agg(
            F.sum("rows_all").alias("rows_all"), F.sum("records").alias("records"), F.sum("total").alias("total"),
            F.sum(F.when(F.col("measure") == 1, F.col("runs")).otherwise(0)).alias("distinct_1"),
            F.sum(F.when(F.col("measure") == 2, F.col("runs")).otherwise(0)).alias("distinct_2"),
        )
        .select(F.when(~F.col("key_null"), F.col("key")).alias("key"), "rows_all", "records", "total", "distinct_1", "distinct_2")
    )


def heavy_keys(counters: DataFrame, share: tuple[int, int] = (1, 50)) -> DataFrame:
    """Keys that hold at least ``share`` (a fraction) of all rows, rows without key included in the whole."""
    whole = counters.agg(F.sum("rows_all").alias("whole"))
    return counters.crossJoin(F.broadcast(whole)).where(F.col("key").isNotNull() & (F.col("rows_all") * share[1] >= F.col("whole") * share[0])).drop("whole")
