"""Frequency of every distinct term: persistent partitioned counts, kept by signed deltas.

A batch of added, changed or deleted records is compared with the stored state of those records
only. What changed becomes signed term deltas (+ the new content, - the old one), aggregated per term
before and after one shuffle and merged into the counts of the buckets (a hash of the term) that they touch.
Records that arrive again unchanged, or in an older version than the stored one, cost a comparison and change nothing.

Layout below ``path``: ``records/gen=K/part=P`` (records written by batch K, by a hash of their first key column),
``counts/gen=K/bucket=B`` (whole counts of the buckets that batch K touched) and ``manifest/K.json``, which names the
generations that hold each part and bucket. It is written last: a batch that fails halfway leaves the store as it was and can be run again.
A store is opened at the latest manifest at its path. One writer at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramforge.llm.records import terms_of

RARE_BELOW = 200
COMMON_SHARE = (1, 20)
_KEY = ["k1", "k2"]
_RECORD = "k1 long, k2 long, content string, weight long, version {}, alive boolean, gen int"
_COUNTS = "term string, occurrences long, records long"


class TermCountStore:
    """Counts of terms over records with key (k1, k2), content and weight.

    Input columns: k1, k2, content, weight, version; other columns are ignored. Rows with a null in
    key, content or weight are no record and are skipped. Of several rows with one key in a batch the
    one with the highest version counts (nulls lowest; ties by content, then weight); one of a lower version than the
    stored record's is ignored, one of the same version replaces it. Deleted keys are gone whatever their version; a
    lower version than the deleted one doesn't bring them back. All batches have one type of version.

    ``buckets``: choose them so that the counts of one fit a task; an existing store keeps its own.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path = spark, path.rstrip("/")
        #: parts and buckets: the generations that hold them
        self.state = self._opened() or {"generation": 0, "buckets": buckets, "version": None, "total": 0, "parts": {}, "counts": {}}

    @property
    def generation(self) -> int:
        return self.state["generation"]

    @property
    def buckets(self) -> int:
        return self.state["buckets"]

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _opened(self) -> dict | None:
        fs, folder = self._folder("manifest")
        if not fs.exists(folder):
            return None
        numbers = [int(x.getPath().getName().removesuffix(".json")) for x in fs.listStatus(folder) if x.getPath().getName().endswith(".json")]
        if not numbers:
            return None
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/manifest/{max(numbers)}.json").collect()))

    def _commit(self, state: dict) -> None:
        fs, draft = self._folder("manifest/draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(state), "utf-8"))
        out.close()
        _, final = self._folder(f"manifest/{state['generation']}.json")
        if not fs.rename(draft, final):
            raise OSError(f"{self.path}: generation {state['generation']} is there already: another writer?")
        self.state = state

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("k1"), F.lit(self.buckets)).cast("int")

    def _stored(self, parts: list[int]) -> DataFrame | None:
        """The stored records of some parts, all generations of them; only their folders are read."""
        folders = [f"{self.path}/records/gen={g}/part={p}" for p in parts for g in self.state["parts"].get(str(p), [])]
        if not folders:
            return None
        return self.spark.read.schema(_RECORD.format(self.state["version"])).option("basePath", f"{self.path}/records").parquet(*folders)

    def _old_counts(self, buckets: list[int]) -> DataFrame:
        folders = [f"{self.path}/counts/gen={self.state['counts'][str(b)]}/bucket={b}" for b in buckets if str(b) in self.state["counts"]]
        if not folders:
            return self.spark.createDataFrame([], f"{_COUNTS}, bucket int")
        return self.spark.read.schema(f"{_COUNTS}, bucket int").option("basePath", f"{self.path}/counts").parquet(*folders).select("term", "occurrences", "records", "bucket")

    def _write_records(self, records: DataFrame, gen: int) -> DataFrame:
        """By part; adaptive execution splits a part of many records over several tasks. Returns what was written."""
        path = f"{self.path}/records/gen={gen}"
        spread = records.withColumn("part", self._part()).hint("rebalance", F.col("part"))
        spread.write.mode("overwrite").partitionBy("part").parquet(path)
        return self.spark.read.schema(spread.schema).parquet(path)

    def apply(self, changes: DataFrame, deleted: DataFrame | None = None) -> None:
        """Merge one batch: upserts, and keys (k1, k2) to delete."""
        gen = self.generation
        sound = changes.where(F.col("k1").isNotNull() & F.col("k2").isNotNull() & F.col("content").isNotNull() & F.col("weight").isNotNull())
        new = (
            sound.groupBy(*(F.col(k).cast("long").alias(k) for k in _KEY))
            .agg(F.max_by(F.struct("content", F.col("weight").cast("long").alias("weight"), "version"), F.struct("version", "content", "weight")).alias("r"))
            .select(*_KEY, "r.*", F.lit(True).alias("alive"))
        )
        kind = new.schema["version"].dataType.simpleString()
        if self.state["version"] not in (None, kind):
            raise ValueError(f"versions were {self.state['version']}, now {kind}")
        if deleted is not None:
            gone = deleted.select(*(F.col(k).cast("long").alias(k) for k in _KEY)).dropna().dropDuplicates(_KEY)
            empty = [F.lit(None).cast(t).alias(c) for c, t in (("content", "string"), ("weight", "long"), ("version", kind))]
            new = new.join(gone, _KEY, "left_anti").unionByName(gone.select(*_KEY, *empty, F.lit(False).alias("alive")))
        stored = None
        if self.state["parts"]:
            # the parts that the batch touches: no more than there are buckets
            asked = changes if deleted is None else changes.select("k1").unionByName(deleted.select("k1"))
            touched = [r[0] for r in asked.select(F.col("k1").cast("long").alias("k1")).dropna().select(self._part().alias("p")).distinct().collect()]
            stored = self._stored(touched)
        old = "struct<content:string,weight:bigint,version:{},alive:boolean>".format(kind)
        if stored is not None:
            last = stored.join(new.select(*_KEY), _KEY, "left_semi").groupBy(*_KEY).agg(F.max_by(F.struct("content", "weight", "version", "alive"), "gen").alias("o"))
            pair = new.join(last, _KEY, "left")
            known = F.col("o.version").isNotNull()
            stale = F.col("alive") & known & (F.col("version").isNull() | (F.col("version") < F.col("o.version")))
            same = F.col("content").eqNullSafe(F.col("o.content")) & F.col("weight").eqNullSafe(F.col("o.weight")) & (F.col("alive") == F.col("o.alive")) & ~(F.col("alive") & ~F.col("version").eqNullSafe(F.col("o.version")))
            # a deletion keeps the version it deleted; a key never seen needs none
            pair = pair.withColumn("version", F.when(F.col("alive"), F.col("version")).otherwise(F.col("o.version")))
            changed = pair.where(F.when(F.col("o").isNull(), F.col("alive")).otherwise(~F.coalesce(stale | same, F.lit(False))))
        else:
            changed = new.where("alive").withColumn("o", F.lit(None).cast(old))
        batch = self._write_records(changed.withColumn("was_alive", F.coalesce(F.col("o.alive"), F.lit(False))).select(*_KEY, "content", "weight", "version", "alive", "was_alive", F.col("o.content").alias("was"), F.col("o.weight").alias("was_weight")), gen)
        deltas = self._deltas(batch, stored is not None)
        # which buckets and parts are new, and how many records: a few numbers
        draft = f"{self.path}/deltas/gen={gen}"
        deltas.write.mode("overwrite").parquet(draft)
        deltas = self.spark.read.schema(deltas.schema).parquet(draft)
        buckets = sorted(r[0] for r in deltas.select("bucket").distinct().collect())
        counts = self._old_counts(buckets).unionByName(deltas).groupBy("bucket", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).where("records > 0")
        counts.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/counts/gen={gen}")
        by_part = batch.groupBy("part").agg(F.sum(F.col("alive").cast("long") - F.col("was_alive").cast("long")).alias("n")).collect()
        parts = {**self.state["parts"]}
        for r in by_part:
            parts[str(r["part"])] = [*parts.get(str(r["part"]), []), gen]
        left = self._held(gen, buckets)
        where = {k: v for k, v in self.state["counts"].items() if int(k) not in buckets} | {str(b): gen for b in left}
        self._commit({"generation": gen + 1, "buckets": self.buckets, "version": kind, "total": self.state["total"] + sum(r["n"] for r in by_part), "parts": parts, "counts": where})
        fs, folder = self._folder(f"deltas/gen={gen}")
        fs.delete(folder, True)  # they are in the counts now

    def _held(self, gen: int, buckets: list[int]) -> list[int]:
        """Of some buckets, those that hold a term after batch ``gen``: one all of whose terms are gone has no folder."""
        fs, folder = self._folder(f"counts/gen={gen}")
        names = {x.getPath().getName() for x in fs.listStatus(folder)}
        return [b for b in buckets if f"bucket={b}" in names]

    def _deltas(self, batch: DataFrame, changes: bool) -> DataFrame:
        """bucket, term, occurrences, records: what a batch of written records adds and takes away."""
        batch = batch.where(~(F.col("alive") & F.col("was_alive") & F.col("content").eqNullSafe(F.col("was")) & F.col("weight").eqNullSafe(F.col("was_weight"))))
        signed = batch.where("alive").select("content", "weight", F.lit(1).cast("long").alias("sign"))
        if changes:
            signed = signed.unionByName(batch.where("was_alive").select(F.col("was").alias("content"), F.col("was_weight").alias("weight"), F.lit(-1).cast("long").alias("sign")))
        signed = signed.withColumn("t", terms_of(F.col("content")))
        every = lambda once: F.transform("t", lambda x: F.struct(x.alias("term"), (F.col("weight") * F.col("sign")).alias("occurrences"), once.alias("records")))
        none, one = F.lit(0).cast("long"), F.col("sign")
        first = F.transform(F.array_distinct("t"), lambda x: F.struct(x.alias("term"), none.alias("occurrences"), one.alias("records")))
        entries = F.when(F.size(F.array_distinct("t")) == F.size("t"), every(one)).otherwise(F.concat(every(none), first))
        deltas = signed.select(F.explode(entries).alias("e")).select("e.*").groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        return deltas.where("occurrences <> 0 or records <> 0").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))

    def compact(self) -> None:
        """Fold the generations of records into one: of each key only its latest state is left, deleted keys with their version. Counts are whole already.

        Old folders are left to readers that opened the store before; ``clean`` removes them.
        """
        stored = self._stored([int(p) for p in self.state["parts"]])
        if stored is None:
            return
        gen = self.generation
        last = stored.groupBy(*_KEY).agg(F.max_by(F.struct("content", "weight", "version", "alive"), "gen").alias("o")).select(*_KEY, "o.*")
        self._write_records(last, gen)
        self._commit({**self.state, "generation": gen + 1, "parts": {p: [gen] for p in self.state["parts"]}})

    def clean(self) -> None:
        """Remove what the latest manifest doesn't name."""
        for kind, child, kept in (("records", "part", {(g, int(p)) for p, gs in self.state["parts"].items() for g in gs}), ("counts", "bucket", {(g, int(b)) for b, g in self.state["counts"].items()})):
            fs, folder = self._folder(kind)
            for x in fs.listStatus(folder) if fs.exists(folder) else []:
                gen = int(x.getPath().getName().removeprefix("gen="))
                if gen >= self.generation:
                    continue
                for y in fs.listStatus(x.getPath()):
                    name = y.getPath().getName()
                    if name.startswith(f"{child}=") and (gen, int(name.removeprefix(f"{child}="))) not in kept:
                        fs.delete(y.getPath(), True)

    def total(self) -> int:
        """How many records there are."""
        return self.state["total"]

    def counts(self, rare_below: int = RARE_BELOW, common_share: tuple[int, int] = COMMON_SHARE) -> DataFrame:
        """term, occurrences (weighted), records, rare, common. A scan: each bucket holds its whole counts."""
        rare = F.col("occurrences") < rare_below
        common = F.col("records") * common_share[1] > F.lit(self.total()) * common_share[0]
        return self._old_counts(list(range(self.buckets))).select("term", "occurrences", "records", rare.alias("rare"), common.alias("common"))


def as_changes(ngram_files: DataFrame) -> DataFrame:
    return ngram_files.select(F.col("fnum").cast("long").alias("k1"), F.col("line_no").alias("k2"), F.col("ngram").alias("content"), F.col("cnt").alias("weight"), F.col("loaded_at").alias("version"))


def load_by_delivery(spark: SparkSession, path: str, ngram_files: DataFrame, late: float = 0.9) -> TermCountStore:
    """Load a table as it came: the bulk first, then, into the store opened again, what was delivered late or again as a batch of deltas."""
    cut_at = ngram_files.agg(F.percentile_approx("loaded_at", late, 1000).alias("cut")).first()["cut"]
    changes = as_changes(ngram_files)
    if cut_at is None:
        TermCountStore(spark, path).apply(changes)
    else:
        bulk = F.coalesce(F.col("version") <= F.lit(cut_at), F.lit(True))
        TermCountStore(spark, path).apply(changes.where(bulk))
        TermCountStore(spark, path).apply(changes.where(~bulk))
    return TermCountStore(spark, path)
