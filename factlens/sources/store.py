"""Tables of one corpus that change together: a run is committed for all of them by one append to the table `runs`.

Every table is a Parquet folder partitioned by bucket (hash of document_id) and by run. A run writes the new state of the buckets it touches, for
every table, where no reader looks yet; then one row a bucket in `runs` makes it the state of that bucket. Readers semi-join the latest committed
run of each bucket, so they see the old state of all tables or the new one, whatever a job stops at. What a stopped job left is no state
of any bucket and goes with `vacuum`.

One writer at a time; any number of readers, each of which keeps the state that it began with as long as `vacuum` keeps that.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .lifecycle import BUCKETS, _delete, _exists, bucketed

RUNS = "number long, run_id string, run string, bucket int, buckets int, generation int"


def _write(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """The only way that this module writes."""
    df.write.mode("append").option("compression", "zstd").partitionBy(*by).parquet(path)


@dataclass(frozen=True)
class State:
    """What a reader sees: the run of each bucket after `number` commits; at most as many as there are buckets."""

    number: int
    generation: int
    buckets: int
    runs: dict[int, str]


class Store:
    """Tables by name, with their schemas, under a root. `buckets` counts until the first commit; `rebucket` changes it later."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, T.StructType | str], buckets: int = BUCKETS, key: str = "document_id") -> None:
        self.spark, self.root, self.key, self.first_buckets = spark, root.rstrip("/"), key, buckets
        self.schemas = {name: T.StructType.fromDDL(s) if isinstance(s, str) else T.StructType([f for f in s]) for name, s in schemas.items()}

    def history(self) -> DataFrame:
        """Committed runs, a row for each bucket that a run gave a new state."""
        if not _exists(self.spark, f"{self.root}/runs"):
            return self.spark.createDataFrame([], RUNS)
        return self.spark.read.schema(RUNS).parquet(f"{self.root}/runs")

    def state(self, back: int = 0) -> State:
        """The committed state, or the one `back` commits before."""
        runs = self.history()
        top = runs.agg(F.max("number")).first()[0]
        if top is None or top - back < 1:
            return State(0, 0, self.first_buckets, {})
        runs = runs.where(F.col("number") <= top - back)
        last = runs.agg(F.max_by(F.struct("number", "generation", "buckets"), "number")).first()[0]
        live = runs.where(F.col("generation") == last["generation"]).groupBy("bucket").agg(F.max_by("run", "number").alias("run"))
        return State(last["number"], last["generation"], last["buckets"], {r["bucket"]: r["run"] for r in live.collect()})

    def read(self, name: str, state: State | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table as of a state (by default the committed one); of some buckets only, where asked for. Several tables read with one state belong together."""
        state = state or self.state()
        live = {b: r for b, r in state.runs.items() if buckets is None or b in set(buckets)}
        fields = self.schemas[name].fieldNames()
        if not live:
            return self.spark.createDataFrame([], self.schemas[name])
        full = T.StructType([*self.schemas[name], T.StructField("bucket", T.IntegerType()), T.StructField("run", T.StringType())])
        table = self.spark.read.schema(full).parquet(f"{self.root}/{name}")
        # Literals prune folders before the scan; pairs decide. Both have as many rows as the store has buckets.
        pairs = self.spark.createDataFrame(list(live.items()), "bucket int, run string")
        pruned = table.where(F.col("bucket").isin(list(live)) & F.col("run").isin(sorted(set(live.values()))))
        return pruned.join(F.broadcast(pairs), ["bucket", "run"], "left_semi").select(*fields)

    def keyed(self, ids: DataFrame, state: State) -> tuple[DataFrame, list[int]]:
        """Distinct documents (key, bucket) of a frame, by the type that the tables have, and their buckets: as many as there are at most."""
        kind = next(f.dataType for s in self.schemas.values() for f in s if f.name == self.key)
        out = bucketed(ids.select(F.col(self.key).cast(kind)).distinct(), state.buckets, self.key)
        return out, [r["bucket"] for r in out.select("bucket").distinct().collect()]

    def rows_of(self, name: str, ids: DataFrame, state: State | None = None) -> DataFrame:
        """What a table holds of some documents; only their buckets are read."""
        state = state or self.state()
        wanted, hit = self.keyed(ids, state)
        return self.read(name, state, hit).join(wanted.select(self.key), self.key, "left_semi").select(self.schemas[name].fieldNames())

    def commit(self, batches: dict[str, DataFrame], run_id: str, keys: DataFrame | None = None, placed: bool = False) -> bool:
        """Replace documents in all tables at once: those of the batches, or those of `keys`, which may be replaced by nothing. A table without a batch
        loses the documents. A run that was committed before is not done again: False. `placed` says that the batches hold rows of `keys` only, and that
        the rows of a bucket lie in one task, as `dealt` leaves them; they are then written where they are."""
        if unknown := set(batches) - set(self.schemas):
            raise ValueError(f"no such table: {sorted(unknown)}")
        if not self.history().where(F.col("run_id") == run_id).isEmpty():
            return False
        state = self.state()
        named = [df.select(self.key) for df in batches.values()] if keys is None else [keys.select(self.key)]
        gone = named[0]
        for other in named[1:]:
            gone = gone.unionByName(other)
        gone, hit = self.keyed(gone, state)
        self._write_run(state, run_id, hit, {name: self._next(name, batches.get(name), gone, state, hit, placed) for name in self.schemas}, state.buckets, state.generation)
        return True

    def dealt(self, rows: DataFrame, buckets: int) -> DataFrame:
        """Rows with their bucket, those of one bucket in one task."""
        return bucketed(rows, buckets, self.key).repartition("bucket")

    def _typed(self, name: str, rows: DataFrame) -> DataFrame:
        return rows.select([F.col(f.name).cast(f.dataType) for f in self.schemas[name]])

    def _next(self, name: str, batch: DataFrame | None, gone: DataFrame, state: State, hit: list[int], placed: bool) -> DataFrame:
        rows = self.read(name, state, hit).join(gone.select(self.key), self.key, "left_anti")
        if batch is not None and placed:
            new = bucketed(self._typed(name, batch), state.buckets, self.key)
            return self.dealt(self._typed(name, rows), state.buckets).unionByName(new) if set(hit) & set(state.runs) else new
        if batch is not None:
            # Rows of documents that are not replaced would double on the next run, so they are no part of a batch.
            rows = rows.unionByName(batch.select(self.schemas[name].fieldNames()).join(gone.select(self.key), self.key, "left_semi"))
        return self.dealt(self._typed(name, rows), state.buckets)

    def _write_run(self, state: State, run_id: str, hit: list[int], tables: dict[str, DataFrame], buckets: int, generation: int) -> None:
        run = uuid.uuid4().hex
        for name, df in tables.items():
            if hit:
                _write(df.withColumn("run", F.lit(run)), f"{self.root}/{name}", ("bucket", "run"))
        # A run that touches nothing is committed too, so that it is not tried again; bucket -1 holds no rows.
        rows = [(state.number + 1, run_id, run, b, buckets, generation) for b in hit or [-1]]
        _write(self.spark.createDataFrame(rows, RUNS).coalesce(1), f"{self.root}/runs")

    def rebucket(self, buckets: int, run_id: str) -> None:
        """Deal all tables out to another number of buckets, in one run."""
        state = self.state()
        self._write_run(state, run_id, list(range(buckets)), {name: self.dealt(self._typed(name, self.read(name, state)), buckets) for name in self.schemas}, buckets, state.generation + 1)

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that none of the last `keep` states reads: replaced buckets, and what stopped jobs left. Returns their number."""
        live = {(b, r) for back in range(keep) for b, r in self.state(back).runs.items()}
        gone = 0
        for name in self.schemas:
            if not _exists(self.spark, f"{self.root}/{name}"):
                continue
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/bucket=*/run=*")
            system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for status in system.globStatus(path) or []:
                folder = status.getPath()
                bucket, run = folder.getParent().getName().split("=")[1], folder.getName().split("=")[1]
                if (int(bucket), run) not in live:
                    _delete(self.spark, folder.toString())
                    gone += 1
                    if not len(system.listStatus(folder.getParent())):
                        system.delete(folder.getParent(), False)
        return gone
