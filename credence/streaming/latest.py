"""The latest score of every id, and the first k of them, over batches that keep arriving.

Batches are written as they come.  Once they hold enough rows they are merged with what was there into
a generation: the latest row of every id, in bands of falling score with a small table of the rows of each
band.  A list then needs the batches since the last generation, which change c ids, and of the
generation only the bands of the first k + c rows: at least k of those were not changed.  A generation is
written again only after a fixed share of its rows has arrived, so merging costs a constant number
of rows for each row that arrives.

A generation counts once its table of bands is there; a batch that is run again overwrites its own
folder only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

SCORE_COLUMNS = ("candidate_id", "raw_score", "trust_score", "final_score")
_SCHEMA = "candidate_id string, raw_score double, trust_score double, final_score double"


@dataclass(frozen=True)
class LatestScores:
    """`path` is the state's folder.  Batches are merged once they have `least_rows` rows and
    `share` of the last generation's, or are `most_batches`; a band has about `band_rows` rows."""
    spark: SparkSession
    path: str
    least_rows: int = 100_000
    share: float = 0.5
    most_batches: int = 500
    band_rows: int = 1_000_000

    # --- folders

    def _folder(self, kind: str, number: int) -> str:
        return f"{self.path}/{kind}/{kind}={number}"

    def _file_system(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self, kind: str) -> list[int]:
        """The numbers of the completely written folders of a kind."""
        system, path = self._file_system(f"{self.path}/{kind}")
        if not system.exists(path):
            return []
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        found = [s.getPath() for s in system.listStatus(path)]
        return sorted(int(p.getName().split("=")[1]) for p in found
                      if system.exists(hadoop(p, "_SUCCESS")))

    def _drop(self, kind: str, number: int) -> None:
        system, path = self._file_system(self._folder(kind, number))
        system.delete(path, True)

    # --- reading

    def _since(self, upto: int | None) -> tuple[int | None, list[int]]:
        """The last generation and the batches behind it, up to a batch."""
        fits = lambda n: upto is None or n <= upto
        generations = self._numbers("band")
        last = max(filter(fits, generations), default=None)
        if last is None and generations:
            raise ValueError(f"batch {upto} is before the oldest generation that is kept")
        return last, [b for b in self._numbers("batch")
                      if fits(b) and (last is None or b > last)]

    def _arrived(self, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], _SCHEMA + ", place bigint, batch bigint")
        return (self.spark.read.schema(_SCHEMA + ", place bigint, batch bigint")
                .option("basePath", f"{self.path}/batch")
                .parquet(*[self._folder("batch", b) for b in batches]))

    def _generation(self, number: int, bands: list[int] | None = None) -> DataFrame:
        """A generation, or some of its bands."""
        folder = self._folder("generation", number)
        paths = [folder] if bands is None else [f"{folder}/band={b}" for b in bands]
        if not paths:
            return self.spark.createDataFrame([], _SCHEMA + ", band int")
        return self.spark.read.schema(_SCHEMA + ", band int").option(
            "basePath", folder).parquet(*paths)

    @staticmethod
    def _last(arrived: DataFrame) -> DataFrame:
        """The last row of every id, combined in the tasks before the shuffle."""
        values = F.struct(*SCORE_COLUMNS[1:])
        return arrived.groupBy("candidate_id").agg(
            F.max_by(values, F.struct("batch", "place")).alias("s")).select(
            "candidate_id", "s.*")

    def latest(self, upto: int | None = None) -> DataFrame:
        """The latest scores of all ids."""
        last, batches = self._since(upto)
        changed = self._last(self._arrived(batches))
        if last is None:
            return changed
        kept = self._generation(last).select(*SCORE_COLUMNS).join(
            changed.select("candidate_id"), "candidate_id", "left_anti")
        return kept.unionByName(changed)

    def top(self, k: int, upto: int | None = None) -> DataFrame:
        """The exact first k of the latest scores (ties: the smallest id)."""
        last, batches = self._since(upto)
        changed = self._last(self._arrived(batches))
        if last is not None:
            changes = changed.count() if batches else 0
            bands = self.spark.read.schema("band int, n bigint").parquet(
                self._folder("band", last)).orderBy("band").collect()
            needed, seen = [], 0
            for r in bands:
                if seen >= k + changes:
                    break
                needed.append(r["band"])
                seen += r["n"]
            first = self._generation(last, needed)
            if batches:
                first = first.join(changed.select("candidate_id"), "candidate_id", "left_anti")
            changed = first.select(*SCORE_COLUMNS).unionByName(changed)
        return changed.orderBy(F.desc("final_score"), F.asc("candidate_id")).limit(k)

    # --- writing

    def add(self, scores: DataFrame, batch: int) -> None:
        """Keep a batch of scores; merge if enough has arrived."""
        (scores.select(*SCORE_COLUMNS).withColumn("place", F.monotonically_increasing_id())
         .write.mode("overwrite").parquet(self._folder("batch", batch)))
        last, batches = self._since(None)
        if last is not None and last >= batch or not batches:
            return                              # run again after a failure: merged already
        held = 0 if last is None else self.spark.read.schema("band int, n bigint").parquet(
            self._folder("band", last)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        arrived = self._arrived(batches).count()
        if len(batches) >= self.most_batches or arrived >= max(
                self.least_rows, self.share * held):
            self._merge(batch, last, batches, held + arrived)

    def _merge(self, number: int, last: int | None, batches: list[int], rows: int) -> None:
        arrived = self._arrived(batches)
        if last is not None:
            arrived = arrived.unionByName(self._generation(last).select(
                *SCORE_COLUMNS, F.lit(-1).cast("bigint").alias("place"),
                F.lit(last).cast("bigint").alias("batch")))
        target = self._folder("generation", number)
        (self._last(arrived)
         .repartitionByRange(1 + rows // self.band_rows, F.desc("final_score"),
                             F.asc("candidate_id"))
         .withColumn("band", F.spark_partition_id())
         .write.mode("overwrite").partitionBy("band").parquet(target))
        (self._generation(number).groupBy("band").agg(F.count("*").alias("n")).coalesce(1)
         .write.mode("overwrite").parquet(self._folder("band", number)))
        # The generation before stays for readers that began with it.
        for old in [g for g in self._numbers("band") if last is not None and g < last]:
            self._drop("band", old)
            self._drop("generation", old)
        for old in [b for b in self._numbers("batch") if last is not None and b <= last]:
            self._drop("batch", old)
