"""Snapshots in buckets: a batch rewrites the buckets that its keys fall into and no other.

A store is a folder. `data/batch=<n>/bucket=<b>` holds what batch n made of bucket b; `manifest/<n>` says which batch made each
bucket, and is renamed into place after the data is whole, so a reader sees a batch or does not. A batch that runs again finds
its manifest and does nothing; one that broke off before its manifest writes the same files anew. The last KEEP manifests stay,
for readers that began on them; what only older ones name is deleted.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, KEEP = 256, 2


class Store:
    """keys: the columns that batches and snapshots share and that a row is found by; merge_rows(old or None, batch) makes the new rows."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], merge_rows: Callable, buckets: int = BUCKETS, keep: int = KEEP):
        self.spark, self.folder, self.keys, self.merge_rows, self.buckets, self.keep = spark, folder.rstrip("/"), keys, merge_rows, buckets, keep

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def batches(self) -> list[int]:
        """The batches whose manifests are there."""
        fs, p = self._path("manifest")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, batch_id: int) -> dict:
        fs, p = self._path(f"manifest/{batch_id:08d}")
        text = self.spark.read.text(p.toString(), wholetext=True).first()[0]
        return json.loads(text)

    def _publish(self, batch_id: int, content: dict) -> None:
        fs, draft = self._path(f"manifest/_draft-{batch_id:08d}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        _, p = self._path(f"manifest/{batch_id:08d}")
        if not fs.rename(draft, p):
            raise OSError(f"the manifest of batch {batch_id} can't be put into place")

    def _paths(self, made_by: dict[str, int], buckets: list[int] | None = None) -> list[str]:
        chosen = made_by if buckets is None else [str(b) for b in buckets if str(b) in made_by]
        return [f"{self.folder}/data/batch={made_by[b]:08d}/bucket={b}" for b in chosen]

    def read(self, batch_id: int | None = None) -> DataFrame:
        """The snapshot after a batch, the last one by default."""
        done = self.batches()
        if not done:
            raise ValueError(f"no batch has been merged into {self.folder}")
        m = self.manifest(done[-1] if batch_id is None else batch_id)
        paths = self._paths(m["made_by"])
        return self.spark.read.schema(m["schema"]).parquet(*paths) if paths else self.spark.createDataFrame([], m["schema"])

    def merge(self, batch: DataFrame, batch_id: int) -> int:
        """Merges a batch; the number of buckets written (0 if it had been merged before)."""
        done = self.batches()
        if done and done[-1] >= batch_id:
            return 0
        if batch_id > 0 and (not done or done[-1] != batch_id - 1):
            raise ValueError(f"the snapshot before batch {batch_id} is missing: {self.folder}/manifest/{batch_id - 1:08d}")
        before = self.manifest(done[-1]) if done else {"made_by": {}, "schema": None, "buckets": self.buckets}
        if before["buckets"] != self.buckets:
            raise ValueError(f"{self.folder} has {before['buckets']} buckets, not {self.buckets}")
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = sorted(r[0] for r in batch.select(bucket.alias("b")).distinct().collect())  # at most one number a bucket
        paths = self._paths(before["made_by"], touched)
        old = self.spark.read.schema(before["schema"]).parquet(*paths) if paths else None
        new = self.merge_rows(old, batch)
        at = f"{self.folder}/data/batch={batch_id:08d}"
        if touched:
            new.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
        made_by = before["made_by"] | {str(b): batch_id for b in touched}
        replaced = {str(b): before["made_by"][str(b)] for b in touched if str(b) in before["made_by"]}
        self._publish(batch_id, {"made_by": made_by, "replaced": replaced, "schema": _ddl(new), "buckets": self.buckets})
        self._clean(batch_id)
        return len(touched)

    def _clean(self, batch_id: int) -> None:
        """Drops the manifests before the last `keep`, oldest first, and the buckets that the one after each replaced."""
        for k in self.batches():
            if k > batch_id - self.keep:
                break
            for b, made in self.manifest(k + 1)["replaced"].items():
                fs, p = self._path(f"data/batch={made:08d}/bucket={b}")
                fs.delete(p, True)
            fs, p = self._path(f"manifest/{k:08d}")
            fs.delete(p, False)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
