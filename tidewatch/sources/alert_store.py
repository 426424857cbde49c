"""A table of alerts that is updated by id.

Alerts lie in segments, folders of Parquet files cut by modality and bucket of the id. Inside a cell rows are sorted by day and cut into
files of bounded length, so that a filter on ``date`` skips files and row groups by their smallest and largest day without a
folder per day. A manifest names the segments that count: per cell (modality and bucket) one base segment in which ids are unique, and newer segments of updates. A manifest is
written under a name of its own and then renamed to its version number, which fails if another writer was first; that
writer reads again and retries. Readers see one version as a whole. Of several writes of an id the last one counts: the
latest timestamp, then the newest segment. Merging rewrites only cells that were updated; files that no
manifest needs are removed by ``vacuum``.

A cell is written by one task; take as many buckets as leave it a few GB. The id tells the modality, as ids are hashes of modality and record key; filters on modality and bucket reach the files.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.schemas import ALERT_SCHEMA, MODALITIES

BUCKETS = 16
MERGE_AFTER = 8  # segments of updates
ROWS_PER_FILE = 1_000_000
ATTEMPTS = 10

_STORED = T.StructType([*ALERT_SCHEMA.fields, T.StructField("bucket", T.IntegerType()), T.StructField("date", T.DateType())])


class AlertStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, merge_after: int = MERGE_AFTER):
        self.spark, self.path, self.merge_after = spark, path.rstrip("/"), merge_after
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.buckets = self.manifest().get("buckets", buckets)
        self._first = {"version": 0, "buckets": self.buckets, "base": {}, "updates": [], "applied": {}}

    # ---- manifests --------------------------------------------------------------------------------

    def _place(self, name: str):
        place = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place, place.getFileSystem(self._conf)

    def versions(self) -> list[int]:
        place, files = self._place("manifest")
        if not files.exists(place):
            return []
        names = [s.getPath().getName() for s in files.listStatus(place)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default the newest; empty for a store without any."""
        known = self.versions()
        if not known:
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{version or known[-1]:012d}.json", wholetext=True).first()["value"])

    def _publish(self, manifest: dict) -> bool:
        """Make a manifest the newest; false if its version exists already."""
        fs = self._jvm.org.apache.hadoop.fs
        draft, files = self._place(f"manifest/.draft-{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        target, _ = self._place(f"manifest/{manifest['version']:012d}.json")
        rename = getattr(fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            fs.FileContext.getFileContext(files.getUri(), self._conf).rename(draft, target, options)
            return True
        except Exception as error:
            files.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise

    def _change(self, change) -> dict:
        """Publish ``change(manifest)``; on a lost race the change is made anew on what the other writer left."""
        for attempt in range(ATTEMPTS):
            now = self.manifest() or self._first
            new = change(now)
            if new is None:
                return now
            new = new | {"version": now["version"] + 1}
            if self._publish(new):
                return new
            time.sleep(0.05 * (attempt + 1))
        raise RuntimeError("other writers keep changing the store")

    # ---- writing ----------------------------------------------------------------------------------

    def bucket_of(self, alert: Column) -> Column:
        return F.pmod(F.xxhash64(alert), F.lit(self.buckets)).cast("int")

    def _placed(self, rows: DataFrame, unique: bool = False) -> DataFrame:
        """The last writes per id, a cell's rows together in the order of their days.

        Rows move once: the ids of a cell meet in the task that writes it. Rows that lie in cells and are ``unique`` stay where they are.
        """
        if not unique:
            bucket = self.bucket_of(F.col("id"))
            cells = rows.withColumns({"bucket": bucket, "_cell": F.concat_ws("/", "modality", bucket.cast("string"))})
            rows = last_writes(cells.repartition("_cell"))
        dated = rows.select(*ALERT_SCHEMA.names, "bucket", F.to_date("timestamp").alias("date"))
        return dated.sortWithinPartitions("modality", "bucket", "date", "timestamp")

    def _write(self, rows: DataFrame, unique: bool = False) -> str:
        """One segment."""
        name = f"data/{uuid.uuid4().hex}"
        self._placed(rows, unique).write.partitionBy("modality", "bucket").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(f"{self.path}/{name}")
        return name

    def upsert(self, alerts: DataFrame, source: str | None = None, batch: int | None = None) -> None:
        """Add alerts or replace those of the same id. A batch of a source that was applied already changes nothing."""
        def known(manifest: dict) -> bool:
            return source is not None and manifest["applied"].get(source, -1) >= batch

        if known(self.manifest() or self._first):
            return
        name = self._write(alerts.select(*ALERT_SCHEMA.names).withColumn("_at", F.lit(0)))

        def add(now: dict) -> dict | None:
            if known(now):
                return None
            applied = now["applied"] | ({source: batch} if source is not None else {})
            return now | {"updates": [*now["updates"], [now["version"] + 1, name]], "applied": applied}

        if len(self._change(add)["updates"]) >= self.merge_after:
            self.merge()

    def acknowledge(self, acks: DataFrame) -> None:
        """Set the flag of the alerts that are named."""
        named = acks.select("alert_id").distinct()
        known = self.read().join(named, F.col("id") == F.col("alert_id"), "left_semi")
        self.upsert(known.withColumn("is_acknowledged", F.lit(True)))

    def merge(self) -> None:
        """Give every updated cell a new base segment with unique ids."""
        now = self.manifest()
        if not now or not now["updates"]:
            return
        done = [list(u) for u in now["updates"]]
        touched = self._segments(now, [], [u for u in done]).select("modality", "bucket").distinct().collect()  # modalities times buckets
        cells = [f"{r['modality']}/{r['bucket']}" for r in touched]
        alone = len(done) == 1 and not any(c in now["base"] for c in cells)  # a segment's ids are unique, and nothing else is in its cells
        name = self._write(self._segments(now, cells, now["updates"]), unique=alone)

        def swap(found: dict) -> dict | None:
            if any(found["base"].get(c) != now["base"].get(c) for c in cells) or [u for u in done if u not in found["updates"]]:
                return None  # another writer merged these cells
            at = max(u[0] for u in done)
            return found | {"base": found["base"] | {c: [at, name] for c in cells}, "updates": [u for u in found["updates"] if u not in done]}

        self._change(swap)

    def vacuum(self, keep: int = 2, grace_seconds: int = 3600) -> int:
        """Remove the segments that none of the newest ``keep`` versions needs, and older manifests; returns how many segments went.

        Younger ones than ``grace_seconds`` stay, as a writer may be about to publish them.
        """
        if keep < 1:
            raise ValueError("the newest version must stay")
        versions = self.versions()
        kept = [self.manifest(v) for v in versions[-keep:]]
        needed = {n for m in kept for _, n in [*m["base"].values(), *m["updates"]]}
        place, files = self._place("data")
        gone = 0
        for status in files.listStatus(place) if files.exists(place) else []:
            old = status.getModificationTime() <= (time.time() - grace_seconds) * 1000
            if old and f"data/{status.getPath().getName()}" not in needed:
                gone += bool(files.delete(status.getPath(), True))
        for v in versions[:-keep]:
            files.delete(self._place(f"manifest/{v:012d}.json")[0], False)
        return gone

    # ---- reading ----------------------------------------------------------------------------------

    def _segments(self, manifest: dict, cells: Sequence[str] | None, updates: Sequence) -> DataFrame:
        """Rows of base segments, each only in the cells it counts for, and of updates, with the segment's age as ``_at``."""
        bases: dict[tuple, list[str]] = {}
        for cell, (at, name) in manifest["base"].items():
            if cells is None or cell in cells:
                bases.setdefault((at, name), []).append(cell)
        parts = []
        for (at, name), own in sorted(bases.items()):
            rows = self.spark.read.schema(_STORED).parquet(f"{self.path}/{name}")
            by_modality = [
                (F.col("modality") == m) & F.col("bucket").isin([int(c.split("/")[1]) for c in own if c.split("/")[0] == m])
                for m in sorted({c.split("/")[0] for c in own})
            ]
            condition = by_modality[0]
            for more in by_modality[1:]:
                condition = condition | more
            parts.append(rows.where(condition).withColumn("_at", F.lit(at)))
        parts += [self.spark.read.schema(_STORED).parquet(f"{self.path}/{name}").withColumn("_at", F.lit(at)) for at, name in updates]
        if not parts:
            return self.spark.createDataFrame([], T.StructType([*_STORED.fields, T.StructField("_at", T.IntegerType())]))
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    def _rows(self, manifest: dict, cells: Sequence[str] | None = None) -> DataFrame:
        rows = self._segments(manifest, cells, manifest["updates"])
        return last_writes(rows) if manifest["updates"] else rows.drop("_at")

    def read(self, modality: str | None = None, version: int | None = None, since: str | None = None) -> DataFrame:
        """All alerts, or those of one modality or from a day on, each id once."""
        if modality is not None and modality not in MODALITIES:
            raise ValueError(f"unknown modality: {modality}")
        rows = self._rows(self.manifest(version) or self._first)
        if modality is not None:
            rows = rows.where(F.col("modality") == modality)
        if since is not None:
            rows = rows.where(F.col("date") >= F.lit(since).cast("date"))
        return rows.select(*ALERT_SCHEMA.names)

    def alert(self, alert: str) -> DataFrame:
        """The alert of one id; only its bucket is read."""
        bucket = self.spark.range(1).select(self.bucket_of(F.lit(alert))).first()[0]
        return self._rows(self.manifest() or self._first).where((F.col("bucket") == bucket) & (F.col("id") == alert)).select(*ALERT_SCHEMA.names)


def last_writes(rows: DataFrame) -> DataFrame:
    """Of several rows of one id the last: the latest timestamp, the newest segment (``_at``), then the one whose fields as text are last.

    An aggregation by modality, bucket and id, so filters on these reach the files; rows dealt by ``_cell`` do not move again.
    """
    keys = ("_cell", "modality", "bucket", "id")
    names = [c for c in rows.columns if c not in ("_at", *keys)]
    by = [c for c in keys if c in rows.columns]
    whole = F.struct(*names)
    order = F.struct(F.col("timestamp"), F.col("_at"), F.to_json(whole))
    return rows.groupBy(*by).agg(F.max_by(whole, order).alias("_a")).select(*by, "_a.*")
