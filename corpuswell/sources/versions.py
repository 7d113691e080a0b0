"""A chunk index in versions: a log of commits over hashed buckets, with upserts, tombstones, compaction and clean-up."""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from corpuswell.sources.files import Files
from corpuswell.sources.index import point_id, upsert

#: After so many commits one lists all that is live, so that older entries of the log need not be read.
LISTED_EVERY = 20


class VersionedIndex:
    """Chunks (strategy, doc_id, position, chunk_text and other columns) under a path.

    Rows of a commit are dealt to buckets by a hash of their point id and written as a folder of their own, `data/commit=.../strategy=.../bucket=...`; a commit
    writes no bucket that it does not touch. An entry of the log then names the folders that it adds and those that it replaces. An entry is
    published by a rename that fails if its number is taken, whereupon the next is tried: a reader sees all of a commit or nothing, and what a
    failed job has written is never named. A batch that was committed before is not committed again.

    A version of the index is the fold of the entries up to it. Of rows with one point id the one of the latest commit counts; a tombstone hides
    those before it. Buckets with one folder are read as they are; only others are merged.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets, self.files = spark, path.rstrip("/"), buckets, Files(spark, path)

    def _entries(self, upto: int | None = None) -> list[dict]:
        """The entries of the log from the last that lists all that is live."""
        names = [n for n in self.files.names(f"{self.path}/log") if n.endswith(".json")]
        numbers = [int(n.split(".")[0]) for n in names if upto is None or int(n.split(".")[0]) <= upto]
        if not numbers:
            return []
        first = (numbers[-1] // LISTED_EVERY) * LISTED_EVERY
        texts = self.spark.read.text([f"{self.path}/log/{n:020d}.json" for n in numbers if n >= first], wholetext=True)
        return sorted((json.loads(r["value"]) for r in texts.collect()), key=lambda e: e["version"])  # LISTED_EVERY small files

    @staticmethod
    def _live(entries: list[dict]) -> dict[str, int]:
        """Folders that count, each with the version whose rows it holds."""
        live: dict[str, int] = {}
        for e in entries:
            if "live" in e:
                live = dict(e["live"])
                continue
            for folder in e["removes"]:
                live.pop(folder, None)
            live.update(e["adds"])
        return live

    def version(self) -> int:
        """The number of the last commit; -1 before the first."""
        entries = self._entries()
        return entries[-1]["version"] if entries else -1

    def _publish(self, entries: list[dict], adds: dict[str, int] | list[str], removes: list[str], batch: str | None, schema: str) -> int:
        """Adds an entry after `entries`, or after those that others have published meanwhile; folders in a list get the entry's own version."""
        while True:
            number = entries[-1]["version"] + 1 if entries else 0
            own = adds if isinstance(adds, dict) else dict.fromkeys(adds, number)
            entry = {"version": number, "adds": own, "removes": removes, "batch": batch, "schema": schema, "batches": self._batches(entries) + ([batch] if batch else [])}
            if number % LISTED_EVERY == 0:
                entry["live"] = self._live([*entries, entry])
            if self.files.publish(json.dumps(entry), f"{self.path}/log/{number:020d}.json"):
                return number
            entries = self._entries()
            if batch and batch in self._batches(entries):
                return entries[-1]["version"]

    @staticmethod
    def _batches(entries: list[dict]) -> list[str]:
        """The last batches that were committed; a stream runs none but its last again."""
        return entries[-1]["batches"][-100:] if entries else []

    def _write(self, rows: DataFrame) -> tuple[list[str], str]:
        """Writes rows as a new commit's folders and names them, with the schema of rows."""
        name = f"commit={uuid.uuid4().hex}"
        dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("_key"), F.lit(self.buckets)).cast("int"))
        dealt.repartition("strategy", "bucket").write.partitionBy("strategy", "bucket").parquet(f"{self.path}/data/{name}")
        return [f"{name}/{f}" for f in self.files.folders(f"{self.path}/data/{name}", 2)], rows.schema.json()

    def _read(self, live: dict[str, int], schema: str) -> DataFrame:
        """Rows of live folders with `_order`, the version whose rows they are."""
        kind = StructType.fromJson(json.loads(schema)).add("commit", StringType()).add("bucket", IntegerType())
        if not live:
            return self.spark.createDataFrame([], kind).withColumn("_order", F.lit(0).cast("long")).drop("commit", "bucket")
        rows = self.spark.read.option("basePath", f"{self.path}/data").schema(kind).parquet(*[f"{self.path}/data/{f}" for f in live])
        orders = {f.split("/")[0].removeprefix("commit="): v for f, v in live.items()}
        named = self.spark.createDataFrame(list(orders.items()), "commit string, _order long")  # a row for each live commit
        return rows.join(F.broadcast(named), "commit").drop("commit", "bucket")

    def _merged(self, live: dict[str, int], schema: str) -> DataFrame:
        """The rows that count, without tombstones."""
        places: dict[str, list[str]] = {}
        for folder in live:
            places.setdefault(folder.split("/", 1)[1], []).append(folder)
        alone = {f: live[f] for own in places.values() if len(own) == 1 for f in own}
        several = {f: live[f] for own in places.values() if len(own) > 1 for f in own}
        rows = self._read(alone, schema)
        if several:
            last = F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("_order")))
            rows = rows.unionByName(self._read(several, schema).withColumn("_n", last).where("_n = 1").drop("_n"))
        return rows.where("NOT _deleted").drop("_order")

    def snapshot(self, version: int | None = None, strategy: str | None = None) -> DataFrame:
        """The chunks of a version, the last by default; of one strategy only its folders are read. Raises ValueError before the first commit."""
        entries = self._entries(version)
        if not entries:
            raise ValueError(f"{self.path} has no version")
        live = self._live(entries)
        if strategy is not None:
            live = {f: v for f, v in live.items() if f.split("/")[1] == f"strategy={strategy}"}
        return self._merged(live, entries[-1]["schema"]).drop("_key", "_deleted")

    def upsert(self, chunks: DataFrame, batch: str | None = None) -> int:
        """Commits chunks, of equal point ids the last (see index.upsert); gives the version. Chunks without a strategy, document or text leave. A batch that is in the log does nothing."""
        entries = self._entries()
        if batch and batch in self._batches(entries):
            return entries[-1]["version"]
        chunks = chunks.where("strategy IS NOT NULL AND doc_id IS NOT NULL AND chunk_text IS NOT NULL")
        rows = point_id(upsert(None, chunks)).withColumnRenamed("point_id", "_key").withColumn("_deleted", F.lit(False))
        folders, schema = self._write(rows)
        return self._publish(entries, folders, [], batch, schema)

    def delete(self, condition: Column | str) -> int:
        """Commits a tombstone for each chunk that the condition holds for, and gives their number; buckets without such a chunk are not written."""
        entries = self._entries()
        if not entries:
            return 0
        schema = entries[-1]["schema"]
        kept = {"strategy", "_key", "_deleted"}
        gone = self._merged(self._live(entries), schema).where(condition)
        rows = gone.select(*[F.lit(True).alias(c) if c == "_deleted" else F.col(c) if c in kept else F.lit(None).cast(t).alias(c) for c, t in gone.dtypes])
        folders, _ = self._write(rows)
        if not folders:
            return 0
        self._publish(entries, folders, [], None, schema)
        written = self.spark.read.parquet(*[f"{self.path}/data/{f}" for f in folders])
        return written.count()

    def clear(self) -> int:
        """Commits that nothing is live, and gives the version; files stay until vacuum."""
        entries = self._entries()
        return self._publish(entries, [], list(self._live(entries)), None, entries[-1]["schema"]) if entries else -1

    def compact(self, most: int = 4) -> int:
        """Rewrites the buckets of more than `most` folders as one each, and gives how many there were. Rows keep their place in the order of
        versions, so what is committed meanwhile stays above them."""
        entries = self._entries()
        live, places = self._live(entries), {}
        for folder in live:
            places.setdefault(folder.split("/", 1)[1], []).append(folder)
        old = [f for own in places.values() if len(own) > most for f in own]
        if not old:
            return 0
        schema = entries[-1]["schema"]
        folders, _ = self._write(self._merged({f: live[f] for f in old}, schema))
        self._publish(entries, dict.fromkeys(folders, entries[-1]["version"]), old, None, schema)
        return sum(len(own) > most for own in places.values())

    def vacuum(self) -> int:
        """Removes the folders that the last version does not need, of failed commits too, and gives the number of files. Older versions cannot be read afterwards; no other
        writer may be at work."""
        live, removed = set(self._live(self._entries())), 0
        for folder in self.files.folders(f"{self.path}/data", 3):
            if folder not in live:
                removed += self.files.remove(f"{self.path}/data/{folder}")
        return removed


def clear_snapshot(spark: SparkSession, path: str, prefix: str) -> int:
    """Removes the stored files (see datasets.write_files) of all snapshots whose names begin with prefix, and gives their number."""
    files, gone = Files(spark, path), []
    for name in files.names(path):
        if name.startswith("snapshot_id=") and unquote(name).removeprefix("snapshot_id=").startswith(prefix):
            gone.append(f"{path}/{name}")
    if not gone:
        return 0
    n = spark.read.parquet(*gone).count()
    for folder in gone:
        files.remove(folder)
    return n
