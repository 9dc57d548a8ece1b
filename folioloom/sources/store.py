"""Tables of documents kept in segments, with atomic commits.

A change writes one new segment: for each table the new rows, and the ids of the documents that it touches, whose
earlier rows in that table are void. Old files stay as they are, so that an upsert costs what it changes, whatever
the table has. A segment counts once its record is in the log, which is written last and only where no other record
of that number is: a run that dies before leaves nothing that readers see, and of two writers one comes second. Rows lie in
``buckets`` by a hash of doc_id, so that reading some documents opens their buckets alone; ``merge`` makes one segment of
many, for all tables or for some buckets.

    root/_log/00000000000000000007.json     {"segment", "tables", "batch", "replaces"}
    root/<table>/segment=<id>/bucket=<n>/   rows
    root/<table>.touched/segment=<id>/      doc_id

``batch`` names what a segment was made of (a stream's micro-batch): a second commit of that name changes nothing.
The log has a few hundred bytes a segment; the driver lists it, and no document.
"""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 32


class Conflict(Exception):
    """Another writer has committed since the tables were read."""


@dataclass(frozen=True)
class Segment:
    number: int
    id: str
    tables: tuple[str, ...]
    batch: str | None


class Store:
    """The tables under ``root``. ``order``: columns by which a table's rows are sorted in their files, for lookups by them."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, order: dict[str, list[str]] | None = None):
        self.spark, self.root, self.buckets, self.order = spark, root.rstrip("/"), buckets, order or {}
        at = urlsplit(self.root)
        #: Where the log lies as a folder of this machine's; None where only Hadoop reaches it.
        self._local = unquote(at.path) if at.scheme in ("", "file") else None

    # -- the log ---------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _records(self) -> dict[int, dict]:
        """All records of the log by number."""
        if self._local is not None:
            folder, out = f"{self._local}/_log", {}
            for name in os.listdir(folder) if os.path.isdir(folder) else []:
                if name.endswith(".json"):
                    with open(f"{folder}/{name}", encoding="utf-8") as f:
                        out[int(name[:-5])] = json.load(f)
            return out
        fs, folder = self._fs(f"{self.root}/_log")
        if not fs.exists(folder):
            return {}
        rows = self.spark.read.text(f"{self.root}/_log/*.json", wholetext=True).select(F.col("_metadata.file_name").alias("n"), "value").collect() if fs.listStatus(folder) else []
        return {int(r["n"][:-5]): json.loads(r["value"]) for r in rows}

    def _put(self, number: int, record: dict) -> bool:
        """Write a record of the log, unless there is one of that number."""
        name, text = f"{number:020}.json", json.dumps(record)
        if self._local is not None:
            folder = f"{self._local}/_log"
            os.makedirs(folder, exist_ok=True)
            draft = f"{folder}/.{uuid.uuid4().hex}"
            with open(draft, "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(draft, f"{folder}/{name}")  # fails where the name is taken
            except FileExistsError:
                return False
            finally:
                os.remove(draft)
            return True
        fs, folder = self._fs(f"{self.root}/_log")
        fs.mkdirs(folder)
        _, draft = self._fs(f"{self.root}/_log/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.rename(draft, self._fs(f"{self.root}/_log/{name}")[1]):  # never over a file
            return True
        fs.delete(draft, False)
        return False

    def last(self) -> int:
        """The number of the last commit; 0 for none."""
        return max(self._records(), default=0)

    def segments(self, until: int | None = None) -> list[Segment]:
        """Segments that count, oldest first; those that a merge replaced are gone, and it stands where the last of them stood."""
        live: dict[str, Segment] = {}
        for number, r in sorted(self._records().items()):
            if until is not None and number > until:
                break
            for old in r.get("replaces", []):
                live.pop(old, None)
            live[r["segment"]] = Segment(r.get("stands", number), r["segment"], tuple(r["tables"]), r.get("batch"))
        return sorted(live.values(), key=lambda s: s.number)

    def _batches(self) -> set[str]:
        return {r["batch"] for r in self._records().values() if r.get("batch")}

    # -- reading ---------------------------------------------------------------------

    def bucket(self, doc_id="doc_id"):
        return F.pmod(F.xxhash64(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(self.buckets)).cast("int")

    def _parts(self, table: str, segments: list[Segment], suffix: str = "", like: DataFrame | None = None) -> DataFrame | None:
        """Rows of a table's segments, with ``_at``: the number of each row's segment; ``like``: rows whose columns these have too."""
        own = [s for s in segments if table in s.tables]
        if not own:
            return None
        reader = self.spark.read.option("basePath", f"{self.root}/{table}{suffix}")
        reader = reader.schema(T.StructType([*like.drop("_at").schema, T.StructField("segment", T.StringType())])) if like is not None else reader.option("mergeSchema", "true")
        rows = reader.parquet(*[f"{self.root}/{table}{suffix}/segment={s.id}" for s in own])
        number = F.create_map(*[F.lit(x) for s in own for x in (s.id, s.number)])
        return rows.withColumn("_at", F.element_at(number, F.col("segment").cast("string"))).drop("segment")

    def _marks(self, table: str, segments: list[Segment], among: DataFrame | None) -> dict[int, tuple[int, int]]:
        """By a segment's number: how many documents (of ``among``) it touches, and how many of those a later one touches again. The driver gets a row a segment."""
        touched = self._parts(table, segments, ".touched").select("doc_id", "_at")
        if among is not None:
            touched = touched.join(among.select("doc_id").distinct(), "doc_id", "left_semi")
        each = touched.groupBy("doc_id").agg(F.collect_set("_at").alias("ats")).withColumn("_last", F.array_max("ats"))
        counted = each.select("_last", F.explode("ats").alias("at")).groupBy("at").agg(F.count("*").alias("n"), F.count_if(F.col("at") < F.col("_last")).alias("void"))
        return {r["at"]: (r["n"], r["void"]) for r in counted.collect()}

    def read(self, table: str, until: int | None = None, doc_ids: Iterable | None = None, among: DataFrame | None = None) -> DataFrame:
        """The rows that count, of all documents, of ``doc_ids`` or of those in ``among`` (doc_id); as after commit ``until``.

        Which segments have such rows is looked up in the ids that they touch: the others aren't read, and only rows of segments
        that later ones void in part are joined with those ids.
        """
        segments = [s for s in self.segments(until) if table in s.tables]
        rows = self._parts(table, segments)
        if rows is None:
            raise FileNotFoundError(f"{self.root} has no {table}")
        if doc_ids is None and (len(segments) > 1 or among is not None):
            return self._live(table, segments, rows, among)
        if doc_ids is not None:
            wanted = list(doc_ids)
            known = self.spark.createDataFrame([(str(x),) for x in wanted], "x string").select(self.bucket(F.col("x")).alias("b")).distinct().collect() if wanted else []
            rows = rows.filter(F.col("bucket").isin([r["b"] for r in known]) & F.col("doc_id").isin(wanted))
        later = self._parts(table, segments[1:], ".touched")
        if later is not None:
            void = later.select(F.col("doc_id").alias("_id"), F.col("_at").alias("_later"))
            rows = rows.join(void, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_later") > F.col("_at")), "left_anti")
        return rows.drop("_at", "bucket")

    def _live(self, table: str, segments: list[Segment], rows: DataFrame, among: DataFrame | None) -> DataFrame:
        """The rows of ``read``, segment by segment; ``rows`` are those of all of them."""
        marks = self._marks(table, segments, among)
        counted = [(s, *marks.get(s.number, (0, 0))) for s in segments]
        whole = [s for s, n, void in counted if n and not void]
        part = [s for s, n, void in counted if 0 < void < n]

        def of(some: list[Segment]) -> DataFrame:
            return self._parts(table, some, like=rows)

        out = of(whole) if whole else rows.filter(F.lit(False))
        if part:
            first = min(s.number for s in part)
            void = self._parts(table, [s for s in segments if s.number > first], ".touched")
            if among is not None:
                void = void.join(among.select("doc_id").distinct(), "doc_id", "left_semi")
            void = void.groupBy(F.col("doc_id").alias("_id")).agg(F.max("_at").alias("_later"))
            left = of(part).join(void, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_later") > F.col("_at")), "left_anti")
            out = out.unionByName(left)
        if among is not None:
            out = out.join(among.select("doc_id").distinct(), "doc_id", "left_semi")
        return out.drop("_at", "bucket")

    def versions(self, table: str) -> DataFrame:
        """(doc_id, version): how many commits since the last merge have touched each document that has rows."""
        segments = self.segments()
        touched = self._parts(table, segments, ".touched")
        counted = touched.groupBy("doc_id").agg(F.countDistinct("_at").cast("int").alias("version"))
        return counted.join(self.read(table).select("doc_id"), "doc_id", "left_semi")

    # -- writing ---------------------------------------------------------------------

    def _write(self, segment: str, table: str, rows: DataFrame, touched: DataFrame) -> None:
        sort = [c for c in self.order.get(table, []) if c in rows.columns]
        # a large bucket is written by several tasks, small ones together by one
        dealt = rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").sortWithinPartitions("bucket", *sort)
        dealt.write.partitionBy("bucket").parquet(f"{self.root}/{table}/segment={segment}")
        if touched is rows:  # what has been written is read, and not made again
            touched = self.spark.read.schema(rows.select("doc_id").schema).parquet(f"{self.root}/{table}/segment={segment}")
        touched.select("doc_id").distinct().write.parquet(f"{self.root}/{table}.touched/segment={segment}")

    def commit(self, tables: dict[str, DataFrame], touched: dict[str, DataFrame] | None = None, batch: str | None = None, base: int | None = None) -> int | None:
        """Add a segment; its number, or None where ``batch`` has been committed before.

        In each table the rows of ``touched`` documents (by default of those that have new rows) give way to the new ones.
        With ``base``, any other commit since that number raises ``Conflict``.
        """
        if batch is not None and batch in self._batches():
            return None
        segment = uuid.uuid4().hex
        for name, rows in tables.items():
            self._write(segment, name, rows, (touched or {}).get(name, rows))
        record = {"segment": segment, "tables": sorted(tables), "batch": batch}
        while True:
            number = self.last() + 1
            if base is not None and number != base + 1:
                self._discard(segment, tables)
                raise Conflict(f"commit {number - 1} has come since {base}")
            if self._put(number, record):
                return number
            if batch is not None and batch in self._batches():
                self._discard(segment, tables)
                return None

    def change(self, make: Callable[[Store], tuple[dict[str, DataFrame], dict[str, DataFrame] | None]], batch: str | None = None, tries: int = 8) -> int | None:
        """Commit what ``make`` makes of the tables as they are; made again where another writer came first."""
        for _ in range(tries):
            if batch is not None and batch in self._batches():
                return None
            base = self.last()
            with contextlib.suppress(Conflict):
                return self.commit(*make(self), batch=batch, base=base)
        raise Conflict(f"{tries} tries, and each time another writer came first")

    def delete(self, doc_ids: DataFrame, tables: Iterable[str]) -> int | None:
        """Void all rows of documents (doc_id) in ``tables``."""
        return self.change(lambda s: ({t: s.read(t).limit(0) for t in tables}, dict.fromkeys(tables, doc_ids)))

    def _discard(self, segment: str, tables: Iterable[str]) -> None:
        for path in (f"{self.root}/{t}{suffix}/segment={segment}" for t in tables for suffix in ("", ".touched")):
            fs, at = self._fs(path)
            fs.delete(at, True)

    def merge(self, vacuum: bool = False) -> int | None:
        """One segment of all that count; None for fewer than two. Commits that come meanwhile stay on top of it.

        ``vacuum`` removes the files of what was replaced, which breaks readers that began before.
        """
        old = self.segments()
        if len(old) < 2:
            return None
        segment, until = uuid.uuid4().hex, self.last()
        names = sorted({t for s in old for t in s.tables})
        for name in names:
            rows = self.read(name, until)
            self._write(segment, name, rows, rows)
        record = {"segment": segment, "tables": names, "batch": None, "replaces": [s.id for s in old], "stands": max(s.number for s in old)}
        while not self._put(number := self.last() + 1, record):
            pass
        if vacuum:
            for s in old:
                self._discard(s.id, s.tables)
        return number
