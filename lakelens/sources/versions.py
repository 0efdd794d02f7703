"""Versioned tables: files that never change, and a manifest that says which of them a version is made of.

A store holds several tables under one version, as an index does whose documents, chunks and
vectors belong together. Rows of a table are dealt to buckets by their key; a change rewrites the
buckets whose rows differ, all others stay as the files they are. A version comes to be by one
rename of its manifest, which fails if another writer was first: readers see all of a version or
nothing of it, at any time, and one that began goes on with the files of its own version.

Keys are to be unique in each table; null keys are allowed, once. What equals the stored row is no change.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakelens.sources.writers import Invalid, check, corpus_violations, index_violations, repeated


class Conflict(RuntimeError):
    """Another writer made the version first."""


@dataclass(frozen=True)
class Table:
    schema: str
    key: str
    parts: dict[int, str]


class Store:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    # ------------------------------------------------------------ manifests

    def versions(self) -> list[int]:
        """All versions, oldest first; files on their way to become one do not count."""
        if not self._fs.exists(self._at("manifests")):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at("manifests"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def manifest(self, version: int | None = None) -> tuple[int, dict[str, Table]]:
        """The number of a version, by default the last one, and its tables; 0 and none before the first."""
        known = self.versions()
        version = known[-1] if version is None and known else version
        if not version:
            return 0, {}
        if version not in known:
            raise Invalid(f"no version {version}")
        stream = self._fs.open(self._at(f"manifests/{version:010d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return version, {name: Table(t["schema"], t["key"], {int(k): v for k, v in t["parts"].items()}) for name, t in json.loads(text).items()}

    def _publish(self, version: int, tables: dict[str, Table]) -> int:
        text = json.dumps({n: {"schema": t.schema, "key": t.key, "parts": t.parts} for n, t in tables.items()})
        own, final = self._at(f"manifests/.{uuid.uuid4().hex}"), self._at(f"manifests/{version:010d}.json")
        out = self._fs.create(own, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE  # never over what is there
        try:
            context.rename(own, final, options)
        except Exception as e:
            self._fs.delete(own, False)
            if version in self.versions():
                raise Conflict(f"version {version} is there already") from e
            raise
        return version

    # ------------------------------------------------------------ tables

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, key: str) -> dict[int, str]:
        """Rows in new files; the folder of each bucket that has some."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket(key)).repartition(self.buckets, "_bucket").sortWithinPartitions("_bucket", key).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at(folder)) if f.isDirectory()]
        return {int(n.split("=")[1]): f"{folder}/{n}" for n in names if n.startswith("_bucket=")}

    def _rows(self, table: Table, buckets: set[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(table.schema))
        folders = [f"{self.path}/{p}" for b, p in sorted(table.parts.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version; later versions do not change it."""
        _, tables = self.manifest(version)
        if name not in tables:
            raise Invalid(f"no table {name}")
        return self._rows(tables[name])

    def write(self, based_on: int | None = None, **tables: tuple[DataFrame, str]) -> int:
        """A new version of whole tables (rows, key); those that are not named stay. `based_on`: the version that it is to follow."""
        last, had = self.manifest(based_on)
        for name, (rows, key) in tables.items():
            check(**{f"repeated key of {name}": repeated(rows, key)})
        made = {name: Table(rows.schema.json(), key, self._write(rows, key)) for name, (rows, key) in tables.items()}
        return self._publish(last + 1, had | made)

    def changes(self, name: str, rows: DataFrame, gone: DataFrame | None = None, whole: bool = False, version: int | None = None) -> DataFrame:
        """The key and `change` ('new', 'changed', 'gone') of rows that differ from the stored; `whole`: what is not in rows is gone."""
        _, tables = self.manifest(version)
        key = tables[name].key
        columns = [c for c in self._rows(tables[name]).columns if c != key]
        state = lambda df, c: df.select(F.col(key).alias("_k"), F.struct(*columns).alias(c), F.lit(True).alias(f"has{c}"))
        old, new = state(self._rows(tables[name]), "_old"), state(rows, "_new").withColumnRenamed("_k", "_n")
        met = old.join(new, F.col("_k").eqNullSafe(F.col("_n")), "full")
        change = F.when(F.col("has_old").isNull(), "new").when(F.col("has_new").isNull(), "gone" if whole else None).when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
        out = met.select(F.when(F.col("has_old").isNull(), F.col("_n")).otherwise(F.col("_k")).alias(key), change.alias("change")).filter("change is not null")
        if gone is None:
            return out
        lost = old.join(gone.select(F.col(key).alias("_g")).distinct(), F.col("_k").eqNullSafe(F.col("_g")), "left_semi").select(F.col("_k").alias(key), F.lit("gone").alias("change"))
        return out.join(lost.select(F.col(key).alias("_l")), F.col(key).eqNullSafe(F.col("_l")), "left_anti").unionByName(lost)

    def merge(self, name: str, rows: DataFrame, gone: DataFrame | None = None, whole: bool = False) -> tuple[int, set[int]]:
        """A new version with rows put in the place of those of their key, and `gone` keys taken out, which win; and the buckets that were rewritten.

        Without a difference the version stays as it is.
        """
        last, tables = self.manifest()
        table = tables[name]
        schema = StructType.fromJson(json.loads(table.schema))
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
        check(**{f"repeated key of {name}": repeated(rows, table.key)})
        differ = self.changes(name, rows, gone, whole, last)
        touched = {r["b"] for r in differ.select(self._bucket(table.key).alias("b")).distinct().collect()}  # `buckets` numbers at most
        if not touched:
            return last, set()
        key, inside = table.key, self._bucket(table.key).isin(sorted(touched))
        same = lambda a, b: a.join(b.select(F.col(key).alias("_k")), F.col(key).eqNullSafe(F.col("_k")), "left_anti")
        kept = same(self._rows(table, touched), differ)
        lost = differ.filter("change = 'gone'")
        put = same(rows.filter(inside), lost).join(differ.filter("change <> 'gone'").select(F.col(key).alias("_k")), F.col(key).eqNullSafe(F.col("_k")), "left_semi")
        parts = {b: p for b, p in table.parts.items() if b not in touched} | self._write(kept.unionByName(put), key)
        return self._publish(last + 1, tables | {name: Table(table.schema, key, parts)}), touched

    def vacuum(self, keep: int = 2) -> int:
        """Takes away the manifests before the last `keep` and the files that no manifest left names; how many folders went.

        Not to run beside a writer, whose files no manifest names yet.
        """
        known = self.versions()
        for v in known[:-keep]:
            self._fs.delete(self._at(f"manifests/{v:010d}.json"), False)
        used = {p for v in known[-keep:] for t in self.manifest(v)[1].values() for p in t.parts.values()}
        went = 0
        if not self._fs.exists(self._at("data")):
            return went
        for folder in self._fs.listStatus(self._at("data")):
            for part in self._fs.listStatus(folder.getPath()):
                name = f"data/{folder.getPath().getName()}/{part.getPath().getName()}"
                if part.isDirectory() and name not in used:
                    went += self._fs.delete(part.getPath(), True)
        return went


def publish_index(store: Store, documents: DataFrame, chunks: DataFrame, facets: DataFrame, vectors: DataFrame) -> int:
    """A search index as one version, checked before anything is written; facets are keyed by document, key and value."""
    check(**index_violations(documents, chunks, vectors))
    named = facets.withColumn("facet_id", F.concat_ws("\x1f", "doc_id", "key", "value"))
    return store.write(documents=(documents, "doc_id"), chunks=(chunks, "chunk_id"), facets=(named, "facet_id"), vectors=(vectors, "chunk_id"))


def publish_corpus(store: Store, papers: DataFrame, citations: DataFrame, works: DataFrame, chunks: DataFrame, named: list[str]) -> int:
    """A corpus as one version, checked likewise; edges are distinct and keyed by both ends."""
    check(**corpus_violations(papers, citations, works, chunks, named))
    edges = citations.distinct().withColumn("edge_id", F.concat_ws("\x1f", "citing_id", "cited_id"))
    return store.write(papers=(papers, "paper_id"), citations=(edges, "edge_id"), works=(works, "work_id"), chunks=(chunks, "chunk_id"))


def refresh_transcripts(store: Store, conversations: DataFrame, most: int = 1500) -> tuple[int, set[int]]:
    """Brings the chunks of a transcript index to what the conversations are now; only buckets with a changed chunk are rewritten."""
    from lakelens.operators.traces import transcript_index

    chunks = transcript_index(conversations, store.spark.createDataFrame([], "chunk_id string, hash string"), most)["todo"]
    if "transcripts" in store.manifest()[1]:
        return store.merge("transcripts", chunks, whole=True)
    return store.write(transcripts=(chunks, "chunk_id")), set(range(store.buckets))
