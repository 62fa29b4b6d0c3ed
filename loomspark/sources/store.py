"""The index as Parquet tables: files, chunks, chunksets, embeddings, and what searches read: postings, lengths, stems.

Rows are kept in buckets by file, as many as the first change asks for and
`rebucket` sets later.  A change writes new folders for the buckets it touches
and then a manifest with the next number, which names the folder of every
bucket.  Readers take the manifest of the highest number, so they see the
state before or after a change; a change that loses its number to another one
raises, and nothing is written where something is read.
"""

from __future__ import annotations

import json
import re
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.functions import terms
from loomspark.operators import keyword

#: Rows of chunks a bucket should hold when an index is begun.
BUCKET_ROWS = 100_000
TABLES = {
    "files": "file_path string, char_offset bigint, content_hash string, mtime double",
    "chunks": "file_path string, local_index int, content string, depth int, parent_local_index int, ancestors array<int>, batch_id int",
    "chunksets": "file_path string, local_index int, chunk_ids array<int>, contents string, to_embed string",
    "embeddings": "file_path string, local_index int, embedding array<float>",
    "postings": "term string, file_path string, local_index int, tf int, dl int",
    "lengths": "file_path string, local_index int, n_terms int",
    "chunk_stems": "file_path string, local_index int, stems array<string>",
    "chunkset_stems": "file_path string, local_index int, stems array<string>",
}
#: Keys of tables; rows of a bucket are sorted by them, so the terms of postings prune row groups.
KEYS = {"files": ["file_path"], "postings": ["term", "file_path", "local_index"]}
_KEY = ["file_path", "local_index"]
_CHECKED = ("files", "chunks", "chunksets", "embeddings")
_BUCKETS = "_buckets"
_NUMBERED = re.compile(r"manifest-(\d+)\.json$")


def bucket(file_path: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(file_path), F.lit(buckets)).cast("int")


def search_tables(chunks: DataFrame, chunksets: DataFrame) -> dict[str, DataFrame]:
    """What searches read about these rows: postings and lengths of groups, stems of groups and chunks."""
    return {
        "postings": keyword.postings(chunksets, _KEY),
        "lengths": chunksets.select(*_KEY, F.coalesce(F.size(terms.terms("contents")), F.lit(0)).alias("n_terms")),
        "chunk_stems": chunks.select(*_KEY, terms.stemmed("content").alias("stems")),
        "chunkset_stems": chunksets.select(*_KEY, terms.stemmed("contents").alias("stems")),
    }


class DuplicateKey(ValueError):
    pass


class Store:
    """Opens the index in a folder; the folder comes into being with the first change."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, str(root).rstrip("/")

    # --- files of the file system ------------------------------------------

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        path, fs = self._path("")
        found = [_NUMBERED.search(x.getPath().getName()) for x in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(m[1]) for m in found if m)

    def exists(self) -> bool:
        return bool(self._manifests())

    def manifest(self) -> dict[str, dict[str, str]]:
        return self._newest()[1]

    def _newest(self) -> tuple[int, dict]:
        numbers = self._manifests()
        if not numbers:
            return 0, {}
        path, fs = self._path(f"manifest-{numbers[-1]:09d}.json")
        stream = fs.open(path)
        try:
            return numbers[-1], json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, number: int, manifest: dict) -> None:
        """Writes the manifest after the one of that number; until it has its name, readers see the old one."""
        new, fs = self._path(f"new-{uuid.uuid4().hex}")
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        final, _ = self._path(f"manifest-{number + 1:09d}.json")
        if fs.exists(final) or not fs.rename(new, final):
            fs.delete(new, False)
            raise OSError("another change was published meanwhile")
        # the one before stays for readers that have just listed it
        for old in self._manifests()[:-2]:
            fs.delete(self._path(f"manifest-{old:09d}.json")[0], False)

    @staticmethod
    def _begin(manifest: dict, rows: DataFrame) -> None:
        """The number of buckets of a new index, by what it begins with: a power of two."""
        manifest[_BUCKETS] = {"n": str(1 << (rows.count() // BUCKET_ROWS).bit_length())}

    @staticmethod
    def _count(manifest: dict) -> int:
        return int(manifest.get(_BUCKETS, {}).get("n", 1))

    # --- tables --------------------------------------------------------------

    def read(self, table: str, buckets: set[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """A table, or the named buckets of it; rows written before a column existed have null there, an empty text for to_embed."""
        entry = (self.manifest() if manifest is None else manifest).get(table, {})
        folders = [p for b, p in entry.items() if buckets is None or int(b) in buckets]
        if not folders:
            return self.spark.createDataFrame([], TABLES[table])
        df = self.spark.read.schema(TABLES[table]).parquet(*(f"{self.root}/{p}" for p in folders))
        return df.fillna("", ["to_embed"]) if table == "chunksets" else df

    def replace(self, files: DataFrame, new: dict[str, DataFrame]) -> None:
        """In one step: rows of these files (file_path) go from the given tables and the new rows come in."""
        number, manifest = self._newest()
        if not manifest and new:
            self._begin(manifest, new.get("chunks", next(iter(new.values()))))
        n = self._count(manifest)
        touched = files.select("file_path").distinct()
        keys, names = None, touched
        # what searches read has the keys of the rows it was made from
        for table, rows in ((t, r) for t, r in new.items() if t in _CHECKED):
            one = rows.select(F.lit(table).alias("table"), "file_path", (F.col("local_index") if table != "files" else F.lit(0)).cast("int").alias("local_index"))
            keys, names = one if keys is None else keys.unionByName(one), names.unionByName(rows.select("file_path"))
        twice = None if keys is None else keys.groupBy(*keys.columns).count().where("count > 1").first()
        if twice is not None:
            raise DuplicateKey(f"{twice['table']}: a key occurs twice")
        # numbers of buckets, of which there are few
        numbers = {r[0] for r in names.select(bucket("file_path", n)).distinct().collect()}
        published = {k: dict(v) for k, v in manifest.items()}

        def write(table: str) -> None:
            kept = self.read(table, numbers, manifest).join(touched, "file_path", "left_anti")
            self._write(published, table, kept.unionByName(new[table].select(*kept.columns)), numbers)

        # tables are written side by side, as each is a small job where a change is small
        with ThreadPoolExecutor(4) as pool:
            for table in [pool.submit(inheritable_thread_target(self.spark)(write), t) for t in new]:
                table.result()
        self._publish(number, published)

    def append(self, table: str, rows: DataFrame) -> None:
        """Adds rows; a key that is there already raises."""
        self.merge(table, rows, update=False)

    def merge(self, table: str, rows: DataFrame, update: bool = True) -> None:
        """Adds rows, or puts them in the place of those with the same key."""
        key = KEYS.get(table, _KEY)
        number, manifest = self._newest()
        if not manifest:
            self._begin(manifest, rows)
        numbers = {r[0] for r in rows.select(bucket("file_path", self._count(manifest))).distinct().collect()}
        old = self.read(table, numbers, manifest)
        if not rows.groupBy(*key).count().where("count > 1").isEmpty() or (not update and not old.join(rows.select(*key), key, "left_semi").isEmpty()):
            raise DuplicateKey(f"{table}: a key occurs twice")
        published = {k: dict(v) for k, v in manifest.items()}
        self._write(published, table, old.join(rows.select(*key), key, "left_anti").unionByName(rows.select(*old.columns)), numbers)
        self._publish(number, published)

    def rebucket(self, buckets: int) -> None:
        """Writes all tables again in another number of buckets, in one step."""
        number, manifest = self._newest()
        published: dict = {_BUCKETS: {"n": str(buckets)}}
        for table in manifest:
            if table != _BUCKETS:
                self._write(published, table, self.read(table, None, manifest), set(range(buckets)))
        self._publish(number, published)

    def _write(self, manifest: dict, table: str, rows: DataFrame, numbers: set[int]) -> None:
        folder = f"data/{table}/{uuid.uuid4().hex}"
        n = self._count(manifest)
        kinds = T._parse_datatype_string(TABLES[table])
        rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in kinds))
        rows.withColumn("bucket", bucket("file_path", n)).repartition("bucket").sortWithinPartitions("bucket", *KEYS.get(table, _KEY)).write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        entry = manifest.setdefault(table, {})
        path, fs = self._path(folder)
        written = {x.getPath().getName() for x in fs.listStatus(path)}
        for b in numbers:
            if f"bucket={b}" in written:
                entry[str(b)] = f"{folder}/bucket={b}"
            else:
                entry.pop(str(b), None)

    def vacuum(self) -> None:
        """Deletes folders that the manifest no longer names."""
        named = {p.rsplit("/", 1)[0] for table, entry in self.manifest().items() if table != _BUCKETS for p in entry.values()}
        for table in TABLES:
            path, fs = self._path(f"data/{table}")
            for s in fs.listStatus(path) if fs.exists(path) else []:
                if f"data/{table}/{s.getPath().getName()}" not in named:
                    fs.delete(s.getPath(), True)

    # --- lookups ---------------------------------------------------------------

    def _number(self, file_path: str) -> set[int]:
        return {self.spark.range(1).select(bucket(F.lit(file_path), self._count(self.manifest()))).first()[0]}

    def file_record(self, file_path: str):
        return self.read("files", self._number(file_path)).where(F.col("file_path") == file_path).first()

    def chunks_of(self, file_path: str) -> DataFrame:
        return self.read("chunks", self._number(file_path)).where(F.col("file_path") == file_path).orderBy("local_index")

    @staticmethod
    def max_local_indexes(chunks: DataFrame) -> DataFrame:
        """(file_path, max_local_index) of each file that has chunks."""
        return chunks.groupBy("file_path").agg(F.max("local_index").cast("int").alias("max_local_index"))

    @staticmethod
    def last_headings(chunks: DataFrame) -> DataFrame:
        """(file_path, local_index, content, depth) of the last chunk of depth 0 or 1 of each file, whatever kind of text it is."""
        last = F.max_by(F.struct("local_index", "content", "depth"), "local_index").alias("r")
        return chunks.where("depth <= 1").groupBy("file_path").agg(last).select("file_path", "r.*")

    def max_local_index(self, file_path: str) -> int:
        row = self.max_local_indexes(self.chunks_of(file_path)).first()
        return -1 if row is None else row["max_local_index"]

    def last_heading(self, file_path: str):
        return self.last_headings(self.chunks_of(file_path)).first()

    # --- searches --------------------------------------------------------------

    def keyword_index(self) -> tuple[DataFrame, keyword.Statistics] | None:
        """Postings and statistics, where they are kept."""
        manifest = self.manifest()
        if "lengths" not in manifest:
            return None
        return self.read("postings", None, manifest), keyword.statistics_of(self.read("lengths", None, manifest))

    def match_chunksets(self, query: str, limit: int = 20) -> DataFrame:
        """Groups that match a boolean query (see keyword.match), best first."""
        return self._match("chunkset_stems", "chunksets", query, limit)

    def match_chunks(self, query: str, limit: int = 50) -> DataFrame:
        return self._match("chunk_stems", "chunks", query, limit)

    def _match(self, stems: str, table: str, query: str, limit: int) -> DataFrame:
        manifest = self.manifest()
        found = keyword.match(self.read(stems, None, manifest), query, _KEY, limit=limit, stems="stems").drop("stems")
        return self.read(table, None, manifest).join(F.broadcast(found), _KEY).orderBy("rank", *_KEY)

    def all_chunksets(self) -> DataFrame:
        return self.read("chunksets").orderBy("file_path", "local_index")

    def delete(self, files: DataFrame) -> None:
        """Removes all rows of the files."""
        manifest = self.manifest()
        self.replace(files, {t: self.spark.createDataFrame([], s) for t, s in TABLES.items() if t in manifest})

    def with_embeddings(self) -> DataFrame:
        return self.read("chunksets").join(self.read("embeddings"), ["file_path", "local_index"], "left")

    def counts(self) -> DataFrame:
        """One row: number of files, chunks, chunksets and vectors."""
        one = None
        for name, table in (("files", "files"), ("total_chunks", "chunks"), ("total_chunksets", "chunksets"), ("embedded_chunksets", "embeddings")):
            n = self.read(table).agg(F.count("embedding" if table == "embeddings" else "*").alias(name))
            one = n if one is None else one.crossJoin(n)
        return one

    def status(self) -> dict:
        files = [r[0] for r in self.read("files").select("file_path").orderBy("file_path").collect()]
        n = self.counts().first()
        return {"files": files, "total_chunks": n["total_chunks"], "total_chunksets": n["total_chunksets"], "has_embeddings": False, "embedded_chunksets": n["embedded_chunksets"]}
