"""A corpus in stored tables that change together: documents, chunks, vectors and the keyword index.

    <path>/{documents,chunks,vectors}    keyed tables by document_id
    <path>/keywords                       the stored keyword index
    <path>/heads/<number>.json            which version of each belongs to the corpus, and marks of writers

A change merges into each table and then puts the next head in place. Readers open the newest head, so they never see a document
without its chunks; a change that breaks off is in no head, and the next one builds on the head, not on what was left.
A writer's step with a mark is taken once, however often it is repeated.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators.keyword_index import KeywordIndex
from ..operators.providers import Providers
from ..sources import files
from ..sources.keyed import Folder, KeyedTable
from ..sources.tables import Temporary, written
from . import ingest
from .answer import Corpus

_DOCUMENTS = "document_id string, workspace_id string, source_type string, title string, url string, file_type string, content_sha string, length long, modified timestamp"
_CHUNKS = "document_id string, chunk_id string, chunk_index int, title string, section_title string, text string, parent_text string, parent_chunk_id string"
_VECTORS = "document_id string, chunk_id string, vec array<double>"
_RESULTS = "document_id string, status string, error_stage string, error_reason string, n_chunks long"


class Library:
    def __init__(self, spark: SparkSession, path: str, cfg: Config = Config(), models: Providers = Providers(), buckets: int = 64, save=written):
        """Opens the library at path, or makes an empty one."""
        self.spark, self.path, self.cfg, self.models, self.save = spark, path.rstrip("/"), cfg, models, save
        self.folder, self.buckets = Folder(spark, self.path), buckets
        self.tables = {n: KeyedTable(spark, f"{self.path}/{n}", "document_id", s, buckets) for n, s in (("documents", _DOCUMENTS), ("chunks", _CHUNKS), ("vectors", _VECTORS))}

    # --- heads ---

    def _numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.folder.names("heads")]

    def head(self) -> dict:
        """number; versions of documents, chunks, vectors and keywords; marks."""
        n = max(self._numbers(), default=0)
        zero = {"number": 0, "versions": dict.fromkeys([*self.tables, "keywords"], 0), "marks": {}}
        return json.loads(self.folder.read(f"heads/{n:012d}.json")) if n else zero

    def _keywords(self, head: dict) -> KeywordIndex:
        return KeywordIndex(self.spark, f"{self.path}/keywords", self.buckets, save=self.save, number=head["versions"]["keywords"])

    def read(self, table: str) -> DataFrame:
        return self.tables[table].read(number=self.head()["versions"][table])

    def corpus(self) -> Corpus:
        """What answers are found in."""
        head = self.head()
        at = lambda n: self.tables[n].read(number=head["versions"][n])
        chunks = at("chunks").select("document_id", F.col("document_id").alias("source_id"), "chunk_id", "chunk_index", "title", "section_title", "text")
        return Corpus(chunks, at("vectors"), self._keywords(head) if head["versions"]["keywords"] else None)

    # --- changes ---

    def change(self, docs: DataFrame | None = None, gone: DataFrame | None = None, mark: tuple[str, int] | None = None) -> DataFrame:
        """docs (document_id, text, file_type, ...) take the place of their old forms, the documents of ``gone`` go with all that hangs on them.

        The results, as of plans.ingest: one for each of docs. A document that fails leaves its old form as it is. A step that was taken before has no results.
        """
        head = self.head()
        if mark and head["marks"].get(mark[0], -1) >= mark[1]:
            return self.spark.createDataFrame([], _RESULTS)
        versions = dict(head["versions"])
        temp, results, rows = Temporary(self.save), None, {"documents": None, "chunks": None, "vectors": None}
        try:
            if docs is not None:
                made, results = ingest.ingest(temp(docs), None, self.cfg, save=temp, models=self.models)
                results = self.save(results)
                ok = results.where("status = 'ok'").select("document_id").distinct()
                # chunks and vectors are those of documents that went well, and chunks are saved already
                rows = {"documents": temp(self._fitted(made.documents, self.tables["documents"]).join(ok, "document_id", "left_semi")), "chunks": made.chunks, "vectors": temp(self._fitted(made.vectors, self.tables["vectors"]))}
                temp.drop(*rows.values())
            index = self._keywords(head)
            for n, t in self.tables.items():
                if rows[n] is not None or gone is not None:
                    versions[n] = t.merge(self._fitted(rows[n], t) if rows[n] is not None else None, gone, base=versions[n]).version
            temp.drop(rows["chunks"])
            if rows["chunks"] is not None or gone is not None:
                index.replace(rows["chunks"], gone)
        finally:
            temp.drop()
        versions["keywords"] = index.number
        self._commit(head, versions, mark)
        return results if results is not None else self.spark.createDataFrame([], _RESULTS)

    def _fitted(self, rows: DataFrame, table: KeyedTable) -> DataFrame:
        return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema))

    def _commit(self, head: dict, versions: dict[str, int], mark: tuple[str, int] | None) -> None:
        number = head["number"] + 1
        self.folder.put(f"heads/{number:012d}.json", json.dumps({"number": number, "versions": versions, "marks": head["marks"] | ({mark[0]: mark[1]} if mark else {})}))

    def delete(self, ids: DataFrame) -> int:
        """Without these documents (document_id) and their chunks and vectors; how many documents there were."""
        n = self.read("documents").join(ids.select("document_id").distinct(), "document_id", "left_semi").count()
        self.change(gone=ids)
        return n

    def reindex(self, ids: DataFrame | None = None) -> int:
        """Makes the vectors of all documents, or of some, again from the stored chunks; how many."""
        head = self.head()
        chunks = self.tables["chunks"].read(number=head["versions"]["chunks"])
        some = chunks if ids is None else chunks.join(ids.select("document_id").distinct(), "document_id", "left_semi")
        temp = Temporary(self.save)
        fresh = temp(ingest.embedded(some, models=self.models))
        done = self.tables["vectors"].merge(fresh, base=head["versions"]["vectors"])
        self._commit(head, head["versions"] | {"vectors": done.version}, None)
        n = fresh.count()
        temp.drop()
        return n

    def vacuum(self) -> int:
        """Deletes what the newest head doesn't name; how many files."""
        head = self.head()
        for n in self._numbers():
            if n != head["number"]:
                self.folder.delete(f"{self.path}/heads/{n:012d}.json")
        return sum(t.vacuum([head["versions"][n]]) for n, t in self.tables.items()) + (self._keywords(head).vacuum() if head["versions"]["keywords"] else 0)

    # --- folders ---

    def sync(self, root: str, extensions: list[str] | None = None, workspace_id: str = "default", mark: tuple[str, int] | None = None) -> dict[str, int]:
        """Makes the library hold the files below root: new and changed ones are ingested, vanished ones deleted with all that hangs on them.

        A file whose size and time are those of its stored form is not read; one whose content is the same is not ingested. Files that failed are tried again. Counts of read, ingested, failed and deleted files.
        """
        there = self.save(files.listing(self.spark, root, extensions).withColumn("document_id", files.source_id(F.col("path"))))
        known = self.read("documents").select("document_id", "url", "content_sha", F.col("length").alias("~l"), F.col("modified").alias("~m"))
        touched = there.join(known, "document_id", "left").where(~(F.col("length").eqNullSafe(F.col("~l")) & F.col("modified").eqNullSafe(F.col("~m"))))
        paths = self.save(touched.select("path", "document_id", "length", "modified", "content_sha"))
        read = files.read_folder(self.spark, root, extensions).join(paths, "path") if paths.limit(1).count() else None
        counts = {"read": paths.count(), "ingested": 0, "failed": 0, "deleted": 0}
        here = F.startswith(F.col("url"), F.lit(_folder_of(self.spark, root)))
        gone = self.save(known.where(here).join(there, "document_id", "left_anti").select("document_id"))
        counts["deleted"] = gone.count()
        docs = None
        if read is not None:
            hashed = read.withColumn("sha", F.sha2("content", 256)).where(~F.col("sha").eqNullSafe(F.col("content_sha")))
            docs = self.save(_documents(hashed, paths, workspace_id))
        if docs is not None and docs.limit(1).count():
            status = {r.status: r.n for r in self.change(docs.where("text is not null").drop("error_stage"), gone, mark).groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
            counts["ingested"], counts["failed"] = status.get("ok", 0), sum(n for s, n in status.items() if s != "ok") + docs.where("text is null").count()
        elif counts["deleted"] or mark:
            self.change(gone=gone, mark=mark)
        return counts


def _documents(hashed: DataFrame, paths: DataFrame, workspace_id: str) -> DataFrame:
    """Extracted files with what the table of documents holds of them; text is null where extraction failed."""
    found = files.extract(hashed.select("path", "content")).select("path", "file_type", "text", "error_stage")
    more = hashed.select("path", "document_id", "length", "modified", F.col("sha").alias("content_sha"))
    return found.join(more, "path").select("document_id", F.lit(workspace_id).alias("workspace_id"), F.lit("documents").alias("source_type"), F.regexp_extract("path", r"([^/]+)$", 1).alias("title"), F.col("path").alias("url"), "file_type", "content_sha", "length", "modified", "text", "error_stage")


def _folder_of(spark: SparkSession, root: str) -> str:
    """root as Spark writes it in paths, with a slash at the end."""
    f = Folder(spark, root)
    return f.fs.makeQualified(f.at("")).toString().rstrip("/") + "/"
