"""The content-addressed store: objects by the digest of their text, an index of cells for each document.

A store is two tables, ``objects`` (name, content) and ``store_index`` (doc_id, cell_id, name).
Objects are written before the index, so that a writer that dies leaves objects without
a reader (collected later), never a cell without its object.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cells import MAX_IDS, cell_id, content_name, handle
from ..functions.cost import TokenModel, csv_cost, proxy
from ..sources.tables import drop, durable

#: Tokens that moving a cell must save, and the version of a bundle: fixed values of the format.
LEAST_SAVING, BUNDLE_VERSION = 20, 1
#: Cell ids in a part of a bundle.
BUNDLE_CELLS = 256
OBJECTS, INDEX = "name string, content string", "doc_id string, cell_id string, name string"


def priced(encoded: DataFrame, tokens: TokenModel = proxy, least: int = LEAST_SAVING) -> DataFrame:
    """(doc_id, row, col, place, size, whole, name): what each cell costs bare and as a CSV field, and the name of
    its content if a handle (with an id of full width) saves enough; no texts."""
    own = encoded.select("doc_id", "row", "col", "place", "cell", tokens(F.col("cell")).alias("size"), csv_cost(F.col("cell"), tokens).alias("whole"))
    gain = F.col("whole") - csv_cost(handle(F.lit("0001"), F.col("size")), tokens)
    return own.select("doc_id", "row", "col", "place", "size", "whole", F.when(gain >= least, content_name(F.col("cell"))).alias("name"))


def moved_out(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(moved: doc_id, row, col, cell_id, handle, name, size; overfull: doc_id) of priced cells.

    The cells that go are numbered in page order.  A document that would store more cells than there are ids
    stores none; so no task sorts more cells of a document than there are ids.
    """
    gone = cells.filter("name is not null")
    counts = gone.groupBy("doc_id").agg(F.count("*").alias("n_gone")).select(F.col("doc_id").alias("of"), "n_gone")
    page = W.partitionBy("doc_id").orderBy("row", "place")
    fits = gone.join(counts.filter(F.col("n_gone") < MAX_IDS), F.col("doc_id") == F.col("of")).withColumn("cell_id", cell_id(F.row_number().over(page)))
    moved = fits.select("doc_id", "row", "col", "cell_id", handle(F.col("cell_id"), F.col("size")).alias("handle"), "name", "size")
    return moved, counts.filter(F.col("n_gone") >= MAX_IDS).select(F.col("of").alias("doc_id"))


def stashed(encoded: DataFrame, tokens: TokenModel = proxy, least: int = LEAST_SAVING) -> DataFrame:
    """Cells with ``cell_id``, ``handle`` and ``name`` where moving them out saves enough, and ``overfull`` in documents
    that would store more cells than there are ids."""
    moved, full = moved_out(durable(priced(encoded, tokens, least)))
    marked = full.withColumn("overfull", F.lit(True))
    return encoded.join(moved.drop("size"), ["doc_id", "row", "col"], "left").join(marked, "doc_id", "left").withColumn("overfull", F.coalesce("overfull", F.lit(False)))


def document_ids(moved: DataFrame, compact: DataFrame) -> DataFrame:
    """(doc_id, document_id): digest of the payload and of what was moved out of it."""
    listed = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "cell_id", "name"))), chr(0))
    joined = moved.filter("cell_id is not null").groupBy("doc_id").agg(listed.alias("moved")).join(compact, "doc_id")
    return joined.select("doc_id", content_name(F.concat_ws(chr(0), "compact", "moved")).alias("document_id"))


def resolve(index: DataFrame, objects: DataFrame) -> DataFrame:
    """Every cell of an index: (doc_id, cell_id, name, content, problem); the content is null where it is
    missing or has changed, and the problem says so."""
    found = index.join(objects, "name", "left")
    problem = F.when(F.col("content").isNull(), "missing").when(content_name(F.col("content")) != F.col("name"), "content changed")
    return found.select("doc_id", "cell_id", "name", F.when(problem.isNull(), F.col("content")).alias("content"), problem.alias("problem"))


def missing(index: DataFrame, objects: DataFrame) -> DataFrame:
    """Cells whose object is not there."""
    return index.join(objects.select("name"), "name", "left_anti").select("doc_id", "cell_id", "name")


def orphaned(index: DataFrame, used: DataFrame) -> DataFrame:
    """Index entries that no handle of the document uses; used: (doc_id, cell_id)."""
    return index.join(used, ["doc_id", "cell_id"], "left_anti").select("doc_id", "cell_id", "name")


def broken(index: DataFrame, objects: DataFrame) -> DataFrame:
    """(doc_id, cell_id, name, problem): cells that cannot be read back."""
    problem = F.when(F.col("content").isNull(), "missing").when(content_name(F.col("content")) != F.col("name"), "content changed")
    return index.join(objects, "name", "left").select("doc_id", "cell_id", "name", problem.alias("problem")).filter("problem is not null")


def reachable(index: DataFrame) -> DataFrame:
    """The names that any document's index holds."""
    return index.select("name").distinct()


def leaked(index: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects that no index holds."""
    return objects.join(reachable(index), "name", "left_anti")


def kept(index: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects that a collection leaves."""
    return objects.join(reachable(index), "name", "left_semi")


def new_objects(moved: DataFrame, objects: DataFrame) -> DataFrame:
    """(name, content) of moved cells that the store does not hold yet, each once."""
    found = moved.filter("cell_id is not null").select("name", F.col("cell").alias("content")).dropDuplicates(["name"])
    return found.join(objects.select("name"), "name", "left_anti")


def collisions(moved: DataFrame, objects: DataFrame) -> DataFrame:
    """Moved cells whose name the store holds with another content."""
    held = objects.select("name", F.col("content").alias("held"))
    return moved.filter("cell_id is not null").join(held, "name").filter("held <> cell").select("doc_id", "cell_id", "name")


def bundles(index: DataFrame, objects: DataFrame, block: int = BUNDLE_CELLS) -> DataFrame:
    """(doc_id, part, bundle): each document's index and objects as JSON texts of at most ``block`` ids in a row.

    Every part has the objects that its cells need, so it can be taken in by itself.  A part with a cell that cannot be
    read back is null.
    """
    own = resolve(index, objects).withColumn("part", F.floor(F.col("cell_id").cast("long") / block))
    ids = F.map_from_entries(F.array_sort(F.collect_list(F.struct("cell_id", "name"))))
    texts = F.map_from_entries(F.array_sort(F.collect_set(F.struct("name", "content"))))
    text = F.to_json(F.struct(F.lit(BUNDLE_VERSION).alias("sparktab_bundle"), F.col("doc_id"), F.col("ids").alias("index"), F.col("texts").alias("objects")))
    listed = own.groupBy("doc_id", "part").agg(ids.alias("ids"), texts.alias("texts"), F.count("problem").alias("n_bad"))
    return listed.select("doc_id", "part", F.when(F.col("n_bad") == 0, text).alias("bundle"))


def unbundled(bundles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bundles (bundle string) as (index, objects, refused: doc_id, problem).

    A bundle is refused whole if its version is unknown, an object is missing, or one does not hash to its name.
    """
    bundles = bundles.filter("bundle is not null")
    kind = "struct<sparktab_bundle: int, doc_id: string, index: map<string,string>, objects: map<string,string>>"
    read = bundles.select(F.from_json("bundle", kind).alias("b")).select("b.*")
    lacking = F.exists(F.map_values("index"), lambda n: ~F.coalesce(F.map_contains_key(F.col("objects"), n), F.lit(False)))
    changed = F.exists(F.map_entries("objects"), lambda e: content_name(e["value"]) != e["key"])
    problem = F.when(F.coalesce("sparktab_bundle", F.lit(0)) != BUNDLE_VERSION, "not a bundle").when(lacking, "incomplete").when(changed, "corrupt")
    judged = read.withColumn("problem", problem)
    good = judged.filter("problem is null")
    index = good.select("doc_id", F.explode("index").alias("cell_id", "name"))
    objects = good.select(F.explode("objects").alias("name", "content")).dropDuplicates(["name"])
    return index, objects, judged.filter("problem is not null").select("doc_id", "problem")


@dataclass
class Store:
    """A store as Parquet tables under one path.

    A table is a folder with a generation in its name; readers take the latest one that was written to its end.  What
    rewrites a table writes the next generation and then removes the older ones, so a writer lost midway
    loses nothing.
    """

    spark: SparkSession
    path: str

    def _place(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _generations(self, table: str) -> list[int]:
        place, fs = self._place(f"{table}.*")
        found = [s.getPath() for s in fs.globStatus(place) or ()]
        return sorted(int(p.getName().rsplit(".", 1)[1]) for p in found if fs.exists(self._place(f"{p.getName()}/_SUCCESS")[0]))

    def _read(self, table: str, schema: str) -> DataFrame:
        known = self._generations(table)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}.{known[-1]}") if known else self.spark.createDataFrame([], schema)

    def _append(self, rows: DataFrame, table: str) -> None:
        # Rows depend on the table itself, so they are computed before it is written to.
        rows = durable(rows)
        if not rows.isEmpty():
            rows.write.mode("append").parquet(f"{self.path}/{table}.{max([0, *self._generations(table)])}")
        drop(rows)

    def _rewrite(self, rows: DataFrame, table: str) -> None:
        known = self._generations(table)
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}.{max([0, *known]) + 1}")
        for n in known:
            place, fs = self._place(f"{table}.{n}")
            fs.delete(place, True)

    @property
    def objects(self) -> DataFrame:
        return self._read("objects", OBJECTS)

    @property
    def index(self) -> DataFrame:
        return self._read("store_index", INDEX)

    def documents(self) -> DataFrame:
        """The ids of all documents, in order."""
        return self.index.select("doc_id").distinct().orderBy("doc_id")

    def names(self) -> DataFrame:
        """The names of all objects, in order."""
        return self.objects.select("name").orderBy("name")

    def has_document(self, doc_id: str) -> bool:
        return not self.index.filter(F.col("doc_id") == doc_id).isEmpty()

    def has_object(self, name: str) -> bool:
        return not self.objects.filter(F.col("name") == name).isEmpty()

    def commit(self, moved: DataFrame, ids: DataFrame) -> None:
        """Write what documents moved out: objects first, then the index.  Committing again changes nothing."""
        if not collisions(moved, self.objects).isEmpty():
            raise ValueError("the store holds another content under the name of a new one")
        self._append(new_objects(moved, self.objects), "objects")
        entries = moved.filter("cell_id is not null").join(ids, "doc_id").select(F.col("document_id").alias("doc_id"), "cell_id", "name").distinct()
        self._append(entries.join(self.index, ["doc_id", "cell_id"], "left_anti"), "store_index")

    def import_bundles(self, texts: DataFrame) -> DataFrame:
        """Add bundles; returns those refused."""
        index, objects, refused = unbundled(texts)
        self._append(objects.join(self.objects, "name", "left_anti"), "objects")
        self._append(index.join(self.index, ["doc_id", "cell_id"], "left_anti"), "store_index")
        return refused

    def delete(self, *names: str) -> None:
        """Remove objects, whether documents reach them or not."""
        self._rewrite(self.objects.filter(~F.col("name").isin(*names)), "objects")

    def collect(self, delete: bool = False) -> int:
        """How many objects no document reaches; with ``delete`` they go."""
        n = leaked(self.index, self.objects).count()
        if delete and n:
            self._rewrite(kept(self.index, self.objects), "objects")
        return n
