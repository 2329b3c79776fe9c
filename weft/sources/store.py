"""The search store: versions of tables, written by ingest and read by search.

A store's folder holds one folder per version and one manifest per published version:

    versions/<version>/<table>     Parquet, never changed once published
    manifests/<number>.json        {"version": ..., "tables": [...]}

The manifest of the greatest number is the store. It is written after all tables, to a
name aside, and then renamed to the next free number; where another writer took that number
first, publishing fails (on file systems whose rename replaces files, two writers in the very
same moment are not told apart). So readers see the old store or the new one, whole; a run that
dies half way leaves the old one; and a rebuild may read the very store it replaces.
A folder without manifests may hold tables directly, as ``write_table`` leaves them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from weft.operators.reduction import components_from, reduce_rows
from weft.session import dropped_shuffles

TABLES = ("catalog", "variants", "chunks", "vocabulary", "components")
CHUNK_SCHEMA = (
    "chunk_id string, product_id string, chunk_index int, total_chunks int, "
    "chunk_type string, text string, ids array<int>, weights array<double>"
)
# Of chunks whose vectors are made as they are read: their term rows, and one row of each id.
TERM_COLUMNS = ("ids", "weights", "first")


@dataclass(frozen=True)
class Store:
    """Tables of one catalog. No vocabulary means: search by attributes only.

    ``chunks`` carry sparse term rows (``ids``, ``weights``) or dense vectors
    (``vector``): reduced by ``components``, or raw ones where that has no rows.
    Reduced ones are made as they are read, many times smaller on disk: ``rows`` are the
    chunks as they are stored, with their term rows, and ``vectors`` (chunk_id, vector) alone,
    and ``reduction`` the components in every task.
    Dense vectors without a vocabulary were given by the caller; a search of such a
    store needs vectors of its texts from the same model.
    """

    catalog: DataFrame
    variants: DataFrame
    chunks: DataFrame
    vocabulary: DataFrame | None = None
    components: DataFrame | None = None
    name: str = "product_chunks"
    rows: DataFrame | None = None
    vectors: DataFrame | None = None
    reduction: Broadcast | None = None

    @property
    def texts(self) -> DataFrame:
        """The chunks, to be read without their vectors."""
        return self.chunks if self.rows is None else self.rows

    @property
    def has_vectors(self) -> bool:
        return self.vocabulary is not None or self.given

    @property
    def given(self) -> bool:
        return self.vocabulary is None and self.dense

    @property
    def dense(self) -> bool:
        return "vector" in self.chunks.columns


def write_table(df: DataFrame, folder: str, name: str) -> None:
    """Replace one table of the store."""
    with dropped_shuffles(df.sparkSession):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def hadoop_path(spark: SparkSession, path: str):
    """A path and the file system that holds it, on whatever store the cluster uses."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark._jsc.hadoopConfiguration())


def manifests(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the published versions, oldest first."""
    path, files = hadoop_path(spark, f"{folder}/manifests")
    if not files.exists(path):
        return []
    names = [f.getPath().getName() for f in files.listStatus(path)]
    return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json") and not n.startswith("_"))


def read_manifest(spark: SparkSession, folder: str, number: int) -> dict:
    path, files = hadoop_path(spark, f"{folder}/manifests/{number:08d}.json")
    stream = files.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


class StoreWriter:
    """Writes the tables of a new version; nothing of it shows before ``publish``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.version = uuid.uuid4().hex
        self.tables: list[str] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write one table and read it back. Names outside ``TABLES`` are steps on the way."""
        path = f"{self.folder}/versions/{self.version}"
        write_table(df, path, name)
        if name in TABLES:
            self.tables.append(name)
        return self.spark.read.parquet(f"{path}/{name}")

    def publish(self, keep: int = 2) -> int:
        """Make the version the store; versions before the last ``keep`` are removed.

        Readers of the version before go on with its files, so ``keep`` must be at least 2
        where searches run meanwhile. Raises where another writer published first.
        """
        if keep < 1:
            raise ValueError("need keep >= 1")
        numbers = manifests(self.spark, self.folder)
        number = numbers[-1] + 1 if numbers else 1
        body = json.dumps({"version": self.version, "tables": sorted(self.tables)})
        aside, files = hadoop_path(self.spark, f"{self.folder}/manifests/_{self.version}")
        final, _ = hadoop_path(self.spark, f"{self.folder}/manifests/{number:08d}.json")
        stream = files.create(aside, False)
        stream.write(bytearray(body.encode()))
        stream.close()
        if files.exists(final) or not files.rename(aside, final):
            files.delete(aside, False)
            raise RuntimeError(f"version {number} of {self.folder} was published by another writer")
        for old in numbers[: len(numbers) + 1 - keep]:
            # The manifest goes first, so that no manifest names a version without files.
            version = read_manifest(self.spark, self.folder, old)["version"]
            for path in (f"manifests/{old:08d}.json", f"versions/{version}"):
                gone, _ = hadoop_path(self.spark, f"{self.folder}/{path}")
                files.delete(gone, True)
        return number


def write_store(store: Store, folder: str, keep: int = 2) -> int:
    """Publish a whole store as the next version. Variants lie sorted by category for scan pruning."""
    writer = StoreWriter(store.catalog.sparkSession, folder)
    for name in TABLES:
        table = store.texts if name == "chunks" else getattr(store, name)
        if table is not None:
            writer.write(table.sortWithinPartitions("category") if name == "variants" else table, name)
    return writer.publish(keep)


def table_or_none(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{folder}/{name}")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


@dataclass(frozen=True)
class StoreTables:
    """Where the tables of one version lie."""

    spark: SparkSession
    path: str
    names: tuple[str, ...] | None = None

    def read(self, name: str) -> DataFrame | None:
        if self.names is not None and name not in self.names:
            return None
        return table_or_none(self.spark, self.path, name)


def store_tables(spark: SparkSession, folder: str, number: int | None = None) -> StoreTables:
    """Tables of the newest version, or of a given kept one."""
    numbers = manifests(spark, folder)
    if number is not None and number not in numbers:
        raise ValueError(f"{folder} has no version {number}; kept: {numbers}")
    if not numbers:
        return StoreTables(spark, folder)
    found = read_manifest(spark, folder, numbers[-1] if number is None else number)
    return StoreTables(spark, f"{folder}/versions/{found['version']}", tuple(found["tables"]))


def load_store(
    spark: SparkSession, folder: str, fallback: str | None = None, number: int | None = None
) -> Store:
    """Read a store; chunks come from the fallback folder if the first has none.

    Without chunks or a vocabulary in either, the store searches by attributes.
    ``number`` asks for a kept version instead of the newest.
    """
    own = base = store_tables(spark, folder, number)
    name, chunks = folder, own.read("chunks")
    if chunks is None and fallback is not None:
        base, name = store_tables(spark, fallback), fallback
        chunks = base.read("chunks")
    vocabulary = base.read("vocabulary") if chunks is not None else None
    catalog, variants = own.read("catalog"), own.read("variants")
    if catalog is None or variants is None:
        raise FileNotFoundError(f"no store in {folder}")
    components = base.read("components") if vocabulary is not None else None
    rows = vectors = reduction = None
    if components is not None and "ids" in chunks.columns:
        rows, reduction = chunks, spark.sparkContext.broadcast(components_from(components))
        vectors = reduce_rows(rows, reduction, "chunk_id")
        chunks = reduce_rows(rows, reduction, *[c for c in rows.columns if c not in TERM_COLUMNS])
    return Store(
        catalog=catalog,
        variants=variants,
        chunks=chunks if chunks is not None else spark.createDataFrame([], CHUNK_SCHEMA),
        vocabulary=vocabulary,
        components=components,
        name=name.rstrip("/").rsplit("/", 1)[-1],
        rows=rows,
        vectors=vectors,
        reduction=reduction,
    )


def stored_rows(store: Store) -> int:
    return store.texts.count()


def peek(store: Store, rows: int = 3) -> DataFrame:
    """A few stored chunks without their vectors."""
    return store.texts.select(
        "chunk_id", "product_id", "chunk_type", "text"
    ).limit(rows)


def write_report(df: DataFrame, folder: str) -> None:
    """Small report as one JSON-lines file."""
    df.coalesce(1).write.mode("overwrite").json(folder)


def report_line(df: DataFrame) -> DataFrame:
    """Each report row as a JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("report"))
