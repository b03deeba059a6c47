"""A document store of plain Parquet tables, with commits and snapshots.

Tables under one root, all partitioned by (index_name, commit_seq):

``documents``   row_id and the stored fields; written once, in input order
``postings``    bucketed by row_id, sorted by term inside a bucket
``term_stats``  df and token counts per term; deletes add negative rows
``deleted``     rows hidden by a delete
``vectors``     one vector per id and commit; NULL marks a delete

Every write gets a commit number of its own that is never used again.  A commit
counts only once the log says it is done, so what a lost job left behind stays
invisible.  One writer at a time per root.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import zip_longest

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import candidate_text
from termloom.operators.clauses import DOC_MARKER, TERM_KEY, CompiledRequests
from termloom.operators.embed import Embedder, embed_texts
from termloom.operators.postings import build_postings, term_statistics
from termloom.operators.vectors import check_dims, deleted_found, keep_dims, latest_vectors
from termloom.schema import DEFAULT_INDEX, SEARCHABLE_FIELDS
from termloom.sources.documents import fill_ids, from_storage, to_storage

KEYS = ("commit_seq", "row_id")

# Query terms, and rows of a result, up to these counts become literal filters
# that Parquet can use to skip data; larger sets are joined.
LITERAL_TERMS = 1_000
LITERAL_ROWS = 10_000
# Keys of deleted rows up to this count are broadcast to the documents.
BROADCAST_DELETED = 1_000_000
# Parquet gets an IN of up to this many values (Spark's default threshold) value by
# value, a longer one only as the range from its least to its largest.
PUSHED_VALUES = 10

_COLUMNS = {
    "documents": "row_id BIGINT, id STRING, title STRING, body STRING, url STRING, metadata STRING",
    "postings": "row_id BIGINT, field STRING, term STRING, tf INT, dl INT, positions ARRAY<INT>",
    "term_stats": "field STRING, term STRING, df BIGINT, tokens BIGINT",
    "deleted": "row_id BIGINT, doc_seq BIGINT",
    "vectors": "id STRING, embedding ARRAY<FLOAT>",
}
_LAYOUT = {
    "postings": "CLUSTERED BY (row_id) SORTED BY (term, field)",
    "deleted": "CLUSTERED BY (row_id)",
    "vectors": "CLUSTERED BY (id) SORTED BY (id)",
}
_LOG = "commit_seq BIGINT, done BOOLEAN, kind STRING, added BIGINT, stream STRING, batch BIGINT"


def one_of(column: str, values: Sequence) -> Column:
    """``column`` is one of ``values``, in groups short enough to skip data by each value."""
    values = sorted(values)
    if len(values) > LITERAL_TERMS:
        return F.col(column).isin(values)
    groups = [F.col(column).isin(values[i : i + PUSHED_VALUES]) for i in range(0, len(values), PUSHED_VALUES)]
    while len(groups) > 1:  # by halves, so that the condition stays shallow
        groups = [a if b is None else a | b for a, b in zip_longest(groups[::2], groups[1::2])]
    return groups[0] if groups else F.lit(False)


class Store:
    """Open or create the store at ``root``.

    ``buckets`` is fixed when the store is created; choose it so that one bucket
    of postings suits one task.  Table definitions live in the session catalog
    and are recreated from the root when a session does not have them.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 8, dims: int | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.dims = dims
        self._prefix = "store_" + hashlib.sha256(self.root.encode()).hexdigest()[:12]
        self.buckets = self._settings(buckets)
        spark.createDataFrame([], _LOG).write.mode("ignore").parquet(f"{self.root}/log")
        for name in _COLUMNS:
            self._define(name)

    def _settings(self, buckets: int) -> int:
        path = f"{self.root}/settings"
        wanted = self.spark.createDataFrame([(buckets,)], "buckets INT")
        wanted.coalesce(1).write.mode("ignore").parquet(path)
        return self.spark.read.schema("buckets INT").parquet(path).first()["buckets"]

    def _define(self, name: str) -> None:
        table = self.table_name(name)
        if self.spark.catalog.tableExists(table):
            return
        columns = f"{_COLUMNS[name]}, index_name STRING, commit_seq BIGINT"
        empty = self.spark.createDataFrame([], columns)
        empty.write.mode("ignore").partitionBy("index_name", "commit_seq").parquet(
            f"{self.root}/{name}"
        )
        layout = f"{_LAYOUT[name]} INTO {self.buckets} BUCKETS" if name in _LAYOUT else ""
        location = f"{self.root}/{name}".replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE {table} ({columns}) "
            f"USING parquet PARTITIONED BY (index_name, commit_seq) {layout} "
            f"LOCATION '{location}'"
        )
        self.refresh(name)

    def refresh(self, *names: str) -> None:
        """Pick up partitions written by other sessions."""
        for name in names or _COLUMNS:
            self.spark.sql(f"MSCK REPAIR TABLE {self.table_name(name)}")

    def table_name(self, name: str) -> str:
        return f"{self._prefix}_{name}"

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self.table_name(name))

    # -- commits ---------------------------------------------------------

    def log(self) -> DataFrame:
        return self.spark.read.schema(_LOG).parquet(f"{self.root}/log")

    def _record(self, seq: int, done: bool, kind: str, added=None, stream=None, batch=None) -> None:
        values = (seq, done, kind, added, stream, batch)
        columns = [
            F.lit(value).cast(spec.split()[1]).alias(spec.split()[0])
            for value, spec in zip(values, _LOG.split(", "))
        ]
        row = self.spark.range(1, numPartitions=1).select(*columns)
        row.write.mode("append").parquet(f"{self.root}/log")

    def _begin(self, kind: str) -> int:
        last = self.log().agg(F.coalesce(F.max("commit_seq"), F.lit(0))).first()[0]
        self._record(last + 1, False, kind)
        return last + 1

    def _insert(self, name: str, rows: DataFrame, seq: int) -> None:
        columns = [c.split()[0] for c in _COLUMNS[name].split(", ")]
        placed = rows.select(*columns, "index_name", F.lit(seq).cast("bigint").alias("commit_seq"))
        placed.write.insertInto(self.table_name(name))

    def _written(self, name: str, seq: int) -> DataFrame:
        return self.table(name).where(F.col("commit_seq") == seq)

    def stream_commit(self, stream: str, batch: int) -> int | None:
        """Commit number of a finished stream batch, or None."""
        done = self.log().where(
            F.col("done") & (F.col("stream") == stream) & (F.col("batch") == batch)
        )
        return done.agg(F.max("commit_seq")).first()[0]

    # -- writes ----------------------------------------------------------

    def add_documents(
        self,
        docs: DataFrame,
        embedder: Embedder | None = None,
        stream: str | None = None,
        batch: int | None = None,
    ) -> int:
        """Append documents in one commit and return how many were added.

        Equal ids are kept side by side.  With an ``embedder`` the vectors of
        the new documents follow in a commit of their own; documents that it
        fails on stay searchable, and :meth:`fill_vectors` can try them again.
        """
        seq = self._begin("add")
        # The commit number in the upper bits gives each commit row ids of its
        # own, so that many small commits spread over all buckets.
        number = F.monotonically_increasing_id().bitwiseXOR(F.lit(seq << 40))
        numbered = fill_ids(to_storage(docs)).withColumn("row_id", number)
        self._insert("documents", numbered, seq)
        # From here on everything derives from what was written: ids are fixed.
        written = self._written("documents", seq)
        self._insert(
            "postings",
            build_postings(written, ["row_id"], SEARCHABLE_FIELDS, partitions=self.buckets),
            seq,
        )
        self._insert("term_stats", self._sorted(term_statistics(self._written("postings", seq))), seq)
        added = written.count()
        self._record(seq, True, "add", added, stream, batch)
        if embedder is not None:
            try:
                self._embed(written, embedder)
            except Exception:
                # The documents are committed and stay searchable whatever their vectors do.
                logging.getLogger("termloom").warning("storing embeddings failed", exc_info=True)
        return added

    def _sorted(self, stats: DataFrame) -> DataFrame:
        # Sorted files are enough for skipping by term; no range shuffle needed.
        return stats.sortWithinPartitions("index_name", "term", "field")

    def _embed(self, written: DataFrame, embedder: Embedder) -> int:
        texts = written.select(
            "index_name", "id", "commit_seq", "row_id", candidate_text().alias("text")
        )
        made = embed_texts(texts, embedder, keep_failures=True).drop("text")
        return self._put_vectors(made.where(F.col("embedding").isNotNull()), KEYS)

    def fill_vectors(self, embedder: Embedder) -> int:
        """Embed the live documents whose id has no vector; returns how many got one.

        Texts that the model fails on stay without.  A job that fails fails the
        call: nothing was filled then, which is not the same as nothing to fill.
        """
        corpus = self.snapshot()
        have = corpus.vectors().select("index_name", "id")
        return self._embed(corpus.stored().join(have, ["index_name", "id"], "left_anti"), embedder)

    def delete_documents(self, ids: DataFrame) -> int:
        """Delete every live document with one of the given (index_name, id).

        Returns how many rows were hidden.  Vectors of these ids go too.
        """
        ids = self._scoped(ids).select("index_name", "id").distinct()
        corpus = self.snapshot()
        seq = self._begin("delete")
        doomed = corpus.stored().join(ids, ["index_name", "id"], "left_semi")
        hidden = doomed.select("index_name", F.col("commit_seq").alias("doc_seq"), "row_id")
        # By bucket, so that a task writes one file and not one for each bucket.
        self._insert("deleted", hidden.repartition(self.buckets, "row_id"), seq)
        found = self._written("deleted", seq).select("index_name", "doc_seq", "row_id")
        count = found.count()
        # The text of the hidden rows is read once more for its terms.
        rows = corpus.stored()
        if count <= LITERAL_ROWS:
            keys = found.select("doc_seq", "row_id").toArrow()
            rows = rows.where(
                F.col("commit_seq").isin(keys["doc_seq"].unique().to_pylist())
                & F.col("row_id").isin(keys["row_id"].unique().to_pylist())
            )
        found = found.withColumnRenamed("doc_seq", "commit_seq")
        found = F.broadcast(found) if count <= BROADCAST_DELETED else found
        gone = rows.join(found, ["index_name", *KEYS], "left_semi")
        terms = build_postings(gone, KEYS, SEARCHABLE_FIELDS, positions=False, partitions=self.buckets)
        minus = term_statistics(terms)
        negative = minus.withColumns({"df": -F.col("df"), "tokens": -F.col("tokens")})
        self._insert("term_stats", self._sorted(negative), seq)
        markers = ids.repartition(self.buckets, "id").withColumn("embedding", F.lit(None).cast("array<float>"))
        self._insert("vectors", markers, seq)
        self._record(seq, True, "delete", count)
        return count

    def put_vectors(self, vectors: DataFrame, strict: bool = False) -> int:
        """Upsert (index_name, id, embedding), the last row of an id wins.

        Vectors of the wrong size are skipped, or fail the call when ``strict``.
        Returns how many were taken, rewritten ids counted each time.
        """
        ordered = self._scoped(vectors).withColumn("n", F.monotonically_increasing_id())
        return self._put_vectors(ordered, ["n"], strict)

    def _put_vectors(self, vectors: DataFrame, order: Sequence[str], strict: bool = False) -> int:
        taken = vectors
        if self.dims is not None:
            taken = (check_dims if strict else keep_dims)(vectors, self.dims)
        seq = self._begin("vectors")
        # Counted while they are written: a second pass could call a model again.
        seen = Observation()
        counted = taken.observe(seen, F.count(F.lit(1)).alias("n"))
        # By bucket, which serves the grouping too.
        last = counted.repartition(self.buckets, "id").groupBy("index_name", "id").agg(
            F.max_by("embedding", F.struct(*order)).alias("embedding")
        )
        self._insert("vectors", last, seq)
        # A plan found to be empty while it runs counts nothing.
        count = 0 if self._written("vectors", seq).isEmpty() else seen.get["n"]
        self._record(seq, True, "vectors", count)
        return count

    def delete_vectors(self, ids: DataFrame) -> DataFrame:
        """Delete vectors by (index_name, id); returns whether each was there."""
        ids = self._scoped(ids)
        found = deleted_found(self.snapshot().vectors(), ids)
        seq = self._begin("vectors")
        markers = ids.select("index_name", "id").repartition(self.buckets, "id").distinct()
        self._insert(
            "vectors", markers.withColumn("embedding", F.lit(None).cast("array<float>")), seq
        )
        self._record(seq, True, "vectors", 0)
        return found

    def _scoped(self, rows: DataFrame) -> DataFrame:
        if "index_name" in rows.columns:
            return rows
        return rows.withColumn("index_name", F.lit(DEFAULT_INDEX))

    # -- reads -----------------------------------------------------------

    def snapshot(self, seq: int | None = None, index_name: str | None = None) -> StoreCorpus:
        """The store as of commit ``seq`` (default: the last finished one)."""
        commits = self.log().groupBy("commit_seq").agg(
            F.max("done").alias("done"), F.max("kind").alias("kind"), F.max("added").alias("added")
        )
        counted = F.col("done") & (F.col("kind") == "delete")
        if seq is not None:
            counted = counted & (F.col("commit_seq") <= seq)
        state = commits.agg(
            F.coalesce(F.max(F.when(F.col("done"), F.col("commit_seq"))), F.lit(0)).alias("last"),
            F.coalesce(
                F.min(F.when(F.col("done") & (F.col("kind") == "delete"), F.col("commit_seq"))),
                F.lit(None),
            ).alias("first_delete"),
            F.coalesce(F.sum(F.when(counted, F.col("added"))), F.lit(0)).alias("hidden"),
        ).first()
        last = state["last"] if seq is None else min(seq, state["last"])
        # Attempts that never finished; a handful at most.
        open_commits = [
            row["commit_seq"]
            for row in commits.where(~F.col("done") & (F.col("commit_seq") < last)).collect()
        ]
        has_deletes = state["first_delete"] is not None and state["first_delete"] <= last
        return StoreCorpus(self, last, tuple(open_commits), has_deletes, state["hidden"], index_name)

    def list_indexes(self) -> DataFrame:
        """Names of all indexes that were ever written to."""
        corpus = self.snapshot()
        markers = corpus.visible("term_stats").where(F.col("term") == DOC_MARKER)
        return markers.select("index_name").distinct()


@dataclass(frozen=True)
class StoreCorpus:
    """A store pinned to one commit; search works on it as on any corpus."""

    store: Store
    seq: int
    open_commits: tuple[int, ...] = ()
    has_deletes: bool = False
    hidden: int = 0
    index_name: str | None = None
    keys: tuple[str, ...] = KEYS

    def visible(self, name: str) -> DataFrame:
        """Rows of finished commits up to the snapshot; prunes partitions."""
        rows = self.store.table(name).where(F.col("commit_seq") <= self.seq)
        if self.open_commits:
            rows = rows.where(~F.col("commit_seq").isin(*self.open_commits))
        if self.index_name is not None:
            rows = rows.where(F.col("index_name") == self.index_name)
        return rows

    def _live(self, rows: DataFrame) -> DataFrame:
        if not self.has_deletes:
            return rows
        gone = self.visible("deleted").select("doc_seq", F.col("row_id").alias("gone_row"))
        # Both sides are bucketed by row_id.  Writing the rest of the key as a
        # residual condition keeps row_id the only join key, so neither moves.
        same_commit = F.col("commit_seq") - F.col("doc_seq") == 0
        return rows.join(gone, (F.col("row_id") == F.col("gone_row")) & same_commit, "left_anti")

    def stored(self) -> DataFrame:
        """Live documents in storage form, with their keys.

        Deleted keys, whose number the log knows, go to the documents while they
        are few enough, so that no text is shuffled to leave the deleted out.
        """
        if not self.has_deletes or self.hidden > BROADCAST_DELETED:
            return self._live(self.visible("documents"))
        gone = self.visible("deleted").select("index_name", F.col("doc_seq").alias("commit_seq"), "row_id")
        return self.visible("documents").join(F.broadcast(gone), ["index_name", *KEYS], "left_anti")

    @property
    def documents(self) -> DataFrame:
        return from_storage(self.stored())

    def _for_terms(self, name: str, compiled: CompiledRequests) -> DataFrame:
        """Rows of a term-sorted table; few terms become a filter that skips data."""
        rows = self.visible(name).where(F.col("field").isin(list(compiled.profile.fields)))
        if compiled.literal is not None and len(compiled.literal) <= LITERAL_TERMS:
            rows = rows.where(one_of("term", compiled.literal))
        return rows

    def postings_for(self, compiled: CompiledRequests, broadcast: bool = True) -> DataFrame:
        columns = ["index_name", *self.keys, "field", "term", "tf", "dl"]
        if compiled.profile.any_phrase:
            columns.append("positions")
        return self._live(self._for_terms("postings", compiled)).select(*columns)

    def statistics_for(self, compiled: CompiledRequests, postings: DataFrame) -> DataFrame:
        rows = self._for_terms("term_stats", compiled)
        summed = (
            rows.join(compiled.wanted, list(TERM_KEY), "left_semi")
            .groupBy(*TERM_KEY)
            .agg(F.sum("df").alias("df"), F.sum("tokens").alias("tokens"))
        )
        return summed.where(F.col("df") > 0)

    def postings_between(self, condition: Column, fields: Sequence[str]) -> DataFrame:
        rows = self.visible("postings").where(F.col("field").isin(list(fields))).where(condition)
        return self._live(rows).select("index_name", *self.keys, "field", "term")

    def terms_between(self, condition: Column, fields: Sequence[str]) -> DataFrame:
        """Distinct (index_name, field, term) that meet ``condition``, those of deleted documents included."""
        rows = self.visible("term_stats").where(F.col("field").isin(list(fields))).where(condition)
        return rows.select(*TERM_KEY).distinct()

    def settled(self, postings: DataFrame) -> DataFrame:
        """``postings``: they are stored already."""
        return postings

    def document_count(self) -> int:
        """Rows that were added, deleted ones included."""
        return self.visible("documents").count()

    def fetch(self, hits: DataFrame, rows: int | None = None) -> DataFrame:
        """Join stored fields onto ranked hits.

        When at most ``rows`` hits are known to be few, they are brought in
        first and their keys become filters, so only the files and row groups
        that hold a winner are read.
        """
        return self._with(hits, rows, None)

    def fetch_ids(self, hits: DataFrame) -> DataFrame:
        return self._with(hits, None, "id")

    def _with(self, hits: DataFrame, rows: int | None, only: str | None) -> DataFrame:
        docs = self.visible("documents")
        if rows is not None and rows <= LITERAL_ROWS:
            table = hits.toArrow()
            if table.num_rows:
                for key in self.keys:
                    docs = docs.where(one_of(key, table[key].unique().to_pylist()))
            hits = F.broadcast(self.store.spark.createDataFrame(table))
        docs = docs.select("index_name", *self.keys, only) if only else from_storage(docs)
        return docs.join(hits, ["index_name", *self.keys])

    def get(self, ids: DataFrame) -> DataFrame:
        """Documents by (index_name, id).

        The stored documents are read once, and up to a million ids go to them,
        so that neither postings nor texts are shuffled.
        """
        wanted = ids.select("index_name", "id").distinct()
        rows = self.stored()
        few = wanted.select("id").limit(LITERAL_TERMS + 1).collect()
        if len(few) <= LITERAL_TERMS:
            rows = rows.where(one_of("id", {row["id"] for row in few if row["id"] is not None}))
        if len(few) <= LITERAL_TERMS or wanted.count() <= BROADCAST_DELETED:
            wanted = F.broadcast(wanted)
        found = from_storage(rows.join(wanted, ["index_name", "id"], "left_semi"))
        first = ["index_name", *self.keys]
        return found.select(*first, *(c for c in found.columns if c not in first))

    def vectors(self) -> DataFrame:
        """(index_name, id, embedding): the last vector of each id, deletes applied."""
        last = latest_vectors(self.visible("vectors"), ["commit_seq"])
        return last.where(F.col("embedding").isNotNull())
