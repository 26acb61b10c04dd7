"""The store: versioned parquet tables under one root, and the search index derived from them.

Every write makes a new version directory and then a row in the ``_versions`` table. A version
holds all buckets of its table, or only some, or it is a delta that adds rows to what was there;
readers take each bucket from its newest version and the deltas since. A job that dies half-way
leaves a directory nobody reads. One writer per store at a time.

A change of pages (``write_chunks``) writes deltas in proportion to the change: the added chunks, their
postings, the differences of the term frequencies and of the corpus statistics, and the ids of the
chunks that went, which hide their rows in everything written before. All of them are published by
one row set, so chunks and index never disagree. Chunk ids are never given twice, so a hidden id
stays hidden. Deltas of one size tier are folded into one of the next tier, and once the hidden
chunks are a twentieth of the store everything is written anew without them.
"""

from __future__ import annotations

import math
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..operators import bounds, lexical
from ..session import among, local, settled, stored
from . import retrieval

_VERSIONS = (
    "table_name string, version long, path string, n_rows long, layout int, tag string, buckets int, only array<int>, max_id long, "
    # of a delta: what it replaces. Of buckets: which hold rows. Of hidden chunks: up to which version of each table. Of corpus statistics: their share
    "delta boolean, replaces array<long>, filled array<int>, hides struct<chunks:long,chunk_vec:long,postings:long>, n_docs long, sum_dl long")
_STAMPED = _VERSIONS + ", written_at timestamp"
_HIDDEN = "hidden"
_HIDES = ("chunks", "chunk_vec", "postings")
_INDEX = ("postings", "terms", "blocks", "corpus_stats")
#: Row order inside a directory, which decides what a scan can skip.
_SORT = {
    "chunks": ("lib_id", "chunk_id"), "chunk_vec": ("lib_id", "chunk_id"), "postings": ("term", "lib_id", "chunk_id"), "terms": ("term",),
    "blocks": ("term", "lib_id", "block")}


class Store:
    """``n_buckets`` is fixed for the life of a store: about the number of libraries or files
    worth opening separately, 64 on a laptop, some thousands for a large corpus."""

    #: Up to this many libraries a batch names them in the scan itself.
    NAMED_LIBS = 100
    #: After this many partial versions the next write is a whole one.
    MAX_PARTS = 50
    #: So many deltas of one size tier (sizes within a factor of ``FAN``) are folded into one.
    FAN = 8
    #: Hidden chunks are written out of the store once they are this share of it, and so many at least.
    HIDDEN_SHARE, HIDDEN_LEAST = 0.05, 10_000
    #: With so many postings words are looked up by their bounds (``operators.bounds``); below, one pass over them is
    #: quicker than several steps. The answers are the same.
    PRUNE_FROM = 20_000_000

    def __init__(self, spark: SparkSession, root: str, n_buckets: int = 64):
        self.spark, self.root, self.n_buckets = spark, root.rstrip("/"), n_buckets

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.n_buckets)).cast("int")

    def versions(self) -> DataFrame:
        try:
            return self.spark.read.schema(_STAMPED).parquet(f"{self.root}/_versions")
        except AnalysisException:
            return self.spark.createDataFrame([], _STAMPED)

    def newest(self, table: str):
        return self.versions().filter(F.col("table_name") == table).orderBy(F.col("version").desc()).first()

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """Current rows in the current layout; an empty table if nothing was written yet."""
        key = schema.BUCKET_KEY.get(table)
        return self.snapshot(table, buckets=None if buckets is None else {key: buckets})[table]

    def snapshot(self, *tables: str, buckets: dict[str, list[int]] | None = None) -> dict[str, DataFrame]:
        """Several tables as of one moment, found with one look at the version list.

        ``buckets``: per bucket key (``lib_id``, ``term``) the directories that may hold asked rows.
        """
        live = self._live(*tables)
        return {t: self._open(t, live, buckets or {}) for t in tables}

    def _live(self, *tables: str) -> dict[str, list]:
        """Versions that make up the present content of each table, newest first, and the hidden chunks.

        One row for each write since the store began is read.
        """
        rows = self.versions().filter(F.col("table_name").isin(*tables, _HIDDEN)).collect()
        rows.sort(key=lambda r: -r["version"])
        live: dict[str, list] = {}
        for table in tables:
            mine = [r for r in rows if r["table_name"] == table]
            replaced = {v for r in mine for v in r["replaces"] or ()}
            whole = max((r["version"] for r in mine if r["only"] is None and not r["delta"]), default=None)
            live[table] = [] if whole is None else [r for r in mine if r["version"] >= whole and r["version"] not in replaced]
        live[_HIDDEN] = [r for r in rows if r["table_name"] == _HIDDEN]
        return live

    def _hidden(self, table: str, live: dict[str, list]) -> list:
        """Sets of hidden chunks that are younger than the last whole version of the table."""
        versions = live[table]
        return [h for h in live[_HIDDEN] if table in _HIDES and versions and h["hides"][table] >= versions[-1]["version"]]

    def _open(
        self, table: str, live: dict[str, list], buckets: dict[str, list[int]], where: Column | None = None,
        pick: set[int] | None = None,
    ) -> DataFrame:
        """Rows of a table; ``where`` is checked first. ``pick``: of these versions only."""
        kind, key, versions = schema.TABLES[table], schema.BUCKET_KEY.get(table), live[table]
        if not versions:
            return self.spark.createDataFrame([], kind)
        if table == "corpus_stats" and versions[-1]["n_docs"] is not None:
            n, total = (sum(r[c] for r in versions) for c in ("n_docs", "sum_dl"))
            return local(self.spark, kind, [(float(n), total / n if n else None)])
        covered: set[int] = set()
        parts = []
        for v in versions:
            if v["buckets"] not in (None, self.n_buckets):
                raise ValueError(f"{self.root} has {v['buckets']} buckets, not {self.n_buckets}")
            here = set(range(self.n_buckets) if v["only"] is None else v["only"]) - covered
            if not v["delta"]:
                covered |= here if key else set()
            if pick is not None and v["version"] not in pick:
                continue
            wanted = here & set(buckets[key]) if key in buckets else here
            if not key or wanted or not parts:
                df = self._scan(v, kind, key is not None, wanted)
                if key and len(wanted) < self.n_buckets:
                    df = df.filter(F.col("bucket").isin(*sorted(wanted)))
                parts.append(schema.conform(df if where is None else df.filter(where), table))
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        hidden = self._hidden(table, live)
        if hidden:
            ids = self.spark.read.schema("chunk_id long, lib_id string").parquet(*[h["path"] for h in hidden]).select("chunk_id")
            out = among(out, ids, sum(h["n_rows"] for h in hidden), stays=False).select(*[f.name for f in kind])
        if table == "terms" and len(parts) > 1:
            out = out.groupBy("term").agg(F.sum("df").alias("df"))
            out = out.filter("df > 0") if pick is None else out.filter("df <> 0")
        if table == "blocks" and len(parts) > 1:
            out = bounds.merged(out)
        return out

    def _scan(self, version, kind: T.StructType, bucketed: bool, wanted: set[int] | None = None) -> DataFrame:
        """``wanted``: directories of other buckets are not even listed."""
        reader = self.spark.read
        filled = version.get("filled") if isinstance(version, dict) else version["filled"]
        if bucketed and filled is not None and wanted is not None and len(wanted) < self.n_buckets:
            own = T.StructType(kind.fields + [T.StructField("bucket", T.IntegerType())])
            paths = [f"{version['path']}/bucket={b}" for b in sorted(wanted & set(filled))]
            return reader.schema(own).option("basePath", version["path"]).parquet(*paths) if paths else self.spark.createDataFrame([], own)
        if version["layout"] == schema.SCHEMA_VERSION:  # no job to look the schema up
            reader = reader.schema(T.StructType(kind.fields + ([T.StructField("bucket", T.IntegerType())] if bucketed else [])))
        return reader.parquet(version["path"])

    def buckets_of(self, keys: DataFrame, column: str = "lib_id") -> list[int]:
        """Directories that hold the given keys; at most ``n_buckets`` numbers."""
        return [r["b"] for r in keys.select(self.bucket(F.col(column)).alias("b")).distinct().collect()]

    def last_id(self) -> int:
        """Highest chunk id ever given."""
        return self.versions().filter("table_name = 'chunks'").agg(F.coalesce(F.max("max_id"), F.lit(-1))).first()[0]

    def write(
        self, table: str, df: DataFrame, sort: tuple[str, ...] = (), tag: str = "", least_rows: int = 0,
        only: list[int] | None = None,
    ) -> int:
        """Write the next version. ``sort`` columns lay rows out so that scans skip files.

        ``only``: ``df`` is the new content of these buckets; the others stay as they are.
        With fewer than ``least_rows`` rows the version is not published and readers keep the old one.
        """
        mine = self.versions().filter(F.col("table_name") == table)
        plain = F.col("only").isNull() & ~F.coalesce("delta", F.lit(False))
        last, whole = mine.agg(F.max("version"), F.max(F.when(plain, F.col("version")))).first()
        laid_out = df
        if only is not None and (whole is None or last - whole >= self.MAX_PARTS):
            rest = [b for b in range(self.n_buckets) if b not in set(only)]
            laid_out = schema.conform(df, table).unionByName(self.read(table, rest)) if whole else df
            only = None
        row = self._files(table, (last or 0) + 1, laid_out, sort, tag=tag, only=only)
        if row["n_rows"] < least_rows:
            raise ValueError(f"{table}: {row['n_rows']} rows, expected at least {least_rows}; kept version {last or 0}")
        self._publish(row)
        return row["version"]

    def _files(self, table: str, version: int, df: DataFrame, sort: tuple[str, ...] = (), **more) -> dict:
        """Write the directory of a version and return its row for the version list.

        Rows of ``blocks`` are combined where they are laid out: equal keys meet there, so they move once.
        """
        key, kind = schema.BUCKET_KEY.get(table), schema.TABLES[table]
        laid_out = schema.conform(df, table)
        path = f"{self.root}/{table}/v={version}-{uuid.uuid4().hex[:8]}"
        if key:
            # by range within the bucket: a bucket (or library, or term) that is large gets many files
            order = ("bucket", *(sort or _SORT[table]))
            laid_out = laid_out.withColumn("bucket", self.bucket(F.col(key))).repartitionByRange(*order)
            if table == "blocks":
                laid_out = bounds.merged(laid_out, "bucket").select(*[f.name for f in kind], "bucket")
            writer = laid_out.sortWithinPartitions(*order).write
            # a delta is small against the number of buckets: few files, which skip by their statistics
            (writer if more.get("delta") else writer.partitionBy("bucket")).parquet(path)
        else:
            laid_out.write.parquet(path)
        top = F.max("chunk_id") if table == "chunks" else F.lit(None).cast("long")
        own = T.StructType(kind.fields + [T.StructField("bucket", T.IntegerType())]) if key else kind
        filled = F.collect_set("bucket") if key and not more.get("delta") else F.lit(None)
        n_rows, max_id, filled = self.spark.read.schema(own).parquet(path).agg(F.count("*"), top, filled).first()
        return dict(table_name=table, version=version, path=path, n_rows=n_rows, layout=schema.SCHEMA_VERSION,
                    buckets=self.n_buckets if key else None, max_id=max_id, filled=filled) | more

    def rollback(self, table: str, version: int) -> None:
        """Publish an earlier whole version again."""
        old = self.versions().filter(
            (F.col("table_name") == table) & (F.col("version") == version) & F.col("only").isNull() & ~F.coalesce("delta", F.lit(False))).first()
        if old is None:
            raise ValueError(f"{table} has no whole version {version}")
        row = old.asDict(recursive=True)
        row.pop("written_at")
        self._publish(row | {"version": self.newest(table)["version"] + 1})

    def _publish(self, *rows: dict) -> None:
        """Make versions known, all of them at once: they stand in one file."""
        names = [c.split(" ")[0] for c in _VERSIONS.split(", ")]
        entry = local(self.spark, self.spark.createDataFrame([], _VERSIONS).schema, [tuple(r.get(n) for n in names) for r in rows])
        entry.withColumn("written_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.root}/_versions")

    def build_index(self) -> None:
        """Postings, term frequencies and corpus statistics of the current chunks, made from the texts."""
        live = self._live("chunks", *_INDEX)
        self._publish(*self._index_rows(live, self._open("chunks", live, {}), self._chunk_stamp(live)))

    def _index_rows(self, live: dict[str, list], chunks: DataFrame, stamp: str, postings: DataFrame | None = None) -> list[dict]:
        following = {t: (live[t][0]["version"] if live[t] else 0) + 1 for t in _INDEX}
        made = lexical.document_postings(chunks, positions=True) if postings is None else postings
        first = self._files("postings", following["postings"], made)
        written = self._scan(first, schema.POSTINGS, True)
        terms = self._files("terms", following["terms"], written.groupBy("term").agg(F.count("*").alias("df")))
        blocks = self._files("blocks", following["blocks"], bounds.rows_of(written))
        n, total = self._marks(written)
        return [first, terms, blocks, self._stats_row(following["corpus_stats"], stamp, n, total)]

    def _marks(self, postings: DataFrame) -> tuple[int, int]:
        """Number and total length of the documents of some postings; reads the directory of the mark only."""
        mark = self.buckets_of(local(self.spark, T.StructType([T.StructField("term", T.StringType())]), [(lexical.DOC_MARK,)]), "term")
        mine = postings.filter(F.col("bucket").isin(*mark)) if "bucket" in postings.columns else postings
        return tuple(mine.filter(F.col("term") == lexical.DOC_MARK).agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first())

    @staticmethod
    def _stats_row(version: int, stamp: str, n_docs: int, sum_dl: int, delta: bool = False) -> dict:
        return dict(table_name="corpus_stats", version=version, path="", n_rows=1, layout=schema.SCHEMA_VERSION, tag=stamp,
                    n_docs=n_docs, sum_dl=sum_dl, delta=delta)

    def append(self, table: str, rows: DataFrame) -> int:
        """Add rows to a table that has a whole version, in proportion to the rows."""
        last = self.newest(table)
        row = self._files(table, last["version"] + 1, rows, delta=True)
        self._publish(row)
        self._fold()
        return row["version"]

    def write_chunks(self, after: DataFrame, touched: list[int], tag: str = "") -> None:
        """Give the ``touched`` buckets of ``chunks`` new content and let index and vectors follow.

        Rows are told apart by their chunk id. What is written follows the number of chunks that come
        and go. Vectors of chunks that went are hidden with them; ``libraries.embed_missing`` makes those of
        added ones. A store whose index was never built stays without. Chunks that changed under their
        old id cannot be told from those in older deltas, so their buckets are written anew and so is the index.
        """
        tables = ("chunks", "chunk_vec", *_INDEX)
        live = self._live(*tables)
        indexed = self._current(live)
        after = settled(schema.conform(after, "chunks"))
        print_ = F.xxhash64(*[f.name for f in schema.CHUNKS])
        before = self._open("chunks", live, {"lib_id": touched})
        marks = stored(before.select("chunk_id", "lib_id", print_.alias("old")).join(
            after.select("chunk_id", "lib_id", print_.alias("new")), ["chunk_id", "lib_id"], "full").filter("NOT old <=> new"))
        n_new, n_old, n_changed = marks.agg(
            F.count_if(F.col("old").isNull()), F.count_if(F.col("new").isNull()), F.count_if(F.col("old").isNotNull() & F.col("new").isNotNull())).first()
        if not live["chunks"] or n_changed:
            self.write("chunks", after, tag=tag, only=touched)
            if indexed:
                self.build_index()
            return
        added = among(after, marks.filter("old IS NULL"), n_new)
        gone = among(before, marks.filter("new IS NULL"), n_old)
        if self._many_hidden(live, n_new, n_old):
            self._whole(live, added if n_new else None, marks.filter("new IS NULL"), n_old, tag)
            return
        following = {t: (live[t][0]["version"] if live[t] else 0) + 1 for t in tables}
        rows = [self._files("chunks", following["chunks"], added, tag=tag, delta=True)]
        gone = stored(gone.select("chunk_id", "lib_id", "text")) if n_old else None
        if gone is not None:
            number = max((r["version"] for r in live[_HIDDEN]), default=0) + 1
            path = f"{self.root}/{_HIDDEN}/v={number}-{uuid.uuid4().hex[:8]}"
            gone.select("chunk_id", "lib_id").write.parquet(path)
            rows.append(dict(table_name=_HIDDEN, version=number, path=path, n_rows=n_old, hides={t: following[t] - 1 for t in _HIDES}))
        if indexed:
            rows += self._index_deltas(following, self._scan(rows[0], schema.CHUNKS, True), gone)
        self._publish(*rows)
        self._fold()

    def _index_deltas(self, following: dict[str, int], added: DataFrame, gone: DataFrame | None) -> list[dict]:
        posted = self._files("postings", following["postings"], lexical.document_postings(added, positions=True), delta=True)
        fresh = self._scan(posted, schema.POSTINGS, True)
        n, total = self._marks(fresh)
        change = fresh.select("term", F.lit(1).alias("df"))
        if gone is not None:
            left = stored(lexical.document_postings(gone).select("term", "dl"))
            n_left, total_left = self._marks(left)
            n, total = n - n_left, total - total_left
            change = change.unionByName(left.select("term", F.lit(-1).alias("df")))
        sums = change.groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")
        terms = self._files("terms", following["terms"], sums, delta=True)
        blocks = self._files("blocks", following["blocks"], bounds.rows_of(fresh), delta=True)
        return [posted, terms, blocks, self._stats_row(following["corpus_stats"], f"chunks-{following['chunks']}", n, total, delta=True)]

    def _fold(self) -> None:
        """Fold deltas of one tier together; write hidden chunks out of the store when they are many."""
        tables = ("chunks", "chunk_vec", *_INDEX)
        live = self._live(*tables)
        if self._many_hidden(live):
            self.compact()
            return
        rows = []
        for table in tables:
            tiers: dict[int, list] = {}
            for r in live[table]:
                if r["delta"]:
                    tiers.setdefault(0 if table == "corpus_stats" else int(math.log(max(1, r["n_rows"]), self.FAN)), []).append(r)
            for full in (t for t in tiers.values() if len(t) >= self.FAN):
                version = max(r["version"] for r in [*live[table], *[x for x in rows if x["table_name"] == table]]) + 1
                more = dict(delta=True, replaces=[r["version"] for r in full], tag=self._chunk_stamp(live) if table == "chunks" else "")
                if table == "corpus_stats":
                    n, total = (sum(r[c] for r in full) for c in ("n_docs", "sum_dl"))
                    newest = max(full, key=lambda r: r["version"])
                    rows.append(self._stats_row(version, newest["tag"], n, total) | more | {"tag": newest["tag"]})
                else:
                    rows.append(self._files(table, version, self._open(table, live, {}, pick=set(more["replaces"])), **more))
        if rows:
            self._publish(*rows)

    def _many_hidden(self, live: dict[str, list], n_new: int = 0, n_old: int = 0) -> bool:
        """Whether hidden chunks are due to be written out, once ``n_new`` chunks came and ``n_old`` went."""
        held = sum(r["n_rows"] for r in live["chunks"]) + n_new
        return sum(r["n_rows"] for r in self._hidden("chunks", live)) + n_old > max(self.HIDDEN_LEAST, self.HIDDEN_SHARE * held)

    def compact(self) -> None:
        """Write chunks, vectors and a current index as whole versions without deltas and hidden chunks."""
        self._whole(self._live("chunks", "chunk_vec", *_INDEX))

    def _whole(self, live: dict[str, list], added: DataFrame | None = None, gone: DataFrame | None = None, n_gone: int = 0, tag: str = "") -> None:
        """Whole versions of what is live, with the ``added`` chunks and without the ``n_gone`` that are ``gone``.

        A write after which hidden chunks are due to go is done here at once, not as deltas that are read back and written again.
        """
        def left(table: str) -> DataFrame:
            rows = self._open(table, live, {})
            return among(rows, gone, n_gone, stays=False) if n_gone else rows

        following = {t: live[t][0]["version"] + 1 for t in ("chunks", "chunk_vec", "postings") if live[t]}
        made = {t: left(t) for t in following}
        if added is not None:
            made["chunks"] = made["chunks"].unionByName(added)
            if "postings" in made:
                made["postings"] = made["postings"].unionByName(schema.conform(lexical.document_postings(added, positions=True), "postings"))
        rows = [self._files(t, following[t], made[t], **({"tag": tag} if t == "chunks" else {})) for t in ("chunks", "chunk_vec") if t in following]
        if self._current(live):
            rows += self._index_rows(live, made["chunks"], f"chunks-{following['chunks']}", made["postings"])
        self._publish(*rows)

    def _chunk_stamp(self, live: dict[str, list]) -> str:
        """Names the content of the chunks; folding deltas does not change it."""
        newest = live["chunks"][0] if live["chunks"] else None
        return newest["tag"] if newest and newest["replaces"] else f"chunks-{newest['version'] if newest else 0}"

    def _current(self, live: dict[str, list]) -> bool:
        return bool(live["corpus_stats"]) and live["corpus_stats"][0]["tag"] == self._chunk_stamp(live)

    def index_is_current(self) -> bool:
        return self._current(self._live("chunks", "corpus_stats"))

    def _opened(self, queries: DataFrame, asked: lexical.QueryTerms) -> retrieval.Corpus:
        """The part of the store a batch needs. What is collected is at most one number per bucket.

        An index made from other chunks than the current ones would miss some without a sign, so it
        is refused.
        """
        if asked.terms is not None:
            return self._opened_for_one(asked)
        libs = queries.select("lib_id").distinct()
        wanted = libs.select(F.lit("lib_id").alias("key"), self.bucket(F.col("lib_id")).alias("bucket")).union(
            asked.parts.select(F.lit("term"), self.bucket(F.col("term")))).distinct()
        buckets: dict[str, list[int]] = {"lib_id": [], "term": []}
        for row in wanted.collect():
            buckets[row["key"]].append(row["bucket"])
        live = self._searchable()
        named = [r["lib_id"] for r in libs.limit(self.NAMED_LIBS + 1).collect()]
        ours = F.col("lib_id").isin(*named) if len(named) <= self.NAMED_LIBS else None
        ours_only = {"blocks", *_HIDES} - ({"postings"} if asked.phrases else set())
        now = {t: self._open(t, live, buckets, ours if t in ours_only else None) for t in live if t != _HIDDEN}
        return retrieval.Corpus(now["chunks"], now["chunk_vec"], now["postings"], now["corpus_stats"], now["terms"], self._blocks(live, now))

    def _opened_for_one(self, asked: lexical.QueryTerms) -> retrieval.Corpus:
        """The same for one query: its words and its library go into the scans, which skip by them."""
        keys = T.StructType([T.StructField("key", T.StringType())])
        of = lambda values: [r["b"] for r in local(self.spark, keys, [(v,) for v in values]).select(self.bucket(F.col("key")).alias("b")).collect()]
        buckets = {"lib_id": of([asked.lib_id]), "term": sorted(set(of(asked.terms)))}
        mine, words = F.col("lib_id") == F.lit(asked.lib_id), F.col("term").isin(*asked.terms) if asked.terms else F.lit(False)
        where = {"chunks": mine, "chunk_vec": mine, "postings": words if asked.phrases else words & mine, "terms": words, "blocks": words & mine}
        live = self._searchable()
        now = {t: self._open(t, live, buckets, where.get(t)) for t in live if t != _HIDDEN}
        vectors = now["chunk_vec"] if live["chunk_vec"] else None
        return retrieval.Corpus(now["chunks"], vectors, now["postings"], now["corpus_stats"], now["terms"], self._blocks(live, now))

    def _blocks(self, live: dict[str, list], now: dict[str, DataFrame]) -> DataFrame | None:
        """Bounds of a large index; one built before there were bounds has none."""
        large = sum(r["n_rows"] for r in live["postings"]) >= self.PRUNE_FROM
        return now["blocks"] if live["blocks"] and large else None

    def _searchable(self) -> dict[str, list]:
        live = self._live("chunks", "chunk_vec", *_INDEX)
        if live["chunks"] and not self._current(live):
            raise ValueError(f"{self.root}: the index is missing or older than the chunks; run build_index")
        return live

    def lexical_ranks(self, queries: DataFrame, top: int = lexical.TOP) -> DataFrame:
        """The two lexical lists alone; see :func:`lexical.lexical_ranks`."""
        asked = lexical.query_terms(queries)
        return lexical.lexical_ranks(self._opened(queries, asked).scores(asked, top), top)

    def search(self, queries: DataFrame, **options) -> DataFrame:
        return retrieval.search(queries, opener=self._opened, **options)

    def get_docs(self, queries: DataFrame, **options) -> DataFrame:
        """Answers for a batch (qid, lib_id, query, query_vec, version); see :func:`retrieval.get_docs`."""
        return retrieval.get_docs(queries, opener=self._opened, **options)

    def get_docs_one(self, lib_id: str, query: str, version: str = "", query_vec: list | None = None, **options) -> DataFrame:
        row = local(self.spark, schema.QUERIES, [(0, lib_id, query, query_vec, version)])
        return self.get_docs(row, single=True, **options).drop("qid").orderBy("rank")

    def versions_of(self, lib_id: str) -> DataFrame:
        return self.read("libs").filter(F.col("id") == lib_id).select(F.explode_outer("versions").alias("version")).filter("version IS NOT NULL")


def lib_stats(chunks: DataFrame) -> DataFrame:
    """Chunk count, page count and last fetch per library; partial counts merge before the shuffle."""
    per_path = chunks.groupBy("lib_id", "path").agg(F.count("*").alias("n"), F.max("fetched_at").alias("at"))
    return per_path.groupBy("lib_id").agg(
        F.sum("n").alias("n_chunks"), F.count("*").alias("n_paths"), F.max("at").alias("last_fetched")
    )


def pick_release(releases: DataFrame, asset: str) -> DataFrame:
    """Newest release (tag_name, created_at, assets) that carries the asset: tag_name, asset."""
    has = releases.withColumn("asset", F.get(F.filter("assets", lambda a: a["name"] == asset), F.lit(0)))
    return has.filter("asset IS NOT NULL").orderBy(F.col("created_at").desc()).limit(1).select("tag_name", "asset")


