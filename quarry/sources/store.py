"""The knowledge base's tables: replace-by-URL upserts, source records and statistics, and their Parquet store.

The store is merged on reading. A write adds a part: the new rows, their postings, and a tombstone for each of their URLs, all cut
by bucket. A row is dead if its URL has a tombstone of a later write; only buckets that hold more than one part need that join.
Compaction rewrites the buckets whose later parts have grown, and splits buckets by linear hashing where they have become too
large on the average: a bucket's rows go to itself and one other bucket, and no other bucket changes.

One manifest names the parts of all tables. It is a numbered file made by a rename that fails where there already is one, so rows
and postings are always of one state, a failed write leaves the last one, and of two writers at once the second begins again
from what the first has made.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry import schemas
from quarry.functions import vector
from quarry.functions.text import fence_language
from quarry.operators import filters, fts, metadata_index, vector_index
from quarry.sources.files import Files


def row_id(url: Column, number: Column) -> Column:
    """The same id for the same chunk in every run."""
    return F.xxhash64(url, number)


def replaced_by_url(existing: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of ``new`` and those of ``existing`` whose URL it doesn't have."""
    return existing.join(new.select("url").distinct(), "url", "left_anti").unionByName(new)


def with_missing_sources(sources: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """``sources`` and an empty record for each source of ``rows`` that has none."""
    missing = rows.select("source_id").distinct().join(sources, "source_id", "left_anti")
    made = missing.select("source_id", F.concat(F.lit("Auto-created source for "), F.col("source_id")).alias("summary"), F.lit(0).alias("total_word_count"), now.alias("created_at"), now.alias("updated_at"))
    return sources.unionByName(made)


def updated_sources(sources: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """``sources`` with summary and word count of ``new`` in place of the old ones; a record's creation time stays."""
    old, fresh = sources.alias("o"), new.alias("n")
    joined = old.join(fresh, F.col("o.source_id") == F.col("n.source_id"), "full_outer")
    known = F.col("n.source_id").isNotNull()
    return joined.select(
        F.coalesce("o.source_id", "n.source_id").alias("source_id"),
        F.when(known, F.col("n.summary")).otherwise(F.col("o.summary")).alias("summary"),
        F.when(known, F.col("n.total_word_count")).otherwise(F.col("o.total_word_count")).alias("total_word_count"),
        F.coalesce(F.col("o.created_at"), now).alias("created_at"),
        F.when(known, now).otherwise(F.col("o.updated_at")).alias("updated_at"),
    )


def source_stats(sources: DataFrame, chunks: DataFrame, code: DataFrame) -> DataFrame:
    """Each source with its documents, chunks, code examples (counted by URL, and by row) and last update.

    Both tables are summed by source before they are joined, so neither multiplies the other.
    """
    return counted_sources(sources, counts(chunks), counts(code))


def counts(rows: DataFrame) -> DataFrame:
    """source_id, documents (URLs), rows."""
    return rows.groupBy("source_id").agg(F.count_distinct("url").alias("documents"), F.count("*").alias("rows"))


def counted_sources(sources: DataFrame, chunks: DataFrame, code: DataFrame) -> DataFrame:
    """As ``source_stats``, from both tables' ``counts``."""
    pages = chunks.withColumnsRenamed({"documents": "total_documents", "rows": "total_chunks"})
    examples = code.withColumnsRenamed({"documents": "total_code_examples", "rows": "code_example_rows"})
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sources.join(pages, "source_id", "left").join(examples, "source_id", "left").select(
        "source_id", "summary", F.coalesce("total_word_count", F.lit(0)).alias("word_count"), zero("total_documents"), zero("total_chunks"), zero("total_code_examples"), zero("code_example_rows"),
        F.coalesce("updated_at", "created_at").alias("last_updated"),
    )


def source_exists(sources: DataFrame, chunks: DataFrame, code: DataFrame, source_id: str) -> DataFrame:
    """The statistics of one source; no row for an unknown one. The filter reaches all three scans."""
    one = lambda df: df.filter(F.col("source_id") == source_id)
    return source_stats(one(sources), one(chunks), one(code))


def source_texts(pages: DataFrame, source: str = "source_id", text: str = "markdown", order: str = "url") -> DataFrame:
    """source_id, text (10 000 characters of the joined pages at most), word_count of all pages; a page's ``order`` is its key.

    Words are summed page by page. For the text only keys and lengths are ranked, and each task keeps the first pages of a
    source that could matter: each adds its separator at least, so no more than half the limit do. Texts are joined to the
    pages that are left, so a source of any size costs no task more than that.
    """
    limit, gap = 10_000, "\n\n"
    keyed = pages.select(F.col(source).alias("source_id"), F.col(order).alias("_key"), F.col(text).alias("_text"))
    counts = keyed.groupBy("source_id").agg(F.sum(F.size(F.filter(F.split("_text", r"\s+"), lambda w: w != ""))).alias("word_count"))
    by = Window.partitionBy("source_id").orderBy("_key")
    sizes = keyed.select("source_id", "_key", (F.coalesce(F.length("_text"), F.lit(0)) + len(gap)).alias("_n"))
    first = sizes.withColumn("_place", F.row_number().over(by)).filter(F.col("_place") <= limit // len(gap) + 1)
    before = F.coalesce(F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    needed = first.withColumn("_before", before).filter(F.col("_before") < limit).select("source_id", "_key")
    parts = keyed.select("source_id", "_key", F.left("_text", F.lit(limit)).alias("_head")).join(needed, ["source_id", "_key"])
    joined = parts.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("_key", "_head"))).alias("_parts"))
    texts = joined.select("source_id", F.left(F.array_join(F.transform("_parts", lambda p: p["_head"]), gap), F.lit(limit)).alias("text"))
    return texts.join(counts, "source_id")


def duplicates(df: DataFrame) -> DataFrame:
    """Keys (url, chunk_number) that more than one row has: empty in a sound table."""
    return df.groupBy("url", "chunk_number").count().filter("count > 1")


def with_fence_language(code: DataFrame) -> DataFrame:
    """The language of a code example's opening fence in its metadata, over any that stood there; all else keeps its type.

    Metadata that is no object becomes one of the language alone.
    """
    old = F.try_variant_get("metadata", "$", "map<string,variant>")
    rest = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,variant>")), lambda k, v: k != "language")
    language = F.to_json(F.create_map(F.lit("language"), fence_language(F.col("content"))))
    body = F.to_json(rest)  # values are written as the JSON that they are
    merged = F.when(F.size(rest) == 0, language).otherwise(F.concat(F.left(language, F.length(language) - 1), F.lit(","), F.substring(body, F.lit(2), F.length(body))))
    return code.withColumn("metadata", F.parse_json(merged))


#: Values of a row's address, the part of its URL's hash that decides its bucket however many there are.
ADDRESSES = 1 << 24


def address(key: Column) -> Column:
    return F.xxhash64(key).bitwiseAND(ADDRESSES - 1).cast("int")


def bucket(at: Column, n: int) -> Column:
    """The bucket of an address among ``n``: by as many bits as n needs, by one less where that bucket isn't split off yet."""
    high = 1 << (n - 1).bit_length()
    return F.when(at % high < n, at % high).otherwise(at % max(1, high // 2))


def bucket_of(at: int, n: int) -> int:
    high = 1 << (n - 1).bit_length()
    return at % high if at % high < n else at % max(1, high // 2)


def parent(b: int) -> int:
    """The bucket that ``b`` is split off from."""
    return b - (1 << (b.bit_length() - 1))


@dataclass(frozen=True)
class Group:
    """Rows and their postings, in the same buckets by a hash of ``key``; ``indexed`` columns make the postings' text."""

    rows: str
    key: str
    indexed: tuple[str, ...] = ()

    def schema(self, what: str) -> str:
        if what == "tombstones":
            return "key string, seq long"
        if what == "codes":
            return vector_index.CODES
        if what == "leaves":
            return metadata_index.LEAVES
        return f"{self.rows if what == 'rows' else schemas.POSTINGS}, address int, seq long"


STATS = "source_id string, documents long, rows long"


class Snapshot:
    """All tables of a store in one state."""

    def __init__(self, store: Store, number: int, groups: dict):
        self.store, self.spark, self.number, self.groups = store, store.spark, number, groups

    def group(self, name: str) -> dict:
        """n (buckets), parts (id, seq, bytes of tombstones, buckets: bytes of rows, postings, codes and leaves by bucket), stats (ids of parts), index."""
        return self.groups.get(name) or {"n": self.store.buckets, "parts": [], "stats": []}

    def holders(self, name: str) -> dict[int, list[dict]]:
        """The parts of each bucket, in the order of their writes."""
        out: dict[int, list[dict]] = {}
        for part in self.group(name)["parts"]:
            for b in part["buckets"]:
                out.setdefault(int(b), []).append(part)
        return out

    def _scan(self, name: str, what: str, folders: list[str]) -> DataFrame:
        schema = self.store.GROUPS[name].schema(what)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.store.root}/{name}/{f}" for f in folders])

    def live(self, name: str, what: str = "rows", buckets: set[int] | None = None) -> DataFrame:
        """The rows (or postings, codes, leaves) that no later write has replaced, with address and seq; of some buckets only those are read."""
        place = ("rows", "postings", "codes", "leaves").index(what)
        clean, merged, dead, tombstones = [], [], [], {}
        for b, parts in sorted(self.holders(name).items()):
            if buckets is not None and b not in buckets:
                continue
            there = [f"{p['id']}/{what}/bucket={b}" for p in parts if p["buckets"][str(b)][place]]
            if len(parts) == 1:
                clean += there
            else:
                merged += there
                dead += [f"{p['id']}/tombstones/bucket={b}" for p in parts[1:]]
                tombstones |= {p["id"]: p["tombstones"] for p in parts[1:]}
        out = self._scan(name, what, clean)
        if not merged:
            return out
        last = self._scan(name, "tombstones", dead).groupBy(F.col("key").alias(self.store.GROUPS[name].key)).agg(F.max("seq").alias("_last"))
        if sum(tombstones.values()) <= self.store.BROADCAST_BYTES:  # else a shuffle join
            last = F.broadcast(last)
        key = self.store.GROUPS[name].key
        rows = self._scan(name, what, merged)
        kept = rows.join(last, key, "left").filter("_last IS NULL OR seq >= _last").select(*rows.columns)
        return out.unionByName(kept) if clean else kept

    def read(self, table: str, buckets: set[int] | None = None, addressed: bool = False) -> DataFrame:
        """A table's rows; ``addressed``: with the address by which ``fetch`` finds them."""
        name, what = self.store.TABLES[table]
        out = self.live(name, what, buckets)
        return out.drop("seq") if addressed else out.drop("seq", "address")

    def fetch(self, table: str, found: Sequence[tuple[int, int]]) -> DataFrame:
        """The rows of a few (id, address): only their buckets are listed, where rows lie by id, so that bounds of row groups and pages skip most."""
        name, what = self.store.TABLES[table]
        n = self.group(name)["n"]
        rows = self.live(name, what, {bucket_of(at, n) for _, at in found})
        return rows.filter(F.col("id").isin([i for i, _ in found])).drop("seq", "address")

    def where(self, table: str, wanted: dict[str, Any] | None, source: str | None = None) -> DataFrame:
        """The rows, with addresses, of a source whose metadata holds ``wanted``: only buckets that have all its leaves are read."""
        name, _ = self.store.TABLES[table]
        held = metadata_index.holding(self.live(name, "leaves"), wanted) if wanted else None
        buckets = None
        if held is not None:
            at = held.select(bucket(F.col("address"), self.group(name)["n"]).alias("b")).distinct()
            buckets = {r.b for r in at.collect()}  # at most as many as there are buckets
        return filters.where_metadata(self.read(table, buckets, addressed=True), wanted, source)

    def nearest(self, table: str, query: Sequence[float], n: int) -> list[tuple[int, int]] | None:
        """(id, address) of n rows near a vector or, where the index needs more candidates, as many; None where there is none, or not n rows in it."""
        name, _ = self.store.TABLES[table]
        if not self.group(name).get("index"):
            return None
        index = self.store.index(name, self.group(name)["index"])
        found = index.nearest(self.live(name, "codes"), query, max(n, index.candidates_for(-(-n // vector_index.TAKEN))))
        return found if len(found) >= n else None

    def nearest_batched(self, table: str, queries: Sequence[tuple[int, Sequence[float]]], k: int) -> DataFrame:
        """query_id, id, similarity, rank: the k best of each query's candidates by the index, ranked exactly by their vectors."""
        name, what = self.store.TABLES[table]
        index = self.store.index(name, self.group(name)["index"])
        codes, found = self.live(name, "codes"), None
        for block in index.blocks(queries):
            part = index.candidates(codes, block, index.candidates_for(k)).select("query_id", "id")
            found = part if found is None else found.unionByName(part)
        asked = self.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in queries], "query_id long, query array<double>")  # a block
        rows = self.live(name, what).select("id", "embedding")
        near = found.join(rows, "id").join(F.broadcast(asked), "query_id").withColumn("similarity", vector.cosine(F.col("embedding"), F.col("query")))
        by = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity"), "id")
        return near.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "id", "similarity", "rank")

    def counts(self, name: str) -> DataFrame:
        """source_id, documents, rows of a group: what each write has added and taken away; no row of the group is read."""
        parts = self.group(name)["stats"]
        if not parts:
            return self.spark.createDataFrame([], STATS)
        kept = self.spark.read.schema(STATS).parquet(*[f"{self.store.root}/{name}/{p}/stats" for p in parts])
        out = kept.groupBy("source_id").agg(F.sum("documents").alias("documents"), F.sum("rows").alias("rows"))
        return out.filter("rows <> 0 OR documents <> 0")

    def stats(self, source_id: str | None = None) -> DataFrame:
        """Each source's statistics, or one's."""
        one = lambda df: df if source_id is None else df.filter(F.col("source_id") == source_id)
        return counted_sources(one(self.read("sources")), one(self.counts("chunks")), one(self.counts("code_examples"))).orderBy("source_id")


class Store:
    """The tables' parts and manifests under a folder. The last ``keep`` states, and all younger than ``keep_seconds``, can still be read."""

    GROUPS = {"sources": Group(schemas.SOURCES, "source_id"), "chunks": Group(schemas.CHUNKS, "url", ("content",)), "code_examples": Group(schemas.CODE_EXAMPLES, "url", ("content", "summary"))}
    TABLES = {"sources": ("sources", "rows"), "chunks": ("chunks", "rows"), "code_examples": ("code_examples", "rows"), "chunk_postings": ("chunks", "postings"), "code_postings": ("code_examples", "postings")}
    TRIES = 5
    #: A bucket is compacted at so many later parts, or where those have this share of the first one's bytes.
    MOST_PARTS, SHARE = 8, 0.5
    #: Statistics of so many writes are summed into one.
    MOST_STATS = 32
    #: Bytes of tombstones that are sent to all tasks.
    BROADCAST_BYTES = 16 << 20

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16, keep: int = 3, analyzer: fts.Analyzer | None = None, keep_seconds: float = 3600.0, bucket_bytes: int = 1 << 30, compacts: bool = True):
        self.spark, self.root, self.buckets, self.keep, self.keep_seconds = spark, root.rstrip("/"), buckets, keep, keep_seconds
        self.bucket_bytes, self.compacts = bucket_bytes, compacts
        self.analyzer = analyzer or fts.Analyzer()
        self.files = Files(spark, self.root)
        self._indexes: dict[str, vector_index.VectorIndex] = {}

    # --- states ---

    def _manifests(self) -> list[str]:
        return self.files.names(f"{self.root}/manifests")

    def _manifest(self, name: str) -> dict:
        return json.loads(self.files.read(f"{self.root}/manifests/{name}"))

    def snapshot(self) -> Snapshot:
        found = self._manifests()
        return Snapshot(self, int(found[-1]), self._manifest(found[-1])["groups"]) if found else Snapshot(self, 0, {})

    def read(self, table: str, buckets: set[int] | None = None) -> DataFrame:
        """A table's current rows; for several tables of one state take a ``snapshot``."""
        return self.snapshot().read(table, buckets)

    def stats(self, source_id: str | None = None) -> DataFrame:
        return self.snapshot().stats(source_id)

    def _commit(self, number: int, groups: dict) -> bool:
        done = self.files.commit(f"{self.root}/manifests/{number:012d}", json.dumps({"time": time.time(), "groups": groups}))
        if done:
            self._forget()
        return done

    @staticmethod
    def _named(manifests: Sequence[dict]) -> set[tuple[str, str, str]]:
        """(group, part, bucket) of all parts that manifests name; an empty bucket for a part's statistics."""
        out = set()
        for m in manifests:
            for name, g in m["groups"].items():
                out |= {(name, p["id"], b) for p in g["parts"] for b in p["buckets"]} | {(name, p, "") for p in [*g["stats"], *([g["index"]] if g.get("index") else [])]}
        return out

    def _forget(self) -> None:
        """Delete the states that need no longer be kept, and what only those name."""
        found, old = self._manifests(), []
        for name in found[: -self.keep]:
            m = self._manifest(name)
            if m["time"] > time.time() - self.keep_seconds:
                break
            old.append((name, m))
        if not old:
            return
        kept = self._named([self._manifest(n) for n in found[len(old) :]])
        parts = {(name, p) for name, p, _ in kept}
        for name, part, b in self._named([m for _, m in old]) - kept:
            if (name, part) not in parts:
                self.files.delete(f"{self.root}/{name}/{part}")
                continue
            for what in ("rows", "postings", "codes", "leaves", "tombstones") if b else ("stats",):
                self.files.delete(f"{self.root}/{name}/{part}/{what}" + (f"/bucket={b}" if b else ""))
        for name, _ in old:
            self.files.delete(f"{self.root}/manifests/{name}")

    def vacuum(self) -> None:
        """Delete what failed writes have left: parts that no manifest names, and staged rows. No writer may run meanwhile."""
        parts = {(name, p) for name, p, _ in self._named([self._manifest(n) for n in self._manifests()])}
        for name in self.GROUPS:
            for part in self.files.names(f"{self.root}/{name}"):
                if (name, part) not in parts:
                    self.files.delete(f"{self.root}/{name}/{part}")
        self.files.delete(f"{self.root}/staged")

    def _again(self, once: Callable[[], bool]) -> None:
        for _ in range(self.TRIES):
            if once():
                return
        raise RuntimeError(f"other writers came first {self.TRIES} times")

    # --- writing ---

    def staged(self, df: DataFrame) -> tuple[DataFrame, str]:
        """The rows, written once, so that what makes them doesn't run again; and the folder to delete."""
        folder = f"{self.root}/staged/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder), folder

    def _cut(self, df: DataFrame, path: str, n: int, sort: list[str]) -> dict[str, int]:
        """Write by bucket; the bytes of each. A large bucket is dealt to several tasks, small ones go to one together."""
        cut = df.withColumn("bucket", bucket(F.col("address"), n)).hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", *sort)
        cut.write.partitionBy("bucket").parquet(path)
        return {k.removeprefix("bucket="): v for k, v in self.files.sizes(path).items() if k.startswith("bucket=")}

    def _part(self, name: str, rows: DataFrame, n: int, seq: int, postings: DataFrame | None, codes: DataFrame | None, leaves: DataFrame | None, replaces: DataFrame | None) -> dict:
        """Write a part: rows with address and seq, their postings, codes and leaves, and tombstones for the keys of ``replaces``."""
        part, g = uuid.uuid4().hex, self.GROUPS[name]
        path = f"{self.root}/{name}/{part}"
        keys = replaces.select(F.col(g.key).alias("key"), "address").distinct().withColumn("seq", F.lit(seq).cast("long")) if replaces is not None else None
        order = ["id"] if "id" in rows.columns else [g.key]
        wanted = {"rows": (rows, order), "postings": (postings, fts.order()), "codes": (codes, ["cell", "id"]), "leaves": (leaves, ["leaf", "id"]), "tombstones": (keys, ["key"])}
        with ThreadPoolExecutor(len(wanted)) as pool:  # none reads what another writes
            jobs = {what: pool.submit(inheritable_thread_target(self.spark)(self._cut), df, f"{path}/{what}", n, sort) for what, (df, sort) in wanted.items() if df is not None}
            sizes = {what: job.result() for what, job in jobs.items()}
        tombstones = sum(sizes.get("tombstones", {}).values())
        of = lambda b: [sizes.get(what, {}).get(b, 0) for what in ("rows", "postings", "codes", "leaves")]
        return {"id": part, "seq": seq, "tombstones": tombstones, "buckets": {b: of(b) for b in sizes["rows"]}}

    def _upserted(self, snap: Snapshot, name: str, rows: DataFrame) -> dict:
        """The group of ``snap`` with a part of ``rows`` in place of all rows of their keys."""
        g, old, seq = self.GROUPS[name], snap.group(name), snap.number + 1
        new = rows.withColumns({"address": address(F.col(g.key)), "seq": F.lit(seq).cast("long")})
        postings = None
        if g.indexed:
            postings = fts.postings(new.withColumn("_text", F.concat_ws(" ", *g.indexed)), "id", "_text", self.analyzer, keep=["url", "address", "seq"])
        codes = self.index(name, old["index"]).codes(new) if old.get("index") else None
        part = self._part(name, new, old["n"], seq, postings, codes, metadata_index.leaves(new) if g.indexed else None, new)
        stats = old["stats"]
        if g.indexed:
            gone = snap.live(name, "rows", {int(b) for b in part["buckets"]}).select("url", "source_id").join(rows.select("url").distinct(), "url", "left_semi")
            lost = counts(gone).select("source_id", (-F.col("documents")).alias("documents"), (-F.col("rows")).alias("rows"))
            self._write_stats(counts(rows).unionByName(lost), f"{self.root}/{name}/{part['id']}/stats")
            stats = [*stats, part["id"]]
        return old | {"parts": [*old["parts"], part], "stats": stats}

    @staticmethod
    def _write_stats(changes: DataFrame, path: str) -> None:
        changes.groupBy("source_id").agg(F.sum("documents").alias("documents"), F.sum("rows").alias("rows")).coalesce(1).write.parquet(path)  # a row a source

    def _add(self, name: str, rows: DataFrame, now: Column) -> int:
        staged, folder = self.staged(rows.select(*self.spark.createDataFrame([], self.GROUPS[name].rows).columns))
        try:
            n = staged.count()
            if n:

                def once() -> bool:
                    snap = self.snapshot()
                    groups = dict(snap.groups)
                    known = snap.read("sources")
                    missing = with_missing_sources(known.limit(0), staged.join(known, "source_id", "left_anti"), now)
                    if not missing.isEmpty():
                        groups["sources"] = self._upserted(snap, "sources", missing)
                    groups[name] = self._upserted(snap, name, staged)
                    return self._commit(snap.number + 1, groups)

                self._again(once)
                if self.compacts:
                    self.compact(name)
            return n
        finally:
            self.files.delete(folder)

    def add_chunks(self, rows: DataFrame, now: Column) -> int:
        """Replace all chunks of the rows' URLs; sources that are missing are made first. The number of rows added."""
        return self._add("chunks", rows, now)

    def add_code(self, rows: DataFrame, now: Column) -> int:
        return self._add("code_examples", with_fence_language(rows), now)

    def update_sources(self, rows: DataFrame, now: Column) -> None:
        staged, folder = self.staged(rows)

        def once() -> bool:
            snap = self.snapshot()
            known = snap.read("sources").join(staged.select("source_id"), "source_id", "left_semi")
            return self._commit(snap.number + 1, snap.groups | {"sources": self._upserted(snap, "sources", updated_sources(known, staged, now))})

        try:
            self._again(once)
            if self.compacts:
                self.compact("sources")
        finally:
            self.files.delete(folder)

    # --- compaction ---

    def _worn(self, snap: Snapshot, name: str) -> set[int]:
        """The buckets whose later parts have grown."""
        out = set()
        for b, parts in snap.holders(name).items():
            sizes = [sum(p["buckets"][str(b)]) for p in parts]
            if len(parts) > self.MOST_PARTS or sum(sizes[1:]) > self.SHARE * sizes[0]:
                out.add(b)
        return out

    def index(self, name: str, part: str) -> vector_index.VectorIndex:
        """A group's vector index, read once."""
        if part not in self._indexes:
            self._indexes[part] = vector_index.VectorIndex.load(bytes(self.spark.read.parquet(f"{self.root}/{name}/{part}").first()[0]))
        return self._indexes[part]

    def build_index(self, name: str) -> bool:
        """Fit a vector index to a group's rows and code them all, as a compaction of everything. Later writes code what they add."""
        fitted = vector_index.fit(self.snapshot().live(name).select("id", "embedding"))
        if fitted is None:
            return False
        part = uuid.uuid4().hex
        self.spark.createDataFrame([(bytearray(fitted.dump()),)], "model binary").coalesce(1).write.parquet(f"{self.root}/{name}/{part}")
        self._again(lambda: self.compact(name, True, part))
        return True

    def compact(self, name: str, everything: bool = False, index: str | None = None) -> bool:
        """Rewrite worn buckets (or all of several parts) without dead rows, and split buckets where they hold too much on the average.

        Whether that was needed and no other writer came first; else all stays as it is. A new ``index`` codes all rows anew.
        """
        snap = self.snapshot()
        g = snap.group(name)
        total = sum(sum(x) for p in g["parts"] for x in p["buckets"].values())
        n = max(g["n"], min(2 * g["n"], -(-total // self.bucket_bytes), ADDRESSES))
        touched = {b for b, parts in snap.holders(name).items() if len(parts) > 1} if everything else self._worn(snap, name)
        touched |= {parent(b) for b in range(g["n"], n)} | (set(snap.holders(name)) if index else set())
        if not touched and len(g["stats"]) <= self.MOST_STATS:
            return False
        parts = [p | {"buckets": {b: x for b, x in p["buckets"].items() if int(b) not in touched}} for p in g["parts"]]
        parts = [p for p in parts if p["buckets"]]
        if touched:
            postings = snap.live(name, "postings", touched) if self.GROUPS[name].indexed else None
            rows = snap.live(name, "rows", touched)
            codes = self.index(name, index).codes(rows) if index else snap.live(name, "codes", touched) if g.get("index") else None
            leaves = snap.live(name, "leaves", touched) if self.GROUPS[name].indexed else None
            made = self._part(name, rows, n, snap.number + 1, postings, codes, leaves, None)
            parts = [made, *parts] if made["buckets"] else parts
        stats = g["stats"]
        if len(stats) > self.MOST_STATS:
            stats = [uuid.uuid4().hex]
            self._write_stats(snap.counts(name), f"{self.root}/{name}/{stats[0]}/stats")
        return self._commit(snap.number + 1, snap.groups | {name: g | {"n": n, "parts": parts, "stats": stats} | ({"index": index} if index else {})})
