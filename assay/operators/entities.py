"""Parsed entities into the stored tables: new contents only, ids that go on, parents' ids handed down."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.operators.resolve import first_of
from assay.sources.schema import KEYS
from assay.sources.sinks import discard, freed, staged
from assay.sources.store import BATCH, SCOPE, Store

#: Longs in a filter of keys (64 bits each; half a megabyte), bits a key sets, keys from which on a filter would let nearly all through, parts in which a repository's new rows are numbered.
WORDS, PROBES, MOST, PARTS = 65_536, 3, 65_536 * 8, 65_536


def _probes(key: Column) -> list[tuple[Column, Column]]:
    hashes = [F.xxhash64(key, F.lit(i)) for i in range(PROBES)]
    return [(F.pmod(h, F.lit(WORDS)).cast("int"), F.pmod(F.shiftrightunsigned(h, 40), F.lit(64)).cast("int")) for h in hashes]


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """One row: a Bloom filter of the keys (whole numbers) as an array of ``WORDS`` longs, whatever their number."""
    bits = keys.select(F.explode(F.array(*(F.struct(w.alias("w"), b.alias("b")) for w, b in _probes(F.col(key))))).alias("p"))
    words = bits.groupBy("p.w").agg(F.bit_or(F.expr("shiftleft(1L, p.b)")).alias("b"))
    every = keys.sparkSession.range(WORDS).select(F.col("id").cast("int").alias("w")).join(words, "w", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0).cast("long")).alias("b")))), lambda x: x["b"]).alias("words"))


def maybe_in(filtered: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key may be among those of a ``key_filter``; rows that aren't go before any shuffle."""
    out = filtered
    for word, bit in _probes(F.col(key)):
        out = out.where(F.getbit(F.get(keys.scalar(), word), bit) == 1)
    return out


def numbered(rows: DataFrame, last: DataFrame, order: str, name: str = "id") -> DataFrame:
    """Consecutive ids in each repository after its last (``last``: repo_id, last). A repository is numbered in ``PARTS`` parts, so that a huge one spreads. ``rows`` are read twice."""
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(PARTS)))
    counts = dealt.groupBy(SCOPE, "_part").count().join(F.broadcast(last), SCOPE, "left")  # one row a repository
    before = F.sum("count").over(Window.partitionBy(SCOPE).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(SCOPE, "_part", (F.coalesce(before, F.lit(0)) + F.coalesce("last", F.lit(0))).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part", SCOPE).orderBy(order))
    return dealt.withColumn("_place", place).join(starts, ["_part", SCOPE]).withColumn(name, F.col("_start") + F.col("_place")).drop("_part", "_place", "_start")


@dataclass(frozen=True)
class Entity:
    """Rows of a table to come: repo_id, guid, the table's columns, and ``parent``, the guid of what ``refers`` (table, column) names. A table without guids goes by content_hash. ``content``: the columns of which content_hash is made, if the rows don't have it; it is made after parents are joined, which needn't shuffle it."""

    table: str
    rows: DataFrame
    refers: tuple[str, str] | None = None
    content: tuple[str, ...] = ()


def ingest(store: Store, batch: int, entities: Iterable[Entity]) -> dict[str, DataFrame]:
    """Write the new rows of each entity as one batch of its table, parents before children.

    A row is new if no stored row of its repository has its key (``KEYS``); of equal ones the first by guid is stored. Stored keys
    are narrowed by a Bloom filter of the batch's keys, where these are few enough for one, before they are joined; many rows that nothing refers to are used once and so not staged. Rows are grouped, joined
    and so sorted by a hash of their key first: by repository, of which there are few, each comparison would go on to the hex digits. Ids go on after the repository's last. Rows
    whose parent is neither in the batch nor stored are left out. Hashes made here are shuffled and staged as bytes, half the size of their digits. What is staged for one table is deleted before the next, but for the ids. Returns repo_id, guid, id of every row of the batch by table,
    those stored before included. A batch that is run again gives the same rows and ids.
    """
    entities = list(entities)
    referred = [e.refers[0] for e in entities if e.refers]
    ids: dict[str, DataFrame] = {}
    for entity in entities:
        table, rows, keys = entity.table, entity.rows, [SCOPE, *KEYS[entity.table]]
        hashed = ["_key", *keys]
        packed = (lambda df: df.withColumn("content_hash", F.unhex("content_hash"))) if entity.content else lambda df: df
        stored = store.read(table, without=batch)
        if entity.refers:
            rows = _with_parent(rows, store, batch, ids, *entity.refers)
        if entity.content:
            rows = packed(rows.withColumn("content_hash", F.sha2(F.concat_ws("|", *entity.content), 256)))
        rows = rows.withColumn("_key", F.xxhash64(*keys))
        if again := table in referred or _count(entity.rows) <= MOST:
            rows = staged(rows, f"rows-{table}")
        spent = [rows] if table in referred else []
        first = first_of(rows, hashed, "guid")
        if store.batches(table) in ([], [batch]):
            first = first.withColumn("_id", F.lit(None).cast("long"))
        else:
            near = packed(stored.select("id", *keys)).withColumn("_key", F.xxhash64(*keys))
            if again and rows.count() <= MOST:
                spent.append(words := staged(key_filter(rows, "_key"), f"filter-{table}"))
                near = maybe_in(near, "_key", words)
            first = first.join(near.groupBy(*hashed).agg(F.min("id").alias("_id")), hashed, "left")
        spent.append(first := staged(first, f"first-{table}"))
        new = numbered(first.where("_id is null"), stored.groupBy(SCOPE).agg(F.max("id").alias("last")), "guid")
        if entity.content:
            new = new.withColumn("content_hash", F.lower(F.hex("content_hash")))
        schema = store.schemas[table]
        store.append(table, batch, new.select(*((F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields)))
        kept = packed(store.read(table).select(*keys, "id", BATCH)).withColumn("_key", F.xxhash64(*keys))
        if table in referred:
            known = kept.where(F.col(BATCH) == batch).drop(BATCH).unionByName(first.where("_id is not null").select(*hashed, F.col("_id").alias("id")))
        else:
            known = kept.groupBy(*hashed).agg(F.min("id").alias("id"))  # asked for after what is staged has gone
        found = rows.select("guid", *hashed).join(known, hashed, "left").select(SCOPE, "guid", "id")
        ids[table] = staged(found, f"ids-{table}") if table in referred else found
        discard(*spent)
    return ids


def _count(rows: DataFrame) -> int:
    with freed(rows.sparkSession):
        return rows.count()


def _with_parent(rows: DataFrame, store: Store, batch: int, ids: dict[str, DataFrame], parent: str, column: str) -> DataFrame:
    """``rows`` with the stored id of their parent, of this batch or an earlier one; those without one are left out."""
    named = "guid" if "guid" in store.schemas[parent].names else "content_hash"
    none = F.lit(None).cast("long")
    known = store.read(parent, without=batch).select(SCOPE, F.col(named).alias("parent"), none.alias("_now"), F.col("id").alias("_stored"))
    if parent in ids:
        known = known.unionByName(ids[parent].select(SCOPE, F.col("guid").alias("parent"), F.col("id").alias("_now"), none.alias("_stored")))
    keys = ["_up", "parent", SCOPE]
    least = known.withColumn("_up", F.xxhash64(SCOPE, "parent")).groupBy(*keys).agg(F.coalesce(F.min("_now"), F.min("_stored")).alias(column)).where(F.col(column).isNotNull())
    return rows.withColumn("_up", F.xxhash64(SCOPE, "parent")).join(least, keys).drop("_up", "parent")
