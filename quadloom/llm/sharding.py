"""Sharding by a hierarchical weighted hash tree.

The root has regions, a region has `region` racks and a rack has `rack` shards.
Weights are relative to a node's siblings. Regions send arrivals: the first after an
exponential time from a hash of (doc_id, region) with the region's weight as its
rate, the next ones likewise. An arrival descends from its region: at each level each child
draws an exponential time from a hash of (doc_id, child, arrival) with its weight
as its rate, and the least draw is followed, to a rack and then to a shard. The
document goes where the earliest arrival goes that reaches a shard that exists.

Regions are filled in turn, so all but the last accept their first arrival, and a
document costs one draw a region, rack and shard on its way. A new weight changes
the draws of its node only: rows move only between it and its siblings' subtrees,
into it or out of it. One more shard makes an arrival of its region count that did
not before, so rows move only into the new shard (the law `key`). Of `ARRIVALS` arrivals of the last region one is
taken, or, where there is no other region, the shards draw directly; that keeps the law.

Slots number a shard's documents from 0 without gaps, in the order (part, doc_id)
where parts are hash ranges of the shard, of about `PART_ROWS` documents at most;
equal rows are counted first and numbered as ranges of at most `PART_ROWS`, which are
dealt out anew, so no shard or repeated row needs one task.

Cases: a null text has no bytes and the checksum of an empty one; a null doc_id
is placed as the text `null`; repeated rows share a shard and get a slot each;
extra columns are not read; an empty table gives an empty result. Nodes of weight 0
take nothing. Whole documents keep a column named `shard`: the shard is then in `shard_1`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadloom.llm.duck import CRC_TABLE, crc32
from quadloom.llm.scratch import Scratch

SHARDS, LAW = 24, "key"
#: Shards of a rack and racks of a region.
RACK, REGION = 4, 3
#: Arrivals of a region that is not full.
ARRIVALS = 64
#: Parts in which each shard is numbered, at least, and the documents from which on there are more.
PARTS, PART_ROWS = 64, 100_000


@dataclass(frozen=True)
class Tree:
    """`shards` leaves; weights by the number of a shard, rack or region (1 where absent), relative to its siblings."""

    shards: int = SHARDS
    rack: int = RACK
    region: int = REGION
    shard_weights: dict[int, float] = field(default_factory=dict)
    rack_weights: dict[int, float] = field(default_factory=dict)
    region_weights: dict[int, float] = field(default_factory=dict)


def _draw(key: Column, level: str, node: Column, arrival: Column) -> Column:
    """An exponential time of mean 1, from 52 bits of a hash."""
    digest = F.md5(F.concat_ws("|", key, F.lit(level), node.cast("string"), arrival.cast("string")))
    return -F.log((F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52)))


def _weight(node: Column, weights: dict[int, float]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for k, v in weights.items() for x in (int(k), float(v))])[node], F.lit(1.0)) if weights else F.lit(1.0)


def _least(key: Column, level: str, first: Column, n: int, weights: dict[int, float], arrival: Column) -> Column:
    """(time, node) of the least draw of n nodes from `first`; of equal times the lower node."""
    nodes = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: first + i)
    if weights:
        nodes = F.filter(nodes, lambda c: _weight(c, weights) > 0)
    return F.array_min(F.transform(nodes, lambda c: F.struct((_draw(key, level, c, arrival) / _weight(c, weights)).alias("time"), c.alias("node"))))


def _once(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _below(key: Column, tree: Tree, region: Column, arrival: Column) -> Column:
    """The shard to which an arrival of a region descends."""
    rack = _least(key, "rack", region * tree.region, tree.region, tree.rack_weights, arrival)["node"]
    return _once(rack, lambda r: _least(key, "shard", r * tree.rack, tree.rack, tree.shard_weights, arrival)["node"])


def descent(key: Column, tree: Tree) -> Column:
    """The shard of a key."""
    full, rest = divmod(tree.shards, tree.rack * tree.region)
    zero = F.lit(0)
    some = None
    if rest and tree.region_weights.get(full, 1.0) > 0:
        rate = F.lit(float(tree.region_weights.get(full, 1.0)))

        def next_one(state: Column, arrival: Column) -> Column:
            time = state["time"] + _draw(key, "region", F.lit(full), arrival) / rate
            hit = _once(_below(key, tree, F.lit(full), arrival), lambda s: F.when(s < tree.shards, s).otherwise(-1))
            return F.when(state["shard"] >= 0, state).otherwise(F.struct(time.alias("time"), hit.alias("shard")))

        some = F.aggregate(F.sequence(zero, F.lit(ARRIVALS - 1)), F.struct(F.lit(0.0).alias("time"), F.lit(-1).alias("shard")), next_one)
    if not full:
        direct = _least(key, "leaf", zero, tree.shards, tree.shard_weights, zero)["node"]
        return (direct if some is None else _once(some, lambda s: F.when(s["shard"] >= 0, s["shard"]).otherwise(direct))).cast("int")
    best = _least(key, "region", zero, full, tree.region_weights, zero)
    if some is None:
        return _once(best, lambda b: _below(key, tree, b["node"], zero)).cast("int")
    both = F.struct(best.alias("best"), some.alias("some"))
    won = lambda s: (s["some"]["shard"] >= 0) & (s["best"].isNull() | (s["some"]["time"] < s["best"]["time"]))
    return _once(both, lambda s: F.when(won(s), s["some"]["shard"]).otherwise(_below(key, tree, s["best"]["node"], zero))).cast("int")


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))


def parts(n_rows: int, shards: int) -> int:
    return max(PARTS, n_rows // (shards * PART_ROWS) + 1)


def numbered(rows: DataFrame, n_parts: int = PARTS) -> DataFrame:
    """`rows` (with doc_id and shard) with `slot`: the number of each row in its shard, from 0 without gaps."""
    names = [c for c in rows.columns if c != "shard"]
    place = F.conv(F.substring(F.md5(F.concat(F.lit("slot|"), _key())), 1, 8), 16, 10).cast("long")
    kinds = rows.groupBy(rows.columns).agg(F.count("*").alias("times")).withColumn("part", F.pmod(place, F.lit(n_parts)))
    kinds = Scratch(rows.sparkSession, "sharding").write("kinds", kinds)  # read twice; the descent is computed once
    sizes = kinds.groupBy("shard", "part").agg(F.sum("times").alias("n"))  # one row a part
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "part").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    placed = kinds.withColumn("ahead", F.coalesce(F.sum("times").over(order), F.lit(0))).join(starts, ["shard", "part"])
    first = (F.col("start") + F.col("ahead")).alias("first")
    ranges = placed.select(*rows.columns, "part", first, "times", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(PART_ROWS).cast("long"))).alias("from"))
    dealt = ranges.repartition("shard", "part", "from")
    last = F.least("times", F.col("from") + PART_ROWS) - 1
    return dealt.select(*rows.columns, F.explode(F.sequence(F.col("first") + F.col("from"), F.col("first") + last)).alias("slot"))


def assign(docs: DataFrame, tree: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (with one shard more) of every document."""
    tree = tree or Tree()
    grown = Tree(tree.shards + 1, tree.rack, tree.region, tree.shard_weights, tree.rack_weights, tree.region_weights)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    placed = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        descent(_key(), tree).alias("shard"),
        descent(_key(), grown).alias("grown_shard"),
    )
    return numbered(placed, parts(docs.count(), tree.shards)).select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", F.col("slot").cast("long"), "grown_shard")


def query(docs: DataFrame) -> DataFrame:
    return assign(docs)


def with_shards(docs: DataFrame, tree: Tree | None = None) -> DataFrame:
    """Whole documents with their shard in a last column: `shard`, or the first free of `shard_1`, `shard_2` ..."""
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in ("shard", *(f"shard_{i}" for i in range(1, len(taken) + 2))) if n not in taken)
    return docs.withColumn(name, descent(_key(), tree or Tree()))


def write(docs: DataFrame, path: str, tree: Tree | None = None) -> None:
    """One folder of Parquet files a shard: `shard=<n>`."""
    out = with_shards(docs, tree)
    out.write.mode("overwrite").partitionBy(out.columns[-1]).parquet(path)


def sql() -> str:
    """The same rows in DuckDB, from the default tree; the checksum is computed bit by bit."""

    def draw(level: str, node: str, arrival: str) -> str:
        return f"-ln((CAST('0x' || substr(md5(k || '|{level}|' || {node} || '|' || {arrival}), 1, 13) AS BIGINT) + 0.5) / {1 << 52}.0)"

    full = SHARDS // (RACK * REGION)
    assert SHARDS == full * RACK * REGION, "the last region of the smaller tree is full"
    return f"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, k, CAST(strlen(text) + 8 AS BIGINT) AS size, {crc32("text")} AS text_crc32 FROM d, tab),
keys AS (SELECT DISTINCT k FROM d),
came AS (SELECT k, r, a, sum({draw("region", "r", "a")}) OVER (PARTITION BY k, r ORDER BY a) AS time FROM keys, range({full + 1}) AS x(r), range({ARRIVALS}) AS y(a) WHERE r = {full} OR a = 0),
racks AS (SELECT k, r, a, time, arg_min(c, w) AS c FROM (SELECT *, {draw("rack", "c", "a")} AS w FROM (SELECT *, unnest(range(r * {REGION}, (r + 1) * {REGION})) AS c FROM came)) GROUP BY ALL),
leaves AS (SELECT k, r, a, time, arg_min(s, w) AS s FROM (SELECT *, {draw("shard", "s", "a")} AS w FROM (SELECT * EXCLUDE (c), unnest(range(c * {RACK}, (c + 1) * {RACK})) AS s FROM racks)) GROUP BY ALL),
own AS (SELECT k, arg_min(s, time) FILTER (s < {SHARDS}) AS shard, arg_min(s, time) FILTER (s < {SHARDS + 1}) AS grown_shard FROM leaves GROUP BY k),
n AS (SELECT greatest({PARTS}, count(*) // {SHARDS * PART_ROWS} + 1) AS parts FROM documents)
SELECT doc_id, size, text_crc32, '{LAW}' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5('slot|' || k), 1, 8) AS BIGINT) % parts, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM m JOIN own USING (k), n
"""
