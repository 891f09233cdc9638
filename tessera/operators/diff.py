"""Semantic difference of two snapshots by commutative fingerprints.

A fingerprint of the multiset of entries under a key is their number, the sums of both halves of a 64-bit hash of each,
and the exclusive or of a second one; entries of one snapshot count in full, those of the other negatively, so one
aggregate over both snapshots tells the keys that may differ: those for which anything is left. Only for these are
names, canonical JSON and lists made, and what proves equal in canonical form is dropped. Keys are 128-bit hashes of
names. So a difference goes unseen only if 64-bit hashes collide in both.

Edges know their ends by id, and to look up names for all of them would shuffle every edge three times. So ids are put
in place first: a node's place is its id, in the target less the ``shift`` that most ids have between the snapshots. A
name is steady if it has one node in each snapshot, in the same place. Edges between steady nodes have equal names
exactly if their ends have equal places; they are added up in fingerprints of BUCKETS buckets by the places of their
ends, before anything is shuffled. Only edges in buckets where something is left, and those that may have another end,
look up names. Any shift gives the same differences; if few ids run in parallel, more edges look up names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import canonical_json
from tessera.graph import PropertyGraph
from tessera.staging import stage

_KEY = ["k1", "k2"]
#: Buckets of edges whose fingerprints are compared before single edges are; of names, one in SHARE tells the shift.
BUCKETS, SHARE = 1 << 15, 64
#: Words of 64 bits of a sieve, at most: that many rows are broadcast. A full sieve lets more rows pass, and no fewer.
SIEVE = 1 << 18


def _snapshots(table: DataFrame, base: int, target: int) -> DataFrame:
    """Rows of both snapshots; ``sign`` is 1 for the base and -1 for the target."""
    return table.where(F.col("project_id").isin([base, target])).withColumn("sign", F.when(F.col("project_id") == base, 1).otherwise(-1))


def _named(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({"k1": F.xxhash64("label", "qualified_name"), "k2": F.xxhash64(F.lit(1), "qualified_name", "label")})


def _prints(content: list[Column]) -> dict[str, Column]:
    """The signed fingerprint of one entry, in narrow columns: its content is not carried any further."""
    first, second = F.xxhash64(*content), F.xxhash64(F.lit(1), *content)
    return {"n": F.col("sign"), "s": F.col("sign") * F.shiftright(first, 32), "t": F.col("sign") * first.bitwiseAND(F.lit(0xFFFFFFFF)), "x": second}


def _left_over(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Keys under which the signed fingerprints of the entries do not cancel out."""
    sums = entries.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in "nst"], F.bit_xor("x").alias("x"))
    return sums.where("n != 0 or s != 0 or t != 0 or x != 0").select(*keys)


def _sides(entries: DataFrame, keys: list[str], content: Column) -> DataFrame:
    """keys, before and after: the content of each side."""
    return entries.groupBy(*keys).agg(F.max(F.when(F.col("sign") == 1, content)).alias("before"), F.max(F.when(F.col("sign") == -1, content)).alias("after"))


def _hashed(column: str) -> str:
    return f"xxhash64(cast({column} as long))"


def _bits(column: str) -> Column:
    """Three bits, of 64, of a number's hash."""
    return F.expr(" | ".join(f"shiftleft(1L, cast(shiftright({_hashed(column)}, {k}) & 63 as int))" for k in (32, 40, 48)))


def _sieve(numbers: DataFrame) -> DataFrame:
    """The bits of all numbers of the only column, a row a word; numbers are dealt to words by other bits of their hash."""
    (column,) = numbers.columns
    return numbers.select(F.expr(f"pmod({_hashed(column)}, {SIEVE})").alias("_w"), _bits(column).alias("_b")).groupBy("_w").agg(F.bit_or("_b").alias("_bits"))


def _met(rows: DataFrame, sieve: DataFrame, column: str, into: str) -> DataFrame:
    """``rows`` with whether the sieve may hold the number in ``column``: no is certain. No row of them is shuffled."""
    told = rows.withColumn("_w", F.expr(f"pmod({_hashed(column)}, {SIEVE})")).join(F.broadcast(sieve), "_w", "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(_bits(column)) == _bits(column), F.lit(False))
    return told.withColumn(into, hit).drop("_w", "_bits")


def _shift(graph: PropertyGraph, base: int, target: int) -> int:
    """What most ids of the target are above those of the base, by a sample of the names."""
    some = _named(_snapshots(graph.nodes, base, target)).where(F.pmod("k1", F.lit(SHARE)) == 0)
    pairs = some.groupBy(*_KEY).agg(*[F.min(F.when(F.col("sign") == k, F.col("id"))).alias(n) for n, k in (("was", 1), ("is", -1))]).where("was is not null and `is` is not null")
    most = pairs.groupBy((F.col("is") - F.col("was")).alias("shift")).count().orderBy(F.desc("count"), "shift").first()
    return most["shift"] if most else 0


def _place(end: str, shift: int) -> Column:
    return F.when(F.col("sign") == 1, F.col(end)).otherwise(F.col(end) - F.lit(shift))


def _names_told(graph: PropertyGraph, base: int, target: int, source: Column, shift: int) -> DataFrame:
    """Names that ``differ`` in content or aren't ``steady``, with the number ``c`` of their nodes and the least and
    greatest of their places. Stored."""
    nodes = _named(_snapshots(graph.nodes, base, target)).withColumns(_prints([F.col("properties"), source]))
    told = nodes.select(*_KEY, *"nstx", _place("id", shift).alias("place")).groupBy(*_KEY).agg(
        *[F.sum(c).alias(c) for c in "nst"], F.bit_xor("x").alias("x"), F.count("*").alias("c"), F.min("place").alias("low"), F.max("place").alias("high")
    )
    told = told.select(*_KEY, "c", "low", "high", F.expr("n != 0 or s != 0 or t != 0 or x != 0").alias("differ"), F.expr("n = 0 and c = 2 and low = high").alias("steady"))
    return stage(told.where("differ or not steady"))


def _node_changes(graph: PropertyGraph, base: int, target: int, source: Column, told: DataFrame) -> DataFrame:
    differ = told.where("differ").select(*_KEY)
    form = F.to_json(F.struct(canonical_json(F.col("properties")).alias("properties"), source.alias("content_hash")))
    near = _met(_named(_snapshots(graph.nodes, base, target)), _sieve(differ.select("k1")), "k1", "_near").where("_near")
    few = near.join(differ, _KEY, "left_semi").select("sign", F.to_json(F.array("label", "qualified_name")).alias("identity"), form.alias("content"))
    return _sides(few, ["identity"], F.col("content")).select(F.lit("node").alias("kind"), "identity", "before", "after")


def _suspect_edges(graph: PropertyGraph, base: int, target: int, told: DataFrame, shift: int) -> DataFrame:
    """The edges that may differ, with all others of their names: those with an end that may not be steady, and those in
    buckets that differ. Stored."""
    loose = told.where("not steady")
    doubled = stage(loose.where("c > 2").select(*_KEY))  # mostly none: then no node is read for them
    many = _met(_named(_snapshots(graph.nodes, base, target)), _sieve(doubled.select("k1")), "k1", "_near").where("_near").join(doubled, _KEY, "left_semi").select(_place("id", shift).alias("place"))
    sieve = stage(_sieve(loose.select(F.explode(F.array("low", "high")).alias("place")).unionByName(many)))
    edges = _snapshots(graph.edges, base, target).select("source_id", "target_id", "edge_type", "project_id", "sign", "properties", "confidence")
    edges = edges.withColumns({"a": _place("source_id", shift), "b": _place("target_id", shift)})
    edges = _met(_met(edges, sieve, "a", "_a"), sieve, "b", "_b").withColumn("bucket", F.pmod(F.xxhash64("a", "b", "edge_type"), F.lit(BUCKETS)))
    content = [F.col(c) for c in ("a", "b", "edge_type", "properties", "confidence")]
    buckets = stage(_left_over(edges.where("not (_a or _b)").withColumns(_prints(content)).select("bucket", *"nstx"), ["bucket"]))
    return stage(edges.join(F.broadcast(buckets.withColumn("_left", F.lit(True))), "bucket", "left").where("_a or _b or _left").drop("a", "b", "_a", "_b", "bucket", "_left"))


def _edge_changes(graph: PropertyGraph, base: int, target: int, told: DataFrame, shift: int) -> DataFrame:
    edges = _suspect_edges(graph, base, target, told, shift)
    ids = edges.select("project_id", F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    near = _met(_named(_snapshots(graph.nodes, base, target)), _sieve(ids.select("id")), "id", "_near").where("_near")
    ends = stage(near.select("id", "project_id", *_KEY, "label", "qualified_name").join(ids, ["id", "project_id"], "left_semi"))
    entries = edges.withColumns(_prints([F.col("properties"), F.col("confidence")])).select("source_id", "target_id", "edge_type", "project_id", *"nstx")
    for side, (a, b) in (("source_id", ("a1", "a2")), ("target_id", ("b1", "b2"))):
        entries = entries.join(ends.select(F.col("id").alias(side), "project_id", F.col("k1").alias(a), F.col("k2").alias(b)), [side, "project_id"])
    keys = ["a1", "a2", "b1", "b2", "edge_type"]
    differ = stage(_left_over(entries, keys))
    few = edges
    for side, (a, b) in (("source", ("a1", "a2")), ("target", ("b1", "b2"))):
        named = ends.select(F.col("id").alias(f"{side}_id"), "project_id", F.col("k1").alias(a), F.col("k2").alias(b), F.col("label").alias(f"_{side}_l"), F.col("qualified_name").alias(f"_{side}_q"))
        few = few.join(named, [f"{side}_id", "project_id"])
    few = few.join(differ, keys, "left_semi")
    identity = F.to_json(F.array("_source_l", "_source_q", "edge_type", "_target_l", "_target_q"))
    one = F.struct(canonical_json(F.col("properties")).alias("properties"), "confidence")
    lists = few.groupBy(identity.alias("identity"), "sign").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("content"))
    return _sides(lists, ["identity"], F.col("content")).select(F.lit("edge").alias("kind"), "identity", "before", "after")


def changes(graph: PropertyGraph, base: int, target: int, include_source: bool = True) -> DataFrame:
    """kind, identity, change (added, removed or changed), before and after of all that differs.

    A node is known by label and qualified name, and differs in properties or, if ``include_source``, content hash; an
    edge by the names of its ends and its type, and parallel ones are one entry, the sorted list of their properties
    and confidences. Edges with an end in another project are left out.
    """
    known = {r["id"] for r in graph.projects.where(F.col("id").isin([base, target])).select("id").collect()}
    for p in (base, target):
        if p not in known:
            raise ValueError(f"Unknown project {p}")
    if base == target:
        return graph.spark.createDataFrame([], "kind string, identity string, change string, before string, after string")
    source = F.col("content_hash") if include_source else F.lit(None).cast("string")
    shift = _shift(graph, base, target)
    told = _names_told(graph, base, target, source, shift)
    both = _node_changes(graph, base, target, source, told).unionByName(_edge_changes(graph, base, target, told, shift)).where("not (before <=> after)")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return both.select("kind", "identity", change.alias("change"), "before", "after")


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("change").agg(F.count("*").alias("count"))


def page(found: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return found.orderBy("kind", "identity").offset(offset).limit(limit)
