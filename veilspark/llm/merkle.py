"""Merkle manifest of a dataset: cogrouped subtree exchange.

A row is a leaf: H (SHA-256 as lowercase hex text of the inputs' concatenation) of its columns, each ``-`` if null, else
``bytes:value``. Per group (``lang``) the leaves ascend by id and every two consecutive nodes become
their H, a last odd one alone, until one is left: the subroot. The subroots, by group (null first,
bytewise), give the root the same way.

1. Leaves and tampered leaves are hashed where they are read and sorted by (group, id) over the
   cluster; the table of digests is written once (``cut``), with task number and place, so ranks come
   from the counts of the tasks' stretches and no window runs over a whole group.
2. A superblock is ``2**HEIGHT`` leaves of a group, a whole subtree. One grouped pass gives the superblocks'
   top nodes; these are the leaves of a tree that is ``2**HEIGHT`` times smaller and is treated in the
   same way, until every tree is one superblock. Nothing is ever gathered in one task but a superblock.
3. Going back, each superblock's leaves and the outer nodes it needs (siblings of the nodes from its top to
   the root, one short row) are cogrouped by superblock in ``applyInPandas``, which reduces the
   leaves locally, joins inner and outer siblings to proofs and, at the lowest level, folds each leaf up to the root.

Defined cases: null columns are ``-``; null ids come first, rows with equal ids are in the order of their leaves' digests
(equal rows are leaves of their own); an empty table gives an empty result; a group of one row has its
leaf as subroot, and with one group the subroot is the root (an empty proof is H of nothing); other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import cut

HEIGHT = 10
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(columns: list[Column]) -> Column:
    """H of some columns' texts."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def ranked(leaves: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``leaves`` with ``rank`` (from 0) within ``tree`` by ``order``, and ``n``, the tree's leaves. Written once."""
    names = leaves.columns
    spread = leaves.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    held = cut(spread.select(*names, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    runs = held.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col(tree).alias("_tree"), F.col("_part").alias("_run"), "_first",
                       F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
                       F.sum("_rows").over(Window.partitionBy(tree)).alias("n"))
    same = F.col("_part").eqNullSafe(F.col("_run")) & F.col(tree).eqNullSafe(F.col("_tree"))
    return held.join(runs, same).select(*names, (F.col("_at") - F.col("_first") + F.col("_before")).alias("rank"), "n")


def _levels(n: int) -> int:
    return max(int(n) - 1, 0).bit_length()


def _reduce(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of every level, from the given ones up."""
    out = [nodes]
    for _ in range(levels):
        nodes = [digest("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def _siblings(tiers: list[list[str]], i: int) -> list[tuple[str, str]]:
    """(side, digest) of the siblings of leaf ``i`` upwards; side ``-`` and no digest where a node is alone."""
    out = []
    for nodes in tiers[:-1]:
        j = i ^ 1
        out.append(("-", "") if j >= len(nodes) else ("L" if j < i else "R", nodes[j]))
        i >>= 1
    return out


def fold(node: str, sides: str, siblings: str) -> str:
    """The root that ``node`` gives with its siblings (64 letters each, none for a side ``-``)."""
    at = 0
    for side in sides:
        other = ""
        if side != "-":
            other, at = siblings[at : at + 64], at + 64
        node = digest(other + node if side == "L" else node + other)
    return node


def _keyed(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("rank", height))


def _tops(nodes: DataFrame, height: int) -> DataFrame:
    """The superblocks' top nodes, as leaves of the next tier."""

    def top(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        node = _reduce(list(pdf.sort_values("rank")["node"]), min(height, _levels(n)))[-1][0]
        return pd.DataFrame({"tree": [pdf["tree"].iloc[0]], "rank": [pdf["block"].iloc[0]], "node": [node], "n": [-(-n >> height)]})

    keyed = _keyed(nodes, height).select("tree", "block", "rank", "node", "n")
    return keyed.groupBy("tree", "block").applyInPandas(top, "tree string, rank long, node string, n long")


def tiers_of(leaves: DataFrame, height: int) -> list[DataFrame]:
    """``leaves`` (tree, rank, node, n), their superblocks' tops, and so on until one node a tree is left."""
    out = [leaves]
    while len(out) == 1 or not out[-1].filter("n > 1").isEmpty():
        out.append(cut(_tops(out[-1], height)))
    return out


def exchange(tiers: list[DataFrame], outer: DataFrame, height: int, finish, schema: str) -> DataFrame:
    """Down the tiers: superblocks meet the siblings of their tops. ``outer``: tree, rank, sides, siblings, subroot,
    root of the highest tier. ``finish`` makes the lowest tier's rows: (nodes, tiers of the superblock, outer row)."""

    def with_rows(make):
        def run(inner: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
            inner = inner.sort_values("rank", ignore_index=True)
            return make(inner, _reduce(list(inner["node"]), min(height, _levels(inner["n"].iloc[0]))), way.iloc[0])

        return run

    for t in range(len(tiers) - 2, -1, -1):
        ways = outer.withColumnRenamed("rank", "block")
        kind = schema if t == 0 else "tree string, rank long, sides string, siblings string, subroot string, root string"
        outer = _keyed(tiers[t], height).groupBy("tree", "block").cogroup(ways.groupBy("tree", "block")).applyInPandas(with_rows(_listed if t else finish), kind)
    return outer


def _alone(tops: DataFrame) -> DataFrame:
    """The outer row of trees that are nobody's subtree."""
    return tops.select("tree", "rank", F.lit("").alias("sides"), F.lit("").alias("siblings"), F.col("node").alias("subroot"), F.col("node").alias("root"))


def _ways(tiers: list[list[str]], outer) -> list[tuple[str, str]]:
    out = []
    for i in range(len(tiers[0])):
        found = _siblings(tiers, i)
        out.append(("".join(s for s, _ in found) + outer["sides"], "".join(d for _, d in found) + outer["siblings"]))
    return out


def _listed(inner: pd.DataFrame, tiers: list[list[str]], outer) -> pd.DataFrame:
    ways = _ways(tiers, outer)
    return pd.DataFrame({"tree": inner["tree"], "rank": inner["rank"], "sides": [w[0] for w in ways], "siblings": [w[1] for w in ways],
                         "subroot": outer["subroot"], "root": outer["root"]})


def _proved(inner: pd.DataFrame, tiers: list[list[str]], outer) -> pd.DataFrame:
    ways = _ways(tiers, outer)
    return pd.DataFrame({
        "id": inner["id"], "leaf": inner["node"], "subroot": outer["subroot"], "root": outer["root"],
        "sides": [w[0] for w in ways], "siblings": [w[1] for w in ways], "proof_sha256": [digest(w[1]) for w in ways],
        "folded_root": [fold(leaf, *way) for leaf, way in zip(inner["claimed"], ways)]})


def manifest(docs: DataFrame, columns: list[str] = COLUMNS, id_col: str = "doc_id", group_col: str = "lang",
             claimed: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """Per row: id, leaf, subroot, root, sides, siblings, proof_sha256, folded_root, verified.

    ``claimed`` replaces columns in the leaves that are folded and verified (none: the rows as they are).
    """
    claimed = claimed or {}
    group = F.col(group_col).cast("string")
    leaves = docs.select(
        # a tree's name sorts null first, then bytewise; ids cross to Python as text
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("tree"), F.col(id_col).alias("key"), F.col(id_col).cast("string").alias("id"),
        leaf_of([F.col(c) for c in columns]).alias("node"), leaf_of([claimed.get(c, F.col(c)) for c in columns]).alias("claimed"))
    leaves = cut(ranked(leaves, "tree", ["key", "node", "claimed"]).drop("key"))
    tiers = tiers_of(leaves, height)
    subroots = cut(ranked(tiers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("group"), "node"), "tree", ["group"]))
    upper = tiers_of(subroots, height)

    def of_group(inner: pd.DataFrame, tier: list[list[str]], outer) -> pd.DataFrame:
        return _listed(inner, tier, outer).assign(tree=inner["group"], rank=0, subroot=inner["node"])

    kind = "tree string, rank long, sides string, siblings string, subroot string, root string"
    ways = cut(exchange(upper, _alone(upper[-1]), height, of_group, kind))
    out = exchange(tiers, ways, height, _proved,
                   "id string, leaf string, subroot string, root string, sides string, siblings string, proof_sha256 string, folded_root string")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "leaf", "subroot", "root", "sides", "siblings", "proof_sha256",
                      "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def tampered(id_col: str = "doc_id", count_col: str = "n_chars") -> dict[str, Column]:
    """The claim of the registered query: a count one too large where 7 divides the id's crc32."""
    return {count_col: F.col(count_col) + F.when(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 0, 1).otherwise(0)}


def oracle_sql() -> str:
    """The registered query in DuckDB: both trees level by level, then every leaf folded level by level."""
    def part(column: str) -> str:
        return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"

    def tier(name: str, source: str, group: str) -> str:
        return f"""{name}(g, level, place, node, n) AS (
  SELECT {group}, 0, place, node, n FROM {source}
  UNION ALL
  SELECT g, level + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), (any_value(n) + 1) // 2
  FROM {name} WHERE n > 1 GROUP BY g, level, place // 2)"""

    # crc32, bit by bit: each byte is met before the first of its eight shifts
    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))))"
    inputs = [part(c) for c in COLUMNS]
    claim = [part(f"n_chars + CASE WHEN doc_id IS NOT NULL AND {crc} % 7 = 0 THEN 1 ELSE 0 END") if c == "n_chars" else part(c) for c in COLUMNS]
    return f"""
WITH RECURSIVE h AS (SELECT doc_id, coalesce('=' || lang, '') AS g, sha256({" || ".join(inputs)}) AS node, sha256({" || ".join(claim)}) AS claimed FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, node, claimed) - 1 AS place, count(*) OVER (PARTITION BY g) AS n FROM h),
{tier("low", "leaves", "g")},
subroots AS (SELECT g, node, row_number() OVER (ORDER BY encode(g)) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1),
{tier("high", "subroots", "''")},
steps AS (
  SELECT l.g, l.place, t.level, (l.place >> t.level) % 2 = 1 AS behind, s.node AS other
  FROM leaves l JOIN (SELECT DISTINCT g, level FROM low WHERE n > 1) t ON t.g = l.g
  LEFT JOIN low s ON s.g = l.g AND s.level = t.level AND s.place = xor(l.place >> t.level, 1)
  UNION ALL
  SELECT l.g, l.place, 1000 + t.level, (r.place >> t.level) % 2 = 1, s.node
  FROM leaves l JOIN subroots r ON r.g = l.g JOIN (SELECT DISTINCT level FROM high WHERE n > 1) t ON true
  LEFT JOIN high s ON s.level = t.level AND s.place = xor(r.place >> t.level, 1)),
listed AS (SELECT *, row_number() OVER (PARTITION BY g, place ORDER BY level) AS step FROM steps),
folded(g, place, step, node) AS (
  SELECT g, place, 0, claimed FROM leaves
  UNION ALL
  SELECT f.g, f.place, f.step + 1, sha256(CASE WHEN l.behind THEN coalesce(l.other, '') || f.node ELSE f.node || coalesce(l.other, '') END)
  FROM folded f JOIN listed l ON l.g = f.g AND l.place = f.place AND l.step = f.step + 1),
ends AS (SELECT g, place, arg_max(node, step) AS node FROM folded GROUP BY g, place),
proofs AS (SELECT g, place, coalesce(string_agg(other, '' ORDER BY step), '') AS siblings FROM listed GROUP BY g, place)
SELECT l.doc_id, l.node AS leaf, r.node AS subroot, t.node AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256,
       e.node AS folded_root, e.node = t.node AS verified
FROM leaves l JOIN subroots r ON r.g = l.g JOIN high t ON t.n = 1 JOIN ends e ON e.g = l.g AND e.place = l.place
LEFT JOIN proofs p ON p.g = l.g AND p.place = l.place"""
