"""Merkle manifest of a dataset: a digest of every row, a tree of each group, a tree of the groups' roots, and proofs.

A leaf is the sha256 of a row's fields, each with its length. The leaves of a group (a language) are numbered by one
sort of all rows in ranges, whatever the groups' sizes. A tree pairs every two consecutive nodes until one is left; a
last single node is hashed alone. Aligned runs of 2^LEVELS nodes are blocks: executors take a block as an Arrow table
and let DuckDB compute its levels (ordered string_agg, then sha256) and each node's siblings. The blocks' tops are the
nodes of the next round, LEVELS levels higher, until each tree has one; Spark then joins the siblings above a block to
the siblings inside it. A digest changes only if a row changes, moves in its group's order, comes or goes.

A proof is an array with an entry for each level from leaf to root: 'l' or 'r' and the sibling's digest, by the side
on which it stands, or '' where a node is alone. `folded` recomputes a root from a leaf and a proof.

Bounds: a task of the engine holds one block (1,024 nodes of 64 characters and their proofs inside it) at a time; only
digests are shuffled, never texts; the driver holds counts only. A round of blocks is a written table.

Defined results: null fields count as such ('-'), an empty text as '0:'. A null group is a group, the first one. Null
ids come first; equal ids are ordered by leaf; equal rows have equal leaves and a place, thus a proof, each. A group
of one row has its leaf as its root, a dataset of one group that group's root. Texts are hashed whole by the JVM, up to
its 2 GB. An empty table gives an empty result. Columns beside the fields take no part, whatever they are called.
"""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that a block spans.
LEVELS = 10
#: Rows up to which a join broadcasts a table of proofs; above, it is shuffled. A row is 2 KB at most, by the levels.
FEW = 10_000

_ENGINE: dict[str, duckdb.DuckDBPyConnection] = {}


def digest(fields: list[Column]) -> Column:
    """Lowercase hex sha256 of the fields, each as '-' if null, else its bytes in UTF-8, ':', and itself."""
    parts = []
    for f in fields:
        s = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def joined(table: DataFrame) -> DataFrame:
    """A table marked for broadcast if it has few rows, else as it is."""
    return F.broadcast(table) if table.limit(FEW + 1).count() <= FEW else table


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with pos (0, 1, ... by order within the group) and total (rows of the group); no group meets in one task."""
    keys = [group, *order]
    spread = rows.withColumn("_row", F.monotonically_increasing_id())  # equal rows need not share a range
    dealt = spread.repartitionByRange(*keys, "_row").sortWithinPartitions(*keys, "_row").drop("_row")
    placed = materialise(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy("_part", F.col(group).alias("_group")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    of_group = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_n").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("_part").alias("_run"), "_group", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(of_group).alias("total"))
    runs = joined(materialise(runs, "runs"))  # a row for each range, and for each group
    met = placed.join(runs, (F.col("_part") == F.col("_run")) & F.col(group).eqNullSafe(F.col("_group")))
    return met.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "total")


def _engine() -> duckdb.DuckDBPyConnection:
    """This worker's DuckDB: in memory, one thread, no files."""
    if "con" not in _ENGINE:
        _ENGINE["con"] = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
    return _ENGINE["con"]


def block_levels(nodes: pa.Table, levels: int = LEVELS) -> pa.Table:
    """The rows of one block (pos, total, digest, others) with path (siblings inside the block) and top (its last node)."""
    total = nodes.column("total")[0].as_py()
    height = levels if total > 1 << levels else (total - 1).bit_length()
    con = _engine()
    con.register("nodes", nodes)
    con.execute(f"""CREATE OR REPLACE TEMP TABLE tree AS WITH RECURSIVE t AS (SELECT 0 AS level, pos, digest FROM nodes
        UNION ALL SELECT level + 1, pos >> 1, sha256(string_agg(digest, '' ORDER BY pos)) FROM t WHERE level < {height} GROUP BY level, pos >> 1) SELECT * FROM t""")
    found = con.sql(f"""WITH sides AS (SELECT n.pos, list(CASE WHEN s.digest IS NULL THEN '' WHEN (n.pos >> l) & 1 = 1 THEN 'l' || s.digest ELSE 'r' || s.digest END ORDER BY l) AS path
        FROM nodes n, range({height}) r(l) LEFT JOIN tree s ON s.level = l AND s.pos = xor(n.pos >> l, 1) GROUP BY n.pos)
        SELECT n.*, path, tree.digest AS top FROM nodes n JOIN sides USING (pos), tree WHERE level = {height}""").to_arrow_table()
    con.unregister("nodes")
    return found


def blocks(nodes: DataFrame, group: str, levels: int) -> DataFrame:
    """nodes with block, path and top; trees of one node are their own top."""
    held = nodes.withColumn("block", F.shiftright("pos", levels))
    schema = held.withColumn("path", F.lit(None).cast("array<string>")).withColumn("top", F.lit(None).cast("string")).schema
    done = held.where("total > 1").groupBy(group, "block").applyInArrow(lambda t: block_levels(t, levels), schema)
    lone = held.where("total = 1").withColumn("path", F.array().cast("array<string>")).withColumn("top", F.col("digest"))
    return done.unionByName(lone)


def _tops(done: DataFrame, group: str, levels: int) -> DataFrame:
    """The nodes of the round above: one for each block."""
    first = done.where(F.col("pos") == F.shiftleft("block", levels))
    return first.select(group, F.col("block").alias("pos"), F.ceil(F.col("total") / (1 << levels)).cast("long").alias("total"), F.col("top").alias("digest"))


def proofs(nodes: DataFrame, group: str, levels: int = LEVELS) -> DataFrame:
    """group, pos, path (all siblings up to the tree's root), top (that root) of nodes (group, pos, total, digest).

    Each round has 2^levels times fewer nodes than the one before; the rounds grow with the logarithm of the largest group."""
    if nodes.where("total > 1").isEmpty():
        return nodes.select(group, "pos", F.array().cast("array<string>").alias("path"), F.col("digest").alias("top"))
    done = materialise(blocks(nodes, group, levels), "merkle")
    return _above(done, proofs(_tops(done, group, levels), group, levels), group).select(group, "pos", "path", "top")


def _above(done: DataFrame, above: DataFrame, group: str) -> DataFrame:
    """Rows of blocks with the siblings above their block, and its root for their top."""
    upper = joined(above.select(F.col(group).alias("_group"), F.col("pos").alias("_block"), F.col("path").alias("_path"), *(F.col(c).alias(f"_{c}") for c in above.columns if c not in (group, "pos", "path"))))
    met = done.join(upper, F.col(group).eqNullSafe(F.col("_group")) & (F.col("block") == F.col("_block")))
    others = [c for c in done.columns if c not in ("path", "top")]
    return met.select(*others, F.concat("path", "_path").alias("path"), *(F.col(f"_{c}").alias(c) for c in above.columns if c not in (group, "pos", "path")))


def manifest(leaves: DataFrame, group: str, order: str, levels: int = LEVELS) -> DataFrame:
    """leaves (group, order, leaf, others) with path, subroot (of the group's tree) and root (of the tree of subroots)."""
    nodes = numbered(leaves.withColumnRenamed("leaf", "digest"), group, [order, "digest"])
    done = materialise(blocks(nodes, group, levels), "merkle")
    inner = materialise(proofs(_tops(done, group, levels), group, levels), "merkle")  # a row for each block
    subroots = inner.where("pos = 0").select(F.lit(0).alias("_all"), group, F.col("top").alias("digest"))
    groups = numbered(subroots, "_all", [group])
    whole = proofs(groups.select("_all", "pos", "total", "digest"), "_all", levels).select(F.col("pos").alias("_pos"), F.col("path").alias("_outer"), F.col("top").alias("root"))
    of_group = groups.join(joined(whole), F.col("pos") == F.col("_pos")).select(F.col(group).alias("_of"), "_outer", "root", F.col("digest").alias("subroot"))
    above = inner.join(joined(of_group), F.col(group).eqNullSafe(F.col("_of"))).select(group, "pos", F.concat("path", "_outer").alias("path"), "subroot", "root")
    return _above(done, materialise(above, "merkle"), group).withColumnRenamed("digest", "leaf").select(*leaves.columns, "path", "subroot", "root")


def folded(leaf: Column | str, path: Column | str) -> Column:
    """The root that a leaf and a proof give."""
    leaf, path = (F.col(c) if isinstance(c, str) else c for c in (leaf, path))

    def step(node: Column, sibling: Column) -> Column:
        other = F.substring(sibling, 2, 64)
        both = F.when(F.startswith(sibling, F.lit("l")), F.concat(other, node)).when(F.startswith(sibling, F.lit("r")), F.concat(node, other)).otherwise(node)
        return F.sha2(both.cast("binary"), 256)

    return F.aggregate(path, leaf, step)


def proof_digest(path: Column | str) -> Column:
    """sha256 of a proof's digests, joined."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.substring(s, 2, 64)), "").cast("binary"), 256)


def report(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of documents, rows whose crc32(doc_id) 7 divides being
    checked with n_chars one higher."""
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    probe = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    fields = {c: F.col(c) for c in FIELDS}
    tampered = F.when(probe & F.col("n_chars").isNotNull(), digest(list({**fields, "n_chars": more}.values())))
    leaves = materialise(docs.select("lang", "doc_id", digest(list(fields.values())).alias("leaf"), tampered.alias("tampered")), "leaves")  # texts are read once
    held = manifest(leaves, "lang", "doc_id", levels)
    found = held.select("doc_id", "leaf", "subroot", "root", proof_digest("path").alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), "path").alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII text in SQL, byte by byte; 3988292384 is the checksum's polynomial."""
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, _: xor(r >> 1, 3988292384::BIGINT * (r & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: {byte}), 4294967295::BIGINT)"


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


_OTHERS = [_field(c) for c in FIELDS]
_LEAF, _BAD = " || ".join(_OTHERS), " || ".join(_field("(n_chars::HUGEINT + 1)") if c == "n_chars" else _field(c) for c in FIELDS)

ORACLE = f"""WITH RECURSIVE leaves AS MATERIALIZED (SELECT doc_id, lang, sha256({_LEAF}) AS leaf, CASE WHEN {_crc32('doc_id::VARCHAR')} % 7 = 0 AND n_chars IS NOT NULL THEN sha256({_BAD}) END AS bad FROM documents),
placed AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
inner_nodes AS (SELECT g, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY g) AS total FROM placed
 UNION ALL SELECT g, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(total) + 1) // 2 FROM inner_nodes WHERE total > 1 GROUP BY g, level, pos // 2),
nodes_in AS MATERIALIZED (SELECT * FROM inner_nodes),
subroots AS MATERIALIZED (SELECT g, h AS subroot, level AS depth FROM nodes_in WHERE total = 1),
outer_nodes AS (SELECT 0 AS level, g AS pos, subroot AS h, count(*) OVER () AS total FROM subroots
 UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(total) + 1) // 2 FROM outer_nodes WHERE total > 1 GROUP BY level, pos // 2),
nodes_out AS MATERIALIZED (SELECT * FROM outer_nodes),
climb AS (SELECT doc_id, p.pos AS first, g, 0 AS level, p.pos AS pos, coalesce(bad, leaf) AS h, '' AS proof FROM placed p
 UNION ALL SELECT c.doc_id, c.first, c.g, c.level + 1, c.pos // 2, sha256(CASE WHEN n.h IS NULL THEN c.h WHEN c.pos % 2 = 1 THEN n.h || c.h ELSE c.h || n.h END), c.proof || coalesce(n.h, '')
 FROM climb c JOIN subroots s ON s.g = c.g AND c.level < s.depth LEFT JOIN nodes_in n ON n.g = c.g AND n.level = c.level AND n.pos = xor(c.pos, 1)),
ascend AS (SELECT c.doc_id, c.first, c.g, 0 AS level, c.g AS pos, c.h, c.proof FROM climb c JOIN subroots s ON s.g = c.g AND c.level = s.depth
 UNION ALL SELECT c.doc_id, c.first, c.g, c.level + 1, c.pos // 2, sha256(CASE WHEN n.h IS NULL THEN c.h WHEN c.pos % 2 = 1 THEN n.h || c.h ELSE c.h || n.h END), c.proof || coalesce(n.h, '')
 FROM ascend c LEFT JOIN nodes_out n ON n.level = c.level AND n.pos = xor(c.pos, 1) WHERE c.level < (SELECT max(level) FROM nodes_out)),
top AS (SELECT h AS root, level FROM nodes_out WHERE total = 1)
SELECT p.doc_id, p.leaf, s.subroot, t.root, sha256(a.proof) AS proof_sha256, a.h AS folded_root, a.h = t.root AS verified
FROM placed p JOIN subroots s USING (g) JOIN ascend a ON a.g = p.g AND a.first = p.pos JOIN top t ON a.level = t.level"""
