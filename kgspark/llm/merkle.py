"""A Merkle manifest of a dataset: leaves, roots, a proof for each row, and its verification.

Rows are leaves: the hash of their values, each with its length before it.
Per group (lang), leaves in order are folded in twos to a subroot, and the
groups' subroots, in order of the group, to the root. A level's last node
without a neighbour is hashed alone.

Leaves are sorted by ranges and numbered in their group, so any number of tasks
may share a hot group. Blocks of BLOCK aligned leaves are whole subtrees: each is
traversed in postorder by a task that holds this block alone; a visit returns
its subtree's digest and, while the recursion unwinds, appends each half's digest
to the paths of the other half's leaves. The blocks' roots are the leaves of the
next distributed traversal, until one node a group is left; then the groups'
subroots are folded alike. A block's path is joined to its leaves' once.

A path has STEP bytes a level: the sibling's side (R, L, or - without one), and
its digest. Digests are kept as bytes, and hashed as lowercase hex text.

Null values count as such, a null group is one of the groups, the first; null
ids come first within it. Rows of equal id are ordered by their leaves; rows that
are equal throughout stay, each with a proof of its own. Other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.session import written

#: Leaves of a block, a power of two.
BLOCK = 1024
STEP = 33


def field(value: Column) -> Column:
    """A value in front of a hash: `-` if null, else its UTF-8 length, a colon and itself."""
    said = value.cast("string")
    return F.when(said.isNull(), "-").otherwise(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said))


def digest_of(*values: Column) -> Column:
    """The hash of a row of values, as bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def hashed(*digests: bytes) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def numbered(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, int]:
    """rows with pos, their 0-based place in their group, and n, the group's rows; and the largest n.

    Nulls come first. Rows equal in all of the order are numbered as they come.
    """
    ordered = [F.col(c).asc_nulls_first() for c in [group, *order]]
    spread = rows.withColumn("_serial", F.monotonically_increasing_id())  # else endless equal rows are one range
    placed = spread.repartitionByRange(*ordered, "_serial").sortWithinPartitions(*ordered, "_serial").drop("_serial")

    def count(batches):
        last, upto = (), 0
        for batch in batches:
            names = batch.column(group).dictionary_encode()
            codes = np.asarray(names.indices.fill_null(-1).to_numpy(zero_copy_only=False))
            if not len(codes):
                continue
            starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            nth = np.arange(len(codes)) - np.repeat(starts, np.diff([*starts, len(codes)]))
            value = lambda i, column=batch.column(group): (column[int(i)].as_py(),)
            if value(0) == last:
                nth[: starts[1] if len(starts) > 1 else None] += upto
            last, upto = value(len(codes) - 1), int(nth[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth, pa.int64())], names=[*batch.schema.names, "_nth"])

    fields = [*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], "_part int", "_nth long"]
    placed = written(placed.withColumn("_part", F.spark_partition_id()).mapInArrow(count, ", ".join(fields)), "merkle-order")
    parts = placed.groupBy(F.col("_part").alias("_p"), F.col(group).alias("_g")).agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(W.partitionBy("_g").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = written(parts.select("_p", "_g", before.alias("_before"), F.sum("_rows").over(W.partitionBy("_g")).alias("n")), "merkle-ranges")
    same = (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g"))
    out = placed.join(parts, same).select(*rows.columns, (F.col("_before") + F.col("_nth")).alias("pos"), "n")
    return out, parts.agg(F.max("n")).first()[0] or 0


def traverse(digests: list[bytes], height: int) -> tuple[bytes, np.ndarray]:
    """The digest of the subtree of that height over these leaves, and the leaves' paths (leaf, level, STEP bytes)."""
    paths = np.zeros((len(digests), height, STEP), np.uint8)
    paths[:, :, 0] = ord("-")

    def visit(low: int, high: int, level: int) -> bytes:
        if level == 0:
            return digests[low]
        middle = low + (1 << level - 1)
        left = visit(low, min(middle, high), level - 1)
        if high <= middle:
            return hashed(left)
        right = visit(middle, high, level - 1)
        paths[low:middle, level - 1] = np.frombuffer(b"R" + right, np.uint8)
        paths[middle:high, level - 1] = np.frombuffer(b"L" + left, np.uint8)
        return hashed(left, right)

    return visit(0, len(digests), height), paths


def _blocks(nodes: DataFrame, group: str) -> DataFrame:
    """nodes(group, pos, n, digest, ..) with block, root (the block's) and path (within it)."""
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema], "block long", "root binary", "path binary"])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        height = (min(int(pdf["n"][0]), BLOCK) - 1).bit_length()
        root, paths = traverse([bytes(d) for d in pdf["digest"]], height)
        return pdf.assign(root=root, path=[p.tobytes() for p in paths])

    numbered_ = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK))
    return written(numbered_.groupBy(group, "block").applyInPandas(fold, schema), "merkle-blocks")


def _above(done: DataFrame, group: str) -> DataFrame:
    """The blocks' roots as nodes of the next traversal."""
    return done.where(F.col("pos") % BLOCK == 0).select(group, F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("root").alias("digest"))


def climb(nodes: DataFrame, group: str, most: int) -> DataFrame:
    """(group, pos, path, root) of nodes(group, pos, n, digest): from each node to its group's root. most: the largest n."""
    if most <= 1:
        return nodes.select(group, "pos", F.lit(b"").alias("path"), F.col("digest").alias("root"))
    done = _blocks(nodes, group)
    if most <= BLOCK:
        return done.select(group, "pos", "path", "root")
    above = climb(_above(done, group), group, -(-most // BLOCK))
    above = above.select(F.col(group).alias("_g"), F.col("pos").alias("_at"), F.col("path").alias("_on"), F.col("root").alias("_root"))
    met = done.join(above, F.col(group).eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_at")))
    return met.select(group, "pos", F.concat("path", "_on").alias("path"), F.col("_root").alias("root"))


def proofs(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """leaves(group, digest, ..) with path (to the root over all groups), subroot and root."""
    nodes, most = numbered(leaves, group, [*order, "digest"])
    done = _blocks(nodes, group)
    blocks = written(climb(_above(done, group), group, -(-most // BLOCK)), "merkle-groups")
    tops, n = numbered(blocks.where("pos = 0").select(F.lit(0).alias("_all"), F.col(group).alias("_top"), F.col("root").alias("digest")), "_all", ["_top"])
    named = tops.select("_top", F.col("pos").alias("_at"))
    up = climb(tops.drop("_top"), "_all", n).select(F.col("pos").alias("_at"), F.col("path").alias("_on"), F.col("root").alias("_root")).join(named, "_at")
    rest = blocks.join(up, F.col(group).eqNullSafe(F.col("_top"))).select(F.col(group).alias("_g"), F.col("pos").alias("_block"), F.concat("path", "_on").alias("_rest"), F.col("root").alias("_subroot"), "_root")
    met = done.join(rest, F.col(group).eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_block")))
    return met.select(*leaves.columns, F.concat("path", "_rest").alias("path"), F.col("_subroot").alias("subroot"), F.col("_root").alias("root"))


def steps(path: bytes) -> list[tuple[bytes, bytes]]:
    """(side, sibling) of each level."""
    return [(path[k : k + 1], path[k + 1 : k + STEP]) for k in range(0, len(path), STEP)]


def folded(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf and its siblings give."""
    for side, sibling in steps(path):
        digest = hashed(digest, sibling) if side == b"R" else hashed(sibling, digest) if side == b"L" else hashed(digest)
    return digest


def verified(rows: DataFrame, claimed: str = "claimed") -> DataFrame:
    """rows(doc_id, digest, path, subroot, root, claimed) as doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: does the claimed leaf fold to the root?"""

    def check(batches):
        for batch in batches:
            ids, own, path, sub, root, said = (batch.column(c) for c in ("doc_id", "digest", "path", "subroot", "root", claimed))
            paths, roots = path.to_pylist(), root.to_pylist()
            folds = [folded(d, p) for d, p in zip(said.to_pylist(), paths, strict=True)]
            proof = [hashed(*(d for side, d in steps(p) if side != b"-")).hex() for p in paths]
            hexed = lambda values: pa.array([d.hex() for d in values], pa.string())
            columns = [ids, hexed(own.to_pylist()), hexed(sub.to_pylist()), hexed(roots), pa.array(proof, pa.string()), hexed(folds), pa.array([a == b for a, b in zip(folds, roots, strict=True)], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    narrow = rows.select("doc_id", "digest", "path", "subroot", "root", claimed)
    return narrow.mapInArrow(check, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(docs: DataFrame) -> DataFrame:
    """Leaves of documents by lang, their proofs, and what becomes of rows whose n_chars was raised by one: those with 7 | crc32(doc_id)."""
    id, n = F.col("doc_id").cast("long"), F.col("n_chars").cast("decimal(20,0)")
    leaf = lambda count: digest_of(id, F.col("source"), F.col("lang"), count, F.col("text"))
    tampered = F.coalesce(F.crc32(id.cast("string")) % 7 == 0, F.lit(False))
    leaves = docs.select(id.alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf(n).alias("digest"), leaf(F.when(tampered, n + 1).otherwise(n)).alias("claimed"))
    return verified(proofs(leaves, "lang", ["doc_id"]))


ORACLE = """
    WITH RECURSIVE f AS (SELECT doc_id, lang, n_chars, coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
            coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail FROM documents),
    bits AS (SELECT i AS byte, list_reduce(range(0, 9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS word FROM range(256) r(i)),
    crcs AS (SELECT list(word ORDER BY byte) AS t FROM bits),
    d AS (SELECT doc_id, lang, sha256(head || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
            sha256(head || coalesce(length(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) AS changed,
            xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295) % 7 = 0 AS tampered FROM f, crcs),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
    tree AS (SELECT 0 AS level, lang, pos, leaf AS digest, count(*) OVER (PARTITION BY lang) AS n FROM leaves
        UNION ALL SELECT level + 1, lang, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 1) // 2) FROM tree WHERE n > 1 GROUP BY level, lang, pos // 2),
    sub AS (SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM tree WHERE n = 1),
    top AS (SELECT 0 AS level, pos, digest, count(*) OVER () AS n FROM sub
        UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 1) // 2) FROM top WHERE n > 1 GROUP BY level, pos // 2),
    low AS (SELECT l.doc_id, l.leaf, l.lang, l.pos AS at, list(CASE WHEN s.digest IS NULL THEN '-' WHEN s.pos % 2 = 1 THEN 'R' || s.digest ELSE 'L' || s.digest END ORDER BY t.level) FILTER (t.n > 1) AS path
        FROM leaves l JOIN tree t ON t.lang IS NOT DISTINCT FROM l.lang AND t.pos = l.pos >> t.level LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM t.lang AND s.level = t.level AND s.pos = xor(t.pos, 1) GROUP BY ALL),
    high AS (SELECT b.lang, b.digest AS subroot, list(CASE WHEN s.digest IS NULL THEN '-' WHEN s.pos % 2 = 1 THEN 'R' || s.digest ELSE 'L' || s.digest END ORDER BY t.level) FILTER (t.n > 1) AS path
        FROM sub b JOIN top t ON t.pos = b.pos >> t.level LEFT JOIN top s ON s.level = t.level AND s.pos = xor(t.pos, 1) GROUP BY ALL),
    p AS (SELECT l.doc_id, l.leaf, h.subroot, r.digest AS root, coalesce(low.path, []) || coalesce(h.path, []) AS path, CASE WHEN l.tampered THEN l.changed ELSE l.leaf END AS claimed
        FROM leaves l JOIN low ON low.lang IS NOT DISTINCT FROM l.lang AND low.at = l.pos JOIN high h ON h.lang IS NOT DISTINCT FROM l.lang CROSS JOIN (SELECT digest FROM top WHERE n = 1) r),
    q AS (SELECT *, list_reduce(path, lambda acc, x: sha256(CASE x[1] WHEN 'R' THEN acc || x[2:] WHEN 'L' THEN x[2:] || acc ELSE acc END), claimed) AS folded_root FROM p)
    SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(path, lambda x: x <> '-'), lambda x: x[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM q"""
