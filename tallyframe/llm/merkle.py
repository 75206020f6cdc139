"""Merkle manifest of a dataset: a digest tree a partition, a tree over the partitions' roots, and a proof a row.

A level of a tree is cut into superblocks of 2^height nodes.  On the way up only their roots travel, superblock by
superblock, until a partition has one.  On the way down each superblock's nodes meet, in one cogrouped task, the one row
that they need from outside: the siblings from the superblock's root to the top.  That task reduces its block again,
joins both halves of each proof, and folds each row's proof to a root.  No task holds more than a superblock.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import with_index
from .common import drop_stage, stage, table

#: Levels of a superblock: 1,024 nodes.
HEIGHT = 10
#: Rows whose crc32 this divides are tampered with by the query.
TAMPERED = 7

_OUTER = "part string, pos long, proof binary, path string, top binary, subroot binary"


def digest(*inputs: Column) -> Column:
    """Digest of a row's fields: each ``-`` if null, else its number of UTF-8 bytes, a colon, and itself (numbers in decimal)."""
    texts = [c.cast("string") for c in inputs]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def node(*digests: bytes) -> bytes:
    """Digest of digests, as hex text in a row."""
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def levels(leaves: list[bytes], height: int | None = None) -> list[list[bytes]]:
    """The nodes of all levels, up to ``height`` or (None) until one is left.  A last node without a pair is hashed alone."""
    out = [leaves]
    while len(out[-1]) > 1 if height is None else len(out) <= height:
        row = out[-1]
        out.append([node(*row[i : i + 2]) for i in range(0, len(row), 2)])
    return out


def fold(leaf: bytes, proof: bytes, path: str) -> bytes:
    """The root from a leaf and its siblings (32 bytes each, from the leaf up).

    ``path`` has a letter a level: L and R where the sibling is left and right, - where there is none.
    """
    at = 0
    for side in path:
        if side == "-":
            leaf = node(leaf)
        else:
            other = proof[at : at + 32]
            at += 32
            leaf = node(other, leaf) if side == "L" else node(leaf, other)
    return leaf


def _inside(tree: list[list[bytes]], i: int) -> tuple[bytes, str]:
    """Siblings and path of leaf i of a block."""
    proof, path = [], []
    for row in tree[:-1]:
        other = i ^ 1
        if other < len(row):
            proof.append(row[other])
            path.append("L" if other < i else "R")
        else:
            path.append("-")
        i >>= 1
    return b"".join(proof), "".join(path)


def _block(height: int) -> Column:
    return F.shiftright(F.col("pos"), height)


def _grown(n: int, height: int) -> int | None:
    """Levels of the blocks of a tree of n nodes: ``height``, or (None) until one is left."""
    return None if n <= 1 << height else height


def _roots(nodes: DataFrame, height: int) -> DataFrame:
    """part, pos, n, node: the superblocks of nodes (part, pos, n, node), n being the nodes of the part."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        n = int(pdf["n"].iloc[0])
        top = levels([bytes(x) for x in pdf["node"]], _grown(n, height))[-1][0]
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "pos": [int(pdf["pos"].iloc[0]) >> height], "n": [-(-n >> height)], "node": [top]})

    return nodes.select("part", "pos", "n", "node", _block(height).alias("block")).groupBy("part", "block").applyInPandas(run, "part string, pos long, n long, node binary")


def _proofs(nodes: DataFrame, height: int, most: int, finish: Callable[[DataFrame], DataFrame], fields: str = "") -> DataFrame:
    """part, pos, proof, path, top, subroot of each node (part, pos, n, node), and ``fields`` of its row.

    ``most``: the largest n.  ``finish`` gives the outer rows of single nodes, that is, of whole parts.  With a field
    ``changed`` the fold starts there where it is not null, and ``folded`` is added.
    """
    roots = stage(_roots(nodes, height), "roots")
    over = -(-most >> height)
    outer = finish(roots) if over <= 1 else _proofs(roots, height, over, finish)
    folds = "changed" in fields
    names = [f.split()[0] for f in fields.split(", ")] if fields else []
    kept = [c for c in names if c != "changed"]

    def run(mine: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values("pos")
        up = above.iloc[0]
        outside, onward = bytes(up["proof"]), up["path"]
        leaves = [bytes(x) for x in mine["node"]]
        tree = levels(leaves, _grown(int(mine["n"].iloc[0]), height))
        found = [_inside(tree, i) for i in range(len(leaves))]
        out = mine[["part", "pos", *(["node"] if folds else []), *kept]].copy()
        out["proof"], out["path"] = [p + outside for p, _ in found], [w + onward for _, w in found]
        out["top"], out["subroot"] = [up["top"]] * len(out), [up["subroot"]] * len(out)
        if folds:
            starts = [leaf if c is None else bytes(c) for leaf, c in zip(leaves, mine["changed"], strict=True)]
            out["folded"] = [fold(s, p, w) for s, p, w in zip(starts, out["proof"], out["path"], strict=True)]
        return out

    kinds = {f.split()[0]: f for f in fields.split(", ")} if fields else {}
    schema = ", ".join(["part string, pos long", *(["node binary"] if folds else []), *[kinds[c] for c in kept], "proof binary, path string, top binary, subroot binary", *(["folded binary"] if folds else [])])
    left = nodes.select("part", "pos", "n", "node", *names, _block(height).alias("block")).groupBy("part", "block")
    right = outer.select("part", F.col("pos").alias("block"), "proof", "path", "top", "subroot").groupBy("part", "block")
    return left.cogroup(right).applyInPandas(run, schema)


def _placed(rows: DataFrame) -> DataFrame:
    """pos and n of each row within its part: rows (part, key, leaf, row, ...) go into range parts, whose counts of a part are summed."""
    ranked = with_index(rows, ["part", "key", "leaf", "row"], "place")
    spans = ranked.groupBy(F.col("part").alias("of")).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    return ranked.join(spans, F.col("part") == F.col("of")).withColumn("pos", F.col("place") - F.col("first")).drop("of", "first", "place", "row")


def manifest(rows: DataFrame, part: Column, key: Column, leaf: Column, changed: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """key, leaf, subroot, root, proof, path, folded of each row: digests of 32 bytes.

    ``part`` names a row's tree; in it rows ascend by ``key`` (null first, equal keys by their leaf, equal rows in any
    order, which gives the same tree).  Trees ascend by name, bytewise, null first, and their roots are the leaves of the
    tree over them.  ``proof`` has the siblings from the leaf to the root, ``path`` their sides.  ``folded`` is the root
    that the proof gives from ``changed`` where that is not null, and else from the leaf.  An empty table gives no rows.
    """
    named = F.coalesce(F.concat(F.lit("="), part.cast("string")), F.lit("-"))  # never null, and null comes first
    leaves = rows.select(named.alias("part"), key.cast("long").alias("key"), leaf.alias("leaf"), (changed if changed is not None else F.lit(None)).cast("binary").alias("changed"))
    leaves = stage(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    placed = stage(_placed(leaves).withColumnRenamed("leaf", "node"), "placed")
    drop_stage(leaves)
    most = placed.agg(F.max("n").alias("n")).first()["n"] or 0

    def ended(roots: DataFrame) -> DataFrame:
        return roots.select("part", "pos", F.lit(b"").alias("proof"), F.lit("").alias("path"), F.col("node").alias("top"), F.col("node").alias("subroot"))

    def between(roots: DataFrame) -> DataFrame:
        """Outer rows of whole parts: the proofs of their roots in the tree over all parts."""
        parts = roots.count()
        over = with_index(roots.select(F.col("part").alias("name"), F.col("node").alias("own")), ["name"], "pos")
        over = stage(over.select(F.lit("").alias("part"), "pos", F.lit(parts).cast("long").alias("n"), F.col("own").alias("node"), "name", "own"), "parts")
        found = _proofs(over, height, parts, ended, "name string, own binary")
        return found.select(F.col("name").alias("part"), F.lit(0).cast("long").alias("pos"), "proof", "path", "top", F.col("own").alias("subroot"))

    made = _proofs(placed, height, most, between, "key long, changed binary")
    return made.select("key", F.col("node").alias("leaf"), "subroot", F.col("top").alias("root"), "proof", "path", "folded")


def document_manifest(docs: DataFrame, tampered: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """``manifest`` of documents: a tree a lang, in order of doc_id, a leaf of doc_id, source, lang, n_chars and text.

    Where ``tampered`` is true, the proof is folded from the leaf of the document with one more in n_chars (a null stays).
    Nulls anywhere, empty and long texts and repeated rows are leaves like others; other columns are not read.
    """
    leaf = lambda n: digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    changed = None if tampered is None else F.when(tampered, leaf(F.col("n_chars") + 1))
    return manifest(docs.select("doc_id", "source", "lang", "n_chars", "text"), F.col("lang"), F.col("doc_id"), leaf(F.col("n_chars")), changed, height)


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of all documents, with the proofs of tampered ones folded from what they have become."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    made = document_manifest(table(spark, sf_dir, "documents"), tampered)
    text = lambda c: F.lower(F.hex(c))
    return made.select(
        F.col("key").alias("doc_id"), text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        F.sha2(text("proof"), 256).alias("proof_sha256"), text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


#: crc32 by its polynomial, bit by bit, and trees level by level; the leaf's path is folded by list_reduce.
ORACLE = """
WITH RECURSIVE docs AS (
  SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, lang, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-')) AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail, n_chars, coalesce(xor(crc, 4294967295::BIGINT) % 7 = 0, false) AS tampered
  FROM docs
), hashed AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN tampered THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS changed
  FROM leaves
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM hashed
), low AS (
  SELECT lang, 0 AS lvl, pos, leaf AS h, n FROM placed
  UNION ALL
  SELECT lang, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM low WHERE n > 1 GROUP BY lang, lvl, pos // 2, n
), subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
  SELECT 0 AS lvl, pos, subroot AS h, n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM high WHERE n > 1 GROUP BY lvl, pos // 2, n
), steps AS (
  SELECT p.doc_id, p.leaf, p.lang, p.pos AS leaf_pos, l.lvl AS lvl, coalesce(s.h, '') AS h, CASE WHEN s.h IS NULL THEN '-' WHEN (p.pos >> l.lvl) % 2 = 1 THEN 'L' ELSE 'R' END AS side
  FROM placed p JOIN (SELECT DISTINCT lang, lvl FROM low WHERE n > 1) l ON l.lang IS NOT DISTINCT FROM p.lang
  LEFT JOIN low s ON s.lang IS NOT DISTINCT FROM p.lang AND s.lvl = l.lvl AND s.pos = xor(p.pos >> l.lvl, 1)
  UNION ALL
  SELECT p.doc_id, p.leaf, p.lang, p.pos, 1000 + l.lvl, coalesce(s.h, ''), CASE WHEN s.h IS NULL THEN '-' WHEN (r.pos >> l.lvl) % 2 = 1 THEN 'L' ELSE 'R' END
  FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang CROSS JOIN (SELECT DISTINCT lvl FROM high WHERE n > 1) l
  LEFT JOIN high s ON s.lvl = l.lvl AND s.pos = xor(r.pos >> l.lvl, 1)
), paths AS (
  SELECT lang, leaf_pos, list({'side': side, 'h': h} ORDER BY lvl) AS path, sha256(string_agg(h, '' ORDER BY lvl)) AS proof_sha256 FROM steps GROUP BY lang, leaf_pos
), folded AS (
  SELECT p.doc_id, p.leaf, r.subroot, (SELECT h FROM high WHERE n = 1) AS root, coalesce(w.proof_sha256, sha256('')) AS proof_sha256,
    list_reduce(list_prepend({'side': '', 'h': coalesce(p.changed, p.leaf)}, coalesce(w.path, [])), lambda a, b: {'side': '', 'h': sha256(CASE b.side WHEN 'L' THEN b.h || a.h ELSE a.h || b.h END)}).h AS folded_root
  FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang LEFT JOIN paths w ON w.lang IS NOT DISTINCT FROM p.lang AND w.leaf_pos = p.pos
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
