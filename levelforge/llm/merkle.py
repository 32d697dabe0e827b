"""A Merkle manifest of a dataset: leaves, subroots, root and a proof for every row.

Rows are numbered within their language by a two-level scan. The reduction goes
by superblocks: a bucket is ``index div fanout^levels``, and one grouped pandas
task collapses ``levels`` levels of it into one digest; bucket digests are the
next nodes, until one is left of each language. Subroots are reduced the same
way. Proofs come back down: each bucket gets the proof of its own digest, and
joins the proofs inside it to that. Only digests are shuffled, never texts, and
a task holds ``fanout^levels`` of them.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelforge.operators.scans import numbered

from .common import materialise

FANOUT = 8
#: Levels that one grouped task collapses: 512 leaves.
LEVELS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*(encoded(v) for v in values)), 256)


def sha(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def height(n: int, fanout: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def collapsed(digests: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The digests of a bucket and of the ``levels`` levels above them."""
    out = [digests]
    for _ in range(levels):
        d = out[-1]
        out.append([sha("".join(d[i : i + fanout])) for i in range(0, len(d), fanout)])
    return out


def sides(nodes: list[str], i: int, fanout: int) -> tuple[str, str]:
    """The siblings left and right of node ``i`` in its run."""
    first = i - i % fanout
    return "".join(nodes[first:i]), "".join(nodes[i + 1 : first + fanout])


def folded(digest: str, path: list[str]) -> str:
    """What ``digest`` leads to beside the siblings of ``path`` (left, right, left, right, ...)."""
    for left, right in zip(path[::2], path[1::2], strict=True):
        digest = sha(left + digest + right)
    return digest


def reduced(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """(tree, at, n, digest) of ``nodes`` and of every superblock level, each written; the last has one node a tree."""
    width = fanout**levels

    def collapse(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        n = int(pdf["n"].iloc[0])
        top = collapsed(list(pdf["digest"]), min(levels, height(n, fanout)), fanout)[-1]
        return pd.DataFrame({"tree": pdf["tree"].iloc[:1], "at": [int(pdf["at"].iloc[0]) // width], "n": [-(-n // width)], "digest": top})

    out = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 1
    while most > 1:
        bucket = F.floor(F.col("at") / width).cast("long").alias("bucket")
        out.append(materialise(out[-1].select("tree", "at", "n", "digest").groupBy("tree", bucket).applyInPandas(collapse, "tree string, at long, n long, digest string")))
        most = -(-most // width)
    return out


def descended(levels_up: list[DataFrame], tops: DataFrame, fanout: int, levels: int, finish, schema: str) -> DataFrame:
    """Proofs from the tops (tree, at 0, path, subroot, root) down to the lowest level, where ``finish`` makes a bucket's rows."""
    width = fanout**levels

    def shared(rows: pd.DataFrame, above: pd.DataFrame):
        rows = rows.sort_values("at")
        up = collapsed(list(rows["digest"]), min(levels, height(int(rows["n"].iloc[0]), fanout)), fanout)[:-1]
        paths = []
        for i in range(len(rows)):
            path = []
            for d in up:
                path += sides(d, i, fanout)
                i //= fanout
            paths.append(path)
        return rows, paths, above.iloc[0]

    def down(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows, paths, top = shared(rows, above)
        upper = list(top["path"])
        return pd.DataFrame({"tree": rows["tree"], "at": rows["at"], "path": [p + upper for p in paths], "subroot": top["subroot"], "root": top["root"]})

    def last(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        return finish(*shared(rows, above)) if len(rows) else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])

    bucket = F.floor(F.col("at") / width).cast("long").alias("bucket")
    for k in range(max(len(levels_up) - 2, 0), -1, -1):
        groups = levels_up[k].groupBy("tree", bucket).cogroup(tops.groupBy("tree", F.col("at").alias("bucket")))
        tops = materialise(groups.applyInPandas(down, "tree string, at long, path array<string>, subroot string, root string")) if k else groups.applyInPandas(last, schema)
    return tops


PROOFS = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, claimed: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, source, lang, n_chars, text; further columns don't matter).

    ``leaf``: the digest of the five values, null told from every value.
    ``subroot``, ``root``: over the leaves of a language in order of doc_id
    (null first; rows with one doc_id by their leaf), and over the subroots in
    order of language (null first). ``proof_sha256``: over all siblings on the
    way up. ``folded_root``: from the leaf of ``claimed``, a column of texts
    held instead of ``text`` (without it: the leaf itself) and the siblings;
    ``verified`` is true if that is the root. Repeated rows have a leaf each. An
    empty table gives no row. Texts are read twice (to sample ranges, and to sort
    digests) and stay in their task.
    """
    five = lambda text: leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    text = F.col("text")
    claim = five(text if claimed is None else claimed)
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    leaves = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), five(text).alias("digest"), claim.alias("claim"))
    placed = numbered(leaves, ["tree"], ["doc_id", "digest", "claim"], "at", "n")
    placed = materialise(placed.withColumns({"at": F.col("at") - 1, "doc_id": F.col("doc_id").cast("string")}))
    up = reduced(placed, fanout, levels)
    subroots = numbered(up[-1].select(F.col("tree").alias("of"), "digest"), [], ["of"], "at", "n")
    subroots = materialise(subroots.select(F.lit("").alias("tree"), (F.col("at") - 1).alias("at"), "n", "of", "digest"))
    over = reduced(subroots, fanout, levels)
    root = over[-1].select("tree", F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))

    def languages(rows, paths, top):
        return pd.DataFrame({"tree": rows["of"], "at": 0, "path": [p + list(top["path"]) for p in paths], "subroot": rows["digest"], "root": top["root"]})

    tops = materialise(descended(over, root, fanout, levels, languages, "tree string, at long, path array<string>, subroot string, root string"))

    def documents(rows, paths, top):
        upper, above, known = list(top["path"]), "".join(top["path"]), {}
        proofs, roots = [], []
        for claim, path in zip(rows["claim"], paths, strict=True):
            proofs.append(sha("".join(path) + above))
            bucket = folded(claim, path)
            if bucket not in known:
                known[bucket] = folded(bucket, upper)
            roots.append(known[bucket])
        return pd.DataFrame({"doc_id": rows["doc_id"], "leaf": rows["digest"], "subroot": top["subroot"], "root": top["root"], "proof_sha256": proofs, "folded_root": roots, "verified": [r == top["root"] for r in roots]})

    return descended(up, tops, fanout, levels, documents, PROOFS).withColumn("doc_id", F.col("doc_id").cast("long"))


def tampered_text() -> Column:
    """The text with A-Z lower-cased where 3 divides the unsigned CRC-32 of the decimal doc_id; null ids are left alone."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
