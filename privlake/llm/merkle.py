"""A Merkle manifest of a dataset: digests of rows, a tree per group, one root, and each row's proof of membership."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, small
from .ranks import ranked

_PROOF = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))
_PAIR = pa.struct([("left", pa.string()), ("right", pa.string())])


def row_digest(*fields: Column | str) -> Column:
    """Lowercase hex SHA-256 of the fields' texts, each after its length in UTF-8 bytes and a colon; a null field counts as "-"."""
    text = [(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]
    return F.sha2(F.encode(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text)), "UTF-8"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(proof, leaf, lambda got, x: F.sha2(F.encode(F.concat(x["left"], got, x["right"]), "UTF-8"), 256))


def proof_text(proof: Column) -> Column:
    """The siblings' digests of a proof, level by level and from left to right, as one text."""
    return F.array_join(F.transform(proof, lambda x: F.concat(x["left"], x["right"])), "")


def traverse(digests: Sequence[str], fanout: int, height: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root of a tree of `height` levels over consecutive digests, and for each of them the siblings left and right of it, level by level.

    Postorder: a subtree gives its digest, and while calls return, each child's siblings are appended to the proofs of the leaves under it.
    """
    proofs: list[list[tuple[str, str]]] = [[] for _ in digests]

    def visit(level: int, first: int) -> str:
        if not level:
            return digests[first]
        width = fanout ** (level - 1)
        starts = range(first, min(first + fanout * width, len(digests)), width)
        below = [visit(level - 1, s) for s in starts]
        for k, s in enumerate(starts):
            beside = ("".join(below[:k]), "".join(below[k + 1 :]))
            for proof in proofs[s : s + width]:
                proof.append(beside)
        return hashlib.sha256("".join(below).encode()).hexdigest()

    return visit(height, 0), proofs


def _blocks(fanout: int, levels: int):
    block = fanout**levels

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        table = table.take(pc.sort_indices(table, [("_pos", "ascending")]))
        total, height = table.column("_n")[0].as_py(), 0
        while fanout**height < min(total, block):
            height += 1
        root, proofs = traverse(table.column("_digest").to_pylist(), fanout, height)
        flat = [x for proof in proofs for x in proof]
        pairs = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], pa.string()) for k in (0, 1)], fields=list(_PAIR))
        proof = pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, height) if height else [0] * (len(proofs) + 1), pa.int32()), pairs)
        nodes = len(proofs)
        kept = table.select(["_group", "_pos", "_row", "_digest"]).combine_chunks().to_batches()[0]
        of_nodes = [*kept.columns[:3], pa.array([total] * nodes, pa.int64()), kept.column(3), proof, pa.array([False] * nodes)]
        yield pa.RecordBatch.from_arrays(of_nodes, names=["_group", "_pos", "_row", "_n", "_digest", "_proof", "_root"])
        of_root = [pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int64()), pa.nulls(1, kept.column(2).type), pa.array([-(-total // block)], pa.int64()), pa.array([root], pa.string()), pa.nulls(1, proof.type), pa.array([True])]
        yield pa.RecordBatch.from_arrays(of_root, names=["_group", "_pos", "_row", "_n", "_digest", "_proof", "_root"])

    return run


def _trees(nodes: DataFrame, fanout: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """One tree for each _group of rows (_group, _pos, _n, _row, _digest): the nodes of each round with their proofs inside blocks, and the groups' roots.

    A round turns blocks of fanout**levels aligned nodes into their roots, a task per block; the roots are the next round's nodes.
    """
    schema = T.StructType([nodes.schema[c] for c in ("_group", "_pos", "_row", "_n", "_digest")]).add("_proof", _PROOF).add("_root", "boolean")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    rounds, most = [], nodes.agg(F.max("_n")).first()[0] or 0
    while True:
        at = F.expr(f"_pos div {fanout**levels}").alias("_block")
        done = durable(nodes.groupBy("_group", at).applyInArrow(_blocks(fanout, levels), schema))
        rounds.append(done.where("not _root").drop("_root"))
        nodes = done.where("_root").select("_group", "_pos", "_n", "_row", "_digest")
        most = -(-most // fanout**levels)
        if most <= 1:
            return rounds, nodes.select("_group", "_digest")


def _whole_proofs(rounds: list[DataFrame], block: int, top: DataFrame) -> DataFrame:
    """First-round nodes with the proofs of all rounds and then `top`'s (_group, _above, ...) in one array."""
    above = top.withColumn("_block", F.lit(0).cast("long"))
    for k, nodes in reversed(list(enumerate(rounds))):
        mine = nodes.withColumn("_block", F.expr(f"_pos div {block}"))
        mine = mine.join(small(above), ["_group", "_block"]).withColumn("_above", F.concat("_proof", "_above"))
        above = mine.drop("_proof", "_block", "_n") if not k else durable(mine.drop("_proof", "_block", "_n", "_row", "_digest").withColumnRenamed("_pos", "_block"))
    return above


def merkle_manifest(docs: DataFrame, leaf: Column, key_col: str = "doc_id", group_col: str = "lang", columns: Sequence[str] = (), fanout: int = 2, levels: int = 12) -> DataFrame:
    """A row per row of `docs`: `key_col`, `group_col`, `columns`, its leaf, its group's root `subroot`, the dataset's `root` and its `proof`.

    `leaf` is a row's digest, such as row_digest(). In a group, leaves ascend by `key_col` (nulls first), equal keys by leaf; while several nodes remain, every `fanout`
    consecutive ones become the digest of their digests, the last run with as many as it has. The groups' roots, in the order of the groups' texts by UTF-8 bytes,
    null first, make the root in the same way. A group's only leaf is its root. `proof` has, from the leaf up, one struct (left, right) a level: the digests of the
    siblings on either side, empty where there are none; folded() turns leaf and proof into the root.

    Positions come from a sort by ranges, so a group of any size is spread over tasks. Blocks of fanout**levels aligned nodes are traversed in a task each, and their
    roots are the nodes of the next round. Texts are read once, for their digests; only digests, keys and `columns` are moved. Other columns of `docs` are not looked at, whatever
    their names; of `columns`, those named like new ones go. Repeated rows are a leaf each; null keys and groups are kept; texts of any length count whole; an empty table gives no rows.
    """
    new = ("leaf", "subroot", "root", "proof")
    text = F.col(f"`{group_col}`").cast("string")
    group = F.when(text.isNull(), "-").otherwise(F.concat(F.lit("="), text))  # nulls are first among these
    carried = [c for c in dict.fromkeys([key_col, group_col, *columns]) if c.lower() not in new]
    kept = F.struct(*(F.col(f"`{c}`") for c in carried))
    leaves = durable(docs.select(group.alias("_group"), F.col(f"`{key_col}`").alias("_key"), leaf.alias("_digest"), kept.alias("_row")))
    block = fanout**levels
    nodes = ranked(leaves, "_group", ["_key", "_digest"]).drop("_key")
    rounds, roots = _trees(nodes, fanout, levels)
    roots = roots.select(F.lit("").alias("_group"), F.col("_group").alias("_key"), "_digest", F.struct(F.col("_group").alias("of"), F.col("_digest").alias("subroot")).alias("_row"))
    over, root = _trees(ranked(roots, "_group", ["_key"]).drop("_key"), fanout, levels)
    root = root.select("_group", F.col("_digest").alias("root"), F.array().cast(_PROOF).alias("_above"))
    top = durable(_whole_proofs(over, block, root).select(F.col("_row.of").alias("_group"), F.col("_row.subroot").alias("subroot"), "root", "_above"))
    out = _whole_proofs(rounds, block, top)
    return out.select(*(F.col(f"_row.`{c}`") for c in carried), F.col("_digest").alias("leaf"), "subroot", "root", F.col("_above").alias("proof"))
