"""Merkle manifest of a dataset, with proofs gathered by a butterfly exchange.

Every row is a leaf. The leaves of a source, in the order of their ids, form a tree in which
runs of 16 nodes become their hash; the sources' roots, in the order of the sources, form
another tree above. ``H`` is SHA-256 in lower-case hex, over digests as hex text.

Leaves are dealt into blocks of 4,096, the lowest three levels. Above, blocks exchange
hashes instead of handing them up to a few nodes and the answers down again: in round r
the blocks with the same place (lane) in 16 neighbouring subtrees of 16^r blocks swap
their subtrees' roots. Each of them gets the 16 hashes of a run, which is one level of its
proof, and hashes the parent for itself. So after log16(blocks) rounds every block has its
upper proof and the root; no group in a round holds more than 16 rows. In a last subtree
with fewer blocks, those that exist answer for the missing lanes too. Blocks then meet
their leaves once more to make the proofs, so no proof is stored per leaf on the way.

Trees with one node are that node. Sources order by their UTF-8 bytes, null first. Defined
results: null ids come last in their source; rows with equal ids are ordered by leaf; rows
that are repeated are leaves of their own, with equal leaves in any order; a null or empty
value has its own form in the leaf; a row without an id is never tampered with; an empty
table has an empty manifest. Extra columns are not read, whatever their names; very long
texts are hashed where they lie, and only their digests move.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlane.llm.common import stored
from postlane.operators.ordering import global_position

FANOUT = 16
# Levels inside a block: a task holds FANOUT ** LEVELS leaves at a time.
LEVELS = 3
BLOCK = FANOUT**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Nodes of a run with the place of the own one: one level of a proof.
PATH = "array<struct<at: int, nodes: array<string>>>"


def field(value: Column) -> Column:
    """A value's form in a leaf: its UTF-8 size, a colon and itself, or a dash for null."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def tampered(doc_id: Column) -> Column:
    """Whether a row's text is altered to see if its proof fails."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def run_of(level: list[str], at: int) -> list[str]:
    start = at - at % FANOUT
    return level[start : start + FANOUT]


def levels_of(nodes: list[str], alone: bool) -> list[list[str]]:
    """The levels of a block from its leaves up to its root.

    A block that is its whole tree stops at one node; one of several blocks goes through
    all levels, so that its root is as high as the others'.
    """
    levels = [nodes]
    while len(levels) <= LEVELS and not (alone and len(levels[-1]) == 1):
        last = levels[-1]
        levels.append([digest(*last[i : i + FANOUT]) for i in range(0, len(last), FANOUT)])
    return levels


def placed(leaves: DataFrame, order: list[Column], key: list[str]) -> DataFrame:
    """Adds ``block``, ``at`` (place in the block) and ``blocks`` of the tree.

    ``leaves`` holds nothing but ``tree`` and the columns of ``key``, which identify a row.
    """
    positions = global_position(leaves, [F.col("tree"), *order], "_position", key=["tree", *key])
    trees = positions.groupBy("tree").agg(F.min("_position").alias("_first"), F.count(F.lit(1)).alias("_size"))
    at = F.col("_position") - F.col("_first")
    return positions.join(trees, "tree").select(
        "tree",
        *key,
        F.floor(at / BLOCK).cast("bigint").alias("block"),
        (at % BLOCK).cast("int").alias("at"),
        F.ceil(F.col("_size") / BLOCK).cast("bigint").alias("blocks"),
    )


def sorted_group(table: pa.Table) -> pa.Table:
    return table.sort_by("at")


def block_roots(leaves: DataFrame, leaf: str) -> DataFrame:
    """``tree``, ``block``, ``blocks`` and ``top`` of every block."""

    def root(table: pa.Table) -> pa.Table:
        table = sorted_group(table)
        first = table.slice(0, 1)
        levels = levels_of(table["leaf"].to_pylist(), first["blocks"][0].as_py() == 1)
        return first.select(["tree", "block", "blocks"]).append_column("top", pa.array([levels[-1][0]], pa.string()))

    named = leaves.select("tree", "block", "blocks", "at", F.col(leaf).alias("leaf"))
    return named.groupBy("tree", "block").applyInArrow(root, "tree string, block bigint, blocks bigint, top string")


def exchanged(blocks: DataFrame, step: int) -> DataFrame:
    """One round: ``top`` becomes the parent's hash and ``path`` gets the run below it.

    ``step`` is the number of blocks in a subtree that is already hashed.
    """
    columns = blocks.columns
    subtree, lane = F.floor(F.col("block") / step).cast("bigint"), F.col("block") % step
    run = F.floor(subtree / FANOUT).cast("bigint")
    # Blocks of the own subtree; the last one may have fewer than a step.
    size = F.least(F.lit(step).cast("bigint"), F.col("blocks") - subtree * step)
    company = run * FANOUT * step < subtree * step
    # A short subtree answers for the lanes that it lacks, if any other subtree is in the run.
    lanes = F.when((size < step) & company, F.sequence(lane, F.lit(step - 1).cast("bigint"), size)).otherwise(F.array(lane))
    sent = blocks.select("*", subtree.alias("_subtree"), run.alias("_run"), lane.alias("_own"), F.explode(lanes).alias("_lane"))
    here = F.col("_lane") == F.col("_own")
    met = sent.groupBy("tree", "_run", "_lane").agg(
        F.array_sort(F.collect_list(F.struct("_subtree", "top"))).alias("_nodes"),
        F.collect_list(F.when(here, F.struct("block", "blocks", "path", "_subtree"))).alias("_members"),
    )
    nodes = met.select("tree", F.transform("_nodes", lambda n: n["top"]).alias("_nodes"), F.explode("_members").alias("_m"))
    place = F.struct((F.col("_m._subtree") % FANOUT).cast("int").alias("at"), F.col("_nodes").alias("nodes"))
    return nodes.select(
        "tree",
        "_m.block",
        "_m.blocks",
        F.sha2(F.concat_ws("", "_nodes").cast("binary"), 256).alias("top"),
        F.concat("_m.path", F.array(place)).cast(PATH).alias("path"),
    ).select(*columns)


def butterfly(blocks: DataFrame) -> DataFrame:
    """Every block's ``path`` above it and its tree's root in ``top``."""
    state = stored(blocks.withColumn("path", F.array().cast(PATH)), "round")
    most = state.agg(F.max("blocks")).first()[0] or 1
    step = 1
    while step < most:
        going = F.col("blocks") > step
        state = stored(exchanged(state.where(going), step).unionByName(state.where(~going)), "round")
        step *= FANOUT
    return state


def with_paths(leaves: DataFrame, above: DataFrame, leaf: str, make, schema: str) -> DataFrame:
    """``make(rows, levels of the block, its row above)`` over every block's leaves, in order."""

    def block(leaves_of: pa.Table, row: pa.Table) -> pa.Table:
        leaves_of = sorted_group(leaves_of)
        alone = leaves_of["blocks"][0].as_py() == 1
        return make(leaves_of, levels_of(leaves_of[leaf].to_pylist(), alone), row.to_pylist()[0])

    return leaves.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(block, schema)


def inner_path(levels: list[list[str]], at: int) -> Iterator[tuple[int, list[str]]]:
    """The runs around a leaf and its ancestors inside its block."""
    for level in levels[:-1]:
        yield at % FANOUT, run_of(level, at)
        at //= FANOUT


def source_proofs(subroots: DataFrame) -> DataFrame:
    """``tree``, ``root`` and the ``path`` from every subroot to the root."""
    named = subroots.select(F.lit("all").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("leaf"))
    leaves = stored(placed(named, [F.col("name")], ["name", "leaf"]), "subroots")
    above = butterfly(block_roots(leaves, "leaf"))

    def make(rows: pa.Table, levels: list[list[str]], row: dict) -> pa.Table:
        upper = [(p["at"], p["nodes"]) for p in row["path"]]
        paths = [[*inner_path(levels, at), *upper] for at in range(rows.num_rows)]
        kind = pa.list_(pa.struct([("at", pa.int32()), ("nodes", pa.list_(pa.string()))]))
        shown = [[{"at": a, "nodes": n} for a, n in path] for path in paths]
        return pa.table(
            {"tree": rows["name"], "root": pa.array([row["top"]] * rows.num_rows, pa.string()), "path": pa.array(shown, kind)}
        )

    return with_paths(leaves, above, "leaf", make, f"tree string, root string, path {PATH}")


def manifest(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source") -> DataFrame:
    """Per row: the id, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified``."""
    text = docs["text"].cast("string")
    columns = [docs[id_column], docs[source_column], docs["lang"], docs["n_chars"]]
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    altered = tampered(docs[id_column])
    leaf = leaf_hash(*columns, text)
    hashed = docs.select(
        # Bytewise order with null first.
        F.coalesce(F.concat(F.lit("="), docs[source_column].cast("string")), F.lit("-")).alias("tree"),
        docs[id_column].alias("doc_id"),
        leaf.alias("leaf"),
        F.when(altered, leaf_hash(*columns, lowered)).alias("now"),
        F.monotonically_increasing_id().alias("row"),
    )
    leaves = stored(hashed, "leaves")
    order = [F.col("doc_id").asc_nulls_last(), F.col("leaf"), F.col("row")]
    dealt = stored(placed(leaves, order, ["doc_id", "leaf", "now", "row"]).drop("row"), "dealt")
    above = butterfly(block_roots(dealt, "leaf"))
    tops = source_proofs(above.where("block = 0").select("tree", "top"))
    top = tops.select("tree", "root", F.col("path").alias("_path"))
    whole = above.join(top, "tree").select(
        "tree", "block", F.col("top").alias("subroot"), "root", F.concat("path", "_path").alias("path")
    )

    def make(rows: pa.Table, levels: list[list[str]], row: dict) -> pa.Table:
        # What stands before and after the own node in a run, for the levels above the block.
        upper = [("".join(p["nodes"][: p["at"]]), "".join(p["nodes"][p["at"] + 1 :])) for p in row["path"]]
        above_block = "".join(a + b for a, b in upper)
        proofs, folded = [], []
        for at, (now, own) in enumerate(zip(rows["now"].to_pylist(), rows["leaf"].to_pylist())):
            sides = [("".join(run[:i]), "".join(run[i + 1 :])) for i, run in inner_path(levels, at)]
            proofs.append(digest(*[a + b for a, b in sides], above_block))
            node = own if now is None else now
            for before, after in (*sides, *upper):
                node = digest(before, node, after)
            folded.append(node)
        many = rows.num_rows
        return pa.table(
            {
                "doc_id": rows["doc_id"],
                "leaf": rows["leaf"],
                "subroot": pa.array([row["subroot"]] * many, pa.string()),
                "root": pa.array([row["root"]] * many, pa.string()),
                "proof_sha256": pa.array(proofs, pa.string()),
                "folded_root": pa.array(folded, pa.string()),
                "verified": pa.array([f == row["root"] for f in folded], pa.bool_()),
            }
        )

    kind = dealt.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )
    return with_paths(dealt, whole, "leaf", make, schema).withColumnRenamed("doc_id", id_column)
