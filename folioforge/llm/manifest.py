"""Merkle manifest of a table: a digest of every row, every source and the whole, with a proof for each row.

Digests are lower-case hex SHA-256, and a node is the digest of its children's hex text, one after the other. The
leaves of a source ascend by doc_id; runs of ``FANOUT`` consecutive nodes become one until one is left, the subroot;
subroots, ordered by source, become the root in the same way.

A source's leaves are cut into aligned blocks of ``FANOUT ** DEPTH``, so that a block is a whole subtree: its leaves
are one contiguous matrix of 64-byte rows, a level up is that matrix reshaped by the fanout, and the siblings of any
node are found by division of its index. Block roots are the leaves of the next round, until every source has one
node; a round divides the number of rows by the size of a block, so that few are needed at any size. What a block
needs from above, the siblings of its root up to the root of all, goes back down to it, and each row is folded from
its leaf to the root inside its block. No task sees more than a block of a source, however large the source.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import materialise, only_result

FANOUT = 3
#: Levels of a block: 729 leaves, whose digests and proofs take about a megabyte. A round leaves one node of 729.
DEPTH = 6
#: Sources up to so many are sent to all executors, with a path of about a kilobyte each.
FEW_SOURCES = 4096
#: Characters of a digest.
HEX = 64

#: The siblings of a node at one level: those left of it, and those right of it, as text.
_PATH = "array<struct<left: string, right: string>>"


def digest(text: bytes) -> bytes:
    return hashlib.sha256(text).hexdigest().encode()


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row's fields in the order given."""
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


# --- inside a block ----------------------------------------------------------------------------------------------


def climb(leaves: bytes, levels: int | None, fanout: int = FANOUT) -> list[bytes]:
    """The nodes of each level above contiguous leaves, the leaves first; until one is left, or so many levels."""
    out = [leaves]
    while len(out[-1]) > HEX if levels is None else len(out) <= levels:
        matrix = np.frombuffer(out[-1], np.uint8)
        whole = len(matrix) // (fanout * HEX)
        rows = matrix[: whole * fanout * HEX].reshape(whole, fanout * HEX)
        above = [hashlib.sha256(row).hexdigest() for row in rows]
        if len(rest := matrix[whole * fanout * HEX :]):
            above.append(hashlib.sha256(rest).hexdigest())
        out.append("".join(above).encode())
    return out


def siblings(level: bytes, at: int, fanout: int = FANOUT) -> tuple[bytes, bytes]:
    """The digests of the run of node ``at`` that stand left and right of it."""
    run = at // fanout * fanout * HEX
    return level[run : at * HEX], level[(at + 1) * HEX : run + fanout * HEX]


def fold(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The node at the top of the path if ``node`` stands at its foot."""
    for left, right in path:
        node = digest(left + node + right)
    return node


# --- over the table ----------------------------------------------------------------------------------------------


def _ranked(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """rows with their rank (from 0) within the group and the group's size, in the given order.

    A global sort by range, then places within each sorted part, and the counts of earlier parts: a group may lie in
    many parts. Rows alike in group and order are numbered in any order.
    """
    spark = rows.sparkSession
    by = [F.col(group).asc_nulls_first(), *order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()  # of the part in the upper 31 bits, in the part in the lower 33
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("*", F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("place"))
    # what is numbered is written, so that a part lost later is read again and not dealt anew
    dealt = materialise(dealt, "sorted")
    counts = dealt.groupBy("part", group).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    over = Window.partitionBy(group)
    counts = counts.select("part", F.col(group).alias("of"), (F.sum("n").over(over.orderBy("part")) - F.col("n") - F.col("first")).alias("shift"), F.sum("n").over(over).alias("size"))
    found = dealt.alias("d").join(counts.alias("c"), (F.col("d.part") == F.col("c.part")) & (F.col(f"d.{group}") == F.col("c.of")))
    return found.select("d.*", (F.col("place") + F.col("shift")).alias("rank"), "size").drop("part", "place")


def _contiguous(digests: pa.ChunkedArray) -> bytes:
    """Digests as one matrix of hex rows."""
    return b"".join(digests.to_pylist()).hex().encode()


def _roots(depth: int, fanout: int):
    def run(key, table):
        table = table.sort_by("rank")
        size, at = table["size"][0].as_py(), key[1].as_py()
        top = climb(_contiguous(table["node"]), None if size <= fanout**depth else depth, fanout)[-1]
        return pa.table({"grp": [key[0].as_py()], "rank": [at], "size": [-(-size // fanout**depth)], "node": [bytes.fromhex(top.decode())]}, schema=_NODE)

    return run


_NODE = pa.schema([("grp", pa.string()), ("rank", pa.int64()), ("size", pa.int64()), ("node", pa.binary())])
_NODES = "grp string, rank long, size long, node binary"


def _paths(depth: int, fanout: int):
    def run(key, nodes, above):
        nodes = nodes.sort_by("rank")
        size = nodes["size"][0].as_py()
        levels = climb(_contiguous(nodes["node"]), None if size <= fanout**depth else depth, fanout)
        upper = above["path"][0].as_py() or []
        ranks = nodes["rank"].to_pylist()
        first = ranks[0]
        paths = []
        for rank in ranks:
            at, own = rank - first, []
            for level in levels[:-1]:
                left, right = siblings(level, at, fanout)
                own.append({"left": left.decode(), "right": right.decode()})
                at //= fanout
            paths.append(own + upper)
        n = len(ranks)
        return pa.table({"grp": nodes["grp"], "rank": nodes["rank"], "path": pa.array(paths, _PATH_TYPE), "top": pa.array([above["top"][0].as_py()] * n, pa.string())}, schema=_PLACED)

    return run


_PATH_TYPE = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_PLACES = f"grp string, rank long, path {_PATH}, top string"
_PLACED = pa.schema([("grp", pa.string()), ("rank", pa.int64()), ("path", _PATH_TYPE), ("top", pa.string())])


def _cogrouped(nodes: DataFrame, above: DataFrame, block: int, run, schema: str) -> DataFrame:
    """Blocks of nodes beside their own row of ``above`` (grp, rank of the block)."""
    left = nodes.withColumn("block", F.floor(F.col("rank") / block)).groupBy("grp", "block")
    return left.cogroup(above.groupBy("grp", "rank")).applyInArrow(run, schema)


def forest(nodes: DataFrame, depth: int = DEPTH, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """nodes (grp, rank, size of the group, node) -> (blocks above them with the path from each to its group's root,
    the root of each group).

    Blocks have grp, rank, path and top; they are as many as the nodes by ``fanout ** depth`` of each group.
    """
    block = fanout**depth
    heads = nodes.withColumn("block", F.floor(F.col("rank") / block)).groupBy("grp", "block").applyInArrow(_roots(depth, fanout), _NODES)
    heads = materialise(heads, "blocks")
    if heads.filter("size > 1").isEmpty():
        roots = heads.select("grp", "node")
        return heads.select("grp", "rank", F.expr(f"cast(array() as {_PATH})").alias("path"), F.lower(F.hex("node")).alias("top")), roots
    above, roots = forest(heads, depth, fanout)
    return materialise(_cogrouped(heads, above, block, _paths(depth, fanout), _PLACES), "paths"), roots


def _proved(depth: int, fanout: int, id_type: pa.DataType, schema: pa.Schema):
    def run(key, nodes, above):
        nodes = nodes.sort_by("rank")
        size, root = nodes["size"][0].as_py(), above["root"][0].as_py()
        levels = climb(_contiguous(nodes["node"]), None if size <= fanout**depth else depth, fanout)
        upper = [(p["left"].encode(), p["right"].encode()) for p in above["path"][0].as_py()]
        # what follows a node in the proofs of all leaves under it, from the top level down
        beyond = [b"".join(a + b for a, b in upper)]
        paths = []
        for level in reversed(levels[:-1]):
            here = [siblings(level, at, fanout) for at in range(len(level) // HEX)]
            beyond = [a + b + beyond[at // fanout] for at, (a, b) in enumerate(here)]
            paths.append(here)
        paths.reverse()
        folded, leaves = [], nodes["node"].to_pylist()
        for at, (node, altered) in enumerate(zip(leaves, nodes["altered"].to_pylist(), strict=True)):
            path = []
            for here in paths:
                path.append(here[at])
                at //= fanout
            folded.append(fold((altered or node).hex().encode(), path + upper).decode())
        n = nodes.num_rows
        columns = [
            nodes["doc_id"].cast(id_type), pa.array([x.hex() for x in leaves]), pa.array([above["top"][0].as_py()] * n), pa.array([root] * n),
            pa.array([hashlib.sha256(proof).hexdigest() for proof in beyond]), pa.array(folded), pa.array([f == root for f in folded]),
        ]
        return pa.table(columns, schema=schema)

    return run


@only_result
def merkle_manifest(docs: DataFrame, altered_text: Column | None = None, *, depth: int = DEPTH, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of docs (doc_id, source, lang,
    n_chars, text; other columns are ignored).

    ``altered_text`` is the text that is held against the manifest, a column of docs; by default the text itself.
    folded_root is what the row's altered leaf and the siblings in the manifest give; verified says whether it
    is the root.

    Null fields are written as ``-`` and so differ from empty ones. Rows of a null source are a source of their own,
    which comes first. Leaves of one doc_id stand in the order of their digests, null ids first; rows alike in all
    fields have leaves of their own, whose proofs may be told apart by no column. An empty table gives no rows. A
    table of one row has its leaf as root, and the digest of nothing as proof.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    text = F.col("text") if altered_text is None else altered_text
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    kind = docs.schema["doc_id"].dataType
    # the source with a mark before it, so that null and any text differ and null comes first
    group = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("grp")
    original, changed = F.unhex(leaf(*fields, F.col("text"))), F.unhex(leaf(*fields, text))
    leaves = docs.select("doc_id", group, original.alias("node"), F.when(original != changed, changed).alias("altered"))
    leaves = _ranked(materialise(leaves, "digests"), "grp", [F.col("doc_id").asc_nulls_first(), F.col("node")])
    leaves = materialise(leaves, "leaves")
    blocks, subroots = forest(leaves.select("grp", "rank", "size", "node"), depth, fanout)
    # the sources are the leaves of one more tree
    tops = materialise(_ranked(subroots.select(F.lit("").alias("all"), "grp", "node"), "all", [F.col("grp")]), "sources")
    tree = tops.select(F.lit("").alias("grp"), "rank", "size", "node")
    onward = _cogrouped(tree, forest(tree, depth, fanout)[0], fanout**depth, _paths(depth, fanout), _PLACES)
    onward = tops.select("grp", "rank").join(onward.select("rank", F.col("path").alias("onward"), F.col("top").alias("root")), "rank").drop("rank")
    if tops.count() <= FEW_SOURCES:
        onward = F.broadcast(onward)
    above = blocks.join(onward, "grp").select("grp", "rank", F.concat("path", "onward").alias("path"), "top", "root")
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), T.StructField("verified", T.BooleanType())])
    arrow = pa.schema([("doc_id", to_arrow_type(kind)), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])
    return _cogrouped(leaves, materialise(above, "above"), fanout**depth, _proved(depth, fanout, to_arrow_type(kind), arrow), schema)

