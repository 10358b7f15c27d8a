"""Merkle dataset manifest: one root for a dataset, and a proof for each row of it.

A digest is lower-case hex SHA-256 of its inputs, concatenated; digests enter as hex text.  A
row is a leaf, the digest of its fields.  The leaves of a source ascend by id; each ``FANOUT``
consecutive nodes (the last run may have fewer, even one) become their digest, level by level,
until one node, the source's subroot, remains.  The subroots, in order of their sources (null
first, then by UTF-8 bytes), give the root likewise.

How it runs.  Leaves are hashed in the JVM and written as 32 bytes each; texts are read once.
Rows are then sorted by range of (source, id, leaf), so a source that holds most rows is spread
over many tasks, and numbered: only the first source of a partition can continue from the one
before, so one offset for each partition makes the number of a row within its source.  Aligned
blocks of FANOUT ** ``BLOCK_LEVELS`` leaves are contiguous digest matrices: each level
reshapes the one below by the fanout and hashes its rows, and the top of a block is a leaf of
the tree above, which is climbed in the same way, as often as the number of blocks asks for.
A node's siblings are found by index arithmetic on the levels of its block, and the siblings
above the block travel down with it, a few kilobytes for each block.

A block that is not full and its source's only one stops at one node; every other block goes up
BLOCK_LEVELS levels, so a node alone in its run is hashed alone on each of them.

Only one row for each partition comes to the driver.  Every step ends in a table in the shared
folder, so a lost executor costs its tasks alone.

Defined cases: a null field is a dash in the leaf's input, so it differs from the empty text; a
null id sorts first and is a row like any other; a null source is a source of its own; rows
that repeat an id go by leaf, and equal rows stand side by side, each with its own proof; one
row gives a root equal to its leaf; an empty table gives no rows; texts of any length are
hashed whole; columns that are no field are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.llm.common import settle

FANOUT = 3
BLOCK_LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_HEX = 64


def leaf_digest(fields: list[Column]) -> Column:
    """The digest of a row, as 32 bytes: each field as its UTF-8 byte count, a colon and its value, or a dash if null."""
    told = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.unhex(F.sha2(F.concat(*told), 256))


def levels_of(leaves: np.ndarray, most: int) -> list[np.ndarray]:
    """Matrices of 64 hex characters a row: the leaves, then each level above, until one node or most levels."""
    out = [leaves]
    while len(out) <= most:
        below = out[-1]
        rows = -(-len(below) // FANOUT)
        above = np.empty((rows, _HEX), np.uint8)
        full = len(below) // FANOUT
        for i, row in enumerate(below[: full * FANOUT].reshape(full, FANOUT * _HEX)):
            above[i] = np.frombuffer(hashlib.sha256(row).hexdigest().encode(), np.uint8)
        if full < rows:
            above[full] = np.frombuffer(hashlib.sha256(below[full * FANOUT :].tobytes()).hexdigest().encode(), np.uint8)
        out.append(above)
    return out


def block_levels(leaves: np.ndarray, block: int, depth: int) -> list[np.ndarray]:
    """The levels of a block: a first block that is not full is alone, and stops at one node."""
    n, most = len(leaves), depth
    if block == 0 and n < FANOUT**depth:
        most = 0
        while n > 1:
            n, most = -(-n // FANOUT), most + 1
    return levels_of(leaves, most)


def siblings(levels: list[np.ndarray], i: int) -> list[tuple[bytes, bytes]]:
    """Hex of the nodes left and right of leaf i's ancestor in its run, on each level below the top."""
    out = []
    for level in levels[:-1]:
        first = i // FANOUT * FANOUT
        out.append((level[first:i].tobytes(), level[i + 1 : first + FANOUT].tobytes()))
        i //= FANOUT
    return out


def fold(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = hashlib.sha256(left + leaf + right).hexdigest().encode()
    return leaf


def pack_path(path: list[tuple[bytes, bytes]]) -> bytes:
    return b"".join(struct.pack("<HH", len(left), len(right)) + left + right for left, right in path)


def unpack_path(packed: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], 0
    while at < len(packed):
        left, right = struct.unpack_from("<HH", packed, at)
        at += 4
        out.append((packed[at : at + left], packed[at + left : at + left + right]))
        at += left + right
    return out


def _hex_rows(digests: pa.Array) -> np.ndarray:
    """A column of 32-byte digests as a matrix of hex characters."""
    return np.frombuffer(b"".join(digests.to_pylist()).hex().encode(), np.uint8).reshape(-1, _HEX)


def _each_block(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.StructArray]]:
    nodes = batch.column("nodes")
    for i in range(batch.num_rows):
        yield i, nodes.slice(i, 1).flatten()


def numbered(rows: DataFrame, run: str, order: list[str], label: str) -> DataFrame:
    """rows with ``at``, the number of each among the rows of its run in the given order, from 0.  run must not be null.

    Rows that tie in all of order are numbered in any order; a random last key keeps even a
    third of all rows that are equal from meeting in one task.
    """
    schema = T.StructType([*rows.schema, T.StructField("at", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("first", T.BooleanType())])
    place = rows.columns.index(run)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, opening, last, so_far = TaskContext.get().partitionId(), None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(place).dictionary_encode()
            codes = coded.indices.to_numpy()
            begins = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])
            at = np.arange(batch.num_rows) - np.repeat(begins, np.diff([*begins, batch.num_rows]))
            begin, end = batch.column(place)[0].as_py(), batch.column(place)[-1].as_py()
            opening = begin if opening is None else opening
            head = begins[1] if len(begins) > 1 else batch.num_rows
            if begin == last:
                at[:head] += so_far
            last, so_far = end, int(at[-1]) + 1
            first = pc.equal(batch.column(place), opening)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64()), pa.array(np.full(batch.num_rows, part, np.int32)), first], schema.names)

    ranged = rows.withColumn("_tie", F.rand(13)).repartitionByRange(run, *order, "_tie").sortWithinPartitions(run, *order, "_tie").drop("_tie")
    table = settle(ranged.mapInArrow(count, schema), label)
    ends = table.groupBy("part").agg(F.min(run).alias("begin"), F.max(F.struct(run, "at")).alias("end"), F.count("*").alias("n")).orderBy("part").collect()  # one row for each partition
    offsets, carried, total = [], None, 0
    for part, begin, (end, at), _ in ends:
        offset = total if begin == carried else 0
        offsets.append((part, offset))
        carried, total = end, at + 1 + (offset if begin == end else 0)
    known = table.sparkSession.createDataFrame(offsets or [(0, 0)], "part int, offset long")
    return table.join(F.broadcast(known), "part").withColumn("at", F.col("at") + F.when(F.col("first"), F.col("offset")).otherwise(0)).drop("part", "first", "offset")


def _in_blocks(nodes: DataFrame, depth: int, label: str) -> DataFrame:
    """run, block, nodes: the nodes (at, digest and what else there is) of each aligned block, in order; at most FANOUT ** depth to a row."""
    what = F.struct("at", *(c for c in nodes.columns if c not in ("run", "at")))
    return settle(nodes.groupBy("run", F.expr(f"at div {FANOUT**depth}").alias("block")).agg(F.array_sort(F.collect_list(what)).alias("nodes")), label)


def _tops(blocks: DataFrame, depth: int) -> DataFrame:
    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("block").to_pylist()
            tops = [bytes.fromhex(block_levels(_hex_rows(nodes.field("digest")), numbers[i], depth)[-1].tobytes().decode()) for i, nodes in _each_block(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("run"), batch.column("block"), pa.array(tops, pa.binary())], ["run", "at", "digest"])

    slim = blocks.select("run", "block", F.transform("nodes", lambda x: F.struct(x["digest"].alias("digest"))).alias("nodes"))
    return slim.mapInArrow(top, "run string, at long, digest binary")


def _climb(blocks: DataFrame, depth: int, label: str) -> DataFrame:
    """run, at, path, top: for each block, the siblings from its own top to the run's, packed, and the digest of the run."""
    tops = settle(_tops(blocks, depth), f"{label}-tops")
    if not tops.agg(F.max("at")).first()[0]:
        return tops.select("run", "at", F.lit(b"").alias("path"), F.col("digest").alias("top"))
    above = _in_blocks(tops, depth, f"{label}-blocks")
    return _node_paths(above, _climb(above, depth, f"{label}-up"), depth, [])


def _node_paths(blocks: DataFrame, upper: DataFrame, depth: int, keep: list[str]) -> DataFrame:
    """run, at, path, top (and the kept columns) of each node of the blocks; upper has path and top of each block."""
    kinds = [T.StructField(c, blocks.schema["nodes"].dataType.elementType[c].dataType) for c in keep]
    schema = T.StructType([T.StructField("run", T.StringType()), T.StructField("at", T.LongType()), T.StructField("path", T.BinaryType()), T.StructField("top", T.BinaryType()), *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, names, paths, tops = (batch.column(c).to_pylist() for c in ("block", "run", "path", "top"))
            for i, nodes in _each_block(batch):
                levels = block_levels(_hex_rows(nodes.field("digest")), numbers[i], depth)
                own = [pack_path(siblings(levels, k)) + paths[i] for k in range(len(nodes))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i]] * len(nodes), pa.string()), nodes.field("at"), pa.array(own, pa.binary()), pa.array([tops[i]] * len(nodes), pa.binary()), *(nodes.field(c) for c in keep)], schema.names
                )

    return blocks.join(upper.withColumnRenamed("at", "block").hint("merge"), ["run", "block"]).select("run", "block", "nodes", "path", "top").mapInArrow(run, schema)


def merkle_manifest(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", fields: list[Column] | None = None, received: list[Column] | None = None, depth: int = BLOCK_LEVELS) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256 (digest of all siblings), folded_root, verified of every row of docs.

    fields: what a leaf is the digest of.  received: the same fields as a copy holds them; its
    leaf is folded with the siblings of docs, and verified says whether that gives the root.
    depth: levels of a block; it changes no result.
    """
    fields = fields or [F.col(c) for c in FIELDS]
    given = F.lit(None).cast("binary")
    if received is not None:
        own, other = leaf_digest(fields), leaf_digest(received)
        given = F.nullif(other, own)
    run = F.concat(F.when(F.col(source_col).isNull(), "0").otherwise("1"), F.coalesce(F.col(source_col).cast("string"), F.lit("")))  # never null, null first
    leaves = settle(docs.select(run.alias("run"), F.col(id_col).alias("id"), leaf_digest(fields).alias("digest"), given.alias("given")), "merkle-leaves")
    blocks = _in_blocks(numbered(leaves, "run", ["id", "digest"], "merkle-numbered"), depth, "merkle-blocks")
    upper = settle(_climb(blocks, depth, "merkle"), "merkle-upper")
    subroots = upper.where("at = 0").select(F.lit("").alias("run"), F.col("run").alias("source"), F.col("top").alias("digest"))
    sources = _in_blocks(numbered(subroots, "run", ["source"], "merkle-sources"), depth, "merkle-source-blocks")
    roots = _node_paths(sources, _climb(sources, depth, "merkle-root"), depth, ["source"])
    ways = upper.join(roots.select(F.col("source").alias("run"), F.col("path").alias("source_path"), F.col("top").alias("root")).hint("merge"), "run")
    schema = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), T.StructField("verified", T.BooleanType())]
    )

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, paths, source_paths, tops, ends = (batch.column(c).to_pylist() for c in ("block", "path", "source_path", "top", "root"))
            for i, nodes in _each_block(batch):
                matrix = _hex_rows(nodes.field("digest"))
                levels = block_levels(matrix, numbers[i], depth)
                above = unpack_path(paths[i]) + unpack_path(source_paths[i])
                tail = b"".join(left + right for left, right in above)
                subroot, root = tops[i].hex(), ends[i].hex()
                own = matrix.tobytes()
                proofs, folded = [], []
                for k, given in enumerate(nodes.field("given").to_pylist()):
                    path = siblings(levels, k)
                    proofs.append(hashlib.sha256(b"".join(left + right for left, right in path) + tail).hexdigest())
                    leaf = own[k * _HEX : (k + 1) * _HEX] if given is None else given.hex().encode()
                    folded.append(fold(fold(leaf, path), above).decode())
                n = len(proofs)
                text = [pa.array(x, pa.string()) for x in ([own[k * _HEX : (k + 1) * _HEX].decode() for k in range(n)], [subroot] * n, [root] * n, proofs, folded)]
                yield pa.RecordBatch.from_arrays([nodes.field("id"), *text, pa.array([x == root for x in folded])], schema.names)

    joined = blocks.join(ways.withColumnRenamed("at", "block").hint("merge"), ["run", "block"]).select("block", "nodes", "path", "source_path", "top", "root")
    return joined.mapInArrow(prove, schema).withColumnRenamed("id", id_col)
