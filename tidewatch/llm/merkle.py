"""A Merkle manifest of a dataset over contiguous numpy digest matrices.

Each row is a leaf. Leaves of a source ascend by doc_id, and runs of ``FANOUT``
nodes become a parent until one is left, the source's subroot; subroots in the
order of their sources give the root in the same way. Tasks work on aligned
blocks: a block's digests are one matrix of 64 hex bytes a row, reshaped by the
fanout and hashed row by row, level by level. Block tops are the nodes of the
next tier, so that tiers are as many as the logarithm of the leaves, and what a
node needs from above its block is a path of a few levels.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._common import fan_out, materialize, sent

FANOUT = 16
#: Levels of a block, and the nodes it starts from.
LEVELS = 2
BLOCK = FANOUT**LEVELS
#: Rows of a range of sorted leaves.
RANGE_ROWS = 1_000_000
HEX = 64
#: For each place in a run, the places of the others.
OTHERS = np.array([[j for j in range(FANOUT) if j != i] for i in range(FANOUT)])

PATH = "array<struct<at: int, others: string>>"


def _hex(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def parents(level: np.ndarray) -> np.ndarray:
    """The digests above a (nodes, 64) matrix; a short last run counts as it is."""
    full = len(level) // FANOUT * FANOUT
    rows = [row.tobytes() for row in level[:full].reshape(-1, FANOUT * HEX)]
    if full < len(level):
        rows.append(level[full:].tobytes())
    return np.frombuffer(b"".join(map(_hex, rows)), np.uint8).reshape(-1, HEX)


def siblings(level: np.ndarray) -> list[bytes]:
    """Digests of the others in each node's run, left to right, end to end."""
    full = len(level) // FANOUT * FANOUT
    rows = [row.tobytes() for row in level[:full].reshape(-1, FANOUT, HEX)[:, OTHERS].reshape(full, (FANOUT - 1) * HEX)]
    last = level[full:]
    return rows + [np.delete(last, i, axis=0).tobytes() for i in range(len(last))]


def climb(leaves: np.ndarray, all_nodes: int) -> list[np.ndarray]:
    """A block's levels from its nodes to its top. Of a group with more nodes than
    a block every block climbs the same ``LEVELS``; the only block of a smaller
    group ends at the first level of one node."""
    levels = [leaves]
    while len(levels) <= LEVELS if all_nodes > BLOCK else len(levels[-1]) > 1:
        levels.append(parents(levels[-1]))
    return levels


def fold(node: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The digest that a node and the siblings on its way up lead to."""
    for at, others in path:
        node = _hex(others[: at * HEX] + node + others[at * HEX :])
    return node


def _field(value: Column, known: Column) -> Column:
    return F.when(known.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def _leaf(text: Column) -> Column:
    """H of the row's fields, with ``text`` in place of the row's own."""
    fields = [_field(F.col(c).cast("string"), F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    return F.sha2(F.concat(*fields, _field(text, text)).cast("binary"), 256)


def leaves_of(docs: DataFrame) -> DataFrame:
    """(key, doc_id, leaf, tampered, tie): ``tampered`` is the leaf with the text's
    A-Z in lower case where 5 divides the checksum of doc_id, else null."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "lang", "n_chars", "text")
    return rows.select(
        # Null is first, and every other source keeps its order of bytes.
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"), "doc_id", _leaf(F.col("text")).alias("leaf"),
        F.when(hit, _leaf(F.translate("text", upper, upper.lower()))).alias("tampered"), F.monotonically_increasing_id().alias("tie"),
    )


def placed(nodes: DataFrame, order: list[str], kept: list[str]) -> DataFrame:
    """(key, pos, n, *kept): each row's place (from 0) among the rows of its key in
    the given order, and how many there are. Rows are sorted by ranges over all
    keys, so that a key of any size is dealt over many tasks."""
    spark = nodes.sparkSession
    ranges = max(fan_out(spark), nodes.count() // RANGE_ROWS)
    line = nodes.repartitionByRange(ranges, "key", *order).sortWithinPartitions("key", *order)
    # The number of a row holds its range above bit 33, and its place there below.
    line = materialize(line.select("key", *kept, F.monotonically_increasing_id().alias("line")), "lines")
    line = line.withColumn("range", F.shiftright("line", 33))
    ends = materialize(line.groupBy("key", "range").agg(F.min("line").alias("first"), F.count("*").alias("rows")), "ends")
    # Ranges are in the order of keys: a key has as many rows here as ranges.
    starts = spark.sql(
        "select key as k, range as r, first, sum(rows) over (partition by key order by range) - rows as before,"
        " sum(rows) over (partition by key) as n from {ends}", ends=ends
    )
    met = line.join(sent(materialize(starts, "starts")), (F.col("key") == F.col("k")) & (F.col("range") == F.col("r")))
    return materialize(met.select("key", (F.col("line") - F.col("first") + F.col("before")).alias("pos"), "n", *kept), "placed")


def _matrix(batch: pa.Table) -> np.ndarray:
    """The digests of a block's rows, sorted by their place."""
    return np.frombuffer("".join(batch.column("digest").to_pylist()).encode(), np.uint8).reshape(-1, HEX)


def _block() -> Column:
    return (F.col("pos") / BLOCK).cast("long").alias("block")


def _tops(nodes: DataFrame) -> DataFrame:
    """One tier up: (key, pos, n, digest) of the tops of all blocks."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n, block = table.column("n")[0].as_py(), table.column("block")[0].as_py()
        top = climb(_matrix(table), n)[-1]
        return pa.table({
            "key": table.column("key").slice(0, 1), "pos": pa.array([block], pa.int64()), "n": pa.array([-(-n // BLOCK)], pa.int64()),
            "digest": pa.array([top[0].tobytes().decode()]),
        })

    rows = nodes.select("key", "pos", "n", "digest", _block())
    return rows.groupBy("key", "block").applyInArrow(run, "key string, pos long, n long, digest string")


def _ways(levels: list[np.ndarray], count: int) -> Iterator[list[tuple[int, bytes]]]:
    """Each node's (place in its run, siblings) for the levels of its block."""
    by_level = [siblings(level) for level in levels[:-1]]
    for i in range(count):
        yield [((i // FANOUT**k) % FANOUT, by_level[k][i // FANOUT**k]) for k in range(len(by_level))]


def _above(table: pa.Table) -> list[tuple[int, bytes]]:
    """The path from a block's top, as ``descend`` gave it."""
    return [(step["at"], step["others"].encode()) for step in table.column("path")[0].as_py()]


def descend(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """(key, pos, path) of all nodes: the way through their block, then the path
    of its top in ``above`` (key, pos, path)."""

    def run(table: pa.Table, over: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        levels, rest = climb(_matrix(table), table.column("n")[0].as_py()), _above(over)
        paths = [[{"at": a, "others": s.decode()} for a, s in way + rest] for way in _ways(levels, len(table))]
        kind = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.string())]))
        return pa.table({"key": table.column("key"), "pos": table.column("pos"), "path": pa.array(paths, kind)})

    mine = nodes.select("key", "pos", "n", "digest", _block()).groupBy("key", "block")
    over = above.select("key", F.col("pos").alias("block"), "path").groupBy("key", "block")
    return mine.cogroup(over).applyInArrow(run, f"key string, pos long, path {PATH}")


def tiers_over(nodes: DataFrame) -> list[DataFrame]:
    """Node tables from ``nodes`` up to one node a key. One number, the size of the
    largest key, tells how many there are."""
    most = nodes.agg(F.max("n")).first()[0] or 1
    tiers = [nodes]
    for _ in range(max(1, math.ceil(math.log(most, BLOCK) - 1e-9))):
        tiers.append(materialize(_tops(tiers[-1]), "tier"))
    return tiers


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row.

    Leaves of equal doc_id follow each other by their digest; a null doc_id is first
    and is not tampered with. Null fields are `-`, null sources come first and are
    not the empty source. Repeated rows are leaves of their own. A lone leaf is its
    subroot, a lone subroot the root; the proof of both is H of nothing. An empty
    table has no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    leaves = placed(materialize(leaves_of(docs), "leaves"), ["doc_id", "leaf", "tie"], ["doc_id", "leaf", "tampered"])
    bottom = leaves.withColumnRenamed("leaf", "digest")
    tiers = tiers_over(bottom)
    sources = tiers[-1].select(F.lit("").alias("key"), F.col("key").alias("name"), F.col("digest"))
    sources = placed(sources, ["name"], ["name", "digest"])
    upper = tiers_over(sources)
    found = upper[-1].first()
    root = found["digest"] if found else None
    path = upper[-1].select("key", "pos", F.array().cast(PATH).alias("path"))
    for nodes in reversed(upper[:-1]):
        path = descend(nodes, path)
    named = sources.select("name", F.col("digest").alias("subroot"), "pos").join(path.drop("key"), "pos")
    path = materialize(named.select(F.col("name").alias("key"), F.lit(0).cast("long").alias("pos"), "subroot", "path"), "subroots")
    subroots = path.select("key", "subroot")
    path = path.drop("subroot")
    for nodes in reversed(tiers[1:-1]):
        path = materialize(descend(nodes, path), "paths")

    def run(table: pa.Table, over: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        matrix, rest = _matrix(table), _above(over)
        tail, proofs, folded = b"".join(s for _, s in rest), [], []
        tampered = table.column("tampered").to_pylist()
        for i, way in enumerate(_ways(climb(matrix, table.column("n")[0].as_py()), len(table))):
            proofs.append(_hex(b"".join(s for _, s in way) + tail).decode())
            node = tampered[i].encode() if tampered[i] else matrix[i].tobytes()
            folded.append(fold(node, way + rest).decode())
        names = {"key": "key", "doc_id": "doc_id", "leaf": "digest"}
        return pa.table({a: table.column(b) for a, b in names.items()} | {"proof_sha256": pa.array(proofs), "folded_root": pa.array(folded)})

    mine = bottom.select("key", "pos", "n", "digest", "doc_id", "tampered", _block()).groupBy("key", "block")
    over = path.select("key", F.col("pos").alias("block"), "path").groupBy("key", "block")
    schema = "key string, doc_id long, leaf string, proof_sha256 string, folded_root string"
    rows = mine.cogroup(over).applyInArrow(run, schema)
    met = rows.join(sent(materialize(subroots, "roots")), "key")
    return met.select(
        "doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified")
    )


def _tree_sql(name: str, group: str, nodes: str, levels: int) -> str:
    """CTEs ``{name}0`` to ``{name}{levels}`` of (group, pos, n, digest), and for
    each below the last the siblings of every node: left, right."""
    out = [f"{name}0 as materialized ({nodes})"]
    for k in range(levels):
        here, up = f"{name}{k}", f"{name}{k + 1}"
        run = f"{group}, pos // {FANOUT}"
        out.append(
            f"{name}_run{k} as materialized (select {run} as pos, n, list(digest order by pos) as run from {here} group by {run}, n)"
        )
        out.append(
            f"{up} as materialized (select {group}, pos, case when n > 1 then (n + {FANOUT - 1}) // {FANOUT} else 1 end as n,"
            f" case when n > 1 then sha256(array_to_string(run, '')) else run[1] end as digest from {name}_run{k})"
        )
        out.append(
            f"{name}_side{k} as materialized (select h.{group}, h.pos, h.n, case when h.n > 1 then array_to_string(run[1:(h.pos % {FANOUT})], '') else '' end as l,"
            f" case when h.n > 1 then array_to_string(run[(h.pos % {FANOUT} + 2):], '') else '' end as r"
            f" from {here} h join {name}_run{k} u on u.{group} = h.{group} and u.pos = h.pos // {FANOUT})"
        )
    return ",\n".join(out)


def sql(levels: int = 8, source_levels: int = 4) -> str:
    """DuckDB SQL for ``manifest``, for at most 16^levels leaves a source."""
    field = lambda c: f"coalesce(octet_length(encode({c}))::varchar || ':' || {c}, '-')"
    texts = [field(f"{c}::varchar") for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = lambda text: f"sha256({' || '.join([*texts, field(text)])})"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = (
        "list_reduce(list_prepend(4294967295::bigint, list_transform(range(strlen(doc_id::varchar)), lambda i: ascii(substring(doc_id::varchar, (i + 1)::int, 1))::bigint)),"
        " lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end))"
    )
    proof, joins = "''", []
    for name, group, held, tall, at in (("t", "key", "b.key", levels, "b.pos"), ("s", "top", "''", source_levels, "o.pos")):
        for k in range(tall):
            j = f"{name}x{k}"
            joins.append(f"join {name}_side{k} {j} on {j}.{group} = {held} and {j}.pos = {at} // {FANOUT**k}")
            proof = f"{proof} || {j}.l || {j}.r"
    # Each fold names the one below twice, so they are columns of their own.
    steps, inner = [], "coalesce(b.tampered, b.digest)"
    for name, tall in (("t", levels), ("s", source_levels)):
        for k in range(tall):
            j = f"{name}x{k}"
            steps.append(f"case when {j}.n > 1 then sha256({j}.l || {inner} || {j}.r) else {inner} end as f_{j}")
            inner = f"f_{j}"
    return f"""with
leaves as (select coalesce('=' || source, '') as key, doc_id, {leaf('text')} as digest,
  case when xor({crc}, 4294967295) % 5 = 0 then {leaf(lower)} end as tampered from documents),
base as materialized (select *, row_number() over (partition by key order by doc_id nulls first, digest) - 1 as pos,
  count(*) over (partition by key) as n from leaves),
{_tree_sql("t", "key", "select key, pos, n, digest from base", levels)},
{_tree_sql("s", "top", f"select '' as top, row_number() over (order by key) - 1 as pos, count(*) over () as n, digest from t{levels}", source_levels)},
o as (select key, digest as subroot, row_number() over (order by key) - 1 as pos from t{levels}),
folded as (select b.doc_id, b.digest as leaf, o.subroot, sha256({proof}) as proof_sha256, {', '.join(steps)}
  from base b join o on o.key = b.key {' '.join(joins)})
select doc_id, leaf, subroot, digest as root, proof_sha256, {inner} as folded_root, {inner} = digest as verified
from folded, s{source_levels}"""
