"""Prefix trie of conversations by burst tries: trie heads above, containers of suffixes below.

A turn is a fixed-width code (hash of role and text, number of words), a conversation the string of its codes;
texts are never shuffled. All sequences start in one container under the root. A container with more than CAP
turns in different sequences bursts: its suffixes move to containers under the heads that their next turns name,
two turns in the second round, four in the third, so that deep common openings take few rounds. Containers
that are left are bounded; each is sorted and swept into nodes in one pass of its shard. Nodes at and above the
heads come from sums over containers. Conversations with equal turns are one sequence with a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import WORD, staged

#: Turns that a container holds at most, unless they are those of one sequence.
CAP = 1_024
#: Heads that are sent to every task; more are joined by shuffle.
BROADCAST_HEADS = 100_000
#: Places in which the children of a head meet it.
SALTS = 32
#: Ids in a piece of a hashed list, and nodes in an Arrow batch.
LISTED, NODES = 4_096, 8_192
# Characters of a turn's code, of them hash first and number of words last.
HASH, COUNT = 32, 8
CODE = HASH + COUNT
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
ROOT = hashlib.sha256(b"root").hexdigest()[:HASH]

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_CONTAINER = "head string, opening string, at long, n long, lo long, kids long, leaves long, mass long, words long, ends string, whole long"
_SWEPT = f"kind string, {_NODE}, {_CONTAINER}"
_ABOVE = "node string, parent string, depth long, own long, above long, n long, lo long, mass long, kids long, ends string"


def _code(role: Column, text: Column) -> Column:
    """Code of a turn: 128 bits of SHA-256 over role and text, and the number of words of the text."""
    both = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.sha2(both, 256), 1, HASH), F.lpad(F.lower(F.hex(F.regexp_count(text, F.lit(WORD)))), COUNT, "0"))


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, path`` of all conversations of (conv_id, turn, role, text): the codes of their turns in order.

    Turns are ordered by ``turn``, null first, ties by role and then by the code. Null roles and texts are empty.
    Rows without a conv_id belong to no conversation. A conversation is one string of 40 bytes a turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    coded = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(
        F.col("turn").alias("turn"), role.alias("role"), _code(role, text).alias("code")).alias("t"))
    ordered = F.transform(F.sort_array(F.collect_list("t")), lambda t: t["code"])
    return coded.groupBy("conv_id").agg(F.array_join(ordered, "").alias("path"))


def share_openings(paths: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations rebuilt: the first h turns of conversation ``c - c % every``, then c's own after its first h.

    h is the CRC-32 of the decimal id modulo ``most``. Where that conversation is missing or shorter, what it has is taken.
    """
    first = F.col("conv_id") - F.col("conv_id") % every
    heads = paths.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.substring("path", 1, CODE * (most - 1)).alias("opening"))
    chosen = paths.withColumn("base", first).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int"))
    return chosen.join(heads, "base", "left").select("conv_id", F.concat(
        F.expr(f"substring(coalesce(opening, ''), 1, {CODE} * h)"), F.expr(f"substring(path, {CODE} * h + 1)")).alias("path"))


def _fold(paths: DataFrame) -> DataFrame:
    """``path, n, lo, ends`` of distinct sequences: conversations, smallest id, SHA-256 of their ids in order.

    Ids are sorted by range, so that a sequence of any number of conversations lies in many tasks; each joins its
    ids to pieces, and one task hashes the pieces of a sequence as they come.
    """
    members = staged(paths.select(F.substring(F.sha2("path", 256), 1, HASH).alias("seq"), "conv_id", "path"), "members")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            out = []
            for seq, group in groupby(rows, key=lambda row: row[0]):
                ids = [row[1] for row in group]
                out += [(seq, ids[at], min(LISTED, len(ids) - at), ",".join(map(str, ids[at : at + LISTED]))) for at in range(0, len(ids), LISTED)]
            yield pa.RecordBatch.from_pylist([dict(zip(("seq", "lo", "n", "listed"), row)) for row in out], schema=_PIECE)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, lo, n, digest = None, 0, 0, None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(at).to_pylist() for at in range(4))):
                if row[0] != seq:
                    if digest:
                        out.append((seq, lo, n, digest.hexdigest()))
                    seq, lo, n, digest = row[0], row[1], 0, hashlib.sha256()
                digest.update(b"," * bool(n) + row[3].encode())
                n += row[2]
            yield _ends(out)
        if digest:
            yield _ends([(seq, lo, n, digest.hexdigest())])

    listed = members.select("seq", "conv_id").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    listed = listed.mapInArrow(pieces, "seq string, lo long, n long, listed string")
    ends = listed.repartition("seq").sortWithinPartitions("seq", "lo").mapInArrow(hashed, "seq string, lo long, n long, ends string")
    ends = staged(ends, "ends")
    # The smallest member brings the turns, so each sequence is carried once.
    return ends.join(members.select(F.col("conv_id").alias("lo"), "path"), "lo").select("path", "n", "lo", "ends")


_PIECE = pa.schema([("seq", pa.string()), ("lo", pa.int64()), ("n", pa.int64()), ("listed", pa.string())])


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"seq": pa.string(), "lo": pa.int64(), "n": pa.int64(), "ends": pa.string()}
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(columns, kinds.values())], list(kinds))


def _head(at: Column) -> Column:
    return F.when(at == 0, F.lit(ROOT)).otherwise(F.substring(F.sha2(F.expr(f"substring(path, 1, {CODE} * at)"), 256), 1, HASH))


def _burst(sequences_: DataFrame, cap: int) -> DataFrame:
    """``path, n, lo, ends, at``: sequences with the depth of the head under which their container stays."""
    settled, open_, step = [], sequences_.withColumn("at", F.lit(0)), 1
    while True:
        open_ = open_.withColumn("head", _head(F.col("at")))
        sizes = open_.groupBy("head").agg(
            F.sum(F.expr(f"length(path) div {CODE} - at + 1")).alias("turns"), F.count("*").alias("different"))
        large = staged(sizes.where((F.col("turns") > cap) & (F.col("different") > 1)).select("head", F.lit(True).alias("large")), "large")
        heads = large.count()
        if not heads:
            settled.append(open_.drop("head"))
            break
        large = F.broadcast(large) if heads <= BROADCAST_HEADS else large  # at most one head per ``cap`` turns
        depth = F.expr(f"int(length(path) div {CODE})")
        moved = open_.join(large, "head", "left").select(
            "path", "n", "lo", "ends", F.when(F.col("large"), F.least(depth, F.col("at") + step)).otherwise(F.col("at")).alias("at"),
            (F.col("large").isNotNull() & (depth >= F.col("at") + step)).alias("open"))
        moved = staged(moved, "burst")
        settled.append(moved.where("not open").drop("open"))
        open_, step = moved.where("open").drop("open"), 2 * step
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out


def _turns(path: str) -> list[str]:
    return [path[at : at + CODE] for at in range(0, len(path), CODE)]


def _words(code: str) -> int:
    return int(code[HASH:], 16)


def _chain(rows: list[tuple], at: int) -> tuple[list[tuple], tuple]:
    """Nodes and sums of a container with one sequence: a node per turn, no sorting needed."""
    path, n, lo, ends = rows[0]
    words = list(map(_words, _turns(path)))
    last, saved, nodes = len(words), 0, []
    for depth in range(last, at, -1):
        saved += (n - 1) * words[depth - 1]
        nodes.append((lo, depth, lo, n, int(depth < last), 1, saved, EMPTY_SHA if depth < last else ends))
    inner = last > at
    return nodes, (n, lo, int(inner), int(inner), n * sum(words), sum(words[at:]), None if inner else ends)


def _sweep(rows: list[tuple], at: int) -> tuple[list[tuple], tuple]:
    """Nodes below the head of a container, and its sums, from sequences sorted by their codes.

    ``rows`` are (path, n, lo, ends). The sums are (n, lo, children and leaves below the head, words of all members,
    words of the distinct nodes below the head, hash of those that end at the head).
    """
    # An open node: [depth, words, n, smallest id, children, leaves, saved, ends, parent].
    head = [at, 0, 0, None, 0, 0, 0, None, None]
    stack, closed, before, mass, distinct = [head], [], [], 0, 0

    def close() -> None:
        node = stack.pop()
        node[5] = node[5] or 1
        node[6] += (node[2] - 1) * node[1]
        above = stack[-1]
        above[2] += node[2]
        above[3] = node[3] if above[3] is None else min(above[3], node[3])
        above[4] += 1
        above[5] += node[5]
        above[6] += node[6]
        closed.append(node)

    for path, n, lo, ends in rows:
        turns = _turns(path)
        mass += n * sum(map(_words, turns))
        same = at
        while same < len(before) and same < len(turns) and before[same] == turns[same]:
            same += 1
        while stack[-1][0] > same:
            close()
        for depth in range(same + 1, len(turns) + 1):
            words = _words(turns[depth - 1])
            distinct += words
            stack.append([depth, words, 0, None, 0, 0, 0, None, stack[-1]])
        top = stack[-1]
        top[2] += n
        top[3] = lo if top[3] is None else min(top[3], lo)
        top[7] = ends
        before = turns
    while len(stack) > 1:
        close()
    nodes = [(node[3], node[0], node[8][3], node[2], node[4], node[5], node[6], node[7] or EMPTY_SHA) for node in closed]
    return nodes, (head[2], head[3], head[4], head[5], mass, distinct, head[7])


def _containers(shard: DataFrame) -> DataFrame:
    """Rows of kind ``node`` (all nodes below heads) and ``container`` (sums by head)."""
    names = [part.split()[0] for part in _SWEPT.split(", ")]
    kinds = [pa.string() if part.endswith("string") else pa.int64() for part in _SWEPT.split(", ")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(columns, kinds)], names)

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def finish() -> None:
            at = key[1]
            nodes, sums = (_chain if len(held) == 1 else _sweep)(held, at)
            out.extend(("node", *node, *[None] * 11) for node in nodes)
            n, lo, kids, leaves, mass, words, ends = sums
            opening = held[0][0][: CODE * at]
            whole = sum(map(_words, _turns(opening)))
            out.append(("container", *[None] * 8, key[0], opening, at, n, lo, kids, leaves, mass, words, ends, whole))

        for batch in batches:
            for head, at, path, n, lo, ends in zip(*(batch.column(index).to_pylist() for index in range(6))):
                if (head, at) != key:
                    if held:
                        finish()
                    key, held = (head, at), []
                held.append((path, n, lo, ends))
                if len(out) >= NODES:
                    yield made(out)
                    out = []
        if held:
            finish()
        yield from (made(out[start : start + NODES]) for start in range(0, len(out), NODES))

    chosen = shard.withColumn("head", _head(F.col("at"))).select("head", F.col("at").cast("long").alias("at"), "path", "n", "lo", "ends")
    return chosen.repartition("head").sortWithinPartitions("head", "path").mapInArrow(swept, _SWEPT)


def _above(containers: DataFrame, schema: str, row) -> DataFrame:
    """A row per container and node from the root down to its head, as ``row(container, depth, own, above, whole)`` says.

    ``own`` is the number of words of the node's turn, ``above`` that of all turns before it, ``whole`` that down to the head.
    """
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [pa.string() if part.endswith("string") else pa.int64() for part in schema.split(", ")]

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = [batch.column(at).to_pylist() for at in range(batch.num_columns)]
            for values in zip(*columns):
                container = dict(zip(batch.schema.names, values))
                turns, digest, above, node, parent = _turns(container["opening"]), hashlib.sha256(), 0, ROOT, None
                words = list(map(_words, turns))
                whole = sum(words)
                for depth in range(len(turns) + 1):
                    own = words[depth - 1] if depth else 0
                    if depth:
                        digest.update(turns[depth - 1].encode())
                        node, parent = digest.copy().hexdigest()[:HASH], node
                    out.append((node, parent, depth, *row(container, depth, own, above, whole)))
                    above += own
                    if len(out) >= NODES:
                        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names)

    return containers.mapInArrow(walked, schema)


def _first_look(container: dict, depth: int, own: int, above: int, whole: int) -> tuple:
    at_head = depth == container["at"]
    return (own, above, container["n"], container["lo"], container["mass"],
            container["kids"] if at_head else 0, container["ends"] if at_head else None)


def _second_look(container: dict, depth: int, own: int, above: int, whole: int) -> tuple:
    """Words of the distinct nodes that this container brings into the subtree, and its leaves.

    Every node at or above a head is brought by the container with its smallest conversation: from ``brings`` on
    downwards all nodes of this container's opening are its own.
    """
    own_words = container["brought"] if depth < container["brings"] else whole - above
    return own_words + container["words"], container["leaves"] + container["leaf"]


def prefix_trie(paths: DataFrame, cap: int = CAP) -> DataFrame:
    """All nodes of the trie over ``conv_id, path`` (see ``sequences``); an empty table has none.

    ``conv_id`` is the smallest member, ``depth`` the number of turns, ``parent_conv_id`` the parent's conv_id (root:
    null), ``n_convs`` the members, ``n_children``, ``n_leaves`` childless nodes of the subtree, ``saved_tokens`` the
    sum over the subtree of (n_convs - 1) times the words of a node's last turn, ``ends_sha256`` the SHA-256 of the
    ids of members that end there, ascending and comma-joined. Conversations without turns end at the root.
    """
    swept = staged(_containers(_burst(staged(_fold(paths), "sequences"), cap)), "swept")
    inner = swept.where("kind = 'node'").select(*[part.split()[0] for part in _NODE.split(", ")])
    containers = swept.where("kind = 'container'").select(*[part.split()[0] for part in _CONTAINER.split(", ")])

    upper = _above(containers, _ABOVE, _first_look).groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("own").alias("own"), F.first("above").alias("above"),
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.sum("mass").alias("mass"), F.sum("kids").alias("kids"), F.max("ends").alias("ends"))
    upper = staged(upper, "upper")
    counted = upper.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.count("*").alias("heads_below"))
    upper = upper.join(counted.withColumnRenamed("parent", "node"), "node", "left").withColumn("heads_below", F.coalesce("heads_below", F.lit(0)))
    upper = staged(upper.withColumn("n_children", F.col("kids") + F.col("heads_below")), "children")

    brings = upper.groupBy("lo").agg(F.min(F.struct("depth", "above")).alias("b")).select("lo", F.col("b.depth").alias("brings"), F.col("b.above").alias("before"))
    leaf = upper.where("n_children = 0").select(F.col("node").alias("head"), F.lit(1).cast("long").alias("leaf"))
    told = containers.join(brings, "lo", "left").join(leaf, "head", "left").withColumn("leaf", F.coalesce("leaf", F.lit(0).cast("long")))
    told = told.withColumn("brought", F.coalesce(F.col("whole") - F.col("before"), F.lit(0))).withColumn(
        "brings", F.coalesce("brings", F.col("at") + 1))
    sums = _above(told, "node string, parent string, depth long, words long, leaves long", _second_look).groupBy("node").agg(
        F.sum("words").alias("words"), F.sum("leaves").alias("n_leaves"))

    # A head with very many children meets them in SALTS places.
    parents = upper.where("heads_below > 0").select(
        F.col("node").alias("parent"), F.col("lo").alias("parent_conv_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = upper.join(sums, "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    heads = salted.join(parents, ["parent", "salt"], "left").select(
        F.col("lo").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves",
        (F.col("mass") - F.col("n") * F.col("above") - F.col("words")).alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256"))
    return inner.unionByName(heads)
