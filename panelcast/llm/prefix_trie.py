"""Prefix trie of conversations, as balanced parentheses in shards.

Every distinct sequence of a conversation's first turns is a node. Sequences are
sorted over the whole input and cut into shards. Each shard writes its part of
the trie as a row of parentheses: one opens where a node begins and closes where
its subtree ends. The excess (open less closed ones) is kept as minima of blocks
in a range min-max tree, by which ``findclose`` finds the end of every subtree;
the rank of leaf pairs "()" counts its leaves, and cumulative arrays over the
nodes in order give its members and savings.

Only nodes on the path of a shard's first or last sequence (its spine) can go on
in another shard. A shard gives them in part, without the spine nodes below; the
spines, two paths a shard, merge in one small task that does the same sums over
the tree they form. All other nodes are whole where they are. A very common
sequence is cut between shards by its conversation id like any other.

Turns are compared by 128-bit hashes of role and text, of which only the length
is kept. Null roles and texts count as empty. Turns are ordered by number, null
first, then by hash. Rows with a null conv_id belong to no conversation. Ids
are brought to their base by SQL's %, which keeps the sign. An empty table has
no nodes. Repeated rows are turns of their own. Other columns are ignored.
A task holds the hashes of one shard (``SHARD_TURNS``) or of one conversation.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage

KEY = 16                 # bytes of a turn's hash
SHARD_TURNS = 400_000    # a shard is closed beyond this
ENDS_IDS = 1_000         # conversation ids in one piece of a shared node's list
BLOCK = 64               # parentheses in a block of the min-max tree
MOST_HEAD = 5            # turns a conversation may take from its base
_NO_ID = np.iinfo(np.int64).max


class Parentheses:
    """Balanced parentheses with a range min-max tree over blocks of excess."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits.astype(bool)
        size = max(-(-len(bits) // BLOCK), 1)
        step = np.zeros(size * BLOCK, np.int64)
        step[: len(bits)] = np.where(self.bits, 1, -1)
        self.steps = step.reshape(size, BLOCK)
        inside = self.steps.cumsum(1)
        self.before = np.concatenate([[0], inside[:, -1].cumsum()[:-1]])
        self.levels = [self.before + inside.min(1)]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            if len(low) % 2:
                low = self.levels[-1] = np.append(low, np.iinfo(np.int64).max)
            self.levels.append(np.minimum(low[::2], low[1::2]))
        pair = np.zeros(len(bits) + 1, np.int64)
        pair[1:-1] = self.bits[:-1] & ~self.bits[1:]
        self.pairs = pair.cumsum()

    def _in_block(self, block: np.ndarray, after: np.ndarray, most: np.ndarray) -> np.ndarray:
        """First place of ``block`` beyond ``after`` with excess at most ``most``, or -1."""
        excess = self.before[block, None] + self.steps[block].cumsum(1)
        hit = (excess <= most[:, None]) & (np.arange(BLOCK) > after[:, None])
        return np.where(hit.any(1), hit.argmax(1), -1)

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """Where the parentheses opened at ``at`` close."""
        out = np.empty(len(at), np.int64)
        for k in range(0, len(at), 16_384):
            out[k: k + 16_384] = self._findclose(at[k: k + 16_384])
        return out

    def _findclose(self, at: np.ndarray) -> np.ndarray:
        block, inside = at // BLOCK, at % BLOCK
        excess = self.before[block] + np.take_along_axis(self.steps[block].cumsum(1), inside[:, None], 1)[:, 0]
        most = excess - 1
        place = self._in_block(block, inside, most)
        out = block * BLOCK + place
        left = np.flatnonzero(place < 0)
        if not len(left):
            return out
        # up to the first block to the right whose minimum is low enough, down to its first such child
        node, want, level = block[left], most[left], np.zeros(len(left), np.int64)
        found = np.zeros(len(left), bool)
        for h, low in enumerate(self.levels):
            right = node + 1
            here = ~found & (node % 2 == 0) & (right < len(low)) & (low[np.minimum(right, len(low) - 1)] <= want)
            node = np.where(here, right, np.where(found, node, node // 2))
            level[here] = h
            found |= here
        for h in range(len(self.levels) - 1, 0, -1):
            down = level == h
            child = node * 2
            low = self.levels[h - 1]
            child += low[np.where(down, child, 0)] > want
            node, level = np.where(down, child, node), np.where(down, h - 1, level)
        out[left] = node * BLOCK + self._in_block(node, np.full(len(left), -1), want)
        return out

    def leaves(self, opened: np.ndarray, closed: np.ndarray) -> np.ndarray:
        """Leaf pairs that begin from ``opened`` on and before ``closed``."""
        return self.pairs[closed] - self.pairs[opened]


@dataclass
class Shard:
    """The trie of sorted sequences, nodes in order of their opening."""

    bits: list = field(default_factory=lambda: [True])
    depth: list = field(default_factory=lambda: [0])
    parent: list = field(default_factory=lambda: [-1])
    length: list = field(default_factory=lambda: [0])
    path: list = field(default_factory=lambda: [0])
    end: list = field(default_factory=list)     # node of each sequence
    ids: list = field(default_factory=list)
    first: bytes = b""
    last: bytes = b""

    def add(self, conv: int, keys: bytes, lengths: list) -> None:
        n, same = len(keys) // KEY, 0
        if self.ids:
            most = min(n, len(self.last) // KEY)
            while same < most and keys[same * KEY: (same + 1) * KEY] == self.last[same * KEY: (same + 1) * KEY]:
                same += 1
        else:
            self.first = keys
        self.last = keys
        self.bits += [False] * (len(self.path) - 1 - same) + [True] * (n - same)
        del self.path[same + 1:]
        for d in range(same, n):
            self.parent.append(self.path[-1])
            self.path.append(len(self.depth))
            self.depth.append(d + 1)
            self.length.append(lengths[d])
        self.end.append(self.path[-1])
        self.ids.append(conv)

    def turns(self) -> int:
        return len(self.depth) + len(self.ids)

    def spine(self) -> dict[int, tuple[bytes, bytes]]:
        """Nodes on the first and the last path: node -> (name, name of its parent)."""
        out: dict[int, tuple[bytes, bytes]] = {}
        for keys, path in ((self.first, range(len(self.first) // KEY + 1)), (self.last, self.path)):
            name, up = b"", b""
            for d, node in enumerate(path):
                up, name = name, hashlib.md5(name + keys[max(d - 1, 0) * KEY: d * KEY]).digest()
                out[node] = (name, up)
        return out


    @property
    def tree(self) -> Parentheses:
        return Parentheses(np.array(self.bits + [False] * len(self.path), bool))


def sums_of(values: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each node and those after it up to its ``end``."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[end] - total[:-1]


def least_below(depth: np.ndarray, parent: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Smallest value in every subtree, carried up level by level."""
    out = own.copy()
    order = np.argsort(-depth, kind="stable")
    edges = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, edges):
        level = level[parent[level] >= 0]
        np.minimum.at(out, parent[level], out[level])
    return out


def added_below(depth: np.ndarray, parent: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Sum of every subtree, carried up level by level."""
    out = own.copy()
    for d in range(int(depth.max(initial=0)), 0, -1):
        level = np.flatnonzero(depth == d)
        np.add.at(out, parent[level], out[level])
    return out


NODE, SPINE, ENDS = 0, 1, 2
_PART = pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("place", pa.int64()), ("name", pa.binary()), ("up", pa.binary()),
                   *[(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                               "saved_tokens", "length")], ("ends", pa.string())])
_PART_SQL = ("kind int, shard long, place long, name binary, up binary, conv_id long, depth long, parent_conv_id long, "
             "n_convs long, n_children long, n_leaves long, saved_tokens long, length long, ends string")
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _rows(kind: int, n: int, **columns) -> pa.RecordBatch:
    columns["kind"] = np.full(n, kind)
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _PART], schema=_PART)


def shard_rows(shard: Shard, number: int):
    """What a shard knows: whole nodes (``place``: the spine node they hang on),
    its spine (``place``: its number there) without the sums of spine nodes
    themselves, and pieces of the id lists of spine nodes."""
    n = len(shard.depth)
    depth, parent = np.array(shard.depth), np.array(shard.parent)
    length, end_at = np.array(shard.length, np.int64), np.array(shard.end)
    spine = shard.spine()
    on_spine = np.zeros(n, bool)
    on_spine[list(spine)] = True
    inner = ~on_spine

    tree = shard.tree
    opened = np.flatnonzero(tree.bits)
    closed = tree.findclose(opened)
    end = np.arange(n) + (closed - opened + 1) // 2
    least = np.full(n, _NO_ID)
    np.minimum.at(least, end_at, np.array(shard.ids, np.int64))
    least = least_below(depth, parent, least)
    n_convs = sums_of(np.bincount(end_at, minlength=n), end)
    saved = sums_of(np.where(inner, (n_convs - 1) * length, 0), end)
    leaf = closed == opened + 1
    leaves = tree.leaves(opened, closed) - sums_of(on_spine & leaf, end)
    children = np.bincount(parent[1:][inner[1:]], minlength=n)

    # sequences are sorted, so those that end in a node are together and their ids ascend
    starts = np.flatnonzero(np.diff(end_at, prepend=-1))
    lists = {int(end_at[a]): (a, b) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(end_at)], strict=True)}
    joined = lambda a, b: ",".join(map(str, shard.ids[a:b]))

    own = list(spine)
    number_of = {node: k for k, node in enumerate(own)}
    at = np.flatnonzero(inner)
    up = parent[at]
    cut = on_spine[up]
    yield _rows(NODE, len(at), shard=np.full(len(at), number), conv_id=least[at], depth=depth[at], n_convs=n_convs[at],
                place=[number_of[u] if c else None for u, c in zip(up.tolist(), cut.tolist(), strict=True)],
                parent_conv_id=pa.array(least[up], mask=cut), n_children=children[at], n_leaves=leaves[at],
                saved_tokens=saved[at],
                ends=[hashlib.sha256(joined(*lists[v]).encode()).hexdigest() if v in lists else NO_ENDS for v in at.tolist()])
    yield _rows(SPINE, len(own), shard=np.full(len(own), number), place=np.arange(len(own)),
                name=[spine[v][0] for v in own], up=[spine[v][1] for v in own], conv_id=least[own], depth=depth[own],
                n_convs=n_convs[own], n_children=children[own], n_leaves=leaves[own], saved_tokens=saved[own], length=length[own])
    pieces = [(v, a, min(a + ENDS_IDS, lists[v][1])) for v in own if v in lists for a in range(*lists[v], ENDS_IDS)]
    yield _rows(ENDS, len(pieces), shard=np.full(len(pieces), number), place=[a for _, a, _ in pieces],
                name=[spine[v][0] for v, _, _ in pieces], ends=[joined(a, b) for _, a, b in pieces])


def _shards(batches, most: int):
    """Rows of the shards of one sorted partition."""
    part, count, shard = TaskContext.get().partitionId(), 0, Shard()
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "keys", "lengths")]
        for conv, keys, lengths in zip(*columns, strict=True):
            if shard.turns() > most:
                yield from shard_rows(shard, (part << 32) + count)
                shard, count = Shard(), count + 1
            shard.add(conv, keys, lengths)
    if shard.ids:
        yield from shard_rows(shard, (part << 32) + count)


def _whole_spines(batches):
    """Spine nodes, one row each with the sums over all shards, made whole: the
    savings and leaves of spine nodes themselves are added up the tree they form."""
    rows = pa.Table.from_batches(list(batches))
    if not rows.num_rows:
        return
    get = {c: rows.column(c).to_numpy() for c in rows.column_names if c not in ("name", "up")}
    names = rows.column("name").to_pylist()
    where = {name: k for k, name in enumerate(names)}
    depth = get["depth"]
    parent = np.array([where[up] if d else -1 for up, d in zip(rows.column("up").to_pylist(), depth, strict=True)])
    n_children = get["n_children"] + np.bincount(parent[parent >= 0], minlength=len(names))
    n_leaves = get["n_leaves"] + added_below(depth, parent, (n_children == 0).astype(np.int64))
    saved = get["saved_tokens"] + added_below(depth, parent, (get["n_convs"] - 1) * get["length"])
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.binary()), pa.array(get["conv_id"]), pa.array(depth),
         pa.array(get["conv_id"][parent], mask=parent < 0), pa.array(get["n_convs"]), pa.array(n_children),
         pa.array(n_leaves), pa.array(saved)], names=["name", *COLUMNS])


def _ends_hashes(batches):
    """(name, SHA-256 of its id list) from the list's pieces in order, read as a stream."""
    name, state = None, None
    for batch in batches:
        done = []
        for own, text in zip(batch.column("name").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if own != name:
                if state:
                    done.append((name, state.hexdigest()))
                name, state = own, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())],
                                         names=["name", "ends_sha256"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()])], names=["name", "ends_sha256"])


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def rebuild(conversations: DataFrame) -> DataFrame:
    """(conv_id, keys, lengths): the hashes and code points of the turns of every
    rebuilt conversation, which takes its first turns from its base."""
    text, role = (F.coalesce(F.col(c), F.lit("")) for c in ("text", "role"))
    turns = conversations.where("conv_id is not null").select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), "turn",
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("key"),
        F.length(text).alias("length")).repartition("base")
    # one conversation's turns are one row; a base has a hundred conversations at most
    own = turns.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "key", "length"))).alias("own"))
    heads = own.where("conv_id = base").select("base", F.slice("own", 1, MOST_HEAD).alias("head"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_HEAD + 1)).cast("int")
    both = own.join(heads, "base", "left").select("conv_id", F.concat(
        F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), taken),
        F.slice("own", taken + 1, F.greatest(F.size("own") - taken, F.lit(0)))).alias("turns"))
    return both.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), "")).alias("keys"),
                       F.transform("turns", lambda t: t["length"]).alias("lengths"))


def nodes(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """All nodes of the trie of (conv_id, keys, lengths)."""
    ordered = sequences.repartitionByRange("keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    parts = stage(ordered.mapInArrow(lambda b: _shards(b, shard_turns), _PART_SQL), "trie-shards")
    spine = parts.where(F.col("kind") == SPINE)
    sums = spine.groupBy("name", "up", "depth", "length").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    # two paths a shard: their number follows the shards, not the conversations
    whole = stage(sums.coalesce(1).mapInArrow(_whole_spines, "name binary, " + ", ".join(f"{c} long" for c in COLUMNS)), "trie-spines")
    hashes = (parts.where(F.col("kind") == ENDS).select("name", "shard", "place", "ends").repartition("name")
              .sortWithinPartitions("name", "shard", "place").select("name", "ends")
              .mapInArrow(_ends_hashes, "name binary, ends_sha256 string"))
    shared = whole.join(hashes, "name", "left").select(
        *COLUMNS, F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
    inner = parts.where(F.col("kind") == NODE)
    plain = inner.where("place is null").select(*COLUMNS, F.col("ends").alias("ends_sha256"))
    above = spine.select("shard", "place", "name").join(whole.select("name", F.col("conv_id").alias("_up")), "name").drop("name")
    hung = (inner.where("place is not null").drop("name").join(above, ["shard", "place"])
            .withColumn("parent_conv_id", F.col("_up")).select(*COLUMNS, F.col("ends").alias("ends_sha256")))
    return plain.unionByName(hung).unionByName(shared)


def report(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations."""
    return nodes(rebuild(conversations))


#: The checksum of h is written out, bit by bit, as DuckDB has none.
ORACLE = f"""
with turns as (
  select conv_id, turn, length(coalesce(text, '')) as size,
    md5(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as key
  from conversations where conv_id is not null),
placed as materialized (
  select conv_id, key, size, row_number() over (partition by conv_id order by turn nulls first, key) as pos from turns),
convs as materialized (
  select conv_id, conv_id - conv_id % 100 as base, xor(list_reduce(
    list_concat([4294967295::bigint], list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)), 4294967295::bigint) % {MOST_HEAD + 1} as h
  from (select distinct conv_id from placed)),
rebuilt as (
  select c.conv_id, p.pos, p.key, p.size from convs c join placed p on p.conv_id = c.base and p.pos <= c.h
  union all
  select c.conv_id, 1000 + p.pos, p.key, p.size from convs c join placed p on p.conv_id = c.conv_id and p.pos > c.h),
paths as materialized (
  select conv_id, row_number() over w as depth, md5(string_agg(key, '') over w) as name, size from rebuilt
  window w as (partition by conv_id order by pos rows unbounded preceding)
  union all select conv_id, 0, '', 0 from convs),
steps as materialized (
  select *, lag(name) over (partition by conv_id order by depth) as up,
    lead(name) over (partition by conv_id order by depth) is null as ends from paths),
nodes as materialized (
  select name, up, depth, size, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256
  from steps group by all),
children as (select up as name, count(*) as n_children from nodes where depth > 0 group by all),
sums as (
  select a.name, sum((n.n_convs - 1) * n.size)::bigint as saved_tokens, count(*) filter (where c.name is null) as n_leaves
  from nodes n left join children c using (name) join paths a on a.conv_id = n.conv_id and a.depth <= n.depth group by a.name)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n_children, 0) as n_children,
  s.n_leaves, s.saved_tokens, n.ends_sha256
from nodes n left join nodes p on p.name = n.up left join children c on c.name = n.name join sums s on s.name = n.name
"""
