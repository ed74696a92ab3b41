"""The trie of shared conversation prefixes, from an external mergesort whose runs carry the lengths of common prefixes."""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, materialise, parts_for, table
from tessera.llm.resampling import CRC_OF, CRC_STEPS

#: A turn in a sequence: 16 bytes of the SHA-256 of role and text, and its words as 4 bytes.
TURN = 20
#: Bytes of sequences that one sorted run holds (or one sequence), and that one range of the merge gets on average.
RUN_BYTES, RANGE_BYTES = 8 << 20, 4 << 20
ROOT = hashlib.sha256(b"").digest()[:16]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def common(a: bytes, b: bytes, turns: int) -> int:
    """Turns that a and b share from the start, given that they share so many. Wide steps first, then within the step that differs."""
    at, most = turns * TURN, min(len(a), len(b)) // TURN * TURN
    step = TURN
    while at < most:
        to = min(most, at + step)
        if a[at:to] == b[at:to]:
            at, step = to, step * 2
        elif step == TURN or to - at == TURN:
            break
        else:
            step = TURN
    return at // TURN


def sorted_run(sequences: list[tuple[bytes, int]]) -> Iterator[tuple[bytes, int, list[int]]]:
    """Distinct sequences in order, each with the turns that it shares with the one before, and the ids of the conversations that have it."""
    before, ids = None, []
    shared = 0
    for seq, conv in sorted(sequences):
        if seq == before:
            ids.append(conv)
            continue
        if before is not None:
            yield before, shared, ids
        shared = common(before, seq, 0) if before is not None else 0
        before, ids = seq, [conv]
    if before is not None:
        yield before, shared, ids


class LoserTree:
    """Merges sorted runs of (sequence, shared, ...): each match compares lengths shared with the last winner first, and turns only from there.

    A leaf's shared count is with the last winner of all. Of two contenders the one that shares more with the last winner is smaller; if both
    share as much, turns after that decide, and the loser keeps the count that it shares with the winner. So no shared turn is compared again.
    """

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.heads = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.shared = [0] * self.size
        self.losers = [0] * self.size
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        return self._match(node, self._build(2 * node), self._build(2 * node + 1))

    def _match(self, node: int, a: int, b: int) -> int:
        """The winner; the loser stays at the node."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            a, b = (b, a) if x is None else (a, b)
        elif self.shared[a] < self.shared[b]:
            a, b = b, a
        elif self.shared[a] == self.shared[b]:
            n = common(x[0], y[0], self.shared[a])
            if y[0][n * TURN : n * TURN + TURN] < x[0][n * TURN : n * TURN + TURN]:
                a, b = b, a
            self.shared[b] = n
        self.losers[node] = b
        return a

    def pairs(self) -> Iterator[tuple]:
        """Heads in order, each with the turns that it shares with the one before it in the merge."""
        while (head := self.heads[self.winner]) is not None:
            at = self.winner
            yield head, self.shared[at]
            after = self.heads[at] = next(self.runs[at], None)
            self.shared[at] = after[1] if after is not None else 0  # shared with its run's last head, which is the last winner
            node = (at + self.size) // 2
            while node:
                at = self._match(node, at, self.losers[node])
                node //= 2
            self.winner = at


class Path:
    """The open path of a sorted stream, from the root down; nodes are finished as the stream leaves them.

    An open node is [key, words, index, conv_id, n_convs, n_children, n_leaves, saved, ends, children]. A finished child waits in its parent,
    for the parent's smallest member is known only when that is finished too. Nodes of the first sequence's path may go on before this
    stream, and those still open at its end may go on after it: these are given as partial sums, without what their open children hold.
    """

    def __init__(self, firsts: bool = False):
        self.open: list[list] = []
        self.firsts = firsts  # whether the first path may have begun before
        self.first_indices = self.count = 0

    def push(self, key: bytes, words: int) -> None:
        self.open.append([key, words, self.count, None, 0, 0, 0, 0, 0, []])
        self.count += 1

    def add(self, conv: int, n: int, ends: int, children: int = 0, leaves: int = 0, saved: int = 0) -> None:
        """More members, ends and finished children for the deepest node."""
        _add(self.open[-1], conv, n, children, leaves, saved, ends)

    def leave(self, depth: int) -> Iterator[tuple]:
        """Finishes the nodes below depth."""
        while len(self.open) > depth:
            node = self.open.pop()
            if node[2] < self.first_indices:
                yield from _partial(node, len(self.open))
                continue
            key, words, _, conv, n, children, leaves, saved, ends, held = node
            leaves, saved = leaves if children else 1, saved + (n - 1) * words
            for child in held:
                yield (*child, None, conv)
            done = (None, None, key, len(self.open), None, conv, n, children, leaves, saved, ends)
            if self.open:
                _add(self.open[-1], conv, n, 1, leaves, saved, 0)
                self.open[-1][9].append(done)
            else:
                yield (*done, None, None)

    def follow(self, seq: bytes, shared: int) -> Iterator[tuple]:
        """Goes to a sequence that shares so many turns with the one before."""
        if not self.open:
            self.push(ROOT, 0)
        yield from self.leave(shared + 1)
        for at in range(shared * TURN, len(seq), TURN):
            turn = seq[at : at + TURN]
            self.push(hashlib.sha256(self.open[-1][0] + turn).digest()[:16], int.from_bytes(turn[16:]))
        if self.firsts and not self.first_indices:
            self.first_indices = self.count

    def rest(self) -> Iterator[tuple]:
        """What is still open, as partial sums."""
        while self.open:
            node = self.open.pop()
            yield from _partial(node, len(self.open))


def _add(node: list, conv: int | None, n: int, children: int, leaves: int, saved: int, ends: int) -> None:
    if conv is not None:
        node[3] = conv if node[3] is None else min(node[3], conv)
    node[4] += n
    node[5] += children
    node[6] += leaves
    node[7] += saved
    node[8] += ends


def _partial(node: list, depth: int) -> Iterator[tuple]:
    key, words, index, conv, n, children, leaves, saved, ends, held = node
    for child in held:
        yield (*child, key, None)
    yield (index, words, key, depth, None, conv, n, children, leaves, saved, ends, None, None)


#: Nodes as tasks write them: index and words of partial ones, parent_key of those whose parent is partial, parent_conv_id of the others.
_NODE = pa.schema([("index", pa.int64()), ("words", pa.int64()), ("key", pa.binary()), ("depth", pa.int64()), ("_", pa.int64()), ("conv_id", pa.int64()), *((c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "ends")), ("parent_key", pa.binary()), ("parent_conv_id", pa.int64())])
_NODE_DDL = ", ".join(f"{f.name} {'binary' if pa.types.is_binary(f.type) else 'long'}" for f in _NODE).replace("_ long, ", "", 1)


def _batches(nodes: Iterator[tuple], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    rows = []

    def made():
        t = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _NODE, strict=True)], schema=_NODE).drop_columns(["_"])
        return t.combine_chunks().to_batches()[0]

    for node in nodes:
        rows.append(node)
        if len(rows) == size:
            yield made()
            rows.clear()
    if rows:
        yield made()


_RUN_DDL = "run long, place long, seq binary, shared long, n long, conv_id long, ids array<long>, key binary"


def _make_runs(batches):
    """Rows of conversations, each conversation's together and in order, into sorted runs of distinct sequences."""
    from pyspark import TaskContext

    run = TaskContext.get().partitionId() << 32
    done: list[tuple[bytes, int]] = []
    size, conv, turns = 0, None, []

    def out():
        rows, keys = [], [ROOT]
        for place, (seq, shared, ids) in enumerate(sorted_run(done)):
            del keys[shared + 1 :]
            for at in range(shared * TURN, len(seq), TURN):
                keys.append(hashlib.sha256(keys[-1] + seq[at : at + TURN]).digest()[:16])
            rows.append((run, place, seq, shared, len(ids), ids[0], ids, keys[-1]))
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        names = ["run", "place", "seq", "shared", "n", "conv_id", "ids", "key"]
        for i in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000], strict=True), types, strict=True)], names=names)

    for b in batches:
        for c, item in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if c != conv:
                if conv is not None:
                    done.append((b"".join(turns), conv))
                    size += len(done[-1][0]) + 64
                if size >= RUN_BYTES:
                    yield from out()
                    run, done, size = run + 1, [], 0
                conv, turns = c, []
            if item is not None:
                turns.append(item)
    if conv is not None:
        done.append((b"".join(turns), conv))
    if done:
        yield from out()


def _merge(batches):
    """A range's part of all runs, merged, as nodes."""
    runs: dict[int, list] = {}
    for b in batches:
        for run, *item in zip(*(c.to_pylist() for c in b.columns), strict=True):
            runs.setdefault(run, []).append(item)
    if not runs:
        return
    for items in runs.values():
        items.sort()  # by place: a run's rows may come in any order

    def nodes():
        path = Path(firsts=True)
        for (seq, _, n, conv), shared in LoserTree([iter([item[1:] for item in items]) for items in runs.values()]).pairs():
            yield from path.follow(seq, shared)
            path.add(conv, n, n)
        yield from path.rest()

    yield from _batches(nodes())


def _join_borders(batches):
    """Partial nodes of all ranges, in order of ranges and from the root down in each, into finished ones."""

    def nodes():
        path = Path()
        for b in batches:
            for words, key, depth, conv, n, children, leaves, saved, ends in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True):
                if len(path.open) <= depth or path.open[depth][0] != key:
                    yield from path.leave(depth)
                    path.push(key, words)
                _add(path.open[depth], conv, n, children, leaves, saved, ends)
        yield from path.leave(0)

    yield from _batches(nodes())


def _hash_ends(batches):
    """Rows of (key, text of ids), each key's together and in order, into a SHA-256 a key."""
    key, sha = None, None
    rows = []
    for b in batches:
        for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    rows.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256(text.encode())
            else:
                sha.update(b"," + text.encode())
        if len(rows) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["end_key", "ends_sha256"])
            rows = []
    if key is not None:
        rows.append((key, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["end_key", "ends_sha256"])


def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 1) and item (the turn as TURN bytes) of each turn. Texts are read here and nowhere after.

    Null turns come first; turns of one number are ordered by item. A null role or text counts as empty. Rows without a conv_id belong to
    no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.encode(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256)
    item = F.unhex(F.concat(F.substring(digest, 1, 32), F.lpad(F.hex(F.regexp_count(text, F.lit(WORD))), 8, "0")))
    rows = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), item.alias("item")).filter("conv_id IS NOT NULL")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "item")
    return rows.select("conv_id", F.row_number().over(order).alias("pos"), "item")


def with_shared_heads(turns: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """Conversations that begin like the first of their group: of conversation c, h = CRC-32 of its decimal id modulo heads, the first h turns
    are those of conversation c - c % group (fewer if it has fewer, none if there is none), then come its own after its first h.

    Takes and gives conv_id, pos, item. A conversation that is left without turns is a row of pos 0 and no item; all have that row.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % heads
    convs = turns.filter("pos = 1").select("conv_id")
    first = turns.filter((F.col("conv_id") % group == 0) & (F.col("pos") < heads)).select(F.col("conv_id").alias("base"), "pos", "item")
    given = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(first, "base").filter(F.col("pos") <= h).select("conv_id", "pos", "item")
    empty = convs.select("conv_id", F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("item"))
    return turns.filter(F.col("pos") > h).unionByName(given).unionByName(empty)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of the sequences of turns (conv_id, pos, item; see numbered_turns()), a row a node.

    Columns: key (binary, a chain of hashes from the root), depth, conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (in the node's subtree, members but one times words of the last turn), ends (conversations that end here), ends_sha256 (of
    their ids, ascending, joined by commas).

    An external mergesort: tasks write sorted runs of at most RUN_BYTES, equal sequences once with their number, each with the turns shared
    with the one before. Runs are dealt by ranges of sequences, and a range's runs are merged by a loser tree that compares turns only from
    those known to be shared. The merged stream is a walk through the trie, and a stack of the open path gives a node when the walk leaves it.
    Nodes that may go on in another range (on the path of a range's first or last sequence) are given as partial sums and joined in a
    second walk over these alone: two paths a range. So a prefix that all conversations share costs no task more than its range.

    The ids of a node's ends are put in order by blocks of 4096 numbers first, then hashed block after block in one task a node, as a
    SHA-256 asks for. A task holds one range's sequences (RANGE_BYTES on average) or one conversation's (20 bytes a turn). An empty table
    gives no node.
    """
    rows = turns.select("conv_id", "pos", "item").repartition("conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "item")
    runs = materialise(rows.mapInArrow(_make_runs, _RUN_DDL), "runs")
    dealt = runs.select("run", "place", "seq", "shared", "n", "conv_id").repartitionByRange(parts_for(runs, RANGE_BYTES >> 20), "seq")
    nodes = materialise(dealt.mapInArrow(_merge, _NODE_DDL).withColumn("part", F.spark_partition_id()), "nodes")
    partial = nodes.filter("index IS NOT NULL").select("part", "index", "words", "key", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
    border = materialise(partial.repartition(1).sortWithinPartitions("part", "index").mapInArrow(_join_borders, _NODE_DDL), "border")
    columns = ["key", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    closed = nodes.filter("index IS NULL")
    parents = border.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found"))
    below = closed.filter("parent_key IS NOT NULL").join(parents, "parent_key").withColumn("parent_conv_id", F.col("found"))
    out = closed.filter("parent_key IS NULL").select(*columns).unionByName(below.select(*columns)).unionByName(border.select(*columns))
    ids = runs.select("key", F.explode("ids").alias("id"))
    blocks = ids.groupBy("key", F.shiftright("id", 12).alias("block")).agg(F.concat_ws(",", F.array_sort(F.collect_list("id")).cast("array<string>")).alias("text"))
    shas = blocks.repartition("key").sortWithinPartitions("key", "block").select("key", "text").mapInArrow(_hash_ends, "end_key binary, ends_sha256 string")
    ended = out.filter("ends > 0").join(shas, F.col("key") == F.col("end_key")).drop("end_key")
    return ended.unionByName(out.filter("ends = 0").withColumn("ends_sha256", F.lit(NO_ENDS)))


def op12_prefix_trie(spark, sf_dir):
    """The trie of all conversations, rebuilt with shared heads; see prefix_trie()."""
    turns = materialise(numbered_turns(table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie(with_shared_heads(turns)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


OP12_SQL = f"""
WITH crc AS ({CRC_STEPS}),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {CRC_OF.format(w="conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t), crc),
r AS (SELECT t.* FROM t JOIN c USING (conv_id) WHERE pos > h
      UNION ALL SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h),
q AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, sha256(strlen(role) || ':' || role || text) AS item, len(regexp_extract_all(text, '{WORD}')) AS words FROM r),
p AS (SELECT conv_id, depth, words, string_agg(item, '') OVER (PARTITION BY conv_id ORDER BY depth) AS k FROM q UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT k, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words FROM p GROUP BY k),
up AS (SELECT n.k, p.k AS parent FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
ch AS (SELECT parent AS k, count(*) AS n_children FROM up GROUP BY parent),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (k)),
sub AS (SELECT p.k, sum((x.n_children = 0)::BIGINT) AS n_leaves, sum((x.n_convs - 1) * x.words) AS saved FROM x JOIN p ON p.conv_id = x.conv_id AND p.depth <= x.depth GROUP BY p.k),
e AS (SELECT k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, arg_max(k, depth) AS k FROM p GROUP BY conv_id) GROUP BY k)
SELECT x.conv_id, x.depth::BIGINT AS depth, n2.conv_id AS parent_conv_id, x.n_convs, x.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM x JOIN sub USING (k) LEFT JOIN up USING (k) LEFT JOIN n n2 ON n2.k = up.parent LEFT JOIN e ON e.k = x.k
"""
