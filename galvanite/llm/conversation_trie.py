"""The prefix trie of conversations.

Turns become ids of a dictionary, so that a conversation is a list of numbers;
equal lists are one sequence. Sequences are dealt to buckets by their first
ids, most significant first: a bucket that is too large for a task is split by
the id after its common prefix, round after round, until every bucket is
local. A local bucket is finished by multikey quicksort, whose recursion emits
a node wherever it has put equal ids together; the split buckets' own nodes
are made of their children's sums, from the deepest round up."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galvanite.llm.common import joined_back, partitions, written

NOTHING = hashlib.sha256(b"").hexdigest()
SEQUENCES = ["first", "n", "ids", "sizes", "ends"]


def encoded(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Each conversation as conv_id, ids and sizes: dictionary ids of its
    turns, which are equal when role and text are, and their code points."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    name = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("conv_id"), "turn", name.alias("name"), F.length(text).alias("size"))
    dictionary = rows.groupBy("name").agg(F.count("*").alias("used")).withColumn("id", F.monotonically_increasing_id())
    coded = joined_back(rows, written(dictionary, "dictionary"), ["name"], "used")
    own = F.sort_array(F.collect_list(F.struct("turn", "name", "id", "size")))
    return coded.groupBy("conv_id").agg(own.alias("own")).select("conv_id", F.col("own.id").alias("ids"), F.col("own.size").alias("sizes"))


def with_heads(own: DataFrame, head: Column, every: int, most: int) -> DataFrame:
    """Conversations whose first ``head`` turns (at most ``most``) are those
    of the conversation whose id is theirs, rounded to ``every``."""
    none = {c: F.array().cast(kind) for c, kind in own.dtypes if c != "conv_id"}
    heads = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), *(F.slice(c, 1, most).alias(f"head_{c}") for c in none))
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("head", head.cast("int")).join(heads, "base", "left")
    return joined.select("conv_id", *(F.concat(F.slice(F.coalesce(f"head_{c}", empty), F.lit(1), F.col("head")), F.slice(c, F.col("head") + 1, F.size(c))).alias(c) for c, empty in none.items()))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted ids of one sequence, as text."""
    for batch in batches:
        firsts, ids = batch["first"].to_pylist(), batch["conv_id"].to_pylist()
        edges = [0, *(i for i in range(1, len(ids)) if firsts[i] != firsts[i - 1]), len(ids)] if ids else [0]
        runs = list(zip(edges, edges[1:], strict=False))
        yield pa.RecordBatch.from_pydict({"first": [firsts[a] for a, _ in runs], "start": [ids[a] for a, _ in runs], "text": [",".join(map(str, ids[a:b])) for a, b in runs]}, pa.schema([("first", pa.int64()), ("start", pa.int64()), ("text", pa.string())]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each sequence's runs, joined by commas; a run at a time."""
    now, state, done = None, None, []
    for batch in batches:
        for first, text in zip(batch["first"].to_pylist(), batch["text"].to_pylist(), strict=True):
            if first == now:
                state.update(b"," + text.encode())
            else:
                done += [(now, state.hexdigest())] if state else []
                now, state = first, hashlib.sha256(text.encode())
    done += [(now, state.hexdigest())] if state else []
    yield pa.RecordBatch.from_pydict({"first": [a for a, _ in done], "ends": [b for _, b in done]}, pa.schema([("first", pa.int64()), ("ends", pa.string())]))


def distinct_sequences(conversations: DataFrame) -> DataFrame:
    """One row for each different sequence: first (its smallest conv_id), n
    (its conversations), ids, sizes and ends, the SHA-256 of their ids.

    The ids of a sequence are sorted over all partitions and hashed in runs,
    so a group of any size is neither one row nor one task's memory."""
    spread = partitions(conversations.sparkSession)
    groups = written(conversations.groupBy("ids", "sizes").agg(F.min("conv_id").alias("first"), F.count("*").alias("n")), "sequences")
    repeated = written(groups.where("n > 1").select("ids", "first", "n"), "repeated")
    members = joined_back(conversations.select("conv_id", "ids"), repeated, ["ids"], "n").where("first is not null").select("first", "conv_id")
    runs = members.repartitionByRange(spread, "first", "conv_id").sortWithinPartitions("first", "conv_id").mapInArrow(_chunks, "first long, start long, text string")
    digests = runs.repartition(spread, "first").sortWithinPartitions("first", "start").mapInArrow(_digests, "first long, ends string")
    alone = groups.where("n = 1").withColumn("ends", F.sha2(F.col("first").cast("string"), 256))
    return alone.select(SEQUENCES).unionByName(groups.where("n > 1").join(digests, "first").select(SEQUENCES))


class _Nodes:
    """Nodes of one bucket, parents before children."""

    def __init__(self) -> None:
        self.parent, self.depth, self.size, self.conv, self.n, self.ends = [], [], [], [], [], []

    def add(self, parent: int, depth: int, size: int) -> int:
        self.parent.append(parent)
        self.depth.append(depth)
        self.size.append(size)
        self.conv.append(None)
        self.n.append(0)
        self.ends.append(NOTHING)
        return len(self.parent) - 1

    def end(self, node: int, sequence: tuple) -> None:
        self.conv[node], self.n[node], self.ends[node] = sequence[0], sequence[1], sequence[4]


def multikey_quicksort(sequences: list[tuple], depth: int) -> _Nodes:
    """The trie of different sequences (as in SEQUENCES) that share their
    first ``depth`` ids. A group that agrees in one more id is a node; groups
    with smaller and larger ids go on as siblings."""
    out = _Nodes()
    size = lambda s, d: s[3][d - 1] if d else 0
    todo = [(sequences, depth, out.add(-1, depth, size(sequences[0], depth)), True)]
    while todo:
        group, d, node, fresh = todo.pop()
        if fresh:  # all of the node's sequences: one may end here
            if len(group) == 1:
                for d in range(d + 1, len(group[0][2]) + 1):
                    node = out.add(node, d, size(group[0], d))
                out.end(node, group[0])
                continue
            ended = [s for s in group if len(s[2]) == d]
            if ended:
                out.end(node, ended[0])
                group = [s for s in group if len(s[2]) > d]
        pivot = group[len(group) // 2][2][d]
        less, more = [s for s in group if s[2][d] < pivot], [s for s in group if s[2][d] > pivot]
        same = [s for s in group if s[2][d] == pivot]
        todo += [(part, d, node, False) for part in (less, more) if part]
        todo.append((same, d + 1, out.add(node, d + 1, size(same[0], d + 1)), True))
    return out


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
LOCAL = f"{NODE}, round int, up array<long>"
_KIND = pa.schema([*((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string()), ("round", pa.int32()), ("up", pa.list_(pa.int64()))])


def _summed(nodes: _Nodes, round_: int, prefix: list[int], out: dict[str, list]) -> None:
    """Adds a bucket's nodes, with the sums of their subtrees. ``up``, of the
    bucket's own node only, is the prefix of its parent."""
    count = len(nodes.parent)
    children, leaves, saved, conv, n = [0] * count, [0] * count, [0] * count, nodes.conv, nodes.n
    for i in range(count - 1, -1, -1):
        leaves[i] = leaves[i] or 1
        saved[i] += (n[i] - 1) * nodes.size[i]
        p = nodes.parent[i]
        if p >= 0:
            n[p] += n[i]
            conv[p] = conv[i] if conv[p] is None else min(conv[p], conv[i])
            children[p] += 1
            leaves[p] += leaves[i]
            saved[p] += saved[i]
    parents = [None if p < 0 else conv[p] for p in nodes.parent]
    top = [prefix[:-1] if prefix else None] + [None] * (count - 1)
    for name, values in zip(_KIND.names, (conv, nodes.depth, parents, n, children, leaves, saved, nodes.ends, [round_] * count, top), strict=True):
        out[name] += values


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the partition's buckets; rows come sorted by prefix."""
    out: dict[str, list] = {c: [] for c in _KIND.names}
    prefix, bucket = None, []
    for batch in batches:
        for own, round_, *sequence in zip(*(batch[c].to_pylist() for c in ("prefix", "round", *SEQUENCES)), strict=True):
            if own != prefix and bucket:
                _summed(multikey_quicksort(bucket, len(prefix)), was, prefix, out)
                bucket = []
                if len(out["depth"]) > 20_000:
                    yield pa.RecordBatch.from_pydict(out, _KIND)
                    out = {c: [] for c in _KIND.names}
            prefix, was = own, round_
            bucket.append(tuple(sequence))
    if bucket:
        _summed(multikey_quicksort(bucket, len(prefix)), was, prefix, out)
    yield pa.RecordBatch.from_pydict(out, _KIND)


def _split(current: DataFrame, limit: int, round_: int) -> tuple[DataFrame, DataFrame]:
    """The buckets of ``current`` with more than ``limit`` turns in two or more
    sequences, with their common prefix and its sizes; and all rows, marked
    with the common prefix of theirs."""
    loads = current.groupBy("prefix").agg(F.sum(F.size("ids") + 1).alias("load"), F.count("*").alias("k"))
    large = written(loads.where((F.col("load") > limit) & (F.col("k") > 1)).select("prefix", "load"), "large")
    marked = joined_back(current, large, ["prefix"], "load")
    ends = marked.where("load is not null").groupBy("prefix").agg(F.min("ids").alias("low"), F.max(F.struct("ids", "sizes")).alias("high"), F.first("load").alias("load"))
    differ = F.array_position(F.transform(F.arrays_zip("low", F.col("high.ids").alias("top")), lambda x: x["low"].eqNullSafe(x["top"])), False)
    length = F.when(differ > 0, differ - 1).otherwise(F.size("low")).cast("int")
    common = ends.select("prefix", "load", length.alias("c"), "low", F.col("high.sizes").alias("all")).select("prefix", "load", F.slice("low", F.lit(1), F.col("c")).alias("common"), F.slice("all", F.lit(1), F.col("c")).alias("path"))
    common = written(common, f"common_{round_}")
    return common, joined_back(current, common, ["prefix"], "load")


def prefix_trie(conversations: DataFrame, *, limit: int | None = None) -> DataFrame:
    """The nodes of the trie of ``conversations`` (conv_id, ids, sizes), one
    row for each distinct sequence of first ids: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conv_id is the smallest member, n_convs their number; n_leaves and
    saved_tokens, (n_convs - 1) times the size of the last turn, are summed
    over the subtree; ends_sha256 is of the ids of the members that end at the
    node, ascending, joined by commas. The root has depth 0 and no parent. No
    conversations give no node.

    A bucket is local up to ``limit`` turns: by default what a shuffle
    partition has of them, between 256 and 500,000. Copies are one sequence
    before, and a bucket's common prefix is skipped at once, so a round is
    only needed where many sequences branch. A conversation's ids must fit
    in a task's memory (12 bytes a turn); its texts need not."""
    spark = conversations.sparkSession
    spread = partitions(spark)
    sequences = written(distinct_sequences(conversations), "distinct")
    if limit is None:
        total = sequences.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
        limit = min(max(total // spread, 256), 500_000)
    current = sequences.withColumn("prefix", F.array().cast("array<long>"))
    locals_, commons, ended = [], [], []
    while True:
        common, marked = _split(current, limit, len(commons))
        locals_.append(marked.where("common is null").select("prefix", F.lit(len(commons)).alias("round"), *SEQUENCES))
        if common.isEmpty():
            break
        inside = marked.where("common is not null")
        deeper = F.size("ids") > F.size("common")
        commons.append(common)
        ended.append(inside.where(~deeper).select("common", F.col("first").alias("own_first"), F.col("n").alias("own_n"), F.col("ends").alias("own_ends")))
        current = written(inside.where(deeper).select(*SEQUENCES, F.expr("slice(ids, 1, size(common) + 1)").alias("prefix")), "buckets")
    dealt = locals_[0]
    for more in locals_[1:]:
        dealt = dealt.unionByName(more)
    found = written(dealt.repartition(spread, "prefix").sortWithinPartitions("prefix").mapInArrow(_finish, LOCAL), "nodes")
    own = [c.split()[0] for c in NODE.split(", ")]
    if not commons:
        return found.select(own)
    tops, uppers = found.where("up is not null"), []
    sums = ["up", "conv_id", "n_convs", "n_leaves", "saved_tokens"]
    for k in range(len(commons) - 1, -1, -1):
        below = tops.where(F.col("round") == k + 1).select(sums)
        if uppers:
            below = below.unionByName(uppers[-1].where("up is not null").select(sums))
        uppers.append(written(_upper(commons[k], below, ended[k]), f"upper_{k}"))
    every = uppers[0]
    for more in uppers[1:]:
        every = every.unionByName(more)
    named = written(every.select(F.col("common").alias("up"), F.col("conv_id").alias("above"), F.col("n_children").alias("weight")), "parents")
    top = joined_back(tops, named, ["up"], "weight").withColumn("parent_conv_id", F.col("above"))
    chains = _chains(joined_back(every, named, ["up"], "weight"))
    return found.where("up is null").select(own).unionByName(top.select(own)).unionByName(chains.select(own))


def _upper(common: DataFrame, below: DataFrame, ended: DataFrame) -> DataFrame:
    """Sums of the split buckets of one round, from those of their children's
    own nodes and the sequence that ends at the common prefix. saved_tokens
    is that of the bucket's own node, ``up`` the prefix of its parent."""
    kids = below.groupBy("up").agg(F.sum("n_convs").alias("n"), F.min("conv_id").alias("least"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("kids_saved"), F.count("*").alias("n_children"))
    joined = common.join(kids.withColumnRenamed("up", "common"), "common").join(ended, "common", "left")
    summed = joined.withColumn("n_convs", F.col("n") + F.coalesce("own_n", F.lit(0))).withColumn("conv_id", F.least("least", "own_first"))
    up = F.when(F.size("prefix") > 0, F.expr("slice(prefix, 1, size(prefix) - 1)"))
    return summed.select("prefix", "common", "path", up.alias("up"), "conv_id", "n_convs", "n_leaves", "n_children", "kids_saved", _saved(F.size("prefix")).alias("saved_tokens"), F.coalesce("own_ends", F.lit(NOTHING)).alias("ends_sha256"))


def _saved(depth: Column) -> Column:
    """saved_tokens at a depth of a bucket's chain of single children."""
    rest = F.slice("path", F.greatest(depth, F.lit(1)), F.greatest(F.size("path"), F.lit(0)))
    return F.col("kids_saved") + (F.col("n_convs") - 1) * F.aggregate(rest, F.lit(0).cast("long"), lambda a, x: a + x)


def _chains(upper: DataFrame) -> DataFrame:
    """The nodes of split buckets: from the bucket's own down to the one of
    the common prefix. All have the same members."""
    top, last = F.size("prefix"), F.size("common")
    each = upper.withColumn("at", F.explode(F.sequence(top, last)))
    parent = F.when(F.col("at") > top, F.col("conv_id")).otherwise(F.col("above"))
    children = F.when(F.col("at") == last, F.col("n_children")).otherwise(F.lit(1).cast("long"))
    ends = F.when(F.col("at") == last, F.col("ends_sha256")).otherwise(F.lit(NOTHING))
    return each.select("conv_id", F.col("at").cast("long").alias("depth"), parent.alias("parent_conv_id"), "n_convs", children.alias("n_children"), "n_leaves", _saved(F.col("at")).alias("saved_tokens"), ends.alias("ends_sha256"))
