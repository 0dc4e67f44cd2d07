"""Language-model scores by a hashed maximum-entropy model with a softmax factored along a tree of classes.

Counting: every training text is cut into words and an end token; counts of all tokens are summed by their 64-bit hash.
The counts of the ``COUNTS`` most frequent tokens travel with the tasks; all others are joined to the texts by a shuffle.
The ``HEAD`` most frequent ones have leaves of their own in the model.

Model: every word is a leaf of a tree of classes, split into at most ``FAN`` parts of about equal frequency at each node;
frequent tokens are leaves of their own, all others are dealt by their hash into groups of about ``GROUP`` tokens.  A
token's probability is the product of softmaxes along its path, each over features of the context hashed with the node:
the previous word, the previous two, and the one before the previous (a skip).  Within a group it is the token's share of
their smoothed counts, one share left for unseen ones, so that probabilities sum to one.  Biases start at the counts,
so the untrained model is the unigram model.  Groups grow in number with the distinct tokens, buckets of features with
the square root of the training tokens, as every task holds them all.

Training: texts are dealt to rounds and tasks by a hash of id and text, so each is used once and the split of the table does
not matter.  Each round hands the weights to all tasks; a task takes gradient steps over batches of its own tokens and
sends its change of every bucket with the number of tokens behind it; changes are added up by bucket in Spark and
averaged by these numbers.

Scoring: sparse gathers of weight rows in batches of tokens.

Edge cases: null and empty texts are the end token alone; texts are used whole; without training texts every token is
unseen; rows with the same id and text get the same answer; null ids are allowed; empty tables give an empty result;
other columns are not carried.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import textkit
from lectern.llm.runtime import arrow_batches, spill

HEAD = 1 << 17
#: Counts of so many tokens travel with the tasks; the others are joined to the texts.
COUNTS = 1 << 20
FAN = 16
GROUP = 256
#: Buckets of a feature: 2 to the power of BITS at least, about BUCKETS times the square root of the training tokens, and 2 to
#: the power of MOST_BITS at most, as every task holds 192 bytes a bucket.
BITS, BUCKETS, MOST_BITS = 13, 16, 20
#: A training task sees about this many times the square root of all training tokens, or more.
TASK, LEAST_TASKS = 1000, 8
#: Tasks whose changes one group adds up; sums of more tasks are added up in turn.
LANE = 64
ROUNDS = 2
BATCH = 2048
RATE = 0.7
#: Weights are held within these bounds after each round, so that exponentials of their sums stay finite.
MOST_WEIGHT = 20.0
SMOOTH = 0.1
_END = np.uint64(0x51ED270B35AF1C07)
_START = np.uint64(0x2B7E151628AED2A6)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]
_BLOCK = 256


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and of an end after each text, and each text's first index."""
    data, offsets = textkit.buffers(column)
    starts, ends, bounds = textkit.words(data, offsets)
    hashes = textkit.word_hashes(data, starts, ends)
    return np.insert(hashes, bounds[1:], _END), bounds + np.arange(len(bounds))


def _count(batches):
    """(h, c): token counts of the task, sent on whenever they have grown large."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def folded():
        h, c = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        unique, at = np.unique(h, return_inverse=True)
        return unique, np.bincount(at, c, minlength=len(unique)).astype(np.int64)

    def rows(part):
        return pa.RecordBatch.from_arrays([pa.array(part[0].view(np.int64)), pa.array(part[1])], names=["h", "c"])

    for batch in batches:
        for i, j in textkit.slices(textkit.buffers(batch.column(0))[1]):
            held.append(np.unique(tokens(batch.column(0).slice(i, j - i))[0], return_counts=True))
            if sum(len(x[0]) for x in held) > 2_000_000:
                held[:] = [folded()]
                if len(held[0][0]) > 1_000_000:
                    yield rows(held.pop())
    if held:
        yield rows(folded())


@dataclass
class Model:
    """Counts of frequent tokens, the tree and the weights; leaves are frequent tokens and groups of others."""

    head: np.ndarray  # sorted hashes
    head_count: np.ndarray
    rest: np.ndarray  # sorted hashes of the tokens next to the head in frequency
    rest_count: np.ndarray
    index: np.ndarray  # by the upper bits of a hash, where in the head it would begin
    total: int
    distinct: int
    group_mass: np.ndarray  # smoothed counts of each group, one unseen token included
    leaf: np.ndarray  # the leaf of each frequent token, then of each group
    path_first: np.ndarray  # by leaf, into the nodes and children on its path
    path_node: np.ndarray
    path_child: np.ndarray
    bias: np.ndarray  # (node, child)
    weights: np.ndarray  # (feature, bucket, child)

    @property
    def known(self) -> np.ndarray:
        return self.head


def grow_tree(mass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(path_first, path_node, path_child, bias) over leaves of falling mass."""
    cum = np.concatenate([[0.0], np.cumsum(mass)]).tolist()
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    biases = []
    open_ = [(0, len(mass), 0)] if len(mass) > 1 else []
    while open_:
        a, b, depth = open_.pop()
        if depth == len(levels):
            levels.append((np.full(len(mass), -1, np.int32), np.zeros(len(mass), np.uint8)))
        nodes, children = levels[depth]
        nodes[a:b] = len(biases)
        bias, start = np.full(FAN, -1e4, np.float32), a
        for child in range(FAN):
            parts = FAN - child
            end = b if parts == 1 else start + 1 if b - start <= parts else bisect.bisect_left(cum, cum[start] + (cum[b] - cum[start]) / parts, start + 1, b - parts + 1)
            children[start:end] = child
            bias[child] = math.log((cum[end] - cum[start]) / (cum[b] - cum[a]))
            if end - start > 1:
                open_.append((start, end, depth + 1))
            start = end
            if start == b:
                break
        biases.append(bias)
    if not levels:
        return np.zeros(len(mass) + 1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint8), np.zeros((1, FAN), np.float32)
    nodes, children = (np.stack([level[k] for level in levels], 1) for k in range(2))
    some = nodes >= 0
    return np.concatenate([[0], np.cumsum(some.sum(1))]), nodes[some], children[some], np.array(biases)


def _most_frequent(vocabulary: DataFrame, head: int) -> tuple[Column, int, int]:
    """(which rows of (h, c) are in the head, tokens, distinct tokens).

    At most ``head`` rows, of the highest counts; of the count at which they no longer fit, those with the lowest hashes.
    Three histograms, each of the part that the one before it leaves open, so that no row has to be ordered.
    """

    def room_in(rows: DataFrame, key: Column, room: int, rising: bool) -> tuple[int | None, int]:
        """The first key, from the best, whose rows no longer fit, and the room left for it."""
        found = rows.groupBy(key.cast("long").alias("k")).agg(F.count("*").alias("n")).collect()
        for r in sorted(found, key=lambda r: r["k"] if rising else -r["k"]):
            if r["n"] > room:
                return r["k"], room
            room -= r["n"]
        return None, room

    level = F.floor(F.log2("c") * 16)
    total = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    first, room = room_in(vocabulary, level, head, False)
    if first is None:
        return F.lit(True), int(total["n"]), int(total["v"])
    edge = vocabulary.where(level == first)
    count, room = room_in(edge, F.col("c"), room, False)
    if count is None:
        return level >= first, int(total["n"]), int(total["v"])
    slot = F.shiftrightunsigned("h", 48)
    last, room = room_in(edge.where(F.col("c") == count), slot, room, True)
    return (F.col("c") > count) | ((F.col("c") == count) & (slot < (1 << 16 if last is None else last))), int(total["n"]), int(total["v"])


def new_model(vocabulary: DataFrame, head: int = HEAD, counts: int = COUNTS) -> Model:
    """From (h, c) of all tokens; only the ``counts`` most frequent reach the driver, as Arrow columns of 16 bytes a token."""
    among, n, v = _most_frequent(vocabulary, max(head, counts))
    top = vocabulary.where(among).select("h", "c").toArrow()
    h, c = top["h"].to_numpy().view(np.uint64), top["c"].to_numpy()
    del top
    order = np.lexsort((h, -c))
    first, rest = np.sort(order[:head]), order[head:]
    first, rest = first[np.argsort(h[first])], rest[np.argsort(h[rest])]
    groups = 1 << max(0, math.ceil(math.log2(max(1, v - len(first)) / GROUP)))
    group = F.col("h").bitwiseAND(F.lit(groups - 1))
    found = vocabulary.where(~among).groupBy(group.alias("g")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).toArrow()
    group_mass = np.full(groups, SMOOTH)
    group_mass[found["g"].to_numpy()] += found["n"].to_numpy() + SMOOTH * found["v"].to_numpy()
    np.add.at(group_mass, (h[rest] & np.uint64(groups - 1)).astype(np.int64), c[rest] + SMOOTH)
    rest, rest_count, h, c = h[rest], c[rest], h[first], c[first]
    mass = np.concatenate([c + SMOOTH, group_mass])
    order = np.argsort(-mass, kind="stable")
    leaf = np.empty(len(mass), np.int64)
    leaf[order] = np.arange(len(mass))
    bits = min(MOST_BITS, max(BITS, round(math.log2(BUCKETS * math.sqrt(max(1, n))))))
    slots = max(1, 2 * len(h)).bit_length()
    index = np.searchsorted(h, np.arange(1 << slots, dtype=np.uint64) << np.uint64(64 - slots))
    return Model(h, c, rest, rest_count, np.append(index, len(h)), n, v, group_mass, leaf, *grow_tree(mass[order]), np.zeros((3, 1 << bits, FAN), np.float32))


def contexts(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The previous word and the one before it, of each token."""
    one, two = np.empty_like(h), np.empty_like(h)
    one[1:], two[2:] = h[:-1], h[:-2]
    first = bounds[:-1]
    one[first] = two[first] = _START
    second = first + 1
    two[second[second < bounds[1:]]] = _START
    return one, two


def _groups(model: Model, h: np.ndarray) -> np.ndarray:
    """The group of each token, if it is not in the head."""
    return (h & np.uint64(len(model.group_mass) - 1)).astype(np.int64)


def _steps(model: Model, h: np.ndarray, one: np.ndarray, two: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(token, node, child, buckets of the features) of all steps on the tokens' paths; ``at`` has the tokens' places in the head if they are known."""
    at = _headed(model, h) if at is None else at
    leaf = model.leaf.take(np.where(at >= 0, at, len(model.head) + _groups(model, h)))
    first = model.path_first.take(leaf)
    many = model.path_first.take(leaf + 1) - first
    owner = np.repeat(np.arange(len(h)), many)
    step = np.arange(len(owner)) + np.repeat(first - np.cumsum(many) + many, many)
    node = model.path_node.take(step)
    shift = np.uint64(64 - (model.weights.shape[1].bit_length() - 1))
    salt = (node.astype(np.uint64) + np.uint64(1)) * _ODD[4]
    buckets = []
    for key, odd in ((one * _ODD[0], _ODD[2]), (one * _ODD[1] + two * _ODD[2], _ODD[3]), (two * _ODD[3], _ODD[1])):
        bucket = key.take(owner)
        bucket += salt
        bucket *= odd
        bucket >>= shift
        buckets.append(bucket.view(np.int64))
    return owner, node, model.path_child.take(step), buckets


def _summed(bias: np.ndarray, weights: np.ndarray, buckets: list[np.ndarray]) -> np.ndarray:
    z = weights[0].take(buckets[0], axis=0)
    z += bias
    for table, b in zip(weights[1:], buckets[1:], strict=True):
        z += table.take(b, axis=0)
    return z


def _exp_sums(z: np.ndarray) -> np.ndarray:
    """Replaces ``z`` by its exponentials; a column of sums of its rows.

    Biases are logarithms of shares and changes of weights sum to zero over a row, so no row is far from zero as a whole.
    """
    np.exp(z, out=z)
    return z @ np.ones((z.shape[1], 1), z.dtype)


def _descend(weights: np.ndarray, seen: np.ndarray, bucket: np.ndarray, g: np.ndarray) -> None:
    """A step for the rows of ``weights`` named by ``bucket``: shorter the more tokens a bucket has seen."""
    order = np.argsort(bucket.astype(np.uint16), kind="stable")  # 16 bits are sorted by radix
    if len(seen) > 1 << 16:
        order = order.take(np.argsort((bucket >> 16).astype(np.uint16).take(order), kind="stable"))
    sorted_ = bucket.take(order)
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    n = np.diff(first, append=len(order))
    rows = sorted_.take(first)

    whole = weights.view(f"V{weights.itemsize * FAN}")[:, 0]  # a row as one value, which is set faster

    def step(rows, n, sums):
        met = seen.take(rows) + n
        seen[rows] = met
        sums *= (RATE / np.sqrt(n * met))[:, None]
        whole[rows] = np.subtract(weights.take(rows, axis=0), sums, out=sums).view(whole.dtype)[:, 0]

    once = n == 1
    step(rows[once], np.float32(1), g.take(order.take(first[once]), axis=0))
    more = ~once
    if more.any():
        # sums of runs as differences of running sums
        runs = n[more]
        last = np.cumsum(runs) - 1
        sums = np.cumsum(g.take(order[np.repeat(more, n)], axis=0), axis=0).take(last, axis=0)
        sums[1:] -= sums[:-1].copy()
        step(rows[more], runs.astype(np.float32), sums)


class Trainer:
    """A task's own copy of the weights."""

    def __init__(self, model: Model):
        self.model = model
        self.weights = model.weights.copy()
        self.seen = np.zeros(self.weights.shape[:2], np.float32)

    def learn(self, h: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        _, node, child, buckets = _steps(self.model, h, one, two)
        if not len(node):
            return
        g = _summed(self.model.bias.take(node, axis=0), self.weights, buckets)
        g /= _exp_sums(g)
        g.reshape(-1)[np.arange(0, g.size, FAN) + child] -= 1
        for k, b in enumerate(buckets):
            _descend(self.weights[k], self.seen[k], b, g)

    def changes(self):
        """(block, bytes, bytes): changes, in half precision, and tokens, for blocks of buckets that were met."""
        now, before, n = self.weights.reshape(-1, FAN), self.model.weights.reshape(-1, FAN), self.seen.reshape(-1)
        for k in range(0, len(n), _BLOCK):
            if n[k : k + _BLOCK].any():
                yield k // _BLOCK, (now[k : k + _BLOCK] - before[k : k + _BLOCK]).astype(np.float16).tobytes(), n[k : k + _BLOCK].tobytes()


def train(docs: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """Rounds of distributed gradient updates over ``docs`` (text and, if there are any, columns that tell equal texts apart).

    Rows are dealt to rounds and shards by hashes and read in the order of their hashes, so the weights do not depend on how
    the table is split.  The number of tasks follows from the tokens alone and is below the splits of a large table, so that
    what they send stays in proportion to the input.
    """
    tasks = max(LEAST_TASKS, math.ceil(math.sqrt(model.total) / TASK))
    deal = F.xxhash64(*docs.columns, F.lit(5))
    dealt = docs.select(F.col("text").cast("string").alias("text"), deal.alias("deal"))
    for k in range(rounds):
        none = np.zeros(0, np.int64)
        shared = docs.sparkSession.sparkContext.broadcast(replace(model, rest=none.view(np.uint64), rest_count=none))

        def run(batches, shared=shared):
            trainer = Trainer(shared.value)
            some = False
            for batch in batches:
                for i, j in textkit.slices(textkit.buffers(batch.column(0))[1]):
                    h, bounds = tokens(batch.column(0).slice(i, j - i))
                    one, two = contexts(h, bounds)
                    for a in range(0, len(h), BATCH):
                        trainer.learn(h[a : a + BATCH], one[a : a + BATCH], two[a : a + BATCH])
                        some = True
            if some:
                lane = TaskContext.get().partitionId() // LANE
                for block, raw, seen in trainer.changes():
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([lane], pa.int32()), pa.array([raw], pa.binary()), pa.array([seen], pa.binary())], names=["block", "lane", "raw", "seen"])

        def add(pdf):
            """The average change of the tokens behind it, and their number."""
            total, tokens_ = np.zeros((_BLOCK, FAN)), np.zeros((_BLOCK, 1))
            for raw, seen in zip(pdf["raw"], pdf["seen"], strict=True):
                n = np.frombuffer(seen, np.float32)[:, None]
                total += np.frombuffer(raw, np.float16).reshape(_BLOCK, FAN) * n.astype(float)
                tokens_ += n
            return pdf.iloc[:1][["block", "lane"]].assign(raw=[(total / np.maximum(tokens_, 1)).astype(np.float16).tobytes()], seen=[tokens_.astype(np.float32).tobytes()])

        part = dealt.where(F.pmod("deal", F.lit(rounds)) == k).repartition(4 * tasks, "deal").sortWithinPartitions("deal")
        fields = "block int, lane int, raw binary, seen binary"
        changes = part.select("text").coalesce(tasks).mapInArrow(run, fields).groupBy("block", "lane").applyInPandas(add, fields)
        if tasks > LANE:
            changes = changes.groupBy("block").applyInPandas(add, fields)
        found = changes.select("block", "raw").collect()
        table = model.weights.reshape(-1, FAN).copy()
        for r in found:
            table[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] += np.frombuffer(r["raw"], np.float16).reshape(_BLOCK, FAN).astype(np.float32)
        model = replace(model, weights=np.clip(table, -MOST_WEIGHT, MOST_WEIGHT).reshape(model.weights.shape))
        shared.unpersist()
    return model


def log_probabilities(model: Model, h: np.ndarray, one: np.ndarray, two: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Natural logarithms of the probabilities of paths: of tokens in the head, and of the groups of others."""
    at = _headed(model, h) if at is None else at
    out = np.empty(len(h))
    for a in range(0, len(h), BATCH):
        x, p, q = h[a : a + BATCH], one[a : a + BATCH], two[a : a + BATCH]
        owner, node, child, buckets = _steps(model, x, p, q, at[a : a + BATCH])
        z = _summed(model.bias.take(node, axis=0), model.weights, buckets)
        chosen = z.reshape(-1).take(np.arange(0, z.size, FAN) + child)
        out[a : a + BATCH] = np.bincount(owner, chosen - np.log(_exp_sums(z)[:, 0]), minlength=len(x))
    return out


def _headed(model: Model, h: np.ndarray) -> np.ndarray:
    """Index in the head, or -1: the few hashes with equal upper bits are tried in turn."""
    out = np.full(len(h), -1, np.int64)
    slot = (h >> np.uint64(64 - (len(model.index) - 1).bit_length() + 1)).astype(np.int64)
    at, end = model.index.take(slot), model.index.take(slot + 1)
    open_ = np.flatnonzero(at < end)
    while len(open_):
        place = at.take(open_)
        hit = model.head.take(place) == h.take(open_)
        out[open_[hit]] = place[hit]
        miss = ~hit
        open_, place = open_[miss], place[miss] + 1
        at[open_] = place
        open_ = open_[place < end.take(open_)]
    return out


def _facts(shared):
    """Per text: tokens, those whose counts are at hand, sums over these and the model's part, and the hashes of the others."""

    def run(batches):
        model = shared.value
        smooth, near, mass = np.log10(model.head_count + SMOOTH), np.log10(model.rest_count + SMOOTH), np.log10(model.group_mass)
        for batch in batches:
            for i, j in textkit.slices(textkit.buffers(batch.column(3))[1]):
                h, bounds = tokens(batch.column(3).slice(i, j - i))
                at = _headed(model, h)
                base = np.zeros(len(h))
                base[at >= 0] = smooth[at[at >= 0]]
                far = np.flatnonzero(at < 0)
                place = np.searchsorted(model.rest, h[far])
                met = place < len(model.rest)
                met[met] = model.rest[place[met]] == h[far[met]]
                base[far[met]] = near[place[met]]
                value = log_probabilities(model, h, *contexts(h, bounds), at) / np.log(10)
                value[far] += base[far] - mass[_groups(model, h[far])]
                first = bounds[:-1]
                known = np.ones(len(h), np.int64)
                known[far[~met]] = 0
                sums = [np.add.reduceat(x, first) for x in (known, base, value)]
                others = h[known == 0]
                edge = np.concatenate([[0], np.cumsum(np.diff(bounds) - sums[0])]).astype(np.int32)
                rare = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(edge * 8), pa.py_buffer(np.ascontiguousarray(others))])
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(i, j - i) for k in range(3)], pa.array(np.diff(bounds)), *[pa.array(s) for s in sums], rare], names=["id", "part", "held_out", "n_tokens", "n_head", "base", "value", "rare"])

    return run


def _tail(batches):
    """(id, part, rare) -> (id, part, h) of every token whose count is not at hand."""
    for batch in batches:
        data, offsets = textkit.buffers(batch.column(2))
        row = pa.array(np.repeat(np.arange(len(batch)), np.diff(offsets) // 8))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(np.frombuffer(data.tobytes(), np.int64))], names=["id", "part", "h"])


def score_texts(docs: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), F.hash(text).alias("part"), held_out.alias("held_out"), text.alias("text"))
    training = keyed.where(~F.col("held_out")).select("text", "id")
    vocabulary = spill(training.select("text").mapInArrow(_count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    model = train(training, new_model(vocabulary))
    trained = spark.sparkContext.broadcast(model)
    facts = spill(keyed.mapInArrow(_facts(trained), "id long, part int, held_out boolean, n_tokens long, n_head long, base double, value double, rare binary"))
    tail = facts.select("id", "part", "rare").where(F.length("rare") > 0).mapInArrow(_tail, "id long, part int, h long")
    count = F.coalesce("c", F.lit(0))
    rare = tail.join(vocabulary, "h", "left").groupBy("id", "part").agg(F.sum(F.log10(count + SMOOTH)).alias("rare"), F.sum((count > 0).cast("long")).alias("known"), F.count("*").alias("n"))
    facts = facts.drop("rare")
    # rows with the same id and text sent their tail once each: the sums are over all of them
    rare = rare.select(F.col("id").alias("_id"), F.col("part").alias("_part"), "rare", "known", "n")
    times = F.greatest(F.round(F.col("n") / F.greatest(F.col("n_tokens") - F.col("n_head"), F.lit(1))), F.lit(1))
    joined = facts.join(rare, F.col("id").eqNullSafe(F.col("_id")) & (F.col("part") == F.col("_part")), "left").withColumn("times", F.coalesce(times, F.lit(1)))
    more = F.coalesce(F.col("rare") / F.col("times"), F.lit(0.0))
    whole = float(np.log10(model.total + SMOOTH * (model.distinct + 1)))
    return joined.select(
        F.col("id").alias("doc_id"),
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce(F.round(F.col("known") / F.col("times")), F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("value") + more).alias("score"),
    )
