"""Near-duplicate documents by a grouped prefix join on word shingles.

A document is the set of its distinct shingles of ``width`` words; two documents link when
``100 * |A & B| >= percent * |A | B|``.  Shingles are ordered by (frequent, hash): frequent ones, counted over all
documents, come last.  Any order is right, this one keeps common passages out of the prefixes.  Linked sets share a
shingle within their first ``n - ceil(percent n / 100) + 1`` ones.

1. Equal sets are one set; sets with equal prefix and size form a group with its least id as leader.
2. The leaders' prefixes meet in lists by shingle, read in sorted order as a stream.  Short lists give all pairs that
   pass the size and position filters; a long list ties each entry to the pivot of like size that stands for most
   documents, and to its neighbour.  Pairs must also share as many prefix shingles as their sizes demand.
3. Each set is verified against its leader and those candidates, pivots and neighbours with which it shares most; links
   are contracted to components.
4. Pairs of groups that lie wholly in one component are dropped, list by list; only lists that hold more than one
   component are expanded to the members of their groups.  Such lists are cut into tiles of bounded size, and within a
   tile a pair of different components passes on if the size and position filters hold and the parity bitmaps of the
   two whole sets differ in no more bits than linked sets may differ in shingles.
5. What passes is verified and contracted.  At first each set brings its best partners only; as long as one has more,
   the step is repeated with the components so far, at last with all pairs.

Pairs within one component are never made, and pairs of components only if whole-set bitmaps cannot tell them apart.
Verification compares whole sets, remade from the texts of candidates only.  Equal hashes of 64 bits (48 between the two
sets of a pair) stand for equal shingles, two of 64 bits for equal sets.

Edge cases: null and wordless texts have no shingles and link with nothing; a text with fewer words than ``width`` is
one shingle; texts are used whole; rows that share an id are one node, which links as each of its texts does; null ids
link with nothing; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import textkit
from lectern.llm.components import components
from lectern.llm.runtime import arrow_batches, cut, extend, shuffle_width, spill, without

#: Lists of at most this many groups give all their pairs at once; longer ones take the way by pivots and components.
SHORT_LIST = 16
#: Of each kind of candidates, how many a set tries first; the others follow if they can still join components.
OFFERS = 2
#: Rounds of step 5 in which sets bring so many best partners of a tile only; the round after them brings all.
LIMITED_ROUNDS, PARTNERS = 1, 64
#: Entries of a list with several components that meet in one place: the square of it bounds the pairs looked at there.
TILE = 1024
#: Documents that one stream holds, about; shingles that they have together; and documents compared with them.
MOST_HEADS, MOST_HELD, MOST_PARTNERS = 1024, 1_000_000, 2048
#: Roles, some numbers a row, are broadcast up to this many rows; beyond it the sets are shuffled to them.
MOST_BROADCAST_ROLES = 150_000
#: A shingle is frequent from this count on, or from the least power of two that at most an eighth of the cells reach.
LEAST_FREQUENT = 16
FREQUENT_BITS = 22
#: Only shingles below this hash are counted: the lowest quarter, from which most prefixes come.
_LOW = np.uint64(1 << 62)
#: Bits of the parity bitmap of a set.
PARITY = 1024


def joined_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after the other, and each text's first index."""
    data, offsets = textkit.buffers(column)
    starts, ends, bounds = textkit.words(data, offsets)
    hashes, edge = textkit.shingles(textkit.word_hashes(data, starts, ends), bounds, width)
    for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        hashes[i:j].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[edge[:-1][np.diff(edge) > 0]] = True
    return hashes[new], np.concatenate([[0], np.cumsum(new)])[edge]


def document_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, edge = joined_sets(column, width)
    return [hashes[i:j] for i, j in zip(edge[:-1], edge[1:], strict=True)]


def _sums(x: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Sums of the runs between edges, modulo 2**64."""
    total = np.zeros(len(x) + 1, x.dtype)
    np.cumsum(x, out=total[1:])
    return total[edge[1:]] - total[edge[:-1]]


def _set_keys(x: np.ndarray, edge: np.ndarray) -> list[pa.Array]:
    """Two numbers of 64 bits for each set between edges."""
    return [pa.array(_sums(textkit.mix(y), edge).view(np.int64)) for y in (x, x ^ np.uint64(0xA5A5A5A55A5A5A5A))]


def _binaries(data: np.ndarray, edge: np.ndarray, size: int) -> pa.Array:
    """Rows of ``size`` bytes, in runs between edges, as a binary column."""
    return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer((edge * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def cell_bitmap(cells: DataFrame, bits: int) -> np.ndarray:
    """One bit for each ``cell`` below 2**bits that occurs: at most 2**(bits - 6) numbers reach the driver."""
    words = cells.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(cell & 63 as int)))").alias("set")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("set").to_numpy().view(np.uint64)
    return out


def _flagged(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bitmap[cells >> 6] >> (cells & 63).astype(np.uint64)) & np.uint64(1) != 0


def _local_counts(width: int, buckets: int):
    """(bucket, tokens, counts): distinct shingles of a task in the lowest quarter of hashes, 48 bits and a count of 16 bits
    each, in blocks by their upper bits."""
    shift = 62 - buckets.bit_length() + 1

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def blocks():
            token, count = _folded(held)
            count = np.minimum(count, 65535).astype("<u2")
            edge = np.searchsorted(token, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(shift))
            low = ((token & np.uint64((1 << shift) - 1)) << np.uint64(64 - shift)).astype("<u8")
            some = np.flatnonzero(np.diff(edge))
            parts = [(_upper(low[edge[k] : edge[k + 1]]).tobytes(), count[edge[k] : edge[k + 1]].tobytes()) for k in some]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([x[0] for x in parts], pa.binary()), pa.array([x[1] for x in parts], pa.binary())], names=["bucket", "tokens", "counts"])

        for batch in batches:
            for i, j in textkit.slices(textkit.buffers(batch.column(0))[1]):
                data, offsets = textkit.buffers(batch.column(0).slice(i, j - i))
                starts, ends, bounds = textkit.words(data, offsets)
                hashes, _ = textkit.shingles(textkit.word_hashes(data, starts, ends), bounds, width)
                held.append(np.unique(hashes[hashes < _LOW], return_counts=True))
                size += len(held[-1][0])
                if size > 4_000_000:
                    held[:] = [_folded(held)]
                    size = len(held[0][0])
                    if size > 2_000_000:
                        yield blocks()
                        size = 0
        if held:
            yield blocks()

    return run


def _folded(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    token, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
    return token, np.bincount(at, np.concatenate([x[1] for x in held]), minlength=len(token)).astype(np.int64)


def _frequent_cells(buckets: int):
    """Blocks sorted by bucket -> (cell, power): cells of frequent shingles, with the power of two that their counts reach."""
    bits = buckets.bit_length() - 1

    def run(batches):
        held, size, key = [], 0, None

        def cells():
            token, count = _folded(held)
            some = count >= LEAST_FREQUENT
            cell = (token[some] >> np.uint64(64 + bits - FREQUENT_BITS)).astype(np.int64) | (key << (FREQUENT_BITS - bits))
            return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.log2(count[some]).astype(np.int32))], names=["cell", "power"])

        for batch in batches:
            for k, tokens, counts in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if held and k != key:
                    yield cells()
                    held, size = [], 0
                key = k
                held.append((_unpacked(np.frombuffer(tokens, np.uint8)), np.frombuffer(counts, "<u2").astype(np.int64)))
                size += len(held[-1][0])
                if size > 8_000_000:
                    held = [_folded(held)]
                    size = len(held[0][0])
        if held:
            yield cells()

    return run


def frequent_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """The bitmap of frequent shingles of ``texts`` (text), by the upper bits of those in the lowest quarter.

    Every distinct shingle of a task crosses the shuffle in eight bytes and is added up where it lands, whatever the split.
    """
    tasks = shuffle_width(texts.sparkSession)
    buckets = 1 << min(FREQUENT_BITS - 1, (4 * tasks - 1).bit_length())
    blocks = texts.mapInArrow(_local_counts(width, buckets), "bucket int, tokens binary, counts binary")
    cells = blocks.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_frequent_cells(buckets), "cell long, power int")
    words = cells.groupBy(F.shiftright("cell", 6).alias("word"), "power").agg(F.expr("bit_or(shiftleft(1L, cast(cell & 63 as int)))").alias("set")).toArrow()
    word, power, part = (words.column(c).to_numpy() for c in ("word", "power", "set"))
    out = np.zeros(1 << (FREQUENT_BITS - 6), np.uint64)
    for p in np.unique(power)[::-1]:
        more = out.copy()
        more[word[power == p]] |= part[power == p].view(np.uint64)
        if out.any() and np.bitwise_count(more).sum() > (1 << FREQUENT_BITS) // 8:
            break
        out = more
    return out


def _parities(hashes: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A row of PARITY bits for each set between edges: whether a cell of its shingles holds an odd number of them.

    Two sets differ in at least as many shingles as their rows do in bits.
    """
    owner = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    cell = (hashes >> np.uint64(7)).astype(np.int64) & (PARITY - 1)
    return np.packbits((np.bincount(owner * PARITY + cell, minlength=(len(edge) - 1) * PARITY) & 1).astype(np.uint8).reshape(len(edge) - 1, PARITY), axis=1)


def prefix_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


def prefixes(hashes: np.ndarray, edge: np.ndarray, bitmap: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of each set, rare ones before frequent ones, and each set's first index."""
    n = np.diff(edge)
    p = np.where(n > 0, prefix_length(n, percent), 0)
    start = np.concatenate([[0], np.cumsum(p)])
    owner = np.repeat(np.arange(len(n)), n)
    common = hashes < _LOW
    common[common] = _flagged(bitmap, (hashes[common] >> np.uint64(62 - FREQUENT_BITS)).astype(np.int64))
    before = np.concatenate([[0], np.cumsum(common)])
    place = before[:-1] - before[edge[:-1]][owner]  # among the frequent ones of the set
    rare = np.arange(len(hashes)) - edge[:-1][owner] - place
    rares = n - (before[edge[1:]] - before[edge[:-1]])
    place = np.where(common, rares[owner] + place, rare)
    chosen = place < p[owner]
    out = np.empty(start[-1], np.uint64)
    out[start[:-1][owner[chosen]] + place[chosen]] = hashes[chosen]
    return out, start


def _prefix_kernel(width: int, percent: int, shared):
    def kernel():
        bitmap = shared.value

        def run(column):
            hashes, edge = joined_sets(column, width)
            head, start = prefixes(hashes, edge, bitmap, percent)
            rows = np.arange(len(edge))
            return [pa.array(np.diff(edge)), *_set_keys(hashes, edge), *_set_keys(head, start), _binaries(head, start, 8), _binaries(_parities(hashes, edge), rows, PARITY // 8)]

        return run

    return kernel


def _spread(batches):
    """(gid, n, many, light, prefix) -> a row for each shingle of the prefix."""
    for batch in batches:
        gid, n, many, light = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        data, offsets = textkit.buffers(batch.column(4))
        size = np.diff(offsets) // 8
        owner = np.repeat(np.arange(len(size)), size)
        pos = np.arange(len(owner)) - np.repeat(offsets[:-1] // 8, size)
        token = np.frombuffer(data.tobytes(), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(token), pa.array(gid[owner]), pa.array(n[owner].astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(many[owner]), pa.array(light[owner])],
            names=["token", "gid", "n", "pos", "many", "light"],
        )


def overlap_needed(nx, ny, percent: int):
    return -(-percent * (nx + ny) // (100 + percent))


def _passes(nx, px, ny, py, percent: int) -> np.ndarray:
    """Size and position filters for entries of one list."""
    most = np.minimum(px, py) + 1 + np.minimum(nx - px - 1, ny - py - 1)
    return (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)) & (most >= overlap_needed(nx, ny, percent))


def _meet(percent: int):
    """Sorted entries (token, gid, n, pos, many) -> pairs (kind 0), pivot pairs (kind 1), entries of long lists (kind 2) and of
    short lists with groups of several sets (kind 3), neighbours in long lists (kind 4).

    A list comes heaviest first and may span batches; of a long one only its pivots, which are as few as its sizes are
    unlike, and its last entry are held.
    """
    names = ["kind", "token", "a", "na", "pos", "b", "nb"]

    def rows(kind, token, a, na, pos, b, nb):
        k = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(k, kind, np.int32)), pa.array(token), pa.array(a), pa.array(na.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(b), pa.array(nb.astype(np.int32))], names=names
        )

    def pairs(kind, token, a, na, pos, b, nb):
        swap = a > b
        return rows(kind, token, np.where(swap, b, a), np.where(swap, nb, na), pos, np.where(swap, a, b), np.where(swap, na, nb))

    def alike(x, y):
        return 100 * np.minimum(x, y).astype(np.int64) >= percent * np.maximum(x, y).astype(np.int64)

    def run(batches):
        held = None  # entries of the list that the last batch ended in
        long_token, pivots, last = None, [], (0, 0)

        def tie(part, first):
            """Pivot and neighbour pairs of entries of a long list; ``first`` if the list begins here."""
            nonlocal last
            _, gid, n, pos, _m = part
            if first:
                pivots.clear()
            out = [rows(2, *[part[k] for k in (0, 1, 2, 3)], np.zeros(len(gid), np.int64), np.zeros(len(gid), np.int32))]
            loose, k = np.arange(len(gid)), 0
            while len(loose):
                if k == len(pivots):
                    pivots.append((gid[loose[0]], n[loose[0]]))
                good = alike(n[loose], pivots[k][1])
                at = loose[good & (gid[loose] != pivots[k][0])]
                if len(at):
                    z = len(at)
                    out.append(pairs(1, np.zeros(z, np.int64), np.full(z, pivots[k][0]), np.full(z, pivots[k][1]), np.zeros(z), gid[at], n[at]))
                loose, k = loose[~good], k + 1
            left, size = np.append(last[0], gid[:-1])[first:], np.append(last[1], n[:-1])[first:]
            good = (left != gid[first:]) & alike(size, n[first:])
            if good.any():
                out.append(pairs(4, np.zeros(good.sum(), np.int64), left[good], size[good], np.zeros(good.sum()), gid[first:][good], n[first:][good]))
            last = gid[-1], n[-1]
            return out

        def short(part):
            """Pairs and left-over entries of complete lists."""
            token, gid, n, pos, many = part
            edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            size = np.diff(np.concatenate([edge, [len(token)]]))
            whole = np.repeat(size, size)
            for i in edge[size > SHORT_LIST]:
                m = int(whole[i])
                yield from tie([x[i : i + m] for x in part], True)
            open_ = np.repeat(np.maximum.reduceat(many, edge), size).astype(bool) & (whole <= SHORT_LIST)
            if open_.any():
                z = int(open_.sum())
                yield rows(3, token[open_], gid[open_], n[open_], pos[open_], np.zeros(z, np.int64), np.zeros(z, np.int32))
            live = np.flatnonzero((whole > 1) & (whole <= SHORT_LIST))
            token, gid, pos = token[live], gid[live], pos[live].astype(np.int64)
            n = n[live].astype(np.int64)
            for d in range(1, SHORT_LIST):
                same = token[d:] == token[:-d]
                if not same.any():
                    break
                i = np.flatnonzero(same)
                i = i[_passes(n[i], pos[i], n[i + d], pos[i + d], percent) & (gid[i] != gid[i + d])]
                if len(i):
                    yield pairs(0, token[i], gid[i], n[i], pos[i], gid[i + d], n[i + d])

        for batch in batches:
            part = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            if not len(part[0]):
                continue
            if long_token is not None:
                m = int(np.searchsorted(part[0] != long_token, True)) if part[0][-1] != long_token else len(part[0])
                if m:
                    yield from tie([x[:m] for x in part], False)
                if m == len(part[0]):
                    continue
                part, long_token = [x[m:] for x in part], None
            if held is not None:
                part, held = [np.concatenate([h, x]) for h, x in zip(held, part, strict=True)], None
            cutoff = int(np.flatnonzero(part[0] == part[0][-1])[0])
            tail = [x[cutoff:] for x in part]
            if cutoff:
                yield from short([x[:cutoff] for x in part])
            if len(tail[0]) > SHORT_LIST:
                long_token = tail[0][-1]
                yield from tie(tail, True)
            else:
                held = tail
        if held is not None:
            yield from short(held)

    return run


def _tiles(percent: int, offers: int | None, seed: int):
    """Sorted (token, i, j, block, listed, leads, rep, n, pos, root, bits) -> (a, b, more): pairs of different components that pass.

    With ``offers``, pairs are left out that are not among so many best ones of either side; a row with ``more`` tells so.
    """

    def meet(i, j, block, listed, leads, rep, n, pos, root, bits):
        left, right = (np.arange(len(rep)),) * 2 if i == j else (np.flatnonzero(block == i), np.flatnonzero(block == j))
        found = []
        for k in range(0, len(left), 64):
            l, r = left[k : k + 64, None], right[None, :]
            # leaders in short lists are counted already; sets with that many shingles in common share one of their first
            needed = overlap_needed(n[l], n[r], percent)
            some = (root[l] != root[r]) & (rep[l] != rep[r]) & (listed[l] | ~(leads[l] & leads[r]))
            some &= (pos[l] <= n[l] - needed) & (pos[r] <= n[r] - needed) & _passes(n[l], pos[l], n[r], pos[r], percent)
            if i == j:
                some &= l < r
            x, y = np.nonzero(some)
            x, y = left[k + x], right[y]
            far = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64)
            good = far <= n[x] + n[y] - 2 * overlap_needed(n[x], n[y], percent)
            found.append((x[good], y[good], far[good]))
        x, y, far = (np.concatenate([f[k] for f in found]) for k in range(3)) if found else (np.zeros(0, np.int64),) * 3
        a, b = np.minimum(rep[x], rep[y]), np.maximum(rep[x], rep[y])
        if offers is not None and len(a):
            if seed:
                far = (textkit.mix(a.astype(np.uint64) * np.uint64(31) + b.astype(np.uint64) + np.uint64(seed << 40)) >> np.uint64(2)).astype(np.int64)
            keep = np.zeros(len(a), bool)
            for side in (x, y):
                order = np.lexsort((far, side))
                first = np.flatnonzero(np.append(True, np.diff(side[order]) != 0))
                place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
                keep[order[place < offers]] = True
            return a[keep], b[keep], not keep.all()
        return a, b, False

    def run(batches):
        key, held = None, []

        def flush():
            a, b, more = meet(*key[1:], *(np.concatenate([h[k] for h in held]) for k in range(8)))
            if more:
                a, b = np.append(a, 0), np.append(b, 0)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array((np.arange(len(a)) == len(a) - 1) & more)], names=["a", "b", "more"])

        for batch in batches:
            token, i, j, *rest = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(10))
            rest = [x.astype(bool) if k in (1, 2) else x.astype(np.int64) for k, x in enumerate(rest)]
            bits = textkit.buffers(batch.column(10))[0].view(np.uint64).reshape(-1, PARITY // 64)
            edge = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])) if len(token) else []
            for s, e in zip(edge, [*edge[1:], len(token)], strict=True):
                mine = (token[s], i[s], j[s])
                if held and mine != key:
                    yield flush()
                    held = []
                key = mine
                held.append([x[s:e] for x in rest] + [bits[s:e]])
        if held:
            yield flush()

    return run


def _upper(x: np.ndarray) -> np.ndarray:
    """The upper 48 bits of hashes."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:])


def _unpacked(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = raw.reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _compared(percent: int):
    """Sorted (near, sa, sb, role, id, partners, set): sets of a (role 0) come before those to compare with them."""

    def run(batches):
        key, heads = None, {}
        for batch in batches:
            near, sa, sb, role, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            partners = batch.column(5).to_pylist()
            data, at = textkit.buffers(batch.column(6))
            a, b, good = [], [], []
            for i in range(len(ids)):
                if key != (near[i], sa[i], sb[i]):
                    key, heads = (near[i], sa[i], sb[i]), {}
                x = _unpacked(data[at[i] : at[i + 1]])
                if role[i] == 0:
                    heads.setdefault(ids[i], []).append(x)
                    continue
                for other in partners[i]:
                    for y in heads.get(other, ()):
                        both = np.concatenate([x, y])
                        both.sort()
                        same = int((both[1:] == both[:-1]).sum())
                        a.append(other)
                        b.append(ids[i])
                        good.append(100 * same >= percent * (len(x) + len(y) - same) and same > 0)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(good, pa.bool_())], names=["a", "b", "good"])

    return run


def _roles(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, near, sa, sb, role, partners): where the set of each document of ``pairs`` is needed.

    Documents a whose partners overlap meet in one stream, a few at a time, so that a document travels once for many of
    its pairs; ``near``, the least id within two steps, tells them.  Much met documents have several streams.
    """
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    one = both.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("m")).select("x", F.least("x", "m").alias("m"))
    two = pairs.join(one, F.col("b") == F.col("x")).groupBy("a").agg(F.min("m").alias("near"))
    heads = pairs.select("a").distinct().join(two, "a").join(sizes.select(F.col("id").alias("a"), "n"), "a")
    load = heads.groupBy("near").agg(F.greatest(F.ceil(F.count("*") / MOST_HEADS), F.ceil(F.sum("n") / MOST_HELD)).alias("parts"))
    heads = cut(heads.join(load, "near").select("a", "near", F.pmod(F.xxhash64("a"), F.col("parts")).alias("sa")))
    visits = pairs.join(heads, "a").groupBy("near", "sa", "b").agg(F.collect_list("a").alias("partners"))
    streams = visits.groupBy("near", "sa").agg(F.ceil(F.count("*") / MOST_PARTNERS).alias("parts"))
    met = visits.join(streams, ["near", "sa"]).select(F.col("b").alias("id"), "near", "sa", F.pmod(F.xxhash64("b"), F.col("parts")).alias("sb"), F.lit(1).alias("role"), "partners")
    every = heads.join(streams, ["near", "sa"]).select(F.col("a").alias("id"), "near", "sa", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("sb"), F.lit(0).alias("role"), F.array().cast("array<long>").alias("partners"))
    return cut(met.unionByName(every))


def verify(pairs: DataFrame, docs: DataFrame, sizes: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b, good) for the distinct ``pairs``: whether their whole sets link; ``sizes`` has (id, n).

    Sets are made for the documents in pairs only: told by a broadcast of their ids, or by one bit for the hash of an id if
    there are many.
    """
    spark = pairs.sparkSession
    roles = _roles(pairs, sizes)
    n = roles.count()
    few = n <= MOST_BROADCAST_ROLES
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    shared = None
    if few:
        texts = texts.join(F.broadcast(roles.select("id").distinct()), "id", "left_semi")
    else:
        size = min(26, max(16, (32 * n).bit_length()))
        cell = F.shiftrightunsigned(F.xxhash64("id"), 64 - size)
        texts = texts.withColumn("cell", cell)
        shared = spark.sparkContext.broadcast(cell_bitmap(roles.select(cell.alias("cell")), size))

    def sets(batches):
        for batch in batches:
            if shared is not None:
                batch = batch.take(pa.array(np.flatnonzero(_flagged(shared.value, batch.column(2).to_numpy()))))
            for i, j in textkit.slices(textkit.buffers(batch.column(1))[1]):
                hashes, edge = joined_sets(batch.column(1).slice(i, j - i), width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _binaries(_upper(hashes), edge, 6)], names=["id", "set"])

    made = texts.mapInArrow(sets, "id long, set binary")
    order = ["near", "sa", "sb", "role", "id"]
    placed = made.join(F.broadcast(roles) if few else roles.hint("shuffle_hash"), "id").select(*order, "partners", "set")
    streams = placed.repartition(shuffle_width(spark), *order[:3]).sortWithinPartitions(*order)
    found = cut(streams.mapInArrow(_compared(percent), "a long, b long, good boolean"))
    if shared is not None:
        shared.unpersist()
    return found


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n_shingles and component_id, the least id that links reach."""
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = without(docs, ["n_shingles", "component_id"])
    shared = spark.sparkContext.broadcast(frequent_shingles(docs.select(F.col("text").cast("string").alias("text")), width))
    fields = "n long, sa long, sb long, ga long, gb long, prefix binary, bits binary"
    marked = spill(extend(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _prefix_kernel(width, percent, shared), fields, ["doc_id"]))
    shared.unpersist()
    usable = marked.where((F.col("n") > 0) & F.col("doc_id").isNotNull())

    same = ["n", "ga", "gb"]
    reps = cut(usable.groupBy("sa", "sb").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in same]))
    groups = cut(reps.groupBy(*same).agg(F.min("rep").alias("gid"), F.count("*").alias("members"), F.sum("copies").alias("copies")))
    leaders = usable.join(groups.withColumnRenamed("gid", "doc_id"), ["doc_id", *same]).dropDuplicates(["doc_id", *same])
    light = -F.least("copies", F.lit(1 << 30)).cast("int")
    entries = leaders.select(F.col("doc_id").alias("gid"), "n", (F.col("members") > 1).cast("int").alias("many"), light.alias("light"), "prefix").mapInArrow(_spread, "token long, gid long, n int, pos int, many int, light int")
    lists = entries.repartition(shuffle_width(spark), "token").sortWithinPartitions("token", "light", "n", "gid").drop("light")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
    met = spill(lists.mapInArrow(_meet(percent), "kind int, token long, a long, na int, pos int, b long, nb int"))
    arrow_batches(spark)

    left_over = met.where("kind in (2, 3)").select("kind", "token", F.col("a").alias("gid"), F.col("na").alias("n"), "pos")
    unseen = left_over.where("kind = 2").groupBy("gid").agg(F.count("*").alias("more"))
    counted = met.where("kind = 0").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("common"))
    # the prefixes are longer than sets of these sizes need, so linked sets share more than one shingle of them
    alpha = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent))
    least = F.least(*[alpha - F.ceil(F.lit(percent) * F.col(c) / 100) + 1 for c in ("na", "nb")])
    more = F.least(*[F.coalesce(F.col(c), F.lit(0)) for c in ("more_a", "more_b")])
    likely = cut(
        counted.join(unseen.select(F.col("gid").alias("a"), F.col("more").alias("more_a")), "a", "left")
        .join(unseen.select(F.col("gid").alias("b"), F.col("more").alias("more_b")), "b", "left")
        .where((F.col("common") + more >= least) & (F.col("a") != F.col("b")))
        .select("a", "b", "common")
    )
    pivots = met.where("kind in (1, 4)").groupBy("kind", "a", "b").agg(F.count("*").alias("common"))
    members = cut(reps.join(groups.where("members > 1").select("gid", *same), same).where(F.col("rep") != F.col("gid")).select("gid", "rep", "n"))
    led = members.select(F.col("gid").alias("a"), F.col("rep").alias("b"), (F.col("n") + 1).cast("long").alias("common"))
    offers = likely.withColumn("kind", F.lit(0)).unionByName(pivots).unionByName(led.withColumn("kind", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("b", "kind").orderBy(F.col("common").desc(), "a"))
    tries = cut(offers.withColumn("place", place).where(F.col("place") <= OFFERS).select("a", "b").distinct())
    sizes = reps.groupBy(F.col("rep").alias("id")).agg(F.sum("n").alias("n"))
    bits = marked.select(F.col("doc_id").alias("rep"), "n", "bits")

    def rooted(rows: DataFrame, column: str, root: str) -> DataFrame:
        table = roots.select(F.col("node").alias(column), F.col("root").alias(root))
        return rows.join(table, column, "left").withColumn(root, F.coalesce(root, column))

    def apart(rows: DataFrame) -> DataFrame:
        return rooted(rooted(rows, "a", "ra"), "b", "rb").where(F.col("ra") != F.col("rb")).select("a", "b")

    def passing(limit: int | None, seed: int) -> DataFrame:
        """(a, b, more): pairs of sets of different components that meet in lists of groups."""
        spans = rooted(members, "rep", "root").groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
        wide = rooted(left_over, "gid", "root").join(spans, "gid", "left")
        mixed = wide.groupBy("token").agg(F.min(F.least("root", "lo")).alias("lo"), F.max(F.greatest("root", "hi")).alias("hi")).where("lo <> hi").select("token")
        inside = cut(wide.join(mixed, "token").select("token", (F.col("kind") == 2).alias("listed"), "gid", "n", "pos", "root"))
        led_ = rooted(inside.select("token", "listed", "gid", "n", "pos").join(members.select("gid", "rep"), "gid"), "rep", "root")
        columns = ["token", "listed", "leads", "rep", "n", "pos", "root"]
        every = inside.withColumn("rep", F.col("gid")).withColumn("leads", F.lit(True)).select(*columns).unionByName(led_.withColumn("leads", F.lit(False)).select(*columns))
        parts = every.groupBy("token").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
        needed = bits.join(every.select("rep", "n").distinct(), ["rep", "n"], "left_semi").dropDuplicates(["rep", "n", "bits"])
        block = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
        tiled = every.join(needed, ["rep", "n"]).join(parts, "token").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        tiled = tiled.select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "listed", "leads", "rep", F.col("n").cast("long"), F.col("pos").cast("long"), "root", "bits")
        return cut(tiled.repartition(shuffle_width(spark), "token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(_tiles(percent, limit, seed), "a long, b long, more boolean"))

    checked = verify(tries, docs, sizes, width, percent)
    roots = components(checked.where("good").select("a", "b"))
    for k in range(LIMITED_ROUNDS + 1):
        passed = passing(PARTNERS if k < LIMITED_ROUNDS else None, k)
        # members of one group share their whole prefix, and pivots may not: what is known but not yet linked comes along
        known = [likely.select("a", "b"), led.select("a", "b")]
        open_ = passed.where(~F.col("more")).select("a", "b").distinct().unionByName(apart(known[0])).unionByName(apart(known[1])).distinct()
        tries = cut(open_.join(checked.select("a", "b"), ["a", "b"], "left_anti"))
        if not tries.isEmpty():
            checked = checked.unionByName(verify(tries, docs, sizes, width, percent))
            roots = components(checked.where("good").select("a", "b"))
        if passed.where("more").isEmpty():
            break

    named = reps.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("sa", "sb", F.coalesce("root", "rep").alias("_near_root"))
    facts = marked.select("doc_id", "n", "sa", "sb").join(named, ["sa", "sb"], "left")
    return facts.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("_near_root")).otherwise(F.col("doc_id")).alias("component_id"))


def add_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """All columns of ``docs`` with n_shingles and component_id; of rows that share an id one fact is used for all."""
    docs = without(docs, ["n_shingles", "component_id"])
    facts = near_duplicates(docs, width, percent).groupBy(F.col("doc_id").alias("_near_id")).agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    return docs.join(facts, docs["doc_id"].cast("long").eqNullSafe(F.col("_near_id")), "left").drop("_near_id")
