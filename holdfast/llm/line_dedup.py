"""Line deduplication by an exact set-similarity join.

A line's set holds its lower-cased (A-Z) words. Lines with the same words in the same order are one class, found by a
128-bit cryptographic digest; its earliest line stands for it. Words are ordered by rarity: by an upper bound of their
count in all texts (two rows of fixed counters, the lesser counts), then by hash; any common total order keeps the join
exact. Classes meet in buckets, one for each of the rarest words of their sets (prefix filter: a larger set's prefix
meets the shorter one of a smaller set), if their sizes (length filter) and the places of the meeting word (positional
filter) allow the similarity; 128 parity bits of each set then bound how many words two sets can share.

A line goes if an equal or similar line stands earlier, by (doc_id, line number), so a class is settled at its first
verified earlier match: a bucket names for each class an earlier class whose parity bits leave little doubt, or else a
few that the filters let through; they are verified on the words of both lines. Classes whose candidates
all fail ask their buckets for all others, nearest first, more of them each time, until they are settled or no bucket
holds another. So a group of n similar classes makes n candidates, not n * n, and no line that must go is left out. A bucket has BLOCK classes at most; buckets of commoner words are cut
into blocks, each of which meets each other once.

Where the links are asked for, all pairs of a bucket that the filters let through are verified instead. A pair counts in
the bucket of the first word that its sets share, so in one only. A bucket with DENSE pairs a class at most gives these as
rows. The classes of a fuller one are met with their texts again, in tiles of bounded size, where their pairs are verified
and counted: a tile gives one row a class, so rows stay in proportion to the postings. The comparisons of n near copies
that all differ are n * n / 2 all the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, Words, as_bytes, broadcast_if_small, chunks, slices
from .minhash import word_set

COUNTERS = 1 << 18  #: of each of the two rows
PARTS = 256  #: pieces that the counters are added up in
STEPS = 8  #: ranks for each doubling of a count
BLOCK = 4096  #: classes of a bucket that are compared in one task
SLICE = 1 << 22  #: bytes of texts whose equal lines are one row of prefixes
MORE = 16  #: how many more candidates a class may ask for from one round to the next
BROADCAST_LINES = 1_000_000  #: lines (40 bytes each) to be looked up in their texts that may be broadcast
BROADCAST_KEYS = 1_000_000

#: Options of tables of digests and word hashes, of which Parquet's dictionaries would only be given up page by page.
PLAIN = {"parquet.enable.dictionary": "false"}
SURE = 10  #: differing words up to which parity bits are taken at their word

_U = np.uint64


def _slots(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (words & _U(COUNTERS - 1)).astype(np.int64), ((words >> _U(20)) & _U(COUNTERS - 1)).astype(np.int64)


def word_ranks(docs: DataFrame) -> np.ndarray:
    """Two rows of ranks (logarithms of how many words of all texts fall to a counter); PARTS rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, COUNTERS), np.int64)
        for batch in batches:
            texts = as_bytes(batch.column(0).to_pylist())
            for part in chunks(texts):
                for row, slots in zip(total, _slots(Words(texts[part]).hashes), strict=True):
                    row += np.bincount(slots, minlength=COUNTERS)
        pieces = total.reshape(PARTS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS, dtype=np.int32)), pa.array([p.tobytes() for p in pieces], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(counts, np.int64)
                sums[part] = sums[part] + own if part in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["part", "counts"])

    schema = "part int, counts binary"
    rows = docs.select("text").mapInArrow(count, schema).repartition("part").mapInArrow(add, schema).collect()
    total = np.zeros((PARTS, 2 * COUNTERS // PARTS), np.int64)
    for r in rows:
        total[r["part"]] = np.frombuffer(r["counts"], np.int64)
    return np.minimum(255, np.floor(STEPS * np.log2(1 + total.reshape(2, COUNTERS)))).astype(np.uint8)


def _ordered(found: Words, lines: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in found of the distinct words of each line, rarest first, and the ranks of all words."""
    words, owner = found.hashes, found.owner
    one, two = _slots(words)
    rank = np.minimum(ranks[0][one], ranks[1][two])
    order = np.argsort((rank.astype(_U) << _U(56)) | (words & _U((1 << 56) - 1)))
    small = np.uint16 if lines <= 1 << 16 else np.int64
    order = order[np.argsort(owner[order].astype(small), kind="stable")]
    words, owner = words[order], owner[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])
    return order[new], rank


def line_sets(found: Words, lines: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word hashes of each line, rarest first, the index of their line, and their rank."""
    at, rank = _ordered(found, lines, ranks)
    return found.hashes[at], found.owner[at], rank[at]


def parities(words: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """128 bits for each set, each word turning one: in two sets' bits no more differ than words do. n: the sets' sizes."""
    bit, full = (words >> _U(32)) & _U(127), n > 0
    out = []
    for half in (0, 1):
        own = np.where(bit >> _U(6) == half, _U(1) << (bit & _U(63)), _U(0))
        mask = np.zeros(len(n), _U)
        if full.any():
            mask[full] = np.bitwise_xor.reduceat(own, (np.cumsum(n) - n)[full])
        out.append(mask.view(np.int64))
    return out


LINES = "doc_id long, line int, n int, f1 long, f2 long, m1 long, m2 long, copies int, prefix array<long>, common int"


def _lines(ranks: np.ndarray, percent: int):
    """Rows of LINES; copies: how many lines of the slice are equal to this one, its first, and 0 for the others of them, which
    have no prefix; common: how many words at the end of the prefix may occur more than BLOCK times."""
    names = [x.split()[0] for x in LINES.split(", ")]
    rare = np.exp2((np.arange(256) + 1) / STEPS) - 1 <= BLOCK
    rare[255] = False

    def described(ids: np.ndarray, texts: list[bytes]) -> Iterator[tuple]:
        for part in chunks(texts):
            split = [t.split(b"\n") for t in texts[part]]
            per = np.array([len(s) for s in split])
            lines = [line for s in split for line in s]
            found = Words(lines)
            words, owner, rank = line_sets(found, len(lines), ranks)
            n = np.bincount(owner, minlength=len(lines))
            ends = np.cumsum(n)
            place = np.arange(len(words)) - np.repeat(ends - n, n)
            length = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
            in_prefix = place < length[owner]
            common = np.bincount(owner[in_prefix & ~rare[rank]], minlength=len(lines)).astype(np.int32)
            number = np.arange(len(lines)) - np.repeat(np.cumsum(per) - per, per)
            f = found.digests(len(lines))
            yield np.repeat(ids[part], per), number.astype(np.int32), n.astype(np.int32), f[:, 0], f[:, 1], *parities(words, n), common, length, words[in_prefix].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in slices(batch, batch.column(1), limit=SLICE):
                held = described(own.column(0).to_numpy(), as_bytes(own.column(1).to_pylist()))
                ids, number, n, f1, f2, m1, m2, common, length, words = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.lexsort((number, ids, f2, f1))
                new = np.ones(len(order), bool)
                new[1:] = (np.diff(f1[order]) != 0) | (np.diff(f2[order]) != 0)
                copies = np.zeros(len(order), np.int32)
                copies[order[new]] = np.diff(np.append(np.flatnonzero(new), len(order)))
                first = copies > 0
                words, length = words[np.repeat(first, length)], np.where(first, length, 0)
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32)), pa.array(words))
                yield pa.RecordBatch.from_arrays([*map(pa.array, (ids, number, n, f1, f2, m1, m2, copies)), prefix, pa.array(common)], names=names)

    return run


# --- candidates ---------------------------------------------------------------------------------

NEAR = "seq long, f1 long, a_seq long, a_f1 long"
PAIRS = 500_000  #: of a batch of all pairs, about
DENSE = 4  #: pairs a class from which on a bucket's classes are compared in tiles
TILE = 1 << 18  #: words of the lines of half a tile, about
FEW = 4  #: candidates in doubt that a bucket names at first


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(_U))  # of signed numbers it would count the absolute value's


def _runs(key, group) -> np.ndarray:
    """Where the bucket of each row begins."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
    return np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))


def _short(n, at, percent: int) -> np.ndarray:
    """Rows in the shorter prefix, by which the smaller set of a pair is found."""
    return at < n - -(-2 * percent * n // (100 + percent)) + 1


def likely(key, group, side, seq, n, at, m1, m2, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by (key, group, n), whole buckets: places (b, a), a an earlier row that the filters let through; for each
    b one a whose parity bits leave little doubt, or else FEW about. Also whether such an a, and whether b has more.

    All rows are held at once against the s-th row of the shorter prefix before them, whose set is no larger, until it is
    too small for them; either of the two may be the earlier one.
    """
    total = len(key)
    short = np.flatnonzero(_short(n, at, percent))
    before = np.searchsorted(short, np.arange(total))  # rows of the shorter prefix before each row
    begin = before[_runs(key, group)]
    rest, count, settled, full = n - at, np.zeros(total, np.int64), np.zeros(total, bool), np.zeros(total, bool)
    out = []
    left, s = np.flatnonzero(before > begin), 1
    while len(left):
        other = short[before[left] - s]
        near = 100 * n[other] >= percent * n[left]
        left, other = left[near], other[near]
        both = n[left] + n[other]
        need = -(-both * percent // (100 + percent))
        keep = np.flatnonzero((np.minimum(rest[left], rest[other]) >= need) & (seq[left] != seq[other]) & ((side[left] != side[other]) | (side[left] < 0)))
        j, i, room = left[keep], other[keep], (both - 2 * need)[keep]
        differ = _bits(m1[i] ^ m1[j]).astype(np.int64) + _bits(m2[i] ^ m2[j])
        close = np.flatnonzero(differ <= room)
        if len(close):
            j, i, differ, room = j[close], i[close], differ[close], room[close]
            later = seq[j] > seq[i]
            b, a, sure = np.where(later, j, i), np.where(later, i, j), (room <= SURE) | (3 * differ <= 2 * room)
            full[b[count[b] >= FEW]] = True
            add = ~settled[b] & (sure | (count[b] < FEW))
            b, a, sure = b[add], a[add], sure[add]
            np.add.at(count, b, 1)
            settled[b[sure]] = True
            out.append((b, a, sure))
        s += 1
        left = left[before[left] - s >= begin[left]]
    b, a, sure = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool))
    alone = sure | ~settled[b]
    return b[alone], a[alone], sure[alone], full[b[alone]]


def nearest(key, group, side, seq, f1, n, at, m1, m2, until, until_f1, most: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by (key, group, seq, f1), whole buckets: places (b, a) of up to ``most`` nearest earlier rows a for each b.

    until, until_f1: b takes only rows a with (seq, f1) below them (-1: b asks for none). All rows are held against the
    row s places before them at once; once few are left, each of those against all rows before it.
    """
    total, first, short = len(key), _runs(key, group), _short(n, at, percent)
    crossing = side >= 0
    found = np.zeros(total, np.int64)
    out = []

    def fits(b, a):
        na, nb = n[a], n[b]
        low = np.minimum(na, nb)
        ok = (100 * low >= percent * np.maximum(na, nb)) & np.where(na < nb, short[a], np.where(nb < na, short[b], short[a] & short[b]))
        ok &= ((seq[a] < until[b]) | ((seq[a] == until[b]) & (f1[a] < until_f1[b]))) & (seq[a] < seq[b]) & ((side[a] != side[b]) | ~crossing[b])
        keep = np.flatnonzero(ok)
        b, a = b[keep], a[keep]
        both = n[a] + n[b]
        need = -(-both * percent // (100 + percent))
        room = both - 2 * need
        differ = _bits(m1[a] ^ m1[b]).astype(np.int64) + _bits(m2[a] ^ m2[b])
        close = (np.minimum(n[a] - at[a], n[b] - at[b]) >= need) & (differ <= room)
        return b[close], a[close]

    left, s = np.flatnonzero((until >= 0) & (first < np.arange(total))), 1
    while len(left) > 512:
        b, a = fits(left, left - s)
        out.append((b, a))
        found[b] += 1
        s += 1
        left = left[(found[left] < most) & (left - s >= first[left])]
    for b in left:
        before = np.arange(b - s, first[b] - 1, -1)
        _, a = fits(np.full(len(before), b), before)
        a = a[: most - found[b]]
        out.append((np.full(len(a), b), a))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Postings of which those of a bucket follow one another, in tables of whole buckets."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < 200_000:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        other = np.zeros(t.num_rows, bool)
        for name in ["bucket"] if "bucket" in t.column_names else {"key", "group"} & set(t.column_names):
            own = t.column(name).to_numpy()
            other |= own != own[-1]
        last = np.flatnonzero(other)
        cut = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on in the next batch
        if cut:
            yield t.slice(0, cut)
        held, rows = t.slice(cut).to_batches(), t.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def _near(most: int | None, percent: int):
    """Sorted postings -> rows of NEAR, key, sure, and where the bucket may hold more for the class, the farthest one of
    those named. most: how many of the nearest; None: those that are likely."""

    def found(t: pa.Table) -> pa.RecordBatch:
        given = {name: c.to_numpy() for name, c in zip(t.column_names, t.columns, strict=True)}
        key, seq, f1, size, m1, m2 = (given[c] for c in POSTED)
        same = lambda name, value: given.get(name, np.broadcast_to(np.int64(value), len(key)))
        group, side, until, until_f1 = same("group", 0), same("side", -1), same("until", (1 << 63) - 1), same("until_f1", 0)
        n, at = size >> 32, size & 0xFFFFFFFF
        if most is None:
            b, a, sure, full = likely(key, group, side, seq, n, at, m1, m2, percent)
        else:
            b, a = nearest(key, group, side, seq, f1, n, at, m1, m2, until, until_f1, most, percent)
            sure, full = np.zeros(len(b), bool), np.bincount(b, minlength=len(key))[b] >= most
        far = np.full(len(key), len(key))
        np.minimum.at(far, b, a)
        done = ~full
        columns = [*(pa.array(x) for x in (seq[b], f1[b], seq[a], f1[a], key[b], sure)), pa.array(seq[far[b]], mask=done), pa.array(f1[far[b]], mask=done)]
        return pa.RecordBatch.from_arrays(columns, names=["seq", "f1", "a_seq", "a_f1", "key", "sure", "far_seq", "far_f1"])

    return lambda batches: map(found, _buckets(batches))


POSTED = ["key", "seq", "f1", "size", "m1", "m2"]


def postings(scratch: Scratch, classes: DataFrame, name: str) -> DataFrame:
    """A row for each class and word of its prefix: POSTED and, if a bucket is cut, group and side: the block pair, and the
    row's place in the pair (-1: all rows of the group meet)."""
    each = classes.select("seq", "f1", "m1", "m2", "n", (F.size("prefix") - F.col("common")).alias("rare"), F.posexplode("prefix").alias("at", "key"))
    size = F.shiftleft(F.col("n").cast("long"), 32) + F.col("at")
    plain = each.select("key", "seq", "f1", size.alias("size"), "m1", "m2", (F.col("at") >= F.col("rare")).alias("common"))
    full = plain.filter("common").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
    full = scratch.save(full.select("key", F.ceil(F.col("n") / (BLOCK // 2)).cast("int").alias("blocks")), f"full-{name}")
    if full.isEmpty():
        return plain.select(*POSTED)
    cut = plain.join(broadcast_if_small(full, BROADCAST_KEYS), "key")
    cut = cut.withColumn("own", F.pmod(F.xxhash64("f1"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other") + 1
    side = F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int"))
    whole = plain.join(broadcast_if_small(full, BROADCAST_KEYS), "key", "left_anti")
    whole = whole.select(*POSTED, F.lit(0).alias("group"), F.lit(-1).alias("side"))
    return whole.unionByName(cut.select(*POSTED, pair.cast("int").alias("group"), side.cast("int").alias("side")))


def candidates(posted: DataFrame, most: int | None, percent: int) -> DataFrame:
    """Rows of NEAR, key, sure, far_seq and far_f1. posted: what postings gives, and until and until_f1 unless every class
    asks for all."""
    bucket = ["key", *(["group"] if "group" in posted.columns else [])]
    ordered = posted.repartition(*bucket).sortWithinPartitions(*bucket, *(["size"] if most is None else ["seq", "f1"]))
    return ordered.mapInArrow(_near(most, percent), f"{NEAR}, key long, sure boolean, far_seq long, far_f1 long")


def meeting(key, group, side, n, at, m1, m2, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows sorted by (key, group, n), whole buckets: places of all pairs that the filters let through, PAIRS or more at once.

    The first word that two sets share is one of both prefixes, and what stands before it in either set differs; so a pair
    at the similarity passes in that word's bucket, if not in all where it meets.
    """
    total = len(key)
    short = np.flatnonzero(_short(n, at, percent))
    before = np.searchsorted(short, np.arange(total))
    begin = before[_runs(key, group)]
    out, held = [], 0
    left, s = np.flatnonzero(before > begin), 1
    while len(left):
        other = short[before[left] - s]
        near = 100 * n[other] >= percent * n[left]
        left, other = left[near], other[near]
        both = n[left] + n[other]
        need = -(-both * percent // (100 + percent))
        room = both - 2 * need
        fits = (np.minimum(n[left] - at[left], n[other] - at[other]) >= need) & (at[left] + at[other] <= room)
        keep = np.flatnonzero(fits & ((side[left] != side[other]) | (side[left] < 0)))
        j, i = left[keep], other[keep]
        close = _bits(m1[i] ^ m1[j]).astype(np.int64) + _bits(m2[i] ^ m2[j]) <= room[keep]
        out.append((j[close], i[close]))
        held += len(out[-1][0])
        if held >= PAIRS:
            yield tuple(np.concatenate(x) for x in zip(*out, strict=True))
            out, held = [], 0
        s += 1
        left = left[before[left] - s >= begin[left]]
    if held:
        yield tuple(np.concatenate(x) for x in zip(*out, strict=True))


MET = "seq long, f1 long, a_seq long, a_f1 long, at int, key long, group long, tile long, half int"


def tiles(n: np.ndarray, percent: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """n: sizes of the classes of a dense bucket, ascending. Pairs of halves (numbers, rows) whose sizes allow the similarity;
    a half has TILE words about, and each of two classes is in a half that meets the other's."""
    half = np.cumsum(n) // TILE
    names, first = np.unique(half, return_index=True)
    last = np.append(first[1:], len(n))
    for x in range(len(names)):
        for y in range(x, len(names)):
            if 100 * n[last[x] - 1] >= percent * n[first[y]]:
                yield x, y, np.arange(first[x], last[x]), np.arange(first[y], last[y])


def by_size(given: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Columns of postings, sorted by (key, group, n), without buckets of a single one. Spark sorts by one column of
    numbers, which takes a fraction of the time that it takes for several."""
    key, group = given["key"], given.get("group")
    if group is not None:
        order = np.lexsort((given["size"], group, key))
        run = _runs(key[order], group[order])
    else:
        run = _runs(key, np.broadcast_to(np.int64(0), len(key)))
        order = np.argsort((run << 32) | (given["size"] >> 32))
    held = np.bincount(run, minlength=len(run))[run] > 1
    return {name: column[order[held]] for name, column in given.items()}


def _meeting(percent: int):
    """Postings, those of a bucket one after another -> rows of MET: pairs, (a_seq, a_f1) the earlier class and at the word's place in the later one's set;
    or, without a_seq, classes of dense buckets that have a pair there, for each tile that they meet others in.

    half: -1 if all classes of the tile meet, else 0 and 1 meet.
    """
    names = [x.split()[0] for x in MET.split(", ")]

    def rows(n, **given) -> pa.RecordBatch:
        kinds = [pa.int32() if c in ("at", "half") else pa.int64() for c in names]
        return pa.RecordBatch.from_arrays([pa.array(given[c], kind) if c in given else pa.nulls(n, kind) for c, kind in zip(names, kinds, strict=True)], names=names)

    def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
        given = by_size({name: c.to_numpy() for name, c in zip(t.column_names, t.columns, strict=True)})
        key, seq, f1, size, m1, m2 = (given[c] for c in POSTED)
        group, side = given.get("group", np.zeros(len(key), np.int64)), given.get("side", np.full(len(key), -1))
        n, at = size >> 32, size & 0xFFFFFFFF
        bucket = _runs(key, group)
        most = DENSE * np.bincount(bucket, minlength=len(key))
        count, met, kept = np.zeros(len(key), np.int64), np.zeros(len(key), bool), []
        for j, i in meeting(key, group, side, n, at, m1, m2, percent):
            count += np.bincount(bucket[j], minlength=len(key))
            met[j] = met[i] = True
            few = count[bucket[j]] <= most[bucket[j]]
            kept.append((j[few], i[few]))
        for j, i in kept:
            few = count[bucket[j]] <= most[bucket[j]]
            j, i = j[few], i[few]
            later = (seq[j] > seq[i]) | ((seq[j] == seq[i]) & (f1[j] > f1[i]))
            b, a = np.where(later, j, i), np.where(later, i, j)
            yield rows(len(b), seq=seq[b], f1=f1[b], a_seq=seq[a], a_f1=f1[a], at=at[b])
        dense = np.flatnonzero(met & (count > most)[bucket])
        for own in np.split(dense, np.flatnonzero(np.diff(bucket[dense])) + 1) if len(dense) else []:
            for x, y, left, right in tiles(n[own], percent):
                # the sides of a cut bucket meet each other only
                for one, two in [(0, 1), (1, 0)][: 1 + (x != y)] if side[own[0]] >= 0 else [(None, None)]:
                    if one is None:
                        in_tile = own[left] if x == y else np.concatenate((own[left], own[right]))
                        half = np.full(len(in_tile), -1) if x == y else np.repeat([0, 1], [len(left), len(right)])
                    else:
                        a, b = own[left][side[own[left]] == one], own[right][side[own[right]] == two]
                        in_tile, half = np.concatenate((a, b)), np.repeat([0, 1], [len(a), len(b)])
                        if not (len(a) and len(b)):
                            continue
                    tile = np.full(len(in_tile), 2 * (x * len(own) + y) + (one or 0))
                    yield rows(len(in_tile), seq=seq[in_tile], f1=f1[in_tile], key=key[in_tile], group=group[in_tile], tile=tile, half=half)

    return lambda batches: (met for t in _buckets(batches) for met in found(t))


# --- verification -------------------------------------------------------------------------------


class Places:
    """seq for each (doc_id, line), ascending with it, and back."""

    def __init__(self, scratch: Scratch, lines: DataFrame):
        """lines: doc_id, line and more."""
        low, high, top = lines.agg(F.min("doc_id"), F.max("doc_id"), F.max("line")).first()
        self.low, self.bits, self.order = low or 0, int(top or 0).bit_length(), None
        if low is not None and (high - low + 1) << self.bits >= 1 << 63:
            order = lines.select("doc_id", "line").distinct().orderBy("doc_id", "line").withColumn("seq", F.monotonically_increasing_id())
            self.order = scratch.save(order, "order")

    def numbered(self, lines: DataFrame) -> DataFrame:
        """lines with seq."""
        if self.order is not None:
            return lines.join(self.order, ["doc_id", "line"])
        return lines.withColumn("seq", F.shiftleft(F.col("doc_id") - F.lit(self.low), self.bits) + F.col("line"))

    def of(self, df: DataFrame, seq: str) -> DataFrame:
        """df with place, the struct of doc_id and line that column seq stands for."""
        place = lambda doc_id, line: F.struct(doc_id.alias("doc_id"), line.alias("line")).alias("place")
        if self.order is not None:
            return df.join(self.order.select(F.col("seq").alias(seq), place(F.col("doc_id"), F.col("line"))), seq)
        line = F.col(seq).bitwiseAND(F.lit((1 << self.bits) - 1)).cast("int")
        return df.withColumn("place", place(F.shiftright(seq, self.bits) + F.lit(self.low), line))


def _texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, wanted (line, seq, f1) -> seq, f1, f2, text of the line, where the line has the digest."""
    for batch in batches:
        seq, f1, lines = [], [], []
        for text, wanted in zip(as_bytes(batch.column(0).to_pylist()), batch.column(1).to_pylist(), strict=True):
            split = text.split(b"\n")
            for w in wanted:
                if w["line"] < len(split):
                    seq.append(w["seq"])
                    f1.append(w["f1"])
                    lines.append(split[w["line"]])
        seq, f1 = np.array(seq, np.int64), np.array(f1, np.int64)
        for part in chunks(lines):
            own = lines[part]
            f = Words(own).digests(len(own))
            held = pa.array(f[:, 0] == f1[part])
            text = pa.array([x.decode("utf-8", "surrogatepass") for x in own], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(seq[part]), pa.array(f1[part]), pa.array(f[:, 1]), text], names=["seq", "f1", "f2", "text"]).filter(held)


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                a, b = word_set(left, 1), word_set(right, 1)
                both = len(a & b)
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(keep, pa.bool_())], names=["seq", "f1", "a_seq", "a_f1", "similar"])

    return run


def lines_of(scratch: Scratch, ends: DataFrame, places: Places, texts: DataFrame, name: str) -> DataFrame:
    """seq, f1, f2 and text of the lines that stand for the classes in ends (distinct seq, f1)."""
    wanted = places.of(ends, "seq").groupBy("place.doc_id").agg(F.collect_list(F.struct("place.line", "seq", "f1")).alias("wanted"))
    wanted = scratch.save(wanted, f"wanted-{name}")
    few = (wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0) <= BROADCAST_LINES
    held = texts.join(F.broadcast(wanted) if few else wanted, "doc_id").select("text", "wanted")
    return scratch.save(held.mapInArrow(_texts_of, "seq long, f1 long, f2 long, text string").dropDuplicates(["seq", "f1"]), f"texts-{name}")


def verified(scratch: Scratch, pairs: DataFrame, places: Places, texts: DataFrame, percent: int, name: str) -> DataFrame:
    """pairs (rows of NEAR) and whether the words of both lines reach the similarity."""
    held = lines_of(scratch, pairs.select("seq", "f1").union(pairs.select("a_seq", "a_f1")).distinct(), places, texts, name).drop("f2")
    both = pairs.join(held, ["seq", "f1"]).join(held.toDF("a_seq", "a_f1", "a_text"), ["a_seq", "a_f1"])
    return both.select("seq", "f1", "a_seq", "a_f1", "text", "a_text").mapInArrow(_verified(percent), f"{NEAR}, similar boolean")


def first_matches(scratch: Scratch, classes: DataFrame, places: Places, texts: DataFrame, percent: int) -> DataFrame:
    """seq, f1 and a_seq, a_f1 of an earlier similar class, for each class that has one.

    classes: seq, f1, n, m1, m2, prefix, common; seq ascends with (doc_id, line).
    """
    every, row = {"until": F.lit((1 << 63) - 1), "until_f1": F.lit(0).cast("long")}, ["seq", "f1"]
    posted, most, i, matches = postings(scratch, classes, "0"), FEW, 0, []
    while True:
        near = scratch.save(candidates(posted, most if i else None, percent), f"near-{i}")
        a = F.struct("a_seq", "a_f1")
        named = near.groupBy("seq", "f1").agg(F.max(F.when(F.col("sure"), a)).alias("best"), F.collect_set(a).alias("all"), F.max(F.struct("far_seq", "far_f1")).alias("far"))
        # at first a class with a sure candidate has that one tested alone
        tested = F.when(F.col("best").isNotNull(), F.array("best")).otherwise(F.col("all")) if i == 0 else F.col("all")
        pairs = scratch.save(named.select("seq", "f1", F.explode(tested).alias("a")).select("seq", "f1", "a.*"), f"pairs-{i}")
        judged = verified(scratch, pairs, places, texts, percent, str(i))
        best = judged.filter("similar").groupBy("seq", "f1").agg(F.max(a).alias("a")).select("seq", "f1", "a.*")
        matches.append(scratch.save(best, f"matches-{i}"))
        if i == 0:  # after the first look the nearest others follow from the start
            again = named.filter("best IS NOT NULL OR far.far_seq IS NOT NULL").select("seq", "f1").withColumns(every)
        else:  # down to the farthest that the fullest bucket has named all were tested
            again = named.filter("far.far_seq IS NOT NULL").select("seq", "f1", F.col("far.far_seq").alias("until"), F.col("far.far_f1").alias("until_f1"))
        open_ = scratch.save(again.join(matches[-1], row, "left_anti"), f"open-{i}")
        if open_.isEmpty():
            break
        keys = scratch.save(near.join(open_.select("seq", "f1"), row, "left_semi").select("key").distinct(), f"keys-{i}")
        i, most = i + 1, most * MORE
        posted = postings(scratch, classes, str(i)).join(broadcast_if_small(keys, BROADCAST_KEYS), "key", "left_semi")
        posted = posted.join(broadcast_if_small(open_, BROADCAST_KEYS), row, "left").fillna(-1, ["until"]).fillna(0, ["until_f1"])
    out = matches[0]
    for more in matches[1:]:
        out = out.unionByName(more)
    return out


def _numbers(found: Words) -> np.ndarray:
    """A number for each word; equal ones are the same word byte for byte."""
    _, first, of = np.unique(found.hashes, return_index=True, return_inverse=True)
    return of if found.same(np.arange(len(of)), first[of]) else found.numbered({}, np.arange(len(of)))


def _twice(word: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that a pair has twice."""
    order = np.argsort(word)
    order = order[np.argsort(pair[order].astype(np.uint16 if pair.max(initial=0) < 1 << 16 else np.int64), kind="stable")]
    again = np.flatnonzero((word[order][1:] == word[order][:-1]) & (pair[order][1:] == pair[order][:-1]))
    return order[again], order[again + 1]


def _first_shared(percent: int, ranks: np.ndarray):
    """seq, f1, a_seq, a_f1, at, text, a_text -> the pairs whose words reach the similarity and first meet at that place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            at, text, other = batch.column(4).to_numpy(), as_bytes(batch.column(5).to_pylist()), as_bytes(batch.column(6).to_pylist())
            for part in chunks(text):
                pairs = part.stop - part.start
                found = Words(text[part] + other[part])
                picked, _ = _ordered(found, 2 * pairs, ranks)
                owner = found.owner[picked]
                n = np.bincount(owner, minlength=2 * pairs)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                one, two = _twice(found.hashes[picked], owner % pairs)
                if not found.same(picked[one], picked[two]):  # two words share a hash
                    one, two = _twice(_numbers(found)[picked], owner % pairs)
                shared = np.sort(np.minimum(one, two))  # words of the first texts stand before those of the second
                n_shared = np.bincount(owner[shared], minlength=pairs)
                first = np.full(pairs, -1)
                first[owner[shared][::-1]] = place[shared][::-1]  # the smallest place is written last
                keep.append((100 * n_shared >= percent * (n[:pairs] + n[pairs:] - n_shared)) & (first == at[part]))
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["seq", "f1", "a_seq", "a_f1"]).filter(pa.array(np.concatenate(keep) if keep else [], pa.bool_()))

    return run


def counted(lines: list[bytes], seq: np.ndarray, f1: np.ndarray, half: np.ndarray, key: int, percent: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many others of a tile each line is similar to, and which is its nearest earlier one (-1: none), of the pairs whose
    first shared word is key. Sets are rows of bits, a column for each word that two lines hold, in the order of words."""
    total = len(lines)
    found = Words(lines)
    picked, rank = _ordered(found, total, ranks)
    owner, word = found.owner[picked], _numbers(found)[picked]
    n = np.bincount(owner, minlength=total)
    names, first, held = np.unique(word, return_index=True, return_counts=True)
    names, first = names[held > 1], first[held > 1]
    hashes, rank = found.hashes[picked[first]], rank[picked[first]]
    order = np.argsort((rank.astype(_U) << _U(56)) | (hashes & _U((1 << 56) - 1)))
    column = np.full(len(found.hashes) + 1, -1)
    column[names[order]] = np.arange(len(order))
    before = np.flatnonzero(hashes[order].view(np.int64) == key)
    links, best = np.zeros(total, np.int64), np.full(total, -1)
    if not len(before):  # no two lines share the word
        return links, best
    at = column[word]
    owner, at = owner[at >= 0], at[at >= 0]
    bits = np.zeros((total, len(order) // 64 + 1), _U)
    np.bitwise_or.at(bits, (owner, at >> 6), _U(1) << (at & 63).astype(_U))
    early = bits[:, : before[0] // 64 + 1].copy()
    early[:, -1] &= (_U(1) << _U(before[0] % 64)) - _U(1)
    has = (bits[:, before[0] // 64] >> _U(before[0] % 64)) & _U(1) == 1
    row = np.flatnonzero(has)
    row = row[np.argsort(n[row], kind="stable")]
    bits, early, n, half = bits[row], early[row], n[row], half[row]
    nth = np.empty(total, np.int64)
    nth[np.lexsort((f1, seq))] = np.arange(total)
    nth, seq = nth[row], seq[row]
    line_at, found_links, nearest_ = np.zeros(total, np.int64), np.zeros(len(row), np.int64), np.full(len(row), -1)
    for i in range(len(row) - 1):
        stop = np.searchsorted(n, 100 * n[i] // percent, side="right")
        j = np.arange(i + 1, stop)
        if half[i] >= 0:
            j = j[half[j] != half[i]]
        own = np.flatnonzero(early[i])
        if len(own):
            j = j[~(early[j][:, own] & early[i, own]).any(axis=1)]
        if not len(j):
            continue
        own = np.flatnonzero(bits[i])
        both = np.bitwise_count(bits[j][:, own] & bits[i, own]).sum(axis=1, dtype=np.int64)
        j = j[100 * both >= percent * (n[i] + n[j] - both)]
        if len(j):
            found_links[i] += len(j)
            found_links[j] += 1
            later = j[seq[j] > seq[i]]
            nearest_[later] = np.maximum(nearest_[later], nth[i])
            nearest_[i] = max(nearest_[i], nth[j[seq[j] < seq[i]]].max(initial=-1))
    links[row] = found_links
    line_at[nth] = row  # the line at each place in the order
    best[row] = np.where(nearest_ >= 0, line_at[nearest_], -1)
    return links, best


COUNTED = "seq long, f1 long, links long, a_seq long, a_f1 long"


def _counted(percent: int, ranks: np.ndarray):
    """Rows (key, group, tile, half, seq, f1, text) sorted by tile -> rows of COUNTED, one for each class with links."""

    def tile(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        seq, f1 = t.column("seq").to_numpy(), t.column("f1").to_numpy()
        links, best = counted(as_bytes(t.column("text").to_pylist()), seq, f1, t.column("half").to_numpy(), t.column("key")[0].as_py(), percent, ranks)
        have = np.flatnonzero(links)
        none, best = best[have] < 0, best[have]
        columns = [pa.array(seq[have]), pa.array(f1[have]), pa.array(links[have]), pa.array(seq[best], mask=none), pa.array(f1[best], mask=none)]
        return pa.RecordBatch.from_arrays(columns, names=["seq", "f1", "links", "a_seq", "a_f1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, group, number = (batch.column(c).to_numpy() for c in range(3))
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(group) != 0) | (np.diff(number) != 0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                own = (key[start], group[start], number[start])
                if held and own != name:
                    yield tile(held)
                    held = []
                held.append(batch.slice(start, stop - start))
                name = own
        if held:
            yield tile(held)

    return run


def linked(scratch: Scratch, classes: DataFrame, places: Places, texts: DataFrame, ranks: np.ndarray, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What first_matches gives; seq, f1 and links of each class that has links: how many other classes are similar
    to it; and seq, f1, f2 of all classes in the two. All pairs that the filters let through are verified."""
    posted = postings(scratch, classes, "all")
    if "group" in posted.columns:
        ordered = posted.withColumn("bucket", F.xxhash64("key", "group")).repartition("bucket").sortWithinPartitions("bucket")
    else:
        ordered = posted.repartition("key").sortWithinPartitions("key")
    met = scratch.save(ordered.mapInArrow(_meeting(percent), MET), "met")
    pairs = met.filter("a_seq IS NOT NULL").groupBy("seq", "f1", "a_seq", "a_f1").agg(F.min("at").alias("at"))
    pairs, dense = scratch.save(pairs, "pairs-all"), met.filter("a_seq IS NULL")
    ends = pairs.select("seq", "f1").union(pairs.select("a_seq", "a_f1")).union(dense.select("seq", "f1")).distinct()
    named = lines_of(scratch, ends, places, texts, "all")

    held = named.drop("f2")
    both = pairs.join(held, ["seq", "f1"]).join(held.toDF("a_seq", "a_f1", "a_text"), ["a_seq", "a_f1"])
    both = both.select("seq", "f1", "a_seq", "a_f1", "at", "text", "a_text")
    similar = scratch.save(both.mapInArrow(_first_shared(percent, ranks), NEAR), "similar")
    tile = ["key", "group", "tile"]
    whole = dense.join(held, ["seq", "f1"]).select(*tile, "half", "seq", "f1", "text").repartition(*tile).sortWithinPartitions(*tile)
    counts = scratch.save(whole.mapInArrow(_counted(percent, ranks), COUNTED), "counted")

    earlier = similar.filter("a_seq < seq").unionByName(counts.filter("a_seq IS NOT NULL").drop("links"))
    first = earlier.groupBy("seq", "f1").agg(F.max(F.struct("a_seq", "a_f1")).alias("a")).select("seq", "f1", "a.*")
    one = F.lit(1).cast("long").alias("links")
    ends = similar.select("seq", "f1", one).union(similar.select("a_seq", "a_f1", one)).union(counts.select("seq", "f1", "links"))
    return first, ends.groupBy("seq", "f1").agg(F.sum("links").alias("links")), named.select("seq", "f1", "f2")


def duplicate_lines(docs: DataFrame, percent: int = 80, links: bool = True) -> DataFrame:
    """One row per doc_id: doc_id, n_lines, removed (line numbers from 0, ascending), n_links, matches.

    matches: for each removed line, its number and the place (doc_id, line) of an earlier line that is equal or similar
    to it. n_links: for each line of the document, how many different lines (copies counted once) are similar to it, added
    up; with ``links`` false they are not looked for, and it is null. Reads ``doc_id`` and ``text`` only. Null and empty texts have one line without
    words; lines without words match nothing and stay. Rows without doc_id are left out: their lines have no place in
    the order. Repeated doc_ids are judged together, and lines at the same place of repeated rows don't remove each
    other. Lines of any length are compared whole. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranks = word_ranks(texts)
    lines = scratch.save(texts.mapInArrow(_lines(ranks, percent), LINES), "all-lines", **PLAIN)
    places, row = Places(scratch, lines), ["f1", "f2"]
    # a slice of texts has one row a class here, so that a line that is everywhere is no large group; of two of them, one is first
    whole = Window.partitionBy(*row).orderBy("seq")
    classes = places.numbered(lines.filter("n > 0 AND copies > 0")).withColumns({"nth": F.row_number().over(whole), "next": F.lead("seq").over(whole)}).filter("nth = 1")
    classes = scratch.save(classes.select(*row, "seq", "n", "m1", "m2", "prefix", "common", F.expr("copies > 1 OR next IS NOT NULL").alias("repeated")), "classes", **PLAIN)
    lines = scratch.save(lines.select("doc_id", "line", "n", *row), "lines", **PLAIN)
    scratch.drop("all-lines")

    if links:
        matches, counts, named = linked(scratch, classes, places, texts, ranks, percent)
    else:
        matches, named = first_matches(scratch, classes, places, texts, percent), classes.select("seq", "f1", "f2")
    matched = places.of(matches.join(named, ["seq", "f1"]), "a_seq").select(*row, F.col("place").alias("other"))
    repeated = places.of(classes.filter("repeated").select(*row, "seq"), "seq").select(*row, F.col("place").alias("own"))
    known = repeated.join(matched, row, "full").select(*row, F.coalesce("other", "own").alias("earlier"))
    if links:
        known = known.join(counts.join(named, ["seq", "f1"]).select(*row, "links"), row, "full")
    else:
        known = known.withColumn("links", F.lit(None).cast("long"))
    known = scratch.save(known, "known")
    judged = lines.filter("n > 0").select("doc_id", "line", *row).join(known, row)
    match = F.struct("line", F.col("earlier.doc_id").alias("doc_id"), F.col("earlier.line").alias("at"))
    match = F.when(F.struct("doc_id", "line") > F.col("earlier"), match)
    judged = judged.groupBy("doc_id").agg(F.array_sort(F.collect_set(match)).alias("matches"), F.sum("links").alias("n_links"))
    every = lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    out = every.join(judged, "doc_id", "left").withColumn("matches", F.coalesce("matches", F.expr("cast(array() as array<struct<line: int, doc_id: bigint, at: int>>)")))
    out = out.fillna(0, ["n_links"]) if links else out
    return out.select("doc_id", "n_lines", F.array_distinct("matches.line").alias("removed"), "n_links", "matches")


def without_lines(docs: DataFrame, removals: DataFrame) -> DataFrame:
    """docs with the removed lines taken out of their texts; removals: doc_id, removed. Null texts stay null."""
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    marked = docs.alias("d").join(removals.select("doc_id", "removed").alias("r"), F.col("d.doc_id") == F.col("r.doc_id"), "left")
    kept = F.filter(F.split("d.text", "\n"), lambda x, i: ~F.array_contains("r.removed", i.cast("int")))
    text = F.when(F.size("r.removed") > 0, F.array_join(kept, "\n")).otherwise(F.col("d.text"))
    return marked.select(*(text.alias("text") if name == "text" else c for name, c in zip(docs.columns, columns, strict=True)))
