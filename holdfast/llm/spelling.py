"""Grouping of spelling variants by deletion keys from rolling hashes.

Two words are near if one code point inserted, deleted or replaced turns one into the other. Prefix sums of a
polynomial hash over a batch's code points, taken modulo 2**64, give the hash of every word without any one of its code
points as prefix plus shifted suffix, for all words and places at once in numpy. Words with a common deletion differ by a
replacement if the place is the same; a word that is another's deletion differs by an insertion. So all near words meet
under one key, where each pair shows once.

Keys are dealt by their leading digits (radix) and sorted within tasks; a pass over the sorted keys compares the strings
behind equal keys, as hashes can collide. Under one key stand only words that become equal by one deletion, so groups are
bounded by the alphabet times the length, and per word only counts and the best near word leave a group, never pairs.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Words, as_bytes, chunks, mix64

LEAST = 7  #: code points of a word
EVERY = 31  #: runs whose crc32 this divides lose a code point
FACTOR = 10  #: a form is so many times as frequent as its word
LONG = 64  #: code points of a deletion up to which its key carries the word; beyond, only keys that occur twice fetch it
RADIX_BITS = 16
HELD = 500_000  #: distinct words that a task counts before it hands them on

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def _between(data: np.ndarray) -> np.ndarray:
    """Bytes that are no part of a run: all but a-z (A-Z are lower-cased before) and U+00C0 to U+00FF, the characters of two bytes that begin with C3."""
    lead = data == 0xC3
    run = lead | ((data >= 97) & (data <= 122))
    run[1:] |= lead[:-1]
    return ~run


def crc32s(found: Words, at: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of the words at ``at``, each carried on from a seed."""
    crc, place, left = ~seeds.astype(np.uint32), found.start[at], found.end[at] - found.start[at]
    going = np.arange(len(at))
    while len(going):
        crc[going] = _CRC[(crc[going] ^ found.data[place]) & 255] ^ (crc[going] >> 8)
        more = left > 1
        going, place, left = going[more], place[more] + 1, left[more] - 1
    return ~crc


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their occurrences, of about HELD words at a time."""
    known: dict[bytes, int] = {}
    counts, short = np.zeros(1 << 20, np.int64), {}

    def flush() -> pa.RecordBatch:
        nonlocal counts
        out: dict[str, int] = {w.decode("utf-8"): n for w, n in zip(known, counts.tolist(), strict=False)}
        for w, n in short.items():
            out[w] = out.get(w, 0) + n
        known.clear()
        short.clear()
        counts[:] = 0
        return pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1).to_pylist())
        for part in chunks(texts, 1 << 20):
            found = Words(texts[part], space=_between)
            leads = np.concatenate(([0], np.cumsum(found.data == 0xC3)))
            length = found.end - found.start - (leads[found.end] - leads[found.start])
            at = np.flatnonzero(length >= LEAST)
            length = length[at]
            seeds = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids[part]], np.uint32)
            crc = crc32s(found, at, seeds[found.owner[at]])
            cut = crc % EVERY == 0
            number = found.numbered(known, at[~cut])
            if len(known) > len(counts):
                counts = np.concatenate((counts, np.zeros(len(known), np.int64)))
            if len(number):
                own = np.bincount(number)
                counts[: len(own)] += own
            cut &= length > LEAST
            for i, c, n in zip(at[cut].tolist(), crc[cut].tolist(), length[cut].tolist(), strict=True):
                word, c = found.data[found.start[i] : found.end[i]].tobytes().decode("utf-8"), c % n
                word = word[:c] + word[c + 1 :]
                short[word] = short.get(word, 0) + 1
            if len(known) + len(short) >= HELD:
                yield flush()
    yield flush()


def words(docs: DataFrame) -> DataFrame:
    """word, n: what the runs of all texts give, counted over all documents, words of two occurrences and more.

    Reads ``doc_id`` and ``text`` only; a null doc_id counts as an empty one, a null text as none.
    """
    texts = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n >= 2")


def deletion_keys(terms: list[str]) -> tuple[np.ndarray, ...]:
    """(index of the word, place of the deletion or -1 for the whole word, whether it begins a run of equal code points,
    code points left, key), for each word and each of its deletions."""
    points = np.frombuffer("".join(terms).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.fromiter(map(len, terms), np.int64, len(terms))
    first = np.cumsum(length) - length
    power = np.concatenate(([_U(1)], np.cumprod(np.full(len(points), _BASE), dtype=_U)))
    back = np.concatenate(([_U(1)], np.cumprod(np.full(len(points) + 1, _INVERSE), dtype=_U)))
    sums = np.concatenate(([_U(0)], np.cumsum(mix64(points.astype(_U) + _BASE) * power[:-1], dtype=_U)))
    owner = np.repeat(np.arange(len(terms)), length)
    at = np.arange(len(points))
    begin, end = first[owner], (first + length)[owner]
    cut = (sums[at] - sums[begin]) + (sums[end] - sums[at + 1]) * _INVERSE
    hashes = np.concatenate((cut * back[begin], (sums[first + length] - sums[first]) * back[first]))
    new = np.concatenate((points[1:] != points[:-1], [True]))
    new = np.concatenate(([True], new[:-1])) | (at == begin)
    left = np.concatenate((length[owner] - 1, length))
    key = mix64(hashes ^ (left.astype(_U) * _BASE)).view(np.int64)
    return np.concatenate((owner, np.arange(len(terms)))), np.concatenate((at - begin, np.full(len(terms), -1))), np.concatenate((new, np.ones(len(terms), bool))), left, key


def _keyed(long: bool):
    """Keys of deletions up to LONG code points with their word, or those of longer ones with its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _slices(batch, 1 << 17):
                terms = rows.column(1).to_pylist()
                of, place, new, left, key = deletion_keys(terms)
                keep = np.flatnonzero((left > LONG) == long)
                of = pa.array(of[keep])
                columns = [pa.array(key[keep]), pa.array(place[keep]), pa.array(new[keep])]
                columns += [rows.column(i).take(of) for i in ((0,) if long else (1, 2))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "place", "new", *(["id"] if long else ["word", "n"])])

    return run


def _slices(batch: pa.RecordBatch, points: int) -> Iterator[pa.RecordBatch]:
    """Slices of about so many code points; a longer word makes a slice of its own."""
    at, size = 0, 0
    for i, word in enumerate(batch.column(1).to_pylist()):
        if size and size + len(word) > points:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += len(word)
    if at < batch.num_rows:
        yield batch.slice(at)


def _group(members: list[tuple[int, bool, str, int]], near: list) -> None:
    """Adds (word, near words, minus the best one's n, the best one) of words under one key: (place, new, word, n)."""
    behind = defaultdict(list)  # keys can collide: by the string that is left
    for place, new, word, n in members:
        behind[word if place < 0 else word[:place] + word[place + 1 :]].append((place, new, word, n))
    for group in behind.values():
        if len(group) < 2:
            continue
        at = defaultdict(list)
        for place, _, word, n in group:
            at[place].append((-n, word))
        for place, same in at.items():
            if place >= 0 and len(same) > 1:  # a replacement at this place
                one, two = sorted(same)[:2]
                near += [(w, len(same) - 1, *(two if w == one[1] else one)) for _, w in same]
        if -1 in at:  # an insertion; of a run of equal code points one deletion counts
            [whole] = at[-1]
            longer = [(-n, word) for place, new, word, n in group if place >= 0 and new]
            if longer:
                near.append((whole[1], len(longer), *min(longer)))
                near += [(w, 1, *whole) for _, w in longer]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: counts and best near words of each key with several words."""
    rest: pa.Table | None = None

    def found(rows: pa.Table, key: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate(([True], key[1:] != key[:-1]))
        begin = np.flatnonzero(new)
        size = np.diff(np.concatenate((begin, [len(key)])))
        many = size > 1
        rows = rows.filter(pa.array(np.repeat(many, size)))
        members = list(zip(*(rows.column(c).to_pylist() for c in ("place", "new", "word", "n")), strict=True))
        near, at = [], 0
        for n in size[many].tolist():
            _group(members[at : at + n], near)
            at += n
        columns = list(zip(*near, strict=True)) or [[]] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["word", "near", "minus", "other"])

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        key = rows.column("key").to_numpy()
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on in the next batch
        if last:
            yield found(rows.slice(0, last), key[:last])
        rest = rows.slice(last)
    if rest is not None and rest.num_rows:
        yield found(rest, rest.column("key").to_numpy())


def near_words(counted: DataFrame) -> DataFrame:
    """word, n, n_near, best_n and best (the near word of largest n, of several the first in code-point order).

    counted: a written table of distinct ``word`` with ``n``.
    """
    spark, scratch = counted.sparkSession, Scratch(counted.sparkSession, "near-words")
    rows = scratch.save(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    names = "key long, place long, new boolean, "
    keys = rows.mapInArrow(_keyed(False), names + "word string, n long")
    # long words: their keys go without them, and only those that meet another fetch it
    bare = rows.filter(F.length("word") > LONG).mapInArrow(_keyed(True), names + "id long")
    bare = scratch.save(bare, "long-keys")
    twice = bare.groupBy("key").agg(F.count("*").alias("of")).filter("of > 1").select("key")
    fetched = bare.join(twice, "key", "left_semi").join(rows, "id").select("key", "place", "new", "word", "n")
    digits = F.shiftright("key", 64 - RADIX_BITS)
    dealt = keys.unionByName(fetched).repartition(digits).sortWithinPartitions("key")
    found = dealt.mapInArrow(_grouped, "word string, near long, minus long, other string")
    best = F.when(F.col("other").isNotNull(), F.struct("minus", "other"))
    both = found.select("word", F.lit(None).cast("long").alias("n"), "near", best.alias("best"))
    alone = rows.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast(both.schema["best"].dataType).alias("best"))
    one = both.unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return one.select("word", "n", "n_near", (-F.col("best.minus")).alias("best_n"), F.col("best.other").alias("best"))


def variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the texts.

    Reads ``doc_id`` and ``text`` only; other columns may have any name. Null and empty texts have no words; repeated
    rows count each; words of any length are compared whole, and of equally frequent near words the first in code-point
    order is the form. An empty table gives no rows. A form is at least FACTOR times as frequent as its word, so chains
    of forms are short: each round that resolves roots halves what is left of them.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    near = near_words(scratch.save(words(docs), "words"))
    has = F.col("best_n") >= FACTOR * F.col("n")
    judged = near.select("word", "n", "n_near", F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"))
    judged = scratch.save(judged, "judged")
    roots = judged.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    roots, n = scratch.save(roots, "roots-0"), 0
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        moved, n = scratch.save(moved, f"roots-{n + 1}"), n + 1
        if moved.filter("moved").isEmpty():
            break
        roots = moved.select("word", "root")
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
