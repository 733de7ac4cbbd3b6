"""Token-id output: canonical length-limited Huffman code over global id counts, in independent blocks.

Format of a folder. ``code``: one row per id that occurs: id, count, length; canonical codes follow from the
lengths. ``blocks``: rows in files, a shard being a range of doc_ids and its blocks consecutive texts in ascending
order. A block has its texts' doc_ids and token numbers, the number of tokens before it in its shard, a payload in
which each text starts at a byte, and the bit offset of every CHECKPOINT-th token of a text. Any block can be
decoded alone, and its checkpoints decode side by side through one table with an entry for each code of full length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, give_back, kept

LIMIT = 16  #: bits of the longest code; two more than their number takes if ids are too many for that
CHECKPOINT = 256  #: tokens between bit offsets
BLOCK_TOKENS = 1 << 18  #: tokens of a block, or one text
SHARD_TOKENS = 1 << 23  #: tokens of a shard, about; one task writes a shard
SHARDS, PER_CUT = 65_536, 200  #: shards at most, beyond which they grow; sampled doc_ids for each bound between two
UNITS = 400_000  #: words and other units of text whose ids a worker remembers
PART = 1 << 22  #: characters tokenised at once
CODED = 1 << 20  #: tokens coded at once


#: A piece that is one run of Latin letters and then ASCII punctuation without an apostrophe: two units to a tokenizer
#: that splits letters from punctuation. These letters are in composed form already.
_LETTERS = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<after>[!-&(-/:-@\[-`{-~]*)$"


def _byte_letters() -> dict[int, str]:
    """For str.translate: a Latin-1 character to the letters that stand for its UTF-8 bytes in byte-level vocabularies.

    Printable bytes stand for themselves; the others, in order, for the characters from 256 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    letter = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


def _ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places start[i], ..., start[i] + n[i] - 1 of all i, one after the other."""
    ends = np.cumsum(n)
    return np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


class PieceEncoder:
    """Ids of whole texts by way of a memory of the units between spaces and line feeds.

    Exact for byte-level tokenizers that drop white space and never join text across it. If the tokenizer also
    lower-cases and splits letters from the rest (checked on a sample at the start), the letters of a piece go to its
    model directly. A full memory takes no more units; what it lacks is encoded each time.
    """

    @classmethod
    def of(cls, tokenizer_json: str, end_id: int) -> PieceEncoder:
        return kept(("encoder", zlib.crc32(tokenizer_json.encode()), end_id), lambda: cls(tokenizer_json, end_id))

    def __init__(self, tokenizer_json: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.letters, self.end_id = _byte_letters(), end_id
        self.at: dict[str, int] = {}  # unit -> its number; unit i has ids[first[i] : first[i + 1]]
        self.ids, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        sample = ["Straße,", "ÉTÉ!!", "señor.", "The&&&", "word", "Ünïcödé|"]
        plain = [self.tokenizer.encode(p, add_special_tokens=False).ids for p in sample]
        self.direct = True
        self.direct = [x.tolist()[:-1] for x in np.split(*self(pa.array(sample), cuts=True))] == plain
        self.at, self.ids, self.first = {}, self.ids[:0], self.first[:1]

    def _numbers(self, words: list[str], others: list[str]) -> np.ndarray:
        """The units' numbers; new units are encoded, and those that find no room get numbers beyond the memory's.

        words hold a unit once; others may repeat one, such as the empty one.
        """
        known = len(self.at)
        new_words, rest = [w for w in words if w not in self.at], list(dict.fromkeys(u for u in others if u not in self.at))
        flat: list[int] = []
        sizes: list[int] = []
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        for word in new_words:
            before = len(flat)
            flat.extend([t.id for t in tokenize(word.translate(letters))])
            sizes.append(len(flat) - before)
        for at in range(0, len(rest), 1000):
            for e in self.tokenizer.encode_batch_fast(rest[at : at + 1000], add_special_tokens=False):
                flat.extend(e.ids)
                sizes.append(len(e.ids))
        self.ids = np.concatenate((self.ids, np.array(flat, np.uint32)))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(np.array(sizes, np.int64))))
        new = dict(zip(new_words + rest, range(known, known + len(sizes)), strict=True))
        numbers = [self.at[u] if u in self.at else new[u] for u in words + others]
        self.at.update(islice(new.items(), max(0, UNITS - known)))
        return np.array(numbers, np.int64)

    def __call__(self, texts: pa.Array, cuts: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text's end id included, and where each text ends (cuts: where all but the last end)."""
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        per_text = pc.list_value_length(split).to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        of, pieces = coded.indices.to_numpy(), coded.dictionary
        if self.direct:
            found = pc.extract_regex(pieces, _LETTERS)
            plain = found.is_valid()
            words = pc.utf8_lower(found.field(0).filter(plain)).dictionary_encode()
            after = found.field(1).filter(plain).dictionary_encode()
            others = pieces.filter(pc.invert(plain)).to_pylist()
            listed = words.dictionary.to_pylist()
            number = self._numbers(listed, after.dictionary.to_pylist() + others)
            is_plain = plain.to_numpy(zero_copy_only=False)
            units = np.zeros((len(pieces), 2), np.int64)
            units[is_plain, 0] = number[words.indices.to_numpy()]
            units[is_plain, 1] = number[len(listed) + after.indices.to_numpy()]
            units[~is_plain, 0] = number[len(number) - len(others) :]
            size = np.diff(self.first)
            n = size[units]
            n[~is_plain, 1] = 0
        else:
            units = self._numbers([], pieces.to_pylist())[:, None]
            n = np.diff(self.first)[units]
        of_piece = self.ids[_ragged(self.first[units].ravel(), n.ravel())]
        n = n.sum(axis=1)
        start = np.cumsum(n) - n
        tokens = of_piece[_ragged(start[of], n[of])]
        ends = np.concatenate(([0], np.cumsum(n[of])))[np.cumsum(per_text)]
        tokens = np.insert(tokens, ends, np.uint32(self.end_id))
        known = len(self.at)
        self.first = self.first[: known + 1]
        self.ids = self.ids[: self.first[-1]]
        ends = ends + np.arange(1, len(ends) + 1)
        return tokens, ends[:-1] if cuts else ends


def _parts(sizes: list[int], limit: int):
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield slice(at, i)
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield slice(at, len(sizes))


def tokenized(docs: DataFrame, tokenizer_json: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian, 32 bits each); the end id closes every text, an empty or null one too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = PieceEncoder.of(tokenizer_json, end_id)
        for batch in batches:
            for part in _parts(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), PART):
                rows = batch.slice(part.start, part.stop - part.start)
                ids, ends = encode(rows.column(1))
                offsets = np.concatenate(([0], ends))
                data = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets * 4), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offsets)), data], names=["doc_id", "n_tokens", "ids"])
        give_back()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def id_counts(tokens: DataFrame) -> DataFrame:
    """id, count over all texts; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                n = np.bincount(np.frombuffer(ids.as_buffer(), np.uint32))
                if len(n) > len(total):
                    total = np.concatenate((total, np.zeros(len(n) - len(total), np.int64)))
                total[: len(n)] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(total[seen])], names=["id", "count"])

    return tokens.select("ids").mapInArrow(run, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))


def limit_for(n: int) -> int:
    """Bits of the longest code for n ids; LIMIT where that leaves room."""
    return LIMIT if n <= 1 << LIMIT else n.bit_length() + 2


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Optimal lengths of at most ``limit_for`` bits for positive counts, by package-merge."""
    n = len(counts)
    limit = limit_for(n)
    if n == 1:
        return np.ones(1, np.int64)
    order = np.argsort(counts, kind="stable")
    leaves, packages, kinds = counts[order], np.zeros(0, counts.dtype), []
    for _ in range(limit):
        merged = np.concatenate((leaves, packages))
        by = np.argsort(merged, kind="stable")
        kinds.append(by < n)
        merged = merged[by]
        packages = merged[0 : len(merged) // 2 * 2 : 2] + merged[1::2]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(kinds):
        used = int(is_leaf[:take].sum())
        lengths[:used] += 1
        take = 2 * (take - used)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical code: ids by (length, id) get consecutive codes. ids ascend."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        top, self.limit = int(ids.max()) + 1, max(LIMIT, int(lengths.max()))
        order = np.lexsort((ids, lengths))
        size = np.left_shift(1, self.limit - lengths[order])  # table entries of each code
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        self.length = np.zeros(top, np.int64)
        self.code = np.zeros(top, np.int64)
        self.length[ids] = lengths
        self.code[ids[order]] = first >> (self.limit - lengths[order])
        self.table_id = np.zeros(1 << self.limit, np.uint32)
        self.table_length = np.ones(1 << self.limit, np.int64)
        used = int(size.sum())
        self.table_id[:used] = np.repeat(ids[order], size)
        self.table_length[:used] = np.repeat(lengths[order], size)

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids: texts one after the other; sizes: their token numbers (1 at least).

        Returns the payload, the byte at which each text starts (and the end), and the bit offset of every token.
        """
        length, code = self.length[ids], self.code[ids]
        ends = np.cumsum(sizes)
        before = np.cumsum(length) - length
        base = before[ends - sizes]
        bits = np.add.reduceat(length, ends - sizes)
        starts = np.concatenate(([0], np.cumsum((bits + 7) // 8)))
        at = before - np.repeat(base, sizes) + np.repeat(starts[:-1] * 8, sizes)
        touched = (self.limit + 14) // 8  # bytes that a code touches at most, no bit of them twice
        byte, word = at >> 3, code << (8 * touched - length - (at & 7))
        payload = np.zeros(starts[-1] + touched, np.int64)
        for j in range(touched):
            payload += np.bincount(byte + j, weights=(word >> (8 * (touched - 1 - j))) & 255, minlength=len(payload)).astype(np.int64)
        return payload[: starts[-1]].astype(np.uint8), starts, at

    def decode(self, payload: bytes, marks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """marks: bit offsets of the checkpoints of all texts in order; sizes: the texts' token numbers."""
        per = -(-sizes // CHECKPOINT)
        left = np.full(int(per.sum()), CHECKPOINT, np.int64)
        left[np.cumsum(per) - 1] = sizes - (per - 1) * CHECKPOINT
        to = np.cumsum(left) - left
        lanes = np.argsort(-left, kind="stable")
        left, to, at = left[lanes], to[lanes], marks[lanes].astype(np.int64)
        b = np.frombuffer(payload + b"\0\0\0\0", np.uint8).astype(np.int64)
        windows = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]  # 25 bits from any place in a byte on
        shift, mask = 32 - self.limit, (1 << self.limit) - 1
        active = np.searchsorted(-left, -np.arange(CHECKPOINT), side="left")  # lanes with more than t tokens
        out = np.zeros(int(sizes.sum()), np.uint32)
        for t in range(CHECKPOINT):
            n = active[t]
            if not n:
                break
            p = at[:n]
            key = (windows[p >> 3] >> (shift - (p & 7))) & mask
            out[to[:n] + t] = self.table_id[key]
            at[:n] = p + self.table_length[key]
        return out


BLOCKS = "shard int, block int, first_token long, n_tokens long, doc_ids array<long>, sizes array<long>, marks array<long>, payload binary"


def _coded(code: Code, cuts: np.ndarray, nameless: int):
    """doc_id, n_tokens, ids -> shard, doc_id, n_tokens, marks within the text, payload of each text.

    The shard is the number of cuts below doc_id; rows without doc_id go to ``nameless`` shards before the first, by
    their ids' checksum.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            shards = np.searchsorted(cuts, batch.column(0).fill_null(0).to_numpy(), side="left")
            for i in np.flatnonzero(batch.column(0).is_null().to_numpy(zero_copy_only=False)):
                shards[i] = -1 - zlib.crc32(batch.column(2)[i].as_buffer()) % nameless
            for part in _parts(sizes.tolist(), CODED):
                n = sizes[part]
                rows = batch.slice(part.start, part.stop - part.start)
                payload, starts, at = code.encode(np.frombuffer(b"".join(rows.column(2).to_pylist()), np.uint32), n)
                first = np.cumsum(n) - n
                marks = [(at[f : f + s : CHECKPOINT] - starts[i] * 8).tolist() for i, (f, s) in enumerate(zip(first, n, strict=True))]
                data = payload.tobytes()
                texts = [data[starts[i] : starts[i + 1]] for i in range(len(n))]
                yield pa.RecordBatch.from_arrays([pa.array(shards[part], pa.int32()), rows.column(0), rows.column(1), pa.array(marks, pa.list_(pa.int64())), pa.array(texts, pa.binary())], names=["shard", "doc_id", "n_tokens", "marks", "payload"])

    return run


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts sorted by (shard, doc_id) -> blocks."""
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    shard, block, before, held, tokens = None, 0, 0, [], 0

    def flush():
        nonlocal block, before, held, tokens
        marks, offset = [], 0
        for _, _, m, p in held:
            marks.extend(offset + x for x in m)
            offset += 8 * len(p)
        row = [shard, block, before, tokens, [h[0] for h in held], [h[1] for h in held], marks, b"".join(h[3] for h in held)]
        block, before, held, tokens = block + 1, before + tokens, [], 0
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    for batch in batches:
        for s, *text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (s != shard or tokens + text[1] > BLOCK_TOKENS):
                yield flush()
            if s != shard:
                shard, block, before = s, 0, 0
            held.append(text)
            tokens += text[1]
    if held:
        yield flush()


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes every whole text and writes the folder's ``code`` and ``blocks``.

    Reads ``doc_id`` and ``text`` only. Null counts as empty; every text has its end id at least. Rows without
    doc_id come first; repeated doc_ids stand side by side, ordered by their tokens. Texts of any length are encoded
    whole. An empty table writes no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    tokens = tokenized(docs, Path(tokenizer_path).read_text(encoding="utf-8"), end_id)
    tokens = scratch.save(tokens, "ids", compression="zstd")
    rows = id_counts(tokens).orderBy("id").collect()  # one row per id of the vocabulary at most
    ids, counts = np.array([r["id"] for r in rows], np.int64), np.array([r["count"] for r in rows], np.int64)
    lengths = code_lengths(counts) if len(ids) else counts
    listed = list(zip(ids.tolist(), counts.tolist(), lengths.tolist(), strict=True))
    spark.createDataFrame(listed, "id long, count long, length long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/code")
    if not len(ids):
        spark.createDataFrame([], BLOCKS).write.mode("overwrite").parquet(f"{folder}/blocks")
        return
    # shards are ranges of doc_ids with bounds from quantiles, so no row is tokenised twice to sample it
    n = min(SHARDS, max(1, -(-int(counts.sum()) // shard_tokens)))
    every = max(1, int(counts[ids == end_id].sum()) // (n * PER_CUT))
    sample = tokens.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)  # balance only: each row finds its shard by the bounds
    cuts = sample.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    cuts = sorted(set(cuts or []))
    lost = tokens.filter("doc_id IS NULL").agg(F.sum("n_tokens")).first()[0] or 0
    nameless = min(SHARDS, 1 + lost // shard_tokens)
    coded = tokens.select("doc_id", "n_tokens", "ids").mapInArrow(_coded(Code(ids, lengths), np.array(cuts, np.int64), nameless), "shard int, doc_id long, n_tokens long, marks array<long>, payload binary")
    dealt = coded.repartition(n + nameless, "shard").sortWithinPartitions("shard", "doc_id", "n_tokens", "payload")
    dealt.mapInArrow(_assembled, BLOCKS).write.mode("overwrite").parquet(f"{folder}/blocks")
    scratch.close()


def _code_of(spark: SparkSession, folder: str) -> Code | None:
    rows = spark.read.parquet(f"{folder}/code").select("id", "length").orderBy("id").collect()
    return Code(np.array([r["id"] for r in rows], np.int64), np.array([r["length"] for r in rows], np.int64)) if rows else None


def _read_blocks(spark: SparkSession, folder: str, shape, schema: str) -> DataFrame:
    """Decodes all blocks; shape makes a row's last columns from (offset, ids)."""
    blocks, code = spark.read.parquet(f"{folder}/blocks"), _code_of(spark, folder)
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()  # a row per shard
    starts, total = [], 0
    for r in totals:
        starts.append((r["shard"], total))
        total += r["n"]
    start = F.broadcast(spark.createDataFrame(starts, "shard int, shard_start long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for offset, doc_ids, sizes, marks, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = np.array(sizes, np.int64)
                ids = code.decode(payload, np.array(marks, np.int64), n)
                ends = np.cumsum(n)
                rows = [(d, *shape(offset + int(e - s), ids[e - s : e])) for d, s, e in zip(doc_ids, n, ends, strict=True)]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    names = arrow.names
    joined = blocks.join(start, "shard").select((F.col("shard_start") + F.col("first_token")).alias("offset"), "doc_ids", "sizes", "marks", "payload")
    return joined.mapInArrow(run, schema)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (tokens of all texts before it), ids."""
    return _read_blocks(spark, folder, lambda start, ids: (start, ids.tolist()), "doc_id long, start long, ids array<long>")


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the decoded ids, as read back from the files."""
    digest = lambda start, ids: (start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
    return _read_blocks(spark, folder, digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
