"""The pipeline's stages against plain versions, on sf0.001 and on awkward tables."""

import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import corpus_pipeline as P
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from holdfast.llm import common, minhash, toxicity
from holdfast.llm.decontaminate import WINDOW
from holdfast.llm.token_output import PieceEncoder
from holdfast.scratch import Scratch

from .helpers import AWKWARD, SF, near_copies, shingles, similar, table
from .test_text import brute_matches


def rows_of(df):
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def test_toxic_texts_go(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = P.drop_toxic(spark, documents, SF)
    assert got.columns == documents.columns
    model = toxicity.train(documents.filter(~toxicity.held_out("doc_id")), labels)

    def plain(text):
        words = Counter(re.findall(r"[^\W\d_]+", (text or "").lower()))
        begun = Counter()
        for w, n in words.items():
            if len(w) > 5:
                begun["^" + w[:5]] += n
        z = model.bias + sum(model.weights[t] * min(n, 3) for t, n in (words + begun).items() if t in model.weights)
        return 1 / (1 + math.exp(-max(min(z, 30), -30)))

    want = Counter({k: n for k, n in rows_of(documents).items() if plain(k[1]) < 0.5})
    assert rows_of(got) == want and 0 < sum(want.values())


def brute_near(rows):
    """One row of each component: the least by (no doc_id, doc_id), of several under that id any one."""
    sets = [shingles(t, 5) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and (similar(sets[i], sets[j])):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    members = defaultdict(list)
    for i, g in enumerate(group):
        members[g].append(rows[i])
    return members, sets


@pytest.mark.parametrize("source", ["tables", "copies"])
def test_one_row_of_each_group_stays(spark, documents, source):
    if source == "tables":
        docs = documents
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    else:
        rows = near_copies(90, seed=8, words=60) + AWKWARD + [(5, "quite another text under the id of a copy"), (None, "only here"), (None, "ONLY here")]
        docs = table(spark, rows)
    got = P.drop_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    kept, left = rows_of(got), Counter()
    for members in brute_near(rows)[0].values():
        if not shingles(members[0][1], 5):
            left.update(members)
            continue
        least = min(((d is None, d or 0) for d, _ in members))
        stays = [m for m in members if (m[0] is None, m[0] or 0) == least]
        held = [m for m in set(stays) if kept[m]]
        assert len(held) == 1, (members, held)
        left[held[0]] += 1
    assert kept == left


def test_texts_with_passages_go(spark, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    few = [r for r in rows if len(r[1] or "") < 4000]
    found = {d for d, *_ in brute_matches(few, items, WINDOW)}
    got = rows_of(P.decontaminate(spark, documents, SF))
    assert {k for k in got if k in set(few)} == {r for r in few if r[0] not in found} and found
    # of two texts under one id only the one with the passage goes
    passage = next(t for i, t in items if len(t.split()) > WINDOW)
    twins = table(spark, [(1, passage), (1, "a clean text"), (None, passage), (None, "clean too"), (2, None), (3, "")])
    assert rows_of(P.decontaminate(spark, twins, SF)) == Counter([(1, "a clean text"), (None, "clean too"), (2, None), (3, "")])


def test_decontamination_holds_one_row_a_text(spark, monkeypatch):
    """A long text full of passages goes, and is one row with its places on the way."""
    saved, save = {}, Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name, **options: saved.setdefault(name, save(self, df, name, **options)))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy(F.length("text").desc()).first()["text"]
    docs = spark.createDataFrame([(1, f"{item} " * 200), (2, "clean")], "doc_id long, text string")
    assert rows_of(P.decontaminate(spark, docs, SF)) == Counter([(2, "clean")])
    assert saved["gathered"].count() == 1 and saved["hits"].count() > 200


def test_sources_are_mixed(spark, documents):
    got = P.mix_sources(spark, documents, SF)
    assert got.columns == documents.columns
    used, had = Counter(), Counter()
    for df, counts in ((got, used), (documents, had)):
        for r in df.select("source", "text").collect():
            counts[r["source"]] += len((r["text"] or "").split())
    total = sum(had.values())
    entropy = lambda c: -sum(n / sum(c.values()) * math.log(n / sum(c.values())) for n in c.values() if n)
    longest = documents.select(F.max(F.size(F.split("text", " ")))).first()[0]
    assert abs(sum(used.values()) - total) <= longest * len(had)
    assert entropy(used) > entropy(had) and max(used[s] / had[s] for s in had) <= 4.5
    assert set(rows_of(got)) <= set(rows_of(documents))


def test_tokens_are_written_and_read(spark, documents):
    some = documents.filter("n_chars < 20000").limit(60).cache()
    got = sorted((tuple(r) for r in P.token_output(spark, some, SF).collect()), key=lambda r: r[1])
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at = 0
    texts = {r["doc_id"]: r["text"] for r in some.collect()}
    assert [g[0] for g in got] == sorted(texts)
    for doc_id, start, n, crc in got:
        ids = plain.encode(texts[doc_id] or "", add_special_tokens=False).ids + [1]
        assert (start, n, crc) == (at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        at += n


@pytest.mark.parametrize(("name", "stage"), P.STAGES, ids=[n for n, _ in P.STAGES])
def test_stages_on_awkward_and_empty_tables(spark, name, stage):
    docs = table(spark, [(d, t if len(t or "") < 9000 else t[:9000]) for d, t in AWKWARD])
    clash = ["row", "text_key", "stays", "key", "group", "_source", "_text", "_n", "order"]
    docs = docs.withColumns({c: F.lit(c) for c in clash if c not in docs.columns}).withColumn("source", F.when(F.col("doc_id") < 6, F.col("source")))
    got, none = stage(spark, docs, SF), stage(spark, docs.limit(0), SF)
    assert none.collect() == []
    if name != "token_output":
        assert got.columns == docs.columns == none.columns
        assert all(r[c] == c for r in got.collect() for c in clash)
    assert {"near_duplicates": 9, "toxicity": 14, "decontamination": 14, "token_output": 14}.get(name, got.count()) == got.count()


def test_run_is_the_stages_in_turn(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_output"]
    got = P.run(spark, SF).collect()
    assert got and sum(r["n_tokens"] for r in got) == max(r["start"] + r["n_tokens"] for r in got)


def most_held(rows) -> int:
    """Bytes that Python holds at most while rows are made, the first left out."""
    tracemalloc.start()
    try:
        next(rows, None)
        tracemalloc.reset_peak()
        for _ in rows:
            pass
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_workers_hold_a_small_part_of_a_batch_and_free_what_others_kept():
    """A worker goes on to other tasks and would keep what the lists of a whole batch took."""
    text = [" ".join(f"w{(i * 7 + j) % 5000}" for j in range(700)) for i in range(5000)]
    texts, numbers = pa.array(text), pa.array([0] * len(text), pa.int64())
    del text
    assert texts.nbytes > 16 << 20
    docs = pa.RecordBatch.from_arrays([numbers, numbers, texts], names=["doc_id", "text_key", "text"])
    pairs = pa.RecordBatch.from_arrays([numbers, numbers, texts, texts], names=["a", "b", "ta", "tb"]).slice(0, 4000)
    labelled = pa.RecordBatch.from_arrays([texts, numbers], names=["text", "toxic"])

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        PieceEncoder.of(f.read(), 1)
    assert most_held(minhash._signed(5)(iter([docs]))) < 30 << 20  # 17 MB are its slots
    assert list(common._kept) == [("signatures", 5)]
    assert most_held(minhash._verified(5, 80)(iter([pairs]))) < 8 << 20
    assert most_held(toxicity._mined(b for b in [labelled.slice(0, 1), labelled])) < 8 << 20
    assert not common._kept


def test_slices_hold_every_row():
    texts = pa.array([None, "", "a" * 10, "b" * 300, "c" * 60, None, "é" * 45, "d"])
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), texts], names=["i", "text"])
    parts = list(common.slices(batch, batch.column(1), limit=100))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1, 2], [3], [4, 5], [6, 7]]
    assert list(common.slices(batch.slice(0, 0), texts.slice(0, 0))) == []


def test_spark_sends_workers_small_batches(spark, monkeypatch):
    key, signed, most = "spark.sql.execution.arrow.maxBytesPerBatch", minhash._signed, 2 * common.BATCH

    def seen(k):
        run = signed(k)

        def watched(batches):
            for batch in batches:
                assert batch.nbytes < most, batch.nbytes
                yield from run(iter([batch]))

        return watched

    monkeypatch.setattr(minhash, "_signed", seen)
    words = F.transform(F.sequence(F.lit(0), F.lit(899)), lambda x: F.concat(F.lit("w"), F.col("id") * 1000 + x))
    docs = spark.range(0, 1500, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", words).alias("text"))
    assert minhash.near_duplicates(docs).filter("kept").count() == 1500
    assert spark.conf.get(key, None) is None
    spark.conf.set(key, "1m")
    try:
        with common.small_batches(spark):
            assert spark.conf.get(key) == "1m"
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)
