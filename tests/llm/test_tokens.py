"""BPE and token records against the tokenizers library; language ID, sharding and licences."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest import MEDIUM, SMALL
from pyspark.sql import functions as F

from ordstack.llm.corpus import DOCUMENT_COLUMNS
from ordstack.llm import bpe, language_id, license_scan, records, sharding
from ordstack.llm.queries import QUERIES
from ordstack.session import scratch_path

PARTS = ["a", "b", "the", "ing", "é", "é", "<|endoftext|>", "'s", "!!", "'", " ", "1", "…", "Ø", "漢字", "😀", "​",
         "İ", "ß", "<|endof", "text|>", "zz", "́"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary())


@pytest.fixture(scope="module")
def enc():
    return bpe.Encoder(bpe.vocabulary())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("size", [37, 200])
def test_tree_equals_the_library(library, enc, size):
    draw = random.Random(size)
    for _ in range(60):
        some = draw.sample(PARTS, draw.randint(1, len(PARTS)))
        text = "".join(draw.choice(some) for _ in range(draw.choice([3, 50, 400, 2000])))
        assert [t[0] for t in bpe.tree(enc, text, size)] == ids_of(library, text)


def test_words_and_parts_equal_the_library(library, enc):
    draw = random.Random(2)
    chars = [chr(i) for i in [*range(33, 127), *range(161, 384)]]
    texts = ["".join(draw.choice(draw.choice([chars, chars[:94], "'sdmltrve!a1"])) for _ in range(draw.randint(1, 8))) for _ in range(20_000)]
    texts += ["a\x85b \xa0c\x1cd", "x\ty\x0bz", "Σας ΣΑΣ", "<|startoftext|>a"]
    got = [np.frombuffer(x, dtype="<u4").tolist() for x in enc.encode(texts)]
    assert got == [ids_of(library, t) for t in texts]


ROWS = [
    (1, None), (2, ""), (3, "a" * 70_000), (4, "x " + "ab!c" * 10_000 + " y"), (4, "x " + "ab!c" * 10_000 + " y"),
    (None, "hello <|endoftext|>World B\x85c\n\td"), (6, " \n"),
]


def digests(library, text):
    ids = ids_of(library, text)
    decoded = library.decode(ids, skip_special_tokens=False)
    sha = hashlib.sha256
    return len(ids), sha(np.array(ids, dtype="<u4").tobytes()).hexdigest(), sha(decoded.encode()).hexdigest()


def test_round_trip_of_odd_rows(spark, library):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("ids", F.lit(3)).withColumn("n_tokens", F.lit("x"))
    got = bpe.round_trip(df, bpe.vocabulary()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *digests(library, t)) for i, t in ROWS), key=str)
    back = bpe.decode(bpe.encode(df, bpe.vocabulary()), bpe.vocabulary()).collect()
    want = sorted(library.decode(ids_of(library, t), skip_special_tokens=False) for _, t in ROWS)
    assert sorted(r.text for r in back) == want
    assert bpe.round_trip(df.limit(0), bpe.vocabulary()).count() == 0


def test_round_trip_query(spark, library):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op9_bpe_round_trip"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r.doc_id: digests(library, r.text) for r in docs}


def slow_crc(data):
    crc = 0xFFFFFFFF
    for x in data:
        crc ^= x
        for _ in range(8):
            crc = (crc >> 1) ^ (records.POLYNOMIAL if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_crc32c():
    draw = random.Random(1)
    parts = [draw.randbytes(draw.choice([4, 5, 8, 127, 128, 129, 1000])) for _ in range(40)] + [b"123456789"]
    assert records.crc32c(parts).tolist() == [slow_crc(p) for p in parts]
    assert records.crc32c(parts)[-1] == 0xE3069283


def expected(library, rows):
    start, out = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*ids_of(library, text), records.END_ID]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_records_of_odd_rows(spark, library):
    rows = [(5, None), (1, ""), (3, "Hello wörld"), (None, "x y"), (9, "a b " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("x"))
    folder = scratch_path(spark, "records")
    written = records.write(df, bpe.vocabulary(), folder)
    got = sorted(map(tuple, records.records(spark, written).collect()), key=lambda r: r[1])
    assert got == expected(library, rows)
    part, n, _ = written.parts[0]
    shuffled = records.fetch(folder, part, list(range(n))[::-1])
    assert [len(x) for x in shuffled] == [r[2] for r in got[:n]][::-1]
    empty = records.write(df.limit(0), bpe.vocabulary(), scratch_path(spark, "records"))
    assert records.records(spark, empty).count() == 0


def test_many_rows_without_an_id_do_not_gather_in_one_file(spark):
    rows = [(None if i % 2 else 7, f"text number {i} " * (i % 5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or few rows are one file
    try:
        written = records.write(df, bpe.vocabulary(), scratch_path(spark, "records"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [n for _, n, _ in written.parts]
    assert sum(sizes) == 2000 and max(sizes) < 700
    got = sorted(map(tuple, records.records(spark, written).collect()), key=lambda r: r[1])
    assert [r[0] is None for r in got] == [False] * 1000 + [True] * 1000
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]


def test_damage_is_noticed():
    frame = records.frames([records.packed(np.array([1, 2], dtype="<u4").tobytes(), 2)])[0]
    assert records.unpacked(records.unframed(frame, [0])[0]) == np.array([1, 2], dtype="<u4").tobytes()
    for at in (3, 9, 13, len(frame) - 1):
        bad = bytearray(frame)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.unframed(bytes(bad), [0])


def test_records_query(spark, library):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, QUERIES["op3_binary_records"](spark, SMALL).collect()), key=lambda r: r[1])
    assert got == expected(library, docs)


def test_language_id_on_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op1_language_id"](spark, MEDIUM).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


def test_language_id_of_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (4, "12 !", None), (None, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = language_id.fit(df)
    got = language_id.identify(df, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.lang_pred for r in got} == {1: "en", 2: "fr", 3: "und", 4: "und", None: "und"}
    blank = language_id.fit(df.filter("lang IS NULL"))
    assert {r.lang_pred for r in language_id.identify(df, blank).collect()} == {"und"}
    assert {r.doc_id for r in language_id.accepted(df, model).collect()} == {1, 2}
    assert {r.doc_id for r in language_id.accepted(df, blank).collect()} == {1, 2}
    assert language_id.identify(df.limit(0), model).count() == 0


def test_long_texts_are_counted_whole(monkeypatch):
    text = "abc déf ghi " * 50
    whole = np.bincount(np.concatenate(list(language_id.pieces(text))), minlength=language_id.N_BUCKETS)
    monkeypatch.setattr(language_id, "STEP_CHARS", 17)
    parts = np.bincount(np.concatenate(list(language_id.pieces(text))), minlength=language_id.N_BUCKETS)
    assert abs(int(parts.sum()) - int(whole.sum())) <= 0.01 * whole.sum()


def jumped(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    draw = random.Random(3)
    keys = [draw.getrandbits(64) for _ in range(3000)]
    for n in (1, 2, 24, 25):
        assert sharding.jump(np.array(keys, dtype=np.uint64), n).tolist() == [jumped(k, n) for k in keys]


def test_shards(spark):
    got = QUERIES["op7_jump_hash_shards"](spark, MEDIUM).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").collect()}
    slots = {}
    for r in got:
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "key")
        assert r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(docs) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 0 < sum(r.grown_shard == 24 for r in got) < 0.1 * len(got)


def test_shards_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_BLOCK", 3)
    rows = [(None, "a"), (1, None), (1, "b"), (1, "b"), *[(i, "x") for i in range(50)]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("x"))
    got = sharding.shards(df, "doc_id", 4).collect()
    assert len(got) == len(rows) and len({r.shard for r in got if r.doc_id == 1}) == 1
    for shard in range(4):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shards(df.limit(0), "doc_id", 4).count() == 0
    path = scratch_path(spark, "shards")
    sharding.write_shards(df, "doc_id", 4, path, 2)
    assert spark.read.parquet(path).count() == len(rows)


def test_licences_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "x\nreleased under the mit license\n\nx"), (4, "Released under\nthe MIT License."), (4, "MIT")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("dice", F.lit("x"))).collect()
    assert sorted(((r.doc_id, r.licence, r.dice, r.n_blocks) for r in got), key=str) == [(4, "MIT", 1.0, 1), (None, "MIT", 1.0, 2)]


def test_size_bounds_lose_no_template():
    draw = random.Random(4)
    scanner = license_scan.Scanner()
    for _ in range(300):
        words = license_scan._WORD.findall(draw.choice(license_scan.TEMPLATES)[1].lower())
        for _ in range(draw.randint(0, 6)):
            words.insert(draw.randrange(len(words)), draw.choice(["x", "y", "the"]))
        made = license_scan.bigrams(" ".join(words))
        want = {n for n, b in scanner.templates if license_scan.dice(made, b) >= license_scan.LEAST}
        assert {row[0] for row in scanner.scan(" ".join(words))} == want


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = corpus_pipeline.read(spark, SMALL)
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.store(stage(spark, docs, SMALL), name)
        assert docs.columns == list(DOCUMENT_COLUMNS)
        assert 0 < docs.count() <= 2 * n
    assert corpus_pipeline.run(spark, SMALL).count() == docs.count()
    empty = corpus_pipeline.read(spark, SMALL).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0
