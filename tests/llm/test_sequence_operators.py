"""Packing, token files, media, language model."""

import io
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from helpers import SF, awkward, nothing, table
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.llm import binary, lm, media, packing
from lexloom.llm.queries import QUERIES
from lexloom.llm.tokens import WordEncoder, default_path


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


# ---- tokens ----


@lru_cache
def words_encoder():
    return WordEncoder(default_path())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aZé É'.,!?<|>#09ñß×÷İ한́-_\n\t\"st☃\x1c\x85\xa0", max_size=40))
def test_words_give_the_ids_of_the_text(text):
    enc = words_encoder()
    assert enc.encode(text).tolist() == enc.tok.encode(text, add_special_tokens=False).ids


def test_special_strings_and_generations(tok, monkeypatch):
    from lexloom.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_PIECES", 50)
    monkeypatch.setattr(tokens, "STEP", 300)
    enc = WordEncoder(default_path())
    texts = ["a<|endoftext|>b c", "<|startoftext|> x", *[f"w{i} abc{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}, the" for i in range(400)], "x" * 300]
    for text, ids in zip(texts, enc.encode_column(pa.array(texts)), strict=True):
        assert ids.tolist() == ids_of(tok, text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_tokenizers_see_whole_texts(name):
    enc = WordEncoder(default_path(name))
    assert not enc.split
    assert enc.encode("Two  words").tolist() == enc.tok.encode("Two  words", add_special_tokens=False).ids


# ---- packing ----


def check_packing(rows, texts, tok, capacity=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for doc, found in by_doc.items():
        ids = [*ids_of(tok, texts[doc]), 0]
        found.sort(key=lambda r: r.piece)
        pieces = [ids[i : i + capacity] for i in range(0, len(ids), capacity)]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in found] == [(i, i * capacity, len(p), crc(p)) for i, p in enumerate(pieces)]
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), sum(r.length for r in rows)


def test_packing_query(spark, tok):
    rows = QUERIES["op3_best_fit_packing"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    sequences, tokens = check_packing(rows, texts, tok)
    long = sum(r.length > 1024 for r in rows)
    assert sequences <= max(-(-tokens // 2048), long) * 1.02 + 1


def test_packing_awkward(spark, tok):
    docs = awkward(spark)
    rows = packing.pack_documents(docs).collect()
    twice = [r for r in rows if r.doc_id == 1]
    assert len(twice) == 2 and len({(r.sequence_id, r.offset) for r in twice}) == 2
    texts = {r.doc_id: r.text for r in docs.collect()}
    single = [r for r in rows if r.doc_id != 1] + twice[:1]
    all_ids = {d: [*ids_of(tok, t), 0] for d, t in texts.items()}
    for r in single:
        ids = all_ids[r.doc_id]
        assert r.ids_crc32 == crc(ids[r.start : r.start + r.length])
    assert {r.length for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert packing.pack_documents(nothing(spark)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_places_each_piece_once(lengths):
    runs = packing.plan_runs(Counter(lengths), 40)
    placed, fill = Counter(), defaultdict(list)
    for length, first, n, sequence, offset in runs:
        assert first == placed[length]  # numbers of a length are used in order
        placed[length] += n
        for i in range(n):
            fill[sequence + i].append((offset, length))
    assert placed == Counter(lengths)
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 40
    # First-fit decreasing never beats it by much; the bound from the total holds.
    bins: list[int] = []
    for x in sorted(lengths, reverse=True):
        i = next((i for i, b in enumerate(bins) if b + x <= 40), None)
        if i is None:
            bins.append(x)
        else:
            bins[i] += x
    assert len(fill) <= len(bins) * 1.1 + 1


def test_exact_complements_come_first():
    assert sorted((length, s) for length, _, _, s, _ in packing.plan_runs({30: 2, 10: 1, 7: 1, 3: 1}, 40)) == [(3, 1), (7, 1), (10, 0), (30, 0), (30, 1)]
    triple = packing.plan_runs({30: 1, 5: 1, 3: 1, 2: 1, 9: 1}, 40)
    assert {s for length, _, _, s, _ in triple if length in (30, 5, 3, 2)} == {0}
    many = packing.plan_runs({25: 10**12, 15: 10**12}, 40)
    assert len(many) == 2


# ---- token files ----


def test_token_files(spark, tok, tmp_path):
    docs = table(spark, "documents")
    folder = f"file://{tmp_path}/t"
    rows = binary.round_trip(docs, folder).orderBy("doc_id").collect()
    start = 0
    for r, d in zip(rows, docs.orderBy("doc_id").collect(), strict=True):
        ids = [*ids_of(tok, d.text), 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), crc(ids))
        start += len(ids)
    reader = binary.open_part(folder, 0)
    ids, mask = binary.sequence(reader, 0)
    assert len(ids) == 2048 and mask.all() and not ids.flags.owndata  # a view of the mapped file
    last = binary.sequence(reader, (reader.num_record_batches - 1) * binary.BATCH + reader.get_batch(reader.num_record_batches - 1).num_rows - 1)
    assert last[1].sum() < 2048 and (last[0][~last[1]] == 0).all()
    assert not list(tmp_path.glob("t/_*"))


def test_token_files_awkward(spark, tok, tmp_path):
    rows = binary.round_trip(awkward(spark), f"file://{tmp_path}/t").collect()
    assert len(rows) == 9 and min(rows, key=lambda r: r.start).doc_id is None
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert binary.round_trip(nothing(spark), f"file://{tmp_path}/u").count() == 0


def test_token_files_ties_and_reruns(spark, tok, tmp_path):
    """Many rows without an id, and of one id: no part holds them all, the order is that of a hash; a second run replaces files."""
    docs = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit(None)).otherwise(F.lit(7)).cast("bigint").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    folder = f"file://{tmp_path}/t"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # so little data would be one part
    first, second = (binary.write_sequences(docs, folder).orderBy("part").collect() for _ in range(2))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(max(r.docs for r in x) < 1500 and sum(r.docs for r in x) == 3000 for x in (first, second))
    rows = [tuple(r) for r in binary.read_documents(spark.createDataFrame(second), folder).orderBy("start").collect()]
    assert rows == [tuple(r) for r in binary.round_trip(docs.orderBy(F.rand(3)), f"file://{tmp_path}/u").orderBy("start").collect()]
    assert [r[0] for r in rows] == [None] * 2000 + [7] * 1000


# ---- media ----


def test_media_query(spark):
    texts = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    import hashlib

    rows = QUERIES["op4_media_columns"](spark, SF).collect()
    assert len(rows) == len(texts)
    seen = {}
    for r in rows:
        data = texts[r.doc_id].encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert seen.setdefault(data, r.feature) == r.feature
        assert r.feature == naive_feature(np.frombuffer(payload, np.uint8).reshape(-1, 64))


def naive_feature(image):
    """Hash and tile from plain means over exact areas, halves rounded up."""
    cells = np.floor(naive_resize(image, 8, 9) + 0.5 + 1e-9)
    bits = "".join("1" if a < b else "0" for row in cells for a, b in zip(row, row[1:]))
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(np.floor(naive_resize(image, 16, 16) + 0.5 + 1e-9), np.uint8))
    return f"{int(bits, 2):016x}:{zlib.crc32(out.getvalue()):08x}"


def test_long_image_memory():
    """A long image is resized in little more room than itself."""
    import tracemalloc

    image = np.zeros((1 << 18, 64), np.uint8)
    tracemalloc.start()
    media.difference_hash(image)
    media.tile_npy(image.T)
    media.grey_of(np.zeros((1 << 14, 64, 3), np.uint8))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < image.size


def naive_resize(image, height, width):
    h, w = image.shape
    fine = np.repeat(np.repeat(image.astype(float), height, 0), width, 1)
    return fine.reshape(height, h, width, w).mean((1, 3))


@pytest.mark.parametrize("small", [media.SMALL, 0])
@pytest.mark.parametrize("shape", [(1, 64), (3, 5), (17, 64), (64, 64), (9, 8), (200, 3)])
def test_area_resize(shape, small, monkeypatch):
    monkeypatch.setattr(media, "SMALL", small)
    image = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    for out in ((16, 16), (8, 9), (1, 1)):
        assert np.abs(media.area_resize(image, *out) - naive_resize(image, *out)).max() <= 0.5


def test_formats():
    rng = np.random.default_rng(2)
    grey, colour = rng.integers(0, 256, (5, 7)).astype(np.uint8), rng.integers(0, 256, (4, 3, 3)).astype(np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all() and (media.decode(media.encode_ppm(colour)) == colour).all()
    assert (media.decode(media.encode_bmp(grey)) == grey).all() and (media.decode(media.encode_bmp(colour)) == colour).all()
    assert media.decode(b"P2 # note\n2 2\n# more\n9\n1 2\n3 4").tolist() == [[1, 2], [3, 4]]
    assert media.decode(b"P3 1 1 255 7 8 9").tolist() == [[[7, 8, 9]]]
    assert media.decode(b"P1 3 1 1 0 1").tolist() == [[0, 255, 0]] == media.decode(b"P4 3 1\n\xa0").tolist()
    assert media.decode(b"P5 1 2 65535\n\x01\x02\x00\x03").tolist() == [[258], [3]]
    tile = np.load(io.BytesIO(media.tile_npy(grey)))
    assert tile.shape == (16, 16) and tile.dtype == np.uint8
    ramp = np.tile(np.arange(64, dtype=np.uint8), (64, 1))
    assert media.difference_hash(ramp) == "ff" * 8 and media.difference_hash(ramp[:, ::-1]) == "00" * 8


def test_damaged_media(spark):
    rows = [(1, media.encode_pgm(np.zeros((2, 2), np.uint8)), 5), (2, b"P5\n9 9\n255\n12", 6), (3, None, 7), (4, b"BM", 8), (5, b"", 9), (6, b"P5\n-1 2\n255\n", 1)]
    found = media.describe_media(spark.createDataFrame(rows, "id int, media binary, height int")).orderBy("id").collect()
    assert [r.error is None for r in found] == [True, False, False, False, False, False]
    assert (found[0].height, found[0].width, found[0].channels) == (2, 2, 1) and found[1].tile is None


def test_media_awkward(spark):
    rows = media.media_digests(media.store_media(media.texts_as_media(awkward(spark)))).collect()
    assert len(rows) == 9 and {r.payload_bytes for r in rows if r.doc_id in (2, 3)} == {64}
    assert media.media_digests(media.store_media(media.texts_as_media(nothing(spark)))).count() == 0


# ---- language model ----


def test_language_model(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in table(spark, "documents", sf).collect()}
    rows = QUERIES["op2_language_model"](spark, sf).collect()
    toks = {d: [*t.encode().lower().split(), b"\n"] for d, t in docs.items()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in docs}
    counts = Counter(w for d, ws in toks.items() if not held[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(docs)
    for r in rows:
        ws = toks[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(w in counts for w in ws), n)
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)
        assert r.score < 0
    better = [(r.score, r.base_score) for r in rows if r.held_out]
    assert sum(s for s, _ in better) > 0.97 * sum(b for _, b in better)  # log10: closer to 0


def test_scores_token_by_token(spark):
    """The score of each text, from the model's vectors alone: a softmax over classes and a share of the class for each token."""
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["the", "cat", "sat", "on", "mats", "hats", f"rare{i}ing", f"odd{i}"], 30)) for i in range(80)] + ["", "unheard of cats", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in lm.score_documents(docs, head=3, suffixes=2, heavy=5).collect()}
    training = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1).select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    vocabulary, k, _, model = lm.fit(training, head=3, suffixes=2, heavy=5)
    counts = {bytes(r.word): r.c for r in vocabulary.collect()}
    classes = {w: int(k.of([w])[0][0]) for w in [*counts, b"unheard", b"of", b"cats", b"\n"]}
    mass, kinds = Counter(), Counter()
    for w, c in counts.items():
        mass[classes[w]] += c
        kinds[classes[w]] += 1
    for d, text in enumerate(texts):
        total, a, b = 0.0, 0, 0  # classes of the last word and of that before it; the end stands before a text
        for w in [*(text or "").encode().split(), b"\n"]:
            c = classes.setdefault(w, int(k.of([w])[0][0]))
            logits = [float((model.r1[a] + model.r2[k.coarse[b]]) @ model.q[x] + model.b[x]) for x in range(k.size)]
            total += (logits[c] - np.log(np.sum(np.exp(logits)))) / np.log(10)
            if not k.single[c]:
                total += np.log10((counts.get(w, 0) + 0.5) / (mass[c] + 0.5 * (kinds[c] + 1)))
            a, b = c, a
        assert got[d] == pytest.approx(total, rel=1e-4), d


def test_model_outcomes_sum_to_one(spark):
    docs = spark.createDataFrame([(i, "the cat sat on the mat " * 3 + f"rare{i} word{i}x") for i in range(60)], "doc_id bigint, text string")
    training = docs.selectExpr("cast(text as binary) AS text")
    vocabulary = lm.word_counts(training)
    k = lm.choose_classes(vocabulary, head=3, suffixes=2)
    inside = np.zeros(k.size)
    for r in vocabulary.collect():
        c, _ = k.of([bytes(r.word)])
        inside[c[0]] += 1.0 if k.single[c[0]] else (r.c + 0.5) / 10 ** k.inside[c[0]]
    unseen = np.where(k.single, 0, 0.5 / 10**k.inside)  # each group's place for unseen words
    assert np.allclose(inside + unseen, 1)
    p = lm.train_nce(np.random.default_rng(0).integers(0, 5, (k.size * lm.COARSE, k.size)).astype(float)).log_probabilities()
    assert np.allclose(np.exp(p).sum(1), 1, atol=1e-5)


def test_noise_contrastive_training_finds_the_distribution():
    rng = np.random.default_rng(4)
    size = 12
    truth = rng.dirichlet(np.ones(size) * 0.5, size)
    counts = np.zeros((size * lm.COARSE, size))
    counts[::lm.COARSE] = truth * 1000
    p = np.exp(lm.train_nce(counts, steps=600).log_probabilities()[:: lm.COARSE])
    assert np.abs(p - truth).max() < 0.05


def test_classes_grow_with_the_corpus(spark):
    few = spark.range(2_000).selectExpr("cast(concat('w', id) as binary) AS word", "cast(1 + 4000 div (id + 1) as bigint) AS c")
    many = few.withColumn("c", F.col("c") * 100)
    small, large = lm.choose_classes(few), lm.choose_classes(many)
    n = few.agg(F.sum("c")).collect()[0][0]
    assert (small.n, large.n) == (n, 100 * n)
    assert int(large.single.sum()) == 1 + int(lm.HEAD * (100 * n) ** 0.25) > int(small.single.sum())


def test_training_by_blocks(spark):
    """Cells dealt to several blocks: every cell is in one of them, and the scores are near those of a single block."""
    docs = spark.createDataFrame([(i, "the cat sat on the mat and the dog lay by the door " * 4 + f"rare{i}") for i in range(100)], "doc_id bigint, text string")
    training = docs.selectExpr("cast(text as binary) AS text")
    _, k, shared, whole = lm.fit(training, head=12, suffixes=2)
    cells = lm.cell_counts(training, shared)
    expected = {r.cell: r.n for r in cells.collect()}
    blocks = list(lm.cell_blocks(lm.by_block(cells, k.size, 3), 3))
    assert len(blocks) == 3 * lm.PASSES
    found = [dict(zip(c.tolist(), n.tolist())) for c, n, _ in blocks[:3]]
    assert sum(map(len, found)) == len(expected) and {c: n for part in found for c, n in part.items()} == expected
    _, _, _, parted = lm.fit(training, head=12, suffixes=2, block=10)
    at = np.array(sorted(expected))
    weight = np.array([expected[c] for c in at.tolist()]) / sum(expected.values())
    one, other = whole.log_probabilities().ravel()[at], parted.log_probabilities().ravel()[at]
    assert (weight * one).sum() > -0.5 and abs((weight * (one - other)).sum()) < 0.1


def test_language_model_awkward(spark):
    rows = lm.score_documents(awkward(spark)).collect()
    assert len(rows) == 9 and all(r.score is not None and np.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert len({r.score for r in rows if r.doc_id == 1}) == 1
    assert lm.score_documents(nothing(spark)).count() == 0
