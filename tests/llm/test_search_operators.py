"""SimHash groups, connected components, nearest neighbours."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from helpers import SF, awkward, nothing, table
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import components, neighbours, simhash
from lexloom.llm.queries import QUERIES

# ---- SimHash ----


def plain_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    """nodes -> smallest node reachable."""
    label = {x: x for x in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in combinations(sorted(nodes), 2):
        if linked(a, b):
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def test_simhash_query(spark):
    texts = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    want = plain_components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    rows = QUERIES["op8_simhash_groups"](spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{prints[d]:016x}", want[d]) for d in texts}


def test_long_texts_are_counted_in_chunks(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n)) for n in (0, 1, 2, 3, 300, 5000)]
    want = [plain_fingerprint(t) for t in texts]
    for chunk in (7, 256, 1 << 18):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        assert simhash.fingerprints_of([t.encode() for t in texts], 3).tolist() == want


def clustered(n, seed, width=64):
    """Fingerprints with near neighbours, far ones, and many equal high bits."""
    rng = random.Random(seed)
    out = set()
    centres = [rng.getrandbits(width) for _ in range(max(1, n // 20))]
    while len(out) < n:
        v = rng.choice(centres)
        for _ in range(rng.choice((0, 1, 2, 3, 4, 9))):
            v ^= 1 << rng.randrange(width)
        out.add(v)
    return sorted(out)


@pytest.mark.parametrize(("n", "diff"), [(3, 2), (70, 2), (1500, 2), (1500, 4), (3000, 1)])
def test_gray_index_finds_all_pairs(n, diff):
    v = np.array(clustered(n, n + diff), dtype=np.uint64)
    v = v[np.argsort(simhash.gray_rank(v))]
    found = {(int(a), int(b)) for x, y in simhash.GrayIndex(v).links(diff) for a, b in zip(x, y, strict=True)}
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= diff
    assert found == {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=40, unique=True))
def test_gray_rank_orders_neighbours(values):
    v = np.array(values, dtype=np.uint64)
    rank = simhash.gray_rank(v)
    assert (rank ^ (rank >> np.uint64(1)) == v).all()


@pytest.mark.parametrize("group_rows", [12, 50, 1 << 16])
def test_hot_groups_are_split_without_losing_links(spark, group_rows):
    prints = clustered(400, 9)
    prints += [(0xABCDEF << 40) | x for x in range(0, 600, 2)]  # one block value shared by many
    prints = sorted(set(prints))
    rows = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "doc_id bigint, f0 bigint")
    want = plain_components(range(len(prints)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = simhash.components(rows, group_rows=group_rows).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_simhash_awkward(spark):
    rows = simhash.near_duplicates(awkward(spark)).collect()
    assert len(rows) == 9
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert by[2] == by[3] == by[4] == {("0" * 16, 2)} and all(len(x) == 1 for x in by.values())
    lone = spark.createDataFrame([(None, "some words that stand alone here"), (None, "some words that stand alone here")], "doc_id bigint, text string")
    assert {r.component_id for r in simhash.near_duplicates(lone).collect()} == {None}
    assert simhash.near_duplicates(nothing(spark)).count() == 0
    assert simhash.keep_one(nothing(spark)).count() == 0
    kept = simhash.keep_one(awkward(spark)).collect()
    assert len(kept) == 6 and kept[0].asDict().keys() == awkward(spark).first().asDict().keys()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 2, 5, 6, 7]


def shingles(text, n=5):
    w = text.lower().split()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def test_similar_documents_against_jaccard(spark):
    """Planted copies with words changed: links at 0.85 and more are found, none below 0.7."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts, pairs = [], []
    for _ in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 400))]
        texts.append(" ".join(words))
        changed = list(words)
        for _ in range(rng.randint(0, max(1, len(words) // 40))):
            changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
        pairs.append((len(texts) - 1, len(texts)))
        texts.append(" ".join(changed))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    sets = [shingles(t) for t in texts]
    near = [(a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a, b in pairs]
    high = [got[a] == got[b] for a, b, s in near if s >= 0.85]
    assert sum(high) >= 0.97 * len(high) and len(high) > 40
    assert not any(got[a] == got[b] for a, b, s in near if s < 0.65)
    assert all(got[a] in (a, a - 1) for a in got)


def test_similar_documents_are_exact(spark):
    """Pairs close to the limit: those at 0.8 and more are linked, those below aren't; so are the large groups of one template."""
    rng = random.Random(12)
    texts, pairs = [], []
    for k in range(400):
        words = [f"w{rng.randrange(10**6)}" for _ in range(124)]  # 120 shingles
        changed = list(words)
        for at in range(2, 2 + k % 8 * 1 * 5, 5):
            changed[at] = "other"
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(words), " ".join(changed)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    sets = [shingles(t) for t in texts]
    near = [(got[a] == got[b], len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a, b in pairs]
    at_limit = [x for x, s in near if 0.8 <= s < 0.86]
    assert not any(x for x, s in near if s < 0.8) and sum(s < 0.8 for _, s in near) >= 150
    assert len(at_limit) >= 50 and sum(at_limit) >= 0.97 * len(at_limit) and all(x for x, s in near if s > 0.9)


def test_large_ids_and_rows_of_one_id(spark):
    """Ids over the whole long range; rows that share an id but not a text are documents of their own."""
    text = " ".join(f"word{i}" for i in range(40))
    other = " ".join(f"other{i}" for i in range(40))
    big = 1 << 62
    docs = spark.createDataFrame([(big + 6, text), (big + 5, text), (-big, other), (1, other + " a"), (None, text)], "doc_id bigint, text string")
    rows = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs.where("doc_id > 1")).collect()}
    assert rows == {(big + 6, big + 5), (big + 5, big + 5)}
    assert {(r.doc_id, r.component_id) for r in simhash.similar_documents(docs).collect()} == {(big + 6, big + 5), (big + 5, big + 5), (None, big + 5), (-big, -big), (1, -big)}
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == {big + 5, -big}
    same = spark.createDataFrame([(1, text, 1), (1, other, 2), (1, other, 3), (None, text, 4)], "doc_id bigint, text string, k int")
    assert sorted(r.text for r in simhash.keep_one(same).collect()) == sorted([text, other])
    named = spark.createDataFrame([("b", text), ("a", text), (None, other), (None, other)], "doc_id string, text string")
    assert sorted((r.doc_id or "") for r in simhash.keep_one(named).collect()) == ["", "a"]
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(named).collect()} == {("a", "a"), ("b", "a"), (None, None)}


@pytest.mark.parametrize("limits", [{}, {"group_rows": 8}, {"group_shingles": 1500}])
def test_split_groups_lose_no_links(spark, limits):
    """One large group of near copies, in parts of some rows: the same components as without parts."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(124)]
    texts = []
    for k in range(70):
        words = list(base)
        for _ in range(k % 7):
            words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [shingles(t) for t in texts]
    want = plain_components(range(len(texts)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs, **limits).collect()}
    assert got == want and len(set(want.values())) > 1


# ---- components ----


@pytest.mark.parametrize("seed", range(3))
def test_connected(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(300)] + [(5000, 5000 + i) for i in range(200)] + [(7, 7)]
    got = {r.u: r.v for r in components.connected(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    nodes = {x for e in edges for x in e}
    links = {frozenset(e) for e in edges}
    want = plain_components(nodes, lambda a, b: frozenset((a, b)) in links)
    assert got == {x: y for x, y in want.items() if x != y}


def test_no_links(spark):
    assert components.connected(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# ---- neighbours ----


def exact(ids, x, every=20, k=20):
    out = {}
    for i in np.flatnonzero(np.array(ids) % every == 0):
        score = (x * x[i]).sum(1)
        found = sorted(((-s, j) for j, s in zip(ids, score, strict=True) if j != ids[i]))[:k]
        out[ids[i]] = [(j, -s) for s, j in found]
    return out


def vectors(spark, sf):
    rows = table(spark, "embeddings", sf).orderBy("vec_id").collect()
    return [r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=np.float64)


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [(j, s) for _, j, s in sorted(v)] for q, v in out.items() if [x[0] for x in sorted(v)] == list(range(1, len(v) + 1))}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_recall(spark, sf):
    ids, x = vectors(spark, sf)
    want, got = exact(ids, x), answers(QUERIES["op9_nearest_vectors"](spark, sf))
    assert set(got) == set(want)
    hits = total = 0
    for q, found in got.items():
        true = dict(want[q])
        assert len(found) == len(true)
        total += len(true)
        hits += sum(j in true for j, _ in found)
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))
        at = ids.index(q)
        for j, s in found:
            assert s == pytest.approx(float((x[ids.index(j)] * x[at]).sum()), abs=1e-12)
    assert hits / total >= 0.9


def test_whole_share_is_exact_and_norms_count(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 8)) * rng.uniform(0.2, 3, (900, 1))
    x[100:400] = x[50]  # equal vectors: ties go to the smaller id
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = answers(neighbours.nearest(docs, share=2.0, leaf_rows=16, bucket_rows=64))
    want = exact(list(range(900)), x)
    assert {q: [j for j, _ in v] for q, v in got.items()} == {q: [j for j, _ in v] for q, v in want.items()}


def test_neighbours_awkward(spark):
    rows = [(0, [1.0, 0.0], 1), (20, [0.9, 0.1], 2), (40, None, 3), (60, [0.0, 0.0], 4), (80, [float("nan"), 1.0], 5), (100, [None, 1.0], 6), (120, [1.0], 7), (None, [1.0, 1.0], 8), (3, [0.5, 0.5], None), (3, [0.5, 0.5], None), (140, [], 1)]
    got = answers(neighbours.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int")))
    assert {q: [j for j, _ in v] for q, v in got.items()} == {0: [20, 3], 20: [0, 3]}
    assert neighbours.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(0, [1.0])], "vec_id bigint, embedding array<float>")).count() == 0


@pytest.mark.parametrize("spread", [0.0, 1e-3])
@pytest.mark.parametrize("leaf_rows", [16, 256])
def test_repeated_ids_take_one_place(spark, spread, leaf_rows):
    """One id on 60 rows near the query, equal ones or not: 20 other ids come back all the same."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 8))
    x[1] = 1.2 * x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1, (x[1] + spread * rng.normal(size=8)).tolist()) for _ in range(60)]
    got = answers(neighbours.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), share=2.0, leaf_rows=leaf_rows, bucket_rows=32))
    assert set(got) == set(range(0, 200, 20))
    every = np.array([v for _, v in rows])
    for q, found in got.items():
        score = {}
        for (i, _), s in zip(rows, every @ x[q], strict=True):
            score[i] = max(s, score.get(i, -np.inf))
        del score[q]
        assert [j for j, _ in found] == sorted(score, key=lambda j: (-score[j], j))[:20]
