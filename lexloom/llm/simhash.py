"""SimHash near-dedup with a hierarchical index in Gray order.

Fingerprints: words are runs without white space, ASCII capitals folded; each word shingle is hashed (XXH64, seed 42) and
a fingerprint bit is set if it is set in over half of the hashes. Further fingerprint words come from mixes of the same
hashes.

Index: a group's fingerprints are sorted by Gray rank; runs of neighbours share many bits, which an upper node holds as
(mask, pattern), without what its parents hold already. Queries descend from the top with the differences counted so far
and leave a whole subtree where they exceed the limit. Links inside a group are reduced to a spanning forest at once, so a
group of n rows gives fewer than n links.

Two searches deal fingerprints into groups for that index:

* near_duplicates links 64-bit fingerprints that differ in at most `max_diff` bits, exactly: a fingerprint is cut into
  max_diff + 1 blocks, and two linked ones agree in at least one block. A group of more than `group_rows` is split further
  by the blocks of its remaining bits, again exactly.
* similar_documents (and keep_one) links documents whose sets of shingles have a Jaccard similarity of 0.8 or more. There
  a 64-bit fingerprint differs in ten bits on average, and the blocks of an exact search would be some four bits long, so
  that groups would grow with the corpus. Sets are dealt out by least hashes instead (BANDS keys of ROWS least hashes
  each), the index picks the candidates in a group by four fingerprint words, and the sets themselves decide each one
  exactly. A pair at 0.8 is missed with a probability of 0.002 (no common key) plus 0.0002 (too many different bits; for
  sets of less than ten shingles up to 0.03); at 0.9 both are below 1e-5.

Scale: equal fingerprints, or equal sets, are one node (combined on the map side), and hot keys never meet in one task:
tables are joined to their hot keys by a broadcast of fewer than a thousand rows. Groups of similar_documents beyond
GROUP_ROWS sets, or GROUP_SHINGLES shingles, are dealt into parts: first each part by itself (twice, by different salts),
then, only where a group still holds different components, all pairs of its parts. Nothing about all documents reaches
the driver.

Defined results: null texts are empty, a text without words has fingerprint zero and the empty set, which equals other
empty sets; a text of fewer words than a shingle is one shingle; ids are of any type that has an order, the least is that
of the type; rows with a null id take part, component_id is the smallest id that isn't null (null if there is none);
repeated rows get equal results; an empty table gives an empty result; other columns are ignored by all but keep_one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, islice, repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lexloom.llm.common import if_small, join_hot, lean, materialise, text_of
from lexloom.llm.components import connected


SEED = 42
ONES = np.uint64(0x0101010101010101)
#: Shingles hashed and counted at a time.
CHUNK = 1 << 18


# ---- fingerprints ----------------------------------------------------------------------------------------------


def shingle_hashes(data: bytes, n: int, distinct: bool = False) -> Iterator[np.ndarray]:
    """XXH64 of each n-word shingle, at most CHUNK at a time (all at once if distinct)."""
    from xxhash import xxh64_intdigest

    words = data.lower().split()
    if not words:
        return
    count = max(1, len(words) - n + 1)
    shingles = iter([b" ".join(words)]) if count == 1 else map(b" ".join, zip(*[islice(words, k, None) for k in range(n)], strict=False))
    step = count if distinct else CHUNK
    for at in range(0, count, step):
        size = min(step, count - at)
        h = np.fromiter(map(xxh64_intdigest, islice(shingles, size), repeat(SEED)), np.uint64, size)
        yield np.unique(h) if distinct else h


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of a hash (k = 0: itself): a bijective mix of 64 bits."""
    if k == 0:
        return h
    z = h + np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def bit_counts(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, for the segments of h that begin at `starts` (none empty)."""
    ends = np.append(starts[1:], len(h))
    pieces = (ends - starts + 254) // 255  # a byte counts to 255
    owner = np.repeat(np.arange(len(starts)), pieces)
    first = np.cumsum(pieces) - pieces
    cuts = starts[owner] + (np.arange(len(owner)) - first[owner]) * 255
    out = np.empty((len(starts), 64), dtype=np.int64)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & ONES, cuts)
        out[:, k::8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    return out


def _majority(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    bits = (counts * 2 > sizes[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints_of(texts: list[bytes], n: int) -> np.ndarray:
    """The 64-bit fingerprint of each text (repeated shingles count), as uint64."""
    out = np.zeros(len(texts), dtype=np.uint64)
    held: list[np.ndarray] = []
    rows: list[int] = []
    size = 0

    def flush():
        nonlocal held, rows, size
        if rows:
            sizes = np.array([len(x) for x in held])
            out[rows] = _majority(bit_counts(np.concatenate(held), np.cumsum(sizes) - sizes), sizes)
        held, rows, size = [], [], 0

    for i, data in enumerate(texts):
        parts = shingle_hashes(data, n)
        h = next(parts, None)
        if h is None:
            continue
        more = next(parts, None)
        if more is None:
            held.append(h)
            rows.append(i)
            size += len(h)
            if size >= CHUNK:
                flush()
        else:  # a very long text: counts are summed chunk by chunk
            total, counts = 0, np.zeros((1, 64), dtype=np.int64)
            for part in chain((h, more), parts):
                total += len(part)
                counts += bit_counts(part, np.zeros(1, dtype=np.int64))
            out[i] = _majority(counts, np.array([total]))[0]
    flush()
    return out


def fingerprints(docs: DataFrame, n: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, f0 (long): one row per row of docs."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).cast("binary").alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            f = fingerprints_of([x.as_py() for x in batch.column(1)], n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f.view(np.int64))], names=["doc_id", "f0"])

    return rows.mapInArrow(lean(run), StructType([rows.schema["doc_id"], StructField("f0", LongType())]))


# ---- the hierarchical index ------------------------------------------------------------------------------------


def gray_rank(v: np.ndarray) -> np.ndarray:
    """The place of a bit pattern in the reflected Gray sequence; neighbours there differ in one bit."""
    v = v.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        v ^= v >> np.uint64(shift)
    return v


LEAF, FAN = 64, 16


class GrayIndex:
    """Fingerprints in Gray order; each level's nodes hold the bits that all below them share, beyond what their parents hold."""

    def __init__(self, values: np.ndarray):
        """values: uint64, already sorted by gray_rank."""
        self.values = values
        shared_mask, shared = self._agree(values, np.full(len(values), ~np.uint64(0)), LEAF)
        levels = [(shared_mask, shared)]
        while len(levels[-1][0]) > 1:
            levels.append(self._agree(levels[-1][1], levels[-1][0], FAN))
        self.levels = []  # from the top: own mask, pattern
        for depth in range(len(levels) - 1, -1, -1):
            mask, pattern = levels[depth]
            above = levels[depth + 1][0][np.arange(len(mask)) // FAN] if depth + 1 < len(levels) else np.zeros(len(mask), dtype=np.uint64)
            self.levels.append((mask & ~above, pattern))
        self.leaf_mask = levels[0][0]

    @staticmethod
    def _agree(patterns: np.ndarray, masks: np.ndarray, fan: int) -> tuple[np.ndarray, np.ndarray]:
        starts = np.arange(0, len(patterns), fan)
        first = np.repeat(patterns[starts], np.diff(np.append(starts, len(patterns))))
        mask = np.bitwise_and.reduceat(masks, starts) & ~np.bitwise_or.reduceat(patterns ^ first, starts)
        return mask, patterns[starts] & mask

    def links(self, max_diff: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j), i < j, of positions whose values differ in at most max_diff bits."""
        n = len(self.values)
        stack = [(0, 0, np.arange(n), np.zeros(n, dtype=np.uint8))]
        while stack:
            level, node, queries, so_far = stack.pop()
            mask, pattern = self.levels[level]
            diff = so_far + np.bitwise_count((self.values[queries] ^ pattern[node]) & mask[node])
            alive = diff <= max_diff
            queries, diff = queries[alive], diff[alive]
            if not len(queries):
                continue
            if level + 1 < len(self.levels):
                width = LEAF * FAN ** (len(self.levels) - 2 - level)  # values below a child
                last = min((node + 1) * FAN, len(self.levels[level + 1][0]))
                for child in range(node * FAN, last):
                    upto = np.searchsorted(queries, min(n, (child + 1) * width))  # only queries before the child's last value
                    if upto:
                        stack.append((level + 1, child, queries[:upto], diff[:upto]))
                continue
            members = np.arange(node * LEAF, min(n, (node + 1) * LEAF))
            rest = ~self.leaf_mask[node]
            own = self.values[members] & rest
            for at in range(0, len(queries), 8192):
                q = queries[at : at + 8192]
                near = np.bitwise_count((self.values[q] & rest)[:, None] ^ own) + diff[at : at + 8192, None] <= max_diff
                a, b = np.nonzero(near)
                a, b = q[a], members[b]
                keep = a < b
                if keep.any():
                    yield a[keep], b[keep]


def merge_links(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Components after adding links; label holds, for each position, a smaller or equal position of its component (a root's own)."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def group_links(values: np.ndarray, max_diff: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (member, root) of the links among distinct fingerprints."""
    values = values[np.argsort(gray_rank(values))]
    label = np.arange(len(values))
    for a, b in GrayIndex(values).links(max_diff):
        label = merge_links(label, a, b)
    member = np.flatnonzero(label != np.arange(len(values)))
    return values[member], values[label[member]]


# ---- fingerprints that differ in a few bits --------------------------------------------------------------------


def _blocks(bits: list[int], parts: int) -> list[int]:
    """Masks of `parts` blocks of the given bit places."""
    cut = np.array_split(np.array(bits), parts)
    return [sum(1 << int(b) for b in c) for c in cut if len(c)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _keys(masks: dict[int, int]) -> Column:
    """(path, key) of each group that a fingerprint belongs to: which bits its rows share, and those bits."""
    return F.explode(F.array(*[F.struct(F.lit(i).alias("path"), F.xxhash64(F.lit(str(m)), F.col("f0").bitwiseAND(F.lit(_signed(m)))).alias("key")) for i, m in masks.items()]))


def _children(mask: int, max_diff: int) -> list[int]:
    """Masks of finer groups that together hold every link of this one: with one of max_diff + 1 blocks of the remaining bits."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | m for m in _blocks(free, max_diff + 1)]


def near_links(nodes: DataFrame, max_diff: int = 2, group_rows: int = 1 << 16) -> DataFrame:
    """nodes: f0 (distinct). Links u, v (fingerprints as long) that connect exactly what differs in at most max_diff bits."""
    names = dict(enumerate(_children(0, max_diff)))
    spread = lambda rows, masks: rows.select("f0", _keys(masks).alias("e")).select("f0", "e.path", "e.key")
    entries, found = spread(nodes, names), []
    while True:
        hot = entries.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows).select("path", "key")
        splits = {i: _children(names[i], max_diff) for i in sorted(r["path"] for r in hot.select("path").distinct().collect())}  # at most one row per path
        splits = {i: c for i, c in splits.items() if c}
        if not splits:
            found.append(_search(entries, max_diff))
            break
        hot = hot.where(F.col("path").isin(list(splits)))
        found.append(_search(entries.join(hot, ["path", "key"], "left_anti"), max_diff))
        inside = entries.join(hot, ["path", "key"], "left_semi")
        finer, names = [], {}
        for i, masks in splits.items():
            own = {len(names) + k: m for k, m in enumerate(masks)}
            names |= own
            finer.append(spread(inside.where(F.col("path") == i), own))
        entries = materialise(reduce(DataFrame.unionByName, finer), "finer")
    return reduce(DataFrame.unionByName, found)


def _whole_groups(batches: Iterator) -> Iterator[np.ndarray]:
    """Rows of long columns, sorted by the first one, as blocks that hold all rows of their keys."""
    held: list[np.ndarray] = []
    for batch in batches:
        block = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if not len(block):
            continue
        held.append(block)
        if held[0][0, 0] != block[-1, 0]:
            joined = np.concatenate(held)
            last = np.searchsorted(joined[:, 0], joined[-1, 0], side="left")  # the last group may go on
            yield joined[:last]
            held = [joined[last:]]
    if held:
        yield np.concatenate(held)


def _several(block: np.ndarray) -> Iterator[np.ndarray]:
    """The groups of two and more rows in a block."""
    cuts = np.flatnonzero(np.diff(block[:, 0])) + 1
    starts, ends = np.append(0, cuts), np.append(cuts, len(block))
    several = ends - starts > 1
    for a, b in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
        yield block[a:b]


def _search(entries: DataFrame, max_diff: int) -> DataFrame:
    """Deal entries out by group and index each group."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in zip(*found, strict=True)], names=["u", "v"])

        for block in _whole_groups(batches):
            found, held = [], 0
            for part in _several(block):
                found.append(group_links(part[:, 1].copy().view(np.uint64), max_diff))
                held += len(found[-1][0])
                if held > 1 << 18:
                    yield out(found)
                    found, held = [], 0
            if held:
                yield out(found)

    return entries.select("key", "f0").repartition("key").sortWithinPartitions("key").mapInArrow(lean(run), "u bigint, v bigint")


def components(prints: DataFrame, max_diff: int = 2, group_rows: int = 1 << 16) -> DataFrame:
    """prints: doc_id, f0. Adds component_id (of the id's type). Nodes are the fingerprints themselves, whatever the ids are."""
    nodes = materialise(prints.groupBy("f0").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes", rows=prints.count())
    n_nodes = nodes.count()
    roots = connected(near_links(nodes.select("f0"), max_diff, group_rows), 3 * n_nodes)
    marked = nodes.join(roots, nodes["f0"] == roots["u"], "left").select("f0", "least", "n", F.coalesce("v", "f0").alias("root"))
    marked = materialise(marked, "marked", rows=n_nodes)
    found = marked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    named = materialise(join_hot(marked.select("f0", "n", "root"), found, "root", "members", n_nodes), "named", rows=n_nodes)
    return join_hot(prints, named.select("f0", "n", "component_id"), "f0", "n", prints.count()).select("doc_id", "f0", "component_id")


def near_duplicates(docs: DataFrame, n: int = 3, max_diff: int = 2, doc_id: str = "doc_id", text: str = "text", group_rows: int = 1 << 16) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: documents linked by 64-bit fingerprints at most max_diff bits apart."""
    prints = materialise(fingerprints(docs, n, doc_id, text), "prints")
    found = components(prints, max_diff, group_rows)
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


# ---- sets of shingles that agree by 0.8 ------------------------------------------------------------------------


#: Keys of a set, and least hashes in each: two sets share a key with a probability of 1 - (1 - s**4)**12 at similarity s.
BANDS, ROWS = 12, 4
#: Keys of the first search, which joins most of what is alike, so that the second one has little left to compare.
FIRST_BANDS = 3
#: Fingerprint words; candidates differ in at most so many bits of the first and of all words. At s = 0.8 a bit differs
#: with a probability of acos(2s / (1 + s)) / pi = 0.15: in 10 of 64 (deviation 3) and 39 of 256 (deviation 6).
WORDS, FIRST_DIFF, TOTAL_DIFF = 4, 24, 60
SIMILAR = 0.8
#: Sets, and shingles in them, that one task compares as a group.
GROUP_ROWS, GROUP_SHINGLES = 1 << 13, 1 << 22
PRINTS = [f"f{k}" for k in range(WORDS)]
#: A node's row, with its keys, counts as so many narrow rows.
WIDE = 8


def _odd_numbers() -> np.ndarray:
    """An odd factor for each least hash."""
    return np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


FACTORS = _odd_numbers()


def sketches_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint words (len(sets) x WORDS, uint64) and keys (len(sets) x BANDS, int64) of sets of hashes."""
    prints = np.zeros((len(sets), WORDS), dtype=np.uint64)
    least = np.full((len(sets), BANDS * ROWS), ~np.uint64(0))

    def count(h: np.ndarray, starts: np.ndarray, rows) -> np.ndarray:
        for k, factor in enumerate(FACTORS):
            least[rows, k] = np.minimum(least[rows, k], np.minimum.reduceat(h * factor, starts))
        return np.stack([bit_counts(mixed(h, k), starts) for k in range(WORDS)])

    def flush(rows: list[int]) -> None:
        if rows:
            sizes = np.array([len(sets[i]) for i in rows])
            counts = count(np.concatenate([sets[i] for i in rows]), np.cumsum(sizes) - sizes, rows)
            for k in range(WORDS):
                prints[rows, k] = _majority(counts[k], sizes)

    rows, size = [], 0
    for i, h in enumerate(sets):
        if len(h) > CHUNK:  # a very long text by itself, some hashes at a time
            counts = sum(count(h[at : at + CHUNK], np.zeros(1, dtype=np.int64), [i]) for at in range(0, len(h), CHUNK))
            prints[i] = [_majority(c, np.array([len(h)]))[0] for c in counts]
        elif len(h):
            rows.append(i)
            size += len(h)
            if size >= CHUNK:
                flush(rows)
                rows, size = [], 0
    flush(rows)
    keys = np.empty((len(sets), BANDS), dtype=np.uint64)
    for t in range(BANDS):
        key = np.full(len(sets), t + 1, dtype=np.uint64)
        for k in range(t * ROWS, (t + 1) * ROWS):
            key = mixed(key * FACTORS[0] + least[:, k], 1)
        keys[:, t] = key
    return prints, keys.view(np.int64)


def shingle_set(data: bytes, n: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    return next(shingle_hashes(data, n, True), np.zeros(0, dtype=np.uint64))


def sketches(rows: DataFrame, n: int) -> DataFrame:
    """rows: doc_id, h (long), text (binary). doc_id, h, d1 and d2 (a digest of the set), size, f0 .. , keys (array)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle_set(x.as_py(), n) for x in part.column(2)]
                digests = np.frombuffer(b"".join(xxh3_128_digest(x.tobytes()) for x in sets), "<i8").reshape(-1, 2)
                prints, keys = sketches_of(sets)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
                columns = [digests[:, 0].copy(), digests[:, 1].copy(), np.array([len(x) for x in sets], dtype=np.int64), *[prints[:, k].copy().view(np.int64) for k in range(WORDS)]]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *map(pa.array, columns), flat], names=["doc_id", "h", "d1", "d2", "size", *PRINTS, "keys"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"doc_id {kind}, h bigint, d1 bigint, d2 bigint, size bigint, {', '.join(f'{f} bigint' for f in PRINTS)}, keys array<bigint>")


def candidates(nodes: np.ndarray, prints: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (a, b) of places in a group whose fingerprints and sizes allow a similarity of SIMILAR, and their different bits.
    Rows must be in Gray order of their first word."""
    for a, b in GrayIndex(prints[:, 0]).links(FIRST_DIFF):
        small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
        keep = (small >= SIMILAR * large - 1e-9) & (nodes[a] != nodes[b])
        a, b = a[keep], b[keep]
        diff = np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1, dtype=np.int64)
        keep = diff <= TOTAL_DIFF
        if keep.any():
            yield a[keep], b[keep], diff[keep]


def _in_order(part: np.ndarray) -> np.ndarray:
    """A group's rows (key, node, known, size, f0 ..) in Gray order."""
    return part[np.lexsort((part[:, 1], gray_rank(part[:, 4].copy().view(np.uint64))))]


def _columns(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """node, known, size and the fingerprint words (uint64) of rows."""
    return part[:, 1], part[:, 2], part[:, 3], np.ascontiguousarray(part[:, 4 : 4 + WORDS]).view(np.uint64)


ENTRY = ["key", "node", "known", "size", *PRINTS]


def to_compare(entries: DataFrame) -> DataFrame:
    """Of dealt entries, those that have a candidate of another component in their group."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for block in _whole_groups(batches):
            found = []
            for part in _several(block):
                if (part[:, 2] == part[0, 2]).all():
                    continue
                part = _in_order(part)
                node, known, size, prints = _columns(part)
                has = np.zeros(len(part), dtype=bool)
                for a, b, _ in candidates(node, prints, size):
                    other = known[a] != known[b]
                    has[a[other]] = has[b[other]] = True
                if has.any():
                    found.append(part[has])
            if found:
                rows = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, k].copy()) for k in range(len(ENTRY))], names=ENTRY)

    return entries.select(*ENTRY).repartition("key").sortWithinPartitions("key").mapInArrow(lean(run), ", ".join(f"{c} bigint" for c in ENTRY))


def similar_links(part: np.ndarray, sets: list[np.ndarray], least: float = SIMILAR) -> list[tuple[int, int]]:
    """Links between nodes of a group that join its components (known so far) wherever two sets agree by `least`, checked exactly."""
    order = np.lexsort((part[:, 1], gray_rank(part[:, 4].copy().view(np.uint64))))
    part, sets = part[order], [sets[i] for i in order.tolist()]
    node, known, size, prints = _columns(part)
    first, inverse = np.unique(known, return_index=True, return_inverse=True)[1:]
    label = first[inverse]  # the first place of its component
    found = []
    for a, b, diff in candidates(node, prints, size):
        order = np.argsort(diff, kind="stable")  # the closest ones join most
        a, b = a[order], b[order]
        for at in range(0, len(a), 256):
            x, y = a[at : at + 256], b[at : at + 256]
            for i in np.flatnonzero(label[x] != label[y]).tolist():
                p, q = label[x[i]], label[y[i]]
                if p == q:
                    continue
                s, t = sets[x[i]], sets[y[i]]
                shared = len(np.intersect1d(s, t, assume_unique=True))
                if shared >= least * (len(s) + len(t) - shared) - 1e-9:
                    found.append((int(node[x[i]]), int(node[y[i]])))
                    label[label == max(p, q)] = min(p, q)
    return found


def compare_sets(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """entries: of to_compare; sets: node, s (binary). Links u, v of nodes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def links(held: list) -> Iterator:
            rows = np.concatenate([np.column_stack([c.to_numpy(zero_copy_only=False) for c in x.columns[: len(ENTRY)]]) for x in held])
            found = similar_links(rows, [np.frombuffer(s.as_buffer(), np.uint64) for x in held for s in x.column(len(ENTRY))])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

        held, now = [], None
        for batch in batches:
            keys = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    if held and keys[a] != now:
                        yield from links(held)
                        held = []
                    held.append(batch.slice(a, b - a))
                    now = keys[a]
        if held:
            yield from links(held)

    return entries.join(sets, "node").select(*ENTRY, "s").repartition("key").sortWithinPartitions("key").mapInArrow(lean(run), "u bigint, v bigint")


def _dealt(nodes: DataFrame, bands: int, salt: int, pairs: bool, group_rows: int, group_shingles: int) -> DataFrame | None:
    """Entries of nodes in their groups. Groups beyond the limits are dealt into parts; with `pairs`, only those that hold
    several components are given, with every pair of parts as a group (None if there are none)."""
    entries = nodes.select(F.explode(F.slice("keys", 1, bands)).alias("key"), *ENTRY[1:])
    parts = F.ceil(F.greatest(F.col("n") * 2 / group_rows, F.col("shingles") * 2 / group_shingles)).cast("int")
    groups = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"), (F.min("known") != F.max("known")).alias("mixed"))
    over = (F.col("n") > group_rows) | (F.col("shingles") > group_shingles) & (F.col("n") > 1)
    large = groups.where(over).select("key", "n", "mixed", parts.alias("parts"))
    if large.isEmpty():
        return None if pairs else entries
    large = materialise(large, "large")
    hot = large.where("mixed").drop("mixed")
    total = hot.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    if pairs and not total:
        return None
    split = join_hot(entries, hot, "key", "n", total).withColumn("__ll_p", F.pmod(F.xxhash64(F.lit(salt), "key", "node"), "parts").cast("int"))
    if pairs:
        split = split.withColumn("__ll_q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return split.withColumn("key", F.xxhash64("key", F.least("__ll_p", "__ll_q"), F.greatest("__ll_p", "__ll_q"))).select(*ENTRY)
    split = split.withColumn("key", F.xxhash64("key", "__ll_p")).select(*ENTRY)
    # Large groups of one component have nothing left to compare. A large group has group_rows rows or group_shingles
    # shingles at least, so their keys are few; beyond some thousands they are joined by a shuffle.
    return entries.join(if_small(large.select("key")), "key", "left_anti").select(*ENTRY).unionByName(split)


def similar_nodes(rows: DataFrame, n: int = 5, group_rows: int = GROUP_ROWS, group_shingles: int = GROUP_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """rows: doc_id, h (long, of the text), text (binary). The sketches of all rows, and the nodes (d1, d2, n rows, root, and
    least: the smallest (no id?, doc_id, h) of its rows); nodes of one root are linked."""
    prints = materialise(sketches(rows, n), "prints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("least")
    same = [F.first(c).alias(c) for c in ("size", *PRINTS, "keys")]  # equal sets have equal sketches
    nodes = prints.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), least, *same)
    # Numbers are written once and so stay fixed.
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes", rows=WIDE * prints.count())
    n_nodes = nodes.count()
    marked, roots = nodes.withColumn("known", F.col("node")), None
    for salt, (bands, pairs) in enumerate(((FIRST_BANDS, False), (BANDS, False), (BANDS, True))):
        entries = _dealt(marked, bands, salt, pairs, group_rows, group_shingles)
        if entries is None:
            continue
        near = materialise(to_compare(entries), "near", rows=bands * n_nodes)
        n_near = near.count()
        wanted = if_small(near.select("node").distinct().join(nodes.select("node", F.col("least.doc_id").alias("i"), F.col("least.h").alias("k")), "node"))
        texts = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["i"]) & (rows["h"] == wanted["k"])).groupBy("node").agg(F.first("text").alias("text"))
        links = compare_sets(near, sets_of(texts, n))
        roots = connected(links if roots is None else roots.unionByName(links), n_near + (roots.count() if roots is not None else 0))
        marked = materialise(nodes.join(roots, nodes["node"] == roots["u"], "left").select(nodes["*"], F.coalesce("v", "node").alias("known")), "marked", rows=WIDE * n_nodes)
    return prints, marked.withColumnRenamed("known", "root")


def sets_of(texts: DataFrame, n: int) -> DataFrame:
    """texts: node, text. node, s (binary: the shingle set's hashes)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(x.as_py(), n).tobytes() for x in part.column(1)], pa.binary())], names=["node", "s"])

    return texts.select("node", "text").mapInArrow(lean(run), "node bigint, s binary")


def _classes(docs: DataFrame, n: int, doc_id: str, text: str, **limits) -> tuple[DataFrame, DataFrame, int]:
    """Sketches (doc_id, h, d1, d2), and per distinct set: d1, d2, n (rows), members (sets in its component) and best (the
    least of all these rows); the number of rows."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_of(text)).alias("h"), text_of(text).cast("binary").alias("text"))
    prints, nodes = similar_nodes(rows, n, **limits)
    n_nodes = nodes.count()
    best = nodes.groupBy("root").agg(F.min("least").alias("best"), F.count(F.lit(1)).alias("members"))
    classes = join_hot(nodes.select("root", "d1", "d2", "n"), best, "root", "members", n_nodes)
    return prints.select("doc_id", "h", "d1", "d2"), materialise(classes, "classes", rows=n_nodes), prints.count()


def similar_documents(docs: DataFrame, n: int = 5, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """doc_id, component_id: documents whose sets of n-word shingles have a Jaccard similarity of 0.8 or more, chained."""
    prints, classes, n_rows = _classes(docs, n, doc_id, text, **limits)
    return join_hot(prints, classes, ["d1", "d2"], "n", n_rows).select("doc_id", F.col("best.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """docs without near copies: of each group one row stays (all its columns), that with the smallest id; rows without an id
    come after all others, and among rows of one id the hash of the text decides. Rows that repeat both id and text are one
    document, of which any row stays."""
    prints, classes, n_rows = _classes(docs, n, doc_id, text, **limits)
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    several = classes.where("n > 1 or members > 1").select("d1", "d2", "n", "best")
    gone = join_hot(prints, several, ["d1", "d2"], "n", n_rows).where(~own.eqNullSafe(F.col("best"))).select("doc_id", "h").distinct()
    again = prints.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("__ll_n")).where("__ll_n > 1").drop("__ll_n")
    rows = docs.withColumn("__ll_h", F.xxhash64(text_of(text)))

    def among(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = if_small(keys.select(F.col("doc_id").alias("__ll_i"), F.col("h").alias("__ll_k")))
        return rows.join(keys, rows[doc_id].eqNullSafe(F.col("__ll_i")) & (F.col("__ll_h") == F.col("__ll_k")), how)

    kept = among(rows, materialise(gone, "gone", rows=n_rows), "left_anti")
    if not again.isEmpty():
        again = materialise(again, "again", rows=n_rows)
        kept = among(kept, again, "left_anti").unionByName(among(kept, again, "left_semi").dropDuplicates([doc_id, "__ll_h"]))
    return kept.drop("__ll_h")
