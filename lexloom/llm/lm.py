"""Language-model scoring: a log-bilinear neural model, trained in numpy by noise-contrastive estimation.

Words fall into classes: each of the most frequent words is one of its own, the others are grouped by their last three
bytes. The model predicts the class of the next word from the class of the word before and a coarse class of the one
before that: score(context, w) = (r1[a] + r2[t]) . q[w] + b[w]. A word's probability is its class's, normalised over all
classes, times its smoothed share of the class, with one place in each class for unseen words; so all outcomes sum to 1.

The number of classes grows with the corpus: HEAD single words and SUFFIXES groups for each unit of the fourth root of its
tokens. Training uses every training text: tasks count (context, class) cells and Spark sums them. The driver draws text
positions evenly from these counts, and noise classes from the class frequencies, and follows the noise-contrastive
objective of k noise words per position in minibatches, by matrix products. It holds one block of at most BLOCK cells at a
time; contexts are dealt to blocks by hash and each block is visited PASSES times. Draws are seeded and cells are sorted,
so a run can be repeated exactly. Word counts, which grow faster, stay distributed.

Scoring: one batched product over all contexts and classes gives the normaliser of each context; a token's log-probability
is its own product less that. Counts of the `heavy` most frequent words travel to the tasks; rarer words are looked up by a
shuffle join (AQE splits hot keys).

Defined results: null texts count as empty (their end alone); rows with a null id count as id 'null' for the fold;
repeated rows count as often as they occur and get equal scores; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import id_remainder, lean, materialise, scratch, text_of

#: Words of their own and suffix groups, each times the fourth root of the training tokens.
HEAD, SUFFIXES = 6, 12
#: Coarse classes; size of vectors; noise words per position.
COARSE, DIM, NOISE = 16, 32, 10
#: Least steps of training, text positions and noise classes drawn for a step.
STEPS, POSITIONS, DRAWS = 400, 16_384, 1024
#: Cells that the driver holds at a time; where there are several such blocks, visits of each and steps of a visit.
BLOCK, PASSES, VISIT = 2_000_000, 8, 25
#: Words whose counts travel to every task, and distinct words held before they are passed on in counting.
HEAVY, HELD = 100_000, 200_000
#: Cells held before they are passed on in counting.
HELD_CELLS = 2_000_000
#: Stands for the end of a text; no word holds white space.
END = b"\n"


def tokens(text: bytes) -> list[bytes]:
    """Words in small ASCII letters, then the end."""
    return [*text.lower().split(), END]


def word_counts(training: DataFrame) -> DataFrame:
    """training: text (binary). word (binary), c (long)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(counts: Counter):
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for x in batch.column(0):
                counts.update(tokens(x.as_py()))
                if len(counts) > HELD:
                    yield out(counts)
                    counts.clear()
        if counts:
            yield out(counts)

    return training.select("text").mapInArrow(lean(run), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Classes:
    """Class 0 is the end, then head words, then suffix groups; the last one holds all other words."""

    heavy: dict[bytes, int]  # word -> place in the arrays
    heavy_class: np.ndarray
    heavy_log: np.ndarray  # log10(c + 0.5)
    suffix: dict[bytes, int]
    coarse: np.ndarray  # class -> coarse class
    inside: np.ndarray  # class -> log10 of the total that a word's count in it is divided by; 0 for single words
    single: np.ndarray  # class -> holds one word
    n: int  # training tokens
    v: int  # distinct ones

    @property
    def size(self) -> int:
        return len(self.coarse)

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each word its class, and its place among heavy words or -1."""
        at = np.fromiter(map(self.heavy.get, words, repeat(-1)), np.int64, len(words))
        found = self.heavy_class[at]
        for i in np.flatnonzero(at < 0).tolist():
            found[i] = self.suffix.get(words[i][-3:], self.size - 1)
        return found, at

    def contexts(self, classes: np.ndarray) -> np.ndarray:
        """The context's number at each position; before a text stands the end."""
        before = np.concatenate([[0, 0], classes[:-1]])
        return before[1:] * COARSE + self.coarse[before[:-1]] if len(classes) else before[:0]


def choose_classes(vocabulary: DataFrame, head: int | None = None, suffixes: int | None = None, heavy: int = HEAVY) -> Classes:
    """head, suffixes: how many words of their own (at most `heavy`) and groups there are; by the number of tokens if not given."""
    total = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).collect()[0]
    root = total[0] ** 0.25
    head = int(HEAD * root) if head is None else head
    suffixes = int(SUFFIXES * root) if suffixes is None else suffixes
    # The lowest count (in steps of an eighth of a power of two) that at most `heavy` words reach.
    step = F.floor(F.log2("c") * 8).cast("int")
    bins = sorted(vocabulary.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["s"])  # some hundred rows
    least, held = None, 0
    for r in bins:
        if held + r["n"] > heavy:
            break
        held += r["n"]
        least = r["s"]
    frequent = (vocabulary.where(step >= least) if least is not None else vocabulary.limit(0)).toArrow()
    pairs = sorted(zip(frequent.column("word").to_pylist(), frequent.column("c").to_pylist(), strict=True), key=lambda p: (-p[1], p[0]))
    del frequent
    own = [w for w, _ in pairs if w != END][:head]
    place = {END: 0} | {w: i + 1 for i, w in enumerate(own)}
    taken = vocabulary.sparkSession.createDataFrame([(bytearray(w),) for w in place], "word binary")
    rest = vocabulary.join(F.broadcast(taken), "word", "left_anti")
    by_suffix = rest.groupBy(F.substring("word", -3, 3).alias("s")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"))
    top = by_suffix.orderBy(F.desc("n"), F.asc("s")).limit(suffixes).collect()
    suffix = {bytes(r["s"]): len(place) + i for i, r in enumerate(top)}
    size = len(place) + len(suffix) + 1
    mass, kinds = np.zeros(size), np.zeros(size)
    counts = {w: c for w, c in pairs if w in place}
    for i, r in enumerate(top):
        mass[len(place) + i], kinds[len(place) + i] = r["n"], r["v"]
    mass[-1] = total[0] - mass.sum() - sum(counts.get(w, 0) for w in place)
    kinds[-1] = total[1] - kinds.sum() - sum(w in counts for w in place)
    single = np.arange(size) < len(place)
    inside = np.where(single, 0.0, np.log10(mass + 0.5 * (kinds + 1)))
    # Coarse classes: the last two bytes, the most frequent ones by tokens; 0 is the end, the last one all others.
    ends: Counter = Counter()
    for w in own:
        ends[w[-2:]] += counts[w]
    for s, i in suffix.items():
        ends[s[-2:]] += mass[i]
    chosen = {e: i + 1 for i, (e, _) in enumerate(sorted(ends.items(), key=lambda p: (-p[1], p[0]))[: COARSE - 2])}
    coarse = np.full(size, COARSE - 1, dtype=np.int64)
    coarse[0] = 0
    for w, i in [*((w, place[w]) for w in own), *suffix.items()]:
        coarse[i] = chosen.get(w[-2:], COARSE - 1)
    classes = np.array([place.get(w, suffix.get(w[-3:], size - 1)) for w, _ in pairs] + [size - 1], dtype=np.int64)  # the last entry serves place -1
    logs = np.log10(np.array([c for _, c in pairs] + [0], dtype=np.float64) + 0.5)
    return Classes({w: i for i, (w, _) in enumerate(pairs)}, classes, logs, suffix, coarse, inside, single, int(total[0]), int(total[1]))


def cell_counts(training: DataFrame, shared) -> DataFrame:
    """cell (context * classes + class), n: over all training texts. shared: a broadcast of Classes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        k = shared.value
        waiting, size = [], 0
        held = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))

        def add() -> tuple[np.ndarray, np.ndarray]:
            cell, n = np.unique(np.concatenate(waiting), return_counts=True)
            cell, n = np.concatenate([held[0], cell]), np.concatenate([held[1], n])
            order = np.argsort(cell, kind="stable")
            cell, n = cell[order], n[order]
            starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            return cell[starts], np.add.reduceat(n, starts)

        def out() -> Iterator:
            for at in range(0, len(held[0]), 1 << 17):
                part = slice(at, at + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(held[0][part]), pa.array(held[1][part])], names=["cell", "n"])

        for batch in batches:
            for x in batch.column(0):
                found, _ = k.of(tokens(x.as_py()))
                waiting.append(k.contexts(found) * k.size + found)
                size += len(found)
                if size > 1 << 20:
                    held = add()
                    waiting, size = [], 0
                    if len(held[0]) > HELD_CELLS:
                        yield from out()
                        held = (held[0][:0], held[1][:0])
        if waiting:
            held = add()
        yield from out()

    return training.select("text").mapInArrow(lean(run), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


@dataclass
class Bilinear:
    r1: np.ndarray
    r2: np.ndarray
    q: np.ndarray
    b: np.ndarray

    def scores(self) -> np.ndarray:
        """contexts x classes, not normalised; context = class before * COARSE + coarse class before that."""
        vectors = (self.r1[:, None, :] + self.r2[None, :, :]).reshape(-1, self.q.shape[1])
        return vectors @ self.q.T + self.b

    def log_totals(self) -> np.ndarray:
        """The natural logarithm of each context's normaliser, some contexts at a time."""
        found = []
        for a in range(0, len(self.r1), 128):
            s = Bilinear(self.r1[a : a + 128], self.r2, self.q, self.b).scores()
            top = s.max(axis=1, keepdims=True)
            s -= top
            found.append(np.log(np.exp(s, out=s).sum(axis=1, dtype=np.float64)) + top[:, 0])
        return np.concatenate(found)

    def log_probability(self, totals: np.ndarray, contexts: np.ndarray, classes: np.ndarray) -> float:
        """The sum over positions of log-probabilities (natural)."""
        total = 0.0
        for at in range(0, len(classes), 1 << 16):
            c, w = contexts[at : at + (1 << 16)], classes[at : at + (1 << 16)]
            s = np.einsum("ij,ij->i", self.r1[c // COARSE] + self.r2[c % COARSE], self.q[w])
            total += float((s + self.b[w] - totals[c]).sum(dtype=np.float64))
        return total

    def log_probabilities(self) -> np.ndarray:
        """Natural logarithms; each row sums to 1 in probabilities."""
        s = self.scores()
        s -= s.max(axis=1, keepdims=True)
        return s - np.log(np.exp(s).sum(axis=1, keepdims=True))


def _evenly(cumulated: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n draws by these weights, evenly spaced from a random start: ascending places."""
    points = (np.arange(n) + rng.random()) * (float(cumulated[-1]) / n)
    return np.minimum(np.searchsorted(cumulated, points, side="right"), len(cumulated) - 1)


def _sums(rows: np.ndarray, keys: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows by key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    out = np.zeros((size, *rows.shape[1:]), dtype=rows.dtype)
    out[keys[starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out


def train_cells(blocks: Iterable[tuple[np.ndarray, np.ndarray, int]], totals: np.ndarray, steps: int, dim: int = DIM, noise: int = NOISE, rate: float = 0.05, seed: int = 3) -> Bilinear:
    """blocks: (cells in ascending order, their counts, steps to take with them); totals: counts of classes; steps: those of
    all blocks, which set how the rate falls. Adam on the noise-contrastive objective."""
    size = len(totals)
    rng = np.random.default_rng(seed)
    f = np.float32
    share = (totals + 0.5) / (totals.sum() + 0.5 * size)
    cumulated_share = np.cumsum(share)
    log_kp = np.log(noise * share).astype(f)
    params = [rng.normal(0, 0.1, (size, dim)).astype(f), rng.normal(0, 0.1, (COARSE, dim)).astype(f), rng.normal(0, 0.1, (size, dim)).astype(f), np.log(share).astype(f)]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for cells, counts, visit in blocks:
        cumulated = np.cumsum(counts, dtype=np.float64)
        for _ in range(visit if len(cells) else 0):
            step += 1
            r1, r2, q, b = params
            drawn = cells[_evenly(cumulated, POSITIONS, rng)]
            context, word = drawn // size, drawn % size
            starts = np.flatnonzero(np.append(True, context[1:] != context[:-1]))  # drawn cells ascend, so contexts do
            times = np.diff(np.append(starts, POSITIONS))
            first, second = context[starts] // COARSE, context[starts] % COARSE
            vectors = r1[first] + r2[second]
            # Data: the slope by score is -P(noise | data word).
            rows = np.repeat(vectors, times, axis=0)
            targets = q[word]
            score = np.einsum("ij,ij->i", rows, targets) + b[word] - log_kp[word]
            data = -1 / (1 + np.exp(np.clip(score, -30, 30))) / f(POSITIONS)
            # Noise: drawn classes stand for k words beside each position; the slope is P(data | noise word).
            classes, often = np.unique(_evenly(cumulated_share, DRAWS, rng), return_counts=True)
            other = q[classes]
            slope = vectors @ other.T
            slope += b[classes] - log_kp[classes]
            np.clip(slope, -30, 30, out=slope)
            np.negative(slope, out=slope)
            np.exp(slope, out=slope)
            slope += 1
            np.divide((times / POSITIONS).astype(f)[:, None] * (often * (noise / DRAWS)).astype(f), slope, out=slope)
            by_context = np.add.reduceat(data[:, None] * targets, starts, axis=0) + slope @ other
            by_word = _sums(data[:, None] * rows, word, size)
            by_word[classes] += slope.T @ vectors
            bias = np.bincount(word, weights=data, minlength=size).astype(f)
            bias[classes] += slope.sum(axis=0)
            grads = [_sums(by_context, first, size), _sums(by_context, second, COARSE), by_word, bias]
            now = rate * (1 - step / (steps + 1)) ** 0.5
            for i, g in enumerate(grads):
                m1[i] = 0.9 * m1[i] + f(0.1) * g
                m2[i] = 0.98 * m2[i] + f(0.02) * g * g
                params[i] = (params[i] - now * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.98**step)) + 1e-9)).astype(f)
    return Bilinear(*params)


def train_nce(counts: np.ndarray, steps: int = STEPS, **options) -> Bilinear:
    """counts: contexts x classes, held whole."""
    cells = np.flatnonzero(counts)
    return train_cells([(cells, counts.ravel()[cells], steps)], counts.sum(axis=0, dtype=np.float64), steps, **options)


def by_block(cells: DataFrame, size: int, number: int) -> DataFrame:
    """The table of cells saved again in folders by the hash of the context, so that a block is read alone."""
    path = scratch(cells.sparkSession, "blocks")
    block = F.pmod(F.xxhash64(F.floor(F.col("cell") / size)), F.lit(number)).cast("int")
    cells.withColumn("block", block).repartition("block").write.partitionBy("block").parquet(path)
    return cells.sparkSession.read.schema("cell bigint, n bigint, block int").parquet(path)


def cell_blocks(cells: DataFrame, number: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """What train_cells takes, from cells or, for several blocks, from by_block of them."""
    for _ in range(PASSES if number > 1 else 1):
        for i in range(number):
            held = (cells.where(F.col("block") == i) if number > 1 else cells).select("cell", "n").toArrow()  # about BLOCK rows
            cell, n = held.column("cell").to_numpy(), held.column("n").to_numpy()
            del held
            order = np.argsort(cell)
            yield cell[order], n[order], VISIT if number > 1 else STEPS


def partial_scores(rows: DataFrame, shared, model: Bilinear) -> DataFrame:
    """rows: doc_id, held_out, text. Sums over each text's tokens, all but the counts of rare words, which are listed."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    totals = model.log_totals()
    schema = f"uid bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, counts double, shared double, classes double, rare array<struct<word:binary,m:int>>"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        k = shared.value
        uid = TaskContext.get().partitionId() << 33
        rare_type = pa.list_(pa.struct([("word", pa.binary()), ("m", pa.int32())]))
        # Single-word classes: the class is the word, so its count drops out of the model's score.
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out: list[list] = [[] for _ in range(6)]
                for x in part.column(2):
                    words = tokens(x.as_py())
                    found, place = k.of(words)
                    heavy = place >= 0
                    logs = k.heavy_log[place[heavy]]
                    grouped = ~k.single[found]
                    rare = Counter([words[i] for i in np.flatnonzero(~heavy).tolist()])
                    values = (
                        len(words),
                        int(heavy.sum()),
                        float(logs.sum()),  # of heavy words, for the base
                        float(logs[grouped[heavy]].sum() - k.inside[found].sum()),  # of heavy words in groups, for the model
                        model.log_probability(totals, k.contexts(found), found) / float(np.log(10)),
                        [{"word": w, "m": m} for w, m in rare.items()],
                    )
                    for col, v in zip(out, values, strict=True):
                        col.append(v)
                n = part.num_rows
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), rare_type)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + n)), part.column(0), part.column(1), *[pa.array(c, t) for c, t in zip(out, kinds, strict=True)]], names=["uid", "doc_id", "held_out", "n_tokens", "n_known", "counts", "shared", "classes", "rare"])
                uid += n

    return rows.select("doc_id", "held_out", "text").mapInArrow(lean(run), schema)


def fit(training: DataFrame, head: int | None = None, suffixes: int | None = None, heavy: int = HEAVY, block: int = BLOCK) -> tuple[DataFrame, Classes, object, Bilinear]:
    """training: text (binary). The vocabulary (word, c), its classes (and their broadcast), and the model."""
    spark = training.sparkSession
    vocabulary = materialise(word_counts(training), "words")
    classes = choose_classes(vocabulary, head, suffixes, heavy)
    shared = spark.sparkContext.broadcast(classes)  # bounded by `heavy` words
    cells = materialise(cell_counts(training, shared), "cells")
    totals = np.zeros(classes.size)
    held = 0
    for r in cells.groupBy((F.col("cell") % classes.size).alias("w")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells")).collect():  # a row for each class
        totals[r["w"]] = r["n"]
        held += r["cells"]
    number = max(1, -(-held // block))
    if number > 1:
        cells = by_block(cells, classes.size, number)
    return vocabulary, classes, shared, train_cells(cell_blocks(cells, number), totals, number * PASSES * VISIT if number > 1 else STEPS)


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out: int = 1, folds: int = 5, head: int | None = None, suffixes: int | None = None, heavy: int = HEAVY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of whole texts)."""
    remainder = id_remainder(doc_id, folds)
    rows = docs.select(F.col(doc_id).alias("doc_id"), (remainder == held_out).alias("held_out"), text_of(text).cast("binary").alias("text"))
    vocabulary, classes, shared, model = fit(rows.where(~F.col("held_out")), head, suffixes, heavy)
    partial = materialise(partial_scores(rows, shared, model), "partial")
    rare = partial.select("uid", F.explode("rare").alias("r")).select("uid", F.col("r.word").alias("word"), F.col("r.m").alias("m"))
    looked = rare.join(vocabulary, "word", "left").groupBy("uid").agg(F.sum(F.col("m") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("known"))
    all_of = float(np.log10(classes.n + 0.5 * (classes.v + 1)))
    joined = partial.drop("rare").join(looked, "uid", "left")
    more = F.coalesce(F.col("more"), F.lit(0.0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce(F.col("known"), F.lit(0))).alias("n_known"),
        F.lit(classes.n).cast("bigint").alias("train_tokens"),
        (F.col("counts") + more - F.col("n_tokens") * F.lit(all_of)).alias("base_score"),
        (F.col("classes") + F.col("shared") + more).alias("score"),
    )
