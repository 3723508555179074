"""Token ids from the tokenizers library, each distinct piece of a word once.

A tokenizer whose normaliser and pre-tokeniser treat white space only as a separator gives a text's ids as the ids of its
white-space-separated words, one after the other. Words of letters with marks behind them are, in turn, two pre-tokens.
So some megabytes of text at a time are cut into words and distinct pieces by Arrow's kernels, a bounded cache of pieces
stands in front of the library, and numpy puts the texts' ids together. `separable` checks that property from the
tokenizer's definition; other tokenizers get whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np

from lexloom.llm.common import worker_state

#: Pieces kept per worker process, and bytes of text handled at a time.
CACHE_PIECES, STEP = 300_000, 2 << 20
#: Letters of ASCII and Latin-1, then ASCII marks (no apostrophe, which can start an ending such as 's): one or two pre-tokens.
PLAIN = "^(?P<a>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<b>[!-&(-/:-;=?-@\\[-`{}~]*)$"


def separable(path: str) -> bool:
    """True for the pattern where no rule of the tokenizer sees past white space."""
    spec = json.load(open(path, encoding="utf-8"))
    norm = json.dumps(spec.get("normalizer") or {})
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    drops = [p for p in pre if p.get("type") == "Split" and p.get("invert") and p.get("behavior") == "Removed"]
    spaces = '"Regex": "\\\\s+"' in norm
    flags = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t.get("content", "") for t in spec.get("added_tokens") or [])
    patterns = [p["pattern"].get("Regex", "") for p in drops]
    only_words = all("[\\p{L}]+" in x and "[^\\s\\p{L}\\p{N}]+" in x and "\\s+" not in x for x in patterns)
    byte_level_plain = all(not p.get("add_prefix_space") and not p.get("use_regex") for p in pre if p.get("type") == "ByteLevel")
    ends = bool(spec["model"].get("end_of_word_suffix"))
    return bool(drops) and spaces and only_words and byte_level_plain and not flags and ends


class WordEncoder:
    """Texts to unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.split = separable(path)
        if self.split:
            # Ids that end a pre-token: a text of single pre-tokens can be cut into them by its ids.
            suffix = json.load(open(path, encoding="utf-8"))["model"]["end_of_word_suffix"]
            self.ends = np.zeros(self.tok.get_vocab_size(with_added_tokens=True), dtype=bool)
            self.ends[[i for t, i in self.tok.get_vocab().items() if t.endswith(suffix)]] = True
            self.plain = re.compile(PLAIN).fullmatch
            self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {"": 0}  # piece -> its place in start and length
        self.start, self.length = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int32)
        self.flat = np.zeros(0, dtype=np.uint32)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(array("I", e.ids), dtype=np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single pre-tokens in one array, and how many each has; from one text, where each ends with the only id there that ends a pre-token."""
        ids = np.array(self.tok.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) != len(pieces):  # not as expected: the library sees each for itself
            return self._alone(pieces)
        return ids, np.diff(last, prepend=0)

    def _alone(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self._whole(pieces)
        return np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))

    def _learn(self, pieces: list[str]) -> None:
        """Give new pieces a slot."""
        plain = list(filter(self.plain, pieces))
        odd = list(set(pieces).difference(plain)) if len(plain) < len(pieces) else []
        found = [self._pieces(plain[at : at + 512]) for at in range(0, len(plain), 512)]
        found += [self._alone(odd[at : at + 512]) for at in range(0, len(odd), 512)]
        sizes = np.concatenate([n for _, n in found])
        begin = len(self.flat) + np.cumsum(sizes) - sizes
        self.slots.update(zip(plain + odd, range(len(self.start), len(self.start) + len(sizes)), strict=True))
        self.start, self.length = np.append(self.start, begin), np.append(self.length, sizes.astype(np.int32))
        self.flat = np.concatenate([self.flat, *[ids for ids, _ in found]])

    def _places(self, pieces: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.slots.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(at < 0)
        if len(new):
            self._learn([pieces[i] for i in new.tolist()])
            at[new] = [self.slots[pieces[i]] for i in new.tolist()]
        return at

    def _column(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """texts: an Arrow array of strings without nulls. All ids, and where each text's ids begin (one more entry: their end)."""
        import pyarrow.compute as pc

        if len(self.slots) > CACHE_PIECES:
            self._forget()
        lists = pc.ascii_split_whitespace(texts)
        offsets = lists.offsets.to_numpy()
        words = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
        word, distinct = words.indices.to_numpy(), words.dictionary
        parts = pc.extract_regex(distinct, PLAIN)
        first = pc.coalesce(pc.ascii_lower(pc.struct_field(parts, 0)), distinct).dictionary_encode()
        second = pc.fill_null(pc.struct_field(parts, 1), "").dictionary_encode()
        ab = [self._places(x.dictionary.to_pylist())[x.indices.to_numpy()] for x in (first, second)]
        # The ids of each distinct word, then of the texts: copies by computed places.
        piece = np.stack(ab, axis=1).ravel()
        flat = _gather(self.flat, self.start[piece], self.length[piece])
        size = self.length[piece].reshape(-1, 2).sum(axis=1)
        start = np.cumsum(size, dtype=np.int64) - size
        counts = size[word]
        ends = np.append(0, np.cumsum(counts, dtype=np.int64))
        return _gather(flat, start[word], counts), ends[offsets - offsets[0]]

    def encode_column(self, texts) -> Iterator[np.ndarray]:
        """texts: an Arrow array of strings without nulls. Each text's ids, in order."""
        import pyarrow.compute as pc

        if not self.split:
            for x in texts:
                yield self._whole([x.as_py()])[0]
            return
        lengths = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            done = lengths[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(lengths, done + STEP, side="right")))
            ids, starts = self._column(texts.slice(at, end - at))
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                yield ids[a:b]
            at = end

    def encode(self, text: str) -> np.ndarray:
        import pyarrow as pa

        return next(self.encode_column(pa.array([text])))


def _gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start[0] : start[0] + size[0]], values[start[1] : ...], ... in one array."""
    before = np.cumsum(size, dtype=np.int64) - size
    total = int(before[-1] + size[-1]) if len(size) else 0
    return values[np.repeat(start - before, size) + np.arange(total)]


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for this tokenizer file."""
    state = worker_state("encoders")
    if path not in state:
        state[path] = WordEncoder(path)
    return state[path]


def default_path(name: str = "word_bpe_49k.json") -> str:
    """The file's place on the machine that calls this; executors resolve it themselves through `resolve`."""
    import public_tokenizers

    return public_tokenizers.path(name)


def resolve(path_or_name: str) -> str:
    """A path, or the name of an installed public tokenizer."""
    return path_or_name if os.path.sep in path_or_name else default_path(path_or_name)
