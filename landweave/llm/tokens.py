"""Token ids of a byte-level BPE by corpus-level merge replay.

Each task works on its part of the corpus. The distinct words of a batch that the task hasn't met
yet are laid end to end in one symbol array; an inverted index from token pair to the positions
where it stands is built once, and every merge that occurs is applied in rank order to all its
positions, from left to right. A merge touches only the neighbours of its positions, whose new
pairs are added to the index. A merge makes a token of its own rank, so new pairs always come
later in the order and one pass over a heap of ranks ends the replay. The texts are then gathered
from the words' ids with array operations.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Default place of the tokenizer's file; a parameter of every function, never part of this repository.
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.json"
#: Words whose ids a task keeps; beyond it the task forgets them and replays them when met again.
KEPT_WORDS = 1_000_000
#: Fixed value: the pattern that cuts a text into words in byte-level BPE.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary's file."""
    shown = [b for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letter[b] for b in range(256)]


class MergeReplay:
    """The merges of one vocabulary and the words already replayed."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.of_byte = np.array([vocab[c] for c in _byte_letters()], dtype=np.int64)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.cut = regex.compile(WORDS).findall
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.start = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and the number of ids of each."""
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        length = np.array([len(w) for w in words], dtype=np.int64)
        sym = self.of_byte[raw].tolist()
        n = len(sym)
        ends = np.cumsum(length)
        last = np.zeros(n, dtype=bool)
        last[ends[length > 0] - 1] = True
        first = np.zeros(n, dtype=bool)
        first[(ends - length)[length > 0]] = True
        nxt = np.where(last, -1, np.arange(1, n + 1)).tolist()
        prv = np.where(first, -1, np.arange(-1, n - 1)).tolist()
        merges = self.merges
        places: dict[tuple[int, int], list[int]] = {}
        for i in range(n):
            j = nxt[i]
            if j >= 0:
                p = (sym[i], sym[j])
                if p in places:
                    places[p].append(i)
                elif p in merges:
                    places[p] = [i]
        heap = [(merges[p][0], p) for p in places]
        heapq.heapify(heap)
        while heap:
            _, pair = heapq.heappop(heap)
            a, b = pair
            new = merges[pair][1]
            for i in sorted(places.pop(pair)):
                j = nxt[i]
                if sym[i] != a or j < 0 or sym[j] != b:  # an earlier merge took this place
                    continue
                sym[i] = new
                sym[j] = -1
                k = nxt[j]
                nxt[i] = k
                if k >= 0:
                    prv[k] = i
                    p = (new, sym[k])
                    if p in places:
                        places[p].append(i)
                    elif p in merges:
                        places[p] = [i]
                        heapq.heappush(heap, (merges[p][0], p))
                h = prv[i]
                if h >= 0:
                    p = (sym[h], new)
                    if p in places:
                        places[p].append(h)
                    elif p in merges:
                        places[p] = [h]
                        heapq.heappush(heap, (merges[p][0], p))
        out = np.array(sym, dtype=np.int64)
        kept = out >= 0
        word_of = np.repeat(np.arange(len(words)), length)
        return out[kept].astype(np.int32), np.bincount(word_of[kept], minlength=len(words)).astype(np.int64)

    def _learn(self, words: Iterable[str]) -> None:
        new = list(words)
        if not new:
            return
        flat, size = self.replay([w.encode("utf-8", "surrogatepass") for w in new])
        for w in new:
            self.at[w] = len(self.at)
        start = len(self.flat) + np.cumsum(size) - size
        self.start, self.size, self.flat = np.concatenate([self.start, start]), np.concatenate([self.size, size]), np.concatenate([self.flat, flat])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each text)."""
        cuts = [self.cut(t) if t else [] for t in texts]
        if len(self.at) > KEPT_WORDS:
            self.forget()
        self._learn(dict.fromkeys(w for c in cuts for w in c if w not in self.at))
        at = self.at
        word = np.fromiter((at[w] for c in cuts for w in c), dtype=np.int64)
        size = self.size[word] if len(word) else np.zeros(0, dtype=np.int64)
        text_of = np.repeat(np.arange(len(texts)), [len(c) for c in cuts])
        counts = np.bincount(text_of, weights=size, minlength=len(texts)).astype(np.int64)
        before = np.cumsum(size) - size
        ids = self.flat[np.repeat(self.start[word] - before, size) + np.arange(int(size.sum()))] if len(word) else np.zeros(0, dtype=np.int32)
        return ids, counts


@lru_cache(maxsize=2)
def _loaded(path: str) -> MergeReplay:
    return MergeReplay(path)


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = BYTE_BPE_50K) -> DataFrame:
    """(key, ids): token ids of the whole text, no special tokens; a null and an empty text give an empty list.

    A special token's string in a text is ordinary text. Repeated rows are encoded each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path)
        for b in batches:
            ids, counts = bpe.encode(b.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = BYTE_BPE_50K) -> DataFrame:
    """(key, n_tokens) of the whole text; null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path)
        for b in batches:
            _, counts = bpe.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts)], names=[key, "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")
