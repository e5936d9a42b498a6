"""Order-preserving packing of token streams into windows by dynamic programming.

Documents are taken in the order of their ids or of a given column, which is range-sorted: the documents of a sorted
partition form one stream, whatever their ids. A window ends at a document's or a sentence's end, or, where there is none
for long, inside a sentence. The cost of a cut is the padding of its window plus a penalty for what it truncates; the
transition is a minimum over a sliding range of earlier cuts, which a monotone queue answers in constant time each.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import text_or_empty

WINDOW = 2048
#: Windows that are read ahead before the stream is cut; the last of them wait for what follows.
AHEAD, WAITING = 256, 2
#: Sequences of one sorted partition.
PER_PARTITION = 1 << 40
#: Penalties, in tokens of padding: a cut at the end of a sentence, and one inside a sentence.
AT_SENTENCE, IN_SENTENCE = 2, 16
#: The longest stretch without a place to cut.
STRETCH = 64
END_ID = 1
SENTENCE_END = tuple(".!?…。！？")
#: Small letters that no tokenizer composes, lowers or takes apart from each other, and digits.
LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff\u0430-\u045f"
WORD = re.compile(f"[{LETTERS}]+")
#: Marks that end a word of small letters or digits, and stand apart from it in the tokenizer's split as well.
PUNCTUATED = f"([0-9{LETTERS}])([.,;:!?]+)( |$)"
#: Characters of the texts whose chunks are numbered at once, ids looked up at once, new words encoded as one text, and texts of one call.
TEXTS, IDS, JOINED, CALL = 1 << 22, 1 << 19, 64, 256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Codes(dict):
    """Numbers for chunks as they are met; `new` are those whose ids are still to be learned."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = code = len(self)
        self.new.append(chunk)
        return code


def _grown(array: np.ndarray, least: int) -> np.ndarray:
    if least <= len(array):
        return array
    out = np.zeros(max(least, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


class ChunkTokenizer:
    """Ids of whole texts by way of their chunks between spaces, which are encoded once each.

    Right for tokenizers that compose (NFC), lower the case, drop white space and split words from punctuation. About `most` chunks are remembered.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        #: Which ids end a word: none where the vocabulary doesn't tell.
        vocabulary, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.codes, self.used = _Codes(), 0
        self.ids, self.starts, self.lengths, self.ends = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, bool)

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        batches = (self.tokenizer.encode_batch_fast(texts[k : k + CALL], add_special_tokens=False) for k in range(0, len(texts), CALL))
        return [np.array(e.ids, "<u4") for batch in batches for e in batch]

    def store(self, codes: list[int], lengths: np.ndarray, ids: list[np.ndarray]) -> None:
        """The ids of the chunks of these codes, one after the other, in arrays of any size."""
        total = int(lengths.sum())
        self.ids = _grown(self.ids, self.used + total)
        if total:
            np.concatenate(ids, out=self.ids[self.used : self.used + total])
        self.starts[codes], self.lengths[codes] = self.used + np.cumsum(lengths) - lengths, lengths
        self.used += total

    def learn(self) -> None:
        chunks, first, last = self.codes.new, len(self.codes) - len(self.codes.new), len(self.codes)
        self.codes.new = []
        self.starts, self.lengths, self.ends = _grown(self.starts, last), _grown(self.lengths, last), _grown(self.ends, last)
        self.ends[first:last] = [c.endswith(SENTENCE_END) for c in chunks]
        words, alone = [], []
        for code, chunk in enumerate(chunks, first):
            (words if WORD.fullmatch(chunk) else alone).append(code)
        # Calls cost more than words: words are encoded in rows, and parted where ids end a word.
        groups = [words[k : k + JOINED] for k in range(0, len(words), JOINED)]
        right, lengths, rows = [], [], []
        for group, ids in zip(groups, self.encoded([" ".join([chunks[c - first] for c in g]) for g in groups])):
            stops = np.flatnonzero(self.last[ids]) + 1
            if len(stops) == len(group) and stops[-1] == len(ids):
                right.extend(group)
                lengths.append(np.diff(stops, prepend=0))
                rows.append(ids)
            else:
                alone.extend(group)
        if right:
            self.store(right, np.concatenate(lengths), rows)
        if alone:
            rows = self.encoded([chunks[c - first] for c in alone])
            self.store(alone, np.fromiter(map(len, rows), np.int64, len(rows)), rows)

    def encode_all(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each text the ids, and the numbers of ids before which a sentence ends."""
        held, size = [], 0
        for text in texts:
            low = text.lower()
            # Lower case first, where the tokenizer, which looks for special tokens and composes before it lowers, comes to the same.
            if "<|" not in text and (text.isascii() or "Σ" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)):
                text = low
            held.append(text.replace("\n", " "))
            size += len(text) + 1
            if size >= TEXTS:
                yield from self._encode(held)
                held, size = [], 0
        if held:
            yield from self._encode(held)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return next(self.encode_all([text]))

    def _coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all chunks, and where each text's begin."""
        chunks = pc.split_pattern(pc.replace_substring_regex(pa.array(texts, pa.large_string()), PUNCTUATED, r"\1 \2\3"), " ")
        coded = chunks.values.dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False)
        return np.fromiter(map(self.codes.__getitem__, known), np.int32, len(known))[coded.indices.to_numpy()], chunks.offsets.to_numpy().copy()

    def _encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if len(self.codes) > self.most:
            self.clear()
        codes, bounds = self._coded(texts)
        if self.codes.new:
            self.learn()
        all_ids, starts, lengths = self.ids, self.starts, self.lengths  # whatever is learned while the caller works with the first texts
        after = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(lengths[codes], out=after[1:])
        stops = after[bounds]
        ended = after[1:][self.ends[codes]]
        ended = ended[np.diff(ended, prepend=-1) > 0]
        parts = np.searchsorted(ended, stops, "right")
        k = 0
        while k < len(texts):
            n = max(int(np.searchsorted(stops, stops[k] + IDS, "right")) - 1, k + 1)
            some, at = codes[bounds[k] : bounds[n]], after[bounds[k] : bounds[n]]
            # The place of each id: its chunk's start, and its number within the chunk.
            places = np.repeat(starts[some] - at, lengths[some])
            places += np.arange(stops[k], stops[n])
            ids = all_ids[places]
            for i in range(k, n):
                yield ids[stops[i] - stops[k] : stops[i + 1] - stops[k]], ended[parts[i] : parts[i + 1]] - stops[i]
            k = n


@lru_cache(maxsize=1)
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """One for all tasks that a Python worker runs, as most of the work is in chunks not seen before."""
    return ChunkTokenizer(path)


def candidate_cuts(sizes: list[int], sentence_ends: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Places of a stream where windows may end, ascending from 0 to its end, and their penalties."""
    sizes = np.array(sizes, np.int64)
    stops, counts = np.cumsum(sizes), [len(e) for e in sentence_ends]
    ends, size = np.concatenate([np.zeros(0, np.int64), *sentence_ends]), np.repeat(sizes, counts)
    inside = (np.repeat(stops - sizes, counts) + ends)[(0 < ends) & (ends < size)]
    edges = np.append(0, stops)
    marks = np.unique(np.append(edges, inside))
    # After each mark, a place every STRETCH ids up to the next one.
    runs = np.append((np.diff(marks) + STRETCH - 1) // STRETCH, 1)
    first = np.cumsum(runs) - runs
    places = np.repeat(marks - first * STRETCH, runs) + np.arange(runs.sum()) * STRETCH
    penalties = np.full(len(places), IN_SENTENCE)
    penalties[first] = AT_SENTENCE
    penalties[first[np.searchsorted(marks, edges)]] = 0
    return places.tolist(), penalties.tolist()


def best_cuts(places: list[int], penalties: list[int], window: int = WINDOW) -> list[int]:
    """The places of cuts (0 first, the end last) that cost least.

    cost[i] = penalty[i] + window - places[i] + min(cost[j] + places[j]), over j with places[i] - places[j] <= window.
    """
    n = len(places)
    key, back = [0] * n, [0] * n
    queue: deque[int] = deque([0])
    for i in range(1, n):
        here = places[i]
        while here - places[queue[0]] > window:
            queue.popleft()
        j = queue[0]
        back[i] = j
        key[i] = value = penalties[i] + window + key[j]  # cost[i] + places[i]
        while queue and key[queue[-1]] >= value:
            queue.pop()
        queue.append(i)
    cuts, i = [], n - 1
    while i > 0:
        cuts.append(places[i])
        i = back[i]
    return [0, *reversed(cuts)]


class Stream:
    """Cuts a stream of documents into windows as it is read; holds at most AHEAD windows and one document."""

    def __init__(self, first_sequence: int, window: int = WINDOW):
        self.sequence, self.window, self.held = first_sequence, window, 0
        self.pending: list[tuple[int | None, np.ndarray, np.ndarray, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray, ends: np.ndarray) -> None:
        self.pending.append((doc_id, ids, ends, 0, len(ids)))
        self.held += len(ids)

    def full(self) -> bool:
        return self.held >= AHEAD * self.window

    def cut(self, last: bool) -> pd.DataFrame:
        """Pieces of the windows that are settled: all at the stream's end."""
        places, penalties = candidate_cuts([len(ids) for _, ids, *_ in self.pending], [e for _, _, e, *_ in self.pending])
        cuts = best_cuts(places, penalties, self.window)
        if not last:
            cuts = cuts[: max(len(cuts) - WAITING, 1)]
        rows, left, k, base = [], [], 0, 0
        for doc_id, ids, ends, start, size in self.pending:
            ids, at = np.ascontiguousarray(ids, "<u4"), 0
            while at < len(ids) and base + at < cuts[-1]:
                while cuts[k + 1] <= base + at:
                    k += 1
                stop = min(len(ids), cuts[k + 1] - base)
                rows.append((doc_id, start + at, stop - at, zlib.crc32(ids[at:stop]), size, self.sequence + k, base + at - cuts[k]))
                at = stop
            if at < len(ids):
                left.append((doc_id, ids[at:], ends[ends > at] - at, start + at, size))
            base += len(ids)
        self.sequence += len(cuts) - 1
        self.pending, self.held = left, sum(len(ids) for _, ids, *_ in left)
        columns = dict(zip((c.split()[0] for c in PIECES.split(", ")), zip(*rows))) if rows else {c.split()[0]: () for c in PIECES.split(", ")}
        return pd.DataFrame({k: pd.array(v, dtype="Int64") for k, v in columns.items()})


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, window: int = WINDOW, make: Callable = chunk_tokenizer, order: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone; null ids stand before all others; rows that repeat an id are packed one
    after the other; an empty table has no pieces. Columns besides doc_id, text and `order` are not read. Every id lies
    in exactly one piece. Only the last window of each sorted partition is left as it comes.

    `order` names a column that documents are taken by; sequence_id ascends with it.
    `make` gives, for the path, an object with encode_all(texts), like ChunkTokenizer's.
    """

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, tokenizer = Stream(TaskContext.get().partitionId() * PER_PARTITION, window), make(tokenizer_path)
        for batch in batches:
            for doc_id, (ids, ends) in zip(batch["doc_id"], tokenizer.encode_all(batch["text"])):
                stream.add(None if pd.isna(doc_id) else int(doc_id), np.append(ids, np.uint32(end_id)), ends)
                if stream.full():
                    yield stream.cut(False)
        if stream.pending:
            yield stream.cut(True)

    # Ids travel as text, as a batch with a null among them would turn large ones into rounded floats.
    rows = docs.select(F.col("doc_id"), text_or_empty().alias("text"), F.col(order).alias("order"))
    rows = rows.orderBy("order", "doc_id", F.xxhash64("text")).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(packed, PIECES)
