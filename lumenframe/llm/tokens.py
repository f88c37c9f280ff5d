"""Token ids by a public ``tokenizers`` file, a whole slice of texts at a time."""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lumenframe.llm import text as T

#: Chunks that are a word of plain letters and marks after it.
SIMPLE, MARKS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[.,;:!?]*$", ".,;:!?"
#: UTF-8 bytes of text that are encoded at one time: ids and their places take many times that.
SLICE_BYTES = 1 << 20


def byte_names() -> dict[int, str]:
    """Byte-level vocabularies name a byte by its character where that is printable, else by the next from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class KnownIds:
    """Ids of texts that have been encoded, as Arrow and numpy columns, up to a number of bytes; then it starts anew.  Long texts aren't kept.

    An entry takes some 30 bytes, where objects in a dict take 200: each Python worker of an executor holds its own.
    """

    def __init__(self, most: int = 8 << 20, longest: int = 256) -> None:
        self.most, self.longest = most, longest
        self._clear()

    def _clear(self) -> None:
        self.values, self.pool, self.lengths = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int32)

    def __len__(self) -> int:
        return len(self.values)

    @property
    def held(self) -> int:
        return self.values.nbytes + self.pool.nbytes + self.lengths.nbytes

    def parts(self, values: pa.Array, made: Callable[[list[str]], Iterable[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all of the distinct values in a row, and how many each has; those that aren't known are made, in one go."""
        if self.held > self.most:
            self._clear()
        at = pc.index_in(values, value_set=self.values)
        is_new = at.is_null()
        new = values.filter(is_new)
        ids = list(made(new.to_pylist()))
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        pool, lengths = np.concatenate([self.pool, np.frombuffer(b"".join(ids), np.uint32)]), np.concatenate([self.lengths, sizes])
        row = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        row[is_new.to_numpy(zero_copy_only=False)] = len(self) + np.arange(len(new))
        starts = np.cumsum(lengths, dtype=np.int64) - lengths
        out = pool[T.ragged(starts[row], lengths[row])], lengths[row].astype(np.int64)
        short = pc.less_equal(pc.binary_length(new), self.longest)
        if len(new) > short.true_count:
            is_short = short.to_numpy(zero_copy_only=False)
            new, sizes, first = new.filter(short), sizes[is_short], starts[len(self) :][is_short]
            pool = np.concatenate([self.pool, pool[T.ragged(first, sizes)]])
            lengths = np.concatenate([self.lengths, sizes])
        self.values, self.pool, self.lengths = pa.concat_arrays([self.values, new]), pool, lengths
        return out


class Encoder:
    """Ids of whole texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    The tokenizer must not join anything across ASCII white space, so each distinct chunk between white
    space is encoded once and its ids are gathered for every use.  Where the tokenizer also lower-cases
    and cuts letters from marks, a simple chunk is the ids of its lower-case word, which the BPE model gives,
    and those of its marks; all other chunks go through the whole tokenizer.  Both are tried on a few texts first.
    """

    _made: dict[str, "Encoder"] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.names = byte_names()
        self.chunks, self.words = KnownIds(), KnownIds()
        whole = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        for text in ("Ab 'c", "d\n\n <|endoftext|>x\t9", " \r\n"):
            if whole(text) != [i for w in text.split() for i in whole(w)]:
                raise ValueError(f"{path} doesn't split texts at white space")
        self.plain = all(whole(w + m) == np.frombuffer(self._word(w.lower()), "<u4").tolist() + whole(m) for w, m in
                         (("The", ","), ("\u00c9t\u00e9", "."), ("na\u00efvet\u00e9", "?!"), ("Stra\u00dfe", ":")))

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """One encoder for each worker process."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _word(self, word: str) -> bytes:
        named = word if word.isascii() else word.encode().decode("latin-1").translate(self.names)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(named)]).tobytes()

    def _wholly(self, values: list[str]) -> Iterable[bytes]:
        return (array("I", e.ids).tobytes() for e in self.batch(values, add_special_tokens=False))

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the distinct chunks in a row, and how many each has."""
        simple = pc.match_substring_regex(chunks, SIMPLE) if self.plain else pa.array(np.zeros(len(chunks), bool))
        bare = chunks.filter(simple)
        trimmed = pc.utf8_rtrim(bare, MARKS)
        word, words = T.coded(pc.utf8_lower(trimmed))
        mark, marks = T.coded(suffixes(bare, trimmed))
        pools = [self.words.parts(words, lambda new: map(self._word, new)), self.chunks.parts(marks, self._wholly),
                 self.chunks.parts(chunks.filter(pc.invert(simple)), self._wholly)]
        shift = np.cumsum([0, *(len(p) for p, _ in pools)])
        starts = [np.cumsum(n) - n + a for (_, n), a in zip(pools, shift, strict=False)]
        is_simple = simple.to_numpy(zero_copy_only=False)
        # Each chunk is two runs of the pool: its word (or all of it), and the marks after the word (or nothing).
        start, length = np.zeros((len(chunks), 2), np.int64), np.zeros((len(chunks), 2), np.int64)
        start[is_simple, 0], length[is_simple, 0] = starts[0][word], pools[0][1][word]
        start[is_simple, 1], length[is_simple, 1] = starts[1][mark], pools[1][1][mark]
        start[~is_simple, 0], length[~is_simple, 0] = starts[2], pools[2][1]
        pool = np.concatenate([p for p, _ in pools])
        return pool[T.ragged(start.ravel(), length.ravel())], length.sum(axis=1)

    def ids(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each followed by ``end_id``, and the offsets of each text."""
        flat, bounds = T.words(texts)
        ids, of_word = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(flat):
            codes, distinct = T.coded(flat)
            pool, lengths = self._distinct(distinct)
            of_word = lengths[codes]
            ids = pool[T.ragged((np.cumsum(lengths) - lengths)[codes], of_word)]
        bounds = np.concatenate([[0], np.cumsum(of_word)])[bounds]
        if end_id is not None:
            ids = np.insert(ids, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
        return ids.astype("<u4", copy=False), bounds


def suffixes(values: pa.Array, heads: pa.Array) -> pa.Array:
    """What follows each head in its value."""
    if not len(values):
        return values
    data = np.frombuffer(values.buffers()[2], np.uint8)
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    start = offsets[:-1] + pc.binary_length(heads).to_numpy()
    length = offsets[1:] - start
    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(values), pa.py_buffer(ends), pa.py_buffer(data[T.ragged(start, length)]))
