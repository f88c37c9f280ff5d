"""SentencePiece encoding by a Viterbi search that words with common prefixes share, and exact decoding.

What the best path to each end of a word is depends on the model.  A unigram model has scores that add up: the path with the greatest sum.
A model of merges has ranks that don't: there a path is good where each two neighbours are what the merges make of
their text, and exactly one path to each end is (it is the merges' own result), so the ids are the library's.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import text as T

#: The mark of a space in pieces.  Here a space stands for it, so a mark in a text is an ordinary character.
MARK = "▁"
# Kinds of pieces in model files.
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
#: What an unknown character costs below the worst piece.
PENALTY = 10.0
#: Ids that are decoded at one time.
DECODED = 1 << 20
# Kinds of models in model files.
UNIGRAM, MERGES = 1, 2
#: Pairs of neighbours that a worker remembers the test of (some 100 bytes each); then it starts anew.
MOST_PAIRS = 1 << 19


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The pieces of a model file with byte fallback, and searches over them."""

    _made: dict[str, "Pieces"] = {}

    def __init__(self, path: str, kind: int | None = None) -> None:
        """``kind`` is UNIGRAM or MERGES; the model file says which by default."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.normalizer_spec.name != "identity" or model.normalizer_spec.remove_extra_whitespaces or not model.normalizer_spec.add_dummy_prefix:
            raise ValueError("only models without normalisation and with a space before texts are known here")
        self.kind = kind or model.trainer_spec.model_type
        if self.kind not in (UNIGRAM, MERGES):
            raise ValueError("only unigram models and models of merges are known here")
        self.pairs: dict[int, bool] = {}
        self.score: dict[str, tuple[float, int]] = {}
        self.byte_id = np.zeros(256, np.uint32)
        self.data: list[bytes] = []
        for i, p in enumerate(model.pieces):
            plain = p.piece.replace(MARK, " ")
            self.data.append(plain.encode() if p.type in (NORMAL, USER) else b"")
            if p.type == BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_id[value], self.data[-1] = i, bytes([value])
            elif p.type in (NORMAL, USER):
                self.score[plain] = (p.score, i)
                if "\n" in plain or " " in plain.lstrip(" "):
                    raise ValueError("a piece crosses words")
        self.longest = max(map(len, self.score))
        self.ids = {text: i for text, (_, i) in self.score.items()}
        tails: dict[str, set[int]] = {}
        for text in self.score:
            if len(text) > 1:
                tails.setdefault(text[-3:], {1, 2} if text[-2:] in self.score else {1}).add(len(text))
        self.by_tail = {tail: tuple(sorted(lengths, reverse=True)) for tail, lengths in tails.items()}
        self.unknown = min(s for s, _ in self.score.values()) - PENALTY
        self.letters = {c for p in self.score for c in p}
        self.piece_chars = [len(d.decode("utf-8", "replace")) for d in self.data]
        self.known = T.Remembered()
        lengths = np.array([len(d) for d in self.data])
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.pool = np.frombuffer(b"".join(self.data), np.uint8)

    @classmethod
    def of(cls, path: str) -> "Pieces":
        """One for each worker process."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def search(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Best pieces of each of the distinct words, as ids in a row, in sorted order.

        The sorted words are the leaves of their trie in depth-first order: going from one word to the next, the
        best paths to all ends in the common prefix stay, and only ends after it are searched.
        Scores and best last pieces lie in arrays of 12 bytes for each character, so a text without spaces is searched, too.
        A last piece below 0 is a character that no piece is; its bytes are written.
        """
        best, last, before = array("d", [0.0]), array("i", [-1]), ""
        extend = self._greatest if self.kind == UNIGRAM else self._merged
        for word in sorted(words):
            common = common_prefix(word, before)
            del best[common + 1 :], last[common + 1 :]
            extend(word, best, last)
            ids = array("I")
            at = len(word)
            while at:
                piece = last[at]
                if piece < 0:
                    at -= 1
                    ids.extend(reversed([int(self.byte_id[x]) for x in word[at].encode()]))
                else:
                    ids.append(piece)
                    at -= self.piece_chars[piece]
            ids.reverse()
            before = word
            yield word, ids.tobytes()

    def _greatest(self, word: str, best: array, last: array) -> None:
        """Go on to each end of the word with the greatest sum of scores."""
        score, longest = self.score, self.longest
        for end in range(len(best), len(word) + 1):
            top, piece = best[end - 1] + self.unknown, -1
            for begin in range(max(0, end - longest), end):
                found = score.get(word[begin:end])
                if found is not None and best[begin] + found[0] > top:
                    top, piece = best[begin] + found[0], found[1]
            best.append(top)
            last.append(piece)

    def _merged(self, word: str, best: array, last: array) -> None:
        """Go on to each end of the word with the one last piece that is what the merges make beside the piece before it; all scores are 0.

        Only lengths that pieces with the same last three characters (or two) have are tried, the longest first.
        """
        ids, by_tail, pairs, single = self.ids, self.by_tail, self.pairs, (1,)
        if len(pairs) > MOST_PAIRS:
            pairs.clear()
        for end in range(len(best), len(word) + 1):
            for n in by_tail.get(word[max(0, end - 3) : end]) or by_tail.get(word[max(0, end - 2) : end], single):
                begin = end - n
                if begin < 0:
                    continue
                piece = ids.get(word[begin:end])
                if piece is None:
                    if n > 1:
                        continue
                    piece = -2 - ord(word[begin])
                pair = (last[begin] << 32) + piece
                good = pairs.get(pair)
                if good is None:
                    ahead, text = self.text_of(last[begin]) if begin else "", word[begin:end]
                    good = pairs[pair] = self.merges(ahead + text) == ([ahead, text] if ahead else [text])
                if good:
                    break
            else:
                raise ValueError(f"no path to {word[max(0, end - 40) : end]!r}")
            best.append(0.0)
            last.append(piece)

    def text_of(self, piece: int) -> str:
        """The text of a piece, or of a character that no piece is."""
        return self.data[piece].decode() if piece >= 0 else chr(-2 - piece)

    def merges(self, text: str) -> list[str]:
        """What the merges make of a short text: the two neighbours whose piece has the greatest score, the leftmost of several, become one, again and again."""
        parts = list(text)
        while True:
            known = [(found[0], -i) for i in range(len(parts) - 1) if (found := self.score.get(parts[i] + parts[i + 1])) is not None]
            if not known:
                return parts
            at = -max(known)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of each text."""
        chunks, bounds = marked_words(texts)
        codes, distinct = T.coded(chunks)
        parts = self.known.parts(distinct.to_pylist(), self.ids_of)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        of_word = lengths[codes] if len(codes) else np.zeros(0, np.int64)
        pool = np.frombuffer(b"".join(parts), "<u4")
        ids = pool[T.ragged((np.cumsum(lengths) - lengths)[codes], of_word)] if len(codes) else pool
        return ids, np.concatenate([[0], np.cumsum(of_word)])[bounds]

    def ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, in their order."""
        found = dict(self.search(words))
        return [found[w] for w in words]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The texts of the runs of ids, as bytes."""
        flat = []
        for at in range(0, len(ids), DECODED):
            part = ids[at : at + DECODED]
            flat.append(self.pool[T.ragged(self.starts[part], self.lengths[part])].tobytes())
        text = b"".join(flat)
        ends = np.concatenate([[0], np.cumsum(self.lengths[ids])])[bounds].tolist()
        return [text[a + 1 : b] if b > a else b"" for a, b in zip(ends, ends[1:], strict=False)]


def common_prefix(a: str, b: str) -> int:
    """Characters that two words begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 32:  # the first difference lies in [low, n)
        middle = (low + n) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            n = middle
    return next(i for i in range(low, n) if a[i] != b[i])


def marked_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts with a space before them, cut before each run of spaces and around newlines; empty texts have no word."""
    led = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
    led = pa.concat_arrays([led])
    offsets = np.frombuffer(led.buffers()[1], np.int32)[: len(led) + 1].astype(np.int64) if len(led) else np.zeros(1, np.int64)
    data = np.frombuffer(led.buffers()[2] or b"", np.uint8)[: offsets[-1]]
    first = np.zeros(len(data) + 1, bool)
    space, line = data == 32, data == 10
    first[:-1] = (space & ~np.concatenate([[False], space[:-1]])) | line
    first[1:] |= line
    first[offsets] = True
    starts = np.flatnonzero(first[: len(data)]) if len(data) else np.zeros(0, np.int64)
    ends = np.concatenate([starts, [len(data)]]).astype(np.int32)
    chunks = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), led.buffers()[2]) if len(starts) else pa.array([], pa.string())
    return chunks, np.searchsorted(starts, offsets)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """Encode every text and decode its ids again: the id, n_pieces, ids_crc32, decoded_sha256, exact.

    Pieces are those of the model's best path (see above); characters that no piece is
    are written as bytes, so decoding gives each text back, marks and control characters too.  Null texts
    count as empty and have no piece.  Rows that repeat an id are rows of their own; an empty table gives an empty result.
    """
    path = model or default_model()
    id_type = df.schema[id_col].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path)
        for b in T.slices(batches):
            ids, bounds = pieces.encode(b.column("text"))
            texts = pieces.decode(ids, bounds)
            raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
            exact = [t == x.encode() for t, x in zip(texts, b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(np.diff(bounds)), pa.array(crc, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(exact, pa.bool_())],
                ["id", "n_pieces", "ids_crc32", "decoded_sha256", "exact"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(code, f"id {id_type}, n_pieces long, ids_crc32 long, decoded_sha256 string, exact boolean").withColumnRenamed("id", id_col)
