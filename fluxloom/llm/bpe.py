"""BPE encoding and decoding with a priority queue of merge ranks over a doubly linked list of symbols.

The vocabulary file is a parameter (a ``tokenizers`` JSON with end-of-word suffix); ids equal that library's with
``add_special_tokens=False``. Texts are normalised and split as the file says: texts with characters below U+0180
only by this module, others by the library's normaliser and splitter. The merges are this module's own.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fluxloom.llm.common import id_type, map_batches

#: Of the characters that the short way takes: white space, letters (after lower-casing), numbers.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0"
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_NUMBER = "0-9²³¹¼½¾"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
_FAR = re.compile("[^\x00-įı-ſ]")
CACHED_WORDS = 450_000
#: Of the encoder that stays in a worker beside other operators' stages.
CACHED_BESIDE = 150_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it has one, else the next from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Recent(dict):
    """A cache of word -> ids in two generations: at most twice ``most`` words, the frequent ones stay."""

    def __init__(self, make, most: int = CACHED_WORDS):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.make(word)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class WordBpe:
    """Encoder and decoder for one vocabulary file. Ids are bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, cached_words: int = CACHED_WORDS, by_library: bool = False):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, model = path, spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (a, b) in enumerate(model["merges"]):
            self.rank.setdefault(vocab[a] << 32 | vocab[b], rank)
            self.made.append(vocab[a + b])
        letters = byte_letters()
        self.inner = [vocab.get(c, -1) for c in letters]
        self.last = [vocab.get(c + suffix, -1) for c in letters]
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for s, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = s
        self.utf8 = [s.encode() for s in self.strings]
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = letters
        self.cache = Recent(self.merge_by_library if by_library else lambda word: self.merge(word.encode()), cached_words)
        self.cached = self.cache.__getitem__
        self._library = None

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._model = self._library.model
        return self._library

    def merge_by_library(self, word: str) -> bytes:
        """The ids of one word by the library's merges, for operators whose method isn't the encoding."""
        if not (word.isascii() and word.isprintable()):
            word = "".join([self.letters[b] for b in word.encode()])
        self.library  # noqa: B018
        return array("I", [t.id for t in self._model.tokenize(word)]).tobytes()

    def merge(self, word: bytes) -> bytes:
        """The ids of one word: the lowest rank first, of equal ranks the leftmost."""
        ids = [self.inner[b] for b in word]
        n = len(ids)
        if not n:
            return b""
        ids[-1] = self.last[word[-1]]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank, made = self.rank, self.made
        queue = [r << 32 | i for i in range(n - 1) if (r := rank.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            top = heapq.heappop(queue)
            r, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            # stale: either symbol has gone or become another
            if ids[i] < 0 or j >= n or rank.get(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j] = made[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(queue, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank.get(ids[h] << 32 | ids[i])) is not None:
                heapq.heappush(queue, r << 32 | h)
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def _by_library(self, text: str) -> bytes:
        library = self.library
        words = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))
        return b"".join([self.cached(bytes(map(self.byte_of.__getitem__, w)).decode()) for w, _ in words])

    def _plain(self, text: str) -> bytes:
        if not text.isascii() and _FAR.search(text):
            return self._by_library(text)
        return b"".join(map(self.cached, _WORDS.findall(text.lower())))

    def encode(self, text: str) -> bytes:
        if self.special_at is None or "<|" not in text:
            return self._plain(text)
        parts = self.special_at.split(text)
        return b"".join(self.special[p].to_bytes(4, "little") if k % 2 else self._plain(p) for k, p in enumerate(parts))

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the vocabulary's strings, which this file's decoder joins by one space."""
        return b" ".join(map(self.utf8.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(2)
def encoder(path: str, by_library: bool = False) -> WordBpe:
    """One per worker process, with its cache of words. ``by_library``: the library merges words not met before."""
    return WordBpe(path, CACHED_BESIDE if by_library else CACHED_WORDS, by_library)


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256 (of UTF-8).

    Whole texts, each on its own, without a shuffle; null is the empty text, which has no ids. Rows may repeat, ids may
    be null, other columns are not read.
    """

    def make():
        bpe = encoder(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"cast(`{text_col}` AS string) AS text")
    return map_batches(rows, make, f"doc_id {id_type(rows, 'doc_id')}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids (array of int). The general form, for those who need the ids."""

    def make():
        bpe = encoder(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = pa.array([np.frombuffer(bpe.encode(x.as_py() or ""), "<u4").astype("i4") for x in batch.column(1)], pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

        return step

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"cast(`{text_col}` AS string) AS text")
    return map_batches(rows, make, f"doc_id {id_type(rows, 'doc_id')}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """The inverse of bpe_ids: doc_id, decoded."""

    def make():
        bpe = encoder(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [bpe.decode(np.array(x.as_py() or [], "<u4").tobytes()).decode() for x in batch.column("ids")]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "decoded"])

        return step

    return map_batches(encoded.select("doc_id", "ids"), make, f"doc_id {id_type(encoded, 'doc_id')}, decoded string")
