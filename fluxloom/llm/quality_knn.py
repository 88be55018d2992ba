"""Quality classifier by nearest-neighbour voting over latent-semantic vectors.

Terms are a text's words, and its style: the shapes of its words (letters, capitals, digits, signs, in order), words that
repeat the one before or a pair met earlier, lines met earlier. Their tf-idf matrix over labelled documents is reduced by
a singular value decomposition. The labelled vectors are broadcast (at most MOST_LABELLED of them, whatever the corpus),
exact cosines of every document with all of them are computed in blocks, and the nearest vote with weights that grow
with the similarity.

Fitting reads at most MOST_LABELLED labelled ids (``most``, a parameter): those with the smallest hash of their id. Every
document is scored from its whole text.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.llm.common import PIECE, column, id_type, map_batches

MOST_LABELLED = 4000
SHAPES, WORDS = 256, 512
DIMENSIONS = 48
#: Weight of words' terms beside those of style.
WORD_WEIGHT = 0.35
NEIGHBOURS = 15
SHARPNESS = 20.0
THRESHOLD = 0.3
_EXTRA = ("same as the word before", "pair met before", "line met before", "line not met before", "few words")
TERMS = SHAPES + len(_EXTRA) + 8 + WORDS


def _shape_of(word: str) -> int:
    """A term for the runs of kinds of characters of the whole word, as in 'Xx,' or '9.9'; runs of a kind count as one."""
    shape, last = [], ""
    for c in word:
        kind = "x" if c.islower() else "X" if c.isupper() else "9" if c.isdigit() else c if not c.isalpha() else "o"
        if kind != last:
            shape.append(kind)
            last = kind
    return zlib.crc32("".join(shape).encode("utf-8", "replace")) % SHAPES


class _Shapes(dict):
    """Each word's shape and its own term, as one number."""

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        plain = word.lower().strip(".,:;!?\"'()")
        self[word] = code = _shape_of(word) * WORDS + zlib.crc32(plain.encode("utf-8", "replace")) % WORDS
        return code


@functools.lru_cache(1)
def _shapes() -> _Shapes:
    return _Shapes()


def term_counts(text: str) -> np.ndarray:
    """Counts of the terms of one text, a word."""
    counts = np.zeros(TERMS, np.float32)
    words = text.split()
    n = len(words)
    if n:
        codes = np.fromiter(map(_shapes().__getitem__, words), np.int64, n)
        counts[:SHAPES] = np.bincount(codes // WORDS, minlength=SHAPES)
        counts[TERMS - WORDS :] = WORD_WEIGHT * np.bincount(codes % WORDS, minlength=WORDS)
        pairs = list(zip(words, words[1:]))
        counts[SHAPES] = sum(a == b for a, b in pairs)
        counts[SHAPES + 1] = len(pairs) - len(set(pairs))
        lines = [x for x in text.split("\n") if x.strip()]
        counts[SHAPES + 2] = n * (len(lines) - len(set(lines))) / len(lines)
        counts[SHAPES + 3] = n * len(set(lines)) / len(lines)
        counts[SHAPES + 4] = 0.2 * n if n < 10 else 0
    counts[SHAPES + len(_EXTRA) + min(7, int(np.log2(n + 1) / 2))] = 0.05 * max(n, 1)
    return counts / max(n, 1)


class Voter:
    """Term weights, the latent space and the labelled vectors in it."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS):
        self.neighbours, self.labels = neighbours, labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        if not len(labels):
            return
        self.idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 0.5
        weighted = self._weighted(counts)
        gram = weighted.T.astype(float) @ weighted
        values, vectors = np.linalg.eigh(gram)  # right singular vectors of the term matrix
        self.basis = vectors[:, np.argsort(-values)[: min(dimensions, len(values))]].astype(np.float32)
        self.vectors = self._unit(weighted @ self.basis)

    def _weighted(self, counts: np.ndarray) -> np.ndarray:
        return np.sqrt(counts) * self.idf

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest, from 0 to 1."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        k = min(self.neighbours, len(self.labels))
        out = np.empty(len(counts))
        for i in range(0, len(counts), 512):
            cosine = self._unit(self._weighted(counts[i : i + 512]) @ self.basis) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.exp(SHARPNESS * (np.take_along_axis(cosine, near, 1) - 1)).astype(float) + 1e-9
            out[i : i + 512] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED) -> Voter:
    """Learn from labelled rows whose crc32(id as text) mod 5 is not 0, at most ``most`` of them. Null labels and ids
    are left out; of documents that repeat an id the text that sorts last counts; an id with both labels counts for both."""
    key = column(id_col).cast("string")
    learn = labels.select(column(id_col).alias("_id"), column(label_col).cast("int").alias("_label"), F.crc32(key.cast("binary")).alias("_crc")).filter("_id IS NOT NULL AND _label IS NOT NULL AND _crc % 5 <> 0")
    sample = learn.distinct().orderBy(F.xxhash64("_id"), "_id", "_label").limit(most)
    # bounded by the limit above, and so is what is joined: a row for each of the sample's, however often an id repeats
    texts = docs.select(column(id_col).alias("_doc"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("_text"))
    joined = texts.join(F.broadcast(sample), F.col("_doc") == F.col("_id")).groupBy("_doc", "_label").agg(F.max("_text").alias("_text"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = [term_counts(x.as_py()) for x in batch.column(1)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in counts], pa.binary()), batch.column(2)], ["id", "counts", "label"])

        return step

    rows = map_batches(joined.select("_doc", "_text", "_label"), make, f"id {id_type(docs, id_col)}, counts binary, label int", PIECE).collect()
    rows = sorted(rows, key=lambda r: (str(r[0]), bytes(r[1]), r[2]))
    counts = np.array([np.frombuffer(r[1], np.float32) for r in rows], np.float32).reshape(-1, TERMS)
    return Voter(counts, np.array([r[2] for r in rows], np.float32))


def score(docs: DataFrame, voter: Voter, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: bool = False) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. With ``keep``: the rows predicted 1, with all columns of ``docs``,
    whatever their names.

    Null and empty texts are scored as texts without words; a null id is never held out. Other columns are not read. Rows that
    repeat are scored each; an empty table gives no rows.
    """
    box = docs.sparkSession.sparkContext.broadcast(voter)

    def make():
        voter = box.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(batch.schema.get_field_index(text_col) if keep else 1)
            counts = np.array([term_counts(x.as_py() or "") for x in texts], np.float32).reshape(-1, TERMS)
            found = voter.scores(counts)
            if keep:
                return batch.filter(pa.array(found >= threshold))
            crc = [zlib.crc32(str(x.as_py()).encode()) % 5 == 0 if x.is_valid else False for x in batch.column(0)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc, pa.bool_()), pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

        return step

    if keep:
        return map_batches(docs, make, docs.schema, PIECE)
    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"cast(`{text_col}` AS string) AS text")
    return map_batches(rows, make, f"doc_id {id_type(rows, 'doc_id')}, held_out boolean, score double, predicted int", PIECE)
