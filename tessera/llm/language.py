"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1; an n-gram is bound as the product of its letters' vectors, each
rolled by its place; a text's vector is the sum (bundle) of its n-grams' vectors; a language's prototype is
the bundle of its training texts. Texts go to the prototype with the largest cosine.

Vectors come from a hash of the letter, so every task makes the same ones; only prototypes, of languages x
dimensions numbers, pass the driver. Prototypes are centred on their mean, which all languages share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held_out, staged

DIMENSIONS = 1024
GRAM = 3
#: Labelled texts of a language that its prototype is bundled from, as an expected number; more are thinned by a hash of the id.
MAX_TRAINING = 5_000
#: Bytes of prototypes that a driver and a task can hold; a model of more is refused, none of its languages left out.
MAX_MODEL = 1 << 29
UNKNOWN = "und"
#: Code points of a batch that are turned into n-grams at once, and n-gram vectors multiplied at once.
CHUNK, GRAMS_AT_ONCE = 1 << 20, 1 << 12


def letter_vector(code: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=code + 1)).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1


class Bundler:
    """Turns texts into bundles; keeps letter vectors and letter tests of the code points it has met."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.rolled: dict[int, list[np.ndarray]] = {}
        self.letters = np.zeros(0x110000, bool)
        self.known = np.zeros(0x110000, bool)

    def _vector(self, gram: int) -> np.ndarray:
        out = np.ones(self.dimensions, np.int8)
        for place in range(GRAM):
            code = gram >> 21 * (GRAM - 1 - place) & 0x1FFFFF
            if code not in self.rolled:
                self.rolled[code] = [np.roll(letter_vector(code, self.dimensions), GRAM - 1 - p) for p in range(GRAM)]
            out = out * self.rolled[code][place]
        return out

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """Distinct n-grams of the lower-cased letters, with one blank for each run of other characters; counts; whether there is a letter."""
        found, counts, any_letter, tail = [], [], False, np.array([32], np.int64)
        for at in range(0, len(text), CHUNK):
            codes = np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            new = np.unique(codes[~self.known[codes]])
            self.letters[new] = [chr(c).isalpha() for c in new]
            self.known[new] = True
            letter = self.letters[codes]
            any_letter |= bool(letter.any())
            codes = np.concatenate([tail, np.where(letter, codes, 32)])
            codes = codes[np.append(True, (codes[1:] != 32) | (codes[:-1] != 32))]
            if at + CHUNK >= len(text) and codes[-1] != 32:
                codes = np.append(codes, 32)
            if len(codes) >= GRAM:
                packed = codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]
                g, n = np.unique(packed, return_counts=True)
                found.append(g)
                counts.append(n)
            tail = codes[-(GRAM - 1) :]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), any_letter
        if len(found) == 1:
            return found[0], counts[0], any_letter
        g, inverse = np.unique(np.concatenate(found), return_inverse=True)
        return g, np.bincount(inverse, np.concatenate(counts)).astype(np.int64), any_letter

    def bundles(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """A row for each text, scaled to length 1 (zeros without n-grams), and which texts have a letter."""
        parts = [self.grams(t or "") for t in texts]
        out = np.zeros((len(texts), self.dimensions), np.float32)
        sizes = [len(p[0]) for p in parts]
        if sum(sizes):
            names, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            counts = np.concatenate([p[1] for p in parts]).astype(np.float32)
            rows = np.repeat(np.arange(len(texts)), sizes)
            for at in range(0, len(names), GRAMS_AT_ONCE):
                here = (inverse >= at) & (inverse < at + GRAMS_AT_ONCE)
                table = np.zeros((len(texts), min(GRAMS_AT_ONCE, len(names) - at)), np.float32)
                table[rows[here], inverse[here] - at] = counts[here]
                out += table @ np.stack([self._known_vector(int(g)) for g in names[at : at + GRAMS_AT_ONCE]]).astype(np.float32)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0), np.array([p[2] for p in parts], bool)

    def _known_vector(self, gram: int) -> np.ndarray:
        vector = _VECTORS.get((self.dimensions, gram))
        if vector is None:
            if len(_VECTORS) >= 1 << 16:
                _VECTORS.clear()
            vector = _VECTORS[self.dimensions, gram] = self._vector(gram)
        return vector


#: Vectors of n-grams, kept over the batches of a worker; at most 65,536.
_VECTORS: dict[tuple[int, int], np.ndarray] = {}


def _in_parts(batch: pa.RecordBatch, rows: int = 64) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def train(docs: DataFrame, max_training: int = MAX_TRAINING, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their centred prototypes, from text and lang of the rows given; every language that has a row gets one."""
    labelled = docs.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    shares = staged(labelled.groupBy("lang").agg(F.least(F.lit(1.0), max_training / F.count(F.lit(1))).alias("share")).withColumnRenamed("lang", "shared_lang"), "language-shares")
    if shares.count() * dimensions * 8 > MAX_MODEL:
        raise ValueError(f"the prototypes of {shares.count()} languages take more than {MAX_MODEL} bytes")
    labelled = labelled.join(F.broadcast(shares), F.col("lang") == F.col("shared_lang")).filter(F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler, sums = Bundler(dimensions), {}
        for batch in batches:
            for part in _in_parts(batch):
                vectors, _ = bundler.bundles(part.column("text").to_pylist())
                for lang, vector in zip(part.column("lang").to_pylist(), vectors, strict=True):
                    total = sums.setdefault(lang, np.zeros(dimensions + 1))
                    total[:-1] += vector
                    total[-1] += 1
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "bundle"])

    parts = labelled.select("text", "lang").mapInArrow(run, "lang string, bundle array<double>")
    summed = parts.select("lang", F.posexplode("bundle").alias("place", "value")).groupBy("lang", "place").agg(F.sum("value").alias("value"))
    rows = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("bundle")).select("lang", "bundle.value")
    rows = sorted(rows.collect(), key=lambda r: r.lang)
    prototypes = np.array([r.value[:-1] for r in rows], np.float64).reshape(len(rows), dimensions)
    prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)
    if len(rows) > 1:
        prototypes -= prototypes.mean(0)
    return [r.lang for r in rows], prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)


def identify(docs: DataFrame, languages: list[str], prototypes: np.ndarray) -> DataFrame:
    """doc_id, lang_pred and score (the cosine, moved to 0 to 1) for every row.

    ``und`` with score 0 for null texts, texts without a letter, and where the model has no language. Whole
    texts are read, in chunks; equal cosines go to the first language by name; repeated rows stay.
    """
    dimensions = prototypes.shape[1]
    matrix = prototypes.astype(np.float32).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler = Bundler(dimensions)
        for batch in batches:
            for part in _in_parts(batch):
                vectors, letters = bundler.bundles(part.column("text").to_pylist())
                if languages:
                    cosines = vectors @ matrix
                    best = cosines.argmax(1)
                    names = [languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
                    scores = np.where(letters, np.clip((1 + cosines[np.arange(len(best)), best]) / 2, 0, 1), 0).astype(float)
                else:
                    names, scores = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_digest(docs: DataFrame) -> DataFrame:
    languages, prototypes = train(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs, languages, prototypes).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
