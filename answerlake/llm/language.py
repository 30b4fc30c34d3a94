"""Language of texts from character n-grams in bit-sliced Bloom filters.

Learning counts the n-grams (three code points of a lower-cased letter run with a blank
before and after; of Han, kana and Hangul, whose runs are whole clauses, single letters)
of all labelled texts per language. A language's filter holds its most frequent n-grams,
as many as make up ``COVERED`` of 100 of its occurrences, with all that are as frequent as
the last of them (counts that differ by less than one in ``STEPS`` are one frequency). So
the size of a filter follows the language's alphabet, not the corpus; two languages are
told apart by the letters of wide scripts that only one of them uses often. The filters are
sliced by bit: row b of one table has a bit for each language whose filter has bit b set,
and the AND of an n-gram's rows is the mask of all languages that may contain it.

A text's hits are counted per language (one popcount for each language over its n-grams'
masks), freed from the false positives that the filter's load leads one to expect,
``(hits / n - f) / (1 - f)``, and the language with the most is predicted. The score is
that share, 0 to 1.

Cases: null texts and texts without a letter are ``und`` with score 0; texts of which no
n-gram is known get the language with most learned n-grams and score 0; ties go to the first
name; rows without language or text teach nothing; without any labelled text all are
``und``. Repeated rows are predicted each; null ids are not held out. Only the text is an
input of a prediction.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerlake.llm import query
from answerlake.llm.common import col, per_text, table
from answerlake.runtime import cut_lineage

COVERED, STEPS, BITS_PER_GRAM, HASHES = 99, 64, 16, 4
WORD_CACHE = 200_000
_letters = re.compile(r"[^\W\d_]+")


# First and last code points of scripts without blanks between words, or of
# whole syllables: Han and kana with their radicals and extensions, Hangul.
WIDE = np.array([(0x2E80, 0xA4CF), (0xAC00, 0xD7FF), (0xF900, 0xFAFF), (0xFF66, 0xFFDC), (0x1B000, 0x1B16F),
                 (0x20000, 0x3FFFF)], np.int64)


def words_of(text) -> list:
    return _letters.findall(text.lower()) if text else []


def grams_of(words: list) -> tuple:
    """All n-grams of the words as numbers, and the position of the word of each."""
    codes = np.frombuffer(f" {'  '.join(words)} ".encode("utf-32-le"), "<u4").astype(np.int64)
    gram = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    if codes.max() >= WIDE[0, 0]:
        at = np.searchsorted(WIDE[:, 0], codes[1:-1], "right") - 1
        wide = (at >= 0) & (codes[1:-1] <= WIDE[at, 1])
        gram[wide] = codes[1:-1][wide] << 21
    # words are parted by two blanks; n-grams with both of them belong to no word
    blank = codes == 32
    own = ~((blank[:-2] & blank[1:-1]) | (blank[1:-1] & blank[2:]))
    word = np.cumsum(blank[:-1] & ~blank[1:]) - 1
    return gram[own], word[:-1][own]


def _count():
    """Batches (text, lang) to the n-grams of each language with their counts."""
    def work(batches):
        for batch in batches:
            by = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                times = by.setdefault(lang, {})
                for w in words_of(text):
                    times[w] = times.get(w, 0) + 1
            for lang, times in by.items():
                if not times:
                    continue
                grams, word = grams_of(list(times))
                different, at = np.unique(grams, return_inverse=True)
                n = np.bincount(at, np.array(list(times.values()), np.float64)[word]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(different), pa.string()), pa.array(different), pa.array(n)],
                    names=["lang", "gram", "n"])
    return work


class Filters:
    """Bit-sliced Bloom filters of several languages."""

    def __init__(self, languages: list, grams: list, largest: str = None):
        """``grams`` has the sorted n-grams of each language."""
        self.languages, self.largest = languages, largest
        most = max((len(g) for g in grams), default=0)
        self.size = 1 << max(6, int(BITS_PER_GRAM * most).bit_length())
        self.rows = np.zeros((self.size, -(-len(languages) // 64) or 1), np.uint64)
        for i, own in enumerate(grams):
            for at in self._places(np.asarray(own, np.int64)):
                self.rows[at, i // 64] |= np.uint64(1 << (i % 64))
        load = [float(((self.rows[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean())
                for i in range(len(languages))]
        self.false = np.array(load) ** HASHES

    @classmethod
    def of(cls, state: dict) -> "Filters":
        """From the dictionary of another one's fields, as a broadcast carries it."""
        new = cls.__new__(cls)
        new.__dict__.update(state)
        return new

    def _places(self, grams):
        h = grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        step = (h >> np.uint64(32)) | np.uint64(1)
        return [((h + np.uint64(k) * step) & np.uint64(self.size - 1)).astype(np.int64) for k in range(HASHES)]

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram the bitmask of the languages that may contain it."""
        places = self._places(grams)
        out = self.rows[places[0]]
        for at in places[1:]:
            out = out & self.rows[at]
        return out

    def hits(self, words: list) -> np.ndarray:
        """For each word the number of its n-grams and, per language, how many hit."""
        grams, word = grams_of(words)
        masks, out = self.masks(grams), np.empty((len(words), len(self.languages) + 1), np.int64)
        out[:, 0] = np.bincount(word, minlength=len(words))
        for i in range(len(self.languages)):
            bit = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            out[:, i + 1] = np.bincount(word, bit.astype(np.float64), minlength=len(words))
        return out


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", covered: int = COVERED) -> Filters:
    counts = (docs.select(col(text).cast("string").alias("text"), col(lang).cast("string").alias("lang"))
              .dropna().mapInArrow(_count(), "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
              .withColumn("step", F.floor(F.log2("n") * STEPS).cast("int")))
    counts = cut_lineage(counts, "grams")
    # a language has at most 64 * STEPS frequencies
    steps = counts.groupBy("lang", "step").agg(F.sum("n").cast("decimal(38,0)").alias("n"))
    more = Window.partitionBy("lang").orderBy(F.desc("step"))
    whole = Window.partitionBy("lang")
    least = (steps.withColumn("before", F.sum("n").over(more) - F.col("n")).withColumn("total", F.sum("n").over(whole))
             .where(100 * F.col("before") < covered * F.col("total"))
             .groupBy("lang").agg(F.min("step").alias("least"), F.max("total").alias("total")))
    kept = (counts.join(least, "lang").where("step >= least")
            .select("lang", "gram", F.col("total").cast("long").alias("total")).toArrow())
    by = {}
    for lang_, gram, n in zip(*[c.to_pylist() for c in kept.columns]):
        by.setdefault((-n, lang_), []).append(gram)
    order = sorted(by, key=lambda k: k[1])
    return Filters([name for _, name in order], [sorted(by[k]) for k in order],
                   min(by)[1] if by else None)


def _predict(state):
    def fn():
        filters = Filters.of(state.value)
        languages, false = filters.languages, filters.false
        known, matrix = {}, np.empty((0, len(languages) + 1), np.int64)

        def one(words):
            nonlocal matrix
            if len(known) > WORD_CACHE:
                known.clear()
            new, used = list({w for w in words if w not in known}), len(known)
            if used + len(new) > len(matrix):  # grown by doubling
                matrix = np.concatenate([matrix[:used], np.empty((used + 2 * len(new), matrix.shape[1]), np.int64)])
            if new:
                matrix[used:used + len(new)] = filters.hits(new)
                known.update(zip(new, range(used, used + len(new))))
            total = matrix[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(axis=0)
            share = np.clip((total[1:] / total[0] - false) / np.maximum(1 - false, 1e-9), 0, 1)
            best = int(np.argmax(share))
            return (languages[best], float(share[best])) if share[best] > 0 else (filters.largest, 0.0)

        def apply(texts):
            out = []
            for text in texts:
                words = words_of(text.decode("utf-8", "replace")) if text else []
                out.append(one(words) if words and languages else ("und", 0.0))
            return {"lang_pred": pa.array([x for x, _ in out], pa.string()),
                    "score": pa.array([y for _, y in out], pa.float64())}
        return apply
    return fn


def predict(docs: DataFrame, filters: Filters, key: str = "doc_id", text: str = "text", keep: dict = None) -> DataFrame:
    """One row per document: key, ``keep`` columns, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(filters))
    return per_text(docs, text, _predict(sent), "lang_pred string, score double", {key: col(key), **(keep or {})})


@query("op7_language_id")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    filters = learn(docs.where(~held_out))
    return predict(docs, filters, keep={"held_out": held_out}).select("doc_id", "held_out", "lang_pred", "score")
