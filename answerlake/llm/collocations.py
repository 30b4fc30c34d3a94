"""Phrases whose words occur together more often than apart, for each language.

Texts have A-Z lower-cased and are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those
into words ``[^\\x20\\x09]+``. f(phrase) is the number of its contiguous occurrences inside
pieces, overlaps included; n is the number of words of the language. Phrases of two and
three words with a = f(phrase) >= ``least`` are candidates. A cut after k words gives
l = f(first part), r = f(rest) and floor(1000000 * a * a / (l * r)); the lowest of a
candidate counts (ties: the smallest k). A candidate goes if its words lie inside a longer
candidate with 100 * f(longer) >= ``inside`` * a. Ranks follow score and a, both falling,
then the phrase in byte order.

The layout is that of external stream estimation; no task holds a table of phrases:

1. A task turns its tokens into numbers and sorts the runs of one and two words of each
   ``CHUNK`` tokens; equal runs are adjacent, so what leaves the task are sorted streams of
   (phrase, count). Spark merges the streams of all tasks into one count per phrase.
2. A phrase of three words has at least ``least`` occurrences only if both pairs in it have.
   The frequent pairs go into a bit table of at most ``MAX_BITS`` bits; the texts are read
   again and only triples that it admits are counted. The bits only save work: triples of
   rare pairs are cut by their own exact counts, so a full table changes no result.
3. The streams of frequent phrases are kept twice, sorted by their words from the left
   (prefix order) and from the right (suffix order). Left counts and extensions to the right
   come from merge joins of prefix streams, right counts and extensions to the left from
   merge joins of suffix streams; every join is a sort-merge join, whose two readers advance
   in lockstep, and a hot word is split by adaptive execution.

All numbers are exact: scores are divided as decimals of 38 digits.

Cases: null and empty texts have no words; a null language is ``und`` and shares the rows of
that language; a very long text is counted in chunks; repeated rows count as often as they
occur; an empty table gives no rows; other columns are not read.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlake.llm import query
from answerlake.llm.common import col, table, utf8
from answerlake.runtime import cut_lineage, remove_folder, shared_dir, top_n

LEAST, INSIDE, FIRST = 10, 50, 2000
CHUNK = 1 << 20
BITS_A_PAIR, MIN_BITS, MAX_BITS, PROBES = 16, 1 << 16, 1 << 29, 2
END = b"\xff"  # is in no UTF-8 text
#: lower-cases A-Z and turns every byte that ends a piece into END
PIECES = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


class _Numbers(dict):
    """Numbers of words in order of first use."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


class _Chunk:
    """Tokens of one language as numbers; 0 ends a piece."""

    def __init__(self):
        self.numbers, self.parts, self.size = _Numbers(), [], 0
        self.numbers[END]

    def add(self, text: bytes):
        tokens = text.translate(PIECES).replace(END, b" \xff ").split()
        tokens.append(END)
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, tokens), np.int64, len(tokens)))
        self.size += len(tokens)

    def words(self) -> pa.Array:
        return pa.array(list(self.numbers), pa.binary())

    def runs(self, length: int):
        """Codes of the runs of ``length`` words, sorted, and their counts."""
        ids, base = np.concatenate(self.parts), len(self.numbers)
        code, whole = ids, ids > 0
        for k in range(1, length):
            code = code[:-1] * base + ids[k:]
            whole = whole[:-1] & (ids[k:] > 0)
        return np.unique(code[whole], return_counts=True)

    def split(self, codes, length: int) -> list:
        """The numbers of the words of each run."""
        base, out = len(self.numbers), []
        for _ in range(length):
            out.append(codes % base)
            codes = codes // base
        return out[::-1]


def _slices(text: bytes):
    """A text in slices of at most about 4 * CHUNK bytes, cut where a piece ends if one does."""
    start, width = 0, 4 * CHUNK
    while len(text) - start > width:
        end = max(text.rfind(c, start, start + width) for c in (b"\n", b".", b",", b";", b"!", b"?", b":"))
        if end < start:
            break
        yield text[start:end + 1]
        start = end + 1
    yield text[start:]


def _counted(emit):
    """Batches (lang, text) to what ``emit(lang, chunk)`` yields for each chunk of tokens."""
    def work(batches):
        chunks, held = {}, 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                for part in _slices(text or b""):
                    chunk = chunks.get(lang)
                    if chunk is None:
                        chunk = chunks[lang] = _Chunk()
                    before = chunk.size
                    chunk.add(part)
                    held += chunk.size - before
                    if held >= CHUNK:
                        for name, full in chunks.items():
                            yield from emit(name, full)
                        chunks, held = {}, 0
        for name, full in chunks.items():
            yield from emit(name, full)
    return work


def _rows(lang, words, parts, times):
    """A batch lang, w1, w2, w3, f; words that are not there are null."""
    n = len(times)
    text = [pc.take(words, pa.array(p)).cast(pa.string()) for p in parts]
    text += [pa.nulls(n, pa.string())] * (3 - len(parts))
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * n, pa.string()), *text, pa.array(times, pa.int64())],
        names=["lang", "w1", "w2", "w3", "f"])


def _short_runs(lang, chunk):
    words = chunk.words()
    for length in (1, 2):
        codes, times = chunk.runs(length)
        yield _rows(lang, words, chunk.split(codes, length), times)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _marks(lang, words: list, parts, bits: int) -> list:
    """The places of pairs of words in the bit table, one array for each probe."""
    of = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
    code = _mixed(of[parts[0]] * np.uint64(0x9E3779B97F4A7C15) + _mixed(of[parts[1]] ^ seed))
    return [(_mixed(code + np.uint64(p)) & np.uint64(bits - 1)).astype(np.int64) for p in range(PROBES)]


def _bit_table(pairs: DataFrame, bits: int):
    """The marks of frequent pairs, set by all tasks and merged in words of 64 bits."""
    def work(batches):
        for batch in batches:
            langs, first, second = batch.column(0).to_pylist(), utf8(batch.column(1)), utf8(batch.column(2))
            by = {}
            for i, lang in enumerate(langs):
                by.setdefault(lang, []).append(i)
            places = [np.empty(0, np.int64)]
            for lang, rows in by.items():
                words, at = [first[i] for i in rows] + [second[i] for i in rows], np.arange(len(rows))
                places += _marks(lang, words, [at, at + len(rows)], bits)
            place = np.unique(np.concatenate(places))
            yield pa.RecordBatch.from_arrays(
                [pa.array(place >> 6), pa.array(np.left_shift(np.uint64(1), (place & 63).astype(np.uint64)).view(np.int64))],
                names=["word", "bits"])

    rows = (pairs.select("lang", "w1", "w2").mapInArrow(work, "word long, bits long")
            .groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow())
    out = np.zeros(bits >> 6, np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return pairs.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def _long_runs(marks, bits):
    """Triples, both of whose pairs the bit table admits."""
    def admitted(lang, words, parts):
        ok = np.ones(len(parts[0]), bool)
        for place in _marks(lang, words, parts, bits):
            ok &= (marks.value[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
        return ok

    def emit(lang, chunk):
        words = list(chunk.numbers)
        pairs, _ = chunk.runs(2)
        # pairs are sorted, so a triple finds its pairs by search in them
        ok = admitted(lang, words, chunk.split(pairs, 2)) if len(pairs) else np.empty(0, bool)
        pairs = pairs[ok]
        ids, base = np.concatenate(chunk.parts), len(words)
        if not len(pairs) or len(ids) < 3:
            return
        pair = ids[:-1] * base + ids[1:]
        at = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
        good = (pairs[at] == pair) & (ids[:-1] > 0) & (ids[1:] > 0)
        both = good[:-1] & good[1:]
        codes, times = np.unique(pair[:-1][both] * base + ids[2:][both], return_counts=True)
        if len(codes):
            yield _rows(lang, chunk.words(), chunk.split(codes, 3), times)
    return emit


COUNTS = "lang string, w1 string, w2 string, w3 string, f long"
WORDS = ["w1", "w2", "w3"]


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang", *WORDS).agg(F.sum("f").alias("f"))


def _merge(stream: DataFrame, other: DataFrame, on: list, how: str = "inner") -> DataFrame:
    """Two sorted streams read in lockstep."""
    return stream.join(other.hint("merge"), on, how)


def _score(a, l, r):
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(l) * wide(r))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST,
                 inside: int = INSIDE, first: int = FIRST) -> DataFrame:
    """One row per kept phrase: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    folder, result = shared_dir(spark, "collocations"), shared_dir(spark, "collocations-ranked")
    given = docs.select(F.coalesce(col(lang).cast("string"), F.lit("und")).alias("lang"),
                        col(text).cast("string").alias("text"))
    # 1: counts of words and pairs; rare pairs are in no candidate
    short = _summed(given.mapInArrow(_counted(_short_runs), COUNTS))
    short = cut_lineage(short.where(F.col("w2").isNull() | (F.col("f") >= least)), "short", folder)
    words = short.where(F.col("w2").isNull()).select("lang", F.col("w1").alias("w"), "f")
    pairs = short.where(F.col("w2").isNotNull()).select("lang", "w1", "w2", F.col("f").alias("a"))
    total = cut_lineage(words.groupBy("lang").agg(F.sum("f").alias("n")), "total", folder)
    # 2: triples of frequent pairs
    bits = min(max(MIN_BITS, 1 << (BITS_A_PAIR * pairs.count()).bit_length()), MAX_BITS)
    marks = _bit_table(pairs, bits)
    triples = cut_lineage(_summed(given.mapInArrow(_counted(_long_runs(marks, bits)), COUNTS))
                          .where(F.col("f") >= least).withColumnRenamed("f", "a"), "triples", folder)
    words = words.where(F.col("f") >= least)
    # 3: prefix streams give left counts and extensions to the right, suffix streams the others
    one = lambda w, f: words.select("lang", F.col("w").alias(w), F.col("f").alias(f))
    two = lambda v, w, f: pairs.select("lang", F.col("w1").alias(v), F.col("w2").alias(w), F.col("a").alias(f))
    longer = lambda v, w, out: cut_lineage(
        triples.groupBy("lang", F.col(v).alias("w1"), F.col(w).alias("w2")).agg(F.max("a").alias(out)), out, folder)
    prefix = _merge(pairs, one("w1", "l1"), ["lang", "w1"])
    prefix = _merge(prefix, longer("w1", "w2", "to_right"), ["lang", "w1", "w2"], "left")
    suffix = _merge(prefix, one("w2", "r1"), ["lang", "w2"])
    suffix = _merge(suffix, longer("w2", "w3", "to_left"), ["lang", "w1", "w2"], "left")
    most = F.greatest(F.coalesce("to_right", F.lit(0)), F.coalesce("to_left", F.lit(0)))
    of_two = suffix.where((most == 0) | (100 * most < inside * F.col("a"))).select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a",
        F.col("l1").alias("l"), F.col("r1").alias("r"), _score("a", "l1", "r1").alias("score"))
    prefix = _merge(triples, one("w1", "l1"), ["lang", "w1"])
    prefix = _merge(prefix, two("w1", "w2", "l2"), ["lang", "w1", "w2"])
    suffix = _merge(prefix, two("w2", "w3", "r1"), ["lang", "w2", "w3"])
    suffix = _merge(suffix, one("w3", "r2"), ["lang", "w3"])
    cut = F.least(F.struct(_score("a", "l1", "r1").alias("score"), F.lit(1).alias("k"), F.col("l1").alias("l"), F.col("r1").alias("r")),
                  F.struct(_score("a", "l2", "r2").alias("score"), F.lit(2).alias("k"), F.col("l2").alias("l"), F.col("r2").alias("r")))
    of_three = suffix.withColumn("cut", cut).select(
        "lang", F.concat_ws(" ", *WORDS).alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    kept = top_n(cut_lineage(of_two.unionByName(of_three), "phrases", folder), ["lang"], order, first, ["phrase"], "rank")
    kept.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase",
                                    "a", "l", "r", "n", "score").write.parquet(result)
    marks.unpersist()
    remove_folder(spark, folder)  # the result reads none of its tables
    return spark.read.parquet(result)


SQL = r"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
c AS (SELECT lang, m, g, count(*) AS f FROM (
        SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS g FROM (
          SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (VALUES (1), (2), (3)) AS v(m))) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, g, f AS a, string_split(g, ' ') AS w FROM c WHERE m > 1 AND f >= 10),
cuts AS (SELECT x.lang, x.g, x.a, k, y.f AS l, z.f AS r,
                (1000000::HUGEINT * x.a * x.a // (y.f::HUGEINT * z.f))::BIGINT AS score
         FROM (SELECT *, array_to_string(w[1:k], ' ') AS left_part, array_to_string(w[k+1:m], ' ') AS right_part
               FROM cand, (VALUES (1), (2)) AS v(k) WHERE k < m) x
         JOIN c y ON y.lang = x.lang AND y.g = left_part AND y.m = k
         JOIN c z ON z.lang = x.lang AND z.g = right_part AND z.m = x.m - k),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
longer AS (SELECT lang, g, max(f) AS f FROM (
             SELECT lang, array_to_string(w[1:2], ' ') AS g, a AS f FROM cand WHERE m = 3
             UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM cand WHERE m = 3) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.g) AS rank,
       b.g AS phrase, a, l, r, n.n, score
FROM best b JOIN n ON n.lang = b.lang LEFT JOIN longer x ON x.lang = b.lang AND x.g = b.g
WHERE x.f IS NULL OR 100 * x.f < 50 * a
QUALIFY rank <= 2000"""


@query("op13_phrase_collocations", SQL)
def op13(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))
