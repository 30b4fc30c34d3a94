"""Benchmark passages in training documents, found with a suffix automaton.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.
A window is a run of ``width`` consecutive words of an item; an item of fewer
words, but not none, is one window. Document words inside any occurrence of any
window are hit.

The items' word runs are put into one generalised suffix automaton; a document's
words are streamed through it, keeping the longest match that ends at each word.
A match of ``width`` words or more ends a window there; marked states tell where a
short item may end. Items are cut to overlapping pieces and dealt to blocks of
about ``BLOCK_BYTES``, and the documents pass one automaton after the other, so
neither the driver nor a task ever holds more than a block of items.

Cases: null texts and texts without words have counts 0 and are not contaminated;
items without words have no window; items of one id are one item; a null item id
counts as one item named ``''``; an empty benchmark hits nothing; repeated
documents are judged each. Other columns travel along in a struct.
"""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlake.llm import query
from answerlake.llm.common import ALNUM_LOWER, col, slices, table, utf8
from answerlake.runtime import cut_lineage

WIDTH = 10
BLOCK_BYTES = 1 << 20
PIECE_WORDS = 20_000
MAX_COVERAGE_PCT = 50
ROWS = 1000  # rows that a task holds at once

_word = re.compile(rb"[^ ]+")
FOUND = "n_words long, spans array<long>, items array<string>"


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, pieces: list, width: int):
        self.width, self.vocabulary = width, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        self.owners = {}
        ends = []
        for item, words in pieces:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            size, at = min(width, len(ids)), 0
            for i, c in enumerate(ids):
                at = self._extend(at, c)
                if i + 1 >= size:
                    self.owners.setdefault(tuple(ids[i + 1 - size:i + 1]), set()).add(item)
            if len(ids) < width:
                ends.append(at)
        self.short_sizes = sorted({len(w) for w in self.owners if len(w) < width})
        # a short item may end in a state when it, or a state that its suffix links lead to, is marked
        self.short_end = [False] * len(self.next)
        for s in ends:
            self.short_end[s] = True
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.short_end[s] = self.short_end[s] or self.short_end[self.link[s]]

    def _state(self, length, moves, link):
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p, c, q):
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last, c):
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def matches(self, words: list) -> tuple:
        """Flat (start, end) word positions of the windows that occur, and their items."""
        ids = list(map(self.vocabulary.get, words))
        next_, link, length, short_end = self.next, self.link, self.length, self.short_end
        width, spans, items = self.width, [], set()
        state = matched = 0
        for i, c in enumerate(ids):
            if c is None:
                state = matched = 0
                continue
            moves = next_[state]
            while c not in moves and state:
                state = link[state]
                matched, moves = length[state], next_[state]
            if c in moves:
                state = moves[c]
                matched += 1
            if matched >= width:
                self._take(ids, i, width, spans, items)
            if short_end[state]:
                for size in self.short_sizes:
                    if size <= matched and tuple(ids[i + 1 - size:i + 1]) in self.owners:
                        self._take(ids, i, size, spans, items)
        return spans, items

    def _take(self, ids, i, size, spans, items):
        start = i + 1 - size
        items |= self.owners[tuple(ids[start:i + 1])]
        if spans and start <= spans[-1] and start >= spans[-2]:
            spans[-1] = max(spans[-1], i + 1)
        else:
            spans += (start, i + 1)


def words_of(text: bytes) -> list:
    return text.translate(ALNUM_LOWER).split()


def merged(spans: list) -> list:
    """Sorted disjoint (start, end) pairs covering the flat spans."""
    out = []
    for s, e in sorted(zip(spans[::2], spans[1::2])):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def cut(text: bytes, spans: list) -> bytes:
    """The text without the words of the merged spans and what stands between them."""
    places = [m.span() for m in _word.finditer(text.translate(ALNUM_LOWER))]
    parts, at = [], 0
    for s, e in spans:
        parts.append(text[at:places[s][0]])
        at = places[e - 1][1]
    return b"".join([*parts, text[at:]])


def item_blocks(items: DataFrame, item_id: str, text: str, width: int) -> list:
    """The items as lists of (id, words), one bounded list a block."""
    def pieces(batches):
        for batch in batches:
            ids, texts = [], []
            for i, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                words = words_of(t or b"")
                for k in range(0, max(1, len(words) - width + 1), PIECE_WORDS - width + 1):
                    if words:
                        ids.append(i)
                        texts.append(b" ".join(words[k:k + PIECE_WORDS]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(texts, pa.binary())], names=["item", "words"])

    named = items.select(F.coalesce(col(item_id).cast("string"), F.lit("")).alias("item"),
                         col(text).cast("string").alias("text"))
    cut_up = cut_lineage(named.mapInArrow(pieces, "item string, words binary").distinct(), "items")
    size = cut_up.agg(F.sum(F.octet_length("words") + F.octet_length("item"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    for b in range(blocks):
        rows = cut_up.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b).collect()
        yield sorted((r.item, bytes(r.words).split()) for r in rows)


def _pass(block, width, last, remove):
    """Batches (carried, text, spans, items) with the block's matches added.

    With ``remove`` the last pass also cuts the spans, and cuts again what this block
    matches where the rest has joined up.
    """
    def work(batches):
        automaton = Automaton(block.value, width) if block else None
        for batch in slices(batches, ROWS):
            texts = utf8(batch.column(1))
            counts, spans, items, clean = [], [], [], []
            for text, s, i in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = words_of(text or b"")
                new_s, new_i = automaton.matches(words) if automaton else ([], set())
                pairs = merged(s + new_s)
                counts.append(len(words))
                spans.append([x for pair in pairs for x in pair])
                items.append(sorted(set(i) | new_i))
                while remove and pairs:
                    text = cut(text, pairs)
                    pairs = merged(automaton.matches(words_of(text))[0])
                clean.append(text)
            arrays = {"carried": batch.column(0),
                      "text": pa.array(clean, pa.binary()).cast(pa.string()) if remove else batch.column(1),
                      "n_words": pa.array(counts, pa.int64()),
                      "spans": pa.array(spans, pa.list_(pa.int64())),
                      "items": pa.array(items, pa.list_(pa.string()))}
            if not last:
                del arrays["n_words"]
            elif not remove:
                del arrays["text"]
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))
    return work


def _searched(docs: DataFrame, blocks: list, text: str, keep: dict, width: int, remove: bool) -> DataFrame:
    """The documents after a pass for each block of items."""
    carried = F.struct(*[c.alias(n) for n, c in (keep or {"_": F.lit(1)}).items()])
    state = docs.select(carried.alias("carried"), col(text).cast("string").alias("text"),
                        F.array().cast("array<long>").alias("spans"),
                        F.array().cast("array<string>").alias("items"))
    kind = state.schema["carried"].dataType.simpleString()
    for block in blocks[:-1]:
        state = cut_lineage(state.mapInArrow(
            _pass(block, width, False, False),
            f"carried {kind}, text string, spans array<long>, items array<string>"), "hits")
    found = state.mapInArrow(_pass(blocks[-1] if blocks else None, width, True, remove),
                             f"carried {kind}, {'text string, ' if remove else ''}{FOUND}")
    names = [c for c in found.columns if c not in ("carried", "text")]
    clean = [F.col("text").alias("clean")] if remove else []
    return found.select(*[F.col("carried").getField(n).alias(n) for n in keep or {}], *clean, *names)


def _sent(docs: DataFrame, items: DataFrame, item_id: str, item_text: str, width: int) -> list:
    """A broadcast for each block of items."""
    return [docs.sparkSession.sparkContext.broadcast(b) for b in item_blocks(items, item_id, item_text, width)]


def benchmark_hits(docs: DataFrame, items: DataFrame, text: str = "text", keep: dict = None,
                   item_id: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """Per document the ``keep`` columns, n_words, spans and item ids.

    ``spans`` has flat (start, end) word positions, merged and in order.
    """
    return _searched(docs, _sent(docs, items, item_id, item_text, width), text, keep, width, False)


def _n_hit():
    pairs = F.sequence(F.lit(0), F.floor(F.size("spans") / 2).cast("int") - 1)
    width = F.aggregate(pairs, F.lit(0).cast("long"),
                        lambda n, k: n + F.col("spans")[2 * k + 1] - F.col("spans")[2 * k])
    return F.when(F.size("spans") == 0, F.lit(0).cast("long")).otherwise(width)


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                  **options) -> DataFrame:
    """One row per document: key, n_words, n_hit, n_items, items_sha256, contaminated, spans, items."""
    found = benchmark_hits(docs, items, text, {"doc_key": col(key)}, **options)
    return found.select(
        F.col("doc_key").alias(key), "n_words", _n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"), "spans", "items")


def remove_benchmark(docs: DataFrame, items: DataFrame, text: str = "text", n_chars: str = "n_chars",
                     max_coverage_pct: int = MAX_COVERAGE_PCT, item_id: str = "item_id",
                     item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """The documents without their hit words; same columns.

    A document of which more than ``max_coverage_pct`` of 100 words are hit goes.
    Cutting a span joins what stood around it, so texts are cut until nothing is hit;
    where there are several blocks of items, those that were cut are searched again by all.
    """
    keep = {f"given_{i}": col(c) for i, c in enumerate(docs.columns)}
    blocks = _sent(docs, items, item_id, item_text, width)

    def cleaned(rest, most):
        found = _searched(rest, blocks, text, keep, width, True).where(100 * _n_hit() <= most * F.col("n_words"))
        return found if len(blocks) < 2 else cut_lineage(found, "decontaminated")

    def columns(found):
        hit = F.size("spans") > 0
        out = []
        for i, f in enumerate(docs.schema):
            value = F.col(f"given_{i}")
            if f.name == text:
                value = F.when(hit, F.col("clean")).otherwise(value)
            elif f.name == n_chars:
                value = F.when(hit, F.char_length("clean").cast(f.dataType)).otherwise(value)
            out.append(value.alias(f.name))
        return found.select(*out)

    found = cleaned(docs, max_coverage_pct)
    if len(blocks) < 2:
        return columns(found)
    result = columns(found.where(F.size("spans") == 0))
    while True:
        rest = columns(found.where(F.size("spans") > 0))
        if rest.isEmpty():
            return result
        found = cleaned(rest, 100)
        result = result.unionByName(columns(found.where(F.size("spans") == 0)))


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
sized AS (SELECT item, words, least(len(words), {WIDTH}) AS size FROM b WHERE len(words) > 0),
win AS (SELECT DISTINCT item, size, words[i : i + size - 1] AS run
        FROM (SELECT item, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM sized)),
sizes AS (SELECT DISTINCT size FROM sized),
dw AS (SELECT doc_id, size, i, words[i : i + size - 1] AS run
       FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM d, sizes)),
found AS (SELECT doc_id, i, dw.size, item FROM dw JOIN win USING (size, run)),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM found, range(0, {WIDTH}) AS r(k) WHERE k < size GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256
       FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""


@query("op3_benchmark_decontamination", SQL)
def op3(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"),
                         table(spark, sf_dir, "benchmark")).drop("spans", "items")
