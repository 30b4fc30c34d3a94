"""Similarity join of documents on their sets of word n-grams.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a document's set
has its distinct runs of ``width`` words, or with fewer words the whole sequence.
Two documents link when ``100 * intersection >= threshold * union``; the result has
each document's component.

The document by n-gram incidence is multiplied with its transpose in blocks, and only
where the product can reach the threshold:

1. Equal sets become one row of the matrix (a node), so copies are never paired.
2. N-grams get one order for all documents, rarest first: those that repeat inside
   chunks of documents are summed, and the most frequent (at most ``MAX_FREQUENT``,
   which only shapes the order, never the result) come last, by their count.
3. A node is entered under the n-grams of its prefix: of n, the first n - ceil(0.9 n)
   + 1. Linked nodes share one there. The sizes of two nodes and the positions of the
   n-gram in both bound the overlap from above; below the bound a pair is discarded.
   A pair must also pass a bound from parity bitmaps: of two sets' bitmaps no more bits
   differ than there are n-grams in one set only.
4. In each block (n-gram, size class) the node with the earliest position is the hub;
   every node's overlap is accumulated with the hub that it meets most often.
5. In each block, nodes outside the first node's component are paired with all nodes of
   other components that the bounds admit, so a group of near copies is never paired out,
   and no pair that can still join two components is left out.

Cases: null or empty texts and texts without words have no n-grams, link with nothing
and are their own component; a text with one or two words links with equal sequences;
repeated rows are copies; null ids are carried, and a component's id is its smallest
non-null id. Other columns are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerlake.llm import query
from answerlake.llm.common import LOWER, col, per_text, slices, table, utf8
from answerlake.runtime import broadcast_if_small, cut_lineage, remove_folder, shared_dir

WIDTH, THRESHOLD = 3, 90
FREQUENT, MAX_FREQUENT, CHUNK = 8, 500_000, 1 << 21
MIN_BITS, MAX_BITS = 256, 1 << 16
WORD_CACHE = 200_000
ROWS = 500  # documents that a task turns into n-grams at once


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def __call__(self, text) -> np.ndarray:
        words = (text or b"").translate(LOWER).split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > WORD_CACHE:
            self.known.clear()
        known, hashed = self.known, []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            hashed.append(h)
        ids, size = np.array(hashed, np.uint64), min(self.width, len(words))
        code = np.full(len(ids) - size + 1, size, np.uint64)
        for k in range(size):
            code = _mix(code * np.uint64(0x9E3779B97F4A7C15) + ids[k:len(ids) - size + 1 + k])
        return np.unique(code)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _node(grams: np.ndarray):
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def _signed(grams: np.ndarray) -> np.ndarray:
    return grams.view(np.int64)


def _parity(grams: np.ndarray) -> np.ndarray:
    """A bitmap of about two bits an n-gram, each bit the parity of the n-grams on it."""
    bits = min(max(MIN_BITS, 1 << int(2 * len(grams) - 1).bit_length()), MAX_BITS)
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _first_pass(width):
    """Batches (doc, text) to a row per document, and rows of n-grams that repeat among
    the different sets of a chunk."""
    def work(batches):
        shingle, seen, sets, held, kind = Shingler(width), set(), [], 0, None

        def rows(doc, n, node, parity, gram, times):
            return pa.RecordBatch.from_arrays(
                [doc, pa.array(n, pa.int64()), pa.array(node, pa.binary()),
                 pa.array(parity, pa.list_(pa.int64())), pa.array(gram, pa.int64()),
                 pa.array(times, pa.int64())], names=["doc", "n", "node", "parity", "gram", "times"])

        def counted():
            grams, n = np.unique(np.concatenate(sets), return_counts=True)
            often = n > 1
            none = [None] * int(often.sum())
            return rows(pa.array(none, kind), none, none, none, _signed(grams[often]), n[often])

        for batch in slices(batches, ROWS):
            kind, n, nodes, parity = batch.column(0).type, [], [], []
            for text in utf8(batch.column(1)):
                grams = shingle(text)
                node = _node(grams)
                n.append(len(grams))
                nodes.append(node)
                parity.append(_parity(grams) if node else None)
                if node is None or node in seen:
                    continue
                seen.add(node)
                sets.append(grams)
                held += len(grams)
                if held >= CHUNK:
                    yield counted()
                    seen, sets, held = set(), [], 0
            none = [None] * len(n)
            yield rows(batch.column(0), n, nodes, parity, none, none)
        if sets:
            yield counted()
    return work


def _prefixes(width, threshold, frequent):
    """Batches (text) to prefix entries: gram, node, size and position; once per set and task."""
    def work(batches):
        shingle, seen = Shingler(width), set()
        known, rank = frequent.value
        for batch in slices(batches, ROWS):
            grams, nodes, sizes, places = [], [], [], []
            for text in utf8(batch.column(0)):
                own = shingle(text)
                node = _node(own)
                if node is None or node in seen:
                    continue
                seen.add(node)
                n = len(own)
                length = n + (-n * threshold // 100) + 1
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    late = np.where(known[at] == own, rank[at], 0)
                    first = own[np.lexsort((own, late))[:length]]
                else:
                    first = own[:length]
                grams.append(first)
                nodes += [node] * length
                sizes.append(np.full(length, n))
                places.append(np.arange(length))
            if grams:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(np.concatenate(grams))), pa.array(nodes, pa.binary()),
                     pa.array(np.concatenate(sizes), pa.int64()),
                     pa.array(np.concatenate(places), pa.int64())],
                    names=["gram", "node", "n", "place"])
    return work


def _sets(width):
    def fn():
        shingle = Shingler(width)

        def apply(texts):
            sets = [shingle(t) for t in texts]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            return {"node": pa.array([_node(s) for s in sets], pa.binary()),
                    "grams": pa.ListArray.from_arrays(pa.array(offsets), pa.array(_signed(flat)))}
        return apply
    return fn


def _admitted(n_a, place_a, n_b, place_b, threshold):
    """Whether sizes and positions leave the overlap that a link needs."""
    least = F.least(F.col(n_a) - F.col(place_a), F.col(n_b) - F.col(place_b))
    return ((100 * F.least(n_a, n_b) >= threshold * F.greatest(n_a, n_b))
            & ((100 + threshold) * least >= threshold * (F.col(n_a) + F.col(n_b))))


def _near(pairs: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that the parity bitmaps admit."""
    both = (pairs.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("parity").alias("x")), "a")
            .join(nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("parity").alias("y")), "b"))
    # the larger bitmap is folded once to the size of the smaller
    half = F.least(F.size("x"), F.size("y"))
    fold = lambda z: F.when(F.size(z) == half, F.col(z)).otherwise(F.zip_with(
        F.slice(z, 1, half), F.slice(z, half + 1, half), lambda p, q: p.bitwiseXOR(q)))
    odd = F.aggregate(F.zip_with(fold("x"), fold("y"), lambda p, q: F.bit_count(p.bitwiseXOR(q))),
                      F.lit(0), lambda n, m: n + m)
    fits = F.greatest(F.size("x"), F.size("y")) <= 2 * half
    # intersection >= t/(100+t) * (n_a + n_b), so at most (100-t)/(100+t) of both are in one only
    return both.where(~fits | ((100 + threshold) * odd <= (100 - threshold) * (F.col("n_a") + F.col("n_b")))) \
        .select("a", "b")


def _linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str,
            width: int, threshold: int, folder: str) -> DataFrame:
    """The pairs (a, b) whose overlap reaches the threshold, counted on their whole sets."""
    near = cut_lineage(_near(pairs, nodes, threshold), "near", folder)
    used = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    wanted = cut_lineage(nodes.join(used, "node").select("doc").distinct(), "wanted", folder)
    given = docs.select(col(key).alias("doc"), col(text).alias("text"))
    found = per_text(given.join(broadcast_if_small(wanted), given["doc"].eqNullSafe(wanted["doc"]), "left_semi"),
                     "text", _sets(width), "node binary, grams array<long>", rows=ROWS)
    sets = cut_lineage(found.join(broadcast_if_small(cut_lineage(used, "used", folder)), "node", "left_semi")
                       .dropDuplicates(["node"]), "sets", folder)
    both = (near.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("grams_a")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("grams").alias("grams_b")), "b"))
    overlap = F.size(F.array_intersect("grams_a", "grams_b"))
    union = F.size("grams_a") + F.size("grams_b") - overlap
    return cut_lineage(both.where(100 * overlap >= threshold * union).select("a", "b"), "links", folder)


def components(edges: DataFrame, a: str = "a", b: str = "b", folder: str = None) -> DataFrame:
    """(node, component): the smallest node that is reachable, for every node of an edge.

    Every round takes the smallest label of a node's neighbours and then the label of
    that label, until no label changes.
    """
    both = cut_lineage(edges.select(col(a).alias("node"), col(b).alias("other"))
                       .union(edges.select(col(b), col(a))).distinct(), "edges", folder)
    labels = cut_lineage(both.groupBy("node").agg(
        F.least("node", F.min("other")).alias("component")), "labels", folder)
    while True:
        told = (both.join(labels.select(F.col("node").alias("other"), "component"), "other")
                .groupBy("node").agg(F.min("component").alias("told")))
        nearer = labels.join(told, "node").select(
            "node", F.col("component").alias("before"), F.least("component", "told").alias("component"))
        of = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        new = cut_lineage(nearer.join(of, "component", "left").select(
            "node", "before", F.least("component", F.coalesce("root", "component")).alias("component")),
            "labels", folder)
        labels = new.select("node", "component")
        if new.where(F.col("before") != F.col("component")).isEmpty():
            return labels


def _frequent(repeats: DataFrame):
    """The most frequent n-grams as sorted hashes, and ranks that grow with their counts."""
    rows = (repeats.groupBy("gram").agg(F.sum("times").alias("n")).where(F.col("n") >= FREQUENT)
            .orderBy(F.col("n").desc(), "gram").limit(MAX_FREQUENT).toArrow())
    grams = rows["gram"].to_numpy().view(np.uint64)
    rank = np.log2(rows["n"].to_numpy()).astype(np.int64)
    order = np.argsort(grams)
    return repeats.sparkSession.sparkContext.broadcast((grams[order], rank[order]))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text",
                       width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: key, n_shingles, component_id."""
    given = docs.select(col(key).alias("doc"), col(text).cast("string").alias("text"))
    spark = docs.sparkSession
    folder, result = shared_dir(spark, "jaccard"), shared_dir(spark, "jaccard-components")
    seen = cut_lineage(given.mapInArrow(
        _first_pass(width), f"doc {given.schema['doc'].dataType.simpleString()}, n long, node binary, "
        "parity array<long>, gram long, times long"), "sizes", folder)
    rows = seen.where(F.col("gram").isNull()).select("doc", "n", "node")
    # 1: equal sets are one node
    nodes = cut_lineage(seen.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("parity").alias("parity")), "nodes", folder)
    # 2-3: entries, and blocks that hold more than one
    frequent = _frequent(seen.where(F.col("gram").isNotNull()).select("gram", "times"))
    entries = given.select("text").mapInArrow(_prefixes(width, threshold, frequent),
                                              "gram long, node binary, n long, place long")
    entries = (entries.repartition("gram").groupBy("gram", "node")
               .agg(F.first("n").alias("n"), F.first("place").alias("place")))
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / threshold))))
    by_gram = Window.partitionBy("gram")
    hub = F.min(F.struct("place", "n", "node")).over(Window.partitionBy("gram", "size"))
    blocks = cut_lineage(
        entries.withColumn("size", size_class).withColumn("members", F.count(F.lit(1)).over(by_gram))
        .where(F.col("members") > 1).withColumn("hub", hub)
        .select("gram", "node", "n", "place", F.col("hub.node").alias("hub"),
                F.col("hub.n").alias("hub_n"), F.col("hub.place").alias("hub_place")), "blocks", folder)
    exact = lambda pairs: _linked(pairs, nodes, docs, key, text, width, threshold, folder)
    # 4: each node with the hub that it meets in most blocks
    met = (blocks.where((F.col("node") != F.col("hub"))
                        & _admitted("n", "place", "hub_n", "hub_place", threshold))
           .groupBy("node", "hub").agg(F.count(F.lit(1)).alias("times"))
           .groupBy("node").agg(F.max_by("hub", F.struct("times", "hub")).alias("hub")))
    links = exact(met.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    # 5: pairs of different components that the bounds admit
    label = components(links, folder=folder)
    same_gram = Window.partitionBy("gram")
    lead = F.min(F.struct("place", "n", "node", "component")).over(same_gram)
    named = cut_lineage(
        blocks.select("gram", "node", "n", "place").join(label, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .withColumn("apart", F.col("component") != lead["component"])
        .withColumn("mixed", F.max("apart").over(same_gram)).where("mixed").drop("mixed"), "mixed", folder)
    other = named.select("gram", *[F.col(c).alias(f"{c}_b") for c in
                                   ("node", "n", "place", "component", "apart")])
    open_pairs = (named.where("apart").join(other, "gram")
                  .where((F.col("component") != F.col("component_b"))
                         & (~F.col("apart_b") | (F.col("node") < F.col("node_b")))
                         & _admitted("n", "place", "n_b", "place_b", threshold))
                  .select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b"))
                  .distinct())
    label = components(links.union(exact(open_pairs)), folder=folder)
    named = nodes.select("node", "doc").join(label, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    of = named.join(least, "component").select("node", "component_id")
    rows.join(of, "node", "left").select(
        "doc", F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc")).otherwise(F.col("component_id")).alias("component_id")) \
        .write.parquet(result)
    frequent.unpersist()
    remove_folder(spark, folder)  # the result reads none of its tables
    return spark.read.parquet(result).withColumnRenamed("doc", key)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents whose id names their component. Rows that share an id stay or go
    together, and of those that are equal in all columns one stays.
    """
    found = jaccard_components(docs, key, text, **options)
    by_id = found.groupBy(key).agg(
        F.max(F.col(key).eqNullSafe(F.col("component_id"))).alias("first"), F.count(F.lit(1)).alias("rows"))
    out = cut_lineage(by_id.where(~F.col("first")).select(F.col(key).alias("_out")), "near-copies")
    kept = docs.join(broadcast_if_small(out), col(key).eqNullSafe(F.col("_out")), "left_anti")
    again = cut_lineage(by_id.where(F.col("first") & (F.col("rows") > 1)).select(F.col(key).alias("_id")), "repeated-ids")
    if again.isEmpty():
        return kept
    again, repeated = broadcast_if_small(again), col(key).eqNullSafe(F.col("_id"))
    return kept.join(again, repeated, "left_anti").unionByName(kept.join(again, repeated, "left_semi").dropDuplicates())


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 3 THEN words ELSE words[i : i + 2] END AS gram
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b USING (gram)
      WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, to_id) AS (SELECT a, b FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.to_id)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(to_id) AS m FROM r GROUP BY doc_id) USING (doc_id)"""


@query("op10_ngram_jaccard_join", SQL)
def op10(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))
