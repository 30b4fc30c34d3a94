"""Near duplicates by SimHash fingerprints that differ in few bits.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; the shingles are all runs
of ``width`` words joined by a space, repeats included, or with fewer words the whole
sequence. A bit of the fingerprint is 1 if it is set in over half of the shingles' XXH64
(seed 42). Fingerprints link at ``radius`` or fewer differing bits; the result has each
document's component.

The links are found in a Gray-order hierarchical index:

1. Equal fingerprints become one code, so copies are never compared.
2. Codes within ``radius`` bits agree in one of ``radius + 1`` blocks of bits (or in two of
   ``radius + 2``, which many codes call for). Each choice of blocks is an order of the bits
   with the chosen ones first; in each order all codes are sorted by Gray rank over the
   cluster. Codes that share the first bits are adjacent there, and their shared bits are
   the pattern of a top node. The sort is by distinct ranks, so no range of it is hot.
3. A task cuts its range at the ends of such nodes into chunks of at most ``CHUNK`` codes and
   builds the lower levels: a node covers ``FAN`` neighbours and holds the bits they share
   beyond those of the nodes above, as a mask and a pattern. A code goes down from the root
   and adds up the differences under the masks; whole groups leave the search when the sum
   passes ``radius``.
4. A top node with more codes than a chunk, or one on the border of two tasks, is stored in
   pieces; pairs of pieces whose shared patterns differ in ``radius`` bits or fewer are
   searched in the same way, each pair by itself.
5. Of the links of a chunk only a spanning forest is kept (a link from each code to the
   first of its component), so a group of n near copies gives fewer than n rows. Components
   of the kept links are found by labels.

Cases: null and empty texts and texts without words have fingerprint zero and link like any
other; repeated rows are copies; null ids are carried, and a component's id is its smallest
non-null id (null if it has none); very long texts are hashed in slices; an empty table
gives no rows; other columns are not read.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlake.llm import query
from answerlake.llm.common import LOWER, col, per_text, table
from answerlake.llm.jaccard_join import components
from answerlake.runtime import cut_lineage, remove_folder, shared_dir

WIDTH, RADIUS, SEED = 3, 3, 42
CHUNK, FAN, QUERIES = 4096, 8, 256
CODES_A_TASK = 1 << 20
SLICE = 1 << 16
LANES, LANE_ROWS = np.uint64(0x0101010101010101), 255


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the lowest bit first."""
    rows = -(-len(hashes) // LANE_ROWS)
    full = np.zeros(rows * LANE_ROWS, np.uint64)
    full[:len(hashes)] = hashes
    full, counts = full.reshape(rows, LANE_ROWS), np.empty((8, 8), np.int64)
    for k in range(8):  # a byte of a lane adds up at most 255 bits
        lanes = ((full >> np.uint64(k)) & LANES).sum(axis=1, dtype=np.uint64)
        counts[:, k] = lanes.view(np.uint8).reshape(rows, 8).sum(axis=0)
    return counts.ravel()


def fingerprint(text, width: int = WIDTH) -> int:
    """The fingerprint of a text of UTF-8 bytes, unsigned."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    size = min(width, len(words))
    shingles, counts, hashed = len(words) - size + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for start in range(0, shingles, SLICE):
        part = words[start:start + SLICE + size - 1]
        joined, ends = b" ".join(part), np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        begins = np.concatenate([[0], ends[:len(part) - size]]).tolist()
        counts += _bit_counts(np.array([hashed(joined[b:e], SEED) for b, e in zip(
            begins, (ends[size - 1:] - 1).tolist())], np.uint64))
    return int(np.packbits(2 * counts > shingles, bitorder="little").view(np.uint64)[0])


def _fingerprints(width):
    def fn():
        return lambda texts: {"fp": pa.array(
            np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))}
    return fn


def bit_orders(blocks: int, radius: int) -> list:
    """For each choice of blocks that ``radius`` differences must leave equal: the number of
    leading bits, and the moves (from, width, to) of the blocks, as shifts from the right."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    fields = [(edges[i], edges[i + 1] - edges[i]) for i in range(blocks)]
    orders = []
    for chosen in combinations(range(blocks), blocks - radius):
        at, moves = 64, []
        for i in [*chosen, *(j for j in range(blocks) if j not in chosen)]:
            at -= fields[i][1]
            moves.append((*fields[i], at))
        orders.append((sum(fields[i][1] for i in chosen), moves))
    return orders


def _placed(codes: np.ndarray, moves) -> np.ndarray:
    """The codes with their blocks moved."""
    return _restored(codes, [(to, width, start) for start, width, to in moves])


def _restored(codes: np.ndarray, moves) -> np.ndarray:
    out = np.zeros_like(codes)
    for start, width, to in moves:
        out |= ((codes >> np.uint64(to)) & np.uint64((1 << width) - 1)) << np.uint64(start)
    return out


def _ranks(codes: np.ndarray) -> np.ndarray:
    """Positions of codes in Gray order, as signed numbers that sort alike."""
    for shift in (1, 2, 4, 8, 16, 32):
        codes = codes ^ (codes >> np.uint64(shift))
    return (codes ^ np.uint64(1 << 63)).view(np.int64)


def _ranked(orders):
    """Batches (fp) to the rank of each code in each order of bits."""
    def work(batches):
        for batch in batches:
            codes = batch.column(0).to_numpy().view(np.uint64)
            for i, (_, moves) in enumerate(orders):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), i, np.int32)), pa.array(_ranks(_placed(codes, moves)))],
                                                 names=["order", "rank"])
    return work


def _codes(ranks: np.ndarray) -> np.ndarray:
    ranks = ranks.view(np.uint64) ^ np.uint64(1 << 63)
    return ranks ^ (ranks >> np.uint64(1))


class GrayIndex:
    """Nodes over codes in Gray order; level 0 are the codes themselves."""

    def __init__(self, codes: np.ndarray):
        low, high = codes, codes
        masks, patterns = [np.full(len(codes), ~np.uint64(0))], [codes]
        while len(low) > 1:
            starts = np.arange(0, len(low), FAN)
            low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
            masks.append(~(low ^ high))
            patterns.append(low & masks[-1])
        # what the nodes above share is compared there
        for level in range(len(masks) - 1):
            masks[level] = masks[level] & ~np.repeat(masks[level + 1], FAN)[:len(masks[level])]
        self.masks, self.patterns = masks, patterns

    def search(self, queries: np.ndarray, radius: int, after: np.ndarray = None):
        """(query, code) positions within ``radius`` bits; with ``after`` only codes beyond that position."""
        ask, node, differ = np.arange(len(queries)), np.zeros(len(queries), np.int64), np.zeros(len(queries), np.uint8)
        for level in range(len(self.masks) - 1, -1, -1):
            differ = differ + np.bitwise_count((queries[ask] ^ self.patterns[level][node]) & self.masks[level][node])
            stays = differ <= radius
            if after is not None:
                stays &= (node + 1) * FAN ** level - 1 > after[ask]
            ask, node, differ = ask[stays], node[stays], differ[stays]
            if level:
                children = (node[:, None] * FAN + np.arange(FAN)).ravel()
                inside = children < len(self.masks[level - 1])
                ask, node, differ = np.repeat(ask, FAN)[inside], children[inside], np.repeat(differ, FAN)[inside]
        return ask, node


class _Forest:
    """Components of positions, joined by arrays of links."""

    def __init__(self, size):
        self.root = np.arange(size)

    def join(self, a, b):
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def linked_inside(codes: np.ndarray, radius: int) -> np.ndarray:
    """For each code the position of the first of its component, links within these codes."""
    index, forest = GrayIndex(codes), _Forest(len(codes))
    for start in range(0, len(codes), QUERIES):
        a, b = index.search(codes[start:start + QUERIES], radius, np.arange(start, min(start + QUERIES, len(codes))))
        forest.join(a + start, b)
    return forest.root


def linked_across(one: np.ndarray, other: np.ndarray, radius: int) -> np.ndarray:
    """As ``linked_inside`` for both together, links between the two only."""
    index, forest = GrayIndex(other), _Forest(len(one) + len(other))
    for start in range(0, len(one), QUERIES):
        a, b = index.search(one[start:start + QUERIES], radius)
        forest.join(a + start, b + len(one))
    return forest.root


OUT = "a long, b long, order int, key long, mask long, pattern long, codes binary"
OUT_NAMES = [x.split()[0] for x in OUT.split(", ")]


def _links(codes: np.ndarray, root: np.ndarray, moves) -> pa.RecordBatch:
    """Rows of links from each code to the first of its component."""
    at = np.flatnonzero(root != np.arange(len(root)))
    ids = _restored(codes, moves).view(np.int64)
    none = lambda kind: pa.nulls(len(at), kind)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[root[at]]), pa.array(ids[at]), none(pa.int32()), *[none(pa.int64())] * 3, none(pa.binary())], names=OUT_NAMES)


def _piece(order: int, lead: int, codes: np.ndarray) -> pa.RecordBatch:
    low, high = np.bitwise_and.reduce(codes), np.bitwise_or.reduce(codes)
    signed = lambda x: pa.array([int(np.uint64(x).view(np.int64))], pa.int64())
    mask = ~(low ^ high)
    return pa.RecordBatch.from_arrays(
        [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([order], pa.int32()), signed(codes[0] >> np.uint64(64 - lead)),
         signed(mask), signed(low & mask), pa.array([codes.tobytes()], pa.binary())], names=OUT_NAMES)


def _index_range(orders, radius):
    """Batches (order, rank), sorted, to links inside chunks and pieces of nodes that go on elsewhere."""
    def chunk(order, codes, begins, ends):
        """``begins`` and ``ends``: whether the first and the last node are known to be whole there."""
        lead, moves = orders[order]
        yield _links(codes, linked_inside(codes, radius), moves)
        keys = codes >> np.uint64(64 - lead)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        first, last = (cuts[0], cuts[-1]) if len(cuts) else (len(codes), 0)
        if not begins or (not len(cuts) and not ends):
            yield _piece(order, lead, codes[:first])
        if not ends and len(cuts):
            yield _piece(order, lead, codes[last:])

    def work(batches):
        held, order, begins = np.empty(0, np.uint64), None, False
        for batch in batches:
            of, ranks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for part in np.split(np.arange(len(of)), np.flatnonzero(of[1:] != of[:-1]) + 1):
                if not len(part):
                    continue
                if order is not None and of[part[0]] != order:
                    yield from chunk(order, held, begins, True)
                    held, begins = np.empty(0, np.uint64), True
                order = int(of[part[0]])
                held = np.concatenate([held, _codes(ranks[part])])
                while len(held) > CHUNK:
                    keys = held[:CHUNK + 1] >> np.uint64(64 - orders[order][0])
                    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
                    cut = int(cuts[-1]) if len(cuts) else CHUNK
                    yield from chunk(order, held[:cut], begins, bool(len(cuts)))
                    held, begins = held[cut:], bool(len(cuts))
        if len(held):
            yield from chunk(order, held, begins, False)
    return work


def _cross_pieces(orders, radius):
    """Batches (order, codes, codes of another piece) to links between the two."""
    def work(batches):
        for batch in batches:
            for order, x, y in zip(*[c.to_pylist() for c in batch.columns]):
                one, other = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                yield _links(np.concatenate([one, other]), linked_across(one, other, radius), orders[order][1])
    return work


def _piece_links(pieces: DataFrame, orders, radius: int) -> DataFrame:
    """Links between pieces of one node whose shared bits leave ``radius`` differences or fewer."""
    pieces = pieces.withColumn("piece", F.xxhash64("order", "codes"))
    sizes = pieces.select("order", "key", "piece", "mask", "pattern")
    other = sizes.select("order", "key", *[F.col(c).alias(f"other_{c}") for c in ("piece", "mask", "pattern")])
    differ = F.bit_count(F.col("pattern").bitwiseXOR(F.col("other_pattern"))
                         .bitwiseAND(F.col("mask")).bitwiseAND(F.col("other_mask")))
    pairs = sizes.join(other, ["order", "key"]).where(
        (F.col("piece") < F.col("other_piece")) & (differ <= radius)).select("order", "piece", "other_piece")
    codes = pieces.select("order", "piece", "codes")
    both = pairs.join(codes, ["order", "piece"]).join(
        codes.select("order", F.col("piece").alias("other_piece"), F.col("codes").alias("other_codes")), ["order", "other_piece"])
    return both.select("order", "codes", "other_codes").mapInArrow(_cross_pieces(orders, radius), OUT).select("a", "b")


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH,
                       radius: int = RADIUS) -> DataFrame:
    """One row per document: key, fingerprint (16 hex digits), component_id."""
    spark = docs.sparkSession
    folder, result = shared_dir(spark, "simhash"), shared_dir(spark, "simhash-components")
    rows = cut_lineage(per_text(docs, text, _fingerprints(width), "fp long", {"doc": col(key)}), "fingerprints", folder)
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("doc").alias("doc")), "codes", folder)
    count = nodes.count()
    # one spare block as soon as nodes under 64 / (radius + 1) shared bits outgrow a chunk
    blocks = radius + 1 if count >> (64 // (radius + 1)) <= CHUNK else radius + 2
    orders = bit_orders(blocks, radius)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(orders) * count // CODES_A_TASK)
    found = cut_lineage(nodes.select("fp").mapInArrow(_ranked(orders), "order int, rank long").repartitionByRange(tasks, "order", "rank")
                        .sortWithinPartitions("order", "rank").mapInArrow(_index_range(orders, radius), OUT), "links", folder)
    links = found.where(F.col("codes").isNull()).select("a", "b").union(
        _piece_links(found.where(F.col("codes").isNotNull()), orders, radius))
    label = components(links, folder=folder)
    named = label.join(nodes.withColumnRenamed("fp", "node"), "node")
    least = cut_lineage(named.groupBy("component").agg(F.min("doc").alias("least")), "least", folder)
    of = cut_lineage(label.join(least, "component").select(F.col("node").alias("fp"), "least"), "named", folder)
    known = cut_lineage(nodes.join(of, "fp", "left").select(
        "fp", F.coalesce("least", "doc").alias("component_id")), "known", folder)
    rows.join(known, "fp", "left").select(
        "doc", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id").write.parquet(result)
    remove_folder(spark, folder)  # the result reads none of its tables
    return spark.read.parquet(result).withColumnRenamed("doc", key)


@query("op11_simhash_components")
def op11(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"))
