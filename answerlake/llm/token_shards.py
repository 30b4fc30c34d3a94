"""Token ids of a corpus in training order, as fixed-stride binary shards.

1. Documents are encoded (byte-level BPE, one end token each) and packed in order of
   their input partitions into sequences of ``length`` 16-bit ids; the last sequence of
   a partition is filled with end tokens. The sequences are written as a table.
2. Sequence i of all N (counted over the partitions of that table) gets slot F(i): a
   keyed Feistel network over the next power of four, walked along its cycle until it
   is below N, so F permutes 0..N-1 and needs no sort and no table.
3. Sequences are dealt by ranges of ``per_shard`` slots, compressed on the way, and every
   range is written as one file of ``per_shard * length * 2`` bytes (the last may be
   shorter): slot s is at byte ``(s % per_shard) * length * 2`` of shard ``s // per_shard``.

A folder that already holds the table or shards of an earlier run is continued: the
table is not made again and shards in the manifest are not written again. It must be
continued with the same documents, order key, length, range, vocabulary and end token,
which stand in ``parameters`` and in the table's digests; anything else raises
``ValueError`` before it writes. Shards are written under another name and moved, so a
lost task leaves no half shard. A task writes consecutive shards, one at a time.

Cases: null and empty texts are a lone end token; long texts run over as many sequences
as they need; repeated rows are encoded each; null ids are carried; an empty corpus has
no sequences and no shards. Extra columns are not read.
"""

import base64
import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlake.llm import query
from answerlake.llm.common import col, table
from answerlake.runtime import shared_dir

LENGTH, PER_SHARD, KEY, ROUNDS = 1024, 8192, 20_240_117, 6
MAX_WRITERS = 50_000
VOCABULARY, END = "byte_bpe_50k.tiktoken", 50_256
CHUNK_CACHE, BATCH = 200_000, 4096

# The encoder's pattern never joins a character to white space after it, so a text is
# the sum of these chunks: a word with the blank before it, or a run of white space.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_chunk = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of texts as little-endian 16-bit bytes; chunks seen before are looked up."""

    def __init__(self, vocabulary: bytes):
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN,
                                        mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known = {}

    def __call__(self, text) -> bytes:
        known, chunks = self.known, _chunk.findall(text or "")
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            if len(known) > CHUNK_CACHE:
                known.clear()
            for c in set(chunks):
                if c not in known:
                    known[c] = np.array(self.encode(c), "<u2").tobytes()
            return b"".join([known[c] for c in chunks])


def _signed(number: int) -> int:
    """The number modulo 2**64, as a signed one."""
    return (number + (1 << 63)) % (1 << 64) - (1 << 63)


def _pack(vocabulary, length, end):
    """Batches (doc, text, digest) to sequences: part, place, tokens, the documents in them
    and the sum of the digests of those that begin in them."""
    def work(batches):
        encode, part, place = Encoder(vocabulary.value), TaskContext.get().partitionId(), 0
        last, room = np.array([end], "<u2").tobytes(), 2 * length
        kind, full, filled = None, [], 0
        tokens, docs, starts, sizes, digest = [], [], [], [], 0

        def rows():
            nonlocal full, place
            n = len(full)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array(range(place, place + n), pa.int64()),
                 pa.array([x[0] for x in full], pa.binary()), pa.array([x[1] for x in full], pa.list_(kind)),
                 pa.array([x[2] for x in full], pa.list_(pa.int32())),
                 pa.array([x[3] for x in full], pa.list_(pa.int32())),
                 pa.array([_signed(x[4]) for x in full], pa.int64())],
                names=["part", "place", "tokens", "docs", "starts", "sizes", "digest"])
            place, full = place + n, []
            return out

        for batch in batches:
            kind = batch.column(0).type
            for doc, text, own in zip(*[c.to_pylist() for c in batch.columns]):
                ids, at = encode(text) + last, 0
                digest += own
                while at < len(ids):
                    piece = ids[at:at + room - filled]
                    tokens.append(piece)
                    docs.append(doc)
                    starts.append(filled // 2)
                    sizes.append(len(piece) // 2)
                    at, filled = at + len(piece), filled + len(piece)
                    if filled == room:
                        full.append((b"".join(tokens), docs, starts, sizes, digest))
                        tokens, docs, starts, sizes, filled, digest = [], [], [], [], 0, 0
                        if len(full) == BATCH:
                            yield rows()
        if tokens:
            full.append((b"".join(tokens) + last * ((room - filled) // 2), docs, starts, sizes, digest))
        if full:
            yield rows()
    return work


def slots(index: np.ndarray, total: int, key: int) -> np.ndarray:
    """The slot of each index below ``total``: a permutation of 0..total-1."""
    half = max(1, -(-int(total - 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "little"))
            for r in range(ROUNDS)]

    def network(x):
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask)
        return (left << np.uint64(half)) | right

    out = network(index.astype(np.uint64))
    while True:
        beyond = out >= np.uint64(total)
        if not beyond.any():
            return out.astype(np.int64)
        out[beyond] = network(out[beyond])


def _slots_of(batch, before, total, key):
    part = batch.column("part").to_numpy()
    offset = np.array([before[p] for p in part.tolist()], np.int64)
    return slots(offset + batch.column("place").to_numpy(), total, key)


def _deal(before, total, key, per_shard):
    """Sequences to (shard, slots, blob), a row for each shard that a batch has part in."""
    def work(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            own, tokens = _slots_of(batch, before.value, total, key), batch.column("tokens").to_pylist()
            order = np.argsort(own, kind="stable")
            shard = own[order] // per_shard
            cuts = np.flatnonzero(np.diff(shard)) + 1
            runs = np.split(order, cuts) if len(order) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(own[r[0]]) // per_shard for r in runs], pa.int64()),
                 pa.array([own[r] for r in runs], pa.list_(pa.int64())),
                 pa.array([pack.compress(b"".join([tokens[i] for i in r])) for r in runs], pa.binary())],
                names=["shard", "slots", "blob"])
    return work


def shard_name(shard: int) -> str:
    return f"shard-{shard:010d}.bin"


def _write_shards(folder, total, per_shard, stride):
    """Rows sorted by shard to files; a row of the manifest for each."""
    def work(batches):
        store, base = fs.FileSystem.from_uri(folder)
        unpack, shard, data = zstandard.ZstdDecompressor(), None, None

        def done():
            name, trial = f"{base}/{shard_name(shard)}", f"{base}/.{uuid.uuid4().hex}"
            with store.open_output_stream(trial) as out:
                out.write(data)
            store.move(trial, name)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard]), pa.array([shard * per_shard]), pa.array([len(data) // stride]),
                 pa.array([len(data)]), pa.array([hashlib.sha256(data).hexdigest()])],
                names=["shard", "first_slot", "n_sequences", "n_bytes", "sha256"])

        for batch in batches:
            for new, own, blob in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if new != shard:
                    if shard is not None:
                        yield done()
                    shard = new
                    data = bytearray(stride * min(per_shard, total - new * per_shard))
                raw = unpack.decompress(blob)
                for k, slot in enumerate(own.values.to_numpy()):
                    at = int(slot - new * per_shard) * stride
                    data[at:at + stride] = raw[k * stride:(k + 1) * stride]
        if shard is not None:
            yield done()
    return work


def _pieces(before, total, key, per_shard, stride):
    """Sequences to a row for each document in them."""
    def work(batches):
        for batch in batches:
            own, docs = _slots_of(batch, before.value, total, key), batch.column("docs")
            row = pa.compute.list_parent_indices(docs).to_numpy()
            slot = own[row]
            start = pa.compute.list_flatten(batch.column("starts")).to_numpy()
            size = pa.compute.list_flatten(batch.column("sizes"))
            yield pa.RecordBatch.from_arrays(
                [pa.compute.list_flatten(docs), size.cast(pa.int64()), pa.array(slot),
                 pa.array(slot // per_shard), pa.array(slot % per_shard * stride + 2 * start.astype(np.int64))],
                names=["doc", "n_tokens", "slot", "shard", "byte_offset"])
    return work


def _table(spark: SparkSession, path: str):
    """A table that an earlier run completed, or None."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def _digest_of(df: DataFrame, digest) -> int:
    """The sum of a long column modulo 2**64, in no order."""
    return _signed(int(df.agg(F.sum(digest.cast("decimal(38,0)"))).first()[0] or 0))


def _same_parameters(spark: SparkSession, folder: str, own: dict) -> None:
    """Write the parameters of a new folder, or raise if a used one has others."""
    found = _table(spark, f"{folder}/parameters")
    if found is None:
        if _table(spark, f"{folder}/sequences") is not None:
            raise ValueError(f"{folder} has sequences of unknown parameters")
        spark.createDataFrame([own], ", ".join(
            f"{n} {'string' if isinstance(v, str) else 'long'}" for n, v in own.items())).coalesce(1) \
            .write.parquet(f"{folder}/parameters")
        return
    then = found.first().asDict()
    other = [n for n in own if then.get(n) != own[n]]
    if other:
        raise ValueError(f"{folder} was written with other values of: {', '.join(other)}")


def materialise(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text",
                length: int = LENGTH, per_shard: int = PER_SHARD, order_key: int = KEY,
                vocabulary: str = None, end: int = END) -> DataFrame:
    """Write the shards to ``folder`` (a URI that all executors reach) and return where
    every piece of every document is: key, n_tokens, slot, shard, byte_offset.
    """
    spark, stride = docs.sparkSession, 2 * length
    with open(vocabulary or vocabulary_path(), "rb") as f:
        ranks = f.read()
    given = docs.select(col(key).alias("doc"), col(text).cast("string").alias("text")) \
        .withColumn("digest", F.xxhash64("doc", "text"))
    kind = given.schema["doc"].dataType.simpleString()
    _same_parameters(spark, folder, {
        "order_key": str(order_key), "length": length, "per_shard": per_shard, "end": end, "id_type": kind,
        "vocabulary": hashlib.sha256(ranks).hexdigest()})
    sequences = _table(spark, f"{folder}/sequences")
    if sequences is None:
        schema = (f"part int, place long, tokens binary, docs array<{kind}>, "
                  "starts array<int>, sizes array<int>, digest long")
        given.mapInArrow(_pack(spark.sparkContext.broadcast(ranks), length, end), schema) \
            .write.option("compression", "zstd").parquet(f"{folder}/sequences")
        sequences = spark.read.schema(schema).parquet(f"{folder}/sequences")
    elif _digest_of(sequences, F.col("digest")) != _digest_of(given, F.col("digest")):
        raise ValueError(f"{folder} holds shards of other documents")
    # one number for each task that encoded
    counts = sorted((r["part"], r["n"]) for r in
                    sequences.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = {}, 0
    for part, n in counts:
        before[part], total = total, total + n
    before = spark.sparkContext.broadcast(before)
    dealt = sequences.select("part", "place", "tokens").mapInArrow(
        _deal(before, total, order_key, per_shard), "shard long, slots array<long>, blob binary")
    finished = _table(spark, f"{folder}/manifest")
    if finished is not None:
        dealt = dealt.join(finished.select("shard"), "shard", "left_anti")
    if total:
        shards = -(-total // per_shard)
        each = -(-shards // MAX_WRITERS)
        writer = F.floor(F.col("shard") / each).cast("int")
        (dealt.repartitionById(-(-shards // each), writer).sortWithinPartitions("shard")
         .mapInArrow(_write_shards(folder, total, per_shard, stride),
                     "shard long, first_slot long, n_sequences long, n_bytes long, sha256 string")
         .write.mode("append").parquet(f"{folder}/manifest"))
    kind = sequences.schema["docs"].dataType.elementType.simpleString()
    return sequences.select("part", "place", "docs", "starts", "sizes").mapInArrow(
        _pieces(before, total, order_key, per_shard, stride),
        f"doc {kind}, n_tokens long, slot long, shard long, byte_offset long") \
        .withColumnRenamed("doc", key)


def read_slots(spark: SparkSession, folder: str, first: int, count: int, length: int = LENGTH,
               per_shard: int = PER_SHARD) -> DataFrame:
    """slot and tokens of ``count`` slots from ``first`` on, in order inside each shard."""
    stride = 2 * length
    wanted = (spark.read.parquet(f"{folder}/manifest")
              .select("shard", F.greatest(F.lit(first), "first_slot").alias("begin"),
                      F.least(F.lit(first + count), F.col("first_slot") + F.col("n_sequences")).alias("stop"))
              .where("begin < stop"))

    def work(batches):
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for shard, begin, stop in zip(*[c.to_pylist() for c in batch.columns]):
                with store.open_input_file(f"{base}/{shard_name(shard)}") as f:
                    f.seek((begin - shard * per_shard) * stride)
                    for at in range(begin, stop, BATCH):
                        n = min(BATCH, stop - at)
                        ids = np.frombuffer(f.read(n * stride), "<u2").astype(np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(range(at, at + n), pa.int64()), pa.ListArray.from_arrays(
                                pa.array(np.arange(0, n * length + 1, length, dtype=np.int32)), pa.array(ids))],
                            names=["slot", "tokens"])

    return wanted.mapInArrow(work, "slot long, tokens array<int>")


@query("op5_token_shards")
def op5(spark, sf_dir):
    return materialise(table(spark, sf_dir, "documents"), shared_dir(spark, "token-shards"))
