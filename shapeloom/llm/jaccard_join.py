"""N-gram Jaccard join by a token-group matrix, and its connected components.

1. Equal sets are one class; only the document with the smallest id stands for it.
2. Similar documents are partitioned into groups. Two sets with a Jaccard similarity of t differ in at most
   (1/t - 1) of the smaller one's tokens. A set's tokens are dealt by hash into twice as many parts as one more than
   that number, so two linked sets agree in more than half of all parts. Parts have an order by their tokens alone:
   first those with a rare token, then those with many tokens, empty ones last. A set keeps the first half of its
   parts. The first part in which two linked sets agree is in either one's half, since all others in which they agree
   come after it. So parts of common passages, in which a set would agree with many strangers, are left out. How
   common a token is, a table of fixed size tells, which counts tokens that documents near each other share; it
   decides how many strangers meet, and never which links are found. Documents that share a part meet in a cluster; no
   link leaves a cluster. Clusters are cut into blocks of a bounded number of documents.
3. In a block, groups of documents keep the union of their tokens (the token-group matrix). The overlap of a query
   document with a group's union bounds its overlap with every member; only groups that reach the bound are opened,
   and their members are compared exactly.
4. A cluster of more than one block is joined in two rounds. First each block is joined in itself and with the
   cluster's hubs. Then every document outside the cluster's largest component visits all blocks of its size; a pair
   within one component needs no comparison, so a cluster of near copies costs no pairs of all with all.
5. Where such visits would outnumber a cluster's documents many times, tokens that a single document of the cluster
   holds are counted. They lie in no intersection: two documents whose lone tokens together exceed what linked sets may
   differ in are not linked. A document with more than half of that is heavy; heavy ones need not visit heavy ones,
   and one with more than all of it visits none. A block's visitors are cut into bounded sub-blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapeloom.llm import kernels as K
from shapeloom.llm.chunks import bucket_of, by_bucket
from shapeloom.llm.common import discard, id_and_text, shuffle_partitions, written
from shapeloom.operators.components import connected_components

_U = np.uint64
#: Documents in a block, documents in a group of a block's matrix, hubs of a cluster, and visitors of a sub-block, about.
BLOCK, GROUP, HUBS, GUESTS = 128, 8, 8, 1024
#: Visits for each document of a cluster from which lone tokens are counted.
CROWDED = 4
#: Values that meet in one bucket, about: a bound of a task's memory at every size of the corpus.
PER_BUCKET = 500_000
#: Pairs that a task holds until it gives them.
PAIRS = 1 << 20
#: The table of common tokens: entries, entries of a chunk of it, and tokens among which a task looks for shared ones.
ENTRIES, CHUNK, WINDOW = 1 << 22, 1 << 16, 1 << 21


def token_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words the whole sequence is one."""
    body, rows = K.text_bytes(texts)
    words, offsets = K.word_hashes(body, rows, lower=True)
    hashes, _, bounds = K.ngram_hashes(words, offsets, shingle)
    out = []
    for i, n in enumerate(np.diff(offsets).tolist()):
        if n >= shingle:
            own = np.sort(hashes[bounds[i] : bounds[i + 1]])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif n:
            out.append(K.ngram_hashes(words[offsets[i] : offsets[i + 1]], np.array([0, n]), n)[0])
        else:
            out.append(np.zeros(0, _U))
    return out


def _summaries(shingle: int, batches):
    for batch in batches:
        for a, b in K.slices(batch.column(1)):
            sets = token_sets(batch.column(1)[a:b], shingle)
            sums = [(int(K.mix(s).sum(dtype=_U)) if len(s) else 0, int(np.bitwise_xor.reduce(K.mix(s + _U(0x5851F42D4C957F2D)))) if len(s) else 0) for s in sets]
            signed = [np.array([x[k] for x in sums], _U).view(np.int64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([len(s) for s in sets], pa.int64()), pa.array(signed[0]), pa.array(signed[1])], names=["doc_id", "n", "h1", "h2"])
    K.tidy()


def size_classes(num: int, den: int, most: int) -> np.ndarray:
    """Lower bounds of size classes: linked sets are of one class or of neighbours."""
    bounds = [1]
    while bounds[-1] <= most:
        bounds.append(max(bounds[-1] + 1, bounds[-1] * den // num + 1))
    return np.array(bounds, np.int64)


def parts_of(beyond: int, num: int, den: int) -> int:
    """Parts of sets where linked pairs have a smaller set of below ``beyond`` tokens; half of them are kept."""
    return 2 * ((beyond - 1) * (den - num) // num + 1)


def _entry(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> _U(20) & _U(ENTRIES - 1)).astype(np.int64)


def _shared_tokens(shingle: int, batches):
    """Rows (chunk, at, count) of packed values: how many documents hold the tokens that documents of a window share."""
    count = np.zeros(ENTRIES, np.uint32)
    held, n = [], 0

    def close() -> None:
        tokens = np.concatenate(held)
        tokens.sort()
        begin, size = K.groups_of(tokens)
        np.add.at(count, _entry(tokens[begin[size > 1]]), size[size > 1].astype(np.uint32))

    for batch in batches:
        for a, b in K.slices(batch.column(0)):
            sets = token_sets(batch.column(0)[a:b], shingle)
            held.append(np.concatenate(sets))
            n += len(held[-1])
            if n >= WINDOW:
                close()
                held, n = [], 0
    if n:
        close()
    rows = []
    for k in range(ENTRIES // CHUNK):
        part = count[k * CHUNK : (k + 1) * CHUNK]
        at = np.flatnonzero(part)
        if len(at):
            rows.append((k, at.astype(np.uint16).tobytes(), part[at].tobytes()))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["chunk", "at", "count"])
    held.clear()
    K.tidy()


def _summed(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """The counts of one chunk, added up row by row."""
    total = np.zeros(CHUNK, np.uint64)
    for batch in batches:
        for at, count in zip(batch.column("at"), batch.column("count"), strict=True):
            total[np.frombuffer(at.as_py(), np.uint16)] += np.frombuffer(count.as_py(), np.uint32)
    return np.minimum(total, _U(0xFFFFFFFF))


def _added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one chunk from some tasks as one row."""
    total = _summed(batches)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([total[at].astype(np.uint32).tobytes()], pa.binary())], names=["chunk", "at", "count"])


def _levels(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk of the table: for each entry the number of binary digits of its count."""
    level = np.frexp(_summed(batches).astype(np.float64))[1].astype(np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["chunk", "level"])


def common_tokens(docs: DataFrame, shingle: int) -> np.ndarray:
    """How common tokens are, by the entry that a token falls to: 0 for those that no documents of a window share.

    All documents are read. The driver receives ENTRIES bytes (4 MB), at any size of the corpus.
    """
    rows = "chunk int, at binary, count binary"
    shared = docs.select("text").mapInArrow(partial(_shared_tokens, shingle), rows)
    # the rows of 256 tasks are added up at a time, so that a chunk's last task reads few rows
    shared = shared.groupBy("chunk", F.expr("spark_partition_id() div 256").alias("salt")).applyInArrow(_added, rows)
    table = np.zeros(ENTRIES, np.uint8)
    for row in shared.groupBy("chunk").applyInArrow(_levels, "chunk int, level binary").collect():
        table[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(row.level, np.uint8)
    return table


def _part_signatures(tokens: np.ndarray, level: np.ndarray, c: int, parts: int) -> np.ndarray:
    """A hash of the tokens in each of the first half of the parts: by their rarest token, then by number of tokens."""
    mixed = K.mix(tokens + _U(0x94D049BB133111EB))
    part = (mixed % _U(parts)).astype(np.int64)
    low = np.bincount(part, (mixed >> _U(8) & _U(0xFFFFFFF)).astype(np.float64), parts).astype(_U)
    high = np.bincount(part, (mixed >> _U(36)).astype(np.float64), parts).astype(_U)
    own = K.mix((high * _U(0x9E3779B97F4A7C15)) ^ (low * _U(0xC2B2AE3D27D4EB4F)) ^ K.mix(np.arange(parts, dtype=_U) + _U(c << 32)))
    rarest = np.full(parts, 255, np.uint8)
    np.minimum.at(rarest, part, level)
    many = np.minimum(np.bincount(part, minlength=parts), 255)
    order = (_U(255) - rarest.astype(_U)) << _U(56) | many.astype(_U) << _U(48) | own >> _U(16)
    return own[np.argpartition(order, parts // 2)[parts // 2 :]]


def _signatures(shingle: int, num: int, den: int, buckets: int, common, batches):
    """Rows (bucket, sig, doc) of packed values; in bucket -1 pairs of documents that share a part in this slice."""
    for batch in batches:
        for a, b in K.slices(batch.column(1)):
            sets, ids = token_sets(batch.column(1)[a:b], shingle), batch.column(0)[a:b].to_pylist()
            bounds = size_classes(num, den, 2 * max([1, *map(len, sets)]))
            sigs, docs = [], []
            for tokens, i in zip(sets, ids, strict=True):
                if i is None or len(tokens) * (den - num) < num:
                    continue  # nothing but an equal set can be linked
                c = int(np.searchsorted(bounds, len(tokens), "right")) - 1
                level = common.value[_entry(tokens)]
                for k in {c, max(c - 1, 0)}:
                    # the lowest bit: the set is of the smaller class of this scheme. Pairs without such a set meet in the next scheme
                    own = _part_signatures(tokens, level, k, parts_of(int(bounds[k + 1]), num, den))
                    sigs.append(own & ~_U(1) | _U(k == c))
                    docs.append(np.full(len(own), i, np.int64))
            if not sigs:
                continue
            sig, doc = np.concatenate(sigs), np.concatenate(docs)
            bucket = bucket_of(sig, buckets)
            order = np.lexsort((doc, sig >> _U(1), bucket))
            bucket, sig, doc = bucket[order], sig[order], doc[order]
            begin, size = K.groups_of(sig >> _U(1))
            sig = sig & ~_U(1) | np.repeat(np.bitwise_or.reduceat(sig & _U(1), begin), size)
            pivot = np.repeat(doc[begin], size)
            pairs = np.unique(np.stack([doc, pivot])[:, doc != pivot], axis=1)
            bucket, sig, doc = bucket[begin], sig[begin], doc[begin]
            rows = [(k, sig[s].tobytes(), doc[s].tobytes()) for k, s in by_bucket(bucket, buckets)]
            if pairs.size:
                rows.append((-1 - int(pairs[0, 0]) % buckets, pairs[1].tobytes(), pairs[0].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "sig", "doc"])
    K.tidy()


def _meet(sig: np.ndarray, doc: np.ndarray, packed_pairs: bool) -> np.ndarray:
    """The distinct pairs (document, smallest document with the same part) of one bucket."""
    if packed_pairs:
        pairs = np.stack([doc, sig.view(np.int64)])
    else:
        order = np.lexsort((doc, sig >> _U(1)))
        sig, doc = sig[order], doc[order]
        begin, size = K.groups_of(sig >> _U(1))
        needed = np.repeat(np.bitwise_or.reduceat(sig & _U(1), begin), size) > 0
        pairs = np.stack([doc, np.repeat(doc[begin], size)])[:, needed]
    return np.unique(pairs[:, pairs[0] != pairs[1]], axis=1)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (document, smallest document with the same part) of a task's buckets, which come one after another.

    A pair that meets in several of them is given once, but for tasks with over PAIRS different pairs.
    """
    now, sigs, docs, found, n = None, [], [], [], 0

    def close() -> None:
        nonlocal n
        if sigs:
            found.append(_meet(np.concatenate(sigs), np.concatenate(docs), now < 0))
            n += found[-1].shape[1]
            sigs.clear()
            docs.clear()

    def given() -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["doc", "pivot"])

    for batch in batches:
        for bucket, sig, doc in zip(batch.column("bucket").to_pylist(), batch.column("sig"), batch.column("doc"), strict=True):
            if bucket != now:
                close()
                now = bucket
                if n > PAIRS:
                    found[:] = [np.unique(np.concatenate(found, axis=1), axis=1)]
                    n = found[0].shape[1]
                    if n > PAIRS // 2:
                        yield given()
                        found.clear()
                        n = 0
            sigs.append(np.frombuffer(sig.as_py(), _U))
            docs.append(np.frombuffer(doc.as_py(), np.int64))
    close()
    if found:
        yield given()
    K.tidy()


class _Sets:
    """Disjoint sets over positions."""

    def __init__(self, labels):
        self.up, first = list(range(len(labels))), {}
        for i, x in enumerate(labels):
            self.up[i] = first.setdefault(x, i)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.find(i)] = self.find(j)


def _open_groups(shingle: int, num: int, den: int, visitors_only: bool, table: pa.Table) -> pa.Table:
    """Links of a block as (document, document) that connect what was not connected before."""
    sets = token_sets(table.column("text").combine_chunks() if table.num_rows else table.column("text"), shingle)
    ids, home = table.column("doc_id").to_pylist(), table.column("home").to_pylist()
    joined, links = _Sets(table.column("label").to_pylist()), []
    sizes = np.array([len(s) for s in sets], np.int64)
    vocabulary, token = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(token, np.cumsum(sizes)[:-1])
    members = sorted((i for i in range(len(ids)) if home[i]), key=lambda i: (sizes[i], own[i][0] if sizes[i] else -1, ids[i]))
    groups = [members[a : a + GROUP] for a in range(0, len(members), GROUP)]
    matrix = np.zeros((len(groups), len(vocabulary)), bool)
    for g, group in enumerate(groups):
        matrix[g, np.concatenate([own[i] for i in group])] = True
    low = np.array([sizes[g[0]] for g in groups], np.int64)
    high = np.array([sizes[g[-1]] for g in groups], np.int64)
    mark = np.zeros(len(vocabulary), bool)
    for q in sorted(range(len(ids)), key=lambda i: (sizes[i], ids[i])):
        if visitors_only and home[q]:
            continue
        n = sizes[q]
        overlap = matrix[:, own[q]].sum(axis=1)
        # an intersection holds at least num/den of either set, and cannot exceed the overlap with the union
        able = (overlap * den >= num * np.maximum(n, low)) & (high * den >= num * n) & (low * num <= den * n)
        if not able.any():
            continue
        mark[own[q]] = True
        for g in np.flatnonzero(able):
            for m in groups[g]:
                if m == q or joined.find(m) == joined.find(q) or min(n, sizes[m]) * den < num * max(n, sizes[m]):
                    continue
                both = int(mark[own[m]].sum())
                if both * den >= num * (n + sizes[m] - both):
                    joined.join(q, m)
                    links.append((ids[q], ids[m]))
        mark[own[q]] = False
    if table.nbytes > 1 << 20:
        del sets, own, vocabulary, token, matrix
        K.tidy()
    return pa.table({"u": pa.array([x[0] for x in links], pa.int64()), "v": pa.array([x[1] for x in links], pa.int64())})


def _blocks(reps: DataFrame, clusters: DataFrame, num: int, den: int) -> DataFrame:
    """(doc_id, cluster, cls, blk): the home block of each document whose cluster has another."""
    ratio = F.log(F.lit(den / num))
    placed = clusters.join(reps, clusters.node == reps.rep).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"), F.floor(F.log(F.col("n").cast("double")) / ratio).cast("int").alias("cls"))
    count = placed.groupBy("cluster").agg(F.count("*").alias("total")).where("total > 1")
    placed = placed.join(count, "cluster").withColumn("cls", F.when(F.col("total") <= BLOCK, -1).otherwise(F.col("cls")))
    count = placed.groupBy("cluster", "cls").agg(F.ceil(F.count("*") / BLOCK).alias("blks"))
    return placed.join(count, ["cluster", "cls"]).select("doc_id", "cluster", "cls", F.expr("pmod(xxhash64(doc_id), blks)").cast("int").alias("blk"))


def _cluster_tokens(shingle: int, buckets: int, batches):
    """Rows (bucket, sig, doc) of packed values: a cluster's tokens with a document; lowest bit: more than one holds it."""
    for batch in batches:
        for a, b in K.slices(batch.column(2)):
            sets = token_sets(batch.column(2)[a:b], shingle)
            ids, clusters = (batch.column(k)[a:b].to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            doc = np.repeat(ids, [len(s) for s in sets])
            if not len(doc):
                continue
            sig = np.concatenate([K.mix(s ^ K.mix(np.array([c], np.int64).view(_U))) & ~_U(1) for s, c in zip(sets, clusters, strict=True)])
            bucket = bucket_of(sig, buckets)
            order = np.lexsort((sig, bucket))
            bucket, sig, doc = bucket[order], sig[order], doc[order]
            begin, size = K.groups_of(sig)
            bucket, sig, doc = bucket[begin], sig[begin] | (size > 1).astype(_U), doc[begin]
            rows = [(k, sig[s].tobytes(), doc[s].tobytes()) for k, s in by_bucket(bucket, buckets)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "sig", "doc"])


def _lone(table: pa.Table) -> pa.Table:
    """(doc, lone): a document's tokens in this bucket that no other document of its cluster holds."""
    sig = np.concatenate([np.frombuffer(x, _U) for x in table.column("sig").to_pylist()])
    doc = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("doc").to_pylist()])
    order = np.argsort(sig, kind="stable")
    sig, doc = sig[order], doc[order]
    begin, size = K.groups_of(sig >> _U(1))
    own, lone = np.unique(doc[begin][(size == 1) & (sig[begin] & _U(1) == 0)], return_counts=True)
    return pa.table({"doc": pa.array(own, pa.int64()), "lone": pa.array(lone.astype(np.int64))})


def _weighed(docs: DataFrame, sets: DataFrame, members: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """(doc_id, heavy, apart) of those ``members`` (doc_id, cluster) whose lone tokens bound their links."""
    tokens = members.join(sets, "doc_id").agg(F.sum("n")).first()[0] or 0
    buckets = max(shuffle_partitions(docs.sparkSession), tokens // PER_BUCKET)
    packed = docs.join(members, "doc_id").select("doc_id", "cluster", "text").mapInArrow(partial(_cluster_tokens, shingle, buckets), "bucket int, sig binary, doc binary")
    lone = packed.groupBy("bucket").applyInArrow(_lone, "doc long, lone long").groupBy(F.col("doc").alias("doc_id")).agg(F.sum("lone").alias("lone"))
    # an id with several rows may stand for several sets: nothing is known of it
    single = sets.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.max("n").alias("n")).where("rows = 1")
    return lone.join(single, "doc_id").select("doc_id", (F.col("lone") * (num + den) > F.col("n") * (den - num)).alias("heavy"), (F.col("lone") * num > F.col("n") * (den - num)).alias("apart")).where("heavy")


def _visits(labelled: DataFrame, minor: DataFrame) -> DataFrame:
    """Seats of the second round: homes and visitors of each block's light and heavy part, cut into sub-blocks."""
    keys = ["cluster", "cls", "blk", "heavy"]
    places = labelled.where("not apart").select(*keys).distinct()
    # a heavy document visits light homes only
    fits = "cls between own - 1 and own + 1 and not (heavy and guest_heavy)"
    minor = minor.where("not apart").select("doc_id", "cluster", F.col("cls").alias("own"), F.col("heavy").alias("guest_heavy"), "label")
    number = minor.groupBy("cluster", "own", "guest_heavy").agg(F.count("*").alias("n")).join(places, "cluster").where(fits)
    slots = number.groupBy(*keys).agg(F.ceil(F.sum("n") / GUESTS).cast("int").alias("slots"))
    guests = minor.join(slots, "cluster").where(fits).select("doc_id", *keys, F.expr("cast(pmod(xxhash64(doc_id, 1), slots) as int)").alias("slot"), F.lit(False).alias("home"), "label")
    homes = labelled.where("not apart").join(slots, keys).withColumn("slot", F.explode(F.expr("sequence(0, slots - 1)")))
    return homes.select("doc_id", *keys, "slot", F.lit(True).alias("home"), "label").unionByName(guests)


def _links(docs: DataFrame, seats: DataFrame, shingle: int, num: int, den: int, visitors_only: bool) -> DataFrame:
    place = [c for c in ("cluster", "cls", "blk", "heavy", "slot") if c in seats.columns]
    seated = docs.join(seats, "doc_id").select(*place, "doc_id", "home", "label", "text")

    def opened(table: pa.Table) -> pa.Table:
        return _open_groups(shingle, num, den, visitors_only, table)

    return seated.groupBy(*place).applyInArrow(opened, "u long, v long")


def jaccard_components(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of the graph that links two documents when den * |A & B| >= num * |A | B|.

    A and B are the documents' sets of distinct ``shingle``-word shingles, A-Z lower-cased; a text with fewer words
    has its whole sequence as one. Returns for each row of ``docs``: doc_id, n_shingles, component_id (the smallest
    doc_id that is reachable by links, itself included).
    A text that is null or without words has an empty set, linked with nothing. A row without an id is linked with
    nothing and its component is null. Rows that repeat an id are one node; each is returned. Ties do not occur: a
    component is a set. Other columns are not read. No rows give no rows.
    """
    if not 0 < num < den:
        raise ValueError("the similarity must lie between 0 and 1")
    spark = docs.sparkSession
    docs = id_and_text(docs, id_col, text_col)
    sets = written(docs.mapInArrow(partial(_summaries, shingle), "doc_id long, n long, h1 long, h2 long"), "sets")
    reps = written(sets.where("n > 0 and doc_id is not null").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    # a set's signatures: half of the parts of two schemes
    tokens = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(shuffle_partitions(spark), int(2.5 * tokens * (den - num) / num) // PER_BUCKET)
    common = spark.sparkContext.broadcast(common_tokens(docs, shingle))
    packed = docs.mapInArrow(partial(_signatures, shingle, num, den, buckets, common), "bucket int, sig binary, doc binary")
    # a task takes several buckets in turn: their number grows with the corpus, and most linked documents meet in most of them
    parts = shuffle_partitions(spark)
    dealt = packed.repartition(parts, F.expr(f"pmod(bucket, {parts})")).sortWithinPartitions("bucket")
    meetings = written(dealt.mapInArrow(_meetings, "doc long, pivot long").distinct(), "meetings")
    home = written(_blocks(reps, connected_components(meetings, "doc", "pivot"), num, den), "blocks")
    # the documents of a cluster that most others met at; a few for each cluster, chosen by aggregation
    many = home.where("cls >= 0")
    degree = meetings.groupBy(F.col("pivot").alias("doc_id")).agg(F.count("*").alias("met"))
    hubs = many.join(degree, "doc_id").groupBy("cluster", F.expr(f"pmod(xxhash64(doc_id), {HUBS})").alias("k")).agg(F.max(F.struct("met", "doc_id")).alias("top")).select("cluster", F.col("top.doc_id").alias("doc_id"))
    places = many.select("cluster", "cls", "blk").distinct()
    visits = hubs.join(places, "cluster").join(many.select("doc_id", "cluster", "cls", "blk"), ["doc_id", "cluster", "cls", "blk"], "left_anti")
    seats = home.withColumn("home", F.lit(True)).unionByName(visits.withColumn("home", F.lit(False))).withColumn("label", F.col("doc_id"))
    links = first = written(_links(docs, seats, shingle, num, den, False), "joined")
    discard(meetings)
    common.unpersist()
    passing = [home, first]
    if not places.isEmpty():
        parts = connected_components(links, "u", "v")
        labelled = many.join(parts, many.doc_id == parts.node, "left").select("doc_id", "cluster", "cls", "blk", F.coalesce("component", "doc_id").alias("label"))
        labelled = written(labelled, "labels")
        passing.append(labelled)
        largest = labelled.groupBy("cluster", "label").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max(F.struct("n", "label")).alias("top")).select("cluster", F.col("top.label").alias("main"))
        minor = labelled.join(largest, "cluster").where("label <> main").drop("main")
        if not minor.isEmpty():
            blocks = places.groupBy("cluster").agg(F.count("*").alias("blks"))
            members = labelled.groupBy("cluster").agg(F.count("*").alias("total"))
            crowded = minor.groupBy("cluster").agg(F.count("*").alias("minor")).join(blocks, "cluster").join(members, "cluster").where(F.col("minor") * F.col("blks") > F.col("total") * CROWDED).select("cluster")
            crowded = labelled.join(crowded, "cluster", "left_semi").select("doc_id", "cluster")
            light = [F.lit(False).alias("heavy"), F.lit(False).alias("apart")]
            if crowded.isEmpty():
                labelled, minor = (x.select("*", *light) for x in (labelled, minor))
            else:
                weight = written(_weighed(docs, sets, crowded, shingle, num, den), "weights")
                passing.append(weight)
                labelled, minor = (x.join(weight, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("heavy", "apart")}) for x in (labelled, minor))
            # written before they are contracted, so that no task runs two Python workers at a time
            second = written(_links(docs, _visits(labelled, minor), shingle, num, den, True), "visited")
            passing.append(second)
            links = links.unionByName(second)
    found = connected_components(links, "u", "v")
    for table in passing:
        discard(table)
    linked = sets.join(reps, ["n", "h1", "h2"], "left")
    linked = linked.join(found, linked.rep == found.node, "left")
    merged = linked.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("own"))
    return merged.select("doc_id", F.col("n").alias("n_shingles"), F.col("own").alias("component_id"))
