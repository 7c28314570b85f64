"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard similarity.

Two permutations make all coordinates of a signature: sigma spreads the shingles over the 2^32 places of a circle, and pi,
shifted by k places, gives coordinate k: the least pi((sigma(s) + k) mod 2^32) over the set. Bands of coordinates are hashed to
buckets, candidates from the buckets are confirmed on their full shingle sets, and links make connected components.

Documents with the same set are one node (their copies are never paired). Each bucket has a leader, the member with the
most company over all its buckets, and all members are compared with it: a group of any size costs one comparison for each member and leader.
What this leaves apart from its leader is then compared with the leader's other members through what distinguishes them from the leader:
two sets that are similar enough share a number of such differences that follows from their sizes, so
both have one among their rarest ones (prefix filtering), and only pairs that meet there are confirmed. So every pair of different sets with a common leader is
either in one component or shown or tested to be no link, and no pair is dropped for its number. With the defaults, a pair at the threshold
of 0.8 shares no bucket with a chance of about 1e-8.

Nulls, ties and odd rows: a text without words has an empty set and is linked with nothing; one with fewer words than a shingle has
its whole sequence as the one shingle; rows with a null ``doc_id`` are linked with nothing and kept; rows with the same ``doc_id``
are one document, linked through any of their texts; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stored, table, words
from .substrings import BASE, MIX_1, MIX_2, from_bytes, rolling_hashes, to_bytes

COORDINATES, BANDS = 192, 64
#: Shingles that go through the permutations at once, so that they stay in the processor's cache.
CHUNK = 1 << 15
#: Members that are compared with one copy of a leader's set.
SALT_ROWS = 256
#: Documents whose sets and signatures are in memory at once.
SLICE = 1024


def shingle_sets(tokens: np.ndarray, lengths: np.ndarray, size: int) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its ``size``-word shingles."""
    ends = np.cumsum(lengths)
    starts, hashes = ends - lengths, rolling_hashes(tokens, size)
    out = []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(hashes[a : b - size + 1]))
        else:
            out.append(rolling_hashes(tokens[a:b], b - a) if b > a else tokens[:0])
    return out


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Circulant MinHash of sets that aren't empty: a row of 32-bit coordinates for each."""
    out = np.empty((len(sets), coordinates), np.uint32)
    first = 0
    while first < len(sets):
        last, n = first, 0
        while last < len(sets) and (n == 0 or n + len(sets[last]) <= CHUNK):
            n, last = n + len(sets[last]), last + 1
        flat = np.concatenate(sets[first:last])
        flat = (flat ^ (flat >> np.uint64(29))) * MIX_1
        places = ((flat ^ (flat >> np.uint64(32))) * BASE >> np.uint64(32)).astype(np.uint32)
        begins = np.cumsum([0] + [len(s) for s in sets[first : last - 1]])
        x, y = np.empty_like(places), np.empty_like(places)
        for k in range(coordinates):
            np.add(places, np.uint32(k), out=x)
            for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 0)):
                np.right_shift(x, shift, out=y)
                np.bitwise_xor(x, y, out=x)
                if factor:
                    np.multiply(x, np.uint32(factor), out=x)
            out[first:last, k] = np.minimum.reduceat(x, begins)
        first = last
    return out


def band_hashes(rows: np.ndarray, bands: int) -> np.ndarray:
    """Two groupings of the coordinates, each into half the bands: neighbours, and those a stride apart."""
    half = bands // 2
    n, size = len(rows), rows.shape[1] // half
    groups = np.concatenate([rows.reshape(n, half, size), rows.reshape(n, size, half).swapaxes(1, 2)], axis=1).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * MIX_2, (n, bands)).copy()
    for k in range(size):
        out = (out ^ groups[:, :, k]) * BASE
        out ^= out >> np.uint64(31)
    return (out * MIX_1).view(np.int64)


def _word_hashes(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, F.transform(words(ascii_lower(F.col("text"))), lambda w: F.xxhash64(w)).alias("_hashes"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            yield batch.slice(k, SLICE)


def _sets_of(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    column = batch.column(batch.schema.get_field_index("_hashes"))
    return shingle_sets(np.asarray(column.flatten()).view(np.uint64), np.asarray(column.value_lengths()).astype(np.int64), size)


def _digest(members: np.ndarray) -> bytes | None:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest() if len(members) else None


def sketches(docs: DataFrame, shingle: int, coordinates: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, digest (128 bits that name the set; null if it's empty) and the bands' hashes."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = _sets_of(batch, shingle)
            full = [s for s in sets if len(s)]
            hashes = iter(band_hashes(signatures(full, coordinates), bands) if full else ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(map(_digest, sets), pa.binary()),
                    pa.array([next(hashes) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "digest", "bands"],
            )

    return _word_hashes(docs, "doc_id").mapInArrow(sketch, "doc_id long, n_shingles long, digest binary, bands array<long>")


def _like_sizes(a: str, b: str, percent: int):
    """Sets whose sizes differ by more can't be similar enough."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _side_by_side(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b and others) with both sets. A set that meets many is copied to as many salts as it needs."""
    more = [c for c in pairs.columns if c not in ("a", "b")]
    # Written, so that the joins below are between exchanges, whose large partitions Spark can split.
    salts = stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).alias("salts")), "salts")
    salted = pairs.join(salts, "a").select(*pairs.columns, F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
    left = sets.join(salts, sets.node == salts.a).select("a", F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt"), F.col("n").alias("a_n"), F.col("members").alias("a_set"))
    right = salted.join(sets, salted.b == sets.node).select("a", "salt", "b", *more, F.col("n").alias("b_n"), F.col("members").alias("b_set"))
    return right.join(left, ["a", "salt"]).select("a", "b", "a_n", "b_n", "a_set", "b_set", *more)


def _decoded(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    known, values = None, None
    for k in range(batch.num_rows):
        data = batch.column(4)[k].as_py()
        if data != known:
            known, values = data, from_bytes(data)
        yield values, from_bytes(batch.column(5)[k].as_py())


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            a, b, a_n, b_n = (batch.column(k).to_pylist() for k in range(4))
            shared = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in _decoded(batch)]
            keep = [100 * n >= percent * (p + q - n) for n, p, q in zip(shared, a_n, b_n, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, k in zip(c, keep, strict=True) if k], pa.int64()) for c in (a, b)], ["a", "b"])

    return _side_by_side(pairs, sets).mapInArrow(compare, "a long, b long")


def _differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """For pairs (a, b, component, open) what only one of the sets has, and how much that is of each; a's own are even numbers, b's odd."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            lacks, adds, both = [], [], []
            for x, y in _decoded(batch):
                lacked, added = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                lacks.append(len(lacked))
                adds.append(len(added))
                both.append(np.concatenate([lacked * np.uint64(2), added * np.uint64(2) + np.uint64(1)]).view(np.int64))
            columns = [batch.column(k) for k in (0, 1, 2, 3, 6, 7)] + [pa.array(lacks, pa.int64()), pa.array(adds, pa.int64()), pa.array(both, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "a_n", "b_n", "component", "open", "lacks", "adds", "elements"])

    return _side_by_side(pairs, sets).mapInArrow(compare, "a long, b long, a_n long, b_n long, component long, open boolean, lacks long, adds long, elements array<long>")


def _meeting(star: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one leader's members that may be links between components.

    Sets x and y that lack and add some of leader c's elements share |c| - lacks(x) - lacks(y) + (shared differences), which must be
    t (|x| + |y|) at least, with t = percent / (100 + percent). An open member, one that isn't linked with the leader, has k = t (|x| + |c|) - |c| + lacks(x) > 0.
    From that follow the least numbers of shared differences: k / (1 - t) for an open member with any other, k + (1 - 2 t) |c| for two open
    ones, and (1 - t) lacks(y) + t adds(y) for a linked one with an open one.
    """
    of_a, of_b = labels.select(F.col("node").alias("a"), F.col("component").alias("_ca")), labels.select(F.col("node").alias("b"), F.col("component").alias("_cb"))
    placed = star.select("a", "b").join(of_a, "a", "left").join(of_b, "b", "left").select("a", "b", F.coalesce("_cb", "b").alias("component"), (F.coalesce("_ca", "a") != F.coalesce("_cb", "b")).alias("open"))
    several = stored(placed.groupBy("a").agg(F.count("*").alias("all"), F.count_if("open").alias("n_open")).where("all > 1 AND n_open > 0").select("a"), "open-stars")
    found = stored(_differences(placed.join(several, "a", "left_semi"), sets), "differences")

    t, tiny = percent / (100 + percent), 1 / (100 + percent)  # differences of counts times t are multiples of tiny
    prefix = lambda least: F.size("elements") - F.greatest(F.lit(1), F.ceil(least - 1e-9)) + 1
    k = t * (F.col("b_n") + F.col("a_n")) - F.col("a_n") + F.col("lacks")
    with_any = F.when(F.col("open"), k / (1 - t)).otherwise((1 - t) * F.col("lacks") + t * F.col("adds") + tiny)
    member = F.struct("b", F.col("b_n").alias("n"), "component", "lacks", "adds", prefix(with_any).alias("p_any"), prefix(k + (1 - 2 * t) * F.col("a_n") + tiny).alias("p_open"))
    rows = found.withColumn("m", member).select("a", "a_n", "open", "b", "m", F.explode("elements").alias("e"))
    common = rows.groupBy("a", "e").agg(F.count("*").alias("times"))
    # Elements that one member alone has come first in every order, and meet nothing; only their number matters.
    several = rows.join(common, ["a", "e"]).withColumn("alone", F.count_if(F.col("times") == 1).over(Window.partitionBy("a", "b")))
    several = several.where("times > 1").withColumn("place", F.col("alone") + F.row_number().over(Window.partitionBy("a", "b").orderBy("times", "e")))
    end = lambda p: F.max(F.when(F.col("place") <= F.col(f"m.{p}"), F.struct("times", "e"))).over(Window.partitionBy("a", "b"))
    several = several.withColumn("end_any", end("p_any")).withColumn("end_open", end("p_open"))
    ranked = stored(several.where("place <= m.p_any OR (open AND place <= m.p_open)").select("a", "a_n", "e", "open", "m", "place", "end_any", "end_open"), "prefixes")

    mine = ranked.where("open").select("a", "e", F.col("m").alias("x"), F.col("place").alias("x_place"), F.col("end_any").alias("x_any"), F.col("end_open").alias("x_open"))
    # For two open members the prefixes are those for open ones; each pair of them counts once.
    own, other = F.when(F.col("open"), F.col("x.p_open")).otherwise(F.col("x.p_any")), F.when(F.col("open"), F.col("m.p_open")).otherwise(F.col("m.p_any"))
    wanted = t * (F.col("x.n") + F.col("m.n")) - F.col("a_n") + F.col("x.lacks") + F.col("m.lacks") - 1e-9
    can = (F.least("x.lacks", "m.lacks") + F.least("x.adds", "m.adds") >= wanted) & _like_sizes("x.n", "m.n", percent)
    meet = (F.col("x_place") <= own) & (F.col("place") <= other) & (~F.col("open") | (F.col("x.b") < F.col("m.b"))) & (F.col("x.component") != F.col("m.component"))
    met = mine.join(ranked, ["a", "e"]).where(meet & can)
    # What is shared beyond the prefixes lies in the rest of the one that ends first (the other may hold it in its prefix), and behind the last meeting in both.
    x_first = F.when(F.col("open"), F.col("x_open") <= F.col("end_open")).otherwise(F.col("x_any") <= F.col("end_any"))
    x_size, m_size = F.col("x.lacks") + F.col("x.adds"), F.col("m.lacks") + F.col("m.adds")
    rest = F.least(F.first(F.when(x_first, x_size - own).otherwise(m_size - other)), F.first(x_size) - F.max("x_place"), F.first(m_size) - F.max("place"))
    pairs = met.groupBy("a", F.col("x.b").alias("p"), F.col("m.b").alias("q")).agg(F.count("*").alias("shared"), rest.alias("rest"), F.first(wanted).alias("wanted"))
    return pairs.where("shared + rest >= wanted").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node that it reaches) for the nodes of ``links`` (a, b): least labels and pointer jumps."""
    both = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen"))
        near = labels.join(seen, "node").select("node", F.col("component").alias("old"), F.least("component", "seen").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        moved = stored(near.join(jump, "component").select("node", "old", F.least("component", "next").alias("component")), "labels")
        if not moved.where("component <> old").limit(1).count():
            return labels
        labels = moved.select("node", "component")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, coordinates: int = COORDINATES, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (it is the component's smallest) for each row of ``docs`` (doc_id, text)."""
    if bands % 2 or coordinates % (bands // 2):
        raise ValueError("bands must be even, and half of them divide the coordinates")
    docs = docs.select("doc_id", "text")
    sketched = stored(sketches(docs, shingle, coordinates, bands), "sketches")
    nodes = sketched.where("doc_id IS NOT NULL AND digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))

    # Buckets are counted with partial sums, and only those that hold several are kept; nothing is sorted by bucket.
    entries = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = stored(entries.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    repeated = stored(sketched.where("doc_id IS NOT NULL AND digest IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.xxhash64("digest")).alias("low"), F.max(F.xxhash64("digest")).alias("high")).where("n > 1"), "repeated-ids")
    same = _same_document(sketched, nodes, repeated.where("low < high"))
    if not shared.limit(1).count():
        return _labelled(sketched, nodes, components(same))
    members = stored(entries.join(shared, "bucket"), "members")
    company = stored(members.groupBy("node").agg(F.sum("size").alias("company")), "company")
    leaders = members.join(company, "node").groupBy("bucket").agg(F.max(F.struct("company", (-F.col("node")).alias("node"), "n")).alias("leader"))
    star = members.join(stored(leaders, "leaders"), "bucket").select((-F.col("leader.node")).alias("a"), F.col("leader.n").alias("a_n"), F.col("node").alias("b"), F.col("n").alias("b_n")).where("a <> b").distinct()
    star = stored(star, "stars")

    wanted = star.select(F.col("a").alias("node")).union(star.select("b")).distinct()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = _sets_of(batch, shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([to_bytes(s) for s in sets], pa.binary()), pa.array(map(_digest, sets), pa.binary())], ["node", "n", "members", "digest"])

    # The wanted ids grow with the corpus, so they are never broadcast.
    chosen = docs.join(wanted.hint("merge"), docs.doc_id == wanted.node, "left_semi")
    sets = _word_hashes(chosen, "doc_id").mapInArrow(gather, "node long, n long, members binary, digest binary").where("n > 0")
    if repeated.limit(1).count():  # of several rows of one doc_id, one that has the node's set
        sets = sets.join(nodes.select("node", "digest"), ["node", "digest"], "left_semi").dropDuplicates(["node"])
    sets = stored(sets.drop("digest"), "sets")

    links = stored(same.unionByName(_confirmed(star.where(_like_sizes("a_n", "b_n", percent)).select("a", "b"), sets, percent)), "links")
    labels = components(links)
    more = stored(_confirmed(_meeting(star, labels, sets, percent), sets, percent), "links")
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    return _labelled(sketched, nodes, labels)


def _same_document(sketched: DataFrame, nodes: DataFrame, repeated: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of the rows of each ``repeated`` doc_id."""
    if not repeated.limit(1).count():
        return repeated.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    rows = sketched.join(repeated, "doc_id", "left_semi").select("doc_id", "digest").distinct()
    found = stored(rows.join(nodes.select("digest", "node"), "digest").select("doc_id", "node"), "repeated-nodes")
    first = stored(found.groupBy("doc_id").agg(F.min("node").alias("a")), "repeated-first")
    return found.join(first, "doc_id").where("a <> node").select("a", F.col("node").alias("b")).distinct()


def _labelled(sketched: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    # Written, so that the join below is between exchanges: a set that many rows have is split.
    named = stored(nodes.select("digest", "node").join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("found")), "named")
    rows = sketched.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id")
    return rows.select("doc_id", "n_shingles", own).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


#: Every pair of documents that share a shingle is compared: for small tables.
OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]] ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.least AS component_id, c.least = d.doc_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(seen) AS least FROM r GROUP BY 1) c ON c.node = d.doc_id
"""
