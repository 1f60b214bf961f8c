"""Exact Jaccard join of word shingles by universe partition.

The set of a text is its distinct 5-word shingles.  Texts with equal sets form
one node, so that copies meet once.  Two sets of sizes s and l link at a
Jaccard similarity of 0.8 only if they differ in at most (s + l) / 9 shingles.

Sizes fall into bands [2^k, 2^(k+1)).  A band cuts the universe of shingles by
hash into m segments, and a set's part in a segment is a subset.  A node
indexes its non-empty subsets in its own band and probes that band and, if its
smaller partners may lie there, the band below.  A segment with allowance v
finds partners whose subset differs in at most v shingles, and counts v + 1; if
the segments that a probe uses count more than the largest possible difference
D, then, by the pigeonhole principle, every partner shows in one of them.
Allowance 1 costs an index entry for each subset less one shingle (the
one-deletion neighbourhood), so only bands of small sets, whose subsets tell
little, have it (for subsets of two shingles or more); all others have 0.

Allocation goes by cost: the cost of a segment is the number of index entries
under its keys, nothing if no other set has them.  Each probe drops its
dearest segments, as far as the rest still proves.  A set that has enough keys
of its own is thus proved to have no partner.  The rare set whose shingles fall
into too few segments for the proof meets its partners by single shingles.

The kept entries group nodes under keys.  In rounds, the nodes under a key are
verified exactly against its heads, the nodes that meet most others; the middle
of a group of near copies is such a node, and joins it in one round.  Keys whose
nodes all became one component are done; the others go on without their heads.
Before the next round the shingles of the remaining nodes are counted over
components: a node whose shingles are too rarely shared for any link leaves, so
copies that differ too much from all others cost rows, not pairs.  After the
last round the nodes that are left meet by their rarest shingles: in one order
of all shingles, rare ones first, two sets that link share one of the first
fifth of each.  Links inside a component need no further check.  Parities of the
sets, one bit for each of many parts of the universe, rule out most pairs that
do not link before their texts are read.

Shingles are 64-bit hashes of the words' hashes, and equal sets are those with
equal 128-bit hashes; a pair of n shingles is misjudged with a chance of about
n^2 / 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm.common import discard, fresh, materialize, materialize_by, texts_of
from lamina.llm.components import components

#: Words of a shingle, and the threshold 80 / 100.
WORDS = 5
LEAST, OF = 80, 100
#: Sizes below which no two different sets can link; bands below SMALL index one-deletion neighbourhoods.
FIRST, SMALL = 4, 32
#: Nodes under a key that the others meet, by round; what is left then meets by rare shingles.
HEADS = (1, 32)
#: Shingles of a bucket of texts; least and most buckets.
PART, LEAST_PARTS, MOST_PARTS = 1 << 21, 8, 100_000
#: 64-bit numbers of a set's parities.
PARITIES = 16
#: Pairs of one node that go to one task.
SALT = 256

_mix1, _mix2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_places = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * _mix1
    x = (x ^ (x >> np.uint64(33))) * _mix2
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's 5-word shingles; of the whole sequence if it has fewer words.

    Words are runs without ASCII white space, A-Z lower-cased: what bytes.lower and bytes.split do.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    count = len(words) - WORDS + 1
    total = hashed[:count] * _places[0]
    for place in range(1, WORDS):
        total += hashed[place : place + count] * _places[place]
    total = mix(total)
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])] if count > 1 else total


def band_of(size: int) -> int:
    return size.bit_length() - 1


def segments_of(band: int) -> int:
    """m of a band: enough that the non-empty subsets can cover the largest difference, with some to spare."""
    largest = (2 << band) - 1
    most = (largest + largest * OF // LEAST) // 9
    if largest < SMALL:
        return most // 2 + 1 + (band > 2)
    return most + 1 + max(8, most // 10)


def entries(found: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, infos) of a set; an info packs spare << 40 | segment << 8 | lower band << 4 | wild << 2 | probes << 1 | indexes.

    spare is the number of segments that the probe can do without.
    """
    size = len(found)
    if size < FIRST:
        return
    own = band_of(size)
    for band in (own, own - 1):
        largest = min(size, (2 << band) - 1)
        if largest < FIRST or LEAST * size > OF * largest:
            continue
        m, lower = segments_of(band), int(band != own) << 4
        segment = ((found >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)  # rising, as found is
        first = np.flatnonzero(np.diff(segment, prepend=-1))
        spread = mix(found ^ _places[3])
        sums = np.add.reduceat(spread, first)
        small = (2 << band) <= SMALL
        counts = np.diff(np.append(first, size))
        spare = int((1 + (counts > 1)).sum() if small else len(first)) - (size + largest) // 9 - 1
        wild, spare = spare < 0, max(0, spare // 2 if small else spare)
        base = spare << 40 | lower
        keys = mix(sums ^ mix(segment[first].astype(np.uint64) + np.uint64(band << 40)))
        infos = segment[first] << 8 | base
        yield keys, infos | (2 if lower else 3)
        if wild:
            yield mix(found[:1] ^ _places[2]), np.array([base | 4])
        if small:
            own_segment = np.repeat(np.arange(len(first)), counts)
            several = counts[own_segment] > 1
            left = sums[own_segment] - spread
            less = mix(left ^ mix(segment.astype(np.uint64) + np.uint64(band << 40)))[several]
            less_infos = (segment << 8 | base)[several]
            yield less, less_infos | 2
            if not lower:
                yield mix(less ^ _places[4]), less_infos | 1
            yield mix(keys ^ _places[4]), infos | 2


def parities(found: np.ndarray) -> np.ndarray:
    """One bit for each part of the universe: whether the set has an odd number of its shingles there.

    A shingle that only one of two sets has turns one bit, so the sets differ in as many shingles as bits at least.
    """
    odd = np.bincount((found >> np.uint64(64 - 10)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, h, f1, f2, n, bits: hash of id and text, 128 bits over its set, the set's size and parities; one row per row of `docs`."""

    def emit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            prints, sizes, bits = [], [], []
            for text in texts_of(part.column(2)):
                found = shingles(text)
                sizes.append(len(found))
                bits.append(parities(found))
                prints.append(xxhash.xxh3_128_digest(found.tobytes()))
            halves = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
            columns = {"doc_id": part.column(0), "h": part.column(1), "f1": halves[:, 0].copy(), "f2": halves[:, 1].copy(), "n": np.array(sizes, np.int64)}
            ends = pa.array(np.arange(len(bits) + 1, dtype=np.int32) * PARITIES)
            yield pa.RecordBatch.from_pydict(columns | {"bits": pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *bits])))})

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("doc_id").cast("long"), text), text).mapInArrow(emit, "doc_id long, h long, f1 long, f2 long, n long, bits array<long>")


def _node_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """h, node, text: the text that stands for each of `nodes`, once, bucketed by the row's hash.

    This is the only shuffle of texts by row: later joins of chosen nodes read the buckets where they lie.
    """
    total = nodes.agg(F.sum("n")).first()[0] or 0
    parts = min(MOST_PARTS, LEAST_PARTS + total // PART)
    text = F.col("text").cast("string")
    rows = docs.select(F.xxhash64(F.col("doc_id").cast("long"), text).alias("h"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where("text is not null").repartition(parts, "h").distinct()
    stand = nodes.select("node", "rep", "rep_hash").hint("shuffle_hash")
    same = F.expr("(doc_id is null and rep is null) or doc_id - rep = 0")  # no join key, so that rows stay where h put them
    own = rows.join(stand, (F.col("h") == F.col("rep_hash")) & same).select("h", "node", "text")
    return materialize_by(own, "h", parts, "jaccard-texts")


def _texts(texts: DataFrame, nodes: DataFrame, some: DataFrame) -> DataFrame:
    """node, text of the nodes in `some` (node, distinct)."""
    wanted = nodes.select("node", "rep_hash").join(some.select("node"), "node", "left_semi")
    return texts.join(wanted.withColumnRenamed("node", "own").hint("shuffle_hash"), (F.col("h") == F.col("rep_hash")) & F.expr("node - own = 0")).select("node", "text")


def _entries(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, node, info of the nodes' texts (node, text)."""
    for part in parts:
        held: list[tuple[np.ndarray, np.ndarray, int]] = []
        rows = 0
        for node, text in zip(part.column(0).to_pylist(), texts_of(part.column(1)), strict=True):
            for keys, infos in entries(shingles(text)):
                held.append((keys, infos, node))
                rows += len(keys)
            if rows > 1 << 17:
                yield _entry_rows(held)
                held, rows = [], 0
        if held:
            yield _entry_rows(held)


def _entry_rows(held: list[tuple[np.ndarray, np.ndarray, int]]) -> pa.RecordBatch:
    nodes = np.repeat(np.array([node for *_, node in held], np.int64), [len(keys) for keys, *_ in held])
    return pa.RecordBatch.from_pydict({"key": np.concatenate([x[0] for x in held]).view(np.int64), "node": nodes, "info": np.concatenate([x[1] for x in held]).astype(np.int64)})


def _met(rows: DataFrame) -> DataFrame:
    """The entries under keys where a probe meets another node's index entry, with the number of index entries; and wild marks."""
    own = Window.partitionBy("key")
    counted = rows.withColumns({"indexed": F.sum(F.expr("info & 1")).over(own), "probed": F.sum(F.expr("shiftright(info, 1) & 1")).over(own), "met": F.count("*").over(own)})
    return counted.where("(met > 1 and indexed > 0 and probed > 0) or (info & 4) > 0").drop("probed", "met")


def _allocated(rows: DataFrame) -> DataFrame:
    """Drops each probe's dearest segments as far as it can spare them; index entries and wild marks stay."""
    segment = Window.partitionBy("node", "lower", "segment")
    dearest = Window.partitionBy("node", "lower").orderBy(F.desc("cost"), "segment")
    split = rows.withColumns({"lower": F.expr("shiftright(info, 4) & 1"), "segment": F.expr("shiftright(info, 8) & 4294967295"), "spare": F.expr("shiftright(info, 40)")})
    costs = split.withColumn("cost", F.sum(F.expr("if((info & 2) > 0, indexed, 0)")).over(segment))
    placed = costs.withColumn("place", F.dense_rank().over(dearest))
    return placed.withColumn("info", F.expr("if(place <= spare, info & ~2, info)")).where("(info & 7) > 0").select("key", "node", "info", "n")


def _wild_pairs(wild: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b: nodes that fit a wild node in size and share a shingle of both prefixes in hash order."""
    own = nodes.join(wild, "node", "left_semi")
    sizes = own.agg(F.min("n"), F.max("n")).first()
    near = nodes.where(F.col("n").between(sizes[0] * LEAST // OF, -(-sizes[1] * OF // LEAST)))
    schema = "shingle long, node long"
    few = _texts(texts, nodes, own).mapInArrow(_prefixes, schema)
    many = _texts(texts, nodes, near).mapInArrow(_prefixes, schema)
    return few.toDF("shingle", "b").join(many.toDF("shingle", "a"), "shingle").where("a <> b").select("a", "b").distinct()


def linked(one: np.ndarray, other: np.ndarray) -> bool:
    """Whether OF * intersection >= LEAST * union for two sorted sets."""
    few, many = (one, other) if len(one) <= len(other) else (other, one)
    if not len(few) or OF * len(few) < LEAST * len(many):
        return False
    at = np.minimum(np.searchsorted(many, few), len(many) - 1)
    both = int((many[at] == few).sum())
    return OF * both >= LEAST * (len(one) + len(other) - both)


def _verify(pairs: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b of the linked ones among `pairs` (a, b), by exact intersection.

    The pairs of a node b are dealt over tasks by SALT; each task reads b's text once, ahead of the texts
    of its partners, and holds two sets at a time.
    """
    involved = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    own = materialize(_texts(texts, nodes, involved), "jaccard-own")
    loads = pairs.groupBy("b").agg(F.ceil(F.count("*") / SALT).alias("tasks"))
    dealt = pairs.join(loads, "b").select("a", "b", F.pmod(F.xxhash64("a"), "tasks").alias("salt"))
    one = own.join(dealt, F.col("node") == F.col("a")).select("b", "salt", "a", "text")
    other = own.join(loads, F.col("node") == F.col("b")).select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("salt"), F.lit(None).cast("long").alias("a"), "text")
    rows = one.unionByName(other).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = np.empty(0, np.uint64)
        for part in batches:
            left, right = [], []
            for b, a, text in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), texts_of(part.column(3)), strict=True):
                found = shingles(text)
                if a is None:
                    current = found
                elif linked(found, current):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_pydict({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    found = materialize(rows.mapInArrow(compare, "a long, b long"), "jaccard-links")
    discard(own)
    return found


_fits = f"{OF} * least(n, rep_n) >= {LEAST} * greatest(n, rep_n)"
_differ = " + ".join(f"bit_count(bits[{i}] ^ rep_bits[{i}])" for i in range(PARITIES))
_near = f"{OF + LEAST} * ({_differ}) <= {OF - LEAST} * (n + rep_n)"
_covers = f"{OF + LEAST} * least(shared, rep_shared) >= {LEAST} * (n + rep_n)"


def _exploded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """shingle, node of texts (node, text)."""
    for part in parts:
        for node, text in zip(part.column(0).to_pylist(), texts_of(part.column(1)), strict=True):
            found = shingles(text).view(np.int64)
            yield pa.RecordBatch.from_pydict({"shingle": found, "node": np.full(len(found), node, np.int64)})


def _prefixes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """shingle, node of the first shingles in hash order of texts (node, text): as many as no partner can do without."""
    for part in parts:
        for node, text in zip(part.column(0).to_pylist(), texts_of(part.column(1)), strict=True):
            found = shingles(text)
            found = found[: len(found) - -(-LEAST * len(found) // OF) + 1].view(np.int64)
            yield pa.RecordBatch.from_pydict({"shingle": found, "node": np.full(len(found), node, np.int64)})


def _listed(rows: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """shingle, node, root of the nodes of `rows`."""
    open_ = rows.select("node", "root").distinct()
    return materialize(_texts(texts, nodes, open_).mapInArrow(_exploded, "shingle long, node long").join(open_, "node"), "jaccard-shingles")


def _possible(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """The rows (key, node, n, root) that may still link to another component, with `shared`.

    shared is the number of a node's shingles that a remaining node of another component has too.  No new
    link of the node holds more of its shingles, and a link of sets of sizes s and l holds at least
    4 (s + l) / 9; so under each key a node stays only if that fits the smallest partner it could have.
    """
    common = listed.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("shingle")
    shared = listed.join(common, "shingle", "left_semi").groupBy("node").agg(F.count("*").alias("shared"))
    least = rows.groupBy("key").agg(F.min("n").alias("least"))
    room = f"{OF + LEAST} * shared >= {LEAST} * n + {LEAST} * greatest(least, ceil({LEAST} * n / {OF}))"
    return materialize(rows.join(shared, "node").join(least, "key").where(room).select("key", "node", "n", "root", "shared"), "jaccard-possible")


def _rare_pairs(rows: DataFrame, listed: DataFrame, parity: DataFrame) -> DataFrame:
    """a, b: the pairs of different components of `rows` that share one of both sets' rarest shingles, and may link by size and parities.

    In one order of all shingles, here by the number of remaining nodes that have them, two sets that link
    share one of the first n - ceil(0.8 n) + 1 of each.  What a large group has in common is frequent, so
    comes last, and texts that are alike but do not link meet nowhere.
    """
    own = rows.groupBy("node").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.first("shared").alias("shared"))
    held = listed.select("shingle", "node").join(own.select("node", "n"), "node")
    counted = held.groupBy("shingle").agg(F.count("*").alias("texts"))
    order = Window.partitionBy("node").orderBy("texts", "shingle")
    first = held.join(counted, "shingle").withColumn("place", F.row_number().over(order)).where(f"place <= n - ceil({LEAST} * n / {OF}) + 1 and texts > 1")
    full = materialize(first.select("shingle", "node").join(own, "node").join(parity, "node"), "jaccard-rare")
    other = full.toDF("shingle", "rep", "rep_n", "rep_root", "rep_shared", "rep_bits")
    met = full.join(other, "shingle").where("root < rep_root").where(_fits).where(_covers).where(_near)
    out = materialize(met.select(F.greatest("node", "rep").alias("a"), F.least("node", "rep").alias("b")).distinct(), "jaccard-pairs")
    discard(full)
    return out


def _heads(rows: DataFrame, most: int) -> DataFrame:
    """key, rep, rep_n, rep_root, rep_shared: under each key the `most` nodes that meet most others under all their keys.

    The order of nodes is the same for all keys, so the middle of a group of near copies leads wherever it is.
    """
    sizes = rows.groupBy("key").agg(F.count("*").alias("size"))
    weights = rows.select("key", "node").join(sizes, "key").groupBy("node").agg(F.sum("size").alias("weight"))
    order = Window.partitionBy("key").orderBy(F.desc("weight"), "node")
    first = rows.join(weights, "node").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return first.select("key", F.col("node").alias("rep"), F.col("n").alias("rep_n"), F.col("root").alias("rep_root"), F.col("shared").alias("rep_shared"))


def _reduced(rows: DataFrame) -> DataFrame:
    """The rows under keys that still hold two components."""
    several = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return rows.join(several, "key", "left_semi")


def _links(rows: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """Verified edges (a, b) that connect whatever links under the keys of `rows` (key, node, n, root)."""
    edges: DataFrame | None = None
    parity = nodes.select("node", "bits")
    rows, listed = rows.withColumn("shared", F.col("n")), None
    for most in HEADS:
        if not rows.limit(1).count():
            break
        heads = materialize(_heads(rows, most), "jaccard-heads")
        pairs = rows.join(parity, "node").join(heads.join(parity.toDF("rep", "rep_bits"), "rep"), "key").where("root <> rep_root").where(_fits).where(_covers).where(_near)
        pairs = materialize(pairs.select(F.greatest("node", "rep").alias("a"), F.least("node", "rep").alias("b")).distinct(), "jaccard-pairs")
        found = _verify(pairs, texts, nodes)
        edges = found if edges is None else edges.unionByName(found)
        roots = components(edges)
        now = rows.select("key", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        done = heads.select("key", F.col("rep").alias("node"))
        left = materialize(_reduced(now.join(done, ["key", "node"], "left_anti")), "jaccard-left")
        discard(pairs, heads, roots, rows, listed)
        listed = _listed(left, texts, nodes)
        rows = _possible(left, listed)
        discard(left)
    if listed is not None and rows.limit(1).count():
        pairs = _rare_pairs(rows, listed, parity)
        edges = edges.unionByName(_verify(pairs, texts, nodes))
        discard(pairs)
    discard(rows, listed)
    return edges


def _classified(docs: DataFrame) -> DataFrame:
    """doc_id, h, n, component, class_: the rows of `docs` with their component's name and its smallest node."""
    prints = materialize(fingerprints(docs), "jaccard-prints")
    stand = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h")).alias("r")
    classes = prints.where("n > 0").groupBy("f1", "f2").agg(stand, F.max("n").alias("n"), F.first("bits").alias("bits"))
    nodes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "f1", "f2", "n", "bits", F.col("r.doc_id").alias("rep"), F.col("r.h").alias("rep_hash")), "jaccard-nodes")
    texts = _node_texts(docs, nodes.where(F.col("n") >= FIRST))
    listed = texts.select("node", "text").mapInArrow(_entries, "key long, node long, info long")
    allocated = _allocated(_met(listed).join(nodes.select("node", "n"), "node"))
    kept = materialize(_met(allocated).withColumn("root", F.col("node")), "jaccard-kept")
    edges = _links(kept.where("(info & 4) = 0").select("key", "node", "n", "root"), texts, nodes)
    wild = kept.where("(info & 4) > 0").select("node").distinct()
    if wild.limit(1).count():
        more = _verify(materialize(_wild_pairs(wild, texts, nodes), "jaccard-wild"), texts, nodes)
        edges = more if edges is None else edges.unionByName(more)
    discard(kept, texts)
    named = nodes.select("f1", "f2", F.col("rep").alias("component"), F.col("node").alias("class_"))
    if edges is not None:
        roots = components(edges)
        names = roots.join(nodes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("name"))
        named = nodes.join(roots, "node", "left").join(names, "root", "left").select("f1", "f2", F.coalesce("name", "rep").alias("component"), F.coalesce("root", "node").alias("class_"))
    out = prints.drop("bits").join(named, ["f1", "f2"], "left")
    return out.select("doc_id", "h", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component"), "class_")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of `docs` (doc_id, text).

    n_shingles is the size of the text's set, component_id the smallest doc_id reachable by links, the
    document's own included.  Null and empty texts and texts without words have size 0 and link with
    nothing, so they keep their own id; rows that agree in their set are one class, repeated rows and
    repeated ids included; a null id is a component's id only if all its ids are null; an empty table gives
    no rows.  Other columns are ignored.
    """
    return _classified(docs).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, unchanged, one for each component: the one with the smallest id.

    Null and empty texts and texts without words are all kept; of rows that agree in id and text one is
    kept; a null id stands only where a component has no other; an empty table gives no rows.
    """
    keep_id, keep_h, row_h, row_n = (fresh(docs, stem) for stem in ("keep_id", "keep_h", "row_h", "row_n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h")).alias("r")
    keep = _classified(docs).where("n > 0").groupBy("class_").agg(least).select(F.col("r.doc_id").alias(keep_id), F.col("r.h").alias(keep_h))
    text, own = F.col("text").cast("string"), F.col("doc_id").cast("long")
    worded = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.where(worded).withColumn(row_h, F.xxhash64(own, text)).join(keep, (F.col(row_h) == F.col(keep_h)) & own.eqNullSafe(F.col(keep_id)))
    first = rows.withColumn(row_n, F.row_number().over(Window.partitionBy(keep_id, keep_h).orderBy(F.lit(0)))).where(F.col(row_n) == 1)
    return first.select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(docs.where(~worded))


_upper, _lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All pairs that share a shingle, for DuckDB.
ORACLE = rf"""
with recursive d as (
  select doc_id, coalesce(regexp_extract_all(translate(text, '{_upper}', '{_lower}'), '[^\x20\x09-\x0D]+'), []) as w from documents),
s as (select distinct doc_id, case when len(w) < {WORDS} then array_to_string(w, ' ') else array_to_string(w[i:i + {WORDS - 1}], ' ') end as g
  from d, unnest(range(1, greatest(len(w) - {WORDS - 1}, least(len(w), 1)) + 1)) as r(i)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where {OF} * shared >= {LEAST} * (x.n + y.n - shared)),
e as (select a, b from l union all select b, a from l),
c(doc_id, root) as (select doc_id, doc_id from d union select e.a, c.root from e join c on e.b = c.doc_id)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(c.root) as component_id
from d join c on d.doc_id = c.doc_id left join n on d.doc_id = n.doc_id group by d.doc_id
"""
