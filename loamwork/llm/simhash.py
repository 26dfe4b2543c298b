"""SimHash near-dedup: fingerprints, pigeonring candidate filtering, components of links."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import connected_components, drop_stage, map_arrow, partitions, stage, text_slices

SEED = 42
#: Rows of one bucket that are compared at once; larger buckets are cut into blocks of this size.
BLOCK = 1024
#: Rows of a bucket of which all pairs are compared at once; a larger one yields a spanning forest.
SMALL = 8
_SPAN = 1 << 16


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``size`` words joined by a space; fewer words: of the whole sequence."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1].tolist()
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint: a bit is 1 if it is set in over half of the hashes; none: zero."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _SPAN):
        part = np.ascontiguousarray(hashes[i : i + _SPAN].astype(">u8")).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8)).view(">u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: (doc_id, fp), fp as a signed 64-bit number. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            fps = [majority(shingle_hashes(words_of(t), shingle_words)) for t in part.column("text").to_pylist()]
            yield pa.record_batch([part.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, fp long")


def _bits(fp: str, low: int, width: int):
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def ring_keys(fp: str = "fp"):
    """Index keys for distance 3 over four 16-bit segments of a 64-bit fingerprint.

    Pigeonring: a pair within 3 has a segment from which the differences of 1, 2, 3, 4 consecutive
    segments stay within 3/4 of a bit a segment, that is 0, 1, 2, 3. So that segment is equal and of
    the next one at least one 8-bit half is: eight keys of 24 bits a fingerprint find every pair.
    """
    keys = []
    for i in range(4):
        here, after = 16 * i, 16 * ((i + 1) % 4)
        for half in range(2):
            keys.append(F.lit((2 * i + half) << 24).bitwiseOR(F.shiftleft(_bits(fp, here, 16), 8)).bitwiseOR(_bits(fp, after + 8 * half, 8)).cast("long"))
    return F.array(*keys)


def ring_close(diff: np.ndarray, start: np.ndarray | int, budget: int = 3) -> np.ndarray:
    """Which XORs of 64-bit fingerprints pass the chain from 16-bit segment ``start`` and the full check."""
    near, total = np.ones(len(diff), bool), np.zeros(len(diff), np.int64)
    for step in range(4):
        shift = np.asarray(16 * ((start + step) % 4)).astype(np.uint64)
        total = total + np.bitwise_count((diff >> shift) & np.uint64(0xFFFF))
        near &= total <= (step + 1) * budget // 4
    return near


def forest(size: int, close) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links ``close(i, others)`` shows; each row is expanded once."""
    left, edges = np.arange(size), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = close(i, left)
            found = left[hit]
            edges += [(i, int(j)) for j in found]
            queue += found.tolist()
            left = left[~hit]
    return edges


def linked_components(rows: DataFrame, values: list[str], near, block: int = BLOCK) -> DataFrame:
    """(node, component) of the links between rows (key, id, *values) of equal key.

    ``near(rows, i, j)`` tells which pairs of places in the arrays ``rows`` link. A bucket is cut into
    blocks by a hash of the id. First each block by itself yields a spanning forest of its links,
    whose components are found over all buckets. Then, in buckets of several blocks, rows outside a
    bucket's largest component are compared with all rows of the bucket, in tasks of two blocks.
    Rows of one component need no further comparison, so no link between components is missed, and
    a large group of close rows isn't compared pair by pair.
    """
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cut = rows.join(sizes, "key").withColumn("parts", F.ceil(F.col("n") / F.lit(block)).cast("int")).drop("n")
    cut = cut.withColumn("b", F.pmod(F.xxhash64("id", "key"), F.col("parts")).cast("int"))
    cut = stage(cut.select("key", "b", "parts", "id", *values), "buckets")
    n = partitions(rows.sparkSession)
    dealt = cut.select("key", "b", "id", *values).repartition(n, "key", "b").sortWithinPartitions("key", "b")
    first = connected_components(map_arrow(dealt, _by_group(("key", "b"), _block_links(near)), "u long, v long").distinct())
    crowded = cut.where("parts > 1")
    if crowded.isEmpty():
        drop_stage(cut)
        return first
    first = stage(first, "first")
    known = _open_rows(crowded, first)
    both = _probes(known, values, n)
    more = stage(map_arrow(both, _by_group(("key", "b", "p"), _probe_links(near)), "u long, v long").distinct(), "more")
    drop_stage(cut)
    drop_stage(known)
    out = connected_components(more.unionByName(first.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    drop_stage(more)
    return out


def _open_rows(cut: DataFrame, components: DataFrame) -> DataFrame:
    """Rows of buckets of several components, with their component ``c``, the bucket's largest, ``top``, and
    ``probe_parts``, the blocks of rows outside that."""
    known = cut.join(components.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    largest = known.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("top"), F.sum("n").alias("all"), F.max("n").alias("most"))
    open_keys = largest.where("most < all").withColumn("probe_parts", F.ceil((F.col("all") - F.col("most")) / F.lit(BLOCK)).cast("int")).select("key", "top", "probe_parts")
    return stage(known.join(open_keys, "key"), "open")


def _probes(known: DataFrame, values: list[str], n: int) -> DataFrame:
    """``_open_rows`` dealt so that those outside a bucket's largest component (``probe`` 1) meet all its rows:
    tasks of a block (``b``) and a block of probes (``p``)."""
    columns = ["key", "id", "c", *values]
    targets = known.select(*columns, "b", F.explode(F.sequence(F.lit(0), F.col("probe_parts") - 1)).alias("p"), F.lit(0).alias("probe"))
    probes = known.where("c <> top").withColumn("p", F.pmod(F.xxhash64("id"), F.col("probe_parts")).cast("int"))
    probes = probes.select(*columns, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("b"), "p", F.lit(1).alias("probe"))
    return targets.unionByName(probes).repartition(n, "key", "b", "p").sortWithinPartitions("key", "b", "p")


def _by_group(keys: tuple[str, ...], links_of):
    """A function of sorted batches that hands whole groups of equal ``keys`` to ``links_of(rows, cuts)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in chain(batches, (None,)):
            if batch is not None:
                rows = {c: _plain(batch.column(c)) for c in batch.schema.names}
                held = rows if held is None else {c: np.concatenate((held[c], rows[c])) for c in rows}
            if held is None or not len(held["id"]):
                continue
            change = np.zeros(len(held["id"]) - 1, bool)
            for c in keys:
                change |= held[c][1:] != held[c][:-1]
            cuts = np.concatenate(([0], np.flatnonzero(change) + 1, [len(held["id"])]))
            # the last group may go on in the next batch
            whole = cuts if batch is None else cuts[:-1]
            if len(whole) > 1:
                u, v = links_of(held, whole)
                if len(u):
                    yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])
                held = {c: x[whole[-1] :] for c, x in held.items()}

    return run


def _plain(column: pa.Array) -> np.ndarray:
    """The column as numbers; lists, which are of one length, as rows of numbers."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy().reshape(len(column), -1)
    return column.to_numpy()


def _block_links(near):
    """Links of each group: all in small groups, a spanning forest in larger ones."""

    def links(rows: dict[str, np.ndarray], cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = rows["id"], np.diff(cuts)
        end = np.repeat(np.where(sizes <= SMALL, cuts[1:], 0), sizes)
        place, us, vs = np.arange(len(end)), [], []
        for step in range(1, SMALL):
            i = np.flatnonzero(place + step < end)
            i = i[near(rows, i, i + step)]
            us.append(ids[i])
            vs.append(ids[i + step])
        for g in np.flatnonzero(sizes > SMALL).tolist():
            a = int(cuts[g])
            found = forest(int(sizes[g]), lambda i, others, a=a: near(rows, np.full(len(others), a + i), a + others))
            if found:
                i, j = np.array(found).T
                us.append(ids[a + i])
                vs.append(ids[a + j])
        return np.concatenate(us), np.concatenate(vs)

    return links


def _probe_links(near, every: bool = False):
    """Links from each probe of a group to rows of other components: ``every`` one, or one a component."""

    def links(rows: dict[str, np.ndarray], cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, components, probe, us, vs = rows["id"], rows["c"], rows["probe"] == 1, [ids_none()], [ids_none()]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            targets = a + np.flatnonzero(~probe[a:b])
            for i in (a + np.flatnonzero(probe[a:b])).tolist():
                hit = targets[components[targets] != components[i]]
                hit = hit[near(rows, np.full(len(hit), i), hit)]
                if not every:
                    hit = hit[np.unique(components[hit], return_index=True)[1]]
                us.append(np.full(len(hit), ids[i]))
                vs.append(ids[hit])
        return np.concatenate(us), np.concatenate(vs)

    return links


def ids_none() -> np.ndarray:
    return np.zeros(0, np.int64)


def _near_op10(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    fp = rows["fp"].view(np.uint64)
    return ring_close(fp[i] ^ fp[j], (rows["key"][i] >> 24) // 2)


def hamming_components(fps: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) from (doc_id, fp): fingerprints link at 3 or fewer differing bits.

    Equal fingerprints are one node; a component's id is the smallest doc_id in it. A row without
    doc_id takes part through its fingerprint where a row with that fingerprint has an id, and else
    keeps a null component_id.
    """
    fps = stage(fps, "fingerprints")
    # a table of its own, so that the last join can split a fingerprint that many rows have
    nodes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("id")).where("id IS NOT NULL"), "nodes")
    rows = nodes.select(F.explode(ring_keys()).alias("key"), "id", "fp")
    found = linked_components(rows, ["fp"], _near_op10)
    roots = nodes.join(found, nodes["id"] == found["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return fps.join(roots, "fp", "left").select("doc_id", "fp", "component_id")


#: Near-dedup stage: five-word shingles; parity bits in 64-bit lanes that prune candidates.
STAGE_WORDS, LANES = 5, 4
#: Lanes of the wider parities that prune pairs before their whole sets are joined.
WIDE = 64
#: Documents of the sample that shows which shingles are common, in how many of them one has to be,
#: and how many are sent to the executors at most.
COMMON_DOCS, COMMON_MIN, COMMON_MOST = 8192, 4, 1 << 17


def parity(shingles: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """Bits that tell whether an even or odd number of shingles falls to each; a shingle flips one."""
    odd = np.bincount((shingles % np.uint64(64 * lanes)).astype(np.int64), minlength=64 * lanes) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def prefix_keys(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles (sorted, unique) of which any set of similarity 0.8 or more shares one.

    Prefix filter: a set of n shares ceil(0.8 n) elements with such a set, so in an order that all
    sets keep the first n - ceil(0.8 n) + 1 of both meet. The order is by hash, with ``common``
    (sorted) shingles last; which those are changes the number of candidates, never a result.
    """
    n = len(shingles)
    if not n:
        return shingles
    late = np.isin(shingles, common, assume_unique=True) if len(common) else np.zeros(n, bool)
    return shingles[np.argsort(late, kind="stable")[: n - -(-4 * n // 5) + 1]]


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles that recur in a sample of the documents, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            for text in part.column("text").to_pylist():
                yield pa.record_batch([pa.array(np.unique(shingle_hashes(words_of(text), STAGE_WORDS)).view(np.int64))], names=["shingle"])

    share = max(1, -(-docs.count() // COMMON_DOCS))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select(F.col("text").cast("string").alias("text"))
    counts = map_arrow(sample, run, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON_MIN)
    rows = counts.orderBy(F.desc("n"), "shingle").limit(COMMON_MOST).collect()
    return np.sort(np.array([r["shingle"] for r in rows], np.int64).view(np.uint64))


def _near_stage(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Similarity 0.8 leaves a ninth of both sizes to differ, and parities differ in no more bits. The first
    shared shingle in the common order leaves no more to share than what comes from it on; so under a
    later one a pair may be passed over, under the first one it never is."""
    one, other = rows["size"][i], rows["size"][j]
    near = 9 * np.minimum(one - rows["place"][i], other - rows["place"][j]) >= 4 * (one + other)
    i, j = i[near], j[near]
    differ = sum(np.bitwise_count((rows[f"w{x}"][i] ^ rows[f"w{x}"][j]).view(np.uint64)).astype(np.int64) for x in range(LANES))
    near[near] = 9 * differ <= (one + other)[near]
    return near


def _near_wide(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``_near_stage``, and the same bound on the wide parities."""
    near = _near_stage(rows, i, j)
    i, j = i[near], j[near]
    differ = np.bitwise_count((rows["w"][i] ^ rows["w"][j]).view(np.uint64)).sum(axis=1, dtype=np.int64)
    near[near] = 9 * differ <= rows["size"][i] + rows["size"][j]
    return near


def _sets(ids: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, n, s, w): the shingle sets and wide parities of some nodes, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            sets = [np.unique(shingle_hashes(words_of(t), STAGE_WORDS)) for t in part.column("text").to_pylist()]
            wide = [parity(s, WIDE).view(np.int64) for s in sets]
            yield pa.record_batch([part.column("id"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64()))], names=["id", "s", "w"])

    # a text for each node; of repeated rows one
    wanted = nodes.join(ids, "id", "left_semi").select("id", "row_key")
    texts = docs.select("row_key", "text").join(wanted, "row_key").dropDuplicates(["row_key"])
    return stage(map_arrow(texts.select("id", "text"), run, "id long, s array<long>, w array<long>").select("id", F.size("s").alias("n"), "s", "w"), "sets", free=True)


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    return stage(pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs", free=True)


def _parities_agree(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose wide parities differ in no more bits than the similarity allows."""
    differ = F.aggregate(F.zip_with("wu", "wv", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, n: total + n)
    for name in ("u", "v"):
        pairs = pairs.join(sets.select(F.col("id").alias(name), F.col("n").alias(f"n{name}"), F.col("w").alias(f"w{name}")), name)
    return stage(pairs.where(9 * differ <= F.col("nu") + F.col("nv")).select("u", "v"), "near", free=True)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of node ids whose shingle sets have similarity 0.8 or more."""
    one, other = sets.select(F.col("id").alias("u"), F.col("s").alias("su")), sets.select(F.col("id").alias("v"), F.col("s").alias("sv"))
    shared = F.size(F.array_intersect("su", "sv"))
    return stage(pairs.join(one, "u").join(other, "v").where(9 * shared >= 4 * (F.size("su") + F.size("sv"))).select("u", "v"), "links", free=True)


def _links_of(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) that the wide parities and the shingle sets confirm."""
    sets = _sets(pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct(), docs, nodes)
    near = _parities_agree(pairs, sets)
    links = _confirmed(near, sets)
    for table in (pairs, sets, near):
        drop_stage(table)
    return links


def _fingerprint_components(heads: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component) of the pairs of ``heads`` (id, fp) whose fingerprints, found by their pigeonring keys, differ
    in 3 bits at most and whose shingle sets have similarity 0.8 or more.

    Blocks of large buckets are looked at by themselves; what they miss is left to the prefix filter.
    """
    n = partitions(heads.sparkSession)
    rows = heads.select(F.explode(ring_keys()).alias("key"), "id", "fp")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cut = rows.join(sizes, "key").withColumn("b", F.pmod(F.xxhash64("id", "key"), F.ceil(F.col("n") / F.lit(BLOCK))).cast("int"))
    dealt = cut.select("key", "b", "id", "fp").repartition(n, "key", "b").sortWithinPartitions("key", "b")
    links = _links_of(_distinct_pairs(map_arrow(dealt, _by_group(("key", "b"), _block_links(_near_op10)), "u long, v long")), docs, nodes)
    roots = stage(connected_components(links), "fingerprint-roots")
    drop_stage(links)
    return roots


def _stage_components(rows: DataFrame, values: list[str], docs: DataFrame, nodes: DataFrame, known: DataFrame) -> DataFrame:
    """(node, component) of the pairs of rows (key, id, n, parts, *values) of equal key with similarity 0.8 or more,
    beside the components that are ``known`` (node, component).

    All possible links of small buckets come first, and a spanning forest of those of each block of
    larger ones, so that a large group isn't confirmed pair by pair; pairs within a known component need
    no check. Then, in the larger ones, every possible pair between different components is confirmed;
    there the wide parities go with the rows.
    """
    n = partitions(rows.sparkSession)
    cut = rows.withColumn("b", F.pmod(F.xxhash64("id", "key"), F.col("parts")).cast("int"))
    dealt = cut.select("key", "b", "id", *values).repartition(n, "key", "b").sortWithinPartitions("key", "b")
    found = map_arrow(dealt, _by_group(("key", "b"), _block_links(_near_stage)), "u long, v long")
    for name in ("u", "v"):
        found = found.join(known.select(F.col("node").alias(name), F.col("component").alias(f"c{name}")), name, "left")
    first = _links_of(_distinct_pairs(found.where("cu IS NULL OR cv IS NULL OR cu <> cv").select("u", "v")), docs, nodes)
    roots = stage(connected_components(first.unionByName(known.select(F.col("node").alias("u"), F.col("component").alias("v")))), "roots")
    drop_stage(first)
    known = _open_rows(cut.where(F.col("n") > SMALL).drop("n"), roots)
    sets = _sets(known.select("id").distinct(), docs, nodes)
    both = _probes(known.join(sets.select("id", "w"), "id"), [*values, "w"], n)
    pairs = _distinct_pairs(map_arrow(both, _by_group(("key", "b", "p"), _probe_links(_near_wide, every=True)), "u long, v long"))
    more = _confirmed(pairs, sets)
    for table in (known, sets, pairs):
        drop_stage(table)
    return connected_components(more.unionByName(roots.select(F.col("node").alias("u"), F.col("component").alias("v"))))


def _row_key() -> Column:
    """Rows with equal doc_id and text, and only they, share a key (128 bits of MD5)."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("none")), F.lit(" "), F.coalesce(text, F.lit("")))))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_row_key().alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, heads): (row_key, doc_id, root) of each row of ``_keyed`` documents, and (root, head) of each
    group, where head has the smallest doc_id of the group (none comes last) and its row's key."""
    values = ["size", *(f"w{i}" for i in range(LANES))]
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            exact, fps, sizes, bits, keys = [], [], [], [], []
            for text in part.column("text").to_pylist():
                words = words_of(text)
                exact.append(xxhash.xxh128_digest(b" ".join(words), SEED))
                hashes = shingle_hashes(words, STAGE_WORDS)
                fps.append(majority(hashes))
                shingles = np.unique(hashes)
                sizes.append(len(shingles))
                bits.append(parity(shingles))
                keys.append(prefix_keys(shingles, common.value).view(np.int64))
            wide = np.array(bits, np.uint64).view(np.int64)
            yield pa.record_batch([part.column("row_key"), part.column("doc_id"), pa.array(exact, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), *(pa.array(wide[:, i]) for i in range(LANES))], names=["row_key", "doc_id", "exact", "fp", "keys", *values])

    schema = "row_key binary, doc_id long, exact binary, fp long, keys array<long>, " + ", ".join(f"{v} long" for v in values)
    prints = stage(map_arrow(docs, run, schema).withColumn("number", F.monotonically_increasing_id()), "prints")
    # a node for each word sequence, under a number of its own: texts of one doc_id stay apart
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key", "number"))
    nodes = prints.groupBy("exact").agg(first.alias("head")).select("exact", "head", F.col("head.row_key").alias("row_key"), F.col("head.number").alias("id"))
    nodes = stage(nodes, "nodes", free=True)
    heads = prints.withColumnRenamed("number", "id").join(nodes.select("id"), "id", "left_semi")
    ids = nodes.select("id", "row_key")
    known = _fingerprint_components(heads.select("id", "fp"), docs, ids)
    keys = heads.select(F.posexplode("keys").alias("place", "key"), "id")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = keys.join(sizes, "key").select("key", "id", F.col("place").cast("long").alias("place"), "n", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("parts"))
    rows = stage(met.join(heads.select("id", *values), "id"), "buckets", free=True)
    found = _stage_components(rows, ["place", *values], docs, ids, known)
    drop_stage(rows)
    roots = stage(nodes.join(found, nodes["id"] == found["node"], "left").select("exact", "head", F.coalesce("component", "id").alias("root")), "roots", free=True)
    members = prints.select("row_key", "doc_id", "exact").join(roots.select("exact", "root"), "exact").drop("exact")
    return members, roots.groupBy("root").agg(F.min("head").alias("head"))


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, group_id): documents whose five-word shingles have similarity 0.8 or more, in groups.

    Equal word sequences are one node. SimHash comes first: nodes whose fingerprints meet under a
    pigeonring key and differ in 3 bits at most are candidates. As at 0.8 fingerprints differ in more
    bits, the prefix filter has all other pairs of similarity 0.8 or more meet under a key; sizes and
    parity bits prune without loss. The exact similarity of the shingle sets confirms each link. Empty and null texts are one node. Groups are the components; group_id
    is the smallest doc_id, null where no row of the group has one. Rows of equal doc_id with
    different texts are documents of their own; each row has its group, so repeated rows repeat.
    Columns other than doc_id and text are ignored; an empty table has no groups.
    """
    rows, heads = _grouped(_keyed(docs))
    return rows.join(heads.select("root", F.col("head.doc_id").alias("group_id")), "root").select("doc_id", "group_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one document of each near-duplicate group: the one with the smallest doc_id.

    Shuffle files are given back after each table, which keeps the peak of disk low. Rows without doc_id take part and come last. Of rows with equal doc_id the texts decide: those
    that aren't near duplicates all stay. Of repeated rows (equal doc_id and text) one stays, which
    differ in other columns at most. Empty and null texts are equal; an empty table stays empty.
    """
    _, heads = _grouped(_keyed(docs))
    # all columns in one, so that no name of theirs can clash
    named = docs.select(_row_key().alias("row_key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("kept"))
    return named.join(heads.select(F.col("head.row_key").alias("row_key")), "row_key").dropDuplicates(["row_key"]).select("kept.*")
