"""SimHash near-duplicates, linked by searching BK-trees.

A fingerprint's links lie within a Hamming radius. Fingerprints are dealt into shards, and each
shard has a BK-tree: children keyed by their integer distance to the parent, of which a search
follows only the edges that the radius allows. The corpus's fingerprints have no size bound, so the
trees are not broadcast: a shard's tree is built and searched in the task that owns the shard.
With `blocks` set, the bits are cut into radius + 2 blocks and there is a shard for each value of
each pair of blocks: two fingerprints within the radius agree on at least two blocks, so no link is
lost. Without, shards come from random bit samples, with a stated chance to miss a link.
A shard's task emits a spanning forest of its links, never all pairs.

Defined results: null or empty text has fingerprint zero; a row with null doc_id is fingerprinted
but takes no part in linking (component null); repeated rows share a component; columns other than
doc_id and text are not looked at.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, numbered, release_memory, slices, tidy
from .components import components

SEED = 42
#: Random fingerprints that a shard should hold, where its keys are sampled bits.
SHARD = 16
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


@dataclass(frozen=True)
class Plan:
    """What a SimHash run takes: shingle length, fingerprint bits, radius, and how it shards.

    Without blocks, a shard's key is a sample of the bits, as many as make shards of about SHARD
    random fingerprints, and there are as many tables as find a pair that differs in `share` of its
    bits with probability `recall`, whatever the input's size. With a similarity, the groups that
    the links make are split again: members stay together where the exact Jaccard similarity of
    their shingles reaches it, directly or through other members.
    """

    words: int = 4
    bits: int = 64
    radius: int = 4
    distinct: bool = False
    blocks: bool = True
    share: float = 0.1515
    recall: float = 0.98
    similarity: float = 0.0

    def masks(self, fingerprints: int = 0) -> np.ndarray:
        """A row of 64-bit masks for each shard table, for so many fingerprints."""
        if self.blocks:
            n = self.radius + 2
            cut = [self.bits * i // n for i in range(n + 1)]
            chosen = [[*range(cut[a], cut[a + 1]), *range(cut[b], cut[b + 1])] for a, b in itertools.combinations(range(n), 2)]
        else:
            rng = np.random.default_rng(SEED)
            size = min(28, max(10, math.ceil(math.log2(max(1, fingerprints) / SHARD))))
            tables = math.ceil(math.log(1 - self.recall) / math.log(1 - (1 - self.share) ** size))
            chosen = [rng.choice(self.bits, size, replace=False).tolist() for _ in range(tables)]
        out = np.zeros((len(chosen), self.bits // 64), dtype=np.uint64)
        for row, bits in zip(out, chosen, strict=True):
            for b in bits:
                row[b // 64] |= np.uint64(1 << b % 64)
        return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of each run of `words` words, repeats included; of all words if there are fewer."""
    found = text.lower().split() if text else []  # on bytes, both are ASCII only
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined, of = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([of(joined, SEED)], dtype=np.uint64)
    after = list(itertools.accumulate(map(len, found), lambda a, n: a + n + 1, initial=0))
    return np.array([of(joined[a : b - 1], SEED) for a, b in zip(after, after[words:], strict=False)], dtype=np.uint64)


def fingerprint(h: np.ndarray, plan: Plan) -> bytes:
    """The 64-bit words, little-endian, of the fingerprint of a text's shingle hashes."""
    if not len(h):
        return bytes(plan.bits // 8)
    if plan.distinct:
        h = np.unique(h)
    out = b""
    for k in range(plan.bits // 64):
        own = h if not k else _mix(h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        columns = own.view(np.uint8).reshape(-1, 8)
        if len(own) < 64:
            count = _BITS[columns].sum(0)
        else:
            count = np.stack([np.bincount(columns[:, j], minlength=256) for j in range(8)]) @ _BITS
        out += np.packbits(2 * count > len(own), axis=None, bitorder="little").tobytes()
    return out


#: What one block of a large group holds at most, about: members, and bytes of shingle hashes.
BLOCK_ROWS, BLOCK_BYTES = 512, 4 << 20


def shingle_set(h: np.ndarray) -> bytes:
    """The distinct hashes in order, little-endian."""
    return np.unique(h).astype("<u8").tobytes()


def similar_pairs(sets: list[bytes], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs whose exact Jaccard similarity is at least that."""
    sizes = np.array([len(x) // 8 for x in sets], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    words, ids = np.unique(np.frombuffer(b"".join(sets), dtype="<u8"), return_inverse=True)
    mark, below = np.zeros(len(words), dtype=bool), np.zeros(len(ids) + 1, dtype=np.int64)
    a, b, left = [], [], np.arange(len(sets))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            own = ids[starts[at] : ends[at]]
            mark[own] = True
            np.cumsum(mark[ids], out=below[1:])
            mark[own] = False
            both = below[ends[left]] - below[starts[left]]
            hit = both + 1e-9 >= similarity * (sizes[at] + sizes[left] - both)
            a.append(np.full(hit.sum(), at))
            b.append(left[hit])
            queue += left[hit].tolist()
            left = left[~hit]
    return tuple(np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (a, b))


def fingerprints(docs: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, row, fp binary, digest binary) for every row, with the digest of its shingle set.

    row: that of docs, null if it has none; the digest is null if the plan needs none.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("fp", pa.binary()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                hashes = [shingle_hashes(t, plan.words) for t in batch.column("text").to_pylist()]
                digests = [xxhash.xxh3_128_digest(shingle_set(h), SEED) if plan.similarity else None for h in hashes]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array([fingerprint(h, plan) for h in hashes], pa.binary()), pa.array(digests, pa.binary())], schema=schema)

    row = F.col("row") if "row" in docs.columns else F.lit(None).alias("row")
    return docs.select(F.col("doc_id").cast("long"), row.cast("long").alias("row"), F.col("text").cast("binary").alias("text")).mapInArrow(tidy(run), "doc_id long, row long, fp binary, digest binary")


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union by smallest label; labels stay fully compressed."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label[:] = up


class BKForest:
    """BK-trees of many shards at once, and the links found so far as smallest labels.

    key: an item's shard. Building compares every item with its ancestors, which already gives
    links; a search then leaves out subtrees that are linked to the item as a whole. So a large
    group of near copies costs little more than its tree.
    """

    def __init__(self, key: np.ndarray, fp: np.ndarray, radius: int):
        n = len(key)
        self.fp, self.radius, self.span, self.label = fp, radius, fp.shape[1] * 64 + 1, np.arange(n)
        order = np.argsort(key, kind="stable")
        first = np.r_[True, key[order][1:] != key[order][:-1]] if n else np.zeros(0, dtype=bool)
        sizes = np.diff(np.r_[np.flatnonzero(first), n])
        self.root, self.size = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        self.root[order] = np.repeat(order[first], sizes)
        self.size[order] = np.repeat(sizes, sizes)
        codes, children, parents = [], [], []
        active = np.flatnonzero(self.root != np.arange(n))
        at = self.root[active]
        while len(active):  # a level of all trees at a time
            d = self._distance(active, at)
            _unite(self.label, active[d <= radius], at[d <= radius])
            new, where, back = np.unique(at * self.span + d, return_index=True, return_inverse=True)
            codes.append(new)
            children.append(active[where])
            parents.append(at[where])
            down = active[where][back]
            keep = down != active
            active, at = active[keep], down[keep]
        self.whole = np.ones(n, dtype=bool)  # does the subtree have one label?
        for child, parent in zip(children[::-1], parents[::-1], strict=True):
            odd = ~self.whole[child] | (self.label[child] != self.label[parent])
            self.whole[parent[odd]] = False
        self.code = np.concatenate([np.zeros(0, dtype=np.int64), *codes])
        self.child = np.concatenate([np.zeros(0, dtype=np.int64), *children])
        order = np.argsort(self.code)
        self.code, self.child = self.code[order], self.child[order]

    def _distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), dtype=np.int64)
        for w in range(self.fp.shape[1]):
            out += np.bitwise_count(self.fp[a, w] ^ self.fp[b, w])
        return out

    def search(self, items: np.ndarray) -> None:
        """Link the items to all others of their shard within the radius."""
        q, node = items, self.root[items]
        while len(q):
            todo = ~(self.whole[node] & (self.label[q] == self.label[node]))
            q, node = q[todo], node[todo]
            d = self._distance(q, node)
            hit = (d <= self.radius) & (q != node)
            _unite(self.label, q[hit], node[hit])
            low = np.searchsorted(self.code, node * self.span + np.maximum(d - self.radius, 0))
            n = np.searchsorted(self.code, node * self.span + np.minimum(d + self.radius, self.span - 1), side="right") - low
            start = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n)
            q, node = np.repeat(q, n), self.child[start + np.arange(len(start))]


def forest_links(key: np.ndarray, fp: np.ndarray, radius: int, block: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside shards: item and the smallest item it reaches."""
    tree = BKForest(key, fp, radius)
    items = np.flatnonzero(~tree.whole[tree.root])  # of other shards, all is linked already
    part = np.cumsum(tree.size[items]) // block
    for own in np.split(items, np.flatnonzero(np.diff(part)) + 1) if len(items) else []:
        tree.search(own)
    moved = np.flatnonzero(tree.label != np.arange(len(key)))
    return moved, tree.label[moved]


#: Bytes of packed shard entries that one task's group should hold.
BUCKET_BYTES = 12 << 20


def links(reps: DataFrame, plan: Plan, n: int) -> DataFrame:
    """Links (a, b) between representatives (fp, rep) of distinct fingerprints; n: their count."""
    masks, words = plan.masks(n), plan.bits // 64
    entry = np.dtype([("key", "<u8"), ("rep", "<i8"), ("fp", "<u8", (words,))])
    buckets = max(reps.sparkSession.sparkContext.defaultParallelism, n * len(masks) * entry.itemsize // BUCKET_BYTES + 1)
    packed = pa.schema([("bucket", pa.int32()), ("entries", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 50_000):
                batch = whole.slice(a, 50_000)
                fp = np.frombuffer(b"".join(batch.column("fp").to_pylist()), dtype="<u8").reshape(-1, words)
                rep = batch.column("rep").to_numpy(zero_copy_only=False)
                out = np.empty((len(masks), len(fp)), dtype=entry)
                for t, mask in enumerate(masks):
                    key = np.full(len(fp), t + 1, dtype=np.uint64)
                    for w in range(words):
                        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + (fp[:, w] & mask[w]))
                    out[t]["key"], out[t]["rep"], out[t]["fp"] = key, rep, fp
                out = out.ravel()
                bucket = (out["key"] >> np.uint64(33)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                ids, first = np.unique(bucket[order], return_index=True)
                cut = np.split(out[order], first[1:])
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array([x.tobytes() for x in cut], pa.binary())], schema=packed)

    def search(table: pa.Table) -> pa.Table:
        e = np.frombuffer(b"".join(table.column("entries").to_pylist()), dtype=entry)
        a, b = forest_links(e["key"], np.ascontiguousarray(e["fp"]), plan.radius)
        pairs = np.unique(np.stack([e["rep"][a], e["rep"][b]], axis=1), axis=0) if len(a) else np.zeros((0, 2), dtype=np.int64)
        del e, a, b
        release_memory()
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return reps.mapInArrow(tidy(deal), "bucket int, entries binary").groupBy("bucket").applyInArrow(search, "a long, b long")


def shingle_sets(docs: DataFrame, members: DataFrame, plan: Plan) -> DataFrame:
    """(group, node, shingles) of members(group, node), whose texts are those of docs(node, text)."""
    schema = pa.schema([("group", pa.int64()), ("node", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = [shingle_set(shingle_hashes(t, plan.words)) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("node"), pa.array(sets, pa.binary())], schema=schema)

    texts = docs.select("node", F.col("text").cast("binary").alias("text"))
    return texts.join(members, "node").select("group", "node", "text").mapInArrow(tidy(run), "group long, node long, shingles binary")


def similar_links(sets: DataFrame, plan: Plan) -> DataFrame:
    """Links (a, b) of sets(group, node, shingles): forests of the pairs in a group that are similar.

    A group of one block meets in one task. The members of a larger one are first compared to its
    smallest node, which links most of a group of near copies; each block of the others then meets
    each block of the group, two blocks in a task, so every pair that could still join two parts is
    compared. The broadcasts are of a row for each group of more than a block.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("lead_set").to_pylist(), batch.column("shingles").to_pylist(), strict=True)
            close = [len(similar_pairs(list(pair), plan.similarity)[0]) > 0 for pair in pairs]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("group", "node", "shingles", "lead")), pa.array(close, pa.bool_())], names=["group", "node", "shingles", "lead", "near"])

    def blocks(n: Column, size: Column) -> Column:
        return F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(size / BLOCK_BYTES))

    weight = F.length("shingles")
    sizes = sets.groupBy("group").agg(F.count("*").alias("n"), F.sum(weight).alias("size"))
    large = materialise(sizes.where(blocks(F.col("n"), F.col("size")) > 1).select("group"), "simhash-large")
    inside = sets.join(F.broadcast(large), "group")
    lead = inside.groupBy("group").agg(F.min("node").alias("lead"), F.min_by("shingles", "node").alias("lead_set"))
    told = materialise(inside.join(F.broadcast(lead), "group").mapInArrow(tidy(near), "group long, node long, shingles binary, lead long, near boolean"), "simhash-near")
    parts = told.groupBy("group").agg(blocks(F.count_if("near"), F.coalesce(F.sum(F.when(F.col("near"), weight)), F.lit(0))).alias("of_near"), blocks(F.count_if(~F.col("near")), F.coalesce(F.sum(F.when(~F.col("near"), weight)), F.lit(0))).alias("of_rest"))
    own = F.when(F.col("near"), F.pmod(F.xxhash64("node"), F.greatest("of_near", F.lit(1)))).otherwise(F.col("of_near") + F.pmod(F.xxhash64("node"), F.greatest("of_rest", F.lit(1)))).alias("own")
    placed = told.join(F.broadcast(parts.where("of_rest > 0")), "group").select("*", own)
    first = F.when(F.col("near"), F.col("of_near")).otherwise(F.lit(0))
    met = placed.withColumn("other", F.explode(F.sequence(first, F.col("of_near") + F.col("of_rest") - 1)))
    of_large = met.select("group", F.greatest("own", "other").alias("x"), F.least("own", "other").alias("y"), "node", "shingles")
    of_small = sets.join(F.broadcast(large), "group", "left_anti").select("group", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "node", "shingles")
    every = of_small.unionByName(of_large)
    total = every.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    buckets = total // BUCKET_BYTES + 8 * sets.sparkSession.sparkContext.defaultParallelism
    dealt = every.select(F.pmod(F.xxhash64("group", "x", "y"), F.lit(buckets)).alias("bucket"), "*")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("group", "x", "y", "node")])
        node = table.column("node").to_numpy()
        key = np.stack([table.column(c).to_numpy() for c in ("group", "x", "y")])
        cuts = [0, *(np.flatnonzero((np.diff(key) != 0).any(0)) + 1).tolist(), len(node)]
        out = [np.zeros((2, 0), dtype=np.int64)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            out.append(node[np.stack(similar_pairs(table.column("shingles").slice(a, b - a).to_pylist(), plan.similarity)) + a])
        pairs = np.concatenate(out, axis=1)
        del table, out
        release_memory()
        return pa.table({"a": pairs[0], "b": pairs[1]})

    stars = told.where("near and node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    return dealt.groupBy("bucket").applyInArrow(compare, "a long, b long").unionByName(stars)


def link_documents(docs: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the smallest doc_id that the fingerprints' links reach.

    Nodes are the distinct fingerprints, numbered, so rows of one doc_id with different texts are
    linked only where their fingerprints are.
    """
    fps = materialise(fingerprints(docs, plan).select("doc_id", "fp"), "simhash")
    reps = numbered(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")), "rep", "simhash-reps")
    roots = components(links(reps.select("fp", "rep"), plan, reps.count()))
    linked = materialise(reps.join(roots, reps["rep"] == roots["node"]).select("fp", "root", "least"), "simhash-linked")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = linked.join(smallest, "root").select("fp", "component_id")
    alone = reps.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    return fps.join(of_fp.unionByName(alone), "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def near_duplicate_groups(rows: DataFrame, plan: Plan) -> DataFrame:
    """(component, best, fp, digest): the component of each distinct shingle set, and the row that stays of those with it.

    rows: (doc_id, __row, text), numbered. Rows of equal shingle sets are one node. The fingerprints'
    links make groups of nodes; in a group, nodes of exact similarity belong together, directly or
    through others.
    """
    fps = materialise(fingerprints(rows.select("doc_id", F.col("__row").alias("row"), "text"), plan), "simhash")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    nodes = materialise(fps.groupBy("fp", "digest").agg(best).withColumn("node", F.col("best.row")), "simhash-nodes")
    reps = materialise(nodes.groupBy("fp").agg(F.min("node").alias("rep"), F.count("*").alias("n")), "simhash-reps")
    roots = components(links(reps.select("fp", "rep"), plan, reps.count()))
    grouped = reps.join(roots, reps["rep"] == roots["node"], "left").where("root is not null or n > 1").select("fp", F.coalesce("root", "rep").alias("group"))
    members = nodes.join(grouped, "fp").select("group", "node")
    sets = materialise(shingle_sets(rows.withColumnRenamed("__row", "node"), members, plan), "simhash-sets")
    similar = components(similar_links(sets, plan))
    return nodes.join(similar, "node", "left").select(F.coalesce("root", "node").alias("component"), "best", "fp", "digest")


def drop_near_duplicates(docs: DataFrame, plan: Plan) -> DataFrame:
    """Keep one row of each component, that of the smallest doc_id (a row without one comes last).

    Rows are told apart by a number of their own, not by doc_id: of rows with equal texts one stays,
    whatever their doc_ids, and rows of one doc_id with different texts all stay. Null, empty and
    wordless texts have equal (empty) shingle sets, so one of them stays. All other columns are kept,
    whatever their names. Texts of any length are read whole.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")
    rows = numbered(docs.select(whole), "__row", "simhash-rows")
    kept = near_duplicate_groups(rows.select("d.doc_id", "__row", "d.text"), plan).groupBy("component").agg(F.min("best").alias("best"))
    stay = rows.join(kept.select(F.col("best.row").alias("__row")), "__row", "left_semi")
    return stay.select(*[F.col(f"d.`{c}`").alias(c) for c in docs.columns])


#: The contract's fingerprints.
CONTRACT = Plan()
#: For filtering near copies: five-word shingles, Jaccard similarity 0.8. Two sets of equal size with
#: that similarity have a cosine of 0.889 and so differ in 15 % of the bits, 39 of 256 with deviation
#: 5.7; at 0.7 they differ in 49, unrelated ones in 128.
NEAR_COPIES = Plan(words=5, bits=256, radius=54, distinct=True, blocks=False, recall=0.99, similarity=0.8)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: doc_id, fingerprint (hex), component_id of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    linked = link_documents(docs, CONTRACT)
    return linked.select("doc_id", F.expr("lower(array_join(reverse(regexp_extract_all(hex(fp), '..', 0)), ''))").alias("fingerprint"), "component_id")
