"""Near-duplicate components with an LSH forest.

Each document's shingle set gets MinHash values; a tree orders documents by a label of several
values, and each of the forest's trees by others. Documents that share a label's head (its first
``head`` values) form a region; in it, a row's neighbours in the order are those with the longest
common prefix, so the depth at which rows meet adapts to how crowded their part of the region is.
The trees' orders are one range-partitioned sort, which no region, however large, can skew.
Neighbours whose labels agree enough are joined into clusters (connected components of linearly
many edges), and inside a cluster pairs are compared on full sets. So the forest only has to bring
the members of a link into one cluster: there is no cap on partners, and no candidate pair is
written out. A cluster of many documents is compared in blocks, and only where it can matter:
between sets of like size, and not inside what is linked already.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.llm.arrow import by_bytes, map_rows, slices, utf8
from docflow.operators.components import components
from docflow.llm.filters import maybe_in, without_ids
from docflow.llm.shingles import shingle_set, signatures
from docflow.operators.skew import join_groups
from docflow.plans.staging import staged

#: Deeper label levels after the head, one byte of a MinHash value each.
LEVELS = 16


@dataclass(frozen=True)
class ForestParams:
    """Links have 100 * intersection >= ``percent`` * union of sets of ``width``-word shingles.

    With similarity s, a tree brings a pair into one region with probability s ** head; at 0.8,
    four values and 32 trees, no tree does once in 20 million. A pair of a region is joined by the rows
    between them in the order, ``back`` neighbours each, where ``agree`` of the LEVELS deeper values
    are equal (under 5 of 16 happens to a pair at 0.8 with probability 3e-6 a tree).
    ``block`` documents or ``block_shingles`` shingles of a cluster are compared with as many
    others in one task, which bounds its memory.
    """

    width: int = 2
    percent: int = 80
    trees: int = 32
    head: int = 4
    agree: int = 5
    back: int = 2
    block: int = 256
    block_shingles: int = 400_000

    @property
    def values(self) -> int:
        return self.trees * self.head


def sketches(documents: DataFrame, params: ForestParams) -> DataFrame:
    """doc_id, n_shingles, cls (digest of the set; null if empty), heads, low (a byte per value)."""
    out = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.binary()), ("heads", pa.list_(pa.int64())), ("low", pa.binary())])
    p = params

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        rows: dict[str, list] = {name: [] for name in out.names}
        rows["doc_id"] = batch.column(0)
        texts = utf8(batch.column(1))
        for i, j in by_bytes(texts, lambda t: len(t or b""), 4 << 20):
            sets = [shingle_set(t, p.width) for t in texts[i:j]]
            held = [s for s in sets if len(s)]
            values = iter(signatures(held, p.values)) if held else iter(())
            for s in sets:
                rows["n_shingles"].append(len(s))
                if not len(s):
                    for name in ("cls", "heads", "low"):
                        rows[name].append(None)
                    continue
                own = next(values)
                rows["cls"].append(xxhash.xxh3_128_digest(s.tobytes()))
                parts = own.reshape(p.trees, p.head)
                rows["heads"].append([xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in parts])
                low = own.astype(np.uint8).tobytes()
                rows["low"].append((low * (1 + LEVELS // len(low)) + low)[: p.values + LEVELS + p.head])
        return rows

    narrow = documents.select(F.col("doc_id").cast("long"), "text")
    return map_rows(narrow, ["doc_id", "text"], "doc_id long, n_shingles long, cls binary, heads array<long>, low binary", work, out)


#: A row's key in the trees' orders: a byte for the tree, eight for the label's head, LEVELS below.
_KEY = 9 + LEVELS


def _agreement(left: Column, right: Column) -> Column:
    """How many of the LEVELS last bytes of two keys are equal."""
    same = [F.when(F.substring(left, k, 1) == F.substring(right, k, 1), 1).otherwise(0) for k in range(10, _KEY + 1)]
    return sum(same[1:], same[0])


def _neighbours(keys: np.ndarray, reps: np.ndarray, known: int, params: ForestParams) -> tuple[np.ndarray, np.ndarray]:
    """Pairs at most ``back`` apart in the order, of one region, with labels that agree enough.

    The first ``known`` rows are carried over from before: pairs among them are left out.
    """
    left, right = [], []
    for k in range(1, params.back + 1):
        i = max(k, known)
        same = keys[i:] == keys[i - k : max(0, len(keys) - k)]
        near = same[:, :9].all(1) & (same[:, 9:].sum(1) >= params.agree)
        left.append(reps[i:][near])
        right.append(reps[i - k : max(0, len(reps) - k)][near])
    return np.concatenate(left), np.concatenate(right)


def forest_edges(reps: DataFrame, params: ForestParams) -> DataFrame:
    """(a, b) edges between neighbours in the trees' orders; linearly many.

    One shuffle deals the rows by ranges of (key, rep), so that neither a crowded region nor many
    equal labels meet in one task. Neighbours inside a range come from one pass over it. The
    first and last ``back`` rows of the ranges are put in order once more, for neighbours across
    ranges; how rows are dealt takes no candidate away.
    """
    p = params
    rows = reps.select("rep", "low", F.posexplode("heads").alias("tree", "top"))
    key = F.concat(F.unhex(F.lpad(F.hex("tree"), 2, "0")), F.unhex(F.lpad(F.hex("top"), 16, "0")), F.expr(f"substring(low, {p.head} * tree + {p.head + 1}, {LEVELS})"))
    ordered = rows.select(key.alias("key"), "rep").repartitionByRange("key", "rep").sortWithinPartitions("key", "rep")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, reps, ends = np.empty((0, _KEY), dtype=np.uint8), np.empty(0, dtype=np.int64), []
        for batch in slices(batches):
            known = len(reps)
            keys = np.concatenate([keys, np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint8).reshape(-1, _KEY)])
            reps = np.concatenate([reps, batch.column(1).to_numpy()])
            a, b = _neighbours(keys, reps, known, p)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.binary())], schema=out)
            more = slice(known, known + max(0, p.back - len(ends)))
            ends += zip(reps[more].tolist(), map(bytes, keys[more]), strict=True)
            keys, reps = keys[-p.back :], reps[-p.back :]
        ends = sorted({*ends, *zip(reps.tolist(), map(bytes, keys), strict=True)})
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in ends], pa.int64()), pa.nulls(len(ends), pa.int64()), pa.array([k for _, k in ends], pa.binary())], schema=out)

    found = staged(ordered.mapInArrow(work, "a long, b long, key binary"), "edges")
    order = Window.partitionBy(F.substring("key", 1, 9)).orderBy("key", "a")
    ends = found.filter("key IS NOT NULL").select("key", "a")
    across = ends.withColumn("before", F.array(*[F.lag(F.struct("a", "key"), k).over(order) for k in range(1, p.back + 1)]))
    across = across.withColumn("other", F.explode("before")).filter(F.col("other").isNotNull() & (_agreement(F.col("key"), F.col("other.key")) >= p.agree))
    return found.filter("key IS NULL").select("a", "b").unionByName(across.select("a", F.col("other.a").alias("b")))


def _linked(ids: np.ndarray, sets: list[np.ndarray], first: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among sets, at least one end before ``first`` and one from it on; all if ``first`` is 0.

    Returns (node, root) with node > root, a forest of the components of these links.
    """
    n = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1
    shared_column = np.where(often, np.cumsum(often) - 1, -1)[column]
    kept = shared_column >= 0
    owner, shared_column = owner[kept], shared_column[kept]
    common = np.zeros((n, n), dtype=np.float64)
    width = 4096
    edges = np.searchsorted(shared_column, np.arange(0, (shared_column[-1] if len(shared_column) else -1) + width + 1, width))
    for k, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if i < j:
            part = np.zeros((n, int(shared_column[j - 1]) - k * width + 1), dtype=np.float32)
            part[owner[i:j], shared_column[i:j] - k * width] = 1
            common += part @ part.T
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    link = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    if first:
        link[:first, :first] = False
        link[first:, first:] = False
    link |= ids[:, None] == ids[None, :]
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    label = rank.copy()
    while True:
        least = np.where(link, label[None, :], n).min(1)
        if (least == label).all():
            break
        label = least
    by_rank = np.sort(ids)
    root = by_rank[label]
    moved = root < ids
    return ids[moved], root[moved]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Runs of rows with the same (cluster, i, j) in sorted batches; sets are views of the batches."""
    key, held = None, {}
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("cluster", "i", "j")), strict=True))
        reps, sides, sets = (batch.column(c) for c in ("rep", "side", "set"))
        for k, own in enumerate(keys):
            if own != key:
                if key is not None:
                    yield held
                key, held = own, {"rep": [], "side": [], "set": []}
            held["rep"].append(reps[k].as_py())
            held["side"].append(sides[k].as_py())
            held["set"].append(np.frombuffer(sets[k].as_buffer(), dtype=np.uint64))
    if key is not None:
        yield held


def _compared(documents: DataFrame, tasks: DataFrame, params: ForestParams) -> DataFrame:
    """Links of the tasks as forests (a, b), staged.

    ``tasks``: (rep, cluster, own, others): a document of a block, and the blocks of its cluster
    that it is compared with, itself perhaps. Each pair of blocks is one task, and a document's
    set is sent to as many as it has ``others``.
    """
    dealt = tasks.withColumn("other", F.explode("others"))
    dealt = dealt.select("rep", "cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    # Only texts that the tasks' bit set lets through are read into sets and shuffled.
    texts = maybe_in(documents.select(F.col("doc_id").cast("long"), "text"), tasks.select("rep"), "doc_id", "_maybe").filter("_maybe")
    out = pa.schema([("rep", pa.int64()), ("set", pa.binary())])

    def sets(batch: pa.RecordBatch) -> dict[str, list]:
        return {"rep": batch.column(0), "set": [shingle_set(t, params.width).tobytes() for t in utf8(batch.column(1))]}

    found = map_rows(texts, ["doc_id", "text"], "rep long, set binary", sets, out)
    parts = max(1, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = dealt.join(found, "rep").repartition(parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "side")
    linked = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(slices(batches)):
            own = group["set"]
            if len(own) > 1:
                first = group["side"].index(1) if 1 in group["side"] else 0
                a, b = _linked(np.array(group["rep"], dtype=np.int64), own, first, params.percent)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=linked)

    return staged(met.mapInArrow(compare, "a long, b long"), "links")


def _blocks(n: str, held: str, params: ForestParams) -> Column:
    """Blocks that so many documents with so many shingles are dealt into; none for none."""
    return F.greatest(F.ceil(F.col(n) / params.block), F.ceil(F.col(held) / params.block_shingles)).cast("int")


def large_cluster_links(documents: DataFrame, large: DataFrame, total: int, params: ForestParams) -> DataFrame:
    """Links (a, b) of clusters of many blocks; their components are those of all links.

    ``large``: (rep, cluster, n_shingles). Sets whose sizes differ by more than the similarity
    allows cannot be linked, so a cluster is dealt by bands of size, and only a band and the next
    are compared. First the members of each band meet in blocks by one hash, then by another, which
    is linear and unites all but a few of a group of near copies. Then every document that
    is not in its cluster's largest component so far meets all of its own band and the
    bands beside it; pairs inside the largest component change nothing and are left out.
    """
    p = params
    size = "band_n"
    members = large.withColumn("band", F.floor(F.log("n_shingles") / F.lit(float(np.log(101 / p.percent)))).cast("int"))
    bands = members.groupBy("cluster", "band").agg(F.count(F.lit(1)).alias(size), F.sum("n_shingles").alias("held"))
    group = F.struct("cluster", "band").alias("group")
    keyed = members.select("rep", "cluster", "band", "n_shingles", group)
    met = join_groups(keyed, bands.select(group, size, _blocks(size, "held", p).alias("blocks")), "group", size, total)
    salted = [(F.lit(2 * k).cast("long") + F.col("band")) * (1 << 32) + F.pmod(F.xxhash64("rep", F.lit(k)), F.col("blocks")) for k in (0, 1000)]
    twice = met.select("rep", "cluster", F.explode(F.array(*salted)).alias("own")).withColumn("others", F.array("own"))
    near = _compared(documents, twice, p)
    united = keyed.join(components(near).withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("root", "rep"))
    parts = united.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("cluster").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.sum("n").alias("n"))
    marked = join_groups(united, main, "cluster", "n", total).withColumn("minor", F.col("part") != F.col("main"))
    marked = staged(marked.select("rep", "cluster", "band", "n_shingles", "minor", "group"), "marked")
    counts = marked.groupBy("cluster", "band").agg(
        *[F.count(F.when(F.col("minor") == m, 1)).alias(f"n{int(m)}") for m in (False, True)], *[F.coalesce(F.sum(F.when(F.col("minor") == m, F.col("n_shingles"))), F.lit(0)).alias(f"h{int(m)}") for m in (False, True)]
    )
    blocks = counts.select("cluster", "band", (F.col("n0") + F.col("n1")).alias(size), *[_blocks(f"n{m}", f"h{m}", p).alias(f"b{m}") for m in (0, 1)])
    beside = blocks.select("cluster", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("at"), F.struct("band", "b0", "b1").alias("near"))
    beside = beside.groupBy("cluster", F.col("at").alias("band")).agg(F.collect_list("near").alias("near"))
    table = staged(blocks.join(beside, ["cluster", "band"]).select(group, size, "b0", "b1", "near"), "bands")
    # A block's number: its band, whether it is of the largest component, its place.
    place = lambda band, main, k: (band * 2 + main).cast("long") * (1 << 32) + k
    of = lambda count, main: lambda x: F.when(x[count] > 0, F.transform(F.sequence(F.lit(0), x[count] - 1), lambda k: place(x["band"], F.lit(main), k))).otherwise(F.array().cast("array<long>"))
    minor, major = F.flatten(F.transform("near", of("b1", 0))), F.flatten(F.transform("near", of("b0", 1)))
    own = place(F.col("band"), (~F.col("minor")).cast("int"), F.pmod(F.xxhash64("rep"), F.when(F.col("minor"), F.col("b1")).otherwise(F.col("b0"))))
    last = join_groups(marked, table, "group", size, total)
    last = last.select("rep", "cluster", own.alias("own"), F.when(F.col("minor"), F.concat(minor, major)).otherwise(minor).alias("others"))
    if last.filter(F.size("others") > 0).isEmpty():
        return near
    return near.unionByName(_compared(documents, last.filter(F.size("others") > 0), p))


def near_components(documents: DataFrame, params: ForestParams = ForestParams()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``documents`` (doc_id, text).

    component_id is the least doc_id that links reach; kept says that it is the row's own.
    Texts with equal sets are one class from the start, so copies, however many, cost one row
    each. Null texts and texts without words have no shingle, are linked with nothing and are
    kept. A row without doc_id is linked with nothing: its component_id is null and it is kept.
    Rows with the same doc_id count as one document; repeats of a kept one are all kept. Other
    columns are not read. An empty table gives an empty result. Sets hold 64-bit hashes of whole
    shingles: counts and links are exact but for collisions (one in 10**8 for texts of a million words).
    """
    table = staged(sketches(documents, params), "sketches")
    total = table.count()
    usable = table.filter(F.col("cls").isNotNull() & F.col("doc_id").isNotNull())
    classes = usable.groupBy("cls").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.max("n_shingles").alias("n_shingles"), F.min_by(F.struct("heads", "low"), "doc_id").alias("s")
    )
    reps = staged(classes.select("cls", "rep", "size", "n_shingles", "s.heads", "s.low"), "classes")
    clusters = components(forest_edges(reps, params)).join(reps.groupBy(F.col("rep").alias("node")).agg(F.max("n_shingles").alias("n_shingles")), "node")
    sizes = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("held"))
    sized = join_groups(clusters, sizes.withColumn("blocks", _blocks("n", "held", params)), "root", "n", max(1, total))
    sized = staged(sized.select(F.col("node").alias("rep"), F.col("root").alias("cluster"), "n_shingles", "blocks"), "clusters")
    small = sized.filter("blocks = 1").select("rep", "cluster", F.lit(0).cast("long").alias("own"), F.array(F.lit(0).cast("long")).alias("others"))
    links, large = _compared(documents, small, params), sized.filter("blocks > 1").select("rep", "cluster", "n_shingles")
    if large.isEmpty():
        # A cluster of one block is settled by its forest.
        roots = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    else:
        roots = components(links.unionByName(large_cluster_links(documents, large, max(1, total), params)))
    named = reps.join(roots, reps["rep"] == roots["node"], "left").select("cls", "size", F.coalesce("root", "rep").alias("component_id"))
    rows = table.select("doc_id", "n_shingles", "cls")
    classed = join_groups(rows.filter(F.col("cls").isNotNull() & F.col("doc_id").isNotNull()), named, "cls", "size", max(1, total))
    alone = rows.filter(F.col("cls").isNull() | F.col("doc_id").isNull()).withColumn("component_id", F.col("doc_id"))
    both = classed.select("doc_id", "n_shingles", "component_id").unionByName(alone.select("doc_id", "n_shingles", "component_id"))
    return both.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op7_lsh_forest(documents: DataFrame, params: ForestParams = ForestParams()) -> DataFrame:
    return near_components(documents, params)


def drop_near_copies(documents: DataFrame, params: ForestParams = ForestParams(width=5)) -> DataFrame:
    """Documents with one of each near-duplicate component left, the one of least doc_id.

    Links are those of five-word shingles at 0.8 or more, which is what near-duplicate stages take;
    `op7_lsh_forest` takes two-word shingles, as its contract says, and so links more.
    Rows without doc_id stay; repeats of a doc_id stay or go together; columns stay as they are.
    """
    found = staged(near_components(documents, params), "components")
    return without_ids(documents, found.filter(~F.col("kept")).select("doc_id").distinct())
