"""Grouped prefix join on word n-grams, and its connected components.

A document's set holds the hashes of its distinct word n-grams.  Documents with equal
sets are one node.  Any two sets whose Jaccard similarity reaches the threshold share a
member of their prefixes under one global order, so:

1. Order: hashes are counted into a fixed number of cells over all documents; rare
   cells come first.  Any order is exact; this one keeps frequent passages out of the
   prefixes.
2. Group: nodes with the same prefix and size form one group; only groups are indexed.
3. Filter: groups that share a prefix hash are paired.  First, each is paired only with
   one hub of a hash, and members with their group's first; this is linear in the index.
   Pairs of groups that then already lie in one component need no link of their own to
   be found; every other pair is generated in a second pass, on such hashes as can be the
   first common one of two linked sets (enough of both sets must follow).
4. Expand and verify: pairs of groups become pairs of members; parity sketches rule out
   most that are too far apart, without error; the whole sets of the rest are intersected.

So a large cluster of near copies costs a star and not a square, and no link between
components is lost.  The result is the component of each document.

Links: the number of links of each document is counted on request.  Copies count by
their number.  A component of two nodes has one link between them; the nodes of larger
ones are dealt into blocks of bounded size, and each pair of blocks is intersected in one
bounded step that sends counts and no pairs.

Defined results: a text without words, or null, has an empty set and is linked with
nothing (its component is its own id); with fewer words than n, the whole sequence is
the one member; equal rows are linked; a component whose ids are all null is null; an
empty table gives an empty result; only id, text and key are read.  Members and sets are
told apart by 64- and 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, tidy
from .hashing import byte_words, mixed, sequence_hashes

#: Least and most cells (as powers of two) of the frequency count that orders the hashes, and
#: how many documents there are to a cell between them.
CELL_BITS = (14, 20)
DOCS_PER_CELL = 8
#: Least bits of a set's parity sketch; a sketch has from two to four bits a member.
SKETCH_BITS = 512
#: Least and most bits (as powers of two) of the filter that says which nodes' sets are wanted;
#: a set that passes without being wanted is dropped by the join that follows.
WANTED_BITS = (20, 27)
BITS_PER_NODE = 16
#: Groups that share a hash are paired by so many of one side at a time.
GROUPS_PER_TASK = 512
#: A block of a component's nodes holds about so many members of sets, and so many sets, at most.
BLOCK_MEMBERS = 1 << 18
BLOCK_SETS = 1024
#: Members of more sets of a block than this are counted by a matrix product, others pair by pair.
FEW_SETS = 16


def shingle_sets(texts: list[bytes | None], n: int) -> Iterator[np.ndarray]:
    """The sorted set of each text: A-Z lower-cased, words between ASCII white space."""
    for joined, each in byte_words(texts):
        runs, at = sequence_hashes(joined, n), 0
        for words in each:
            if len(words) >= n:
                found = np.sort(runs[at : at + len(words) - n + 1])
                yield found[np.append(True, found[1:] != found[:-1])]
            elif len(words):
                yield mixed(sequence_hashes(words, len(words)) + np.uint64(len(words)))
            else:
                yield words
            at += len(words)


def node_of(members: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(members.tobytes())


def parity_sketch(members: np.ndarray) -> np.ndarray:
    """Parity of the members that fall on each bit: two sketches differ in no more bits than
    the sets have members that are not common.  The halves of a sketch, joined by exclusive
    or, are the sketch of half as many bits."""
    bits = max(SKETCH_BITS, 1 << (2 * len(members)).bit_length())
    odd = np.bincount((members >> np.uint64(16) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _power(least_most: tuple[int, int], size: int) -> int:
    low, high = least_most
    return 1 << min(high, max(low, size.bit_length()))


def _count_cells(batches: Iterator[pa.RecordBatch], n: int, cells: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(cells, np.int64)
    for batch in batches:
        for members in shingle_sets(batch.column(0).to_pylist(), n):
            total += np.bincount((members & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["cell", "n"])


def _prefixes(batches: Iterator[pa.RecordBatch], n: int, percent: int, shared) -> Iterator[pa.RecordBatch]:
    order = shared.value
    for batch in batches:
        sizes, nodes, groups, prefixes, sketches = [], [], [], [], []
        for members in shingle_sets(batch.column(1).to_pylist(), n):
            size = len(members)
            length = size - -(-percent * size // 100) + 1 if size else 0
            rank = order[(members & np.uint64(len(order) - 1)).astype(np.int64)]
            first = members[np.argsort(rank, kind="stable")[:length]]
            sizes.append(size)
            nodes.append(node_of(members))
            groups.append(xxhash.xxh3_64_intdigest(first.tobytes(), seed=size) - (1 << 63))
            prefixes.append(first.view(np.int64))
            sketches.append(parity_sketch(members))
        arrays = [
            batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()),
            pa.array(groups, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64())),
            *batch.columns[2:],
        ]
        yield pa.RecordBatch.from_arrays(arrays, names=["id", "size", "node", "grp", "prefix", "sketch", *batch.schema.names[2:]])


def _wanted_sets(batches: Iterator[pa.RecordBatch], n: int, shared) -> Iterator[pa.RecordBatch]:
    wanted = shared.value
    size = 8 * len(wanted)
    for batch in batches:
        nodes, sets = [], []
        for members in shingle_sets(batch.column(0).to_pylist(), n):
            node = node_of(members)
            bit = int.from_bytes(node[:4], "big") % size
            if wanted[bit >> 3] >> (bit & 7) & 1:
                nodes.append(node)
                sets.append(members.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "members"])


def cell_order(texts: DataFrame, n: int) -> np.ndarray:
    """The rank of each cell by how many set members fall into it.

    There are as many cells as the table is long, within bounds; all members are counted.
    """
    cells = _power(CELL_BITS, texts.count() // DOCS_PER_CELL)
    counts = texts.mapInArrow(lambda b: tidy(_count_cells(b, n, cells)), "cell bigint, n bigint")
    found = counts.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(cells, np.int64)
    total[found["cell"].to_numpy()] = found["n"].to_numpy()
    order = np.empty(cells, np.uint32)
    order[np.argsort(total, kind="stable")] = np.arange(cells, dtype=np.uint32)
    return order


def sets_of(wanted: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """The sets of the nodes in column ``node`` (and of some others): node, members.

    A bitmap of bounded size, made from all wanted nodes, goes to the tasks that read the texts.
    """
    sc = texts.sparkSession.sparkContext
    size = _power(WANTED_BITS, wanted.count() * BITS_PER_NODE)
    bit = (F.conv(F.hex(F.substring("node", 1, 4)), 16, 10).cast("bigint") % size + 1).alias("bit")
    parts = wanted.select(bit).groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    bitmap = np.zeros(size // 8, np.uint8)
    for k, bits in parts.collect():
        at = (k - 1) * 4096  # bucket k holds the values from 32768 (k - 1) + 1 on
        bitmap[at : at + len(bits)] |= np.frombuffer(bits, np.uint8)
    shared = sc.broadcast(bitmap)
    sets = texts.mapInArrow(lambda b: tidy(_wanted_sets(b, n, shared)), "node binary, members array<bigint>")
    return sets.groupBy("node").agg(F.first("members").alias("members"))


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches do not rule the similarity out.

    At the threshold, the members not common to both sets are (100 - percent) of each
    (100 + percent) members of the two; sketches that differ in more bits exclude it.
    """
    pairs = pairs.join(nodes.select(F.col("node").alias("a"), F.col("size").alias("na"), F.col("sketch").alias("x")), "a")
    pairs = pairs.join(nodes.select(F.col("node").alias("b"), F.col("size").alias("nb"), F.col("sketch").alias("y")), "b")
    half = lambda v: F.zip_with(F.slice(v, F.lit(1), F.expr(f'size({v}) div 2')), F.slice(v, F.expr(f'size({v}) div 2 + 1'), F.expr(f'size({v}) div 2')), lambda a, b: a.bitwiseXOR(b))
    x = F.when(F.size("x") > F.size("y"), half("x")).otherwise(F.col("x"))  # sizes that fit are one doubling apart at most
    y = F.when(F.size("y") > F.size("x"), half("y")).otherwise(F.col("y"))
    pairs = pairs.select("a", "b", "na", "nb", x.alias("x"), y.alias("y"))
    apart = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, d: a + d)
    return pairs.where(apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)).select("a", "b")


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach the similarity, as a written table."""
    pairs = materialize(plausible(pairs, nodes, percent), "plausible")
    if pairs.isEmpty():
        return pairs
    sets = materialize(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), texts, n), "sets")
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    both = both.select("a", "b", common.alias("common"), (F.size("x") + F.size("y")).alias("total"))
    links = materialize(both.where(F.col("common") * 100 >= (F.col("total") - F.col("common")) * percent).select("a", "b"), "links")
    discard(pairs, sets)
    return links


def components(edges: DataFrame) -> DataFrame:
    """Component (its least node) of every node with an edge: node, comp.

    Labels spread along edges and jump to their label's label until none changes; each
    round ends in a written table, so a lost executor costs one round at most.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "edges")
    labels = written = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("near"))
        spread = labels.join(near, labels.node == near.a).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        spread = spread.join(up, "comp", "left")
        new = materialize(spread.select("node", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp")), "labels")
        discard(written)
        labels, written = new.select("node", "comp"), new
        if new.where("old != comp").isEmpty():
            discard(both)
            return labels


def block_links(sets: list[np.ndarray], copies: np.ndarray, left: np.ndarray, percent: int) -> np.ndarray:
    """Links of each set: with all others of one block (``left`` all true), or with the other side of two.

    Counts how many members each two sets share: members of few sets pair by pair, those
    of many by a matrix product over some of them at a time.
    """
    k, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(k), sizes)
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.zeros((k, k), np.float32)
    order = np.argsort(column, kind="stable")
    owner, held = owner[order], held[column[order]]
    met = []
    for count in range(2, FEW_SETS + 1):
        rows = owner[held == count].reshape(-1, count)
        met += [rows[:, a] * k + rows[:, b] for a in range(count if len(rows) else 0) for b in range(a)]
    if met:
        common += np.bincount(np.concatenate(met), minlength=k * k).reshape(k, k)
    many = held > FEW_SETS
    rows, starts = owner[many], np.flatnonzero(np.diff(column[order][many], prepend=-1))
    which = np.cumsum(np.diff(column[order][many], prepend=-1) != 0) - 1
    for low in range(0, len(starts), 4096):
        part = (which >= low) & (which < low + 4096)
        dense = np.zeros((k, min(4096, len(starts) - low)), np.float32)
        dense[rows[part], which[part] - low] = 1
        product = dense @ dense.T
        common += np.tril(product, -1)
    common += common.T
    total = (sizes[:, None] + sizes[None]) - common
    linked = common * 100 >= total * percent
    np.fill_diagonal(linked, False)
    if not left.all():
        linked &= left[:, None] != left[None]
    return (linked @ copies.astype(np.float64)).astype(np.int64)


def _count_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come in order of (comp, i, j); each such unit is taken by itself."""
    unit, rows = None, []

    def done() -> pa.RecordBatch:
        sets = [r[1] for r in rows]
        found = block_links(sets, np.array([r[2] for r in rows]), np.array([r[3] == unit[1] for r in rows]), percent)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array(found, pa.int64())], names=["node", "links"])

    for batch in batches:
        comp, i, j, block, node, copies = (batch.column(x).to_pylist() for x in ("comp", "i", "j", "block", "node", "copies"))
        members = batch.column("members")
        for r in range(batch.num_rows):
            if unit != (comp[r], i[r], j[r]):
                if rows:
                    yield done()
                unit, rows = (comp[r], i[r], j[r]), []
            rows.append((node[r], members[r].values.to_numpy(), copies[r], block[r]))
    if rows:
        yield done()


def link_counts(found: DataFrame, nodes: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Node and its links with other nodes, each counted by its copies, for nodes of components."""
    own = found.join(nodes.select("node", "size", "copies"), "node")
    if found.isEmpty():
        return own.select("node", F.col("copies").alias("links"))
    stats = own.groupBy("comp").agg(F.count("*").alias("nodes"), F.sum("size").alias("members"), F.sum("copies").alias("all"))
    own = materialize(own.join(stats, "comp"), "linked")
    two = own.where("nodes = 2").select("node", (F.col("all") - F.col("copies")).alias("links"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_MEMBERS), F.ceil(F.col("nodes") / BLOCK_SETS)).cast("int")
    more = own.where("nodes > 2").select("node", "comp", "copies", blocks.alias("blocks"))
    more = more.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = more.join(sets_of(more.select("node"), texts, n), "node")
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "members")
    units = met.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    counted = units.mapInArrow(lambda b: tidy(_count_links(b, percent)), "node binary, links bigint")
    links = materialize(two.union(counted).groupBy("node").agg(F.sum("links").alias("links")), "counted")
    discard(own)
    return links


def link_components(
    docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None, links: bool = False
) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the component's least id).

    With ``key_col`` (binary), also each row's key and the ``first_key`` of its component:
    that of its least id, nulls last, and of the least key among equal ids.  With
    ``links``, also ``n_links``, the number of other rows that the row is linked with.
    """
    sc = docs.sparkSession.sparkContext
    keys = [F.col(key_col).alias("key")] if key_col else []
    data = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"), *keys)
    texts = data.select("text")
    order = sc.broadcast(cell_order(texts, n))
    schema = "id bigint, size bigint, node binary, grp bigint, prefix array<bigint>, sketch array<bigint>" + (", key binary" if keys else "")
    rows = materialize(data.mapInArrow(lambda b: tidy(_prefixes(b, n, percent, order)), schema), "prefixes")

    nodes = rows.where("size > 0").groupBy("node").agg(
        F.min("grp").alias("grp"), F.min("size").alias("size"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")
    )
    nodes = materialize(nodes, "nodes")
    groups = nodes.groupBy("grp", "size").agg(F.min("node").alias("head"), F.count("*").alias("n"))
    groups = materialize(groups, "groups")

    # Index of groups by prefix hash, hashes of one group left out.
    shown = rows.where("size > 0").groupBy("grp", "size").agg(F.first("prefix").alias("prefix"))
    index = shown.select("grp", "size", F.posexplode("prefix").alias("pos", "hash"))
    ends = index.groupBy("hash").agg(F.min_by("grp", "pos").alias("hub"), F.count("*").alias("n")).where("n > 1").select("hash", "hub")
    index = materialize(index.join(ends, "hash"), "index")

    # First pass: a star in each group, and for each hash around the group in which it comes
    # earliest, which has the fewest rarer members of its own.
    hubs = index.where("grp != hub").select(F.least("grp", "hub").alias("g"), F.greatest("grp", "hub").alias("h")).distinct()
    one, two = _side(groups, "g", "a"), _side(groups, "h", "b")
    stars = hubs.join(one, "g").join(two, "h").where(_sizes_fit(percent)).select("a", "b")
    inner = nodes.join(groups.where("n > 1").select("grp", "size", "head"), ["grp", "size"]).where("node != head")
    pairs = materialize(stars.union(inner.select(F.col("head").alias("a"), F.col("node").alias("b"))), "pairs")
    edges = verified(pairs, nodes, texts, n, percent)
    found = nodes.select("node", F.col("node").alias("comp")).limit(0) if edges.isEmpty() else components(edges)

    # Second pass: every remaining pair of groups that is not within one component.
    placed = nodes.join(found, "node", "left").select("node", "grp", "size", F.coalesce("comp", "node").alias("comp"))
    placed = materialize(placed, "placed")
    more = _open_pairs(index, placed, percent)
    more = more.join(pairs, ["a", "b"], "left_anti").join(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    late = verified(more, nodes, texts, n, percent)
    discard(index, groups, pairs, placed)
    if not late.isEmpty():
        found = components(edges.union(late))
    discard(edges, late)

    held = ["key"] if keys else []
    counts = ["n_links"] if links else []
    placed = rows.select("id", "size", "node", *held).join(found, "node", "left")
    if links:
        linked = nodes.select("node", "copies").join(link_counts(found, nodes, texts, n, percent), "node", "left")
        linked = linked.select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        placed = placed.join(linked, "node", "left")
    placed = placed.select("id", "size", F.when(F.col("size") > 0, F.coalesce("comp", "node")).alias("comp"), *held, *counts)
    first = [F.min(F.struct(F.col("id").isNull(), "id", "key"))["key"].alias("first_key")] if keys else []
    least = placed.where("comp IS NOT NULL").groupBy("comp").agg(F.min("id").alias("least"), *first)
    return placed.join(least, "comp", "left").select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("comp").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"),
        *([F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")] if links else []),
        *([F.col("key").alias(key_col), "first_key"] if keys else []),
    )


def _open_pairs(index: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of different components whose groups meet on a possible first common hash.

    The groups of a frequent hash are dealt over several tasks, each with a bounded part of one side.
    """
    state = placed.groupBy("grp", "size").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    known = index.select("hash", "grp", "size", "pos").join(state, ["grp", "size"])
    open_ = known.groupBy("hash").agg(F.min("c0").alias("m0"), F.max("c1").alias("m1"), F.ceil(F.count("*") / GROUPS_PER_TASK).cast("int").alias("parts"))
    known = materialize(known.join(open_.where("m0 != m1").select("hash", "parts"), "hash"), "open")
    pure = F.col("c0") == F.col("c1")
    major = known.where(pure).groupBy("hash", "c0").count().groupBy("hash").agg(F.max_by("c0", "count").alias("major"))
    left = known.join(major, "hash", "left").where(~(pure & F.col("c0").eqNullSafe(F.col("major"))))
    cols = ("grp", "size", "pos", "c0", "c1")
    left = left.select("hash", F.pmod(F.xxhash64("grp"), F.col("parts")).cast("int").alias("part"), *[F.col(c).alias(f"l_{c}") for c in cols])
    right = known.select("hash", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[F.col(c).alias(f"r_{c}") for c in cols])
    same = (F.col("l_c0") == F.col("l_c1")) & (F.col("r_c0") == F.col("r_c1")) & (F.col("l_c0") == F.col("r_c0"))
    near = F.least("l_size", "r_size") * 100 >= F.greatest("l_size", "r_size") * percent
    # At the first common hash of two linked sets, enough of both is left.
    rest = F.least(F.col("l_size") - F.col("l_pos"), F.col("r_size") - F.col("r_pos"))
    enough = rest * (100 + percent) >= (F.col("l_size") + F.col("r_size")) * percent
    met = left.join(right, ["hash", "part"]).where((F.col("l_grp") != F.col("r_grp")) & near & enough & ~same)
    met = met.select(F.least("l_grp", "r_grp").alias("g"), F.greatest("l_grp", "r_grp").alias("h")).distinct()
    own = state.where("c0 != c1").select(F.col("grp").alias("g"), F.col("grp").alias("h"))
    x = placed.select(F.col("grp").alias("g"), F.col("node").alias("a"), F.col("comp").alias("ca"), F.col("size").alias("sa"))
    y = placed.select(F.col("grp").alias("h"), F.col("node").alias("b"), F.col("comp").alias("cb"), F.col("size").alias("sb"))
    more = met.union(own).join(x, "g").join(y, "h").where((F.col("ca") != F.col("cb")) & _sizes_fit(percent))
    return more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _side(groups: DataFrame, key: str, node: str) -> DataFrame:
    return groups.select(F.col("grp").alias(key), F.col("head").alias(node), F.col("size").alias(f"s{node}"))


def _sizes_fit(percent: int):
    return F.least("sa", "sb") * 100 >= F.greatest("sa", "sb") * percent
