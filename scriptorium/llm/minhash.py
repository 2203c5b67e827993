"""Near-duplicates by b-bit MinHash.

One pass over the texts gives, for each, its number of distinct word shingles,
a key of the whole shingle set, a signature that keeps the low ``BITS`` bits of
each minimum, packed, and a key for each band of full minima. Texts with equal
sets form a class, and only one member of each goes on. Classes that share a
band key are candidates. Candidates are sifted by their packed signatures
(equal bit groups are counted, and the count is corrected for chance
collisions) and confirmed on the full sets of their texts.

Only connectivity matters, so a bucket's members aren't all compared with each
other. First each class is compared with one of the centres of its buckets, the one
that its signature is closest to; then, in buckets with several components, each
member outside the largest with the closest of the centres that these largest ones
have there. So large groups are whole, or nearly, before pairs are looked at.
Then the buckets whose members still belong to several components are laid out
in tiles: members of all components but the bucket's largest along one side, all
members along the other. A tile first compares packed signatures, and a pair
counts in the first bucket that it shares only; what comes out are the members
that have a close one of another component in the tile. To these tiles the
texts of such members go, and their full sets are compared. So no candidate pair
between two components is left out, a task's rows and bytes are bounded by the
tile, and pairs never leave it, but only links that join two components, and
a task gives none between what it has joined before.

At the similarity of the threshold, 0.8, a pair escapes all bands with a
probability of (1 - 0.8 ** ROWS) ** BANDS, about 5e-6; the sieve lets pass what
is up to five standard deviations below the threshold.

Defined cases: null texts and texts without words have an empty set and are
linked with nothing; texts with fewer words than a shingle have their whole
sequence as the one element; equal rows are one class; rows that repeat an id
count as rows, each in its text's class; a null id is never the smallest, and a
row without an id is never marked as kept; an empty table gives an empty
result; other columns are ignored by ``link`` and kept by ``keep``. ``keep`` leaves
one of the rows that are marked as kept with the same id and text, and all rows
without an id. Ids are never joined by: rows get numbers of their own and are written
with them first, as numbers given anew could differ.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm._common import arrow_batches, join_spread, materialise, ship
from scriptorium.llm._kernels import mix, shingle_sets
from scriptorium.llm.components import components

ROWS, BANDS, BITS = 6, 40, 2
SIZE = ROWS * BANDS
#: Members along one side of a tile: from the least to the most, and texts' bytes, about.
TILE_LEAST, TILE_MOST, TILE_BYTES = 128, 2000, 8 << 20
#: Joined roots that a task keeps; beyond it starts anew, and may give a link again.
FOREST = 1 << 20


def _family() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * SIZE + 1, dtype=np.uint64))
    return (seeds[:SIZE] & np.uint64(0xFFFFFFFF)).astype(np.uint32), (seeds[SIZE:] & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)


_XOR, _ODD = _family()


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least of each of SIZE hashes over a set."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(SIZE, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(out, ((low[at : at + 512, None] ^ _XOR) * _ODD).min(axis=0), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of minima."""
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key * np.uint64(7) + rows[:, j])
    return key.view(np.int64)


def signature(least: np.ndarray) -> bytes:
    """The low bits of the minima, packed."""
    low = (least & np.uint32((1 << BITS) - 1)).astype(np.uint8)
    bits = (low[:, None] >> np.arange(BITS, dtype=np.uint8)) & 1
    return np.packbits(bits.astype(bool).ravel()).tobytes()


#: Unequal groups of BITS bits in a byte of two signatures' difference.
_UNEQUAL = np.array([sum(bool(x >> at & (1 << BITS) - 1) for at in range(0, 8, BITS)) for x in range(256)], dtype=np.uint8)


def _estimate(difference: np.ndarray) -> np.ndarray:
    """Similarities from rows of differing bits, corrected for chance collisions of b-bit groups."""
    agree = 1 - _UNEQUAL[difference].sum(axis=1, dtype=np.int64) / SIZE
    chance = 1 / (1 << BITS)
    return (agree - chance) / (1 - chance)


def similarity(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Estimated similarities of pairs of packed signatures."""
    x, y = (np.frombuffer(b"".join(s), dtype=np.uint8).reshape(len(s), -1) for s in (a, b))
    return _estimate(x ^ y)


def sieve_threshold(threshold: float) -> float:
    """Five standard deviations of the estimate below the threshold."""
    chance = 1 / (1 << BITS)
    agree = chance + threshold * (1 - chance)
    return threshold - 5 * float(np.sqrt(agree * (1 - agree) / SIZE)) / (1 - chance)


def _set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with row, a number; kept in a table."""
    return materialise(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """row, doc_id, at (hash of the text), bytes (of the text), n (size of the set), cls (key of the set), sig, bands, marks (short forms of the band keys, packed) of every row."""
    ship(docs.sparkSession)
    arrow_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            n, cls, sig, bands, marks = [], [], [], [], []
            for s in shingle_sets(b["text"].to_pylist(), width):
                n.append(len(s))
                if len(s):
                    least = minima(s)
                    keys = band_keys(least)
                    cls.append(_set_key(s))
                    sig.append(signature(least))
                    bands.append(keys)
                    marks.append(keys.astype(np.uint32).tobytes())
                else:
                    for x in (cls, sig, bands, marks):
                        x.append(None)
            made = [pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays([b["row"], b["doc_id"], b["at"], b["bytes"], *made], ["row", "doc_id", "at", "bytes", "n", "cls", "sig", "bands", "marks"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("row", "doc_id", F.xxhash64("text").alias("at"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), "text")
    return rows.mapInArrow(run, f"row long, doc_id {kind}, at long, bytes long, n long, cls binary, sig binary, bands array<long>, marks binary")


def _texts(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, text of the classes named by nodes (node, row, cls)."""

    def run(batches):
        for b in batches:
            same = [len(s) and _set_key(s) == c for s, c in zip(shingle_sets(b["text"].to_pylist(), width), b["cls"].to_pylist(), strict=True)]
            yield b.select(["node", "text"]).filter(pa.array(same, pa.bool_()))

    found = docs.select("row", "text").join(nodes, "row")
    return found.select("node", "cls", "text").mapInArrow(run, "node long, text string")


def _nearest(pairs: DataFrame, sigs: DataFrame, least: float, safe: float) -> DataFrame:
    """Of pairs (u, v) whose estimated similarity isn't too low, the one of each v with the most; from ``safe`` on, all count alike, and the smaller u is taken, so that chains stay short."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                near = similarity(b["su"].to_pylist(), b["sv"].to_pylist())
                yield pa.RecordBatch.from_arrays([b["u"], b["v"], pa.array(near)], ["u", "v", "near"]).filter(pa.array(near >= least))

    both = pairs.join(sigs.select(F.col("node").alias("u"), F.col("sig").alias("su")), "u").join(sigs.select(F.col("node").alias("v"), F.col("sig").alias("sv")), "v")
    found = both.select("u", "v", "su", "sv").mapInArrow(run, "u long, v long, near double")
    return found.groupBy("v").agg(F.min_by("u", F.struct(-F.least("near", F.lit(safe)), "u")).alias("u")).select("u", "v")


def _confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of pairs (u, v) whose full sets meet the threshold. The pairs of a
    frequent u are dealt out over parts, to each of which u's text goes once."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(shingle_sets(b["tu"].to_pylist(), width), shingle_sets(b["tv"].to_pylist(), width), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    dealt = pairs.join(pairs.groupBy("u").count(), "u").withColumn("salt", F.pmod(F.xxhash64("v"), F.ceil(F.col("count") / 500)))
    asked = dealt.select("u", "salt").distinct()
    left = asked.join(texts.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u")
    right = dealt.select("u", "v", "salt").join(texts.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v")
    return right.join(left, ["u", "salt"]).select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long")


def _mixed(members: DataFrame, placed: DataFrame) -> DataFrame:
    """key, band, node, root, top, centre of members (key, band, node) of buckets with several roots: the root that most members have, and one of these members.

    placed has (node, root). The centre is drawn by another order than that of the numbers, in which the first centres came."""
    held = materialise(members.join(placed, "node"), "rooted")
    own = held.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.min_by("node", F.xxhash64("node")).alias("centre"))
    whole = own.groupBy("key").agg(F.sum("n").alias("size"), F.max_by(F.struct("root", "centre"), F.struct("n", "root")).alias("of"), F.min("root").alias("a"), F.max("root").alias("b"))
    several = materialise(whole.where("a <> b").select("key", "size", F.col("of.root").alias("top"), F.col("of.centre").alias("centre")), "several")
    return materialise(join_spread(held, several, "key", "size", held.count(), ["node"]).select("key", "band", "node", "root", "top", "centre"), "mixed")


def _tiles(members: DataFrame, placed: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, p, q, side, band, node, root, sig, marks: the tiles of the buckets whose members have several roots.

    members has (key, band, node), placed has (node, root, bytes), nodes has (node, sig, marks), which only members of such buckets need."""
    held = materialise(members.join(placed, "node"), "placed")
    own = held.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    whole = own.groupBy("key").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max_by("root", F.struct("n", "root")).alias("top"), F.max("n").alias("most"), F.min("root").alias("a"), F.max("root").alias("b"))
    side = F.greatest(F.lit(TILE_LEAST), F.least(F.lit(TILE_MOST), F.col("n") / 32))
    heavy = F.ceil(F.col("bytes") / TILE_BYTES)
    across = F.greatest(F.ceil(F.col("n") / side), heavy).cast("int")
    down = F.greatest(F.ceil((F.col("n") - F.col("most")) / side), F.least(heavy, F.col("n") - F.col("most"))).cast("int")
    buckets = materialise(whole.where("a <> b").select("key", "n", "top", across.alias("across"), down.alias("down")), "buckets")
    dealt = join_spread(held.select("key", "band", "node", "root"), buckets, "key", "n", held.count(), ["node"])
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    # The side of those outside the largest component is 1, that of all members 2, or 3 for those inside it.
    first = F.when(F.col("root") != F.col("top"), F.transform(upto("across"), lambda q: F.struct(place("down").alias("p"), q.alias("q"), F.lit(1).alias("side"))))
    second = F.transform(upto("down"), lambda p: F.struct(p.alias("p"), place("across").alias("q"), F.when(F.col("root") == F.col("top"), 3).otherwise(2).alias("side")))
    laid = dealt.join(nodes, "node").select("key", F.explode(F.concat(F.coalesce(first, F.slice(second, 1, 0)), second)).alias("tile"), "band", "node", "root", "sig", "marks")
    return laid.select("key", "tile.*", "band", "node", "root", "sig", "marks")


def _close(tiles: DataFrame, percent: int) -> DataFrame:
    """key, p, q, side, node, root of the members of tiles that have a close one of another root there, by signature."""
    least = sieve_threshold(percent / 100)

    def compare(group, _):
        side, node, root = (group[c].to_numpy() for c in ("side", "node", "root"))
        sig, mark = (np.frombuffer(b"".join(group[c].to_pylist()), dtype=kind).reshape(group.num_rows, -1) for c, kind in (("sig", np.uint8), ("marks", np.uint32)))
        left, right = np.flatnonzero(side == 1), np.flatnonzero(side != 1)
        found = np.zeros(len(side), dtype=bool)
        band = group["band"][0].as_py()
        for x in left.tolist():
            apart = right[(root[right] != root[x]) & ((side[right] == 3) | (node[right] > node[x]))]
            near = apart[_estimate(sig[apart] ^ sig[x]) >= least] if len(apart) else apart
            near = near[~(mark[near, :band] == mark[x, :band]).any(axis=1)] if len(near) else near
            if len(near):
                found[x] = True
                found[near] = True
        return group.select(["key", "p", "q", "side", "node", "root"]).filter(pa.array(found))

    return _by_tile(tiles, compare, "key long, p int, q int, side int, node long, root long")


def _by_tile(tiles: DataFrame, compare, kind: str) -> DataFrame:
    """What compare, a function of a tile's table and of what its task keeps of joined roots, gives for each tile. Most tiles are small, so a task runs through its tiles one after another."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def end():
            whole = pa.Table.from_batches(held)
            held.clear()
            return compare(whole, least).combine_chunks().to_batches()

        least: dict[int, int] = {}

        last = None
        for b in batches:
            place = [b[c].to_numpy() for c in ("key", "p", "q")]
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in place], axis=0)) + 1
            for first, past in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if first == past:
                    continue
                here = tuple(x[first].item() for x in place)
                if held and here != last:
                    yield from end()
                held.append(b.slice(first, past - first))
                last = here
        if held:
            yield from end()

    # Else a join's partitioning by key would do, and all tiles of a bucket would meet.
    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiles.repartition(parts, "key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(run, kind)


def _link_tiles(close: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, v), roots that belong together; close is what ``_close`` gives, texts has (node, text).

    Roots that a tile joins all go with the least of them, so what tiles and buckets have found alike is one row; what a
    task has joined is one root to its further tiles, so its rows are no more than the roots that it has, however many tiles join them."""

    def compare(group, least):
        if len(least) > FOREST:
            least.clear()
        node = group["node"].to_numpy()
        root = np.array([top_of(least, x) for x in group["root"].to_pylist()], dtype=np.int64)
        found = join_roots(group["side"].to_numpy(), node, root, shingle_sets(group["text"].to_pylist(), width), percent)
        u, v = stars(dict(zip(node.tolist(), root.tolist(), strict=True)), *found, least)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return _by_tile(close.join(texts, "node"), compare, "u long, v long")


def top_of(least: dict[int, int], x: int) -> int:
    """The root that x has been joined to, or x."""
    while (y := least.get(x, x)) != x:
        least[x] = least.get(y, y)
        x = y
    return x


def stars(root: dict[int, int], u: list[int], v: list[int], least: dict[int, int] | None = None) -> tuple[list[int], list[int]]:
    """The roots that links (u, v) join, each but the least with the least of all that are joined; ``least`` has what was joined before, and gets these."""
    least = {} if least is None else least
    ends = []
    for a, b in zip(u, v, strict=True):
        low, high = sorted((top_of(least, root[a]), top_of(least, root[b])))
        if low != high:
            least[high] = low
            ends.append(high)
    return [top_of(least, x) for x in ends], ends


def join_roots(side: np.ndarray, nodes: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """Links between members of side 1 and others of different roots, as few as join all that can be joined; sets are held against each other through an index of shingles."""
    left, right = np.flatnonzero(side == 1), np.flatnonzero(side != 1)
    if not len(left) or not len(right):
        return [], []
    _, group = np.unique(roots, return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate([sets[k] for k in right.tolist()])
    order = np.argsort(flat, kind="stable")
    shingles, firsts = np.unique(flat[order], return_index=True)
    owners = np.repeat(right, sizes[right])[order]
    ends = np.append(firsts[1:], len(flat))
    u, v = [], []
    for x in left.tolist():
        apart = right[group[right] != group[x]]
        if not len(apart):
            continue
        at = np.minimum(np.searchsorted(shingles, sets[x]), len(shingles) - 1)
        at = at[shingles[at] == sets[x]]
        if not len(at):
            continue
        both = np.bincount(np.concatenate([owners[firsts[k] : ends[k]] for k in at.tolist()]), minlength=len(sets))[apart]
        for y in apart[100 * both >= percent * (sizes[x] + sizes[apart] - both)].tolist():
            if group[y] != group[x]:
                u.append(int(nodes[x]))
                v.append(int(nodes[y]))
                group[group == group[y]] = group[x]
    return u, v


def _linked(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """row, doc_id, at, n, component_id of every row of docs (row, doc_id, text)."""
    rows = materialise(sketches(docs, width), "sketches")
    firsts = [F.first(c).alias(c) for c in ("sig", "bands", "marks")]
    classes = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("row").alias("row"), F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("copies"), *firsts)
    classes = materialise(classes.withColumn("node", F.xxhash64(F.monotonically_increasing_id())), "classes")

    keys = classes.select("node", F.posexplode("bands").alias("band", "key"))
    centres = materialise(keys.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("size")).where("size > 1"), "centres")
    members = materialise(join_spread(keys, centres, "key", "size", BANDS * classes.count(), ["node"]).select("key", "band", "node", "centre"), "members")
    nodes = members.select("node").distinct().join(classes.select("node", "row", "cls", "sig", "marks", "bytes"), "node")
    nodes = materialise(nodes, "nodes")
    texts = materialise(_texts(docs, nodes.select("node", "row", "cls"), width), "texts")
    least = sieve_threshold(percent / 100)

    def confirmed(pairs: DataFrame) -> DataFrame:
        return materialise(_confirm(materialise(_nearest(pairs.distinct(), nodes, least, percent / 100 + (percent / 100 - least) / 2), "nearest"), texts, width, percent), "links")

    def rooted(df: DataFrame) -> DataFrame:
        return df.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    links = confirmed(members.where("node <> centre").select(F.col("centre").alias("u"), F.col("node").alias("v")))
    roots = components(links)
    mixed = _mixed(members.select("key", "band", "node"), rooted(nodes.select("node")))
    further = confirmed(mixed.where("root <> top").select(F.col("centre").alias("u"), F.col("node").alias("v")))
    if not further.isEmpty():
        roots = components(links.union(further))

    tiles = _tiles(mixed.select("key", "band", "node"), rooted(nodes.select("node", "bytes")), nodes.select("node", "sig", "marks"))
    close = materialise(_close(tiles, percent), "close")
    more = materialise(_link_tiles(close, texts, width, percent).distinct(), "more-links")

    owned = rooted(classes.select("node", "cls", "rep", "copies"))
    tops = owned.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("_size"))
    if not more.isEmpty():
        # Roots that the tiles have joined: one row of each, so no node's row moves again.
        joined = components(more).select(F.col("node").alias("root"), F.col("root").alias("top"))
        placed = materialise(tops.join(joined, "root", "left").withColumn("top", F.coalesce("top", "root")), "tops")
        whole = placed.groupBy("top").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("_roots"))
        tops = join_spread(placed.select("root", "top", "_size"), whole, "top", "_roots", placed.count(), ["root"]).select("root", "component_id", "_size")
    belongs = materialise(join_spread(owned, tops, "root", "_size", classes.count(), ["node"]).select("cls", "component_id", "copies"), "belongs")
    full = join_spread(rows.where("cls IS NOT NULL").select("row", "doc_id", "at", "n", "cls"), belongs, "cls", "copies", rows.count(), ["row"])
    bare = rows.where("cls IS NULL").select("row", "doc_id", "at", "n", F.col("doc_id").alias("component_id"))
    return full.select("row", "doc_id", "at", "n", "component_id").union(bare)


def _kept() -> Column:
    return F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))


def link(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row: links have 100 * intersection >= percent * union."""
    rows = _numbered(docs.select("doc_id", "text"))
    return _linked(rows, width, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id", _kept().alias("kept"))


def keep(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with their columns, that ``link`` marks as kept, each id and text once; rows without an id stay."""
    held = [f"_c{i}" for i in range(len(docs.columns))]
    rows = _numbered(docs.toDF(*held))
    pair = rows.select("row", F.col(held[docs.columns.index("doc_id")]).alias("doc_id"), F.col(held[docs.columns.index("text")]).alias("text"))
    linked = materialise(_linked(pair, width, percent), "linked")
    once = linked.where(_kept()).groupBy("doc_id", "at").agg(F.min("row").alias("row")).select("row")
    kept = once.union(linked.where("doc_id IS NULL").select("row"))
    return rows.join(kept, "row", "left_semi").select(*held).toDF(*docs.columns)
