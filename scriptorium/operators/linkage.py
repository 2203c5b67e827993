"""Record linkage: similarity joins, composition diffs and clusters.

Candidates come from inverted indexes (equal grams, equal items), which lose no
pair of a similarity above zero, and never from a product of the two sides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scriptorium.functions.offsets import codes
from scriptorium.operators import meetings
from scriptorium.operators.lineage import cut
from scriptorium.shipping import ship, small_batches

#: Signs of left texts that go to all tasks at once.
BLOCK = 4_000_000


def dice_pairs(left: DataFrame, right: DataFrame, n: int = 3, least: float = 0.0, best: bool = False) -> DataFrame:
    """(left_id, right_id, dice) of all pairs that share a gram; inputs have (id, text), and ids are keys.

    Texts of right stay where they are, and are held against all of left at hand, in blocks of ``BLOCK`` signs; each
    further block is one more pass. Only pairs with a dice of ``least`` or more come out; with ``best``, of each
    task and left row just the pair with the greatest dice to three digits, the least right_id of equals."""
    if not 1 <= n <= 3:
        raise ValueError("grams have one to three signs")
    spark = right.sparkSession
    ship(spark)
    small_batches(spark)
    kinds = [dict(x.dtypes)["id"] for x in (left, right)]
    kind = to_arrow_type(left.schema["id"].dataType)
    size = left.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK) or 1
    dealt = left.where("text IS NOT NULL").select("id", "text", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).alias("block"))
    hays = right.where("id IS NOT NULL AND text IS NOT NULL").select("id", "text")
    out = None
    for block in range(blocks):
        rows = dealt.where(F.col("block") == block).collect()
        part = hays.mapInArrow(_dice_pass([r["id"] for r in rows], [r["text"] for r in rows], kind, n, least, best), f"left_id {kinds[0]}, right_id {kinds[1]}, dice double")
        out = part if out is None else out.union(part)
    return out


def gram_codes(text: str, n: int) -> np.ndarray:
    """The set of a text's n-grams as numbers, 21 bits a sign; a shorter text is its own and only gram, the empty one included."""
    signs = codes(text).astype(np.uint64) + np.uint64(1)
    width = min(n, len(signs))
    out = np.zeros(len(signs) - width + 1, dtype=np.uint64)
    for j in range(width):
        out = out << np.uint64(21) | signs[j : j + len(out)]
    return np.unique(out)


def _dice_pass(ids: list, texts: list[str], kind: pa.DataType, n: int, least: float, best: bool):
    names = ["left_id", "right_id", "dice"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [gram_codes(t, n) for t in texts]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)])
        order = np.argsort(flat, kind="stable")
        owners = np.repeat(np.arange(len(sets)), sizes)[order]
        known, first = np.unique(flat[order], return_index=True)
        first = np.append(first, len(flat))
        keys = pa.array(ids, kind)
        top, held, exact = np.full(len(sets), -1, dtype=np.int64), [None] * len(sets), np.zeros(len(sets))
        for b in batches:
            lefts, rights, dices = [], [], []
            for row, (other, text) in enumerate(zip(b["id"].to_pylist(), b["text"].to_pylist(), strict=True)):
                own = gram_codes(text, n)
                at = np.searchsorted(known, own)
                at = at[known[np.minimum(at, len(known) - 1)] == own] if len(known) else at[:0]
                times = first[at + 1] - first[at]
                both = np.bincount(owners[np.repeat(first[at] - (np.cumsum(times) - times), times) + np.arange(times.sum())], minlength=len(sets))
                met = np.flatnonzero(both)
                dice = 2 * both[met] / (sizes[met] + len(own))
                wide = dice >= least
                met, dice = met[wide], dice[wide]
                if not best:
                    lefts.append(met)
                    rights.append(np.full(len(met), row))
                    dices.append(dice)
                    continue
                score = meetings.rounded(dice, 3)
                for k in np.flatnonzero(score >= top[met]).tolist():
                    i = int(met[k])
                    if score[k] > top[i] or other < held[i]:
                        top[i], held[i], exact[i] = score[k], other, dice[k]
            if lefts:
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.concatenate(lefts))), b["id"].take(pa.array(np.concatenate(rights))), pa.array(np.concatenate(dices))], names)
        if best and (top >= 0).any():
            found = np.flatnonzero(top >= 0)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(found)), pa.array([held[i] for i in found.tolist()], b["id"].type), pa.array(exact[found])], names)

    return run


def best_match(left: DataFrame, pairs: DataFrame, threshold: float, bonus: Column | None = None) -> DataFrame:
    """left_id, right_id, score of every left row: its best partner, the first of equals, and none below the threshold.

    The score is that of the best partner even if it isn't taken."""
    scored = pairs.withColumn("score", F.round(F.col("dice") + (bonus if bonus is not None else 0.0), 3))
    best = scored.groupBy("left_id").agg(F.max(F.struct("score", (-F.col("right_id")).alias("order"))).alias("b"))
    out = left.select(F.col("id").alias("left_id")).join(best, "left_id", "left")
    score = F.coalesce(F.col("b.score"), F.lit(0.0))
    return out.select("left_id", F.when(score >= threshold, -F.col("b.order")).alias("right_id"), score.alias("score"))


def one_to_one(pairs: DataFrame, group: str, threshold: float) -> DataFrame:
    """Greedy assignment in the order of left_id: each takes its best partner that is still free.

    As all partners prefer the least left_id, this is the stable matching, and it is found
    by rounds over the whole table: each left proposes to the best partner that it
    has left, each partner holds the least of its proposers, and pairs of a
    partner with a greater left than it holds are gone. It ends when nobody is turned down."""
    near = cut(pairs.where(F.col("score") >= threshold).select(group, "left_id", "right_id", "score"))
    while True:
        best = near.groupBy(group, "left_id").agg(F.min_by(F.struct("right_id", "score"), F.struct(-F.col("score"), "right_id")).alias("b")).select(group, "left_id", "b.right_id", "b.score")
        held = cut(best.groupBy(group, "right_id").agg(F.min("left_id").alias("_held")))
        rest = cut(near.join(held, [group, "right_id"], "left").where("_held IS NULL OR left_id <= _held").select(*near.columns))
        if best.join(held, [group, "right_id"]).where("left_id > _held").isEmpty():
            return best
        near = rest


def bags(rows: DataFrame, bag: str, item: str, dose: str, order: list[str]) -> DataFrame:
    """bag, size, and item to dose of each bag; the last of a repeated item counts."""
    # By bundle first, so that its items need no other shuffle to come together.
    one = rows.select(bag, item, dose, *[c for c in order if c not in (bag, item, dose)]).repartition(bag).groupBy(bag, item).agg(F.max_by(dose, F.struct(*order)).alias("dose"))
    return one.withColumnRenamed(bag, "bag").withColumnRenamed(item, "item")


def shared_items(one: DataFrame, keep: Callable[..., np.ndarray] | None = None) -> DataFrame:
    """(a, b, shared, changed, closeness, na, nb) of all pairs a < b of bags that share an item.

    ``changed`` counts shared items whose doses differ. ``keep`` (of arrays na, nb, shared, changed) says which pairs are wanted."""
    return meetings.pairs(one, keep)


def alike(least: float) -> Callable[..., np.ndarray]:
    """Keeps pairs with a Jaccard similarity of at least so much."""
    return lambda na, nb, shared, changed: shared / (na + nb - shared) >= least


def little_changed(most: int = 5) -> Callable[..., np.ndarray]:
    """Keeps pairs with one to so many changes."""
    return lambda na, nb, shared, changed: ((changes := na + nb - 2 * shared + changed) > 0) & (changes <= most)


def composition_diff(pairs: DataFrame, most: int = 5, least_jaccard: float = 0.2, least_shared: int = 2) -> DataFrame:
    """a, b, removed, added, changed, shared, kind of the pairs that differ a little.

    Dropped: equal pairs, pairs with more than ``most`` changes, and pairs
    with several changes that share too little by both measures."""
    d = pairs.withColumn("removed", F.col("na") - F.col("shared")).withColumn("added", F.col("nb") - F.col("shared"))
    d = d.withColumn("changes", F.col("removed") + F.col("added") + F.col("changed"))
    jaccard = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    d = d.where((F.col("changes") > 0) & (F.col("changes") <= most)).where(~((F.col("changes") > 1) & (jaccard < least_jaccard) & (F.col("shared") < least_shared)))
    kinds = F.when(F.col("changes") > F.greatest("removed", "added", "changed"), "multi").when(F.col("removed") > 0, "remove").when(F.col("added") > 0, "add").otherwise("dose")
    return d.select("a", "b", "removed", "added", "changed", "shared", kinds.alias("kind"))


def jaccard_pairs(pairs: DataFrame, least: float) -> DataFrame:
    j = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    return pairs.select("a", "b", "shared", j.alias("jaccard"), (j * F.col("closeness") / F.col("shared")).alias("dose_score")).where(F.col("jaccard") >= least)


def similar(rows: DataFrame, least: float, parts: int) -> DataFrame:
    """(a, b), a < b, of the bags of rows (bag, item) with a Jaccard similarity of ``least`` or more, through an index of pairs of items.

    Bags whose sizes ask for two shared items or more meet at each two that they share, which few others have, and are then
    compared in full. Only bags so small that one shared item does are paired at single items, by their sizes alone. An item
    that is null counts in its bag's size only."""
    own = rows.where("bag IS NOT NULL").repartition(parts, "bag").groupBy("bag").agg(F.sort_array(F.collect_set("item")).alias("items"), F.max(F.col("item").isNull().cast("int")).alias("none"))
    held = cut(own.select("bag", "items", (F.size("items") + F.col("none")).alias("n")))
    # shared / (na + nb - shared) >= least: with one shared item it holds for sizes that add up to this at most.
    alone = int(1 + 1 / least + 1e-9)
    single = held.where(F.col("n") < alone).select("bag", "n", F.explode("items").alias("item")).repartition(parts, "item")
    x, y = (single.select("item", F.col("bag").alias(k), F.col("n").alias(f"n{k}")) for k in "ab")
    by_one = x.join(y, "item").where((F.col("a") < F.col("b")) & (F.col("na") + F.col("nb") <= alone)).select("a", "b")
    two = F.flatten(F.transform("items", lambda p, i: F.transform(F.slice("items", i + 2, F.size("items")), lambda q: F.struct(p.alias("p"), q.alias("q")))))
    double = held.select("bag", "n", F.explode(two).alias("k")).select("bag", "n", "k.p", "k.q").repartition(parts, "p", "q")
    x, y = (double.select("p", "q", F.col("bag").alias(k), F.col("n").alias(f"n{k}")) for k in "ab")
    by_two = x.join(y, ["p", "q"]).where((F.col("a") < F.col("b")) & (F.col("na") + F.col("nb") > alone)).select("a", "b").distinct()
    sides = {k: held.select(F.col("bag").alias(k), F.col("items").alias(f"i{k}"), F.col("n").alias(f"n{k}")) for k in "ab"}
    shared = F.size(F.array_intersect("ia", "ib"))
    alike = by_two.join(sides["a"], "a").join(sides["b"], "b").where(shared / (F.col("na") + F.col("nb") - shared) >= least)
    return by_one.union(alike.select("a", "b")).distinct()


def leader_clusters(members: DataFrame, pairs: DataFrame, group: str) -> DataFrame:
    """group, leader, id: in the order of ids each free one leads and takes its free partners; clusters of two or more.

    Pairs (a, b) are of one group. A round makes leaders of all ids without a
    smaller partner that is still free; a partner of several goes to the least.
    What is decided leaves with its pairs, until no pair is left."""
    left = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    taken = None
    while not left.isEmpty():
        leaders = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        own = cut(left.join(leaders, "a").groupBy("b").agg(F.min("a").alias("leader")))
        taken = own if taken is None else taken.union(own)
        gone = own.select("b")
        left = cut(left.join(leaders, "a", "left_anti").join(gone, "b", "left_anti").join(gone.withColumnRenamed("b", "a"), "a", "left_anti").select("a", "b"))
    if taken is None:
        taken = left.select("b", F.col("a").alias("leader"))
    rows = taken.select("leader", F.col("b").alias("id")).union(taken.select("leader", "leader").distinct())
    return rows.join(members.select("id", group), "id").select(group, "leader", "id")


def name_families(rows: DataFrame, name: Column, base: Column, least: int = 2) -> DataFrame:
    """base, members (sorted), size of the families of names with the same base."""
    own = rows.select(name.alias("name"), base.alias("base")).distinct()
    return own.groupBy("base").agg(F.array_sort(F.collect_list("name")).alias("members"), F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
