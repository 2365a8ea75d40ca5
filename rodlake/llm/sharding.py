"""Sharding by balanced label propagation.

Documents are linked by hubs (an equal text, a shared line). Shards are labels: in each
round every linked document votes, through its hubs, for the shard where most of its
neighbours are, and moves there if the shard has room for it. What leaves a shard makes
room in the same round, so full shards exchange documents. Documents with the same
hubs and the same label are one vertex with a weight, so a hub that holds a third of
all rows is a few vertices. Documents without links cost no edge wherever they are, so
they fill what room is left, which makes the sizes exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, crowded, discard, lookup, ranked, salted, save

#: Ranks of moves: gain in powers of two, then a hash, so that a full shard takes the best moves first.
LEVELS, DEALS = 40, 64
#: Propagation has settled when no document wishes to move, or when this many rounds add less than a thousandth to the links kept.
PATIENCE, LEAST = 6, 1e-3
#: Vertices are split into pieces of about a PIECES-th of a shard, as a full shard exchanges whole vertices only.
PIECES = 64
#: Rows or vertices of one hub that one task joins; hubs with more are dealt over several.
HUB = 200_000
#: Between rounds a shard may hold a SLACK-th more than its quota, if rows without links leave no places; the end takes it back.
SLACK = 64


def _literal(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def _cuts(sums: list[tuple[int, int, int, int]], room: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of (own, to, order, n): for each own and to the order below which moves are taken, and their weight.

    What leaves a shard makes room in it. First all moves are taken; while a shard is
    overfull, the fullest takes back its last step from the shard that can best keep it.
    """
    shards, space = len(room), np.array(room, float)
    order: dict[tuple[int, int], list[int]] = {}
    total: dict[tuple[int, int], list[int]] = {}
    for own, to, at, n in sorted(sums):
        order.setdefault((own, to), []).append(at)
        held = total.setdefault((own, to), [0])
        held.append(held[-1] + n)
    taken = np.zeros((shards, shards))
    for pair, held in total.items():
        taken[pair] = held[-1]
    count = {pair: len(o) for pair, o in order.items()}
    left, least = space + taken.sum(1) - taken.sum(0), np.minimum(space, 0)
    while ((over := left < least) & (taken > 0).any(0)).any():
        to = int(np.argmin(np.where(over & (taken > 0).any(0), left, np.inf)))
        own = int(np.argmax(np.where(taken[:, to] > 0, left, -np.inf)))
        count[own, to] -= 1
        step = taken[own, to] - total[own, to][count[own, to]]
        taken[own, to] -= step
        left[own] -= step
        left[to] += step
    # what is left of the room goes to whole steps of single pairs, the best first
    more = True
    while more:
        more = False
        for pair in sorted((p for p in order if count[p] < len(order[p])), key=lambda p: (order[p][count[p]], p)):
            own, to = pair
            while count[pair] < len(order[pair]) and taken[:, to].sum() + total[pair][count[pair] + 1] - taken[pair] <= space[to] + taken[to].sum():
                count[pair] += 1
                taken[pair] = total[pair][count[pair]]
                more = True
    cut = np.zeros((shards, shards), int)
    for pair, c in count.items():
        cut[pair] = order[pair][c - 1] + 1 if c else 0
    return cut, taken


def _round(vertices: DataFrame, quota: list[int], turn: int, closed: set[int], crowd: DataFrame | None = None) -> tuple[DataFrame, set[int], float, int]:
    """One step of propagation over (v, n, hubs, shard).

    crowd: hubs of many vertices, from ``crowded``. closed: shards that no vertex may wish for now. Returns the moved table, the shards that
    took in under an eighth of what wished for them, the links kept before this step
    (ordered pairs of rows in one hub and one shard) and the weight that moved.
    """
    shards = len(quota)
    load = [0] * shards
    for s, n in vertices.groupBy("shard").agg(F.sum("n")).collect():
        load[s] = n
    idle = (sum(quota) - sum(load)) // shards
    room = [q + max(0, q // SLACK - idle) - x for q, x in zip(quota, load)]
    ends = vertices.select("v", "n", "shard", F.element_at("hubs", 1).alias("h"), F.explode("hubs").alias("hub"))
    held = save(ends.groupBy("hub", "shard").agg(F.sum("n").alias("c")).groupBy("hub").agg(F.collect_list(F.struct("shard", "c")).alias("held")), "lp-hubs")
    kept = held.agg(F.sum(F.aggregate("held", F.lit(0.0), lambda a, x: a + x["c"].cast("double") * x["c"]))).first()[0] or 0.0
    votes = salted(ends, held, "hub", crowd, F.col("v")).select("v", "n", "h", F.col("shard").alias("own"), F.explode("held").alias("x"))
    votes = votes.groupBy("v", "n", "h", "own", F.col("x.shard").alias("to")).agg(F.sum("x.c").alias("c"))
    here = F.max(F.when(F.col("to") == F.col("own"), F.col("c")).otherwise(0))
    # a vertex may stay, or go where the shard is not closed; most votes, then a shard that all documents of a hub agree on and that differs from hub to hub
    open_ = F.when((F.col("to") == F.col("own")) | ~F.element_at(_literal([s in closed for s in range(shards)]), F.col("to") + 1).cast("boolean"), F.struct("c", F.xxhash64("h", "to").alias("tie"), "to"))
    wish = votes.groupBy("v", "n", "own").agg(F.max(open_).alias("best"), here.alias("here"))
    gain = F.col("best.c") - F.col("here")
    order = (LEVELS - F.floor(F.log2(F.greatest(gain, F.lit(0)) + 1))) * DEALS + F.pmod(F.xxhash64("v", F.lit(turn)), F.lit(DEALS))
    wish = save(wish.select("v", "n", "own", F.col("best.to").alias("to"), order.cast("int").alias("order")).where("own <> to"), "lp-wish")
    # at most shards * shards * LEVELS * DEALS sums reach the driver, whatever the input
    sums = [tuple(r) for r in wish.groupBy("own", "to", "order").agg(F.sum("n")).collect()]
    cut, gone = _cuts(sums, room)
    asked = [0] * shards
    for _, to, _, n in sums:
        asked[to] += n
    taken = wish.where(F.col("order") < F.element_at(_literal(cut.ravel()), F.col("own") * shards + F.col("to") + 1)).select("v", "to")
    now = save(vertices.join(taken, "v", "left").select("v", "n", "hubs", F.coalesce("to", "shard").cast("int").alias("shard")), "lp-vertices")
    discard(held, wish, vertices)
    return now, {s for s in range(shards) if 8 * gone[:, s].sum() < asked[s]}, kept, int(gone.sum())


def balanced_shards(docs: DataFrame, hubs: Column, key: list[Column], shards: int = 16) -> DataFrame:
    """``docs`` plus shard (int, from 0) and slot (long, gapless from 0 in each shard).

    hubs: array<long>; rows with a hub in common are linked, nulls and hubs of one row
    link nothing. key: columns that tell rows apart; rows equal in all of them are
    interchangeable. The law is ``rows``: shard sizes differ by one row at most,
    however large a group of linked rows is; a group that a shard cannot hold is split.
    Empty table: no rows. ``docs`` should be narrow: its rows are shuffled.
    """
    kept = docs.columns
    # _row tells equal rows apart; it is drawn once, as the table is written
    base = save(docs.select(*kept, F.xxhash64(*key).alias("_node"), hubs.alias("_hubs"), F.monotonically_increasing_id().alias("_row")), "lp-base")
    total = base.count()
    equal = crowded(base, "_node", 1000)
    link = base.select("_node", F.explode(F.array_distinct("_hubs")).alias("hub")).where("hub is not null")
    live = save(link.groupBy("hub").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "lp-live")
    busy = live.where(F.col("rows") > HUB).select("hub", F.ceil(F.col("rows") / HUB).cast("int").alias("_parts"))
    mine = save(salted(link.distinct(), live.select("hub"), "hub", busy if busy.limit(1).count() else None, F.col("_node")).groupBy("_node").agg(F.sort_array(F.collect_list("hub")).alias("hubs")), "lp-links")
    start = F.pmod(F.xxhash64("_node", F.lit("shard")), F.lit(shards)).cast("int")
    placed = base.drop("_hubs").join(mine, "_node", "left").withColumn("v", F.when(F.col("hubs").isNotNull(), F.xxhash64("hubs", start)))
    whole = save(placed, "lp-whole")
    most = max(16, total // shards // PIECES)
    heavy = save(whole.where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > most), "lp-heavy")
    piece = F.pmod(F.xxhash64("_node", F.lit("piece")), F.ceil(F.col("rows") / most))
    placed = whole.join(lookup(heavy, 200_000), "v", "left").withColumn("v", F.when(F.col("rows").isNull(), F.col("v")).otherwise(F.xxhash64("v", piece)))
    placed = save(placed.drop("rows"), "lp-placed")
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    vertices = save(placed.where("v is not null").groupBy("v", "hubs", start.alias("shard")).agg(F.count(F.lit(1)).alias("n")).select("v", "n", "hubs", "shard"), "lp-vertices")
    crowd = crowded(vertices.select(F.explode("hubs").alias("hub")), "hub", HUB)
    discard(base, live, mine, whole, heavy)
    turn, best, idle, closed = 0, 0.0, 0, set()
    while idle < PATIENCE:
        vertices, full, links, moved = _round(vertices, quota, turn, closed, crowd)
        if not closed and not full and not moved:
            break  # no vertex wishes to move
        # who wished for a crowded shard may try the next best, until nothing moves and all are open again
        closed = closed | full if moved or full else set()
        idle, best = (0, links) if links > best * (1 + LEAST) else (idle + 1, best)
        turn += 1
    load = [0] * shards
    for s, n in vertices.groupBy("shard").agg(F.sum("n")).collect():
        load[s] = n
    stays = [min(q, x) for q, x in zip(quota, load)]
    free, over, past = total - sum(load), [], total - sum(load)
    for q, x in zip(quota, load):
        over.append(past)
        past += max(0, x - q)
    ends, room = [], 0
    for q, s in zip(quota, stays):
        room += q - s
        ends.append(room)
    named = placed.drop("hubs").join(vertices.select("v", "n", F.col("shard").alias("_s")), "v", "left")
    # documents of one vertex lie together, so that an overfull shard gives up whole groups first
    salt = F.when(F.col("n") <= 64, F.xxhash64("v")).otherwise(F.xxhash64("_node", F.lit(1)))
    if equal is not None:  # rows that are repeated many times are dealt one by one
        named = named.join(lookup(equal, 200_000), "_node", "left")
        salt = F.when(F.col("_parts").isNotNull(), F.xxhash64("_node", "_row")).otherwise(salt)
    named = named.withColumn("_key", F.coalesce("_s", F.lit(-1)))
    rank = ranked(named, "_key", [F.col("v"), F.col("_node"), F.col("_row")], salt, total, "_rank")
    at = F.col("_s") + 1
    fits = F.col("_s").isNotNull() & (F.col("_rank") < F.element_at(_literal(stays), at))
    fill = F.when(F.col("_s").isNull(), F.col("_rank")).otherwise(F.col("_rank") - F.element_at(_literal(stays), at) + F.element_at(_literal(over), at))
    # the shard of fill number f: the first whose room up to here exceeds f
    put = F.size(F.filter(_literal(ends), lambda e: e <= F.col("_fill")))
    before = F.element_at(_literal([0, *ends[:-1]]), F.col("_put") + 1)
    out = rank.withColumn("_fill", F.when(~fits, fill)).withColumn("_put", F.least(put, F.lit(shards - 1)))
    out = out.withColumn("shard", F.when(fits, F.col("_s")).otherwise(F.col("_put")).cast("int"))
    out = out.withColumn("slot", F.when(fits, F.col("_rank")).otherwise(F.element_at(_literal(stays), F.col("_put") + 1) + F.col("_fill") - before))
    assert free >= 0 and past == room
    return out.select(*kept, "shard", "slot")


def cut_edges(assigned: DataFrame, group: str) -> DataFrame:
    """Pairs of rows of one group, and how many of them lie in different shards; (edges, cut), one row. Null groups have no pairs."""
    each = assigned.where(F.col(group).isNotNull()).groupBy(group, "shard").agg(F.count(F.lit(1)).cast("double").alias("n"))
    sums = each.groupBy(group).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("q"))
    return sums.agg(F.sum((F.col("n") * F.col("n") - F.col("n")) / 2).alias("edges"), F.sum((F.col("n") * F.col("n") - F.col("q")) / 2).alias("cut"))


def _size(text: str) -> Column:
    """UTF-8 bytes plus 1; null: 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of all documents, under the law ``rows``.

    Documents with equal texts are linked, empty ones too; a null text is equal to no
    other, its size is 1 and its text_crc32 null. Null and repeated ids keep their rows;
    equal rows are interchangeable, so which of them gets which place is open. Whole
    texts count, however long. Further columns are ignored, whatever their names.
    Empty table: no rows.
    """
    given = docs.select("doc_id", _size("text").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("_text"), F.col("text").isNull().alias("_none"))
    hub = F.when(~F.col("_none"), F.array("_text")).otherwise(F.expr("cast(array() as array<bigint>)"))
    out = balanced_shards(given, hub, [F.col("doc_id"), F.col("_text"), F.col("size")], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Characters that a line needs to link the documents that share it.
LINE = 60
#: Columns that ``line_shards`` adds.
ADDED = ["size", "text_crc32", "shard", "slot"]


def line_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``docs``, texts included, plus size, text_crc32, shard and slot; documents that share a line of LINE characters or more are linked.

    All columns stay; one named like a column added is replaced. Rows move without their
    texts, which join at the end by id and two hashes of the text; where rows repeat these, texts are
    written once, with a number for each row, and join by that. Null texts have no lines, size 1 and a null
    text_crc32. Null and repeated ids keep their rows; equal rows are interchangeable. Whole
    texts are read, however long. Empty table: no rows.
    """
    plain, _ = aside(docs)
    doc, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    kept = [(f"c{i}", c) for i, c in enumerate(docs.columns) if c not in ADDED]
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: F.length(x) >= LINE), lambda x: F.xxhash64(x))
    narrow = [_size(text).alias("size"), F.crc32(F.col(text).cast("binary")).alias("text_crc32"), F.coalesce(F.array_distinct(lines), F.expr("cast(array() as array<bigint>)")).alias("lines")]
    keyed = plain.select(*[c for c, _ in kept], F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    if keyed.groupBy(doc, "t1", "t2").count().where("count > 1").limit(1).count():
        ids = ["row"]
        keyed = save(plain.select(*[c for c, _ in kept], F.monotonically_increasing_id().alias("row")), "shard-whole")
        given = keyed.select("row", F.col(doc).alias("k0"), *narrow)
    else:
        ids = ["k0", "t1", "t2"]
        keyed = keyed.withColumn("k0", F.col(doc))
        given = keyed.select("k0", "t1", "t2", *narrow)
    out = balanced_shards(given, F.col("lines"), [F.col("k0"), F.col("text_crc32"), F.col("size")], shards).select(*[F.col(k).alias(f"_{k}") for k in ids], *ADDED)
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in ids]
    return keyed.join(out, on).select(*[F.col(c).alias(name) for c, name in kept], *ADDED)
