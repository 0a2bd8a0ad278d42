"""Conversation threads: reference edges, components, and the exact order-dependent replay."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions.text import sender_address
from threadlake.operators.ordering import positions
from threadlake.sources.shared import forget, stored


def edges(messages: DataFrame) -> DataFrame:
    """``pk, referenced``: every id a message names, once."""
    named = F.array_distinct(F.array_compact(F.concat(F.array("in_reply_to"), F.coalesce("references", F.array().cast("array<string>")))))
    return messages.select("pk", F.explode(named).alias("referenced"))


def nearest_parent(messages: DataFrame) -> DataFrame:
    """``pk, parent``: the first known of the replied-to id and the references from the last back."""
    order = F.concat(F.array("in_reply_to"), F.reverse(F.coalesce("references", F.array().cast("array<string>"))))
    named = messages.select("pk", F.posexplode(order).alias("at", "message_id")).where("message_id is not null")
    known = named.join(messages.select("message_id", F.col("pk").alias("parent")), "message_id")
    return known.groupBy("pk").agg(F.min_by("parent", "at").alias("parent"))


FEW = 10_000  # links that one task settles sooner than a round takes


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, name`` of links, one name for each component, by union-find."""
    top: dict[int, int] = {}
    kind = pa.int64()

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for batch in batches:
        kind = batch.schema.types[0]
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            top[root(top.setdefault(a, a))] = root(top.setdefault(b, b))
    if top:
        yield pa.RecordBatch.from_arrays([pa.array(list(top), kind), pa.array([root(x) for x in top], kind)], names=["node", "name"])


def components(links: DataFrame, nodes: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``pk, component`` (smallest pk) of every node; ``links`` has ``a, b``.

    Each round names a node after the neighbour (or itself) that comes first by a
    hash of the round, and keeps the links between names; so a round leaves a half
    of the names or fewer, whatever the shape, and the rounds together read little
    more than the first. At most ``FEW`` links that are left are settled in one task.
    A name carries the smallest pk it stands for, and names are looked up from
    the last round back, so no join has a component for a key. Rounds are tables in
    the shared folder, deleted at the end.
    """
    ends = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    lows = lambda step: step.groupBy("name").agg(F.min("low").alias("low"))
    rest = stored(links.select(*ends("a", "b")).where("a <> b").distinct())
    kind = rest.schema["a"].dataType.simpleString()
    steps: list[DataFrame] = []
    left = rest.count()
    while left:
        if len(steps) == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        few = left <= FEW
        if few:
            named = rest.coalesce(1).mapInArrow(united, f"node {kind}, name {kind}")
        else:
            rank = lambda c: F.xxhash64(c, F.lit(len(steps)))
            both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
            first = both.groupBy("a").agg(F.min_by("b", rank("b")).alias("b"))
            named = first.select(F.col("a").alias("node"), F.when(rank("b") < rank("a"), F.col("b")).otherwise(F.col("a")).alias("name"))
        steps.append(stored(named.join(lows(steps[-1]).withColumnRenamed("name", "node"), "node") if steps else named.withColumn("low", F.col("node"))))
        if few:
            break
        names = steps[-1].select("node", "name")
        new = rest.join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b").where("x <> y").select(*ends("x", "y")).distinct()
        old, rest = rest, stored(new)
        forget(old)
        left = rest.count()
    found = None
    for step in reversed(steps):
        least = lows(step)
        if found is not None:
            least = least.join(found.toDF("name", "far"), "name", "left").select("name", F.coalesce("far", "low").alias("low"))
        found = step.select("node", "name").join(least, "name").select("node", F.col("low").alias("component"))
    label = nodes.select("pk")
    label = stored(label.withColumn("component", F.col("pk")) if found is None else label.join(found.withColumnRenamed("node", "pk"), "pk", "left").select("pk", F.coalesce("component", "pk").alias("component")))
    for old in (rest, *steps):
        forget(old)
    return label


SHIFT = 44  # bits of a place in the order of arrival


def last_labels(edges: DataFrame) -> DataFrame:
    """``node, label``: the latest place in each node's component of ``edges`` (``span, a, b``), spans apart.

    A node is ``span`` and place in one long, with the place reversed, so that the
    smallest label is the latest.
    """
    key = lambda c: F.shiftleft(F.col("span"), SHIFT) + F.lit(2**SHIFT - 1) - F.col(c)
    links = edges.where("a <> b").select(key("a").alias("a"), key("b").alias("b"))
    nodes = links.select(F.col("a").alias("pk")).unionByName(links.select(F.col("b").alias("pk"))).distinct()
    place = lambda c: F.lit(2**SHIFT - 1) - F.col(c).bitwiseAND(F.lit(2**SHIFT - 1))
    return components(links, nodes).select(F.shiftright("pk", SHIFT).alias("span"), place("pk").alias("node"), place("component").alias("label"))


def arrivals(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages by place of arrival (``place, message_id``, one for each id: its first), and the links that the replay follows.

    A link ``later, earlier, near`` joins a message to the nearest ancestor that
    was there when it came (``near``), and to every message that was there and had
    named it. Which these are depends on the order alone, not on the threads.
    """
    firsts = messages.where("message_id is not null").groupBy("message_id").agg(F.min_by(F.struct("in_reply_to", "references", "arrival", "pk"), F.struct("arrival", "pk")).alias("m")).select("message_id", "m.*")
    placed = positions(firsts, ["arrival", "pk", "message_id"], "place").withColumn("place", F.col("place") - 1)
    order = F.concat(F.array("in_reply_to"), F.reverse(F.coalesce("references", F.array().cast("array<string>"))))
    named = placed.select("place", F.posexplode(order).alias("at", "name")).where("name is not null and name <> ''")
    met = named.join(placed.select(F.col("message_id").alias("name"), F.col("place").alias("other")), "name").where("place <> other")
    near = met.where("other < place").groupBy("place").agg(F.min_by("other", "at").alias("other")).select(F.col("place").alias("later"), F.col("other").alias("earlier"), F.lit(True).alias("near"))
    waiting = met.where("other > place").select(F.col("other").alias("later"), F.col("place").alias("earlier"), F.lit(False).alias("near"))
    links = near.unionByName(waiting).groupBy("later", "earlier").agg(F.max("near").alias("near"))
    return placed.select("place", "message_id"), links


def replay_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``place, up`` of the messages of each block, which come sorted by block and place.

    Threads of earlier blocks are known by the latest message in them. ``up`` is
    the message whose thread name a message's thread has: itself for a founder, or
    the latest of an earlier block's thread.
    """
    now, above, latest, up = None, {}, {}, {}

    def root(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    held: list[tuple[int, bool]] = []
    place = None

    def settle() -> None:
        """One message with all its links."""
        found = next((x for x, near in held if near), None)
        if found is None:
            up[place] = place
        else:
            ahead = latest.get(root(found), found)
            up[place] = up.get(ahead, ahead)
        mine = root(place)
        for x, _ in held:
            above[root(x)] = mine
        latest[mine] = place

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array(list(up.values()), pa.int64())], names=["place", "up"])

    for batch in batches:
        for block, later, earlier, near in zip(*(batch.column(c).to_pylist() for c in ("block", "later", "earlier", "near"))):
            if later != place:
                if place is not None:
                    settle()
                place, held = later, []
            if block != now:
                if up:
                    yield done()
                now, above, latest, up = block, {}, {}, {}
            if earlier is not None:
                held.append((earlier, near))
    if place is not None:
        settle()
        yield done()


def replay(messages: DataFrame, block: int = 1_000_000) -> DataFrame:
    """``message_id, thread_id``: threads as they come about when messages are taken in the order of arrival.

    A message joins the thread of the nearest ancestor that is known by then, else
    founds one named by its own id; then the threads of all messages that named it
    are merged into its own, under that one's name. ``messages`` has ``pk,
    message_id, in_reply_to, references, arrival``; a repeated id counts when it
    first comes, and rows without an id are left out.

    The order is cut into blocks of ``block`` messages. Which messages are joined
    before a block is a question of components, answered for all blocks at once by
    halving the order: links of a first half unite what the second half's links
    meet, so each halving costs one run of :func:`components` over disjoint parts;
    the first one's run also has the components of the whole order.
    Then a block sees earlier threads as single nodes and is replayed by itself, and
    the names are followed from block to block by pointer doubling. A task holds a
    block's messages and the links that can matter in it, whatever a thread's size.
    """
    known, links = arrivals(messages)
    known, links = stored(known), stored(links)
    total = known.count()
    halvings = max(0, math.ceil(math.log2(max(1, total) / block)))
    width = max(1, -(-total >> halvings))
    part = F.floor(F.col("later") / width).cast("long")
    rows = links.withColumn("block", part)
    at = lambda span: (F.lit(span).cast("long").alias("span"), F.col("later").alias("a"), F.col("earlier").alias("b"))
    whole = None if halvings else last_labels(links.select(*at(0)))
    for depth in range(halvings):
        # a span's first half unites nodes; the second half's links then meet the united ones
        rows = rows.withColumn("span", F.shiftright("block", halvings - depth)).withColumn("second", F.shiftright("block", halvings - depth - 1).bitwiseAND(F.lit(1)) == 1)
        halves = rows.where("not second").select("span", F.col("later").alias("a"), F.col("earlier").alias("b"))
        if whole is None:  # the first halving has one span, so all links are a second one in its rounds
            labels = last_labels(halves.unionByName(links.select(*at(1))))
            whole, labels = labels.where("span = 1"), labels.where("span = 0")
        else:
            labels = last_labels(halves)
        moved = rows.where("second").join(labels.withColumnRenamed("node", "earlier"), ["span", "earlier"], "left").withColumn("earlier", F.coalesce("label", "earlier")).drop("label")
        joined = rows.where("not second").unionByName(moved).groupBy("block", "later", "earlier").agg(F.max("near").alias("near"))
        rows = stored(joined)
    # an earlier thread that one message of a block meets, and not as its nearest, is not seen again in the block
    often = rows.where(F.floor(F.col("earlier") / width) < F.col("block")).groupBy("block", "earlier").agg(F.count("*").alias("times"))
    seen = rows.join(often, ["block", "earlier"], "left").where("near or times is null or times > 1").select("block", "later", "earlier", "near")
    alone = known.select(F.floor(F.col("place") / width).cast("long").alias("block"), F.col("place").alias("later"), F.lit(None).cast("long").alias("earlier"), F.lit(False).alias("near"))
    tasks = seen.unionByName(alone).repartition(1 << halvings, "block").sortWithinPartitions("block", "later", F.col("near").desc())
    names = stored(tasks.mapInArrow(replay_block, "place long, up long"))
    for _ in range(64):
        farther = names.select(F.col("place").alias("up"), F.col("up").alias("next"))
        nxt = stored(names.join(farther, "up").select("place", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")))
        forget(names)
        names = nxt.select("place", "up")
        names.threadlake_path = nxt.threadlake_path
        if nxt.where("moved").isEmpty():
            break
    ends = known.join(whole.select(F.col("node").alias("place"), "label"), "place", "left").select("message_id", F.coalesce("label", "place").alias("place"))
    called = names.join(known.select(F.col("place").alias("up"), F.col("message_id").alias("thread_id")), "up").select("place", "thread_id")
    return ends.join(called, "place").select("message_id", "thread_id")


def last_messages(messages: DataFrame, most: int = 20) -> DataFrame:
    """The last ``most`` of each thread, oldest first by ``position``."""
    back = Window.partitionBy("thread_id").orderBy(F.col("date_unix").desc(), F.col("pk").desc())
    kept = messages.withColumn("back", F.row_number().over(back)).where(F.col("back") <= most)
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("thread_id").orderBy("date_unix", "pk"))).drop("back")


def upto_target(messages: DataFrame) -> DataFrame:
    """Each thread up to its target message (``is_target``) and including it."""
    ahead = Window.partitionBy("thread_id").orderBy("date_unix", "pk").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return messages.withColumn("keep", F.max(F.col("is_target").cast("int")).over(ahead)).where("keep = 1").drop("keep")


def latest_thread(messages: DataFrame, address: str, scan: int = 500) -> DataFrame:
    """``thread_id`` of the newest message that an address sent; see :func:`latest_threads`."""
    one = messages.sparkSession.createDataFrame([(address,)], "address string")
    return latest_threads(messages, one, scan).select("thread_id")


def latest_threads(messages: DataFrame, addresses: DataFrame, scan: int = 500, block: int = 200) -> DataFrame:
    """``address, thread_id`` for each of ``addresses``: of the ``scan`` newest messages whose sender holds it as a substring, the first whose address it is.

    Addresses are a query set: ``block`` of them at a time are looked for in every
    sender, so a set of any size takes as many scans as blocks. They are compared
    lower-cased; null and empty ones find nothing.
    """
    wanted = [r.address for r in addresses.select("address").distinct().where("address <> ''").toLocalIterator()]
    out = messages.sparkSession.createDataFrame([], f"address string, thread_id {messages.schema['thread_id'].dataType.simpleString()}")
    newest = Window.partitionBy("address").orderBy(F.col("date_unix").desc(), F.col("pk").desc())
    for k in range(0, len(wanted), block):
        some = F.array(*[F.lit(a) for a in wanted[k : k + block]])
        met = messages.withColumn("address", F.explode(F.filter(some, lambda a: F.contains(F.lower("sender"), F.lower(a)))))
        seen = met.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= scan)
        own = seen.where(sender_address(F.col("sender")) == F.lower("address"))
        out = out.unionByName(own.groupBy("address").agg(F.min_by("thread_id", "nth").alias("thread_id")))
    return out
