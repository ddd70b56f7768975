"""Communities by label propagation (survey ids ALG-05, ALG-06, ALG-09), as joins and aggregates over the whole table.

Each node asks for the tag that has the most weight around it. In 'async' mode, of nodes that ask for a change only those
move in a round that come before all neighbours that ask for one, in an order that is drawn by a digest of the id. Two
neighbours never move at once, so no two swap tags for ever, as they may in 'sync' mode; and the drawn order lets a long
chain of nodes move in few rounds. One rule holds at every size, and no component, community or neighbourhood meets in a
task: votes are added up before they are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.functions.persist import cut, cut_and_told, numbered, sent
from thicket.operators.algorithms import undirected

ROUNDS = 50


def _digest():
    """Of tags, taken as they are written."""
    return F.sum(F.xxhash64("id", "tag").cast("decimal(38,0)")).alias("digest")


def _best(steps: DataFrame, tags: DataFrame) -> DataFrame:
    """(n, best): the tag with the most weight around each node; the smaller, if equal."""
    votes = steps.join(tags.select(F.col("id").alias("m"), "tag"), "m").groupBy("n", "tag").agg(F.sum("w").alias("w"))
    return votes.groupBy("n").agg(F.min(F.struct((-F.col("w")).alias("w"), "tag")).alias("best")).select("n", F.col("best.tag").alias("best"))


def propagated(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(id, tag): every round, each node takes the tag that it asks for. Where tags come back to those of two rounds
    before, the rest of the rounds is known."""
    steps = cut(undirected(edges), "steps")
    tags, told = cut_and_told(nodes.select("id", F.col("id").alias("tag")), "tags", _digest())
    past, states = [tags], [told["digest"]]
    for k in range(1, rounds + 1):
        new = tags.join(_best(steps, tags), F.col("id") == F.col("n"), "left").select("id", F.coalesce("best", "tag").alias("tag"))
        tags, told = cut_and_told(new, "tags", _digest())
        past, states = [*past[-1:], tags], [*states[-2:], told["digest"]]
        if states[-1] == states[-2]:
            break
        if len(states) > 2 and states[-1] == states[-3]:
            return past[-1] if (rounds - k) % 2 == 0 else past[-2]
    return tags


def settled(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(id, tag): every round, those nodes take the tag that they ask for which come before all neighbours that ask for
    a change. Ends when none asks for one, or after so many rounds."""
    steps = cut(undirected(edges).withColumns({"n_order": F.md5("n"), "m_order": F.md5("m")}), "steps")
    tags = cut(nodes.select("id", F.col("id").alias("tag")), "tags")
    for _ in range(rounds):
        asking = tags.join(_best(steps, tags), F.col("id") == F.col("n")).where("best <> tag").select("n", "best")
        asking, told = cut_and_told(asking, "asking", F.count(F.lit(1)).alias("n"))
        if not told["n"]:
            break
        others = steps.where("m_order < n_order").join(asking.select(F.col("n").alias("m")), "m", "left_semi").select("n").distinct()
        moving = asking.join(others, "n", "left_anti").withColumnRenamed("n", "id")
        tags = cut(tags.join(moving, "id", "left").select("id", F.coalesce("best", "tag").alias("tag")), "tags")
    return tags


def levels(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, level): 0 for nodes without a neighbour before them by id, else one more than the greatest level of those. Of
    two neighbours the one that comes first has the lower level, so the nodes of a level are no neighbours."""
    before = cut(steps.where("m < n").select("n", "m"), "before")
    found = cut(nodes.select("id").join(before.select(F.col("n").alias("id")).distinct(), "id", "left_anti").withColumn("level", F.lit(0)), "level")
    done, level = [found], 0
    waits = cut(before.groupBy("n").agg(F.count(F.lit(1)).alias("open")), "waits")
    while waits.limit(1).count():
        # A node is of the next level once all nodes before it have one.
        less = before.join(sent(found.select(F.col("id").alias("m"))), "m", "left_semi").groupBy("n").agg(F.count(F.lit(1)).alias("less"))
        waits = cut(waits.join(less, "n", "left").select("n", (F.col("open") - F.coalesce("less", F.lit(0))).alias("open")), "waits")
        level += 1
        found = cut(waits.where("open = 0").select(F.col("n").alias("id"), F.lit(level).alias("level")), "level")
        waits = waits.where("open > 0")
        done.append(found)
    return reduce(DataFrame.unionByName, done)


def visited(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(id, tag): what visiting the nodes one after the other by id gives, where each at once takes the tag that it asks
    for; ends when a round changes none.

    Nodes of one level (levels()) are no neighbours, so they can be visited at once, after all lower levels. A round is as
    many steps as there are levels, and a step moves the votes for its level's nodes only. Tags are a log: a node's last
    row holds.
    """
    steps = cut(undirected(edges), "steps")
    own = cut(levels(steps, nodes), "levels")
    votes = cut(steps.join(own.withColumnRenamed("id", "n"), "n"), "votes")
    tags, last = cut(nodes.select("id", F.col("id").alias("tag")), "tags"), own.agg(F.max("level")).first()[0] or 0
    for _ in range(rounds):
        moves, stirred = [], False
        for level in range(last + 1):
            mine = votes.where(F.col("level") == level).drop("level")
            known = tags
            for m in moves:  # tags taken in this round
                known = known.join(sent(m.select("id", F.col("tag").alias("taken"))), "id", "left").select("id", F.coalesce("taken", "tag").alias("tag"))
            best = _best(mine, known).withColumnsRenamed({"n": "id", "best": "tag"})
            moved = cut(best.join(known.withColumnRenamed("tag", "old"), "id").where("tag <> old").select("id", "tag"), "moved")
            if moved.limit(1).count():
                moves.append(moved)
            if moves and (len(moves) >= 8 or level == last):
                for m in moves:
                    tags = tags.join(sent(m.select("id", F.col("tag").alias("taken"))), "id", "left").select("id", F.coalesce("taken", "tag").alias("tag"))
                tags, stirred, moves = cut(tags, "tags"), True, []
        if not stirred:
            break
    return tags


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS, mode: str = "async") -> DataFrame:
    """ALG-05: (id, community): numbers from 0 in order of first appearance among the ids in order. mode: 'async'
    (settled), 'sync' (propagated) or 'ordered' (visited: as a single process that goes by id). Isolated nodes keep their
    own tag."""
    tags = cut({"sync": propagated, "ordered": visited, "async": settled}[mode](nodes, edges, rounds), "tags")
    ids = numbered(tags.groupBy("tag").agg(F.min("id").alias("first")), "community", "first").select("tag", "community")
    return tags.join(ids, "tag").select("id", "community")


def summary(labels: DataFrame) -> DataFrame:
    """ALG-06: (community, size, id): a row for each member, the largest community first, members in order."""
    sizes = labels.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    return labels.join(sizes, "community").select("community", "size", "id").orderBy(F.desc("size"), "community", "id")


def type_histogram(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """ALG-09: (community, entity_type, n); null counts as 'untyped'."""
    return labels.join(nodes.select("id", F.coalesce("entity_type", F.lit("untyped")).alias("entity_type")), "id").groupBy("community", "entity_type").agg(F.count(F.lit(1)).alias("n"))


def first_members(labels: DataFrame, k: int = 20) -> DataFrame:
    """ALG-09: (community, members): the first k of each."""
    from pyspark.sql import Window

    own = Window.partitionBy("community").orderBy("id")
    return labels.withColumn("r", F.row_number().over(own)).where(F.col("r") <= k).groupBy("community").agg(F.array_sort(F.collect_list("id")).alias("members"))
