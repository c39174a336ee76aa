"""Maximal cliques of graphs that stay distributed, found between groups of nodes that have the same neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .graphs import degrees


def grown(near: list[int], inside: int, beside: int, part: int = 0, parts: int = 1) -> Iterator[list[int]]:
    """The maximal cliques of the nodes whose bits are in ``inside`` that none of ``beside`` is next to, by Bron and Kerbosch with a pivot; of the branches at the top each ``parts``-th from ``part``.

    ``near`` has the neighbours of each node as bits; of nodes in ``beside`` only those that are inside count.
    """
    if not inside:
        if not beside and not part:
            yield []
        return
    rest = [(inside, beside, None, True)]
    while rest:
        inside, beside, path, top = rest.pop()
        if not inside:
            if not beside:
                clique = []
                while path:
                    clique.append(path[0])
                    path = path[1]
                yield clique
            continue
        most, pivot, all_of, left = -1, 0, inside.bit_count(), inside | beside
        while left:
            low = left & -left
            left ^= low
            i = low.bit_length() - 1
            count = (inside & near[i]).bit_count()
            if count > most:
                most, pivot = count, i
                if count >= all_of - (inside >> i & 1):
                    break
        left, at = inside & ~near[pivot], 0
        while left:
            low = left & -left
            left ^= low
            i = low.bit_length() - 1
            if not top or at % parts == part:
                rest.append((inside & near[i], beside & near[i], (i, path), False))
            inside, beside, at = inside ^ low, beside | low, at + 1


def cliques(links: DataFrame, members: DataFrame, least: int = 3, most_edges: int = 20_000, save: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """(nodes, size, confidence): maximal cliques of ``least`` nodes or more, nodes ascending, with the mean confidence of their pairs; ``links`` and ``members`` as in ``twins``.

    Classes next to one another and to the same others are in the same maximal cliques, so they are one module (told by two 64-bit hashes of neighbours), and cliques are looked
    for between modules. Modules are ordered by degree, then id; a clique belongs to its first module, whose later neighbours are at most about the root of twice the number of
    links. Modules are dealt over groups, one for each shuffle partition, and a task gets the later neighbours of its own modules and of all next to them: what is shuffled are at
    most so many copies of the links between modules, never triangles or cliques. The branches of a module that may have more than ``most_edges`` links among its later neighbours are dealt over several groups.
    """
    kind = links.schema["a"].dataType
    both = links.select(F.col("a").alias("cls"), F.col("b").alias("x")).unionAll(links.select("b", "a")).unionAll(members.filter("node = cls").select("cls", "cls"))
    mark = save(both.groupBy("cls").agg(*[F.bit_xor(F.xxhash64("x", F.lit(i))).alias(f"_{i}") for i in range(2)], F.count(F.lit(1)).alias("_n")))
    same = ["_0", "_1", "_n"]
    home = save(mark.join(mark.groupBy(*same).agg(F.min("cls").alias("m")), same).select("cls", "m"))
    side = lambda x: home.select(F.col("cls").alias(x), F.col("m").alias(f"m{x}"))
    ends = links.select("a", "b", (F.col("n_a").cast("double") * F.col("n_b") * F.col("confidence")).alias("w")).join(side("a"), "a").join(side("b"), "b")
    sums = save(ends.groupBy(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).agg(F.sum("w").alias("w")))
    modules = members.join(home, "cls").groupBy("m").agg(F.collect_list("node").alias("nodes"), F.sum((F.col("n") - 1) / 2).alias("own"))  # the pairs of twins
    modules = modules.join(sums.filter("a = b").select(F.col("a").alias("m"), "w"), "m", "left").withColumn("own", F.col("own") + F.coalesce("w", F.lit(0.0))).drop("w")

    between = sums.filter("a <> b")
    rank = degrees(between)
    e = between.join(rank.withColumnsRenamed({"node": "a", "degree": "da"}), "a").join(rank.withColumnsRenamed({"node": "b", "degree": "db"}), "b")
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    arcs = save(e.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("m"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"), "w"))
    later = arcs.groupBy("m").agg(F.collect_list("v").alias("vs"), F.collect_list("w").alias("ws"))
    lists = save(modules.join(later, "m", "left").withColumns({"vs": F.coalesce("vs", F.array().cast(ArrayType(kind))), "ws": F.coalesce("ws", F.array().cast("array<double>"))}))

    groups = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = F.size("vs").cast("bigint")
    parts = F.greatest(F.lit(1), F.least(n, F.ceil(n * (n - 1) / 2 / most_edges))).cast("int").alias("parts")
    units = lists.select("m", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("g", F.pmod(F.xxhash64("m", "part"), F.lit(groups)).cast("int"))
    units = save(units.groupBy("g", "m").agg(F.first("parts").alias("parts"), F.collect_list("part").alias("work")))
    next_to = arcs.select("m", F.col("v").alias("x")).unionAll(arcs.select("v", "m"))
    asked = next_to.join(units.select("g", "m"), "m").select("g", F.col("x").alias("m")).unionAll(units.select("g", "m")).distinct()
    rows = asked.join(lists, "m").join(units, ["g", "m"], "left")
    schema = StructType([StructField("nodes", ArrayType(kind)), StructField("size", IntegerType()), StructField("confidence", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        column = lambda c: t.column(c).combine_chunks()
        counts = lambda c: np.concatenate([[0], np.cumsum(pc.list_value_length(column(c)).to_numpy(zero_copy_only=False))])
        to, weight, ends = pc.fill_null(pc.index_in(pc.list_flatten(column("vs")), column("m")), -1).to_numpy(), pc.list_flatten(column("ws")).to_numpy(), counts("vs")
        ids, until, own = pc.list_flatten(column("nodes")), counts("nodes"), column("own").to_numpy()
        place = np.empty(len(ids), np.int64)
        place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        source, there = np.repeat(np.arange(t.num_rows), np.diff(ends)), to >= 0
        order = np.argsort(to[there], kind="stable")
        earlier, until_earlier = source[there][order], np.searchsorted(to[there][order], np.arange(t.num_rows + 1))
        local, found, held = np.full(t.num_rows + 1, -1), [], 0  # the last place is of modules that aren't here
        out = lambda: pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.cumsum([0, *map(len, (x for x, _ in found))], dtype=np.int32), ids.take(pa.array(np.concatenate([x for x, _ in found])))), pa.array([len(x) for x, _ in found], pa.int32()), pa.array([c for _, c in found])], names=schema.names)
        for u, work, parts in zip(range(t.num_rows), t.column("work").to_pylist(), t.column("parts").to_pylist(), strict=True):
            if work is None:
                continue
            inner, outer = to[ends[u] : ends[u + 1]], earlier[until_earlier[u] : until_earlier[u + 1]]
            p = len(inner)
            local[inner] = np.arange(p)
            table, inward = np.zeros((p + len(outer), p), bool), []
            for i, x in enumerate([*inner, *outer]):
                at = local[to[ends[x] : ends[x + 1]]]
                kept = at >= 0
                table[i, at[kept]] = True
                if i < p:
                    inward.append((at[kept], weight[ends[x] : ends[x + 1]][kept]))
            local[inner] = -1
            table[:p] |= table[:p].T
            bits = lambda row: int.from_bytes(np.packbits(row, bitorder="little").tobytes(), "little")
            near = [bits(row) for row in np.concatenate([table[:p], table[p:].T], axis=1)] + [bits(row) for row in table[p:]]
            inside = (1 << p) - 1
            for part in work:
                for clique in grown(near, inside, ((1 << len(outer)) - 1) << p, part, parts):
                    modules = [u, *inner[clique]] if clique else [u]
                    size = int(sum(until[x + 1] - until[x] for x in modules))
                    if size < least:
                        continue
                    mask = np.zeros(p, bool)
                    mask[clique] = True
                    total = own[modules].sum() + weight[ends[u] : ends[u + 1]][mask].sum() + sum(w[mask[at]].sum() for at, w in (inward[i] for i in clique))
                    nodes = np.concatenate([np.arange(until[x], until[x + 1]) for x in modules])
                    found.append((nodes[np.argsort(place[nodes])], float(total) / (size * (size - 1) / 2)))
                    held += size
                    if held > 500_000:
                        yield out()
                        found, held = [], 0
        if found:
            yield out()

    return rows.repartition(groups, "g").groupBy("g").applyInArrow(run, schema)
