"""Filling of fixed-capacity containers with items of varying length.

Best-two-fit inside bounded shards: a container is filled greedily, then its smallest item is exchanged for the two
unpacked items that fill its widened gap best. Sizes are small numbers, so a shard is a table of sizes with the items of
each, and the sizes at hand are the bits of one number. Containers of a shard that stay too empty are opened again and
their items packed across shards in a second pass.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.session import materialize

#: Parameters: items of a shard on average; unused share from which a container is opened again.
SHARD_ITEMS, LOOSE = 20_000, 0.005


def best_two_fit(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each item (sizes from 1 to ``capacity``; empty items take the first container)."""
    stock: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        stock.setdefault(s, []).append(i)
    empty = stock.pop(0, [])
    bits = sum(1 << s for s in stock)
    out = [0] * len(sizes)

    def largest(upto: int) -> int:
        return (bits & ((1 << (upto + 1)) - 1)).bit_length() - 1 if upto > 0 else -1

    def take(s: int) -> int:
        nonlocal bits
        i = stock[s].pop()
        if not stock[s]:
            del stock[s]
            bits &= ~(1 << s)
        return i

    def give(s: int, i: int) -> None:
        nonlocal bits
        stock.setdefault(s, []).append(i)
        bits |= 1 << s

    def two(room: int) -> tuple[int, int]:
        best, a = (0, 0), largest(room - 1)
        while a > 0 and 2 * a > sum(best):
            b = largest(min(room - a, a))
            if b == a and len(stock[a]) < 2:
                b = largest(min(room - a, a - 1))
            if b > 0 and a + b > sum(best):
                best = (a, b)
                if a + b == room:
                    break
            a = largest(a - 1)
        return best

    number = 0
    while bits:
        room, held = capacity, []
        while (s := largest(room)) > 0:
            held.append((s, take(s)))
            room -= s
        while room and held:
            small, i = min(held)
            a, b = two(room + small)
            if a + b <= small:
                break
            held.remove((small, i))
            held += [(a, take(a)), (b, take(b))]
            give(small, i)
            room += small - a - b
        for _, i in held:
            out[i] = number
        number += 1
    for i in empty:
        out[i] = 0
    return out


def items(sized: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece, start, size): one row per item, or several where an item alone exceeds the capacity."""
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col(size) / capacity).cast("int") - 1)), lambda i: F.struct(i.alias("piece"), (i * capacity).alias("start"), F.least(F.lit(capacity), F.col(size) - i * capacity).alias("size")))
    return sized.select(F.col(key).alias("key"), F.explode(pieces).alias("p")).select("key", "p.*")


def _pack(rows: DataFrame, shards: int, capacity: int, offset: int, kind: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField("key", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("container", T.LongType()), T.StructField("used", T.IntegerType())])

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "mark", "piece"], kind="stable")
        number = pd.Series(best_two_fit(group["size"].tolist(), capacity), index=group.index)
        used = group["size"].groupby(number).transform("sum")
        return group.assign(container=offset + group["shard"].astype("int64") * (1 << 24) + number, used=used.astype("int32"))[schema.names]

    marked = rows.withColumn("mark", F.xxhash64("key", "piece")).withColumn("shard", F.pmod(F.col("mark"), F.lit(shards)))
    return marked.groupBy("shard").applyInPandas(pack, schema)


def assign(sized: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece, start, size, container) of every item; the sizes in a container add up to ``capacity`` at most.

    Items above the capacity are cut into full pieces and a rest; no other item is cut. Items of size 0 or null are
    assigned as well and take no room. Keys may repeat or be null: every row is an item. An empty table gives no rows.
    """
    kind = sized.schema[key].dataType
    rows = materialize(items(sized.withColumn(size, F.coalesce(F.col(size), F.lit(0)).cast("int")), key, size, capacity), "items")
    open_ = rows.filter(F.col("size") < capacity)
    full = rows.filter(F.col("size") == capacity).select("key", "piece", "start", "size", (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("container"))
    shards = max(1, round(open_.count() / SHARD_ITEMS))
    first = materialize(_pack(open_, shards, capacity, 0, kind), "packed")
    out = ["key", "piece", "start", "size", "container"]
    if shards == 1:
        done = first.select(out).unionByName(full)
    else:
        loose = F.col("used") < (1 - LOOSE) * capacity
        again = first.filter(loose).drop("container", "used")
        left = again.count()
        second = _pack(again, max(1, round(left / SHARD_ITEMS)), capacity, 1 << 61, kind)
        done = first.filter(~loose).select(out).unionByName(second.select(out)).unionByName(full)
    return done.withColumnRenamed("key", key)


def fill(assigned: DataFrame, size: str = "size", container: str = "container") -> DataFrame:
    """(containers, items, used) over an assignment."""
    each = assigned.groupBy(container).agg(F.sum(size).alias("_u"), F.count(F.lit(1)).alias("_n"))
    return each.agg(F.count(F.lit(1)).alias("containers"), F.sum("_n").alias("items"), F.sum("_u").alias("used"))
