"""Differences between two copies of a table, field by field, with keys that may repeat.

Rows that are identical on both sides cancel by multiplicity.  What is left of a key is paired so that the fewest
fields differ in all (a minimum-cost assignment); rows without a partner are missing on the other side.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.session import col

#: Rows of a key, on either side, that are paired by a dense assignment; beyond it a flow through blocks may be cheaper.
MOST_ASSIGNED = 128

MISSING_LEFT, MISSING_RIGHT, DIFFERS = "missing_left", "missing_right", "differs"


def assign(cost: np.ndarray) -> np.ndarray:
    """The column of each row in an assignment of least total cost; there are at least as many columns as rows.

    Shortest augmenting paths with potentials, a row at a time.
    """
    n, m = cost.shape
    row_price, col_price = np.zeros(n + 1), np.zeros(m + 1)
    owner, came = np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        slack, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool)
        while owner[at]:
            used[at] = True
            row = owner[at]
            reduced = cost[row - 1] - row_price[row] - col_price[1:]
            better = ~used[1:] & (reduced < slack[1:])
            slack[1:][better], came[1:][better] = reduced[better], at
            free = np.where(used, np.inf, slack)
            free[0] = np.inf
            at, step = int(np.argmin(free)), free.min()
            row_price[owner[used]] += step
            col_price[used] -= step
            slack[~used] -= step
        while at:
            owner[at] = owner[came[at]]
            at = came[at]
    out = np.zeros(n, dtype=int)
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def _blocks(x: np.ndarray, y: np.ndarray) -> list[tuple[int, list[int], list[int]]]:
    """(fields that differ at most, rows of x, rows of y) of each set of fields and values that rows of both have.

    A block with the same rows as one of more fields is left out.
    """
    n, width = len(x), x.shape[1]
    out, seen = [], set()
    for fields in (s for size in range(width, -1, -1) for s in combinations(range(width), size)):
        groups: dict[tuple, tuple[list[int], list[int]]] = {}
        for i, values in enumerate(map(tuple, np.concatenate([x, y])[:, list(fields)].tolist())):
            groups.setdefault(values, ([], []))[i >= n].append(i if i < n else i - n)
        for a, b in groups.values():
            rows = (tuple(a), tuple(b))
            if a and b and rows not in seen:
                seen.add(rows)
                out.append((width - len(fields), a, b))
    return out


def assign_copies(x: np.ndarray, nx: Sequence[int], y: np.ndarray, ny: Sequence[int]) -> list[tuple[int, int, int]]:
    """(row of x, row of y, copies) of an assignment in which the fewest fields differ; as many as the smaller side has.

    Rows are of whole numbers, nx and ny say how often each occurs.  Copies flow from rows of x through the blocks that
    they share with rows of y, so that the network grows with the rows and not with the pairs.  Least distances and
    maximum flows at that distance alternate; no distance exceeds the number of fields.
    """
    blocks = _blocks(x, y)
    n, m = len(x), len(y)
    block_at, right_at, sink = n, n + len(blocks), n + len(blocks) + m
    ahead: list[list[tuple[int, int]]] = [[] for _ in range(sink)]
    for k, (cost, a, b) in enumerate(blocks):
        for i in a:
            ahead[i].append((block_at + k, cost))
        ahead[block_at + k] = [(right_at + j, 0) for j in b]
    back: list[dict[int, list[int]]] = [{} for _ in range(sink)]  # node: {node before it: [copies that flow, cost]}
    left, room = list(map(int, nx)), list(map(int, ny))
    todo, price = min(sum(left), sum(room)), [0] * (sink + 1)

    def arcs(u: int):
        """(next node, cost, whether it takes flow back)."""
        for v, cost in ahead[u]:
            yield v, cost, False
        for v, (_, cost) in back[u].items():
            yield v, -cost, True
        if u >= right_at and room[u - right_at]:
            yield sink, 0, False

    while todo:
        far = len(x[0]) * 4 + 4
        reach = [far] * (sink + 1)
        queue: dict[int, list[int]] = {0: [i for i in range(n) if left[i]]}
        for i in queue[0]:
            reach[i] = 0
        while queue:
            d = min(queue)
            for u in queue.pop(d):
                if reach[u] < d or u == sink:
                    continue
                for v, cost, _ in arcs(u):
                    e = d + cost + price[u] - price[v]
                    if e < reach[v]:
                        reach[v] = e
                        queue.setdefault(e, []).append(v)
        price = [p + min(r, reach[sink]) for p, r in zip(price, reach, strict=True)]
        while todo:
            level = dict.fromkeys((i for i in range(n) if left[i]), 0)
            layer = list(level)
            while layer and sink not in level:
                following = []
                for u in layer:
                    for v, cost, _ in arcs(u):
                        if v not in level and cost + price[u] == price[v]:
                            level[v] = level[u] + 1
                            following.append(v)
                layer = following
            if sink not in level:
                break
            tries: dict[int, list[tuple[int, int, bool]]] = {}
            for root in [i for i in range(n) if left[i]]:
                path: list[tuple[int, int, int, bool]] = []
                u = root
                while left[root] and todo:
                    if u == sink:
                        amount = min([left[root], room[path[-1][0] - right_at], todo] + [back[a][b][0] for a, b, _, reverse in path if reverse])
                        for a, b, cost, reverse in path[:-1]:
                            if reverse:
                                back[a][b][0] -= amount
                                if not back[a][b][0]:
                                    del back[a][b]
                            else:
                                back[b].setdefault(a, [0, cost])[0] += amount
                        room[path[-1][0] - right_at] -= amount
                        left[root] -= amount
                        todo -= amount
                        path, u = [], root
                        continue
                    if u not in tries:
                        tries[u] = [(v, c, r) for v, c, r in arcs(u) if level.get(v) == level[u] + 1 and c + price[u] == price[v]]
                    while tries[u]:
                        v, cost, reverse = tries[u][-1]
                        if (v in back[u]) if reverse else (v != sink or room[u - right_at]):
                            break
                        tries[u].pop()
                    if tries[u]:
                        path.append((u, *tries[u][-1]))
                        u = path[-1][1]
                    elif path:
                        u = path.pop()[0]
                        tries[u].pop()
                    else:
                        break
    pairs = []
    for k, (_, _, b) in enumerate(blocks):
        sent = [[i, flow] for i, (flow, _) in back[block_at + k].items()]
        for j in b:
            need = back[right_at + j].get(block_at + k, [0])[0]
            while need:
                amount = min(need, sent[-1][1])
                pairs.append((sent[-1][0], j, amount))
                need -= amount
                sent[-1][1] -= amount
                if not sent[-1][1]:
                    sent.pop()
    return pairs


def _fields(prefix: str, fields: Sequence[str]) -> list[Column]:
    return [F.col(f"{prefix}.f{i}").alias(name) for i, name in enumerate(fields)]


def _report(pairs: DataFrame, keys: int, fields: Sequence[str]) -> DataFrame:
    """Rows (k.., l, r, n) -> a row for each missing row and each differing field; l and r are structs of strings."""
    differing = F.filter(
        F.array(*[F.struct(F.lit(DIFFERS).alias("kind"), F.lit(name).alias("field_name"), F.col(f"l.f{i}").alias("left_value"), F.col(f"r.f{i}").alias("right_value")) for i, name in enumerate(fields)]),
        lambda d: ~d["left_value"].eqNullSafe(d["right_value"]),
    )

    def missing(kind: str) -> Column:
        none = F.lit(None).cast("string")
        return F.array(F.struct(F.lit(kind).alias("kind"), none.alias("field_name"), none.alias("left_value"), none.alias("right_value")))

    found = F.when(F.col("r").isNull(), missing(MISSING_RIGHT)).when(F.col("l").isNull(), missing(MISSING_LEFT)).otherwise(differing)
    return pairs.select(*[f"k{i}" for i in range(keys)], F.col("n"), F.inline(found))


def _assignment(fields: int, names: list[str], most: int):
    """Pairs the rows (side, n, f0..) of one key; returns rows (k.., l0.., r0.., has_l, has_r, n)."""

    def pair(group: pd.DataFrame) -> pd.DataFrame:
        values = [f"f{i}" for i in range(fields)]
        left, right = (group[group["side"] == s] for s in (0, 1))
        a, b = left[values].to_numpy(dtype=object), right[values].to_numpy(dtype=object)
        na, nb = left["n"].to_numpy(dtype=np.int64), right["n"].to_numpy(dtype=np.int64)
        if max(na.sum(), nb.sum()) > most and (len(a) + len(b)) << fields < na.sum() * nb.sum():
            codes = [pd.factorize(np.concatenate([a[:, i], b[:, i]]), use_na_sentinel=True)[0] for i in range(fields)]
            table = np.stack(codes, axis=1)
            pairs = assign_copies(table[: len(a)], na, table[len(a) :], nb)
        else:
            pairs = _assign_each(a, na, b, nb)
        rows, none = [], [None] * fields
        head = group.iloc[0][names].tolist()
        for i, j, n in pairs:
            rows.append([*head, *a[i], *b[j], True, True, n])
            na[i] -= n
            nb[j] -= n
        rows += [[*head, *a[i], *none, True, False, na[i]] for i in np.flatnonzero(na)]
        rows += [[*head, *none, *b[j], False, True, nb[j]] for j in np.flatnonzero(nb)]
        return pd.DataFrame(rows, columns=[*names, *[f"l{i}" for i in range(fields)], *[f"r{i}" for i in range(fields)], "has_l", "has_r", "n"], dtype=object).astype({"has_l": bool, "has_r": bool, "n": "int64"})

    return pair


def _assign_each(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> list[tuple[int, int, int]]:
    """(row of a, row of b, 1) of a dense assignment of single copies."""
    swapped = na.sum() > nb.sum()
    i, j = np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)
    x, y = (b[j], a[i]) if swapped else (a[i], b[j])
    cost = np.zeros((len(x), len(y)), dtype=np.uint16)
    for f in range(a.shape[1]):
        cost += _unequal(x[:, f], y[:, f])
    to = assign(cost) if len(x) else np.zeros(0, dtype=int)
    return [(int(i[q]), int(j[p]), 1) if swapped else (int(i[p]), int(j[q]), 1) for p, q in enumerate(to)]


def _unequal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    codes, _ = pd.factorize(np.concatenate([x, y]), use_na_sentinel=True)
    return codes[: len(x), None] != codes[None, len(x) :]


def _paired(groups: DataFrame, keys: list[str], fields: int, kinds: dict[str, T.DataType], most: int) -> DataFrame:
    """Solves the rows (keys, side, n, f..) of each key; its rows that differ are held by one worker."""
    schema = T.StructType(
        [T.StructField(k, kinds[k]) for k in keys]
        + [T.StructField(f"{s}{i}", T.StringType()) for s in "lr" for i in range(fields)]
        + [T.StructField("has_l", T.BooleanType()), T.StructField("has_r", T.BooleanType()), T.StructField("n", T.LongType())]
    )
    out = groups.groupBy(*keys).applyInPandas(_assignment(fields, keys, most), schema)

    def side(s: str) -> Column:
        return F.when(F.col(f"has_{s}"), F.struct(*[F.col(f"{s}{i}").alias(f"f{i}") for i in range(fields)])).alias(s)

    return out.select(*keys, side("l"), side("r"), "n")


def differences(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str], most: int = MOST_ASSIGNED) -> DataFrame:
    """A row for each row that one side lacks and for each field that differs.

    Columns: the keys, kind (missing_left, missing_right, differs), field_name, left_value, right_value (strings;
    null for missing rows), n (copies).  Null keys are equal to each other, and so are null values; null and a value
    differ.  Other columns are ignored, whatever their names.  Two empty tables give no rows.

    Identical rows are combined before the shuffle and hashed by all their columns, so a hot key is spread.  What is
    left of a key is assigned at least cost as a whole, whatever its size: up to ``most`` unmatched copies on a side
    densely, beyond that by flows through blocks of rows that agree in some fields, if these are fewer than the pairs.
    """
    k, f = [f"k{i}" for i in range(len(keys))], [f"f{i}" for i in range(len(fields))]

    def rows(df: DataFrame, side: int) -> DataFrame:
        return df.select(*[col(c).alias(a) for c, a in zip(keys, k, strict=True)], *[col(c).cast("string").alias(a) for c, a in zip(fields, f, strict=True)], F.lit(1 - 2 * side).alias("sign"))

    both = rows(left, 0).unionByName(rows(right, 1))
    kinds = {a: both.schema[a].dataType for a in k}
    net = both.groupBy(*k, *f).agg(F.sum("sign").alias("net")).where(F.col("net") != 0)
    rest = net.select(*k, F.struct(*f).alias("row"), F.when(F.col("net") > 0, 0).otherwise(1).alias("side"), F.abs("net").alias("n"))

    def of(side: int, what: Column) -> Column:
        return F.when(F.col("side") == side, what)

    totals = rest.groupBy(*k).agg(
        F.coalesce(F.sum(of(0, F.col("n"))), F.lit(0)).alias("nl"),
        F.coalesce(F.sum(of(1, F.col("n"))), F.lit(0)).alias("nr"),
        F.max(of(0, F.col("row"))).alias("l"),
        F.max(of(1, F.col("row"))).alias("r"),
    )
    simple = (F.col("nl") <= 1) & (F.col("nr") <= 1)
    direct = totals.where(simple).select(*k, "l", "r", F.lit(1).cast("bigint").alias("n"))
    crowded = totals.where(~simple).select(*[F.col(x).alias(f"t_{x}") for x in k], "nl", "nr")
    same_key = None
    for x in k:
        here = F.col(x).eqNullSafe(F.col(f"t_{x}"))
        same_key = here if same_key is None else same_key & here
    held = rest.join(crowded, same_key).select(*k, "row", "side", "n", "nl", "nr")
    lonely = held.where((F.col("nl") == 0) | (F.col("nr") == 0))
    alone = lonely.select(*k, of(0, F.col("row")).alias("l"), of(1, F.col("row")).alias("r"), "n")
    matched = held.where((F.col("nl") > 0) & (F.col("nr") > 0))
    flat = [*k, "side", "n", *[F.col(f"row.{x}").alias(x) for x in f]]
    solved = direct.unionByName(alone).unionByName(_paired(matched.select(*flat), k, len(f), kinds, most))
    report = _report(solved, len(k), fields)
    return report.select(*[F.col(a).alias(c) for a, c in zip(k, keys, strict=True)], "kind", "field_name", "left_value", "right_value", "n")


# Checksums of one set of files in two formats

SUMS = ["sum_pos", "sum_flags", "sum_name", "sum_seq", "sum_cigar", "sum_qual"]
_TWO_64 = "18446744073709551616"


def unblanked(text: Column) -> Column:
    """Without the white space around it."""
    return F.regexp_replace(text, r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+$", "")


def unsigned_text(text: Column) -> Column:
    """An unsigned 64-bit number in decimal, or hexadecimal after 0x, as decimal(20,0); null if it is neither."""
    plain = unblanked(text)
    number = F.when(plain.rlike("^[0-9]{1,20}$"), plain).when(plain.rlike("^0[xX][0-9a-fA-F]{1,16}$"), F.conv(F.substring(plain, 3, 16), 16, 10))
    value = F.try_to_number(number, F.lit("9" * 20)).cast("decimal(20,0)")
    return F.when(value < F.lit(_TWO_64).cast("decimal(20,0)"), value)


def unsigned_bits(number: Column) -> Column:
    """A two's complement bigint as the unsigned number of the same bits, decimal(20,0)."""
    wide = number.cast("decimal(20,0)")
    return F.when(wide < 0, (wide + F.lit(_TWO_64).cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(wide)


def checksum_differences(bam: DataFrame, pam: DataFrame) -> DataFrame:
    """(file_id, ref_name, field_name, left_value, right_value) of two checksum tables: of the latest rows, what
    is missing on a side (missing_in_bam, missing_in_pam) and which fields differ.  Unreadable numbers count as
    null."""
    from strandline.session import latest_rows

    def latest(df: DataFrame, number) -> DataFrame:
        parsed = df.select("file_id", unblanked(F.col("ref_name")).alias("ref_name"), "n_recs", *[number(F.col(c)).alias(c) for c in SUMS], "computed_at")
        return latest_rows(parsed, ["file_id", "ref_name"], "computed_at")

    found = differences(latest(bam, unsigned_text), latest(pam, unsigned_bits), ["file_id", "ref_name"], ["n_recs", *SUMS])
    name = F.when(F.col("kind") == MISSING_LEFT, "missing_in_bam").when(F.col("kind") == MISSING_RIGHT, "missing_in_pam").otherwise(F.col("field_name"))
    return found.select("file_id", "ref_name", name.alias("field_name"), "left_value", "right_value")
