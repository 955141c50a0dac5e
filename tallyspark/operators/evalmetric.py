"""Scoring a query's result against the expected one: canonical cells, tolerant multiset matching, order, F1."""

from __future__ import annotations

import itertools
import math
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import FLOAT, strip

TOLERANCE = 0.01
#: The tolerance with what the last bits of doubles change.
NEAR = TOLERANCE + 1e-9
#: Texts without a point are numbers if they are whole ones.
WHOLE = r"^[+-]?\d+(_\d+)*$"
#: An empty result may stand as this one cell.
EMPTY = "no query results"


def canonical_cell(c: Column, kind: T.DataType) -> Column:
    """struct(n, s): numbers and numeric texts as n; booleans, dates (time cut off) and other texts, trimmed and lower, as s."""
    number, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(kind, T.BooleanType):
        text = c.cast("string")
    elif isinstance(kind, T.NumericType):
        number = F.when(~F.isnan(c.cast("double")), c.cast("double"))
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(c, "yyyy-MM-dd")
    else:
        t = strip(c.cast("string"))
        numeric = F.when(t.contains("."), t.rlike(FLOAT)).otherwise(t.rlike(WHOLE))
        number = F.when(numeric, F.replace(t, F.lit("_"), F.lit("")).try_cast("double"))
        text = F.when(~numeric, F.lower(t))
    return F.struct(number.alias("n"), text.alias("s"))


def canonical_rows(df: DataFrame) -> DataFrame:
    return df.select(F.array(*(canonical_cell(F.col(f"`{f.name}`"), f.dataType) for f in df.schema)).alias("cells"))


def plain_name(c: str) -> str:
    return c.strip().lower()


def aligned_columns(pred: list[str], gold: list[str]) -> list[str] | None:
    """The columns of ``pred`` in the gold columns' order by name, else by position; None for another number of columns."""
    p, g = [plain_name(c) for c in pred], [plain_name(c) for c in gold]
    if sorted(p) == sorted(g) and len(set(p)) == len(p):
        return [pred[p.index(c)] for c in g]
    return list(pred) if len(p) == len(g) else None


def align(pred: DataFrame, gold: DataFrame) -> DataFrame | None:
    """``pred`` with the gold columns, by name or else by position; None for another number of columns."""
    names = aligned_columns(pred.columns, gold.columns)
    return None if names is None else pred.select(*(F.col(f"`{c}`") for c in names)).toDF(*gold.columns)


def exact_matches(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(tp, fp, fn) of equal canonical rows as multisets: a full join of counts."""
    a = canonical_rows(pred).groupBy("cells").agg(F.count("*").alias("a"))
    b = canonical_rows(gold).groupBy("cells").agg(F.count("*").alias("b"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = a.join(b, "cells", "full").select(zero("a").alias("a"), zero("b").alias("b"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return both.agg(n(F.least("a", "b")).alias("tp"), n(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("fp"), n(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("fn"))


def tolerant_matches(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(tp, fp, fn) where numbers may differ by 0.01: a maximum matching.

    Rows with equal texts are split along their first number into runs without a gap over the tolerance; no pair crosses
    two runs. A run that lies within the tolerance in every number matches all it can, two rows that don't lie so match only
    their own copies, and a run of one side matches nothing: those are plain counts. Other runs are split along the next
    numbers too, and matched row by row (``match_sorted``).
    """
    rows = canonical_rows(pred).withColumn("side", F.lit(0)).unionAll(canonical_rows(gold).withColumn("side", F.lit(1)))
    fixed = (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    width = max(1, sum(not (isinstance(p.dataType, fixed) and isinstance(g.dataType, fixed)) for p, g in zip(pred.schema, gold.schema, strict=True)))
    # a text with its length, n for a number, - for a null: no two rows of other texts or other places of numbers share a key
    mark = F.transform("cells", lambda x: F.when(x["s"].isNotNull(), F.concat(F.length(x["s"]).cast("string"), F.lit(":"), x["s"])).when(x["n"].isNotNull(), "n").otherwise("-"))
    numbers = F.filter(F.transform("cells", lambda x: x["n"]), lambda x: x.isNotNull())
    xs = [f"x{i}" for i in range(width)]
    rows = rows.select(F.array_join(mark, "").alias("key"), numbers.alias("n"), "side").select("key", *(F.get("n", F.lit(i)).alias(x) for i, x in enumerate(xs)), "side")
    rows = rows.groupBy("key", *xs).agg(F.count(F.when(F.col("side") == 0, 1)).alias("a"), F.count(F.when(F.col("side") == 1, 1)).alias("b"))

    def split(rows: DataFrame, by: list[str], x: str, run: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(x)
        before = F.lag(x).over(w)
        gap = F.coalesce((F.col(x) != before) & (F.col(x) - before > NEAR), F.lit(False))
        return rows.withColumn("gap", gap).withColumn(run, F.sum(F.col("gap").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))

    runs = split(rows, ["key"], xs[0], "run0")
    run = Window.partitionBy("key", "run0")
    close = F.lit(True)
    for x in xs:
        most, least = F.max(x).over(run), F.min(x).over(run)
        close &= F.coalesce((most == least) | (most - least <= NEAR), F.lit(True))
    one, all_ = F.count("*").over(run), F.least(F.sum("a").over(run), F.sum("b").over(run))
    # how a run is counted: each row's own copies, all at once, or row by row
    runs = runs.withColumns({"all": all_, "way": F.when((one == 1) | (all_ == 0), "own").when(close, "all").when(one == 2, "own").otherwise("rows")})
    counted = runs.where("way <> 'rows'").groupBy("key", "run0").agg(F.first("way").alias("way"), F.first("all").alias("all"), F.sum(F.least("a", "b")).alias("own"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    plain = counted.select(F.when(F.col("way") == "all", F.col("all")).otherwise(F.col("own")).alias("tp"), "a", "b")
    hard, by = runs.where("way = 'rows'").drop("all", "way"), ["key", "run0"]
    for i, x in enumerate(xs[1:], 1):
        hard = split(hard, by, x, f"run{i}")
        by = [*by, f"run{i}"]
    hard = hard.select(F.to_json(F.struct(*by)).alias("mark"), *xs, "a", "b").repartition("mark").sortWithinPartitions("mark", *xs).mapInPandas(match_sorted, "tp long, a long, b long")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return plain.unionAll(hard).agg(n("tp").alias("tp"), n(F.col("a") - F.col("tp")).alias("fp"), n(F.col("b") - F.col("tp")).alias("fn"))


def match_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Run after run (mark, x0..., a, b), each sorted. Runs of one number need only the rows within the tolerance; else one run is held."""
    mark, line, held, n = None, None, [], [0, 0, 0]

    def done() -> None:
        if held:
            n[0] += flow_of(*map(list, zip(*held, strict=True)))

    for p in batches:
        xs = [c for c in p.columns if c[0] == "x"]
        for m, a, b, *x in p[["mark", "a", "b", *xs]].itertuples(index=False):
            x = [v for v in x if v == v and v is not None]
            if m != mark:
                done()
                mark, held, line = m, [], Line() if len(x) == 1 else None
            n[1] += a
            n[2] += b
            if line:
                n[0] += line.add(x[0], a, b)
            else:
                held.append((x, a, b))
    done()
    yield pd.DataFrame([n], columns=["tp", "a", "b"])


class Line:
    """A maximum matching along one number, rows in its order: each takes the least ones of the other side that are still in reach."""

    def __init__(self) -> None:
        self.open: deque[list] = deque()  # (number, side, count); all of one side

    def add(self, x: float, a: int, b: int) -> int:
        total = 0
        while self.open and not abs(x - self.open[0][0]) <= NEAR:
            self.open.popleft()
        for side, left in ((0, a), (1, b)):
            while left and self.open and self.open[0][1] != side:
                f = min(left, self.open[0][2])
                total, left = total + f, left - f
                self.open[0][2] -= f
                if not self.open[0][2]:
                    self.open.popleft()
            if left:
                self.open.append([x, side, left])
        return total


def matching(p: pd.DataFrame) -> int:
    """The greatest number of pairs within the tolerance, for rows with counts a and b."""
    return flow_of([[None if x is None or x != x else float(x) for x in v] for v in p["n"]], [int(x) for x in p["a"]], [int(x) for x in p["b"]])


def flow_of(n: list[list[float | None]], a: list[int], b: list[int]) -> int:
    """A flow by shortest augmenting paths, many in a round. Only rows in neighbouring cells along two of the numbers are compared."""
    near = lambda x, y: all((u is None) == (v is None) and (u is None or u == v or abs(u - v) <= NEAR) for u, v in zip(x, y, strict=True))
    right = [j for j in range(len(n)) if b[j]]
    cell = lambda u: math.floor(u / (2 * NEAR)) if u is not None and math.isfinite(u) else u
    beside = lambda c: (c - 1, c, c + 1) if isinstance(c, int) else (c,)
    places = range(min(map(len, n), default=0))
    used = sorted(places, key=lambda d: -len({cell(x[d]) for x in n}))[:2]  # the two numbers that part the rows most
    cells: dict[tuple, list[int]] = {}
    for j in right:
        cells.setdefault(tuple(cell(n[j][d]) for d in used), []).append(j)
    to = {}
    for i in range(len(n)):
        if a[i]:
            around = itertools.product(*(beside(cell(n[i][d])) for d in used))
            to[i] = [j for c in around for j in cells.get(c, ()) if near(n[i], n[j])]
    flow: dict[int, dict[int, int]] = {j: {} for j in right}  # by right row: what each left row gives it
    free_a, free_b, total = list(a), list(b), 0

    def give(i: int, j: int, f: int) -> None:
        flow[j][i] = flow[j].get(i, 0) + f
        if not flow[j][i]:
            del flow[j][i]

    for i in to:  # equal rows first, then any
        for j in ([i] if i in to[i] else []) + to[i]:
            if f := min(free_a[i], free_b[j]):
                give(i, j, f)
                free_a[i], free_b[j], total = free_a[i] - f, free_b[j] - f, total + f
    while True:
        level = {i: 0 for i in to if free_a[i]}
        layer, depth, ends = list(level), 0, False
        seen: dict[int, int] = {}  # right rows by depth
        while layer and not ends:
            found = []
            for i in layer:
                for j in to[i]:
                    if j not in seen:
                        seen[j] = depth
                        found.append(j)
                        ends = ends or bool(free_b[j])
            depth += 1
            layer = []
            for j in found:
                for k in flow[j]:
                    if k not in level:
                        level[k] = depth
                        layer.append(k)
        if not ends:
            return total
        # paths of the layers, left and right rows by turns; edges that led nowhere aren't tried again
        next_right, next_left, back = dict.fromkeys(level, 0), dict.fromkeys(seen, 0), {j: list(flow[j]) for j in seen}
        for start in [i for i, d in level.items() if d == 0]:
            while free_a[start]:
                path, end = [start], None
                while path:
                    x = path[-1]
                    if len(path) % 2:
                        while next_right[x] < len(to[x]) and seen.get(to[x][next_right[x]]) != level[x]:
                            next_right[x] += 1
                        if next_right[x] == len(to[x]):
                            path.pop()
                            if path:
                                next_left[path[-1]] += 1
                            continue
                        path.append(to[x][next_right[x]])
                        if free_b[path[-1]]:
                            end = path[-1]
                            break
                    else:
                        while next_left[x] < len(back[x]) and not (flow[x].get(back[x][next_left[x]]) and level.get(back[x][next_left[x]]) == seen[x] + 1):
                            next_left[x] += 1
                        if next_left[x] < len(back[x]):
                            path.append(back[x][next_left[x]])
                        else:
                            path.pop()
                            next_right[path[-1]] += 1
                if end is None:
                    break
                room = min([free_a[start], free_b[end], *(flow[path[x]][path[x + 1]] for x in range(1, len(path) - 1, 2))])
                for x in range(0, len(path), 2):
                    give(path[x], path[x + 1], room)
                    if x:
                        give(path[x], path[x - 1], -room)
                free_a[start], free_b[end], total = free_a[start] - room, free_b[end] - room, total + room


def scores(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, F1 and Jaccard; all are 1 where nothing was expected and nothing came."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    none = (tp + fp + fn) == 0
    ratio = lambda a, b: F.when(none, 1.0).otherwise(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)))
    r = {"set_precision": ratio(tp, tp + fp), "set_recall": ratio(tp, tp + fn), "set_f1": ratio(2 * tp, 2 * tp + fp + fn), "set_jaccard": ratio(tp, tp + fp + fn)}
    return counts.select("*", *(F.round(c, 6).alias(k) for k, c in r.items()))


def order_key(sql: str) -> str | None:
    """The first term of the last ORDER BY, without direction, qualifier or function, in lower case; None if that is no name."""
    text = re.sub(r"/\*.*?\*/", " ", re.sub(r"--[^\n]*", " ", sql), flags=re.S)
    if not (found := list(re.finditer(r"\border\s+by\b", text, re.I))):
        return None
    depth, term = 0, ""
    for ch in text[found[-1].end() :]:
        depth += (ch == "(") - (ch == ")")
        if depth < 0 or depth == 0 and ch in ",;":
            break
        term += ch
    term = re.sub(r"\b(limit|offset|fetch)\b.*$", "", term, flags=re.I | re.S)
    term = re.sub(r"\s+nulls\s+(first|last)\s*$|\s+(asc|desc)\s*$", "", re.sub(r"\s+nulls\s+(first|last)\s*$", "", term.strip(), flags=re.I), flags=re.I).strip()
    while m := re.fullmatch(r"\w+\s*\((.*)\)", term, re.S):
        term = m[1].split(",")[0].strip()
    term = term.rpartition(".")[2].strip('"` ')
    return term.lower() if re.fullmatch(r"[A-Za-z_]\w*", term) else None


def in_order(pred: DataFrame, gold: DataFrame, key: str | None, pos: str = "pos") -> bool:
    """Whether ``pred`` is sorted as ``gold`` is, ties free; both have the same columns, and ``pos`` holds the rows' places.

    The column is ``key`` where gold has it, in the direction of gold's rows; one that is constant or in no order asks for
    nothing. Else it is the first gold column without nulls that rises or falls. A null in ``pred`` fails.
    """
    names = [c for c in gold.columns if c != pos]

    def steps(df: DataFrame, columns: list[str]) -> list[tuple[bool, bool, bool]]:
        """(rises, falls, has a null) of each column."""
        cells = df.select(pos, *(canonical_cell(F.col(f"`{c}`"), df.schema[c].dataType).alias(f"v{i}") for i, c in enumerate(columns)))
        w, out = Window.orderBy(pos), []
        for i in range(len(columns)):
            v, cells = F.col(f"v{i}"), cells.withColumn(f"u{i}", F.lag(f"v{i}").over(w))
            out += [F.coalesce(F.bool_and(v >= F.col(f"u{i}")), F.lit(True)), F.coalesce(F.bool_and(v <= F.col(f"u{i}")), F.lit(True)), F.coalesce(F.bool_or(v["n"].isNull() & v["s"].isNull()), F.lit(False))]
        row = cells.agg(*(x.alias(f"x{i}") for i, x in enumerate(out))).first()
        return [tuple(row[3 * i : 3 * i + 3]) for i in range(len(columns))]

    chosen = next((c for c in names if key is not None and plain_name(c) == key), None)
    columns = [chosen] if chosen else names
    found = [(c, up) for c, (up, down, hole) in zip(columns, steps(gold, columns), strict=True) if up != down and (chosen or not hole)]
    if not found:
        return True
    rises, falls, hole = steps(pred, [found[0][0]])[0]
    return not hole and (rises if found[0][1] else falls)


def is_empty(df: DataFrame) -> bool:
    """No rows, or the one cell that says so."""
    some = df.limit(2).collect()
    return not some or len(some) == 1 and len(some[0]) == 1 and EMPTY in str(some[0][0]).lower()


def compare(pred: DataFrame, gold: DataFrame, sql: str = "", order_matters: bool = False, pos: str | None = None) -> dict:
    """tp, fp, fn, the four scores, order_satisfied, execution_accuracy and exact_match of one question.

    Row places are read from ``pos`` (left out of the comparison) where order matters.
    """
    drop = lambda d: d.drop(pos) if pos else d
    p, g = drop(pred), drop(gold)
    pe, ge = is_empty(p), is_empty(g)
    spark, ordered = gold.sparkSession, True
    names = None if pe or ge else aligned_columns(p.columns, g.columns)
    if names is None:
        n = (0, 0 if pe else p.count(), 0 if ge else g.count())
        counts = spark.createDataFrame([n], "tp long, fp long, fn long")
        ordered = pe or ge
    else:
        counts = tolerant_matches(align(p, g), g)
        if order_matters and pos:
            place = F.col(pos) if pos in pred.columns else F.lit(0)
            ordered = in_order(pred.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(names, g.columns, strict=True)), place.alias(pos)), gold, order_key(sql), pos)
    out = scores(counts).first().asDict()
    match = out["fp"] == out["fn"] == 0
    return out | {"order_satisfied": int(ordered), "execution_accuracy": int(match and (ordered or not order_matters)), "exact_match": int(match)}


def macro(evaluations: DataFrame, questions: int) -> DataFrame:
    """Means by solution; accuracy is over all ``questions``, answered or not."""
    mean = [F.round(F.avg(c), 6).alias(c) for c in ("set_precision", "set_recall", "set_f1", "set_jaccard")]
    return evaluations.groupBy("solution").agg(*mean, F.round(F.sum("execution_accuracy") / questions, 6).alias("accuracy"), F.count("*").alias("n"))
