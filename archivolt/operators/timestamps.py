"""Mixed timestamp notations to one unambiguous form.

:func:`interpret` generates every valid reading of a value as an array: each
order of day and month, both centuries of a two-digit year, both instants of a
repeated local hour. :func:`choose_readings` picks one reading a row by Viterbi
over each source's record order: a reading costs something for each convention
it goes against, a change of format and a backward jump in time cost something
between neighbours.

The chain of a source may hold a third of all rows, so it is solved in blocks,
exactly: a block's cheapest ways from each reading of its first row to each
reading of its last are one small matrix, blocks of blocks are composed in the
same way until one matrix a source is left, and the choice is handed back down,
each block solving its own rows between two fixed ends.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from archivolt.functions import timeparse
from archivolt.functions.gazetteer import Gazetteer
from archivolt.session import bounded_rows, cut_to_table

#: Rows (or blocks) that are one task's unit.
BLOCK = 4096
#: Costs of a convention broken, a change of format and a jump back in time. A convention weighs more than all that a row's
#: two neighbours can (2 x (SWITCH + BACK)): the chain decides where conventions leave a choice and never against them.
ODD, SWITCH, BACK = 8.0, 1.0, 2.0


def zone_of_place(places: DataFrame, limit: int = 100_000):
    """A pandas UDF: written location -> IANA zone, null when it names none or several.

    ``places`` is a reference table (place_id, name, area, tz) of at most
    ``limit`` rows, checked here; it travels with the UDF.
    """
    rows = [(r[0], r[1], r[2], r[3]) for r in bounded_rows(places.select("place_id", "name", "area", "tz"), limit, "the gazetteer")]
    index: list[Gazetteer] = []

    @F.pandas_udf(T.StringType())
    def zone(written: pd.Series) -> pd.Series:
        if not index:
            index.append(Gazetteer(rows))
        return written.map(lambda s: index[0].resolve(s)[1] if isinstance(s, str) else None)

    return zone


def interpret(value: Column, zone: Column, pivot: int = 26) -> Column:
    """All valid readings of ``value``; ``zone`` is used where a time names none.

    ``odd`` counts what speaks against a reading: conventions it breaks, and
    that it is one of two instants of a repeated hour. Null, empty and
    unreadable values, impossible dates, and local times with no instant or
    without a zone give an empty array. Cheapest readings come first.
    """

    fields = [("fmt", T.StringType()), ("normal", T.StringType()), ("t", T.DoubleType()), ("odd", T.IntegerType())]

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField(*f) for f in fields])))
    def read(v: pd.Series, z: pd.Series) -> pd.Series:
        out = []
        for text, tz in zip(v, z):
            got: dict[str, dict] = {}
            for r in timeparse.every_reading(text, pivot) if isinstance(text, str) else ():
                at = timeparse.normals(r, tz if isinstance(tz, str) else None)
                for text_, t in at:
                    odd = r.odd + (len(at) > 1)
                    if text_ not in got or odd < got[text_]["odd"]:
                        got[text_] = {"fmt": r.fmt, "normal": text_, "t": t, "odd": odd}
            out.append(sorted(got.values(), key=lambda g: (g["odd"], g["t"], g["normal"])))
        return pd.Series(out, index=v.index)

    return read(value, zone)


class Chain:
    """Elements are (times and formats of the first row's readings, of the last row's, costs from each to each).

    A row is an element whose ends are the same readings.
    """

    def __init__(self, switch: float, back: float):
        self.switch, self.back = switch, back

    def step(self, t0: float, f0: int, t1: float, f1: int) -> float:
        return self.switch * (f0 != f1) + self.back * (t1 < t0)

    @staticmethod
    def row(times: list[float], fmts: list[int], costs: list[float]) -> tuple:
        inf = float("inf")
        return times, fmts, times, fmts, [[c if i == j else inf for j in range(len(costs))] for i, c in enumerate(costs)]

    def forward(self, elements: list[tuple], start: list[float]) -> list[tuple[list[float], list[tuple[int, int]]]]:
        """Per element its exits' costs from ``start`` (costs of the first element's entries), and each exit's best (exit before, entry)."""
        out = []
        for n, (ft, ff, _, _, m) in enumerate(elements):
            if n == 0:
                enter, came = start, [0] * len(ft)
            else:
                cost, (_, _, lt, lf, _) = out[-1][0], elements[n - 1]
                if len(ft) == len(lt) == 1 == len(m[0]):  # nothing to choose
                    out.append(([cost[0] + self.step(lt[0], lf[0], ft[0], ff[0]) + m[0][0]], [(0, 0)]))
                    continue
                enter, came = [], []
                for t, f in zip(ft, ff):
                    c, j = min((cost[j] + self.step(lt[j], lf[j], t, f), j) for j in range(len(lt)))
                    enter.append(c)
                    came.append(j)
            leave = [min((enter[a] + m[a][b], a) for a in range(len(ft))) for b in range(len(m[0]))]
            out.append(([c for c, _ in leave], [(came[a], a) for _, a in leave]))
        return out

    def compose(self, elements: list[tuple]) -> tuple:
        """One element for a run of them."""
        first, last = elements[0], elements[-1]
        inf, k = float("inf"), len(first[0])
        return first[0], first[1], last[2], last[3], [self.forward(elements, [0.0 if j == i else inf for j in range(k)])[-1][0] for i in range(k)]

    def solve(self, elements: list[tuple], enter: int, leave: int) -> list[tuple[int, int]]:
        """(entry, exit) of each element on the cheapest way between two fixed ends."""
        inf = float("inf")
        ways = self.forward(elements, [0.0 if j == enter else inf for j in range(len(elements[0][0]))])
        out = []
        for n in range(len(elements) - 1, -1, -1):
            before, a = ways[n][1][leave]
            out.append((a, leave))
            leave = before
        return out[::-1]

    def around(self, elements: list[tuple], before: list[float], after: list[float]) -> tuple[list[list[float]], list[list[float]]]:
        """Per element what it costs at least to come to each entry, and to go on from each exit.

        ``before`` is that of the first element's entries, ``after`` of the last one's exits.
        """
        befores, afters = [before], [after]
        for (_, _, lt, lf, m), (ft, ff, _, _, _) in zip(elements, elements[1:]):
            leave = [min(befores[-1][a] + m[a][b] for a in range(len(m))) for b in range(len(m[0]))]
            befores.append([min(c + self.step(t0, f0, t1, f1) for c, t0, f0 in zip(leave, lt, lf)) for t1, f1 in zip(ft, ff)])
        for (_, _, lt, lf, _), (ft, ff, _, _, m) in zip(elements[-2::-1], elements[:0:-1]):
            enter = [min(c + d for c, d in zip(line, afters[-1])) for line in m]
            afters.append([min(c + self.step(t0, f0, t1, f1) for c, t1, f1 in zip(enter, ft, ff)) for t0, f0 in zip(lt, lf)])
        return befores, afters[::-1]


def margin_of(before: list[float], costs: list[float], after: list[float]) -> float:
    """By how much the cheapest way through a row is cheaper than the cheapest through any other of its readings."""
    least, second = sorted(map(sum, zip(before, costs, after)))[:2]
    return second - least


def choose_readings(df: DataFrame, source: str, order: str, cands: str = "readings", odd: float = ODD, switch: float = SWITCH, back: float = BACK, block: int = BLOCK, margin: str | None = None) -> DataFrame:
    """Add ``chosen``, the reading picked for each row (null where there is none).

    With ``margin`` a column of that name says how much dearer the cheapest
    chain is that picks another reading for the row, where several of its
    readings go against nothing: 0 is a tie, which the order settles no better
    than a coin. It is null where a row has at most one such reading.

    ``cands`` is an array of (fmt, normal, t, odd) as :func:`interpret` makes
    it; ``order`` is a bigint giving each source's record order; ties are broken
    by the readings themselves, and rows alike in source, order and readings are
    one step of the chain. Rows without a reading take no part in it, nor do
    rows without an order, which take their first reading. A null source is a
    source of its own. Memory: ``block`` rows a task.
    """
    chain = Chain(switch, back)
    key = F.to_json(F.struct(F.col(source).alias("s"))).alias("__s")
    ordered = F.col(order).isNotNull()
    open_ = ordered & (F.size(cands) > 1)
    spine = df.where(ordered & (F.size(cands) >= 1)).select(
        key, F.col(order).cast("bigint").alias("__o"), F.xxhash64(cands).alias("__k"),
        F.transform(cands, lambda c: c["t"]).alias("ft"), F.transform(cands, lambda c: F.hash(c["fmt"])).alias("ff"), F.transform(cands, lambda c: c["odd"] * F.lit(odd)).alias("cost"),
    ).distinct().withColumn("__b", F.floor(F.col("__o") / block))
    # Ranks in two steps, so that a large source is no single task. Decided rows between decided rows change nothing.
    sizes = spine.groupBy("__s", "__b").agg(F.count(F.lit(1)).alias("n"))
    ahead = sizes.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("__s", "__b").orderBy("__o", "__k")
    single = lambda c: F.coalesce(F.size(c) == 1, F.lit(False))
    calm = single("ft") & single(F.lag("ft").over(inside)) & single(F.lead("ft").over(inside))
    rows = spine.withColumn("r", F.row_number().over(inside)).withColumn("calm", calm).where(~F.col("calm"))
    rows = rows.join(ahead.select("__s", "__b", "ahead"), ["__s", "__b"]).withColumn("r", F.col("r") + F.col("ahead") - 1)
    rows = cut_to_table(rows.select("__s", "__o", "__k", "r", "ft", "ff", "cost"), "chain")
    level = rows.select("__s", "r", "ft", "ff", F.col("ft").alias("lt"), F.col("ff").alias("lf"), F.array("cost").alias("m"))

    def elements(pdf: pd.DataFrame) -> list[tuple]:
        """A row's costs are one line; those of a block have one for each reading of its first row."""
        out = []
        for ft, ff, lt, lf, m in zip(pdf["ft"], pdf["ff"], pdf["lt"], pdf["lf"], pdf["m"]):
            ft, ff, m = ft.tolist(), ff.tolist(), [x.tolist() for x in m]
            out.append((ft, ff, lt.tolist(), lf.tolist(), m) if len(m) == len(ft) > 1 or len(m[0]) != len(ft) else chain.row(ft, ff, m[0]))
        return out

    def compose(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ft, ff, lt, lf, m = chain.compose(elements(pdf.sort_values("r")))
        return pd.DataFrame({"__s": [keys[0]], "r": [keys[1]], "ft": [ft], "ff": [ff], "lt": [lt], "lf": [lf], "m": [m]})

    def solve(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        es = elements(pdf)
        path = chain.solve(es, int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0]))
        out = pd.DataFrame({"__s": keys[0], "r": pdf["r"], "i": [a for a, _ in path], "j": [b for _, b in path]})
        if margin:
            # Of single rows only those are of interest of which several readings go against nothing.
            costs = [x.tolist() for x in pdf["open"]]
            if bool(pdf["single"].iloc[0]) and not any(costs):
                out["before"], out["after"], out["margin"] = None, None, None
            else:
                out["before"], out["after"] = chain.around(es, pdf["before"].iloc[0].tolist(), pdf["after"].iloc[0].tolist())
                out["margin"] = [margin_of(b, c, a) if c else None for b, c, a in zip(out["before"], costs, out["after"])]
        return out

    element = "__s string, r bigint, ft array<double>, ff array<int>, lt array<double>, lf array<int>, m array<array<double>>"
    group = F.floor(F.col("r") / block).alias("g")
    levels = [level]
    while (levels[-1].agg(F.max("r")).first()[0] or 0) > 0:
        levels.append(cut_to_table(levels[-1].groupBy("__s", group).applyInPandas(compose, element), "chain"))
    # One element a source is left: the cheapest of its ways.
    flat = F.flatten(F.transform("m", lambda row, i: F.transform(row, lambda c, j: F.struct(c.alias("c"), i.alias("i"), j.alias("j")))))
    if len(levels) == 1:
        flat = F.transform(F.col("m")[0], lambda c, i: F.struct(c.alias("c"), i.alias("i"), i.alias("j")))
    several = F.size(F.filter(F.col("m")[0], lambda c: c == 0)) > 1
    open_costs = F.when(several, F.col("m")[0]).otherwise(F.array().cast("array<double>"))
    nothing = lambda c: F.transform(c, lambda _: F.lit(0.0))
    handed = [nothing("ft").alias("before"), nothing("lt").alias("after")] if margin else []
    told = "__s string, r bigint, i int, j int" + (", before array<double>, after array<double>, margin double" if margin else "")
    picked = levels[-1].select("__s", "r", F.array_min(flat).alias("x"), *handed).select("__s", "r", "x.i", "x.j", *(["before", "after"] if margin else []))
    if margin:  # a source of one row: its costs are all there is
        alone = F.array_sort(F.col("m")[0])
        picked = picked.join(levels[-1].select("__s", "r", (F.when(several, F.get(alone, F.lit(1)) - alone[0]) if len(levels) == 1 else F.lit(None).cast("double")).alias("margin")), ["__s", "r"])
    for k in range(len(levels) - 2, -1, -1):
        below = levels[k].withColumn("g", group)
        if margin:
            below = below.withColumn("open", open_costs if k == 0 else F.array().cast("array<double>")).withColumn("single", F.lit(k == 0))
        held = below.join(picked.drop("margin").withColumnRenamed("r", "g"), ["__s", "g"])
        picked = cut_to_table(held.groupBy("__s", "g").applyInPandas(solve, told), "chain")
    picked = rows.where(F.size("ft") > 1).join(picked, ["__s", "r"]).select("__s", "__o", "__k", F.col("i").alias("__i"), *([F.col("margin").alias("__m")] if margin else []))
    plain = df.where(~F.coalesce(open_, F.lit(False))).withColumn("chosen", F.get(F.col(cands), F.lit(0)))
    if margin:  # rows without an order take their first reading, which is a tie where the next is as good
        plain = plain.withColumn(margin, F.when(F.size(F.filter(F.col(cands), lambda c: c["odd"] == 0)) > 1, F.lit(0.0)))
    undecided = df.where(open_).select("*", key, F.col(order).cast("bigint").alias("__o"), F.xxhash64(cands).alias("__k"))
    chosen = undecided.join(picked, ["__s", "__o", "__k"]).select(*df.columns, F.get(F.col(cands), F.col("__i")).alias("chosen"), *([F.col("__m").alias(margin)] if margin else []))
    return plain.unionByName(chosen)


def chosen_times(records: DataFrame, places: DataFrame, agencies: DataFrame, pivot: int = 26) -> DataFrame:
    """(id, field, value, readings, chosen, margin) of every incident_date and release_date.

    ``agencies`` (agency, code, office_tz) is a bounded reference table, checked.
    The record order of a source is the number in its ids. Rows repeated whole
    count once; a null id has no row.
    """
    offices = {r["agency"]: r["office_tz"] for r in bounded_rows(agencies.select("agency", "office_tz"), 10_000, "agencies")}
    zone = zone_of_place(places)
    lookup = F.create_map(*[F.lit(x) for kv in offices.items() for x in kv]) if offices else F.lit(None).cast("map<string,string>")
    base = records.select("id", "agency", "incident_date", "release_date", "incident_location").where(F.col("id").isNotNull())
    long = base.select(
        "id",
        F.explode(
            F.array(
                F.struct(F.lit("incident_date").alias("field"), F.col("incident_date").alias("value"), F.col("incident_location").alias("place"), F.lit(None).cast("string").alias("office")),
                F.struct(F.lit("release_date").alias("field"), F.col("release_date").alias("value"), F.lit(None).cast("string").alias("place"), lookup[F.col("agency")].alias("office")),
            )
        ).alias("x"),
    ).select("id", "x.*").where(F.col("value").isNotNull()).distinct()
    long = long.withColumn("readings", interpret(F.col("value"), F.coalesce("office", zone("place")), pivot))
    long = long.withColumn("source", F.concat_ws("|", F.regexp_extract("id", "^([^0-9]*)", 1), "field")).withColumn("ord", F.regexp_extract("id", r"([0-9]{1,18})", 1).try_cast("bigint"))
    # Written once: the readings come from Python and are used several times below.
    return choose_readings(cut_to_table(long.select("id", "field", "value", "source", "ord", "readings"), "readings"), "source", "ord", margin="margin")


def record_times(records: DataFrame, places: DataFrame, agencies: DataFrame, pivot: int = 26) -> DataFrame:
    """(id, field, normal) of every incident_date and release_date that reads within the conventions.

    Where they leave several readings (dashed dates have no convention), the
    record order decides; if it decides nothing, the value is no case. What only
    a broken convention makes readable, and local times with two instants, are
    none either, though :func:`chosen_times` has a choice for them.
    """
    settled = F.col("margin").isNull() | (F.col("margin") > 0)
    return chosen_times(records, places, agencies, pivot).where((F.col("chosen.odd") == 0) & settled).select("id", "field", F.col("chosen.normal").alias("normal"))
