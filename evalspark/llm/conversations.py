"""Repair of conversations by iterative-deepening A*.

Rows of a conversation are kept (cost 0), given another role (1), deleted (2) or preceded by a new row without text (5), so that the
initials of the roles read ``(s?(ua)+)?``.  Blank rows and repeats must be deleted; a truncated row that stays costs 5 more.  The answer is the
cheapest sequence of edits, of several the least in ASCII order of the edits' initials D, I, K, R.

The search (``search``) goes depth first through (row, state of the pattern) in ASCII order of edits, under a bound on cost that rises to the least
cost that broke it.  A table keeps for each state that failed how much its rest costs at least, so it is entered again only with more to spend.
The rest costs at least what its faults cost, whatever the roles.  The first path that is accepted is the answer: a cheaper one
would have been found under a lower bound, and an equal one that is less in ASCII order before.

A conversation may be of any length.  Its distinct rows are numbered, and ``SEGMENT`` of them at a time are a text of one code per
row, which is all the search sees; texts of rows stay where they are until the edits are known.  Longer conversations are cut into
segments: a segment's least costs from each state to each state (found by the same search) are multiplied from the right, which gives what
every state costs from there to the end; with that each segment is searched alone, from all four states, and a scan from the left tells in
which of them it is entered.  Both scans are trees of ``FAN`` nodes, so no task gets a whole conversation.  Exactly equal rows of one
turn are one row with a number of copies, since all but the first are repeats.

Cases: null in any column counts as one space, but for order (null turns first) and for ``gaps`` (null turns do not count); an empty role or text is
itself; rows of one turn go in the order of their digests; a null ``conv_id`` is a conversation; repeated rows are faults, as are
their repeats in other turns; an empty table gives an empty table; other columns are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.operators.order import join_groups, number_within
from evalspark.session import materialise

SEGMENT, FAN = 128, 1024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of the pattern: nothing yet, after s, after u, after a.  What may come next, and the state it leads to.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FIXED = (("u", 2), ("u", 2), ("a", 3), ("u", 2))  # what a row must become that is given its role here
ENDS = (0, 3)
NEVER = 1 << 40

# Codes of rows: "-" must go; else the role's initial, or "o" for one that fits nowhere, in capitals when truncated.


def search(codes: str, entry: int, exits: list[int] | None) -> tuple[int, str, str, int]:
    """Cost, edits, roles of the edits and state at the end, of the cheapest repair from state ``entry``.

    ``exits``: what each state costs from the last row on; None if the conversation ends there, where rows may still be inserted.
    Roles: of each edit the initial of the row that is kept, in capitals where it is new, ``-`` where it is deleted.  A cost of
    ``NEVER`` or more means that there is no way.
    """
    n = len(codes)
    floor = [0] * (n + 1)  # what faults cost from a row on
    for i in range(n - 1, -1, -1):
        floor[i] = floor[i + 1] + (DELETE if codes[i] == "-" or codes[i].isupper() else 0)
    least: dict[tuple[int, int], int] = {}
    path: list[tuple[str, str]] = []

    def rest(i: int, state: int) -> int:
        if i == n and exits is not None:
            return exits[state]
        if i == n and state in ENDS:
            return 0
        return least.get((i, state), floor[i])

    def steps(i: int, state: int) -> Iterator[tuple[str, str, int, int, int]]:
        """Edits in ASCII order: initial, role, cost, and where they lead."""
        code = codes[i] if i < n else None
        role, after = FIXED[state]
        if code is not None:
            yield "D", "-", DELETE, i + 1, state
        yield "I", role.upper(), INSERT, i, after
        if code is not None and code != "-":
            late = TRUNCATED if code.isupper() else 0
            if code.lower() in NEXT[state]:
                yield "K", code.lower(), KEEP + late, i + 1, NEXT[state][code.lower()]
            yield "R", role.upper(), REROLE + late, i + 1, after

    def reach(i: int, state: int, budget: int) -> int | None:
        """The state at the end of the first path within the budget; None leaves in the table what the rest costs at least."""
        if i == n and (exits is not None or state in ENDS):
            return state
        best = NEVER
        for letter, role, cost, j, after in steps(i, state):
            if cost + rest(j, after) <= budget:
                path.append((letter, role))
                end = reach(j, after, budget - cost)
                if end is not None:
                    return end
                path.pop()
            best = min(best, cost + rest(j, after))
        least[i, state] = max(best, rest(i, state))
        return None

    # Deleting all rows and inserting three leads to every end that can be reached at all.
    limit = DELETE * n + 3 * INSERT + max([0, *(x for x in exits or () if x < NEVER)])
    while (bound := rest(0, entry)) <= limit:
        end = reach(0, entry, bound)
        if end is not None:
            return bound, "".join(p[0] for p in path), "".join(p[1] for p in path), end
    return NEVER, "", "", entry


def crossing(codes: str, last: bool) -> list[int]:
    """Least costs from each of the four states (rows) to each (columns); to the end counts as state 0."""
    if last:
        return [x for entry in range(4) for x in (search(codes, entry, None)[0], NEVER, NEVER, NEVER)]
    only = [[0 if x == end else NEVER for x in range(4)] for end in range(4)]
    # Nothing leads back to the first two states, so staying there is deleting all; all lead to the others.
    stay = DELETE * len(codes)
    back = [[stay, search(codes, 0, only[1])[0]], [NEVER, stay], [NEVER, NEVER], [NEVER, NEVER]]
    return [back[entry][end] if end < 2 else search(codes, entry, only[end])[0] for entry in range(4) for end in range(4)]


def _least_sums(left: list[int], right: list[int]) -> list[int]:
    a, b = np.array(left).reshape(4, 4), np.array(right).reshape(4, 4)
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), NEVER).ravel().tolist()


def _chained(left: list[int], right: list[int]) -> list[int]:
    return [right[x] for x in left]


def _scan(nodes: DataFrame, combine: Callable[[list, list], list], unit: list[int], backward: bool, levels: int) -> DataFrame:
    """``conv_id, segment, outer``: all values before a node (behind it, if ``backward``), combined in order.

    ``nodes``: ``conv_id, segment, value``.  Values of ``FAN`` neighbours are combined to one node of the level above, scanned there, and what comes
    from outside is carried back down.
    """
    schema = "conv_id {0}, segment long, outer array<long>".format(dict(nodes.dtypes)["conv_id"])

    def walk(rows: pd.DataFrame, outer: list[int]) -> Iterator[tuple[int, list[int]]]:
        for number, value in rows.sort_values("segment", ascending=not backward)[["segment", "value"]].itertuples(index=False):
            yield number, outer
            outer = combine(list(value), outer) if backward else combine(outer, list(value))
        yield -1, outer

    def frame(key: tuple, name: str, found: list[tuple[int, list[int]]]) -> pd.DataFrame:
        conversation = None if pd.isna(key[0]) else key[0]
        return pd.DataFrame({"conv_id": pd.Series([conversation] * len(found), dtype=object), "segment": [f[0] for f in found], name: [f[1] for f in found]})

    def inside(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return frame(key, "outer", list(walk(rows, list(rows["above"].iloc[0]) if "above" in rows else unit))[:-1])

    def total(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return frame(key, "value", [(key[1], [v for _, v in walk(rows, unit)][-1])])

    parent = F.floor(F.col("segment") / FAN).alias("parent")
    if levels > 1:
        up = nodes.withColumn("parent", parent).groupBy("conv_id", "parent").applyInPandas(total, schema.replace("outer", "value"))
        above = _scan(up, combine, unit, backward, levels - 1).select("conv_id", F.col("segment").alias("parent"), F.col("outer").alias("above"))
        nodes = join_groups(nodes.withColumn("parent", parent), above, ["conv_id", "parent"])
    else:
        nodes = nodes.withColumn("parent", parent)
    return nodes.groupBy("conv_id", "parent").applyInPandas(inside, schema)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def _digest() -> Column:
    role = _text("role")
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, _text("text")), 256)).alias("digest")


def distinct_rows(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, digest, copies, fault, initial``: equal rows of a turn once, numbered as ``pos`` in their conversation of ``n`` rows.

    ``fault``: blank, duplicate, truncated or none, of the first of the copies; ``code``: what the search sees of it.
    """
    said = F.rtrim(_text("text"), F.lit(" \t\n\v\f\r"))
    own = rows.select(
        "conv_id", "turn", _digest(),
        F.substring(_text("role"), 1, 1).alias("initial"),
        F.when(said == "", "blank").when(~F.substring(said, -1, 1).isin(".", "!", "?"), "truncated").otherwise("").alias("fault"),
        F.col("copies"),
    )
    once = own.groupBy("conv_id", "turn", "digest", "initial", "fault").agg(F.sum("copies").alias("copies"))
    first = once.groupBy("conv_id", "digest").agg(F.min(F.struct("turn")).alias("first"))
    known = join_groups(once, first, ["conv_id", "digest"])
    again = ~F.col("first.turn").eqNullSafe(F.col("turn"))
    named = known.withColumn("fault", F.when((F.col("fault") != "blank") & again, "duplicate").otherwise(F.col("fault"))).drop("first")
    # Turns, and within a turn the first bits of the digest, as one number: so that also the rows of one turn are cut into blocks.
    low = F.lit(rows.agg(F.min("turn")).first()[0] or 0).cast("decimal(38,0)")
    turn = F.coalesce(F.col("turn").cast("decimal(38,0)") - low + 1, F.lit(0).cast("decimal(38,0)"))
    bits = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("decimal(10,0)")
    named = named.withColumn("__order", (turn.cast("decimal(25,0)") * F.lit(1 << 32).cast("decimal(10,0)") + bits).cast("decimal(38,0)"))
    numbered = number_within(named, ["conv_id"], "__order", "pos", ties=["digest"], total="n").drop("__order")
    code = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(code)).otherwise(code)
    return numbered.withColumn("code", code)


def _segments(numbered: DataFrame) -> DataFrame:
    """``conv_id, segment, last, codes, rows``: the rows of each segment in order."""
    inside = F.array_sort(F.collect_list(F.struct("pos", "code", "turn", "digest", "copies", "initial", "fault")))
    segment = F.floor(F.col("pos") / SEGMENT).alias("segment")
    grouped = numbered.groupBy("conv_id", segment, (segment == F.floor((F.col("n") - 1) / SEGMENT)).alias("last")).agg(inside.alias("rows"))
    return grouped.withColumn("codes", F.array_join("rows.code", ""))


def _searched(codes: Column | str, entry: Column | str, exits: Column | str) -> Column:
    @F.arrow_udf("struct<cost:long,edits:string,roles:string,end:int>")
    def searched(codes: pa.Array, entry: pa.Array, exits: pa.Array) -> pa.Array:
        found = [search(*row) for row in zip(codes.to_pylist(), entry.to_pylist(), exits.to_pylist(), strict=True)]
        columns = list(zip(*found, strict=True)) if found else [()] * 4
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int32())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["cost", "edits", "roles", "end"])

    return searched(codes, entry, exits)


def _crossed(codes: Column | str, last: Column | str) -> Column:
    @F.arrow_udf("array<bigint>")
    def crossed(codes: pa.Array, last: pa.Array) -> pa.Array:
        return pa.array([crossing(c, x) for c, x in zip(codes.to_pylist(), last.to_pylist(), strict=True)], pa.list_(pa.int64()))

    return crossed(codes, last)


def edits(numbered: DataFrame) -> DataFrame:
    """Each segment with ``found``: the edits of its rows in the cheapest repair of the whole conversation."""
    segments = materialise(_segments(numbered), "segments")
    most = segments.agg(F.max("segment")).first()[0] or 0
    none = F.lit(None).cast("array<bigint>")
    alone = segments.filter("last and segment = 0").withColumn("found", _searched("codes", F.lit(0), none))
    if not most:
        return alone
    many = segments.filter("not last or segment > 0")
    levels = 1
    while FAN ** levels <= most:
        levels += 1
    crossings = many.select("conv_id", "segment", _crossed("codes", "last").alias("value"))
    unit = [0 if a == b else NEVER for a in range(4) for b in range(4)]
    behind = _scan(materialise(crossings, "crossings"), _least_sums, unit, True, levels)
    # Behind the segment everything leads to the end, which counts as state 0.
    exits = join_groups(many, behind, ["conv_id", "segment"])
    exits = exits.withColumn("exits", F.when(F.col("last"), none).otherwise(F.transform(F.array(*[F.lit(4 * i) for i in range(4)]), lambda i: F.get("outer", i))))
    tried = materialise(
        exits.withColumn("entry", F.explode(F.array(*map(F.lit, range(4))))).withColumn("found", _searched("codes", "entry", "exits")).drop("outer", "exits"),
        "tried",
    )
    ends = F.transform(F.array_sort(F.collect_list(F.struct("entry", "found.end"))), lambda x: x["end"].cast("bigint"))
    before = _scan(tried.groupBy("conv_id", "segment").agg(ends.alias("value")), _chained, [0, 1, 2, 3], False, levels)
    entered = before.select("conv_id", "segment", F.get("outer", F.lit(0)).alias("entered"))
    chosen = join_groups(tried, entered, ["conv_id", "segment"]).filter("entry = entered").drop("entry", "entered")
    return alone.unionByName(chosen)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repaired rows of all conversations, and a report on each conversation.

    ``rows``: ``conv_id, turn, role, text`` and ``copies``, a whole number of 1 or more.  Repaired rows: ``conv_id, pos, step, turn, role, text, edit``,
    in the order of ``pos`` and ``step``.  Report: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``.
    """
    numbered = materialise(distinct_rows(rows), "numbered")
    segments = materialise(edits(numbered), "edits")
    letters, roles = F.col("found.edits"), F.col("found.roles")
    # The rows of a segment are met in order by its edits but inserts.
    step = F.struct(F.col("at").alias("step"), F.substring(letters, F.col("at"), F.lit(1)).alias("edit"), F.substring(roles, F.col("at"), F.lit(1)).alias("sign"))
    each = segments.filter(F.length(letters) > 0).select("conv_id", "segment", "rows", letters.alias("letters"), F.explode(F.sequence(F.lit(1), F.length(letters))).alias("at"), "found")
    each = each.select("conv_id", "segment", step.alias("s"), F.get("rows", F.length(F.translate(F.substring("letters", F.lit(1), F.col("at") - 1), "I", ""))).alias("row"))
    kept = each.filter("s.edit <> 'D'").select(
        "conv_id", "segment", F.col("s.step").alias("step"), F.col("s.edit").alias("edit"),
        F.when(F.col("s.sign") == "U", "user").when(F.col("s.sign") == "A", "assistant").alias("new_role"),
        F.when(F.col("s.edit") != "I", F.col("row.turn")).alias("turn"), F.when(F.col("s.edit") != "I", F.col("row.digest")).alias("digest"),
        (F.col("segment") * SEGMENT).alias("pos"),
    )
    texts = rows.select("conv_id", "turn", _digest(), _text("role").alias("role"), _text("text").alias("text")).dropDuplicates(["conv_id", "turn", "digest"])
    old = join_groups(kept.filter("edit <> 'I'"), texts, ["conv_id", "turn", "digest"], "left")
    columns = ["conv_id", "pos", "step", "turn", F.coalesce("new_role", "role").alias("role"), "text", "edit"]
    new = kept.filter("edit = 'I'").withColumns({"role": F.lit(None).cast("string"), "text": F.lit("")})
    repaired = old.select(*columns).unionByName(new.select(*columns))
    return repaired, _report(numbered, segments)


def _report(numbered: DataFrame, segments: DataFrame) -> DataFrame:
    copies, fault = F.col("copies"), F.col("fault")
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counted = numbered.groupBy("conv_id").agg(
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"),
        F.sum(F.when(fault == "blank", copies).otherwise(0)).alias("blank"),
        F.sum(F.when(fault == "blank", 0).when(fault == "duplicate", copies).otherwise(copies - 1)).alias("duplicate"),
        F.sum((fault == "truncated").cast("long")).alias("truncated"),
        # Between copies of a row no pair of roles is legal.
        F.sum(copies - 1).alias("among"),
    )
    initials = F.col("rows.initial")
    follow = Window.partitionBy("conv_id").orderBy("segment")
    pairs = F.zip_with(F.slice(initials, 1, F.size(initials) - 1), F.slice(initials, 2, F.greatest(F.size(initials) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    wrong = F.size(F.filter(pairs, lambda x: ~x.isin("su", "ua", "au")))
    border = F.concat(F.lag(F.element_at(initials, -1)).over(follow), F.get(initials, F.lit(0)))
    # After each row's own edit come the deletions of its copies.
    numbers = F.sequence(F.lit(1), F.length("found.edits"))
    own = F.transform(numbers, lambda i: F.struct(
        F.substring(F.col("found.edits"), i, F.lit(1)).alias("e"), F.length(F.translate(F.substring(F.col("found.edits"), F.lit(1), i - 1), "I", "")).alias("j")))
    audit = F.array_join(F.transform(own, lambda x: F.when(x["e"] == "I", "I").otherwise(
        F.concat(x["e"], F.repeat(F.lit("D"), (F.get("rows.copies", x["j"]) - 1).cast("int"))))), "")
    extra = F.aggregate("rows.copies", F.lit(0).cast("long"), lambda s, c: s + (c - 1) * DELETE)
    parts = segments.select(
        "conv_id", "segment", F.when(F.length("found.edits") > 0, audit).otherwise("").alias("audit"), extra.alias("extra"), (F.when(F.size(initials) > 1, wrong).otherwise(0)).alias("wrong"),
        F.coalesce((~border.isin("su", "ua", "au")).cast("long"), F.lit(0)).alias("border"),
        # Costs run on to the end of the conversation, so the first segment has the cost of all.
        F.when(F.col("segment") == 0, F.col("found.cost")).otherwise(0).alias("cost"),
    )
    whole = parts.groupBy("conv_id").agg(
        F.sum(F.col("wrong") + F.col("border")).alias("illegal"), (F.sum("cost") + F.sum("extra")).alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    joined = join_groups(counted, whole, ["conv_id"])
    return joined.select("conv_id", "gaps", "blank", "duplicate", "truncated", (F.col("illegal") + F.col("among")).alias("illegal"), "cost", "audit")


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, sha256``: of each conversation's ``role:text`` lines.  A digest needs them in order; they stream through, none is held."""
    kind = repaired.select("conv_id").schema[0]

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = repaired_schema
        at, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if state is None or key != at:
                    if state is not None:
                        done.append((at, state.hexdigest()))
                    at, state = key, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_pylist([{"conv_id": k, "sha256": v} for k, v in done], schema=names)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": at, "sha256": state.hexdigest()}], schema=names)

    from pyspark.sql.pandas.types import to_arrow_type

    repaired_schema = pa.schema([("conv_id", to_arrow_type(kind.dataType)), ("sha256", pa.string())])
    lines = repaired.select("conv_id", "pos", "step", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "pos", "step")
    return lines.mapInArrow(streamed, f"conv_id {kind.dataType.simpleString()}, sha256 string")
