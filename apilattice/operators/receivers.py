"""Types of receivers: what the expressions of samples yield, by joins with the members of an API.

Every expression of :func:`apilattice.sources.flow.extract_flow` has a root and steps: an element of a container
by its type's text, a member by (type, member).  Finished values are the roots of others in their file.

A task takes a package's members and then its files one after another, those of many packages; a package of
many rows is dealt to parts by file, each with the members.  Packages of more than ``MOST`` members go in rounds over
all tasks by joins: in a round all expressions whose root is known take their next step at once.  Both give the same rows.
What types have from their bases is told likewise: in tasks, or level by level for packages of more than ``LENT``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apilattice.functions.text import unwrap_async
from apilattice.operators.graph import cut
from apilattice.operators.tables import shuffled

CALL = ["package_id", "file", "line", "call_ord", "client", "operation"]
FLOW = ["package_id", "file", "id", "kind", "root_kind", "root", "steps", "line", "call_ord", "operation"]
#: Members of a package that a task holds at most, and the rows of a package beyond which its files are dealt to parts.
MOST, PART = 1 << 17, 1 << 16
#: Members of a package, times its bases and one, up to which a task tells what its types inherit.
LENT = 1 << 19
#: Any character of a line and the end of a text, as Java's expressions have them.
_ANY, _STOP = r"[^\n\r\x85\u2028\u2029]", r"(?!(?<=\r)\n)(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)"


def result_type(ret: Column, language: str) -> Column:
    """The type of a value that ``ret`` announces: the first result of Go, what asynchronous wrappers hold, containers kept."""
    if language == "go":
        return F.regexp_replace(F.regexp_extract(F.trim(ret), r"^\(?\s*(?:\w+\s+(?=[*\[\]A-Za-z]))?((?:map\[[^\]]*\]|[^,()])*)", 1), r"^\s*\*|\s+$", "")
    inner = unwrap_async(F.trim(ret), language)
    return F.regexp_replace(inner, r"\s*\|\s*(undefined|null)\b", "") if language == "typescript" else inner


def element_type(type_: Column) -> Column:
    """The type of a container's elements or values: of T[], []T, map[K]T, and the last argument of C<..., T>."""
    last = F.regexp_extract(type_, r"^[\w.$]+<(?:.*,)?\s*([\w.$]+(?:<.*>)?(?:\[\])*)>$", 1)
    go = F.regexp_extract(type_, r"^(?:\[\d*\]|map\[[^\]]*\]|chan )(.*)$", 1)
    array = F.regexp_extract(type_, r"^(?:readonly\s+)?\(?(.*?)\)?\[\]$", 1)
    return F.when(go != "", F.regexp_replace(go, r"^\*", "")).when(array != "", array).when(last != "", last)


def plain_type(type_: Column) -> Column:
    """A type's own name: without pointers, packages, arguments and marks of what may be missing."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(type_), r"^[*&?]+|[?!]+$|<.*$", ""), r"\s*\|\s*(undefined|null)$", "")
    return F.when(~bare.rlike(r"[\[\]]"), F.substring_index(bare, ".", -1))


def member_types(members: DataFrame, types: DataFrame, language: str) -> DataFrame:
    """(package_id, owner, step, type): what a step from a type yields; functions and types step from ``""``.

    members(package_id, owner, name, kind, ret) as :func:`apilattice.sources.index.members` gives them; of
    overloads the least result counts.  types(package_id, name).
    """
    calls = F.col("kind").isin("method", "function", "ctor", "operator")
    step = F.when(calls, F.concat("name", F.lit("()"))).otherwise(F.col("name"))
    own = members.where("ret is not null").select("package_id", plain_type(F.coalesce("owner", F.lit(""))).alias("owner"), step.alias("step"), result_type(F.col("ret"), language).alias("type"))
    named = types.select("package_id", F.lit("").alias("owner"), plain_type(F.col("name")).alias("step"), plain_type(F.col("name")).alias("type"))
    return own.union(named).where("type <> ''").groupBy("package_id", "owner", "step").agg(F.min("type").alias("type"))


def typed_calls(flow: DataFrame, members: DataFrame, bases: DataFrame | None = None) -> DataFrame:
    """CALL rows, where ``client`` is the type of the receiver; calls whose receiver stays unknown are left out.

    bases(package_id, name, base): where a type lacks a member, that of its base or of theirs counts.
    """
    members = cut((inherited(members, bases) if bases is not None else members).select("package_id", "owner", "step", "type"))
    rows = cut(flow.select(*FLOW))  # parsed once
    large = _some(members.groupBy("package_id").agg(F.count("*").alias("_n")).where(F.col("_n") > MOST).select("package_id"))
    if large is None:
        return _in_tasks(rows, members)
    of = lambda side, how: side.join(shuffled(large), "package_id", how)
    return _in_tasks(of(rows, "left_anti"), of(members, "left_anti")).union(_by_steps(cut(of(rows, "left_semi")), cut(of(members, "left_semi"))))


def _some(rows: DataFrame) -> DataFrame | None:
    """Few rows, written; None where there are none, so that the usual case writes no table."""
    return None if rows.isEmpty() else cut(rows)


def _in_tasks(rows: DataFrame, members: DataFrame) -> DataFrame:
    """CALL rows of packages whose members a task can hold."""
    parts = _some(rows.groupBy("package_id").agg(F.ceil(F.count("*") / PART).cast("int").alias("_n")).where("_n > 1"))
    if parts is None:
        rows, members = (side.withColumn("_part", F.lit(0)) for side in (rows, members))
    else:
        rows, members = (side.join(shuffled(parts), "package_id", "left").withColumn("_n", F.coalesce("_n", F.lit(1))) for side in (rows, members))
        rows, members = rows.withColumn("_part", F.expr("pmod(hash(file), _n)")), members.withColumn("_part", F.explode(F.expr("sequence(0, _n - 1)")))
    said = members.selectExpr("package_id", "_part", "false AS _own", "null AS file", "null AS id", "null AS kind", "owner AS root_kind", "step AS root", "null AS steps", "null AS line", "null AS call_ord", "type AS operation")
    said = rows.select("package_id", "_part", F.lit(True).alias("_own"), *FLOW[1:]).union(said)
    dealt = said.repartition("package_id", "_part").sortWithinPartitions("package_id", "_part", "_own", "file")
    return dealt.mapInArrow(_by_package, "package_id string, file string, line int, call_ord int, client string, operation string")


def _by_package(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CALL rows of parts that stand together: the members of each come first, then the rows of its files, file by file."""
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], CALL)
    made: list[tuple] = []
    for (package, _), part in groupby((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), itemgetter(0, 1)):
        members: dict[tuple[str, str], list[str]] = {}
        for (own, file), rows in groupby(part, itemgetter(2, 3)):
            if own:
                made += [(package, file, *call) for call in _file_calls([r[4:] for r in rows], members, package is not None and file is not None)]
                if len(made) > 50_000:
                    yield flush(made)
                    made = []
                continue
            for *_, owner, step, _, _, _, type_ in rows:
                if package is not None and step is not None:  # nulls are no names, as in a join
                    members.setdefault((owner, step), []).append(type_)
    if made:
        yield flush(made)


def _file_calls(rows: list[tuple], members: dict[tuple[str, str], list[str]], named: bool) -> list[tuple]:
    """(line, call_ord, client, operation) of a file's rows; values are the roots of others if the file is ``named``."""
    made, waiting, live = [], {}, []
    for r in rows:
        if r[2] == "value":
            waiting.setdefault(r[3], []).append(r)
        elif r[2] is not None:
            live.append((r, r[3] if r[2] == "type" else ""))
    while live:
        (id_, kind, _, _, steps, line, call_ord, operation), type_ = live.pop()
        types = [type_] if steps is not None else []
        for step in steps or ():
            if step == "[]":
                types = [e for e in map(_element, types) if e is not None]
            else:
                types = [m for owner in map(_plain, types) for m in members.get(("?" if owner is None else owner, step), ())]
        for t in filter(None, types):
            if kind == "call" and (client := _plain(t)) is not None:
                made.append((line, call_ord, client, operation))
            elif kind == "value" and named:
                live += [(r, t) for r in waiting.get(str(id_), ())]
    return made


@lru_cache(1 << 14)
def _element(type_: str | None) -> str | None:
    """:func:`element_type` of one text."""
    if type_ is None:
        return None
    if (go := re.search(rf"^(?:\[\d*\]|map\[[^\]]*\]|chan )({_ANY}*){_STOP}", type_, re.A)) and go[1]:
        return go[1].removeprefix("*")
    if (array := re.search(rf"^(?:readonly\s+)?\(?({_ANY}*?)\)?\[\]{_STOP}", type_, re.A)) and array[1]:
        return array[1]
    last = re.search(rf"^[\w.$]+<(?:{_ANY}*,)?\s*([\w.$]+(?:<{_ANY}*>)?(?:\[\])*)>{_STOP}", type_, re.A)
    return last[1] if last else None


@lru_cache(1 << 14)
def _plain(type_: str | None) -> str | None:
    """:func:`plain_type` of one text."""
    if type_ is None:
        return None
    bare = re.sub(rf"\s*\|\s*(undefined|null){_STOP}", "", re.sub(rf"^[*&?]+|[?!]+{_STOP}|<{_ANY}*{_STOP}", "", type_.strip(" "), flags=re.A), flags=re.A)
    return None if "[" in bare or "]" in bare else bare.rpartition(".")[2]


def _by_steps(rows: DataFrame, members: DataFrame) -> DataFrame:
    """CALL rows, all packages a step at a time; both sides are written tables."""
    start = F.when(F.col("root_kind") == "type", F.col("root")).otherwise("")
    live = rows.where("root_kind <> 'value'").withColumn("type", start)
    waiting = cut(rows.where("root_kind = 'value'"))
    done = None
    while True:
        here = live.where("size(steps) = 0").where("type <> ''")
        value = here.where("kind = 'value'").select("package_id", "file", F.col("id").cast("string").alias("root"), "type")
        made = here.where("kind = 'call'").select(*CALL[:4], plain_type(F.col("type")).alias("client"), "operation")
        done = made if done is None else done.union(made)
        onward = live.where("size(steps) > 0").withColumns({"_step": F.col("steps")[0], "_owner": F.coalesce(plain_type(F.col("type")), F.lit("?")), "steps": F.expr("slice(steps, 2, size(steps))")})
        into = onward.where("_step = '[]'").withColumn("type", element_type(F.col("type"))).where("type is not null")
        met = members.select("package_id", F.col("owner").alias("_owner"), F.col("step").alias("_step"), F.col("type").alias("_type"))
        through = onward.where("_step <> '[]'").join(shuffled(met), ["package_id", "_owner", "_step"]).withColumn("type", F.col("_type"))
        woken = waiting.join(shuffled(value), ["package_id", "file", "root"])
        columns = [*rows.columns, "type"]
        live = cut(into.select(*columns).union(through.select(*columns)).union(woken.select(*columns)).hint("rebalance"))
        if live.isEmpty():
            return done.where("client is not null").select(*CALL)


def inherited(members: DataFrame, bases: DataFrame, most: int = 16) -> DataFrame:
    """members with those of bases(package_id, name, base) that a type does not have itself; the nearest base counts."""
    up = bases.select("package_id", plain_type(F.col("name")).alias("owner"), plain_type(F.col("base")).alias("base")).where("base is not null and owner <> base").distinct()
    own = members.select("package_id", "owner", "step", "type", F.lit(None).cast("string").alias("base"))
    said = cut(own.union(up.select("package_id", "owner", F.lit(None), F.lit(None), "base")))
    large = _some(said.groupBy("package_id").agg((F.count_if(F.col("base").isNull()) * (1 + F.count("base"))).alias("_n")).where(F.col("_n") > LENT).select("package_id"))
    small = said if large is None else said.join(shuffled(large), "package_id", "left_anti")
    dealt = small.repartition("package_id").sortWithinPartitions("package_id")
    out = dealt.mapInArrow(lambda batches: _lent_by_package(batches, most), "package_id string, owner string, step string, type string")
    if large is None:
        return out
    rest = cut(said.join(shuffled(large), "package_id", "left_semi"))
    return out.union(_lent_by_levels(rest.where("base is null").drop("base"), rest.where("base is not null").select("package_id", "owner", "base"), most))


def _lent_by_package(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The members of packages that stand together, with those of bases."""
    flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["package_id", "owner", "step", "type"])
    made: list[tuple] = []
    for package, rows in groupby((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), itemgetter(0)):
        own, heirs = [], {}
        for _, owner, step, type_, base in rows:
            if base is None:
                own.append((owner, step, type_))
            elif package is not None:  # null is no name, as in a join
                heirs.setdefault(base, []).append(owner)
        made += [(package, *r) for r in _lent(own, heirs, most)]
        if len(made) > 50_000:
            yield flush(made)
            made = []
    if made:
        yield flush(made)


def _lent(own: list[tuple], heirs: dict[str, list[str]], most: int) -> list[tuple]:
    """(owner, step, type) of one package; of bases equally near the least type counts."""
    out, last, have = list(own), own, {r[:2] for r in own}
    for _ in range(most):
        new: dict[tuple, list] = {}
        for base, step, type_ in last:
            for owner in heirs.get(base, ()):
                if step is None or (owner, step) not in have:
                    new.setdefault((owner, step), []).append(type_)
        last = [(*key, min((x for x in types if x is not None), default=None)) for key, types in new.items()]
        if not last:
            break
        have.update(new)
        out += last
    return out


def _lent_by_levels(members: DataFrame, up: DataFrame, most: int) -> DataFrame:
    """As :func:`_lent`, all packages a level at a time; both sides are written tables."""
    out = last = cut(members.withColumn("_far", F.lit(0)))
    for far in range(1, most + 1):
        lent = last.withColumnRenamed("owner", "base").join(shuffled(up), ["package_id", "base"]).select("package_id", "owner", "step", "type", F.lit(far).alias("_far"))
        last = cut(lent.join(shuffled(out), ["package_id", "owner", "step"], "left_anti").groupBy("package_id", "owner", "step").agg(F.min("type").alias("type"), F.min("_far").alias("_far")))
        if last.isEmpty():
            break
        out = cut(out.union(last))
    return out.drop("_far")


def covered_calls(flow: DataFrame, members: DataFrame, operations: DataFrame, bases: DataFrame | None = None) -> DataFrame:
    """The typed calls that are operations(package_id, client, operation) of their receiver's type."""
    return typed_calls(flow, members, bases).join(shuffled(operations.select("package_id", "client", "operation").distinct()), ["package_id", "client", "operation"], "left_semi").select(*CALL)
