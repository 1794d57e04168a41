"""Names across files: which declaration a name in a file means, through imports, re-exports and ``export *``.

A fixpoint.  A fact (package_id, file, space, name, decl_file, decl_name) says that a name
means a declaration: in space ``l`` inside the file, in space ``e`` for those who import it; a
declaration ``*`` is a whole module.  Declarations are the first facts; a step carries only the new
ones along the links of imports and exports.  What a file names itself hides what a star brings; a
name that two stars bring from two declarations means neither.  Cycles end since facts are finite.

Packages of at most ``LOCAL`` statements share a task, which takes one after another; larger ones, and those
that come to more than ``MOST`` facts, go step by step over all tasks by joins.  Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apilattice.operators.graph import LOCAL, cut, reachable
from apilattice.operators.tables import shuffled

FACT = ["package_id", "file", "space", "name", "decl_file", "decl_name"]
PLACE = ["package_id", "file", "space", "name"]
#: Steps after which the facts so far are written anew, so that the plan stays short.
COMPACT = 8
#: Facts of a package that a task holds at most.
MOST = 1 << 17


def module_files(rows: DataFrame, files: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """rows with ``to``: the file or folder of the package that ``module`` means, null for other packages.

    Of a TypeScript path the first counts that is there: as written, .ts, .tsx, .d.ts, index files; .js
    stands for .ts.  modules(package_id, module_path): the path before Go's folders.
    """
    rows = cut(rows)  # parsed once
    asked = rows.where("module is not null").select("package_id", "module").distinct()
    stem = F.regexp_replace("module", r"\.[mc]?js$", "")
    ends = [".ts", ".tsx", ".mts", ".cts", ".d.ts", "/index.ts", "/index.tsx", "/index.d.ts"]
    paths = asked.select("package_id", "module", F.posexplode(F.array(F.col("module"), *(F.regexp_replace(F.concat(stem, F.lit(e)), r"^\./", "") for e in ends))).alias("rank", "rel_path"))
    here = files.select("package_id", "rel_path").union(files.select("package_id", F.regexp_replace("rel_path", r"/?[^/]*\.go$", "").alias("rel_path")).where(F.col("rel_path").isNotNull())).distinct()
    found = paths.join(shuffled(here), ["package_id", "rel_path"]).groupBy("package_id", "module").agg(F.min_by("rel_path", "rank").alias("to"))
    if modules is not None:
        inner = asked.join(shuffled(modules), "package_id").where(F.col("module").startswith(F.concat(F.lit(":"), "module_path")))
        inner = inner.withColumn("rest", F.expr("substring(module, length(module_path) + 2)")).where("rest = '' or rest like '/%'")
        found = found.union(inner.select("package_id", "module", F.expr("substring(rest, 2)").alias("to")))
    return rows.join(shuffled(found.distinct()), ["package_id", "module"], "left")


def links(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, named links, stars) of rows with ``to``; a link leads from what it needs (src_...) to what it names."""
    col = F.col
    decl = rows.where("kind = 'decl'")
    facts = decl.select("package_id", "file", F.lit("l").alias("space"), "name", col("file").alias("decl_file"), col("name").alias("decl_name"))
    whole = rows.where("target = '*' and to is not null")
    facts = facts.union(whole.select("package_id", "file", F.when(col("kind") == "import", "l").otherwise("e").alias("space"), "name", col("to").alias("decl_file"), F.lit("*").alias("decl_name"))).distinct()
    named = rows.where("kind in ('import', 'export') and target <> '*' and (module is null or to is not null)")
    space = F.when(col("kind") == "import", "l").otherwise("e")
    named = named.select("package_id", F.coalesce("to", "file").alias("src_file"), F.when(col("module").isNull(), "l").otherwise("e").alias("src_space"), col("target").alias("src_name"), "file", space.alias("space"), "name").distinct()
    stars = rows.where("kind in ('star', 'open') and to is not null").select("package_id", col("to").alias("src_file"), "file", F.when(col("kind") == "open", "l").otherwise("e").alias("space")).distinct()
    return facts, named, stars


def resolve(rows: DataFrame, language: str = "typescript") -> DataFrame:
    """FACT rows: every name that a file sees or gives out and the one declaration that it means."""
    facts, named, stars = links(cut(rows))
    if language == "go":  # a folder's files share their declarations, and other folders see them
        folder = lambda space: facts.where("decl_name <> '*'").select("package_id", F.regexp_replace("file", r"/?[^/]*$", "").alias("file"), F.lit(space).alias("space"), "name", "decl_file", "decl_name")
        facts = facts.union(folder("e")).distinct()
    null, place = F.lit(None).cast("string"), ["file", "space", "name"]
    source = [f"src_{c}" for c in place]
    said = facts.select("package_id", F.lit("fact").alias("kind"), *(F.col(c).alias(f"src_{c}") for c in place), F.col("decl_file").alias("file"), null.alias("space"), F.col("decl_name").alias("name"))
    said = said.union(named.select("package_id", F.lit("name"), *source, *place)).union(stars.select("package_id", F.lit("star"), "src_file", null, null, "file", "space", null))
    said = cut(said)
    large = cut(said.groupBy("package_id").agg(F.count("*").alias("_n")).where(F.col("_n") > LOCAL).select("package_id"))
    of = lambda packages, how: said.join(shuffled(packages), said["package_id"].eqNullSafe(packages["package_id"]), how)
    found = cut(of(large, "left_anti").repartition("package_id").sortWithinPartitions("package_id").mapInArrow(partial(_by_package, most=MOST), ", ".join(f"{c} string" for c in FACT)))
    large = cut(large.union(found.where("file is null").select("package_id")))
    found = found.where("file is not null")
    if large.isEmpty():
        return found
    rest = cut(of(large, "left_semi"))
    facts = rest.where("kind = 'fact'").select("package_id", *source, "file", "name").toDF(*FACT)
    return found.union(_by_steps(facts, rest.where("kind = 'name'").drop("kind"), rest.where("kind = 'star'").select("package_id", "src_file", "file", "space")))


def _by_package(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """FACT rows of packages that stand together; of one with more than ``most`` facts a row of nulls."""
    flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], FACT)
    made: list[tuple] = []
    for package, rows in groupby((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), itemgetter(0)):
        found = _meanings((r[1:] for r in rows if package is not None or r[1] == "fact"), most)
        made += [(package, *r) for r in found] if found is not None else [(package, *[None] * 5)]
        if len(made) > 50_000:
            yield flush(made)
            made = []
    if made:
        yield flush(made)


def _meanings(rows: Iterable[tuple], most: int) -> list[tuple] | None:
    """(file, space, name, decl_file, decl_name) of a package's facts, names and stars; None beyond ``most`` facts."""
    seen, own, named, stars = set(), set(), {}, {}
    for kind, *place, file, space, name in rows:
        if kind == "star":
            stars.setdefault(place[0], []).append((file, space))
            continue
        own.add(tuple(place) if kind == "fact" else (file, space, name))
        if kind == "fact":
            seen.add((*place, file, name))
        else:
            named.setdefault(tuple(place), []).append((file, space, name))
        if len(seen) > most:
            return None
    new = list(seen)
    while new:
        after = []
        for file, space, name, *decl in new:
            ends = named.get((file, space, name), [])
            if space == "e" and name != "default":
                ends = ends + [(f, s, name) for f, s in stars.get(file, ()) if (f, s, name) not in own]
            for fact in ((*end, *decl) for end in ends):
                if fact not in seen:
                    seen.add(fact)
                    after.append(fact)
            if len(seen) > most:
                return None
        new = after
    meant: dict = {}
    for *place, file, name in seen:
        meant.setdefault(tuple(place), []).append((file, name))
    return [(*place, *decls[0]) for place, decls in meant.items() if len(decls) == 1]


def _by_steps(facts: DataFrame, named: DataFrame, stars: DataFrame) -> DataFrame:
    """FACT rows of facts and links: a step carries the new facts of all packages at once."""
    facts, named, stars = cut(facts), cut(named), cut(stars)
    own = cut(facts.select(*PLACE).union(named.select(*PLACE)).distinct())
    seen = new = facts
    step = 0
    while not new.isEmpty():
        step += 1
        src = new.select("package_id", F.col("file").alias("src_file"), F.col("space").alias("src_space"), F.col("name").alias("src_name"), "decl_file", "decl_name")
        by_name = src.join(shuffled(named), ["package_id", "src_file", "src_space", "src_name"]).select(*FACT)
        given = src.where("src_space = 'e' and src_name <> 'default'").withColumnRenamed("src_name", "name")
        by_star = given.join(shuffled(stars), ["package_id", "src_file"]).select(*FACT).join(shuffled(own), PLACE, "left_anti")
        new = cut(by_name.union(by_star).distinct().join(shuffled(seen), FACT, "left_anti"))
        seen = seen.union(new) if step % COMPACT else cut(seen.union(new))
    one = seen.groupBy(*PLACE).agg(F.min(F.struct("decl_file", "decl_name")).alias("d"), F.max(F.struct("decl_file", "decl_name")).alias("e")).where("d = e")
    return one.select(*PLACE, "d.decl_file", "d.decl_name")


def references(refs: DataFrame, facts: DataFrame, most_depth: int = 8) -> DataFrame:
    """refs(package_id, file, name, ref) with (decl_file, decl_name): what ``ref`` means in the file.

    Dotted names go through modules, part by part; names that mean nothing here, or only a module, are left out.
    """
    facts, refs = cut(facts), cut(refs)
    parts = refs.withColumn("_parts", F.split("ref", r"\."))
    at = facts.select("package_id", "file", F.col("space").alias("_space"), F.col("name").alias("_part"), F.col("decl_file").alias("_to"), F.col("decl_name").alias("_what"))
    open_ = parts.withColumns({"_at": F.col("file"), "_space": F.lit("l"), "_part": F.col("_parts")[0], "_k": F.lit(1)})
    done = None
    for _ in range(most_depth):
        met = open_.join(shuffled(at.withColumnRenamed("file", "_at")), ["package_id", "_at", "_space", "_part"]).select(*refs.columns, "_parts", "_k", "_to", "_what")
        found = met.where("_what <> '*' and _k = size(_parts)").select(*refs.columns, F.col("_to").alias("decl_file"), F.col("_what").alias("decl_name"))
        done = found if done is None else done.union(found)
        open_ = cut(met.where("_what = '*' and _k < size(_parts)").select(*refs.columns, "_parts", F.col("_to").alias("_at"), F.lit("e").alias("_space"), F.col("_parts")[F.col("_k")].alias("_part"), (F.col("_k") + 1).alias("_k")))
        if open_.isEmpty():
            break
    return done


def referenced_names(types: DataFrame) -> DataFrame:
    """(package_id, file, name, ref): names in the heads and members of types as :func:`apilattice.sources.declarations.extract_types` reads them."""
    texts = F.concat(F.coalesce("supers", F.array()), F.coalesce("embeds", F.array()), F.array(F.coalesce("base", F.lit(""))), F.transform("members", lambda m: F.coalesce(m["ret"], F.lit(""))), F.flatten(F.transform("members", lambda m: F.transform(m["params"], lambda p: F.coalesce(p["type"], F.lit(""))))))
    words = F.flatten(F.transform(texts, lambda s: F.regexp_extract_all(s, F.lit(r"[\p{L}_$][\w$]*(?:\.[\p{L}_$][\w$]*)*"), F.lit(0))))
    return types.select("package_id", F.col("rel_path").alias("file"), "name", F.explode(F.array_distinct(words)).alias("ref"))


def resolved_edges(types: DataFrame, facts: DataFrame) -> DataFrame:
    """(package_id, src, dst) between types as file#name, by what the names in them mean in their file."""
    met = references(referenced_names(types), facts)
    key = lambda f, n: F.concat(F.col(f), F.lit("#"), F.col(n))
    edges = met.select("package_id", key("file", "name").alias("src"), key("decl_file", "decl_name").alias("dst"))
    return edges.where("src <> dst").distinct()


def with_references(types: DataFrame, facts: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """types with ``referenced_types``: names of the declarations that their heads and members mean, others than themselves.

    With entries(package_id, file), ``entry_point`` says whether one of these files gives the type out.
    """
    met = references(referenced_names(types), facts).where("not (decl_file = file and decl_name = name)")
    met = met.groupBy("package_id", F.col("file").alias("rel_path"), "name").agg(F.sort_array(F.collect_set("decl_name")).alias("referenced_types"))
    out = types.join(shuffled(met), ["package_id", "rel_path", "name"], "left").withColumn("referenced_types", F.coalesce("referenced_types", F.array().cast("array<string>")))
    if entries is None:
        return out
    given = entry_types(facts, entries).withColumnRenamed("name", "_shown").withColumn("_entry", F.lit(True))
    out = out.withColumn("_shown", F.concat("rel_path", F.lit("#"), "name")).join(shuffled(given), ["package_id", "_shown"], "left")
    return out.withColumn("entry_point", F.coalesce("_entry", F.lit(False))).drop("_entry", "_shown").select(*types.columns, "referenced_types")


def entry_types(facts: DataFrame, entries: DataFrame) -> DataFrame:
    """(package_id, name): declarations, as file#name, that the files entries(package_id, file) give out."""
    out = facts.where("space = 'e' and decl_name <> '*'").join(shuffled(entries.select("package_id", "file").distinct()), ["package_id", "file"], "left_semi")
    return out.select("package_id", F.concat("decl_file", F.lit("#"), "decl_name").alias("name")).distinct()


def entry_reachable(types: DataFrame, facts: DataFrame, entries: DataFrame) -> DataFrame:
    """(package_id, name, depth): types, as file#name, that users reach from the entry files by resolved references, and from nowhere else."""
    types, facts = cut(types), cut(facts)  # parsed once
    known = types.select("package_id", F.concat("rel_path", F.lit("#"), "name").alias("name")).distinct()
    edges = resolved_edges(types, facts).join(shuffled(known.withColumnRenamed("name", "dst")), ["package_id", "dst"], "left_semi")
    return reachable(edges, entry_types(facts, entries).join(shuffled(known), ["package_id", "name"], "left_semi"))
