"""Call edges: resolution passes, breadth-first expansion, neighbours.

Edges have an explicit ``call_id``, so "first" and "last" are defined by data,
never by the order of partitions.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import shared_dir


def demote(edges: DataFrame, symbols: DataFrame, target: str, key: str) -> DataFrame:
    """Edges with ``target`` nulled where it is not a symbol."""
    known = symbols.select(F.col(key).alias("__known")).distinct()
    return edges.join(known, edges[target] == F.col("__known"), "left").withColumn(target, F.col("__known")).drop("__known")


def unique_match(pending: DataFrame, call: str, candidates: DataFrame, on: list[tuple[Column, Column]], target: str) -> DataFrame:
    """(call, target) where exactly one candidate fits; ``on``: expressions of a call and of a candidate that must be equal.

    Candidates are counted by their keys before they meet calls, so a call that many fit
    meets one row, and pairs of calls and candidates are never made.
    """
    keys = [f"__key{k}" for k in range(len(on))]
    fits = candidates.select(*[own.alias(k) for k, (_, own) in zip(keys, on, strict=True)], target).groupBy(*keys).agg(F.count("*").alias("n"), F.min(target).alias(target))
    asked = pending.select(call, *[own.alias(k) for k, (own, _) in zip(keys, on, strict=True)])
    found = asked.join(fits, keys).groupBy(call).agg(F.sum("n").alias("n"), F.min(target).alias(target))
    return found.where("n = 1").select(call, target)


def last_import(imports: DataFrame) -> DataFrame:
    """One row per (file, lookup): what the last import of that name brings."""
    named = imports.withColumn("lookup", F.coalesce("alias", "name")).where("lookup is not null")
    last = Window.partitionBy("file", "lookup").orderBy(F.desc("import_id"))
    return named.withColumn("place", F.row_number().over(last)).where("place = 1").drop("place")


def simple_name(qname: Column) -> Column:
    """What stands behind the last dot or colon; a module's name is its whole one."""
    return F.when(qname.endswith(":"), qname).otherwise(F.regexp_extract(qname, r"[^.:]*$", 0))


def _member(calls_name: str = "callee_name") -> Column:
    return F.regexp_extract(calls_name, r"^(?:self|this)\.([^.]+)$", 1)


def needs(calls: DataFrame, imports: DataFrame) -> DataFrame:
    """(name, call_id, file): the simple names on which a call's resolution depends: its
    guess, a member of its own class, a name of its file, and what an import calls so.

    Symbols that have none of a call's names, and imports of other files, can't change
    what the call is resolved to. ``calls``: call_id, callee_name, guess, file.
    """
    brought = last_import(imports.where("name is not null and name <> '*'")).select(F.col("file").alias("i_file"), "lookup", F.col("name").alias("real"))
    rows = calls.join(brought, (F.col("file") == F.col("i_file")) & (F.col("callee_name") == F.col("lookup")), "left")
    bare = F.when(~F.col("callee_name").contains("."), F.col("callee_name"))
    every = F.array(simple_name(F.col("guess")), F.nullif(_member(), F.lit("")), bare, F.col("real"))
    return rows.select("call_id", "file", F.explode(F.array_distinct(F.filter(every, lambda n: n.isNotNull()))).alias("name")).select("name", "call_id", "file")


def changed_names(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name) of the symbols (qname, kind, file, parent_qname) that only one side has."""
    columns = ["qname", "kind", "file", "parent_qname"]
    a, b = before.select(*columns).distinct().withColumn("side", F.lit(1)), after.select(*columns).distinct().withColumn("side", F.lit(2))
    lone = a.unionByName(b).groupBy(*columns).agg(F.sum("side").alias("sides")).where("sides <> 3")
    return lone.select(simple_name(F.col("qname")).alias("name")).distinct()


def module_prefixes(module: Column) -> Column:
    """The module and every dotted beginning of it."""
    parts = F.split(module, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def imported_targets(wanted: DataFrame, offered: DataFrame) -> DataFrame:
    """(call_id, found_q) where one symbol fits an import: it has the name, and its module
    is the imported one or below it.

    Each symbol is offered under its name and every prefix of its module, so the match
    is by equal keys. wanted: call_id, real, i_module; offered: o_name, o_module, found_q.
    """
    keys = offered.select("o_name", "found_q", F.explode(module_prefixes(F.col("o_module"))).alias("o_prefix"))
    return unique_match(wanted, "call_id", keys, [(F.col("real"), F.col("o_name")), (F.col("i_module"), F.col("o_prefix"))], "found_q")


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame, local: bool = True) -> DataFrame:
    """``calls`` with callee_qname settled: demoted if unknown, then found through
    self or this, through names of the same file, or through the file's imports.

    calls: call_id, caller_qname, callee_name, callee_qname (the parser's guess), file,
    line. ``symbols`` need only be those with a name that the calls need.
    """
    kinds = F.col("kind").isin("function", "method", "class", "component")
    known = demote(calls, symbols, "callee_qname", "qname")
    member = _member()
    owner = F.when(F.col("caller_qname").rlike(r":.*\."), F.regexp_replace("caller_qname", r"\.[^.]*$", ""))
    own = F.when((member != "") & owner.isNotNull(), F.concat(owner, F.lit("."), member))
    names = symbols.select(F.col("qname").alias("self_q")).distinct()
    step = known.withColumn("want_self", F.when(F.col("callee_qname").isNull(), own)).join(names, F.col("want_self") == F.col("self_q"), "left")
    top_level = symbols.where(F.col("parent_qname").isNull() | F.col("parent_qname").endswith(":")).where(kinds)
    module, name = F.regexp_replace("qname", ":[^:]*$", ""), F.regexp_replace("qname", "^.*:", "")
    bare = ~F.col("callee_name").contains(".")
    if local:
        here = top_level.where(~name.contains(".")).select(module.alias("l_module"), name.alias("l_name"), F.col("file").alias("l_file"), F.col("qname").alias("local_q"))
        caller_module = F.regexp_replace("caller_qname", ":[^:]*$", "")
        step = step.join(here, bare & (caller_module == F.col("l_module")) & (F.col("callee_name") == F.col("l_name")) & (F.col("file") == F.col("l_file")), "left")
    else:
        step = step.withColumn("local_q", F.lit(None).cast("string"))
    step = step.withColumn("callee_qname", F.coalesce("callee_qname", "self_q", "local_q")).select(*calls.columns)
    pending = step.where(F.col("callee_qname").isNull() & bare)
    brought = last_import(imports.where("name is not null and name <> '*'")).select(F.col("file").alias("i_file"), "lookup", F.col("name").alias("real"), F.col("module").alias("i_module"))
    wanted = pending.join(brought, (F.col("file") == F.col("i_file")) & (F.col("callee_name") == F.col("lookup"))).select("call_id", "real", "i_module")
    plain = F.regexp_replace(module, r"^(src|tests)\.", "")
    offered = symbols.where(kinds).where(~name.contains(".")).select(name.alias("o_name"), plain.alias("o_module"), F.col("qname").alias("found_q"))
    imported = imported_targets(wanted, offered)
    return step.join(imported, "call_id", "left").withColumn("callee_qname", F.coalesce("callee_qname", "found_q")).select(*calls.columns)


def touched_calls(calls: DataFrame, dependencies: DataFrame, names: DataFrame, files: DataFrame) -> DataFrame:
    """Calls to resolve again: those outside of ``files`` (file) that need one of ``names`` (name)."""
    ids = dependencies.join(names, "name", "left_semi").select("call_id").distinct()
    return calls.join(files, "file", "left_anti").join(ids, "call_id", "left_semi")


@contextmanager
def laid_out(edges: DataFrame, by: str) -> Iterator[DataFrame]:
    """``edges`` written once, in buckets of ``by``: joins on it read them without a shuffle of their own."""
    spark, name = edges.sparkSession, f"edges_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def expand(edges: DataFrame, starts: DataFrame, depth: int, order: tuple[str, ...] = ()) -> DataFrame:
    """(node, hop, via, ord): nodes within ``depth`` hops of ``starts`` (node) over edges
    (src, dst), as a walk finds them that takes the nodes of a layer one after another,
    and each one's edges in ``order``: ``via`` is the node that a node was first found
    from, ``ord`` grows within a layer in the order of finding.

    One join with the frontier a hop; what was seen before is taken out before the first
    edge of a node is looked for, so cycles end. Each hop is cut by a reliable
    checkpoint, small as the frontier.
    """
    shared_dir(edges.sparkSession)
    ordinal = F.monotonically_increasing_id()  # after a sort it grows from partition to partition
    seen = starts.select("node").distinct().orderBy("node").select("node", F.lit(0).alias("hop"), F.lit(None).cast(edges.schema["src"].dataType).alias("via"), ordinal.alias("ord")).checkpoint()
    frontier = seen
    with laid_out(edges.select("src", "dst", *order), "src") as laid:
        for hop in range(1, depth + 1):
            found = laid.join(frontier.select(F.col("node").alias("src"), F.col("ord").alias("from_ord")), "src")
            new = found.join(seen.select(F.col("node").alias("dst")), "dst", "left_anti")
            first = new.groupBy("dst").agg(F.min(F.struct("from_ord", *order, "src")).alias("first"))
            fresh = first.orderBy("first", "dst").select(F.col("dst").alias("node"), F.lit(hop).alias("hop"), F.col("first.src").alias("via"), ordinal.alias("ord")).checkpoint()
            if fresh.isEmpty():
                break
            seen, frontier = seen.unionByName(fresh), fresh
    return seen


def neighbor_tree(edges: DataFrame, roots: DataFrame, limit: int, inner: int, order: list[str]) -> DataFrame:
    """(root, child, child_pos, grandchild, grandchild_pos): up to ``limit`` edges of
    each root in order, and up to ``inner`` of each of theirs. Edges: src, dst.

    The edges are numbered by source once; the children's come from the same rows.
    """
    place = F.row_number().over(Window.partitionBy("src").orderBy(*order))
    numbered = edges.withColumn("pos", place).where(F.col("pos") <= max(limit, inner)).select("src", "dst", "pos")
    path = f"{shared_dir(edges.sparkSession)}/neighbors-{uuid.uuid4().hex}"
    numbered.write.parquet(path)
    near = edges.sparkSession.read.schema(numbered.schema).parquet(path)
    first = near.where(F.col("pos") <= limit).join(roots.select(F.col("node").alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("root"), F.col("dst").alias("child"), F.col("pos").alias("child_pos"))
    second = near.where(F.col("pos") <= inner).select(F.col("src").alias("child"), F.col("dst").alias("grandchild"), F.col("pos").alias("grandchild_pos"))
    return first.join(second, "child", "left").select("root", "child", "child_pos", "grandchild", "grandchild_pos")


def callers_of(edges: DataFrame, callee: str, caller: str, line: str) -> DataFrame:
    """Each distinct caller of a callee with its first line."""
    return edges.groupBy(callee, caller).agg(F.min(line).alias("first_line"))


def alias_chain(aliases: DataFrame, starts: DataFrame, hops: int = 3) -> DataFrame:
    """(id, hop1.., terminal): up to ``hops`` steps of aliases (id, target), never
    back to a name that the chain has visited."""
    rows, names = starts.select("id"), ["id"]
    for n in range(1, hops + 1):
        step = aliases.select(F.col("id").alias("__id"), F.col("target").alias(f"hop{n}"))
        fresh = F.col("__id") == F.col(names[-1])
        for seen in names:
            fresh = fresh & (F.col(f"hop{n}") != F.col(seen))
        rows = rows.join(step, fresh, "left").drop("__id")
        names.append(f"hop{n}")
    return rows.withColumn("terminal", F.coalesce(*reversed(names)))


def constant_chains(consts: DataFrame, starts: DataFrame, hops: int = 3) -> DataFrame:
    """(start, chain, terminal, value): constants whose value is another's name, followed
    up to ``hops`` times, never to one that the chain has visited, all starts at once.

    consts: qname, name, value; starts: qname. Of several constants with a name the
    first is taken.
    """
    table = consts.select(F.col("qname").alias("next_q"), F.col("name").alias("next_name"), F.col("value").alias("next_value"))
    rows = starts.select("qname").distinct().join(consts, "qname").select(F.col("qname").alias("start"), F.array("qname").alias("visited"), "value")
    for _ in range(hops):
        wanted = F.when(F.col("value").rlike(r"^[A-Za-z_][\w.]*$"), F.regexp_extract("value", r"[^.]*$", 0))
        fits = (F.col("wanted") == F.col("next_name")) & ~F.array_contains("visited", F.col("next_q"))
        step = rows.withColumn("wanted", wanted).join(table, fits, "left").groupBy("start").agg(F.first("visited").alias("visited"), F.first("value").alias("value"), F.min(F.when(F.col("next_q").isNotNull(), F.struct("next_q", "next_value"))).alias("step"))
        went = F.col("step").isNotNull()
        # A chain that has ended stays as it is: its value names no constant that it has not visited.
        rows = step.select("start", F.when(went, F.concat("visited", F.array("step.next_q"))).otherwise(F.col("visited")).alias("visited"), F.when(went, F.col("step.next_value")).otherwise(F.col("value")).alias("value"))
    chain = F.slice("visited", F.lit(2), F.size("visited"))
    return rows.select("start", chain.alias("chain"), F.element_at("visited", -1).alias("terminal"), "value")


# Names that every program calls, in the two families of languages.
PYTHON_BUILTINS = frozenset(
    "print len range enumerate zip map filter sorted reversed any all min max sum abs str int float bool list dict tuple set bytes bytearray frozenset open type id repr hash ord chr next iter callable isinstance issubclass hasattr getattr setattr delattr format vars dir super object property staticmethod classmethod".split()
)
SCRIPT_METHODS = frozenset(
    "forEach map filter reduce reduceRight push pop shift unshift slice splice concat join find findIndex findLast findLastIndex flat flatMap some every includes indexOf lastIndexOf reverse sort copyWithin fill at split trim trimStart trimEnd toLowerCase toUpperCase replace replaceAll substring substr charAt charCodeAt padStart padEnd startsWith endsWith repeat codePointAt normalize localeCompare match matchAll search has get set delete clear keys values entries add then catch finally parse stringify assign fromEntries freeze isFrozen clearTimeout setTimeout clearInterval setInterval queueMicrotask requestAnimationFrame cancelAnimationFrame structuredClone".split()
)


def is_builtin_col(node: Column) -> Column:
    """Whether an unresolved node (``?:name``) is a built-in function or method."""
    name = F.regexp_extract(node, r"^\?:(.+)$", 1)
    tail = F.element_at(F.split(name, r"\."), -1)
    bare = ~name.contains(".") & name.isin(sorted(PYTHON_BUILTINS | SCRIPT_METHODS))
    return (name != "") & (bare | (name.contains(".") & tail.isin(sorted(SCRIPT_METHODS))))
