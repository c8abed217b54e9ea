"""URL filters: rules by host and path, and a path-template tree for what no rule fits.

A url's path is a walk from its host's root. The tree is grown level by level, in
joins and groupings over distinct path patterns:

1. Segments with digits are generalised to their shape (digits, hexadecimal numbers
   and long tokens), and equal patterns of a host are counted together before
   anything is shuffled, so a hot host is as large as its patterns, not its pages.
2. Where a node has more than ``MOST_CHILDREN`` children, those with less than that
   part of its pages become one wildcard; so at most that many stay.
3. Children of a node that are statistically similar are merged: the shapes below
   them may differ by no more than two samples of one distribution would (the
   Hoeffding bound of state merging, at ``ALPHA``), and their shares of blocked and
   of allowed pages by no more than ``LABEL_GAP``. A branch without labels is
   therefore not merged with one that rules have judged.
4. A template's purity is (blocked + ``SMOOTH``) / (labelled + 2 ``SMOOTH``) over the
   pages that it holds. A template with a purity of ``REJECT`` or more is rejected.

Labels are the verdicts of the rules and, if given, a column of known ones. A page
gets the verdict of the longest rule that fits it, else its template's: block if it
is rejected, allow otherwise, as it is without labels.

Cases: null urls, and those without ``://``, have an empty host and path, and share a
tree; an empty path is the root's template; segments beyond ``DEPTH`` count as one;
repeated rows and ids are judged each on their own; an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, in_workers

#: Verdict and rule (host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MOST_CHILDREN, DEPTH, LONG = 32, 8, 40
ALPHA, LABEL_GAP = 0.05, 0.1
SMOOTH, REJECT = 1.0, 0.9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WILD = "*"
#: Kinds of what follows a segment: nothing, digits, digits with an ending, other shapes, words.
KINDS = ("end", "number", "file", "shape", "word")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands behind the first ``://``: the host, A-Z lower-cased, and the path up to ``?`` or ``#``."""
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, below = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + below)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The path's segments, variable ones as shapes, at most ``DEPTH``."""

    def shape(x: Column) -> Column:
        digits = F.regexp_replace(x, r"\d+", "#")
        hexadecimal = x.rlike(r"^(?=.*\d)(?=.*[a-fA-F])[0-9a-fA-F-]{8,}$")
        return F.when(F.length(x) > LONG, "<long>").when(hexadecimal, "<hex>").otherwise(digits)

    all_of = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), shape)
    return F.when(F.size(all_of) > DEPTH, F.concat(F.slice(all_of, 1, DEPTH - 1), F.array(F.lit("**")))).otherwise(all_of)


def _kind(segment: Column) -> Column:
    return F.when(segment.isNull(), 0).when(segment == "#", 1).when(segment.rlike(r"^#\.\w+$"), 2).when(segment.rlike("[#<*]"), 3).otherwise(4)


def similar(a: dict, b: dict) -> bool:
    """Whether two branches may be one: see step 3 of the module. A branch has n pages,
    the counts of the kinds below, and its blocked and allowed pages."""
    bound = math.sqrt(math.log(2 / ALPHA) / 2) * (1 / math.sqrt(a["n"]) + 1 / math.sqrt(b["n"]))
    if any(abs(x / a["n"] - y / b["n"]) > bound for x, y in zip(a["kinds"], b["kinds"], strict=True)):
        return False
    return all(abs(a[c] / a["n"] - b[c] / b["n"]) <= LABEL_GAP for c in ("blocked", "allowed"))


def merged(children: list[dict]) -> list[tuple[str, str]]:
    """(segment, name of its branch): each child, largest first, joins the first branch that is similar to it."""
    branches: list[dict] = []
    for child in sorted(children, key=lambda c: (-c["n"], c["seg"])):
        home = next((b for b in branches if similar(b, child)), None)
        if home is None:
            branches.append(child | {"members": [child["seg"]]})
        else:
            home["members"].append(child["seg"])
            for c in ("n", "blocked", "allowed"):
                home[c] += child[c]
            home["kinds"] = [x + y for x, y in zip(home["kinds"], child["kinds"], strict=True)]
    return [(m, b["members"][0] if len(b["members"]) == 1 else "{" + "|".join(sorted(b["members"])) + "}") for b in branches for m in b["members"]]


def _names(children: DataFrame) -> DataFrame:
    """(host, node, seg, name) of the children that stay, from one row for each child."""
    entry = F.struct("seg", "n", "blocked", "allowed", "kinds")
    nodes = children.groupBy("host", "node").agg(F.collect_list(entry).alias("children"))  # at most MOST_CHILDREN and the wildcard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out = [(h, p, seg, name) for h, p, own in zip(hosts, paths, rows, strict=True) for seg, name in merged(own)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["host", "node", "seg", "name"])

    return in_workers(nodes, run, "host string, node string, seg string, name string", "urls")


def templates(patterns: DataFrame) -> DataFrame:
    """(host, shapes, template) from distinct (host, shapes, n, blocked, allowed)."""
    depth = patterns.agg(F.max(F.size("shapes"))).first()[0] or 0
    walks = patterns.withColumn("node", F.lit(""))
    for level in range(1, depth + 1):
        seg = F.get("shapes", F.lit(level - 1))
        here = walks.withColumn("seg", seg)
        kind = _kind(F.get("shapes", F.lit(level)))
        sums = [F.sum(F.when(kind == k, F.col("n")).otherwise(0)) for k in range(len(KINDS))]
        children = here.where(seg.isNotNull()).groupBy("host", "node", "seg").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"), F.array(*sums).alias("kinds"))
        nodes = children.groupBy("host", "node").agg(F.count("*").alias("__children"), F.sum("n").alias("__pages"))
        stays = (F.col("__children") <= MOST_CHILDREN) | (F.col("n") * MOST_CHILDREN >= F.col("__pages"))
        judged = children.join(nodes, ["host", "node"]).withColumn("seg", F.when(stays, F.col("seg")).otherwise(WILD))
        pooled = judged.groupBy("host", "node", "seg").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"), F.array(*[F.sum(F.get("kinds", F.lit(k))) for k in range(len(KINDS))]).alias("kinds"))
        names = cut(_names(pooled), "urls-names")
        wild = names.where(F.col("seg") == WILD).select("host", "node", F.col("name").alias("__wild"))
        known = here.join(names, ["host", "node", "seg"], "left").join(wild, ["host", "node"], "left")
        named = F.when(F.col("seg").isNull(), F.col("node")).otherwise(F.concat("node", F.lit("/"), F.coalesce("name", "__wild", F.lit(WILD))))
        walks = cut(known.withColumn("node", named).select(*patterns.columns, "node"), "urls-walks")
    return walks.select("host", "shapes", F.when(F.col("node") == "", "/").otherwise(F.col("node")).alias("template"), "n", "blocked", "allowed")


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, blocked: Column | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of ``pages`` (page_id, url).

    ``rules`` are a written list that becomes one expression; ``blocked`` is a boolean
    column of ``pages`` with known labels, null where there is none.
    """
    host, path = host_and_path(F.coalesce("url", F.lit("")))
    known = F.lit(None).cast("boolean") if blocked is None else blocked
    given = pages.select("page_id", host.alias("host"), path.alias("path"), known.alias("known"))
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    rows = given.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), "known", segments(F.col("path")).alias("shapes"))
    bad = F.coalesce(F.col("ruled") == "block", F.col("known"))
    counts = rows.groupBy("host", "shapes").agg(F.count("*").alias("n"), F.sum(F.when(bad, 1).otherwise(0)).alias("blocked"), F.sum(F.when(~bad, 1).otherwise(0)).alias("allowed"))
    walks = templates(cut(counts, "urls-patterns"))
    purity = (F.sum("blocked") + SMOOTH) / (F.sum("blocked") + F.sum("allowed") + 2 * SMOOTH)
    pure = walks.groupBy("host", "template").agg(purity.alias("purity"))
    found = walks.select("host", "shapes", "template").join(pure, ["host", "template"])
    # The rows' side is split where a pattern is hot; the other has one row for each.
    out = rows.join(found, ["host", "shapes"], "left")
    own = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "template", "purity")
