"""Every operator of the engine as a query over the supplied tables, with its SQL.

documents stand for symbols with bodies (doc_id a name, lang a language, source a
folder), embeddings for symbol vectors, lineitem for call edges, pages for HTML
sources, events for file events. Floats are rounded to six places and every
ranking ends with a unique key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import cooccurrence, fusion, graph, lexical, postings, snapshots, spans, vectors, views
from sparkloom.plans.kept import text_postings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def searcher(spark: SparkSession, sf_dir: str) -> postings.Searcher:
    """Kept postings of the documents' texts."""
    return text_postings(spark, f"{sf_dir}/documents.parquet")


TOKENS = """
tok AS (SELECT doc_id, lang, source, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS l FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(l)::DOUBLE) AS avgdl FROM tok)"""


def _bm25_sql(terms: str, name: str = "bm") -> str:
    return f"""
{name}_tf AS (SELECT doc_id, len(l) AS dl, w, count(*) AS tf FROM (SELECT doc_id, l, unnest(l) AS w FROM tok) WHERE w IN ({terms}) GROUP BY ALL),
{name}_df AS (SELECT w, count(*) AS df FROM {name}_tf GROUP BY w),
{name} AS (SELECT doc_id, sum(greatest(ln((n-df+0.5)/(df+0.5)),1e-6)*tf*2.2/(tf+1.2*(0.25+0.75*dl/avgdl))) AS score
  FROM {name}_tf JOIN {name}_df USING (w), st GROUP BY doc_id)"""


@query(f"WITH {TOKENS}, {_bm25_sql(chr(39) + 'thing' + chr(39) + ',' + chr(39) + 'thon' + chr(39))} SELECT doc_id, round(score, 6) AS score, lang, source FROM bm JOIN documents USING (doc_id) ORDER BY 2 DESC, 1 LIMIT 10")
def bm25_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    best = searcher(spark, sf_dir).top([["thing"], ["thon"]], 10).withColumnRenamed("key", "doc_id")
    return best.join(docs.select("doc_id", "lang", "source"), "doc_id").select("doc_id", "score", "lang", "source")


@query(f"""WITH {TOKENS},
ph_tf AS (SELECT doc_id, len(l) AS dl, len(list_filter(generate_series(1, len(l) - 1), lambda i: l[i] = 'of' AND l[i + 1] = 'the')) AS tf FROM tok),
p AS (SELECT * FROM ph_tf WHERE tf > 0), d AS (SELECT count(*) AS df FROM p)
SELECT doc_id, round(greatest(ln((n-df+0.5)/(df+0.5)),1e-6)*tf*2.2/(tf+1.2*(0.25+0.75*dl/avgdl)), 6) AS score FROM p, d, st ORDER BY 2 DESC, 1 LIMIT 10""")
def bm25_phrase(spark, sf_dir):
    return searcher(spark, sf_dir).top([["of", "the"]], 10).withColumnRenamed("key", "doc_id")


@query(f"WITH {TOKENS}, {_bm25_sql(chr(39) + 'und' + chr(39))}, k AS (SELECT bm.doc_id, score FROM bm JOIN documents USING (doc_id) WHERE lang = 'de') SELECT doc_id, round(score, 6) AS score, false AS kind_filter_dropped FROM k UNION ALL SELECT doc_id, round(score, 6), true FROM bm WHERE NOT EXISTS (SELECT 1 FROM k) ORDER BY 2 DESC, 1 LIMIT 10")
def bm25_kind_filter(spark, sf_dir):
    of_kind = table(spark, sf_dir, "documents").where("lang = 'de'").select(F.col("doc_id").alias("key"))
    return lexical.search_kind(searcher(spark, sf_dir), [["und"]], of_kind, 10).withColumnRenamed("key", "doc_id")


@query("SELECT e.vec_id, round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE e.label = (SELECT min(label) FROM embeddings) ORDER BY 2 DESC, 1 LIMIT 10")
def vector_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    wanted = rows.where("vec_id = 7").first().embedding
    label = rows.agg(F.min("label")).first()[0]
    return vectors.vector_top(rows, "vec_id", "embedding", wanted, 10, F.col("label") == label)


@query(f"""WITH {TOKENS}, {_bm25_sql(chr(39) + 'thing' + chr(39) + ',' + chr(39) + 'thon' + chr(39))},
lx AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS r FROM bm QUALIFY r <= 30),
vs AS (SELECT e.vec_id AS id, round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q),
vx AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS r FROM vs QUALIFY r <= 30),
f AS (SELECT id, sum(p) AS s FROM (SELECT id, 1.0::DOUBLE / (60 + r) AS p FROM lx UNION ALL SELECT id, 1.5::DOUBLE / (60 + r) FROM vx) GROUP BY id),
g AS (SELECT id, s * CASE WHEN source = 'src0' THEN 0.6::DOUBLE ELSE 1 END * CASE WHEN lang = 'de' THEN 0.7::DOUBLE ELSE 1 END AS s FROM f JOIN documents ON doc_id = id)
SELECT id AS doc_id, round(s, 6) AS score FROM g ORDER BY 2 DESC, 1 LIMIT 10""")
def rrf_hybrid(spark, sf_dir):
    docs, rows = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    lex = fusion.ranked(searcher(spark, sf_dir).top([["thing"], ["thon"]], 30).withColumnRenamed("key", "doc_id"), "doc_id", 30)
    wanted = rows.where("vec_id = 7").first().embedding
    vec = vectors.vector_top(rows, "vec_id", "embedding", wanted, 30).withColumnRenamed("vec_id", "doc_id")
    fused = fusion.fuse([(lex, 1.0), (fusion.ranked(vec, "doc_id", 30), 1.5)], "doc_id")
    known = fused.join(docs.select("doc_id", "lang", "source"), "doc_id")
    factor = F.when(F.col("source") == "src0", 0.6).otherwise(1.0) * F.when(F.col("lang") == "de", 0.7).otherwise(1.0)
    return lexical.top(known.select("doc_id", (F.col("score") * factor).alias("score")), "doc_id", 10)


@query(f"WITH {TOKENS}, {_bm25_sql(chr(39) + 'thing' + chr(39), 'x')}, {_bm25_sql(chr(39) + 'thon' + chr(39), 'y')} SELECT doc_id, round(max(score), 6) AS score FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY doc_id ORDER BY 2 DESC, 1 LIMIT 10")
def multi_term_max(spark, sf_dir):
    search = searcher(spark, sf_dir)
    found = [search.top([[w]], 10).withColumnRenamed("key", "doc_id") for w in ("thing", "thon")]
    return fusion.merge_terms(found, "doc_id", 10)


LINES_SQL = """ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS txt, generate_subscripts(string_split(text, chr(10)), 1) AS line, string_split(text, chr(10)) AS ls FROM documents)"""


@query(f"WITH {LINES_SQL} SELECT doc_id, line::INT AS line, txt, array_to_string(ls[line-1:line-1], '~') AS before, array_to_string(ls[line+1:line+1], '~') AS after, regexp_matches(txt, '(^|\\s)({spans.DECLARING})\\s+License(\\s|[(=:<{{,])|^License\\s*=') AS is_definition FROM ln WHERE contains(txt, 'License')")
def grep_literal(spark, sf_dir):
    rows = spans.grep(table(spark, sf_dir, "documents"), "doc_id", "text", "License")
    return rows.select("doc_id", "line", "txt", F.array_join("before", "~").alias("before"), F.array_join("after", "~").alias("after"), "is_definition")


@query(f"WITH {LINES_SQL} SELECT doc_id, line::INT AS line, length(txt)::INT AS n FROM ln WHERE regexp_matches(txt, 'released +under|rights', 'i')")
def grep_regex_ci(spark, sf_dir):
    rows = spans.grep(table(spark, sf_dir, "documents"), "doc_id", "text", "released +under|rights", regex=True, ignore_case=True)
    return rows.select("doc_id", "line", F.length("txt").alias("n"))


SPANS_SQL = f"""WITH {LINES_SQL},
sp AS (SELECT doc_id, 1 AS start, len(string_split(text, chr(10))) AS stop, 'module' AS name, true AS is_module FROM documents
  UNION ALL SELECT doc_id, line, line + 1, 'p' || line, false FROM ln WHERE line % 2 = 1
  UNION ALL SELECT doc_id, line, line + 3, 'q' || line, false FROM ln WHERE line % 3 = 1),
h AS (SELECT doc_id, line FROM ln WHERE contains(txt, 'License')),
j AS (SELECT h.doc_id, h.line, name, row_number() OVER (PARTITION BY h.doc_id, h.line ORDER BY ORDERING) AS r FROM h JOIN sp ON h.doc_id = sp.doc_id AND h.line BETWEEN start AND stop)
SELECT doc_id, line::INT AS line, name FROM j WHERE r = 1"""


def _spans(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    rows = spans.line_table(docs.where(F.col("text").contains("License")), "doc_id", "text")  # no others have hits
    # One pass gives the whole text's span and those of its paragraphs.
    made = rows.select("doc_id", "line", F.size("lines").alias("n")).select(
        "doc_id",
        F.explode(
            F.filter(
                F.array(
                    F.when(F.col("line") == 1, F.struct(F.lit(1).alias("start"), F.col("n").alias("stop"), F.lit("module").alias("name"), F.lit(True).alias("is_module"))),
                    F.when(F.col("line") % 2 == 1, F.struct(F.col("line").alias("start"), (F.col("line") + 1).alias("stop"), F.concat(F.lit("p"), F.col("line")).alias("name"), F.lit(False).alias("is_module"))),
                    F.when(F.col("line") % 3 == 1, F.struct(F.col("line").alias("start"), (F.col("line") + 3).alias("stop"), F.concat(F.lit("q"), F.col("line")).alias("name"), F.lit(False).alias("is_module"))),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("s"),
    )
    hits = spans.grep(docs, "doc_id", "text", "License").select("doc_id", "line")
    return hits, made.select("doc_id", "s.*")


@query(SPANS_SQL.replace("ORDERING", "is_module, stop - start, start, name"))
def find_innermost(spark, sf_dir):
    hits, made = _spans(spark, sf_dir)
    return spans.attribute(hits, made, "doc_id").select("doc_id", "line", "name")


@query(SPANS_SQL.replace("ORDERING", "stop - start, start, name"))
def line_tightest(spark, sf_dir):
    hits, made = _spans(spark, sf_dir)
    return spans.attribute(hits, made, "doc_id", prefer_members=False).select("doc_id", "line", "name")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 25) THEN l_partkey END AS target FROM lineitem")
def demote_edges(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("target"))
    return graph.demote(edges, table(spark, sf_dir, "part").where("p_size <= 25"), "target", "p_partkey")


@query("""WITH calls AS (SELECT l_orderkey AS call_id, min(l_partkey) AS part, min(l_suppkey) AS supp FROM lineitem GROUP BY 1),
imports AS (SELECT p_brand AS file, p_type AS lookup, p_partkey AS import_id, p_size AS real FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey DESC) = 1),
own AS (SELECT call_id, supp AS target FROM calls JOIN supplier ON s_suppkey = supp WHERE s_acctbal > 0),
loc AS (SELECT call_id, p_partkey AS target FROM calls JOIN part ON p_partkey = part WHERE p_size < 20),
imp AS (SELECT call_id, CASE WHEN count(*) = 1 THEN min(n_nationkey) END AS target FROM calls JOIN part ON p_partkey = part JOIN imports ON file = p_brand AND lookup = p_type JOIN nation ON n_nationkey % 10 = real % 10 AND n_nationkey < 15 GROUP BY 1)
SELECT call_id, coalesce(own.target, loc.target, imp.target)::BIGINT AS target FROM calls LEFT JOIN own USING (call_id) LEFT JOIN loc USING (call_id) LEFT JOIN imp USING (call_id)""")
def promote_chain(spark, sf_dir):
    part, supplier, nation = (table(spark, sf_dir, t) for t in ("part", "supplier", "nation"))
    calls = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("call_id")).agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"))
    imports = graph.last_import(part.select(F.col("p_brand").alias("file"), F.col("p_type").alias("name"), F.lit(None).cast("string").alias("alias"), F.col("p_partkey").alias("import_id"), F.col("p_size").alias("real")))
    own = calls.join(supplier.where("s_acctbal > 0"), F.col("supp") == F.col("s_suppkey")).select("call_id", F.col("s_suppkey").alias("t1"))
    local = calls.join(part.where("p_size < 20"), F.col("part") == F.col("p_partkey")).select("call_id", F.col("p_partkey").alias("t2"))
    wanted = calls.join(part, F.col("part") == F.col("p_partkey")).join(imports.select("file", "lookup", "real"), (F.col("file") == F.col("p_brand")) & (F.col("lookup") == F.col("p_type"))).select("call_id", "real")
    brought = graph.unique_match(wanted, "call_id", nation.where("n_nationkey < 15"), [(F.col("real") % 10, F.col("n_nationkey") % 10)], "n_nationkey").withColumnRenamed("n_nationkey", "t3")
    rows = calls.join(own, "call_id", "left").join(local, "call_id", "left").join(brought, "call_id", "left")
    return rows.select("call_id", F.coalesce("t1", "t2", F.col("t3").cast("long")).alias("target"))


EDGES_SQL = "e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem WHERE l_linenumber % 2 = 1 UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem WHERE l_linenumber % 2 = 0)"


def _calls(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    s, p = F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("p"), "l_partkey")
    first = F.col("l_linenumber") % 2 == 1
    return rows.select(F.when(first, s).otherwise(p).alias("src"), F.when(first, p).otherwise(s).alias("dst"))


@query(f"WITH RECURSIVE {EDGES_SQL}, w AS (SELECT 's1' AS node, 0 AS hop UNION SELECT dst, hop + 1 FROM w JOIN e ON src = node WHERE hop < 3) SELECT node, min(hop)::INT AS hop FROM w GROUP BY node")
def bfs_layers(spark, sf_dir):
    start = spark.createDataFrame([("s1",)], "node string")
    return graph.expand(_calls(spark, sf_dir), start, 3).select("node", "hop")


@query(f"""WITH {EDGES_SQL}, n AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS pos FROM e),
a AS (SELECT src AS root, dst AS child, pos AS child_pos FROM n WHERE src LIKE 's%' AND pos <= 8)
SELECT root, child, child_pos::INT AS child_pos, dst AS grandchild, pos::INT AS grandchild_pos FROM a LEFT JOIN (SELECT * FROM n WHERE pos <= 4) b ON b.src = child""")
def neighbor_tree(spark, sf_dir):
    edges = _calls(spark, sf_dir).distinct()
    suppliers = table(spark, sf_dir, "lineitem").where("l_linenumber % 2 = 1").select("l_suppkey").distinct()
    roots = suppliers.select(F.concat(F.lit("s"), "l_suppkey").alias("node"))
    return graph.neighbor_tree(edges, roots, 8, 4, ["dst"])


@query("SELECT l_partkey AS callee, l_suppkey AS caller, min(l_orderkey) AS first_line FROM lineitem GROUP BY 1, 2")
def callers_dedup(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("callee"), F.col("l_suppkey").alias("caller"), "l_orderkey")
    return graph.callers_of(edges, "callee", "caller", "l_orderkey")


@query("SELECT o_orderkey, count(*)::INT AS n, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS members FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def outline_nest(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    kept = items.join(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "left_semi")
    made = views.outline(kept, "o_orderkey", ["l_linenumber", "l_partkey"], [])
    text = F.array_join(F.transform("members", lambda m: F.concat_ws(":", m["l_linenumber"], m["l_partkey"])), ",")
    return made.select("o_orderkey", "n", text.alias("members"))


@query("SELECT source, lang, count(*) AS files, sum(n_chars)::BIGINT AS chars, arg_min(left(text, 20), doc_id) AS first_heading FROM documents GROUP BY 1, 2")
def map_repo(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source", "lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.min_by(F.left("text", F.lit(20)), "doc_id").alias("first_heading"))


@query("WITH b AS (SELECT source, lang, sum(length(text))::BIGINT AS size FROM documents GROUP BY 1, 2), r AS (SELECT *, sum(size) OVER (PARTITION BY lang ORDER BY source ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM b) SELECT lang, source, size, used FROM r WHERE used <= 200000")
def skeleton_budget(spark, sf_dir):
    blocks = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.sum(F.length("text")).alias("size"))
    return views.within_budget(blocks, ["lang"], ["source"], "size", 200000).select("lang", "source", "size", "used")


@query("SELECT page_id, pos::INT AS pos, heading FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1)) AS heading, generate_subscripts(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), 1) - 1 AS pos FROM pages)")
def html_headings(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("pos", "heading"))


def _summary_sql() -> str:
    text = r"regexp_replace(html, '(?s)\{[%{#].*?[#}%]\}', ' ', 'g')"
    text = rf"regexp_replace({text}, '(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<![^>]*>|<[^>]+>', ' ', 'g')"
    text = rf"regexp_replace({text}, '\s+', ' ', 'g')"
    for entity, mark in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " ")):
        text = f"replace({text}, '{entity}', '{mark}')"
    text = f"trim({text})"
    return f"""WITH t AS (SELECT page_id, {text} AS t FROM pages), u AS (SELECT page_id, t, left(t, 480) AS h, length(left(t, 480)) - strpos(reverse(left(t, 480)), ' ') AS cut_at FROM t)
SELECT page_id, CASE WHEN length(t) <= 480 THEN t WHEN cut_at > 240 THEN rtrim(left(h, cut_at)) || '…' ELSE rtrim(h) || '…' END AS summary FROM u"""


@query(_summary_sql())
def html_prose_summary(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.prose_summary_col(F.col("html")).alias("summary"))


@query(r"""SELECT p_partkey, array_to_string(list_filter(string_split_regex(lower(regexp_replace(regexp_replace('My' || p_brand || 'HTTPServer_x9' || p_name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ') AS words FROM part""")
def identifier_split(spark, sf_dir):
    name = F.concat(F.lit("My"), "p_brand", F.lit("HTTPServer_x9"), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.identifier_words_col(name), " ").alias("words"))


def _class_sql() -> str:
    prose = ", ".join(f"'{w}'" for w in sorted(T.PROSE_WORDS))
    return rf"""WITH q AS (SELECT doc_id, array_to_string(list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '')[1:(1 + doc_id % 6)], ' ') AS q FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(trim(q), '\s+'), lambda x: x <> '') AS raw, list_filter(string_split_regex(lower(q), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '') AS tok FROM q),
c AS (SELECT doc_id, len(raw) AS n_raw, len(tok) AS n, len(list_filter(tok, lambda x: x IN ({prose}))) AS p, len(list_filter(raw, lambda x: regexp_matches(x, '[._:/]|[a-z][A-Z]') OR (length(x) > 1 AND regexp_matches(x, '[A-Z]') AND upper(x) = x))) > 0 AS named FROM w)
SELECT doc_id, CASE WHEN n_raw <= 2 AND named THEN 'identifier' WHEN (n >= 5 AND p >= 1) OR (n >= 4 AND p >= 2) THEN 'natural' ELSE 'mixed' END AS class FROM c"""


@query(_class_sql())
def classify_query(spark, sf_dir):
    cut = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")
    first = F.array_join(F.slice(cut, F.lit(1), (F.lit(1) + F.col("doc_id") % 6).cast("int")), " ")
    return table(spark, sf_dir, "documents").select("doc_id", T.query_class_col(first).alias("class"))


NEXT_SQL = "nx AS (SELECT doc_id, sha1(text || CASE WHEN doc_id % 10 = 0 THEN '!' ELSE '' END) AS h FROM documents WHERE doc_id % 17 <> 0 UNION ALL SELECT doc_id + 1000000000, sha1(text) FROM documents WHERE doc_id % 13 = 0)"


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    old = docs.select("doc_id", F.sha1("text").alias("h"))
    edited = docs.where("doc_id % 17 <> 0").select("doc_id", F.sha1(F.concat("text", F.when(F.col("doc_id") % 10 == 0, "!").otherwise(""))).alias("h"))
    return old, edited.unionByName(docs.where("doc_id % 13 = 0").select((F.col("doc_id") + 1000000000).alias("doc_id"), F.sha1("text").alias("h")))


@query(f"WITH {NEXT_SQL}, ol AS (SELECT doc_id, sha1(text) AS h FROM documents) SELECT coalesce(ol.doc_id, nx.doc_id) AS doc_id, CASE WHEN ol.h IS NULL THEN 'added' WHEN nx.h IS NULL THEN 'removed' WHEN ol.h = nx.h THEN 'unchanged' ELSE 'changed' END AS status FROM ol FULL JOIN nx ON ol.doc_id = nx.doc_id")
def sha_diff(spark, sf_dir):
    return snapshots.changes(*_versions(spark, sf_dir), "doc_id", "h")


@query("SELECT source, sha1(string_agg(doc_id || chr(0) || sha1(text), chr(10) ORDER BY doc_id)) AS version, count(*) AS files FROM documents GROUP BY source")
def source_version(spark, sf_dir):
    return snapshots.source_version(table(spark, sf_dir, "documents").select("source", "doc_id", F.sha1("text").alias("h")), "doc_id", "h", ("source",))


@query("WITH nw AS (SELECT vec_id + 3 AS vec_id, label + 1 AS label FROM embeddings WHERE vec_id % 5 = 0) SELECT vec_id, label::INT AS label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM nw) UNION ALL SELECT vec_id, label::INT FROM nw")
def upsert_vectors(spark, sf_dir):
    old = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    new = old.where("vec_id % 5 = 0").select((F.col("vec_id") + 3).alias("vec_id"), (F.col("label") + 1).alias("label"))
    return vectors.upsert(old, new, "vec_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0)")
def vectors_missing(spark, sf_dir):
    held = table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("doc_id"))
    return vectors.missing(table(spark, sf_dir, "documents").select("doc_id"), held, "doc_id")


@query("""WITH g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts)::VARCHAR AS started, count(*) AS events FROM r GROUP BY user_id, k""")
def debounce_sessions(spark, sf_dir):
    from sparkloom.streaming import watch

    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return watch.sessions(rows, "user_id", "ts", "30 minutes").select("user_id", F.col("started").cast("string").alias("started"), "events")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_index(spark, sf_dir):
    from sparkloom.streaming import watch

    return watch.replay_totals(spark, sf_dir)


@query(r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, len(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> ''))::INT AS segments FROM pages WHERE regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) LIKE '/en/%'")
def routes_lookup(spark, sf_dir):
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"), path.alias("path"))
    return rows.where(F.col("path").startswith("/en/")).withColumn("segments", F.size(F.filter(F.split("path", "/"), lambda x: x != "")))


@query("""WITH a AS (SELECT p_partkey AS id, p_partkey // 2 AS target FROM part)
SELECT s.id, h1.target AS hop1, h2.target AS hop2, h3.target AS hop3, coalesce(h3.target, h2.target, h1.target, s.id) AS terminal FROM a s
LEFT JOIN a h1 ON h1.id = s.id AND h1.target <> s.id LEFT JOIN a h2 ON h2.id = h1.target AND h2.target NOT IN (s.id, h1.target) LEFT JOIN a h3 ON h3.id = h2.target AND h3.target NOT IN (s.id, h1.target, h2.target)""")
def alias_chain(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 2").alias("target"))
    return graph.alias_chain(rows, rows, 3)


@query(r"WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(text, '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z][A-Z0-9_]{2,}')))) AS name FROM documents) SELECT doc_id, name, length(name)::INT AS n FROM w")
def constants_in_body(spark, sf_dir):
    names = F.array_distinct(F.filter(F.split("text", r"[^\p{L}\p{N}_]+"), lambda x: x.rlike("^[A-Z][A-Z0-9_]{2,}$")))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(names).alias("name")).withColumn("n", F.length("name"))


@query(f"WITH {TOKENS}, {_bm25_sql(chr(39) + 'thing' + chr(39))}, r AS (SELECT source, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY source ORDER BY round(score, 6) DESC, doc_id) AS root_rank FROM bm JOIN documents USING (doc_id)) SELECT source, doc_id, score, root_rank::INT AS root_rank FROM r WHERE root_rank <= 5 ORDER BY score DESC, source, doc_id LIMIT 20")
def multi_root_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    search = searcher(spark, sf_dir)
    scored = search.keyed(search.scores([["thing"]])).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score")).join(docs.select("doc_id", "source"), "doc_id")
    return views.merge_roots(scored, "source", "doc_id", 5, 20).select("source", "doc_id", "score", "root_rank")


@query("""WITH c AS (SELECT l_orderkey AS call_id, l_linenumber AS line, unnest([1, 2]) AS cand, l_partkey, l_suppkey FROM lineitem),
k AS (SELECT call_id, line, cand, CASE WHEN cand = 1 THEN 'part' ELSE 'supplier' END AS scope, CASE WHEN cand = 1 THEN l_partkey ELSE l_suppkey END AS qname FROM c),
s AS (SELECT 'part' AS scope, p_partkey AS qname FROM part WHERE p_size < 10 UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE s_acctbal > 0)
SELECT call_id, scope, qname FROM k JOIN s USING (scope, qname) QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY line, cand, qname) = 1""")
def cross_scope_resolve(spark, sf_dir):
    calls = table(spark, sf_dir, "lineitem")
    cand = F.array(F.struct(F.lit(1).alias("cand"), F.lit("part").alias("scope"), F.col("l_partkey").alias("qname")), F.struct(F.lit(2).alias("cand"), F.lit("supplier").alias("scope"), F.col("l_suppkey").alias("qname")))
    wanted = calls.select(F.col("l_orderkey").alias("call_id"), F.col("l_linenumber").alias("line"), F.inline(cand))
    known = table(spark, sf_dir, "part").where("p_size < 10").select(F.lit("part").alias("scope"), F.col("p_partkey").alias("qname")).unionByName(table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.lit("supplier").alias("scope"), F.col("s_suppkey").alias("qname")))
    return snapshots.first_of_key(wanted.join(known, ["scope", "qname"]), "call_id", ["line", "cand", "qname"]).select("call_id", "scope", "qname")


@query(r"SELECT doc_id, sha1(regexp_replace(text, '\bthe\b', 'renamed', 'g')) AS digest, (length(regexp_replace(text, '\bthe\b', 'the#', 'g')) - length(text))::INT AS places FROM documents WHERE regexp_matches(text, '\bthe\b')")
def rename_rewrite(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\bthe\b"))
    return rows.select("doc_id", F.sha1(F.regexp_replace("text", r"\bthe\b", "renamed")).alias("digest"), F.regexp_count("text", F.lit(r"\bthe\b")).alias("places"))


@query("WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE contains(text, chr(10))) SELECT doc_id, array_to_string(list_concat(l[1:1], ['NEW', 'LINES'], l[4:]), chr(10)) AS text FROM l")
def splice_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where(F.col("text").contains("\n"))
    return rows.select("doc_id", spans.splice(F.col("text"), 2, 3, F.array(F.lit("NEW"), F.lit("LINES"))).alias("text"))


@query("SELECT l_orderkey, l_linenumber, a, b, reached FROM (SELECT l_orderkey, l_linenumber, l_partkey AS a, l_partkey + l_suppkey % 50 AS b, max(l_partkey + l_suppkey % 50) OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_partkey + l_suppkey % 50, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM lineitem) WHERE a <= reached")
def overlap_check(spark, sf_dir):
    edits = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("a"), (F.col("l_partkey") + F.col("l_suppkey") % 50).alias("b"))
    return spans.overlapping(edits, "l_orderkey", "a", "b", "l_linenumber")


@query("SELECT doc_id, (length(text) // 4)::INT AS tokens, CASE WHEN length(text) // 4 > 1600 THEN 'halve_bodies' WHEN length(text) // 4 > 800 THEN 'drop_outlines' ELSE 'whole' END AS stage FROM documents")
def token_budget(spark, sf_dir):
    n = F.expr("cast(length(text) div 4 as int)")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("tokens"), F.when(n > 1600, "halve_bodies").when(n > 800, "drop_outlines").otherwise("whole").alias("stage"))


@query("""WITH c AS (SELECT page_id, q, list_value(q, regexp_replace(q, '\\.html?$', ''), replace(q, '/', '.'), replace(replace(q, '.', '/'), '//', '/')) AS l FROM (SELECT page_id, 'en/' || page_id || CASE WHEN page_id % 3 = 0 THEN '.html' ELSE '' END AS q FROM pages)),
e AS (SELECT page_id, unnest(l) AS cand, generate_subscripts(l, 1) AS rank FROM c), known AS (SELECT 'en/' || page_id AS name FROM pages WHERE page_id % 2 = 0 UNION SELECT 'en.' || page_id FROM pages WHERE page_id % 5 = 0)
SELECT page_id, arg_min(cand, rank) AS name, min(rank)::INT AS rank FROM e JOIN known ON name = cand GROUP BY page_id""")
def paraphrase(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    asked = pages.select("page_id", F.concat(F.lit("en/"), "page_id", F.when(F.col("page_id") % 3 == 0, ".html").otherwise("")).alias("q"))
    tries = F.array("q", F.regexp_replace("q", r"\.html?$", ""), F.replace("q", F.lit("/"), F.lit(".")), F.replace(F.replace("q", F.lit("."), F.lit("/")), F.lit("//"), F.lit("/")))
    wanted = asked.select("page_id", F.posexplode(tries).alias("p", "name")).withColumn("rank", F.col("p") + 1)
    known = pages.where("page_id % 2 = 0").select(F.concat(F.lit("en/"), "page_id").alias("name")).unionByName(pages.where("page_id % 5 = 0").select(F.concat(F.lit("en."), "page_id").alias("name")))
    return snapshots.first_of_key(wanted.join(known, "name", "left_semi"), "page_id", ["rank"]).select("page_id", "name", "rank")


@query("WITH o AS (SELECT doc_id, ((length(text) - length(replace(text, 'License', ''))) / 7)::INT AS n FROM documents) SELECT doc_id, n, CASE WHEN n = 0 THEN 'not_found' WHEN n = 1 THEN 'ok' ELSE 'ambiguous' END AS outcome FROM o")
def unique_occurrence(spark, sf_dir):
    n = spans.occurrences(F.col("text"), "License")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n"), F.when(n == 0, "not_found").when(n == 1, "ok").otherwise("ambiguous").alias("outcome"))


@query("SELECT DISTINCT source AS file FROM documents WHERE starts_with(source, 'src1') ORDER BY 1")
def files_under_prefix(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("source").startswith("src1")).select(F.col("source").alias("file")).distinct().orderBy("file")


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text)::INT AS place FROM conversations")
def symbols_in_file(spark, sf_dir):
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.row_number().over(order).alias("place"))


@query("""WITH o AS (SELECT p_partkey AS q, 'n' || (p_partkey % 50) AS name, 'm' || (p_size % 5) || '.m' || (p_size % 7) || '.m' || (p_partkey % 11) AS module FROM part),
w AS (SELECT o_orderkey AS call_id, 'n' || (o_orderkey % 50) AS name, 'm' || (o_orderkey % 5) || CASE WHEN o_orderkey % 3 > 0 THEN '.m' || (o_orderkey % 7) ELSE '' END || CASE WHEN o_orderkey % 3 > 1 THEN '.m' || (o_orderkey % 11) ELSE '' END AS module FROM orders)
SELECT call_id, min(q)::BIGINT AS found_q FROM w JOIN o ON w.name = o.name AND (o.module = w.module OR starts_with(o.module, w.module || '.')) GROUP BY call_id HAVING count(*) = 1""")
def import_targets(spark, sf_dir):
    m = lambda column, n: F.concat(F.lit("m"), (F.col(column) % n).cast("string"))
    offered = table(spark, sf_dir, "part").select(F.concat(F.lit("n"), (F.col("p_partkey") % 50).cast("string")).alias("o_name"), F.concat_ws(".", m("p_size", 5), m("p_size", 7), m("p_partkey", 11)).alias("o_module"), F.col("p_partkey").cast("long").alias("found_q"))
    deeper = [F.when(F.col("o_orderkey") % 3 > k, m("o_orderkey", n)) for k, n in ((0, 7), (1, 11))]
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), F.concat(F.lit("n"), (F.col("o_orderkey") % 50).cast("string")).alias("real"), F.concat_ws(".", m("o_orderkey", 5), *deeper).alias("i_module"))
    return graph.imported_targets(wanted, offered)


@query("""WITH f AS (SELECT source, lang, doc_id::VARCHAR AS name, sha1(text) AS h FROM documents),
a AS (SELECT source, lang, sha1(string_agg('f' || chr(0) || name || chr(0) || h, chr(10) ORDER BY name)) AS digest FROM f GROUP BY 1, 2),
b AS (SELECT source, sha1(string_agg('d' || chr(0) || lang || chr(0) || digest, chr(10) ORDER BY lang)) AS digest FROM a GROUP BY 1)
SELECT source || '/' || lang AS folder, digest FROM a UNION ALL SELECT source, digest FROM b
UNION ALL SELECT '', sha1(string_agg('d' || chr(0) || source || chr(0) || digest, chr(10) ORDER BY source)) FROM b""")
def folder_digests(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("rel"), F.sha1("text").alias("h"))
    return snapshots.folder_digests(files, "rel", "h")


@query(r"""WITH t AS (SELECT list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS l FROM conversations),
p AS (SELECT l, unnest(l) AS a, generate_subscripts(l, 1) AS i FROM t),
q AS (SELECT a, unnest(l[i + 1:i + 5]) AS b FROM p),
n AS (SELECT word, other, count(*) AS n FROM (SELECT a AS word, b AS other FROM q WHERE a <> b UNION ALL SELECT b, a FROM q WHERE a <> b) GROUP BY 1, 2),
s AS (SELECT word, sum(n) AS s FROM n GROUP BY 1)
SELECT n.word, n.other, round(ln(n.n::DOUBLE * (SELECT sum(n) FROM n)::DOUBLE / (x.s::DOUBLE * y.s::DOUBLE)), 6) AS w FROM n JOIN s x ON x.word = n.word JOIN s y ON y.word = n.other
WHERE ln(n.n::DOUBLE * (SELECT sum(n) FROM n)::DOUBLE / (x.s::DOUBLE * y.s::DOUBLE)) > 0""")
def word_information(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(T.words(F.col("text")).alias("words"))
    return cooccurrence.word_information(rows, "words").select("word", "other", F.round("w", 6).alias("w"))
