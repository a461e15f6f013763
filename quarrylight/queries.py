"""The operators applied to the driver's tables, each beside SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import paths, risk, text
from quarrylight.operators import graph, joins, ordering
from quarrylight.plans import arch, ci, deadcode, drift, opportunity, security, techdebt, triage
from quarrylight.session import shipped
from quarrylight.sources.repo import Repo

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(fn):
        QUERIES[fn.__name__] = shipped(fn)
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _above(value: str, sorted_list: str, n: str) -> str:
    return "(1 + " + " + ".join(f"({value} > {sorted_list}[1 + floor({n} * {q})::INT])::INT" for q in (0.2, 0.4, 0.6, 0.8)) + ")"


def _share(value: str) -> str:
    return f"(CASE WHEN {value} <= 0 THEN 1 ELSE least(5, 1 + floor(5 * cume_dist() OVER (ORDER BY {value}))::INT) END)"


# --- churn and scores ------------------------------------------------------------------------------------------------


def _numstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return events.select(k.alias("added"), F.when(F.col("event_type") == "error", "-").otherwise("0").alias("deleted"), F.concat(F.lit("users/{old => u"), "user_id", F.lit("}/log")).alias("raw_path"))


_CHURN = """SELECT 'users/u' || user_id || '/log' AS file, count(*)::INT AS commits,
    coalesce(sum((props->>'k')::INT) FILTER (event_type <> 'error'), 0)::INT AS lines FROM events GROUP BY user_id"""


@query(f"SELECT file, commits, lines, commits + lines / 1000.0::DOUBLE AS churn_raw FROM ({_CHURN})")
def churn_rollup(spark, sf_dir):
    return techdebt.churn(_numstat(spark, sf_dir)).withColumn("churn_raw", techdebt.churn_raw())


@query("SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def churn_left_join(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


_USERS = "SELECT user_id, count(*)::INT AS commits, sum((props->>'k')::INT)::INT AS lines, count(DISTINCT event_type)::INT AS kinds, count(*) FILTER (event_type = 'error')::INT AS errors FROM events GROUP BY 1"


@query(
    f"""WITH u AS (SELECT *, commits + lines / 1000.0::DOUBLE AS churn_raw, errors + 0.05::DOUBLE * kinds AS risk FROM ({_USERS})),
    t AS (SELECT list_sort(list(churn_raw)) AS a, list_sort(list(risk)) AS b, count(*) AS n FROM u)
    SELECT user_id, commits, lines, churn_raw, risk, {_above("churn_raw", "a", "n")} AS impact, {_above("risk", "b", "n")} AS opportunity,
    {_above("churn_raw", "a", "n")} * {_above("risk", "b", "n")} AS score FROM u, t"""
)
def event_hotspots(spark, sf_dir):
    """The flagship: users by activity times errors."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = _t(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).cast("int").alias("commits"), F.sum(k).cast("int").alias("lines"), F.countDistinct("event_type").cast("int").alias("kinds"),
        F.count_if(F.col("event_type") == "error").cast("int").alias("errors"),
    )
    rows = rows.select("user_id", "commits", "lines", techdebt.churn_raw().alias("churn_raw"), (F.col("errors") + F.lit(0.05) * F.col("kinds")).alias("risk"))
    return techdebt.scored(rows, "churn_raw", "risk")


_URGENT = """SELECT c_custkey, c_acctbal, count(o_orderkey) FILTER (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')::INT AS urgent
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2"""


def _urgent(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey"))
    counts = orders.agg(F.count(F.lit(1)).cast("int").alias("urgent"))
    return _t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").join(counts, "c_custkey", "left").na.fill(0, ["urgent"])


@query(f"""WITH c AS ({_URGENT}), t AS (SELECT list_sort(list(urgent)) AS a, list_sort(list(c_acctbal)) AS b, count(*) AS n FROM c)
    SELECT c_custkey, {_above("urgent", "a", "n")} AS sparse, {_above("c_acctbal", "b", "n")} AS dense FROM c, t""")
def quintile_threshold(spark, sf_dir):
    rows = ordering.persisted(_urgent(spark, sf_dir))
    return rows.select("c_custkey", ordering.quintile_above(rows, "urgent").alias("sparse"), ordering.quintile_above(rows, "c_acctbal").alias("dense"))


@query(f"SELECT c_custkey, {_share('urgent')} AS sparse, {_share('c_acctbal')} AS dense FROM ({_URGENT})")
def quintile_cume(spark, sf_dir):
    rows = ordering.persisted(_urgent(spark, sf_dir))
    return rows.select("c_custkey", ordering.quintile_share(rows, "urgent").alias("sparse"), ordering.quintile_share(rows, "c_acctbal").alias("dense"))


_PARTS = "SELECT p_partkey, count(l_orderkey)::INT AS lines, count(DISTINCT l_suppkey)::INT AS suppliers FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1"
_SCORED = f"""WITH p AS ({_PARTS}), t AS (SELECT list_sort(list(lines)) AS a, list_sort(list(suppliers)) AS b, count(*) AS n FROM p),
    s AS (SELECT p_partkey, lines, suppliers, {_above("lines", "a", "n")} AS impact, {_above("suppliers", "b", "n")} AS opportunity FROM p, t)
    SELECT *, impact * opportunity AS score FROM s"""


def _parts(spark, sf_dir):
    items = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"))
    counts = items.agg(F.count(F.lit(1)).cast("int").alias("lines"), F.countDistinct("l_suppkey").cast("int").alias("suppliers"))
    rows = _t(spark, sf_dir, "part").select("p_partkey").join(counts, "p_partkey", "left").na.fill(0)
    return techdebt.scored(rows, "lines", "suppliers")


@query(_SCORED)
def techdebt_score(spark, sf_dir):
    return _parts(spark, sf_dir)


@query(f"SELECT * FROM ({_SCORED}) WHERE impact >= 4 AND opportunity >= 4")
def quadrant(spark, sf_dir):
    return techdebt.targets(_parts(spark, sf_dir))


@query(f"SELECT * FROM ({_SCORED}) WHERE impact >= 3 OR opportunity >= 3")
def kept_rows(spark, sf_dir):
    return techdebt.kept(_parts(spark, sf_dir))


@query(
    f"""WITH r AS (SELECT o_orderkey, any_value(o_orderpriority) AS workflow, any_value(o_orderstatus) AS st, abs(date_diff('day', any_value(o_orderdate)::DATE, max(l_shipdate)::DATE)) * 86400.0 AS s
        FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
    w AS (SELECT workflow, count(*)::INT AS runs, count(*) FILTER (st = 'O')::INT AS success, count(*) FILTER (st = 'F')::INT AS failure, count(*) FILTER (st = 'P')::INT AS cancelled,
        list_sort(list(s) FILTER (s IS NOT NULL)) AS d FROM r GROUP BY 1),
    h AS (SELECT workflow, runs, success, failure, cancelled, (runs - success - failure - cancelled)::INT AS other,
        CASE WHEN success + failure > 0 THEN round(failure / (success + failure)::DOUBLE, 3) ELSE 0 END AS failure_rate, round(d[len(d) // 2 + 1] / 60.0, 1)::DOUBLE AS p50_min FROM w)
    SELECT *, {_share("runs")} AS impact, {_share("failure_rate")} AS opportunity, {_share("runs")} * {_share("failure_rate")} AS score FROM h"""
)
def ci_health(spark, sf_dir):
    last = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last"))
    days = F.abs(F.datediff(F.to_date("last"), F.to_date("o_orderdate")))
    outcome = F.when(F.col("o_orderstatus") == "O", "success").when(F.col("o_orderstatus") == "F", "failure").when(F.col("o_orderstatus") == "P", "cancelled").otherwise("other")
    rows = _t(spark, sf_dir, "orders").join(last, "o_orderkey", "left")
    rows = rows.select(F.col("o_orderpriority").alias("workflow"), F.lit(True).alias("done"), outcome.alias("conclusion"), (days * 86400.0).alias("seconds"))
    return techdebt.scored(ci.health(rows), "runs", "failure_rate", ordering.quintile_share)


# --- text joins ------------------------------------------------------------------------------------------------------


@query(
    """WITH b AS (SELECT split_part(text, ' ', 1) AS term, sum(length(text))::BIGINT AS churn FROM benchmark GROUP BY 1),
    r AS (SELECT term, count(doc_id) AS refs FROM b LEFT JOIN documents d ON contains(d.text, b.term) GROUP BY 1)
    SELECT term, refs, round(churn / (1 + refs), 1) AS gap FROM b JOIN r USING (term)"""
)
def coverage_gap(spark, sf_dir):
    items = _t(spark, sf_dir, "benchmark").groupBy(F.split_part("text", F.lit(" "), F.lit(1)).alias("term")).agg(F.sum(F.length("text")).alias("churn"))
    refs = joins.mention_counts(_t(spark, sf_dir, "documents").select(F.col("text").alias("body")), items)
    return items.join(refs, "term").select("term", "refs", F.round(F.col("churn") / (1 + F.col("refs")), 1).alias("gap"))


@query(
    r"""WITH n AS (SELECT DISTINCT split_part(text, ' ', 1) AS base FROM benchmark WHERE regexp_matches(split_part(text, ' ', 1), '^[A-Za-z.]+$')),
    h AS (SELECT base, count(doc_id) AS hits FROM n LEFT JOIN documents ON contains(text, base)
        AND regexp_matches(text, '(^|[^\p{L}\p{N}\p{M}_/.])' || replace(base, '.', '\.') || '($|[^\p{L}\p{N}\p{M}_])') GROUP BY 1)
    SELECT base, hits FROM h"""
)
def evidence_mentions(spark, sf_dir):
    names = _t(spark, sf_dir, "benchmark").select(F.split_part("text", F.lit(" "), F.lit(1)).alias("base")).filter("base rlike '^[A-Za-z.]+$'")
    return joins.basename_mentions(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), names)


_ASCII_WORD = "[A-Za-z_][A-Za-z0-9_]*"


@query(
    f"""WITH w AS (SELECT doc_id, coalesce(toxic, 0) = 1 AS is_test, unnest(regexp_extract_all(text, '{_ASCII_WORD}')) AS word FROM documents LEFT JOIN labels USING (doc_id)),
    t AS (SELECT word, count(*) AS n, count(*) FILTER (NOT is_test) AS n_src FROM w GROUP BY 1),
    o AS (SELECT doc_id, word, is_test, count(*) AS own FROM w GROUP BY 1, 2, 3)
    SELECT doc_id, count(*) FILTER (n - own = 0)::BIGINT AS unused, count(*) FILTER (n - own > 0 AND n_src - CASE WHEN is_test THEN 0 ELSE own END = 0)::BIGINT AS test_only FROM o JOIN t USING (word) GROUP BY 1"""
)
def token_liveness(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    docs = docs.select("doc_id", (F.coalesce("toxic", F.lit(0)) == 1).alias("is_test"), F.regexp_extract_all("text", F.lit(_ASCII_WORD), 0).alias("words"))
    return deadcode.liveness(docs)


_BODY = r"""array_to_string(list_filter(string_split(replace(text, chr(13), ''), chr(10)), lambda x: NOT regexp_matches(x, '^\s*#')), chr(10))"""
_TAILS = ("yaml.load(f)", "yaml.load(f, Loader=SafeLoader)", "requests.get(url) or requests.post('u')", "urlopen('u')", "x = urlopen(u)")
_SCRIPT = "import { exec } from 'node:child_process'; exec(a); RX.exec(b); cp.spawnSync(c)"


def _matches(name: str) -> str:
    """SQL for the matches of a pattern. The regex engine has no lookahead: calls are counted without those that it rules out."""
    _, _, flags, regex = risk.PATTERNS[name]
    find = lambda r: f"""len(regexp_extract_all(body, '{("(?i)" if "i" in flags else "") + r.replace("'", "''")}'))"""
    if name == "yaml_unsafe":
        call = regex[: regex.index("(?!")]
        return f"({find(call)} - {find(call + '[^)]*Safe')})"
    if "(?!" in regex:  # white space before a quote can be given back, so only a quote at once rules a call out
        call = regex[: regex.index(r"\s*(?!")]
        return f"""({find(call)} - {find(call + "['" + '"]')})"""
    return find(regex)


def _lits(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query(
    f"""WITH t AS (SELECT doc_id, text || chr(10) || {_lits(_TAILS)}[1 + doc_id % {len(_TAILS)}] AS text FROM documents), d AS (SELECT doc_id, {_BODY} AS body FROM t),
    c AS (SELECT doc_id, {", ".join(f"{_matches(k)} AS {k}" for k in risk.PATTERNS)} FROM d)
    SELECT doc_id, literal_secret::INT AS literal_secret, yaml_unsafe::INT AS yaml_unsafe, ssrf_request::INT AS ssrf_request, urlopen::INT AS urlopen, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS spawned,
    ({" + ".join(f"{risk.PATTERNS[k][0]} * {k}" for k in risk.PATTERNS)} + CASE WHEN doc_id % 3 = 0 THEN 10 ELSE 0 END + 3 * (doc_id % 4))::DOUBLE AS vuln_raw FROM c"""
)
def risk_patterns(spark, sf_dir):
    """All patterns over every text and a line of code after it; process calls of a script; handlers without authentication."""
    tail = F.element_at(F.array(*map(F.lit, _TAILS)), (F.col("doc_id") % len(_TAILS)).cast("int") + 1)
    body = text.without_comments(F.concat("text", F.lit("\n"), tail), F.lit(True))
    script = F.when(F.col("doc_id") % 3 == 0, _SCRIPT).otherwise("exec(a)")
    docs = _t(spark, sf_dir, "documents").select("doc_id", body.alias("body"), risk.child_processes(script, F.lit(False)).alias("spawned"))
    found = risk.counts(F.col("body"), F.lit(True))
    shown = [found[k].alias(k) for k in ("literal_secret", "yaml_unsafe", "ssrf_request", "urlopen")]
    return docs.select("doc_id", *shown, "spawned", risk.score(found, F.col("spawned"), F.col("doc_id") % 4).alias("vuln_raw"))


_STEM = r"(CASE WHEN regexp_extract({0}, '[^/.][^/]*(\.[^/.]+)$', 1) = '' THEN string_split({0}, '/')[-1] ELSE left(string_split({0}, '/')[-1], length(string_split({0}, '/')[-1]) - length(regexp_extract({0}, '[^/.][^/]*(\.[^/.]+)$', 1))) END)"
_HREFS = """SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS spec FROM pages"""


def _hrefs(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("spec"))


@query(f"SELECT {_STEM.format('spec')} AS stem, count(*) AS n FROM ({_HREFS}) GROUP BY 1")
def import_specs(spark, sf_dir):
    return _hrefs(spark, sf_dir).groupBy(paths.stem(F.col("spec")).alias("stem")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH s AS (SELECT page_id, spec, {_STEM.format("spec")} AS stem FROM ({_HREFS})),
    d AS (SELECT split_part(text, ' ', 1) AS stem, any_value(doc_id) AS doc_id FROM documents GROUP BY 1 HAVING count(*) = 1)
    SELECT page_id, spec, doc_id FROM s JOIN d USING (stem)"""
)
def stem_resolve(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.split_part("text", F.lit(" "), F.lit(1)).alias("stem"), "doc_id")
    return _hrefs(spark, sf_dir).withColumn("stem", paths.stem(F.col("spec"))).join(joins.unique_values(docs, "stem", "doc_id"), "stem").select("page_id", "spec", "doc_id")


# --- clones ----------------------------------------------------------------------------------------------------------


def _functions(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").withColumn("toks", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).filter(F.size("toks") >= 40)
    doc = F.col("doc_id").cast("string")
    return docs.select(F.col("doc_id").alias("id"), doc.alias("file"), doc.alias("name"), F.lit(1).alias("line"), F.lit(1).alias("end"), F.col("n_chars").cast("int").alias("loc"), "toks")


_PAIRS = """d AS (SELECT doc_id, n_chars::INT AS loc, regexp_extract_all(text, '[A-Za-z]+') AS t FROM documents),
    s AS (SELECT DISTINCT doc_id, t[i:i + 4] AS s FROM (SELECT doc_id, t, unnest(range(1, len(t) - 3)) AS i FROM d WHERE len(t) >= 40)),
    k AS (SELECT s FROM s GROUP BY 1 HAVING count(*) BETWEEN 2 AND 25),
    h AS (SELECT * FROM s JOIN k USING (s)),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b FROM h a JOIN h b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING count(*) >= 8),
    z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    i AS (SELECT c.a, c.b, count(*) AS n FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND y.s = x.s GROUP BY 1, 2),
    p AS (SELECT a, b, i.n / (x.n + y.n - i.n)::DOUBLE AS similarity FROM i JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b)"""


@query(f"WITH {_PAIRS} SELECT a, b, similarity, similarity >= 0.999 AS exact FROM p WHERE similarity >= 0.8")
def clone_pairs(spark, sf_dir):
    pairs = drift.clone_pairs(_functions(spark, sf_dir), "ts")
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "similarity", "exact")


@query(
    f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM p WHERE similarity >= 0.8 AND similarity < 0.999 UNION SELECT b, a FROM p WHERE similarity >= 0.8 AND similarity < 0.999),
    r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen), l AS (SELECT node, min(seen) AS component FROM r GROUP BY 1)
    SELECT component, count(*)::INT AS size, max(loc)::INT AS max_loc, (count(*) * max(loc))::INT AS weight FROM l JOIN d ON d.doc_id = node GROUP BY 1"""
)
def clone_groups(spark, sf_dir):
    groups = drift.drift_groups(drift.clone_pairs(_functions(spark, sf_dir), "ts"))
    return groups.select("component", "size", "max_loc", "weight")


@query()
def clone_ratio(spark, sf_dir):
    pairs = drift.clone_pairs(_functions(spark, sf_dir), "py")
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "similarity", "exact")


# --- graphs ----------------------------------------------------------------------------------------------------------

_TRADE = """SELECT c.n_name AS src, s.n_name AS dst, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
    JOIN nation c ON c.n_nationkey = c_nationkey JOIN nation s ON s.n_nationkey = s_nationkey WHERE c.n_name <> s.n_name GROUP BY 1, 2"""
_THIN = f"e AS (SELECT src, dst FROM ({_TRADE}) WHERE n >= (SELECT quantile_disc(n, 0.8) FROM ({_TRADE})))"


def _trade(spark, sf_dir):
    nation = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    name = lambda key, out: nation.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(out))
    buyer = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    seller = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    items = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").join(buyer, "o_orderkey").join(seller, "l_suppkey")
    counts = items.groupBy("c_nationkey", "s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(name("c_nationkey", "src"), "c_nationkey").join(name("s_nationkey", "dst"), "s_nationkey").filter("src <> dst").select("src", "dst", "n")


def _thin(spark, sf_dir):
    trade = ordering.persisted(_trade(spark, sf_dir))
    least = trade.agg(F.expr("percentile_disc(0.8) within group (order by n)")).first()[0]
    return trade.filter(F.col("n") >= (least or 0)).select("src", "dst")


_REACH = "r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)"
_SCC = f"{_THIN}, {_REACH}, m AS (SELECT x.a AS node, least(x.a, min(x.b)) AS scc, count(DISTINCT x.b)::INT AS size FROM r x JOIN r y ON y.a = x.b AND y.b = x.a WHERE x.a <> x.b GROUP BY 1)"


@query(f"WITH RECURSIVE {_SCC} SELECT node, scc, (size + 1)::INT AS size FROM m")
def import_cycles(spark, sf_dir):
    return graph.strongly_connected(_thin(spark, sf_dir))


@query(f"WITH RECURSIVE {_SCC} SELECT node, scc, (size + 1)::INT AS size FROM m")
def import_cycles_distributed(spark, sf_dir):
    """The same components by forward and backward reachability, the way of graphs too large for one task."""
    return graph.strongly_connected(_thin(spark, sf_dir), small=-1)


@query(
    f"""WITH RECURSIVE {_SCC}, l AS (SELECT n_name AS module, r_name AS layer, n_regionkey AS rank FROM nation JOIN region ON r_regionkey = n_regionkey),
    v AS (SELECT src AS module, count(*) AS n FROM e JOIN l a ON a.module = src JOIN l b ON b.module = dst WHERE b.rank < a.rank OR (a.rank = 0 AND b.rank = 0) GROUP BY 1),
    x AS (SELECT l.module, layer, coalesce(i.n, 0)::INT AS fan_in, coalesce(o.n, 0)::INT AS fan_out, coalesce(v.n, 0)::INT AS n_violations, m.node IS NOT NULL AS in_cycle
        FROM l LEFT JOIN (SELECT dst AS module, count(*) AS n FROM e GROUP BY 1) i USING (module) LEFT JOIN (SELECT src AS module, count(*) AS n FROM e GROUP BY 1) o USING (module)
        LEFT JOIN v USING (module) LEFT JOIN m ON m.node = l.module),
    q AS (SELECT *, 3 * n_violations + CASE WHEN in_cycle THEN 2 ELSE 0 END + fan_out AS raw FROM x),
    b AS (SELECT *, {_share("fan_in")} AS impact, {_share("raw")} AS opportunity FROM q)
    SELECT module, layer, fan_in, fan_out, n_violations, in_cycle, impact, opportunity, impact * opportunity AS score FROM b WHERE impact > 2 OR n_violations > 0 OR in_cycle"""
)
def layer_violations(spark, sf_dir):
    layer = _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("layer"))
    nodes = _t(spark, sf_dir, "nation").join(layer, "n_regionkey").select(F.col("n_name").alias("module"), "layer", F.col("n_regionkey").alias("rank"), F.lit(True).alias("top_self"))
    rows, _ = arch.rank_graph(nodes, _thin(spark, sf_dir))
    return rows.select("module", "layer", "fan_in", "fan_out", F.size("violations").alias("n_violations"), "in_cycle", "impact", "opportunity", "score")


@query(f"""WITH {_THIN} SELECT n_name AS module, (SELECT count(*) FROM e WHERE dst = n_name)::BIGINT AS fan_in, (SELECT count(*) FROM e WHERE src = n_name)::BIGINT AS fan_out FROM nation""")
def fan_in_out(spark, sf_dir):
    ends = _thin(spark, sf_dir).select(F.explode(F.array(F.struct(F.col("dst").alias("module"), F.lit(1).alias("i")), F.struct(F.col("src").alias("module"), F.lit(0).alias("i")))).alias("x"))
    counts = ends.groupBy("x.module").agg(F.count_if(F.col("x.i") == 1).alias("fan_in"), F.count_if(F.col("x.i") == 0).alias("fan_out"))
    return _t(spark, sf_dir, "nation").select(F.col("n_name").alias("module")).join(counts, "module", "left").na.fill(0)


@query(
    f"""WITH RECURSIVE {_THIN}, s AS (SELECT min(src) AS node FROM e),
    w AS (SELECT node, 0 AS round FROM s UNION SELECT dst, round + 1 FROM w JOIN e ON src = node WHERE round < 4)
    SELECT node, min(round)::INT AS round FROM w GROUP BY 1"""
)
def auth_fixpoint(spark, sf_dir):
    edges = ordering.persisted(_thin(spark, sf_dir))
    return graph.closure(edges.agg(F.min("src").alias("node")), edges, 4)


# --- filters, ranks, text --------------------------------------------------------------------------------------------


@query(
    """WITH m AS (SELECT user_id, max(ts) AS changed FROM events WHERE event_type <> 'error' GROUP BY 1)
    SELECT e.user_id, count(*) AS standing FROM events e LEFT JOIN m USING (user_id) WHERE event_type = 'error' AND NOT coalesce(m.changed > e.ts, false) GROUP BY 1"""
)
def stale_audit(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    findings = events.filter("event_type = 'error'").select(F.col("user_id").alias("file"), F.col("ts").alias("at"))
    changes = events.filter("event_type <> 'error'").groupBy(F.col("user_id").alias("file")).agg(F.max("ts").alias("changed"))
    return joins.still_standing(findings, changes).groupBy(F.col("file").alias("user_id")).agg(F.count(F.lit(1)).alias("standing"))


@query("SELECT doc_id, source FROM documents SEMI JOIN labels USING (doc_id)")
def ghost_filter(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", "source").join(_t(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def shipped_anti(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", "source").join(_t(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


_EVIDENCE = f"""WITH d AS (SELECT doc_id::VARCHAR AS file, n_chars::DOUBLE AS churn_raw, length(text) - length(replace(text, ' ', '')) AS words,
        coalesce(quality, 0) AS issues, 0 AS audit, coalesce(toxic, 0) AS incidents FROM documents LEFT JOIN labels USING (doc_id)),
    t AS (SELECT list_sort(list(churn_raw)) AS a, list_sort(list(words)) AS b, count(*) AS n FROM d),
    s AS (SELECT *, {_above("churn_raw", "a", "n")} AS impact, 6 - {_above("words", "b", "n")} AS opportunity FROM d, t),
    b AS (SELECT *, impact * opportunity AS score, issues + 2 * audit + 3 * incidents AS evidence_raw FROM s WHERE impact >= 3),
    e AS (SELECT *, least(5, opportunity + CASE WHEN evidence_raw <= 0 THEN 0 WHEN evidence_raw <= 1 THEN 1 WHEN evidence_raw <= 2 THEN 2 WHEN evidence_raw <= 4 THEN 3 ELSE 4 END) AS new_opportunity,
        row_number() OVER (ORDER BY score DESC, churn_raw DESC, file) AS old_rank FROM b),
    f AS (SELECT *, impact * new_opportunity AS new_score, row_number() OVER (ORDER BY impact * new_opportunity DESC, evidence_raw DESC, churn_raw DESC, old_rank) AS new_rank FROM e)"""


@query(f"{_EVIDENCE} SELECT file, evidence_raw::INT AS evidence_raw, impact::INT AS impact, new_opportunity::INT AS new_opportunity, new_score::INT AS new_score, old_rank, new_rank, old_rank - new_rank AS delta_rank FROM f WHERE old_rank > new_rank AND evidence_raw > 0")
def evidence_rerank(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    words = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("string").alias("file"), F.col("n_chars").cast("double").alias("churn_raw"), words.alias("words"),
                       F.coalesce("quality", F.lit(0)).alias("issues"), F.lit(0).alias("audit"), F.coalesce("toxic", F.lit(0)).alias("incidents"))
    rows = techdebt.scored(rows, "churn_raw", "words").withColumn("opportunity", 6 - F.col("opportunity")).withColumn("score", F.col("impact") * F.col("opportunity"))
    return opportunity.movers(opportunity.reranked(rows)).select("file", "evidence_raw", "impact", "new_opportunity", "new_score", "old_rank", "new_rank", "delta_rank")


@query(
    """WITH l AS (SELECT conv_id, turn, role, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) + (first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) <> 'user')::INT AS block FROM conversations)
    SELECT conv_id::VARCHAR AS source, block::INT AS block, string_agg(CASE WHEN role = 'user' THEN '- ' ELSE '  ' END || role || turn, chr(10) ORDER BY turn) AS text FROM l GROUP BY 1, 2"""
)
def block_split(spark, sf_dir):
    line = F.concat(F.when(F.col("role") == "user", "- ").otherwise("  "), F.col("role"), F.col("turn").cast("string"))
    notes = _t(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("source")).agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    found = text.blocks(notes.select("source", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text")))
    # blocks are trimmed; give the first line of a block that no user opens its margin back
    return found.withColumn("text", F.when(F.startswith("text", F.lit("- ")), F.col("text")).otherwise(F.concat(F.lit("  "), F.col("text"))))


@query("SELECT o_orderkey, unnest([o_orderkey, o_custkey])::INT AS number FROM orders WHERE o_orderkey <> o_custkey UNION ALL SELECT o_orderkey, o_orderkey::INT FROM orders WHERE o_orderkey = o_custkey")
def issue_refs(spark, sf_dir):
    body = F.concat(F.lit("It closes #"), "o_orderkey", F.lit(", and #"), "o_custkey", F.lit("; see #1."))
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.explode(text.closed_issues(body)).alias("number"))


_NAMES = ("en", "de", "fr/1", "es")
_PATH = "list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '/'), lambda x: x <> '')"


@query(
    f"""WITH p AS (SELECT page_id, {_PATH} AS parts FROM pages), t AS (SELECT page_id, unnest(range(1, len(parts) + 1)) AS n, parts FROM p),
    h AS (SELECT page_id, max_by(array_to_string(parts[1:n], '/'), n) AS target FROM t WHERE array_to_string(parts[1:n], '/') IN {_NAMES} GROUP BY 1)
    SELECT page_id, target FROM p LEFT JOIN h USING (page_id)"""
)
def prefix_resolve(spark, sf_dir):
    parts = F.filter(F.split(F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1), "/"), lambda x: x != "")
    known = spark.range(len(_NAMES)).select(F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("id") + 1).cast("int")).alias("name"))
    return joins.longest_prefix(_t(spark, sf_dir, "pages").select("page_id", parts.alias("parts")), known, sep="/").select("page_id", "target")


@query(
    f"""WITH p AS (SELECT page_id, list_reverse({_PATH}) AS c FROM pages), t AS (SELECT page_id, unnest(c) AS name, unnest(range(len(c))) AS pos FROM p)
    SELECT p.page_id, (SELECT min_by(name, pos) FROM t WHERE t.page_id = p.page_id AND name IN {_NAMES}) AS target FROM p"""
)
def priority_resolve(spark, sf_dir):
    parts = F.reverse(F.filter(F.split(F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1), "/"), lambda x: x != ""))
    known = spark.range(len(_NAMES)).select(F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("id") + 1).cast("int")).alias("name"))
    return joins.first_existing(_t(spark, sf_dir, "pages").select("page_id", parts.alias("candidates")), known).select("page_id", "target")


_CAPS = {"techdebt": 8, "security": 8}


@query(
    f"""WITH t AS (SELECT 'techdebt' AS lens, p_partkey::VARCHAR AS file, 'score ' || score AS detail, row_number() OVER (ORDER BY score DESC, lines DESC, p_partkey::VARCHAR) AS k FROM ({_SCORED}) WHERE p_partkey % 7 <> 0),
    s AS (SELECT 'security' AS lens, p_partkey::VARCHAR AS file, 'size ' || p_size AS detail, row_number() OVER (ORDER BY p_size DESC, p_partkey::VARCHAR) AS k FROM part WHERE p_partkey % 7 <> 0)
    SELECT lens, 'parts' AS target, file, detail FROM (SELECT * FROM t UNION ALL SELECT * FROM s) WHERE k <= 8"""
)
def triage_union(spark, sf_dir):
    part, file = _t(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    debt = _parts(spark, sf_dir).withColumn("file", file)
    size = part.withColumn("file", file)
    skip = part.filter("p_partkey % 7 = 0").select(file.alias("file"))
    rows = [
        triage._rows(debt, "techdebt", "parts", [-F.col("score"), -F.col("lines")], F.format_string("score %d", "score")),
        triage._rows(size, "security", "parts", [-F.col("p_size")], F.format_string("size %d", "p_size")),
    ]
    return triage.capped_union([*rows, rows[0]], skip, _CAPS).select("lens", "target", "file", "detail")


@query(
    """WITH v AS (SELECT CASE WHEN conv_id % 3 = 0 THEN 'security' ELSE 'techdebt' END AS lens, CASE role WHEN 'user' THEN 'real' WHEN 'assistant' THEN 'already-fixed' ELSE 'false-positive' END AS status FROM conversations)
    SELECT section, lens, count(*) AS n FROM (SELECT status AS section, lens FROM v UNION ALL SELECT 'security', lens FROM v WHERE lens = 'security') GROUP BY 1, 2"""
)
def verdict_sections(spark, sf_dir):
    status = F.when(F.col("role") == "user", "real").when(F.col("role") == "assistant", "already-fixed").otherwise("false-positive")
    verdict = F.struct(status.alias("status"), F.lit("n/a").alias("klass"), F.col("text").alias("evidence"), F.lit(1).alias("priority"), F.lit("").alias("suggested_action"))
    rows = _t(spark, sf_dir, "conversations").select(F.when(F.col("conv_id") % 3 == 0, "security").otherwise("techdebt").alias("lens"), verdict.alias("verdict"))
    return triage.sections(triage.valid_verdicts(rows.fillna(""))).groupBy("section", "lens").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_mktsegment, position, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey)::INT AS position FROM customer) WHERE position <= 10")
def index_topn(spark, sf_dir):
    return ordering.top_per(_t(spark, sf_dir, "customer"), ["c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")], 10).select("c_mktsegment", "position", "c_custkey", "c_acctbal")


_KEPT = r"list_filter(string_split(replace(html, chr(13), ''), chr(10)), lambda x: regexp_matches(x, '\S') AND NOT regexp_matches(x, '^\s*(//|/?\*)'))"


@query(
    rf"""WITH p AS (SELECT page_id, html, {_KEPT} AS l FROM pages),
    c AS (SELECT page_id, len(l)::INT AS loc, len(regexp_extract_all(array_to_string(l, chr(10)), '\b(if|for|while|case|catch|switch)\b|&&|\|\||\?\?|\?\.'))::INT AS cc, len(regexp_extract_all(html, '=>'))::INT AS funcs FROM p)
    SELECT page_id, loc, cc, funcs, round(cc + 0.05::DOUBLE * loc, 1) AS raw FROM c"""
)
def ts_complexity(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", text.script_complexity(F.col("html")).alias("c")).select("page_id", "c.loc", "c.cc", "c.funcs", "c.raw")


@query(
    f"""WITH p AS (SELECT page_id, 'a/./b//../' || regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path FROM pages)
    SELECT page_id, regexp_extract(path, '[^/.][^/]*(\\.[^/.]+)$', 1) AS suffix, {_STEM.format("path")} AS stem,
    'a/' || array_to_string(list_filter(string_split(substr(path, 11), '/'), lambda x: x <> ''), '/') AS normal FROM p"""
)
def path_functions(spark, sf_dir):
    path = F.concat(F.lit("a/./b//../"), F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1))
    rows = _t(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return rows.select("page_id", paths.suffix(F.col("path")).alias("suffix"), paths.stem(F.col("path")).alias("stem"), paths.normal(F.col("path")).alias("normal"))


@query(
    """WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS s FROM documents)
    SELECT doc_id, CASE WHEN length(s) > 60 THEN left(s, 59) || '…' ELSE s END AS line FROM t"""
)
def squeezed_text(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.squeezed(F.col("text"), 60).alias("line"))


# --- lenses over a repository made of the driver's tables -----------------------------------------------------------------

_PATHS = (
    "src/routes/r{}.py", "tests/test_{}.py", "src/api/x{}_test.go", "src/lib/util{}.ts", "web/node_modules/a{}.js", "src/app/page.tsx", "app/models/m{}.py",
    "src/components/c{}.test.tsx", "conftest.py", "src/x{}/__init__.py", "lib/Auth{}.ts", "src/hooks/h{}.d.ts", "src/instrumentation.ts", "src/webhook/middleware.ts",
)
_RANKS = paths.layers(arch.LAYERS["py"])
_CONTAINS = lambda column, words: f"len(list_filter({_lits(words)}, lambda t: contains({column}, t))) > 0"
_TAG_SQL = {t: " OR ".join([_CONTAINS("lower(path)", p)] * bool(p) + [_CONTAINS("text", w)] * bool(w)) for t, (p, w) in deadcode.TAGS.items()}
_TAG_SQL["orm/pydantic-model"] += f" OR regexp_matches(text, '{deadcode.MODEL_CLASS[4:]}')"
_TAG_SQL["framework-entrypoint"] = f"""base IN {deadcode.ENTRYPOINTS} OR (ext IN {paths.SCRIPT} AND (stem IN {deadcode.ROOT_STEMS} OR (stem IN {deadcode.APP_STEMS} AND list_contains(segs[:-2], 'app'))))"""
_ROLE_SQL = {
    "auth": _CONTAINS("lower(path)", security.AUTH_PATHS), "input-handler": f"regexp_matches(text, '{security.REQUEST[4:]}')",
    "route": _CONTAINS("lower(path)", security.ROUTE_PATHS), "webhook": "contains(lower(path), 'webhook') OR contains(lower(text), 'webhook')",
}
_PICKED = lambda found: "list_filter([" + ", ".join(f"CASE WHEN {found[k]} THEN '{k}' END" for k in sorted(found)) + "], lambda x: x IS NOT NULL)"


@query(
    f"""WITH p AS (SELECT doc_id, text, replace({_lits(_PATHS)}[1 + doc_id % {len(_PATHS)}], '{{}}', doc_id::VARCHAR) AS path FROM documents),
    s AS (SELECT *, string_split(path, '/') AS segs, string_split(path, '/')[-1] AS base, regexp_extract(path, '[^/.][^/]*(\\.[^/.]+)$', 1) AS ext, {_STEM.format("path")} AS stem FROM p),
    l AS (SELECT *, list_filter(list_transform(list_concat(list_transform(segs[:-2], lambda x: lower(x)), [lower(stem)]), lambda x: CASE {" ".join(f"WHEN x = '{k}' THEN '{v[0]}:{v[1]}'" for k, v in _RANKS.items())} END), lambda x: x IS NOT NULL)[1] AS hit FROM s)
    SELECT doc_id, path, {_CONTAINS("path", paths.DENIED)} AS denied, {_CONTAINS("path", paths.GRAPH_DENIED_SCRIPT)} AS graph_denied, {_CONTAINS("path", paths.DRIFT_DENIED)} AS drift_denied,
        ext IN {paths.PYTHON + paths.SCRIPT} AS code, starts_with(path, 'src/') OR starts_with(path, 'lib/') AS under, regexp_matches(path, '{paths.NAMED_TEST}') AS named_test, regexp_matches(path, '{paths.TEST}') AS test,
        replace(regexp_replace(regexp_replace(regexp_replace(path, '^src/', ''), '\\.py$', ''), '/__init__$', ''), '/', '.') AS module, coalesce(split_part(hit, ':', 1), 'core') AS layer, split_part(hit, ':', 2)::INT AS rank,
        array_to_string({_PICKED(_ROLE_SQL)}, ',') AS roles, array_to_string({_PICKED(_TAG_SQL)}, ',') AS tags FROM l"""
)
def path_predicates(spark, sf_dir):
    """Which files each lens sees, and what it takes them for."""
    template = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("doc_id") % len(_PATHS)).cast("int") + 1)
    rows = _t(spark, sf_dir, "documents").select("doc_id", "text", F.replace(template, F.lit("{}"), F.col("doc_id").cast("string")).alias("path"))
    path, src, at = F.col("path"), F.col("text"), paths.layer_of(F.col("path"), _RANKS)
    entry = deadcode._by_convention(path)
    return rows.select(
        "doc_id", "path", paths.contains_any(path, paths.DENIED).alias("denied"), paths.contains_any(path, paths.GRAPH_DENIED_SCRIPT).alias("graph_denied"),
        paths.contains_any(path, paths.DRIFT_DENIED).alias("drift_denied"), paths.is_code(path).alias("code"), paths.under(path, ("src/", "lib/")).alias("under"),
        paths.is_named_test(path).alias("named_test"), paths.is_test(path).alias("test"), paths.module_name(path, "src/").alias("module"), at["label"].alias("layer"), at["rank"].alias("rank"),
        F.array_join(security.roles(path, src), ",").alias("roles"), F.array_join(deadcode._tags(path, src, entry), ",").alias("tags"),
    )


_FILES = "SELECT 'src/p' || page_id || CASE WHEN page_id % 7 = 0 THEN '.test' ELSE '' END || '.ts' AS file, html FROM pages"
_TOUCHES = "SELECT 'src/p' || (event_id % 400) || '.ts' AS file, count(*)::INT AS commits, coalesce(sum((props->>'k')::INT) FILTER (event_type <> 'error'), 0)::INT AS lines FROM events GROUP BY 1"
_DEBT = rf"""WITH f AS ({_FILES}), k AS (SELECT file, {_KEPT} AS l, html FROM f WHERE NOT contains(file, '.test.')),
    x AS (SELECT file, round(len(regexp_extract_all(array_to_string(l, chr(10)), '{text.BRANCH[4:]}')) + 0.05::DOUBLE * len(l), 1) AS raw FROM k),
    j AS (SELECT x.file, raw, coalesce(commits, 0)::INT AS commits, coalesce(lines, 0)::INT AS lines, coalesce(commits, 0) + coalesce(lines, 0) / 1000.0::DOUBLE AS churn_raw FROM x LEFT JOIN ({_TOUCHES}) t ON t.file = x.file),
    t AS (SELECT list_sort(list(churn_raw)) AS a, list_sort(list(raw)) AS b, count(*) AS n FROM j),
    d AS (SELECT file, commits, lines, churn_raw, raw, {_above("churn_raw", "a", "n")} AS impact, {_above("raw", "b", "n")} AS opportunity FROM j, t)"""


def _repo(spark, sf_dir):
    page = F.when(F.col("page_id") % 7 == 0, ".test").otherwise("")
    files = _t(spark, sf_dir, "pages").select(F.concat(F.lit("src/p"), "page_id", page, F.lit(".ts")).alias("path"), F.col("html").alias("src"))
    tests = _t(spark, sf_dir, "documents").select(F.concat(F.lit("tests/t"), "doc_id", F.lit(".md")).alias("path"), F.concat(F.lit("p"), F.col("doc_id") * 37 % 1000, F.lit(" "), "text").alias("src"))
    k = F.get_json_object("props", "$.k")
    touches = _t(spark, sf_dir, "events").select(k.alias("added"), F.when(F.col("event_type") == "error", "-").otherwise("0").alias("deleted"), F.concat(F.lit("src/p"), F.col("event_id") % 400, F.lit(".ts")).alias("raw_path"))
    return Repo(spark, files.union(tests), {"numstat": touches})


@query(f"{_DEBT} SELECT file, commits, lines, churn_raw, raw, impact, opportunity, impact * opportunity AS score FROM d")
def techdebt_lens(spark, sf_dir):
    """The whole lens: pages are its code files, events the commits that touch them."""
    return techdebt.techdebt(_repo(spark, sf_dir)).select("file", "commits", "lines", "churn_raw", F.col("complexity.raw").alias("raw"), "impact", "opportunity", "score")


@query(
    f"""{_DEBT}, h AS (SELECT *, {_STEM.format("file")} AS stem FROM d WHERE impact >= 4),
    b AS (SELECT 'p' || (doc_id * 37 % 1000) || ' ' || text AS body FROM documents UNION ALL SELECT html FROM f WHERE contains(file, '.test.')),
    r AS (SELECT stem, count(body) AS refs FROM (SELECT DISTINCT stem FROM h) LEFT JOIN b ON contains(body, stem) GROUP BY 1)
    SELECT file, round(churn_raw / (1 + refs), 1) AS gap, commits, impact, raw AS complexity_raw, refs::INT AS test_refs FROM h JOIN r USING (stem)"""
)
def coverage_lens(spark, sf_dir):
    """Churned pages over the texts, and tests beside them, that name them."""
    repo = _repo(spark, sf_dir)
    return techdebt.coverage(techdebt.techdebt(repo), techdebt.tests(repo.files))


@query(
    f"""WITH r AS (SELECT o_orderpriority AS workflow, o_orderkey % 11 <> 0 AS done, CASE o_orderstatus WHEN 'O' THEN 'success' WHEN 'F' THEN 'failure' ELSE 'cancelled' END AS st,
        CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_orderkey % 977)::DOUBLE END AS s FROM orders),
    w AS (SELECT workflow, count(*)::INT AS runs, count(*) FILTER (done AND st = 'success')::INT AS success, count(*) FILTER (done AND st = 'failure')::INT AS failure,
        count(*) FILTER (done AND st = 'cancelled')::INT AS cancelled, list_sort(list(s) FILTER (done AND s IS NOT NULL)) AS d FROM r GROUP BY 1),
    h AS (SELECT workflow, runs, success, failure, cancelled, round(failure / (success + failure)::DOUBLE, 3) AS failure_rate, round(d[len(d) // 2 + 1] / 60.0, 1)::DOUBLE AS p50_min FROM w)
    SELECT *, {_share("runs")} AS impact, {_share("failure_rate")} AS opportunity, {_share("runs")} * {_share("failure_rate")} AS score FROM h"""
)
def ci_lens(spark, sf_dir):
    """The whole lens: orders are runs with times as text, some unreadable, some not completed."""
    start = F.col("o_orderdate").cast("timestamp")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    end = F.when(F.col("o_orderkey") % 13 == 0, "soon").otherwise(iso(F.timestamp_seconds(F.unix_timestamp(start) + F.col("o_orderkey") % 977)))
    outcome = F.when(F.col("o_orderstatus") == "O", "success").when(F.col("o_orderstatus") == "F", "failure").otherwise("cancelled")
    runs = _t(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("workflowName"), outcome.alias("conclusion"), F.when(F.col("o_orderkey") % 11 == 0, "queued").otherwise("completed").alias("status"),
        iso(start).alias("createdAt"), end.alias("updatedAt"), F.lit("push").alias("event"),
    )
    return ci.ci(runs).drop("other")


@query(
    """WITH m AS (SELECT 'u' || user_id AS file, max(ts) AS changed FROM events WHERE event_type <> 'error' GROUP BY 1),
    e AS (SELECT 'u' || user_id AS file, CASE WHEN event_id % 5 = 0 THEN NULL ELSE date_trunc('second', ts) END AS stamp FROM events WHERE event_type = 'error')
    SELECT file, count(*)::INT AS audit FROM e LEFT JOIN m USING (file) WHERE NOT coalesce(changed > stamp, false) GROUP BY 1"""
)
def audit_counts(spark, sf_dir):
    """Findings with times as text, some unreadable, on files that did not change since."""
    events = _t(spark, sf_dir, "events")
    file = F.concat(F.lit("u"), "user_id").alias("file")
    stamp = F.when(F.col("event_id") % 5 == 0, "then").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    findings = events.filter("event_type = 'error'").select(file, stamp.alias("ts"))
    changes = events.filter("event_type <> 'error'").groupBy(file).agg(F.max("ts").alias("changed"))
    return opportunity.finding_counts(findings, changes)


@query(
    """SELECT 'o' || o_orderkey AS id, o_orderpriority || chr(10) || o_orderstatus AS text FROM orders o
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 4 UNION ALL SELECT l_orderkey + 1 FROM lineitem WHERE l_linenumber = 4)"""
)
def open_issue_texts(spark, sf_dir):
    """Orders are issues; lines are merged changes, of which some close two of them."""
    orders = _t(spark, sf_dir, "orders")
    issues = orders.select(F.col("o_orderkey").cast("int").alias("number"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("body"))
    key = F.col("l_orderkey")
    closes = F.concat(F.lit("Fixes #"), key, F.lit(" and #"), key + 1)
    pulls = _t(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") == 4, closes).otherwise(F.concat(F.lit("see #"), key)).alias("body"))
    return opportunity.open_issues(issues, pulls).select(F.concat(F.lit("o"), "id").alias("id"), "text")
