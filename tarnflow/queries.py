"""Named queries over the test tables and, where SQL has the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnflow.functions import casts
from tarnflow.functions.types import FieldType, parse_type
from tarnflow.operators import candidates, drift, elements, extraction, nodes, probes, pruning, shapes
from tarnflow.plans import heal, lookups, many, runs
from tarnflow.plans.compiling import FieldSpec, SourceSpec, lock_rows
from tarnflow.plans.planner import drop_all_null, matched, parse_query, run_query
from tarnflow.sources import pages as page_source
from tarnflow.sources import state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def types(**fields: str) -> dict[str, FieldType]:
    return {n: parse_type(t) for n, t in fields.items()}


EVENTS = types(event_id="int", ts="datetime", user_id="int", event_type="enum[view, signup, error, click, purchase]", value="float", props="str")
ORDERS = types(o_orderkey="int", o_custkey="int", o_orderstatus="str | null", o_totalprice="float", o_orderdate="datetime", o_orderpriority="str")
CUSTOMER = types(c_custkey="int", c_name="str", c_nationkey="int", c_acctbal="float", c_mktsegment="str")
PART = types(p_partkey="int", p_name="str", p_brand="str", p_type="str", p_size="int", p_retailprice="float")
LINEITEM = types(l_orderkey="int", l_linenumber="int", l_quantity="float", l_extendedprice="float", l_discount="float", l_shipdate="datetime")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def flat(name: str, source: str, schema: dict[str, FieldType], params: dict, sql: str, ordinal: list[str] = (), prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Register a query of the flat grammar."""
    QUERIES[name] = lambda spark, sf_dir: run_query(prepare(table(spark, sf_dir, source)), params, schema, list(ordinal))
    ORACLE_SQL[name] = sql


def _null_status(df: DataFrame) -> DataFrame:
    return df.withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))


def _ranked(df: DataFrame) -> DataFrame:
    """One partition is given the page of a top-k: the ranks of its rows."""
    return df.withColumn("nth", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))


_NULL_ORDERS = "(SELECT * REPLACE (nullif(o_orderstatus, 'P') AS o_orderstatus) FROM orders)"
_O = "o_orderkey, o_orderstatus, o_totalprice"

flat("topk_events", "events", EVENTS, {"event_type": "error", "value__gt": "100", "sort": "-value", "limit": "20", "fields": "event_id,value"}, "SELECT event_id, value FROM events WHERE event_type = 'error' AND value > 100 ORDER BY value DESC, event_id LIMIT 20", ["event_id"])
flat("filter_eq", "orders", ORDERS, {"o_orderstatus": "F", "fields": "o_orderkey,o_orderstatus,o_totalprice"}, f"SELECT {_O} FROM orders WHERE o_orderstatus = 'F'")
flat("filter_ne_null", "orders", ORDERS, {"o_orderstatus__ne": "F", "fields": "o_orderkey,o_orderstatus"}, f"SELECT o_orderkey, o_orderstatus FROM {_NULL_ORDERS} WHERE o_orderstatus <> 'F'", prepare=_null_status)
flat("filter_in", "orders", ORDERS, {"o_orderpriority__in": "1-URGENT,5-LOW", "fields": "o_orderkey,o_orderpriority"}, "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
flat("filter_isnull", "orders", ORDERS, {"o_orderstatus__isnull": "true", "fields": "o_orderkey"}, f"SELECT o_orderkey FROM {_NULL_ORDERS} WHERE o_orderstatus IS NULL", prepare=_null_status)
flat("filter_notnull", "orders", ORDERS, {"o_orderstatus__isnull": "0", "fields": "o_orderkey"}, f"SELECT o_orderkey FROM {_NULL_ORDERS} WHERE o_orderstatus IS NOT NULL", prepare=_null_status)
for _op, _sign in (("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    flat(f"filter_{_op}", "lineitem", LINEITEM, {f"l_quantity__{_op}": "25", "fields": "l_orderkey,l_linenumber,l_quantity"}, f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {_sign} 25")
flat("filter_range_conjunction", "lineitem", LINEITEM, {"l_quantity__gte": "10", "l_quantity__lt": "12", "l_discount__gt": "0.05", "fields": "l_orderkey,l_linenumber"}, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 12 AND l_discount > 0.05")
flat("filter_datetime_day", "orders", ORDERS, {"o_orderdate__gte": "1997-01-01", "fields": "o_orderkey"}, "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
flat("filter_datetime_eq", "orders", ORDERS, {"o_orderdate": "1997-01-01", "fields": "o_orderkey"}, "SELECT o_orderkey FROM orders WHERE o_orderdate = TIMESTAMP '1997-01-01'")
flat("contains_text", "customer", CUSTOMER, {"c_name__contains": "CUSTOMER#0000000", "fields": "c_custkey,c_name"}, "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'customer#0000000')")
flat("contains_list", "part", types(p_partkey="int", words="list[str]"), {"words__contains": "blue", "fields": "p_partkey"}, "SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'blue')", prepare=lambda df: df.withColumn("words", F.split("p_name", " ")))
flat("search_q", "part", PART, {"q": "WIDGET", "fields": "p_partkey"}, "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'widget') OR contains(lower(p_brand), 'widget') OR contains(lower(p_type), 'widget')")
flat("search_q_list", "part", types(p_partkey="int", words="list[str]"), {"q": "RE", "fields": "p_partkey"}, "SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda w: contains(lower(w), 're'))) > 0", prepare=lambda df: df.withColumn("words", F.split("p_name", " ")))
flat("page_offset_limit", "orders", ORDERS, {"sort": "o_totalprice", "offset": "100", "limit": "50", "fields": "o_orderkey,o_totalprice"}, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 100", ["o_orderkey"])
flat("sort_multi_nulls_last", "orders", ORDERS, {"sort": "-o_orderstatus,o_totalprice", "limit": "1000", "fields": "o_orderkey,o_orderstatus"}, f"SELECT o_orderkey, o_orderstatus FROM {_NULL_ORDERS} ORDER BY lower(o_orderstatus) DESC NULLS LAST, o_totalprice, o_orderkey LIMIT 1000", ["o_orderkey"], _null_status)
flat("sort_datetime", "events", EVENTS, {"sort": "-ts", "limit": "25", "fields": "event_id"}, "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 25", ["event_id"])
flat("limit_zero", "orders", ORDERS, {"limit": "0", "fields": "o_orderkey"}, "SELECT o_orderkey FROM orders LIMIT 0")
flat("project_duplicates", "customer", CUSTOMER, {"fields": "c_custkey,c_name,c_custkey"}, "SELECT c_custkey, c_name FROM customer")


@query("SELECT row_number() OVER (ORDER BY lower(p_name), p_partkey) AS nth, p_partkey FROM part ORDER BY nth LIMIT 200")
def sort_text_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(run_query(table(spark, sf_dir, "part"), {"sort": "p_name", "limit": "200", "fields": "p_partkey"}, PART, ["p_partkey"]))


@query("SELECT count(*) AS matched FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'")
def matched_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, _ = parse_query({"o_totalprice__gt": "100000", "o_orderstatus": "O", "limit": "5"}, ORDERS)
    return matched(table(spark, sf_dir, "orders"), q, ORDERS).agg(F.count(F.lit(1)).alias("matched"))


@query("SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'P') IS NOT NULL OR nullif(o_orderpriority, '5-LOW') IS NOT NULL")
def drop_null_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _null_status(table(spark, sf_dir, "orders")).withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return drop_all_null(df, ["o_orderstatus", "o_orderpriority"]).select("o_orderkey")


# ----------------------------------------------------------------------- casts


@query("SELECT p_partkey, TRY_CAST(nullif(regexp_extract(p_brand, '[-+]?[0-9]+', 0), '') AS BIGINT) AS n, TRY_CAST(nullif(regexp_extract('$' || CAST(p_size AS VARCHAR) || '.5 each', '[0-9]+[.][0-9]+', 0), '') AS DOUBLE) AS x FROM part")
def cast_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part")
    return df.select("p_partkey", casts.to_int(F.col("p_brand")).alias("n"), casts.to_float(F.concat(F.lit("$"), F.col("p_size").cast("string"), F.lit(".5 each"))).alias("x"))


@query("SELECT doc_id, CASE WHEN quality = 1 THEN true ELSE false END AS good, CASE WHEN toxic = 1 THEN true END AS bad FROM labels")
def cast_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "labels")
    word = F.when(F.col("toxic") == 1, " YES ").otherwise("perhaps")
    return df.select("doc_id", casts.to_bool(F.col("quality").cast("string")).alias("good"), casts.to_bool(word).alias("bad"))


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN upper(event_type) END AS kind FROM events")
def cast_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", casts.cast_column(F.concat(F.lit(" "), F.col("event_type")), parse_type("enum[VIEW, CLICK] | null")).alias("kind"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT00:00:00') AS named, strftime(o_orderdate, '%Y-%m-%dT00:00:00') AS iso, CAST(NULL AS VARCHAR) AS none FROM orders")
def cast_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "MMM d, yyyy")
    return table(spark, sf_dir, "orders").select("o_orderkey", casts.to_datetime(day).alias("named"), casts.to_datetime(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("iso"), casts.to_datetime(F.date_format("o_orderdate", "yyyy")).alias("none"))


@query("SELECT doc_id, nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') AS body FROM documents")
def cast_str(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", casts.cast_column(F.col("text"), parse_type("str | null")).alias("body"))


# ------------------------------------------------------------ shapes and drift


@query(r"""SELECT shape, count(*) AS n FROM (SELECT '^' || replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(c_name, '[0-9]+', chr(57344), 'g'), '\p{L}+', chr(57345), 'g'), '\s+', chr(57346), 'g'), '([#\-.])', '\\\1', 'g'), chr(57344), '\d+'), chr(57345), '[^\W\d_]+'), chr(57346), '\s+') || '$' AS shape FROM customer) GROUP BY shape""")
def value_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(shapes.value_shape(F.col("c_name")).alias("shape")).groupBy("shape").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_nationkey, avg(CASE WHEN regexp_matches(c_mktsegment, '^[A-Z]+$') THEN 1.0 ELSE 0.0 END) AS ratio FROM customer GROUP BY c_nationkey")
def shape_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(shapes.shape_ratio(F.col("c_mktsegment"), F.lit("^[A-Z]+$")).alias("ratio"))


@query("SELECT user_id, max_by(event_type, ROW(n, -f)) AS usual FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) GROUP BY user_id")
def usual_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.most_frequent(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id", "usual")


@query("SELECT user_id, count(*) AS n, round(list_reduce(list(value ORDER BY event_id), lambda a, x: 0.3 * x + 0.7 * a), 6) AS ema FROM events GROUP BY user_id")
def ema_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.ema_by_key(table(spark, sf_dir, "events"), "user_id", "value", "event_id").withColumn("ema", F.round("ema", 6))


def _event_stats(events: DataFrame) -> DataFrame:
    """Each event type as a field, its values as matches: statistics with the columns that drift takes."""
    half = F.col("event_id") % 2 == 0
    return events.groupBy(F.lit("events").alias("source"), F.col("event_type").alias("field")).agg(
        F.count(F.lit(1)).alias("items"), F.count(F.when(half, 1)).alias("match_count"), F.count(F.when(~half, 1)).alias("null_count"), F.count(F.when(F.col("value") > 150, 1)).alias("cast_fail"), F.avg((F.col("value") < 100).cast("double")).alias("shape_ratio"), F.lit(1.0).alias("similarity"), F.avg(F.length("props")).alias("len_mean")
    )


@query("""SELECT event_type AS field, array_to_string(list_filter([
        CASE WHEN bad / n > 0.2 THEN 'schema-fail ' || bad || '/' || n END,
        CASE WHEN half / (n * 1.5) < 0.5 THEN 'cardinality ' || printf('%.1f', half / (n * 1.5)) || 'x baseline' END,
        CASE WHEN (n - half) / n > 0.2 AND (n - half) / n > 3 * 0.1 THEN 'null-rate ' || printf('%.0f', (n - half) * 100.0 / n) || '%' END], lambda x: x IS NOT NULL), '; ') AS causes
    FROM (SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 2 = 0) AS half, count(*) FILTER (value > 150) AS bad FROM events GROUP BY event_type)""")
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _event_stats(table(spark, sf_dir, "events")).withColumn("shape_ratio", F.lit(1.0))
    locks = stats.select("source", "field", F.lit(1).alias("min_items"), F.lit(False).alias("nullable"), F.lit(False).alias("loose"), (F.col("items") * 1.5).alias("match_count_ema"), F.lit(0.1).alias("null_rate_ema"))
    return drift.drifted(stats, locks).select("field", F.array_join("causes", "; ").alias("causes"))


@query("""SELECT page_id, label, least(1.0, greatest(0.0, 1.0 - 0.2 * len(regexp_extract_all(label, ':nth-child')) - 0.4 * len(regexp_extract_all(label, '[.]css-')) + CASE WHEN contains(label, '#') THEN 0.05 ELSE 0 END - CASE WHEN regexp_matches(label, '[.#]') THEN 0 ELSE 0.35 END))::DOUBLE AS score
    FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'article > h1' WHEN 1 THEN 'nav > ul > li:nth-child(' || n || ')' WHEN 2 THEN '.css-' || page_id || ' > p' ELSE '#p' || page_id END AS label FROM (SELECT page_id, len(regexp_extract_all(html, '<li>')) AS n FROM pages))""")
def selector_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One selector for each page, spelled from what the page has."""
    page, n = F.col("page_id"), F.regexp_count("html", F.lit("<li>")).cast("string")
    label = F.when(page % 4 == 0, "article > h1").when(page % 4 == 1, F.concat(F.lit("nav > ul > li:nth-child("), n, F.lit(")"))).when(page % 4 == 2, F.concat(F.lit(".css-"), page.cast("string"), F.lit(" > p"))).otherwise(F.concat(F.lit("#p"), page.cast("string")))
    return table(spark, sf_dir, "pages").select("page_id", label.alias("label")).withColumn("score", shapes.robustness(F.col("label")))


_MARKED = " OR ".join(f"contains(lower(substr(html, 1, 4096)), '{m}')" for m in page_source.CHALLENGES)
_HOST = "regexp_extract(url, '://([^/?#]*)', 1)"


# ------------------------------------------------------------------- pages


@query(f"""SELECT page_id, CASE
        WHEN {_MARKED} THEN 'challenge'
        WHEN regexp_extract(url, '://([^/?#]*)', 1) <> 'example.com' AND regexp_extract(url, '://([^/?#]*)', 1) <> '' THEN 'off-host'
        WHEN length(html) < 0.2 * 4000 THEN 'collapsed' ELSE 'ok' END AS verdict FROM pages""")
def classify_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = page_source.block_reason(F.lit(200), F.col("html"), F.col("url"), F.lit("example.com"), F.lit(4000.0))
    verdict = F.when(reason.isNull(), "ok").when(reason.startswith("challenge"), "challenge").when(reason.startswith("redirected off-host"), "off-host").when(reason.startswith("content"), "collapsed").otherwise(reason)
    return table(spark, sf_dir, "pages").select("page_id", verdict.alias("verdict"))


@query("SELECT c_custkey, 'https://x.test/c/' || replace(c_mktsegment, ' ', '%20') || '?nation=' || c_nationkey AS url FROM customer")
def url_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", page_source.bind_url("https://x.test/c/{segment}", {"segment": F.col("c_mktsegment"), "nation": F.col("c_nationkey"), "empty": F.lit("")}).alias("url"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS links, CAST(len(regexp_extract_all(html, '<h1[ >]')) AS BIGINT) AS heads FROM pages")
def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes.page_nodes(table(spark, sf_dir, "pages")).where(nodes.matches(F.col("path"), "a[href], h1"))
    tag = F.element_at("path", -1)["tag"]
    return found.groupBy("page_id").agg(F.count(F.when(tag == "a", 1)).alias("links"), F.count(F.when(tag == "h1", 1)).alias("heads"))


_NAV = {"label": (parse_type("str"), extraction.Selector("a")), "target": (parse_type("url"), extraction.Selector("a", "href")), "links": (parse_type("list[str]"), extraction.Selector("a", "href"))}


def _decoded(x: str) -> str:
    """SQL of a text with the entities that the pages use."""
    for entity, sign in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&#x27;", "chr(39)"), ("&amp;", "'&'")):
        x = f"replace({x}, '{entity}', {sign})"
    return x


_ITEMS_SQL = f"""WITH parts AS (SELECT page_id, string_split(regexp_extract(html, '<nav><ul>(.*?)</ul></nav>', 1), '<li>')[2:] AS li FROM pages),
        each_ AS (SELECT page_id, unnest(li) AS x, unnest(range(1, len(li) + 1)) AS nth FROM parts),
        items AS (SELECT page_id, nth, {_decoded("regexp_extract(x, '>([^<]*)</a>', 1)")} AS label, {_decoded("regexp_extract(x, 'href=.([^>]*).>', 1)")} AS href FROM each_)"""


@query(_ITEMS_SQL + " SELECT page_id, nth, label, 'https://base.test' || href AS target, href AS links FROM items")
def extract_nav_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.extract(nodes.page_nodes(table(spark, sf_dir, "pages")), "nav li", _NAV, F.lit("https://base.test/"))
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("item"))
    return found.select("page_id", nth.cast("long").alias("nth"), "label", "target", F.array_join("links", ",").alias("links"))


@query(_ITEMS_SQL + """ SELECT field, count(*) AS items, count(*) AS match_count, 0 AS null_count, 0 AS cast_fail, avg(length(CASE WHEN field = 'label' THEN label ELSE href END)) AS len_mean FROM items, (VALUES ('label'), ('target'), ('links')) f(field) GROUP BY field""")
def extraction_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = extraction.extract_raw(nodes.page_nodes(table(spark, sf_dir, "pages")), "nav li", _NAV)
    return extraction.field_statistics(raw, {n: ft for n, (ft, _) in _NAV.items()}, F.lit("https://base.test/"))


def _listing(part: DataFrame, head: str, size: str) -> DataFrame:
    """Invented pages, 20 parts each, whose classes depend on the design: page_id, url, status, html."""
    row = F.concat(F.lit(f"<article class='part'><h2 class='{head}'>"), "p_name", F.lit(f"</h2><div class='meta'><span class='{size}'>"), F.col("p_size").cast("string"), F.lit(" units</span><b class='key'>"), F.col("p_partkey").cast("string"), F.lit("</b></div></article>"))
    listed = part.groupBy(F.floor(F.col("p_partkey") / 20).cast("long").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("row")))).alias("rows"))
    return listed.select("page_id", F.lit("https://x.test/").alias("url"), F.lit(200).alias("status"), F.concat(F.lit("<html><body><main>"), F.array_join(F.transform("rows", lambda r: r["row"]), ""), F.lit("</main></body></html>")).alias("html"))


_PARTS = {"p_partkey": (parse_type("int"), extraction.Selector(".key")), "p_name": (parse_type("str"), extraction.Selector("h2.head")), "p_size": (parse_type("int"), extraction.Selector(".meta > .size")), "gone": (parse_type("int | null"), extraction.Selector(".gone"))}


@query("SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size FROM part")
def extract_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed items of invented pages are the rows that the pages were made of."""
    return extraction.extract(nodes.page_nodes(_listing(table(spark, sf_dir, "part"), "head", "size")), "article.part", _PARTS).select("p_partkey", "p_name", "p_size")


@query("""SELECT field, n AS scopes, CASE WHEN field IN ('gone') THEN 0 ELSE n END AS matched_scopes, CASE WHEN field = 'text_as_int' THEN 0 ELSE n END AS cast_ok, CASE WHEN field = 'text_as_int' THEN n ELSE 0 END AS cast_fail, field NOT IN ('gone', 'text_as_int') AS passed
    FROM (SELECT count(*) AS n FROM part), (VALUES ('p_partkey'), ('p_name'), ('p_size'), ('gone'), ('text_as_int')) f(field)""")
def probe_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = _PARTS | {"text_as_int": (parse_type("int"), extraction.Selector("h2.head"))}
    got = probes.probe(nodes.page_nodes(_listing(table(spark, sf_dir, "part"), "head", "size")), "article.part", tries)
    return got.select("field", "scopes", "matched_scopes", "cast_ok", "cast_fail", probes.passes(F.col("field") == "gone").alias("passed"))


@query("""SELECT p_partkey // 20 AS page_id, css, count(*) AS n, max(depth)::DOUBLE AS mean_depth, 1.0::DOUBLE AS robust, max(nth) AS rank
    FROM part, (VALUES ('article.part', 3, 1), ('div.meta', 4, 2)) c(css, depth, nth) GROUP BY 1, 2 HAVING count(*) >= 3""")
def item_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each invented page the repeated elements that hold others, the outer ones first."""
    return candidates.item_candidates(nodes.page_nodes(_listing(table(spark, sf_dir, "part"), "head", "size")))


@query("""SELECT 'article.part' AS css, count(*) AS n, count(DISTINCT p_partkey // 20) AS pages FROM part WHERE p_partkey // 20 IN (SELECT p_partkey // 20 FROM part GROUP BY 1 HAVING count(*) >= 3)""")
def item_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = candidates.item_candidates(nodes.page_nodes(_listing(table(spark, sf_dir, "part"), "head", "size"))).where("rank = 1")
    return best.groupBy("css").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pages"))


@query(r"""SELECT 'p_size' AS field, 'span' AS tag, 'size' AS class_tokens, 'div.meta<article.part<main' AS ancestor_sig, '^\d+\s+[^\W\d_]+$' AS value_shape,
        count(*) / count(DISTINCT p_partkey // 20) AS match_count_ema, 0.0::DOUBLE AS null_rate_ema, avg(length(CAST(p_size AS VARCHAR)) + 6) AS len_mean FROM part""")
def field_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = probes.fingerprints(nodes.page_nodes(_listing(table(spark, sf_dir, "part"), "head", "size")), "article.part", {"p_size": _PARTS["p_size"]})
    return got.withColumn("class_tokens", F.array_join("class_tokens", ",")).drop("samples")


@query("SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size FROM part")
def repair_redesign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors and fingerprints of one design, a run over pages of another: drift is found, repaired, and all items come out."""
    part = table(spark, sf_dir, "part")
    spec = SourceSpec("parts", {"p_partkey": FieldSpec(parse_type("int"), "key"), "p_name": FieldSpec(parse_type("str"), "head"), "p_size": FieldSpec(parse_type("int"), "size")}, min_items=1)
    locks = lock_rows(nodes.page_nodes(_listing(part, "head", "size")), "article.part", spec, {n: (_PARTS[n][1], []) for n in spec.fields})
    done = runs.run_source(spark, spec, "article.part", locks, _listing(part, "title", "stock"))
    return done.items.select("p_partkey", "p_name", "p_size")


@query("""WITH asked AS (SELECT c_custkey AS request_id, c_mktsegment AS segment, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_nationkey END AS nation FROM customer),
        seen AS (SELECT *, 'https://x.test/n/' || nation || '?segment=' || segment AS url FROM asked),
        page AS (SELECT url, min(request_id) AS page_id FROM seen WHERE url IS NOT NULL GROUP BY url)
    SELECT request_id, seen.url, page_id, CASE WHEN nation IS NULL THEN 'error' WHEN segment = 'MACHINERY' THEN 'blocked' WHEN segment = 'FURNITURE' THEN 'not_found' ELSE 'ok' END AS status,
        CASE WHEN nation IS NULL THEN 'missing parameters: nation' WHEN segment = 'MACHINERY' THEN 'http 503' END AS error,
        CAST(CASE WHEN segment IN ('HOUSEHOLD', 'AUTOMOBILE') AND nation > 0 THEN 1 ELSE 0 END AS BIGINT) AS count FROM seen LEFT JOIN page ON seen.url = page.url""")
def lookup_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request for each customer, against invented pages of (nation, segment): statuses, shared pages and counts of items."""
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_nationkey")).alias("nation"))
    source = SourceSpec("nations", {"nation": FieldSpec(parse_type("int"), "number")}, min_items=0)
    spec = lookups.LookupSpec(source, "https://x.test/n/{nation}", {"nation": "", "segment": ""}, not_found={"title_contains": "no such"})

    def fetch(urls: DataFrame) -> DataFrame:
        nation, segment = F.regexp_extract("url", r"/n/(\d+)", 1), F.regexp_extract("url", r"segment=(\w+)", 1)
        hit = F.when(nation != "0", F.concat(F.lit("<p class='hit'>nation <b>"), nation, F.lit("</b></p>"))).otherwise("")
        html = F.when(segment == "FURNITURE", "<title>No such page</title>").otherwise(F.concat(F.lit("<title>Nations</title>"), hit))
        return urls.select("url", F.col("url").alias("url_final"), F.when(segment == "MACHINERY", 503).otherwise(200).alias("status"), html.alias("html"), F.lit(None).cast("string").alias("error"))

    lock = {"source": "nations", "field": "nation", "field_order": 0, "css": "b", "attr": "text", "fallbacks": [], "status": heal.VERIFIED}
    return lookups.lookup(spark, spec, ".hit", [lock], asked, fetch).requests


@query()
def field_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.field_candidates(nodes.page_nodes(table(spark, sf_dir, "pages")), "li", parse_type("url"), "target of the link", "target", F.lit("https://base.test/"))


# ------------------------------------------------------------------- state


@query("SELECT event_id, user_id, nth FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 5")
def ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.ring_buffer(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id").select("event_id", "user_id", "nth")


@query("SELECT c.c_custkey, c.c_nationkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM customer o WHERE o.c_nationkey = c.c_nationkey AND o.c_mktsegment = c.c_mktsegment AND o.c_custkey % 10 = 0 AND o.c_custkey <> c.c_custkey)")
def free_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("source"), F.col("c_custkey").alias("field"), F.col("c_mktsegment").alias("css"), F.lit("text").alias("attr"))
    return drift.free_selectors(df, df.where(F.col("field") % 10 == 0)).select(F.col("field").alias("c_custkey"), F.col("source").alias("c_nationkey"))


@query("""SELECT CAST(page_id AS VARCHAR) AS source, field, 'li:nth-child(' || nth || ')' AS css, 'text' AS attr, 2 AS rung
    FROM (SELECT page_id, len(regexp_extract_all(html, '<li>')) AS n FROM pages), (VALUES ('first', 2), ('second', 3)) f(field, nth) WHERE n >= nth""")
def heal_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fields of each page compete for the places of its list, of which the first does not pass: the first field takes the second place, the other one the next."""
    places = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("source"), F.explode(F.sequence(F.lit(0), F.regexp_count("html", F.lit("<li>")))).alias("nth")).where("nth > 0")
    fields = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.lit(k).alias("field_order")) for k, n in enumerate(("first", "second"))]))
    able = places.select("source", "nth", fields.alias("f")).select("source", "f.field", "f.field_order", F.lit(2).alias("rung"), F.col("nth").alias("rank"), F.concat(F.lit("li:nth-child("), F.col("nth").cast("string"), F.lit(")")).alias("css"), F.lit("text").alias("attr"), (F.col("nth") > 1).alias("passed"))
    return heal.choose(able, able.select("source", "field", F.lit("none").alias("css"), "attr").distinct())


@query(f"""WITH given AS (SELECT {_HOST} AS source, html, coalesce({_MARKED}, false) AS marked FROM pages),
        each_ AS (SELECT source, marked, trim(CASE WHEN length(source) % 2 = 0 THEN regexp_extract(html, '<title>(.*?)</title>', 1) ELSE regexp_extract(html, '<h1>(.*?)</h1>', 1) END) AS heading, len(regexp_extract_all(html, '<li><a href=')) AS links FROM given)
    SELECT source, CASE WHEN bool_and(marked) THEN 'blocked' ELSE 'ok' END AS status, CASE WHEN bool_and(marked) THEN 2 ELSE 0 END AS exit_code, count(*) FILTER (NOT marked) AS n_pages,
        count(*) FILTER (NOT marked AND heading <> '') AS headings, coalesce(sum(links) FILTER (NOT marked), 0)::BIGINT AS links, min(length(replace(replace(replace(replace(replace(heading, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'))) FILTER (NOT marked AND heading <> '')::BIGINT AS shortest FROM each_ GROUP BY source""")
def run_all_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every host is a source with selectors of its own, rows of a table; all of them are one run."""
    pages = table(spark, sf_dir, "pages").withColumn("source", F.try_parse_url("url", F.lit("AUTHORITY"))).withColumn("status", F.lit(200))
    hosts = runs.stored(pages.select("source").distinct())
    css = F.when(F.length("source") % 2 == 0, "head > title").otherwise("article > h1:first-of-type")
    kinds = F.array(*[F.struct(F.lit(n).alias("field"), F.lit(k).alias("field_order"), F.lit(is_list).alias("is_list"), c.alias("css"), F.lit(a).alias("attr")) for k, (n, is_list, c, a) in enumerate([("heading", False, css, "text"), ("links", True, F.lit("nav > ul > li > a[href]"), "href")])])
    each = hosts.select("source", F.explode(kinds).alias("f")).select("source", "f.*")
    none = F.expr("array()").cast("array<string>")
    fields = each.select("source", "field", "field_order", F.lit("str").alias("base"), F.lit(True).alias("nullable"), "is_list", none.alias("members"), F.lit(True).alias("manual"), none.alias("post"), F.lit(1).alias("min_items"), F.lit(True).alias("loose"), F.col("source").alias("origin_host"))
    fixed = {"fallbacks": F.expr("array()").cast("array<struct<css:string,attr:string>>"), "status": F.lit(heal.VERIFIED), "confirm_runs": F.lit(0), "heal_count": F.lit(0), "value_shape": F.lit(""), "samples": none, "tag": F.lit(""), "class_tokens": none, "ancestor_sig": F.lit("")}
    fixed |= {c: F.lit(None).cast("double") for c in ("match_count_ema", "null_rate_ema", "len_mean")}
    locks = each.withColumns(fixed).select(*[c.split()[0] for c in state.LOCKS.split(", ")])
    states = hosts.select("source", F.lit(None).cast("string").alias("item"), F.lit(None).cast("double").alias("content_len"))
    done = many.run_all(spark, fields, locks, states, pages)
    values = done.items.groupBy("source").agg(F.count("value").alias("headings"), F.sum(F.size("values")).alias("links"), F.min(F.length("value")).cast("long").alias("shortest"))
    zero = F.lit(0).cast("long")
    return done.sources.join(values, "source", "left").select("source", "status", "exit_code", "n_pages", F.coalesce("headings", zero).alias("headings"), F.coalesce("links", zero).alias("links"), "shortest")


@query("""WITH parts AS (SELECT page_id, string_split(regexp_extract(html, '<nav><ul>(.*?)</ul></nav>', 1), '<li>')[2:] AS li FROM pages),
        each_ AS (SELECT page_id, len(li) AS n, unnest(li) AS x, unnest(range(1, len(li) + 1)) AS nth FROM parts)
    SELECT page_id, count(*) AS items, count(*) FILTER (nth % 2 = 1) AS odd, min(CASE WHEN nth = n THEN regexp_extract(x, 'href="([^"]*)"', 1) END) AS last_link, count(*) FILTER (nth > 1) AS after_first FROM each_ GROUP BY page_id""")
def select_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places among siblings by selectors that are data: odd ones, the last one, those after the first."""
    rules = {"items": ("nav li", "text"), "odd": ("nav li:nth-child(odd)", "text"), "last_link": ("nav li:last-child > a", "href"), "after_first": ("nav li:first-child ~ li", "text")}
    rows = spark.createDataFrame([("pages", None, n, css, attr, None, False) for n, (css, attr) in rules.items()], elements.RULES)
    found = elements.extract_rules(table(spark, sf_dir, "pages").withColumn("source", F.lit("pages")), rows)
    count = lambda n: F.max(F.when(F.col("field") == n, F.col("n_nodes"))).cast("long").alias(n)
    got = found.groupBy("page_id").agg(count("items"), count("odd"), F.first(F.when(F.col("field") == "last_link", F.try_element_at("raws", F.lit(1))), True).alias("last_link"), count("after_first"))
    return got.where("items > 0")


@query("""WITH each_ AS (SELECT p_partkey // 20 AS page_id, p_partkey, '<article class="part"><h2 class="head">' || p_name || '</h2><div class="meta"><span class="size">' || p_size || ' units</span><b class="key">' || p_partkey || '</b></div></article>' AS one,
        row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) AS nth FROM part)
    SELECT page_id, string_agg(one, chr(10) || '<!-- region -->' || chr(10) ORDER BY p_partkey) AS region FROM each_ WHERE nth <= 8 GROUP BY page_id""")
def value_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surroundings of values of a known shape, for a prompt: of each invented page the first items."""
    listed = _listing(table(spark, sf_dir, "part"), "head", "size")
    return pruning.page_regions(listed.withColumns({"samples": F.expr("array('', null)"), "shape": F.lit(r"^\d+\s+units$")}))
