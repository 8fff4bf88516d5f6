"""Queries for clusters, partition plans, evidence and task reports, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions import names
from strataline.operators import clusters, evidence
from strataline.operators.ranking import first_per_group
from strataline.plans.registry import query

# Clusters: customers are candidates, nations repositories, segments roots; suppliers and parts are nodes.


@query("""WITH g AS (SELECT c_nationkey, c_mktsegment, count(*) AS size FROM customer GROUP BY 1, 2 HAVING count(*) >= 2) SELECT c_custkey, c_nationkey, c_mktsegment, size FROM customer JOIN g USING (c_nationkey, c_mktsegment)""")
def folder_clusters(table):
    return clusters.sharing(table("customer"), ["c_nationkey", "c_mktsegment"], "c_custkey")


_BRIDGE = "(SELECT s_suppkey AS n, s_nationkey AS o FROM supplier UNION ALL SELECT -1 - p_partkey, p_size FROM part)"


def _bridge(table) -> DataFrame:
    return table("supplier").select(F.col("s_suppkey").alias("n"), F.col("s_nationkey").alias("o")).unionByName(table("part").select((-1 - F.col("p_partkey")).alias("n"), F.col("p_size").alias("o")))


@query(f"""WITH e AS (SELECT DISTINCT l_suppkey AS s, -1 - l_partkey AS d FROM lineitem) SELECT DISTINCT a.o AS owner_a, b.o AS owner_b FROM e JOIN {_BRIDGE} a ON a.n = e.s JOIN {_BRIDGE} b ON b.n = e.d WHERE a.o <> b.o""")
def import_pairs(table):
    edges = table("lineitem").select(F.col("l_suppkey").alias("s"), (-1 - F.col("l_partkey")).alias("d"))
    return clusters.bridged_pairs(edges, _bridge(table), "s", "d", "n", "o")


@query("""SELECT o_custkey AS component, count(*) + 1 AS size FROM orders GROUP BY 1""")
def linked_clusters(table):
    pairs = table("orders").select("o_custkey", (F.col("o_orderkey") + 1_000_000_000).alias("order_node"))
    return clusters.linked(pairs, "o_custkey", "order_node").select("component", "size").distinct()


@query("""WITH t AS (SELECT l_partkey AS store, s_nationkey AS owner FROM lineitem JOIN supplier ON s_suppkey = l_suppkey UNION SELECT p_partkey, p_size + 100 FROM part),
n AS (SELECT store, count(*) AS size FROM t GROUP BY 1 HAVING count(*) >= 2) SELECT store, owner, size FROM t JOIN n USING (store)""")
def store_owners(table):
    own = table("part").select((-1 - F.col("p_partkey")).alias("n"), (F.col("p_size") + 100).alias("owner"))
    bridge = own.unionByName(table("supplier").select(F.col("s_suppkey").alias("n"), F.col("s_nationkey").alias("owner")))
    touches = table("lineitem").select(F.col("l_suppkey").alias("file"), (-1 - F.col("l_partkey")).alias("store"))
    stores = table("part").select((-1 - F.col("p_partkey")).alias("store"))
    return clusters.owners_by_store(touches, stores, bridge, "file", "store", "n", "owner").withColumn("store", -1 - F.col("store"))


_PLAN = """p AS (SELECT c_custkey, c_nationkey, component, ((row_number() OVER (PARTITION BY component ORDER BY c_custkey) - 1) // 16)::BIGINT AS chunk
FROM (SELECT c_custkey, c_nationkey, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS component FROM customer))"""
_LINKS = "SELECT c_custkey AS a, c_custkey + 1 AS b FROM customer WHERE c_acctbal > 9000"


def _plan(table) -> tuple[DataFrame, DataFrame]:
    customers = table("customer")
    # a link to the next customer, where it is of another nation and so merges nothing
    links = customers.filter("c_acctbal > 9000").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))
    nation = lambda end, name: customers.select(F.col("c_custkey").alias(end), F.col("c_nationkey").alias(name))
    links = links.join(nation("a", "na"), "a").join(nation("b", "nb"), "b").filter("na <> nb").select("a", "b")
    return clusters.partition_plan(customers, links, "c_custkey", "c_nationkey", "c_mktsegment", "a", "b"), links


@query(f"WITH {_PLAN} SELECT * FROM p")
def partition_plan(table):
    return _plan(table)[0]


@query(f"""WITH {_PLAN}, l AS (SELECT least((x.component, x.chunk), (y.component, y.chunk)) AS u, greatest((x.component, x.chunk), (y.component, y.chunk)) AS v
FROM ({_LINKS}) JOIN p x ON x.c_custkey = a JOIN p y ON y.c_custkey = b WHERE x.c_nationkey <> y.c_nationkey)
SELECT u[1] AS component_a, u[2] AS chunk_a, v[1] AS component_b, v[2] AS chunk_b, true AS crosses, count(*) AS links FROM l GROUP BY u, v""")
def boundary_links(table):
    return clusters.boundary_links(*_plan(table), "c_custkey", "c_nationkey", "a", "b")


_PATHS = "(SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path FROM pages)"
_ROOTS = "(SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS root, 'host' AS owner FROM pages UNION SELECT regexp_extract(url, '^[a-z]+://([^/?#]*/de)(/|$)', 1), 'german' FROM pages WHERE regexp_matches(url, '^[a-z]+://[^/?#]*/de(/|$)'))"


def _paths(table) -> tuple[DataFrame, DataFrame]:
    urls = table("pages").select("url")
    part = lambda pattern: F.regexp_extract("url", pattern, 1)
    hosts = urls.select(part("^[a-z]+://([^/?#]*)").alias("root"), F.lit("host").alias("owner"))
    german = urls.filter(F.col("url").rlike("^[a-z]+://[^/?#]*/de(/|$)")).select(part("^[a-z]+://([^/?#]*/de)(/|$)").alias("root"), F.lit("german").alias("owner"))
    return urls.select(part("^[a-z]+://([^?#]*)").alias("path")), hosts.unionByName(german).distinct()


@query(f"""SELECT path, CASE WHEN count(DISTINCT owner) = 1 THEN min(owner) END AS owner, count(DISTINCT owner) AS matches, CASE count(DISTINCT owner) WHEN 1 THEN 'resolved' WHEN 0 THEN 'unresolved' ELSE 'ambiguous' END AS status
FROM {_PATHS} LEFT JOIN {_ROOTS} ON path = root OR starts_with(path, root || '/') GROUP BY path""")
def path_owners(table):
    return clusters.containment(*_paths(table), "path", "root", "owner")


@query(f"SELECT DISTINCT a.owner AS \"outer\", b.owner AS \"inner\" FROM {_ROOTS} a JOIN {_ROOTS} b ON a.owner <> b.owner AND (starts_with(b.root, a.root || '/') OR (a.root = b.root AND a.owner < b.owner))")
def nested_roots(table):
    return clusters.nested_roots(_paths(table)[1], "root", "owner")


# Signals: event types are tools, users are repositories, amounts give the status.

_STATUS = "CASE WHEN value < 10 THEN 'skipped' WHEN value < 100 THEN 'complete' ELSE 'failed' END"


def _signals(table) -> DataFrame:
    return table("events").withColumn("status", F.when(F.col("value") < 10, "skipped").when(F.col("value") < 100, "complete").otherwise("failed"))


@query(f"""SELECT event_type, count(*) AS invocations, count(DISTINCT user_id) AS repositories, count(*) FILTER (s = 'complete') AS complete, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'skipped') AS skipped
FROM (SELECT *, {_STATUS} AS s FROM events) GROUP BY 1""")
def signal_counts(table):
    return evidence.signal_counts(_signals(table), "event_type", "user_id", "status", ["complete", "failed", "skipped"])


_LENSES = {"engagement": ["view", "click"], "revenue": ["purchase", "click"], "reliability": ["error"]}


@query("""SELECT lens, count(*) AS invocations, count(DISTINCT user_id) AS repositories FROM events JOIN (VALUES ('engagement', 'view'), ('engagement', 'click'), ('revenue', 'purchase'), ('revenue', 'click'), ('reliability', 'error')) l(lens, t) ON event_type = t GROUP BY 1""")
def lens_counts(table):
    return evidence.lens_counts(_signals(table), _LENSES, "event_type", "user_id")


@query("""SELECT v AS o_orderstatus, (SELECT count(*) FROM orders WHERE o_orderstatus = v) AS n FROM (VALUES ('F'), ('O'), ('P'), ('never')) t(v)""")
def disposition_totals(table):
    return evidence.zero_filled(table("orders"), "o_orderstatus", ["F", "O", "P", "never"])


@query("""WITH s AS (SELECT l_suppkey, l_partkey, bool_or(l_returnflag = 'R') AS i FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, count(*) FILTER (i) AS internal_sites, count(*) FILTER (NOT i) AS external_sites FROM s GROUP BY 1""")
def call_sites(table):
    return evidence.sites(table("lineitem"), "l_suppkey", "l_partkey", F.col("l_returnflag") == "R")


@query("""WITH e AS (SELECT user_id, event_type, count(*) FILTER (event_type <> 'error') AS want, count(*) FILTER (value >= 1 AND event_type <> 'error') AS have, count(*) FILTER (event_type = 'error' AND value > 200) AS bad FROM events GROUP BY 1, 2 HAVING want > 0 OR bad > 0)
SELECT user_id, CASE WHEN bool_or(have < want OR bad > 0) THEN 'partial' ELSE 'complete' END AS status FROM e GROUP BY 1""")
def coverage_status(table):
    e = table("events")
    files = e.filter("event_type <> 'error'")
    return evidence.coverage(files, files.filter("value >= 1"), e.filter("event_type = 'error' and value > 200"), "user_id", "event_type")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), '+') AS kinds, count(*) AS seen, string_agg(event_id::VARCHAR, '|' ORDER BY k) FILTER (k <= 3) AS evidence FROM r GROUP BY 1""")
def integration_candidates(table):
    return evidence.merged_candidates(table("events"), "user_id", "event_type", "event_id", [F.col("ts"), F.col("event_id")])


@query("""SELECT l_partkey, l_returnflag, l_orderkey, l_linenumber, rank::INT AS rank, total, total > 8 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_orderkey, l_linenumber) AS rank, count(*) OVER (PARTITION BY l_partkey, l_returnflag) AS total FROM lineitem) WHERE rank <= 8""")
def access_buckets(table):
    rows = table("lineitem").select("l_partkey", "l_returnflag", "l_orderkey", "l_linenumber")
    return evidence.buckets(rows, ["l_partkey", "l_returnflag"], [F.col("l_orderkey"), F.col("l_linenumber")])


# Findings: orders raise concerns about customers.

_RULES = [("urgent", [{"priority": ["1-URGENT"]}, {"priority": ["2-HIGH"], "status": ["F"]}]), ("open", [{"status": ["O"]}]), ("five", [{"priority_prefixes": ["5"], "status": ["F"]}])]


@query("""WITH m AS (SELECT o_orderkey, o_orderpriority = '1-URGENT' OR (o_orderpriority = '2-HIGH' AND o_orderstatus = 'F') AS u, o_orderstatus = 'O' AS o, o_orderpriority LIKE '5%' AND o_orderstatus = 'F' AS f FROM orders), n AS (SELECT *, u::BIGINT + o::BIGINT + f::BIGINT AS matched FROM m)
SELECT o_orderkey, CASE WHEN matched = 0 THEN 'unresolved' WHEN matched = 1 THEN CASE WHEN u THEN 'urgent' WHEN o THEN 'open' ELSE 'five' END END AS rule, matched FROM n""")
def rule_expansion(table):
    columns = {"priority": "o_orderpriority", "priority_prefixes": "o_orderpriority", "status": "o_orderstatus"}
    return evidence.expand_rules(table("orders"), _RULES, columns, "o_orderkey", "unresolved")


@query("""WITH j AS (SELECT coalesce(p, o_custkey) AS survivor, o_custkey, o_orderkey, o_orderpriority AS fact, o_orderstatus AS module FROM orders LEFT JOIN (SELECT c_custkey, c_custkey - 1 AS p FROM customer WHERE c_acctbal < 0 AND c_custkey > 0) ON c_custkey = o_custkey),
f AS (SELECT survivor, fact, module, min((o_custkey <> survivor, o_custkey, o_orderkey)) AS place FROM j GROUP BY 1, 2, 3) SELECT survivor, fact, module, row_number() OVER (PARTITION BY survivor ORDER BY place)::INT AS position FROM f""")
def merged_findings(table):
    findings = table("orders").select(F.col("o_custkey").alias("finding"), F.col("o_orderpriority").alias("fact"), F.col("o_orderstatus").alias("module"), "o_orderkey")
    merges = table("customer").filter("c_acctbal < 0 and c_custkey > 0").select(F.col("c_custkey").alias("finding"), (F.col("c_custkey") - 1).alias("into"))
    return evidence.merged_findings(findings, merges, "finding", "into", "fact", "module", "o_orderkey")


@query("""SELECT p_brand, count(DISTINCT p_type) AS definitions, count(DISTINCT p_type) > 1 AS conflict, CASE min(CASE WHEN p_size < 10 THEN 0 WHEN p_size < 30 THEN 1 ELSE 2 END) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence,
array_to_string(list_sort(list(DISTINCT p_name)), '|') AS aliases FROM part GROUP BY 1""")
def merged_definitions(table):
    parts = table("part").withColumn("sure", F.when(F.col("p_size") < 10, "low").when(F.col("p_size") < 30, "medium").otherwise("high"))
    return evidence.merged_definitions(parts, "p_brand", ["p_type"], "sure", {"low": 0, "medium": 1, "high": 2}, "p_name")


@query("""WITH h AS (SELECT DISTINCT o_custkey AS c, o_orderpriority AS q, o_orderkey AS k FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY c, q ORDER BY k) AS i FROM h),
f AS (SELECT c, q, string_agg(k::VARCHAR, '|' ORDER BY k) AS hits FROM r WHERE i <= 3 GROUP BY 1, 2)
SELECT c_custkey, question, CASE WHEN hits IS NOT NULL THEN 'confirmed' WHEN question IN ('1-URGENT', '2-HIGH') THEN 'no concern' ELSE 'unknown' END AS status, coalesce(hits, '') AS hits
FROM customer CROSS JOIN (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM')) v(question) LEFT JOIN f ON c = c_custkey AND q = question""")
def changeability(table):
    hits = table("orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("question"), "o_orderkey")
    return evidence.questions(table("customer"), hits, ["1-URGENT", "2-HIGH"], ["1-URGENT", "2-HIGH", "3-MEDIUM"], "c_custkey", "question", "o_orderkey")


@query("""SELECT l_partkey, count(DISTINCT l_suppkey) AS origins, count(DISTINCT l_suppkey) >= 2 AS corroborated FROM lineitem GROUP BY 1""")
def independent_origins(table):
    return evidence.independent_origins(table("lineitem"), "l_partkey", F.col("l_suppkey"))


@query("""SELECT p_brand, p_partkey, p_size, greatest(1, round_even(1000 * p_size / sum(p_size) OVER (PARTITION BY p_brand), 0)::BIGINT) AS words FROM part WHERE p_size > 0""")
def budget_shares(table):
    return evidence.budget_shares(table("part").select("p_brand", "p_partkey", "p_size"), "p_brand", "p_size", 1000)


@query("""WITH t AS (SELECT DISTINCT user_id, event_type FROM events) SELECT DISTINCT provider, user_id FROM (VALUES ('clicks', 'click'), ('clicks', 'view'), ('money', 'purchase')) p(provider, profile) JOIN t ON event_type = profile UNION SELECT 'all', user_id FROM events""")
def provider_selection(table):
    events = table("events")
    names = F.array(*[F.struct(F.lit(n).alias("provider"), F.array(*map(F.lit, p)).cast("array<string>").alias("profiles"), F.lit(not p).alias("universal")) for n, p in (("clicks", ["click", "view"]), ("money", ["purchase"]), ("all", []))])
    providers = events.sparkSession.range(1).select(F.inline(names))
    targets = events.groupBy("user_id").agg(F.collect_set("event_type").alias("profiles"))
    return evidence.selected_providers(providers, targets.withColumnRenamed("profiles", "found"), "provider", "profiles", "universal", "user_id", "found")


@query("""SELECT DISTINCT n_regionkey AS module, c_custkey AS fact FROM nation JOIN customer ON c_nationkey = n_nationkey""")
def module_facts(table):
    modules = table("nation").groupBy(F.col("n_regionkey").alias("module")).agg(F.collect_set("n_nationkey").alias("repos"))
    facts = table("customer").select(F.col("c_custkey").alias("fact"), F.col("c_nationkey").alias("repo"))
    return evidence.facts_of_modules(modules, facts, "module", "repos", "fact", "repo")


@query()
def relocation(table):
    talk = table("conversations").groupBy("conv_id")
    side = lambda f, name: talk.agg(f("text", "turn").alias(name)).withColumnRenamed(name, "text")
    return evidence.lost_blocks(table("conversations").select("conv_id", "text"), side(F.min_by, "a"), side(F.max_by, "b"), "conv_id", "text")


# Tasks: users are tasks and events their log.


@query("""WITH t AS (SELECT o_custkey, o_orderkey, 10 + length(o_orderpriority) AS tokens FROM orders), n AS (SELECT *, count(*) OVER w AS n, sum(tokens) OVER w AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM t WINDOW w AS (PARTITION BY o_custkey)),
k AS (SELECT *, CASE WHEN s <= 90 THEN 1 ELSE least(greatest(2, ceil(s / 90)::BIGINT), n) END AS k FROM n)
SELECT o_custkey, o_orderkey, tokens, (CASE WHEN i < (n % k) * (n // k + 1) THEN i // (n // k + 1) ELSE n % k + (i - (n % k) * (n // k + 1)) // (n // k) END)::BIGINT AS shard, k::BIGINT AS shards FROM k""")
def task_shards(table):
    units = table("orders").select("o_custkey", "o_orderkey", (F.length("o_orderpriority") + 10).cast("long").alias("tokens"))
    return evidence.shards(units, "o_custkey", "o_orderkey", "tokens", fixed=10, budget=100)


@query("""WITH g AS (SELECT *, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS generation FROM events),
a AS (SELECT *, count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id, generation ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS attempt FROM g),
e AS (SELECT user_id, generation, attempt, max(ts) FILTER (event_type = 'click') AS c, max(ts) FILTER (event_type = 'purchase') AS s FROM a WHERE attempt > 0 GROUP BY 1, 2, 3)
SELECT user_id, generation, attempt, CASE WHEN s >= c THEN floor(epoch(s))::BIGINT - floor(epoch(c))::BIGINT WHEN s < c THEN 0 END AS queue_seconds FROM e""")
def executions(table):
    found = evidence.executions(table("events"), "user_id", ["ts", "event_id"], "event_type", "ts", created="signup", claimed="click", submitted="purchase")
    return found.select("user_id", "generation", "attempt", "queue_seconds")


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type = 'purchase') WHERE k = 1""")
def latest_outputs(table):
    done = table("events").filter("event_type = 'purchase'")
    return first_per_group(done, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "value")


# References and prose.


@query("""SELECT page_id, coalesce(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '') || '@nogit:' || url || ':' || page_id || ':1' AS citation FROM pages""")
def citations(table):
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    return table("pages").select("page_id", names.citation(host, F.lit(""), F.col("url"), F.col("page_id"), F.lit(1)).alias("citation"))


@query("""SELECT url, replace(replace(replace(replace(url, '%', '%25'), ':', '%3A'), '/', '%2F'), '?', '%3F') AS key, url AS back FROM pages""")
def artifact_keys(table):
    key = names.artifact_key(F.col("url"))
    return table("pages").select("url", key.alias("key"), names.artifact_reference(key).alias("back"))


@query("""SELECT conv_id, turn, coalesce(array_to_string(list_transform(range(1, len(p)), lambda i: (list_sum(list_transform(p[1:i], lambda s: length(s))) + (i - 1) * 2)::BIGINT), ','), '') AS at
FROM (SELECT conv_id, turn, string_split(coalesce(text, ''), 'le') AS p FROM conversations)""")
def forbidden_words(table):
    found = names.occurrences(F.coalesce("text", F.lit("")), "le")
    return table("conversations").select("conv_id", "turn", F.array_join(F.transform(found, lambda x: x["at"].cast("string")), ",").alias("at"))


@query("""SELECT conv_id, turn, CASE WHEN octet_length(encode(text)) <= 40 THEN text END AS whole, least(40, octet_length(encode(text))) >= octet_length(encode(cut)) AND octet_length(encode(cut)) > least(36, octet_length(encode(text)) - 1) AS tight, starts_with(text, cut) AS prefix
FROM (SELECT *, (SELECT left(text, max(i)) FROM range(0, 41) r(i) WHERE octet_length(encode(left(text, i::BIGINT))) <= 40) AS cut FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations))""")
def byte_caps(table):
    rows = table("conversations").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("cut", names.byte_prefix(F.col("text"), 40))
    size, cut = F.octet_length("text"), F.octet_length("cut")
    tight = (F.least(F.lit(40), size) >= cut) & (cut > F.least(F.lit(36), size - 1))
    return rows.select("conv_id", "turn", F.when(size <= 40, F.col("text")).alias("whole"), tight.alias("tight"), F.col("text").startswith(F.col("cut")).alias("prefix"))


@query("""WITH m AS (SELECT p_name AS package, bool_or(p_size < 25) AS prod FROM part WHERE p_size < 40 GROUP BY 1) SELECT DISTINCT p_name || '/' || p_type AS spec, CASE WHEN prod THEN 'production' WHEN NOT prod THEN 'dev-test' ELSE 'unclassified' END AS class FROM part LEFT JOIN m ON package = p_name""")
def import_classes(table):
    parts = table("part")
    manifest = parts.filter("p_size < 40").select(F.col("p_name").alias("package"), F.when(F.col("p_size") < 25, "dependencies").otherwise("devDependencies").alias("section"))
    return evidence.import_classes(parts.select(F.concat_ws("/", "p_name", "p_type").alias("spec")), manifest, "spec", "package", "section")


@query("""WITH p AS (SELECT DISTINCT p_type || '/' || p_brand || '/' || p_name AS path, p_name AS b, p_brand || '/' || p_name AS t FROM part), g AS (SELECT b, count(*) AS n, count(DISTINCT t) AS d FROM p GROUP BY 1)
SELECT path, CASE WHEN n = 1 THEN b WHEN d = n THEN t ELSE path END AS reference FROM p JOIN g USING (b)""")
def short_references(table):
    return evidence.short_references(table("part").select(F.concat_ws("/", "p_type", "p_brand", "p_name").alias("path")), "path")


@query("""WITH l AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations WHERE contains(text, 'tion')) SELECT conv_id, turn, text, rank::INT AS rank, total, total > 2 AS truncated FROM l WHERE rank <= 2""")
def view_lines(table):
    return evidence.view_lines(table("conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text", "tion", 2)


@query("""SELECT user_id, event_type AS name, value::VARCHAR AS current, '' AS wanted, event_id::VARCHAR AS latest, '' AS type FROM events""")
def outdated_packages(table):
    report = F.to_json(F.create_map("event_type", F.struct(F.col("value").cast("string").alias("current"), F.col("event_id").cast("string").alias("latest"))))
    return evidence.outdated(table("events").select("user_id", report.alias("report")), "user_id", "report")
