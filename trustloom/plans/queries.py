"""Queries over the driver's tables and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, tags
from ..operators import emit, event_metrics, graph, intern, query, relational, store, user_metrics
from ..operators.query import Filter
from ..schema import EVENT, FOLLOWS
from ..sources import adapters
from . import reputation

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

EV = """ev AS (SELECT event_id AS id, user_id AS pubkey, epoch_us(ts) // 1000000 AS created_at, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value,
  CASE event_type WHEN 'signup' THEN 3 WHEN 'view' THEN 1 WHEN 'click' THEN 7 WHEN 'error' THEN 1984 ELSE 9735 END AS kind FROM events),
tag AS (SELECT id, pubkey, kind, created_at, 1 AS pos, 'Pubkey' AS label, k AS node, CAST(NULL AS BIGINT) AS amount FROM ev WHERE kind IN (3, 1984)
  UNION ALL SELECT id, pubkey, kind, created_at, 1, 'Mention', k, NULL FROM ev WHERE kind IN (7, 9735)
  UNION ALL SELECT id, pubkey, kind, created_at, 1, CASE id % 3 WHEN 0 THEN 'Reply' ELSE 'RootReply' END, k, NULL FROM ev WHERE kind = 1 AND id % 3 < 2
  UNION ALL SELECT id, pubkey, kind, created_at, 2, 'Pubkey', k, NULL FROM ev WHERE kind = 9735
  UNION ALL SELECT id, pubkey, kind, created_at, 3, 'PubkeyUpper', pubkey, NULL FROM ev WHERE kind = 9735
  UNION ALL SELECT id, pubkey, kind, created_at, 4, 'Bolt11', NULL, CAST(floor(value) AS BIGINT) FROM ev WHERE kind = 9735)"""


def _norm(r: str) -> str:
    return f"CASE WHEN {r} <= 0 THEN 0 ELSE CAST(round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE * (1.0::DOUBLE - pow(0.24::DOUBLE / ({r} / 6e6::DOUBLE + 0.24::DOUBLE), 0.38::DOUBLE))))) AS BIGINT) END"


def _pagerank_sql(n: int, edges: str = "SELECT pubkey AS src, node AS dst FROM tag WHERE kind = 3 AND label = 'Pubkey'") -> str:
    out = [
        f"pe AS MATERIALIZED (SELECT src, dst, count(*) AS m FROM ({edges}) WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY src, dst)",
        "pd AS MATERIALIZED (SELECT src, CAST(sum(m) AS BIGINT) AS d FROM pe GROUP BY src)",
        "pn AS MATERIALIZED (SELECT src AS node FROM pe UNION SELECT dst FROM pe)",
        "r0 AS MATERIALIZED (SELECT node, CAST(6000000 AS BIGINT) AS rank FROM pn)",
    ]
    for i in range(n):
        out.append(
            f"r{i + 1} AS MATERIALIZED (SELECT pn.node, CAST(1000000 + coalesce(s.x, 0) AS BIGINT) AS rank FROM pn LEFT JOIN "
            f"(SELECT dst, sum(((5 * rank) // (6 * d)) * m) AS x FROM pe JOIN pd USING (src) JOIN r{i} ON r{i}.node = pe.src GROUP BY dst) s ON s.dst = pn.node)"
        )
    return ", ".join(out)


def query_(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


ev = adapters.events
FLAGSHIP = f"""WITH {EV}, {_pagerank_sql(20)}, s AS (SELECT node AS pubkey, {_norm('rank')} AS rank FROM r20)
SELECT row_number() OVER (ORDER BY rank DESC, pubkey DESC) AS position, pubkey, rank FROM (SELECT * FROM s ORDER BY rank DESC, pubkey DESC LIMIT 10)"""


@query_("flagship_trust_topk", FLAGSHIP)
def flagship(s: SparkSession, d: str) -> DataFrame:
    return reputation.trust_top(ev(s, d))


query_("edges", f"WITH {EV} SELECT kind, pubkey AS src, node AS dst, label FROM tag WHERE label <> 'Bolt11'")(lambda s, d: graph.edges(ev(s, d)))
query_("follows", f"WITH {EV} SELECT pubkey AS src, node AS dst FROM tag WHERE kind = 3 AND label = 'Pubkey'")(lambda s, d: graph.follows(ev(s, d)))
query_("tag_keys", f"WITH {EV} SELECT label, node, id FROM tag WHERE label <> 'Bolt11'")(lambda s, d: graph.tag_keys(ev(s, d)))
query_("p_tags", f"WITH {EV} SELECT id, node AS pubkey FROM tag WHERE label = 'Pubkey'")(lambda s, d: graph.p_tags(ev(s, d)))
query_("event_predicates", f"""WITH {EV}, r AS (SELECT DISTINCT id FROM tag WHERE label IN ('Reply', 'RootReply'))
SELECT kind, kind = 1 AS note, (kind = 1111 OR r.id IS NOT NULL) AS reply, (kind = 1 AND r.id IS NULL) AS root_post, kind = 1984 AS report, count(*) AS n
FROM ev LEFT JOIN r USING (id) GROUP BY ALL""")(
    lambda s, d: ev(s, d).groupBy("kind", tags.is_note(F.col("kind")).alias("note"), tags.is_reply(F.col("kind"), F.col("tags")).alias("reply"), tags.is_root_post(F.col("kind"), F.col("tags")).alias("root_post"), (F.col("kind") == 1984).alias("report")).agg(F.count("*").alias("n"))
)
query_("time_buckets", f"WITH {EV} SELECT created_at // 86400 AS day, CAST((created_at // 3600) % 24 AS INTEGER) AS hour, count(*) AS n FROM ev GROUP BY ALL")(
    lambda s, d: ev(s, d).groupBy(scores.day(F.col("created_at")).alias("day"), scores.hour(F.col("created_at")).alias("hour")).agg(F.count("*").alias("n"))
)


@query_("author_topics", "SELECT source AS pubkey, lower(lang) AS topic, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL")
def author_topics(s: SparkSession, d: str) -> DataFrame:
    docs = adapters.table(s, d, "documents").where("source is not null and lang is not null")
    parsed = docs.select("source", tags.parse_tags(F.to_json(F.array(F.array(F.lit("t"), F.upper("lang"))))).alias("tags"))
    named = parsed.select(F.col("source").alias("pubkey"), F.transform("tags", lambda t: F.struct(t["label"].alias("label"), t["value"].alias("node"))).alias("tags"))
    return graph.author_topics(named).groupBy("pubkey", F.decode("topic", "utf-8").alias("topic")).agg(F.count("*").alias("n"))


query_("total_events", "SELECT count(*) AS events FROM events")(lambda s, d: store.engagement_weight(ev(s, d)))
query_("pagerank_20", f"WITH {EV}, {_pagerank_sql(20)} SELECT node, rank FROM r20")(lambda s, d: graph.pagerank(graph.follows(ev(s, d)), 20))
query_("pagerank_normalized", f"WITH {EV}, {_pagerank_sql(30)} SELECT node AS pubkey, {_norm('rank')} AS rank FROM r30")(lambda s, d: user_metrics.normalized_ranks(graph.pagerank(graph.follows(ev(s, d)), 30)))
query_("graph_orders_pagerank", f"WITH {_pagerank_sql(10, 'SELECT o_custkey AS src, -l_suppkey - 1 AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey')} SELECT node, rank FROM r10")(
    lambda s, d: graph.pagerank(adapters.purchases_graph(s, d), 10)
)


def _k_core_sql(k: int, rounds: int) -> str:
    out = [
        "ke AS MATERIALIZED (SELECT pubkey AS src, node AS dst, count(*) AS m FROM tag WHERE kind = 3 AND label = 'Pubkey' AND pubkey IS NOT NULL AND node IS NOT NULL GROUP BY ALL)",
        "a0 AS MATERIALIZED (SELECT src AS node FROM ke UNION SELECT dst FROM ke)",
    ]
    for i in range(rounds):
        out.append(f"a{i + 1} AS MATERIALIZED (SELECT dst AS node FROM ke WHERE src IN (SELECT node FROM a{i}) AND dst IN (SELECT node FROM a{i}) GROUP BY dst HAVING sum(m) >= {k})")
    return ", ".join(out)


query_("k_core_8", f"WITH {EV}, {_k_core_sql(8, 6)} SELECT node FROM a6")(lambda s, d: graph.k_core(graph.follows(ev(s, d)), 8))

_AUTHOR = f"WITH {EV}, x AS (SELECT ev.*, (kind = 1111 OR id IN (SELECT id FROM tag WHERE label IN ('Reply', 'RootReply'))) AS reply FROM ev WHERE kind <> 3)"
_ZAP = f"""WITH {EV}, z AS (SELECT p.pubkey, u.node AS sender, p.node AS recipient, b.amount, b.created_at // 86400 AS day
  FROM tag p JOIN tag u ON u.id = p.id AND u.label = 'PubkeyUpper' JOIN tag b ON b.id = p.id AND b.label = 'Bolt11' WHERE p.kind = 9735 AND p.label = 'Pubkey' AND b.amount IS NOT NULL)"""
_SENT = "SELECT sender AS pubkey, CAST(sum(a) AS BIGINT) AS zap_amt_sent, CAST(sum(n) AS BIGINT) AS zap_cnt_sent, CAST(sum(a) // count(*) AS BIGINT) AS zap_avg_amt_day_sent FROM (SELECT sender, day, sum(amount) AS a, count(*) AS n FROM z WHERE sender IS NOT NULL GROUP BY ALL) GROUP BY sender"
_RECD = "SELECT recipient AS pubkey, CAST(sum(a) AS BIGINT) AS zap_amt_recd, CAST(sum(n) AS BIGINT) AS zap_cnt_recd, CAST(coalesce(sum(a) // nullif(count(nullif(a, 0)), 0), 0) AS BIGINT) AS zap_avg_amt_day_recd FROM (SELECT recipient, day, sum(amount) AS a, count(*) AS n FROM z WHERE recipient IS NOT NULL GROUP BY ALL) GROUP BY recipient"


def _rest(s: SparkSession, d: str) -> DataFrame:
    return ev(s, d).where(F.col("kind") != FOLLOWS)


def _authored(*columns: str) -> Query:
    return lambda s, d: user_metrics.authored(_rest(s, d)).select("pubkey", *columns)


query_("first_created_at", f"{_AUTHOR} SELECT pubkey, min(created_at) AS first_created_at FROM x GROUP BY pubkey")(_authored("first_created_at"))
query_("post_cnt", f"{_AUTHOR} SELECT pubkey, count(*) FILTER (kind = 1 AND NOT reply) AS post_cnt FROM x GROUP BY pubkey")(_authored("post_cnt"))
query_("reply_cnt", f"{_AUTHOR} SELECT pubkey, count(*) FILTER (reply) AS reply_cnt FROM x GROUP BY pubkey")(_authored("reply_cnt"))
query_("reactions_cnt", f"{_AUTHOR} SELECT pubkey, count(*) FILTER (kind = 7) AS reactions_cnt FROM x GROUP BY pubkey")(_authored("reactions_cnt"))
query_("active_hours", f"{_AUTHOR} SELECT pubkey, min((created_at // 3600) % 24) AS active_hours_start, max((created_at // 3600) % 24) AS active_hours_end FROM x GROUP BY pubkey")(_authored("active_hours_start", "active_hours_end"))
query_("reports_sent", f"{_AUTHOR} SELECT pubkey, count(*) FILTER (kind = 1984) AS reports_cnt_sent FROM x GROUP BY pubkey")(_authored("reports_cnt_sent"))
query_("reports_recd", f"WITH {EV} SELECT node AS pubkey, count(*) AS reports_cnt_recd FROM tag WHERE kind = 1984 AND label = 'Pubkey' GROUP BY node")(lambda s, d: user_metrics.reports_received(_rest(s, d)))
query_("zap_sent", f"{_ZAP} {_SENT}")(lambda s, d: user_metrics.zaps_sent(user_metrics.zaps(_rest(s, d))))
query_("zap_recd", f"{_ZAP} {_RECD}")(lambda s, d: user_metrics.zaps_received(user_metrics.zaps(_rest(s, d))))
query_("follower_cnt", f"""WITH {EV}, {_pagerank_sql(20)}, nr AS (SELECT node, {_norm('rank')} AS v FROM r20)
SELECT dst AS pubkey, count(*) AS follower_cnt FROM (SELECT DISTINCT src, dst FROM pe) WHERE src IN (SELECT node FROM nr WHERE v >= 8) GROUP BY dst""")(
    lambda s, d: user_metrics.follower_counts(graph.follows(ev(s, d)), user_metrics.normalized_ranks(graph.pagerank(graph.follows(ev(s, d)), 20)))
)

_USERS = f"""{_ZAP}, x AS (SELECT ev.*, (kind = 1111 OR id IN (SELECT id FROM tag WHERE label IN ('Reply', 'RootReply'))) AS reply FROM ev WHERE kind <> 3),
{_pagerank_sql(20)}, nr AS (SELECT node AS pubkey, {_norm('rank')} AS rank FROM r20),
fc AS (SELECT dst AS pubkey, count(*) AS follower_cnt FROM (SELECT DISTINCT src, dst FROM pe) WHERE src IN (SELECT pubkey FROM nr WHERE rank >= 8) GROUP BY dst),
au AS (SELECT pubkey, min(created_at) AS first_created_at, count(*) FILTER (kind = 1 AND NOT reply) AS post_cnt, count(*) FILTER (reply) AS reply_cnt, count(*) FILTER (kind = 7) AS reactions_cnt,
  count(*) FILTER (kind = 1984) AS reports_cnt_sent, min((created_at // 3600) % 24) AS active_hours_start, max((created_at // 3600) % 24) AS active_hours_end FROM x GROUP BY pubkey),
rr AS (SELECT node AS pubkey, count(*) AS reports_cnt_recd FROM tag WHERE kind = 1984 AND label = 'Pubkey' GROUP BY node),
zs AS ({_SENT}), zr AS ({_RECD}),
everyone AS (SELECT pubkey FROM nr UNION SELECT pubkey FROM fc UNION SELECT pubkey FROM au UNION SELECT pubkey FROM rr UNION SELECT pubkey FROM zs UNION SELECT pubkey FROM zr),
ua AS (SELECT pubkey, coalesce(follower_cnt, 0) AS follower_cnt, coalesce(post_cnt, 0) AS post_cnt, coalesce(reply_cnt, 0) AS reply_cnt, coalesce(reactions_cnt, 0) AS reactions_cnt,
  coalesce(zap_amt_recd, 0) AS zap_amt_recd, coalesce(zap_amt_sent, 0) AS zap_amt_sent, coalesce(zap_cnt_recd, 0) AS zap_cnt_recd, coalesce(zap_cnt_sent, 0) AS zap_cnt_sent,
  coalesce(zap_avg_amt_day_recd, 0) AS zap_avg_amt_day_recd, coalesce(zap_avg_amt_day_sent, 0) AS zap_avg_amt_day_sent, coalesce(reports_cnt_recd, 0) AS reports_cnt_recd, coalesce(reports_cnt_sent, 0) AS reports_cnt_sent,
  rank, first_created_at, active_hours_start, active_hours_end
  FROM everyone LEFT JOIN nr USING (pubkey) LEFT JOIN fc USING (pubkey) LEFT JOIN au USING (pubkey) LEFT JOIN rr USING (pubkey) LEFT JOIN zs USING (pubkey) LEFT JOIN zr USING (pubkey) WHERE pubkey IS NOT NULL)"""


def _users(s: SparkSession, d: str) -> DataFrame:
    return reputation.users(ev(s, d), 20)


query_("user_assertions", f"{_USERS} SELECT * FROM ua")(_users)
_TOP = "SELECT row_number() OVER (ORDER BY {m} DESC, pubkey DESC) AS position, pubkey, {m} FROM (SELECT pubkey, {m} FROM ua WHERE {m} IS NOT NULL ORDER BY {m} DESC, pubkey DESC LIMIT 500)"
query_("list_ranks", f"{_USERS} {_TOP.format(m='rank')}")(lambda s, d: reputation.top_ranks(ev(s, d), 20))
query_("list_followers", f"{_USERS} {_TOP.format(m='follower_cnt')}")(lambda s, d: reputation.top_followers(ev(s, d), 20))

_EVENTS = f"""WITH {EV}, g AS (
  SELECT node AS event, 'c' AS w, 0 AS amount FROM tag WHERE kind = 1 AND label IN ('Reply', 'RootReply')
  UNION ALL SELECT node, 'r', 0 FROM tag WHERE kind = 7 AND label = 'Mention'
  UNION ALL SELECT m.node, 'z', coalesce(b.amount, 0) FROM tag m LEFT JOIN tag b ON b.id = m.id AND b.label = 'Bolt11' WHERE m.kind = 9735 AND m.label = 'Mention' AND m.node IS NOT NULL),
c AS (SELECT event, count(*) FILTER (w = 'c') AS comment_cnt, CAST(0 AS BIGINT) AS quote_cnt, CAST(0 AS BIGINT) AS repost_cnt, count(*) FILTER (w = 'r') AS reaction_cnt, count(*) FILTER (w = 'z') AS zap_cnt, CAST(sum(amount) AS BIGINT) AS zap_amount FROM g GROUP BY event),
e AS (SELECT *, 3 * comment_cnt + 4 * quote_cnt + 2 * repost_cnt + reaction_cnt + CASE WHEN zap_cnt > 0 AND zap_amount > 0 THEN 5 * zap_cnt + 2 * log10(zap_amount) ELSE 0 END AS x FROM c),
ea AS (SELECT event, comment_cnt, quote_cnt, repost_cnt, reaction_cnt, zap_cnt, zap_amount, CASE WHEN x > 0 THEN CAST(round(least(100.0::DOUBLE, 20 * log10(x + 1))) AS BIGINT) ELSE 0 END AS rank FROM e)"""
query_("event_assertions", f"{_EVENTS} SELECT * FROM ea")(lambda s, d: event_metrics.event_assertions(ev(s, d)))


def _json(*parts: str) -> str:
    return "'[' || concat_ws(',', " + ", ".join(parts) + ") || ']'"


def _jtag(name: str, column: str) -> str:
    return f"""'["{name}","' || {column} || '"]'"""


_user_tags = [_jtag(n, n if n != "d" else "pubkey") for n in ["d", *emit._USER[0]]] + [f"CASE WHEN {n} IS NOT NULL THEN {_jtag(n, n)} END" for n in emit._USER[1]]
query_("assertion_events", f"{_USERS} SELECT 30382 AS kind, '' AS content, {_json(*_user_tags)} AS tags FROM ua")(lambda s, d: emit.user_cards(_users(s, d)))
_event_tags = [_jtag("d", "event"), _jtag("e", "event"), *[_jtag(n, n) for n in emit._EVENT]]
query_("event_assertion_events", f"{_EVENTS} SELECT 30383 AS kind, '' AS content, {_json(*_event_tags)} AS tags FROM ea")(lambda s, d: emit.event_cards(event_metrics.event_assertions(ev(s, d))))
_LIST = """SELECT 30392 AS kind, '' AS content, '[["d","{d}"],["title","{t}"],["metric","{m}"],' || string_agg('["p","' || pubkey || '","","' || {m} || '"]', ',' ORDER BY {m} DESC, pubkey DESC) || ']' AS tags
FROM (SELECT pubkey, {m} FROM ua WHERE {m} IS NOT NULL ORDER BY {m} DESC, pubkey DESC LIMIT 500) HAVING count(*) > 0"""
query_("list_events", f"{_USERS} {_LIST.format(d='ranks', t='Top Pubkeys by Rank', m='rank')} UNION ALL {_LIST.format(d='followers', t='Top Pubkeys by Followers', m='follower_cnt')}")(
    lambda s, d: (lambda u: emit.rank_list(reputation.ranked_list(u, "rank")).unionByName(emit.follower_list(reputation.ranked_list(u, "follower_cnt"))))(_users(s, d))
)


# Store semantics


@query_("dedup_ids", "SELECT user_id AS id, min(event_id) AS first_event FROM events GROUP BY user_id")
def dedup_ids(s: SparkSession, d: str) -> DataFrame:
    rows = adapters.table(s, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("_seq"))
    return store.dedup_ids(rows, "_seq").select("id", F.col("_seq").alias("first_event"))


query_("replaceable_latest", "SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) // 1000000 AS created_at FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1")(
    lambda s, d: store.latest(adapters.table(s, d, "orders").select("o_custkey", "o_orderkey", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("created_at")), ["o_custkey"], "created_at", "o_orderkey")
)
query_("replaceable_latest_new_ties", "SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) // 1000000 AS created_at FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")(
    lambda s, d: store.latest(adapters.table(s, d, "orders").select("o_custkey", "o_orderkey", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("created_at")), ["o_custkey"], "created_at", "o_orderkey", tie="new")
)


def _slotted(s: SparkSession, d: str) -> DataFrame:
    """Signups and errors as replaceable, purchases as addressable by k, the rest as plain events."""
    kind = F.when(F.col("kind") == 1984, 10_002).when(F.col("kind") == 9735, 30_023).otherwise(F.col("kind")).cast("int")
    tag = F.transform(F.filter("tags", lambda t: t["label"] == "Mention"), lambda t: F.struct(F.lit("DTag").alias("label"), t["node"].alias("node"), t["address"].alias("address"), t["amount"].alias("amount")))
    return ev(s, d).withColumns({"tags": F.when(kind == 30_023, tag).otherwise(F.col("tags")), "kind": kind, "_lsn": F.col("id"), "_seq": F.lit(0)})


_SLOT = f"""WITH {EV}, sl AS (SELECT id, pubkey, created_at, CASE kind WHEN 1984 THEN 10002 WHEN 9735 THEN 30023 ELSE kind END AS kind, k,
  CASE WHEN kind IN (3, 1984) THEN 'r' || kind || ':' || pubkey WHEN kind = 9735 AND k IS NOT NULL THEN 'a' || pubkey || ':' || k ELSE 'e' || id END AS slot FROM ev)"""
query_("current_state", f"{_SLOT} SELECT id, pubkey, kind, created_at FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY created_at DESC, id) AS n FROM sl) WHERE n = 1")(
    lambda s, d: store.current(_slotted(s, d), "_lsn", "_seq").select("id", "pubkey", "kind", "created_at")
)
query_("addressable_latest", f"{_SLOT} SELECT id, pubkey, created_at FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY created_at DESC, id) AS n FROM sl WHERE kind = 30023) WHERE n = 1")(
    lambda s, d: store.current(_slotted(s, d).where("kind = 30023"), "_lsn", "_seq").select("id", "pubkey", "created_at")
)


@query_("current_after_deletes", f"""{_SLOT}, w AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY created_at DESC, id) AS n FROM sl)
SELECT id, pubkey, kind, created_at FROM w WHERE n = 1 AND id % 5 <> 0""")
def current_after_deletes(s: SparkSession, d: str) -> DataFrame:
    """All events come in, then every fifth id is deleted: what a deleted one replaced stays gone."""
    rows = _slotted(s, d)
    gone = rows.where("id % 5 = 0").withColumns({"_diff": F.lit(-1), "_lsn": F.col("_lsn") + (1 << 40)})
    return store.fold(rows.withColumn("_diff", F.lit(1)).unionByName(gone), "_lsn", "_seq").select("id", "pubkey", "kind", "created_at")


@query_("change_log", f"""{_SLOT}, w AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY created_at DESC, id) AS n FROM sl),
o AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY created_at DESC, id) AS n FROM sl WHERE created_at < 1704700000),
a AS (SELECT id, pubkey, kind, created_at FROM o WHERE n = 1), b AS (SELECT id, pubkey, kind, created_at FROM w WHERE n = 1)
SELECT *, CAST(-1 AS BIGINT) AS diff FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, CAST(1 AS BIGINT) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def change_log(s: SparkSession, d: str) -> DataFrame:
    """What the events from some time on changed in the store."""
    rows = _slotted(s, d)
    cols = ["id", "pubkey", "kind", "created_at"]
    old = store.current(rows.where("created_at < 1704700000"), "_lsn", "_seq").select(cols)
    return store.change_log(old, store.current(rows, "_lsn", "_seq").select(cols)).withColumnRenamed("_diff", "diff")


@query_("interned_events", """WITH w AS (SELECT 'u' || user_id AS b, event_id AS o FROM events WHERE user_id IS NOT NULL), f AS (SELECT b, min(o) AS o FROM w GROUP BY b)
SELECT b AS name, row_number() OVER (ORDER BY o, b) AS sym FROM f""")
def interned(s: SparkSession, d: str) -> DataFrame:
    seen = adapters.table(s, d, "events").where("user_id is not null").select(F.encode(F.concat(F.lit("u"), F.col("user_id").cast("string")), "utf-8").alias("bytes"), "event_id")
    return intern.extend(None, seen, ["event_id"]).select(F.decode("bytes", "utf-8").alias("name"), "sym")


# Filters

_TAGGED = f"WITH {EV}, x AS (SELECT id, pubkey, kind, created_at FROM ev)"


def _filtered(f: Filter, order: str = "index") -> Query:
    return lambda s, d: query.run(ev(s, d), f, order).select("id", "pubkey", "kind", "created_at")


_M = "id IN (SELECT id FROM tag WHERE label IN ('Reply', 'RootReply', 'Mention') AND node IN (3, 7))"
query_("filter_ids", f"{_TAGGED} SELECT * FROM x WHERE id IN (5, 17, 99, 250, 1000000007)")(_filtered(Filter().with_ids(5, 17, 99, 250, 1_000_000_007)))
query_("filter_authors", f"{_TAGGED} SELECT * FROM x WHERE pubkey IN (2, 5, 11) ORDER BY pubkey, id LIMIT 100")(_filtered(Filter().with_authors(2, 5).with_authors(11).with_limit(100)))
query_("filter_kinds", f"{_TAGGED} SELECT * FROM x WHERE kind IN (1, 7) ORDER BY kind, id LIMIT 500")(_filtered(Filter().with_kinds(1, 7)))
query_("filter_since_until", f"{_TAGGED} SELECT * FROM x WHERE created_at BETWEEN 1704200000 AND 1704300000 ORDER BY id LIMIT 500")(_filtered(Filter().between(1_704_200_000, 1_704_300_000)))
query_("filter_tags", f"{_TAGGED} SELECT * FROM x WHERE {_M} ORDER BY id LIMIT 100000")(_filtered(Filter().with_tags("e", 3, 7).with_limit(100_000)))
query_("filter_combo", f"{_TAGGED} SELECT * FROM x WHERE {_M} AND kind = 9735 AND id IN (SELECT id FROM tag WHERE label = 'Pubkey' AND node IN (3, 50)) AND created_at >= 1704100000")(
    _filtered(Filter().with_tags("e", 3, 7).with_tags("p", 3, 50).with_kinds(9735).between(since=1_704_100_000).with_limit(100_000))
)
query_("filter_limit", f"""WITH {EV}, kx AS (SELECT id, min(CASE label WHEN 'RootReply' THEN 0 WHEN 'Reply' THEN 1 ELSE 2 END * 1000000000 + node) AS key FROM tag WHERE label IN ('Reply', 'RootReply', 'Mention') AND node IN (3, 7) GROUP BY id)
SELECT id, pubkey, kind, created_at FROM ev JOIN kx USING (id) ORDER BY key, id LIMIT 20""")(_filtered(Filter().with_tags("e", 3, 7).with_limit(20)))
query_("filter_newest", f"{_TAGGED} SELECT * FROM x WHERE kind IN (1, 3) ORDER BY created_at DESC, id LIMIT 50")(_filtered(Filter().with_kinds(1, 3).with_limit(50), "created_at_desc"))


def _store(s: SparkSession, d: str) -> DataFrame:
    """events in the text store's form: ids in 64 hexadecimal digits, tags as JSON."""
    pad = lambda c: F.lower(F.lpad(F.hex(c), 64, "0"))
    e = adapters.table(s, d, "events")
    tags_ = F.to_json(F.array(F.array(F.lit("t"), F.col("event_type")), F.array(F.lit("d"), F.get_json_object("props", "$.k"))))
    return e.select(pad(F.col("event_id")).alias("id"), pad(F.col("user_id")).alias("pubkey"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created_at"), F.lit(30_023).alias("kind"), tags_.alias("tags"), F.lit("").alias("content"), F.repeat(F.lit("0"), 128).alias("sig"))


_hex = lambda n: f"{n:064x}"
_STORE = "WITH st AS (SELECT lpad(lower(to_hex(event_id)), 64, '0') AS id, lpad(lower(to_hex(user_id)), 64, '0') AS pubkey, epoch_us(ts) // 1000000 AS created_at, event_type AS t, json_extract_string(props, '$.k') AS k FROM events)"


def _from_store(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda s, d: f(_store(s, d)).select("id", "pubkey", "created_at")


query_("store_by_ids", f"{_STORE} SELECT id, pubkey, created_at FROM st WHERE id IN ('{_hex(3)}', '{_hex(77)}')")(_from_store(lambda st: query.by_ids(st, [_hex(3), _hex(77)])))
query_("store_query_newest", f"{_STORE} SELECT id, pubkey, created_at FROM st WHERE pubkey IN ('{_hex(1)}', '{_hex(4)}') ORDER BY created_at DESC, id LIMIT 500")(_from_store(lambda st: query.query_store(st, Filter().with_authors(_hex(1), _hex(4)))))
query_("store_query_tags", f"{_STORE} SELECT id, pubkey, created_at FROM st WHERE t = 'click' OR k = '5' ORDER BY created_at DESC, id LIMIT 500")(_from_store(lambda st: query.by_tags(st, [("t", "click"), ("d", "5")])))
query_("store_query_combined", f"{_STORE} SELECT id, pubkey, created_at FROM st WHERE t IN ('click', 'view') AND k = '5' AND created_at <= 1705000000 ORDER BY created_at DESC, id LIMIT 100")(
    _from_store(lambda st: query.query_store(st, Filter().with_tags("t", "click", "view").with_tags("d", "5").between(until=1_705_000_000).with_limit(100)))
)
query_("store_latest_replaceable", f"{_STORE} SELECT id, pubkey, created_at FROM st WHERE pubkey = '{_hex(2)}' ORDER BY created_at DESC, id LIMIT 1")(_from_store(lambda st: query.latest_replaceable(st, _hex(2), 30_023)))
query_("store_latest_addressable", f"{_STORE} SELECT id, pubkey, created_at FROM st WHERE pubkey = '{_hex(2)}' AND k = '42' ORDER BY created_at DESC, id LIMIT 1")(_from_store(lambda st: query.latest_addressable(st, _hex(2), 30_023, "42")))
query_("store_count", f"{_STORE} SELECT count(*) AS n FROM (SELECT * FROM st WHERE created_at >= 1704200000 LIMIT 500)")(lambda s, d: query.count_store(_store(s, d), Filter().between(since=1_704_200_000)))
query_("weighted_topk", "WITH w AS (SELECT l_suppkey AS key, CAST(l_quantity AS BIGINT) AS score, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT key, score, unnest(range(n)) AS i FROM w) SELECT key, score FROM r ORDER BY score DESC, key DESC LIMIT 50")(
    lambda s, d: relational.top_k(adapters.table(s, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_quantity").cast("bigint").alias("score"), F.lit(1).alias("w")), "score", "key", 50, "w")
)

__all__ = ["EVENT", "QUERIES", "SQL"]
