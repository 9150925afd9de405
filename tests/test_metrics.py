import pytest
from pyspark.sql import functions as F

from trustloom.functions.scores import event_rank, normalize_rank
from trustloom.operators import emit, graph
from trustloom.operators.event_metrics import event_assertions
from trustloom.operators.relational import as_list, changes, consolidate, threshold, top_k
from trustloom.operators.user_metrics import user_assertions
from trustloom.schema import EVENT

H = 3600


def tag(label, node=None, amount=None):
    return (label, node, None, amount)


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT)


USERS = [
    (30, 1, 3, 2 * H, [tag("Pubkey", 2)]), (31, 2, 3, 10 * H, [tag("Pubkey", 1)]), (32, 3, 3, 7 * H, [tag("Pubkey", 1)]),
    (10, 1, 1, H, [tag("Topic", 400)]), (11, 1, 1, 3 * H, [tag("Topic", 401)]), (12, 1, 1, 20 * H, [tag("Reply", 9)]),
    (13, 1, 7, 21 * H, [tag("Mention", 10), tag("Pubkey", 1)]), (14, 1, 7, 22 * H, [tag("Mention", 11), tag("Pubkey", 1)]),
    (15, 1, 1984, 23 * H, [tag("Pubkey", 2)]), (16, 2, 1, 5 * H, [tag("Pubkey", 1)]), (17, 3, 1, 6 * H, [tag("Pubkey", 1)]),
    (18, 3, 1, 7 * H, []), (19, 3, 7, 8 * H, []),
    (20, 9, 9735, 9 * H, [tag("Pubkey", 2), tag("PubkeyUpper", 1), tag("Bolt11", amount=1000)]),
    (21, 9, 9735, 10 * H, [tag("Pubkey", 1), tag("PubkeyUpper", 2), tag("Bolt11", amount=2000)]),
]


def assertions(spark, rows):
    e = events(spark, rows)
    f = graph.follows(e)
    return {r["pubkey"]: r for r in user_assertions(e, f, graph.pagerank(f, 20)).collect()}


def test_user_assertions(spark):
    got = assertions(spark, USERS)
    want = {
        "follower_cnt": (2, 1, 0), "rank": (52, 52, 18), "first_created_at": (3600, 18000, 21600), "post_cnt": (2, 1, 2), "reply_cnt": (1, 0, 0), "reactions_cnt": (2, 0, 1),
        "zap_amt_sent": (1000, 2000, 0), "zap_cnt_sent": (1, 1, 0), "zap_avg_amt_day_sent": (1000, 2000, 0), "zap_amt_recd": (2000, 1000, 0), "zap_cnt_recd": (1, 1, 0),
        "zap_avg_amt_day_recd": (2000, 1000, 0), "reports_cnt_sent": (1, 0, 0), "reports_cnt_recd": (0, 1, 0), "active_hours_start": (1, 5, 6), "active_hours_end": (23, 10, 8),
    }
    for name, values in want.items():
        assert tuple(got[u][name] for u in (1, 2, 3)) == values, name


def test_report_target_alone(spark):
    got = assertions(spark, [(1, 5, 1984, 10, [tag("Pubkey", 7)])])
    assert got[7]["reports_cnt_recd"] == 1 and got[7]["post_cnt"] == 0
    assert [got[7][c] for c in ("rank", "first_created_at", "active_hours_start", "active_hours_end")] == [None] * 4


def test_repeated_follows_count_once(spark):
    rows = [(1, 2, 3, 1, [tag("Pubkey", 1), tag("Pubkey", 1)]), (2, 2, 3, 2, [tag("Pubkey", 1)]), (3, 3, 3, 1, [tag("Pubkey", 1)]), (4, 4, 3, 1, [tag("Pubkey", 1)])]
    assert assertions(spark, rows)[1]["follower_cnt"] == 3


def test_days_of_nothing(spark):
    zap = lambda i, day, amount: (i, 9, 9735, day * 86400, [tag("Pubkey", 2), tag("PubkeyUpper", 1), tag("Bolt11", amount=amount)])
    got = assertions(spark, [zap(1, 1, 100), zap(2, 2, 0), (3, 9, 9735, 5, [tag("Pubkey", 2), tag("PubkeyUpper", 1)])])
    assert got[1]["zap_avg_amt_day_sent"] == 50 and got[1]["zap_cnt_sent"] == 2
    assert got[2]["zap_avg_amt_day_recd"] == 100 and got[2]["zap_cnt_recd"] == 2


def test_rank_history(spark):
    """Following, unfollowing and following again gives the ranks that a fresh computation gives."""
    follow = [(1, 2), (2, 1), (3, 1), (4, 1)]
    e = spark.createDataFrame(follow, "src long, dst long")
    full = {r["node"]: r["rank"] for r in graph.pagerank(e, 20).collect()}
    again = {r["node"]: r["rank"] for r in graph.pagerank(e.where("src <> 1").unionByName(e.where("src = 1")), 20).collect()}
    assert full == again


@pytest.mark.parametrize("rank, want", [(0, 0), (-1, 0), (1_000_000, 18), (3_000_000, 35), (6_000_000, 46), (12_000_000, 57), (21_000_000, 65), (120_000_000, 81), (600_000_000, 90)])
def test_normalize(spark, rank, want):
    assert spark.range(1).select(normalize_rank(F.lit(rank))).first()[0] == want


EVENTS = [(100, 1, 1, 0, []), (101, 1, 1, 0, []), (102, 1, 1, 0, [])] + [
    (200, 2, 7, 1, [tag("Mention", 100)]), (201, 3, 7, 1, [tag("Mention", 100)]), (202, 1, 7, 1, [tag("Mention", 100)]),
    (203, 2, 1, 1, [tag("Reply", 100)]), (204, 3, 1, 1, [tag("RootReply", 100)]), (205, 2, 1, 1, [tag("Quote", 100)]), (206, 3, 6, 1, [tag("Mention", 100)]),
    (207, 9, 9735, 1, [tag("Mention", 100), tag("Bolt11", amount=5000)]), (208, 9, 9735, 1, [tag("Mention", 100), tag("Bolt11", amount=3000)]), (300, 1, 7, 1, [tag("Mention", 101)]),
]


def test_event_assertions(spark):
    got = {r["event"]: r.asDict() for r in event_assertions(events(spark, EVENTS)).collect()}
    assert got == {
        100: dict(event=100, rank=31, comment_cnt=2, quote_cnt=1, repost_cnt=1, reaction_cnt=3, zap_cnt=2, zap_amount=8000),
        101: dict(event=101, rank=6, comment_cnt=0, quote_cnt=0, repost_cnt=0, reaction_cnt=1, zap_cnt=0, zap_amount=0),
    }
    both = events(spark, [(1, 1, 1, 0, [tag("Reply", 5), tag("RootReply", 5)]), (2, 1, 1111, 0, [tag("Reply", 5)]), (3, 1, 9735, 0, [tag("Mention", 5)])])
    r = event_assertions(both).first()
    assert (r["comment_cnt"], r["zap_cnt"], r["zap_amount"]) == (2, 1, 0)


@pytest.mark.parametrize("counts, want", [((0, 0, 0, 0, 0, 0), 0), ((0, 0, 0, 10, 0, 0), 21), ((0, 0, 0, 0, 5, 10_000), 31), ((100, 50, 200, 1000, 50, 1_000_000), 67)])
def test_event_rank(spark, counts, want):
    assert spark.range(1).select(event_rank(*[F.lit(c).cast("bigint") for c in counts])).first()[0] == want


def test_top_k(spark):
    df = spark.createDataFrame([("Alice", 50), ("Bob", 20), ("Carol", 15), ("Dave", 30), ("Erin", 25)], "user string, score int")
    assert [tuple(r) for r in top_k(df, "score", "user", 3).collect()] == [("Alice", 50), ("Dave", 30), ("Erin", 25)]
    ranks = spark.createDataFrame([(1, 50), (2, 20), (3, 15), (4, 30), (5, 25), (6, 25)], "pubkey long, rank long")
    row = as_list(top_k(ranks, "rank", "pubkey", 3), "rank", "pubkey").first()
    assert [(e["pubkey"], e["score"]) for e in row["entries"]] == [(1, 50), (4, 30), (6, 25)]  # of equal scores the larger key
    w = spark.createDataFrame([(9, 1, 2), (8, 2, 5), (10, 3, 0), (7, 4, -1)], "score int, key int, w int")
    assert [tuple(r) for r in top_k(w, "score", "key", 4, "w").collect()] == [(1, 9), (1, 9), (2, 8), (2, 8)]
    assert as_list(ranks.where("rank > 99"), "rank", "pubkey").collect() == []


def test_signed_rows(spark):
    df = spark.createDataFrame([(1, 1), (1, -1), (2, 2), (3, -1)], "x int, _diff int")
    assert sorted(map(tuple, consolidate(df).collect())) == [(2, 2), (3, -1)]
    assert sorted(map(tuple, threshold(df).collect())) == [(2, 1)]
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (3,)], "x int")
    assert sorted(map(tuple, changes(a, b).collect())) == [(1, -1), (2, -1), (3, 1)]


def test_cards(spark):
    e = events(spark, USERS)
    f = graph.follows(e)
    rows = {r["tags"].split('"')[3]: r for r in emit.user_cards(user_assertions(e, f, graph.pagerank(f, 20))).collect()}
    assert rows["1"]["kind"] == 30382 and '["follower_cnt","2"]' in rows["1"]["tags"] and '["rank","52"]' in rows["1"]["tags"]
    assert "zap_avg" not in rows["1"]["tags"] and '"rank"' not in rows["9"]["tags"]
    entries = spark.createDataFrame([([(5, 1), (4, None)],)], "entries array<struct<score: long, pubkey: long>>")
    assert emit.rank_list(entries).first()["tags"] == '[["d","ranks"],["title","Top Pubkeys by Rank"],["metric","rank"],["p","1","","5"]]'
