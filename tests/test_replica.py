import json

from pyspark.sql import functions as F

from trustloom.functions import scores
from trustloom.operators import event_metrics, user_metrics
from trustloom.operators.query import Filter
from trustloom.plans import reputation
from trustloom.schema import EVENT, RAW
from trustloom.sources.changes import copy_text, decode_changes
from trustloom.streaming.incremental import Views
from trustloom.streaming.replica import Replica

H = lambda n: f"{n:064x}"


def raw(n, author, kind, at, tags, content="x"):
    return bytes.fromhex(H(n)), bytes.fromhex(H(author)), at, kind, json.dumps(tags), content, bytes(64)


ROWS = [
    raw(1, 101, 3, 10, [["p", H(102)]]), raw(2, 102, 3, 11, [["p", H(101)]]), raw(3, 103, 3, 12, [["p", H(101)]]), raw(4, 104, 3, 13, [["p", H(101)]]), raw(5, 105, 3, 14, [["p", H(101)]]),
    raw(6, 101, 1, 20, [["t", "Tea"]], "hello"), raw(7, 102, 7, 21, [["e", H(6)]]), raw(8, 103, 4242, 22, []),
]


def test_raw_to_views(spark, tmp_path):
    lines = ["\t".join([r[0].hex(), "\\\\x" + r[1].hex(), str(r[2]), str(r[3]), r[4], r[5], r[6].hex()]) for r in ROWS]
    table = copy_text(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert table.count() == len(ROWS)
    rep = Replica(spark, str(tmp_path / "out"), Views(20))
    assert rep.lsn() is None
    rep.snapshot(table, 100)
    rep.snapshot(table, 100)  # once only
    assert rep.lsn() == 100
    ranks = lambda: {int(r["node"], 16): r["rank"] for r in rep.named("ranks", "node").collect()}
    assert ranks() == {101: 13968397, 102: 13031592, 103: 1000000, 104: 1000000, 105: 1000000}

    def change(rows, name):
        df = spark.createDataFrame([(*r, op, lsn) for r, op, lsn in rows], f"{RAW}, op string, lsn bigint")
        decode_changes(df).coalesce(1).write.parquet(str(tmp_path / name))

    change([(ROWS[5], "delete", 90), (ROWS[0], "delete", 101), (raw(9, 106, 6, 31, [["e", H(6)]]), "insert", 102)], "in0")
    schema = spark.read.parquet(str(tmp_path / "in0")).schema
    follow = lambda: rep.start(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*")), str(tmp_path / "check")).awaitTermination()
    follow()
    assert rep.lsn() == 102 and ranks() == {101: 4333332, 102: 1000000, 103: 1000000, 104: 1000000, 105: 1000000}
    numbers = {bytes(r["bytes"]): r["sym"] for r in rep.dictionary().collect()}
    change([(raw(10, 101, 3, 40, [["p", H(102)]]), "insert", 103)], "in1")
    rep = Replica(spark, str(tmp_path / "out"), Views(20))  # a new process goes on
    follow()
    assert rep.lsn() == 103 and ranks()[101] == 13968397
    now = {bytes(r["bytes"]): r["sym"] for r in rep.dictionary().collect()}
    assert numbers.items() < now.items() and len(set(now.values())) == len(now) == max(now.values())
    events = {int(r["event"], 16): r for r in rep.named("events", "event").collect()}
    assert (events[6]["reaction_cnt"], events[6]["repost_cnt"]) == (1, 1)
    got = [json.loads(r[0]) for r in rep.events(Filter().with_kinds(1)).collect()]
    assert got == [{"id": H(6), "pubkey": H(101), "created_at": 20, "kind": 1, "tags": [["t", "Tea"]], "content": "hello", "sig": "00" * 64}]
    assert [json.loads(r[0])["kind"] for r in rep.events(Filter().with_authors(H(102))).collect()].count(7) == 1
    assert rep.events(Filter().with_authors(H(999))).collect() == []
    cards = rep.cards(2).collect()
    assert {r["kind"] for r in cards} == {30382} and any(json.loads(r["tags"])[0] == ["d", H(101)] for r in cards)


def test_sums_stop_at_the_largest_number(spark):
    most, pay = (1 << 63) - 1, lambda n: [("PubkeyUpper", 1, None, None), ("Pubkey", 2, None, None), ("Mention", 3, None, None), ("Bolt11", None, None, n)]
    df = spark.createDataFrame([(10, 5, 9735, 0, pay(most)), (11, 5, 9735, 60, pay(5)), (12, 5, 9735, 90_000, pay(7))], EVENT)
    z = user_metrics.zaps(df)
    a = user_metrics.activity(df)
    assert user_metrics.zaps_sent(z).first()["zap_amt_sent"] == most and user_metrics.zaps_received(z).first()["zap_amt_recd"] == most
    assert a.where("pubkey = 1").first()["zap_avg_amt_day_sent"] == most // 2 == user_metrics.zaps_sent(z).first()["zap_avg_amt_day_sent"]
    assert event_metrics.event_assertions(df).first()["zap_amount"] == most
    assert a.where("pubkey = 5").first()["zap_amt_sent"] == a.where("pubkey = 1").first()["zap_amt_recd"] == 0
    assert spark.range(0).select(scores.saturating_sum(F.col("id"))).first()[0] is None
    assert spark.range(3).select(scores.saturating_sum(F.col("id"))).first()[0] == 3


def test_quotes_and_reposts(spark):
    t = lambda *x: [(label, node, None, None) for label, node in x]
    rows = [(1, 9, 1, 0, t(("Quote", 50))), (2, 9, 1, 0, t(("Quote", 50), ("Reply", 50))), (3, 9, 6, 0, t(("Mention", 50))), (4, 9, 6, 0, t(("Mention", 51), ("Quote", 50))), (5, 9, 7, 0, t(("Quote", 50)))]
    got = {r["event"]: (r["comment_cnt"], r["quote_cnt"], r["repost_cnt"]) for r in event_metrics.event_assertions(spark.createDataFrame(rows, EVENT)).collect()}
    assert got == {50: (1, 2, 1), 51: (0, 0, 1)}


def test_one_scan_equals_the_parts(spark):
    import random

    r = random.Random(4)
    who = lambda: r.choice([None, *range(1, 9)])
    rows = []
    for i in range(400):
        kind = r.choice([1, 3, 7, 1111, 1984, 9735, 9735])
        tags = [(r.choice(["Pubkey", "PubkeyUpper", "Mention", "Reply", "Quote"]), who(), None, None) for _ in range(r.randrange(4))]
        tags += [("Bolt11", None, None, r.choice([0, 0, 5, 70, None]))] if r.random() < 0.7 else []
        rows.append((i, who(), kind, r.randrange(600_000), tags))
    df = spark.createDataFrame(rows, EVENT).where("kind <> 3")
    a = {x["pubkey"]: x for x in user_metrics.activity(df).collect()}
    z = user_metrics.zaps(df)
    for part in (user_metrics.authored(df), user_metrics.reports_received(df), user_metrics.zaps_sent(z), user_metrics.zaps_received(z)):
        for x in part.where("pubkey is not null").collect():
            assert all(a[x["pubkey"]][c] == x[c] for c in part.columns)
    assert {x["pubkey"] for x in user_metrics.known_users(df).collect()} == set(a)
    every = spark.createDataFrame(rows, EVENT)
    users = reputation.users(every, 5)
    for narrow, m in ((reputation.top_ranks(every, 5, 6), "rank"), (reputation.top_followers(every, 5, 6), "follower_cnt")):
        assert sorted(map(tuple, narrow.collect())) == sorted(map(tuple, reputation.ranked(users, m, 6).collect()))
