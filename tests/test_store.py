import random

from pyspark.sql import functions as F

from trustloom.functions.tags import invoice_amount, parse_tags
from trustloom.operators import intern, query, store
from trustloom.operators.query import Filter
from trustloom.schema import EVENT
from trustloom.sources.changes import copy_text, decode_changes
from trustloom.streaming.incremental import Maintained, Views, event_stream

ROW = f"{EVENT}, _lsn bigint, _seq bigint"


def rows(spark, data):
    return spark.createDataFrame([(i, p, k, c, t, n, 0) for n, (i, p, k, c, t) in enumerate(data)], ROW)


D = lambda n: [("DTag", n, None, None)]


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_last_writer_wins(spark):
    data = [(1, 1, 0, 10, []), (2, 1, 0, 5, []), (3, 1, 0, 10, []), (4, 2, 30023, 1, D(7)), (5, 2, 30023, 2, D(7)), (6, 2, 30023, 1, D(8)), (7, 2, 30023, 1, []), (8, 1, 1, 1, []), (8, 1, 1, 1, [])]
    assert ids(store.current(rows(spark, data), "_lsn")) == [1, 5, 6, 7, 8]
    assert ids(store.current(rows(spark, data), "_lsn", tie="new")) == [3, 5, 6, 7, 8]
    folded = rows(spark, data).withColumn("_diff", F.lit(1))
    assert ids(store.fold(folded, "_lsn", "_seq")) == [1, 5, 6, 7, 8]


def test_deletes_do_not_revive(spark):
    df = rows(spark, [(1, 1, 0, 1, []), (2, 1, 0, 2, []), (2, 1, 0, 2, []), (3, 1, 1, 1, []), (9, 1, 1, 1, [])])
    signed = df.withColumn("_diff", F.when(F.col("_lsn").isin(2, 4), -1).otherwise(1))
    assert ids(store.fold(signed, "_lsn", "_seq")) == [3]


def reference_fold(data):
    state = {}
    for i, p, k, c, t, diff in data:
        d = next((x[1] for x in t if x[0] == "DTag"), None)
        slot = ("r", p, k) if k in (0, 3) or 10000 <= k < 20000 else ("a", p, k, d) if 30000 <= k < 40000 and d is not None else ("i", i)
        now = state.get(slot)
        if diff > 0:
            if now is None or now[0] != i and c > now[3]:
                state[slot] = (i, p, k, c)
        elif now is not None and now[0] == i:
            del state[slot]
    return sorted(v[0] for v in state.values())


def history(r, n):
    out, known = [], []
    for i in range(n):
        if known and r.random() < 0.25:
            out.append((*r.choice(known), -1))
        else:
            k = r.choice([0, 1, 3, 7, 30023, 1984])
            e = (i, r.randrange(4), k, r.randrange(30), D(r.randrange(3)) if k == 30023 else [("Pubkey", r.randrange(4), None, None)] if k != 7 else [("Mention", r.randrange(9), None, None)])
            known.append(e)
            out.append((*e, 1))
    return out


def test_fold_equals_sequential_application(spark):
    h = history(random.Random(2), 120)
    df = spark.createDataFrame([(i, p, k, c, t, n, 0, d) for n, (i, p, k, c, t, d) in enumerate(h)], f"{ROW}, _diff int")
    assert ids(store.fold(df, "_lsn", "_seq")) == reference_fold(h)


def test_stream_equals_batch(spark, tmp_path):
    h = history(random.Random(7), 90)
    for b in range(3):
        part = [(i, p, k, c, t, n, 0, d) for n, (i, p, k, c, t, d) in enumerate(h)][b * 30 : b * 30 + 30]
        spark.createDataFrame(part, f"{ROW}, _diff int").coalesce(1).write.parquet(str(tmp_path / f"in{b}"))
    m = Maintained(spark, str(tmp_path / "out"), Views(5))
    source = event_stream(spark, str(tmp_path / "in*"))
    q = m.start(source, str(tmp_path / "check"))
    q.awaitTermination()
    assert ids(m.state()) == reference_fold(h)
    full = Views(5).build(m.state())
    for name in ("users", "events", "ranks"):
        view = m.view(name)
        assert sorted(map(str, view.collect())) == sorted(map(str, full[name].select(*view.columns).collect()))
        # the signed changes of all batches add up to the view
        cols = view.columns
        total = m.log(name).groupBy(*cols).agg(F.sum("_diff").alias("n")).where("n <> 0")
        assert sorted(map(str, total.where("n = 1").select(*cols).collect())) == sorted(map(str, view.collect())) and total.where("n <> 1").count() == 0


K = "ab" * 32


def test_parse_tags(spark):
    j = f'[["e","{K}"],["e","{K}","","reply"],["e","{K}","","root"],["e","zz"],["p","{K.upper()}"],["P","{K}"],["q","{K}"],["q","30023:{K}:x:y"],["a","30023:{K}:n"],["a","bad"],["t","ÄB"],["d","first"],["d","{K}"],["x","y"],["p"]]'
    got = spark.createDataFrame([(j,)], "j string").select(parse_tags(F.col("j"))).first()[0]
    k = bytes.fromhex(K)
    assert [(t["label"], bytes(t["value"]), t["address"] and bytes(t["address"])) for t in got] == [
        ("Mention", k, None), ("Reply", k, None), ("RootReply", k, None), ("Pubkey", k, None), ("PubkeyUpper", k, None), ("Quote", k, None),
        ("QuoteAddress", k, f"30023:{K}:x:y".encode()), ("Address", k, f"30023:{K}:n".encode()), ("Topic", "äb".encode(), None), ("DTag", b"first", None), ("DTag", k, None),
    ]


def test_strict_tags(spark):
    data = ['[["t","a"],["e",1]]', '[["t","a\\"b"]]', "nonsense", None, "[]", ' [ ["t" , "a"] ] ', '[["t","a,b]["]]']
    df = spark.createDataFrame([(j,) for j in data], "j string")
    assert [len(r[0] or []) for r in df.select(parse_tags(F.col("j"))).collect()] == [0, 0, 0, 0, 0, 1, 1]
    assert [len(r[0] or []) for r in df.select(parse_tags(F.col("j"), strict=False)).collect()] == [1, 1, 0, 0, 0, 1, 1]


def test_invoices(spark):
    data = "q" * 120
    cases = {f"lnbc210u1{data}": 21000, f"lnbc1{data}": 0, f"lnbc2500n1{data}": 250, f"lnbc20m1{data}": 2_000_000, f"lnbc10p1{data}": 0, f"lntb11{data}": 100_000_000, "lnbcinvalid": None, f"xxbc1u1{data}": None}
    df = spark.createDataFrame([(c,) for c in cases], "v string")
    assert [r[0] for r in df.select(invoice_amount(F.col("v"))).collect()] == list(cases.values())


def test_interning(spark):
    first = spark.createDataFrame([(b"b", 2), (b"a", 1), (b"b", 3), (None, 0)], "bytes binary, at int")
    d = intern.extend(None, first, ["at"])
    assert {bytes(r["bytes"]): r["sym"] for r in d.collect()} == {b"a": 1, b"b": 2}
    more = intern.extend(d, spark.createDataFrame([(b"c", 1), (b"a", 0), (b"0", 5)], "bytes binary, at int"), ["at"])
    assert {bytes(r["bytes"]): r["sym"] for r in more.collect()} == {b"a": 1, b"b": 2, b"c": 3, b"0": 4}


def test_intern_events_and_text_filters(spark):
    a, b, e = bytes([1]) * 32, bytes([2]) * 32, bytes([9]) * 32
    raw = spark.createDataFrame([(e, a, 5, 1, f'[["p","{b.hex()}"],["t","X"]]', 1, 0), (b, b, 6, 1, "[]", 2, 0)], "id binary, pubkey binary, created_at long, kind int, tags string, _lsn long, _seq long")
    events, d = intern.intern_events(raw.withColumn("tags", parse_tags(F.col("tags"))))
    got = {r["created_at"]: r for r in events.collect()}
    assert (got[5]["id"], got[5]["pubkey"], [(t["label"], t["node"]) for t in got[5]["tags"]]) == (1, 2, [("Pubkey", 3), ("Topic", 4)])
    assert (got[6]["id"], got[6]["pubkey"], got[6]["tags"]) == (3, 3, [])
    f = query.from_text(Filter().with_tags("t", "x").with_tags("p", b.hex(), "00" * 32), d)
    assert f.tags == {"t": frozenset({4}), "p": frozenset({3})}
    assert query.from_text(Filter().with_authors("77" * 32), d) is None


E = lambda spark: spark.createDataFrame(
    [(1, 10, 1, 100, [("Reply", 5, None, None), ("Mention", 5, None, None)]), (2, 10, 7, 200, [("Pubkey", 11, None, None)]), (3, 11, 1, 300, [("DTag", 8, None, None)]), (4, 12, 1, 400, [("Pubkey", 11, None, None)]), (5, 12, 6, 500, [])], EVENT
)


def test_filters(spark):
    e = E(spark)
    run = lambda f, **o: [r["id"] for r in query.run(e, f, **o).collect()]
    assert run(Filter().with_ids(3, 99)) == [3]
    assert run(Filter().with_authors(10).with_kinds(7)) == [2]
    assert run(Filter().with_tags("e", 5)) == [1]
    assert run(Filter().with_tags("p", 11).with_authors(12)) == [4]
    assert run(Filter().with_tags("d", 8).with_kinds(6)) == []
    assert run(Filter().between(200, 400)) == [2, 3, 4]
    assert run(Filter().with_kinds(1, 6, 7).with_limit(2)) == [1, 3]
    assert run(Filter().with_kinds(1, 6, 7).with_limit(2), order="created_at_desc") == [5, 4]
    assert run(Filter()) == [1, 2, 3, 4, 5] and run(Filter(), compat=True) == []


def test_copy_text(spark):
    i, p, s = "01" * 32, "02" * 32, "03" * 64
    lines = [f"{i}\t{p}\t5\t1\t[]\ta\\tb\\\\n\\q\t{s}", f"{i}\t{p}\tx\t1\t[]\tc\t{s}", "short", f"\\\\x{i}\t{p}\t6\t1\t\\N\t\\N\t{s}"]
    got = copy_text(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["created_at"], r["tags"], r["content"]) for r in got] == [(5, "[]", "a\tb\\nq"), (6, "[]", "")]


def test_change_records(spark):
    b = bytes(32)
    data = [(b, b, 1, 1, None, None, b, "insert", 1), (b, b, 1, 1, "[]", "x", b, "update", 2), (b, None, None, None, None, None, None, "delete", 3), (b, b, 1, 1, "[]", "", b, "delete", 4)]
    df = spark.createDataFrame(data, "id binary, pubkey binary, created_at long, kind int, tags string, content string, sig binary, op string, lsn long")
    assert [(r["_lsn"], r["_diff"], r["tags"], r["content"]) for r in decode_changes(df).collect()] == [(1, 1, "[]", ""), (4, -1, "[]", "")]
