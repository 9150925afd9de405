from trustloom.operators.progress import changed, counted
from trustloom.operators.query import Filter
from trustloom.plans.engine import Engine, main
from trustloom.schema import EVENT


def events(spark):
    p = lambda n: [("Pubkey", n, None, None)]
    rows = [(1, 10, 3, 100, p(11)), (2, 11, 3, 110, p(10)), (3, 12, 3, 120, p(10)), (4, 10, 1, 130, []), (5, 11, 7, 140, [("Mention", 4, None, None)]), (6, 12, 4242, 150, [])]
    return spark.createDataFrame(rows, EVENT)


def test_engine(spark):
    e = Engine(events(spark), iterations=20, top=2)
    assert [r["id"] for r in e.query(Filter().with_authors(10)).collect()] == [1, 4]
    assert {r["pubkey"]: r["follower_cnt"] for r in e.users().collect()} == {10: 2, 11: 1, 12: 0}
    kinds = sorted(r["kind"] for r in e.cards().collect())
    assert kinds == [30382] * 3 + [30383] + [30392] * 2
    coded = Engine(events(spark), spark.createDataFrame([(bytes([7]) * 32, 10)], "bytes binary, sym bigint"))
    assert [r["id"] for r in coded.query(Filter().with_authors("07" * 32)).collect()] == [1, 4]
    assert coded.query(Filter().with_authors("08" * 32)).collect() == []


def test_command_line(spark, tmp_path):
    events(spark).write.parquet(str(tmp_path / "in"))
    main([str(tmp_path / "in"), str(tmp_path / "out"), "--iterations", "5", "--top", "1", "--cards"])
    top = spark.read.parquet(str(tmp_path / "out/top_follower_cnt")).collect()
    assert [(r["pubkey"], r["follower_cnt"]) for r in top] == [(10, 2)]
    assert spark.read.parquet(str(tmp_path / "out/cards")).where("kind = 30392").count() == 2


def test_progress(spark):
    df, seen = counted(spark.range(7), "all")
    df.collect()
    assert seen.get["rows"] == 7
    df, seen = changed(spark.createDataFrame([(1, 1), (2, -1), (3, 1)], "node int, _diff int"), "ranks")
    df.collect()
    assert seen.get == {"rows": 3, "added": 2, "removed": 1}
