"""Semantics that the catalogue's frames don't show: errors, nulls, conversions, layouts and plans."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from lodestar import Column, Entity, Table, lit
from lodestar.functions.convert import ConversionError
from lodestar.operators.query import EmptyError, ManyError
from lodestar.sources import delta, footers
from lodestar.sources.paths import account_of, blob_uri, is_parquet, normalise_prefix, parse_partition_values
from lodestar.sources.scan import MissingColumn

PEOPLE = Entity(id=Column("bigint"), name=Column("string"), amount=Column("decimal(10,2)"), count_=Column("int", name="count"), active=Column("boolean"), year=Column("int", partition=True), region=Column("string", partition=True))


@pytest.fixture(scope="module")
def people(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("people"))
    df = spark.createDataFrame([(1, "Alice", "100.50", 5, True), (2, "Bob", "250.75", 10, True), (3, None, "75.25", None, False)], "id long, name string, amount string, count int, active boolean")
    df = df.withColumn("amount", F.col("amount").cast("decimal(10,2)"))
    df.coalesce(1).write.parquet(f"{root}/year=2024/region=US")
    df.coalesce(1).where("id < 3").withColumn("id", F.col("id") + 10).write.parquet(f"{root}/year=0023/region=eu-west")
    return Table.from_path(spark, PEOPLE, root)


def plan(query):
    return query.to_df()._jdf.queryExecution().executedPlan().toString()


def test_terminals(people):
    usa = people.where(lambda r: r.region == "us").order_by("id")
    assert usa.count() == 3 and people.count() == 5 and people.long_count(lambda r: r.active) == 4
    assert usa.first().name == "Alice" and usa.last().id == 3 and usa.element_at(1).name == "Bob"
    assert usa.skip(1).first().name == "Bob" and [r.id for r in usa.take_last(2).to_list()] == [2, 3]
    assert float(usa.sum("amount")) == 426.5 and usa.average("count_") == 7.5
    assert float(usa.min("amount")) == 75.25 and float(usa.max("amount")) == 250.75
    assert usa.single(lambda r: r.id == 2).name == "Bob" and usa.single_or_default(lambda r: r.id == 9) is None
    assert usa.to_dict("id", "name") == {1: "Alice", 2: "Bob", 3: None}
    assert usa.to_lookup("active", "id") == {True: [1, 2], False: [3]}
    assert usa.select("id").sequence_equal(usa.select("id")) and not usa.select("id").sequence_equal(usa.select("id").take(2))
    assert usa.select("id").contains(id=3) and not usa.select("id").contains(id=4)
    assert [r.id for r in usa] == [1, 2, 3]
    assert usa.aggregate("id", F.lit(0).cast("long"), lambda a, x: a * 10 + x) == 123


def test_errors(people):
    none = people.where(lambda r: r.id > 99)
    for terminal in (none.first, none.last, none.single, lambda: none.element_at(0), lambda: none.min("amount"), lambda: none.average("count_")):
        with pytest.raises(EmptyError):
            terminal()
    assert none.first_or_default(default=7) == 7 and none.last_or_default() is None and none.element_at_or_default(3) is None
    assert none.sum("id") == 0 and none.max("id", nullable=True) is None and none.all(lambda r: r.id < 0) and not none.any()
    with pytest.raises(ManyError):
        people.single()
    with pytest.raises(TypeError):
        people.where(lambda r: r.id + 1)
    with pytest.raises(TypeError):
        people.then_by("id")
    with pytest.raises(AttributeError):
        people.where(lambda r: r.nothing == 1)
    with pytest.raises(ValueError):
        people.to_dict("active", "id")


def test_two_valued_nulls(people):
    usa = people.where(lambda r: r.year == 2024)
    assert usa.count(lambda r: r.name != "Bob") == 2
    assert usa.count(lambda r: r.count_ > 5) == 1 and usa.count(lambda r: ~(r.count_ > 5)) == 2
    assert usa.count(lambda r: r.name == None) == 1  # noqa: E711
    assert not usa.all(lambda r: r.count_ > 0)
    assert usa.count(lambda r: r.name.is_in(["Bob", None])) == 2
    assert usa.count(lambda r: r.name.is_null_or_white_space()) == 1
    assert usa.count(lambda r: r.name.compare("B") < 0) == 2


def test_partition_values_and_pruning(people):
    assert {r.region for r in people.select("region").distinct().to_list()} == {"us", "eu-west"}
    assert people.count(lambda r: r.region == "US") == 0 and people.count(lambda r: r.region.equals_ignore_case("US")) == 3
    assert people.count(lambda r: r.year == 23) == 2
    pruned = people.where(lambda r: (r.year == 2024) & (r.amount > 80)).select("id")
    assert re.search(r"PartitionFilters: \[[^]]*year", plan(pruned)) and "GreaterThan(amount,80" in plan(pruned)
    assert "ReadSchema: struct<id:bigint,amount:decimal(10,2)>" in plan(pruned)
    assert {tuple(sorted(r["values"].items())) for r in people.partitions().collect()} == {(("region", "US"), ("year", "2024")), (("region", "eu-west"), ("year", "0023"))}


def test_paths():
    assert parse_partition_values("/a/year=2024/x=/=y/b/year=2025/k=v=w") == {"year": "2025", "k": "v=w"}
    assert normalise_prefix("/a/b") == "a/b/" and normalise_prefix("") == "" and is_parquet("X.PARQUET")
    assert account_of("AccountName=a;AccountKey=k==") == {"AccountName": "a", "AccountKey": "k=="}
    assert blob_uri("a", "c", "/p") == "abfss://c@a.dfs.core.windows.net/p/"


def test_extensions_and_strays(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "t"))
    part = next((tmp_path / "t").glob("*.parquet"))
    part.rename(tmp_path / "t" / "DATA.PARQUET")
    (tmp_path / "t" / "notes.txt").write_text("no table")
    assert Table.from_path(spark, Entity(id=Column("bigint")), str(tmp_path / "t")).count() == 3
    with pytest.raises(ValueError):
        Table.from_path(spark, Entity(id=Column("bigint")), " ")


@pytest.mark.parametrize("kind,good", [("bigint", True), ("double", True), ("decimal(12,0)", True), ("smallint", False), ("string", False), ("date", False)])
def test_widening_only(spark, tmp_path, kind, good):
    spark.createDataFrame([(1,)], "v int").write.parquet(str(tmp_path / "t"))
    entity = Entity(v=Column(kind))
    if good:
        assert int(Table.from_path(spark, entity, str(tmp_path / "t")).first().v) == 1
    else:
        with pytest.raises(ConversionError):
            Table.from_path(spark, entity, str(tmp_path / "t"))


def test_text_conversion(spark, tmp_path):
    spark.createDataFrame([("2025-10-01",), ("10/01/2025",), (None,)], "day string").coalesce(1).write.parquet(str(tmp_path / "t"))
    table = Table.from_path(spark, Entity(day=Column("date")), str(tmp_path / "t"))
    assert [r.day for r in table.to_list()] == [dt.date(2025, 10, 1), dt.date(2025, 10, 1), None]
    spark.createDataFrame([("soon",)], "day string").write.mode("overwrite").parquet(str(tmp_path / "u"))
    with pytest.raises(Exception, match="not a date"):
        Table.from_path(spark, Entity(day=Column("date")), str(tmp_path / "u")).to_list()


def test_missing_columns(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "t"))
    with pytest.raises(MissingColumn):
        Table.from_path(spark, Entity(id=Column("bigint"), note=Column("string")), str(tmp_path / "t"))
    table = Table.from_path(spark, Entity(id=Column("bigint"), note=Column("string", allow_missing=True)), str(tmp_path / "t"))
    assert table.count(lambda r: r.note.is_null()) == 2
    with pytest.raises(ValueError):
        Column("int", nullable=False, allow_missing=True)


def log(root, version, *actions):
    (root / "_delta_log").mkdir(exist_ok=True)
    (root / "_delta_log" / f"{version:020}.json").write_text("".join(json.dumps(a) + "\n" for a in actions))


def test_log_replay(spark, tmp_path):
    for name, lo in (("a b", 0), ("c", 10), ("d", 20)):
        spark.range(lo, lo + 5).coalesce(1).write.parquet(str(tmp_path / "w" / name))
        next((tmp_path / "w" / name).glob("*.parquet")).rename(tmp_path / f"{name}.parquet")
    add = lambda p: {"add": {"path": p, "partitionValues": {}, "size": 1, "modificationTime": 0, "dataChange": True}}
    log(tmp_path, 0, {"protocol": {"minReaderVersion": 1}}, add("a%20b.parquet"), add("c.parquet"), {"commitInfo": {}})
    log(tmp_path, 1, {"remove": {"path": "c.parquet"}}, add("d.parquet"))
    table = Table.from_path(spark, Entity(id=Column("bigint")), str(tmp_path))
    assert sorted(r.id for r in table.to_list()) == [0, 1, 2, 3, 4, 20, 21, 22, 23, 24]
    assert delta.snapshot(spark, str(tmp_path)).version == 1 and table.files().count() == 2
    log(tmp_path, 2, {"remove": {"path": "d.parquet"}}, add("d.parquet"))
    assert Table.from_path(spark, Entity(id=Column("bigint")), str(tmp_path)).count() == 10
    log(tmp_path, 3, {"protocol": {"minReaderVersion": 3, "readerFeatures": ["deletionVectors"]}})
    with pytest.raises(delta.UnsupportedTable):
        Table.from_path(spark, Entity(id=Column("bigint")), str(tmp_path))


def test_log_with_missing_commits(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "w"))
    next((tmp_path / "w").glob("*.parquet")).rename(tmp_path / "a.parquet")
    add = {"add": {"path": "a.parquet", "partitionValues": {}, "size": 1, "modificationTime": 0, "dataChange": True}}
    log(tmp_path, 7, {"protocol": {"minReaderVersion": 1}}, add)
    with pytest.raises(delta.UnsupportedTable, match="missing"):
        Table.from_path(spark, Entity(id=Column("bigint")), str(tmp_path))


def test_log_values_of_equal_names(spark, tmp_path):
    actions = [{"protocol": {"minReaderVersion": 1}}, {"metaData": {"id": "x", "name": None, "schemaString": "{}", "partitionColumns": ["y"], "configuration": {}}}]
    for folder, y in (("a", "1"), ("b c", "2")):
        spark.range(2).coalesce(1).write.parquet(str(tmp_path / "w" / folder))
        (tmp_path / folder).mkdir()
        next((tmp_path / "w" / folder).glob("*.parquet")).rename(tmp_path / folder / "part-0.parquet")
        actions.append({"add": {"path": f"{folder.replace(' ', '%20')}/part-0.parquet", "partitionValues": {"y": y}, "size": 1, "modificationTime": 0, "dataChange": True}})
    log(tmp_path, 0, *actions)
    table = Table.from_path(spark, Entity(id=Column("bigint"), y=Column("int", partition=True)), str(tmp_path))
    assert sorted((r.id, r.y) for r in table.to_list()) == [(0, 1), (0, 2), (1, 1), (1, 2)]


def test_azure_credentials(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(Table, "from_path", classmethod(lambda cls, spark, entity, root, ttl=300.0: asked.append(root)))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    Table.from_azure_blob(spark, Entity(id=Column("bigint")), "AccountName=one;AccountKey=k==", "box", "/a/b")
    Table.from_azure_blob(spark, Entity(id=Column("bigint")), "AccountName=two;SharedAccessSignature=sv=1&sig=x=;EndpointSuffix=core.example", "box")
    Table.from_azure_container(spark, Entity(id=Column("bigint")), "three", "box", "p", {"fs.azure.account.auth.type": "OAuth"})
    assert asked == ["abfss://box@one.dfs.core.windows.net/a/b/", "abfss://box@two.dfs.core.example/", "abfss://box@three.dfs.core.windows.net/p/"]
    assert conf.get("fs.azure.account.key.one.dfs.core.windows.net") == "k==" and conf.get("fs.azure.sas.fixed.token.two.dfs.core.example") == "sv=1&sig=x="
    assert conf.get("fs.azure.account.auth.type.two.dfs.core.example") == "SAS" and conf.get("fs.azure.account.auth.type.three.dfs.core.windows.net") == "OAuth"
    for connection, container in (("AccountKey=k", "box"), ("AccountName=a", "")):
        with pytest.raises(ValueError):
            Table.from_azure_blob(spark, Entity(id=Column("bigint")), connection, container)


def test_other_statistics(spark, tmp_path):
    for k in range(8):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    asked = []

    def none(files):
        asked.append(1)
        return footers.column_statistics(files).withColumn("min_value", F.lit(None).cast("string"))

    table = Table.from_path(spark, Entity(id=Column("bigint")), str(tmp_path / "t"), statistics=none)
    found = table.where(lambda r: r.id == 33)
    assert found.count() == 1 and asked == [1] and found._df.select("__file").distinct().count() == 1 and table._within[(("id", "==", 33),)] is None


def test_reduce(people):
    none = people.where(lambda r: r.id > 99)
    with pytest.raises(EmptyError):
        none.reduce("id", lambda a, x: a + x)
    assert people.reduce("id", lambda a, x: a + x) == 29
    with pytest.raises(ValueError):
        people.order_by("id").take_range(-2, 3)


def test_compare_pushes_down(people):
    assert "GreaterThanOrEqual(name,B" in plan(people.where(lambda r: r.name.compare("B") >= 0).select("id"))
    assert [people.count(lambda r, f=f: f(r.name.compare("Bob"))) for f in (lambda c: c > 0, lambda c: c >= 0, lambda c: c == 0, lambda c: c != 0, lambda c: c < 0, lambda c: c <= 0, lambda c: ~(c >= 0))] == [0, 2, 2, 3, 3, 5, 3]


def test_file_pruning(spark, tmp_path):
    for k in range(10):
        spark.range(k * 100, k * 100 + 100).selectExpr("id", "cast(id as int) as value").coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    table = Table.from_path(spark, Entity(id=Column("bigint"), value=Column("int", indexed=True)), str(tmp_path / "t"))
    found = table.in_range("value", 250, 449)
    assert found.count() == 200 and found._df.select("__file").distinct().count() == 3
    assert table.row_groups().count() == 10 and table.column_statistics().where("column = 'value'").count() == 10
    files = lambda q: q._df.select("__file").distinct().count()
    ranged = table.where(lambda r: (r.value >= 250) & (r.id > 0)).where(lambda r: r.value < 450)
    assert ranged.count() == 200 and files(ranged) == 3 and len(table._within) == 1
    assert table.where(lambda r: r.id == 777).count() == 1 and files(table.where(lambda r: r.id == 777)) == 1
    assert files(table.where(lambda r: r.id.is_in([5, 120]))) == 2 and table.where(lambda r: r.id < 0).count() == 0
    assert table.where(lambda r: (r.id < 5) | (r.id > 995)).count() == 9 and table.where(lambda r: ~(r.id < 995)).count() == 5
    assert files(table.take(150)) == 2 and [r.id for r in table.order_by("id").take(2).to_list()] == [0, 1]
    narrow = table.lookup(lambda r: r.value == 777)
    assert narrow.count() == 1 and "InMemoryTableScan" not in plan(narrow)


def test_index(spark, tmp_path):
    spark.range(1000).selectExpr("id", "cast(id % 7 as string) as s", "nullif(id, 5) as v").write.parquet(str(tmp_path / "t"))
    table = Table.from_path(spark, Entity(id=Column("bigint", indexed=True), s=Column("string"), v=Column("bigint", indexed=True)), str(tmp_path / "t"))
    assert table.count(lambda r: (r.id >= 10) & (r.id < 20)) == 10 and "id" in table._indexes
    index = table._indexes["id"]
    assert table.count(lambda r: r.id == 3) == 1 and table._indexes["id"] is index
    assert table.count(lambda r: r.v < 10) == 9
    assert table.where(lambda r: r.s == "1").count(lambda r: r.id < 70) == 10
    assert table.where(lambda r: r.id < 70).take(5).count() == 5
    table.refresh()
    assert not table._indexes


def test_order_and_parts(people):
    by = people.order_by_desc("amount").then_by("id")
    assert [r.id for r in by.select("id").to_list()] == [2, 12, 1, 11, 3]
    assert [r.id for r in by.take_while(lambda r: r.amount > 100).select("id").to_list()] == [2, 12, 1, 11]
    assert [r.id for r in by.skip_while(lambda r: r.amount > 100).select("id").to_list()] == [3]
    assert [r.id for r in by.skip_last(3).select("id").to_list()] == [2, 12] and by.skip(9).count() == 0
    assert [r.chunk for r in by.chunk(2).to_list()] == [0, 0, 1, 1, 2]
    assert [r.id for r in by.reverse().select("id").take(2).to_list()] == [3, 11]
    assert sorted(r.id for r in people.shuffle(1).select("id").to_list()) == [1, 2, 3, 11, 12]
    assert people.select("active").distinct().count() == 2


def test_stream(spark, people, tmp_path):
    from lodestar.streaming import read_stream

    entity = Entity(id=Column("bigint"), region=Column("string", partition=True))
    stream = read_stream(spark, entity, people.root)
    run = stream.writeStream.format("memory").queryName("arrived").trigger(availableNow=True).option("checkpointLocation", str(tmp_path)).start()
    run.awaitTermination(60)
    assert sorted((r.id, r.region) for r in spark.table("arrived").collect()) == [(1, "us"), (2, "us"), (3, "us"), (11, "eu-west"), (12, "eu-west")]


def test_literal_expressions(people):
    assert people.select(x=lambda r: lit("a").concat(r.name, None)).where(lambda r: r.x == "a").count() == 1
    assert people.select(x=lambda r: r.id.whole_div(-2)).order_by("x").first().x == -6
