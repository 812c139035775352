"""The catalogue: one query per operator over the driver's tables, with the SQL of the same result."""

from __future__ import annotations

import datetime as dt
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.expressions import lit
from lodestar.operators.query import Query
from lodestar.schema import Column, Entity
from lodestar.table import Table

FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def query(sql: str):
    """Register a function of (spark, sf_dir) under its name, with its SQL."""

    def add(make: Callable) -> Callable:
        FOUND[make.__name__] = (make, sql)
        return make

    return add


def of(name: str, sql: str, make: Callable[[SparkSession, str], DataFrame]) -> None:
    FOUND[name] = (make, sql)


# tables
def t(spark: SparkSession, sf: str, name: str) -> Table:
    path = f"{sf}/{name}.parquet"
    return Table.from_path(spark, Entity.of(spark.read.parquet(path).schema), path)


ORDERS = Entity(key=Column("bigint", name="o_orderkey"), customer=Column("bigint", name="o_custkey"), status=Column("string", name="o_orderstatus"), price=Column("double", name="o_totalprice"), day=Column("timestamp_ntz", name="o_orderdate"), priority=Column("string", name="o_orderpriority"))
BY_YEAR = Entity(key=Column("bigint", name="o_orderkey"), price=Column("double", name="o_totalprice"), o_year=Column("int", partition=True), o_orderpriority=Column("string", partition=True))


def orders(spark: SparkSession, sf: str) -> Table:
    return Table.from_path(spark, ORDERS, f"{sf}/orders.parquet")


WRITTEN: dict[tuple[str, str, str], str] = {}


def written(spark: SparkSession, sf: str, kind: str, write: Callable[[str], None]) -> str:
    """A fixture below the shared folder (a temporary one, where none is set), written once an application."""
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in WRITTEN:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lodestar-")
        root = f"{base.rstrip('/')}/lodestar-{kind}-{uuid.uuid4().hex}"
        write(root)
        WRITTEN[key] = root
    return WRITTEN[key]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def hive(spark: SparkSession, sf: str) -> Table:
    def write(root: str) -> None:
        df = spark.read.parquet(f"{sf}/orders.parquet")
        df.withColumn("o_year", F.year("o_orderdate")).write.partitionBy("o_year", "o_orderpriority").parquet(root)

    return Table.from_path(spark, BY_YEAR, written(spark, sf, "hive", write))


def padded(spark: SparkSession, sf: str) -> Table:
    def write(root: str) -> None:
        df = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderdate")
        df.withColumn("month", F.date_format("o_orderdate", "MM")).drop("o_orderdate").write.partitionBy("month").parquet(root)

    return Table.from_path(spark, Entity(key=Column("bigint", name="o_orderkey"), month=Column("int", partition=True)), written(spark, sf, "padded", write))


def mixed(spark: SparkSession, sf: str) -> Table:
    """Finished orders in folders by status, all others in files at the root."""

    def write(root: str) -> None:
        df = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus")
        df.where("o_orderstatus = 'F'").drop("o_orderstatus").write.parquet(f"{root}/status=F")
        df.where("o_orderstatus != 'F'").drop("o_orderstatus").write.mode("append").parquet(root)

    return Table.from_path(spark, Entity(key=Column("bigint", name="o_orderkey"), status=Column("string", partition=True)), written(spark, sf, "mixed", write))


def logged(spark: SparkSession, sf: str) -> Table:
    """Orders by year under a transaction log: all years are added, 1996 is removed, 1997's prices double."""

    def write(root: str) -> None:
        df = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderdate").withColumn("o_year", F.year("o_orderdate")).drop("o_orderdate")
        df.coalesce(1).write.partitionBy("o_year").parquet(root)
        first = files_below(spark, root)
        df.where("o_year = 1997").withColumn("o_totalprice", F.col("o_totalprice") * 2).drop("o_year").coalesce(1).write.mode("append").parquet(f"{root}/o_year=1997")
        later = [f for f in files_below(spark, root) if f not in first]
        meta = {"metaData": {"id": "orders", "partitionColumns": ["o_year"], "schemaString": df.schema.json(), "configuration": {}}}
        added = [{"add": {"path": f, "partitionValues": {"o_year": f.split("=")[1].split("/")[0]}, "size": 1, "modificationTime": 0, "dataChange": True}} for f in first]
        moved = [{"remove": {"path": f, "deletionTimestamp": 1, "dataChange": True}} for f in first if "o_year=1997/" in f]
        moved += [{"add": {"path": f, "partitionValues": {"o_year": "1997"}, "size": 1, "modificationTime": 1, "dataChange": True}} for f in later]
        gone = [{"remove": {"path": f, "deletionTimestamp": 2, "dataChange": True}} for f in first if "o_year=1996/" in f]
        for version, actions in enumerate([[{"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}}, meta, *added], moved, gone]):
            write_text(spark, f"{root}/_delta_log/{version:020}.json", "".join(json.dumps(a) + "\n" for a in actions))

    return Table.from_path(spark, Entity(key=Column("bigint", name="o_orderkey"), price=Column("double", name="o_totalprice"), o_year=Column("int", partition=True)), written(spark, sf, "logged", write))


def files_below(spark: SparkSession, root: str) -> list[str]:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root).select("path").collect()
    mark = root.rstrip("/").rsplit("/", 1)[1] + "/"
    return sorted(r[0].split(mark, 1)[1] for r in found)


#: The tables of ``ranged``: kept, so that indexes and statistics are read once an application.
KEPT: dict[tuple[str, str], Table] = {}


def ranged(spark: SparkSession, sf: str) -> Table:
    """Line items by order key in eight files of disjoint ranges; one table an application, as its users would keep it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in KEPT:
        KEPT[key] = made_ranged(spark, sf)
    return KEPT[key]


def made_ranged(spark: SparkSession, sf: str) -> Table:

    def write(root: str) -> None:
        spark.read.parquet(f"{sf}/lineitem.parquet").repartitionByRange(8, "l_orderkey").write.parquet(root)

    entity = Entity(l_orderkey=Column("bigint", indexed=True), l_quantity=Column("double"), l_shipmode=Column("string", name="l_returnflag"), shipped=Column("timestamp_ntz", name="l_shipdate"))
    return Table.from_path(spark, entity, written(spark, sf, "ranged", write))


def money(r, name: str = "l_extendedprice"):
    return r[name].cast("decimal(18,2)")


def null_if(value, null):
    """The value, or null where it equals ``null``."""
    return value._with(lambda a, b: F.nullif(a, b), null)


def text(value: str):
    """A literal as an expression."""
    return lit(value)


# scans and projections
of("scan_all", "select * from region", lambda s, d: t(s, d, "region").to_df())
of("select_member", "select c_name from customer", lambda s, d: t(s, d, "customer").select("c_name").to_df())
of("select_multi", "select c_custkey, c_mktsegment from customer", lambda s, d: t(s, d, "customer").select("c_custkey", "c_mktsegment").to_df())
of("select_rename", "select n_name as nation, n_regionkey as region from nation", lambda s, d: t(s, d, "nation").select(nation="n_name", region="n_regionkey").to_df())
of("select_computed", "select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as revenue from lineitem", lambda s, d: t(s, d, "lineitem").select("l_orderkey", "l_linenumber", revenue=lambda r: r.l_extendedprice * (1 - r.l_discount)).to_df())
of("select_indexed", "select o_orderkey as key, (row_number() over (order by o_totalprice, o_orderkey) - 1)::bigint as number from orders", lambda s, d: orders(s, d).order_by("price", "key").index("number").select("key", "number").to_df())
of("select_many", "select event_id, unnest(string_split(event_type, 'i')) as part from events", lambda s, d: t(s, d, "events").select("event_id", parts=lambda r: F.split(r.event_type.col, "i")).select_many("parts", "part").select("event_id", "part").to_df())
of("cast", "select p_partkey, p_size::bigint as p_size from part", lambda s, d: t(s, d, "part").select("p_partkey", "p_size").cast(p_size="bigint").to_df())
of("of_type", "select o_orderkey as key, try_cast(left(o_orderpriority, 1) as integer) as level from orders where try_cast(left(o_orderpriority, 1) as integer) is not null", lambda s, d: orders(s, d).select("key", level=lambda r: r.priority.substring(0, 1)).of_type(level="int").to_df())
of("convert_widening", "select p_partkey, p_size::double as p_size, p_retailprice from part", lambda s, d: Table.from_path(s, Entity(p_partkey=Column("bigint"), p_size=Column("double"), p_retailprice=Column("double")), f"{d}/part.parquet").to_df())
of("allow_missing", "select r_regionkey, null::varchar as remark from region", lambda s, d: Table.from_path(s, Entity(r_regionkey=Column("int"), remark=Column("string", allow_missing=True)), f"{d}/region.parquet").to_df())


# predicates
def where(name: str, sql: str, condition: Callable, table: str = "orders", columns: tuple[str, ...] = ("o_orderkey",)) -> None:
    of(f"where_{name}", f"select {', '.join(columns)} from {table} where {sql}", lambda s, d: t(s, d, table).where(condition).select(*columns).to_df())


where("eq", "o_orderstatus = 'F'", lambda r: r.o_orderstatus == "F")
where("ne", "o_orderstatus is distinct from 'F'", lambda r: r.o_orderstatus != "F")
where("ne_null", "nullif(o_orderstatus, 'O') is distinct from 'F'", lambda r: null_if(r.o_orderstatus, "O") != "F")
where("gt", "o_custkey > 100", lambda r: r.o_custkey > 100)
where("ge", "o_custkey >= 100", lambda r: r.o_custkey >= 100)
where("lt", "o_custkey < 100", lambda r: r.o_custkey < 100)
where("le", "o_custkey <= 100", lambda r: r.o_custkey <= 100)
where("reversed_operand", "250000 < o_totalprice", lambda r: 250000 < r.o_totalprice)
where("and", "o_totalprice > 100000 and o_orderstatus = 'O'", lambda r: (r.o_totalprice > 100000) & (r.o_orderstatus == "O"))
where("or", "o_totalprice > 400000 or o_orderstatus = 'P'", lambda r: (r.o_totalprice > 400000) | (r.o_orderstatus == "P"))
where("not", "not (o_totalprice > 100000)", lambda r: ~(r.o_totalprice > 100000))
where("not_null", "not coalesce(nullif(o_custkey, 1) > 100, false)", lambda r: ~(null_if(r.o_custkey, 1) > 100))
of("where_bool", "select o_orderkey as key from orders where o_totalprice > 200000", lambda s, d: orders(s, d).select("key", dear=lambda r: r.price > 200000).where("dear").select("key").to_df())
where("string_compare", "o_orderpriority >= '3'", lambda r: r.o_orderpriority.compare("3") >= 0)
where("startswith", "o_orderpriority like '1%'", lambda r: r.o_orderpriority.starts_with("1"))
where("endswith", "o_orderpriority like '%LOW'", lambda r: r.o_orderpriority.ends_with("LOW"))
where("contains", "o_orderpriority like '%I%'", lambda r: r.o_orderpriority.contains("I"))
where("not_contains", "o_orderpriority not like '%I%'", lambda r: ~r.o_orderpriority.contains("I"))
where("equals_ignore_case", "lower(o_orderpriority) = '1-urgent'", lambda r: r.o_orderpriority.equals_ignore_case("1-Urgent"))
where("lower", "lower(o_orderpriority) = '2-high'", lambda r: r.o_orderpriority.to_lower() == "2-high")
where("upper", "upper(c_mktsegment) = 'BUILDING'", lambda r: r.c_mktsegment.to_upper() == "BUILDING", "customer", ("c_custkey",))
where("trim", "trim('  ' || o_orderstatus || ' ') = 'F'", lambda r: text("  ").concat(r.o_orderstatus, " ").trim() == "F")
where("is_null_or_empty", "nullif(o_orderstatus, 'F') is null", lambda r: null_if(r.o_orderstatus, "F").is_null_or_empty())
where("is_null_or_whitespace", "trim(replace(o_orderstatus, 'F', '  ')) = ''", lambda r: r.o_orderstatus.replace("F", "  ").is_null_or_white_space())
where("in", "o_custkey in (1, 5, 7, 11)", lambda r: r.o_custkey.is_in([1, 5, 7, 11]))
where("timestamp_range", "o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1997-01-01'", lambda r: (r.o_orderdate >= dt.datetime(1996, 1, 1)) & (r.o_orderdate < dt.datetime(1997, 1, 1)))
where("date", "o_orderdate::date = date '1996-01-02'", lambda r: r.o_orderdate.date() == dt.date(1996, 1, 2))
where("substring", "substr(o_orderpriority, 3, 3) = 'MED'", lambda r: r.o_orderpriority.substring(2, 3) == "MED")
where("index_of", "strpos(o_orderpriority, 'H') = 3", lambda r: r.o_orderpriority.index_of("H") == 2)
where("length", "length(o_orderpriority) > 8", lambda r: r.o_orderpriority.length() > 8)
where("year_month_day", "year(o_orderdate) = 1997 and month(o_orderdate) = 2 and day(o_orderdate) < 9", lambda r: (r.o_orderdate.year() == 1997) & (r.o_orderdate.month() == 2) & (r.o_orderdate.day() < 9))
where("add_days", "(o_orderdate::date + 30) >= date '1998-01-15'", lambda r: r.o_orderdate.date().add_days(30) >= dt.date(1998, 1, 15))
where("coalesce", "coalesce(nullif(o_custkey, 1), 9) = 9", lambda r: null_if(r.o_custkey, 1).or_else(9) == 9)
where("has_value", "nullif(o_custkey, 1) is not null", lambda r: null_if(r.o_custkey, 1).has_value())
where("conditional", "(case when o_orderstatus = 'F' then o_totalprice else 0 end) > 200000", lambda r: (r.o_orderstatus == "F").choose(r.o_totalprice, 0.0) > 200000)
where("whole_div", "o_custkey // 10 = 3", lambda r: r.o_custkey.whole_div(10) == 3)
where("math", "abs(floor(o_totalprice / 1000) - 100) <= 2 and ceil(o_totalprice / 1000) <> 101", lambda r: (((r.o_totalprice / 1000).floor() - 100).abs() <= 2) & ((r.o_totalprice / 1000).ceiling() != 101))
of("round_half_even", "select p_partkey, (case when p_size % 2 = 0 then p_size / 2 else 2 * floor((p_size + 1) / 4) end)::bigint as half from part", lambda s, d: t(s, d, "part").select("p_partkey", half=lambda r: (r.p_size.cast("decimal(10,1)") / 2).round().cast("bigint")).to_df())
of("where_chained", "select l_orderkey, l_linenumber from lineitem where l_quantity < 24 and l_discount >= 0.05 and l_returnflag = 'R'", lambda s, d: t(s, d, "lineitem").where(lambda r: r.l_quantity < 24).where(lambda r: r.l_discount >= 0.05).where(lambda r: r.l_returnflag == "R").select("l_orderkey", "l_linenumber").to_df())


# terminals, as one-row frames
of("any_true", "select exists(select 1 from orders where o_totalprice > 1000) as result", lambda s, d: orders(s, d).frame_any(lambda r: r.price > 1000))
of("any_false", "select exists(select 1 from orders where o_totalprice < 0) as result", lambda s, d: orders(s, d).frame_any(lambda r: r.price < 0))
of("all_true", "select not exists(select 1 from orders where not o_totalprice > 0) as result", lambda s, d: orders(s, d).frame_all(lambda r: r.price > 0))
of("all_false", "select not exists(select 1 from orders where not o_totalprice > 100000) as result", lambda s, d: orders(s, d).frame_all(lambda r: r.price > 100000))
of("all_empty", "select true as result", lambda s, d: orders(s, d).where(lambda r: r.price < 0).frame_all(lambda r: r.price > 1e9))
of("first_ordered", "select o_orderkey as key, o_totalprice as price from orders order by o_totalprice desc, o_orderkey limit 1", lambda s, d: orders(s, d).select("key", "price").order_by_desc("price").then_by("key").frame_first())
of("first_in_scan", "select min(o_orderkey) as key from orders where o_orderkey = (select min(o_orderkey) from orders)", lambda s, d: orders(s, d).select("key").frame_first())
of("first_or_default_none", "select o_orderkey as key from orders where o_totalprice < 0", lambda s, d: orders(s, d).select("key", "price").where(lambda r: r.price < 0).select("key").frame_first())
of("last_ordered", "select o_orderkey as key from orders order by o_totalprice desc, o_orderkey desc limit 1", lambda s, d: orders(s, d).order_by("price", "key").select("key").frame_last())
of("single", "select o_orderkey as key, o_totalprice as price from orders where o_orderkey = (select min(o_orderkey) from orders)", lambda s, d: single(orders(s, d)))
of("element_at", "select o_orderkey as key from orders order by o_totalprice, o_orderkey limit 1 offset 10", lambda s, d: orders(s, d).order_by("price", "key").select("key").frame_element_at(10))
of("contains", "select exists(select 1 from region where r_regionkey = 1 and r_name = 'AMERICA') as result", lambda s, d: t(s, d, "region").frame_contains(r_regionkey=1, r_name="AMERICA"))
of("default_if_empty", "select -1::bigint as key", lambda s, d: orders(s, d).where(lambda r: r.price < 0).select("key").default_if_empty(key=-1).to_df())


def single(table: Query) -> DataFrame:
    least = table.min("key")
    found = table.select("key", "price").single(lambda r: r.key == least)
    return table._lean.sparkSession.createDataFrame([tuple(found)], "key long, price double")


# aggregates
L = "l_extendedprice::decimal(18,2)"
of("count", "select count(*) as n from lineitem", lambda s, d: t(s, d, "lineitem").frame_count())
of("count_pred", "select count(*) as n from lineitem where l_quantity > 25", lambda s, d: t(s, d, "lineitem").frame_count(lambda r: r.l_quantity > 25))
of("long_count", "select count(*) as n from events", lambda s, d: t(s, d, "events").frame_count())
of("sum", f"select sum({L})::decimal(28,2) as total from lineitem", lambda s, d: t(s, d, "lineitem").frame(total=lambda g: g.sum(money)).select(F.col("total").cast("decimal(28,2)").alias("total")))
of("sum_empty", "select 0::decimal(28,2) as total", lambda s, d: t(s, d, "lineitem").where(lambda r: r.l_quantity < 0).frame(total=lambda g: g.sum(money)).select(F.col("total").cast("decimal(28,2)").alias("total")))
of("average", "select round(avg(o_custkey), 6) as mean from orders", lambda s, d: orders(s, d).frame(mean=lambda g: g.average("customer")).select(F.round("mean", 6).alias("mean")))
of("min", "select min(o_totalprice) as least from orders", lambda s, d: orders(s, d).frame(least=lambda g: g.min("price")))
of("max", "select max(o_totalprice) as most from orders", lambda s, d: orders(s, d).frame(most=lambda g: g.max("price")))
of("min_by", "select o_orderkey as key from orders order by o_totalprice, o_orderkey limit 1", lambda s, d: orders(s, d).order_by("key").min_by("price").select("key").to_df())
of("max_by", "select o_orderkey as key from orders order by o_totalprice desc, o_orderkey limit 1", lambda s, d: orders(s, d).order_by("key").max_by("price").select("key").to_df())
of("aggregate_fold", "select sum(n_nationkey * 2)::bigint as total from nation", lambda s, d: t(s, d, "nation").frame(total=lambda g: g.fold(lambda r: r.n_nationkey.cast("bigint"), F.lit(0).cast("bigint"), lambda a, x: a + 2 * x)))
of("aggregate_by", "select n_regionkey, string_agg(n_name, '>' order by n_nationkey) as names from nation group by 1", lambda s, d: t(s, d, "nation").order_by("n_nationkey").aggregate_by("n_regionkey", seed="", of="n_name", step=lambda a, x: F.when(a == "", x).otherwise(F.concat(a, F.lit(">"), x)), name="names").to_df())
of("group_count", "select o_orderpriority as priority, count(*) as n from orders group by 1", lambda s, d: orders(s, d).group_by("priority").agg(n=lambda g: g.count()).to_df())
of("group_null_key", "select nullif(o_orderstatus, 'P') as status, count(*) as n from orders group by 1", lambda s, d: orders(s, d).group_by(status=lambda r: null_if(r.status, "P")).agg(n=lambda g: g.count()).to_df())
of("group_multi_agg", f"select l_returnflag, sum({L})::decimal(28,2) as total, min(l_quantity) as least, max(l_quantity) as most, count(*) as n from lineitem group by 1", lambda s, d: t(s, d, "lineitem").group_by("l_returnflag").agg(total=lambda g: g.sum(money), least=lambda g: g.min("l_quantity"), most=lambda g: g.max("l_quantity"), n=lambda g: g.count()).select("l_returnflag", "least", "most", "n", total=lambda r: r.total.cast("decimal(28,2)")).to_df())
of("group_composite_key", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by 1, 2", lambda s, d: t(s, d, "lineitem").group_by("l_returnflag", "l_linestatus").agg(n=lambda g: g.count()).to_df())
of("group_count_if", "select o_orderpriority as priority, count(*) filter (o_totalprice > 200000) as n from orders group by 1", lambda s, d: orders(s, d).group_by("priority").agg(n=lambda g: g.count(lambda r: r.price > 200000)).to_df())
of("group_having", "select o_custkey as customer, count(*) as n from orders group by 1 having count(*) > 12", lambda s, d: orders(s, d).group_by("customer").agg(n=lambda g: g.count()).where(lambda r: r.n > 12).to_df())
of("group_number_of_groups", "select count(distinct o_custkey) as n from orders", lambda s, d: orders(s, d).group_by("customer").keys().frame_count())
of("group_items", "select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by 1", lambda s, d: t(s, d, "nation").group_by("n_regionkey").agg(names=lambda g: g.items("n_name")).select("n_regionkey", names=lambda r: F.array_join(r.names.col, ",")).to_df())
of("count_by", "select event_type, count(*) as n from events group by 1", lambda s, d: t(s, d, "events").count_by("event_type").to_df())

of("reduce", "select string_agg(n_name, '+' order by n_name desc) as names from nation", lambda s, d: t(s, d, "nation").order_by_desc("n_name").frame(names=lambda g: g.reduce("n_name", lambda a, x: F.concat(a, F.lit("+"), x))))
of("fold_mixed_order", "select string_agg(n_name, '' order by n_regionkey, n_name desc) as names from nation", lambda s, d: t(s, d, "nation").order_by("n_regionkey").then_by_desc("n_name").frame(names=lambda g: g.fold("n_name", "", lambda a, x: F.concat(a, x))))
of("fold_descending", "select n_regionkey, string_agg(n_name, '' order by n_regionkey desc, n_nationkey) as names from nation group by 1", lambda s, d: t(s, d, "nation").order_by_desc("n_regionkey").aggregate_by("n_regionkey", seed="", of="n_name", step=lambda a, x: F.concat(a, x), name="names").to_df())

# order, parts, sets
O10 = "select o_orderkey as key, o_totalprice as price from orders"
of("order_by", f"{O10} order by price, key", lambda s, d: orders(s, d).select("key", "price").order_by("price", "key").to_df())
of("order_by_desc", f"{O10} order by price desc, key desc", lambda s, d: orders(s, d).select("key", "price").order_by_desc("price", "key").to_df())
of("then_by", "select o_orderkey as key, row_number() over (order by o_orderpriority, o_totalprice desc, o_orderkey) - 1 as at from orders", lambda s, d: orders(s, d).order_by("priority").then_by_desc("price").then_by("key").index("at").select("key", "at").to_df())
of("take", f"{O10} order by price, key limit 25", lambda s, d: orders(s, d).select("key", "price").order_by("price", "key").take(25).to_df())
of("skip", f"{O10} order by price, key offset 50", lambda s, d: orders(s, d).select("key", "price").order_by("price", "key").skip(50).to_df())
of("skip_take", f"{O10} order by price, key limit 10 offset 20", lambda s, d: orders(s, d).select("key", "price").order_by("price", "key").page(20, 10).to_df())
of("take_then_where", f"select * from ({O10} order by price desc, key limit 100) where key % 2 = 0", lambda s, d: orders(s, d).select("key", "price").order_by_desc("price").then_by("key").take(100).where(lambda r: r.key % 2 == 0).to_df())
of("top_k", f"{O10} order by price desc, key limit 10", lambda s, d: orders(s, d).select("key", "price").order_by_desc("price").then_by("key").take(10).to_df())
WHILE = "(select o_orderkey as key, o_totalprice as price, max((not o_totalprice < 300000)::int) over (order by o_orderkey) as gone from orders)"
of("take_while", f"select key, price from {WHILE} where gone = 0", lambda s, d: orders(s, d).order_by("key").take_while(lambda r: r.price < 300000).select("key", "price").to_df())
of("skip_while", f"select key, price from {WHILE} where gone = 1", lambda s, d: orders(s, d).order_by("key").skip_while(lambda r: r.price < 300000).select("key", "price").to_df())
of("take_range", f"{O10} order by price, key limit 15 offset 5", lambda s, d: orders(s, d).select("key", "price").order_by("price", "key").take_range(5, 20).to_df())
of("take_range_from_end", f"select * from ({O10} order by price desc, key desc limit 6 offset 4)", lambda s, d: orders(s, d).select("key", "price").order_by("price", "key").take_range(-10, -4).to_df())
of("where_indexed", "select key, price from (select o_orderkey as key, o_totalprice as price, row_number() over (order by o_totalprice, o_orderkey) - 1 as place from orders) where place % 7 = 3 and price > 50000", lambda s, d: orders(s, d).order_by("price", "key").where_indexed(lambda r, i: (i % 7 == 3) & (r.price > 50000)).select("key", "price").to_df())
of("take_while_indexed", f"{O10} order by price, key limit 12", lambda s, d: orders(s, d).order_by("price", "key").take_while_indexed(lambda r, i: i < 12).select("key", "price").to_df())
of("skip_while_indexed", f"{O10} order by price, key offset 12", lambda s, d: orders(s, d).order_by("price", "key").skip_while_indexed(lambda r, i: i < 12).select("key", "price").to_df())
of("take_last", f"{O10} order by price desc, key desc limit 7", lambda s, d: orders(s, d).select("key", "price").order_by("price", "key").take_last(7).to_df())
of("skip_last", f"{O10} order by price desc, key desc offset 7", lambda s, d: orders(s, d).select("key", "price").order_by("price", "key").skip_last(7).to_df())
TWICE = "(select o_custkey % 10 as c from orders union all select o_custkey % 10 from orders)"
of("skip_ties", f"select c from {TWICE} order by c offset 7", lambda s, d: twice(s, d).order_by("c").skip(7).to_df())
of("skip_last_ties", f"select c from {TWICE} order by c desc offset 7", lambda s, d: twice(s, d).order_by("c").skip_last(7).to_df())
of("reverse", "select o_orderkey as key, row_number() over (order by o_totalprice desc, o_orderkey desc) - 1 as at from orders", lambda s, d: orders(s, d).order_by("price", "key").reverse().index("at").select("key", "at").to_df())
of("chunk", "select chunk, count(*) as n, min(price) as least from (select o_totalprice as price, ((row_number() over (order by o_totalprice, o_orderkey) - 1) // 100)::bigint as chunk from orders) group by 1", lambda s, d: orders(s, d).order_by("price", "key").chunk(100).group_by("chunk").agg(n=lambda g: g.count(), least=lambda g: g.min("price")).to_df())
of("zip", "select a.r_name as a, b.n_name as b from (select r_name, row_number() over (order by r_regionkey) k from region) a join (select n_name, row_number() over (order by n_nationkey desc) k from nation) b using (k)", lambda s, d: t(s, d, "region").order_by("r_regionkey").select(a="r_name").zip(t(s, d, "nation").order_by_desc("n_nationkey"), b="n_name").to_df())
of("distinct", "select distinct l_returnflag, l_linestatus from lineitem", lambda s, d: t(s, d, "lineitem").select("l_returnflag", "l_linestatus").distinct().to_df())
of("distinct_by", "select o_custkey as customer, min(o_orderkey) as key from orders group by 1", lambda s, d: orders(s, d).order_by("key").distinct_by("customer").select("customer", "key").to_df())
LOW, HIGH = "select o_custkey as customer from orders where o_totalprice < 200000", "select o_custkey as customer from orders where o_totalprice > 150000"


def low(s, d) -> Query:
    return orders(s, d).where(lambda r: r.price < 200000).select("customer")


def high(s, d) -> Query:
    return orders(s, d).where(lambda r: r.price > 150000).select("customer")


def twice(s, d) -> Query:
    own = orders(s, d).select(c=lambda r: r.customer % 10)
    return own.concat(own)


of("concat", f"{LOW} union all {HIGH}", lambda s, d: low(s, d).concat(high(s, d)).to_df())
of("union", f"{LOW} union {HIGH}", lambda s, d: low(s, d).union(high(s, d)).to_df())
of("intersect", f"{LOW} intersect {HIGH}", lambda s, d: low(s, d).intersect(high(s, d)).to_df())
of("except", f"{LOW} except {HIGH}", lambda s, d: low(s, d).except_(high(s, d)).to_df())
of("union_by", "select c_nationkey as nation, min(c_custkey) as k from customer group by 1 union all select s_nationkey, min(s_suppkey) from supplier where s_nationkey not in (select c_nationkey from customer) group by 1", lambda s, d: t(s, d, "customer").select(nation="c_nationkey", k="c_custkey").union_by(t(s, d, "supplier").select(nation="s_nationkey", k="s_suppkey"), "nation").to_df())
of("intersect_by", "select c_nationkey, min(c_custkey) as c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 1) group by 1", lambda s, d: t(s, d, "customer").select("c_nationkey", "c_custkey").order_by("c_custkey").intersect_by(t(s, d, "nation").where(lambda r: r.n_regionkey == 1).select("n_nationkey"), "c_nationkey").to_df())
of("except_by", "select c_nationkey, min(c_custkey) as c_custkey from customer where c_nationkey not in (select n_nationkey from nation where n_regionkey = 1) group by 1", lambda s, d: t(s, d, "customer").select("c_nationkey", "c_custkey").order_by("c_custkey").except_by(t(s, d, "nation").where(lambda r: r.n_regionkey == 1).select("n_nationkey"), "c_nationkey").to_df())
of("append", "select r_regionkey, r_name from region union all select 99, 'NOWHERE'", lambda s, d: t(s, d, "region").append(r_regionkey=99, r_name="NOWHERE").to_df())
of("prepend", "select r_name, row_number() over (order by k) - 1 as at from (select r_name, r_regionkey k from region union all select 'NOWHERE', -1)", lambda s, d: t(s, d, "region").order_by("r_regionkey").prepend(r_regionkey=99, r_name="NOWHERE").index("at").select("r_name", "at").to_df())

of("concat_first", "select max(r_regionkey) as r_regionkey from region", lambda s, d: t(s, d, "region").order_by_desc("r_regionkey").take(1).concat(t(s, d, "region")).select("r_regionkey").frame_first())
of("concat_index", "select r_name, row_number() over (order by r_regionkey < 3, r_regionkey) - 1 as at from region", lambda s, d: t(s, d, "region").where(lambda r: r.r_regionkey >= 3).concat(t(s, d, "region").where(lambda r: r.r_regionkey < 3)).index("at").select("r_name", "at").to_df())
of("union_index", "select r, row_number() over (order by r <> 4, r) - 1 as at from (select distinct n_regionkey as r from nation)", lambda s, d: t(s, d, "nation").where(lambda r: r.n_regionkey == 4).select(r="n_regionkey").union(t(s, d, "nation").order_by("n_regionkey").select(r="n_regionkey")).index("at").select("r", "at").to_df())

# joins
of("join_index", "select r_name, n_name, row_number() over (order by r_regionkey desc, n_name) - 1 as at from region join nation on r_regionkey = n_regionkey", lambda s, d: t(s, d, "region").order_by_desc("r_regionkey").join(t(s, d, "nation").order_by("n_name"), "r_regionkey", "n_regionkey").index("at").select("r_name", "n_name", "at").to_df())
of("group_index", "select r, row_number() over (order by first) - 1 as at from (select n_regionkey as r, min(n_name) as first from nation group by 1)", lambda s, d: t(s, d, "nation").order_by("n_name").group_by(r="n_regionkey").agg(n=lambda g: g.count()).index("at").select("r", "at").to_df())
of("join_inner", "select o_orderkey as key, c_name from orders join customer on o_custkey = c_custkey", lambda s, d: orders(s, d).join(t(s, d, "customer"), "customer", "c_custkey").select("key", "c_name").to_df())
of("join_null_keys", "select count(*) as n from orders join customer on nullif(o_custkey, 1) = nullif(c_custkey, 1)", lambda s, d: orders(s, d).join(t(s, d, "customer"), lambda r: null_if(r.customer, 1), lambda r: null_if(r.c_custkey, 1)).frame_count())
of("group_join_count", "select c_custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by 1", lambda s, d: t(s, d, "customer").group_join(orders(s, d), "c_custkey", "customer", n=lambda g: g.count()).select("c_custkey", "n").to_df())
of("left_join", "select c_custkey, o_orderkey as key from customer left join orders on o_custkey = c_custkey and o_totalprice > 400000", lambda s, d: t(s, d, "customer").left_join(orders(s, d).where(lambda r: r.price > 400000), "c_custkey", "customer").select("c_custkey", "key").to_df())
of("right_join", "select n_name, r_name from (select * from nation where n_regionkey < 3) right join region on n_regionkey = r_regionkey", lambda s, d: t(s, d, "nation").where(lambda r: r.n_regionkey < 3).right_join(t(s, d, "region"), "n_regionkey", "r_regionkey").select("n_name", "r_name").to_df())
of("cross_join", "select r_name, n_name from region, nation", lambda s, d: t(s, d, "region").cross_join(t(s, d, "nation")).select("r_name", "n_name").to_df())
of("theta_join", "select a.n_name as a, b.n_name as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey", lambda s, d: t(s, d, "nation").select(a="n_name", ra="n_regionkey", ka="n_nationkey").cross_join(t(s, d, "nation").select(b="n_name", rb="n_regionkey", kb="n_nationkey"), on=lambda x, y: (x.ra == y.rb) & (x.ka < y.kb)).select("a", "b").to_df())
of("semi_join", "select c_custkey from customer where exists(select 1 from orders where o_custkey = c_custkey)", lambda s, d: t(s, d, "customer").semi_join(orders(s, d), "c_custkey", "customer").select("c_custkey").to_df())
of("anti_join", "select c_custkey from customer where not exists(select 1 from orders where o_custkey = c_custkey and o_totalprice > 250000)", lambda s, d: t(s, d, "customer").anti_join(orders(s, d).where(lambda r: r.price > 250000), "c_custkey", "customer").select("c_custkey").to_df())
of("self_join", "select a.n_nationkey as x, count(*) as n from nation a join nation b on a.n_regionkey = b.n_regionkey group by 1", lambda s, d: (lambda q: q.join(q, "n_regionkey", "n_regionkey", names={"y": "n_nationkey"}).count_by("n_nationkey").select("n", x="n_nationkey").to_df())(t(s, d, "nation")))

# partitioned, logged, indexed
YEARS = "(select o_orderkey as key, o_totalprice as price, year(o_orderdate)::int as o_year, lower(o_orderpriority) as o_orderpriority from orders)"
of("hive_scan", f"select * from {YEARS}", lambda s, d: hive(s, d).to_df())
of("hive_prune_one", f"select key from {YEARS} where o_year = 1996", lambda s, d: hive(s, d).where(lambda r: r.o_year == 1996).select("key").to_df())
of("hive_prune_multi", f"select key from {YEARS} where o_year = 1996 and o_orderpriority = '1-urgent'", lambda s, d: hive(s, d).where(lambda r: (r.o_year == 1996) & (r.o_orderpriority == "1-urgent")).select("key").to_df())
of("hive_prune_or", f"select key from {YEARS} where o_orderpriority = '1-urgent' or o_orderpriority = '5-low'", lambda s, d: hive(s, d).where(lambda r: (r.o_orderpriority == "1-urgent") | (r.o_orderpriority == "5-low")).select("key").to_df())
of("hive_prune_mixed", f"select key from {YEARS} where o_year = 1996 and price > 200000", lambda s, d: hive(s, d).where(lambda r: (r.o_year == 1996) & (r.price > 200000)).select("key").to_df())
of("hive_group_by_partition", f"select o_orderpriority, count(*) as n from {YEARS} group by 1", lambda s, d: hive(s, d).group_by("o_orderpriority").agg(n=lambda g: g.count()).to_df())
of("hive_partition_values", f"select distinct o_year, o_orderpriority from {YEARS}", lambda s, d: hive(s, d).partitions().select(F.col("values")["o_year"].cast("int").alias("o_year"), F.lower(F.col("values")["o_orderpriority"]).alias("o_orderpriority")))
of("hive_leading_zero", "select o_orderkey as key from orders where month(o_orderdate) = 6", lambda s, d: padded(s, d).where(lambda r: r.month == 6).select("key").to_df())
of("hive_case_sensitive_value", "select o_orderkey as key from orders where false", lambda s, d: hive(s, d).where(lambda r: r.o_orderpriority == "1-URGENT").select("key").to_df())
of("hive_ignore_case", f"select key from {YEARS} where o_orderpriority = '1-urgent'", lambda s, d: hive(s, d).where(lambda r: r.o_orderpriority.equals_ignore_case("1-URGENT")).select("key").to_df())
of("mixed_layout", "select o_orderkey as key, case when o_orderstatus = 'F' then 'f' end as status from orders", lambda s, d: mixed(s, d).to_df())
LOGGED = "(select o_orderkey as key, case when year(o_orderdate) = 1997 then o_totalprice * 2 else o_totalprice end as price, year(o_orderdate)::int as o_year from orders where year(o_orderdate) <> 1996)"
of("delta_snapshot", f"select * from {LOGGED}", lambda s, d: logged(s, d).to_df())
of("delta_after_remove", f"select count(*) as n from {LOGGED} where o_year = 1996", lambda s, d: logged(s, d).frame_count(lambda r: r.o_year == 1996))
of("delta_prune", f"select key, price from {LOGGED} where o_year = 1997", lambda s, d: logged(s, d).where(lambda r: r.o_year == 1997).select("key", "price").to_df())
of("delta_aggregate", f"select o_year, count(*) as n, max(price) as most from {LOGGED} group by 1", lambda s, d: logged(s, d).group_by("o_year").agg(n=lambda g: g.count(), most=lambda g: g.max("price")).to_df())
of("index_count_eq", "select count(*) as n from lineitem where l_orderkey = 7", lambda s, d: number(ranged(s, d), lambda r: r.l_orderkey == 7))
of("index_count_range", "select count(*) as n from lineitem where l_orderkey >= 100 and l_orderkey < 900", lambda s, d: number(ranged(s, d), lambda r: (r.l_orderkey >= 100) & (r.l_orderkey < 900)))
of("index_count_prefix", "select count(*) as n from customer where c_name like 'Customer#00000001%'", lambda s, d: number(Table.from_path(s, Entity(c_name=Column("string", indexed=True)), f"{d}/customer.parquet"), lambda r: r.c_name.starts_with("Customer#00000001")))
of("index_where_project", "select l_orderkey, l_quantity from lineitem where l_orderkey = 11", lambda s, d: ranged(s, d).lookup(lambda r: r.l_orderkey == 11).select("l_orderkey", "l_quantity").to_df())
of("index_with_other_predicate", "select count(*) as n from lineitem where l_orderkey < 500 and l_quantity > 20", lambda s, d: number(ranged(s, d).where(lambda r: r.l_quantity > 20), lambda r: r.l_orderkey < 500))
of("range_file_pruning", "select l_orderkey, l_quantity from lineitem where l_orderkey between 200 and 300", lambda s, d: ranged(s, d).in_range("l_orderkey", 200, 300).select("l_orderkey", "l_quantity").to_df())
of("range_where", "select l_orderkey, l_quantity from lineitem where l_orderkey >= 200 and l_orderkey < 300 and l_quantity > 10", lambda s, d: ranged(s, d).where(lambda r: (r.l_orderkey >= 200) & (r.l_quantity > 10)).where(lambda r: r.l_orderkey < 300).select("l_orderkey", "l_quantity").to_df())
of("take_leading", "select count(*) as n, max(l_orderkey) <= (select max(l_orderkey) from lineitem) as inside from (select * from lineitem order by l_orderkey limit 100)", lambda s, d: ranged(s, d).take(100).frame(n=lambda g: g.count(), top=lambda g: g.max("l_orderkey")).select("n", (F.col("top") > 0).alias("inside")))
of("stats_min_max", "select min(l_orderkey) as least, max(l_orderkey) as most from lineitem", lambda s, d: ranged(s, d).column_statistics().where("column = 'l_orderkey'").agg(F.min(F.col("min_value").cast("long")).alias("least"), F.max(F.col("max_value").cast("long")).alias("most")))
of("row_groups", "select count(*) as n from lineitem", lambda s, d: ranged(s, d).row_groups().agg(F.sum("rows").alias("n")))


def number(table: Query, condition: Callable) -> DataFrame:
    return (table._lean.sparkSession).createDataFrame([(table.count(condition),)], "n long")


@query(f"select sum(({L} * l_discount::decimal(18,2)))::decimal(38,4) as revenue from lineitem where l_discount >= 0.05 and l_discount <= 0.07 and l_quantity < 24 and l_shipdate >= timestamp '1996-01-01' and l_shipdate < timestamp '1997-01-01'")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue of small, discounted items shipped in a year."""
    items = t(spark, sf, "lineitem").where(lambda r: (r.l_discount >= 0.05) & (r.l_discount <= 0.07) & (r.l_quantity < 24) & (r.l_shipdate >= dt.datetime(1996, 1, 1)) & (r.l_shipdate < dt.datetime(1997, 1, 1)))
    return items.frame(revenue=lambda g: g.sum(lambda r: money(r) * money(r, "l_discount"))).select(F.col("revenue").cast("decimal(38,4)").alias("revenue"))
