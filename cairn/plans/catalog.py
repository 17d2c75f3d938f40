"""The catalogue: each operator as a query over the driver's tables, with the same question in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text, wire
from cairn.operators import chunks, objects, state, trees, versions
from cairn.operators.indexing import index_commits
from cairn.schemas import BLOB, FILE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Views of the driver's tables as stored objects, files, commits and trees.


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def entries(self) -> DataFrame:
        """Archive entries: documents by source."""
        return self.documents.select(F.col("source").alias("archive"), F.col("doc_id").alias("seq"), F.sha1("text").alias("ref"), F.octet_length("text").cast("long").alias("length"), F.lit(BLOB).alias("type"), F.col("text").alias("payload"))

    def meta(self) -> DataFrame:
        return self.entries().drop("payload")

    def all_objects(self) -> DataFrame:
        turns = self.conversations.select(F.lit("conversations").alias("archive"), F.sha1("text").alias("ref"), F.octet_length("text").cast("long").alias("length"), F.lit(FILE).alias("type"), F.col("text").alias("payload"))
        return self.entries().drop("seq").unionByName(turns)

    def files(self) -> DataFrame:
        """File versions: events by user."""
        return self.events.select(F.col("event_type").alias("set"), F.col("user_id").alias("path"), "ts", F.col("event_id").alias("ref"), F.floor("value").cast("long").alias("size"))

    def commits(self) -> DataFrame:
        """Commits: orders by priority."""
        return self.orders.select(F.col("o_orderpriority").alias("set"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("ref"))

    def edges(self, orders: bool = False) -> DataFrame:
        """Trees: regions, nations, customers and, if asked for, orders as files."""
        row = lambda df, of, name, tree, ref: df.select(F.concat(F.lit(of[0]), F.col(of[1]).cast("string")).alias("tree_ref"), name.alias("name"), F.lit(tree).alias("is_tree"), F.concat(F.lit(ref[0]), F.col(ref[1]).cast("string")).alias("child_ref"))
        top = self.region.select(F.lit("root").alias("tree_ref"), F.col("r_name").alias("name"), F.lit(True).alias("is_tree"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("child_ref"))
        out = top.unionByName(row(self.nation, ("r", "n_regionkey"), F.col("n_name"), True, ("n", "n_nationkey"))).unionByName(row(self.customer, ("n", "c_nationkey"), F.col("c_name"), orders, ("c", "c_custkey")))
        return out.unionByName(row(self.orders, ("c", "o_custkey"), F.col("o_orderkey").cast("string"), False, ("o", "o_orderkey"))) if orders else out

    def roots(self) -> DataFrame:
        return self.spark.range(1).select(F.lit("root").alias("ref"))


ENTRIES = "(select source as archive, doc_id as seq, sha1(text) as ref, cast(strlen(text) as bigint) as length, 4 as type, text as payload from documents)"
ALL = f"(select archive, ref, length, type from {ENTRIES} union all select 'conversations', sha1(text), cast(strlen(text) as bigint), 3 from conversations)"
FILES = "(select event_type as set, user_id as path, ts, event_id as ref, cast(floor(value) as bigint) as size from events)"
COMMITS = "(select o_orderpriority as set, o_orderdate as ts, o_orderkey as ref from orders)"
EDGES = """(select 'root' as tree_ref, r_name as name, true as is_tree, 'r' || r_regionkey as child_ref from region
    union all select 'r' || n_regionkey, n_name, true, 'n' || n_nationkey from nation
    union all select 'n' || c_nationkey, c_name, false, 'c' || c_custkey from customer)"""
DEEP = """(select 'root' as tree_ref, r_name as name, true as is_tree, 'r' || r_regionkey as child_ref from region
    union all select 'r' || n_regionkey, n_name, true, 'n' || n_nationkey from nation
    union all select 'n' || c_nationkey, c_name, true, 'c' || c_custkey from customer
    union all select 'c' || o_custkey, cast(o_orderkey as varchar), false, 'o' || o_orderkey from orders)"""
SIZES = f"(select archive, cast(sum(length) as bigint) as size from {ENTRIES} group by 1)"
#: Archives of fewer bytes than half of them are candidates, so that some are and some aren't at any size of the tables.
SMALL = f"(select cast(quantile_disc(size, 0.5) as bigint) from {SIZES})"

# Scans, filters, sinks


@query(f"select archive, ref, length, type from {ALL}")
def walk_objects(spark, sf_dir):
    """Every object of all archives, without payloads."""
    return objects.walk(Views(spark, sf_dir).all_objects(), load=False)


@query(f"select archive, ref, length, type from {ALL} where type = 3")
def walk_by_type(spark, sf_dir):
    return objects.walk(Views(spark, sf_dir).all_objects(), FILE, load=False)


@query("select sha1(cast(o_orderkey as varchar)) as ref, cast(epoch(o_orderdate) as bigint) as timestamp, o_orderpriority as set from orders union all select sha1(p_name), 0, '' from part")
def list_objects_csv(spark, sf_dir):
    from cairn.sources.files import list_objects_csv as listed

    v = Views(spark, sf_dir)
    commits = v.orders.select(F.sha1(F.col("o_orderkey").cast("string")).alias("ref"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("timestamp"), F.col("o_orderpriority").alias("set"))
    others = v.part.select(F.sha1("p_name").alias("ref"), F.lit(None).cast("long").alias("timestamp"), F.lit(None).cast("string").alias("set"))
    return listed(commits.unionByName(others))


@query("select l_orderkey, l_linenumber from lineitem where l_quantity = 10 or (l_partkey <> 7 and l_suppkey < 5 and l_linenumber <= 3 and l_shipdate > timestamp '1998-01-01' and l_returnflag >= 'N')")
def predicates_all(spark, sf_dir):
    c = F.col
    rare = (c("l_partkey") != 7) & (c("l_suppkey") < 5) & (c("l_linenumber") <= 3) & (c("l_shipdate") > F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00"))) & (c("l_returnflag") >= "N")
    return Views(spark, sf_dir).lineitem.where((c("l_quantity") == 10) | rare).select("l_orderkey", "l_linenumber")


@query("select l_orderkey, l_linenumber from lineitem where l_suppkey in (1, 5, 9) and l_linestatus not in ('X') and l_returnflag not in ('R', 'A')")
def predicates_in(spark, sf_dir):
    c = F.col
    return Views(spark, sf_dir).lineitem.where(c("l_suppkey").isin(1, 5, 9) & ~c("l_linestatus").isin("X") & ~c("l_returnflag").isin("R", "A")).select("l_orderkey", "l_linenumber")


INCLUDE, EXCLUDE = ["**/*1*"], ["**/*[02468]", "**/*.{png,gif}"]


def _globs(globs: list[str]) -> str:
    return " or ".join(f"regexp_matches(url, '{text.glob_regex(g)}')" for g in globs)


@query(f"select page_id, case when {_globs(INCLUDE)} then true when {_globs(EXCLUDE)} then false else true end as kept from pages")
def glob_include_exclude(spark, sf_dir):
    return Views(spark, sf_dir).pages.select("page_id", text.selected(F.col("url"), INCLUDE, EXCLUDE).alias("kept"))


@query("select p_partkey, string_split(p_type, ' ')[-1] as name, cast(p_size as bigint) as size, false as tree from part")
def project_nodes(spark, sf_dir):
    """Index rows as tree nodes: the last name of a path."""
    return Views(spark, sf_dir).part.select("p_partkey", text.basename(F.regexp_replace("p_type", " ", "/")).alias("name"), F.col("p_size").cast("long").alias("size"), F.lit(False).alias("tree"))


# Point-in-time questions

NOON = "2024-01-20 12:00:00"


def _at(moment: str):
    return F.to_timestamp_ntz(F.lit(moment))


@query(f"select ts, ref, size from {FILES} where set = 'click' and path = (select min(user_id) from events where event_type = 'click') and ts <= timestamp '{NOON}' order by ts desc, ref limit 10")
def file_info(spark, sf_dir):
    """The ten newest versions of a path as of a time."""
    v = Views(spark, sf_dir)
    path = v.events.where("event_type = 'click'").agg(F.min("user_id")).first()[0]
    return versions.file_info(v.files(), F.col("set") == "click", F.col("path") == path, _at(NOON), 10).select("ts", "ref", "size")


@query(f"select ts, ref from {COMMITS} where set = '1-URGENT' and ts <= timestamp '1999-06-30' order by ts desc, ref limit 10")
def commit_info(spark, sf_dir):
    rows = Views(spark, sf_dir).commits().where(F.col("set") == "1-URGENT")
    return versions.newest(versions.as_of(rows, "ts", _at("1999-06-30 00:00:00")), "ts", 10, "ref").select("ts", "ref")


@query(f"select set, path, ts, ref, version from (select *, row_number() over (partition by set, path order by ts desc, ref) as version from {FILES} where ts <= timestamp '{NOON}') where version <= 3")
def file_info_batch(spark, sf_dir):
    rows = versions.as_of(Views(spark, sf_dir).files(), "ts", _at(NOON))
    return versions.newest_each(rows, ["set", "path"], "ts", 3, "ref").select("set", "path", "ts", "ref", F.col("version").cast("long").alias("version"))


@query(f"select set, path, ts, ref from (select *, row_number() over (partition by set, path order by ts desc, ref desc) as k from {FILES}) where k = 1")
def latest_per_path(spark, sf_dir):
    return versions.latest_each(Views(spark, sf_dir).files(), ["set", "path"], "ts", "ref")


@query("select o_orderkey from orders where o_orderpriority = 'no such set'")
def unknown_set(spark, sf_dir):
    """A set that doesn't exist has no rows."""
    v = Views(spark, sf_dir)
    sets = v.orders.select(F.col("o_orderpriority").alias("name")).distinct().withColumn("id", F.col("name"))
    return versions.in_set(v.orders.withColumn("set_id", F.col("o_orderpriority")), sets, "no such set").select("o_orderkey")


@query(f"select o_orderkey, o_totalprice from orders where o_orderpriority = '2-HIGH' and o_orderdate <= timestamp '1996-01-01'")
def set_scope(spark, sf_dir):
    v = Views(spark, sf_dir)
    sets = v.orders.select(F.col("o_orderpriority").alias("name")).distinct().withColumn("id", F.col("name"))
    rows = versions.in_set(v.orders.withColumn("set_id", F.col("o_orderpriority")), sets, "2-HIGH")
    return versions.as_of(rows, "o_orderdate", _at("1996-01-01 00:00:00")).select("o_orderkey", "o_totalprice")


def _retained(rows: str, anchor: str) -> str:
    a = f"timestamp '{anchor}'"
    return f"""select set, ts, ref from (select *, rank() over (partition by set,
        case when ts >= {a} - interval 14 day then date_trunc('hour', ts) when ts >= {a} - interval 30 day then date_trunc('day', ts)
             when ts >= {a} - interval 90 day then date_trunc('week', ts) else date_trunc('month', ts) end order by ts) as r from {rows}) where r = 1"""


@query(_retained(COMMITS, "2001-08-01"))
def retention_commits(spark, sf_dir):
    """The earliest commits of each hour, day, week or month."""
    return versions.retained(Views(spark, sf_dir).commits(), "set", "ts", _at("2001-08-01 00:00:00")).select("set", "ts", "ref")


@query(_retained(FILES, "2024-01-31"))
def retention_events(spark, sf_dir):
    return versions.retained(Views(spark, sf_dir).files(), "set", "ts", _at("2024-01-31 00:00:00")).select("set", "ts", "ref")


@query(f"""with k as (select set, path, max(ts) as known from {FILES} where ts <= timestamp '{NOON}' group by all), c as (select set, path, max(ts) as ts from {FILES} group by all)
    select set, path, case when known is null then 'new' when date_trunc('second', known) = date_trunc('second', ts) then 'same' else 'changed' end as state from c left join k using (set, path)""")
def change_detection(spark, sf_dir):
    files = Views(spark, sf_dir).files()
    newest = lambda rows: rows.groupBy("set", "path").agg(F.max("ts").alias("ts"))
    return versions.reusable(newest(files), newest(versions.as_of(files, "ts", _at(NOON))), ["set", "path"], "ts").select("set", "path", "state")


# Objects and locations


@query(f"select distinct ref from {ENTRIES} where archive = 'src0' and ref in (select ref from {ENTRIES} where archive <> 'src0')")
def has_objects(spark, sf_dir):
    e = Views(spark, sf_dir).meta()
    return objects.has(e.where("archive = 'src0'").select("ref").distinct(), e.where("archive <> 'src0'"))


@query(f"select distinct ref from {ENTRIES} where archive = 'src0' and ref not in (select ref from {ENTRIES} where archive <> 'src0')")
def missing_objects(spark, sf_dir):
    e = Views(spark, sf_dir).meta()
    return objects.missing(e.where("archive = 'src0'").select("ref").distinct(), e.where("archive <> 'src0'"))


OFFSETS = f'(select archive, seq, ref, length, type, coalesce(cast(sum(length) over (partition by archive order by seq rows between unbounded preceding and 1 preceding) as bigint), 0) as "offset" from {ENTRIES})'


def _locate(excluded: str) -> str:
    return f'select ref, archive, "offset", length, type from (select *, row_number() over (partition by ref order by archive, "offset") as k from {OFFSETS} {excluded}) where k = 1'


@query(_locate(""))
def locate_object(spark, sf_dir):
    e = objects.offsets(Views(spark, sf_dir).meta()).select("ref", "archive", "offset", "length", "type")
    return objects.locate(e.select("ref"), e)


@query(_locate("where archive not in ('src0', 'src1')"))
def locate_excluding(spark, sf_dir):
    e = objects.offsets(Views(spark, sf_dir).meta()).select("ref", "archive", "offset", "length", "type")
    return objects.locate(e.select("ref"), e, ["src0", "src1"])


@query("select r.ref, coalesce(d.n, -1) as n from (select distinct sha1(text) as ref from documents where source in ('src1', 'src2') union select distinct sha1(text) from benchmark) r left join (select sha1(text) as ref, cast(min(strlen(text)) as bigint) as n from documents group by 1) d using (ref)")
def get_objects(spark, sf_dir):
    """Payloads by reference, verified on reading; a miss is null, here -1."""
    v = Views(spark, sf_dir)
    refs = v.meta().where(F.col("archive").isin("src1", "src2")).select("ref").union(v.benchmark.select(F.sha1("text"))).distinct()
    return objects.get(refs, v.entries()).select("ref", F.coalesce(F.octet_length("payload").cast("long"), F.lit(-1)).cast("long").alias("n"))


@query("select c_custkey, n_name from customer left join nation on n_nationkey = c_nationkey")
def eager_to_one(spark, sf_dir):
    v = Views(spark, sf_dir)
    return v.customer.join(v.nation, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("c_custkey", "n_name")


@query("select c_custkey, count(o_orderkey) as n, coalesce(string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey), '') as orders from customer left join orders on o_custkey = c_custkey group by 1")
def eager_to_many(spark, sf_dir):
    v = Views(spark, sf_dir)
    each = v.customer.join(v.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("o"))
    return each.select("c_custkey", F.size("o").cast("long").alias("n"), F.array_join(F.col("o").cast("array<string>"), ",").alias("orders"))


@query("select o_orderkey, o_orderdate from orders where o_custkey = 10")
def navigate_relation(spark, sf_dir):
    return Views(spark, sf_dir).orders.where("o_custkey = 10").select("o_orderkey", "o_orderdate")


@query(f"select count(*) as total, count(distinct ref) as unique_refs from {ENTRIES}")
def count_objects(spark, sf_dir):
    return objects.counts(Views(spark, sf_dir).meta())


@query(f"select type, count(*) as n from {ALL} group by 1")
def count_by_type(spark, sf_dir):
    return Views(spark, sf_dir).all_objects().groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("select count(*) as n from orders where o_orderstatus = 'F' and o_totalprice > 1000")
def query_count(spark, sf_dir):
    return Views(spark, sf_dir).orders.where("o_orderstatus = 'F' and o_totalprice > 1000").agg(F.count(F.lit(1)).alias("n"))


@query(f"select exists (select 1 from {ENTRIES} where archive = 'src3') as known, exists (select 1 from {ENTRIES} where archive = 'none') as unknown")
def object_exists(spark, sf_dir):
    """Whether an archive is indexed: at most one row is read of each."""
    e = Views(spark, sf_dir).meta()
    any_ = lambda name, alias: e.where(F.col("archive") == name).limit(1).agg((F.count(F.lit(1)) > 0).alias(alias))
    return any_("src3", "known").join(F.broadcast(any_("none", "unknown")))


BOUNDS = [256, 1024, 4096, 16384, 65536]


@query(f"select type, {' + '.join(f'(length >= {b})::int' for b in BOUNDS)} as bucket, count(*) as n, cast(sum(length) as bigint) as total from {ALL} group by all")
def size_distribution(spark, sf_dir):
    return objects.distribution(Views(spark, sf_dir).all_objects(), "type", "length", BOUNDS)


@query(f"select set, max_by(size, struct_pack(ts := ts, ref := ref)) as size from {FILES} group by 1")
def last_value(spark, sf_dir):
    return Views(spark, sf_dir).files().groupBy("set").agg(F.max_by("size", F.struct("ts", "ref")).alias("size"))


@query("select doc_id, case when n >= 1000 then case when n / 1000.0 < 10 then printf('%.1f', floor(n / 1000.0 * 10 + 0.5) / 10) else cast(cast(floor(n / 1000.0 + 0.5) as bigint) as varchar) end || ' kB' else n || ' B' end as shown from (select doc_id, cast(strlen(text) as bigint) as n from documents)")
def human_sizes(spark, sf_dir):
    return Views(spark, sf_dir).documents.select("doc_id", text.human_bytes(F.octet_length("text").cast("long")).alias("shown"))


# Archives


@query(f'select archive, seq, ref, length, "offset" from {OFFSETS}')
def archive_offsets(spark, sf_dir):
    return objects.offsets(Views(spark, sf_dir).meta()).select("archive", "seq", "ref", "length", "offset")


@query(f"select archive, seq, lag(ref) over (partition by archive order by seq) as predecessor from {ENTRIES}")
def predecessor_chain(spark, sf_dir):
    return objects.offsets(Views(spark, sf_dir).meta()).select("archive", "seq", "predecessor")


@query(f"select archive, seq, ref, row_number() over (partition by archive order by ref, seq) - 1 as rank from {ENTRIES}")
def archive_rank(spark, sf_dir):
    return objects.ranks(Views(spark, sf_dir).meta(), "seq").select("archive", "seq", "ref", F.col("rank").cast("long").alias("rank"))


@query(f"select archive, size from {SIZES}")
def archive_sizes(spark, sf_dir):
    return _sizes(Views(spark, sf_dir).meta())


def _small(entries: DataFrame) -> int:
    return _sizes(entries).agg(F.expr("percentile_disc(0.5) within group (order by size)")).first()[0]


def _sizes(entries: DataFrame) -> DataFrame:
    return entries.groupBy("archive").agg(F.sum("length").cast("long").alias("size"))


@query(f"""select archive, count(*) as n from (select archive, ref from {ENTRIES} where archive < 'src3'
    union all select distinct archive, ref from {ENTRIES} where archive >= 'src15' and archive not in (select archive from {ENTRIES} where archive < 'src3')) group by 1""")
def index_archive(spark, sf_dir):
    """Archives that are known stay; the others' locations are added once for each reference."""
    e = Views(spark, sf_dir).meta().select("archive", "ref")
    old = e.where("archive < 'src3'")
    _, out = objects.index_archive(old.select("archive").distinct(), old, e.where("archive >= 'src15'"))
    return out.groupBy("archive").agg(F.count(F.lit(1)).alias("n"))


@query(f"select archive, count(*) as n from {ENTRIES} where archive not in ('src2', 'src5') group by 1")
def delete_archive(spark, sf_dir):
    e = Views(spark, sf_dir).meta()
    _, out = objects.delete_archive(e.select("archive").distinct(), e, ["src2", "src5"])
    return out.groupBy("archive").agg(F.count(F.lit(1)).alias("n"))


@query(f"select distinct sha1(unhex(ref)) as ref, ref as tombstone_for, 5 as type from {ENTRIES} where archive = 'src4'")
def tombstones(spark, sf_dir):
    return objects.tombstones(Views(spark, sf_dir).meta().where("archive = 'src4'").select("ref").distinct())


@query(f"select archive, count(*) as n from {ENTRIES} where ref not in (select ref from {ENTRIES} where archive = 'src4') group by 1")
def tombstones_applied(spark, sf_dir):
    e = Views(spark, sf_dir).meta()
    return objects.without_deleted(e, objects.tombstones(e.where("archive = 'src4'").select("ref").distinct())).groupBy("archive").agg(F.count(F.lit(1)).alias("n"))


CHOSEN = f"(select archive, size from {SIZES} where size < {SMALL})"
SURVIVORS = f"""(select archive, seq, ref, length, type from (select *, row_number() over (partition by ref order by archive, seq) as k from {ENTRIES} where archive in (select archive from {CHOSEN}))
    where k = 1 and ref not in (select ref from {ENTRIES} where archive not in (select archive from {CHOSEN})))"""


@query(f"select archive, size from {CHOSEN}")
def compaction_candidates(spark, sf_dir):
    e = Views(spark, sf_dir).meta()
    return objects.candidates(_sizes(e), _small(e))


@query(f"select count(*) as n, coalesce(cast(sum(size) as bigint), 0) as size, count(*) > 100 or coalesce(sum(size), 0) >= {SMALL} as run from {CHOSEN}")
def compaction_trigger(spark, sf_dir):
    e = Views(spark, sf_dir).meta()
    small = _small(e)
    return objects.triggered(objects.candidates(_sizes(e), small), small, 100)


def _survivors(v: Views) -> DataFrame:
    e = v.meta()
    return objects.survivors(e, objects.candidates(_sizes(e), _small(e)))


@query(f"select archive, seq, ref, length, type from {SURVIVORS}")
def compaction_survivors(spark, sf_dir):
    return _survivors(Views(spark, sf_dir)).select("archive", "seq", "ref", "length", "type")


@query(f"""with a as (select count(*) as n, coalesce(cast(sum(length) as bigint), 0) as b from {ENTRIES} where archive in (select archive from {CHOSEN})), s as (select count(*) as n, coalesce(cast(sum(length) as bigint), 0) as b from {SURVIVORS})
    select a.n as objects, a.b as bytes, a.n - s.n as dropped_objects, a.b - s.b as dropped_bytes from a, s""")
def compaction_stats(spark, sf_dir):
    v = Views(spark, sf_dir)
    e = v.meta()
    total = lambda df, a, b: df.agg(F.count(F.lit(1)).alias(a), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias(b))
    inside = total(e.join(objects.candidates(_sizes(e), _small(e)).select("archive"), "archive", "left_semi"), "objects", "bytes")
    return inside.join(F.broadcast(total(_survivors(v), "n", "b"))).select("objects", "bytes", (F.col("objects") - F.col("n")).alias("dropped_objects"), (F.col("bytes") - F.col("b")).alias("dropped_bytes"))


VOLUME = 50_000


@query(f"""with recursive s as (select ref, length, ascii(ref) % 4 as writer, row_number() over (partition by ascii(ref) % 4 order by archive, seq) as i from {SURVIVORS}),
    f as (select writer, ref, length, i, 0 as volume, length as filled from s where i = 1
        union all select s.writer, s.ref, s.length, s.i, case when f.filled >= {VOLUME} then f.volume + 1 else f.volume end, case when f.filled >= {VOLUME} then s.length else f.filled + s.length end from f join s on s.writer = f.writer and s.i = f.i + 1)
    select writer, ref, length, cast(volume as bigint) as volume from f""")
def compaction_repack(spark, sf_dir):
    """Four writers, each rolling to a new archive once the present one is full."""
    kept = _survivors(Views(spark, sf_dir)).withColumn("writer", F.ascii("ref") % 4)
    return objects.repack(kept, VOLUME).select("writer", "ref", "length", "volume")


# State


@query(f"select path, min(ref) as ref from {FILES} where set = 'click' group by 1 union all select path, min(ref) from {FILES} where set <> 'click' and path not in (select path from {FILES} where set = 'click') group by 1")
def insert_if_absent(spark, sf_dir):
    f = Views(spark, sf_dir).files().select("set", "path", "ref")
    old = f.where("set = 'click'").groupBy("path").agg(F.min("ref").alias("ref"))
    return state.insert_if_absent(old, f.where("set <> 'click'").select("path", "ref"), ["path"], "ref")


@query(f"select path, max(ref) as ref from {FILES} where set <> 'click' group by 1 union all select path, min(ref) from {FILES} where set = 'click' and path not in (select path from {FILES} where set <> 'click') group by 1")
def upsert_latest(spark, sf_dir):
    f = Views(spark, sf_dir).files().select("set", "path", "ref")
    old = f.where("set = 'click'").groupBy("path").agg(F.min("ref").alias("ref"))
    return state.upsert(old, f.where("set <> 'click'").select("path", "ref"), ["path"], "ref")


@query("select c_custkey, case when c_acctbal < 0 then 'closed' else c_mktsegment end as c_mktsegment from customer where c_nationkey <> 3")
def update_and_delete(spark, sf_dir):
    c = Views(spark, sf_dir).customer
    return state.delete(state.update(c, F.col("c_acctbal") < 0, c_mktsegment=F.lit("closed")), F.col("c_nationkey") == 3).select("c_custkey", "c_mktsegment")


@query("select o_orderkey, o_orderstatus from orders where o_orderkey in (select distinct l_orderkey from lineitem where l_quantity > 49)")
def reload_rows(spark, sf_dir):
    v = Views(spark, sf_dir)
    return state.reload(v.lineitem.where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")), v.orders, ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


@query("select r_regionkey + 1 as id, r_name as name from region union all select (select max(r_regionkey) + 1 from region) + row_number() over (order by n_name), n_name from nation where n_name not in (select r_name from region)")
def get_or_create_set(spark, sf_dir):
    v = Views(spark, sf_dir)
    sets = v.region.select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.col("r_name").alias("name"))
    return state.get_or_create(sets, v.nation.select(F.col("n_name").alias("name")))


# Trees and collection

WALK = f"""with recursive w as (select name as path, is_tree, child_ref as ref, 1 as depth from {EDGES} where tree_ref = 'root'
    union all select w.path || '/' || e.name, e.is_tree, e.child_ref, w.depth + 1 from w join {EDGES} e on e.tree_ref = w.ref where w.is_tree)"""


@query(f"{WALK} select path, is_tree, ref, depth from w")
def tree_walk(spark, sf_dir):
    v = Views(spark, sf_dir)
    return trees.traverse(v.edges(), v.roots()).select("path", "is_tree", "ref", "depth")


@query("select 'n' || n_nationkey as ref from nation join region on r_regionkey = n_regionkey where r_name = (select min(r_name) from region) and n_name = (select min(n_name) from nation join region on r_regionkey = n_regionkey where r_name = (select min(r_name) from region))")
def tree_path_lookup(spark, sf_dir):
    v = Views(spark, sf_dir)
    region, nation = v.region.join(v.nation, F.col("n_regionkey") == F.col("r_regionkey")).orderBy("r_name", "n_name").select("r_name", "n_name").first()
    return trees.lookup(v.edges(), v.roots(), f"{region}/{nation}").select("ref")


@query(f"select tree_ref, name, is_tree from {EDGES} order by tree_ref, is_tree desc, name")
def tree_listing(spark, sf_dir):
    return trees.listing(Views(spark, sf_dir).edges()).select("tree_ref", "name", "is_tree")


#: The region whose sub-tree the index has already, and what it had indexed there.
HAD = "(select min(r_name) as r_name, min_by(r_regionkey, r_name) as r_regionkey from region)"


@query(f"""with recursive w as (select name as path, is_tree, child_ref as ref from {DEEP} where tree_ref = 'root'
    union all select w.path || '/' || e.name, e.is_tree, e.child_ref from w join {DEEP} e on e.tree_ref = w.ref where w.is_tree)
    select path, o_orderdate as timestamp, w.ref, cast(1 as bigint) as set_id from w join orders on w.ref = 'o' || o_orderkey where not w.is_tree and not starts_with(path, (select r_name || '/' from {HAD}))
    union all select r_name || '/kept', timestamp '{NOON}', 'kept', 1 from {HAD}""")
def index_commit(spark, sf_dir):
    """The files of an index that has one of a commit's sub-trees, once the commit is indexed: that sub-tree isn't entered and keeps what it had; a commit that lacks a sub-tree adds nothing."""
    v = Views(spark, sf_dir)
    empty = lambda kind: spark.createDataFrame([], kind)
    had = v.region.agg(F.min(F.struct("r_name", "r_regionkey")).alias("r")).select("r.*")
    commits = spark.createDataFrame([("commit1", "root", "all"), ("commit2", "gone", "all")], "ref string, tree string, set string").withColumn("timestamp", _at(NOON))
    index = {
        "sets": spark.createDataFrame([(1, "all")], "id long, name string"), "commits": empty("ref string, timestamp timestamp_ntz, tree string, set_id long"),
        "trees": had.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("ref"), F.col("r_name").alias("path"), F.lit(1).cast("long").alias("set_id")),
        "files": had.select(F.concat("r_name", F.lit("/kept")).alias("path"), _at(NOON).alias("timestamp"), F.lit(1).cast("long").alias("set_id"), F.lit("kept").alias("ref"), *[F.lit(None).cast(k).alias(c) for c, k in (("mode", "long"), ("user", "string"), ("group", "string"), ("size", "long"))]),
    }
    named = v.edges(orders=True).join(v.orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("child_ref"), F.col("o_orderdate").alias("ts")), "child_ref", "left")
    entries = v.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("tree_ref"))
    once = index_commits(index, commits, named.unionByName(entries, allowMissingColumns=True))
    return once["files"].select("path", "timestamp", "ref", "set_id")


GRAPH = "(select 'o' || l_orderkey as src, 'p' || l_partkey as dst from lineitem union select 'p' || p_partkey, 'b' || p_brand from part)"
MARK = f"""with recursive e as (select * from {GRAPH}), m as (select 'o' || o_orderkey as ref from orders where o_orderpriority = '1-URGENT' and o_orderdate >= timestamp '2001-07-01'
    union select e.dst from m join e on e.src = m.ref)"""


def _marked(v: Views) -> DataFrame:
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    edges = v.lineitem.select(name("o", "l_orderkey").alias("src"), name("p", "l_partkey").alias("dst")).union(v.part.select(name("p", "p_partkey"), name("b", "p_brand"))).distinct()
    roots = v.orders.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderdate") >= _at("2001-07-01 00:00:00"))).select(name("o", "o_orderkey").alias("ref"))
    return trees.reachable(roots, edges)


@query(f"{MARK} select ref from m")
def gc_mark(spark, sf_dir):
    return _marked(Views(spark, sf_dir))


@query(f"{MARK} select 'p' || p_partkey as ref from part where 'p' || p_partkey not in (select ref from m)")
def gc_sweep(spark, sf_dir):
    v = Views(spark, sf_dir)
    return trees.unreachable(v.part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("ref")), _marked(v))


# Content

SLICE = 1000
PARTS = f"(select doc_id, k as part_no, k * {SLICE} as \"offset\", least({SLICE}, length(text) - k * {SLICE}) as length, substring(text, k * {SLICE} + 1, {SLICE}) as data from (select doc_id, text, unnest(range(0, cast(ceil(length(text) / {SLICE}.0) as bigint))) as k from documents))"


def _parts(v: Views) -> DataFrame:
    return chunks.fixed_parts(v.documents, "doc_id", "text", SLICE)


@query(f'select doc_id, part_no, "offset", length, sha1(data) as ref from {PARTS}')
def file_parts_fixed(spark, sf_dir):
    return _parts(Views(spark, sf_dir)).select("doc_id", "part_no", "offset", "length", F.sha1("data").alias("ref"))


@query("select l_orderkey, l_linenumber, cast(coalesce(sum(cast(l_quantity as bigint)) over (partition by l_orderkey order by l_linenumber rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\", (l_linenumber - 1) // 3 as split_no from (select distinct on (l_orderkey, l_linenumber) l_orderkey, l_linenumber, l_quantity from lineitem order by l_orderkey, l_linenumber, l_quantity)")
def file_splits(spark, sf_dir):
    """Lines as parts of orders: their offsets, and which file object holds them at three parts each."""
    lines = state.first_of(Views(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey", "l_linenumber"], "l_quantity")
    parts = lines.select("l_orderkey", "l_linenumber", (F.col("l_linenumber") - 1).alias("part_no"), F.col("l_quantity").cast("long").alias("length"))
    return chunks.splits(chunks.part_offsets(parts, "l_orderkey"), 3).select("l_orderkey", "l_linenumber", "offset", F.col("split_no").cast("int").alias("split_no"))


@query("select doc_id, sha1(text) as ref, cast(strlen(text) as bigint) as n from documents where length(text) > 0")
def file_reassemble(spark, sf_dir):
    """Cutting and putting together again gives every text."""
    parts = _parts(Views(spark, sf_dir)).withColumn("ref", F.sha1("data"))
    return chunks.assemble(parts.drop("data"), parts.select("ref", "data"), "doc_id").select("doc_id", F.sha1("content").alias("ref"), F.octet_length("content").cast("long").alias("n"))


@query(f"select doc_id, sha1(string_agg(case when sha1(data)[1] = '0' then repeat('0', length) else data end, '' order by part_no)) as ref from {PARTS} group by 1")
def missing_part_zero_fill(spark, sf_dir):
    """A missing blob reads as zeros (here the digit, which SQL can write) of the part's length."""
    parts = _parts(Views(spark, sf_dir)).withColumn("ref", F.sha1("data"))
    return chunks.assemble(parts.drop("data"), parts.where("ref not like '0%'").select("ref", "data"), "doc_id", "0").select("doc_id", F.sha1("content").alias("ref"))


@query("select doc_id, substring(text, 951, 120) as data from documents where length(text) > 950")
def read_range(spark, sf_dir):
    """120 characters from character 950 on, over the border of two parts."""
    v = Views(spark, sf_dir)
    wanted = v.documents.select("doc_id", F.lit(950).cast("long").alias("start"), F.lit(120).cast("long").alias("n"))
    return chunks.read_range(_parts(v), wanted, "doc_id").select("doc_id", "data")


@query("select doc_id, length(text) as size, case when length(text) - 1 - 99 >= 0 then length(text) - 1 - 99 else -1 end as from_end, case when 500 <= length(text) then 500 else -1 end as from_start from documents where length(text) > 0")
def seek(spark, sf_dir):
    sizes = chunks.file_sizes(_parts(Views(spark, sf_dir)), "doc_id")
    at = lambda n, whence: F.coalesce(chunks.seek(F.col("size"), F.lit(n).cast("long"), whence), F.lit(-1)).cast("long")
    return sizes.select("doc_id", "size", at(99, "end").alias("from_end"), at(500, "start").alias("from_start"))


@query(f"select count(*) as parts, count(distinct ref) as unique_parts, cast(sum(n) as bigint) as bytes, (select cast(sum(n) as bigint) from (select distinct sha1(data) as ref, strlen(data) as n from {PARTS})) as unique_bytes from (select sha1(data) as ref, strlen(data) as n from {PARTS})")
def dedup_chunks(spark, sf_dir):
    """What storing each chunk once saves."""
    parts = _parts(Views(spark, sf_dir)).select(F.sha1("data").alias("ref"), F.octet_length("data").cast("long").alias("n"))
    each = parts.groupBy("ref").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"))
    return each.agg(F.sum("k").cast("long").alias("parts"), F.count(F.lit(1)).alias("unique_parts"), F.sum(F.col("k") * F.col("n")).cast("long").alias("bytes"), F.sum("n").cast("long").alias("unique_bytes"))


@query()
def content_defined_chunks(spark, sf_dir):
    """Boundaries that follow content; tested against a loop over bytes."""
    return chunks.content_parts(Views(spark, sf_dir).documents, "doc_id", "text").drop("data")


def _varint_sql(n: str) -> str:
    """The varint of a count below 2**35, as hex digits."""
    byte = lambda k, more: f"printf('%02X', (({n}) >> {7 * k}) % 128 + {128 if more else 0})"
    whole = [" || ".join([*(byte(j, True) for j in range(k)), byte(k, False)]) for k in range(5)]
    return f"case {' '.join(f'when {n} < {1 << 7 * (k + 1)} then {x}' for k, x in enumerate(whole[:4]))} else {whole[4]} end"


@query(f"select doc_id, sha1(unhex('22') || unhex({_varint_sql('octet_length(inner_)')}) || inner_) as ref from (select doc_id, case when n = 0 then unhex('') else unhex('0A') || unhex({_varint_sql('n')}) || encode(text) end as inner_ from (select doc_id, text, strlen(text) as n from documents))")
def blob_refs(spark, sf_dir):
    """References of all texts as stored blobs: empty ones, and of any length."""
    docs = Views(spark, sf_dir).documents
    return docs.select("doc_id", F.lower(F.hex(wire.blob_ref(F.col("text").cast("binary")))).alias("ref"))


@query("select event_type as key, min(event_id) as event_id from events group by 1")
def stream_incremental_index(spark, sf_dir):
    """A stream of events, inserted if absent a micro-batch at a time, ends as the batch form does."""
    import uuid

    from cairn.plans.durable import shared_root
    from cairn.streaming.incremental import indexed_stream

    root = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    source.select(F.col("event_type").alias("key"), "event_id").repartition(2).sortWithinPartitions("event_id").write.parquet(f"{root}/in")
    arrivals = spark.readStream.schema("key string, event_id long").option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    seen: list[str] = []

    def write(rows: DataFrame, number: int) -> None:
        path = f"{root}/state-{number}"
        rows.write.mode("overwrite").parquet(path)
        seen.append(path)

    indexed_stream(arrivals, ["key"], lambda: spark.read.parquet(seen[-1]) if seen else None, write, f"{root}/checkpoint", "event_id").awaitTermination()
    return spark.read.parquet(seen[-1]) if seen else spark.createDataFrame([], "key string, event_id long")


@query("select event_type, count(*) as n, time_bucket(interval '1 day', ts) as day from events group by all")
def metrics_by_window(spark, sf_dir):
    """Counts of each kind by day."""
    e = Views(spark, sf_dir).events
    return e.groupBy("event_type", F.col("ts").cast("date").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n"))

