"""Benchmark decontamination with a positional inverted index (DataFrame and SQL functions only).

Corpus words become postings (term, document, position).  Only terms that the
benchmark uses are counted, over all documents, and only the rarest terms of
each benchmark window are posted: a list of positions less the term's offset in
its item is the list of places where the item would start, so intersecting the
offset-adjusted lists of a window's rarest terms leaves the places where the
window can occur.  Those few are verified word by word against the text, which
gives exact phrases; lists that meet within a slop, or exactly but around other
words, give proximity matches.

Postings are dealt by document, so a term that a third of all rows hold is
never gathered in one place.

Defined results: null or empty text has no words; items without words have no
windows; rows that agree in ``doc_id`` and text get the same result once each;
a null ``doc_id`` is a document like any other; a null ``item_id`` is no item;
empty tables give no rows or no hits; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.store import fresh, maybe_broadcast, pick, spread_join, stored, table

# What separates words, and the letters that are lowered.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A term that no text holds: its posting's position is the number of words.
END = "\x00"


def words(text: str) -> Column:
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, BETWEEN), "")


def numbered(items: DataFrame) -> DataFrame:
    """item, item_id, w: each different row of the benchmark that has words, numbered, so that rows that repeat an id stay apart."""
    rows = pick(items, item_id="string", text="string").where("item_id is not null").select("item_id", words("text").alias("w")).where("size(w) > 0").distinct()
    return stored(rows.select(F.monotonically_increasing_id().alias("item"), "item_id", "w"), "decontam-items")


def windows(items: DataFrame, width: int) -> DataFrame:
    """item, at, win: each run of width words of an item, or all of a shorter one."""
    return items.select("item", "w", F.explode(F.expr(f"sequence(0, greatest(size(w) - {width}, 0))")).alias("at")).select("item", "at", F.expr(f"slice(w, at + 1, {width})").alias("win"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, h (of the text) and text."""
    return pick(docs, doc_id="long", text="string").select("doc_id", F.xxhash64("text").alias("h"), "text")


DOC = ["doc_id", "h"]


def same(left: str, right: str):
    """Whether rows of the aliases are of one document; a null id is like any other."""
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.h") == F.col(f"{right}.h"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: occurrences of the terms in all documents. Terms above the broadcast bound are joined with sums, which no term makes hot."""
    every, few = docs.select(F.explode(words("text")).alias("term")), maybe_broadcast(terms)
    if few is not terms:
        return every.join(few, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return every.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(terms, "term")


def anchors(docs: DataFrame, wins: DataFrame, rarest: int, near: bool = False) -> DataFrame:
    """item, at, win, terms, need: each window's rarest terms by their count over all documents, and their places in the item.

    Windows with a term that never occurs are gone; if near, they have the rarest of the terms that occur, and are gone if those are too few.
    """
    terms = stored(wins.select(F.explode("win").alias("term")).distinct(), "decontam-terms")
    each, counts = wins.select("item", "at", "win", F.posexplode("win").alias("o", "term")), stored(term_counts(docs, terms), "decontam-counts")
    few = maybe_broadcast(counts)
    # beyond the broadcast bound a term of very many windows is dealt to all tasks
    each = each.join(few, "term", "left") if few is not counts else spread_join(stored(each, "decontam-each"), counts, "term", "left")
    some = f"by[0].n > 0 or size(filter(by, x -> x.n > 0)) >= {max(rarest, 2)}" if near else "by[0].n > 0"
    by = each.groupBy("item", "at").agg(F.first("win").alias("win"), F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "o", "term"))).alias("by"))
    by = by.where(some).withColumn("by", F.expr(f"slice(filter(by, x -> x.n > 0), 1, {rarest})"))
    return by.select("item", "at", "win", F.expr("transform(by, x -> x.term)").alias("terms"), F.expr("transform(by, x -> at + x.o)").alias("need"))


def posted_terms(plan: DataFrame) -> DataFrame:
    """term, places: where anchors stand in items, and whether one is all that some window needs; END has none."""
    zipped = F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("need").alias("place")))
    each = plan.select("item", zipped.alias("p"), (F.size("need") == 1).alias("alone")).groupBy("p.term", "item", "p.place").agg(F.max("alone").alias("alone"))
    posted = each.groupBy("term").agg(F.collect_list(F.struct("item", "place", "alone")).alias("places"))
    end = plan.sparkSession.range(1).select(F.lit(END).alias("term"), F.expr("cast(array() as array<struct<item:bigint,place:int,alone:boolean>>)").alias("places"))
    return stored(posted.unionByName(end), "decontam-posted")


def meetings(postings: DataFrame, slop: int) -> DataFrame:
    """doc_id, h, item, start, places: the places of an item that stand at their distances from one start.

    Only starts that can matter: of several places, of one that a window needs alone, or with another start within slop.
    Documents and items are dealt once, for the sums as for the neighbours.
    """
    starts = postings.where("places is not null").select(*DOC, "pos", F.explode("places").alias("p")).select(*DOC, "p.item", (F.col("pos") - F.col("p.place")).alias("start"), "p.place", "p.alone")
    met = starts.repartition(*DOC, "item").groupBy(*DOC, "item", "start").agg(F.collect_set("place").alias("places"), F.max("alone").alias("alone"))
    matters = (F.size("places") > 1) | F.col("alone")
    if slop:
        order = Window.partitionBy(*DOC, "item").orderBy("start")
        met = met.withColumn("before", F.col("start") - F.lag("start").over(order)).withColumn("after", F.lead("start").over(order) - F.col("start"))
        matters = matters | (F.coalesce("before", F.lit(slop + 1)) <= slop) | (F.coalesce("after", F.lit(slop + 1)) <= slop)
    return stored(met.where(matters).select(*DOC, "item", "start", "places", "alone"), "decontam-met")


def asked(met: DataFrame, by_place: DataFrame) -> DataFrame:
    """doc_id, h, item, start, place, at, n: each place of a start with the windows that need it, and how many places those need."""
    each = met.select(*DOC, "item", "start", F.explode("places").alias("place"))
    return each.join(maybe_broadcast(by_place), ["item", "place"]).select(*DOC, "item", "start", "place", F.explode("wins").alias("w")).select(*DOC, "item", "start", "place", "w.at", "w.n")


def occurrences(docs: DataFrame, items: DataFrame, width: int = 10, rarest: int = 2, slop: int = 4) -> tuple[DataFrame, DataFrame]:
    """(exact, counted).

    exact: doc_id, h, found: for each document with candidates, its verified windows as (start, n, item, item_id).
    counted: doc_id, h, n_words, n_near for each row of docs; n_near: items that the document doesn't hold exactly and
    of which some window's rarest terms stand within slop words of their distances in the item.
    """
    docs, items = keyed(docs), numbered(items)
    plan = stored(anchors(docs, windows(items, width), rarest, slop > 0), "decontam-anchors")
    tokens = docs.select(*DOC, F.posexplode(F.concat(words("text"), F.array(F.lit(END)))).alias("pos", "term"))
    postings = stored(tokens.join(maybe_broadcast(posted_terms(plan)), "term").select(*DOC, "pos", F.when(F.size("places") > 0, F.col("places")).alias("places")), "decontam-postings")
    ends = postings.where("places is null").select(*DOC, F.col("pos").cast("long").alias("n_words"))
    met = meetings(postings, slop)
    # at most width windows for each place that they need
    by_place = stored(plan.select("item", "at", F.size("need").alias("n"), F.explode("need").alias("place")).groupBy("item", "place").agg(F.collect_list(F.struct("at", "n")).alias("wins")), "decontam-places")
    full = asked(met.where((F.size("places") > 1) | F.col("alone")), by_place).groupBy(*DOC, "item", "start", "at").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n")).where("k = n")
    wins = stored(plan.select("item", "at", "win").join(items.select("item", "item_id"), "item"), "decontam-windows")
    candidates = full.join(maybe_broadcast(wins), ["item", "at"]).groupBy(*DOC).agg(F.collect_list(F.struct((F.col("start") + F.col("at")).alias("start"), "win", "item", "item_id")).alias("c"))
    candidates = stored(candidates, "decontam-candidates")
    side = candidates.withColumnsRenamed({"doc_id": "d", "h": "k"})
    is_d = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k"))
    # ids first, which are few bytes and may be broadcast, so that only candidates' texts are dealt; a generated column isn't computed anew for each candidate
    texts = docs.join(maybe_broadcast(side.select("d", "k")), is_d, "left_semi").join(side, is_d).select(*DOC, "c", F.explode(F.array(words("text"))).alias("w"))
    true = F.expr("transform(filter(c, x -> x.start >= 0 and slice(w, x.start + 1, size(x.win)) = x.win), x -> struct(x.start as start, size(x.win) as n, x.item as item, x.item_id as item_id))")
    exact = stored(texts.select(*DOC, true.alias("found")).where("size(found) > 0").groupBy(*DOC).agg(F.first("found").alias("found")), "decontam-exact")
    if not slop:
        return exact, ends
    near = proximity(met, by_place, items, exact, slop)
    return exact, ends.alias("a").join(near.alias("b"), same("a", "b"), "left").select("a.*", F.coalesce("b.n_near", F.lit(0)).alias("n_near"))


def proximity(met: DataFrame, by_place: DataFrame, items: DataFrame, exact: DataFrame, slop: int) -> DataFrame:
    """doc_id, h, n_near: items without an exact window of which some window's rarest terms have starts within slop of each other.

    Each start of a window's place is taken with those that follow within slop, which are at most (slop + 1) for each
    place; the window is near if together they have all places that it needs, at as many different words.
    """
    held = exact.select(*DOC, F.explode(F.expr("array_distinct(transform(found, x -> x.item))")).alias("item"))
    is_held = same("a", "b") & (F.col("a.item") == F.col("b.item"))
    rest = asked(met.alias("a").join(held.alias("b"), is_held, "left_anti"), by_place)
    within = Window.partitionBy(*DOC, "item", "at").orderBy("start").rangeBetween(0, slop)
    together = rest.withColumn("c", F.collect_list(F.struct("place", (F.col("start") + F.col("place")).alias("pos"))).over(within))
    near = together.where("size(array_distinct(c.place)) = n and size(array_distinct(c.pos)) >= n").select(*DOC, "item").distinct()
    named = near.join(maybe_broadcast(items.select("item", "item_id")), "item").select(*DOC, "item_id").distinct()
    ids = exact.select(*DOC, F.expr("transform(found, x -> x.item_id)").alias("held"))
    others = named.alias("a").join(ids.alias("b"), same("a", "b"), "left").where("held is null or not array_contains(held, item_id)")
    return others.groupBy("a.doc_id", "a.h").agg(F.count(F.lit(1)).alias("n_near"))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, rarest: int = 2, slop: int = 4) -> DataFrame:
    """doc_id, h, n_words, n_hit, n_items, items (sorted), n_near for each row of docs."""
    exact, counted = occurrences(docs, items, width, rarest, slop)
    hit = exact.select(*DOC, F.expr("size(array_distinct(flatten(transform(found, x -> sequence(x.start, x.start + x.n - 1)))))").cast("long").alias("n_hit"), F.expr("array_sort(array_distinct(transform(found, x -> x.item_id)))").alias("items"))
    joined = counted.alias("a").join(hit.alias("b"), same("a", "b"), "left")
    none = F.expr("cast(array() as array<string>)")
    return joined.select("a.doc_id", "a.h", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"), *(["n_near"] if slop else []))


def clean(docs: DataFrame, items: DataFrame, width: int = 10, rarest: int = 2) -> DataFrame:
    """docs without the rows that hold a window of an item, with their columns."""
    exact, _ = occurrences(docs, items, width, rarest, slop=0)
    d, k = fresh(docs, "d", "k")
    bad = stored(exact.select(F.col("doc_id").alias(d), F.col("h").alias(k)), "decontam-found")
    return docs.join(maybe_broadcast(bad), docs["doc_id"].cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(k)), "left_anti")


def op6_decontam(spark, sf_dir: str) -> DataFrame:
    """Which benchmark items every document holds, and how many more it holds nearly."""
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near")


ORACLE = r"""
with d as (select doc_id, row_number() over () as rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
win as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[p + 1:p + 10], ' ') as s from (select item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) as p from b where len(w) > 0)),
sizes as (select distinct n from win),
places as (select rid, n, p, array_to_string(w[p + 1:p + n], ' ') as s from (select rid, w, n, unnest(range(0, len(w) - n + 1)) as p from d, sizes where len(w) >= n)),
found as (select rid, places.n, p, item_id from places join win on places.n = win.n and places.s = win.s),
hits as (select rid, count(distinct q) as n_hit from (select rid, unnest(range(p, p + n)) as q from found) group by rid),
every as (select distinct item_id, w from b where len(w) > 0),
terms as (select item_id, w, p, o, w[p + o] as term from (select item_id, w, p, unnest(range(1, least(len(w), 10) + 1)) as o from (select item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) as p from every))),
tokens as (select rid, w[k] as term, k from (select rid, w, unnest(range(1, len(w) + 1)) as k from d)),
counts as (select term, count(*) as c from tokens where term in (select term from terms) group by term),
ranks as (select item_id, w, p, o, term, c, row_number() over (partition by item_id, w, p order by c, o) as r, count(*) over (partition by item_id, w, p) as m,
    least(len(w), 10) as size from terms join counts using (term)),
needs as (select item_id, w, p, o, term, least(m, 2) as n from ranks where r <= 2 and (m = size or m >= 2)),
met as (select rid, item_id, w, p, o, n, k, k - o as s from needs join tokens using (term)),
near as (select rid, count(*) as n_near from (
    select distinct rid, item_id from (
        select rid, item_id from met where n = 1
        union all
        select x.rid, x.item_id from met x join met y on x.rid = y.rid and x.item_id = y.item_id and x.w = y.w and x.p = y.p and x.o <> y.o and x.k <> y.k and y.s between x.s - 4 and x.s + 4)
    where (rid, item_id) not in (select (rid, item_id) from found)) group by rid),
items as (select rid, count(*) as n_items, string_agg(item_id, ',' order by item_id) as i from (select distinct rid, item_id from found) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(i, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0) as n_near
from d left join hits using (rid) left join items using (rid) left join near using (rid)"""
