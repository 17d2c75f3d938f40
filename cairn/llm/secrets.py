"""Secret scan: patterns, and sliding-window entropy over candidate strings (DataFrame and SQL functions only).

Base kinds are matched leftmost and without overlap, each by its own pattern.
Further candidates are long runs of the characters that keys are written in.  A
candidate's class follows from its characters; a window of fixed width slides
over it, and the window's Shannon entropy is kept by incremental counts: the
character that enters and the one that leaves change two counts and the sum of
n*log2(n), held as integers so that the result does not depend on the order of
additions.  A candidate is a secret if some window reaches the bits asked for
its class, no base span overlaps it and no allow-list pattern suppresses it.

Everything is computed within a row, so nothing is shuffled.

Defined results: null text is empty text, which has no spans; a null ``doc_id``
is a document like any other; repeated rows give repeated results; an empty
table gives no rows; further columns are ignored (``redact`` keeps them).
Positions are code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.store import pick, table

# The base patterns and their order.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
EITHER = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in KEYWORDS)
ASSIGN = rf"""({EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"  # a failing run holds no passing match, so the length may stand in the pattern
HEX = "[0-9a-f]{16,}"
BASE = ("assign", "access", "hex")
ASSIGN_LEAST = 12

#: Window of the entropy scan, in characters.
WINDOW = 20
#: What a candidate is written in.
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: kind: (all of its characters, what it must hold, bits of entropy in some window). The first that fits counts.
CLASSES = {
    "entropy_hex": ("^[0-9A-Fa-f]+$", "[0-9].*[A-Fa-f]|[A-Fa-f].*[0-9]", 2.8),
    "entropy_alnum": ("^[0-9A-Za-z]+$", "[0-9].*[A-Za-z]|[A-Za-z].*[0-9]", 3.4),
    "entropy_base64": ("^[A-Za-z0-9+/_=-]+$", "(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])", 3.6),
}
#: A candidate is let be if one of these is found in it, in lower case.
ALLOW = (
    "example|sample|dummy|placeholder|changeme|your[-_]?",
    "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "abcdefgh|12345678|qwerty",
    r"(.)\1{7}",
)
MARK = "[SECRET]"
BLOCK = 256
UNIT = 1 << 20


def weight(n: int) -> int:
    """n*log2(n) in units that are added exactly."""
    return round(n * math.log2(n) * UNIT) if n else 0


def limit(bits: float) -> int:
    """A window has these bits of entropy if its sum of weights is at most this."""
    return int(WINDOW * (math.log2(WINDOW) - bits) * UNIT)


def quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def with_starts(df: DataFrame, steps: str, to: str) -> DataFrame:
    """Adds the sums before each element: over whole blocks, then within the element's block, so that long arrays take about linear time."""
    b = BLOCK
    df = df.withColumn("blocks", F.expr(f"transform(sequence(0, size({steps}) div {b}), k -> aggregate(slice({steps}, int(k * {b} + 1), {b}), 0L, (a, y) -> a + y))"))
    df = df.withColumn("before", F.expr("transform(blocks, (x, k) -> aggregate(slice(blocks, 1, k), 0L, (a, y) -> a + y))"))
    return df.withColumn(to, F.expr(f"transform({steps}, (x, i) -> before[int(i div {b})] + aggregate(slice({steps}, int((i div {b}) * {b} + 1), i % {b}), 0L, (a, y) -> a + y))")).drop("blocks", "before")


def located(df: DataFrame, kind: str, pattern: str, keep: str = "true") -> DataFrame:
    """Adds column kind: the matches as (start, end, found)."""
    empty = "cast(array() as array<struct<start:bigint,end:bigint,found:string>>)"
    df = df.withColumn("m", F.expr(f"regexp_extract_all(text, {quoted(pattern)}, 0)"))
    df = df.withColumn("g", F.expr(f"if(size(m) = 0, cast(array() as array<string>), split(text, {quoted(pattern)}, -1))"))
    df = df.withColumn("steps", F.expr("transform(m, (x, i) -> cast(length(g[i]) + length(x) as bigint))"))
    df = with_starts(df, "steps", "at")
    return df.withColumn(kind, F.expr(f"if(size(m) = 0, {empty}, filter(transform(m, (x, i) -> named_struct('start', at[i] + length(g[i]), 'end', at[i] + steps[i], 'found', x)), s -> {keep}))")).drop("m", "g", "steps", "at")


def least_weight(token: str) -> str:
    """SQL: the least sum of weights of a window of the token, from counts that change by one character in and one out."""
    table_ = f"array({', '.join(f'{weight(n)}L' for n in range(WINDOW + 2))})"
    n = len(ALPHABET)
    code = lambda at: f"x[{at} - 1]"
    before = lambda s, x: f"{s}.w[{s}.c[{x}]]"
    fewer = f"if(i <= {WINDOW}, s, named_struct('c', transform(s.c, (y, j) -> if(j = {code(f'i - {WINDOW}')}, y - 1, y)), 's', s.s - {before('s', code(f'i - {WINDOW}'))} + s.w[s.c[{code(f'i - {WINDOW}')}] - 1], 'b', s.b, 'w', s.w))"
    more = f"named_struct('c', transform(t.c, (y, j) -> if(j = {code('i')}, y + 1, y)), 's', t.s - {before('t', code('i'))} + t.w[t.c[{code('i')}] + 1], 'b', t.b, 'w', t.w)"
    kept = f"named_struct('c', u.c, 's', u.s, 'b', if(i >= {WINDOW}, least(u.b, u.s), u.b), 'w', u.w)"
    step = f"transform(array({fewer}), t -> transform(array({more}), u -> {kept})[0])[0]"
    codes = f"transform(split({token}, ''), ch -> instr('{ALPHABET}', ch) - 1)"
    return f"transform(array({codes}), x -> aggregate(sequence(1, size(x)), named_struct('c', array_repeat(0, {n}), 's', 0L, 'b', {1 << 60}L, 'w', {table_}), (s, i) -> {step}, s -> s.b))[0]"


def classed(token: str) -> str:
    """SQL: the candidate's kind, or null."""
    cases = " ".join(f"when {token} rlike {quoted(every)} and {token} rlike {quoted(some)} then if({least_weight(token)} <= {limit(bits)}, '{kind}', null)" for kind, (every, some, bits) in CLASSES.items())
    return f"case when {' or '.join(f'lower({token}) rlike {quoted(a)}' for a in ALLOW)} then null {cases} end"


def scanned(docs: DataFrame) -> DataFrame:
    """docs with assign, access, hex and more: arrays of spans; text is never null."""
    df = docs.withColumn("text", F.coalesce("text", F.lit("")))
    df = located(df, "assign", ASSIGN, f"length(regexp_extract(s.found, {quoted(ASSIGN)}, 2)) >= {ASSIGN_LEAST}")
    df = located(df, "access", ACCESS)
    df = located(df, "hex", HEX)
    df = located(df, "candidates", CANDIDATE)
    df = df.withColumn("candidates", F.expr("filter(candidates, c -> not exists(concat(assign, access, hex), b -> b.start < c.end and c.start < b.end))"))
    more = f"filter(transform(candidates, c -> named_struct('kind', {classed('c.found')}, 'start', c.start, 'end', c.end)), x -> x.kind is not null)"
    none = "cast(array() as array<struct<kind:string,start:bigint,end:bigint>>)"
    return df.withColumn("more", F.expr(f"if(size(candidates) = 0, {none}, {more})")).drop("candidates")


def ordered(kinds: tuple[str, ...], more: bool) -> Column:
    """All spans as (start, rank, kind, end), by start, then kind."""
    parts = [f"transform({k}, s -> named_struct('start', s.start, 'rank', {n}, 'kind', '{k}', 'end', s.end))" for n, k in enumerate(kinds)]
    if more:
        parts.append(f"transform(more, s -> named_struct('start', s.start, 'rank', {len(kinds)}, 'kind', s.kind, 'end', s.end))")
    return F.expr(f"array_sort(concat({', '.join(parts)}))")


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base and spans: strings kind:start:end joined by commas."""
    df = scanned(pick(docs, doc_id="long", text="string"))
    said = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    return df.select("doc_id", *counts, said(ordered(BASE, False)).alias("base"), said(ordered(BASE, True)).alias("spans"))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span (overlapping ones as one) replaced by MARK; other columns stay; null text stays null."""
    work = docs.select(F.struct("*").alias("row_"), F.col(f"`{text}`").alias("text"))
    df = scanned(work).withColumn("all", ordered(BASE, True))
    merged = """aggregate(all, cast(array() as array<struct<start:bigint,end:bigint>>), (a, s) ->
        if(size(a) > 0 and s.start < element_at(a, -1).end,
           concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end)))),
           concat(a, array(named_struct('start', s.start, 'end', s.end)))))"""
    df = df.withColumn("cut", F.expr(merged))
    kept = f"concat_ws('{MARK}', transform(sequence(0, size(cut)), i -> substring(text, int(if(i = 0, 0, cut[i - 1].end)) + 1, int(if(i = size(cut), length(text), cut[i].start) - if(i = 0, 0, cut[i - 1].end)))))"
    clean = F.when(F.size("cut") == 0, F.col(f"row_.`{text}`")).otherwise(F.expr(kept))
    return df.select(*[clean.alias(c) if c == text else F.col(f"row_.`{c}`") for c in docs.columns])


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    """The secrets of every document."""
    out = secret_spans(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def _oracle() -> str:
    """DuckDB: the same spans, the entropy of each window counted anew."""
    q = lambda p: "'" + p.replace("'", "''") + "'"
    table_ = f"[{', '.join(str(weight(n)) for n in range(WINDOW + 2))}]"

    def found(kind: str, pattern: str) -> str:
        return f"""select doc_id, rid, '{kind}' as kind, m[i] as found,
            list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as s
            from (select *, unnest(range(1, len(m) + 1)) as i from (select doc_id, rid, regexp_extract_all(text, {q(pattern)}) as m, regexp_split_to_array(text, {q(pattern)}) as g from d))"""

    kinds = " ".join(f"when regexp_matches(found, {q(every)}) and {' and '.join(f'regexp_matches(found, {q(x)})' for x in (['[0-9]', '[a-z]', '[A-Z]'] if 'base64' in k else [some]))} then '{k}:{limit(bits)}'" for k, (every, some, bits) in CLASSES.items())
    allow = " or ".join(f"regexp_matches(lower(found), {q(a)})" for a in ALLOW if "\\1" not in a)
    repeats = " or ".join(f"contains(lower(found), repeat('{c}', 8))" for c in dict.fromkeys(ALPHABET.lower()))
    return f"""
    with d as (select doc_id, row_number() over () as rid, coalesce(text, '') as text from documents),
    base as (
        select * from (
            {found('assign', ASSIGN)} union all {found('access', ACCESS)} union all {found('hex', HEX)})
        where kind <> 'assign' or length(regexp_extract(found, {q(ASSIGN)}, 2)) >= {ASSIGN_LEAST}),
    cand as (
        select c.*, case when {allow} or {repeats} then null {kinds} end as k from ({found('candidate', CANDIDATE)}) c
        where not exists (select 1 from base b where b.rid = c.rid and b.s < c.s + length(c.found) and c.s < b.s + length(b.found))),
    windows as (select doc_id, rid, k, s, found, unnest(range(1, length(found) - {WINDOW} + 2)) as p from cand where k is not null),
    sums as (
        select doc_id, rid, k, s, found, p, sum(({table_})[n + 1]) as w from (
            select doc_id, rid, k, s, found, p, substr(found, p + j, 1) as ch, count(*) as n from (select *, unnest(range({WINDOW})) as j from windows) group by all)
        group by all),
    more as (select distinct doc_id, rid, split_part(k, ':', 1) as kind, found, s from sums where w <= cast(split_part(k, ':', 2) as bigint)),
    alls as (
        select rid, kind, s, s + length(found) as e, case kind when 'assign' then 0 when 'access' then 1 when 'hex' then 2 else 3 end as r from
        (select rid, kind, found, s from base union all select rid, kind, found, s from more)),
    said as (
        select rid, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
            string_agg(kind || ':' || cast(s as bigint) || ':' || cast(e as bigint), ',' order by s, r) filter (r < 3) as base,
            string_agg(kind || ':' || cast(s as bigint) || ':' || cast(e as bigint), ',' order by s, r) as spans
        from alls group by rid)
    select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
        sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
    from d left join said using (rid)"""


ORACLE = _oracle()
