"""The engine's own queries and their SQL twins, one for each operator; the driver reads them through __spark_entry__.

The driver's tables are clean, so queries about dirt make their own, by SQL that Spark and the oracle both read."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinsework.functions import constants as K
from rinsework.functions import pii, text
from rinsework.operators import actions, charts, checks, dependencies, gazetteer, governance, increments, loss, normalize, profile, quantiles, relations, semantics
from rinsework.plans import provenance
from rinsework.plans.ir import Step
from rinsework.session import prepare, shared_dir, staged, table
from rinsework.sources import encodings, formats, shield
from rinsework.sources.versions import VersionStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- tables with dirt, in SQL that both engines read

_DIRTY_ROW = """select c_custkey, c_name, c_nationkey,
  case when c_custkey % 20 = 0 then null when c_custkey % 37 = 0 then c_acctbal * 100 else c_acctbal end as c_acctbal,
  case when c_custkey % 13 = 0 then '  ' when c_custkey % 25 = 0 then replace(c_mktsegment, 'MACHINERY', 'MACHINRY') else c_mktsegment end as c_mktsegment
from customer"""
DIRTY = f"{_DIRTY_ROW} union all {_DIRTY_ROW} where c_custkey % 50 = 0"

CONTACTS = """select c_custkey, c_acctbal, c_custkey % 50 as bucket,
  case when c_custkey % 11 = 0 then 'no address' when c_custkey % 7 = 0 then concat(' USER', cast(c_custkey as string), '@EXAMPLE.COM ')
       else concat('user', cast(c_custkey as string), '@example.com') end as email,
  case when c_custkey % 9 = 0 then concat('+91 ', cast(6000000000 + c_custkey as string)) when c_custkey % 5 = 0 then '12345'
       when c_custkey % 4 = 0 then concat('1-', cast(2000000000 + c_custkey as string)) else cast(9000000000 + c_custkey as string) end as phone,
  case when c_custkey % 3 = 0 then concat(cast(1 + c_custkey % 28 as string), '/', cast(1 + c_custkey % 12 as string), '/2021')
       when c_custkey % 3 = 1 then concat('2020-', cast(1 + c_custkey % 12 as string), '-', cast(1 + c_custkey % 28 as string))
       else concat(cast(1 + c_custkey % 12 as string), '.', cast(13 + c_custkey % 16 as string), '.2019') end as joined,
  lpad(cast(c_custkey as string), 5, '0') as postal,
  case when c_custkey % 17 = 0 then 'N/A' when c_custkey % 19 = 0 then 'None' when c_custkey % 23 = 0 then '' else concat('note ', cast(c_custkey as string)) end as note,
  case c_custkey % 50 % 4 when 0 then (case when c_custkey % 100 = 0 then 'Hyderbad' else 'Hyderabad' end)
       when 1 then (case when c_custkey % 250 = 1 then 'MUMBAI' else 'Mumbai' end) when 2 then 'Pune' else 'Chennai' end as city,
  concat('$', cast(c_custkey % 900 as string), ',', lpad(cast(c_custkey % 1000 as string), 3, '0')) as list_price
from customer"""

ENTITIES = """select concat('d', cast(c_custkey - c_custkey % 12 as string)) as doc_id, 'CustomerName' as type,
  case c_custkey % 5 when 0 then 'Anna Smith' when 1 then 'Ana Smith' when 2 then 'Bob Jones' when 3 then 'ANNA SMITH' else concat('Carl Nr', cast(c_custkey as string)) end as value,
  case c_custkey % 5 when 0 then 'Anna Smith' when 1 then 'Ana Smith' when 2 then 'Bob Jones' when 3 then 'Anna Smith' else concat('Carl Nr', cast(c_custkey as string)) end as normalized_value,
  cast(c_custkey % 12 * 100 as int) as span_start, cast(c_custkey % 12 * 100 + 10 as int) as span_end, cast(1 + c_custkey % 2 as int) as page,
  concat('r', cast(c_custkey as string)) as record_id, cast(0.98 as double) as confidence, concat('n', cast(c_custkey as string)) as entity_id
from customer
union all select concat('d', cast(c_custkey - c_custkey % 12 as string)), 'Phone', cast(9000000000 + c_custkey as string), concat('+91-', cast(9000000000 + c_custkey as string)),
  cast(c_custkey % 12 * 100 + 37 as int), cast(c_custkey % 12 * 100 + 47 as int), cast(1 + c_custkey % 2 as int),
  case when c_custkey % 4 = 0 then 'loose' else concat('r', cast(c_custkey as string)) end, cast(0.96 as double), concat('p', cast(c_custkey as string))
from customer where c_custkey % 3 <> 0
union all select concat('d', cast(c_custkey - c_custkey % 12 as string)), 'Email', concat('u', cast(c_custkey as string), case when c_custkey % 10 = 0 then '@nodot' else '@example.com' end),
  concat('u', cast(c_custkey as string), '@example.com'), cast(c_custkey % 12 * 100 + 60 as int), cast(c_custkey % 12 * 100 + 80 as int), cast(1 + c_custkey % 2 as int),
  concat('r', cast(c_custkey as string)), cast(0.99 as double), concat('e', cast(c_custkey as string))
from customer where c_custkey % 5 <> 1
union all select concat('d', cast(c_custkey - c_custkey % 12 as string)), 'City', case when c_custkey % 7 = 0 then 'Hyd' else 'Pune' end, case when c_custkey % 7 = 0 then 'Hyderabad' else 'Pune' end,
  cast(c_custkey % 12 * 100 + 90 as int), cast(c_custkey % 12 * 100 + 95 as int), cast(1 + c_custkey % 2 as int), concat('r', cast(c_custkey as string)), cast(0.96 as double), concat('c', cast(c_custkey as string))
from customer where c_custkey % 2 = 0
union all select concat('d', cast(c_custkey - c_custkey % 12 as string)), 'City', 'Delhi', 'Delhi', cast(c_custkey % 12 * 100 + 96 as int), cast(c_custkey % 12 * 100 + 99 as int), cast(1 + c_custkey % 2 as int),
  concat('r', cast(c_custkey as string)), cast(0.90 as double), concat('q', cast(c_custkey as string))
from customer where c_custkey % 8 = 0"""


def _made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return prepare(spark).sql(sql.replace("from customer", "from {customer}"), customer=table(spark, sf_dir, "customer"))


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, DIRTY)


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, CONTACTS)


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, ENTITIES)


def _step(action: str, column: str = "ALL", test: str = "", **own) -> Step:
    return Step(1, column, "", "", action, own, test_criterion=test)


# ---- the flagship: dirty customers, cleaned by a plan

CLEANING = [
    _step("deduplicate_exact"),
    _step("standardize_values", "c_mktsegment", mapping={"MACHINRY": "MACHINERY", "": None}),
    _step("clamp_bounds", "c_acctbal", lower=0, upper=20_000),
    _step("knn_impute", "c_acctbal", strategy="median"),
    _step("knn_impute", "c_mktsegment", strategy="mode"),
]

_CLEAN_SQL = f"""with dirty as ({DIRTY}), one as (select distinct * from dirty),
named as (select c_custkey, c_name, c_nationkey, case when c_acctbal < 0 then 0 when c_acctbal > 20000 then 20000 else c_acctbal end as c_acctbal,
  case trim(c_mktsegment) when 'MACHINRY' then 'MACHINERY' when '' then null else trim(c_mktsegment) end as c_mktsegment from one),
fill as (select (select median(c_acctbal) from named) as m, (select c_mktsegment from named where c_mktsegment is not null group by 1 order by count(*) desc, 1 limit 1) as s)
select c_custkey, c_name, c_nationkey, coalesce(c_acctbal, m) as c_acctbal, coalesce(c_mktsegment, s) as c_mktsegment from named, fill"""


@query(_CLEAN_SQL)
def clean_customers(spark, sf_dir):
    out = actions.apply_plan(_dirty(spark, sf_dir), CLEANING)
    return checks.split(out, checks.checks_of(CLEANING, out.columns))[0]


# ---- profiles

LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _stats_sql(of: str, columns: list[str], places: int = 4) -> str:
    r = lambda x: f"round(({x})::double, {places})"
    one = lambda c: (
        f"select '{c}' as column_name, count(*) - count({c}) as n_null, {r(f'min({c})')} as min, {r(f'max({c})')} as max, {r(f'avg({c})')} as mean, {r(f'stddev_samp({c})')} as std, "
        + ", ".join(f"{r(f'quantile_cont({c}, {q})')} as q{round(100 * q)}" for q in (0.25, 0.5, 0.75))
        + f", min({c}) = max({c}) as zero_var from t"
    )
    return f"with t as ({of}) " + " union all ".join(one(c) for c in columns)


@query(_stats_sql("select * from lineitem", LINEITEM))
def profile_numeric(spark, sf_dir):
    return profile.numeric_profile(table(spark, sf_dir, "lineitem"), LINEITEM, places=4)


@query(_stats_sql(DIRTY, ["c_custkey", "c_nationkey", "c_acctbal"]))
def profile_numeric_dirty(spark, sf_dir):
    return profile.numeric_profile(_dirty(spark, sf_dir), places=4)


_GROWN = ["c_custkey", "c_acctbal", "c_nationkey"]


@query(
    f"with t as ({DIRTY}) "
    + " union all ".join(
        f"""select '{c}' as column_name, count(*) as n_rows, count(*) - count({c}) as n_null, round(min({c})::double, 2) as "min", round(max({c})::double, 2) as "max", round(avg({c})::double, 2) as mean, round(stddev_samp({c})::double, 2) as std, true as near from t"""
        for c in _GROWN
    )
)
def profile_of_growing_table(spark, sf_dir):
    """A folder that gets new files twice; a refresh reads these alone. near: distinct values and the median are those of a full run
    within the errors of the sketches."""
    at, df = _at(spark, "growing"), _dirty(spark, sf_dir).select(*_GROWN)
    grown = increments.GrowingProfile(spark, at, at + "-states")
    for i in range(3):
        df.filter(F.col("c_custkey") % 3 == i).write.mode("append").parquet(at)
        found = grown.profile()
    whole = spark.read.parquet(at)
    exact = profile.distinct_profile(whole, _GROWN).select("column_name", F.col("card").alias("exact"))
    low_high = quantiles.quantiles(whole.select(F.inline(F.array(*(F.struct(F.lit(c).alias("g"), F.col(c).cast("double").alias("x")) for c in _GROWN)))), (0.49, 0.51)).select(F.col("g").alias("column_name"), "q")
    near = (F.abs(F.col("card") - F.col("exact")) <= 0.08 * F.col("exact")) & F.col("q50").between(F.floor(F.col("q")[0]), F.ceil(F.col("q")[1]))
    return found.join(exact, "column_name").join(low_high, "column_name").select("column_name", "n_rows", "n_null", "min", "max", "mean", "std", near.alias("near"))


def _distinct_sql(of: str, columns: list[str]) -> str:
    one = lambda c: (
        f"select '{c}' as column_name, (select count(distinct {c}) + max(case when {c} is null then 1 else 0 end) from t) as card, (select count(*) - count({c}) from t) as n_null, "
        f"(select string_agg(v, '|' order by v) from (select distinct {c}::varchar as v from t where {c} is not null order by 1 limit 3)) as samples"
    )
    return f"with t as ({of}) " + " union all ".join(one(c) for c in columns)


@query(_distinct_sql(DIRTY, ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]))
def profile_distinct(spark, sf_dir):
    return profile.distinct_profile(_dirty(spark, sf_dir), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]).withColumn("samples", F.array_join("samples", "|"))


PATTERNED = ["email", "phone", "joined", "postal"]


@query(
    f"with t as ({CONTACTS}) "
    + " union all ".join(
        f"select '{c}' as column_name, " + ", ".join(f"case when s_{k} > 0.4 then s_{k} end as {k}" for k in profile.PATTERNS) + " from (select "
        + ", ".join(f"round(avg(regexp_matches(trim({c}), '{p}')::int), 4) as s_{k}" for k, p in profile.PATTERNS.items()) + " from t) q"
        for c in PATTERNED
    )
)
def profile_text_patterns(spark, sf_dir):
    return profile.pattern_profile(_contacts(spark, sf_dir), PATTERNED)


@query(f"with t as ({DIRTY}) select (select count(*) from t) as n_rows, count(*) as n_distinct, (select count(*) from t) - count(*) as duplicates from (select distinct * from t) q")
def profile_duplicates(spark, sf_dir):
    return profile.duplicate_rows(_dirty(spark, sf_dir))


@query(
    """with c as (select (select count(*) from events) as n_rows, (select count(distinct event_type) from events) as a, (select count(distinct cast(floor(value) as bigint)) from events) as b)
select n_rows, least(a::bigint * least(b, 10000), 1000000000)::bigint as state_space, least(a * least(b, 10000), 1000000000) < n_rows and n_rows > 500 as is_event_log from c"""
)
def event_log_test(spark, sf_dir):
    seen = table(spark, sf_dir, "events").select("event_type", F.floor("value").alias("amount"))
    cards = F.transform(F.collect_list("card"), lambda c: F.least(c, F.lit(10_000)))
    space = profile.distinct_profile(seen).agg(F.aggregate(cards, F.lit(1).cast("long"), lambda a, c: F.least(a * c, F.lit(10**9).cast("long"))).alias("state_space"))
    n = seen.agg(F.count("*").alias("n_rows"))
    both = n.select(F.lit(1).alias("k"), "*").join(space.select(F.lit(1).alias("k"), "*"), "k").drop("k")  # one row each
    return both.withColumn("is_event_log", (F.col("state_space") < F.col("n_rows")) & (F.col("n_rows") > 500))


@query(
    f"""with t as ({DIRTY}), n as (select count(*)::double as n, count(*) - count(c_custkey) as a, count(*) - count(c_name) as b, count(*) - count(c_nationkey) as c,
  count(*) - count(c_acctbal) as d, count(*) - count(c_mktsegment) as e from t), u as (select count(*) as u from (select distinct * from t) q)
select floor(greatest(0, least(100, 100 - 0.5 * (round(100 * a / n, 2) + round(100 * b / n, 2) + round(100 * c / n, 2) + round(100 * d / n, 2) + round(100 * e / n, 2)) / 5 - 0.5 * round(100 * (n - u) / n, 2))))::int as quality_score from n, u"""
)
def quality_score(spark, sf_dir):
    return spark.createDataFrame([(profile.quality_score(profile.profile(_dirty(spark, sf_dir))),)], "quality_score int")


# ---- normalisation

_TOKENS = ", ".join(f"'{t}'" for t in K.NULL_TOKENS)


@query(f"select c_custkey, case when note not in ({_TOKENS}) then note end as note from ({CONTACTS}) t")
def null_tokens(spark, sf_dir):
    return normalize.null_tokens(_contacts(spark, sf_dir).select("c_custkey", "note"))


@query(f"select c_custkey, nullif(trim(c_mktsegment), '') as c_mktsegment from ({DIRTY}) t")
def trim_blank(spark, sf_dir):
    return normalize.trim_blank(_dirty(spark, sf_dir).select("c_custkey", "c_mktsegment"))


@query(f"select c_custkey, replace(replace(list_price, '$', ''), ',', '')::double as list_price, postal, city from ({CONTACTS}) t")
def numeric_strings(spark, sf_dir):
    return normalize.numeric_strings(_contacts(spark, sf_dir).select("c_custkey", "list_price", F.col("postal").alias("postal"), "city"))


@query("select event_id, user_id, regexp_extract(props, '\"k\"\\s*:\\s*(-?[0-9]+)', 1)::bigint as k from events")
def unnest_props(spark, sf_dir):
    parsed = table(spark, sf_dir, "events").select("event_id", "user_id", F.from_json("props", "struct<k:bigint>").alias("props"))
    return normalize.unnest(parsed)


@query("select l_orderkey, l_linenumber, l_quantity from lineitem")
def unwrap_records(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_quantity")).alias("records"))
    return normalize.unwrap(rows, "records")


_LINES = """select case when p_partkey % 41 = 0 then concat(p_name, repeat(',', 60)) when p_partkey % 17 = 0 then concat(p_name, ',', p_brand)
  when p_partkey % 13 = 0 then concat('"', p_name, ', x",', p_brand, ',', p_type, ',', cast(p_size as string))
  else concat(p_name, ',', p_brand, ',', p_type, ',', cast(p_size as string)) end as value from part"""


@query(
    f"""select value as line, n, case when n > 18 then 'delimiter_bomb' when abs(n - 3) >= 1 then 'ragged_row' end as reason
from (select value, length(regexp_replace(value, '"(?:[^"]|"")*"', '', 'g')) - length(replace(regexp_replace(value, '"(?:[^"]|"")*"', '', 'g'), ',', '')) as n from ({_LINES}) t) q"""
)
def shield_classify(spark, sf_dir):
    lines = prepare(spark).sql(_LINES.replace("from part", "from {part}"), part=table(spark, sf_dir, "part"))
    return shield.classify(lines, shield.Facts(",", 3)).select("line", "n", "reason")


# ---- files: tables are written to the shared folder and loaded from there


def _at(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rinsework/{uuid.uuid4().hex}/{name}"


@query("select c_custkey, c_name, c_nationkey::bigint as c_nationkey, c_acctbal, c_mktsegment from customer")
def load_csv(spark, sf_dir):
    raw = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    df = formats.load(spark, formats.save(raw, _at(prepare(spark), "customer.csv"))).df
    return df.withColumns({"c_custkey": F.col("c_custkey").cast("long"), "c_nationkey": F.col("c_nationkey").cast("long")})


@query("select case when c_custkey % 10 = 9 then concat('late ', c_custkey) else c_custkey::varchar end as key, c_custkey, c_name from customer")
def load_ndjson(spark, sf_dir):
    """The last rows hold another type of key."""
    raw = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 10 == 9, F.concat(F.lit("late "), "c_custkey")).alias("late"), "c_custkey", "c_name").repartition(1).sortWithinPartitions(F.col("c_custkey") % 10)
    key = F.when(F.col("late").isNull(), F.col("c_custkey").cast("string")).otherwise(F.concat(F.lit('"'), "late", F.lit('"')))
    at = _at(prepare(spark), "customer.ndjson")
    raw.select(F.concat(F.lit('{"key": '), key, F.lit(', "c_custkey": '), "c_custkey", F.lit(', "c_name": "'), "c_name", F.lit('"}')).alias("value")).write.text(at)
    return formats.load(spark, at).df.select("key", "c_custkey", "c_name")


@query("select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey from nation")
def load_json(spark, sf_dir):
    """One document that wraps its records."""
    at = _at(prepare(spark), "nation.json")
    record = F.to_json(F.struct("n_nationkey", "n_name", "n_regionkey"))
    table(spark, sf_dir, "nation").agg(F.concat(F.lit('{"status": "ok",\n "data": ['), F.array_join(F.collect_list(record), ", "), F.lit("]}")).alias("value")).coalesce(1).write.text(at)
    return formats.load(spark, at, "json").df.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))


_NUMBERED = f"select row_number() over (order by p_partkey) as line_no, value, p_partkey from ({_LINES.replace(' as value from part', ' as value, p_partkey from part where p_partkey > 0')}) t"


@query(
    f"""select line_no, case when n > 18 then 'delimiter_bomb' else 'ragged_row' end as reason, substr(value, 1, 250) as data from
(select *, length(regexp_replace(value, '"(?:[^"]|"")*"', '', 'g')) - length(replace(regexp_replace(value, '"(?:[^"]|"")*"', '', 'g'), ',', '')) as n from ({_NUMBERED}) q) q where n > 18 or abs(n - 3) >= 1"""
)
def shield_log(spark, sf_dir):
    """Lines of a written file that the shield holds back, by number."""
    lines = prepare(spark).sql(_NUMBERED.replace("from part ", "from {part} "), part=table(spark, sf_dir, "part"))
    at = _at(spark, "part.csv")
    lines.repartition(1).sortWithinPartitions("line_no").select("value").write.text(at)
    return shield.shield(spark, at).quarantined.select(F.col("line_no").cast("long").alias("line_no"), "reason", "data")


_FOLDERS = """select source, doc_id, regexp_replace(concat(cast(doc_id as string), '|', coalesce(text, '')), '[\\r\\n]', ' '{g}) as value,
  cast(substr(source, 4) as int) % 3 as kind from {documents}"""


@query(
    f"""with lines as (
  select *, kind > 0 and (kind = 1 or doc_id % 2 = 0) and regexp_full_match(value, '[\\x00-\\xFF]*') as narrow, regexp_matches(value, '[^\\x00-\\x7F]') as beyond
  from ({_FOLDERS.format(g=", 'g'", documents="documents")}) t),
told as (select source, count_if(narrow and beyond) as bad, count_if(not narrow and beyond) as good from lines group by source)
select source, doc_id, length(value)::bigint as chars, md5(value) as line_md5, case when bad > 0 then 'cp1252' else 'utf-8' end as encoding,
  bad > 0 and good * 10 >= bad + good as mixed, false as misfit from lines join told using (source)"""
)
def encoding_by_file(spark, sf_dir):
    """Whole texts written to a folder for each source, in UTF-8, in a Latin encoding, or in both by turns, and read back."""
    lines = prepare(spark).sql(_FOLDERS.format(g="", documents="{documents}").replace("\\r\\n", "\\\\r\\\\n"), documents=table(spark, sf_dir, "documents"))
    narrow = (F.col("kind") > 0) & ((F.col("kind") == 1) | (F.col("doc_id") % 2 == 0)) & ~F.col("value").rlike(r"[^\x{0}-\x{FF}]")
    raw = F.when(narrow, F.encode(F.when(narrow, F.col("value")), "ISO-8859-1").cast("string")).otherwise(F.col("value"))
    at = _at(spark, "by_source")
    lines.select("source", raw.alias("value")).write.partitionBy("source").text(at)
    raw_lines = encodings.lines_of(spark, at)
    told = staged(encodings.encodings(raw_lines), "encodings")
    by_source = told.withColumn("source", F.regexp_extract("file", "source=([^/]*)", 1)).groupBy("source").agg(F.max(F.struct(F.col("encoding") != "utf-8", "encoding")).alias("e"), F.sum("bad").alias("bad"), F.sum("beyond").alias("beyond"))
    lines = encodings.decoded(raw_lines, told).withColumn("source", F.regexp_extract("file", "source=([^/]*)", 1)).join(by_source, "source")
    mixed = (F.col("bad") > 0) & (F.col("beyond") * 10 >= F.col("bad") + F.col("beyond"))
    return lines.select("source", F.regexp_extract("value", r"^(\d+)\|", 1).cast("long").alias("doc_id"), F.length("value").cast("long").alias("chars"), F.md5("value").alias("line_md5"), F.col("e.encoding").alias("encoding"), mixed.alias("mixed"), "misfit")


@query("select c_custkey, c_name, c_acctbal, 2 as newest, 3 as versions from customer")
def version_read(spark, sf_dir):
    """The first version, read back after another commit and a restore."""
    raw = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    store = VersionStore(spark, _at(prepare(spark), "store"))
    store.commit(raw, "raw")
    store.commit(raw.filter("c_acctbal > 0"), "filter", "c_acctbal")
    newest = store.restore(0)
    return store.read(newest).withColumns({"newest": F.lit(newest), "versions": F.lit(len(store.history()))})


@query(
    f"with t as ({DIRTY}) "
    + " union all ".join(f"select '{c}' as column_name from t having count(*) > count({c}) or count(distinct {c}) = 1" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))
)
def anomaly_columns(spark, sf_dir):
    found = profile.anomalies(profile.profile(_dirty(spark, sf_dir)))
    return spark.createDataFrame([(c,) for c in found], "column_name string")


@query(
    f"with t as ({CONTACTS}) "
    + " union all ".join(f"select '{c}' as column_name from t having {'true' if c == 'c_custkey' else f'count(distinct {c}) = count(*)'}" for c in ("c_custkey", "email", "phone", "postal", "city", "bucket"))
)
def identifier_columns(spark, sf_dir):
    """Columns that name rows: by their own name, or because every value is another."""
    found = profile.profile(_contacts(spark, sf_dir).select("c_custkey", "email", "phone", "postal", "city", "bucket"))
    return spark.createDataFrame([(c,) for c in found.meta["identifiers"]], "column_name string")


# ---- dependencies and spellings


def lcs_sql(a: str, b: str) -> str:
    """Twice the longest common subsequence over both lengths, in per cent, for the oracle."""
    cell = f"case when unicode(substr({b}, jj[1]::int, 1)) = ca[1] then 1 + coalesce(prev[jj[1] - 1], 0) else greatest(prev[jj[1]], coalesce(cur[jj[1] - 1], 0)) end"
    row = f"list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [j::int]), lambda cur, jj: list_append(cur, {cell}), cast([] as int[]))"
    whole = f"list_reduce(list_transform(string_split({a}, ''), lambda ch: [unicode(ch)]), lambda prev, ca: {row}, list_transform(range(0, length({b})), lambda x: 0::int))"
    return f"200.0 * ({whole})[-1] / (length({a}) + length({b}))"


_WORDS = """select distinct w from (select city as w from ({c}) a union all select c_mktsegment from ({d}) b where trim(c_mktsegment) <> '' union all select 'Telengana' from customer union all select 'telangana' from customer
  union all select 'Karnatak' from customer union all select 'Karnataka' from customer union all select 'Block 12' from customer union all select 'Block 13' from customer union all select 'Pun' from customer) q"""


@query(
    f"""with words as ({_WORDS.format(c=CONTACTS, d=DIRTY)}), pairs as (select x.w as a, y.w as b, lower(x.w) as la, lower(y.w) as lb from words x join words y on x.w < y.w)
select a, b, la = lb or (regexp_replace(a, '\\D', '', 'g') = regexp_replace(b, '\\D', '', 'g') and (s >= 85 or (least(length(a), length(b)) >= 4 and (starts_with(la, lb) or starts_with(lb, la)
  or (abs(length(a) - length(b)) <= 1 and (select count(*) from range(1, least(length(a), length(b)) + 1) r(i) where substr(la, i::int, 1) <> substr(lb, i::int, 1)) <= 1))))) as variants, round(s, 3) as similarity
from (select *, {lcs_sql("la", "lb")} as s from pairs) q"""
)
def typo_pairs(spark, sf_dir):
    words = _made(spark, sf_dir, _WORDS.format(c=CONTACTS, d=DIRTY))
    pairs = words.select(F.col("w").alias("a")).join(words.select(F.col("w").alias("b")), F.col("a") < F.col("b"))
    return pairs.select("a", "b", text.typo_variants(F.col("a"), F.col("b")).alias("variants"), F.round(text.similarity(F.lower("a"), F.lower("b")), 3).alias("similarity"))


# names of places, misspelt, with a number, cut off or in capitals; as many of them as there are customers
_PLACES = """select c_custkey, case c_custkey // 6 % 6 when 0 then concat(substr(b, 1, p), substr(b, p + 2)) when 1 then concat(substr(b, 1, p), 'x', substr(b, p + 1)) when 2 then concat(b, ' ', cast(c_custkey % 1000 as string))
    when 3 then substr(b, 1, p + 2) when 4 then concat(substr(b, 1, p), cast(c_custkey % 100 as string), substr(b, p + 3)) else upper(b) end as place
  from (select c_custkey, 1 + c_custkey % 5 as p, case c_custkey % 6 {names} end as b from customer) q"""
CITY_PLACES = _PLACES.format(names=" ".join(f"{'else' if i == 5 else f'when {i} then'} '{n}'" for i, n in enumerate(["Hyderabad", "San Francisco", "Chennai", "los angeles", "Ahmedabad", "hyd"])))
STATE_PLACES = _PLACES.format(names=" ".join(f"{'else' if i == 5 else f'when {i} then'} '{n}'" for i, n in enumerate(["Telangana", "north carolina", "Utah", "Tamil Nadu", "west virginia", "Jammu and Kashmir"])))


def _meant_sql(places: str, names: list[str], sure: str) -> str:
    capital = "array_to_string(list_transform(string_split({}, ' '), lambda x: concat(upper(x[1]), x[2:])), ' ')"
    known = ", ".join(f"('{n}')" for n in sorted(set(names)))
    return f"""with t as ({places}), v as (select distinct lower(trim(place)) as low from t), n(name) as (values {known}),
s as (select low, {sure} as sure from v),
k as (select low, name, row_number() over (partition by low order by score desc, name) as k from (select low, name, {lcs_sql("low", "name")} as score from s, n where sure is null) q where score >= 80)
select c_custkey, place, coalesce(sure, {capital.format("k.name")}) as meant from t join s on lower(trim(place)) = s.low left join k on k.low = s.low and k.k = 1"""


def _meant(spark: SparkSession, sf_dir: str, places: str, kind: str) -> DataFrame:
    df = _made(spark, sf_dir, places.replace("//", "div"))
    found = gazetteer.meant(df.select(F.trim("place").alias("v")).distinct(), kind)
    return df.join(found, F.trim("place") == F.col("v"), "left").select("c_custkey", "place", F.col("w").alias("meant"))


_SURE_CITY = f"""coalesce(case low {" ".join(f"when '{k}' then '{v}'" for k, v in K.CITY_SHORT.items())} end, (select array_to_string(list_transform(string_split(min(name), ' '), lambda x: concat(upper(x[1]), x[2:])), ' ') from n where length(low) >= 3 and starts_with(name, low)))"""


@query(_meant_sql(CITY_PLACES, K.CITIES, _SURE_CITY))
def city_names(spark, sf_dir):
    return _meant(spark, sf_dir, CITY_PLACES, "City")


@query(_meant_sql(STATE_PLACES, [*K.INDIAN_STATES, *K.US_STATES], "null::varchar"))
def state_names(spark, sf_dir):
    return _meant(spark, sf_dir, STATE_PLACES, "State")


_GEO = "select c.c_custkey, c.c_mktsegment, n.n_nationkey, n.n_name, r.r_regionkey, r.r_name from customer c join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey"
_GEO_COLUMNS = ["n_nationkey", "n_name", "r_regionkey", "r_name", "c_mktsegment"]


@query(
    f"with t as ({_GEO}) "
    + " union all ".join(
        f"select '{x}' as determinant, '{y}' as dependent, count(*) as groups, count(case when d > 1 then 1 end) as violating, count(case when d > 1 then 1 end) = 0 as is_exact from (select count(distinct {y}) as d from t group by {x}) q"
        for x in _GEO_COLUMNS
        for y in _GEO_COLUMNS
        if x != y
    )
)
def fd_exact_matrix(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    whole = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return dependencies.exact_matrix(whole, _GEO_COLUMNS, _GEO_COLUMNS)


_MINED = [(x, y) for x in ("n_nationkey", "n_name", "r_regionkey", "r_name") for y in _GEO_COLUMNS if x != y]


@query(
    f"with t as ({_GEO}), n as (select count(*) as n from t) "
    + " union all ".join(
        f"select '{x}' as determinant, '{y}' as dependent from t, n having count(distinct {x}) > 1 and count(distinct {x}) < 0.95 * any_value(n.n) and (select max(d) from (select count(distinct {y}) as d from t group by {x}) q) = 1" for x, y in _MINED
    )
)
def fd_mine(spark, sf_dir):
    """All exact dependencies that a search over the columns finds."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    whole = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_regionkey", "r_name", "c_mktsegment")
    found = [d for d in dependencies.mine(whole, profile.profile(whole)) if d.exact and d.determinant != "c_mktsegment"]
    return spark.createDataFrame([(d.determinant, d.dependent) for d in found], "determinant string, dependent string")


_PAIRS = f"select cast(bucket as string) as x, city as y, count(*) as n from ({CONTACTS}) t group by 1, 2"


@query(f"with p as ({_PAIRS}) select a.x, least(a.y, b.y) as a, greatest(a.y, b.y) as b from p a join p b on a.x = b.x and a.y < b.y where lower(a.y) = lower(b.y) or {lcs_sql('lower(a.y)', 'lower(b.y)')} >= 85")
def fd_variants(spark, sf_dir):
    return dependencies.variants(dependencies.pair_counts(_contacts(spark, sf_dir), "bucket", "city"))


@query("select 'Hyderbad' as y, 'Hyderabad' as root union all select 'Hyderabad', 'Hyderabad' union all select 'MUMBAI', 'Mumbai' union all select 'Mumbai', 'Mumbai'")
def fd_canonical_map(spark, sf_dir):
    return dependencies.canonical(dependencies.pair_counts(_contacts(spark, sf_dir), "bucket", "city"))


@query(
    f"""with p as ({_PAIRS}), u as (select x, case y when 'Hyderbad' then 'Hyderabad' when 'MUMBAI' then 'Mumbai' else y end as y, sum(n) as n from p group by 1, 2),
t as (select x, max(n) as top, sum(n) as n from u group by x) select sum(n)::bigint as n_rows, sum(top)::bigint as n_kept, round(sum(top) / sum(n), 4) as confidence from t"""
)
def fd_fuzzy_confidence(spark, sf_dir):
    pairs = dependencies.pair_counts(_contacts(spark, sf_dir), "bucket", "city")
    return dependencies.confidence(pairs, dependencies.canonical(pairs))


@query(f"with p as ({_PAIRS}) select x, y, case y when 'Hyderbad' then 'Hyderabad' when 'MUMBAI' then 'Mumbai' else y end as leader from p")
def fd_leaders(spark, sf_dir):
    return dependencies.leaders(dependencies.pair_counts(_contacts(spark, sf_dir), "bucket", "city"))


# ---- semantic types


@query(
    f"with t as ({CONTACTS}) "
    + " union all ".join(
        f"""select '{c}' as column_name, count({c}) as n, round(sum(length(regexp_replace(trim({c}), '[^0-9]', '', 'g'))) / sum(length(trim({c}))), 6) as digits,
  round(avg(regexp_matches(trim({c}), '{K.EMAIL}')::int), 6) as emails, round(avg((lower(trim({c})) in ({", ".join(f"'{x}'" for x in K.CITIES)}))::int), 6) as cities, round(avg(length(trim({c}))), 6) as length from t"""
        for c in ("email", "phone", "city", "postal")
    )
)
def semantic_features(spark, sf_dir):
    found = semantics.features(_contacts(spark, sf_dir), ["email", "phone", "city", "postal"])
    return found.select("column_name", "n", *(F.round(c, 6).alias(c) for c in ("digits", "emails", "cities", "length")))


@query()
def semantic_types(spark, sf_dir):
    found = semantics.infer_types(_contacts(spark, sf_dir))
    return spark.createDataFrame([(c, t.kind, float(t.confidence)) for c, t in found.items()], "column_name string, kind string, confidence double")


@query()
def cleaning_plan(spark, sf_dir):
    from rinsework.plans.flow import analyse

    steps = analyse(_dirty(spark, sf_dir)).plan.steps
    return spark.createDataFrame([(s.step_id, s.target_column, s.action, float(s.confidence), s.loss_potential) for s in steps], "step_id int, target_column string, action string, confidence double, loss_potential string")


# ---- actions


@query(f"select distinct * from ({DIRTY}) t")
def dedup_exact(spark, sf_dir):
    return actions.apply_step(_dirty(spark, sf_dir), _step("deduplicate_exact"))


@query(f"select c_custkey, case trim(c_mktsegment) when 'MACHINRY' then 'MACHINERY' when 'machinry' then 'MACHINERY' when 'FURNITURE' then 'Home' when '' then null else trim(c_mktsegment) end as c_mktsegment from ({DIRTY}) t")
def standardize_map(spark, sf_dir):
    return actions.standardize(_dirty(spark, sf_dir).select("c_custkey", "c_mktsegment"), "c_mktsegment", {"Machinry": "MACHINERY", "furniture": "Home", "": None})


@query(f"select c_custkey, case when c_acctbal < 0 then 0 when c_acctbal > 9000 then 9000 else c_acctbal end as c_acctbal from ({DIRTY}) t")
def clamp(spark, sf_dir):
    return actions.clamp(_dirty(spark, sf_dir).select("c_custkey", "c_acctbal"), "c_acctbal", 0, 9000)


@query(
    f"""with t as ({DIRTY}) select c_custkey, coalesce(c_acctbal, (select median(c_acctbal) from t)) as c_acctbal,
  coalesce(c_mktsegment, (select c_mktsegment from t where c_mktsegment is not null group by 1 order by count(*) desc, 1 limit 1)) as c_mktsegment from (select c_custkey, c_acctbal, case when c_custkey % 6 = 0 then null else c_mktsegment end as c_mktsegment from t) q"""
)
def impute_median_mode(spark, sf_dir):
    t = _dirty(spark, sf_dir)
    mode = t.agg(F.mode("c_mktsegment", True)).first()[0]
    gaps = t.select("c_custkey", "c_acctbal", F.when(F.col("c_custkey") % 6 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return actions.impute(gaps, "c_acctbal").withColumn("c_mktsegment", F.coalesce("c_mktsegment", F.lit(mode)))


@query(f"select c_custkey, case when regexp_matches(lower(trim(email)), '{K.EMAIL}') then lower(trim(email)) end as email from ({CONTACTS}) t")
def regex_email(spark, sf_dir):
    return actions.regex_replace(_contacts(spark, sf_dir).select("c_custkey", "email"), "email", "valid_email_regex", pattern=r"^\s+|\s+$", replacement="", lowercase=True, nullify_invalid=True)


@query(
    f"""with t as (select c_custkey, case when c_custkey % 10 = 3 then null else c_name end as c_name, case when c_custkey % 14 = 2 then null else c_nationkey end as c_nationkey, c_acctbal,
  case when c_custkey % 6 = 0 then null else c_mktsegment end as c_mktsegment, case when c_custkey % 9 = 4 then null else c_custkey end as account_id from ({DIRTY}) d),
f as (select round_even(median(c_nationkey), 0)::int as a, median(c_acctbal) as b from t), m as (select c_mktsegment as s from t where c_mktsegment is not null group by 1 order by count(*) desc, 1 limit 1),
g as (select c_name as s from t where c_name is not null group by 1 order by count(*) desc, 1 limit 1)
select c_custkey, coalesce(c_name, g.s) as c_name, coalesce(c_nationkey, f.a) as c_nationkey, coalesce(c_acctbal, f.b) as c_acctbal, coalesce(c_mktsegment, m.s) as c_mktsegment, account_id from t, f, m, g where account_id is not null"""
)
def resolve_nulls(spark, sf_dir):
    k = F.col("c_custkey")
    gaps = _dirty(spark, sf_dir).select(
        "c_custkey", F.when(k % 10 != 3, F.col("c_name")).alias("c_name"), F.when(k % 14 != 2, F.col("c_nationkey")).alias("c_nationkey"), "c_acctbal", F.when(k % 6 != 0, F.col("c_mktsegment")).alias("c_mktsegment"),
        F.when(k % 9 != 4, k).alias("account_id"),
    )
    return actions.resolve_nulls(gaps)[0]


# ---- loss


@query("select count(*) as n_raw, count(case when o_totalprice < 300000 then 1 end) as n_clean, round(1 - count(case when o_totalprice < 300000 then 1 end) / count(*), 4) as loss from orders")
def loss_volumetric(spark, sf_dir):
    raw = table(spark, sf_dir, "orders")
    n, m = raw.count(), raw.filter("o_totalprice < 300000").count()
    return spark.createDataFrame([(n, m, round(loss.volumetric(n, m), 4))], "n_raw long, n_clean long, loss double")


@query(
    """with s as (select avg(o_totalprice) as m, stddev_pop(o_totalprice) as d, count(*) as n from orders),
x as (select o_totalprice as x, 1 as a, 0 as b from orders union all select least(o_totalprice, 200000), 0, 1 from orders),
v as (select x, sum(a) as a, sum(b) as b from x group by x),
c as (select sum(a) over (order by x) as fa, sum(b) over (order by x) as fb, lead(x) over (order by x) - x as dx from v)
select round(sum(abs(fa - fb) / n * coalesce(dx, 0)) / any_value(d), 4) as w1 from c, s"""
)
def loss_w1(spark, sf_dir):
    raw = table(spark, sf_dir, "orders")
    return loss.wasserstein(raw, raw.withColumn("o_totalprice", F.least("o_totalprice", F.lit(200_000.0))), "o_totalprice")


@query(
    f"""with a as (select distinct c_mktsegment as x from customer), b as (select distinct c_mktsegment as x from ({DIRTY}) d where c_mktsegment is not null)
select round(1 - (select count(*) from a join b on a.x = b.x) / (select count(*) from (select x from a union select x from b) u), 4) as jaccard_loss"""
)
def loss_jaccard(spark, sf_dir):
    return loss.jaccard(table(spark, sf_dir, "customer"), _dirty(spark, sf_dir), "c_mktsegment")


_SIDE = """select {i} as side, p_partkey, lower(trim({c})) as t from part"""


@query(
    f"""with t as ({_SIDE.format(i=0, c="p_name")} union all {_SIDE.format(i=1, c="replace(p_name, 'a', 'o')")}),
g as (select side, p_partkey, ('0x' || substr(md5(substr(t, i::int, 3)), 1, 8))::ubigint % 64 as b from (select *, unnest(range(1, greatest(1, length(t) - 2) + 1)) as i from t) q),
c as (select side, p_partkey, b, count(*)::double as c from g group by all), n as (select side, p_partkey, sqrt(sum(c * c)) as n from c group by all),
w as (select c.side, c.b, sum(c.c / n.n) as w from c join n on c.side = n.side and c.p_partkey = n.p_partkey group by all),
m as (select b, coalesce(sum(case when side = 0 then w end), 0) as x, coalesce(sum(case when side = 1 then w end), 0) as y from w group by b)
select round(greatest(0, 1 - sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y)))), 4) as cosine_distance from m"""
)
def loss_cosine(spark, sf_dir):
    raw = table(spark, sf_dir, "part")
    return loss.drift(raw, raw.withColumn("p_name", F.replace("p_name", F.lit("a"), F.lit("o"))), "p_name")


@query()
def loss_report(spark, sf_dir):
    raw = table(spark, sf_dir, "customer")
    r = loss.assess(raw, raw.filter("c_acctbal > 5000"), "c_mktsegment")
    rows = [("volumetric", "ALL", r.volumetric), *(("w1", c, v) for c, v in r.w1.items()), *(("jaccard", c, v) for c, v in r.jaccard.items()), *(("cosine", c, v) for c, v in r.cosine.items()), ("utility_delta", "ALL", r.utility.delta)]
    return spark.createDataFrame([(m, c, float(v)) for m, c, v in rows], "metric string, column_name string, value double")


# ---- validation

CHECKS = [checks.Check("c_acctbal", "between", 0, 9000), checks.Check("c_acctbal", "not_null"), checks.Check("c_mktsegment", "matches", pattern="^[A-Z]+$")]
_FAILS = ["coalesce(c_acctbal < 0 or c_acctbal > 9000, false)", "c_acctbal is null", "coalesce(not regexp_matches(c_mktsegment, '^[A-Z]+$'), false)"]


@query(
    " union all ".join(
        f"select '{c.column}' as column_name, '{c.kind}' as kind, count(case when {f} then 1 end) as failed, count(*) as total, count(case when {f} then 1 end) = 0 as passed from ({DIRTY}) t" for c, f in zip(CHECKS, _FAILS, strict=True)
    )
)
def checks_summary(spark, sf_dir):
    return checks.violations(_dirty(spark, sf_dir), CHECKS)


@query(f"select * from ({DIRTY}) t where not ({' or '.join(_FAILS)})")
def filter_valid(spark, sf_dir):
    return checks.split(_dirty(spark, sf_dir), CHECKS)[0]


@query(
    f"select *, concat_ws(';', {', '.join(f"case when {f} then '{c.column}:{c.kind}' end" for c, f in zip(CHECKS, _FAILS, strict=True))}) as _reasons from ({DIRTY}) t where {' or '.join(_FAILS)}"
)
def quarantine(spark, sf_dir):
    return checks.split(_dirty(spark, sf_dir), CHECKS)[1]


# ---- personal data

_FOUND = {k: f"regexp_extract_all(text, '{p}')" for k, p in pii.CLASSES.items()}
_FOUND["PHONE"] = f"list_filter({_FOUND['PHONE']}, lambda x: length(regexp_replace(x, '\\D', '', 'g')) >= 10)"


@query("select doc_id, " + ", ".join(f"len({x})::bigint as n_{k.lower()}" for k, x in _FOUND.items()) + " from documents")
def pii_counts(spark, sf_dir):
    return pii.counts(table(spark, sf_dir, "documents"), "text", "doc_id")


def _masked(c: str) -> str:
    for kind, form in [*list(pii.CLASSES.items())[:-1], ("PHONE", pii.FULL_PHONE)]:
        c = f"regexp_replace({c}, '{form}', '[{kind}]', 'g')"
    return c


@query(f"select doc_id, {_masked('text')} as text from documents")
def pii_mask_class(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", pii.mask_class(F.col("text")).alias("text"))


@query("select doc_id, " + " or ".join(f"len({x}) > 0" for x in _FOUND.values()) + " as leaks from documents")
def pii_leak_audit(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(pii.leaks(F.col("text")), F.lit(False)).alias("leaks"))


def _tokens_sql() -> str:
    parts, left = [], "text"
    for kind, form in pii.CLASSES.items():
        found = f"regexp_extract_all({left}, '{form}')"
        if kind == "PHONE":
            found = f"list_filter({found}, lambda x: length(regexp_replace(x, '\\D', '', 'g')) >= 10)"
        plain = {"EMAIL": "lower(raw)", "PHONE": "regexp_replace(raw, '\\D', '', 'g')"}.get(kind, "replace(replace(raw, '-', ''), ' ', '')")
        parts.append(f"select doc_id, '{kind}' as kind, {plain} as value, i from (select doc_id, unnest(f) as raw, unnest(range(len(f))) as i from (select doc_id, {found} as f from documents) a) b")
        left = f"regexp_replace({left}, '{pii.FULL_PHONE if kind == 'PHONE' else form}', '[{kind}]', 'g')"
    return f"""with m as ({" union all ".join(parts)}), f as (select doc_id, kind, value, min(i) as i from m group by 1, 2, 3)
select doc_id, kind, value, concat('[', kind, '_', row_number() over (partition by doc_id, kind order by i), ']') as token from f"""


@query(_tokens_sql())
def pii_tokens_numbered(spark, sf_dir):
    return pii.tokens(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "kind", "value", "token")


@query()
def pii_mask_numbered(spark, sf_dir):
    return pii.mask_numbered(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


# ---- documents


@query(
    " union all ".join(f"select '{k}' as type, sum(len(regexp_extract_all(text, '{p}')))::bigint as n from documents" for k, p in (("Email", K.DOC_EMAIL), ("Date", K.DOC_DATE), ("Invoice", K.DOC_INVOICE), ("Postal", K.DOC_POSTAL)))
)
def entity_counts(spark, sf_dir):
    from rinsework.operators import entities

    return entities.counts(table(spark, sf_dir, "documents"))


@query()
def entities_found(spark, sf_dir):
    from rinsework.operators import entities
    from rinsework.sources.documents import texts

    return entities.dedupe(entities.extract(texts(table(spark, sf_dir, "documents"))))


@query(
    f"""with t as (select c_custkey, joined, string_split(replace(replace(joined, '.', '-'), '/', '-'), '-') as p from ({CONTACTS}) t)
select c_custkey, joined, case when length(p[1]) = 4 then concat(p[1], '-', lpad(p[2], 2, '0'), '-', lpad(p[3], 2, '0')) when p[2]::int > 12 then concat(p[3], '-', lpad(p[1], 2, '0'), '-', lpad(p[2], 2, '0'))
  else concat(p[3], '-', lpad(p[2], 2, '0'), '-', lpad(p[1], 2, '0')) end as iso from t"""
)
def dates_iso(spark, sf_dir):
    return _contacts(spark, sf_dir).select("c_custkey", "joined", text.date_iso(F.col("joined")).alias("iso"))


@query(
    f"""with t as (select c_custkey, phone, regexp_replace(phone, '\\D', '', 'g') as d from ({CONTACTS}) t)
select c_custkey, phone, case when starts_with(phone, '1-') then concat('+1-', substr(d, 2, 3), '-', substr(d, 5, 3), '-', substr(d, 8)) when starts_with(phone, '+91') then concat('+91-', substr(d, 3, 5), '-', substr(d, 8))
  when length(d) = 10 then concat('+91-', substr(d, 1, 5), '-', substr(d, 6)) else phone end as e164 from t"""
)
def phones_e164(spark, sf_dir):
    return _contacts(spark, sf_dir).select("c_custkey", "phone", text.phone_e164(F.col("phone")).alias("e164"))


@query(
    f"""with t as (select c_custkey, phone, regexp_replace(phone, '\\D', '', 'g') as d from ({CONTACTS}) t)
select c_custkey, phone, case when length(d) = 10 then concat('+91-', d) when length(d) = 12 and starts_with(d, '91') then concat('+91-', substr(d, 3)) when length(d) between 1 and 9 then null else trim(phone) end as meant from t"""
)
def phones_of_tables(spark, sf_dir):
    df = _contacts(spark, sf_dir)
    found = gazetteer.meant(df.select(F.trim("phone").alias("v")).distinct(), "Phone")
    return df.join(found, F.trim("phone") == F.col("v"), "left").select("c_custkey", "phone", F.col("w").alias("meant"))


@query(
    f"""with t as ({CONTACTS}), e as (select concat('d', c_custkey % 50) as doc_id, 'Phone' as type, phone as value, concat(phone, case when c_custkey % 2 = 0 then '' else ' ' end) as normalized_value from t
  union all select concat('d', c_custkey % 50), 'Date', joined, case when starts_with(joined, '2020') then joined else 'iso' end from t),
m as (select doc_id from e where type = 'Phone' group by 1 having count(distinct case when starts_with(trim(value), '+91') then '+91' when contains(trim(value), '-') then 'hyphenated' when regexp_full_match(trim(value), '\\d+') then 'digits' end) > 1)
select doc_id, type as field, value as current_value, normalized_value as other_value from e where value <> normalized_value and (type = 'Date' or doc_id in (select doc_id from m))"""
)
def mixed_layouts(spark, sf_dir):
    t = _contacts(spark, sf_dir)
    doc = F.concat(F.lit("d"), (F.col("c_custkey") % 50).cast("string")).alias("doc_id")
    e = t.select(doc, F.lit("Phone").alias("type"), F.col("phone").alias("value"), F.concat("phone", F.when(F.col("c_custkey") % 2 == 0, "").otherwise(" ")).alias("normalized_value"))
    e = e.unionByName(t.select(doc, F.lit("Date").alias("type"), F.col("joined").alias("value"), F.when(F.startswith("joined", F.lit("2020")), F.col("joined")).otherwise("iso").alias("normalized_value")))
    return relations.layouts(e).select("doc_id", "field", "current_value", "other_value")


_LINKS = f"""e as ({ENTITIES}), n as (select doc_id, page, record_id, entity_id as name_id, (span_start + span_end) / 2.0 as name_at, span_start as name_start from e where type = 'CustomerName'),
a as (select *, (span_start + span_end) / 2.0 as at from e where type <> 'CustomerName'),
i as (select doc_id, entity_id, type, name_id from (select a.doc_id, a.entity_id, a.type, n.name_id, row_number() over (partition by a.doc_id, a.page, a.entity_id, a.type order by abs(a.at - n.name_at), n.name_start, n.name_id) as k
  from a join n on a.doc_id = n.doc_id and a.record_id = n.record_id) q where k = 1),
o as (select doc_id, page, count(*) as c from n group by 1, 2),
p as (select doc_id, entity_id, type, name_id, c from (select a.doc_id, a.entity_id, a.type, n.name_id, o.c, row_number() over (partition by a.doc_id, a.page, a.entity_id, a.type order by abs(a.at - n.name_at), n.name_start, n.name_id) as k
  from a join n on a.doc_id = n.doc_id and a.page = n.page join o on o.doc_id = a.doc_id and o.page = a.page
  where (o.c = 1 or abs(a.at - n.name_at) <= 350) and not exists (select 1 from i where i.doc_id = a.doc_id and i.entity_id = a.entity_id)) q where k = 1),
links as (select doc_id, name_id as source_id, entity_id as target_id, concat('has_', lower(type)) as relation_type, 0.98::double as confidence from i
  union all select doc_id, name_id, entity_id, concat('has_', lower(type)), case when c = 1 then 0.95 else 0.88 end::double from p),
own as (select l.doc_id, l.source_id, t.type, t.normalized_value as v, t.confidence as c from links l join e t on t.doc_id = l.doc_id and t.entity_id = l.target_id)"""


@query(f"with {_LINKS} select * from links")
def nearest_link(spark, sf_dir):
    return relations.link(_entities(spark, sf_dir))


@query(
    f"""with {_LINKS}, o2 as (select doc_id, page, count(*) as c from n group by 1, 2)
select doc_id, name_id as source_id, entity_id as target_id, concat('has_', lower(type)) as relation_type, case when c = 1 then 0.95 else 0.88 end::double as confidence
from (select a.doc_id, a.entity_id, a.type, n.name_id, o2.c, row_number() over (partition by a.doc_id, a.entity_id order by abs(a.at - n.name_at), n.name_start, n.name_id) as k
  from a join n on a.doc_id = n.doc_id and a.page = n.page join o2 on o2.doc_id = a.doc_id and o2.page = a.page where o2.c = 1 or abs(a.at - n.name_at) <= 350) q where k = 1"""
)
def page_link(spark, sf_dir):
    """Without records, all attributes go to the nearest name of their page."""
    return relations.link(_entities(spark, sf_dir).withColumn("record_id", F.lit(None).cast("string")))


def _clusters(spark, sf_dir):
    e = _entities(spark, sf_dir)
    return relations.clusters(e, relations.link(e))


@query(
    f"""with {_LINKS}, f as (select 'Email' as field union all select 'Phone')
select e.doc_id, f.field, concat('no ', f.field, ' for ', e.normalized_value) as evidence from e, f where e.type = 'CustomerName' and not exists (select 1 from own where own.doc_id = e.doc_id and own.source_id = e.entity_id and own.type = f.field)"""
)
def missing_attrs(spark, sf_dir):
    return relations.missing(_clusters(spark, sf_dir)).select("doc_id", "field", "evidence")


@query(
    f"""with {_LINKS}, d as (select doc_id, source_id, type, list_sort(list_distinct(list(v))) as vs from own where type in ('Phone', 'City', 'State') group by 1, 2, 3)
select doc_id, type as field, vs[1] as current_value, array_to_string(vs[2:], ', ') as other_value from d where len(vs) > 1"""
)
def conflicts(spark, sf_dir):
    return relations.conflicts(_clusters(spark, sf_dir)).select("doc_id", "field", "current_value", "other_value")


@query(
    f"""with e as ({ENTITIES}), v as (select doc_id, type, lower(trim(value)) as low, count(*) as n, min(value) as value from e where type in ('CustomerName', 'Phone') group by 1, 2, 3),
near as (select a.doc_id, a.type, a.value as current_value, b.value as other_value, 'medium' as severity from v a join v b on a.doc_id = b.doc_id and a.type = b.type and a.low < b.low where {lcs_sql("a.low", "b.low")} >= 85
  or abs(length(a.low) - length(b.low)) + (select count(*) from range(1, least(length(a.low), length(b.low)) + 1) r(i) where substr(a.low, i::int, 1) <> substr(b.low, i::int, 1)) <= 1)
select doc_id, type as field, value as current_value, value as other_value, 'low' as severity from (select *, unnest(range(1, n)) as i from v where n > 1) q union all select doc_id, type, current_value, other_value, severity from near"""
)
def dup_pairs(spark, sf_dir):
    return relations.duplicates(_entities(spark, sf_dir)).select("doc_id", "field", "current_value", "other_value", "severity")


@query(
    f"""with e as ({ENTITIES}) select doc_id, type as field, value as current_value, 'invalid' as type from e where (type = 'Email' and not regexp_matches(value, '@[^@]*\\.[^@]*$'))
  or (type = 'Phone' and length(regexp_replace(value, '\\D', '', 'g')) not between 10 and 15)
union all select distinct doc_id, type, value, 'semantic' from e where type = 'City' and value = 'Hyd'
union all select doc_id, type, value, 'format_inconsistent' from e where type = 'Date' and value <> normalized_value"""
)
def invalid_and_spellings(spark, sf_dir):
    e = _entities(spark, sf_dir)
    return relations.invalid(e).unionByName(relations.spellings(e)).unionByName(relations.layouts(e)).select("doc_id", "field", "current_value", "type")


_BEST = "(select v from own o where o.doc_id = e.doc_id and o.type = '{t}' and o.source_id in (select entity_id from e x where x.doc_id = e.doc_id and x.type = 'CustomerName' and x.normalized_value = e.name) order by c desc, v limit 1)"


@query(
    f"""with {_LINKS}, w as (select n.doc_id, n.normalized_value as name, own.type, own.v, row_number() over (partition by n.doc_id, n.normalized_value, own.type order by own.c desc, own.v) as k
  from e n left join own on own.doc_id = n.doc_id and own.source_id = n.entity_id where n.type = 'CustomerName')
select doc_id, name, max(case when type = 'Phone' and k = 1 then v end) as "Phone", max(case when type = 'Email' and k = 1 then v end) as "Email", max(case when type = 'City' and k = 1 then v end) as "City" from w group by 1, 2"""
)
def records_pivot(spark, sf_dir):
    e = _entities(spark, sf_dir)
    return relations.records(e, relations.link(e), ("Phone", "Email", "City"))


_ISSUES = """select cast(o_orderkey as string) as doc_id, case o_orderkey % 6 when 0 then 'semantic' when 1 then 'format_inconsistent' when 2 then 'duplicate' when 3 then 'conflict' when 4 then 'missing' else 'invalid' end as type,
  case o_orderkey % 5 when 0 then 'Phone' when 1 then 'City' when 2 then 'Date' when 3 then 'Email' else 'State' end as field, cast(o_orderkey as string) as issue_id from orders"""


@query(
    f"""with o as (select *, case type when 'semantic' then 'standardize' when 'format_inconsistent' then 'standardize' when 'duplicate' then 'deduplicate' when 'conflict' then 'merge' when 'missing' then 'fill' else 'normalize' end as operation,
  case type when 'semantic' then 0.98 when 'format_inconsistent' then 0.95 when 'duplicate' then 0.88 when 'conflict' then 0.60 when 'missing' then 0.70 else 0.80 end::double as confidence from ({_ISSUES}) t),
r as (select *, case when type = 'conflict' then 0.90 when operation = 'deduplicate' then 0.50 when field = 'Phone' and operation = 'standardize' then 0.20 when field in ('City', 'State') and operation in ('standardize', 'normalize') then 0.15
  when field = 'Date' and operation in ('standardize', 'normalize') then 0.10 when operation = 'fill' then 0.35 else 0.15 end::double as loss_score,
  case when type = 'conflict' then 'high' when operation in ('deduplicate', 'fill') then 'medium' else 'low' end as risk_level, type <> 'conflict' as is_reversible, type = 'conflict' as is_blocked from o),
a as (select *, confidence < 0.85 or risk_level in ('medium', 'high') or is_blocked as requires_approval from r)
select *, case when not requires_approval or risk_level <> 'high' then 'approved' else 'pending' end as decision from a"""
)
def risk_governance(spark, sf_dir):
    issues = prepare(spark).sql(_ISSUES.replace("from orders", "from {orders}"), orders=table(spark, sf_dir, "orders"))
    return governance.Approvals(all_but_high_risk=True).decide(governance.recommend(issues))


# ---- charts, provenance, time


@query(
    """with s as (select min(o_totalprice) as a, max(o_totalprice) as b from orders), w as (select a, (b - a) / 25 as w from s),
c as (select least(floor((o_totalprice - a) / w), 24)::int as bin, count(*) as n from orders, w group by 1)
select r.bin::int as bin, round(a + r.bin * w, 4) as low, round(a + (r.bin + 1) * w, 4) as high, coalesce(c.n, 0)::bigint as n from range(25) r(bin) cross join w left join c on c.bin = r.bin"""
)
def histogram(spark, sf_dir):
    return charts.histogram(table(spark, sf_dir, "orders"), "o_totalprice").select("bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n")


@query("select o_orderpriority as category, round(avg(o_totalprice), 4) as mean, count(o_totalprice) as n from orders group by 1")
def mean_by_category(spark, sf_dir):
    return charts.mean_by(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice").withColumn("mean", F.round("mean", 4))


@query("select l_returnflag as x, l_linestatus as y, count(*) as n from lineitem group by 1, 2")
def heatmap_counts(spark, sf_dir):
    return charts.heatmap(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query("select p_brand as value, count(*) as n from part group by 1 order by n desc, 1 limit 5")
def value_counts(spark, sf_dir):
    return charts.value_counts(table(spark, sf_dir, "part"), "p_brand", 5)


@query(
    "select o_orderstatus as category, min(o_totalprice) as low, round(quantile_cont(o_totalprice, 0.25), 4) as q25, round(quantile_cont(o_totalprice, 0.5), 4) as q50, round(quantile_cont(o_totalprice, 0.75), 4) as q75, max(o_totalprice) as high from orders group by 1"
)
def box_plot(spark, sf_dir):
    return charts.box(table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice").withColumns({c: F.round(c, 4) for c in ("q25", "q50", "q75")})


@query("select date_trunc('month', o_orderdate)::timestamp as at, round(avg(o_totalprice), 4) as mean, count(*) as n from orders group by 1")
def line_by_month(spark, sf_dir):
    return charts.line(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice").select(F.col("at").cast("timestamp_ntz").alias("at"), F.round("mean", 4).alias("mean"), "n")


@query(
    """with d as (select sha256(concat('{"n_name":"', n_name, '","n_nationkey":', n_nationkey, ',"n_regionkey":', n_regionkey, '}')) as h from (select n_name, n_nationkey, n_regionkey from nation) t)
select count(*) as n, sum(('0x' || substr(h, 1, 15))::bigint)::varchar as a, sum(('0x' || substr(h, 16, 15))::bigint)::varchar as b from d"""
)
def content_hash(spark, sf_dir):
    return provenance.digest(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")).select("n", F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))


@query("select time_bucket(interval '1 hour', ts)::timestamp as window_start, event_type, count(*) as n from events group by 1, 2")
def tumbling_counts(spark, sf_dir):
    from rinsework.streaming.live import tumbling

    return tumbling(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    """with g as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval '30 minutes' then 1 else 0 end as new_one from events),
s as (select user_id, ts, sum(new_one) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as session_start, max(ts) + interval '30 minutes' as session_end, count(*) as n from s group by user_id, k"""
)
def session_counts(spark, sf_dir):
    from rinsework.streaming.live import sessions

    out = sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
