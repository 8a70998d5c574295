"""Derived views over the test tables: traces, venues, visits, tips, ratings and so on.

Integer arithmetic on the given tables only, so the same SQL serves Spark and DuckDB but
for the spelling of epoch seconds and of the events' key.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: The key of an event's properties, in Spark and in DuckDB.
SPELLINGS = {"K %": ("cast(get_json_object(props,'$.k') as bigint) %", "cast(json_extract_string(props,'$.k') as bigint) %")}
VIEWS = {
    "fx_trace": """select l_suppkey as user_id, cast(1704067200 + day_no*86400 as bigint) as day_start, day_no, cast(1704067200 + day_no*86400 + (rn % 60)*1200 as bigint) as ts_local, cast(1704067200 + day_no*86400 + (rn % 60)*1200 - 3600 as bigint) as ts_utc, cast(51.5 as double) + ((l_suppkey*7 + blk*13) % 20) * cast(0.01 as double) + (l_partkey % 5) * cast(0.0001 as double) as lat, cast(-0.1 as double) + ((l_suppkey*11 + blk*17) % 20) * cast(0.01 as double) + (l_orderkey % 5) * cast(0.0001 as double) as lon, cast(l_quantity as bigint) as nb_steps
    from (select *, cast(floor(rn/12) as bigint) as blk, cast(floor(rn/60) as bigint) as day_no
    from (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 as rn from lineitem) a) b""",
    "fx_category": """select concat('r', r_regionkey) as category_id, '' as parent_id, r_name as name from region
    union all select concat('n', n_nationkey), concat('r', n_regionkey), n_name from nation
    union all select distinct concat('b', replace(p_brand,'Brand#','')), concat('n', cast(replace(p_brand,'Brand#','') as int) % 25), p_brand from part""",
    "fx_venue": """select p_partkey as venue_id, p_name as name, concat('b', replace(p_brand,'Brand#','')) as leaf_category, concat('n', p_partkey % 25) as extra_category, p_size*10 as nb_checkins, cast(51.5 as double) + (p_partkey % 20)*cast(0.01 as double) as lat, cast(-0.1 as double) + (cast(floor(p_partkey/20) as bigint) % 20)*cast(0.01 as double) as lon from part""",
    "fx_visit": """select o_orderkey as visit_id, o_custkey % 50 as user_id, o_orderkey % 97 as place_id, a as arrival, a + 600 + cast(floor(o_totalprice) as bigint) % 14400 as departure, cast(floor(a/86400) as bigint) as day_no, case o_orderstatus when 'F' then false when 'P' then true end as deleted, case when o_orderpriority = '1-URGENT' then true end as visited, 3600*(o_custkey % 3) as utc_offset
    from (select *, UNIX(o_orderdate) + (o_orderkey % 24)*3600 as a from orders) x""",
    "fx_place": """select user_id, place_id, concat(case place_id % 3 when 0 then 'small steel' when 1 then 'blue anvil' else 'red gear' end, ' ', place_id) as name, case when place_id % 3 > 0 then place_id end as venue_id, cast(51.5 as double) + (place_id % 20)*cast(0.01 as double) as lat, cast(-0.1 as double) + (cast(floor(place_id/20) as bigint) % 20)*cast(0.01 as double) as lon, nb_visits
    from (select o_custkey % 50 as user_id, o_orderkey % 97 as place_id, cast(sum(case when o_orderstatus = 'F' then 1 else 0 end) as bigint) as nb_visits from orders group by o_custkey % 50, o_orderkey % 97) p""",
    "fx_checkin": """select l_suppkey as user_id, l_partkey as venue_id, UNIX(l_shipdate) as ts from lineitem""",
    "fx_tip": """select doc_id as tip_id, doc_id % 40 as venue_id, doc_id % 30 as author_id, lang, text from documents""",
    "fx_rating": """select user_id as session_id, event_id % 50 as place_id, K % 10 as pi_id, max(1 + least(4, ((event_id % 50)*7 + (K % 10)*3) % 5 + user_id % 2)) as rating from events group by user_id, event_id % 50, K % 10""",
    "fx_score": """select event_id % 50 as venue_id, K % 10 as pi_id, case event_id % 3 when 0 then 'sg' when 1 then 'cbow' else 'cn' end as model_type, case cast(floor(event_id/3) as bigint) % 3 when 0 then 'tips' when 1 then 'name' else 'categories' end as feature_type, max(value) as score from events group by 1,2,3,4""",
    "fx_tag": """select vec_id as word_id, label as pi_id from embeddings where vec_id % 5 <> 0""",
    "fx_feature": """select vec_id % 40 as venue_id, vec_id as word_id from embeddings where vec_id % 5 = 0""",
    "fx_chat": """select conv_id as user_id, turn as ts, role = 'user' as sender, text as message from conversations""",
}


def _epoch(text: str, spark: bool) -> str:
    text = text.replace("UNIX(o_orderdate)", "unix_timestamp(o_orderdate)" if spark else "cast(epoch(o_orderdate) as bigint)")
    text = text.replace("UNIX(l_shipdate)", "unix_timestamp(l_shipdate)" if spark else "cast(epoch(l_shipdate) as bigint)")
    return text.replace(*("K %", SPELLINGS["K %"][0 if spark else 1]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame."""
    used: dict[str, DataFrame] = {}

    def named(m: re.Match) -> str:
        used[m[2]] = table(spark, sf_dir, m[2])
        return f"{m[1]} {{{m[2]}}}"

    text = re.sub(rf"\b(from|join)\s+({'|'.join(TABLES)})\b", named, _epoch(VIEWS[name], True))
    return spark.sql(text, **used)


def oracle(sql: str, *names: str) -> str:
    """DuckDB SQL with the views that it names."""
    names = names or tuple(n for n in VIEWS if n in sql)
    if not names:
        return sql
    parts = ",\n".join(f"{n} AS ({_epoch(VIEWS[n], False)})" for n in names)
    body = sql.strip()
    return f"WITH {parts},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {parts}\n{body}"
