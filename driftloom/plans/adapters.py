"""Adapter views: deterministic tables derived from the given ones. The same SQL runs in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS = {
    "fx_items": r"""
select user_id % 10 as entity_id, event_type as platform, props as item_id, concat(event_type, ' ', props) as item_text,
  ts as seen_at, event_id as seq from events
""",
    "fx_captures": r"""
select user_id as entity_id, case event_id % 4 when 0 then 'homepage' when 1 then 'blog' when 2 then 'pricing' else 'careers' end as page_type,
  event_type as content_text, ts as checked_at, event_id as seq from events
""",
    "fx_posts": r"""
select concat('p', cast(o_custkey % 400 as varchar(20))) as post_id, o_orderkey % 6 as keyword_idx, o_orderkey as pos,
  case o_orderkey % 7 when 0 then concat('Service plans from $', cast(cast(floor(o_totalprice) as bigint) as varchar(20)), ' per month')
    when 1 then 'Considering support, worth it?' when 2 then 'I work at this place, terrible manager'
    when 3 then 'Customer review from my boss' when 4 then 'We pay per seat' when 5 then 'General chatter' else '' end as title,
  case when o_orderkey % 11 = 0 then '[deleted]' when o_orderkey % 13 = 0 then 'quoted $250 yesterday' else 'body' end as raw_body,
  case o_custkey % 5 when 0 then 'smallbusiness' when 1 then 'stocks' when 2 then 'HVAC' when 3 then 'startups' else 'forhire' end as channel,
  case o_custkey % 3 when 0 then 'AcmeHandle' when 1 then 'bob' else 'carol' end as author, o_orderdate as created_at from orders
""",
    "fx_comments": r"""
select conv_id as post_id, turn as comment_id, case when turn = 0 then null else cast(floor((turn - 1) / 2) as bigint) end as parent_id,
  concat(text, case (conv_id + turn) % 4 when 0 then ' We paid $299 per month' when 1 then ' Customer here' when 2 then ' I work at that place' else '' end) as body
from conversations
""",
    "fx_runs": r"""
select o_orderkey as run_id, o_orderdate as started_at, o_orderstatus as status from orders
""",
    "fx_run_log": r"""
select l_orderkey as run_id, l_linenumber as pos, case l_linestatus when 'F' then 'success' else 'error' end as status from lineitem
""",
    "fx_source_status": r"""
select user_id as entity_id, case event_id % 5 when 0 then 'website:pricing' when 1 then 'reddit:pricing' when 2 then 'linkedin:ads' when 3 then 'twitter:social' else 'facebook:posts' end as source,
  case event_type when 'click' then 'ok' when 'error' then 'failed' when 'view' then 'skipped' when 'purchase' then 'not_needed' else 'not_configured' end as status,
  props as note, event_id as seq from events
""",
    "fx_usage": r"""
select o_orderpriority as endpoint, o_orderdate as ts, o_orderkey as seq, o_orderstatus <> 'F' as success from orders
""",
    "fx_entities": r"""
select s_suppkey as entity_id, s_name as name, case when s_suppkey % 7 = 0 then '' else concat('https://e', cast(s_suppkey as varchar(20)), '.example') end as website,
  case when s_suppkey % 3 = 0 then null else concat(s_name, ' support') end as search_term,
  case when s_suppkey % 4 = 0 then '' else 'Pricing, pricing,cost ,,quote,rate,monthly,fee,COST,how much' end as keywords_raw from supplier
""",
    "fx_age_labels": r"""
select event_id, case event_id % 12 when 0 then concat(cast(event_id % 40 as varchar(20)), 'd') when 1 then concat(cast(event_id % 5 as varchar(20)), ' weeks')
  when 2 then 'Yesterday' when 3 then 'January 1, 2020' when 4 then 'just now' when 5 then concat(cast(event_id % 3 as varchar(20)), 'mo')
  when 6 then '5h' when 7 then 'Jan 25, 2024' when 8 then 'posted recently' when 9 then '' when 10 then '45m' else null end as label, ts as as_of from events
""",
    "fx_summaries": r"""
select event_id as id, cast(floor(event_id / 100) as bigint) as run_id, user_id % 10 as entity_id,
  case event_type when 'click' then 'pricing_research' when 'view' then 'homepage_change' when 'error' then 'linkedin_ads' when 'signup' then 'reddit_discussion' else 'pricing_change' end as summary_type,
  case event_id % 6
    when 0 then concat('### Note', chr(10), '2) Moved to credit-based plan at 99/month.', chr(10), '- **Second** point', chr(10), '- second point')
    when 1 then concat('Signals:', chr(10), '• First signal. • Second signal. • Third signal ', cast(event_id as varchar(20)))
    when 2 then '• No concrete customer pricing figures were found.'
    when 3 then concat('Step 1 extract', chr(10), 'Step 3 synthesize', chr(10), '• Quote of 250/month per user')
    when 4 then concat('Plain sentence one. Plain sentence two! ', props) else '' end as summary_text, ts as created_at from events
""",
    "fx_reports": r"""
select run_id, entity_id,
  max(case when rn = 1 and summary_type = 'pricing_research' then summary_text end) as pricing_research_summary,
  max(case when rn = 1 and summary_type = 'pricing_change' then summary_text end) as pricing_change,
  max(case when rn = 1 and summary_type = 'homepage_change' then summary_text end) as homepage_change,
  max(case when rn = 1 and summary_type = 'linkedin_ads' then summary_text end) as linkedin_ads_summary,
  max(case when rn = 1 and summary_type = 'reddit_discussion' then summary_text end) as reddit_discussion_summary,
  case when (run_id + entity_id) % 5 = 0 then 'timeout while loading' end as error
from (select *, row_number() over (partition by run_id, entity_id, summary_type order by id desc) as rn from fx_summaries) group by run_id, entity_id
""",
    "fx_payload": r"""
select event_id, case event_type
  when 'click' then concat('{"posts":[{"title":"t', cast(event_id as varchar(20)), '","snippet":"","text":"body ', cast(user_id as varchar(20)), '","url":"https://x.example/', cast(event_id % 500 as varchar(20)), '","author":"Ann","likes":', cast(event_id % 9 as varchar(20)), '}]}')
  when 'view' then concat('{"posts":[],"tweets":[{"body":"b","username":"bob","views":null,"retweets":', cast(event_id % 7 as varchar(20)), '}]}')
  when 'error' then '{"posts":"oops"}' when 'signup' then 'not json'
  else '{"reviews":[{"text":"ok"},{"snippet":"s2","shares":1}]}' end as payload from events
""",
    "fx_page_items": r"""
select c_custkey as entity_id, case when c_custkey % 2 = 0 then 'blog' else 'careers' end as page_type,
  case when c_custkey % 4 = 0 then '' else concat(c_name, ' | /', c_mktsegment, chr(10), 'Alpha ', cast(c_nationkey as varchar(20))) end as items_raw,
  concat('fallback ', c_name) as fallback_text from customer
""",
    "fx_cards": r"""
select o_orderkey as pos, o_custkey as entity_id, case o_orderkey % 6
  when 0 then concat('  Grow faster ', chr(10), chr(10), '1,000 - 5,000 impressions', chr(10), 'Started Jan 1, 2026', chr(10), 'Carousel ad with video')
  when 1 then concat('Book now ', o_orderpriority, chr(10), 'Running since May', chr(10), 'Video')
  when 2 then concat('Single Image ', cast(o_orderkey % 50 as varchar(20))) when 3 then 'A small text ad'
  when 4 then concat('Hiring help desk ', o_orderpriority, ' for small teams everywhere') else 'tiny' end as card_text from orders
""",
    "fx_states": r"""
select conv_id, turn, case (conv_id + turn) % 6 when 0 then concat('Sign  in to continue. Complete security verification challenge. ', text)
  when 1 then 'This page is unavailable. The page isn''t available' when 2 then '' when 3 then concat('Something went wrong, try again ', text)
  when 4 then 'No posts yet' else text end as body_text from conversations
""",
}


def depends_on(name: str) -> list[str]:
    """Adapter views the named view reads."""
    return [v for v in VIEWS if v != name and v in VIEWS[name]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter view over the tables in ``sf_dir``."""
    sql = VIEWS[name]
    for base in BASE_TABLES:
        if f"from {base}" in sql:
            table(spark, sf_dir, base).createOrReplaceTempView(base)
    for dep in depends_on(name):
        view(spark, sf_dir, dep).createOrReplaceTempView(dep)
    return spark.sql(sql)


def with_views(sql: str, *names: str) -> str:
    """``sql`` preceded by the adapter views it reads, as common table expressions."""
    needed: list[str] = []
    for name in names:
        for item in [*depends_on(name), name]:
            if item not in needed:
                needed.append(item)
    ctes = [f"{n} as ({VIEWS[n]})" for n in needed]
    return "with " + ",\n".join(ctes) + "\n" + sql if ctes else sql
