"""The same queries as SQL for an independent engine; adapter views are inlined."""

from __future__ import annotations

from driftloom.functions import vocab as V
from driftloom.operators import digest as D
from driftloom.operators import reports as R
from driftloom.plans.adapters import with_views

ORACLES: dict[str, str] = {}

COLLAPSED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
WEEK = "strftime({0}, '%Y-W%W')"
VERDICT = (
    "case when prev_hash is null then 'first' when prev_hash <> content_hash then 'changed' "
    "else 'unchanged' end"
)


def oracle(name: str, sql: str, *views: str) -> None:
    ORACLES[name] = with_views(sql, *views)


def collapsed(col: str) -> str:
    return COLLAPSED.format(col)


CHANGES = f"""
select *, {VERDICT} as verdict from (
  select *, lag(content_hash) over (partition by entity_id, page_type order by seq) as prev_hash from (
    select *, sha256({collapsed('content_text')}) as content_hash from fx_captures where content_text <> ''
  )
)
"""
ITEM_STATE = """
select entity_id, platform, item_id, arg_min(item_text, seq) as item_text, arg_min(seen_at, seq) as first_seen_at,
  arg_max(seen_at, seq) as last_seen_at from fx_items group by all
"""
KNOWN = "select distinct entity_id, platform, item_id from fx_items where seen_at < timestamp '2024-01-22'"
FRESH = f"""
select * from fx_items o where seen_at >= timestamp '2024-01-22' and not exists (
  select 1 from ({KNOWN}) k
  where k.entity_id = o.entity_id and k.platform = o.platform and k.item_id = o.item_id)
"""

# --- Stored state ---
oracle("e1_detect_changes", f"select seq, entity_id, page_type, content_hash, verdict from ({CHANGES})", "fx_captures")
oracle("e1_changes_against_state", f"""
select seq, entity_id, page_type, verdict from ({CHANGES}) where checked_at >= timestamp '2024-01-22'""", "fx_captures")
oracle("e2_snapshots_to_append", f"""
select seq, entity_id, page_type, content_hash, content_text from ({CHANGES}) where verdict <> 'unchanged'""", "fx_captures")
oracle("e3_first_scan_note", """
select entity_id, page_type, case when items_raw <> '' then concat('First scan — ',
  len(list_filter(string_split(items_raw, chr(10)), lambda x: trim(x) <> '')),
  case page_type when 'blog' then ' post(s)' else ' job(s)' end, ' indexed') end as note from fx_page_items""", "fx_page_items")
oracle("e4_upsert_items", ITEM_STATE, "fx_items")
oracle("e5_fold_runs", """
select run_id, started_at, case when status <> 'O' then started_at + to_seconds(run_id % 100) end as finished_at,
  run_id % 9 as entity_count, case status when 'O' then 'running' when 'F' then 'success' else 'error' end as status,
  case when status <> 'O' then concat('• run ', run_id) end as executive_summary,
  case when status <> 'O' then cast(run_id % 100 as double) end as duration_seconds from fx_runs""", "fx_runs")
oracle("e7_run_metrics", f"""
select coalesce(i.entity_id, p.entity_id) as entity_id, coalesce(new_ads_count, 0) as new_ads_count,
  coalesce(new_posts_count, 0) as new_posts_count, coalesce(pages_changed_count, 0) as pages_changed_count
from (select entity_id, count(*) filter (platform = 'click') as new_ads_count,
        count(*) filter (platform <> 'click') as new_posts_count from ({FRESH}) group by 1) i
full join (select entity_id, count(*) filter (verdict = 'changed') as pages_changed_count from ({CHANGES}) group by 1) p
  on i.entity_id = p.entity_id""", "fx_items", "fx_captures")
oracle("e9_usage_monthly", """
select endpoint, strftime(ts, '%Y-%m') as month, count(*) as request_count from fx_usage where success group by all""", "fx_usage")
oracle("e10_admit_requests", """
select seq, endpoint, month, cast(used as bigint) as used, used < 50 as admitted from (
  select *, coalesce(sum(success::int) over (partition by endpoint, month order by seq
    rows between unbounded preceding and 1 preceding), 0) as used
  from (select *, strftime(ts, '%Y-%m') as month from fx_usage))""", "fx_usage")
oracle("e11_prune_snapshots", """
select seq, entity_id, page_type from (
  select *, row_number() over (partition by entity_id, page_type order by seq desc) as rn from fx_captures)
where rn = 1 or checked_at >= timestamp '2024-01-15'""", "fx_captures")
oracle("e11_prune_partitions", """
select seq, entity_id, page_type from (
  select *, row_number() over (partition by entity_id, page_type order by seq desc) as rn from fx_captures)
where rn = 1 or checked_at >= timestamp '2024-01-15'""", "fx_captures")
oracle("e13_prune_by_manifest", """
select count(*) filter (rn > 1 and checked_at < timestamp '2024-01-15') as pruned,
  count(*) filter (rn = 1 or checked_at >= timestamp '2024-01-15') as left_rows from (
  select *, row_number() over (partition by entity_id, page_type order by seq desc) as rn from fx_captures)""", "fx_captures")
oracle("e12_prune_items", f"""
select entity_id, platform, item_id from ({ITEM_STATE}) where last_seen_at >= timestamp '2024-01-26'""", "fx_items")
oracle("e13_prune_report", f"""
select 'snapshots' as table_name, count(*) as pruned from (
  select *, row_number() over (partition by entity_id, page_type order by seq desc) as rn from fx_captures)
where rn > 1 and checked_at < timestamp '2024-01-15'
union all
select 'items', count(*) from ({ITEM_STATE}) where last_seen_at < timestamp '2024-01-26'""", "fx_captures", "fx_items")
oracle("d2_new_items", f"select seq, entity_id, platform, item_id from ({FRESH})", "fx_items")
oracle("d2_new_item_counts", f"""
select entity_id, platform, count(*) as new_rows, count(distinct item_id) as new_distinct from ({FRESH}) group by all""", "fx_items")
oracle("d7_latest_snapshot", """
select entity_id, page_type, content_text, checked_at, seq from fx_captures
qualify row_number() over (partition by entity_id, page_type order by seq desc) = 1""", "fx_captures")
oracle("d7_latest_summary", """
select * from fx_summaries
qualify row_number() over (partition by entity_id, summary_type order by created_at desc, id desc) = 1""", "fx_summaries")
oracle("d8_summary_history", """
select id, entity_id, summary_type, rank from (select *,
  row_number() over (partition by entity_id, summary_type order by created_at desc, id desc) as rank from fx_summaries)
where rank <= 10""", "fx_summaries")

# --- Trends ---
oracle("f1_item_trend", f"""
select {WEEK.format('first_seen_at')} as week, entity_id, platform, count(*) as new_count
from ({ITEM_STATE}) where first_seen_at >= timestamp '2024-02-01' - interval 84 day group by all""", "fx_items")
oracle("f1_item_trend_filtered", f"""
select {WEEK.format('first_seen_at')} as week, entity_id, platform, count(*) as new_count
from ({ITEM_STATE}) where first_seen_at >= timestamp '2024-02-01' - interval 21 day
  and entity_id = 3 and platform = 'click' group by all""", "fx_items")
oracle("f2_change_trend", f"""
select {WEEK.format('checked_at')} as week, entity_id, page_type, count(*) as change_count
from ({CHANGES}) where verdict <> 'unchanged' and checked_at >= timestamp '2024-02-01' - interval 84 day
group by all""", "fx_captures")
oracle("f3_run_history", """
select r.run_id, r.started_at, r.status,
  (select count(*) from fx_run_log l where l.run_id = r.run_id and l.status = 'success') as success_count,
  (select count(*) from fx_run_log l where l.run_id = r.run_id and l.status = 'error') as error_count
from fx_runs r order by r.run_id desc limit 20""", "fx_runs", "fx_run_log")
oracle("f4_run_summaries", """
select id, entity_id, summary_type, summary_text from fx_summaries where run_id = 7 order by id""", "fx_summaries")
oracle("f5_last_run_summaries", """
select id, run_id, entity_id, summary_type, length(summary_text) as text_length from fx_summaries
where run_id = (select max(run_id) from fx_summaries)""", "fx_summaries")
oracle("f6_recent_runs", "select * from fx_runs order by run_id desc limit 5", "fx_runs")
oracle("f7_change_history", """
select id, run_id, summary_text, created_at from fx_summaries
where entity_id = 3 and summary_type = 'homepage_change'""", "fx_summaries")
oracle("f8_weekly_counts", f"""
select {WEEK.format('first_seen_at')} as week, entity_id, count(*) as new_count from ({ITEM_STATE})
group by all order by week desc, entity_id limit 20""", "fx_items")
oracle("f9_usage_all", """
select endpoint, count(*) as request_count from fx_usage
where success and strftime(ts, '%Y-%m') = '1997-03' group by 1""", "fx_usage")
oracle("f9_usage_one", """
select e.endpoint, count(u.endpoint) as request_count
from (values ('1-URGENT'), ('no-such-endpoint')) e(endpoint)
left join (select * from fx_usage where success and strftime(ts, '%Y-%m') = '1997-03') u on u.endpoint = e.endpoint
group by 1""", "fx_usage")
oracle("f10_recent_checks", """
select entity_id, page_type, checked_at, seq from fx_captures order by checked_at desc, seq desc limit 10""", "fx_captures")
oracle("f11_usage_line", """
select concat('API Direct usage: ', string_agg(endpoint || '=' || n, ', ' order by endpoint), ' (total=', sum(n), ')') as usage_line
from (select endpoint, count(*) as n from fx_usage where success group by 1)""", "fx_usage")

# --- Sources and sinks ---
def q(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("'", "''") + "'"


def hit(col: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({col}, {q('(?i)' + pattern)}), false)"


def collapsed_trim(col: str) -> str:
    return f"trim(regexp_replace({col}, '\\s+', ' ', 'g'))"


def rfind_space(head: str) -> str:
    """0-based index of the last space, -1 without one."""
    return f"(case when contains({head}, ' ') then length(regexp_extract({head}, '(?s)^(.*) ', 1)) else -1 end)"


def cut_words(col: str, n: int, low: int) -> str:
    """Word-boundary truncation of an already collapsed column."""
    head = f"rtrim(left({col}, {n}))"
    kept = f"case when {rfind_space(head)} >= {low} then left({head}, {rfind_space(head)}) else {head} end"
    return f"case when length({col}) <= {n} then {col} else rtrim({kept}, ' ,;:.') || '…' end"


def cut_smart(col: str, n: int) -> str:
    head = f"rtrim(left({col}, {n}))"
    sentence = f"regexp_extract({head}, '(?s)^.*[.!?;]')"
    return (
        f"case when length({col}) <= {n} then {col} when length({sentence}) > 60 then trim({sentence}) "
        f"when {rfind_space(head)} >= 40 then rtrim(left({head}, {rfind_space(head)})) || '…' else {head} || '…' end"
    )


def cut(col: str, n: int, marker: str = "' [truncated]'") -> str:
    return f"case when length({col}) > {n} then left({col}, {n}) || {marker} else {col} end"


def split_lines(col: str) -> str:
    return (
        f"list_filter(list_transform(string_split({col}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    )


ENTITIES = """
select cast(entity_id as varchar) as entity_id, name, website, search_term,
  list_filter(list_transform(string_split(keywords_raw, ','), lambda x: trim(x)), lambda x: x <> '') as keywords
from fx_entities where name <> '' and website <> ''
"""
oracle("a1_load_entities", f"""
select entity_id, name, website, search_term, array_to_string(keywords, '|') as keywords from ({ENTITIES})""", "fx_entities")

TAGS = V.STRIP_TAGS


def visible(col: str) -> str:
    for tag in TAGS:
        col = f"regexp_replace({col}, {q(f'(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>')}, ' ', 'g')"
    col = f"regexp_replace({col}, '(?s)<!--.*?-->', ' ', 'g')"
    col = f"regexp_replace({col}, '(?s)<[!/a-zA-Z][^>]*>', ' ', 'g')"
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        col = f"replace({col}, '{entity}', '{char}')"
    return collapsed_trim(col)


oracle("a2_capture_status", f"""
select entity_id, url, case when error is not null or text = '' then 'failed' else 'ok' end as status,
  case when error is not null then {cut_words('error', 140, 60)} when text = '' then 'empty response' end as note
from (select page_id as entity_id, url, case when page_id % 7 = 0 then '' else {visible('html')} end as text,
  {collapsed_trim("case when page_id % 10 = 0 then concat('timeout while loading ', repeat('resource ', 20), url) end")} as error
  from pages)""")
LISTED = """
select o_orderkey % 6 as keyword_idx, cast(floor(o_orderkey / 150) as bigint) as page, p.pos as okey, post_id, title, raw_body,
  channel, concat('/r/', channel, '/comments/', post_id, '/') as permalink,
  cast(epoch(date_trunc('hour', created_at)) as double) as created_utc
from fx_posts p join orders on o_orderkey = p.pos
"""
oracle("a3_parse_listing", f"""
select keyword_idx, page, row_number() over (partition by keyword_idx, page order by okey) - 1 as pos,
  post_id, title, raw_body, channel, permalink, created_utc from ({LISTED})""", "fx_posts")
PAYLOAD_FIELDS = ", ".join(
    f"case when json_extract(j, '$.{k}')::varchar not in ('null', '\"\"', '[]', '{{}}', '0', 'false') "
    f"then json_extract(j, '$.{k}') end" for k in V.PAYLOAD_LISTS
)


def item(*keys: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(json_extract_string(i, '$.{k}'), '')" for k in keys) + ", '')"


COUNTERS = ", ".join(
    f"case when json_extract_string(i, '$.{k}') is not null then '{k}=' || json_extract_string(i, '$.{k}') end"
    for k in sorted(V.ENGAGEMENT_KEYS)
)
SOCIAL = f"""
select *, left(sha256(case when url <> '' then url else concat(title, left(text, 100)) end), 16) as post_id from (
  select event_id, 'facebook' as source, false as is_owned, pos, {item('title')} as title,
    {item('snippet', 'text', 'body')} as text, {item('url')} as url, {item('author', 'username')} as author,
    {item('date')} as date, concat_ws(',', {COUNTERS}) as engagement
  from (select event_id, pos, json_extract(l, '$[' || pos || ']') as i from (
    select event_id, l, unnest(range(cast(json_array_length(l) as bigint))) as pos from (
      select event_id, coalesce({PAYLOAD_FIELDS}) as l from (select event_id, try_cast(payload as json) as j from fx_payload))
    where json_type(l) = 'ARRAY')))
"""
oracle("a4_normalize_payload", f"select * from ({SOCIAL})", "fx_payload")
oracle("a4_counters", """
select o_orderkey, case o_orderkey % 4 when 0 then '1.2K' when 1 then 'many' when 3 then '3,400' end as likes_text,
  cast(case o_orderkey % 4 when 0 then 1200 when 3 then 3400 end as bigint) as likes,
  concat(o_orderkey, '.5') as views_text, cast(o_orderkey + 1 as bigint) as views from orders""")
oracle("a5_endpoint_sources", """
select source, is_owned, count(*) as requests, count(*) filter (success) as successes from (
  select success, case left(endpoint, 1) when '1' then 'reddit' when '2' then 'linkedin' when '3' then 'facebook' when '4' then 'twitter' end as source,
    case left(endpoint, 1) when '1' then false when '2' then true when '3' then false when '4' then true end as is_owned
  from fx_usage) group by all""", "fx_usage")
oracle("a6_append_round_trip", f"""
select seq, entity_id, page_type, content_hash, content_text, checked_at from ({CHANGES}) where verdict <> 'unchanged'""", "fx_captures")
oracle("a7_commit_state", ITEM_STATE, "fx_items")
oracle("e8_save_summaries", "select * from fx_summaries", "fx_summaries")
oracle("e14_read_evolved", """
select status, case run_id % 2 when 1 then 3::bigint else 0 end as new_ads_count, 0::bigint as new_posts_count,
  count(*) as n, count(*) filter (run_id % 2 = 1) as with_run, 0::bigint as with_duration
from fx_run_log group by all""", "fx_run_log")

# --- Extraction ---
oracle("b1_visible_text", f"select page_id, {visible('html')} as visible_text from pages")
oracle("b1_visible_text_parsed", f"select page_id, {visible('html')} as visible_text from pages")
oracle("b1_bad_pages", f"select page_id, {visible('html')} as visible_text, cast(null as varchar) as error from pages")
FOCUSED = visible("regexp_extract(html, '(?s)<article>.*$', 0)")
oracle("b2_focused_text", f"select page_id, {FOCUSED} as focused_text from pages")
oracle("b3_article_titles", """
select page_id, concat(trim(replace(replace(regexp_extract(html, '(?s)<article><h1>(.*?)</h1>', 1), '&quot;', '"'), '&amp;', '&')), ' | ') as title
from pages where html like '%<article><h1>%'""")
oracle("b4_job_titles", """
select page_id, row_number() over (partition by page_id order by i) - 1 as pos, title from (
  select page_id, i, title from (
    select page_id, unnest(range(len(items))) as i, unnest(list_transform(items, lambda x: trim(regexp_replace(replace(replace(
      regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')))) as title
    from (select page_id, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) as items from pages))
  where length(title) > 5 and length(title) < 200
  qualify row_number() over (partition by page_id, title order by i) = 1)
qualify row_number() over (partition by page_id order by i) <= 100""")
oracle("b5_list_page_text", f"""
select entity_id, page_type, case when items_raw <> '' then array_to_string(list_sort({split_lines('items_raw')}), chr(10))
  else fallback_text end as content_text from fx_page_items""", "fx_page_items")
oracle("b6_parse_ad_cards", f"""
select pos, entity_id, ad_text, left(sha256(ad_text), 16) as ad_id,
  case when contains(low, 'carousel') then 'Carousel' when contains(low, 'video') then 'Video'
    when contains(low, 'single image') then 'Single Image' when contains(low, 'text ad') then 'Text' else 'Unknown' end as ad_format,
  list_filter(lines, lambda x: {hit('x', V.IMPRESSIONS_LINE)})[1] as impressions_range,
  list_filter(lines, lambda x: {hit('x', V.RUN_DATE_LINE)})[1] as date_range
from (select *, lower(card_text) as low, {split_lines('card_text')} as lines, array_to_string({split_lines('card_text')}[1:15], ' ') as ad_text
  from (select *, row_number() over (partition by entity_id order by pos) as rn from fx_cards)
  where rn <= 20 and length(trim(card_text)) >= 10)""", "fx_cards")


def age_token(col: str) -> str:
    return (
        f"coalesce(case when contains(lower({col}), 'just now') then 'just now' when contains(lower({col}), 'today') then 'today' "
        f"when contains(lower({col}), 'yesterday') then 'yesterday' end, "
        f"nullif(regexp_extract(lower({col}), {q('(?i)' + V.AGE_TOKEN)}), ''), nullif(regexp_extract({col}, {q('(?i)' + V.DATE_TOKEN)}), ''))"
    )


def looks_like_age(col: str) -> str:
    return (
        f"(regexp_matches(lower({col}), 'yesterday|today|just now') or {hit(col, V.AGE_TOKEN)} or {hit(col, V.DATE_TOKEN)})"
    )


oracle("b7_parse_organic_cards", f"""
select pos, trim(left(body, 1800)) as post_text, posted_label,
  coalesce(nullif(regexp_extract(url, '/posts/[^/?#]+-(\\d+)', 1), ''), left(sha256(concat(left(body, 300), '|', coalesce(posted_label, ''))), 16)) as post_id
from (select pos, url, coalesce(list_filter(bodies, lambda x: length(x) > 20)[1],
    case when length(whole) >= 40 then left(whole, 1200) end) as body,
    case when {looks_like_age('one')} then one else {age_token('whole')} end as posted_label
  from (select pos, case when pos % 5 = 0 then concat('https://x.example/posts/a-', pos) end as url, {collapsed_trim('card_text')} as one,
    list_transform(string_split(card_text, chr(10)), lambda x: {collapsed_trim('x')}) as bodies,
    {collapsed_trim("repeat(concat(card_text, ' '), 2)")} as whole from fx_cards))
where body is not null""", "fx_cards")
oracle("b8_posted_label", f"""
select event_id, case when label is not null and {looks_like_age('trim(label)')} then trim(label) else
  {age_token("concat('Acme posted ', coalesce(label, 'today'))")} end as posted_label from fx_age_labels""", "fx_age_labels")
oracle("b9_canonical_url", """
select page_id, coalesce(case when page_id % 3 = 0 then concat('https://www.linkedin.com/posts/', page_id)
  when page_id % 5 > 0 then string_split(url, '?')[1] end,
  concat('https://www.linkedin.com/feed/update/urn:li:activity:', page_id + 7000, '/')) as canonical_url from pages""")
oracle("b9_candidate_urls", """
select page_id, concat_ws('|', base || '/posts/?feedView=all', base || '/posts/?feedView=all&viewAsMember=true',
  concat('https://www.linkedin.com/company/', page_id, '/')) as candidates
from (select page_id, concat('https://www.linkedin.com/company/', case when page_id % 3 = 1 then 'c' else '' end, page_id) as base from pages)""")
oracle("b10_item_id", """
select page_id, case page_id % 4 when 0 then cast(page_id as varchar) when 1 then cast(page_id as varchar)
  when 2 then left(sha256(url), 16) else left(sha256(concat(left(html, 300), '|', case when page_id % 8 = 3 then '3d' else '' end)), 16) end as item_id
from pages""")
oracle("b11_content_id", """
select doc_id, left(sha256(case when doc_id % 2 = 0 then concat('https://d.example/', doc_id) else concat(source, left(text, 100)) end), 16) as content_id,
  left(sha256(text), 16) as text_id from documents""")
STATE_CASES = ", ".join(f"case when contains(low, {q(n)}) then '{m}' end" for n, m in V.PAGE_STATE_MARKERS[:7])
oracle("b12_page_state", f"""
select conv_id, turn, case when low = '' then 'empty-body' when marks = '' then 'no-known-marker' else marks end as state
from (select *, concat_ws(',', {STATE_CASES},
    case when contains(low, 'page isn''t available') or contains(low, 'this page is unavailable') then 'page-unavailable' end) as marks
  from (select conv_id, turn, lower({collapsed_trim('body_text')}) as low from fx_states))""", "fx_states")
oracle("b13_blocked_captures", """
select page_id, regexp_matches(lower(case when page_id % 4 = 0 then concat(url, '/AuthWall?x') else url end),
  '/login|/authwall|/checkpoint') as blocked from pages""")
oracle("b14_flatten_comments", """
select post_id, comment_id, trim(body) as body, path from walk
where comment_id % 5 <> 3 and trim(body) <> ''""", "fx_comments")
ORACLES["b14_flatten_comments"] = ORACLES["b14_flatten_comments"].replace("with fx_comments", "with recursive fx_comments").replace(
    "\nselect post_id, comment_id, trim(body)", """,
walk as (select post_id, comment_id, body, cast(comment_id as varchar) as path from fx_comments where parent_id is null
  union all select c.post_id, c.comment_id, c.body, concat(w.path, '.', c.comment_id)
  from fx_comments c join walk w on c.post_id = w.post_id and c.parent_id = w.comment_id)
select post_id, comment_id, trim(body)""")
ORACLES["b14_orphans"] = ORACLES["b14_flatten_comments"].replace(
    "as path from fx_comments where parent_id is null",
    "as path, case when parent_id = 2 then 'orphan' else 'tree' end as place from fx_comments where comment_id <> 2 and (parent_id is null or parent_id = 2)",
).replace("concat(w.path, '.', c.comment_id)", "concat(w.path, '.', c.comment_id), w.place").replace(
    "as body, path from walk", "as body, path, place from walk").replace("comment_id % 5 <> 3", "comment_id <> 2").replace(
    "c.parent_id = w.comment_id)", "c.parent_id = w.comment_id where c.comment_id <> 2)")
# A path of (999 - comment_id) in three digits sorts siblings by falling id, parents before their replies.
oracle("b14_reading_order", """
select post_id, comment_id, trim(body) as body, ord, depth, 'tree' as place from (
  select *, row_number() over (partition by post_id order by path) - 1 as ord from walk) where comment_id % 5 <> 3 and trim(body) <> ''""", "fx_comments")
ORACLES["b14_reading_order"] = ORACLES["b14_reading_order"].replace("with fx_comments", "with recursive fx_comments").replace(
    "\nselect post_id, comment_id, trim(body) as body, ord", """,
walk as (select post_id, comment_id, body, format('{:03d}', 999 - comment_id) as path, cast(0 as bigint) as depth from fx_comments where parent_id is null
  union all select c.post_id, c.comment_id, c.body, concat(w.path, format('{:03d}', 999 - c.comment_id)), w.depth + 1
  from fx_comments c join walk w on c.post_id = w.post_id and c.parent_id = w.comment_id)
select post_id, comment_id, trim(body) as body, ord""")
oracle("b14_raw_comment_payloads", """
select concat(conv_id, '/', turn // 50) as post_id, row_number() over (partition by conv_id, turn // 50 order by turn) - 1 as ord,
  trim(text) as body from conversations where trim(text) <> ''""")

# --- Predicates and text ---
BODY = "concat_ws(' ', title, raw_body)"
oracle("c1_price_signal", f"select pos, {hit(BODY, V.PRICE_SIGNAL)} as hit from fx_posts", "fx_posts")
oracle("c2_specific_price", f"select pos, {hit(BODY, V.CONCRETE_PRICE)} as hit from fx_posts", "fx_posts")
oracle("c3_finance_channel", f"select pos, {hit('channel', V.FINANCE_CHANNEL)} as hit from fx_posts", "fx_posts")
oracle("c4_customer_signal", f"select pos, {hit('title', V.CUSTOMER_SIGNAL)} as hit from fx_posts", "fx_posts")
oracle("c5_employee_signal", f"select post_id, comment_id, {hit('body', V.EMPLOYEE_SIGNAL)} as hit from fx_comments", "fx_comments")
oracle("c6_filter_channels", "select pos, channel from fx_posts where lower(channel) in ('smallbusiness', 'hvac')", "fx_posts")
oracle("c6_filter_channels_by_entity", """
select pos, entity_id, channel from (select *, pos % 10 + 1 as entity_id from fx_posts) where entity_id in (select entity_id from fx_entities)
  and (entity_id % 2 = 1 or lower(channel) in ('hvac', 'stocks')) and (entity_id % 3 > 0 or lower(channel) <> 'stocks')""", "fx_posts", "fx_entities")
CLEAN = """
select *, case when raw_body in ('[deleted]', '[removed]') then '' else coalesce(raw_body, '') end as text
from fx_posts where post_id <> '' and title <> '' and channel <> ''
"""
oracle("c7_clean_posts", f"select pos, title, text from ({CLEAN})", "fx_posts")


def filtered(signal: str, deny: str = "") -> str:
    return f"""
select post_id, pos, keyword_idx, channel, author, title, text, strftime(created_at, '%Y-%m-%d') as date,
  concat('https://www.reddit.com/r/', channel, '/comments/', post_id, '/') as url
from ({CLEAN}) where not {hit('channel', V.FINANCE_CHANNEL)} and {hit("concat_ws(' ', title, text)", signal)} {deny}"""


PRICING, DISCUSSION = filtered(V.PRICE_SIGNAL), filtered(V.CUSTOMER_SIGNAL)
POST_COLUMNS = "post_id, pos, channel, title, text, date, url"
oracle("c8_filter_pricing_posts", f"select {POST_COLUMNS} from ({PRICING})", "fx_posts")
oracle("c8_filter_discussion_posts", f"""
select {POST_COLUMNS} from ({filtered(V.CUSTOMER_SIGNAL, "and lower(channel) <> 'startups'")})""", "fx_posts")
oracle("c9_exclude_own", "select pos, author from fx_posts where pos % 2 = 1 or lower(author) <> 'acmehandle'", "fx_posts")
oracle("c10_select_entities", f"""
select entity_id, name from ({ENTITIES}) where lower(name) = lower('SUPPLIER#000000003')""", "fx_entities")
oracle("c10_entities_with_id", f"select entity_id, name from ({ENTITIES}) where search_term <> ''", "fx_entities")
oracle("c11_within_days", """
select event_id, case when coalesce(label, '') = '' or contains(lower(label), 'just now') or contains(lower(label), 'yesterday') then true
  when regexp_matches(label, '^\\d+d$') then cast(regexp_extract(label, '\\d+') as int) <= 7
  when regexp_matches(label, '^\\d+ weeks$') then cast(regexp_extract(label, '\\d+') as int) * 7 <= 7
  when regexp_matches(label, '^\\d+mo$') then cast(regexp_extract(label, '\\d+') as int) * 30 <= 7
  when try_strptime(label, ['%B %d, %Y', '%b %d, %Y']) is not null
    then date_diff('day', cast(try_strptime(label, ['%B %d, %Y', '%b %d, %Y']) as date), cast(as_of as date)) <= 7
  else true end as recent from fx_age_labels""", "fx_age_labels")
oracle("c12_content_hash", f"select doc_id, sha256({collapsed_trim('text')}) as content_hash from documents")
oracle("c13_sanitize", """
select doc_id, sha256(regexp_replace(replace(replace(text, 'a', chr(7) || 'a'), '.', '.' || chr(11) || chr(13) || chr(9)),
  '[\\x00-\\x08\\x0B-\\x1F]', '', 'g')) as clean_hash from documents""")
oracle("c14_truncate", f"""
select doc_id, {cut('text', 500)} as cut, {cut('text', 2900, "chr(10) || '_[truncated]_'")} as block from documents""")
oracle("c15_truncate_words", f"""
select doc_id, {cut_words('c', 220, 48)} as phrase, {cut_words('c', 140, 60)} as note
from (select doc_id, {collapsed_trim('text')} as c from documents)""")
oracle("c16_truncate_smart", f"select doc_id, {cut_smart('text', 220)} as smart from documents")
oracle("c17_pricing_callouts", f"""
select id, {hit('summary_text', V.PRICING_CALLOUT)} as callout, {hit('summary_text', V.NON_MATERIAL_PRICING)} as non_material
from fx_summaries""", "fx_summaries")


def label_case(col: str, variant: int) -> str:
    cases = " ".join(f"when '{k}' then {q(v[variant])}" for k, v in V.SOURCE_LABELS.items())
    return f"case {col} {cases} else {col} end"


oracle("c18_source_labels", f"""
select seq, {label_case('s', 0)} as label, {label_case('s', 1)} as digest_label
from (select seq, case when seq % 11 = 0 then 'custom:feed' else source end as s from fx_source_status)""", "fx_source_status")


def keyword_queries(defaults: list[str]) -> str:
    fixed = "[" + ", ".join(q(k) for k in defaults) + "]"
    return f"""
select entity_id, row_number() over (partition by entity_id order by i) - 1 as keyword_idx, concat('"', term, '" "', k, '"') as query
from (select entity_id, term, k, i from (
  select entity_id, coalesce(nullif(search_term, ''), name) as term, unnest(ks) as k, unnest(range(len(ks))) as i
  from (select *, case when len(keywords) > 0 then keywords else {fixed} end as ks from ({ENTITIES})))
  qualify row_number() over (partition by entity_id, lower(k) order by i) = 1)
qualify row_number() over (partition by entity_id order by i) <= 6"""


oracle("c19_pricing_queries", keyword_queries(V.PRICING_KEYWORDS), "fx_entities")
oracle("c19_discussion_queries", keyword_queries(V.DISCUSSION_KEYWORDS), "fx_entities")
oracle("c19_commentary_queries", f"""
select entity_id, unnest(range(len(ks))) as keyword_idx, unnest(ks) as query from (
  select entity_id, case when len(keywords) > 0 then keywords[1:2] else [coalesce(nullif(search_term, ''), name)] end as ks
  from ({ENTITIES}))""", "fx_entities")
NOTED = f"""
select *, author as entity_id, case when pos % 2 = 0 then [concat('note ', pos), channel] else [] end as comments from ({PRICING})
"""
oracle("c20_item_text", f"""
select pos, concat(title, chr(10), left(text, 700), case when pos % 2 = 0 then concat(chr(10), chr(10), 'Top comments:', chr(10),
    left(array_to_string(list_transform(comments, lambda c: '- ' || c), chr(10)), 900)) else '' end) as forum,
  concat('[', case when pos % 3 = 0 then '3d' else 'unknown date' end, '] ', left(title, 1200), chr(10), 'URL: n/a') as organic,
  concat(title, chr(10), left(text, 700)) as social from ({NOTED})""", "fx_posts")
oracle("c21_to_post", f"""
select post_id, title, text, url, 'unknown' as channel, date, '' as comments from ({SOCIAL})""", "fx_payload")

# --- Dedup, ranking and enrichment ---
FIRST_POSTS = f"select * from ({PRICING}) qualify row_number() over (partition by post_id order by keyword_idx, pos) = 1"
oracle("d1_dedup_first", f"select post_id, keyword_idx, pos, title from ({FIRST_POSTS})", "fx_posts")
oracle("d3_select_recent", """
select entity_id, item_id, seq from (
  select * from (select i.*, case when coalesce(label, '') = '' or contains(lower(label), 'just now') or contains(lower(label), 'yesterday') then true
      when regexp_matches(label, '^\\d+d$') then cast(regexp_extract(label, '\\d+') as int) <= 7
      when regexp_matches(label, '^\\d+ weeks$') then cast(regexp_extract(label, '\\d+') as int) * 7 <= 7
      when regexp_matches(label, '^\\d+mo$') then cast(regexp_extract(label, '\\d+') as int) * 30 <= 7
      when label = 'January 1, 2020' then false when label = 'Jan 25, 2024' then date_diff('day', date '2024-01-25', cast(as_of as date)) <= 7
      else true end as recent
    from fx_items i join fx_age_labels l on l.event_id = i.seq) where recent
  qualify row_number() over (partition by entity_id, item_id order by seq) = 1)
qualify row_number() over (partition by entity_id order by seq) <= 20""", "fx_items", "fx_age_labels")
PRICE_CLASS = f"case when {hit('body', V.PRICE_SIGNAL)} then 0 else 1 end"


def ranked(cls: str, keep: str = "true") -> str:
    return f"""
select post_id, comment_id, rank, left(body, 400) as body from (
  select *, row_number() over (partition by post_id order by {cls}, comment_id) as rank from fx_comments where {keep}) where rank <= 8"""


IS_CUSTOMER, IS_EMPLOYEE = hit("body", V.CUSTOMER_SIGNAL), hit("body", V.EMPLOYEE_SIGNAL)
oracle("d4_rank_pricing_comments", ranked(PRICE_CLASS), "fx_comments")
oracle("d4_rank_discussion_comments", ranked(
    f"case when {IS_CUSTOMER} then 0 else 1 end", f"({IS_CUSTOMER} or not {IS_EMPLOYEE})"), "fx_comments")
oracle("d5_attach_comments", f"""
select p.author as entity_id, p.post_id, case when p.rn <= 10 then coalesce(c.comments, '') else '' end as comments
from (select *, row_number() over (partition by author order by keyword_idx, pos) as rn from ({FIRST_POSTS})) p
left join (select concat('p', post_id) as post_id, string_agg(body, '|' order by rank) as comments from ({ranked(PRICE_CLASS)}) group by 1) c
  on c.post_id = p.post_id""", "fx_posts", "fx_comments")
oracle("d6_union_sources", f"""
select post_id, pos, title, author, null::varchar as channel from ({PRICING})
union all select post_id, pos, title, null, channel from ({DISCUSSION})""", "fx_posts")
oracle("d9_prefix_budget", """
select doc_id, source, cast(running as bigint) as running from (
  select *, sum(length(text)) over (partition by source order by doc_id) as running from documents) where running <= 22000""")

# --- Coverage ---
STATUS = """
select run_id, entity_id, source, arg_max(status, seq) as status, arg_max(coalesce(note, ''), seq) as note, min(seq) as position
from (select *, entity_id % 7 as run_id from fx_source_status) group by all
"""
OPEN = "status in ('failed', 'skipped')"
oracle("g1_source_status", f"select * from ({STATUS})", "fx_source_status")


def json_text(col: str) -> str:
    return f"concat('\"', replace({col}, '\"', '\\\"'), '\"')"


LOG = f"""
select s.entity_id, 'success' as status, coalesce(new_ads_count, 0) as new_ads_count, coalesce(new_posts_count, 0) as new_posts_count,
  coalesce(pages_changed_count, 0) as pages_changed_count,
  concat('{{"status":{{', string_agg(concat({json_text('source')}, ':', {json_text('s.status')}), ',' order by position), '}},"notes":{{',
    string_agg(concat({json_text('source')}, ':', {json_text('note')}), ',' order by position), '}}}}') as sources_json
from ({STATUS}) s
left join (select entity_id, count(*) filter (platform = 'click') as new_ads_count,
        count(*) filter (platform <> 'click') as new_posts_count from ({FRESH}) group by 1) i on i.entity_id = s.entity_id
left join (select entity_id, count(*) filter (verdict = 'changed') as pages_changed_count from ({CHANGES}) group by 1) p
  on p.entity_id = s.entity_id group by all"""
oracle("e6_log_run", LOG, "fx_items", "fx_captures", "fx_source_status")
oracle("e6_log_outcomes", f"""
select entity_id % 7 as run_id, entity_id, case when failed then 'error' else 'success' end as status,
  case when failed then 'timeout while loading' end as error_message, cast(entity_id % 100 as double) / 4 as duration_seconds,
  case when failed then 0 else new_ads_count end as new_ads_count, case when failed then 0 else new_posts_count end as new_posts_count,
  case when failed then 0 else pages_changed_count end as pages_changed_count, case when not failed then sources_json end as sources_json
from (select *, entity_id % 5 = 0 as failed from ({LOG}))""", "fx_items", "fx_captures", "fx_source_status")
oracle("g2_needs_pricing_research", f"""
select entity_id, needed, case when not needed then 'not_needed' end as status,
  case when not needed then {q(V.NOT_NEEDED_NOTE)} end as note
from (select c_custkey as entity_id, c_custkey % 5 = 0 or (captured and (n % 16 = 6 or text = '' or not {hit('text', V.CONCRETE_PRICE)})) as needed
  from (select c_custkey, seq as n, seq is not null as captured, case when seq % 8 = 2 then '' when seq % 12 = 6 then concat(content_text, ' from $ 99') else content_text end as text
    from customer left join (select * from fx_captures where page_type = 'pricing'
      qualify row_number() over (partition by entity_id order by seq desc) = 1) on entity_id = c_custkey))""", "fx_captures")
oracle("g3_route_fallbacks", """
select entity_id, network as network_fallback, (forum or coalesce(p, '') = '') and coalesce(d, '') = '' as forum_fallback
from (select entity_id, bool_or(source = 'linkedin:ads' and status in ('failed', 'skipped')) as network,
    bool_or(source = 'reddit:pricing' and status in ('failed', 'skipped')) as forum
  from (select entity_id, source, arg_max(status, seq) as status from fx_source_status group by all) group by 1)
left join (select entity_id, arg_max(summary_text, id) filter (summary_type = 'pricing_research') as p,
    case when entity_id < 5 then arg_max(summary_text, id) filter (summary_type = 'reddit_discussion') end as d
  from fx_summaries group by 1) using (entity_id)""", "fx_source_status", "fx_summaries")
oracle("g4_cascade_skips", f"""
with a as (select cast(floor(seq / 100) as bigint) as run_id, seq as run_pos, entity_id, seq % 6 > 0 as has_id, seq % 4 = 0 as ads_set,
    case when source <> 'linkedin:ads' then 'ok' when status = 'failed' then 'expired' when status = 'skipped' then 'partial' else 'ok' end as outcome,
    coalesce(case when seq % 3 > 0 then nullif(note, '') end, 'unknown scrape failure') as blame from fx_source_status),
b as (select *, coalesce(max((has_id and outcome = 'expired')::int) over (partition by run_id order by run_pos
    rows between unbounded preceding and 1 preceding), 0) = 1 as later from a)
select run_id, run_pos, entity_id,
  case when not has_id then 'not_configured' when later then 'skipped' when outcome = 'expired' then 'failed'
    when outcome = 'partial' and not ads_set then 'failed' else 'ok' end as ads,
  case when not has_id then null when later then {q(V.EXPIRED_EARLIER)} when outcome = 'expired' then 'session expired'
    when outcome = 'partial' and not ads_set then blame end as ads_note,
  case when not has_id then 'not_configured' when later then 'skipped' when outcome = 'expired' then 'skipped'
    when outcome = 'partial' then 'failed' else 'ok' end as organic,
  case when not has_id then null when later then {q(V.EXPIRED_EARLIER)} when outcome = 'expired' then 'session expired — organic post scan skipped'
    when outcome = 'partial' then blame end as organic_note
from b""".replace("with a as", "a as", 1), "fx_source_status")
ORACLES["g4_cascade_skips"] = ORACLES["g4_cascade_skips"].replace(")\n\na as", "),\na as")
oracle("g5_coverage_summary", f"""
select run_id, entity_id, string_agg(line, '; ' order by position) as coverage_summary from (
  select *, concat({label_case('source', 0)}, ' ', status, case when note <> '' then ': ' || note else '' end) as line
  from ({STATUS}) where {OPEN} qualify row_number() over (partition by run_id, entity_id order by position) <= 4) group by all""", "fx_source_status")
BUCKET_COUNTS = ", ".join(
    f"case when count(*) filter (b = '{b}') > 0 then concat('{label} ', count(*) filter (b = '{b}')) end" for b, label in V.COVERAGE_BUCKETS
)
oracle("g6_coverage_bullet", f"""
select run_id, concat('• Coverage note: partial scrape failures/skips affected ', count(distinct entity_id), ' competitor(s) (',
  concat_ws(', ', {BUCKET_COUNTS}), '); review coverage before treating the run as complete.') as bullet
from (select *, split_part(source, ':', 1) as b from ({STATUS}) where {OPEN}) group by 1""", "fx_source_status")


def issue(source: str, status: str, note: str) -> str:
    return (
        f"case when {status} = 'failed' then concat(':warning: *', {label_case(source, 1)}, ':* failed', case when {note} <> '' then concat(' (', {note}, ')') else '' end) "
        f"when {status} = 'skipped' then concat(':information_source: *', {label_case(source, 1)}, ':* skipped', case when {note} <> '' then concat(' (', {note}, ')') else '' end) end"
    )


oracle("g7_issue_lines", f"""
select run_id, entity_id, source, {issue('source', 'status', 'note')} as line from ({STATUS})
where source like 'website:%' and {OPEN}""", "fx_source_status")

# --- Reports ---
WIDE = ", ".join(
    f"arg_max(summary_text, id) filter (summary_type = '{kind}') as {col}" for kind, col in V.SUMMARY_COLUMNS.items()
)
oracle("g8_entity_report", f"select run_id, entity_id, {WIDE} from fx_summaries group by run_id, entity_id", "fx_summaries")
REPORTS = """
select *, concat('Entity ', entity_id) as name, concat('https://e', entity_id, '.example') as website_url,
  case when (run_id + entity_id) % 7 = 0 then 'Blog failed: timeout' end as coverage_summary from fx_reports
"""
GIVEN = [
    "pricing_research_summary", "pricing_change", "homepage_change", "linkedin_ads_summary",
    "reddit_discussion_summary", "coverage_summary", "error",
]


def clean_text(col: str) -> str:
    return f"regexp_replace({col}, '[\\x00-\\x08\\x0B-\\x1F]', '', 'g')"


EVIDENCE = ", ".join(
    f"case when {c} <> '' then concat('{label}: ', {cut(clean_text(c), 520)}) end" for label, c in V.EVIDENCE_FIELDS if c in GIVEN
)
oracle("g9_evidence_block", f"""
select run_id, entity_id, concat_ws(chr(10), {EVIDENCE}) as evidence from ({REPORTS})""", "fx_reports")


def packet(kind: str, where: str = "") -> str:
    n, chars, _ = R.EVIDENCE_CAPS[kind]
    order = "row_number() over (partition by entity_id order by pos)"
    head = (
        f"select entity_id, string_agg(entry, {{sep}} order by rn) as evidence from (select *, {{entry}} as entry "
        f"from (select *, {order} as rn from ({NOTED}) n {where}) where rn <= {n}) {{keep}} group by 1"
    )
    if kind == "jobs":
        body = head.format(sep="chr(10)", entry="concat('- ', text)", keep="")
    elif kind in R.FORUM_TYPES:
        entry = (
            "concat(chr(10), '---', chr(10), 'Date: ', date, '  |  Subreddit: r/', channel, chr(10), 'Title: ', title, chr(10), 'URL: ', url, "
            "chr(10), 'Post body:', chr(10), text, chr(10), case when pos % 2 = 0 then concat('Top comments:', chr(10), "
            "array_to_string(list_transform(comments, lambda c: '- ' || c), chr(10)), chr(10)) else '' end)"
        )
        body = head.format(sep="''", entry=entry, keep="")
    else:
        text = "text" if kind in ("linkedin_ads", "linkedin_organic") else "coalesce(nullif(text, ''), title)"
        body_text = cut(text, chars)
        if kind == "linkedin_ads":
            entry = f"concat('Ad ', rn, ':', chr(10), {body_text}, chr(10), 'Duration: ', date)"
        else:
            label = {"twitter_activity": "Tweet ", "facebook_reviews": "Review "}.get(kind, "Post ")
            by = "' by ', author, " if kind.endswith("_social") else ""
            url = "" if kind == "facebook_reviews" else ", chr(10), 'URL: ', url"
            entry = f"concat('{label}', rn, {by}' (', date, '):', chr(10), {body_text}{url})"
        body = head.format(sep="chr(10) || chr(10)", entry=entry, keep="")
    return f"""
select '{kind}' as kind, entity_id, item_count, evidence from ({body})
join (select entity_id, count(*) as item_count from ({NOTED}) n {where} group by 1) using (entity_id)"""


oracle("g10_evidence_packets", " union all ".join(packet(k) for k in R.EVIDENCE_CAPS), "fx_posts")
oracle("g10_changed_pages", f"""
select seq, entity_id, page_type, old_seq, {cut(clean_text('old_text'), 3000)} as old_text, {cut(clean_text('content_text'), 3000)} as new_text
from (select *, lag(seq) over w as old_seq, lag(content_text) over w as old_text from ({CHANGES}) where verdict <> 'unchanged'
  window w as (partition by entity_id, page_type order by seq))
where verdict = 'changed' and checked_at >= timestamp '2024-01-22'""", "fx_captures")
oracle("g10_page_evidence", f"""
select doc_id, {cut(clean_text('old'), 3000)} as old_text, {cut(clean_text('text'), 3000)} as new_text
from (select doc_id, text, lag(text) over (partition by source order by doc_id) as old from documents) where old is not null""")


def fallback(kind: str, where: str = "") -> str:
    chars = R.EVIDENCE_CAPS[kind][2]
    n = 5 if kind == "jobs" else 3
    text = "text" if kind in ("linkedin_ads", "linkedin_organic") else "coalesce(nullif(text, ''), title)"
    line = "text" if kind == "jobs" else "concat(title, ' (', url, ')')" if kind in R.FORUM_TYPES else cut(text, chars)
    sep = "', '" if kind == "jobs" else "chr(10) || '• '"
    start = "concat(item_count, ' new job posting(s): ')" if kind == "jobs" else "'• '"
    return f"""
select '{kind}' as kind, entity_id, item_count, concat({start}, body) as summary_text
from (select entity_id, max(c) as item_count, string_agg(line, {sep} order by rn) filter (rn <= {n}) as body from (
  select *, {line} as line, count(*) over (partition by entity_id) as c,
    row_number() over (partition by entity_id order by pos) as rn from ({NOTED}) n {where}) group by 1)"""


oracle("g11_fallback_summaries", " union all ".join(fallback(k) for k in R.EVIDENCE_CAPS), "fx_posts")
HEADED = [
    ("linkedin_ads", "linkedin", "concat('*', item_count, ' new ad(s) detected*', chr(10))"),
    ("linkedin_organic", "linkedin_organic", "concat('*', item_count, ' new post(s) in last 7 days*', chr(10))"),
    ("linkedin_organic", "apidirect_linkedin", "'*LinkedIn (via API Direct)*' || chr(10)"),
    ("reddit_discussion", "apidirect_reddit", "'*Reddit (via API Direct)*' || chr(10)"),
    ("twitter_activity", "twitter", "''"),
]
oracle("g12_headlines", " union all ".join(
    f"select '{kind}' as kind, '{platform}' as platform, entity_id, item_count, concat({prefix}, summary_text) as summary_text "
    f"from ({fallback(kind, f'where pos % 5 = {i}')})" for i, (kind, platform, prefix) in enumerate(HEADED)), "fx_posts")
oracle("g10_evidence_by_platform", packet("twitter_activity", "where pos % 3 = 0") + " union all "
       + packet("pricing_research", "where pos % 3 > 0"), "fx_posts")

MARK = q(V.BULLET_MARK)


def unmarked(col: str) -> str:
    return f"trim(regexp_replace({col}, {MARK}, ''))"


def words(col: str) -> str:
    return f"len(list_filter(string_split({col}, ' '), lambda w: w <> ''))"


SIGNAL_SKIP = "'^(step 1|step 2|step 3|extract|normalize|synthesize)'"


def signal(col: str, n: int) -> str:
    cleaned = f"list_transform({split_lines(col)}, lambda x: trim(regexp_replace({unmarked('x')}, '\\*+', '', 'g')))"
    useful = (
        f"list_filter({cleaned}, lambda y: not regexp_matches(lower(y), {SIGNAL_SKIP}) and not (y like '%:' and {words('y')} <= 5))"
    )
    return f"rtrim(left({collapsed_trim(f'coalesce(({useful})[1], {col}, {chr(39)*2})')}, {n}))"


oracle("g13_signal_line", f"select id, {signal('summary_text', 60)} as line from fx_summaries", "fx_summaries")
SKIPPED = "'^(" + "|".join(V.COMPACT_SKIP_PREFIXES) + ")'"


def compact_ctes(source: str, name: str, n: int, chars: int) -> str:
    """CTEs from ``source`` (key, text) to ``name`` (key, bullets)."""
    inline = "regexp_replace(x, '(•\\s+|\\d+[.)]\\s+)', chr(1) || '\\1', 'g')"
    kept = (
        "list_filter(list_transform(list_filter({0}, lambda x: not regexp_matches(x, '^#{{1,6}}\\s+') and not regexp_matches(lower(x), "
        + SKIPPED.replace("{", "{{").replace("}", "}}") + ")), lambda x: " + unmarked("x").replace("{", "{{").replace("}", "}}")
        + "), lambda y: not (y like '%:' and " + words("y") + " <= 5))"
    )
    plain = "list_filter(list_transform(" + kept + ", lambda x: trim(replace(x, '**', ''))), lambda x: x <> '')"
    return f"""
{name}_e as (select key, text, list_filter(list_transform(flatten(list_transform({split_lines('text')},
    lambda x: string_split({inline}, chr(1)))), lambda x: trim(x)), lambda x: x <> '') as entries from {source}),
{name}_a as (select key, text, {plain.format('entries')} as every, list_position(list_transform(entries,
    lambda x: contains(lower(x), 'step 3') or contains(lower(x), 'synthes')), true) as mark_at, entries from {name}_e),
{name}_l as (select key, text, every, case when mark_at > 0 then {plain.format('entries[mark_at + 1:]')} else [] end as late from {name}_a),
{name}_c as (select key, text, case when len(late) >= {n} then late else list_concat(late, every) end as found from {name}_l),
{name}_f as (select key, text, case when len(found) > 0 then found else
    string_split(regexp_replace({collapsed_trim('text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) end as chosen from {name}_c),
{name}_t as (select key, text, list_filter(list_transform(chosen, lambda x: trim({collapsed_trim('x')}, ' •-*')),
    lambda x: x <> '' and not regexp_matches(lower(x), {SKIPPED})) as points from {name}_f),
{name}_d as (select key, text, list_filter(points, lambda x, i: list_position(list_transform(points, lambda z: lower(z)), lower(x)) = i)[1:{n}] as firsts from {name}_t),
{name} as (select key, case when coalesce(text, '') = '' then '' when len(firsts) = 0 then '• Summary unavailable' else
    array_to_string(list_transform(firsts, lambda x: '• ' || {cut_smart('x', chars)}), chr(10)) end as bullets from {name}_d)"""


def chained(name: str, ctes: str, sql: str, *views: str) -> None:
    """An oracle with further common table expressions after the adapter views."""
    ORACLES[name] = with_views("@@", *views).replace("\n@@", ",\n" + ctes + "\n" + sql)


chained("g14_compact_bullets", "s as (select id as key, summary_text as text from fx_summaries),"
        + compact_ctes("s", "short", 3, 220) + "," + compact_ctes("s", "long", 6, 380),
        "select short.key as id, short.bullets as bullets, long.bullets as long_bullets from short join long using (key)", "fx_summaries")
LONG_BULLETS = f"""
select doc_id, concat(case when doc_id % 5 = 0 then 'no bullet' || chr(10) else '' end, array_to_string(list_transform(
  range(0, least(len(ws) // 12, 40) + 1), lambda i: '• ' || array_to_string(ws[i * 12 + 1:i * 12 + 12], ' ')), chr(10))) as bullets
from (select doc_id, string_split({collapsed_trim('text')}, ' ') as ws from documents)
"""
oracle("g15_fit_bullets", f"""
select doc_id, case when length(bullets) <= 700 then bullets
  when doc_id % 5 = 0 or kept = 0 then {cut('bullets', 2900, "chr(10) || '_[truncated]_'")}
  else concat(array_to_string(rows[1:kept], chr(10)), case when kept < len(rows) then chr(10) || {q(V.TRUNCATED_NOTICE)} else '' end) end as fitted
from (select *, len(list_filter(range(1, len(rows) + 1), lambda i: list_sum(list_transform(rows[1:i], lambda x: length(x) + 1)) - 1
    <= greatest(200, 700 - {len(V.TRUNCATED_NOTICE) + 1}))) as kept
  from (select doc_id, bullets, {split_lines('bullets')} as rows from ({LONG_BULLETS})))""")


def cut_phrase(col: str, n: int = 220) -> str:
    return cut_words(collapsed_trim(col), n, 48)


def card_of(name: str, points: str) -> str:
    return (
        f"concat('Competitor: ', {name}, chr(10), 'Signals:', chr(10), case when len({points}) > 0 then array_to_string({points}, chr(10)) "
        f"else {q(V.NO_MOVEMENT)} end)"
    )


oracle("g16_normalize_card", f"""
select id, {card_of("concat('Entity ', entity_id)", 'points')} as card from (
  select id, entity_id, list_transform(list_filter(list_transform(list_filter({split_lines('summary_text')},
      lambda x: not regexp_matches(lower(x), '^(competitor:|signals:)') and not (x like '%:' and {words('x')} <= 4)),
    lambda x: {unmarked('x')}), lambda x: x <> '')[1:5], lambda x: '- ' || {cut_phrase('x')}) as points from fx_summaries)""", "fx_summaries")
PRICE_TEXT = "coalesce(nullif(pricing_research_summary, ''), nullif(pricing_change, ''))"
CARD_MESSAGE = "coalesce(nullif(linkedin_ads_summary, ''), nullif(reddit_discussion_summary, ''), nullif(homepage_change, ''))"
SIGNALS = f"""
select *, {signal(PRICE_TEXT, 180)} as s_price, {signal(CARD_MESSAGE, 180)} as s_message,
  {signal("case when coalesce(error, '') <> '' then error else coverage_summary end", 180)} as s_risk,
  {signal(PRICE_TEXT, 140)} as x_price, {signal(CARD_MESSAGE, 140)} as x_message,
  {signal("coalesce(nullif(error, ''), nullif(coverage_summary, ''))", 120)} as x_risk,
  {signal('pricing_research_summary', 150)} as b_one, {signal('pricing_change', 150)} as b_two from ({REPORTS})
"""
CARD_POINTS = ", ".join(
    f"case when {c} <> '' then concat('- {label}: ', {cut_phrase(c, 200)}) end"
    for label, c in (("Pricing/packaging", "s_price"), ("Messaging/GTM", "s_message"), ("Coverage risk", "s_risk"))
)
CARDS = f"""
select run_id, entity_id, {card_of('name', 'points')} as card from (
  select *, list_filter([{CARD_POINTS}], lambda x: x is not null) as points from ({SIGNALS}))
"""
oracle("g17_fallback_card", f"select * from ({CARDS})", "fx_reports")


def material(col: str) -> str:
    return f"({col} <> '' and not {hit(col, V.NON_MATERIAL_PRICING)} and {hit(col, V.PRICING_CALLOUT)})"


BULLETS = f"""
select run_id, arg_min(bullet, entity_id) as pricing_bullet from (
  select run_id, entity_id, concat('• ', name, ' pricing update: ', rtrim(case when {material('b_one')} then b_one else b_two end, '. '), '.') as bullet
  from ({SIGNALS}) where {material('b_one')} or {material('b_two')}) group by 1
"""
oracle("g18_pricing_bullet", BULLETS, "fx_reports")
DRAFTS = """
select run_id, entity_id, concat_ws(chr(10), '• Messaging moved.', homepage_change, '  ', linkedin_ads_summary) as draft from fx_reports
"""


def ensured(col: str, n: int) -> str:
    rows = split_lines(col)
    return (
        f"array_to_string((case when len(list_filter({rows}, lambda x: {hit('x', V.PRICING_CALLOUT)})) > 0 or pricing_bullet is null "
        f"then {rows} else list_concat([pricing_bullet], {rows}) end)[1:{n}], chr(10))"
    )


oracle("g19_ensure_pricing", f"""
select run_id, entity_id, {ensured('draft', 4)} as ensured from ({DRAFTS}) left join ({BULLETS}) using (run_id)""", "fx_reports")
EXECUTIVE = f"""
select run_id, case when e is null then {q(V.NO_ENTITIES)} else {ensured('e', 6)} end as executive from
  (select distinct run_id from fx_summaries union all select max(run_id) + 1 from fx_summaries)
left join (select run_id, coalesce(nullif(concat_ws(chr(10), '• *Pricing watch:* ' || arg_min(name || ': ' || x_price, entity_id) filter (x_risk = '' and x_price <> ''),
    '• *Messaging shift:* ' || arg_min(name || ': ' || x_message, entity_id) filter (x_risk = '' and x_message <> ''),
    '• *Execution risk:* ' || arg_min(name || ': ' || x_risk, entity_id) filter (x_risk <> '')), ''), {q(V.NO_CHANGES)}) as e
  from ({SIGNALS}) group by 1) using (run_id)
left join ({BULLETS}) using (run_id)
"""
oracle("g20_executive_fallback", EXECUTIVE, "fx_reports")
oracle("g20_card_evidence", f"""
select * from (select run_id, entity_id, card, cast(sum(length(card)) over (partition by run_id order by entity_id) as bigint) as running
  from ({CARDS})) where running <= 22000""", "fx_reports")
oracle("g21_append_bullet", f"""
select run_id, entity_id, case when run_id % 3 = 0 then draft else array_to_string(rows[greatest(len(rows) - 2, 1):], chr(10)) end as appended
from (select *, list_concat({split_lines('draft')}, ['• Added last']) as rows from ({DRAFTS}))""", "fx_reports")
oracle("g22_recovery_run", f"""
select run_id, entities, has_new, case when has_new then executive else
  array_to_string(list_concat({split_lines('executive')}, [{q(V.NO_NET_NEW)}])[-4:], chr(10)) end as executive
from ({EXECUTIVE}) join (
  select s.run_id, count(*) as entities, bool_or(coalesce(s.entity_id % 4 = 0 and linkedin_ads_summary <> '', false)) as has_new
  from (select distinct run_id, entity_id from ({STATUS}) where source in ('linkedin:ads', 'linkedin:organic') and entity_id % 2 = 0
    and entity_id in (select c_custkey from customer)) s
  left join fx_reports r on r.run_id = s.run_id and r.entity_id = s.entity_id group by 1) using (run_id)""", "fx_reports", "fx_source_status")

# --- Digest ---
SECTION_ORDER = {  # report column: (section number, title)
    "pricing_research_summary": (6, "*Pricing Intel (Reddit):*"),
    "reddit_discussion_summary": (7, "*Reddit Customer Voice:*"),
    "linkedin_ads_summary": (8, "*LinkedIn Ads:*"),
}
LONG_TEXTS = " union all ".join(
    f"select concat(run_id, '/', entity_id, '/{c}') as key, {c} as text from fx_reports" for c in SECTION_ORDER
)
SOURCES = """
select entity_id, source, arg_max(status, seq) as status, arg_max(note, seq) as note from fx_source_status group by all
"""
BLOCK_CUT = cut("{0}", 2900, "chr(10) || '_[truncated]_'")


def shown(title: str, col: str) -> str:
    text = f"concat('{title}', chr(10), {col})"
    return BLOCK_CUT.replace("{0}", text)


def single(source: str) -> str:
    return f"max(case when source = '{source}' then {issue('source', 'status', 'note')} end)"


DIGEST_CTES = (
    f"texts as ({LONG_TEXTS})," + compact_ctes("texts", "compact", 3, 220)
    + f""",
execs as (select run_id, executive from ({EXECUTIVE})),
exec_texts as (select run_id as key, executive as text from execs),""" + compact_ctes("exec_texts", "exec_compact", 6, 380)
    + f""",
issues as (select entity_id, {single('website:pricing')} as site, count(*) filter (source like 'website:%') > 0 as has_site,
    {single('reddit:pricing')} as forum, {single('linkedin:ads')} as ads,
    bool_or(source = 'linkedin:ads' and status = 'not_configured') as ads_unset from ({SOURCES}) group by 1),
full_reports as (select r.*, i.site, i.has_site, i.forum, i.ads, coalesce(i.ads_unset, false) as ads_unset,
    c1.bullets as t_pricing, c2.bullets as t_discussion, c3.bullets as t_ads from ({REPORTS}) r left join issues i using (entity_id)
  left join compact c1 on c1.key = concat(r.run_id, '/', r.entity_id, '/pricing_research_summary')
  left join compact c2 on c2.key = concat(r.run_id, '/', r.entity_id, '/reddit_discussion_summary')
  left join compact c3 on c3.key = concat(r.run_id, '/', r.entity_id, '/linkedin_ads_summary')),
sections as (
  select run_id, entity_id, 0 as k, concat('*', name, '*  |  <', website_url, '|', website_url, '>') as text, error from full_reports
  union all select run_id, entity_id, 1, {shown('*Homepage:*', 'homepage_change')}, error from full_reports where homepage_change <> ''
  union all select run_id, entity_id, 2, {shown('*Pricing:*', 'pricing_change')}, error from full_reports where pricing_change <> ''
  union all select run_id, entity_id, 3, case when site is not null then {shown('*Website Coverage:*', 'site')}
      when has_site then ':white_check_mark: *Website:* No changes detected this week' else '*Website:* Not configured' end, error
    from full_reports where site is not null or (coalesce(homepage_change, '') = '' and coalesce(pricing_change, '') = '')
  union all select run_id, entity_id, 4, {shown('*Pricing Intel (Reddit):*', "case when pricing_research_summary <> '' then t_pricing else forum end")}, error
    from full_reports where pricing_research_summary <> '' or forum is not null
  union all select run_id, entity_id, 5, {shown('*Reddit Customer Voice:*', 't_discussion')}, error from full_reports where reddit_discussion_summary <> ''
  union all select run_id, entity_id, 6, case when linkedin_ads_summary <> '' then {shown('*LinkedIn Ads:*', 't_ads')}
      when ads_unset then '*LinkedIn Ads:* Not configured' else coalesce(ads, '*LinkedIn Ads:* No new ads') end, error from full_reports
  union all select run_id, entity_id, 7, '*LinkedIn Organic:* No new posts in last 7 days', error from full_reports),
parts as (
  select run_id, 1 as part, entity_id, k, 'section' as kind, text from sections where coalesce(error, '') = '' or k = 0
  union all select run_id, 1, entity_id, 1, 'section', concat(':warning: *Error:* ', error) from full_reports where error <> ''
  union all select run_id, 1, entity_id, 99, 'divider', null from full_reports
  union all select run_id, 0, 0, 0, 'header', 'Weekly Competitive Intel — 2024-02-01' from execs
  union all select run_id, 0, 0, 1, 'divider', null from execs
  union all select run_id, 2, 0, 0, 'section', {shown('*Executive Summary:*', 'bullets')} from execs join exec_compact on key = run_id
  union all select run_id, 2, 0, 1, 'divider', null from execs
  union all select run_id, 2, 0, 2, 'context', {q(D.FOOTER)} from execs),
blocks as (select run_id, row_number() over (partition by run_id order by part, entity_id, k) - 1 as block_no, kind, text from parts),
brief as (select run_id, row_number() over (partition by run_id order by part, entity_id, k) - 1 as block_no, kind, text from parts where part <> 1)"""
)
DIGEST_VIEWS = ("fx_reports", "fx_source_status")
chained("g23_digest_blocks", DIGEST_CTES, "select * from blocks", *DIGEST_VIEWS)
chained("g23_summary_digest", DIGEST_CTES, "select * from brief", *DIGEST_VIEWS)


def packed(source: str) -> str:
    """Message numbers by following the chain of message starts, one start at a time."""
    return f"""
hops as (select run_id, block_no, case when block_no + 50 >= n then n when d is not null then d + 1 else block_no + 50 end as after, n
  from (select *, count(*) over (partition by run_id) as n, max(case when kind = 'divider' then block_no end) over (
    partition by run_id order by block_no rows between 1 following and 49 following) as d from {source})),
starts as (select run_id, cast(0 as bigint) as start_no, cast(0 as bigint) as message_no from (select distinct run_id from {source})
  union all select h.run_id, h.after, s.message_no + 1 from starts s join hops h on h.run_id = s.run_id and h.block_no = s.start_no where h.after < h.n),
packed as (select b.run_id, b.block_no, b.kind, b.text, max(s.message_no) as message_no from {source} b
  join starts s on s.run_id = b.run_id and s.start_no <= b.block_no group by all)"""


chained("g24_pack_blocks", DIGEST_CTES + "," + packed("blocks"), "select run_id, block_no, kind, message_no from packed", *DIGEST_VIEWS)
ORACLES["g24_pack_blocks"] = ORACLES["g24_pack_blocks"].replace("with ", "with recursive ", 1)
BLOCK_JSON = """case kind when 'header' then concat('{"type":"header","text":{"type":"plain_text","text":', to_json(text), ',"emoji":true}}')
  when 'section' then concat('{"type":"section","text":{"type":"mrkdwn","text":', to_json(text), '}}')
  when 'context' then concat('{"type":"context","elements":[{"type":"mrkdwn","text":', to_json(text), '}]}') else '{"type":"divider"}' end"""
chained("a8_write_digest", DIGEST_CTES, f"""
select run_id, cast(0 as bigint) as message_no, count(*) as block_count,
  concat('{{"blocks":[', string_agg({BLOCK_JSON}, ',' order by block_no), ']}}') as payload from brief group by run_id""", *DIGEST_VIEWS)

# --- Incremental forms ---
oracle("h1_stream_changes", f"select seq, entity_id, page_type, content_hash, verdict from ({CHANGES})", "fx_captures")
oracle("h2_stream_items", ITEM_STATE, "fx_items")
oracle("h3_stream_new", """
select seq, entity_id, platform, item_id from fx_items
qualify row_number() over (partition by entity_id, platform, item_id order by seq) = 1""", "fx_items")
oracle("h3_stream_new_in_state", "select distinct entity_id, platform, item_id from fx_items", "fx_items")
oracle("h4_stream_trend", f"""
select strftime(date_trunc('week', first_seen_at), '%Y-%m-%d') as week_start, entity_id, platform, count(*) as new_count
from ({ITEM_STATE}) group by all""", "fx_items")
oracle("h5_summarize_callback", f"""
select entity_id, item_count, concat(item_count, ' items, longest: ', t) as summary_text from (
  select entity_id, count(*) as item_count, max(case when rn <= 12 then (length(title), title) end)[2] as t from (
    select *, row_number() over (partition by entity_id order by pos) as rn from ({NOTED}) n) group by 1)""", "fx_posts")
oracle("h5_summarize_groups", f"""
select entity_id, count(*) as item_count, concat(entity_id, ': ', count(*), ' items, ', sum(length(title)), ' characters, from ',
  arg_min(title, pos), ' to ', arg_max(title, pos)) as summary_text from ({NOTED}) n group by 1""", "fx_posts")
