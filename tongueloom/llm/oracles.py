"""SQL counterparts of the registered queries, where SQL can express them."""

from __future__ import annotations

_DAY = "cast(('0x' || substr(md5('{0}|' || {1}), 1, 8)) as bigint) % {2}"

URL_FILTER = f"""
with parts as (
  select page_id, url, date '2024-01-01' + cast({_DAY.format('fetch', 'cast(page_id as varchar)', 366)} as integer) as day,
    lower(regexp_replace(regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)', 1), '^.*@', ''), '\\.?(:[0-9]*)?$', '')) as host,
    list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)', 2), '/'), lambda x: x <> '') as path
  from pages),
stood as (
  select page_id, url, day, unnest(list_distinct(list_concat(
      list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
      list_transform(range(1, len(path) + 1), lambda i: host || '/' || lower(array_to_string(path[:i], '/')))))) as pattern
  from parts where host <> ''),
own as (select distinct pattern from stood),
picked as (
  select pattern, {_DAY.format('pick', 'pattern', 12)} as pick, cast({_DAY.format('start', 'pattern', 300)} as integer) as start,
    cast({_DAY.format('stay', 'pattern', 120)} as integer) as stay from own),
log as (
  select case when pick % 2 = 0 then 'even' else 'odd' end as list, case when pick < 4 then 'block' else 'allow' end as kind, pattern,
    unnest([date '2024-01-01' + start, date '2024-01-01' + start + 5, date '2024-01-01' + start + stay, date '2024-01-01' + start + 2 * stay]) as day,
    unnest(['add', 'add', 'remove', 'add']) as action
  from picked where pick <= 4),
turns as (
  select * from (
    select *, coalesce(lag(action) over (partition by list, kind, pattern order by day, action), 'remove') as before from log)
  where action <> before),
spans as (
  select * from (
    select list, kind, pattern, action, day as valid_from, lead(day) over (partition by list, kind, pattern order by day, action) as valid_to from turns)
  where action = 'add' and (valid_to is null or valid_to > valid_from)),
hits as (
  select page_id, count(*) as n, list_sort(list(list || ':' || kind || ':' || s.pattern)) as active,
    arg_max(kind, length(s.pattern) * 2 + (kind = 'allow')::integer) = 'block' as blocked
  from stood c join spans s on c.pattern = s.pattern and day >= valid_from and (valid_to is null or day < valid_to)
  group by page_id)
select p.page_id, strftime(day, '%Y-%m-%d') as day, coalesce(n, 0) as n_active, coalesce(array_to_string(active, ','), '') as active,
  coalesce(blocked, false) as blocked
from parts p left join hits using (page_id)
"""


def build() -> dict[str, str]:
    return {"op9_urls": URL_FILTER}
