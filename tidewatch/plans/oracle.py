"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def _uuid5(name: str) -> str:
    h = f"sha1(unhex('{'0' * 32}') || encode({name}))"
    variant = f"translate({h}[17:17], '0123456789abcdef', '89ab89ab89ab89ab')"
    return f"({h}[1:8]||'-'||{h}[9:12]||'-5'||{h}[14:16]||'-'||{variant}||{h}[18:20]||'-'||{h}[21:32])"


def _time(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%SZ')"


def _csv(values: str) -> str:
    return f"array_to_string({values}, '|')"


_NONE = "cast([] as varchar[])"
_NOW = "timestamp '2024-06-01 00:00:00'"
_EPOCH = "timestamp '2024-01-01 00:00:00'"

# Bindings: name -> (names it reads, SQL).
_BINDINGS: dict[str, tuple[list[str], str]] = {
    "b_hashed": ([], """
        select key, list(cast(coalesce(n, 0) / norm as float) order by bucket) vector from (
          select key, bucket, n, sqrt(sum(n * n) over (partition by key)) norm from (
            select key, bucket, count(token) n from (
              select key, token, (('0x'||md5(token)[1:7])::int % 64)::bigint bucket from (
                select doc_id key, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) token from documents
                where doc_id not in (select vec_id from embeddings)) where token <> ''
              union all select doc_id, null, unnest(range(64)) from documents where doc_id not in (select vec_id from embeddings))
            group by 1, 2)) where norm > 0 group by key"""),
    "b_events": (["b_hashed"], f"""
        select cast(d.doc_id as varchar) id, d.source,
          case when d.doc_id%7=0 then {_NONE}
               else [upper(d.lang), 'T'||cast(d.doc_id%10 as varchar)] end tickers,
          substr(d.text,1,60) title, p.url content_url, d.text raw_text, e.ts published_at,
          e.ts + interval 1 minute ingested_at, coalesce(m.embedding, h.vector) vector, d.doc_id seq
        from documents d join events e on e.event_id=d.doc_id
        left join pages p on p.page_id=d.doc_id left join embeddings m on m.vec_id=d.doc_id left join b_hashed h on h.key=d.doc_id"""),
    "b_enriched": (["b_events"], """
        select * from b_events where vector is not null and octet_length(encode(raw_text)) >= 50"""),
    "b_repeats": (["b_events"], """
        select id, source, tickers, title, published_at, ingested_at, seq from b_events
        union all select id, source, tickers, 'again: '||title, published_at,
          ingested_at + interval 1 day, seq from b_events where seq%6=0"""),
    "b_outcomes": (["b_events"], """
        select *, case when outcome='error' then 4 when outcome='enriched' then seq%3 else 0 end failed_calls
        from (select *, case when seq%17=3 then 'skipped_fetch'
            when octet_length(encode(raw_text)) < 50 then 'skipped_short'
            when vector is null or seq%11=5 then 'error' else 'enriched' end outcome from b_events)"""),
    "b_users": ([], """
        select cast(c_custkey as varchar) id, lower(replace(c_name,'#','.'))||'@example.com' email,
          c_custkey seq from customer"""),
    "b_strategies": ([], f"""
        select cast(vec_id as varchar) id, cast(vec_id%20 as varchar) user_id,
          'strategy '||vec_id as name, 'watch '||vec_id description, b.text query,
          case vec_id%3 when 0 then {_NONE}
            when 1 then ['src0','src1','src2','src3','src4','src5','src6','src7','src8','src9']
            else ['src'||(vec_id%20)] end source,
          case vec_id%4 when 0 then ['EN','DE'] when 1 then ['T1','T2','T3'] else {_NONE} end tickers,
          cast([0.0,0.1,0.2,0.3][vec_id%4+1] as double) similarity_threshold,
          vec_id%5<>4 is_active, {_EPOCH} + to_minutes(vec_id) created_at,
          {_EPOCH} + to_minutes(vec_id) updated_at, embedding query_vector, vec_id seq
        from embeddings left join benchmark b on b.item_id = vec_id % (select count(*) from benchmark)"""),
    "b_active": (["b_strategies", "b_users"], """
        select s.*, u.email owner_email from b_strategies s join b_users u on u.id=s.user_id where s.is_active"""),
    "b_pairs": (["b_enriched", "b_active"], """
        select event_id, ingested_at, strategy_id, threshold, seq,
          round(case when isnan(c) then 0 else c end, 6) score
        from (select e.id event_id, e.ingested_at, s.id strategy_id, s.similarity_threshold threshold, e.seq,
                list_cosine_similarity(e.vector::double[], s.query_vector::double[]) c
              from b_enriched e join b_active s
                on (len(s.source)=0 or list_contains(s.source, e.source))
               and (len(s.tickers)=0 or list_has_any(s.tickers, e.tickers)))"""),
    "b_match": (["b_pairs"], """
        select a.*, (select 1 + count(*) from b_pairs b where b.strategy_id=a.strategy_id
            and b.score > a.score and (b.ingested_at, b.event_id) < (a.ingested_at, a.event_id)) as rank
        from b_pairs a where a.score >= a.threshold"""),
    "b_found": (["b_match"], "select * from b_match where rank <= 10"),
    "b_alerts": (["b_found", "b_active", "b_events"], f"""
        select {_uuid5("f.strategy_id||':'||f.event_id")} id, s.user_id, f.strategy_id, f.event_id,
          e.title, s.description as content, coalesce(e.content_url,'') url, f.score similarity_score,
          false is_read, f.ingested_at created_at, e.source event_source, s.owner_email recipient,
          s.similarity_threshold
        from b_found f join b_active s on s.id=f.strategy_id join b_events e on e.id=f.event_id"""),
    "b_hits": (["b_pairs"], f"""
        select * from (select strategy_id, event_id, {_uuid5("event_id")} point_id, score, threshold,
            row_number() over (partition by strategy_id order by score desc, {_uuid5("event_id")}) rank
          from b_pairs) where rank <= 10"""),
    "b_texts": ([], r"""
        select url, array_to_string(list_filter(list_transform(string_split(t, chr(10)),
            lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) as text
        from (select url, replace(replace(replace(replace(regexp_replace(regexp_replace(
            regexp_extract(html, '<article>(.*)</article>', 1, 's'),
            '</?(p|br|div|li|h1|h2|h3|h4|h5|h6)( [^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g'),
            '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') as t from pages)"""),
    "b_filings": ([], """
        select cast(o_orderkey as varchar) guid, '8-K - '||c_name||case
            when o_orderkey%13=0 then ''
            when o_orderkey%11=0 then ' (DE) ('||o_custkey||') (Filer)'
            when o_orderkey%10=0 then ' ('||lpad(cast(o_custkey as varchar),10,'0')||') (Filer)'
            else ' ('||o_custkey||') (Filer)' end title,
          'https://filings.example/'||o_orderkey link, cast(o_orderdate as timestamp) published
        from orders join customer on c_custkey=o_custkey"""),
    "b_companies": ([], """
        select cik, min(ticker) ticker from (
          select cast(c_custkey as varchar) cik, 'C'||c_custkey ticker from customer where c_custkey%4<>0
          union all select cast(c_custkey as varchar), 'D'||c_custkey from customer where c_custkey%9=0)
        group by cik"""),
    "b_filed": (["b_filings", "b_companies"], """
        select f.*, coalesce(c.ticker, '') tickers from b_filings f left join b_companies c
          on c.cik = nullif(regexp_extract(f.title, '\\(([^)]+)\\)', 1), '')"""),
    "b_key_requests": ([], f"""
        with k as (select cast(c_custkey as varchar) user_id, case c_custkey%3 when 0 then 'polygon'
            when 1 then 'openai' else 'other' end provider, 'key '||c_custkey encrypted_key,
            {_EPOCH} + to_minutes(c_custkey) created_at, c_custkey seq from customer)
        select * from k union all
        select user_id, provider, 'new '||encrypted_key, created_at + interval 1 day, seq from k where seq%4=0"""),
    "b_keys": ([], f"""
        select cast(c_custkey as varchar) user_id, case c_custkey%2 when 0 then 'polygon' else 'openai' end provider,
          'old '||c_custkey encrypted_key, {_EPOCH} - interval 1 day created_at from customer"""),
    "b_keys_after": (["b_keys", "b_key_requests"], """
        select user_id, provider, arg_max(encrypted_key, created_at) encrypted_key, max(created_at) created_at
        from (select * from b_keys union all select user_id, provider, encrypted_key, created_at
              from b_key_requests where provider in ('polygon','openai') and encrypted_key<>'')
        group by user_id, provider"""),
    "b_user_requests": (["b_users"], """
        select email, seq from b_users union all select email, seq + 1000000000 from b_users where seq%8=0"""),
}
def _needed(names: list[str], done: list[str]) -> list[str]:
    for name in names:
        if name not in done:
            _needed(_BINDINGS[name][0], done)
            done.append(name)
    return done


def sql(name: str, reads: str, body: str) -> None:
    order = _needed(reads.split(), [])
    views = ",\n".join(f"{n} as materialized ({_BINDINGS[n][1]})" for n in order)
    body = body.strip()
    if order and body.startswith("with "):
        body = ", " + body[len("with "):]
    ORACLE[name] = f"with {views}\n{body}" if order else body


_EVENT_FILTER_S = "(len(s.source)=0 or list_contains(s.source, e.source))"
_EVENT_FILTER_T = "(len(s.tickers)=0 or list_has_any(s.tickers, e.tickers))"

# -- sources
sql("ingest_news", "b_events", f"""
select id, 'Polygon.io' as source, {_csv('tickers')} tickers, title, content_url, {_time('published_at')} published_at,
  {_time('ingested_at')} ingested_at from b_events""")
sql("ingest_filings", "b_filed", f"""
select guid id, 'SEC EDGAR' as source, tickers, title, link content_url, {_time('published')} published_at,
  {_time('published + interval 1 minute')} ingested_at from b_filed""")
sql("company_tickers", "b_companies", "select cik, ticker from b_companies")
sql("filing_tickers", "b_filed", "select guid id, tickers from b_filed")
sql("filing_tickers_tolerant", "b_filings b_companies", """
select f.guid id, coalesce(c.ticker,'') tickers from b_filings f left join b_companies c
  on c.cik = cast(try_cast(nullif(regexp_extract(f.title, '\\(([0-9]+)\\)', 1), '') as bigint) as varchar)""")
_FAN_IN = """select id, 'Polygon.io' as source, title, published_at from b_events
union all select guid, 'SEC EDGAR', title, published from b_filings"""
sql("fan_in", "b_events b_filings", f"select id, source, title, {_time('published_at')} published_at from ({_FAN_IN})")
sql("ingest_counts", "b_events b_filings", f"""
select source, strftime(published_at, '%Y-%m') poll, count(*) as events from ({_FAN_IN}) group by 1, 2""")
sql("dedupe_events", "b_repeats", f"""
select id, title, {_time('ingested_at')} ingested_at from b_repeats
qualify row_number() over (partition by id order by ingested_at, title) = 1""")
_FEEDS = """snapshot as (
  select 'news' as source, cast(event_id as varchar) id, (select max(event_id) from events) - event_id pos from events
  union all select 'filings', cast(o_orderkey as varchar), (select max(o_orderkey) from orders) - o_orderkey from orders),
cursors as (
  select 'news' as source, cast(max(event_id) - cast(floor(count(*)*0.3) as bigint) as varchar) last_id from events
  union all select 'filings', 'gone')"""
sql("new_since_cursor", "", f"""with {_FEEDS},
marks as (select s.source, min(s.pos) mark from snapshot s join cursors c on c.source=s.source and c.last_id=s.id group by 1)
select s.source, s.id, -s.pos as emit_order from snapshot s left join marks m on m.source=s.source
where m.mark is null or s.pos < m.mark""")
sql("next_cursors", "", f"with {_FEEDS} select source, arg_min(id, pos) last_id from snapshot group by source")
sql("import_strategies", "b_strategies", f"""
with r as (select *, case when seq%10=0 then 'bad_json' when seq%11=0 then 'missing_field' else 'ok' end status from b_strategies)
select id request_id, status, case when status='ok' then {_uuid5("user_id||':'||id")} end id, user_id,
  case when status='ok' then name end as name, case when status='ok' then query end query,
  case when status='ok' then {_csv('source')} end as source, case when status='ok' then {_csv('tickers')} end tickers,
  case when status='ok' then similarity_threshold end similarity_threshold,
  case when status='ok' then seq%3<>0 and is_active end is_active,
  case when status='ok' then {_time(_NOW)} end created_at from r""")

# -- filters and joins
sql("active_strategies", "b_active", f"""
select id, user_id, owner_email, name, query, {_csv('source')} as source, {_csv('tickers')} tickers, similarity_threshold from b_active""")
sql("filter_source", "b_events b_active", f"""
select s.id strategy_id, count(*) as events from b_events e join b_active s on {_EVENT_FILTER_S} group by 1""")
sql("filter_tickers", "b_events b_active", f"""
select s.id strategy_id, count(*) as events from b_events e join b_active s on {_EVENT_FILTER_T} group by 1""")
for _name in ("prefilter_match", "prefilter_match_equi"):
    sql(_name, "b_events b_active", f"""
select e.id event_id, s.id strategy_id from b_events e join b_active s on {_EVENT_FILTER_S} and {_EVENT_FILTER_T}""")
sql("strategies_checked", "b_events b_active", """
select e.id event_id, (select count(*) from b_active) as strategies from b_events e""")
sql("strategies_passed", "b_events b_active", f"""
select e.id event_id, count(*) strategies from b_events e join b_active s
on {_EVENT_FILTER_S} and {_EVENT_FILTER_T} group by 1""")
sql("min_text_filter", "", """
select doc_id, octet_length(encode(text)) n_bytes from documents where octet_length(encode(text)) >= 50""")
sql("owner_scoped_read", "b_strategies", "select id, user_id, name from b_strategies where seq%2=0")
sql("content_join", "b_events", """
select e.id, e.content_url, p.url is not null fetched, octet_length(encode(p.html)) html_bytes
from b_events e left join pages p on p.url=e.content_url""")

# -- vectors
sql("point_ids", "", f"select doc_id, {_uuid5('cast(doc_id as varchar)')} point_id from documents")
sql("point_payload", "b_events", f"""
select id, source, title, content_url, {_time('published_at')} published_at,
  case when len(tickers)>0 then {_csv('tickers')} end tickers from b_events""")
sql("corpus_stats", "b_enriched", """
select count(*) points, cast(min(len(vector)) as bigint) min_dim, cast(max(len(vector)) as bigint) max_dim, 'Cosine' as metric from b_enriched""")
sql("vector_schema_guard", "b_events", """
select id, case when vector is null or seq%17=3 then 'missing' when seq%13=0 then 'wrong_dim' else 'ok' end vector_status from b_events""")
sql("upsert_points", "b_repeats", f"""
select {_uuid5('id')} point_id, id event_id, title, case when len(tickers)>0 then {_csv('tickers')} end tickers,
  {_time('ingested_at')} as version from (
    select *, 1 as written from b_repeats where cast(id as bigint) % 10 <> 4
    union all by name
    select * replace ('stored before' as title, ingested_at + case when seq % 8 = 0 then interval 9 days else interval 0 days end as ingested_at),
      0 as written from b_repeats where seq % 2 = 0 and title not like 'again: %')
qualify row_number() over (partition by id order by written desc, ingested_at desc) = 1""")
sql("cosine_scores", "b_pairs", "select event_id, strategy_id, score from b_pairs")
_TERMS = """
t as (select key, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) token from texts),
c as (select key, (('0x'||md5(token)[1:7])::int % 256)::bigint bucket, count(*) n from t where token<>'' group by 1, 2),
n as (select key, sqrt(sum(n*n)::double) norm from c group by 1)"""
sql("embed_text", "", f"""
with texts as (select doc_id key, text from documents), {_TERMS}
select key doc_id, bucket, round(n / norm, 9) weight from c join n using (key)""")
sql("pipeline_alerts", "b_events b_active", f"""
with texts as (select 'd'||doc_id as key, text from documents union all select 'q'||item_id, text from benchmark), {_TERMS},
w as (select key, bucket, cast(cast(n / norm as float) as double) as weight from c join n using (key)),
lengths as (select key, sqrt(sum(weight * weight)) as length from w group by 1),
readable as (
  select cast(doc_id as varchar) as id, array_to_string(list_filter(list_transform(string_split(text, chr(10)),
    lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) as text from documents),
dots as (
  select d.key as doc, q.key as item, sum(d.weight * q.weight) as product from w d join w q on d.bucket = q.bucket
  where d.key like 'd%' and q.key like 'q%' group by 1, 2),
pairs as (
  select s.id as strategy_id, e.id as event_id, s.similarity_threshold as threshold,
    round(coalesce(product / (x.length * y.length), 0), 6) as score
  from b_events e join b_active s on {_EVENT_FILTER_S} and {_EVENT_FILTER_T}
  join readable r on r.id = e.id and octet_length(encode(r.text)) >= 50
  join lengths x on x.key = 'd'||e.id
  join benchmark b on b.text = s.query and b.item_id = s.seq % (select count(*) from benchmark)
  join lengths y on y.key = 'q'||b.item_id
  left join dots on doc = x.key and item = y.key)
select strategy_id, event_id, score, rank from (
  select *, row_number() over (partition by strategy_id order by score desc, {_uuid5('event_id')}) rank from pairs)
where rank <= 10 and score >= threshold""")
sql("embed_queries", "b_strategies", f"""
with texts as (select distinct query key, query text from b_strategies), {_TERMS}
select s.id, bucket, round(cast(cast(n / norm as float) as double), 5) weight
from c join n using (key) join b_strategies s on s.query=key""")
for _name in ("vector_search", "vector_search_large_registry"):
    sql(_name, "b_hits", "select strategy_id, point_id, score, rank from b_hits")

# -- matches and alerts
for _name in ("match_alerts", "match_alerts_large_registry", "stream_match_alerts"):
    sql(_name, "b_found", "select strategy_id, event_id, score, rank from b_found")
sql("stream_registry_changes", "b_found b_events b_strategies", """
with seen as (select * from b_events where vector is not null and octet_length(encode(raw_text)) >= 50),
m as (select make_timestamp((epoch_us(min(ingested_at)) + epoch_us(max(ingested_at))) // 2) as middle from seen)
select f.strategy_id, f.event_id, f.score, f.rank
from b_found f join seen e on e.id = f.event_id join b_strategies s on s.id = f.strategy_id, m
where e.ingested_at < middle or not (s.seq % 10 = 1 or s.seq % 10 = 2 and f.score < 0.5)""")
sql("match_alerts_single_precision", "b_pairs", """
with p as (select *, case when strategy_id::bigint % 3 = 0 then 1.0::double else 0.1::double end as least from b_pairs)
select * from (
  select strategy_id, event_id, score, (select 1 + count(*) from p b where b.strategy_id = a.strategy_id
    and b.score > a.score and (b.ingested_at, b.event_id) < (a.ingested_at, a.event_id)) as rank
  from p a where cast(cast(score as float) as double) >= least) where rank <= 10""")
sql("match_alerts_final", "b_hits", "select strategy_id, event_id, score, rank from b_hits where score >= threshold")
_ALERT = f"""id, user_id, strategy_id, event_id, title, content, url, similarity_score, is_read,
  {_time('created_at')} created_at"""
for _name in ("alert_rows", "stream_event_job"):
    sql(_name, "b_alerts", f"select {_ALERT} from b_alerts")
sql("alert_log", "b_alerts", """
select '{"time":"'||strftime(created_at, '%Y-%m-%dT%H:%M:%SZ')||'","level":"INFO","msg":"alert triggered","strategy_id":'||to_json(strategy_id)||',"recipient":'||to_json(recipient)
  ||',"event_title":'||to_json(title)||',"event_source":'||to_json(event_source)
  ||',"similarity_score":"'||cast(cast(cast(similarity_score as decimal(18,6)) as decimal(18,4)) as varchar)
  ||'","threshold":"'||cast(cast(similarity_threshold as decimal(18,2)) as varchar)||'"}' as value from b_alerts""")
sql("user_alert_feed", "b_alerts", f"""
select user_id, seq, '{{"id":'||to_json(id)||',"user_id":'||to_json(user_id)||',"strategy_id":'||to_json(strategy_id)
  ||',"event_id":'||to_json(event_id)||',"title":'||to_json(title)||',"content":'||to_json(content)||',"url":'||to_json(url)
  ||',"similarity_score":'||cast(cast(similarity_score as decimal(18,6)) as varchar)||',"is_read":false,"created_at":"'||{_time('created_at')}||'"}}' payload
from (select *, row_number() over (partition by user_id order by created_at, id) seq from b_alerts) where seq <= 64""")
sql("user_alerts_page", "b_alerts", f"""
select id, user_id, {_time('created_at')} created_at from (
  select * from b_alerts where user_id='3' order by created_at desc, id limit 50 offset 20)""")
sql("alert_pages", "b_alerts", """
select id, user_id, row_number() over (partition by user_id order by created_at desc, id) as position
from b_alerts qualify position <= 50""")
sql("alert_badges", "b_alerts", """
select id, 'Match: '||cast(floor(similarity_score*100+0.5) as bigint)||'%' label,
  case when similarity_score > 0.8 then 'red' else 'orange' end colour, not is_read unread from b_alerts""")
sql("strategy_cards", "b_strategies", """
select id, case when is_active then 'Active' else 'Paused' end state, case when is_active then 'Pause' else 'Resume' end as action,
  case when len(source)>0 then array_to_string(source, ', ') else 'All' end sources_label,
  case when len(tickers)>0 then array_to_string(tickers, ', ') else 'All' end tickers_label from b_strategies""")
sql("event_counters", "b_outcomes b_found", """
select count(*) events_ingested, count(*) filter (outcome<>'error') events_processed,
  count(*) filter (outcome='enriched') events_enriched, (select count(*) from b_found) alerts_triggered,
  count(*) filter (outcome='error') errors_total, cast(sum(failed_calls) as bigint) retry_attempts from b_outcomes""")

# -- enrichment
sql("enrichment_outcomes", "b_outcomes", "select id, outcome, cast(failed_calls as bigint) failed_calls from b_outcomes")
sql("retry_schedule", "b_outcomes", """
with f as (select id, cast(seq%4+1 as bigint) attempts from b_outcomes where outcome='error'),
d as (select *, attempts > 3 exhausted, least(500.0*pow(2.0, attempts-1), 10000.0)::double delay from f)
select id, attempts, exhausted, case when not exhausted then delay*0.5 end min_delay_ms,
  case when not exhausted then delay end max_delay_ms, case when not exhausted then cast(delay*1000 as bigint) end wait_micros from d""")
sql("extract_text", "b_texts", "select url, text from b_texts")
sql("enrich_events", "b_events b_texts", """
select id, outcome, case when outcome='enriched' then cast(256 as bigint) end dims from (
  select e.id, case when t.url is null then 'skipped_fetch' when octet_length(encode(t.text)) < 50 then 'skipped_short'
    when not regexp_matches(lower(t.text), '[a-z0-9]') then 'error' else 'enriched' end outcome
  from b_events e left join b_texts t on t.url=e.content_url)""")
sql("parse_tickers", "", """
select doc_id, array_to_string(list_filter(list_transform(string_split(lang||' ,'||'t'||(doc_id%10)||' ,'||' '||' ,'||source, ','),
  lambda x: upper(trim(x))), lambda x: x<>''), '|') tickers from documents""")

# -- table maintenance
sql("user_strategies", "b_strategies", f"select id, name, {_time('created_at')} created_at from b_strategies where user_id='3'")
sql("toggle_strategies", "b_strategies", f"""
select id, case when seq%7=0 and seq%21<>0 then not is_active else is_active end is_active,
  {_time(f'case when seq%7=0 then {_NOW} else updated_at end')} updated_at from b_strategies""")
sql("update_strategies", "b_strategies", f"""
with u as (select *, seq%4=0 and seq%3<>0 hit from b_strategies)
select id, case when hit and seq%8=0 then 'renamed again '||seq when hit then 'renamed '||seq else name end as name,
  case when hit then 0.75::double else similarity_threshold end similarity_threshold,
  case when hit and seq%8=0 then not is_active else is_active end is_active,
  {_time(f'case when hit then {_NOW} else updated_at end')} updated_at from u""")
_ASKED = "event_id::bigint%5=0"
sql("mark_alerts_read", "b_alerts", f"select id, user_id, {_ASKED} and event_id::bigint%2=0 is_read from b_alerts")
sql("mark_alerts_not_found", "b_alerts", f"select id, 'stranger' user_id from b_alerts where {_ASKED} and event_id::bigint%2<>0")
sql("delete_strategies", "b_strategies", "select id, user_id from b_strategies where seq%9<>0")
sql("delete_strategies_alerts", "b_alerts", """
select id, case when strategy_id::bigint%9<>0 then strategy_id end strategy_id from b_alerts""")
sql("cascade_delete_users", "b_users b_keys b_strategies b_alerts", f"""
select 'users' kept_in, id from b_users where seq%6<>0
union all select 'api_keys', {_uuid5("user_id||':'||provider")} from b_keys where user_id::bigint%6<>0
union all select 'strategies', id from b_strategies where user_id::bigint%6<>0
union all select 'alerts', id from b_alerts where user_id::bigint%6<>0""")
sql("upsert_api_keys", "b_keys_after", f"""
select {_uuid5("user_id||':'||provider")} id, user_id, provider, encrypted_key, {_time('created_at')} created_at from b_keys_after""")
sql("delete_api_keys", "b_keys", f"""
select {_uuid5("user_id||':'||provider")} id, user_id, provider from b_keys k
where not (user_id::bigint%3=0 and provider='polygon')""")
sql("key_status", "b_users b_keys_after", """
select u.id user_id, p.provider, k.user_id is not null has_key
from b_users u cross join (values ('polygon'), ('openai')) p(provider)
left join b_keys_after k on k.user_id=u.id and k.provider=p.provider""")
sql("register_users", "b_user_requests b_users", """
select r.email, r.seq, case when r.email not in (select email from b_users where seq%5=0)
  and r.seq = min(r.seq) over (partition by r.email) then 'inserted' else 'rejected' end status from b_user_requests r""")
sql("unique_violations", "b_user_requests", "select email, count(*) as rows from b_user_requests group by 1 having count(*)>1")
sql("encrypt_column", "b_key_requests", """
select user_id, provider, encrypted_key, cast(12 + octet_length(encode(encrypted_key)) + 16 as bigint) sealed_bytes
from b_key_requests""")
sql("decrypt_column", "b_key_requests", f"""
select user_id, {_time('created_at')} created_at,
  case when seq%7<>0 and seq%11<>0 then encrypted_key end opened, seq%7=0 or seq%11=0 rejected from b_key_requests""")

# -- streams
sql("stream_dedupe_events", "b_events", "select id, source from b_events")
sql("stream_retry_outcomes", "b_events", """
with steps as (
  select id, floor(seq * 3 / ((select max(seq) from b_events) + 1)) as step,
    case when octet_length(encode(raw_text)) < 50 then 'skipped_short' when seq % 5 = 0 then 'error' else 'enriched' end as outcome
  from b_events)
select id, outcome, cast(0 as bigint) as attempts from steps
union all select id, 'enriched', 1 from steps where outcome = 'error' and step < 2
union all select id, 'waiting', 1 from steps where outcome = 'error' and step = 2""")
sql("stream_cursor_polls", "", """
with m as (select max(event_id) - cast(floor(count(*) * 0.3) as bigint) as mark from events)
select 'news' as source, cast(0 as bigint) as poll, cast(event_id as varchar) as id, 1 - row_number() over (order by event_id desc) as emit_order,
  false as discarded from events, m where event_id <= mark
union all select 'news', 1, null, null, true
union all select 'news', 2, cast(event_id as varchar), 1 - row_number() over (order by event_id desc), false from events, m where event_id > mark
union all select 'filings', 0, 'gone', 0, false
union all select 'filings', 1, cast(o_orderkey as varchar), 1 - row_number() over (order by o_orderkey desc), false from orders""")
sql("stream_retry_timers", "", """
select cast(doc_id as varchar) as id, case when doc_id % 6 < 4 then 'done' else 'exhausted' end as outcome,
  cast(least(doc_id % 6 + 1, 4) as bigint) as tries, case when doc_id % 6 < 4 then 'value ' || doc_id end as value from documents""")
sql("stream_live_feed", "b_alerts", """
with a as (select user_id, id, created_at, cast(floor(event_id::bigint * 3 / ((select max(doc_id) from documents) + 1)) as int) as step from b_alerts),
r as (select *, row_number() over (partition by user_id, step order by created_at, id) as rn from a),
n as (select user_id, count(*) filter (step = 0) n0, count(*) filter (step = 1) n1, count(*) filter (step = 2) n2 from a group by 1),
p as (select *, least(64, n0) as p0, least(user_id::bigint % 5 * 10, least(64, n0)) as d0 from n),
q as (select *, least(n1, 64 - (p0 - d0)) as in1 from p),
s as (select *, least(40, p0 - d0 + in1) as d1 from q),
u as (select *, least(n2, 64 - (p0 - d0 + in1 - d1)) as in2 from s),
v as (select r.*, u.*, case step when 0 then p0 when 1 then in1 else in2 end as room,
  case step when 0 then 0 when 1 then p0 else p0 + in1 end as before,
  case step when 0 then 0 when 1 then n0 - p0 else n0 - p0 + n1 - in1 end as lost from r join u using (user_id))
select user_id, id, case when rn > room then 'dropped' else 'delivered' end as status,
  case when rn > room then lost + rn - room else before + rn end as seq
from v where rn > room or before + rn <= d0 + d1""")

# -- classes, cells, logs of parts, change feeds
ORACLE["prefilter_match_classes"] = ORACLE["prefilter_match"]
ORACLE["strategies_passed_classes"] = ORACLE["strategies_passed"]
ORACLE["vector_search_cells"] = ORACLE["vector_search"]
ORACLE["user_alerts_page_skipping"] = ORACLE["user_alerts_page"]
ORACLE["stream_counters_replayed"] = ORACLE["event_counters"]
sql("corpus_versions", "b_events", f"""
with writes as (
  select seq, w.batch, w.title from b_events, (values (0, 'stored before'), (1, 'first'), (2, 'again'), (3, 'late')) w(batch, title)
  where (batch = 0 and seq % 2 = 0) or (batch = 1 and seq % 3 <> 1) or (batch = 2 and seq % 6 = 0) or (batch = 3 and seq % 10 = 4)),
views(version, last) as (values (1, 0), (2, 1), (3, 2), (4, 2), (5, 3))
select cast(version as bigint) as version, {_uuid5("cast(seq as varchar)")} as point_id, cast(seq as varchar) as event_id, arg_max(title, batch) as title
from views join writes on batch <= last group by version, seq""")
_STEPS = f"""s0 as (select id, user_id, name, similarity_threshold, is_active, updated_at, seq from b_strategies),
s1 as (select * replace (case when seq%7=0 then not is_active else is_active end as is_active,
  case when seq%7=0 then {_NOW} else updated_at end as updated_at) from s0),
s2 as (select * replace (case when seq%4=0 and seq%3<>0 then 'renamed '||seq else name end as name,
  case when seq%4=0 and seq%3<>0 then 0.75::double else similarity_threshold end as similarity_threshold,
  case when seq%4=0 and seq%3<>0 then {_NOW} else updated_at end as updated_at) from s1)"""
_FIELDS = ["name", "similarity_threshold", "is_active", "updated_at"]
sql("strategy_change_feed", "b_strategies", f"with {_STEPS} " + " union all ".join(
    f"select a.id as key, cast({version} as bigint) as version, 'update' as kind, '{name}' as field from s{version - 1} a join s{version} b using (id) where a.{name} is distinct from b.{name}"
    for version in (1, 2) for name in _FIELDS) + " union all select id, cast(3 as bigint), 'delete', '*' from s2 where seq%9=0")
_STATE = f"id, user_id, name, similarity_threshold, is_active, {_time('updated_at')} as updated_at"
sql("strategies_replayed", "b_strategies", f"""
with {_STEPS} select 'new' as state, {_STATE} from s2 where seq%9<>0 union all select 'old', {_STATE} from s0""")
