"""SQL twins of the queries, on the same tables. Where a rule is a pattern both sides have it, so markup and URLs
are also checked by known answers (`hard_markup`, tests).

Shared pieces are common table expressions put together as text. A query without an entry here
is checked by tests instead (stemming and highlighting have no SQL form).
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_PARTS = (r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?"
          r"((?:[^?#]*/)?[^?#;/]*)(?:;([^?#/]*))?(?:\?([^#]*))?(?:#(.*))?$")


def _part(url: str, i: int) -> str:
    return f"coalesce(regexp_extract({url}, '{_PARTS}', {i}), '')"


def canonical_sql(raw: str) -> str:
    """NULL for other schemes; assumes a host, which every http(s) URL of the given tables has."""
    url = rf"regexp_replace({raw}, '^\s+|\s+$', '', 'g')"
    scheme, host = f"lower({_part(url, 1)})", f"lower({_part(url, 2)})"
    path, params, query = _part(url, 3), _part(url, 4), _part(url, 5)
    port = (f"CASE WHEN {scheme} = 'http' THEN regexp_replace({host}, ':80$', '') "
            f"ELSE regexp_replace({host}, ':443$', '') END")
    return f"""CASE WHEN {scheme} IN ('http', 'https') THEN {scheme} || '://' || {port}
      || CASE WHEN {path} IN ('', '/') THEN '/' WHEN right({path}, 1) = '/' THEN left({path}, -1) ELSE {path} END
      || CASE WHEN {params} = '' THEN '' ELSE ';' || {params} END
      || CASE WHEN {query} = '' THEN ''
              ELSE '?' || array_to_string(list_sort(string_split({query}, '&')), '&') END END"""


# --- derived tables (the rules of fixtures.py) ---------------------------------------------------

_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
_CRAWLED = "TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id * 60)"

_URLS = rf"""urls AS (SELECT page_id, CASE page_id % 8
  WHEN 1 THEN regexp_extract(url, '^(https?://)', 1) || upper({_HOST})
       || CASE WHEN url LIKE 'https%' THEN ':443' ELSE ':80' END || regexp_replace(url, '^https?://[^/?#]+', '')
  WHEN 2 THEN '  ' || regexp_replace(regexp_replace(url, '#.*$', ''), '\?.*$', '') || '/ '
  WHEN 3 THEN regexp_replace(url, '^https?', 'ftp')
  WHEN 4 THEN regexp_replace(regexp_replace(url, '#.*$', ''), '\?.*$', '') || '?z=1&a=2&a=1&&b'
  WHEN 5 THEN regexp_replace(regexp_replace(url, '#.*$', ''), '\?.*$', '') || '/;p'
  WHEN 6 THEN regexp_replace(url, '^https?://', '')
  WHEN 7 THEN url || repeat('x', 2040) ELSE url END AS url FROM pages)"""

_EDGES = f"""p AS (SELECT page_id, url, {_HOST} AS host, {canonical_sql('url')} AS canonical FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS hr,
             count(*) OVER (PARTITION BY host) AS hn, count(*) OVER () AS n FROM p),
fx AS (SELECT a.page_id, a.url AS source_url, a.host, 1 AS pos, b.url AS href, b.canonical, b.host AS to_host
         FROM r a JOIN r b ON a.host = b.host AND b.hr = a.hr % a.hn + 1
  UNION ALL SELECT a.page_id, a.url, a.host, 2, b.url, b.canonical, b.host
         FROM r a JOIN r b ON a.host = b.host AND b.hr = (a.hr * 3) % a.hn + 1
  UNION ALL SELECT a.page_id, a.url, a.host, 3, b.url, b.canonical, b.host
         FROM r a JOIN r b ON b.page_id = (a.page_id * 7 + 13) % a.n
  UNION ALL SELECT a.page_id, a.url, a.host, 4, b.url, b.canonical, b.host
         FROM r a JOIN r b ON b.page_id = (a.page_id * 11 + 5) % a.n),
firsts AS (SELECT *, CASE WHEN host = to_host THEN 'internal' ELSE 'external' END AS category FROM fx
  QUALIFY row_number() OVER (PARTITION BY page_id, canonical ORDER BY pos) = 1),
edges AS (SELECT *, sha256(canonical) AS url_hash, 'link ' || pos AS anchor_text,
  CAST(row_number() OVER (PARTITION BY page_id, category ORDER BY pos) AS INTEGER) AS rank FROM firsts)"""

_RESPONSES = """responses AS (SELECT url, page_id,
  CASE page_id % 20 WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 2 THEN 403 WHEN 3 THEN 429 WHEN 4 THEN 405
       WHEN 5 THEN NULL WHEN 6 THEN NULL WHEN 7 THEN NULL WHEN 8 THEN NULL ELSE 200 END AS head_status,
  CASE page_id % 20 WHEN 4 THEN CASE WHEN page_id % 40 = 4 THEN 200 ELSE 410 END END AS get_status,
  CASE page_id % 20 WHEN 5 THEN 'dial tcp: i/o timeout' WHEN 6 THEN 'dial tcp: lookup h: no such host'
       WHEN 7 THEN 'tls: failed to verify certificate: x509: unknown authority'
       WHEN 8 THEN 'connect: connection refused' END AS net_error FROM pages)"""


def _checked_sql(policy: str = "lenient") -> str:
    blocked = "AND status_code NOT IN (403, 429)" if policy == "lenient" else ""
    dns = ("net_error LIKE '%no such host%' OR net_error LIKE '%DNS%' OR net_error LIKE '%lookup%'"
           if policy == "lenient" else
           "net_error LIKE '%Name or service not known%' OR net_error LIKE '%getaddrinfo failed%'")
    certificate = ("WHEN net_error LIKE '%certificate%' OR net_error LIKE '%tls%' OR net_error LIKE '%x509%' THEN 'SSL_ERROR'"
                   if policy == "lenient" else "")
    message = "net_error" if policy == "lenient" else "CASE WHEN kind = 'TIMEOUT' THEN 'Request timeout' ELSE net_error END"
    return f"""{_RESPONSES},
effective AS (SELECT *, CASE WHEN head_status = 405 THEN get_status ELSE head_status END AS status_code,
  CASE WHEN net_error IS NULL THEN NULL
       WHEN net_error LIKE '%timeout%' OR net_error LIKE '%deadline exceeded%' THEN 'TIMEOUT'
       WHEN {dns} THEN 'DNS_ERROR'
       {certificate}
       ELSE 'CONNECTION_ERROR' END AS kind FROM responses),
checked AS (SELECT url, page_id, status_code,
  CASE WHEN status_code IS NULL THEN FALSE ELSE NOT (status_code >= 400 {blocked}) END AS is_valid,
  CASE WHEN status_code IS NULL THEN kind WHEN status_code >= 400 {blocked} THEN 'HTTP_ERROR' END AS error_type,
  CASE WHEN status_code IS NULL THEN {message}
       WHEN status_code >= 400 {blocked} THEN 'HTTP ' || status_code END AS error_message FROM effective)"""


_OUTCOMES = f"""{_EDGES}, {_checked_sql()},
outcomes AS (SELECT p.canonical, arg_min(struct_pack(s := c.status_code, v := c.is_valid, t := c.error_type,
                    m := c.error_message), p.url) AS o FROM checked c JOIN p ON p.page_id = c.page_id GROUP BY 1),
links AS (SELECT e.*, o.s AS status_code, o.v AS is_valid, o.t AS error_type, o.m AS error_message
          FROM edges e LEFT JOIN outcomes USING (canonical))"""

_BROKEN = f"""{_OUTCOMES},
broken AS (SELECT host AS job_id, source_url, canonical AS broken_url, anchor_text, status_code, error_type,
  error_message, 0 AS depth, {_CRAWLED} AS discovered_at FROM links WHERE category = 'external' AND NOT is_valid)"""

_JOB_PAGES = f"""job_pages AS (SELECT host AS job_id, page_id, url, canonical, 4 AS links_count,
  page_id % 20 BETWEEN 5 AND 8 AS failed, {_CRAWLED} AS crawled_at,
  CASE WHEN page_id % 20 BETWEEN 5 AND 8 THEN NULL WHEN page_id % 20 = 0 THEN 404 WHEN page_id % 20 = 1 THEN 500
       WHEN page_id % 20 = 2 THEN 403 WHEN page_id % 20 = 3 THEN 429
       WHEN page_id % 20 = 4 AND page_id % 40 != 4 THEN 410 ELSE 200 END AS status_code FROM p)"""

_ONE_JOB = f"(SELECT {_HOST} FROM pages GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"

_ROBOT_HOSTS = f"""robot_hosts AS (SELECT {_HOST} AS host, min(page_id) % 5 AS k, min(page_id) AS first
  FROM pages GROUP BY 1)"""


def _denied_sql(path: str) -> str:
    return (f"CASE k WHEN 1 THEN {path} LIKE '/fr/%' WHEN 2 THEN {path} LIKE '/en/%' "
            f"WHEN 3 THEN ({path} LIKE '/de%' AND {path} NOT LIKE '/de/%') OR {path} LIKE '/es/%' ELSE FALSE END")


_PATH = "regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"

# --- sources and sinks ------------------------------------------------------------------------------

ORACLES["scan_pages"] = """SELECT page_id, url, CAST(length(html) AS INTEGER) AS html_chars,
  CAST(NULL AS VARCHAR) AS error FROM pages"""

_MESSAGES = f"""{_EDGES}, messages AS (SELECT page_id, host AS job_id, source_url,
  list(canonical ORDER BY pos) AS target_urls FROM edges WHERE category = 'external' GROUP BY ALL)"""

ORACLES["link_job_messages"] = f"""WITH {_MESSAGES}
SELECT job_id AS key, CAST(to_json(struct_pack(job_id := job_id, source_url := source_url,
  target_urls := target_urls, depth := 1)) AS VARCHAR) AS value FROM messages"""

ORACLES["parse_link_jobs"] = f"""WITH {_MESSAGES}
SELECT job_id, source_url, 1 AS depth, CAST(generate_subscripts(target_urls, 1) AS INTEGER) AS pos,
  unnest(target_urls) AS target_url FROM messages WHERE page_id % 17 NOT IN (3, 5)"""

ORACLES["rejected_link_jobs"] = f"""WITH {_MESSAGES}
SELECT page_id FROM messages WHERE page_id % 17 IN (3, 5)"""

ORACLES["upsert_pages"] = f"""WITH u AS (SELECT page_id, sha256({canonical_sql('url')}) AS url_hash FROM pages),
rows AS (SELECT 'job' AS job_id, url_hash, page_id, 'stored' AS version, {_CRAWLED} AS crawled_at, 0 AS fresh FROM u
  UNION ALL SELECT 'job', url_hash, page_id, 'new', {_CRAWLED} + CASE WHEN page_id % 2 = 0
    THEN INTERVAL 1 HOUR ELSE -INTERVAL 1 HOUR END, 1 FROM u WHERE page_id % 3 != 1)
SELECT job_id, url_hash, page_id, version, crawled_at FROM rows
QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY crawled_at DESC, fresh DESC) = 1"""

ORACLES["append_broken_links"] = f"""WITH {_BROKEN}
SELECT sha256(job_id || chr(31) || source_url || chr(31) || broken_url) AS link_key, job_id, source_url,
  broken_url, anchor_text, status_code, error_type, error_message, depth
FROM broken WHERE error_type != 'TIMEOUT'"""

# --- URLs -----------------------------------------------------------------------------------------------

ORACLES["canonical_urls"] = f"""WITH {_URLS}, c AS (SELECT page_id, url, {canonical_sql('url')} AS canonical FROM urls)
SELECT *, CASE WHEN canonical IS NULL THEN 'scheme' END AS reason FROM c"""

ORACLES["dedupe_urls"] = f"""WITH c AS (SELECT page_id, url, {canonical_sql('url')} AS canonical FROM pages)
SELECT min(page_id) AS page_id, arg_min(url, page_id) AS url, canonical, sha256(canonical) AS url_hash,
  count(*) AS copies FROM c GROUP BY canonical"""

ORACLES["url_audit"] = rf"""WITH {_URLS}
SELECT CASE WHEN NOT regexp_matches(url, '^\s*https?:') THEN 'scheme'
            WHEN NOT regexp_matches(url, '^\s*https?://[^/?#]') THEN 'netloc'
            WHEN length(url) > 2048 THEN 'length' ELSE 'ok' END AS outcome, count(*) AS urls
FROM urls GROUP BY 1"""

ORACLES["strict_urls"] = rf"""WITH {_URLS}
SELECT page_id, url FROM urls WHERE regexp_matches(url, '(?i)^https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{{0,61}}[A-Z0-9])?\.)+[A-Z]{{2,6}}\.?|localhost|\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}})(?::\d+)?(?:/?|[/?]\S+)$')"""

ORACLES["pages_per_host"] = f"SELECT lower({_HOST}) AS host, count(*) AS pages FROM pages GROUP BY 1"

# --- pages -----------------------------------------------------------------------------------------------


def _decoded(e: str, bare: bool = True) -> str:
    """The references that occur in the given pages. In text they also count without ';' (titles are
    cut off in the middle). A decoded '&' is kept apart until the end, so nothing is decoded twice."""
    for name, char in (("amp", "\x01"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "),
                       ("copy", "©"), ("middot", "·")):
        e = f"replace({e}, '&{name};', '{char}')"
        if bare:
            e = f"replace({e}, '&{name}', '{char}')"
    return f"replace({e}, '\x01', '&')"


def _without(e: str, *tags: str) -> str:
    for t in tags:
        e = rf"regexp_replace({e}, '(?is)<{t}\b.*?</{t}\s*>', '', 'g')"
    return e


_TITLE = rf"trim(regexp_replace({_decoded(r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title', 1)")}, '\s+', ' ', 'g'))"
_PLAIN = rf"regexp_replace({_without('html', 'script', 'style')}, '(?s)<!--.*?-->', '', 'g')"
_BODY = _without(rf"regexp_replace({_PLAIN}, '(?is)^.*?<body\b[^>]*>', '')", "nav", "footer", "header")
_WHOLE_TEXT = (rf"trim(regexp_replace({_decoded(rf"regexp_replace({_BODY}, '<[A-Za-z/!?][^>]*>', '', 'g')")}, "
               rf"'\s+', ' ', 'g'))")
_TEXT = f"left({_WHOLE_TEXT}, 50000)"

_ANCHORS = rf"""tags AS (SELECT page_id, url, regexp_extract_all({_PLAIN}, '(?is)<a\s[^>]*>.*?</a') AS found FROM pages),
each AS (SELECT page_id, url, unnest(found) AS a, generate_subscripts(found, 1) AS pos FROM tags),
anchors AS (SELECT page_id, url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INTEGER) AS pos,
  {_decoded(r"regexp_extract(a, '(?is)\shref=.([^\x22\x27]*)', 1)", bare=False)} AS href,
  left(trim({_decoded(r"regexp_replace(regexp_extract(a, '(?is)^<a\s[^>]*>(.*)</a$', 1), '<[A-Za-z/!?][^>]*>', '', 'g')")}), 200) AS text,
  '' AS rel FROM each WHERE regexp_matches(a, '(?is)\shref=.[^\x22\x27]'))"""

ORACLES["page_titles"] = f"SELECT page_id, {_TITLE} AS title FROM pages"
ORACLES["page_text"] = f"SELECT page_id, {_TEXT} AS content FROM pages"
# what the engine has to make of the woven markup is known: `barmseen` and one more link
ORACLES["hard_markup"] = rf"""SELECT page_id, 'Real ' || page_id AS title, content, links_count, '/deep/er/' AS base_href,
  regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/deep/er/p' || page_id AS last_target
FROM (SELECT page_id, url, {_TEXT} AS content FROM (SELECT page_id, url, replace(html, '</body>', '') || 'barmseeng</body>' AS html FROM pages)) t
JOIN (WITH {_ANCHORS} SELECT p.page_id, CAST(count(a.page_id) + 1 AS INTEGER) AS links_count
  FROM pages p LEFT JOIN anchors a USING (page_id) GROUP BY 1) c USING (page_id)"""
ORACLES["page_anchors"] = f"WITH {_ANCHORS} SELECT page_id, url, pos, href, text, rel FROM anchors"
ORACLES["link_counts"] = f"""WITH {_ANCHORS}
SELECT p.page_id, CAST(count(a.page_id) AS INTEGER) AS links_count
FROM pages p LEFT JOIN anchors a USING (page_id) GROUP BY 1"""
ORACLES["page_records"] = f"""WITH {_ANCHORS}, counts AS (SELECT page_id, count(*) AS n FROM anchors GROUP BY 1),
c AS (SELECT *, {canonical_sql('url')} AS normalized_url FROM pages)
SELECT {_HOST} AS job_id, url, normalized_url, sha256(normalized_url) AS url_hash, {_TITLE} AS title,
  {_TEXT} AS content, 0 AS depth, CAST(NULL AS INTEGER) AS status_code, CAST(NULL AS VARCHAR) AS content_type,
  CAST(coalesce(n, 0) AS INTEGER) AS links_count, {_CRAWLED} AS crawled_at FROM c LEFT JOIN counts USING (page_id)"""

_DIR = r"CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '(?s)^(.*/)', 1) END"

ORACLES["resolved_links"] = rf"""WITH {_ANCHORS},
b AS (SELECT page_id, url AS base_url, pos, href, regexp_replace(href, '^/+', '') AS word,
  regexp_extract(url, '^(https?)', 1) AS scheme, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS site,
  {_PATH} AS path FROM anchors),
d AS (SELECT *, {_DIR} AS dir FROM b),
n AS (SELECT page_id, base_url, pos,
  CASE pos % 5 WHEN 1 THEN word WHEN 2 THEN '../' || word WHEN 3 THEN '//cdn.example.com/' || word
       WHEN 4 THEN '?q=' || word ELSE href END AS href,
  CASE pos % 5 WHEN 1 THEN site || dir || word
       WHEN 2 THEN site || CASE WHEN dir = '/' THEN '/' ELSE regexp_replace(dir, '[^/]+/$', '') END || word
       WHEN 3 THEN scheme || '://cdn.example.com/' || word
       WHEN 4 THEN site || path || '?q=' || word ELSE site || href END AS resolved FROM d)
SELECT * FROM n"""

ORACLES["same_site"] = f"""WITH {_EDGES}
SELECT page_id, source_url AS url, pos, href, host = to_host AS same_site FROM fx"""

# --- links ------------------------------------------------------------------------------------------------

_HTML_EDGES = f"""{_ANCHORS}, absolute AS (SELECT *, regexp_extract(url, '^(https?://[^/?#]+)', 1) || href AS target_url
  FROM anchors), html_edges AS (SELECT page_id, url AS source_url, pos, href, target_url,
  {canonical_sql('target_url')} AS canonical, text AS anchor_text, rel FROM absolute
  QUALIFY row_number() OVER (PARTITION BY page_id, canonical ORDER BY pos) = 1)"""

ORACLES["page_edges"] = f"""WITH {_HTML_EDGES}
SELECT page_id, source_url, pos, href, target_url, canonical, sha256(canonical) AS url_hash,
  'internal' AS category, anchor_text, rel FROM html_edges"""

ORACLES["linked_edges"] = f"""WITH {_EDGES}
SELECT page_id, source_url, pos, href, href AS target_url, canonical, url_hash, category, rank, anchor_text,
  '' AS rel FROM edges"""

ORACLES["link_categories"] = f"""WITH {_EDGES}
SELECT host, count(*) FILTER (category = 'internal') AS internal, count(*) FILTER (category = 'external') AS external,
  count(*) FILTER (category = 'invalid') AS invalid FROM edges GROUP BY host"""

ORACLES["filter_links"] = f"""WITH {_HTML_EDGES}
SELECT page_id, pos, canonical FROM html_edges
WHERE NOT contains(canonical, '.pdf') AND NOT contains(canonical, 'th')
  AND (contains(canonical, '/e') OR contains(canonical, '/o') OR contains(canonical, '/a'))
  AND len(list_filter(string_split({_part('canonical', 3)}, '/'), lambda s: s != '')) <= 2"""

ORACLES["cap_links"] = f"""WITH {_HTML_EDGES}, n AS (SELECT page_id, pos, canonical,
  CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INTEGER) AS rank FROM html_edges)
SELECT * FROM n WHERE rank <= 3"""

# --- crawl ------------------------------------------------------------------------------------------------


def _crawl_sql(robots: bool = False) -> str:
    deny = _denied_sql(_PATH) if robots else "FALSE"
    return f"""RECURSIVE {_EDGES}, {_ROBOT_HOSTS},
site AS (SELECT canonical, min(page_id) AS page_id FROM p GROUP BY 1),
state AS (SELECT s.canonical, s.page_id, s.page_id % 20 BETWEEN 5 AND 8 AS failed, {deny} AS denied
  FROM site s JOIN (SELECT page_id, canonical AS url, host FROM p) q ON q.page_id = s.page_id
  JOIN robot_hosts h ON h.host = q.host),
follow AS (SELECT s.canonical AS src, e.canonical AS dst, e.rank
  FROM state s JOIN edges e ON e.page_id = s.page_id
  WHERE e.category = 'internal' AND NOT s.failed AND NOT s.denied),
seeds AS (SELECT host AS job_id, arg_min(canonical, page_id) AS url FROM p GROUP BY 1),
walk AS (SELECT job_id, url, 0 AS depth, CAST([] AS INTEGER[]) AS ord, CAST(NULL AS VARCHAR) AS parent_url FROM seeds
  UNION ALL SELECT w.job_id, f.dst, w.depth + 1, list_append(w.ord, f.rank), w.url
  FROM walk w JOIN follow f ON f.src = w.url WHERE w.depth < 3),
tree AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY job_id, url ORDER BY depth, ord) = 1),
visits AS (SELECT t.*, CASE WHEN s.denied THEN 'robots_denied' WHEN s.failed THEN 'error' ELSE 'success' END AS outcome,
  coalesce(sum(CASE WHEN NOT s.denied AND NOT s.failed THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY t.depth, t.ord
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM tree t JOIN state s ON s.canonical = t.url)"""


def _attempts_sql(budget: int, robots: bool = False) -> str:
    """Every attempt in order: a page is tried once per link from a page that was crawled."""
    return f"""{_crawl_sql(robots)},
done AS (SELECT * FROM visits WHERE before < {budget}),
tries AS (SELECT job_id, url, 0 AS depth, CAST([] AS INTEGER[]) AS ord FROM seeds
  UNION ALL SELECT d.job_id, f.dst, d.depth + 1, list_append(d.ord, f.rank)
  FROM done d JOIN follow f ON f.src = d.url WHERE d.outcome = 'success' AND d.depth < 3),
placed AS (SELECT t.*, row_number() OVER (PARTITION BY t.job_id, t.url ORDER BY t.depth, t.ord) AS nth,
  (SELECT count(*) FROM done d WHERE d.job_id = t.job_id AND d.outcome = 'success'
     AND (d.depth < t.depth OR (d.depth = t.depth AND d.ord < t.ord))) AS before FROM tries t),
judged AS (SELECT t.job_id, CASE WHEN t.before >= {budget} THEN 'max_pages_reached'
  WHEN t.nth > 1 THEN 'already_visited' ELSE v.outcome END AS outcome
  FROM placed t JOIN visits v ON v.job_id = t.job_id AND v.url = t.url)
SELECT job_id, outcome, count(*) AS attempts FROM judged GROUP BY ALL"""


ORACLES["crawl_bfs"] = f"""WITH {_crawl_sql()}
SELECT job_id, url, depth, outcome, CASE WHEN outcome = 'success' THEN 4 ELSE 0 END AS links_count FROM visits"""
ORACLES["crawl_depths"] = f"WITH {_crawl_sql()} SELECT job_id, url, depth, parent_url FROM visits"
ORACLES["crawl_budget"] = f"WITH {_crawl_sql()} SELECT job_id, url, depth, outcome FROM visits WHERE before < 4"
ORACLES["crawl_outcomes"] = f"WITH {_attempts_sql(4)}"
ORACLES["crawl_robots"] = f"WITH {_attempts_sql(100_000, robots=True)}"

ORACLES["crawl_cancelled"] = f"""SELECT * FROM (WITH {_attempts_sql(100_000)}) WHERE length(job_id) % 2 = 1
UNION ALL SELECT DISTINCT {_HOST}, 'cancelled', CAST(1 AS BIGINT) FROM pages WHERE length({_HOST}) % 2 = 0"""

# --- robots and admission -----------------------------------------------------------------------------------

ORACLES["robots_rules"] = f"""WITH {_ROBOT_HOSTS},
v(k, grp, agents, is_default, seq, allow, path, crawl_delay) AS (VALUES
  (1, 1, '*', TRUE, 1, FALSE, '/fr/', 2),
  (2, 1, 'linkspark', FALSE, 2, FALSE, '/en/', NULL), (2, 1, 'linkspark', FALSE, 3, TRUE, '/', NULL),
  (2, 2, '*', TRUE, 6, FALSE, '/', NULL),
  (3, 1, 'otherbot', FALSE, 1, FALSE, '/', NULL), (3, 2, '*', TRUE, 4, TRUE, '/de/', 5),
  (3, 2, '*', TRUE, 5, FALSE, '/de', 5), (3, 2, '*', TRUE, 6, FALSE, '/es/', 5),
  (4, 1, '*', TRUE, 1, TRUE, '', NULL))
SELECT host, CAST(grp AS BIGINT) AS grp, agents, is_default, seq, allow, path, crawl_delay
FROM robot_hosts JOIN v USING (k)"""

ORACLES["robots_verdicts"] = f"""WITH {_ROBOT_HOSTS}
SELECT page_id, url, NOT ({_denied_sql('path')}) AS allowed
FROM (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path FROM pages) JOIN robot_hosts USING (host)"""

ORACLES["crawl_delays"] = f"""WITH {_ROBOT_HOSTS}
SELECT host, CAST(CASE k WHEN 1 THEN 2 WHEN 3 THEN 5 ELSE 1 END AS DOUBLE) AS crawl_delay FROM robot_hosts"""

_TOKEN = 21_600_000_000  # microseconds per token at one request every six hours

_QUEUE = """q AS (SELECT CAST(user_id AS VARCHAR) AS domain, event_id AS request_id, ts, epoch_us(ts) AS t,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"""

ORACLES["admission_schedule"] = f"""WITH {_QUEUE},
s AS (SELECT *, greatest(t, max(t - (n - 1) * {_TOKEN}) OVER (PARTITION BY domain ORDER BY t, request_id)
  + (n - 2) * {_TOKEN}) AS start FROM q)
SELECT domain, request_id, ts, round((start - t) / 1000000, 6) AS wait_seconds, make_timestamp(start) AS start_at FROM s"""

ORACLES["bucket_status"] = f"""WITH {_QUEUE},
f AS (SELECT domain, count(*) AS requests, max(ts) AS last_request,
  max(t - (n - 1) * {_TOKEN}) + count(*) * {_TOKEN} AS full_us FROM q
  WHERE ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY domain)
SELECT domain, requests, last_request,
  round(2 - greatest(full_us - epoch_us(TIMESTAMP '2024-01-20 12:00:00'), 0) / {_TOKEN}, 6) AS tokens,
  make_timestamp(CAST(full_us AS BIGINT)) AS full_at, 2 AS capacity FROM f"""

# --- link checking --------------------------------------------------------------------------------------------

ORACLES["effective_response"] = f"WITH {_checked_sql()} SELECT page_id, status_code FROM checked"
ORACLES["link_status"] = f"""WITH {_checked_sql()}
SELECT page_id, status_code, is_valid, error_type, error_message FROM checked"""
ORACLES["link_status_strict"] = f"""WITH {_checked_sql('strict')}
SELECT page_id, status_code, is_valid, error_type, error_message FROM checked"""
ORACLES["invalid_targets"] = f"""WITH {_checked_sql()}, o AS (SELECT page_id, {canonical_sql('url')} AS canonical, is_valid, error_type, url FROM checked),
best AS (SELECT canonical, arg_min(is_valid, url) AS is_valid, arg_min(error_type, url) AS error_type FROM o GROUP BY 1)
SELECT page_id, 'http://[bad/' || page_id AS broken_url, 'INVALID_URL' AS error_type FROM pages WHERE page_id % 7 = 3
UNION ALL SELECT o.page_id, canonical, best.error_type FROM o JOIN best USING (canonical) WHERE o.page_id % 7 <> 3 AND NOT best.is_valid"""

ORACLES["redirected_checks"] = f"""WITH {_checked_sql()}
SELECT p.url, c.status_code, c.is_valid, c.error_type, c.error_message
FROM pages p JOIN checked c ON c.page_id = CASE WHEN p.page_id % 5 = 4 THEN p.page_id - 1 ELSE p.page_id END"""
ORACLES["net_error_types"] = f"""WITH {_checked_sql()}
SELECT error_message AS net_error, error_type, count(*) AS urls FROM checked
WHERE error_type NOT IN ('HTTP_ERROR') GROUP BY ALL"""

ORACLES["resolved_attempts"] = f"""WITH {_checked_sql()},
tries AS (SELECT c.url, attempt, c.error_type IN ('TIMEOUT', 'DNS_ERROR', 'SSL_ERROR', 'CONNECTION_ERROR')
    AND attempt > page_id % 7 AS well, status_code, is_valid, error_type, error_message
  FROM checked c, range(1, 4) x(attempt)),
fixed AS (SELECT url, attempt, CASE WHEN well THEN 200 ELSE status_code END AS status_code, well OR is_valid AS is_valid,
  CASE WHEN NOT coalesce(well, FALSE) THEN error_type END AS error_type,
  CASE WHEN NOT coalesce(well, FALSE) THEN error_message END AS error_message FROM tries),
marked AS (SELECT *, coalesce(error_type IN ('TIMEOUT', 'CONNECTION_ERROR'), FALSE) AS transient FROM fixed),
last AS (SELECT * FROM marked QUALIFY row_number() OVER (PARTITION BY url
  ORDER BY transient, CASE WHEN transient THEN -attempt ELSE attempt END) = 1)
SELECT url, status_code, is_valid, error_type, error_message, CAST(attempt AS INTEGER) AS attempts,
  CASE attempt WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN 0.5::DOUBLE ELSE 2.5::DOUBLE END AS backoff_seconds FROM last"""

ORACLES["redirect_chains"] = """WITH RECURSIVE red AS (SELECT a.url, b.url AS location
  FROM pages a JOIN pages b ON b.page_id = a.page_id + 1 WHERE a.page_id % 16 < 13),
chase AS (SELECT url, url AS here, 0 AS hops FROM pages
  UNION ALL SELECT c.url, r.location, c.hops + 1 FROM chase c JOIN red r ON r.url = c.here WHERE c.hops < 10),
ends AS (SELECT url, max(hops) AS hops, arg_max(here, hops) AS here FROM chase GROUP BY url)
SELECT url, page_id, CASE WHEN hops <= 9 THEN here END AS final_url, CAST(hops AS INTEGER) AS hops, hops > 9 AS refused,
  CASE WHEN hops > 9 THEN 'CONNECTION_ERROR' END AS error_type,
  CASE WHEN hops > 9 THEN 'too many redirects' END AS error_message FROM ends JOIN pages USING (url)"""

ORACLES["check_links"] = f"""WITH {_OUTCOMES}
SELECT page_id, pos, canonical, category, status_code, is_valid, error_type, error_message FROM links"""
ORACLES["broken_links"] = f"WITH {_BROKEN} SELECT * FROM broken"

# --- retries ---------------------------------------------------------------------------------------------------

_DECISIONS = r"""attempts AS (SELECT CAST(user_id AS VARCHAR) AS task_id, 'job-' || (user_id % 10) AS job_id,
  'crawl_url' AS task_name, ts, event_id AS seq,
  CASE event_type WHEN 'error' THEN 'FAILURE' WHEN 'view' THEN 'STARTED' ELSE 'SUCCESS' END AS outcome,
  CASE WHEN event_type = 'error' THEN CASE WHEN CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) % 10 = 0 THEN 'ValueError'
    WHEN CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) % 10 < 5 THEN 'TimeoutError' ELSE 'ConnectionError' END END AS exception_class,
  CASE WHEN event_type = 'error' THEN 'failed at ' || props END AS exception_message FROM events),
ended AS (SELECT *, coalesce(sum(CASE WHEN outcome = 'SUCCESS' OR exception_class = 'ValueError' THEN 1 ELSE 0 END)
  OVER (PARTITION BY task_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
  FROM attempts WHERE outcome != 'STARTED'),
numbered AS (SELECT *, CAST((row_number() OVER (PARTITION BY task_id, run ORDER BY ts, seq) - 1) % 3 AS INTEGER) AS retry_number FROM ended),
decisions AS (SELECT *, CASE WHEN outcome = 'SUCCESS' THEN 'done' WHEN exception_class = 'ValueError' OR retry_number >= 2
  THEN 'dead_letter' ELSE 'retry' END AS decision FROM numbered)"""

ORACLES["backoff_schedule"] = """SELECT event_id, CAST(event_id % 12 AS INTEGER) AS retry_number,
  CAST(least(60 * pow(2, event_id % 12), 600) AS INTEGER) AS backoff_seconds FROM events"""
ORACLES["retry_decisions"] = f"""WITH {_DECISIONS}
SELECT task_id, seq, outcome, retry_number, decision,
  CASE WHEN decision = 'retry' THEN CAST(60 * pow(2, retry_number) AS INTEGER) END AS backoff_seconds FROM decisions"""
ORACLES["retry_history"] = f"""WITH {_DECISIONS}
SELECT task_id, retry_number, exception_class, exception_message,
  CAST(60 * pow(2, retry_number) AS INTEGER) AS backoff_seconds, ts AS retried_at FROM decisions WHERE decision = 'retry'"""
_LETTERS = f"""{_DECISIONS}, letters AS (SELECT job_id, task_id, task_name, exception_class, exception_message,
  retry_number AS total_retries, FALSE AS acknowledged, ts AS final_failure_at FROM decisions WHERE decision = 'dead_letter')"""
ORACLES["dead_letters"] = f"WITH {_LETTERS} SELECT * FROM letters"
ORACLES["task_status"] = f"""WITH {_DECISIONS},
seen AS (SELECT task_id, ts, seq, CASE decision WHEN 'done' THEN 'SUCCESS' WHEN 'retry' THEN 'RETRY' ELSE 'FAILURE' END AS status
  FROM decisions UNION ALL SELECT task_id, ts, seq, 'STARTED' FROM attempts WHERE outcome = 'STARTED'),
latest AS (SELECT task_id, status, ts FROM seen QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, seq DESC) = 1)
SELECT CAST(c_custkey AS VARCHAR) AS task_id, coalesce(status, 'PENDING') AS status, ts AS updated_at
FROM customer LEFT JOIN latest ON task_id = CAST(c_custkey AS VARCHAR)"""
ORACLES["retryable_errors"] = f"""WITH {_DECISIONS}
SELECT exception_class, count(*) AS failures FROM attempts
WHERE outcome = 'FAILURE' AND exception_class != 'ValueError' GROUP BY 1"""
ORACLES["dlq_backlog"] = f"""WITH {_LETTERS}
SELECT job_id, exception_class, count(*) AS open_letters, min(final_failure_at) AS oldest
FROM letters WHERE CAST(task_id AS INTEGER) % 4 != 0 GROUP BY 1, 2"""

# --- jobs --------------------------------------------------------------------------------------------------------

_JOB_EVENTS = """job_events AS (SELECT CAST(user_id AS VARCHAR) AS job_id, ts, event_id AS seq,
  CASE event_type WHEN 'view' THEN 'IN_PROGRESS' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED'
       WHEN 'signup' THEN 'CANCELLED' ELSE 'PENDING' END AS status,
  CASE WHEN event_type = 'error' THEN 'error ' || props END AS error_message FROM events)"""
_STATES = f"""{_JOB_EVENTS}, states AS (SELECT job_id, last(status ORDER BY ts, seq) AS status,
  min(ts) FILTER (status = 'IN_PROGRESS') AS started_at,
  max(ts) FILTER (status IN ('COMPLETED', 'FAILED', 'CANCELLED')) AS completed_at,
  last(error_message ORDER BY ts, seq) FILTER (error_message IS NOT NULL) AS error_message
  FROM job_events GROUP BY job_id)"""

ORACLES["job_intake"] = rf"""WITH {_URLS},
d AS (SELECT *, coalesce(CASE WHEN page_id % 5 != 0 THEN page_id % 13 - 1 END, 3) AS max_depth,
  coalesce(CASE WHEN page_id % 7 != 0 THEN page_id * 97 % 12000 END, 100) AS max_pages FROM urls),
j AS (SELECT *, CASE WHEN NOT regexp_matches(url, '^\s*https?://[^/?#]') OR length(url) > 2048 THEN 'invalid_url'
  WHEN max_depth NOT BETWEEN 1 AND 10 THEN 'max_depth' WHEN max_pages NOT BETWEEN 1 AND 10000 THEN 'max_pages' END AS reject_reason FROM d)
SELECT sha256(page_id || '|' || url) AS job_id, url, reject_reason, CAST(max_depth AS INTEGER) AS max_depth,
  CAST(max_pages AS INTEGER) AS max_pages, page_id % 2 != 0 AS respect_robots_txt,
  TIMESTAMP '2024-01-20 12:00:00' AS created_at, CASE WHEN reject_reason IS NULL THEN 'PENDING' END AS status FROM j"""
ORACLES["job_state"] = f"WITH {_STATES} SELECT * FROM states"
ORACLES["cancel_decisions"] = f"""WITH {_JOB_EVENTS},
b AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ts, seq) AS previous_status FROM job_events)
SELECT job_id, seq, previous_status, CASE WHEN previous_status IN ('COMPLETED', 'FAILED', 'CANCELLED')
  THEN 'rejected' ELSE 'accepted' END AS decision FROM b WHERE status = 'CANCELLED'"""
ORACLES["idle_jobs"] = f"""WITH {_STATES},
last AS (SELECT CAST(user_id AS VARCHAR) AS job_id, max(ts) AS last_page_at FROM events
  WHERE event_type = 'click' AND user_id % 5 != 0 GROUP BY 1)
SELECT job_id, last_page_at, CASE WHEN last_page_at IS NULL THEN 'stalled' ELSE 'completed' END AS verdict
FROM states LEFT JOIN last USING (job_id) WHERE status = 'IN_PROGRESS'
  AND (last_page_at IS NULL OR last_page_at <= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 6 HOUR)"""
ORACLES["list_jobs"] = """WITH j AS (SELECT CAST(o_orderkey AS VARCHAR) AS job_id, CAST(o_custkey AS VARCHAR) AS user_id,
  'IN_PROGRESS' AS status, CAST(o_orderdate AS TIMESTAMP) AS created_at, count(*) OVER () AS total,
  CAST(floor(epoch(TIMESTAMP '1998-08-03 07:00:00')) - epoch(o_orderdate) AS BIGINT) AS s FROM orders WHERE o_orderstatus = 'O')
SELECT job_id, user_id, status, created_at, total, greatest(least(50, total - 10), 0) AS returned,
  CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago'
       ELSE s // 86400 || 'd ago' END AS age FROM j ORDER BY created_at DESC, job_id LIMIT 50 OFFSET 10"""
_COUNTERS = f"""{_BROKEN}, {_JOB_PAGES},
counters AS (SELECT job_id, coalesce(pages_n, 0) AS total_pages_crawled, coalesce(links_n, 0) AS total_links_found,
  coalesce(broken_n, 0) AS total_broken_links
  FROM (SELECT job_id, count(*) AS pages_n, CAST(sum(links_count) AS BIGINT) AS links_n FROM job_pages WHERE NOT failed GROUP BY 1)
  FULL JOIN (SELECT job_id, count(*) AS broken_n FROM broken GROUP BY 1) USING (job_id))"""
ORACLES["job_counters"] = f"WITH {_COUNTERS} SELECT * FROM counters"
ORACLES["job_link_totals"] = f"""WITH {_EDGES}
SELECT host AS job_id, count(*) AS links_kept, count(*) FILTER (category = 'external') AS external_links,
  count(DISTINCT canonical) FILTER (category = 'external') AS checked_targets FROM edges GROUP BY 1"""
ORACLES["job_summary"] = f"""WITH {_COUNTERS},
h AS (SELECT host AS job_id, arg_min(url, page_id) AS url, min(page_id) AS first FROM p GROUP BY 1),
j AS (SELECT *, TIMESTAMP '2024-01-01' + to_seconds(first * 60) AS created_at,
  CASE WHEN first % 3 != 0 THEN TIMESTAMP '2024-01-01' + to_seconds(first * 67) END AS completed_at FROM h),
e AS (SELECT *, CAST(floor(epoch(coalesce(completed_at, TIMESTAMP '2024-01-20 12:00:00'))) - floor(epoch(created_at)) AS BIGINT) AS s FROM j)
SELECT job_id, url, CASE first % 3 WHEN 0 THEN 'IN_PROGRESS' WHEN 1 THEN 'COMPLETED' ELSE 'FAILED' END AS status,
  coalesce(total_pages_crawled, 0) AS pages_crawled, coalesce(total_links_found, 0) AS links_found,
  coalesce(total_broken_links, 0) AS broken_links, coalesce(links_kept, 0) AS links_kept,
  coalesce(external_links, 0) AS external_links, coalesce(checked_targets, 0) AS checked_targets, 3 AS max_depth, 5 AS max_pages,
  created_at, created_at AS started_at, completed_at, CASE WHEN first % 3 = 2 THEN 'seed failed' END AS error,
  s AS elapsed_seconds, CASE WHEN s < 60 THEN s || 's' ELSE s // 60 || 'm ' || s % 60 || 's' END AS elapsed,
  round(least(100.0::DOUBLE, coalesce(total_pages_crawled, 0) / 5 * 100), 6) AS progress FROM e LEFT JOIN counters USING (job_id)
LEFT JOIN (SELECT host AS job_id, count(*) AS links_kept, count(*) FILTER (category = 'external') AS external_links,
  count(DISTINCT canonical) FILTER (category = 'external') AS checked_targets FROM edges GROUP BY 1) USING (job_id)"""
ORACLES["broken_links_page"] = f"""WITH {_BROKEN}
SELECT *, count(*) OVER () AS total, greatest(least(5, count(*) OVER () - 1), 0) AS returned FROM broken WHERE job_id = {_ONE_JOB}
ORDER BY discovered_at DESC, broken_url LIMIT 5 OFFSET 1"""
ORACLES["pages_by_job"] = f"""WITH {_EDGES}, {_JOB_PAGES}
SELECT job_id, url, status_code, links_count, crawled_at, count(*) OVER () AS total, greatest(least(10, count(*) OVER () - 1), 0) AS returned FROM job_pages
WHERE job_id = {_ONE_JOB} ORDER BY crawled_at DESC, url LIMIT 10 OFFSET 1"""
ORACLES["visited_lookup"] = f"""WITH {_EDGES}
SELECT page_id, pos, host AS job_id, href AS url,
  EXISTS (SELECT 1 FROM p WHERE p.host = fx.host AND p.canonical = fx.canonical) AS visited FROM fx"""
ORACLES["delete_jobs"] = f"""SELECT {_HOST} AS job_id, page_id FROM pages
WHERE {_HOST} NOT IN (SELECT {_HOST} FROM pages WHERE page_id % 4 = 0)"""
ORACLES["delete_jobs_dead_letters"] = f"""WITH {_LETTERS}
SELECT * REPLACE (CASE WHEN job_id NOT IN ('job-1', 'job-4') THEN job_id END AS job_id) FROM letters"""

# --- search --------------------------------------------------------------------------------------------------------

_WORDS = r"[\p{L}\p{M}\p{N}_]+(?:[.''’][\p{L}\p{M}\p{N}_]+)*"


def _tokens(e: str) -> str:
    return f"regexp_extract_all(lower({e}), '{_WORDS}')"


_PAGE_INDEX = f"""docs AS (SELECT page_id AS doc_id, {_HOST} AS job_id, url, {_TITLE} AS title, {_WHOLE_TEXT} AS content,
  {_CRAWLED} AS crawled_at FROM pages),
words AS (SELECT 'title' AS field, doc_id, unnest({_tokens('title')}) AS term FROM docs
  UNION ALL SELECT 'content', doc_id, unnest({_tokens('content')}) FROM docs),
lengths AS (SELECT field, doc_id, count(*) AS length FROM words GROUP BY ALL),
postings AS (SELECT field, term, doc_id, count(*) AS tf FROM words GROUP BY ALL),
terms AS (SELECT field, term, count(*) AS df FROM postings GROUP BY ALL),
fields AS (SELECT field, count(*) AS docs, avg(length) AS mean_length FROM lengths GROUP BY 1)"""

# The built-in distances count bytes, so accented letters become (unused) capitals first.
_PLAIN_LETTERS = "translate({0}, 'ßäçèéêíñóöü', 'ABCDEFGHIJK')"


def _swap_at(shift: int) -> str:
    """a and b swap two neighbours at i, and the rest on both sides is one edit at most."""
    at = f"(i + {shift})"
    return (f"({at} >= 1 AND substr(b, {at}, 2) = reverse(substr(a, i, 2)) AND length(substr(b, {at}, 2)) = 2 AND "
            f"damerau_levenshtein(substr(a, 1, i - 1), substr(b, 1, {at} - 1)) + "
            f"damerau_levenshtein(substr(a, i + 2), substr(b, {at} + 2)) <= 1)")


# The built-in swap distance also counts swaps with letters put in between, which search does not.
_DISTANCE = (f"CASE WHEN dl < 2 OR levenshtein(a, b) <= 2 OR len(list_filter(range(1, length(a)), "
             f"lambda i: {_swap_at(-1)} OR {_swap_at(0)} OR {_swap_at(1)})) > 0 THEN dl ELSE 3 END")

_EXPANDED = f"""reach AS (SELECT DISTINCT qterm, CASE WHEN length(qterm) <= 2 THEN 0 WHEN length(qterm) <= 5 THEN 1 ELSE 2 END AS k FROM qterms),
pairs AS (SELECT qterm, term, k, {_PLAIN_LETTERS.format('qterm')} AS a, {_PLAIN_LETTERS.format('term')} AS b,
  damerau_levenshtein(a, b) AS dl
  FROM reach JOIN (SELECT DISTINCT term FROM terms) ON abs(length(qterm) - length(term)) <= k),
near AS (SELECT qterm, term, k, {_DISTANCE} AS edits FROM pairs WHERE dl <= k),
expanded AS (SELECT field, qterm, term, edits, 1 - edits / least(length(qterm), length(term)) AS weight, df
  FROM near JOIN terms USING (term) WHERE edits <= k AND edits < least(length(qterm), length(term)))"""

_SCORED = """blended AS (SELECT field, term, weight * qtf AS weight, query_id, max(df) OVER (PARTITION BY query_id, field, qterm) AS df
  FROM expanded JOIN qterms USING (qterm)),
per_field AS (SELECT query_id, doc_id, field, sum(weight * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf
  / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean_length))) AS s
  FROM blended JOIN fields USING (field) JOIN postings USING (field, term) JOIN lengths USING (field, doc_id) GROUP BY ALL),
scored AS (SELECT query_id, doc_id, round(max(s * CASE field WHEN 'title' THEN 3 ELSE 1 END), 6) AS score FROM per_field GROUP BY ALL)"""

_QUESTIONS = f"""qterms AS (SELECT query_id, qterm, count(*) AS qtf FROM (
  SELECT item_id AS query_id, unnest({_tokens('text')}) AS qterm FROM benchmark) GROUP BY ALL)"""


def _search_sql(where: str, size: int) -> str:
    from linkspark.plans.queries import SEARCH
    return f"""WITH {_PAGE_INDEX}, qterms AS (SELECT 0 AS query_id, qterm, count(*) AS qtf
  FROM (SELECT unnest({_tokens(f"'{SEARCH}'")}) AS qterm) GROUP BY ALL), {_EXPANDED}, {_SCORED}
SELECT doc_id, job_id, url, title, 0 AS depth, 200 AS status_code, crawled_at, score
FROM scored JOIN docs USING (doc_id) {where} ORDER BY score DESC, doc_id LIMIT {size}"""


ORACLES["analyze_standard"] = f"""SELECT doc_id, term, count(*) AS tf FROM (
  SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents) GROUP BY ALL"""
ORACLES["term_stats"] = f"""WITH {_PAGE_INDEX}
SELECT field, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences FROM postings GROUP BY ALL"""
ORACLES["doc_lengths"] = f"""WITH {_PAGE_INDEX}
SELECT field, doc_id, CAST(length AS INTEGER) AS length FROM lengths"""
ORACLES["fuzzy_terms"] = f"""WITH {_PAGE_INDEX}, {_QUESTIONS}, {_EXPANDED}
SELECT field, qterm, term, CAST(edits AS INTEGER) AS edits, round(weight, 6) AS weight, df FROM expanded"""
ORACLES["search_bm25"] = _search_sql("", 20)
ORACLES["search_saved"] = ORACLES["search_bm25"]
ORACLES["search_job"] = _search_sql(f"WHERE job_id = {_ONE_JOB}", 5)
ORACLES["search_many"] = f"""WITH words AS (SELECT 'content' AS field, doc_id, unnest({_tokens('text')}) AS term FROM documents),
lengths AS (SELECT field, doc_id, count(*) AS length FROM words GROUP BY ALL),
postings AS (SELECT field, term, doc_id, count(*) AS tf FROM words GROUP BY ALL),
terms AS (SELECT field, term, count(*) AS df FROM postings GROUP BY ALL),
fields AS (SELECT field, count(*) AS docs, avg(length) AS mean_length FROM lengths GROUP BY 1), {_QUESTIONS},
expanded AS (SELECT DISTINCT field, qterm, term, 1.0::DOUBLE AS weight, df FROM qterms JOIN terms ON term = qterm), {_SCORED},
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 10"""

# --- metrics ---------------------------------------------------------------------------------------------------------


def _windows(hours: int, slide: int, keys: str) -> str:
    return f"""w AS (SELECT time_bucket(INTERVAL {slide} HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL {slide} HOUR * i AS window_start, *
  FROM events, range(0, {hours // slide}) x(i)),
rated AS (SELECT window_start, window_start + INTERVAL {hours} HOUR AS window_end, {keys} count(*) AS events FROM w GROUP BY ALL)"""


ORACLES["event_rate"] = f"""WITH {_windows(6, 1, '')}
SELECT window_start, window_end, events, round(events / 21600, 9) AS per_second FROM rated"""
ORACLES["error_rate_by_type"] = f"""WITH {_windows(12, 3, 'event_type,')}
SELECT window_start, window_end, event_type, events, round(events / 43200, 9) AS per_second FROM rated"""
ORACLES["failure_rate"] = """WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start,
  count(*) FILTER (event_type = 'error') AS failures, count(*) AS events FROM events GROUP BY 1)
SELECT window_start, failures, events, round(failures / 21600, 9) AS per_second, round(failures / events, 6) AS share FROM w"""

_BOUNDS = "b(le, i) AS (VALUES (0.5::DOUBLE, 1), (1, 2), (2, 3), (5, 4), (10, 5), (30, 6), ('Infinity'::DOUBLE, 7))"
_DEFAULT = ("b(le, i) AS (VALUES (0.005::DOUBLE, 1), (0.01, 2), (0.025, 3), (0.05, 4), (0.1, 5), (0.25, 6), (0.5, 7), "
            "(1, 8), (2.5, 9), (5, 10), (10, 11), ('Infinity'::DOUBLE, 12))")
ORACLES["duration_histogram"] = f"""WITH {_BOUNDS}
SELECT event_type, CASE WHEN i = 7 THEN '+Inf' ELSE CAST(le AS VARCHAR) END AS le,
  count(*) FILTER (value <= le) AS cumulative FROM events, b GROUP BY event_type, le, i"""


def _quantile(bounds: str, last: int, keys: str, select: str, q: float) -> str:
    return f"""WITH {bounds}, h AS (SELECT {select}, i, le, count(*) FILTER (value <= le) AS c, count(*) AS n
  FROM events, b GROUP BY ALL),
s AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY {keys} ORDER BY i), 0) AS below,
  coalesce(lag(le) OVER (PARTITION BY {keys} ORDER BY i), 0) AS low FROM h),
f AS (SELECT * FROM s WHERE c >= n * {q}::DOUBLE QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY i) = 1)
SELECT {keys}, n AS observations,
  round(CASE WHEN i = {last} THEN low WHEN c = below THEN low ELSE low + (le - low) * (n * {q}::DOUBLE - below) / (c - below) END, 6) AS quantile FROM f"""


ORACLES["p95_duration"] = _quantile(_BOUNDS, 7, "day, event_type", "date_trunc('day', ts)::TIMESTAMP AS day, event_type", 0.95)
ORACLES["check_duration_quantile"] = _quantile(_DEFAULT, 12, "user_id", "user_id", 0.5)
ORACLES["active_jobs"] = f"""WITH {_STATES},
c AS (SELECT started_at AS ts, 1 AS d FROM states WHERE started_at IS NOT NULL
  UNION ALL SELECT completed_at, -1 FROM states WHERE completed_at >= started_at),
m AS (SELECT ts, sum(d) AS d FROM c GROUP BY ts)
SELECT ts, CAST(sum(d) OVER (ORDER BY ts) AS BIGINT) AS active FROM m"""
ORACLES["active_jobs_at"] = f"""WITH {_STATES}
SELECT count(*) FILTER (started_at <= TIMESTAMP '2024-01-20 12:00:00' AND (completed_at IS NULL
  OR completed_at > TIMESTAMP '2024-01-20 12:00:00')) AS active FROM states"""
ORACLES["backlog_depth"] = """WITH m AS (SELECT CAST(user_id % 3 AS VARCHAR) AS queue, ts,
  sum(CASE event_type WHEN 'view' THEN 1 ELSE -1 END) AS d FROM events WHERE event_type IN ('view', 'purchase') GROUP BY ALL)
SELECT queue, ts, CAST(sum(d) OVER (PARTITION BY queue ORDER BY ts) AS BIGINT) AS depth FROM m"""
ORACLES["metric_totals"] = "SELECT user_id, event_type, count(*) AS total FROM events GROUP BY ALL"
ORACLES["job_activity"] = """WITH g AS (SELECT CAST(user_id AS VARCHAR) AS job_id, ts,
  CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY job_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM g)
SELECT job_id, min(ts) AS started_at, max(ts) + INTERVAL 6 HOUR AS completed_at, count(*) AS pages
FROM s GROUP BY job_id, nth"""
ORACLES["quiet_rate"] = """WITH e AS (SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS w, event_type FROM events WHERE value > 40),
s AS (SELECT event_type, unnest(generate_series(min(w), max(w), INTERVAL 1 HOUR)) AS window_start FROM e GROUP BY 1),
c AS (SELECT w AS window_start, event_type, count(*) AS n FROM e GROUP BY ALL)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, coalesce(n, 0) AS events, round(coalesce(n, 0) / 3600, 9) AS per_second
FROM s LEFT JOIN c USING (window_start, event_type)"""
ORACLES["sketched_percentiles"] = """SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, share,
  count(value) AS rows, true AS near FROM events, (VALUES (0.5::DOUBLE), (0.95::DOUBLE)) q(share) WHERE value IS NOT NULL GROUP BY ALL"""
ORACLES["value_percentiles"] = """SELECT event_type, share, round(CASE share WHEN 0.5 THEN a WHEN 0.95 THEN b ELSE c END, 6) AS exact
FROM (SELECT event_type, quantile_cont(value, 0.5) AS a, quantile_cont(value, 0.95) AS b, quantile_cont(value, 0.99) AS c FROM events GROUP BY 1),
  (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) q(share)"""
# windows and sessions leave a stream once its watermark, the newest time less an hour, has passed their end
_WATERMARK = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"
ORACLES["stream_dedupe"] = "SELECT DISTINCT event_type AS job_id, sha256('https://shop.example/u/' || user_id) AS url_hash FROM events"
ORACLES["stream_rate"] = f"""SELECT * FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type,
  count(*) AS events FROM events GROUP BY ALL) WHERE window_start + INTERVAL 6 HOUR <= {_WATERMARK}"""
ORACLES["stream_completions"] = f"SELECT * FROM ({ORACLES['job_activity']}) WHERE completed_at <= {_WATERMARK}"
ORACLES["stream_closings"] = ORACLES["stream_completions"]
ORACLES["stream_check"] = f"""WITH {_BROKEN}
SELECT DISTINCT job_id, source_url, broken_url, status_code, error_type, error_message, CAST(1 AS INTEGER) AS depth FROM broken"""
ORACLES["stream_counters"] = """SELECT CAST(user_id AS VARCHAR) AS job_id, count(*) AS total_pages_crawled,
  CAST(sum(event_id % 7) AS BIGINT) AS total_links_found FROM events WHERE user_id % 10 <> 3 OR user_id % 20 = 3 GROUP BY user_id"""
ORACLES["merge_pages"] = ORACLES["upsert_pages"]
ORACLES["robots_statuses"] = ORACLES["crawl_delays"].replace("WHEN 1 THEN 2 WHEN 3", "WHEN 3")
ORACLES["jobs_after"] = """WITH j AS (SELECT CAST(o_orderkey AS VARCHAR) AS job_id, CAST(o_custkey AS VARCHAR) AS user_id,
  CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'IN_PROGRESS' ELSE 'PENDING' END AS status,
  CAST(o_orderdate AS TIMESTAMP) AS created_at FROM orders), l AS (SELECT created_at AS t, job_id AS k FROM j WHERE job_id = '700')
SELECT j.* FROM j, l WHERE created_at < t OR (created_at = t AND job_id > k) ORDER BY created_at DESC, job_id LIMIT 100"""
