"""The same queries as plain SQL for an independent engine, over the given tables."""

from __future__ import annotations

_TRACKING = "('utm_source','utm_medium','utm_campaign','utm_term','utm_content','gclid','fbclid','mc_cid','mc_eid','ref','source','amp')"
_WORDS = (
    "['login','signin','sign-in','signup','sign-up','register','contact','contact-us','privacy','privacy-policy','terms',"
    "'terms-of-service','terms-and-conditions','careers','jobs','cart','checkout','account','my-account','wp-admin','wp-login',"
    "'search','tag','tags','author','page','category-listing']"
)
_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def _part(url: str, i: int) -> str:
    return f"coalesce(regexp_extract({url}, '{_URL}', {i}), '')"


def _domain(url: str) -> str:
    return rf"split_part(regexp_replace(lower({_part(url, 2)}), '^www\.', ''), ':', 1)"


def _normalized(url: str) -> str:
    path = _part(url, 3)
    path = f"CASE WHEN {path} = '' THEN '/' WHEN length({path}) > 1 THEN regexp_replace({path}, '/$', '') ELSE {path} END"
    code = lambda e: f"replace(url_encode(url_decode(replace({e}, '+', ' '))), '%20', '+')"
    pairs = (
        f"list_sort(list_transform(list_filter(string_split({_part(url, 4)}, '&'), lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN {_TRACKING}), "
        f"lambda p: {code(chr(115) + 'plit_part(p, ' + chr(39) + '=' + chr(39) + ', 1)')} || '=' || {code('regexp_replace(p, ' + chr(39) + '^[^=]*=?' + chr(39) + ', ' + chr(39) * 2 + ')')}))"
    )
    query = f"coalesce(array_to_string({pairs}, '&'), '')"
    return f"lower({_part(url, 1)}) || '://' || {_domain(url)} || {path} || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END"


def _non_article(url: str) -> str:
    return f"(trim(lower({_part(url, 3)}), '/') = '' OR list_has_any(string_split(trim(lower({_part(url, 3)}), '/'), '/'), {_WORDS}))"


_DECODE = (
    "regexp_replace(replace(replace(replace(replace(replace({t}, '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), "
    "'&middot;', '·'), '&amp;?', '&', 'g')"
)


def _decode(text: str) -> str:
    return _DECODE.replace("{t}", text)


_SPACE = r"E' \t\n\r\x0b\x0c'"


def _strip(text: str) -> str:
    return f"trim({text}, {_SPACE})"


def _words(text: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({text}, '\s+'), lambda w: w <> ''))"


# Tags and texts of every page, one row each, outside scripts, styles and comments.
_TOKENS = rf"""
clean AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>', '', 'g'),
         '(?s)<style.*?</style>', '', 'g'), '(?s)<!--.*?-->', '<c>', 'g') AS html FROM pages),
cut AS (SELECT page_id, url, regexp_extract_all(html, '<[^>]*>[^<]*') AS toks FROM clean),
rows0 AS (SELECT page_id, url, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM cut),
tokens AS (
  SELECT page_id, url, pos, lower(regexp_extract(tok, '^<(/?[a-zA-Z0-9!]+)', 1)) AS tag,
         {_strip(_decode("regexp_replace(tok, '^<[^>]*>', '')"))} AS text FROM rows0),
state AS (
  SELECT *, sum(CASE WHEN tag IN ('nav','footer') THEN 1 WHEN tag IN ('/nav','/footer') THEN -1 ELSE 0 END) OVER w AS noise,
    sum(CASE WHEN tag IN ('p','h1') THEN 1 ELSE 0 END) OVER w AS block,
    last_value(CASE WHEN tag IN ('p','h1','title') THEN tag WHEN tag IN ('/p','/h1','/title','/article','footer','nav','div','ul','li') THEN '-' END IGNORE NULLS) OVER w AS inside,
    sum(CASE WHEN tag = 'body' THEN 1 ELSE 0 END) OVER w AS in_body
  FROM tokens WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
lines AS (
  SELECT page_id, block, any_value(inside) AS tag, min(pos) AS pos,
    coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE text <> ''), '') AS tight,
    coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (WHERE text <> ''), '') AS spaced
  FROM state WHERE inside IN ('p','h1') AND noise = 0 GROUP BY page_id, block),
article AS (
  SELECT p.page_id, p.url, coalesce({_strip("string_agg(CASE WHEN tag = 'h1' THEN E'\\n[H1] ' || tight || E'\\n' ELSE spaced END, E'\\n' ORDER BY l.pos) FILTER (WHERE tight <> '')")}, '') AS structured_content
  FROM pages p LEFT JOIN lines l ON p.page_id = l.page_id GROUP BY p.page_id, p.url)
"""

_SITE = "'c' || o_custkey || '.example.com'"

# Documents as article pages: the texts written straight from the columns.
_PARAS = f"list_transform(list_filter(string_split(text, E'\\n'), lambda p: trim(p) <> ''), lambda p: {_strip('p')})"
_DOCS = f"""
docs AS (
  SELECT *, 'Report ' || doc_id || ' of ' || source AS title,
    '[H1] Report ' || doc_id || ' of ' || source || E'\\n' || list_aggregate(list_transform({_PARAS}, lambda p: E'\\n' || p), 'string_agg', '') AS head,
    E'[H2] Facts' || 'here' || E'\\n\\n- lang ' || lang || E'\\n- nested one two\\n1. one\\n1. two\\n> "said ' || source || E'"\\nid | chars\\n' || doc_id || ' | ' || n_chars
      || E'\\n\\n[H2] FAQ\\n\\nWhy ' || source || E'?\\n\\n[H3] Who?\\n\\nNobody\\n\\n[H2] In Summary\\n\\nDone with ' || doc_id AS tail
  FROM documents),
full_docs AS (SELECT *, head || E'\\n\\n' || tail AS structured_content FROM docs)
"""

# Orders by their place in the file tree of their site.
_TREE = f"""
tree AS (
  SELECT o_orderkey AS key, {_SITE} AS site, o_orderdate, 'https://' || {_SITE} AS base, o_orderkey // 1000 AS n0,
    o_orderkey // 1000000 AS n1, o_orderkey // 1000000000 AS n2 FROM orders)
"""
_FOUND_MAPS = "SELECT site, base || '/blog/order-' || key || '?a=1&b=2' AS url, strftime(o_orderdate, '%Y-%m-%d') AS lastmod, CAST(3 AS BIGINT) AS level, key FROM tree"


def _node(level: int, node: str) -> str:
    return f"base || '/blog/page/' || ({level} * 1000000000000 + {node})"


# Pages of the tree below the root, and what a crawl of them finds at which depth.
_CRAWL = f"""
{_TREE},
crawl AS (
  SELECT site, base || '/blog/order-' || key AS url, CAST(3 AS BIGINT) AS level FROM tree
  UNION ALL SELECT DISTINCT site, base || '/blog/', CAST(0 AS BIGINT) FROM tree
  UNION ALL SELECT DISTINCT site, {_node(1, 'n1')}, CAST(3 AS BIGINT) FROM tree
  UNION ALL SELECT DISTINCT site, {_node(2, 'n2')}, CAST(2 AS BIGINT) FROM tree)
"""

_V4 = r"regexp_extract(url, '//(\d+)\.(\d+)\.(\d+)\.(\d+)/', {i})"
_IP = [f"CAST(nullif({_V4.replace('{i}', str(i))}, '') AS INT)" for i in (1, 2, 3, 4)]
_A, _B, _C, _D = _IP
_V4_BLOCKED = f"""(
  {_A} IN (0, 10, 127) OR {_A} >= 224 OR ({_A} = 169 AND {_B} = 254) OR ({_A} = 172 AND {_B} BETWEEN 16 AND 31)
  OR ({_A} = 192 AND {_B} = 168) OR ({_A} = 192 AND {_B} = 0 AND {_C} = 2)
  OR ({_A} = 192 AND {_B} = 0 AND {_C} = 0 AND {_D} NOT IN (9, 10))
  OR ({_A} = 198 AND {_B} IN (18, 19)) OR ({_A} = 198 AND {_B} = 51 AND {_C} = 100) OR ({_A} = 203 AND {_B} = 0 AND {_C} = 113))"""

_ATTEMPTS = """
att AS (
  SELECT l_orderkey AS order_key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_partkey) - 1 AS attempt,
    l_returnflag AS flag, l_partkey AS part FROM lineitem),
tried AS (
  SELECT *, CASE flag WHEN 'N' THEN 200 WHEN 'R' THEN 500 ELSE 0 END AS http_status FROM att)
"""

_OWNED = f"owned AS (SELECT l.*, o_custkey, 'https://' || {_SITE} || '/blog/order-' || l_orderkey AS page FROM lineitem l JOIN orders ON l_orderkey = o_orderkey)"
_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'queued' ELSE 'failed' END"
# Half-even rounding to one digit of a ratio of integers times 100.
_EVEN = "round_even(CAST(processed AS DOUBLE) / identified * 100, 1)"

_EXPORT = f"""
{_DOCS},
rows1 AS (
  SELECT *, row_number() OVER (ORDER BY doc_id % 100, blog_url) AS id FROM (
    SELECT *, 'https://example.com/' || CASE WHEN lang = 'es' THEN 'tag/' ELSE 'docs/' END || doc_id AS blog_url FROM full_docs) t)
"""

_RUN = f"""{_TOKENS}, long AS (SELECT page_id, count(*) FILTER (WHERE tag = 'p' AND length(tight) > 80) AS n FROM lines GROUP BY page_id),
run AS (
  SELECT regexp_extract(p.url, '//[^/]*/([a-z]*)', 1) AS job_id, p.url AS raw_url, words,
    CASE WHEN blocked THEN 'skipped' WHEN NOT good THEN CASE WHEN p.page_id % 5 < 3 THEN 'failed' ELSE 'permanently_failed' END
      WHEN {_non_article('p.url')} THEN 'skipped' WHEN words >= 50 THEN 'success' ELSE 'partial' END AS status,
    CASE WHEN blocked OR NOT good THEN NULL ELSE round(CASE WHEN {_non_article('p.url')} THEN 0.05 ELSE
      least(1.0::DOUBLE, 0.2::DOUBLE + CASE WHEN n >= 3 THEN 0.25 ELSE 0.0 END + CASE WHEN regexp_matches(lower(p.url), '/blog|/article|/post') THEN 0.3 ELSE 0.0 END + 0.5) END, 6) END AS confidence,
    CAST(CASE WHEN blocked THEN NULL WHEN good THEN 200 ELSE 503 END AS BIGINT) AS http_status,
    CAST(p.page_id % 5 + CASE WHEN blocked OR good THEN 0 ELSE 1 END AS BIGINT) AS retry_count,
    CASE WHEN NOT blocked AND NOT good THEN 'HTTP 503' END AS error
  FROM (SELECT *, starts_with(url, 'https') AS good, contains(url, '://m.') AND regexp_matches(url, '^[^/]*//[^/]*/de/') AS blocked FROM pages) p
  JOIN long USING (page_id) JOIN (SELECT page_id, {_words('structured_content')} AS words FROM article) a USING (page_id))"""


_NODES = f"""
WITH {_TREE}, nodes AS (
  SELECT site, base || '/maps/0-' || n0 || '.xml' AS url, count(*) AS pages, 0 AS children FROM tree GROUP BY site, base, n0
  UNION ALL SELECT site, base || '/maps/1-' || n1 || '.xml', 0, count(DISTINCT n0) FROM tree GROUP BY site, base, n1
  UNION ALL SELECT site, base || '/maps/2-' || n2 || '.xml', 0, count(DISTINCT n1) FROM tree GROUP BY site, base, n2
  UNION ALL SELECT site, base || '/sitemap.xml', 0, count(DISTINCT n2) + 2 FROM tree GROUP BY site, base
  UNION ALL SELECT site, 'https://' || site || '/sitemap_index.xml', 0, 0 FROM (SELECT 'c' || c_custkey || '.example.com' AS site FROM customer) c)"""


ORACLE = {
    "article_url_counts": f"""
SELECT {_domain('url')} AS domain, count(*) AS article_urls FROM (
  SELECT arg_min(url, page_id) AS url FROM pages GROUP BY {_normalized('url')}) t
WHERE NOT {_non_article('url')} GROUP BY 1""",
    "url_normalize": f"SELECT page_id, {_normalized('url')} AS normalized_url FROM pages",
    "url_parts": f"""
SELECT page_id, lower({_part('url', 1)}) AS scheme, {_part('url', 2)} AS netloc, {_part('url', 3)} AS path, {_part('url', 4)} AS query,
  {_part('url', 5)} AS fragment, {_domain('url')} AS domain, split_part(url, '/', 1) || '//' || split_part(url, '/', 3) AS site_root,
  split_part(url, '#', 1) AS no_fragment FROM pages""",
    "url_dedup_first": f"SELECT arg_min(url, page_id) AS url, min(page_id) AS page_id, {_normalized('url')} AS normalized_url FROM pages GROUP BY 3",
    "path_filter": rf"""
SELECT page_id, {_non_article('url')} AS non_article, NOT {_non_article('url')} AS article,
  regexp_matches(url, '/page/\d+|[?&]page=\d+|[?&]paged=\d+') AS pagination,
  regexp_matches({_part('url', 3)}, '(?i)/(blog|articles?|posts?|news|insights?|resources?|guides?|case-stud(y|ies)|stories|updates?)/') AS hinted
FROM pages""",
    "same_site": f"""
SELECT page_id, root, d = root OR ends_with(d, '.' || root) AS same, ends_with(d, '.ample.com') AS other FROM (
  SELECT page_id, {_domain('url')} AS d, array_to_string(list_slice(string_split({_domain('url')}, '.'), -3, -1), '.') AS root FROM pages) t""",
    "add_scheme": "SELECT page_id, CASE WHEN starts_with(url, 'http://') THEN 'https://' || substr(url, 8) ELSE url END AS full_url FROM pages",
    "link_extract": """
SELECT page_id, CAST(pos - 1 AS BIGINT) AS pos, href, regexp_extract(url, '^[a-z]+://[^/?#]*') || href AS link FROM (
  SELECT page_id, url, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS pos FROM (
    SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages) a) b""",
    "link_domain_counts": rf"""
SELECT {_domain('url')} AS domain, sum(len(hrefs)) AS links, sum(len(list_filter(hrefs, lambda h: regexp_matches(h, '/page/\d+|[?&]page=\d+|[?&]paged=\d+')))) AS pagination_links
FROM (SELECT url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages) a GROUP BY 1""",
    "tag_counts": """
WITH t AS (SELECT unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)(<script)>.*?</script>', '<script>', 'g'), '(?s)(<style)>.*?</style>', '<style>', 'g'),
  '<(/?[a-zA-Z][a-zA-Z0-9]*)', 1)) AS name FROM pages)
SELECT lower(ltrim(name, '/')) AS tag, starts_with(name, '/') AS closing, count(*) AS n FROM t GROUP BY 1, 2""",
    "title_h1": f"""
SELECT page_id, {_strip(_decode("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))} AS title,
  {_strip(_decode("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))} AS h1 FROM pages""",
    "visible_words": f"""
WITH {_TOKENS}, counted AS (SELECT page_id, sum({_words('text')}) AS n FROM state WHERE noise = 0 GROUP BY page_id)
SELECT page_id, CAST(n AS BIGINT) AS visible_words, n < 80 AS needs_render FROM counted""",
    "structured_content": f"""
WITH {_TOKENS}
SELECT page_id, structured_content, {_strip("string_split(structured_content, E'\\n\\n')[1]")} AS introduction,
  CAST({_words('structured_content')} AS BIGINT) AS word_count, {_words('structured_content')} >= 50 AS quality_ok FROM article""",
    "body_fallback": f"""
WITH {_TOKENS}, whole AS (
  SELECT page_id, coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (WHERE text <> ''), '') AS text FROM state WHERE noise = 0 AND in_body > 0 GROUP BY page_id),
judged AS (SELECT a.page_id, structured_content, text, {_words('structured_content')} AS n, {_words('text')} AS m FROM article a JOIN whole USING (page_id))
SELECT page_id, CASE WHEN n < 50 AND m > n THEN text ELSE structured_content END AS main_content,
  concat_ws('; ', CASE WHEN n < 50 AND m > n THEN 'Fell back to whole-page text (article body was too short)' END,
    CASE WHEN n < 50 THEN 'Extracted word count below quality threshold (possible extraction failure)' END) AS warnings FROM judged""",
    "classify_confidence": f"""
WITH {_TOKENS}, long AS (SELECT page_id, count(*) FILTER (WHERE tag = 'p' AND length(tight) > 80) AS n FROM lines GROUP BY page_id)
SELECT p.page_id, NOT {_non_article('p.url')} AS is_candidate, round(CASE WHEN {_non_article('p.url')} THEN 0.05 ELSE
  least(1.0::DOUBLE, 0.2::DOUBLE + CASE WHEN n >= 3 THEN 0.25 ELSE 0.0 END + CASE WHEN regexp_matches(lower(p.url), '/blog|/article|/post') THEN 0.3 ELSE 0.0 END + 0.5) END, 6) AS confidence
FROM pages p JOIN long USING (page_id)""",
    "article_metadata": f"""
WITH {_DOCS}
SELECT doc_id, title, title || ' | Site' AS meta_title, 'About "' || source || '"' AS meta_description, 'https://example.com/blog/' || doc_id AS canonical_url,
  source AS author, CASE WHEN lang IN ('en','fr') THEN 'https://example.com/authors/' || source END AS author_url,
  CASE WHEN lang IN ('en','fr','de') THEN '2026-01-05' ELSE '2026-02-03' END AS published_date, CAST(NULL AS VARCHAR) AS modified_date, lang AS category,
  CASE lang WHEN 'en' THEN lang || '|' || source WHEN 'fr' THEN source || '|' || lang WHEN 'de' THEN '' ELSE 'a|b' END AS tags,
  CASE WHEN lang = 'fr' THEN 'https://example.com/authors/' || source || '.png' ELSE '/og.png' END AS featured_image, title AS h1 FROM docs""",
    "article_content": f"""
WITH {_DOCS}
SELECT doc_id, structured_content, head AS introduction, E'[H2] In Summary\\n\\nDone with ' || doc_id AS conclusion,
  'Why ' || source || '?' AS faq_content, 'Factshere|FAQ|In Summary' AS h2_headings, 'Who?' AS h3_headings,
  CAST({_words('structured_content')} AS BIGINT) AS word_count, {_words('structured_content')} >= 50 AS quality_ok FROM full_docs""",
    "article_score": f"""
SELECT doc_id, lang <> 'es' AS is_candidate, CASE WHEN lang = 'es' THEN 0.05 ELSE
  least(1.0::DOUBLE, round(0.4::DOUBLE * (lang IN ('en','fr'))::INT + 0.2 + 0.2 + CASE WHEN longs >= 3 THEN 0.25 ELSE 0 END + 0.1 + 0.5, 6)) END AS confidence
FROM (SELECT *, len(list_filter({_PARAS}, lambda p: length(p) > 80)) AS longs FROM documents) d""",
    "site_seeds": """
WITH s AS (SELECT 'c' || c_custkey || '.example.com' AS site FROM customer),
k AS (
  SELECT 'sitemap' AS kind, ['/sitemap.xml','/sitemap_index.xml','/sitemap-index.xml','/post-sitemap.xml','/blog-sitemap.xml','/page-sitemap.xml','/sitemap/sitemap.xml','/wp-sitemap.xml'] AS paths
  UNION ALL SELECT 'feed', ['/feed','/feed/','/rss','/rss.xml','/atom.xml','/blog/feed']
  UNION ALL SELECT 'index', ['','/blog','/blog/','/articles','/articles/','/resources','/resources/','/news','/news/','/insights','/insights/','/guides','/guides/','/case-studies','/case-studies/','/press','/updates']),
e AS (SELECT kind, unnest(paths) AS path, generate_subscripts(paths, 1) - 1 AS seq FROM k)
SELECT site, kind, CAST(seq AS BIGINT) AS seq, 'https://' || site || path AS url FROM s CROSS JOIN e""",
    "sitemap_entries": f"""{_NODES}
SELECT url, CAST(pages AS BIGINT) AS pages, CAST(children AS BIGINT) AS children FROM nodes""",
    "sitemap_large": """
SELECT CAST(c_nationkey AS BIGINT) AS nation, 'https://n.example.com/blog/order-' || o_orderkey || '?a=1&b=2' AS loc, strftime(o_orderdate, '%Y-%m-%d') AS lastmod
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 5 <> 4""",
    # A packed file that is not told so is no valid text and has no row.
    "sitemap_bodies": f"""{_NODES}
SELECT url, CAST(pages AS BIGINT) AS pages FROM nodes WHERE length(url) % 5 NOT IN (2, 4)""",
    "sitemap_expand": f"WITH {_TREE} SELECT site, url, lastmod, level FROM ({_FOUND_MAPS}) f",
    "sitemap_capped": f"WITH {_TREE} SELECT site, url, lastmod, level FROM ({_FOUND_MAPS}) f QUALIFY row_number() OVER (PARTITION BY site ORDER BY key) <= 3",
    "bfs_links": f"WITH {_CRAWL} SELECT site, url, level FROM crawl",
    "bfs_links_depth": f"WITH {_CRAWL} SELECT site, url, level FROM crawl WHERE level <= 2",
    "bfs_links_resumed": f"WITH {_CRAWL} SELECT site, url, level FROM crawl",
    "sitemap_resumed": f"WITH {_TREE} SELECT site, url, lastmod, level FROM ({_FOUND_MAPS}) f",
    "bfs_links_capped": f"""
WITH {_CRAWL}, first AS (SELECT site, base, min(n0) AS n0, min(n1) AS n1 FROM tree GROUP BY site, base)
SELECT site, url, level FROM crawl WHERE level <= 2
UNION ALL SELECT site, {_node(1, 'n1')}, CAST(3 AS BIGINT) FROM first
UNION ALL SELECT site, base || '/blog/order-' || key, CAST(3 AS BIGINT) FROM tree SEMI JOIN first USING (site, n0)""",
    "feed_links": """
SELECT page_id, CAST(pos AS BIGINT) AS pos, url || suffix AS url FROM pages, (VALUES (0, ''), (1, '/item'), (2, '/atom')) v(pos, suffix) WHERE NOT starts_with(url, 'http:')""",
    "discover_sparse": f"""
WITH {_CRAWL}, maps AS ({_FOUND_MAPS}),
thin AS (SELECT 'c' || c_custkey || '.example.com' AS site FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 5))
SELECT site, url, 'sitemap' AS source FROM maps
UNION ALL SELECT site, url, 'internal_link' FROM crawl WHERE site IN (SELECT site FROM thin)
UNION ALL SELECT site, 'https://' || site || '/blog/', 'rss' FROM thin WHERE site NOT IN (SELECT site FROM crawl)
UNION ALL SELECT site, 'https://news.example.org/' || site, 'rss' FROM thin""",
    "discover_union": f"""
WITH {_CRAWL}, maps AS ({_FOUND_MAPS}),
thin AS (SELECT 'c' || c_custkey || '.example.com' AS site FROM customer)
SELECT site, url, 'sitemap' AS source FROM maps
UNION ALL SELECT site, url, 'internal_link' FROM crawl WHERE (site, url) NOT IN (SELECT (site, url) FROM maps)
UNION ALL SELECT site, 'https://' || site || '/blog/', 'rss' FROM thin WHERE site NOT IN (SELECT site FROM crawl)
UNION ALL SELECT site, 'https://news.example.org/' || site, 'rss' FROM thin""",
    "new_urls": f"""
WITH f AS (SELECT page_id, url, regexp_extract(url, '//[^/]*/([a-z]*)', 1) AS job_id, {_normalized('url')} AS normalized_url FROM pages),
once AS (SELECT job_id, normalized_url, arg_min(url, page_id) AS raw_url FROM f GROUP BY 1, 2)
SELECT job_id, raw_url, normalized_url, NOT {_non_article('raw_url')} AS is_candidate, CASE WHEN {_non_article('raw_url')} THEN 'skipped' ELSE 'queued' END AS status
FROM once WHERE (job_id, normalized_url) NOT IN (SELECT (job_id, normalized_url) FROM f WHERE contains(url, '://m.'))""",
    "new_urls_indexed": f"""
WITH f AS (SELECT page_id, url, regexp_extract(url, '//[^/]*/([a-z]*)', 1) AS job_id, {_normalized('url')} AS normalized_url FROM pages),
once AS (SELECT job_id, normalized_url, arg_min(url, (NOT contains(url, '://m.'), page_id)) AS raw_url FROM f GROUP BY 1, 2)
SELECT job_id, raw_url, normalized_url, NOT {_non_article('raw_url')} AS is_candidate, CASE WHEN {_non_article('raw_url')} THEN 'skipped' ELSE 'queued' END AS status
FROM once""",
    "robots_gate": """
SELECT o_orderkey AS order_key, CASE c_mktsegment
  WHEN 'BUILDING' THEN NOT starts_with(o_orderkey::VARCHAR, '1')
  WHEN 'AUTOMOBILE' THEN starts_with(o_orderkey::VARCHAR, '1')
  WHEN 'HOUSEHOLD' THEN NOT (starts_with(o_orderkey::VARCHAR, '12') OR starts_with(o_orderkey::VARCHAR, '2'))
  ELSE true END AS allowed
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "robots_delay": """
SELECT 'https://c' || c_custkey || '.example.com' AS site_root, CAST(CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'HOUSEHOLD' THEN 3 ELSE 2 END AS BIGINT) AS rules,
  CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 5.0::DOUBLE END AS crawl_delay
FROM customer WHERE c_mktsegment IN ('BUILDING','AUTOMOBILE','MACHINERY','HOUSEHOLD')""",
    "url_safety": f"""
WITH li AS (
  SELECT *, CASE WHEN l_linenumber = 7 THEN 'ftp' WHEN l_linenumber > 3 THEN 'https' ELSE 'http' END || '://' ||
    CASE WHEN l_returnflag = 'R' THEN (l_partkey % 256) || '.' || (l_orderkey % 256) || '.' || (l_suppkey % 256) || '.' || ((l_orderkey * 7 + l_linenumber) % 256)
    WHEN l_returnflag = 'A' THEN 'S' || l_suppkey || '.Example.com:8080'
    WHEN l_linestatus = 'F' THEN '[' || lower(printf('%x', l_partkey % 256 * 256)) || '::' || ((l_orderkey * 7 + l_linenumber) % 256) || ']'
    ELSE 'c' || l_partkey || '.example.com' END || '/blog' AS url FROM lineitem),
judged AS (
  SELECT l_orderkey, l_linenumber, url, CASE WHEN l_linenumber = 7 THEN 'Unsupported scheme'
    WHEN l_returnflag = 'R' THEN CASE WHEN contains(url, '//127.0.0.1/') OR contains(url, '//0.0.0.0/') THEN 'Blocked host' WHEN {_V4_BLOCKED} THEN 'Blocked internal' ELSE 'ok' END
    WHEN l_returnflag = 'A' THEN CASE WHEN s_suppkey IS NULL THEN 'DNS resolution' WHEN s_nationkey < 5 OR s_nationkey IN (6, 7) THEN 'Blocked internal' ELSE 'ok' END
    WHEN l_linestatus = 'F' THEN CASE WHEN l_partkey % 256 BETWEEN 32 AND 63 THEN 'ok' ELSE 'Blocked internal' END
    ELSE 'DNS resolution' END AS verdict
  FROM li LEFT JOIN supplier ON l_suppkey = s_suppkey)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, url, verdict FROM judged""",
    "fetch_results": f"""
WITH {_ATTEMPTS}
SELECT order_key, CAST(attempt AS BIGINT) AS attempt, CASE http_status WHEN 200 THEN NULL WHEN 0 THEN CASE WHEN part % 2 = 0 THEN 'Timeout' ELSE 'Unknown fetch error' END ELSE 'HTTP 500' END AS error,
  CASE WHEN http_status = 200 THEN '<p>' || part ELSE '' END AS html, least(CAST(pow(2, attempt) AS DOUBLE), 10.0::DOUBLE) AS backoff_seconds FROM tried""",
    "final_attempts": f"""
WITH {_ATTEMPTS}
SELECT order_key, CAST(attempt AS BIGINT) AS attempt, CAST(http_status AS BIGINT) AS http_status FROM tried
QUALIFY row_number() OVER (PARTITION BY order_key ORDER BY CASE WHEN http_status = 200 THEN attempt ELSE 100 - attempt END) = 1""",
    "fetch_choice": f"""
WITH {_TOKENS}, counted AS (SELECT page_id, sum({_words('text')}) AS n FROM state WHERE noise = 0 GROUP BY page_id),
both_sides AS (SELECT coalesce(c.page_id, doc_id) AS page_id, n, doc_id, lang FROM counted c FULL JOIN documents ON c.page_id = doc_id),
pick AS (SELECT *, NOT coalesce(n >= 80 OR (n IS NOT NULL AND (doc_id IS NULL OR lang = 'de')), false) AS rendered FROM both_sides)
SELECT page_id, rendered, CAST(CASE WHEN rendered AND lang = 'es' THEN 404 ELSE 200 END AS BIGINT) AS http_status, NOT rendered OR lang <> 'de' AS has_html FROM pick""",
    "job_progress": f"""
WITH {_OWNED},
u AS (SELECT o_custkey, count(*) AS urls_discovered, count(*) FILTER (WHERE o_orderpriority <> '5-LOW') AS identified, count(*) FILTER (WHERE {_STATUS} IN ('queued','failed')) AS pending FROM orders GROUP BY 1),
a AS (SELECT o_custkey, count(*) AS ok, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS words, arg_max(page, (l_shipdate, page)) AS current_url FROM owned WHERE l_returnflag = 'N' GROUP BY 1),
f AS (SELECT o_custkey, count(*) AS bad FROM owned WHERE l_returnflag = 'R' GROUP BY 1),
j AS (SELECT 'job-' || c_custkey AS job_id, coalesce(urls_discovered, 0) AS urls_discovered, coalesce(identified, 0) AS identified, coalesce(pending, 0) AS pending,
  coalesce(ok, 0) AS ok, coalesce(bad, 0) AS bad, coalesce(words, 0) AS words, current_url, coalesce(ok, 0) + coalesce(bad, 0) AS processed
  FROM customer LEFT JOIN u ON c_custkey = u.o_custkey LEFT JOIN a ON c_custkey = a.o_custkey LEFT JOIN f ON c_custkey = f.o_custkey)
SELECT job_id, urls_discovered, identified AS blogs_identified, pending, ok AS blogs_successful, bad AS blogs_failed, words AS total_words_extracted, current_url,
  processed AS blogs_processed, greatest(identified - processed, 0) AS remaining, CASE WHEN identified > 0 THEN {_EVEN} ELSE 0.0::DOUBLE END AS progress_percent FROM j""",
    "url_states": f"""
WITH fails AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey AS order_key, CASE WHEN {_STATUS} <> 'success' AND n > 1 THEN 'permanently_failed' WHEN {_STATUS} <> 'success' AND n = 1 THEN 'failed' ELSE {_STATUS} END AS status,
  coalesce(n, 0) AS retry_count FROM orders LEFT JOIN fails ON o_orderkey = l_orderkey""",
    "job_states": f"""
WITH j AS (SELECT *, CASE WHEN c_nationkey < 8 THEN 'paused' WHEN c_nationkey < 16 THEN 'crawling' ELSE 'completed' END AS status, CASE WHEN c_acctbal < 0 THEN 'boom' END AS err FROM customer),
u AS (SELECT o_custkey, count(*) FILTER (WHERE {_STATUS} <> 'success') AS pending FROM orders GROUP BY 1)
SELECT 'job-' || c_custkey AS job_id, CASE WHEN status = 'paused' THEN 'pending' ELSE status END AS resumed, CASE WHEN status <> 'paused' THEN err END AS error_message,
  CASE WHEN status IN ('paused','crawling') THEN 'cancelled' ELSE status END AS cancelled, CASE WHEN pending > 0 THEN 'paused' ELSE 'completed' END AS after_run
FROM j LEFT JOIN u ON c_custkey = o_custkey""",
    "fetch_outcomes": f"""
WITH {_TOKENS}
SELECT page_id, CASE WHEN starts_with(url, 'http:') THEN CASE WHEN page_id % 5 < 3 THEN 'failed' ELSE 'permanently_failed' END
  WHEN {_non_article('url')} THEN 'skipped' WHEN {_words('structured_content')} >= 50 THEN 'success' ELSE 'partial' END AS status FROM article""",
    "crawl_run": f"WITH {_RUN} SELECT job_id, raw_url, status, confidence, http_status, retry_count, error FROM run",
    "crawl_run_counts": f"""
WITH {_RUN}
SELECT job_id, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'skipped') AS skipped,
  count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'permanently_failed') AS permanently_failed,
  CAST(coalesce(sum(words) FILTER (status IN ('success', 'partial')), 0) AS BIGINT) AS words FROM run GROUP BY job_id""",
    "crawl_run_stored": f"WITH {_RUN} SELECT job_id, raw_url, CAST(words AS BIGINT) AS word_count FROM run WHERE status IN ('success', 'partial')",
    "urls_appended": f"""
SELECT regexp_extract(url, '//[^/]*/([a-z]*)', 1) AS job_id, {_normalized('url')} AS normalized_url, CAST(arg_min(page_id, (page_id % 3, page_id)) AS BIGINT) AS ord, CAST(min(page_id % 3) AS BIGINT) AS batch
FROM pages GROUP BY 1, 2""",
    "crawl_run_resumed": f"""
WITH {_RUN}
SELECT 'articles' AS kind, job_id, raw_url, status AS what FROM run WHERE status IN ('success', 'partial')
UNION ALL SELECT 'failures', job_id, raw_url, error FROM run WHERE status IN ('failed', 'permanently_failed')
UNION ALL SELECT 'states', job_id, raw_url, status || ' ' || retry_count FROM run""",
    "crawl_run_totals": f"""
WITH {_RUN}
SELECT job_id, CAST(count(*) FILTER (status = 'success') AS BIGINT) AS success, CAST(count(*) FILTER (status = 'partial') AS BIGINT) AS partial,
  CAST(count(*) FILTER (status = 'skipped') AS BIGINT) AS skipped, CAST(count(*) FILTER (status = 'failed') AS BIGINT) AS failed,
  CAST(count(*) FILTER (status = 'permanently_failed') AS BIGINT) AS permanently_failed,
  CAST(coalesce(sum(words) FILTER (status IN ('success', 'partial')), 0) AS BIGINT) AS words FROM run GROUP BY job_id""",
    "ip_ranges": """
WITH nets AS (
  SELECT 'k' || lpad(o_orderkey::VARCHAR, 12, '0') AS kind, o_orderkey % 3 < 2 AS v4,
    CASE o_orderkey % 3 WHEN 0 THEN 8 + o_orderkey % 9 WHEN 1 THEN 17 + o_orderkey % 8 ELSE 16 + o_custkey % 100 END AS len,
    CASE o_orderkey % 3 WHEN 0 THEN (o_custkey % 256) * 16777216 WHEN 1 THEN (o_custkey % 256) * 16777216 + (o_orderkey % 256) * 65536 + (o_orderkey * 7 % 256) * 256
      ELSE o_orderkey % 256 END AS n FROM orders),
blocks AS (  -- IPv6 networks begin at a multiple of their size, but for their first byte they are all zeros
  SELECT kind, v4, len, CASE WHEN v4 THEN (n >> (32 - len)) << (32 - len) ELSE n END AS lo FROM nets),
numbered AS (SELECT *, row_number() OVER () AS r FROM lineitem),
found AS (
  SELECT r, l_linenumber % 2 = 0 AS v4, (l_partkey % 256) * 16777216 + (l_orderkey % 256) * 65536 + (l_suppkey % 256) * 256 + (l_orderkey * 7 + l_linenumber) % 256 AS a,
    l_partkey % 256 AS top, (l_orderkey * 7 + l_linenumber) % 256 AS tail FROM numbered WHERE l_linenumber <> 7),
best4 AS (
  SELECT r, arg_min(kind, (-lo, lo + (1::BIGINT << (32 - len)), kind)) AS kind
  FROM found JOIN blocks ON found.v4 AND blocks.v4 AND a >= lo AND a < lo + (1::BIGINT << (32 - len)) GROUP BY ALL),
best6 AS (  -- the last group of an address spells its number in hexadecimal digits, below the length of every network
  SELECT r, arg_max(kind, (len, -CAST(substr(kind, 2) AS BIGINT))) AS kind
  FROM found JOIN blocks ON NOT found.v4 AND NOT blocks.v4 AND top = lo GROUP BY ALL)
SELECT l.l_orderkey, CAST(l.l_linenumber AS BIGINT) AS l_linenumber, coalesce(best4.kind, best6.kind) AS kind
FROM numbered l LEFT JOIN best4 ON l.r = best4.r LEFT JOIN best6 ON l.r = best6.r""",
    "results_page_stored": f"""
WITH {_OWNED}
SELECT 'job-' || o_custkey AS job_id, page AS raw_url, CAST(l_quantity AS BIGINT) AS word_count FROM owned WHERE l_returnflag = 'N'
ORDER BY l_shipdate, page, CAST(l_quantity AS BIGINT), job_id LIMIT 100 OFFSET 200""",
    "article_summaries": f"""
WITH {_EXPORT}
SELECT blog_url, title AS blog_title, source AS author, CASE WHEN lang IN ('en','fr','de') THEN '2026-01-05' ELSE '2026-02-03' END AS publication_date,
  CAST({_words('structured_content')} AS BIGINT) AS word_count, CASE WHEN {_words('structured_content')} >= 50 THEN 'Success' ELSE 'Partial' END AS extraction_status FROM rows1""",
    "failure_summaries": f"""
WITH {_OWNED}
SELECT page AS url, 'HTTP 500' AS error, CAST(500 AS BIGINT) AS http_status, CAST(l_linenumber AS BIGINT) AS retry_count, CAST(l_shipdate AS DATE) AS day FROM owned WHERE l_returnflag = 'R'""",
    "jobs_ready": "SELECT 'job-' || c_custkey AS job_id, c_nationkey >= 16 AND c_acctbal >= 0 AS ready FROM customer",
    "export_jobs": f"""
WITH {_OWNED}, f AS (SELECT 'job-' || o_custkey AS job, page, l_linenumber, l_shipdate FROM owned WHERE l_returnflag = 'R'),
again AS (SELECT DISTINCT job FROM f WHERE job LIKE '%7' AND l_linenumber = 1)
SELECT job || '_failed_urls' AS export, page AS url, CAST(l_linenumber AS BIGINT) AS retry_count, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS at FROM f
WHERE l_linenumber = 1 OR job NOT IN (SELECT job FROM again)""",
    "export_articles_by_job": f"""
WITH {_EXPORT}
SELECT 'job-' || doc_id % 10 || '.example.com_blog_extraction_2026-01-05' AS export, row_number() OVER (PARTITION BY doc_id % 10 ORDER BY doc_id % 100, blog_url) AS id, blog_url,
  structured_content AS main_content FROM rows1""",
    "results_page": f"""
WITH {_OWNED}
SELECT 'job-' || o_custkey AS job_id, page AS raw_url, CAST(l_quantity AS BIGINT) AS word_count FROM owned WHERE l_returnflag = 'N'
ORDER BY l_shipdate, page, CAST(l_quantity AS BIGINT), job_id LIMIT 100 OFFSET 200""",
    "batches": f"SELECT o_orderkey AS order_key, (row_number() OVER (ORDER BY o_orderkey) - 1) // 80 AS batch_id FROM orders WHERE {_STATUS} <> 'success'",
    "batches_per_job": "SELECT 'job-' || o_custkey AS job_id, o_orderkey AS order_key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders",
    "config_snapshot": """
SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 3 <> 0 THEN 'max_concurrent_requests' END, CASE WHEN p_size % 2 <> 0 THEN 'max_urls' END,
  CASE WHEN p_size > 25 THEN 'request_delay_seconds' END) AS kept, p_retailprice AS price FROM part""",
    "failure_export": f"""
WITH {_OWNED}
SELECT page AS url, 'HTTP 500' AS error, CAST(500 AS BIGINT) AS http_status, CAST(l_linenumber AS BIGINT) AS retry_count, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS "timestamp"
FROM owned WHERE l_returnflag = 'R'""",
    "failure_log": f"""
WITH {_ATTEMPTS}
SELECT order_key::VARCHAR AS url, CASE WHEN http_status <> 0 THEN 'HTTP 500' WHEN part % 2 = 0 THEN 'Timeout' ELSE 'Unknown fetch error' END AS error, CAST(http_status AS BIGINT) AS http_status, CAST(attempt + 1 AS BIGINT) AS retry_count FROM tried WHERE http_status <> 200""",
    "export_rows": f"""
WITH {_EXPORT}
SELECT id, 'https://example.com' AS website, blog_url, 'https://example.com/blog/' || doc_id AS canonical_url, title AS blog_title, source AS author,
  CASE lang WHEN 'en' THEN lang || ', ' || source WHEN 'fr' THEN source || ', ' || lang WHEN 'de' THEN NULL ELSE 'a, b' END AS tags,
  CAST({_words('structured_content')} AS BIGINT) AS word_count, E'Factshere\\nFAQ\\nIn Summary' AS h2_headings, CASE WHEN {_words('structured_content')} >= 50 THEN 'Success' ELSE 'Partial' END AS extraction_status,
  CAST(200 AS BIGINT) AS http_status, strftime(make_timestamp((1767225600 + doc_id % 100) * 1000000), '%Y-%m-%dT%H:%M:%S') AS extraction_date,
  nullif(concat_ws('; ', CASE WHEN {_words('tail')} < 50 AND {_words('head')} - 1 + 23 > {_words('tail')} THEN 'Fell back to whole-page text (article body was too short)' END, CASE WHEN {_words('structured_content')} < 50 THEN 'Extracted word count below quality threshold (possible extraction failure)' END), '') AS error_message, CAST(NULL AS VARCHAR) AS subcategory FROM rows1""",
    "export_csv": f"WITH {_EXPORT} SELECT id, blog_url, structured_content AS main_content, 'Why ' || source || '?' AS faq_content FROM rows1",
    "export_names": f"SELECT page_id, {_domain('url')} || '_blog_extraction_2026-01-05' AS articles_name, page_id || '_failed_urls' AS failures_name FROM pages",
    "stream_extract": f"""
WITH {_TOKENS}
SELECT page_id, {_strip(_decode("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))} AS title, CAST({_words('structured_content')} AS BIGINT) AS word_count FROM article JOIN pages USING (page_id)""",
    "stream_distinct_urls": f"SELECT DISTINCT regexp_extract(url, '//[^/]*/([a-z]*)', 1) AS job_id, {_normalized('url')} AS normalized_url FROM pages",
    "stream_counts": f"SELECT regexp_extract(url, '//[^/]*/([a-z]*)', 1) AS job_id, count(*) AS urls_discovered, count(*) FILTER (WHERE NOT {_non_article('url')}) AS blogs_identified FROM pages GROUP BY 1",
}
