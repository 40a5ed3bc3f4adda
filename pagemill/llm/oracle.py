"""SQL (DuckDB dialect) that gives the rows of the registered queries."""

from __future__ import annotations

import re

from pagemill.llm import quality, secrets

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place FROM documents
), keyed AS (SELECT *, translate(trim(line, {SPACES}), '{UPPER}', '{LOWER}') AS k FROM lines),
frequent AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT keyed.*, coalesce(doc_id <> top, false) AS dropped FROM keyed LEFT JOIN frequent USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

DECONTAMINATION = rf"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), strings AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item_words WHERE len(w) > 0)
), windows AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc_words, (SELECT DISTINCT m FROM strings))
), found AS (SELECT doc_id, i, m, item_id FROM windows JOIN strings USING (m, s)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

NEAR_DEDUP = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, b AS other FROM both_ways UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
least_id AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id,
       doc_id <= coalesce(other, doc_id) AS kept
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN least_id USING (doc_id)
"""


def _stats_sql() -> str:
    """One row per document with the statistics of the quality rules."""
    def gone(chars: str) -> str:
        return f"length(t) - length(translate(t, '{chars}', ''))"

    word = r"""^["''(]*[\p{L}\p{M}][\p{L}\p{M}''-]*[.,;:?)"'']*!?$"""
    return f"""
docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM docs)
), following AS (
  SELECT *, lag(w) OVER d AS before, lead(w) OVER d AS w2, lead(w, 2) OVER d AS w3 FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), windows AS (SELECT *, w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, w2, w3) > 1 AS again FROM following),
covered AS (
  SELECT *, again OR coalesce(lag(again) OVER d, false) OR coalesce(lag(again, 2) OVER d, false) AS inside
  FROM windows WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), by_word AS (
  SELECT doc_id, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars, count(*) FILTER (inside) AS n_repeat_words,
         count(*) FILTER (regexp_matches(w, '{word}')) AS n_plain, count(*) FILTER (w = before) AS n_stutter
  FROM covered GROUP BY doc_id
), by_line AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) AS n_full_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE trim(line, {SPACES}) <> '' GROUP BY doc_id
), stats AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_plain, 0) AS n_plain, coalesce(n_stutter, 0) AS n_stutter, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_full_lines, 0) AS n_full_lines, {gone(quality.SYMBOLS)} AS n_symbols, {gone('!')} AS n_exclaim, {gone('.?!')} AS n_stops,
         length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) AS n_upper
  FROM docs LEFT JOIN by_word USING (doc_id) LEFT JOIN by_line USING (doc_id)
)"""


def quality_sql(tail: str | None = None) -> str:
    """Statistics, votes, EM as a recursive query over the vote patterns, verdicts."""
    k = len(quality.RULES)
    votes = ", ".join(
        f"CASE WHEN n_words = 0 THEN 0 WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v{j}" for j, (_, bad, good) in enumerate(quality.RULES)
    )
    vs = ", ".join(f"v{j}" for j in range(k))
    params = [f"{c}{j}" for j in range(k) for c in "bg"]
    start = ", ".join(f"{quality.START['bad' if p[0] == 'b' else 'good']}::DOUBLE AS {p}" for p in params)
    terms = " + ".join(f"CASE v{j} WHEN -1 THEN ln(g{j} / b{j}) WHEN 1 THEN ln((1 - g{j}) / (1 - b{j})) ELSE 0 END" for j in range(k))
    probability = f"1 / (1 + exp(-(ln((1 - bad) / bad) + {terms})))"
    s = quality.SMOOTH
    sums, rates, fixed = [], [], []
    for j in range(k):
        for c, mass in (("b", "n - q"), ("g", "q")):
            sums += [f"sum(CASE WHEN v{j} = -1 THEN {mass} ELSE 0 END) AS no_{c}{j}", f"sum(CASE WHEN v{j} <> 0 THEN {mass} ELSE 0 END) AS all_{c}{j}"]
            rates.append(f"(no_{c}{j} + {s}) / (all_{c}{j} + 2 * {s}) AS {c}{j}")
            fixed.append(f"CASE WHEN b{j} < g{j} THEN (b{j} + g{j}) / 2 ELSE {c}{j} END AS {c}{j}")
    order = ", ".join(params)
    return f"""
WITH RECURSIVE {_stats_sql()},
votes AS (SELECT *, ({quality.BASE_FAILED}) AS base_failed, {votes} FROM stats),
patterns AS (SELECT {vs}, count(*)::DOUBLE AS n FROM votes WHERE NOT base_failed GROUP BY {vs}),
em AS (
  SELECT 0 AS step, {quality.START_BAD}::DOUBLE AS bad, {start}
  UNION ALL
  SELECT step + 1, bad, {order} FROM (
    SELECT step, bad, {", ".join(fixed)} FROM (
      SELECT step, (total - good + {s}) / (total + 2 * {s}) AS bad, {", ".join(rates)} FROM (
        SELECT step, sum(n) AS total, sum(q) AS good, {", ".join(sums)} FROM (
          SELECT em.step, patterns.*, n * ({probability}) AS q FROM em, patterns WHERE em.step < {quality.ITERATIONS}
        ) GROUP BY step
      )
    )
  )
), last AS (SELECT * FROM em WHERE step = {quality.ITERATIONS}),
judged AS (SELECT votes.*, NOT base_failed AND ({probability}) >= 0.5 AS kept FROM votes, last)
""" + (tail or "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged")


def secrets_sql() -> str:
    """Every rule searched in every text; gaps and hits give the places."""
    parts = []
    for rank, rule in enumerate(secrets.RULES):
        # The other engine knows neither possessive repeats nor a case switch that keeps to ASCII.
        pattern = rule.pattern.replace("}+", "}").replace("]++", "]+").replace("'", "''")
        for word in ("password", "passwd", "secret", "token", "key", "api"):
            pattern = re.sub(rf"(?<![a-z]){word}(?![a-z])", "".join(f"[{c.upper()}{c}]" for c in word), pattern) if rule.kind == "assign" else pattern
        pattern = pattern.replace("(?i:", "(?:")
        least = f"length(regexp_extract(hit, '{pattern}', {rule.group})) >= {rule.least}"
        parts.append(f"""
  SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, upto - length(hit) AS s0, upto AS s1 FROM (
    SELECT doc_id, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS upto FROM (
      SELECT doc_id, unnest(gaps) AS gap, unnest(hits) AS hit, unnest(range(len(gaps))) AS i FROM (
        SELECT doc_id, regexp_extract_all(t, '(?s)(.*?)(?:({pattern})|$)', 1) AS gaps, regexp_extract_all(t, '(?s)(.*?)(?:({pattern})|$)', 2) AS hits
        FROM docs WHERE regexp_matches(t, '{pattern}')))
  ) WHERE hit <> '' AND {least}""")
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(parts)}),
listed AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
         string_agg(kind || ':' || s0 || ':' || s1, ',' ORDER BY s0, rank) FILTER (rank < 3) AS base,
         string_agg(kind || ':' || s0 || ':' || s1, ',' ORDER BY s0, rank) AS spans
  FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (doc_id)
"""


# The checksum is one fold: each byte is followed by eight steps of one bit.
SPELLING = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(r, '{UPPER}', '{LOWER}') AS r, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) GROUP BY ALL
), summed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(bytes, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))),
                        lambda c, s: CASE WHEN s >= 0 THEN xor(c, s) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) AS h
  FROM (SELECT *, flatten(list_transform(string_split(doc_id || ':' || r, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c) - 64] END)) AS bytes FROM runs)
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % 97 = 0 THEN left(r, (h % length(r))::BIGINT) || substr(r, (h % length(r))::BIGINT + 2) ELSE r END AS word FROM summed
  ) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
masks AS (SELECT word, left(word, i - 1) || chr(1) || substr(word, i + 1) AS mask, left(word, i - 1) || substr(word, i + 1) AS cut FROM places),
pairs AS (
  SELECT a.word, b.word AS other FROM masks a JOIN masks b ON a.mask = b.mask AND a.word <> b.word
  UNION SELECT words.word, masks.word FROM masks JOIN words ON masks.cut = words.word
  UNION SELECT masks.word, words.word FROM masks JOIN words ON masks.cut = words.word
), near AS (
  SELECT pairs.word, words.word AS form, words.n AS form_n, count(*) OVER (PARTITION BY pairs.word) AS n_near
  FROM pairs JOIN words ON words.word = pairs.other QUALIFY row_number() OVER (PARTITION BY pairs.word ORDER BY words.n DESC, words.word) = 1
), judged AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n
  FROM words LEFT JOIN near ON words.word = near.word
), chain AS (
  SELECT word, word AS at FROM judged UNION ALL SELECT chain.word, judged.form FROM chain JOIN judged ON chain.at = judged.word WHERE judged.form IS NOT NULL
), roots AS (SELECT chain.word, chain.at AS root FROM chain JOIN judged ON chain.at = judged.word WHERE judged.form IS NULL)
SELECT judged.word, form, root, n, n_near, form_n FROM judged JOIN roots ON judged.word = roots.word
"""

HARD_NEGATIVES = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id, score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER w::INT AS rank, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 50 * p.score AND 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 3
"""


def url_filter_sql(rules: list[tuple[str, str, str]]) -> str:
    """Every rule tested on every URL; the longest that fits wins."""
    listed = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in rules)
    return f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {listed}),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS u FROM pages),
split AS (SELECT page_id, translate(regexp_extract(u, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
numbered AS (SELECT *, row_number() OVER () AS r FROM split),
best AS (
  SELECT r, rule_host || rule_path AS rule, rule_verdict
  FROM numbered JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) = 1
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM numbered LEFT JOIN best USING (r)
"""
