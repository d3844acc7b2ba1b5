"""DuckDB SQL of the registered queries, put together from the same parts as their plans."""

from __future__ import annotations

from ..functions import html, stem, text, urls
from ..operators import crawl, graph, index, search

STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


def kept(column: str) -> str:
    runs = rf"list_filter(regexp_extract_all(coalesce({column}, ''), '\p{{L}}+'), lambda x: regexp_full_match(x, '[a-zA-Z]+'))"
    return f"list_filter(list_transform({runs}, lambda x: lower(x)), lambda x: x NOT IN ({STOPS}) AND length(x) > 1)"


def snippets(pairs: str) -> str:
    """Rows (doc_id, t, token) with the snippet at the token's first place, as text.snippet makes it; step by step."""
    around = text.AROUND
    return f"""SELECT doc_id, token, (CASE WHEN start_ > 0 THEN '...' ELSE '' END) || substr(t, start_ + 1, i - start_) || '<strong>' || substr(t, i + 1, m) || '</strong>'
  || (CASE WHEN end_ > i + m THEN substr(t, i + m + 1, end_ - i - m) ELSE '' END) || (CASE WHEN end_ < n THEN '...' ELSE '' END) AS snippet
FROM (SELECT *, CASE WHEN first_ > 0 AND stop_ > i - {around} THEN stop_ + 2 ELSE first_ END AS start_,
    CASE WHEN last_ < n AND ahead > 0 THEN least(i + ahead, n) ELSE last_ END AS end_
  FROM (SELECT *, CASE WHEN back > 0 THEN first_ + length(head) - back - 1 ELSE -1 END AS stop_, least(n, i + m + {around}) AS last_
    FROM (SELECT *, instr(reverse(head), ' .') AS back, instr(substr(t, i + 1, {around}), '.') AS ahead
      FROM (SELECT *, substr(t, first_ + 1, i + 2 - first_) AS head
        FROM (SELECT *, greatest(0, i - {around}) AS first_, length(t) AS n, length(token) AS m
          FROM (SELECT *, instr(low, token) - 1 AS i FROM ({pairs})))))))
WHERE i >= 0"""


def literals(words: list[str]) -> str:
    return ", ".join(html.quoted(w) for w in words)


def marked(column: str, words: list[str]) -> str:
    """Whole words marked: the text in runs of word characters and of others, some of the former wrapped."""
    runs = rf"regexp_extract_all({column}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+')"
    return f"array_to_string(list_transform({runs}, lambda r: CASE WHEN lower(r) IN ({literals(words)}) THEN '<strong>' || r || '</strong>' ELSE r END), '')"


def first_highest(items: str, score: str) -> str:
    """The first of the items x with the highest score."""
    scores = f"list_transform({items}, lambda x: {score})"
    return f"{items}[list_position({scores}, list_max({scores}))]"


def snippet_lists(pairs: str) -> str:
    """CTEs sp and sn: sn has each posting's snippets (doc_id, word, s), three at most."""
    return f"""sp AS ({pairs}), se AS (SELECT tok.doc_id, word, position, snippet FROM tok JOIN sp USING (doc_id, token) JOIN vocab USING (token)),
sn AS (SELECT doc_id, word, CASE WHEN count(*) <= 3 THEN list(snippet ORDER BY position)
  ELSE list(snippet ORDER BY contains(snippet, '.') DESC, length(snippet) DESC, position)[1:3] END AS s FROM se GROUP BY doc_id, word)"""


def best_snippets(words: list[str], name: str) -> str:
    """CTE of (doc_id, snippet): for each document with any of the words, the best of the first word that it has."""
    score = "CASE WHEN NOT contains(lower(x), word) THEN 0 WHEN contains(lower(x), '<strong>' || word || '</strong>') THEN 3 ELSE 1 END"
    return f"""{name} AS (SELECT doc_id, {first_highest("s", score)} AS snippet FROM sn JOIN (VALUES {", ".join(f"('{w}', {i})" for i, w in enumerate(words))}) o(w, ord) ON word = w
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ord) = 1)"""


def phrase_snippets(words: list[str], name: str) -> str:
    """CTE of (doc_id, snippet) for a phrase of two words, of every document that has both."""
    a, b = words
    mark = lambda w: f"20 * CAST(contains(lower(x), '<strong>{w}</strong>') AS INTEGER)"
    order = f"instr(lower(x), '{a}') > 0 AND instr(lower(x), '{b}') >= instr(lower(x), '{a}')"
    score = f"100 * CAST(contains(lower(x), '{a} {b}') AS INTEGER) + CASE WHEN {order} THEN 50 ELSE 0 END + {mark(a)} + {mark(b)}"
    return f"""{name}_c AS (SELECT x.doc_id, CASE WHEN len(list_filter(x.s, lambda i: list_contains(y.s, i))) > 0 THEN list_filter(x.s, lambda i: list_contains(y.s, i)) ELSE x.s[1:1] END AS c
  FROM sn x JOIN sn y ON x.doc_id = y.doc_id WHERE x.word = '{a}' AND y.word = '{b}'),
{name} AS (SELECT doc_id, {first_highest("c", score)} AS snippet FROM {name}_c)"""


def central(items: str, term: str) -> str:
    """The item with the term nearest its middle, a marked one before others."""
    at = f"(instr(lower(x), '{term}') - 1)"
    return first_highest(items, f"CASE WHEN {at} < 0 THEN 0 ELSE 100 - least(100, abs({at} - length(x) // 2)) + 50 * CAST(contains(lower(x), '<strong>{term}</strong>') AS INTEGER) END")


#: (doc_id, field, value lists) of plain documents and of pages.
DOCUMENTS = "SELECT doc_id, '' AS url, '' AS title, 0.0::DOUBLE AS popularity, [{'field': 'body', 'value': text}] AS fields FROM documents"


def pages() -> str:
    heads = f"list_transform({html.sql_headings('html')}, lambda h: {{'field': 'header', 'value': h}})"
    return f"""SELECT page_id AS doc_id, url, {html.sql_title("html")} AS title, 0.0::DOUBLE AS popularity,
      list_concat(list_concat([{{'field': 'title', 'value': {html.sql_title("html")}}}], {heads}), [{{'field': 'body', 'value': {html.sql_body("html")}}}]) AS fields
      FROM pages"""


def base(source: str) -> str:
    """CTEs: src, tok, pos, len_, post, n_, dict."""
    weight = " ".join(f"WHEN '{f}' THEN {w}" for f, w in index.WEIGHTS.items())
    tagged = f"flatten(list_transform(fields, lambda f: list_transform({kept('f.value')}, lambda t: {{'token': t, 'field': f.field}})))"
    return f"""
src AS ({source}),
arr AS (SELECT doc_id, {tagged} AS ts FROM src),
tok AS (SELECT doc_id, t.token AS token, t.field AS field, CAST(p - 1 AS INTEGER) AS position
        FROM (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS p FROM arr)),
vocab AS ({stem.sql_stems("(SELECT DISTINCT token FROM tok)", "token", "word")}),
pos AS (SELECT tok.*, word FROM tok JOIN vocab USING (token)),
len_ AS (SELECT doc_id, count(*) AS length, count(*) FILTER (field = 'title') AS title_length FROM pos GROUP BY doc_id),
post AS (SELECT word, pos.doc_id, CAST(count(*) AS INTEGER) AS frequency, count(*) / any_value(length) AS tf, bool_or(field = 'title') AS in_title,
         sum(CAST(CASE field {weight} END AS DOUBLE)) AS importance_score, CAST(any_value(length) AS INTEGER) AS length,
         any_value(title_length) AS title_length, list(position ORDER BY position) AS positions
         FROM pos JOIN len_ ON pos.doc_id = len_.doc_id GROUP BY word, pos.doc_id),
n_ AS (SELECT count(*) AS n FROM len_),
dict AS (SELECT word, CAST(count(*) AS INTEGER) AS doc_count, ln(any_value(n) / (1 + count(*))) AS idf FROM post, n_ GROUP BY word)"""


def terms(words: list[str], name: str = "cand") -> str:
    times = {w: words.count(w) for w in words}
    qtf = " ".join(f"WHEN '{w}' THEN {n}" for w, n in times.items())
    some = ", ".join(f"'{w}'" for w in times)
    return f"{name} AS (SELECT doc_id, word AS term, tf, in_title, idf, CASE word {qtf} END AS qtf FROM post JOIN dict USING (word) WHERE word IN ({some}))"


def phrase(words: list[str], name: str = "cand") -> str:
    """The phrase by (position - place in the phrase), all places present."""
    places = ", ".join(f"('{w}', {i})" for i, w in enumerate(words))
    return f"""
{name}_hit AS (SELECT doc_id, position - ord AS start_ FROM pos JOIN (VALUES {places}) v(w, ord) ON word = w
  GROUP BY doc_id, position - ord HAVING count(DISTINCT ord) = {len(words)}),
{name}_doc AS (SELECT doc_id, count(*) AS c, min(start_) AS first_ FROM {name}_hit GROUP BY doc_id),
{name} AS (SELECT d.doc_id, '{" ".join(words)}' AS term, c / length AS tf, first_ + {len(words)} <= title_length AS in_title,
  ln((SELECT n FROM n_) / (1 + (SELECT count(*) FROM {name}_doc))) AS idf, 1 AS qtf FROM {name}_doc d JOIN len_ USING (doc_id))"""


def combined(kind: str, left: str, right: str, name: str = "cand") -> str:
    if kind == "NOT":
        return f"{name} AS (SELECT * FROM {left} WHERE doc_id NOT IN (SELECT doc_id FROM {right}))"
    only = f"WHERE doc_id IN (SELECT doc_id FROM {left}) AND doc_id IN (SELECT doc_id FROM {right})" if kind == "AND" else ""
    return f"""{name}_both AS (SELECT *, 1 AS side FROM {left} UNION ALL SELECT *, 0 FROM {right}),
{name} AS (SELECT doc_id, term, arg_max(tf, (tf, side)) AS tf, arg_max(in_title, (tf, side)) AS in_title, arg_max(idf, (tf, side)) AS idf, sum(qtf) AS qtf
  FROM {name}_both {only} GROUP BY doc_id, term)"""


def ranked(source: str, *parts: str) -> str:
    """(doc_id, relevance, popularity, score) with 9 digits."""
    return f"""WITH {base(source)}, {", ".join(parts)},
rel AS (SELECT doc_id, sum(qtf * tf * idf * CASE WHEN in_title THEN {search.TITLE} ELSE 1.0 END) AS r FROM cand GROUP BY doc_id)
SELECT doc_id, round(CAST(r AS DOUBLE), 9) AS relevance, round(popularity, 9) AS popularity,
  round(CAST({search.RELEVANCE} * r + {search.POPULARITY} * popularity AS DOUBLE), 9) AS score FROM rel JOIN src USING (doc_id)"""


def pagerank(pages_cte: str, iterations: int) -> str:
    """CTEs nodes, edges and r0 ... of pg (url, links), the last named ranks."""
    d = graph.DAMPING
    out = f"""{pages_cte},
nodes AS MATERIALIZED (SELECT url, coalesce(len(links), 0) AS out_degree FROM pg),
edges AS MATERIALIZED (SELECT src, dst FROM (SELECT url AS src, unnest(list_distinct(links)) AS dst FROM pg) WHERE dst IN (SELECT url FROM pg)),
cnt AS (SELECT count(*) AS n FROM nodes),
r0 AS MATERIALIZED (SELECT url, 1.0::DOUBLE / n AS pr FROM nodes, cnt)"""
    for k in range(1, iterations + 1):
        o = f"r{k - 1}"
        out += f""",
m{k} AS MATERIALIZED (SELECT coalesce(sum(pr), 0) AS mass FROM {o} JOIN nodes USING (url) WHERE out_degree = 0),
i{k} AS MATERIALIZED (SELECT dst AS url, sum(pr / out_degree) AS inc FROM edges JOIN {o} ON src = {o}.url JOIN nodes ON nodes.url = src GROUP BY dst),
w{k} AS MATERIALIZED (SELECT nodes.url, {1 - d}::DOUBLE / n + {d}::DOUBLE * coalesce(inc, 0) + {d}::DOUBLE * mass / n AS raw
  FROM nodes LEFT JOIN i{k} ON nodes.url = i{k}.url, m{k}, cnt),
r{k} AS MATERIALIZED (SELECT url, raw / (SELECT sum(raw) FROM w{k}) AS pr FROM w{k})"""
    return out + f",\nranks AS (SELECT * FROM r{iterations})"


PARTS = """pg AS MATERIALIZED (
  SELECT CAST(p_partkey AS VARCHAR) AS url, links FROM part LEFT JOIN (
    SELECT l_partkey, list(CAST(next_ AS VARCHAR)) AS links FROM (
      SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS next_
      FROM lineitem WHERE l_returnflag = 'R') WHERE next_ IS NOT NULL GROUP BY l_partkey) ON p_partkey = l_partkey)"""


def hrefs() -> str:
    """(page_id, pos, href, url) of all links of pages, made absolute."""
    shown = html.sql_visible("html")
    each = [f"regexp_extract_all({shown}, {html.quoted(html.HREF)}, {k})" for k in (1, 2, 3)]
    value = "concat(v[1], v[2], v[3])"
    for entity, char in html.SQL_REFERENCES.items():
        value = f"replace({value}, '{entity}', {html.quoted(char)})"
    return f"""SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, {value} AS href, base FROM (
      SELECT page_id, url AS base, unnest(list_zip({", ".join(each)})) AS v, generate_subscripts({each[0]}, 1) AS pos FROM pages)"""


def resolved(base_url: str, href: str) -> str:
    u = f"trim({base_url})"
    part = lambda k: f"regexp_extract({u}, '{urls.SPLIT}', {k})"
    root = f"{part(1)} || '://' || {part(2)}"
    raw = f"trim({href})"
    path = f"regexp_extract({raw}, '^([^?#]*)', 1)"
    rest = f"substr({raw}, length({path}) + 1)"
    folder = f"regexp_replace(CASE WHEN {part(3)} = '' THEN '/' ELSE {part(3)} END, '[^/]*$', '')"
    return f"""CASE WHEN {raw} = '' THEN '' WHEN regexp_matches({raw}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {raw}
      WHEN starts_with({raw}, '//') THEN {part(1)} || ':' || {raw} WHEN starts_with({raw}, '/') THEN {root} || {urls.sql_path(path)} || {rest}
      WHEN starts_with({raw}, '?') THEN {root} || {part(3)} || {raw} WHEN starts_with({raw}, '#') THEN {root} || {part(3)} || {part(4)} || {raw}
      ELSE {root} || {urls.sql_path(f"({folder} || {path})")} || {rest} END"""


def robots_key(url: str) -> str:
    u = f"trim({url})"
    authority = f"regexp_extract({u}, '{urls.SPLIT}', 2)"
    host, port = (f"regexp_extract({authority}, '{urls.AUTHORITY}', {k})" for k in (1, 2))
    scheme = f"regexp_extract({u}, '{urls.SPLIT}', 1)"
    return f"CASE WHEN {scheme} <> '' AND {host} <> '' THEN {scheme} || '://' || {host} || CASE WHEN {port} = ':' THEN '' ELSE {port} END END"


def robots(files: list[str], asked: str = "url") -> str:
    """CTEs rules (key, prefix, allow) and verdicts (page_id, url, allowed) on the urls asked for; a site's file goes by the
    length of its key."""
    cases = " ".join(f"WHEN {i} THEN {html.quoted(f)}" for i, f in enumerate(files))
    value = lambda k: f"trim(substr(line, {len(k) + 1}))"
    return f"""
asked AS (SELECT page_id, {asked} AS url FROM pages),
pk AS (SELECT page_id, url, {robots_key("url")} AS key, regexp_extract(trim(url), '{urls.SPLIT}', 3) AS path FROM asked),
files AS (SELECT key, CASE length(key) % {len(files)} {cases} END AS txt FROM (SELECT DISTINCT {robots_key("url")} AS key FROM pages)),
lines_ AS (SELECT key, n, trim(regexp_replace(line, '[\\r\\t]', ' ', 'g')) AS line FROM (
  SELECT key, unnest(string_split(txt, chr(10))) AS line, generate_subscripts(string_split(txt, chr(10)), 1) AS n FROM files)),
agents AS (SELECT *, last_value(CASE WHEN starts_with(lower(line), 'user-agent:') THEN {value("user-agent:")} END IGNORE NULLS)
  OVER (PARTITION BY key ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS agent FROM lines_),
ours AS (SELECT key, n, CASE WHEN starts_with(lower(line), 'disallow:') THEN {value("disallow:")} ELSE {value("allow:")} END AS prefix,
  starts_with(lower(line), 'allow:') AS allow FROM agents WHERE agent IN ('*', '{crawl.AGENT}')
  AND (starts_with(lower(line), 'disallow:') OR starts_with(lower(line), 'allow:'))),
rules AS (SELECT key, prefix, arg_max(allow, n) AS allow FROM ours WHERE prefix <> '' GROUP BY key, prefix),
verdicts AS (SELECT page_id, any_value(url) AS url, coalesce(arg_max(allow, length(prefix)), true) AS allowed
  FROM pk LEFT JOIN rules ON pk.key = rules.key AND starts_with(path, prefix) GROUP BY page_id)"""
