"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

from . import sharding, url_reputation

#: Links among vectors, each pair compared; then reachability.
OP1 = """
WITH RECURSIVE rows_ AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), v AS (
  SELECT * FROM rows_ WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e)
   AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT r, r AS s FROM rows_ UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.s = links.a
), least AS (
  SELECT reach.r, min(o.vec_id) AS component_id FROM reach JOIN rows_ o ON o.r = reach.s GROUP BY reach.r
), n AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id,
       coalesce(vec_id = component_id, false) AS kept
FROM rows_ JOIN least USING (r) LEFT JOIN n USING (r)
"""

#: Whole shingle sets, all pairs that share a shingle; then reachability.
OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh
  FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS o
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), one AS (SELECT a, b FROM pairs WHERE 100 * o >= 75 * (na + nb - o)),
links AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
reach AS (SELECT doc_id, doc_id AS r FROM s UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT s.doc_id, CAST(len(any_value(s.sh)) AS BIGINT) AS n_shingles, min(reach.r) AS component_id
FROM s JOIN reach ON s.doc_id = reach.doc_id GROUP BY s.doc_id
"""


def op10(shards: list[str]) -> str:
    """The lookup table as a literal; tests check the table itself against a plain construction."""
    owner = sharding.fill_table(shards)
    return f"""
SELECT doc_id, slot, CAST(list_extract({owner}, slot + 1) AS INTEGER) AS shard FROM (
  SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) % {len(owner)} AS slot
  FROM documents)
"""


def op5() -> str:
    """The same counts, moments, shrinkage and bound, level by level."""
    two = ", ".join(f"'{s}'" for s in url_reputation.TWO_PART_SUFFIXES)
    parts = f"""
    CASE WHEN len(string_split(host, '.')) < 2 THEN host ELSE array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') END AS two_
"""
    levels = f"""
    CASE WHEN two_ IN ({two}) THEN two_ ELSE string_split(host, '.')[-1] END AS suffix,
    CASE WHEN two_ IN ({two}) THEN array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') ELSE two_ END AS domain
"""
    host = f"""
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_reputation.UPPER}', '{url_reputation.LOWER}'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
"""
    rest = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest"

    def strength(name: str, units: str, rate: str) -> str:
        low, high = url_reputation.LEAST_STRENGTH, url_reputation.MOST_STRENGTH
        return f"""
{name} AS (SELECT least(greatest(coalesce(CASE WHEN q - n1 > 0 THEN (nn - q) / (q - n1) END, {high}), {low}), {high}) AS k FROM (
  SELECT sum(pow(bad - n * {rate}, 2)) AS q, sum(n * n * {rate} * (1 - {rate})) AS nn, sum(n * {rate} * (1 - {rate})) AS n1
  FROM {units} WHERE n > 1))"""

    rules = url_reputation.RULES
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in longest)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in longest)
    return rf"""
WITH p AS (SELECT page_id, url, {host} FROM (SELECT page_id, url, {rest} FROM pages)),
h AS (SELECT *, {levels} FROM (SELECT *, {parts} FROM p)),
l AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels
      WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
o AS (SELECT h.*, l.bad FROM h JOIN l ON TRY_CAST(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:\.html|/)?$', 1), '') AS BIGINT) = l.doc_id),
hosts AS (SELECT host, domain, suffix, count(*) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM o GROUP BY ALL),
domains AS (SELECT domain, suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM domains GROUP BY ALL),
whole AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS rate FROM suffixes),
s0 AS (SELECT suffixes.*, whole.rate FROM suffixes, whole), {strength("ks", "s0", "rate")},
s AS (SELECT suffix, (k * rate + bad) / (k + n) AS s_rate, k + n AS s_n FROM s0, ks),
d0 AS (SELECT domains.*, s_rate FROM domains JOIN s USING (suffix)), {strength("kd", "d0", "s_rate")},
d AS (SELECT domain, (k * s_rate + bad) / (k + n) AS d_rate, k + n AS d_n FROM d0, kd),
h0 AS (SELECT hosts.*, d_rate FROM hosts JOIN d USING (domain)), {strength("kh", "h0", "d_rate")},
hh AS (SELECT host, (k * d_rate + bad) / (k + n) AS h_rate, k + n AS h_n FROM h0, kh),
j AS (SELECT h.page_id, h.host, h.path, coalesce(h_rate, d_rate, s_rate, whole.rate) AS r, coalesce(h_n, d_n, s_n, 0) AS t
      FROM h LEFT JOIN hh USING (host) LEFT JOIN d ON d.domain = h.domain LEFT JOIN s ON s.suffix = h.suffix, whole)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN host <> '' AND greatest(0, r - {url_reputation.Z} * sqrt(r * (1 - r) / (t + 1))) > {url_reputation.BAD_RATE}
       THEN 'block' ELSE 'allow' END AS verdict
FROM j
"""


#: Words, symbols, lines and windows counted anew, each by its definition.
QUALITY_BASE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM t),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS dups FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
win AS (SELECT r, i, [ws[i], ws[i + 1], ws[i + 2]] AS x FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
hit AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY r),
c AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  coalesce(dups, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM t JOIN w USING (r) LEFT JOIN lines USING (r) LEFT JOIN hit USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
"""

#: Targets by filling up: after each round the sources beyond three times their size are full, and the rest share anew.
MIX_TARGETS = r"""
WITH RECURSIVE s AS (SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS size FROM documents GROUP BY source),
k AS (SELECT source, size, 1.0::DOUBLE + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS weight FROM s),
fill AS (
  SELECT 0 AS turn, source, size, weight, false AS full_ FROM k
  UNION ALL
  SELECT turn + 1, source, size, weight, full_ OR weight * unit >= 3 * size FROM (
    SELECT *, (sum(size) OVER () - 3 * coalesce(sum(size) FILTER (full_) OVER (), 0)) / sum(weight) FILTER (NOT full_) OVER () AS unit FROM fill)
  WHERE turn < (SELECT count(*) FROM k)
), last_ AS (SELECT * FROM fill WHERE turn = (SELECT max(turn) FROM fill))
SELECT source, size AS source_size, round(CASE WHEN full_ THEN 3.0 * size ELSE weight * (sum(size) OVER () - 3 * coalesce(sum(size) FILTER (full_) OVER (), 0))
  / sum(weight) FILTER (NOT full_) OVER () END, 6) AS target FROM last_
"""


def pii_base() -> str:
    """Matches by kind, whose places follow from the texts between them; then the tests of each kind."""
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    place = "list_transform(string_split(reverse(d), ''), lambda c, i: CAST(c AS INTEGER) * (1 + (i + 1) % 2))"
    good = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST(right('00' || ltrim(x, '0'), 3) AS INTEGER) > 255)) = 0",
        "card": "length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(luhn, lambda x: x - 9 * CAST(x > 9 AS INTEGER))) % 10 = 0",
        "phone": "length(d) BETWEEN 9 AND 15",
    }
    each = " UNION ALL ".join(
        f"SELECT r, {k} AS rank, '{kind}' AS kind, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS gaps FROM t" for k, (kind, p) in enumerate(kinds.items())
    )
    tests = " ".join(f"WHEN '{kind}' THEN {test}" for kind, test in good.items())
    luhn = f"CASE WHEN kind = 'card' AND length(d) BETWEEN 13 AND 19 THEN {place} END"
    counts = ", ".join(f"count(kind) FILTER (kind = '{k}') AS n_{k}" for k in kinds)
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
e AS ({each}),
f AS (SELECT r, rank, kind, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, generate_subscripts(ms, 1) AS i FROM e WHERE len(ms) > 0),
placed AS (SELECT r, rank, kind, m, {digits} AS d, sum(length(gap) + length(m)) OVER (PARTITION BY r, rank ORDER BY i) AS e_ FROM f),
g AS (SELECT *, CAST(e_ - length(m) AS BIGINT) AS s_ FROM (SELECT *, {luhn} AS luhn FROM placed) WHERE CASE kind {tests} END),
j AS (SELECT doc_id, r, rank, kind, s_, CAST(e_ AS BIGINT) AS e_ FROM t LEFT JOIN g USING (r))
SELECT doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || s_ || ':' || e_, ',' ORDER BY rank, s_), '')) AS base_sha256 FROM j GROUP BY r, doc_id
"""


def oracles(shards: list[str]) -> dict[str, str]:
    whole = {"op1_embedding_near_dedup": OP1, "op5_url_filter": op5(), "op8_ngram_jaccard_join": OP8, "op10_sharding": op10(shards)}
    return whole | {"quality_base": QUALITY_BASE, "mix_targets": MIX_TARGETS, "pii_base": pii_base()}
