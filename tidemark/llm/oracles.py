"""SQL of the corpus queries from their definitions: plain patterns, windows as strings, tests and dynamic programming spelled out."""

from __future__ import annotations

from tidemark.llm.packing import BUCKETS, BUDGET
from tidemark.llm.secrets import ENCODINGS

SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(list_slice(w, i, i + 19), ' ') ORDER BY doc_id, i) AS n FROM s),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM k WHERE n > 1),
a AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d),
r AS (SELECT a.doc_id, count(g.j) AS n_removed, coalesce(string_agg(CASE WHEN g.j IS NULL THEN x END, ' ' ORDER BY a.j), '') AS kept FROM a LEFT JOIN g ON g.doc_id = a.doc_id AND g.j = a.j GROUP BY a.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""


def _spans(kind: str, order: int, pattern: str, ok: str) -> str:
    """Matches of a kind with their places: the lengths of the pieces and matches in front of each, added up."""
    return f"""SELECT doc_id, '{kind}' AS kind, {order} AS o, v, (list_sum(p[1:k]) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: len(x))), 0))::BIGINT AS a FROM (
 SELECT doc_id, m, p, unnest(m) AS v, generate_subscripts(m, 1) AS k FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, list_transform(string_split_regex(t, '{pattern}'), lambda x: len(x)) AS p FROM d)) WHERE {ok}"""
_NAMED = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?"""
_ENCODINGS = ", ".join(f"({i}, '{n}', '{a}', {len(a)}.0)" for i, (n, _, a) in enumerate(ENCODINGS))
SECRETS = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, kind, o, a, a + len(v) AS e FROM (
{_spans('assign', 0, _NAMED + r'[A-Za-z0-9+/_.=-]+', f"len(regexp_extract(v, '^{_NAMED}([A-Za-z0-9+/_.=-]+)', 1)) >= 6")} UNION ALL
{_spans('access', 1, 'AKIA[A-Z0-9]+', 'len(v) >= 20')} UNION ALL
{_spans('hex', 2, '[0-9a-f]+', 'len(v) >= 24')})),
c AS (SELECT doc_id, a, a + len(v) AS e, regexp_replace(v, '=+$', '') AS body, row_number() OVER () AS token FROM ({_spans('random', 3, '[A-Za-z0-9+/_-]{20,}={0,2}', 'true')})),
f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = c.doc_id AND b.a < c.e AND c.a < b.e)),
enc(rank, enc, abc, k) AS (VALUES {_ENCODINGS}),
t AS (SELECT f.*, x.enc, x.abc, x.k FROM f, LATERAL (SELECT * FROM enc WHERE translate(f.body, enc.abc, '') = '' ORDER BY rank LIMIT 1) x),
kc AS (SELECT token, body, abc, k, len(body)::DOUBLE AS n, unnest(['0123456789', 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '+/-_']) AS of FROM t),
kd AS (SELECT token, sum(CASE WHEN z > 0 THEN power(c - n * z / k, 2) / (n * z / k) ELSE 0 END) AS chi, count(*) FILTER (z > 0) - 1 AS df FROM (SELECT token, k, n, n - len(translate(body, of, '')) AS c, k - len(translate(abc, of, '')) AS z FROM kc) GROUP BY 1),
ch AS (SELECT token, k, pos, (strpos(abc, ch) - 1)::DOUBLE AS v FROM (SELECT token, abc, k, unnest(string_split(body, '')) AS ch, generate_subscripts(string_split(body, ''), 1) AS pos FROM t)),
cn AS (SELECT token, sum(n * n)::DOUBLE AS squares FROM (SELECT token, v, count(*) AS n FROM ch GROUP BY 1, 2) GROUP BY 1),
mn AS (SELECT token, any_value(k) AS k, count(*)::DOUBLE AS n, avg(v) AS mean, sum((v >= k / 2)::INT)::DOUBLE AS above FROM ch GROUP BY 1),
lg AS (SELECT ch.token, ch.v - mean AS u, lag(ch.v - mean) OVER w AS lu, (ch.v >= ch.k / 2) <> lag(ch.v >= ch.k / 2) OVER w AS turn FROM ch JOIN mn ON mn.token = ch.token WINDOW w AS (PARTITION BY ch.token ORDER BY pos)),
ls AS (SELECT token, sum(u * u) AS ss, sum(u * lu) AS lagged, 1 + sum(coalesce(turn, false)::INT) AS runs FROM lg GROUP BY 1),
z AS (SELECT mn.*, (k / n * squares - n - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n) AS z_chi, 2 * above * (n - above) / n + 1 AS mu, runs, ss, lagged FROM mn JOIN cn ON cn.token = mn.token JOIN ls ON ls.token = mn.token),
q AS (SELECT z.token, (df = 0 OR chi <= CASE df WHEN 1 THEN 6.24 WHEN 2 THEN 8.76 ELSE 10.87 END) AND abs(z_chi) <= 2.94 AND CASE WHEN (mu - 1) * (mu - 2) > 0 THEN abs(runs - mu) <= 2.94 * sqrt((mu - 1) * (mu - 2) / (n - 1)) ELSE false END AND CASE WHEN ss > 0 THEN abs(lagged / ss + 1 / n) * sqrt(n) <= 2.94 ELSE false END AS passes, least(z.n, 512)::INT AS n, z.n AS whole FROM z JOIN kd ON kd.token = z.token),
y AS (SELECT t.doc_id, t.a, t.e, t.enc, t.k, q.n, q.whole, q.passes, t.token FROM t JOIN q ON q.token = t.token),
mt AS (SELECT y.enc, any_value(y.k) AS k, ch.v, count(*)::DOUBLE AS m FROM y JOIN ch ON ch.token = y.token WHERE NOT passes GROUP BY y.enc, ch.v),
lk AS (SELECT enc, count(*) * 0.04 / 0.96 AS failed, avg(whole) AS long FROM y WHERE passes GROUP BY 1),
rs AS (SELECT mt.*, greatest(m - coalesce((failed + 3 * sqrt(failed)) * long / k, 0), 0) AS rest FROM mt LEFT JOIN lk ON lk.enc = mt.enc),
en AS (SELECT enc, any_value(k) AS k, log2(sum(m)) - sum(m * log2(m)) / sum(m) AS every, CASE WHEN sum(rest) > 0 THEN log2(sum(rest)) - sum(CASE WHEN rest > 0 THEN rest * log2(rest) ELSE 0 END) / sum(rest) END AS bits FROM rs GROUP BY 1),
sh AS (SELECT enc, least(CASE WHEN bits IS NULL THEN 1.0 ELSE greatest(log2(k) - bits, 0) END, greatest(log2(k) - every, 1.0)) AS d FROM en),
cl AS (SELECT y.enc, n, any_value(k) AS k, count(*) AS tested, sum(passes::INT) AS passing FROM y GROUP BY 1, 2),
p AS (SELECT cl.*, power(2, -coalesce(d, 1.0) * n) AS p FROM cl LEFT JOIN sh ON sh.enc = cl.enc),
up AS (SELECT enc, n, p, sum(passing) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS found FROM p WHERE passing > 0),
ok AS (SELECT enc, n FROM up WHERE p <= (SELECT max(p) FROM up WHERE p <= 0.01 * found / (SELECT sum(tested) FROM cl))),
al AS (SELECT doc_id, kind, o, a, e FROM b UNION ALL SELECT doc_id, 'random', 3, a, e FROM y JOIN ok ON ok.enc = y.enc AND ok.n = y.n WHERE passes),
g AS (SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, o) FILTER (o < 3) AS base, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, o) AS spans FROM al GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
_LUHN = "list_sum(list_transform(list_reverse(string_split(regexp_replace(v, '[^0-9]', '', 'g'), '')), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN 2 * c::INT - 9 ELSE 2 * c::INT END)) % 10 = 0"
_DIGITS = "len(regexp_replace(v, '[^0-9]', '', 'g'))"
PII = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, kind, o, v, a, a + len(v) AS e FROM (
{_spans('email', 0, r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', 'true')} UNION ALL
{_spans('ip', 1, r'[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+', "list_bool_and(list_transform(string_split(v, '.'), lambda x: len(ltrim(x, '0')) <= 3 AND coalesce(try_cast(x AS INT), 999) <= 255))")} UNION ALL
{_spans('card', 2, r'[0-9](?:[\x20-]?[0-9])+', f"{_DIGITS} BETWEEN 16 AND 19 AND {_LUHN}")} UNION ALL
{_spans('phone', 3, r'\+[0-9][\x20().0-9-]+[0-9]', f"{_DIGITS} BETWEEN 8 AND 15")})),
ws AS (SELECT doc_id, p, unnest(m) AS v, generate_subscripts(m, 1) AS k, m FROM (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS m, list_transform(string_split_regex(t, '[^\x20\x09-\x0D]+'), lambda x: len(x)) AS p FROM d)),
wp AS (SELECT doc_id, v, sum(len(v)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(p[k]) OVER (PARTITION BY doc_id ORDER BY k) AS gaps FROM ws),
wd AS (SELECT doc_id, (coalesce(before, 0) + gaps)::BIGINT AS a, len(v) AS whole, regexp_replace(v, '[,.;:!?]$', '') AS x FROM wp),
tm AS (SELECT doc_id, a, a + len(x) AS e, a + whole AS stop, lower(x) AS term FROM wd WHERE regexp_matches(x, '^\p{{L}}[\p{{L}}''-]{{2,}}$')),
bx AS (SELECT b.*, substring(' ' || t || ' ', greatest(0, a - 47) + 1, a + 1 - greatest(0, a - 47)) || '|' || substring(' ' || t || ' ', e + 2, 48) AS context FROM b JOIN d ON d.doc_id = b.doc_id),
nr AS (SELECT b.doc_id, b.kind || ':' || lower(b.v) AS entity, b.context, tm.term, tm.a, tm.e FROM bx b JOIN tm ON tm.doc_id = b.doc_id AND (tm.a >= greatest(0, b.a - 47) AND tm.stop < b.a OR tm.a >= b.e + 1 AND tm.stop < b.e + 48)),
n AS (SELECT count(*)::DOUBLE AS n FROM d),
dt AS (SELECT term, count(DISTINCT doc_id)::DOUBLE AS df FROM tm GROUP BY 1),
en AS (SELECT doc_id, kind || ':' || lower(v) AS entity, context FROM bx), ow AS (SELECT doc_id, entity, min(context) AS context FROM en GROUP BY 1, 2),
ce AS (SELECT entity, count(DISTINCT doc_id)::DOUBLE AS df FROM en GROUP BY 1 HAVING count(DISTINCT context) >= 2),
fr AS (SELECT ow.entity, x.term, count(*)::DOUBLE AS shared, count(DISTINCT ow.context) AS far FROM ow JOIN ce ON ce.entity = ow.entity JOIN (SELECT DISTINCT doc_id, term FROM tm) x ON x.doc_id = ow.doc_id GROUP BY 1, 2),
ns AS (SELECT entity, term, count(DISTINCT context) AS near FROM nr GROUP BY 1, 2),
sc AS (SELECT fr.entity, fr.term FROM fr LEFT JOIN ns ON ns.entity = fr.entity AND ns.term = fr.term JOIN dt ON dt.term = fr.term JOIN ce ON ce.entity = fr.entity, n WHERE (far >= 2 OR near >= 2) AND n > ce.df AND ln(n * shared / (ce.df * greatest(dt.df, shared))) / ln(n / ce.df) >= 0.8),
hit AS (SELECT DISTINCT tm.doc_id, tm.a, tm.e FROM tm JOIN ow ON ow.doc_id = tm.doc_id JOIN sc ON sc.entity = ow.entity AND sc.term = tm.term WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = tm.doc_id AND b.a < tm.e AND tm.a < b.e)),
al AS (SELECT doc_id, kind, o, a, e FROM b UNION ALL SELECT doc_id, 'term', 4, a, e FROM hit),
g AS (SELECT doc_id, {', '.join(f"count(*) FILTER (o = {i}) AS n_{k}" for i, k in enumerate(('email', 'ip', 'card', 'phone')))}, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY o, a) FILTER (o < 4) AS base, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY o, a) AS spans FROM al GROUP BY 1)
SELECT d.doc_id, {', '.join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in ('email', 'ip', 'card', 'phone'))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""


def packing(buckets: int = BUCKETS, budget: int = BUDGET) -> str:
    """Least padding b_k(j) of the j shortest lengths in k buckets, level by level, then back from all lengths to none."""
    levels = "".join(
        f"""
b{k} AS MATERIALIZED (SELECT j, x.v AS v, x.i AS i FROM (SELECT c.j, min({{'v': b.v + c.c, 'i': c.i}}) AS x FROM cost c JOIN b{k - 1} b ON b.j = c.i GROUP BY 1) UNION ALL SELECT 0, 0.0, NULL),"""
        for k in range(1, buckets + 1)
    )
    back = "".join(f"""
t{k - 1} AS MATERIALIZED (SELECT i AS j FROM b{k} JOIN t{k} ON t{k}.j = b{k}.j WHERE i > 0),""" for k in range(buckets, 1, -1))
    return rf"""
WITH d AS (SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents),
g AS (SELECT doc_id, n_tokens, n_tokens AS grid FROM d),
h AS MATERIALIZED (SELECT row_number() OVER (ORDER BY grid) AS j, grid, sum(n) OVER (ORDER BY grid) AS c, sum(n * grid) OVER (ORDER BY grid) AS w FROM (SELECT grid, count(*) AS n FROM g GROUP BY 1)),
p AS (SELECT 0 AS j, 0 AS c, 0 AS w UNION ALL SELECT j, c, w FROM h),
cost AS MATERIALIZED (SELECT p.j AS i, h.j AS j, (h.grid * (h.c - p.c) - (h.w - p.w))::DOUBLE AS c FROM p JOIN h ON p.j < h.j),
b0 AS MATERIALIZED (SELECT 0 AS j, 0.0::DOUBLE AS v),{levels}
t{buckets} AS MATERIALIZED (SELECT max(j) AS j FROM h),{back}
top AS (SELECT grid, row_number() OVER (ORDER BY grid) - 1 AS bucket FROM h WHERE j IN ({" UNION ALL ".join(f"SELECT j FROM t{k}" for k in range(1, buckets + 1))})),
a AS (SELECT g.doc_id, n_tokens, min(top.bucket) AS bucket, min(top.grid) AS bucket_length FROM g JOIN top ON g.grid <= top.grid GROUP BY 1, 2),
r AS (SELECT *, greatest({budget} // greatest(bucket_length, 1), 1)::BIGINT AS batch_rows, row_number() OVER (PARTITION BY bucket ORDER BY md5('pack:' || doc_id), doc_id) - 1 AS before FROM a)
SELECT doc_id, n_tokens, bucket::INT AS bucket, bucket_length::BIGINT AS bucket_length, (before // batch_rows)::BIGINT AS batch, (before % batch_rows)::BIGINT AS place, batch_rows FROM r
"""
