"""DuckDB SQL for the queries that SQL can express: quality rules, mixing, repeated strings, near duplicates."""

from __future__ import annotations

from gridloom.llm import jaccard, mixing, quality, suffixes

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _water_fill(name: str, source: str, total: str, weight: str, cap: str, order: str, by: str = "") -> str:
    """CTEs that end in ``name``: the rows of ``source`` with a column target."""
    part = f"PARTITION BY {by}" if by else ""
    prior = f"OVER ({part} ORDER BY ratio, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{name}_r AS (SELECT *, CASE WHEN {weight} > 0 THEN {cap} / {weight} ELSE 0.0 END AS ratio, {total} AS total FROM {source}),
{name}_s AS (SELECT *, coalesce(sum({cap}) {prior}, 0.0) AS capped, coalesce(sum({weight}) {prior}, 0.0) AS spent, sum({weight}) OVER ({part}) AS every FROM {name}_r),
{name}_l AS (SELECT *, CASE WHEN every > spent THEN (total - capped) / (every - spent) END AS level FROM {name}_s),
{name}_f AS (SELECT *, min(CASE WHEN level <= ratio THEN {{'r': ratio, 'l': level}} END) OVER ({part}) AS final FROM {name}_l),
{name} AS (SELECT * EXCLUDE (ratio, total, capped, spent, every, level, final), CASE WHEN final IS NULL THEN {cap} ELSE least({cap}, final.l * {weight}) END AS target FROM {name}_f)"""


_FIRST, _SECOND, _THIRD = (f"{w:.1f}::DOUBLE" for w in mixing.WEIGHTS)
MIXING = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN {_FIRST} WHEN 1 THEN {_SECOND} ELSE {_THIRD} END AS weight, {mixing.MOST}::DOUBLE * source_size AS cap FROM p),
{_water_fill("sources", "w", f"{mixing.SHARE}::DOUBLE * sum(source_size) OVER ()", "weight", "cap", "place")},
sized AS (SELECT *, CASE {" ".join(f"WHEN size < {n} THEN {x}::DOUBLE" for n, x in mixing.TIERS)} ELSE 1.0::DOUBLE END AS tier, row_number() OVER (PARTITION BY source, doc_id, size) - 1 AS num FROM d),
t AS (SELECT z.source, z.tier, CAST(sum(z.size) AS DOUBLE) AS tier_size, any_value(x.source_size) AS source_size, any_value(x.target) AS source_target
      FROM sized z JOIN sources x ON z.source IS NOT DISTINCT FROM x.source GROUP BY z.source, z.tier),
tw AS (SELECT *, tier * tier_size AS tier_weight, {mixing.MOST}::DOUBLE * tier_size AS tier_cap FROM t),
{_water_fill("tiers", "tw", "source_target", "tier_weight", "tier_cap", "tier", "source")},
c AS (SELECT *, CASE WHEN tier_size > 0 THEN least(target / tier_size, {mixing.MOST}::DOUBLE) ELSE 0.0 END AS copies FROM tiers),
plan AS (SELECT source, tier, tier_size, source_size, source_target, floor(copies) AS whole, copies - floor(copies) AS pi FROM c),
opened AS (SELECT source, any_value(source_target) - sum(whole * tier_size) AS opened FROM plan GROUP BY source),
r AS (SELECT z.doc_id, z.source, z.size, z.num, x.source_size, x.source_target, x.whole, x.pi, o.opened,
             (CAST('0x' || substr(md5(concat_ws('|', '{mixing.SEED}', coalesce(CAST(z.doc_id AS VARCHAR), '-'), CAST(z.size AS VARCHAR), CAST(z.num AS VARCHAR))), 1, 12) AS BIGINT)::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
      FROM sized z JOIN plan x ON z.source IS NOT DISTINCT FROM x.source AND z.tier = x.tier JOIN opened o ON z.source IS NOT DISTINCT FROM o.source),
k AS (SELECT *, CASE WHEN pi > 0 AND size > 0 THEN (u / (1 - u)) / (pi / (1 - pi)) END AS rank FROM r),
n AS (SELECT *, sum(CASE WHEN rank IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, size, num ROWS UNBOUNDED PRECEDING) AS done FROM k)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, source_target AS target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE (whole + CASE WHEN rank IS NOT NULL AND done - size / 2.0::DOUBLE <= opened THEN 1 ELSE 0 END) * size END AS BIGINT) AS taken FROM n
"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN ['all ' || md5(array_to_string(w, ' '))] ELSE [] END) AS g FROM d),
sets AS (SELECT DISTINCT doc_id, g FROM x),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sets a JOIN sets b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b, shared = x.n AND shared = y.n AS same FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE shared >= ({jaccard.SIMILARITY} - 1e-6) * (x.n + y.n - shared)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
groups AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
counts AS (SELECT a AS doc_id, count(*) AS n, count(*) FILTER (same) AS c, min(b) FILTER (same) AS low FROM links GROUP BY a)
SELECT doc_id, class_id, least(doc_id, coalesce(low, doc_id)) AS copy_id, CAST(1 + coalesce(c, 0) AS BIGINT) AS n_copies, CAST(coalesce(n, 0) AS BIGINT) AS n_links FROM groups LEFT JOIN counts USING (doc_id)
"""

_N = suffixes.LENGTH
SUFFIXES = f"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(h[2 * i + 1 : 2 * i + {2 * _N}]) AS k FROM (SELECT doc_id, h, unnest(range(n - {_N - 1})) AS i FROM b WHERE n >= {_N})),
twice AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM w SEMI JOIN twice USING (k)),
step AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {_N} THEN 1 ELSE 0 END AS new FROM hit),
run AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS r FROM step),
gone AS (SELECT doc_id, r, min(i) AS s, max(i) + {_N} AS e FROM run GROUP BY doc_id, r),
gap AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS p FROM gone),
kept AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(h[2 * p + 1 : 2 * s], '' ORDER BY s) AS left_h FROM gap JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN last IS NULL THEN h ELSE left_h || h[2 * last + 1 : ] END)) AS kept_sha256 FROM b LEFT JOIN kept USING (doc_id)
"""

_Q = quality
_K = len(_Q.RULES)
_STOPS = ", ".join(f"'{x}'" for x in _Q.STOP_WORDS)


def _side(right: int, prior: str) -> str:
    return f"ln({prior}) + list_sum(list_transform(range(1, {_K + 1}), lambda j: CASE x.votes[j] WHEN {right} THEN ln(acc[j]) WHEN {-right} THEN ln(1 - acc[j]) ELSE 0.0 END))"


_SCORED = f"list_transform(pairs, lambda x: {{'votes': x.votes, 'n': x.n, 'p': 1 / (1 + exp(({_side(-1, '1 - prior')}) - ({_side(1, 'prior')})))}})"
QUALITY = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
lines AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
places AS (SELECT uid, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
win AS (SELECT uid, i, count(*) OVER (PARTITION BY uid, w[i], w[i + 1], w[i + 2]) AS c FROM places),
starts AS (SELECT uid, i, lag(i) OVER (PARTITION BY uid ORDER BY i) AS before FROM win WHERE c > 1),
repeats AS (SELECT uid, sum(least(3, i - coalesce(before, i - 3))) AS n FROM starts GROUP BY uid),
base AS (SELECT uid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
  len(ls) AS n_lines, len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper, len(regexp_extract_all(t, '[0-9]')) AS n_digits,
  len(list_filter(w, lambda x: lower(rtrim(x, '.,')) IN ({_STOPS}))) AS n_stops, len(regexp_extract_all(t, '[.,;:?!]+([\x20\x09-\x0D]|\z)')) AS n_stopped
  FROM lines LEFT JOIN repeats USING (uid)),
voted AS (SELECT *, n_words < {_Q.MIN_WORDS} OR 100 * n_repeat_words > {_Q.MAX_REPEAT_PERCENT} * n_words AS base_failed, CASE WHEN n_words = 0 THEN [0, 0, 0, 0, 0, 0, 0, 0] ELSE [
  CASE WHEN n_words < {_Q.MIN_WORDS} THEN -1 ELSE 0 END, CASE WHEN 10 * n_symbols > n_words THEN -1 ELSE 0 END, CASE WHEN 100 * n_repeat_words > 40 * n_words THEN -1 ELSE 0 END, CASE WHEN 10 * n_dup_lines > 5 * n_lines THEN -1 ELSE 0 END,
  CASE WHEN 10 * n_upper > 3 * word_chars THEN -1 ELSE 0 END, CASE WHEN 10 * n_digits > 2 * word_chars THEN -1 ELSE 0 END,
  CASE WHEN 100 * n_stops < 2 * n_words AND n_words >= 30 THEN -1 WHEN 100 * n_stops >= 6 * n_words THEN 1 ELSE 0 END,
  CASE WHEN 100 * n_stopped < 5 * n_words AND n_words >= 30 OR 10 * n_stopped > 6 * n_words THEN -1 WHEN 100 * n_stopped >= 8 * n_words AND 10 * n_stopped <= 4 * n_words THEN 1 ELSE 0 END] END AS votes FROM base),
patterns AS (SELECT list({{'votes': votes, 'n': n}} ORDER BY votes) AS pairs FROM (SELECT votes, CAST(count(*) AS DOUBLE) AS n FROM voted GROUP BY votes)),
em(i, pairs, prior, acc) AS (
  SELECT 0, pairs, {_Q.PRIOR}::DOUBLE, list_transform(range({_K}), lambda j: {_Q.ACCURACY}::DOUBLE) FROM patterns
  UNION ALL
  SELECT i + 1, pairs,
    least({_Q.MOST}::DOUBLE, greatest(1 - {_Q.MOST}::DOUBLE, (list_sum(list_transform(q, lambda x: x.n * x.p)) + {_Q.WEIGHT * _Q.PRIOR}::DOUBLE) / (list_sum(list_transform(q, lambda x: x.n)) + {_Q.WEIGHT}::DOUBLE))),
    list_transform(range(1, {_K + 1}), lambda j: least({_Q.MOST}::DOUBLE, greatest({_Q.LEAST}::DOUBLE,
      (list_sum(list_transform(q, lambda x: CASE x.votes[j] WHEN 1 THEN x.n * x.p WHEN -1 THEN x.n * (1 - x.p) ELSE 0.0 END)) + {_Q.WEIGHT * _Q.ACCURACY}::DOUBLE)
      / (list_sum(list_transform(q, lambda x: CASE WHEN x.votes[j] <> 0 THEN x.n ELSE 0.0 END)) + {_Q.WEIGHT}::DOUBLE))))
  FROM (SELECT i, pairs, {_SCORED} AS q FROM em WHERE i < {_Q.ROUNDS})),
learned AS (SELECT unnest({_SCORED}) AS x FROM em WHERE i = {_Q.ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND x.p >= {_Q.KEEP} AS kept, round(x.p, 6) AS posterior FROM voted JOIN learned ON voted.votes = x.votes
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality": QUALITY, "op2_mixing": MIXING, "op3_suffixes": SUFFIXES, "op4_jaccard": JACCARD}
