"""The SQL that states the core's queries, for an independent engine over the same tables."""

from __future__ import annotations

# Spans made from lineitem; runs unchanged in Spark and elsewhere.
GOLD = """SELECT l_orderkey AS doc_id, l_linenumber AS ln, l_linenumber*40 AS s, l_linenumber*40 + 5 + max(l_partkey)%20 AS e,
  max(l_returnflag) AS ty, max(l_suppkey) AS sk, CAST(round(max(l_discount)*100) AS INT)/CAST(10 AS DOUBLE) AS score
FROM lineitem GROUP BY l_orderkey, l_linenumber"""
# Misses (7), shifted, shrunk and grown spans (8), wrong types (9), spans in two parts (11).
PRED = """SELECT doc_id, s, e, ty, score FROM (
  SELECT doc_id, s + CASE WHEN sk%8=1 THEN 2 ELSE 0 END AS s, e + CASE WHEN sk%8=2 THEN -3 WHEN sk%8=3 THEN 6 ELSE 0 END AS e,
    CASE WHEN sk%9=0 THEN CASE WHEN ty='N' THEN 'A' ELSE 'N' END ELSE ty END AS ty, score, (sk%11=0 AND sk%8<>2) AS cut
  FROM gold WHERE sk%7<>0) WHERE NOT cut
UNION ALL SELECT doc_id, s, s+2, ty, score FROM (
  SELECT doc_id, s + CASE WHEN sk%8=1 THEN 2 ELSE 0 END AS s, CASE WHEN sk%9=0 THEN CASE WHEN ty='N' THEN 'A' ELSE 'N' END ELSE ty END AS ty, score
  FROM gold WHERE sk%7<>0 AND sk%11=0 AND sk%8<>2)
UNION ALL SELECT doc_id, s+2, e, ty, score FROM (
  SELECT doc_id, s + CASE WHEN sk%8=1 THEN 2 ELSE 0 END AS s, e + CASE WHEN sk%8=3 THEN 6 ELSE 0 END AS e,
    CASE WHEN sk%9=0 THEN CASE WHEN ty='N' THEN 'A' ELSE 'N' END ELSE ty END AS ty, score
  FROM gold WHERE sk%7<>0 AND sk%11=0 AND sk%8<>2)"""
WINDOWS = """SELECT l_orderkey AS doc_id, CAST(l_suppkey%4 AS INT) AS window_index, l_linenumber*40 AS s, CAST(l_linenumber*40 + 5 + l_partkey%3 AS INT) AS e,
  l_returnflag AS ty, CAST(round(l_discount*100) AS INT)/CAST(10 AS DOUBLE) AS score FROM lineitem"""
HUNDREDTHS = "SELECT (l_suppkey*37 + l_orderkey)%101/CAST(100 AS DOUBLE) AS score, l_partkey%3 = 0 AS correct FROM lineitem"

_L = f"WITH gold AS ({GOLD}), pred AS ({PRED})"

# Letters become x and digits 0, place for place: ASCII classes and word boundaries then do.
_MAPPED = r"regexp_replace(regexp_replace(text, '\p{Nd}', '0', 'g'), '[\p{L}\p{No}\p{Nl}]', 'x', 'g')"
_PATTERNS = {
    # the tail is what a look-behind would keep from starting another match; group 1 is the address
    "EMAIL": r"([\w.+-]+@[\w-]+(?:\.[\w-]+)+)(?:[.+][\w.+-]*)?",
    "PHONE": r"((?:\B\+)?\b\d[\d ().-]{6,}\d\b)",
    "IP_ADDRESS": r"(\b(?:\d{1,3}\.){3}\d{1,3}\b)",
}


def _found(kind: str) -> str:
    p = _PATTERNS[kind]
    return f"""SELECT doc_id, CAST(coalesce(list_sum([length(v) for v in g[1:i]]), 0) + coalesce(list_sum([length(v) for v in x[1:i-1]]), 0) AS INT) AS span_start,
  CAST(coalesce(list_sum([length(v) for v in g[1:i]]), 0) + coalesce(list_sum([length(v) for v in x[1:i-1]]), 0) + length(y[i]) AS INT) AS span_end, '{kind}' AS entity_type
FROM (SELECT doc_id, string_split_regex(m, '{p}') AS g, regexp_extract_all(m, '{p}', 0) AS x, regexp_extract_all(m, '{p}', 1) AS y, unnest(range(1, len(regexp_extract_all(m, '{p}', 0)) + 1)) AS i
  FROM (SELECT doc_id, {_MAPPED} AS m FROM documents WHERE text IS NOT NULL))"""


_RAW = "raw AS (" + " UNION ALL ".join(_found(k) for k in _PATTERNS) + ")"
# Greedy by start, then length, then type: each step takes the first span behind the last one taken.
_RESOLVED = f"""{_RAW},
  ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY span_start, span_start - span_end, entity_type) AS rn FROM raw),
  steps AS (SELECT doc_id, rn, span_start, span_end, entity_type FROM ranked WHERE rn = 1
    UNION ALL SELECT r.doc_id, r.rn, r.span_start, r.span_end, r.entity_type FROM steps p JOIN ranked r ON r.doc_id = p.doc_id
      AND r.rn = (SELECT min(q.rn) FROM ranked q WHERE q.doc_id = p.doc_id AND q.rn > p.rn AND q.span_start >= p.span_end)),
  resolved AS (SELECT doc_id, span_start, span_end, entity_type FROM steps)"""

_SPANS = """sp AS (SELECT row_id, s['start'] AS s, s['end'] AS e, s['entity_type'] AS ty, n FROM (SELECT row_id, unnest(spans) AS s, length(text) AS n FROM dataset_examples WHERE text IS NOT NULL)),
  bad AS (SELECT DISTINCT row_id FROM (SELECT *, lag(e) OVER (PARTITION BY row_id ORDER BY s, e, ty) AS pe FROM sp)
    WHERE NOT coalesce(s >= 0 AND s < e AND e <= n AND trim(ty) <> '', false) OR s < pe),
  ann AS (SELECT * FROM dataset_examples WHERE spans IS NOT NULL AND text IS NOT NULL AND row_id NOT IN (SELECT row_id FROM bad)),
  asp AS (SELECT row_id, s, e, ty FROM sp WHERE row_id NOT IN (SELECT row_id FROM bad))"""
_A = f"WITH {_SPANS}"

_FOLD = "replace(translate(lower({0}), 'ςſ', 'σs'), 'ß', 'ss')"
for _a, _b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
    _FOLD = f"replace({_FOLD}, '{_a}', '{_b}')"


def _normal(c: str) -> str:
    return rf"trim(regexp_replace({_FOLD.format(c)}, '[\s\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g'))"


_P, _R = "tp / CAST(tp + fp AS DOUBLE)", "tp / CAST(tp + fn AS DOUBLE)"


def _scores(prefix: str) -> str:
    return f"""coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS {prefix}precision, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS {prefix}recall,
  coalesce(2 * ({_P}) * ({_R}) / nullif(({_P}) + ({_R}), 0), 0) AS {prefix}f1"""


_HITS = "hits AS (SELECT count(*) AS tp FROM (SELECT doc_id, s, e, ty FROM gold INTERSECT SELECT doc_id, s, e, ty FROM pred))"
_SIZES = "sizes AS (SELECT (SELECT count(*) FROM gold) AS ng, (SELECT count(*) FROM (SELECT DISTINCT doc_id, s, e, ty FROM pred)) AS np, (SELECT count(*) FROM pred) AS npr)"
_KEPT = "kept AS (SELECT doc_id, s, e, ty FROM gold INTERSECT SELECT doc_id, s, e, ty FROM pred)"
_LEAK = "lk AS (SELECT count(*) AS leaked FROM (SELECT g.doc_id, g.ln, g.e - g.s AS n, count(DISTINCT c) AS k FROM (SELECT *, unnest(range(s, e)) AS c FROM gold) g SEMI JOIN (SELECT doc_id, unnest(range(s, e)) AS c FROM pred) p USING (doc_id, c) GROUP BY ALL) WHERE k = n)"
_CHARS = "gc AS (SELECT DISTINCT doc_id, unnest(range(s, e)) AS c FROM gold), pc AS (SELECT DISTINCT doc_id, unnest(range(s, e)) AS c FROM pred)"


def _calibrated(rows: str, by: str, bins: int) -> str:
    group = f"{by}, " if by else ""
    return f"""SELECT {group}CAST(sum(n) AS BIGINT) AS predictions, round(sum(abs(ok - p)) / CAST(sum(n) AS DOUBLE), 6) AS ece FROM (
  SELECT {group}b, count(*) AS n, sum(score) AS p, sum(CAST(correct AS INT)) AS ok FROM ({rows}) r
  JOIN (SELECT unnest(range({bins})) AS b) bins ON score >= b / CAST({bins} AS DOUBLE) AND score < (b + 1) / CAST({bins} AS DOUBLE) OR b = {bins} - 1 AND score = 1
  GROUP BY ALL) {"GROUP BY " + by if by else ""}"""


_CORRECT = "SELECT p.ty AS entity_type, p.score, g.ln IS NOT NULL AS correct FROM pred p LEFT JOIN gold g ON g.doc_id = p.doc_id AND g.s = p.s AND g.e = p.e AND g.ty = p.ty"
_GRID = "(SELECT CASE WHEN i = 20 THEN 1.0 ELSE round(i * CAST(0.05 AS DOUBLE), 10) END AS t FROM (SELECT unnest(range(21)) AS i))"
_SWEEP = f"""{_L}, grid AS {_GRID}, cut AS (SELECT CAST(t AS DOUBLE) AS t, p.* FROM grid, pred p WHERE score >= t),
  gc AS (SELECT DISTINCT doc_id, unnest(range(s, e)) AS c FROM gold), docs AS (SELECT DISTINCT doc_id FROM gold),
  n AS (SELECT t, count(*) AS npr FROM cut GROUP BY t), nd AS (SELECT t, count(*) AS np FROM (SELECT DISTINCT t, doc_id, s, e, ty FROM cut) GROUP BY t),
  h AS (SELECT t, count(*) AS tp FROM (SELECT DISTINCT t, c.doc_id, c.s, c.e, c.ty FROM cut c SEMI JOIN gold g USING (doc_id, s, e, ty)) GROUP BY t),
  pc AS (SELECT DISTINCT t, doc_id, unnest(range(s, e)) AS c FROM cut),
  ok AS (SELECT t, count(*) AS ok FROM (SELECT t, g.doc_id, g.ln, g.e - g.s AS n, count(*) AS k FROM (SELECT *, unnest(range(s, e)) AS c FROM gold) g JOIN pc USING (doc_id, c) GROUP BY t, g.doc_id, g.ln, g.e - g.s) WHERE k = n GROUP BY t),
  fp AS (SELECT t, count(*) AS f FROM pc ANTI JOIN gc USING (doc_id, c) GROUP BY t),
  tot AS (SELECT (SELECT count(*) FROM gold) AS ng, (SELECT count(*) FROM docs) * 400 - (SELECT count(*) FROM gc) AS free),
  s AS (SELECT CAST(grid.t AS DOUBLE) AS threshold, ng, free, coalesce(npr, 0) AS predictions, coalesce(tp, 0) AS tp, coalesce(np, 0) - coalesce(tp, 0) AS fp, ng - coalesce(tp, 0) AS fn, ng - coalesce(ok, 0) AS leaked, coalesce(f, 0) AS f
    FROM grid CROSS JOIN tot LEFT JOIN n USING (t) LEFT JOIN nd USING (t) LEFT JOIN h USING (t) LEFT JOIN ok USING (t) LEFT JOIN fp USING (t))"""

# How each perturbation rewrites a text.
_PERTURB = {
    "lowercase": "array_to_string(list_transform(string_split({0}, ''), lambda x: lower(x)), '')", "uppercase": "array_to_string(list_transform(string_split({0}, ''), lambda x: upper(CASE x WHEN 'ß' THEN 'SS' WHEN 'ﬁ' THEN 'FI' WHEN 'ﬂ' THEN 'FL' WHEN 'ﬀ' THEN 'FF' WHEN 'ﬃ' THEN 'FFI' ELSE x END)), '')",
    "double_spaces": "replace({0}, ' ', '  ')", "nbsp_spaces": "replace({0}, ' ', chr(160))", "unicode_dashes": "replace({0}, '-', chr(8211))", "curly_apostrophes": "replace({0}, '''', chr(8217))",
}


def _perturbed(name: str) -> str:
    f = _PERTURB[name]
    return f"""{_A} SELECT row_id, CAST(length({f.format("text")}) AS INT) AS n, CAST(length({f.format("substring(text, 1, s)")}) AS INT) AS span_start, CAST(length({f.format("substring(text, 1, e)")}) AS INT) AS span_end
FROM ann LEFT JOIN asp USING (row_id) WHERE {f.format("text")} <> text"""


_BIO = rf"""words AS (SELECT row_id, CAST(sum(n + gap) OVER (PARTITION BY row_id ORDER BY i) - n AS BIGINT) AS a, n FROM (
    SELECT row_id, unnest(range(len(x))) AS i, unnest([length(v) for v in x]) AS n, unnest([length(v) for v in g[1:len(x)]]) AS gap FROM (
      SELECT row_id, string_split_regex(text, '[^\s\x1c-\x1f\x{{85}}\p{{Z}}]+') AS g, regexp_extract_all(text, '[^\s\x1c-\x1f\x{{85}}\p{{Z}}]+', 0) AS x FROM ann))),
  edges AS (SELECT row_id, a AS c, a, a + n AS z FROM words UNION SELECT w.row_id, x.c, w.a, w.a + w.n FROM words w JOIN (SELECT row_id, s AS c FROM asp UNION SELECT row_id, e FROM asp) x ON x.row_id = w.row_id AND x.c > w.a AND x.c < w.a + w.n),
  pieces AS (SELECT row_id, c AS a, coalesce(lead(c) OVER (PARTITION BY row_id, a ORDER BY c), z) AS z FROM edges),
  labels AS (SELECT p.row_id, p.a, p.z, CASE WHEN s IS NULL THEN 'O' WHEN s = p.a THEN 'B-' || ty ELSE 'I-' || ty END AS label FROM pieces p LEFT JOIN asp ON asp.row_id = p.row_id AND s <= p.a AND p.z <= e)"""

_HASH = "md5('42:' || CAST(row_id AS VARCHAR))"
_JSON_SPAN = """'{"start":' || s || ',"end":' || e || ',"entity_type":"' || ty || '"}'"""
_TARGETS = f"""targets AS (SELECT row_id, '{{"spans":[' || coalesce(string_agg({_JSON_SPAN}, ',' ORDER BY s, e, ty), '') || ']}}' AS target FROM ann LEFT JOIN asp USING (row_id) GROUP BY row_id)"""


def _thresholds(profile: dict[str, float]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in profile.items())
    return f"SELECT row_id, window_index, span_start, span_end, entity_type, score FROM window_predictions WHERE score IS NULL OR score >= CAST(CASE entity_type {cases} ELSE 0 END AS DOUBLE)"


def _duplicates(key: str) -> str:
    return f"""SELECT split AS part, count(*) AS target_examples, count(*) FILTER (WHERE hit) AS matching_examples, count(*) FILTER (WHERE hit) / CAST(count(*) AS DOUBLE) AS rate FROM (
  SELECT split, {key} IN (SELECT {key} FROM dataset_examples WHERE split = 'train') AS hit FROM dataset_examples WHERE split <> 'train') GROUP BY split"""


_CLEAN = r"'[\s\x1c-\x1f\x{85}\p{Z}]+'"
# Annotated rows with their merged window predictions: gold(doc_id, ln, s, e, ty), pred(doc_id, s, e, ty, score), docs(doc_id, n).
_ROWS = "gold AS (SELECT row_id AS doc_id, row_number() OVER (PARTITION BY row_id ORDER BY s, e, ty) AS ln, s, e, ty FROM asp), docs AS (SELECT row_id AS doc_id, length(text) AS n, text, source FROM ann)"


def _survivors(name: str, source: str, by: str, wins: str) -> str:
    """Visits spans in order and compares each with the last survivor."""
    cols = ("s", "e", "ty", "window_index", "score")
    take = ", ".join(f"CASE WHEN n.s < r.e AND r.s < n.e AND NOT ({wins}) THEN r.{c} ELSE n.{c} END AS {c}" for c in cols)
    return f"""{name}_o AS (SELECT doc_id, {", ".join(cols)}, row_number() OVER (PARTITION BY {by} ORDER BY s, e, ty) AS rn FROM {source}),
  {name}_r AS (SELECT doc_id, {", ".join(cols)}, rn, 1 AS g FROM {name}_o WHERE rn = 1 UNION ALL
    SELECT r.doc_id, {take}, n.rn, CASE WHEN n.s < r.e AND r.s < n.e THEN r.g ELSE r.g + 1 END FROM {name}_r r JOIN {name}_o n ON n.doc_id = r.doc_id AND n.rn = r.rn + 1 {"AND n.ty = r.ty" if "ty" in by else ""}),
  {name} AS (SELECT doc_id, {", ".join(cols)} FROM {name}_r QUALIFY row_number() OVER (PARTITION BY {by}, g ORDER BY rn DESC) = 1)"""


def _merge(windows: str) -> str:
    """The three passes over ``windows`` (doc_id, window_index, s, e, ty, score); the last is ``apart``."""
    rank = "(coalesce({0}.score, -1), {0}.e - {0}.s, -{0}.window_index)"
    n, r = rank.format("n"), rank.format("r")
    first = "CASE WHEN n.ty = r.ty THEN false WHEN starts_with(n.ty, r.ty) THEN true WHEN starts_with(r.ty, n.ty) THEN false ELSE n.ty < r.ty END"
    return f"""once AS (SELECT * FROM ({windows}) QUALIFY row_number() OVER (PARTITION BY doc_id, s, e, ty ORDER BY score DESC NULLS LAST, window_index) = 1),
  {_survivors("same", "once", "doc_id, ty", f"{n} > {r}")}, {_survivors("apart", "same", "doc_id", f"{n} > {r} OR {n} = {r} AND {first}")}"""


_STORED = "SELECT row_id AS doc_id, window_index, span_start AS s, span_end AS e, entity_type AS ty, score FROM window_predictions"
_B = f"WITH RECURSIVE {_SPANS}, {_ROWS}, {_merge(_STORED)}, pred AS (SELECT a.doc_id, a.s, a.e, a.ty, a.score FROM apart a SEMI JOIN docs USING (doc_id))"


def _measured(pred: str = "pred", to: str = "m") -> str:
    """Measures of every document of ``docs`` as table ``to``."""
    return f"""{to}_x AS (SELECT doc_id, count(*) AS exact_tp FROM (SELECT doc_id, s, e, ty FROM gold INTERSECT SELECT doc_id, s, e, ty FROM {pred}) GROUP BY doc_id),
  {to}_d AS (SELECT doc_id, count(*) AS npd FROM (SELECT DISTINCT doc_id, s, e, ty FROM {pred}) GROUP BY doc_id), {to}_gd AS (SELECT doc_id, count(*) AS ngd FROM (SELECT DISTINCT doc_id, s, e, ty FROM gold) GROUP BY doc_id),
  {to}_n AS (SELECT doc_id, count(*) AS n_pred FROM {pred} GROUP BY doc_id), {to}_g AS (SELECT doc_id, count(*) AS n_gold FROM gold GROUP BY doc_id),
  {to}_pc AS (SELECT DISTINCT doc_id, unnest(range(s, e)) AS c FROM {pred}), {to}_gc AS (SELECT DISTINCT doc_id, unnest(range(s, e)) AS c FROM gold),
  {to}_l AS (SELECT doc_id, count(*) AS leaked FROM (SELECT g.doc_id, g.ln, count(p.c) AS k, count(*) AS n FROM (SELECT doc_id, ln, unnest(range(s, e)) AS c FROM gold) g LEFT JOIN {to}_pc p USING (doc_id, c) GROUP BY ALL) WHERE k < n GROUP BY doc_id),
  {to}_f AS (SELECT doc_id, count(*) AS fp_chars FROM {to}_pc ANTI JOIN {to}_gc USING (doc_id, c) GROUP BY doc_id), {to}_c AS (SELECT doc_id, count(*) AS gold_chars FROM {to}_gc GROUP BY doc_id),
  {to} AS (SELECT doc_id, source, coalesce(n_gold, 0) AS n_gold, coalesce(n_pred, 0) AS n_pred, coalesce(ngd, 0) AS ngd, coalesce(npd, 0) AS npd, coalesce(exact_tp, 0) AS exact_tp, coalesce(leaked, 0) AS leaked, coalesce(fp_chars, 0) AS fp_chars, n - coalesce(gold_chars, 0) AS non_pii
    FROM docs LEFT JOIN {to}_x USING (doc_id) LEFT JOIN {to}_d USING (doc_id) LEFT JOIN {to}_gd USING (doc_id) LEFT JOIN {to}_n USING (doc_id) LEFT JOIN {to}_g USING (doc_id) LEFT JOIN {to}_l USING (doc_id) LEFT JOIN {to}_f USING (doc_id) LEFT JOIN {to}_c USING (doc_id))"""


_TOTALS = """count(*) AS examples, CAST(sum(n_gold) AS BIGINT) AS gold, CAST(sum(n_pred) AS BIGINT) AS predicted, CAST(sum(exact_tp) AS BIGINT) AS exact_tp, CAST(sum(npd) - sum(exact_tp) AS BIGINT) AS xfp, CAST(sum(ngd) - sum(exact_tp) AS BIGINT) AS xfn,
  CAST(sum(leaked) AS BIGINT) AS leaked, CAST(sum(fp_chars) AS BIGINT) AS fp_chars, CAST(sum(non_pii) AS BIGINT) AS non_pii"""
_RATES = """coalesce(2 * (exact_tp / nullif(CAST(exact_tp + xfp AS DOUBLE), 0)) * (exact_tp / nullif(CAST(exact_tp + xfn AS DOUBLE), 0)) / nullif(exact_tp / nullif(CAST(exact_tp + xfp AS DOUBLE), 0) + exact_tp / nullif(CAST(exact_tp + xfn AS DOUBLE), 0), 0), 0) AS exact_f1,
  coalesce(leaked / nullif(CAST(gold AS DOUBLE), 0), 0) AS leak_rate, coalesce(fp_chars / nullif(CAST(non_pii AS DOUBLE), 0), 0) AS over_redaction_rate"""
# The greedy matching of partial hits, each step by the next pair in order.
_PARTIAL = """pg AS (SELECT doc_id, s, e, ty, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, ty) AS i FROM gold), pp AS (SELECT doc_id, s, e, ty, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, ty, score) AS j FROM pred),
  pairs AS (SELECT g.doc_id, i, j, row_number() OVER (PARTITION BY g.doc_id ORDER BY -(least(g.e, p.e) - greatest(g.s, p.s)), abs(g.s - p.s) + abs(g.e - p.e), i, j) AS rn FROM pg g JOIN pp p ON p.doc_id = g.doc_id AND p.ty = g.ty AND g.s < p.e AND p.s < g.e),
  taken AS (SELECT doc_id, rn, [i] AS gs, [j] AS ps FROM pairs WHERE rn = 1 UNION ALL
    SELECT r.doc_id, c.rn, CASE WHEN list_contains(gs, i) OR list_contains(ps, j) THEN gs ELSE list_append(gs, i) END, CASE WHEN list_contains(gs, i) OR list_contains(ps, j) THEN ps ELSE list_append(ps, j) END FROM taken r JOIN pairs c ON c.doc_id = r.doc_id AND c.rn = r.rn + 1),
  partial AS (SELECT doc_id, max(len(gs)) AS partial_tp FROM taken GROUP BY doc_id)"""


def _cuts(profile: dict[str, float], name: str, source: str = "pred") -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in profile.items())
    return f"{name} AS (SELECT * FROM {source} WHERE score IS NULL OR score >= CAST({f'CASE ty {cases} ELSE 0 END' if profile else '0'} AS DOUBLE))"


def _adapter(prefix: str, label: str, known: str, kept: str) -> str:
    """What an adapter makes of records of annotated rows: spans of kept types, or null where a rule is broken."""
    return f"""WITH r AS (SELECT row_id, text, language, spans FROM dataset_examples WHERE spans IS NOT NULL AND text IS NOT NULL),
  sp AS (SELECT row_id, s['start'] AS s, s['end'] AS e, s['entity_type'] AS ty, n FROM (SELECT row_id, length(text) AS n, unnest(spans) AS s FROM r)), t AS (SELECT *, {label} AS kind FROM sp),
  bad AS (SELECT DISTINCT row_id FROM t WHERE NOT coalesce(s >= 0 AND e > s AND e <= n AND {known}, false)), kept AS (SELECT * FROM t WHERE {kept}),
  clash AS (SELECT DISTINCT row_id FROM (SELECT row_id, s, lag(e) OVER (PARTITION BY row_id ORDER BY s, e, kind) AS pe FROM kept) WHERE s < pe),
  k AS (SELECT row_id, count(*) AS n, sum(e - s) AS c FROM kept GROUP BY row_id),
  o AS (SELECT r.row_id, regexp_replace(text, {_CLEAN}, '', 'g') <> '' AND coalesce(regexp_replace(language, {_CLEAN}, '', 'g') <> '', false) AND r.row_id NOT IN (SELECT row_id FROM bad) AND r.row_id NOT IN (SELECT row_id FROM clash) AS ok FROM r)
  SELECT '{prefix}' || row_id AS example_id, ok, CASE WHEN ok THEN CAST(coalesce(n, 0) AS INT) END AS n_spans, CASE WHEN ok THEN CAST(coalesce(c, 0) AS BIGINT) END AS characters FROM o LEFT JOIN k USING (row_id)"""


def _words(source: str, key: str) -> str:
    """Words without white space of ``source``: key, a (where it begins), n (letters), w."""
    return rf"""SELECT {key}, CAST(sum(n + gap) OVER (PARTITION BY {key} ORDER BY i) - n AS BIGINT) AS a, n, w FROM (
  SELECT {key}, unnest(range(len(x))) AS i, unnest(x) AS w, unnest([length(v) for v in x]) AS n, unnest([length(v) for v in g[1:len(x)]]) AS gap FROM (
    SELECT {key}, string_split_regex(text, '[^\s\x1c-\x1f\x{{85}}\p{{Z}}]+') AS g, regexp_extract_all(text, '[^\s\x1c-\x1f\x{{85}}\p{{Z}}]+', 0) AS x FROM {source}))"""


def more() -> dict[str, str]:
    """SQL of adapters, stored window predictions, and tokenizer-dependent steps with a tokenizer of some letters a token."""
    from ..operators import normalize, taxonomy
    from ..operators.calibrate import ANCHORS
    from ..operators.redact import PROFILES
    from .catalogue import LABEL_IDS, masking_label

    out: dict[str, str] = {}
    mapped = "CASE upper(replace(replace(trim(ty), '-', '_'), ' ', '_')) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in taxonomy.LABELS.items()) + " END"
    for name, prefix in (("openpii", "openpii-"), ("gretel", "gretel-finance-")):
        out[f"adapter_{name}"] = _adapter(prefix, mapped, "kind IS NOT NULL", "true")
    some = ", ".join(f"'{t}'" for t in taxonomy.TYPES if masking_label(t) in taxonomy.MASKING_LABELS)
    out["adapter_masking"] = _adapter("ai4privacy-", "ty", "ty IN (" + ", ".join(f"'{t}'" for t in taxonomy.TYPES) + ")", f"kind IN ({some})")
    left, right = (", ".join("'" + x.replace("'", "''") + "'" for x in xs) for xs in (normalize.ATTACH_LEFT, normalize.NO_SPACE_AFTER))
    out["adapter_conll"] = f"""{_A}, {_BIO}, t AS (SELECT l.row_id, l.a, substring(text, l.a + 1, l.z - l.a) AS w, CASE label WHEN 'B-PERSON' THEN 'B' WHEN 'I-PERSON' THEN 'I' ELSE 'O' END AS tag FROM labels l JOIN ann USING (row_id)),
  u AS (SELECT *, lag(w) OVER o AS pw, lag(tag) OVER o AS pt FROM t WINDOW o AS (PARTITION BY row_id ORDER BY a)),
  v AS (SELECT *, sum(length(w) + CASE WHEN pw IS NULL OR w IN ({left}) OR pw IN ({right}) THEN 0 ELSE 1 END) OVER (PARTITION BY row_id ORDER BY a) AS z, sum(CASE WHEN tag = 'I' AND pt IN ('B', 'I') THEN 0 ELSE 1 END) OVER (PARTITION BY row_id ORDER BY a) AS island FROM u),
  runs AS (SELECT row_id, CAST(min(z - length(w)) AS INT) AS span_start, CAST(max(z) AS INT) AS span_end FROM v WHERE tag <> 'O' GROUP BY row_id, island), n AS (SELECT row_id, CAST(max(z) AS INT) AS n FROM v GROUP BY row_id)
  SELECT 'conll2003-' || row_id AS example_id, n, span_start, span_end FROM n LEFT JOIN runs USING (row_id)"""

    out["window_predictions_merged"] = f"{_B} SELECT doc_id AS row_id, CAST(s AS INT) AS span_start, CAST(e AS INT) AS span_end, ty AS entity_type FROM pred"
    out["document_scores"] = f"""{_B}, {_measured()}, {_PARTIAL} SELECT doc_id AS row_id, CAST(n_gold AS INT) AS n_gold, CAST(n_pred AS INT) AS n_pred, CAST(exact_tp AS INT) AS exact_tp, CAST(coalesce(partial_tp, 0) AS INT) AS partial_tp,
  CAST(leaked AS INT) AS leaked, CAST(fp_chars AS INT) AS fp_chars, CAST(non_pii AS INT) AS non_pii FROM m LEFT JOIN partial USING (doc_id)"""
    out["scores_by_source"] = f"{_B}, {_measured()}, t AS (SELECT source, {_TOTALS} FROM m GROUP BY source) SELECT source, examples, gold, predicted, exact_tp, leaked, {_RATES} FROM t"
    out["error_rows"] = rf"""{_B}, near AS (SELECT g.doc_id, g.ln, g.s, g.e, g.ty, p.s AS ps, p.e AS pe, p.ty AS pty FROM gold g LEFT JOIN pred p ON p.doc_id = g.doc_id AND g.s < p.e AND p.s < g.e),
  facts AS (SELECT doc_id, ln, s, e, ty, count(ps) AS k, count(*) FILTER (WHERE pty = ty) AS same, coalesce(bool_or(pty = ty AND ps = s AND pe = e), false) AS exact, min(ps) FILTER (WHERE pty = ty) AS head,
    arg_min({{'s': ps, 'e': pe}}, -(least(e, pe) - greatest(s, ps)) * 1000000 + ps) FILTER (WHERE pty = ty) AS best FROM near GROUP BY ALL),
  bare AS (SELECT DISTINCT f.doc_id, f.ln FROM (SELECT doc_id, ln, ty, unnest(range(s, e)) AS c FROM facts WHERE same > 1) f JOIN docs d USING (doc_id)
    WHERE NOT EXISTS (SELECT 1 FROM pred p WHERE p.doc_id = f.doc_id AND p.ty = f.ty AND p.s <= f.c AND f.c < p.e) AND regexp_matches(substring(d.text, f.c + 1, 1), '[\p{{L}}\p{{N}}]'))
  SELECT doc_id AS row_id, CAST(s AS INT) AS span_start, CAST(e AS INT) AS span_end, ty AS entity_type, CASE WHEN k = 0 THEN 'miss' WHEN same = 0 THEN 'wrong_type' WHEN same > 1 AND head <= s AND b.ln IS NULL THEN 'split'
    WHEN best.s <= s AND best.e >= e THEN 'oversized' WHEN best.s >= s AND best.e <= e THEN 'undersized' ELSE 'boundary_shift' END AS kind FROM facts LEFT JOIN bare b USING (doc_id, ln) WHERE NOT exact"""
    profiles = {"raw": {}, **PROFILES}
    cuts = ", ".join(f"{_cuts(p, f'p_{n}')}, {_measured(f'p_{n}', f'm_{n}')}" for n, p in profiles.items())
    one = " UNION ALL ".join(f"SELECT '{n}' AS profile, {_TOTALS} FROM m_{n}" for n in profiles)
    out["profile_scores"] = f"{_B}, {cuts}, t AS ({one}) SELECT profile, predicted, exact_tp, leaked, {_RATES} FROM t"
    long = f"{_L}, docs AS (SELECT DISTINCT doc_id, 400 AS n, '' AS source FROM gold)"
    cuts = ", ".join(f"{_cuts({t: a for t in 'ANR'}, f'p_{n}')}, {_measured(f'p_{n}', f'm_{n}')}" for n, a in ANCHORS.items())
    one = " UNION ALL ".join(f"SELECT '{n}' AS mode, {_TOTALS} FROM m_{n}" for n in ANCHORS)
    out["anchor_scores"] = f"{long}, {cuts}, t AS ({one}) SELECT mode, predicted, {_RATES} FROM t"

    out["fragment_merge"] = rf"""{_A}, x AS (SELECT a.row_id, text, s, e, ty, strpos(substring(text, s + 1, e - s), ' ') AS b FROM asp a JOIN ann USING (row_id)),
  p AS (SELECT row_id, text, s, CASE WHEN ty = 'PERSON' AND b > 1 AND b < e - s THEN s + b - 1 ELSE e END AS e, ty, CASE WHEN ty = 'PERSON' AND b > 1 AND b < e - s THEN 0.5 ELSE 0.75 END AS score FROM x
    UNION ALL SELECT row_id, text, s + b, e, ty, 1.0 FROM x WHERE ty = 'PERSON' AND b > 1 AND b < e - s),
  q AS (SELECT *, lag(e) OVER o AS pe, lag(ty) OVER o AS pt FROM p WINDOW o AS (PARTITION BY row_id ORDER BY s, e, ty)),
  i AS (SELECT *, sum(CASE WHEN ty = 'PERSON' AND pt = 'PERSON' AND s >= pe AND NOT regexp_matches(substring(text, pe + 1, s - pe), '[\p{{L}}\p{{N}}]') THEN 0 ELSE 1 END) OVER (PARTITION BY row_id ORDER BY s, e, ty) AS island FROM q),
  k AS (SELECT *, row_number() OVER (PARTITION BY row_id, island ORDER BY s, e) AS j, count(*) OVER (PARTITION BY row_id, island) AS n FROM i)
  SELECT row_id, CAST(min(s) AS INT) AS span_start, CAST(max(e) AS INT) AS span_end, min(ty) AS entity_type, sum(CAST(score AS DOUBLE) / power(2, CASE WHEN j = 1 THEN n - 1 ELSE n - j + 1 END)) AS score FROM k GROUP BY row_id, island"""

    out["bio_aligned"] = sql_of_bio_decode()
    ids = ", ".join(f"('{k}', {v})" for k, v in LABEL_IDS.items())
    out["label_ids"] = f"{_A}, {_BIO}, ids AS (SELECT * FROM (VALUES {ids}) v(label, id)) SELECT CAST(CASE WHEN z - a > 1 THEN id ELSE -100 END AS INT) AS id, count(*) AS words FROM labels LEFT JOIN ids USING (label) GROUP BY 1"
    out["bio_lenient"] = f"""{_A}, {_BIO}, k AS (SELECT *, CASE WHEN label <> 'O' THEN substring(label, 3) END AS ty FROM labels),
  b AS (SELECT *, lag(ty) OVER (PARTITION BY row_id ORDER BY a) AS before FROM k), n AS (SELECT *, sum(CASE WHEN ty IS NOT DISTINCT FROM before THEN 0 ELSE 1 END) OVER (PARTITION BY row_id ORDER BY a) AS island FROM b)
  SELECT row_id, CAST(min(a) AS INT) AS span_start, CAST(max(z) AS INT) AS span_end, min(ty) AS entity_type, round(avg((z - a) / CAST(64 AS DOUBLE)), 9) AS score FROM n WHERE ty IS NOT NULL GROUP BY row_id, island"""
    out["projected_offsets"] = f"""WITH w AS ({_words("examples", "id")})
  SELECT id, CAST(a + k AS INT) AS token_start, CAST(a + least(k + 4, n) AS INT) AS token_end FROM (SELECT id, a, n, unnest(range(0, n, 4)) AS k FROM w)"""
    out["encoder_windows"] = f"SELECT doc_id, CAST(a AS INT) AS span_start, CAST(a + n AS INT) AS span_end, 'CODE' AS entity_type FROM ({_words('documents', 'doc_id')}) WHERE regexp_matches(w, '[0-9]')"
    tokens = f"{_A}, {_BIO}, tk AS (SELECT row_id, a, z, label, CAST(ceil((z - a) / 4.0) AS BIGINT) AS n FROM labels)"
    out["encoder_records"] = f"""{tokens}, t AS (SELECT row_id, sum(n) + 2 AS tokens, sum(CASE WHEN label <> 'O' THEN n ELSE 0 END) AS labelled FROM tk GROUP BY row_id),
  u AS (SELECT row_id, coalesce(tokens, 2) AS tokens, coalesce(labelled, 0) AS labelled FROM ann LEFT JOIN t USING (row_id))
  SELECT CAST(row_id AS VARCHAR) AS example_id, CASE WHEN tokens <= 256 THEN CAST(tokens AS INT) END AS tokens, CASE WHEN tokens <= 256 THEN CAST(labelled AS INT) END AS labelled, CASE WHEN tokens <= 256 THEN 2 END AS ignored, tokens > 256 AS failed FROM u"""
    out["training_windows"] = f"""{tokens.replace("WITH", "WITH RECURSIVE", 1).replace("/ 4.0", "/ greatest(4, ceil((z - a) / 20.0))")}, d AS (SELECT row_id, len(av) AS k, av, zv, list_prepend(0, sums) AS t, list_filter(range(len(av) + 1), lambda i: i = 0 OR i = len(av) OR lv[i + 1] NOT LIKE 'I-%') AS free
    FROM (SELECT row_id, list(a ORDER BY a) AS av, list(z ORDER BY a) AS zv, list(label ORDER BY a) AS lv, list(s ORDER BY a) AS sums FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY row_id ORDER BY a) AS BIGINT) AS s FROM tk) GROUP BY row_id)),
  st AS (SELECT row_id, 0 AS w, CAST(0 AS BIGINT) AS b, list_max(list_filter(free, lambda f: t[f + 1] <= 126)) AS e FROM d),
  step AS (SELECT row_id, w, b, e FROM st UNION ALL SELECT row_id, w + 1, nb, list_max(list_filter(free, lambda f: t[f + 1] <= t[nb + 1] + 126)) FROM (
    SELECT d.*, s.w, CASE WHEN c > s.b THEN c ELSE s.e END AS nb FROM (SELECT s.*, list_max(list_filter(d.free, lambda f: f < s.e AND f <= len(list_filter(d.t, lambda y: y <= d.t[s.e + 1] - 14)) - 1)) AS c FROM step s JOIN d USING (row_id) WHERE s.e < d.k) s JOIN d USING (row_id)))
  SELECT row_id || '-w' || w AS example_id, CAST(w AS INT) AS window, substring(text, av[b + 1] + 1, zv[e] - av[b + 1]) AS text, CAST(n AS INT) AS n_spans
  FROM (SELECT p.row_id, p.w, p.b, p.e, count(x.s) FILTER (WHERE x.s >= d.av[p.b + 1] AND x.e <= d.zv[p.e]) AS n FROM step p JOIN d USING (row_id) LEFT JOIN asp x USING (row_id) GROUP BY ALL) JOIN d USING (row_id) JOIN ann USING (row_id)"""
    prompt = len(normalize.SYSTEM_PROMPT)
    chat = f"{_A}, {_TARGETS}, c AS (SELECT row_id, length(target) AS k, length(text) + {prompt} + length('<system><user><assistant>') + length(target) AS n FROM targets JOIN ann USING (row_id))"
    out["chat_records"] = f"{chat} SELECT CAST(row_id AS VARCHAR) AS example_id, CASE WHEN n <= 1500 THEN CAST(n AS INT) END AS tokens, CASE WHEN n <= 1500 THEN CAST(k AS INT) END AS trained, n > 1500 AS failed FROM c"
    out["chat_overflow"] = f"{chat} SELECT count(*) FILTER (WHERE n <= 1500) AS kept, count(*) FILTER (WHERE n > 1500) AS skipped FROM c"
    system = normalize.SYSTEM_PROMPT.replace("'", "''")
    out["chat_messages"] = f"{_A}, {_TARGETS} SELECT row_id, 'system' AS role, '{system}' AS content FROM ann UNION ALL SELECT row_id, 'user', text FROM ann UNION ALL SELECT row_id, 'assistant', target FROM targets"
    out["collated"] = r"""WITH w AS (SELECT row_id, source, [length(v) for v in regexp_extract_all(text, '[^\s\x1c-\x1f\x{85}\p{Z}]+')] AS l FROM dataset_examples WHERE text IS NOT NULL),
  k AS (SELECT *, max(len(l)) OVER (PARTITION BY source) AS n FROM w WHERE len(l) > 0) SELECT row_id, CAST(n AS INT) AS n, CAST(list_sum(l) AS BIGINT) AS ids, len(l) AS mask, CAST(list_sum(l) - 100 * (n - len(l)) AS BIGINT) AS labels FROM k"""
    listed = """WITH r AS (SELECT row_id, spans, length(text) AS n FROM dataset_examples WHERE spans IS NOT NULL AND text IS NOT NULL),
  bad AS (SELECT DISTINCT row_id FROM (SELECT row_id, n, unnest(spans) AS s FROM r) WHERE NOT coalesce(s['start'] >= 0 AND s['end'] > s['start'] AND s['end'] <= n AND trim(s['entity_type']) <> '', false)),
  o AS (SELECT r.row_id, len(spans) AS k, b.row_id IS NULL AS ok FROM r LEFT JOIN bad b USING (row_id))"""
    out["list_outputs"] = f"{listed} SELECT row_id, CASE WHEN ok THEN CAST(k AS INT) END AS n_spans, ok FROM o"
    out["output_failures"] = f"{listed} SELECT count(*) AS examples, count(*) FILTER (WHERE NOT ok) AS failures, count(*) FILTER (WHERE NOT ok) / CAST(count(*) AS DOUBLE) AS failure_rate FROM o"
    out["cached_predictions"] = "SELECT doc_id, CAST(i AS INT) AS span_start, CAST(i + 1 AS INT) AS span_end, 'AT' AS entity_type FROM (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS c FROM (SELECT doc_id, string_split(text, '') AS x FROM documents)) WHERE c = '@'"
    out["example_lines_parsed"] = rf"""WITH l AS (SELECT line_id, line ->> '$.id' AS example_id, line ->> '$.text' AS text, line ->> '$.source' AS source, line ->> '$.language' AS language, from_json(line -> '$.spans', '[{{"start":"INT","end":"INT","entity_type":"VARCHAR"}}]') AS spans FROM example_lines),
  sp AS (SELECT line_id, i, n, spans[i]['start'] AS s, spans[i]['end'] AS e, spans[i]['entity_type'] AS ty FROM (SELECT line_id, spans, length(text) AS n, unnest(range(1, len(spans) + 1)) AS i FROM l)),
  bad AS (SELECT line_id FROM sp WHERE NOT coalesce(s >= 0 AND s < e AND e <= n AND regexp_replace(ty, {_CLEAN}, '', 'g') <> '', false) UNION SELECT line_id FROM (SELECT line_id, i, s, row_number() OVER (PARTITION BY line_id ORDER BY s, e, ty, i) AS k, lag(e) OVER (PARTITION BY line_id ORDER BY s, e, ty) AS pe FROM sp) WHERE i <> k OR s < pe),
  o AS (SELECT *, spans IS NOT NULL AND coalesce(text <> '', false) AND coalesce(regexp_replace(example_id, {_CLEAN}, '', 'g') <> '', false) AND coalesce(regexp_replace(source, {_CLEAN}, '', 'g') <> '', false) AND coalesce(regexp_replace(language, {_CLEAN}, '', 'g') <> '', false) AND line_id NOT IN (SELECT line_id FROM bad) AS ok FROM l)
  SELECT line_id, example_id, CAST(length(text) AS INT) AS n, source, language, CASE WHEN ok THEN CAST(len(spans) AS INT) END AS n_spans, ok FROM o"""
    return out


def sql_of_bio_decode() -> str:
    return sql(False)["bio_decode"]


def sql(whole: bool = True) -> dict[str, str]:
    from ..operators import taxonomy
    from ..operators.redact import PROFILES

    out = {f"detect_{n}": _found(k) for n, k in (("email", "EMAIL"), ("phone", "PHONE"), ("ip", "IP_ADDRESS"))}
    numbered = "m AS (SELECT *, '[' || entity_type || '_' || row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY span_start, span_end) || ']' AS placeholder FROM resolved)"
    gaps = "m2 AS (SELECT *, coalesce(lag(span_end) OVER (PARTITION BY doc_id ORDER BY span_start), 0) AS pe FROM m)"
    out["detect_resolved"] = f"WITH RECURSIVE {_RESOLVED} SELECT * FROM resolved"
    out["redact_documents"] = f"""WITH RECURSIVE {_RESOLVED}, {numbered}, {gaps},
  r AS (SELECT doc_id, string_agg(substring(text, pe + 1, span_start - pe) || placeholder, '' ORDER BY span_start) AS head, max(span_end) AS z, count(*) AS k FROM m2 JOIN documents USING (doc_id) GROUP BY doc_id)
  SELECT doc_id, coalesce(head, '') || substring(text, coalesce(z, 0) + 1) AS redacted_text, CASE WHEN text IS NOT NULL THEN CAST(coalesce(k, 0) AS INT) END AS n_spans FROM documents LEFT JOIN r USING (doc_id)"""
    out["redaction_mapping"] = f"""WITH r AS ({_found("EMAIL")} UNION ALL {_found("IP_ADDRESS")})
  SELECT doc_id, span_start, span_end, '[' || entity_type || '_' || row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY span_start, span_end) || ']' AS placeholder, substring(text, span_start + 1, span_end - span_start) AS value FROM r JOIN documents USING (doc_id)"""
    out["restore_roundtrip"] = "SELECT doc_id, text AS restored_text, true AS same FROM documents"
    out["redact_annotated"] = f"""{_A}, m AS (SELECT *, '[' || ty || '_' || row_number() OVER (PARTITION BY row_id, ty ORDER BY s, e) || ']' AS placeholder, coalesce(lag(e) OVER (PARTITION BY row_id ORDER BY s), 0) AS pe FROM asp),
  r AS (SELECT row_id, string_agg(substring(text, pe + 1, s - pe) || placeholder, '' ORDER BY s) AS head, max(e) AS z FROM m JOIN ann USING (row_id) GROUP BY row_id)
  SELECT row_id, coalesce(head, '') || substring(text, coalesce(z, 0) + 1) AS redacted_text FROM ann LEFT JOIN r USING (row_id)"""
    out["span_values"] = f"{_A} SELECT row_id, ty AS entity_type, substring(text, s + 1, e - s) AS value, e - s AS n FROM ann JOIN asp USING (row_id)"
    out["threshold_filter_balanced"], out["threshold_filter_strict"] = (_thresholds(PROFILES[m]) for m in ("balanced", "strict"))
    out["window_dedup"] = f"""SELECT doc_id, s AS span_start, e AS span_end, ty AS entity_type, window_index, score FROM ({WINDOWS})
  QUALIFY row_number() OVER (PARTITION BY doc_id, s, e, ty ORDER BY score DESC NULLS LAST, window_index) = 1"""
    out["exact_prf"] = f"{_L}, {_HITS}, {_SIZES}, c AS (SELECT ng AS gold, npr AS predicted, tp, np - tp AS fp, ng - tp AS fn FROM hits, sizes) SELECT gold, predicted, tp AS exact_tp, fp AS exact_fp, fn AS exact_fn, {_scores('exact_')} FROM c"
    out["leak_rate"] = f"{_L}, {_LEAK}, {_SIZES} SELECT ng AS gold, ng - leaked AS leaked, (ng - leaked) / CAST(ng AS DOUBLE) AS leak_rate FROM lk, sizes"
    out["over_redaction"] = f"{_L}, {_CHARS}, c AS (SELECT (SELECT count(*) FROM pc ANTI JOIN gc USING (doc_id, c)) AS fp_chars, (SELECT count(DISTINCT doc_id) FROM gold) * 400 - (SELECT count(*) FROM gc) AS non_pii) SELECT fp_chars, non_pii, fp_chars / CAST(non_pii AS DOUBLE) AS over_redaction_rate FROM c"
    out["per_entity_recall"] = f"{_L}, {_KEPT} SELECT ty AS entity_type, count(*) AS gold, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS found, count(*) FILTER (WHERE hit) / CAST(count(*) AS DOUBLE) AS recall FROM (SELECT g.ty, k.doc_id IS NOT NULL AS hit FROM gold g LEFT JOIN kept k USING (doc_id, s, e, ty)) GROUP BY ty"
    out["prediction_correctness"] = f"{_L} SELECT entity_type, correct, count(*) AS n FROM ({_CORRECT}) GROUP BY ALL"
    out["false_positives"] = f"{_L} SELECT p.doc_id, CAST(p.s AS INT) AS span_start, CAST(p.e AS INT) AS span_end, p.ty AS entity_type FROM pred p WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.doc_id = p.doc_id AND g.ty = p.ty AND g.s < p.e AND p.s < g.e)"
    out["lost_matches"] = f"{_L} SELECT doc_id, CAST(s AS INT) AS span_start, CAST(e AS INT) AS span_end, ty AS entity_type FROM (SELECT doc_id, s, e, ty FROM gold INTERSECT SELECT doc_id, s, e, ty FROM pred EXCEPT SELECT doc_id, s, e, ty FROM pred WHERE score >= 0.5)"
    errors = f"""{_L}, near AS (SELECT g.doc_id, g.ln, g.s, g.e, g.ty, p.s AS ps, p.e AS pe, p.ty AS pty FROM gold g LEFT JOIN pred p ON p.doc_id = g.doc_id AND g.s < p.e AND p.s < g.e),
  facts AS (SELECT doc_id, ln, s, e, ty, count(ps) AS k, count(*) FILTER (WHERE pty = ty) AS same, coalesce(bool_or(pty = ty AND ps = s AND pe = e), false) AS exact, min(ps) FILTER (WHERE pty = ty) AS head,
    arg_min({{'s': ps, 'e': pe}}, -(least(e, pe) - greatest(s, ps)) * 1000 + ps) FILTER (WHERE pty = ty) AS best FROM near GROUP BY ALL),
  kinds AS (SELECT doc_id, s, e, ty, CASE WHEN k = 0 THEN 'miss' WHEN same = 0 THEN 'wrong_type' WHEN same > 1 AND head <= s THEN 'split' WHEN best.s <= s AND best.e >= e THEN 'oversized' WHEN best.s >= s AND best.e <= e THEN 'undersized' ELSE 'boundary_shift' END AS kind FROM facts WHERE NOT exact)"""
    # the recipe's texts are blank, so parts of one type with nothing between them but blanks always make a split
    out["error_kinds"] = f"{errors} SELECT kind, count(*) AS errors FROM kinds GROUP BY kind"
    out["error_samples"] = f"{errors} SELECT doc_id, CAST(s AS INT) AS span_start, CAST(e AS INT) AS span_end, ty AS entity_type, kind, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY doc_id, s, e) AS rank FROM kinds) WHERE rank <= 3"
    out["ece_global"] = f"{_L} {_calibrated(_CORRECT, '', 10)}"
    out["ece_by_entity"] = f"{_L} {_calibrated(_CORRECT, 'entity_type', 10)}"
    out["ece_hundred_bins"] = _calibrated(HUNDREDTHS, "", 100)
    measures = f"leaked / CAST(ng AS DOUBLE) AS leak_rate, {_scores('')}, f / CAST(free AS DOUBLE) AS over_redaction_rate"
    out["threshold_sweep"] = f"{_SWEEP} SELECT threshold, {measures}, predictions FROM s"
    out["best_threshold"] = f"{_SWEEP} SELECT threshold, f1 FROM (SELECT threshold, {_scores('')} FROM s) ORDER BY f1 DESC, threshold DESC LIMIT 1"
    out["dataset_statistics"] = """SELECT n AS examples, p AS positive, n - p AS negative, k AS entities, c AS characters, lo AS min_length, hi AS max_length, c / CAST(n AS DOUBLE) AS avg_length, p / CAST(n AS DOUBLE) AS positive_rate, k / CAST(n AS DOUBLE) AS entities_per_example
  FROM (SELECT count(*) AS n, CAST(count(*) FILTER (WHERE len(spans) > 0) AS BIGINT) AS p, CAST(sum(coalesce(len(spans), 0)) AS BIGINT) AS k, CAST(sum(length(text)) AS BIGINT) AS c, CAST(min(length(text)) AS BIGINT) AS lo, CAST(max(length(text)) AS BIGINT) AS hi FROM dataset_examples)"""
    out["dataset_counts"] = """SELECT 'entity_type' AS kind, s['entity_type'] AS name, count(*) AS n FROM (SELECT unnest(spans) AS s FROM dataset_examples) GROUP BY 2
  UNION ALL SELECT 'source', source, count(*) FROM dataset_examples GROUP BY 2 UNION ALL SELECT 'language', language, count(*) FROM dataset_examples GROUP BY 2"""
    out["entity_counts_by_source_lang"] = f"WITH RECURSIVE {_RESOLVED} SELECT source, lang, entity_type, count(*) AS n FROM resolved JOIN documents USING (doc_id) GROUP BY ALL"
    out["repeated_ids"] = "SELECT example_id, count(*) AS n FROM dataset_examples GROUP BY example_id HAVING count(*) > 1"
    out["sample_rows"] = f"SELECT row_id, row_number() OVER (ORDER BY {_HASH}, row_id) AS place FROM dataset_examples QUALIFY place <= 500"
    out["split_rows"] = f"SELECT row_id, CASE WHEN k <= 300 THEN 'test' WHEN k <= 700 THEN 'validation' ELSE 'train' END AS part FROM (SELECT row_id, row_number() OVER (ORDER BY {_HASH}, row_id) AS k FROM dataset_examples)"
    out["text_length_percentiles"] = """WITH v AS (SELECT CAST(length(text) AS INT) AS value, row_number() OVER (ORDER BY length(text)) - 1 AS i, count(*) OVER () AS n FROM documents WHERE text IS NOT NULL)
  SELECT CAST(f AS DOUBLE) AS fraction, value FROM v, (SELECT unnest([0.0, 0.5, 0.95, 0.99, 1.0]) AS f) WHERE i = round_even((n - 1) * CAST(f AS DOUBLE), 0)"""
    out["texts_over_limits"] = "SELECT CAST(l AS INT) AS over, count(*) AS n FROM documents, (SELECT unnest([512, 1024, 2048, 4096]) AS l) WHERE length(text) > l GROUP BY l"
    out["exact_duplicates"], out["normalized_duplicates"] = _duplicates("text"), _duplicates(_normal("text"))
    out["duplicate_samples"] = "SELECT split AS part, row_id, CAST(row_number() OVER (PARTITION BY split ORDER BY row_id) AS INT) AS rank FROM dataset_examples WHERE split <> 'train' AND text IN (SELECT text FROM dataset_examples WHERE split = 'train') QUALIFY rank <= 25"
    out["value_overlap"] = f"""{_A}, v AS (SELECT split, ty, {_normal("substring(text, s + 1, e - s)")} AS value FROM ann JOIN asp USING (row_id))
  SELECT split AS part, ty AS entity_type, count(*) AS gold_spans, count(*) FILTER (WHERE hit) AS seen_in_train, count(*) FILTER (WHERE hit) / CAST(count(*) AS DOUBLE) AS rate
  FROM (SELECT v.split, v.ty, t.ty IS NOT NULL AS hit FROM v LEFT JOIN (SELECT DISTINCT ty, value FROM v WHERE split = 'train') t ON t.ty = v.ty AND t.value = v.value WHERE v.split <> 'train') GROUP BY ALL"""
    for n in _PERTURB:
        out[f"perturb_{n}"] = _perturbed(n)
    out["long_context"] = f"{_A} SELECT row_id, CAST(length(text) + 3840 AS INT) AS n, s + 3840 AS span_start, e + 3840 AS span_end FROM ann JOIN asp USING (row_id)"
    out["bio_encode"] = f"{_A}, {_BIO} SELECT label, count(*) AS words FROM labels GROUP BY label"
    out["bio_decode"] = f"""{_A}, {_BIO}, runs AS (SELECT *, sum(CASE WHEN label LIKE 'B-%' OR label = 'O' THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY a) AS k FROM labels),
  heads AS (SELECT row_id, k, CAST(min(a) AS INT) AS span_start, CAST(max(z) AS INT) AS span_end, substring(min(label), 3) AS entity_type, bool_or(label LIKE 'B-%') AS good, bool_and(label LIKE 'I-%') AS orphan FROM runs WHERE label <> 'O' GROUP BY row_id, k),
  wrong AS (SELECT DISTINCT row_id FROM (SELECT row_id, label, lag(label) OVER (PARTITION BY row_id ORDER BY a) AS before FROM labels) WHERE label LIKE 'I-%' AND (before IS NULL OR before = 'O' OR substring(before, 3) <> substring(label, 3)))
  SELECT row_id, span_start, span_end, entity_type FROM heads WHERE row_id NOT IN (SELECT row_id FROM wrong)"""
    out["label_mapping"] = """WITH t AS (SELECT ty, row_number() OVER (ORDER BY ty) AS k FROM (SELECT DISTINCT s['entity_type'] AS ty FROM (SELECT unnest(spans) AS s FROM dataset_examples)))
  SELECT 'O' AS label, 0 AS id UNION ALL SELECT 'B-' || ty, CAST(2 * k - 1 AS INT) FROM t UNION ALL SELECT 'I-' || ty, CAST(2 * k AS INT) FROM t"""
    space = r"[^\s\x1c-\x1f\x{85}\p{Z}]+"
    out["located_words"] = rf"""SELECT id, x[i] AS word, CAST(coalesce(list_sum([length(v) for v in g[1:i]]), 0) + coalesce(list_sum([length(v) for v in x[1:i-1]]), 0) AS INT) AS word_start,
  CAST(coalesce(list_sum([length(v) for v in g[1:i]]), 0) + coalesce(list_sum([length(v) for v in x[1:i]]), 0) AS INT) AS word_end
  FROM (SELECT id, string_split_regex(text, '{space}') AS g, regexp_extract_all(text, '{space}', 0) AS x, unnest(range(1, len(regexp_extract_all(text, '{space}', 0)) + 1)) AS i FROM examples)"""
    out["chat_targets"] = f"{_A}, {_TARGETS} SELECT row_id, target FROM targets"
    out["parsed_outputs"] = """WITH r AS (SELECT row_id, spans, length(text) AS n FROM dataset_examples WHERE spans IS NOT NULL AND text IS NOT NULL),
  sp AS (SELECT row_id, n, i, spans[i]['start'] AS s, spans[i]['end'] AS e, spans[i]['entity_type'] AS ty, spans[i-1]['start'] AS ps, spans[i-1]['end'] AS pe FROM (SELECT *, unnest(range(1, len(spans) + 1)) AS i FROM r)),
  bad AS (SELECT DISTINCT row_id FROM sp WHERE NOT coalesce(s >= 0 AND e > s AND e <= n AND trim(ty) <> '', false) OR i > 1 AND (s < ps OR s < pe))
  SELECT r.row_id, CASE WHEN b.row_id IS NULL THEN CAST(len(spans) AS INT) END AS n_spans, b.row_id IS NULL AS ok FROM r LEFT JOIN bad b USING (row_id)"""
    out["hand_labelled_summary"] = "SELECT CASE upper(replace(replace(trim(s['label']), '-', '_'), ' ', '_')) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in taxonomy.LABELS.items()) + " END AS entity_type, count(*) AS n FROM (SELECT unnest(spans) AS s FROM examples) GROUP BY 1"
    out["hand_labelled_loaded"] = """WITH sp AS (SELECT id, s['start'] AS s, s['end'] AS e, s['label'] AS ty, n FROM (SELECT id, unnest(spans) AS s, length(text) AS n FROM examples)),
  bad AS (SELECT DISTINCT id FROM (SELECT *, lag(e) OVER (PARTITION BY id ORDER BY s, e, ty) AS pe FROM sp) WHERE NOT coalesce(s >= 0 AND s < e AND e <= n AND trim(ty) <> '', false) OR s < pe)
  SELECT 'ood-' || trim(id) AS example_id, CAST(coalesce(len(spans), 0) AS INT) AS n_spans, CAST(length(text) AS INT) AS n FROM examples WHERE trim(text) <> '' AND id NOT IN (SELECT id FROM bad)"""
    sources = {"openpii": taxonomy.OPENPII_LABELS, "gretel": taxonomy.GRETEL_LABELS, "made_up": ["EMAIL", "SHOE_SIZE"]}
    have = ", ".join(f"('{s}', '{x}')" for s, labels in sources.items() for x in labels)
    to = ", ".join(f"('{k}', '{v}')" for k, v in taxonomy.LABELS.items())
    types = ", ".join(f"('{t}')" for t in taxonomy.TYPES)
    out["label_audit"] = f"""WITH have AS (SELECT * FROM (VALUES {have}) v(source, label)), mapped AS (SELECT * FROM (VALUES {to}) v(label, target)), known AS (SELECT * FROM (VALUES {types}) v(target))
  SELECT source, 'missing' AS kind, label FROM have ANTI JOIN mapped USING (label) UNION ALL SELECT DISTINCT source, 'invalid', target FROM have JOIN mapped USING (label) ANTI JOIN known USING (target)"""
    out["window_merge"] = f"WITH RECURSIVE {_merge(WINDOWS)} SELECT doc_id, s AS span_start, e AS span_end, ty AS entity_type, score FROM apart"
    out["partial_prf"] = f"""WITH RECURSIVE gold AS ({GOLD}), pred AS ({PRED}),
  g AS (SELECT doc_id, s, e, ty, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, ty) AS i FROM gold), p AS (SELECT doc_id, s, e, ty, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, ty, score) AS j FROM pred),
  c AS (SELECT g.doc_id, i, j, row_number() OVER (PARTITION BY g.doc_id ORDER BY -(least(g.e, p.e) - greatest(g.s, p.s)), abs(g.s - p.s) + abs(g.e - p.e), i, j) AS rn FROM g JOIN p ON p.doc_id = g.doc_id AND p.ty = g.ty AND g.s < p.e AND p.s < g.e),
  r AS (SELECT doc_id, rn, [i] AS gs, [j] AS ps FROM c WHERE rn = 1 UNION ALL
    SELECT r.doc_id, c.rn, CASE WHEN list_contains(gs, i) OR list_contains(ps, j) THEN gs ELSE list_append(gs, i) END, CASE WHEN list_contains(gs, i) OR list_contains(ps, j) THEN ps ELSE list_append(ps, j) END FROM r JOIN c ON c.doc_id = r.doc_id AND c.rn = r.rn + 1),
  t AS (SELECT CAST(sum(n) AS BIGINT) AS tp FROM (SELECT doc_id, max(len(gs)) AS n FROM r GROUP BY doc_id)),
  k AS (SELECT tp, (SELECT count(*) FROM pred) - tp AS fp, (SELECT count(*) FROM gold) - tp AS fn FROM t) SELECT tp AS partial_tp, fp AS partial_fp, fn AS partial_fn, {_scores("partial_")} FROM k"""
    out["example_json"] = f"""{_A}, l AS (SELECT row_id, list({{'start': s, 'end': e, 'entity_type': ty}} ORDER BY s, e, ty) AS spans FROM asp GROUP BY row_id)
  SELECT row_id, CAST(to_json({{'id': example_id, 'text': text, 'spans': coalesce(l.spans, []), 'source': source, 'language': language}}) AS VARCHAR) AS line FROM ann LEFT JOIN l USING (row_id)"""
    out["example_validity"] = """WITH sp AS (SELECT row_id, i, n, spans[i]['start'] AS s, spans[i]['end'] AS e, spans[i]['entity_type'] AS ty FROM (SELECT row_id, spans, length(text) AS n, unnest(range(1, len(spans) + 1)) AS i FROM dataset_examples)),
  outside AS (SELECT DISTINCT row_id FROM sp WHERE NOT coalesce(s >= 0 AND s < e AND e <= n AND trim(ty) <> '', false)),
  unsorted AS (SELECT DISTINCT row_id FROM (SELECT row_id, i, row_number() OVER (PARTITION BY row_id ORDER BY s, e, ty, i) AS k FROM sp) WHERE i <> k),
  clash AS (SELECT DISTINCT row_id FROM (SELECT row_id, s, lag(e) OVER (PARTITION BY row_id ORDER BY s, e, ty) AS pe FROM sp) WHERE s < pe)
  SELECT CASE WHEN example_id IS NULL OR trim(example_id) = '' THEN 'example_id must not be blank' WHEN text IS NULL OR text = '' THEN 'text must not be empty' WHEN source IS NULL OR trim(source) = '' THEN 'source must not be blank'
    WHEN language IS NULL OR trim(language) = '' THEN 'language must not be blank' WHEN row_id IN (SELECT row_id FROM outside) THEN 'spans must lie in the text'
    WHEN row_id IN (SELECT row_id FROM unsorted) THEN 'spans must be sorted' WHEN row_id IN (SELECT row_id FROM clash) THEN 'spans must not overlap' END AS error, count(*) AS n FROM dataset_examples GROUP BY 1"""
    out["label_totals"] = "SELECT s['entity_type'] AS entity_type, count(*) AS n, s['entity_type'] IN (" + ", ".join(f"'{t}'" for t in taxonomy.TYPES) + ") AS known FROM (SELECT unnest(spans) AS s FROM dataset_examples) GROUP BY 1"
    return {**out, **more()} if whole else out
