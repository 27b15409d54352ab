"""SQL (DuckDB) for the queries that SQL can state on whole tables."""

from __future__ import annotations

from riverbed.llm.secrets import RULES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = r"[\x20\x09-\x0D]+"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _secrets() -> str:
    columns, names = [], []
    for rank, r in enumerate(RULES):
        p = _quoted(r.pattern)
        value = f"regexp_extract_all(t, {p}, {r.group})"
        columns.append(
            f"(SELECT [x for x in [{{'start': list_sum([length(y) for y in g[1:k]]) + coalesce(list_sum([length(y) for y in m[1:k - 1]]), 0), 'rank': {rank},"
            f" 'stop': list_sum([length(y) for y in g[1:k]]) + list_sum([length(y) for y in m[1:k]]), 'kind': '{r.kind}', 'n': length(v[k])}} for k in range(1, len(m) + 1)] if x.n >= {r.least}]"
            f" FROM (SELECT regexp_extract_all(t, {p}) AS m, string_split_regex(t, {p}) AS g, {value} AS v)) AS s{rank}"
        )
        names.append(f"s{rank}")
    shown = "array_to_string([x.kind || ':' || CAST(x.start AS BIGINT) || ':' || CAST(x.stop AS BIGINT) for x in {}], ',')"
    base = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
    counts = ", ".join(f"len([x for x in s if x.kind = '{r.kind}']) AS n_{r.kind}" for r in RULES if r.base)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, {", ".join(columns)} FROM d),
 a AS (SELECT doc_id, list_sort(flatten([{", ".join(names)}])) AS s FROM f)
 SELECT doc_id, {counts}, sha256({shown.format(f"[y for y in s if y.kind IN ({base})]")}) AS base_sha256, {shown.format("s")} AS spans FROM a"""


def _words(n: int, table: str, key: str, lowered: str) -> str:
    """Distinct runs of n words of each text; a shorter text as a whole."""
    return f"""(SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= {n} THEN [array_to_string(w[i:i + {n - 1}], ' ') for i in range(1, len(w) - {n - 2})] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
 FROM (SELECT {key}, [x for x in string_split_regex({lowered}, '{_BLANK}') if x <> ''] AS w FROM {table}))"""


_JACCARD = f"""WITH RECURSIVE s AS {_words(3, "documents", "doc_id", _LOWER.format("coalesce(text, '')"))}, n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
 ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(node, other) AS (SELECT a, b FROM ways UNION SELECT r.node, x.b FROM reach r JOIN ways x ON r.other = x.a),
 least_of AS (SELECT node, least(node, min(other)) AS component_id FROM reach GROUP BY node)
 SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least_of ON node = d.doc_id"""

_CONTAINED = f"""WITH d AS {_words(5, "documents", "doc_id", "lower(coalesce(text, ''))")}, i AS {_words(5, "benchmark", "item_id", "lower(coalesce(text, ''))")},
 n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id), k AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (g) GROUP BY ALL)
 SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM k JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item"""

_LINES = f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
 k AS (SELECT *, {_LOWER.format(f"regexp_replace(regexp_replace(line, '^{_BLANK}', ''), '{_BLANK}$', '')")} AS key FROM l),
 h AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
 j AS (SELECT k.*, last IS NOT NULL AND last <> doc_id AS gone FROM k LEFT JOIN h USING (key))
 SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id"""


_SHARE = "1 + (1000000000 * ({}::HUGEINT + 5)) // ({} + 5 * {})"
_DIVERGENCE = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
 w AS (SELECT lang, source, r, unnest(regexp_extract_all({_LOWER.format("t")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
 c AS (SELECT lang, source, term, count(DISTINCT r) AS docs, count(*) AS n FROM w GROUP BY ALL), k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
 v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang), g AS (SELECT DISTINCT lang, source FROM d),
 s AS (SELECT lang, source, sum(c.n) AS n FROM c JOIN k USING (lang, term) GROUP BY ALL),
 p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_SHARE.format("coalesce(c.n, 0)", "coalesce(s.n, 0)", "v.v")} AS p, {_SHARE.format("k.n", "v.n", "v.v")} AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
   LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
 x AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM o)
 SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM x WHERE part = 'pair' OR rank <= 50"""

_NEGATIVES = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if coalesce(isfinite(x), false)]) = len(embedding)),
 s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
 p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
 n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
 SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS INTEGER) AS rank, negative_id, positive_score, negative_score
 FROM n QUALIFY rank <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op11_source_divergence": _DIVERGENCE, "op13_hard_negatives": _NEGATIVES} | {"op1_secret_scans": _secrets(), "op2_ngram_jaccard_join": _JACCARD, "op5_benchmark_decontamination": _CONTAINED, "op8_line_dedup": _LINES}
