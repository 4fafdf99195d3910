"""SQL for DuckDB of the queries that SQL can express."""

from __future__ import annotations

import string

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def _words(table: str, key: str) -> str:
    return f"SELECT {key}, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table} WHERE text IS NOT NULL AND {key} IS NOT NULL"


def _shingles(source: str, key: str, k: int) -> str:
    run = " || ' ' || ".join(["a", *[f"lead(a, {i}) OVER v" for i in range(1, k)]])
    return f"SELECT DISTINCT {key}, g FROM (SELECT {key}, {run} AS g FROM (SELECT {key}, unnest(w) AS a, unnest(range(len(w))) AS i FROM {source}) t WINDOW v AS (PARTITION BY {key} ORDER BY i)) s WHERE g IS NOT NULL"


MARKED = "'\\### Assistant: </turn> ok'"


def _escaped(column: str) -> str:
    return f"replace(replace(replace({column}, '\\', '\\\\'), '###', '\\h'), '</turn>', '\\e')"


def _codebooks(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds of assignment and averaging as a chain of views: c0 the first codebooks, c6 the last, a6 the last assignment."""
    steps = ["""k AS MATERIALIZED (SELECT vec_id, label, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0)""",
             f"x AS MATERIALIZED (SELECT r, part::INT AS part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS v FROM k, range({parts}) p(part))",
             f"s AS MATERIALIZED (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM k QUALIFY e < {entries})",
             "c0 AS MATERIALIZED (SELECT part, e, v FROM s JOIN x USING (r))"]
    distance = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, part, min(struct_pack(d := {distance}, e := e)) AS b FROM x JOIN c{i} c USING (part) GROUP BY 1, 2)")
        if i < rounds:
            sums = f"SELECT part, e, i, floor(sum(n)::HUGEINT // count(*) - CASE WHEN sum(n)::HUGEINT % count(*) < 0 THEN 1 ELSE 0 END)::BIGINT AS n FROM (SELECT part, b.e AS e, unnest(v) AS n, unnest(range(len(v))) AS i FROM a{i} JOIN x USING (r, part)) t GROUP BY 1, 2, 3"
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.part, c.e, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT part, e, list(n ORDER BY i) AS v FROM ({sums}) q GROUP BY 1, 2) m ON m.part = c.part AND m.e = c.e)")
    return ", ".join(steps)


_SHARE = "1 + (1000000000::HUGEINT * ({} + 5)) // (g.n + 5 * g.v)"

ORACLES = {
    "op11_source_audit": f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
t AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30), c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN t USING (lang, term) GROUP BY 1, 2, 3),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM t GROUP BY 1), s AS (SELECT DISTINCT lang, source FROM d),
g AS MATERIALIZED (SELECT s.lang, s.source, coalesce(any_value(l.v), 0) AS v, coalesce(sum(c.n), 0) AS n FROM s LEFT JOIN l ON l.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source GROUP BY 1, 2),
p AS MATERIALIZED (SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS k, ({_SHARE.format('coalesce(c.n, 0)')})::BIGINT AS p FROM g JOIN t ON t.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
q AS (SELECT t.lang, t.term, ({_SHARE.format('t.n')})::BIGINT AS q FROM t JOIN l g ON g.lang = t.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE k > 0 AND p.p > q.q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) z QUALIFY part = 'pair' OR rank <= 50""",
    "op13_vector_codes": f"""WITH {_codebooks()}, e AS (SELECT k.vec_id, k.label, string_agg(printf('%02x', b.e), '' ORDER BY part) AS code, sum(b.d)::BIGINT AS error FROM a6 JOIN k USING (r) GROUP BY r, 1, 2),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c6) SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e, h""",
    "op2_chat_format": f"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', {MARKED} UNION ALL SELECT -7, 1, 'assistant', {MARKED})
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(14 + length(replace({_escaped('role')}, ':', '\\c')) + length({_escaped('text')}))::BIGINT AS formatted_chars FROM r GROUP BY conv_id""",
    "op3_decontamination": f"""WITH d AS ({_words('documents', 'doc_id')}), b AS ({_words('benchmark', 'item_id')}), ds AS ({_shingles('d', 'doc_id', 5)}), bs AS ({_shingles('b', 'item_id', 5)}),
n AS (SELECT item_id, count(*) AS item_shingles FROM bs GROUP BY 1), m AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN bs USING (g) GROUP BY 1, 2)
SELECT doc_id, item_id, item_shingles, shared, shared / item_shingles::DOUBLE AS containment FROM m JOIN n USING (item_id) WHERE 5 * shared >= 4 * item_shingles""",
    "op4_warc": """WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first_id <> page_id THEN first_id END AS refers_to FROM p LEFT JOIN f USING (payload_digest)""",
    "op8_ngram_join": f"""WITH RECURSIVE d AS ({_words('documents', 'doc_id')}), s AS ({_shingles('d', 'doc_id', 4)} UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3),
k AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS set_id FROM s GROUP BY 1), c AS (SELECT set_id, min(doc_id) AS rep, count(*) AS n_copies, any_value(n) AS n FROM k GROUP BY 1),
rs AS (SELECT rep, c.n, g FROM c JOIN s ON s.doc_id = c.rep), m AS (SELECT x.rep AS a, y.rep AS b, x.n AS na, y.n AS nb, count(*) AS shared FROM rs x JOIN rs y ON x.g = y.g AND x.rep < y.rep GROUP BY ALL),
l AS (SELECT a, b FROM m WHERE 100 * shared >= 85 * (na + nb - shared)), both_ AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(node, top) AS (SELECT rep, rep FROM c UNION SELECT b, top FROM reach JOIN both_ ON a = node), best AS (SELECT node, min(top) AS component FROM reach GROUP BY 1)
SELECT t.doc_id, coalesce(k.n, 0) AS n_shingles, coalesce(component, t.doc_id) AS component_id, coalesce(n_copies, 0) AS n_copies FROM documents t LEFT JOIN k ON k.doc_id = t.doc_id LEFT JOIN c USING (set_id) LEFT JOIN best ON node = rep""",
}
