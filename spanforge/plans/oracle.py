"""The catalogue's queries in SQL, built from shared common table expressions."""

from __future__ import annotations

_WS = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _hash(*parts: str) -> str:
    return "sha256(concat(" + ", ".join(f"{p}, chr(0)" for p in parts) + "))"


def _words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9]+')"


def _tokens(text: str) -> str:
    return rf"len(regexp_extract_all({text}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_WS}]'))"


DOCS = "docs AS (SELECT id, arg_max(coalesce(text, ''), doc_id) AS text, min(doc_id) AS doc_pos FROM documents WHERE id IS NOT NULL GROUP BY id)"


def _fixed(size: int, overlap: int, name: str = "fx") -> str:
    step, spec = size - overlap, f"fixed:size={size}:overlap={overlap}"
    return f"""
{name}_n AS (SELECT id, doc_pos, text, length(text) AS len, unnest(range(0, greatest(0, ceil((length(text) - {size}) / {step}.0))::INT + 1)) AS no FROM docs WHERE length(text) > 0),
{name}_s AS (SELECT id, doc_pos, text, no, (no * {step})::INT AS s, least(no * {step} + {size}, len)::INT AS e FROM {name}_n),
{name} AS (SELECT doc_pos * 16777216 + no AS chunk_pos, {_hash("id", "s", "e", f"'{spec}'")} AS chunk_id, id AS source_id, s, e, substr(text, s + 1, e - s) AS text FROM {name}_s)"""


CHUNKS = f"{DOCS}, {_fixed(400, 50)}"

QUERIES = "uq AS (SELECT id AS query_id, text, gold FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY asked_at NULLS LAST, text NULLS LAST) AS n FROM queries WHERE id IS NOT NULL) WHERE n = 1)"

SPANS = f"""{QUERIES},
g1 AS (SELECT query_id, unnest(range(len(gold.alternatives))) AS alt_idx, gold FROM uq WHERE gold IS NOT NULL),
g2 AS (SELECT query_id, alt_idx, gold.alternatives[alt_idx + 1].required_spans AS r FROM g1),
g3 AS (SELECT query_id, alt_idx, unnest(range(len(r))) AS span_idx, r FROM g2),
g4 AS (SELECT query_id, alt_idx::INT AS alt_idx, span_idx::INT AS span_idx, r[span_idx + 1] AS x FROM g3),
sp AS (SELECT query_id, alt_idx, span_idx, {_hash("x.source_id", 'x."start"', 'x."end"')} AS span_id, x.source_id AS source_id, x."start" AS s0, x."end" AS e0, x.quoted_text AS quoted_text, x.source_version AS source_version FROM g4)"""


def _bm25(k: int, k1: float = 1.5, b: float = 0.75, name: str = "bm", chunks: str = "fx") -> str:
    return f"""
{name}_w AS (SELECT chunk_pos, {_words("text")} AS w FROM {chunks}),
{name}_f AS (SELECT chunk_pos, term, count(*) AS f FROM (SELECT chunk_pos, unnest(w) AS term FROM {name}_w) GROUP BY chunk_pos, term),
{name}_l AS (SELECT chunk_pos, len(w) AS dl FROM {name}_w),
{name}_t AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM {name}_l),
{name}_d AS (SELECT term, count(*)::DOUBLE AS df FROM {name}_f GROUP BY term),
{name}_q AS (SELECT DISTINCT query_id, unnest({_words("text")}) AS term FROM uq),
{name}_s AS (SELECT query_id, chunk_pos, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * f * ({k1}::DOUBLE + 1) / (f + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * dl / avgdl))) AS score
  FROM {name}_q JOIN {name}_f USING (term) JOIN {name}_d USING (term) JOIN {name}_l USING (chunk_pos), {name}_t GROUP BY query_id, chunk_pos),
{name}_r AS (SELECT query_id, chunk_pos, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_pos) AS rank FROM {name}_s WHERE score > 0),
{name} AS (SELECT query_id, rank::INT AS rank, chunk_pos, score FROM {name}_r WHERE rank <= {k})"""


_GRAMS = " || ".join(f"(CASE WHEN length(t) >= {n} THEN list_transform(range(1, length(t) - {n} + 2), lambda i: substr(t, i, {n})) ELSE [] END)" for n in (3, 4, 5))


def _hashed(name: str, source: str, dim: int) -> str:
    """name(k, b, v): unit feature-hashing vectors of source(k, text) as their non-zero entries; 2 * dim is a power of two up to 4,096."""
    return rf"""
{name}_x AS (SELECT k, lower(coalesce(text, '')) AS l, trim(regexp_replace(lower(coalesce(text, '')), '[{_WS}]+', ' ', 'g'), ' ') AS t FROM {source}),
{name}_f AS (SELECT k, unnest(list_transform(regexp_extract_all(l, '[a-z0-9]+'), lambda w: 'w:' || w) || list_transform({_GRAMS}, lambda g: 'c:' || g)) AS f FROM {name}_x),
{name}_u AS (SELECT f, ('0x' || right(sha256(f || chr(0)), 3))::INT % {2 * dim} AS h FROM (SELECT DISTINCT f FROM {name}_f)),
{name}_b AS (SELECT k, h % {dim} AS b, sum(CASE WHEN h < {dim} THEN 1 ELSE -1 END)::DOUBLE AS v FROM {name}_f JOIN {name}_u USING (f) GROUP BY k, h % {dim}),
{name}_n AS (SELECT k, sqrt(sum(v * v)) AS n FROM {name}_b GROUP BY k),
{name} AS (SELECT k, b, v / n AS v FROM {name}_b JOIN {name}_n USING (k) WHERE v <> 0)"""


def _dense(k: int, dim: int = 2048, name: str = "dn") -> str:
    """name(query_id, rank, chunk_pos, score): exact dense lists of uq over fx."""
    return f"""
{name}_ct AS (SELECT chunk_pos AS k, text FROM fx), {name}_qt AS (SELECT query_id AS k, text FROM uq),
{_hashed(f"{name}_c", f"{name}_ct", dim)},
{_hashed(f"{name}_q", f"{name}_qt", dim)},
{name}_d AS (SELECT q.k AS query_id, c.k AS chunk_pos, sum(q.v * c.v) AS score FROM {name}_q q JOIN {name}_c c USING (b) GROUP BY q.k, c.k),
{name}_a AS (SELECT uq.query_id, fx.chunk_pos, coalesce(score, 0)::DOUBLE AS score FROM uq CROSS JOIN fx LEFT JOIN {name}_d d ON d.query_id = uq.query_id AND d.chunk_pos = fx.chunk_pos),
{name} AS (SELECT * FROM (SELECT query_id, chunk_pos, score, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_pos))::INT AS rank FROM {name}_a) WHERE rank <= {k})"""


ITEMS = f"{CHUNKS}, {SPANS}, {_bm25(20)}, it AS (SELECT query_id, rank, chunk_id, source_id, s, e, {_tokens('text')} AS n_tokens FROM bm JOIN fx USING (chunk_pos))"


def _covered(items: str, name: str, keys: str = "") -> str:
    """Coverage of each touched span by the items (with the keys' columns)."""
    k = f"{keys}, " if keys else ""
    ik = f"i.{keys}, " if keys else ""
    return f"""
{name}_o AS (SELECT {ik}g.query_id, alt_idx, span_idx, span_id, e0 - s0 AS len, rank, greatest(s, s0) AS a, least(e, e0) AS b
  FROM sp g JOIN {items} i ON g.query_id = i.query_id AND g.source_id = i.source_id AND s < e0 AND e > s0),
{name}_m AS (SELECT *, max(b) OVER (PARTITION BY {k}query_id, alt_idx, span_idx ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {name}_o),
{name} AS (SELECT {k}query_id, alt_idx, span_idx, span_id, sum(greatest(0, b - greatest(a, coalesce(before, a))))::DOUBLE / max(len) AS coverage, max(b - a)::DOUBLE / max(len) AS best_single
  FROM {name}_m GROUP BY {k}query_id, alt_idx, span_idx, span_id)"""


def _satisfied(coverage: str, name: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"""
{name} AS (SELECT DISTINCT {k}query_id FROM (
  SELECT {k}c.query_id, c.alt_idx, count(*) AS have, any_value(need) AS need FROM {coverage} c
  JOIN (SELECT query_id, alt_idx, count(*) AS need FROM sp GROUP BY query_id, alt_idx) n ON c.query_id = n.query_id AND c.alt_idx = n.alt_idx
  WHERE coverage >= 0.8::DOUBLE GROUP BY {k}c.query_id, c.alt_idx) WHERE have = need)"""


_ATTRIBUTED = f"""{ITEMS},
rr AS (SELECT query_id, chunk_id, source_id, s, e, n_tokens, row_number() OVER (PARTITION BY query_id ORDER BY ov DESC, rank) AS rank FROM (
  SELECT it.*, len(list_intersect(list_distinct({_words("coalesce(uq.text, '')")}), list_distinct({_words("fx.text")}))) AS ov FROM it JOIN uq USING (query_id) JOIN fx USING (chunk_id))),
fin AS (SELECT * FROM rr WHERE rank <= 5),
bud AS (SELECT * FROM (SELECT *, sum(n_tokens) OVER (PARTITION BY query_id ORDER BY rank) AS run FROM fin) WHERE run <= 200),
al AS (SELECT query_id, 1 AS rank, source_id, s, e FROM fx, (SELECT DISTINCT query_id FROM sp)),
{_covered("it", "c_union")}, {_satisfied("c_union", "h_union")},
{_covered("fin", "c_final")}, {_satisfied("c_final", "h_final")},
{_covered("bud", "c_budget")}, {_satisfied("c_budget", "h_budget")},
{_covered("al", "c_all")}, {_satisfied("c_all", "h_all")},
fl AS (SELECT query_id, query_id IN (FROM h_all) AS f_all, query_id IN (FROM h_union) AS f_union, query_id IN (FROM h_final) AS f_final, query_id IN (FROM h_budget) AS f_budget FROM uq)"""

_RESULTS = "rs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config_id, query_id ORDER BY hit, gold_completion_rank, retrieved_tokens) AS n FROM results WHERE config_id IS NOT NULL AND query_id IS NOT NULL) WHERE n = 1)"
_LIVE = f"{_RESULTS}, lv AS (SELECT *, coalesce(1.0::DOUBLE / gold_completion_rank, 0) AS rr, coalesce(hit, false) AS h FROM rs WHERE NOT coalesce(refused, false))"
_METRICS = f"""{_LIVE},
ct AS (SELECT config_id, count(*) AS n, count(*) FILTER (h) AS hits, avg(h::INT)::DOUBLE AS hit_rate, avg(rr) AS mrr, count(*) FILTER (h AND len(fragmented_spans) > 0) AS fragmented_queries FROM lv GROUP BY config_id)"""


def _wilson(x: str, n: str) -> tuple[str, str]:
    p, m = f"({x}::DOUBLE / {n})", f"{n}::DOUBLE"
    d = f"(1 + 3.8416::DOUBLE / {m})"
    c = f"(({p} + 3.8416::DOUBLE / (2 * {m})) / {d})"
    w = f"(1.96::DOUBLE / {d} * sqrt({p} * (1 - {p}) / {m} + 3.8416::DOUBLE / (4 * {m} * {m})))"
    return f"greatest(0::DOUBLE, {c} - {w})", f"least(1::DOUBLE, {c} + {w})"


# A recorded version differs from the text's: whole hashes only, or their first 16 characters at least.
_WHOLE = "sha256(text) <> source_version"
_SHORT = "(length(source_version) < 16 OR left(sha256(text), length(source_version)) <> source_version)"
_EMB = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"
_NEAR = f"{_EMB}, nn AS (SELECT a.vec_id AS x, b.vec_id AS y, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 6) DESC, b.vec_id) AS r FROM v a JOIN v b ON a.vec_id <> b.vec_id)"


def _recursive(size: int) -> str:
    """Chunks (chunk_pos, chunk_id, source_id, s, e, text) by ever weaker separators: pieces, then greedy packing, then tiling."""
    seps = "(CASE lv WHEN 0 THEN chr(10) || chr(10) WHEN 1 THEN chr(10) WHEN 2 THEN '. ' WHEN 3 THEN ' ' END)"
    cut = f"(lv < 4 AND e - s > {size})"
    return f"""{DOCS},
r_t AS (SELECT id, text, length(text) AS n FROM docs WHERE length(text) > 0),
r_p AS (SELECT id, 0 AS s, n::INT AS e, 0 AS lv FROM r_t
  UNION ALL
  SELECT id, (s + o)::INT AS s, (s + o + length(w))::INT AS e, lv + 1 AS lv FROM (
    SELECT id, s, lv, unnest(ws) AS w, unnest(list_transform(range(len(ws)), lambda i: coalesce(list_sum(list_transform(ws[1:i], lambda x: length(x) + l)), 0))) AS o FROM (
      SELECT r_p.id, s, lv, length({seps}) AS l, string_split(substr(text, s + 1, e - s), {seps}) AS ws FROM r_p JOIN r_t USING (id) WHERE {cut})) WHERE w <> ''),
r_l AS (SELECT id, s, e FROM r_p WHERE NOT {cut} AND e - s <= {size} UNION ALL SELECT id, x::INT, least(x + {size}, e)::INT FROM (SELECT id, e, unnest(range(s, e, {size})) AS x FROM r_p WHERE NOT {cut} AND e - s > {size})),
r_o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s) AS i FROM r_l),
r_k AS (SELECT id, i, s AS p FROM r_o WHERE i = 1 UNION ALL SELECT o.id, o.i, CASE WHEN o.e - p <= {size} THEN p ELSE o.s END FROM r_k k JOIN r_o o ON o.id = k.id AND o.i = k.i + 1),
r_s AS (SELECT id, p, row_number() OVER (PARTITION BY id ORDER BY p) AS no FROM (SELECT DISTINCT id, p FROM r_k)),
r_e AS (SELECT id, no - 1 AS no, CASE WHEN no = 1 THEN 0 ELSE p END::INT AS s, coalesce(lead(p) OVER (PARTITION BY id ORDER BY no), n)::INT AS e FROM r_s JOIN r_t USING (id)),
rc AS (SELECT doc_pos * 16777216 + no AS chunk_pos, {_hash("id", "s", "e", f"'recursive:size={size}'")} AS chunk_id, id AS source_id, s, e, substr(text, s + 1, e - s) AS text FROM r_e JOIN docs USING (id))"""


_SENTENCES = rf"""{DOCS}, s_p AS (SELECT id, list_filter(string_split(regexp_replace(text, '([.!?]+(?:[{_WS}]+|\z)|\n+)', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts FROM docs WHERE length(text) > 0),
s_q AS (SELECT id, parts, unnest(range(len(parts))) AS no FROM s_p),
se AS (SELECT id, no::INT AS no, coalesce(list_sum(list_transform(parts[1:no], lambda x: length(x))), 0)::INT AS s, list_sum(list_transform(parts[1:no + 1], lambda x: length(x)))::INT AS e, parts[no + 1] AS text FROM s_q)"""


def _semantic(dim: int, percentile: float, most: int, spec: str) -> str:
    """Chunks sc of whole sentences, cut at far neighbours and at ``most`` characters."""
    return f"""{_SENTENCES},
m_t AS (SELECT id || chr(0) || no AS k, text FROM se),
{_hashed("m_v", "m_t", dim)},
m_w AS (SELECT x.id, x.no, v.b, v.v FROM se x JOIN m_v v ON v.k = x.id || chr(0) || x.no),
m_c AS (SELECT a.id, a.no, sum(a.v * b.v) AS c FROM m_w a JOIN m_w b ON b.id = a.id AND b.no = a.no + 1 AND b.b = a.b GROUP BY a.id, a.no),
m_d AS (SELECT x.id, x.no, coalesce(c, 0) AS c FROM se x JOIN se y ON y.id = x.id AND y.no = x.no + 1 LEFT JOIN m_c ON m_c.id = x.id AND m_c.no = x.no),
m_q AS (SELECT id, quantile_cont(1 - c, {percentile / 100}) AS q FROM m_d GROUP BY id),
m_f AS (SELECT se.id, se.no, s, e, coalesce(1 - c >= q, false) AS far FROM se LEFT JOIN m_d ON m_d.id = se.id AND m_d.no = se.no LEFT JOIN m_q ON m_q.id = se.id),
m_k AS (SELECT id, no, s AS p, e, (far OR e - s >= {most}) AS stop FROM m_f WHERE no = 0
  UNION ALL SELECT f.id, f.no, CASE WHEN k.stop THEN f.s ELSE k.p END, f.e, f.far OR f.e - CASE WHEN k.stop THEN f.s ELSE k.p END >= {most} FROM m_k k JOIN m_f f ON f.id = k.id AND f.no = k.no + 1),
m_s AS (SELECT id, p::INT AS s, max(e)::INT AS e FROM m_k GROUP BY id, p),
m_n AS (SELECT id, s, e, row_number() OVER (PARTITION BY id ORDER BY s) - 1 AS no FROM m_s),
sc AS (SELECT doc_pos * 16777216 + no AS chunk_pos, {_hash("id", "s", "e", f"'{spec}'")} AS chunk_id, id AS source_id, s, e, substr(text, s + 1, e - s) AS text FROM m_n JOIN docs USING (id))"""


def sql() -> dict[str, str]:
    lo, hi = _wilson("hits", "n")
    grams = _GRAMS
    mixed = lambda n: f"""{CHUNKS}, {SPANS}, {_bm25(n)}, {_dense(n)},
hl AS (SELECT query_id, chunk_pos, rank, 0 AS o FROM dn UNION ALL SELECT query_id, chunk_pos, rank, 1000 FROM bm),
hu AS (SELECT query_id, chunk_pos, sum(1.0::DOUBLE / (60 + rank)) AS score, min(o + rank) AS seen FROM hl GROUP BY query_id, chunk_pos),
hf AS (SELECT query_id, chunk_id, source_id, s, e, text, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank, (row_number() OVER (PARTITION BY query_id ORDER BY seen))::INT AS place FROM hu JOIN fx USING (chunk_pos))"""  # noqa: E731
    hybrid = mixed(20)
    needed = lambda i, n: f"{_covered(i, 'c_' + n)}, {_satisfied('c_' + n, 'h_' + n)}"
    done = lambda i: f"ks AS (SELECT unnest(range(1, 21)) AS k), pre AS (SELECT k, i.* FROM {i} i JOIN ks ON rank <= k), {_covered('pre', 'pv', 'k')}, {_satisfied('pv', 'ph', 'k')}, cr AS (SELECT query_id, min(k)::INT AS rank FROM ph GROUP BY query_id)"
    every = "al AS (SELECT query_id, 1 AS rank, source_id, s, e FROM fx, (SELECT DISTINCT query_id FROM sp))"
    both = f"{CHUNKS}, {QUERIES}, {_bm25(20, name='a1')}, {_bm25(20, 0.9, 0.4, 'a2')}, l1 AS (SELECT query_id, rank, chunk_id FROM a1 JOIN fx USING (chunk_pos)), l2 AS (SELECT query_id, rank, chunk_id FROM a2 JOIN fx USING (chunk_pos))"
    children = f"""{DOCS},
pc1 AS (SELECT id, doc_pos, text, unnest(range(0, ((length(text) - 1) // 1200)::INT + 1)) AS p FROM docs WHERE length(text) > 0),
pc2 AS (SELECT id, doc_pos, text, p, (p * 1200)::INT AS ps, least(p * 1200 + 1200, length(text))::INT AS pe FROM pc1),
pc3 AS (SELECT *, unnest(range(0, ((pe - ps - 1) // 300)::INT + 1)) AS c FROM pc2),
pc4 AS (SELECT *, (ps + c * 300)::INT AS s, least(ps + c * 300 + 300, pe)::INT AS e FROM pc3),
pc AS (SELECT doc_pos * 16777216 + p * 4 + c AS chunk_pos, {_hash("id", "s", "e", "'parentchild:parent=1200:child=300'")} AS chunk_id, id AS source_id, s, e, substr(text, s + 1, e - s) AS text,
  {_hash("id", "ps", "pe", "'parentchild:parent=1200:child=300:parent'")} AS parent_id FROM pc4)"""
    chunk_rows = f'chunk_pos, chunk_id, source_id, s AS "start", e AS "end", {_tokens("text")}::INT AS n_tokens'
    return {
        "word_tokens_stats": f"SELECT doc_id, len({_words('coalesce(text, chr(32))')})::BIGINT AS words, len(list_distinct({_words('coalesce(text, chr(32))')}))::BIGINT AS distinct_words FROM documents",
        "token_count": f"SELECT doc_id, coalesce({_tokens('text')}, 0)::BIGINT AS n_tokens FROM documents",
        "char_ngram_counts": rf"WITH x AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[{_WS}]+', ' ', 'g'), ' ') AS t FROM documents), y AS (SELECT doc_id, {grams} AS g FROM x) SELECT doc_id, len(g)::BIGINT AS grams, len(list_distinct(g))::BIGINT AS distinct_grams FROM y",
        "content_hashes": f"SELECT doc_id, sha256(text) AS version, CASE WHEN id IS NOT NULL THEN {_hash('id', 'doc_id', chr(39) + 'x' + chr(39))} END AS key FROM documents",
        "load_documents": f"WITH {DOCS} SELECT id, doc_pos, length(text)::BIGINT AS n_chars, sha256(text) AS version FROM docs",
        "chunk_fixed": f"WITH {DOCS}, {_fixed(400, 0)} SELECT {chunk_rows} FROM fx",
        "chunk_fixed_overlap": f"WITH {CHUNKS} SELECT {chunk_rows} FROM fx",
        "chunk_recursive": f"WITH RECURSIVE {_recursive(400)} SELECT {chunk_rows} FROM rc",
        "chunk_semantic": f"WITH RECURSIVE {_semantic(256, 75.0, 1000, 'semantic:pct=75.0:max=1000:emb=det-hash')} SELECT {chunk_rows} FROM sc",
        "chunk_parent_child": f'WITH {children} SELECT chunk_pos, chunk_id, source_id, s AS "start", e AS "end", parent_id FROM pc',
        "chunk_lossy": f"""WITH {DOCS}, r AS (SELECT id, text, 0 AS a, least(200, length(text)) AS b FROM docs UNION ALL SELECT id, text, least(350, length(text)), length(text) FROM docs),
r2 AS (SELECT *, unnest(range(0, ((b - a - 1) // 100)::INT + 1)) AS c FROM r WHERE b > a), r3 AS (SELECT id, text, (a + c * 100)::INT AS s, least(a + c * 100 + 100, b)::INT AS e FROM r2)
SELECT {_hash("id", "s", "e", "'lossy:drop=200-350:size=100'")} AS chunk_id, id AS source_id, s AS "start", e AS "end", {_tokens("substr(text, s + 1, e - s)")}::INT AS n_tokens FROM r3""",
        "sentence_spans": rf"""WITH {DOCS}, p AS (SELECT id, list_filter(string_split(regexp_replace(text, '([.!?]+(?:[{_WS}]+|\z)|\n+)', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts FROM docs WHERE length(text) > 0),
q AS (SELECT id, parts, unnest(range(len(parts))) AS no FROM p)
SELECT id, no::INT AS no, coalesce(list_sum(list_transform(parts[1:no], lambda x: length(x))), 0)::INT AS "start", list_sum(list_transform(parts[1:no + 1], lambda x: length(x)))::INT AS "end" FROM q""",
        "chunk_tiling": f"WITH {DOCS} SELECT unnest(['fixed', 'parent_child', 'recursive', 'semantic']) AS chunker, id, length(text)::BIGINT AS covered FROM docs WHERE length(text) > 0",
        "hash_embed": rf"""WITH x AS (SELECT doc_id, lower(coalesce(text, '')) AS l, trim(regexp_replace(lower(coalesce(text, '')), '[{_WS}]+', ' ', 'g'), ' ') AS t FROM documents),
f AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(l, '[a-z0-9]+'), lambda w: 'w:' || w) || list_transform({grams}, lambda g: 'c:' || g)) AS f FROM x),
h AS (SELECT doc_id, ('0x' || right(sha256(f || chr(0)), 3))::INT % 512 AS h FROM f)
SELECT doc_id, (h % 256)::INT AS bucket, sum(CASE WHEN h < 256 THEN 1 ELSE -1 END)::BIGINT AS value FROM h GROUP BY doc_id, h % 256 HAVING sum(CASE WHEN h < 256 THEN 1 ELSE -1 END) <> 0""",
        "dense_topk": f"""WITH {_EMB}, s AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.e, b.e) AS sc FROM v a, v b WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sc, 6) DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, round(sc, 6) AS score FROM r WHERE rank <= 10""",
        "index_size": "SELECT count(*) AS n, (count(*) * 64 * 4)::BIGINT AS bytes FROM embeddings",
        "ann_diagnostics_summary": "WITH x AS (SELECT DISTINCT config_key, k, n, mean_recall, min_recall, queries_below_full_recall FROM ann_diagnostics WHERE mean_recall IS NOT NULL) SELECT split_part(config_key, '|', 1) AS model, k, count(*) AS runs, round(avg(mean_recall), 9) AS mean_recall, min(min_recall) AS min_recall, sum(queries_below_full_recall)::BIGINT AS below FROM x GROUP BY 1, 2",
        "bm25_stats": f"WITH {CHUNKS}, t AS (SELECT DISTINCT chunk_pos, unnest({_words('text')}) AS term FROM fx), n AS (SELECT count(*)::DOUBLE AS n FROM fx), d AS (SELECT term, count(*) AS df FROM t GROUP BY term) SELECT term, df, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 9) AS idf FROM d, n",
        "bm25_topk": f"WITH {CHUNKS}, {QUERIES}, {_bm25(10)} SELECT query_id, rank, chunk_pos, round(score, 6) AS score FROM bm",
        "rrf_fusion": f"""WITH {both}, u AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (FROM l1 UNION ALL FROM l2) GROUP BY query_id, chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM u) SELECT query_id, rank::INT AS rank, chunk_id, round(score, 9) AS score FROM r WHERE rank <= 20""",
        "candidate_union": f"""WITH {both}, u AS (SELECT query_id, chunk_id, min(o) AS o FROM (SELECT query_id, chunk_id, rank AS o FROM l1 UNION ALL SELECT query_id, chunk_id, rank + 1000 FROM l2) GROUP BY query_id, chunk_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY o))::INT AS rank, chunk_id FROM u""",
        "lexical_rerank": f"""WITH {CHUNKS}, {QUERIES}, {_bm25(20)}, o AS (SELECT bm.query_id, rank, chunk_id, len(list_intersect(list_distinct({_words("coalesce(uq.text, '')")}), list_distinct({_words("fx.text")}))) AS ov FROM bm JOIN fx USING (chunk_pos) JOIN uq ON uq.query_id = bm.query_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY ov DESC, rank))::INT AS rank, chunk_id, ov::BIGINT AS overlap FROM o""",
        "parent_expand": f"""WITH {children}, {QUERIES}, {_bm25(20, chunks='pc')}, u AS (SELECT query_id, parent_id, min(rank) AS o FROM bm JOIN pc USING (chunk_pos) GROUP BY query_id, parent_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY o))::INT AS rank, parent_id AS chunk_id FROM u""",
        "normalized_vectors": f"WITH {_EMB}, u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v) SELECT vec_id, unnest(range(64))::INT AS d, round(unnest(e), 9) AS x FROM u",
        "passage_texts": rf"WITH x AS (SELECT doc_id, regexp_replace(coalesce(source, ''), '^[{_WS}]+|[{_WS}]+$', '', 'g') AS t, regexp_replace(coalesce(text, ''), '^[{_WS}]+|[{_WS}]+$', '', 'g') AS b FROM documents), y AS (SELECT doc_id, CASE WHEN t <> '' THEN t || chr(10) || chr(10) || b ELSE b END AS w FROM x) SELECT doc_id, length(w)::BIGINT AS n_chars, sha256(w) AS version FROM y",
        "score_query": f"""WITH {ITEMS}, i5 AS (SELECT * FROM it WHERE rank <= 5), {_covered('i5', 'cv')}, {_satisfied('cv', 'hh')}, ks AS (SELECT unnest(range(1, 21)) AS k), pre AS (SELECT k, it.* FROM it JOIN ks ON rank <= k), {_covered('pre', 'pv', 'k')}, {_satisfied('pv', 'ph', 'k')},
cr AS (SELECT query_id, min(k)::INT AS rank FROM ph GROUP BY query_id), tk AS (SELECT query_id, sum(n_tokens)::BIGINT AS t FROM i5 GROUP BY query_id), br AS (SELECT query_id, count(DISTINCT span_id)::BIGINT AS b FROM cv WHERE coverage >= 0.8::DOUBLE AND best_single < 0.8::DOUBLE GROUP BY query_id)
SELECT query_id, query_id IN (FROM hh) AS hit, coalesce(t, 0)::BIGINT AS retrieved_tokens, coalesce(b, 0)::BIGINT AS fragmented, rank AS gold_completion_rank FROM uq LEFT JOIN tk USING (query_id) LEFT JOIN br USING (query_id) LEFT JOIN cr USING (query_id)""",
        "gold_spans": f'WITH {SPANS} SELECT DISTINCT query_id, span_id, source_id, s0 AS "start", e0 AS "end" FROM sp',
        **{name: f"""WITH {DOCS}, {SPANS} SELECT query_id, alt_idx, span_idx, CASE WHEN docs.id IS NULL THEN 'unknown_source' WHEN source_version IS NOT NULL AND {differ} THEN 'version_mismatch'
WHEN e0 > length(text) THEN 'out_of_range' WHEN substr(text, s0 + 1, e0 - s0) IS DISTINCT FROM quoted_text THEN 'quote_mismatch' END AS reason FROM sp LEFT JOIN docs ON docs.id = sp.source_id"""
           for name, differ in (("gold_verify", _WHOLE), ("gold_verify_short", _SHORT))},
        **{name: f"""WITH {DOCS}, {SPANS}, bad AS (SELECT query_id FROM sp LEFT JOIN docs ON docs.id = sp.source_id WHERE docs.id IS NULL OR (source_version IS NOT NULL AND {differ})
OR e0 > length(text) OR substr(text, s0 + 1, e0 - s0) IS DISTINCT FROM quoted_text) SELECT query_id FROM uq WHERE query_id NOT IN (FROM bad)"""
           for name, differ in (("load_queries_exact", _WHOLE), ("load_queries", _SHORT))},
        "gold_authoring": f"""WITH {DOCS}, {SPANS} SELECT query_id, alt_idx, span_idx, CASE WHEN length(quoted_text) > 0 AND strpos(text, quoted_text) > 0 THEN strpos(text, quoted_text) - 1 END::BIGINT AS "start", sha256(text) AS source_version,
CASE WHEN docs.id IS NULL THEN 'unknown_source' WHEN coalesce(length(quoted_text), 0) = 0 THEN 'empty_quote' WHEN strpos(text, quoted_text) = 0 THEN 'quote_not_found' END AS reason FROM sp LEFT JOIN docs ON docs.id = sp.source_id""",
        "span_coverage": f"WITH {ITEMS}, {_covered('it', 'cv')} SELECT query_id, alt_idx, span_idx, round(coverage, 9) AS coverage, round(best_single, 9) AS best_single FROM cv",
        "hit_at_k": f"WITH {ITEMS}, i5 AS (SELECT * FROM it WHERE rank <= 5), {_covered('i5', 'cv')}, {_satisfied('cv', 'hh')} SELECT query_id, query_id IN (FROM hh) AS hit FROM uq",
        "completion_rank": f"""WITH {ITEMS}, ks AS (SELECT unnest(range(1, 21)) AS k), pre AS (SELECT k, it.* FROM it JOIN ks ON rank <= k), {_covered('pre', 'cv', 'k')}, {_satisfied('cv', 'hh', 'k')}
SELECT query_id, min(k)::INT AS rank FROM hh GROUP BY query_id""",
        "fragmentation": f"WITH {DOCS}, {_fixed(40, 0)}, {SPANS}, {_bm25(20)}, i AS (SELECT query_id, rank, source_id, s, e FROM bm JOIN fx USING (chunk_pos)), {_covered('i', 'cv')} SELECT DISTINCT query_id, span_id FROM cv WHERE coverage >= 0.8::DOUBLE AND best_single < 0.8::DOUBLE",
        "budget_pack": f"WITH {ITEMS}, r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY query_id ORDER BY rank) AS run FROM it) SELECT query_id, rank::INT AS rank, chunk_id, run::BIGINT AS running_tokens FROM r WHERE run <= 200",
        "stage_items": f"""WITH {_ATTRIBUTED}, st AS (SELECT query_id, rank, chunk_id FROM it)
SELECT query_id, stage, rank::INT AS rank, chunk_id FROM (SELECT query_id, unnest(['sparse_candidates', 'candidate_union', 'reranker_input']) AS stage, rank, chunk_id FROM st
UNION ALL SELECT query_id, unnest(['reranked', 'pre_final']), rank, chunk_id FROM rr UNION ALL SELECT query_id, 'final', rank, chunk_id FROM fin UNION ALL SELECT query_id, 'budget_packed', rank, chunk_id FROM bud)""",
        "stage_attribution": f"""WITH {_ATTRIBUTED} SELECT query_id, f_budget AS hit, CASE WHEN f_budget THEN NULL WHEN NOT f_all THEN 'representation' WHEN NOT f_union THEN 'candidate_generation'
WHEN NOT f_final THEN 'reranker_demotion' ELSE 'budget_cutoff' END AS stage_attribution FROM fl""",
        "branch_diag": f"WITH {_ATTRIBUTED} SELECT query_id, f_union AS sparse, 1::INT AS branches FROM fl",
        "attribution_invariant": f"WITH {_ATTRIBUTED} SELECT count(*) FILTER (f_budget) AS hits, count(*) FILTER (NOT f_budget) AS misses, count(*) FILTER (NOT f_budget) AS explained, 0::BIGINT AS wrong FROM fl",
        "config_metrics": f"WITH {_METRICS} SELECT config_id, n, hits, round(hit_rate, 9) AS hit_rate, CASE WHEN n >= 20 THEN round({lo}, 9) END AS lo, CASE WHEN n >= 20 THEN round({hi}, 9) END AS hi, round(mrr, 9) AS mrr, n < 20 AS verdict_suppressed, fragmented_queries FROM ct",
        "wilson_intervals": f"WITH c AS (SELECT event_type, count(*) FILTER (value > 50) AS hits, count(*) AS n FROM events GROUP BY event_type) SELECT event_type, round({lo}, 9) AS lo, round({hi}, 9) AS hi FROM c",
        "stage_breakdown": f"WITH {_LIVE} SELECT config_id, stage_attribution AS stage, count(*) AS misses FROM lv WHERE NOT h AND stage_attribution IS NOT NULL GROUP BY config_id, stage_attribution",
        "paired_compare": f"WITH {_RESULTS} SELECT a.config_id AS config_a, b.config_id AS config_b, count(*) AS n, round(avg(coalesce(a.hit, false)::INT - coalesce(b.hit, false)::INT), 9) AS mean_diff FROM rs a JOIN rs b ON a.query_id = b.query_id AND a.config_id < b.config_id GROUP BY 1, 2",
        "validity_gates": f"WITH {_METRICS} SELECT count(*) > 0 AND bool_and(hits = 0) AS baseline_broken, bool_or(n < 20) AS verdicts_suppressed FROM ct",
        "ranked_configs": f"WITH {_METRICS} SELECT (row_number() OVER (ORDER BY round(hit_rate, 9) DESC, round(mrr, 9) DESC, config_id))::INT AS rank, config_id, round(hit_rate, 9) AS hit_rate, round(mrr, 9) AS mrr FROM ct",
        "best_config": f"WITH {_METRICS} SELECT config_id, round(hit_rate, 9) AS hit_rate, round(mrr, 9) AS mrr FROM ct WHERE NOT (SELECT bool_or(n < 20) FROM ct) ORDER BY 2 DESC, 3 DESC, 1 LIMIT 1",
        "pareto_frontier": f"""WITH {_METRICS}, p AS (SELECT ct.config_id, hit_rate, mrr, t FROM ct JOIN (SELECT config_id, avg(coalesce(retrieved_tokens, 0))::DOUBLE AS t FROM lv GROUP BY config_id) USING (config_id))
SELECT config_id, round(hit_rate, 9) AS hit_rate, round(mrr, 9) AS mrr, round(t, 6) AS avg_tokens FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.hit_rate >= a.hit_rate AND b.t <= a.t AND (b.hit_rate > a.hit_rate OR b.t < a.t))""",
        "average_tokens": f"WITH {_LIVE} SELECT config_id, round(avg(coalesce(retrieved_tokens, 0)), 6)::DOUBLE AS avg_tokens FROM lv GROUP BY config_id",
        "explain_query": f"WITH {_RESULTS} SELECT query_id, config_id, hit, stage_attribution, gold_completion_rank, coalesce(len(fragmented_spans), 0) > 0 AS fragmented, branch_diag['dense'] AS dense, branch_diag['sparse'] AS sparse FROM rs",
        "latency_stats": "SELECT event_type AS config_id, count(value) AS n, round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms FROM events GROUP BY event_type",
        "config_parts": r"SELECT DISTINCT config_id, split_part(config_id, '|', 1) AS embed, split_part(config_id, '|', 2) AS chunker, split_part(config_id, '|', 3) AS retrieval, regexp_extract(config_id, 'rerank=([^|]*)', 1) AS rerank, regexp_extract(config_id, 'budget=([^|]*)', 1) AS budget, coalesce(nullif(regexp_extract(config_id, 'index=([^|]*)', 1), ''), 'exact') AS idx FROM results",
        "hubness_counts": f"WITH {_NEAR} SELECT vec_id AS id, count(x)::BIGINT AS times FROM v LEFT JOIN (SELECT * FROM nn WHERE r <= 10) ON y = vec_id GROUP BY vec_id",
        "hubness": f"""WITH {_NEAR}, c AS (SELECT vec_id, count(x)::DOUBLE AS t FROM v LEFT JOIN (SELECT * FROM nn WHERE r <= 10) ON y = vec_id GROUP BY vec_id), m AS (SELECT avg(t) AS mu, stddev_pop(t) AS sd FROM c)
SELECT 10::INT AS k, round(avg(pow((t - mu) / sd, 3)), 6) AS skewness FROM c, m""",
        "anisotropy": f"WITH {_EMB}, p AS (SELECT avg(list_cosine_similarity(a.e, b.e)) AS m FROM v a JOIN v b ON a.vec_id <> b.vec_id) SELECT round(m, 9) AS mean_cosine, round(1 - m, 9) AS isotropy FROM p",
        "query_corpus_mismatch": f"""WITH {_EMB}, u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v), d AS (SELECT vec_id % 20 = 0 AS q, vec_id, unnest(range(64)) AS d, unnest(e) AS x FROM u),
c AS (SELECT d, avg(x) FILTER (q) AS a, avg(x) FILTER (NOT q) AS b FROM d GROUP BY d), n AS (SELECT a.vec_id, max(round(list_cosine_similarity(a.e, b.e), 9)) AS s FROM v a JOIN v b ON a.vec_id % 20 = 0 AND b.vec_id % 20 <> 0 GROUP BY a.vec_id)
SELECT round((SELECT sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) FROM c), 6) AS centroid_cosine, round((SELECT avg(s) FROM n), 6) AS mean_nearest""",
        "dense_text_topk": f"WITH {CHUNKS}, {QUERIES}, {_dense(10)} SELECT query_id, rank, chunk_pos FROM dn",
        "dense_text_scores": f"WITH {CHUNKS}, {QUERIES}, {_dense(10)} SELECT query_id, rank, round(score, 6) AS score FROM dn",
        "hybrid_fusion": f"WITH {hybrid} SELECT query_id, rank, chunk_id, round(score, 9) AS score FROM hf WHERE rank <= 20",
        "hybrid_union": f"WITH {hybrid} SELECT query_id, place AS rank, chunk_id FROM hf",
        **{name: f"""WITH {mixed(n)}, i20 AS (SELECT * FROM hf WHERE rank <= {n}), i5 AS (SELECT *, {_tokens('text')} AS n_tokens FROM hf WHERE rank <= {k}), i5r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY query_id ORDER BY rank) AS run FROM i5),
ib AS (SELECT * FROM i5r WHERE run <= 200), idn AS (SELECT query_id, rank, source_id, s, e FROM dn JOIN fx USING (chunk_pos)), isp AS (SELECT query_id, rank, source_id, s, e FROM bm JOIN fx USING (chunk_pos)), {every},
{needed('al', 'all')}, {needed('hf', 'union')}, {needed('i20', 'fused')}, {needed('i5', 'final')}, {needed('ib', 'budget')}, {needed('idn', 'dense')}, {needed('isp', 'sparse')}, {done('i20')},
tk AS (SELECT query_id, sum(n_tokens)::BIGINT AS t FROM ib GROUP BY query_id)
SELECT query_id, query_id IN (FROM h_budget) AS hit, CASE WHEN query_id IN (FROM h_budget) THEN NULL WHEN query_id NOT IN (FROM h_all) THEN 'representation' WHEN query_id NOT IN (FROM h_union) THEN 'candidate_generation'
WHEN query_id NOT IN (FROM h_fused) THEN 'fusion' WHEN query_id NOT IN (FROM h_final) THEN 'final_cutoff' ELSE 'budget_cutoff' END AS stage_attribution,
query_id IN (FROM h_dense) AS dense, query_id IN (FROM h_sparse) AS sparse, cr.rank AS gold_completion_rank, coalesce(t, 0)::BIGINT AS retrieved_tokens FROM uq LEFT JOIN cr USING (query_id) LEFT JOIN tk USING (query_id)""" for name, n, k in (("hybrid_attribution", 20, 5), ("fusion_attribution", 1, 1))},
        "dense_attribution": f"""WITH {CHUNKS}, {SPANS}, {_dense(20)}, i20 AS (SELECT query_id, rank, source_id, s, e FROM dn JOIN fx USING (chunk_pos)), i5 AS (SELECT * FROM i20 WHERE rank <= 5), {every},
{needed('al', 'all')}, {needed('i20', 'union')}, {needed('i5', 'final')}, {done('i20')}
SELECT query_id, query_id IN (FROM h_final) AS hit, CASE WHEN query_id IN (FROM h_final) THEN NULL WHEN query_id NOT IN (FROM h_all) THEN 'representation' WHEN query_id NOT IN (FROM h_union) THEN 'candidate_generation' ELSE 'final_cutoff' END AS stage_attribution,
query_id IN (FROM h_union) AS dense, cr.rank AS gold_completion_rank FROM uq LEFT JOIN cr USING (query_id)""",
        "jsonl_documents": f"WITH {DOCS} SELECT id, length(text)::BIGINT AS n_chars, sha256(text) AS version FROM docs",
        "beir_import": f"""WITH {DOCS}, {SPANS}, w AS (SELECT id, regexp_replace(text, '^[{_WS}]+|[{_WS}]+$', '', 'g') AS text FROM docs),
r AS (SELECT query_id, source_id, text, min((alt_idx, span_idx)) AS first FROM sp JOIN w ON w.id = sp.source_id GROUP BY query_id, source_id, text),
k AS (SELECT query_id, count(*) AS alternatives, arg_min(sha256(text), first) AS version FROM r WHERE text <> '' GROUP BY query_id)
SELECT query_id, row_number() OVER (ORDER BY query_id) AS query_pos, alternatives::INT AS alternatives, version FROM k JOIN uq USING (query_id) WHERE uq.text IS NOT NULL""",
    }
