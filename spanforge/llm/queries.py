"""The queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from .ann import op8_nearest
from .codes import op11_codes
from .embdedup import op3_embedding_dedup
from .langid import op5_langid
from .linededup import op2_line_dedup
from .minhash import op1_minhash
from .mixing import op9_mixing
from .packing import op10_packing
from .pii import op6_pii
from .resample import op13_resample
from .secretscan import op7_secrets
from .substrings import op12_substrings
from .toxicity import op4_toxicity

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_line_dedup": op2_line_dedup,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_langid": op5_langid,
    "op6_pii": op6_pii,
    "op7_secrets": op7_secrets,
    "op8_nearest": op8_nearest,
    "op9_mixing": op9_mixing,
    "op10_packing": op10_packing,
    "op11_codes": op11_codes,
    "op12_substrings": op12_substrings,
    "op13_resample": op13_resample,
}


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds of op11 one after another; vectors of one length."""
    nearest = """SELECT vec_id, a.part, min(list_sum([(a.x[i] - b.x[i]) * (a.x[i] - b.x[i]) for i in generate_series(1, len(a.x))]) * 256 + b.k) AS best FROM p a JOIN b{r} b ON a.part = b.part GROUP BY ALL"""
    ctes = f"""v AS (SELECT vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e FROM embeddings
WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
p AS MATERIALIZED (SELECT vec_id, part, e[part * (len(e) // {parts}) + 1:(part + 1) * (len(e) // {parts})] AS x FROM v, range({parts}) r(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS k, x FROM p QUALIFY k < {entries})"""
    for r in range(rounds):
        ctes += f""",
a{r} AS MATERIALIZED ({nearest.format(r=r)}),
s{r} AS (SELECT a.part, best % 256 AS k, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM a{r} a JOIN p ON a.vec_id = p.vec_id AND a.part = p.part),
m{r} AS (SELECT part, k, i, sum(c) AS s, count(*) AS n FROM s{r} GROUP BY ALL),
u{r} AS (SELECT part, k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM m{r} GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT part, k, coalesce(u.x, b.x) AS x FROM b{r} b LEFT JOIN u{r} u USING (part, k))"""
    return f"""WITH {ctes},
z AS ({nearest.format(r=rounds)}),
c AS (SELECT vec_id, string_agg(lpad(lower(to_hex(CAST(best % 256 AS BIGINT))), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM z GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
(SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, k)) FROM b{rounds}) AS codebooks_sha256 FROM c JOIN v USING (vec_id)"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Operators that learn, search by approximation or place rows by a hash have no SQL; tests hold them against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op1_minhash": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE [array_to_string(ws[i:i + 4], ' ') for i in generate_series(1, len(ws) - 4)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS both_n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n x ON u = x.doc_id JOIN n y ON v = y.doc_id WHERE 100 * both_n >= 75 * (x.n + y.n - both_n)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
c AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT c.doc_id, e.v FROM c JOIN e ON c.root = e.u),
m AS (SELECT doc_id, min(root) AS component_id FROM c GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN m ON d.doc_id = m.doc_id LEFT JOIN n ON d.doc_id = n.doc_id""",
    "op2_line_dedup": f"""WITH p AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM p),
k AS (SELECT *, {_LOWER.format("regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')")} AS key FROM l),
h AS (SELECT key AS gone FROM k WHERE length(key) >= 1 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone IS NULL), '')) AS kept_sha256 FROM k LEFT JOIN h ON key = gone GROUP BY doc_id""",
    "op3_embedding_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in e if x <> 0]) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
c AS (SELECT vec_id, vec_id AS root FROM v UNION SELECT c.vec_id, l.v FROM c JOIN l ON c.root = l.u),
m AS (SELECT vec_id, min(root) AS component_id FROM c GROUP BY 1), n AS (SELECT u, count(*) AS n FROM l GROUP BY 1)
SELECT m.vec_id, coalesce(n, 0) AS n_links, component_id, m.vec_id = component_id AS kept FROM m LEFT JOIN n ON m.vec_id = u""",
    "op11_codes": _codes_sql(),
    "op12_substrings": """WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 34], ' ')) AS g FROM w, unnest(generate_series(1, len(ws) - 34)) t(i)),
n AS (SELECT g FROM s GROUP BY 1 HAVING count(*) > 1),
r AS (SELECT doc_id, list(i ORDER BY i) AS starts FROM s SEMI JOIN n USING (g) GROUP BY 1),
t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
h AS (SELECT doc_id, i, true AS hit FROM (SELECT doc_id, unnest(starts) AS i FROM r)),
m AS (SELECT t.doc_id, t.j, t.word, count(hit) OVER (PARTITION BY t.doc_id ORDER BY j ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) > 0 AS gone FROM t LEFT JOIN h ON t.doc_id = h.doc_id AND t.j = h.i),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id""",
    "op13_resample": f"""WITH RECURSIVE g AS (SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM g WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM g WHERE k = 8),
w AS (SELECT 'd' AS kind, doc_id AS id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
UNION ALL SELECT 'b', item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS MATERIALIZED (SELECT kind, id, unnest([array_to_string(ws[i:i + n - 1], ' ') for i in generate_series(1, len(ws) - n + 1)]) AS f FROM w, (VALUES (1), (2), (3)) v(n)),
y AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
x AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || h[2 * i - 1:2 * i] AS BIGINT) for i in generate_series(1, len(h) // 2)]), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS b FROM y, tab),
n AS (SELECT b, count(*) FILTER (WHERE kind = 'd') AS s, count(*) FILTER (WHERE kind = 'b') AS t FROM f JOIN x USING (f) GROUP BY 1),
a AS (SELECT sum(s) AS s, sum(t) AS t FROM n),
gain AS (SELECT b, CAST(floor(1000 * ln(CAST(n.t + 1 AS DOUBLE) * CAST(a.s + 10000 AS DOUBLE) / (CAST(n.s + 1 AS DOUBLE) * CAST(a.t + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM n, a),
d AS (SELECT id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN x USING (f) JOIN gain USING (b) WHERE kind = 'd' GROUP BY 1),
e AS (SELECT w.id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(ws) AS words,
coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || w.id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM w LEFT JOIN d ON w.id = d.id WHERE kind = 'd'),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM e WHERE words >= 20)
SELECT e.doc_id, n_features, weight, score, rank FROM e LEFT JOIN r ON e.doc_id = r.doc_id AND rank <= 5 * n // 100""",
}
