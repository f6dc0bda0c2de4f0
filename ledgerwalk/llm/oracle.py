"""DuckDB SQL for the registered queries that SQL can express.

Patterns, tables and constants that must be equal come from the operators;
the computation is written on its own: positions and entropies are counted
window by window, top-k scores by a full join, the mix by plain windows."""

from __future__ import annotations

from . import collocations, decontam, secret_scan, sharding


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _secret_sql() -> str:
    kinds = [(0, secret_scan.ASSIGN), (1, secret_scan.ACCESS), (2, secret_scan.HEX)] + [(i + 3, c.pattern) for i, c in enumerate(secret_scan.CLASSES)]
    found = " UNION ALL ".join(
        f"SELECT rid, {k} AS k, regexp_extract_all(t, {_quoted(p)}) AS hits, "
        f"{'regexp_extract_all(t, ' + _quoted(p) + ', 2)' if k == 0 else 'NULL::VARCHAR[]'} AS vals, "
        f"string_split_regex(t, {_quoted(p)}) AS gaps FROM d" for k, p in kinds)
    names = "CASE k " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(secret_scan.KINDS)) + " END"
    classes = ", ".join(f"({i + 3}, {c.window}, {secret_scan.plogp_limit(c)}, {str(c.fold).lower()})" for i, c in enumerate(secret_scan.CLASSES))
    allow = " AND ".join(f"NOT regexp_matches(h, {_quoted(a)})" for a in secret_scan.ALLOW)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({found}),
e AS (SELECT rid, k, unnest(hits) AS h, unnest(vals) AS v, unnest(gaps[1:len(hits)]) AS g, unnest(range(1, len(hits) + 1)) AS i
      FROM m WHERE len(hits) > 0),
a AS (SELECT *, sum(length(g)) OVER (PARTITION BY rid, k ORDER BY i)
             + coalesce(sum(length(h)) OVER (PARTITION BY rid, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM e),
base AS (SELECT rid, k, s, s + length(h) AS e FROM a WHERE k = 1 OR k = 2 OR (k = 0 AND length(v) >= {secret_scan.ASSIGN_VALUE_MIN})),
c(k, w, lim, fold) AS (VALUES {classes}),
cand AS (SELECT a.rid, a.k, a.s, c.w, c.lim, CASE WHEN c.fold THEN lower(h) ELSE h END AS h FROM a JOIN c ON a.k = c.k WHERE {allow}),
win AS (SELECT *, unnest(range(0, length(h) - w + 1)) AS o FROM cand),
chars AS (SELECT rid, k, s, o, w, lim, unnest(string_split(substr(h, (o + 1)::BIGINT, w), '')) AS ch FROM win),
counted AS (SELECT rid, k, s, o, w, lim, ch, count(*) AS n FROM chars GROUP BY ALL),
hot AS (SELECT rid, k, s, s + o AS b, s + o + w AS e FROM counted GROUP BY rid, k, s, o, w, lim
        HAVING sum(CASE WHEN n = 1 THEN 0 ELSE round(n * log2(n) * 1048576)::BIGINT END) <= lim),
edge AS (SELECT *, CASE WHEN b <= max(e) OVER (PARTITION BY rid, k, s ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                   THEN 0 ELSE 1 END AS fresh FROM hot),
grp AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, k, s ORDER BY b) AS gno FROM edge),
spans AS (SELECT rid, k, s, e FROM base UNION ALL SELECT rid, k, min(b), max(e) FROM grp GROUP BY rid, k, s, gno),
txt AS (SELECT rid, k, s, {names} || ':' || s::BIGINT || ':' || e::BIGINT AS x FROM spans),
per AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
        string_agg(x, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(x, ',' ORDER BY s, k) AS spans FROM txt GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (rid)"""


WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)"""

TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


def _shard_sql() -> str:
    owners = ",".join(str(i) for i in sharding.fill_table(sharding.SHARDS, sharding.TABLE_SIZE))
    return f"""
WITH t AS (SELECT string_split('{owners}', ',') AS owner),
d AS (SELECT doc_id, (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % {sharding.TABLE_SIZE})::INTEGER AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(owner[slot + 1], 2, '0') AS shard FROM d, t"""


def mix_ctes(table: str) -> str:
    return f"""
d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
      md5('mix:' || doc_id) AS okey FROM {table}),
q AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY okey) - size AS before FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 3 * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER z AS i, (sum(source_size) OVER ()) - (sum(cap) OVER z - cap) AS rest,
      (sum(w) OVER ()) - (sum(w) OVER z - w) AS rest_w FROM w
      WINDOW z AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l AS (SELECT i AS li, rest AS lrest, rest_w AS lrest_w FROM o WHERE rest * w <= cap * rest_w ORDER BY i LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN i < li THEN cap::DOUBLE ELSE (w * lrest)::DOUBLE / lrest_w::DOUBLE END AS target FROM o, l)"""


MIX_SQL = f"""
WITH {mix_ctes("documents")}
SELECT doc_id, size, source_size, target,
       (greatest(least(floor(target) - before, size), 0) + greatest(least(floor(target) - source_size - before, size), 0)
        + greatest(least(floor(target) - 2 * source_size - before, size), 0))::BIGINT AS taken,
       (before + size) / target AS virtual_finish
FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source"""

def decontam_ctes(table: str) -> str:
    def words(t: str) -> str:
        lower = f"translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return f"list_filter(string_split_regex({lower}, '{decontam.SEPARATORS}'), lambda x: x <> '')"

    return f"""
i AS (SELECT item_id::VARCHAR AS item_id, {words("text")} AS w FROM benchmark),
iw AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS o FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[o:o + 9], ' ') AS phrase FROM iw),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT row_number() OVER () AS rid, doc_id, {words("text")} AS w FROM {table}),
pos AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS p FROM dw WHERE len(w) > 0),
occ AS (SELECT rid, p, n, array_to_string(w[p:p + n - 1], ' ') AS phrase FROM pos, sizes WHERE p + n - 1 <= len(w)),
hit AS (SELECT rid, p, occ.n, item_id FROM occ JOIN win ON occ.phrase = win.phrase AND occ.n = win.n),
cov AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS x FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)"""


DECONTAM_SQL = f"""
WITH {decontam_ctes("documents")}
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)"""

def jaccard_ctes(table: str) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
jd AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex({lower}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table}),
sh AS (SELECT rid, array_to_string(w, ' ') AS s FROM jd WHERE len(w) BETWEEN 1 AND 4
       UNION SELECT rid, array_to_string(w[i:i + 4], ' ') FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM jd WHERE len(w) >= 5)),
sn AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
met AS (SELECT a.rid AS a, b.rid AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.rid <> b.rid GROUP BY ALL),
link AS (SELECT a, b FROM met JOIN sn x ON x.rid = a JOIN sn y ON y.rid = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT rid AS a, rid AS b FROM jd UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT r.a AS rid, min(jd.doc_id) AS component_id FROM reach r JOIN jd ON jd.rid = r.b GROUP BY r.a)"""


JACCARD_SQL = f"""
WITH RECURSIVE {jaccard_ctes("documents")}
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM jd JOIN comp USING (rid) LEFT JOIN sn USING (rid)"""


TRIE_SQL = """
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 100 AS b, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295) % 6 AS h FROM ids),
t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations),
reb AS (SELECT convs.c, 0 AS own, pos, r, x FROM convs JOIN t ON t.c = b AND pos <= h UNION ALL SELECT convs.c, 1, pos, r, x FROM convs JOIN t USING (c) WHERE pos > h),
seq AS (SELECT c, coalesce(list({'r': r, 'x': x} ORDER BY own, pos) FILTER (r IS NOT NULL), []) AS s FROM ids LEFT JOIN reb USING (c) GROUP BY c),
pre AS (SELECT c, d, s[1:d] AS p, len(s) = d AS fin FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM seq)),
node AS (SELECT p, d, min(c) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (fin), '')) AS ends FROM pre GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * length(p[d].x) END AS saved FROM node LEFT JOIN kids USING (p)),
up AS (SELECT p[1:k] AS p, n_children, saved FROM (SELECT *, unnest(range(d + 1)) AS k FROM full_node)),
sub AS (SELECT p, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY p)
SELECT f.conv_id, f.d AS depth, a.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, n_leaves, saved_tokens, f.ends AS ends_sha256
FROM full_node f JOIN sub USING (p) LEFT JOIN node a ON f.d > 0 AND a.d = f.d - 1 AND a.p = f.p[1:f.d - 1]"""

COLLOCATIONS_SQL = f"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS s FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(s, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM piece),
g AS (SELECT lang, k, w[i:i + k - 1] AS p FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS ks(k))),
f AS (SELECT lang, k, p, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT * FROM f WHERE k > 1 AND a >= {collocations.MIN_COUNT}),
ways AS (SELECT lang, k, p, a, ck, p[1:ck] AS lp, p[ck + 1:k] AS rp FROM (SELECT *, unnest(range(1, k)) AS ck FROM cand)),
cut AS (SELECT c.lang, c.p, c.k, c.a, ck, l.a AS l, r.a AS r, (1000000::HUGEINT * c.a * c.a // (l.a::HUGEINT * r.a))::BIGINT AS score
        FROM ways c JOIN f l ON l.lang = c.lang AND l.p = c.lp JOIN f r ON r.lang = c.lang AND r.p = c.rp),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, ck) = 1),
longer AS (SELECT lang, p[1:2] AS p, a, 0 AS lf, 1 AS rt FROM cand WHERE k = 3 UNION ALL SELECT lang, p[2:3], a, 1, 0 FROM cand WHERE k = 3),
most AS (SELECT lang, p, max(a) AS most, sum(lf)::BIGINT AS lefts, sum(rt)::BIGINT AS rights FROM longer GROUP BY lang, p),
kept AS (SELECT b.*, array_to_string(b.p, ' ') AS phrase, coalesce(lefts, 0) AS lefts, coalesce(rights, 0) AS rights FROM best b LEFT JOIN most m ON m.lang = b.lang AND m.p = b.p
         WHERE most IS NULL OR 100 * most < {collocations.ABSORBED_PCT} * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score, lefts, rights FROM ranked JOIN n USING (lang) WHERE rank <= {collocations.TOP}"""

ORACLE = {"op1_secret_scan": _secret_sql(), "op2_warc": WARC_SQL, "op3_exact_topk": TOPK_SQL, "op4_sharding": _shard_sql(), "op5_decontamination": DECONTAM_SQL, "op8_jaccard_join": JACCARD_SQL,
          "op10_mixing": MIX_SQL, "op11_prefix_trie": TRIE_SQL, "op12_collocations": COLLOCATIONS_SQL}
