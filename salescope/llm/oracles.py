"""DuckDB SQL of the training-data queries that SQL can express.

Language ID, the classifier, personal data (iterated graph scores), quality rules (concentration
steps), sharding (its CRC-32 column), token output and SentencePiece pieces have none; their tests hold them
against brute force or the library itself.
"""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUP = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
low AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.m, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(low.m, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)"""

MIXING = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
k AS (SELECT doc_id, source, len(regexp_extract_all(t, '{_WORD}')) AS size,
             round(0.25 + 0.75 * CASE WHEN length(t) > 0 THEN length(regexp_replace(t, '[^\p{{L}} ]+', '', 'g')) / length(t) ELSE 0.0 END, 6) AS wt,
             (('0x' || substr(md5('mix|' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM d),
n AS (SELECT *, -ln(u) / wt AS key FROM k),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM n GROUP BY source),
c AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w,
             2.0 * source_size::DOUBLE AS cap FROM per),
l AS (SELECT *, (1.5 * sum(source_size) OVER ()::DOUBLE
                 - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
                / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM l AS x WHERE x.level * x.w <= x.cap ORDER BY x.cap / x.w, x.level LIMIT 1) * w, cap)) AS target
      FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
             row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM t),
r AS (SELECT n.*, e.source_size, e.target, e.epochs, e.sid, row_number() OVER (PARTITION BY e.sid ORDER BY key, doc_id) AS pos
      FROM n JOIN e ON n.source IS NOT DISTINCT FROM e.source),
-- the budget left after whole epochs, document by document in draw order: one that fits is taken, others are passed over
walk AS (SELECT sid, 0::BIGINT AS pos, floor(target)::BIGINT - epochs * source_size AS gap, false AS inside FROM e
         UNION ALL
         SELECT w.sid, r.pos, w.gap - CASE WHEN r.size <= w.gap THEN r.size ELSE 0 END, r.size <= w.gap
         FROM walk w JOIN r ON r.sid = w.sid AND r.pos = w.pos + 1),
g AS (SELECT r.*, walk.inside, min(walk.gap) OVER (PARTITION BY r.sid) AS gap FROM r JOIN walk ON walk.sid = r.sid AND walk.pos = r.pos),
f AS (SELECT *, row_number() OVER (PARTITION BY sid, NOT inside AND size < 2 * gap ORDER BY abs(size - gap), key, doc_id) AS near,
             row_number() OVER (PARTITION BY sid, inside OR size = 0 ORDER BY key, doc_id) AS first_out,
             least(gap, coalesce(min(CASE WHEN NOT inside THEN abs(size - gap) END) OVER (PARTITION BY sid), gap)) > 0.05::DOUBLE * target AS cut FROM g)
SELECT doc_id, size, source_size, target,
       (epochs + CASE WHEN inside OR (NOT cut AND size < 2 * gap AND near = 1) THEN 1 ELSE 0 END) * size
       + CASE WHEN cut AND NOT inside AND size > 0 AND first_out = 1 THEN gap ELSE 0 END AS taken
FROM f"""

LINE_DEDUP = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d),
-- passages: two lines, a text of one line, or one line of 50 words
v AS (SELECT doc_id, i, len(l[i:i + 1]) AS n, array_to_string(l[i:i + 1], chr(10)) AS x FROM w WHERE i < len(l) OR len(l) = 1
      UNION ALL
      SELECT doc_id, i, 1 AS n, l[i] AS x FROM w WHERE len(l) > 1 AND len(regexp_extract_all(l[i], '[^\x20\x09-\x0D]+')) >= 50),
o AS (SELECT *, row_number() OVER (PARTITION BY x, n ORDER BY doc_id, i) AS nth FROM v WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
gone AS (SELECT doc_id, list_sort(list(DISTINCT line)) AS gone FROM (
  SELECT doc_id, unnest(range(i - 1, i - 1 + n)) AS line FROM o WHERE nth > 1) GROUP BY doc_id),
j AS (SELECT doc_id, l, coalesce(gone, []) AS gone FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(l) AS n_lines, len(gone) AS n_removed, array_to_string(gone, ',') AS removed,
       sha256(array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(gone, i - 1)), lambda i: l[i]), chr(10))) AS text_sha256
FROM j"""

DECONTAMINATION = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS g, len(w[i:i + 12]) AS n
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
p AS (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d CROSS JOIN sizes),
hits AS (SELECT doc_id, i, p.n, win.item_id FROM p JOIN win ON win.n = p.n AND win.g = array_to_string(p.w[i:i + p.n - 1], ' ')),
cover AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(x, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)"""

# crc32 of the decimal digits of an id: the table of its polynomial, then one step per digit
_CRC_TABLE = """bits AS (SELECT b, 0 AS k, b AS c FROM (SELECT unnest(range(0, 256)) AS b)
         UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8)"""


def _crc(ident: str) -> str:
    return (f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({ident}::VARCHAR, ''), lambda x: ascii(x)::BIGINT), "
            "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)")


def _value(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


MANIFEST = rf"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT doc_id, source, {" || ".join(_value(c) for c in ("doc_id", "source", "lang", "n_chars"))} AS head, text,
             CASE WHEN {_crc("doc_id")} % 5 = 0 THEN {_LOWER.format("text")} ELSE text END AS other FROM documents, tab),
g AS (SELECT source, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS gid FROM (SELECT DISTINCT source FROM documents)),
l AS (SELECT doc_id, gid, sha256(head || {_value("text")}) AS leaf, sha256(head || {_value("other")}) AS claimed,
             row_number() OVER (PARTITION BY gid ORDER BY doc_id) - 1 AS pos
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
tree AS (SELECT gid, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY gid) AS n FROM l
         UNION ALL
         SELECT gid, level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM tree WHERE n > 1 GROUP BY gid, level, pos // 16),
sub AS (SELECT gid, h, level AS top FROM tree WHERE n = 1),
over AS (SELECT 0 AS level, gid AS pos, h, count(*) OVER () AS n FROM sub
         UNION ALL
         SELECT level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM over WHERE n > 1 GROUP BY level, pos // 16),
root AS (SELECT h AS root FROM over WHERE n = 1),
-- every node's siblings to its left and to its right
side AS (SELECT a.gid, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lft,
                coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS rgt
         FROM tree a JOIN tree b ON a.gid = b.gid AND a.level = b.level AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY ALL),
oside AS (SELECT a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lft,
                 coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS rgt
          FROM over a JOIN over b ON a.level = b.level AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY ALL),
path AS (SELECT doc_id, side.level AS step, lft, rgt FROM l JOIN side ON side.gid = l.gid AND side.pos = l.pos // power(16, side.level)::BIGINT
         UNION ALL
         SELECT doc_id, top + oside.level, lft, rgt FROM l JOIN sub USING (gid) JOIN oside ON oside.pos = l.gid // power(16, oside.level)::BIGINT),
walk AS (SELECT doc_id, 0 AS step, claimed AS h FROM l
         UNION ALL SELECT w.doc_id, w.step + 1, sha256(p.lft || w.h || p.rgt) FROM walk w JOIN path p ON p.doc_id = w.doc_id AND p.step = w.step),
folded AS (SELECT doc_id, arg_max(h, step) AS folded_root FROM walk GROUP BY doc_id),
proof AS (SELECT doc_id, sha256(string_agg(lft || rgt, '' ORDER BY step)) AS proof_sha256 FROM path GROUP BY doc_id)
SELECT l.doc_id, leaf, sub.h AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN sub USING (gid) JOIN folded USING (doc_id) LEFT JOIN proof USING (doc_id), root"""

TRIE = rf"""
WITH RECURSIVE {_CRC_TABLE},
own AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS v
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, v, {_crc("c")} % 6 AS h FROM own, tab),
b AS (SELECT h.c, coalesce(own.v[1:h.h], []) || h.v[h.h + 1:] AS v FROM h LEFT JOIN own ON own.c = h.c - h.c % 100),
pre AS (SELECT c, v, unnest(range(0, len(v) + 1)) AS d FROM b),
nodes AS (SELECT v[1:d] AS p, d AS depth, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = len(v)), '') AS ends
          FROM pre GROUP BY ALL),
kids AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (p)),
up AS (SELECT p[1:a] AS p, n_children = 0 AS leaf, CASE WHEN depth > 0 THEN (n_convs - 1) * length(p[depth].t) ELSE 0 END AS saved
       FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM full_nodes)),
sums AS (SELECT p, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY p)
SELECT f.conv_id, f.depth, parent.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_nodes f JOIN sums USING (p) LEFT JOIN nodes parent ON f.depth > 0 AND parent.p = f.p[1:f.depth - 1]"""

ORACLE = {
    "op4_minhash_near_dedup": NEAR_DUP,
    "op5_mixing": MIXING,
    "op6_line_dedup": LINE_DEDUP,
    "op8_decontamination": DECONTAMINATION,
    "op11_prefix_trie": TRIE,
    "op13_merkle_manifest": MANIFEST,
}
