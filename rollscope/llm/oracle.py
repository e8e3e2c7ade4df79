"""DuckDB SQL for the queries that SQL can express, each over whole tables."""
from __future__ import annotations

from .op10_secrets import BASE, RULES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
same AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b, c = x.n AND c = y.n AS equal FROM same JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
          WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM docs UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_ AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
twins AS (SELECT a, min(b) AS b FROM links WHERE equal GROUP BY a)
SELECT docs.doc_id, coalesce(n, 0) AS n_shingles, component_id, least(docs.doc_id, coalesce(twins.b, docs.doc_id)) AS set_id
FROM docs LEFT JOIN sizes ON sizes.doc_id = docs.doc_id JOIN least_ ON least_.a = docs.doc_id LEFT JOIN twins ON twins.a = docs.doc_id
"""

#: The same with every document's number of links.
OP1_LINKS = OP1.split("SELECT docs.doc_id, coalesce(n, 0)")[0].rstrip() + """,
found AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT docs.doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links
FROM docs LEFT JOIN sizes ON sizes.doc_id = docs.doc_id JOIN least_ ON least_.a = docs.doc_id LEFT JOIN found ON found.a = docs.doc_id
"""

OP3 = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1),
cover AS (SELECT words.doc_id, words.i, word, coalesce(max(CASE WHEN later.i IS NOT NULL THEN 1 ELSE 0 END) OVER (
            PARTITION BY words.doc_id ORDER BY words.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS gone
          FROM words LEFT JOIN later ON later.doc_id = words.doc_id AND later.i = words.i),
kept AS (SELECT doc_id, sum(gone) AS n, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS t FROM cover GROUP BY doc_id)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept ON kept.doc_id = docs.doc_id
"""

OP5 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
pieces AS (
  SELECT *, concat('<|im_start|>', replace(replace(replace(role, '%', '%25'), '<', '%3C'), chr(10), '%0A'), chr(10),
                   CASE WHEN regexp_matches(text, '<\|im_(start|end)\|>') OR regexp_matches(text, '<~+\|')
                        THEN regexp_replace(text, '<(~*)\|', '<~\1|', 'g') ELSE text END, '<|im_end|>', chr(10)) AS piece FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(piece)) AS BIGINT) AS formatted_chars
FROM pieces GROUP BY conv_id
"""

OP6 = f"""
WITH sized AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS z FROM sized GROUP BY source),
weighed AS (SELECT source, z, 3 * z AS cap, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS BIGINT) AS w
            FROM sums),
total AS (SELECT CAST(sum(z) AS BIGINT) AS t, CAST(sum(w) AS BIGINT) AS ws FROM weighed),
filled AS (SELECT *, w * (t - coalesce(sum(cap) OVER p, 0)) > cap * (ws - coalesce(sum(w) OVER p, 0)) AS full_ FROM weighed, total
           WINDOW p AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rest AS (SELECT t - coalesce(sum(cap) FILTER (WHERE full_), 0) AS num, ws - coalesce(sum(w) FILTER (WHERE full_), 0) AS den FROM filled GROUP BY t, ws),
targets AS (SELECT source, z, CASE WHEN full_ THEN CAST(cap AS DOUBLE) ELSE CAST(w * num AS DOUBLE) / CAST(den AS DOUBLE) END AS target FROM filled, rest),
rated AS (SELECT s.doc_id, s.size, z AS source_size, target, CASE WHEN z > 0 THEN target / z ELSE 0 END AS r,
                 CAST(CAST('0x' || substr(md5('1:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
          FROM sized s JOIN targets x ON s.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(r) + CASE WHEN u < r - floor(r) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated
"""


def _rule_sql(k: int, rule) -> str:
    kind, pattern, group, least = rule
    p = "'" + pattern.replace("'", "''") + "'"
    before = "CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT)"
    return f"""SELECT doc_id, {k} AS k, '{kind}' AS kind, {before} AS s, {before} + length(found[i]) AS e FROM (
        SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (
          SELECT doc_id, string_split_regex(text, {p}) AS gaps, regexp_extract_all(text, {p}, 0) AS found,
                 regexp_extract_all(text, {p}, {group}) AS counted FROM docs WHERE regexp_matches(text, {p}))) WHERE length(counted[i]) >= {least}"""


_BASE = ", ".join(f"'{k}'" for k in BASE)
OP10 = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({' UNION ALL '.join(_rule_sql(k, r) for k, r in enumerate(RULES))}),
each AS (SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)},
                coalesce(string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, k) FILTER (WHERE kind IN ({_BASE})), '') AS base,
                string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, k) AS spans FROM spans GROUP BY doc_id)
SELECT docs.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans FROM docs LEFT JOIN each ON each.doc_id = docs.doc_id
"""

#: crc32 byte by byte, its table from the rule of the polynomial; runs hold ASCII and U+00C0-U+00FF (bytes 0xC3, code - 64) alone.
OP12 = """
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], list_transform(range(8), lambda k: 0::BIGINT)),
         lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
         FROM documents WHERE text IS NOT NULL),
each AS (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY 1, 2),
hashed AS (SELECT run, c, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(concat(doc_id, ':', run), ''),
             lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195::BIGINT, ord(x)::BIGINT - 64] END))),
             lambda s, b: xor(s // 256, t[(xor(s, b) & 255) + 1])), 4294967295) AS h FROM each, tab),
spelled AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM hashed),
w AS (SELECT word, sum(c)::BIGINT AS n FROM spelled WHERE length(word) >= 5 GROUP BY 1 HAVING sum(c) >= 3),
d AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM w)),
one AS (SELECT d.word AS long, w.word AS short FROM d JOIN w ON w.word = d.s),
near AS (SELECT a.word, b.word AS other FROM d a JOIN d b ON a.i = b.i AND a.s = b.s AND a.word <> b.word
         UNION SELECT long, short FROM one UNION SELECT short, long FROM one),
best AS (SELECT near.word, other, o.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
                row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) AS k FROM near JOIN w o ON o.word = other),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form,
             CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n FROM w LEFT JOIN (SELECT * FROM best WHERE k = 1) b ON b.word = w.word),
chain AS (SELECT word, word AS at FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM f JOIN chain c ON c.word = f.word JOIN f e ON e.word = c.at AND e.form IS NULL"""
