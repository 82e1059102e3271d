"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from ballgraph.llm import divergence as dv
from ballgraph.llm.site_lines import MIN_PAGES, RATIO

SITE_LINES = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
lines AS (SELECT DISTINCT r, source, line FROM (SELECT r, source, unnest(lines) AS line FROM docs)
          WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
page_lines AS (SELECT DISTINCT l.source, text, line FROM lines l JOIN docs USING (r)),
totals AS (SELECT source, count(*) AS total FROM (SELECT DISTINCT source, text FROM documents) GROUP BY source),
bad AS (SELECT l.source, line FROM page_lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
        GROUP BY l.source, line, total HAVING count(*) >= {MIN_PAGES} AND count(*) > {RATIO} * total),
lists AS (SELECT source, list(line) AS bad FROM bad GROUP BY source),
kept AS (SELECT d.*, CASE WHEN l.bad IS NULL THEN d.lines
                     ELSE list_filter(d.lines, lambda x: NOT list_contains(l.bad, x)) END AS kept
         FROM docs d LEFT JOIN lists l ON d.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, source, array_to_string(kept, chr(10)) AS text, coalesce(len(lines), 0)::BIGINT AS n_lines,
       coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped
FROM kept
"""


def _sql_list(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def _jsd(own: str, ref: str, bins: int) -> str:
    x, y = f"({own}[i]::DOUBLE / list_sum({own}))", f"({ref}[i]::DOUBLE / list_sum({ref}))"
    return (
        f"CASE WHEN list_sum({own}) = 0 OR list_sum({ref}) = 0 THEN 0.0 ELSE round(list_sum(list_transform("
        f"range(1, {bins + 1}), lambda i: (CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0.0 END)"
        f" + (CASE WHEN {y} > 0 THEN {y} * log2(2 * {y} / ({x} + {y})) ELSE 0.0 END))) / 2, 6) END"
    )


_BINS = len(dv.COMMON_WORDS)
_CLASS_COUNTS = ", ".join(
    f"length(regexp_replace(t, '{c.replace(chr(39), chr(39) * 2)}', '', 'g'))" for c in dv.CLASSES
)

QUALITY = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
                 [{_CLASS_COUNTS}] AS classes
          FROM texts),
base AS (SELECT *, len(w) AS n, length(array_to_string(w, '')) AS chars FROM split),
hist AS (SELECT *, list_concat([len(list_filter(w, lambda x: NOT list_contains({_sql_list(dv.COMMON_WORDS)}, x)))],
                list_transform({_sql_list(dv.COMMON_WORDS)}, lambda c: len(list_filter(w, lambda x: x = c)))) AS hw,
                list_concat(classes, [length(t) - chars, chars - list_sum(classes)]) AS hc
         FROM base),
refs AS (SELECT lang AS ref_lang,
                [{', '.join(f'sum(hw[{i}])' for i in range(1, _BINS + 2))}] AS rw,
                [{', '.join(f'sum(hc[{i}])' for i in range(1, len(dv.CLASSES) + 3))}] AS rc
         FROM hist GROUP BY lang),
wins AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
         FROM (SELECT r, w, unnest(range(1, n - 1)) AS i FROM base WHERE n >= 3)),
found AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, a, b, c) AS m FROM wins) WHERE m > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat FROM found, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
rules AS (SELECT doc_id, n AS n_words, chars AS word_chars, hc[3] AS n_symbols,
                 len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
                 {_jsd('hc', 'rc', len(dv.CLASSES) + 2)} AS char_divergence,
                 {_jsd('hw', 'rw', _BINS + 1)} AS word_divergence, length(t) AS all_chars
          FROM hist JOIN refs ON lang IS NOT DISTINCT FROM ref_lang LEFT JOIN covered USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM rules)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, char_divergence, word_divergence,
       base_failed,
       NOT base_failed AND NOT (all_chars >= {dv.MIN_CHARS} AND char_divergence > {dv.MAX_CHAR_DIVERGENCE})
       AND NOT (n_words > 0 AND word_divergence
                > greatest({dv.MAX_WORD_DIVERGENCE}, {dv.WORD_NOISE}::DOUBLE / greatest(n_words, 1))) AS kept
FROM judged
"""


def url_filter(rules: list[tuple[str, str]], labels: tuple[str, ...]) -> str:
    values = ", ".join(f"('{v}', '{r}', '{r[:r.index('/')]}', '{r[r.index('/'):]}')" for v, r in rules)
    names = ", ".join(f"'{x}'" for x in labels)
    return f"""
WITH rules(says, rule, h, p) AS (VALUES {values}),
rest AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
                THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says FROM parts, rules
         WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r),
hits AS (SELECT *, EXISTS (SELECT 1 FROM unnest(string_split(host, '.')) AS l(x) WHERE x IN ({names})) AS listed
         FROM parts)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM hits LEFT JOIN fits USING (r)
"""

def _escaped(text: str) -> str:
    """Length of an escaped text: a character more for each control string, and for each place where ### begins."""
    return (
        f"(length({text}) + len(regexp_extract_all({text}, '\\\\|</turn>|<\\|'))"
        f" + coalesce(list_sum(list_transform(regexp_extract_all({text}, '###+'), lambda x: length(x) - 2)), 0))"
    )


CHAT = f"""
WITH every AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
               UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
rows_ AS (SELECT *, {_escaped('text')} AS chars, CASE WHEN role = 'assistant' THEN text ELSE '' END AS trained,
                 CASE role WHEN 'assistant' THEN 15 WHEN 'system' THEN 12 WHEN 'user' THEN 10
                      ELSE 11 + {_escaped('role')} END + 8 AS marks
          FROM every)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(length(trained))::BIGINT AS loss_chars,
       sha256(string_agg(trained, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       sum(chars + marks)::BIGINT AS formatted_chars
FROM rows_ GROUP BY conv_id
"""


def _crc32(blob: str) -> str:
    """Unsigned CRC-32 of a blob byte by byte; the table is that of the reflected polynomial EDB88320."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    values = f"list_transform(regexp_extract_all(hex({blob}), '..'), lambda x: ('0x' || x)::BIGINT)"
    step = f"xor(c >> 8, ({table}::BIGINT[])[(xor(c, x) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, {values}), lambda c, x: {step}), 4294967295)"


def _cell(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({name}::VARCHAR) || ':' || {name}::VARCHAR END"


def _digest(n_chars: str) -> str:
    cells = [_cell(c) for c in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(cells)})"


MANIFEST = f"""
WITH RECURSIVE leaves AS (
    SELECT row_number() OVER () AS r, doc_id, lang, {_digest('n_chars')} AS leaf,
           CASE WHEN {_crc32('encode(doc_id::VARCHAR)')} % 7 = 0 THEN {_digest('(n_chars + 1)')} END AS forged
    FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
                  count(*) OVER (PARTITION BY lang) AS total FROM leaves),
tree AS (SELECT 0 AS lvl, lang, i, leaf AS h, total FROM placed
         UNION ALL
         SELECT lvl + 1, lang, i // 2, sha256(string_agg(h, '' ORDER BY i)), (total + 1) // 2 FROM tree WHERE total > 1
         GROUP BY lvl, lang, i // 2, total),
subroots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS total
             FROM tree WHERE total = 1),
upper AS (SELECT 0 AS lvl, i, subroot AS h, total FROM subroots
          UNION ALL
          SELECT lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (total + 1) // 2 FROM upper WHERE total > 1
          GROUP BY lvl, i // 2, total),
steps AS (
    SELECT p.r, l.lvl, (p.i >> l.lvl) & 1 AS odd, s.h
    FROM placed p JOIN (SELECT DISTINCT lang, lvl FROM tree WHERE total > 1) l ON p.lang IS NOT DISTINCT FROM l.lang
    LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM p.lang AND s.lvl = l.lvl AND s.i = xor(p.i >> l.lvl, 1)
    UNION ALL
    SELECT p.r, 1000 + l.lvl, (g.i >> l.lvl) & 1, s.h
    FROM placed p JOIN subroots g ON p.lang IS NOT DISTINCT FROM g.lang
    JOIN (SELECT DISTINCT lvl FROM upper WHERE total > 1) l ON true
    LEFT JOIN upper s ON s.lvl = l.lvl AND s.i = xor(g.i >> l.lvl, 1)),
proofs AS (SELECT r, sha256(coalesce(string_agg(h, '' ORDER BY lvl), '')) AS proof_sha256,
                  list({{'odd': odd, 'h': h}} ORDER BY lvl) AS steps FROM steps GROUP BY r),
folded AS (
    SELECT p.*, coalesce(proof_sha256, sha256('')) AS proof_sha256,
           list_reduce(list_prepend({{'odd': 0::BIGINT, 'h': coalesce(forged, leaf)}}, coalesce(steps, [])),
               lambda a, s: {{'odd': 0::BIGINT, 'h': sha256(CASE WHEN s.h IS NULL THEN a.h WHEN s.odd = 1 THEN s.h || a.h
                                                     ELSE a.h || s.h END)}}).h AS folded_root
    FROM placed p LEFT JOIN proofs USING (r))
SELECT doc_id, f.lang, f.i::BIGINT AS coord, leaf, subroot, h AS root, proof_sha256, folded_root, folded_root = h AS verified
FROM folded f JOIN subroots g ON f.lang IS NOT DISTINCT FROM g.lang JOIN (SELECT h FROM upper WHERE total = 1) ON true
"""


def _draw(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT"


def shards(n: int, virtual_nodes: int, waves: int, parts: int) -> str:
    """Rows one by one in the order of their arrival, each to the first shard on its way that has room."""
    arcs, row = n * virtual_nodes, "doc_id, size, text_crc32"
    return f"""
WITH RECURSIVE ring AS (
    SELECT s.s, pos, row_number() OVER (ORDER BY pos, s.s) - 1 AS arc
    FROM (SELECT s, {_draw("'ring'", 's', 'v')} AS pos FROM range({n}) a(s), range({virtual_nodes}) b(v)) s),
rows_ AS (SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, {_crc32("encode(coalesce(text, ''))")} AS text_crc32 FROM documents),
hashed AS (SELECT *, {_draw("'key'", 'doc_id')} AS pos, {_draw("'wave'", row)} % {waves} AS wave,
                  {_draw("'part'", row)} % {parts} AS part FROM rows_),
arced AS (SELECT h.*, (SELECT count(*) FROM ring WHERE ring.pos < h.pos) % {arcs} AS arc FROM hashed h),
ordered AS (SELECT *, row_number() OVER (ORDER BY wave, arc, part, pos, {row}) AS nth, count(*) OVER () AS total FROM arced),
near AS (SELECT o.arc, s, min((ring.arc - o.arc + {arcs}) % {arcs}) AS far
         FROM (SELECT DISTINCT arc FROM ordered) o, ring GROUP BY o.arc, s),
walks AS (SELECT arc, list(s ORDER BY far) AS walk FROM near GROUP BY arc),
arrivals AS (SELECT nth, walk, list_transform(range(0, {n}), lambda s: total // {n} + (CASE WHEN s < total % {n} THEN 1 ELSE 0 END)) AS room
             FROM ordered JOIN walks USING (arc)),
filled AS (
    SELECT 0::BIGINT AS nth, list_transform(range(0, {n}), lambda s: 0::BIGINT) AS held, NULL::BIGINT AS shard
    UNION ALL
    SELECT nth, list_transform(held, lambda x, i: CASE WHEN i - 1 = shard THEN x + 1 ELSE x END), shard
    FROM (SELECT a.nth, held, list_filter(walk, lambda s: held[s + 1] < room[s + 1])[1] AS shard
          FROM filled f JOIN arrivals a ON a.nth = f.nth + 1))
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INTEGER AS shard,
       held[shard + 1] - 1 AS slot, NULL::INTEGER AS grown_shard
FROM ordered JOIN filled USING (nth)
"""
