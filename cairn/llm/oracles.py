"""DuckDB SQL for the corpus operators that SQL can express."""

#: Classes and links by counting common shingles of all pairs that share one.
NGRAM_JOIN = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_sort(list_distinct([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)])) END AS shingles FROM w),
k AS (SELECT doc_id, shingles, CASE WHEN len(shingles) > 0 THEN md5(array_to_string(shingles, chr(10))) END AS node FROM s),
n AS (SELECT node, min(doc_id) AS low, count(*) AS n_copies, any_value(shingles) AS shingles, any_value(len(shingles)) AS size FROM k WHERE node IS NOT NULL GROUP BY node),
e AS (SELECT node, size, unnest(shingles) AS shingle FROM n),
p AS (SELECT a.node AS x, b.node AS y FROM e AS a JOIN e AS b ON a.shingle = b.shingle AND a.node <> b.node
  GROUP BY a.node, b.node, a.size, b.size HAVING 9 * count(*) >= 4 * (a.size + b.size)),
r AS (SELECT node, node AS other FROM n UNION SELECT r.node, p.y FROM r JOIN p ON r.other = p.x),
c AS (SELECT r.node, min(n.low) AS class_id FROM r JOIN n ON r.other = n.node GROUP BY r.node),
l AS (SELECT x AS node, count(*) AS n_links FROM p GROUP BY x)
SELECT k.doc_id, CASE WHEN k.node IS NULL THEN k.doc_id ELSE c.class_id END AS class_id, CAST(coalesce(l.n_links, 0) AS BIGINT) AS n_links,
  CAST(coalesce(n.n_copies, 1) AS BIGINT) AS n_copies, CAST(len(k.shingles) AS BIGINT) AS n_shingles
FROM k LEFT JOIN n USING (node) LEFT JOIN c USING (node) LEFT JOIN l USING (node)"""

#: Every 400-byte window of every text, by its position in the text's hex form.
SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, greatest(0, len(h) // 2 - 399))) AS i FROM d),
k AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS m FROM p),
t AS (SELECT m FROM k GROUP BY m HAVING count(*) > 1),
s AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM k JOIN t USING (m)),
g AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
r AS (SELECT doc_id, min(i) AS lo, max(i) + 400 AS hi FROM g GROUP BY doc_id, run),
a AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id),
f AS (SELECT doc_id, hi AS start, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS stop FROM r
  UNION ALL SELECT doc_id, 0, min(lo) FROM r GROUP BY doc_id),
q AS (SELECT doc_id, string_agg(substr(h, CAST(2 * start + 1 AS BIGINT), CAST(2 * (coalesce(stop, len(h) // 2) - start) AS BIGINT)), '' ORDER BY start) AS kept FROM f JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(a.n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(a.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(q.kept, d.h))) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id) LEFT JOIN q USING (doc_id)"""

#: Lines by place, keys by count and largest document.
LINE_DEDUP = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
g AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, g.key IS NOT NULL AND doc_id <> holder AS goes FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT goes), '')) AS kept_sha256
FROM m GROUP BY doc_id"""


def _crc32(text: str) -> str:
    """SQL of the unsigned crc32 of an ASCII string, by a table of 256 values (``crc_t``, column ``t``)."""
    return (f"xor(list_reduce([4294967295::BIGINT] || [CAST(ascii(ch) AS BIGINT) FOR ch IN string_split({text}, '')], "
            "lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295)")


_CRC_TABLE = """crc_t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i)))"""


def _merkle() -> str:
    """Levels written out: six per source (16 million documents), four over the sources."""
    field = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [_CRC_TABLE, f"""d AS (SELECT doc_id, source, sha256({head} || {field('text')}) AS leaf,
  CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN sha256({head} || {field(low)}) END AS changed FROM documents, crc_t)""",
             "a0 AS (SELECT source AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h FROM d)",
             "dd AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)"]

    def tree(x: str, levels: int) -> None:
        for k in range(levels):
            run = "PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN"
            parts.append(f"""{x}s{k} AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS n,
  coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {x}{k})""")
            parts.append(f"{x}{k + 1} AS (SELECT g, i // 16 AS i, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {x}s{k} GROUP BY g, i // 16)")

    tree("a", 6)
    parts.append("src AS (SELECT g AS source, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS k FROM a6)")
    parts.append("b0 AS (SELECT 0 AS g, k AS i, subroot AS h FROM src)")
    tree("b", 4)
    parts.append("f0 AS (SELECT dd.doc_id, dd.source, dd.i, dd.leaf, s.k, s.subroot, coalesce(dd.changed, dd.leaf) AS f, '' AS p FROM dd JOIN src AS s ON dd.source IS NOT DISTINCT FROM s.source)")
    steps = [("a", k, f"f.source IS NOT DISTINCT FROM s.g AND f.i // {16**k} = s.i") for k in range(6)] + [("b", k, f"f.k // {16**k} = s.i") for k in range(4)]
    for j, (x, k, on) in enumerate(steps):
        parts.append(f"""f{j + 1} AS (SELECT f.doc_id, f.source, f.i, f.leaf, f.k, f.subroot, CASE WHEN s.n = 1 THEN f.f ELSE sha256(s.l || f.f || s.r) END AS f,
  f.p || s.l || s.r AS p FROM f{j} AS f JOIN {x}s{k} AS s ON {on})""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, b4.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = b4.h AS verified FROM f{len(steps)}, b4"""


#: Every level as a table of nodes with what stands left and right of each.
MERKLE = _merkle()


def _conversations() -> str:
    """A recursive table over the rows: per state the least ``cost (ten digits) || audit``."""
    add = lambda x, c, letter: f"lpad(CAST(CAST(left({x}, 10) AS INT) + {c} AS VARCHAR), 10, '0') || substr({x}, 11) || '{letter}'"
    insert = lambda x: add(x, 5, "I")
    stays, before = "fault IS NULL OR fault = 'truncated'", "least(s0, s1, s3)"
    extra = "(CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END)"
    return "WITH RECURSIVE " + _CRC_TABLE + f""",
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS hit FROM conversations, crc_t),
dmg AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
  CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
  FROM src, (VALUES (0), (1)) AS c(copy) WHERE hit <> 0 AND (copy = 0 OR hit = 3)),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM dmg),
flt AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS previous,
  CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' END AS fault FROM num),
stat AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM flt GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations),
st AS (SELECT conv_id, 0 AS i, '0000000000' AS s0, CAST(NULL AS VARCHAR) AS s1, '0000000005I' AS s2, '0000000010II' AS s3 FROM ids
  UNION ALL
  SELECT conv_id, i, s0, s1, least(u, {insert('a')}), a FROM (
    SELECT conv_id, i, s0, s1, u, least(s3, {insert('u')}) AS a FROM (
      SELECT conv_id, i, s0, s1, s3, least(s2, {insert(before)}) AS u FROM (
        SELECT st.conv_id, flt.i AS i, {add('s0', 2, 'D')} AS s0,
          least({add('s1', 2, 'D')}, CASE WHEN ({stays}) AND initial = 's' THEN {add('s0', extra, 'K')} END) AS s1,
          least({add('s2', 2, 'D')}, CASE WHEN {stays} THEN {add(before, '1 + ' + extra, 'R')} END,
            CASE WHEN ({stays}) AND initial = 'u' THEN {add(before, extra, 'K')} END) AS s2,
          least({add('s3', 2, 'D')}, CASE WHEN {stays} THEN {add('s2', '1 + ' + extra, 'R')} END,
            CASE WHEN ({stays}) AND initial = 'a' THEN {add('s2', extra, 'K')} END) AS s3
        FROM st JOIN flt ON st.conv_id IS NOT DISTINCT FROM flt.conv_id AND flt.i = st.i + 1)))),
best AS (SELECT ids.conv_id, least(st.s0, st.s3) AS b FROM ids LEFT JOIN stat ON ids.conv_id IS NOT DISTINCT FROM stat.conv_id
  JOIN st ON ids.conv_id IS NOT DISTINCT FROM st.conv_id AND st.i = coalesce(stat.n, 0)),
aud AS (SELECT conv_id, CASE WHEN b = '0000000000' THEN '' ELSE substr(b, 11) END AS audit, CAST(left(b, 10) AS BIGINT) AS cost FROM best),
let AS (SELECT conv_id, unnest(string_split(audit, '')) AS letter, unnest(range(len(audit))) AS p FROM aud WHERE audit <> ''),
pos AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i FROM let),
lin AS (SELECT pos.conv_id, p, letter, row_number() OVER (PARTITION BY pos.conv_id ORDER BY p) AS j, flt.role, CASE WHEN letter = 'I' THEN '' ELSE flt.text END AS text
  FROM pos LEFT JOIN flt ON pos.conv_id IS NOT DISTINCT FROM flt.conv_id AND pos.i = flt.i WHERE letter <> 'D'),
sys AS (SELECT *, max(CASE WHEN j = 1 AND letter = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS shift FROM lin),
fin AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (j - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j)) AS h FROM sys GROUP BY conv_id)
SELECT aud.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, cost, audit, coalesce(fin.h, sha256('')) AS repaired_sha256
FROM aud LEFT JOIN stat ON aud.conv_id IS NOT DISTINCT FROM stat.conv_id LEFT JOIN fin ON aud.conv_id IS NOT DISTINCT FROM fin.conv_id"""


#: The edit lattice row by row; rows of equal turn do not occur in the tables (copies made by the damage aside).
CONVERSATIONS = _conversations()
