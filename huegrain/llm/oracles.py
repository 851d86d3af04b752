"""DuckDB SQL for the contract queries that SQL can express."""

_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op1_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, pos, parts[pos] AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) t, unnest(range(1, len(parts) + 1)) AS u(pos)
), keyed AS (SELECT doc_id, pos, line, {_KEY} AS k FROM lines),
seen AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT x.doc_id, x.pos, x.line, (s.k IS NOT NULL AND s.keeper <> x.doc_id) AS gone
  FROM keyed x LEFT JOIN seen s ON s.k = x.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op6_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents
), r AS (
  SELECT doc_id, bare, count(*) OVER (PARTITION BY bare) AS group_size,
         first_value(doc_id) OVER (PARTITION BY bare ORDER BY n_chars DESC, doc_id) AS keep_id FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM r
""",
    "op8_chat_format": """
WITH t AS (
  SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS said,
         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
  FROM conversations GROUP BY conv_id
), u AS (SELECT said, min(conv_id) AS conv_id, min(rendered) AS rendered, count(*) AS n_copies, said[1] AS opening FROM t GROUP BY said)
SELECT a.conv_id, CAST(len(a.said) AS BIGINT) AS n_turns, a.n_copies, a.rendered
FROM u a
WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.opening = a.opening AND len(b.said) > len(a.said) AND b.said[1:len(a.said)] = a.said)
""",
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _phrases() -> str:
    """op11: all phrases of up to four words, counted; parts and longer phrases found by text."""
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))) AS phrase FROM split WHERE len(w) >= {k}" for k in (1, 2, 3, 4))
    cuts = " UNION ALL ".join(f"SELECT lang, phrase, a, {c} AS cut, array_to_string(w[1:{c}], ' ') AS lp, array_to_string(w[{c + 1}:], ' ') AS rp FROM kept WHERE len(w) > {c}" for c in (1, 2, 3))
    inner = " UNION ALL ".join(f"SELECT lang, f, array_to_string(w[{i}:{i + n - 1}], ' ') AS phrase FROM many WHERE len(w) > {n} AND len(w) >= {i + n - 1}" for n in (2, 3) for i in (1, 2, 3))
    return rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM documents),
split AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
grams AS ({grams}),
often AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
many AS (SELECT lang, phrase, f, string_split(phrase, ' ') AS w FROM often WHERE k > 1),
around AS (SELECT lang, phrase, max(f) AS longer FROM ({inner}) GROUP BY ALL),
kept AS (SELECT m.lang, m.phrase, m.f AS a, m.w FROM many m LEFT JOIN around x USING (lang, phrase) WHERE x.longer IS NULL OR 100 * x.longer < 80 * m.f),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (l.f + r.f) AS BIGINT) AS score
  FROM ({cuts}) c JOIN often l ON l.lang = c.lang AND l.phrase = c.lp JOIN often r ON r.lang = c.lang AND r.phrase = c.rp
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def _seeded(text: str) -> str:
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


#: op12: targets in closed form, sources in the order in which they reach their limit.
_MIXING = rf"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sums),
placed AS (SELECT *, row_number() OVER (ORDER BY source_size * (10 // weight), source NULLS LAST) AS k FROM weighed),
closing AS (
  SELECT *, 3 * (SELECT sum(source_size) FROM sums) - coalesce(sum(4 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
         sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM placed
), level AS (SELECT k, left_over, open_weight FROM closing WHERE left_over * weight <= 4 * source_size * open_weight ORDER BY k LIMIT 1),
targets AS (
  SELECT s.source, s.source_size, s.n_docs, CASE WHEN s.k < v.k THEN 2.0::DOUBLE * s.source_size ELSE CAST(v.left_over * s.weight AS DOUBLE) / CAST(2 * v.open_weight AS DOUBLE) END AS target
  FROM closing s, level v
), rated AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         CAST(ceil(t.n_docs / 1024.0) AS BIGINT) AS blocks, {_seeded("coalesce(CAST(d.doc_id AS VARCHAR), ' ')")} AS draw
  FROM sized d JOIN targets t ON t.source IS NOT DISTINCT FROM d.source
), blocked AS (SELECT *, CAST(floor(draw * blocks) AS BIGINT) AS block, rate - floor(rate) AS fraction FROM rated),
stepped AS (
  SELECT *, row_number() OVER (PARTITION BY source, block ORDER BY size DESC, draw, doc_id) AS place, {_seeded("coalesce(source, ' ') || ':' || CAST(block AS VARCHAR)")} AS seed FROM blocked
), drawn AS (SELECT *, CAST(floor(rate) + floor(seed + place * fraction) - floor(seed + (place - 1) * fraction) AS BIGINT) AS copies FROM stepped)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM drawn
"""


def _repair() -> str:
    """op13: crc32 from its table, and a recursion over turns from the last one back that carries the best (cost, audit) of each state."""
    crc = "SELECT i, i AS c FROM range(256) AS x(i)"
    for _ in range(8):
        crc = f"SELECT i, xor(c >> 1, (c & 1) * 3988292384) AS c FROM ({crc})"
    following = {"n": ("u", {"s": "s", "u": "u"}), "s": ("u", {"u": "u"}), "u": ("a", {"a": "a"}), "a": ("u", {"u": "u"})}

    def best(state: str) -> str:
        options, at = [], state
        for n in range(3):
            step = lambda cost, initial, to: f"{{'c': {5 * n} + {cost} + b.{to}.c, 'a': '{'I' * n}{initial}' || b.{to}.a}}"  # noqa: B023, E731
            options.append(step("2", "D", at))
            to, kept = following[at]
            options.append(f"CASE WHEN NOT o.gone THEN {step('1 + o.extra', 'R', to)} END")
            options += [f"CASE WHEN NOT o.gone AND o.ini = '{role}' THEN {step('o.extra', 'K', after)} END" for role, after in kept.items()]
            at = to
        return f"list_min(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL)) AS {state}"

    return rf"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM ({crc})),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
dealt AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS fault
  FROM keyed, crc
), harmed AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM dealt WHERE fault <> 0
), placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS pos, left(role, 1) AS ini FROM harmed),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 AS again, lag(ini) OVER (PARTITION BY conv ORDER BY pos) AS before,
         count(*) OVER (PARTITION BY conv) AS n, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS bare FROM placed
), o AS (
  SELECT conv, pos, n, turn, role, text, ini, before, bare = '' OR again AS gone, bare = '' AS blank, bare <> '' AND again AS duplicate,
         bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut, CASE WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS extra FROM seen
), b AS (
  SELECT conv, n + 1 AS pos, {{'c': 0, 'a': ''}} AS n, {{'c': 10, 'a': 'II'}} AS s, {{'c': 5, 'a': 'I'}} AS u, {{'c': 0, 'a': ''}} AS a FROM o WHERE pos = 1
  UNION ALL
  SELECT b.conv, o.pos, {best("n")}, {best("s")}, {best("u")}, {best("a")} FROM b JOIN o ON o.conv = b.conv AND o.pos = b.pos - 1
), solved AS (SELECT conv, n.c AS cost, n.a AS audit FROM b WHERE pos = 1),
steps AS (SELECT conv, unnest(string_split(audit, '')) AS e, generate_subscripts(string_split(audit, ''), 1) AS i FROM solved WHERE audit <> ''),
counted AS (SELECT *, count(*) FILTER (e <> 'I') OVER w AS pos, count(*) FILTER (e <> 'D') OVER w AS nth FROM steps WINDOW w AS (PARTITION BY conv ORDER BY i)),
told AS (SELECT c.*, o.role, o.text, o.ini FROM counted c LEFT JOIN o ON o.conv = c.conv AND o.pos = c.pos AND c.e <> 'I' WHERE c.e <> 'D'),
based AS (SELECT *, nth - max(CASE WHEN nth = 1 AND e = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv) AS place FROM told),
repaired AS (SELECT conv, string_agg(CASE WHEN e = 'K' THEN role || ':' || text ELSE (CASE WHEN place % 2 = 1 THEN 'user:' ELSE 'assistant:' END) || coalesce(text, '') END, chr(10) ORDER BY i) AS whole FROM based GROUP BY conv),
counts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1, 0) - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (cut) AS truncated,
         count(*) FILTER (pos > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM o GROUP BY conv
)
SELECT x.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
       CAST(coalesce(s.cost, 0) AS BIGINT) AS cost, coalesce(s.audit, '') AS audit, sha256(coalesce(r.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) x
LEFT JOIN counts c ON c.conv = coalesce(CAST(x.conv_id AS VARCHAR), ' ') LEFT JOIN solved s ON s.conv = coalesce(CAST(x.conv_id AS VARCHAR), ' ') LEFT JOIN repaired r ON r.conv = coalesce(CAST(x.conv_id AS VARCHAR), ' ')
"""


SQL |= {"op11_phrase_collocations": _phrases(), "op12_source_mixing": _MIXING, "op13_chat_repair": _repair()}
