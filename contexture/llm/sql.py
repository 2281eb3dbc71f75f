"""The same rows as the named queries give, as SQL over the given tables."""

from __future__ import annotations


def _level(name: str, above: str, by: list[str], key: str, weights: dict[str, int]) -> str:
    keys = ", ".join([*by, key])
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    rest = f"PARTITION BY {', '.join([*by, 'short'])}"
    order = f"ORDER BY supply / weight, {key}"
    case = " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items())
    weight = f"CASE {key} {case} ELSE 1 END" if case else "1"
    join = f"JOIN {above} USING ({', '.join(by)})" if by else f"CROSS JOIN {above}"
    return f"""
{name}_sum AS (
  SELECT {keys}, CAST(sum(supply) AS BIGINT) AS supply, CAST({weight} AS BIGINT) AS weight
  FROM leaves GROUP BY {keys}),
{name}_left AS (
  SELECT {keys}, supply, weight,
    parent_budget - coalesce(CAST(sum(supply) OVER ({part} {order}
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS open,
    CAST(sum(weight) OVER ({part} {order}
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weights
  FROM {name}_sum {join}),
{name}_short AS (
  SELECT *, supply * weights <= weight * open AS short FROM {name}_left),
{name}_rest AS (
  SELECT *, CAST(sum(weight) OVER ({rest} {order}
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto,
    max(open) OVER ({rest}) AS most, CAST(sum(weight) OVER ({rest}) AS BIGINT) AS whole
  FROM {name}_short),
{name} AS (
  SELECT {keys}, CASE WHEN short THEN supply
    ELSE most * upto // whole - most * (upto - weight) // whole END AS parent_budget
  FROM {name}_rest)"""


def mixing(weights: dict[str, dict[str, int]], share: float, epochs: int, seed: str) -> str:
    levels = [
        _level("by_domain", "top", [], "domain", weights.get("domain", {})),
        _level("by_language", "by_domain", ["domain"], "lang", weights.get("language", {})),
        _level("by_origin", "by_language", ["domain", "lang"], "source", weights.get("origin", {})),
    ]
    return f"""
WITH counted AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE WHEN substr(md5(coalesce(source, '')), 1, 1) < '6' THEN 'a'
      WHEN substr(md5(coalesce(source, '')), 1, 1) < 'b' THEN 'b' ELSE 'c' END AS domain,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS tokens
  FROM documents),
leaves AS (
  SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens,
    CAST(sum(tokens) * {epochs} AS BIGINT) AS supply
  FROM counted GROUP BY domain, lang, source),
top AS (
  SELECT least(CAST(floor(CAST(sum(tokens) AS DOUBLE) * {share}) AS BIGINT),
    CAST(sum(supply) AS BIGINT)) AS parent_budget FROM leaves),
{",".join(levels)},
planned AS (
  SELECT domain, lang, source, parent_budget AS budget,
    coalesce(parent_budget // nullif(tokens, 0), 0) AS full_epochs,
    parent_budget - coalesce(parent_budget // nullif(tokens, 0), 0) * tokens AS rest
  FROM leaves JOIN by_origin USING (domain, lang, source)),
ordered AS (
  SELECT *, CAST(sum(tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5('{seed}:' || (full_epochs + 1) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')
      || ':' || tokens)
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
  FROM counted JOIN planned USING (domain, lang, source)),
copies AS (
  SELECT *, full_epochs + CAST(full_epochs < {epochs} AND upto <= rest AS BIGINT) AS times
  FROM ordered)
SELECT doc_id, CAST(epoch AS INTEGER) AS epoch, domain, lang, source, tokens
FROM (SELECT *, unnest(range(1, times + 1)) AS epoch FROM copies)
"""


EXACT_TOP_K = """
WITH scaled AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM scaled q JOIN scaled c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

TOKEN_COUNTS = r"""
WITH counted AS (
  SELECT doc_id, source, lang,
    coalesce(len(regexp_extract_all(text,
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 0) AS words,
    coalesce(length(text), 0) AS chars,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents),
kept AS (SELECT * FROM counted WHERE doc_id = first)
SELECT source, lang, 'words' AS version, count(*) AS documents, CAST(sum(words) AS BIGINT) AS tokens
FROM kept GROUP BY source, lang
UNION ALL
SELECT source, lang, 'chars', count(*), CAST(sum(chars) AS BIGINT)
FROM kept GROUP BY source, lang
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWERED = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

BENCHMARK_DECONTAMINATION = f"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all({_LOWERED}, {_ALNUM}) AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all({_LOWERED}, {_ALNUM}) AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, w[k:k + 9] AS own, len(w[k:k + 9]) AS n
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM items WHERE len(w) > 0)),
places AS (
  SELECT doc_id, p, n, w[p:p + n - 1] AS own
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p
        FROM docs, (SELECT DISTINCT n FROM windows))),
hits AS (SELECT doc_id, p, n, item_id FROM places JOIN windows USING (own, n)),
covered AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

CHAT_FORMAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
    AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
    FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(text) + length(text) - length(translate(text, '\[<', ''))
    + CASE role WHEN 'assistant' THEN 4 WHEN 'user' THEN 15 WHEN 'system' THEN 15
      ELSE 11 + length(role) + length(role) - length(translate(role, '\[<|', '')) END) AS BIGINT)
    AS formatted_chars
FROM turns GROUP BY conv_id
"""

WARC = """
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
    sha1(coalesce(html, '')) AS hex FROM pages),
named AS (
  SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(1 + ((CAST('0x' || substr(hex, 1 + 5 * (k // 4), 5) AS BIGINT)
        >> (15 - 5 * (k % 4))) & 31) AS BIGINT), 1) for k in range(32)], '') AS payload_digest,
    min(page_id) OVER (PARTITION BY hex) AS first
  FROM payloads)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM named
"""

_HEX = "hex(encode(key))"
_CRC_TABLE = """crc_table AS (
  SELECT [list_reduce(range(8),
      lambda crc, bit: CASE WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END, k)
    for k in range(256)] AS crc)"""
_CRC32 = f"""xor(CAST(4294967295 AS BIGINT), list_reduce(
    [CAST('0x' || substr({_HEX}, 2 * k + 1, 2) AS BIGINT) for k in range(octet_length(encode(key)))],
    lambda was, byte: xor(was // 256, crc[xor(was, byte) % 256 + 1]), CAST(4294967295 AS BIGINT)))"""

SPELLING_VARIANTS = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '[a-zA-ZÀ-ÿ]+')) AS run FROM documents),
marked AS (
  SELECT run, {_CRC32} AS mark
  FROM (SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key FROM runs
        WHERE length(run) >= 7), crc_table),
damaged AS (
  SELECT CASE WHEN mark % 31 = 0
    THEN run[:mark % length(run)] || run[mark % length(run) + 2:] ELSE run END AS word
  FROM marked),
words AS (
  SELECT word, count(*) AS n FROM damaged
  WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
shorter AS (
  SELECT word, k, word[:k - 1] || word[k + 1:] AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM words)),
pairs AS (
  SELECT a.word AS word, b.word AS near FROM shorter a JOIN shorter b USING (k, rest)
  WHERE a.word <> b.word
  UNION SELECT s.word, w.word FROM shorter s JOIN words w ON s.rest = w.word
  UNION SELECT w.word, s.word FROM shorter s JOIN words w ON s.rest = w.word),
ranked AS (
  SELECT p.word, p.near, w.n AS m, count(*) OVER (PARTITION BY p.word) AS n_near,
    row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, encode(p.near)) AS place
  FROM pairs p JOIN words w ON p.near = w.word),
found AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near,
    CASE WHEN r.m >= 10 * w.n THEN r.near END AS form,
    CASE WHEN r.m >= 10 * w.n THEN r.m END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
ways AS (
  SELECT word, word AS root, form AS further FROM found
  UNION ALL
  SELECT y.word, y.further, f.form FROM ways y JOIN found f ON f.word = y.further)
SELECT f.word, f.form, y.root, f.n, f.n_near, f.form_n
FROM found f JOIN ways y ON y.word = f.word AND y.further IS NULL
"""

# Up to three insertions lead from any state to any other.
_INSERTED = """
    [[0, 2, 3, 2], [1, 2, 3, 2], [2, 3, 2, 3], [3, 2, 3, 2]][st + 1][k + 1] AS st,
    cost + 3 * k AS cost, audit || repeat('I', k) AS audit,
    body || CASE WHEN st = 2
      THEN ['', chr(10) || 'assistant:', chr(10) || 'assistant:' || chr(10) || 'user:',
        chr(10) || 'assistant:' || chr(10) || 'user:' || chr(10) || 'assistant:'][k + 1]
      ELSE ['', chr(10) || 'user:', chr(10) || 'user:' || chr(10) || 'assistant:',
        chr(10) || 'user:' || chr(10) || 'assistant:' || chr(10) || 'user:'][k + 1] END AS body"""

CONVERSATION_REPAIR = f"""
WITH RECURSIVE {_CRC_TABLE},
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') AS c,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations),
kinds AS (SELECT *, {_CRC32} % 20 AS kind FROM keyed, crc_table),
damaged AS (
  SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds)
  WHERE kind <> 0),
numbered AS (
  SELECT *, substr(role, 1, 1) AS initial,
    row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text)) AS pos,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last
  FROM damaged),
faults AS (
  SELECT *, CASE WHEN last = '' THEN 1
    WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY pos) > 1 THEN 2
    WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(initial) OVER (PARTITION BY c ORDER BY pos) || initial AS meeting
  FROM numbered),
dp(c, pos, st, cost, audit, body) AS (
  SELECT DISTINCT c, CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), '', '' FROM kinds
  UNION ALL
  SELECT c, pos, st, cost, audit, body FROM (
    SELECT f.c, f.pos,
      CASE letter WHEN 'D' THEN d.st WHEN 'K' THEN kept
        ELSE CASE d.st WHEN 2 THEN 3 ELSE 2 END END AS st,
      CAST(d.cost + CASE letter WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END
        + CASE WHEN letter <> 'D' AND fault = 3 THEN 3 ELSE 0 END AS BIGINT) AS cost,
      d.audit || letter AS audit,
      d.body || CASE letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text
        ELSE chr(10) || CASE d.st WHEN 2 THEN 'assistant:' ELSE 'user:' END || text END AS body
    FROM (SELECT c, pos, {_INSERTED} FROM (SELECT *, unnest(range(4)) AS k FROM dp)) d
    JOIN (SELECT *, unnest(['D', 'R', 'K']) AS letter FROM faults) f
      ON f.c = d.c AND f.pos = d.pos + 1,
    LATERAL (SELECT CASE WHEN d.st = 0 AND initial = 's' THEN 1
      WHEN d.st <> 2 AND initial = 'u' THEN 2 WHEN d.st = 2 AND initial = 'a' THEN 3 END AS kept)
    WHERE letter = 'D' OR (fault NOT IN (1, 2) AND (letter = 'R' OR kept IS NOT NULL)))
  QUALIFY row_number() OVER (PARTITION BY c, st ORDER BY cost, audit) = 1),
sizes AS (
  SELECT c, count(pos) AS turns,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (meeting NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT c FROM kinds) LEFT JOIN faults USING (c) GROUP BY c),
ended AS (
  SELECT c, cost, audit, body FROM (
    SELECT c, {_INSERTED} FROM (
      SELECT dp.*, unnest(range(4)) AS k FROM dp JOIN sizes ON dp.c = sizes.c AND pos = turns))
  WHERE st IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY c ORDER BY cost, audit) = 1)
SELECT k.conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
  sha256(substr(body, 2)) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM kinds) k JOIN sizes USING (c) JOIN ended USING (c)
"""

VECTOR_DEDUP = """
WITH RECURSIVE own AS (
  SELECT row_number() OVER () AS r, vec_id, [CAST(x AS DOUBLE) for x in embedding] AS v
  FROM embeddings),
sound AS (
  SELECT r, vec_id, v, len(v) AS dim, sqrt(list_inner_product(v, v)) AS size
  FROM own
  WHERE vec_id IS NOT NULL AND len([x for x in v if x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x for x in v if x <> 0]) > 0),
links AS (
  SELECT a.r AS a, b.r AS b FROM sound a JOIN sound b ON a.dim = b.dim AND a.r <> b.r
  WHERE list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.95),
reached AS (
  SELECT r, r AS other FROM own
  UNION SELECT reached.r, links.b FROM reached JOIN links ON links.a = reached.other),
least AS (
  SELECT reached.r, min(own.vec_id) AS component_id
  FROM reached JOIN own ON own.r = reached.other GROUP BY reached.r),
counted AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id,
  coalesce(vec_id = component_id, false) AS kept
FROM own JOIN least USING (r) LEFT JOIN counted USING (r)
"""

NGRAM_JACCARD_JOIN = f"""
WITH RECURSIVE worded AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all({_LOWERED}, '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS s
  FROM worded),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
shared AS (
  SELECT a.r AS a, b.r AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b
  WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
reached AS (
  SELECT r, r AS other FROM worded
  UNION SELECT reached.r, links.b FROM reached JOIN links ON links.a = reached.other),
least AS (
  SELECT reached.r, min(doc_id) AS component_id
  FROM reached JOIN worded ON worded.r = reached.other GROUP BY reached.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM worded JOIN least USING (r) LEFT JOIN sizes USING (r)
"""
