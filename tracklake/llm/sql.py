"""DuckDB SQL of the queries that SQL can express, made from the same tables of rules."""

from __future__ import annotations

from tracklake.llm import chat_format as cf
from tracklake.llm import decontaminate as dc
from tracklake.llm import fill_in_middle as fm
from tracklake.llm import license_scan as ls
from tracklake.llm import quality_rules as qr
from tracklake.llm import sharding as sh


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def quality_rules() -> str:
    tests = []
    for r in qr.RULES:
        ratio = f"{r.measure} / greatest({r.per}, 1)"
        tests += [f"{ratio} < {r.least}"] * (r.least is not None) + [f"{ratio} > {r.most}"] * (r.most is not None)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
 w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
 g AS (SELECT doc_id, i, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p || ' ' || lead(w, 3) OVER p || ' ' || lead(w, 4) OVER p AS g FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
 r AS (SELECT doc_id, i FROM g WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
 c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, range(5) AS s(k) GROUP BY 1),
 l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
 m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '{qr.SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  len(list_filter(ws, lambda x: lower(x) IN ({_quoted(sorted(set(qr.STOP_WORDS)))}))) AS n_stop_words, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
 b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {" OR ".join(tests)}) AS kept FROM b"""


def license_scan() -> str:
    known = ", ".join(f"('{v}', '{k}')" for v, k in ls.KNOWN.items())
    names = ", ".join(f"('{v}', '{k}')" for v, k in ls.KNOWN_NAMES.items())
    # Points of short forms are set aside before the text is cut.
    short = "|".join(x.replace(".", "[.]") for x in ls.SHORT)
    text = f"regexp_replace(coalesce(text, ''), '(^|[^\\p{{L}}\\p{{N}}])({short})[.](\\s)', '\\1\\2' || chr(1) || '\\3', 'gi')"
    held = f"regexp_extract(plain, '{ls.NOTICE}', 1) || regexp_extract(plain, '{ls.NOTICE}', 2)"
    back = "x"
    for k, later in enumerate(ls._LATER):
        held, back = f"replace({held}, '{later}', chr({1 + k}))", f"replace({back}, chr({1 + k}), '{later}')"
    tail = f"regexp_replace(held, '{ls.TAIL}', '')"
    gaps = ", ".join(f"CASE WHEN regexp_matches(plain, '{p}') THEN '{k}' END" for k, (_, p) in ls.GAPS.items())
    rules, licenses, steps = [], [], ["s0 AS (SELECT doc_id, c, s AS r0 FROM q WHERE c > 0)"]
    for k, r in enumerate(ls.RULES):
        pattern = "".join(f"|{x}|" for x in r.sentences)
        rules.append(f"CASE WHEN contains(r{k}, '{pattern}') THEN '{r.rule}' END")
        licenses.append(f"('{r.rule}', '{r.license}')")
        steps.append(f"s{k + 1} AS (SELECT *, replace(r{k}, '{pattern}', '||') AS r{k + 1} FROM s{k})")
    return f"""WITH k(plain, id) AS (VALUES {known}), kn(name, nid) AS (VALUES {names}), lic(rule, license) AS (VALUES {", ".join(licenses)}),
 p AS (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM (SELECT doc_id, string_split_regex(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+') AS parts FROM documents)),
 n AS (SELECT doc_id, i, trim(regexp_replace(lower(part), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS plain FROM p WHERE length(trim(part)) > 0),
 o AS (SELECT doc_id, i, {tail} AS held FROM (SELECT doc_id, i, {held} AS held FROM n)),
 e AS (SELECT doc_id, i, unnest(parts) AS name, unnest(range(len(parts))) AS j FROM (SELECT doc_id, i, list_transform(string_split_regex(held, '{ls.BETWEEN}'), lambda x: {back}) AS parts FROM o)),
 kk AS (SELECT doc_id, i, string_agg(nid, '||' ORDER BY j) AS nid FROM e JOIN kn USING (name) GROUP BY 1, 2),
 m AS (SELECT n.*, coalesce(k.id, {gaps}, kk.nid) AS id FROM n LEFT JOIN k USING (plain) LEFT JOIN kk ON kk.doc_id = n.doc_id AND kk.i = n.i),
 q AS (SELECT doc_id, count(id) AS c, '|' || string_agg(coalesce(id, ''), '||' ORDER BY i) || '|' AS s FROM m GROUP BY 1),
 {", ".join(steps)},
 r AS (SELECT doc_id, c, list_filter([{", ".join(rules)}], lambda x: x IS NOT NULL) AS rs FROM s{len(ls.RULES)}),
 l AS (SELECT doc_id, list_sort(list(DISTINCT license)) AS li FROM (SELECT doc_id, unnest(rs) AS rule FROM r) JOIN lic USING (rule) GROUP BY 1)
 SELECT d.doc_id, coalesce(c, 0) AS n_known_sentences, coalesce(array_to_string(rs, ','), '') AS rules, coalesce(array_to_string(li, ','), '') AS licenses
 FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN l ON d.doc_id = l.doc_id"""


def line_dedup() -> str:
    # The first line of each set of words stands for it; sets that are alike share a rare word, as with the shingles below.
    return r"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents), l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM d),
 w AS MATERIALIZED (SELECT doc_id, i, line, list_sort(list_distinct(regexp_extract_all(lower(line), '(?:[0-9a-z]|[^\x00-\x7F])+'))) AS g FROM l),
 s AS MATERIALIZED (SELECT g, len(g) AS n, min({'d': doc_id, 'i': i}) AS first FROM w WHERE len(g) > 0 GROUP BY g),
 e AS (SELECT first, n, unnest(g) AS k FROM s), f AS (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM e),
 p AS MATERIALIZED (SELECT first, n, k FROM f QUALIFY row_number() OVER (PARTITION BY first ORDER BY c, k) <= n - (4 * n + 4) // 5 + 1),
 m AS (SELECT DISTINCT a.first AS a, b.first AS b FROM p AS a JOIN p AS b ON a.k = b.k AND b.first < a.first AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
 v AS (SELECT m.a, len(list_intersect(s.g, u.g)) AS i, s.n + u.n AS n FROM m JOIN s ON s.first = m.a JOIN s AS u ON u.first = m.b),
 r AS (SELECT DISTINCT a FROM v WHERE 5 * i >= 4 * (n - i)),
 k AS (SELECT w.doc_id, w.i, w.line, len(w.g) > 0 AS worded, coalesce({'d': w.doc_id, 'i': w.i} > s.first OR r.a IS NOT NULL, false) AS gone FROM w LEFT JOIN s USING (g) LEFT JOIN r ON r.a = s.first),
 t AS (SELECT doc_id, count(*) FILTER (worded) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM k GROUP BY doc_id)
 SELECT doc_id, n_lines, n_removed, CAST(length(kept) AS BIGINT) AS n_kept_chars, sha256(kept) AS kept_sha256 FROM t"""


def minhash() -> str:
    # All pairs by rare shingles first: two sets of n and m shingles that are alike share one of the first n - ceil(0.8 n) + 1 of each.
    return r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), t AS MATERIALIZED (SELECT x, min(doc_id) AS rep, regexp_extract_all(lower(x), '(?:[0-9a-z]|[^\x00-\x7F])+') AS w FROM d GROUP BY x),
 s AS MATERIALIZED (SELECT rep, list_distinct(CASE WHEN len(w) < 5 THEN list_filter([array_to_string(w, ' ')], lambda y: y <> '') ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' ')) END) AS g FROM t),
 e AS (SELECT rep, len(g) AS n, unnest(g) AS k FROM s), f AS (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM e),
 p AS (SELECT rep, n, k FROM f QUALIFY row_number() OVER (PARTITION BY rep ORDER BY c, k) <= n - (4 * n + 4) // 5 + 1),
 m AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM p AS a JOIN p AS b ON a.k = b.k AND a.rep < b.rep AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
 v AS MATERIALIZED (SELECT m.a, m.b, len(list_intersect(s.g, u.g)) AS i, len(s.g) + len(u.g) AS n FROM m JOIN s ON s.rep = m.a JOIN s AS u ON u.rep = m.b),
 l AS MATERIALIZED (SELECT a, b FROM v WHERE 5 * i >= 4 * (n - i) UNION SELECT b, a FROM v WHERE 5 * i >= 4 * (n - i)),
 r AS (SELECT rep AS a, rep AS b FROM t UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), z AS (SELECT a, min(b) AS class_id FROM r GROUP BY a)
 SELECT doc_id, class_id FROM d JOIN t USING (x) JOIN z ON z.a = t.rep"""


def suffix_dedup() -> str:
    # Every start of 100 bytes by its md5; starts at most 100 apart are one run.
    return """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
 w AS (SELECT doc_id, s, md5(h[s + 1:s + 100]) AS k FROM (SELECT doc_id, h, unnest(range(n - 99)) AS s FROM d)),
 r AS (SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
 g AS (SELECT *, CASE WHEN s <= 100 + lag(s) OVER (PARTITION BY doc_id ORDER BY s) THEN 0 ELSE 1 END AS fresh FROM r),
 i AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM g),
 m AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY doc_id, run),
 p AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM m UNION ALL SELECT d.doc_id, coalesce(max(b), 0), any_value(n) FROM d LEFT JOIN m USING (doc_id) GROUP BY d.doc_id),
 k AS (SELECT doc_id, sha256(unhex(string_agg(hex(h[a + 1:b]), '' ORDER BY a, b))) AS kept_sha256 FROM p JOIN d USING (doc_id) GROUP BY doc_id)
 SELECT d.doc_id, n AS n_bytes, CAST(coalesce(sum(b - a), 0) AS BIGINT) AS n_removed, count(a) AS n_spans, any_value(kept_sha256) AS kept_sha256 FROM d JOIN k USING (doc_id) LEFT JOIN m USING (doc_id) GROUP BY d.doc_id, n"""


def decontaminate() -> str:
    marks = dc.PUNCTUATION.replace("'", "''")
    later = " || ' ' || ".join(["c", *[f"lead(c, {k}) OVER p" for k in range(1, dc.WINDOW)]])

    def side(name: str, table: str, key: str) -> str:
        runs = f"AND capitals < {dc.CAPITALS}" if name == "d" else ""
        return f"""{name}w AS (SELECT {key} AS k, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT {key}, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM {table})),
 {name}b AS (SELECT k, i, w, trim(w, '{marks}') AS bare, coalesce(right(lag(w) OVER (PARTITION BY k ORDER BY i), 1), '.') AS before FROM {name}w),
 {name}c AS (SELECT k, i, lower(bare) AS v, CASE WHEN left(bare, 1) BETWEEN '0' AND '9' THEN '<num>' WHEN lower(bare) IN ({_quoted(dc.UNITS)}) THEN '<unit>'
  WHEN left(bare, 1) <> left(lower(bare), 1) AND before NOT IN ('.', '!', '?', ':') {runs} THEN '<name>' ELSE lower(bare) END AS c
  FROM (SELECT *, count(*) FILTER (cased = 1) OVER (PARTITION BY k, run) AS capitals FROM (SELECT *, sum(CASE WHEN cased = -1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS run
   FROM (SELECT *, CASE WHEN left(bare, 1) <> left(lower(bare), 1) THEN 1 WHEN upper(left(bare, 1)) <> left(lower(bare), 1) THEN -1 ELSE 0 END AS cased FROM {name}b)))),
 {name}g AS (SELECT * FROM (SELECT k, i, {later} AS g FROM {name}c WINDOW p AS (PARTITION BY k ORDER BY i)) WHERE g IS NOT NULL)"""

    slot = "c IN ('<num>', '<name>', '<unit>')"
    return f"""WITH {side("d", "documents", "doc_id")}, {side("b", "benchmark", "item_id")},
 tot AS (SELECT k, count(*) AS n FROM bg GROUP BY 1),
 lit AS (SELECT bg.k, bg.i, bg.g FROM bg JOIN bc ON bg.k = bc.k AND bc.i BETWEEN bg.i AND bg.i + {dc.WINDOW - 1} GROUP BY ALL HAVING count(*) FILTER (NOT {slot}) >= {dc.LITERALS}),
 pg AS (SELECT * FROM (SELECT k, i, {later} AS g FROM (SELECT k, i, CASE WHEN c = '<name>' THEN v ELSE c END AS c FROM bc) WINDOW p AS (PARTITION BY k ORDER BY i)) WHERE g IS NOT NULL),
 al AS (SELECT * FROM lit UNION SELECT pg.* FROM pg JOIN lit ON lit.k = pg.k AND lit.i = pg.i),
 hit AS (SELECT dg.k AS d, lit.k AS b, lit.i AS bi, dg.i - lit.i AS diag FROM dg JOIN al AS lit ON dg.g = lit.g),
 s AS (SELECT d, b, diag, bc.v AS value, min(dc.v) AS lo, max(dc.v) AS hi FROM hit JOIN bc ON bc.k = hit.b AND bc.i BETWEEN bi AND bi + {dc.WINDOW - 1} AND {slot.replace("c IN", "bc.c IN")} JOIN dc ON dc.k = hit.d AND dc.i = bc.i + diag GROUP BY ALL),
 f AS (SELECT d, b, diag, count(*) AS n_slots, sum(CASE WHEN lo <> hi THEN 1 ELSE 0 END) AS conflicts FROM s GROUP BY ALL),
 a AS (SELECT d, b, diag, coalesce(n_slots, 0) AS n_slots, coalesce(conflicts, 0) AS conflicts FROM (SELECT DISTINCT d, b, diag FROM hit) LEFT JOIN f USING (d, b, diag)),
 t AS (SELECT d, b, sum(n_slots) AS n_slots, sum(conflicts) AS n_conflicts FROM a GROUP BY 1, 2),
 x AS (SELECT hit.*, bc.v AS bv, dc.v AS dv, s.lo <> s.hi AS bad FROM hit JOIN bc ON bc.k = hit.b AND bc.i BETWEEN bi AND bi + {dc.WINDOW - 1} JOIN dc ON dc.k = hit.d AND dc.i = bc.i + hit.diag
  LEFT JOIN s ON s.d = hit.d AND s.b = hit.b AND s.diag = hit.diag AND s.value = bc.v AND {slot.replace("c IN", "bc.c IN")}),
 g AS (SELECT d, b, diag, bi FROM x GROUP BY ALL HAVING bool_and(bv = dv) OR NOT bool_or(coalesce(bad, false))),
 w AS (SELECT d, b, count(DISTINCT bi) AS n FROM g GROUP BY 1, 2)
 SELECT t.d AS doc_id, t.b AS item_id, coalesce(w.n, 0) AS n_windows, tot.n AS n_item_windows, CAST(t.n_slots AS BIGINT) AS n_slots, CAST(t.n_conflicts AS BIGINT) AS n_conflicts,
 coalesce(w.n, 0) >= least({dc.LEAST_WINDOWS}, tot.n) AND coalesce(w.n, 0) >= {dc.LEAST_COVER} * tot.n AS leaked FROM t JOIN tot ON tot.k = t.b LEFT JOIN w ON w.d = t.d AND w.b = t.b"""


def chat_format() -> str:
    # Control strings neither overlap nor hold one another, so each occurrence is broken by one character.
    broken = " + ".join(f"(length(x) - length(replace(x, {_quoted([c])}, ''))) // {len(c)}" for c in cf.control_strings())
    grown = f"length(x) + length(x) - length(replace(x, '{cf.ESCAPE}', '')) + {broken}"
    marks = " ".join(f"WHEN '{role}' THEN {len(''.join(pair))}" for role, pair in cf.TEMPLATE.items())
    others = len("[ROLE][/ROLE][/TURN]")
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -1, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) AS r(k)),
 s AS (SELECT *, {grown} AS text_chars, CASE role {marks} ELSE {others} + (SELECT {grown} FROM (SELECT role AS x)) END AS mark_chars FROM c),
 g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, role, x) AS turns,
  coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, x) FILTER (role = 'assistant'), '') AS loss, 3 + sum(text_chars + mark_chars) AS chars FROM s GROUP BY 1)
 SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g"""


def fill_in_middle() -> str:
    number = ", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, regexp_extract_all(coalesce(text, ''), '{fm.UNIT}') AS u FROM documents),
 e AS (SELECT doc_id, t, u, len(u) AS n, {number} FROM d),
 f AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '{fm.PREFIX}') OR contains(t, '{fm.SUFFIX}') OR contains(t, '{fm.MIDDLE}') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p, array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
  array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s FROM e)
 SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{fm.PREFIX}' || p || '{fm.SUFFIX}' || s || '{fm.MIDDLE}' || m ELSE '{fm.SUFFIX}' || s || '{fm.PREFIX}' || p || '{fm.MIDDLE}' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM f"""


def sharding() -> str:
    # The remainders of the 256 byte values by the reflected polynomial, then one step for each byte of the text.
    best = lambda n: f"list_reduce(list_transform(range({n}), lambda i: {{'score': -1 / ln((CAST('0x' || left(md5('0|' || i || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), {sh.DRAW_DIGITS}) AS BIGINT) + CAST(0.5 AS DOUBLE)) / {16**sh.DRAW_DIGITS}), 'shard': i}}), lambda a, b: CASE WHEN b.score >= a.score THEN b ELSE a END).shard"
    return f"""WITH r AS (SELECT list(c ORDER BY k) AS t FROM (SELECT k, list_reduce(list_concat([k], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS b(k))),
 d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
 s AS (SELECT doc_id, strlen(x) + 1 AS size, xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32,
  CAST({best(8)} AS INTEGER) AS shard, CAST({best(9)} AS INTEGER) AS grown_shard FROM d, r)
 SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || left(md5(concat_ws('|', doc_id, size, text_crc32)), 8) AS BIGINT) % {sh.BLOCKS}, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard FROM s"""


def hard_negatives() -> str:
    return """WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.id AS a, r.id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score FROM r AS a JOIN r ON a.id <> r.id WHERE a.id % 100 = 0),
 p AS (SELECT a, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= 5)
 SELECT p.a AS anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
 FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
 QUALIFY row_number() OVER (PARTITION BY p.a, p.id ORDER BY s.score DESC, s.id) <= 5"""
