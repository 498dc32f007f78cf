"""DuckDB SQL for the queries of this subpackage that SQL can express. Fixed values come from the operators' modules."""

from __future__ import annotations

from brindle.llm.chat import _ESCAPE, CLOSE, MIDDLE, OPEN
from brindle.llm.quality import CLASSES, COMMON, FAR_CLASSES, FAR_WORDS, MIN_DOCUMENTS, MIN_WORDS, OTHER, SMALL, WORDS
from brindle.llm.warc import SECONDS, URL

_WORD = r"'[^\x20\x09-\x0D]+'"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _count(column: str, characters: str) -> str:
    return f"length({column}) - length(translate({column}, {_text(characters)}, ''))"


def _half(a: str, b: str) -> str:
    return f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"


def _distance(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists of shares."""
    return f"sqrt(greatest(0, 0.5 * list_sum(list_transform(list_zip({p}, {q}), lambda z: {_half('z[1]', 'z[2]')} + {_half('z[2]', 'z[1]')}))))"


def _shares(counts: str) -> str:
    return f"list_transform({counts}, lambda x: CASE WHEN list_sum({counts}) > 0 THEN x / list_sum({counts}) ELSE 0.0 END)"


def op6() -> str:
    """Rows are numbered, so null and repeated ids stay apart."""
    names = ["small", *CLASSES]
    own = ", ".join(f"{_count('solid', c)} AS {n}" for n, c in CLASSES.items())
    langs = ", ".join(map(_text, COMMON))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, regexp_extract_all(t, {_WORD}) AS w, regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g') AS solid,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_WORD})) AS lines FROM d),
o AS (SELECT *, {own}, {_count('solid', SMALL)} AS small, {_count('solid', '#*$%&|<>')} AS n_symbols, length(solid) AS word_chars, len(w) AS n_words,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM s),
k AS (SELECT r, unnest(w) AS word FROM s),
kc AS (SELECT r, lower(word) AS word, count(*) AS n FROM k WHERE lower(word) IN ({", ".join(map(_text, WORDS))}) GROUP BY ALL),
km AS (SELECT r, map_from_entries(list((word, n))) AS m, sum(n) AS n FROM kc GROUP BY r),
h AS (SELECT o.*, [{", ".join(names)}, word_chars - {" - ".join(names)}] AS chars,
    list_append(list_transform([{", ".join(map(_text, WORDS))}], lambda v: CAST(coalesce(m[v], 0) AS DOUBLE)), {OTHER} * CAST(n_words - coalesce(km.n, 0) AS DOUBLE)) AS words
    FROM o LEFT JOIN km USING (r)),
p AS (SELECT r, generate_subscripts(w, 1) AS p, w FROM s WHERE len(w) >= 3),
win AS (SELECT r, p, count(*) OVER (PARTITION BY r, w[p], w[p + 1], w[p + 2]) AS n FROM p WHERE p + 2 <= len(w)),
rep AS (SELECT r, count(DISTINCT p + i) AS n_repeat_words FROM win, range(3) AS g(i) WHERE n >= 2 GROUP BY r),
good AS (SELECT * FROM h WHERE lang IN ({langs}) AND n_words >= {MIN_WORDS} AND symbol * 10 <= word_chars AND capital * 2 <= word_chars),
ref_n AS (SELECT lang FROM good GROUP BY lang HAVING count(*) >= {MIN_DOCUMENTS}),
ref_c AS (SELECT lang, list(n ORDER BY i) AS c FROM (SELECT lang, i, sum(x) AS n FROM (SELECT lang, generate_subscripts(chars, 1) AS i, unnest(chars) AS x FROM good) GROUP BY lang, i) GROUP BY lang),
ref_w AS (SELECT lang, list(n ORDER BY i) AS c FROM (SELECT lang, i, sum(x) AS n FROM (SELECT lang, generate_subscripts(words, 1) AS i, unnest(words) AS x FROM good) GROUP BY lang, i) GROUP BY lang),
refs AS (SELECT {_shares('ref_c.c')} AS c, {_shares('ref_w.c')} AS w FROM ref_n JOIN ref_c USING (lang) JOIN ref_w USING (lang)),
sh AS (SELECT r, {_shares('chars')} AS c, {_shares('words')} AS w FROM h),
each AS (SELECT r, {_distance('sh.c', 'refs.c')} AS c, {_distance('sh.w', 'refs.w')} AS w FROM sh, refs),
dist AS (SELECT r, arg_min(c, c + w) AS c, arg_min(w, c + w) AS w FROM each GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    n_words < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed,
    NOT (n_words < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words) AND NOT coalesce(dist.c > {FAR_CLASSES} OR dist.w > {FAR_WORDS}, false) AS kept,
    round(dist.c, 6) AS class_distance, round(dist.w, 6) AS word_distance
FROM h LEFT JOIN rep USING (r) LEFT JOIN dist USING (r)"""


def op7() -> str:
    """Each escaped string becomes one character longer."""
    said = _text("</s>[INST] ok [/INST]")
    long = lambda c: f"length({c}) + len(regexp_extract_all({c}, {_text(_ESCAPE.pattern)}))"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', {said}), (-1, 1, 'assistant', {said})),
t AS (SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    CAST(sum({len(OPEN + MIDDLE + CLOSE)} + {long('role')} + {long('text')}) AS BIGINT) AS formatted_chars
    FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM t"""


def op9() -> str:
    """Base32 is four characters for each five hex digits of the SHA-1. Captures of a URL key are numbered by time, id
    (null first) and digest; times follow ids, but for ids out of the calendar, which have the time of id 0."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digits = "".join(f" || '{alphabet}'[((v >> {s}) & 31) + 1]" for s in (15, 10, 5, 0))
    small = f"translate(trim(regexp_replace(coalesce(url, ''), '[\\r\\n]+', ' ', 'g'), ' ' || chr(9)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH p AS (SELECT page_id, {small} AS u, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, u, regexp_extract(u, {_text(URL)}, ['host', 'port', 'path', 'query']) AS m, regexp_matches(u, {_text(URL)}) AS ok, strlen(html) AS payload_bytes, sha1(html) AS sha FROM p),
n AS (SELECT *, CASE WHEN NOT ok THEN u ELSE
    array_to_string(list_reverse(string_split(regexp_replace(m.host, '^www[0-9]*[.]', ''), '.')), ',')
    || CASE WHEN m.port IN ('', '80', '443') THEN '' ELSE ':' || m.port END || ')' || CASE WHEN m.path = '' THEN '/' ELSE m.path END
    || CASE WHEN m.query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(m.query, '&')), '&') END END AS key FROM s),
m AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS last FROM n),
k AS (SELECT *, CASE WHEN page_id IS NULL OR page_id < last THEN last END AS refers_to,
    list_transform(range(8), lambda i: CAST('0x' || substr(sha, CAST(i * 5 + 1 AS BIGINT), 5) AS BIGINT)) AS parts FROM m),
d AS (SELECT *, array_to_string(list_transform(parts, lambda v: ''{digits}), '') AS payload_digest FROM k)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to,
    row_number() OVER (PARTITION BY key ORDER BY CASE WHEN page_id BETWEEN {SECONDS[0]} AND {SECONDS[1]} THEN page_id ELSE 0 END, page_id NULLS FIRST, payload_digest) AS seq FROM d"""


ORACLE = {"op6_quality": op6, "op7_chat": op7, "op9_warc": op9}
