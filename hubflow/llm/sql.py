"""DuckDB SQL of the operators' queries, written independently of the Spark code."""

from __future__ import annotations


def _walk(kinds: list[tuple[str, str, str, str]]) -> str:
    """CTEs up to ``span(doc_id, kind, k, s, e)``: matches of each pattern in
    order, each found as the first place of its text after the one before it
    (a leftmost match cannot start later than its own text's next place)."""
    found = "\n  UNION ALL\n  ".join(
        f"SELECT doc_id, t, {k} AS k, '{name}' AS kind, regexp_extract_all(t, '{pat}') AS m, "
        f"{lens} AS keep_list FROM d WHERE {where}"
        for k, (name, pat, where, lens) in enumerate(kinds))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (
  {found}
),
w AS (
  SELECT doc_id, k, kind, m, keep_list, 1 AS i, t AS rest, 0 AS off, NULL::BIGINT AS s, NULL::BIGINT AS e
  FROM f WHERE len(m) > 0
  UNION ALL
  SELECT doc_id, k, kind, m, keep_list, i + 1, substr(rest, strpos(rest, m[i]) + length(m[i])),
         off + strpos(rest, m[i]) - 1 + length(m[i]), off + strpos(rest, m[i]) - 1,
         off + strpos(rest, m[i]) - 1 + length(m[i])
  FROM w WHERE i <= len(m)
),
span AS (SELECT doc_id, kind, k, s, e, m[i - 1] AS v, keep_list[i - 1] AS g FROM w WHERE i > 1)"""


def _digest(base: int, counts: list[str]) -> str:
    tag = "kind || ':' || s || ':' || e"
    return f"""
SELECT d.doc_id, {', '.join(f"count(*) FILTER (ok.kind = '{c}') AS n_{c}" for c in counts)},
  sha256(coalesce(string_agg({tag}, ',' ORDER BY s, k) FILTER (k < {base}), '')) AS base_sha256,
  coalesce(string_agg({tag}, ',' ORDER BY s, k), '') AS spans
FROM d LEFT JOIN ok USING (doc_id) GROUP BY d.doc_id"""


_KEY = ("([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"
        "[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])")
_ASSIGN = _KEY + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_ALL = "regexp_extract_all(t, '{}')"

SECRETS = _walk([
    ("assign", _ASSIGN, "true", f"regexp_extract_all(t, '{_ASSIGN}', 2)"),
    ("access", "AKIA[A-Z0-9]+", "true", _ALL.format("AKIA[A-Z0-9]+")),
    ("hex", "[0-9a-f]+", "true", _ALL.format("[0-9a-f]+")),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true", _ALL.format("-----BEGIN [A-Z ]*PRIVATE KEY-----")),
    *[(n, p, "true", _ALL.format(p)) for n, p in (
        ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
        ("forge", "gh[pousr]_[A-Za-z0-9]{36,}"),
        ("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"))],
]).replace("'[0-9a-f]+'", "'[0-9a-f]{24,}'") + """,
ok AS (SELECT * FROM span WHERE length(g) >= CASE kind WHEN 'assign' THEN 6 WHEN 'access' THEN 20
                                                       WHEN 'hex' THEN 24 ELSE 0 END)
""" + _digest(3, ["assign", "access", "hex"])

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
_IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
_CARD = r"[0-9]([\x20-]?[0-9])+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_IBAN = "[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"
PII = _walk([(n, p, "true", _ALL.format(p)) for n, p in (
    ("email", _EMAIL), ("ip", _IP), ("card", _CARD), ("phone", _PHONE), ("iban", _IBAN))]) + """,
dig AS (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS dg,
               substr(v, 5) || substr(v, 1, 4) AS turned FROM span),
ok AS (SELECT * FROM dig WHERE CASE kind
  WHEN 'email' THEN true
  WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda x: coalesce(try_cast(x AS HUGEINT), 256) > 255)) = 0
  WHEN 'card' THEN length(dg) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(dg) + 1),
    lambda i: CASE WHEN (length(dg) - i) % 2 = 0 THEN substr(dg, i, 1)::INT
                   ELSE (2 * substr(dg, i, 1)::INT) // 10 + (2 * substr(dg, i, 1)::INT) % 10 END)) % 10 = 0
  WHEN 'phone' THEN length(dg) BETWEEN 10 AND 15
  ELSE list_reduce(list_prepend(0, list_transform(range(1, length(turned) + 1), lambda i:
         CASE WHEN ascii(substr(turned, i, 1)) < 58 THEN ascii(substr(turned, i, 1)) - 48
              ELSE ascii(substr(turned, i, 1)) - 55 END)),
         lambda a, x: (a * (CASE WHEN x < 10 THEN 10 ELSE 100 END) + x) % 97) = 1 END)
""" + _digest(4, ["email", "ip", "card", "phone"])

_LINES = r"""
list_filter(list_transform(string_split({text}, chr(10)),
  lambda x: regexp_replace(x, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g')), lambda x: x <> '')"""


def line_dedup(source: str, id_col: str, host: str, text: str, ratio: float, least: int) -> str:
    """CTEs up to ``kept(id, lines, kept)`` over the table ``source``."""
    return f"""
b AS (SELECT {id_col} AS id, {host} AS host, {_LINES.format(text=text)} AS lines FROM {source}),
l AS (SELECT id, host, unnest(list_distinct(lines)) AS line FROM b),
c AS (SELECT host, line FROM l JOIN (SELECT host, count(*) AS pages FROM b GROUP BY host) p USING (host)
      GROUP BY host, line, pages HAVING count(*) >= {least} AND count(*) > {ratio} * pages),
x AS (SELECT l.id, list(line) AS lost FROM l JOIN c USING (host, line) GROUP BY l.id),
kept AS (SELECT b.id, lines, CASE WHEN lost IS NULL THEN lines
                ELSE list_filter(lines, lambda v: NOT list_contains(lost, v)) END AS kept
         FROM b LEFT JOIN x USING (id))"""


_MARKUP = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]*>"
LINE_DEDUP = "WITH " + line_dedup(
    "pages", "page_id",
    r"lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1))",
    f"regexp_replace(coalesce(html, ''), '{_MARKUP}', chr(10), 'g')", 0.1, 3) + """
SELECT id AS page_id, array_to_string(kept, chr(10)) AS text, len(lines)::BIGINT AS n_lines,
       (len(lines) - len(kept))::BIGINT AS n_dropped FROM kept"""


def word_list(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def shingle_list(w: str) -> str:
    """Distinct five-word shingles of the word list ``w`` as strings."""
    return (f"CASE WHEN len({w}) = 0 THEN [] WHEN len({w}) < 5 THEN ['short ' || array_to_string({w}, ' ')] "
            f"ELSE list_distinct(list_transform(range(1, len({w}) - 3), "
            f"lambda i: array_to_string({w}[i:i + 4], ' '))) END")


def contaminated(docs: str) -> str:
    """CTEs up to ``leak(doc_id, item_id, n_shared, n_item)`` for a table of documents."""
    return f"""
dw AS (SELECT doc_id, {word_list('text')} AS w FROM {docs}),
iw AS (SELECT item_id, {word_list('text')} AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest({shingle_list('w')}) AS g FROM dw),
il AS (SELECT item_id, unnest({shingle_list('w')}) AS g FROM iw),
leak AS (SELECT doc_id, item_id, count(*) AS n_shared, n_item FROM ds JOIN il USING (g)
         JOIN (SELECT item_id, count(*) AS n_item FROM il GROUP BY item_id) USING (item_id)
         GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.75 * n_item)"""


DECONTAMINATION = "WITH " + contaminated("documents") + """
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM leak"""


def packing(docs: str, n_buckets: int = 16, budget: int = 65536) -> str:
    """Table expression text after ``WITH RECURSIVE``: the packing of ``docs``."""
    return rf"""
ln AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM {docs}),
rw AS (SELECT doc_id, n, greatest(1, CASE WHEN n <= 4096 THEN n ELSE
         ((n + (1::BIGINT << (length(bin(n)) - 12)) - 1) // (1::BIGINT << (length(bin(n)) - 12)))
         * (1::BIGINT << (length(bin(n)) - 12)) END) AS b FROM ln),
hs AS (SELECT list(b ORDER BY b) AS lens, list(c ORDER BY b) AS cum, len(list(b)) AS m
       FROM (SELECT b, sum(count(*)) OVER (ORDER BY b)::HUGEINT AS c FROM rw GROUP BY b)),
dp AS (
  SELECT 1 AS k, list_transform(range(1, m + 1), lambda j: lens[j] * cum[j]) AS best,
         [list_transform(range(1, m + 1), lambda j: 0)] AS picks, lens, cum, m FROM hs
  UNION ALL
  SELECT k + 1, list_transform(opts, lambda o: list_min(o)),
         list_append(picks, list_transform(opts, lambda o: len(o) - list_position(list_reverse(o), list_min(o)) + 1)),
         lens, cum, m
  FROM (SELECT k, picks, lens, cum, m, list_transform(range(1, m + 1), lambda j:
          CASE WHEN j <= k THEN [best[j]] ELSE
          list_transform(range(1, j), lambda i: CASE WHEN i < k THEN NULL ELSE best[i] + lens[j] * (cum[j] - cum[i]) END) END
        ) AS opts FROM dp WHERE k < least({n_buckets}, m))
),
last AS (SELECT * FROM dp ORDER BY k DESC LIMIT 1),
bk AS (
  SELECT k, m AS j, [lens[m]] AS bounds, picks, lens FROM last
  UNION ALL
  SELECT k - 1, picks[k][j], list_prepend(lens[picks[k][j]], bounds), picks, lens FROM bk WHERE k > 1
),
bd AS (SELECT bounds FROM bk WHERE k = 1),
pl AS (SELECT doc_id, n, len(list_filter(bounds, lambda x: x < b)) AS bucket,
              bounds[len(list_filter(bounds, lambda x: x < b)) + 1] AS bucket_len FROM rw, bd),
nb AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS nth,
              greatest(1, {budget} // bucket_len) AS cap FROM pl)
SELECT doc_id, n AS n_tokens, bucket::INT AS bucket, bucket_len, nth // cap AS batch, nth % cap AS slot,
       bucket_len - n AS padding FROM nb"""


PACKING = "WITH RECURSIVE " + packing("documents")


def ascii_word_list(text: str) -> str:
    return (rf"list_filter(regexp_split_to_array(translate(coalesce({text}, ''), "
            r"'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')")


def near_components(docs: str) -> str:
    """CTEs (recursive) up to ``comp(doc_id, n, component_id)``."""
    return f"""
nw AS (SELECT doc_id, {ascii_word_list('text')} AS w FROM {docs}),
ng AS (SELECT doc_id, {shingle_list('w')} AS gs FROM nw),
nu AS (SELECT doc_id, unnest(gs) AS g FROM ng),
link AS (SELECT x.doc_id AS a, y.doc_id AS b FROM nu x JOIN nu y ON x.g = y.g AND x.doc_id <> y.doc_id
         JOIN ng p ON p.doc_id = x.doc_id JOIN ng q ON q.doc_id = y.doc_id
         GROUP BY x.doc_id, y.doc_id, len(p.gs), len(q.gs)
         HAVING 100 * count(*) >= 75 * (len(p.gs) + len(q.gs) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM ng UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT ng.doc_id, len(gs)::BIGINT AS n, c.component_id FROM ng
         JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id))"""


NGRAM_JOIN = "WITH RECURSIVE " + near_components("documents") + """
SELECT doc_id, n AS n_shingles, component_id FROM comp"""


EMBEDDINGS = """WITH RECURSIVE
v AS (SELECT vec_id, embedding::DOUBLE[] AS e, len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm, len(e) AS d FROM v WHERE ok),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM n x JOIN n y ON x.vec_id <> y.vec_id AND x.d = y.d
         WHERE list_inner_product(x.e, y.e) / (x.norm * y.norm) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = c.vec_id) AS n_links, component_id,
       vec_id = component_id AS kept FROM c"""


LM_SCORE = rf"""WITH
d AS (SELECT doc_id, {ascii_word_list('text')} AS w FROM documents),
p AS (SELECT doc_id, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS c
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
u AS (SELECT a, count(*) AS n FROM p GROUP BY a),
bi AS (SELECT b, a, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY b, a),
tri AS (SELECT c, b, a, count(*) AS n FROM p WHERE c IS NOT NULL GROUP BY c, b, a),
s AS (SELECT p.doc_id, tri.n >= 2 AS full_order, u.n < 2 AND coalesce(bi.n, 0) < 2 AS unseen, CASE
        WHEN tri.n >= 2 THEN ln(tri.n) - ln(cb.n)
        WHEN bi.n >= 2 THEN ln(0.4) + ln(bi.n) - ln(ub.n)
        WHEN u.n >= 2 THEN 2 * ln(0.4) + ln(u.n) - ln((SELECT count(*) FROM p))
        ELSE 2 * ln(0.4) - ln((SELECT count(*) FROM p)) END AS v
      FROM p JOIN u ON u.a = p.a LEFT JOIN bi ON bi.a = p.a AND bi.b = p.b
      LEFT JOIN tri ON tri.a = p.a AND tri.b = p.b AND tri.c = p.c
      LEFT JOIN bi cb ON cb.a = p.b AND cb.b = p.c LEFT JOIN u ub ON ub.a = p.b)
SELECT d.doc_id, count(v) AS n_words, round(coalesce(sum(v), 0), 4) + 0.0 AS log_score,
       round(avg(v), 6) + 0.0 AS mean_log_score, count(*) FILTER (full_order) AS n_full,
       count(*) FILTER (unseen) AS n_unseen
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"""


EXACT_DEDUP = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
           FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(x) DESC, doc_id)"""


def _crc32(text: str) -> str:
    bit = "CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: {bit})"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), "
            f"lambda h: ascii(h)::BIGINT)), lambda c, b: {byte}), 4294967295)")


def _edit(state: str, cost: str, edit: str) -> str:
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || {edit}}} END"


def _least(*entries: str) -> str:
    return f"list_min([{', '.join(entries)}])"


_SEEN = r"regexp_replace(text, '[\x20\x09-\x0D]+$', '')"
_ROW = "CASE WHEN NOT gone THEN {} END"
_TO_U = "CASE WHEN ini = 'u' THEN 0 ELSE 1 END + extra", "CASE WHEN ini = 'u' THEN 'K' ELSE 'R' END"
_TO_A = "CASE WHEN ini = 'a' THEN 0 ELSE 1 END + extra", "CASE WHEN ini = 'a' THEN 'K' ELSE 'R' END"
CONVERSATION = f"""
WITH RECURSIVE c0 AS (SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS c, turn, coalesce(role, ' ') AS role,
                             coalesce(text, ' ') AS text FROM conversations),
c1 AS (SELECT *, {_crc32("(c || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM c0),
c2 AS (SELECT conv_id, c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
              CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
              unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c1),
c3 AS (SELECT c, turn, role, text, role[1] AS ini, {_SEEN} = '' AS blank, {_SEEN}[-1] NOT IN ('.', '!', '?') AS cut,
              row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS rn FROM c2),
c4 AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY rn) > 1 AS again,
              lag(ini) OVER (PARTITION BY c ORDER BY rn) || ini AS two FROM c3),
r AS (SELECT *, blank OR again AS gone, CASE WHEN cut THEN 5 ELSE 0 END AS extra FROM c4),
facts AS (SELECT c, max(rn) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                 count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
                 count(*) FILTER (NOT gone AND cut) AS truncated,
                 count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY c),
dp AS (
  SELECT DISTINCT c, 0::BIGINT AS k, {{'c': 0::BIGINT, 'a': ''}} AS e, NULL::STRUCT(c BIGINT, a VARCHAR) AS s,
         NULL::STRUCT(c BIGINT, a VARCHAR) AS u, NULL::STRUCT(c BIGINT, a VARCHAR) AS a FROM r
  UNION ALL
  SELECT c, k, {_edit('e', '2', "'D'")},
         {_least(_edit('s', '2', "'D'"), "CASE WHEN NOT gone AND ini = 's' THEN " + _edit('e', 'extra', "'K'") + " END")},
         {_least(_edit('u', '2', "'D'"), _ROW.format(_least(*(_edit(x, *_TO_U) for x in 'esa'))))},
         {_least(_edit('a', '2', "'D'"), _ROW.format(_edit('u', *_TO_A)))}
  FROM (SELECT dp.c, r.rn AS k, gone, extra, ini, e, s,
               {_least('u', *(_edit(x, '5', "'I'") for x in 'esa'))} AS u,
               {_least('a', _edit('e', '10', "'II'"), _edit('s', '10', "'II'"), _edit('u', '5', "'I'"))} AS a
        FROM dp JOIN r ON r.c = dp.c AND r.rn = dp.k + 1)
),
best AS (SELECT dp.c, {_least('e', 'a', _edit('u', '5', "'I'"), _edit('s', '10', "'II'"))} AS b
         FROM dp JOIN facts ON facts.c = dp.c AND facts.n = dp.k),
ch AS (SELECT c, i, b.a[i] AS x, sum(CASE WHEN b.a[i] <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY i) AS rn,
              sum(CASE WHEN b.a[i] <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY i) AS o
       FROM (SELECT c, b, unnest(range(1, length(b.a) + 1)) AS i FROM best)),
ed AS (SELECT ch.c, i, x, o, CASE WHEN x = 'I' THEN '' ELSE text END AS text, role,
              max(CASE WHEN o = 1 AND x = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY ch.c) AS sys
       FROM ch LEFT JOIN r ON r.c = ch.c AND r.rn = ch.rn),
fixed AS (SELECT c, string_agg(CASE WHEN x = 'K' THEN role WHEN (o - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END
                               || ':' || text, chr(10) ORDER BY i) AS t FROM ed WHERE x <> 'D' GROUP BY c)
SELECT p.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost,
       coalesce(b.a, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, c FROM c0) p LEFT JOIN facts USING (c) LEFT JOIN best USING (c) LEFT JOIN fixed USING (c)"""

_TERMS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
RANKED_SEARCH = rf"""
WITH d AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
st AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM dl),
m AS (SELECT doc_id, 100 - 75 + ((75 * n * nd) // l) AS m FROM dl, st),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, st GROUP BY term, nd),
q AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
       FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)
WHERE rank <= 10"""
