"""DuckDB SQL that states the result of each registered query that SQL can express."""

from __future__ import annotations

from epistola.functions import domains

#: Issues with key words that occur in the test corpus, and their categories.
ISSUES = (
    ("Delay of the works", ("the", "with", "tion", "ered")),
    ("Retard des travaux", ("que", "dans", "eau", "ment")),
    ("Verzug der Arbeiten", ("der", "und", "ung", "ein")),
    ("Pago de obras", ("que", "para", "ción", "ado")),
)
LABELS = (
    ("Delay of the works", "EoT"), ("Delay of the works", "Change of Scope"), ("Retard des travaux", "EoT"), ("Verzug der Arbeiten", "Others"),
    ("Pago de obras", "Payments"), ("Pago de obras", "EoT"),
)
RAW_LABELS = ("EoT", " EoT ", "PAYMENTS", "cos", "payment delay", "Extention of Time", "qqqq", "", "Contractors Obligation", "Disputes", "start date", "misc")

SPACE = r"[\s\x{0085}\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"[\p{L}\p{N}_]+"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def trim_all(x: str) -> str:
    return rx(x, rf"^{SPACE}+|{SPACE}+$", "")


def clean(x: str) -> str:
    x = f"trim({rx(x, SPACE + '+', ' ')})"
    x = rx(x, r"""[^\p{L}\p{N}_\s.,;:!?\-'"]""", " ")
    for sign in ".,:;!?":
        x = rx(x, rf"[{sign}]{{2,}}", sign)
    return f"trim({rx(x, r'\s+([.,:;!?])', chr(92) + '1')})"


def ocr(x: str) -> str:
    """Word bounds spelled out: \\b is ASCII here; two passes, as a match uses up the sign between two."""
    for letter, to in (("l", "I"), ("O", "0")):
        for _ in range(2):
            x = rx(x, rf"(^|[^\p{{L}}\p{{N}}_]){letter}($|[^\p{{L}}\p{{N}}_])", rf"\1{to}\2")
    x = rx(x, r"\.{2,}", "...")
    x = rx(x, SPACE + "+", " ")
    return rx(x, "([a-z])([A-Z])", r"\1 \2")


def normalized(x: str) -> str:
    x = rx(ocr(clean(x)), r"(?m)^(\d+\.)+\s*", "")
    x = rx(x, r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})\b", r"\1/\2/\3")
    return rx(x, r"[$£€¥]\s*", "")


def sentences(x: str) -> str:
    marked = rx(clean(x), r"([.!?])\s+", "\\1\x1e")
    return f"list_filter(list_transform(string_split({marked}, {q(chr(30))}), lambda s: trim(s)), lambda s: s <> '')"


def any_of(x: str, words) -> str:
    return "(" + " + ".join(f"contains({x}, {q(w)})::INT" for w in words) + ")"


def ratio(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif(({b}), 0), 0.0)"


def case(pairs, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {other} END"


def text_list(words) -> str:
    return "[" + ", ".join(map(q, words)) + "]"


ORACLES: dict[str, str] = {}

# ---- documents

ORACLES["clean_text"] = f"SELECT doc_id, {clean('text')} AS cleaned FROM documents"
ORACLES["normalize_document"] = f"SELECT doc_id, {normalized('text')} AS normalized FROM documents"

WINDOWS = f"""
WITH s AS (SELECT doc_id, {sentences("text")} AS p FROM documents),
starts AS (SELECT doc_id, p, unnest(CASE WHEN len(p) = 0 THEN [] WHEN len(p) <= 3 THEN [0] ELSE range(0, ((len(p) - 3 + 1) // 2) * 2 + 1, 2) END) AS i FROM s),
windows AS (
  SELECT doc_id, (i // 2 + 1)::INT AS window_id, array_to_string(p[i + 1 : least(i + 3, len(p))], ' ') AS text, i::INT AS "start", (least(i + 3, len(p)) - 1)::INT AS "end" FROM starts
)
"""
ORACLES["sentence_windows"] = WINDOWS + "SELECT * FROM windows"


def _tied(a: str, b: str, ab: str, n: str) -> str:
    """SQL of the log-likelihood ratio that b follows a."""
    log = lambda k, x: f"(CASE WHEN {k} = 0 THEN 0.0 ELSE ({k}) * ln({x}) END)"
    p, p1, p2 = f"{b}::DOUBLE / {n}", f"{ab}::DOUBLE / {a}", f"({b} - {ab})::DOUBLE / nullif({n} - {a}, 0)"
    apart = f"{log(ab, p)} + {log(f'{a} - {ab}', f'1 - {p}')} + {log(f'{b} - {ab}', p)} + {log(f'{n} - {a} - {b} + {ab}', f'1 - {p}')}"
    near = f"(CASE WHEN {a} = {ab} THEN 0.0 ELSE {log(ab, p1)} + {log(f'{a} - {ab}', f'1 - {p1}')} END)"
    far = f"(CASE WHEN {b} = {ab} THEN 0.0 ELSE {log(f'{b} - {ab}', p2)} + {log(f'{n} - {a} - {b} + {ab}', f'1 - {p2}')} END)"
    return f"(-2 * ({apart} - {near} - {far}))"


_BODY = rx("tok", r"""^["\x27-]+|["\x27,;:-]+$""", "")
_UPPER = "regexp_matches({0}, '^[\"\\x27-]*\\p{{Lu}}')"
SPLIT = f"""
WITH toks AS (
  SELECT doc_id, unnest(l) AS tok, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, list_filter(string_split({clean("text")}, ' '), lambda x: x <> '') AS l FROM documents)
), bodies AS (SELECT *, {_BODY} AS body FROM toks
), kinds AS (SELECT *, CASE WHEN regexp_matches(body, '^-?[0-9][0-9.,]*$') THEN '##number##' ELSE lower(CASE WHEN ends_with(body, '.') THEN left(body, length(body) - 1) ELSE body END) END AS type, ends_with(body, '.') AS stop FROM bodies
), pairs AS (SELECT *, lead(type) OVER w AS next, lead(tok) OVER w AS following FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), counts AS (SELECT type, count(*) AS total, count(*) FILTER (stop) AS with_stop FROM pairs GROUP BY type
), sums AS (SELECT sum(total)::BIGINT AS n, sum(with_stop)::BIGINT AS stops FROM counts
), weighed AS (
  SELECT type, (-2 * (with_stop * ln(stops::DOUBLE / n) + (total - with_stop) * ln(1 - stops::DOUBLE / n) - with_stop * ln(0.99::DOUBLE) - (total - with_stop) * ln(0.01::DOUBLE)))
    * exp(-letters::DOUBLE) * (inner_stops + 1) * pow(letters::DOUBLE, -(total - with_stop)::DOUBLE) AS score
  FROM (SELECT *, length(type) - length(replace(type, '.', '')) AS inner_stops, length(replace(type, '.', '')) AS letters FROM counts), sums
  WHERE with_stop > 0 AND type <> '##number##' AND regexp_matches(type, '[\\p{{L}}\\p{{N}}_]') AND stops < n
), short AS (SELECT type, score FROM weighed WHERE score >= 0.3
), marked AS (SELECT p.*, s.type IS NOT NULL AS short FROM pairs p LEFT JOIN short s USING (type) WHERE stop
), breaks AS (SELECT count(*) AS breaks FROM marked WHERE NOT short
), starters AS (
  SELECT next AS type, score FROM (SELECT f.*, {_tied("breaks", "b", "ab", "n")} AS score FROM (SELECT next, count(*) AS ab FROM marked WHERE NOT short AND next IS NOT NULL GROUP BY next) f JOIN (SELECT type AS next, total AS b FROM counts) USING (next), breaks, sums
    WHERE regexp_matches(next, '[\\p{{L}}\\p{{N}}_]') AND next <> '##number##' AND n::DOUBLE / breaks > b::DOUBLE / ab) WHERE score >= 30
), tied AS (
  SELECT type, next, score FROM (SELECT f.*, {_tied("a", "b", "ab", "n")} AS score FROM (SELECT type, next, count(*) AS ab FROM marked WHERE next IS NOT NULL AND (short OR regexp_matches(body, '^\\p{{L}}\\.$') OR type = '##number##') GROUP BY ALL HAVING count(*) > 1) f
    JOIN (SELECT type, total AS a FROM counts) USING (type) JOIN (SELECT type AS next, total AS b FROM counts) USING (next), sums
    WHERE regexp_matches(next, '[\\p{{L}}\\p{{N}}_]') AND next NOT IN (SELECT type FROM starters) AND n::DOUBLE / a > b::DOUBLE / ab) WHERE score >= 7.88
)
"""
ORACLES["sentence_model"] = SPLIT + """
SELECT 'abbreviation' AS kind, type, '' AS next, round(score, 4) AS score FROM short UNION ALL SELECT 'starter', type, '', round(score, 4) FROM starters UNION ALL SELECT 'collocation', type, next, round(score, 4) FROM tied
"""
ORACLES["learned_sentences"] = SPLIT + f"""
, ended AS (
  SELECT p.doc_id, p.tok, p.i, CASE WHEN p.following IS NULL THEN false WHEN regexp_matches(body, '[!?]$') THEN true WHEN NOT stop THEN false WHEN t.type IS NOT NULL THEN false
    WHEN s.type IS NOT NULL OR regexp_matches(body, '^\\p{{L}}\\.$') THEN {_UPPER.format("p.following")} AND p.next IN (SELECT type FROM starters)
    ELSE {_UPPER.format("p.following")} OR p.type <> '##number##' END AS over
  FROM pairs p LEFT JOIN tied t ON t.type = p.type AND t.next = p.next LEFT JOIN short s ON s.type = p.type
), placed AS (SELECT doc_id, tok, i, (coalesce(sum(over::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1)::INT AS place FROM ended)
SELECT doc_id, place, string_agg(tok, ' ' ORDER BY i) AS sentence FROM placed GROUP BY ALL
"""

ORACLES["greedy_chunks"] = f"""
WITH RECURSIVE s AS (SELECT doc_id, {sentences("text")} AS p FROM documents),
fold AS (
  SELECT doc_id, p, 1 AS i, 0 AS chunk, p[1] AS text, length(p[1]) + 1 AS size FROM s WHERE len(p) > 0
  UNION ALL
  SELECT doc_id, p, i + 1, CASE WHEN size + length(p[i + 1]) > 3000 THEN chunk + 1 ELSE chunk END,
         CASE WHEN size + length(p[i + 1]) > 3000 THEN p[i + 1] ELSE text || ' ' || p[i + 1] END,
         CASE WHEN size + length(p[i + 1]) > 3000 THEN length(p[i + 1]) ELSE size + length(p[i + 1]) + 1 END
  FROM fold WHERE i < len(p)
)
SELECT doc_id, chunk::INT AS chunk, arg_max(text, i) AS text FROM fold GROUP BY doc_id, chunk
"""

PARTS = f"""
WITH parts AS (
  SELECT doc_id, coalesce(text, '') AS body, {trim_all("coalesce(text, '')")} AS bare,
         regexp_extract_all(lower(coalesce(text, '')), {q(WORD)}) AS w FROM documents
), grams AS (
  SELECT doc_id, CASE WHEN len(w) < 3 THEN [] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END AS g FROM parts
), lines AS (
  SELECT doc_id, list_filter(list_transform(string_split(body, chr(10)), lambda s: {trim_all("s")}), lambda s: s <> '') AS l FROM parts
)
"""


def top(table: str, column: str) -> str:
    return f"""(SELECT doc_id, v AS value, n::INT AS n FROM (
      SELECT doc_id, v, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, v) AS r FROM (SELECT doc_id, unnest({column}) AS v FROM {table}) GROUP BY doc_id, v
    ) WHERE r = 1)"""


ORACLES["doc_quality"] = f"""
{PARTS}, counted AS (
  SELECT p.doc_id, length(bare) AS text_length, {" + ".join(f"regexp_matches(lower(body), {q(x)})::INT" for x in domains.SCAN_PATTERNS)} AS artifacts,
         len(w)::INT AS total_words, len(list_distinct(w))::INT AS unique_words,
         len(list_filter(w, lambda x: length(x) > 2 AND x NOT IN ({", ".join(map(q, domains.FILLER_WORDS))})))::INT AS meaningful_words,
         coalesce(tw.n, 0) AS wn, coalesce(tp.n, 0) AS pn, len(g) AS gn, coalesce(tl.n, 0) AS ln, len(l) AS ll,
         regexp_matches(bare, '^[^\\p{{L}}\\p{{N}}_]*$') OR regexp_matches(bare, '^\\d+$') OR regexp_matches(bare, '^[a-z\\s]*$') OR regexp_matches(bare, '^[A-Z\\s]*$') AS odd
  FROM parts p JOIN grams USING (doc_id) JOIN lines USING (doc_id)
  LEFT JOIN {top("parts", "w")} tw USING (doc_id) LEFT JOIN {top("grams", "g")} tp USING (doc_id) LEFT JOIN {top("lines", "l")} tl USING (doc_id)
), flagged AS (
  SELECT *, text_length < {domains.MIN_CHARS} AS too_short, artifacts > 0 OR (ln > 3 AND ln::DOUBLE / nullif(ll, 0) > 0.6::DOUBLE) AS has_artifacts,
         total_words < {domains.MIN_WORDS} OR unique_words < {domains.MIN_UNIQUE} OR meaningful_words < 3 OR odd AS not_meaningful,
         {ratio("wn", "total_words")} > {domains.MAX_REPETITION}::DOUBLE OR {ratio("pn", "gn")} > 0.5::DOUBLE AS repetitive
  FROM counted
)
SELECT doc_id, text_length::INT AS text_length, artifacts::INT AS artifacts, total_words, unique_words, meaningful_words,
       round_even({ratio("unique_words", "total_words")}, 6) AS word_diversity,
       round_even(CASE WHEN total_words = 0 THEN 1.0 ELSE (total_words - meaningful_words)::DOUBLE / total_words END, 6) AS filler_ratio,
       round_even({ratio("wn", "total_words")}, 6) AS repetition_ratio, round_even({ratio("pn", "gn")}, 6) AS phrase_ratio,
       too_short, coalesce(has_artifacts, false) AS has_artifacts, not_meaningful, repetitive,
       round_even((CASE WHEN too_short THEN 0.1 ELSE 1 END)::DOUBLE * (CASE WHEN has_artifacts THEN 0.2 ELSE 1 END)::DOUBLE * (CASE WHEN not_meaningful THEN 0.3 ELSE 1 END)::DOUBLE
             * (CASE WHEN repetitive THEN 0.4 ELSE 1 END)::DOUBLE, 6) AS quality_score,
       NOT (too_short OR coalesce(has_artifacts, false) OR not_meaningful OR repetitive) AS is_quality
FROM flagged
"""
ORACLES["quality_gate"] = f"""
WITH checked AS ({ORACLES["doc_quality"]})
SELECT CASE WHEN (length(trim(coalesce(text, ''))) < 200 OR contains(lower(text), 'scanned by')) AND NOT is_quality THEN 'skipped' ELSE 'pending' END AS status, count(*) AS n
FROM documents JOIN checked USING (doc_id) GROUP BY 1
"""
ORACLES["word_repetition"] = f"""
{PARTS} SELECT doc_id, len(w)::INT AS total, value, coalesce(n, 0)::INT AS n, round_even({ratio("coalesce(n, 0)", "len(w)")}, 6) AS ratio
FROM parts LEFT JOIN {top("parts", "w")} USING (doc_id)
"""
ORACLES["trigram_repetition"] = f"""
{PARTS} SELECT doc_id, len(g)::INT AS total, value, coalesce(n, 0)::INT AS n, round_even({ratio("coalesce(n, 0)", "len(g)")}, 6) AS ratio
FROM grams LEFT JOIN {top("grams", "g")} USING (doc_id)
"""


def trimmed_lines(source: str) -> str:
    return f"""
SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM (
  SELECT *, count(*) OVER (PARTITION BY doc_id, bare) AS n, row_number() OVER (PARTITION BY doc_id, bare ORDER BY i) AS r
  FROM (SELECT doc_id, line, i, {trim_all("line")} AS bare FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {source}))
) WHERE length(bare) <= 10 OR n <= 3 OR r <= 2 GROUP BY doc_id
"""


ORACLES["repeated_line_trim"] = trimmed_lines("(SELECT doc_id, coalesce(text, '') AS text FROM documents)")


def reduced(x: str) -> str:
    x = rx(x, r"\n\s*\n\s*\n+", "\n\n")
    x = rx(x, r"[ \t]+", " ")
    x = rx(x, r"\n[ \t]+", "\n")
    for p in domains.BOILERPLATE:
        x = rx(x, f"(?i){p}", "")
    return x


def short_phrases(x: str) -> str:
    x = rx(x, r"(?i)WHEREAS,?\s+", "WHEREAS ")
    x = rx(x, r"(?i)NOW,?\s+THEREFORE,?\s+", "NOW THEREFORE ")
    x = rx(x, r"(?i)IN\s+WITNESS\s+WHEREOF[^.]*\.?", "IN WITNESS WHEREOF...")
    return rx(rx(x, r"\n\s*\n\s*\n+", "\n\n"), r"^\s+|\s+$", "")


ORACLES["boilerplate_reduce"] = f"""
WITH plain AS (SELECT doc_id, {reduced("coalesce(text, '')")} AS text FROM documents), kept AS ({trimmed_lines("plain")})
SELECT doc_id, {short_phrases("text")} AS text FROM kept
"""

KEYS = ("the", "with", "que", "der", "thion")
ORACLES["key_sentences"] = f"""
WITH s AS (SELECT doc_id, {sentences("text")} AS p FROM documents),
each AS (SELECT doc_id, unnest(p) AS sentence, generate_subscripts(p, 1) AS i FROM s),
scored AS (SELECT *, (CASE WHEN n > 1 THEN n * 1.5::DOUBLE ELSE n END) + CASE WHEN regexp_matches(sentence, '\\p{{Nd}}') THEN 0.5 ELSE 0 END AS score
  FROM (SELECT *, {any_of("lower(sentence)", KEYS)}::DOUBLE AS n FROM each)),
best AS (SELECT doc_id, sentence, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) - 1 AS place FROM scored WHERE score > 0)
SELECT doc_id, place::INT AS place, sentence FROM best WHERE place < 10
UNION ALL SELECT doc_id, (i - 1)::INT, sentence FROM each WHERE i <= 3 AND doc_id NOT IN (SELECT doc_id FROM best)
"""


def evidence(text: str, words: str) -> str:
    """SQL for the evidence sentence of a text under a list of words."""
    parts = f"list_filter(list_transform(string_split({text}, '.'), lambda s: {trim_all('s')}), lambda s: s <> '')"
    strong = f"list_filter({parts}, lambda s: len(list_filter({words}, lambda k: contains(lower(s), k))) >= 2)[1]"
    weak = f"list_filter({parts}, lambda s: length(s) > 20 AND len(list_filter({words}[1:3], lambda k: contains(lower(s), k))) >= 1)[1]"
    return f"coalesce({strong}, {weak}, '')"


def cut(x: str, limit: int = 200, keep: int = 197) -> str:
    return f"CASE WHEN length({x}) > {limit} THEN left({x}, {keep}) || '...' ELSE {x} END"


ISSUE_ROWS = "(VALUES " + ", ".join(f"({q(n)}, {text_list(ws)})" for n, ws in ISSUES) + ") AS issues(issue_type, words)"
ORACLES["evidence_sentence"] = f"""
SELECT doc_id, issue_type, {cut("e")} AS evidence FROM (SELECT doc_id, issue_type, {evidence("text", "words")} AS e FROM documents, {ISSUE_ROWS}) WHERE e <> ''
"""


def length_bonus(kind: str, n: str, pages: str = "0") -> str:
    return {
        "contract_agreements": f"CASE WHEN {pages} > 200 THEN 3.0 WHEN {pages} > 100 THEN 1.0 WHEN {n} > 50000 THEN 1.5 WHEN {n} > 20000 THEN 0.5 ELSE -1.0 END",
        "correspondence": f"CASE WHEN {n} BETWEEN 500 AND 8000 THEN 1.0 WHEN {n} > 15000 THEN -0.3 ELSE 0.2 END",
        "meeting_minutes": f"CASE WHEN {n} BETWEEN 2000 AND 15000 THEN 0.8 WHEN {n} < 1000 THEN -0.5 ELSE 0 END",
        "technical_drawings": f"CASE WHEN {n} < 2000 THEN 0.5 ELSE 0 END",
        "progress_reports": f"CASE WHEN {n} BETWEEN 3000 AND 12000 THEN 0.6 ELSE 0 END",
    }.get(kind, "0")


def typed(source: str, names: bool) -> str:
    """SQL for typed rows of source(text, and stem when names count)."""
    scores = []
    for kind, (_, words, files) in domains.DOCUMENT_TYPES.items():
        found = " + ".join(f"regexp_matches(text, {q('(?i)' + p)})::INT" for p in domains.DOCUMENT_PATTERNS[kind])
        file = f" + 2 * {any_of('stem', files)}" if names else ""
        scores.append(f"round_even(({any_of('lower(text)', words)} + 3 * ({found}){file} + ({length_bonus(kind, 'length(text)')}))::DOUBLE, 4) AS score_{kind}")
    kinds = list(domains.DOCUMENT_TYPES)
    ranked = "list_reverse_sort([" + ", ".join(f"{{'score': score_{k}, 'priority': {domains.DOCUMENT_TYPES[k][0]}, 'kind': {q(k)}}}" for k in kinds) + "])"
    return f"""
  SELECT *, CASE WHEN confidence < 0.6::DOUBLE THEN 'unknown' WHEN r[1].score <= 0 THEN 'others' ELSE r[1].kind END AS doc_type FROM (
    SELECT *, round_even(CASE WHEN r[1].score <= 0 THEN 0.4::DOUBLE ELSE least(0.95::DOUBLE, least(0.9::DOUBLE, 0.4::DOUBLE + r[1].score * 0.1::DOUBLE)
      + CASE WHEN r[1].score > r[2].score THEN least(0.2::DOUBLE, (r[1].score - r[2].score) * 0.05::DOUBLE) ELSE 0 END) END, 6) AS confidence
    FROM (SELECT *, {ranked} AS r FROM (SELECT *, {", ".join(scores)} FROM {source})))
"""


_COLUMNS = ", ".join(f"score_{k}" for k in domains.DOCUMENT_TYPES)
ORACLES["doctype_scores"] = f"SELECT doc_id, doc_type, confidence, {_COLUMNS} FROM ({typed('(SELECT doc_id, coalesce(text, $$$$) AS text FROM documents)', False)})"
_PAGES = "(SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text, lower(regexp_replace(list_last(string_split(url, '/')), '\\.[^.]*$', '')) AS stem FROM pages)"
ORACLES["page_types"] = f"SELECT doc_type, count(*) AS n, round_even(avg(confidence), 4) AS confidence FROM ({typed(_PAGES, True)}) GROUP BY doc_type"
ORACLES["text_facts"] = f"""
SELECT doc_id, CASE WHEN length(text) < 1000 THEN 'short' WHEN length(text) < 3000 THEN 'medium' WHEN length(text) < 8000 THEN 'long' ELSE 'very_long' END AS bucket,
       left(md5(text), 16) AS hash, length(text) < 100 OR length(regexp_replace(text, '[ \\n\\t]', '', 'g')) < 50 AS scanned, {any_of("lower(text)", domains.GENERIC_PHRASES)}::INT AS generic,
       len(list_distinct(list_transform(list_filter(string_split(trim({rx("lower(text)", SPACE + "+", " ")}), ' '), lambda w: length(w) >= 4 AND w NOT IN ({", ".join(map(q, domains.KEYWORD_STOPS))})),
           lambda w: trim(w, {q('.,!?;:"()[]{}')}))))::INT AS key_words,
       CASE WHEN length(text) > 150 THEN string_split(text, '. ')[1] || '...' ELSE text END AS shown
FROM documents
"""

# ---- labels

RAW = "(SELECT o_orderkey, CASE o_orderkey % {n} {whens} END AS category FROM orders)".format(
    n=len(RAW_LABELS), whens=" ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(RAW_LABELS))
)
VARIANTS = "(VALUES " + ", ".join(f"({q(v)}, {q(c)})" for c, vs in domains.CATEGORY_VARIANTS.items() for v in vs) + ") AS variants(variant, known)"
STANDARD = case([(f"lower(trim(category)) = {q(c.lower())}", q(c)) for c in domains.CATEGORIES], "NULL")


def named_categories(source: str) -> str:
    return f"""
SELECT s.*, CASE WHEN coalesce(trim(category), '') = '' THEN NULL WHEN trim(category) IN ({", ".join(map(q, domains.CATEGORIES))}) THEN trim(category)
         WHEN lower(trim(category)) IN ({", ".join(map(q, domains.MISUSED_ISSUES))}) THEN 'Others' ELSE coalesce(known, {STANDARD}, 'Others') END AS category_norm,
       CASE WHEN coalesce(trim(category), '') = '' THEN 'rejected' WHEN trim(category) IN ({", ".join(map(q, domains.CATEGORIES))}) THEN 'exact'
         WHEN lower(trim(category)) IN ({", ".join(map(q, domains.MISUSED_ISSUES))}) THEN 'issue_type' ELSE 'normalized' END AS status,
       (CASE WHEN coalesce(trim(category), '') = '' THEN 0 WHEN trim(category) IN ({", ".join(map(q, domains.CATEGORIES))}) THEN 1
         WHEN lower(trim(category)) IN ({", ".join(map(q, domains.MISUSED_ISSUES))}) THEN 0.7 WHEN known IS NOT NULL OR ({STANDARD}) IS NOT NULL THEN 0.95 ELSE 0.5 END)::DOUBLE AS match_confidence
FROM {source} s LEFT JOIN {VARIANTS} ON lower(trim(category)) = variant
"""


ORACLES["category_normalize"] = named_categories(RAW)
ORACLES["category_lists"] = f"""
WITH lists AS (SELECT o_orderkey // 3 AS k, string_agg(category, ', ' ORDER BY category) AS l FROM {RAW} GROUP BY 1),
each AS (SELECT k, trim(unnest(string_split(l, ','))) AS category, generate_subscripts(string_split(l, ','), 1) AS i FROM lists),
named AS ({named_categories("(SELECT * FROM each WHERE category <> '')")})
SELECT k, list(category_norm ORDER BY i) AS categories FROM (SELECT k, category_norm, min(i) AS i FROM named GROUP BY ALL) GROUP BY k
"""
ORACLES["category_report"] = f"""
SELECT count(*) AS rows, count(*) FILTER (category IS DISTINCT FROM category_norm) AS changed, count(*) FILTER (status = 'issue_type') AS misused, count(*) FILTER (match_confidence = 0.5 OR status = 'rejected') AS unknown
FROM ({named_categories(RAW)})
"""
_ISSUE = "(SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Utility Shifting' WHEN 1 THEN ' Trial patch' WHEN 2 THEN 'a  b' WHEN 3 THEN 'Extension of time proposal' ELSE p_name END AS issue_type FROM part)"
_KNOWN = case([(f"lower(trim(issue_type)) = {q(v)}", q(i)) for v, i in domains.ISSUE_VARIANTS.items()], "NULL")
ORACLES["issue_normalize"] = f"""
WITH s AS (SELECT *, trim(issue_type) AS t, {rx("trim(issue_type)", SPACE + "+", " ")} AS sq, {_KNOWN} AS known FROM {_ISSUE})
SELECT p_partkey, issue_type, coalesce(known, CASE WHEN sq <> t THEN sq WHEN t <> issue_type THEN t ELSE issue_type END) AS issue_norm,
       CASE WHEN known IS NOT NULL OR sq <> t OR t <> issue_type THEN 'normalized' ELSE 'exact' END AS issue_status,
       (CASE WHEN known IS NOT NULL THEN 0.95 WHEN sq <> t THEN 0.9 WHEN t <> issue_type THEN 0.95 ELSE 1 END)::DOUBLE AS issue_confidence
FROM s
"""

TRAINING = "(SELECT p_brand AS issue_type, CASE WHEN p_size % 5 = 0 THEN p_type || ', Promo' ELSE p_type END AS category FROM part)"
EDGES = f"(SELECT issue_type, category, count(*) AS n FROM (SELECT issue_type, trim(unnest(string_split(category, ','))) AS category FROM {TRAINING}) GROUP BY ALL)"
COUNTS = f"(SELECT issue_type, count(*) AS n FROM {TRAINING} GROUP BY ALL)"
PAIRS = "(SELECT l_orderkey AS doc_id, p_brand AS issue_type, max(1 - l_discount) AS confidence, min(p_name) AS evidence FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
ORACLES["issue_category_edges"] = f"SELECT * FROM {EDGES}"
ORACLES["mapping_stats"] = f"""
SELECT count(*) AS issues, round_even(avg(k), 4) AS avg_categories, max(k) AS max_categories, min(k) AS min_categories, count(*) FILTER (k = 1) AS single, count(*) FILTER (k > 1) AS multiple
FROM (SELECT issue_type, count(DISTINCT category) AS k FROM {EDGES} GROUP BY ALL)
"""
ORACLES["unified_mapping_override"] = f"""
WITH own AS (SELECT issue_type, list(DISTINCT category ORDER BY category) AS trained FROM {EDGES} GROUP BY ALL), given AS (SELECT DISTINCT p_brand AS issue_type, ['Standard', 'Extra'] AS given FROM part WHERE p_size = 1)
SELECT issue_type, coalesce(given, trained) AS categories, CASE WHEN given IS NOT NULL THEN 'explicit' ELSE 'training' END AS origin FROM own FULL JOIN given USING (issue_type)
"""
ORACLES["map_issues"] = f"""
WITH scored AS (
  SELECT doc_id, category, issue_type, confidence, evidence, confidence * least(1.0::DOUBLE, 0.7::DOUBLE + least(0.3::DOUBLE, c.n::DOUBLE / 100)) AS score FROM {PAIRS} JOIN {EDGES} e USING (issue_type) JOIN {COUNTS} c USING (issue_type)
), said AS (
  SELECT doc_id, category, string_agg(evidence, '; ' ORDER BY c DESC, i) AS evidence FROM (
    SELECT doc_id, category, evidence, arg_max(confidence, (confidence, -rank)) AS c, min(rank) AS i FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY confidence DESC, issue_type, evidence) AS rank FROM scored) GROUP BY ALL) GROUP BY ALL
)
SELECT doc_id, category, round_even(max(score), 6) AS confidence, list(DISTINCT issue_type ORDER BY issue_type) AS issue_types, count(*) AS n_sources, any_value(said.evidence) AS evidence
FROM scored JOIN said USING (doc_id, category) GROUP BY doc_id, category
"""
ORACLES["reverse_mapping"] = f"SELECT category, list(DISTINCT issue_type ORDER BY issue_type) AS issues, count(DISTINCT issue_type) AS n_issues FROM {EDGES} GROUP BY ALL"
ORACLES["pair_strength"] = f"SELECT issue_type, category, n, round_even(n::DOUBLE / sum(n) OVER (PARTITION BY issue_type), 3) AS strength FROM {EDGES}"
ORACLES["export_confidence"] = f"""
SELECT issue_type, sum(n)::BIGINT AS issue_n, round_even(least(sum(n)::DOUBLE / greatest((SELECT sum(n) FROM {EDGES}) * 0.01::DOUBLE, 1.0), 1.0), 3) AS confidence FROM {EDGES} GROUP BY ALL
"""
ORACLES["category_distribution"] = f"""
SELECT category, sum(n)::BIGINT AS n, round_even(100 * sum(n)::DOUBLE / (SELECT sum(n) FROM {EDGES}), 1) AS percent FROM {EDGES} GROUP BY category ORDER BY n DESC, category LIMIT 20
"""
ORACLES["issue_category_ids"] = f"""
SELECT issue_type, category, 'issue_type_' || dense_rank() OVER (ORDER BY issue_type) AS issue_type_id, 'category_' || dense_rank() OVER (ORDER BY category) AS category_id FROM {EDGES}
"""


def level(n: str) -> str:
    return case([(f"{n} >= {least}", q(name)) for name, least, _ in reversed(domains.SUFFICIENCY[1:])], q("critical"))


def multiplier(n: str) -> str:
    return f"({case([(f'{n} >= {least}', str(m)) for _, least, m in reversed(domains.SUFFICIENCY[1:])], '0.5')})::DOUBLE"


ORACLES["sufficiency_levels"] = f"""
SELECT {level("n")} AS level, {multiplier("n")} AS multiplier, count(*) AS orders FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1, 2
"""
ORACLES["sufficiency_report"] = f"""
SELECT count(*) AS labels, round_even(avg(n), 4) AS mean, min(n) AS least, max(n) AS most, round_even(100 * (count(*) FILTER ({level("n")} = 'critical'))::DOUBLE / count(*), 2) AS critical_percent,
       round_even(100 * (count(*) FILTER ({level("n")} = 'warning'))::DOUBLE / count(*), 2) AS warning_percent FROM {COUNTS}
"""
ORACLES["priority_items"] = f"SELECT issue_type, n, greatest(100 - n, 0)::BIGINT AS needed FROM {COUNTS} ORDER BY n, issue_type LIMIT 10"
ORACLES["sufficiency_adjust"] = f"""
SELECT c_custkey, c_nationkey AS label, c_acctbal / 10000 * {multiplier("coalesce(n, 0)")} AS confidence, coalesce(n, 0)::BIGINT AS training_samples, c_acctbal / 10000 AS original_confidence,
       {level("coalesce(n, 0)")} AS data_sufficiency, {level("coalesce(n, 0)")} IN ('critical', 'warning') AS warning
FROM customer LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY ALL) ON c_nationkey = s_nationkey
"""
ORACLES["mode_category"] = f"""
SELECT issue_type, category FROM (SELECT issue_type, category, row_number() OVER (PARTITION BY issue_type ORDER BY count(*) DESC, category) AS r FROM {TRAINING} GROUP BY issue_type, category) WHERE r = 1
"""
ORACLES["stratified_split"] = """
SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY md5(p_partkey::VARCHAR || '|42'), p_partkey) <= greatest(1, floor(count(*) OVER (PARTITION BY p_brand) * 0.2::DOUBLE)) AS is_validation FROM part
"""
ORACLES["validate_labels"] = """
WITH said AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN lower(o_orderpriority) ELSE o_orderpriority || '?' END AS label FROM orders),
names AS (SELECT DISTINCT o_orderpriority AS name FROM orders)
SELECT o_orderkey, label, coalesce(a.name, b.name) AS valid, CASE WHEN a.name IS NOT NULL THEN 'valid' WHEN b.name IS NOT NULL THEN 'case' ELSE 'rejected' END AS validity,
       (CASE WHEN a.name IS NOT NULL THEN 1 WHEN b.name IS NOT NULL THEN 0.95 ELSE 0 END)::DOUBLE AS match_confidence
FROM said LEFT JOIN names a ON label = a.name LEFT JOIN (SELECT lower(name) AS low, min(name) AS name FROM names GROUP BY 1) b ON lower(label) = low
"""
OLD = "(SELECT p_name AS issue_type, list(DISTINCT p_type ORDER BY p_type) AS o FROM part WHERE p_size <= 25 GROUP BY ALL)"
NEW = "(SELECT p_name AS issue_type, list(DISTINCT p_type ORDER BY p_type) AS n FROM part WHERE p_size >= 20 GROUP BY ALL)"
ORACLES["mapping_diff"] = f"""
SELECT issue_type, CASE WHEN o IS NULL THEN 'NEW' WHEN n IS NULL THEN 'ONLY_IN_CURRENT' WHEN o = n THEN 'SAME' ELSE 'DIFFERENT' END AS state,
       array_to_string(list_filter(coalesce(n, []), lambda x: NOT list_contains(coalesce(o, []), x)), ',') AS added,
       array_to_string(list_filter(coalesce(o, []), lambda x: NOT list_contains(coalesce(n, []), x)), ',') AS removed FROM {OLD} FULL JOIN {NEW} USING (issue_type)
"""
ORACLES["mapping_merge"] = "SELECT p_name AS issue_type, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS categories FROM part GROUP BY ALL"
ORACLES["usage_compare"] = """
SELECT p_type AS category, count(DISTINCT CASE WHEN p_size <= 25 THEN p_name END) AS n_current, count(DISTINCT CASE WHEN p_size >= 20 THEN p_name END) AS n_new,
       count(DISTINCT CASE WHEN p_size >= 20 THEN p_name END) - count(DISTINCT CASE WHEN p_size <= 25 THEN p_name END) AS difference FROM part GROUP BY ALL
"""
ORACLES["coverage_report"] = """
WITH truth AS (SELECT DISTINCT l_suppkey AS file_name, p_brand || '/' || p_type AS issue_type FROM lineitem JOIN part ON l_partkey = p_partkey),
mapped AS (SELECT DISTINCT p_brand || '/' || p_type AS issue_type, true AS there FROM part WHERE p_size > 10 AND p_retailprice < 950)
SELECT file_name, count(*) AS issues, count(*) FILTER (there) AS covered, count(*) - count(*) FILTER (there) AS missing, round_even(100 * (count(*) FILTER (there))::DOUBLE / count(*), 2) AS coverage
FROM truth LEFT JOIN mapped USING (issue_type) GROUP BY file_name
"""
ORACLES["missing_issues"] = """
SELECT event_type AS issue_type, count(DISTINCT user_id) AS files, array_to_string(list(DISTINCT user_id ORDER BY user_id), ',') AS file_names FROM events
WHERE event_type NOT IN (SELECT event_type FROM events WHERE value > 350) GROUP BY ALL
"""
ORACLES["unpivot_truth"] = "SELECT DISTINCT doc_id::VARCHAR AS file_name, unnest([quality::VARCHAR, toxic::VARCHAR]) AS category FROM labels"

# ---- evaluation

JUDGED = """(
  SELECT doc_id, list_filter([CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 0 THEN 'junk' END], lambda x: x IS NOT NULL) AS t,
         list_filter([CASE WHEN length(text) >= 600 THEN 'quality' END, CASE WHEN contains(lower(text), 'idiot') OR contains(lower(text), 'clown') THEN 'toxic' END,
           CASE WHEN contains(lower(text), '!!') OR contains(lower(text), ' | ') THEN 'junk' END], lambda x: x IS NOT NULL) AS p
  FROM documents JOIN labels USING (doc_id))"""


def measured(source: str) -> str:
    p, r = ratio("tp", "tp + fp"), ratio("tp", "tp + fn")
    return f"""
SELECT *, round_even({p}, 4) AS precision, round_even({r}, 4) AS recall, round_even({ratio(f"2 * {p} * {r}", f"{p} + {r}")}, 4) AS f1_score,
       (fp + fn = 0)::INT::DOUBLE AS exact_match, round_even(CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fp + fn) END, 4) AS jaccard_similarity
FROM (SELECT *, len(list_intersect(t, p)) AS tp, len(list_filter(p, lambda x: NOT list_contains(t, x))) AS fp, len(list_filter(t, lambda x: NOT list_contains(p, x))) AS fn FROM {source})
"""


def batch(source: str, by: str = "") -> str:
    p, r = ratio("sum(tp)", "sum(tp) + sum(fp)"), ratio("sum(tp)", "sum(tp) + sum(fn)")
    return f"""
SELECT {by} count(*) AS files, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round_even(avg(precision), 4) AS macro_precision, round_even(avg(recall), 4) AS macro_recall,
       round_even(avg(f1_score), 4) AS macro_f1, round_even(avg(exact_match), 4) AS exact_match_rate, round_even(avg(jaccard_similarity), 4) AS mean_jaccard, count(*) FILTER (exact_match = 1) AS perfect,
       round_even({p}, 4) AS micro_precision, round_even({r}, 4) AS micro_recall, round_even({ratio(f"2 * {p} * {r}", f"{p} + {r}")}, 4) AS micro_f1
FROM ({measured(source)}) {"GROUP BY ALL" if by else ""}
"""


ORACLES["doc_metrics"] = f"""
SELECT doc_id, tp, fp, fn, precision, recall, f1_score, exact_match, jaccard_similarity, array_to_string(list_sort(list_filter(t, lambda x: NOT list_contains(p, x))), ',') AS missed,
       array_to_string(list_sort(list_filter(p, lambda x: NOT list_contains(t, x))), ',') AS extra FROM ({measured(JUDGED)})
"""
ORACLES["batch_metrics"] = batch(JUDGED)
_EACH = f"""(SELECT category, count(*) FILTER (a AND b) AS tp, count(*) FILTER (NOT a AND b) AS fp, count(*) FILTER (a AND NOT b) AS fn, count(*) AS appearances, count(*) FILTER (a) AS support
  FROM (SELECT category, list_contains(t, category) AS a, list_contains(p, category) AS b FROM (SELECT t, p, unnest(list_distinct(list_concat(t, p))) AS category FROM {JUDGED})) GROUP BY category)"""
_P, _R = ratio("tp", "tp + fp"), ratio("tp", "tp + fn")
ORACLES["category_metrics"] = f"SELECT *, round_even({_P}, 4) AS precision, round_even({_R}, 4) AS recall, round_even({ratio(f'2 * {_P} * {_R}', f'{_P} + {_R}')}, 4) AS f1_score FROM {_EACH}"
ORACLES["approach_compare"] = f"""
WITH each AS ({batch(f"(SELECT 'rules' AS approach, * FROM {JUDGED} UNION ALL SELECT 'always', doc_id, t, ['quality'] FROM {JUDGED})", "approach,")}),
long AS (UNPIVOT (SELECT approach, micro_precision, micro_recall, micro_f1, exact_match_rate, mean_jaccard FROM each) ON COLUMNS(* EXCLUDE approach) INTO NAME metric VALUE value)
SELECT metric, max(value) AS value, min(approach) FILTER (value = m) AS best_approach FROM (SELECT *, max(value) OVER (PARTITION BY metric) AS m FROM long) GROUP BY metric
"""
ORACLES["confusion_accuracy"] = f"""
WITH s AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum((SELECT count(*) FROM {JUDGED}) - tp - fp - fn)::BIGINT AS tn FROM {_EACH})
SELECT *, round_even({_P}, 4) AS precision, round_even({_R}, 4) AS recall, round_even({ratio(f"2 * {_P} * {_R}", f"{_P} + {_R}")}, 4) AS f1_score, round_even({ratio("tp + tn", "tp + tn + fp + fn")}, 4) AS accuracy FROM s
"""
ORACLES["provider_share"] = "SELECT event_type, count(*) AS n, round_even(100 * count(*)::DOUBLE / (SELECT count(*) FROM events), 2) AS percent FROM events GROUP BY ALL"
ORACLES["best_of_approaches"] = """
WITH r AS (SELECT user_id AS doc_id, event_type AS category, value AS confidence, CASE event_id % 3 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'pure' ELSE 'rules' END AS approach FROM events)
SELECT doc_id, category, confidence, min(approach) AS approach FROM r WHERE (doc_id, category, confidence) IN (SELECT doc_id, category, max(confidence) FROM r GROUP BY ALL) GROUP BY ALL
"""
_LABELS = "(VALUES " + ", ".join(f"({q(i)}, {q(c)})" for i, c in LABELS) + ") AS l(issue_type, category)"
ORACLES["keyword_baseline"] = f"""
SELECT DISTINCT doc_id, issue_type, category FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), {q(WORD)}))) AS word FROM documents)
JOIN (SELECT issue_type, category, unnest(regexp_extract_all(lower(issue_type), {q(WORD)})) AS word FROM {_LABELS}) USING (word)
"""

# ---- vectors and search

NEAR = """(
  SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank, round_even(1 / (1 + distance), 6) AS similarity FROM (
    SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))), 6) AS distance
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0))"""
ORACLES["knn_topk"] = f"SELECT query_id, rank, id, distance, similarity FROM {NEAR} WHERE rank <= 12"
ORACLES["ivf_topk"] = ORACLES["knn_topk"]
ORACLES["knn_threshold"] = f"SELECT query_id, rank, id, distance, similarity FROM {NEAR} WHERE rank <= 12 AND similarity >= 0.45"
ORACLES["near_duplicate_vectors"] = """
WITH base AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
every AS (SELECT * FROM base UNION ALL SELECT vec_id + 1000000000, list_transform(v, lambda x, i: x * (1 + ((i - 1) % 7 - 3) * 0.05::DOUBLE)) FROM base),
named AS (SELECT min(vec_id) AS id, v FROM every GROUP BY v)
SELECT a.id AS a, b.id AS b, round_even(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM named a JOIN named b ON a.id < b.id WHERE round_even(list_cosine_similarity(a.v, b.v), 6) >= 0.95
UNION ALL SELECT id, vec_id, 1.0 FROM every JOIN named USING (v) WHERE vec_id <> id
"""
ORACLES["near_duplicate_vectors_exact"] = ORACLES["near_duplicate_vectors"]


def votes(most: int) -> str:
    return f"""(
  SELECT query_id, label, round_even(c * (1 - (place - 1) * 0.03::DOUBLE), 6) AS confidence, votes, place FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, label)::INT AS place FROM (
      SELECT query_id, label, CASE WHEN count(*) > 3 THEN least(1.0, max(similarity) * 1.2::DOUBLE) ELSE max(similarity) END AS c, count(*) AS votes
      FROM {NEAR} JOIN embeddings ON id = vec_id WHERE rank <= 12 GROUP BY query_id, label)) WHERE place <= {most})"""


ORACLES["knn_label_vote"] = f"SELECT * FROM {votes(5)}"
ORACLES["divergence_filter"] = f"""
WITH v AS (SELECT query_id AS doc_id, label::VARCHAR AS issue_type, confidence, count(*) OVER w AS n, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, label::VARCHAR) AS r FROM {votes(10)} WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT *, greatest(1, floor(n * 0.2::DOUBLE)) AS k FROM v),
d AS (SELECT *, round_even(avg(confidence) FILTER (r <= k) OVER (PARTITION BY doc_id) - avg(confidence) FILTER (r > n - k) OVER (PARTITION BY doc_id), 6) AS divergence FROM f)
SELECT doc_id, issue_type, confidence, divergence FROM d WHERE n <= 1 OR divergence < 0.1 OR r <= greatest(1, floor(n * 0.4::DOUBLE))
"""
_SOURCE = "CASE length(issue_type) % 3 WHEN 0 THEN 'llm_validation' WHEN 1 THEN 'semantic_search' ELSE 'other' END"
ORACLES["source_priority"] = f"""
SELECT doc_id, issue_type, confidence, source, row_number() OVER (PARTITION BY doc_id ORDER BY CASE source WHEN 'llm_validation' THEN 0 WHEN 'semantic_search' THEN 1 ELSE 2 END, confidence DESC, issue_type)::INT AS place
FROM (SELECT *, {_SOURCE} AS source FROM {PAIRS})
"""
ORACLES["rank_issues"] = f"""
SELECT doc_id, issue_type, rank::INT AS rank, round_even(c, 6) AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS r FROM (
    SELECT *, confidence * (1 - rank * 0.03::DOUBLE) AS c FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, issue_type) - 1 AS rank FROM {PAIRS})) WHERE c >= 0.2::DOUBLE * 0.3::DOUBLE)
WHERE r <= CASE WHEN doc_id % 3000 < 1000 THEN 3 WHEN doc_id % 3000 < 2000 THEN 4 ELSE 5 END
"""
ORACLES["category_merge"] = f"""
WITH semantic AS (SELECT doc_id, category, max(confidence) AS c, list(DISTINCT issue_type) AS s FROM {PAIRS} JOIN {EDGES} USING (issue_type) GROUP BY ALL),
backed AS (SELECT doc_id, category, max(c) AS found FROM (SELECT doc_id, category, c, unnest(s) AS issue_type FROM semantic) SEMI JOIN (SELECT doc_id, issue_type FROM {PAIRS} WHERE confidence >= 0.97) USING (doc_id, issue_type) GROUP BY ALL),
final AS (SELECT l_orderkey AS doc_id, p_type AS category, round_even(min(1 - l_discount), 4) AS given FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT doc_id, category, greatest(given, found) AS confidence, CASE WHEN given IS NULL THEN 'search' WHEN found > given THEN 'raised' ELSE 'final' END AS origin FROM final FULL JOIN backed USING (doc_id, category)
"""
ORACLES["expand_categories"] = f"SELECT doc_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM {PAIRS} JOIN {EDGES} USING (issue_type) GROUP BY doc_id"

# ---- duplicates, fields

_WORDS = lambda c: f"list_distinct(list_transform(list_filter(string_split(trim({rx(f'lower({c})', SPACE + '+', ' ')}), ' '), lambda w: length(w) >= 4 AND w NOT IN ({', '.join(map(q, domains.KEYWORD_STOPS))})), lambda w: trim(w, {q('.,!?;:\"()[]{}')})))"
_OVERLAP = lambda c: f"CASE WHEN len(a.{c}) = 0 OR len(b.{c}) = 0 THEN 0.0 ELSE len(list_intersect(a.{c}, b.{c}))::DOUBLE / len(list_distinct(list_concat(a.{c}, b.{c}))) END"
ORACLES["duplicate_letters"] = f"""
WITH letters AS (
  SELECT doc_id AS id, lang, source || '/' || (n_chars // 10) AS k, DATE '2024-01-01' + (doc_id % 30)::INT AS d, {_WORDS("string_split(text, chr(10))[1]")} AS s, {_WORDS("text")} AS w FROM documents
), firsts AS (SELECT lang, k, min(id) AS first FROM letters GROUP BY ALL),
scored AS (
  SELECT b.id AS original_id, a.id AS new_id, abs(date_diff('day', a.d, b.d)) AS days, {_OVERLAP("s")} AS so, {_OVERLAP("w")} AS wo
  FROM letters a JOIN firsts f USING (lang, k) JOIN letters b ON b.id = f.first WHERE a.id > b.id
)
SELECT original_id, new_id, round_even(40 + CASE WHEN days = 0 THEN 20.0::DOUBLE WHEN days <= 3 THEN (1 - days::DOUBLE / 7) * 20 ELSE 0 END + so * 25 + wo * 15, 4) AS score, 'letter_id_match' AS detection_method FROM scored
"""
_SPAN = "CASE o_orderkey % 5 WHEN 0 THEN o_custkey % 40 || ' months' WHEN 1 THEN '2 Years' WHEN 2 THEN o_custkey % 90 || ' days' WHEN 3 THEN 'soon' ELSE '2 years 6 months' END"
ORACLES["planned_end_date"] = f"""
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN o_orderdate::DATE END AS d, lower({_SPAN}) AS s FROM orders),
n AS (SELECT *, try_cast(regexp_extract(s, '(\\d+)', 1) AS INT) AS n FROM r),
m AS (SELECT *, CASE WHEN contains(s, 'month') THEN n WHEN contains(s, 'year') THEN n * 12 END AS months FROM n),
f AS (SELECT *, (date_trunc('month', d) + to_months(months))::DATE AS first FROM m)
SELECT o_orderkey, CASE WHEN months IS NOT NULL THEN CASE WHEN day(d) <= day(last_day(first)) THEN first + (day(d) - 1)::INT END WHEN contains(s, 'day') THEN d + n END::DATE AS planned_end FROM f
"""
ORACLES["json_fields"] = """
SELECT event_id, CASE WHEN event_id % 4 < 3 THEN json_extract_string(props, '$.k') END AS k, NULL::VARCHAR AS z, (CASE WHEN event_id % 4 < 3 THEN 0.5 ELSE 0 END)::DOUBLE AS completeness FROM events
"""
ORACLES["synonyms"] = """
SELECT o_orderkey, CASE WHEN p IN ('urgent', 'high', 'critical', 'priority', 'immediate', 'asap') THEN 'urgent' WHEN p IN ('routine', 'low', 'minor', 'non-urgent', 'informational') THEN 'routine' ELSE 'normal' END AS urgency
FROM (SELECT o_orderkey, lower(regexp_replace(o_orderpriority, '^[0-9]-', '')) AS p FROM orders)
"""

# ---- the flagship

_QUALITY = ORACLES["doc_quality"]
_N = "(VALUES " + ", ".join(f"({q(n)}, {4 * k + 3})" for k, (n, _) in enumerate(ISSUES)) + ") AS counts(issue_type, issue_n)"
ORACLES["flagship_classify"] = f"""
WITH good AS (SELECT doc_id FROM ({_QUALITY}) WHERE is_quality),
win AS (SELECT doc_id, window_id, text FROM ({WINDOWS} SELECT * FROM windows) SEMI JOIN good USING (doc_id)),
hits AS (SELECT doc_id, window_id, issue_type, round_even(n::DOUBLE / len(words), 6) AS similarity, {evidence("text", "words")} AS raw
  FROM (SELECT *, len(list_filter(words, lambda k: contains(lower(text), k))) AS n FROM win, {ISSUE_ROWS}) WHERE n >= 2),
found AS (SELECT doc_id, window_id, issue_type, similarity, {cut("raw")} AS evidence FROM hits WHERE raw <> ''),
first_said AS (SELECT doc_id, issue_type, evidence, min(window_id) AS w FROM found GROUP BY ALL),
joined AS (SELECT doc_id, issue_type, string_agg(evidence, '; ' ORDER BY w) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, issue_type ORDER BY w) AS r FROM first_said) WHERE r <= 3 GROUP BY ALL),
issues AS (SELECT doc_id, issue_type, CASE WHEN count(*) > 3 THEN least(1.0, max(similarity) * 1.2::DOUBLE) ELSE max(similarity) END AS confidence FROM found GROUP BY ALL),
placed AS (SELECT doc_id, issue_type, evidence, confidence * (1 - (row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, issue_type) - 1) * 0.03::DOUBLE) AS c FROM issues JOIN joined USING (doc_id, issue_type)),
kept AS (SELECT * FROM (SELECT *, c * CASE WHEN {any_of("lower(evidence)", domains.GENERIC_PHRASES)} > 3 THEN 0.8::DOUBLE ELSE 1 END AS confidence FROM placed) WHERE confidence >= 0.2::DOUBLE * 0.3::DOUBLE),
mapped AS (SELECT doc_id, category, max(confidence * least(1.0::DOUBLE, 0.9::DOUBLE + least(0.1::DOUBLE, issue_n::DOUBLE / 100))) AS confidence, count(*) AS n_sources FROM kept JOIN {_LABELS} USING (issue_type) JOIN {_N} USING (issue_type) GROUP BY ALL),
samples AS (SELECT category, sum(issue_n)::BIGINT AS n FROM {_LABELS} JOIN {_N} USING (issue_type) GROUP BY ALL)
SELECT doc_id, category, round_even(confidence * {multiplier("n")}, 6) AS confidence, n_sources, {level("n")} AS data_sufficiency FROM mapped JOIN samples USING (category) WHERE confidence * {multiplier("n")} >= 0.2::DOUBLE
"""
