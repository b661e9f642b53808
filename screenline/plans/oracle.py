r"""The registered queries once more, as SQL for an independent engine.

Written from the description of each operator, not from the Spark code: rules
are a joined table, lists are aggregated or folded, splits are plain window
functions. ``\b`` and ``\w`` are ASCII in that engine; where that matters (a card
or phone next to an accented letter) all letters are turned into ``x`` first,
which leaves digits and separators, the only things those patterns take, alone.
"""

from __future__ import annotations

from screenline import fixed
from screenline.plans.inputs import FIRST_SECOND, SECONDS, TIMELESS
from screenline.plans.queries import FIXED_INTERCEPTS, FIXED_TERMS, USER_RULES


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(texts) -> str:
    return "[" + ", ".join(_s(t) for t in texts) + "]"


def _case(key: str, mapping) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {_s(k)} THEN {v if isinstance(v, int) else _s(v)}" for k, v in mapping.items()) + " END"


def _tidy(text: str) -> str:
    spaces = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    return f"trim(regexp_replace({text}, '{spaces}', ' ', 'g'))"


def _luhn(candidate: str) -> str:
    digits = f"regexp_replace({candidate}, '[ -]', '', 'g')"
    doubled = (f"list_transform(range(1, length({digits}) + 1), lambda i: "
               f"CAST(substr(reverse({digits}), CAST(i AS INT), 1) AS INT) * CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END)")
    return f"list_sum(list_transform({doubled}, lambda d: CASE WHEN d > 9 THEN d - 9 ELSE d END)) % 10 = 0"


def _entity(kind: str, texts: str) -> str:
    return (f"list_transform({texts}, lambda x: {{'type': {_s(kind)}, 'text': x, "
            f"'severity': {fixed.SEVERITY_BY_KIND[kind]}}})")


def _pii(text: str) -> str:
    """CTEs ``<text>`` -> ``pii_found(prompt_id, t, pii, data_leakage_severity)``."""
    return f"""
pii_raw AS (
  SELECT * EXCLUDE (digits_only), regexp_extract_all(t, {_s(fixed.EMAIL_PATTERN)}) AS emails,
    regexp_extract_all(t, {_s('(?i)' + fixed.API_KEY_PATTERN)}) AS keys,
    regexp_extract_all(digits_only, {_s(fixed.GOVERNMENT_ID_PATTERN)}) AS ids,
    list_filter(regexp_extract_all(digits_only, {_s(fixed.CREDIT_CARD_PATTERN)}), lambda x: {_luhn('x')}) AS cards,
    regexp_extract_all(digits_only, {_s(fixed.PHONE_PATTERN)}) AS phones
  FROM (SELECT *, regexp_replace(t, '\\pL', 'x', 'g') AS digits_only FROM {text})),
pii_base AS (
  SELECT *, list_concat(emails, list_concat(keys, list_concat(ids, cards))) AS base FROM pii_raw),
pii_folded AS (
  SELECT *, list_reduce(list_concat([base], list_transform(phones, lambda p: [p])), lambda a, e:
    CASE WHEN len(list_filter(a, lambda x: contains(x, e[1]))) > 0 THEN a ELSE list_concat(a, e) END) AS kept
  FROM pii_base),
pii_listed AS (
  SELECT *, list_concat({_entity('EMAIL', 'emails')}, list_concat({_entity('API_KEY', 'keys')},
    list_concat({_entity('GOVERNMENT_ID', 'ids')}, list_concat({_entity('CREDIT_CARD', 'cards')},
    {_entity('PHONE', 'kept[len(base) + 1:]')})))) AS pii FROM pii_folded),
pii_found AS (
  SELECT *, CASE WHEN len(pii) = 0 THEN 0 ELSE least(100,
    list_max(list_transform(pii, lambda e: e.severity)) + 5 * (len(pii) - 1)) END::INTEGER AS data_leakage_severity
  FROM pii_listed)"""


PROMPTS = f"""
prompts AS (
  SELECT doc_id AS prompt_id, source, lang,
    text || ' ' || ({_list(fixed.PHRASE_BANK)})[1 + doc_id % {len(fixed.PHRASE_BANK)}] AS prompt FROM documents),
texts AS (SELECT *, {_tidy('prompt')} AS t FROM prompts),
low AS (SELECT *, lower(t) AS l FROM texts)"""


def _rules_table(rows) -> str:
    values = ", ".join(f"({i}, {_s(n)}, {_s(p)}, {_s(t)}, {s}, {_s(m)})" for i, (n, p, t, s, m) in enumerate(rows))
    return f"rules(rule_no, name, pattern, threat, severity, message) AS (VALUES {values})"


RULES = f"""
{_rules_table(fixed.RULES)},
hits AS (SELECT p.prompt_id, p.source, p.lang, r.* FROM low p JOIN rules r ON regexp_matches(p.l, r.pattern)),
rule_scores AS (SELECT prompt_id, max(severity) AS rule_score FROM hits GROUP BY prompt_id)"""


def _hit_sum(phrases) -> str:
    return " + ".join(f"contains(l, {_s(p)})::INT" for p in phrases)


INTENT = f"""
phrase_hits AS (
  SELECT prompt_id, {_hit_sum(fixed.INJECTION_PHRASES)} AS i, {_hit_sum(fixed.JAILBREAK_PHRASES)} AS j FROM low),
intent AS (
  SELECT prompt_id,
    CASE WHEN i = 0 AND j = 0 THEN NULL WHEN i >= j THEN 'PROMPT_INJECTION' ELSE 'JAILBREAK' END AS label,
    CASE WHEN i = 0 AND j = 0 THEN 0.0::DOUBLE ELSE round(least(0.95::DOUBLE, 0.5::DOUBLE + 0.2::DOUBLE * greatest(i, j)), 2) END AS confidence
  FROM phrase_hits)"""


def _fixed_model(source: str, key: str, text: str) -> str:
    """CTEs down to ``fixed_probs(key, p0, p1, p2)``: a linear model on TF-IDF, one probability per class."""
    terms = ", ".join(f"({_s(t)}, {idf}::DOUBLE, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for t, idf, a, b, c in FIXED_TERMS)
    margin = ", ".join(f"{b}::DOUBLE + coalesce(s{k} / norm, 0) AS m{k}" for k, b in enumerate(FIXED_INTERCEPTS))
    return f"""
fixed_terms(term, idf, c0, c1, c2) AS (VALUES {terms}),
fixed_words AS (SELECT {key}, regexp_extract_all(lower({text}), '[\\pL\\pN_]{{2,}}') AS w FROM {source}),
fixed_long AS (SELECT {key}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM fixed_words),
fixed_counts AS (SELECT {key}, term, count(*) AS tf FROM fixed_long JOIN fixed_terms USING (term) GROUP BY {key}, term),
fixed_raw AS (SELECT {key}, (1 + ln(tf)) * idf AS v, c0, c1, c2 FROM fixed_counts JOIN fixed_terms USING (term)),
fixed_sums AS (SELECT {key}, sqrt(sum(v * v)) AS norm, sum(v * c0) AS s0, sum(v * c1) AS s1, sum(v * c2) AS s2 FROM fixed_raw GROUP BY {key}),
fixed_margins AS (SELECT {key}, {margin} FROM {source} LEFT JOIN fixed_sums USING ({key})),
fixed_probs AS (SELECT {key}, exp(m0) / (exp(m0) + exp(m1) + exp(m2)) AS p0, exp(m1) / (exp(m0) + exp(m1) + exp(m2)) AS p1,
  exp(m2) / (exp(m0) + exp(m1) + exp(m2)) AS p2 FROM fixed_margins)"""


FIXED_INTENT = _fixed_model("prompts", "prompt_id", "prompt") + """,
intent AS (SELECT prompt_id, CASE WHEN p0 >= p1 AND p0 >= p2 THEN NULL WHEN p1 >= p2 THEN 'PROMPT_INJECTION' ELSE 'JAILBREAK' END AS label,
    round(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 1 - p0 ELSE greatest(p1, p2) END, 2) AS confidence FROM fixed_probs)"""


def _uuid(h: str) -> str:
    return f"concat_ws('-', substr({h},1,8), substr({h},9,4), substr({h},13,4), substr({h},17,4), substr({h},21,12))"


def _redact(prompt: str) -> str:
    order = ("list_sort(list_transform(range(1, len(pii) + 1), lambda i: {'n': -length(pii[i].text), 'i': i, "
             "'t': pii[i].text, 'k': '[' || pii[i].type || '_REDACTED]'}))")
    steps = f"list_transform({order}, lambda e: {{'s': '', 't': e.t, 'k': e.k}})"
    return (f"list_reduce(list_concat([{{'s': {prompt}, 't': '', 'k': ''}}], {steps}), lambda a, e: "
            f"{{'s': replace(a.s, e.t, e.k), 't': '', 'k': ''}}).s")


SCAN = f"""WITH {PROMPTS}, {RULES}, {INTENT}, {_pii('low')},
scored AS (
  SELECT f.prompt_id, f.source, f.lang, f.prompt, f.t, f.pii, f.data_leakage_severity, i.label, i.confidence,
    coalesce(r.rule_score, 0) AS rule_score,
    {_uuid("md5('prompts:' || f.prompt_id || ':' || f.prompt)")} AS scan_id
  FROM pii_found f JOIN intent i USING (prompt_id) LEFT JOIN rule_scores r USING (prompt_id)),
risked AS (
  SELECT *, least(100, greatest(0, floor(0.5::DOUBLE * rule_score + 0.3::DOUBLE * (confidence * 100.0::DOUBLE)
    + 0.2::DOUBLE * data_leakage_severity + 0.5::DOUBLE)))::INTEGER AS base FROM scored),
rated AS (
  SELECT *, CASE WHEN rule_score >= 70 THEN greatest(base, 70) ELSE base END::INTEGER AS risk_score FROM risked),
decided AS (
  SELECT *, CASE WHEN risk_score <= 34 THEN 'ALLOW' WHEN risk_score <= 69 THEN 'SANITIZE' ELSE 'BLOCK' END AS decision
  FROM rated),
scan AS (
  SELECT *, CASE WHEN decision = 'SANITIZE' AND len(pii) > 0 THEN {_redact('prompt')} END AS sanitized_prompt,
    CASE WHEN decision = 'SANITIZE' AND len(pii) > 0 THEN {_redact('t')} END AS sanitized_normal FROM decided),
threat_rows AS (
  SELECT prompt_id, threat, min(seat) AS seat FROM (
    SELECT prompt_id, threat, rule_no AS seat FROM hits
    UNION ALL SELECT prompt_id, label, 100 FROM scan WHERE label IS NOT NULL
    UNION ALL SELECT prompt_id, 'SENSITIVE_DATA', 200 FROM scan WHERE len(pii) > 0) GROUP BY prompt_id, threat),
signal_rows AS (
  SELECT prompt_id, rule_no AS seat, 'RULE' AS type, message, severity::INTEGER AS severity, NULL::DOUBLE AS confidence FROM hits
  UNION ALL SELECT prompt_id, 100, 'ML', 'ML classifier detected ' || label, trunc(confidence * 100)::INTEGER, confidence
    FROM scan WHERE label IS NOT NULL
  UNION ALL SELECT prompt_id, 200, 'PII', len(pii) || ' PII entity/entities detected', data_leakage_severity, NULL
    FROM scan WHERE len(pii) > 0),
events_scanned AS (
  SELECT *, strftime(at_time, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM (SELECT *, CASE WHEN prompt_id % 10 <> {TIMELESS}
    THEN make_timestamp(({FIRST_SECOND} + prompt_id * 7919 % {SECONDS}) * 1000000) END AS at_time FROM scan))
"""

RULES_ONLY = f"WITH {PROMPTS}, {RULES} "
PII_ONLY = f"WITH {PROMPTS}, {_pii('low')} "
_ENTITIES = "SELECT {keep}, unnest(range(1, len(pii) + 1))::INTEGER AS entity_no, unnest(pii) AS e FROM pii_found"
_TURNS = """WITH turns AS (SELECT conv_id || '-' || turn AS prompt_id, role,
  CASE turn % 7 WHEN 3 THEN NULL WHEN 4 THEN ' ' || chr(9) || ' ' ELSE text END AS prompt FROM conversations)"""

_DIGITS = "lpad(c_custkey::VARCHAR, 14, '0')"
_PHONE = f"'415-' || substr({_DIGITS}, 8, 3) || '-' || substr({_DIGITS}, 11, 4)"
_CHECK = (f"list_filter(range(0, 10), lambda d: {_luhn(chr(39) + '4' + chr(39) + ' || ' + _DIGITS + ' || d::VARCHAR')})[1]"
          ).replace("regexp_replace('4'", "regexp_replace('4'")
PEOPLE = f"""
people AS (SELECT c_custkey AS key, 'c' || {_DIGITS} || '@example.com' AS email, c_name AS name,
  CASE c_custkey % 4 WHEN 0 THEN {_PHONE}
    WHEN 1 THEN '(415)' || substr({_DIGITS}, 8, 3) || '-' || substr({_DIGITS}, 11, 4)
    WHEN 2 THEN '+1-' || {_PHONE}
    ELSE '415.' || substr({_DIGITS}, 8, 3) || '.' || substr({_DIGITS}, 11, 4) || 'x77' END AS phone,
  lower(c_mktsegment) || ' works' AS company, (c_custkey % 997) || ' Hill Road' AS address,
  'Town ' || c_nationkey AS city, 'clerk ' || (c_custkey % 13) AS job,
  '4' || {_DIGITS} || ({_CHECK})::VARCHAR AS card,
  substr({_DIGITS}, 6, 3) || '-' || substr({_DIGITS}, 9, 2) || '-' || substr({_DIGITS}, 11, 4) AS ssn,
  'sk-' || substr(md5(c_custkey::VARCHAR), 1, 20) AS api_key FROM customer)"""


def _fill(template: str, names) -> str:
    for n in names:
        template = f"replace({template}, {_s('{' + n + '}')}, {n})"
    return template


def _pick(templates, key: str) -> str:
    return f"({_list(templates)})[1 + ('0x' || substr(md5({key}), 1, 7))::BIGINT % {len(templates)}]"


_LABEL = "CASE WHEN toxic = 1 THEN 'PROMPT_INJECTION' WHEN quality = 0 THEN 'JAILBREAK' ELSE 'NORMAL' END"

FILLED = f"filled AS (SELECT 0 AS round_no, key, {_tidy(_fill(_pick(fixed.IDENTITY_TEMPLATES, '''%s || ':0:' || key''' % _s(str(fixed.SEED))), fixed.IDENTITY_FIELDS))} AS text FROM people)"

CORPORA = f"""
two_label AS (SELECT 'two_label' AS source, 0 AS source_rank, doc_id AS pos, {_tidy('text')} AS text,
  CASE toxic WHEN 1 THEN 'PROMPT_INJECTION' ELSE 'NORMAL' END AS label FROM documents JOIN labels USING (doc_id)),
wild AS (SELECT 'wild' AS source, 1 AS source_rank, doc_id AS pos, {_tidy('text')} AS text, 'JAILBREAK' AS label FROM documents
  WHERE length({_tidy('text')}) > 0),
turns AS (SELECT conv_id * 1000 + turn AS pos, role, {_tidy('text')} AS text FROM conversations),
paired AS (SELECT 'paired_harmful' AS source, 2 AS source_rank, pos, text, 'JAILBREAK' AS label FROM turns WHERE role = 'assistant'
  UNION ALL SELECT 'paired_benign', 3, pos, text, 'NORMAL' FROM turns WHERE role = 'user'),
instructions AS (SELECT 'instructions' AS source, 4 AS source_rank, item_id AS pos, {_tidy('text')} AS text,
  'PROMPT_INJECTION' AS label FROM benchmark WHERE length({_tidy('text')}) > 0),
refusals AS (SELECT 'refusals' AS source, 5 AS source_rank, doc_id AS pos, {_tidy('text')} AS text, 'NORMAL' AS label
  FROM documents JOIN labels USING (doc_id) WHERE quality = 1)"""

EVERYDAY = ("everyday AS (SELECT 'everyday' AS source, 6 AS source_rank, i - 1 AS pos, x[i] AS text, 'NORMAL' AS label FROM "
            f"(SELECT x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT {_list(fixed.EVERYDAY_PROMPTS)} AS x)))")

DATASET = f"""WITH {CORPORA}, {EVERYDAY}, {PEOPLE}, {FILLED},
all_rows AS (
  SELECT source, source_rank, pos, text, label FROM (
    SELECT * FROM two_label UNION ALL BY NAME SELECT * FROM wild UNION ALL BY NAME SELECT * FROM paired
    UNION ALL BY NAME SELECT * FROM instructions UNION ALL BY NAME SELECT * FROM refusals
    UNION ALL BY NAME SELECT * FROM everyday
    UNION ALL BY NAME SELECT 'identities' AS source, 7 AS source_rank, key AS pos, text, 'NORMAL' AS label FROM filled)
  WHERE length(text) > 0),
firsts AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY source_rank, pos) AS k FROM all_rows),
dataset AS (SELECT * FROM firsts WHERE k = 1 AND length(text) >= {fixed.MIN_TEXT_LENGTH}),
ranked AS (SELECT *, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label
  ORDER BY md5('{fixed.SEED}:' || source_rank || ':' || pos), source_rank, pos) AS r FROM dataset),
split AS (SELECT *, CASE WHEN r <= (n * 700 + 500) // 1000 THEN 'train' WHEN r <= (n * 850 + 500) // 1000 THEN 'val'
  ELSE 'test' END AS split FROM ranked)
"""

TERMS = f"""WITH docs AS (SELECT doc_id AS id, text, {_LABEL} AS label FROM documents JOIN labels USING (doc_id)),
words AS (SELECT id, regexp_extract_all(lower(text), '[\\pL\\pN_]{{2,}}') AS w FROM docs),
pairs AS (SELECT id, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS terms FROM words),
long AS (SELECT id, unnest(terms) AS term FROM pairs),
per_doc AS (SELECT id, term, count(*) AS tf FROM long GROUP BY id, term),
counts AS (SELECT term, sum(tf)::BIGINT AS occurrences, count(*) AS texts FROM per_doc GROUP BY term),
vocab AS (SELECT * FROM counts ORDER BY occurrences DESC, term LIMIT {fixed.MAX_TERMS})
"""

_PREDICT = f"""WITH {PROMPTS}, {RULES}, {INTENT},
truth AS (SELECT doc_id AS id, {_LABEL} AS y_true FROM labels),
first_rule AS (SELECT prompt_id, arg_min(threat, rule_no) AS threat FROM hits WHERE threat <> 'SOCIAL_ENGINEERING' GROUP BY prompt_id),
preds AS (
  SELECT 'phrases' AS model, t.id, t.y_true, coalesce(i.label, 'NORMAL') AS y_pred FROM truth t JOIN intent i ON i.prompt_id = t.id
  UNION ALL SELECT 'rules', t.id, t.y_true, coalesce(r.threat, 'NORMAL') FROM truth t JOIN prompts p ON p.prompt_id = t.id
    LEFT JOIN first_rule r ON r.prompt_id = t.id),
classes(label) AS (VALUES ('NORMAL'), ('PROMPT_INJECTION'), ('JAILBREAK')),
models(model) AS (VALUES ('phrases'), ('rules')),
tallies AS (SELECT m.model, c.label, count(*) FILTER (y_true = c.label AND y_pred = c.label) AS tp,
  count(*) FILTER (y_true = c.label) AS support, count(*) FILTER (y_pred = c.label) AS predicted, count(*) AS n,
  count(*) FILTER (y_true = y_pred) AS correct
  FROM preds JOIN models m USING (model) CROSS JOIN classes c GROUP BY m.model, c.label),
rates AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp::DOUBLE / predicted END AS precision,
  CASE WHEN support = 0 THEN 0.0 ELSE tp::DOUBLE / support END AS recall FROM tallies),
per_class AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM rates),
overall AS (SELECT model, max(correct)::DOUBLE / max(n) AS accuracy, avg(precision) AS precision_macro, avg(recall) AS recall_macro,
  avg(f1) AS f1_macro, sum(precision * support) / sum(support) AS precision_weighted,
  sum(recall * support) / sum(support) AS recall_weighted, sum(f1 * support) / sum(support) AS f1_weighted, max(n) AS n
  FROM per_class GROUP BY model)
"""

LEAKS = f"""WITH {PEOPLE},
cases AS (SELECT *, {_pick(fixed.TRUTH_TEMPLATES, "'123:' || key")} AS template FROM people),
case_texts AS (SELECT key AS prompt_id, {_fill('template', fixed.TRUTH_FIELDS)} AS t,
  list_filter([{', '.join(f"CASE WHEN contains(template, {_s('{' + f + '}')}) THEN {f} END" for f in fixed.TRUTH_FIELDS)}],
    lambda v: v IS NOT NULL) AS truth FROM cases),
{_pii('case_texts')},
sanitized AS (SELECT prompt_id AS case_id, t AS text, truth, {_redact('t')} AS sanitized FROM pii_found),
checked AS (SELECT *, list_filter(truth, lambda v: contains(sanitized, v)) AS leaked FROM sanitized),
judged AS (SELECT *, len(list_filter(leaked, lambda v: regexp_matches(v, '\\d') AND length(v) >= {fixed.PHONE_LIKE_LENGTH})) > 0 AS phone_like
  FROM checked)
"""

_ROUND = "round({0}, 6) AS {0}"


def _rounded(*names: str) -> str:
    return ", ".join(_ROUND.format(n) for n in names)


ORACLE: dict[str, str] = {
    "intake_rejects": _TURNS + " SELECT prompt_id, CASE WHEN prompt IS NULL THEN 'missing' ELSE 'ok' END AS outcome FROM turns",
    "intake_blank": _TURNS + f""" SELECT role, CASE WHEN prompt IS NULL THEN 'missing' WHEN {_tidy('prompt')} = '' THEN 'blank' ELSE 'ok' END
        AS outcome, count(*) AS n_rows FROM turns GROUP BY ALL""",
    "text_normalized": f"WITH {PROMPTS} SELECT prompt_id, md5(t) AS normal_md5, md5(l) AS detector_md5, length(t)::BIGINT AS n_chars FROM low",
    "text_cleaned": f"""SELECT doc_id, md5(x) AS text_md5, length(x)::BIGINT AS n_chars FROM (
        SELECT doc_id, {_tidy('text')} AS x FROM documents) WHERE length(x) >= {fixed.MIN_TEXT_LENGTH}""",
    "text_capped": f"""SELECT doc_id, md5(x) AS text_md5, length(x)::BIGINT AS n_chars FROM (
        SELECT doc_id, substr({_tidy('text')}, 1, {fixed.WILD_TEXT_CAP}) AS x FROM documents) WHERE length(x) >= 1""",
    "card_check": f"""WITH {PEOPLE}, forms AS (SELECT key, [card, substr(card, 1, 8) || '-' || substr(card, 9, 8),
        substr(card, 1, 15) || ((substr(card, 16, 1)::INT + 1) % 10), substr(card, 1, 12)] AS f FROM people),
        long AS (SELECT key, unnest(range(0, 4))::INTEGER AS form, unnest(f) AS c FROM forms)
        SELECT key, form, length(replace(c, '-', '')) BETWEEN 13 AND 19 AND {_luhn('c')} AS valid FROM long""",
    "rule_score": RULES_ONLY + """SELECT prompt_id, coalesce(rule_score, 0)::INTEGER AS rule_score
        FROM prompts LEFT JOIN rule_scores USING (prompt_id)""",
    "rule_threats": RULES_ONLY + """, firsts AS (SELECT prompt_id, threat, min(rule_no) AS seat FROM hits GROUP BY ALL)
        SELECT prompt_id, (row_number() OVER (PARTITION BY prompt_id ORDER BY seat) - 1)::INTEGER AS threat_no, threat FROM firsts""",
    "rule_signals": RULES_ONLY + """SELECT prompt_id, (row_number() OVER (PARTITION BY prompt_id ORDER BY rule_no) - 1)::INTEGER AS signal_no,
        'RULE' AS type, message, severity::INTEGER AS severity, NULL::DOUBLE AS confidence FROM hits""",
    "rule_hits_long": RULES_ONLY + "SELECT prompt_id, name, threat, severity::INTEGER AS severity FROM hits",
    "rule_hits_count": RULES_ONLY + "SELECT name, count(*) AS hits FROM hits GROUP BY name",
    "rule_threat_count": RULES_ONLY + "SELECT lang, threat, count(*) AS hits FROM hits GROUP BY lang, threat",
    "rule_table_join": f"""WITH {PROMPTS}, {_rules_table(USER_RULES)} SELECT prompt_id, name, threat, severity::INTEGER AS severity, message
        FROM low JOIN rules ON regexp_matches(l, pattern)""",
    "intent_keyword": f"WITH {PROMPTS}, {INTENT} SELECT prompt_id, label AS intent_label, confidence AS intent_confidence FROM intent",
    "pii_entities": PII_ONLY + f"SELECT prompt_id, entity_no, e.type, e.text, e.severity::INTEGER AS severity FROM ({_ENTITIES.format(keep='prompt_id')})",
    "pii_by_type": PII_ONLY + f"SELECT e.type AS type, count(*) AS entities FROM ({_ENTITIES.format(keep='prompt_id')}) GROUP BY e.type",
    "pii_by_source": f"WITH raw AS (SELECT doc_id AS prompt_id, source, {_tidy('text')} AS t FROM documents), {_pii('raw')} "
        f"SELECT source, e.type AS type, count(*) AS entities FROM ({_ENTITIES.format(keep='source')}) GROUP BY source, e.type",
    "pii_severity": PII_ONLY + "SELECT prompt_id, len(pii)::INTEGER AS entities, data_leakage_severity FROM pii_found",
    "pii_cards_luhn": PII_ONLY + "SELECT prompt_id, unnest(cards) AS text FROM pii_raw",
    "pii_phone_suppressed": PII_ONLY + "SELECT prompt_id, len(kept) - len(base) AS phones FROM pii_folded WHERE len(kept) > len(base)",
    "pii_external_spans": "", "pii_external_severity": "",
    "risk_grid": """WITH grid AS (SELECT least(1, greatest(0, round(l_discount * 10, 2))) AS c, (l_quantity * 2)::INTEGER AS p,
        (l_partkey % 101)::INTEGER AS r FROM lineitem),
        base AS (SELECT *, least(100, greatest(0, floor(0.5::DOUBLE * r + 0.3::DOUBLE * (c * 100.0::DOUBLE) + 0.2::DOUBLE * p + 0.5::DOUBLE)))::INTEGER AS b FROM grid),
        rated AS (SELECT CASE WHEN r >= 70 THEN greatest(b, 70) ELSE b END::INTEGER AS risk_score, trunc(c * 100)::INTEGER AS intent_severity FROM base)
        SELECT risk_score, CASE WHEN risk_score <= 34 THEN 'ALLOW' WHEN risk_score <= 69 THEN 'SANITIZE' ELSE 'BLOCK' END AS decision,
        intent_severity, count(*) AS n_rows FROM rated GROUP BY ALL""",
    "scan_decisions": SCAN + "SELECT decision, count(*) AS prompts, round(avg(risk_score), 6) AS mean_score FROM scan GROUP BY decision",
    "scan_scores": SCAN + "SELECT scan_id, risk_score, decision FROM scan",
    "scan_threats": SCAN + """SELECT scan_id, (row_number() OVER (PARTITION BY prompt_id ORDER BY seat) - 1)::INTEGER AS threat_no, threat
        FROM threat_rows JOIN scan USING (prompt_id)""",
    "scan_signals": SCAN + """SELECT scan_id, (row_number() OVER (PARTITION BY prompt_id ORDER BY seat) - 1)::INTEGER AS signal_no,
        type, message, severity, r.confidence FROM signal_rows r JOIN (SELECT prompt_id, scan_id FROM scan) USING (prompt_id)""",
    "scan_redacted": SCAN + """SELECT scan_id, md5(sanitized_prompt) AS sanitized_md5,
        coalesce(len(list_filter(pii, lambda e: contains(sanitized_prompt, e.text))) > 0, false) AS residual_leak FROM scan""",
    "scan_redacted_normalized": SCAN + "SELECT scan_id, sanitized_normal AS sanitized_prompt FROM scan WHERE sanitized_normal IS NOT NULL",
    "scan_rates": SCAN + """SELECT source, count(*) AS cases, round(avg((rule_score > 0)::INT), 6) AS rule_rate,
        round(avg((label IS NOT NULL)::INT), 6) AS intent_rate, round(avg((len(pii) > 0)::INT), 6) AS pii_rate,
        round(avg(((rule_score > 0) = (label IS NOT NULL))::INT), 6) AS agreement FROM scan GROUP BY source""",
    "scan_stream_counts": SCAN + """SELECT count(*) AS total, count(*) FILTER (decision = 'ALLOW') AS allow,
        count(*) FILTER (decision = 'SANITIZE') AS sanitize, count(*) FILTER (decision = 'BLOCK') AS block FROM scan""",
    "events_stream_counts": SCAN + """SELECT 'decision' AS kind, decision AS name, count(*) AS events FROM events_scanned GROUP BY decision
        UNION ALL SELECT 'threat', threat, count(*) FROM threat_rows WHERE prompt_id IN (SELECT prompt_id FROM events_scanned) GROUP BY threat""",
    "events_stream_windows": SCAN + """, named AS (SELECT at_time, 'decision' AS kind, decision AS name FROM events_scanned
          UNION ALL SELECT e.at_time, 'threat', t.threat FROM threat_rows t JOIN events_scanned e USING (prompt_id)),
        days AS (SELECT date_trunc('day', at_time) AS began, kind, name, count(*) AS events FROM named WHERE at_time IS NOT NULL GROUP BY ALL)
        SELECT strftime(began, '%Y-%m-%dT%H:%M:%S') AS started, kind, name, events FROM days
        WHERE began + INTERVAL 1 DAY <= (SELECT max(at_time) FROM events_scanned) - INTERVAL 2 DAY""",
    "events_stream_newest": SCAN + "SELECT scan_id, timestamp, risk_score, decision FROM events_scanned ORDER BY at_time DESC NULLS LAST, scan_id LIMIT 100",
    "event_log_compacted": SCAN + """SELECT strftime(at_time, '%Y-%m-%d') AS event_day, count(*) AS events, sum(risk_score)::BIGINT AS risk,
        1::BIGINT AS files FROM events_scanned GROUP BY ALL""",
    "events_score_sketch": SCAN + """, days AS (SELECT strftime(at_time, '%Y-%m-%d') AS event_day, count(*) AS events FROM events_scanned GROUP BY ALL)
        SELECT event_day, events, point, true AS near_rank FROM days CROSS JOIN (VALUES ('p50'), ('p95'), ('p99')) v(point)""",
    "event_log_roundtrip": SCAN + """SELECT strftime(at_time, '%Y-%m-%d') AS event_day, decision, count(*) AS events,
        sum(len(pii))::BIGINT AS entities FROM events_scanned GROUP BY ALL""",
    "event_log_other_day": SCAN + """SELECT scan_id, CASE WHEN prompt_id % 3 <> 0 THEN timestamp
        ELSE strftime(at_time + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%S') END AS timestamp, decision FROM events_scanned""",
    "events_find": SCAN + """SELECT scan_id, risk_score, decision FROM events_scanned
        WHERE prompt_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "event_json": SCAN + """, listed AS (SELECT prompt_id, list(threat ORDER BY seat) AS threats FROM threat_rows GROUP BY prompt_id),
        counted AS (SELECT prompt_id, count(*) AS n FROM signal_rows GROUP BY prompt_id)
        SELECT scan_id, coalesce('["' || array_to_string(threats, '","') || '"]', '[]') AS threats_json,
        md5('[' || array_to_string(list_transform(pii, lambda e: '{"type":"' || e.type || '","text":"' || e.text || '","severity":' || e.severity || '}'), ',') || ']') AS pii_md5,
        coalesce(n, 0)::INTEGER AS signals, len(pii)::INTEGER AS entities
        FROM scan LEFT JOIN listed USING (prompt_id) LEFT JOIN counted USING (prompt_id)""",
    "event_ids": SCAN + "SELECT scan_id, timestamp FROM events_scanned",
    "events_latest": SCAN + "SELECT scan_id, timestamp, risk_score, decision FROM events_scanned ORDER BY at_time DESC NULLS LAST, scan_id LIMIT 100",
    "events_by_decision": SCAN + """SELECT count(*) AS total, count(*) FILTER (decision = 'ALLOW') AS allow,
        count(*) FILTER (decision = 'SANITIZE') AS sanitize, count(*) FILTER (decision = 'BLOCK') AS block FROM events_scanned""",
    "events_by_decision_last": SCAN + """, newest AS (SELECT * FROM events_scanned ORDER BY at_time DESC NULLS LAST, scan_id LIMIT 100)
        SELECT count(*) AS total, count(*) FILTER (decision = 'ALLOW') AS allow,
        count(*) FILTER (decision = 'SANITIZE') AS sanitize, count(*) FILTER (decision = 'BLOCK') AS block FROM newest""",
    "events_by_threat": SCAN + f"""SELECT k.threat, count(t.prompt_id) AS events FROM (SELECT unnest({_list(fixed.KNOWN_THREATS)}) AS threat) k
        LEFT JOIN (SELECT * FROM threat_rows WHERE prompt_id IN (SELECT prompt_id FROM events_scanned)) t USING (threat) GROUP BY k.threat""",
    "events_search": SCAN + """SELECT scan_id, risk_score, timestamp FROM events_scanned WHERE decision = 'BLOCK'
        AND (contains(lower(prompt), 'previous instructions') OR contains(lower(scan_id), 'previous instructions'))""",
    "events_search_indexed": SCAN + """SELECT scan_id, risk_score, timestamp FROM events_scanned WHERE decision = 'BLOCK'
        AND (contains(lower(prompt), 'previous instructions') OR contains(lower(scan_id), 'previous instructions'))""",
    "events_search_id": SCAN + """SELECT scan_id, decision FROM events_scanned
        WHERE contains(lower(prompt), '-ab') OR contains(lower(scan_id), '-ab')""",
    "events_signals": SCAN + """SELECT scan_id, risk_score, CASE WHEN type IS NOT NULL
        THEN row_number() OVER (PARTITION BY e.prompt_id ORDER BY r.seat) END::INTEGER AS signal_no, type, message, severity, r.confidence
        FROM events_scanned e LEFT JOIN signal_rows r ON r.prompt_id = e.prompt_id""",
    "events_redacted_only": SCAN + """SELECT scan_id, md5(prompt) AS original_md5, md5(sanitized_prompt) AS sanitized_md5
        FROM events_scanned WHERE sanitized_prompt IS NOT NULL""",
    "events_lookup": SCAN + """SELECT scan_id, risk_score, decision FROM events_scanned
        WHERE prompt_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "source_two_label": f"WITH {CORPORA} SELECT pos, label, md5(text) AS text_md5 FROM two_label WHERE length(text) > 0",
    "source_paired": f"WITH {CORPORA} SELECT source, pos, label, md5(text) AS text_md5 FROM paired WHERE length(text) > 0",
    "source_instructions": f"WITH {CORPORA} SELECT pos, label, text FROM instructions",
    "source_csv": """WITH lines AS (SELECT item_id, CASE WHEN item_id % 11 = 10 THEN 'none' ELSE item_id::VARCHAR END || ',"' ||
          replace(translate(text, chr(10) || chr(13), '  '), '"', '""') || '"' || CASE WHEN item_id % 7 = 6 THEN ',more' ELSE '' END AS line, text FROM benchmark),
        good AS (SELECT item_id, {_clean} AS text FROM lines WHERE item_id % 11 <> 10 AND item_id % 7 <> 6)
        SELECT item_id AS pos, 'ok' AS outcome, md5(text) AS md5 FROM good WHERE length(text) > 0
        UNION ALL SELECT NULL, 'malformed', md5(line) FROM lines WHERE item_id % 11 = 10 OR item_id % 7 = 6""".replace("{_clean}", _tidy("text")),
    "detect_turns": f"""WITH prompts AS (SELECT conv_id || '-' || turn AS prompt_id, NULL AS source, NULL AS lang, CASE turn % 7 WHEN 3 THEN NULL
          WHEN 4 THEN ' ' || chr(9) || ' ' WHEN 5 THEN '' ELSE text || ' ' || ({_list(fixed.PHRASE_BANK)})[1 + (conv_id + turn) % {len(fixed.PHRASE_BANK)}] END AS prompt
          FROM conversations),
        texts AS (SELECT *, coalesce(prompt, '') AS t FROM prompts), low AS (SELECT *, lower({_tidy('t')}) AS l FROM texts),
        {RULES}, {INTENT}, {_pii('texts')},
        per_rule AS (SELECT prompt_id, count(*) AS signals, count(DISTINCT threat) AS threats FROM hits GROUP BY prompt_id)
        SELECT t.prompt_id, coalesce(s.rule_score, 0)::INTEGER AS rule_score, coalesce(r.threats, 0)::INTEGER AS threats, coalesce(r.signals, 0)::INTEGER AS signals,
          i.label AS intent_label, i.confidence AS intent_confidence, len(p.pii)::INTEGER AS entities, p.data_leakage_severity
        FROM texts t LEFT JOIN rule_scores s USING (prompt_id) LEFT JOIN per_rule r USING (prompt_id) JOIN intent i USING (prompt_id)
        JOIN pii_found p USING (prompt_id)""",
    "source_safe_only": f"WITH {CORPORA} SELECT pos, label, md5(text) AS text_md5 FROM refusals WHERE length(text) > 0",
    "dataset_sample": f"WITH {CORPORA} SELECT pos, label, md5(substr(text, 1, {fixed.WILD_TEXT_CAP})) AS text_md5 FROM wild "
        f"ORDER BY md5('{fixed.SEED}:wild:' || pos), pos LIMIT {fixed.WILD_SAMPLE}",
    "dataset_sample_large": """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
        ORDER BY md5('7:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey), 1, 2, 3, 4 LIMIT 5000)
        SELECT *, count(*) AS n_rows FROM r GROUP BY ALL""",
    "dataset_union_dedup": DATASET + "SELECT source, pos, label, md5(text) AS text_md5 FROM dataset",
    "dataset_stage_counts": DATASET + """SELECT 'before' AS stage, count(*) AS n_rows FROM all_rows
        UNION ALL SELECT 'after', count(*) FROM dataset""",
    "dataset_stage_counts_written": DATASET + """SELECT 'before' AS stage, count(*) AS n_rows FROM all_rows
        UNION ALL SELECT 'after', count(*) FROM dataset""",
    "dataset_class_counts": DATASET + "SELECT label, count(*) AS n_rows FROM dataset GROUP BY label",
    "dataset_split_members": DATASET + "SELECT source, pos, label, split FROM split",
    "dataset_split_counts": DATASET + "SELECT split, label, count(*) AS n_rows FROM split GROUP BY ALL",
    "splits_roundtrip": DATASET + "SELECT label, split, count(*) AS n_rows, sum(length(text))::BIGINT AS n_chars FROM split GROUP BY ALL",
    "dataset_template_cross": f"""WITH topics AS (SELECT DISTINCT p_name AS topic FROM part),
        rows AS (SELECT topic, unnest(range(0, {len(fixed.TOPIC_TEMPLATES)}))::INTEGER AS template_no, unnest({_list(fixed.TOPIC_TEMPLATES)}) AS t FROM topics)
        SELECT topic, template_no, {_tidy("replace(t, '{topic}', topic)")} AS text FROM rows
        ORDER BY md5('{fixed.SEED + 1}:' || topic || ':' || template_no), topic, template_no LIMIT {fixed.EXPANDED_ROWS}""",
    "dataset_template_fill": "",
    "label_indexes": f"""SELECT {_LABEL} AS label, {_case(_LABEL, {n: i for i, n in enumerate(fixed.LABELS)})}::INTEGER AS label_index,
        {_LABEL} AS back, count(*) AS n_rows FROM labels JOIN documents USING (doc_id) GROUP BY ALL""",
    "template_filled": f"WITH {PEOPLE} SELECT key, name || ' <' || email || '> ' || phone || ' ' || name AS line FROM people",
    "term_counts": TERMS + "SELECT term, occurrences, texts FROM counts",
    "vocab_top": TERMS + "SELECT term, occurrences, texts FROM vocab",
    "tfidf_terms": TERMS + """, raw AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM docs)) / (1.0 + texts)) + 1) AS w
          FROM per_doc JOIN vocab USING (term)),
        norms AS (SELECT id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY id)
        SELECT id, term, round(w / norm, 6) AS weight FROM raw JOIN norms USING (id)""",
    "class_weights": TERMS + """, c AS (SELECT label, count(*) AS n_rows FROM docs GROUP BY label)
        SELECT label, n_rows, round((SELECT sum(n_rows) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n_rows), 6) AS weight FROM c""",
    "svm_optimum": TERMS + "SELECT label, count(*) AS n_rows, true AS at_optimum FROM docs GROUP BY label",
    "model_fixed_intent": f"WITH {PROMPTS}, {FIXED_INTENT} SELECT prompt_id, label AS intent_label, confidence AS intent_confidence FROM intent",
    "model_fixed_predictions": f"WITH docs AS (SELECT doc_id AS id, text, {_LABEL} AS y_true FROM documents JOIN labels USING (doc_id)), "
        + _fixed_model("docs", "id", "text") + """ SELECT id, y_true, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'NORMAL'
        WHEN p1 >= p2 THEN 'PROMPT_INJECTION' ELSE 'JAILBREAK' END AS y_pred FROM docs JOIN fixed_probs USING (id)""",
    "scan_with_model": SCAN.replace(INTENT, FIXED_INTENT) + "SELECT scan_id, risk_score, decision FROM scan",
    "confusion": _PREDICT + """SELECT c.label AS y_true, count(*) FILTER (y_pred = 'NORMAL') AS "NORMAL",
        count(*) FILTER (y_pred = 'PROMPT_INJECTION') AS "PROMPT_INJECTION", count(*) FILTER (y_pred = 'JAILBREAK') AS "JAILBREAK"
        FROM classes c LEFT JOIN (SELECT * FROM preds WHERE model = 'phrases') p ON p.y_true = c.label GROUP BY c.label""",
    "confusion_csv": _PREDICT + """SELECT c.label AS y_true, count(*) FILTER (y_pred = 'NORMAL') AS "NORMAL",
        count(*) FILTER (y_pred = 'PROMPT_INJECTION') AS "PROMPT_INJECTION", count(*) FILTER (y_pred = 'JAILBREAK') AS "JAILBREAK"
        FROM classes c LEFT JOIN (SELECT * FROM preds WHERE model = 'rules') p ON p.y_true = c.label GROUP BY c.label""",
    "class_metrics": _PREDICT + f"SELECT label, {_rounded('precision', 'recall', 'f1')}, support FROM per_class WHERE model = 'phrases'",
    "macro_metrics": _PREDICT + f"SELECT {_rounded('accuracy', 'precision_macro', 'recall_macro', 'f1_macro')}, n FROM overall WHERE model = 'phrases'",
    "weighted_metrics": _PREDICT + f"SELECT {_rounded('precision_weighted', 'recall_weighted', 'f1_weighted')} FROM overall WHERE model = 'phrases'",
    "metrics_roundtrip": _PREDICT + """SELECT model, label, metric, round(value, 6) AS value FROM (
        UNPIVOT (SELECT model, 'ALL' AS label, accuracy, precision_macro, recall_macro, f1_macro, n::DOUBLE AS n FROM overall)
          ON accuracy, precision_macro, recall_macro, f1_macro, n INTO NAME metric VALUE value
        UNION ALL BY NAME
        UNPIVOT (SELECT model, label, precision::DOUBLE AS precision, recall::DOUBLE AS recall, f1::DOUBLE AS f1, support::DOUBLE AS support FROM per_class)
          ON precision, recall, f1, support INTO NAME metric VALUE value) WHERE model = 'phrases'""",
    "model_compare": _PREDICT + f"""SELECT model, {_rounded('accuracy', 'precision_macro', 'recall_macro', 'f1_macro')},
        round(best, 6) AS best_baseline_f1, round(f1_macro - best, 6) AS f1_gap
        FROM overall, (SELECT max(f1_macro) AS best FROM overall WHERE model = 'phrases')""",
    "model_compare_by_class": _PREDICT + "SELECT label, " + ", ".join(
        f"round(max({m}) FILTER (model = '{k}'), 6) AS {k}_{m}" for k in ("phrases", "rules") for m in ("precision", "recall", "f1"))
        + " FROM per_class GROUP BY label",
    "detection_rates": _PREDICT + """, v AS (SELECT CASE label WHEN 'NORMAL' THEN 'false_positive_rate' ELSE 'detection_rate' END AS metric, label,
        CASE label WHEN 'NORMAL' THEN 1 - recall ELSE recall END AS value,
        CASE label WHEN 'NORMAL' THEN 0.05::DOUBLE ELSE 0.9::DOUBLE END AS target FROM per_class WHERE model = 'rules')
        SELECT metric, label, round(value, 6) AS value, target, CASE label WHEN 'NORMAL' THEN value <= target ELSE value >= target END AS target_met FROM v""",
    "truth_cases": LEAKS + "SELECT prompt_id AS case_id, t AS text, array_to_string(truth, '|') AS truth FROM case_texts",
    "leak_check": LEAKS + "SELECT case_id, sanitized, array_to_string(leaked, '|') AS leaked FROM checked",
    "leak_rate": LEAKS + f"""SELECT count(*) AS cases, count(*) FILTER (len(leaked) = 0) AS successes, count(*) FILTER (len(leaked) > 0) AS failures,
        count(*) FILTER (phone_like) AS phone_like, round(avg((len(leaked) = 0)::INT), 6) AS success_rate,
        avg((len(leaked) = 0)::INT) >= {fixed.LEAK_TARGET} AS target_met FROM judged""",
    "leak_phone_like": LEAKS + "SELECT case_id, array_to_string(leaked, '|') AS leaked FROM judged WHERE phone_like",
    "leak_failures_top50": LEAKS + f"""SELECT case_id, text, array_to_string(leaked, '|') AS leaked, sanitized FROM checked WHERE len(leaked) > 0
        ORDER BY case_id LIMIT {fixed.FAILURES_SHOWN}""",
    "leak_left_out": LEAKS + f"SELECT greatest(count(*) FILTER (len(leaked) > 0) - {fixed.FAILURES_SHOWN}, 0)::BIGINT AS left_out FROM checked",
    "latency_summary": f"""SELECT count(value) AS n, round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms,
        round(quantile_cont(value, 0.95), 6) AS p95_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms, round(max(value), 6) AS max_ms,
        quantile_cont(value, 0.95) < {fixed.LATENCY_TARGET_MS} AS target_met FROM events WHERE event_id + 1 > {fixed.LATENCY_WARMUP}""",
    "latency_approximate": "SELECT * FROM (VALUES ('p50', true), ('p95', true), ('p99', true)) v(point, near_rank)",
    "round_robin": f"""SELECT ({_list(fixed.PHRASE_BANK)})[1 + event_id % {len(fixed.PHRASE_BANK)}] AS phrase, count(*) AS n_rows
        FROM events GROUP BY ALL""",
}

_KINDS = [*fixed.EXTERNAL_KINDS, "DATE_TIME"]
_SPANS = f"""WITH {PROMPTS}, spans AS (
  SELECT doc_id AS prompt_id, ({_list(_KINDS)})[1 + (doc_id + k) % 8] AS kind, ((doc_id * 7 + k * 3) % 50)::INTEGER AS s,
    ((doc_id * 7 + k * 3) % 50 + 4 + k)::INTEGER AS e, ((doc_id * 13 + k * 29) % 100) / 100.0 AS score
  FROM documents, (VALUES (0), (1)) v(k)),
kept AS (SELECT prompt_id, s, e, {_case('kind', fixed.EXTERNAL_KINDS)} AS type FROM spans WHERE score >= 0.4 AND kind <> 'DATE_TIME'),
found AS (SELECT prompt_id, s, e, type, substr(prompt, s + 1, e - s) AS text, ({_case('type', fixed.SEVERITY_BY_KIND)})::INTEGER AS severity
  FROM kept JOIN prompts USING (prompt_id)),
sev AS (SELECT prompt_id, least(100, max(severity) + 5 * (count(*) - 1))::INTEGER AS data_leakage_severity, count(*) AS entities FROM found GROUP BY prompt_id)
"""
ORACLE["pii_external_spans"] = _SPANS + """SELECT p.prompt_id, coalesce(v.data_leakage_severity, 0)::INTEGER AS data_leakage_severity,
  CASE WHEN type IS NOT NULL THEN row_number() OVER (PARTITION BY p.prompt_id ORDER BY s, e, type) END::INTEGER AS entity_no, type, text, severity
  FROM prompts p LEFT JOIN sev v USING (prompt_id) LEFT JOIN found f USING (prompt_id)"""
ORACLE["pii_external_severity"] = _SPANS + "SELECT prompt_id, data_leakage_severity, entities FROM sev"

# Identities in rounds: a second round only where the table is too small.
ORACLE["dataset_template_fill"] = f"""WITH {PEOPLE},
rounds AS (SELECT *, unnest(range(0, greatest(1, ceil({fixed.FILLED_ROWS} / (SELECT count(*) FROM people))::INT)))::INTEGER AS round_no FROM people)
SELECT round_no, key, {_tidy(_fill(_pick(fixed.IDENTITY_TEMPLATES, f"'{fixed.SEED}:' || round_no || ':' || key"), fixed.IDENTITY_FIELDS))} AS text
FROM rounds ORDER BY round_no, key LIMIT {fixed.FILLED_ROWS}"""

# Left to the rows-only check: solvers, and JSON of floating numbers.
ROWS_ONLY = {"train_lr", "train_svm", "model_select", "model_intent_counts", "scan_report"}
