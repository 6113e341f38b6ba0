"""Shared pieces of the SQL that the driver queries are compared with."""

from __future__ import annotations

from tuneprep.functions.text import ARTICLES, BLANKS, PUNCTUATION
from tuneprep.operators.scoring import MAX_CLASSES


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _chars(text: str) -> str:
    """A string literal with control characters spelled as chr()."""
    parts = [quote(c) if c.isprintable() else f"chr({ord(c)})" for c in text]
    return "(" + " || ".join(parts) + ")"


BLANK_CHARS = _chars(BLANKS)
BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PUNCT = "[" + "".join("\\" + c for c in PUNCTUATION) + "]"
_NON_WORD = r"[^\p{L}\p{N}_]"


def strip(x: str) -> str:
    return f"trim({x}, {BLANK_CHARS})"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({strip(x)}, '{BLANK}+'), lambda w: w <> '')"


def normalize(x: str) -> str:
    """Two passes, because neighbouring articles share the blank between them."""
    text = f"regexp_replace(lower({x}), {quote(_PUNCT)}, '', 'g')"
    for _ in range(2):
        text = f"regexp_replace({text}, '(^|{_NON_WORD})(?:{'|'.join(ARTICLES)})($|{_NON_WORD})', '\\1 \\2', 'g')"
    return f"trim(regexp_replace({text}, '{BLANK}+', ' ', 'g'))"


def rounded(x: str, digits: int) -> str:
    """printf rounds the exact binary value, ties to even."""
    return f"CAST(printf('%.{digits}f', {x}) AS DOUBLE)"


def percent(part: str, total: str, digits: int = 1) -> str:
    return rounded(f"CAST({part} AS DOUBLE) / greatest({total}, 1) * 100.0", digits)


def _answer(form: str) -> str:
    return f"""CASE {form} WHEN 0 THEN golden WHEN 1 THEN 'The ' || golden || '.'
        WHEN 2 THEN 'answer is ' || golden
        WHEN 3 THEN array_to_string(words[1:len(words)//2], ' ')
        ELSE array_to_string(words[len(words)//2 + 1:], ' ') END"""


PAIRS = f"""words AS (SELECT doc_id, source, {tokens('text')} AS words FROM documents),
    golds AS (SELECT *, array_to_string(words, ' ') AS golden FROM words),
    pairs AS (SELECT source AS run_id, doc_id AS id, golden,
        {_answer('(doc_id // 5) % 5')} AS baseline_output, {_answer('doc_id % 5')} AS model_output FROM golds)"""

SCORED = f"""{PAIRS},
    normed AS (SELECT *, {normalize('golden')} AS ng, {normalize('model_output')} AS nm,
        {normalize('baseline_output')} AS nb FROM pairs),
    matched AS (SELECT *, model_output = golden AS exact_match_strict, nm = ng AS exact_match_norm,
        golden <> '' AND model_output <> '' AND ((ng <> '' AND contains(nm, ng))
            OR contains(lower({strip('model_output')}), lower({strip('golden')}))) AS substring_match,
        golden <> '' AND baseline_output <> '' AND ((ng <> '' AND contains(nb, ng))
            OR contains(lower({strip('baseline_output')}), lower({strip('golden')}))) OR nb = ng AS baseline_correct
        FROM normed),
    flagged AS (SELECT *, substring_match OR exact_match_norm AS model_correct FROM matched),
    scored AS (SELECT *, CASE WHEN baseline_correct AND model_correct THEN 'PRESERVED'
        WHEN model_correct THEN 'FIXED' WHEN baseline_correct THEN 'REGRESSED' ELSE 'PERSISTENT_FAIL' END AS status
        FROM flagged)"""

# Word metrics by counting words, not by sorting them.
WORDS = f"""{SCORED},
    sides AS (SELECT id, unnest({tokens('nm')}) AS w, 1 AS p, 0 AS g FROM scored
        UNION ALL SELECT id, unnest({tokens('ng')}), 0, 1 FROM scored),
    shared AS (SELECT id, sum(least(p, g)) AS same FROM
        (SELECT id, w, sum(p) AS p, sum(g) AS g FROM sides GROUP BY ALL) GROUP BY id),
    sizes AS (SELECT s.*, len({tokens('nm')}) AS np, len({tokens('ng')}) AS ngw, coalesce(same, 0) AS same
        FROM scored s LEFT JOIN shared USING (id)),
    ratios AS (SELECT *, CASE WHEN np = 0 AND ngw = 0 THEN 1.0::DOUBLE WHEN same > 0 THEN same::DOUBLE / np ELSE 0.0::DOUBLE END AS pr,
        CASE WHEN np = 0 AND ngw = 0 THEN 1.0::DOUBLE WHEN same > 0 THEN same::DOUBLE / ngw ELSE 0.0::DOUBLE END AS rc FROM sizes),
    measured AS (SELECT *, {rounded('pr', 4)} AS word_precision, {rounded('rc', 4)} AS word_recall,
        {rounded('CASE WHEN pr + rc > 0 THEN 2.0::DOUBLE * pr * rc / (pr + rc) ELSE 0.0::DOUBLE END', 4)} AS word_f1 FROM ratios)"""


def _mean(column: str) -> str:
    return rounded(f"CAST(sum(CAST(round({column} * 10000) AS BIGINT)) AS DOUBLE) / 10000.0::DOUBLE / count(*)", 4)


SUMMARY = f"""{WORDS},
    summary AS (SELECT run_id, count(*) AS total_samples,
        count(*) FILTER (exact_match_strict) AS strict_count, count(*) FILTER (exact_match_norm) AS exact_count,
        count(*) FILTER (substring_match) AS substring_count,
        count(*) FILTER (status = 'FIXED') AS fixed_count, count(*) FILTER (status = 'REGRESSED') AS regressed_count,
        count(*) FILTER (model_output IS NULL) AS missing_count,
        {percent('count(*) FILTER (exact_match_norm)', 'count(*)')} AS exact_match_pct,
        {percent('count(*) FILTER (exact_match_strict)', 'count(*)')} AS exact_match_strict_pct,
        {percent('count(*) FILTER (substring_match)', 'count(*)')} AS substring_match_pct,
        {_mean('word_f1')} AS avg_word_f1, {_mean('word_precision')} AS avg_word_prec, {_mean('word_recall')} AS avg_word_recall
        FROM measured GROUP BY run_id)"""

CLASS_PAIRS = """class_pairs AS (SELECT source AS run_id, doc_id AS id, lang AS golden,
        CASE WHEN doc_id % 8 = 7 THEN 'unknown'
             WHEN doc_id % 4 = 3 THEN CASE lang WHEN 'de' THEN 'en' WHEN 'en' THEN 'es' WHEN 'es' THEN 'fr' WHEN 'fr' THEN 'de' END
             WHEN doc_id % 4 = 2 THEN 'Lang: ' || lang || '!' ELSE lang END AS model_output FROM documents)"""

CELLS = f"""{CLASS_PAIRS},
    answers AS (SELECT run_id, id, {normalize('golden')} AS actual, {normalize('model_output')} AS answer FROM class_pairs),
    class_lists AS (SELECT run_id, list_sort(list(DISTINCT actual)) AS classes FROM answers GROUP BY run_id
        HAVING count(DISTINCT actual) BETWEEN 2 AND {MAX_CLASSES}),
    named AS (SELECT *, list_filter(classes, lambda c: c <> '' AND contains(answer, c)) AS hits FROM answers JOIN class_lists USING (run_id)),
    picked AS (SELECT *, CASE WHEN list_contains(classes, answer) THEN answer WHEN len(hits) = 1 THEN hits[1] END AS predicted FROM named),
    cells AS (SELECT run_id, actual, predicted, count(*) AS n FROM picked GROUP BY ALL)"""

PER_CLASS = f"""{CELLS},
    counted AS (SELECT run_id, c AS class,
            (SELECT coalesce(sum(n), 0) FROM cells x WHERE x.run_id = g.run_id AND x.actual = c)::BIGINT AS support,
            (SELECT coalesce(sum(n), 0) FROM cells x WHERE x.run_id = g.run_id AND x.predicted = c)::BIGINT AS answered,
            (SELECT coalesce(sum(n), 0) FROM cells x WHERE x.run_id = g.run_id AND x.actual = c AND x.predicted = c)::BIGINT AS tp,
            (SELECT coalesce(sum(n), 0) FROM cells x WHERE x.run_id = g.run_id AND x.actual = c AND x.predicted IS NULL)::BIGINT AS unclassified,
            (SELECT min(id) FROM picked p WHERE p.run_id = g.run_id AND p.actual = c) AS first_id
        FROM (SELECT run_id, unnest(classes) AS c FROM class_lists) g),
    shares AS (SELECT *, CASE WHEN answered > 0 THEN tp::DOUBLE / answered ELSE 0.0::DOUBLE END AS pr,
        CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0.0::DOUBLE END AS rc FROM counted),
    per_class AS (SELECT run_id, class, support, answered, tp, unclassified, first_id,
        {rounded('pr * 100.0::DOUBLE', 2)} AS precision, {rounded('rc * 100.0::DOUBLE', 2)} AS recall,
        {rounded('(CASE WHEN pr + rc > 0 THEN 2.0::DOUBLE * pr * rc / (pr + rc) ELSE 0.0::DOUBLE END) * 100.0::DOUBLE', 2)} AS f1 FROM shares)"""

CLASS_SUMMARY = f"""{PER_CLASS},
    totals AS (SELECT run_id, count(*) AS n_classes, sum(support)::BIGINT AS total_samples, sum(tp) AS correct,
        sum(unclassified)::BIGINT AS unclassified, max(support) AS majority,
        arg_max(class, (support, -first_id)) AS majority_label,
        CAST(sum(CAST(round(f1 * 100) AS BIGINT)) AS DOUBLE) / 100.0::DOUBLE / count(*) AS macro FROM per_class GROUP BY run_id),
    class_pcts AS (SELECT *, {percent('correct', 'total_samples', 2)} AS accuracy, {percent('majority', 'total_samples', 2)} AS majority_baseline FROM totals),
    class_summary AS (SELECT run_id, n_classes, total_samples, unclassified, majority_label, accuracy, majority_baseline,
        {rounded('macro', 2)} AS macro_f1, {rounded('accuracy - majority_baseline', 2)} AS accuracy_over_baseline FROM class_pcts)"""

CURVES = """losses AS (SELECT user_id AS run_id, event_id AS step, CASE event_type WHEN 'view' THEN 'val' ELSE 'train' END AS metric,
        value FROM events WHERE event_type IN ('view', 'click')),
    ckpts AS (SELECT user_id AS run_id, event_id AS step, 'adapters/' || lpad(event_id::VARCHAR, 12, '0') AS path
        FROM events WHERE event_type IN ('view', 'purchase')),
    vals AS (SELECT run_id, step, value AS val_loss FROM losses WHERE metric = 'val'),
    trains AS (SELECT run_id, step, value AS train_loss FROM losses WHERE metric = 'train'),
    matched AS (SELECT run_id, step, val_loss FROM ckpts JOIN vals USING (run_id, step)),
    as_of AS (SELECT c.run_id, c.step, t.train_loss FROM ckpts c ASOF JOIN trains t ON c.run_id = t.run_id AND c.step >= t.step),
    best_val AS (SELECT run_id, arg_min(step, (val_loss, step)) AS step, min(val_loss) AS loss FROM matched GROUP BY run_id),
    best_train AS (SELECT run_id, arg_min(step, (train_loss, step)) AS step, min(train_loss) AS loss FROM as_of GROUP BY run_id)"""

STOPS = f"""{CURVES},
    walked AS (SELECT *, min(val_loss) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low,
        lag(val_loss) OVER (PARTITION BY run_id ORDER BY step) AS prev FROM matched),
    rises AS (SELECT *, coalesce(val_loss >= low AND val_loss > prev, false) AS rise FROM walked),
    flags AS (SELECT *, coalesce(val_loss >= low AND (val_loss - low) / greatest(low, 1e-8) > 0.05, false)
        OR (rise AND coalesce(lag(rise) OVER (PARTITION BY run_id ORDER BY step), false)) AS stop FROM rises),
    stops AS (SELECT run_id, min(step) FILTER (stop) AS stop_step, arg_min(val_loss, step) AS first_loss FROM flags GROUP BY run_id)"""

KNEES = f"""{STOPS},
    bests AS (SELECT run_id, arg_min(step, (val_loss, step)) AS best_step, min(val_loss) AS best_loss, any_value(first_loss) AS first_loss
        FROM matched JOIN stops USING (run_id) WHERE stop_step IS NULL OR step < stop_step GROUP BY run_id),
    knees AS (SELECT run_id, min(step) AS step, arg_min(val_loss, step) AS loss FROM matched JOIN bests USING (run_id)
        WHERE step <= best_step AND val_loss <= best_loss + greatest(0.005::DOUBLE, 0.02::DOUBLE * greatest(0.0::DOUBLE, first_loss - best_loss))
        GROUP BY run_id)"""

# Half-up would differ from half-even here only on exact ties of two-digit prices: none.
_LINE_VALUE = "printf('%.2f', value)"
LOG_LINES = f"""log_lines AS (SELECT user_id AS run_id, event_id AS line_no, event_id // 10 AS step, event_type,
        CAST({_LINE_VALUE} AS DOUBLE) AS v FROM events)"""
