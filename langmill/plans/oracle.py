"""The same queries in plain SQL for an independent engine, written from the definitions."""

from __future__ import annotations

import string

from langmill.operators import lexicon, seeds
from langmill.plans import catalog

SEED = catalog.SEED


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def case(column: str, mapping: dict, otherwise: str = "NULL") -> str:
    whens = " ".join(f"WHEN {quoted(k)} THEN {quoted(v) if v is not None else 'NULL'}" for k, v in mapping.items())
    return f"CASE {column} {whens} ELSE {otherwise} END"


def sql_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


LABEL = case("lang", catalog.LANGUAGES)
LEXICON = "(VALUES " + ", ".join(
    f"({quoted(label)}, {sql_list(words.split())})" for label, words in lexicon.FUNCTION_WORDS.items()
) + ") AS lex(label, listed)"
LABEL_VALUES = "(VALUES " + ", ".join(f"({quoted(label)})" for label in catalog.LABELS) + ") AS lab(label)"


def scored(source: str, keys: str) -> str:
    """CTE ``scored`` (keys, label, score) over ``source`` with a column text."""
    return f"""
base AS ({source}),
hits AS (
  SELECT {keys}, label,
    len(list_filter(regexp_split_to_array(lower(text), {quoted(lexicon.SEPARATOR)}), lambda x: list_contains(listed, x)))::DOUBLE AS n
  FROM base, {LEXICON}),
scored AS (
  SELECT {keys}, label,
    CASE WHEN sum(n) OVER (PARTITION BY {keys}) = 0 THEN 0 ELSE n / sum(n) OVER (PARTITION BY {keys}) END AS score
  FROM hits)"""


def predicted(source: str, keys: str, threshold: float = catalog.THRESHOLD) -> str:
    """CTE ``pred`` (keys, pred): labels above the threshold, best first."""
    return f"""{scored(source, keys)},
pred AS (
  SELECT {keys}, coalesce(list(label ORDER BY score DESC, label) FILTER (WHERE score > {threshold}), []) AS pred
  FROM scored GROUP BY {keys})"""


DOC_PRED = predicted(f"SELECT doc_id, source, {LABEL} AS lang, text FROM documents WHERE text IS NOT NULL", "doc_id, source, lang")
DOC_ITEMS = f"{DOC_PRED}, items AS (SELECT *, [lang] AS gold FROM pred)"
JUDGED = f"""{DOC_PRED},
items AS (
  SELECT pred.*, CASE WHEN quality = 0 THEN [] WHEN toxic = 1 THEN list_sort(list_distinct([lang, 'deu_Latn'])) ELSE [lang] END AS gold
  FROM pred LEFT JOIN labels USING (doc_id))"""
SINGLE = f"""{scored(f"SELECT doc_id, {LABEL} AS lang, text FROM documents WHERE text IS NOT NULL", "doc_id, lang")},
single AS (
  SELECT doc_id, lang AS gold, first(CASE WHEN score > 0 THEN label END ORDER BY score DESC, label) AS pred
  FROM scored GROUP BY doc_id, lang)"""


def counts(keys: str = "", labels: str = LABEL_VALUES) -> str:
    """CTE ``cnt``: every item against every label."""
    lead = f"{keys}, " if keys else ""
    return f"""
cnt AS (
  SELECT {lead}label, count(*) AS n_items,
    count(*) FILTER (WHERE list_contains(pred, label) AND list_contains(gold, label)) AS tp,
    count(*) FILTER (WHERE list_contains(pred, label) AND NOT list_contains(gold, label)) AS fp,
    count(*) FILTER (WHERE NOT list_contains(pred, label) AND list_contains(gold, label)) AS fn,
    count(*) FILTER (WHERE NOT list_contains(pred, label) AND NOT list_contains(gold, label)) AS tn
  FROM items, {labels} GROUP BY ALL)"""


P = "CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END"
R = "CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END"
F1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END"
FPR = "CASE WHEN fp + tn = 0 THEN NULL ELSE fp / (fp + tn) END"


def long_metrics(keys: str = "") -> str:
    """CTE ``met`` (keys, metric, label, score) with the mean as label ``all``."""
    lead = f"{keys}, " if keys else ""
    parts = [
        f"SELECT {lead}'{name}' AS metric, label, ({expr})::DOUBLE AS score FROM cnt WHERE tp + fn > 0"
        for name, expr in (("F1", F1), ("FPR", FPR), ("Precision", P), ("Recall", R))
    ]
    return f"""
lm AS ({' UNION ALL '.join(parts)}),
met AS (SELECT * FROM lm UNION ALL SELECT {lead}metric, 'all', avg(score) FROM lm GROUP BY {lead}metric)"""


CLASSES = "(VALUES " + ", ".join(f"({quoted(c)})" for c in [*catalog.LABELS, "ces_Latn", "rus_Cyrl"]) + ") AS lab(label)"


def accuracy(test: str) -> str:
    return f"""WITH {JUDGED}
SELECT source, count(*) AS n_items, round(avg(CASE WHEN {test} THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy
FROM items GROUP BY source"""


def digest(*keys: str) -> str:
    return f"md5(concat_ws('|', '{SEED}', {', '.join(keys)}))"


def u(*keys: str) -> str:
    return f"((('0x' || substr({digest(*keys)}, 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def draw(low: str, high: str, *keys: str) -> str:
    return f"({low} + floor({u(*keys)} * ({high} - {low} + 1)))::BIGINT"


INDEXED = f"""
n_docs AS (SELECT count(*) AS n FROM documents),
idx AS (SELECT row_number() OVER (ORDER BY {digest('doc_id')}, doc_id) - 1 AS row_idx, * FROM documents)"""


def planned(m: str = "n") -> str:
    return f"""{INDEXED},
plan AS (
  SELECT row_no, CASE WHEN slot < 4 THEN 'mixed' WHEN slot < 8 THEN 'transliterated' ELSE 'random' END AS kind
  FROM (SELECT r AS row_no, floor(r * 9 / {m}) AS slot FROM n_docs, unnest(range(({m})::BIGINT)) AS t(r)))"""


def mixed_sql(m: str = "n") -> str:
    words = "CASE WHEN contains(text, ' ') THEN list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') ELSE string_split(text, '') END"
    return f"""{planned(m)},
picks AS (
  SELECT row_no, part, {LABEL} AS lang, {words} AS w
  FROM (SELECT row_no, part, floor({u("'row'", 'row_no', 'part')} * n)::BIGINT AS row_idx FROM plan, n_docs, (VALUES (0), (1)) p(part) WHERE kind = 'mixed')
  JOIN idx USING (row_idx)),
sizes AS (
  SELECT *, len(w) AS nw, {draw('greatest(1, len(w) // 2)', '(len(w) - 1)', "'size'", 'row_no', 'part')} AS size FROM picks),
frags AS (
  SELECT *, CASE WHEN nw > 3 THEN w[{draw('0', '(nw - size)', "'start'", 'row_no', 'part')} + 1 : {draw('0', '(nw - size)', "'start'", 'row_no', 'part')} + size] ELSE w END AS f FROM sizes),
mixed AS (
  SELECT row_no, array_to_string(flatten(list(f ORDER BY part)), ' ') AS text,
    array_to_string(list_sort(list_distinct(list(lang))), ',') AS gold
  FROM frags GROUP BY row_no)"""


def random_sql() -> str:
    def chars(alphabet: str, count: str, name: str) -> str:
        position = draw("1", str(len(alphabet)), f"'{name}'", "row_no", "i", "k")
        return (
            f"(SELECT string_agg(substr({quoted(alphabet)}, {position}, 1), '' ORDER BY k) FROM unnest(range(1, {count} + 1)) t(k))"
        )

    keys = ("row_no", "i")
    punct = draw("1", str(len(string.punctuation)), "'punct'", *keys)
    return f"""{planned()},
items AS (
  SELECT row_no, unnest(range(1, {draw('1', '10', "'words'", 'row_no')} + 1)) AS i FROM plan WHERE kind = 'random'),
tokens AS (
  SELECT row_no, i, {u("'number?'", *keys)} < 0.05 AS is_number,
    {chars(string.digits, draw('1', '5', "'digits'", *keys), 'digit')} AS number,
    {chars(string.ascii_lowercase, draw('2', '7', "'letters'", *keys), 'letter')}
      || CASE WHEN {u("'punct?'", *keys)} < 0.1 THEN substr({quoted(string.punctuation)}, {punct}, 1) ELSE '' END AS word
  FROM items),
titled AS (
  SELECT row_no, i, CASE WHEN is_number THEN number WHEN {u("'title?'", *keys)} < 0.1 THEN upper(word[1]) || substr(word, 2) ELSE word END AS token FROM tokens),
first_titled AS (
  SELECT row_no, i, CASE WHEN i = 1 AND {u("'first?'", 'row_no')} < 0.5 THEN upper(token[1]) || substr(token, 2) ELSE token END AS token FROM titled)
SELECT row_no, string_agg(token, ' ' ORDER BY i) AS text, '' AS gold FROM first_titled GROUP BY row_no"""


GRAMS = """
clean AS (SELECT doc_id, regexp_replace(lower(text), '\\s\\s+', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL),
grams AS (SELECT doc_id, unnest(list_transform(range(1, length(t) - 4), lambda i: substr(t, i, 6))) AS ngram FROM clean),
tf AS (SELECT doc_id, ngram, count(*) AS tf FROM grams GROUP BY ALL),
vocab AS (
  SELECT ngram, count(*) AS df FROM tf GROUP BY ngram
  HAVING count(*) >= 5 AND count(*) <= 0.5 * (SELECT count(*) FROM documents))"""

TURN_SCORES = scored("SELECT conv_id, turn, role, text FROM conversations", "conv_id, turn, role")
TURNS = f"""{TURN_SCORES},
gold_turn AS (
  SELECT conv_id, min(gold) AS gold FROM (
    SELECT conv_id, role, coalesce(list(label ORDER BY label) FILTER (WHERE score >= 0.5), []) AS gold
    FROM scored WHERE turn = 0 GROUP BY conv_id, role)
  GROUP BY conv_id),
items AS (
  SELECT role AS l1, turn::VARCHAR AS l2, conv_id AS pos, pred, coalesce(gold, []) AS gold FROM (
    SELECT conv_id, turn, role, coalesce(list(label ORDER BY score DESC, label) FILTER (WHERE score > {catalog.THRESHOLD}), []) AS pred
    FROM scored GROUP BY conv_id, turn, role) LEFT JOIN gold_turn USING (conv_id))"""
LEVELS = f"""{TURNS.replace('items AS', 'leaves AS')},
items AS (
  SELECT 'leaf' AS level, l1, l2, pred, gold FROM leaves UNION ALL
  SELECT 'parent', l1, NULL, pred, gold FROM leaves UNION ALL
  SELECT 'overall', NULL, NULL, pred, gold FROM leaves)"""
LOOSE = "((len(pred) = 0 AND len(gold) = 0) OR len(list_intersect(pred, gold)) > 0)"
EXACT = "(list_sort(list_distinct(pred)) = list_sort(list_distinct(gold)))"

CENTROIDS = """
dims AS (SELECT label::VARCHAR AS label, unnest(range(len(embedding))) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings),
centroid AS (SELECT label, d, avg(x) AS x FROM dims GROUP BY ALL)"""


def scaled(name: str, pairs: str) -> str:
    return f"""
{name}_raw AS ({pairs}),
{name} AS (
  SELECT label_a, label_b, CASE WHEN max(v) OVER w = min(v) OVER w THEN 0 ELSE (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) END AS sim
  FROM {name}_raw WINDOW w AS (PARTITION BY label_a))"""


SIMILARITY = CENTROIDS + "," + scaled(
    "sims", "SELECT a.label AS label_a, b.label AS label_b, sum(a.x * b.x) AS v FROM centroid a JOIN centroid b USING (d) GROUP BY ALL"
)
CLASS_VALUES = "(SELECT DISTINCT label::VARCHAR AS label FROM embeddings WHERE label IS NOT NULL) AS cls"


def negatives(id_col: str, ratio: float) -> str:
    """CTE ``negs`` (id, label) drawn for ``items`` (id, gold)."""
    return f"""
cand AS (
  SELECT i.{id_col}, i.gold, c.label,
    1 - coalesce((SELECT sum(s.sim) FROM sims s WHERE s.label_b = c.label AND list_contains(i.gold, s.label_a)), 0) / greatest(len(i.gold), 1) AS w
  FROM items i, {CLASS_VALUES.replace('cls', 'c')} WHERE NOT list_contains(i.gold, c.label)),
keyed AS (
  SELECT *, CASE WHEN sum(w) OVER (PARTITION BY {id_col}) = 0 THEN -ln({u(id_col, 'label')})
    WHEN w = 0 THEN 'Infinity'::DOUBLE ELSE -ln({u(id_col, 'label')}) / w END AS k FROM cand),
negs AS (
  SELECT {id_col}, label FROM (
    SELECT *, row_number() OVER (PARTITION BY {id_col} ORDER BY k, label) AS rn FROM keyed)
  WHERE rn <= floor(greatest(len(gold), 1) * {ratio}))"""


HEX = "lower(hex(encode(text)))"
IDS = "list_append(list_transform(regexp_extract_all(lower(hex(encode(text))), '..'), lambda x: ('0x' || x)::INT + 3), 1)"


def rewrite(digits: str, rules: dict[str, str]) -> str:
    ordered = sorted(rules, key=len, reverse=True)
    pattern = "|".join(r.replace(" ", "") for r in ordered)
    table = case("x", {k.replace(" ", ""): v.replace(" ", "") for k, v in rules.items()}, "x")
    return f"array_to_string(list_transform(regexp_extract_all({digits}, '({pattern}|..)', 1), lambda x: {table}), '')"


def reverse(rules: dict[str, str]) -> dict[str, str]:
    return {target: source for source, target in rules.items()}


def profile_sql(step: int) -> str:
    overs = ", ".join(f"count(*) FILTER (WHERE length(text) > {k}) AS over_{k}" for k in (1024, 512, 256))
    shares = ", ".join(f"round(over_{k} * {step} * 100.0::DOUBLE / n, 6) AS percent_over_{k}" for k in (1024, 512, 256))
    return f"""WITH {INDEXED},
p AS (SELECT count(*) AS n_texts, max(length(text)) AS longest, {overs} FROM idx WHERE row_idx % {step} = 0 AND text <> '')
SELECT p.*, {shares} FROM p, n_docs"""


def tier_of(column: str) -> str:
    """Tiers of the languages that stand in for those of the tables."""
    return f"(CASE {column} WHEN 'nld' THEN 4 WHEN 'eng' THEN 5 WHEN 'kin' THEN 1 WHEN 'glg' THEN 3 END)::BIGINT"


TIERED = f"""{DOC_ITEMS}, {counts('source')}, {long_metrics('source')},
tm AS (SELECT source, metric, left({case('label', catalog.TIER_LABELS)}, 3) AS iso, score FROM met WHERE label <> 'all')"""


def statements() -> dict[str, str]:
    score_text = "label || ':' || round(score * 1000000)::BIGINT"
    sql = {
        "per_label_prf": f"WITH {DOC_ITEMS}, {counts()}, {long_metrics()} SELECT metric, label, round(score, 6) AS score FROM met",
        "fpr_by_label": f"""WITH {SINGLE}, items AS (SELECT [gold] AS gold, [pred] AS pred FROM single WHERE pred IS NOT NULL), {counts()}
SELECT label, tp, fp, fn, tn, round({FPR}, 6) AS fpr FROM cnt WHERE tp + fp + fn > 0""",
        "micro_macro": f"""WITH {JUDGED}, {counts(labels=CLASSES)},
tot AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg({F1}) AS f1_macro, avg({P}) AS precision_macro, avg({R}) AS recall_macro FROM cnt)
SELECT round({F1}, 6)::DOUBLE AS f1_micro, round(f1_macro, 6) AS f1_macro, round({P}, 6)::DOUBLE AS precision_micro,
  round(precision_macro, 6) AS precision_macro, round({R}, 6)::DOUBLE AS recall_micro, round(recall_macro, 6) AS recall_macro FROM tot""",
        "hamming": f"WITH {JUDGED}, {counts(labels=CLASSES)} SELECT round(sum(fp + fn) / sum(n_items), 6)::DOUBLE AS hamming_loss FROM cnt",
        "fixed_label_f1": f"""WITH {JUDGED}, {counts(labels=CLASSES.replace("('ces_Latn'), ('rus_Cyrl')", "('dan_Latn')"))}
SELECT label, round({F1}, 6)::DOUBLE AS f1 FROM cnt""",
        "loose_overlap": accuracy(LOOSE),
        "loose_overlap_strict": accuracy("len(list_intersect(pred, gold)) > 0"),
        "loose_subset": accuracy("len(list_filter(pred, lambda x: NOT list_contains(gold, x))) = 0"),
        "exact_set": accuracy(EXACT),
        "exact_ordered": accuracy("pred = gold"),
        "membership_accuracy": f"""WITH {predicted('''SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS code, html AS text FROM pages''', "page_id, code")}
SELECT code, count(*) FILTER (WHERE list_contains(pred, {case('code', catalog.LANGUAGES)})) AS correct, count(*) AS total,
  round(count(*) FILTER (WHERE list_contains(pred, {case('code', catalog.LANGUAGES)})) / count(*), 6) AS accuracy FROM pred GROUP BY code""",
        "hierarchy_rollup": f"""WITH {LEVELS}, {counts('level, l1, l2')}
SELECT level, l1, l2, '*' AS label, count(*)::DOUBLE AS a, round(avg(CASE WHEN {LOOSE} THEN 1.0::DOUBLE ELSE 0 END), 6) AS b,
  round(avg(CASE WHEN {EXACT} THEN 1.0::DOUBLE ELSE 0 END), 6) AS c FROM items GROUP BY level, l1, l2
UNION ALL SELECT level, l1, l2, label, round({F1}, 6)::DOUBLE, round({P}, 6)::DOUBLE, round({R}, 6)::DOUBLE FROM cnt WHERE tp + fn > 0""",
        "section_report": f"""WITH {LEVELS},
names AS (SELECT *, CASE level WHEN 'leaf' THEN l1 || '/' || l2 WHEN 'parent' THEN l1 || ' (combined)' ELSE 'Overall' END AS section FROM items)
SELECT section, count(*) AS n_items, round(avg(CASE WHEN {LOOSE} THEN 1.0::DOUBLE ELSE 0 END), 4) AS loose_accuracy,
  round(avg(CASE WHEN {EXACT} THEN 1.0::DOUBLE ELSE 0 END), 4) AS exact_accuracy,
  array_to_string(list_sort(list_distinct(flatten(list(gold)))), ',') AS labels FROM names GROUP BY section""",
        "instance_dump": f"WITH {TURNS} SELECT l1, l2, pos, array_to_string(pred, ',') AS pred, array_to_string(gold, ',') AS gold FROM items",
        "nested_sections": """SELECT role AS l1, CASE WHEN conv_id % 2 = 1 THEN turn::VARCHAR ELSE 'part/' || turn END AS l2, count(*) AS n,
  sum(length(line))::BIGINT AS n_chars, sum(pos)::BIGINT AS pos_sum, count(*) AS n_labels
FROM (SELECT *, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM conversations) GROUP BY 1, 2""",
        "large_sections": """SELECT role AS l1, CASE WHEN conv_id % 2 = 1 THEN turn::VARCHAR ELSE 'part/' || turn END AS l2, md5(text) AS digest,
  count(*) AS n, count(*) AS n_labels FROM conversations GROUP BY 1, 2, 3""",
        "quoted_tsv": f"""SELECT CASE lang {' '.join(f"WHEN '{code}' THEN '{label}'" for code, label in sorted(catalog.LANGUAGES.items()))} END AS gold,
  md5(text) AS digest, count(*) AS n FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2""",
        "confusion_long": f"WITH {SINGLE} SELECT gold, pred, count(*) AS n FROM single WHERE pred IS NOT NULL GROUP BY gold, pred",
        "single_accuracy": f"WITH {SINGLE} SELECT round(avg(CASE WHEN pred = gold THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM single",
        "confusion_multilabel": f"""WITH {DOC_ITEMS},
r AS (SELECT lang AS gold, CASE WHEN list_contains(pred, lang) THEN lang ELSE list_sort(pred)[1] END AS p FROM items WHERE len(pred) > 0)
SELECT label AS gold, {', '.join(f"count(*) FILTER (WHERE p = '{label}') AS {label}" for label in [*catalog.LABELS, 'rus_Cyrl'])}
FROM {CLASSES.replace("('ces_Latn'), ", "")} LEFT JOIN r ON gold = label GROUP BY label""",
        "classification_report": f"""WITH {SINGLE},
items AS (SELECT [gold] AS gold, CASE WHEN pred IS NULL THEN [] ELSE [pred] END AS pred FROM single), {counts()},
pc AS (SELECT label AS class, ({P})::DOUBLE AS precision, ({R})::DOUBLE AS recall, ({F1})::DOUBLE AS f1, tp + fn AS support, tp, n_items FROM cnt),
rep AS (
  SELECT class, precision, recall, f1, support FROM pc UNION ALL
  SELECT 'accuracy', sum(tp) / max(n_items), sum(tp) / max(n_items), sum(tp) / max(n_items), sum(support) FROM pc UNION ALL
  SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM pc UNION ALL
  SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM pc)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM rep""",
        "language_counts_topn": f"""WITH {DOC_ITEMS} SELECT label, count(*) AS n FROM (SELECT unnest(pred) AS label FROM items)
GROUP BY label ORDER BY n DESC, label LIMIT 3""",
        "topk_scores": f"""WITH {scored("SELECT doc_id, text FROM documents WHERE text IS NOT NULL", "doc_id")},
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS rn FROM scored),
agg AS (
  SELECT doc_id, max(label) FILTER (WHERE rn = 1) AS prediction, round(max(score), 6) AS confidence,
    round(max(score) FILTER (WHERE label = 'fra_Latn'), 6) AS p_french,
    string_agg({score_text}, ',' ORDER BY rn) FILTER (WHERE rn <= 3) AS top3,
    coalesce(string_agg({score_text}, ',' ORDER BY label) FILTER (WHERE score > 0.25), '') AS above,
    coalesce(string_agg({score_text}, ',' ORDER BY label) FILTER (WHERE score >= 0.25), '') AS at_least
  FROM ranked GROUP BY doc_id)
SELECT agg.*, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS preview FROM agg JOIN documents USING (doc_id)""",
        "masked_bce": f"""WITH {SIMILARITY},
vec AS (SELECT vec_id, label::VARCHAR AS gold_label, unnest(range(len(embedding))) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings),
logits AS (SELECT vec_id, gold_label, c.label, sum(vec.x * c.x) AS z FROM vec JOIN centroid c USING (d) GROUP BY ALL),
items AS (SELECT vec_id, [label::VARCHAR] AS gold FROM embeddings), {negatives('vec_id', 5.0)},
kept AS (
  SELECT z, CASE WHEN label = gold_label THEN 1.0::DOUBLE ELSE 0 END AS y FROM logits
  WHERE label = gold_label OR (vec_id, label) IN (SELECT vec_id, label FROM negs))
SELECT count(*) AS n_terms, round(avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))), 5) AS loss FROM kept""",
        "positive_logits": f"""WITH {CENTROIDS},
vec AS (SELECT vec_id, unnest(range(len(embedding))) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings),
logits AS (SELECT vec_id, c.label, sum(vec.x * c.x) AS z FROM vec JOIN centroid c USING (d) GROUP BY ALL)
SELECT vec_id, count(*) FILTER (WHERE z > 0) AS n_positive, round(max(1 / (1 + exp(-z))), 5) AS top_sigmoid,
  round(max(exp(z)) / sum(exp(z)), 5) AS top_softmax FROM logits GROUP BY vec_id""",
        "tier_average": f"""WITH {TIERED}
SELECT source, metric, {tier_of('iso')} AS tier, round(avg(score), 6) AS score FROM tm GROUP BY source, metric, {tier_of('iso')}""",
        "speaker_weighted": f"""WITH {TIERED},
vol AS (SELECT left({case(LABEL, catalog.TIER_LABELS)}, 3) AS iso, sum(length(text)) AS n FROM documents GROUP BY 1),
spk AS (SELECT iso, CASE WHEN iso = 'kin' THEN 0 ELSE n END AS n FROM vol),
wts AS (SELECT iso, n / (SELECT sum(n) FROM spk) AS w FROM spk)
SELECT source, metric, round(sum(score * coalesce(w, 0)), 6) AS score FROM tm LEFT JOIN wts USING (iso) GROUP BY source, metric""",
        "latest_speakers": f"""SELECT iso, CASE iso WHEN 'eng' THEN 'English' WHEN 'kin' THEN 'Kinyarwanda' ELSE 'Unknown' END AS name,
  CASE iso WHEN 'eng' THEN 5 WHEN 'nld' THEN 4 WHEN 'kin' THEN 1 WHEN 'glg' THEN 0 END::BIGINT AS tier, n_chars AS speakers
FROM (SELECT CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'nld' WHEN 'fr' THEN 'kin' WHEN 'es' THEN 'glg' END AS iso, n_chars, row_number() OVER (PARTITION BY lang ORDER BY source DESC, doc_id) AS rn FROM documents) WHERE rn = 1""",
        "label_canonicalise": f"""SELECT CASE WHEN source < 'src2' THEN {LABEL} END AS canonical,
  CASE WHEN source = 'src9' THEN 'co' ELSE lang END AS raw, CASE WHEN source = 'src9' THEN NULL ELSE {LABEL} END AS label, count(*) AS n
FROM documents GROUP BY ALL""",
        "label_arrays": f"""WITH w AS (
  SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS code FROM documents WHERE lang IN ('en', 'es')),
m AS (SELECT doc_id, {case('code', {'is': 'isl_Latn', **seeds.BCMS_CODES, 'be': 'bel_Cyrl', 'es': 'spa_Latn', 'el': 'ell_Grek'})} AS label FROM w),
c AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS class_idx FROM (SELECT DISTINCT label FROM m WHERE label IS NOT NULL))
SELECT doc_id, class_idx FROM m JOIN c USING (label)""",
        "class_index": f"""SELECT doc_id, list_position({sql_list(catalog.LABELS)}, {LABEL})::BIGINT - 1 AS class_idx,
  array_to_string(list_transform({sql_list(catalog.LABELS)}, lambda x: CASE WHEN x = {LABEL} THEN 1 ELSE 0 END), '') AS multi_hot FROM documents""",
        "unpivot_parallel": f"""SELECT {LABEL} AS lang, count(*) AS n_texts, sum(length(text))::BIGINT AS n_chars FROM documents
WHERE lang <> 'es' AND text IS NOT NULL GROUP BY 1""",
        "length_profile": profile_sql(1),
        "systematic_profile": profile_sql(100),
        "length_histogram": """SELECT b AS bin, b * 100 AS low, b * 100 + 100 AS high,
  (SELECT count(*) FROM documents WHERE text <> '' AND ((length(text) >= b * 100 AND length(text) < b * 100 + 100) OR (b = 20 AND length(text) = 2100))) AS n
FROM unnest(range(21)) AS t(b)""",
        "cap_per_language": f"""SELECT doc_id, lang, md5(text) AS text_md5 FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {digest('doc_id')}, doc_id) AS rn FROM documents) WHERE rn <= 120""",
        "train_eval_split": f"""SELECT doc_id, lang, CASE WHEN row_idx < ceil(n * 0.05::DOUBLE) THEN 'eval' ELSE 'train' END AS split
FROM (WITH {INDEXED} SELECT * FROM idx, n_docs)""",
        "train_without_eval": "SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang",
        "texts_by_language": "SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n_texts FROM documents WHERE text IS NOT NULL",
        "dense_index": f"WITH {INDEXED} SELECT doc_id, row_idx FROM idx",
        "line_predictions": f"""WITH {predicted('''SELECT row_number() OVER () AS id, text FROM (
    SELECT trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS text FROM documents) WHERE text <> '' ''', "id, text")}
SELECT array_to_string(pred, ',') AS pred, count(*) AS n_lines, sum(length(text))::BIGINT AS n_chars FROM pred GROUP BY 1""",
        "named_predictions": f"""WITH {predicted('''SELECT row_number() OVER () AS id, text, lang FROM (
    SELECT lang, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS text FROM documents WHERE lang IS NOT NULL) WHERE text <> '' ''', "id, text, lang")}
SELECT lang, array_to_string(pred, ',') AS pred, count(*) AS n_lines, sum(length(text))::BIGINT AS n_chars, 0 AS n_unnamed FROM pred GROUP BY 1, 2""",
        "ngram_df": f"WITH {GRAMS} SELECT ngram, df FROM vocab",
        "tfidf_weights": f"""WITH {GRAMS},
raw AS (
  SELECT doc_id, ngram, (1 + ln(tf::DOUBLE)) * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w
  FROM tf JOIN vocab USING (ngram), (SELECT count(*) AS n FROM documents))
SELECT doc_id, ngram, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw""",
        "synthetic_random": f"WITH {random_sql()}",
        "synthetic_mixed": f"WITH {mixed_sql()} SELECT row_no, text, gold FROM mixed",
        "synthetic_transliterated": f"""WITH {planned()}
SELECT row_no, strip_accents(replace(text, 'ß', 'ss')) AS text, {LABEL} AS gold
FROM (SELECT row_no, floor({u("'row'", 'row_no', '0')} * n)::BIGINT AS row_idx FROM plan, n_docs WHERE kind = 'transliterated') JOIN idx USING (row_idx)""",
        "spelled_alphabets": """SELECT doc_id, md5(t) AS digest, length(t) AS n_chars
FROM (SELECT doc_id, strip_accents(replace(text, 'ß', 'ss')) AS t FROM documents WHERE text IS NOT NULL)""",
        "extended_corpus": f"""WITH {mixed_sql('floor(n * 0.5)')}
SELECT 'real' AS kind, 1::BIGINT AS n_labels, count(*) AS n FROM documents UNION ALL
SELECT 'mixed', len(string_split(gold, ','))::BIGINT, count(*) FROM mixed GROUP BY 2 UNION ALL
SELECT kind, CASE kind WHEN 'random' THEN 0 ELSE 1 END, count(*) FROM plan WHERE kind <> 'mixed' GROUP BY kind""",
        "class_similarity": f"""WITH {CENTROIDS},
known AS (SELECT label, d, CASE WHEN label IN ('3', '7') THEN 0 ELSE x END AS x FROM centroid),
{scaled('main', 'SELECT a.label AS label_a, b.label AS label_b, sum(a.x * b.x) AS v FROM known a JOIN known b USING (d) GROUP BY ALL')},
{scaled('back', 'SELECT a.label AS label_a, b.label AS label_b, sum(a.x * b.x) AS v FROM centroid a JOIN centroid b USING (d) WHERE d < 16 GROUP BY ALL')}
SELECT label_a, label_b, round(CASE WHEN label_a IN ('3', '7') OR label_b IN ('3', '7') THEN back.sim ELSE main.sim END, 5)::DOUBLE AS sim
FROM main JOIN back USING (label_a, label_b)""",
        "negative_samples": f"""WITH {JUDGED.replace('items AS', 'judged AS')},
{SIMILARITY},
items AS (SELECT doc_id, list_transform(gold, lambda g: {case('g', {label: str(i) for i, label in enumerate(catalog.LABELS)})}) AS gold FROM judged),
{negatives('doc_id', 2.0)}
SELECT doc_id, string_agg(label, ',' ORDER BY label) AS negatives FROM negs GROUP BY doc_id""",
        "byte_token_corpus": f"""SELECT doc_id, len(ids)::BIGINT AS n_ids, md5(array_to_string(ids, ' ')) AS ids_md5,
  octet_length(encode(text))::BIGINT + 1 AS n_bytes_and_end FROM (SELECT doc_id, text, {IDS} AS ids FROM documents)""",
        "pad_truncate": f"""SELECT doc_id, 512::BIGINT AS n_ids, least(len(ids), 512)::BIGINT AS n_real,
  md5(array_to_string(list_concat(ids[1:512], list_transform(range(greatest(0, 512 - len(ids))), lambda x: 0)), ' ')) AS ids_md5
FROM (SELECT doc_id, {IDS} AS ids FROM documents)""",
        "byte_rewrite": f"""SELECT doc_id, (length(h) // 2)::BIGINT AS n_tokens, md5(h) AS tokens_md5,
  {rewrite(rewrite('h', reverse(catalog.MERGE)), reverse(catalog.DECOMPOSE))} = {HEX} AS round_trip
FROM (SELECT doc_id, text, {rewrite('d', catalog.MERGE)} AS h FROM (SELECT doc_id, text, {rewrite(HEX, catalog.DECOMPOSE)} AS d FROM documents))""",
        "failing_scorer": """SELECT doc_id, text IS NULL OR length(text) % 20 = 0 AS failed,
  CASE WHEN length(text) % 20 = 0 THEN 'ValueError: cannot read ' || length(text) || ' characters' END AS error,
  CASE WHEN text IS NULL OR length(text) % 20 = 0 THEN ''
    ELSE concat_ws(',', CASE WHEN share <= 1 - share THEN 'others' END, CASE WHEN share > 0.15 THEN 'spaces' END, CASE WHEN share > 1 - share AND 1 - share > 0.15 THEN 'others' END) END AS pred
FROM (SELECT doc_id, text, (length(text) - length(replace(text, ' ', '')))::DOUBLE / nullif(length(text), 0) AS share FROM documents)""",
        "stream_scores": f"WITH {DOC_PRED} SELECT doc_id, array_to_string(pred, ',') AS pred FROM pred",
        "stream_counts": f"WITH {DOC_PRED} SELECT label, count(*) AS n FROM (SELECT unnest(pred) AS label FROM pred) GROUP BY label",
    }
    return sql
