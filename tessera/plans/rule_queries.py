"""Queries of the decision rules over rows derived from tables; their SQL computes the answers by itself.

The texts are built from keys of orders, customers and order lines by expressions that mean the same in Spark and in the
SQL, beside some literal edge cases; what a rule makes of them is written twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import rules as R
from ..functions import text as X
from ..operators.joins import membership
from .base import dealt, literal, sql_values, table


def _derived(spark, d: str, name: str, exprs: dict[str, str], rows: list[tuple], schema: str) -> DataFrame:
    """Distinct rows of expressions over a table, and literal ones."""
    made = table(spark, d, name).select(*[F.expr(e).alias(c) for c, e in exprs.items()]).distinct()
    return made.unionByName(literal(spark, rows, schema))


def _sql_derived(name: str, exprs: dict[str, str], rows: list[tuple]) -> str:
    return f"(SELECT DISTINCT {', '.join(f'{e} AS {c}' for c, e in exprs.items())} FROM {name} UNION ALL SELECT * FROM {sql_values(rows, list(exprs))})"


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _list(words) -> str:
    return "[" + _in(words)[1:-1] + "]"


def _case(key: str, values: list[str]) -> str:
    return f"CASE {key} " + " ".join("WHEN {} THEN '{}'".format(i, v.replace("'", "''")) for i, v in enumerate(values)) + " END"


def _sql_values_of(x: str) -> str:
    """The values of a number as written, as a list of SQL."""
    word = f"regexp_replace(lower(trim({x})), '^\\.+|\\.+$', '', 'g')"
    spoken = f"(CASE {word} " + " ".join(f"WHEN '{w}' THEN {v}" for w, v in L.WORD_NUMBERS.items()) + " END)"
    bare = f"regexp_replace(regexp_replace(trim({x}), '[$,%]', '', 'g'), '(?i)percent', '', 'g')"
    base = f"(round(TRY_CAST(nullif(regexp_extract({bare}, '-?\\d+(?:\\.\\d+)?'), '') AS DOUBLE), 6) + 0::DOUBLE)"  # no negative zero
    part = f"(contains({x}, '%') OR ends_with(lower(trim({x})), 'percent'))"
    return (
        f"(CASE WHEN trim({x}) = '' THEN [] WHEN {spoken} IS NOT NULL THEN [{spoken}::DOUBLE] WHEN {base} IS NULL THEN [] "
        f"WHEN {part} AND round({base} / 100, 6) <> {base} THEN [{base}, round({base} / 100, 6)] ELSE [{base}] END::DOUBLE[])"
    )


# ---- values of numbers

_WRITTEN = """CASE l_linenumber % 6 WHEN 0 THEN concat('$', CAST(floor(l_extendedprice) AS BIGINT)) WHEN 1 THEN concat(CAST(floor(l_quantity) AS BIGINT), '%') WHEN 2 THEN concat(l_suppkey % 90, ' percent')
WHEN 3 THEN concat('-', l_partkey) WHEN 4 THEN concat(l_partkey % 9 + 1, ',', l_suppkey % 900 + 100, '.50') ELSE concat(l_linenumber, '.', l_suppkey % 90 + 10) END"""
_NUMBERS = [("$1,000",), ("50%",), ("twelve",), ("3.0",), ("abc",), ("",), ("12 percent",), ("-7",), ("Dozen.",), ("1,234.50",), ("0%",)]


def number_values(spark, d):
    """The values of numbers as they are written: money, percentages, words, thousands."""
    v = X.number_values(F.col("raw"))
    rows = _derived(spark, d, "lineitem", {"raw": _WRITTEN}, _NUMBERS, "raw string").distinct()
    return rows.select("raw", F.size(v).cast("long").alias("n"), F.try_element_at(v, F.lit(1)).alias("first"), F.try_element_at(v, F.lit(2)).alias("second"))


NUMBER_VALUES = f"SELECT raw, len(v)::BIGINT AS n, v[1] AS first, v[2] AS second FROM (SELECT raw, {_sql_values_of('raw')} AS v FROM (SELECT DISTINCT raw FROM {_sql_derived('lineitem', {'raw': _WRITTEN}, _NUMBERS)}))"

# ---- answers

_X, _Y = "substr('ABCDEFG', CAST(1 + o_custkey % 7 AS INT), 1)", "substr('ABCD', CAST(1 + o_orderkey % 4 AS INT), 1)"
_SAID = f"""CASE o_orderkey % 7 WHEN 0 THEN concat('Answer: ', {_X}, ', then final answer: ', {_Y}) WHEN 1 THEN concat('I would say (', lower({_Y}), ').') WHEN 2 THEN concat('no idea: ', o_orderpriority)
WHEN 3 THEN concat({_Y}, ' or ', {_X}) WHEN 4 THEN concat('so #### ', o_custkey, ',000 apples') WHEN 5 THEN concat('it is ', o_custkey, ' and then ', o_orderkey % 50, '.50') ELSE concat('final answer: ', {_X}, ' as 3 > 2 #### -', o_orderkey % 90) END"""
_ANSWERS = [(-1, "Answer: b, then final answer: C"), (-2, "I would say (d)."), (-3, "no idea"), (-4, "A or B"), (-5, "#### 1,200 apples"), (-6, "it is 3 and then 4.50"), (-7, "")]
_ANSWER_OF = {"id": "o_orderkey", "text": _SAID}


def answers(spark, d):
    """Option letters and final numbers that texts state, with where the number stands."""
    rows = _derived(spark, d, "orders", _ANSWER_OF, _ANSWERS, "id long, text string")
    option, final = X.option_answer(F.col("text"), list("ABCD")), X.final_answer(F.col("text"))
    return rows.select("id", option["label"].alias("label"), option["method"].alias("method"), final["answer"].alias("answer"), X.normal_number(final["answer"]).alias("normal"), final["start"].alias("start"))


_PLAIN = r"[-+]?\d[\d,]*(?:\.\d+)?"
ANSWERS_SQL = rf"""
WITH r AS {_sql_derived('orders', _ANSWER_OF, _ANSWERS)},
m AS (SELECT *, list_filter(regexp_extract_all(text, '(?i)\b(?:final\s+)?answer\s*:\s*([A-Z])\b', 1), lambda x: upper(x) IN ('A', 'B', 'C', 'D')) AS explicit,
  regexp_extract(text, '(?is)(?:^|[^A-Za-z])([ABCD])[\s.,;:!?()\[\]{{}}]*$', 1) AS letter,
  CASE WHEN regexp_matches(text, '####\s*{_PLAIN}') THEN '####\s*{_PLAIN}' ELSE '{_PLAIN}' END AS p FROM r),
n AS (SELECT *, regexp_extract_all(text, '####\s*({_PLAIN})', 1)[-1] AS marked, regexp_extract_all(text, '{_PLAIN}')[-1] AS last,
  length(CASE WHEN p LIKE '#%' THEN string_split_regex(text, '####\s*{_PLAIN}') ELSE string_split_regex(text, '{_PLAIN}') END[-1]) AS rest FROM m),
a AS (SELECT *, coalesce(marked, last) AS answer, regexp_replace(replace(trim(coalesce(marked, last)), ',', ''), '^[$% .,]+|[$% .,]+$', '', 'g') AS bare FROM n)
SELECT id, CASE WHEN len(explicit) > 0 THEN upper(explicit[-1]) WHEN letter <> '' THEN upper(letter) END AS label,
  CASE WHEN len(explicit) > 0 THEN 'explicit_answer_marker' WHEN letter <> '' THEN 'last_isolated_label' ELSE 'parse_failure' END AS method, answer,
  CASE WHEN TRY_CAST(bare AS DOUBLE) = round(TRY_CAST(bare AS DOUBLE)) THEN CAST(CAST(bare AS DOUBLE)::BIGINT AS VARCHAR) ELSE coalesce(CAST(TRY_CAST(bare AS DOUBLE) AS VARCHAR), lower(bare)) END AS normal,
  CAST(length(text) - rest - length(answer) AS INTEGER) AS start FROM a
"""

# ---- numbers on the path of a solution

_A, _B, _C = "o_orderkey % 50 + 1", "o_custkey % 9 + 1", "o_orderkey % 7"
_PATH = {
    "grp": "o_orderkey % 5", "id": "o_orderkey",
    "question": f"concat('Tom has ', {_A}, ' apples, buys ', {_B}, ', sells ', {_C}, ', sees ', o_custkey % 11, ' and ', {_A} + {_B}, '.')",
    "solution": f"concat('<<', {_A}, '+', {_B}, '=', {_A} + {_B}, '>> then <<', {_A} + {_B} + 100, '*', {_C}, '=', ({_A} + {_B} + 100) * ({_C}), '>>')",
}
_SOLVED = [(101, 1, "Tom has 3 apples, buys 5, sells 2, sees 9.", "He has <<3+5=8>>8 and sells <<8-2=6>>6"), (102, 2, "10 and 10 or 5", "<<10*0.5=5>>"), (103, 3, "7", "")]


def solution_path(spark, d):
    """Numbers of questions, on or off the path of their solutions: how many of each, and the sum of their places."""
    made = table(spark, d, "orders").select(*[F.expr(e).alias(c) for c, e in _PATH.items()], F.lit(0).alias("from_"))
    said = literal(spark, _SOLVED, "grp long, id long, question string, solution string").withColumn("from_", F.lit(1))
    # dealt once by id: rows are made distinct and numbers are counted in place
    rows = dealt(made.unionByName(said), "id").distinct().withColumn("s", X.solution_values(F.col("solution")))
    numbers = rows.select("grp", "id", "s", F.inline(X.matches(F.col("question"), L.ARABIC_NUMBER))).withColumn("v", X.number_values(F.col("text")))
    alone = numbers.select("grp", "id", F.col("v")[0].alias("first"), "start", X.path_status(F.col("v"), F.lit(1), F.col("s.operands"), F.col("s.results")).alias("alone"))
    # a number on the path that stands in several places is ambiguous
    times = F.count(F.lit(1)).over(Window.partitionBy("grp", "id", "first"))
    told = alone.withColumn("times", times).withColumn("status", F.when((F.col("alone") == "on_solution_path_number") & (F.col("times") > 1), "ambiguous_number").otherwise(F.col("alone")))
    return told.groupBy("grp", "status").agg(F.count(F.lit(1)).alias("numbers"), F.sum("start").cast("long").alias("starts"))


_N = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"


def _side(at: int) -> str:
    return f"list_transform(flatten(list_transform(regexp_extract_all(solution, '<<([^>]*)>>', 1), lambda x: regexp_extract_all(split_part(x, '=', {at}), '{_N}'))), lambda x: replace(x, ',', '')::DOUBLE)"


_NEAR = "len(list_filter({}, lambda t: abs(t - v) <= 1e-6)) > 0"
SOLUTION_PATH = rf"""
WITH r AS {_sql_derived('orders', _PATH, _SOLVED)},
m AS (SELECT grp, id, {_side(1)} AS operands, {_side(2)} AS results, regexp_extract_all(question, '{_N}') AS m, string_split_regex(question, '{_N}') AS g FROM r),
s AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m),
n AS (SELECT *, m[i]::DOUBLE AS v, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS start FROM s),
t AS (SELECT *, count(*) OVER (PARTITION BY grp, id, v) AS times FROM n)
SELECT grp, CASE WHEN {_NEAR.format('operands')} THEN CASE WHEN times > 1 THEN 'ambiguous_number' ELSE 'on_solution_path_number' END WHEN {_NEAR.format('results')} THEN 'ambiguous_number' ELSE 'off_solution_path_number' END AS status,
  count(*) AS numbers, sum(start)::BIGINT AS starts FROM t GROUP BY ALL
"""

# ---- drift of fills

_MASKED = ["3", "12", "more than", "not", "5 miles", "apples", "if", "x", "the red book", "50%", "at least 2 hours", "berries", "cannot", "$20", "never less than"]
_FILLED = ["4", "twelve", "several", "less than", "always", "5 km", "the apples", "pens", "when", "", "a red book", "0.5", "[MASK]", "berry", "a long way round with more than eight words in it", "20 dollars", "No"]
_KINDS = ["number", "comparison", "negation", "object", "entity", "condition", "relation", "question_target"]
_DRIFTS = [("3", "number", "4"), ("12", "number", "twelve"), ("3", "number", "several"), ("more than", "comparison", "less than"), ("not", "negation", "always"), ("5 miles", "object", "5 km"), ("apples", "object", "the apples"), ("books", "object", "pens"), ("if", "condition", "when"), ("x", "relation", ""), ("x", "relation", None)]
_DRIFT_OF = {"span": _case("o_orderkey % 15", _MASKED), "type": _case("o_orderkey % 8", _KINDS), "fill": _case("o_orderkey % 17", _FILLED)}


def drift_labels(spark, d):
    """How fills drift from the spans that they stand for."""
    rows = _derived(spark, d, "orders", _DRIFT_OF, _DRIFTS, "span string, type string, fill string").distinct()
    return rows.select("span", "type", "fill", R.drift(F.col("span"), F.col("type"), F.col("fill"), F.lit(False)).alias("drift"))


def _direction(x: str) -> str:
    whole = " ".join(f"WHEN {x} IN {_in(w)} THEN '{g}'" for g, w in L.DIRECTIONS.items())
    held = " ".join("WHEN regexp_matches({}, '{}') THEN '{}'".format(x, "|".join(rf"\b{p}\b" for p in w), g) for g, w in L.DIRECTIONS.items())
    return f"CASE {whole} {held} END"


def _one(x: str) -> str:
    return f"CASE WHEN {x} LIKE '%ies' AND length({x}) > 3 THEN left({x}, length({x}) - 3) || 'y' WHEN {x} LIKE '%es' AND length({x}) > 2 THEN left({x}, length({x}) - 2) WHEN {x} LIKE '%s' AND length({x}) > 1 THEN left({x}, length({x}) - 1) ELSE {x} END"


_WORDS = "list_distinct(regexp_extract_all({}, '[A-Za-z0-9$%.,''-]+'))"
_UNITS = "list_sort(list_distinct(list_concat(list_filter({w}, lambda u: u IN " + _in(L.UNITS) + "), list_concat(CASE WHEN contains({x}, '%') THEN ['%'] ELSE [] END, CASE WHEN contains({x}, '$') THEN ['$'] ELSE [] END))))"
_NOT = "(list_has_any({w}, " + _list(L.NEGATIONS) + ") OR contains({x}, 'n''t'))"
DRIFT_LABELS = rf"""
WITH r AS (SELECT DISTINCT * FROM {_sql_derived('orders', _DRIFT_OF, _DRIFTS)}),
t AS (SELECT *, trim(span) AS s, trim(fill) AS f, lower(trim(span)) AS sl, lower(trim(fill)) AS fl FROM r),
w AS (SELECT *, {_WORDS.format('sl')} AS sw, {_WORDS.format('fl')} AS fw, {_sql_values_of('s')} AS sv, {_sql_values_of('f')} AS fv, len(regexp_extract_all(s, '\S+')) AS sn, len(regexp_extract_all(f, '\S+')) AS fn, {_direction('sl')} AS ds, {_direction('fl')} AS df FROM t),
u AS (SELECT *, {_UNITS.format(w='sw', x='sl')} AS su, {_UNITS.format(w='fw', x='fl')} AS fu, len(list_filter(sv, lambda a: list_contains(fv, a))) > 0 AS equal, len(sv) > 0 AND len(fv) > 0 AS numeric_, regexp_replace(fl, '^\.+|\.+$', '', 'g') IN {_in(L.GENERIC_QUANTITIES)} AS generic,
  len(sw) > 0 AND len(fw) > 0 AND (list_has_all(fw, sw) OR list_has_all(sw, fw)) AS held FROM w)
SELECT span, type, fill, CASE WHEN fill IS NULL THEN 'ambiguous' WHEN f = '' THEN 'unrecoverable' WHEN contains(fl, 'mask]') OR fn > greatest(8, 4 * greatest(1, sn)) THEN 'ambiguous'
  WHEN fl = sl OR (fn = 1 AND sn = 1 AND ({_one('fl')}) = ({_one('sl')})) THEN 'exact_recovery'
  WHEN type = 'number' THEN CASE WHEN NOT numeric_ THEN 'generic_recovery' WHEN equal THEN 'exact_recovery' ELSE 'wrong_numeric_recovery' END
  WHEN type = 'comparison' THEN CASE WHEN ds IS NULL OR df IS NULL THEN 'generic_recovery' WHEN ds = df THEN 'exact_recovery' ELSE 'direction_drift' END
  WHEN type = 'negation' THEN CASE WHEN {_NOT.format(w='sw', x='sl')} = {_NOT.format(w='fw', x='fl')} THEN 'exact_recovery' ELSE 'direction_drift' END
  WHEN len(su) > 0 AND su <> fu THEN 'unit_drift'
  WHEN type IN ('object', 'entity') THEN CASE WHEN generic OR fl IN {_in(L.VAGUE_OBJECTS)} OR held THEN 'generic_recovery' ELSE 'object_drift' END
  WHEN type = 'condition' THEN 'condition_drift' ELSE 'generic_recovery' END AS drift FROM u
"""

# ---- ids

_CVE, _CWE, _TECHNIQUE = "10000 + o_orderkey % 997", "o_custkey % 120 + 1", "1000 + o_orderkey % 500"
_IDS = {
    "grp": "o_orderkey % 5", "id": "o_orderkey",
    "text": f"concat('See CVE-2021-', {_CVE}, ' and cwe ', {_CWE}, ' or T', {_TECHNIQUE}, CASE WHEN o_orderkey % 3 = 0 THEN concat('.00', o_orderkey % 9 + 1) ELSE '' END, ' end')",
    "prompt": f"CASE o_orderkey % 4 WHEN 0 THEN concat('About cve 2021 ', {_CVE}) WHEN 1 THEN concat('On CWE-', {_CWE}, '?') WHEN 2 THEN 'T1003 it is' ELSE '' END",
}
_ONTOLOGY = {"family": "CASE c_custkey % 3 WHEN 0 THEN 'cve' WHEN 1 THEN 'cwe' ELSE 'attack' END", "normalized": "CASE c_custkey % 3 WHEN 0 THEN concat('CVE-2021-', 10000 + c_custkey % 997) WHEN 1 THEN concat('CWE-', c_custkey % 120 + 1) ELSE concat('T', 1000 + c_custkey % 500) END"}
_MENTIONS = [
    (101, 1, "See CVE-2021-44228 and cve-2020-1234.", "CVE-2021-44228"),
    (102, 2, "CWE-79, CWE-089 and T1059.001; again CWE-79", "none"),
    (103, 3, "T1003 is not XT1003 nor T10031", "T1003"),
    (104, 4, "nothing here", ""),
    (105, 5, "CVE 2019 0708 beside CWE 22", "cwe 22"),
]
_KNOWN = [("cve", "CVE-2021-44228"), ("cwe", "CWE-79"), ("cwe", "CWE-22"), ("attack", "T1059.001")]


def identifier_membership(spark, d):
    """Mentions of ids, each echoed from its prompt, grounded in the ontology, or fabricated: how many and where."""
    rows = _derived(spark, d, "orders", _IDS, _MENTIONS, "grp long, id long, text string, prompt string")
    mentions = rows.select("grp", "id", F.inline(X.identifiers(F.col("text")))).select("grp", "id", "family", "normalized", "start", "end")
    prompts = rows.select("grp", "id", F.inline(X.identifiers(F.col("prompt")))).select("grp", "id", "family", "normalized")
    known = _derived(spark, d, "customer", _ONTOLOGY, _KNOWN, "family string, normalized string")
    out = membership(mentions, prompts, known, ["family", "normalized"], ["grp", "id"])
    return out.groupBy("grp", "family", "label").agg(F.count(F.lit(1)).alias("mentions"), F.sum("start").cast("long").alias("starts"), F.sum("end").cast("long").alias("ends"))


def _sql_mentions(column: str) -> str:
    """Ids of a column of `r` with their places: techniques are sought with a character on either side, in a padded text."""

    def of(family: str, text: str, pattern: str, pad: int, normalized: str) -> str:
        return rf"""SELECT grp, id, '{family}' AS family, {normalized} AS normalized, place AS s, place + length(x) - {2 * pad} AS e FROM (SELECT grp, id, m[i] AS x,
  list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i-1], lambda y: length(y))), 0) AS place
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT grp, id, regexp_extract_all({text}, '{pattern}') AS m, string_split_regex({text}, '{pattern}') AS g FROM r)))"""

    cve = "'CVE-' || regexp_extract(x, '([0-9]{4})[ -]?[0-9]{4,}$', 1) || '-' || regexp_extract(x, '[0-9]{4}[ -]?([0-9]{4,})$', 1)"
    return "(" + " UNION ALL ".join([
        of("cve", column, r"(?i)\bCVE[\s-]\d{4}[\s-]?\d{4,}\b", 0, cve),
        of("cwe", column, r"(?i)\bCWE[\s-]\d{1,5}\b", 0, "'CWE-' || regexp_extract(x, '[0-9]+')::INTEGER"),
        of("attack", f"' ' || {column} || ' '", r"[^A-Za-z0-9-]T\d{4}(?:\.\d{3})?[^A-Za-z0-9]", 1, "x[2:-2]"),
    ]) + ")"


IDENTIFIER_MEMBERSHIP = f"""
WITH r AS {_sql_derived('orders', _IDS, _MENTIONS)}, t AS {_sql_mentions('text')}, p AS (SELECT DISTINCT grp, id, family, normalized FROM {_sql_mentions('prompt')}), k AS (SELECT DISTINCT * FROM {_sql_derived('customer', _ONTOLOGY, _KNOWN)})
SELECT t.grp, t.family, CASE WHEN p.id IS NOT NULL THEN 'echoed' WHEN k.family IS NOT NULL THEN 'grounded' ELSE 'fabricated' END AS label, count(*) AS mentions, sum(s)::BIGINT AS starts, sum(e)::BIGINT AS ends
FROM t LEFT JOIN p ON t.grp = p.grp AND t.id = p.id AND t.family = p.family AND t.normalized = p.normalized LEFT JOIN k ON t.family = k.family AND t.normalized = k.normalized GROUP BY ALL
"""

# ---- entailment and verdicts

_PAIR = {"kind": "CASE l_returnflag WHEN 'R' THEN 'delete' ELSE 'generalize' END", "spans": "CAST(l_linenumber AS INT)"}
_PAIRS = [("delete", 1), ("generalize", 1), ("delete", 3), ("generalize", 6), ("generalize", 12)]


def entailment_rules(spark, d):
    """Scores of the rule-based entailment scorer by kind and number of spans, and the necessity that they lead to."""
    rows = _derived(spark, d, "lineitem", _PAIR, _PAIRS, "kind string, spans int").distinct()
    f, b = R.entailment(F.col("kind"), F.col("spans"), "forward"), R.entailment(F.col("kind"), F.col("spans"), "backward")
    n = R.necessity(f["entailment"], b["entailment"], F.greatest(f["contradiction"], b["contradiction"]))
    return rows.select("kind", "spans", f["entailment"].alias("forward"), b["entailment"].alias("backward"), b["label"].alias("backward_label"), n["label"].alias("label"), n["reason"].alias("reason"), n["score"].alias("score"))


def _scored(way: str, at: int, sign: str) -> str:
    return f"round(CASE kind WHEN 'generalize' THEN {R.ENTAILMENT['generalize', way][at]} ELSE {R.ENTAILMENT['delete', way][at]} END::DOUBLE {sign} least(0.2, 0.05 * (spans - 1))::DOUBLE, 10)"


ENTAILMENT_RULES = f"""
WITH r AS (SELECT DISTINCT kind, CAST(spans AS INTEGER) AS spans FROM {_sql_derived('lineitem', _PAIR, _PAIRS)}),
e AS (SELECT *, {_scored('forward', 0, '-')} AS forward, {_scored('backward', 0, '-')} AS backward, {_scored('backward', 1, '+')} AS neutral FROM r)
SELECT kind, spans, forward, backward, CASE WHEN backward >= neutral AND backward >= 0.05 THEN 'entailment' WHEN neutral >= 0.05 THEN 'neutral' ELSE 'contradiction' END AS backward_label,
  CASE WHEN least(forward, backward) >= 0.7 THEN 'Equivalent' WHEN forward >= 0.5 AND backward < 0.5 THEN 'Information Loss' WHEN forward < 0.5 AND backward >= 0.5 THEN 'Added Assumption' ELSE 'Non-equivalent' END AS label,
  CASE WHEN least(forward, backward) >= 0.7 THEN 'bidirectional entailment above equivalent threshold' WHEN forward >= 0.5 AND backward < 0.5 THEN 'forward entails ablated but backward does not entail original'
    WHEN forward < 0.5 AND backward >= 0.5 THEN 'backward entails original but forward does not entail ablated' ELSE 'low bidirectional entailment' END AS reason,
  round(greatest(1 - least(forward, backward), 0.05::DOUBLE), 10) AS score FROM e
"""

_INTERVAL = {"low": "CASE WHEN c_custkey % 50 = 7 THEN NULL ELSE (c_custkey * 37 % 401 - 200) / 1000.0 END", "high": "CASE WHEN c_custkey % 60 = 11 THEN NULL ELSE (c_custkey * 37 % 401 - 200 + c_custkey % 173) / 1000.0 END"}
_INTERVALS = [(0.01, 0.2), (-0.3, -0.1), (-0.02, 0.03), (-0.4, 0.4), (None, 0.1)]


def equivalence_verdict(spark, d):
    """What intervals of a difference say: how many of each verdict, and the sums of their ends."""
    rows = table(spark, d, "customer").select(*[F.expr(e).cast("double").alias(c) for c, e in _INTERVAL.items()]).unionByName(literal(spark, _INTERVALS, "low double, high double"))
    return rows.groupBy(R.verdict(F.col("low"), F.col("high")).alias("verdict")).agg(F.count(F.lit(1)).alias("intervals"), F.round(F.sum("low"), 4).alias("lows"), F.round(F.sum("high"), 4).alias("highs"))


EQUIVALENCE_VERDICT = f"""
WITH r AS (SELECT CAST({_INTERVAL['low']} AS DOUBLE) AS low, CAST({_INTERVAL['high']} AS DOUBLE) AS high FROM customer UNION ALL SELECT CAST(low AS DOUBLE), CAST(high AS DOUBLE) FROM {sql_values(_INTERVALS, ['low', 'high'])})
SELECT CASE WHEN low IS NULL OR high IS NULL THEN 'undetermined' WHEN low > 0 THEN 'positive' WHEN high < 0 THEN 'negative' WHEN high - low <= 0.1 THEN 'equivalent' ELSE 'imprecise' END AS verdict,
  count(*) AS intervals, round(sum(low), 4) AS lows, round(sum(high), 4) AS highs FROM r GROUP BY 1
"""

QUERIES = {
    "number_values": (number_values, NUMBER_VALUES), "answers": (answers, ANSWERS_SQL), "solution_path": (solution_path, SOLUTION_PATH), "drift_labels": (drift_labels, DRIFT_LABELS),
    "identifier_membership": (identifier_membership, IDENTIFIER_MEMBERSHIP), "entailment_rules": (entailment_rules, ENTAILMENT_RULES), "equivalence_verdict": (equivalence_verdict, EQUIVALENCE_VERDICT),
}
