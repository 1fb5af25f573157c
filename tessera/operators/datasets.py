"""Data sets of questions: multiple-choice records in one form, their audits, the density of id spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .sampling import shuffled_choices

CHOICES = "array<struct<choice:string,label_text:string,original_position:int>>"


def multiple_choice(raw: DataFrame, *, source: str, seed: int = 0) -> DataFrame:
    """Records (original_index, question, answers map<string,string>, solution, category) in canonical form: choices in the
    order of their labels, then shuffled by seed and id, with the gold label carried along.

    `problem` names what is wrong with a record and is null for a good one; nothing is dropped."""
    entries = F.transform(F.map_entries("answers"), lambda e: F.struct(F.upper(F.trim(e["key"])).alias("label"), F.trim(e["value"]).alias("text")))
    rows = raw.withColumn("options", F.array_sort(entries)).withColumn("gold", F.upper(F.trim("solution")))
    labels = F.transform("options", lambda o: o["label"])
    problem = (
        F.when(F.coalesce(F.trim("question"), F.lit("")) == "", "no question").when(F.coalesce(F.size("options"), F.lit(0)) < 2, "fewer than two options")
        .when(F.exists("options", lambda o: F.coalesce(o["label"] == "", F.lit(True)) | F.coalesce(o["text"] == "", F.lit(True))), "blank option").when(F.size(F.array_distinct(labels)) < F.size("options"), "duplicate option")
        .when(~F.coalesce(F.array_contains(labels, F.col("gold")), F.lit(False)), "no such solution")
    )
    rows = rows.withColumns({"problem": problem, "example_id": F.format_string(f"{source}_%06d", "original_index"), "gold_position": (F.array_position(labels, F.col("gold")) - 1).cast("int")})
    mixed = shuffled_choices(F.transform("options", lambda o: o["text"]), F.col("example_id"), seed)
    rows = rows.withColumn("choices", F.transform(mixed, lambda c: F.struct(c["label"].alias("choice"), c["choice"].alias("label_text"), c["original_position"].alias("original_position"))).cast(CHOICES))
    gold = F.filter("choices", lambda c: c["original_position"] == F.col("gold_position"))[0]
    group = F.coalesce(F.concat(F.lit("category_"), X.hashed(F.lower(F.nullif(F.trim("category"), F.lit(""))), 16)), F.concat(F.lit("question_"), X.hashed(X.normal(F.col("question")), 16)))
    return rows.select("example_id", F.lit(source).alias("source"), group.alias("group_id"), F.trim("question").alias("question"), "choices", F.when(F.col("problem").isNull(), gold["choice"]).alias("gold_label"), F.when(F.col("problem").isNull(), gold["label_text"]).alias("gold_text"), "gold_position", "problem")


def letter_mapping(rows: DataFrame) -> DataFrame:
    """(label_text, uses, letters): how often a text is offered and under how many letters; `fixed` when a repeated one has one."""
    out = rows.select(F.inline("choices")).groupBy("label_text").agg(F.count(F.lit(1)).alias("uses"), F.count_distinct("choice").alias("letters"))
    return out.withColumn("fixed", (F.col("uses") >= 2) & (F.col("letters") == 1))


def split_audit(rows: DataFrame, split: str = "split") -> DataFrame:
    """One row: records, duplicate ids, groups, groups in more than one split."""
    groups = rows.groupBy("group_id").agg(F.count_distinct(split).alias("s"))
    ids = rows.agg(F.count(F.lit(1)).alias("records"), (F.count("example_id") - F.count_distinct("example_id")).alias("duplicate_ids"))
    return ids.join(F.broadcast(groups.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("s") > 1).alias("leaking_groups"))))


# How many ids the forms of three families allow.
SPACES = {"attack": 9000 + 9000 * 999, "cwe": 99999}


def id_density(ontology: DataFrame) -> DataFrame:
    """(family, ids, space, chance): how likely a random well-formed id is known. The CVE space is 996,000 a year on record."""
    by = ontology.groupBy("family").agg(F.count_distinct("normalized_id").alias("ids"), F.count_distinct(F.regexp_extract("normalized_id", r"^CVE-(\d+)-", 1)).alias("years"))
    space = F.when(F.col("family") == "cve", F.greatest(F.lit(1), F.col("years") * 996000)).when(F.col("family") == "attack", SPACES["attack"]).when(F.col("family") == "cwe", SPACES["cwe"])
    return by.select("family", "ids", space.cast("long").alias("space"), (F.col("ids") / space).alias("chance"))


def year_density(ontology: DataFrame) -> DataFrame:
    """(year, ids, largest, low_share, high_chance) of CVE numbers."""
    n = F.regexp_extract("normalized_id", r"^CVE-(\d+)-(\d+)$", 2).cast("long")
    rows = ontology.where("family = 'cve'").select(F.regexp_extract("normalized_id", r"^CVE-(\d+)-", 1).alias("year"), n.alias("n"))
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("ids"), F.max("n").alias("largest"), F.least(F.lit(1.0), F.count_if(F.col("n") < 10000) / 9000).alias("low_share"), (F.count_if(F.col("n") >= 100000) / 900000).alias("high_chance"))


def completion_labels(completions: DataFrame, mentions: DataFrame, families: tuple[str, ...] = ("attack", "cwe")) -> DataFrame:
    """completions (completion_id) with label: 1 when a mention of a primary family is fabricated, 0 when such mentions are all
    grounded, else null with the reason (no mention, echoed only, other families only)."""
    primary = F.col("family").isin(*families) & F.col("label").isin("grounded", "fabricated")
    by = mentions.groupBy("completion_id").agg(F.count(F.lit(1)).alias("m"), F.count_if(primary).alias("p"), F.bool_or(primary & (F.col("label") == "fabricated")).alias("f"), F.count_if(F.col("label") != "echoed").alias("o"))
    out = completions.join(by, "completion_id", "left")
    label = F.when(F.col("p") > 0, F.col("f").cast("int"))
    reason = F.when(F.coalesce("m", F.lit(0)) == 0, "no_mention").when(F.col("p") > 0, None).when(F.col("o") == 0, "echoed_only").otherwise("other_families_only")
    return out.select("completion_id", label.alias("label"), reason.alias("excluded"))


def number_census(df: DataFrame, key: str, question: str, solution: str) -> DataFrame:
    """One row a question: expressions of its solution, numbers it holds, how many are on, off and ambiguous of the solution's path, and words
    that imply a number."""
    from ..functions import lexicons as L

    values = X.solution_values(F.col(solution))
    found = F.transform(X.matches(F.col(question), L.ARABIC_NUMBER), lambda m: X.number_values(m["text"]))
    rows = df.select(key, values.alias("s"), found.alias("v"), F.size(F.regexp_extract_all(F.col(solution), F.lit("<<([^>]*)>>"), F.lit(1))).alias("expressions"), F.size(X.implicit_numbers(F.col(question))).alias("implicit"))
    firsts = F.transform("v", lambda x: F.try_element_at(x, F.lit(1)))
    status = F.transform("v", lambda x: X.path_status(x, F.size(F.filter(firsts, lambda y: y == F.try_element_at(x, F.lit(1)))), F.col("s.operands"), F.col("s.results")))
    rows = rows.withColumn("status", status)
    count = lambda name: F.size(F.filter("status", lambda x: x == name))
    return rows.select(key, "expressions", F.size("v").alias("numbers"), count("on_solution_path_number").alias("on_path"), count("off_solution_path_number").alias("off_path"), count("ambiguous_number").alias("ambiguous"), "implicit")


def span_surface(span_type, text, start, length):
    """struct of what a span looks like: kind, digits, words, where it stands in its question, and a keyness by type alone."""
    from .formulas import NUMBERS, SURFACE_KEYNESS

    words = F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))
    at = start / F.greatest(F.lit(1), length)
    keyness = F.lit(0.30)
    for name, value in SURFACE_KEYNESS.items():
        keyness = F.when(span_type == name, value).otherwise(keyness)
    flag = lambda c: c.cast("int").cast("double")
    return F.struct(
        flag(span_type.isin(NUMBERS)).alias("number_like"), flag(text.rlike(r"\d")).alias("has_digit"), flag(words > 1).alias("phrase"), F.length(text).cast("double").alias("chars"), words.cast("double").alias("words"), at.cast("double").alias("relative_start"),
        F.when(at < 0.33, "early").when(at < 0.66, "mid").otherwise("late").alias("place"), flag(span_type.isin("number_unit", "rate")).alias("unit_hint"), keyness.alias("keyness"),
    )


def imported(raw: DataFrame, questions: list[str], answers: list[str], order: list, *, dataset: str, split: str) -> DataFrame:
    """Records of foreign data in one form: the first filled of the candidate columns as question and answer, an id by place (from 1), and the
    record as it came. `problem` names what is missing; nothing is dropped."""
    from .ordering import global_row_number

    filled = lambda names: X.first_filled(*[F.col(c).cast("string") for c in names if c in raw.columns]) if any(c in raw.columns for c in names) else F.lit(None).cast("string")
    rows = global_row_number(raw, order, "place")
    q, a = filled(questions), filled(answers)
    problem = F.when(q.isNull(), "no question").when(a.isNull(), "no answer")
    return rows.select(F.format_string(f"{dataset}_{split}_%06d", "place").alias("id"), F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), q.alias("question"), X.final_part(a).alias("gold_answer"), F.to_json(F.struct(*raw.columns)).alias("original"), problem.alias("problem"))


def import_report(rows: DataFrame) -> DataFrame:
    """One row: records, good ones, and how many lack what."""
    return rows.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("problem").isNull()).alias("good"), F.count_if(F.col("problem") == "no question").alias("no_question"), F.count_if(F.col("problem") == "no answer").alias("no_answer"), F.count_distinct("id").alias("ids"))


def reviewed(rows: DataFrame, status: str = "reviewed") -> DataFrame:
    """Reviews that count, and per field the histogram of what was said: (field, value, rows)."""
    from .aggregates import histograms

    done = rows.where(F.col("status") == status)
    return histograms(done, [c for c in rows.columns if c.startswith("human_")])
