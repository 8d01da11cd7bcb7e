"""Eligibility rules: derived from scheme columns, merged with stored ones, evaluated three-valued, and summed up.

A rule is a row (scheme_id, ordinal, rule_type, operator, num_value, lo, hi, list_value, str_value, is_hard). Two forms of
evaluation share one comparison: `evaluate_rows` joins rules to long-form profile fields, for any rule set;
`hard_checks` compiles the rules that scheme columns imply into one array of structs per pair, without any explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.text import purpose_family

# The profile field that each rule type looks at.
FIELDS = {
    "income": "annual_family_income",
    "annual_family_income": "annual_family_income",
    "category": "category",
    "age": "age",
    "gender": "gender",
    "project_type": "project_type",
    "project_cost": "project_cost",
    "loan_amount": "loan_required",
    "loan_required": "loan_required",
    "education": "education_status",
    "education_status": "education_status",
    "location": "location",
    "state": "state",
    "district": "district",
    "purpose": "purpose",
    "occupation": "occupation",
}
OPEN_GENDERS = ["any", "both", "all", ""]
UNSAID_GENDERS = ["prefer_not_to_say", "prefer-not-to-say", "na", ""]


def cleaned(x: Column) -> Column:
    return F.lower(F.trim(x.cast("string")))


def compare(op: Column, text: Column, num: Column, str_value: Column, num_value: Column, lo: Column, hi: Column, many: Column) -> Column:
    """Whether an actual value (as text and as number) meets a rule; unknown operators never do."""
    op = F.lower(op)
    a, expected = cleaned(text), cleaned(F.coalesce(str_value, num_value.cast("string")))
    same = F.when(num.isNotNull() & num_value.isNotNull(), num == num_value).otherwise(a == expected)
    target = F.coalesce(F.nullif(cleaned(str_value), F.lit("")), F.lit("any"))
    options = F.transform(F.coalesce(many, F.array(str_value)), lambda x: cleaned(x))
    verdict = (
        F.when(op.isin("eq", "==", "equals"), same)
        .when(op.isin("neq", "!="), ~same)
        .when(op.isin("gte", ">="), num >= num_value)
        .when(op.isin("lte", "<="), num <= num_value)
        .when(op.isin("gt", ">"), num > num_value)
        .when(op.isin("lt", "<"), num < num_value)
        .when(op.isin("in"), F.array_contains(options, a))
        .when(op.isin("contains"), a.contains(expected))
        .when(op.isin("purpose_match"), (purpose_family(text) == purpose_family(str_value)) & (purpose_family(text) != ""))
        .when(op.isin("between"), num.between(lo, hi))
        .when(op.isin("intersects"), F.exists(F.coalesce(many, F.array(str_value)), lambda x: F.lower(x) == F.lower(text)))
        .when(op.isin("gender_match"), target.isin(OPEN_GENDERS) | a.isin(UNSAID_GENDERS) | (a == target))
        .otherwise(False)
    )
    return F.coalesce(verdict, F.lit(False))


def profile_fields(profiles: DataFrame) -> DataFrame:
    """(profile_id, field, text, num): every non-empty field of every profile."""
    names = sorted(set(FIELDS.values()) & set(profiles.columns))
    pairs = F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("text"), F.col(n).try_cast("double").alias("num")) for n in names))
    return profiles.select("profile_id", F.inline(pairs)).where("text is not null and text <> ''")


def field_of(rule_type: Column) -> Column:
    out = F.when(F.lit(False), "")
    for rule, field in FIELDS.items():
        out = out.when(rule_type == rule, field)
    return out.otherwise(rule_type)


def evaluate_rows(pairs: DataFrame, rules: DataFrame, profiles: DataFrame) -> DataFrame:
    """pairs(profile_id, scheme_id) x rules -> with passed (null where the profile says nothing) and symbol."""
    asked = pairs.join(rules, "scheme_id").withColumn("field", field_of(F.col("rule_type")))
    met = asked.join(profile_fields(profiles), ["profile_id", "field"], "left")
    verdict = compare(*(F.col(c) for c in ("operator", "text", "num", "str_value", "num_value", "lo", "hi", "list_value")))
    passed = F.when(F.col("text").isNotNull(), verdict)
    symbol = F.when(passed.isNull(), "warning").when(passed, "pass").otherwise("fail")
    return met.withColumns({"passed": passed, "symbol": symbol})


def decision(evaluated: DataFrame) -> DataFrame:
    """(profile_id, scheme_id): eligible, missing, complete, eligibility (0-100), hard and soft fails, blocking rules in order."""
    hard, passed = F.col("is_hard"), F.col("passed")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    n = F.count_if(hard)
    out = evaluated.groupBy("profile_id", "scheme_id").agg(
        (count(hard & ~passed) == 0).alias("eligible"),
        (F.count_if(hard & passed.isNull()) > 0).alias("missing"),
        F.when(n == 0, 50.0).otherwise(F.round(count(hard & passed) / n * 100, 2)).alias("eligibility"),
        count(hard & ~passed).alias("hard_fails"),
        count(~hard & ~passed).alias("soft_fails"),
        F.array_sort(F.collect_list(F.when(hard & ~passed, F.struct("ordinal", "rule_type")))).alias("blocking"),
    )
    return out.withColumns({"complete": F.col("eligible") & ~F.col("missing"), "blocking": F.transform("blocking", lambda b: b.rule_type)})


def derived_rules(schemes: DataFrame) -> DataFrame:
    """The rules that a scheme's own columns state. schemes: see the columns named here; absent ones count as null."""
    c = {n: F.col(n) if n in schemes.columns else F.lit(None) for n in (
        "max_income", "min_income", "max_loan", "min_loan", "categories", "activities", "purpose", "scheme_type", "target_gender")}
    kind = F.lower(F.coalesce(c["scheme_type"], F.lit("")))
    from_type = F.when(kind.contains("education"), "education").when(kind.rlike("micro|term_loan|business|enterprise"), "business")
    purpose = F.when(F.coalesce(c["purpose"], F.lit("")) != "", c["purpose"]).otherwise(from_type)
    gender = F.coalesce(F.nullif(F.lower(F.trim(c["target_gender"])), F.lit("")), F.lit("any"))
    none_num, none_str, none_list = F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(None).cast("array<string>")

    def rule(order: int, kind: str, op: str, when: Column, num=none_num, text=none_str, many=none_list, hard: bool = True) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(order).alias("ordinal"), F.lit(kind).alias("rule_type"), F.lit(op).alias("operator"), num.cast("double").alias("num_value"),
                none_num.alias("lo"), none_num.alias("hi"), many.cast("array<string>").alias("list_value"), text.cast("string").alias("str_value"), F.lit(hard).alias("is_hard"),
            ),
        )

    has = lambda n: F.coalesce(F.size(c[n]) > 0, F.lit(False)) if n in schemes.columns else F.lit(False)
    all_ = F.array(
        rule(1, "income", "lte", c["max_income"].isNotNull(), c["max_income"]),
        rule(2, "income", "gte", c["min_income"].isNotNull(), c["min_income"]),
        rule(3, "loan_amount", "lte", c["max_loan"].isNotNull(), c["max_loan"]),
        rule(4, "loan_amount", "gte", c["min_loan"].isNotNull(), c["min_loan"]),
        rule(5, "category", "in", has("categories"), many=c["categories"]),
        rule(6, "project_type", "intersects", has("activities"), many=c["activities"], hard=False),
        rule(7, "purpose", "purpose_match", purpose.isNotNull(), text=purpose),
        rule(8, "gender", "gender_match", ~gender.isin("any", "both", "all"), text=gender),
    )
    return schemes.select("scheme_id", F.inline(F.filter(all_, lambda r: r.isNotNull())))


def merged_rules(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """Stored rules, and derived ones of types that a scheme has no stored rule of; a purpose column always speaks for itself."""
    types = stored.select("scheme_id", "rule_type").distinct()
    own_purpose = derived.where("rule_type = 'purpose'").select("scheme_id").distinct()
    kept = stored.join(own_purpose.withColumn("rule_type", F.lit("purpose")), ["scheme_id", "rule_type"], "left_anti")
    added = derived.where("rule_type <> 'purpose'").join(types, ["scheme_id", "rule_type"], "left_anti")
    return kept.unionByName(added).unionByName(derived.where("rule_type = 'purpose'"))


def hard_checks() -> tuple[Column, Column, Column]:
    """How many hard rules a scheme states, and how many of them the profile of the same row passes and fails.

    Plain sums of conditions, so a pair costs no array and no interpreted lambda. Expects the columns of a scheme named in
    `derived_rules` (categories in lower case), those of a profile, and user_family and scheme_family.
    """
    income, loan = F.col("annual_family_income"), F.col("loan_required")
    gender = F.lower(F.trim("gender"))
    target = F.coalesce(F.nullif(F.lower(F.trim("target_gender")), F.lit("")), F.lit("any"))
    user = F.lower(F.trim("category"))
    checks = [
        (F.col("max_income").isNotNull(), income <= F.col("max_income")),
        (F.col("min_income").isNotNull(), income >= F.col("min_income")),
        (F.col("max_loan").isNotNull(), loan <= F.col("max_loan")),
        (F.col("min_loan").isNotNull(), loan >= F.col("min_loan")),
        (F.col("categories").isNotNull(), F.array_contains(F.col("categories"), user)),
        (F.col("scheme_family").isNotNull(), F.col("user_family") == F.col("scheme_family")),
        (~target.isin("any", "both", "all"), gender.isin(UNSAID_GENDERS) | (gender == target)),
    ]
    total = lambda conditions: sum((F.when(c, 1).otherwise(0) for c in conditions), F.lit(0))
    return total(w for w, _ in checks), total(w & p for w, p in checks), total(w & ~p for w, p in checks)


def gender_fails() -> Column:
    """Whether the scheme of a pair is for one gender and the profile says another."""
    gender = F.lower(F.trim("gender"))
    target = F.coalesce(F.nullif(F.lower(F.trim("target_gender")), F.lit("")), F.lit("any"))
    return F.coalesce(~target.isin("any", "both", "all") & ~(gender.isin(UNSAID_GENDERS) | (gender == target)), F.lit(False))
