"""Why a rule passed, failed or could not be told, in two languages: one table of templates, filled by Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.text import rupees

# The published texts. {a} is the applicant's value, {e} the scheme's; money is written as ₹1,234.
PASS = {
    "income": ("Your family income is within the required limit.", "आपकी पारिवारिक आय निर्धारित सीमा के भीतर है।"),
    "income_min": ("Your family income meets the minimum published threshold.", "आपकी पारिवारिक आय न्यूनतम प्रकाशित सीमा को पूरा करती है।"),
    "loan_amount": ("Your requested loan is within the applicable limit.", "आपका अनुरोधित ऋण लागू सीमा के भीतर है।"),
    "loan_amount_min": ("Your requested loan meets the minimum published amount.", "आपका अनुरोधित ऋण न्यूनतम प्रकाशित राशि को पूरा करता है।"),
    "category": ("Your category matches the published beneficiary requirement.", "आपकी श्रेणी प्रकाशित लाभार्थी आवश्यकता से मेल खाती है।"),
    "project_type": ("Your project type matches the scheme.", "आपका परियोजना प्रकार योजना से मेल खाता है।"),
    "purpose": ("Your purpose matches the scheme purpose.", "आपका उद्देश्य योजना के उद्देश्य से मेल खाता है।"),
    "gender": ("This scheme matches your gender eligibility.", "यह योजना आपकी लिंग-पात्रता से मेल खाती है।"),
    "age": ("Your age meets the published age condition.", "आपकी आयु प्रकाशित आयु शर्त को पूरा करती है।"),
    "default": ("Your details match the published condition.", "आपका विवरण प्रकाशित शर्त से मेल खाता है।"),
}
FAIL = {
    "income": (
        "Your annual family income ({a}) is above the scheme limit ({e}). You currently do not meet this income criterion.",
        "आपकी वार्षिक पारिवारिक आय ({a}) योजना की सीमा ({e}) से अधिक है। आप वर्तमान में यह आय शर्त पूरी नहीं करते।",
    ),
    "income_min": ("Your annual family income ({a}) is below the minimum required ({e}).", "आपकी वार्षिक पारिवारिक आय ({a}) न्यूनतम आवश्यक ({e}) से कम है।"),
    "loan_amount": (
        "Your requested loan ({a}) is higher than the maximum allowed ({e}) for this scheme.", "आपका अनुरोधित ऋण ({a}) इस योजना की अधिकतम अनुमति ({e}) से अधिक है।",
    ),
    "loan_amount_min": ("Your requested loan ({a}) is below the minimum published amount ({e}).", "आपका अनुरोधित ऋण ({a}) न्यूनतम प्रकाशित राशि ({e}) से कम है।"),
    "purpose": (
        "This scheme is for '{e}' purposes, but you asked for '{a}'. Purpose does not match, so this scheme is not suitable.",
        "यह योजना '{e}' उद्देश्य के लिए है, जबकि आपने '{a}' माँगा है। उद्देश्य मेल नहीं खाता, इसलिए यह योजना उपयुक्त नहीं है।",
    ),
    "category": (
        "Your category ({a}) is not in the allowed beneficiary categories ({e}).", "आपकी श्रेणी ({a}) अनुमत लाभार्थी श्रेणियों ({e}) में नहीं है।",
    ),
    "gender": (
        "This scheme is published for {e} beneficiaries. Your selected gender ({a}) does not match, so this scheme is not available for you.",
        "यह योजना {e} लाभार्थियों के लिए प्रकाशित है। आपका चयनित लिंग ({a}) मेल नहीं खाता, इसलिए यह योजना आपके लिए उपलब्ध नहीं है।",
    ),
    "age": ("Your age ({a}) does not meet the published age condition for this scheme.", "आपकी आयु ({a}) इस योजना की प्रकाशित आयु शर्त को पूरा नहीं करती।"),
    "project_type": (
        "Your project type ({a}) does not match the activities covered by this scheme.", "आपका परियोजना प्रकार ({a}) इस योजना की गतिविधियों से मेल नहीं खाता।",
    ),
    "default": ("You do not meet the published '{r}' condition for this scheme.", "आप इस योजना की प्रकाशित '{r}' शर्त को पूरा नहीं करते।"),
}
MISSING = ("This information ({r}) is required to confirm eligibility.", "पात्रता की पुष्टि के लिए यह जानकारी ({r}) आवश्यक है।")
FRESHNESS_HI = {"Fresh": "ताज़ा", "Aging": "पुराना पड़ रहा", "Stale": "अप्रचलित", "Unknown": "अज्ञात"}
GENDER = {"female": ("Female", "महिला"), "male": ("Male", "पुरुष"), "any": ("Both", "दोनों")}
GENDER_GROUP = {"female": ("women", "महिला"), "male": ("men", "पुरुष"), "any": ("all genders", "सभी लिंग")}
UNPUBLISHED = ("Not published", "आधिकारिक स्रोत में प्रकाशित नहीं")


def said(pair: tuple[str, str], hindi: Column) -> Column:
    return F.when(hindi, pair[1]).otherwise(pair[0])


def labelled(key: Column, table: dict[str, tuple[str, str]], hindi: Column, default: Column | None = None) -> Column:
    """The label of a key; the default, or the key itself, where the table has none."""
    out = F.when(F.lit(False), "")
    for name, pair in table.items():
        out = out.when(key == name, said(pair, hindi))
    return out.otherwise(key if default is None else default)


def _kind(rule_type: Column, operator: Column) -> Column:
    """The templates' key of a rule."""
    base = F.when(rule_type == "annual_family_income", "income").when(rule_type == "loan_required", "loan_amount").otherwise(F.lower(rule_type))
    return F.when(base.isin("income", "loan_amount") & F.lower(operator).isin("gte", ">="), F.concat(base, F.lit("_min"))).otherwise(base)


def reason(rule_type: Column, operator: Column, passed: Column, actual: Column, expected: Column, hindi: Column) -> Column:
    """The text for a rule's outcome; actual and expected are texts, amounts among them as plain numbers."""
    kind = _kind(rule_type, operator)
    money = kind.isin("income", "income_min", "loan_amount", "loan_amount_min")
    shown = lambda x: F.when(money & x.try_cast("double").isNotNull(), rupees(x.try_cast("double"))).otherwise(x)
    group = labelled(F.lower(expected), GENDER_GROUP, hindi, said(GENDER_GROUP["any"], hindi))
    wanted = F.when(kind == "gender", group).otherwise(shown(expected))
    template = (
        F.when(passed.isNull(), said(MISSING, hindi))
        .when(passed, labelled(kind, PASS, hindi, said(PASS["default"], hindi)))
        .otherwise(labelled(kind, FAIL, hindi, said(FAIL["default"], hindi)))
    )
    out = F.replace(template, F.lit("{a}"), F.coalesce(shown(actual), F.lit("")))
    out = F.replace(out, F.lit("{e}"), F.coalesce(wanted, F.lit("")))
    return F.replace(out, F.lit("{r}"), rule_type)


def with_reasons(evaluated: DataFrame, hindi: Column | None = None) -> DataFrame:
    """Adds reason to evaluated rules, and gap for those that failed: field, both values and the reason."""
    expected = F.coalesce("str_value", F.array_join("list_value", ", "), F.col("num_value").cast("string"))
    hindi = F.lit(False) if hindi is None else hindi
    text = reason(F.col("rule_type"), F.col("operator"), F.col("passed"), F.col("text"), expected, hindi)
    gap = F.struct(F.col("rule_type").alias("field"), F.col("text").alias("your_value"), expected.alias("scheme_requires"), F.col("reason").alias("message"))
    return evaluated.withColumn("reason", text).withColumn("gap", F.when(F.col("passed") == F.lit(False), gap))


def suggestion(reasons: Column, limit: int = 3) -> Column:
    """The first reasons that passed, as one line; empty without any. reasons: array<struct<passed, reason>> in order."""
    good = F.slice(F.transform(F.filter(reasons, lambda r: r.passed), lambda r: r.reason), 1, limit)
    return F.when(F.size(good) > 0, F.concat(F.lit(" Key matches: "), F.array_join(good, "; "), F.lit("."))).otherwise("")


def freshness_label(state: Column, hindi: Column) -> Column:
    return labelled(state, {k: (k, v) for k, v in FRESHNESS_HI.items()}, hindi)


def gender_label(target: Column, hindi: Column) -> Column:
    key = F.coalesce(F.nullif(F.lower(F.trim(target)), F.lit("")), F.lit("any"))
    return labelled(key, GENDER, hindi, said(GENDER["any"], hindi))


def months_label(n: Column, hindi: Column) -> Column:
    return F.when(n.isNull(), said(UNPUBLISHED, hindi)).otherwise(F.concat(n.cast("string"), said((" months", " महीने"), hindi)))
