"""Intent parsing of short utterances in English, Hindi and a mix: ordered keyword tables and amounts, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.numbers import cosine
from loomwork.functions.text import ascii_digits, extract, first_label
from loomwork.session import small

# Keywords by label, and words of the mixed language with what they stand for.
PURPOSES = {
    "business": [
        "business", "vyapar", "vyapaar", "व्यवसाय", "उद्यम", "enterprise", "self employment", "self-employment", "स्वरोजगार", "dukaan",
        "shop", "startup", "workshop", "factory", "नौकरी नहीं", "खुद का काम",
    ],
    "education": [
        "education", "educational", "study", "studies", "college", "university", "शिक्षा", "पढ़ाई", "padhai", "shiksha", "tuition", "mba",
        "btech", "degree",
    ],
    "agriculture": [
        "agriculture", "farming", "dairy", "डेयरी", "कृषि", "kheti", "poultry", "goatery", "animal husbandry", "पशुपालन", "मछली", "fishery",
    ],
}
PROJECTS = {
    "dairy": ["dairy", "डेयरी", "milk", "दूध", "gaushala", "cattle", "buffalo"],
    "tailoring": ["tailoring", "silai", "सिलाई", "boutique", "garment"],
    "kirana": ["kirana", "grocery", "किराना", "general store"],
    "transport": ["transport", "vehicle", "auto", "taxi", "परिवहन", "truck"],
    "education_loan": ["education loan", "शैक्षणिक ऋण", "tuition fee", "hostel fee"],
    "micro_enterprise": ["micro", "microfinance", "सूक्ष्म", "small business", "chhote business"],
    "beauty_parlour": ["beauty", "parlour", "salon", "पार्लर"],
    "agriculture": ["agriculture", "farming", "kheti", "कृषि", "crop"],
    "poultry": ["poultry", "chicken", "मुर्गी"],
    "services": ["repair", "service", "services", "मरम्मत"],
}
CATEGORIES = {
    "SC": ["sc", "scheduled caste", "अनुसूचित जाति", "anusuchit jati", "dalit"],
    "ST": ["st", "scheduled tribe", "अनुसूचित जनजाति", "adivasi"],
    "OBC": ["obc", "other backward", "अन्य पिछड़ा", "pichda"],
}
MIXED = {"mujhe": "", "chahiye": "", "ke liye": " for ", "vyavasay": "business", "udyam": "business"}
# How an age, and an income, is said; the leftmost of the ways to say an age counts.
AGE = (
    r"(?:age|उम्र|vayu|umra|years?\s*old|साल\s*का|वर्षीय)[^0-9]{0,8}([0-9]{1,2})"
    r"|(?:i\s*am|i'm|mein|main|मेरी?\s*उम्र)[^0-9]{0,8}([0-9]{1,2})"
)
INCOME = r"(?:income|आय|aay|salary|वेतन)[^0-9₹rs]{0,20}((?:₹|rs\.?)?\s*[0-9,]+(?:\.[0-9]+)?\s*(?:lakh|lac|लाख|crore)?)"
LEAST_SIMILARITY = 0.28


def amount(text: Column) -> Column:
    """Rupees that an utterance asks for: after a currency sign, in lakh, in crore, or a bare number of four to nine digits.

    The first kind that occurs and yields an amount decides; plain rupees count from 1000. A bare year is taken for an amount, and
    crore after a currency sign is not read: both are part of what the numbers mean here.
    """
    t = F.replace(ascii_digits(text), F.lit(","))
    sign = r"(?i)(?:₹|rs\.?|inr)\s*([0-9]+(?:\.[0-9]+)?)\s*(lakh|lac|lakhs|लाख)?"
    n, unit = extract(t, sign, 1).try_cast("double"), extract(t, sign, 2)
    bare = extract(t, r"\b([0-9]{4,9})\b").try_cast("double")
    return F.coalesce(
        F.when(unit.isNotNull(), n * 100_000).when(n >= 1000, n),
        extract(t, r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(?:lakh|lac|lakhs|लाख)").try_cast("double") * 100_000,
        extract(t, r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(?:crore|करोड़)").try_cast("double") * 10_000_000,
        F.when(bare >= 1000, bare),
    )


def parsed(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds purpose, project_type, category, loan_required, age, annual_family_income, n_fields, method and confidence."""
    original = ascii_digits(F.trim(F.coalesce(F.col(text), F.lit(""))))
    low = F.lower(original)
    for word, meaning in MIXED.items():
        low = F.replace(low, F.lit(word), F.lit(meaning))
    df = df.withColumns({"_o": original, "_l": low})
    o, t = F.col("_o"), F.col("_l")
    df = df.withColumns({"_purpose": first_label(t, o, PURPOSES), "_project": first_label(t, o, PROJECTS), "category": first_label(t, o, CATEGORIES)})
    implied = F.when(F.col("_project") == "education_loan", "education").when(F.col("_project").isNotNull(), "business")
    purpose = F.coalesce("_purpose", implied)
    farming = purpose == "agriculture"
    df = df.withColumns(
        {
            "purpose": F.when(farming, "business").otherwise(purpose),
            "project_type": F.coalesce("_project", F.when(farming, "agriculture")),
            "loan_required": amount(o),
            "age": F.coalesce(extract(t, AGE, 1), extract(t, AGE, 2)).try_cast("int"),
            "annual_family_income": amount(extract(t, INCOME)),
        }
    )
    fields = ["purpose", "project_type", "category", "loan_required", "age", "annual_family_income"]
    n = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    return df.withColumn("n_fields", n).withColumns(confidence(F.col("n_fields"))).drop("_o", "_l", "_purpose", "_project")


def confidence(n: Column, similarity: Column | None = None) -> dict[str, Column]:
    """method and confidence: 0.55 and 0.1 for each field; with embeddings 0.15 of the similarity, 0.95 at most."""
    plain = F.lit(0.55) + F.lit(0.1) * n
    if similarity is None:
        return {"method": F.lit("rule_based"), "confidence": F.round(plain, 3)}
    used = similarity.isNotNull()
    mixed = F.when(used, F.least(F.lit(0.95), plain + 0.15 * similarity)).otherwise(plain)
    return {"method": F.when(used, "hybrid").otherwise("rule_based"), "confidence": F.round(mixed, 3)}


def best_exemplar(df: DataFrame, key: str, vector: str, exemplars: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """(key, label, similarity): the most similar exemplar (ord, label, exemplar) of each vector, if it is similar enough.

    Every vector meets every exemplar, which are broadcast if they are few by count; ties go to the first.
    """
    scored = df.select(key, vector).join(small(exemplars), F.lit(True)).withColumn("s", cosine(F.col(vector), F.col("exemplar")))
    best = scored.groupBy(key).agg(F.max_by(F.struct("label", "s"), F.struct(F.col("s"), -F.col("ord"))).alias("b"))
    return best.where(F.col("b.s") >= least).select(key, F.col("b.label").alias("label"), F.round("b.s", 4).alias("similarity"))
