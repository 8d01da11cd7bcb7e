"""A generated corpus of loan schemes with their pages: 150 deterministic rows, or any number, by column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Places of partners, and what schemes are for.
PLACES = [("Rajasthan", "Hanumangarh", "Sangaria", 29.7902, 74.4661), ("Uttar Pradesh", "Gautam Buddha Nagar", "Greater Noida", 28.4744, 77.5040),
          ("Uttar Pradesh", "Ghaziabad", "Ghaziabad", 28.6692, 77.4538), ("Bihar", "Purnia", "Purnia", 25.7771, 87.4753)]
ACTIVITIES = ["Dairy", "Tailoring", "Kirana", "Transport", "Poultry", "Beauty", "Repair"]
PER_SITE = 30


def _pick(values: list, i: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(i, F.lit(len(values))) + 1).cast("int"))


def schemes(spark: SparkSession, n: int = 150) -> DataFrame:
    i = F.col("id")
    k, site = i % PER_SITE, F.floor(i / PER_SITE) % 5
    education = site == 1
    gender = F.when((site == 2) & (k % 4 != 0), "female").when((site != 2) & (k % 10 == 7), "male").when((site != 2) & (k % 10 == 3), "female").otherwise("any")
    kind = F.when(i % 5 < 2, "lifetime").when(i % 5 < 4, "period")
    year = 2025 + k % 2
    word = F.when(gender == "female", "Women ").when(gender == "male", "Men ").otherwise("")
    title = F.when(education, "Educational Loan").otherwise(_pick(ACTIVITIES, k))
    jitter = F.floor(i / len(PLACES)) * 0.0021
    return spark.range(n).select(
        i, F.concat(F.lit("Site "), site.cast("string"), F.lit(" "), word, title, F.lit(" Scheme "), F.lpad((k + 1).cast("string"), 2, "0")).alias("name"),
        F.when(education, "educational_loan").otherwise("term_loan").alias("scheme_type"), F.when(education, "education").otherwise("business").alias("purpose"),
        F.when(education, 50000 + (k % 5) * 25000).otherwise(25000 + (k % 8) * 25000).cast("double").alias("min_loan"),
        F.when(education, 300000 + (k % 10) * 200000).otherwise(200000 + (k % 12) * 150000).cast("double").alias("max_loan"),
        (150000 + (k % 10) * 50000).cast("double").alias("max_income"), F.round(4.0 + (k % 9) * 0.5, 1).alias("interest_rate"),
        (24 + (k % 8) * 12).cast("int").alias("tenure"), F.when(k % 3 == 0, 3).when(k % 3 == 1, 6).otherwise(0).alias("moratorium"),
        gender.alias("target_gender"), kind.alias("availability_type"),
        F.when(kind == "period", F.concat((5 + k % 20).cast("string"), F.lit(" May "), year.cast("string"), F.lit(" to 31 March "), (year + 2 + k % 3).cast("string"))).alias("period"),
        _pick([p[0] for p in PLACES], i).alias("state"), _pick([p[2] for p in PLACES], i).alias("city"),
        F.round(_pick([p[3] for p in PLACES], i) + F.sin(i) * 0.004 + jitter, 6).alias("latitude"), F.round(_pick([p[4] for p in PLACES], i) + F.cos(i) * 0.004 + jitter, 6).alias("longitude"),
    )


def pages(corpus: DataFrame) -> DataFrame:
    """(doc_id, url, title, text): one page a scheme, as extraction reads it."""
    number = lambda c: F.format_number(c, 0)
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value, F.lit("\n"))
    body = F.concat(
        line("Scheme Name", F.col("name")), line("Minimum loan", F.concat(F.lit("Rs. "), number("min_loan"))), line("Maximum loan", F.concat(F.lit("Rs. "), number("max_loan"))),
        line("Annual family income", F.concat(F.lit("Rs. "), number("max_income"))), line("Interest rate", F.concat(F.col("interest_rate").cast("string"), F.lit("%"))),
        line("Repayment period", F.concat(F.col("tenure").cast("string"), F.lit(" months"))), F.when(F.col("moratorium") > 0, line("Moratorium", F.concat(F.col("moratorium").cast("string"), F.lit(" months")))).otherwise(""),
        line("Target gender", F.col("target_gender")), F.when(F.col("availability_type") == "lifetime", "Availability: Lifetime\n").when(F.col("period").isNotNull(), line("Scheme period", F.col("period"))).otherwise(""),
        line("Purpose", F.col("purpose")), line("Channel Partner Name", F.concat("city", F.lit(" Centre"))), line("State", F.col("state")),
        line("Latitude", F.col("latitude").cast("string")), line("Longitude", F.col("longitude").cast("string")),
    )
    url = F.concat(F.lit("http://schemes.example.gov.in/"), F.col("id").cast("string"))
    return corpus.select(F.col("id").alias("doc_id"), url.alias("url"), F.col("name").alias("title"), body.alias("text"))
