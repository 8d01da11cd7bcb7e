"""Gates: which documents and rows are loan schemes, and which pages and names are not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.text import any_of, host, path

# Cues in addresses of pages that are no scheme.
URL_HINTS = [
    "privacy", "terms-of-use", "terms_of_use", "termsofuse", "copyright", "hyperlink", "accessibility", "security-policy",
    "security_policy", "monitoring", "contingency", "about-us", "aboutus", "/faq", "faqs", "dashboard", "sign-in", "signin",
    "login", "t-and-c", "tnc", "cookie", "disclaimer", "sitemap", "contact-us", "careers", "recruit",
]
# Cues in titles and names of what is no scheme.
NAME_HINTS = [
    "privacy policy", "terms of use", "terms & conditions", "terms and conditions", "copyright policy", "hyperlinking policy",
    "accessibility statement", "security policy", "monitoring policy", "contingency management", "about us", "frequently asked",
    "faq", "dashboard", "sign out", "something went wrong", "t&c for url", "conditions for hosting", "links to myscheme",
    "shared eligibility", "support-myscheme", "support myscheme", "unnamed scheme", "home page", "our mission is to streamline",
    "our vision", "powered by digital india", "department of social justice and empowerment - government of india",
    "schemes | department of social justice", "material featured on this platform",
]
# Kinds and bare names that are never schemes, and words that tell a scheme or a loan.
OTHER_KINDS = ["eligibility_reference", "shared_eligibility", "navigation", "policy", "faq"]
BARE_NAMES = ["myscheme", "schemes", "home", "dashboard", "faq", "about"]
SCHEME_NAME = (
    r"(?i)\b(?:scheme|yojana|term\s*loan|micro[\s\-]?finance|micro[\s\-]?credit|educational\s*loan|vocational|udyam|aajeevika|"
    r"mahila\s*samriddhi|laghu\s*vyavasay|green\s*business|standup|stand[\-\s]?up)\b"
)
FINANCE = (
    r"(?i)(?:maximum\s*loan|max\.?\s*loan|loan\s*limit|interest\s*rate|rate\s*of\s*interest|repayment\s*period|₹|"
    r"rs\.?\s*[0-9,]+\s*(?:lakh|lac|crore)?)"
)
# Words of pages worth a visit, of partner pages, and of pages that never list partners.
RELEVANT = [
    "scheme", "loan", "finance", "lending", "channel", "partner", "sca", "eligibility", "guideline", "circular",
    "notification", "faq", "micro", "education", "interest", "repayment", "policy",
]
PARTNER_URLS = [
    "channel-partner", "channel_partner", "channelpartner", "our-channel-partners", "channelising", "channelizing", "/sca", "state-channel",
]
NO_PARTNER_URLS = ["career", "recruit", "interview", "vacancy", "hr/", "/hr", "tender", "pratibha", "upsc"]
PERSON = [
    r"(?i)^(?:Mr\.|Ms\.|Mrs\.|Shri|Smt\.?|Dr\.)\b",
    r"(?i)\b(?:Manager|Deputy|Assistant|Officer|Director|Candidate|Selected|Interview)\b",
    r"(?i)\b(?:Pay Scale|Level E-|IDA Pattern|UPSC)\b",
]
# Words that make a source relevant.
AUTHORITY = [
    "NSFDC", "SC loan scheme", "Scheduled Caste financial assistance", "SC entrepreneur loan", "educational loan Scheduled Caste",
    "government concessional loan", "channelizing agency", "social justice loan scheme", "scheme", "loan", "finance",
]


def relevant_url(url: Column) -> Column:
    """The site's root, a PDF, or an address with a relevant word."""
    low = F.lower(url)
    return path(url).isin("", "/") | low.endswith(".pdf") | any_of(low, RELEVANT)


def is_other_document(url: Column, title: Column, text: Column) -> Column:
    """Policies, questions and portal chrome, by address, title and the first 800 characters."""
    place = F.concat(F.coalesce(host(url), F.lit("")), path(url))
    head = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(F.substring(text, 1, 800), F.lit(""))))
    return any_of(place, URL_HINTS) | any_of(head, NAME_HINTS) | head.contains("are you sure you want to sign out")


def is_scheme(name: Column, kind: Column, description: Column, url: Column, text: Column, has_figures: Column) -> Column:
    """Whether a row is a loan scheme: cheap tests first, as codegen stops at the first that decides.

    has_figures: any of the loan, rate, tenure and income figures is known.
    """
    name = F.coalesce(name, F.lit(""))
    low = F.lower(F.trim(name))
    text = F.coalesce(F.nullif(text, F.lit("")), F.coalesce(description, F.lit("")))
    strong = name.rlike(SCHEME_NAME)
    told = F.concat_ws("\n", name, F.coalesce(description, F.lit("")), F.substring(text, 1, 2000)).rlike(FINANCE)
    return (
        ~F.lower(F.coalesce(kind, F.lit(""))).isin(OTHER_KINDS)
        & (F.length(low) >= 8)
        & ~low.isin(BARE_NAMES)
        & ~any_of(low, NAME_HINTS)
        & (has_figures | (strong & told))
        & ~is_other_document(url, name, text)
    )


def is_partner_url(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    return ~any_of(low, NO_PARTNER_URLS) & any_of(low, PARTNER_URLS)


def is_person(name: Column) -> Column:
    return name.rlike(PERSON[0]) | name.rlike(PERSON[1]) | name.rlike(PERSON[2])


def is_government(url: Column) -> Column:
    h = F.coalesce(host(url), F.lit(""))
    return h.contains(".gov.in") | h.contains(".nic.in") | h.endswith("gov.in") | h.endswith("nic.in")


def authority_score(url: Column, title: Column) -> Column:
    """How promising a source is, 0 to 100; 0 without an http(s) host."""
    text = F.lower(F.concat_ws(" ", url, F.coalesce(title, F.lit("")), F.lit("")))
    hits = sum((F.when(text.contains(k.lower()), 1).otherwise(0) for k in AUTHORITY), F.lit(0))
    score = (
        F.lit(25) + 8 * hits
        + F.when(is_government(url), 25).otherwise(0)
        + F.when(text.contains("nsfdc"), 20).otherwise(0)
        + F.when(text.contains("socialjustice") | text.contains("social justice"), 15).otherwise(0)
    )
    open_ = F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")).isin("http", "https"), F.lit(False)) & host(url).isNotNull()
    return F.when(open_, F.least(score, F.lit(100))).otherwise(0)


def crawl_verdict(robots: Column, http_status: Column) -> Column:
    """allowed, blocked or uncertain, from robots (null: unknown) and the status of the home page (null: no answer)."""
    ok = F.coalesce(http_status < 400, F.lit(False))
    return F.when(F.coalesce(robots == F.lit(False), F.lit(False)) | F.coalesce(http_status.isin(401, 403), F.lit(False)), "blocked").when(
        F.coalesce(robots, F.lit(False)) & ok, "allowed"
    ).otherwise("uncertain")
