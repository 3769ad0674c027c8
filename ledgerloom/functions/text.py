"""Text rules: merchant keys, account types and ids, categories by keyword, placeholders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, as the results need them: prefixes of payment processors, patterns of noise in descriptions, punctuation
# dropped at the ends, and words of account types, categories and transfers, each in the order of their precedence.
PROCESSORS = (
    "SQ *", "TST* ", "TST*", "PY *", "PAYPAL *", "SP *", "UBER *",
    "POS DEBIT", "ACH DEBIT", "ACH CREDIT", "DEBIT CARD PURCHASE", "VISA DDA PUR",
)
CHECKCARD = r"(?i)^CHECKCARD\s+\d{4}\s*"
PHONE = r"\b\d{3}[-\s]?\d{3}[-\s]?\d{4}\b"
HASH_NUMBER = r"#\s*\d+"
LONG_DIGITS = r"\b\d{3,}\b"
TRAILING_STATE = r"\s+[A-Z]{2}\s*$"
ORDER_CODE = r"\b(?=[A-Za-z0-9*]{5,}\b)(?=(?:[^\d\s]*\d){2})[A-Za-z0-9*]+\b"
TRAILING_DAY = r"(?i)\s+(?:MON|TUE|WED|THU|FRI|SAT|SUN)\s*$"
EDGES = " -.,*/|:;#"
ACCOUNT_TYPES = (
    ("checking", ("debit",)),
    ("credit", ("credit card", "creditcard", "charge card", "card account", "line of credit", "credit line", "heloc",
                "visa", "mastercard", "master card", "amex", "american express", "discover", "diners")),
    ("checking", ("chequing", "checking", "current account", "demand deposit", "dda", "transaction account", "everyday", "now account")),
    ("savings", ("savings", "saving", "money market", "tfsa", "isa", "certificate of deposit", "gic", "term deposit")),
)
CATEGORIES = (
    "Food & Drink", "Groceries", "Transportation", "Shopping", "Entertainment", "Subscriptions", "Utilities", "Housing",
    "Health", "Education", "Travel", "Income", "Transfer", "Fees & Interest", "Other",
)
KEYWORDS = (
    ("payroll|salary|direct deposit", "Income"),
    (r"interest charge|overdraft|annual membership fee|\bfees?\b|\bnsf\b|service charge", "Fees & Interest"),
    (r"funds transfer|transfer to|\bxfer\b|e-?transfer", "Transfer"),
    ("atm withdrawal|cash withdrawal", "Transfer"),
    ("automatic payment|payment - thank you|bill payment - visa|bill payment - mastercard|bill payment - amex", "Transfer"),
    (r"mortgage|\brent\b|property tax|condo fee", "Housing"),
    (r"hydro|electric|\bgas bill\b|water bill|internet|\bcable\b|telecom|wireless", "Utilities"),
    ("pharmacy|drug ?mart|dental|clinic|medical|optical", "Health"),
    (r"\bgym\b|fitness|yoga", "Health"),
    (r"supermarket|grocer|market\b", "Groceries"),
    ("restaurant|coffee|cafe|café|bistro|noodle|pizza|bakery", "Food & Drink"),
    (r"gas bar|petro|fuel|\bshell\b|esso|chevron", "Transportation"),
    (r"transit|parking|railway|\bbus\b|airline|airport", "Transportation"),
    ("bookstore|hardware|electronics|clothing|department", "Shopping"),
    ("tuition|university|college|course", "Education"),
    ("insurance", "Other"),
)
ENRICHMENT_CATEGORIES = {
    "Cafes": "Food & Drink", "Restaurants": "Food & Drink", "Food Delivery": "Food & Drink", "Groceries": "Groceries",
    "Department Stores": "Shopping", "Online Marketplaces": "Shopping", "Home Improvement": "Shopping",
    "Ride-sharing": "Transportation", "Fuel": "Transportation", "Video Streaming": "Subscriptions",
    "Music Streaming": "Subscriptions", "Design & Creative Software": "Subscriptions", "Gaming": "Entertainment",
    "Online Learning": "Education", "Banking": "Fees & Interest", "Cash & ATM": "Transfer",
    "Savings Transfer": "Transfer", "Utilities": "Utilities", "Fitness": "Health",
    "Professional Services": "Other", "Uncategorized": "Other",
}
TRANSFER_WORDS = ("PAYMENT", "TRANSFER", "THANK YOU", "XFER", "ZELLE", "VENMO", "ONLINE PMT", "AUTOPAY")
PLACEHOLDERS = ("", "null", "none", "n/a", "na", "-", "--", "unknown")

_NUMBER_TOKEN = r"(?:[^A-Za-z\s\d]*\d){3}[^A-Za-z\s]*"


def _quoted(words: tuple[str, ...]) -> str:
    return "|".join(w.replace("*", r"\*") for w in words)


def title(x: Column) -> Column:
    """A capital after everything that is no letter; initcap only knows white space."""
    runs = F.regexp_extract_all(F.lower(x), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def merchant_key(description: Column) -> Column:
    """The merchant of a description without what changes from one purchase to the next; '' for null."""
    x = F.trim(F.coalesce(description, F.lit("")))
    x = F.regexp_replace(x, CHECKCARD, "")
    x = F.regexp_replace(x, f"(?i)^(?:{_quoted(PROCESSORS)})", "")
    for noise in (PHONE, HASH_NUMBER, LONG_DIGITS, TRAILING_STATE, ORDER_CODE, TRAILING_DAY):
        x = F.regexp_replace(x, noise, " ")
    x = F.regexp_replace(x, rf"^\s*(?:{_NUMBER_TOKEN}(?:\s+|$))+", "")
    x = F.regexp_replace(x, rf"(?:(?:^|\s+){_NUMBER_TOKEN})+\s*$", "")
    x = F.btrim(F.regexp_replace(x, r"\s+", " "), F.lit(EDGES))
    return title(x)


def account_type(raw: Column) -> Column:
    """checking, credit, savings or unknown; a credit union is no credit."""
    x = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", " ")), r"\bcredit union\b", " ")
    out = F
    for kind, words in ACCOUNT_TYPES:
        out = out.when(x.rlike(rf"\b(?:{'|'.join(words)})\b"), kind)
    return out.otherwise("unknown")


def last4(number: Column) -> Column:
    """The last four digits; fewer if there are no more; null without any."""
    return F.nullif(F.right(F.regexp_replace(number, r"\D", ""), F.lit(4)), F.lit(""))


def account_id(bank: Column, four: Column, period_start: Column) -> Column:
    """A slug of bank and last digits, else one of the period's digest."""
    slug = F.btrim(F.regexp_replace(F.lower(F.concat_ws("-", F.nullif(bank, F.lit("")), four)), "[^a-z0-9]+", "-"), F.lit("-"))
    digest = F.substring(F.sha2(F.coalesce(period_start, F.lit("")), 256), 1, 8)
    return F.when(slug != "", slug).otherwise(F.concat(F.lit("unknown-"), digest))


def keyword_category(description: Column, amount: Column) -> Column:
    """The category of the first rule that matches; income needs money in; null if none or only Other."""
    x, out = F.coalesce(description, F.lit("")), F
    for pattern, category in KEYWORDS:
        hit = x.rlike(f"(?iu){pattern}")
        out = out.when(hit & (F.coalesce(amount, F.lit(0.0)) > 0) if category == "Income" else hit, F.lit(None if category == "Other" else category))
    return out.otherwise(F.lit(None))


def enrichment_category(name: Column) -> Column:
    """Another vocabulary's category in ours; null if it has none or only Other."""
    pairs = [F.lit(x) for pair in ENRICHMENT_CATEGORIES.items() for x in pair]
    return F.nullif(F.try_element_at(F.create_map(*pairs), F.trim(name)), F.lit("Other"))


def transfer_word(*descriptions: Column) -> Column:
    return F.upper(F.concat_ws(" ", *descriptions)).rlike("|".join(TRANSFER_WORDS))


def clean_text(x: Column) -> Column:
    """White space as single blanks; null for placeholders."""
    x = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.when(~F.lower(x).isin(*PLACEHOLDERS), x)


def currency_code(stated: Column) -> Column:
    """The three-letter code in the text, else that of a symbol in it, else null."""
    code = F.nullif(F.regexp_extract(F.upper(stated), r"\b([A-Z]{3})\b", 1), F.lit(""))
    symbols = {"€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR"}
    return F.coalesce(code, *(F.when(F.contains(stated, F.lit(s)), c) for s, c in symbols.items()))
