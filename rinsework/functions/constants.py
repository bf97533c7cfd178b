"""Results depend on exactly these lists, tables and patterns."""

from __future__ import annotations

# Gazetteers, in lower case.

INDIAN_STATES = [
    "andhra pradesh", "arunachal pradesh", "assam", "bihar", "chhattisgarh", "goa", "gujarat", "haryana", "himachal pradesh", "jharkhand",
    "karnataka", "kerala", "madhya pradesh", "maharashtra", "manipur", "meghalaya", "mizoram", "nagaland", "odisha", "punjab", "rajasthan", "sikkim",
    "tamil nadu", "telangana", "tripura", "uttar pradesh", "uttarakhand", "west bengal", "delhi", "chandigarh", "puducherry", "ladakh",
    "jammu and kashmir",
]

US_STATES = [
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida", "georgia", "hawaii", "idaho",
    "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine", "maryland", "massachusetts", "michigan", "minnesota", "mississippi",
    "missouri", "montana", "nebraska", "nevada", "new hampshire", "new jersey", "new mexico", "new york", "north carolina", "north dakota", "ohio",
    "oklahoma", "oregon", "pennsylvania", "rhode island", "south carolina", "south dakota", "tennessee", "texas", "utah", "vermont", "virginia",
    "washington", "west virginia", "wisconsin", "wyoming",
]

CITIES = [
    "hyderabad", "bengaluru", "bangalore", "mumbai", "delhi", "chennai", "kolkata", "pune", "ahmedabad", "jaipur", "surat", "lucknow", "kanpur",
    "nagpur", "indore", "thane", "bhopal", "visakhapatnam", "patna", "vadodara", "new york", "los angeles", "chicago", "houston", "phoenix",
    "philadelphia", "san antonio", "san diego", "dallas", "san jose", "austin", "seattle", "san francisco",
]

COUNTRIES = [
    "united kingdom", "uk", "great britain", "united states", "usa", "us", "germany", "france", "australia", "canada", "india", "japan", "china",
    "brazil", "spain", "italy", "netherlands", "switzerland", "sweden", "singapore", "united arab emirates", "uae", "ireland", "norway", "belgium",
    "austria", "denmark", "finland", "poland", "portugal", "new zealand", "south africa", "mexico", "israel", "greece", "czech republic", "hong kong",
    "malaysia", "thailand", "philippines", "indonesia", "taiwan", "chile", "argentina", "colombia", "peru", "saudi arabia", "turkey", "cyprus", "rsa",
    "eire", "channel islands", "european community", "unspecified", "iceland", "lithuania", "malta", "bahrain", "lebanon", "russia", "south korea",
    "korea",
]

CURRENCY_SYMBOLS = ["$", "€", "£", "₹", "¥", "rs", "inr", "usd", "eur", "gbp"]

# Names that title case would get wrong, and short or former names.

SPECIAL_CASE = {"uk": "United Kingdom", "u.k.": "United Kingdom", "great britain": "United Kingdom", "usa": "USA", "uae": "UAE", "rsa": "RSA"}

CITY_SHORT = {
    "hyd": "Hyderabad", "sec": "Secunderabad", "blr": "Bangalore", "mum": "Mumbai", "del": "Delhi", "chn": "Chennai", "kol": "Kolkata", "pune": "Pune",
    "nyc": "New York", "sf": "San Francisco", "la": "Los Angeles", "chi": "Chicago",
}

CITY_CANONICAL = {
    "hyd": "Hyderabad", "hyderabad": "Hyderabad", "secunderabad": "Secunderabad", "bengaluru": "Bengaluru", "bangalore": "Bengaluru", "blr": "Bengaluru",
    "mumbai": "Mumbai", "bombay": "Mumbai", "delhi": "Delhi", "new delhi": "Delhi", "chennai": "Chennai", "madras": "Chennai", "kolkata": "Kolkata",
    "calcutta": "Kolkata", "pune": "Pune", "sf": "San Francisco", "san francisco": "San Francisco", "nyc": "New York", "new york": "New York",
    "ahmedabad": "Ahmedabad",
}

CITY_STATE = {
    "Hyderabad": "Telangana", "Secunderabad": "Telangana", "Bengaluru": "Karnataka", "Mumbai": "Maharashtra", "Pune": "Maharashtra", "Chennai": "Tamil Nadu",
    "Kolkata": "West Bengal", "Ahmedabad": "Gujarat", "San Francisco": "California", "New York": "New York",
}

OUTDATED_CITIES = ["hyd", "blr", "bombay", "calcutta", "madras"]

NOT_IN_NAMES = [
    "report", "dispatch", "accounts", "statement", "summary", "invoice", "section", "customer", "department", "profiles", "logs", "confidential",
    "internal", "use", "only", "enterprise", "active", "batch", "annual", "billing", "receipt", "order", "purchase", "overview", "client", "contact",
    "name", "phone", "email", "address", "city", "state", "date", "status", "number", "balance", "total", "amount", "paid", "due", "pending", "table",
    "data", "auditor", "audit", "organization", "vendor", "procurement", "reconciliation", "discrepancy", "metadata", "items", "issued", "solutions",
]

# Patterns.

EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
PHONE = r"^(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}$|^(?:\+?91[-.\s]?)?[6-9]\d{9}$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}(?:[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?$"
US_POSTAL = r"^\d{5}(-\d{4})?$"
INDIA_POSTAL = r"^[1-9]\d{5}$"
ANY_POSTAL = r"^(?:[1-9]\d{5}|\d{5}(?:-\d{4})?)$"
ANY_DATE = r"^(?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{4})(?:[T\s]\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?$"

PII_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PII_PHONE = r"(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b|\b(?:\+?91[-.\s]?)?[6-9]\d{9}\b"
PII_CARD = r"\b(?:\d{4}[-\s]?){3}\d{4}\b"
PII_AADHAAR = r"\b[2-9]\d{3}[-\s]?\d{4}[-\s]?\d{4}\b"
PII_SSN = r"\b\d{3}-\d{2}-\d{4}\b"

DOC_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
DOC_PHONE = r"(?:\+?91[-.\s]?)?[6-9]\d{9}\b|(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b"
DOC_DATE = r"\b(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})\b"
DOC_AMOUNT = r"(?i)(?:[\$€£₹]|(?:USD|EUR|GBP|INR|Rs\.?)\s?)\s*[\d,]+(?:\.\d{1,2})?|\b[\d,]+(?:\.\d{2})?\s*(?:USD|EUR|INR)\b"
DOC_INVOICE = r"(?i)\b(?:INVOICE|BILL|RECEIPT|INV)[-#:\s]+([A-Za-z0-9\-_]{3,20})\b"
DOC_POSTAL = r"\b(?:[1-9]\d{5}|\d{5}(?:-\d{4})?)\b"
DOC_ADDRESS = r"(?i)\b(?:\d+[/A-Za-z0-9\s,-]+)\s+(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Nagar|Colony|Hills|Banjara|Sector|Plaza|Floor)\b"
DOC_NAME = (
    r"(?i)(?:Customer(?:\s*Name)?|Client(?:\s*Name)?|Name|Bill\s*To|Contact(?:\s*Person)?)[^\S\r\n]*[:\-][^\S\r\n]*([A-Z][a-zA-Z\.\'-]+(?:[^\S\r\n]+[A-Z][a-zA-Z\.\'-]+)+)|"
    r"\b(?:Mr\.|Ms\.|Mrs\.)[^\S\r\n]*([A-Z][a-zA-Z\.\'-]+(?:[^\S\r\n]+[A-Z][a-zA-Z\.\'-]+)+)"
)
DOC_BOUNDARY = r"(?:\n[ \t]*\n+|(?<=\n)(?=(?:Customer(?:\s*Name)?|Vendor(?:\s*Name)?|Client|Bill\s*To|Contact|Key\s+Vendor|DISCREPANCY|SECTION:)\s*[:\-]?))"

# Kinds of entities in the order of search with the group that holds the value (None: the one that matched), how sure
# a match is, what a name's words look like, words of lines without postal codes, and words in the headers of tables.

DOC_KINDS = [
    ("InvoiceNo", DOC_INVOICE, 1), ("Email", DOC_EMAIL, 0), ("Phone", DOC_PHONE, 0), ("Date", DOC_DATE, 0), ("Amount", DOC_AMOUNT, 0),
    ("CustomerName", DOC_NAME, None), ("PostalCode", DOC_POSTAL, 0), ("Address", DOC_ADDRESS, 0),
]
DOC_CONFIDENCE = {"InvoiceNo": 0.98, "Email": 0.99, "Phone": 0.96, "Date": 0.92, "Amount": 0.94, "CustomerName": 0.98, "PostalCode": 0.88, "Address": 0.90}
NAME_EDGES = ".,;:()#-*|"
NAME_WORDS = r"[A-Z][a-zA-Z.'-]*(?: [A-Z][a-zA-Z.'-]*){1,3}"
NOT_POSTAL = ["phone", "contact", "mobile", "tel", "fax", "date", "inv", "balance", "$"]
HEADERS = [
    ("CustomerName", ("name", "customer", "client", "vendor")), ("Phone", ("phone", "mobile", "contact")), ("Email", ("email", "mail")), ("City", ("city",)),
    ("State", ("state",)), ("Date", ("date",)), ("Amount", ("amount", "price", "total", "balance", "cost")), ("InvoiceNo", ("invoice",)),
    ("PostalCode", ("zip", "postal", "pin")), ("Address", ("address",)),
]

# Null tokens, container keys of JSON documents, words in the names of columns.

NULL_TOKENS = ["", "NA", "N/A", "null", "NULL", "None", "NaN"]
CONTAINERS = ["data", "records", "rows", "items", "results", "entities", "entries", "content"]
CODE_WORDS = ["code", "zip", "postal", "phone", "id", "ssn", "ein", "tax", "mobile"]
IDENTIFIER_WORDS = ["id", "key", "uuid", "guid", "code", "pk", "num"]
MONEY_WORDS = ["amount", "salary", "price", "revenue", "cost", "fee", "balance"]

# The linear model of semantic types; a row for each feature, a column for each class.

SEMANTIC_CLASSES = ["City", "PostalCode", "State", "Email", "Currency", "Timestamp", "Other"]
SEMANTIC_WEIGHTS = [
    [0.0, 5.0, 0.0, 0.0, 2.0, 2.0, -1.0],  # digits
    [3.0, -2.0, 3.0, 1.0, 0.0, -2.0, 0.5],  # letters
    [1.5, -2.0, 2.0, -2.0, 0.5, 0.5, 0.0],  # white space
    [-2.0, -2.0, -2.0, 12.0, -2.0, -2.0, -2.0],  # e-mail addresses
    [-1.0, -1.0, -1.0, -1.0, 15.0, -5.0, -1.0],  # currency symbols
    [-2.0, 0.0, -2.0, -2.0, -2.0, 15.0, -2.0],  # dates
    [-2.0, 12.0, -2.0, -2.0, -2.0, -2.0, -2.0],  # postal codes
    [12.0, -2.0, -1.0, -2.0, -2.0, -2.0, -2.0],  # cities
    [-1.0, -2.0, 12.0, -2.0, -2.0, -2.0, -2.0],  # states
    [1.0, -1.0, 1.0, 1.5, 0.0, 2.0, 0.0],  # length
]
SEMANTIC_BIAS = [0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.0]
