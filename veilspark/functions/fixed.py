"""Fixed values.

FIXED VALUES — these must equal the behaviour being matched for results to agree:
regular expressions, phrase lists, stop-word lists, checksum tables, labels and the
type/category vocabulary. They are stated here plainly, in natural order, and are
only *data*; all logic that uses them is written as Spark column expressions in
``veilspark.functions`` / ``veilspark.operators``.

Regex dialect: patterns are Java regular expressions (Spark's ``rlike`` /
``regexp_extract_all`` / ``split``).
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Categories and type vocabulary (46 types, 3 categories)
# ---------------------------------------------------------------------------
CREDENTIAL = "CREDENTIAL"
PERSONAL_INFO = "PERSONAL_INFO"
BUSINESS_CONFIDENTIAL = "BUSINESS_CONFIDENTIAL"

CREDENTIAL_TYPES = [
    "PASSWORD", "PIN", "CVV", "OTP", "API_KEY", "ACCESS_TOKEN", "PRIVATE_KEY", "DATABASE_CREDENTIAL",
]
PERSONAL_TYPES = [
    "EMAIL", "PHONE", "SSN", "CREDIT_CARD", "IP_ADDRESS", "PAN_CARD", "AADHAAR", "PASSPORT",
    "DATE_OF_BIRTH", "PERSON_NAME", "DRIVERS_LICENSE", "HOME_ADDRESS", "MEDICAL_DIAGNOSIS",
    "BIOMETRIC_TEMPLATE", "SALARY_INFO", "BANK_ACCOUNT",
    "GPS_COORDINATES", "LIVE_LOCATION", "VOTER_ID", "NATIONAL_ID", "TAX_ID", "EMPLOYEE_ID",
    "STUDENT_ID", "CUSTOMER_ID", "PERSONAL_ACCOUNT_ID", "DEVICE_ID", "ADVERTISING_ID", "USERNAME",
    "DIGITAL_SIGNATURE", "PERSONAL_PHOTOGRAPH", "FAMILY_MEMBER_DETAILS", "EMERGENCY_CONTACT",
]
BUSINESS_TYPES = [
    "CONFIDENTIAL_SOURCE_CODE", "INTERNAL_SYSTEM_INSTRUCTIONS", "CUSTOMER_DATABASE",
    "EMPLOYEE_RECORDS", "SECURITY_CONFIG", "TRADE_SECRET",
]
ALL_TYPES = PERSONAL_TYPES + CREDENTIAL_TYPES + BUSINESS_TYPES

# Credentials that always block unless the destination is an authorised gateway.
STRICT_TYPES = ["PIN", "CVV", "OTP", "PASSWORD", "PRIVATE_KEY", "DATABASE_CREDENTIAL"]

# ---------------------------------------------------------------------------
# Pattern detectors
# ---------------------------------------------------------------------------
EMAIL_PATTERN = r"(?i)\b([a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,})\b"
EMAIL_OBFUSCATED_PATTERN = (
    r"(?i)\b([a-z0-9._%+-]+(?:\s*\[at\]\s*|\s*\(at\)\s*|\s+at\s+)[a-z0-9.-]+"
    r"(?:\s*\[dot\]\s*|\s*\(dot\)\s*|\s+dot\s+|\.)[a-z]{2,})\b"
)

PHONE_PATTERNS = [
    r"(?:^|(?<=[^\w]))\+\d{1,3}[-.\s]?(?:\(?\d{2,4}\)?[-.\s]?)?\d{3,5}[-.\s]?\d{4,6}\b",
    r"(?:^|(?<=[^\w]))(?:\+?1[-.\s]?)?(?:\(\d{3}\)|\d{3})[-.\s]\d{3}[-.\s]\d{4}\b",
    r"(?:^|(?<=[^\w]))(?:\+91[-.\s]?|0)?[6-9]\d{4}[-.\s]?\d{5}\b",
    r"(?:^|(?<=[^\w]))(?:\+91\s*|0\s*)?[6-9]\s*\d(?:\s*\d){8}\b",
]
PHONE_DATE_SHAPE = r"^\d{4}[-/.]\d{2}[-/.]\d{2}$"

SSN_PATTERN = r"\b(\d{3})[- ](\d{2})[- ](\d{4})\b"

CARD_PATTERN = (
    r"\b(?:4[0-9]{12}(?:[0-9]{3})?"
    r"|(?:5[1-5][0-9]{2}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12}"
    r"|3[47][0-9]{13}"
    r"|6(?:011|5[0-9]{2})[0-9]{12}"
    r"|\d{4}[- ]\d{4}[- ]\d{4}[- ]\d{4}"
    r"|\d{4}[- ]\d{6}[- ]\d{5}"
    r")\b"
)

IPV4_PATTERN = (
    r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}"
    r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
)

API_KEY_PATTERNS = [
    r"\b(?:sk-[A-Za-z0-9]{32,}|sk-proj-[A-Za-z0-9_-]{32,})\b",
    r"\b(AKIA[0-9A-Z]{16})\b",
    r"\b(ghp_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{40,})\b",
    r"\b(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{24,}\b",
    r"(?i)\bBearer\s+([A-Za-z0-9\-_=]{24,})\b",
]

PAN_PATTERN = r"\b[A-Z]{3}[PCHFATBLJG][A-Z]\d{4}[A-Z]\b"
AADHAAR_PATTERN = r"(?<!\d)([2-9]\d{3}[ -]?\d{4}[ -]?\d{4})(?![ -]?\d)"

# Confidence per detector.
CONFIDENCE = {
    "EMAIL": 0.98, "EMAIL_OBFUSCATED": 0.95, "PHONE": 0.95, "SSN": 0.99, "CREDIT_CARD": 0.99,
    "IP_ADDRESS": 0.97, "API_KEY": 0.99, "PAN_CARD": 0.99, "AADHAAR": 0.98,
}

# Verhoeff checksum tables (multiplication d, permutation p).
VERHOEFF_D = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    [1, 2, 3, 4, 0, 6, 7, 8, 9, 5],
    [2, 3, 4, 0, 1, 7, 8, 9, 5, 6],
    [3, 4, 0, 1, 2, 8, 9, 5, 6, 7],
    [4, 0, 1, 2, 3, 9, 5, 6, 7, 8],
    [5, 9, 8, 7, 6, 0, 4, 3, 2, 1],
    [6, 5, 9, 8, 7, 1, 0, 4, 3, 2],
    [7, 6, 5, 9, 8, 2, 1, 0, 4, 3],
    [8, 7, 6, 5, 9, 3, 2, 1, 0, 4],
    [9, 8, 7, 6, 5, 4, 3, 2, 1, 0],
]
VERHOEFF_P = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    [1, 5, 7, 6, 2, 8, 3, 0, 9, 4],
    [5, 8, 0, 3, 7, 9, 6, 1, 4, 2],
    [8, 9, 1, 6, 0, 4, 3, 5, 2, 7],
    [9, 4, 5, 3, 1, 2, 6, 8, 7, 0],
    [4, 2, 8, 6, 5, 7, 3, 9, 0, 1],
    [2, 7, 9, 3, 8, 0, 6, 4, 1, 5],
    [7, 0, 4, 6, 9, 1, 3, 2, 5, 8],
]

# ---------------------------------------------------------------------------
# Context phrases per type (whole-word match when <= 4 chars and no space)
# ---------------------------------------------------------------------------
PHRASES = {
    "PIN": [
        "debit card pin", "debit card password", "atm pin", "atm card pin",
        "bank card pin", "cash withdrawal pin", "card security pin", "banking pin",
        "four-digit card pin", "my card's secret number", "the pin used at an atm",
        "pin for withdrawing cash", "the number i enter at the atm",
        "the secret code for my debit card", "upi pin", "atm passcode",
        "debit pin", "secret atm pin", "card pin", "atm secret code", "pin number",
        "secret pin", "my card pin", "enter at the atm",
    ],
    "PASSWORD": [
        "passcode", "login secret", "account password", "sign-in code", "signin code",
        "master password", "admin password", "user password", "login password",
        "secret password", "password is", "passphrase", "login credential",
        "portal password", "system password", "auth password", "credential password",
    ],
    "CVV": [
        "card security code", "card verification value", "security digits",
        "cvv", "cvc", "cvv2", "cid", "3-digit security code", "3 digit security code",
        "back of the card code", "card verification code", "card security digits",
        "cvc code", "cvv code", "security code on back",
    ],
    "OTP": [
        "one-time code", "verification code", "login code", "authentication code",
        "one-time password", "sms code", "2fa code", "mfa code", "security code",
        "email otp", "sms otp", "mobile verification code", "one time pin", "auth code",
        "otp", "otp is", "otp code", "your otp", "login otp",
    ],
    "ACCESS_TOKEN": [
        "bearer token", "authorization token", "session access token", "access token",
        "oauth token", "session token", "jwt token", "refresh token", "id token",
        "api access token", "client token", "auth token",
    ],
    "PRIVATE_KEY": [
        "signing key", "secret cryptographic key", "private encryption key",
        "rsa private key", "id_rsa", "openssh private key", "private key",
        "ecdsa private key", "secret key file", "cryptographic private key",
    ],
    "DATABASE_CREDENTIAL": [
        "db password", "database login", "connection-string credentials",
        "database credentials", "postgres password", "mysql password",
        "mongodb uri", "redis auth", "db credentials", "database password",
        "db connection string", "database secret",
    ],
    "API_KEY": [
        "api secret", "developer key", "service key", "access credential",
        "openai key", "aws access key", "aws secret", "github token", "stripe key",
        "api key", "client secret", "production api key", "developer secret",
    ],
    "PASSPORT": [
        "passport id", "passport document number", "passport number",
        "travel document number", "passport no", "international passport",
    ],
    "DATE_OF_BIRTH": [
        "dob", "birth date", "date of birth", "born on", "birthday",
        "birthdate", "natal date",
    ],
    "DRIVERS_LICENSE": [
        "driver's license", "drivers license", "driver license", "driving license",
        "dl number", "dl no", "dl num", "driver license number", "dl",
        "driver's license no", "driver's licence", "driving licence",
    ],
    "PERSON_NAME": [
        "customer name", "client name", "user name", "patient name", "applicant name",
        "individual name", "full name", "employee name", "profile for", "record for",
        "account holder", "member name",
    ],
    "HOME_ADDRESS": [
        "residential address", "home location", "permanent address",
        "living address", "home address", "house address", "delivery address",
        "residence address", "mailing address",
    ],
    "MEDICAL_DIAGNOSIS": [
        "medical diagnosis", "health condition", "diagnosed illness",
        "clinical diagnosis", "medical report", "patient diagnosis",
        "disease diagnosis", "diagnosed with", "medical condition",
        "pathology report", "clinical condition", "health status",
    ],
    "BIOMETRIC_TEMPLATE": [
        "face template", "fingerprint template", "iris template", "voiceprint",
        "biometric template", "facial geometry", "retina scan", "fingerprint data",
        "biometric signature",
    ],
    "SALARY_INFO": [
        "salary", "pay details", "compensation", "monthly salary", "remuneration",
        "annual ctc", "base salary", "pay slip", "wage", "take-home pay",
        "annual package", "hourly rate",
    ],
    "BANK_ACCOUNT": [
        "bank account number", "account number", "banking account id",
        "account details", "checking account", "savings account", "iban",
        "routing number", "ach account", "bank account",
    ],
    "AADHAAR": [
        "aadhaar", "aadhaar number", "aadhaar no", "aadhaar num", "aadhaar card", "aadhaar id",
        "aadhar", "aadhar number", "aadhar no", "aadhar num", "aadhar card", "aadhar id",
        "adhaar", "adhaar number", "adhaar no", "adhaar num", "adhaar card", "adhaar id",
        "adhar", "adhar number", "adhar card", "adhar no", "adhar num", "adhar id",
        "uidai", "uidai number", "uidai no", "uidai num", "uidai id",
        "uid number", "uid no", "uid num",
        "my aadhaar", "my aadhar", "my adhaar", "my adhar",
        "national id", "indian uid",
    ],
    "PAN_CARD": [
        "pan card", "pan number", "pan no", "pan num", "permanent account number",
        "my pan", "pan id", "income tax pan", "tax pan",
    ],
    "CONFIDENTIAL_SOURCE_CODE": [
        "proprietary code", "internal repository code", "private application source",
        "confidential source code", "trade secret algorithms", "internal source code",
        "source repository", "proprietary algorithm", "core algorithm codebase",
    ],
    "INTERNAL_SYSTEM_INSTRUCTIONS": [
        "system prompt", "hidden instructions", "internal model configuration",
        "base instructions", "system directive", "developer prompt",
        "internal instructions", "system prompt instructions", "hidden prompt",
    ],
    "CUSTOMER_DATABASE": [
        "customer database", "customer table", "customer records database",
        "client database", "crm database", "user database table",
    ],
    "EMPLOYEE_RECORDS": [
        "employee database", "employee records", "staff records",
        "hr database", "payroll records", "personnel files",
    ],
    "SECURITY_CONFIG": [
        "security configuration", "firewall rules configuration", "internal network topology",
        "vulnerability report", "security audit findings", "infosec policy configuration",
    ],
    "TRADE_SECRET": [
        "trade secret", "confidential business plan", "unreleased product roadmap",
        "merger documents", "proprietary financial model",
    ],
}

CONTEXT_WINDOW_CHARS = 70

# Send-type verbs and external destinations for the transmission-intent check.
SEND_VERBS = ["send", "forward", "transmit", "upload", "export", "share", "post", "dispatch"]
EXTERNAL_TARGETS = [
    "external assistant", "external service", "third party", "unapproved",
    "public api", "external api", "outside assistant", "assistant", "external tool",
]

# Scheduling / operational phrases that can veto a PIN or Aadhaar candidate.
OPERATIONAL_STOPWORDS = [
    "3pm", "3 pm", "4pm", "5pm", "9am", "10am", "11am", "12pm",
    "31st nov", "30th nov", "1st jan", "tomorrow", "yesterday",
    "november", "december", "january", "schedule", "leave",
    "port 8080", "port 443", "year 2024", "year 2025", "year 2026",
    "model 4821", "order 4821", "room 4821", "suite 4821", "flight 4821",
]

# Words that disqualify a person-name candidate.
NAME_STOPWORDS = [
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december",
    "general", "motors", "production", "environment", "new", "york", "united", "states",
    "next", "quarter", "project", "schedule", "meeting", "system", "service", "cloud",
    "customer", "terms", "conditions", "privacy", "policy", "internal", "external",
    "spring", "summer", "autumn", "winter", "north", "south", "east", "west",
]

# Relationship triple "X's predicate is/was/= value".
RELATIONSHIP_PATTERN = r"(?i)([A-Z][a-zA-Z]+|[a-zA-Z]+)'s\s+([a-zA-Z\s]+?)\s+(?:is|was|=)\s+([^\s,.;]+)"

PIN_CANDIDATE = r"\b(\d{4,6})\b"
CVV_CANDIDATE = r"\b(\d{3,4})\b"
OTP_CANDIDATE = r"\b(\d{4,8})\b"
PIN_SUBJECT_HINTS = ["pin", "atm", "card"]
AADHAAR_SUBJECT_HINTS = ["aadhaar", "aadhar", "adhaar", "adhar", "uidai"]

PASSWORD_PATTERN = (
    r"(?i)(?:password|passcode|login secret|account password|sign-in code|auth password)"
    r"\s*(?:is|was|:|=|->|\s+)\s*([^\s,.;]+)"
)
PASSWORD_REJECT_WORDS = ["never", "not", "should", "always", "shared", "kept"]

SYSTEM_PROMPT_MARKERS = [
    "system prompt", "hidden instructions", "internal model configuration",
    "you are an ai assistant", "ignore all previous instructions",
    "internal prompt directive", "base system instructions",
]
SOURCE_CODE_MARKERS = [
    r"def\s+[a-zA-Z_][a-zA-Z0-9_]*\(.*?\):",
    r"class\s+[a-zA-Z_][a-zA-Z0-9_]*(?:\(.*?\))?:",
    r"import\s+[a-zA-Z_][a-zA-Z0-9_.]*",
    r"#include\s+<.*?>",
    r"public\s+class\s+[a-zA-Z_][a-zA-Z0-9_]*",
    r"proprietary code", r"internal repository code", r"trade secret algorithms",
]
DB_MARKERS = [
    ("employee database", "EMPLOYEE_RECORDS"),
    ("staff records", "EMPLOYEE_RECORDS"),
    ("customer database", "CUSTOMER_DATABASE"),
    ("client database", "CUSTOMER_DATABASE"),
]

MEDICAL_PATTERN = r"(?i)(?:diagnosed with|diagnosis is|health condition:|medical report:)\s*([a-zA-Z\s]{3,30})"
SALARY_PATTERN = (
    r"(?i)(?:salary|compensation|annual ctc|monthly salary)\s*(?:is|was|:|=)\s*"
    r"([$€£₹]?\s*[\d,]+(?:\.\d+)?(?:\s*(?:k|lac|lakh|usd|inr|per annum|per month))?)"
)
DOB_PATTERN = (
    r"(?i)(?:(?:DOB|birth\s*date|date\s*of\s*birth|born\s*on|born|birthday|birthdate)\s*(?:is|was|:|=|->|\s)\s*)"
    r"(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+\d{1,2},?\s+\d{4})"
)
LICENCE_PATTERN = (
    r"(?i:\b(?:driver'?s?\s*licen[sc]e(?:\s*(?:no\.?|num(?:ber)?))?|driving\s*licen[sc]e(?:\s*(?:no\.?|num(?:ber)?))?|dl\s*num(?:ber)?|dl\s*no\.?|dl)\b\s*(?:is|was|:|=|->|#|\s)*\s*)"
    r"([A-Za-z0-9][A-Za-z0-9\s-]{4,18}[A-Za-z0-9])"
)
# Cue is case-insensitive, the name itself is case-sensitive.
PERSON_NAME_PATTERN = (
    r"(?i:(?:(?:customer|user|client|employee|patient|individual|applicant|profile|member|account(?:\s+holder)?)\s*(?:onboarding\s+)?(?::|=|->|\s+(?:name\s*(?:is|was|:|=|->)?|profile\s+for|record\s+for|for\s+))|(?:full\s+)?name\s*(?:is|was|:|=|->)?|named\s+|profile\s+for\s+|record\s+for\s+|onboarding\s+(?:profile\s+)?for\s+|(?:welcome\s+)?(?:note|letter|message|email|invitation)\s+to\s+|(?:Mr|Mrs|Ms|Miss|Dr|Prof)\.?\s*)\s*)"
    r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})"
)
PASSPORT_PATTERN = (
    r"(?i:(?:passport(?:\s*(?:no\.?|num(?:ber)?|id|doc))?|travel\s+document(?:\s+number)?)\s*(?:is|was|:|=|->|#|\s)\s*)"
    r"([A-Za-z][0-9]{7,9}|[A-Za-z0-9]{8,10})"
)
SSN_CONTEXT_PATTERN = (
    r"(?i:(?:ssn|social\s*security(?:\s*number)?)\s*(?:is|was|:|=|->|#|\s)\s*)"
    r"(\d{3}-\d{2}-\d{4}|\d{3}\s+\d{2}\s+\d{4})"
)
# One area-900+ value that the contextual SSN rule lets through (configurable allow list).
SSN_CONTEXT_ALLOW = ["999-12-3456"]
PAN_CONTEXT_PATTERN = r"(?i)(?<![A-Z0-9])([A-Z]{3}[PCHFATBLJG][A-Z]\d{4}[A-Z])(?![A-Z0-9])"

CONTEXT_CONFIDENCE = {
    "INTENT": 0.99, "PIN": 0.98, "PASSWORD": 0.96, "CVV": 0.97, "OTP": 0.95,
    "INTERNAL_SYSTEM_INSTRUCTIONS": 0.99, "CONFIDENTIAL_SOURCE_CODE": 0.95, "DB": 0.98,
    "MEDICAL_DIAGNOSIS": 0.93, "SALARY_INFO": 0.95, "DATE_OF_BIRTH": 0.96, "DRIVERS_LICENSE": 0.97,
    "PERSON_NAME": 0.95, "PASSPORT": 0.98, "SSN": 0.99, "AADHAAR_VALID": 0.99, "AADHAAR": 0.98,
    "PAN_CARD": 0.99,
}

# ---------------------------------------------------------------------------
# Evasion defence
# ---------------------------------------------------------------------------
# Invisible code points removed after NFKC normalisation.
INVISIBLE_CHARS = ["\u200b", "\u200c", "\u200d", "\u200e", "\u200f", "\ufeff", "\u00ad", "\u2060", "\u180e"]
BASE64_CANDIDATE = (
    r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{4}){2,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=|[A-Za-z0-9+/]{4})(?![A-Za-z0-9+/=])"
)
TOKEN_PREFIX = "⟦"
TOKEN_SUFFIX = "⟧"
FORGED_PREFIX_MARK = "[PRE_EXISTING_DELIM_L_"
FORGED_SUFFIX_MARK = "_DELIM_R]"
TOKEN_BODY = r"([a-zA-Z0-9_\-]+_[a-zA-Z0-9]+)"

# ---------------------------------------------------------------------------
# Policy defaults
# ---------------------------------------------------------------------------
DEFAULT_ALLOWLISTS = {
    BUSINESS_CONFIDENTIAL: [
        "internal_git_repo", "secure_vault", "approved_internal_storage",
        "enterprise_compliance_archive", "internal_code_analyzer",
    ],
    CREDENTIAL: ["internal_kms", "vault_service", "authorized_auth_gateway"],
    PERSONAL_INFO: ["*"],
}

# Default classification rules (rule name -> action).
DEFAULT_RULES = {
    "FULL_NAME": "TOKENIZE", "FIRST_NAME": "TOKENIZE", "MIDDLE_NAME": "TOKENIZE",
    "LAST_NAME": "TOKENIZE", "PERSON_NAME": "TOKENIZE", "NAME": "TOKENIZE",
    "DATE_OF_BIRTH": "TOKENIZE", "DOB": "TOKENIZE",
    "PERSONAL_EMAIL": "TOKENIZE", "BUSINESS_EMAIL": "TOKENIZE", "EMAIL": "TOKENIZE",
    "MOBILE_NUMBER": "TOKENIZE", "TELEPHONE_NUMBER": "TOKENIZE", "PHONE_NUMBER": "TOKENIZE",
    "PHONE": "TOKENIZE", "HOME_ADDRESS": "TOKENIZE", "PERMANENT_ADDRESS": "TOKENIZE",
    "TEMPORARY_ADDRESS": "TOKENIZE", "EMPLOYEE_ID": "TOKENIZE", "STUDENT_ID": "TOKENIZE",
    "REGISTRATION_NUMBER": "TOKENIZE", "UUCMS_NUMBER": "TOKENIZE", "CUSTOMER_ID": "TOKENIZE",
    "PERSONAL_ACCOUNT_ID": "TOKENIZE", "DEVICE_ID": "TOKENIZE", "ADVERTISING_ID": "TOKENIZE",
    "USERNAME": "TOKENIZE", "PERSONAL_USERNAME": "TOKENIZE", "FAMILY_MEMBER_DETAILS": "TOKENIZE",
    "EMERGENCY_CONTACT": "TOKENIZE", "EMERGENCY_CONTACT_DETAILS": "TOKENIZE",
    "PRECISE_GPS_COORDINATES": "REDACT", "GPS_COORDINATES": "REDACT", "LIVE_LOCATION": "REDACT",
    "AADHAAR_NUMBER": "REDACT", "AADHAAR": "REDACT", "PASSPORT_NUMBER": "REDACT",
    "PASSPORT": "REDACT", "DRIVING_LICENCE_NUMBER": "REDACT", "DRIVERS_LICENSE": "REDACT",
    "VOTER_ID_NUMBER": "REDACT", "VOTER_ID": "REDACT", "PAN_NUMBER": "REDACT",
    "PAN_CARD": "REDACT", "SOCIAL_SECURITY_NUMBER": "REDACT", "SSN": "REDACT",
    "NATIONAL_ID_NUMBER": "REDACT", "NATIONAL_ID": "REDACT",
    "TAX_IDENTIFICATION_NUMBER": "REDACT", "TAX_ID": "REDACT", "SIGNATURE_IMAGE": "REDACT",
    "DIGITAL_SIGNATURE": "REDACT", "PERSONAL_PHOTOGRAPH": "REDACT",
    "IP_ADDRESS": "MASK", "IP": "MASK",
    "PASSWORD": "BLOCK_TOOL", "PIN": "BLOCK_TOOL", "CVV": "BLOCK_TOOL", "OTP": "BLOCK_TOOL",
    "API_KEY": "BLOCK_TOOL",
}

# Rule-name aliases -> standard type (names are trimmed and upper-cased first).
TYPE_ALIASES = {
    "NAME": "PERSON_NAME", "PERSON_NAME": "PERSON_NAME", "FULL_NAME": "PERSON_NAME",
    "FIRST_NAME": "PERSON_NAME", "MIDDLE_NAME": "PERSON_NAME", "LAST_NAME": "PERSON_NAME",
    "SURNAME": "PERSON_NAME", "CUSTOMER_NAME": "PERSON_NAME",
    "PHONE": "PHONE", "PHONE_NUMBER": "PHONE", "MOBILE": "PHONE", "MOBILE_NUMBER": "PHONE",
    "TELEPHONE_NUMBER": "PHONE",
    "PASSPORT": "PASSPORT", "PASSPORT_NUMBER": "PASSPORT",
    "SSN": "SSN", "SOCIAL_SECURITY_NUMBER": "SSN",
    "EMAIL": "EMAIL", "PERSONAL_EMAIL": "EMAIL", "BUSINESS_EMAIL": "EMAIL",
    "CREDIT_CARD": "CREDIT_CARD", "CARD_NUMBER": "CREDIT_CARD",
    "AADHAAR": "AADHAAR", "AADHAAR_NUMBER": "AADHAAR",
    "PAN": "PAN_CARD", "PAN_CARD": "PAN_CARD", "PAN_NUMBER": "PAN_CARD",
    "DOB": "DATE_OF_BIRTH", "DATE_OF_BIRTH": "DATE_OF_BIRTH",
    "DL": "DRIVERS_LICENSE", "DRIVERS_LICENSE": "DRIVERS_LICENSE",
    "DRIVING_LICENCE_NUMBER": "DRIVERS_LICENSE",
    "IP": "IP_ADDRESS", "IP_ADDRESS": "IP_ADDRESS", "API_KEY": "API_KEY",
    "HOME_ADDRESS": "HOME_ADDRESS", "PERMANENT_ADDRESS": "HOME_ADDRESS",
    "TEMPORARY_ADDRESS": "HOME_ADDRESS",
    "PRECISE_GPS_COORDINATES": "GPS_COORDINATES", "GPS_COORDINATES": "GPS_COORDINATES",
    "LIVE_LOCATION": "LIVE_LOCATION", "VOTER_ID": "VOTER_ID", "VOTER_ID_NUMBER": "VOTER_ID",
    "NATIONAL_ID": "NATIONAL_ID", "NATIONAL_ID_NUMBER": "NATIONAL_ID",
    "TAX_ID": "TAX_ID", "TAX_IDENTIFICATION_NUMBER": "TAX_ID",
    "EMPLOYEE_ID": "EMPLOYEE_ID", "STUDENT_ID": "STUDENT_ID", "REGISTRATION_NUMBER": "STUDENT_ID",
    "UUCMS_NUMBER": "STUDENT_ID", "UUCMS": "STUDENT_ID", "CUSTOMER_ID": "CUSTOMER_ID",
    "PERSONAL_ACCOUNT_ID": "PERSONAL_ACCOUNT_ID", "PERSONAL_ACCOUNT_IDENTIFIER": "PERSONAL_ACCOUNT_ID",
    "DEVICE_ID": "DEVICE_ID", "ADVERTISING_ID": "ADVERTISING_ID",
    "USERNAME": "USERNAME", "PERSONAL_USERNAME": "USERNAME",
    "SIGNATURE_IMAGE": "DIGITAL_SIGNATURE", "DIGITAL_SIGNATURE": "DIGITAL_SIGNATURE",
    "PERSONAL_PHOTOGRAPH": "PERSONAL_PHOTOGRAPH", "PHOTO": "PERSONAL_PHOTOGRAPH",
    "FAMILY_MEMBER_DETAILS": "FAMILY_MEMBER_DETAILS", "EMERGENCY_CONTACT": "EMERGENCY_CONTACT",
    "EMERGENCY_CONTACT_DETAILS": "EMERGENCY_CONTACT",
}

# Type names used by external annotations (unknown names fall back to EMAIL).
ANNOTATION_TYPE_ALIASES = {
    "EMAIL": "EMAIL", "EMAIL_ADDRESS": "EMAIL", "PHONE": "PHONE", "PHONE_NUMBER": "PHONE",
    "MOBILE": "PHONE", "SSN": "SSN", "SOCIAL_SECURITY_NUMBER": "SSN",
    "CREDIT_CARD": "CREDIT_CARD", "CARD_NUMBER": "CREDIT_CARD", "DEBIT_CARD": "CREDIT_CARD",
    "IP_ADDRESS": "IP_ADDRESS", "IP": "IP_ADDRESS", "API_KEY": "API_KEY", "SECRET_KEY": "API_KEY",
    "ACCESS_TOKEN": "ACCESS_TOKEN", "TOKEN": "ACCESS_TOKEN", "BEARER_TOKEN": "ACCESS_TOKEN",
    "PRIVATE_KEY": "PRIVATE_KEY", "PAN": "PAN_CARD", "PAN_CARD": "PAN_CARD",
    "AADHAAR": "AADHAAR", "AADHAAR_NUMBER": "AADHAAR", "AADHAAR_CARD": "AADHAAR",
    "ADHAAR": "AADHAAR", "ADHAR": "AADHAAR", "UIDAI": "AADHAAR",
    "PIN": "PIN", "ATM_PIN": "PIN", "PASSWORD": "PASSWORD", "PASSCODE": "PASSWORD",
    "CVV": "CVV", "OTP": "OTP", "PASSPORT": "PASSPORT",
    "DATE_OF_BIRTH": "DATE_OF_BIRTH", "DOB": "DATE_OF_BIRTH", "BIRTH_DATE": "DATE_OF_BIRTH",
    "PERSON_NAME": "PERSON_NAME", "NAME": "PERSON_NAME", "FULL_NAME": "PERSON_NAME",
    "CUSTOMER_NAME": "PERSON_NAME", "DRIVERS_LICENSE": "DRIVERS_LICENSE",
    "DRIVER_LICENSE": "DRIVERS_LICENSE", "DL": "DRIVERS_LICENSE",
    "HOME_ADDRESS": "HOME_ADDRESS", "ADDRESS": "HOME_ADDRESS",
    "BANK_ACCOUNT": "BANK_ACCOUNT", "ACCOUNT_NUMBER": "BANK_ACCOUNT",
    "MEDICAL_DIAGNOSIS": "MEDICAL_DIAGNOSIS", "SALARY_INFO": "SALARY_INFO",
    "CONFIDENTIAL_SOURCE_CODE": "CONFIDENTIAL_SOURCE_CODE",
    "INTERNAL_SYSTEM_INSTRUCTIONS": "INTERNAL_SYSTEM_INSTRUCTIONS",
    "CUSTOMER_DATABASE": "CUSTOMER_DATABASE", "EMPLOYEE_RECORDS": "EMPLOYEE_RECORDS",
}

# Mask labels.
MASK_LABELS = {
    "CONFIDENTIAL_SOURCE_CODE": "[SOURCE_CODE_REDACTED]",
    "INTERNAL_SYSTEM_INSTRUCTIONS": "[SYSTEM_INSTRUCTION_REDACTED]",
    "CUSTOMER_DATABASE": "[DATABASE_DUMP_BLOCKED]",
    "EMPLOYEE_RECORDS": "[EMPLOYEE_RECORDS_REDACTED]",
    "BUSINESS_OTHER": "[BUSINESS_CONFIDENTIAL_REDACTED]",
    "CREDENTIAL": "[REDACTED_CREDENTIAL]",
    "EMAIL_NO_AT": "***@***.***",
    "PHONE_SHORT": "***-***-****",
    "PASSPORT_SHORT": "[REDACTED_PASSPORT]",
    "BANK_SHORT": "[REDACTED_ACCOUNT]",
    "DOB_OTHER": "[DOB_REDACTED]",
    "NAME_EMPTY": "[NAME_REDACTED]",
    "DL_SHORT": "[DL_REDACTED]",
    "SALARY_INFO": "[SALARY_REDACTED]",
    "MEDICAL_DIAGNOSIS": "[HEALTH_RECORD_REDACTED]",
    "BIOMETRIC_TEMPLATE": "[BIOMETRIC_REDACTED]",
    "HOME_ADDRESS": "[ADDRESS_REDACTED]",
    "IP_OTHER": "*.*.*.*",
}

# Repairs of almost-JSON: quote bare keys, then bare-word values (pattern, replacement).
JSON_REPAIRS = [
    (r"([{,]\s*)([a-zA-Z_]\w*)\s*:", '$1"$2":'),
    (r":\s*([a-zA-Z_]\w*)([,\s}])", ': "$1"$2'),
]

# Keyword routing of free prompts to tool names (first rule that holds wins, then the default).
PROMPT_ROUTES = [
    ("send_email", ["email"]),
    ("external_assistant", ["pin", "atm", "password", "credential", "assistant"]),
    ("stripe_payment", ["card", "credit", "pay", "charge", "stripe", "billing"]),
    ("kyc_verify", ["aadhaar", "aadhar", "adhaar", "adhar", "pan", "kyc", "identity"]),
    ("crm_service", ["crm", "customer", "contact", "salesforce"]),
    ("cloud_deploy", ["deploy", "server", "ip", "api key", "aws", "openai"]),
]
PROMPT_DEFAULT_TOOL = "send_email"
PROMPT_DEFAULT_SUBJECT = "Leave Notification"
PROMPT_SCHEDULES = [(["3pm", "3 pm"], "3:00 PM"), (["tomorrow"], "Tomorrow")]
PROMPT_DEFAULT_SCHEDULE = "Immediate"
