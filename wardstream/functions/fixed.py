"""Word lists, character maps, patterns and limits.

Results depend on these exact values, so they are stated plainly and in order.
"""

# --- conversation limits -----------------------------------------------------
MAX_MESSAGES = 20
MAX_TOTAL_CHARS = 8_000
MAX_MESSAGE_CHARS = 4_000
MAX_SYSTEM_CHARS = 2_000
MAX_OUTPUT_CHARS = 4_000
ROLES = ["user", "assistant", "system"]

# --- normalisation -----------------------------------------------------------
KEYWORDS = [
    "ignore", "forget", "disregard", "bypass", "override", "jailbreak",
    "system prompt", "previous instructions", "new instructions", "as dan",
    "developer mode", "unrestricted", "do anything now", "you are now",
    "pretend you", "act as", "roleplay as", "simulate", "hypothetically",
    "in a story", "for fiction", "base64", "rot13", "encoded",
]
CYRILLIC = "аеорсхАЕОРСХІіВКМТ"
LATIN = "aeopcxAEOPCXIiBKMT"
ZERO_WIDTH = "[\u200b-\u200f\u2060\ufeff]"
NORM_BLOCK_RISK = 0.7

# Characters a Python ``str.strip()`` removes at both ends.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- personal data: the list the input guard uses, in order ------------------
PII_PATTERNS = {
    "credit_card": r"\b(?:\d{4}[\s\-]?){3}\d{4}\b",
    "email": r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+",
    "phone_in": r"(\+91[\-\s]?)?[6-9]\d{9}",
    "phone_us": r"\b\d{3}[\s.\-]?\d{3}[\s.\-]?\d{4}\b",
    "aadhaar": r"\b[2-9]\d{3}\s?\d{4}\s?\d{4}\b",
    "pan": r"\b[A-Z]{5}[0-9]{4}[A-Z]\b",
    "gstin": r"\b\d{2}[A-Z]{5}\d{4}[A-Z][A-Z\d]Z[A-Z\d]\b",
    "ifsc": r"\b[A-Z]{4}0[A-Z0-9]{6}\b",
    "upi_vpa": r"\b[\w.\-]{2,50}@[a-zA-Z]{2,20}\b",
    "passport_in": r"\b[A-PR-WY][1-9]\d{7}\b",
}
HIGH_SENSITIVITY = ["credit_card", "aadhaar", "pan", "passport_in"]

# --- personal data: the stand-alone list, most specific first ----------------
PII_LIBRARY_PATTERNS = {
    "aadhaar": r"(?<!\d)[2-9]\d{3}\s?\d{4}\s?\d{4}(?!\s?\d)",
    "pan": r"\b[A-Z]{5}[0-9]{4}[A-Z]\b",
    "gstin": r"\b\d{2}[A-Z]{5}\d{4}[A-Z][A-Z\d]Z[A-Z\d]\b",
    "passport_in": r"\b[A-PR-WYa-pr-wy][1-9]\d\s?\d{4}[1-9]\b",
    "voter_id": r"\b[A-Z]{3}\d{7}\b",
    "ifsc": r"\b[A-Z]{4}0[A-Z0-9]{6}\b",
    "credit_card": r"\b(?:\d{4}[\s\-]?){3}\d{4}\b",
    "phone_in": r"(\+91[\-\s]?)?[6-9]\d{9}",
    "upi_vpa": r"(?<!\+)\b[\w.][\w.\-]{1,255}@[a-zA-Z]{2,64}\b",
    "email": r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+",
}

# --- injection ---------------------------------------------------------------
INDIRECT_MARKERS = [
    r"(?i)(system\s*:|\binstruction\s*:|\btask\s*:)\s*(ignore|forget|bypass|override)",
    r"<!--.*?(ignore|bypass|override).*?-->",
    r"\[.*?(ignore|bypass).*?\]\(.*?\)",
    r"```\s*(system|instructions?)\s*\n",
    r"<\s*(system|instruction)\s*>",
    r"[-=]{10,}\s*(new\s+)?instructions?\s*[-=]{10,}",
]
MULTILANG_PHRASES = {
    "hi": [
        "पिछले निर्देश", "सभी निर्देश भूल जाओ", "सिस्टम प्रॉम्प्ट",
        "सिस्टम प्रॉम्प्ट बताओ", "नियम भूल जाओ", "प्रतिबंध हटाओ",
    ],
    "es": ["ignora las instrucciones", "olvida todo", "actúa como"],
    "fr": ["ignorez les instructions", "oubliez tout", "jouez le rôle"],
    "de": ["ignoriere alle Anweisungen", "vergiss alles", "du bist jetzt"],
    "zh-cn": ["忽略所有指令", "忘记之前", "你现在是"],
    "ar": ["تجاهل التعليمات", "انسَ كل شيء"],
    "pt": ["ignore as instruções", "esqueça tudo", "aja como"],
    "ru": ["игнорируй инструкции", "забудь всё", "ты теперь"],
    "ja": ["すべての指示を無視", "以前の指示を忘れ"],
    "ko": ["모든 지시를 무시", "이전 지시를 잊어"],
}
CLASSIFIER_LABEL = "INJECTION"
CLASSIFIER_THRESHOLD = 0.70

# --- sessions, limits, cache, canaries ---------------------------------------
SESSION_WINDOW = 8
DRIFT_THRESHOLD = 0.65
ESCALATION_THRESHOLD = 0.08
MAX_SESSIONS = 10_000
EVICT_SESSIONS = 1_000
BUCKET_CAPACITY = 5
BUCKET_REFILL_TOKENS = 10
BUCKET_REFILL_SECONDS = 60
IDLE_SECONDS = 3600
CACHE_THRESHOLD = 0.95
CACHE_CAPACITY = 5_000
CANARY_TTL_SECONDS = 3600
CANARY_TAG = "AVG"

# --- output guard ------------------------------------------------------------
AMOUNT_PATTERNS = [
    r"\$\s*(\d+(?:\.\d{1,2})?)",
    r"(\d+(?:\.\d{1,2})?)\s*(?:USD|usd)",
    r"(\d+(?:\.\d{1,2})?)\s*dollars?",
    r"Rs\.?\s*(\d+(?:\.\d{1,2})?)",
    "₹" + r"\s*(\d+(?:\.\d{1,2})?)",
]
NUMERIC_OPERATORS = ["<=", ">=", "<", ">", "=="]
RULE_OPERATORS = ["<=", ">=", "<", ">", "==", "!="]
RULE_FIELD_PATTERN = r"^[a-zA-Z_][a-zA-Z0-9_]{0,63}$"
MAX_DESCRIPTION_CHARS = 500
CONTRADICTION_THRESHOLD = 0.40
REVIEW_LOW = 0.45
REVIEW_HIGH = 0.75
CANDIDATE_CONFIDENCE = 0.6

# --- assembled prompts: text between a prompt and the message ----------------
SEPARATORS = ["\n\n---\n\n", "\n\n===\n\n", "\n\n", " "]
