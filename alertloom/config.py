"""Constants and default rule tables.

Everything here is a fixed value that results depend on. Each operator takes
its table as an argument, so a caller can pass another one.
"""

from __future__ import annotations

# --- Fixed values: limits and window lengths -------------------------------
INITIAL_SCAN_ROWS = 200
TREND_BUCKETS = 60
RULE_CHART_SIZE = 15

CLUSTER_MIN = 5
CLUSTER_MAX = 50
SIMILARITY_THRESHOLD = 0.7
RETENTION_DAYS = {
    "cluster": 90,
    "daily": 365,
    "weekly": 730,
    "monthly": 1825,
    "quarterly": 3650,
}
SUMMARY_LENGTHS = {
    "cluster": (50, 2000),
    "daily": (100, 5000),
    "weekly": (200, 8000),
    "monthly": (500, 12000),
    "quarterly": (800, 15000),
}

# --- Fixed values: entity patterns in extraction order ----------------------
IPV4 = r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
HOST = r"(?i)\b[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?)*\.[A-Za-z]{2,6}\b"
COMPUTER = r"(?i)\b[A-Za-z0-9\-]{2,15}-(?:PC|SERVER|WS|SRV|DC)\b"
WORKSTATION = r"(?i)\b(?:DESKTOP|LAPTOP|SERVER|DC|WORKSTATION)-[A-Za-z0-9\-]+\b"
USER = r"(?i)\b(?:user_|admin_|service_|svc_)[A-Za-z0-9\-_]+\b"
DOMAIN_USER = r"(?i)\b[A-Za-z0-9]{2,}\\{1,2}[A-Za-z0-9\-_\.]+\b"
WINDOWS_PATH = r"(?i)\b[C-Z]:\\{1,2}[\\A-Za-z0-9\s\.\-_\(\)]+\b"
UNIX_PATH = r"(?i)\b/[/A-Za-z0-9\s\.\-_\(\)]+\b"
PROCESS = r"(?i)\b[A-Za-z0-9\-_]+\.(?:exe|dll|bat|cmd|ps1|sh)\b"
MD5 = r"\b[a-fA-F0-9]{32}\b"
SHA1 = r"\b[a-fA-F0-9]{40}\b"
SHA256 = r"\b[a-fA-F0-9]{64}\b"
SHA512 = r"\b[a-fA-F0-9]{128}\b"
NAMED_COMPUTER = r"(?i)\b[A-Za-z]{2,8}[0-9]{4,8}\b"

ENTITY_PATTERNS = [
    ("IP", IPV4),
    ("HOST", HOST),
    ("COMPUTER", COMPUTER),
    ("WORKSTATION", WORKSTATION),
    ("USER", USER),
    ("DOMAIN_USER", DOMAIN_USER),
    ("WINDOWS_PATH", WINDOWS_PATH),
    ("UNIX_PATH", UNIX_PATH),
    ("PROCESS", PROCESS),
    ("MD5_HASH", MD5),
    ("SHA1_HASH", SHA1),
    ("SHA256_HASH", SHA256),
]

# Addresses as logs write them, without a check of the ranges.
LOGGED_IPV4 = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
LOGGED_PATTERNS = [(label, LOGGED_IPV4 if label == "IP" else pattern) for label, pattern in ENTITY_PATTERNS]

# Labels of the query-side set; several patterns may share one label.
QUERY_ENTITY_PATTERNS = [
    ("IP", IPV4),
    ("HOST", HOST),
    ("COMPUTER", COMPUTER),
    ("COMPUTER", WORKSTATION),
    ("COMPUTER", NAMED_COMPUTER),
    ("USER", USER),
    ("USER", DOMAIN_USER),
    ("PROCESS", PROCESS),
    ("HASH", MD5),
    ("HASH", SHA1),
    ("HASH", SHA256),
]

# --- Fixed values: personal data patterns ----------------------------------
PII_PATTERNS = [
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("ssn", r"\b\d{3}\s\d{2}\s\d{4}\b"),
    ("ssn", r"\b\d{9}\b"),
    ("credit_card", r"\b4\d{3}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"),
    ("credit_card", r"\b5[1-5]\d{2}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"),
    ("credit_card", r"\b3[47]\d{2}[\s-]?\d{6}[\s-]?\d{5}\b"),
    ("credit_card", r"\b6011[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("phone", r"\b\d{3}-\d{3}-\d{4}\b"),
    ("phone", r"\(\d{3}\)\s?\d{3}-\d{4}"),
    ("phone", r"\b\d{3}\.\d{3}\.\d{4}\b"),
    ("phone", r"\+1[\s-]?\d{3}[\s-]?\d{3}[\s-]?\d{4}"),
    ("name", r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b"),
    ("name", r"\b[A-Z][a-z]+\s+[A-Z]\.\s+[A-Z][a-z]+\b"),
    ("address", r"(?i)\d+\s+[A-Za-z0-9\s]+\s+(?:Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Lane|Ln|Boulevard|Blvd)"),
    ("date_of_birth", r"\b\d{1,2}/\d{1,2}/\d{4}\b"),
    ("date_of_birth", r"\b\d{4}-\d{2}-\d{2}\b"),
    ("date_of_birth", r"(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b"),
]
PII_CONTEXT = 50
PII_KEEP = 0.7
PII_LOG_WORDS = ["log", "debug", "trace", "error"]
PII_PERSONAL_WORDS = ["personal", "identity", "private", "confidential"]
PII_FALSE_WORDS = {
    "ssn": ["test", "example", "000-00-0000", "123-45-6789"],
    "credit_card": ["test", "example", "0000", "1111", "1234"],
    "email": ["example.com", "test.com", "localhost"],
    "phone": ["555-555-5555", "000-000-0000", "123-456-7890"],
}
PII_FALSE_CONTEXT = ["example", "test", "sample", "dummy", "fake"]
PII_FALSE_SSN = ["000000000", "111111111", "123456789"]
PII_TEST_DOMAINS = ["example.com", "test.com", "localhost", "domain.com"]
PII_WEIGHTS = {
    "ssn": 1.0,
    "credit_card": 1.0,
    "email": 0.7,
    "phone": 0.6,
    "name": 0.4,
    "address": 0.8,
    "date_of_birth": 0.9,
    "drivers_license": 0.9,
    "passport": 1.0,
    "custom": 0.8,
}

# --- Fixed values: security indicator patterns -----------------------------
INDICATOR_PATTERNS = [
    ("ip_address", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"),
    ("ip_address", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"),
    ("domain", r"\b[a-zA-Z0-9][a-zA-Z0-9-]{0,61}[a-zA-Z0-9]?\.[a-zA-Z]{2,}\b"),
    ("file_hash", MD5),
    ("file_hash", SHA1),
    ("file_hash", SHA256),
    ("file_hash", SHA512),
    ("port", r"(?:port|Port|PORT)[\s:=]+\d{1,5}\b"),
    ("port", r":\d{1,5}\b"),
    ("protocol", r"(?i)\b(?:HTTP|HTTPS|FTP|FTPS|SSH|TELNET|SMTP|POP3|IMAP|DNS|DHCP|SNMP|TCP|UDP|ICMP)\b"),
    ("process_name", r"(?i)\b\w+\.exe\b"),
    ("process_name", r"(?i)\b\w+\.dll\b"),
    ("process_name", r"/usr/bin/\w+\b"),
    ("process_name", r"/sbin/\w+\b"),
    ("cve", r"(?i)\bCVE-\d{4}-\d{4,}\b"),
    ("signature_id", r"(?i)\bSID[\s:=]+\d+\b"),
    ("signature_id", r"(?i)\bRule[\s:=]+\d+\b"),
    ("event_id", r"(?i)\bEvent[\s:=]+ID[\s:=]+\d+\b"),
    ("event_id", r"(?i)\bEventID[\s:=]+\d+\b"),
]
INDICATOR_CONTEXT = 30
INDICATOR_PII_CONTEXT = 50
INDICATOR_PII_WORDS = [
    "personal", "private", "confidential", "name", "address", "phone", "email",
    "ssn", "social security", "credit card", "employee id", "customer id",
    "account number",
]
INDICATOR_ALERT_WORDS = ["alert", "warning", "error", "threat", "attack", "malware", "virus"]
INDICATOR_EXAMPLE_WORDS = ["example", "test", "sample", "placeholder"]
INDICATOR_KEPT = ["file_hash", "cve", "protocol", "port", "event_id", "signature_id"]
# type -> (policy, minimum confidence); types not listed use ("default", 0.7)
INDICATOR_POLICY = {
    "ip_address": ("default", 0.7),
    "domain": ("default", 0.7),
    "file_hash": ("always", 0.8),
    "cve": ("always", 0.9),
    "protocol": ("always", 0.8),
    "port": ("always", 0.8),
}
INDICATOR_MINIMUM = 0.7
# type -> factor of the confidence of a listed value
THREAT_BOOST = {"ip_address": 1.2, "domain": 1.3, "file_hash": 1.5}
KNOWN_DOMAINS = [
    "microsoft.com", "google.com", "amazon.com", "apple.com", "github.com",
    "stackoverflow.com", "cloudflare.com",
]
HASH_TYPES = {32: "MD5", 40: "SHA1", 64: "SHA256", 128: "SHA512"}

# --- Fixed values: special address ranges of the public registries ------------
# Dotted addresses outside the private, loopback and link-local ranges.
RESERVED_IPV4 = r"^(?:0\.|192\.0\.0\.|192\.0\.2\.|198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|2[45][0-9]\.)"
RESERVED_IPV4_EXCEPT = ["192.0.0.9", "192.0.0.10"]
# IPv6 as 32 hexadecimal digits: loopback and link local; private and reserved ranges; exceptions to those.
SYSTEM_IPV6 = r"^(?:0{31}1$|fe[89ab])"
RESERVED_IPV6 = r"^(?:0{32}$|0{20}ffff|0064ff9b0001|0100000000000000|2001(?:00|01)|20010db8|2002|3fff0|f[cd])"
RESERVED_IPV6_EXCEPT = r"^(?:20010001000000000000000000000001$|20010001000000000000000000000002$|20010003|200100040112|2001002|2001003)"

# --- Fixed values: redaction ------------------------------------------------
# type -> (strategy, keep format, minimum confidence)
REDACTION_RULES = {
    "ssn": ("tokenize", True, 0.8),
    "credit_card": ("mask", True, 0.8),
    "email": ("tokenize", False, 0.7),
    "phone": ("mask", True, 0.7),
    "name": ("tokenize", False, 0.6),
    "address": ("tokenize", False, 0.7),
    "date_of_birth": ("mask", True, 0.8),
}
REDACTION_DEFAULT = ("tokenize", False, 0.7)
# mode -> (keep indicators, aggressive, keep context, tokenise identifiers)
REDACTION_MODES = {
    "embedding": (True, False, True, True),
    "display": (True, True, True, False),
    "export": (False, True, False, False),
    "analysis": (True, False, True, True),
}
AGGRESSIVE_MINIMUM = 0.6
# Any value works here; jobs that must produce equal tokens share one.
DEFAULT_SALT = "alertloom-salt"

# --- Fixed values: audit ----------------------------------------------------
AUDIT_BASE_RISK = {
    "authentication": 0.3,
    "authorization": 0.2,
    "data_access": 0.4,
    "pii_detection": 0.7,
    "security_violation": 0.9,
    "configuration_change": 0.5,
    "system_error": 0.3,
}
AUDIT_OTHER_RISK = 0.1
AUDIT_OUTCOME_FACTOR = {"FAILURE": 1.5, "PARTIAL": 1.2}
AUDIT_SEVERITY_FACTOR = {"low": 1.0, "medium": 1.3, "high": 1.6, "critical": 2.0}
AUDIT_HIGH_RISK = 0.7
# kind -> (window seconds, limit)
RATE_LIMITS = {
    "failed_auth": (60, 10),
    "pii_detection": (3600, 50),
    "high_risk": (3600, 5),
    "api_error": (60, 20),
}

# --- Fixed values: requests and sessions ------------------------------------
REQUESTS_PER_MINUTE = 60
BURST_LIMIT = 10
BURST_SECONDS = 10
MAX_VIOLATIONS = 10
MAX_REQUEST_BYTES = 10 * 1024 * 1024
SLOW_SECONDS = 5.0
SCANNER_AGENTS = ["sqlmap", "nikto", "nmap", "masscan", "nessus", "openvas"]
LOCKOUT_FAILURES = 5
LOCKOUT_MINUTES = 15
MAX_SESSIONS = 5
SESSION_IDLE_MINUTES = 60
SESSION_ABSOLUTE_HOURS = 8

# --- Fixed values: search ---------------------------------------------------
BM25_K1 = 1.5
BM25_B = 0.75
SEMANTIC_WEIGHT = 0.6
KEYWORD_WEIGHT = 0.4
ENTITY_BOOST = 3
STRATEGY_BONUS = {
    "entity_exact": 25,
    "ai_generated": 20,
    "semantic_context": 15,
    "related_term": 10,
    "broad_context": 5,
}
PRIORITY_BONUS = {"high": 20, "medium": 10}
RELEVANCE_WORDS = [
    "error", "failure", "alert", "warning", "critical", "suspicious",
    "authentication", "cryptographic",
]
SUMMARY_STEMS = [
    "error", "fail", "alert", "warn", "critical", "auth", "crypto", "cert",
    "suspicious", "attack",
]
FALLBACK_QUERIES = [
    "security events authentication",
    "system failures errors",
    "suspicious activity alerts",
]
HOST_SUFFIXES = ["login", "authentication", "cryptographic", "certificate", "failure", "error"]
IP_SUFFIXES = ["connection", "traffic", "suspicious"]
USER_SUFFIXES = ["login", "authentication", "access", "privilege"]
COMMON_SUFFIXES = ["alert", "warning", "critical", "suspicious activity", "security event"]
RULE_BASE_SUFFIXES = [
    "error failure", "authentication login", "cryptographic certificate",
    "suspicious activity", "security event alert",
]
RULE_HOST_SUFFIXES = ["authentication failure", "cryptographic error", "certificate issue", "login problem"]
RULE_IP_SUFFIXES = ["connection suspicious", "network traffic", "security alert"]
RULE_USER_SUFFIXES = ["privilege escalation", "access denied", "authentication failure"]
CONTEXT_PREFIXES = ["security events", "authentication issues", "cryptographic failures", "suspicious activity"]
BROAD_PREFIXES = ["issues problems", "failures errors", "security events", "alerts warnings"]
ENTITY_SEARCH_SUFFIXES = ["authentication", "login", "cryptographic", "certificate", "failure", "error"]

# --- Fixed values: attack phrases -------------------------------------------
FAILURE_PHRASES = ["authentication failed", "login failed", "invalid password"]
LOGIN_PHRASES = ["login attempt", "authentication", "logon"]

# --- Fixed values: input validation ------------------------------------------
VALID_EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
VALID_URL = r"^https?://(?:[-\w.])+(?:[:\d]+)?(?:/(?:[\w/_.])*(?:\?(?:[\w&=%.])*)?(?:#(?:\w*))?)?$"
VALID_IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$"
VALID_IPV6 = r"^(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$"
VALID_UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
VALID_FILENAME = r"^[a-zA-Z0-9._-]+$"
SQL_INJECTION = (
    r"(?i)(?:union\s+select)|(?:select\s+.*\s+from)|(?:insert\s+into)|(?:update\s+.*\s+set)"
    r"|(?:delete\s+from)|(?:drop\s+(?:table|database))|(?:create\s+(?:table|database))"
    r"|(?:alter\s+table)|(?:exec(?:ute)?)|(?:sp_)|(?:xp_)|(?:--)|(?:/\*.*?\*/)"
)
XSS = (
    r"(?i)(?:<script[^>]*>)|(?:</script>)|(?:javascript:)|(?:vbscript:)|(?:on\w+\s*=)"
    r"|(?:<iframe[^>]*>)|(?:<object[^>]*>)|(?:<embed[^>]*>)|(?:<link[^>]*>)|(?:<meta[^>]*>)"
    r"|(?:expression\s*\()|(?:@import)|(?:data:text/html)"
)
PATH_TRAVERSAL = r"(?:\.\.[\\/]|[\\/]\.\.[\\/]|[\\/]\.\.$)"
COMMAND_INJECTION = r"(?:[;&|`])|(?:\$\(.*?\))|(?:`.*?`)|(?:\|\s*\w+)|(?:>\s*[\w/.-]+)|(?:<\s*[\w/.-]+)"
MAX_STRING_LENGTH = 10_000
MAX_JSON_DEPTH = 10
