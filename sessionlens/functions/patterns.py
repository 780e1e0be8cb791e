"""Patterns, word lists and tables the results depend on."""

# --- fixed values: log content patterns, in tag order -------------------------------------------
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
LOG_URL = r"https?://(?:[-\w.])+(?::[\d]+)?(?:/(?:[\w/_.])*(?:\?(?:[\w&=%.])*)?(?:#(?:\w*))?)?"
LOG_PHONE = r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
LOG_CARD = (
    r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|3[0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b"
)
LOG_SSN = r"\b(?!000)(?!666)(?!9)\d{3}[-.]?(?!00)\d{2}[-.]?(?!0000)\d{4}\b"
IP_ADDRESS = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
WINDOWS_PATH = r"""[A-Za-z]:\\(?:[^\\/:*?"<>|\r\n]+\\)*[^\\/:*?"<>|\r\n]*"""
CLOCK_TIME = r"\b(?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9])?\b"
SLASH_DATE = r"\b(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12][0-9]|3[01])[/-](?:19|20)?\d{2}\b"
TAG_PATTERNS = {
    "email": EMAIL,
    "url": LOG_URL,
    "phone": LOG_PHONE,
    "credit_card": LOG_CARD,
    "ssn": LOG_SSN,
    "ip_address": IP_ADDRESS,
    "file_path": WINDOWS_PATH,
    "time": CLOCK_TIME,
    "date": SLASH_DATE,
}
REDACTED_PATTERNS = {"EMAIL": EMAIL, "PHONE": LOG_PHONE, "CREDIT_CARD": LOG_CARD, "SSN": LOG_SSN}

# --- fixed values: typed content patterns, first match wins -------------------------------------
SSN_DASHED = r"\b\d{3}-\d{2}-\d{4}\b"
CARD_GROUPS = r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"
PLAIN_URL = r"https?://[^\s]+"
PHONE_GROUPS, PHONE_PLAIN = r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", r"\b\d{10}\b"
DOTTED_NUMBERS = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
TYPED_WINDOWS_PATH, TYPED_UNIX_PATH = r"[A-Za-z]:\\[^\n]*", r"/[^\s]*"
LONG_KEY, SK_KEY, PK_KEY = r"[A-Za-z0-9]{32,}", r"sk-[A-Za-z0-9]+", r"pk_[A-Za-z0-9]+"
CONTENT_TYPES = {
    "password": [r"password", r"passwd", r"pwd", r"secret", r"token"],
    "email": [EMAIL],
    "phone": [PHONE_GROUPS, PHONE_PLAIN],
    "credit_card": [CARD_GROUPS],
    "ssn": [SSN_DASHED],
    "url": [PLAIN_URL],
    "ip_address": [DOTTED_NUMBERS],
    "file_path": [TYPED_WINDOWS_PATH, TYPED_UNIX_PATH],
    "api_key": [LONG_KEY, SK_KEY, PK_KEY],
    "code": [r"function\s+\w+", r"class\s+\w+", r"def\s+\w+", r"import\s+\w+"],
}
SENSITIVE_TYPES = ["password", "email", "phone", "credit_card", "ssn", "api_key"]
KEY_MARKERS = ["-----BEGIN", "-----END", "PRIVATE KEY", "CERTIFICATE", "ssh-rsa", "ssh-ed25519"]
TYPED_SENSITIVE = ["password", "passwd", "pwd", "pin", "secret", "token", "key", "auth"]
PASSWORD_PAIR = r"password\s*[:=]\s*\S+"
API_KEY_PAIR = r"api[_\s]?key\s*[:=]\s*\S+"
CREDENTIAL_WORDS = ["password", "passwd", "pwd", "token", "key", "secret", "auth"]
ANY_WINDOWS_PATH = r"[A-Za-z]:\\[^\s]+"
ANY_UNIX_PATH = r"/[^\s]+"

# --- fixed values: title redaction ---------------------------------------------------------------
TITLE_SECRETS = [
    r"password", r"login", r"signin", r"auth", r"private", r"confidential", r"secret", r"\b\d{4}\b", r"@\w+\.\w+",
]
TITLE_PATH = r"[A-Za-z]:\\[^\n]*"

# --- fixed values: special keys shown as symbols ---------------------------------------------------
KEY_SYMBOLS = {
    "<backspace>": "⌫", "<enter>": "↵", "<tab>": "⇥", "<space>": " ",
    "<shift>": "⇧", "<ctrl>": "⌃", "<alt>": "⌥", "<delete>": "⌦",
}

# --- fixed values: labels of raw events and the kinds they stand for ---------------------------------
LABEL_KINDS = {
    "Text Input": "keyboard", "Mouse Click": "mouse", "Clipboard Change": "clipboard", "Window Change": "window",
}

# --- fixed values: indicator -> (column, words), matched as lower-case substrings --------------------
KEYWORD_INDICATORS = {
    "admin_tool_access": ("app", ["cmd", "powershell", "regedit", "services", "taskmgr"]),
    "file_manager_access": ("app", ["explorer", "finder", "nautilus"]),
    "network_tool_access": ("app", ["wireshark", "netstat", "tcpdump"]),
    "dev_tool_access": ("app", ["studio", "code", "git", "terminal"]),
    "browser_private_mode": ("app", ["private", "incognito"]),
    "admin_application": ("app", ["admin", "elevated", "administrator"]),
    "system_application": ("app", ["system", "services", "registry"]),
    "security_application": ("app", ["security", "firewall", "antivirus"]),
    "admin_commands": ("content", ["sudo", "runas", "net user", "chmod", "chown"]),
    "file_operations": ("content", ["copy", "move", "delete", "rm", "cp", "mv"]),
    "network_commands": ("content", ["ping", "nslookup", "netstat", "ssh", "ftp"]),
    "system_info_commands": ("content", ["systeminfo", "whoami", "id", "ps", "top"]),
    "system_commands": ("content", ["cmd", "powershell", "terminal", "sudo", "admin"]),
    "sensitive_content": ("content", ["password", "secret", "key", "token"]),
    "typed_file_operations": ("content", ["delete", "remove", "copy", "move"]),
    "network_activity": ("content", ["download", "upload", "ftp", "ssh"]),
    "database_access": ("content", ["database", "sql", "mysql", "postgres", "oracle"]),
    "config_file_access": ("content", ["config", ".conf", ".ini", ".xml", ".json"]),
    "log_file_access": ("content", [".log", "logs", "audit", "event"]),
    "backup_access": ("content", ["backup", ".bak", ".zip", ".tar"]),
    "sensitive_directory": ("content", ["system32", "etc", "var", "tmp", "temp"]),
    "sudo_usage": ("content", ["sudo"]),
    "runas_usage": ("content", ["runas"]),
    "admin_elevation": ("content", ["administrator", "admin", "root", "elevation"]),
    "user_management": ("content", ["net user", "useradd", "usermod", "passwd"]),
    "group_management": ("content", ["net group", "groupadd", "groupmod"]),
    "service_management": ("content", ["sc create", "systemctl", "service"]),
    "registry_access": ("content", ["regedit", "reg add", "reg delete"]),
    "policy_changes": ("content", ["gpedit", "secpol", "policy"]),
    "file_compression": ("content", ["zip", "rar", "7z", "tar", "gzip"]),
    "encryption_tools": ("content", ["encrypt", "gpg", "openssl", "cipher"]),
    "cloud_services": ("content", ["dropbox", "google drive", "onedrive", "icloud"]),
    "file_transfer": ("content", ["ftp", "sftp", "scp", "rsync", "wget", "curl"]),
    "email_attachment": ("content", ["attachment", "send", "forward", "mailto"]),
    "network_upload": ("content", ["upload", "send", "post", "put", "transfer"]),
    "large_file_operations": ("content", ["gb", "gigabyte", "tb", "terabyte", "large", "big"]),
}
BROWSERS = ["chrome", "firefox", "edge", "safari"]
OFFICE_APPS = ["word", "excel", "powerpoint", "outlook"]
DEV_APPS = ["code", "studio", "terminal", "cmd"]
ADMIN_WORDS = ["sudo", "admin", "administrator", "runas", "elevation"]
NETWORK_WORDS = ["http", "ftp", "ssh", "download", "upload", "transfer"]

# --- fixed values: keyboard rows (top, home, bottom) and the finger of each column -------------------
KEYBOARD_ROWS = ["qwertyuiop", "asdfghjkl", "zxcvbnm"]
COLUMN_FINGERS = [0, 1, 2, 3, 3, 6, 6, 7, 8, 9]
SPECIAL_KEYS = ["shift", "ctrl", "alt", "tab", "enter", "backspace"]

# --- fixed values: score -> label tables, (label, inclusive lower bound), highest first ---------------
LEVELS = {
    "severity": [("critical", 0.9), ("high", 0.8), ("medium", 0.7), ("low", None)],
    "alert": [("critical", 0.95), ("high", 0.9), ("medium", 0.8), ("low", None)],
    "risk": [("critical", 0.9), ("high", 0.7), ("medium", 0.5), ("low", 0.3), ("minimal", None)],
    "status": [("critical", 0.9), ("elevated", 0.7), ("moderate", 0.5), ("normal", None)],
    "confidence": [("very_high", 0.9), ("high", 0.8), ("medium", 0.6), ("low", 0.4), ("very_low", None)],
    "threat": [("critical", 0.8), ("high", 0.6), ("medium", 0.4), ("low", None)],
}
SEVERITY_SCORES = {"low": 0.2, "medium": 0.5, "high": 0.8, "critical": 1.0}

# --- fixed values: weights ------------------------------------------------------------------------
RISK_WEIGHTS = {
    "behavioral_anomaly": 0.25, "keystroke_anomaly": 0.20, "insider_threat": 0.30,
    "temporal_risk": 0.15, "access_risk": 0.10,
}
THREAT_WEIGHTS = {
    "access_patterns": 0.2, "data_usage": 0.25, "temporal_behavior": 0.15,
    "privilege_escalation": 0.25, "data_exfiltration": 0.3,
}
VOTE_WEIGHTS = {"isolation_forest": 0.3, "one_class_svm": 0.3, "dbscan": 0.2, "supervised": 0.2}
DIMENSION_TERMS = {
    "access_patterns": ["access", "application", "window", "file"],
    "data_usage": ["clipboard", "data", "usage", "size"],
    "temporal_behavior": ["time", "hour", "day", "gap", "burst"],
    "privilege_escalation": ["sudo", "admin", "elevation", "privilege"],
    "data_exfiltration": ["transfer", "compression", "encryption", "cloud"],
}

# --- fixed values: advice and policy texts -----------------------------------------------------------
FACTOR_NAMES = {
    "behavioral_anomaly": "unusual behavior patterns",
    "keystroke_anomaly": "abnormal typing patterns",
    "insider_threat": "potential insider threat indicators",
    "temporal_risk": "suspicious timing patterns",
    "access_risk": "risky access patterns",
}
FACTOR_ADVICE = {
    "behavioral_anomaly": [
        "Review recent user activity patterns",
        "Verify user identity through additional authentication",
        "Monitor for continued anomalous behavior",
    ],
    "keystroke_anomaly": [
        "Verify user identity through keystroke dynamics",
        "Check for potential unauthorized access",
        "Review typing pattern changes",
    ],
    "insider_threat": [
        "Investigate potential insider threat activity",
        "Review data access and transfer patterns",
        "Consider additional monitoring and restrictions",
    ],
    "temporal_risk": [
        "Verify authorization for after-hours access",
        "Review business justification for activity timing",
        "Consider implementing time-based access controls",
    ],
    "access_risk": [
        "Review application and system access patterns",
        "Verify authorization for sensitive system access",
        "Consider implementing additional access controls",
    ],
}
LEVEL_RECOMMENDATIONS = {
    "critical": [
        "immediate_investigation_required", "isolate_user_session", "notify_security_team",
        "preserve_forensic_evidence", "consider_account_suspension",
    ],
    "high": [
        "enhanced_monitoring", "verify_user_identity", "review_recent_activities",
        "check_for_indicators_of_compromise",
    ],
    "medium": ["increase_logging_level", "monitor_for_escalation", "correlate_with_other_events"],
    "low": ["continue_normal_monitoring", "log_for_trend_analysis"],
}
TYPE_RECOMMENDATIONS = {
    "account_takeover": ["force_password_reset", "review_account_privileges"],
    "insider_threat": ["review_data_access_patterns", "check_for_data_exfiltration"],
    "cross_platform_anomaly": ["verify_device_trust_level", "check_network_location"],
}
LEVEL_ACTIONS = {
    "low": ["log_alert"],
    "medium": ["log_alert", "notify_admin"],
    "high": ["log_alert", "notify_admin", "isolate_user", "preserve_evidence"],
    "critical": ["log_alert", "notify_admin", "isolate_user", "block_action", "preserve_evidence"],
}
TYPE_ACTIONS = {
    "account_takeover": ["require_mfa", "notify_admin"],
    "insider_threat": ["isolate_user", "preserve_evidence"],
    "cross_platform_anomaly": ["require_mfa", "notify_admin"],
    "adversarial_attack": ["block_action", "preserve_evidence"],
}
ESCALATE_EVERY = {"medium": 5, "high": 3, "critical": 1}
ESCALATE_EVERY_OTHER = 10
METRIC_LIMITS = {"cpu": 80.0, "memory": 85.0, "disk": 90.0, "process_mb": 100.0}
