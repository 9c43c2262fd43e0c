"""Fixed values about rules: scan patterns, sensitive data, techniques, scores and weaknesses."""

from __future__ import annotations

# Security rules as (id, severity, category, pattern, weakness); all ignore case.
SECURITY_RULES = [
    ("SEC001", "CRITICAL", "injection", r"(?:mysql_query|mysqli_query|pg_query)\s*\([^)]*\$_(?:GET|POST|REQUEST|COOKIE)", "CWE-89"),
    ("SEC002", "CRITICAL", "rce", r"\b(?:eval|assert)\s*\(\s*\$", "CWE-94"),
    ("SEC003", "CRITICAL", "rce", r"(?<!->)(?<!::)\b(?:exec|system|passthru|shell_exec|popen|proc_open)\s*\(\s*\$", "CWE-78"),
    ("SEC004", "CRITICAL", "credentials", r"""(?:password|passwd|secret_key|api_key|private_key|auth_token)\s*[=:]\s*['"][A-Za-z0-9+/=]{8,}['"]""", "CWE-798"),
    ("SEC010", "HIGH", "xss", r"echo\s+\$_(?:GET|POST|REQUEST|COOKIE)\s*\[", "CWE-79"),
    ("SEC011", "HIGH", "file_inclusion", r"(?:include|require)(?:_once)?\s*[\(]?\s*\$_(?:GET|POST|REQUEST)", "CWE-98"),
    ("SEC012", "HIGH", "deserialization", r"\bunserialize\s*\(\s*\$", "CWE-502"),
    ("SEC013", "HIGH", "upload", r"move_uploaded_file\s*\(.*?\$_(?:FILES|GET|POST)", "CWE-434"),
    ("SEC014", "HIGH", "crypto", r"\b(?:md5|sha1)\s*\(\s*\$.*password", "CWE-328"),
    ("SEC020", "MEDIUM", "injection", r"\$_(?:GET|POST|REQUEST|COOKIE)\s*\[.*?\](?!.*(?:htmlspecialchars|htmlentities|filter_|intval|escape|sanitize))", "CWE-20"),
    ("SEC021", "MEDIUM", "session", r"session_start\s*\(\s*\)(?!.*session_regenerate_id)", "CWE-384"),
    ("SEC022", "MEDIUM", "config", r"(?:display_errors|error_reporting)\s*[=(]\s*(?:1|true|E_ALL|on)", "CWE-209"),
    ("SEC023", "MEDIUM", "deprecated", r"\b(?:mysql_connect|mysql_query|mysql_fetch|mysql_select_db|ereg|split)\s*\(", "CWE-477"),
    ("SEC030", "LOW", "debug", r"\b(?:var_dump|print_r|debug_print_backtrace|debug_zval_dump)\s*\(", "CWE-506"),
    ("SEC031", "LOW", "header", r"""header\s*\(\s*['"]X-Powered-By""", "CWE-200"),
    ("SEC040", "INFO", "backdoor", r"\b(?:base64_decode|gzinflate|gzuncompress|str_rot13)\s*\(\s*(?:base64_decode|gzinflate)", "CWE-506"),
    ("SEC041", "INFO", "backdoor", r"""(?:preg_replace|preg_replace_callback)\s*\([^)]*['"].*?/e['"]""", "CWE-94"),
    ("SEC061", "CRITICAL", "obfuscation", r"\beval\s*\(\s*(?:gzinflate|gzuncompress)\s*\(\s*base64_decode", "CWE-506"),
    ("SEC063", "HIGH", "debug_tool", r"\bKint::|\\Kint\\|kint-php|(?<![a-zA-Z_])d\(\s*\$|Kint\\Renderer", "CWE-489"),
    ("SEC064", "CRITICAL", "info_disclosure", r"filp[/\\]whoops|PrettyPageHandler|Whoops\\Run|new\s+Whoops", "CWE-209"),
    ("SEC065", "MEDIUM", "config_exposure", r"Dotenv\\Dotenv|vlucas[/\\]phpdotenv|Dotenv::create", "CWE-538"),
    ("SEC066", "HIGH", "database_file", r"SQLite format 3|PRAGMA\s+journal_mode|sqlite_master", "CWE-506"),
    ("SEC067", "CRITICAL", "debug_tool", r"psy[/\\]psysh|Psy\\Shell|\\PsySH|psysh\.php|Psy\\Configuration", "CWE-489"),
    ("SEC068", "HIGH", "debug_tool", r"Symfony\\Component\\VarDumper|symfony[/\\]var-dumper|\bdump\s*\(\s*\$", "CWE-489"),
    ("SEC069", "HIGH", "debug_tool", r"Symfony\\Component\\Debug\\Debug|Debug::enable\(\)|Symfony\\Component\\Debug\\ErrorHandler", "CWE-489"),
    ("SEC070", "CRITICAL", "deserialization_rce", r"unserialize\s*\(\s*(?:decrypt|base64_decode)?\s*\(?\s*\$_COOKIE", "CWE-502"),
    ("SEC071", "CRITICAL", "rce_logic", r"""\beval\s*\(\s*['"]?\s*\$(?:result|eval_string|formula|actualFormula|calc)""", "CWE-94"),
    ("SEC072", "CRITICAL", "rce_logic", r"""\beval\s*\(\s*['"][^'"]*\s*['"]?\s*\.\s*\$""", "CWE-94"),
    ("SEC073", "HIGH", "injection", r"(?:db_query|mysqli?_query|query)\s*\([^)]*\$_(?:GET|POST|REQUEST).*(?:DataQuality|data_quality|dq_rule)", "CWE-89"),
    ("SEC074", "MEDIUM", "path_traversal", r"(?:file_get_contents|fopen|readfile|include|require)\s*\(.*\$.*(?:report|summarize|ai_|translate)", "CWE-22"),
    ("SEC075", "HIGH", "xss", r"(?:echo|print)\s+.*(?:messenger|thread|message_body|conversation)(?!.*htmlspecialchars)", "CWE-79"),
    ("SEC076", "HIGH", "xss", r"@INLINE\b.*(?:pdf|PDF|action_tag)|(?:pdf|PDF).*@INLINE", "CWE-79"),
    ("SEC077", "HIGH", "authorization", r"getUserRights\s*\(", "CWE-285"),
    ("SEC078", "HIGH", "authorization", r"(?:file_export|edoc|download).*(?:No\s*Access|access_level|user_rights)", "CWE-285"),
    ("SEC079", "HIGH", "injection", r"(?:mail|sendmail|send_email|Email::send)\s*\(.*\$_(?:GET|POST|REQUEST).*(?:from|sender)", "CWE-20"),
    ("SEC080", "CRITICAL", "persistence", r"php_value\s+auto_prepend_file", "CWE-94"),
    ("SEC081", "CRITICAL", "persistence", r"php_value\s+auto_append_file", "CWE-94"),
    ("SEC082", "CRITICAL", "persistence", r"auto_prepend_file\s*=", "CWE-94"),
    ("SEC083", "CRITICAL", "rfi", r"allow_url_include\s*=\s*(?:1|on|true)", "CWE-98"),
    ("SEC084", "HIGH", "persistence", r"\bstream_wrapper_register\s*\(", "CWE-94"),
    ("SEC085", "HIGH", "persistence", r"""\b(?:set_include_path|ini_set\s*\(\s*['"]include_path)\s*\(""", "CWE-426"),
    ("SEC086", "HIGH", "persistence", r"""\bdl\s*\(\s*['"]""", "CWE-94"),
    ("SEC087", "HIGH", "config_tamper", r"AddHandler\s+.*php", "CWE-434"),
    ("SEC088", "HIGH", "config_tamper", r"SetHandler\s+.*php", "CWE-434"),
    ("SEC089", "MEDIUM", "config_tamper", r"ProxyPass\s+", "CWE-441"),
    ("SEC090", "HIGH", "config_tamper", r"RewriteRule\s+.*https?://", "CWE-601"),
    ("SEC091", "HIGH", "config_tamper", r"php_flag\s+engine\s+on", "CWE-434"),
    ("SEC092", "HIGH", "config_tamper", r"disable_functions\s*=", "CWE-693"),
    ("SEC093", "CRITICAL", "injection", r"\bINTO\s+(?:OUTFILE|DUMPFILE)\s", "CWE-89"),
    ("SEC094", "HIGH", "backdoor", r"\bcreate_function\s*\(", "CWE-94"),
    ("SEC095", "HIGH", "backdoor", r"\$\{?\$\w+\}?\s*\(", "CWE-94"),
    ("SEC096", "MEDIUM", "config_tamper", r"open_basedir\s*=", "CWE-693"),
    ("SEC097", "HIGH", "supply_chain", r"""["']post-(?:install|update)-cmd["']""", "CWE-506"),
    ("SEC098", "HIGH", "webshell", r"file_put_contents\s*\([^)]*\.php", "CWE-94"),
    ("SEC099", "CRITICAL", "obfuscation", r"(?:str_rot13|gzinflate|gzuncompress|rawurldecode)\s*\(\s*(?:str_rot13|gzinflate|gzuncompress|rawurldecode|base64_decode)\s*\(", "CWE-506"),
]

# Web shell signatures; their ids go by position.
WEBSHELLS = [
    ("WEB000", "CRITICAL", "conclusive", r"\beval\s*\(\s*\$_(GET|POST|REQUEST|COOKIE)"),
    ("WEB001", "CRITICAL", "conclusive", r"\b(?:system|exec|passthru|shell_exec)\s*\(\s*\$_(GET|POST|REQUEST)"),
    ("WEB002", "CRITICAL", "conclusive", r"\beval\s*\(\s*(?:base64_decode|gzinflate|gzuncompress|str_rot13)\s*\("),
    ("WEB003", "HIGH", "suspicious", r"\$\w+\s*\(\s*\$_(GET|POST|REQUEST)"),
    ("WEB004", "CRITICAL", "conclusive", r"\bassert\s*\(\s*\$_(GET|POST|REQUEST|COOKIE)"),
    ("WEB005", "CRITICAL", "conclusive", r"""preg_replace\s*\(\s*['"][^'"]*/e['"]"""),
    ("WEB006", "CRITICAL", "conclusive", r"""\bcreate_function\s*\(\s*['"].*?['"]\s*,\s*\$"""),
    ("WEB007", "CRITICAL", "conclusive", r"file_put_contents\s*\(.*\$_(GET|POST|REQUEST)"),
    ("WEB008", "CRITICAL", "suspicious", r"(?:fsockopen|stream_socket_client)\s*\(\s*\$"),
    ("WEB009", "HIGH", "suspicious", r"__halt_compiler\s*\(\s*\)"),
]

# Sensitive data in order: (type, category, severity, counts for health privacy, pattern with one group).
SENSITIVE = [
    ("ssn", "PII", "CRITICAL", True, r"\b(\d{3}-\d{2}-\d{4})\b"),
    ("ssn_compact", "PII", "HIGH", True, r"(?<!\d)(\d{9})(?!\d)"),
    ("email", "PII", "MEDIUM", True, r"\b([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})\b"),
    ("phone", "PII", "MEDIUM", True, r"(\(\d{3}\)\s?\d{3}[.\-]\d{4})"),
    ("phone", "PII", "MEDIUM", True, r"\b(\d{3}[.\-]\d{3}[.\-]\d{4})\b"),
    ("phone", "PII", "MEDIUM", True, r"(\+1\d{10})\b"),
    ("credit_card_visa", "FINANCIAL", "CRITICAL", True, r"\b(4\d{3}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4})\b"),
    ("credit_card_mc", "FINANCIAL", "CRITICAL", True, r"\b(5[1-5]\d{2}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4})\b"),
    ("credit_card_amex", "FINANCIAL", "CRITICAL", True, r"\b(3[47]\d{2}[\s\-]?\d{6}[\s\-]?\d{5})\b"),
    ("credit_card_discover", "FINANCIAL", "CRITICAL", True, r"\b(6(?:011|5\d{2})[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4})\b"),
    ("ip_address", "INFRASTRUCTURE", "MEDIUM", True, r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"),
    ("api_token", "CREDENTIAL", "CRITICAL", True, r"\b([0-9A-Fa-f]{32})\b"),
    ("password", "CREDENTIAL", "CRITICAL", False, r"""\$(?:password|passwd|pwd)\s*=\s*['"](.+?)['"]"""),
    ("password", "CREDENTIAL", "CRITICAL", False, r"""(?:password|passwd|pwd)\s*[:=]\s*['"](.+?)['"]"""),
    ("db_credential", "CREDENTIAL", "HIGH", False, r"""\$(?:hostname|db|username|database_host|database_name|database_user)\s*=\s*['"](.+?)['"]"""),
    ("aws_access_key", "CREDENTIAL", "CRITICAL", False, r"\b(AKIA[0-9A-Z]{16})\b"),
    ("aws_secret_key", "CREDENTIAL", "CRITICAL", False, r"""(?:aws_secret_access_key|AWS_SECRET_ACCESS_KEY)\s*[:=]\s*['"]?([A-Za-z0-9/+=]{40})['"]?"""),
    ("private_key_rsa", "CREDENTIAL", "CRITICAL", False, r"(-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----)"),
    ("private_key_ec", "CREDENTIAL", "CRITICAL", False, r"(-----BEGIN\s+EC\s+PRIVATE\s+KEY-----)"),
    ("private_key_openssh", "CREDENTIAL", "CRITICAL", False, r"(-----BEGIN\s+OPENSSH\s+PRIVATE\s+KEY-----)"),
    ("base64_blob", "CREDENTIAL", "HIGH", False, r"""(?:=\s*|:\s*|'|")([A-Za-z0-9+/]{50,}={0,2})(?:'|"|\s|;|$)"""),
    ("date_of_birth", "PHI", "HIGH", True, r"""(?:dob|date.of.birth|birth.?date|DOB)\s*[:=]\s*['"]?(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})['"]?"""),
    ("medical_record_number", "PHI", "HIGH", True, r"""(?:mrn|medical.record|MRN|record.number)\s*[:=]\s*['"]?([A-Za-z0-9]{6,10})['"]?"""),
    ("person_name", "PHI", "HIGH", True, r"""(?:patient_name|first_name|last_name|patientName|firstName|lastName)\s*[:=]\s*['"]([A-Za-z\s\-'.]{2,60})['"]"""),
    ("jwt_token", "CREDENTIAL", "HIGH", True, r"\b(eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+)\b"),
]
REDACTED = "***REDACTED***"

# Lines that the quick gate lets pass (it misses types such as addresses; off unless parity is asked for).
QUICK_GATE = (
    r"(?i)\d{3}[\-]\d{2}[\-]\d{4}|@|\(\d{3}\)|\+1\d{10}|\d{4}[\s\-]?\d{4}[\s\-]?\d{4}|AKIA|BEGIN.{0,10}PRIVATE|password|passwd|pwd|\$hostname|\$db|\$username"
    r"|aws_secret|eyJ[A-Za-z0-9_\-]{10}|dob|birth|mrn|medical.record|patient_name|first_name|last_name|patientName|firstName|lastName"
    r"|[A-Za-z0-9+/]{50}|[0-9a-fA-F]{32}"
)

# Techniques, scores and weaknesses by rule id, looked up with ever shorter beginnings.
TECHNIQUES = {
    "SEC001": "T1190", "SEC002": "T1059.004", "SEC003": "T1059.004", "SEC004": "T1552.001", "SEC005": "T1059.004", "SEC006": "T1055.001", "SEC007": "T1059.004",
    "SEC008": "T1059.004", "SEC009": "T1059.004", "SEC010": "T1059.004", "SEC011": "T1189", "SEC012": "T1189", "SEC013": "T1083", "SEC014": "T1105",
    "SEC015": "T1005", "SEC016": "T1036", "SEC017": "T1059.004", "SEC018": "T1600", "SEC019": "T1600", "SEC020": "T1190", "SEC021": "T1190", "SEC022": "T1090",
    "WEB000": "T1505.003", "WEB001": "T1505.003", "WEB002": "T1505.003", "WEB003": "T1027", "WEB004": "T1505.003", "WEB005": "T1505.003", "WEB006": "T1027.010",
    "WEB007": "T1505.003", "WEB008": "T1071.001", "WEB009": "T1505.003", "IOC-FP": "T1505.003", "IOC-FC": "T1505.003", "IOC-CT": "T1543", "IOC-PS": "T1546",
    "IOC-OB": "T1027", "IOC-CR": "T1552.001", "IOC-WS": "T1505.003", "IOC-SC": "T1195", "IOC-IR": "T1505.003", "MAGIKA": "T1036.008",
}
SCORES = {
    "SEC001": 9.8, "SEC002": 10.0, "SEC003": 10.0, "SEC004": 9.1, "SEC005": 10.0, "SEC006": 9.8, "SEC007": 9.8, "SEC008": 8.8, "SEC009": 8.8, "SEC010": 7.5,
    "SEC011": 6.1, "SEC012": 6.1, "SEC013": 7.5, "SEC014": 9.1, "SEC015": 6.5, "SEC016": 9.8, "SEC017": 9.8, "SEC018": 5.9, "SEC019": 5.9, "SEC020": 9.1,
    "SEC021": 7.5, "SEC022": 8.2, "WEB000": 10.0, "WEB001": 10.0, "WEB002": 10.0, "WEB003": 9.8, "WEB006": 9.8,
}
WEAKNESSES = {
    "SEC001": "CWE-89", "SEC002": "CWE-94", "SEC003": "CWE-78", "SEC004": "CWE-798", "SEC005": "CWE-78", "SEC006": "CWE-98", "SEC007": "CWE-94", "SEC008": "CWE-94",
    "SEC009": "CWE-94", "SEC010": "CWE-94", "SEC011": "CWE-79", "SEC012": "CWE-79", "SEC013": "CWE-22", "SEC014": "CWE-22", "SEC015": "CWE-22", "SEC016": "CWE-434",
    "SEC017": "CWE-502", "SEC018": "CWE-328", "SEC019": "CWE-330", "SEC020": "CWE-90", "SEC021": "CWE-611", "SEC022": "CWE-918", "WEB000": "CWE-94",
    "WEB001": "CWE-94", "WEB002": "CWE-94", "WEB003": "CWE-506", "WEB004": "CWE-506", "WEB005": "CWE-506", "WEB006": "CWE-506", "WEB007": "CWE-506",
    "WEB008": "CWE-506", "WEB009": "CWE-506", "MAGIKA": "CWE-434",
}

# Names of techniques.
TECHNIQUE_NAMES = {
    "T1190": "Exploit Public-Facing Application",
    "T1059.004": "Command and Scripting Interpreter: Unix Shell",
    "T1552.001": "Unsecured Credentials: Credentials In Files",
    "T1055.001": "Process Injection: Dynamic-link Library Injection",
    "T1189": "Drive-by Compromise",
    "T1083": "File and Directory Discovery",
    "T1105": "Ingress Tool Transfer",
    "T1005": "Data from Local System",
    "T1036": "Masquerading",
    "T1600": "Weaken Encryption",
    "T1090": "Proxy",
    "T1505.003": "Server Software Component: Web Shell",
    "T1027": "Obfuscated Files or Information",
    "T1027.010": "Obfuscated Files or Information: Command Obfuscation",
    "T1071.001": "Application Layer Protocol: Web Protocols",
    "T1543": "Create or Modify System Process",
    "T1546": "Event Triggered Execution",
    "T1195": "Supply Chain Compromise",
    "T1036.008": "Masquerading: Masquerade File Type",
}

# Techniques of kinds of rules of a static analyser, looked up before words are.
STATIC_RULE_TECHNIQUES = {
    "sql-injection": "T1190",
    "command-injection": "T1059.004",
    "xss": "T1189",
    "path-traversal": "T1083",
    "ssrf": "T1090",
    "deserialization": "T1059.004",
    "xxe": "T1190",
    "open-redirect": "T1189",
    "ldap-injection": "T1190",
    "hardcoded-secret": "T1552.001",
}

# Categories of a static analyser's results; the first word that rule and message hold counts.
STATIC_CATEGORIES = [
    ("sql", "injection"),
    ("sqli", "injection"),
    ("command-injection", "rce"),
    ("os-command", "rce"),
    ("xss", "xss"),
    ("cross-site", "xss"),
    ("ssrf", "ssrf"),
    ("path-traversal", "path_traversal"),
    ("directory-traversal", "path_traversal"),
    ("xxe", "xxe"),
    ("deserialization", "deserialization"),
    ("ldap", "injection"),
    ("hardcoded", "credentials"),
    ("credential", "credentials"),
    ("secret", "credentials"),
    ("password", "credentials"),
    ("open-redirect", "redirect"),
    ("file-inclusion", "file_inclusion"),
    ("eval", "rce"),
    ("exec", "rce"),
    ("upload", "upload"),
    ("csrf", "csrf"),
]

# Techniques of a static analyser's results; the first entry of which any word is held counts.
STATIC_TECHNIQUES = [
    (["sql", "injection"], "T1190"),
    (["command", "exec", "system"], "T1059.004"),
    (["eval", "code-injection"], "T1059.004"),
    (["xss", "cross-site"], "T1189"),
    (["ssrf"], "T1090"),
    (["path-traversal", "directory"], "T1083"),
    (["deserialization"], "T1059.004"),
    (["hardcoded", "credential", "secret"], "T1552.001"),
    (["upload"], "T1105"),
    (["xxe"], "T1190"),
]

# Tactics with their techniques.
TACTICS = {
    "Initial Access (TA0001)": ["T1190", "T1189", "T1195"],
    "Execution (TA0002)": ["T1059.001", "T1059.004"],
    "Persistence (TA0003)": ["T1505.003", "T1543", "T1546"],
    "Defense Evasion (TA0005)": ["T1027", "T1027.010", "T1036", "T1036.008", "T1600"],
    "Credential Access (TA0006)": ["T1552.001"],
    "Discovery (TA0007)": ["T1083"],
    "Collection (TA0009)": ["T1005"],
    "Command and Control (TA0011)": ["T1071.001", "T1090", "T1105"],
}

# Names of weaknesses for backfill.
WEAKNESS_NAMES = {
    "CWE-20": "Improper Input Validation", "CWE-22": "Path Traversal", "CWE-78": "OS Command Injection", "CWE-79": "Cross-site Scripting", "CWE-89": "SQL Injection",
    "CWE-94": "Code Injection", "CWE-98": "PHP Remote File Inclusion", "CWE-200": "Exposure of Sensitive Information", "CWE-209": "Error Message Information Exposure",
    "CWE-312": "Cleartext Storage of Sensitive Information", "CWE-328": "Use of Weak Hash", "CWE-434": "Unrestricted Upload", "CWE-502": "Deserialization of Untrusted Data",
    "CWE-506": "Embedded Malicious Code", "CWE-522": "Insufficiently Protected Credentials", "CWE-798": "Use of Hard-coded Credentials",
}

# Rules for the files of an upgrade: (id, severity, category, names, pattern).
UPGRADE_RULES = [
    ("UPG001", "CRITICAL", "upgrade_hijack", ["Upgrade.php", "upgrade.php"], r"(?:eval|assert|create_function)\s*\(\s*\$(?:sql|query|patch|upgrade|code)"),
    ("UPG002", "CRITICAL", "upgrade_hijack", ["Upgrade.php"], r"""preg_replace\s*\([^)]*\/[eimsxADSUXJu]*e[eimsxADSUXJu]*['"]"""),
    ("UPG003", "CRITICAL", "upgrade_hijack", ["Upgrade.php"], r"\$\{?\$[a-zA-Z_][a-zA-Z0-9_]*\}?\s*\("),
    ("UPG010", "HIGH", "file_deletion_bypass", ["Upgrade.php"], r"if\s*\([^)]*\$\w+\s*(!==?|===?|in_array)"),
    ("UPG011", "HIGH", "file_deletion_bypass", ["Upgrade.php"], r"@?unlink\s*\([^)]*\)"),
    ("UPG020", "CRITICAL", "persistence_injection", ["Upgrade.php", ".htaccess"], r"auto_prepend_file|auto_append_file|php_value|SetHandler|AddHandler"),
    ("UPG021", "CRITICAL", "persistence_injection", ["Upgrade.php"], r"fopen\s*\([^)]*\.(?:htaccess|user\.ini|php\.ini)"),
    ("UPG030", "HIGH", "skip_logic", ["Upgrade.php"], r"return|die|exit|skip|continue\s*(?:;|//|#)"),
    ("UPG031", "HIGH", "skip_logic", ["Upgrade.php"], r"if\s*\(!\$\w+\)\s*return|if\s*\(empty\(\$\w+\)\)\s*return"),
    ("UPG040", "CRITICAL", "obfuscation", ["Upgrade.php"], r"(?:base64_decode|gzinflate|gzuncompress|str_rot13)\s*\("),
    ("UPG050", "HIGH", "config_tampering", ["Upgrade.php", "database.php"], r"\$db_password|\$db_user|\$db_connection|database\.php"),
]

# Directives of .htaccess files that are reported, and of .user.ini files that make them critical.
HTACCESS_DIRECTIVES = r"php_value\s+auto_(?:prepend|append)_file|php_flag\s+engine\s+on|AddType\s+application/x-httpd-php|SetHandler\s+application/x-httpd-php"
USER_INI_CRITICAL = r"auto_(?:prepend|append)_file"

# Rules of failed runtime tests by the first keyword in their names: (suite, keyword, rule id, weakness, category).
RUNTIME_RULES = [
    ("admin", "Control Center", "SEC077", "CWE-285", "access-control"), ("admin", "unauthenticated", "SEC021", "CWE-306", "authentication"),
    ("admin", "API", "SEC077", "CWE-287", "authentication"), ("admin", "cookie", "SEC071", "CWE-614", "session"),
    ("admin", "config", "SEC065", "CWE-200", "information-disclosure"), ("admin", "audit", "SEC021", "CWE-778", "logging"),
    ("export", "CSV", "SEC070", "CWE-94", "injection"), ("export", "PDF", "SEC074", "CWE-79", "injection"), ("export", "XSS", "SEC010", "CWE-79", "xss"),
    ("export", "info leak", "SEC031", "CWE-200", "information-disclosure"), ("export", "export", "SEC076", "CWE-862", "authorization"),
    ("upgrade", "filesystem", "SEC060", "CWE-506", "persistence"), ("upgrade", "PHP file", "SEC060", "CWE-506", "persistence"),
    ("upgrade", "suspicious", "SEC062", "CWE-506", "persistence"), ("upgrade", "external network", "SEC061", "CWE-506", "c2"), ("upgrade", "cron", "SEC063", "CWE-506", "persistence"),
]

# What a credential file must not hold, the variables that it may set, and heuristics about its connections.
CREDENTIAL_FORBIDDEN = [
    ("function", r"\bfunction\s+\w+\s*\("), ("class", r"\bclass\s+\w+"), ("include", r"""\b(?:include|require)(?:_once)?\s*[\('"]"""),
    ("execution", r"\b(?:eval|exec|system|passthru|shell_exec|popen|proc_open)\s*\("), ("base64", r"\bbase64_decode\s*\("), ("inflate", r"\bgzinflate\s*\("),
    ("file_read", r"\bfile_get_contents\s*\("), ("curl", r"\bcurl_exec\s*\("), ("wrapper", r"\bstream_wrapper_register\s*\("), ("ini_set", r"\bini_set\s*\("),
    ("include_path", r"\bset_include_path\s*\("),
]
CREDENTIAL_VARIABLES = ["hostname", "db", "username", "password", "salt"]

# Calls that are dangerous by themselves, by what they are.
DANGEROUS_FUNCTIONS = {
    "eval_usage": ["eval", "assert", "preg_replace"],
    "exec_usage": ["exec", "system", "passthru", "shell_exec", "popen", "proc_open"],
    "unsafe_deserialization": ["unserialize"],
    "debug_function": ["var_dump", "print_r", "debug_print_backtrace"],
    "obfuscation": ["base64_decode", "gzinflate", "str_rot13", "gzuncompress"],
    "deprecation": ["mysql_query", "mysql_real_escape_string", "ereg", "split", "session_register"],
}
#: Patterns of dangerous constructs: the calls above, request values in output, uploads, dynamic includes, credentials in code.
DANGEROUS_PATTERNS = [
    *((kind, r"(?<![\w$>:\\])(?:" + "|".join(names) + r")\s*\(") for kind, names in DANGEROUS_FUNCTIONS.items()),
    ("xss_risk", r"\becho\b[^;\n]*\$_(?:GET|POST|REQUEST|COOKIE)"),
    ("file_upload_risk", r"\$_FILES\s*\["),
    ("file_inclusion_risk", r"\b(?:include|require)(?:_once)?\b\s*\(?\s*\$"),
    ("hardcoded_credential", r"""\$\w*(?:password|passwd|secret|api_key|token)\w*\s*=\s*(?:"[^"\n]{4,}"|'[^'\n]{4,}')"""),
]

# Signatures that are critical by name, and words of names that make one high.
CRITICAL_SIGNATURES = ["php_backdoor", "php_webshell", "webshell", "backdoor", "php_obfuscation_eval", "phpInPNG", "SuspiciousCodeSignature"]
HIGH_SIGNATURE_WORDS = ["shell", "backdoor", "exploit", "malware"]

# Labels of content that runs, of databases, and severities of (label by extension, label by content).
ACTIVE_LABELS = ["php", "python", "perl", "ruby", "shell", "batch", "powershell", "javascript", "vba"]
DATABASE_LABELS = ["sqlite", "mysql"]
MISMATCH_PAIRS = {
    **{(x, "php"): "critical" for x in ["jpeg", "png", "gif", "bmp", "ico", "webp", "css", "javascript", "txt", "json", "yaml", "ini", "xml", "csv", "sql"]},
    ("html", "php"): "suspicious",
    **{(x, "sqlite"): "critical" for x in ["php", "txt", "ini", "javascript", "css", "html", "jpeg", "png", "gif"]},
    **{("txt", x): "suspicious" for x in ["python", "perl", "shell"]},
}
