"""Fixed values about files: extensions, names, directories and thresholds."""

# Languages by extension.
LANGUAGES = {
    ".php": "PHP", ".js": "JavaScript", ".css": "CSS", ".html": "HTML", ".htm": "HTML", ".xml": "XML", ".json": "JSON", ".sql": "SQL", ".py": "Python",
    ".sh": "Shell", ".bat": "Batch", ".yml": "YAML", ".yaml": "YAML", ".md": "Markdown", ".txt": "Text", ".csv": "CSV", ".ini": "INI", ".conf": "Config",
    ".htaccess": "Apache", ".twig": "Twig", ".tpl": "Template", ".inc": "PHP Include", ".module": "PHP Module",
}

# Extensions by category; the first category that lists an extension counts.
CATEGORIES = {
    "code": [".php", ".js", ".py", ".sh", ".bat", ".sql", ".inc", ".module"],
    "markup": [".html", ".htm", ".xml", ".twig", ".tpl", ".svg"],
    "style": [".css", ".scss", ".less", ".sass"],
    "data": [".json", ".csv", ".yml", ".yaml", ".sql"],
    "config": [".ini", ".conf", ".htaccess", ".env", ".user.ini"],
    "doc": [".md", ".txt", ".rst", ".pdf"],
    "binary": [
        ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".pdf", ".zip", ".gz", ".tar", ".rar", ".7z", ".exe", ".dll",
        ".so", ".dylib", ".wasm", ".phar", ".db", ".sqlite", ".sqlite3",
    ],
}

# Media types by extension; anything else is application/octet-stream.
MIME_TYPES = {
    ".html": "text/html", ".htm": "text/html", ".txt": "text/plain", ".log": "text/plain", ".md": "text/markdown", ".css": "text/css", ".csv": "text/csv",
    ".xml": "application/xml", ".json": "application/json", ".js": "text/javascript", ".php": "application/x-httpd-php", ".py": "text/x-python",
    ".sh": "application/x-sh", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".svg": "image/svg+xml",
    ".pdf": "application/pdf", ".zip": "application/zip", ".gz": "application/gzip", ".tar": "application/x-tar", ".sql": "application/sql",
}

# Severities from least to most severe, with their representative scores and report levels.
SEVERITIES = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
SEVERITY_SCORES = {"CRITICAL": 9.5, "HIGH": 8.0, "MEDIUM": 5.5, "LOW": 3.0, "INFO": 0.0}
SARIF_LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "none"}
SEVERITY_ALIASES = {"ERROR": "HIGH", "WARNING": "MEDIUM", "NOTE": "LOW", "NONE": "INFO"}

# What traversals leave out.
SKIP_DIRS = [".git", ".svn", "__pycache__", "node_modules", "vendor", ".tox", ".DS_Store"]
DIFF_SKIP_DIRS = ["__pycache__", ".git", ".svn", "node_modules"]
DIFF_SKIP_NAMES = [".DS_Store", "Thumbs.db", "desktop.ini"]

# Extensions that scans read, and dotfiles that they read by name.
SCANNABLE = [
    ".php", ".inc", ".module", ".js", ".json", ".yml", ".yaml", ".xml", ".sql", ".txt", ".csv", ".html", ".htm", ".conf", ".ini", ".env", ".log", ".md",
    ".htaccess", ".user.ini", ".py", ".sh",
]
SCAN_LIMIT, PROFILE_LIMIT, HASH_LIMIT, ENTROPY_LIMIT = 10 << 20, 50_000_000, 100_000_000, 10_000_000

# What anomaly checks look for.
SUSPICIOUS_NAMES = [
    "shell.php", "cmd.php", "c99.php", "r57.php", "wso.php", "b374k.php", "webshell.php", "backdoor.php", "eval.php", "phpinfo.php", "info.php", "test.php", "x.php",
]
FORBIDDEN_EXTENSIONS = [".db", ".sqlite", ".sqlite3", ".phar", ".so", ".dll", ".exe", ".py", ".rb", ".pl", ".cgi"]
UPLOAD_DIRS = ["edocs", "uploads", "temp", "tmp"]
PHP_EXTENSIONS = [".php", ".phtml", ".phar", ".php5", ".php7"]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".ico"]
KEY_EXTENSIONS = [".pem", ".crt", ".key", ".p12", ".pfx"]
SQLITE_EXTENSIONS = [".db", ".sqlite", ".sqlite3"]

# Top-level prefixes under which new files are expected.
EXPECTED_ADDITIONS = ["edocs/", "temp/", "modules/", "languages/", "__pycache__/", "node_modules/", ".git/", ".svn/"]

# The report field of each anomaly.
ANOMALY_ROUTES = {
    "suspicious_filename": "suspicious_files", "anomalous_extension": "anomalous_files", "hidden_php_file": "hidden_files", "user_ini_persistence": "config_overrides",
    "htaccess_in_upload_dir": "config_overrides", "sqlite_file_in_webroot": "database_files", "sqlite_sidecar_active_writes": "database_files",
    "php_in_upload_directory": "php_in_uploads", "polyglot_php_in_image": "polyglot_files", "phar_archive": "phar_files", "phar_magic_in_non_phar": "phar_files",
    "certificate_in_webroot": "certificates", "php_code_in_log_file": "poisoned_logs", "double_extension_php": "double_extensions", "high_entropy_php": "high_entropy_files",
}

# Labels of contents that an extension may have.
EXPECTED_LABELS = {
    ".php": ["php"],
    ".inc": ["php"],
    ".phtml": ["php"],
    ".php5": ["php"],
    ".php7": ["php"],
    ".module": ["php"],
    ".html": ["html"],
    ".htm": ["html"],
    ".css": ["css"],
    ".js": ["javascript"],
    ".json": ["json"],
    ".xml": ["xml"],
    ".svg": ["svg", "xml"],
    ".jpg": ["jpeg"],
    ".jpeg": ["jpeg"],
    ".png": ["png"],
    ".gif": ["gif"],
    ".bmp": ["bmp"],
    ".ico": ["ico"],
    ".webp": ["webp"],
    ".pdf": ["pdf"],
    ".md": ["markdown"],
    ".txt": ["txt", "empty", "unknown"],
    ".csv": ["csv"],
    ".ini": ["ini"],
    ".conf": ["ini", "txt", "unknown"],
    ".sql": ["sql"],
    ".yml": ["yaml"],
    ".yaml": ["yaml"],
    ".zip": ["zip"],
    ".gz": ["gzip"],
    ".tar": ["tar"],
    ".7z": ["sevenzip"],
    ".rar": ["rar"],
    ".exe": ["pebin"],
    ".dll": ["pebin"],
    ".so": ["elf"],
    ".phar": ["php", "zip"],
    ".db": ["sqlite"],
    ".sqlite": ["sqlite"],
    ".sqlite3": ["sqlite"],
    ".woff": ["woff"],
    ".woff2": ["woff2"],
    ".ttf": ["ttf"],
    ".eot": ["eot"],
    ".otf": ["otf"],
    ".sh": ["shell"],
    ".bat": ["batch"],
}
#: Labels of text that has no mark of its own: plain text passes for them.
PLAIN_LABELS = ["css", "javascript", "json", "xml", "svg", "markdown", "csv", "ini", "sql", "yaml", "shell", "batch", "txt"]
#: Leading bytes that tell a label, in hexadecimal digits, with the number of bytes before them.
MAGIC_LABELS = [
    ("89504E47", 0, "png"), ("FFD8FF", 0, "jpeg"), ("47494638", 0, "gif"), ("424D", 0, "bmp"), ("00000100", 0, "ico"), ("57454250", 8, "webp"), ("25504446", 0, "pdf"),
    ("504B0304", 0, "zip"), ("1F8B", 0, "gzip"), ("7573746172", 257, "tar"), ("377ABCAF271C", 0, "sevenzip"), ("526172211A07", 0, "rar"), ("4D5A", 0, "pebin"),
    ("7F454C46", 0, "elf"), ("53514C69746520666F726D6174203300", 0, "sqlite"), ("774F4646", 0, "woff"), ("774F4632", 0, "woff2"), ("0001000000", 0, "ttf"), ("4F54544F", 0, "otf"),
]

# Names with a dot that scans for sensitive data read whatever their suffix.
SCANNABLE_DOT_FILES = [".htaccess", ".env", ".user.ini"]

# Units of sizes, with their bases.
SIZE_UNITS = {"binary": (1024, ["B", "KiB", "MiB", "GiB", "TiB"]), "decimal": (1000, ["B", "kB", "MB", "GB", "TB"]), "legacy": (1024, ["B", "KB", "MB", "GB", "TB"])}

# What begins a comment, by extension; "/*" and "<!--" begin one that may span lines.
COMMENT_MARKERS = {
    ".php": ("//", "/*", "#"), ".js": ("//", "/*"), ".css": ("/*",), ".py": ("#",), ".sh": ("#",), ".bat": ("REM", "::"), ".sql": ("--", "/*"),
    ".html": ("<!--",), ".xml": ("<!--",), ".yml": ("#",), ".yaml": ("#",), ".ini": (";", "#"), ".conf": ("#",),
}
