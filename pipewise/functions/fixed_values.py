"""Fixed values.

Every constant here decides a result (a pattern, a label, a limit, a text that
readers of the reports see), so it is stated once, as plain text, and used
everywhere else by name.
"""

# --- limits -----------------------------------------------------------------
BROADCAST_LIMIT_MB = 200
HISTORY_DEPTH = 5
GAIN_THRESHOLD_PCT = 3.0
PHOTON_MULTIPLIER = 1.5
COOLDOWN_DAYS = 5
TOP_N = 3
RUNS_TO_AVERAGE = 2
CARD_CHANGES = 4
ERROR_CHARS = 180
BULLET_CHARS = 100
WORD_OVERLAP = 0.6

# --- script patterns: (word that must occur, lower case; pattern) -----------
TARGET_PATTERNS = [
    ("saveastable", r"""\.saveAsTable\(\s*['"]([a-zA-Z0-9_.]+)['"]"""),
    ("merge", r"MERGE\s+INTO\s+([a-zA-Z0-9_.]+)"),
    ("insert", r"INSERT\s+(?:OVERWRITE\s+)?(?:INTO\s+)?(?:TABLE\s+)?([a-zA-Z0-9_.]+)"),
    ("create", r"CREATE\s+(?:OR\s+REPLACE\s+)?TABLE\s+([a-zA-Z0-9_.]+)"),
    ("deltatable.forname", r"""DeltaTable\.forName\([^,]+,\s*['"]([a-zA-Z0-9_.]+)['"]"""),
]

STRICT_READ_PATTERNS = [
    ("spark.read.table", r"""spark\.read\.table\(\s*['"]([a-zA-Z0-9_.]+)['"]"""),
    ("from", r"FROM\s+([a-zA-Z0-9_]+\.[a-zA-Z0-9_]+)(?:\s|$)"),
    ("join", r"JOIN\s+([a-zA-Z0-9_]+\.[a-zA-Z0-9_]+)(?:\s|$)"),
    ("spark.table", r"""spark\.table\(\s*['"]([a-zA-Z0-9_.]+)['"]"""),
]

READ_PATTERNS = [
    ("spark.read.table", r"""spark\.read\.table\(\s*['"]([a-zA-Z0-9_.]+)['"]"""),
    ("spark.table", r"""spark\.table\(\s*['"]([a-zA-Z0-9_.]+)['"]"""),
    ("from", r"\bFROM\s+([a-zA-Z0-9_]+\.[a-zA-Z0-9_]+)\b"),
    ("join", r"\bJOIN\s+([a-zA-Z0-9_]+\.[a-zA-Z0-9_]+)\b"),
]

READ_PATH_PATTERNS = [
    (".parquet", r"""spark\.read(?:\.[a-z]+)*\.parquet\(\s*['"]([^'"]+)['"]"""),
]

# (label; words of which one must occur; pattern), in reporting order
SIDE_EFFECTS = [
    ("HTTP external (requests)", ["requests."], r"requests\.(post|get|put|delete|patch)\s*\("),
    ("HTTP external (urllib)", ["urllib."], r"urllib\.request\.urlopen"),
    ("Slack webhook", ["slack"], r"slack_webhook|SLACK_WEBHOOK|hooks\.slack"),
    (
        "Google Sheets/Drive",
        ["sheets.", "gspread", "google.", "service_account"],
        r"sheets\.spreadsheets|gspread|google\.auth|service_account",
    ),
    (
        "Email",
        ["smtp", "sendmail", "send_email"],
        r"smtplib|sendmail|send_email|SMTP",
    ),
    ("Nested notebook call", ["dbutils."], r"dbutils\.notebook\.run\("),
    ("Structured Streaming", [".writestream", ".start()"], r"\.writeStream|\.start\(\)"),
    ("External subprocess", ["subprocess."], r"subprocess\.(run|call|Popen)"),
]

# --- lineage patterns -------------------------------------------------------
PARQUET_VAR = r"""\b(\w+)\s*=\s*spark\.read(?:\.[a-z]+)*\.parquet\(\s*['"]([^'"]+)['"]\s*\)"""
SQL_VAR = r'\b(\w+)\s*=\s*spark\.sql\(\s*(?:f?""")(.*?)(?:""")\s*\)'
SQL_SOURCE = r"\b(?:FROM|JOIN)\s+(\w+(?:\.\w+)*)"
TEMP_VIEW = r"""\b(\w+)\.createOrReplaceTempView\(\s*['"](\w+)['"]\s*\)"""

# --- cells ------------------------------------------------------------------
CELL_MARKER = "# COMMAND ----------"
CELL_TITLE = r"#\s*DBTITLE\s+\d+\s*,\s*(.+)"
PREVIEW_CHARS = 50

# --- outcomes of a candidate ------------------------------------------------
REPORTED_NOT_COUNTED = ["export_error", "llm_error", "no_changes"]
NEITHER_REPORTED_NOR_COUNTED = ["upload_error", "schema_mismatch", "data_mismatch"]

# --- marks used in reports --------------------------------------------------
TIER_MARKS = {"green": "🟢", "yellow": "🟡"}
VALIDATION_MARKS = {
    "passed": "✅",
    "smoke_passed": "✅",
    "smoke_failed": "❌",
    "schema_mismatch": "⚠️",
    "data_mismatch": "⚠️",
    "failed": "❌",
    "skipped": "⏭️",
    "no_changes": "💤",
    "llm_error": "💥",
    "export_error": "🚫",
}
SAVINGS_MARKS = {
    "alto": "🔴",
    "medio": "🟡",
    "bajo": "🟢",
    "high": "🔴",
    "medium": "🟡",
    "low": "🟢",
}
ACTION_MARKS = {"approve": "✅", "reject": "❌", "rollback": "↩️"}
UNKNOWN_MARK = "❔"

# --- texts ------------------------------------------------------------------
NO_SIZES_TEXT = "(sizes could not be estimated — use conservative broadcast criteria)"
NO_TARGETS_TEXT = "(none detected)"
NO_SIZE_CONTEXT_TEXT = "(sizes not available)"
HISTORY_HEADER = (
    "PREVIOUSLY REJECTED OPTIMIZATIONS FOR THIS NOTEBOOK "
    "(do not re-propose any of these):"
)
STALE_NOTE = "[STALE: notebook manually edited after proposal]"
ROLLBACK_NOTE = "\n[ROLLBACK] "

# Characters that count as white space when text is trimmed.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Where a line ends.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
