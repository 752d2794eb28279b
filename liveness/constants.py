"""Fixed values that results depend on.

FIXED VALUES (must stay equal to the analysed tool's behaviour; listed plainly, in
their natural order):
"""

# --- severity thresholds on the dead-code confidence ---------------------------
DANGER_AT = 0.75
WARNING_AT = 0.55
REVIEW_AT = 0.35
VISIBLE_DEFAULT = 0.30        # editor threshold setting default
HOVER_MIN = 0.15              # hover is suppressed below this confidence
PREDICT_DEAD_ABOVE = 0.5      # strict ">"
SEVERITIES = ["danger", "warning", "review", "safe"]

# --- feature order of the model -------------------------------------------------
FEATURES = [
    "call_count",
    "is_exported",
    "used_in_tests",
    "dynamic_call_risk",
    "cyclomatic_complexity",
    "file_depth",
]

# display labels of the features (fallback: the feature name)
FEATURE_LABELS = {
    "call_count": "Call Frequency",
    "is_exported": "Export Visibility",
    "used_in_tests": "Test Coverage",
    "dynamic_call_risk": "Dynamic Invocation Risk",
    "cyclomatic_complexity": "Cyclomatic Complexity",
    "file_depth": "File Depth",
}

# name markers, first in this list order wins
DEPRECATED_MARKERS = ["old", "unused", "deprecated", "legacy", "temp", "todo", "backup", "bak"]
# the six-marker boolean variant used for mock biasing

# substrings (of the lower-cased file name or directory) marking a test file
TEST_PATTERNS = ["test_", "_test", "tests", "spec"]

# names of the syntax nodes that add one to a function's complexity
DECISION_NODES = ["If", "For", "While", "And", "Or", "ExceptHandler", "With", "Assert", "ListComp", "SetComp", "DictComp",
                  "GeneratorExp"]
# call targets (plain names) that make an entity's invocation dynamic
DYNAMIC_NAMES = ["eval", "exec", "getattr", "setattr", "globals", "locals", "__import__", "importlib"]

# directory names excluded from a workspace scan
EXCLUDED_DIRS = ["node_modules", ".git", "__pycache__", "venv", ".venv", "dist", "build", "out", ".next"]
MAX_FILES_PER_EXTENSION = 500

# extension -> editor language id
EXTENSION_LANGUAGES = {
    "py": "python",
    "js": "javascript",
    "ts": "typescript",
    "jsx": "javascriptreact",
    "tsx": "typescriptreact",
}

# record cleaning
NULL_TOKENS = ["", "NULL", "N/A"]
VALUE_MIN = 0
VALUE_MAX = 1000
VALUE_ERROR = -1

# history limits
RECENT_SESSIONS = 20
RECENT_REMOVALS = 50
RECENT_CHATS = 50
TOP_SUSPECTS = 5
HOVER_TOP_FEATURES = 4
PANEL_TOP_FEATURES = 6

# snippet cut
SNIPPET_MAX_CHARS = 500
SNIPPET_ELLIPSIS = "..."

# question routing (lower-cased, trimmed text; first intent whose rule matches wins)
INTENT_COUNT_ALL = ["how many"]
INTENT_COUNT_ANY = ["dead", "danger"]
INTENT_REMOVABLE = ["safe to remove", "can i remove", "should i remove"]
INTENT_EXPLAIN = ["explain", "why"]
INTENT_SUMMARY = ["summary", "overview"]
INTENT_HELP = ["help", "what can"]
INTENT_DEFINITION = ["what is dead code", "what is a dead code"]

# training recipe
TRAIN_PERCENT = 80
SPLIT_SEED = 42
REG_C = 1.5
MAX_ITER = 2000

# fallback explanation fields
FALLBACK_RISK = "Medium"
FALLBACK_ACTION = "review"
