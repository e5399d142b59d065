"""Word lists, patterns, weights and limits that results depend on."""

STOP_WORDS = """a an and are as at be been but by can could did do does for from had has have how in into is it its may
might must not of on or other our over should so such than that the their then there these they this those to use used
uses using was were what when where which while who will with within would you your""".split()
TITLE_STOP_WORDS = "a an and as at but by for in nor of on or the to up via with".split()
ABBREVIATIONS = """e.g i.e etc vs cf al approx dept est fig no vol ver sec min max mr mrs ms dr prof sr jr st inc ltd co corp dept univ""".split()

KEYWORD_LIMIT = 25
CONTENT_KEYWORD_LIMIT = 4000

CATEGORY_ALIASES = {
    "testing": ["tests", "test", "testing", "test suite", "test coverage", "validation", "quality", "qa", "pytest", "unit tests", "integration tests", "coverage"],
    "ci_deployment": ["ci", "cd", "ci/cd", "deployment", "deploy", "workflow", "workflows", "github actions", "actions", "build", "release", "pipeline runner", "automation runner", "continuous integration"],
    "configuration_dependencies": ["configuration", "config", "settings", "environment", "dependencies", "requirements", "packages", "pyproject", "setup", "install"],
    "automation_pipeline": ["automation", "pipeline", "routing", "router", "updater", "generator", "change detection", "change package", "summary update", "orchestration", "pr workflow", "detector"],
    "architecture_modules": ["architecture", "modules", "module", "components", "component", "implementation", "source code", "core", "providers", "parsers", "analyzers", "services", "internals", "design"],
    "repository_structure": ["repository", "repo", "structure", "layout", "file tree", "organization", "directories", "tree"],
    "overview": ["overview", "purpose", "introduction", "intro", "system", "project", "product", "summary", "about"],
    "limitations_risks": ["limitations", "limitation", "constraints", "risks", "known issues", "security", "restrictions", "deprecated", "legacy", "caveats"],
    "documentation": ["readme", "documentation", "docs", "guides", "usage", "manual"],
}
RISK_WORDS = ["security", "legacy", "deprecat", "vulnerab", "restrict"]
TEST_PATH = r"(^|/)(tests?)(/|$)|(^|/)test_[^/]*\.py$|_test\.py$"
AUTOMATION_NAME = r"(router|updater|generator|detector|orchestrat|pipeline|automation|workflow)"
CONFIG_NAMES = ["requirements.txt", "pyproject.toml", "setup.py", "setup.cfg", "pipfile", "package.json", "pytest.ini", "tox.ini", ".gitignore", "environment.yml"]
CI_NAMES = ["jenkinsfile", "dockerfile", ".travis.yml", "azure-pipelines.yml"]

#: component: (weight, cap)
SECTION_SCORES = {
    "explicit_path": (15.0, 2),
    "explicit_symbol": (12.0, 2),
    "category": (10.0, 2),
    "heading_overlap": (6.0, 3),
    "path_overlap": (4.0, 3),
    "content_overlap": (2.0, 5),
    "hunk_overlap": (1.5, 4),
    "summary_overlap": (1.0, 3),
    "extension": (1.0, 2),
}
TEST_SUPPORT_WEIGHT, DIFF_CATEGORY_WEIGHT = 0.35, 0.5
SECTION_MIN, SECTION_STRONG, SECTION_MARGIN = 6.0, 25.0, 3.0
TIE_CAP, AMBIGUOUS_CAP = 0.55, 0.70
SHORTLIST = 3
HUNKS_PER_FILE, LINES_PER_SIDE, LINE_CHARS, HUNK_TOKENS = 5, 10, 200, 2000
PROMPT_FILES = 15

PLACEMENT_SCORES = {
    "symbol_match": (16.0, 2),
    "module_match": (14.0, 2),
    "path_match": (14.0, 2),
    "removed_evidence": (5.0, 3),
    "hunk_overlap": (4.0, 3),
    "added_evidence": (3.0, 3),
    "category_overlap": (6.0, 1),
    "summary_overlap": (2.0, 3),
    "keyword_overlap": (1.0, 4),
}
SPECIFIC = ["symbol_match", "module_match", "path_match", "removed_evidence", "hunk_overlap", "added_evidence"]
PLACEMENT_MIN, PLACEMENT_MARGIN, MATCHED_LIMIT = 8.0, 4.0, 12
NEIGHBOUR_CHARS, PARENT_CHARS = 200, 400

HEADING_WEIGHTS = {
    "numbering_prefix": 25,
    "bold": 15,
    "larger_font": 20,
    "different_font_family": 5,
    "underlined": 5,
    "few_words": 10,
    "colon_ending": 10,
    "spacing_before": 10,
    "spacing_after": 5,
    "repeated_pattern": 20,
    "title_or_caps": 5,
    "no_full_stop": 5,
    "word_list_item": -20,
    "many_words": -20,
    "multiple_sentences": -20,
    "full_stop_ending": -10,
    "body_formatting": -15,
    "sentence_style": -10,
    "colored_text": -20,
}
HEADING_LIMITS = {"larger_font_min_delta": 1.0, "few_words_max": 10, "many_words_min": 15, "heading_min": 80, "probable_min": 60, "body_size_tolerance": 0.5}
NUMBERING = r"^\s*(\d{1,2}(?:\.\d{1,2})*)\s*[.):\-–—]?\s+(?=\S)"
NOTE_OR_LINK = r"(?i)^\s*(note|link)\s*(?::[-–—]?|[-–—])"

HUNK_HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(?: (.*))?$"
STORED_LINES, STORED_LINE_CHARS, STORED_HUNK_CHARS = 500, 2000, 200_000

GENERIC_HEADINGS = ["code changes", "code change", "changes", "change", "updates", "update", "code updates", "miscellaneous", "misc", "general", "general updates", "other", "improvements", "fixes", "modifications", "new section"]
GENERATED_HEADING = "automated change update"
#: Substrings of the comments around generated regions.
REGION_START, REGION_END = "UPDATE_START", "UPDATE_END"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"

PROMPT_MANIFESTS = ["requirements.txt", "pyproject.toml", "setup.py", "setup.cfg", "package.json", "pytest.ini", "cargo.toml", "go.mod"]
ORCHESTRATION = ["main", "cli", "app", "updater", "generator", "router", "builder", "provider", "collector", "detector", "report", "automation", "pipeline", "store", "resolver"]
IGNORED_FOLDERS = [".git", ".venv", "__pycache__", ".pytest_cache", "node_modules", "dist", "build", "artifacts"]
IGNORED_SUFFIXES = [".docx", ".csv", ".pyc", ".pem", ".key"]
SECRET_NAMES = ["secret", "credential", "token"]
TEXT_SUFFIXES = [".py", ".md", ".txt", ".json", ".yml", ".yaml", ".toml", ".ini", ".cfg"]
TEXT_NAMES = ["requirements.txt", "pytest.ini", ".gitignore"]
FILE_CHARS, TOTAL_CHARS, CONTENT_FILES, TREE_ENTRIES = 6_000, 150_000, 50, 400

SECRETS = [r"gh[pousr]_[A-Za-z0-9]{20,}", r"github_pat_[A-Za-z0-9_]{20,}", r"(?i)\bbearer\s+[A-Za-z0-9._\-]+", r"(?i)\b(token|secret|password|authorization)\b\s*[:=]\s*\S+"]
DIAGNOSTIC_CHARS = 500
LIBRARIES = {
    "machine learning": ["sklearn", "scikit-learn", "xgboost", "lightgbm", "tensorflow", "keras", "torch", "pytorch"],
    "natural language processing": ["spacy", "nltk", "transformers", "sentence-transformers", "sentence_transformers"],
    "nlp": ["spacy", "nltk", "transformers", "sentence-transformers", "sentence_transformers"],
    "neural network": ["tensorflow", "keras", "torch", "pytorch"],
    "deep learning": ["tensorflow", "keras", "torch", "pytorch"],
}
MANIFESTS = ["requirements.txt", "pyproject.toml", "setup.py", "setup.cfg", "pipfile", "pipfile.lock", "package.json"]
NEGATIONS = ["not", "no", "without", "never", "n't", "cannot", "neither", "nor", "avoid", "instead of", "rather than"]

#: Words too broad to support a claim about a change.
BROAD_TERMS = """change changes changed update updates updated summary summaries documentation document documents
project system module modules component components code file files process processes data technical core management
feature features function functions test tests information added removed modified deleted renamed line lines src py md
handling consistency overview readers content new""".split()
ACTIVE_VERBS = "includes include including uses use using provides provide handles handle contains contain implements implement supports support".split()
REMOVAL_MARKERS = ["removed", "remove", "deleted", "delete", "retired", "deprecated", "replaced", "legacy", "no longer", "dropped", "obsolete", "superseded"]
ADDITION_MARKERS = ["newly added", "new file", "introduced", "now includes"]
RENAME_MARKERS = ["renamed", "moved", "formerly", "previously", "was renamed"]
GENERIC_SUMMARY = r"(?i)^(the\s+)?(repo(sitory)?|code(base)?|files?|project)(\s+structure)?\s+(was|were|has\s+been|have\s+been)\s+(updated|changed|modified)\.?$"
SUMMARY_CHARS, REASONING_CHARS = 15, 400
PATCH_CANDIDATES, PATCH_HUNKS = 3, 3
TRUE_WORDS = ["true", "1", "yes", "on"]
DOCUMENT_FOLDER, DOCUMENT_SUFFIX = "artifacts/summaries", "_TechnicalDocument.md"
DEFAULT_REPOSITORY, FIRST_HEADING = "Repository", "System Overview"
MIN_CONFIDENCE, NO_CHANGE_CONFIDENCE = 0.75, 0.90
#: Texts and phrases that say nothing about a change.
GENERIC_TEXT = r"(?i)^\s*(the\s+)?(code|system|repository|project|documentation|summary)?\s*(was|were|has\s+been|have\s+been)?\s*(updated|changed|modified|enhanced|improved|implemented|refactored)[\s.!]*$"
GENERIC_PHRASES = [
    "various improvements", "several changes", "minor improvements", "general improvements", "miscellaneous changes", "code was updated",
    "system was enhanced", "changes were implemented", "various changes", "streamline processes", "streamline the process", "ensure consistency",
    "improve efficiency", "improve performance", "enhance functionality", "make the system robust", "essential components", "relevant and informative",
    "better maintainability", "seamless integration", "designed to streamline", "designed to ensure", "helps improve", "provides a robust",
]
NEW_TEXT_CHARS, LEAST_REASONING_CHARS, GROWTH_CHARS = 1_200, 5, 600
