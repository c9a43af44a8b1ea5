"""Values that results depend on: patterns, word lists, lookup tables and weights. All are fixed values."""

# File extension -> language.
LANGUAGES = {
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx", "py": "python", "go": "go",
    "rs": "rust", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "cpp2": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp",
    "cs": "csharp", "php": "php", "phtml": "php", "kt": "kotlin", "kts": "kotlin", "swift": "swift", "rb": "ruby", "rake": "ruby", "gemspec": "ruby",
}
# Extensions of binary files.
BINARY_EXTENSIONS = (
    "png", "jpg", "jpeg", "gif", "webp", "svg", "ico", "bmp", "pdf", "zip", "gz", "tar", "woff", "woff2", "ttf", "eot", "mp4", "mp3", "wav", "exe",
    "dll", "so", "dylib", "wasm",
)
# Directories that a scan leaves out, compared in lower case.
SKIP_DIRS = (".git", "node_modules", "dist", "build", "out", "target", ".next", ".nuxt", ".venv", "venv", "__pycache__", ".idea")
# Names of a README in order of preference.
README_NAMES = ("README.md", "readme.md", "Readme.md", "README.MD", "README_zh.md", "README-zh.md", "README.markdown")
# Path patterns.
TEST_PATH = r"(?i)(^|/)(__tests__|__mocks__|tests?|specs?|e2e|fixtures?|examples?|benchmarks?)/|\.(test|spec|bench)\.[a-z]+$"
VENDOR_PATH = r"(?i)(^|/)(node_modules|\.git|dist|build|out|target|coverage|__pycache__|\.venv|venv|third[_-]?party|vendor|external|deps|generated|gen)(/|$)"
CORE_PATH = r"(?i)(^|/)(src|lib|libs|core|app|apps|include|internal|pkg|cmd|module|modules|kernel|drivers|arch|fs|net|mm|sys|base|framework|engine)(/|$)"
TESTY_PATH = r"(?i)(^|/)(test|tests|spec|specs|__tests__|e2e|fixture|fixtures|mock|mocks|bench|benchmarks)(/|$)"
ENTRY_PATH = r"(?i)(^|/)(main|index|app|server|cli|bootstrap|entry|init|start)\.[a-z0-9]+$"
PACKAGE_ENTRY = r"^(?:packages|libs|modules|apps)/([^/]+)/(?:src/)?(?:index|mod)\.(?:ts|tsx|js|jsx|mjs|cjs)$"
DEVICE_NAME = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..+)?$"
# Scores of paths in target selection.
PATH_BASE, PATH_DEPTH, PATH_CORE, PATH_ENTRY, PATH_TESTY = 100, 4, 30, 40, 40
# Token weights of alphanumeric, space, other and CJK characters.
W_ALNUM, W_SPACE, W_PUNCT, W_CJK = 0.25, 0.26, 0.62, 1.02
CJK = r"\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}"
BUDGET_SHARE = 0.95
# Stop words of focus queries, and the weights of focus retrieval.
FOCUS_STOP_WORDS = (
    "the", "and", "for", "with", "from", "this", "that", "how", "what", "why", "add", "new", "use", "using", "make", "fix", "bug", "get", "set",
    "want", "need", "should", "about", "into", "when", "where", "which",
)
NAME_EQUAL, NAME_PREFIX, NAME_INSIDE, PATH_SEGMENT, PATH_INSIDE, LABEL_HIT = 6.0, 4.0, 2.5, 5.0, 2.0, 1.5
TEST_FACTOR, HOP_DECAY, FOCUS_HOPS, FOCUS_FILES = 0.3, 0.35, 2, 12
# Fuzzy matching.
FUZZY_HIT, FUZZY_RUN, FUZZY_BOUNDARY, FUZZY_GAP, FUZZY_EARLY, FUZZY_LENGTH, FUZZY_LABEL, FUZZY_LIMIT = 1, 8, 6, 4, 6, 5, 10, 50
# Extensions and index files that a relative import may leave out, in order.
IMPORT_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "go", "rs", "java", "c", "h", "cpp", "cc", "cxx", "hpp", "hh", "cs", "php", "kt", "kts", "swift", "rb")
INDEX_FILES = ("index", "mod", "__init__")
RANK_SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".py", "/index.ts", "/index.tsx", "/index.js", "/__init__.py")
IMPORT_NOISE = ("@", "~", "$", "crate", "super", "self")
# Weights of edges.
IMPORT_WEIGHT, CALL_WEIGHT = 1.0, 2.0
# PageRank.
DAMPING, RANK_ROUNDS, RANK_TOLERANCE = 0.85, 100, 1e-6
# Directory name -> purpose.
PURPOSES = {
    "tests": ("__tests__", "test", "tests", "spec", "specs", "e2e"),
    "fixtures": ("fixtures", "__fixtures__", "__mocks__", "mocks"),
    "benchmarks": ("benchmark", "benchmarks", "bench"),
    "source": ("src", "source", "lib", "app", "core"),
    "components": ("components", "ui", "views", "pages", "widgets"),
    "hooks": ("hooks", "composables"),
    "utils": ("utils", "util", "helpers", "common", "shared"),
    "api": ("api", "apis", "services", "service", "routes", "controllers"),
    "types": ("types", "typings", "@types", "interfaces"),
    "database": ("db", "database", "models", "entities", "repositories", "dao"),
    "migrations": ("migrations", "migration"),
    "styles": ("styles", "style", "css", "scss", "theme", "themes"),
    "docs": ("docs", "doc", "documentation", "wiki"),
    "examples": ("examples", "example", "demo", "demos", "samples", "playground"),
    "templates": ("templates", "template"),
    "config": ("config", "configs", "configuration", "settings"),
    "ci": (".github", ".gitlab", ".circleci"),
    "scripts": ("scripts", "script", "bin", "tools", "tooling"),
    "infrastructure": ("infra", "infrastructure", "deploy", "deployment", "terraform", "k8s", "kubernetes"),
    "docker": ("docker", ".docker"),
    "editor": (".vscode", ".idea", ".devcontainer"),
    "build": ("dist", "build", "out", "output", "target", "release"),
    "vendor": ("node_modules", "vendor", "third_party", "third-party"),
    "cache": (".cache", "cache", ".tmp", "tmp"),
    "localization": ("locales", "locale", "i18n", "lang", "langs", "translations", "messages"),
    "assets": ("public", "static", "assets", "images", "img", "fonts", "media", "resources"),
    "monorepo": ("packages", "libs", "modules", "workspaces"),
    "mobile": ("android", "ios", "mobile"),
    "desktop": ("desktop", "electron", "tauri", "src-tauri"),
}
# Shares from which a directory's contents tell its purpose.
TESTS_SHARE, DOCS_SHARE, STYLES_SHARE, DATA_SHARE = 0.4, 0.5, 0.5, 0.6
# Directories whose children are modules.
MODULE_HEADS = ("packages", "libs", "modules", "apps", "src")
# Health score.
HIGH_CYCLOMATIC, HIGH_COGNITIVE, MEAN_CYCLOMATIC, COMMENT_SHARE = 15, 25, 5, 0.05
# Package managers by lock file, in order.
LOCK_FILES = (("pnpm-lock.yaml", "pnpm"), ("yarn.lock", "yarn"), ("bun.lockb", "bun"), ("package-lock.json", "npm"))
# White space, and a line by which a model asks for a slice; the look-ahead is the end in every dialect.
WHITE = "[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
MARKER_LINE = rf"^{WHITE}*`{{0,3}}@@expand{WHITE}+([^{WHITE[1:-1]}`]+)`{{0,3}}{WHITE}*(?![\s\S])"
