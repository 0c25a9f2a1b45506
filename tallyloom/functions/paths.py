"""Path predicates and the ordered file classification, as Columns.

Every function takes a path column and stays inside code generation; ``classify`` is one CASE expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Names, endings and patterns that decide a file's class.
GENERATED_DIRS = ("dist", "build", "out", "vendor", "third_party", "node_modules", "__generated__", "generated", "deps", "external", "pods", "bower_components", ".yarn")
GENERATED_ENDINGS = (".min.js", ".min.css", ".map", ".snap", ".d.ts", ".bundle.js", ".chunk.js", ".g.dart", ".pb.go", "_pb2.py")
GENERATED_NAME = r"\.generated\.|\.gen\.|_generated\."
GENERATED_MARK = "@generated|DO NOT EDIT|auto-generated|Code generated"
LOCKFILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock", "bun.lockb", "cargo.lock", "gemfile.lock", "poetry.lock", "pipfile.lock", "uv.lock", "composer.lock", "go.sum", "mix.lock", "pubspec.lock", "podfile.lock", "packages.lock.json", "flake.lock", "gradle.lockfile")
MANIFESTS = ("package.json", "pyproject.toml", "setup.py", "setup.cfg", "pipfile", "go.mod", "cargo.toml", "gemfile", "composer.json", "pom.xml", "mix.exs", "pubspec.yaml")
MANIFEST_NAME = r"^requirements.*\.txt\z|^build\.gradle|\.csproj\z"
CI_DIRS = (".github", ".circleci", ".buildkite", ".vscode", ".idea")
CI_NAMES = (".gitlab-ci.yml", "makefile", "justfile", "jsconfig.json", ".pre-commit-config.yaml", "bunfig.toml", "renovate.json", "dependabot.yml", ".gitignore", ".gitattributes", ".nvmrc", ".tool-versions", ".editorconfig", ".flake8", "mypy.ini", ".babelrc")
CI_STARTS = ("dockerfile", "docker-compose", "tsconfig", ".eslintrc", "eslint.config", ".prettierrc", "prettier.config", "biome.json", ".stylelintrc", "stylelint.config", "ruff.toml", ".ruff.toml", "vite.config", "webpack.config", "rollup.config", "esbuild.config", "babel.config", "jest.config", "vitest.config", "playwright.config")
HOUSEKEEPING = (".gitkeep", ".keep", ".gitmodules", ".mailmap", ".git-blame-ignore-revs")
AGENT_DIRS = (".claude", ".cursor")
TOOL_DOTFILE = r"^\.[a-z0-9_-]+(rc|ignore)(\.(json|ya?ml|js|cjs|mjs|toml))?\z"
TEST_DIRS = ("test", "tests", "__tests__", "spec", "specs", "e2e", "cypress", "testdata", "fixtures", "__mocks__", "benchmarks")
TEST_NAME = r"\.(test|spec)\.[^.]+\z|_test\.go\z|^test_.*\.py\z|_test\.py\z|^conftest\.py\z"
ARCHIVE_DIRS = ("deprecated", ".deprecated", "archive", "archived", "attic")
DRAFT_DIRS = ("drafts", "_drafts")
DOC_STEM = r"^(readme|changelog|history|contributing|code_of_conduct|license|notice|authors|notes|plan|todo|roadmap)([._-].*)?\z"
DOC_NAMES = ("security.md", "isa.md", "isa.html")
DOC_DIRS = ("adr", "rfcs", "doc", "docs", "documentation")
EXAMPLE_DIRS = ("examples", "example")
PROSE = (".md", ".mdx", ".rst", ".adoc", ".txt")
ASSETS = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".avif", ".svg", ".ico", ".bmp", ".tif", ".tiff", ".woff", ".woff2", ".ttf", ".otf", ".eot", ".mp3", ".wav", ".ogg", ".flac", ".m4a", ".aac", ".mp4", ".mov", ".webm", ".mkv", ".avi")
SOURCES = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".rs", ".java", ".kt", ".kts", ".swift", ".rb", ".php", ".c", ".h", ".cc", ".cpp", ".hpp", ".cs", ".sh", ".bash", ".zsh", ".fish", ".ps1", ".lua", ".ex", ".exs", ".erl", ".scala", ".clj", ".dart", ".m", ".mm", ".vue", ".svelte", ".astro", ".html", ".htm", ".css", ".scss", ".sass", ".less", ".sql", ".graphql", ".gql", ".proto", ".zig", ".nim", ".hs", ".ml", ".r", ".jl", ".pl")
CONFIGS = (".json", ".jsonc", ".yaml", ".yml", ".toml", ".ini", ".conf", ".xml", ".csv", ".tsv")
DATA = (".csv", ".tsv", ".json", ".jsonl", ".ndjson", ".parquet", ".xml", ".yaml", ".yml")
TABULAR = (".csv", ".tsv", ".jsonl", ".ndjson", ".parquet")
DEPLOY_MANIFESTS = ("wrangler.toml", "vercel.json", "netlify.toml", "fly.toml")
CONFIG_DIRS = ("config", "conf", "settings", ".config")
CONFIG_NAME = "config|settings|flag|feature|toggle|route|manifest|rewrite|redirect"
CONTENT_ROOTS = ("content", "posts", "_posts", "blog", "articles", "wordlists", "lists", "datasets")
PROMPT_DIRS = ("skills", "patterns", "prompts", "commands", "agents", "workflows", "hooks", "packs")
PROMPT_ENDINGS = (".md", ".mdx", ".txt", ".yaml", ".yml", ".hbs", ".template")
AGENT_FILES = ("claude.md", "agents.md")
ROOT_DOC_WORDS = ("readme", "install", "changelog", "history", "contributing", "license", "security", "isa", "plan", "notes", "todo", "roadmap", "quickstart", "guide", "report", "migration")
DEPLOY_MODULE = r"^(wrangler|[a-z0-9_-]+\.config)\.(ts|mts|cts|js|mjs|cjs)\z"
BUILD_MODULE = r"^(tailwind|postcss|svelte|next|nuxt|astro|remix|tsup|unocss|uno|windi|karma|cypress|nodemon|commitlint|lint-staged|metro|drizzle|electron|quasar|vue|angular|ember|gatsby|docusaurus|vuepress|vitepress)\.config\."
PRODUCT = ("source", "app_config", "content", "asset")
PLUMBING = ("generated_vendored", "lockfile", "dependency_manifest", "ci_build")
TEST_PATH = r"(^|/)(tests?|__tests__|specs?|e2e|fixtures?|testdata|snapshots?)/|\.(test|spec)\.[a-z0-9]+\z|_test\.(go|rs|py)\z|(^|/)test_[^/]+\.py\z|(^|/)tests?\.rs\z"
PATTERN_FILE = r"(?i)(^|/)patterns/[^/]+/system\.md\z"
SNAPSHOT = r"(?i)(^|/)releases/v?[0-9]+(\.[0-9]+)*([-.][0-9a-z.]+)?/"
GENERIC_STEMS = ("index", "main", "mod", "lib", "app", "readme", "skill", "__init__", "__main__", "init", "default", "config", "types", "utils", "util", "helpers")
GENERIC_DIR = r"^(src|lib|app|packages?|skills?|workflows?|tools?|source)\z"


def base(p: Column) -> Column:
    """The last segment, lower case."""
    return F.lower(F.element_at(F.split(p, "/"), -1))


def ext(p: Column) -> Column:
    """The ending with its dot, lower case; empty for a name whose only dot is its first character."""
    return F.regexp_extract(base(p), r"^.+(\.[^.]*)\z", 1)


def folders(p: Column) -> Column:
    """The segments before the last, lower case."""
    s = F.split(F.lower(p), "/")
    return F.slice(s, 1, F.size(s) - 1)


def under(p: Column, names: Sequence[str]) -> Column:
    return F.arrays_overlap(folders(p), F.array(*map(F.lit, names)))


def is_snapshot(p: Column) -> Column:
    """``releases/<version>/`` with something below it."""
    return p.rlike(SNAPSHOT)


def is_doc_named(p: Column) -> Column:
    return base(p).isin(*DOC_NAMES) | (base(p).rlike(DOC_STEM) & ((ext(p) == "") | ext(p).isin(*PROSE)))


def is_test_path(p: Column) -> Column:
    return p.rlike(f"(?i){TEST_PATH}")


def in_prompt_root(p: Column, skill_dirs: Column | None) -> Column:
    """Under a folder of prompts by name, or under one that holds a skill file of the commit (``skill_dirs``, lower case)."""
    named = under(p, PROMPT_DIRS)
    if skill_dirs is None:
        return named
    s = folders(p)
    above = F.transform(F.when(F.size(s) > 0, F.sequence(F.lit(1), F.size(s))).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(s, 1, i), "/"))
    return named | F.coalesce(F.arrays_overlap(above, skill_dirs), F.lit(False))


def front_matter(head: Column) -> Column:
    """The lines between the two ``---`` at the top of an array of lines, joined; null where there are none."""
    end = F.array_position(F.slice(head, 2, F.greatest(F.size(head), F.lit(1))), "---")
    ok = head.isNotNull() & (F.size(head) > 0) & (F.trim(F.try_element_at(head, F.lit(1))) == "---") & (end > 0)
    return F.when(ok, F.array_join(F.slice(head, 2, F.greatest(end.cast("int") - 1, F.lit(0))), "\n"))


def says_draft(matter: Column) -> Column:
    return F.coalesce(matter.rlike(r"(?im)^draft:\s*true\s*$|^published:\s*false\s*$"), F.lit(False))


def classify(p: Column, kind: Column | str | None = None, head: Column | None = None, skill_dirs: Column | None = None) -> Column:
    """One of twelve classes; the first rule that fits decides. ``kind`` is the repository's, null read as mixed."""
    b, e = base(p), ext(p)
    k = F.coalesce(F.lit(kind) if kind is None or isinstance(kind, str) else kind, F.lit("mixed"))
    code, prompts, content, mixed = (k == x for x in ("code", "prompts", "content", "mixed"))
    at_root, prose = ~p.contains("/"), e.isin(*PROSE)
    marked = F.lit(False) if head is None else F.coalesce(F.exists(F.slice(head, 1, 10), lambda x: x.rlike(GENERATED_MARK)), F.lit(False))
    drafted = F.lit(False) if head is None else says_draft(front_matter(head))
    scope = content | (mixed & under(p, CONTENT_ROOTS))
    live = F.when(drafted, "draft").otherwise("content")
    doc_word = F.arrays_overlap(F.split(F.regexp_replace(b, r"\.mdx?\z", ""), "[-_. ]+"), F.array(*map(F.lit, ROOT_DOC_WORDS)))
    prompt_root = in_prompt_root(p, skill_dirs)
    own_prompt = prompts & e.isin(".md", ".mdx") & ((b.isin(*AGENT_FILES) & (at_root | under(p, (".claude",)) | prompt_root)) | (at_root & ~doc_word))
    config = e.isin(*CONFIGS) | (b == ".env.example") | b.isin(*DEPLOY_MANIFESTS)
    rules = (
        (under(p, GENERATED_DIRS) | b.rlike("(" + "|".join(x.replace(".", r"\.") for x in GENERATED_ENDINGS) + r")\z") | b.rlike(GENERATED_NAME) | marked, F.lit("generated_vendored")),
        (b.isin(*LOCKFILES), F.lit("lockfile")),
        (b.isin(*MANIFESTS) | b.rlike(MANIFEST_NAME), F.lit("dependency_manifest")),
        (under(p, CI_DIRS) | b.isin(*CI_NAMES, *HOUSEKEEPING) | b.rlike("^(" + "|".join(x.replace(".", r"\.") for x in CI_STARTS) + ")") | (~prompts & under(p, AGENT_DIRS)), F.lit("ci_build")),
        (under(p, TEST_DIRS) | b.rlike(TEST_NAME), F.lit("test")),
        (under(p, ARCHIVE_DIRS), F.lit("archived")),
        (under(p, DRAFT_DIRS), F.lit("draft")),
        (is_doc_named(p), F.lit("docs")),
        (own_prompt, F.lit("source")),
        (~content & (under(p, DOC_DIRS + EXAMPLE_DIRS) | (at_root & prose)), F.lit("docs")),
        (prose & (code | (mixed & ~under(p, CONTENT_ROOTS)) | (prompts & ~prompt_root)), F.lit("docs")),
        (prompts & e.isin(*PROMPT_ENDINGS) & prompt_root, F.lit("source")),
        (e.isin(*ASSETS), F.lit("asset")),
        (b.rlike(DEPLOY_MODULE) & ~b.rlike(BUILD_MODULE), F.lit("app_config")),
        (e.isin(*SOURCES), F.lit("source")),
        (config, F.when(scope & ~b.isin(*DEPLOY_MANIFESTS) & ~under(p, CONFIG_DIRS) & ~b.rlike(CONFIG_NAME), live).otherwise("app_config")),
        (scope & (prose | e.isin(*DATA)), live),
        (b.rlike(TOOL_DOTFILE), F.lit("ci_build")),
    )
    out = None
    for fits, cls in rules:
        out = F.when(fits, cls) if out is None else out.when(fits, cls)
    return out.otherwise("app_config")


def is_item(p: Column, cls: Column, kind: Column | str | None) -> Column:
    """A file that is one unit of the product: content, or a prompt in a repository of prompts."""
    k = F.coalesce(F.lit(kind) if kind is None or isinstance(kind, str) else kind, F.lit("mixed"))
    parent = F.try_element_at(folders(p), F.lit(-1))
    prompt = (base(p) == "skill.md") | under(p, ("workflows",)) | p.rlike(PATTERN_FILE) | (F.coalesce(parent.isin("commands", "agents", "prompts"), F.lit(False)) & (ext(p) == ".md"))
    return (cls == "content") | ((k == "prompts") & (cls == "source") & ext(p).isin(*PROSE) & prompt)


def words(stem: Column) -> Column:
    """Words of a name: separators and camel case become spaces."""
    x = F.regexp_replace(stem, "([a-z0-9])([A-Z])", "$1 $2")
    x = F.regexp_replace(x, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.lower(F.trim(F.regexp_replace(x, r"[-_.\s]+", " ")))


def path_words(p: Column) -> Column:
    """A path in plain words: its stem, or for a stem that says nothing the nearest folder that says something."""
    parts = F.filter(F.split(p, "/"), lambda x: x != "")
    file = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    cut = F.regexp_replace(file, r"\.[A-Za-z0-9]+\z", "")
    stem = F.when(cut == "", file).otherwise(cut)
    own = words(stem)
    above = F.filter(F.transform(F.reverse(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))), words), lambda w: (w != "") & ~w.rlike(GENERIC_DIR))
    named = F.when(F.lower(stem).isin(*GENERIC_STEMS) | (own == ""), F.coalesce(F.try_element_at(above, F.lit(1)), own)).otherwise(own)
    return F.when(named != "", named).when(words(file) != "", words(file)).otherwise("capability")
