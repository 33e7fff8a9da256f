"""Column expressions over source text and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions of the seven languages, manifests, directories never walked, and asset extensions.
LANGUAGES = {"ts": "TypeScript", "mts": "TypeScript", "cts": "TypeScript", "tsx": "TSX", "js": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "jsx": "JSX", "rs": "Rust", "py": "Python", "pyi": "Python", "go": "Go"}
MANIFESTS = ["package.json", "Cargo.toml", "go.mod", "go.work", "jsconfig.json", "pnpm-workspace.yaml", "pyproject.toml", "setup.cfg"]
SKIP_DIRS = [".git", ".hg", ".svn", "node_modules", "target", "dist", "build", "out", ".next", ".nuxt", ".turbo", ".svelte-kit", ".venv", "venv", "__pycache__", ".mypy_cache", ".pytest_cache", ".tox", "vendor", "Pods", ".gradle", ".idea", ".vscode", "coverage", ".cache"]
ASSETS = "css scss sass less styl svg png jpg jpeg gif webp avif ico bmp json json5 yaml yml toml txt md mdx wasm woff woff2 ttf otf eot mp3 mp4 webm ogg wav glsl frag vert graphql gql html xml csv pdf".split()
SEVERITIES = ["Info", "Low", "Medium", "High", "Critical"]
#: Size cap of a source file in bytes, and the first bytes in which a NUL tells a binary.
MAX_BYTES, SNIFFED = 2 * 1024 * 1024, 8192


def is_manifest(name: Column) -> Column:
    """Whether a file name is that of a project file."""
    return name.isin(*MANIFESTS) | name.rlike(r"^tsconfig.*\.json$")


def language_of(extension: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[extension]


#: A block comment that begins its line, with all of its first and last line; open ones reach to the end.
_BLOCK = r"(?dm)^[\h\x0b\f\r\x85]*(?=/\*)(?s:.*?)(?:\*/[^\n]*|\z)"


def loc(text: Column, language: Column) -> Column:
    """Lines of code: neither blank nor comment. A line inside or opening a block comment counts as comment, in every language."""
    bare = F.regexp_replace(text, _BLOCK, "")
    begins = lambda mark: F.regexp_count(bare, F.lit(rf"(?dm)^[\h\x0b\f\r\x85]*(?!{mark})[^\h\v]"))
    return F.when(language == "Python", begins("#")).otherwise(begins("//"))


def total_lines(text: Column) -> Column:
    """Lines as an editor counts them: no empty one after a final line end."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return ends + ((text != "") & ~F.endswith(text, F.lit("\n"))).cast("int")


def severity_for(score: Column) -> Column:
    """Severity of a FLOAT score."""
    bound = lambda v: F.lit(v).cast("float")
    return F.when(score >= bound(0.95), "Critical").when(score >= bound(0.85), "High").when(score >= bound(0.65), "Medium").when(score >= bound(0.4), "Low").otherwise("Info")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


def heat_of(severity: Column) -> Column:
    heats = dict(zip(SEVERITIES, (0.1, 0.35, 0.6, 0.85, 1.0)))
    return F.coalesce(*[F.when(severity == s, F.lit(h)) for s, h in heats.items()])


def time_label(seconds: Column, span: Column) -> Column:
    """UTC label of an epoch second: clock time under two days of span, month and day under 75, else year and month."""
    at = F.timestamp_seconds(seconds)
    shown = lambda f: F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")), f)
    return F.when(span < 2 * 86_400, shown("HH:mm")).when(span < 75 * 86_400, shown("MM-dd")).otherwise(shown("yyyy-MM"))


def can_be_dead(path: Column) -> Column:
    """Whether a file that nothing imports may be dead: no declaration, configuration, test, example, bench or root script."""
    name = F.substring_index(path, "/", -1)
    exempt = (
        name.rlike(r"\.d\.ts$|\.config\.|\.mjs$|\.cjs$") | path.rlike(r"\.test\.|\.spec\.|/tests/|/test/|/examples/|/benches/|__tests__") | (~F.contains(path, F.lit("/")) & F.endswith(name, F.lit(".js")))
    )
    return ~exempt


def is_entry_name(path: Column) -> Column:
    """Usual entry points: main and lib files, and an index at the root or directly in a ``src`` directory."""
    return path.rlike(r"(^|/)(main\.rs|lib\.rs|build\.rs|main\.tsx|main\.ts|App\.tsx)$") | path.rlike(r"(^|(^|/)src/)index\.(ts|tsx|js|jsx)$")


def diagram_ident(path: Column) -> Column:
    plain = F.regexp_replace(path, "[^A-Za-z0-9]", "_")
    return F.when(plain == "", F.lit("root")).when(plain.rlike("^[0-9]"), F.concat(F.lit("n"), plain)).otherwise(plain)


def node_radius(size: Column) -> Column:
    return 3 + 0.6 * F.sqrt(size)


def package_name(specifier: Column) -> Column:
    """npm package of a bare specifier: ``@scope/name`` or the first segment."""
    return F.regexp_extract(specifier, r"^(@[^/]+/[^/]+|[^/]+)", 1)


def crate_name(name: Column) -> Column:
    return F.translate(name, "-", "_")


def is_asset(specifier: Column) -> Column:
    cut = F.regexp_replace(specifier, r"[?#].*$", "")
    return F.lower(F.regexp_extract(cut, r"\.([A-Za-z0-9]+)$", 1)).isin(*ASSETS)


def windows_safe(name: Column) -> Column:
    """Whether Windows can hold the file name: no reserved character or device name, no trailing dot or space."""
    return ~(name.rlike(r'[<>:"|?*\\\x00-\x1f]') | name.rlike(r"[. ]$") | name.rlike(r"(?i)^(con|prn|aux|nul|com[0-9]|lpt[0-9])(\..*)?$") | (name == ""))


def looks_binary(content: Column) -> Column:
    return F.contains(F.substring(content, 1, SNIFFED), F.lit(b"\x00"))
