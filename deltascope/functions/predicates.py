"""Predicates of the review pipeline as Column expressions (all codegen, no Python on rows)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Generated or vendored files that a review skips.
NOISE_FILES = ("pnpm-lock.yaml", "package-lock.json", "yarn.lock", "npm-shrinkwrap.json", "bun.lockb", "Cargo.lock", "Gemfile.lock", "poetry.lock", "Pipfile.lock", "uv.lock", "go.sum", "composer.lock", "packages.lock.json", "pubspec.lock", "Package.resolved", "mix.lock", ".DS_Store")
NOISE_SUFFIXES = (".min.js", ".min.css", ".map", ".chunk.js", ".bundle.js")
NOISE_FOLDERS = ("dist/", ".next/", "build/", "__generated__/", ".turbo/")
WEB_NOISE = r"\.lock$|package-lock\.json$|yarn\.lock$|\.min\.(js|css)$|\.map$|\.DS_Store$|\bdist/|\bbuild/|\b__generated__/|\.snap$"
# Extensions of files that the dependency graph covers, and of code named in findings.
GRAPH_EXTENSIONS = ("rs", "ts", "tsx", "js", "jsx", "py", "go", "java", "c", "cpp", "rb", "cs", "php")
CODE_EXTENSIONS = (".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".go", ".rs", ".rb", ".c", ".cpp", ".cs", ".swift", ".kt", ".scala", ".hbs", ".erb", ".ex", ".exs", ".hcl")
# What a signature line starts with or contains.
SIGNATURE_STARTS = ("fn ", "pub fn ", "pub(crate) fn ", "def ", "class ", "struct ", "enum ", "trait ", "impl ", "interface ", "type ", "pub struct ", "pub enum ", "pub trait ", "async fn ", "pub async fn ", "function ", "export function ", "export default ")
SIGNATURE_PARTS = ("->", "=> ", ": &", ": Vec<", ": Option<", ": Result<")
RISK_ORDER = ("low", "medium", "high", "critical")
LINE_TOLERANCE = 10


def any_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for x in conditions[1:]:
        out = out | x
    return out


def starts_with(col: Column, values: tuple[str, ...]) -> Column:
    return any_of([col.startswith(v) for v in values])


def ends_with(col: Column, values: tuple[str, ...]) -> Column:
    return any_of([col.endswith(v) for v in values])


def contains(col: Column, values: tuple[str, ...]) -> Column:
    return any_of([col.contains(v) for v in values])


def is_noise(path: Column) -> Column:
    """Lock files, minified bundles and build folders at the root."""
    return F.substring_index(path, "/", -1).isin(*NOISE_FILES) | ends_with(path, NOISE_SUFFIXES) | starts_with(path, NOISE_FOLDERS)


def is_web_noise(path: Column) -> Column:
    """The dashboard's variant: build folders anywhere, snapshots and any lock file."""
    return path.rlike(WEB_NOISE)


def is_source_file(path: Column) -> Column:
    return F.lower(path).rlike(rf"\.({'|'.join(GRAPH_EXTENSIONS)})$")


def risk_rank(level: Column) -> Column:
    """0 .. 3; an unknown level is the lowest."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, RISK_ORDER)), F.lower(level)).cast("int"), F.lit(0)) - F.when(F.lower(level).isin(*RISK_ORDER), 1).otherwise(0)


def at_least(rank: Column, level: str) -> Column:
    return rank >= (RISK_ORDER.index(level.lower()) if level.lower() in RISK_ORDER else 0)


def in_file(path: Column, wanted: str) -> Column:
    return path.endswith(wanted)


def named(name: Column, wanted: str) -> Column:
    """The name itself, or a member path that ends with it."""
    return (name == wanted) | name.endswith(f"::{wanted}") | name.endswith(f".{wanted}")


def is_comment(line: Column) -> Column:
    return line.rlike(r'^(//|/\*|\*|""")') | (line.startswith("#") & ~line.startswith("#["))


def is_signature(line: Column) -> Column:
    return starts_with(line, SIGNATURE_STARTS) | contains(line, SIGNATURE_PARTS)


def is_public(kind: Column, name: Column, after: Column | None = None) -> Column:
    """Public by the first line of its new text, or by an upper-case name of a callable or type."""
    by_name = kind.isin("function", "method", "struct", "interface") & name.rlike(r"^\p{Lu}")
    if after is None:
        return by_name
    first = F.split(after, "\n")[0]
    return F.coalesce(starts_with(first, ("pub ", "pub(crate)", "export ", "module.exports")), F.lit(False)) | by_name


def is_cosmetic(structural: Column) -> Column:
    return structural.eqNullSafe(F.lit(False))


def same_path(a: Column, b: Column) -> Column:
    """Equal after normalising separators, or one a suffix of the other; empty never."""
    x, y = (F.regexp_replace(F.regexp_replace(p, r"\\", "/"), "^/+", "") for p in (a, b))
    return (a != "") & (b != "") & (x.endswith(y) | y.endswith(x))


def lines_overlap(g_from: Column, g_to: Column, f_from: Column, f_to: Column, tolerance: int = LINE_TOLERANCE) -> Column:
    """Ranges meet within the tolerance; 0 or null means unknown."""
    gf, gt, ff, ft = (F.nullif(x, F.lit(0)) for x in (g_from, g_to, f_from, f_to))
    known = F.coalesce(gf, gt).isNotNull() & F.coalesce(ff, ft).isNotNull()
    return F.coalesce(known & (F.greatest(F.lit(1), F.coalesce(gf, gt) - tolerance) <= F.coalesce(ft, ff)) & (F.coalesce(ff, ft) <= F.coalesce(gt, gf) + tolerance), F.lit(False))


def names_foreign_file(issue: Column, basenames: Column) -> Column:
    """The text names a code file whose basename is not among the changed ones."""
    tokens = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(issue), "/", " / "), r"\s+", " ")), " ")
    return F.exists(tokens, lambda w: ends_with(w, CODE_EXTENSIONS) & ~F.array_contains(basenames, w))
