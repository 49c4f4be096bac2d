"""Paths: language and framework by name, gitwildmatch globs as regular expressions, ignore rules."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language by lower-cased file suffix (".blade.php" before ".php").
LANGUAGE_SUFFIXES: dict[str, list[str]] = {
    "blade": [".blade.php"],
    "php": [".php"],
    "typescript": [".ts"],
    "tsx": [".tsx"],
    "javascript": [".js", ".mjs", ".cjs"],
    "jsx": [".jsx"],
    "python": [".py", ".pyi"],
    "csharp": [".cs"],
    "dotnet": [".csproj", ".fsproj", ".vbproj", ".sln", ".props", ".targets"],
    "aspnet": [".cshtml", ".razor", ".aspx", ".ascx", ".master"],
    "asp": [".asp"],
    "css": [".css", ".scss", ".less"],
    "html": [".html", ".htm"],
    "json": [".json"],
    "yaml": [".yaml", ".yml"],
    "sql": [".sql"],
    "markdown": [".md", ".mdx"],
    "shell": [".sh", ".bash", ".zsh"],
}

# Framework by what exists under the root, the first that is found counts.
FRAMEWORK_PATHS: list[tuple[str, str]] = [
    ("app/Http/Controllers", "laravel"),
    ("app/Models", "laravel"),
    ("routes/web.php", "laravel"),
    ("artisan", "laravel"),
    ("pages/_app.tsx", "nextjs"),
    ("pages/_app.jsx", "nextjs"),
    ("next.config", "nextjs"),
    ("src/App.tsx", "react"),
    ("src/App.jsx", "react"),
    ("vite.config", "react"),
    ("*.sln", "dotnet"),
    ("*.csproj", "dotnet"),
]

# Paths that are never read.
NEVER_INDEX: list[str] = [
    *("**/.env", "**/.env.*", "**/*.key", "**/*.pem", "**/*.crt", "**/*.cert", "**/*.cer", "**/*.p12", "**/*.pfx", "**/*.p8"),
    *("**/id_rsa", "**/id_rsa.pub", "**/id_ecdsa", "**/id_ecdsa.pub", "**/id_ed25519", "**/id_ed25519.pub", "**/.ssh/**"),
    *("**/secrets/**", "**/credentials", "**/credentials.json", "**/service-account*.json", "**/serviceaccount*.json"),
    *("**/storage/logs/**", "**/storage/sessions/**", "**/storage/framework/cache/**", "**/storage/framework/sessions/**", "**/storage/uploads/**", "**/public/storage/**"),
    *("**/.git/**", "**/vendor/**", "**/node_modules/**", "**/__pycache__/**", "**/.venv/**", "**/venv/**", "**/.context/**"),
    *("**/*.db-wal", "**/*.db-shm", "**/*.sqlite-wal", "**/*.sqlite-shm", "**/*-journal"),
]

# Suffixes of binary files.
BINARY_SUFFIXES: list[str] = (
    ".exe .dll .so .dylib .bin .obj .o .a .lib .zip .tar .gz .bz2 .xz .7z .rar .jpg .jpeg .png .gif .bmp .ico .webp .tiff .avif "
    ".mp4 .avi .mov .mkv .mp3 .wav .ogg .flac .pdf .doc .docx .xls .xlsx .ppt .pptx .odt .woff .woff2 .ttf .otf .eot "
    ".db .sqlite .sqlite3 .mdb .db-wal .db-shm .sqlite-wal .sqlite-shm .pkl .pickle .index .faiss .pyc .pyd .pyo .class .jar .dmg .iso .img"
).split()


def suffix_of(path: Column) -> Column:
    """Lower-cased suffix of the last path segment, empty without one (a leading dot starts no suffix)."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def language_of(path: Column) -> Column:
    """Language of a path, `unknown` for others."""
    plain = F.create_map(*[F.lit(x) for name, suffixes in LANGUAGE_SUFFIXES.items() if name != "blade" for s in suffixes for x in (s, name)])
    return F.when(F.lower(path).endswith(".blade.php"), "blade").otherwise(F.coalesce(F.try_element_at(plain, suffix_of(path)), F.lit("unknown")))


def framework_of(paths) -> str | None:
    """Framework of a DataFrame of relative paths (column path), or None: one aggregate over all rows."""
    rank = F.lit(None).cast("int")
    for i, (pattern, _) in reversed(list(enumerate(FRAMEWORK_PATHS))):
        p = F.col("path")
        hit = p.rlike(glob_regex("/" + pattern)) if "*" in pattern else (p == pattern) | p.startswith(pattern + "/")
        rank = F.when(hit, i).otherwise(rank)
    first = paths.agg(F.min(rank)).first()[0]
    return None if first is None else FRAMEWORK_PATHS[first][1]


def glob_regex(pattern: str) -> str:
    """Regular expression (for a search in a whole relative path) of a gitwildmatch pattern without `!`.

    A pattern with a / before its end is anchored at the root; others match at any depth; a trailing /
    matches directories only; whatever lies under a match matches, too.
    """
    directory = pattern.endswith("/")
    body = pattern.strip("/") if pattern.strip("/") else ""
    anchored = pattern.startswith("/") or "/" in body
    parts = body.split("/")
    out = ""
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            if last:
                out += ".+"
            else:
                out += "(?:[^/]+/)*"
            continue
        out += _segment(part) + ("" if last else "/")
    tail = "" if parts[-1] == "**" else ("/.*" if directory else "(?:/.*)?")
    return ("^" if anchored else "^(?:.*/)?") + out + tail + "$"


def _segment(part: str) -> str:
    out, i = "", 0
    while i < len(part):
        c = part[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            close = part.find("]", i + 2 if part[i + 1 : i + 2] in ("!", "^", "]") else i + 1)
            if close < 0:
                out += r"\["
            else:
                inner = part[i + 1 : close]
                inner = ("^" + inner[1:]) if inner[:1] == "!" else inner
                out += "[" + inner.replace("\\", "\\\\").replace("[", r"\[") + "]"
                i = close
        elif c == "\\" and i + 1 < len(part):
            i += 1
            out += re.escape(part[i])
        else:
            out += re.escape(c)
        i += 1
    return out


def glob_match(path: Column, pattern: str) -> Column:
    """Whether one gitwildmatch pattern matches; a comment, blank or negated pattern matches nothing."""
    if not pattern.strip() or pattern.startswith(("#", "!")):
        return F.lit(False)
    return path.rlike(glob_regex(pattern.strip()))


class IgnoreRules:
    """The ignore files of a tree: a path is ignored if the last matching line of any one file says so."""

    def __init__(self, files: dict[str, str]):
        self.specs: list[tuple[str, list[tuple[bool, re.Pattern]]]] = []
        for folder, text in sorted(files.items()):
            lines = [x.rstrip() for x in text.split("\n")]
            rules = [(x.startswith("!"), re.compile(glob_regex(x.lstrip("!")))) for x in lines if x and not x.startswith("#") and x.strip("!/")]
            self.specs.append((folder.strip("/"), rules))

    def ignored(self, path: str) -> bool:
        for folder, rules in self.specs:
            if folder and not path.startswith(folder + "/"):
                continue
            own = path[len(folder) + 1 :] if folder else path
            verdict = False
            for negated, rule in rules:
                if rule.search(own):
                    verdict = not negated
            if verdict:
                return True
        return False


class Blocklist:
    """Files that are never read: by suffix, by pattern, by size (equal to the limit passes)."""

    def __init__(self, extra: list[str] | None = None, max_bytes: int = 2 * 1024 * 1024, extra_suffixes: list[str] | None = None):
        self.pattern = "|".join(f"(?:{glob_regex(p)})" for p in [*NEVER_INDEX, *(extra or [])])
        self.suffixes = sorted({*BINARY_SUFFIXES, *(extra_suffixes or [])})
        self.max_bytes = max_bytes
        self._regex = re.compile(self.pattern)

    def allowed(self, path: str, size: int | None = None) -> bool:
        suffix = posixpath.splitext(path)[1].lower()
        return suffix not in self.suffixes and not self._regex.search(path) and (size is None or size <= self.max_bytes)

    def require(self, path: str, size: int | None = None) -> None:
        if not self.allowed(path, size):
            raise PermissionError(f"{path} may not be read")

    def allowed_column(self, path: Column, size: Column) -> Column:
        return ~suffix_of(path).isin(self.suffixes) & ~path.rlike(self.pattern) & (size <= self.max_bytes)

    def rejected_count(self, files) -> int:
        """Rows of a DataFrame (path, size_bytes) that may not be read."""
        return files.where(~self.allowed_column(F.col("path"), F.col("size_bytes"))).count()
