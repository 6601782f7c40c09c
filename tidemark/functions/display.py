"""Media types, icons, and sizes and ages for people."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import basename, suffix

# fixed values: media types by extension, and names without one that are text
MIME = {
    ".md": "text/markdown", ".markdown": "text/markdown", ".txt": "text/plain", ".log": "text/plain", ".csv": "text/csv",
    ".tsv": "text/tab-separated-values", ".json": "application/json", ".jsonc": "application/json", ".yaml": "application/yaml",
    ".yml": "application/yaml", ".toml": "application/toml", ".xml": "application/xml", ".html": "text/html", ".htm": "text/html",
    ".css": "text/css", ".js": "text/javascript", ".mjs": "text/javascript", ".cjs": "text/javascript", ".ts": "text/typescript",
    ".tsx": "text/typescript", ".jsx": "text/javascript", ".sh": "application/x-sh", ".svg": "image/svg+xml", ".png": "image/png",
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".webp": "image/webp", ".avif": "image/avif", ".ico": "image/x-icon",
    ".pdf": "application/pdf", ".zip": "application/zip", ".gz": "application/gzip", ".wasm": "application/wasm", ".mp3": "audio/mpeg",
    ".wav": "audio/wav", ".mp4": "video/mp4", ".webm": "video/webm", ".woff": "font/woff", ".woff2": "font/woff2",
}
TEXT_NAMES = ("license", "licence", "readme", "makefile", "dockerfile", "procfile", "changelog", "authors", "notice")
TEXT_TYPES = ("application/json", "application/yaml", "application/toml", "application/xml", "application/x-sh", "image/svg+xml")
UNITS = ("bytes", "KB", "MB", "GB", "TB")


def mime(path: Column) -> Column:
    name = basename(path)
    types = F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair))
    plain = F.startswith(name, F.lit(".")) | F.lower(name).isin(*TEXT_NAMES)
    return F.coalesce(F.try_element_at(types, F.lower(suffix(name))), F.when(plain, "text/plain").otherwise("application/octet-stream"))


def is_text_mime(type_: Column) -> Column:
    return F.startswith(type_, F.lit("text/")) | type_.isin(*TEXT_TYPES)


def looks_textual(text: Column) -> Column:
    """Whether the first 4096 characters hold no control character but tab and line ends, and no replacement character."""
    return ~F.rlike(F.substring(text, 1, 4096), F.lit("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFD]"))


def icon(type_: Column) -> Column:
    families = (("image/", "🖼"), ("audio/", "🎵"), ("video/", "🎬"), ("font/", "🔤"))
    rest = F.when(type_ == "application/pdf", "📕").when(type_.isin("application/zip", "application/gzip"), "🗜").when(is_text_mime(type_), "📄").otherwise("📦")
    return reduce(lambda other, f: F.when(F.startswith(type_, F.lit(f[0])), f[1]).otherwise(other), reversed(families), rest)


def format_bytes(size: Column) -> Column:
    """1024 to a unit; one decimal below ten."""
    out = F.when(size == 1, F.lit("1 byte")).otherwise(F.concat(size.cast("string"), F.lit(" bytes")))
    for unit in range(1, len(UNITS)):
        value = size / float(1024**unit)
        short = F.when(value < 10, F.format_string("%.1f", value)).otherwise(F.format_string("%.0f", value))
        out = F.when(size >= 1024**unit, F.concat(short, F.lit(" " + UNITS[unit]))).otherwise(out)
    return out


def format_size(size: Column) -> Column:
    long = F.concat(format_bytes(size), F.lit(" ("), F.format_number(size, 0), F.lit(" bytes)"))
    return F.when(size < 1024, format_bytes(size)).otherwise(long)


def format_ago(at_ms: Column, now_ms: Column) -> Column:
    half_up = lambda x: F.floor(x + 0.5)
    seconds = F.greatest(F.lit(0), half_up((now_ms - at_ms) / 1000.0))
    minutes = half_up(seconds / 60.0)
    hours = half_up(minutes / 60.0)
    days = half_up(hours / 24.0)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(seconds < 60, text(seconds, "s ago")).when(minutes < 60, text(minutes, "m ago")).when(hours < 24, text(hours, "h ago")).otherwise(text(days, "d ago"))
