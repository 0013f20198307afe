"""File, dataset, configuration and report sources and sinks."""

from __future__ import annotations

import json
import os
import tomllib
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OFFICE = "application/vnd.openxmlformats-officedocument."
MEDIA_TYPES = {
    **{f".{s}": f"image/{t}" for t, ss in {"png": "png", "jpeg": "jpg jpeg", "tiff": "tif tiff", "bmp": "bmp", "webp": "webp"}.items() for s in ss.split()},
    **{f".{s}": f"audio/{t}" for s, t in {"wav": "wav", "flac": "flac", "mp3": "mpeg", "m4a": "mp4"}.items()},
    **{f".{s}": f"video/{s}" for s in ("mp4", "webm")},
    **{f".{s}": f"text/{t}" for t, ss in {"plain": "txt", "markdown": "md markdown", "html": "html htm", "x-python": "py", "javascript": "js", "typescript": "ts", "x-java-source": "java", "x-go": "go", "x-rust": "rs", "x-c": "c h", "x-c++": "cpp"}.items() for s in ss.split()},
    **{f".{s}": f"application/{t}" for t, ss in {"json": "json", "yaml": "yaml yml", "toml": "toml", "pdf": "pdf", "vnd.ms-excel.sheet.macroEnabled.12": "xlsm"}.items() for s in ss.split()},
    ".eml": "message/rfc822",
    ".pptx": _OFFICE + "presentationml.presentation",
    ".xlsx": _OFFICE + "spreadsheetml.sheet",
}
UNKNOWN = "application/octet-stream"
_PROSE = {"text/plain": "plain", "text/markdown": "markdown", "text/html": "html", "message/rfc822": "email"}
TEXT_KINDS = {t: _PROSE.get(t, "code") for t in MEDIA_TYPES.values() if t.startswith(("text/", "message/")) or t in ("application/json", "application/yaml", "application/toml")}


def media_type(path: Column) -> Column:
    """The media type by a path's suffix, inside the JVM."""
    suffix = F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for kv in sorted(MEDIA_TYPES.items()) for x in kv])
    return F.coalesce(F.try_element_at(kinds, suffix), F.lit(UNKNOWN))


def local_path(uri: str) -> Path:
    """The absolute path of a path or file URI; other schemes and hosts are refused."""
    u = urlparse(uri)
    if u.scheme not in ("", "file") or u.netloc not in ("", "localhost"):
        raise ValueError(f"{uri!r} is no local file")
    return Path(unquote(u.path) if u.scheme else uri).expanduser().absolute()


def scan_files(spark: SparkSession, uri: str, most_files: int = 10_000, most_bytes: int = 1 << 30) -> DataFrame:
    """Assets (uri, asset_id, media_type, sha256, size_bytes, content) of a file or a directory.

    Links, empty files and sizes or counts over the limits are errors; ``__pycache__`` is passed
    over.  Order, where it matters, is that of path components: see :func:`path_order`.
    """
    root = local_path(uri)
    if not root.exists():
        raise FileNotFoundError(str(root))
    names = [root] if root.is_file() else [Path(d) / f for d, _, fs in os.walk(root) for f in fs]
    names = [p for p in names if "__pycache__" not in p.parts]
    if root.is_symlink() or any(p.is_symlink() for p in names):
        raise ValueError("links are not followed")
    if len(names) > most_files:
        raise OverflowError(f"{len(names)} files exceed the limit of {most_files}")
    sizes = [p.stat().st_size for p in names]
    if sum(sizes) > most_bytes:
        raise OverflowError(f"{sum(sizes)} bytes exceed the limit of {most_bytes}")
    if 0 in sizes:
        raise ValueError(f"{names[sizes.index(0)]} is empty")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(root)).where("path NOT LIKE '%/__pycache__/%'")
    where = F.regexp_replace("path", "^file:/+", "file:///")
    return raw.select(where.alias("uri"), F.concat(F.lit("asset-"), F.sha2(where, 256)).alias("asset_id"), media_type(F.col("path")).alias("media_type"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), "content")


def path_order(uri: Column) -> Column:
    return F.split(uri, "/")


EXAMPLE = "example_id STRING, query STRING, expected_answer STRING"


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of exactly example_id, query and expected_answer, all non-empty strings, ids
    unique; anything else is an error."""
    rows = [json.loads(x) for x in local_path(path).read_text().splitlines() if x.strip()]
    for r in rows:
        if set(r) != {"example_id", "query", "expected_answer"} or not all(isinstance(v, str) and v.strip() for v in r.values()):
            raise ValueError(f"malformed example: {r!r}")
    if len({r["example_id"] for r in rows}) < len(rows) or not rows:
        raise ValueError("examples need unique ids and at least one row")
    return spark.createDataFrame([(r["example_id"], r["query"], r["expected_answer"]) for r in rows], EXAMPLE)


_CASE = {"case_id", "family", "business_use_case", "source_uri", "query", "relevant_evidence_ids", "expected_extractions", "required_locator_kinds", "eligibility", "ineligible_reason"}


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a versioned JSON dataset, checked field by field."""
    d = json.loads(local_path(path).read_text())
    seen: set[str] = set()
    out = []
    for c in d["cases"]:
        ids = c.get("relevant_evidence_ids") or []
        if set(c) - _CASE or c["case_id"] in seen or c.get("expected_extractions", 0) <= 0 or not ids or len(set(ids)) < len(ids):
            raise ValueError(f"malformed case: {c.get('case_id')!r}")
        if (c.get("eligibility", "eligible") == "ineligible") != bool(c.get("ineligible_reason")):
            raise ValueError("an ineligible case, and only that, has a reason")
        seen.add(c["case_id"])
        out.append((c["case_id"], c["family"], c["source_uri"], c["query"], ids, c["expected_extractions"], c.get("required_locator_kinds", []), c.get("ineligible_reason")))
    return spark.createDataFrame(out, "case_id string, family string, source_uri string, query string, relevant array<string>, expected_extractions int, required_locators array<string>, ineligible_reason string")


#: Sections and fields of a profile, with their defaults.
PROFILE = {
    "profile": {"name": "offline", "family": "text"},
    "source": {"uri": "", "max_files": 1000, "max_bytes": 1 << 28},
    "chunking": {"strategy": "auto", "max_chars": 1200, "overlap_chars": 120, "min_chunk_chars": 80, "semantic_threshold": 0.72, "include_parent_context": True},
    "indexing": {"strategy": "auto", "vector_database": "in_memory", "physical_index": "default", "dimension": 128},
    "retrieval": {"top_k": 5, "candidate_multiplier": 4, "max_candidates": 1000, "rrf_k": 60},
    "generation": {"max_context_chars": 4000, "max_output_tokens": 64, "temperature": 0.0},
}


def load_profile(path: str | Path) -> dict:
    """A TOML profile over the defaults; unknown sections, fields and types are errors."""
    given = tomllib.loads(Path(path).read_text())
    out = {s: dict(f) for s, f in PROFILE.items()}
    for section, fields in given.items():
        if section not in PROFILE or not isinstance(fields, dict):
            raise ValueError(f"unknown section {section!r}")
        for k, v in fields.items():
            if k not in PROFILE[section]:
                raise ValueError(f"unknown field {section}.{k}")
            want = PROFILE[section][k]
            if isinstance(want, float) and isinstance(v, int) and not isinstance(v, bool):
                v = float(v)
            if type(v) is not type(want):
                raise ValueError(f"{section}.{k} must be a {type(want).__name__}")
            out[section][k] = v
    return out


def report_json(report) -> str:
    return json.dumps(report, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
