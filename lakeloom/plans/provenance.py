"""Where a result comes from: file signatures, hashes, versions, snapshots of the source and of what it depends on."""

from __future__ import annotations

import hashlib
import importlib.metadata
import io
import json
import os
import platform
import re
import zipfile
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from . import artifacts

PACKAGES = ("pyspark", "pyarrow", "pandas", "numpy")


@dataclass
class Hashes:
    """SHA-256 of files, kept by path, length and time of change; a file that changes while it is read is an error."""

    spark: SparkSession
    _known: dict[tuple, str] = field(default_factory=dict)

    def signature(self, path: str) -> tuple[str, int, int]:
        fs, p = artifacts.files(self.spark, path)
        if not fs.exists(p):
            raise FileNotFoundError(path)
        status = fs.getFileStatus(p)
        return (status.getPath().toString(), status.getLen(), status.getModificationTime())

    def sha256(self, path: str) -> str:
        before = self.signature(path)
        if before not in self._known:
            fs, p = artifacts.files(self.spark, path)
            jvm = self.spark._jvm
            digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
            stream = jvm.java.security.DigestInputStream(fs.open(p), digest)
            try:
                jvm.org.apache.commons.io.IOUtils.consume(stream)
            finally:
                stream.close()
            if self.signature(path) != before:
                raise RuntimeError(f"{path} changed while it was read")
            self._known[before] = bytes(digest.digest()).hex()
        return self._known[before]

    def verify(self, path: str, sha256: str) -> None:
        if self.sha256(path) != sha256:
            raise ValueError(f"{path}: the content differs from its record")


def redacted(url: str | None) -> str:
    """Scheme, host and port of a service's address; what can't be parsed says only that there is one."""
    m = re.match(r"^([A-Za-z][A-Za-z0-9+.-]*://)(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]]+)(:\d+)?(?:[/?#]|$)", url or "")
    return "" if not url else f"{m[1]}{m[2]}{m[3] or ''}".lower() if m else "configured (redacted)"


def versions(*packages: str) -> dict[str, str | None]:
    out: dict[str, str | None] = {}
    for name in packages:
        try:
            out[name] = importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            out[name] = None
    return out


def lock() -> str:
    """name==version of every installed distribution, one a line, in order."""
    found = {(d.metadata["Name"] or "").lower().replace("_", "-"): d.version for d in importlib.metadata.distributions()}
    return "".join(f"{name}=={version}\n" for name, version in sorted(found.items()) if name)


def _sources(folder: str) -> list[tuple[str, str]]:
    """(name below the folder, path) of its source files, in order; caches and hidden folders are left out."""
    out = []
    for at, folders, names in os.walk(folder):
        folders[:] = sorted(f for f in folders if not f.startswith((".", "__pycache__")))
        out += [(os.path.relpath(os.path.join(at, n), folder).replace(os.sep, "/"), os.path.join(at, n)) for n in names if n.endswith((".py", ".md", ".toml", ".txt", ".json"))]
    return sorted(out)


def code_hashes(folder: str) -> dict[str, str]:
    out = {}
    for name, path in _sources(folder):
        with open(path, "rb") as f:
            out[name] = hashlib.sha256(f.read()).hexdigest()
    return out


def source_snapshot(folder: str) -> bytes:
    """A zip of the folder's sources with a list of their hashes; equal sources give equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        put = lambda name, data: z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
        for name, path in _sources(folder):
            with open(path, "rb") as f:
                put(name, f.read())
        put("MANIFEST.json", json.dumps(code_hashes(folder), indent=1, sort_keys=True))
    return out.getvalue()


def collect(spark: SparkSession, roots: dict[str, str] | None = None, paths: dict[str, str] | None = None, models: dict[str, dict] | None = None, parameters: dict | None = None, code: str | None = None, hashes: Hashes | None = None) -> dict:
    """What a run used: artifacts and files with their hashes, models (addresses redacted), software, code and parameters."""
    hashes = hashes or Hashes(spark)

    def published(root: str) -> dict | None:
        try:
            return {"root": root, "facts": artifacts.manifest(spark, root)[1]}
        except FileNotFoundError:
            return None

    def file(path: str) -> dict:
        try:
            return {"path": path, "exists": True, "sha256": hashes.sha256(path)}
        except FileNotFoundError:
            return {"path": path, "exists": False, "sha256": None}

    return {
        "artifacts": {name: published(root) for name, root in (roots or {}).items()},
        "files": {name: file(path) for name, path in (paths or {}).items()},
        "models": {name: {k: redacted(v) if k == "base_url" else v for k, v in m.items()} for name, m in (models or {}).items()},
        "software": {"python": platform.python_version(), "spark": spark.version, "dependencies": versions(*PACKAGES)},
        "code": code_hashes(code) if code else {},
        "parameters": parameters or {},
    }
