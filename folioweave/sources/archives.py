"""Archives to their members, within budgets: one archive in one task, all of it or nothing.

zip, tar (gz, bz2, xz inside or not) and single streams are read; rar and 7z need a program from outside and are reported
as not expanded. Members that would leave the archive's folder, links and devices are passed over; members over the size
of a file are passed over alone; more bytes, more entries or a higher ratio than allowed reject the whole archive.

Defined results: null or corrupt content is not expanded; nested archives are expanded to `depth`, deeper ones stay files.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATIO = 200
STREAMS = {".gz": gzip.GzipFile, ".bz2": bz2.BZ2File, ".xz": lzma.LZMAFile}
# Suffixes of tar files, and of Office files that are zip containers but no archives.
TARS = (".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".tar.xz", ".txz")
DOCUMENTS = (".docx", ".xlsx", ".pptx", ".epub")


class OverBudget(Exception):
    pass


@dataclass
class Budget:
    """What one archive and all within it may unpack to."""

    member: int = 200 << 20
    entries: int = 100_000
    depth: int = 8
    bytes_used: int = 0
    entries_used: int = 0

    @property
    def total(self) -> int:
        return max(4 * self.member, 1 << 30)

    def entry(self) -> None:
        self.entries_used += 1
        if self.entries_used > self.entries:
            raise OverBudget

    def read(self, f, declared: int = 0) -> bytes | None:
        """A member's bytes; None if it alone is too large, whatever size it claims."""
        if declared > self.member:
            return None
        data = f.read(self.member + 1)
        if len(data) > self.member:
            return None
        self.bytes_used += len(data)
        if self.bytes_used > self.total:
            raise OverBudget
        return data


def kind(name: str) -> str | None:
    """The family of an archive by its name: zip, tar, stream, external; None for other files."""
    n = name.lower()
    if n.endswith(DOCUMENTS):
        return None
    if n.endswith(".zip"):
        return "zip"
    if n.endswith(TARS):
        return "tar"
    if n.endswith((".rar", ".7z")):
        return "external"
    return "stream" if n.endswith(tuple(STREAMS)) else None


def safe(name: str) -> str | None:
    """A member's path within its archive; None if it would lead out."""
    parts = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".")]
    return None if not parts or ".." in parts or name[:1] in "/\\" or name[1:2] == ":" else "/".join(parts)


def _members(name: str, content: bytes, budget: Budget) -> Iterator[tuple[str, bytes]]:
    family = kind(name)
    if family == "zip":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            infos = z.infolist()
            if sum(i.file_size for i in infos) / (sum(i.compress_size for i in infos) or 1) > RATIO:
                raise OverBudget
            for i in infos:
                if not i.is_dir():
                    budget.entry()
                    if (path := safe(i.filename)) and (data := budget.read(z.open(i), i.file_size)) is not None:
                        yield path, data
    elif family == "tar":
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            for m in t:
                if m.isreg():
                    budget.entry()
                    if (path := safe(m.name)) and (data := budget.read(t.extractfile(m), m.size)) is not None:
                        yield path, data
    elif family == "stream":
        suffix = "." + name.lower().rsplit(".", 1)[1]
        budget.entry()
        with STREAMS[suffix](io.BytesIO(content)) as f:
            if (data := budget.read(f)) is not None and (path := safe(name.rsplit("/", 1)[-1][: -len(suffix)] or name + ".out")):
                yield path, data
    else:
        raise ValueError("not expanded here")


def expand(name: str, content: bytes, budget: Budget, depth: int = 1) -> list[tuple[str, bytes]] | None:
    """(path, content) of all members, nested archives replaced by theirs; None where nothing could be expanded."""
    try:
        found = list(_members(name, content, budget))
    except OverBudget:
        raise
    except Exception:  # corrupt
        return None
    out = []
    for path, data in found:
        inner = expand(path, data, budget, depth + 1) if depth < budget.depth and kind(path) else None
        out += [(path, data)] if inner is None else [(f"{path}.unpacked/{p}", d) for p, d in inner]
    return out


def expanded(files: DataFrame, member: int = 200 << 20, entries: int = 100_000, depth: int = 8) -> DataFrame:
    """Files (path, content) with every archive replaced by its members, `archive` naming it; one that can't be
    expanded stays as a row of its own. Other files pass without Python."""
    is_archive = F.lower("path").rlike(r"\.(zip|tar|tgz|tbz2|txz|gz|bz2|xz|rar|7z)$")

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                try:
                    got = expand(path, content, Budget(member, entries, depth)) if content is not None else None
                except OverBudget:
                    got = None
                rows = [(path, path, content)] if got is None else [(path, f"{path}/{p}", d) for p, d in got]
                yield pd.DataFrame(rows, columns=["archive", "path", "content"])

    rest = files.where(~is_archive | F.col("path").isNull()).select(F.lit(None).cast("string").alias("archive"), "path", "content")
    return rest.unionByName(files.where(is_archive).select("path", "content").mapInPandas(part, "archive string, path string, content binary"))
