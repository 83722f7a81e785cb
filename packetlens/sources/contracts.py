"""Strict JSON documents, configuration objects, and atomic publication of result folders."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import tempfile
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from pathlib import Path


class ContractError(ValueError):
    """A document breaks its contract."""


def load_strict(path: str | Path, *, keys: Sequence[str] | None = None) -> tuple[dict, str]:
    """A JSON object and the SHA-256 of its bytes; repeated keys, links and (with ``keys``) any
    other set of top-level keys raise."""
    p = Path(path)
    if p.is_symlink():
        raise ContractError(f"{p} is a link")
    raw = p.read_bytes()

    def unique(pairs):
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ContractError(f"{p}: repeated key")
        return out

    try:
        document = json.loads(raw.decode("utf-8"), object_pairs_hook=unique)
    except ValueError as problem:
        raise ContractError(f"{p}: {problem}") from None
    if not isinstance(document, dict):
        raise ContractError(f"{p}: not an object")
    if keys is not None:
        require_keys(document, keys, str(p))
    return document, hashlib.sha256(raw).hexdigest()


def require_keys(document: Mapping, keys: Sequence[str], where: str) -> None:
    missing, extra = set(keys) - set(document), set(document) - set(keys)
    if missing or extra:
        raise ContractError(f"{where}: missing {sorted(missing)}, unexpected {sorted(extra)}")


def number(document: Mapping, key: str, *, low: float, high: float, whole: bool = False) -> float:
    value = document.get(key)
    if isinstance(value, bool) or not isinstance(value, int if whole else (int, float)) or not low <= value <= high:
        raise ContractError(f"{key}: expected a number in {low}..{high}")
    return value


def write_report(path: str | Path, value) -> None:
    """JSON with sorted keys and an indent of two, ending in a line feed."""
    Path(path).write_text(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")


def allow_list(value) -> dict[str, str]:
    """Host to class from a list of pairs or a mapping; hosts normalised, no repeats, not empty."""
    from packetlens.functions.frames import normal_host

    pairs = value.items() if isinstance(value, Mapping) else [(e["host"], e["class_name"]) for e in value]
    out: dict[str, str] = {}
    for host, name in pairs:
        h = normal_host(host)
        if h is None or not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}", name):
            raise ContractError(f"bad entry {host!r}: {name!r}")
        if h in out:
            raise ContractError(f"repeated host {h}")
        out[h] = name
    if not out:
        raise ContractError("empty allow list")
    return out


def pages(rows: Sequence[Mapping], *, fields: Sequence[str]) -> list[dict]:
    """Page inventory: exact fields, unique ids, https addresses, replacements that exist."""
    known = set()
    for r in rows:
        require_keys(r, fields, "page")
        if r["page_id"] in known:
            raise ContractError(f"repeated page {r['page_id']}")
        if not re.fullmatch(r"https://[^/@\s#?]+(?:[/?][^#\s]*)?", r["url"]):
            raise ContractError(f"bad address {r['url']}")
        known.add(r["page_id"])
    for r in rows:
        if r.get("replacement_page_id") and r["replacement_page_id"] not in known:
            raise ContractError(f"replacement {r['replacement_page_id']} does not exist")
    return [dict(r) for r in rows]


def configurations(rows: Sequence[Mapping], *, fields: Sequence[str], together: Sequence[str] = ()) -> list[dict]:
    """Configuration inventory: exact fields, unique ids, and all or none of ``together`` set."""
    known = set()
    for r in rows:
        require_keys(r, fields, "configuration")
        if r["configuration_id"] in known:
            raise ContractError(f"repeated configuration {r['configuration_id']}")
        known.add(r["configuration_id"])
        if len({bool(r[t]) for t in together}) > 1:
            raise ContractError(f"{r['configuration_id']}: give all or none of {list(together)}")
    return [dict(r) for r in rows]


def coverage(name: str, declared, used) -> None:
    """Two sets of names must be equal."""
    if set(declared) != set(used):
        raise ContractError(f"{name}: only declared {sorted(set(declared) - set(used))}, only used {sorted(set(used) - set(declared))}")


@contextmanager
def staged_folder(target: str | Path) -> Iterator[Path]:
    """A sibling folder that becomes ``target`` by one rename when the block ends well.  An
    existing target raises; a failed block leaves the staging folder for inspection."""
    target = Path(target)
    if target.exists():
        raise FileExistsError(target)
    target.parent.mkdir(parents=True, exist_ok=True)
    staging = Path(tempfile.mkdtemp(prefix=f".{target.name}.", dir=target.parent))
    yield staging
    for folder, _, files in os.walk(staging):
        for name in files:
            fd = os.open(os.path.join(folder, name), os.O_RDONLY)
            os.fsync(fd)
            os.close(fd)
    if target.exists():
        raise FileExistsError(target)
    os.rename(staging, target)


def copy_into(staging: Path, files: Mapping[str, bytes]) -> None:
    """Write files by relative path; a path that leaves the folder raises."""
    for name, content in files.items():
        place = (staging / name).resolve()
        if not place.is_relative_to(staging.resolve()):
            raise ContractError(f"{name} leaves the folder")
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(content)


def remove_folder(path: str | Path) -> None:
    shutil.rmtree(path, ignore_errors=True)
