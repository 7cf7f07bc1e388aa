"""Finding files and forming groups of them, on the driver."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

from textloom.config import Group, supported_extensions


def find_files(folder: str | Path) -> list[str]:
    """Readable files below a folder, sorted; temporary ones (`~$`) are left out."""
    return sorted(str(p) for p in Path(folder).rglob("*") if p.is_file() and p.suffix.lower() in supported_extensions() and not p.name.startswith("~$"))


def groups_from_files(paths: list[str]) -> list[Group]:
    """A group for each file, named by its stem, or `folder_stem` where stems repeat."""
    unique = sorted({str(Path(p)) for p in paths})
    stems = Counter(Path(p).stem for p in unique)
    return [Group(Path(p).stem if stems[Path(p).stem] == 1 else f"{Path(p).parent.name}_{Path(p).stem}", (p,)) for p in unique]


def groups_from_folders(root: str | Path) -> tuple[list[Group], list[str]]:
    """A group for each direct sub-folder, by lower-case name, and the names of those without readable files."""
    groups, empty = [], []
    for folder in sorted((p for p in Path(root).iterdir() if p.is_dir()), key=lambda p: p.name.lower()):
        files = find_files(folder)
        if files:
            groups.append(Group(folder.name, tuple(files)))
        else:
            empty.append(folder.name)
    return groups, empty


def unique_name(name: str, taken: set[str]) -> str:
    if name not in taken:
        return name
    k = 2
    while f"{name}({k})" in taken:
        k += 1
    return f"{name}({k})"


def add_groups(have: list[Group], new: list[Group]) -> list[Group]:
    """Groups with the files of one that is there already are skipped, names made unique."""
    out = list(have)
    seen = {tuple(sorted(g.files)) for g in have}
    for g in new:
        key = tuple(sorted(g.files))
        if key not in seen:
            seen.add(key)
            out.append(Group(unique_name(g.name, {x.name for x in out}), g.files))
    return out
