"""Name and path column functions (all built-in expressions, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def name_to_dir(name: str | Column) -> Column:
    """Dotted class name to a directory name: every '.' becomes '_' (literal, not regex)."""
    return F.replace(_c(name), F.lit("."), F.lit("_"))


def name_to_member(name: str | Column, ext: str = ".class") -> Column:
    """Dotted class name to its archive member path: '.' -> '/' plus the extension."""
    return F.concat(F.replace(_c(name), F.lit("."), F.lit("/")), F.lit(ext))


def test_name(name: str | Column, suffix: str = "_ESTest") -> Column:
    """Generated test class name."""
    return F.concat(_c(name), F.lit(suffix))


def first_segment(name: str | Column, sep: str = ".") -> Column:
    return F.split_part(_c(name), F.lit(sep), F.lit(1))


def last_segment(name: str | Column, sep: str = ".") -> Column:
    return F.split_part(_c(name), F.lit(sep), F.lit(-1))


def artifact_path(base: str | Column, project: str | Column, name: str | Column) -> Column:
    """base/project/<class with '_'>: the per-class output directory."""
    return F.concat_ws("/", _c(base), _c(project), name_to_dir(name))


def test_file_path(base: str | Column, project: str | Column, name: str | Column, suffix: str = "_ESTest.java") -> Column:
    """base/project/<class with '_'>/<simple name><suffix>."""
    return F.concat_ws("/", artifact_path(base, project, name), F.concat(last_segment(name), F.lit(suffix)))


def parent_dir(path: str | Column) -> Column:
    """Text before the last '/', '' when there is none."""
    return F.regexp_extract(_c(path), r"^(.*)/[^/]*$", 1)


def depth(path: str | Column) -> Column:
    """Number of directories above the last segment: top-level entries sort before nested ones."""
    return F.size(F.split(_c(path), "/")) - 1


def rebase(path: str | Column, src_root: str, dst_root: str) -> Column:
    """Path relative to ``src_root`` joined to ``dst_root``; NULL when outside ``src_root``."""
    p = _c(path)
    src = src_root.rstrip("/") + "/"
    dst = dst_root.rstrip("/") + "/"
    return F.when(p.startswith(src), F.concat(F.lit(dst), F.substr(p, F.lit(len(src) + 1))))


def relative_to(path: str | Column, root: str) -> Column:
    """Path relative to ``root``; NULL when outside it."""
    p = _c(path)
    src = root.rstrip("/") + "/"
    return F.when(p.startswith(src), F.substr(p, F.lit(len(src) + 1)))


def keys_from_path(path: str | Column, root: str) -> tuple[Column, Column]:
    """(project, class) from root/<project>/.../<Class>.<ext>; NULL unless at least two parts."""
    rel = relative_to(path, root)
    parts = F.split(rel, "/")
    ok = F.size(parts) >= 2
    project = F.when(ok, F.get(parts, 0))
    stem = F.when(ok, F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", ""))
    return project, stem


def join_paths(*arrays: str | Column, sep: str = ":") -> Column:
    """Concatenate path arrays and join them with ``sep`` (a classpath string)."""
    return F.array_join(F.concat(*[_c(a) for a in arrays]), sep)
