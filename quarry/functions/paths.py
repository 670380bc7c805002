"""Boolean column functions of a file's path."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rules as R


def _path(path) -> Column:
    return F.col(path) if isinstance(path, str) else path


def base(path="path") -> Column:
    return F.element_at(F.split(_path(path), "/"), -1)


def ext(path="path") -> Column:
    """Lower-cased suffix from the last dot of the base name; empty without one."""
    return F.lower(F.regexp_extract(base(path), r"(\.[^.]*)$", 1))


def dirs(path="path") -> Column:
    return F.slice(F.split(_path(path), "/"), 1, F.size(F.split(_path(path), "/")) - 1)


def _any_dir(path, names) -> Column:
    return F.arrays_overlap(F.transform(dirs(path), F.lower), F.array(*[F.lit(n) for n in names]))


def _dir_rlike(path, pattern: str) -> Column:
    return F.exists(dirs(path), lambda d: d.rlike(pattern))


def _pair(path, first: str, second: list[str], more: bool = False) -> Column:
    """A folder `first` directly followed by one of `second`."""
    tail = "/.+" if more else "/"
    return F.lower(_path(path)).rlike(rf"(^|/){first.replace('.', chr(92) + '.')}/({'|'.join(second)}){tail}")


def glob_regex(glob: str) -> str | None:
    """Anchored regex of a whole-path glob whose *, ? and [..] don't cross '/'; None if malformed."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                return None
            inner = glob[i + 1 : end]
            if inner.strip("^") == "":
                return None
            out += "[" + ("^" if inner[0] == "^" else "") + inner.lstrip("^").replace("\\", r"\\").replace("[", r"\[").replace("&", r"\&") + "]"
            i = end
        elif c == "\\":
            if i + 1 == len(glob):
                return None
            i += 1
            out += glob[i] if glob[i].isalnum() else "\\" + glob[i]
        else:
            out += c if c.isalnum() or c in "/_- " else "\\" + c
        i += 1
    try:  # ranges that go backwards
        re.compile(out)
    except re.error:
        return None
    return rf"^{out}\z"


def glob_regexes(globs: Column) -> Column:
    """The regexes of an array of globs, without those of malformed ones. Null has none."""

    def of(lists):
        import pyarrow as pa

        return pa.array([[r for g in own or [] if g is not None and (r := glob_regex(g))] for own in lists.to_pylist()], type=pa.list_(pa.string()))

    return F.arrow_udf(of, T.ArrayType(T.StringType()))(globs)


def path_excluded(globs: list[str], path="path") -> Column:
    known = [r for r in map(glob_regex, globs) if r]
    return reduce(lambda a, b: a | b, [_path(path).rlike(r) for r in known], F.lit(False))


def is_test_file(path="path") -> Column:
    return F.lower(base(path)).rlike(r"_test\.(go|py|rs|rb)$|^test_.*\.py$|\.(test|spec)\.([jt]sx?|[cm]js)$|tests?\.(java|kt|cs|php)$|spec\.kt$|_spec\.rb$|^test.*\.php$")


def is_fixture_path(path="path") -> Column:
    return is_test_file(path) | (base(path) == "conftest.py") | _any_dir(path, R.FIXTURE_DIRS) | _dir_rlike(path, r".Tests?$")


def is_data_file(path="path") -> Column:
    return ext(path).isin(R.DATA_EXTENSIONS)


def is_data_dir_file(path="path") -> Column:
    return ext(path).isin(R.DATASET_EXTENSIONS) & _any_dir(path, R.DATASET_DIRS)


def is_noisy_data_file(path="path") -> Column:
    b = F.lower(base(path))
    return ext(path).isin(R.LIST_EXTENSIONS) | b.isin("log.json", "logs.json") | b.rlike(r"\.log\.(json|txt)$") | is_data_dir_file(path)


def is_backup_path(path="path") -> Column:
    dated = r"[-_ .]backup[-_][0-9]{8}([-_][0-9]{6})?"
    return _any_dir(path, R.BACKUP_DIRS) | ext(path).isin(R.BACKUP_EXTENSIONS) | F.lower(_path(path)).rlike(dated)


def is_generated_file(path="path") -> Column:
    b = F.lower(base(path))
    return b.isin(R.GENERATED_FILES) | b.endswith(".map") | b.endswith(".pb.go")


def is_dependency_path(path="path") -> Column:
    return _any_dir(path, R.DEPENDENCY_DIRS) | F.array_contains(dirs(path), "Pods") | _pair(path, ".cargo", ["registry", "git", "bin"]) | _pair(path, ".yarn", ["cache", "unplugged", "releases", "plugins", "sdks", "berry"])


def is_generated_dir_path(path="path") -> Column:
    return _any_dir(path, R.GENERATED_DIRS) | F.exists(dirs(path), lambda d: F.lower(d).rlike(r"[_.-]cache$"))


def is_minified(path="path") -> Column:
    return F.lower(base(path)).rlike(r"\.min\.(js|css|mjs)$|\.bundle\.js$")


def is_binary_path(path="path") -> Column:
    return ext(path).isin(R.BINARY_EXTENSIONS)


def subsumed_by_vendored(path="path") -> Column:
    return is_dependency_path(path) | is_generated_dir_path(path) | _pair(path, "target", ["debug", "release"], more=True)


def is_changelog(path="path") -> Column:
    return F.lower(base(path)).isin(R.CHANGELOG_NAMES)


def is_license(path="path") -> Column:
    b = reduce(lambda c, e: F.regexp_replace(c, rf"\.{e}$", ""), ("md", "txt", "rst"), F.lower(base(path)))
    return b.isin(R.LICENSE_NAMES) | b.rlike("^licen[sc]e-")


def is_detection_rule(path="path") -> Column:
    b = F.lower(base(path))
    return ext(path).isin(".yar", ".yara") | (ext(path).isin(".yml", ".yaml", ".json", ".md") & (_any_dir(path, ["rules", "signatures", "detections"]) | b.rlike(r"^(rules|signatures|detections)\.(ya?ml|json)$")))


def is_placeholder_register(path="path") -> Column:
    return F.lower(base(path)).isin(R.PLACEHOLDER_REGISTERS)


def is_prose(path="path") -> Column:
    return ext(path).isin(R.PROSE_EXTENSIONS)


def config_kind(path="path") -> Column:
    b = F.lower(base(path))
    parts = F.transform(F.split(_path(path), "/"), F.lower)
    jsonc = b.isin("devcontainer.json", ".devcontainer.json") | b.rlike(r"^[tj]sconfig\..*json$") | F.arrays_overlap(parts, F.array(F.lit(".vscode"), F.lit(".devcontainer")))
    return F.when((ext(path) == ".json") & ~jsonc, "json").when(ext(path).isin(".yml", ".yaml"), "yaml").otherwise("none")


def file_kind(path="path") -> Column:
    b, e = base(path), ext(path)
    return (
        F.when(e.isin(".html", ".htm"), "html")
        .when(e.isin(R.STYLESHEET_EXTENSIONS) & ~F.lower(b).endswith(".min.css"), "css")
        .when(e.isin(".md", ".markdown"), "markdown")
        .when((b == "Dockerfile") | b.startswith("Dockerfile."), "dockerfile")
        .when(b.isin(R.COMPOSE_NAMES), "compose")
        .otherwise("none")
    )


#: Options of path filters: all filters are on unless switched off.
SWITCHES = (
    "skip_default_fixture_paths", "skip_default_data_files", "skip_default_backup_paths", "skip_default_generated_files", "skip_default_data_dirs", "skip_default_dependency_paths",
    "skip_default_generated_dirs",
)


def _on(scan: Column | None, switch: str) -> Column:
    return F.lit(True) if scan is None else F.coalesce(scan[switch], F.lit(True))


def should_skip(globs=(), fixtures: Column | None = None, path="path", scan: Column | None = None) -> Column:
    """fixtures: a nullable boolean option; null means true. scan: a project's options as a struct with `excluded`, an
    array of regexes, and the SWITCHES; null, or null in a field, means the default."""
    on = F.coalesce(fixtures, F.lit(True)) if fixtures is not None else _on(scan, "skip_default_fixture_paths")
    out = path_excluded(list(globs), path) | (on & is_fixture_path(path))
    return out if scan is None else out | F.exists(F.coalesce(scan["excluded"], F.array().cast("array<string>")), lambda r: F.rlike(_path(path), r))


def should_skip_secrets(globs=(), path="path", scan: Column | None = None) -> Column:
    more = (("skip_default_data_files", is_data_file), ("skip_default_backup_paths", is_backup_path), ("skip_default_generated_files", is_generated_file))
    return reduce(lambda a, m: a | (_on(scan, m[0]) & m[1](path)), more, should_skip(globs, None, path, scan))


def should_skip_content(globs=(), path="path", scan: Column | None = None) -> Column:
    more = (
        ("skip_default_data_dirs", is_noisy_data_file), ("skip_default_generated_files", is_minified), ("skip_default_dependency_paths", is_dependency_path),
        ("skip_default_generated_dirs", is_generated_dir_path),
    )
    return reduce(lambda a, m: a | (_on(scan, m[0]) & m[1](path)), more, should_skip_secrets(globs, path, scan)) | is_binary_path(path)


PREDICATES = {
    f.__name__: f
    for f in (
        is_test_file, is_fixture_path, is_data_file, is_data_dir_file, is_noisy_data_file, is_backup_path, is_generated_file, is_dependency_path, is_generated_dir_path, is_minified, is_binary_path,
        subsumed_by_vendored, is_changelog, is_license, is_detection_rule, is_placeholder_register, is_prose, config_kind, file_kind, should_skip, should_skip_secrets, should_skip_content,
    )
}
