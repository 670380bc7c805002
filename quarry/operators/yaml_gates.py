"""YAML files as rows of nodes, and the gates over them: Compose files, branch protection, parse errors.

The reader covers what such files hold: block and flow collections, quoted, plain and block
scalars, comments, tags, anchors (aliases are not followed) and several documents. It runs in
Arrow batches, a file at a time; all rules after it are columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import rules as R
from ..functions.batches import read_rows
from .lines import own_options
from .markup import apply_overrides, overrides

NODES = "project string, path string, doc int, key_path array<string>, kind string, scalar string, line int"
_FILE = ["project", "path"]

_DOUBLE, _SINGLE = r'"(?:[^"\\]|\\.)*"', r"'(?:[^']|'')*'"
_PLAIN = r"(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[-?:](?=\S))(?:[^:#]|:(?=\S)|(?<=\S)#)*?"
_KEY = re.compile(rf"({_DOUBLE}|{_SINGLE}|{_PLAIN})[ \t]*:(?=\s|\Z)\s*")
_PROPERTIES = re.compile(r"(?:[&!]\S*(?:\s+|\Z))+")
_END = {'"': re.compile(r'(?:[^"\\]|\\.|\\\Z)*?"'), "'": re.compile(r"(?:[^']|'')*?'(?!')")}
_QUOTED = re.compile(f"{_DOUBLE}|{_SINGLE}")
_FLOW = re.compile(rf"{_DOUBLE}|{_SINGLE}|[\[\]{{}},]|(?<=[\"']):|:(?=[\s,\[\]{{}}]|\Z)|(?:^|\s)#.*|\s+|(?:[^,\[\]{{}}:#]|:(?=[^\s,\[\]{{}}])|(?<=\S)#)+|.")


def _unquoted(s: str) -> str:
    if s[:1] == "'":
        return s[1:-1].replace("''", "'")
    return s[1:-1].replace('\\"', '"').replace("\\\\", "\\") if s[:1] == '"' else s.strip()


class _Broken(ValueError):
    """The file is no YAML; args: line, problem."""


def _flow(segments: list[tuple[int, str]], path: tuple, out: list) -> tuple[int, str]:
    """Adds the nodes of the flow collection that the first segment opens; (segments used, rest of the last one)."""
    stack: list[list] = []  # kind, path, items, key, value waiting
    for used, (line, text) in enumerate(segments, 1):
        at = 0
        while at < len(text):
            token = _FLOW.match(text, at).group()
            at += len(token)
            if not token.strip() or token.lstrip().startswith("#"):
                continue
            top = stack[-1] if stack else None
            if token in "[{":
                own = path if top is None else (*top[1], f"[{top[2]}]" if top[0] == "seq" else str(top[3]))
                if top:
                    top[2], top[3], top[4] = top[2] + 1, None, None
                stack.append(["seq" if token == "[" else "map", own, 0, None, None])
                out.append((own, stack[-1][0], None, line))
            elif token == ":" and top[4] is not None:
                top[3], top[4] = _unquoted(top[4]), None
            elif token in ",]}":
                if top[4] is not None or top[3] is not None:
                    key = f"[{top[2]}]" if top[0] == "seq" and top[3] is None else str(top[3] if top[3] is not None else _unquoted(top[4]))
                    value = top[4] if top[3] is not None or top[0] == "seq" else None
                    out.append(((*top[1], key), "null" if value is None else "scalar", None if value is None else _unquoted(value), line))
                    top[2], top[3], top[4] = top[2] + 1, None, None
                if token != ",":
                    if (token == "]") != (top[0] == "seq"):
                        raise _Broken(line, "a bracket doesn't match")
                    stack.pop()
                    if not stack:
                        return used, text[at:]
            elif top[4] is not None:
                raise _Broken(line, "a comma is missing")
            else:
                top[4] = token
    raise _Broken(segments[0][0], "a bracket isn't closed")


class _Reader:
    """One document after the other, a line at a time; the open collections are a stack."""

    def __init__(self, text: str):
        self.lines = [s.rstrip("\r") for s in text.removeprefix("﻿").split("\n")]
        self.at, self.doc, self.rows, self.out = 0, 0, [], []
        self._begin()

    def _begin(self) -> None:
        self.stack: list[list] = []  # indent, kind, path, items
        self.owner, self.waits, self.line, self.plain = (-1, ()), True, 1, False

    def _finish(self) -> None:
        if self.waits:
            self.rows.append((self.owner[1], "null", None, self.line))
        self.out += [(self.doc, *r) for r in self.rows]
        self.rows, self.doc = [], self.doc + 1
        self._begin()

    def nodes(self) -> list[tuple]:
        """(doc, key path, kind, scalar, line); the last row's kind is error if the file breaks off there."""
        try:
            while self.at < len(self.lines):
                self._line()
            if self.rows or not self.doc:
                self._finish()
        except _Broken as e:
            self.out += [(self.doc, *r) for r in self.rows]
            self.out.append((self.doc, (), "error", e.args[1], e.args[0]))
        return self.out

    def _line(self) -> None:
        raw, number = self.lines[self.at], self.at + 1
        self.at += 1
        body = raw.lstrip(" ")
        if not body.strip() or body.lstrip()[0] == "#":
            return
        indent = len(raw) - len(body)
        if indent == 0 and re.match(r"(?:---|\.\.\.)(?:\s|\Z)", body):
            if self.rows:
                self._finish()
            body = body[3:].strip()
            if not body or body[0] == "#":
                return
        elif indent == 0 and body[0] == "%" and not self.rows:
            return
        if body[0] == "\t":
            raise _Broken(number, "a tab indents")
        while self.stack and self.stack[-1][0] > indent:
            self.stack.pop()
        dash = body == "-" or body.startswith("- ")
        if self.stack and self.stack[-1][:2] == [indent, "seq"] and not dash:
            self.stack.pop()
        if self.plain and indent > self.owner[0]:  # a plain scalar goes on
            if _KEY.match(body):
                raise _Broken(number, "a key inside a scalar")
            return
        self._block(body, indent, number)

    def _open(self, indent: int, kind: str, number: int) -> list:
        """The collection of this kind at this indent, opened as the waiting value if there is none."""
        top = self.stack[-1] if self.stack else None
        if top and top[0] == indent and top[1] == kind:
            if self.waits:
                self.rows.append((self.owner[1], "null", None, self.line))
                self.waits = False
            return top
        flush = kind == "seq" and self.owner[0] == indent
        if not self.waits or not (indent > self.owner[0] or flush):
            raise _Broken(number, "wrong indentation")
        self.rows.append((self.owner[1], kind, None, number))
        self.stack.append([indent, kind, self.owner[1], 0])
        self.waits = False
        return self.stack[-1]

    def _block(self, body: str, indent: int, number: int) -> None:
        while body == "-" or body.startswith("- "):
            top = self._open(indent, "seq", number)
            self.owner, self.waits, self.line, self.plain = (indent, (*top[2], f"[{top[3]}]")), True, number, False
            top[3] += 1
            rest = body[1:].lstrip()
            indent, body = indent + len(body) - len(rest), rest
            if not body or body[0] == "#":
                return
        properties = _PROPERTIES.match(body)
        if properties and properties.end() == len(body):
            return
        key = _KEY.match(body, properties.end() if properties else 0)
        if key:
            top = self._open(indent, "map", number)
            self.owner, self.waits, self.line, self.plain = (indent, (*top[2], _unquoted(key.group(1)))), True, number, False
            self._value(body[key.end():], number)
        elif body[0] in "?:" or re.match(r"\*\S+\s*:", body):  # keys that are no scalars of their own are passed over
            self._open(indent, "map", number)
            self.owner, self.waits, self.plain = (indent, self.owner[1]), False, False
        elif not self.waits:
            raise _Broken(number, "a key without a colon")
        elif self.owner[0] >= indent:
            raise _Broken(number, "wrong indentation")
        else:
            self._value(body, number)

    def _value(self, value: str, number: int) -> None:
        properties = _PROPERTIES.match(value)
        value = value[properties.end():] if properties else value
        if not value or value[0] == "#":
            return
        path, first = self.owner[1], value[0]
        if first in "|>":
            start = self.at
            while self.at < len(self.lines) and (not self.lines[self.at].strip() or len(self.lines[self.at]) - len(self.lines[self.at].lstrip(" ")) > self.owner[0]):
                self.at += 1
            self._scalar("\n".join(s.strip() for s in self.lines[start:self.at]), number)
            return
        if first in "\"'":
            parts, end = [value[1:]], _END[first].match(value, 1)
            rest = value[end.end():] if end else ""
            while not end:
                if self.at >= len(self.lines):
                    raise _Broken(number, "a quote isn't closed")
                parts.append(self.lines[self.at])
                end = _END[first].match(parts[-1])
                rest = parts[-1][end.end():] if end else ""
                self.at += 1
            if rest.strip() and not rest.lstrip().startswith("#"):
                raise _Broken(number, "text behind a quote")
            whole = "\n".join(parts)
            self._scalar(_unquoted(first + whole[: len(whole) - len(rest)]), number)
            return
        if first in "[{":
            depth, segments, at = 0, [], self.at
            line = value
            while True:  # only the lines up to the last bracket are read
                segments.append((number + at - self.at, line))
                bare = _QUOTED.sub("", line)
                depth += bare.count("[") + bare.count("{") - bare.count("]") - bare.count("}")
                if depth <= 0 or at >= len(self.lines):
                    break
                line, at = self.lines[at], at + 1
            used, rest = _flow(segments, path, self.rows)
            if rest.strip() and not rest.lstrip().startswith("#"):
                raise _Broken(number, "text behind a bracket")
            self.at, self.waits = self.at + used - 1, False
            return
        if first in "@`%":
            raise _Broken(number, "a character that starts nothing")
        own = re.split(r"\s#", value, maxsplit=1)[0].strip()
        if re.search(r":(?:\s|\Z)", own):
            raise _Broken(number, "a key inside a scalar")
        self._scalar(own, number)
        self.plain = True

    def _scalar(self, value: str, number: int) -> None:
        self.rows.append((self.owner[1], "scalar", value, number))
        self.waits = False


def breaks_off(text: str) -> bool:
    """Whether the first document of a YAML text doesn't parse."""
    return any(doc == 0 and kind == "error" for doc, _, kind, _, _ in _Reader(text).nodes())


def yaml_nodes(files: DataFrame, roots: tuple[str, ...] | None = None) -> DataFrame:
    """(project, path, doc, key_path, kind, scalar, line) of YAML files (project, path, text).

    kind: map, seq, scalar, null, or error, whose scalar is the problem and with which a file
    ends. Items of a sequence are [0], [1] in a key path; the root's is empty. A null text reads
    as an empty one, which is one null node. Collections have the line of their first entry.
    roots: of the nodes below the root only those under these keys leave the reader.
    """

    def read(project: str, path: str, text: str | None) -> Iterator[tuple]:
        for doc, keys, kind, scalar, line in _Reader(text or "").nodes():
            if roots is None or not keys or keys[0] in roots:
                yield project, path, doc, keys, kind, scalar, line

    return read_rows(files, [*[F.col(c).cast("string") for c in _FILE], "text"], read, NODES, lambda row: len(row[5] or ""))


def _at(*keys: str | None) -> Column:
    """The key path has these keys and no more; None stands for any."""
    out = F.size("key_path") == len(keys)
    for k, key in enumerate(keys):
        if key is not None:
            out = out & (F.get("key_path", F.lit(k)) == key)
    return out


def _is_item(k: int) -> Column:
    return F.get("key_path", F.lit(k)).rlike(r"^\[[0-9]+\]\z")


def compose_lint(files: DataFrame, disabled: tuple[str, ...] = (), orchestrators: tuple[str, ...] = (), own_images: DataFrame | None = None) -> DataFrame:
    """(project, path, line, rule) over Compose files: yaml_invalid, privileged_true, network_mode_host,
    docker_socket_mount (.._orchestrator for images that need it), missing_memory_limit.

    One aggregate a service over the file's nodes, which are read once; only the first document counts. own_images: (project, images) of
    projects with more images that need the socket.
    """
    composes = files.where(P.base().isin(R.COMPOSE_NAMES) & ~P.should_skip_content(scan=own_options(files, "compose_lint")))
    nodes = yaml_nodes(composes, ("services",)).where("doc = 0")
    scalar = F.col("kind") == "scalar"
    bad = (F.col("kind") == "error") | (_at() & (F.col("kind") != "map"))
    first = lambda c, v: F.min(F.when(c, v))
    sock = F.col("scalar").contains("/var/run/docker.sock") & scalar & _is_item(3)
    mounted = (_at("services", None, "volumes", None) & sock) | (_at("services", None, "volumes", None, "source") & sock)
    item = F.struct(F.get("key_path", F.lit(3)).alias("item"), "line")
    # a file's row without a service says whether it is one
    each = nodes.where(bad | (F.size("key_path") >= 2)).withColumn("service", F.get("key_path", F.lit(1))).groupBy(*_FILE, "service").agg(
        F.max(bad).alias("bad"),
        first(_at("services", None) & (F.col("kind") == "map"), F.col("line")).alias("own"),
        first(_at("services", None, "privileged") & scalar & F.lower(F.trim("scalar")).isin("true", "yes", "on"), F.col("line")).alias("privileged"),
        first(_at("services", None, "network_mode") & (F.col("scalar") == "host"), F.col("line")).alias("host"),
        first(mounted, F.struct("line", F.get("key_path", F.lit(3)).alias("item"))).alias("mount"),
        F.collect_list(F.when(_at("services", None, "volumes", None), item)).alias("items"),
        first(_at("services", None, "image") & scalar, F.lower("scalar")).alias("image"),
        F.max(_at("services", None, "image") | _at("services", None, "command") | _at("services", None, "entrypoint")).alias("runs"),
        F.max(_at("services", None, "mem_limit") | _at("services", None, "deploy", "resources", "limits", "memory")).alias("limited"),
    ).withColumn("broken", F.max("bad").over(W.partitionBy(*_FILE)))
    name = F.regexp_extract("image", "^([^:@]*)", 1)
    known = F.lit(False)
    for o in (*R.ORCHESTRATOR_IMAGES, *(x.lower() for x in orchestrators)):
        known = known | (name == o) | name.endswith("/" + o)
    if own_images is not None:
        each = each.join(own_images, "project", "left")
        known = known | F.exists(F.coalesce("images", F.array().cast("array<string>")), lambda i: (name == F.lower(i)) | name.endswith(F.concat(F.lit("/"), F.lower(i))))
    rule = F.when(F.coalesce(known, F.lit(False)), "docker_socket_mount_orchestrator").otherwise("docker_socket_mount")
    row = lambda line, r: F.struct(line.cast("int").alias("line"), r.alias("rule"))
    named = lambda line, r: F.when(F.col(line).isNotNull(), row(F.col(line), F.lit(r)))
    mounts = F.transform(F.filter("items", lambda i: i["item"] == F.col("mount.item")), lambda i: row(i["line"], rule))
    found = F.concat(
        F.array_compact(F.array(named("privileged", "privileged_true"), named("host", "network_mode_host"), F.when(F.col("runs") & ~F.col("limited"), row(F.col("own"), F.lit("missing_memory_limit"))))),
        F.coalesce(mounts, F.array().cast("array<struct<line:int,rule:string>>")),
    )
    invalid = F.when(F.col("service").isNull() & F.col("bad"), F.array(row(F.lit(1), F.lit("yaml_invalid"))))
    lints = F.when(~F.col("broken") & F.col("own").isNotNull(), found)
    out = each.select(*_FILE, F.inline(F.coalesce(invalid, lints)))
    return out.where(~F.col("rule").isin(*disabled)) if disabled else out


def compose_overridden(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings of compose_lint as inline overrides change them; one of docker_socket_mount covers orchestrators too."""
    over = overrides(files.where(P.base().isin(R.COMPOSE_NAMES)), inline=True)
    both = F.array_union("ids", F.array(F.lit("docker_socket_mount_orchestrator")))
    return apply_overrides(findings, over.withColumn("ids", F.when(F.array_contains("ids", "docker_socket_mount"), both).otherwise(F.col("ids"))))


def branch_protection_missing(projects: DataFrame, files: DataFrame) -> DataFrame:
    """Projects without a settings file, or whose file has no entry of `branches` with a protection mapping."""
    nodes = yaml_nodes(files.where(F.col("path") == ".github/settings.yml"), ("branches",)).where("doc = 0")
    broken = nodes.where("kind = 'error'").select("project")
    have = nodes.where(_at("branches", None, "protection") & _is_item(1) & (F.col("kind") == "map")).select("project").distinct()
    return projects.select("project").distinct().join(have.join(broken, "project", "left_anti"), "project", "left_anti")


def yaml_parse_errors(files: DataFrame, most: int = 5 << 20) -> DataFrame:
    """(project, path) of YAML files that don't parse; templates are not YAML yet and are left out."""
    template = F.col("text").rlike(r"\{\{|\{%|<%")
    own = files.where((P.config_kind() == "yaml") & (F.col("size") > 0) & (F.col("size") <= most) & ~P.should_skip_content(scan=own_options(files, "config_parse_error")) & ~template)
    return yaml_nodes(own, ()).where("kind = 'error'").select(*_FILE)
